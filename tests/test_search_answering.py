import math

import pytest
from pyspark.sql import functions as F

from lexmill.operators import answering, search


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([("a", "bail bail loyer"), ("b", "loyer du terrain"), ("c", "contrat de travail"), ("d", None)], "doc_id string, text string")


def test_bm25_by_hand(spark, docs):
    q = spark.createDataFrame([(1, "bail loyer loyer"), (2, "rien"), (3, "")], "query_id int, question string")
    got = {r["doc_id"]: r["score"] for r in search.bm25(docs, "doc_id", "text", q).collect()}
    n, avg = 4, 9 / 4
    idf = lambda df: math.log(1 + (n - df + 0.5) / (df + 0.5))
    part = lambda tf, length: tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * length / avg))
    assert set(got) == {"a", "b"}
    assert got["a"] == pytest.approx(idf(1) * part(2, 3) + 2 * idf(2) * part(1, 3), abs=0.2)


def test_cosine_and_filters(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 1.0]), (4, [0.0, 0.0]), (5, None)], "id int, v array<float>")
    q = spark.createDataFrame([(9, [2.0, 0.0])], "query_id int, query_vector array<float>")
    assert [(r["id"], r["score"]) for r in search.cosine_topk(v, "id", "v", q, 3).orderBy("rank").collect()] == [(1, 1.0), (3, 0.707107), (2, 0.0)]
    with pytest.raises(ValueError, match="unknown filter field: text"):
        search.check_filters({"text": "x"})
    m = spark.createDataFrame([("a", "fr", {"jurisdiction": "X"}), ("b", "ar", {})], "doc_id string, language string, metadata map<string,string>")
    assert [r[0] for r in search.metadata_filter(m, {"language": "fr", "jurisdiction": "X"}).collect()] == ["a"]


def test_fusion_ignores_scales_and_weight_zero(spark):
    a = spark.createDataFrame([(1, "x", 1), (1, "y", 2)], "query_id int, id string, rank int")
    b = spark.createDataFrame([(1, "y", 1), (1, "z", 2)], "query_id int, id string, rank int")
    got = search.reciprocal_rank_fusion({"dense": (a, 1.0), "lexical": (b, 1.0)}, "id", 2).orderBy("rank").collect()
    assert [(r["id"], r["methods"]) for r in got] == [("y", "dense+lexical"), ("x", "dense")]
    assert [r["id"] for r in search.reciprocal_rank_fusion({"dense": (a, 1.0), "lexical": (b, 0.0)}, "id", 8).orderBy("rank").collect()] == ["x", "y"]


def test_upsert_and_delete(spark):
    t = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    c = spark.createDataFrame([(2, "c", 1), (2, "d", 2), (3, "e", 1)], "k int, v string, _version int")
    out = search.upsert(t, c, "k")
    assert {tuple(r) for r in out.collect()} == {(1, "a"), (2, "d"), (3, "e")}
    assert search.delete_documents(out, spark.createDataFrame([(1,)], "k int"), "k").count() == 2


def test_embedding_is_unit_and_repeats():
    v = search.embed_words("Bail et loyer", 64)
    assert sum(x * x for x in v) == pytest.approx(1) and v[:32] == v[32:]
    assert search.embed_words(None, 4) == [0.0] * 4


def test_recall_and_latency(spark):
    got = spark.createDataFrame([(1, "a", 1), (1, "b", 9)], "query_id int, id string, rank int")
    rel = spark.createDataFrame([(1, ["a", "b"]), (2, ["c"])], "query_id int, relevant array<string>")
    assert {tuple(r) for r in search.recall_at_k(got, rel, "id", 8).collect()} == {(1, 0.5), (2, 0.0)}
    x = spark.range(1, 21).select(F.col("id").cast("double").alias("v"))
    assert search.latency_summary(x, "v").first()["p95"] == 19.0


def test_compression(spark):
    c = answering.CompressionConfig

    def compressed(texts, config):
        rows = spark.createDataFrame([(1, k, f"c{k}", t) for k, t in enumerate(texts)], "query_id int, rank int, chunk_id string, text string")
        return [(r["rank"], r["text"]) for r in answering.compress(rows, config).orderBy("rank").collect()]

    assert compressed(["Un deux trois. Quatre cinq."], c(budget=4)) == [(0, "Un deux trois.")]
    assert compressed(["un deux trois quatre"], c(budget=2)) == [(0, "un deux")]
    assert compressed(["Un deux. Trois quatre cinq. Six."], c(budget=3)) == [(0, "Un deux.")]
    assert compressed(["a b c", "A, b. C!", "d"], c()) == [(0, "a b c"), (2, "d")]
    assert len(compressed([f"mot{k}" for k in range(20)], c())) == 8
    assert compressed(["a", "a", None], c(enabled=False)) == [(0, "a"), (1, "a"), (2, "")]
    assert compressed(["", "x y"], c()) == [(1, "x y")]
    with pytest.raises(ValueError):
        c(budget=0)


def test_refusals_in_order_and_grounding(spark):
    requests = spark.createDataFrame([(1, " "), (2, "la météo"), (3, "le bail perdu"), (4, "le bail")], "query_id int, question string")
    contexts = spark.createDataFrame([(4, 1, "c1", "Le bail dure un an."), (4, 2, "c2", "Autre.")], "query_id int, rank int, chunk_id string, text string")
    got = {r["query_id"]: r for r in answering.answers(requests, contexts, ["bail"]).collect()}
    assert [got[k]["refusal_reason"] for k in (1, 2, 3, 4)] == ["empty_question", "out_of_scope", "insufficient_context", None]
    assert got[4]["cited"] == ["c1"] and answering.DISCLAIMER in got[4]["answer"]
    bad = answering.answers(requests.where("query_id = 4"), contexts, ["bail"], lambda c: F.lit("sans source")).first()
    assert bad["refusal_reason"] == "ungrounded_generation"
    check = spark.createDataFrame([("x [chunk_id:a]", ["a"], ["a", "b"], True), ("x", ["a"], ["a"], False), ("x [chunk_id:z]", ["z"], ["a"], False), ("x [chunk_id:b]", ["a"], ["a", "b"], False), ("", [], ["a"], False)], "t string, cited array<string>, got array<string>, want boolean")
    assert all(r[0] == r[1] for r in check.select(answering.grounded(F.col("t"), F.col("cited"), F.col("got")), "want").collect())
    assert [e["event"] for e in answering.events("a b", False)] == ["start", "text_delta", "text_delta", "final", "done"]


def test_generator_contract_and_rate(spark):
    p = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "query_id int, prompt string")
    replies = {"a": '{"answer": "Oui [chunk_id:x]", "citations": ["x"]}', "b": "pas du JSON", "c": '{"answer": " ", "citations": []}'}
    got = {r["query_id"]: r for r in answering.generated(p, lambda xs: [replies[x] for x in xs]).collect()}
    assert got[1]["cited"] == ["x"] and got[1]["error"] is None and got[2]["answer"] is None and got[2]["error"] and got[3]["error"]
    assert all(r["error"].startswith("RuntimeError") for r in answering.generated(p, _broken).collect())
    q = spark.createDataFrame([("u", "2024-01-01 00:00:0%d" % k) for k in range(7)] + [("u", "2024-01-01 00:01:01")], "k string, t string").selectExpr("k", "cast(t as timestamp) as t")
    assert answering.within_rate(q, "k", "t", 5, 60).where("allowed").count() == 6


def _broken(_):
    raise RuntimeError("no model")


def test_adapters(spark):
    d = spark.createDataFrame([("a", "un deux"), ("b", None)], "id string, t string")
    assert {r["id"]: r["embedding"] for r in search.embedded(d, "id", "t", lambda xs: [[len(x), 1] for x in xs], 2).collect()} == {"a": [7.0, 1.0], "b": [0.0, 1.0]}
    with pytest.raises(Exception, match="one vector of 3"):
        search.embedded(d, "id", "t", lambda xs: [[1, 2] for _ in xs], 3).collect()
    c = spark.createDataFrame([(1, "q", "a", "xx", 1), (1, "q", "b", "x", 2)], "query_id int, question string, id string, text string, rank int")
    assert [r["id"] for r in search.pairwise_rerank(c, "question", "text", "id", lambda ps: [-len(t) for _, t in ps], 2).orderBy("rank").collect()] == ["b", "a"]


def test_approximate_search_finds_most(spark):
    import random

    rng = random.Random(3)
    rows = [(k, [rng.gauss(k % 7, 1) if j == k % 7 else rng.gauss(0, 1) for j in range(16)]) for k in range(600)] + [(9999, None)]
    v = spark.createDataFrame(rows, "id long, v array<double>")
    q = v.where("id % 50 = 0").selectExpr("id as query_id", "v as query_vector")
    exact = search.cosine_topk(v, "id", "v", q, 10).groupBy("query_id").agg(F.collect_set("id").alias("relevant"))
    found = search.recall_at_k(search.approximate_topk(v, "id", "v", q, search.fit_cells(v, "id", "v", 8), 5, 10), exact, "id", 10)
    assert found.agg(F.avg("recall")).first()[0] >= 0.9
    assert search.cosine_topk(v, "id", "v", q.limit(0), 3).count() == 0


def test_index_equals_search_without_one(spark, tmp_path):
    docs = spark.createDataFrame([("a", "le bail commercial"), ("b", "le titre foncier et le bail"), ("c", None), ("d", "autre texte"), ("a", "le bail")], "id string, t string")
    q = spark.createDataFrame([(1, "bail foncier"), (2, "rien du tout")], "query_id int, question string")
    index = search.Index.build(docs, "id", "t", str(tmp_path / "index"))
    want = [tuple(r) for r in search.bm25(docs, "id", "t", q, 5, unique=False).orderBy("query_id", "rank").collect()]
    assert [tuple(r) for r in index.lexical(q, 5).orderBy("query_id", "rank").select("query_id", "key", "score", "rank").collect()] == want and want
    assert index.retrieve(q, 0).count() == 8


def test_fingerprint_of_long_keys(spark):
    import hashlib
    import hmac

    from lexmill.functions import text as T

    for key in ("court", "k" * 64, "clé très longue " * 10):
        got = spark.createDataFrame([("message", key)], "m string, k string").select(T.keyed_fingerprint(F.col("m"), F.col("k"))).first()[0]
        assert got == hmac.new(key.encode(), b"message", hashlib.sha256).hexdigest()[:32]
