import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lexmill.llm import budget, packing, pieces
from lexmill.llm.text import count_tokens, split_tokens


def text_of(n, seed=0):
    rng = random.Random(seed)
    out = []
    for k in range(n):
        w = rng.choice(["bail", "loyer", "contrat", "terme", "partie", "عقد"])
        out.append(w + (".\n\n" if k % 97 == 96 else ".\n" if k % 41 == 40 else ". " if k % 13 == 12 else " "))
    return "".join(out)


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 3000), st.integers(0, 5))
def test_pieces_tile_the_text(n, seed):
    text = text_of(n, seed)
    parts = pieces.pieces_of(text)
    assert all(p["tokens"] <= 512 for p in parts)
    tokens = split_tokens(text)
    for a, b in zip(parts, parts[1:]):
        assert a["first_token"] + a["tokens"] - b["first_token"] == 64
    rebuilt = split_tokens(parts[0]["text"]) + [w for p in parts[1:] for w in split_tokens(p["text"])[64:]]
    assert rebuilt == tokens


def test_cuts_fall_on_boundaries_and_edits_stay_local():
    text = text_of(4000, 1)
    parts = pieces.pieces_of(text)
    assert {p["ends_at"] for p in parts[:-1]} <= {"sentence", "paragraph", "heading"}
    edited = "Un mot de plus. " + text
    same = {p["text"] for p in parts} & {p["text"] for p in pieces.pieces_of(edited)}
    assert len(same) >= len(parts) - 3


def test_no_boundary_and_one_long_word():
    parts = pieces.pieces_of(" ".join(["mot"] * 1500))
    assert all(p["tokens"] <= 512 for p in parts) and len(parts) > 2
    assert len(pieces.pieces_of("x" * 100_000)) == 1


def test_pieces_table(spark):
    rows = [("a", text_of(600), None), ("a", text_of(600), None), ("b", "court", "s"), ("c", None, None), (None, text_of(513), None)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "chunk_id string, text string, section string, piece_no int")
    assert {r[0] for r in pieces.found(df).collect()} == {"a", None}
    assert pieces.pieces(df).where("chunk_id = 'a'").count() == len(pieces.pieces_of(text_of(600)))
    assert pieces.found(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        pieces.pieces_of(text_of(600), limit=100, overlap=90)


def test_tokens_are_split_at_five_characters_only():
    assert count_tokens("a b c\td\ne\rf\fg h\x0bi") == 7
    assert count_tokens(None) == 0 and count_tokens(" \n") == 0


def test_budget_found(spark):
    rows = [("a", "un deux trois", 3), ("b", "un deux", None), ("c", "un deux", 5), ("d", None, 0), ("e", None, 2), ("b", "un deux", None), (None, "x", 9)]
    rows += [(f"f{k}", "mot " * (k % 50) + "fin 12, ok.", k % 50 + 3) for k in range(300)]
    df = spark.createDataFrame([(*r, "fr" if k % 2 else None, "s", "c") for k, r in enumerate(rows)], "chunk_id string, text string, token_count int, language string, source string, category string")
    assert {r[0] for r in budget.found(df).collect()} == {"b", "c", "e", None}
    assert budget.found(df.limit(0)).count() == 0


def test_totals_count_each_chunk_once(spark):
    rows = [("a", "un deux trois", 3, "fr", "s", "c")] * 3 + [("b", "un", 1, "FR-ma", "s", "c"), ("c", "اثنان هنا", 2, "ar", "t", None), ("b", None, 1, "fr", "s", "c")]
    docs = spark.createDataFrame([(1, "un deux", "fr", "s", "c"), (1, "un deux", "fr", "s", "c"), (2, None, None, "u", "c")], "doc_id long, text string, lang string, source string, category string")
    chunks = spark.createDataFrame(rows, "chunk_id string, text string, token_count int, language string, source string, category string")
    out = {r["source"]: r for r in budget.totals(chunks, docs).collect()}
    assert out["s"]["chunks"] == 3 and out["s"]["tokens"] == 4 and out["t"]["tokens"] == 2 and out["s"]["documents"] == 1 and out["s"]["document_tokens"] == 2
    assert out["u"]["language"] == "other" and out["u"]["documents"] == 1 and out["u"]["document_tokens"] == 0


def test_features_hold_no_count_of_tokens():
    assert budget.features("l'an 12, a-b c")[0] == 6 and budget.features("") == [0, 0, 0, 0, 0, 0]


def test_estimate_holds_on_held_out_chunks():
    count = budget.byte_pairs()
    texts = [("fr" if k % 2 else "ar", (text_of(50 + k, k) if k % 2 else "العقد شريعة المتعاقدين. " * (k % 30 + 3))) for k in range(300)]
    model = budget.fit(texts[:200], count)
    for lang in ("fr", "ar"):
        own = [t for a, t in texts[200:] if a == lang]
        said = sum(float(np.dot(model[lang][0], budget.features(t))) for t in own)
        assert abs(said / sum(map(count, own)) - 1) < 0.05


def test_a_missing_tokenizer_is_an_error():
    with pytest.raises(FileNotFoundError):
        budget.byte_pairs("/nowhere/vocabulary.tiktoken")


def test_packing_by_the_rule():
    rng = np.random.default_rng(1)
    sizes = rng.integers(1, 1025, 3000)
    place = packing.sum_of_squares(sizes)
    fill = np.bincount(place, weights=sizes)
    assert fill.max() <= 1024 and len(place) == 3000
    assert sizes.sum() / (len(fill) * 1024) > 0.9
    sizes = rng.lognormal(5.4, 0.7, 8000).astype(int).clip(1, 1024)
    assert sizes.sum() / (len(np.bincount(packing.sum_of_squares(sizes))) * 1024) > 0.98


def test_packing_matches_the_definition():
    rng = random.Random(2)
    sizes = [rng.randint(1, 20) for _ in range(200)]
    gaps: list[int] = []
    want = []
    for s in sizes:
        def cost(g):
            n = {}
            for x in g:
                if 0 < x < 20:
                    n[x] = n.get(x, 0) + 1
            return sum(v * v for v in n.values())
        options = [(cost([*gaps[:k], gaps[k] - s, *gaps[k + 1 :]]), 0) for k in range(len(gaps)) if gaps[k] >= s]
        fresh = cost([*gaps, 20 - s])
        want.append(min([x for x, _ in options] + [fresh]))
        hits = [k for k in range(len(gaps)) if gaps[k] >= s and cost([*gaps[:k], gaps[k] - s, *gaps[k + 1 :]]) == want[-1]]
        if hits and want[-1] <= fresh:
            gaps[min(hits, key=lambda k: gaps[k])] -= s
        else:
            gaps.append(20 - s)
    place = packing.sum_of_squares(np.array(sizes), 20)
    assert len(set(place.tolist())) == len(gaps)


def test_pack_table(spark):
    docs = [(1, "mot " * 3000), (2, None), (3, ""), (4, "a b c"), (5, "mot " * 1024), (6, "x")]
    out = packing.pack(spark.createDataFrame([(*d, 0) for d in docs], "doc_id long, text string, container int"), tokens=count_tokens)
    rows = out.collect()
    per = {}
    for r in rows:
        per[r["doc_id"]] = per.get(r["doc_id"], 0) + r["tokens"]
    assert per == {1: 3000, 2: 0, 3: 0, 4: 3, 5: 1024, 6: 1}
    assert sum(r["doc_id"] == 1 for r in rows) == 3 and sum(r["doc_id"] == 5 for r in rows) == 1
    assert packing.fill(out).first()["containers"] >= 4
    assert packing.pack(out.select("doc_id").withColumn("text", out["doc_id"].cast("string")).limit(0)).count() == 0
