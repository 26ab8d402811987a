from collections import defaultdict

import numpy as np

from lexmill.llm import sitelines


def brute(docs):
    per, where = defaultdict(set), []
    seen = defaultdict(set)
    for i, s, t in docs:
        per[s].add(i)
        for k, line in enumerate((t or "").split("\n")):
            x = "".join(c for c in line if c.isalpha()).lower()
            if len(x) >= 12:
                seen[(s, x)].add(i)
                where.append((i, s, k, x))
    return {(i, k) for i, s, k, x in where if len(seen[(s, x)]) >= 5 and len(seen[(s, x)]) >= 0.08 * len(per[s])}


def test_against_brute_force(spark):
    docs = []
    for k in range(120):
        body = [f"phrase tout à fait propre au document numéro {chr(97 + k % 26)}{chr(97 + k // 26)}"]
        if k % 4 == 0:
            body = ["Accueil > Textes > Page", *body, f"Tous droits réservés, le site {k}"]
        if k % 9 == 0:
            body.append("  TOUS DROITS réservés — le site ")
        if k % 40 == 0:
            body.append("une ligne trop rare pour compter")
        docs.append((k, "a" if k < 100 else None, "\n".join(body)))
    docs += [(500, "a", None), (501, "b", "Accueil > Textes > Page"), (502, "a", "")]
    df = spark.createDataFrame([(*d, "z") for d in docs], "doc_id long, source string, text string, key string")
    got = {(r[0], r[1]) for r in sitelines.found(df).collect()}
    assert got == brute(docs)
    assert len(got) > 50


def test_shards_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(sitelines, "SHARD_DOCS", 7)
    docs = [(k, "a", f"ligne particulière {chr(97 + k % 26) * 5}{k}" + ("\nmention légale répétée" if k % 10 == 0 else "")) for k in range(100)]
    got = {(r[0], r[1]) for r in sitelines.found(spark.createDataFrame(docs, "doc_id long, source string, text string")).collect()}
    assert got == brute(docs)
    assert len(got) >= 10


def test_cleaned_keeps_every_document(spark):
    docs = [(k, "a", f"propre au document {'abcdefghij'[k]} seulement\nmention légale répétée") for k in range(10)] + [(99, "a", None)]
    out = {r["doc_id"]: r for r in sitelines.cleaned(spark.createDataFrame(docs, "doc_id long, source string, text string")).collect()}
    assert len(out) == 11 and out[99]["text"] is None
    assert out[3]["text"] == "propre au document d seulement" and out[3]["lines_removed"] == 1


def test_blocks_are_as_long_as_they_repeat():
    doc = np.array([0, 0, 0, 1, 1, 1, 2, 2])
    key = np.array([7, 8, 1, 7, 8, 2, 7, 8])
    assert ([7, 8], 3) in sitelines.repeated_blocks(doc, key, 3)
    assert sitelines.repeated_blocks(doc[:0], key[:0], 1) == []


def test_empty(spark):
    assert sitelines.found(spark.createDataFrame([], "doc_id long, source string, text string")).count() == 0


def test_tiny_sources(spark):
    docs = [(1, "a", "une seule ligne assez longue"), (2, "b", ""), (3, "c", None)]
    assert sitelines.found(spark.createDataFrame(docs, "doc_id long, source string, text string")).count() == 0
    assert sitelines.repeated_blocks(np.array([0]), np.array([5]), 1.0) == [([5], 1)]
