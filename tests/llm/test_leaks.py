import random

import numpy as np
import pytest

from lexmill.llm import leaks
from lexmill.llm.text import bare_words


def brute(docs, items, window):
    out = set()
    for i, t in docs:
        w = bare_words(t or "")
        grams = {tuple(w[k : k + window]) for k in range(len(w) - window + 1)}
        for j, x in items:
            v = bare_words(x or "")
            if any(tuple(v[k : k + window]) in grams for k in range(len(v) - window + 1)):
                out.add((i, j))
    return out


def test_against_brute_force(spark):
    rng = random.Random(1)
    words = ["le", "bail", "Été", "garantie", "n°", "12", "عقد", "a", "b", "c", "d'accord"]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(k, text(rng.randint(0, 60))) for k in range(30)]
    docs = []
    for k in range(120):
        t = text(rng.randint(0, 80))
        if k % 3 == 0:
            w = items[k % 30][1].upper().split()
            a = rng.randint(0, max(0, len(w) - 15))
            t += "\n" + ",  ".join(w[a : a + rng.choice([14, 15, 20])])
        docs.append((k, t))
    docs += [(900, None), (901, ""), docs[0]]
    d = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, item_id string")
    e = spark.createDataFrame([*items, (99, None)], "item_id long, text string")
    got = {(r[0], r[1]) for r in leaks.found(d, e).collect()}
    assert got == brute(docs, items, 15)
    assert got


def test_accents_case_and_line_breaks_do_not_matter(spark):
    words = [f"mot{k}" for k in range(15)]
    words[3] = "été"
    d = spark.createDataFrame([(1, "\n".join(words).upper().replace("É", "É")), (2, " ".join(words[:14]))], "doc_id long, text string")
    e = spark.createDataFrame([(7, " ".join(words))], "item_id long, text string")
    assert [tuple(r) for r in leaks.leaked_spans(d, e).collect()] == [(1, 7, 0, 15)]


def test_empty_tables(spark):
    d = spark.createDataFrame([], "doc_id long, text string")
    e = spark.createDataFrame([], "item_id long, text string")
    assert leaks.found(d, e).count() == 0
    assert leaks.found(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), e).count() == 0


def test_spans_merge_and_repeat_in_one_document():
    assert leaks.merged([0, 1, 2, 40], 15) == [(0, 17), (40, 55)]


def test_index_counts_like_a_scan():
    rng = np.random.default_rng(3)
    codes = rng.integers(1, 5, 3000)
    index = leaks.FMIndex(codes, 5)
    patterns = rng.integers(1, 5, (200, 6))
    rows, lo, hi = index.search(patterns)
    said = dict(zip(rows.tolist(), (hi - lo).tolist(), strict=True))
    for k, p in enumerate(patterns):
        real = sum(1 for a in range(len(codes) - 5) if (codes[a : a + 6] == p).all())
        assert said.get(k, 0) == real
        if real:
            at = np.flatnonzero(rows == k)[0]
            assert all((codes[a : a + 6] == p).all() for a in index.locate(np.arange(lo[at], hi[at])))


def test_suffix_order_of_repeated_runs():
    codes = np.array([3, 2, 3, 2, 3, 2, 1] * 40 + [3, 2] * 30 + [0])
    sa = leaks.suffix_order(codes, 2)
    assert sa.tolist() == sorted(range(len(codes)), key=lambda k: codes[k:].tolist())


def test_repeated_documents_and_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(leaks, "ITEMS_A_BLOCK", 2)
    text = " ".join(f"mot{k}" for k in range(60))
    docs = [(k, text if k % 2 else f"autre {k} {text[:200]}") for k in range(12)]
    items = [(k, " ".join(text.split()[k * 5 : k * 5 + 18])) for k in range(8)]
    got = {(r[0], r[1]) for r in leaks.found(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == brute(docs, items, 15)


def test_window_bound():
    with pytest.raises(ValueError):
        leaks.leaked_spans(None, None, 0)
