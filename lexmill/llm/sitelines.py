"""Problem 6: lines that one source repeats over many of its documents.

Each line becomes a 64-bit identifier of its letters. The documents of a source are dealt to shards of
bounded size; each shard's line identifiers are put one after the other and sorted as suffixes, and the
common prefixes of neighbouring suffixes give the blocks of lines that repeat. A line in a share of a
source's documents is in at least that share of one shard's documents, so every such line is in a block
of some shard; the counts over all documents, which follow, keep those that pass and no others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm.text import arrow_map, hash64
from lexmill.session import staged

MIN_LETTERS = 12
MIN_DOCS = 5
MIN_SHARE = 0.08
#: Documents of a shard, about; a source of any size is dealt to as many shards as it needs.
SHARD_DOCS = 4000


class _Letters(dict):
    """The letters of each space-separated word, in lower case; emptied when it grows large."""

    def __missing__(self, word: str) -> str:
        if len(self) > 400_000:
            self.clear()
        x = self[word] = word.lower() if word.isalpha() else "".join(filter(str.isalpha, word)).lower()
        return x


def line_keys(text: str, letters: dict[str, str] | None = None) -> tuple[list[int], list[int]]:
    """Numbers and identifiers of the lines with at least MIN_LETTERS letters."""
    get = (_Letters() if letters is None else letters).__getitem__
    numbers, keys = [], []
    for k, line in enumerate(text.split("\n")):
        x = "".join(map(get, line.split()))
        if len(x) >= MIN_LETTERS:
            numbers.append(k)
            keys.append(hash64(x))
    return numbers, keys


def suffix_array(codes: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Suffixes in order, and their ranks by the first 1, 2, 4, ... codes, until no two suffixes are alike."""
    n = len(codes)
    rank = np.unique(codes, return_inverse=True)[1].astype(np.int64)
    ranks, span = [rank], 1
    while span < n and int(rank.max(initial=-1)) < n - 1:
        after = np.zeros(n, np.int64)
        after[: max(n - span, 0)] = rank[span:] + 1
        key = rank * (n + 2) + after
        rank = np.unique(key, return_inverse=True)[1].astype(np.int64)
        ranks.append(rank)
        span *= 2
    return np.argsort(rank, kind="stable"), ranks


def repeated_blocks(doc: np.ndarray, key: np.ndarray, least: float) -> list[tuple[list[int], int]]:
    """Blocks of one or more lines, as long as they repeat, that are in at least ``least`` documents.

    ``doc`` and ``key`` name the document and the identifier of each line, in order; a block stays within
    a document. One that only occurs as the beginning or end of a longer one of the same documents is left out.
    """
    n = len(key)
    if not n:
        return []
    # each document ends in a code of its own, which no other suffix shares
    cut = np.flatnonzero(np.diff(doc)) + 1
    codes = np.unique(key, return_inverse=True)[1].astype(np.int64)
    codes = np.insert(codes, cut, codes.max() + 1 + np.arange(len(cut)))
    docs = np.insert(doc, cut, -1 - np.arange(len(cut)))
    keys = np.insert(key, cut, 0)
    sa, ranks = suffix_array(codes)
    # common prefix of each suffix with the one before it, from the ranks of doubling lengths
    lcp = np.zeros(len(sa), np.int64)
    a, b = sa[:-1].copy(), sa[1:].copy()
    for k in range(len(ranks) - 1, -1, -1):
        inside = (a < len(codes)) & (b < len(codes))
        same = np.zeros(len(a), bool)
        same[inside] = ranks[k][a[inside]] == ranks[k][b[inside]]
        step = same * (1 << k)
        lcp[1:] += step
        a += step
        b += step
    found: list[tuple[list[int], int]] = []
    for size in sorted({1, *np.unique(lcp[lcp > 0]).tolist()}, reverse=True):
        edge = np.flatnonzero(lcp < size)
        to = np.append(edge[1:], len(sa))
        # a longer block is one that repeats; a single line may be asked for even if it does not
        wide = to - edge >= (max(2, least) if size > 1 else least)
        for lo, hi in zip(edge[wide].tolist(), to[wide].tolist(), strict=True):
            holds = np.unique(docs[sa[lo:hi]])
            if holds[0] >= 0 and len(holds) >= least:
                found.append((keys[sa[lo] : sa[lo] + size].tolist(), len(holds)))
    out: list[tuple[list[int], int]] = []
    longer: dict[tuple[int, ...], int] = {}
    for block, many in found:
        t = tuple(block)
        if longer.get(t) != many:
            out.append((block, many))
        for part in (t[1:], t[:-1]):
            if part:
                longer[part] = max(longer.get(part, 0), many)
    return out


def _hashed(documents: DataFrame) -> DataFrame:
    """(source, doc_id, line_no array, key array) of every document; a null source is a source of its own."""
    letters = _Letters()

    def keys(cols: dict[str, list]) -> dict[str, list]:
        both = [line_keys(t or "", letters) for t in cols["text"]]
        return {"source": cols["source"], "doc_id": cols["doc_id"], "line_no": [x[0] for x in both], "key": [x[1] for x in both]}

    docs = documents.select(F.coalesce(F.col("source").cast("string"), F.lit("\u0000")).alias("source"), F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null")
    types = {"source": pa.string(), "doc_id": pa.int64(), "line_no": pa.list_(pa.int32()), "key": pa.list_(pa.int64())}
    return arrow_map(docs, keys, "source string, doc_id bigint, line_no array<int>, key array<bigint>", types, rows=1024)


def _blocks(hashed: DataFrame, sizes: DataFrame) -> DataFrame:
    """(source, block, n_docs): blocks that repeat in enough documents of one shard."""

    def shard(_: tuple, groups: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, lens, keys, source, whole = [], [], [], None, False
        for b in groups:
            if b.num_rows:
                source, whole = b.column("source")[0].as_py(), b.column("n_source")[0].as_py() <= SHARD_DOCS
            ids.append(b.column("doc_id").to_numpy())
            lens.append(np.diff(b.column("key").offsets.to_numpy()))
            keys.append(b.column("key").flatten().to_numpy())
        if source is None:
            return
        doc, lens, key = np.concatenate(ids), np.concatenate(lens), np.concatenate(keys)
        many = len(np.unique(doc))
        found = repeated_blocks(np.repeat(np.unique(doc, return_inverse=True)[1], lens), key, max(MIN_DOCS if whole else 1.0, MIN_SHARE * many - 1e-9))
        if found:
            yield pa.RecordBatch.from_arrays([pa.array([source] * len(found)), pa.array([x for x, _ in found], pa.list_(pa.int64())), pa.array([n for _, n in found], pa.int64())], names=["source", "block", "n_docs"])

    shards = hashed.join(sizes, "source").withColumn("shard", F.pmod(F.xxhash64("doc_id", F.lit(6)), F.ceil(F.col("n_source") / F.lit(SHARD_DOCS))))
    return shards.select("source", "shard", "doc_id", "key", "n_source").groupBy("source", "shard").applyInArrow(shard, "source string, block array<bigint>, n_docs bigint")


def repeated_lines(documents: DataFrame) -> DataFrame:
    """(source, doc_id, line_no, n_docs): each occurrence of a line in MIN_DOCS documents and MIN_SHARE of its source.

    Only letters are compared, case left aside; lines of fewer than MIN_LETTERS letters are never found.
    Null texts count as documents without lines, null sources as one source; rows of one doc_id are one
    document; further columns are left aside.
    """
    hashed = staged(_hashed(documents))
    sizes = hashed.groupBy("source").agg(F.countDistinct("doc_id").alias("n_source"))
    lines = _blocks(hashed, sizes).select("source", F.explode("block").alias("key")).distinct()
    places = hashed.select("source", "doc_id", F.explode(F.arrays_zip("line_no", "key")).alias("x")).select("source", "doc_id", F.col("x.line_no").alias("line_no"), F.col("x.key").alias("key"))
    kept = places.join(lines, ["source", "key"], "left_semi")
    counts = kept.groupBy("source", "key").agg(F.countDistinct("doc_id").alias("n_docs")).join(sizes, "source").where((F.col("n_docs") >= MIN_DOCS) & (F.col("n_docs") >= MIN_SHARE * F.col("n_source") - 1e-9))
    return kept.join(counts.select("source", "key", "n_docs"), ["source", "key"]).select("source", "doc_id", "line_no", "n_docs").distinct()


def found(documents: DataFrame) -> DataFrame:
    return repeated_lines(documents).select("doc_id", F.col("line_no").cast("bigint").alias("line_no")).distinct()


def cleaned(documents: DataFrame) -> DataFrame:
    """(doc_id, text, lines_removed): every document without the lines that its source repeats."""
    drop = repeated_lines(documents).groupBy("doc_id").agg(F.collect_set("line_no").alias("drop"))
    docs = documents.select("doc_id", "text").join(drop, "doc_id", "left")
    kept = F.filter(F.split("text", "\n", -1), lambda _, k: ~F.coalesce(F.array_contains("drop", k), F.lit(False)))
    return docs.select("doc_id", F.when(F.col("drop").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")).alias("text"), F.coalesce(F.size("drop"), F.lit(0)).alias("lines_removed"))


SQL_FOUND = """
WITH doc AS (SELECT doc_id, coalesce(source, chr(1)) AS source, text FROM documents WHERE doc_id IS NOT NULL),
line AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM doc),
keyed AS (SELECT doc_id, source, line_no, lower(regexp_replace(line, '[^\\p{L}]', '', 'g')) AS k FROM line),
long AS (SELECT * FROM keyed WHERE length(k) >= 12),
n AS (SELECT source, count(DISTINCT doc_id) AS n FROM doc GROUP BY source),
hit AS (SELECT source, k, count(DISTINCT doc_id) AS m FROM long GROUP BY source, k)
SELECT DISTINCT l.doc_id, CAST(l.line_no AS BIGINT) AS line_no
FROM long l JOIN hit h ON l.source = h.source AND l.k = h.k JOIN n ON n.source = l.source
WHERE h.m >= 5 AND h.m >= 0.08 * n.n
"""

SQL_CLEANED = f"""
WITH f AS ({SQL_FOUND}),
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM documents WHERE doc_id IS NOT NULL),
k AS (SELECT l.doc_id, count(f.line_no) AS n, coalesce(string_agg(l.line, chr(10) ORDER BY l.line_no) FILTER (WHERE f.line_no IS NULL), '') AS text FROM l LEFT JOIN f ON f.doc_id = l.doc_id AND f.line_no = l.line_no GROUP BY l.doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE k.text END AS text, CAST(coalesce(k.n, 0) AS INTEGER) AS lines_removed FROM documents d LEFT JOIN k ON k.doc_id = d.doc_id
"""
