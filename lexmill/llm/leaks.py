"""Problem 9: held-out passages inside training documents, found in an FM-index over each shard's words.

A shard is a run of documents of one task. Its words are coded by the shard's own vocabulary, sorted as
suffixes, turned into a Burrows-Wheeler transform in a wavelet matrix with sampled suffix positions; so an
index depends on the documents alone, is built once, and every block of held-out items is searched in it.
Each window of ``window`` words of an item is searched backwards through the ranks, and located by walking
to the next sampled position. Documents are never shuffled and read once for any number of items.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm.text import WordCoder, arrow_map, bare_words, hash64

#: Words of a document and an item that must agree in a row.
WINDOW = 15
#: Items that the driver gathers, and a task holds, at a time.
ITEMS_A_BLOCK = 20_000
#: Words of one FM-index.
SHARD_WORDS = 600_000
#: One suffix position in so many is kept.
SAMPLE_RATE = 16

#: Codes of the end of the sequence, which occurs once, and of a document.
_LAST, _END = 0, 1


def suffix_order(codes: np.ndarray, bits: int) -> np.ndarray:
    """All suffixes of the codes in order. Sixteen codes are compared by packing, then only suffixes that are still alike, by doubling."""
    n = len(codes)
    rank = codes.astype(np.int64)
    width, span = bits, 1
    while span < 16:
        # as many codes side by side as fit into 62 bits, then sorted ranks of those
        many = max(2, min(16 // span, 62 // width))
        key = np.zeros(n, np.int64)
        for k in range(many):
            shifted = np.zeros(n, np.int64)
            if k * span < n:
                shifted[: n - k * span] = rank[k * span :] + (span > 1)
            key = (key << width) | shifted
        span *= many
        sa = np.argsort(key, kind="stable")
        ordered = key[sa]
        first = np.concatenate(([True], ordered[1:] != ordered[:-1]))
        rank = np.empty(n, np.int64)
        rank[sa] = np.cumsum(first) - 1
        width = max(1, int(rank.max() + 1).bit_length())
        if width * 2 > 62:
            raise ValueError("shard too large")
    # from here on a rank is the place where its group of equal suffixes begins
    start = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    rank[sa] = start
    tied = np.flatnonzero(~first | np.concatenate((~first[1:], [False])))
    while len(tied) and span < 2 * n:
        at = sa[tied]
        after = np.zeros(len(at), np.int64)
        inside = at + span < n
        after[inside] = rank[at[inside] + span] + 1
        order = np.lexsort((after, rank[at]))
        at, after, group = at[order], after[order], rank[at[order]]
        sa[tied] = at
        fresh = np.concatenate(([True], (group[1:] != group[:-1]) | (after[1:] != after[:-1])))
        rank[at] = tied[np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))]
        tied = tied[~fresh | np.concatenate((~fresh[1:], [False]))]
        span *= 2
    return sa


class FMIndex:
    """FM-index over a sequence of codes: ranks in a wavelet matrix, suffix positions at rate SAMPLE_RATE."""

    def __init__(self, codes: np.ndarray, sigma: int, rate: int = SAMPLE_RATE) -> None:
        """``sigma``: codes of the sequence and of all patterns are below it, and above 0, which is put at the end."""
        codes = np.append(codes, _LAST)
        n = self.n = len(codes)
        self.bits = max(1, int(sigma - 1).bit_length())
        sa = suffix_order(codes, self.bits)
        kept = sa % rate == 0
        self.kept = np.concatenate(([0], np.cumsum(kept, dtype=np.int32)))
        self.samples = sa[kept].astype(np.int32)
        bwt = codes[sa - 1]
        counts = np.bincount(codes, minlength=1 << self.bits)
        self.c = np.concatenate(([0], np.cumsum(counts)))
        self.ones: list[np.ndarray] = []
        self.zeros: list[int] = []
        seq = bwt
        for level in range(self.bits - 1, -1, -1):
            bit = (seq >> level) & 1
            self.ones.append(np.concatenate(([0], np.cumsum(bit, dtype=np.int64))).astype(np.int32))
            self.zeros.append(int(n - self.ones[-1][-1]))
            seq = np.concatenate((seq[bit == 0], seq[bit == 1]))
        # the place of the first of each code on the lowest level
        first = np.zeros(1 << self.bits, np.int64)
        where = np.arange(1 << self.bits)
        for k, level in enumerate(range(self.bits - 1, -1, -1)):
            bit = (where >> level) & 1
            one = self.ones[k][first]
            first = np.where(bit == 1, self.zeros[k] + one, first - one)
        self.first = first

    def rank(self, code: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each code occurs before each place of the transform."""
        for k, level in enumerate(range(self.bits - 1, -1, -1)):
            one = self.ones[k][at]
            at = np.where((code >> level) & 1 == 1, self.zeros[k] + one, at - one)
        return at - self.first[code]

    def before(self, at: np.ndarray) -> np.ndarray:
        """Places in the order of the suffixes that begin one code earlier."""
        code = np.zeros(len(at), np.int64)
        place = at
        for k, level in enumerate(range(self.bits - 1, -1, -1)):
            one = self.ones[k][place]
            bit = self.ones[k][place + 1] - one
            code |= bit.astype(np.int64) << level
            place = np.where(bit == 1, self.zeros[k] + one, place - one)
        return self.c[code] + place - self.first[code]

    def locate(self, at: np.ndarray) -> np.ndarray:
        """Positions of the suffixes at these places: steps back to the next sampled one, and as many forward."""
        out = np.empty(len(at), np.int64)
        live, steps = np.arange(len(at)), 0
        place = at.astype(np.int64)
        while len(live):
            hit = self.kept[place + 1] > self.kept[place]
            out[live[hit]] = self.samples[self.kept[place[hit]]] + steps
            live, place = live[~hit], place[~hit]
            if len(live):
                place = self.before(place)
            steps += 1
        return out

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Patterns of one length as rows: the rows that occur, and their ranges in the suffix array."""
        live = np.arange(len(patterns))
        lo, hi = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n, np.int64)
        for k in range(patterns.shape[1] - 1, -1, -1):
            code = patterns[live, k]
            lo, hi = self.c[code] + self.rank(code, lo), self.c[code] + self.rank(code, hi)
            keep = lo < hi
            live, lo, hi = live[keep], lo[keep], hi[keep]
            if not len(live):
                break
        return live, lo, hi


class Block:
    """Some items: the hashes of their words one after the other, and where each begins."""

    def __init__(self, items: list[tuple[int, str]]) -> None:
        words = [[hash64(w) for w in bare_words(t or "")] for _, t in items]
        self.item = np.repeat(np.array([k for k, _ in items], np.int64), [len(w) for w in words])
        self.word = np.array([h for w in words for h in w], np.int64)
        self.left = np.concatenate([np.arange(len(w), 0, -1) for w in words]) if words else np.zeros(0, np.int64)

    def windows(self, vocabulary: np.ndarray, codes: np.ndarray, window: int) -> tuple[np.ndarray, list[np.ndarray]]:
        """Distinct windows all of whose words a shard has, in its codes, and the items of each. ``vocabulary``: the shard's hashes in order, ``codes``: their codes."""
        if len(self.word) < window or not len(vocabulary):
            return np.zeros((0, window), np.int64), []
        at = np.minimum(np.searchsorted(vocabulary, self.word), len(vocabulary) - 1)
        code = np.where(vocabulary[at] == self.word, codes[at], -1)
        lacks = np.concatenate(([0], np.cumsum(code < 0)))
        start = np.flatnonzero((self.left >= window) & (lacks[np.minimum(np.arange(len(code)) + window, len(code))] == lacks[:-1]))
        rows = code[start[:, None] + np.arange(window)]
        distinct, which = np.unique(rows, axis=0, return_inverse=True)
        order = np.argsort(which.ravel(), kind="stable")
        return distinct, [np.unique(x) for x in np.split(self.item[start[order]], np.flatnonzero(np.diff(which.ravel()[order])) + 1)] if len(start) else []


class Shard:
    """The FM-index of some documents, whose words are coded by their own vocabulary."""

    def __init__(self, hashes: np.ndarray, starts: np.ndarray) -> None:
        self.vocabulary, codes = np.unique(hashes, return_inverse=True)
        self.codes = np.arange(2, len(self.vocabulary) + 2)
        # an end mark after each document, so that no window runs on into the next
        codes = np.insert(codes.ravel() + 2, starts[1:], _END)
        self.starts = starts + np.arange(len(starts))
        self.index = FMIndex(codes, len(self.vocabulary) + 2)

    def hits(self, block: Block, window: int) -> dict[tuple[int, int], list[int]]:
        """(document index, item) to the ascending first words of the windows found there."""
        patterns, owners = block.windows(self.vocabulary, self.codes, window)
        out: dict[tuple[int, int], set[int]] = {}
        if len(patterns):
            rows, lo, hi = self.index.search(patterns)
            many = hi - lo
            at = np.repeat(lo - np.concatenate(([0], np.cumsum(many)[:-1])), many) + np.arange(many.sum())
            place = self.index.locate(at)
            docs = np.searchsorted(self.starts, place, side="right") - 1
            for row, d, p in zip(np.repeat(rows, many).tolist(), docs.tolist(), (place - self.starts[docs]).tolist(), strict=True):
                for item in owners[row].tolist():
                    out.setdefault((d, item), set()).add(p)
        return {k: sorted(v) for k, v in out.items()}


def merged(places: list[int], window: int) -> list[tuple[int, int]]:
    """Spans of words that the windows at these places cover together."""
    spans: list[tuple[int, int]] = []
    for p in places:
        if spans and p <= spans[-1][1]:
            spans[-1] = (spans[-1][0], p + window)
        else:
            spans.append((p, p + window))
    return spans


def leaked_spans(documents: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, item_id, start_word, end_word): merged spans of words that a document shares with an item.

    Null or empty texts, and items of fewer than ``window`` words, give no rows; repeated rows count once;
    further columns are left aside. The driver gathers ITEMS_A_BLOCK items at a time and hands them on; a task
    searches the blocks one after the other in the index of each of its shards.
    """
    if window < 1:
        raise ValueError("a window has at least one word")
    docs = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null and text is not null")
    chosen = items.select(F.col("item_id").cast("bigint").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null and text is not null")
    many = max(1, math.ceil(chosen.count() / ITEMS_A_BLOCK))
    sc = documents.sparkSession.sparkContext
    blocks = [sc.broadcast(Block([(r[0], r[1]) for r in chosen.where(F.pmod(F.xxhash64("item_id"), F.lit(many)) == k).collect()])) for k in range(many)]
    return _against(docs, blocks, window).dropDuplicates()


def _against(docs: DataFrame, blocks: list[Broadcast], window: int) -> DataFrame:
    types = {"doc_id": pa.int64(), "item_id": pa.int64(), "start_word": pa.int32(), "end_word": pa.int32()}
    coder = WordCoder(_hashes)

    def find(cols: dict[str, list]) -> dict[str, list]:
        rows: list[tuple] = []
        hashes, starts = coder.encode(cols["text"])
        first = 0
        while first < len(cols["doc_id"]):
            last = max(first + 1, int(np.searchsorted(starts, starts[first] + SHARD_WORDS, side="right")) - 1)
            shard = Shard(hashes[starts[first] : starts[last]], starts[first : last + 1] - starts[first])
            for b in blocks:
                block = b.value
                if len(blocks) > 1:
                    b.__dict__.pop("_value", None)  # one block at a time is held
                for (d, item), places in shard.hits(block, window).items():
                    rows += [(cols["doc_id"][first + d], item, *span) for span in merged(places, window)]
            first = last
        return dict(zip(types, zip(*rows))) if rows else {}

    return arrow_map(docs, find, "doc_id bigint, item_id bigint, start_word int, end_word int", types, rows=2048)


def _hashes(word: str) -> list[int]:
    return [hash64(x) for x in bare_words(word)]


def found(documents: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id): documents that hold a passage of the item."""
    return leaked_spans(documents, items).select("doc_id", "item_id").distinct()


#: Brute force: every window of both sides, joined.
SQL_FOUND = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(strip_accents(text)), '[\p{L}\p{N}]+') AS w FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
i AS (SELECT item_id, regexp_extract_all(lower(strip_accents(text)), '[\p{L}\p{N}]+') AS w FROM eval_items WHERE item_id IS NOT NULL AND text IS NOT NULL),
a AS (SELECT doc_id, array_to_string(w[k : k + 14], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, CAST(len(w) - 13 AS BIGINT))) AS k FROM d WHERE len(w) >= 15)),
b AS (SELECT item_id, array_to_string(w[k : k + 14], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, CAST(len(w) - 13 AS BIGINT))) AS k FROM i WHERE len(w) >= 15))
SELECT DISTINCT doc_id, item_id FROM a JOIN b USING (g)
"""
