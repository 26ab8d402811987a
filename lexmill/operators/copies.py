"""Near copies: a whole self-join of texts by the Jaccard similarity of their five-word shingles.

Prefix filtering, which loses no pair: under one order of all shingles, two sets with a Jaccard similarity of
at least ``t`` share a shingle among the first ``n - ceil(t n) + 1`` of each. Common shingles, known from a
sample, come last in the order; the sample decides only the cost. Candidates are verified with the whole sets.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.session import checkpoint

#: Words of a shingle, and the least similarity of near copies.
WORDS, LEAST = 5, 0.8
#: Texts whose shingles are counted for the order, and common shingles that are kept of them.
SAMPLE, COMMON = 20_000, 300_000
#: Groups that prefix entries are dealt to by their shingle.
BUCKETS = 1024
_WORD = re.compile(r"[^\W_]+(?:[-./][^\W_]+)*")
_FACTORS = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]
#: Bits of the filter by which the texts of candidates are picked before they are moved.
BITS = 1 << 26
_ENTRY = np.dtype([("h", "<u8"), ("key", "<i8"), ("n", "<u4"), ("at", "<u4")])


class Codes(dict):
    """Hashes of words; emptied when it grows large."""

    def __missing__(self, word: str) -> int:
        if len(self) > 400_000:
            self.clear()
        x = self[word] = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return x


def shingles(text: str | None, codes: Codes) -> np.ndarray:
    """Hashes of the distinct runs of five words, in order; a shorter text is one shingle."""
    words = _WORD.findall(text.lower()) if text else []
    if not words:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(codes.__getitem__, words), np.uint64, len(words))
    k = min(WORDS, len(w))
    h = np.full(len(w) - k + 1, k, np.uint64)
    for j in range(k):
        h = (h ^ (w[j : j + len(h)] >> np.uint64(29)) ^ w[j : j + len(h)]) * _FACTORS[j]
    return np.unique(h ^ (h >> np.uint64(32)))


def key_of(s: np.ndarray) -> int:
    """Names a set of shingles."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(s.tobytes())).astype(np.int64))


def hash_of(text: str) -> int:
    """Hash of a whole text."""
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) >> 1


def signature(s: np.ndarray) -> bytes:
    """For each of 512 classes of shingles whether the set has an odd number of them. Two sets differ in at least as many shingles as their signatures in bits."""
    return np.packbits(np.bincount((s % np.uint64(512)).astype(int), minlength=512) & 1).tobytes()


def _map(df: DataFrame, f: Callable[[list, list, Codes], dict[str, list]], schema: str, rows: int = 4096) -> DataFrame:
    """``df`` of (id, text) through ``f``, at most ``rows`` texts at a time."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = Codes()
        for batch in batches:
            for k in range(0, batch.num_rows, rows):
                part = batch.slice(k, rows)
                out = f(part.column(0).to_pylist(), part.column(1).to_pylist(), codes)
                if len(next(iter(out.values()))):
                    yield pa.RecordBatch.from_pydict(out)

    return df.mapInArrow(run, schema)


def _common(texts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Shingles (in order) that stand in several texts of a sample, and in how many."""
    share = min(1.0, SAMPLE / max(texts.count(), 1))
    some = texts if share == 1 else texts.where(F.abs(F.xxhash64("id", F.lit(5)) % 1_000_000) < int(share * 1_000_000))

    def count(_: list, batch: list, codes: Codes) -> dict[str, list]:
        h, n = np.unique(np.concatenate([shingles(t, codes) for t in batch]), return_counts=True)
        to = (h >> np.uint64(58)).astype(int)
        cut = np.searchsorted(to, np.arange(65))
        return {"b": list(range(64)), "h": [h[x:y].tobytes() for x, y in zip(cut, cut[1:])], "n": [n[x:y].astype("<i8").tobytes() for x, y in zip(cut, cut[1:])]}

    def add(t: pa.Table) -> pa.Table:
        h, n = (np.concatenate([np.frombuffer(x, kind) for x in t.column(c).to_pylist()]) for c, kind in (("h", "<u8"), ("n", "<i8")))
        u, at = np.unique(h, return_inverse=True)
        total = np.bincount(at, n, len(u)).astype("<i8")
        keep = np.flatnonzero(total > 1)
        keep = keep[np.argsort(-total[keep], kind="stable")[: COMMON // 64]]
        return pa.table({"h": [u[keep].tobytes()], "n": [total[keep].tobytes()]})

    got = _map(some, count, "b bigint, h binary, n binary").groupBy("b").applyInArrow(add, "h binary, n binary").collect()
    h, n = (np.concatenate([np.zeros(0, kind), *[np.frombuffer(bytes(r[c]), kind) for r in got]]) for c, kind in (("h", "<u8"), ("n", "<i8")))
    order = np.argsort(h)
    return h[order], n[order]


def _needed(n: int | np.ndarray, m: int | np.ndarray, least: float) -> np.ndarray:
    """Shingles that sets of these sizes must share."""
    return np.ceil(least / (1 + least) * (np.asarray(n, float) + m) - 1e-9)


def _pairs(e: np.ndarray, least: float) -> np.ndarray:
    """Candidate pairs of the entries of one group: smaller set, larger set, shingles shared, where the last of them stands in each, sizes."""
    e = np.unique(e)  # copies have the same entries; in order of h, key
    e = e[np.lexsort((e["key"], e["n"], e["h"]))]
    parts = []
    i, d = np.arange(len(e)), 1
    while True:
        i = i[i + d < len(e)]
        i = i[e["h"][i] == e["h"][i + d]]
        i = i[e["n"][i] >= least * e["n"][i + d] - 1e-9]  # sizes grow within a shingle
        if not len(i):
            break
        x, y = e[i], e[i + d]
        need = _needed(x["n"], y["n"], least)
        near = (x["at"] <= x["n"] - _needed(x["n"], x["n"], least)) & (np.minimum(x["at"], y["at"]) + np.minimum(x["n"] - x["at"], y["n"] - y["at"]) >= need)
        x, y = x[near], y[near]
        parts.append(np.stack([x["key"], y["key"], x["at"].astype("i8"), y["at"].astype("i8"), x["n"].astype("i8"), y["n"].astype("i8")], axis=1))
        d += 1
    return np.concatenate(parts) if parts else np.zeros((0, 6), "i8")


def _marks(hashes: DataFrame) -> np.ndarray:
    """A bit set of fixed size that holds at least the hashes (h)."""
    each = BITS // 64

    def mark(t: pa.Table) -> pa.Table:
        bits = np.zeros(each, bool)
        bits[t.column("h").to_numpy() // 64 % each] = True
        return pa.table({"b": t.column("b")[:1], "bits": [np.packbits(bits).tobytes()]})

    out = np.zeros((64, each // 8), np.uint8)
    for r in hashes.select("h", (F.col("h") % 64).alias("b")).groupBy("b").applyInArrow(mark, "b bigint, bits binary").toLocalIterator():
        out[r["b"]] = np.frombuffer(bytes(r["bits"]), np.uint8)
    return out


def similar(texts: DataFrame, named: DataFrame, least: float = LEAST) -> DataFrame:
    """(a, b, jaccard): every pair of distinct shingle sets of ``texts`` (id, text) with at least that similarity, each once.

    ``named`` has the sets that count (key), a hash of a text of each (h) and its signature (sig).
    """
    common, counts = _common(texts)

    def entries(_: list, batch: list, codes: Codes) -> dict[str, list]:
        parts = []
        for t in batch:
            s = shingles(t, codes)
            if n := len(s):
                rank = np.zeros(n, np.int64)
                if len(common):
                    at = np.minimum(np.searchsorted(common, s), len(common) - 1)
                    rank = np.where(common[at] == s, counts[at], 0)
                first = s[np.argsort(rank, kind="stable")[: n - math.ceil(least * n - 1e-9) + 1]]
                p = np.empty(len(first), _ENTRY)
                p["h"], p["key"], p["n"], p["at"] = first, key_of(s), n, np.arange(len(first))
                parts.append(p)
        e = np.concatenate([np.empty(0, _ENTRY), *parts])
        to = (e["h"] % np.uint64(BUCKETS)).astype(int)
        order = np.argsort(to, kind="stable")
        cut = np.searchsorted(to[order], np.arange(BUCKETS + 1))
        e = e[order]
        full = np.flatnonzero(cut[1:] > cut[:-1])
        return {"b": full.tolist(), "e": [e[cut[k] : cut[k + 1]].tobytes() for k in full]}

    def meet(t: pa.Table) -> pa.Table:
        p = _pairs(np.concatenate([np.frombuffer(x, _ENTRY) for x in t.column("e").to_pylist()]), least)
        return pa.table({c: pa.array(p[:, k], pa.int64()) for k, c in enumerate(("a", "b", "i", "j", "n", "m"))})

    met = _map(texts, entries, "b bigint, e binary").groupBy("b").applyInArrow(meet, "a bigint, b bigint, i bigint, j bigint, n bigint, m bigint")
    pairs = met.groupBy("a", "b").agg(F.count("*").alias("c"), F.max("i").alias("i"), F.max("j").alias("j"), F.max("n").alias("n"), F.max("m").alias("m"))
    # beyond the last shared entry no more can be shared than what is left of either set
    pairs = pairs.where(F.col("c") + F.least(F.col("n") - F.col("i"), F.col("m") - F.col("j")) - 1 >= F.ceil(least / (1 + least) * (F.col("n") + F.col("m")) - 1e-9))
    pairs = pairs.join(named.select(F.col("key").alias("a"), F.col("sig").alias("x")), "a").join(named.select(F.col("key").alias("b"), F.col("sig").alias("y")), "b")

    def alike(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            if t.num_rows:
                x, y = (np.frombuffer(b"".join(t.column(c).to_pylist()), np.uint8).reshape(-1, 64) for c in "xy")
                n, m = (t.column(c).to_numpy() for c in "nm")
                keep = np.bitwise_count(x ^ y).sum(axis=1) <= n + m - 2 * _needed(n, m, least)
                yield t.select(["a", "b"]).filter(pa.array(keep))

    pairs = checkpoint(pairs.select("a", "b", "n", "m", "x", "y").mapInArrow(alike, "a bigint, b bigint"))

    asked = pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct()
    marks = _marks(named.join(asked, "key").select("h"))

    def whole(_: list, batch: list, codes: Codes) -> dict[str, list]:
        out: dict[str, list] = {"key": [], "s": []}
        for t in batch:
            h = hash_of(t) if t else 0
            at = h // 64 % (BITS // 64)
            if t and marks[h % 64, at >> 3] >> (7 - (at & 7)) & 1:
                s = shingles(t, codes)
                out["key"].append(key_of(s))
                out["s"].append(s.tobytes())
        return out

    sets = checkpoint(_map(texts, whole, "key bigint, s binary").join(asked, "key", "left_semi").groupBy("key").agg(F.any_value("s").alias("s")))

    def verify(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            j = []
            for x, y in zip(batch.column("s").to_pylist(), batch.column("t").to_pylist(), strict=True):
                x, y = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
                both = len(np.intersect1d(x, y, assume_unique=True))
                j.append(both / (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(j, pa.float64())], names=["a", "b", "jaccard"])

    full = pairs.join(sets.select(F.col("key").alias("a"), "s"), "a").join(sets.select(F.col("key").alias("b"), F.col("s").alias("t")), "b").select("a", "b", "s", "t")
    return full.mapInArrow(verify, "a bigint, b bigint, jaccard double").where(F.col("jaccard") >= least - 1e-12)


def components(edges: DataFrame) -> DataFrame:
    """(key, label) of every node of ``edges`` (a, b): the least node that paths lead to. Runs until nothing changes."""
    both = checkpoint(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    labels = checkpoint(both.groupBy(F.col("a").alias("key")).agg(F.least(F.min("b"), F.col("key")).alias("label")))
    while True:
        seen = both.join(labels.select(F.col("key").alias("b"), "label"), "b").groupBy(F.col("a").alias("key")).agg(F.min("label").alias("near"))
        # a step along the edges, then a jump to the label of the label
        step = labels.join(seen, "key").select("key", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        far = labels.select(F.col("key").alias("label"), F.col("label").alias("far"))
        after = checkpoint(step.join(far, "label").select("key", "old", F.least("label", "far").alias("label")))
        if after.where("label <> old").isEmpty():
            return after.select("key", "label")
        labels = after.select("key", "label")


def near_copies(texts: DataFrame, key: str, text: str, least: float = LEAST) -> DataFrame:
    """(key, class_id, links array<struct<key, jaccard>>): one row for each ``key``.

    A class is what links join, named by its least key; a text without near copies is alone in its own. Texts
    with the same shingles are linked to the first of them, and only the first carries links to other sets, so
    that n equal texts have n links. Where rows of one key differ, the set that has most shingles counts.
    A text without words has no copies.
    """
    own = texts.where(F.col(key).isNotNull()).select(F.col(key).cast("string").alias("id"), F.col(text).cast("string").alias("text"))

    def name(ids: list, batch: list, codes: Codes) -> dict[str, list]:
        sets = [shingles(t, codes) for t in batch]
        return {"id": ids, "h": pa.array([hash_of(t) if t else 0 for t in batch], pa.int64()), "n": pa.array([len(s) for s in sets], pa.int32()), "key": pa.array([key_of(s) if len(s) else None for s in sets], pa.int64()), "sig": [signature(s) for s in sets]}

    ids = _map(own, name, "id string, h bigint, n int, key bigint, sig binary").groupBy("id").agg(F.max(F.struct("n", "key", "h", "sig")).alias("x")).select("id", "x.key", "x.h", "x.sig").persist(StorageLevel.MEMORY_AND_DISK)
    firsts = ids.where("key is not null").groupBy("key").agg(F.min("id").alias("first"), F.min("h").alias("h"), F.min("sig").alias("sig"))
    # a set that no key stands for any more (rows of one key that differ) links nothing
    edges = similar(own, firsts.select("key", "h", "sig"), least)
    there = firsts.select("key")
    edges = checkpoint(edges.join(there.withColumnRenamed("key", "a"), "a", "left_semi").join(there.withColumnRenamed("key", "b"), "b", "left_semi").select("a", "b", "jaccard"))
    labels = components(edges)
    links = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "jaccard")).join(firsts.select(F.col("key").alias("b"), F.col("first").alias(key)), "b")
    links = links.groupBy(F.col("a").alias("key")).agg(F.array_sort(F.collect_list(F.struct(key, F.round("jaccard", 6).alias("jaccard")))).alias("others"))
    sets = firsts.join(labels, "key", "left").withColumn("label", F.coalesce("label", "key")).join(links, "key", "left")
    classes = sets.groupBy("label").agg(F.min("first").alias("class_id"))
    sets = sets.join(classes, "label").select("key", "first", "class_id", "others")
    none = F.array().cast(f"array<struct<{key}:string,jaccard:double>>")
    link = F.when(F.col("first") < F.col("id"), F.array(F.struct(F.col("first").alias(key), F.lit(1.0).alias("jaccard")))).otherwise(F.coalesce("others", none))
    return ids.select("id", "key").join(sets, "key", "left").select(F.col("id").alias(key), F.coalesce("class_id", "id").alias("class_id"), link.alias("links"))
