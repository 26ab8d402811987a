"""Problem 8: documents packed into containers of fixed capacity by the sum-of-squares rule.

Each item goes where the sum, over all gaps, of the squared number of open containers with that gap
becomes smallest. Items are dealt to shards of bounded size by a hash; a shard wastes at most the room of
its last open containers, which a shard of ten thousand items makes negligible. Sizes are in tokens of a public tokenizer.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm.budget import byte_pairs
from lexmill.llm.text import arrow_map

CAPACITY = 1024
SHARD_ITEMS = 10_000
#: The smallest items of a shard come last, by falling size, to fill what is left open.
LAST = 500
#: Items above this share of a container come first, by falling size.
LARGE = 0.4


def sum_of_squares(sizes: np.ndarray, capacity: int = CAPACITY) -> np.ndarray:
    """The container of each item, in the order given; sizes are from 1 to the capacity.

    With counts N of open containers by gap, an item of size s into a gap g changes the sum of squares by
    1 - 2 N[g], and by 1 + 2 N[g - s] if room is left; a new container changes it by 1 + 2 N[capacity - s].
    """
    many = np.zeros(capacity + 1, np.int64)
    open_at: list[list[int]] = [[] for _ in range(capacity + 1)]
    place = np.empty(len(sizes), np.int64)
    made = 0
    for k, s in enumerate(sizes.tolist()):
        gaps = many[s:]  # from gap s on
        change = 2 * (many[: capacity + 1 - s] - gaps) + 2
        change[0] = 1 - 2 * gaps[0]  # filled to the brim
        change[gaps == 0] = 1 << 40
        g = int(np.argmin(change))
        fresh = 2 * many[capacity - s] + 1 if s < capacity else 0
        if change[g] <= fresh:
            gap = g + s
            c = open_at[gap].pop()
            many[gap] -= 1
        else:
            gap, c = capacity, made
            made += 1
        place[k] = c
        if gap > s:
            open_at[gap - s].append(c)
            many[gap - s] += 1
    return place


def pieces_of_size(n: int, capacity: int) -> list[int]:
    """An item larger than a container in full containers and the rest; any other whole."""
    return [capacity] * (n // capacity) + ([n % capacity] if n % capacity or not n else []) if n > capacity else [n]


def pack(documents: DataFrame, capacity: int = CAPACITY, tokens: Callable[[str], int] | None = None) -> DataFrame:
    """(doc_id, piece_no, first_token, tokens, container): every document, each container within the capacity.

    Only a document larger than a container is divided, into full containers and one rest. Rows without a doc_id are left out. A document
    without tokens (null or empty) has container null. Rows that repeat a doc_id are packed each. ``tokens`` gives the
    size of a text; unless it is given, byte pairs of the public tokenizer count.
    """
    size = tokens or byte_pairs()
    own = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null")
    sized = arrow_map(own, lambda cols: {"doc_id": cols["doc_id"], "n": [size(t) if t else 0 for t in cols["text"]]}, "doc_id bigint, n int", {"doc_id": pa.int64(), "n": pa.int32()}, rows=2048)
    shards = max(1, math.ceil(documents.select("doc_id").count() / SHARD_ITEMS))

    def shard(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["n", "doc_id"], ascending=[False, True], kind="stable")
        rows = [(d, k, k * capacity, s, p) for d, n, p in zip(pdf["doc_id"], pdf["n"], pdf["part"], strict=True) for k, s in enumerate(pieces_of_size(int(n), capacity))]
        out = pd.DataFrame(rows, columns=["doc_id", "piece_no", "first_token", "tokens", "part"])
        real = out[out["tokens"] > 0].sort_values("tokens", ascending=False, kind="stable")
        # large items first, as they fit into few gaps; an even mix of the others keeps all gaps in supply, which is what the rule needs
        big, small = real[real["tokens"] > LARGE * capacity], real[real["tokens"] <= LARGE * capacity]
        real = pd.concat([big, small.iloc[:-LAST].sample(frac=1.0, random_state=8), small.iloc[-LAST:]])
        place = pd.Series(sum_of_squares(real["tokens"].to_numpy(np.int64), capacity), index=real.index)
        out["container"] = [None if pd.isna(c) else f"{p}-{int(c)}" for p, c in zip(out["part"], place.reindex(out.index), strict=True)]
        return out[["doc_id", "piece_no", "first_token", "tokens", "container"]]

    parts = sized.withColumn("part", F.pmod(F.xxhash64("doc_id", F.lit(8)), F.lit(shards)))
    # a number of partitions of its own, which adaptive execution leaves as it is: a task for each shard
    return parts.repartition(shards, "part").groupBy("part").applyInPandas(shard, "doc_id bigint, piece_no int, first_token int, tokens int, container string")


def fill(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(containers, tokens, share): how full the containers are."""
    one = packed.where("container is not null").groupBy("container").agg(F.sum("tokens").alias("tokens"))
    return one.agg(F.count("*").alias("containers"), F.sum("tokens").alias("tokens"), (F.sum("tokens") / (F.count("*") * capacity)).alias("share"))
