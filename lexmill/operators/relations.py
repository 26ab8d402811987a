"""Grids, closures and upserts over small reference tables, and other relational helpers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexmill.session import staged


def grid(members: DataFrame, modules: DataFrame, accountable: str, consulted: str) -> DataFrame:
    """(member, module, role): A, C or I of each member for each module. Both tables are bounded reference lists; a larger one is refused."""
    if max(members.count(), modules.count()) > 10_000:
        raise ValueError("reference lists are too long for a grid")
    pairs = members.join(modules, how="cross")
    role = F.when(F.col("member") == F.col(accountable), "A").when(F.array_contains(consulted, F.col("member")), "C").otherwise("I")
    return pairs.select("member", "module", role.alias("role"))


def closure(edges: DataFrame) -> DataFrame:
    """(src, dst, hops) over all paths, with the fewest hops: one join a hop, until nothing is new.

    Each hop's new pairs are written once to the shared folder, so neither plans nor recomputation grow with the hops.
    Paths may be of any length; a cycle ends when it gives no new pair.
    """
    step = edges.select("src", "dst").distinct()
    known = frontier = staged(step.withColumn("hops", F.lit(1)))
    hop = 1
    while True:
        hop += 1
        ahead = frontier.alias("a").join(step.alias("b"), F.col("a.dst") == F.col("b.src")).select("a.src", "b.dst").distinct()
        frontier = staged(ahead.join(known.select("src", "dst"), ["src", "dst"], "left_anti").withColumn("hops", F.lit(hop)))
        if frontier.isEmpty():
            return known
        known = known.unionByName(frontier)


def newest(df: DataFrame, group: str, order: str, n: int) -> DataFrame:
    """The newest ``n`` rows of each group."""
    w = Window.partitionBy(group).orderBy(F.col(order).desc(), F.col("message_id"))
    return df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")
