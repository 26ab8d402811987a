"""Runs, metrics and model versions as append-only tables; model cards; bounded configurations."""

from __future__ import annotations

import os
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexmill.sources.files import exists

ALIASES = ("candidate", "champion")


@dataclass(frozen=True)
class TuningConfig:
    """Bounds of an adapter's configuration."""

    rank: int = 16
    alpha: int = 32
    dropout: float = 0.05
    bits: int | None = 4

    def __post_init__(self) -> None:
        if self.rank <= 0 or self.alpha <= 0 or not 0 <= self.dropout < 1 or self.bits not in (None, 4, 8):
            raise ValueError("rank and alpha positive, dropout from 0 to below 1, bits 4, 8 or none")


@dataclass(frozen=True)
class ModelCard:
    name: str
    version: str
    purpose: str
    data: str
    limitations: tuple[str, ...]
    metrics: dict[str, float] = field(default_factory=dict)

    def __post_init__(self) -> None:
        if not all(x.strip() for x in (self.name, self.version, self.purpose, self.data)) or not self.limitations:
            raise ValueError("every field and at least one limitation are needed")

    def markdown(self) -> str:
        rows = "\n".join(f"| {k} | {v:.4f} |" for k, v in sorted(self.metrics.items()))
        limits = "\n".join(f"- {x}" for x in self.limitations)
        return f"# {self.name} {self.version}\n\n{self.purpose}\n\nData: {self.data}\n\n## Limitations\n\n{limits}\n\n## Metrics\n\n| metric | value |\n| --- | --- |\n{rows}\n"


class Tracker:
    """Runs with parameters and metrics under a folder that all can reach."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root

    def _append(self, name: str, rows: list[tuple], schema: str) -> None:
        if rows:
            self.spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(os.path.join(self.root, name))

    def log(self, run_id: str, params: dict, metrics: dict[str, float]) -> None:
        """Lists become comma-separated, maps k=v in the order of the keys; values that are no numbers are no metrics."""

        def flat(v: object) -> str:
            if isinstance(v, dict):
                return ",".join(f"{k}={x}" for k, x in sorted(v.items()))
            return ",".join(map(str, v)) if isinstance(v, (list, tuple)) else str(v)

        self._append("params", [(run_id, k, flat(v)) for k, v in sorted(params.items())], "run_id string, name string, value string")
        self._append("metrics", [(run_id, k, float(v)) for k, v in sorted(metrics.items()) if isinstance(v, (int, float)) and not isinstance(v, bool)], "run_id string, metric string, value double")

    def metrics(self, run_id: str) -> DataFrame:
        return self.spark.read.parquet(os.path.join(self.root, "metrics")).where(F.col("run_id") == run_id).select("metric", "value")

    def register(self, name: str, run_id: str) -> int:
        """A new version of a model; versions count from 1."""
        path = os.path.join(self.root, "versions")
        n = self.spark.read.parquet(path).where(F.col("name") == name).agg(F.max("version")).first()[0] if exists(self.spark, path) else None
        self._append("versions", [(name, (n or 0) + 1, run_id)], "name string, version int, run_id string")
        return (n or 0) + 1

    def alias(self, name: str, alias: str, version: int) -> None:
        if alias not in ALIASES:
            raise ValueError(f"unknown alias: {alias}")
        path = os.path.join(self.root, "aliases")
        n = self.spark.read.parquet(path).count() if os.path.exists(path) else 0
        self._append("aliases", [(name, alias, version, n)], "name string, alias string, version int, seq int")

    def resolve(self, name: str, alias: str) -> int | None:
        """The version that an alias names last."""
        w = Window.partitionBy("name", "alias").orderBy(F.desc("seq"))
        rows = self.spark.read.parquet(os.path.join(self.root, "aliases")).withColumn("_n", F.row_number().over(w))
        row = rows.where((F.col("_n") == 1) & (F.col("name") == name) & (F.col("alias") == alias)).first()
        return row["version"] if row else None


def tenant_view(df: DataFrame, tenant: str, column: str = "tenant_id") -> DataFrame:
    """Rows of one tenant; a query only ever sees this view."""
    if not tenant:
        raise ValueError("no tenant")
    return df.where(F.col(column) == tenant)
