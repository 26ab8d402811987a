"""The same transforms over streams: windows with watermarks, late rows, duplicates, sessions, alerts that hold, a cache with a lifetime."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

LATE = "168 hours"


def event_stream(spark: SparkSession, folder: str, schema: str, files_at_once: int = 16) -> DataFrame:
    """Parquet files of a folder as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).parquet(folder)


def audit_stream(spark: SparkSession, glob: str, schema: str) -> DataFrame:
    """Audit lines as they are appended: parsed, timed, without lines that hold what must not be kept."""
    lines = spark.readStream.text(glob)
    kept = lines.where(~F.col("value").rlike(r'"(?:query_text|answer_text|client_ip)"\s*:'))
    return kept.select(F.from_json("value", schema).alias("x")).where("x is not null").select("x.*")


#: Attributes of a trace that are never kept, and how often and how much of it is written at a time.
DENIED = ("query_text", "answer_text", "client_ip", "http.request.body", "user.email")
SCRAPE, TRACE_BATCH, TRACE_FILES = "15 seconds", "5 seconds", 512


def scraped(df: DataFrame, path: str, checkpoint: str, every: str = SCRAPE):
    """Starts writing samples of metrics as they come, one micro-batch an interval."""
    return df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()


def traces(df: DataFrame, denied: tuple[str, ...] = DENIED) -> DataFrame:
    """Spans (trace_id, name, attributes map) without the attributes that must not be kept, and without spans that lack a trace id of 32 hexadecimal digits."""
    deny = F.array(*[F.lit(k) for k in denied])
    return df.where(F.col("trace_id").rlike("^[0-9a-f]{32}$")).withColumn("attributes", F.map_filter("attributes", lambda k, _: ~F.array_contains(deny, k)))


def once(df: DataFrame, key: str, ts: str, late: str = LATE) -> DataFrame:
    """Each key once; rows later than ``late`` are rejected."""
    return df.withWatermark(ts, late).dropDuplicatesWithinWatermark([key])


def windowed(df: DataFrame, ts: str, length: str, slide: str | None, *by: str, late: str = LATE) -> DataFrame:
    """Counts by tumbling or sliding windows of event time."""
    w = F.window(ts, length, slide) if slide else F.window(ts, length)
    return df.withWatermark(ts, late).groupBy(w, *by).agg(F.count("*").alias("n")).select(F.col("window.start").alias("window_start"), *by, "n")


def session_counts(df: DataFrame, ts: str, gap: str, *by: str, late: str = LATE) -> DataFrame:
    return df.withWatermark(ts, late).groupBy(F.session_window(ts, gap), *by).agg(F.count("*").alias("n")).select(F.col("session_window.start").alias("started"), F.col("session_window.end").alias("ended"), *by, "n")


def holding(df: DataFrame, series: str, threshold: float, hold: int) -> DataFrame:
    """(series, since, fired): for each series of samples (series, ts, value), alerts whose value stays above a threshold for ``hold`` seconds.

    The state is the time since when the condition has held; a sample at or below the threshold clears it.
    """

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        since, fired = state.get if state.exists else (None, False)
        out = []
        rows = pd.concat(list(parts)).sort_values("ts") if not state.hasTimedOut else pd.DataFrame(columns=["ts", "value"])
        for ts, value in zip(rows["ts"], rows["value"], strict=True):
            at = int(pd.Timestamp(ts).timestamp())
            if value <= threshold:
                since, fired = None, False
            else:
                since = at if since is None else since
                if not fired and at - since >= hold:
                    fired = True
                    out.append((key[0], pd.Timestamp(since, unit="s"), pd.Timestamp(at, unit="s")))
        state.update((since, fired))
        yield pd.DataFrame(out, columns=[series, "since", "fired"])

    return df.select(series, "ts", "value").groupBy(series).applyInPandasWithState(step, f"{series} string, since timestamp, fired timestamp", "since long, fired boolean", "append", GroupStateTimeout.NoTimeout)


def cached_answers(df: DataFrame, key: str, seconds: int = 3600) -> DataFrame:
    """(key, ts, hit): for each request (key, ts) whether an answer of the same key is at most ``seconds`` old."""

    def step(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        out = []
        rows = pd.concat(list(parts)).sort_values("ts")
        for ts in rows["ts"]:
            at = pd.Timestamp(ts).timestamp()
            hit = last is not None and at - last <= seconds
            if not hit:
                last = at
            out.append((k[0], ts, hit))
        state.update((last,))
        yield pd.DataFrame(out, columns=[key, "ts", "hit"])

    return df.select(key, "ts").groupBy(key).applyInPandasWithState(step, f"{key} string, ts timestamp, hit boolean", "last double", "append", GroupStateTimeout.NoTimeout)


def run_all(df: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Everything that is there, into a table in memory: for tests and back-fills."""
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)
