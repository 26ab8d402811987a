"""Rates, ratios, quantiles of histograms and alert rules over event tables; audit rows; scans for leaks."""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Upper bounds of buckets.
BUCKETS = {
    "http": (0.1, 0.25, 0.5, 1.0, 2.0, 2.5, 5.0, 10.0),
    "retrieval": (0.01, 0.05, 0.1, 0.12, 0.25, 0.5, 1.0),
    "llm": (0.25, 0.5, 1.0, 2.0, 4.0, 8.0, 16.0),
    "documents": (1.0, 2.0, 4.0, 8.0, 12.0, 16.0, 24.0),
}
#: Event types and roles of the audit contract. Fixed values.
EVENT_TYPES = ("auth.login", "auth.denied", "corpus.read", "answer.generated", "answer.exported")
ROLES = ("particulier", "juriste", "gestionnaire", "admin")
FORBIDDEN = r"[\w.+-]+@[\w-]+\.[\w.-]+|\b(?:[0-9]{1,3}\.){3}[0-9]{1,3}\b|\b(?:[0-9a-fA-F]{1,4}:){3,7}[0-9a-fA-F]{1,4}\b|\beyJ[\w-]+\.[\w-]+\.[\w-]+"


def window_start(ts: Column, seconds: int) -> Column:
    """Start of the tumbling window that holds ``ts``."""
    return F.timestamp_seconds((F.floor(F.unix_timestamp(ts) / seconds) * seconds))


def rates(events: DataFrame, ts: str, seconds: int, *by: str) -> DataFrame:
    """(window, by..., n, rate): events and events a second of each window."""
    g = events.groupBy(window_start(F.col(ts), seconds).alias("window_start"), *by).agg(F.count("*").alias("n"))
    return g.withColumn("rate", F.round(F.col("n") / seconds, 8))


def ratio(events: DataFrame, ts: str, seconds: int, condition: Column) -> DataFrame:
    """(window, n, hits, ratio): share of events that meet a condition."""
    g = events.groupBy(window_start(F.col(ts), seconds).alias("window_start")).agg(F.count("*").alias("n"), F.count_if(condition).alias("hits"))
    return g.withColumn("ratio", F.round(F.col("hits") / F.col("n"), 8))


def counter_increase(samples: DataFrame, series: list[str], ts: str = "ts", value: str = "value") -> DataFrame:
    """Increase since the sample before; a fall is a reset and counts from zero."""
    before = F.lag(value).over(Window.partitionBy(*series).orderBy(ts))
    return samples.withColumn("increase", F.when(before.isNull(), 0.0).when(F.col(value) < before, F.col(value)).otherwise(F.col(value) - before))


def histogram(events: DataFrame, value: str, bounds: tuple[float, ...], *by: str) -> DataFrame:
    """(by..., le, n): cumulative counts; the last bound is infinite. Counted in one pass before the shuffle."""
    counts = [F.count_if(F.col(value) <= b).alias(f"_b{k}") for k, b in enumerate(bounds)]
    g = events.where(F.col(value).isNotNull()).groupBy(*by).agg(*counts, F.count("*").alias("_all"))
    rows = F.array(*[F.struct(F.lit(b).alias("le"), F.col(f"_b{k}").alias("n")) for k, b in enumerate(bounds)], F.struct(F.lit(float("inf")).alias("le"), F.col("_all").alias("n")))
    return g.select(*by, F.explode(rows).alias("x")).select(*by, "x.le", "x.n")


def histogram_quantile(hist: DataFrame, q: float, *by: str) -> DataFrame:
    """(by..., quantile): linear inside the first bucket that reaches the rank; the largest finite bound beyond it."""
    w = Window.partitionBy(*by).orderBy("le")
    h = hist.withColumns(
        {"below": F.coalesce(F.lag("n").over(w), F.lit(0)), "low": F.coalesce(F.lag("le").over(w), F.lit(0.0)), "total": F.max("n").over(Window.partitionBy(*by)), "top": F.max(F.when(F.col("le") != float("inf"), F.col("le"))).over(Window.partitionBy(*by))}
    )
    rank = F.col("total") * q
    hit = h.where((F.col("n") >= rank) & ((F.col("below") < rank) | (F.col("below") == 0))).groupBy(*by).agg(F.min_by(F.struct("low", "le", "below", "n", "top", "total"), "le").alias("b"))
    b = F.col("b")
    inside = b["low"] + (b["le"] - b["low"]) * (b["total"] * q - b["below"]) / (b["n"] - b["below"])
    return hit.select(*by, F.round(F.when(b["le"] == float("inf"), b["top"]).otherwise(inside), 6).alias("quantile"))


def surge(events: DataFrame, ts: str, value: str, seconds: int, factor: float = 2.0, offset: int = 86400) -> DataFrame:
    """(window, total, before): windows whose total is more than ``factor`` times that of the same window a day before."""
    t = events.groupBy(window_start(F.col(ts), seconds).alias("window_start")).agg(F.round(F.sum(value), 4).alias("total"))
    shifted = t.select((F.timestamp_seconds(F.unix_timestamp("window_start") + offset)).alias("window_start"), F.col("total").alias("before"))
    return t.join(shifted, "window_start").where(F.col("total") > factor * F.col("before"))


def firing(windows: DataFrame, condition: Column, seconds: int, hold: int, *by: str) -> DataFrame:
    """(by..., started, ended, windows): runs of neighbouring windows that meet a condition for at least ``hold`` seconds."""
    bad = windows.where(condition).withColumn("_k", (F.unix_timestamp("window_start") / seconds).cast("bigint"))
    order = Window.partitionBy(*by).orderBy("_k") if by else Window.orderBy("_k")
    runs = bad.withColumn("_run", F.col("_k") - F.row_number().over(order)).groupBy(*by, "_run").agg(F.min("window_start").alias("started"), F.max("window_start").alias("ended"), F.count("*").alias("windows"))
    return runs.where(F.col("windows") * seconds >= hold).drop("_run")


def absent(events: DataFrame, ts: str, seconds: int) -> DataFrame:
    """(window_start): windows between the first and the last event that hold none."""
    seen = events.select(window_start(F.col(ts), seconds).alias("window_start")).distinct()
    edge = seen.agg(F.min(F.unix_timestamp("window_start")).alias("a"), F.max(F.unix_timestamp("window_start")).alias("b")).where("a is not null")
    spine = edge.select(F.explode(F.sequence("a", "b", F.lit(seconds).cast("bigint"))).alias("s")).select(F.timestamp_seconds("s").alias("window_start"))
    return spine.join(seen, "window_start", "left_anti")


def inhibited(alerts: DataFrame, *rules: tuple[str, ...]) -> DataFrame:
    """Alerts (alertname, module, severity) without the warnings that a critical one silences: one that is alike in all columns of some rule."""
    out = alerts.where("severity = 'warning'")
    for on in rules or (("alertname", "module"),):
        out = out.join(alerts.where("severity = 'critical'").select(*on).distinct(), list(on), "left_anti").select(*alerts.columns)
    return alerts.where("severity <> 'warning'").unionByName(out)


def notifications(alerts: DataFrame, repeat: int, *by: str) -> DataFrame:
    """(by..., notified_at, alerts): one message for each group of firing alerts (by..., ts), at its first sample and again when ``repeat`` seconds have passed.

    Samples of a group that are ``repeat`` seconds or more apart begin anew. Groups are reduced to their distinct
    times before they are put in order.
    """
    at = alerts.groupBy(*by, F.unix_timestamp("ts").alias("at")).agg(F.count("*").alias("n"))
    w = Window.partitionBy(*by).orderBy("at")
    started = F.when(F.lag("at").over(w).isNull() | (F.col("at") - F.lag("at").over(w) >= repeat), F.col("at"))
    runs = at.withColumn("_start", F.last(started, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    turn = F.floor((F.col("at") - F.col("_start")) / repeat)
    return runs.groupBy(*by, "_start", turn.alias("_turn")).agg(F.min("at").alias("at"), F.sum("n").alias("alerts")).select(*by, F.timestamp_seconds("at").alias("notified_at"), "alerts")


def sums(events: DataFrame, ts: str, value: str, seconds: int, *by: str) -> DataFrame:
    """(window, by..., total) of a value."""
    return events.groupBy(window_start(F.col(ts), seconds).alias("window_start"), *by).agg(F.round(F.sum(value), 4).alias("total"))


def with_traces(audit: DataFrame, spans: DataFrame, key: str = "trace_id") -> DataFrame:
    """Audit rows with the segments of their trace: how many, and seconds in all. Spans are added up before the join; a row whose trace is unknown is left out."""
    of_trace = spans.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("segments"), F.round(F.sum("seconds"), 6).alias("seconds"))
    return audit.join(of_trace, key)


def sessions(events: DataFrame, user: str, ts: str, gap: int) -> DataFrame:
    """(user, session, started, ended, n): runs of events with no gap longer than ``gap`` seconds."""
    w = Window.partitionBy(user).orderBy(ts)
    before = F.lag(ts).over(w)
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    new = F.when(before.isNull() | (micros(F.col(ts)) - micros(before) > gap * 1_000_000), 1).otherwise(0)
    marked = events.select(user, ts, new.alias("_new")).withColumn("session", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(user, "session").agg(F.min(ts).alias("started"), F.max(ts).alias("ended"), F.count("*").alias("n"))


def audit_problems(df: DataFrame) -> DataFrame:
    """Audit rows with the array of what is wrong: required fields, known types and roles, a code for errors, forbidden content."""
    def missing(c: str) -> Column:
        return F.when(F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) == "", F.lit(f"missing: {c}"))

    texts = [c for c, kind in df.dtypes if kind == "string"]
    lists = [c for c, kind in df.dtypes if kind == "array<string>"]
    leak = [F.when(F.col(c).rlike(FORBIDDEN), F.lit(f"forbidden content: {c}")) for c in texts] + [F.when(F.exists(c, lambda x: x.rlike(FORBIDDEN)), F.lit(f"forbidden content: {c}")) for c in lists]
    rules = [
        *[missing(c) for c in ("ts", "event_id", "event_type", "actor_id", "actor_role", "outcome")],
        F.when(~F.col("event_type").isin(*EVENT_TYPES), F.lit("unknown event_type")),
        F.when(~F.col("actor_role").isin(*ROLES), F.lit("unknown actor_role")),
        F.when((F.col("outcome") == "error") & F.col("error_code").isNull(), F.lit("error without code")),
        *leak,
    ]
    return df.withColumn("problems", F.array_compact(F.array(*rules)))


def without_keys(attributes: Column, denied: Iterable[str]) -> Column:
    """A map without the keys that must not be exported."""
    deny = F.array(*[F.lit(k) for k in denied])
    return F.map_filter(attributes, lambda k, _: ~F.array_contains(deny, k))


def safe_lines(df: DataFrame, line: str = "value") -> DataFrame:
    """Log lines without those that hold a question, an answer or an address."""
    return df.where(~F.col(line).rlike(r'"(?:query_text|answer_text|client_ip)"\s*:'))


_ABSOLUTE = re.compile(r"(?:^|[\s\"'=(])(?:/(?:home|Users|root|mnt|data|var|tmp|opt)/|[A-Za-z]:[\\/])")
_RAW = re.compile(r"(?:^|[\\/\s\"'])(?:data[\\/])?raw[\\/][^\s\"']")
_FILE = re.compile(r"([\w-]{3,})\.(?:pdf|docx?|txt|png|jpe?g)\b", re.IGNORECASE)


def leaks_in(value: object, path: str = "$") -> Iterator[tuple[str, str, str]]:
    """(path, kind, value) of strings anywhere in a JSON value that give away paths or file names."""
    if isinstance(value, dict):
        for k, v in value.items():
            yield from leaks_in(v, f"{path}.{k}")
    elif isinstance(value, list):
        for k, v in enumerate(value):
            yield from leaks_in(v, f"{path}[{k}]")
    elif isinstance(value, str):
        if _ABSOLUTE.search(value):
            yield path, "absolute_path", value
        elif _RAW.search(value):
            yield path, "raw_path", value
        elif m := _FILE.search(value):
            yield path, f"file_name:{m[1]}", value


def leak_scan(reports: DataFrame, key: str, body: str, known: DataFrame) -> DataFrame:
    """(key, path, kind, value) of leaks in JSON reports; file names whose stem is a known doc_id are none."""
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            rows = []
            for k, b in zip(p[key], p[body], strict=True):
                try:
                    value = json.loads(b) if b else None
                except ValueError:
                    value = b
                rows += [(k, *x) for x in leaks_in(value)]
            yield pd.DataFrame(rows, columns=[key, "path", "kind", "value"])

    found = reports.select(key, body).mapInPandas(run, f"{key} {dict(reports.dtypes)[key]}, path string, kind string, value string")
    stem = F.regexp_extract("kind", "^file_name:(.*)$", 1)
    flagged = found.withColumn("doc_id", stem)
    return flagged.where("doc_id = ''").drop("doc_id").unionByName(flagged.where("doc_id <> ''").join(known.select(F.col("doc_id").cast("string")).distinct(), "doc_id", "left_anti").drop("doc_id").withColumn("kind", F.lit("file_name")))


def redact_paths(value: object, ids: dict[str, str], raw_dir: str = "raw") -> object:
    """A report without names of raw files: each path into the raw folder becomes the document's identifier and the extension.

    ``ids`` gives the identifier of each path relative to the folder; an unknown file becomes "document". Only the
    path changes, wherever it stands in a string; backslashes in it count as slashes.
    """
    if isinstance(value, dict):
        return {k: redact_paths(v, ids, raw_dir) for k, v in value.items()}
    if isinstance(value, list):
        return [redact_paths(v, ids, raw_dir) for v in value]
    if not isinstance(value, str):
        return value
    folder = re.escape(raw_dir.replace("\\", "/")).replace("/", r"[\\/]")

    def name(m: re.Match) -> str:
        rel = m[1].replace("\\", "/")
        stem, dot, extension = rel.rpartition(".")
        return ids.get(rel, "document") + (f".{extension}" if dot and "/" not in extension else "")

    return re.sub(rf"(?:[^\s\"'<>|]*[\\/])?{folder}[\\/]([^\s\"'<>|:;,]+(?: [^\s\"'<>|:;,/\\]+)*?\.[A-Za-z0-9]{{2,5}}\b|[^\s\"'<>|:;,]+)", name, value)


def route_template(path: Column) -> Column:
    """A path with its identifiers taken out, so that a label has few values."""
    bare = F.regexp_replace(F.split_part(path, F.lit("?"), F.lit(1)), "/$", "")
    return F.regexp_replace(F.regexp_replace(bare, "/[0-9]+(?=/|$)", "/{id}"), "/[0-9a-f]{8,}(?:-[0-9a-f]+)*(?=/|$)", "/{id}")


def request_metrics(requests: DataFrame, skip: str = "/metrics") -> DataFrame:
    """(method, route, status, n, seconds) of request rows (method, path, status, seconds, error); an unhandled error counts as 500."""
    status = F.when(F.col("error").isNotNull(), 500).otherwise(F.col("status"))
    r = requests.withColumn("route", route_template(F.col("path"))).where(F.col("route") != skip)
    return r.groupBy("method", "route", status.alias("status")).agg(F.count("*").alias("n"), F.round(F.sum("seconds"), 6).alias("seconds"))


def request_durations(requests: DataFrame, bounds: tuple[float, ...] = BUCKETS["http"], skip: str = "/metrics") -> DataFrame:
    """(method, route, le, n): the cumulative histogram of durations by route; failed requests count too."""
    r = requests.withColumn("route", route_template(F.col("path"))).where(F.col("route") != skip)
    return histogram(r, "seconds", bounds, "method", "route")


def span_summary(spans: DataFrame) -> DataFrame:
    """(name, n, p50, p95) of trace segments (name, seconds)."""
    return spans.groupBy("name").agg(F.count("*").alias("n"), F.round(F.median("seconds"), 6).alias("p50"), F.expr("percentile_disc(0.95) within group (order by seconds)").alias("p95"))
