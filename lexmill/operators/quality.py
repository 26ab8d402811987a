"""Checks of rows and of whole tables, profiles, gates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.functions import text as T

SOURCES = ("Bulletin Officiel", "Contrat Type", "Dépôt Interne", "Jurisprudence", "Portail Officiel")
LANGUAGES = ("fr", "ar")
DATE = r"^(?:[0-9]{4}|[0-9]{4}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12][0-9]|3[01]))$"
METHODS = ("text", "pdf_direct", "ocr_pdf", "ocr_image", "docx")
#: Columns that the contract keeps out. Fixed values.
FORBIDDEN_COLUMNS = ("original_filename", "source_path", "raw_path", "absolute_path", "author", "email")


def blank(c: Column) -> Column:
    return F.trim(F.coalesce(c.cast("string"), F.lit(""))) == ""


def check_forbidden(df: DataFrame) -> None:
    bad = [c for c in FORBIDDEN_COLUMNS if c in df.columns]
    if bad:
        raise ValueError(f"forbidden columns: {', '.join(bad)}")


def metadata_errors(df: DataFrame, key: str = "doc_id", least: int = 5, with_warnings: bool = False) -> DataFrame:
    """(key, errors): everything that is wrong with a metadata row; and, if asked for, warnings."""
    year = F.substring("doc_date", 1, 4).cast("int")
    rules = [
        (blank(F.col("title")), "missing: title"),
        (blank(F.col("doc_date")), "missing: date"),
        (blank(F.col("source")), "missing: source"),
        (F.col(key).rlike(r"\s"), "schema: doc_id"),
        (~blank(F.col("source")) & ~F.col("source").isin(*SOURCES), "schema: source"),
        (~F.coalesce(F.col("language").isin(*LANGUAGES), F.lit(False)), "schema: language"),
        (~blank(F.col("doc_date")) & (~F.col("doc_date").rlike(DATE) | (year < 1900)), "schema: date"),
        (F.col("file_path").rlike(r"^(?:/|[A-Za-z]:)"), "schema: file_path"),
        (blank(F.col("file_path")), "missing: file_path"),
        (F.coalesce(F.col("word_count_clean"), F.lit(0)) < least, "text: too short"),
    ]
    if with_warnings:
        warned = F.when(F.coalesce(F.col("word_count_clean"), F.lit(0)) > 20_000, F.array(F.lit("text: very long"))).otherwise(F.array().cast("array<string>"))
        return df.select(key, F.array_compact(F.array(*[F.when(c, F.lit(m)) for c, m in rules])).alias("errors"), warned.alias("warnings"))
    return df.select(key, F.array_compact(F.array(*[F.when(c, F.lit(m)) for c, m in rules])).alias("errors"))


def quality_summary(errors: DataFrame) -> DataFrame:
    """total, passed, failed and pass rate."""
    ok = F.size("errors") == 0
    return errors.agg(
        F.count("*").alias("total"), F.count_if(ok).alias("passed"), F.count_if(~ok).alias("failed"), F.coalesce(F.round(F.try_divide(F.count_if(ok), F.count("*")), 4), F.lit(0.0)).alias("pass_rate")
    )


def top_messages(errors: DataFrame, most: int = 10) -> DataFrame:
    """The most frequent messages; ties in the order of the message."""
    return errors.select(F.explode("errors").alias("message")).groupBy("message").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "message").limit(most)


def expectations(df: DataFrame) -> DataFrame:
    """(expectation, failures): one row for each expectation on the metadata table, all from one pass.

    Value expectations leave nulls aside, as data-quality libraries do.
    """
    def bad(condition: Column) -> Column:
        return F.count_if(F.coalesce(condition, F.lit(False)))

    checks = {
        "rows_at_least_1": F.when(F.count("*") < 1, 1).otherwise(0),
        "doc_id_not_null": bad(F.col("doc_id").isNull()),
        "doc_id_unique": F.count("doc_id") - F.count_distinct("doc_id"),
        "doc_id_no_space": bad(F.col("doc_id").rlike(r"\s")),
        "title_not_null": bad(F.col("title").isNull()),
        "title_not_empty": bad(F.length("title") < 1),
        "source_in_set": bad(~F.col("source").isin(*SOURCES)),
        "language_in_set": bad(~F.col("language").isin(*LANGUAGES)),
        "date_format": bad(~F.col("doc_date").rlike(DATE)),
        "category_not_null": bad(F.col("category").isNull()),
        "file_path_not_null": bad(F.col("file_path").isNull()),
        "file_path_relative": bad(F.col("file_path").rlike(r"^(?:/|[A-Za-z]:)")),
        "words_in_range": bad((F.col("word_count_clean") < 5) | (F.col("word_count_clean") > 20000)),
        "chars_at_least_1": bad(F.col("char_count_clean") < 1),
        "segments_not_negative": bad(F.col("segment_count") < 0),
        "status_success": bad(F.col("status") != "SUCCESS"),
    }
    one = df.agg(*[c.cast("bigint").alias(k) for k, c in checks.items()])
    return one.select(F.explode(F.map_from_arrays(F.array(*[F.lit(k) for k in checks]), F.array(*[F.col(k) for k in checks]))).alias("expectation", "failures"))


def columns_match(df: DataFrame, contract: set[str]) -> list[str]:
    """Names that one side has and the other lacks."""
    return sorted(set(df.columns) ^ contract)


def gate(failures: DataFrame) -> None:
    """Stops a pipeline whose expectations fail."""
    n = failures.where("failures > 0").count()
    if n:
        raise RuntimeError(f"{n} expectations failed")


def value_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """(field, value, n) of each column, null and empty as one value; one shuffle for all columns."""
    pairs = F.array(*[F.struct(F.lit(c).alias("field"), F.coalesce(F.when(F.trim(F.col(c).cast("string")) == "", None).otherwise(F.col(c).cast("string")), F.lit("(non renseigné)")).alias("value")) for c in columns])
    return df.select(F.explode(pairs).alias("x")).groupBy("x.field", "x.value").agg(F.count("*").alias("n"))


def distribution(df: DataFrame, value: Column) -> DataFrame:
    """n, min, median, mean, max, total; zeros for an empty table.

    The median keeps a count for each distinct value, which suits counts of words and segments.
    """
    zero = F.lit(0)
    return df.agg(
        F.count(value).alias("n"), F.coalesce(F.min(value), zero).alias("min"), F.coalesce(F.round(F.median(value), 2), zero.cast("double")).alias("median"),
        F.coalesce(F.round(F.avg(value), 2), zero.cast("double")).alias("mean"), F.coalesce(F.max(value), zero).alias("max"), F.coalesce(F.sum(value), zero).alias("total"),
    )


def segment_counts(docs: DataFrame, segments: DataFrame, key: str) -> DataFrame:
    """(key, n_segments) of every document, zero where it has none."""
    n = segments.groupBy(F.col("doc_id").alias(key)).agg(F.count("*").alias("n_segments"))
    return docs.select(key).join(n, key, "left").select(key, F.coalesce("n_segments", F.lit(0)).alias("n_segments"))


def coverage_gap(declared: DataFrame, present: DataFrame, key: str) -> DataFrame:
    return declared.select(key).distinct().join(present.select(key), key, "left_anti")


def regressions(baseline: DataFrame, candidate: DataFrame, key: str, most: float = 0.05) -> DataFrame:
    """(key, baseline, candidate, drop) of metrics (key, value) that fell by more than ``most``."""
    j = baseline.select(key, F.col("value").alias("baseline")).join(candidate.select(key, F.col("value").alias("candidate")), key)
    return j.withColumn("drop", F.round(F.col("baseline") - F.col("candidate"), 6)).where(F.col("drop") > most)


def promotion(metrics: DataFrame, minima: dict[str, float], maxima: dict[str, float]) -> DataFrame:
    """(promote, reasons): missing metrics count against promotion."""
    rows = metrics.groupBy().pivot("metric", [*minima, *maxima]).agg(F.first("value"))
    tests = [(F.col(k), F.col(k) >= v, f"{k} below {v}") for k, v in minima.items()] + [(F.col(k), F.col(k) <= v, f"{k} above {v}") for k, v in maxima.items()]
    reasons = F.array_compact(F.array(*[F.when(c.isNull(), F.lit(f"{m.split()[0]} missing")).when(~ok, F.lit(m)) for c, ok, m in tests]))
    return rows.select((F.size(reasons) == 0).alias("promote"), reasons.alias("reasons"))


def numeric_metrics(df: DataFrame) -> DataFrame:
    """Metrics (metric, value as text) that are numbers."""
    return df.select("metric", F.expr("try_cast(value as double)").alias("value")).where("value is not null")


def require(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """``df``, failing while it runs on the first row that breaks a check."""
    wrong = reduce(lambda a, kv: a.when(~F.coalesce(kv[1], F.lit(False)), F.lit(kv[0])), checks.items(), F.when(F.lit(False), F.lit("")))
    return df.withColumn("_wrong", wrong).where(F.when(F.col("_wrong").isNotNull(), F.raise_error(F.col("_wrong")).isNull()).otherwise(True)).drop("_wrong")


def split_rows(df: DataFrame, key: str, share: float, seed: int = 0) -> DataFrame:
    """``df`` with is_validation: of n rows the max(1, min(n - 1, round(n * share))) whose keys hash lowest, the same on every run and layout.

    At least two rows are needed. Hashes are counted by their first digits, so the row at the border is found without
    sorting the table: only rows of one bucket are put in order.
    """
    if not 0 < share < 1:
        raise ValueError("the share must be between 0 and 1")
    hashed = df.withColumn("_h", F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))))
    counts = sorted((r["b"] or "", r["n"]) for r in hashed.groupBy(F.substring("_h", 1, 3).alias("b")).agg(F.count("*").alias("n")).collect())
    n = sum(x for _, x in counts)
    if n < 2:
        raise ValueError("a split needs at least two rows")
    left = max(1, min(n - 1, round(n * share)))
    border = ""
    for border, many in counts:
        if many >= left:
            break
        left -= many
    bucket = F.substring("_h", 1, 3)
    edge = hashed.where(bucket == border).groupBy("_h").agg(F.count("*").alias("n")).withColumn("_to", F.sum("n").over(Window.orderBy("_h")))
    last = edge.where(F.col("_to") >= left).agg(F.min("_h")).first()[0]
    return hashed.withColumn("is_validation", F.coalesce(F.col("_h") <= last, F.lit(False))).drop("_h")


def spelled_counts(df: DataFrame, text: str) -> DataFrame:
    return df.select(F.length(text).alias("chars"), T.word_count(F.col(text)).alias("words"))


#: Columns whose values may be shown in a report; all others are suppressed.
SHOWN = ("doc_id", "source", "language", "doc_date", "status", "word_count_clean")


def expectation_samples(df: DataFrame, most: int = 5) -> DataFrame:
    """(expectation, failures, samples): failed value expectations with a few failing values, of columns that may be shown."""
    tests = {
        "doc_id_no_space": ("doc_id", F.col("doc_id").rlike(r"\s")),
        "source_in_set": ("source", ~F.col("source").isin(*SOURCES)),
        "language_in_set": ("language", ~F.col("language").isin(*LANGUAGES)),
        "date_format": ("doc_date", ~F.col("doc_date").rlike(DATE)),
        "words_in_range": ("word_count_clean", (F.col("word_count_clean") < 5) | (F.col("word_count_clean") > 20000)),
        "status_success": ("status", F.col("status") != "SUCCESS"),
        "file_path_relative": ("file_path", F.col("file_path").rlike(r"^(?:/|[A-Za-z]:)")),
    }
    rows = F.array_compact(F.array(*[F.when(c, F.struct(F.lit(k).alias("expectation"), F.when(F.lit(col in SHOWN), F.col(col).cast("string")).alias("value"))) for k, (col, c) in tests.items()]))
    failed = df.select(F.explode(rows).alias("x")).groupBy("x.expectation", "x.value").agg(F.count("*").alias("n"))
    # values are distinct by now; each keeps only its rank before they are gathered
    w = Window.partitionBy("expectation").orderBy("value")
    first = failed.withColumn("_n", F.row_number().over(w))
    return first.groupBy("expectation").agg(F.sum("n").alias("failures"), F.array_join(F.array_sort(F.collect_list(F.when((F.col("_n") <= most) & F.col("value").isNotNull(), F.col("value")))), "; ").alias("samples"))


def quality_gate(metrics: DataFrame, minima: dict[str, float], baseline: DataFrame, most_drop: float = 0.05) -> DataFrame:
    """(passed, reasons): minima missed or missing, and metrics that fell too far from the baseline."""
    wanted = metrics.sparkSession.createDataFrame(list(minima.items()), "metric string, least double")
    low = wanted.join(metrics, "metric", "left").where("value is null or value < least").select(F.when(F.col("value").isNull(), F.concat("metric", F.lit(" missing"))).otherwise(F.concat("metric", F.lit(" too low"))).alias("reason"))
    fell = regressions(baseline.withColumnRenamed("metric", "m"), metrics.withColumnRenamed("metric", "m"), "m", most_drop).select(F.concat("m", F.lit(" regressed")).alias("reason"))
    return low.unionByName(fell).agg(F.array_sort(F.collect_list("reason")).alias("reasons")).select((F.size("reasons") == 0).alias("passed"), "reasons")


def shares(df: DataFrame, column: str) -> DataFrame:
    """(value, n, percent) of a column's values."""
    g = df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    total = g.agg(F.sum("n").alias("total"))
    return g.join(F.broadcast(total)).select("value", "n", F.round(100.0 * F.col("n") / F.col("total"), 2).alias("percent"))


def board(items: DataFrame, order: tuple[str, ...] = ("done", "progress", "planned")) -> DataFrame:
    """(status, n, mean_progress, tools) of items (status, progress, tools array), in the order of the statuses."""
    rank = F.array_position(F.array(*[F.lit(s) for s in order]), F.col("status"))
    tools = items.select("status", F.explode("tools").alias("tool")).groupBy("status").agg(F.count_distinct("tool").cast("int").alias("tools"))
    g = items.groupBy("status").agg(F.count("*").alias("n"), F.round(F.avg("progress")).cast("int").alias("mean_progress"))
    return g.join(tools, "status", "left").select("status", "n", "mean_progress", F.coalesce("tools", F.lit(0)).alias("tools")).orderBy(rank)
