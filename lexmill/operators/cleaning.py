"""Cleaning of documents: lines repeated within one, page lines, blanks; first-wins removal of exact copies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.functions import text as T

#: Starts of lines that structure a text and are never running headers.
STRUCTURE = r"(?iu)^(?:article|art\.|alin[ée]a|al\.|المادة|الفصل|الفقرة)\s*[0-9٠-٩]+"


def without_repeated_lines(df: DataFrame, text: str, least: int = 3, longest: int = 80, keep_sentences: bool = True) -> DataFrame:
    """``df`` whose ``text`` lacks the lines that occur ``least`` times in it and look like running headers.

    Only within one row, so no shuffle. Lines are sorted once for each row, and a line that equals the one
    ``least`` - 1 places on is repeated; each step is a projection of its own, so nothing is worked out
    again for each line. A text that would become blank stays as it is.
    """
    split = df.withColumn("_lines", F.split(text, "\n", -1))
    ordered = split.withColumn("_sorted", F.sort_array(F.transform("_lines", lambda x: F.trim(x))))
    last = F.size("_sorted") - least + 1
    places = F.when(last >= 1, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
    many = F.transform(F.filter(places, lambda k: F.element_at("_sorted", k) == F.element_at("_sorted", k + (least - 1))), lambda k: F.element_at("_sorted", k))
    header = lambda x: (F.length(x) > 0) & (F.length(x) <= longest) & ~x.rlike(STRUCTURE) & (F.lit(not keep_sentences) | ~x.rlike(r"[.!؟۔]$"))
    marked = ordered.withColumn("_often", F.filter(F.array_distinct(many), header))
    kept = F.array_join(F.filter("_lines", lambda x: ~F.array_contains("_often", F.trim(x))), "\n")
    cut = marked.withColumn("_kept", F.when(F.size("_often") == 0, F.col(text)).otherwise(kept))
    return cut.withColumn(text, F.when(T.trim_all(F.col("_kept")) == "", F.col(text)).otherwise(F.col("_kept"))).drop("_lines", "_sorted", "_often", "_kept")


def cleaned(df: DataFrame, text: str = "text", **repeated) -> DataFrame:
    """The steps of cleaning in their fixed order; cleaning twice changes nothing more."""
    first = df.withColumn(text, T.pipeline(F.col(text), T.unify_newlines, T.strip_controls, T.collapse_blanks, T.drop_page_lines))
    return without_repeated_lines(first, text, **repeated).withColumn(text, T.collapse_blank_lines(F.col(text)))


def classify_copies(docs: DataFrame, key: str, text: str, order: str, failed: Column | None = None) -> DataFrame:
    """``docs`` with status (success, duplicate, skipped) and duplicate_of.

    The first row of each text in ``order`` that did not fail succeeds; later ones are duplicates of it.
    Only hashes are shuffled with the keys. Empty or null texts and failed rows are skipped.
    """
    bad = F.lit(False) if failed is None else F.coalesce(failed, F.lit(False))
    empty = F.coalesce(T.trim_all(F.col(text)) == "", F.lit(True))
    # rows without text get a hash of their own, so that they don't meet in one task
    own = F.when(empty, F.concat(F.lit("-"), F.coalesce(F.col(key).cast("string"), F.lit("")))).otherwise(F.sha2(F.col(text), 256))
    slim = docs.select(F.col(key).alias("k"), F.col(order).alias("o"), own.alias("h"), empty.alias("empty"), bad.alias("bad"))
    # a hash that everyone shares is reduced to one row per hash before it meets the documents again
    first = slim.where(~F.col("empty") & ~F.col("bad")).groupBy("h").agg(F.min(F.struct("o", "k")).alias("first"))
    joined = slim.join(first, "h", "left")
    later = F.col("first").isNotNull() & (F.struct("o", "k") > F.col("first"))
    status = F.when(F.col("empty"), "skipped").when(later, "duplicate").when(F.col("bad"), "skipped").otherwise("success")
    return joined.select(F.col("k").alias(key), status.alias("status"), F.when(~F.col("empty") & later, F.col("first.k")).alias("duplicate_of"))


def latest(df: DataFrame, key: str, *order: Column) -> DataFrame:
    """The last version of each key: the upsert of a table whose rows only ever get appended."""
    w = Window.partitionBy(key).orderBy(*[c.desc_nulls_last() for c in order])
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
