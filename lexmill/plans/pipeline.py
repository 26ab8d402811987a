"""The ingestion pipeline end to end, its counters and reports, and a command line over it."""

from __future__ import annotations

import argparse
import json
import os
import sys
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill import resources
from lexmill.functions import text as T
from lexmill.operators import cleaning, masking, quality, spelling, structure
from lexmill.sources import files


@dataclass(frozen=True)
class IngestConfig:
    """What a run does; ``anonymise`` off keeps personal data and says so in the report.

    Recognised text is corrected against ``lexicon``, by default the list of French legal words that is shipped.
    """

    anonymise: bool = True
    spelling: bool = True
    lexicon: tuple[str, ...] = resources.words("legal_fr")
    sources: tuple[tuple[str, str], ...] = ()

    def __post_init__(self) -> None:
        if self.spelling and not self.lexicon:
            raise ValueError("spelling needs a lexicon")


def process(documents: DataFrame, config: IngestConfig = IngestConfig()) -> DataFrame:
    """Documents (doc_id, file_path, source, text, extraction_method, error, metadata...) cleaned, corrected, told from copies and masked.

    Adds status, duplicate_of, text_clean, spans, corrections and counts. Only keys and hashes are shuffled
    to find copies; texts stay where they were read.
    """
    d = cleaning.cleaned(documents.withColumn("text_clean", F.col("text")), "text_clean")
    if config.spelling:
        d = d.withColumn("_s", spelling.correction(list(config.lexicon))(F.col("text_clean"), F.col("extraction_method"))).withColumns({"text_clean": F.col("_s.text"), "corrections": F.col("_s.corrections")}).drop("_s")
    else:
        d = d.withColumn("corrections", F.array().cast("array<struct<at:int,before:string,after:string,rule:string>>"))
    copies = cleaning.classify_copies(d.withColumn("_order", F.split("file_path", "/")), "doc_id", "text_clean", "_order", F.col("error").isNotNull())
    d = d.join(copies, "doc_id")
    if config.anonymise:
        d = d.withColumn("_m", masking.masking()(F.col("text_clean"))).withColumn("text_clean", F.col("_m.text")).withColumn("spans", F.size("_m.spans")).drop("_m")
    else:
        d = d.withColumn("spans", F.lit(0))
    return d.withColumns({"char_count_clean": F.length("text_clean"), "word_count_clean": T.word_count(F.col("text_clean")), "anonymized": F.col("spans") > 0})


def counters(processed: DataFrame, segments: DataFrame) -> dict:
    """Counts of one run; the success rate is over all files, copies included."""
    c = processed.agg(
        F.count("*").alias("total_files_discovered"), F.count_if(F.col("status") == "success").alias("processed"), F.count_if(F.col("status") == "skipped").alias("skipped"),
        F.count_if(F.col("error").isNotNull()).alias("failed"), F.count_if(F.col("status") == "duplicate").alias("duplicates"), F.coalesce(F.sum(F.when(F.col("status") == "success", F.col("spans"))), F.lit(0)).alias("pii_masked"),
    ).first().asDict()
    c["segments"] = segments.count()
    c["success_rate"] = round(c["processed"] / c["total_files_discovered"], 4) if c["total_files_discovered"] else 0.0
    c["extraction_methods"] = {r[0]: r[1] for r in processed.where("status = 'success'").groupBy("extraction_method").count().collect()}
    c["ocr_corrections"] = {r[0]: r[1] for r in spelling.tally(processed.where("status = 'success'")).collect()}
    return c


def ready(report: dict) -> bool:
    """A run may be published if its report is there and nothing failed; a report without the count is not."""
    return report.get("failed", 1) == 0


def run(spark: SparkSession, root: str, out: str, config: IngestConfig = IngestConfig(), **readers: files.Extractor) -> dict:
    """Ingests a folder, writes metadata, texts, segments, errors and the report, and the READY file if all went well."""
    done = process(files.ingest(spark, root, dict(config.sources) or None, **readers), config).persist(StorageLevel.DISK_ONLY)
    good = done.where("status = 'success'")
    segments = structure.segments(good, "doc_id", "text_clean")
    n = quality.segment_counts(good, segments, "doc_id").withColumnRenamed("n_segments", "segment_count")
    metadata = good.join(n, "doc_id").select(
        "doc_id", "title", "source", "doc_date", "category", "language", "file_path", F.regexp_extract("file_path", r"(\.[A-Za-z0-9]+)$", 1).alias("source_format"), "extraction_method", "char_count_raw", "word_count_raw",
        "char_count_clean", "word_count_clean", "anonymized", F.lit("SUCCESS").alias("status"), T.utc_text(F.current_timestamp()).alias("processed_at"), "segment_count",
    )
    metadata.write.mode("overwrite").parquet(os.path.join(out, "metadata"))
    good.select("doc_id", "file_path", F.col("text_clean").alias("text")).write.mode("overwrite").parquet(os.path.join(out, "texts"))
    segments.write.mode("overwrite").parquet(os.path.join(out, "segments"))
    done.where("status <> 'success'").select("doc_id", "file_path", "status", "duplicate_of", "error").write.mode("overwrite").parquet(os.path.join(out, "left_out"))
    report = counters(done, segments)
    if not config.anonymise:
        report["warning"] = "personal data was kept"
    report["expectations"] = {r["expectation"]: r["failures"] for r in quality.expectations(spark.read.parquet(os.path.join(out, "metadata"))).collect()}
    files.write_report(spark, report, os.path.join(out, "report.json"))
    flag = os.path.join(out, "READY")
    if ready(report):
        files.write_text(spark, flag, "")
    else:
        files.remove(spark, flag)
    done.unpersist()
    return report


def card(metadata: DataFrame, segments: DataFrame) -> str:
    """A profile of a processed corpus as Markdown."""
    counts = quality.value_counts(metadata.withColumn("year", F.substring("doc_date", 1, 4)), ["source", "language", "category", "extraction_method", "year"]).orderBy("field", "value")
    return files.markdown_card(
        "Corpus",
        {
            "Values": [r.asDict() for r in counts.collect()],
            "Words": [quality.distribution(metadata, F.col("word_count_clean")).first().asDict()],
            "Segments": [quality.distribution(quality.segment_counts(metadata, segments, "doc_id"), F.col("n_segments")).first().asDict()],
        },
    )


def main(args: list[str] | None = None) -> int:
    """ingest ROOT OUT | check OUT | card OUT"""
    p = argparse.ArgumentParser(description=main.__doc__)
    p.add_argument("command", choices=("ingest", "check", "card"))
    p.add_argument("paths", nargs="+")
    p.add_argument("--keep-personal-data", action="store_true")
    a = p.parse_args(args)
    spark = SparkSession.builder.getOrCreate()
    out = a.paths[-1]
    if a.command == "ingest":
        report = run(spark, a.paths[0], out, IngestConfig(anonymise=not a.keep_personal_data))
        print(json.dumps(report, ensure_ascii=False, indent=2))
        return int(not ready(report))
    metadata = spark.read.parquet(os.path.join(out, "metadata"))
    if a.command == "check":
        failed = quality.expectations(metadata).where("failures > 0").collect()
        for r in failed:
            print(r["expectation"], r["failures"])
        return int(bool(failed))
    print(card(metadata, spark.read.parquet(os.path.join(out, "segments"))))
    return 0


if __name__ == "__main__":
    sys.exit(main())
