"""The registered queries of this package and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.llm import budget, language, leaks, packing, pairs, pieces, pii, scans, sitelines, truncation
from lexmill.session import table


def _with_cut_copies(documents: DataFrame) -> DataFrame:
    """Every document besides a copy cut at three fifths of its length."""
    own = documents.select("doc_id", "source", "title", "text")
    return own.unionByName(own.select((-F.col("doc_id") - 1).alias("doc_id"), "source", "title", F.expr("substring(text, 1, cast(floor(length(text) * 3 / 5) as int))").alias("text")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "p1_found": lambda s, d: language.found(table(s, d, "documents")),
        "p1_judged": lambda s, d: language.judged(table(s, d, "documents")),
        "p2_found": lambda s, d: pii.found(table(s, d, "documents")),
        "p2_anonymised": lambda s, d: pii.anonymised(table(s, d, "documents")),
        "p3_found": lambda s, d: pairs.found(table(s, d, "finetune_examples"), table(s, d, "chat_messages")),
        "p3_defects": lambda s, d: pairs.flagged(pairs.pairs_of(table(s, d, "finetune_examples"), table(s, d, "chat_messages"))),
        "p4_found": lambda s, d: scans.found(table(s, d, "documents")),
        "p4_repaired": lambda s, d: scans.repaired(table(s, d, "documents")),
        "p5_found": lambda s, d: pieces.found(table(s, d, "chunks")),
        "p5_pieces": lambda s, d: pieces.pieces(table(s, d, "chunks")),
        "p6_found": lambda s, d: sitelines.found(table(s, d, "documents")),
        "p6_cleaned": lambda s, d: sitelines.cleaned(table(s, d, "documents")),
        "p7_found": lambda s, d: budget.found(table(s, d, "chunks")),
        "p7_totals": lambda s, d: budget.totals(table(s, d, "chunks"), table(s, d, "documents")),
        "p7_exact_totals": lambda s, d: budget.totals(table(s, d, "chunks"), table(s, d, "documents")).drop("est_tokens", "est_document_tokens"),
        "p7_errors": lambda s, d: budget.errors(table(s, d, "chunks")),
        "p8_packed": lambda s, d: packing.pack(table(s, d, "documents")),
        "p8_fill": lambda s, d: packing.fill(packing.pack(table(s, d, "documents"))),
        "p9_found": lambda s, d: leaks.found(table(s, d, "documents"), table(s, d, "eval_items")),
        "p8_words": lambda s, d: packing.pack(table(s, d, "documents"), tokens=budget.words_of).groupBy("doc_id").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("pieces")),
        "p8_bounds": lambda s, d: packing.pack(table(s, d, "documents"), tokens=budget.words_of).where("container is not null").groupBy("container").agg(F.sum("tokens").alias("n")).agg((F.max("n") <= packing.CAPACITY).alias("bounded"), F.sum("n").alias("tokens")),
        "p5_whole": lambda s, d: pieces.pieces(table(s, d, "chunks")).groupBy("chunk_id").agg(F.max("token_count").alias("most"), F.min("piece_no").alias("first")).select("chunk_id", (F.col("most") <= 512).alias("bounded"), F.col("first").cast("bigint").alias("first")),
        "p10_copies": lambda s, d: truncation.longer_copies(_with_cut_copies(table(s, d, "documents"))).select("doc_id"),
        "p10_found": lambda s, d: truncation.found(table(s, d, "documents")),
        "p10_rates": lambda s, d: truncation.rates(table(s, d, "documents")),
        "p9_spans": lambda s, d: leaks.leaked_spans(table(s, d, "documents"), table(s, d, "eval_items")),
    }


def oracle_sql() -> dict[str, str]:
    return {
        "p5_found": pieces.SQL_FOUND,
        "p6_found": sitelines.SQL_FOUND,
        "p6_cleaned": sitelines.SQL_CLEANED,
        "p8_words": f"SELECT doc_id, CAST(n AS BIGINT) AS tokens, CASE WHEN n > 1024 THEN CAST(ceil(n / 1024) AS BIGINT) ELSE 1 END AS pieces FROM (SELECT doc_id, {budget.SQL_COUNT} AS n FROM documents)",
        "p8_bounds": f"SELECT true AS bounded, CAST(sum(n) AS BIGINT) AS tokens FROM (SELECT {budget.SQL_COUNT} AS n FROM documents)",
        "p9_found": leaks.SQL_FOUND,
        "p5_whole": f"SELECT chunk_id, true AS bounded, CAST(0 AS BIGINT) AS first FROM ({pieces.SQL_FOUND})",
        "p10_copies": "WITH t AS (SELECT doc_id, text FROM documents UNION ALL SELECT -doc_id - 1, substr(text, 1, CAST(length(text) * 3 // 5 AS BIGINT)) FROM documents) SELECT DISTINCT a.doc_id FROM t a JOIN t b ON substr(a.text, 1, 32) = substr(b.text, 1, 32) AND length(b.text) > length(a.text) AND starts_with(b.text, a.text) WHERE length(a.text) >= 32",
        "p7_found": budget.SQL_FOUND,
        "p7_exact_totals": budget.SQL_EXACT,
    }
