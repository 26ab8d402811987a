"""Files as tables: discovery, extraction, side files, strict JSON lines, the corpus reader, sinks."""

from __future__ import annotations

import io
import json
import pathlib
import re
import zipfile
from collections.abc import Callable, Iterable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as t

from lexmill.functions import text as T

EXTENSIONS = ("txt", "pdf", "docx", "png", "jpg", "jpeg")
#: Direct text shorter than this calls for recognition.
LEAST_DIRECT = 20


def relative_path(root: str) -> F.Column:
    """The path below the root, of a file source's ``path``, whose scheme and escapes are undone."""
    plain = re.sub("^[a-z][a-z0-9+]*:/*", "/", root.rstrip("/"))
    path = F.regexp_replace(F.url_decode(F.replace(F.col("path"), F.lit("+"), F.lit("%2B"))), "^[a-z][a-z0-9+]*:/*", "/")
    return F.when(F.startswith(path, F.lit(plain + "/")), F.substring(path, F.lit(len(plain) + 2), F.length(path))).otherwise(path)


def discover(spark: SparkSession, root: str, recursive: bool = True) -> DataFrame:
    """(path, rel, extension, length, content) of files with a known extension."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(root)
    df = df.withColumn("rel", relative_path(root)).withColumn("extension", F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1)))
    return df.where(F.col("extension").isin(*EXTENSIONS)).select("path", "rel", "extension", "length", "content")


def in_path_order(df: DataFrame, path: str = "rel") -> DataFrame:
    """Order by path components, in which a folder comes before a longer name that begins like it."""
    return df.orderBy(F.split(path, "/"))


def docx_text(content: bytes) -> str:
    """Paragraphs of a word processor file."""
    ns = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        root = ElementTree.fromstring(z.read("word/document.xml"))
    return "\n".join("".join(x.text or "" for x in p.iter(f"{ns}t")) for p in root.iter(f"{ns}p"))


Extractor = Callable[[bytes], str]


def extract(files: DataFrame, pdf: Extractor | None = None, recognise: Extractor | None = None) -> DataFrame:
    """(rel, text, method, error). PDF text and recognition come from injected functions; without them such files have an empty text."""

    def one(ext: str, content: bytes) -> tuple[str | None, str | None, str | None]:
        try:
            if ext == "txt":
                return bytes(content).decode("utf-8"), "text", None
            if ext == "docx":
                return docx_text(bytes(content)), "docx", None
            if ext == "pdf":
                direct = pdf(bytes(content)) if pdf else ""
                if len(direct.strip()) >= LEAST_DIRECT or not recognise:
                    return direct, "pdf_direct", None
                seen = recognise(bytes(content))
                return (seen, "ocr_pdf", None) if seen.strip() else (direct, "pdf_direct", None)
            # without an engine a picture is an empty text, which later steps leave out as such
            return (recognise(bytes(content)) if recognise else ""), "ocr_image", None
        except Exception as e:  # noqa: BLE001 - a broken file is a row with an error
            return None, None, f"{type(e).__name__}: {e}"[:200]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            rows = [(r, *one(e, c)) for r, e, c in zip(p["rel"], p["extension"], p["content"], strict=True)]
            yield pd.DataFrame(rows, columns=["rel", "text", "method", "error"])

    return files.select("rel", "extension", "content").mapInPandas(run, "rel string, text string, method string, error string")


SIDE = t.StructType([t.StructField(c, t.StringType()) for c in ("title", "source", "date", "category", "language")])


#: What is added to the whole name of a file to name its side file.
SIDE_SUFFIX = ".meta.json"


def side_files(spark: SparkSession, root: str) -> DataFrame:
    """(rel, side) from ``<file>.<extension>.meta.json`` beside the documents, by the document's relative path; a broken one gives nulls."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*" + SIDE_SUFFIX).load(root)
    return df.select(F.regexp_replace(relative_path(root), r"\.meta\.json$", "").alias("rel"), F.from_json(F.decode("content", "UTF-8"), SIDE).alias("side"))


#: Languages of recognition in the order in which they are wanted, and the one to fall back on.
RECOGNITION = (("fra", "ara"), "eng")


def recognition_language(installed: Iterable[str]) -> str | None:
    """The languages to recognise with, joined by a plus sign: those wanted that are installed, else the fallback, else none."""
    have = set(installed)
    wanted, fallback = RECOGNITION
    return "+".join(x for x in wanted if x in have) or (fallback if fallback in have else None)


def ingest(spark: SparkSession, root: str, source_of: dict[str, str] | None = None, **readers: Extractor) -> DataFrame:
    """Documents of a folder with metadata: side file before folder name before default."""
    texts = extract(discover(spark, root), **readers)
    folder = F.element_at(F.split("rel", "/"), 1)
    table = F.create_map(*[F.lit(x) for kv in (source_of or {}).items() for x in kv]) if source_of else None
    inferred = table[folder] if table is not None else F.when(F.contains("rel", F.lit("/")), folder)
    df = texts.join(side_files(spark, root), "rel", "left")
    source = F.coalesce(F.nullif(F.col("side.source"), F.lit("")), inferred)
    date = F.coalesce(F.nullif(F.col("side.date"), F.lit("")), F.lit("1900"))
    return df.select(
        T.document_id(F.col("rel"), T.slug(F.coalesce(source, F.lit("document")))).alias("doc_id"),
        F.col("rel").alias("file_path"),
        source.alias("source"),
        date.alias("doc_date"),
        F.coalesce(F.nullif(F.col("side.title"), F.lit("")), F.concat_ws(" — ", source, date)).alias("title"),
        F.coalesce(F.nullif(F.col("side.category"), F.lit("")), F.lit("non_categorise")).alias("category"),
        F.coalesce(F.nullif(F.col("side.language"), F.lit("")), T.script_language(F.col("text"))).alias("language"),
        F.col("method").alias("extraction_method"),
        "text",
        F.length("text").alias("char_count_raw"),
        T.word_count(F.col("text")).alias("word_count_raw"),
        F.coalesce("error", F.when(source.isNull(), F.lit("no source"))).alias("error"),
    )


def json_lines(spark: SparkSession, path: str, schema: t.StructType) -> DataFrame:
    """Strict JSON lines: blank lines skipped, a broken one stops the read. Keys beyond the schema stay in ``extra``."""
    raw = spark.read.text(path).where(F.trim("value") != "")
    parsed = raw.select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("x"), F.from_json("value", "map<string,string>").alias("m"))
    core = F.array(*[F.lit(f.name) for f in schema.fields])
    return parsed.select("x.*", F.map_filter("m", lambda k, _: ~F.array_contains(core, k)).alias("extra"))


def corpus(metadata: DataFrame, texts: DataFrame) -> DataFrame:
    """Metadata with texts by path; stops on a repeated doc_id, a path outside the corpus or a missing or empty text."""
    repeated = metadata.groupBy("doc_id").agg(F.count("*").alias("_copies"))
    j = metadata.join(texts, "file_path", "left").join(repeated, "doc_id")
    wrong = (
        F.when(F.col("_copies") > 1, F.concat(F.lit("repeated doc_id: "), "doc_id"))
        .when(F.col("file_path").rlike(r"(?:^/|(?:^|/)\.\.(?:/|$))"), F.concat(F.lit("path outside the corpus: "), "file_path"))
        .when(F.trim(F.coalesce("text", F.lit(""))) == "", F.concat(F.lit("no text: "), "file_path"))
    )
    return j.where(F.when(wrong.isNotNull(), F.raise_error(wrong).isNull()).otherwise(True)).drop("_copies")


def annotated(spark: SparkSession, path: str) -> DataFrame:
    """Fine-tuning examples with whether each is valid."""
    schema = t.StructType([t.StructField("question", t.StringType()), t.StructField("answer", t.StringType()), t.StructField("context", t.ArrayType(t.StringType())), t.StructField("source_doc_ids", t.ArrayType(t.StringType())), t.StructField("language", t.StringType())])
    df = json_lines(spark, path, schema)
    return df.withColumn("valid", (F.trim(F.coalesce("question", F.lit(""))) != "") & (F.trim(F.coalesce("answer", F.lit(""))) != "") & F.coalesce(F.size("source_doc_ids") > 0, F.lit(False)) & F.coalesce(F.col("language").isin("fr", "ar"), F.lit(False)))


class DropZone:
    """Connector that hands over the files of one folder, in order, up to a limit."""

    def __init__(self, root: str) -> None:
        self.root = root

    def fetch(self, spark: SparkSession, limit: int | None = None, **readers: Extractor) -> DataFrame:
        files = in_path_order(discover(spark, self.root, recursive=False))
        return extract(files if limit is None else files.limit(limit), **readers).where("error is null and trim(text) <> ''")


CONNECTORS: dict[str, type] = {"drop": DropZone}


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is something at the path, on whatever file system it names."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def append_new(spark: SparkSession, rows: DataFrame, path: str, key: str) -> int:
    """Appends rows whose key the table at ``path`` lacks; the number appended."""
    if exists(spark, path):
        rows = rows.join(spark.read.parquet(path).select(key), key, "left_anti")
    rows = rows.persist()
    n = rows.count()
    if n:
        rows.write.mode("append").parquet(path)
    rows.unpersist()
    return n


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file, on whatever file system the path names."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(target, True)
    try:
        out.write(bytearray(text.encode("utf-8")))
    finally:
        out.close()


def remove(spark: SparkSession, path: str) -> None:
    """Removes a file or folder, if it is there."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def write_report(spark: SparkSession, report: dict, path: str) -> None:
    """One report as JSON; reports are a few rows."""
    write_text(spark, path, json.dumps(report, ensure_ascii=False, indent=2, sort_keys=True))


def markdown_card(title: str, tables: dict[str, list[dict]]) -> str:
    """A profile as Markdown, one table for each part."""
    out = [f"# {title}"]
    for name, rows in tables.items():
        out.append(f"\n## {name}\n")
        if rows:
            head = list(rows[0])
            out += ["| " + " | ".join(head) + " |", "|" + " --- |" * len(head)]
            out += ["| " + " | ".join(str(r[c]) for c in head) + " |" for r in rows]
    return "\n".join(out)


def append_audit(rows: DataFrame, path: str) -> None:
    """Audit rows as JSON lines, one folder a day; null fields are left out."""
    rows.withColumn("day", F.to_date("ts")).write.mode("append").partitionBy("day").json(path)


def expire(spark: SparkSession, path: str, before: str) -> DataFrame:
    """Rows of a table by day that retention keeps; whole days are pruned, not filtered row by row."""
    return spark.read.json(path).where(F.col("day") >= F.lit(before).cast("date"))


def write_documents(docs: DataFrame, root: str) -> None:
    """Documents (doc_id, source, language, category, doc_date, text) as text files with side files, one folder a source; each task writes its own."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            for r in p.to_dict("records"):
                folder = pathlib.Path(root, r["source"])
                folder.mkdir(parents=True, exist_ok=True)
                (folder / f"{r['doc_id']}.txt").write_text(r["text"] or "", encoding="utf-8")
                side = {"title": r["doc_id"], "source": r["source"], "date": r["doc_date"], "category": r["category"], "language": r["language"]}
                (folder / f"{r['doc_id']}.txt{SIDE_SUFFIX}").write_text(json.dumps(side, ensure_ascii=False), encoding="utf-8")
            yield p[["doc_id"]]

    docs.select("doc_id", "source", "language", "category", "doc_date", "text").mapInPandas(run, "doc_id string").write.format("noop").mode("overwrite").save()


def synthetic_documents(spark: SparkSession, n: int) -> DataFrame:
    """(doc_id, source, language, category, doc_date, text) by rules of the row number."""
    i = F.col("id")
    pick = lambda values, k: F.element_at(F.array(*[F.lit(v) for v in values]), (k + 1).cast("int"))
    source = pick(("bulletin", "jurisprudence", "contrats"), i % 3)
    language = F.when(i % 4 == 3, "ar").otherwise("fr")
    text = F.when(language == "ar", F.concat(F.lit("المادة "), i.cast("string"), F.lit("\nنص تجريبي للوثيقة."))).otherwise(F.concat(F.lit("Article "), i.cast("string"), F.lit("\nTexte d'essai du document.")))
    return spark.range(n).select(
        F.concat_ws("-", source, F.lpad(i.cast("string"), 5, "0")).alias("doc_id"), source.alias("source"), language.alias("language"),
        pick(("travail", "foncier", "commercial", "rural", "procédure"), i % 5).alias("category"), F.concat(F.lit("20"), F.lpad((i % 24).cast("string"), 2, "0")).alias("doc_date"), text.alias("text"),
    )


def simulated_requests(spark: SparkSession, n: int, seed: int = 20260830) -> DataFrame:
    """(ts, route, status, seconds, cache_hit): traffic by seeded distributions."""
    r, s, c = F.rand(seed), F.rand(seed + 1), F.rand(seed + 2)
    return spark.range(n).select(
        F.timestamp_seconds(F.lit(1_767_225_600) + (F.col("id") / 5).cast("bigint")).alias("ts"),
        F.when(r < 0.7, "/chat").when(r < 0.9, "/documents").otherwise("/health").alias("route"),
        F.when(s < 0.005, 500).when(s < 0.02, 422).otherwise(200).alias("status"),
        F.greatest(F.lit(0.005), F.lit(0.8) + F.randn(seed + 3) * 0.3).alias("seconds"),
        (c < 0.4).alias("cache_hit"),
    )
