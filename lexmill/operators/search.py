"""Lexical and vector search, fusion, reranking."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DataType

from lexmill.functions import text as T

_WORDS = re.compile(r"[^ \t\r\n\f]+")
FILTER_FIELDS = ("doc_id", "source", "doc_date", "category", "language", "jurisdiction")


def check_filters(filters: dict[str, str]) -> None:
    """Only known fields may be filtered on."""
    for name in filters:
        if name not in FILTER_FIELDS:
            raise ValueError(f"unknown filter field: {name}")


def metadata_filter(df: DataFrame, filters: dict[str, str], open_map: str = "metadata") -> DataFrame:
    """Equality on each field, looked up in the open map where there is no such column."""
    check_filters(filters)
    conditions = [(F.col(k) if k in df.columns else F.col(open_map)[k]) == v for k, v in filters.items()]
    return df.where(reduce(lambda a, b: a & b, conditions)) if conditions else df


def postings(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, term, tf, length): term frequencies, with the partial counts made before the shuffle."""
    tokens = docs.select(key, T.lexical_tokens(F.col(text)).alias("t"))
    exploded = tokens.select(key, F.size("t").alias("length"), F.explode_outer("t").alias("term")).where("term is not null")
    return exploded.groupBy(key, "length", "term").agg(F.count("*").alias("tf"))


#: Terms of a stated query set that every task may hold; a larger set is joined instead.
MOST_TERMS = 10_000


def bm25(docs: DataFrame, key: str, text: str, questions: DataFrame, limit: int = 10, k1: float = 1.5, b: float = 0.75, keep: DataFrame | None = None, unique: bool = True) -> DataFrame:
    """(query_id, key, score, rank) of each question's best documents.

    ``questions`` holds query_id and question. Statistics are those of all documents, ``keep`` (keys)
    restricts what is ranked. Repeated terms of a question count repeatedly. Ties go to the smaller key.
    ``unique`` says that a key has one row; otherwise of the rows of a key the longest counts, chosen when only
    counts and hits are left of the texts.

    The terms asked for are a stated set of checked size, so tokens are filtered and counted inside each row,
    and no token stream is shuffled: one pass gives document frequencies and lengths, reduced before their
    shuffle to a row for each term, and a second pass scores. Each partition ranks its rows before the shuffle.
    """
    asked = questions.select("query_id", F.explode(T.lexical_tokens(F.col("question"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("q"))
    names = [r[0] for r in asked.select("term").distinct().limit(MOST_TERMS + 1).collect()]
    few = asked.limit(20 * MOST_TERMS + 1).count() <= 20 * MOST_TERMS
    tokens = docs.select(F.col(key), T.lexical_tokens(F.col(text)).alias("t"))
    if len(names) <= MOST_TERMS:
        rows = tokens.select(key, F.coalesce(F.size("t"), F.lit(0)).alias("length"), F.filter("t", lambda x: x.isin(names) if names else F.lit(False)).alias("hit"))
        hint = F.broadcast
    else:
        rows = tokens.select(key, F.coalesce(F.size("t"), F.lit(0)).alias("length"), F.col("t").alias("hit"))
        hint = lambda x: x
        few = False
    if not unique:
        rows = rows.groupBy(key).agg(F.max(F.struct("length", "hit")).alias("x")).select(key, "x.length", "x.hit")
    # explode_outer, as explode would have its array worked out a second time in a filter below it
    counted = rows.select("length", F.explode_outer(F.concat(F.array(F.lit("")), F.coalesce(F.array_distinct("hit"), F.array().cast("array<string>")))).alias("term"))
    sums = counted.groupBy("term").agg(F.count("*").alias("df"), F.sum(F.greatest("length", F.lit(0))).alias("total"))
    if hint is F.broadcast:
        # at most MOST_TERMS rows: gathered into one, so that the texts are read once for all statistics
        of_all = F.col("term") == ""
        one = sums.agg(F.max(F.when(of_all, F.col("df"))).alias("n"), F.max(F.when(of_all, F.col("total"))).alias("total"), F.collect_list(F.when(~of_all, F.struct("term", "df"))).alias("terms"))
        flat = one.select("n", "total", F.explode("terms").alias("x")).select("n", "total", "x.term", "x.df")
    else:
        of_all = sums.where("term = ''").select(F.col("df").alias("n"), "total")
        flat = sums.join(asked.select("term").distinct(), "term", "left_semi").select("term", "df").join(F.broadcast(of_all))
    weights = asked.join(flat, "term").withColumn("average", F.when(F.col("total") > 0, F.col("total") / F.col("n")).otherwise(1.0))
    weights = weights.select("query_id", "term", "average", (F.col("q") * F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))).alias("weight"))
    pairs = F.transform(F.array_distinct("hit"), lambda d: F.struct(d.alias("term"), F.size(F.filter("hit", lambda x: x == d)).alias("tf")))
    tf = rows.select(key, "length", F.explode_outer(pairs).alias("x")).where("x is not null").select(key, "length", "x.term", "x.tf")
    if hint is not F.broadcast:
        tf = rows.select(key, "length", F.explode("hit").alias("term")).groupBy(key, "length", "term").agg(F.count("*").alias("tf")).join(asked.select("term").distinct(), "term", "left_semi")
    if keep is not None:
        tf = tf.join(keep.select(key).distinct(), key, "left_semi")
    part = F.col("weight") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / F.col("average")))
    total = tf.join(F.broadcast(weights) if few else weights, "term").groupBy("query_id", key).agg(F.round(F.sum(part), 6).alias("score")).where("score > 0")
    return ranked(total, "query_id", key, limit)


def ranked(df: DataFrame, group: str, key: str, limit: int, score: str = "score") -> DataFrame:
    """Best ``limit`` rows of each group; Spark cuts each partition before the shuffle (WindowGroupLimit)."""
    w = Window.partitionBy(group).orderBy(F.col(score).desc(), F.col(key))
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    n = F.sqrt(dot(a, a))
    return F.when(n == 0, 1.0).otherwise(n)


#: Stated queries that the driver gathers, and a task multiplies with, at a time.
QUERIES_A_BLOCK = 4096


def cosine_topk(vectors: DataFrame, key: str, vector: str, queries: DataFrame, limit: int = 8, least: float | None = None) -> DataFrame:
    """(query_id, key, score, rank): exact cosine of every stated query against every vector.

    The stated queries (query_id, query_vector) reach the tasks in blocks of QUERIES_A_BLOCK. A task multiplies
    each Arrow batch of its vectors with each block and keeps the best ``limit`` of each query, so vectors are
    neither shuffled nor paired row by row. Null vectors and those of another length are left out; a zero vector scores 0.
    """
    blocks = _blocks_of(queries)
    kinds = dict(vectors.dtypes) | dict(queries.dtypes)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        for batch in batches:
            keys = np.array(batch.column(0).to_pylist())
            rows = batch.column(1).to_pylist()
            for at, block in enumerate(blocks):
                ids, matrix = block.value
                fits = [k for k, v in enumerate(rows) if v is not None and len(v) == matrix.shape[1]]
                if not fits or not len(ids):
                    continue
                own = np.array([rows[k] for k in fits], np.float64)
                norm = np.sqrt((own * own).sum(axis=1))
                scores = np.round((own / np.where(norm == 0, 1.0, norm)[:, None]) @ matrix.T, 6) + 0.0
                names = keys[fits]
                if at in best:
                    kept_keys, kept_scores = best[at]
                    all_keys, all_scores = np.concatenate((kept_keys, np.repeat(names[:, None], len(ids), axis=1))), np.concatenate((kept_scores, scores))
                else:
                    all_keys, all_scores = np.repeat(names[:, None], len(ids), axis=1), scores
                if least is not None:
                    all_scores = np.where(all_scores >= least, all_scores, -np.inf)
                order = np.stack([np.lexsort((all_keys[:, q], -all_scores[:, q]))[:limit] for q in range(len(ids))], axis=1)
                best[at] = np.take_along_axis(all_keys, order, axis=0), np.take_along_axis(all_scores, order, axis=0)
        for at, (k, x) in best.items():
            ids = blocks[at].value[0]
            q = np.repeat(np.array(ids, dtype=object)[None, :], k.shape[0], axis=0).ravel()
            good = np.isfinite(x.ravel())
            yield pa.RecordBatch.from_pylist([{"query_id": i, key: j, "score": float(v)} for i, j, v in zip(q[good].tolist(), k.ravel()[good].tolist(), x.ravel()[good].tolist(), strict=True)], schema=schema) if good.any() else pa.RecordBatch.from_pylist([], schema=schema)

    ddl = f"query_id {kinds['query_id']}, {key} {kinds[key]}, score double"
    schema = to_arrow_schema(DataType.fromDDL(ddl))
    return ranked(vectors.select(key, vector).mapInArrow(run, ddl), "query_id", key, limit)


def _blocks_of(queries: DataFrame) -> list:
    """The stated queries as broadcast blocks of (identifiers, unit vectors); lengths are not mixed in a block."""
    sc = queries.sparkSession.sparkContext
    out = []
    sizes = [r[0] for r in queries.where("query_vector is not null").select(F.size("query_vector").alias("n")).distinct().collect()]
    for n in sizes:
        own = queries.where(F.size("query_vector") == n)
        many = max(1, -(-own.count() // QUERIES_A_BLOCK))
        for k in range(many):
            rows = own.where(F.pmod(F.xxhash64("query_id"), F.lit(many)) == k).select("query_id", "query_vector").collect()
            m = np.array([r[1] for r in rows], np.float64).reshape(len(rows), n)
            norm = np.sqrt((m * m).sum(axis=1))
            out.append(sc.broadcast(([r[0] for r in rows], m / np.where(norm == 0, 1.0, norm)[:, None])))
    return out


@dataclass(frozen=True)
class Cells:
    """An approximate index: centres fitted on a bounded sample; every vector is in the cell of its nearest centre."""

    centres: np.ndarray

    def nearest(self, vectors: np.ndarray, many: int = 1) -> np.ndarray:
        """The nearest ``many`` cells of each vector."""
        norm = np.sqrt((vectors * vectors).sum(axis=1))
        close = (vectors / np.where(norm == 0, 1.0, norm)[:, None]) @ self.centres.T
        return np.argsort(-close, axis=1, kind="stable")[:, :many]


#: Vectors that the centres of an approximate index are fitted on.
CELL_SAMPLE = 20_000


def fit_cells(vectors: DataFrame, key: str, vector: str, cells: int = 16, turns: int = 12) -> Cells:
    """Centres by spherical k-means on the CELL_SAMPLE vectors whose keys hash lowest; the index itself holds all vectors."""
    rows = vectors.where(F.col(vector).isNotNull()).select(vector, F.xxhash64(key).alias("h")).orderBy("h").limit(CELL_SAMPLE).collect()
    x = np.array([r[0] for r in rows], np.float64)
    if not len(x):
        return Cells(np.zeros((1, 1)))
    norm = np.sqrt((x * x).sum(axis=1))
    x = x / np.where(norm == 0, 1.0, norm)[:, None]
    centres = x[np.linspace(0, len(x) - 1, min(cells, len(x))).astype(int)].copy()
    for _ in range(turns):
        at = np.argmax(x @ centres.T, axis=1)
        for k in range(len(centres)):
            if (at == k).any():
                c = x[at == k].sum(axis=0)
                centres[k] = c / (np.sqrt((c * c).sum()) or 1.0)
    return Cells(centres)


def with_cell(vectors: DataFrame, vector: str, index: Cells, probes: int = 1) -> DataFrame:
    """``vectors`` with cells: the nearest ``probes`` cells, in their order."""

    @F.pandas_udf("array<int>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            yield pd.Series([index.nearest(np.array([v], np.float64), probes)[0].tolist() if v is not None and len(v) == index.centres.shape[1] else None for v in s])

    return vectors.withColumn("cells", run(F.col(vector)))


def approximate_topk(vectors: DataFrame, key: str, vector: str, queries: DataFrame, index: Cells, probes: int = 6, limit: int = 8) -> DataFrame:
    """(query_id, key, score, rank) among the vectors in the ``probes`` nearest cells of each query.

    Both sides meet by cell; a hot cell is spread over SALT parts, to each of which its queries are sent. Exact search
    (cosine_topk) stays the default: this one finds most of the best, as measured by recall_at_k.
    """
    base = with_cell(vectors.select(key, F.col(vector).alias("_v")), "_v", index).where("cells is not null").select(key, "_v", F.element_at("cells", 1).alias("_cell"), F.pmod(F.xxhash64(key), F.lit(SALT)).cast("int").alias("_salt"))
    asked = with_cell(queries.select("query_id", F.col("query_vector").alias("_q")), "_q", index, probes).select("query_id", "_q", F.explode("cells").alias("_cell"), F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("_salt"))
    pairs = base.join(asked, ["_cell", "_salt"])
    scored = pairs.select("query_id", key, F.round(dot(F.col("_v"), F.col("_q")) / (norm(F.col("_v")) * norm(F.col("_q"))), 6).alias("score"))
    return ranked(scored, "query_id", key, limit)


#: Parts that each cell of an approximate index is spread over.
SALT = 4


def embedded(docs: DataFrame, key: str, text: str, embed: Callable[[list[str]], Sequence[Sequence[float]]], dims: int, batch: int = 64) -> DataFrame:
    """(key, embedding): texts through an injected model, in batches; a vector of another length than ``dims`` stops the job. Null texts count as empty."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            for k in range(0, len(p), batch):
                own = p.iloc[k : k + batch]
                out = [[float(x) for x in v] for v in embed([x or "" for x in own[text]])]
                if len(out) != len(own) or any(len(v) != dims for v in out):
                    raise ValueError(f"the model must give one vector of {dims} numbers for each text")
                yield pd.DataFrame({key: own[key].tolist(), "embedding": out})

    return docs.select(key, text).mapInPandas(run, f"{key} {dict(docs.dtypes)[key]}, embedding array<double>")


def pairwise_rerank(candidates: DataFrame, question: str, text: str, key: str, score: Callable[[list[tuple[str, str]]], Sequence[float]], limit: int) -> DataFrame:
    """Candidates ordered by an injected model's score of each (question, text), in Arrow batches."""

    @F.pandas_udf("double")
    def run(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for q, t in parts:
            yield pd.Series([float(x) for x in score(list(zip(q.fillna(""), t.fillna(""), strict=True)))])

    return ranked(candidates.drop("rank", "score").withColumn("score", run(F.col(question), F.col(text))), "query_id", key, limit)


def embed_words(text: str | None, dims: int) -> list[float]:
    """Bytes of the SHA-256 of each word in lower case, as numbers from -1 to 1, summed and brought to length one."""
    total = np.zeros(32)
    for w in _WORDS.findall((text or "").lower()):
        total += np.frombuffer(hashlib.sha256(w.encode()).digest(), np.uint8) / 127.5 - 1.0
    v = np.resize(total, dims)
    n = float(np.sqrt((v * v).sum()))
    return (v / (n or 1.0)).tolist()


def hash_embedding(text: Column, dims: int = 32) -> Column:
    """Deterministic vector of a text, in Arrow batches: as nested array functions it would be worked out again for each component."""

    @F.pandas_udf("array<double>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            yield pd.Series([embed_words(x, dims) for x in s])

    return run(text)


def upsert(table: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Last write wins: rows of ``changes`` (later rows by _version) replace those of ``table``."""
    fresh = changes.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(F.col("_version").desc()))).where("_n = 1").drop("_n", "_version")
    return table.join(fresh.select(key), key, "left_anti").unionByName(fresh)


def delete_documents(table: DataFrame, keys: DataFrame, key: str = "doc_id") -> DataFrame:
    return table.join(keys.select(key).distinct(), key, "left_anti")


def reciprocal_rank_fusion(rankings: dict[str, tuple[DataFrame, float]], key: str, limit: int = 8, constant: int = 60) -> DataFrame:
    """(query_id, key, score, methods, rank) from rankings (query_id, key, rank) with weights; weight 0 leaves one out."""
    parts = [df.select("query_id", key, (F.lit(w) / (constant + F.col("rank"))).alias("part"), F.lit(name).alias("method")) for name, (df, w) in rankings.items() if w > 0]
    if not parts:
        raise ValueError("no ranking has a positive weight")
    union = reduce(DataFrame.unionByName, parts)
    fused = union.groupBy("query_id", key).agg(F.round(F.sum("part"), 8).alias("score"), F.array_join(F.array_sort(F.collect_set("method")), "+").alias("methods"))
    return ranked(fused, "query_id", key, limit)


def overlap_rerank(candidates: DataFrame, question: str, text: str, key: str, limit: int) -> DataFrame:
    """Candidates ordered by the number of different tokens that they share with the question."""
    score = F.size(F.array_intersect(F.array_distinct(T.lexical_tokens(F.col(question))), F.array_distinct(T.lexical_tokens(F.col(text)))))
    return ranked(candidates.drop("rank", "score").withColumn("score", score), "query_id", key, limit)


def recall_at_k(returned: DataFrame, relevant: DataFrame, key: str, k: int) -> DataFrame:
    """(query_id, recall): share of the relevant keys (query_id, relevant array) among the first k returned."""
    got = returned.where(F.col("rank") <= k).groupBy("query_id").agg(F.collect_set(key).alias("got"))
    joined = relevant.join(got, "query_id", "left")
    return joined.select("query_id", F.round(F.coalesce(F.size(F.array_intersect("relevant", "got")), F.lit(0)) / F.size(F.array_distinct("relevant")), 6).alias("recall"))


def latency_summary(df: DataFrame, value: str) -> DataFrame:
    """n, min, mean, p50 (median) and p95 by nearest rank.

    Exact, so a count is kept for each distinct value: meant for the runs of an evaluation. Live traffic goes
    through monitoring.histogram and histogram_quantile, whose state is a few buckets.
    """
    v = F.col(value)
    return df.agg(
        F.count(v).alias("n"), F.min(v).alias("min"), F.round(F.avg(v), 6).alias("mean"), F.round(F.median(v), 6).alias("p50"), F.expr(f"percentile_disc(0.95) within group (order by {value})").alias("p95")
    )


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; of two empty ones 1."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def payload(df: DataFrame, fields: list[str], open_map: str = "metadata") -> Column:
    """One map of a row's fields and its open map; the row's own fields win over keys of the same name."""
    own = F.map_from_arrays(F.array(*[F.lit(f) for f in fields]), F.array(*[F.col(f).cast("string") for f in fields]))
    rest = F.map_filter(F.coalesce(F.col(open_map), F.create_map().cast("map<string,string>")), lambda k, _: ~F.array_contains(F.array(*[F.lit(f) for f in fields]), k))
    return F.map_concat(rest, own)


def unpacked(payload_map: Column, fields: list[str]) -> tuple[dict[str, Column], Column]:
    """The fields of a payload, and the map of all other keys."""
    return {f: payload_map[f] for f in fields}, F.map_filter(payload_map, lambda k, _: ~F.array_contains(F.array(*[F.lit(f) for f in fields]), k))


class Index:
    """Postings, lengths and vectors of a corpus as tables in one folder, written once and read by every retrieval.

    Postings lie in BUCKETS folders by the hash of the term, so that a question reads those of its terms only.
    """

    BUCKETS = 64

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    @classmethod
    def build(cls, docs: DataFrame, key: str, text: str, path: str, embed: Callable[[Column], Column] | None = None) -> Index:
        """Writes the index of ``docs``; of the rows of a key the longest counts. Text is tokenised and embedded once."""
        tokens = docs.select(F.col(key).alias("key"), T.lexical_tokens(F.coalesce(F.col(text), F.lit(""))).alias("t"))
        counted = tokens.select("key", F.size("t").alias("length"), F.explode_outer("t").alias("term")).groupBy("key", "length", "term").agg(F.count("*").alias("tf"))
        longest = tokens.groupBy("key").agg(F.max(F.size("t")).alias("length"))
        root = path.rstrip("/")
        longest.write.parquet(f"{root}/lengths")
        bucket = F.pmod(F.xxhash64("term"), F.lit(cls.BUCKETS)).cast("int")
        lengths = docs.sparkSession.read.parquet(f"{root}/lengths")
        counted.where("term is not null").join(lengths, ["key", "length"]).withColumn("bucket", bucket).repartition("bucket").write.partitionBy("bucket").parquet(f"{root}/postings")
        vector = embed(F.col(text)) if embed else hash_embedding(F.col(text), 32)
        docs.select(F.col(key).alias("key"), F.length(F.coalesce(F.col(text), F.lit(""))).alias("n"), vector.alias("embedding")).groupBy("key").agg(F.max(F.struct("n", "embedding"))["embedding"].alias("embedding")).write.parquet(f"{root}/vectors")
        return cls(docs.sparkSession, root)

    def lexical(self, questions: DataFrame, limit: int = 24, k1: float = 1.5, b: float = 0.75) -> DataFrame:
        """BM25 from the postings of the questions' terms."""
        asked = questions.select("query_id", F.explode(T.lexical_tokens(F.col("question"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("q"))
        names = [r[0] for r in asked.select("term").distinct().limit(MOST_TERMS + 1).collect()]
        rows = self.spark.read.parquet(f"{self.path}/postings")
        if len(names) <= MOST_TERMS:
            wanted = [r[0] for r in self.spark.createDataFrame([(x,) for x in names] or [("",)], "term string").select(F.pmod(F.xxhash64("term"), F.lit(self.BUCKETS)).cast("int")).distinct().collect()]
            rows = rows.where(F.col("bucket").isin(wanted) & F.col("term").isin(names))
        stats = self.spark.read.parquet(f"{self.path}/lengths").agg(F.count("*").alias("n"), F.sum("length").alias("total"))
        df = rows.groupBy("term").agg(F.count("*").alias("df"))
        weights = asked.join(df, "term").join(F.broadcast(stats)).select("query_id", "term", F.greatest(F.col("total") / F.col("n"), F.lit(1e-9)).alias("average"), (F.col("q") * F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))).alias("weight"))
        part = F.col("weight") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / F.col("average")))
        total = rows.join(weights, "term").groupBy("query_id", "key").agg(F.round(F.sum(part), 6).alias("score")).where("score > 0")
        return ranked(total, "query_id", "key", limit)

    def dense(self, queries: DataFrame, limit: int = 24) -> DataFrame:
        return cosine_topk(self.spark.read.parquet(f"{self.path}/vectors"), "key", "embedding", queries, limit)

    def retrieve(self, questions: DataFrame, top_k: int = 8, candidates: int = 24, embed: Callable[[Column], Column] | None = None, rerank: Callable[[DataFrame, int], DataFrame] | None = None) -> DataFrame:
        """(query_id, key, score, methods, rank): lexical and dense candidates fused by rank, reranked if asked for; ``top_k`` 0 means 8."""
        vector = embed(F.col("question")) if embed else hash_embedding(F.col("question"), 32)
        asked = questions.select("query_id", vector.alias("query_vector"))
        fused = reciprocal_rank_fusion({"dense": (self.dense(asked, candidates), 1.0), "lexical": (self.lexical(questions, candidates), 1.0)}, "key", candidates if rerank else top_k or 8)
        return rerank(fused, top_k or 8) if rerank else fused
