"""Problem 7: how many tokens chunks and documents have, by regressions per language that tokenised holdouts correct.

A bounded sample of chunks is tokenised. Least squares per language predict the tokens from bytes, words,
digits, punctuation and letters by script on half of it; a quarter corrects the bias, and the last quarter,
which neither has seen, gives the errors that are reported. The prediction is applied everywhere.
"""

from __future__ import annotations

import base64
import functools
import os
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm.text import arrow_map, count_tokens

#: Rows of the sample that the regression is fitted, corrected and measured on.
SAMPLE = 3000
#: Fewer rows of a language than this are fitted with all languages together.
LEAST = 40
FEATURES = ("words", "bytes", "digits", "punctuation", "latin", "arabic")
#: Folder of the public tokenizers' files, read by the driver only.
TOKENIZERS = os.environ.get("LEXMILL_TOKENIZERS", "/opt/tokenizers")
VOCABULARY = "byte_bpe_multi_50k.tiktoken"

# classes of UTF-8 bytes: digit, punctuation, Latin letter (or the lead byte of one), lead byte of an Arabic letter
_CLASS = np.zeros(256, np.uint8)
_CLASS[48:58] = 1
for _c in b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~":
    _CLASS[_c] = 2
_CLASS[65:91] = _CLASS[97:123] = 3
_CLASS[0xC3:0xC5] = 3
_CLASS[0xD8:0xDC] = 4


# Bytes of words: digits, letters, all bytes of characters beyond ASCII.
_INNER = np.isin(_CLASS, (1, 3, 4)) | (np.arange(256) >= 128)


def features(text: str) -> list[float]:
    """The values that FEATURES names. Words are runs of letters and digits, which tokens of neither kind are."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    n = np.bincount(_CLASS[raw], minlength=5)
    inside = _INNER[raw]
    words = int(np.count_nonzero(inside[1:] & ~inside[:-1])) + int(inside[0]) if len(raw) else 0
    return [words, len(raw), *n[1:5].tolist()]


def bucket(language: str | None) -> str:
    """fr, ar, en, es, or other: the language that a label names."""
    x = (language or "").strip().lower()
    return x[:2] if x[:2] in ("fr", "ar", "en", "es") and (len(x) == 2 or x[2] in "-_") else "other"


def words_of(text: str) -> int:
    """The project's own tokenizer."""
    return count_tokens(text)


_PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class BytePairs:
    """Counts byte pairs of a public tokenizer, whose vocabulary travels with it to the tasks."""

    def __init__(self, ranks: bytes) -> None:
        self.ranks = ranks

    def __reduce__(self):
        return BytePairs, (self.ranks,)

    @functools.cached_property
    def encode(self) -> Callable[[str], list[int]]:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, self.ranks.splitlines())}
        return tiktoken.Encoding("own", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def __call__(self, text: str) -> int:
        return len(self.encode(text))


def byte_pairs(path: str | None = None) -> BytePairs:
    """The counter of the public multilingual vocabulary, or of the one in the file ``path``; fails where that is absent."""
    with open(path or os.path.join(TOKENIZERS, VOCABULARY), "rb") as f:
        return BytePairs(f.read())


Fit = dict[str, tuple[list[float], dict[str, float]]]


def fit(rows: list[tuple[str | None, str]], tokens: Callable[[str], int]) -> Fit:
    """Coefficients and errors (rows, bias before its correction, mape, largest), for each language and for all ('')."""
    x = np.array([features(t) for _, t in rows], float).reshape(len(rows), len(FEATURES))
    y = np.array([tokens(t) for _, t in rows], float)
    langs = np.array([bucket(a) for a, _ in rows], dtype=object)
    model: Fit = {}
    for lang in ("", "fr", "ar", "en", "es", "other"):
        own = np.flatnonzero(langs == lang) if lang else np.arange(len(rows))
        if len(own) < (LEAST if lang else 1):
            continue
        train, hold, test = own[::2], own[1::4], own[3::4]
        scale = np.maximum(x[train].max(axis=0), 1)
        w = np.linalg.lstsq(x[train] / scale, y[train], rcond=None)[0] / scale
        bias = 1.0
        if len(hold) and (x[hold] @ w).sum() > 0:
            bias = y[hold].sum() / (x[hold] @ w).sum()
            w = w * bias
        off = x[test] @ w - y[test]
        errors = {"rows": float(len(own)), "bias": round(float(bias - 1), 6), "mape": round(float(np.mean(np.abs(off) / np.maximum(y[test], 1))), 6) if len(test) else float("nan"), "total": round(float(off.sum() / max(y[test].sum(), 1)), 6) if len(test) else float("nan"), "largest": float(np.abs(off).max(initial=0.0)) if len(test) else float("inf")}
        model[lang] = (w.tolist(), errors)
    return model


def estimate(model: Fit, language: str | None, text: str) -> float:
    w, _ = model.get(bucket(language)) or model.get("") or ([0.0] * len(FEATURES), {})
    return max(0.0, float(np.dot(w, features(text))))


def _columns(chunks: DataFrame) -> DataFrame:
    names = {"chunk_id": "string", "text": "string", "token_count": "int", "source": "string", "language": "string", "category": "string"}
    return chunks.select(*[F.col(k).cast(t).alias(k) for k, t in names.items()])


def model_for(chunks: DataFrame, tokens: Callable[[str], int]) -> Fit:
    """Fits on the SAMPLE chunks whose identifiers hash lowest. The sample is bounded, the model a few numbers."""
    own = _columns(chunks).where("text is not null")
    few = own.select("chunk_id", F.xxhash64("chunk_id", F.lit(7)).alias("h")).orderBy("h", "chunk_id").limit(SAMPLE)
    rows = own.select("chunk_id", "language", "text").join(F.broadcast(few.select("chunk_id").distinct()), "chunk_id", "left_semi").limit(2 * SAMPLE).collect()
    return fit([(r["language"], r["text"]) for r in sorted(rows, key=lambda r: (r["chunk_id"] or "", r["text"]))], tokens)


def found(chunks: DataFrame) -> DataFrame:
    """(chunk_id): chunks whose recorded count is null or not the number of tokens of the text.

    Each row gets the regression's estimate, which says how many tokens to expect and how far that may be off.
    No estimate can tell a count from its neighbour, so an exact count follows for every row and decides.
    A null text has 0 tokens. Repeated rows come out once; a null chunk_id comes out as null once.
    """
    rows = counted(chunks, model_for(chunks, words_of), words_of)
    return rows.where("token_count is null OR token_count <> tokens").select("chunk_id").distinct()


def counted(chunks: DataFrame, model: Fit, tokens: Callable[[str], int]) -> DataFrame:
    """(chunk_id, token_count, estimate, far, tokens): each row's estimate, whether the record is further from it than the holdout's largest error, and the exact count."""

    def check(cols: dict[str, list]) -> dict[str, list]:
        said = [estimate(model, lang, t or "") for t, lang in zip(cols["text"], cols["language"], strict=True)]
        far = [n is None or abs(n - e) > (model.get(bucket(lang)) or model[""])[1]["largest"] for n, e, lang in zip(cols["token_count"], said, cols["language"], strict=True)]
        return {"chunk_id": cols["chunk_id"], "token_count": cols["token_count"], "estimate": said, "far": far, "tokens": [tokens(t) if t else 0 for t in cols["text"]]}

    types = {"chunk_id": pa.string(), "token_count": pa.int32(), "estimate": pa.float64(), "far": pa.bool_(), "tokens": pa.int64()}
    if not model:
        model = {"": ([0.0] * len(FEATURES), {"largest": float("inf")})}
    return arrow_map(_columns(chunks).select("chunk_id", "text", "token_count", "language"), check, "chunk_id string, token_count int, estimate double, far boolean, tokens bigint", types, rows=2048)


def totals(chunks: DataFrame, documents: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """(source, language, category, chunks, tokens, est_tokens, documents, document_tokens, est_document_tokens): each distinct chunk and document once.

    ``tokens`` are the project's tokens, exact; ``est_tokens`` those of the public tokenizer in the file
    ``tokenizer``, by regression. Languages are the two-letter code that a label names, or other. A chunk is
    distinct by identifier and text, a document by identifier; of repeated rows the greatest labels count.
    """
    model = model_for(chunks, byte_pairs(tokenizer))

    def apply(cols: dict[str, list]) -> dict[str, list]:
        texts = [t or "" for t in cols["text"]]
        return {k: cols[k] for k in ("kind", "key", "source", "category")} | {"language": [bucket(x) for x in cols["language"]], "hash": cols["hash"], "tokens": [count_tokens(t) for t in texts], "est": [estimate(model, x, t) for x, t in zip(cols["language"], texts, strict=True)]}

    text = F.col("text").cast("string")
    own = chunks.select(F.lit("chunk").alias("kind"), F.col("chunk_id").cast("string").alias("key"), F.xxhash64(text).alias("hash"), text.alias("text"), *[F.col(c).cast("string").alias(c) for c in ("source", "language", "category")])
    docs = documents.select(F.lit("document").alias("kind"), F.col("doc_id").cast("string").alias("key"), F.lit(0).cast("bigint").alias("hash"), text.alias("text"), F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("language"), F.col("category").cast("string").alias("category"))
    types = {"kind": pa.string(), "key": pa.string(), "source": pa.string(), "category": pa.string(), "language": pa.string(), "hash": pa.int64(), "tokens": pa.int64(), "est": pa.float64()}
    rows = arrow_map(own.unionByName(docs), apply, "kind string, key string, source string, category string, language string, hash bigint, tokens bigint, est double", types, rows=2048)
    one = rows.groupBy("kind", "key", "hash").agg(F.max(F.struct("source", "language", "category", "tokens", "est")).alias("x")).select("kind", "x.*")
    of = lambda kind, c: F.coalesce(F.sum(F.when(F.col("kind") == kind, c)), F.lit(0)).cast("bigint")
    return one.groupBy("source", "language", "category").agg(
        of("chunk", F.lit(1)).alias("chunks"), of("chunk", F.col("tokens")).alias("tokens"), of("chunk", F.round("est")).alias("est_tokens"),
        of("document", F.lit(1)).alias("documents"), of("document", F.col("tokens")).alias("document_tokens"), of("document", F.round("est")).alias("est_document_tokens"),
    )


def errors(chunks: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """(tokenizer, language, rows, bias, mape, total, largest): the regressions' errors on holdouts that they were not fitted on; language '' is all together."""
    out = []
    for name, count in (("words", words_of), ("byte pairs", byte_pairs(tokenizer))):
        out += [(name, lang, *(e[k] for k in ("rows", "bias", "mape", "total", "largest"))) for lang, (_, e) in model_for(chunks, count).items()]
    return chunks.sparkSession.createDataFrame(out, "tokenizer string, language string, rows double, bias double, mape double, total double, largest double")


SQL_FOUND = """
SELECT DISTINCT chunk_id FROM chunks
WHERE token_count IS NULL OR token_count <> coalesce(length(list_filter(string_split_regex(text, '[ \\t\\n\\r\\f]+'), lambda x: x <> '')), 0)
"""

_LANGUAGE = "CASE WHEN regexp_matches(lower(trim({0})), '^(fr|ar|en|es)($|[-_])') THEN substr(lower(trim({0})), 1, 2) ELSE 'other' END"
SQL_COUNT = "coalesce(length(list_filter(string_split_regex(text, '[ \\t\\n\\r\\f]+'), lambda x: x <> '')), 0)"
SQL_EXACT = f"""
WITH c AS (SELECT chunk_id, text, max(struct_pack(source := source, language := {_LANGUAGE.format("language")}, category := category)) AS x FROM chunks GROUP BY chunk_id, text),
d AS (SELECT source, {_LANGUAGE.format("lang")} AS language, category, text FROM documents),
u AS (SELECT x.source AS source, x.language AS language, x.category AS category, 1 AS c, {SQL_COUNT} AS n, 0 AS d, 0 AS m FROM c UNION ALL SELECT source, language, category, 0, 0, 1, {SQL_COUNT} FROM d)
SELECT source, language, category, CAST(sum(c) AS BIGINT) AS chunks, CAST(sum(n) AS BIGINT) AS tokens, CAST(sum(d) AS BIGINT) AS documents, CAST(sum(m) AS BIGINT) AS document_tokens FROM u GROUP BY source, language, category
"""
