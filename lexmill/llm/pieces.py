"""Problem 5: chunks over the limit, cut at natural boundaries by content.

A rolling hash over the last tokens marks a landmark in each stretch where a piece may end, and the cut
snaps to the nearest boundary of the strongest kind there: heading, paragraph, sentence, else the landmark
itself. Both depend on nearby text only, so an edit moves the cuts of neighbouring pieces and no others.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm.text import arrow_map, hash64

LIMIT = 512
OVERLAP = 64
#: New tokens that a piece has at least, unless it is the last.
LEAST = 160
#: Tokens under the rolling hash.
ROLL = 8
NONE, SENTENCE, PARAGRAPH, HEADING = 0, 1, 2, 3
KINDS = ("token", "sentence", "paragraph", "heading")

_TOKEN = re.compile(r"[^ \t\n\r\f]+")
_HEADING = re.compile(r"(?:Article|Section|Chapitre|Titre|Alin[ée]a|Art\.|Chapter|Clause|Art[ií]culo|Cap[ií]tulo|Sección|المادة|الفصل|الباب|الفقرة|القسم|الفرع)\s+\S", re.IGNORECASE)
_ENDS = re.compile(r"[.!?؟…۔][\"'»”)\]]*$")
_MULT = np.uint64(0x9E3779B97F4A7C15)


def boundaries(text: str, spans: list[tuple[int, int]]) -> np.ndarray:
    """The kind of boundary before each token."""
    kinds = np.zeros(len(spans), np.int8)
    for k in range(1, len(spans)):
        gap = text[spans[k - 1][1] : spans[k][0]]
        if "\n" in gap:
            kinds[k] = HEADING if _HEADING.match(text, spans[k][0]) else PARAGRAPH if gap.count("\n") > 1 or _ENDS.search(text[max(spans[k - 1][0], spans[k - 1][1] - 6) : spans[k - 1][1]]) else NONE
        if not kinds[k] and _ENDS.search(text[max(spans[k - 1][0], spans[k - 1][1] - 6) : spans[k - 1][1]]):
            kinds[k] = SENTENCE
    return kinds


def rolling(tokens: list[str]) -> np.ndarray:
    """A hash of the ROLL tokens before each place, mixed so that its minimum falls anywhere alike."""
    h = np.array([hash64(t) for t in tokens], np.int64).astype(np.uint64)
    total = np.zeros(len(tokens) + 1, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(ROLL):
            total[k + 1 :] = total[k + 1 :] + h[: len(tokens) - k] * _MULT ** np.uint64(k + 1)
        x = total ^ (total >> np.uint64(29))
        x = x * np.uint64(0xBF58476D1CE4E5B9)
        return x ^ (x >> np.uint64(32))


def cuts(kinds: np.ndarray, hashes: np.ndarray, limit: int = LIMIT, overlap: int = OVERLAP, least: int = LEAST) -> list[tuple[int, int, int]]:
    """(first token, token after the last, kind of the boundary at the end) of each piece."""
    n, out, fresh = len(kinds), [], 0
    while True:
        first = max(0, fresh - overlap)
        if n - first <= limit:
            out.append((first, n, NONE if not out else int(out[-1][2])))
            return [(a, b, k) for a, b, k in out[:-1]] + [(first, n, HEADING + 1)]
        lo, hi = min(fresh + least, first + limit), first + limit
        landmark = lo + int(np.argmin(hashes[lo : hi + 1]))
        window = kinds[lo : hi + 1]
        best = int(window.max())
        if best:
            at = lo + np.flatnonzero(window == best)
            end = int(at[np.argmin(np.abs(at - landmark))])
        else:
            end = landmark
        out.append((first, end, best))
        fresh = end


def pieces_of(text: str, limit: int = LIMIT, overlap: int = OVERLAP, least: int = LEAST) -> list[dict]:
    """The pieces of one text, as substrings of it; one piece if it is within the limit."""
    spans = [m.span() for m in _TOKEN.finditer(text)]
    if len(spans) <= limit:
        return [{"text": text, "first_token": 0, "tokens": len(spans), "ends_at": "end"}]
    if overlap < 0 or least < 1 or overlap + least > limit:
        raise ValueError("overlap and least must fit into the limit")
    found = cuts(boundaries(text, spans), rolling([text[a:b] for a, b in spans]), limit, overlap, least)
    return [{"text": text[spans[a][0] : spans[b - 1][1]], "first_token": a, "tokens": b - a, "ends_at": KINDS[k] if k < len(KINDS) else "end"} for a, b, k in found]


def pieces(chunks: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """(chunk_id, piece_no, text, first_token, token_count, ends_at, section) of every chunk over the limit.

    Consecutive pieces share ``overlap`` tokens, and none has more than ``limit``. Null texts and chunks
    within the limit have no pieces; repeated rows come out once, two texts of one chunk_id both.
    """

    def cut(cols: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {k: [] for k in types}
        for key, text, section in zip(cols["chunk_id"], cols["text"], cols["section"], strict=True):
            if text is None or len(text) < 2 * limit:
                continue
            parts = pieces_of(text, limit, overlap, min(LEAST, limit - overlap))
            if len(parts) > 1:
                for k, p in enumerate(parts):
                    for name, value in zip(out, (key, k, p["text"], p["first_token"], p["tokens"], p["ends_at"], section), strict=True):
                        out[name].append(value)
        return out

    types = {"chunk_id": pa.string(), "piece_no": pa.int32(), "text": pa.string(), "first_token": pa.int32(), "token_count": pa.int32(), "ends_at": pa.string(), "section": pa.string()}
    own = chunks.select(F.col("chunk_id").cast("string").alias("chunk_id"), F.col("text").cast("string").alias("text"), F.col("section").cast("string").alias("section"))
    return arrow_map(own, cut, "chunk_id string, piece_no int, text string, first_token int, token_count int, ends_at string, section string", types, rows=512).distinct()


def found(chunks: DataFrame) -> DataFrame:
    """(chunk_id): chunks that come out in more than one piece."""
    own = chunks.select(F.col("chunk_id").cast("string").alias("chunk_id"), F.col("text").cast("string").alias("text"), F.lit(None).cast("string").alias("section"))
    return pieces(own).where("piece_no = 1").select("chunk_id").distinct()


SQL_FOUND = """
SELECT DISTINCT chunk_id FROM chunks
WHERE length(list_filter(string_split_regex(text, '[ \\t\\n\\r\\f]+'), lambda x: x <> '')) > 512
"""
