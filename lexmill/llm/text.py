"""Helpers shared by the operators: Arrow maps, tokens, word codes."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

#: A token is a run of characters other than these (TESTDATA.md).
TOKEN_SPACE = " \t\n\r\f"
#: str.split() also splits at these; they are part of a token here, so they are masked before a split.
_ODD_SPACE = re.compile("[\x0b\x1c-\x1f\x85\xa0  -     　]")
_TOKEN = re.compile(r"[^ \t\n\r\f]+")
_WORD = re.compile(r"[^\W_]+")
_MARKS = regex.compile(r"\p{M}+")


def split_tokens(text: str) -> list[str]:
    """Tokens of ``text`` in order; odd Unicode spaces inside a token come back as U+E000."""
    return _ODD_SPACE.sub("\ue000", text).split()


def count_tokens(text: str | None) -> int:
    """Number of tokens of ``text``; 0 for null."""
    return len(split_tokens(text)) if text else 0


def token_spans(text: str) -> list[tuple[int, int]]:
    """(start, end) of each token."""
    return [m.span() for m in _TOKEN.finditer(text)]


def bare(text: str) -> str:
    """``text`` without case and combining marks, after canonical decomposition."""
    if text.isascii():
        return text.lower()
    return _MARKS.sub("", unicodedata.normalize("NFD", text.casefold()))


def bare_words(text: str) -> list[str]:
    """Runs of letters or digits, compared without case, accents and other combining marks."""
    return _WORD.findall(bare(text))


def hash64(value: str) -> int:
    """A signed 64-bit hash, the same on every machine."""
    import xxhash

    return int(np.uint64(xxhash.xxh3_64_intdigest(value.encode("utf-8", "surrogatepass"))).astype(np.int64))


def batches_of(batches: Iterable[pa.RecordBatch], rows: int) -> Iterator[dict[str, list]]:
    """Columns as Python lists, at most ``rows`` rows at a time, so that long texts don't add up."""
    for batch in batches:
        for k in range(0, batch.num_rows, rows):
            part = batch.slice(k, rows)
            yield {name: part.column(i).to_pylist() for i, name in enumerate(part.schema.names)}


def arrow_map(df: DataFrame, f: Callable[[dict[str, list]], dict[str, list] | None], schema: str, types: dict[str, pa.DataType], rows: int = 512) -> DataFrame:
    """``df`` through ``f``, which takes and returns columns as lists, as one narrow Arrow stage."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cols in batches_of(batches, rows):
            out = f(cols)
            if out and len(next(iter(out.values()))):
                yield pa.RecordBatch.from_arrays([pa.array(out[k], type=t) for k, t in types.items()], names=list(types))

    return df.mapInArrow(run, schema)


class WordCoder(dict):
    """Codes whole batches of texts word by word; each distinct space-separated word is worked out once.

    ``f`` gives the codes of one word (none, one or several). The memory of words is emptied when it
    holds ``limit`` of them, so it stays bounded on any input.
    """

    def __init__(self, f: Callable[[str], list[int]], limit: int = 400_000) -> None:
        super().__init__()
        self.f, self.limit = f, limit
        self.lens: list[int] = []
        self.flat: list[int] = []

    def __missing__(self, word: str) -> int:
        k = self[word] = len(self.lens)
        codes = self.f(word)
        self.lens.append(len(codes))
        self.flat.extend(codes)
        return k

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Codes of all texts one after the other, and where each text begins (one more at the end)."""
        if len(self) > self.limit:
            self.clear()
            self.lens.clear()
            self.flat.clear()
        ids: list[int] = []
        ends = [0]
        get = self.__getitem__
        for t in texts:
            ids.extend(map(get, t.split()))
            ends.append(len(ids))
        at = np.fromiter(ids, np.int64, len(ids))
        lens, flat = np.array(self.lens, np.int64), np.array(self.flat, np.int64)
        first = np.concatenate(([0], np.cumsum(lens)))[:-1]
        n = lens[at]
        begin = np.concatenate(([0], np.cumsum(n)))
        codes = flat[np.repeat(first[at] - begin[:-1], n) + np.arange(begin[-1])] if len(flat) else np.zeros(0, np.int64)
        return codes, begin[np.array(ends)]
