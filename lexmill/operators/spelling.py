"""Spelling of recognised text against a lexicon: accents restored, digits read for letters put right."""

from __future__ import annotations

import re
import unicodedata
from collections import defaultdict
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as t

#: Characters read for letters.
CONFUSIONS = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "bé", "7": "t", "8": "b", "9": "g"}
_WORD = re.compile(r"[^\W_]+")
_SCHEMA = t.StructType(
    [t.StructField("text", t.StringType()), t.StructField("corrections", t.ArrayType(t.StructType([t.StructField("at", t.IntegerType()), t.StructField("before", t.StringType()), t.StructField("after", t.StringType()), t.StructField("rule", t.StringType())])))]
)


def plain(word: str) -> str:
    """A word without accents, in lower case."""
    return "".join(c for c in unicodedata.normalize("NFD", word.lower()) if unicodedata.category(c) != "Mn")


def like(before: str, after: str) -> str:
    """``after`` in the case of ``before``."""
    return after.upper() if before.isupper() and len(before) > 1 else after.capitalize() if before[:1].isupper() else after


class Speller:
    """Corrections that only one lexicon word allows."""

    def __init__(self, lexicon: list[str]) -> None:
        self.words = {w.lower() for w in lexicon}
        keys: dict[str, set[str]] = defaultdict(set)
        for w in self.words:
            keys[plain(w)].add(w)
        self.accented = {k: next(iter(v)) for k, v in keys.items() if len(v) == 1 and next(iter(v)) != k}

    def readings(self, word: str, most: int = 2) -> set[str]:
        """Lexicon words within ``most`` confusions."""
        level, found = {word.lower()}, set()
        for _ in range(most):
            level = {x[:k] + r + x[k + 1 :] for x in level for k, c in enumerate(x) for r in CONFUSIONS.get(c, "")}
            found |= level & self.words
        return found

    def word(self, word: str) -> tuple[str, str] | None:
        """(correction, rule) of one word, or None."""
        if not 3 <= len(word) <= 30 or word.lower() in self.words or "؀" <= word[0] <= "ۿ":
            return None
        if word.isalpha():
            hit = self.accented.get(plain(word))
            return (like(word, hit), "accent") if hit and plain(word) == word.lower() else None
        if any(c.isdigit() for c in word) and any(c.isalpha() for c in word):
            hits = self.readings(word)
            if len(hits) == 1:
                return like(word, hits.pop()), "confusion"
        return None

    def text(self, text: str) -> tuple[str, list[tuple[int, str, str, str]]]:
        trace: list[tuple[int, str, str, str]] = []

        def fix(m: re.Match) -> str:
            hit = self.word(m[0])
            if hit:
                trace.append((m.start(), m[0], *hit))
                return hit[0]
            return m[0]

        return _WORD.sub(fix, text), trace


def correction(lexicon: list[str]) -> Callable[[F.Column, F.Column], F.Column]:
    """A column function of text and method: struct<text, corrections>. Only texts whose method is recognition change. The lexicon is a bounded word list."""

    @F.pandas_udf(_SCHEMA)
    def run(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        speller = Speller(lexicon)
        for texts, methods in parts:
            both = [speller.text(x) if x and (m or "").startswith("ocr") else (x, []) for x, m in zip(texts, methods, strict=True)]
            yield pd.DataFrame({"text": [a for a, _ in both], "corrections": [b for _, b in both]})

    return run


def corrected(docs: DataFrame, key: str, text: str, method: str, lexicon: list[str]) -> DataFrame:
    """(key, text, corrections) of each text."""
    return docs.select(key, correction(lexicon)(F.col(text), F.col(method)).alias("x")).select(key, "x.text", "x.corrections")


def tally(fixed: DataFrame) -> DataFrame:
    return fixed.select(F.explode("corrections").alias("c")).groupBy("c.rule").agg(F.count("*").alias("n"))
