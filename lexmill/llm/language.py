"""Problem 1: the language of documents and of lines in another language, by character language models.

One interpolated Kneser-Ney model of characters per language; the n-grams of all orders are hashed and
kept in sorted arrays with their log probabilities and back-off weights. A word is scored once (its history
begins at the blank before it) and its score reused; sentences add up their words, lines and documents their
sentences. The language with the lowest cross-entropy per letter wins; where the margin over the document's
language is below a calibrated threshold, a sentence is not told apart from its document.

The models are trained by ``python -m lexmill.llm.train_language`` and stored beside this module.
"""

from __future__ import annotations

import functools
import math
import os
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm.text import arrow_map

LANGUAGES = ("fr", "ar", "en", "es")
ORDER = 5
#: Log probability of a character that a model has never seen.
FLOOR = -12.0
#: What a character of the other script costs.
SCRIPT_GAP = 5.0
#: Letters that a line needs to be told apart.
LINE_LETTERS = 20
#: The language of what is rejected.
UNKNOWN = "und"
MODEL = os.path.join(os.path.dirname(__file__), "models", "language.npz")

_PRIME = 0x100000001B3
_MASK = (1 << 64) - 1
_EMAIL = re.compile(r"(?<![\w.+-])[\w.+-]++\s?(?:@|\(at\)|\[at\])\s?[\w.-]+", re.IGNORECASE)
_LABEL = re.compile(r"^(fr|ar|en|es)(?:[-_][a-z0-9]{2,8})?$")
_SENTENCE = tuple(".!?؟;:»\"")


def gram_hash(gram: str) -> int:
    """FNV-1a over the code points."""
    h = 0xCBF29CE484222325
    for c in gram:
        h = ((h ^ ord(c)) * _PRIME) & _MASK
    return h


def kneser_ney(words: Counter, order: int = ORDER, discount: float = 0.75) -> dict[str, tuple[float, float]]:
    """n-gram to (log probability, log back-off weight of it as a history), from words with their counts."""
    counts: list[Counter] = [Counter() for _ in range(order + 1)]
    for word, n in words.items():
        s = f" {word} "
        for k in range(1, len(s)):
            for m in range(1, min(order, k + 1) + 1):
                counts[m][s[k - m + 1 : k + 1]] += n
    # below the highest order, the number of different characters before an n-gram counts; n-grams that
    # begin with the blank have nothing before them and keep their counts
    used: list[dict[str, float]] = [{} for _ in range(order + 1)]
    used[order] = dict(counts[order])
    for m in range(order - 1, 0, -1):
        before: Counter = Counter(g[1:] for g in counts[m + 1])
        used[m] = {g: (n if g[0] == " " and m > 1 else max(before.get(g, 0), 1)) for g, n in counts[m].items()}
    total: list[defaultdict] = [defaultdict(float) for _ in range(order + 1)]
    kinds: list[Counter] = [Counter() for _ in range(order + 1)]
    for m in range(1, order + 1):
        for g, n in used[m].items():
            total[m][g[:-1]] += n
            kinds[m][g[:-1]] += 1
    vocabulary = len(counts[1]) + 50
    prob: list[dict[str, float]] = [{} for _ in range(order + 1)]
    for m in range(1, order + 1):
        for g, n in used[m].items():
            h = g[:-1]
            lower = 1 / vocabulary if m == 1 else prob[m - 1].get(g[1:], 1 / vocabulary)
            prob[m][g] = max(n - discount, 0) / total[m][h] + discount * kinds[m][h] / total[m][h] * lower
    out = {}
    for m in range(1, order + 1):
        for g, p in prob[m].items():
            weight = math.log(discount * kinds[m + 1][g] / total[m + 1][g]) if m < order and total[m + 1].get(g) else 0.0
            out[g] = (math.log(p), weight)
    return out


def pack(models: dict[str, dict[str, tuple[float, float]]]) -> dict[str, np.ndarray]:
    """The models as arrays: for each language sorted hashes, log probabilities and back-off weights."""
    out = {}
    for lang, model in models.items():
        keys = np.array([gram_hash(g) for g in model], np.uint64)
        order = np.argsort(keys)
        values = np.array(list(model.values()), np.float32).reshape(-1, 2)
        out |= {f"{lang}_key": keys[order], f"{lang}_prob": values[order, 0], f"{lang}_back": values[order, 1]}
    return out


class Scorer(dict):
    """Scores words and keeps their scores; emptied when it grows large."""

    def __init__(self, arrays: dict[str, np.ndarray], limit: int = 300_000) -> None:
        super().__init__()
        self.tables = [(arrays[f"{x}_key"], arrays[f"{x}_prob"].astype(np.float64), arrays[f"{x}_back"].astype(np.float64)) for x in LANGUAGES]
        self.margin, self.scale = (float(x) for x in arrays.get("calibration", np.array([0.25, 2.0])))
        self.limits = arrays.get("limits", np.array([[np.inf, 0.0]] * len(LANGUAGES)))
        self.limit = limit
        self._empty()

    def _empty(self) -> None:
        self.clear()
        self.fresh: list[str] = []
        self.scores = np.zeros((0, len(LANGUAGES)))
        self.letters = np.zeros(0, np.int64)
        self.ends = np.zeros(0, bool)

    def __missing__(self, word: str) -> int:
        k = self[word] = len(self)
        self.fresh.append(word)
        return k

    def _learn(self) -> None:
        if not self.fresh:
            return
        cores = ["".join(c if c.isalpha() else "'" if c in "'’" else " " for c in w.lower()).strip(" '") for w in self.fresh]
        self.letters = np.concatenate((self.letters, [sum(map(str.isalpha, w)) for w in self.fresh])).astype(np.int64)
        self.ends = np.concatenate((self.ends, [w.endswith(_SENTENCE) for w in self.fresh])).astype(bool)
        own = self._score(cores)
        # a word of one script tells nothing about languages of the other but that it isn't one of them
        ar = np.array([sum("\u0600" <= c <= "\u06ff" for c in w) * 2 > len(w) for w in cores])
        n = np.array([len(w) for w in cores])
        latin = [k for k, x in enumerate(LANGUAGES) if x != "ar"]
        j = LANGUAGES.index("ar")
        own[np.ix_(ar, latin)] = (own[ar, j] - SCRIPT_GAP * n[ar])[:, None]
        own[~ar, j] = own[np.ix_(~ar, latin)].max(axis=1) - SCRIPT_GAP * n[~ar]
        self.scores = np.concatenate((self.scores, own))
        self.fresh = []

    def _score(self, words: list[str]) -> np.ndarray:
        """Sums of log probabilities of each word's characters and of the blank after it."""
        text = "".join(f" {w} " if w else "" for w in words)
        owner = np.repeat(np.arange(len(words)), [len(w) + 2 if w else 0 for w in words])
        out = np.zeros((len(words), len(LANGUAGES)))
        if not text:
            return out
        codes = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)
        n = len(codes)
        first = np.concatenate(([True], owner[1:] != owner[:-1]))
        start = np.maximum.accumulate(np.where(first, np.arange(n), 0))
        depth = np.arange(n) - start + 1  # characters from the blank before the word up to here
        grams = []
        with np.errstate(over="ignore"):
            for m in range(1, ORDER + 1):
                h = np.full(n, 0xCBF29CE484222325, np.uint64)
                for back in range(m - 1, -1, -1):
                    c = np.zeros(n, np.uint64)
                    c[back:] = codes[: max(n - back, 0)]
                    h = (h ^ c) * np.uint64(_PRIME)
                grams.append(h)
        for j, (keys, prob, backs) in enumerate(self.tables):
            found, value, weight = [], [], []
            for h in grams:
                at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
                hit = keys[at] == h
                found.append(hit)
                value.append(prob[at])
                weight.append(np.where(hit, backs[at], 0.0))
            best = np.full(n, FLOOR)
            done = np.zeros(n, bool)
            penalty = np.zeros(n)
            for m in range(ORDER, 0, -1):
                possible = depth >= m
                take = possible & found[m - 1] & ~done
                best[take] = value[m - 1][take] + penalty[take]
                done |= take
                if m > 1:
                    # the history of this order ends one character earlier
                    back = np.concatenate(([0.0], weight[m - 2][:-1]))
                    penalty = penalty + np.where(possible & ~done, back, 0.0)
            best[~done] = FLOOR
            best[depth == 1] = 0.0  # the blank before the word is given
            out[:, j] = np.bincount(owner, weights=np.maximum(best, FLOOR), minlength=len(words))
        return out

    def sentences(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For each sentence of the texts: text, line, letters and the scores by language."""
        if len(self) > self.limit:
            self._empty()
        ids: list[int] = []
        line_of: list[int] = []
        text_of: list[int] = []
        sizes: list[int] = []
        get = self.__getitem__
        for t, text in enumerate(texts):
            if "@" in text or "(at)" in text or "[at]" in text or "(AT)" in text or "[AT]" in text:
                text = _EMAIL.sub(lambda m: "\n" * m[0].count("\n") or " ", text)
            for k, line in enumerate(text.split("\n")):
                words = line.split()
                if words:
                    ids.extend(map(get, words))
                    sizes.append(len(words))
                    line_of.append(k)
                    text_of.append(t)
        self._learn()
        at = np.fromiter(ids, np.int64, len(ids))
        if not len(at):
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, len(LANGUAGES)))
        ends = self.ends[at].copy()
        ends[np.cumsum(sizes) - 1] = True
        begin = np.concatenate(([0], np.flatnonzero(ends)[:-1] + 1))
        row = np.repeat(np.arange(len(sizes)), sizes)[begin]
        return np.array(text_of)[row], np.array(line_of)[row], np.add.reduceat(self.letters[at], begin), np.add.reduceat(self.scores[at], begin)

    def _mains(self, texts: list[str]) -> tuple[np.ndarray, ...]:
        """Sentences with letters (text, line, letters, scores, language) and letters by text and language."""
        text, line, letters, scores = self.sentences(texts)
        keep = letters > 0
        text, line, letters, scores = text[keep], line[keep], letters[keep], scores[keep]
        entropy = -scores / letters[:, None]
        best = entropy.argmin(axis=1)
        # first the language of most letters of each text, then sentences against it
        mass = np.zeros((len(texts), len(LANGUAGES)))
        np.add.at(mass, (text, best), letters)
        main = mass.argmax(axis=1)
        gap = entropy[np.arange(len(best)), main[text]] - entropy[np.arange(len(best)), best]
        best = np.where(gap < self.margin * np.minimum(1.0, 40.0 / np.maximum(letters, 1)) ** 0.5, main[text], best)
        mass = np.zeros((len(texts), len(LANGUAGES)))
        np.add.at(mass, (text, best), letters)
        return text, line, letters, scores, best, mass

    def mains(self, texts: list[str], least: int) -> list[str | None]:
        """The language of each text, None where it has fewer than ``least`` letters or is rejected."""
        text, _, letters, scores, _, mass = self._mains(texts)
        main = mass.argmax(axis=1)
        total = np.zeros((len(texts), len(LANGUAGES)))
        np.add.at(total, text, scores)
        n = np.bincount(text, weights=letters, minlength=len(texts)) if len(text) else np.zeros(len(texts))
        known = (n >= least) & ~self.rejected(total, n, main)
        return [LANGUAGES[k] if ok else None for k, ok in zip(main.tolist(), known.tolist(), strict=True)]

    def judge(self, texts: list[str]) -> list[tuple[str | None, float, list[tuple[int, int, str | None, float]]]]:
        """For each text its language and confidence, and (line, letters, language, confidence) of each line with letters. A language that is rejected is None."""
        n = len(LANGUAGES)
        out: list[tuple[str | None, float, list[tuple[int, int, str | None, float]]]] = [(None, 0.0, []) for _ in texts]
        text, line, letters, scores, best, mass = self._mains(texts)
        if not len(text):
            return out
        main = mass.argmax(axis=1)
        key = text * (int(line.max()) + 1) + line
        fresh = np.concatenate(([True], key[1:] != key[:-1]))
        begin = np.flatnonzero(fresh)
        by_line = np.zeros((len(begin), n))
        np.add.at(by_line, (np.cumsum(fresh) - 1, best), letters)
        at = text[begin]
        line_scores, line_letters = np.add.reduceat(scores, begin), by_line.sum(axis=1)
        pick = np.where(by_line[np.arange(len(begin)), main[at]] * 2 >= line_letters, main[at], by_line.argmax(axis=1))
        line_sure = self.confidences(line_scores, line_letters, pick)
        lost = self.rejected(line_scores, line_letters, pick)
        for t, k, m, p, sure, no in zip(at.tolist(), line[begin].tolist(), line_letters.tolist(), pick.tolist(), line_sure.tolist(), lost.tolist(), strict=True):
            out[t][2].append((k, int(m), None if no else LANGUAGES[p], sure))
        text_scores = np.zeros((len(texts), n))
        np.add.at(text_scores, text, scores)
        total = mass.sum(axis=1)
        sure = self.confidences(text_scores, total, main) * mass[np.arange(len(texts)), main] / np.maximum(total, 1)
        no = self.rejected(text_scores, total, main)
        for t in np.unique(text).tolist():
            out[t] = (None if no[t] else LANGUAGES[main[t]], round(float(sure[t]), 4), out[t][2])
        return out

    def confidences(self, scores: np.ndarray, letters: np.ndarray, pick: np.ndarray) -> np.ndarray:
        """Shares of belief in the picks, from cross-entropies per letter; the scale is fitted on held-out lines."""
        z = self.scale * scores / np.maximum(letters, 1)[:, None] * np.minimum(letters, 60)[:, None] ** 0.5
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return np.round(z[np.arange(len(z)), pick] / z.sum(axis=1), 4)

    def rejected(self, scores: np.ndarray, letters: np.ndarray, pick: np.ndarray) -> np.ndarray:
        """Whether a text is in none of the languages: its cross-entropy is high and no lower than under other models, beyond the limit calibrated on held-out lines."""
        each = -scores / np.maximum(letters, 1)[:, None]
        latin = [k for k, x in enumerate(LANGUAGES) if x != "ar"]
        how = np.where(np.isin(pick, latin), lack(each[:, latin]), each[np.arange(len(each)), pick])
        return how > self.limits[pick, 0] + self.limits[pick, 1] / np.maximum(letters, 1) ** 0.5


def lack(entropies: np.ndarray) -> np.ndarray:
    """How far texts are from every one of the languages: the lowest cross-entropy a letter, less what it is below the next."""
    x = np.sort(entropies, axis=1)
    return 2 * x[:, 0] - x[:, 1]


@functools.cache
def scorer() -> Scorer:
    with np.load(MODEL) as f:
        return Scorer({k: f[k] for k in f.files})


def label_language(label: str | None) -> str | None:
    """The language of a label that is a two-letter code, alone or with a region; else None."""
    m = _LABEL.match((label or "").strip().lower())
    return m[1] if m else None


def languages_of(texts: list[str]) -> list[str | None]:
    """Languages of whole texts, None where one has too few letters to tell."""
    return scorer().mains(texts, 12)


def judged(documents: DataFrame) -> DataFrame:
    """(doc_id, line_no, language, confidence, label_ok): each document (line_no -1) and each line in another language.

    A text without letters (null, empty, digits only) has no rows. A text or line that no model accounts for comes
    out as UNKNOWN, with no judgement of its label. Lines of fewer than LINE_LETTERS letters,
    e-mail addresses aside, are never told apart. Further columns are left aside.
    """
    types = {"doc_id": pa.int64(), "line_no": pa.int64(), "language": pa.string(), "confidence": pa.float64(), "label_ok": pa.bool_()}

    def judge(cols: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {k: [] for k in types}

        def add(*values: object) -> None:
            for name, v in zip(out, values, strict=True):
                out[name].append(v)

        for key, label, (lang, sure, lines) in zip(cols["doc_id"], cols["lang"], scorer().judge([t or "" for t in cols["text"]]), strict=True):
            if not lines:
                continue
            add(key, -1, lang or UNKNOWN, sure, label_language(label) == lang if lang else None)
            for k, letters, own, how in lines:
                if own != lang and letters >= LINE_LETTERS:
                    add(key, k, own or UNKNOWN, how, None)
        return out

    own = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")).where("doc_id is not null")
    return arrow_map(own, judge, "doc_id bigint, line_no bigint, language string, confidence double, label_ok boolean", types, rows=1024)


def found(documents: DataFrame) -> DataFrame:
    """(doc_id, line_no, language): wrong or missing labels, and lines in another language than their document."""
    return judged(documents).where(F.col("language") != UNKNOWN).where("line_no >= 0 OR NOT label_ok").select("doc_id", "line_no", "language").distinct()
