"""Trains the weights of the segment model: ``python -m lexmill.llm.train_pii DOCUMENTS.parquet PII_MATCHES.parquet``.

What an older detector recorded is all that is known: it misses most items, takes other things for items and
cuts spans short. So no record is believed by itself; what many records have in common is.

* Words recorded as (part of) names several times, and a fair share of the times that they occur, are name words;
  so are words of like letters that mostly stand beside one. Runs of them are the names of a text.
* Numbers are labelled by the words before them: a context whose candidates the detector recorded far more
  rarely than those of most contexts is not one of an item.

The semi-Markov model is fitted by maximum likelihood: for each text the scores of its segmentations are
summed by forward and backward recursions over the candidates, and the gradient is what the labels have less
what the model expects. Some texts are seen with invented names in the place of theirs, and some without the
features of letters, so that forms of address and shapes carry names that no text had.
"""

from __future__ import annotations

import json
import random
import re
import sys
from collections import Counter, defaultdict

import numpy as np

from lexmill.llm.pii import CUES, MODEL, PARTICLES, Model, best, candidates, features, letters_of, scored, stem

#: Documents of the sample, passes over it, documents of a step.
SAMPLE, PASSES, STEP = 6000, 14, 64
#: Records that a name word needs, and their share of the word's occurrences.
RECORDED, RECORDED_SHARE = 2, 0.04
#: Candidates that a context needs to be judged by the records, and the share of the usual rate of records below which it is none of an item.
CONTEXT, CONTEXT_RATE = 40, 0.55
#: Share of its places at which a word of like letters must stand beside a name word to be one.
BESIDE = 0.5
#: Given names and surnames of invented persons.
GIVEN = "John Mary James Susan Robert Linda William Karen David Helen Thomas Laura Juan María Carlos Carmen José Lucía Antonio Elena Miguel Rosa Pedro Isabel Jean Anne Pierre Claire Michel Sophie Jacques Isabelle Karim Salma Youssef Nadia Omar Leïla Hassan Amina".split()
SURNAMES = "Smith Jones Brown Taylor Wilson Davies Evans Walker Wright Hughes García Márquez Fernández López Martínez Sánchez Romero Torres Molina Ortega Martin Bernard Dubois Laurent Moreau Girard Rousseau Lambert Fontaine Chevalier Alaoui Bennani Tazi Idrissi Chraibi Fassi Berrada Lahlou Naciri Sebti".split()

_NAME_WORD = re.compile(r"[^\W\d_]{2,}(?:[-‐][^\W\d_]{2,})*")

Segment = tuple[int, int, str]


def name_words(texts: list[str], recorded: list[str]) -> set[str]:
    """Stems of words that the records make names."""
    hits: Counter = Counter()
    for value in recorded:
        hits.update({stem(w) for w in _NAME_WORD.findall(value) if not w.islower() or "؀" <= w[0] <= "ۿ"} - CUES)
    seen: Counter = Counter()
    places: list[list[str]] = []
    for t in texts:
        own = [(m.start(), m.end(), stem(m[0]), m[0]) for m in _NAME_WORD.finditer(t)]
        seen.update(x[2] for x in own)
        places.append([x if not w.islower() or "؀" <= w[0] <= "ۿ" else "" for _, _, x, w in own])
    names = {w for w, n in hits.items() if n >= RECORDED and n >= RECORDED_SHARE * seen[w] and w not in PARTICLES and len(w) > 3}
    # words that the detector happened to record too rarely
    for _ in range(2):
        like = Model(like_weights(texts, names))
        beside: Counter = Counter()
        for row in places:
            known = [x in names for x in row]
            beside.update(x for k, x in enumerate(row) if x and not known[k] and (k and known[k - 1] or k + 1 < len(row) and known[k + 1]))
        names |= {w for w, n in beside.items() if n >= 3 and n >= BESIDE * seen[w] and len(w) > 3 and w not in CUES and like.namelike(w)}
    return {w for w in names if not (w[0] == "و" and w[1:] in names)}


class Teacher:
    """Labels candidates by what the records have in common."""

    def __init__(self, texts: dict[str, str], records: list[tuple[str, str, str, int, int]], start: Model) -> None:
        self.names = name_words(list(texts.values()), [v for _, k, v, _, _ in records if k == "nom"])
        self.start = start
        known = defaultdict(set)
        for doc, kind, _, a, b in records:
            known[doc].add((a, b, kind))
        many: Counter = Counter()
        hit: Counter = Counter()
        for doc, text in texts.items():
            for c in candidates(text, Model({"namelike": 1e9})):
                if c[2] in ("telephone", "cin"):
                    for x in self.contexts(text, c):
                        many[x] += 1
                        hit[x] += c[:3] in known[doc]
        usual = {kind: float(np.quantile([hit[x] / n for x, n in many.items() if n >= CONTEXT and x[0] == kind] or [0.0], 0.75)) for kind in ("telephone", "cin")}
        self.never = {x for x, n in many.items() if n >= CONTEXT and hit[x] < CONTEXT_RATE * usual[x[0]] * n or n >= CONTEXT // 3 and not hit[x]}

    @staticmethod
    def contexts(text: str, c: tuple) -> list[tuple[str, str]]:
        fs = features(text, c)
        return [(c[2], f) for f in fs if f.startswith(("l1=", "l2=", "code="))]

    def is_name(self, word: str) -> bool:
        return stem(word) in self.names

    def __call__(self, text: str, found: list[tuple]) -> set[Segment]:
        out: set[Segment] = set()
        names: list[tuple[int, int]] = []
        for c in sorted(found, key=lambda c: (c[0] - c[1], c[0])):  # the longest first
            a, b, kind, spans = c
            if kind == "nom":
                words = [text[i:j] for i, j in spans]
                full = [len(w) > 1 and self.is_name(w) for w in words]
                # an initial may stand before a surname (M. only after a role, as it mostly is a civility), small words between names
                before = [stem(m) for m in re.findall(r"\w+", text[max(0, a - 40) : a])[-1:]]
                fine = all(f or len(w) == 1 and w.isupper() and k == 0 and len(words) > 1 and (stem(w) not in CUES or before and before[0] in CUES) or w in PARTICLES and 0 < k < len(words) - 1 for k, (w, f) in enumerate(zip(words, full)))
                if fine and any(full) and not any(a < y and x < b for x, y in names):
                    names.append((a, b))
                    out.add((a, b, kind))
            elif kind in ("email", "adresse") or not any(x in self.never for x in self.contexts(text, c)):
                out.add((a, b, kind))
        kept: list[Segment] = []
        for s in sorted(out, key=lambda s: (s[2] not in ("email", "adresse"), s[0] - s[1], s[0])):
            if not any(s[0] < b and a < s[1] for a, b, _ in kept):
                kept.append(s)
        return set(kept)


def like_weights(texts: list[str], names: set[str]) -> dict[str, float]:
    """Letters that name words have and other words lack, for the first choice of candidates."""
    outside: Counter = Counter()
    for t in texts:
        outside.update({stem(w) for w in _NAME_WORD.findall(t) if len(w) > 3} - names)
    has, lacks = Counter(), Counter()
    for w in names:
        has.update(f for f in letters_of(w) if not f.startswith(("shape", "len")))
    for w, n in outside.items():
        if n >= 2 and not (w[:1] == "و" and w[1:] in names):
            lacks.update(f for f in letters_of(w) if not f.startswith(("shape", "len")))
    w: dict[str, float] = {}
    for f, n in has.items():
        if n >= 2:
            w[f"like.{f}"] = round(max(-1.0, min(1.5, (n - lacks[f]) / (n + lacks[f]))), 3)
    for f, n in lacks.items():
        if f not in has and n >= 3:
            w[f"like.{f}"] = -0.5
    return w | {"namelike": 0.9}


def renamed(text: str, gold: set[Segment], rng: random.Random) -> tuple[str, set[Segment]]:
    """The text with invented names in the place of its names in Latin script."""
    out, labels, last = [], set(), 0
    size = 0
    for a, b, kind in sorted(gold):
        if a < last:
            continue
        value = text[a:b]
        if kind == "nom" and value[0].isupper() and len(value.split()) > 1:
            small = [rng.choice(["de", "de la", "del", "El", "Ben"])] if rng.random() < 0.15 else []
            value = " ".join([rng.choice(GIVEN), *([rng.choice(GIVEN)] if rng.random() < 0.2 else []), *small, rng.choice(SURNAMES), *([rng.choice(SURNAMES)] if rng.random() < 0.2 else [])])
        out += [text[last:a], value]
        size += a - last
        labels.add((size, size + len(value), kind))
        size += len(value)
        last = b
    return "".join([*out, text[last:]]), labels


def expected(segments: list[tuple[int, int]], score: np.ndarray) -> np.ndarray:
    """The probability of each candidate segment, over all sets of segments that don't overlap."""
    n = len(segments)
    by_end = sorted(range(n), key=lambda k: segments[k][1])
    ends = np.array([segments[k][1] for k in by_end])
    starts = np.array(sorted(s for s, _ in segments))
    forward = np.zeros(n + 1)
    for j, k in enumerate(by_end, 1):
        forward[j] = np.logaddexp(forward[j - 1], forward[np.searchsorted(ends, segments[k][0], side="right")] + score[k])
    by_start = sorted(range(n), key=lambda k: segments[k][0])
    backward = np.zeros(n + 1)
    for j in range(n - 1, -1, -1):
        k = by_start[j]
        backward[j] = np.logaddexp(backward[j + 1], backward[np.searchsorted(starts, segments[k][1], side="left")] + score[k])
    a, b = np.array([s for s, _ in segments]), np.array([e for _, e in segments])
    return np.exp(forward[np.searchsorted(ends, a, side="right")] + score + backward[np.searchsorted(starts, b, side="left")] - forward[n])


def fit(data: list[tuple[list[tuple[int, int]], list[list[int]], np.ndarray]], size: int, prior: float = 0.02) -> np.ndarray:
    """Weights of greatest likelihood with a small Gaussian prior, by adaptive gradient steps."""
    rng = random.Random(2)
    w, square = np.zeros(size), np.full(size, 1e-6)
    ready = [(seg, np.concatenate([np.array(f) for f in fs]), np.array([len(f) for f in fs]), gold) for seg, fs, gold in data]
    for turn in range(PASSES):
        rng.shuffle(ready)
        loss = 0.0
        for k in range(0, len(ready), STEP):
            step: list[np.ndarray] = []
            weight: list[np.ndarray] = []
            for seg, flat, lens, gold in ready[k : k + STEP]:
                score = np.add.reduceat(w[flat], np.concatenate(([0], np.cumsum(lens)[:-1])))
                p = expected(seg, score)
                loss += float(np.abs(gold - p).sum())
                step.append(flat)
                weight.append(np.repeat(gold - p, lens))
            g = np.bincount(np.concatenate(step), np.concatenate(weight), size) - prior * w * STEP / len(ready)
            square += g * g
            w += 0.35 * g / np.sqrt(square)
        print("pass", turn, "expected errors", round(loss, 1), file=sys.stderr)
    return w


def train(texts: dict[str, str], records: list[tuple[str, str, str, int, int]]) -> dict[str, float]:
    rng = random.Random(2)
    chosen = sorted(texts)
    rng.shuffle(chosen)
    teacher = Teacher(texts, records, Model({"namelike": 1e9}))
    start = like_weights([texts[d] for d in chosen[:SAMPLE]], teacher.names)
    model = Model(start)
    index: dict[str, int] = {}
    data = []
    for d in chosen[:SAMPLE]:
        text = texts[d]
        gold = teacher(text, candidates(text, model))
        views = [(text, gold, False)]
        if rng.random() < 0.3:
            views.append((*renamed(text, gold, rng), False))
        if rng.random() < 0.3:
            views.append((*renamed(text, gold, rng), True))
        for t, g, blind in views:
            found = candidates(t, model)
            if found:
                rows = [[f"{c[2]}.{f}" for f in features(t, c) if not blind or not re.match(r"(?:first_|last_)?(?:pre|suf)\d=", f)] for c in found]
                data.append(([c[:2] for c in found], [[index.setdefault(f, len(index)) for f in r] for r in rows], np.array([float(c[:3] in g) for c in found])))
    w = fit(data, len(index))
    return start | {f: round(float(w[k]), 3) for f, k in index.items() if abs(w[k]) >= 0.03}


def accuracy(texts: dict[str, str], records: list[tuple[str, str, str, int, int]], w: dict[str, float]) -> dict[str, tuple[int, int, int]]:
    """Labels, segments found, and both, by type, on texts that the weights were not trained on."""
    m = Model(w)
    teacher = Teacher(texts, records, m)
    out = {}
    for text in texts.values():
        found = candidates(text, m)
        gold, said = teacher(text, found), set(best(scored(text, found, m)))
        for kind in {s[2] for s in gold | said}:
            g, p = {s for s in gold if s[2] == kind}, {s for s in said if s[2] == kind}
            x = out.get(kind, (0, 0, 0))
            out[kind] = (x[0] + len(g), x[1] + len(p), x[2] + len(g & p))
    return out


def read(documents: str, matches: str) -> tuple[dict[str, str], list[tuple[str, str, str, int, int]]]:
    import pyarrow.parquet as pq

    d = pq.read_table(documents, columns=["doc_key", "text"]).to_pydict()
    m = pq.read_table(matches, columns=["doc_id", "pii_type", "value", "start_pos", "end_pos"]).to_pydict()
    return {k: t for k, t in zip(d["doc_key"], d["text"], strict=True) if t}, sorted({r for r in zip(*m.values(), strict=True) if None not in r})


def main() -> None:
    texts, records = read(sys.argv[1], sys.argv[2])
    w = train(texts, records)
    with open(MODEL, "w", encoding="utf-8") as f:
        json.dump(w, f, ensure_ascii=False, indent=0, sort_keys=True)
    print(len(w), "weights", file=sys.stderr)
    if len(sys.argv) > 4:
        print("held out:", accuracy(*read(sys.argv[3], sys.argv[4]), w), file=sys.stderr)


if __name__ == "__main__":
    main()
