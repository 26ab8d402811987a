"""Trains the line model: ``python -m lexmill.llm.train_scans DOCUMENTS.parquet``.

No labels exist, so rules that are sure of themselves label a bounded sample of wrapped documents, and an
averaged structured perceptron learns weights of the layout features and of label pairs from them.
"""

from __future__ import annotations

import json
import random
import sys
from collections import Counter, defaultdict

from lexmill.llm.scans import _HEADING, _LETTERS, MODEL, Chain, ends_sentence, is_title, line_features, line_flags, tail_number, wrapped
from lexmill.llm.truncation import Heads, _page_line

#: Documents of the sample and turns over it.
SAMPLE, TURNS = 2500, 6


def teach(lines: list[str], title: str | None, heads: Heads) -> list[str]:
    """Labels by rule."""
    name = _LETTERS.sub("", title or "").lower()
    keys = [_LETTERS.sub("", tail_number(x)[1]).lower() for x in lines]
    many = Counter(k for k in keys if len(k) >= 10)
    full = [k for k, x in enumerate(lines) if x.strip()]
    out = ["blank"] * len(lines)
    width = max(map(len, lines))
    titled = {k: heads(tail_number(lines[k])[1]) for k in full}
    for j, k in enumerate(full):
        x = lines[k]
        own = titled[k] and is_title(keys[k], name)
        near = (j > 0 and _page_line(lines[full[j - 1]])) or (j + 1 < len(full) and _page_line(lines[full[j + 1]]))
        ends = ends_sentence(x)
        if _page_line(x):
            out[k] = "page"
        elif titled[k] and (tail_number(x)[0] or many[keys[k]] >= 2 or j > 2 and not ends):
            out[k] = "header"
        elif titled[k] and not own and j <= 2 and not ends and any(titled[full[i]] for i in (j - 1, j + 1) if 0 <= i < len(full)):
            out[k] = "header"
        elif titled[k] and not own and j <= 2 and not ends and name:
            out[k] = "header"
        elif many[keys[k]] >= 2 and near and not x.strip()[:1].islower() and len(x) <= 90 and not ends and not _HEADING.match(x.strip()):
            out[k] = "header"
        else:
            gap = k + 1 >= len(lines) or not lines[k + 1].strip()
            after = lines[full[j + 1]].strip() if j + 1 < len(full) else ""
            last = (gap and ends) or not after or bool(_HEADING.match(after)) or (ends and len(x) < width - 14 and not after[:1].islower())
            out[k] = "end" if last or _HEADING.match(x.strip()) else "body"
    return out


def train(rows: list[tuple[str | None, str]]) -> dict[str, float]:
    data = []
    begins = Counter(" ".join(t.lower().split()[:2]) for t, _ in rows if t and " " in t.strip())
    heads = Heads(h for h, n in begins.items() if n * 1000 >= begins.total())
    for title, text in rows:
        lines = text.split("\n")
        if wrapped(lines):
            data.append((line_flags(lines, title, heads), teach(lines, title, heads)))
    rng = random.Random(4)
    rng.shuffle(data)
    data = data[:SAMPLE]
    w: dict[str, float] = defaultdict(float)
    total: dict[str, float] = defaultdict(float)
    step = 1
    for _ in range(TURNS):
        for features, gold in data:
            said = Chain(w).decode(features)
            if said != gold:
                for labels, sign in ((gold, 1.0), (said, -1.0)):
                    before = "^"
                    for fs, b in zip(features, labels):
                        w[f"{before}>{b}"] += sign
                        total[f"{before}>{b}"] += step * sign
                        for f in line_features(fs):
                            w[f"{f}|{b}"] += sign
                            total[f"{f}|{b}"] += step * sign
                        before = b
            step += 1
        rng.shuffle(data)
    return {k: round(v - total[k] / step, 3) for k, v in w.items() if abs(v - total[k] / step) >= 0.001}


def main() -> None:
    import pyarrow.parquet as pq

    t = pq.read_table(sys.argv[1], columns=["title", "text"]).to_pydict()
    with open(MODEL, "w", encoding="utf-8") as f:
        json.dump(train(list(zip(t["title"], t["text"], strict=True))), f, ensure_ascii=False, indent=0, sort_keys=True)


if __name__ == "__main__":
    main()
