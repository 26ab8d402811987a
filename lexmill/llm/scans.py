"""Problem 4: text from scanned pages, repaired into running paragraphs.

A linear-chain conditional model labels the lines of a scanned document as header, page number, body, end
of a paragraph or blank, from layout features; the best sequence is found by dynamic programming. Body lines
are put together again, broken words joined. Words with characters recognised wrongly are found against the
vocabulary of the documents that were not scanned: an unknown word is a misreading if undoing one or two of
the usual confusions gives a known one. ``method`` is not relied on: a scanned document shows in its lines,
which are wrapped at one width.
"""

from __future__ import annotations

import functools
import json
import os
import re
from collections import Counter
from collections.abc import Callable, Iterable
from difflib import SequenceMatcher

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm.text import arrow_map
from lexmill.llm.truncation import _HEADING, Heads, _page_line, title_heads
from lexmill.session import staged

LABELS = ("header", "page", "body", "end", "blank")
MODEL = os.path.join(os.path.dirname(__file__), "models", "lines.json")
#: Words of the clean documents that every task holds; all others are looked up by a join.
COMMON_WORDS = 50_000
#: Times that a word must occur in clean documents to be known.
KNOWN = 3
#: Widest line of a wrapped page.
WIDTH = 95

# What is read for what: (read, meant). Fixed values.
CONFUSIONS = (
    ("c", "e"), ("n", "r"), ("1", "i"), ("|", "i"), ("7", "t"), ("@", "a"), ("0", "o"), ("ri", "n"), ("5", "s"), ("ii", "u"), ("6", "é"), ("rn", "m"), ("1", "l"), ("|", "l"), ("9", "g"), ("6", "b"), ("ê", "è"), ("li", "h"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("3", "e"), ("4", "a"), ("8", "b"), ("vv", "w"), ("cl", "d"),
    ("1", "ا"), ("9", "و"), ("ى", "ي"), ("ث", "ت"), ("ش", "س"), ("ن", "ب"), ("ف", "ق"), ("غ", "ع"), ("5", "ه"), ("0", "ا"), ("0", "ه"), ("6", "ة"), ("7", "ح"),
)

_HYPHEN = re.compile(r"([^\W\d_]+)([-‐¬­])$")
_FIRST = re.compile(r"[^\w]*([^\W_]+)")
_STOPS = frozenset(".!?؟:")
_DIGITS = "0123456789٠١٢٣٤٥٦٧٨٩"
_LETTERS = re.compile(r"[\W\d_]+")
_WORD = re.compile(r"[^\W_]+(?:[@|][^\W_]+)*(?:[@|](?!\S))?|[@|][^\W_]+", re.UNICODE)
_MIXED = re.compile(r"^(?=.*[^\W\d_])(?=.*[0-9@|ﬁﬂ]).{3,}$")
_CODE = re.compile(r"^(?:[A-Za-z]{1,4}[0-9]+|[0-9]+[A-Za-z]{1,3}|[0-9]+[؀-ۿ]{1,2}|n[0-9]+)$")
_MAIL = re.compile(r"(?<!\S)(?:\S+\s?(?:\(at\)|\[at\])(?:\s?\S+)?|\S*(?:@|\(at\)|\[at\])\S*\.\S+|\S+@(?:$|\s)|\S+@(?:cabinet|greffe|etude|poste)\S*)", re.IGNORECASE)


def ends_sentence(line: str) -> bool:
    return line.rstrip(" \t\xa0»”\"')")[-1:] in _STOPS


def tail_number(line: str) -> tuple[bool, str]:
    """Whether a number stands apart at the end of the line, as of a page in its header, and the line without it."""
    x = line.rstrip()
    core = x.rstrip(_DIGITS)
    if core != x and len(core) > 1 and core[-2:].isspace():
        return True, core.rstrip()
    return False, line


def wrapped(lines: list[str]) -> bool:
    """Whether lines are wrapped at one width, as on a scanned page.

    Places where a sentence goes on in the next line make it out, against lines wider than a page: a page
    may hold some of these, as long as there are twice as many lines that go on.
    """
    runs = wide = 0
    for a, b in zip(lines, [*lines[1:], ""]):
        if len(a) > WIDTH and a.strip():
            wide += 1
        if len(a) >= 30 and b and not ends_sentence(a) and a.strip():
            first = b.lstrip()[:1]
            if first.islower() or "؀" <= first <= "ۿ" or first.isdigit():
                runs += len(a) <= WIDTH
    return runs >= 2 and runs >= 2 * wide


@functools.lru_cache(maxsize=100_000)
def is_title(key: str, name: str) -> bool:
    """Whether the letters of a line begin those of the title, misread letters allowed for, or go on after the whole title."""
    if not name or len(key) < 8:
        return False
    if key.startswith(name):
        return True
    if len(key) > 1.2 * len(name) + 8:
        return False
    return SequenceMatcher(None, key, name[: len(key)], autojunk=False).ratio() >= 0.85


def line_flags(lines: list[str], title: str | None, titled_line: Callable[[str], bool]) -> list[tuple]:
    """What the layout of each line shows, as a tuple that line_features() spells out; () for a blank line."""
    full = [k for k, x in enumerate(lines) if x and not x.isspace()]
    if not full:
        return [()] * len(lines)
    rows = [lines[k] for k in full]
    width = max(map(len, rows))
    name = _LETTERS.sub("", title or "").lower()
    tails, cores = zip(*map(tail_number, rows))
    keys = [_LETTERS.sub("", x).lower() for x in cores]
    many = Counter(keys)
    page = [*map(_page_line, rows), False]
    titled = [*map(titled_line, cores), False]
    bare = [x.strip() for x in rows]
    ends = [ends_sentence(x) for x in rows]
    lower = [x[0].islower() for x in bare]
    heading = [_HEADING.match(x) is not None for x in bare]
    last = len(rows) - 1
    out: list[tuple] = [()] * len(lines)
    for j, k in enumerate(full):
        x = rows[j]
        more = j < last
        own = titled[j] and is_title(keys[j], name)
        out[k] = (
            page[j] and (1 if j == 0 or not more else 2),
            tails[j],
            titled[j] and (j <= 2, own, titled[j + 1]),
            many[keys[j]] >= 2 and len(keys[j]) >= 10,
            lower[j],
            page[j - 1] or page[j + 1] if j else page[1],
            ends[j],
            x.isupper() and len(keys[j]) >= 12,
            heading[j],
            len(x) < 0.6 * width,
            j > 0 and not ends[j - 1],
            k + 1 >= len(lines) or not lines[k + 1] or lines[k + 1].isspace(),
            more and heading[j + 1],
            ends[j] and len(x) < width - 14 and more and not lower[j + 1],
        )
    return out


@functools.cache
def line_features(flags: tuple) -> tuple[str, ...]:
    """The names of the features of one line."""
    if not flags:
        return ("blank",)
    page, tail, titled, repeated, lower, near, ends, capitals, heading, short, open_before, gap, before_heading, short_end = flags
    f = ["line"]
    if page:
        f += ["page", "page_edge" if page == 1 else "page_inside"]
    if tail:
        f.append("tail_number")
    if titled:
        top, own, twice = titled
        place = "top" if top else "inside"
        f += ["titled", f"titled_{place}", f"titled_{'own' if own else 'other'}_{place}", f"titled_rep_{repeated}", f"titled_ends_{ends}"]
        if twice:
            f.append("titled_twice")
    if repeated:
        f += ["repeated", f"repeated_ends_{ends}", f"repeated_titled_{bool(titled)}", f"repeated_lower_{lower}_near_{near}"]
    if near:
        f += ["near_page", f"near_page_ends_{ends}_titled_{bool(titled)}"]
    if capitals:
        f.append("capitals")
    if heading:
        f.append("heading")
    f += ["ends" if ends else "open", "short" if short else "long", f"gap_{gap}_ends_{ends}"]
    if open_before and lower:
        f.append("goes_on")
    if before_heading:
        f.append("before_heading")
    if short_end:
        f.append("short_end")
    return tuple(f)


@functools.cache
def weights() -> dict[str, float]:
    with open(MODEL, encoding="utf-8") as f:
        return json.load(f)


class Chain:
    """A linear-chain model: emissions of each kind of line are added up once and kept."""

    def __init__(self, w: dict[str, float]) -> None:
        self.w = w
        self.steps = [[w.get(f"{a}>{b}", 0.0) for a in LABELS] for b in LABELS]
        self.first = [w.get(f"^>{b}", 0.0) for b in LABELS]
        self.emissions: dict[tuple, list[float]] = {}

    def emission(self, flags: tuple) -> list[float]:
        known = self.emissions.get(flags)
        if known is None:
            known = self.emissions[flags] = [sum(self.w.get(f"{f}|{b}", 0.0) for f in line_features(flags)) for b in LABELS]
        return known

    def decode(self, flags: list[tuple]) -> list[str]:
        """The best label sequence, by dynamic programming."""
        if not flags:
            return []
        score = [a + b for a, b in zip(self.first, self.emission(flags[0]))]
        back: list[list[int]] = []
        steps = self.steps
        for x in flags[1:]:
            step, new = [], []
            for t, e in zip(steps, self.emission(x)):
                reach = [a + b for a, b in zip(score, t)]
                best = max(reach)
                step.append(reach.index(best))
                new.append(best + e)
            back.append(step)
            score = new
        at = score.index(max(score))
        out = [at]
        for step in reversed(back):
            at = step[at]
            out.append(at)
        return [LABELS[x] for x in reversed(out)]


@functools.cache
def chain() -> Chain:
    return Chain(weights())


def label_lines(lines: list[str], title: str | None, titled_line: Callable[[str], bool]) -> list[str]:
    return chain().decode(line_flags(lines, title, titled_line))


def running(labels: list[str]) -> list[int]:
    """Numbers of the lines of running text."""
    return [k for k, x in enumerate(labels) if x in ("body", "end")]


def broken(lines: list[str], labels: list[str]) -> list[tuple[int, int, str, str]]:
    """(line, next line of running text, first part, second part) of each word broken at a line's end."""
    out = []
    body = running(labels)
    for a, b in zip(body, body[1:]):
        m = _HYPHEN.search(lines[a].rstrip())
        if m:
            n = _FIRST.match(lines[b])
            if n and (n[1][0].islower() or m[1][0].isupper() or n[1][0].isdigit()):
                out.append((a, b, m[1], n[1]))
    return out


@functools.lru_cache(maxsize=200_000)
def variants(word: str) -> tuple[str, ...]:
    """Words that the usual confusions, one or two of them, may have turned into this one."""

    def undo(x: str) -> Iterable[str]:
        arabic = any("؀" <= c <= "ۿ" for c in x)
        for read, meant in CONFUSIONS:
            if arabic == ("؀" <= meant[0] <= "ۿ"):
                k = x.find(read)
                while k >= 0:
                    yield x[:k] + meant + x[k + len(read) :]
                    k = x.find(read, k + 1)

    once = dict.fromkeys(undo(word))
    twice = dict.fromkeys(y for x in once for y in undo(x))
    return tuple(x for x in [*once, *[y for y in twice if y not in once and y != word]] if x.isalpha())


class Uncommon(dict):
    """(word, whether surely misread, variants) of the words of a space-separated token that are not common and could be misreadings."""

    def __init__(self, common: frozenset[str] | set[str]) -> None:
        super().__init__()
        self.common = common

    def __missing__(self, token: str) -> tuple[tuple[str, bool, tuple[str, ...]], ...]:
        if len(self) > 400_000:
            self.clear()
        out = []
        for w in _WORD.findall(token):
            x = w.lower()
            if x in self.common or len(x) < 2 or x.isdigit():
                continue
            sure, others = surely_misread(x), variants(x)
            if _CODE.match(w) and not (w.islower() and len(w) > 4 and sum(map(str.isdigit, w)) == 1):
                # looks like a code: only a word that one of its variants would make counts
                sure = False
                others = others if w.islower() and len(w) > 2 else ()
            if sure or others:
                out.append((x, sure, others))
        known = self[token] = tuple(out)
        return known

    def of(self, line: str) -> list[tuple[str, bool, tuple[str, ...]]]:
        """Those of a line, e-mail addresses aside."""
        if "@" in line or "(at)" in line or "[at]" in line:
            line = _MAIL.sub(" ", line)
        return [x for token in line.split() for x in self[token]]


def surely_misread(word: str) -> bool:
    """A word with a digit or sign among its letters, which no code, date or ordinal has."""
    if not _MIXED.match(word):
        return False
    letters = sum(map(str.isalpha, word))
    others = sum(c.isdigit() or c in "@|" for c in word)
    if any(c in "ﬁﬂ" for c in word):
        return True
    inner = bool(re.search(r"[^\W\d_][0-9|@]+[^\W\d_]", word))
    return letters >= 3 and others <= 2 and (inner or letters >= 4)


def _own(documents: DataFrame) -> DataFrame:
    return documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("title").cast("string").alias("title"), F.col("text").cast("string").alias("text")).where("doc_id is not null and text is not null")


def vocabulary(documents: DataFrame) -> DataFrame:
    """(word, n): words of the documents that were not scanned, counted before they are shuffled; rarer ones than KNOWN left out."""

    def count(cols: dict[str, list]) -> dict[str, list]:
        raw: Counter = Counter()
        for t in cols["text"]:
            if not wrapped(t.split("\n")):
                raw.update(t.split())
        words: Counter = Counter()
        for token, n in raw.items():
            if "@" not in token:
                for w in _WORD.findall(token):
                    if w.isalpha():
                        words[w.lower()] += n
        return {"word": list(words), "n": list(words.values())}

    rows = arrow_map(_own(documents).select("text"), count, "word string, n bigint", {"word": pa.string(), "n": pa.int64()}, rows=8192)
    return rows.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= KNOWN)


def _lines(documents: DataFrame, common: frozenset[str], titled: Heads) -> DataFrame:
    """(doc_id, line_no, kind, word, variants): labelled lines of scanned documents, and their uncommon words."""
    types = {"doc_id": pa.int64(), "line_no": pa.int64(), "kind": pa.string(), "word": pa.string(), "variants": pa.list_(pa.string())}
    uncommon = Uncommon(common)

    def look(cols: dict[str, list]) -> dict[str, list]:
        rows: list[tuple] = []
        for key, title, text in zip(cols["doc_id"], cols["title"], cols["text"], strict=True):
            lines = text.split("\n")
            if not wrapped(lines):
                continue
            labels = label_lines(lines, title, titled)
            rows += [(key, k, "header" if x == "header" else "page_number", None, None) for k, x in enumerate(labels) if x in ("header", "page")]
            parts: dict[int, set[str]] = {}
            for a, b, first, second in broken(lines, labels):
                rows.append((key, a, "broken_word", None, None))
                first, second = first.lower(), second.lower()
                parts.setdefault(a, set()).add(first)
                parts.setdefault(b, set()).add(second)
                whole = first + second
                if whole not in common and not (first in common and second in common):
                    for v in variants(whole):
                        # the part that differs names the line
                        same = next((j for j, (c, d) in enumerate(zip(whole, v)) if c != d), min(len(whole), len(v)))
                        rows.append((key, a if same < len(first) else b, "misread", whole, [v]))
                    rows += [(key, k, "misread", None, None) for k, part in ((a, first), (b, second)) if surely_misread(part)]
            for k in running(labels):
                skip = parts.get(k, ())
                for w, sure, others in uncommon.of(lines[k]):
                    if w not in skip:
                        if sure:
                            rows.append((key, k, "misread", None, None))
                        if others:
                            rows.append((key, k, "misread", w, others))
        return dict(zip(types, zip(*rows))) if rows else {}

    return arrow_map(_own(documents), look, "doc_id bigint, line_no bigint, kind string, word string, variants array<string>", types, rows=512)


def marked(documents: DataFrame, titled: Heads | None = None) -> DataFrame:
    """(doc_id, line_no, kind, word, correction): lines of scanned documents with traces of pages and recognition.

    A line may come out under two kinds; a misread word comes with its correction where one is known. Null
    texts and documents that are not wrapped have no rows. Further columns are left aside. The vocabulary and
    the labelled lines are written once to the shared folder and read by each of their consumers.
    """
    known = staged(vocabulary(documents))
    common = frozenset(r[0] for r in known.orderBy(F.desc("n"), "word").limit(COMMON_WORDS).collect())
    rows = staged(_lines(documents, common, titled or title_heads(documents)))
    asked = rows.where("variants is not null").select("word", F.explode("variants").alias("variant")).distinct()
    unknown = asked.join(known.select("word"), "word", "left_anti")
    fixes = unknown.join(known.select(F.col("word").alias("variant"), "n"), "variant").groupBy("word").agg(F.max_by("variant", F.struct("n", "variant")).alias("correction"))
    plain = rows.where("variants is null").select("doc_id", "line_no", "kind", "word", F.lit(None).cast("string").alias("correction"))
    doubtful = rows.where("variants is not null").join(fixes, "word").where("size(variants) > 1 OR correction = variants[0]")
    return plain.unionByName(doubtful.select("doc_id", "line_no", "kind", "word", "correction"))


def found(documents: DataFrame) -> DataFrame:
    """(doc_id, line_no, kind)."""
    return marked(documents).select("doc_id", "line_no", "kind").distinct()


_KEEP_HYPHEN = frozenset("sous procès peut est dit celui ceux vice ex non semi aït el al ben bou haut bas avant après demi mi".split())


def paragraphs(lines: list[str], labels: list[str], fixes: dict[str, str], titled: Callable[[str], bool]) -> str:
    """Running text of one document: headers and page numbers left out, broken words joined, misreadings put right."""
    out: list[str] = []
    current = ""

    def close() -> None:
        nonlocal current
        if current:
            out.append(current)
        current = ""

    order = [k for k, x in enumerate(labels) if x not in ("header", "page")]
    for k in order:
        if labels[k] == "blank":
            if current and (ends_sentence(current) or titled(current)):
                close()
            continue
        line = lines[k].strip()
        if _HEADING.match(line):
            close()
            out.append(line)
            continue
        m = _HYPHEN.search(current)
        if m and line[:1].isalpha():
            keep = m[2] == "-" and (m[1].lower() in _KEEP_HYPHEN or line[:1].isupper())
            current = (current if keep else current[:-1]) + line
        else:
            current = f"{current} {line}" if current else line
        if labels[k] == "end":
            close()
    close()
    text = "\n".join(out)
    for bad, good in fixes.items():
        text = re.sub(rf"(?<!\w){re.escape(bad)}(?!\w)", lambda m: good.upper() if m[0].isupper() and len(m[0]) > 1 else good[:1].upper() + good[1:] if m[0][:1].isupper() else good, text, flags=re.IGNORECASE)
    return text


def repaired(documents: DataFrame) -> DataFrame:
    """(doc_id, text, scanned): every document; the text of scanned ones in running paragraphs."""
    titled = title_heads(documents)
    fixes = marked(documents, titled).where("kind = 'misread' AND correction is not null").groupBy("doc_id").agg(F.map_from_entries(F.collect_set(F.struct("word", "correction"))).alias("fixes"))
    own = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("title").cast("string").alias("title"), F.col("text").cast("string").alias("text")).join(fixes, "doc_id", "left")

    def repair(cols: dict[str, list]) -> dict[str, list]:
        texts, scanned = [], []
        for title, text, fix in zip(cols["title"], cols["text"], cols["fixes"], strict=True):
            lines = (text or "").split("\n")
            scanned.append(text is not None and wrapped(lines))
            texts.append(paragraphs(lines, label_lines(lines, title, titled), dict(fix or {}), titled) if scanned[-1] else text)
        return {"doc_id": cols["doc_id"], "text": texts, "scanned": scanned}

    return arrow_map(own.select("doc_id", "title", "text", "fixes"), repair, "doc_id bigint, text string, scanned boolean", {"doc_id": pa.int64(), "text": pa.string(), "scanned": pa.bool_()}, rows=512)
