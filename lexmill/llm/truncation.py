"""Problem 10: texts cut off by field limits.

Two kinds of evidence. A record's own last line, once signs of a cut and the site, routing, signature and
page lines after it are put aside, stops in mid-word or mid-sentence. And a self-join by prefix finds
records that are strict prefixes of a longer copy elsewhere: fixed-length prefixes are hashed, values that
share one are sorted, and a value that begins its successor is a prefix of it. The join decides the records
whose last line looks whole but could be the middle of something, such as a number cut at its separator.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from difflib import SequenceMatcher

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexmill.llm.text import arrow_map, bare, hash64
from lexmill.session import staged

#: Lengths of the prefixes that are hashed, ascending.
LEVELS = (32, 64, 128, 256, 512, 1024, 2048, 4096, 8192)

#: Buckets of identifiers by which texts are told that nothing is asked about.
BUCKETS = 1 << 18

WHOLE, OPEN, CUT = "whole", "open", "cut"

_NOT_LETTER = re.compile(r"[\W\d_]+")
_PAGE = re.compile(r"^(?:[pf][a@]ge|pages|pag|pág|página|p|n|الصفحة|صفحة|ص)?[^\w|]*+(?:n(?![^\W\d_]))?[^\w|]*+[0-9٠-٩IVXl|]{1,5}[^\w/]*+(?:(?:/|sur|of|de|من)\s*+[0-9٠-٩]{1,5})?$", re.IGNORECASE)
# What may stand around a page number, and how a line with only one begins or ends once that is stripped.
_EDGE = " \t\xa0.,;:!?*-–—_=~#<>()[]{}«»\"'•·…/\\"
_PAGE_FIRST = frozenset("pPfFnNصا0123456789٠١٢٣٤٥٦٧٨٩IVXivxlL|")
_PAGE_LAST = frozenset("0123456789٠١٢٣٤٥٦٧٨٩IVXivxlL|")
# A number and its stop are the end of a sentence whose line was wrapped there.
_NUMBER_STOP = re.compile(r"^(?:n\s*[°º.]{0,2}\s*)?[0-9/]+\.(?:\s*[»”\"])?$")
_DATE_LINE = re.compile(r"^[^\s,،]+[,،]\s*(?:le\s+|el\s+|في\s+)?[0-3]?\w?[/ ][\w/ ]{2,20}$")
_HEADING = re.compile(r"^(?:Article|Section|Chapitre|Titre|Alin[ée]a|Chapter|Clause|Cl[áa]usula|Paragraph|Art[ií]culo|Cap[ií]tulo|Sección|Párrafo|المادة|الفصل|الباب|الفقرة|القسم|الفرع|البند)\s+[\w-]{1,5}(?:\s+(?:bis|ter|مكرر))?\s*(?:[-:–.]\s*\w.{0,60})?$", re.IGNORECASE)
_SIGN = re.compile(r"(?:(?:…|\.\.\.)?\s*\((?:lire la|voir la|read|leer|اقرأ|تابع|انظر)?\s*(?:suite|more|más|المزيد|التتمة|البقية)\s*(?:\.\.\.|…)?\s*\)|\[\s*(?:\.\.\.|…)\s*\]|\(\s*(?:\.\.\.|…)\s*\)|\.\.\.|…|�)\s*$")
_SIGN_LAST = frozenset(")].…\ufffd")
_CONTACT = re.compile(r"(?:@|\(at\)|\[at\])\s*[\w.-]+\.[a-z]{2,8}\s*$|^(?:courriel|portable|tél|tel|e-?mail|téléphone|fax|الهاتف|correo|phone)\b[\s.:]*[+\d][\d\s().-]{6,}$", re.IGNORECASE)
# Ends in a stop that may be inside an amount, a telephone number or an abbreviation.
_INNER_STOP = re.compile(r"(?:(?:paiement de|devis de|dépasse|somme de|أداء|النزاع|payment of|pago de|exceeds|supera|estimate of|presupuesto de)\s+\d{1,3}|(?:\d\d\.){1,4}\d\d|\b(?:M|Mme|Mlle|Me|MM|art|Art|al|p|pp|cf|C\.I|C|ب|ت|و|n|N|[A-Z])|\s\d{1,2}/\d{0,2})\.$")
_AMOUNT_STOP = re.compile(r"(?:paiement de|devis de|dépasse|somme de|أداء|النزاع)\s+\d{1,3}\.$")
_PHONE_WHOLE = re.compile(r"(?:\d\d\.){4}\d\d\.$")


def _frame(line: str) -> str:
    return " ".join(_NOT_LETTER.sub(" ", bare(line)).split())


_FIXES = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "6": "e", "7": "t", "8": "b", "9": "g", "@": "a", "|": "l", "$": "s"})


def _page_line(line: str) -> bool:
    """Whether the line holds only a page number, with or without a total."""
    core = line.strip(_EDGE)
    if not core or not (core[0] in _PAGE_FIRST or core[-1] in _PAGE_LAST):
        return False
    return bool(_PAGE.match(core) or _PAGE.match(core.strip(_EDGE + "|"))) and not _NUMBER_STOP.match(line)


class Beginnings:
    """Beginnings of lines, of one or two words, looked up with misread letters allowed for."""

    #: Letters that a beginning has at least to be recognised with a misread one.
    LEAST = 10

    def __init__(self, words: Iterable[str], near: float) -> None:
        self.words, self.near = frozenset(words), near
        self.by_letter: dict[str, list[tuple[str, set[str]]]] = {}
        for w in sorted(self.words):
            if len(w) >= self.LEAST:
                self.by_letter.setdefault(w[0], []).append((w, set(w)))
        self.memo: dict[str, str | None] = {}

    def find(self, head: str) -> str | None:
        """The beginning that ``head``, without case and accents, is or was misread from."""
        if head in self.words:
            return head
        known = self.memo.get(head, "")
        if known == "":
            if len(self.memo) > 200_000:
                self.memo.clear()
            known = self.memo[head] = self._near(head)
        return known

    def _near(self, head: str) -> str | None:
        for w, letters in self.by_letter.get(head[:1], ()):
            own = head[: len(w)]
            if len(letters & set(own)) >= 0.75 * len(letters) and SequenceMatcher(None, w, own, autojunk=False).ratio() >= self.near:
                return w
        return None


class Heads:
    """The beginnings of titles, two words each, which running headers repeat; learned from the titles of a corpus."""

    def __init__(self, heads: Iterable[str], longest: int = 90) -> None:
        self.heads, self.longest = tuple(sorted({bare(h) for h in heads} - {""})), longest
        self.begins = Beginnings(self.heads, 0.88)
        self.reach = max(map(len, self.heads), default=0) + 8
        self.memo: dict[str, bool] = {}

    def __reduce__(self):  # the memory stays behind
        return Heads, (self.heads, self.longest)

    def __call__(self, line: str) -> bool:
        """Whether the line begins as titles do, misread letters allowed for."""
        head = line.lstrip("•-*»« \t0123456789[]—")[: self.reach]
        known = self.memo.get(head)
        if known is None:
            if len(self.memo) > 200_000:
                self.memo.clear()
            x = bare(head)
            known = self.memo[head] = x.startswith(self.heads) or self.begins._near(x.translate(_FIXES)) is not None
        return known


#: Share of the titles that a beginning needs to be one that running headers repeat; so there are at most 1,000 of them.
TITLE_SHARE = 0.001


def title_heads(documents: DataFrame) -> Heads:
    """The first two words of titles that at least TITLE_SHARE of the titled documents begin with."""
    title = F.trim(F.col("title").cast("string"))
    head = F.array_join(F.slice(F.split(F.lower(title), r"\s+"), 1, 2), " ")
    counts = documents.select(head.alias("head"), F.length(title).alias("n")).where("head like '% %'").groupBy("head").agg(F.count("*").alias("n"), F.max("n").alias("longest"))
    total = counts.agg(F.sum("n")).first()[0] or 0
    rows = counts.where(F.col("n") >= TITLE_SHARE * total).collect() if total else []
    return Heads((r["head"] for r in rows), max((r["longest"] for r in rows), default=90))


#: Lines at the end of a text that are counted to learn which ones follow texts.
LOOK = 6
#: Documents that a beginning of closing lines needs, at least and as a share of all; so there are at most LOOK / CLOSING_SHARE of each length.
CLOSING_DOCS, CLOSING_SHARE = 5, 0.0001
#: Share of the places of a beginning of two words, of one word, at which no sentence ends from there to the end of the text.
CLOSING_FREE = {2: 0.5, 1: 0.8}
#: Share of a source's documents that end in a line, for it to be one of the source.
SOURCE_SHARE = 0.01
#: Letters of a line that is compared as a whole within its source.
SOURCE_LETTERS = 12


class Closings:
    """Lines that may follow the end of a text (place and date, signature, enclosure, routing, contact, site), by their first words.

    Learned from a corpus: a line that closes texts stands, with no end of a sentence from there on, at the
    end of many of them, while a line of running text mostly has one after it.
    """

    def __init__(self, words: dict[str, float]) -> None:
        self.words = words
        self.begins = Beginnings(words, 0.86)
        self.memo: dict[str, bool] = {}

    def __reduce__(self):
        return Closings, (self.words,)

    def __call__(self, line: str) -> bool:
        known = self.memo.get(line)
        if known is None:
            if len(self.memo) > 50_000:
                self.memo.clear()
            known = self.memo[line] = self._closes(_frame(line), line) or any(c in _FIXED for c in line) and self._closes(_frame(line.translate(_FIXES)), line)
        return known

    def _closes(self, frame: str, line: str) -> bool:
        words = frame.split(" ")
        if not frame:
            return not any(c.isdigit() for c in line)
        w = self.begins.find(" ".join(words[:2])) if len(words) > 1 else None
        if w is None and not stops(line):  # one word is too little where a sentence ends
            w = self.begins.find(words[0])
        return w is not None and len(words) <= 1.5 * self.words[w] + 3

    def goes_on(self, before: str, line: str) -> bool:
        """Whether the line is the rest of the closing line before it, which both together make no longer than such lines are."""
        words = _frame(f"{before} {line}").split(" ")
        w = self.begins.find(" ".join(words[:2]))
        return w is not None and len(words) <= self.words[w] + 0.5 and not stops(before)


_FIXED = frozenset("0134567@|$89")


def tail_counts(documents: DataFrame, titled: Heads) -> DataFrame:
    """(source, size, head, key, n, free, words): counts of the last LOOK lines of the texts, by beginning (size 1 or 2), and of whole lines by source (size 0); size -1 counts documents.

    Titles, headings, dates and page numbers, known by themselves, are left aside. Added up in each batch, so what
    is shuffled is not a row for each line.
    """
    types = {"source": pa.string(), "size": pa.int32(), "head": pa.string(), "key": pa.int64(), "n": pa.int64(), "free": pa.int64(), "words": pa.int64()}

    def count(cols: dict[str, list]) -> dict[str, list]:
        n: Counter = Counter()
        free: Counter = Counter()
        words: Counter = Counter()
        for source, text in zip(cols["source"], cols["text"], strict=True):
            n[source, -1, None, None] += 1
            rows = _last_lines(text, LOOK)
            end = len(rows)
            while end and not stops(rows[end - 1]):
                end -= 1
            for k, x in enumerate(rows):
                frame = "" if titled(x) or _page_line(x) or _HEADING.match(x) or _DATE_LINE.match(x) else _frame(x)
                if not frame:
                    continue
                parts = frame.split(" ")
                for key in {(None, 2, " ".join(parts[:2]), None), (None, 1, parts[0], None)}:
                    n[key] += 1
                    if k >= end:
                        free[key] += 1
                        words[key] += len(parts)
                if k >= end and len(frame) - len(parts) + 1 >= SOURCE_LETTERS:
                    n[source, 0, None, line_key(frame)] += 1
        keys = list(n)
        return {"source": [k[0] for k in keys], "size": [k[1] for k in keys], "head": [k[2] for k in keys], "key": [k[3] for k in keys], "n": list(n.values()), "free": [free[k] for k in keys], "words": [words[k] for k in keys]}

    own = _own(documents).where("text is not null").select("source", "text")
    return arrow_map(own, count, "source string, size int, head string, key bigint, n bigint, free bigint, words bigint", types, rows=4096)


def learned_closings(counts: DataFrame) -> Closings:
    """The beginnings that close texts. Their number is bounded by CLOSING_SHARE, not by the data."""
    total = counts.where("size = -1").agg(F.sum("n")).first()[0] or 0
    least = max(CLOSING_DOCS, CLOSING_SHARE * total)
    heads = counts.where("size > 0").groupBy("size", "head").agg(F.sum("n").alias("n"), F.sum("free").alias("free"), F.sum("words").alias("words")).where((F.col("n") >= least) & (F.col("free") >= F.when(F.col("size") == 2, CLOSING_FREE[2]).otherwise(CLOSING_FREE[1]) * F.col("n")))
    return Closings({r["head"]: r["words"] / r["free"] for r in heads.orderBy("size").collect()})


def source_lines(counts: DataFrame) -> DataFrame:
    """(source, key): lines that end at least CLOSING_DOCS and SOURCE_SHARE of the texts of a source."""
    sizes = counts.where("size = -1").groupBy("source").agg(F.sum("n").alias("docs"))
    lines = counts.where("size = 0").groupBy("source", "key").agg(F.sum("n").alias("n")).where(F.col("n") >= CLOSING_DOCS)
    both = lines.join(sizes.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")))
    return both.where(F.col("n") >= SOURCE_SHARE * F.col("docs")).select("source", "key")


def line_key(frame: str) -> int:
    """Identifies a line by its letters."""
    return hash64(frame.replace(" ", ""))


def _last_lines(text: str, most: int) -> list[str]:
    """The last ``most`` lines that are not blank, blanks collapsed."""
    out: list[str] = []
    end = len(text)
    while end >= 0 and len(out) < most:
        at = text.rfind("\n", 0, end)
        x = " ".join(text[at + 1 : end].split())
        if x:
            out.append(x)
        if at < 0:
            break
        end = at
    return out[::-1]


def stops(line: str) -> bool:
    """Whether a sentence ends at the line's end; quotes, notes and short remarks in brackets may follow its stop."""
    end = len(line)
    while end:
        c = line[end - 1]
        if c in ".!?؟۔":
            return True
        if c == "]" and (at := line.rfind("[", max(0, end - 12), end)) >= 0 and line[at + 1 : end - 1].isdigit():
            end = at
        elif c == ")" and (at := line.rfind("(", max(0, end - 42), end)) >= 0 and 1 <= end - at - 2 <= 40 and ")" not in line[at + 1 : end - 1]:
            end = at
        elif c in " \t\xa0»”\"')]":
            end -= 1
        else:
            return False
    return False


def abrupt(line: str) -> str:
    """WHOLE, OPEN or CUT: how a text ends whose last line, blanks collapsed, this is."""
    if line[-1:] in _SIGN_LAST and _SIGN.search(line):
        return CUT
    if stops(line):
        return CUT if _AMOUNT_STOP.search(line) else OPEN if _INNER_STOP.search(line) and not _PHONE_WHOLE.search(line) else WHOLE
    if _CONTACT.search(line):
        return WHOLE
    return CUT


class _Rows:
    """The lines of one text that are not blank, and what may be put aside at their end."""

    def __init__(self, text: str, closes: Closings, titled: Heads) -> None:
        self.raw = [x for x in text.split("\n") if x and not x.isspace()]
        self.closes, self.titled = closes, titled
        self.often: Counter | None = None

    def __getitem__(self, k: int) -> str:
        return " ".join(self.raw[k].split())

    def repeated(self, line: str) -> bool:
        if self.often is None:
            self.often = Counter(" ".join(x.split()) for x in self.raw)
        return self.often[line] > 1

    def own(self, k: int, signed: bool) -> tuple[int, bool]:
        """From line ``k`` up to the record's own last line, and whether a sign of a cut was passed."""
        closes = self.closes
        while k >= 0:
            line = self[k]
            before = self[k - 1] if k else ""
            if line[-1] in _SIGN_LAST and not _SIGN.sub("", line).strip():
                signed = True
            elif k and len(line) < 25 and line[-1] in _SIGN_LAST and "(" in before and not stops(before) and not closes(before) and _SIGN.search(f"{before} {line}") and not _page_line(line):
                signed = True
                k -= 1
            elif not (_page_line(line) or closes(line) or _DATE_LINE.match(line) or k and self._aside(line, before)):
                break
            k -= 1
        return k, signed

    def _aside(self, line: str, before: str) -> bool:
        if stops(line):
            return False
        if _HEADING.match(line) or len(line) <= self.titled.longest and (self.titled(line) or self.repeated(line)):
            return True
        return self.closes.goes_on(before, line)

    def verdict(self, k: int, signed: bool) -> str:
        if signed:
            return CUT
        return WHOLE if k < 0 or k == 0 and self.titled(self[0]) else abrupt(self[k])


def ending(text: str, closes: Closings, titled: Heads) -> tuple[str, list[tuple[int, str]]]:
    """How the record's own text ends, and, unless it is whole, the last lines upwards that its source may turn out to repeat: (key, how the text ends without it and all below)."""
    lines = _Rows(text, closes, titled)
    k, signed = lines.own(len(lines.raw) - 1, False)
    first = lines.verdict(k, signed)
    above: list[tuple[int, str]] = []
    if first != WHOLE and not signed:
        said = first
        while k >= 0 and said != WHOLE:
            key = line_key(_frame(lines[k]))
            k, signed = lines.own(k - 1, False)
            said = lines.verdict(k, signed)
            above.append((key, said))
            if signed:
                break
    return first, above


def _own(documents: DataFrame) -> DataFrame:
    return documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("text").cast("string").alias("text")).where("doc_id is not null")


def prefix_keys(text: str) -> list[int]:
    """Hashes of the text's prefixes of each of LEVELS that it reaches."""
    return [hash64(text[:n]) for n in LEVELS if len(text) >= n]


def endings(documents: DataFrame) -> DataFrame:
    """(doc_id, source, ending, keys) of every document that has text.

    Two passes over the texts: one learns which lines close texts, the other reads the endings. Texts that do not
    end whole then meet the lines that their own source repeats at its ends.
    """
    titled = title_heads(documents)
    counts = staged(tail_counts(documents, titled))
    closes = learned_closings(counts)
    types = {"doc_id": pa.int64(), "source": pa.string(), "ending": pa.string(), "above": pa.list_(pa.struct([("key", pa.int64()), ("ending", pa.string())])), "keys": pa.list_(pa.int64())}

    def look(c: dict[str, list]) -> dict[str, list]:
        both = [ending(t, closes, titled) for t in c["text"]]
        return {"doc_id": c["doc_id"], "source": c["source"], "ending": [x for x, _ in both], "above": [[{"key": k, "ending": e} for k, e in a] for _, a in both], "keys": [prefix_keys(t) for t in c["text"]]}

    schema = "doc_id bigint, source string, ending string, above array<struct<key:bigint,ending:string>>, keys array<bigint>"
    rows = staged(arrow_map(_own(documents).where("text is not null"), look, schema, types, rows=1024))
    doubtful = rows.where(F.size("above") > 0).select("doc_id", "source", F.xxhash64("doc_id", "source", "above").alias("row"), F.posexplode("above").alias("at", "x")).select("doc_id", "source", "row", "at", "x.key", "x.ending")
    lines = source_lines(counts).withColumnRenamed("source", "s").withColumnRenamed("key", "k")
    hits = doubtful.join(lines, (F.col("key") == F.col("k")) & F.col("source").eqNullSafe(F.col("s"))).groupBy("row").agg(F.array_sort(F.collect_set(F.struct("at", "ending"))).alias("hits"))
    # as many lines as follow one another from the last own one are put aside
    run = F.filter("hits", lambda x, i: x["at"] == i)
    known = rows.withColumn("row", F.xxhash64("doc_id", "source", "above")).join(hits.withColumn("run", run).where("size(run) > 0").select("row", F.element_at("run", -1)["ending"].alias("then")), "row", "left")
    return known.select("doc_id", "source", F.coalesce("then", "ending").alias("ending"), "keys")


def longer_copies(documents: DataFrame, ends: DataFrame | None = None, whole_too: bool = True) -> DataFrame:
    """(doc_id, longer_id): records whose text is a strict prefix of a longer text; one longer record each.

    Records asked about are all, or those whose ending is not whole; the longer copy may be any record.
    Each is compared at the longest of LEVELS within its length, with all records that share its prefix of
    that length. Copies of one text count once. Records below the shortest level have no prefix to hash and
    are left out, as are null texts. ``ends`` saves the pass of endings().
    """
    base = (endings(documents) if ends is None else ends).where(F.size("keys") > 0)
    asked = (base if whole_too else base.where(F.col("ending") != WHOLE)).select("doc_id", F.size("keys").alias("level"), F.element_at("keys", -1).alias("key"))
    # only hashes are spread over the levels; texts follow for records that share a prefix with one asked about
    spread = base.select("doc_id", F.posexplode("keys").alias("level", "key")).withColumn("level", F.col("level") + 1).join(asked.select("level", "key").distinct(), ["level", "key"], "left_semi")
    shared = spread.groupBy("level", "key").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a < b").select("level", "key")
    members = staged(spread.join(shared, ["level", "key"], "left_semi"))
    # only texts whose identifier falls into a bucket of a member are moved; there are at most BUCKETS of these
    bucket = F.pmod(F.xxhash64("doc_id"), F.lit(BUCKETS)).cast("int")
    wanted = members.select(bucket.alias("bucket")).distinct()
    few = _own(documents).where("text is not null").select("doc_id", "text", bucket.alias("bucket")).join(F.broadcast(wanted), "bucket", "left_semi").drop("bucket")
    texts = members.join(few, "doc_id")
    one = texts.groupBy("level", "key", "text").agg(F.min("doc_id").alias("longer_id"))
    after = _before_longer(one)
    found = texts.join(after.select("level", "key", "text", "longer_id"), ["level", "key", "text"])
    return found.join(asked, ["doc_id", "level", "key"], "left_semi").groupBy("doc_id").agg(F.min("longer_id").alias("longer_id"))


def _before_longer(texts: DataFrame) -> DataFrame:
    """(level, key, text, longer_id): texts (level, key, text, longer_id) that begin the next one in order, whose longer_id is given.

    Among distinct texts in order, a strict prefix of any begins the one right after it. The order is by ranges
    over all groups, so a prefix that very many texts share is spread over tasks like any other; the first and
    last text of each range, which is all that the ranges need to know of one another, are compared afterwards.
    """
    many = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kept = ["level", "key", "text", "longer_id"]

    def walk(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, edge = TaskContext.get().partitionId(), None, True

        def rows(out: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), (pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.int32(), pa.int32()), strict=True)], names=[*kept, "part", "edge"])

        for batch in batches:
            out = []
            for row in zip(*(batch.column(c).to_pylist() for c in kept), strict=True):
                if edge:
                    out.append((*row, part, 0))
                    edge = False
                elif last[:2] == row[:2] and row[2].startswith(last[2]):
                    out.append((*last[:3], row[3], part, 1))
                last = row
            if out:
                yield rows(out)
        if last:
            yield rows([(*last, part, 2)])

    ordered = texts.select(F.col("level").cast("int").alias("level"), *kept[1:]).repartitionByRange(many, "level", "key", "text").sortWithinPartitions("level", "key", "text")
    found = staged(ordered.mapInArrow(walk, "level int, key bigint, text string, longer_id bigint, part int, edge int"))
    ends = found.where("edge <> 1")
    # two rows for each range
    w = Window.orderBy("part", "edge")
    lead = {f"n_{c}": F.lead(c).over(w) for c in ("level", "key", "text", "longer_id", "edge")}
    across = ends.withColumns(lead).where("edge = 2 AND n_edge = 0 AND level = n_level AND key = n_key AND startswith(n_text, text)").select("level", "key", "text", F.col("n_longer_id").alias("longer_id"))
    return found.where("edge = 1").select(*kept).unionByName(across)


def truncated(documents: DataFrame) -> DataFrame:
    """(doc_id, source, ending, longer_id): every record, its ending, and a longer copy of an open or cut one."""
    ends = endings(documents)
    longer = longer_copies(documents, ends, whole_too=False)
    return ends.drop("keys").join(longer, "doc_id", "left").withColumn("cut", (F.col("ending") == CUT) | ((F.col("ending") == OPEN) & F.col("longer_id").isNotNull()))


def found(documents: DataFrame) -> DataFrame:
    """(doc_id): records whose own text is cut off. Null and blank texts are no cases; repeated rows come out once."""
    return truncated(documents).where("cut").select("doc_id").distinct()


def rates(documents: DataFrame) -> DataFrame:
    """(source, records, cut_off, share, with_longer_copy) of each source."""
    all_rows = _own(documents).groupBy("source").agg(F.countDistinct("doc_id").alias("records"))
    cut = truncated(documents).where("cut").groupBy("source").agg(F.countDistinct("doc_id").alias("cut_off"), F.countDistinct(F.when(F.col("longer_id").isNotNull(), F.col("doc_id"))).alias("with_longer_copy"))
    both = all_rows.join(cut, all_rows["source"].eqNullSafe(cut["source"]), "left").select(all_rows["source"], "records", F.coalesce("cut_off", F.lit(0)).alias("cut_off"), F.coalesce("with_longer_copy", F.lit(0)).alias("with_longer_copy"))
    return both.withColumn("share", F.round(F.col("cut_off") / F.col("records"), 6))
