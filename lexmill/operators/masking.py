"""Rule-based masking with propagation of names inside a document, as one Arrow stage per document column."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as t

TYPES = ("cin", "telephone", "email", "nom", "adresse")
STRATEGIES = ("placeholder", "redact_full", "partial", "hash")
PLACEHOLDER = {"cin": "[CIN]", "telephone": "[TELEPHONE]", "email": "[EMAIL]", "nom": "[NOM]", "adresse": "[ADRESSE]"}


@dataclass(frozen=True)
class Rule:
    """A pattern of one type; the span is group 1 if there is one."""

    kind: str
    pattern: str
    description: str
    strategy: str = "placeholder"
    compiled: re.Pattern = field(init=False, repr=False, compare=False)

    def __post_init__(self) -> None:
        if self.kind not in TYPES or self.strategy not in STRATEGIES or not self.description.strip():
            raise ValueError(f"bad rule: {self.kind}, {self.strategy}, {self.description!r}")
        object.__setattr__(self, "compiled", re.compile(self.pattern))

    def __reduce__(self):  # compiled again where it arrives
        return Rule, (self.kind, self.pattern, self.description, self.strategy)


_NAME = r"[A-ZÀ-Ý][\w'’-]+(?:\s+[A-ZÀ-Ý][\w'’-]+){0,2}"
# Arabic words that are no part of a name: verbs that follow one, function words, words of procedure. Fixed values.
NOT_IN_NAMES = (
    "تقدم", "تقدمت", "حضر", "حضرت", "أدلى", "أدلت", "رفض", "رفضت", "قدم", "قدمت", "صرح", "صرحت", "أكد", "أكدت", "طلب", "طلبت",
    "دفع", "دفعت", "تمسك", "تمسكت", "أقر", "أقرت", "ادعى", "ادعت", "استأنف", "استأنفت", "قال", "قالت", "ذكر", "ذكرت", "أجاب", "أجابت",
    "وقع", "وقعت", "التمس", "التمست", "نازع", "نازعت", "أن", "إن", "بأن", "قد", "وقد", "كان", "كانت", "لم", "لا", "ما",
    "في", "من", "على", "إلى", "عن", "مع", "بعد", "قبل", "حيث", "وحيث", "الذي", "التي", "هذا", "هذه", "ذلك", "بذلك",
    "المحكمة", "الجلسة", "الدعوى", "الحكم", "القرار", "الطلب", "الملف", "القانون", "الفصل", "المادة", "الظهير", "المغرب", "الرباط",
)
_WORD_AR = rf"(?!(?:{'|'.join(NOT_IN_NAMES)})\b)[ء-ي]{{2,}}"
_NAME_AR = rf"{_WORD_AR}(?:\s+{_WORD_AR}){{0,2}}"
#: Prefixes of references that look like identity cards. Fixed values.
NOT_CARDS = ("RC", "BO", "RG", "TP", "IF", "ICE", "TVA", "CNSS", "AMO")

RULES = (
    Rule("cin", r"(?:CIN|CNIE|C\.I\.N\.?|carte nationale|البطاقة الوطنية)[^\dA-Z]{0,12}([A-Z]{1,2}[- ]?\d{5,6})\b", "identity card after its name"),
    Rule("cin", rf"\b(?!(?:{'|'.join(NOT_CARDS)})[- ]?\d)([A-Z]{{1,2}}-?\d{{5,6}})\b", "identity card alone"),
    Rule("telephone", r"(?<![\w+])((?:\+212|00212|0)[ .-]?(?:\(0\))?[ .-]?[5-7](?:[ .-]?\d){8})(?!\d)", "telephone number", "partial"),
    Rule("email", r"([\w.+-]+@[\w-]+(?:\.[\w-]+)+)", "e-mail address"),
    Rule("nom", rf"\b((?:M\.|Mme|Mlle|Monsieur|Madame|Maître|Me)\s+(?!le\b|la\b|l['’]){_NAME})", "civility and name"),
    Rule("nom", rf"\b(?:demandeur|défendeur|demanderesse|défenderesse|requérant|requérante|témoin|appelant|intimé)\s*[:,]?\s+({_NAME})", "name after a role"),
    Rule("nom", rf"\bENTRE\s*:?\s+({_NAME})", "name after ENTRE"),
    Rule("nom", rf"(?:المدعي|المدعى عليه|الشاهد|المستأنف)\s*:\s*({_NAME_AR})", "Arabic role, colon and name"),
    Rule("nom", rf"(?:المدعي|الشاهد|المستأنف)\s+(?:السيدة|السيد)\s+({_NAME_AR})", "Arabic role, title and name"),
    Rule("adresse", r"((?:\d{1,4}(?:\s+bis)?,?\s+)?(?:rue|avenue|boulevard|Bd|quartier|résidence|lotissement|douar|hay|زنقة|شارع|حي|دوار)\s+[^.\n]{3,60}?)(?=[.,\n]|$)", "street address"),
    Rule("nom", rf"(?:السيدة|السيد|الأستاذة|الأستاذ)\s+(?!رئيس|كاتب|وكيل|القاضي|المحافظ)({_NAME_AR})", "Arabic title and name"),
)

#: Words of a name span that are not passed on to the rest of the document.
NOT_NAMES = frozenset(
    "monsieur madame mademoiselle maître président présidente tribunal cour greffe juge procureur royaume ministère commune société banque demandeur défendeur témoin requérant avocat "
    "المحكمة القاضي الرئيس المغرب المملكة وزارة جماعة شركة بنك السيد السيدة الأستاذ الأستاذة رئيس كاتب وكيل".split()
)
_PARTICLES = r"(?:(?:El|Al|Ben|Bel|Ait|Aït|Ould|Bou|Abou|De)[ -])?"
_GAP = re.compile(r"[\s'’-]{0,2}")

Span = tuple[int, int, str, int]


def detect(text: str, rules: Iterable[Rule] = RULES) -> list[Span]:
    """(start, end, type, rule) of every match of every rule."""
    out = []
    for k, r in enumerate(rules):
        for m in r.compiled.finditer(text):
            a, b = m.span(1) if r.compiled.groups and m.start(1) >= 0 else m.span()
            out.append((a, b, r.kind, k))
    return sorted(out, key=lambda s: (s[0], -s[1]))


def propagated(text: str, spans: list[Span], last_rule: int) -> list[Span]:
    """Further places of the words of names already found."""
    words = set()
    for a, b, kind, _ in spans:
        if kind == "nom":
            for w in re.findall(r"[A-ZÀ-Ý][\w'’-]{2,}|[ء-ي]{3,}", text[a:b]):
                if w.lower() not in NOT_NAMES:
                    words |= {w, w.upper()}
    if not words:
        return []
    pattern = re.compile(rf"(?<!\w){_PARTICLES}(?:{'|'.join(re.escape(w) for w in sorted(words, key=lambda w: (-len(w), w)))})(?!\w)")
    return [(m.start(), m.end(), "nom", last_rule) for m in pattern.finditer(text)]


def kept_spans(text: str, rules: tuple[Rule, ...] = RULES, propagate: bool = True) -> list[Span]:
    """Spans that are masked: names passed on, covered spans dropped, neighbouring names merged, overlaps swept from the left."""
    found = detect(text, rules)
    if propagate and found:
        found += propagated(text, found, len(rules))
    found.sort(key=lambda s: (s[0], -s[1], s[3]))
    swept: list[Span] = []
    for s in found:
        if swept and s[0] < swept[-1][1]:
            continue
        if swept and s[2] == swept[-1][2] == "nom" and _GAP.fullmatch(text[swept[-1][1] : s[0]]):
            swept[-1] = (swept[-1][0], s[1], "nom", swept[-1][3])
        else:
            swept.append(s)
    return swept


def mask_value(value: str, kind: str, strategy: str) -> str:
    if strategy == "redact_full":
        return "█" * len(value)
    if strategy == "partial":
        digits = re.sub(r"\D", "", value)
        return digits[:2] + "*" * max(0, len(digits) - 4) + digits[-2:] if len(digits) > 4 else "*" * len(digits)
    if strategy == "hash":
        return f"[{kind.upper()}:{hashlib.sha256(value.encode()).hexdigest()[:12]}]"
    return PLACEHOLDER[kind]


def anonymise(text: str | None, rules: tuple[Rule, ...] = RULES, propagate: bool = True) -> tuple[str | None, list[Span]]:
    if not text:
        return text, []
    spans = kept_spans(text, rules, propagate)
    out, last = [], 0
    for a, b, kind, k in spans:
        out += [text[last:a], mask_value(text[a:b], kind, rules[k].strategy if k < len(rules) else "placeholder")]
        last = b
    return "".join([*out, text[last:]]), spans


_SCHEMA = t.StructType(
    [
        t.StructField("text", t.StringType()),
        t.StructField("spans", t.ArrayType(t.StructType([t.StructField("start", t.IntegerType()), t.StructField("end", t.IntegerType()), t.StructField("pii_type", t.StringType()), t.StructField("rule", t.IntegerType()), t.StructField("value", t.StringType())]))),
    ]
)


def masking(rules: tuple[Rule, ...] = RULES, propagate: bool = True):
    """A pandas UDF of the text that gives struct(text, spans)."""

    @F.pandas_udf(_SCHEMA)
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in parts:
            both = [anonymise(x, rules, propagate) for x in s]
            yield pd.DataFrame({"text": [x for x, _ in both], "spans": [[(a, b, k, r, o[a:b]) for a, b, k, r in v] for (_, v), o in zip(both, s, strict=True)]})

    return run


def detections(docs: DataFrame, key: str, text: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row for each masked span."""
    return docs.select(key, masking(rules)(F.col(text)).alias("m")).select(key, F.explode("m.spans").alias("s")).select(key, "s.*")


def mask_emails(t: Column) -> Column:
    """E-mail addresses replaced in the JVM."""
    return F.regexp_replace(t, r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "[EMAIL]")


def score_cases(cases: DataFrame, output: str, must_mask: str = "must_mask", must_survive: str = "must_survive") -> DataFrame:
    """Cases with what leaked and what was damaged, and whether they pass."""
    leaked = F.filter(must_mask, lambda x: F.contains(F.col(output), x))
    damaged = F.filter(must_survive, lambda x: ~F.contains(F.col(output), x))
    return cases.withColumns({"leaked": leaked, "damaged": damaged}).withColumn("passed", (F.size("leaked") == 0) & (F.size("damaged") == 0))


def score_groups(scored: DataFrame) -> DataFrame:
    """Recall and damage by language, by family and in all; null where nothing was expected."""
    g = scored.groupingSets([["language"], ["family"], []], "language", "family")
    return g.agg(
        F.count("*").alias("cases"),
        F.round(F.try_divide(F.sum(F.size("must_mask") - F.size("leaked")), F.sum(F.size("must_mask"))), 6).alias("recall"),
        F.round(F.try_divide(F.sum(F.size("damaged")), F.sum(F.size("must_survive"))), 6).alias("damage"),
    )


def select_cases(cases: DataFrame, language: str | None = None, family: str | None = None, note: str | None = None) -> DataFrame:
    """Evaluation cases of a language, of a family, or whose note holds some words (known limits); all that are given must hold."""
    for column, value in (("language", language), ("family", family)):
        if value is not None:
            cases = cases.where(F.col(column) == value)
    return cases if note is None else cases.where(F.contains(F.lower(F.coalesce("note", F.lit(""))), F.lit(note.lower())))
