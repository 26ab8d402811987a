"""Problem 2: personal data in free text, by a semi-Markov conditional random field.

Segments of text are scored as wholes, by features of the segment (shape, letters at the beginnings and ends
of its words, length) and of the words around it; dynamic programming over the segments of a stretch of text
chooses boundaries and types together, so that a name inside an address or an e-mail address is not found
twice. Only segments that could be an item enter: those of the shape of a number, address or e-mail address,
and runs of at most MOST_WORDS words (the bound on an entity that the dynamic programming needs) that look
like a name or follow a form of address. The weights maximise the likelihood of the segmentations, summed over
all others by the forward-backward recursions of ``python -m lexmill.llm.train_pii``, and are stored beside
this module.
"""

from __future__ import annotations

import functools
import json
import os
import re
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm import text as _text
from lexmill.llm.text import arrow_map

TYPES = ("nom", "cin", "telephone", "email", "adresse")
PLACEHOLDERS = {"nom": "[NOM]", "cin": "[CIN]", "telephone": "[TELEPHONE]", "adresse": "[ADRESSE]", "email": "[EMAIL]"}
MODEL = os.path.join(os.path.dirname(__file__), "models", "pii.json")
#: Words of a name at most.
MOST_WORDS = 6

_D = "0-9٠-٩"
# A blank or line break; inside an item a wrapped line may break there.
_S = r"[ \n\xa0]"
_TOWN = r"(?:[A-ZÉÈ][\w'’@|]*(?:[-‐]\n?[A-ZÉÈ][\w'’@|]*)*)"
_EMAIL = re.compile(r"(?<![\w.+-])[\w+-][\w.+-]*+(?:-\n[\w.+-]+)?[ \n]?(?:@|\(at\)|\[at\]|\( ?at ?\)|\[ ?at ?\])[ \n]?[\w-]+(?:(?:-\n|\.\n?|\n\.)[\w-]+)*\.\n?[a-z]{2,10}\b", re.IGNORECASE)
_PHONE = re.compile(rf"(?<![\w/.,:-])(?:(?:\+|00)212(?:[ .\n-]?\(0\))?[ .\n-]?[{_D}](?:[ .\n-]?[{_D}]){{8}}|[0٠](?:[ .\n-]?[{_D}]){{9}})(?![\w/])")
_ABROAD = re.compile(r"(?<![\w/.,:+-])(?:\+|00)(?!212)[1-9][0-9]{0,2}(?:[ .\n-]?\(?[0-9]{1,4}\)?){2,6}(?![\w/])")
_CIN = re.compile(rf"(?<![\w@./-])[A-Za-z]{{1,2}}(?:[- ]|\n|-\n)?[{_D}]{{5,6}}(?![\w/@])")
_STREET_FR = r"(?:rue|avenue|av\.|Bd|bd|boulevard|Boulevard|Avenue|Rue|place|Place|impasse|Impasse|route|allée)"
_ADDRESS = re.compile(
    rf"(?:\d{{1,4}}(?:{_S}(?:bis|ter|quater))?,?{_S}{_STREET_FR}{_S}(?:[^,.;\n]|\n){{2,60}}?,{_S}(?:(?:appt|app\.|apt|étage|n°|porte){_S}\w+,{_S})?(?:\d{{5}}{_S})?{_TOWN}"
    rf"|(?:Hay|Quartier|Lotissement|Lot\.|Résidence|Immeuble|Cité){_S}(?:[^,.;\n]|\n){{2,50}}?,{_S}(?:(?:bloc|immeuble|villa|imm\.|n°|appt|lot){_S}?(?:n°{_S})?\w+,{_S}){{1,3}}{_TOWN}"
    rf"|Douar{_S}(?:[^,.;\n]|\n){{2,40}}?,{_S}commune{_S}de{_S}{_TOWN}"
    rf"|\d{{1,4}}[A-Za-z]?,?{_S}(?:[A-Z][\w'’-]+{_S}){{1,4}}(?:Street|Road|Avenue|Lane|Drive|Square|Terrace|Gardens|Boulevard|Crescent)\b(?:,{_S}(?:(?:flat|apartment|floor|unit){_S}\w+,{_S})?{_TOWN}(?:{_S}{_TOWN}){{0,2}})?"
    rf"|(?:Calle|Avenida|Avda\.|Plaza|Paseo|Carrera|Camino|Ronda)(?:{_S}(?:de|del|la|las|los|el|y)){{0,2}}(?:{_S}(?:(?:de|del|la|las|los|el|y){_S}){{0,2}}[A-ZÁÉÍÓÚÑ][\w'’-]*){{1,4}},?{_S}(?:n\.?º?{_S}?)?\d{{1,4}}\b(?:,{_S}(?:piso{_S}\w+,{_S})?(?:\d{{5}}{_S})?{_TOWN}(?:{_S}{_TOWN}){{0,2}})?"
    rf"|(?<![ء-ي])(?:شارع|زنقة|حي|دوار|إقامة|تجزئة|درب|ساحة){_S}[^،,.؛]{{2,60}}?[،,]{_S}?(?:جماعة{_S})?[ء-ي][ء-ي{_D}]*)"
)
_WORD = re.compile(r"[^\W_](?:[\w@|]|['’](?=\w))*(?:[-‐¬­]\n?[^\W\d_][\w@|]*)*", re.UNICODE)
# A word that goes on in the next line.
_BROKEN = re.compile(r"(?<!\w)\w++[-‐¬­]\n[^\W\d_][\w@|]*+")
_GAP = re.compile(r"[ \xa0]{1,2}| ?\n")
_INITIAL_GAP = re.compile(r"\.[ \n\xa0]?")
_FIX_LATIN = str.maketrans("0134567@|", "oieasbtai")
_FIX_ARABIC = str.maketrans("190765", "اوهحةه")


def bare(word: str) -> str:
    """A word without case and accents; Arabic letters keep their hamza, which tells names from articles."""
    return word if "؀" <= word[:1] <= "ۿ" else _text.bare(word)


# Words after which, or after whose line end, a person is named.
CUES = frozenset(
    bare(w)
    for w in (
        "M Mme Mlle Me Mr Dr Maître Monsieur Madame Mademoiselle feu salarié salariée témoin Bénéficiaire prénom ENTRE "
        "السيد السيدة للسيد للسيدة الأستاذ الأستاذة المرحوم المرحومة الأجير الأجيرة الشاهد الشاهدة الكامل إفادة صرح صرحت وعقب وأضاف "
        "Mr Mrs Ms Miss witness Señor Señora Sr Sra Don Doña testigo"
    ).split()
)
# Offices and other words that a form of address may precede and that name nobody.
OFFICES = frozenset(
    bare(w)
    for w in (
        "Président Présidente Juge Conservateur Conservatrice Greffier Greffière Notaire Directeur Directrice Ministre Procureur Maire Gouverneur Commissaire Expert Adoul Avocat d'ouvrage le la les l un une "
        "رئيس الرئيس المحكمة القاضي المحافظ كاتب العدل الوكيل وكيل مدير المدير والي عامل وزير President Judge Registrar"
    ).split()
)


def shape(word: str) -> str:
    if not word:
        return "none"
    if "؀" <= word[0] <= "ۿ":
        return "arabic"
    if word.isdigit():
        return "digits"
    letters = [c for c in word if c.isalpha()]
    if not letters:
        return "sign"
    if len(letters) == 1:
        return "initial" if letters[0].isupper() else "letter"
    if all(c.isupper() for c in letters):
        return "upper"
    if letters[0].isupper():
        return "title" if not any(c.isdigit() for c in word) else "mixed"
    return "lower"


@functools.lru_cache(maxsize=200_000)
def stem(word: str) -> str:
    """A word without case, accents and line breaks, misread digits put right."""
    x = bare(re.sub(r"[-‐¬­]\n|\n", "-" if word[:1].isupper() and re.search(r"[-‐]\n?[A-Z]", word) else "", word))
    if any(c.isdigit() or c in "@|" for c in x) and any(c.isalpha() for c in x):
        x = x.translate(_FIX_ARABIC if any("؀" <= c <= "ۿ" for c in x) else _FIX_LATIN)
    return x


@functools.lru_cache(maxsize=200_000)
def letters_of(word: str) -> tuple[str, ...]:
    """Features of the letters of one word of a name."""
    x = stem(word)
    return (f"pre3={x[:3]}", f"pre4={x[:4]}", f"suf3={x[-3:]}", f"suf4={x[-4:]}", f"suf5={x[-5:]}", f"shape={shape(word)}", f"len={min(len(x), 12)}")


class Worth(dict):
    """Whether a space-separated word makes its line worth a look for names; emptied when it grows large."""

    def __init__(self, model: Model) -> None:
        super().__init__()
        self.model = model

    def __missing__(self, word: str) -> bool:
        if len(self) > 400_000:
            self.clear()
        x = self[word] = self.model.namelike(word) or any(stem(w) in CUES or self.model.namelike(w) for w in _WORD.findall(word))
        return x


#: Small words inside names.
PARTICLES = frozenset("de la las los del el al ben bin ibn ould ait van von der den da do dos du des y e le".split())


class Model:
    """Weights and the words that, by their letters alone, may be part of a name. Sums over the features of a word are kept."""

    def __init__(self, w: dict[str, float]) -> None:
        self.w = w
        self.limit = w.get("namelike", 1.0)
        self.memo: dict[str, bool] = {}
        self.words: dict[str, tuple[float, ...]] = {}
        self.worth = Worth(self)

    def namelike(self, word: str) -> bool:
        known = self.memo.get(word)
        if known is None:
            if len(self.memo) > 400_000:
                self.memo.clear()
            core = word.strip("«»\"'“”()[].,;:،؛!?؟")
            known = self.memo[word] = self._namelike(core)
        return known

    def _namelike(self, word: str) -> bool:
        if len(word) < 4 or any(c in "@/" for c in word[1:-1]) and not word.replace("@", "").isalpha() or sum(c.isdigit() for c in word) > 2:
            return False
        if "؀" <= word[0] <= "ۿ" and word[0] == "و" and self._namelike(word[1:]):
            return True
        return sum(self.w.get(f"like.{f}", 0.0) for f in letters_of(word) if not f.startswith(("shape", "len"))) > self.limit

    def sum(self, kind: str, fs: Iterable[str]) -> float:
        get = self.w.get
        return sum(get(f"{kind}.{f}", 0.0) for f in fs)

    def word(self, w: str) -> tuple[float, ...]:
        """What the word adds anywhere in a name, as its first word and as its last."""
        known = self.words.get(w)
        if known is None:
            if len(self.words) > 400_000:
                self.words.clear()
            known = self.words[w] = tuple(self.sum("nom", fs) for fs in word_features(w))
        return known


Candidate = tuple[int, int, str, tuple[tuple[int, int], ...]]


def side(text: str, at: int, left: bool) -> list[str]:
    """Features of the two words before or after a place, and of the sign there."""
    out: list[str] = []
    k = at
    while len(out) < 2:
        if left:
            end = k
            while end and text[end - 1].isspace():
                end -= 1
            if not end:
                break
            k = max(text.rfind(" ", 0, end), text.rfind("\n", 0, end)) + 1
            out = [*(stem(m[0]) for m in _WORD.finditer(text, k, end)), *out]
        else:
            while k < len(text) and text[k].isspace():
                k += 1
            if k >= len(text):
                break
            blank, line = text.find(" ", k), text.find("\n", k)
            end = min(x if x >= 0 else len(text) for x in (blank, line))
            out += [stem(m[0]) for m in _WORD.finditer(text, k, end)]
            k = end
    if left:
        a, b = ["", "", *out][-2:]
        sign = text[max(0, at - 2) : at].strip()[-1:]
        return [f"l1={b}", f"l2={a}_{b}", f"ls={sign if not sign.isalnum() else 'w'}", f"lc={b in CUES}", f"lo={b in OFFICES}"]
    a, b = [*out, "", ""][:2]
    sign = text[at : at + 2].strip()[:1]
    goes_on = text[at : at + 1] in (" ", "\n") and text[at + 1 : at + 2].isupper()
    return [f"r1={a}", f"r2={a}_{b}", f"rs={sign if not sign.isalnum() else 'w'}", f"rt={goes_on and 'name' or a in PARTICLES and 'particle' or 'no'}"]


@functools.lru_cache(maxsize=200_000)
def word_features(w: str) -> tuple[tuple[str, ...], tuple[str, ...], tuple[str, ...]]:
    """Features of a word of a name, besides these of it as the first and as the last."""
    fs = letters_of(w)
    x = stem(w)
    own = fs + (("title_inside",) if x in CUES or x in OFFICES else ()) + (("small_inside",) if x in PARTICLES and w.islower() else ())
    return own, tuple(f"first_{f}" for f in (*fs[:4], fs[5])), tuple(f"last_{f}" for f in (*fs[:4], fs[5]))


def frame_features(text: str, spans: tuple[tuple[int, int], ...]) -> list[str]:
    """Features of a run of words as a whole."""
    fs = ["shapes=" + "_".join("small" if text[a:b] in PARTICLES else shape(text[a:b]) for a, b in spans), f"words={len(spans)}"]
    for (_, x), (y, _) in zip(spans, spans[1:]):
        fs.append("gap=" + ("break" if "\n" in text[x:y] else "dot" if "." in text[x:y] else "blank"))
    return fs


def item_features(kind: str, text: str, a: int, b: int) -> list[str]:
    """Features of a segment of another type."""
    value = text[a:b]
    form = re.sub(r"[A-Za-z]+", lambda m: "A" * min(len(m[0]), 3), re.sub(rf"[{_D}]+", "0", value))
    return [f"form={form[:12]}", f"head={stem(value.split()[0]) if value.split() else ''}" if kind == "adresse" else f"code={re.sub(r'[^A-Za-z]', '', value).upper()}" if kind == "cin" else "item"]


def features(text: str, c: Candidate) -> list[str]:
    """All features of a candidate."""
    a, b, kind, spans = c
    fs = ["bias", *side(text, a, True), *side(text, b, False)]
    if kind != "nom":
        return fs + item_features(kind, text, a, b)
    fs += frame_features(text, spans)
    for k, (x, y) in enumerate(spans):
        own, first, last = word_features(text[x:y])
        fs += own + (first if k == 0 else ()) + (last if k == len(spans) - 1 else ())
    if text[a - 1 : a] == "و":
        fs.append("waw_before")
    return fs


def scored(text: str, found: list[Candidate], model: Model) -> list[tuple[int, int, str, float]]:
    """Candidates with the sum of the weights of their features, each part added up once."""
    left: dict[tuple[str, int], float] = {}
    right: dict[tuple[str, int], float] = {}
    out = []
    for a, b, kind, spans in found:
        if (x := left.get((kind, a))) is None:
            x = left[kind, a] = model.sum(kind, side(text, a, True)) + model.w.get(f"{kind}.bias", 0.0)
        if (y := right.get((kind, b))) is None:
            y = right[kind, b] = model.sum(kind, side(text, b, False))
        if kind != "nom":
            out.append((a, b, kind, x + y + model.sum(kind, item_features(kind, text, a, b))))
            continue
        words = [model.word(text[i:j]) for i, j in spans]
        total = x + y + model.sum("nom", frame_features(text, spans)) + sum(w[0] for w in words) + words[0][1] + words[-1][2]
        if text[a - 1 : a] == "و":
            total += model.w.get("nom.waw_before", 0.0)
        out.append((a, b, kind, total))
    return out


def candidates(text: str, model: Model) -> list[Candidate]:
    """(start, end, type, spans of the words) of every segment that could be an item."""
    out: list[Candidate] = []
    has_at = "@" in text or "at)" in text.lower() or "at]" in text.lower()
    if has_at:
        out += [(m.start(), m.end(), "email", ()) for m in _EMAIL.finditer(text)]
    for kind, pattern in (("telephone", _PHONE), ("cin", _CIN), ("adresse", _ADDRESS)):
        if kind != "adresse" or any(w in text for w in STREETS):
            out += [(m.start(), m.end(), kind, ()) for m in pattern.finditer(text)]
    if "+" in text or "00" in text:
        out += [(m.start(), m.end(), "telephone", ()) for m in _ABROAD.finditer(text) if 8 <= sum(map(str.isdigit, m[0])) <= 15]
    # names: words that look like parts of one, and words after a form of address
    get = model.worth.__getitem__
    broken = [m.start() for m in _BROKEN.finditer(text) if get(m[0])]
    if broken or any(map(get, text.split())):
        lines = text.split("\n")
        hit = [any(map(get, x.split())) for x in lines]
        for a in broken:
            k = text.count("\n", 0, a)
            hit[k] = hit[k + 1] = True
        # a name may go on in the next line, and its form of address may stand in the one before
        near = [any(hit[max(0, k - 1) : k + 2]) for k in range(len(lines))]
        at, begin = 0, -1
        for k, x in enumerate(lines):
            if near[k] and begin < 0:
                begin = at
            at += len(x) + 1
            if begin >= 0 and (k + 1 == len(lines) or not near[k + 1]):
                out += name_candidates(text, model, begin, min(at, len(text)))
                begin = -1
    return out


# One of these is in every address.
STREETS = ("Street", "Road", "Lane", "Drive", "Square", "Terrace", "Gardens", "Crescent", "Calle", "Avenida", "Avda.", "Plaza", "Paseo", "Carrera", "Camino", "Ronda", "rue", "venue", "av.", "Bd", "bd", "oulevard", "lace", "mpasse", "route", "allée", "Hay", "Quartier", "Lot", "Résidence", "Immeuble", "Cité", "Douar", "شارع", "زنقة", "حي", "دوار", "إقامة", "تجزئة", "درب", "ساحة")


def name_candidates(text: str, model: Model, begin: int = 0, end: int | None = None) -> list[Candidate]:
    """Runs of words between two places that could be names: around a word that looks like part of one, or from a form of address on."""
    spans = [m.span() for m in _WORD.finditer(text, begin, len(text) if end is None else end)]
    words = [text[a:b] for a, b in spans]
    like = [model.namelike(w) for w in words]
    seen: set[tuple[int, int]] = set()
    out: list[Candidate] = []

    def joined(k: int) -> bool:
        gap = text[spans[k][1] : spans[k + 1][0]]
        return bool(_GAP.fullmatch(gap) or len(words[k]) == 1 and _INITIAL_GAP.fullmatch(gap))

    def add(i: int, j: int) -> None:
        a, b = spans[i][0], spans[j][1]
        own = tuple(spans[i : j + 1])
        # where the conjunction is written together with the name, both readings enter
        for shift in (0, 1) if words[i][0] == "و" and len(words[i]) > 4 and like[i] else (0,):
            if (a + shift, b) not in seen:
                seen.add((a + shift, b))
                out.append((a + shift, b, "nom", ((a + shift, own[0][1]), *own[1:]) if shift else own))

    for k in range(len(words)):
        if like[k]:
            for i in range(k, max(-1, k - MOST_WORDS), -1):
                if i < k and not joined(i):
                    break
                for j in range(k, min(len(words), i + MOST_WORDS)):
                    if j > k and not joined(j - 1):
                        break
                    extra = [q for q in range(i, j + 1) if not like[q]]
                    if len(extra) > 1 or any(words[q].isdigit() for q in extra):
                        break
                    add(i, j)
        if k and stem(words[k - 1]) in CUES and stem(words[k]) not in OFFICES and shape(words[k]) in ("title", "upper", "arabic", "initial"):
            latin = shape(words[k]) != "arabic"
            for j in range(k, min(len(words), k + MOST_WORDS)):
                if j > k and not joined(j - 1) or words[j].isdigit():
                    break
                # in Latin script only small words stand within a name; in Arabic one word more may belong to it
                if j > k and not like[j] and (words[j][0].islower() and words[j] not in PARTICLES if latin else j > k + 1):
                    break
                if not latin or words[j] not in PARTICLES:
                    add(k, j)
    return out


def best(segments: list[tuple[int, int, str, float]]) -> list[tuple[int, int, str]]:
    """The non-overlapping segments with the highest total score; text outside them scores nothing."""
    order = sorted((s for s in segments if s[3] > 0), key=lambda s: (s[1], s[0]))
    ends = [s[1] for s in order]
    import bisect

    value = [0.0] * (len(order) + 1)
    take: list[bool] = [False] * (len(order) + 1)
    before = [0] * (len(order) + 1)
    for k, (a, _, _, x) in enumerate(order, 1):
        before[k] = bisect.bisect_right(ends, a, 0, k - 1)
        with_it = value[before[k]] + x
        take[k] = with_it > value[k - 1]
        value[k] = with_it if take[k] else value[k - 1]
    out, k = [], len(order)
    while k:
        if take[k]:
            out.append(order[k - 1][:3])
            k = before[k]
        else:
            k -= 1
    return out[::-1]


@functools.cache
def model() -> Model:
    with open(MODEL, encoding="utf-8") as f:
        return Model(json.load(f))


def items(text: str, m: Model | None = None) -> list[tuple[int, int, str]]:
    """(start, end, type) of the items of one text, in order."""
    m = m or model()
    return best(scored(text, candidates(text, m), m))


def masked(text: str, found: list[tuple[int, int, str]]) -> str:
    """The text with typed placeholders, all else unchanged."""
    out, last = [], 0
    for a, b, kind in found:
        out += [text[last:a], PLACEHOLDERS[kind]]
        last = b
    return "".join([*out, text[last:]])


def _own(documents: DataFrame) -> DataFrame:
    return documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))


def spans(documents: DataFrame) -> DataFrame:
    """(doc_id, pii_type, start_pos, end_pos, value). Null and blank texts have none; repeated rows come out once."""
    types = {"doc_id": pa.int64(), "pii_type": pa.string(), "start_pos": pa.int64(), "end_pos": pa.int64(), "value": pa.string()}

    def find(cols: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {k: [] for k in types}
        for key, text in zip(cols["doc_id"], cols["text"], strict=True):
            for a, b, kind in items(text):
                for name, v in zip(out, (key, kind, a, b, text[a:b]), strict=True):
                    out[name].append(v)
        return out

    return arrow_map(_own(documents).where("doc_id is not null and text is not null"), find, "doc_id bigint, pii_type string, start_pos bigint, end_pos bigint, value string", types, rows=512).distinct()


def found(documents: DataFrame) -> DataFrame:
    return spans(documents).select("doc_id", "pii_type", "start_pos", "end_pos")


def anonymised(documents: DataFrame) -> DataFrame:
    """(doc_id, text, items): every document with its items replaced; null texts stay null."""

    def mask(cols: dict[str, list]) -> dict[str, list]:
        hits = [items(t) if t else [] for t in cols["text"]]
        return {"doc_id": cols["doc_id"], "text": [masked(t, h) if t else t for t, h in zip(cols["text"], hits, strict=True)], "items": [len(h) for h in hits]}

    return arrow_map(_own(documents), mask, "doc_id bigint, text string, items int", {"doc_id": pa.int64(), "text": pa.string(), "items": pa.int32()}, rows=512)
