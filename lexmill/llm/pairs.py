"""Problem 3: defective question-answer pairs, by ordered rules over the answer and its question."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm.language import languages_of
from lexmill.llm.text import arrow_map, bare_words

EMPTY, COPY, REFUSAL, OTHER_LANGUAGE, TRUNCATED = "empty", "copy", "refusal", "other_language", "truncated"
#: The order in which one defect is chosen where several rules fire.
ORDER = (EMPTY, COPY, REFUSAL, OTHER_LANGUAGE, TRUNCATED)

# Marks that stand for "nothing".
NOTHING = frozenset("na n a null none nil neant vide rien ras s o aucune aucun nan undefined nothing empty nada ninguna vacio ninguno لا شيء فارغ لا يوجد".split()) | {"sans objet", "sans reponse", "no answer", "sin respuesta", "لا شيء", "بدون جواب", "غير متوفر", "pas de reponse"}

# Phrases by which an assistant declines, in letters only, without case and accents.
REFUSALS = re.compile(
    "|".join(
        [
            r"\bje (?:ne )?(?:peux|puis|saurais|suis) pas (?:\w+ ){0,3}?(?:repondre|donner|traiter|aider|en mesure|autorise|habilite|conseil)",
            r"\bje (?:ne )?puis (?:repondre|traiter|donner)",
            r"\bje (?:prefere|dois) m abstenir", r"\bje m abstiens", r"\bje refuse de", r"\bje m en tiens la\b",
            r"\bil m est impossible", r"\bje n ai rien trouve dans mes sources", r"\b(?:mes|aucune?) sources? (?:\w+ )?ne (?:me |m )?(?:permet|autorise)", r"\bje n ai pas (?:le droit|la possibilite|acces|l autorisation)\b", r"\bje ne peux (?:rien|me prononcer)",
            r"\b(?:sort|hors) de mon (?:perimetre|domaine|champ|role)", r"\bn entre pas dans (?:les sujets|mon|mes)", r"\bdesole (?:mais )?(?:je|cette|ce)\b", r"\ben tant qu (?:assistant|ia|intelligence)",
            r"\bi (?:am|m) (?:unable|not able|sorry|afraid)", r"\bi (?:cannot|can t|can not|won t|must decline|prefer not)", r"\bsorry (?:but )?i\b", r"\bas an (?:assistant|ai)\b", r"\boutside (?:of )?my (?:scope|remit|field)", r"\bi found nothing in my sources", r"\bi have no sources?\b",
            r"\blo siento\b", r"\bno puedo (?:responder|contestar|ayudar|tratar|dar)", r"\bcomo asistente\b", r"\bfuera de mi (?:ambito|alcance)", r"\bno he encontrado nada en mis fuentes", r"\bprefiero no responder",
            r"لا يمكنني", r"\bافضل (?:عدم|الا)\b", r"لا استطيع", r"لا اقدر", r"^اعتذر", r"^عذرا", r"\bاعتذر عن", r"خارج نطاق (?:اختصاصي|عملي)", r"لا تتوفر لدي", r"لم اجد في مصادري", r"لا اجيب", r"يتعذر علي", r"بصفتي مساعدا", r"^اسف",
        ]
    )
)

# Words one of which is in every refusal.
_TRIGGERS = frozenset(
    "peux puis saurais suis abstenir abstiens refuse tiens impossible sources source ai perimetre domaine champ role sujets mon mes desole assistant ia intelligence "
    "am m cannot can not won must prefer sorry afraid unable outside nothing siento puedo asistente fuera encontrado prefiero "
    "يمكنني استطيع اقدر افضل اعتذر عذرا خارج تتوفر اجد اجيب يتعذر بصفتي اسف".split()
)
_SIGN_LAST = frozenset("]….\ufffd,،;؛:-–—")
_SIGN = re.compile(r"(?:\[ ?(?:\.\.\.|…) ?\]|\.\.\.|…|\ufffd|[,،;؛:\-–—])$")
_NOTE = re.compile(r"\((?:voir|cf|see|ver|انظر)[^()]*\)$")
_INNER = re.compile(r"(?:paiement de|devis de|dépasse|somme de|أداء|النزاع|payment of|pago de) \d{1,3}\.$|\b(?:n|art|M|Mme|Me|cf|p)\.$")
_SHORT = re.compile(r"^(?:le|el|on|في|يوم)? ?[\d٠-٩][\d٠-٩/., -]*+\w*(?: [\d٠-٩]{4})?\.?$|^\w+\.?$", re.IGNORECASE)
_PAIRS = (("«", "»"), ("(", ")"), ("[", "]"), ("“", "”"), ("{", "}"))
_SENTENCE_END = re.compile(r"[.!?؟۔](?=\s|$)")


def empty(answer: str | None, words: list[str] | None = None) -> bool:
    """No answer, no word of content, or a mark for nothing."""
    words = bare_words(answer or "") if words is None else words
    return not words or len(words) <= 3 and (" ".join(words) in NOTHING or all(w in NOTHING for w in words))


def copied(question: str, answer: str, words: list[str] | None = None) -> bool:
    """Only the question again: inside a frame before it no longer than half of it or five words, once or more, nothing after it.

    A question of one or two words is only copied without a frame.
    """
    q, a = bare_words(question), bare_words(answer) if words is None else words
    if not q or len(a) < len(q) or a[-len(q) :] != q:
        return False
    rest, k = 0, 0
    while k < len(a):
        if a[k : k + len(q)] == q:
            k += len(q)
        else:
            k, rest = k + 1, rest + 1
    return rest <= (max(5, len(q) // 2) if len(q) > 2 else 0)


def refused(answer: str, words: list[str] | None = None) -> bool:
    """Declines to answer: a phrase of refusal in the first sentence, or the last one, of an answer of any length; anywhere in one of two sentences or three."""
    words = bare_words(answer) if words is None else words
    if _TRIGGERS.isdisjoint(words) or not REFUSALS.search(" ".join(words)):
        return False
    ends = [m.end() for m in _SENTENCE_END.finditer(answer)]
    if len(ends) <= 3:
        return True
    first, last = answer[: ends[0]], answer[ends[-2] :]
    return bool(REFUSALS.search(" ".join(bare_words(first))) or REFUSALS.search(" ".join(bare_words(last))))


def _ended(text: str) -> bool:
    """Whether the text ends in a stop, which quotes, brackets or a short quoted or bracketed remark may follow."""
    core = text.rstrip(" »”\"')]")
    if core[-1:] in STOPS:
        return True
    for a, b in (("«", "»"), ("(", ")")):
        if text.endswith(b) and (at := text.rfind(a)) > 0 and text[:at].rstrip()[-1:] in STOPS:
            return True
    return False


STOPS = frozenset(".!?؟۔")


def truncated(answer: str) -> bool:
    """Stops in mid-word or mid-sentence. A number, a date or a single word is a whole short answer."""
    text = core = " ".join(answer.split())
    while core[-1:] in "])":  # references after the end
        at = core.rfind("[" if core[-1] == "]" else "(") if core else -1
        if at < 0 or not (core[at + 1 : -1].isdigit() if core[-1] == "]" else _NOTE.match(core, at)):
            break
        core = core[:at].rstrip()
    if core[-1:] in _SIGN_LAST and _SIGN.search(core):
        return True
    if _ended(core):
        if core.endswith(".") and _INNER.search(core):
            return True
        return any(text.count(a) > text.count(b) for a, b in _PAIRS)
    return not (_SHORT.match(core) and any(c.isdigit() for c in core))


def defects(question: str | None, answer: str | None, asked: str | None = None, said: str | None = None) -> list[str]:
    """Every defect that a rule finds, in the order of ORDER. ``asked`` and ``said``: the languages, where known."""
    words = bare_words(answer or "")
    if empty(answer, words):
        return [EMPTY]
    out = []
    if question and copied(question, answer, words):
        out.append(COPY)
    if refused(answer, words):
        out.append(REFUSAL)
    if asked and said and asked != said:
        out.append(OTHER_LANGUAGE)
    if truncated(answer):
        out.append(TRUNCATED)
    return out


def pairs_of(examples: DataFrame, messages: DataFrame) -> DataFrame:
    """(pair_id, question, answer): fine-tuning examples, and assistant messages with what they reply to.

    The join is on message_id; a repeated assistant message comes out once for each distinct text of it. Where
    copies of a question differ, the one received last counts, of these the greatest text. Messages that reply to
    nothing, or to no message that is there, have a null question.
    """
    a = examples.select(F.col("example_id").cast("string").alias("pair_id"), F.col("question").cast("string").alias("question"), F.col("answer").cast("string").alias("answer"))
    said = messages.where("role = 'assistant'").select(F.col("message_id").cast("string").alias("pair_id"), F.col("reply_to").cast("string").alias("reply_to"), F.col("content").cast("string").alias("answer")).distinct()
    when = F.col("received_at").cast("timestamp") if "received_at" in messages.columns else F.lit(None).cast("timestamp")
    asked = messages.where("role = 'user' AND message_id IS NOT NULL").groupBy(F.col("message_id").cast("string").alias("reply_to")).agg(F.max(F.struct(when.alias("at"), F.col("content").cast("string").alias("question")))["question"].alias("question"))
    b = said.where("reply_to is not null").join(asked, "reply_to", "left").select("pair_id", "question", "answer")
    c = said.where("reply_to is null").select("pair_id", F.lit(None).cast("string").alias("question"), "answer")
    return a.unionByName(b).unionByName(c)


def flagged(pairs: DataFrame) -> DataFrame:
    """(pair_id, defect, defects): each defective pair with the first defect and all of them.

    A null answer is empty. A null question leaves out the rules that compare with it. A null pair_id comes
    out as null. Repeated rows come out once; where copies of one pair differ, the first defect of all counts.
    """
    types = {"pair_id": pa.string(), "defect": pa.string(), "defects": pa.list_(pa.string())}

    def check(cols: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {k: [] for k in types}
        asked, said = (languages_of([x or "" for x in cols[k]]) for k in ("question", "answer"))
        for key, q, a, x, y in zip(cols["pair_id"], cols["question"], cols["answer"], asked, said, strict=True):
            if found := defects(q, a, x, y):
                out["pair_id"].append(key)
                out["defect"].append(found[0])
                out["defects"].append(found)
        return out

    rows = arrow_map(pairs.select("pair_id", "question", "answer"), check, "pair_id string, defect string, defects array<string>", types, rows=4096)
    rank = F.array_position(F.array(*[F.lit(x) for x in ORDER]), F.col("defect"))
    return rows.groupBy("pair_id").agg(F.min_by("defect", rank).alias("defect"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("defects")))).alias("defects"))


def found(examples: DataFrame, messages: DataFrame) -> DataFrame:
    return flagged(pairs_of(examples, messages)).select("pair_id", "defect")
