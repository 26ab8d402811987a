"""Trains the language models: ``python -m lexmill.llm.train_language DOCUMENTS.parquet``.

At most MOST_LETTERS letters of each language are used, from documents whose label names it. Labels are
partly wrong, so a first model is trained on all, and the second only on the sentences that the first
gives the language of their label. Basic sentences of each language are added, which keeps words of
everyday use in the models where the documents are few. A fifth of the documents is held out and gives the
calibration: the margin at which a sentence is told apart from its document, the scale of the confidences, and
for each language the cross-entropy beyond which a text is rejected.
"""

from __future__ import annotations

import sys
from collections import Counter

import numpy as np

from lexmill.llm.language import LANGUAGES, MODEL, Scorer, kneser_ney, label_language, lack, pack

MOST_LETTERS = 1_500_000
#: Share of held-out sentences of pure documents that may be told apart wrongly, and of held-out lines that may be rejected.
FALSE_RATE = 0.001
#: Share of held-out lines in an unknown language of the same script that may be accepted.
FALSE_ACCEPTS = 0.01
BASIC = {
    "fr": "le la les un une des du de et ou où mais donc car ni que qui quoi dont ce cet cette ces mon ton son notre votre leur dans sur sous avec sans pour par entre chez vers depuis pendant avant après très plus moins bien mal tout tous toute toutes être avoir faire aller venir voir savoir pouvoir vouloir devoir prendre donner il elle nous vous ils elles on ne pas jamais rien aussi encore déjà toujours quand comment pourquoi parce si comme alors ainsi même autre premier dernière année jour semaine mois heure ville maison travail question réponse demande contrat loi droit cour juge partie père mère enfant homme femme monde pays eau temps chose vie main fois nom est sont était étaient sera seront fut a ont avait avaient aura auront peut doit fait dit",
    "en": "the a an of and or but so because nor that which who whom whose this these those my your his her its our their in on under with without for by between at towards since during before after very more less well badly all every each be have do go come see know can will must take give he she we you they it not never nothing also again already always when how why if as then thus same other first last year day week month hour town house work question answer request contract law right court judge party father mother child man woman world country water time thing life hand name is are was were will be been has had may should would could did does said made",
    "es": "el la los las un una unos unas del de y o pero porque ni que quien cuyo este esta estos estas mi tu su nuestro vuestro en sobre bajo con sin para por entre hacia desde durante antes después muy más menos bien mal todo todos toda todas ser estar haber hacer ir venir ver saber poder querer deber tomar dar él ella nosotros ustedes ellos ellas no nunca nada también todavía ya siempre cuando cómo por qué si como entonces así mismo otro primero última año día semana mes hora ciudad casa trabajo pregunta respuesta solicitud contrato ley derecho tribunal juez parte padre madre niño hombre mujer mundo país agua tiempo cosa vida mano vez nombre es son era eran será serán fue ha han había puede debe hecho dicho",
    "ar": "في من إلى على عن مع بين تحت فوق قبل بعد منذ خلال كل بعض هذا هذه ذلك تلك الذي التي الذين ما لا لم لن إن أن كان كانت يكون هو هي هم نحن أنت أنا قد قال كما لكن أو و ثم حيث إذا لو كيف متى أين لماذا هل نعم اليوم السنة الشهر المدينة البيت العمل السؤال الجواب الطلب العقد القانون الحق المحكمة القاضي الطرف الأب الأم الطفل الرجل المرأة العالم البلد الماء الوقت الحياة اليد الاسم",
}


def words(text: str) -> list[str]:
    return [w for w in ("".join(c if c.isalpha() else "'" if c in "'’" else " " for c in x.lower()).strip(" '") for x in text.split()) if w]


def train(rows: list[tuple[str | None, str]]) -> dict[str, np.ndarray]:
    """Packed models from (label, text) rows; a language without rows has its basic words only."""
    kept: dict[str, list[str]] = {x: [] for x in LANGUAGES}
    size = Counter()
    for label, text in rows:
        lang = label_language(label)
        if lang and size[lang] < MOST_LETTERS:
            size[lang] += len(text)
            kept[lang].append(text)
    counts = {x: Counter(w for t in kept[x] for w in words(t)) for x in LANGUAGES}
    arrays: dict[str, np.ndarray] = {}
    for turn in range(2):
        models = {}
        # a word that a wrong label brought in is several times rarer there than in its own language
        share = {x: {w: n / max(1, counts[x].total()) for w, n in counts[x].items()} for x in LANGUAGES}
        counts = {x: Counter({w: n for w, n in counts[x].items() if share[x][w] >= 0.5 * max(share[y].get(w, 0) for y in LANGUAGES)}) for x in LANGUAGES}
        for x in LANGUAGES:
            # counts grow as logarithms, so that frequent wording doesn't drown the rest
            own = Counter({w: 1 + int(2 * np.log2(n)) for w, n in counts[x].items()})
            own.update({w: 4 for w in BASIC[x].split()})
            models[x] = kneser_ney(Counter({w: n for w, n in own.items() if (sum("\u0600" <= c <= "\u06ff" for c in w) * 2 > len(w)) == (x == "ar")}))
        arrays = pack(models)
        if turn == 0:
            s = Scorer(arrays)
            counts = {x: Counter() for x in LANGUAGES}
            for x in LANGUAGES:
                for text, (lang, _, lines) in zip(kept[x], s.judge(kept[x]), strict=True):
                    parts = text.split("\n")
                    for k, _, own_lang, _ in lines:
                        if lang == x and own_lang == x:
                            counts[x].update(words(parts[k]))
    return arrays


def calibrated(arrays: dict[str, np.ndarray], rows: list[tuple[str | None, str]]) -> dict[str, np.ndarray]:
    """Margin, scale and limits from held-out rows; arrays with them."""
    s = Scorer(arrays | {"calibration": np.array([0.0, 1.0])})
    texts = [t for a, t in rows if label_language(a)]
    labels = np.array([LANGUAGES.index(label_language(a)) for a, _ in rows if label_language(a)])
    text, line, letters, scores, best, mass = s._mains(texts)
    main = mass.argmax(axis=1)
    pure = (main == labels) & (mass.max(axis=1) >= 0.98 * mass.sum(axis=1))
    inside = pure[text]
    entropy = -scores / letters[:, None]
    own = main[text]
    # the margin: how much better another language must look for a sentence to be told apart, with the fewest errors
    # on sentences of pure documents, each against its own language and against every other one
    close = 1 / np.minimum(1.0, 40.0 / letters) ** 0.5
    against = (entropy - entropy.min(axis=1)[:, None]) * close[:, None]
    rows_in = np.flatnonzero(inside)
    same = against[rows_in, own[rows_in]]
    other = np.concatenate([against[rows_in[own[rows_in] != j], j] for j in range(len(LANGUAGES))])
    grid = np.arange(1, 41) / 20
    wrong = np.array([(same >= m).mean() + (other < m).mean() for m in grid])
    margin = float(np.median(grid[wrong <= wrong.min() + 1e-6]))
    # lines of pure documents, long and short
    key = text * (int(line.max()) + 1) + line
    begin = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    at, n, total = text[begin], np.add.reduceat(letters, begin), np.add.reduceat(scores, begin)
    keep = pure[at] & (n >= 10)
    n, total, lang = n[keep], total[keep], main[at][keep]
    each = -total / n[:, None]
    # the scale: the one that makes the languages of held-out lines likeliest
    def loss(scale: float) -> float:
        z = -scale * each * np.minimum(n, 60)[:, None] ** 0.5
        z -= z.max(axis=1, keepdims=True)
        return float(-(z[np.arange(len(z)), lang] - np.log(np.exp(z).sum(axis=1))).mean())

    scale = min((0.125 * 2 ** (k / 2) for k in range(14)), key=loss)
    limits = []
    latin = [k for k in range(len(LANGUAGES)) if LANGUAGES[k] != "ar"]
    long = n >= 60
    for j in range(len(LANGUAGES)):
        if j not in latin:
            # no other language of the script is at hand to be told from
            x = each[(lang == j) & long, j]
            limits.append((float(np.quantile(x, 1 - FALSE_RATE)) + 1.5, 0.0))
            continue
        # what lines of the other languages of the script would score as this one if their own were unknown
        foreign = [lack(each[(lang == k) & long][:, [x for x in latin if x != k]]) for k in latin if k != j]
        far = np.concatenate(foreign)
        limit = float(np.quantile(far, FALSE_ACCEPTS)) if len(far) > 50 else 3.0
        near = lack(each[lang == j][:, latin])
        m = n[lang == j]
        slope = max([0.0, *((float(np.quantile(near[(m >= a) & (m < b)], 1 - FALSE_RATE)) - limit) * a**0.5 for a, b in ((10, 20), (20, 40), (40, 80)) if ((m >= a) & (m < b)).sum() > 50)])
        limits.append((limit, slope))
    print("margin", round(margin, 3), "scale", scale, "limits", [(round(a, 2), round(b, 2)) for a, b in limits], file=sys.stderr)
    return arrays | {"calibration": np.array([margin, scale]), "limits": np.array(limits)}


def main() -> None:
    import pyarrow.parquet as pq

    t = pq.read_table(sys.argv[1], columns=["lang", "text"]).to_pydict()
    rows = [(a, x) for a, x in zip(t["lang"], t["text"], strict=True) if x]
    held = [k % 5 == 4 for k in range(len(rows))]
    arrays = train([r for r, h in zip(rows, held, strict=True) if not h])
    np.savez_compressed(MODEL, **calibrated(arrays, [r for r, h in zip(rows, held, strict=True) if h]))


if __name__ == "__main__":
    main()
