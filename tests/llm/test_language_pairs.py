import math
from collections import Counter

import numpy as np

from lexmill.llm import language, pairs

FR = "Le bailleur refuse de restituer le dépôt de garantie au terme du contrat."
EN = "The landlord refuses to return the security deposit at the end of the lease."
ES = "El arrendador se niega a devolver la fianza al final del contrato de alquiler."
AR = "يرفض المكري إرجاع مبلغ الضمانة عند نهاية مدة العقد."


def test_held_out_sentences():
    texts = [FR, EN, ES, AR, "La ville est grande et les enfants jouent dans la rue.", "The children are playing in the street near the house.", "Los niños juegan en la calle cerca de la casa.", "الأطفال يلعبون في الشارع قرب البيت."]
    assert [x[0] for x in language.scorer().judge(texts)] == ["fr", "en", "es", "ar"] * 2


def test_kneser_ney_sums_to_one():
    model = language.kneser_ney(Counter({"abac": 3, "abba": 2, "cab": 1}), order=3)
    p = {g: math.exp(v[0]) for g, v in model.items()}
    back = {g: math.exp(v[1]) for g, v in model.items()}
    chars = {g for g in p if len(g) == 1}
    for history in [g for g in p if len(g) == 2 and g[-1] != " "]:
        total = 0.0
        for c in chars:
            if history + c in p:
                total += p[history + c]
            elif history[1:] + c in p:
                total += back[history] * p[history[1:] + c]
            else:
                total += back[history] * back[history[1:]] * p[c]
        # the rest is kept for characters never seen
        assert 0.7 < total <= 1 + 1e-9


def test_stored_models_are_sorted():
    with np.load(language.MODEL) as f:
        for x in language.LANGUAGES:
            keys = f[f"{x}_key"]
            assert (keys[1:] > keys[:-1]).all()


def test_labels():
    assert [language.label_language(x) for x in ("fr", " FR ", "fr-MA", "ar_ma", "fra", "french", "", None, "xx")] == ["fr", "fr", "fr", "ar", None, None, None, None, None]


def test_found(spark):
    rows = [(1, "fr", FR), (2, "ar", FR), (3, None, AR), (4, "fr-MA", f"{FR}\n{FR}\n{EN}\n{FR}"), (5, "xx", None), (6, "fr", ""), (7, "zz", "12 34"), (8, "ar", f"{AR}\n{AR}\nx.y-long.address.of.someone@some-long-domain.example"), (2, "ar", FR)]
    got = {tuple(r) for r in language.found(spark.createDataFrame([(*r, "q") for r in rows], "doc_id long, lang string, text string, language string")).collect()}
    assert got == {(2, -1, "fr"), (3, -1, "ar"), (4, 2, "en")}
    assert language.found(spark.createDataFrame([], "doc_id long, lang string, text string")).count() == 0


def test_very_long_text():
    assert language.scorer().judge([FR * 5000])[0][0] == "fr"


Q = "Quel délai s'applique lorsque le bailleur refuse de restituer le dépôt ?"


def test_each_defect():
    for answer in (None, "", " ", "​", "N/A", "—", "...", "null", "néant", "[ ]", "لا شيء"):
        assert pairs.defects(Q, answer) == ["empty"]
    for answer in (Q, Q.upper(), f"Réponse : {Q}", f"{Q} {Q}", Q.rstrip(" ?"), f"Vous demandez : « {Q} »"):
        assert pairs.defects(Q, answer)[0] == "copy"
    for answer in ("Je ne suis pas en mesure de répondre à cette demande.", "Désolé, cette question sort de mon périmètre.", "I am unable to answer this question.", "Lo siento, no puedo responder a esta pregunta.", "عذرا، لا يمكنني الإجابة عن هذا السؤال.", "لا تتوفر لدي مصادر تسمح بالجواب."):
        assert pairs.defects(Q, answer)[0] == "refusal"
    for answer in ("Le bailleur doit resti", "Le bailleur doit…", "Le bailleur doit -", "Le bailleur doit le dépôt, sous peine de", "« Le bailleur doit le dépôt.", "contre paiement de 318."):
        assert pairs.defects(Q, answer) == ["truncated"]


def test_whole_answers():
    for answer in ("Oui.", "Non, sauf accord écrit.", "83 jours", "Le 24/05/2011", "Le 3 mai 2011", "33 يوما", "نعم.", "Le refus du bailleur de répondre vaut acceptation après 75 jours.", "Le juge ne peut pas se prononcer sans pièces.", "Le bailleur doit le dépôt. [3]", "Le bailleur doit le dépôt « الكراء ».", f"{Q} Oui, dans les trente jours.", f"{Q} Oui."):
        assert pairs.defects(Q, answer) == [], answer


def test_pairs_table(spark):
    e = spark.createDataFrame([("e1", Q, None), ("e2", Q, EN), ("e3", None, "Oui."), ("e1", Q, None), ("e4", Q, FR)], "example_id string, question string, answer string")
    m = spark.createDataFrame([("u1", "user", None, Q), ("a1", "assistant", "u1", "Le bailleur doit resti"), ("a1", "assistant", "u1", "Le bailleur doit resti"), ("a2", "assistant", "gone", FR), ("a3", "assistant", None, None)], "message_id string, role string, reply_to string, content string")
    assert {tuple(r) for r in pairs.found(e, m).collect()} == {("e1", "empty"), ("e2", "other_language"), ("a1", "truncated"), ("a3", "empty")}
    assert pairs.found(e.limit(0), m.limit(0)).count() == 0


def test_long_refusals_short_copies_and_long_tails():
    long = "Je ne peux pas répondre à cette question. " + "Le texte cité porte sur un autre sujet et ne dit rien de la demande. " * 8
    assert "refusal" in pairs.defects("Quel délai ?", long)
    assert "refusal" not in pairs.defects("Quel délai ?", "Le délai est de dix jours. " * 3 + "Le salarié a dit : je ne peux pas répondre. " + "Le délai court du dépôt. " * 3)
    assert "copy" in pairs.defects("Quel délai ?", "Quel délai ?") and "copy" not in pairs.defects("Délai ?", "Le délai est de dix jours, voilà le délai.")
    assert pairs.defects("Quel délai ?", "Le délai est de dix jours." + " " * 5000 + "(voir " + "article " * 60 + "3)") == []


def test_messages_without_a_question(spark):
    m = spark.createDataFrame([("a1", "assistant", None, "Le délai est"), ("q", "user", None, "Quel délai ?"), ("q", "user", None, "Quel délai ? bis"), ("a2", "assistant", "q", "Dix jours."), ("a3", "assistant", "zz", None)], "message_id string, role string, reply_to string, content string")
    e = spark.createDataFrame([], "example_id string, question string, answer string")
    rows = {r["pair_id"]: r["question"] for r in pairs.pairs_of(e, m).collect()}
    assert rows == {"a1": None, "a2": "Quel délai ? bis", "a3": None}
    assert {tuple(r) for r in pairs.found(e, m).collect()} == {("a1", "truncated"), ("a3", "empty")}


def test_unknown_languages_and_noise_are_rejected():
    for t in ("Der Vermieter muss dem Mieter die Kaution nach Ende des Vertrages zurückzahlen, sobald die Wohnung übergeben ist.", "xk wqz bnrt plmk zzrt qwd hhjk vvbn mkjt rrtp lkjh gfds", "Il padrone di casa deve restituire il deposito cauzionale alla fine del contratto di locazione."):
        assert language.scorer().judge([t])[0][0] is None and language.languages_of([t]) == [None]
    for lang, t in (("fr", "Les enfants jouaient dans le jardin pendant que leur grand-mère préparait une tarte aux pommes."), ("en", "The quick brown fox jumps over the lazy dog while children were playing football in the park."), ("es", "Los niños jugaban en el parque mientras su abuela preparaba una tarta de manzana."), ("ar", "ذهب الأطفال إلى الحديقة ولعبوا كرة القدم حتى غروب الشمس")):
        assert language.scorer().judge([t])[0][0] == lang


def test_rejected_documents_come_out_as_unknown(spark):
    df = spark.createDataFrame([(1, "de", "Der Vermieter muss dem Mieter die Kaution nach Ende des Vertrages zurückzahlen."), (2, "en", FR)], "doc_id long, lang string, text string")
    assert {(r["doc_id"], r["language"], r["label_ok"]) for r in language.judged(df).collect()} == {(1, "und", None), (2, "fr", False)}
    assert [tuple(r) for r in language.found(df).collect()] == [(2, -1, "fr")]
