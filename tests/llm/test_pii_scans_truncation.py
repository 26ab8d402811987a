from lexmill.llm import pii, scans, truncation

TEXT = (
    "M. Elvika Lagradane a comparu en personne. Titulaire de la CIN n° LZ-046805, il justifie de sa qualité. Tél. 06 00 39 46 91, aux heures de bureau.\n"
    "Adresse déclarée : 93 bis avenue Belkelt, 53931 Ouzmelt. Courriel : fasqenni57@greffe-tazrelt.invalid\nMonsieur le Président renvoie l'affaire. Le dossier RC 700678 est joint."
)


def test_items_of_a_text():
    got = [(k, TEXT[a:b]) for a, b, k in pii.items(TEXT)]
    assert got == [("nom", "Elvika Lagradane"), ("cin", "LZ-046805"), ("telephone", "06 00 39 46 91"), ("adresse", "93 bis avenue Belkelt, 53931 Ouzmelt"), ("email", "fasqenni57@greffe-tazrelt.invalid")]


def test_arabic_items():
    t = "حضر السيد كاسديران بلزويركي الجلسة. وعنوانه شارع مزروومي رقم 38، أوزميلت."
    assert [(k, t[a:b]) for a, b, k in pii.items(t)] == [("nom", "كاسديران بلزويركي"), ("adresse", "شارع مزروومي رقم 38، أوزميلت")]


def test_names_after_any_cue_become_candidates():
    model = pii.Model({})  # knows no letters
    for cue in ("ENTRE", "prénom :", "Bénéficiaire", "الكامل", "وعقب", "وأضاف", "(Mme", "«Monsieur", "MONSIEUR", "Mon-\nsieur"):
        text = f"ligne\n\n{cue} Zyx\n\nligne"
        assert pii.name_candidates(text, model) and [c[:3] for c in pii.candidates(text, model)] == [c[:3] for c in pii.name_candidates(text, model)], cue


def test_names_addresses_and_numbers_of_other_languages():
    said = lambda t: [(k, t[a:b]) for a, b, k in pii.items(t)]
    assert said("Mr John Smith lives at 12 Baker Street, London, phone +44 20 7946 0958.") == [("nom", "John Smith"), ("adresse", "12 Baker Street, London"), ("telephone", "+44 20 7946 0958")]
    assert said("El señor Juan Carlos García Márquez vive en la Calle Mayor 5, Madrid.") == [("nom", "Juan Carlos García Márquez"), ("adresse", "Calle Mayor 5, Madrid")]
    assert said("Mme Fatima Zahra El Idrissi demande le partage.") == [("nom", "Fatima Zahra El Idrissi")]


def test_scores_kept_by_parts_equal_the_sum_of_all_features():
    m = pii.model()
    found = pii.candidates(TEXT, m)
    for c, (*_, x) in zip(found, pii.scored(TEXT, found, m), strict=True):
        assert abs(x - m.sum(c[2], pii.features(TEXT, c))) < 1e-9


def test_expected_segments_against_all_segmentations():
    import itertools
    import math

    import numpy as np

    from lexmill.llm.train_pii import expected

    seg = [(0, 3), (2, 5), (3, 6), (5, 9), (0, 9), (7, 9), (3, 6)]
    score = np.array([0.5, 1.0, -0.3, 0.2, 1.5, 0.1, 0.4])
    total, each = 0.0, np.zeros(len(seg))
    for n in range(len(seg) + 1):
        for pick in itertools.combinations(range(len(seg)), n):
            if all(seg[a][1] <= seg[b][0] or seg[b][1] <= seg[a][0] for a, b in itertools.combinations(pick, 2)):
                x = math.exp(score[list(pick)].sum())
                total += x
                each[list(pick)] += x
    assert np.allclose(expected(seg, score), each / total)


def test_mask_leaves_the_rest_unchanged():
    found = pii.items(TEXT)
    out = pii.masked(TEXT, found)
    assert out.startswith("M. [NOM] a comparu en personne. Titulaire de la CIN n° [CIN], il")
    assert all(TEXT[a:b] not in out for a, b, _ in found)
    assert pii.masked("rien", []) == "rien"


def test_best_segments_do_not_overlap():
    got = pii.best([(0, 5, "nom", 1.0), (3, 9, "adresse", 2.5), (9, 12, "cin", 1.0), (0, 3, "nom", 0.5), (4, 6, "nom", -1.0)])
    assert got == [(0, 3, "nom"), (3, 9, "adresse"), (9, 12, "cin")]
    assert pii.best([]) == []


def test_pii_table(spark):
    df = spark.createDataFrame([(1, TEXT, "n"), (1, TEXT, "n"), (2, None, "n"), (3, "", "n"), (4, "mot " * 20000, "n")], "doc_id long, text string, pii_type string")
    assert pii.found(df).count() == 5
    out = {r["doc_id"]: r for r in pii.anonymised(df.dropDuplicates(["doc_id"])).collect()}
    assert out[2]["text"] is None and out[1]["items"] == 5 and out[4]["text"] == "mot " * 20000
    assert pii.found(df.limit(0)).count() == 0


PAGE = """Note sur le dépôt de garantie pour le compte d'un tiers

Le bailleur a transmis le carnet d'entretien à titre conser-
vatoire, sans que cela suspende l'exécution. Le gardien peut
réclamer le plan de bornage avant l'audience du 4 mars 2011,
AVIS RELATIF AU CAHIER DES CHARGES DANS UN DÉLAI DE   2
Page 2 sur 3
selon le rapport. Le caissier a vérifié la garantic bancaire
au si1ège de Meltelt, ce qui reste à démontrer."""


HEADS = truncation.Heads(["note sur", "avis relatif"])


def test_lines_of_a_page():
    lines = PAGE.split("\n")
    assert scans.wrapped(lines)
    labels = scans.label_lines(lines, "Note sur le dépôt de garantie pour le compte d'un tiers", HEADS)
    assert labels[5] == "header" and labels[6] == "page" and labels[1] == "blank"
    assert all(labels[k] in ("body", "end") for k in (0, 2, 3, 4, 7, 8))
    assert [(a, b) for a, b, *_ in scans.broken(lines, labels)] == [(2, 3)]
    text = scans.paragraphs(lines, labels, {"garantic": "garantie"}, HEADS)
    assert "conservatoire, sans" in text and "garantie bancaire" in text and "Page 2" not in text and "AVIS" not in text


def test_one_long_line_leaves_a_page_wrapped():
    assert scans.wrapped([*PAGE.split("\n"), "x" * 400])
    assert not scans.wrapped(["Un paragraphe entier qui tient sur une seule ligne, " * 4] * 5)


def test_a_short_word_like_a_code_is_looked_up():
    u = scans.Uncommon(frozenset(["part"]))
    said = {x[0]: x for x in u.of("par7, RC5 12 part")}
    assert set(said) == {"par7"} and not said["par7"][1] and "part" in said["par7"][2]


def test_page_lines():
    for x in ("Page 2 sur 3", "- 3 -", "p. 4", "PAGE N° 2", "[4]", "3/3", "ص. 5", "الصفحة ٣", "page" + " " * 80 + "7"):
        assert truncation._page_line(x), x
    for x in ("Page de garde", "12 boulevard", "mai.", "5.", "Le 5", ""):
        assert not truncation._page_line(x), x


def test_scan_table(spark):
    clean = "Le caissier a vérifié la garantie bancaire au siège de Meltelt, ce qui reste à démontrer, et le bailleur a transmis le carnet d'entretien pour le compte d'un tiers."
    rows = [(k, "t", clean, None) for k in range(5)] + [(10, "Note sur le dépôt", PAGE, "text"), (11, "Avis relatif au bail", None, "ocr_pdf"), (12, None, "", None), (10, "Note sur le dépôt", PAGE, "text")]
    df = spark.createDataFrame(rows, "doc_id long, title string, text string, method string")
    got = {tuple(r) for r in scans.found(df).collect()}
    assert {(10, 5, "header"), (10, 6, "page_number"), (10, 2, "broken_word"), (10, 7, "misread"), (10, 8, "misread")} <= got
    assert {x[0] for x in got} == {10}
    out = {r["doc_id"]: r for r in scans.repaired(df.dropDuplicates(["doc_id"])).collect()}
    assert out[10]["scanned"] and not out[1]["scanned"] and out[11]["text"] is None and out[1]["text"] == clean
    assert scans.found(df.limit(0)).count() == 0


def test_variants_undo_confusions():
    assert "conformité" in scans.variants("confonmité") and "demande" in scans.variants("dernande") and "المستغل" in scans.variants("المشثغل")


def test_endings():
    closes = truncation.Closings({"fait a": 4, "le greffier": 4, "pieces jointes": 2, "abonnez vous": 9, "كاتب الضبط": 3, "ainsi juge": 7, "document transmis": 7.5})
    e = lambda t: truncation.ending(t, closes, HEADS)[0]
    body = "Le bailleur a transmis le carnet d'entretien, selon le rapport."
    assert e(body) == "whole"
    assert e(f"{body}\nLe gardien peut récla") == "cut"
    assert e(f"{body}\nLe gardien peut réclamer le [...]\n[2]") == "cut"
    assert e(f"{body}\nLe gardien peut… (lire la suite)") == "cut"
    for after in ("Fait à Tazrenza, le 15/12/2022", "Le greffier de Aghbenza", "Pièces jointes : 68", "Page 3 sur 3", "Abonnez-vous à la lettre hebdomadaire de Sidrelt", "كاتب الضبط بتلديغن", "Article 4 bis", "Ainsi jugé à Tazrelt en audierice publique", "Document transmis pour information aux services\nconcernés", "Le gref-fier de Tazrelt".replace("-", "")):
        assert e(f"{body}\n\n{after}") == "whole", after
        assert e(f"{body}\nLe gardien peut récla\n{after}") == "cut", after
    assert e("Le gardien réclame la somme, contre paiement de 318.") == "cut"
    assert e(f"{body}\n{'Avis relatif au bail ' * 30}") == "cut"
    assert e("") == "whole" and e("\n\n") == "whole"


def test_closing_lines_are_learned(spark):
    rows = [(k, "a", f"Texte numéro {k} du dossier, selon le rapport.\nPartager sur Facebook\nSigné à {'Rabat Salé Fès'.split()[k % 3]}") for k in range(12)]
    rows += [(k, "b", f"Le gardien a remis la pièce {k}.\nLe bailleur peut récla") for k in range(20, 24)] + [(30, "a", "Le gardien\nPartager sur Facebook"), (31, "c", "Fin.\n")]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string").selectExpr("*", "cast(null as string) as title")
    assert {r[0] for r in truncation.found(df).collect()} == {20, 21, 22, 23, 30}


def test_truncated_table(spark):
    body = "Le bailleur a transmis le carnet d'entretien, selon le rapport. Le gardien réclame le plan de bornage."
    rows = [(1, "a", body), (2, "a", body[:80]), (3, "a", None), (4, None, ""), (5, "b", body[:80]), (2, "a", body[:80])]
    df = spark.createDataFrame([(*r, "t", 1) for r in rows], "doc_id long, source string, text string, title string, ending int")
    assert {r[0] for r in truncation.found(df).collect()} == {2, 5}
    assert {(r["doc_id"], r["longer_id"]) for r in truncation.longer_copies(df).collect()} == {(2, 1), (5, 1)}
    rates = {r["source"]: r for r in truncation.rates(df).collect()}
    assert rates["a"]["records"] == 3 and rates["a"]["cut_off"] == 1 and rates["b"]["share"] == 1.0 and rates[None]["cut_off"] == 0
    assert truncation.found(df.limit(0)).count() == 0


def test_prefix_join_against_brute_force(spark):
    import random

    rng = random.Random(5)
    base = ["".join(rng.choice("ab cd.") for _ in range(rng.choice([40, 150, 700, 2500]))) for _ in range(25)]
    texts = base + [b[: rng.randint(32, len(b))] for b in base for _ in range(3)]
    got = {r[0] for r in truncation.longer_copies(spark.createDataFrame([(k, "s", t, None) for k, t in enumerate(texts)], "doc_id long, source string, text string, title string")).collect()}
    assert got == {k for k, t in enumerate(texts) if any(len(x) > len(t) and x.startswith(t) for x in texts)}
