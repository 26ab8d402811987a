import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexmill.operators import masking, spelling, structure
from lexmill.plans import catalogue


def test_masks_and_propagates():
    t = "Monsieur Karim Tazafroui, CIN AB123456, tél. 0612345678, karim@exemple.ma. TAZAFROUI est absent."
    out, spans = masking.anonymise(t)
    assert out == "[NOM], CIN [CIN], tél. 06******78, [EMAIL]. [NOM] est absent."
    assert len(spans) == 5
    assert masking.anonymise(t, propagate=False)[0].endswith("TAZAFROUI est absent.")


def test_look_alikes_survive():
    for t in ("Madame la Présidente ouvre l'audience.", "Le dossier RC-123456 est joint.", "Le tribunal de Fès statue.", "أكد السيد رئيس المحكمة ذلك"):
        assert masking.anonymise(t) == (t, [])
    assert masking.anonymise(None) == (None, []) and masking.anonymise("") == ("", [])


def test_windows_take_the_heading_of_what_they_begin_with():
    text = "Article 1\n" + "a " * 300 + "\nArticle 2\n" + "b " * 600
    w = structure.windows_of(text)
    assert [s for s, _ in w] == ["Article 1", "Article 2"] and [len(x) for _, x in w] == [512, 456]


def test_references_and_cards():
    assert masking.anonymise("La taxe TP-123456 est due.")[1] == []
    assert masking.anonymise("Porteur de DA123456.")[0] == "Porteur de [CIN]."
    assert masking.anonymise("السيد أحمد تقدم بمقال")[0] == "السيد [NOM] تقدم بمقال"


def test_arabic_name():
    assert masking.anonymise("حضر السيد كمال الطزفروي الجلسة")[0] == "حضر السيد [NOM] الجلسة"


def test_bad_rules():
    with pytest.raises(ValueError):
        masking.Rule("other", "x", "y")
    with pytest.raises(Exception):
        masking.Rule("nom", "(", "y")
    assert masking.mask_value("0612345678", "telephone", "partial") == "06******78"
    assert masking.mask_value("x", "nom", "hash") == masking.mask_value("x", "nom", "hash") != masking.mask_value("y", "nom", "hash")


def test_masking_in_tables_and_scores(spark):
    df = spark.createDataFrame([(1, "Mme Sara Belkhaya signe."), (2, None)], "id int, t string")
    rows = {r["id"]: r["m"] for r in df.select("id", masking.masking()(F.col("t")).alias("m")).collect()}
    assert rows[1]["text"] == "[NOM] signe." and rows[2]["text"] is None
    assert masking.detections(df, "id", "t").first()["value"] == "Mme Sara Belkhaya"
    cases = spark.createDataFrame([("fr", "nom", ["a"], ["z"], "z"), ("fr", "tel", ["b"], ["y"], "b"), ("ar", "nom", [], [], "")], "language string, family string, must_mask array<string>, must_survive array<string>, out string")
    scored = masking.score_cases(cases, "out")
    got = {(r["language"], r["family"]): (r["recall"], r["damage"]) for r in masking.score_groups(scored).collect()}
    assert got[("fr", None)] == (0.5, 0.5) and got[("ar", None)] == (None, None) and got[(None, None)] == (0.5, 0.5)


def test_segments(spark):
    t = "Préambule\nArticle 1 bis\nle texte, voir l'article 4 ci-dessous. Alinéa 2 : suite\narticle 5 du code\nالمادة 3 مكرر\nنص"
    s = structure.segments_of(t)
    assert [(x["kind"], x["seg_number"]) for x in s] == [("article", "1 bis"), ("alinea", "2"), ("article", "3")]
    assert all(t[x["start_pos"] : x["end_pos"]].strip() == x["text"] for x in s)
    assert [x["end_pos"] for x in s[:-1]] == [x["start_pos"] for x in s[1:]]
    assert structure.segments_of("sans structure") == [] and structure.segments_of(None) == []
    df = spark.createDataFrame([(1, t), (2, None)], "id long, t string")
    assert structure.segments(df, "id", "t").count() == 3


@settings(max_examples=50, deadline=None)
@given(st.integers(0, 2500), st.integers(1, 6))
def test_windows_lose_nothing(n, parts):
    text = "\n".join(f"Article {k}\n" + " ".join(f"w{k}_{i}" for i in range(n // parts)) for k in range(1, parts + 1))
    w = structure.windows_of(text)
    assert all(0 < len(x) <= 512 for _, x in w)
    rebuilt = (w[0][1] if w else []) + [t for _, x in w[1:] for t in x[64:]]
    assert rebuilt == text.split()


def test_number_broken_over_lines(spark):
    t = "Titre.\nArticle 5\nbis : Dépôt.\nArticle 6 \n\n ter - Bail"
    assert [(x["label"], x["seg_number"]) for x in structure.segments_of(t)] == [("Article 5\nbis", "5\nbis"), ("Article 6 \n\n ter", "6 \n\n ter")]
    assert [x["start_pos"] for x in structure.segments_of(t)] == [t.index("Article 5"), t.index("Article 6")]
    df = spark.createDataFrame([(1, t), (2, "Article 7 bis"), (3, None)], "id int, t string")
    assert {(r["id"], r["seg_number"]) for r in structure.segments(df, "id", "t").collect()} == {(1, "5\nbis"), (1, "6 \n\n ter"), (2, "7 bis")}


def test_labels_are_those_of_the_sql(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    rows = [(1, "Titre.\nArticle 5\nbis : Dépôt.\nArticle 6  ter - Bail.\nAl. 2"), (2, "Article 7 bis"), (3, None), (4, "المادة 3\nالفقرة 1"), (5, "sans structure")]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    duckdb.sql(f"CREATE OR REPLACE TEMP VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got = {tuple(r) for r in catalogue.segment_labels(spark, str(tmp_path)).collect()}
    assert got == set(duckdb.sql(catalogue.oracle_sql()["segment_labels"]).fetchall())
    assert (2, 1, "article 7 bis") in got and any("article 6 ter|" in r[2] for r in got)


def test_fixed_windows_agree_with_the_fold(spark):
    texts = [(k, " ".join(f"t{i}" for i in range(n))) for k, n in enumerate((1, 511, 512, 513, 960, 961, 2000))] + [(99, ""), (98, None)]
    got = {}
    for r in structure.fixed_windows(spark.createDataFrame(texts, "id int, t string"), "id", "t").collect():
        got.setdefault(r["id"], {})[r["chunk_index"]] = r["text"]
    for k, t in texts[:7]:
        step = [t.split()[a : a + 512] for a in range(0, max(len(t.split()) - 64, 1), 448)]
        assert [got[k][i] for i in range(len(got[k]))] == [" ".join(x) for x in step]
    assert 98 not in got and 99 not in got
    with pytest.raises(ValueError):
        structure.WindowConfig(64, 64)


def test_spelling(spark):
    s = spelling.Speller(["dépôt", "bail", "société", "cote", "côte", "loi"])
    assert s.text("Le DEPOT du ba1l, 50ciete, cote 12 n7")[0] == "Le DÉPÔT du bail, 50ciete, cote 12 n7"
    assert s.text("depot") == ("dépôt", [(0, "depot", "dépôt", "accent")])
    fixed, _ = s.text("depot ba1l")
    assert s.text(fixed) == (fixed, [])
    df = spark.createDataFrame([(1, "depot", "ocr_pdf"), (2, "depot", "text"), (3, None, "ocr_pdf")], "id int, t string, m string")
    out = spelling.corrected(df, "id", "t", "m", ["dépôt"])
    assert {r["id"]: r["text"] for r in out.collect()} == {1: "dépôt", 2: "depot", 3: None}
    assert spelling.tally(out).first()[:] == ("accent", 1)
