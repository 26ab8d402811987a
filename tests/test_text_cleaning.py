import hashlib
import hmac

from pyspark.sql import functions as F

from lexmill.functions import text as T
from lexmill.operators import cleaning


def one(spark, text, column):
    return spark.createDataFrame([(text,)], "t string").select(column(F.col("t"))).first()[0]


def test_scalar_functions(spark):
    assert one(spark, "a\r\nb\rc", T.unify_newlines) == "a\nb\nc"
    assert one(spark, "a\x00b\tc\x85", T.strip_controls) == "ab\tc"
    assert one(spark, "a\n\n\n\nb \n", T.collapse_blank_lines) == "a\n\nb"
    assert one(spark, "النص", T.script_language) == "ar" and one(spark, "texte", T.script_language) == "fr"
    assert one(spark, " a  b\nc ", T.word_count) == 3 and one(spark, None, T.word_count) == 0
    assert one(spark, "Loi n° 12-34 / L'Été", T.lexical_tokens) == ["loi", "n", "12-34", "l", "été"]
    assert one(spark, "x" * 600, T.excerpt) == "x" * 499 + "…"
    assert one(spark, "jean paul sartre", T.initials) == "JP"
    assert one(spark, "Bulletin Officiel", T.slug) == "bulletin-officiel"
    assert spark.range(1).select(T.byte_size(F.lit(1536)), T.byte_size(F.lit(12)), T.progress(F.lit(3), 4), T.long_date(F.lit("2011-05-03").cast("date"))).first()[:] == ("1.5 Ko", "12 o", 75, "3 mai 2011")
    assert spark.range(1).select(T.serialise_map(F.create_map(F.lit("b"), F.lit("2"), F.lit("a"), F.lit("1")))).first()[0] == "a=1,b=2"


def test_page_lines_go_and_sentences_stay(spark):
    text = "Page 3\nvoir page 3 du dossier\n- 12 -\n3/7\nصفحة 4 من 9\nArticle 3\npage 2 sur 5"
    assert one(spark, text, T.drop_page_lines).split("\n") == ["", "voir page 3 du dossier", "", "", "", "Article 3", ""]


def test_fingerprint_is_hmac(spark):
    want = hmac.new(b"cle secrete", "question é".encode(), hashlib.sha256).hexdigest()[:32]
    assert spark.createDataFrame([("question é", "cle secrete")], "m string, k string").select(T.keyed_fingerprint(F.col("m"), F.col("k"))).first()[0] == want


def test_repeated_lines(spark):
    header = "Royaume – Cour d'appel"
    cases = {
        f"{header}\na\n{header}\nb\n {header} \nc": "a\nb\nc",
        f"{header}\na\n{header}\nb": f"{header}\na\n{header}\nb",
        "Article 1\na\nArticle 1\nb\nArticle 1": "Article 1\na\nArticle 1\nb\nArticle 1",
        "Fin.\na\nFin.\nb\nFin.": "Fin.\na\nFin.\nb\nFin.",
        f"{'x' * 81}\n" * 3: f"{'x' * 81}\n" * 3,
        "h\nh\nh": "h\nh\nh",
        "": "",
    }
    df = spark.createDataFrame(list(cases.items()), "text string, want string")
    for r in cleaning.without_repeated_lines(df, "text").collect():
        assert r["text"] == r["want"]
    assert cleaning.without_repeated_lines(spark.createDataFrame([(None,)], "text string"), "text").first()[0] is None


def test_cleaning_twice_changes_nothing(spark):
    text = "Tribunal de X\r\nPage 1\r\nLe  bail\x07 est conclu.\n\n\n\nTribunal de X\nArticle 2\nPage 2\nTribunal de X\nsuite  du texte "
    once = cleaning.cleaned(spark.createDataFrame([(text,)], "text string"))
    assert once.first()[0] == "Le bail est conclu.\n\nArticle 2\n\nsuite du texte"
    assert cleaning.cleaned(once).first()[0] == once.first()[0]


def test_copies(spark):
    rows = [("a", "x/1", "même texte", None), ("b", "x/2", "même texte", None), ("c", "a/9", "même texte", True), ("d", "b", "", None), ("e", "c", None, None), ("f", "d", "autre", None)]
    df = spark.createDataFrame(rows, "id string, path string, text string, bad boolean")
    got = {r["id"]: (r["status"], r["duplicate_of"]) for r in cleaning.classify_copies(df, "id", "text", "path", F.col("bad")).collect()}
    assert got == {"a": ("success", None), "b": ("duplicate", "a"), "c": ("skipped", None), "d": ("skipped", None), "e": ("skipped", None), "f": ("success", None)}


def test_latest(spark):
    df = spark.createDataFrame([("a", 1, "old"), ("a", 2, "new"), ("b", None, "only")], "k string, v int, x string")
    assert {r["k"]: r["x"] for r in cleaning.latest(df, "k", F.col("v")).collect()} == {"a": "new", "b": "only"}
