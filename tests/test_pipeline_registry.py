import os

import pytest

from lexmill import resources
from lexmill.operators import registry, spelling
from lexmill.plans import pipeline


def test_pipeline_end_to_end(spark, tmp_path):
    root, out = tmp_path / "in", str(tmp_path / "out")
    (root / "juris").mkdir(parents=True)
    (root / "juris" / "a.txt").write_text("Article 1\nMme Sara Belkhaya signe le contrat de bail.\nArticle 2\nLe bail dure un an.")
    (root / "juris" / "b.txt").write_text("Article 1\nMme  Sara Belkhaya signe le contrat de bail.\nArticle 2\nLe bail dure un an.\n")
    (root / "juris" / "c.txt").write_text(" \n ")
    config = pipeline.IngestConfig(sources=(("juris", "Jurisprudence"),))
    r = pipeline.run(spark, str(root), out, config)
    assert (r["total_files_discovered"], r["processed"], r["duplicates"], r["skipped"], r["segments"], r["pii_masked"]) == (3, 1, 1, 1, 2, 1)
    assert r["success_rate"] == 0.3333 and r["failed"] == 0 and os.path.exists(os.path.join(out, "READY"))
    assert not any(r["expectations"].values())
    assert "[NOM] signe" in spark.read.parquet(os.path.join(out, "texts")).first()["text"]
    assert "| source | Jurisprudence | 1 |" in pipeline.card(spark.read.parquet(os.path.join(out, "metadata")), spark.read.parquet(os.path.join(out, "segments")))
    (root / "d.pdf").write_bytes(b"%PDF")
    assert pipeline.run(spark, str(root), out, config)["failed"] == 1 and not os.path.exists(os.path.join(out, "READY"))
    assert not pipeline.ready({})


def test_registry(spark, tmp_path):
    t = registry.Tracker(spark, str(tmp_path / "runs"))
    t.log("r1", {"a": [1, 2], "b": {"y": 1, "x": 2}}, {"recall": 0.9, "note": "x", "flag": True})
    assert t.metrics("r1").collect()[0][:] == ("recall", 0.9)
    assert t.register("m", "r1") == 1 and t.register("m", "r1") == 2
    t.alias("m", "champion", 1)
    t.alias("m", "champion", 2)
    assert t.resolve("m", "champion") == 2 and t.resolve("m", "candidate") is None
    with pytest.raises(ValueError):
        t.alias("m", "other", 1)


def test_bounds(spark):
    with pytest.raises(ValueError):
        registry.TuningConfig(bits=3)
    with pytest.raises(ValueError):
        registry.ModelCard("m", "1", "p", "d", ())
    assert "| f1 | 0.1235 |" in registry.ModelCard("m", "1", "p", "d", ("l",), {"f1": 0.12345678}).markdown()
    df = spark.createDataFrame([("a", 1), ("b", 2)], "tenant_id string, v int")
    assert registry.tenant_view(df, "a").count() == 1
    with pytest.raises(ValueError):
        registry.tenant_view(df, "")


def test_recognised_text_is_corrected_by_default(spark, tmp_path):
    root, out = tmp_path / "in", str(tmp_path / "out")
    (root / "juris").mkdir(parents=True)
    (root / "juris" / "a.png").write_bytes("Article 1\nLe depot de garantie, la 5ociété et le tribuna1.".encode())
    (root / "juris" / "b.png").write_bytes("Article 1\nLe dépôt de garantie, la société et le tribunal.".encode())
    (root / "juris" / "c.txt").write_text("Article 1\nLe depot reste dans un texte tape.")
    r = pipeline.run(spark, str(root), out, recognise=lambda b: b.decode())
    assert r["ocr_corrections"] == {"accent": 1, "confusion": 2}
    # corrected before copies are told apart
    assert (r["processed"], r["duplicates"], r["failed"]) == (2, 1, 0)
    texts = {x["file_path"]: x["text"] for x in spark.read.parquet(os.path.join(out, "texts")).collect()}
    assert "Le dépôt de garantie, la société et le tribunal." in texts["juris/a.png"] and "Le depot reste" in texts["juris/c.txt"]
    with pytest.raises(ValueError):
        pipeline.IngestConfig(lexicon=())
    pipeline.IngestConfig(spelling=False, lexicon=())


def test_shipped_words_leave_ambiguous_forms():
    words = spelling.Speller(list(resources.words("legal_fr")))
    assert [words.text(x)[0] for x in ("propriete", "il annule", "il designe", "le marche", "tribuna1")] == ["propriété", "il annule", "il designe", "le marche", "tribunal"]
