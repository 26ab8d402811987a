import datetime as dt
import json
import zipfile

import pytest
from pyspark.sql import types as t

from lexmill.sources import files
from lexmill.streaming import streams


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a-b").mkdir()
    (tmp_path / "a" / "un.txt").write_text("Texte un", encoding="utf-8")
    (tmp_path / "a" / "un.txt.meta.json").write_text(json.dumps({"title": "Titre", "date": "2011"}), encoding="utf-8")
    (tmp_path / "a-b" / "deux.TXT").write_text("النص", encoding="utf-8")
    (tmp_path / "a-b" / "deux.TXT.meta.json").write_text("{broken", encoding="utf-8")
    (tmp_path / "a-b" / "un.txt").write_text("autre texte", encoding="utf-8")
    (tmp_path / "bad.txt").write_bytes(b"\xff\xfe\xff")
    (tmp_path / "skip.csv").write_text("x")
    with zipfile.ZipFile(tmp_path / "doc.docx", "w") as z:
        z.writestr("word/document.xml", '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body><w:p><w:r><w:t>Un</w:t></w:r></w:p><w:p><w:r><w:t>Deux</w:t></w:r></w:p></w:body></w:document>')
    (tmp_path / "scan.pdf").write_bytes(b"%PDF")
    return str(tmp_path)


def test_discovery_and_extraction(spark, folder):
    d = files.discover(spark, folder)
    assert [r["rel"] for r in files.in_path_order(d.select("rel")).collect()] == ["a/un.txt", "a-b/deux.TXT", "a-b/un.txt", "bad.txt", "doc.docx", "scan.pdf"]
    got = {r["rel"]: r for r in files.extract(d, pdf=lambda b: "court", recognise=lambda b: "texte reconnu").collect()}
    assert got["doc.docx"]["text"] == "Un\nDeux" and got["scan.pdf"]["method"] == "ocr_pdf" and got["bad.txt"]["error"].startswith("UnicodeDecodeError")
    assert {r["rel"]: (r["text"], r["error"]) for r in files.extract(d).collect()}["scan.pdf"] == ("", None)
    assert files.recognition_language(["ara", "fra", "eng"]) == "fra+ara" and files.recognition_language(["eng"]) == "eng" and files.recognition_language([]) is None


def test_ingest(spark, folder):
    rows = files.ingest(spark, folder, {"a": "Jurisprudence"}).collect()
    got = {r["file_path"]: r for r in rows}
    # a side file belongs to one path, not to every file of that name
    assert len(rows) == len(got) == 6 and got["a-b/un.txt"]["title"] != "Titre"
    a, b = got["a/un.txt"], got["a-b/deux.TXT"]
    assert (a["title"], a["doc_date"], a["source"], a["language"], a["error"]) == ("Titre", "2011", "Jurisprudence", "fr", None)
    assert a["doc_id"].startswith("jurisprudence-") and b["language"] == "ar" and b["error"] == "no source"


def test_drop_zone_and_append(spark, folder, tmp_path):
    rows = files.DropZone(folder).fetch(spark, 2)
    assert [r["rel"] for r in rows.collect()] == ["doc.docx"]
    out = str(tmp_path / "table")
    df = spark.createDataFrame([(1,), (2,)], "k int")
    assert files.append_new(spark, df, out, "k") == 2
    assert files.append_new(spark, df.union(spark.createDataFrame([(3,)], "k int")), out, "k") == 1
    assert spark.read.parquet(out).count() == 3


def test_json_lines_and_corpus(spark, tmp_path):
    p = tmp_path / "m.jsonl"
    p.write_text('{"doc_id": "a", "file_path": "x.txt", "jurisdiction": "Y"}\n\n')
    s = t.StructType([t.StructField("doc_id", t.StringType()), t.StructField("file_path", t.StringType())])
    m = files.json_lines(spark, str(p), s)
    assert m.first()["extra"] == {"jurisdiction": "Y"}
    texts = spark.createDataFrame([("x.txt", "texte"), ("../y.txt", "t")], "file_path string, text string")
    assert files.corpus(m, texts).count() == 1
    with pytest.raises(Exception, match="repeated doc_id"):
        files.corpus(m.union(m), texts).collect()
    with pytest.raises(Exception, match="no text"):
        files.corpus(spark.createDataFrame([("b", "z.txt")], "doc_id string, file_path string"), texts).collect()
    with pytest.raises(Exception, match="outside the corpus"):
        files.corpus(spark.createDataFrame([("b", "../y.txt")], "doc_id string, file_path string"), texts).collect()
    p.write_text("{broken\n")
    with pytest.raises(Exception):
        files.json_lines(spark, str(p), s).collect()


def test_generators_and_cards(spark):
    assert files.synthetic_documents(spark, 60).dropDuplicates(["doc_id"]).count() == 60
    r = files.simulated_requests(spark, 2000)
    assert r.count() == 2000 and 0.6 < r.where("route = '/chat'").count() / 2000 < 0.8
    assert files.markdown_card("P", {"t": [{"a": 1}]}) == "# P\n\n## t\n\n| a |\n| --- |\n| 1 |"


def test_streams_agree_with_batch(spark, tmp_path):
    at = lambda m: dt.datetime(2024, 1, 1, 0, m)
    df = spark.createDataFrame([(1, at(0), "a", 1.0), (1, at(0), "a", 1.0), (2, at(1), "a", 9.0), (3, at(4), "a", 9.0), (4, at(30), "b", 1.0)], "event_id long, ts timestamp, k string, value double")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    s = streams.event_stream(spark, str(tmp_path / "in"), "event_id long, ts timestamp, k string, value double")
    assert streams.run_all(streams.once(s, "event_id", "ts"), "once").count() == 4
    w = streams.run_all(streams.windowed(s, "ts", "10 minutes", None, "k", late="0 seconds"), "windows", "complete")
    assert {(r["k"], r["n"]) for r in w.collect()} == {("a", 4), ("b", 1)}
    assert streams.run_all(streams.session_counts(s, "ts", "5 minutes", "k"), "sessions", "complete").count() == 2
    fired = streams.run_all(streams.holding(s, "k", 5.0, 120), "holding").collect()
    assert [(r["k"], r["since"]) for r in fired] == [("a", at(1))]
    hits = streams.run_all(streams.cached_answers(s, "k", 60), "cache").collect()
    assert sum(r["hit"] for r in hits) == 2 and len(hits) == 5
    (tmp_path / "logs").mkdir()
    (tmp_path / "logs" / "audit-1.jsonl").write_text('{"event_id": "1"}\n{"event_id": "2", "query_text": "x"}\n')
    assert streams.run_all(streams.audit_stream(spark, str(tmp_path / "logs"), "event_id string"), "audit").count() == 1
