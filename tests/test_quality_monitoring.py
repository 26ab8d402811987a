import datetime as dt

import pytest
from pyspark.sql import functions as F

from lexmill.operators import monitoring, quality, relations

META = "doc_id string, title string, source string, doc_date string, category string, language string, file_path string, word_count_clean int, char_count_clean int, segment_count int, status string"
GOOD = ("a", "T", "Jurisprudence", "2011-05-03", "C", "fr", "d/a.txt", 10, 50, 0, "SUCCESS")


def test_row_errors(spark):
    bad = [("b x", " ", "Ailleurs", "2011-13-01", "C", "en", "/a.txt", 1, 5, 0, "SUCCESS"), (None, None, None, None, None, None, None, None, None, None, None), GOOD]
    got = [r["errors"] for r in quality.metadata_errors(spark.createDataFrame(bad, META)).collect()]
    assert got[0] == ["missing: title", "schema: doc_id", "schema: source", "schema: language", "schema: date", "schema: file_path", "text: too short"]
    assert got[2] == [] and "missing: source" in got[1]
    s = quality.quality_summary(quality.metadata_errors(spark.createDataFrame(bad, META))).first()
    assert (s["total"], s["passed"], s["pass_rate"]) == (3, 1, 0.3333)


@pytest.mark.parametrize(
    ("rows", "name"),
    [([], "rows_at_least_1"), ([GOOD, GOOD], "doc_id_unique"), ([(*GOOD[:3], "03/05/2011", *GOOD[4:])], "date_format"), ([(*GOOD[:7], 2, *GOOD[8:])], "words_in_range"), ([(*GOOD[:10], "FAILED")], "status_success"), ([(*GOOD[:2], "X", *GOOD[3:])], "source_in_set")],
)
def test_each_expectation(spark, rows, name):
    got = {r["expectation"]: r["failures"] for r in quality.expectations(spark.createDataFrame(rows, META)).collect()}
    assert [k for k, v in got.items() if v] == [name] and len(got) == 16
    with pytest.raises(RuntimeError):
        quality.gate(quality.expectations(spark.createDataFrame(rows, META)))


def test_columns_and_profile(spark):
    df = spark.createDataFrame([("a", None), ("b", ""), ("c", "x")], "k string, v string")
    assert quality.columns_match(df, {"k", "w"}) == ["v", "w"]
    assert {r["value"]: r["n"] for r in quality.value_counts(df, ["v"]).collect()} == {"(non renseigné)": 2, "x": 1}
    assert quality.distribution(df.where("false"), F.length("v")).first()["mean"] == 0.0
    with pytest.raises(ValueError):
        quality.check_forbidden(df.withColumn("raw_path", F.lit("x")))
    with pytest.raises(Exception, match="v must be set"):
        quality.require(df, {"v must be set": F.col("v").isNotNull()}).collect()


def test_gates(spark):
    b = spark.createDataFrame([("r", 0.9), ("f", 0.9), ("x", 0.5)], "m string, value double")
    c = spark.createDataFrame([("r", 0.8), ("f", 0.88)], "m string, value double")
    assert [r["m"] for r in quality.regressions(b, c, "m").collect()] == ["r"]
    m = lambda *rows: quality.promotion(spark.createDataFrame(list(rows), "metric string, value double"), {"faithfulness": 0.94}, {"hallucination": 0.03}).first()
    assert m(("faithfulness", 0.95), ("hallucination", 0.01))["promote"]
    assert m(("faithfulness", 0.95))["reasons"] == ["hallucination missing"]
    x = quality.split_rows(spark.range(2000), "id", 0.25, 3)
    assert x.where("is_validation").count() == 500
    assert quality.split_rows(spark.range(3), "id", 0.01).where("is_validation").count() == 1 and quality.split_rows(spark.range(3), "id", 0.99).where("is_validation").count() == 2
    with pytest.raises(ValueError):
        quality.split_rows(spark.range(1), "id", 0.5)


def ts(h, m=0, day=1):
    return dt.datetime(2024, 1, day, h, m)


def test_rates_runs_and_gaps(spark):
    e = spark.createDataFrame([(ts(0), "e"), (ts(0, 30), "v"), (ts(1), "e"), (ts(2, 5), "e"), (ts(5), "v")], "ts timestamp, k string")
    r = monitoring.ratio(e, "ts", 3600, F.col("k") == "e")
    assert [x["ratio"] for x in r.orderBy("window_start").collect()] == [0.5, 1.0, 1.0, 0.0]
    run = monitoring.firing(r, F.col("ratio") > 0.9, 3600, 7200).collect()
    assert [(x["started"], x["windows"]) for x in run] == [(ts(1), 2)]
    assert [x[0] for x in monitoring.absent(e, "ts", 3600).orderBy("window_start").collect()] == [ts(3), ts(4)]
    assert monitoring.absent(e.where("false"), "ts", 3600).count() == 0


def test_histogram_quantile(spark):
    e = spark.createDataFrame([(0.05,), (0.2,), (0.3,), (20.0,)], "v double").withColumn("g", F.lit("a"))
    h = monitoring.histogram(e, "v", monitoring.BUCKETS["http"], "g")
    q = lambda x: monitoring.histogram_quantile(h, x, "g").first()["quantile"]
    assert q(0.25) == 0.1 and q(0.5) == 0.25 and q(0.99) == 10.0


def test_counter_surge_inhibition_sessions(spark):
    s = spark.createDataFrame([("a", ts(0), 5.0), ("a", ts(1), 9.0), ("a", ts(2), 2.0)], "k string, ts timestamp, value double")
    assert [r["increase"] for r in monitoring.counter_increase(s, ["k"]).orderBy("ts").collect()] == [0.0, 4.0, 2.0]
    d = spark.createDataFrame([(ts(0), 1.0), (ts(0, 0, 2), 2.5), (ts(1), 1.0), (ts(1, 0, 2), 2.0)], "ts timestamp, v double")
    assert [r["total"] for r in monitoring.surge(d, "ts", "v", 3600).collect()] == [2.5]
    a = spark.createDataFrame([("x", "m", "critical"), ("x", "m", "warning"), ("x", "n", "warning")], "alertname string, module string, severity string")
    assert {tuple(r) for r in monitoring.inhibited(a).collect()} == {("x", "m", "critical"), ("x", "n", "warning")}
    assert {tuple(r) for r in monitoring.inhibited(a, ("alertname", "module"), ("module",)).collect()} == {("x", "m", "critical"), ("x", "n", "warning")}
    n = spark.createDataFrame([("g", ts(0)), ("g", ts(0)), ("g", ts(0, 10)), ("g", ts(0, 55)), ("g", ts(1, 5)), ("g", ts(9))], "k string, ts timestamp")
    assert [(r["notified_at"], r["alerts"]) for r in monitoring.notifications(n, 3600, "k").orderBy("notified_at").collect()] == [(ts(0), 4), (ts(1, 5), 1), (ts(9), 1)]
    u = spark.createDataFrame([(1, ts(0)), (1, ts(0, 20)), (1, ts(2))], "u int, ts timestamp")
    assert [r["n"] for r in monitoring.sessions(u, "u", "ts", 1800).orderBy("session").collect()] == [2, 1]


def test_audit_and_leaks(spark):
    a = spark.createDataFrame([("t", "1", "auth.login", "u", "juriste", "ok", None, ["doc-1"]), ("t", "2", "other", "u", "root", "error", None, ["x@y.ma"]), ("t", "3", "answer.generated", "10.0.0.1", "particulier", "ok", None, None)], "ts string, event_id string, event_type string, actor_id string, actor_role string, outcome string, error_code string, resource_ids array<string>")
    got = {r["event_id"]: r["problems"] for r in monitoring.audit_problems(a).collect()}
    assert got["1"] == [] and len(got["2"]) == 4 and got["3"] == ["forbidden content: actor_id"]
    r = spark.createDataFrame([(1, '{"a": [{"b": "/home/x/y.txt"}], "c": "raw/u.pdf", "d": "vu dans inconnu.pdf", "e": "connu.pdf", "f": ".pdf"}'), (2, None), (3, "pas du json")], "id int, body string")
    k = spark.createDataFrame([("connu",)], "doc_id string")
    assert {(x["path"], x["kind"]) for x in monitoring.leak_scan(r, "id", "body", k).collect()} == {("$.a[0].b", "absolute_path"), ("$.c", "raw_path"), ("$.d", "file_name")}
    ids = {"a/nom secret.pdf": "contrat-1", "b.docx": "bail-2"}
    report = {"x": ["data/raw/a/nom secret.pdf", "ok"], "y": "échec de C:\\data\\raw\\b.docx : illisible, voir raw/inconnu.txt"}
    assert monitoring.redact_paths(report, ids) == {"x": ["contrat-1.pdf", "ok"], "y": "échec de bail-2.docx : illisible, voir document.txt"}
    assert spark.range(1).select(monitoring.without_keys(F.create_map(F.lit("a"), F.lit(1), F.lit("b"), F.lit(2)), ["a"])).first()[0] == {"b": 2}
    lines = spark.createDataFrame([('{"query_text": "x"}',), ('{"event_id": 1}',)], "value string")
    assert monitoring.safe_lines(lines).count() == 1


def test_grid_and_closure(spark):
    m = spark.createDataFrame([("a",), ("b",), ("c",)], "member string")
    x = spark.createDataFrame([("m", "a", ["b"])], "module string, lead string, others array<string>")
    assert {(r["member"], r["role"]) for r in relations.grid(m, x, "lead", "others").collect()} == {("a", "A"), ("b", "C"), ("c", "I")}
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1)], "src int, dst int")
    assert relations.closure(e).count() == 9


def test_samples_gate_shares_board(spark):
    bad = [(f"d {k}", "T", f"S{k}", "2011", "C", "fr", "/x", 10, 5, 0, "SUCCESS") for k in range(9)]
    got = {r["expectation"]: r for r in quality.expectation_samples(spark.createDataFrame(bad, META)).collect()}
    assert got["source_in_set"]["failures"] == 9 and got["source_in_set"]["samples"] == "S0; S1; S2; S3; S4" and got["file_path_relative"]["samples"] == ""
    m = spark.createDataFrame([("a", 0.9), ("b", 0.5)], "metric string, value double")
    base = spark.createDataFrame([("b", 0.9)], "metric string, value double")
    assert quality.quality_gate(m, {"a": 0.8, "c": 0.1}, base).first()[:] == (False, ["b regressed", "c missing"])
    assert quality.quality_gate(m, {"a": 0.8}, base.limit(0)).first()["passed"]
    assert {r["value"]: r["percent"] for r in quality.shares(m, "metric").collect()} == {"a": 50.0, "b": 50.0}
    items = spark.createDataFrame([("planned", 10, ["x"]), ("done", 100, ["x", "y"]), ("done", 90, [])], "status string, progress int, tools array<string>")
    assert [r[:] for r in quality.board(items).collect()] == [("done", 2, 95, 2), ("planned", 1, 10, 1)]


def test_requests_and_spans(spark):
    r = spark.createDataFrame([("GET", "/doc/12/?x=1", 200, 0.1, None), ("GET", "/doc/7", 200, 0.2, None), ("GET", "/doc/7", 200, 0.2, "boom"), ("GET", "/metrics", 200, 0.1, None), ("GET", "/a/0123456789abcdef", 404, 0.1, None)], "method string, path string, status int, seconds double, error string")
    got = {(x["route"], x["status"]): x["n"] for x in monitoring.request_metrics(r).collect()}
    assert got == {("/doc/{id}", 200): 2, ("/doc/{id}", 500): 1, ("/a/{id}", 404): 1}
    assert monitoring.span_summary(spark.createDataFrame([("s", 1.0), ("s", 3.0)], "name string, seconds double")).first()[:] == ("s", 2, 2.0, 3.0)
