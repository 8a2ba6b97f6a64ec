"""Intake, value shapes, entities, tasks, progress, reports and their checks on hand-made rows."""

from __future__ import annotations

import uuid

import pytest
from pyspark.sql import functions as F

from probitas.functions import text as X
from probitas.operators import evidence as E
from probitas.operators import intake as N
from probitas.operators import lifecycle as Y
from probitas.operators import qa as Q
from probitas.operators import report as R
from probitas.sources import catalog as C
from tests.test_operators import ev


def said(spark, column, values):
    rows = spark.createDataFrame(list(enumerate(values)), "i int, x string").select("i", column(F.col("x")).alias("y")).orderBy("i").collect()
    return [r.y for r in rows]


def test_locations(spark):
    cases = {" located in new delhi, NEW DELHI ": "New Delhi", "Mumbai &amp; more": "Mumbai", "<b>pune</b> | official website of x": "Pune", "o'neil new-delhi/goa;": "O'Neil New-Delhi, Goa", ",": None, None: None, "a": None, "City of Agra?x=1": "Agra"}
    assert said(spark, X.norm_location, cases) == list(cases.values())


def test_legal_names(spark):
    good = ["Alpha Foods Private Limited", "404 Digital"[4:], "India Cements Limited", "A" * 150]
    bad = [None, "", " ", "A" * 151, "Alpha Foods in Maharashtra, India", "Alpha U12345MH2001PTC123456", "Alpha 27ABCDE1234F1Z5", "Alpha having CIN 1", "Alpha is 12 years old", "Alpha date of incorporation", "Alpha registered on 2001", "Not Applicable", "Welcome to Alpha", "404 not there", "Delhi", "new delhi,"]
    assert said(spark, X.is_legal_name, good) == [True] * len(good) and said(spark, X.is_legal_name, bad) == [False] * len(bad)


def test_activities(spark):
    good = ["Software", "IT services", "Wholesale trade", "Manufacture of paper (kraft)", "Home Products And Services For Careers"]
    bad = [None, "ab", "x" * 251, "two\nlines", "see https://x.y", "<p> trade", "trade …", "what trade?", "Printing [Includes printing of books]", "Paper (n.e.c.)", "12345 67 a", "27ABCDE1234F1Z5 trade", "Nature of Business Activities:", "A | B | C | D", "Home Products Services Careers Contact"]
    assert said(spark, X.is_activity, good) == [True] * len(good) and said(spark, X.is_activity, bad) == [False] * len(bad)


def test_intake(spark):
    rows = [(1, " alpha  foods", " 27abcde1234f1z5", "U12345MH2001PTC123456", " a  b ", "Alpha.com/x", "pune"), (2, " ", "bad", "Z12345MH2001PTC123456", "", "localhost", " "), (3, None, None, None, None, "ftp://a.b", None)]
    d = N.normalize_intake(spark.createDataFrame(rows, "investigation_id long, business_name string, gstin string, cin string, epfo_code string, website string, location string")).orderBy("investigation_id").collect()
    assert tuple(d[0])[1:7] == ("ALPHA FOODS", "27ABCDE1234F1Z5", "U12345MH2001PTC123456", "a b", "https://alpha.com/x", "Pune") and set(d[0].provenance) == {"USER_SUPPLIED"}
    assert tuple(d[1])[1:7] == (None,) * 6 and tuple(d[1].provenance) == ("NOT_CHECKED", "INVALID", "INVALID", "NOT_CHECKED", "INVALID", "NOT_CHECKED")
    assert tuple(d[2])[1:7] == (None,) * 6 and d[2].provenance.website == "INVALID" and d[2].provenance.gstin == "NOT_CHECKED"


def test_read_intake(spark, tmp_path):
    (tmp_path / "r.json").write_text('{"business_name": "x", "gstin": "1234567890123456", "other": 1}\n{}\n')
    assert sorted(r.too_long for r in N.read_intake(spark, str(tmp_path / "r.json")).collect()) == [[], ["gstin"]]


def test_entities(spark):
    names = ["Alpha Foods", "é", "x" * 300]
    assert said(spark, N.entity_id, [*names, "", None]) == [*(str(uuid.uuid5(uuid.NAMESPACE_DNS, n)) for n in names), None, None]
    t = spark.createDataFrame([(1, "a", "g", None), (2, "b", None, "w")], "k int, name string, gstin string, website string")
    c = spark.createDataFrame([(1, "A", " not_found", "new")], "k int, name string, gstin string, website string")
    got = {r.k: tuple(r)[1:] for r in N.merge_entity(t, c, ("name", "gstin", "website"), "k").collect()}
    assert got == {1: ("A", "g", "new"), 2: ("b", None, "w")}
    kept = N.dropped_identifiers(spark.createDataFrame([(1, "g", "N/A", "e"), (2, None, " ", None)], "investigation_id int, gstin string, cin string, epfo_code string"), spark.createDataFrame([(1, "", None, "e"), (2, None, None, None)], "investigation_id int, gstin string, cin string, epfo_code string"))
    assert [tuple(r) for r in kept.collect()] == [(1, "gstin")]


def test_blocked_tasks_are_requeued_unless_the_case_is_closed(spark):
    t = spark.createDataFrame([(1, "a", Y.BLOCKED, "OTP", "x"), (1, "b", "FAILED", None, "x"), (2, "c", Y.BLOCKED, "OTP", "x"), (3, "d", Y.BLOCKED, "OTP", "x")], "investigation_id int, task_id string, status string, intervention_type string, started_at string")
    i = spark.createDataFrame([(1, "FAILED"), (2, "RUNNING")], "investigation_id int, status string")
    got = {r.task_id: tuple(r)[2:] for r in Y.requeue_blocked(t, i).collect()}
    assert got == {"a": ("PENDING", None, None), "b": ("FAILED", None, "x"), "c": (Y.BLOCKED, "OTP", "x"), "d": (Y.BLOCKED, "OTP", "x")}
    assert Y.pending_interventions(t).count() == 3


def test_progress(spark):
    d = spark.createDataFrame([(1, "NORMALIZED", "intake"), (2, "COMPLETED", "qa"), (3, "RISK_ANALYSIS", None)], "investigation_id int, status string, node string")
    got = {(r.investigation_id, r.stage): (r.completed, r.active) for r in Y.stage_progress(d).collect()}
    assert got[1, "Entity Discovery"] == (False, True) and got[1, "Intake"] == (True, False) and got[1, "QA"] == (False, False)
    assert got[2, "QA"] == (True, True) and got[3, "Entity Resolution"] == (True, False) and got[3, "Risk Analysis"] == (False, True) and len(got) == 24


def test_admitted_results_and_bounded_items(spark):
    d = ev(spark, (1, "a", "legal_name", "Welcome to x", "s", 0.9, None), (1, "b", "legal_name", "Alpha", "s", 0.9, None), (1, "c", "business_activity", "?", "s", 0.9, None), (1, "d", "registered_address", "Pune", "s", 0.9, None), (1, "e", "gstin", "", "s", 0.9, None))
    good, bad = E.split_valid(d)
    assert [r.research_result_id for r in good.collect()] == ["b"] and {r.research_result_id: len(r.errors) for r in bad.collect()} == {"a": 1, "c": 1, "d": 1, "e": 1}
    x = spark.createDataFrame([([("n", "x" * 3000)],), ([("n", "x" * 2000)] * 11,)], "x array<struct<name:string,text:string>>")
    got = [r.y for r in x.select(E.bound_items(F.col("x"), ("name", "text")).alias("y")).collect()]
    assert got[0][0].text == "x" * 2000 + E.CUT and got[1][0].text is None and len(got[1]) == 11 and got[1][0].name == "n"


@pytest.mark.parametrize(("insufficient", "limited", "gst", "gstin", "want"), [(False, True, "BLOCKED", None, []), (True, False, "VERIFIED", "g", ["INSUFFICIENT_EVIDENCE"]), (True, None, "NOT_FOUND", None, ["AUTHORITATIVE_SOURCES_UNAVAILABLE", "NO_VERIFIED_ENTITY_RECORD", "INSUFFICIENT_EVIDENCE"]), (True, True, None, "", ["AUTHORITATIVE_SOURCES_UNAVAILABLE", "NO_VERIFIED_ENTITY_RECORD", "INSUFFICIENT_EVIDENCE"])])
def test_reason_codes(spark, insufficient, limited, gst, gstin, want):
    d = spark.createDataFrame([(insufficient, limited, gst, gstin)], "i boolean, l boolean, g string, n string")
    assert d.select(R.reason_codes(F.col("i"), F.col("l"), F.col("g"), F.lit("VERIFIED"), F.col("n"), F.lit(None).cast("string"))).first()[0] == want


def test_consistency_records(spark):
    e = ev(spark, (1, "a", "website", "https://a.in", "s2", 0.9, None), (1, "b", "website", "https://A.in", "s1", 0.9, None), (1, "c", "website", "x", "s2", 0.4, None), (1, "d", "legal_name", "Alpha Steel", "s1", 0.9, None), (1, "e", "legal_name", "Alpha Steel Works", "s2", 0.9, None), (1, "f", "gstin", "G1", "User Input", 0.9, None))
    i = spark.createDataFrame([(1, "https://b.in", "G2"), (2, None, "unknown")], "investigation_id long, website string, gstin string")
    got = {(r.investigation_id, r.field_key): r for r in R.consistency_records(e, i).collect()}
    assert len(got) == 22
    assert got[1, "website"].analysis == "Conflicting data reported across sources: s2: https://a.in; s1: https://A.in; User Input: https://b.in."
    assert (got[1, "legal_name"].status, got[1, "legal_name"].analysis) == ("PARTIAL_MATCH", "Minor formatting or text variations observed across sources: Alpha Steel, Alpha Steel Works.")
    assert [tuple(x) for x in got[1, "gstin"].sources] == [("User Input", "G1")] and got[2, "gstin"].status == "UNAVAILABLE" and got[2, "gstin"].sources == []


def test_verdict(spark):
    reports = spark.createDataFrame([(1, "A", "g", None, None, 0.9, 10, "LOW"), (2, "", None, None, None, 0.9, 10, "LOW"), (3, "C", None, None, None, 0.4, None, "INSUFFICIENT_EVIDENCE"), (4, "D", None, None, None, 0.4, 11, "LOW")], "investigation_id long, business_name string, gstin string, cin string, epfo_code string, entity_confidence double, score int, level string")
    requests = spark.createDataFrame([(k, "g", None, None) for k in (1, 2)], "investigation_id long, gstin string, cin string, epfo_code string")
    scores = spark.createDataFrame([(1, 10), (2, 10), (3, None), (4, 10)], "investigation_id long, score int")
    e = ev(spark, (1, "a", "gst_status", "Active", "s", 0.9, None))
    f = spark.createDataFrame([(1, "GST_INACTIVE", "a scam", ["a"]), (1, "X", "fine", ["zz"])], "investigation_id long, code string, description string, evidence_ids array<string>")
    issues = Q.qa_issues(reports, requests, f, e, scores, Q.check_grounding(f, e))
    got = {r.investigation_id: r for r in Q.qa_verdict(reports, issues, Q.grounding_coverage(reports, Q.check_grounding(f, e))).collect()}
    assert got[1].issues == ["MISSING_EVIDENCE", "REPORT_WORDING", "UNSUPPORTED_CLAIM"] and got[1].coverage == 0.5 and got[1].entity_verified
    assert got[2].issues == ["WRONG_ENTITY"] and not got[2].entity_verified and got[3].status == "PASS"
    assert got[4].issues == ["WRONG_ENTITY", "WRONG_RISK_SCORE"] and not got[4].score_verified


def test_nested_report(spark):
    from probitas.operators import risk as K

    e = ev(spark, (1, "b", "gst_status", "Cancelled", "GST Portal", 0.9, "VERIFIED"), (1, "a", "legal_name", "Alpha", "Tofler", 0.3, None))
    entities = spark.createDataFrame([(1, "Alpha", "g", None, None, 0.8), (2, "Beta", None, None, None, 0.0)], "investigation_id long, business_name string, gstin string, cin string, website string, entity_confidence double")
    attempts = spark.createDataFrame([(1, 2, "gst.gov.in", "BLOCKED")], "attempt_id long, investigation_id long, domain string, status string")
    status = R.source_status(e, C.source_catalog(spark))
    r = {x.investigation_id: x for x in R.build_reports(entities, K.risk_scores(entities, e), K.risk_signals(e), status, R.source_limitations(status, attempts), attempts, e).collect()}
    assert r[1].overall_risk.score == 30 and r[1].assessment_status == "COMPLETED" and [f.code for f in r[1].major_findings] == ["GST_INACTIVE"] and r[1].category_scores.compliance == 30
    assert [x.research_result_id for x in r[1].evidence_summary] == ["a", "b"] and r[1].verification_summary["gst"].status == "VERIFIED" and [x.field_name for x in r[1].unverified_information] == ["legal_name"]
    assert r[2].reason_codes == ["NO_VERIFIED_ENTITY_RECORD", "INSUFFICIENT_EVIDENCE"] and r[2].evidence_summary == [] and len(r[2].cross_source_consistency) == 11 and r[2].recommendation == R.RECOMMENDATIONS[0]


def test_reports_take_the_entity_that_resolution_chooses(spark):
    """Only own evidence of confidence 0.5 counts; the first of equal candidates wins; placeholders never override."""
    given = spark.createDataFrame([(1, "Alpha Foods Ltd", None, None, None, None), (2, "Beta Steel", "27ABCDE1234F1Z5", None, None, None), (3, "Gamma", None, None, None, None), (4, None, None, None, None, None)], "investigation_id long, business_name string, gstin string, cin string, website string, location string")
    lists = [
        (1, 1, 0.4, '[{"name": "Alpha Foods", "cin": "WEAK"}]'), (1, 2, 0.9, '[{"name": "Zed Works"}, {"name": "Alpha Foods", "gstin": "NOT_FOUND", "cin": "C1"}, {"name": "ALPHA FOODS", "cin": "C2"}]'),
        (2, 1, 0.9, '[{"name": "Beta Steel", "gstin": "29XXXXX1234F1Z5"}]'), (3, 1, 0.9, "not a list"), (4, 1, 0.9, '[{"name": "Only"}]'),
    ]
    rows = spark.createDataFrame([(i, s, "candidate_entities", c, v) for i, s, c, v in lists], "investigation_id long, ev_seq int, field_name string, confidence double, field_value string")
    got = {r.investigation_id: r for r in N.resolved_entities(given, rows).collect()}
    assert (got[1].name, got[1].gstin, got[1].cin, got[1].entity_confidence, got[1].resolution_status) == ("Alpha Foods", None, "C1", 1.0, "SIMILARITY")
    assert (got[2].name, got[2].gstin, got[2].entity_confidence, got[2].resolution_status) == ("Beta Steel", "27ABCDE1234F1Z5", 0.0, "CONFLICTING_IDENTITY")
    assert (got[3].name, got[3].entity_confidence, got[3].resolution_status) == ("Gamma", 0.0, "NO_MATCH") and (got[4].name, got[4].resolution_status) == ("Only", "NO_MATCH")
    assert all(r.business_name == g.business_name for r, g in zip(sorted(got.values()), given.orderBy("investigation_id").collect(), strict=True))
