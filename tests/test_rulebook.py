"""Rules as data: files and tables, what they may change, and that they cost no pass over evidence."""

from __future__ import annotations

import json

import pytest

from probitas.operators import risk as K
from probitas.operators.rulebook import Rule, parse_rules, read_rules, rule_of, rules_from_table
from tests.test_operators import ev


def test_a_file_with_all_defaults_is_the_book(spark, tmp_path):
    names = [r.code for r in K.BOOK.rules]
    text = json.dumps({"rules": {n: {} for n in names}, "risk_levels": {n.lower(): {"min": a, "max": b} for n, a, b in K.LEVELS}})
    assert parse_rules(text, K.BOOK) == K.BOOK == parse_rules("{}", K.BOOK)
    (tmp_path / "rules.yaml").write_text("rules:\n  GST_INACTIVE:\n    weight: 31\n    description: it is off\nrisk_levels:\n  bad: {min: 1, max: 100}\n")
    book = read_rules(spark, str(tmp_path / "rules.yaml"), K.BOOK)
    assert [(r.code, r.weight, r.values) for r in book.rules] == [("GST_INACTIVE", 31, K.GST_BAD)] and book.levels == (("BAD", 1, 100),)


def test_custom_rules_score(spark):
    book = K.BOOK.with_rule(Rule("PHONE_CONFLICT", 12, "IDENTITY", "LOW", "differs", (("phone",), ("fax",)), "activity")).with_rule(Rule("GST_INACTIVE", 99, "COMPLIANCE", "HIGH", "one_of", (("gst_status",),), "text", ("odd",)))
    book = book.with_levels(("CALM", 0, 11), ("LOUD", 12, 100))
    rows = ev(spark, (1, "a", "phone", "1-2", "s", 0.9, "VERIFIED"), (1, "b", "fax", "9", "s", 0.9, "VERIFIED"), (1, "c", "phone", "12", "s", 0.9, "VERIFIED"), (1, "d", "fax", "8", "s", 0.7, "VERIFIED"), (2, "e", "gst_status", "inactive", "s", 0.9, "VERIFIED"), (3, "f", "gst_status", " ODD ", "s", 0.9, "VERIFIED"))
    who = spark.createDataFrame([(1,), (2,), (3,), (4,)], "investigation_id long")
    got = {r.investigation_id: (r.score, r.level) for r in K.risk_scores(who, rows, book).collect()}
    assert got == {1: (12, "LOUD"), 2: (0, "CALM"), 3: (99, "LOUD"), 4: (None, "INSUFFICIENT_EVIDENCE")}
    s = K.attach_rules(K.exploded(K.risk_profile(rows, book)), book.catalog(spark)).filter("investigation_id = 1").first()
    assert (s.code, s.evidence_ids, s.risk_weight, round(s.confidence, 4)) == ("PHONE_CONFLICT", ["b", "d"], 12, 0.8)


def test_tables_add_and_change(spark):
    t = spark.createDataFrame([("NEW", 3, "one_of", ["x"], ["y"]), ("GST_INACTIVE", 1, None, None, None)], "code string, weight int, kind string, fields array<string>, values array<string>")
    book = rules_from_table(t, K.BOOK)
    assert len(book.rules) == 7 and {r.code: r.weight for r in book.rules} | {"NEW": 3, "GST_INACTIVE": 1} == {r.code: r.weight for r in book.rules}
    assert rules_from_table(t.limit(0), K.BOOK) == K.BOOK


@pytest.mark.parametrize("row", [{"code": "A", "kind": "odd", "fields": ["x"]}, {"code": "A", "kind": "one_of", "fields": ["x"]}, {"code": "A", "kind": "differs", "fields": []}, {"code": "A", "kind": "younger_than", "fields": ["x"]}, {"code": "A", "kind": "one_of", "fields": [["x"], ["y"]], "values": ["v"]}, {"code": "A", "kind": "differs", "fields": ["x"], "form": "odd"}, {"code": "A", "wieght": 3}])
def test_bad_rules_are_refused(row):
    with pytest.raises((ValueError, TypeError)):
        rule_of(row)


def test_more_rules_cost_no_scan(spark):
    rows = ev(spark, (1, "a", "phone", "1", "s", 0.9, None))
    plan = lambda book: K.risk_profile(rows, book)._jdf.queryExecution().executedPlan().toString()
    more = K.BOOK.with_rule(Rule("P", 1, "IDENTITY", "LOW", "differs", (("phone",),), "activity"))
    assert plan(K.BOOK).count("Exchange") == plan(more).count("Exchange") and plan(K.BOOK).count("Scan") == plan(more).count("Scan")
