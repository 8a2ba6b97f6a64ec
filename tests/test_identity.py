"""Hand-made pages and targets for the identity operators."""

from __future__ import annotations

from probitas.operators import identity as D

G1, G2 = "27ABCDE1234F1Z5", "29XYZAB9876K1Z3"
PAGE = "page_id int, host string, title string, text string"
CASES = [
    (G1, "x.in", "Profile", f"GSTIN {G1} is active", ("TARGET_ENTITY", False, "MATCH")),
    (G1, "x.in", "Something", f"GSTIN {G2}", ("UNRELATED", True, "CONFLICT")),
    ("Alpha Foods Private Limited", "zauba.com", "Alpha Foods Pvt Ltd - Zauba", "", ("TARGET_ENTITY", False, "MATCH")),
    ("Alpha Foods", "x.in", "Beta Traders Limited", "", ("UNRELATED", True, "CONFLICT")),
    ("Alpha Foods India", "x.in", "The Alpha Group", "", ("PARENT_ENTITY", False, "INSUFFICIENT")),
    ("alphafoods official website", "www.alphafoods.com", "Home", "", ("TARGET_ENTITY", False, "CONFLICT")),
    (None, "x.in", "Beta Limited", "text", ("TARGET_ENTITY", False, "INSUFFICIENT")),
    ("Alpha Foods MCA company registration", "x.in", "Alpha Foods Pvt Ltd | MCA", "", ("TARGET_ENTITY", False, "MATCH")),
    ("Alpha Foods", None, None, None, ("UNRELATED", False, "INSUFFICIENT")),
    ("Alpha Foods", "x.in", "Register", "Home\nAlpha Foods Organics Pvt Ltd\nother", ("TARGET_ENTITY", False, "INSUFFICIENT")),
    ("Alpha Foods Organics", "x.in", "Alpha Foods Dairy Limited", "", ("TARGET_ENTITY", False, "CONFLICT")),
]


def test_identity_of_pages(spark):
    profiles = D.page_profiles(spark.createDataFrame([(k, *c[1:4]) for k, c in enumerate(CASES)], PAGE))
    tasks = spark.createDataFrame([*((k, c[0], "x") for k, c in enumerate(CASES)), (99, "gone", "x")], "page_id int, target string, note string")
    got = {r.page_id: (r.relationship, r.conflict, r.verdict) for r in D.page_identity(profiles, tasks).collect()}
    assert {k: (CASES[k][0], v) for k, v in got.items()} == {k: (c[0], c[4]) for k, c in enumerate(CASES)}


def test_gate(spark):
    rows = [
        ("WEBSITE_VERIFICATION", "TARGET_ENTITY", True, "CONFLICT", None, 0.85), ("WEBSITE_VERIFICATION", "RELATED_ENTITY", False, "MATCH", None, 0.5), ("WEBSITE_VERIFICATION", "PARENT_ENTITY", False, "MATCH", "REJECTED", None),
        ("THIRD_PARTY_RESEARCH", "TARGET_ENTITY", False, "INSUFFICIENT", "REJECTED", None), ("THIRD_PARTY_RESEARCH", "UNRELATED", False, "MATCH", None, None), ("THIRD_PARTY_RESEARCH", "TARGET_ENTITY", True, "MATCH", "REJECTED", None),
        ("GENERAL_WEB_RESEARCH", "UNRELATED", False, "CONFLICT", None, None), ("GENERAL_WEB_RESEARCH", "TARGET_ENTITY", True, "MATCH", "REJECTED", None),
        ("MCA_VERIFICATION", "UNRELATED", True, "CONFLICT", "REJECTED", None), ("MCA_VERIFICATION", "PARENT_ENTITY", True, "CONFLICT", None, None), ("ENTITY_DISCOVERY", "UNRELATED", True, "CONFLICT", None, None),
    ]
    d = spark.createDataFrame([(k, *r[:4]) for k, r in enumerate(rows)], "k int, task_type string, relationship string, conflict boolean, verdict string")
    assert [(r.gate, r.site_confidence) for r in D.entity_gate(d).orderBy("k").collect()] == [r[4:] for r in rows]


def test_outcomes(spark):
    rest = " ".join(f"w{k}" for k in range(20))
    rows = [
        ("Alpha Foods", "<title>Alpha Hotel</title>x", "IRRELEVANT_SECTOR"), ("Alpha Hotel", "<title>Alpha Hotel</title>x", None), ("Alpha Foods", f"<p>alpha inn {rest}", "IRRELEVANT_SECTOR"), ("Alpha Foods", f"<p>alpha inner foods {rest}", None),
        ("Alpha Foods", f"<p>alpha {rest}", "IRRELEVANT_CONTENT"), ("Alpha Foods", f"<p>GST portal {rest}", None), ("Alpha Foods", "<p>short", None), ("alpha.in", f"<p>{rest}", "IRRELEVANT_CONTENT"), ("https://www.alpha.in/x", f"<p>Al-pha {rest}", None),
        (G1, f"<p>{rest}", "IRRELEVANT_CONTENT"), (G1, f"<p>{G1} {rest}", None), (G1, f"<p>legal name {rest}", None), (None, f"<p>{rest}", None), ("Alpha", None, "EMPTY_RESPONSE"), ("Alpha", "<p>no records found", "NO_RESULTS"),
    ]
    pages = spark.createDataFrame([(k, r[1]) for k, r in enumerate(rows)], "page_id int, html string")
    tasks = spark.createDataFrame([(k, r[0]) for k, r in enumerate(rows)], "page_id int, target string")
    got = {r.page_id: r.outcome for r in D.page_outcome(pages, tasks).collect()}
    assert {k: (rows[k][:2], v) for k, v in got.items()} == {k: (r[:2], r[2]) for k, r in enumerate(rows)}
