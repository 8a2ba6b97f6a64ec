"""Links, names and results on hand-made rows."""

from pyspark.sql import functions as F

from probitas.operators import links as K
from probitas.operators import names as N
from probitas.operators import pages as P
from probitas.operators import results as R


def score(spark, rows):
    d = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, url string, target string, task_type string, score string")
    got = K.score_links(d.drop("score")).orderBy("i").collect()
    return [(r.score, r.relationship) for r in got]


def test_score_links(spark):
    alpha, web, third = "Alpha Foods Private Limited", "WEBSITE_VERIFICATION", "THIRD_PARTY_RESEARCH"
    rows = [
        ("ftp://alphafoods.com", alpha, web), (None, alpha, web), ("https://www.google.com/alphafoods", alpha, web), ("https://alphafoods.com/hotel", alpha, web), ("https://x.org/27abcde1234f1z5", "27ABCDE1234F1Z5", web), ("https://x.org/", "the company", web),
        ("https://www.tofler.in/alpha-foods", alpha, web), ("https://www.alphafoods.com/about", alpha, web), ("https://alpha.com/", "Alpha Foods Trading", web), ("https://af.com/", alpha, web),
        ("https://tofler.in/alpha-foods", alpha, third), ("https://tofler.in/alpha", "Alpha Foods Trading", third), ("https://other.in/alpha-foods", alpha, third), ("https://other.in/alpha", "Alpha Foods Trading", third), ("https://other.in/none", alpha, third),
        ("https://alphafoods.com/", alpha, None), ("https://alpha.com/", alpha, "MCA_VERIFICATION"), ("https://none.com/", None, "MCA_VERIFICATION"),
    ]
    want = [
        (0.0, "UNRELATED"), (0.0, "UNRELATED"), (0.0, "UNRELATED"), (0.0, "UNRELATED"), (1.0, "TARGET_ENTITY"), (0.5, "UNKNOWN"), (0.0, "UNRELATED"), (0.9, "TARGET_ENTITY"), (0.35, "PARENT_ENTITY"), (0.9, "TARGET_ENTITY"),
        (0.95, "TARGET_ENTITY"), (0.5, "RELATED_ENTITY"), (0.75, "TARGET_ENTITY"), (0.4, "RELATED_ENTITY"), (0.0, "UNRELATED"), (0.85, "TARGET_ENTITY"), (0.6, "RELATED_ENTITY"), (0.5, "UNKNOWN"),
    ]
    assert score(spark, [(*r, None) for r in rows]) == want


def test_links_are_found_scored_and_followed(spark):
    html = """<a href='/l/?uddg=https%3A%2F%2Fx.org%2Fa%2Bb&rut=1'><a HREF="//y.org/z"><a href="/url?q=ftp://no"><a href="https://x.org/a+b"><a href="//y.org/z"><a href="/plain">"""
    own = '<a href="/company/alpha-foods"><a href="/company/alpha"><a href="https://elsewhere.com/company/alpha-foods"><a href="/company/zzz"><a href="/company/alpha-foods">'
    pages = spark.createDataFrame([(1, "https://d.in/search", html), (2, "https://www.d.in/find", own), (3, "https://www.d.in/company/alpha-foods", "<p>Alpha Foods</p>"), (4, None, None)], "page_id long, url string, html string")
    assert [(r.pos, r.link) for r in K.search_links(pages.filter("page_id <> 2")).orderBy("page_id", "pos").collect()] == [(0, "https://x.org/a+b"), (1, "https://y.org/z")]
    tasks = spark.createDataFrame([(i, "T", "Alpha Foods Limited", "MCA_VERIFICATION") for i in (1, 2, 4)], "page_id long, task_id string, target string, task_type string")
    found = K.discover_links(pages, tasks)
    assert {(r.page_id, r.link, r.score) for r in found.collect()} == {(2, "https://www.d.in/company/alpha-foods", 0.85), (2, "https://www.d.in/company/alpha", 0.6)}
    best = K.best_links(found)
    assert [(r.page_id, r.link) for r in best.collect()] == [(2, "https://www.d.in/company/alpha-foods")]
    assert {r.page_id: r.used_page_id for r in K.follow_links(pages, tasks, best).collect()} == {1: 1, 2: 3, 4: 4}


def test_names(spark):
    rows = {
        "ALPHA FOODS LIMITED HAVING CIN U12345MH2001PTC123456 IS 45 YEARS OLD": "ALPHA FOODS LIMITED", "Alpha Foods Pvt Ltd - Company Details | Tofler": "Alpha Foods Pvt Ltd", "Alpha Financials | Company Details": "Alpha", "Alpha &amp; Sons <b>LLP</b>": "Alpha & Sons LLP",
        "Alpha Limited in Pune, India": "Alpha Limited", "Alpha Limited, Mumbai 400001": "Alpha Limited", "Alpha Limited | Where Quality Matters": "Alpha Limited", "Welcome to Alpha": None, "Search results for Alpha": None, "GST Portal": None, "Al": None, None: None, "": None,
    }
    d = spark.createDataFrame([(k, v) for k, v in rows.items()], "title string, want string")
    assert [(r.title, r.got) for r in d.select("title", N.legal_name(F.col("title")).alias("got")).collect()] == list(rows.items())
    pages = spark.createDataFrame(
        [(1, "Alpha Ltd", "x\nCompany Name: Beta Works Limited\n", "T", "MCA"), (2, "Alpha Ltd - Home", "x", "T", "MCA"), (3, None, "x", "Gamma Limited", "ENTITY_DISCOVERY"), (4, None, "x", "Gamma Limited", "MCA"), (5, "Alpha", None, "T", "MCA")],
        "page_id int, title string, text string, target string, task_type string",
    )
    assert [r.legal_name for r in N.page_names(pages).orderBy("page_id").collect()] == ["Beta Works Limited", "Alpha Ltd", "Gamma Limited", "NOT_FOUND", "NOT_FOUND"]
    found = N.candidates_in_text(pages, "page_id").orderBy("page_id", "pos").collect()
    assert [(r.page_id, r.name) for r in found] == [(1, "Beta Works Limited"), (2, "Alpha Ltd"), (3, "Gamma Limited")]
    assert found[-1].source_text == N.OPEN + "x" + N.CLOSE
    near = N.candidate_from_directory(spark.createDataFrame([("Alpha Foods Ltd", "Alpha Foods"), ("Beta", "Alpha Foods"), (None, "Alpha Foods")], "title string, target string")).collect()
    assert [(r.name, r.confidence) for r in near] == [("Alpha Foods Ltd", 0.85), ("Beta", 0.4), ("Alpha Foods", 0.85)]


def test_epfo_status(spark):
    d = spark.createDataFrame([("Registered, closed in 1999",), ("Establishment Details",), ("none",), (None,)], "t string")
    assert [r[0] for r in d.select(P.epfo_status(F.col("t"))).collect()] == ["INACTIVE", "AVAILABLE", "UNAVAILABLE", "UNAVAILABLE"]


def test_pages_to_results(spark):
    tasks = spark.createDataFrame([("A", ["gstin", "title"], False), ("B", ["gstin", "title"], True), ("C", ["gstin"], None), ("D", [], False)], "task_id string, required_fields array<string>, entity_conflict boolean")
    fetches = spark.createDataFrame(
        [("A", 1, 0, True, 5, "https://a.gov.in/x", "MCA", 2, 0.6), ("A", 0, 0, False, 4, "u4", "S4", 2, 0.9), ("A", 2, 0, True, 6, "u6", "S6", 2, 0.9), ("B", 0, 0, True, 7, "u7", None, 3, 0.7), ("C", 0, 0, None, 8, "u8", "S8", 3, 0.7)],
        "task_id string, source_order int, url_order int, usable boolean, page_id long, url string, source_name string, tier int, confidence double",
    )
    values = spark.createDataFrame([(5, "gstin", "G"), (7, "gstin", "H"), (7, "title", "Seven")], "page_id long, field_name string, field_value string")
    got = R.page_results(R.choose_page(tasks, fetches), values).orderBy("result_id").collect()
    assert [(r.result_id, r.field_value, r.source_name, r.confidence, r.verification_status, r.tier) for r in got] == [
        ("RESULT-A-001", "G", "MCA", 0.6, "VERIFIED", 1), ("RESULT-A-002", "NOT_FOUND", "MCA", 0.0, "NOT_FOUND", 2), ("RESULT-B-001", "H", "Public Source", 0.0, "REJECTED", 5),
        ("RESULT-B-002", "Seven", "Public Source", 0.7, "VERIFIED", 3), ("RESULT-C-001", "NOT_FOUND", "Public Source", 0.0, "SOURCE_UNAVAILABLE", 4),
    ]


def test_later_extractors_take_precedence(spark):
    tasks = spark.createDataFrame([("1", "X"), ("2", "Y"), ("3", None)], "task_id string, task_type string")
    by = lambda n: lambda d: d.select("task_id", F.lit(n).alias("by"))
    got = R.dispatch(tasks, [(lambda t: t.isin("X", "Y"), by("first")), (lambda t: t == "X", by("second"))])
    assert {(r.task_id, r.by) for r in got.collect()} == {("1", "second"), ("2", "first")}
