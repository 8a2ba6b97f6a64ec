"""Which page a task uses: losers before the winner are attempts with reasons, fetches after it were never made."""

from __future__ import annotations

from probitas.operators import election as E
from probitas.operators import lifecycle as Y
from probitas.operators import results as R

ALPHA = "<html><title>Alpha Foods Private Limited</title><body>" + "Alpha Foods Private Limited makes food in Pune. " * 6 + "GSTIN 27ABCDE1234F1Z5</body></html>"
OTHER = "<html><title>Zenith Steel Limited</title><body>" + "Zenith Steel Limited is a maker of rails and beams. Company status Active. " * 5 + "</body></html>"
ROBOT = "<html><title>Wait</title><body>Please solve the captcha to prove that you are human</body></html>"
TASKS = [(1, "THIRD_PARTY_RESEARCH", "Alpha Foods Private Limited"), (2, "WEBSITE_VERIFICATION", "Alpha Foods Private Limited"), (3, "GST_VERIFICATION", "Alpha Foods Private Limited"), (4, "GENERAL_WEB_RESEARCH", None)]


def judged(spark, fetches):
    pages = spark.createDataFrame([(10, "https://a.in/x", ROBOT), (11, "https://zenithsteel.in/", OTHER), (12, "https://alphafoods.com/", ALPHA), (13, "https://b.in/", ALPHA), (14, "https://c.in/", None)], "page_id long, url string, html string")
    tasks = spark.createDataFrame(TASKS, "task_id long, task_type string, target string")
    f = spark.createDataFrame([(t, p, so, uo, f"S{p}", f"u{p}", 2, 0.6) for t, p, so, uo in fetches], "task_id long, page_id long, source_order int, url_order int, source_name string, url string, tier int, confidence double")
    return tasks, E.judge_fetches(f, tasks, pages)


def test_election(spark):
    tasks, d = judged(spark, [(1, 13, 2, 0), (1, 12, 1, 1), (1, 11, 1, 0), (1, 10, 0, 0), (1, 99, 0, 1), (2, 11, 0, 0), (2, 12, 0, 1), (3, 14, 0, 0), (9, 12, 0, 0)])
    a = E.page_attempts(d)
    got = [(r.task_id, r.page_id, r.attempt_order, r.status, r.selected) for r in a.orderBy("task_id", "attempt_order").collect()]
    first = [(1, 10, 1, "BLOCKED_OR_ERROR", False), (1, 99, 2, "ERROR", False)]
    assert got[:2] == first and got[2][:3] == (1, 11, 3) and got[2][4] is False and got[3] == (1, 12, 4, "SUCCESS", True)
    assert [g for g in got if g[0] == 1] == got[:4]  # what comes after the winner was never fetched
    assert [(g[1], g[4]) for g in got if g[0] == 2] == [(11, False), (12, True)] and [(g[1], g[3]) for g in got if g[0] == 3] == [(14, "EMPTY_RESPONSE")]
    reasons = {r.page_id: r.failure_reason for r in a.filter("task_id = 1").collect()}
    assert reasons[10].startswith("Verification challenge detected: ") and reasons[99] == E.NO_ANSWER and reasons[11] and reasons[12] is None
    chosen = {r.task_id: r for r in E.elected_pages(tasks, a).collect()}
    assert (chosen[1].page_id, chosen[1].confidence, chosen[2].confidence) == (12, 0.6, 0.85)
    assert (chosen[3].page_id, chosen[3].tier, chosen[3].confidence) == (None, 4, 0.0) and chosen[4].page_id is None


def test_results_and_log_of_an_election(spark):
    """The elected page's values become results; all attempts go to the log, with their source type."""
    tasks, d = judged(spark, [(1, 11, 0, 0), (1, 12, 1, 0), (3, 10, 0, 0)])
    a = E.page_attempts(d)
    values = spark.createDataFrame([(12, "gstin", "27ABCDE1234F1Z5")], "page_id long, field_name string, field_value string")
    wanted = E.elected_pages(tasks.selectExpr("*", "array('gstin', 'cin') AS required_fields"), a)
    r = {(x.task_id, x.field_name): (x.field_value, x.verification_status) for x in R.page_results(wanted, values).collect()}
    assert r[1, "gstin"] == ("27ABCDE1234F1Z5", "UNVERIFIED") and r[1, "cin"] == ("NOT_FOUND", "NOT_FOUND") and r[3, "gstin"] == ("NOT_FOUND", "SOURCE_UNAVAILABLE")
    new = a.selectExpr("row_number() OVER (ORDER BY task_id, attempt_order) AS attempt_id", "task_id AS investigation_id", "source_name AS domain", "status", "0 AS action_count", "source_name", "url", "attempt_order", "array('S12') AS preferred_sources")
    log = Y.append_attempts(spark.createDataFrame([], "attempt_id long, investigation_id long, domain string, status string, action_count int, metadata_json string"), new)
    assert log.count() == 3 and log.filter("metadata_json like '%preferred%'").count() == 1


def test_no_fetches(spark):
    tasks, d = judged(spark, [(1, 12, 0, 0)])
    none = E.page_attempts(d.limit(0))
    assert none.collect() == [] and {r.tier for r in E.elected_pages(tasks, none).collect()} == {4}
