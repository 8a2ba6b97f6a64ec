"""The page that each task uses: every fetch is judged in order, the first that passes is elected, and all that
were tried until then are kept as attempts with their reason.

Page-level facts (challenge, failure, title, profile) are computed once a page; target-level ones once a
fetch. Whole texts meet tasks only where the relevance of a page to a target is judged. A task's fetches
are its list of addresses, so one window by task holds few rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from probitas.operators import identity as D
from probitas.operators import pages as P
from probitas.operators.results import NO_PAGE_TIER
from probitas.sources import catalog as C

# How an attempt is recorded by what became of it, and why a page of another entity is refused.
RESULTS = {"ERROR": "Fetch Exception", "CHALLENGE": "Bot Challenge", "OUTCOME": "Failed Relevance or Blocked check", "GATE": "Entity Mismatch", "PASSED": "200 OK"}
REFUSED = {
    C.WEBSITE: "Website represents {}, not direct target entity", C.GENERAL: "General web page conflicts with target identity",
    "conflict": "Third-party page conflicts with target identity", "unconfirmed": "Third-party page identity could not be confirmed for the target entity",
    "registry": "Page does not correspond to the target entity (relationship=UNRELATED)",
}
NO_ANSWER = "no page for this address"
ATTEMPT = ("task_id", "page_id", "attempt_order", "source_name", "url", "status", "http_result", "title", "text_length", "relevance_result", "failure_reason", "confidence", "selected")


def judge_fetches(fetches: DataFrame, tasks: DataFrame, pages: DataFrame) -> DataFrame:
    """fetches (task_id, page_id, source_order, url_order, source_name, url, tier, confidence) of tasks (task_id, task_type,
    target) with what each is worth: step (ERROR, CHALLENGE, OUTCOME, GATE or PASSED), relationship, conflict, verdict, ... A
    fetch whose page is not in pages (page_id, url, html) failed; fetches of unknown tasks go."""
    asked = fetches.join(tasks.select("task_id", "task_type", "target"), "task_id")
    key = ["task_id", "page_id"]
    seen = P.page_challenge(pages).select("page_id", "challenge").join(pages.select("page_id", F.length(F.coalesce("html", F.lit(""))).alias("html_length")), "page_id")
    read = P.page_text(pages.withColumn("host", F.regexp_extract(F.lower("url"), "^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), "host")
    pairs = asked.select(*key, "task_type", "target").distinct()
    fits = D.page_outcome(pages, pairs).select(*key, "outcome")
    who = D.entity_gate(D.page_identity(D.page_profiles(read), pairs)).select(*key, "relationship", "conflict", "verdict", "gate", "site_confidence")
    told = read.select("page_id", "title", F.length(F.coalesce("text", F.lit(""))).alias("read_length"))
    d = asked.join(seen, "page_id", "left").join(told, "page_id", "left").join(fits, key, "left").join(who, key, "left")
    step = F.when(F.col("html_length").isNull(), "ERROR").when(F.col("challenge").isNotNull(), "CHALLENGE").when(F.col("outcome").isNotNull(), "OUTCOME").when(F.col("gate").isNotNull(), "GATE").otherwise("PASSED")
    return d.withColumn("step", step)


def page_attempts(judged: DataFrame) -> DataFrame:
    """The fetches of judge_fetches() that were made, as attempts (ATTEMPT, tier and conflict): in order of source, then
    url, then page, up to the first that passes; that one is selected."""
    order = ("source_order", "url_order", "page_id")
    w = Window.partitionBy("task_id")
    d = judged.withColumn("at", F.struct(*order)).withColumn("first", F.min(F.when(F.col("step") == "PASSED", F.col("at"))).over(w))
    d = d.filter(F.col("first").isNull() | (F.col("at") <= F.col("first"))).withColumn("attempt_order", F.row_number().over(w.orderBy(*order)))
    step, kind = F.col("step"), F.col("task_type")
    third = F.when((F.col("verdict") == "CONFLICT") | F.col("conflict"), REFUSED["conflict"]).otherwise(REFUSED["unconfirmed"])
    refused = F.when(kind == C.WEBSITE, F.format_string(REFUSED[C.WEBSITE].replace("{}", "%s"), "relationship")).when(kind == C.THIRD, third).when(kind == C.GENERAL, REFUSED[C.GENERAL]).otherwise(REFUSED["registry"])
    reason = F.when(step == "ERROR", NO_ANSWER).when(step == "CHALLENGE", F.concat(F.lit("Verification challenge detected: "), "challenge")).when(step == "OUTCOME", F.concat(F.lit("Classification: "), "outcome")).when(step == "GATE", refused)
    by = lambda *v: F.when(step == "ERROR", v[0]).when(step == "CHALLENGE", v[1]).when(step == "OUTCOME", v[2]).when(step == "GATE", v[3]).otherwise(v[4])
    known, blocked = step.isin("GATE", "PASSED"), F.lit("BLOCKED_OR_ERROR")
    made = {
        "status": by(F.lit("ERROR"), blocked, F.col("outcome"), F.lit("REJECTED"), F.lit("SUCCESS")),
        "http_result": by(*map(F.lit, RESULTS.values())),
        "relevance_result": by(F.lit(None).cast("string"), blocked, F.col("outcome"), F.lit("ENTITY_MISMATCH"), F.lit("PASSED")),
        "failure_reason": reason,
        "title": F.when(known, F.col("title")),
        "text_length": F.coalesce(F.when(known, F.col("read_length")).otherwise(F.col("html_length")), F.lit(0)),
        "confidence": F.when(step == "PASSED", F.coalesce("site_confidence", "confidence")).otherwise(0.0),
        "selected": step == "PASSED",
    }
    return d.withColumns(made).select(*ATTEMPT, "tier", "conflict")


def elected_pages(tasks: DataFrame, attempts: DataFrame) -> DataFrame:
    """tasks with page_id, url, source_name, tier, confidence and entity_conflict of their selected attempt; without
    one no page, tier 4, confidence 0 and no conflict: what results.page_results() takes."""
    won = attempts.filter("selected").select("task_id", "page_id", "url", "source_name", F.col("tier").alias("t_"), F.col("confidence").alias("c_"), F.col("conflict").alias("x_"))
    d = tasks.join(won, "task_id", "left")
    return d.select(*tasks.columns, "page_id", "url", "source_name", F.coalesce("t_", F.lit(NO_PAGE_TIER)).alias("tier"), F.coalesce("c_", F.lit(0.0)).alias("confidence"), F.coalesce("x_", F.lit(False)).alias("entity_conflict"))
