"""Quality checks of reports: every finding cites evidence of its own investigation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from probitas.operators.intake import dropped_identifiers

# Words that need support in cited evidence, and where each issue leads.
UNSAFE = ("fraudster", "fraud", "scam", "fake")
NEXT = (("WRONG_ENTITY", "entity_resolution"), ("MISSING_EVIDENCE", "planner"), ("UNSUPPORTED_CLAIM", "planner"), ("WRONG_RISK_SCORE", "risk_analysis"), ("REPORT_WORDING", "report_generation"))


def check_grounding(findings: DataFrame, ev: DataFrame) -> DataFrame:
    """findings (investigation_id, code, evidence_ids) exploded: (.., evidence_id, problem), problem
    null for own evidence, OTHER_INVESTIGATION, NON_EXISTENT, or NO_EVIDENCE for an empty list."""
    own = ev.select("investigation_id", F.col("research_result_id").alias("evidence_id")).distinct().withColumn("_own", F.lit(True))
    any_ = ev.select(F.col("research_result_id").alias("evidence_id")).distinct().withColumn("_any", F.lit(True))
    d = findings.select("investigation_id", "code", F.explode_outer("evidence_ids").alias("evidence_id"))
    d = d.join(own, ["investigation_id", "evidence_id"], "left").join(any_, "evidence_id", "left")
    problem = F.when(F.col("evidence_id").isNull() | (F.trim("evidence_id") == ""), "NO_EVIDENCE").when(F.col("_own"), None).when(F.col("_any"), "OTHER_INVESTIGATION").otherwise("NON_EXISTENT")
    return d.select("investigation_id", "code", "evidence_id", problem.alias("problem"))


def grounding_coverage(investigations: DataFrame, grounded: DataFrame) -> DataFrame:
    """(investigation_id, coverage): share of findings without a problem; 1 without findings."""
    per = grounded.groupBy("investigation_id", "code").agg(F.bool_and(F.col("problem").isNull()).alias("ok"))
    share = per.groupBy("investigation_id").agg(F.avg(F.col("ok").cast("double")).alias("coverage"))
    return investigations.select("investigation_id").join(share, "investigation_id", "left").withColumn("coverage", F.coalesce("coverage", F.lit(1.0)))


def unsafe_wording(findings: DataFrame, ev: DataFrame) -> DataFrame:
    """(investigation_id, code, word): words in descriptions that no cited row's value or source holds."""
    said = F.filter(F.array(*map(F.lit, UNSAFE)), lambda w: F.contains(F.lower(F.col("description")), w))
    d = findings.select("investigation_id", "code", "evidence_ids", F.explode(said).alias("word"))
    cited = d.select("investigation_id", "code", "word", F.explode_outer("evidence_ids").alias("research_result_id"))
    held = cited.join(ev.select("investigation_id", "research_result_id", "field_value", "source_name"), ["investigation_id", "research_result_id"], "left")
    text = F.lower(F.concat_ws(" ", "field_value", "source_name"))
    return held.groupBy("investigation_id", "code", "word").agg(F.bool_or(F.contains(text, F.col("word"))).alias("ok")).filter("not ok").drop("ok")


def contradicted_findings(findings: DataFrame, ev: DataFrame) -> DataFrame:
    """A finding of an inactive GST registration against GST status evidence that says active."""
    low = F.lower("field_value")
    active = ev.filter((F.col("field_name") == "gst_status") & low.contains("active") & ~low.contains("inactive")).select("investigation_id", "research_result_id")
    return findings.filter("code = 'GST_INACTIVE'").select("investigation_id", "code").join(active, "investigation_id")


def score_mismatch(reports: DataFrame, scores: DataFrame) -> DataFrame:
    """reports (investigation_id, score) whose score is not the recomputed one, null-safe."""
    d = reports.select("investigation_id", "score").join(scores.select("investigation_id", F.col("score").alias("expected")), "investigation_id")
    return d.filter(~F.col("score").eqNullSafe(F.col("expected")))


def qa_issues(reports: DataFrame, requests: DataFrame, findings: DataFrame, ev: DataFrame, scores: DataFrame, grounded: DataFrame) -> DataFrame:
    """(investigation_id, kind, detail): every issue of reports (investigation_id, business_name, gstin, cin,
    epfo_code, entity_confidence, score, level) against their requests, evidence and recomputed scores."""
    i = "investigation_id"
    row = lambda d, kind, *detail: d.select(i, F.lit(kind).alias("kind"), F.concat_ws(" ", *(F.col(c).cast("string") if isinstance(c, str) else c for c in detail)).alias("detail"))
    named = F.coalesce("business_name", F.lit("")) != ""
    unsure = named & ~F.coalesce(F.col("level") == "INSUFFICIENT_EVIDENCE", F.lit(False)) & (F.col("entity_confidence") < 0.5)
    parts = (
        row(grounded.filter("problem is not null"), "MISSING_EVIDENCE", "code", "problem"),
        row(unsafe_wording(findings, ev), "REPORT_WORDING", "code", "word"),
        row(contradicted_findings(findings, ev), "UNSUPPORTED_CLAIM", "code", "research_result_id"),
        row(dropped_identifiers(requests, reports), "WRONG_ENTITY", "field"),
        row(reports.filter(~named), "WRONG_ENTITY", F.lit("empty")),
        row(reports.filter(unsure), "WRONG_ENTITY", F.lit("confidence")),
        row(score_mismatch(reports, scores), "WRONG_RISK_SCORE", F.lit("score")),
    )
    return reduce(DataFrame.union, parts)


def qa_verdict(investigations: DataFrame, issues: DataFrame, coverage: DataFrame) -> DataFrame:
    """(investigation_id, status, issues, coverage, score_verified, entity_verified): PASS without issues (investigation_id, kind)."""
    per = issues.groupBy("investigation_id").agg(F.sort_array(F.collect_set("kind")).alias("issues"))
    d = investigations.select("investigation_id").join(per, "investigation_id", "left").join(coverage, "investigation_id", "left")
    found = F.coalesce("issues", F.array().cast("array<string>"))
    free_of = lambda kind: ~F.array_contains(found, kind)
    return d.select("investigation_id", F.when(F.size(found) == 0, "PASS").otherwise("FAIL").alias("status"), found.alias("issues"), F.coalesce("coverage", F.lit(1.0)).alias("coverage"), free_of("WRONG_RISK_SCORE").alias("score_verified"), free_of("WRONG_ENTITY").alias("entity_verified"))


def next_step(status: Column, issues: Column, loops: Column, max_loops: int = 2) -> Column:
    step = reduce(lambda c, kv: c.when(F.array_contains(issues, kv[0]), kv[1]), NEXT, F.when((status == "PASS") | (loops >= max_loops), "end"))
    return step.otherwise("planner")


def final_status(status: Column, loops: Column, max_loops: int = 2) -> Column:
    return F.when(status == "PASS", "COMPLETED").when(loops >= max_loops, "FAILED").otherwise("FAILED_QA")
