"""The checked loop over all investigations, from first reports with faults to the state in which each ends."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from probitas.cluster import merged, stage, stage_rows
from probitas.operators import risk as K
from probitas.operators import workflow as W
from probitas.operators.evidence import source_key
from probitas.operators.intake import resolved_entities
from probitas.sources.catalog import EPFO, source_catalog
from probitas.sources.views import by_investigation, view


def first_reports(intake: DataFrame, ev: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Reports and findings as a first pass writes them, with faults that depend on the id: scores one too
    high (7), no name (11), findings without evidence (5), a word that nothing supports (3)."""
    i = F.col("investigation_id")
    profile = stage_rows(K.risk_profile(ev), "profile")
    who = resolved_entities(intake, ev).select("investigation_id", F.when(i % 11 != 0, F.col("name")).alias("business_name"), "gstin", "cin", "epfo_code", "entity_confidence")
    said = K.scores_of(intake, profile).select("investigation_id", (F.col("score") + F.when(i % 7 == 0, 1).otherwise(0)).alias("score"), "level")
    ids = F.when(i % 5 == 0, F.array(F.lit("RES-0"))).otherwise(F.col("evidence_ids"))
    findings = K.exploded(profile).select("investigation_id", "code", ids.alias("evidence_ids"), F.when(i % 3 == 0, "looks like a scam").otherwise(F.lower("code")).alias("description"))
    return stage_rows(merged(who).join(said, "investigation_id"), "reports"), stage_rows(findings, "findings")


def answers(ev: DataFrame) -> W.Research:
    """Research that answers each field of a task with the newest verified value that the task's preferred
    source gave for it in any evidence; a task without one fails."""
    best = F.max_by(F.struct("field_value", "confidence", "retrieved_at", "source_name"), F.struct("retrieved_at", "investigation_id", "ev_seq"))
    known = ev.filter((F.col("verification_status") == "VERIFIED") & (F.col("confidence") >= 0.7)).groupBy("field_name", source_key(F.col("source_name")).alias("key_")).agg(best.alias("x"))

    def research(tasks: DataFrame) -> tuple[DataFrame, DataFrame]:
        asked = tasks.select("investigation_id", "task_id", source_key(F.get("preferred", F.lit(0))).alias("key_"), F.posexplode("required_fields").alias("pos", "field_name"))
        found = stage(asked.join(known, ["field_name", "key_"], "left"), "found")
        results = found.filter("x is not null").select("investigation_id", "task_id", "pos", "field_name", "x.field_value", "x.source_name", "x.confidence", F.lit("VERIFIED").alias("verification_status"), "x.retrieved_at")
        ran = found.groupBy("investigation_id", "task_id").agg(F.max("x.retrieved_at").alias("changed_at"))
        ok = F.col("changed_at").isNotNull()
        changes = ran.select("investigation_id", "task_id", F.lit(1).alias("seq"), "changed_at", F.when(ok, "COMPLETED").otherwise("FAILED").alias("status"), F.when(~ok, "no answer").alias("error"), F.when(ok, "answered").alias("result"))
        return results, changes

    return research


def looped(s: SparkSession, d: str) -> W.Ended:
    intake, ev = view(s, d, "intake"), by_investigation(s, d)
    old = intake.filter("investigation_id % 3 = 0 and business_name <> ''").select("investigation_id", F.lit(EPFO).alias("task_type"), F.concat("business_name", F.lit(" EPFO establishment")).alias("target"), F.array(F.lit("epfindia.gov.in")).alias("preferred"))
    return W.run_until_ended(intake, *first_reports(intake, ev), ev, old, source_catalog(s), answers(ev))


def end_states(s: SparkSession, d: str) -> DataFrame:
    """(investigation_id, status, loops, issues, score, n_tasks, n_failed, n_added) of every investigation."""
    e = looped(s, d)
    tasks = e.tasks.groupBy("investigation_id").agg(F.count("*").alias("n_tasks"), F.count_if(F.col("status") == "FAILED").alias("n_failed"))
    added = e.evidence.groupBy("investigation_id").agg(F.count("*").alias("n_added"))
    out = e.state.join(e.reports.select("investigation_id", "score"), "investigation_id").join(tasks, "investigation_id", "left").join(added, "investigation_id", "left")
    return out.select("investigation_id", "status", "loops", F.array_join("issues", ",").alias("issues"), "score", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("n_tasks", "n_failed", "n_added")))


QUERIES = {"f22_f23_qa_loop": end_states}
