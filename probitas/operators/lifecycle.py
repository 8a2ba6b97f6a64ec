"""Lifecycle: events, fetch attempts, blocked tasks, progress."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Stages in their order, what makes each complete, and what makes it active.
_DONE = ("COMPLETED", "FAILED")
STAGES = (
    ("Entity Discovery", ("PENDING_RESEARCH", "RESEARCH", "ENTITY_RESOLUTION", "RISK_ANALYSIS", "REPORT_GENERATION", "QA", *_DONE), ("NORMALIZED",), "DISCOVERY"),
    ("Browser Research", ("ENTITY_RESOLUTION", "RISK_ANALYSIS", "REPORT_GENERATION", "QA", *_DONE), ("PENDING_RESEARCH", "RESEARCH"), "BROWSER_RESEARCH"),
    ("Evidence Validation", ("ENTITY_RESOLUTION", "RISK_ANALYSIS", "REPORT_GENERATION", "QA", *_DONE), ("PENDING_RESEARCH", "RESEARCH"), "BROWSER_RESEARCH"),
    ("Entity Resolution", ("RISK_ANALYSIS", "REPORT_GENERATION", "QA", *_DONE), ("ENTITY_RESOLUTION",), "ENTITY_RESOLUTION"),
    ("Risk Analysis", ("REPORT_GENERATION", "QA", *_DONE), ("RISK_ANALYSIS",), "RISK_ANALYSIS"),
    ("Report", ("QA", *_DONE), ("REPORT_GENERATION",), "REPORT_GENERATION"),
    ("QA", _DONE, ("QA",), "QA"),
)
BLOCKED = "HUMAN_INTERVENTION_REQUIRED"


def append_events(log: DataFrame, new: DataFrame, metadata: tuple[str, ...]) -> DataFrame:
    """log and new (investigation_id, event_type, node, status, created_at), whose metadata columns become one JSON text."""
    rows = new.select("investigation_id", "event_type", "node", "status", F.to_json(F.struct(*metadata)).alias("metadata_json"), "created_at")
    return log.unionByName(rows)


def events_in_order(events: DataFrame) -> DataFrame:
    """events with pos, their place in their investigation's time order."""
    return events.withColumn("pos", F.row_number().over(Window.partitionBy("investigation_id").orderBy("created_at", "event_id")))


def append_attempts(log: DataFrame, new: DataFrame) -> DataFrame:
    """log and a row for each fetch attempt of new: a missing domain is public_source, an attempt with a
    url has one action at least, and what else is known of it becomes one JSON text."""
    kind = F.when(F.array_contains("preferred_sources", F.col("domain")), "preferred").otherwise("fallback")
    facts = F.to_json(F.struct("source_name", kind.alias("source_type"), "url", "attempt_order"))
    actions = F.greatest(F.when(F.coalesce("url", F.lit("")) != "", 1).otherwise(0), "action_count")
    return log.unionByName(new.select("attempt_id", "investigation_id", F.coalesce(F.nullif("domain", F.lit("")), F.lit("public_source")).alias("domain"), "status", actions.cast("int").alias("action_count"), facts.alias("metadata_json")))


def pending_interventions(tasks: DataFrame) -> DataFrame:
    return tasks.filter(F.col("status") == BLOCKED)


def requeue_blocked(tasks: DataFrame, investigations: DataFrame) -> DataFrame:
    """tasks after their investigations are resumed: blocked ones are PENDING again, without run and
    intervention columns; those of COMPLETED and RUNNING investigations stay as they are."""
    open_ = investigations.filter(~F.col("status").isin("COMPLETED", "RUNNING")).select("investigation_id", F.lit(True).alias("open_")).distinct()
    d = tasks.join(open_, "investigation_id", "left").withColumn("go_", F.coalesce("open_", F.lit(False)) & (F.col("status") == BLOCKED))
    cleared = [c for c in ("intervention_type", "intervention_reason", "started_at", "completed_at") if c in tasks.columns]
    d = d.withColumns({"status": F.when(F.col("go_"), "PENDING").otherwise(F.col("status")), **{c: F.when(~F.col("go_"), F.col(c)) for c in cleared}})
    return d.select(*tasks.columns)


def stage_progress(d: DataFrame) -> DataFrame:
    """(investigation_id, stage, completed, active) from status and node: the stages that users see."""
    status, node = (F.upper(F.coalesce(F.col(c), F.lit(""))) for c in ("status", "node"))
    rows = [F.struct(F.lit("Intake").alias("stage"), F.lit(True).alias("completed"), F.lit(False).alias("active"))]
    for name, done, active, at in STAGES:
        complete = status.isin(*done) | ((node != "INTAKE") if name == "Entity Discovery" else F.lit(False))
        rows.append(F.struct(F.lit(name).alias("stage"), complete.alias("completed"), (status.isin(*active) | (node == at)).alias("active")))
    return d.select("investigation_id", F.explode(F.array(*rows)).alias("s")).select("investigation_id", "s.*")


def iso_time(c: Column) -> Column:
    """ISO text of a UTC time, microseconds only where there are any."""
    t = c.cast("timestamp")
    return F.concat(F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss"), F.when(F.date_format(t, "SSSSSS") != "000000", F.concat(F.lit("."), F.date_format(t, "SSSSSS"))).otherwise(""), F.lit("+00:00"))


def evidence_listing(ev: DataFrame) -> DataFrame:
    """The public columns of evidence, times as ISO text; columns that ev lacks are null."""
    have = lambda c: F.col(c) if c in ev.columns else F.lit(None).cast("string").alias(c)
    created = iso_time(F.col("created_at")) if "created_at" in ev.columns else F.lit(None).cast("string")
    return ev.select("investigation_id", "research_result_id", "task_id", "field_name", "field_value", "source_name", have("source_url"), iso_time(F.col("retrieved_at")).alias("retrieved_timestamp"), "confidence", created.alias("created_timestamp"))


def sql_stage_progress() -> str:
    words = lambda w: ", ".join(f"'{x}'" for x in w)
    rows = ["SELECT investigation_id, 'Intake' AS stage, TRUE AS completed, FALSE AS active FROM d"]
    for name, done, active, at in STAGES:
        first = " OR node <> 'INTAKE'" if name == "Entity Discovery" else ""
        rows.append(f"SELECT investigation_id, '{name}', status IN ({words(done)}){first}, status IN ({words(active)}) OR node = '{at}' FROM d")
    return reduce(lambda a, b: f"{a} UNION ALL {b}", rows)
