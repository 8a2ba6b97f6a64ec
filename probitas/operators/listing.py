"""Listings and history of investigations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def owned_by(d: DataFrame, user: str) -> DataFrame:
    return d.filter(F.col("user_id") == user)


def list_investigations(d: DataFrame, user: str, status: str | None = None) -> DataFrame:
    own = owned_by(d, user)
    return (own if status is None else own.filter(F.col("status") == status)).orderBy(F.desc("created_at"), "investigation_id")


def incomplete(d: DataFrame) -> DataFrame:
    return d.filter(F.col("completed_timestamp").isNull() & ~F.col("status").isin("COMPLETED", "FAILED"))


def require_identifier(d: DataFrame) -> DataFrame:
    keys = ("name", "gstin", "cin", "epfo_code", "website")
    return d.filter(F.coalesce(*(F.nullif(F.trim(k), F.lit("")) for k in keys)).isNotNull())


def _in_order(order: str, *columns: str) -> Column:
    """An investigation's rows as an array of structs."""
    return F.transform(F.array_sort(F.collect_list(F.struct(order, *columns))), lambda x: F.struct(*(x[c].alias(c) for c in columns)))


def history(investigations: DataFrame, ev: DataFrame, events: DataFrame, tasks: DataFrame, reports: DataFrame) -> DataFrame:
    """(investigation_id, status, n_evidence, n_fields, n_events, evidence_ids, tasks, latest_version): children are
    gathered by investigation before they are joined. evidence_ids are in order of ev_seq, tasks are
    (task_id, task_type, target, objective, status) in order of seq; without children: 0, null for the lists and the version."""
    e = ev.groupBy("investigation_id").agg(F.count("*").alias("n_evidence"), F.count_distinct("field_name").alias("n_fields"), _in_order("ev_seq", "research_result_id")["research_result_id"].alias("evidence_ids"))
    a = events.groupBy("investigation_id").agg(F.count("*").alias("n_events"))
    t = tasks.groupBy("investigation_id").agg(_in_order("seq", "task_id", "task_type", "target", "objective", "status").alias("tasks"))
    r = reports.groupBy("investigation_id").agg(F.max("version").alias("latest_version"))
    d = investigations.select("investigation_id", "status")
    for child in (e, a, t, r):
        d = d.join(child, "investigation_id", "left")
    return d.fillna(0, ["n_evidence", "n_fields", "n_events"])


def latest_status(events: DataFrame) -> DataFrame:
    """(investigation_id, node, event_type) of the last event; works on a stream, too."""
    g = events.groupBy("investigation_id").agg(F.max_by(F.struct("node", "event_type"), F.struct("created_at", "event_id")).alias("x"))
    return g.select("investigation_id", "x.node", "x.event_type")
