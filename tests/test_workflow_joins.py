"""Joins of the checked loop: none sends a table with rows by investigation through the driver."""

from __future__ import annotations

from pyspark.sql import functions as F
from test_workflow import research, rows, states  # noqa: F401

from probitas import cluster
from probitas.operators import workflow as W
from probitas.plans import workflow as P
from probitas.sources.catalog import source_catalog


def plans_of(monkeypatch):
    """(label, plan) of all that is staged from now on, by Spark's first plan."""
    seen, stage = [], cluster.stage

    def noted(df, label):
        seen.append((label, df._jdf.queryExecution().executedPlan().toString()))
        return stage(df, label)

    for at in (cluster, W, P):
        monkeypatch.setattr(at, "stage", noted)
    return seen


def test_no_table_of_the_loop_is_broadcast(spark, rows, monkeypatch):  # noqa: F811
    requests, reports, findings, evidence, tasks = rows
    seen = plans_of(monkeypatch)
    first = P.first_reports(requests, evidence.withColumn("investigation_id", F.col("investigation_id").cast("int")))
    assert first[0].count() == 8
    e = W.run_until_ended(requests, reports, findings, evidence, tasks, source_catalog(spark), research)
    assert states(e)[7] == ("FAILED", 2)
    assert {"profile", "reports", "findings", "open", "state", "report", "evidence", "tasks"} <= {label for label, _ in seen}
    joins = [(label, line.strip(" :+-")) for label, plan in seen for line in plan.splitlines() if "Broadcast" in line and "Join" in line]
    # tasks meet the catalogue of sources, one row; evidence_id alone is asked for among all ids that exist
    assert not [x for x in joins if "investigation_id" in x[1] or x[0] in ("profile", "reports", "findings", "open")]
    assert "Broadcast" not in e.reports.join(e.state, W.ID)._jdf.queryExecution().executedPlan().toString()
