"""The checked loop on hand-made investigations, one for each way through it."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from probitas.operators import workflow as W
from probitas.sources.catalog import source_catalog
from tests.test_operators import ev

REQUESTS = "investigation_id long, business_name string, gstin string, cin string, epfo_code string, website string, location string"
REPORTS = "investigation_id long, business_name string, gstin string, cin string, epfo_code string, entity_confidence double, score int, level string"
FINDINGS = "investigation_id long, code string, evidence_ids array<string>, description string"
TASKS = "investigation_id long, task_type string, target string, preferred array<string>"
GSTIN = "27ABCDE1234F1Z5"


def research(tasks):
    """GST portals say Active, twice and once wrongly; nobody else answers."""
    gst = tasks.filter("task_type = 'GST_VERIFICATION'")
    row = lambda pos, value: gst.select("investigation_id", "task_id", F.lit(pos).alias("pos"), F.lit("gst_status").alias("field_name"), F.lit(value).alias("field_value"), F.lit("GST Portal").alias("source_name"), F.lit(0.9).alias("confidence"), F.lit("VERIFIED").alias("verification_status"), F.lit("2020-01-09").cast("timestamp").alias("retrieved_at"))
    ok = F.col("task_type") == "GST_VERIFICATION"
    changes = tasks.select("investigation_id", "task_id", F.lit(1).alias("seq"), F.lit("2020-01-09").cast("timestamp").alias("changed_at"), F.when(ok, "COMPLETED").otherwise("FAILED").alias("status"), F.lit("e").alias("error"), F.lit("r").alias("result"))
    return row(0, "Active").unionByName(row(1, "NOT_FOUND")), changes


@pytest.fixture(scope="module")
def rows(spark):
    who = lambda i, name="Alpha Foods": (i, name, GSTIN, None, None, None, None)
    requests = [who(1), who(2), who(3), who(4, None), who(5), who(6), who(7), who(8)]
    told = lambda i, name="Alpha Foods", score=0, sure=0.9: (i, name, GSTIN, None, None, sure, score, "LOW")
    reports = [told(1, score=30), told(2, score=31), told(3, "", 30), told(4, "", 30), told(5, score=30), told(6, score=30), told(7, score=30)]
    bad = lambda i, ids=("a",), said="gst_inactive": (i, "GST_INACTIVE", list(ids), said)
    findings = [bad(1), bad(2), bad(3), bad(4), bad(5, ["gone"]), bad(6, said="a scam"), bad(7)]
    evidence = [r for i in range(1, 8) for r in ((i, "a", "gst_status", "Cancelled", "GST Portal", 0.9, "VERIFIED"), (i, "c", "candidate_entities", '[{"name": "Alpha Foods"}]', "Web", 0.9, "VERIFIED")) if (i, r[1]) != (4, "c")]
    evidence += [(7, "b", "gst_status", "Active", "MCA Portal", 0.9, "VERIFIED")]
    tasks = [(5, "GST_VERIFICATION", GSTIN.lower(), ["gst.gov.in"])]
    make = spark.createDataFrame
    return make(requests, REQUESTS), make(reports, REPORTS), make(findings, FINDINGS), ev(spark, *evidence).withColumn("task_id", F.lit("TASK-000")), make(tasks, TASKS)


def states(e):
    return {r.investigation_id: (r.status, r.loops) for r in e.state.collect()}


def test_each_report_takes_its_way(spark, rows):
    requests, reports, findings, evidence, tasks = rows
    e = W.run_until_ended(requests, reports, findings, evidence, tasks, source_catalog(spark), research)
    assert states(e) == {1: ("COMPLETED", 0), 2: ("COMPLETED", 1), 3: ("COMPLETED", 1), 4: ("FAILED", 2), 5: ("COMPLETED", 1), 6: ("COMPLETED", 1), 7: ("FAILED", 2)}
    ended = {r.investigation_id: r for r in e.reports.collect()}
    assert len(ended) == 7 and ended[2].score == 30 and ended[3].business_name == "Alpha Foods" and not ended[4].business_name
    made = e.tasks.select("investigation_id", "task_id", "task_type", "status").collect()
    assert {r.investigation_id for r in made} == {5, 7}  # only what the planner can mend
    of = lambda i: sorted(r.task_id for r in made if r.investigation_id == i)
    assert len(set(of(7))) == len(of(7)) and of(7)[0] == "TASK-001"  # no task twice in two passes
    assert not [r for r in made if r.investigation_id == 5 and r.task_type == "GST_VERIFICATION"]  # it was there
    assert {r.status for r in made if r.task_type == "GST_VERIFICATION"} == {"COMPLETED"} and {r.status for r in made if r.task_type != "GST_VERIFICATION"} == {"FAILED"}
    assert [(r.investigation_id, r.field_value, r.ev_seq) for r in e.evidence.collect()] == [(7, "Active", max(r.ev_seq for r in evidence.filter("investigation_id = 7").collect()) + 1)]


def test_fewer_loops_and_none(spark, rows):
    requests, reports, findings, evidence, tasks = rows
    one = states(W.run_until_ended(requests, reports, findings, evidence, tasks, source_catalog(spark), research, max_loops=1))
    assert one == {1: ("COMPLETED", 0), **{i: ("FAILED", 1) for i in range(2, 8)}}
    good = reports.filter("investigation_id = 1")
    e = W.run_until_ended(requests, good, findings.filter("investigation_id = 1"), evidence, tasks, source_catalog(spark), research)
    assert states(e) == {1: ("COMPLETED", 0)} and e.tasks.count() == 0 and e.evidence.count() == 0
    assert W.run_until_ended(requests, reports.limit(0), findings.limit(0), evidence, tasks, source_catalog(spark), research).state.count() == 0
