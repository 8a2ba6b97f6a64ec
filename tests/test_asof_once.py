"""As-of lookups over evidence that is dealt by investigation once: the same tasks as by a join of ids, null keys, few shuffles."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from probitas.operators.asof import cached_as_of
from probitas.operators.evidence import link_evidence_to_tasks, normal_task, with_own_task
from probitas.plans import timing
from probitas.plans.queries import queries


def test_own_task_is_that_of_the_join(spark):
    ev = spark.createDataFrame([(1, "T1", "a"), (1, "T2", "b"), (1, None, "c"), (2, "T1", "d"), (3, "T1", "e"), (None, "T1", "f"), (1, "T1", "g")], "investigation_id long, task_id string, v string")
    tasks = spark.createDataFrame([(1, "T1", " gst", "Acme ", None), (1, None, "x", "y", "z"), (1, "T3", "x", "y", "z"), (2, "T1", None, None, "Do"), (None, "T1", "x", "y", "z")], "investigation_id long, task_id string, task_type string, target string, objective string")
    columns = ["investigation_id", "task_id", "v", "kind", "target", "objective", "linked"]
    rows = lambda d: sorted(map(str, d.select(columns).collect()))
    got = rows(with_own_task(ev, tasks).withColumns(normal_task("task")))
    assert got == rows(link_evidence_to_tasks(ev, tasks)) and sum("linked=True" in r for r in got) == 3


def test_asks_with_nulls_and_repeats(spark):
    """A row whose task says no target finds what no task is linked to; rows that ask the same stay all."""
    t = lambda d: dt.datetime(2020, 1, 1) + dt.timedelta(days=d)
    rows = [(1, 1, "gst_status", "free", "GST Portal", t(3), None, None, None, False), (1, 2, "gst_status", "own", "GST Portal", t(4), "GST", "acme", "check", True)]
    linked = spark.createDataFrame(rows, "investigation_id int, ev_seq int, field_name string, field_value string, source_name string, retrieved_at timestamp, kind string, target string, objective string, linked boolean")
    ask = lambda i, target, at, field="gst_status": (i, "GST", target, "check", field, "gst.gov.in", at, "more")
    asks = [ask(1, None, t(5)), ask(2, "Acme", t(5)), ask(2, "Acme", t(5)), ask(3, "Acme", None), ask(4, "Acme", t(5), None), ask(5, "Acme", t(2))]
    wanted = spark.createDataFrame(asks, "i int, task_type string, target string, objective string, field_name string, source_name string, asked_at timestamp, other string")
    d = cached_as_of(wanted, linked)
    assert d.columns == [*wanted.columns, "found_value", "found_at", "found"]
    assert sorted((r.i, r.found_value, r.found, r.field_name, r.asked_at) for r in d.collect() if r.i < 3) == [(1, "free", True, "gst_status", t(5)), *[(2, "own", True, "gst_status", t(5))] * 2]
    assert sorted((r.i, r.found_value, r.found, r.field_name, r.asked_at) for r in d.collect() if r.i > 2) == [(3, None, False, "gst_status", None), (4, None, False, None, t(5)), (5, None, False, "gst_status", t(2))]


def test_evidence_is_dealt_once(spark, monkeypatch):
    """Nothing is shuffled by task: evidence is dealt by investigation, all that tasks add comes to it there."""
    plans, stage_by = [], getattr(timing, "stage_by", None)
    plan = lambda d: d._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(timing, "stage_by", lambda d, *a: (plans.append(plan(d)), stage_by(d, *a))[1], raising=False)
    plans.append(plan(queries()["j7_cached_as_of"](spark, "/root/testdata/sf0.001")))
    moved = [line for p in plans for line in p.splitlines() if "Exchange hashpartitioning(" in line]
    assert not [line for line in moved if "task_id" in line.split("), ")[0]]
    assert not [line for line in plans[0].splitlines() if "Exchange" in line and "l_orderkey" not in line]
