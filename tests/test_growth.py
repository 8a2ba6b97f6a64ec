"""What must not grow faster than the input: shuffles of evidence, and the memory of a task."""

from __future__ import annotations

import glob

import numpy as np
import pytest
from pyspark.sql import functions as F

from probitas import cluster
from probitas.cluster import release
from probitas.llm import ppm
from probitas.operators import report as R
from probitas.operators import risk as K
from probitas.plans.queries import queries
from probitas.sources.views import by_investigation
from probitas.streaming import streams as S
from tests.test_operators import ev

SF = "/root/testdata/sf0.001"


def _plan(d) -> str:
    return d._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["s14_export_sections", "s11_append_report_version", "s10_replace_risk_signals", "a8_qa_verdict"])
def test_evidence_is_put_in_order_once(spark, name):
    assert "l_orderkey" not in _plan(queries()[name](spark, SF))  # staged before: what is read more than once
    release(spark)


def test_what_is_staged_by_investigation_is_not_shuffled_again(spark):
    d = by_investigation(spark, SF)
    assert "Exchange hashpartitioning" not in _plan(d.groupBy("investigation_id").agg(F.count("*")).join(K.admissible(d), "investigation_id"))
    release(spark)
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("evidence_")]


def test_signals_are_not_dealt_by_rule(spark):
    hits = spark.createDataFrame([(1, "GST_INACTIVE", ["a"], 0.9), (1, "NO_RULE", ["a"], 0.9)], "investigation_id long, code string, evidence_ids array<string>, confidence double")
    d = K.attach_rules(hits)
    assert "SortMergeJoin" not in _plan(d)
    assert sorted((r.code, r.risk_weight) for r in d.collect()) == [("GST_INACTIVE", 30), ("NO_RULE", 0)]


def test_consistency_is_shuffled_by_investigation_alone(spark):
    e = ev(spark, (1, "a", "legal_name", "Alpha", "GST Portal", 0.9, "VERIFIED"), (1, "b", "legal_name", " Beta ", "User Input", 0.9, "VERIFIED"), (2, "a", "cin", "X", "MCA Portal", 0.9, "VERIFIED"))
    who = spark.createDataFrame([(1, "Mine", "C1"), (2, None, " x "), (3, None, None)], "investigation_id long, legal_name string, cin string")
    d = R.consistency_records(e, who)
    assert "hashpartitioning(investigation_id#" in _plan(d) and ", field_key#" not in "".join(x.split("hashpartitioning(")[-1].split(",")[1] for x in _plan(d).splitlines() if "Exchange hashpartitioning" in x and "source" not in x)
    got = {(r.investigation_id, r.field_key): (r.status, [(s.source, s.value) for s in r.sources]) for r in d.collect()}
    assert len(got) == 3 * len(R.CONSISTENCY_FIELDS)
    assert got[1, "legal_name"][1] == [("GST Portal", "Alpha"), ("User Input", "Beta")]  # evidence of that name goes before the user's value
    assert got[1, "cin"] == ("MATCH", [("User Input", "C1")]) and got[2, "cin"] == ("MATCH", [("MCA Portal", "X"), ("User Input", "x")])
    assert got[3, "cin"] == ("UNAVAILABLE", [])


def test_a_store_is_merged_in_more_tasks_as_it_grows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(cluster, "ROWS", 10)
    rows = ev(spark, *((i, "a", "cin", "X", "MCA Portal", 0.9, "VERIFIED") for i in range(400))).withColumn("task_id", F.lit("TASK-000"))
    S.evidence_sink(str(tmp_path), 1)(rows, 0)
    assert len(glob.glob(f"{tmp_path}/data/*/bucket=0/*.parquet")) > 16
    assert S.read_store(spark, str(tmp_path), rows.schema).count() == 400


def test_a_block_of_the_trie_holds_its_entries_once():
    rng = np.random.default_rng(1)
    codes = np.unique(rng.integers(0, 1 << 22, 1000))
    n = rng.integers(1, 9, len(codes))
    top = ppm.levels(codes, n)[-1]
    asked = np.concatenate([codes, rng.integers(0, 1 << 22, 500)])
    want = top.log10p(asked)
    block = ppm.Block(top, 0, 1 << 24)
    assert len(block.keys) <= 3 * len(codes) and not len(block.top.codes)
    assert block.log10p(asked.astype(np.uint64)) == pytest.approx(want, abs=1e-5)
