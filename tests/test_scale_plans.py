"""What the plans of joins with small tables must not do: deal rows by a few hot keys, or sort what is planned."""

from pyspark.sql import functions as F

from probitas.operators import planning as N
from probitas.operators import report as R
from probitas.sources import catalog as C


def _plan(d) -> str:
    return d._jdf.queryExecution().executedPlan().toString()


def test_evidence_is_not_dealt_by_source_name(spark):
    ev = spark.createDataFrame([(1, "gst_status", "Active", "Tofler", 0.9, "VERIFIED"), (1, "cin", "X", "Other Books", 0.9, None)], "investigation_id long, field_name string, field_value string, source_name string, confidence double, verification_status string")
    d = R.source_status(ev, C.source_catalog(spark))
    assert "SortMergeJoin" not in _plan(d) and "BroadcastHashJoin" in _plan(d)
    got = {r.category: (r.status, r.evidence_count) for r in d.collect()}
    assert got["third_party"] == ("VERIFIED", 1) and got["general_web"] == ("VERIFIED", 1) and got["mca"] == ("UNAVAILABLE", 0)


def test_planned_tasks_are_neither_shuffled_nor_sorted(spark):
    intake = spark.createDataFrame([(1, "Firm", None, None, None, None, None), (2, "Acme", "G2", None, None, None, "Pune"), (2, "Base", None, None, None, None, None), (3, None, None, None, None, None, None)], "investigation_id long, business_name string, gstin string, cin string, epfo_code string, website string, location string")
    none = spark.createDataFrame([], "investigation_id long, field_name string, field_value string, ev_seq int")
    existing = spark.createDataFrame([(1, C.EPFO, " FIRM EPFO establishment", ["epfindia.gov.in"]), (1, "OTHER", "x", None)], "investigation_id long, task_type string, target string, preferred_sources array<string>")
    d = N.plan_tasks(intake, none, existing, C.source_catalog(spark))
    assert "Window" not in _plan(d)
    rows = d.orderBy("investigation_id", "task_id").collect()
    one, two = ([r for r in rows if r.investigation_id == i] for i in (1, 2))
    assert {r.investigation_id for r in rows} == {1, 2}
    assert C.EPFO not in {r.task_type for r in one} and one[0].task_id == "TASK-003"
    # rows of one investigation are numbered together, category by category
    assert [r.task_id for r in two] == [f"TASK-{k:03d}" for k in range(1, len(two) + 1)]
    assert [(r.task_type, r.target) for r in two[:2]] == [(C.GST, "Base"), (C.GST, "G2")]
    assert all("{" not in r.objective for r in rows)


def test_routes_do_not_deal_tasks_by_type(spark):
    tasks = spark.createDataFrame([(1, C.GST), (2, "UNKNOWN")], "investigation_id long, task_type string")
    d = N.route_sources(tasks, C.source_catalog(spark))
    assert "BroadcastHashJoin" in _plan(d)
    got = {r.investigation_id: r.preferred for r in d.select("investigation_id", F.size("preferred").alias("preferred")).collect()}
    assert got == {1: 1, 2: 0}


def test_bounded_items_are_made_once_and_cut_where_their_json_is_too_long(spark):
    from probitas.operators import evidence as E

    items = F.expr("transform(sequence(1, k), i -> named_struct('name', concat('n', i), 'text', repeat(c, n)))")
    d = spark.createDataFrame([(k, c, n) for k in (1, 3, 10) for c in ("x", '"', "\x01", "é", "😀") for n in (0, 5, 100, 110, 199, 200, 300)], "k int, c string, n int").repartition(1)
    x = d.select("k", "c", "n", items.alias("items"), E.bound_items(items, ("name", "text"), 2000, 200).alias("x"))
    assert str(d.select(E.bound_items(items, ("name", "text")).alias("x"))._jdf.queryExecution().optimizedPlan()).count("repeat(") == 1
    short = F.expr(f"transform(items, x -> named_struct('name', x.name, 'text', CASE WHEN length(x.text) > 200 THEN substring(x.text, 1, 200) || '{E.CUT}' ELSE x.text END))")
    y = x.withColumn("short", short).withColumn("json", F.length(F.to_json("short")))
    rows = y.collect()
    for r in rows:
        assert [i.text for i in r.x] == ([None] * r.k if r.json > 2000 else [i.text for i in r.short]), (r.k, r.c, r.n)
        assert [i.name for i in r.x] == [i.name for i in r.items]
    assert {r.json > 2000 for r in rows} == {True, False}
    nothing = spark.sql("SELECT CAST(NULL AS array<struct<name:string,text:string>>) AS a, CAST(array() AS array<struct<name:string,text:string>>) AS b, array(CAST(NULL AS struct<name:string,text:string>)) AS c")
    got = nothing.select(*(E.bound_items(F.col(k), ("name", "text")).alias(k) for k in "abc")).first()
    assert got.a is None and got.b == [] and len(got.c) == 1 and got.c[0].text is None
