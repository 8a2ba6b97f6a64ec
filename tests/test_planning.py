"""Queries on tasks take every task of the view."""

from __future__ import annotations

import __spark_entry__ as entry
from probitas.operators import planning as N
from probitas.sources import catalog as C
from probitas.sources.views import view

SF = "/root/testdata/sf0.001"


def test_every_task_is_routed(spark):
    tasks = {(r.investigation_id, r.seq) for r in view(spark, SF, "research_tasks").collect()}
    got = entry.queries()["j9_route_all_sources"](spark, SF).collect()
    assert len(got) == len(tasks) and {(r.investigation_id, r.seq) for r in got} == tasks
    assert all(r.preferred for r in got) and any(seq <= 3 for _, seq in tasks)


def test_every_task_takes_its_status(spark):
    rows = view(spark, SF, "research_tasks").collect()
    last = {}
    for r in sorted(rows, key=lambda r: r.seq):
        last[r.investigation_id, r.task_id] = r.status
    got = entry.queries()["s16_apply_all_task_status"](spark, SF).collect()
    assert len(got) == len(last) and {(r.investigation_id, r.task_id): r.status for r in got} == last


def test_frontier_and_terms_are_compiled_and_made_once(spark):
    catalog = C.source_catalog(spark)
    rows = [(1, "T", C.THIRD, "Firm 1"), (2, "T", C.THIRD, ""), (3, "T", C.MCA, "U12345MH2001PTC004107"), (4, "T", C.WEBSITE, "a.com/x"), (5, "T", C.THIRD, None)]
    tasks = spark.createDataFrame(rows, "investigation_id long, task_id string, task_type string, target string")
    urls = N.fetch_frontier(tasks, catalog)
    assert "lambdafunction" not in urls._jdf.queryExecution().optimizedPlan().toString()  # interpreted, row by row
    found = {}
    for r in urls.orderBy("investigation_id", "source", "pos").collect():
        found.setdefault((r.investigation_id, r.source), []).append(r.url)
    assert found[1, "tofler.in"] == ["https://www.tofler.in/company/firm-1", "https://www.tofler.in/search?q=firm-1", "https://www.tofler.in"]
    assert found[2, "tofler.in"] == found[5, "tofler.in"] == ["https://www.tofler.in"]
    assert found[4, "company_website"] == ["https://a.com/x"]
    terms = N.search_terms(tasks)
    assert terms.columns == [*tasks.columns, "terms"]
    assert terms._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract(") <= 4  # two, each tested for being empty
    assert {r.investigation_id: r.terms for r in terms.collect()} == {1: '"Firm 1"', 2: '""', 3: '"U12345MH2001PTC004107"', 4: 'a.com/x', 5: '""'}
