"""As-of joins against plain Python: ties, null keys and times, facts of the same day, repeated asks, empty sides."""

from __future__ import annotations

import datetime as dt
import random

from pyspark.sql import functions as F

from probitas.operators.asof import cached_as_of, newest_before

ASKS = "i int, k string, j string, at timestamp, other string"
FACTS = "k string, j string, at timestamp, v struct<at:timestamp,n:int>"


def test_newest_before_is_what_a_loop_finds(spark):
    rnd = random.Random(5)
    when = lambda: dt.datetime(2020, 1, 1) + dt.timedelta(hours=rnd.choice((0, 1, 12, 23)), days=rnd.randrange(40))
    key = lambda: rnd.choice(("hot", "hot", "hot", "cold", None))
    facts = [(key(), rnd.choice("ab"), t := when() if rnd.random() < 0.95 else None, (t, n)) for n in range(400)]
    asks = [(i, key(), rnd.choice("abc"), when() if rnd.random() < 0.95 else None, "x") for i in range(300)]
    asks += asks[:20]
    want = []
    for i, k, j, at, _ in asks:
        good = [v for fk, fj, fat, v in facts if None not in (k, at, fk, fat) and (fk, fj) == (k, j) and fat <= at]
        want.append((i, max(good) if good else None))
    got = newest_before(spark.createDataFrame(asks, ASKS), spark.createDataFrame(facts, FACTS), ["k", "j"], "at", "v")
    assert got.columns == ["i", "k", "j", "at", "other", "v"]
    assert sorted(((r.i, tuple(r.v) if r.v else None) for r in got.collect()), key=repr) == sorted(want, key=repr)


def test_empty_sides(spark):
    asks, facts = spark.createDataFrame([(1, "a", "b", dt.datetime(2020, 1, 1), None)], ASKS), spark.createDataFrame([], FACTS)
    assert [r.v for r in newest_before(asks, facts, ["k", "j"], "at", "v").collect()] == [None]
    assert newest_before(asks.limit(0), facts, ["k", "j"], "at", "v").count() == 0


def test_windows_of_a_key_hold_a_day(spark):
    """No window over rows is partitioned by the keys alone."""
    day = dt.datetime(2020, 1, 1)
    asks = spark.createDataFrame([(1, "a", "b", day, None)], ASKS)
    d = newest_before(asks, spark.createDataFrame([("a", "b", day, (day, 1))], FACTS), ["k", "j"], "at", "v")
    plan = d._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line]
    assert len(windows) == 2 and sum("day_" in line.split("windowspecdefinition(")[1].split(" ASC")[0] for line in windows) == 2


def test_evidence_as_of_each_task(spark):
    t = lambda d, h=0: dt.datetime(2020, 1, 1, h) + dt.timedelta(days=d)
    own = ("GST", "acme", "check", True)
    rows = [(1, 1, "gst_status", "old", "GST Portal", t(0), *own), (1, 2, "gst_status", "new", "gst.gov.in", t(5), *own), (1, 3, "gst_status", "else", "GST Portal", t(6), "GST", "other", "check", True), (2, 1, "gst_status", "free", "GST Portal", t(7), None, None, None, False)]
    linked = spark.createDataFrame(rows, "investigation_id int, ev_seq int, field_name string, field_value string, source_name string, retrieved_at timestamp, kind string, target string, objective string, linked boolean")
    ask = lambda i, at, target="Acme ": (i, " gst", target, "Check", "gst_status", "GST Portal", at)
    asks = [ask(1, t(-1)), ask(2, t(0)), ask(3, t(4, 23)), ask(4, t(6, 1)), ask(5, t(7, 1)), ask(6, t(6, 1), "nobody"), ask(7, t(4000)), ask(8, None)]
    wanted = spark.createDataFrame(asks, "i int, task_type string, target string, objective string, field_name string, source_name string, asked_at timestamp")
    got = {r.i: r.found_value for r in cached_as_of(wanted, linked).collect()}
    assert got == {1: None, 2: "old", 3: "old", 4: "new", 5: "free", 6: None, 7: None, 8: None}
    assert cached_as_of(wanted, linked).filter(F.col("found") != F.col("found_value").isNotNull()).count() == 0
