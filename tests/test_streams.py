"""Streams end as the batch does: shuffled, repeated and restarted evidence with ties; a tail whose state goes at the end."""

from __future__ import annotations

import datetime as dt
import random

from pyspark.sql import functions as F

from probitas.operators.evidence import merge_evidence, unmerged, upsert_evidence
from probitas.streaming import streams as S

EV = "investigation_id long, research_result_id string, task_id string, field_name string, field_value string, source_name string, confidence double, verification_status string, retrieved_at timestamp, ev_seq int"


def evidence(spark, n, seed):
    """Few keys and few times, so that equal times meet in every order."""
    rnd = random.Random(seed)
    day = lambda: dt.datetime(2024, 1, rnd.randint(1, 3))
    return [(rnd.randint(1, 3), "r", f"t{i}", "f", f"v{i}", rnd.choice(["GST", " gst ", "Gst"]), i / n, rnd.choice(["A", "B", None]), day(), i) for i in range(n)]


def test_merges_in_any_order_and_number_of_steps_are_the_batch(spark):
    for seed in range(3):
        rows = evidence(spark, 60, seed)
        want = sorted(map(tuple, upsert_evidence(spark.createDataFrame(rows, EV)).collect()), key=str)
        random.Random(seed).shuffle(rows)
        store = None
        for k in range(0, 60, 15):
            batch = unmerged(spark.createDataFrame(rows[k : k + 20], EV))  # some rows come twice
            store = merge_evidence(batch if store is None else store.unionByName(batch))
            store = spark.createDataFrame(store.collect(), store.schema)
        assert sorted(map(tuple, store.drop("newest_seq", "status_seq").collect()), key=str) == want


def test_sink_of_shuffled_batches_is_the_batch(spark, tmp_path):
    rows = evidence(spark, 40, 9)
    want = sorted(map(tuple, upsert_evidence(spark.createDataFrame(rows, EV)).collect()), key=str)
    random.Random(1).shuffle(rows)
    sink, store = S.evidence_sink(str(tmp_path / "s"), 4), str(tmp_path / "s")
    for epoch, k in enumerate((0, 20, 20, 30)):
        sink(spark.createDataFrame(rows[k : k + 20 if epoch != 2 else k + 15], EV), epoch)
    columns = upsert_evidence(spark.createDataFrame(rows, EV)).columns
    assert sorted(map(tuple, S.read_store(spark, store, spark.createDataFrame(rows, EV).schema).select(*columns).collect()), key=str) == want


def test_tail_gives_events_in_order_and_drops_state(spark, tmp_path):
    """Days come as files in order. Investigation 1 ends on day 3, 2 never does; an event after the end is not given."""
    t = lambda d, h=0: dt.datetime(2024, 1, 1) + dt.timedelta(days=d, hours=h)
    say, of = "investigation_id long, status string, created_at timestamp", "investigation_id long, event_id long, created_at timestamp, body string"
    statuses = {3: [(1, "COMPLETED", t(3, 5))], 4: [(1, "FAILED", t(4))], 1: [(1, "RUNNING", t(1))], 40: [(None, "FAILED", t(40))]}
    events = {d: [(i, 10 * d + i, t(d, 12 - i), f"b{d}") for i in (1, 2)] for d in range(1, 7)}
    events[3] = [(1, 30, t(3, 4), "x"), (1, 31, t(3, 5), "y"), (1, 29, t(3, 4), "w"), (1, 33, t(3, 6), "after"), (1, 30, t(3, 4), "x"), (2, 32, t(3), "b3")]
    events[5].append((2, 45, t(4, 20), "late"))
    streams = {}
    for name, schema in (("events", of), ("statuses", say)):
        (tmp_path / name).mkdir()
        streams[name] = spark.readStream.schema(schema).parquet(str(tmp_path / name))
    out, size, held = str(tmp_path / "out"), [], []
    for d in [*range(1, 7), 20, 40]:
        spark.createDataFrame(events.get(d, []), of).coalesce(1).write.mode("append").parquet(str(tmp_path / "events"))
        spark.createDataFrame(statuses.get(d, [(None, "FAILED", t(d))]), say).coalesce(1).write.mode("append").parquet(str(tmp_path / "statuses"))
        tail = S.tail_until_end(streams["events"], streams["statuses"], "1 day", keep_days=5)
        q = tail.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination()
        size.append(q.lastProgress["stateOperators"][0]["numRowsTotal"])
    flat = lambda x, s: spark.createDataFrame([r for v in x.values() for r in v], s)
    want = S.events_until_end(flat(events, of), flat(statuses, say))
    got = spark.read.schema(tail.schema).parquet(out)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    mine = [r.event_id for r in got.filter("investigation_id = 1").orderBy("pos").collect()]
    assert mine == [11, 21, 29, 30, 31] and got.filter(F.col("event_id") == 45).count() == 1
    assert max(size) <= 3 and size[-1] <= 2  # investigation 2 and the row without one; the ended one is gone


def test_batch_edges(spark):
    say, of = "investigation_id long, status string, created_at timestamp", "investigation_id long, event_id long, created_at timestamp, body string"
    none = S.events_until_end(spark.createDataFrame([], of), spark.createDataFrame([], say))
    assert none.collect() == []
