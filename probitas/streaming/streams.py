"""Streams of events, results and attempts."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState

from probitas.cluster import tasks_for
from probitas.operators.evidence import merge_evidence, unmerged
from probitas.operators.report import attempt_rank


def tail_events(events: DataFrame, delay: str = "1 day") -> DataFrame:
    """Each event once, within a bounded state: ids are remembered for the delay, and events later than
    that are dropped. event_sink() keeps late ones, too."""
    return events.withWatermark("created_at", delay).dropDuplicatesWithinWatermark(["event_id"])


def attempt_status(attempts: DataFrame) -> DataFrame:
    """Best status by investigation and domain, never demoted; for update or complete mode."""
    best = F.max(F.struct(attempt_rank(F.col("status")).alias("rank"), (-F.col("attempt_id")).alias("first"), "status"))
    return attempts.groupBy("investigation_id", "domain").agg(best.alias("best"), F.count("*").alias("attempts")).select("investigation_id", "domain", "best.status", "attempts")


def _read(spark, path: str) -> str | None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return "\n".join(r.value for r in spark.read.text(path).collect()) if fs.exists(p) else None  # one short line


def _manifests(spark, store: str) -> list[str]:
    """Addresses of the store's manifests in the order of their numbers."""
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{store}/manifest")
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(x.getPath().toString() for x in fs.listStatus(p) if x.getPath().getName().endswith(".json")) if fs.exists(p) else []


def _manifest(spark, store: str) -> dict:
    """number, the applied epoch of each query, and the folder of each bucket."""
    all_ = _manifests(spark, store)
    return json.loads(_read(spark, all_[-1])) if all_ else {"number": 0, "applied": {}, "buckets": {}}


def _publish(spark, store: str, manifest: dict) -> None:
    """Write a manifest under another name and rename it: readers see the old one or the new one."""
    name = f"{store}/manifest/{manifest['number']:012d}.json"
    p = spark._jvm.org.apache.hadoop.fs.Path(name)
    apart = spark._jvm.org.apache.hadoop.fs.Path(f"{store}/manifest/_{uuid.uuid4().hex}")
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    out = fs.create(apart, True)
    out.write(bytearray(json.dumps(manifest).encode()))
    out.close()
    if not fs.rename(apart, p):
        raise RuntimeError(f"{name} exists: a store takes one writer")


def read_store(spark: SparkSession, store: str, schema) -> DataFrame:
    """The evidence of a store as its newest manifest has it."""
    paths = [f"{folder}/bucket={b}" for b, folder in _manifest(spark, store)["buckets"].items()]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def evidence_sink(store: str, buckets: int = 64):
    """A foreachBatch function that merges a batch of evidence into a store of Parquet buckets by
    investigation. Late rows are decided by their own time, so none is dropped; rows in any order, in any
    batches and more than once give what upsert_evidence() gives for all. A batch rewrites the
    buckets that it touches into a new folder and then publishes a manifest that names them; the
    manifest also holds the last epoch of each query, so that a batch that runs again changes
    nothing, and a query that starts anew at epoch 0 adds to what is there. Folders that neither the
    newest manifest nor the one before it names are removed."""

    def merge(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        query = spark.sparkContext.getLocalProperty("sql.streaming.queryId") or "batch"
        now = _manifest(spark, store)
        if now["applied"].get(query, -1) >= epoch:
            return
        at = F.pmod(F.xxhash64("investigation_id"), F.lit(buckets)).cast("int")
        counts = dict(batch.groupBy(at).count().collect())  # `buckets` rows at most
        touched = list(counts)
        old = [f"{now['buckets'][str(b)]}/bucket={b}" for b in touched if str(b) in now["buckets"]]
        new = unmerged(batch)
        rows = spark.read.schema(new.schema).parquet(*old).unionByName(new) if old else new
        folder = f"{store}/data/{now['number'] + 1:012d}-{uuid.uuid4().hex}"
        held = spark.read.schema(new.schema).parquet(*old).count() if old else 0  # from the files' footers
        dealt = rows.repartition(tasks_for(spark, held + sum(counts.values())), "investigation_id")
        merge_evidence(dealt).select(*new.columns).withColumn("bucket", at).write.partitionBy("bucket").parquet(folder)
        after = {"number": now["number"] + 1, "applied": now["applied"] | {query: epoch}, "buckets": now["buckets"] | {str(b): folder for b in touched}}
        _publish(spark, store, after)
        used = {x.rsplit("/", 1)[-1] for m in (now, after) for x in m["buckets"].values()}
        p = spark._jvm.org.apache.hadoop.fs.Path(f"{store}/data")
        fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
        for x in fs.listStatus(p) if fs.exists(p) else ():
            if x.getPath().getName() not in used:
                fs.delete(x.getPath(), True)

    return merge


def event_sink(store: str):
    """A foreachBatch function that appends those events whose id the store lacks, late ones too. A
    batch has a folder of its own, so one that runs again replaces what it wrote."""

    def append(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        query = spark.sparkContext.getLocalProperty("sql.streaming.queryId") or "batch"
        mine = f"batch={query}-{epoch}"
        p = spark._jvm.org.apache.hadoop.fs.Path(store)
        fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
        old = [x.getPath().toString() for x in fs.listStatus(p) if x.getPath().getName() != mine] if fs.exists(p) else []
        rows = batch.dropDuplicates(["event_id"])
        if old:
            rows = rows.join(spark.read.schema(batch.schema).parquet(*old).select("event_id"), "event_id", "left_anti")
        rows.select(*batch.columns).write.mode("overwrite").parquet(f"{store}/{mine}")

    return append


def until_finished(events: DataFrame, last: tuple[str, ...] = ("COMPLETED", "FAILED")) -> DataFrame:
    """Events of each investigation up to the first whose status ends it."""
    end = events.groupBy("investigation_id").agg(F.min(F.when(F.col("status").isin(*last), F.struct("created_at", "event_id"))).alias("end_"))
    return events.join(end, "investigation_id").filter(F.col("end_").isNull() | (F.struct("created_at", "event_id") <= F.col("end_"))).drop("end_")


def events_until_end(events: DataFrame, statuses: DataFrame, last: tuple[str, ...] = ("COMPLETED", "FAILED")) -> DataFrame:
    """(investigation_id, pos, event_id, created_at, body): each event once, in order of time, then id, up to the time of
    the first status (investigation_id, status, created_at) that ends its investigation. events have event_id,
    created_at and body, a text; of repeated ids the earliest event counts."""
    end = statuses.filter(F.col("status").isin(*last)).groupBy("investigation_id").agg(F.min("created_at").alias("end_"))
    one = events.groupBy("investigation_id", "event_id").agg(F.min(F.struct("created_at", "body")).alias("x")).select("investigation_id", "event_id", "x.*")
    kept = one.join(end, "investigation_id", "left").filter(F.col("end_").isNull() | (F.col("created_at") <= F.col("end_")))
    w = Window.partitionBy("investigation_id").orderBy("created_at", "event_id")
    return kept.select("investigation_id", F.row_number().over(w).cast("long").alias("pos"), "event_id", "created_at", "body")


def tail_until_end(events: DataFrame, statuses: DataFrame, delay: str, last: tuple[str, ...] = ("COMPLETED", "FAILED"), keep_days: int = 30) -> DataFrame:
    """events_until_end() of two streams that may be shuffled and late by up to the delay (append mode). An event is
    held until the watermark passes it, so that order holds; rows later than the delay are dropped. The state
    of an investigation is the number of events given and those held; once the watermark passes its end, only
    the mark of the end stays, for keep_days of event time: events of an ended investigation that are later than
    that would open it anew."""
    key = events.schema["investigation_id"].dataType
    row = "investigation_id, event_id, created_at, body, status"
    both = events.selectExpr("investigation_id", "event_id", "created_at", "body", "cast(null as string) AS status").union(
        statuses.filter(F.col("status").isin(*last)).selectExpr("investigation_id", "cast(null as long) AS event_id", "created_at", "cast(null as string) AS body", "status")
    )
    out = T.StructType([T.StructField("investigation_id", key), *T.StructType.fromDDL("pos long, event_id long, created_at timestamp, body string").fields])
    keep = keep_days * 86_400_000_000

    def step(ident: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        given, end, held, closed = state.get if state.exists else (0, -1, "{}", False)
        waiting = {int(k): tuple(v) for k, v in json.loads(held).items()}
        if state.hasTimedOut and closed:
            state.remove()
            return
        for f in () if state.hasTimedOut or closed else frames:
            at = f["created_at"].astype("datetime64[us]").astype("int64").tolist()
            for t, i, body, status in zip(at, f["event_id"].tolist(), f["body"].tolist(), f["status"].tolist(), strict=True):
                if isinstance(status, str):
                    end = t if end < 0 else min(end, t)
                else:
                    waiting[int(i)] = min((t, body), waiting.get(int(i), (t, body)), key=lambda x: (x[0], x[1] or ""))
        passed = state.getCurrentWatermarkMs() * 1000
        ready = sorted((t, i, body) for i, (t, body) in waiting.items() if t <= passed and not 0 <= end < t)
        waiting = {i: v for i, v in waiting.items() if v[0] > passed and not 0 <= end < v[0]}
        if ready:
            made = pd.DataFrame(ready, columns=["at", "event_id", "body"])
            made["created_at"] = pd.to_datetime(made["at"], unit="us")
            made["pos"], made["investigation_id"] = range(given + 1, given + len(ready) + 1), ident[0]
            yield made[["investigation_id", "pos", "event_id", "created_at", "body"]]
        closed = closed or 0 <= end <= passed
        state.update((given + len(ready), end, json.dumps(waiting), closed))
        times = [end + keep] if closed else [t for t, _ in waiting.values()] + ([end] if end >= 0 else [])
        if times:
            state.setTimeoutTimestamp(max(min(times) // 1000, state.getCurrentWatermarkMs()) + 1)

    watched = both.selectExpr(*row.split(", ")).withWatermark("created_at", delay).groupBy("investigation_id")
    return watched.applyInPandasWithState(step, out, "given long, end_at long, held string, closed boolean", "append", "EventTimeTimeout")
