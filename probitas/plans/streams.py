"""Queries on streams: tables are written as shuffled files that streams then read, with a stop and a restart between."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from probitas.cluster import new_folder, stage
from probitas.operators.evidence import upsert_evidence
from probitas.sources.views import ctes, view
from probitas.streaming import streams as S

#: Longer than the events' time spans, as the files are in no order; a last row, later by more, lets all pass.
DELAY, LAST = "36500 days", "2199-01-01"


def _files(rows: DataFrame, part: int, folder: str) -> None:
    """A half of the rows in three more files, each with rows of all times."""
    mixed = rows.withColumn("mix_", F.pmod(F.xxhash64(*rows.columns), F.lit(1 << 20)))
    mixed.filter(F.col("mix_") % 2 == part).repartition(3, "mix_").drop("mix_").write.mode("append").parquet(folder)


def stored_evidence(s: SparkSession, rows: DataFrame) -> DataFrame:
    """What a store holds after rows came in shuffled files, in small batches and two runs of one query."""
    rows = stage(rows, "rows")
    source, store, at = new_folder(s, "source"), new_folder(s, "store"), new_folder(s, "offsets")
    for part in (0, 1):
        _files(rows, part, source)
        stream = s.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(source)
        stream.writeStream.foreachBatch(S.evidence_sink(store, 16)).option("checkpointLocation", at).trigger(availableNow=True).start().awaitTermination()
    return S.read_store(s, store, rows.schema)


EVENTS = "SELECT investigation_id, event_id, created_at, node || ' ' || event_type AS body FROM {events}"
STATUSES = "SELECT investigation_id, CASE WHEN event_type = 'NODE_FAILED' THEN 'FAILED' ELSE 'RUNNING' END AS status, created_at FROM {events} WHERE node = 'qa'"


def tailed_events(s: SparkSession, events: DataFrame, statuses: DataFrame) -> DataFrame:
    """The tail of two streams of shuffled files with every event twice, in two runs of one query."""
    last = s.createDataFrame([(None, "FAILED")], "investigation_id long, status string").select("investigation_id", "status", F.lit(LAST).cast("timestamp").alias("created_at"))
    events, statuses = stage(events, "events"), stage(statuses.select("investigation_id", "status", F.col("created_at").cast("timestamp").alias("created_at")), "statuses")
    of, say, out, at = (new_folder(s, n) for n in ("events", "statuses", "tail", "offsets"))
    for part in (0, 1):
        _files(events.unionAll(events), part, of)
        _files(statuses, part, say)
        if part:
            last.write.mode("append").parquet(say)
        read = lambda path, schema: s.readStream.schema(schema).parquet(path)
        tail = S.tail_until_end(read(of, events.schema), read(say, last.schema), DELAY)
        tail.writeStream.format("parquet").option("path", out).option("checkpointLocation", at).trigger(availableNow=True).start().awaitTermination()
    return s.read.schema(tail.schema).parquet(out)


def _events(s: SparkSession, d: str, sql: str) -> DataFrame:
    return s.sql(sql, events=view(s, d, "audit_events"))


QUERIES = {
    "t1_tail_until_end": lambda s, d: tailed_events(s, _events(s, d, EVENTS), _events(s, d, STATUSES)).select("investigation_id", "pos", "event_id", "body"),
    "t1_events_until_end": lambda s, d: S.events_until_end(_events(s, d, EVENTS), _events(s, d, STATUSES)).select("investigation_id", "pos", "event_id", "body"),
    "t2_stream_evidence": lambda s, d: stored_evidence(s, view(s, d, "evidence")).select(*upsert_evidence(view(s, d, "evidence")).columns),
}


def oracles(upsert: str) -> dict[str, str]:
    tail = f"""{ctes('audit_events')}, ev AS ({EVENTS.format(events='audit_events')}), st AS ({STATUSES.format(events='audit_events')}), fin AS (SELECT investigation_id, min(created_at) AS end_at FROM st WHERE status = 'FAILED' GROUP BY 1)
SELECT ev.investigation_id, row_number() OVER (PARTITION BY ev.investigation_id ORDER BY created_at, event_id) AS pos, event_id, body FROM ev LEFT JOIN fin ON fin.investigation_id = ev.investigation_id WHERE end_at IS NULL OR created_at <= end_at"""
    return {"t1_tail_until_end": tail, "t1_events_until_end": tail, "t2_stream_evidence": upsert}
