"""Queries on dates in free form and on evidence as it was known when a task asked, and their SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from probitas.cluster import merged, stage_by
from probitas.functions.dates import read_date
from probitas.operators.asof import cached_as_of
from probitas.operators.evidence import normal_task, with_own_task
from probitas.sources.views import ctes, dealt, dealt_tasks, view

DATES_AS_OF = "1998-12-01"
#: How an order's date is written, by its key, and what the reader must make of it in SQL.
_D = "CAST(o_orderdate AS DATE)"
FORMS = (
    ("yyyy-MM-dd", _D),
    ("MMMM d, yyyy", _D),
    ("d'th' MMM yy", _D),
    ("yyyy", f"make_date(year({_D}), 12, 1)"),
    ("MM/dd/yyyy", _D),
    ("dd/MM/yyyy", f"CASE WHEN day({_D}) > 12 THEN {_D} ELSE make_date(year({_D}), day({_D}), month({_D})) END"),
    ("yyyyMMdd", _D),
    ("MMM yyyy", f"make_date(year({_D}), month({_D}), 1)"),
    ("EEE, dd MMM yyyy 10:30:00 '+0530'", f"{_D} + INTERVAL 630 MINUTE"),
    ("d-MMM-yyyy '9 PM'", f"{_D} + INTERVAL 21 HOUR"),
    ("'on' d'rd of' MMMM yyyy", _D),
    ("'Incorporated' yyyy", "NULL"),
    ("d MMMM", f"TRY_CAST('1998-' || strftime({_D}, '%m-%d') AS DATE)"),
    ("yyyyMMdd'0915'", f"{_D} + INTERVAL 555 MINUTE"),
)


def free_dates(s: SparkSession, d: str) -> DataFrame:
    """Every order's date, written in one of the forms, as it is read back."""
    k = F.col("o_orderkey") % len(FORMS)
    text = F.coalesce(*(F.when(k == i, F.date_format("o_orderdate", form)) for i, (form, _) in enumerate(FORMS)))
    read = read_date(F.col("told"), F.lit(DATES_AS_OF))
    return s.read.parquet(f"{d}/orders.parquet").select("o_orderkey", text.alias("told")).select("o_orderkey", F.unix_timestamp(read).alias("read_at"))


def asked(s: SparkSession, d: str, tasks: DataFrame) -> DataFrame:
    """What each task of evidence wants, field by field, some days after its investigation began."""
    ev = with_own_task(dealt(s, d, "evidence"), tasks).select("investigation_id", "task_id", "field_name", "source_name", "field_value", "retrieved_at", "ev_seq", "task")
    ev = stage_by(ev, "investigation_id", dealt_tasks(s, d), "linked")
    wanted = ev.filter("task is not null").select("investigation_id", "task_id", "field_name", "source_name", "task.*").distinct()
    days = ((F.col("investigation_id") * 7 + F.substring("task_id", 6, 9).cast("int") * 13) % 120).cast("int")
    at = F.date_add("created_at", days).cast("timestamp") + F.expr("INTERVAL 12 HOURS")
    begun = view(s, d, "investigations").select("investigation_id", "created_at")
    return cached_as_of(wanted.join(merged(begun), "investigation_id").withColumn("asked_at", at), ev.withColumns(normal_task("task")))


def queries(tasks: Callable[..., DataFrame]) -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "f12_free_dates": free_dates,
        "j7_cached_as_of": lambda s, d: asked(s, d, tasks(s, d, dealt)).select("investigation_id", "task_id", "field_name", "source_name", "asked_at", "found_value", "found_at", "found"),
    }


def oracles(tasks: str, key: Callable[[str], str], fresh: str) -> dict[str, str]:
    """tasks: SELECT of one row a task; key: a source's name in its normal form; fresh: days for a field."""
    same = "w.field_name = n.field_name AND w.k = n.k"
    read = " ".join(f"WHEN {i} THEN CAST({sql} AS TIMESTAMP)" for i, (_, sql) in enumerate(FORMS))
    return {
        "f12_free_dates": f"SELECT o_orderkey, CAST(epoch(CASE o_orderkey % {len(FORMS)} {read} END) AS BIGINT) AS read_at FROM orders",
        "j7_cached_as_of": f"""{ctes('investigations', 'evidence', 'research_tasks')}, tk AS ({tasks}), facts AS (SELECT e.*, CAST(retrieved_at AS TIMESTAMP) AS seen, {key('source_name')} AS k, upper(trim(t.task_type)) AS kind, lower(trim(t.target)) AS tg, lower(trim(t.objective)) AS ob, t.task_id IS NOT NULL AS linked
    FROM evidence e LEFT JOIN tk t ON e.investigation_id = t.investigation_id AND e.task_id = t.task_id),
  newest AS (SELECT *, {{'a': seen, 'b': investigation_id, 'c': ev_seq, 'd': field_value}} AS x FROM facts QUALIFY row_number() OVER (PARTITION BY field_name, k, linked, kind, tg, ob, seen ORDER BY investigation_id DESC, ev_seq DESC) = 1),
  wanted AS (SELECT DISTINCT t.investigation_id, t.task_id, field_name, source_name, {key('source_name')} AS k, upper(trim(t.task_type)) AS kind, lower(trim(t.target)) AS tg, lower(trim(t.objective)) AS ob,
    CAST(i.created_at AS TIMESTAMP) + CAST((t.investigation_id * 7 + CAST(substr(t.task_id, 6) AS INT) * 13) % 120 AS INT) * INTERVAL 1 DAY + INTERVAL 12 HOUR AS asked_at
    FROM tk t JOIN evidence e ON e.investigation_id = t.investigation_id AND e.task_id = t.task_id JOIN investigations i ON i.investigation_id = t.investigation_id),
  own AS (SELECT w.*, n.x AS own FROM wanted w ASOF LEFT JOIN (SELECT * FROM newest WHERE linked) n ON {same} AND w.kind = n.kind AND w.tg = n.tg AND w.ob = n.ob AND w.asked_at >= n.seen),
  best AS (SELECT w.*, CASE WHEN own IS NULL OR n.x > own THEN coalesce(n.x, own) ELSE own END AS x FROM own w ASOF LEFT JOIN (SELECT * FROM newest WHERE NOT linked) n ON {same} AND w.asked_at >= n.seen),
  kept AS (SELECT *, x IS NOT NULL AND floor((epoch(asked_at) - epoch(x.a)) / 86400) < {fresh} AS ok FROM best)
SELECT investigation_id, task_id, field_name, source_name, asked_at, CASE WHEN ok THEN x.d END AS found_value, CASE WHEN ok THEN x.a END AS found_at, ok AS found FROM kept""",
    }
