"""Queries on the election of pages, and their SQL for DuckDB.

Two tasks share four pages each: one is about the company in the title of the fourth, one about the site of the
second. One fetch in nineteen has no page. The task's type and place are such that the identity statement's own
numbering (page and k) gives the same type to all fetches of a task."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from probitas.operators import election as E
from probitas.operators import pages as P
from probitas.operators import results as R
from probitas.plans import identity as I
from probitas.plans.links import FIELDS

LOST = 1000000


def _tasks(s: SparkSession, d: str) -> DataFrame:
    """(task_id, task_type, target, required_fields)"""
    pages, group = I._pages(s, d), F.floor(F.col("page_id") / 4)
    opening = F.concat(F.regexp_extract(F.coalesce("title", F.lit("")), I.WORDS, 0), F.lit(" Private Limited"))
    of = pages.groupBy(group.alias("g")).agg(F.max(F.when(F.col("page_id") % 4 == 3, opening)).alias("t0"), F.max(F.when(F.col("page_id") % 4 == 1, F.regexp_extract("host", I.LABEL, 1))).alias("t1"))
    each = of.select("g", F.posexplode(F.array("t0", "t1")).alias("v", "target"))
    kind = F.get(F.array(*map(F.lit, I.TYPES)), F.pmod(F.col("g") + F.col("v"), F.lit(4)).cast("int"))
    return each.select((F.col("g") * 2 + F.col("v")).alias("task_id"), kind.alias("task_type"), F.coalesce("target", F.lit("")).alias("target"), F.array(*map(F.lit, FIELDS)).alias("required_fields"))


def _fetches(s: SparkSession, d: str) -> DataFrame:
    p, g = s.read.parquet(f"{d}/pages.parquet").select("page_id", "url", F.explode(F.array(F.lit(0), F.lit(1))).alias("v")), F.floor(F.col("page_id") / 4)
    i = F.col("page_id")
    return p.select(
        (g * 2 + F.col("v")).alias("task_id"), F.when(i % 19 == 7, i + LOST).otherwise(i).alias("page_id"), (i % 2).cast("int").alias("source_order"), F.floor(i % 4 / 2).cast("int").alias("url_order"),
        F.concat(F.lit("Source "), i % 4).alias("source_name"), "url", (1 + i % 4).cast("int").alias("tier"), ((5 + i % 5).cast("double") / 10).alias("confidence"),
    )


def _attempts(s: SparkSession, d: str) -> DataFrame:
    return E.page_attempts(E.judge_fetches(_fetches(s, d), _tasks(s, d), s.read.parquet(f"{d}/pages.parquet")))


def _results(s: SparkSession, d: str) -> DataFrame:
    pages = s.read.parquet(f"{d}/pages.parquet")
    text = P.identifiers(P.page_text(pages)).select("page_id", "gstin", "cin", P.company_status(F.col("text")).alias("company_status"), F.substring("title", 1, 20).alias("candidate_entities"))
    values = text.unpivot("page_id", list(FIELDS), "field_name", "field_value").filter("field_value is not null")
    return R.page_results(E.elected_pages(_tasks(s, d), _attempts(s, d)), values)


QUERIES = {"x4_page_attempts": lambda s, d: _attempts(s, d).select(*E.ATTEMPT), "x5_elected_results": _results}


# The same in SQL.


def oracles(texts: str, plain: str, challenge: str, facts: str, ids: str) -> dict[str, str]:
    opening = f"regexp_extract(coalesce(title, ''), {I._q(I.WORDS)})"
    target = f"""tk0 AS (SELECT page_id // 4 AS g, coalesce(max(CASE WHEN page_id % 4 = 3 THEN {opening} || ' Private Limited' END), '') AS t0, coalesce(max(CASE WHEN page_id % 4 = 1 THEN regexp_extract(host, {I._q(I.LABEL)}, 1) END), '') AS t1 FROM pg GROUP BY 1),
  tgt AS (SELECT page_id, ((g + v - page_id) % 4 + 4) % 4 + 4 * v AS k, CASE v WHEN 0 THEN t0 ELSE t1 END AS target FROM pg JOIN tk0 ON g = page_id // 4, (VALUES (0), (1)) z(v))"""
    kinds = ", ".join(map(I._q, I.TYPES))
    who = I._statement(texts, "SELECT page_id, k, target, task_type, relationship, conflict, verdict FROM who", target)
    gate = I.gate_sql("who")
    fits = I._outcome(texts, plain, challenge, target)
    reason = f"""CASE step WHEN 'ERROR' THEN '{E.NO_ANSWER}' WHEN 'CHALLENGE' THEN 'Verification challenge detected: ' || challenge WHEN 'OUTCOME' THEN 'Classification: ' || outcome
    WHEN 'GATE' THEN CASE task_type WHEN '{I.TYPES[0]}' THEN 'Website represents ' || relationship || ', not direct target entity' WHEN '{I.TYPES[1]}' THEN CASE WHEN verdict = 'CONFLICT' OR conflict THEN '{E.REFUSED["conflict"]}' ELSE '{E.REFUSED["unconfirmed"]}' END WHEN '{I.TYPES[2]}' THEN '{E.REFUSED[I.TYPES[2]]}' ELSE '{E.REFUSED["registry"]}' END END"""
    base = f"""ti AS ({texts} SELECT page_id, title, length(coalesce(text, '')) AS n FROM texts), bad AS ({challenge}), who AS MATERIALIZED ({who}), gates AS ({gate}), fits AS MATERIALIZED ({fits}),
  f AS (SELECT p.page_id, url, html, page_id // 4 * 2 + v AS task_id, (((page_id // 4 + v - page_id) % 4 + 4) % 4 + 4 * v) AS k, page_id % 19 = 7 AS lost FROM pages p, (VALUES (0), (1)) z(v)),
  j AS (SELECT f.task_id, f.page_id + CASE WHEN lost THEN {LOST} ELSE 0 END AS page_id, CAST(f.page_id % 2 AS INT) AS so, CAST((f.page_id % 4) // 2 AS INT) AS uo, 'Source ' || f.page_id % 4 AS source_name, f.url, CAST(1 + f.page_id % 4 AS INT) AS tier, CAST(5 + f.page_id % 5 AS DOUBLE) / 10 AS given,
    length(coalesce(html, '')) AS hn, ti.title, ti.n, challenge, outcome, gate, site_confidence, w.task_type, relationship, conflict, verdict,
    CASE WHEN lost THEN 'ERROR' WHEN challenge IS NOT NULL THEN 'CHALLENGE' WHEN outcome IS NOT NULL THEN 'OUTCOME' WHEN gate IS NOT NULL THEN 'GATE' ELSE 'PASSED' END AS step
    FROM f JOIN ti ON ti.page_id = f.page_id JOIN bad ON bad.page_id = f.page_id JOIN who w ON w.page_id = f.page_id AND w.k = f.k JOIN gates g ON g.page_id = f.page_id AND g.k = f.k JOIN fits x ON x.page_id = f.page_id AND x.k = f.k),
  o AS (SELECT *, row_number() OVER w AS attempt_order, min(CASE WHEN step = 'PASSED' THEN so * 10 + uo END) OVER (PARTITION BY task_id) AS first_at FROM j WINDOW w AS (PARTITION BY task_id ORDER BY so, uo, page_id)),
  tries AS (SELECT task_id, page_id, CAST(attempt_order AS INT) AS attempt_order, source_name, url, CASE step WHEN 'ERROR' THEN 'ERROR' WHEN 'CHALLENGE' THEN 'BLOCKED_OR_ERROR' WHEN 'OUTCOME' THEN outcome WHEN 'GATE' THEN 'REJECTED' ELSE 'SUCCESS' END AS status,
    CASE step {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in E.RESULTS.items())} END AS http_result, CASE WHEN step IN ('GATE', 'PASSED') THEN title END AS title, CAST(CASE step WHEN 'ERROR' THEN 0 WHEN 'GATE' THEN n WHEN 'PASSED' THEN n ELSE hn END AS INT) AS text_length,
    CASE step WHEN 'CHALLENGE' THEN 'BLOCKED_OR_ERROR' WHEN 'OUTCOME' THEN outcome WHEN 'GATE' THEN 'ENTITY_MISMATCH' WHEN 'PASSED' THEN 'PASSED' END AS relevance_result, {reason} AS failure_reason, CASE WHEN step = 'PASSED' THEN coalesce(site_confidence, given) ELSE 0.0 END AS confidence, step = 'PASSED' AS selected, tier, conflict
    FROM o WHERE first_at IS NULL OR so * 10 + uo <= first_at)"""
    return {
        "x4_page_attempts": f"WITH {base} SELECT {', '.join(E.ATTEMPT)} FROM tries",
        "x5_elected_results": f"""WITH {base}, fa AS ({facts}), id AS ({ids}), c AS (SELECT t.task_id, x.page_id, x.url, x.source_name, x.tier, x.confidence, coalesce(x.conflict, FALSE) AS entity_conflict FROM (SELECT DISTINCT task_id FROM f) t LEFT JOIN (SELECT * FROM tries WHERE selected) x ON x.task_id = t.task_id),
  e AS (SELECT c.*, unnest([1, 2, 3, 4]) AS k, unnest([{", ".join(map(I._q, FIELDS))}]) AS field_name FROM c),
  v AS (SELECT e.*, coalesce(CASE field_name WHEN 'gstin' THEN id.gstin WHEN 'cin' THEN id.cin WHEN 'company_status' THEN fa.company_status ELSE substr(ti.title, 1, 20) END, 'NOT_FOUND') AS field_value FROM e LEFT JOIN id ON id.page_id = e.page_id LEFT JOIN fa ON fa.page_id = e.page_id LEFT JOIN ti ON ti.page_id = e.page_id),
  z AS (SELECT *, entity_conflict AND field_name <> 'candidate_entities' AS other FROM v)
SELECT printf('RESULT-%d-%03d', task_id, k) AS result_id, task_id, page_id, field_name, field_value, coalesce(source_name, 'Public Source') AS source_name, url AS source_url, CASE WHEN other OR field_value IN ('NOT_FOUND', 'UNAVAILABLE', 'SOURCE_UNAVAILABLE') THEN 0.0 ELSE coalesce(confidence, 0.0) END AS confidence,
  CASE WHEN other THEN 'REJECTED' WHEN page_id IS NULL THEN 'SOURCE_UNAVAILABLE' WHEN field_value IN ('NOT_FOUND', 'UNAVAILABLE') THEN 'NOT_FOUND' WHEN contains(url, 'gov.in') OR confidence >= 0.7 THEN 'VERIFIED' ELSE 'UNVERIFIED' END AS verification_status,
  CASE WHEN other THEN 5 WHEN page_id IS NULL THEN 4 WHEN field_value NOT IN ('NOT_FOUND', 'UNAVAILABLE') AND contains(url, 'gov.in') THEN 1 ELSE tier END AS tier FROM z""",
    }
