"""Queries on the identity of pages, and their SQL for DuckDB.

Targets of a page are its host's label, the first words of its title and those of the next page's,
so that pages about their target and about another both occur.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from probitas.operators import identity as D
from probitas.operators import pages as P
from probitas.sources import catalog as C

TYPES = (C.WEBSITE, C.THIRD, C.GENERAL, C.GST)
HOST = "^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"
LABEL = r"([^.]+)\.[^.]+\.[^.]+$"
WORDS = r"^\S+(?:\s+\S+){0,2}"


def _pages(spark: SparkSession, sf: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    return P.page_text(pages.withColumn("host", F.regexp_extract(F.lower("url"), HOST, 1)), "host")


def _targets(pages: DataFrame) -> DataFrame:
    """(page_id, k, target, task_type)"""
    opening = F.regexp_extract(F.coalesce("title", F.lit("")), WORDS, 0)
    own = [F.struct(F.lit(0).alias("k"), F.regexp_extract("host", LABEL, 1).alias("target")), F.struct(F.lit(1).alias("k"), F.concat(opening, F.lit(" Private Limited")).alias("target"))]
    d = pages.select("page_id", F.explode(F.array(*own)).alias("o")).select("page_id", "o.*")
    d = d.unionByName(pages.select((F.col("page_id") - 1).alias("page_id"), F.lit(2).alias("k"), F.concat(opening, F.lit(" Limited GST verification")).alias("target")))
    kinds = F.array(*map(F.lit, TYPES))
    return d.withColumn("task_type", F.get(kinds, F.pmod(F.col("page_id") + F.col("k"), F.lit(len(TYPES))).cast("int")))


def page_identity(spark: SparkSession, sf: str) -> DataFrame:
    pages = _pages(spark, sf)
    return D.page_identity(D.page_profiles(pages), _targets(pages)).drop("task_type")


def entity_gate(spark: SparkSession, sf: str) -> DataFrame:
    pages = _pages(spark, sf)
    return D.entity_gate(D.page_identity(D.page_profiles(pages), _targets(pages))).select("page_id", "k", "task_type", "gate", "site_confidence")


def page_outcome(spark: SparkSession, sf: str) -> DataFrame:
    return D.page_outcome(spark.read.parquet(f"{sf}/pages.parquet"), _targets(_pages(spark, sf))).select("page_id", "k", "outcome")


QUERIES = {"j23_page_identity": page_identity, "p16_entity_gate": entity_gate, "x3_page_outcome": page_outcome}


# The same in SQL.


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _in(words) -> str:
    return "(" + ", ".join(map(_q, words)) + ")"


def _names(c: str) -> str:
    return f"list_distinct(list_filter(regexp_extract_all(lower({c}), '[a-z0-9]+'), lambda w: length(w) > 2 AND w NOT IN {_in(D.NAME_WORDS)}))"


def _bare(c: str) -> str:
    return f"list_filter({_names(c)}, lambda w: w NOT IN {_in(D.HINTS)})"


def _span(c: str) -> str:
    return f"regexp_extract({c}, {_q(D.NAME_SPAN)}, 1)"


def _all_ids(c: str, pattern: str) -> str:
    return f"list_distinct(regexp_extract_all(upper({c}), {_q(rf'\b({pattern})\b')}, 1))"


def _statement(texts: str, result: str, targets: str = "") -> str:
    """Up to the CTE who, then result; targets gives the CTE tgt (page_id, k, target) in place of the queries' own."""
    opening = f"regexp_extract(coalesce(title, ''), {_q(WORDS)})"
    name = "array_to_string(list_slice(words, 1, list_max(list_transform(words, lambda w, i: CASE WHEN regexp_replace(lower(w), '[^a-z]', '', 'g') IN " + _in(D.HINTS) + " THEN 0 ELSE i END))), ' ')"
    for p in D.IDS.values():
        name = f"regexp_replace({name if name.startswith('regexp') else f"upper(replace({name}, 'ß', 'SS'))"}, {_q(rf'\b{p}\b')}, ' ', 'g')"
    said = " OR ".join(f"(regexp_extract(low, {_q(rf'\b({p})\b')}, 1) <> '' AND contains(head, regexp_extract(low, {_q(rf'\b({p})\b')}, 1)))" for p in D.IDS_IN_TARGET.values())
    kinds = ", ".join(map(_q, TYPES))
    own = f"""tgt AS (SELECT page_id, 0 AS k, regexp_extract(host, {_q(LABEL)}, 1) AS target FROM pg UNION ALL SELECT page_id, 1, {opening} || ' Private Limited' FROM pg UNION ALL SELECT page_id - 1, 2, {opening} || ' Limited GST verification' FROM pg)"""
    return f"""{texts}, pg AS (SELECT t.page_id, coalesce(title, '') AS title, coalesce(text, '') AS text, regexp_extract(lower(url), {_q(HOST)}, 1) AS host FROM texts t JOIN pages p ON t.page_id = p.page_id),
  {targets or own},
  prof AS (SELECT page_id, regexp_replace(host, '^www\\.', '') AS host, lower(trim(title)) AS title, substr(lower(text), 1, {D.RELATION_CHARS}) AS head, {", ".join(f"{_all_ids('title || chr(10) || text', p)} AS page_{k}" for k, p in D.IDS.items())},
    regexp_split_to_array(title, {_q(D.TITLE_END)})[1] AS th, list_filter(list_transform(string_split(substr(text, 1, {D.CLAIM_CHARS}), chr(10)), lambda x: {_bare(_span("trim(x)"))}), lambda t: len(t) > 0)[1] AS line,
    {_names("title")} AS title_tokens, regexp_matches(title, {_q(D.SUFFIX_IN_TITLE)}) AS incorporated, {_names(f"substr(text, 1, {D.CONFLICT_CHARS})")} AS text_tokens FROM pg),
  claims AS (SELECT *, list_distinct(list_concat({_bare(f"CASE WHEN {_span('th')} <> '' THEN {_span('th')} ELSE th END")}, coalesce(line, []))) AS claimed FROM prof),
  a AS (SELECT page_id, k, target, lower(trim(target)) AS low, string_split(trim(regexp_replace(target, '\\s+', ' ', 'g')), ' ') AS words, {", ".join(f"{_all_ids('target', p)} AS t_{k}" for k, p in D.IDS.items())}, {_names("target")} AS every FROM tgt),
  b AS (SELECT a.*, c.* EXCLUDE (page_id), {_bare(name)} AS name, list_filter(regexp_split_to_array(low, '[^\\p{{L}}\\p{{N}}_]+'), lambda w: regexp_full_match(w, '[a-z0-9]{{3,}}') AND w NOT IN {_in(D.RELATION_WORDS)}) AS tokens,
    regexp_replace(regexp_replace(regexp_replace(low, 'https?://', '', 'g'), '/+$', ''), '^www\\.', '') AS url FROM a JOIN claims c ON a.page_id = c.page_id),
  d AS (SELECT *, len(tokens) AS n, len(list_filter(tokens, lambda w: contains(title, w))) AS in_title, len(list_filter(tokens, lambda w: contains(head, w))) AS in_head, len(name) AS m,
    len(list_filter(name, lambda w: list_contains(claimed, w))) AS shared, len(list_filter(claimed, lambda w: NOT list_contains(name, w))) AS extra,
    {" OR ".join(f"(len(t_{k}) > 0 AND len(page_{k}) > 0 AND NOT list_has_any(t_{k}, page_{k}))" for k in D.IDS)} AS differs, {" OR ".join(f"list_has_any(t_{k}, page_{k})" for k in D.IDS)} AS agrees FROM b),
  who AS (SELECT page_id, k, target, CASE WHEN (host <> '' AND (contains(low, host) OR contains(host, url) OR (n = 1 AND contains(host, tokens[1])))) OR {said} OR n = 0 THEN 'TARGET_ENTITY'
      WHEN regexp_matches(title, {_q(D.GROUP_TITLE)}) AND n > 1 AND in_title < n THEN 'PARENT_ENTITY' WHEN in_title = n OR (n > 1 AND in_title >= n - 1) OR in_head >= n THEN 'TARGET_ENTITY'
      WHEN n > 1 AND (in_title = 1 OR in_head = 1) THEN 'PARENT_ENTITY' WHEN in_head > 0 OR in_title > 0 THEN 'RELATED_ENTITY' ELSE 'UNRELATED' END AS relationship,
    differs OR (len(every) >= 2 AND len(title_tokens) > 0 AND incorporated AND NOT list_has_any(every, title_tokens) AND NOT list_has_any(every, text_tokens)) AS conflict,
    CASE WHEN differs THEN 'CONFLICT' WHEN agrees THEN 'MATCH' WHEN m = 0 OR len(claimed) = 0 THEN 'INSUFFICIENT' WHEN shared <= 1 AND m >= 2 THEN CASE WHEN extra > 0 THEN 'CONFLICT' ELSE 'INSUFFICIENT' END
      WHEN shared * 10 >= m * 6 AND extra = 0 THEN 'MATCH' WHEN extra > 0 AND shared < m THEN 'CONFLICT' ELSE 'INSUFFICIENT' END AS verdict,
    [{kinds}][1 + CAST(((page_id + k) % {len(TYPES)} + {len(TYPES)}) % {len(TYPES)} AS INT)] AS task_type FROM d)
  {result}"""


def _any(c: str, words) -> str:
    return f"len(list_filter([{', '.join(map(_q, words))}], lambda w: contains({c}, w))) > 0"


def _outcome(texts: str, plain: str, failures: str, targets: str = "") -> str:
    who = _statement(texts, "", targets)
    alnum = lambda c: f"regexp_replace({c}, '[^a-z0-9]', '', 'g')"
    ids = [f"regexp_extract(t, {_q(rf'\b({p})\b')}, 1)" for p in D.IDS_IN_TARGET.values()]
    held = " OR ".join(f"({v} <> '' AND (contains(text, {v}) OR contains(title, {v})))" for v in ids)
    site = alnum("string_split(trim(replace(coalesce(nullif(regexp_extract(t, '^[^/?#]*://([^/?#]+)', 1), ''), t), 'www.', '')), '.')[1]")
    return f"""{who}, fails AS ({failures}), raw AS (SELECT page_id, lower(regexp_extract(html, '<title[^>]*>(.*?)</title>', 1, 'is')) AS title,
    lower(array_to_string(list_filter(list_transform(string_split({plain}, chr(10)), lambda x: trim(regexp_replace(x, {_q(P.SPACES)}, ' ', 'g'))), lambda x: x <> ''), chr(10))) AS text FROM pages),
  j AS (SELECT tgt.page_id, k, lower(trim(target)) AS t, coalesce(title, '') AS title, text, failure FROM tgt JOIN raw r ON tgt.page_id = r.page_id JOIN fails f ON tgt.page_id = f.page_id),
  m AS (SELECT *, ' ' || substr(text, 1, {D.LEADING_CHARS}) || ' ' AS lead_, {_any("text", D.SIGNALS)} AS signals, {alnum("text")} AS plain, {site} AS site,
    list_filter(regexp_split_to_array(t, '[^\\p{{L}}\\p{{N}}_]+'), lambda w: w NOT IN {_in(D.OUTCOME_WORDS)} AND length(w) > 2) AS ws FROM j),
  h AS (SELECT *, len(ws) AS n, len(list_filter(ws, lambda w: contains(text, w) OR contains(title, w))) AS hits, {_any("text", D.PORTALS)} OR {_any("title", D.PORTALS)} OR {held} OR (signals AND ({" OR ".join(f"{v} <> ''" for v in ids)})) AS vouched FROM m)
SELECT page_id, k, CASE WHEN failure IS NOT NULL THEN failure
  WHEN len(list_filter([{", ".join(map(_q, D.SECTORS))}], lambda w: NOT contains(t, w) AND (contains(title, w) OR contains(lead_, ' ' || w || ' ')))) > 0 THEN 'IRRELEVANT_SECTOR'
  WHEN len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) < {D.JUDGED_WORDS} OR vouched THEN NULL
  WHEN CASE WHEN contains(t, '.') OR contains(t, '/') THEN length(site) > 2 AND NOT contains(plain, site) AND NOT contains(title, site)
    WHEN regexp_matches(t, '[0-9]') AND length(t) > 5 AND NOT contains(t, ' ') THEN NOT contains(plain, {alnum("t")}) AND NOT signals
    WHEN n > 1 THEN hits < 2 OR hits * 2 < n WHEN n = 1 THEN hits < 1 ELSE NOT contains(text, t) AND NOT contains(title, t) END THEN 'IRRELEVANT_CONTENT' END AS outcome FROM h"""


def gate_sql(who: str) -> str:
    return f"""SELECT page_id, k, task_type, CASE task_type WHEN '{C.WEBSITE}' THEN CASE WHEN relationship NOT IN {_in(D.WEBSITE_CONFIDENCE)} THEN 'REJECTED' END WHEN '{C.THIRD}' THEN CASE WHEN verdict <> 'MATCH' OR conflict THEN 'REJECTED' END
      WHEN '{C.GENERAL}' THEN CASE WHEN conflict THEN 'REJECTED' END ELSE CASE WHEN relationship = 'UNRELATED' AND conflict THEN 'REJECTED' END END AS gate,
      CASE WHEN task_type = '{C.WEBSITE}' THEN CASE relationship {" ".join(f"WHEN '{k}' THEN {v}" for k, v in D.WEBSITE_CONFIDENCE.items())} END END::DOUBLE AS site_confidence FROM {who}"""


def oracles(texts: str, plain: str, failures: str) -> dict[str, str]:
    return {"j23_page_identity": _statement(texts, "SELECT page_id, k, target, relationship, conflict, verdict FROM who"), "p16_entity_gate": _statement(texts, gate_sql("who")), "x3_page_outcome": _outcome(texts, plain, failures)}
