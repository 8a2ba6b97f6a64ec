"""The library's queries over derived due-diligence tables, and their SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from probitas.functions import text as X
from probitas.operators import evidence as E
from probitas.operators import linkage as L
from probitas.operators import listing as I
from probitas.operators import pages as P
from probitas.operators import qa as Q
from probitas.operators import report as R
from probitas.operators import risk as K
from probitas.plans import cases, corpus, election, extract, identity, links, planning, rules, streams, timing, workflow
from probitas.sources.catalog import SOURCES, source_catalog
from probitas.sources.views import ctes, view

AS_OF = "1998-12-01 00:00:00"


def _ids(name: str = "evidence_ids") -> F.Column:
    return F.array_join(name, ",").alias(name)


def _ev(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "evidence")


def _strings(words) -> str:
    return ", ".join(f"'{w}'" for w in words)


_TASKS = "SELECT investigation_id, 'TASK-' || CAST(CAST(substr(task_id, 6) AS INT) AS STRING) AS task_id, {first}(task_type, seq) AS task_type, {first}(target, seq) AS target, {first}(objective, seq) AS objective FROM research_tasks GROUP BY 1, 2"


def _tasks(spark: SparkSession, sf: str, of: Callable[[SparkSession, str, str], DataFrame] = view) -> DataFrame:
    return spark.sql(_TASKS.format(first="min_by").replace("research_tasks", "{tasks}"), tasks=of(spark, sf, "research_tasks"))


def linked_evidence(spark: SparkSession, sf: str) -> DataFrame:
    return E.link_evidence_to_tasks(_ev(spark, sf), _tasks(spark, sf))


def _cached(spark: SparkSession, sf: str) -> DataFrame:
    """What each task of evidence wants, field by field, from evidence as it is linked to tasks."""
    ev, tasks = _ev(spark, sf), _tasks(spark, sf)
    wanted = tasks.join(ev.select("investigation_id", "task_id", "field_name", "source_name"), ["investigation_id", "task_id"]).distinct()
    return E.cached_results(wanted, E.link_evidence_to_tasks(ev, tasks), F.lit(AS_OF))


def _status(spark: SparkSession, sf: str) -> DataFrame:
    return R.source_status(_ev(spark, sf), source_catalog(spark))


def _html(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/pages.parquet")


def _history(s: SparkSession, d: str) -> DataFrame:
    """Histories with their lists as strings; a version of the report is there for each task."""
    tasks = view(s, d, "research_tasks")
    h = I.history(view(s, d, "investigations"), _ev(s, d), view(s, d, "audit_events"), tasks, tasks.select("investigation_id", F.col("seq").alias("version")))
    told = F.array_join(F.transform("tasks", lambda t: F.concat_ws("|", *(t[c] for c in ("task_id", "task_type", "target", "objective", "status")))), ";")
    return h.withColumns({"evidence_ids": F.array_join("evidence_ids", ","), "tasks": told, "latest_version": F.col("latest_version").cast("int")})


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "a1_risk_scores": lambda s, d: K.risk_scores(view(s, d, "investigations"), _ev(s, d)),
    "a2_category_scores": lambda s, d: K.category_scores(K.risk_signals(_ev(s, d))),
    "a3_minimum_evidence": lambda s, d: K.minimum_evidence(_ev(s, d)),
    "j22_risk_signals": lambda s, d: K.risk_signals(_ev(s, d)).select("investigation_id", "code", "category", "severity", _ids(), "confidence", "risk_weight"),
    "j10_12_conflicts": lambda s, d: K.conflict_triggers(K.admissible(_ev(s, d))).select("investigation_id", "code", _ids(), "confidence"),
    "w3_first_triggers": lambda s, d: K.first_triggers(K.admissible(_ev(s, d))).select("investigation_id", "code", _ids(), "confidence"),
    "p11_normalize_evidence": lambda s, d: K.normalize_evidence(_ev(s, d)).select("investigation_id", "ev_seq", "confidence", "verification_status"),
    "p12_admissible": lambda s, d: K.admissible(_ev(s, d)).select("investigation_id", "research_result_id", "ev_seq"),
    "p13_substantive": lambda s, d: K.substantive(K.admissible(_ev(s, d))).select("investigation_id", "research_result_id", "ev_seq"),
    "p8_validate_results": lambda s, d: E.validate_results(_ev(s, d)).select("investigation_id", "ev_seq", F.array_join("errors", "; ").alias("errors"), "is_valid"),
    "p14_unverified": lambda s, d: R.unverified_information(_ev(s, d)).select("investigation_id", "ev_seq", "field_name", "field_value"),
    "s8_upsert_evidence": lambda s, d: E.upsert_evidence(_ev(s, d)),
    "f13_fresh": lambda s, d: _ev(s, d).filter(E.is_fresh(F.col("retrieved_at"), F.col("field_name"), F.lit(AS_OF))).select("investigation_id", "ev_seq", "field_name"),
    "j7_cached_results": lambda s, d: _cached(s, d).select("investigation_id", "task_id", "field_name", "source_name", "found_value", "found_at", "found"),
    "j8_split_cached": lambda s, d: E.split_cached(_cached(s, d), "investigation_id", "task_id"),
    "w2_latest_evidence": lambda s, d: E.latest_evidence(_ev(s, d)).select("investigation_id", "field_name", "field_value", "ev_seq"),
    "j1_exact_matches": lambda s, d: L.exact_matches(view(s, d, "targets"), view(s, d, "candidates")),
    "j2_identifier_conflicts": lambda s, d: L.identifier_conflicts(view(s, d, "targets"), view(s, d, "candidates"), "nationkey"),
    "j4_score_pairs": lambda s, d: L.score_scope(view(s, d, "targets"), view(s, d, "candidates"), "nationkey").select("target_id", "candidate_id", "score", "exact", "conflict"),
    "j5_resolve": lambda s, d: L.resolve_scope(view(s, d, "targets"), view(s, d, "candidates"), "nationkey"),
    "a4_source_status": _status,
    "a5_attempt_rollup": lambda s, d: R.attempt_rollup(view(s, d, "attempts")),
    "a6_consistency": lambda s, d: R.consistency(_ev(s, d)),
    "a10_attempt_counters": lambda s, d: R.attempt_counters(view(s, d, "attempts").withColumn("source_type", F.when(F.col("domain").isin("gst.gov.in", "mca.gov.in"), "preferred").otherwise("fallback"))),
    "a12_primary_source": lambda s, d: R.primary_source(_ev(s, d)),
    "j19_reconcile_attempts": lambda s, d: R.reconcile_attempts(view(s, d, "attempts"), _ev(s, d)).select("attempt_id", "final_status", "selected"),
    "j20_source_limitations": lambda s, d: R.source_limitations(_status(s, d), view(s, d, "attempts")),
    "j16_contradicted_findings": lambda s, d: Q.contradicted_findings(K.risk_signals(_ev(s, d)), _ev(s, d)),
    "j14_grounding": lambda s, d: Q.check_grounding(K.risk_signals(_ev(s, d)), E.evidence_for(_ev(s, d), view(s, d, "investigations").filter("status = 'COMPLETED'"))),
    "p5_incomplete": lambda s, d: I.incomplete(view(s, d, "investigations")).select("investigation_id", "user_id", "status"),
    "p4_list_investigations": lambda s, d: I.list_investigations(view(s, d, "investigations"), "user-7", "COMPLETED").select("investigation_id", "user_id", "status"),
    "a9_history": _history,
    "t4_latest_status": lambda s, d: I.latest_status(view(s, d, "audit_events")),
    "x1_page_text": lambda s, d: P.page_text(_html(s, d)),
    "x6_identifiers": lambda s, d: P.identifiers(P.page_text(_html(s, d))).drop("title", "text"),
    "x17_link_table": lambda s, d: P.link_table(_html(s, d)),
    "x1_neutralize_documents": lambda s, d: s.read.parquet(f"{d}/documents.parquet").select("doc_id", F.md5(P.neutralize(F.col("text")).cast("binary")).alias("text_md5")),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {**QUERIES, **planning.QUERIES, **identity.QUERIES, **extract.QUERIES, **links.QUERIES, **cases.QUERIES, **corpus.QUERIES, **election.QUERIES, **streams.QUERIES, **rules.QUERIES, **timing.queries(_tasks), **workflow.QUERIES}


# The same in SQL. CTEs that several statements share:

_VALUE = "upper(trim(coalesce(field_value, '')))"
_NORM = """, norm AS (SELECT * REPLACE (CASE WHEN field_value IN ('NOT_FOUND', 'UNAVAILABLE') OR coalesce(verification_status, 'UNVERIFIED') IN ('SOURCE_UNAVAILABLE', 'NOT_FOUND') THEN 0.0 ELSE confidence END AS confidence,
  coalesce(verification_status, 'UNVERIFIED') AS verification_status) FROM evidence)"""
_ADM = f"""{_NORM}, adm AS (SELECT * FROM norm WHERE trim(research_result_id) <> '' AND trim(source_name) <> '' AND trim(field_name) <> '' AND confidence BETWEEN 0.5 AND 1.0 AND field_value NOT IN ('', '[]', '{{}}')
  AND {_VALUE} NOT IN ('NOT_FOUND', 'UNAVAILABLE') AND upper(trim(verification_status)) NOT IN ('SOURCE_UNAVAILABLE', 'NOT_FOUND', {_strings(K.EXCLUDED)})
  QUALIFY row_number() OVER (PARTITION BY investigation_id, research_result_id ORDER BY ev_seq) = 1)"""
_SUB = f", sub AS (SELECT * FROM adm WHERE field_name <> 'candidate_entities' AND (confidence >= 0.7 OR upper(trim(verification_status)) = 'VERIFIED') AND field_name NOT IN ({_strings(K.LOW_INFORMATION)}))"
_FIRST = f""", trig AS (SELECT investigation_id, ev_seq, research_result_id, confidence, CASE WHEN field_name = 'gst_status' AND lower(trim(field_value)) IN ({_strings(K.GST_BAD)}) THEN 'GST_INACTIVE'
    WHEN field_name IN ('company_status', 'registration_status') AND regexp_replace(lower(trim(field_value)), '\\s+', ' ', 'g') IN ({_strings(K.COMPANY_BAD)}) THEN 'COMPANY_STATUS_ADVERSE'
    WHEN field_name IN ('registration_date', 'incorporation_date') AND floor((epoch(CAST(retrieved_at AS TIMESTAMP)) - epoch(CAST(TRY_CAST(field_value AS DATE) AS TIMESTAMP))) / 86400) < 365 THEN 'VERY_RECENT_REGISTRATION' END AS code FROM adm),
  firsts AS (SELECT investigation_id, code, research_result_id AS evidence_ids, confidence FROM trig WHERE code IS NOT NULL QUALIFY row_number() OVER (PARTITION BY investigation_id, code ORDER BY ev_seq) = 1)"""
_GROUP = "CASE " + " ".join(f"WHEN field_name IN ({_strings(g)}) THEN {k}" for k, g in enumerate(K.ADDRESS_GROUPS)) + " END"
_CONFLICT = f""", usable AS (
    SELECT investigation_id, 'LEGAL_NAME_CONFLICT' AS code, 0 AS grp, {X.sql_rule_name("field_value")} AS norm, ev_seq, research_result_id AS id, confidence FROM adm WHERE field_name IN ({_strings(K.NAME_FIELDS)})
    UNION ALL SELECT investigation_id, 'ADDRESS_MAJOR_MISMATCH', {_GROUP}, {X.sql_norm_address("field_value")}, ev_seq, research_result_id, confidence FROM adm WHERE {_GROUP} IS NOT NULL AND {X.sql_is_full_address("field_value")}
    UNION ALL SELECT investigation_id, 'BUSINESS_ACTIVITY_MISMATCH', 0, regexp_replace(lower(field_value), '[^a-z0-9]', '', 'g'), ev_seq, research_result_id, confidence FROM adm WHERE field_name = 'business_activity'),
  u AS (SELECT * FROM usable WHERE norm <> ''),
  pairs AS (SELECT a.investigation_id, a.code, a.grp, a.ev_seq AS i, b.ev_seq AS j, a.id || ',' || b.id AS evidence_ids, (a.confidence + b.confidence) / 2 AS confidence
    FROM u a JOIN u b ON a.investigation_id = b.investigation_id AND a.code = b.code AND a.grp = b.grp AND a.ev_seq < b.ev_seq AND a.norm <> b.norm),
  conflicts AS (SELECT investigation_id, code, evidence_ids, confidence FROM pairs QUALIFY row_number() OVER (PARTITION BY investigation_id, code ORDER BY grp, i, j) = 1)"""
_RULES = ", rules(code, weight, category, severity) AS (VALUES " + ", ".join(str(r) for r in K.RULES) + ")"
_SIGNALS = f"""{_ADM}{_SUB}{_FIRST}{_CONFLICT}{_RULES}, signals AS (SELECT h.investigation_id, h.code, category, severity, evidence_ids, confidence, weight AS risk_weight
  FROM (SELECT * FROM firsts UNION ALL SELECT * FROM conflicts) h JOIN rules r ON h.code = r.code WHERE h.investigation_id IN (SELECT investigation_id FROM sub))"""
_LEVEL = "CASE " + " ".join(f"WHEN score BETWEEN {a} AND {b} THEN '{n}'" for n, a, b in K.LEVELS) + " ELSE 'UNKNOWN' END"


def _cat(c: str) -> str:
    third = " OR ".join([f"contains(lower({c}), '{w}')" for w in R.THIRD_PARTY] + [f"translate(lower(trim({c})), '_.', '--') IN ({_strings(x[0].translate(str.maketrans('_.', '--')) for x in SOURCES if x[2] == 'THIRD_PARTY_REGISTRY')})"])
    return f"CASE WHEN contains(lower({c}), 'gst') THEN 'gst' WHEN contains(lower({c}), 'mca') THEN 'mca' WHEN contains(lower({c}), 'epf') THEN 'epfo' WHEN {third} THEN 'third_party' WHEN contains(lower({c}), 'website') OR contains(lower({c}), 'company') THEN 'official_website' ELSE 'general_web' END"


_DOMAIN = "CASE WHEN contains(domain, 'gst') THEN 'gst' WHEN contains(domain, 'mca') THEN 'mca' WHEN contains(domain, 'epf') THEN 'epfo' WHEN contains(domain, 'website') THEN 'official_website' WHEN contains(domain, 'zauba') OR contains(domain, 'quick') THEN 'third_party' ELSE 'general_web' END"
_STATUS = f""", tagged AS (SELECT investigation_id, {_cat("source_name")} AS category, {_VALUE} AS v, field_name,
    {_VALUE} NOT IN ('NOT_FOUND', 'UNAVAILABLE', 'NONE', 'BLOCKED') AND CASE WHEN coalesce(verification_status, '') <> '' THEN verification_status = 'VERIFIED' ELSE confidence >= 0.7 END AS ok FROM evidence),
  per AS (SELECT investigation_id, category, count(*) AS n, bool_or(ok) AS ok, bool_or(contains(v, 'CAPTCHA')) AS captcha, bool_or(v IN ('BLOCKED', 'SOURCE_UNAVAILABLE', 'TIMEOUT')) AS blocked, bool_or(v IN ('NOT_FOUND', 'NONE')) AS missing
    FROM tagged WHERE field_name <> 'candidate_entities' GROUP BY ALL),
  status AS (SELECT i.investigation_id, c.category, CASE WHEN ok THEN 'VERIFIED' WHEN captcha THEN 'CAPTCHA_REQUIRED' WHEN blocked THEN 'BLOCKED' WHEN missing THEN 'NOT_FOUND' ELSE 'UNAVAILABLE' END AS status, CASE WHEN n IS NULL THEN '{R.NO_RESEARCH}' WHEN ok THEN '{R.DETAILS["VERIFIED"]}' WHEN captcha THEN '{R.DETAILS["CAPTCHA_REQUIRED"]}' WHEN blocked THEN '{R.DETAILS["BLOCKED"]}' WHEN missing THEN '{R.DETAILS["NOT_FOUND"]}' ELSE '{R.NO_DETAIL}' END AS details, coalesce(n, 0) AS evidence_count
    FROM (SELECT DISTINCT investigation_id FROM evidence) i CROSS JOIN (SELECT unnest([{_strings(R.CATEGORIES)}]) AS category) c LEFT JOIN per p ON i.investigation_id = p.investigation_id AND c.category = p.category)"""
_RANK = "CASE status " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in R.ATTEMPT_RANK.items()) + " ELSE 0 END"


def _entity(c: str) -> str:
    return f"{X.sql_norm_text('name')} AS {c}name, {X.sql_norm_text('location')} AS {c}location, {X.sql_norm_website('website')} AS {c}website, nullif(upper(regexp_replace(gstin, '\\s+', '', 'g')), '') AS {c}gstin, {X.sql_name_tokens(X.sql_norm_text('name'))} AS {c}tokens, {X.sql_sector_mask(X.sql_norm_text('name'))} AS {c}sector"


_PAIRS = f""", t AS (SELECT target_id, nationkey, {_entity("t_")} FROM targets), c AS (SELECT candidate_id, nationkey, {_entity("c_")} FROM candidates),
  p AS (SELECT *, CAST(len(list_intersect(t_tokens, c_tokens)) AS DOUBLE) AS n_both, CAST(len(list_distinct(t_tokens)) AS DOUBLE) AS n_t, CAST(len(list_distinct(c_tokens)) AS DOUBLE) AS n_c FROM t JOIN c ON t.nationkey = c.nationkey),
  f AS (SELECT *, 2 * ((n_both / n_c) * (n_both / n_t)) / ((n_both / n_c) + (n_both / n_t)) AS f1, coalesce(t_gstin <> c_gstin, FALSE) AS conflict, coalesce(t_gstin = c_gstin, FALSE) OR coalesce(t_website = c_website, FALSE) AS exact FROM p),
  n AS (SELECT *, CASE WHEN n_t = 0 OR n_c = 0 THEN 0.0 WHEN t_tokens = c_tokens THEN 1.0 WHEN t_sector <> c_sector THEN 0.0 WHEN n_both = 0 THEN 0.0 WHEN len(t_tokens) > 1 AND n_both = 1 THEN round(least(0.3, f1), 4) ELSE round(f1, 4) END AS sim FROM f),
  w AS (SELECT *, CASE WHEN t_name IS NOT NULL AND c_name IS NOT NULL THEN CASE WHEN t_name = c_name THEN CAST(0.4 AS DOUBLE) ELSE CAST(0.4 AS DOUBLE) * sim END ELSE 0 END
      + CASE WHEN t_location = c_location THEN CAST(0.15 AS DOUBLE) ELSE 0 END + CASE WHEN t_website = c_website THEN CAST(0.1 AS DOUBLE) ELSE 0 END + CASE WHEN t_gstin = c_gstin THEN CAST(0.1 AS DOUBLE) ELSE 0 END AS gain,
      CASE WHEN t_name IS NOT NULL AND c_name IS NOT NULL THEN CAST(0.4 AS DOUBLE) ELSE 0 END + CASE WHEN t_location IS NOT NULL AND c_location IS NOT NULL THEN CAST(0.15 AS DOUBLE) ELSE 0 END
      + CASE WHEN t_website IS NOT NULL AND c_website IS NOT NULL THEN CAST(0.1 AS DOUBLE) ELSE 0 END + CASE WHEN t_gstin IS NOT NULL AND c_gstin IS NOT NULL THEN CAST(0.1 AS DOUBLE) ELSE 0 END AS weight FROM n),
  scored AS (SELECT target_id, candidate_id, CASE WHEN conflict OR t_sector <> c_sector OR weight = 0 THEN 0.0 ELSE round(gain / weight, 4) END AS score, exact, conflict, exact OR coalesce(t_location = c_location, FALSE) AS supported, len(t_tokens) < 2 AS one_token FROM w)"""
_FRESH = "CASE " + " ".join(f"WHEN contains(field_name, '{w}') THEN {d}" for w, d in E.FRESH_DAYS) + f" ELSE {E.FRESH_DEFAULT} END"
_FRESH_EV = f", fresh AS (SELECT * FROM evidence WHERE floor((epoch(TIMESTAMP '{AS_OF}') - epoch(CAST(retrieved_at AS TIMESTAMP))) / 86400) < {_FRESH})"
_KEY = lambda c: f"CASE lower(trim({c})) " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in E.PORTAL_NAMES) + f" ELSE lower(trim({c})) END"
_CACHED = f"""{_FRESH_EV}, tk AS ({_TASKS.format(first="arg_min")}),
  linked AS (SELECT e.*, {_KEY("source_name")} AS k, upper(trim(t.task_type)) AS kind, lower(trim(t.target)) AS tg, lower(trim(t.objective)) AS ob, t.task_id IS NOT NULL AS linked FROM fresh e LEFT JOIN tk t ON e.investigation_id = t.investigation_id AND e.task_id = t.task_id),
  newest AS (SELECT * FROM linked QUALIFY row_number() OVER (PARTITION BY field_name, k, linked, kind, tg, ob ORDER BY retrieved_at DESC, investigation_id DESC, ev_seq DESC) = 1),
  wanted AS (SELECT DISTINCT t.*, field_name, source_name FROM tk t JOIN evidence e ON e.investigation_id = t.investigation_id AND e.task_id = t.task_id),
  cached AS (SELECT w.investigation_id, w.task_id, w.field_name, w.source_name, n.field_value AS found_value, n.retrieved_at AS found_at, n.k IS NOT NULL AS found FROM wanted w
    LEFT JOIN newest n ON w.field_name = n.field_name AND {_KEY("w.source_name")} = n.k AND (NOT n.linked OR (upper(trim(w.task_type)) = n.kind AND lower(trim(w.target)) = n.tg AND lower(trim(w.objective)) = n.ob))
    QUALIFY row_number() OVER (PARTITION BY w.investigation_id, w.task_id, w.field_name, w.source_name ORDER BY n.retrieved_at DESC NULLS LAST, n.investigation_id DESC, n.ev_seq DESC) = 1)"""
_NEUTRAL = lambda c: __import__("functools").reduce(lambda v, p: f"regexp_replace({v}, '{p[0].replace('(?i)', '')}', '{p[1]}', 'gi')", P.INJECTIONS, c)
_CLEAN = lambda c: f"trim(regexp_replace({c}, '{P.SPACES}', ' ', 'g'))"
_PLAIN = "regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''), '<script[^>]*>.*?</script>', ' ', 'gis'), '<style[^>]*>.*?</style>', ' ', 'gis'), '<(?:/div|/p|/h[1-6]|/tr|/li|br\\s*/?|/td|/section|/article)>', chr(10), 'gi'), '<[^>]+>', ' ', 'g')"
_TEXTS = f"""WITH texts AS (SELECT page_id, CASE WHEN regexp_matches(html, '<title[^>]*>.*?</title>', 'is') THEN {_NEUTRAL(_CLEAN("regexp_extract(html, '<title[^>]*>(.*?)</title>', 1, 'is')"))} END AS title,
  {_NEUTRAL(f"array_to_string(list_filter(list_transform(string_split({_PLAIN}, chr(10)), lambda x: {_CLEAN('x')}), lambda x: x <> ''), chr(10))")} AS text FROM pages)"""
_WORDS = lambda v: f"list_distinct(list_transform(list_filter(regexp_split_to_array(upper({v}), '\\s+'), lambda x: x NOT IN ({_strings(R.STOPWORDS)}) AND length(x) > 2), lambda x: regexp_replace(x, '^[,.;:]+|[,.;:]+$', '', 'g')))"

ORACLES: dict[str, str] = {
    "a1_risk_scores": f"""{ctes("investigations", "evidence")}{_SIGNALS}, sums AS (SELECT investigation_id, sum(risk_weight) AS total, count(*) AS n FROM signals GROUP BY 1),
  j AS (SELECT i.investigation_id, i.investigation_id NOT IN (SELECT investigation_id FROM sub) AS insufficient_evidence, total, coalesce(n, 0) AS n_signals FROM investigations i LEFT JOIN sums s ON i.investigation_id = s.investigation_id),
  k AS (SELECT *, CASE WHEN NOT insufficient_evidence THEN CAST(least(coalesce(total, 0), 100) AS INTEGER) END AS score FROM j)
SELECT investigation_id, score, CASE WHEN insufficient_evidence THEN 'INSUFFICIENT_EVIDENCE' ELSE {_LEVEL} END AS level, insufficient_evidence, n_signals FROM k""",
    "a2_category_scores": f"{ctes('evidence')}{_SIGNALS} SELECT investigation_id, " + ", ".join(f"CAST(least(coalesce(sum(CASE WHEN lower(category) = '{c}' THEN risk_weight END), 0), 100) AS INTEGER) AS {c}" for c in K.CATEGORIES) + " FROM signals GROUP BY 1",
    "a3_minimum_evidence": f"""{ctes("evidence")}, e AS (SELECT *, confidence >= 0.5 AND {_VALUE} NOT IN ('NOT_FOUND', 'UNAVAILABLE') AND coalesce(verification_status, '') NOT IN ('SOURCE_UNAVAILABLE', 'NOT_FOUND') AS ok FROM evidence),
  g AS (SELECT investigation_id, count(DISTINCT CASE WHEN ok AND source_name IN ({_strings(K.LEGAL_SOURCES)}) THEN source_name END) AS n_legal, count(DISTINCT CASE WHEN ok AND source_name IN ({_strings(K.SUPPORTING_SOURCES)}) THEN source_name END) AS n_supporting FROM e GROUP BY 1)
SELECT *, n_legal >= 1 AND n_supporting >= 1 AS met FROM g""",
    "j22_risk_signals": f"{ctes('evidence')}{_SIGNALS} SELECT * FROM signals",
    "j10_12_conflicts": f"{ctes('evidence')}{_ADM}{_CONFLICT} SELECT * FROM conflicts",
    "w3_first_triggers": f"{ctes('evidence')}{_ADM}{_FIRST} SELECT * FROM firsts",
    "p11_normalize_evidence": f"{ctes('evidence')}{_NORM} SELECT investigation_id, ev_seq, confidence, verification_status FROM norm",
    "p12_admissible": f"{ctes('evidence')}{_ADM} SELECT investigation_id, research_result_id, ev_seq FROM adm",
    "p13_substantive": f"{ctes('evidence')}{_ADM}{_SUB} SELECT investigation_id, research_result_id, ev_seq FROM sub",
    "p8_validate_results": f"""{ctes("evidence")}, e AS (SELECT investigation_id, ev_seq, list_filter([CASE WHEN field_value IS NULL THEN 'field_value is missing' WHEN trim(field_value) = '' THEN 'field_value is empty' END,
   CASE WHEN NOT confidence BETWEEN 0 AND 1 THEN 'confidence must be between 0.0 and 1.0' WHEN confidence <= 0 THEN 'confidence must be greater than 0.0' END,
   {", ".join(f"CASE WHEN trim(coalesce({c}, '')) = '' THEN '{c} is empty' END" for c in ("research_result_id", "task_id", "field_name", "source_name"))},
   CASE WHEN {_VALUE} IN ({_strings(E.PLACEHOLDERS)}) THEN CASE WHEN field_name IN ({_strings(E.VERIFICATION_FIELDS)}) AND upper(field_value) = 'UNAVAILABLE' THEN 'verification result is unavailable' ELSE 'field_value is a placeholder' END END,
   CASE WHEN upper(trim(verification_status)) IN ({_strings(E.REJECTED)}) THEN 'verification_status is rejected' END], lambda x: x IS NOT NULL) AS errs FROM evidence)
SELECT investigation_id, ev_seq, array_to_string(errs, '; ') AS errors, len(errs) = 0 AS is_valid FROM e""",
    "p14_unverified": f"{ctes('evidence')} SELECT investigation_id, ev_seq, field_name, field_value FROM evidence WHERE confidence < 0.5 AND {_VALUE} NOT IN ({_strings(R.NO_VALUE)})",
    "s8_upsert_evidence": f"""{ctes("evidence")}, r AS (SELECT *, lower(trim(source_name)) AS k FROM evidence), w AS (SELECT *, row_number() OVER (PARTITION BY investigation_id, field_name, k, research_result_id ORDER BY retrieved_at DESC, ev_seq DESC) AS newest,
   first_value(verification_status) OVER (PARTITION BY investigation_id, field_name, k, research_result_id ORDER BY retrieved_at DESC, ev_seq) AS st, first_value(source_name) OVER (PARTITION BY investigation_id, field_name, k, research_result_id ORDER BY ev_seq) AS src,
   min(ev_seq) OVER (PARTITION BY investigation_id, field_name, k, research_result_id) AS seq FROM r)
SELECT investigation_id, research_result_id, task_id, field_name, field_value, src AS source_name, confidence, st AS verification_status, retrieved_at, seq AS ev_seq FROM w WHERE newest = 1""",
    "f13_fresh": f"{ctes('evidence')}{_FRESH_EV} SELECT investigation_id, ev_seq, field_name FROM fresh",
    "j7_cached_results": f"{ctes('evidence', 'research_tasks')}{_CACHED} SELECT * FROM cached",
    "j8_split_cached": f"{ctes('evidence', 'research_tasks')}{_CACHED} SELECT investigation_id, task_id, bool_and(found) AS reusable FROM cached GROUP BY ALL",
    "w2_latest_evidence": f"{ctes('evidence')} SELECT investigation_id, field_name, field_value, ev_seq FROM evidence QUALIFY row_number() OVER (PARTITION BY investigation_id, field_name ORDER BY retrieved_at DESC, ev_seq DESC) = 1",
    "j1_exact_matches": f"{ctes('targets', 'candidates')}{_PAIRS.split(', ' + chr(10))[0].split('  p AS')[0].rstrip().rstrip(',')} SELECT DISTINCT target_id, candidate_id FROM t JOIN c ON t_gstin = c_gstin OR t_website = c_website",
    "j2_identifier_conflicts": f"{ctes('targets', 'candidates')}{_PAIRS} SELECT target_id, candidate_id, 'gstin' AS field, t_gstin AS target_value, c_gstin AS candidate_value FROM p WHERE t_gstin <> c_gstin",
    "j4_score_pairs": f"{ctes('targets', 'candidates')}{_PAIRS} SELECT target_id, candidate_id, score, exact, conflict FROM scored",
    "j5_resolve": f"""{ctes("targets", "candidates")}{_PAIRS}, b AS (SELECT *, row_number() OVER (PARTITION BY target_id ORDER BY score DESC, candidate_id) AS r, min(CASE WHEN exact AND NOT conflict THEN candidate_id END) OVER (PARTITION BY target_id) AS hit, count(*) FILTER (conflict) OVER (PARTITION BY target_id) AS n_conflicts FROM scored),
  k AS (SELECT s.target_id, b.candidate_id AS best, score, hit, coalesce(n_conflicts, 0) AS n_conflicts, CASE WHEN b.target_id IS NULL THEN 'NO_MATCH' WHEN hit IS NOT NULL THEN 'EXACT' WHEN score >= 0.75 AND NOT supported AND one_token THEN 'INSUFFICIENT_IDENTITY' WHEN score >= 0.75 THEN 'SIMILARITY' WHEN n_conflicts > 0 THEN 'CONFLICTING_IDENTITY' ELSE 'NO_MATCH' END AS match_type
    FROM targets s LEFT JOIN (SELECT * FROM b WHERE r = 1) b ON s.target_id = b.target_id)
SELECT target_id, match_type, CASE WHEN match_type = 'EXACT' THEN 1.0 WHEN best IS NULL OR match_type = 'CONFLICTING_IDENTITY' THEN 0.0 ELSE score END AS confidence, CASE WHEN match_type = 'EXACT' THEN hit WHEN match_type IN ('SIMILARITY', 'NO_MATCH') THEN best END AS candidate_id, match_type IN ('EXACT', 'SIMILARITY') AS matched, CASE WHEN best IS NOT NULL THEN CASE match_type {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in L.REASONS.items())} END END AS reason, n_conflicts FROM k""",
    "a4_source_status": f"{ctes('evidence')}{_STATUS} SELECT * FROM status",
    "a5_attempt_rollup": f"{ctes('attempts')} SELECT investigation_id, domain, arg_min(status, (-({_RANK}), attempt_id)) AS status, count(*) AS attempts FROM attempts GROUP BY 1, 2",
    "a6_consistency": f"""{ctes("evidence")}, l AS (SELECT investigation_id, field_name AS field_key, source_name, arg_max(trim(field_value), ev_seq) AS v, min(ev_seq) AS first_seq FROM evidence
    WHERE field_name IN ({_strings(R.CONSISTENCY_FIELDS)}) AND confidence >= 0.5 AND {_VALUE} NOT IN ({_strings(R.NO_VALUE)}) GROUP BY 1, 2, 3),
  o AS (SELECT *, first_value(upper(v)) OVER (PARTITION BY investigation_id, field_key ORDER BY first_seq) AS f FROM l),
  x AS (SELECT *, {_WORDS("f")} AS a, {_WORDS("v")} AS b FROM o)
SELECT investigation_id, field_key, CASE WHEN field_key LIKE '%address' THEN CASE WHEN count(DISTINCT {X.sql_norm_address("v")}) = 1 THEN 'MATCH' ELSE 'CONFLICT' END WHEN count(DISTINCT upper(v)) = 1 THEN 'MATCH'
   WHEN bool_or(upper(v) <> f AND len(a) > 0 AND len(b) > 0 AND len(list_intersect(a, b)) / CAST(len(list_distinct(list_concat(a, b))) AS DOUBLE) >= 0.4) THEN 'PARTIAL_MATCH' ELSE 'CONFLICT' END AS status, count(*) AS n_sources FROM x GROUP BY 1, 2""",
    "a10_attempt_counters": f"""{ctes("attempts")}, g AS (SELECT investigation_id, count(*) AS total, count(*) FILTER (status = 'SUCCESS') AS success, count(*) FILTER (status IN ('BLOCKED', 'BLOCKED_OR_ERROR', 'CAPTCHA_REQUIRED')) AS blocked,
   count(*) FILTER (status IN ('REJECTED', 'IRRELEVANT', 'IRRELEVANT_CONTENT', 'IRRELEVANT_SECTOR')) AS irrelevant, arg_min(domain, attempt_id) FILTER (status = 'SUCCESS') AS selected, bool_or(domain NOT IN ('gst.gov.in', 'mca.gov.in')) AS fallback_used FROM attempts GROUP BY 1) SELECT *, total - success - blocked - irrelevant AS failed FROM g""",
    "a12_primary_source": f"{ctes('evidence')} SELECT investigation_id, trim(source_name) AS primary_source FROM evidence WHERE confidence >= 0.5 AND {_VALUE} NOT IN ({_strings(R.UNUSABLE)}) QUALIFY row_number() OVER (PARTITION BY investigation_id ORDER BY CASE "
    + " ".join("WHEN " + " OR ".join(f"contains(lower(source_name), '{w}')" for w in g) + f" THEN {k}" for k, g in enumerate(R.AUTHORITY)) + f" ELSE {len(R.AUTHORITY)} END, confidence DESC, lower(source_name), ev_seq) = 1",
    "j19_reconcile_attempts": f"""{ctes("attempts", "evidence")}, s AS (SELECT DISTINCT investigation_id, lower(trim(source_name)) AS cat FROM evidence WHERE confidence > 0 AND trim(source_name) <> '' AND {_VALUE} NOT IN ({_strings(R.UNUSABLE)})),
  a AS (SELECT *, lower(trim(source_name)) AS cat FROM attempts)
SELECT attempt_id, CASE WHEN status = 'SUCCESS' AND s.cat IS NULL THEN 'NO_DATA' ELSE status END AS final_status, status = 'SUCCESS' AND s.cat IS NOT NULL AS selected FROM a LEFT JOIN s ON a.investigation_id = s.investigation_id AND a.cat = s.cat""",
    "j20_source_limitations": f"{ctes('evidence', 'attempts')}{_STATUS} SELECT investigation_id, CASE category " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in R.LABELS.items()) + f" END AS source, status FROM status WHERE status IN ({_strings(R.LIMITATIONS)}) AND (investigation_id, category) IN (SELECT investigation_id, {_DOMAIN} FROM attempts)",
    "j16_contradicted_findings": f"{ctes('evidence')}{_SIGNALS} SELECT s.investigation_id, code, e.research_result_id FROM signals s JOIN evidence e ON s.investigation_id = e.investigation_id WHERE code = 'GST_INACTIVE' AND field_name = 'gst_status' AND contains(lower(field_value), 'active') AND NOT contains(lower(field_value), 'inactive')",
    "j14_grounding": f"""{ctes("investigations", "evidence")}{_SIGNALS}, kept AS (SELECT * FROM evidence WHERE investigation_id IN (SELECT investigation_id FROM investigations WHERE status = 'COMPLETED')), x AS (SELECT investigation_id, code, unnest(string_split(evidence_ids, ',')) AS evidence_id FROM signals)
SELECT *, CASE WHEN (investigation_id, evidence_id) IN (SELECT investigation_id, research_result_id FROM kept) THEN NULL WHEN evidence_id IN (SELECT research_result_id FROM kept) THEN 'OTHER_INVESTIGATION' ELSE 'NON_EXISTENT' END AS problem FROM x""",
    "p5_incomplete": f"{ctes('investigations')} SELECT investigation_id, user_id, status FROM investigations WHERE completed_timestamp IS NULL AND status NOT IN ('COMPLETED', 'FAILED')",
    "p4_list_investigations": f"{ctes('investigations')} SELECT investigation_id, user_id, status FROM investigations WHERE user_id = 'user-7' AND status = 'COMPLETED'",
    "a9_history": f"""{ctes("investigations", "evidence", "audit_events", "research_tasks")}, e AS (SELECT investigation_id, count(*) AS n, count(DISTINCT field_name) AS f, string_agg(research_result_id, ',' ORDER BY ev_seq) AS ids FROM evidence GROUP BY 1),
  t AS (SELECT investigation_id, string_agg(concat_ws('|', task_id, task_type, target, objective, status), ';' ORDER BY seq) AS tasks, CAST(max(seq) AS INT) AS version FROM research_tasks GROUP BY 1), a AS (SELECT investigation_id, count(*) AS n FROM audit_events GROUP BY 1)
SELECT i.investigation_id, status, coalesce(e.n, 0) AS n_evidence, coalesce(e.f, 0) AS n_fields, coalesce(a.n, 0) AS n_events, e.ids AS evidence_ids, t.tasks, t.version AS latest_version FROM investigations i LEFT JOIN t ON i.investigation_id = t.investigation_id LEFT JOIN e ON i.investigation_id = e.investigation_id LEFT JOIN a ON i.investigation_id = a.investigation_id""",
    "t4_latest_status": f"{ctes('audit_events')} SELECT investigation_id, node, event_type FROM audit_events QUALIFY row_number() OVER (PARTITION BY investigation_id ORDER BY created_at DESC, event_id DESC) = 1",
    "x1_page_text": f"{_TEXTS} SELECT * FROM texts",
    "x6_identifiers": f"{_TEXTS} SELECT page_id, " + ", ".join(f"coalesce(nullif(replace(regexp_extract(text, '{p}', 1), ' ', ''), ''), 'NOT_FOUND') AS {k}" for k, p in P.IDENTIFIERS.items()) + " FROM texts",
    "x17_link_table": """WITH l AS (SELECT page_id, regexp_extract_all(coalesce(html, ''), 'href=["'']([^"'']+)["'']', 1, 'i') AS links FROM pages), u AS (SELECT page_id, links, unnest(range(1, len(links) + 1)) AS k FROM l),
  f AS (SELECT page_id, links[k] AS link, min(k) AS k FROM u GROUP BY 1, 2) SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY k) - 1 AS INTEGER) AS pos, link FROM f""",
    "x1_neutralize_documents": f"SELECT doc_id, md5({_NEUTRAL('text')}) AS text_md5 FROM documents",
}


def oracle_sql() -> dict[str, str]:
    planned = planning.oracles(_TEXTS, _PLAIN, _SIGNALS, _LEVEL)
    planned |= {"j9_route_all_sources": planned["j9_route_sources"], "s16_apply_all_task_status": planned["s16_apply_task_status"]}
    more = cases.oracles(ORACLES, _SIGNALS, _LEVEL, _STATUS, _TASKS.format(first="arg_min"), planned["f14_address_values"], _TEXTS, _RANK)
    return {**ORACLES, **planned, **identity.oracles(_TEXTS, _PLAIN, planned["x2_page_challenge"]), **extract.oracles(_TEXTS), **links.oracles(planned["x2_page_challenge"], _TEXTS, planned["x7_9_page_facts"], ORACLES["x6_identifiers"]), **more, **corpus.oracles(_PAIRS, ORACLES["j5_resolve"]), **election.oracles(_TEXTS, _PLAIN, planned["x2_page_challenge"], planned["x7_9_page_facts"], ORACLES["x6_identifiers"]), **streams.oracles(ORACLES["s8_upsert_evidence"]), **rules.oracles(_SIGNALS), **timing.oracles(_TASKS.format(first="arg_min"), _KEY, _FRESH)}
