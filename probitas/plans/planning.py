"""Queries on planning, tasks, page checks and exports, and their SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from probitas.cluster import stage_by
from probitas.operators import pages as P
from probitas.operators import planning as N
from probitas.operators import report as R
from probitas.operators import risk as K
from probitas.sources import catalog as C
from probitas.sources.views import by_investigation, ctes, dealt_tasks, view


def _html(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/pages.parquet")


def _existing(spark: SparkSession, sf: str) -> DataFrame:
    """Searches at the EPFO portal that every third investigation has had."""
    d = view(spark, sf, "intake").filter("investigation_id % 3 = 0 and business_name <> ''")
    return d.select("investigation_id", F.lit(C.EPFO).alias("task_type"), F.expr("' ' || upper(business_name) || ' EPFO establishment'").alias("target"), F.array(F.lit("epfindia.gov.in")).alias("preferred_sources"))


def _tasks(spark: SparkSession, sf: str) -> DataFrame:
    return N.plan_tasks(view(spark, sf, "intake"), view(spark, sf, "evidence"), _existing(spark, sf), C.source_catalog(spark))


def _plan(spark: SparkSession, sf: str) -> DataFrame:
    d = _tasks(spark, sf)
    return d.withColumns({c: F.array_join(c, ",") for c in ("required_fields", "preferred", "fallback")})


def _store(spark: SparkSession, sf: str) -> DataFrame:
    """The first of like tasks among an investigation's first three."""
    w = Window.partitionBy("investigation_id", F.upper(F.trim("task_type")), F.lower(F.trim("target"))).orderBy("seq")
    d = view(spark, sf, "research_tasks").filter("seq <= 3").withColumn("_n", F.row_number().over(w)).filter("_n = 1")
    started, done = F.when(F.col("status") != "PENDING", F.col("changed_at")), F.when(F.col("status").isin(*N.RAN), F.col("changed_at"))
    return d.select("investigation_id", "task_id", "task_type", "target", "objective", "status", F.lit(0).alias("retry_count"), started.alias("started_at"), done.alias("completed_at"))


def _batch(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "research_tasks").filter("seq > 3")


def _every_task(spark: SparkSession, sf: str) -> DataFrame:
    """One row for each task of an investigation, as it was first stored."""
    w = Window.partitionBy("investigation_id", "task_id").orderBy("seq")
    d = view(spark, sf, "research_tasks").withColumn("_n", F.row_number().over(w)).filter("_n = 1")
    started, done = F.when(F.col("status") != "PENDING", F.col("changed_at")), F.when(F.col("status").isin(*N.RAN), F.col("changed_at"))
    return d.select("investigation_id", "task_id", "task_type", "target", "objective", "status", F.lit(0).alias("retry_count"), started.alias("started_at"), done.alias("completed_at"))


def _routes(spark: SparkSession, tasks: DataFrame) -> DataFrame:
    d = tasks.select("investigation_id", "seq", F.upper(F.trim("task_type")).alias("task_type"))
    return N.route_sources(d, C.source_catalog(spark)).withColumns({c: F.array_join(c, ",") for c in ("preferred", "fallback")})


def _changes(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "research_tasks").selectExpr("investigation_id", "task_id", "seq", "changed_at", "status", "CASE WHEN seq % 2 = 0 THEN 'timeout' ELSE '' END AS error", "CASE WHEN seq % 3 = 0 THEN target END AS result")


def _leaks(spark: SparkSession, sf: str) -> DataFrame:
    kind = "CASE ev_seq % 3 WHEN 0 THEN 'GST_VERIFICATION' WHEN 1 THEN 'THIRD_PARTY_RESEARCH' ELSE 'WEBSITE_VERIFICATION' END AS task_type"
    field = "CASE ev_seq % 4 WHEN 0 THEN 'legal_name' ELSE field_name END AS field_name"
    return view(spark, sf, "evidence").selectExpr("investigation_id", "ev_seq", kind, "CASE ev_seq % 2 WHEN 0 THEN 'alpha foods ' ELSE '27ABCDE1234F1Z5' END AS target", field, "field_value")


def _sections(spark: SparkSession, sf: str) -> DataFrame:
    ev = by_investigation(spark, sf)
    profile = stage_by(K.risk_profile(ev), "investigation_id", dealt_tasks(spark, sf), "risk")  # read by scores, categories and findings
    signals = K.attach_rules(K.exploded(profile))
    d = R.export_report_sections(view(spark, sf, "intake"), K.scores_of(view(spark, sf, "investigations"), profile), K.category_scores(signals), signals, ev)
    return d.withColumn("cells", F.array_join("cells", "|"))


def _proposals(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "evidence").filter("field_name IN ('legal_name', 'trade_name', 'company_name')").selectExpr("investigation_id", "ev_seq AS pos", "field_value AS name", "CAST(NULL AS STRING) AS gstin", "CAST(NULL AS STRING) AS cin", "confidence")


QUERIES = {
    "u3_discovered_identifiers": lambda s, d: N.discovered_identifiers(view(s, d, "evidence")),
    "u1_plan_tasks": _plan,
    "u4_seed_candidates": lambda s, d: N.seed_candidates(view(s, d, "intake")),
    "u6_merge_candidates": lambda s, d: N.merge_candidates(N.seed_candidates(view(s, d, "intake")), _proposals(s, d)),
    "j9_route_sources": lambda s, d: _routes(s, view(s, d, "research_tasks")),
    "j9_route_all_sources": lambda s, d: _routes(s, view(s, d, "research_tasks")),  # the name of before, when j9 took a part
    "w11_admit": lambda s, d: N.admit(view(s, d, "attempts").withColumn("actions", F.col("attempt_id") % 3), "attempt_id").select("attempt_id", "reason"),
    "x16_fetch_frontier": lambda s, d: N.fetch_frontier(_tasks(s, d), C.source_catalog(s)),
    "x18_search_terms": lambda s, d: N.search_terms(_tasks(s, d)).select("investigation_id", "task_id", "terms"),
    "s9_upsert_tasks": lambda s, d: N.upsert_tasks(_store(s, d), _batch(s, d)),
    "s16_apply_task_status": lambda s, d: N.apply_task_status(_every_task(s, d), _changes(s, d)),
    "s16_apply_all_task_status": lambda s, d: N.apply_task_status(_every_task(s, d), _changes(s, d)),  # likewise
    "s14_export_sections": _sections,
    "x2_page_challenge": lambda s, d: P.page_challenge(_html(s, d)),
    "x7_9_page_facts": lambda s, d: P.page_facts(P.page_text(_html(s, d))),
    "x7_9_document_facts": lambda s, d: P.page_facts(s.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").alias("page_id"), "text")),
    "f14_address_values": lambda s, d: view(s, d, "evidence").filter(P.is_address_like(F.col("field_value"))).select("investigation_id", "ev_seq"),
    "p15_guard_leaks": lambda s, d: P.guard_leaks(_leaks(s, d)),
}


# The same in SQL.


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _in(words) -> str:
    return "(" + ", ".join(map(_q, words)) + ")"


def _has(c: str, words) -> str:
    return "(" + " OR ".join(f"contains({c}, {_q(w)})" for w in words) + ")"


def _fits(c: str, patterns) -> str:
    return "(" + " OR ".join(f"regexp_matches({c}, {_q(p)})" for p in patterns) + ")"


_NONE = _in(N.NO_OFFER)
_FOUND = f"""offers AS (
    SELECT investigation_id, ev_seq, 0.0 AS o, 0 AS i, CASE {" ".join(f"WHEN field_name IN {_in(f)} THEN '{k}'" for k, f in N.OFFERS.items())} END AS kind, trim(field_value) AS v FROM evidence WHERE trim(field_value) <> '' AND upper(trim(field_value)) NOT IN {_NONE}
    UNION ALL SELECT investigation_id, ev_seq, -coalesce(c.confidence, 0), i, unnest(['gstin', 'cin', 'epfo_code', 'website', 'name']), unnest([c.gstin, c.cin, c.epfo_code, c.website, c.name])
    FROM (SELECT investigation_id, ev_seq, unnest(l) AS c, generate_subscripts(l, 1) AS i FROM (SELECT *, from_json(field_value, '[{{"name":"VARCHAR","gstin":"VARCHAR","cin":"VARCHAR","epfo_code":"VARCHAR","website":"VARCHAR","confidence":"DOUBLE"}}]') AS l FROM evidence WHERE field_name = 'candidate_entities'))),
  found AS (SELECT e.investigation_id, {", ".join(f"arg_min(v, (ev_seq, o, i)) FILTER (kind = '{k}' AND v <> '') AS {k}" for k in N.OFFERS)} FROM (SELECT investigation_id FROM evidence GROUP BY 1) e LEFT JOIN offers USING (investigation_id) GROUP BY 1)"""
_TARGETS = f"""{_FOUND}, tg AS (SELECT i.investigation_id, {", ".join(f"coalesce(nullif(i.{k}, ''), f.{k}) AS {k}" for k in N.OFFERS if k != "name")}, coalesce(f.name, nullif(business_name, '')) AS name, nullif(location, '') AS location FROM intake i LEFT JOIN found f ON i.investigation_id = f.investigation_id)"""
_CATALOG = "cat(name, label, tier, priority, task_types) AS (VALUES " + ", ".join(f"({_q(s[0])}, {_q(s[1])}, {s[3]}, {s[4]}, [{', '.join(map(_q, s[6]))}])" for s in C.SOURCES) + ")"
_SITES = ", ".join("(" + ", ".join("NULL" if v is None else _q(v) for v in (s[0], s[2], s[7], *C.URLS.get(s[0], (None,) * 5))) + f", [{', '.join(map(_q, s[6]))}])" for s in C.SOURCES)
_ROUTES = f"""{_CATALOG}, typed AS (SELECT *, unnest(task_types) AS task_type FROM cat), byt AS (SELECT task_type, list(name ORDER BY priority, tier, name) AS l FROM typed GROUP BY 1)"""


def _fill(template: str, c: str) -> str:
    return f"replace({_q(template)}, '{{}}', {c})"


def _planned() -> str:
    parts = []
    for pos, (kind, key, with_id, search, without, fields, priority) in enumerate(N.VERIFY):
        parts.append(f"SELECT investigation_id, {pos} AS pos, '' AS route, '{kind}' AS task_type, coalesce({key}, {_fill(search, 'name')}) AS target, coalesce({_fill(with_id, key)}, {_fill(without, 'name')}) AS objective, '{','.join(fields)}' AS required_fields, {priority} AS priority, l[1] AS preferred, array_to_string(l[2:], ',') AS fallback FROM tg JOIN byt ON task_type = '{kind}'")
    third = "name || coalesce(' ' || cin, '') || coalesce(' ' || gstin, '')"
    parts.append(f"SELECT investigation_id, 4, printf('%05d %05d %s', c.priority, tier, c.name), '{C.THIRD}', {third.replace('name', 'tg.name', 1)}, replace(replace({_q(N.DIRECTORY[0])}, '{{label}}', label), '{{target}}', {third.replace('name', 'tg.name', 1)}), '{','.join(N.DIRECTORY[1])}', {N.DIRECTORY[2]}, c.name, '' FROM tg JOIN cat c ON list_contains(task_types, '{C.THIRD}') AND c.name NOT IN {_in(C.NO_DIRECTORY)} WHERE tg.name IS NOT NULL")
    wide = "coalesce(name || ' in ' || location, name)"
    known = "coalesce(gstin, cin, epfo_code) IS NOT NULL"
    for kind, (objective, fields, priority), test in ((C.GENERAL, N.GENERALLY, known), (C.DISCOVERY, N.DISCOVER, f"NOT ({known})")):
        parts.append(f"SELECT investigation_id, 5, '', '{kind}', {wide}, {_fill(objective, wide)}, '{','.join(fields)}', {priority}, l[1], array_to_string(l[2:], ',') FROM tg JOIN byt ON task_type = '{kind}' WHERE {test}")
    return " UNION ALL ".join(parts)


_SEED = """seed AS (SELECT investigation_id, business_name AS name, gstin, cin, website, location, CASE WHEN coalesce(gstin, '') <> '' OR coalesce(cin, '') <> '' THEN 0.95 WHEN business_name <> '' AND website <> '' AND location <> '' THEN 0.8 WHEN business_name <> '' AND (website <> '' OR location <> '') THEN 0.7
  WHEN business_name <> '' THEN 0.5 WHEN website <> '' OR location <> '' THEN 0.3 END::DOUBLE AS confidence FROM intake)"""
_TASK_KEY = "investigation_id, upper(trim(task_type)) AS k1, lower(trim(target)) AS k2, lower(trim(objective)) AS k3"
_STORE = """store AS (SELECT *, CASE WHEN status <> 'PENDING' THEN changed_at END AS started_at, CASE WHEN status IN ('COMPLETED', 'FAILED') THEN changed_at END AS completed_at FROM research_tasks WHERE seq <= 3 QUALIFY row_number() OVER (PARTITION BY investigation_id, upper(trim(task_type)), lower(trim(target)) ORDER BY seq) = 1)"""
_TITLE = "lower(regexp_extract(html, '<title[^>]*>(.*?)</title>', 1, 'is'))"
_LOGIN = [rf"\b{w}\b" for w in P.LOGIN]
_CHALLENGE = f"CASE WHEN {_has(_TITLE, P.CAPTCHA_TITLES)} OR {_has('lower(html)', P.CAPTCHA)} THEN 'CAPTCHA' WHEN {_fits('lower(html)', P.OTP)} THEN 'OTP' WHEN {_fits('lower(html)', _LOGIN)} THEN 'LOGIN_REQUIRED' END"


def _first(found: str, lines: str = "lines") -> str:
    return f"coalesce(list_filter(list_transform({lines}, lambda x: {found}), lambda x: x IS NOT NULL)[1], 'NOT_FOUND')"


_NAMED = "CASE " + " ".join(f"WHEN {_fits('lower(x)', [rf'\b{w}\b' for w in words])} THEN '{s}'" for s, words in P.STATUSES) + " END"
_WORD = "CASE " + " ".join(f"WHEN contains(lower(x), '{w}') THEN '{w.upper()}'" for w in P.STATUS_WORDS) + " END"
_GST_ASK = f"({_has('lower(x)', ('status', 'active', 'suspended', 'cancelled', 'inactive'))} AND contains(lower(x), 'gst') AND NOT {_has('lower(x)', ('company status', 'mca status', 'director status'))})"
_GST_SAID = _first(f"CASE WHEN {_GST_ASK} AND contains(lower(x), 'active') THEN 'AVAILABLE' WHEN {_GST_ASK} AND {_has('lower(x)', P.STATUS_WORDS)} THEN 'UNAVAILABLE' END")
_SPOKEN = _first(f"CASE WHEN contains(lower(x), 'status') THEN {_WORD} END")
_FACTS = f"""SELECT page_id, {_first(f"CASE WHEN contains(lower(x), 'status') THEN {_NAMED} END")} AS strict_status, CASE WHEN {_SPOKEN} <> 'NOT_FOUND' THEN {_SPOKEN} ELSE {_first(_WORD)} END AS company_status,
  CASE WHEN {_GST_SAID} <> 'NOT_FOUND' THEN {_GST_SAID} WHEN len(list_filter(lines, lambda x: contains(lower(x), 'gst') AND contains(lower(x), 'active'))) > 0 THEN 'AVAILABLE' ELSE 'UNAVAILABLE' END AS gst_status,
  {_first(f"CASE WHEN {_has('lower(x)', P.FOUNDED)} THEN coalesce(nullif(regexp_extract(x, {_q(P.YEAR)}, 1), ''), nullif(regexp_extract(x, {_q(P.DAY)}), '')) END")} AS founded"""


def oracles(texts: str, plain: str, signals: str, level: str) -> dict[str, str]:
    """The statements; texts, plain, signals and level are CTEs and expressions of the other queries."""
    own = " OR ".join(f"(task_type = '{t}' AND field_name IN {_in(f)})" for t, f in P.OWN_TARGET.items())
    shaped = " OR ".join(f"(regexp_full_match(upper(trim(field_value)), {_q(P.IDENTIFIERS[k][2:-2])}) AND field_name NOT IN {_in((k, *P.ANY_SHAPE))})" for k in ("gstin", "cin"))
    none, high, moderate, low = R.RECOMMENDATIONS
    advice = f"CASE WHEN score IS NULL THEN '{none}' WHEN score >= 61 THEN '{high}' WHEN score >= 31 THEN '{moderate}' ELSE '{low}' END"
    text = lambda c: f"coalesce(CAST({c} AS VARCHAR), '')"
    known = lambda c: f"coalesce(nullif({c}, ''), 'N/A')"
    entity = [f"SELECT s.investigation_id, 1 AS section_no, {k} AS line_no, '{label}|' || {known(c)} AS cells FROM scores s LEFT JOIN intake i ON s.investigation_id = i.investigation_id" for k, (label, c) in enumerate((("Business Name", "business_name"), ("GSTIN", "gstin"), ("CIN", "cin"), ("Website", "website")))]
    summary = [f"SELECT investigation_id, 2, {k}, '{label}|' || {v} FROM scores" for k, (label, v) in enumerate((("Overall Risk Score", text("coalesce(score, 0)")), ("Overall Risk Level", "coalesce(level, 'UNKNOWN')"), ("Recommendation", advice)))]
    category = ["SELECT investigation_id, 3, 0, 'Category|Score' FROM scores", *(f"SELECT s.investigation_id, 3, {k + 1}, '{c}|' || CAST(least(coalesce(sum(CASE WHEN lower(category) = '{c}' THEN risk_weight END), 0), 100) AS VARCHAR) FROM scores s LEFT JOIN signals g ON s.investigation_id = g.investigation_id GROUP BY 1" for k, c in enumerate(K.CATEGORIES))]
    findings = ["SELECT investigation_id, 4, 0, 'Code|Category|Severity|Confidence|Risk Weight|Evidence IDs' FROM scores", f"SELECT investigation_id, 4, row_number() OVER (PARTITION BY investigation_id ORDER BY code), concat_ws('|', code, category, severity, {text('confidence')}, {text('risk_weight')}, replace(evidence_ids, ',', ', ')) FROM signals WHERE investigation_id IN (SELECT investigation_id FROM scores)"]
    rows = ["SELECT investigation_id, 5, 0, 'Evidence ID|Task ID|Field Name|Source Name|Confidence' FROM scores", f"SELECT investigation_id, 5, row_number() OVER (PARTITION BY investigation_id ORDER BY ev_seq), concat_ws('|', research_result_id, task_id, field_name, source_name, {text('confidence')}) FROM evidence WHERE investigation_id IN (SELECT investigation_id FROM scores)"]
    plan = f"""{ctes("evidence", "intake")}, {_TARGETS}, {_ROUTES}, made AS ({_planned()}), existing AS (SELECT investigation_id, lower(business_name) || ' epfo establishment' AS t FROM intake WHERE investigation_id % 3 = 0 AND business_name <> ''),
  fresh AS (SELECT * FROM made WHERE target <> '' AND NOT (task_type = '{C.EPFO}' AND (investigation_id, lower(target)) IN (SELECT investigation_id, t FROM existing))),
  planned AS (SELECT f.investigation_id, 'TASK-' || lpad(CAST(row_number() OVER (PARTITION BY f.investigation_id ORDER BY pos, route) + (CASE WHEN e.t IS NULL THEN 0 ELSE 1 END) AS VARCHAR), 3, '0') AS task_id, task_type, target, objective, required_fields, priority, preferred, fallback FROM fresh f LEFT JOIN existing e ON f.investigation_id = e.investigation_id)"""
    return {
        "u3_discovered_identifiers": f"{ctes('evidence')}, {_FOUND} SELECT * FROM found",
        "u1_plan_tasks": f"{plan} SELECT * FROM planned",
        "x16_fetch_frontier": f"""{plan}, src(source, kind, base_url, cin_name_url, name_url, cin_url, gstin_url, search_url, task_types) AS (VALUES {_SITES}),
  a AS (SELECT *, nullif(regexp_extract(upper(trim(target)), {_q(P.IDENTIFIERS["cin"])}, 1), '') AS cin, nullif(regexp_extract(upper(trim(target)), {_q(P.IDENTIFIERS["gstin"])}, 1), '') AS gstin,
    starts_with(target, 'http://') OR starts_with(target, 'https://') OR (contains(target, '.') AND NOT contains(target, ' ') AND (contains(target, '/') OR regexp_matches(target, {_q(N.DOMAIN_ENDS)}))) AS direct FROM planned),
  b AS (SELECT *, nullif(lower(regexp_replace(regexp_replace(target, {_q(N.SITE_WORDS)}, '', 'g'), '[^a-zA-Z0-9]', '', 'g')), '') AS site,
    nullif(lower(trim(regexp_replace(trim(regexp_replace(regexp_replace(replace(replace(target, coalesce(gstin, '#'), ''), coalesce(cin, '#'), ''), {_q(N.SLUG_WORDS)}, '', 'g'), '[^a-zA-Z0-9\\s-]', '', 'g')), '\\s+', '-', 'g'), '-')), '') AS slug,
    CASE WHEN contains(target, '://') THEN target ELSE 'https://' || target END AS whole FROM a),
  u AS (SELECT b.*, source, CASE WHEN kind = 'OFFICIAL_WEBSITE' OR b.task_type = '{C.WEBSITE}' THEN CASE WHEN direct THEN [whole] ELSE ['https://www.' || site || '.com', 'https://' || site || '.com', 'https://www.' || site || '.in'] END
    WHEN kind = 'GOVERNMENT' THEN [base_url] WHEN direct THEN [whole] ELSE [replace(replace(cin_name_url, '{{slug}}', slug), '{{cin}}', cin), replace(name_url, '{{slug}}', slug), replace(cin_url, '{{cin}}', cin), replace(gstin_url, '{{gstin}}', gstin),
      replace(search_url, '{{query}}', coalesce(cin, slug, target)), base_url || '/company/' || slug, base_url || '/company/' || cin, base_url] END AS urls FROM b JOIN src ON list_contains(task_types, b.task_type)),
  x AS (SELECT investigation_id, task_id, source, unnest(urls) AS url, generate_subscripts(urls, 1) AS k FROM u), y AS (SELECT investigation_id, task_id, source, url, min(k) AS k FROM x WHERE url IS NOT NULL GROUP BY ALL)
SELECT investigation_id, task_id, source, CAST(row_number() OVER (PARTITION BY investigation_id, task_id, source ORDER BY k) - 1 AS INTEGER) AS pos, url FROM y""",
        "x18_search_terms": f"""{plan}, a AS (SELECT *, nullif(regexp_extract(target, {_q(P.IDENTIFIERS["cin"])}, 1), '') AS cin, nullif(regexp_extract(target, {_q(P.IDENTIFIERS["gstin"])}, 1), '') AS gstin FROM planned),
  b AS (SELECT *, trim(regexp_replace(replace(replace(target, coalesce(gstin, '#'), ''), coalesce(cin, '#'), ''), {_q(N.TERM_WORDS)}, '', 'g')) AS n FROM a)
SELECT investigation_id, task_id, CASE task_type WHEN '{C.GST}' THEN coalesce('"' || gstin || '"', '"' || n || '" "GST" status') WHEN '{C.MCA}' THEN coalesce('"' || cin || '"', '"' || n || '" "MCA" "company master data"') WHEN '{C.EPFO}' THEN '"' || n || '" "EPFO" establishment'
  WHEN '{C.WEBSITE}' THEN CASE WHEN regexp_matches(target, {_q(N.WEB_ADDRESS)}) THEN target ELSE '"' || n || '" official website' END ELSE '"' || coalesce(nullif(n, ''), target) || '"' END AS terms FROM b""",
        "u4_seed_candidates": f"{ctes('intake')}, {_SEED} SELECT * FROM seed WHERE confidence IS NOT NULL",
        "u6_merge_candidates": f"""{ctes("intake", "evidence")}, {_SEED}, base AS (SELECT * FROM seed WHERE confidence IS NOT NULL), extra AS (SELECT investigation_id, trim(field_value) AS name, confidence FROM evidence WHERE field_name IN ('legal_name', 'trade_name', 'company_name') AND trim(field_value) <> ''
   QUALIFY row_number() OVER (PARTITION BY investigation_id, lower(trim(field_value)) ORDER BY ev_seq) = 1)
SELECT *, 'intake' AS source FROM base UNION ALL SELECT x.investigation_id, x.name, NULL, NULL, NULL, NULL, least(x.confidence, CAST(0.9 AS DOUBLE)), 'proposal' FROM extra x JOIN base b ON x.investigation_id = b.investigation_id WHERE lower(trim(coalesce(b.name, ''))) <> lower(x.name)""",
        "j9_route_sources": f"{ctes('research_tasks')}, {_ROUTES} SELECT investigation_id, seq, b.task_type, l[1] AS preferred, array_to_string(l[2:], ',') AS fallback FROM research_tasks t JOIN byt b ON upper(trim(t.task_type)) = b.task_type",
        "w11_admit": f"{ctes('attempts')} SELECT attempt_id, CASE WHEN count(*) OVER w > 15 THEN '{N.TASKS_REASON}' WHEN sum(attempt_id % 3) OVER w > 20 THEN '{N.ACTIONS_REASON}' END AS reason FROM attempts WINDOW w AS (PARTITION BY investigation_id ORDER BY attempt_id ROWS UNBOUNDED PRECEDING)",
        "s9_upsert_tasks": f"""{ctes("research_tasks")}, {_STORE}, allr AS (SELECT {_TASK_KEY}, task_id, task_type, target, objective, status, started_at, completed_at, FALSE AS fresh, seq FROM store UNION ALL SELECT {_TASK_KEY}, task_id, task_type, target, objective, status, NULL, NULL, TRUE, seq FROM research_tasks WHERE seq > 3),
  s AS (SELECT *, lag(status) OVER w AS was, row_number() OVER (PARTITION BY investigation_id, k1, k2, k3 ORDER BY fresh DESC, seq DESC) AS back, first_value(task_type) OVER w AS ft, first_value(target) OVER w AS fg, first_value(objective) OVER w AS fo, lag(started_at) OVER w AS was_started FROM allr WINDOW w AS (PARTITION BY investigation_id, k1, k2, k3 ORDER BY fresh, seq)),
  n AS (SELECT *, sum(CASE WHEN fresh AND (was IN ('COMPLETED', 'FAILED') OR was_started IS NOT NULL) THEN 1 ELSE 0 END) OVER (PARTITION BY investigation_id, k1, k2, k3) AS r FROM s)
SELECT investigation_id, task_id, ft AS task_type, fg AS target, fo AS objective, status, CAST(r AS INTEGER) AS retry_count, started_at, completed_at FROM n WHERE back = 1""",
        "s16_apply_task_status": f"""{ctes("research_tasks")}, store AS (SELECT *, CASE WHEN status <> 'PENDING' THEN changed_at END AS started_at, CASE WHEN status IN ('COMPLETED', 'FAILED') THEN changed_at END AS completed_at FROM research_tasks QUALIFY row_number() OVER (PARTITION BY investigation_id, task_id ORDER BY seq) = 1),
  c AS (SELECT investigation_id, task_id, arg_max(status, seq) AS status, arg_max(changed_at, seq) FILTER (status = 'STARTED') AS started_at, arg_max(changed_at, seq) FILTER (status IN ('COMPLETED', 'FAILED')) AS completed_at,
   arg_max(target, seq) FILTER (status = 'COMPLETED' AND seq % 3 = 0) AS result_info, arg_max('timeout', seq) FILTER (status = 'FAILED' AND seq % 2 = 0) AS error_info FROM research_tasks GROUP BY 1, 2)
SELECT s.investigation_id, s.task_id, task_type, target, objective, coalesce(c.status, s.status) AS status, 0 AS retry_count, coalesce(c.started_at, s.started_at) AS started_at, coalesce(c.completed_at, s.completed_at) AS completed_at, result_info, error_info FROM store s LEFT JOIN c ON s.investigation_id = c.investigation_id AND s.task_id = c.task_id""",
        "s14_export_sections": f"""{ctes("investigations", "evidence", "intake")}{signals}, sums AS (SELECT investigation_id, sum(risk_weight) AS total FROM signals GROUP BY 1), j AS (SELECT i.investigation_id, i.investigation_id NOT IN (SELECT investigation_id FROM sub) AS bare, total FROM investigations i LEFT JOIN sums s ON i.investigation_id = s.investigation_id),
  k AS (SELECT *, CASE WHEN NOT bare THEN CAST(least(coalesce(total, 0), 100) AS INTEGER) END AS score FROM j), scores AS (SELECT investigation_id, score, CASE WHEN bare THEN 'INSUFFICIENT_EVIDENCE' ELSE {level} END AS level FROM k)
{" UNION ALL ".join([*entity, *summary, *category, *findings, *rows])}""",
        "x2_page_challenge": f"""SELECT page_id, {_CHALLENGE} AS challenge, CASE WHEN trim(regexp_replace(coalesce(html, ''), '\\s+', ' ', 'g')) = '' THEN 'EMPTY_RESPONSE' WHEN ({_CHALLENGE}) IS NOT NULL OR {_has("lower(html)", P.BLOCKED)} OR {_has(_TITLE, P.BLOCKED_TITLES)} THEN 'BLOCKED_OR_ERROR'
  WHEN {_has("lower(html)", P.NO_RESULTS)} THEN 'NO_RESULTS' WHEN regexp_replace({plain}, '{P.SPACES}', '', 'g') = '' THEN 'EMPTY_RESPONSE' END AS failure FROM pages""",
        "x7_9_page_facts": f"{texts} {_FACTS} FROM (SELECT page_id, string_split(text, chr(10)) AS lines FROM texts)",
        "x7_9_document_facts": f"{_FACTS} FROM (SELECT doc_id AS page_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents)",
        "f14_address_values": f"""{ctes("evidence")}, t AS (SELECT investigation_id, ev_seq, trim(field_value) AS v, lower(trim(field_value)) AS low FROM evidence),
  k AS (SELECT *, regexp_matches(v, {_q(P.PIN)}) AS pin, {_fits("low", [rf"\b(?:{p})\b" for p in P.PARTS])} AS part, {_has("low", P.REGIONS)} AS region FROM t WHERE length(v) >= 8 AND low NOT IN {_in((*P.NO_ADDRESS, *P.HEADINGS))} AND NOT {_has("low", P.FILINGS)}
    AND NOT ({" OR ".join(f"starts_with(low, {_q(w)})" for w in (*P.ACTIVITIES, *(h + e for h in P.HEADINGS for e in (" -", ":"))))}))
SELECT investigation_id, ev_seq FROM k WHERE (pin AND (part OR region)) OR (part AND region AND length(v) >= 15) OR (pin AND length(v) >= 20 AND contains(v, ','))""",
        "p15_guard_leaks": f"""{ctes("evidence")}, r AS (SELECT investigation_id, ev_seq, CASE ev_seq % 3 WHEN 0 THEN 'GST_VERIFICATION' WHEN 1 THEN 'THIRD_PARTY_RESEARCH' ELSE 'WEBSITE_VERIFICATION' END AS task_type, CASE ev_seq % 2 WHEN 0 THEN 'alpha foods ' ELSE '27ABCDE1234F1Z5' END AS target,
  CASE ev_seq % 4 WHEN 0 THEN 'legal_name' ELSE field_name END AS field_name, field_value FROM evidence) SELECT * REPLACE (CASE WHEN (lower(trim(field_value)) = lower(trim(target)) AND NOT coalesce({own}, FALSE)) OR {shaped} THEN 'NOT_FOUND' ELSE field_value END AS field_value) FROM r""",
    }


