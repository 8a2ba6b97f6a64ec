"""Queries of intake, entities, tasks, events, reports and their checks, and their SQL for DuckDB.

Tables that the views lack are derived by the same expressions in both engines ({name} stands for a table)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from probitas.cluster import new_folder, stage, stage_by
from probitas.functions import text as X
from probitas.operators import evidence as E
from probitas.operators import intake as N
from probitas.operators import lifecycle as Y
from probitas.operators import linkage as L
from probitas.operators import listing as I
from probitas.operators import pages as P
from probitas.operators import qa as Q
from probitas.operators import report as R
from probitas.operators import risk as K
from probitas.sources import catalog as C
from probitas.sources.views import VIEWS, by_investigation, ctes, dealt, dealt_tasks, view
from probitas.streaming import streams as S

DERIVED = {
    "requests": """SELECT investigation_id, CASE investigation_id % 7 WHEN 0 THEN '  firm  of ' || business_name ELSE business_name END AS business_name,
      CASE investigation_id % 5 WHEN 0 THEN lower(gstin) WHEN 1 THEN gstin || '?' ELSE gstin END AS gstin, CASE investigation_id % 4 WHEN 0 THEN 'X' || cin ELSE ' ' || cin END AS cin, epfo_code,
      CASE investigation_id % 6 WHEN 0 THEN 'HTTP://' || website || '/about?x=1' WHEN 1 THEN 'ftp://' || website WHEN 2 THEN 'localhost' ELSE website END AS website,
      CASE investigation_id % 6 WHEN 0 THEN 'located in PUNE, maharashtra / Pune' WHEN 1 THEN 'new-delhi &amp; more' WHEN 2 THEN '<b>Mumbai</b> - official website of x' WHEN 3 THEN ' , ' WHEN 4 THEN location END AS location FROM {intake}""",
    "blocked": """SELECT investigation_id, seq, task_id, CASE WHEN status = 'FAILED' THEN 'HUMAN_INTERVENTION_REQUIRED' ELSE status END AS status,
      CASE WHEN status = 'FAILED' THEN 'CAPTCHA' END AS intervention_type, changed_at AS started_at FROM {research_tasks}""",
    "versions": "SELECT investigation_id, CAST(seq AS INT) AS version, CASE status WHEN 'COMPLETED' THEN 'PASS' WHEN 'FAILED' THEN 'FAIL' ELSE 'PENDING' END AS qa_status FROM {research_tasks}",
    "verdicts": "SELECT investigation_id, CASE status WHEN 'COMPLETED' THEN 'PASS' ELSE 'FAIL' END AS status FROM {investigations} WHERE status IN ('COMPLETED', 'FAILED')",
    "created": "SELECT investigation_id, 'CREATED' AS event_type, 'intake' AS node, 'OK' AS status, '{{}}' AS metadata_json, created_at FROM {investigations}",
    "tries": """SELECT attempt_id, investigation_id, domain, status, source_name, CASE WHEN attempt_id % 3 = 0 THEN '' ELSE url END AS url, attempt_id % 4 AS attempt_order, CAST(attempt_id % 2 AS INT) AS action_count FROM {attempts}""",
    "known_sources": "SELECT DISTINCT source_name AS name, 'REGISTRY' AS source_type, 1 AS authority_tier, TRUE AS enabled FROM {evidence}",
    "seen_sources": "SELECT trim(source_name) AS name, 'REGISTRY' AS source_type, CAST(max(attempt_id % 4) AS INT) AS authority_tier, CAST(NULL AS BOOLEAN) AS enabled FROM {attempts} GROUP BY 1",
    "checks": """SELECT investigation_id, CASE WHEN investigation_id % 3 = 0 THEN 'PASS' ELSE 'FAIL' END AS status, investigation_id % 4 AS loops, investigation_id % 5 AS kind FROM {investigations}""",
}
_KINDS = ("WRONG_ENTITY", "MISSING_EVIDENCE", "WRONG_RISK_SCORE", "REPORT_WORDING", "OTHER")
_SOURCE = {"requests": "intake", "blocked": "research_tasks", "versions": "research_tasks", "verdicts": "investigations", "created": "investigations", "tries": "attempts", "known_sources": "evidence", "seen_sources": "attempts", "checks": "investigations"}


def _get(spark: SparkSession, sf: str, name: str) -> DataFrame:
    if name in VIEWS:
        return view(spark, sf, name)
    base = _SOURCE[name]
    return spark.sql(DERIVED[name], **{base: view(spark, sf, base)})


def _with(*names: str) -> str:
    """Views and derived tables as the leading CTEs of a DuckDB statement."""
    bases = dict.fromkeys(n if n in VIEWS else _SOURCE[n] for n in names)
    more = "".join(f",\n{n} AS ({DERIVED[n].format(**{_SOURCE[n]: _SOURCE[n]})})" for n in names if n not in VIEWS)
    return ctes(*bases) + more


def _normal(s: SparkSession, d: str) -> DataFrame:
    return N.normalize_intake(_get(s, d, "requests"))


def _intake_rows(s: SparkSession, d: str) -> DataFrame:
    said = [F.col(f"provenance.{c}").alias(f"{c}_from") for c in ("gstin", "cin", "website")]
    return _normal(s, d).select("investigation_id", "business_name", "gstin", "cin", "website", "location", *said)


def _resolved(s: SparkSession, d: str) -> DataFrame:
    fields = ("name", "location", "website", "gstin")
    targets, candidates = _get(s, d, "targets"), _get(s, d, "candidates")
    found = L.resolve_scope(targets, candidates, "nationkey").join(candidates, "candidate_id").select("target_id", *fields)
    return N.merge_entity(targets.select("target_id", *fields), found, fields, "target_id").withColumn("entity_id", N.entity_id(F.col("name")))


def _entities(s: SparkSession, d: str) -> DataFrame:
    name = {"trade_name": F.lit(None).cast("string"), "registered_address": F.lit(None).cast("string"), "address": F.col("website"), "state": F.lit("")}
    of = lambda n: _get(s, d, n).select("name", "website", "location").withColumns(name)
    empty = s.createDataFrame([], "entity_id string, canonical_name string, trade_name string, registered_address string, state string")
    return N.upsert_entities(N.upsert_entities(empty, of("candidates")), of("targets"))


def _linked(s: SparkSession, d: str) -> DataFrame:
    from probitas.plans.queries import linked_evidence

    return linked_evidence(s, d)


def _profile(s: SparkSession, d: str, ev: DataFrame | None = None) -> DataFrame:
    """risk_profile() of all evidence, staged: scores, findings and checks read it."""
    return stage(K.risk_profile(_get(s, d, "evidence") if ev is None else ev), "risk")


def _signals(p: DataFrame) -> DataFrame:
    return K.attach_rules(K.exploded(p))


def _findings(p: DataFrame) -> DataFrame:
    return _signals(p).withColumn("description", F.when(F.col("code") == "GST_INACTIVE", "possible fake registration").otherwise(F.lower("code")))


def _scores(s: SparkSession, d: str, p: DataFrame) -> DataFrame:
    return K.scores_of(_get(s, d, "investigations"), p)


def _reported(s: SparkSession, d: str, p: DataFrame) -> DataFrame:
    """What reports say: entity, a confidence, and a score that is wrong for some."""
    e = _normal(s, d).select("investigation_id", "business_name", "gstin", "cin", "epfo_code", "website", (F.col("investigation_id") % 10 / 10).alias("entity_confidence"))
    wrong = F.col("score") + F.when(F.col("investigation_id") % 9 == 0, 1).otherwise(0)
    return e.join(_scores(s, d, p).select("investigation_id", wrong.alias("score"), "level"), "investigation_id")


def _grounded(s: SparkSession, d: str, p: DataFrame, ev: DataFrame | None = None) -> DataFrame:
    ev = _get(s, d, "evidence") if ev is None else ev
    return stage(Q.check_grounding(_signals(p), E.evidence_for(ev, _get(s, d, "investigations").filter("status = 'COMPLETED'"))), "grounded")


def _coverage(s: SparkSession, d: str) -> DataFrame:
    return Q.grounding_coverage(_get(s, d, "investigations"), _grounded(s, d, _profile(s, d)))


def _mismatch(s: SparkSession, d: str) -> DataFrame:
    p = _profile(s, d)
    return Q.score_mismatch(_reported(s, d, p), _scores(s, d, p))


def _verdict(s: SparkSession, d: str) -> DataFrame:
    ev, i = by_investigation(s, d), _get(s, d, "investigations")
    p = stage_by(K.risk_profile(ev), "investigation_id", dealt_tasks(s, d), "risk")
    grounded = _grounded(s, d, p, ev)
    issues = Q.qa_issues(_reported(s, d, p), _get(s, d, "requests"), _findings(p), ev, _scores(s, d, p), grounded)
    return Q.qa_verdict(i, issues, Q.grounding_coverage(i, grounded)).withColumn("issues", F.array_join("issues", ","))


def _reports(s: SparkSession, d: str) -> DataFrame:
    ev, attempts = by_investigation(s, d), _get(s, d, "attempts")
    keep = lambda x, label: stage_by(x, "investigation_id", dealt_tasks(s, d), label)
    p = keep(K.risk_profile(ev), "risk")
    status = keep(R.source_status(ev, C.source_catalog(s)), "status")
    given = _normal(s, d).select("investigation_id", "business_name", "gstin", "cin", "website", "location")
    entities = keep(N.resolved_entities(given, ev), "entities")
    r = R.build_reports(entities, _scores(s, d, p), _signals(p), status, R.source_limitations(status, attempts), attempts, ev)
    said = lambda c, *parts: F.array_join(F.transform(c, lambda x: F.concat_ws("=", *(x[p] for p in parts))), ",")
    texts = {
        "findings": said("major_findings", "code", "risk_weight"), "limitations": said("source_limitations", "source", "status"), "attempts": said("source_attempt_status", "domain", "status", "attempts"),
        "unverified": said("unverified_information", "research_result_id", "field_name"), "evidence": said("evidence_summary", "research_result_id", "ev_seq"), "consistency": said("cross_source_consistency", "field_key", "status"),
    }
    return r.select(
        "investigation_id", "entity.name", "entity.gstin", "entity.cin", "entity.resolution_status", F.round("entity_confidence", 4).alias("entity_confidence"), "overall_risk.score", "overall_risk.level", "assessment_status",
        F.array_join("reason_codes", ",").alias("reason_codes"), "primary_source", F.col("verification_summary")["gst"]["status"].alias("gst"), "category_scores.compliance", "recommendation", *(c.alias(k) for k, c in texts.items()),
    )


def _stream(s: SparkSession, d: str, name: str) -> DataFrame:
    """A view over events as a stream of files."""
    schema = s.read.parquet(f"{d}/events.parquet").schema
    s.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d).createOrReplaceTempView("probitas_stream_events")
    return s.sql(VIEWS[name].replace("{t}", "probitas_stream_"))


def _streamed(s: SparkSession, d: DataFrame, mode: str) -> DataFrame:
    """What a stream gives once all files are read; each batch replaces the rows before."""
    path = new_folder(s, "stream")
    write = lambda batch, _: batch.write.mode("overwrite").parquet(path)
    d.writeStream.outputMode(mode).option("checkpointLocation", new_folder(s, "offsets")).foreachBatch(write).trigger(availableNow=True).start().awaitTermination()
    return s.read.schema(d.schema).parquet(path)


def _tailed(s: SparkSession, d: str) -> DataFrame:
    events, store = _stream(s, d, "audit_events"), new_folder(s, "events")
    events.writeStream.option("checkpointLocation", new_folder(s, "offsets")).foreachBatch(S.event_sink(store)).trigger(availableNow=True).start().awaitTermination()
    return s.read.schema(events.schema).option("recursiveFileLookup", True).parquet(store)


def _bounded(s: SparkSession, d: str) -> DataFrame:
    items = "transform(sequence(1, CASE WHEN ev_seq % 2 = 0 THEN 1 ELSE 12 END), i -> named_struct('name', field_name, 'text', repeat('x', CAST(ev_seq * 700 AS INT))))"
    x = _get(s, d, "evidence").select("investigation_id", "ev_seq", E.bound_items(F.expr(items), ("name", "text")).alias("x"))
    return x.select("investigation_id", "ev_seq", F.size("x").cast("long").alias("n"), F.length(F.col("x")[0]["text"]).cast("long").alias("text_length"))


def _replaced(s: SparkSession, d: str) -> DataFrame:
    p = _profile(s, d, dealt(s, d, "evidence"))  # store and new signals are both made of it
    store = _signals(p).select("investigation_id", "code", "risk_weight")
    touched = _get(s, d, "investigations").filter("status = 'FAILED'")
    new = store.join(touched.select("investigation_id"), "investigation_id", "left_semi").withColumn("risk_weight", F.col("risk_weight") * 2)
    return K.replace_risk_signals(store, new, touched)


def _versions(s: SparkSession, d: str) -> DataFrame:
    """The table of versions, staged by investigation: it is read for its last versions and for its rows."""
    rows = s.sql(DERIVED["versions"], research_tasks=dealt(s, d, "research_tasks"))
    return stage_by(rows, "investigation_id", dealt_tasks(s, d), "versions")


def _pairs_of_rows(s: SparkSession, d: str) -> DataFrame:
    e = _get(s, d, "evidence").select("investigation_id", "ev_seq", "field_name", "field_value")
    n = e.select("investigation_id", (F.col("ev_seq") - 1).alias("ev_seq"), F.col("field_name").alias("f2"), F.col("field_value").alias("v2"))
    return e.join(n, ["investigation_id", "ev_seq"]).select("investigation_id", "ev_seq", R.compare_fields(F.col("field_name"), F.col("field_value"), F.col("f2"), F.col("v2")).alias("outcome"))


def _lines(s: SparkSession, d: str) -> DataFrame:
    t = P.page_text(s.read.parquet(f"{d}/pages.parquet")).select("page_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("pos", "line"))
    return t.select("page_id", "pos", X.is_legal_name(F.col("line")).alias("legal_name"), X.is_activity(F.col("line")).alias("activity"))


def _steps(s: SparkSession, d: str) -> DataFrame:
    issues = F.array(F.element_at(F.array(*map(F.lit, _KINDS)), (F.col("kind") + 1).cast("int")))
    return _get(s, d, "checks").select("investigation_id", Q.next_step(F.col("status"), issues, F.col("loops")).alias("next_step"), Q.final_status(F.col("status"), F.col("loops")).alias("final_status"))


def _progress(s: SparkSession, d: str) -> DataFrame:
    return Y.stage_progress(_get(s, d, "investigations").join(I.latest_status(_get(s, d, "audit_events")).select("investigation_id", "node"), "investigation_id", "left"))


def _attempt_log(s: SparkSession, d: str) -> DataFrame:
    empty = s.createDataFrame([], "attempt_id long, investigation_id long, domain string, status string, action_count int, metadata_json string")
    return Y.append_attempts(empty, _get(s, d, "tries").withColumn("preferred_sources", F.array(F.lit("gst.gov.in"), F.lit("mca.gov.in"))))


QUERIES = {
    "s1_intake_lengths": lambda s, d: N.check_lengths(_get(s, d, "requests")).select("investigation_id", F.array_join("too_long", ",").alias("too_long")),
    "s2_read_pages": lambda s, d: P.read_pages(s, f"{d}/pages.parquet").select("page_id", "url", "content_hash"),
    "p1_normalize_intake": _intake_rows,
    "p2_require_identifier": lambda s, d: I.require_identifier(_get(s, d, "intake").withColumnRenamed("business_name", "name")).select("investigation_id"),
    "j17_dropped_identifiers": lambda s, d: N.dropped_identifiers(_get(s, d, "requests"), _normal(s, d)),
    "j6_merge_entity": _resolved,
    "s15_upsert_entities": _entities,
    "a11_discovery_confidence": lambda s, d: N.discovery_confidence(N.candidates_of(_get(s, d, "evidence"))),
    "j13_link_evidence": lambda s, d: _linked(s, d).select("investigation_id", "ev_seq", "kind", "target", "objective", "linked"),
    "p6_pending_interventions": lambda s, d: Y.pending_interventions(_get(s, d, "blocked")),
    "p7_requeue_blocked": lambda s, d: Y.requeue_blocked(_get(s, d, "blocked"), _get(s, d, "investigations")),
    "p9_admit_results": lambda s, d: E.admit_results(_get(s, d, "evidence")).select("investigation_id", "ev_seq", F.array_join("errors", "; ").alias("errors"), "is_valid"),
    "p10_bound_items": _bounded,
    "p17_evidence_listing": lambda s, d: Y.evidence_listing(_get(s, d, "evidence")),
    "s4_register_missing": lambda s, d: C.register_missing(_get(s, d, "known_sources"), _get(s, d, "seen_sources")),
    "s5_upsert_source": lambda s, d: C.upsert_source(_get(s, d, "known_sources"), _get(s, d, "seen_sources")),
    "f20_find_source": lambda s, d: C.find_source(_get(s, d, "attempts").select(F.col("attempt_id"), F.translate("domain", ".", "_").alias("source_name")), C.source_catalog(s)).select("attempt_id", "source.name", "source.tier"),
    "f19_canonical_source": lambda s, d: _get(s, d, "evidence").select("investigation_id", "ev_seq", C.canonical_source(F.col("source_name")).alias("source")),
    "s10_replace_risk_signals": _replaced,
    "s11_append_report_version": lambda s, d: R.append_report_version(_versions(s, d), _get(s, d, "investigations").select("investigation_id")),
    "s12_append_events": lambda s, d: Y.append_events(_get(s, d, "created"), _get(s, d, "audit_events").withColumn("status", F.col("event_type")), ("event_id",)),
    "s13_export_json": lambda s, d: R.export_report_json(_get(s, d, "versions")),
    "s17_append_attempts": _attempt_log,
    "s18_stamp_qa": lambda s, d: R.stamp_qa(_get(s, d, "versions"), _get(s, d, "verdicts")),
    "w10_report_versions": lambda s, d: R.report_versions(_get(s, d, "versions")).select("investigation_id", "version", "nth"),
    "k4_events_in_order": lambda s, d: Y.events_in_order(_get(s, d, "audit_events")).select("investigation_id", "event_id", "pos"),
    "f15_f16_line_shapes": _lines,
    "f17_compare_fields": _pairs_of_rows,
    "f18_recommendation": lambda s, d: _scores(s, d, K.risk_profile(_get(s, d, "evidence"))).select("investigation_id", R.recommendation(F.col("score")).alias("recommendation")),
    "f22_f23_next_step": _steps,
    "f25_stage_progress": _progress,
    "a6_consistency_records": lambda s, d: R.consistency_records(_get(s, d, "evidence"), _normal(s, d)).select("investigation_id", "field_key", "field", "status", "analysis", F.size("sources").cast("long").alias("n_sources")),
    "j15_unsafe_wording": lambda s, d: Q.unsafe_wording(_findings(_profile(s, d)), _get(s, d, "evidence")),
    "j18_score_mismatch": _mismatch,
    "a7_grounding_coverage": _coverage,
    "a8_qa_verdict": _verdict,
    "a14_build_reports": _reports,
    "t1_tail_events": lambda s, d: _tailed(s, d).select("event_id", "investigation_id", "node"),
    "t3_stream_attempts": lambda s, d: _streamed(s, S.attempt_status(_stream(s, d, "attempts")), "complete"),
    "t4_stream_latest_status": lambda s, d: _streamed(s, I.latest_status(_stream(s, d, "audit_events")), "complete"),
}


def oracles(core: dict[str, str], signals: str, level: str, status: str, tasks: str, address: str, texts: str, rank: str) -> dict[str, str]:
    """The same in SQL; the arguments are statements and CTEs of the other plans."""
    norm = f"norm_in AS (SELECT investigation_id, {X.sql_norm_text('business_name')} AS business_name, {N.sql_normal()}, nullif(trim(regexp_replace(epfo_code, '\\s+', ' ', 'g')), '') AS epfo_code, {X.sql_norm_location('location')} AS location FROM requests)"
    recommend = "CASE " + " ".join(f"WHEN score {c} THEN '{t}'" for c, t in zip(("IS NULL", ">= 61", ">= 31"), R.RECOMMENDATIONS[:3], strict=True)) + f" ELSE '{R.RECOMMENDATIONS[3]}' END"
    sums = f""", sums AS (SELECT investigation_id, sum(risk_weight) AS total FROM signals GROUP BY 1), sc0 AS (SELECT i.investigation_id, i.investigation_id NOT IN (SELECT investigation_id FROM sub) AS bare, total FROM investigations i LEFT JOIN sums s ON i.investigation_id = s.investigation_id),
  sc1 AS (SELECT *, CASE WHEN NOT bare THEN CAST(least(coalesce(total, 0), 100) AS INTEGER) END AS score FROM sc0), scores AS (SELECT investigation_id, score, bare, CASE WHEN bare THEN 'INSUFFICIENT_EVIDENCE' ELSE {level} END AS level FROM sc1)"""
    grounded = f", grounded AS ({core['j14_grounding']})"
    coverage = ", coverage AS (SELECT i.investigation_id, coalesce(avg(CAST(ok AS INT)), 1.0) AS coverage FROM investigations i LEFT JOIN (SELECT investigation_id, code, bool_and(problem IS NULL) AS ok FROM grounded GROUP BY 1, 2) g ON i.investigation_id = g.investigation_id GROUP BY 1)"
    words = ", ".join(f"'{w}'" for w in Q.UNSAFE)
    wording = f""", said AS (SELECT investigation_id, code, evidence_ids, CASE code WHEN 'GST_INACTIVE' THEN 'possible fake registration' ELSE lower(code) END AS description FROM signals),
  w0 AS (SELECT investigation_id, code, evidence_ids, unnest(list_filter([{words}], lambda w: contains(description, w))) AS word FROM said),
  wording AS (SELECT w0.investigation_id, code, word FROM w0 LEFT JOIN evidence e ON e.investigation_id = w0.investigation_id AND list_contains(string_split(evidence_ids, ','), e.research_result_id) GROUP BY ALL HAVING NOT bool_or(coalesce(contains(lower(field_value || ' ' || source_name), word), FALSE)))"""
    reported = f""", {norm}, reported AS (SELECT n.investigation_id, business_name, gstin, cin, epfo_code, (n.investigation_id % 10) / 10 AS entity_confidence, score + CASE WHEN n.investigation_id % 9 = 0 THEN 1 ELSE 0 END AS score, level FROM norm_in n JOIN scores s ON n.investigation_id = s.investigation_id)"""
    dropped = "SELECT r.investigation_id, unnest(list_filter([" + ", ".join(f"CASE WHEN lower(trim(coalesce(r.{c}, ''))) NOT IN ('invalid', 'none', 'null', 'n/a', '') AND coalesce(n.{c}, '') = '' THEN '{c}' END" for c in ("gstin", "cin", "epfo_code")) + "], lambda x: x IS NOT NULL)) AS field FROM requests r JOIN norm_in n ON r.investigation_id = n.investigation_id"
    mismatch = "SELECT r.investigation_id, r.score, s.score AS expected FROM reported r JOIN scores s ON r.investigation_id = s.investigation_id WHERE r.score IS DISTINCT FROM s.score"
    records = f""", {norm}, vals AS (SELECT investigation_id, field_name AS field_key, source_name AS source, arg_max(trim(field_value), ev_seq) AS v, min(ev_seq) AS pos FROM evidence WHERE field_name IN ({", ".join(f"'{c}'" for c in R.CONSISTENCY_FIELDS)}) AND confidence >= 0.5 AND upper(trim(field_value)) NOT IN ({", ".join(f"'{c}'" for c in R.NO_VALUE)}) GROUP BY 1, 2, 3
    UNION ALL SELECT investigation_id, k, 'User Input', trim(v), 4611686018427387904 FROM (SELECT investigation_id, unnest(['gstin', 'cin', 'website']) AS k, unnest([gstin, cin, website]) AS v FROM norm_in) WHERE trim(v) <> ''),
  co AS (SELECT *, first_value(upper(v)) OVER (PARTITION BY investigation_id, field_key ORDER BY pos) AS f FROM vals),
  cx AS (SELECT *, {_words_sql("f")} AS a, {_words_sql("v")} AS b FROM co),
  cu AS (SELECT investigation_id, field_key, string_agg(lv, ', ' ORDER BY m) AS forms FROM (SELECT investigation_id, field_key, upper(v) AS uk, min(pos) AS m, arg_max(v, pos) AS lv FROM vals GROUP BY 1, 2, 3) GROUP BY 1, 2),
  cg AS (SELECT investigation_id, field_key, count(*) AS n, string_agg(source, ', ' ORDER BY pos) AS names, string_agg(source || ': ' || v, '; ' ORDER BY pos) AS pairs, CASE WHEN field_key LIKE '%address' THEN CASE WHEN count(DISTINCT {X.sql_norm_address("v")}) = 1 THEN 'MATCH' ELSE 'CONFLICT' END WHEN count(DISTINCT upper(v)) = 1 THEN 'MATCH'
   WHEN bool_or(upper(v) <> f AND len(a) > 0 AND len(b) > 0 AND len(list_intersect(a, b)) / CAST(len(list_distinct(list_concat(a, b))) AS DOUBLE) >= 0.4) THEN 'PARTIAL_MATCH' ELSE 'CONFLICT' END AS status FROM cx GROUP BY 1, 2),
  records AS (SELECT n.investigation_id, k.field_key, k.field, coalesce(cg.status, 'UNAVAILABLE') AS status, CASE coalesce(cg.status, 'UNAVAILABLE') WHEN 'UNAVAILABLE' THEN 'No verified evidence available from any source for comparison.' WHEN 'MATCH' THEN 'All sources (' || names || ') are fully consistent.' WHEN 'PARTIAL_MATCH' THEN 'Minor formatting or text variations observed across sources: ' || forms || '.'
     ELSE 'Conflicting ' || CASE WHEN k.field_key LIKE '%address' THEN 'address ' ELSE '' END || 'data reported across sources: ' || pairs || '.' END AS analysis, coalesce(cg.n, 0) AS n_sources
    FROM norm_in n CROSS JOIN (VALUES {", ".join(f"('{k}', '{l}')" for k, l in zip(R.CONSISTENCY_FIELDS, R.FIELD_LABELS, strict=True))}) k(field_key, field) LEFT JOIN cg ON cg.investigation_id = n.investigation_id AND cg.field_key = k.field_key LEFT JOIN cu ON cu.investigation_id = n.investigation_id AND cu.field_key = k.field_key)"""
    # the resolution statement, over each investigation's request and the candidates of its evidence
    own = """WITH targets AS (SELECT investigation_id AS target_id, investigation_id AS nationkey, business_name AS name, location, website, gstin FROM norm_in), candidates AS (SELECT candidate_id, investigation_id AS nationkey, name, CAST(NULL AS VARCHAR) AS location, CAST(NULL AS VARCHAR) AS website, gstin FROM cand)"""
    resolution = core["j5_resolve"].replace(ctes("targets", "candidates"), own)
    limited = f"limits AS ({core['j20_source_limitations']})"
    kind = f"[{', '.join(repr(k) for k in _KINDS)}][kind + 1]"
    step = "CASE WHEN status = 'PASS' OR loops >= 2 THEN 'end' " + " ".join(f"WHEN {kind} = '{a}' THEN '{b}'" for a, b in Q.NEXT) + " ELSE 'planner' END"
    key = lambda c: f"translate(lower(trim({c})), '_.', '--')"
    sites = ", ".join(f"('{x[0]}', {x[3]})" for x in C.SOURCES)
    canonical = "CASE source_name " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in C.CANONICAL) + " ELSE source_name END"
    address_field = lambda f: f"v.field_name IN ({', '.join(repr(x) for x in f)})"
    same = "CASE WHEN field_name IN ('registered_address', 'establishment_address', 'contact_address', 'principal_business_address', 'address') THEN {a} <> '' AND {a} = {b} ELSE lower(trim(field_value)) = lower(trim(v2)) END".format(a=X.sql_norm_address("field_value"), b=X.sql_norm_address("v2"))
    fields = ("name", "location", "website", "gstin")
    merged = ", ".join(f"CASE WHEN coalesce(c.{f}, '') <> '' AND upper(trim(c.{f})) NOT IN ('NOT_FOUND', 'UNAVAILABLE', 'NONE') THEN c.{f} ELSE t.{f} END AS {f}" for f in fields)
    return {
        "s1_intake_lengths": f"{_with('requests')} SELECT investigation_id, array_to_string(list_filter([{', '.join(f"CASE WHEN length({c}) > {n} THEN '{c}' END" for c, n in N.FIELDS.items() if n and c != 'user_id')}], lambda x: x IS NOT NULL), ',') AS too_long FROM requests",
        "s2_read_pages": "SELECT page_id, url, sha256(coalesce(html, '')) AS content_hash FROM pages",
        "p1_normalize_intake": f"{_with('requests')}, {norm} SELECT * EXCLUDE (epfo_code) FROM norm_in",
        "p2_require_identifier": f"{_with('intake')} SELECT investigation_id FROM intake WHERE trim(business_name) <> '' OR trim(gstin) <> '' OR trim(cin) <> '' OR trim(epfo_code) <> '' OR trim(website) <> ''",
        "j17_dropped_identifiers": f"{_with('requests')}, {norm} {dropped}",
        "j6_merge_entity": f"{_with('targets', 'candidates')}, r AS ({core['j5_resolve']}), m AS (SELECT t.target_id, {merged} FROM targets t LEFT JOIN r ON r.target_id = t.target_id LEFT JOIN candidates c ON c.candidate_id = r.candidate_id) SELECT *, {N.sql_entity_id('name')} AS entity_id FROM m",
        "s15_upsert_entities": f"""{_with('targets', 'candidates')}, e AS (SELECT {N.sql_entity_id('name')} AS entity_id, name AS canonical_name, name AS trade_name, nullif(website, '') AS registered_address, nullif(location, '') AS state, 1 AS r FROM candidates UNION ALL SELECT {N.sql_entity_id('name')}, name, name, nullif(website, ''), nullif(location, ''), 2 FROM targets)
SELECT entity_id, canonical_name, trade_name, registered_address, state FROM e QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY r, canonical_name, registered_address NULLS FIRST, state NULLS FIRST) = 1""",
        "a11_discovery_confidence": f"""{_with('evidence')} SELECT investigation_id, max(coalesce(c.confidence, 0.0)) AS confidence FROM (SELECT investigation_id, unnest(from_json(field_value, '[{{"confidence":"DOUBLE"}}]')) AS c FROM evidence WHERE field_name = 'candidate_entities') GROUP BY 1""",
        "j13_link_evidence": f"{_with('evidence', 'research_tasks')}, tk AS ({tasks}) SELECT e.investigation_id, ev_seq, upper(trim(task_type)) AS kind, lower(trim(target)) AS target, lower(trim(objective)) AS objective, t.task_id IS NOT NULL AS linked FROM evidence e LEFT JOIN tk t ON e.investigation_id = t.investigation_id AND e.task_id = t.task_id",
        "p6_pending_interventions": f"{_with('blocked')} SELECT * FROM blocked WHERE status = 'HUMAN_INTERVENTION_REQUIRED'",
        "p7_requeue_blocked": f"""{_with('blocked', 'investigations')}, j AS (SELECT b.*, b.status = 'HUMAN_INTERVENTION_REQUIRED' AND coalesce(i.status NOT IN ('COMPLETED', 'RUNNING'), FALSE) AS go FROM blocked b LEFT JOIN investigations i ON i.investigation_id = b.investigation_id)
SELECT investigation_id, seq, task_id, CASE WHEN go THEN 'PENDING' ELSE status END AS status, CASE WHEN NOT go THEN intervention_type END AS intervention_type, CASE WHEN NOT go THEN started_at END AS started_at FROM j""",
        "p9_admit_results": f"""{_with('evidence')}, base AS ({core['p8_validate_results']}), addr AS ({address}), v AS (SELECT e.*, a.ev_seq IS NOT NULL AS address FROM evidence e LEFT JOIN addr a ON a.investigation_id = e.investigation_id AND a.ev_seq = e.ev_seq),
  more AS (SELECT investigation_id, ev_seq, CASE WHEN {address_field(E.ADDRESS_FIELDS)} AND NOT address THEN 'not an address' WHEN {address_field(E.NAME_FIELDS)} AND NOT {X.sql_is_legal_name("field_value")} THEN 'not a legal name' WHEN {address_field(E.ACTIVITY_FIELDS)} AND NOT {X.sql_is_activity("field_value")} THEN 'not a business activity' END AS e FROM v)
SELECT b.investigation_id, b.ev_seq, concat_ws('; ', nullif(b.errors, ''), m.e) AS errors, b.is_valid AND m.e IS NULL AS is_valid FROM base b JOIN more m ON b.investigation_id = m.investigation_id AND b.ev_seq = m.ev_seq""",
        "p10_bound_items": f"{_with('evidence')} SELECT investigation_id, ev_seq, CASE WHEN ev_seq % 2 = 0 THEN 1 ELSE 12 END AS n, CASE WHEN ev_seq % 2 = 0 THEN CASE WHEN ev_seq * 700 > 2000 THEN 2000 + {len(E.CUT)} ELSE ev_seq * 700 END WHEN ev_seq * 700 <= 1400 THEN ev_seq * 700 END AS text_length FROM evidence",
        "p17_evidence_listing": f"{_with('evidence')} SELECT investigation_id, research_result_id, task_id, field_name, field_value, source_name, CAST(NULL AS VARCHAR) AS source_url, strftime(retrieved_at, '%Y-%m-%dT%H:%M:%S') || '+00:00' AS retrieved_timestamp, confidence, CAST(NULL AS VARCHAR) AS created_timestamp FROM evidence",
        "s4_register_missing": f"{_with('known_sources', 'seen_sources')} SELECT * FROM known_sources UNION ALL SELECT * FROM seen_sources WHERE name NOT IN (SELECT name FROM known_sources)",
        "s5_upsert_source": f"{_with('known_sources', 'seen_sources')} SELECT coalesce(k.name, n.name) AS name, 'REGISTRY' AS source_type, coalesce(n.authority_tier, k.authority_tier) AS authority_tier, coalesce(n.enabled, k.enabled, TRUE) AS enabled FROM known_sources k FULL JOIN seen_sources n ON k.name = n.name",
        "f20_find_source": f"{_with('attempts')}, s(name, tier) AS (VALUES {sites}) SELECT attempt_id, s.name, CAST(s.tier AS INTEGER) AS tier FROM attempts a LEFT JOIN s ON {key('s.name')} = {key('a.domain')}",
        "f19_canonical_source": f"{_with('evidence')} SELECT investigation_id, ev_seq, {canonical} AS source FROM evidence",
        "s10_replace_risk_signals": f"{ctes('investigations', 'evidence')}{signals} SELECT s.investigation_id, code, CAST(risk_weight * CASE WHEN i.status = 'FAILED' THEN 2 ELSE 1 END AS INTEGER) AS risk_weight FROM signals s LEFT JOIN investigations i ON i.investigation_id = s.investigation_id",
        "s11_append_report_version": f"{_with('versions', 'investigations')} SELECT * FROM versions UNION ALL SELECT i.investigation_id, CAST(coalesce(max(v.version), 0) + 1 AS INT), 'PENDING' FROM investigations i LEFT JOIN versions v ON v.investigation_id = i.investigation_id GROUP BY 1",
        "s12_append_events": f"{_with('created', 'audit_events')} SELECT * FROM created UNION ALL SELECT investigation_id, event_type, node, event_type, CAST(to_json({{'event_id': event_id}}) AS VARCHAR), created_at FROM audit_events",
        "s13_export_json": f"{_with('versions')} SELECT investigation_id, CAST(to_json({{'investigation_id': investigation_id, 'version': version, 'qa_status': qa_status}}) AS VARCHAR) AS document FROM versions QUALIFY row_number() OVER (PARTITION BY investigation_id ORDER BY version DESC) = 1",
        "s17_append_attempts": f"{_with('tries')} SELECT attempt_id, investigation_id, domain, status, CAST(greatest(CASE WHEN url <> '' THEN 1 ELSE 0 END, action_count) AS INT) AS action_count, CAST(to_json({{'source_name': source_name, 'source_type': CASE WHEN domain IN ('gst.gov.in', 'mca.gov.in') THEN 'preferred' ELSE 'fallback' END, 'url': url, 'attempt_order': attempt_order}}) AS VARCHAR) AS metadata_json FROM tries",
        "s18_stamp_qa": f"{_with('versions', 'verdicts')} SELECT v.investigation_id, v.version, CASE WHEN v.version = max(v.version) OVER (PARTITION BY v.investigation_id) AND d.status IS NOT NULL THEN d.status ELSE v.qa_status END AS qa_status FROM versions v LEFT JOIN verdicts d ON d.investigation_id = v.investigation_id",
        "w10_report_versions": f"{_with('versions')} SELECT investigation_id, version, CAST(row_number() OVER (PARTITION BY investigation_id ORDER BY version) AS INT) AS nth FROM versions",
        "k4_events_in_order": f"{_with('audit_events')} SELECT investigation_id, event_id, CAST(row_number() OVER (PARTITION BY investigation_id ORDER BY created_at, event_id) AS INT) AS pos FROM audit_events",
        "f15_f16_line_shapes": f"{texts}, l AS (SELECT page_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM texts), e AS (SELECT page_id, unnest(range(1, len(ls) + 1)) AS i, unnest(ls) AS line FROM l) SELECT page_id, CAST(i - 1 AS INT) AS pos, {X.sql_is_legal_name('line')} AS legal_name, {X.sql_is_activity('line')} AS activity FROM e",
        "f17_compare_fields": f"{_with('evidence')}, p AS (SELECT investigation_id, ev_seq, field_name, field_value, lead(field_name) OVER w AS f2, lead(field_value) OVER w AS v2, lead(ev_seq) OVER w AS n FROM evidence WINDOW w AS (PARTITION BY investigation_id ORDER BY ev_seq)) SELECT investigation_id, ev_seq, CASE WHEN field_name <> f2 THEN 'NOT_COMPARABLE' WHEN coalesce(field_value, '') = '' OR coalesce(v2, '') = '' THEN 'UNAVAILABLE' WHEN {same} THEN 'MATCH' ELSE 'CONFLICT' END AS outcome FROM p WHERE n IS NOT NULL",
        "f18_recommendation": f"{ctes('investigations', 'evidence')}{signals}{sums} SELECT investigation_id, {recommend} AS recommendation FROM scores",
        "f22_f23_next_step": f"{_with('checks')} SELECT investigation_id, {step} AS next_step, CASE WHEN status = 'PASS' THEN 'COMPLETED' WHEN loops >= 2 THEN 'FAILED' ELSE 'FAILED_QA' END AS final_status FROM checks",
        "f25_stage_progress": f"{_with('investigations', 'audit_events')}, d AS (SELECT i.investigation_id, upper(i.status) AS status, upper(coalesce(n.node, '')) AS node FROM investigations i LEFT JOIN (SELECT investigation_id, arg_max(node, (created_at, event_id)) AS node FROM audit_events GROUP BY 1) n ON n.investigation_id = i.investigation_id) {Y.sql_stage_progress()}",
        "a6_consistency_records": f"{_with('evidence', 'requests')}{records} SELECT * FROM records",
        "j15_unsafe_wording": f"{ctes('evidence')}{signals}{wording} SELECT * FROM wording",
        "j18_score_mismatch": f"{_with('investigations', 'evidence', 'requests')}{signals}{sums}{reported} {mismatch}",
        "a7_grounding_coverage": f"{ctes('investigations', 'evidence')}{grounded}{coverage} SELECT * FROM coverage",
        "a8_qa_verdict": f"""{_with('investigations', 'evidence', 'requests')}{signals}{sums}{grounded}{coverage}{wording}{reported}, issues AS (SELECT investigation_id, 'MISSING_EVIDENCE' AS kind FROM grounded WHERE problem IS NOT NULL UNION ALL SELECT investigation_id, 'REPORT_WORDING' FROM wording
    UNION ALL SELECT investigation_id, 'UNSUPPORTED_CLAIM' FROM ({core['j16_contradicted_findings']}) UNION ALL SELECT investigation_id, 'WRONG_ENTITY' FROM ({dropped}) UNION ALL SELECT investigation_id, 'WRONG_ENTITY' FROM reported WHERE coalesce(business_name, '') = '' OR (level <> 'INSUFFICIENT_EVIDENCE' AND entity_confidence < 0.5)
    UNION ALL SELECT investigation_id, 'WRONG_RISK_SCORE' FROM ({mismatch})),
  per AS (SELECT investigation_id, list_sort(list(DISTINCT kind)) AS l FROM issues GROUP BY 1)
SELECT i.investigation_id, CASE WHEN p.l IS NULL THEN 'PASS' ELSE 'FAIL' END AS status, coalesce(array_to_string(p.l, ','), '') AS issues, c.coverage, NOT coalesce(list_contains(p.l, 'WRONG_RISK_SCORE'), FALSE) AS score_verified, NOT coalesce(list_contains(p.l, 'WRONG_ENTITY'), FALSE) AS entity_verified FROM investigations i LEFT JOIN per p ON p.investigation_id = i.investigation_id LEFT JOIN coverage c ON c.investigation_id = i.investigation_id""",
        "a14_build_reports": f"""{_with('investigations', 'evidence', 'attempts', 'requests')}{signals}{sums}{status}, {limited}{records},
  listed AS MATERIALIZED (SELECT investigation_id, string_agg(research_result_id || '=' || ev_seq, ',' ORDER BY research_result_id, ev_seq) AS evidence,
    string_agg(research_result_id || '=' || field_name, ',' ORDER BY research_result_id, ev_seq) FILTER (confidence < 0.5 AND upper(trim(field_value)) NOT IN ({", ".join(f"'{c}'" for c in R.NO_VALUE)})) AS unverified FROM evidence GROUP BY 1),
  risks AS MATERIALIZED (SELECT investigation_id, string_agg(code || '=' || risk_weight, ',' ORDER BY code) AS findings, CAST(least(coalesce(sum(risk_weight) FILTER (lower(category) = 'compliance'), 0), 100) AS INTEGER) AS comp FROM signals GROUP BY 1),
  short AS MATERIALIZED (SELECT investigation_id, string_agg(source || '=' || status, ',' ORDER BY source, status) AS limitations FROM limits GROUP BY 1),
  tried AS MATERIALIZED (SELECT investigation_id, string_agg(domain || '=' || status || '=' || n, ',' ORDER BY domain) AS attempts FROM (SELECT investigation_id, domain, arg_min(status, (-({rank}), attempt_id)) AS status, count(*) AS n FROM attempts GROUP BY 1, 2) GROUP BY 1),
  agree AS MATERIALIZED (SELECT investigation_id, string_agg(field_key || '=' || status, ',' ORDER BY field_key) AS consistency FROM records GROUP BY 1),
  portal AS MATERIALIZED (SELECT investigation_id, max(status) FILTER (category = 'gst') AS gst, max(status) FILTER (category = 'mca') AS mca FROM status GROUP BY 1),
  prim AS MATERIALIZED ({core['a12_primary_source']}),
  cand AS MATERIALIZED (SELECT investigation_id, CAST(ev_seq AS BIGINT) * 1048576 + pos AS candidate_id, x.name AS name, x.gstin AS gstin, x.cin AS cin FROM (SELECT investigation_id, ev_seq, unnest(range(len(l))) AS pos, unnest(l) AS x FROM (SELECT *, from_json(field_value, '[{{"name":"VARCHAR","gstin":"VARCHAR","cin":"VARCHAR"}}]') AS l FROM evidence WHERE field_name = 'candidate_entities' AND confidence >= 0.5))),
  chosen AS MATERIALIZED ({resolution}),
  ent AS (SELECT n.investigation_id, {", ".join(f"CASE WHEN coalesce(c.{f}, '') <> '' AND upper(trim(c.{f})) NOT IN ('NOT_FOUND', 'UNAVAILABLE', 'NONE') THEN c.{f} ELSE n.{'business_name' if f == 'name' else f} END AS {f}" for f in ("name", "gstin", "cin"))}, match_type AS resolution_status, round(confidence, 4) AS entity_confidence
    FROM norm_in n JOIN chosen r ON r.target_id = n.investigation_id LEFT JOIN cand c ON c.investigation_id = n.investigation_id AND c.candidate_id = r.candidate_id)
SELECT n.investigation_id, n.name, n.gstin, n.cin, n.resolution_status, n.entity_confidence, s.score, s.level, CASE WHEN s.bare THEN 'INSUFFICIENT_EVIDENCE' ELSE 'COMPLETED' END AS assessment_status, CASE WHEN s.bare THEN array_to_string(list_filter([CASE WHEN limitations IS NOT NULL OR coalesce(gst <> 'VERIFIED', FALSE) OR coalesce(mca <> 'VERIFIED', FALSE) THEN 'AUTHORITATIVE_SOURCES_UNAVAILABLE' END,
    CASE WHEN coalesce(n.gstin, '') = '' AND coalesce(n.cin, '') = '' THEN 'NO_VERIFIED_ENTITY_RECORD' END, 'INSUFFICIENT_EVIDENCE'], lambda x: x IS NOT NULL), ',') ELSE '' END AS reason_codes,
   primary_source, gst, CASE WHEN NOT s.bare AND findings IS NOT NULL THEN comp END AS compliance, {recommend} AS recommendation, coalesce(findings, '') AS findings, coalesce(limitations, '') AS limitations, coalesce(attempts, '') AS attempts, coalesce(unverified, '') AS unverified, coalesce(evidence, '') AS evidence, consistency
FROM ent n JOIN scores s ON s.investigation_id = n.investigation_id JOIN agree ag ON ag.investigation_id = n.investigation_id LEFT JOIN listed l ON l.investigation_id = n.investigation_id LEFT JOIN risks k ON k.investigation_id = n.investigation_id LEFT JOIN short h ON h.investigation_id = n.investigation_id
  LEFT JOIN tried t ON t.investigation_id = n.investigation_id LEFT JOIN portal o ON o.investigation_id = n.investigation_id LEFT JOIN prim p ON p.investigation_id = n.investigation_id""",
        "t1_tail_events": f"{_with('audit_events')} SELECT event_id, investigation_id, node FROM audit_events",
        "t3_stream_attempts": f"{_with('attempts')} SELECT investigation_id, domain, arg_min(status, (-({rank}), attempt_id)) AS status, count(*) AS attempts FROM attempts GROUP BY 1, 2",
        "t4_stream_latest_status": core["t4_latest_status"],
    }


def _words_sql(v: str) -> str:
    stop = ", ".join(f"'{w}'" for w in R.STOPWORDS)
    return f"list_distinct(list_transform(list_filter(regexp_split_to_array(upper({v}), '\\s+'), lambda x: x NOT IN ({stop}) AND length(x) > 2), lambda x: regexp_replace(x, '^[,.;:]+|[,.;:]+$', '', 'g')))"
