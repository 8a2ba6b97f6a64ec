"""Report pieces: source status, attempts, consistency, limitations, versions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from probitas.functions import text as X
from probitas.sources.catalog import lookup_key

# Categories, ranks and labels that reports depend on.
CATEGORIES = ("gst", "mca", "epfo", "official_website", "third_party", "general_web")
LABELS = {"gst": "GST Portal", "mca": "MCA Portal", "epfo": "EPFO Portal", "official_website": "Company Website", "third_party": "Third-Party Registry", "general_web": "General Web"}
THIRD_PARTY = ("third_party", "third-party", "third party", "zauba", "tofler", "quickcompany", "quick company", "instafinancial", "registry", "directory")
ATTEMPT_RANK = {"SUCCESS": 6, "NO_DATA": 5, "NO_RESULTS": 5, "NOT_FOUND": 5, "REJECTED": 4, "ENTITY_MISMATCH": 4, "UNRELATED": 4, "IRRELEVANT_CONTENT": 3, "IRRELEVANT_SECTOR": 3, "IRRELEVANT": 3, "CAPTCHA_REQUIRED": 2, "BLOCKED": 2, "BLOCKED_OR_ERROR": 2, "ERROR": 1, "EMPTY_RESPONSE": 1}
AUTHORITY = (("gst",), ("mca",), ("epf",), ("company website", "official website"), ("zauba", "tofler", "quickcompany", "quick company", "instafinancials", "third-party", "third party", "registry"), ("web",))
DETAILS = {"VERIFIED": "Evidence obtained and verified against target entity.", "CAPTCHA_REQUIRED": "Source requires human verification or CAPTCHA challenge.", "BLOCKED": "Source access was blocked or timed out.", "NOT_FOUND": "Target entity record not found in this registry."}
NO_RESEARCH, NO_DETAIL = "No research evidence retrieved from this source.", "Source information unavailable or unverified."
LIMITATIONS = ("UNAVAILABLE", "BLOCKED", "CAPTCHA_REQUIRED", "NOT_FOUND")
UNUSABLE = ("NOT_FOUND", "UNAVAILABLE", "SOURCE_UNAVAILABLE", "BLOCKED", "TIMEOUT", "NONE", "ERROR")
NO_VALUE = ("NOT_FOUND", "UNAVAILABLE", "NONE", "BLOCKED", "ERROR", "UNKNOWN")
CONSISTENCY_FIELDS = ("legal_name", "gstin", "cin", "registered_address", "establishment_address", "contact_address", "principal_business_address", "company_status", "business_activity", "incorporation_date", "website")
FIELD_LABELS = ("Legal Entity Name", "GSTIN Identifier", "CIN Identifier", "Registered Office Address", "EPFO Establishment Address", "Official Contact Address", "Principal Place of Business", "Active Company Status", "Business Activity / Sector", "Incorporation Date", "Official Domain / Website")
SCORE_CATEGORIES = ("identity", "registration", "compliance", "consistency", "operational", "activity", "public_footprint")
RECOMMENDATIONS = (
    "Based on available public evidence, a complete risk assessment could not be finalized because insufficient verified external registry evidence was accessible.",
    "Based on available public evidence, high risk was detected. Additional manual compliance verification is strongly recommended before proceeding with this business partner.",
    "Based on available public evidence, moderate risk was detected. Specific field discrepancies or status limitations require manual verification.",
    "Based on available public evidence, low risk was detected. Standard regulatory and business verification criteria were met.",
)
STOPWORDS = ("AND", "THE", "OF", "IN", "FOR", "TO", "A", "AN", "PVT", "LTD", "LIMITED", "INC", "LLP", "CO", "COMPANY", "SERVICES", "SOLUTIONS", "DEVELOPMENT", "&", "-")


def _any(c: Column, words) -> Column:
    return reduce(lambda a, b: a | b, (c.contains(w) for w in words))


def source_category(name: Column, registered: Column | None = None) -> Column:
    """registered: whether the source is registered as a third-party registry."""
    low = F.lower(F.coalesce(name, F.lit("")))
    third = _any(low, THIRD_PARTY) if registered is None else registered | _any(low, THIRD_PARTY)
    return F.when(low.contains("gst"), "gst").when(low.contains("mca"), "mca").when(low.contains("epf"), "epfo").when(third, "third_party").when(_any(low, ("website", "company")), "official_website").otherwise("general_web")


def domain_category(domain: Column) -> Column:
    low = F.lower(F.coalesce(domain, F.lit("")))
    return F.when(low.contains("gst"), "gst").when(low.contains("mca"), "mca").when(low.contains("epf"), "epfo").when(low.contains("website"), "official_website").when(_any(low, ("third_party", "zauba", "tofler", "quick", "insta")), "third_party").otherwise("general_web")


def source_status(ev: DataFrame, catalog: DataFrame) -> DataFrame:
    """(investigation_id, category, status, details, evidence_count): six rows for each investigation with
    evidence; the best outcome of a source wins over its failures. A source that the catalogue has as
    a third-party registry is one whatever its name says."""
    value = F.upper(F.trim(F.coalesce("field_value", F.lit(""))))
    said = F.upper(F.trim(F.coalesce("verification_status", F.lit(""))))
    verified = ~value.isin("NOT_FOUND", "UNAVAILABLE", "NONE", "BLOCKED") & F.when(said != "", said == "VERIFIED").otherwise(F.coalesce("confidence", F.lit(0.0)) >= 0.70)
    use = F.col("field_name") != "candidate_entities"
    flags = F.struct(use.alias("use"), (use & verified).alias("v"), (use & (value.contains("CAPTCHA") | F.upper("field_name").contains("CAPTCHA"))).alias("c"), (use & value.isin("BLOCKED", "SOURCE_UNAVAILABLE", "TIMEOUT")).alias("b"), (use & value.isin("NOT_FOUND", "NONE")).alias("n"))
    third = catalog.filter("kind = 'THIRD_PARTY_REGISTRY'").select(lookup_key(F.col("name")).alias("key_"), F.lit(True).alias("third_")).distinct()
    cat = source_category(F.col("source_name"), F.coalesce("third_", F.lit(False)))
    per = []
    for c in CATEGORIES:
        on = lambda f, c=c: F.bool_or((F.col("cat") == c) & F.col(f"f.{f}"))
        n = F.count_if((F.col("cat") == c) & F.col("f.use"))
        status = F.when(on("v"), "VERIFIED").when(on("c"), "CAPTCHA_REQUIRED").when(on("b"), "BLOCKED").when(on("n"), "NOT_FOUND").otherwise("UNAVAILABLE")
        per.append(F.struct(F.lit(c).alias("category"), status.alias("status"), n.alias("evidence_count")))
    rows = ev.withColumn("key_", lookup_key(F.col("source_name"))).join(F.broadcast(third), "key_", "left")
    g = rows.select("investigation_id", cat.alias("cat"), flags.alias("f")).groupBy("investigation_id").agg(F.array(*per).alias("x"))
    details = reduce(lambda c, kv: c.when(F.col("x.status") == kv[0], kv[1]), DETAILS.items(), F.when(F.col("x.evidence_count") == 0, NO_RESEARCH)).otherwise(NO_DETAIL)
    return g.select("investigation_id", F.explode("x").alias("x")).select("investigation_id", "x.category", "x.status", details.alias("details"), "x.evidence_count")


def attempt_rank(status: Column) -> Column:
    return reduce(lambda c, kv: c.when(status == kv[0], kv[1]), ATTEMPT_RANK.items(), F.when(F.lit(False), 0)).otherwise(0)


def attempt_rollup(attempts: DataFrame) -> DataFrame:
    """(investigation_id, domain, status, attempts): the best status, the first of equal rank."""
    d = attempts.select("investigation_id", F.trim("domain").alias("domain"), F.upper(F.trim(F.coalesce("status", F.lit("")))).alias("status"), "attempt_id").filter("domain <> ''")
    best = F.max_by("status", F.struct(attempt_rank(F.col("status")).alias("r"), -F.col("attempt_id")))
    return d.groupBy("investigation_id", "domain").agg(best.alias("status"), F.count("*").alias("attempts"))


def attempt_counters(attempts: DataFrame) -> DataFrame:
    """(investigation_id, total, success, blocked, irrelevant, selected, fallback_used, failed) of attempts (attempt_id,
    domain, status, source_type): selected is the domain of the first success, failed is the rest."""
    ok = F.col("status") == "SUCCESS"
    blocked = F.col("status").isin("BLOCKED", "BLOCKED_OR_ERROR", "CAPTCHA_REQUIRED")
    irrelevant = F.col("status").isin("REJECTED", "IRRELEVANT", "IRRELEVANT_CONTENT", "IRRELEVANT_SECTOR")
    d = attempts.groupBy("investigation_id").agg(F.count("*").alias("total"), F.count_if(ok).alias("success"), F.count_if(blocked).alias("blocked"), F.count_if(irrelevant).alias("irrelevant"), F.min_by(F.when(ok, F.col("domain")), F.when(ok, F.col("attempt_id"))).alias("selected"), F.coalesce(F.bool_or(F.col("source_type") == "fallback"), F.lit(False)).alias("fallback_used"))
    return d.withColumn("failed", F.col("total") - F.col("success") - F.col("blocked") - F.col("irrelevant"))


def primary_source(ev: DataFrame) -> DataFrame:
    """(investigation_id, primary_source): highest authority, then confidence, then name."""
    low = F.lower(F.trim("source_name"))
    rank = reduce(lambda c, g: c.when(_any(low, g[1]), g[0]), enumerate(AUTHORITY), F.when(F.lit(False), 0)).otherwise(len(AUTHORITY))
    usable = (F.col("confidence") >= 0.5) & ~F.upper(F.trim("field_value")).isin(*UNUSABLE)
    return ev.filter(usable).groupBy("investigation_id").agg(F.min_by(F.trim("source_name"), F.struct(rank.alias("r"), -F.col("confidence"), low.alias("n"), F.col("ev_seq"))).alias("primary_source"))


def unverified_information(ev: DataFrame) -> DataFrame:
    return ev.filter((F.col("confidence") < 0.5) & ~F.upper(F.trim("field_value")).isin(*NO_VALUE))


def source_limitations(status: DataFrame, attempts: DataFrame) -> DataFrame:
    """(investigation_id, source, status): limited sources that were tried at all."""
    tried = attempts.groupBy("investigation_id").agg(F.collect_set(domain_category(F.col("domain"))).alias("tried_"))  # six at most
    label = reduce(lambda c, kv: c.when(F.col("category") == kv[0], kv[1]), LABELS.items(), F.when(F.lit(False), "")).otherwise(F.col("category"))
    return status.filter(F.col("status").isin(*LIMITATIONS)).join(tried, "investigation_id").filter(F.array_contains("tried_", F.col("category"))).select("investigation_id", label.alias("source"), "status")


def reconcile_attempts(attempts: DataFrame, ev: DataFrame) -> DataFrame:
    """attempts (source_name, ...) with final_status and selected: a success whose source, by its name,
    left no usable evidence in the investigation is NO_DATA."""
    name = lambda c: F.lower(F.trim(F.coalesce(F.col(c), F.lit(""))))
    usable = (F.col("confidence") > 0) & ~F.upper(F.trim("field_value")).isin(*UNUSABLE) & (name("source_name") != "")
    sources = ev.filter(usable).select("investigation_id", name("source_name").alias("source_")).distinct().withColumn("has_", F.lit(True))
    d = attempts.withColumn("source_", name("source_name")).join(sources, ["investigation_id", "source_"], "left")
    has = F.coalesce("has_", F.lit(False))
    final = F.when((F.col("status") == "SUCCESS") & ~has, "NO_DATA").otherwise(F.col("status"))
    return d.select(*attempts.columns, final.alias("final_status"), ((F.col("status") == "SUCCESS") & has).alias("selected"))


def _words(v: Column) -> Column:
    kept = F.filter(F.split(F.upper(v), r"(?U)\s+"), lambda w: ~w.isin(*STOPWORDS) & (F.length(w) > 2))
    return F.array_distinct(F.transform(kept, lambda w: F.regexp_replace(w, r"^[,.;:]+|[,.;:]+$", "")))


def _last_values(ev: DataFrame) -> DataFrame:
    """(investigation_id, field_key, source, v, at): the last value of each source, and the place of its first row."""
    ok = F.col("field_name").isin(*CONSISTENCY_FIELDS) & (F.col("confidence") >= 0.5) & ~F.upper(F.trim("field_value")).isin(*NO_VALUE)
    rows = ev.filter(ok).select("investigation_id", F.col("field_name").alias("field_key"), F.col("source_name").alias("source"), F.trim("field_value").alias("v"), "ev_seq")
    return rows.groupBy("investigation_id", "field_key", "source").agg(F.max_by("v", "ev_seq").alias("v"), F.min("ev_seq").cast("long").alias("at"))


def _values(ev: DataFrame) -> DataFrame:
    """(investigation_id, field_key, vs): the last value of each source as (at, source, v), in the order of
    the sources' first rows."""
    return _last_values(ev).groupBy("investigation_id", "field_key").agg(F.array_sort(F.collect_list(F.struct("at", "source", "v"))).alias("vs"))


def _agreement(vs: Column, key: Column) -> Column:
    """Later values are compared with the first one."""
    plain = F.array_distinct(F.transform(vs, lambda x: F.upper(x["v"])))
    forms = F.array_distinct(F.transform(vs, lambda x: X.norm_address(x["v"])))
    first = _words(plain[0])
    near = F.exists(F.slice(plain, 2, 1 << 20), lambda v: F.coalesce(F.size(F.array_intersect(first, _words(v))) / F.nullif(F.size(F.array_union(first, _words(v))), F.lit(0)) >= 0.40, F.lit(False)) & (F.size(first) > 0) & (F.size(_words(v)) > 0))
    return F.when(key.endswith("address"), F.when(F.size(forms) == 1, "MATCH").otherwise("CONFLICT")).when(F.size(plain) == 1, "MATCH").when(near, "PARTIAL_MATCH").otherwise("CONFLICT")


def consistency(ev: DataFrame) -> DataFrame:
    """(investigation_id, field_key, status, n_sources) for the fields with a value."""
    return _values(ev).select("investigation_id", "field_key", _agreement(F.col("vs"), F.col("field_key")).alias("status"), F.size("vs").cast("long").alias("n_sources"))


def consistency_records(ev: DataFrame, entities: DataFrame) -> DataFrame:
    """(investigation_id, field_key, field, status, sources, analysis): a record of every field for each
    row of entities, whose own values count as the source User Input; a field without any is UNAVAILABLE."""
    own = [c for c in CONSISTENCY_FIELDS if c in entities.columns]
    entry = "array<struct<field_key:string,at:bigint,source:string,v:string>>"
    given = F.array_compact(F.array(*(F.when((F.trim(F.coalesce(F.col(c), F.lit(""))) != "") & ~F.upper(F.trim(c)).isin("NOT_FOUND", "UNAVAILABLE", "NONE", "UNKNOWN"), F.struct(F.lit(c), F.lit(1 << 62), F.lit("User Input"), F.trim(c))) for c in own))).cast(entry)
    # one row an investigation until its records are made, so that values are shuffled by investigation alone
    found = _last_values(ev).groupBy("investigation_id").agg(F.collect_list(F.struct("field_key", "at", "source", "v")).cast(entry).alias("found_"))
    d = entities.select("investigation_id", given.alias("given_")).join(found, "investigation_id", "left").withColumn("found_", F.coalesce("found_", F.array().cast(entry)))

    def record(key: str, name: str) -> Column:
        here = F.filter("found_", lambda x: x["field_key"] == key)
        users = F.filter("given_", lambda x: (x["field_key"] == key) & ~F.exists(here, lambda y: F.coalesce(y["source"] == "User Input", F.lit(False))))
        vs = F.array_sort(F.transform(F.concat(here, users), lambda x: F.struct(x["at"].alias("at"), x["source"].alias("source"), x["v"].alias("v"))))
        return F.struct(F.lit(key).alias("field_key"), F.lit(name).alias("field"), F.when(F.size(vs) > 0, vs).alias("vs"))

    records = F.array(*(record(k, n) for k, n in zip(CONSISTENCY_FIELDS, FIELD_LABELS, strict=True)))
    d = d.select("investigation_id", F.explode(records).alias("r_")).select("investigation_id", "r_.*")
    d = d.withColumn("status", F.when(F.col("vs").isNull(), "UNAVAILABLE").otherwise(_agreement(F.col("vs"), F.col("field_key"))))
    names = F.array_join(F.transform("vs", lambda x: x["source"]), ", ")
    pairs = F.array_join(F.transform("vs", lambda x: F.concat(x["source"], F.lit(": "), x["v"])), "; ")
    uppers = F.array_distinct(F.transform("vs", lambda x: F.upper(x["v"])))
    forms = F.array_join(F.transform(uppers, lambda u: F.element_at(F.filter("vs", lambda x: F.upper(x["v"]) == u), -1)["v"]), ", ")
    text = F.when(F.col("status") == "UNAVAILABLE", "No verified evidence available from any source for comparison.").when(F.col("status") == "MATCH", F.concat(F.lit("All sources ("), names, F.lit(") are fully consistent.")))
    text = text.when(F.col("status") == "PARTIAL_MATCH", F.concat(F.lit("Minor formatting or text variations observed across sources: "), forms, F.lit(".")))
    text = text.when(F.col("field_key").endswith("address"), F.concat(F.lit("Conflicting address data reported across sources: "), pairs, F.lit("."))).otherwise(F.concat(F.lit("Conflicting data reported across sources: "), pairs, F.lit(".")))
    sources = F.coalesce(F.transform("vs", lambda x: F.struct(x["source"].alias("source"), x["v"].alias("value"))), F.array().cast("array<struct<source:string,value:string>>"))
    return d.select("investigation_id", "field_key", "field", "status", sources.alias("sources"), text.alias("analysis"))


def reason_codes(insufficient: Column, limited: Column, gst: Column, mca: Column, gstin: Column, cin: Column) -> Column:
    """Why an assessment is insufficient; empty if it isn't. limited: some source is a limitation."""
    blank = lambda c: F.coalesce(c, F.lit("")) == ""
    away = F.coalesce(limited, F.lit(False)) | F.coalesce(gst.isin(*LIMITATIONS), F.lit(False)) | F.coalesce(mca.isin(*LIMITATIONS), F.lit(False))
    codes = F.array(F.when(away, "AUTHORITATIVE_SOURCES_UNAVAILABLE"), F.when(blank(gstin) & blank(cin), "NO_VERIFIED_ENTITY_RECORD"), F.lit("INSUFFICIENT_EVIDENCE"))
    return F.when(insufficient, F.array_compact(codes)).otherwise(F.array().cast("array<string>"))


def compare_fields(field_a: Column, value_a: Column, field_b: Column, value_b: Column) -> Column:
    address = field_a.isin("registered_address", "establishment_address", "contact_address", "principal_business_address", "address")
    a, b = X.norm_address(value_a), X.norm_address(value_b)
    same = F.when(address, (a != "") & (a == b)).otherwise(F.lower(F.trim(value_a)) == F.lower(F.trim(value_b)))
    missing = (F.coalesce(value_a, F.lit("")) == "") | (F.coalesce(value_b, F.lit("")) == "")
    return F.when(field_a != field_b, "NOT_COMPARABLE").when(missing, "UNAVAILABLE").when(same, "MATCH").otherwise("CONFLICT")


def recommendation(score: Column) -> Column:
    return F.when(score.isNull(), RECOMMENDATIONS[0]).when(score >= 61, RECOMMENDATIONS[1]).when(score >= 31, RECOMMENDATIONS[2]).otherwise(RECOMMENDATIONS[3])


def append_report_version(reports: DataFrame, new: DataFrame) -> DataFrame:
    """new (investigation_id, ...) with version = last + 1 and qa_status PENDING, appended."""
    last = reports.groupBy("investigation_id").agg(F.max("version").alias("_v"))
    rows = new.join(last, "investigation_id", "left").withColumns({"version": (F.coalesce("_v", F.lit(0)) + 1).cast("int"), "qa_status": F.lit("PENDING")}).drop("_v")
    return reports.unionByName(rows, allowMissingColumns=True)


def latest_reports(reports: DataFrame) -> DataFrame:
    w = Window.partitionBy("investigation_id").orderBy(F.desc("version"))
    return reports.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def stamp_qa(reports: DataFrame, verdict: DataFrame) -> DataFrame:
    """PASS or FAIL of verdict (investigation_id, status), on the latest version only."""
    newest = reports.groupBy("investigation_id").agg(F.max("version").alias("_v"))
    d = reports.join(newest, "investigation_id").join(verdict.withColumnRenamed("status", "_q"), "investigation_id", "left")
    return d.withColumn("qa_status", F.when((F.col("version") == F.col("_v")) & F.col("_q").isNotNull(), F.col("_q")).otherwise(F.col("qa_status"))).drop("_v", "_q")


def report_versions(reports: DataFrame) -> DataFrame:
    """reports with nth, their place among the investigation's versions in rising order."""
    return reports.withColumn("nth", F.row_number().over(Window.partitionBy("investigation_id").orderBy("version")))


def build_reports(entities: DataFrame, scores: DataFrame, signals: DataFrame, status: DataFrame, limitations: DataFrame, attempts: DataFrame, ev: DataFrame) -> DataFrame:
    """One nested report for each row of entities (investigation_id, business_name, gstin, cin, ...,
    entity_confidence): every child is aggregated to a row an investigation before it is joined."""
    i = "investigation_id"
    many = lambda d, out, *cols: d.groupBy(i).agg(F.array_sort(F.collect_list(F.struct(*cols))).alias(out))
    cats = F.map_from_entries(F.collect_list(F.struct("category", F.struct("status", "details", "evidence_count")))).alias("verification_summary")
    parts = [
        scores.select(i, "score", "level", "insufficient_evidence"),
        many(signals, "major_findings", "code", "category", "severity", "evidence_ids", "confidence", "risk_weight"),
        status.groupBy(i).agg(cats),
        primary_source(ev),
        many(consistency_records(ev, entities), "cross_source_consistency", "field_key", "field", "status", "sources", "analysis"),
        many(limitations, "source_limitations", "source", "status"),
        many(attempt_rollup(attempts), "source_attempt_status", "domain", "status", "attempts"),
        many(unverified_information(ev), "unverified_information", "research_result_id", "ev_seq", "field_name", "field_value", "source_name"),
        many(ev, "evidence_summary", "research_result_id", "ev_seq", "task_id", "field_name", "field_value", "source_name", "retrieved_at", "confidence"),
        signals.groupBy(i).agg(F.struct(*(F.least(F.coalesce(F.sum(F.when(F.lower("category") == c, F.col("risk_weight"))), F.lit(0)), F.lit(100)).cast("int").alias(c) for c in SCORE_CATEGORIES)).alias("category_scores")),
    ]
    d = entities.select(i, "entity_confidence", F.struct(*(c for c in entities.columns if c not in (i, "entity_confidence"))).alias("entity"))
    for p in parts:
        d = d.join(p, i, "left")
    codes = reason_codes(F.col("insufficient_evidence"), F.size("source_limitations") > 0, F.col("verification_summary")["gst"]["status"], F.col("verification_summary")["mca"]["status"], F.col("entity.gstin"), F.col("entity.cin"))
    full = lambda c: F.coalesce(F.col(c), F.array().cast(d.schema[c].dataType)).alias(c)
    return d.select(i, "entity", "entity_confidence", F.struct("score", "level").alias("overall_risk"), F.when(F.col("insufficient_evidence"), "INSUFFICIENT_EVIDENCE").otherwise("COMPLETED").alias("assessment_status"), codes.alias("reason_codes"), "verification_summary", "primary_source",
                    *map(full, ("cross_source_consistency", "source_limitations", "source_attempt_status")), F.when(~F.col("insufficient_evidence"), F.col("category_scores")).alias("category_scores"), full("major_findings"), full("unverified_information"), recommendation(F.col("score")).alias("recommendation"), full("evidence_summary"))


def export_report_json(reports: DataFrame) -> DataFrame:
    """(investigation_id, document) of each investigation's latest version."""
    return latest_reports(reports).select("investigation_id", F.to_json(F.struct(*reports.columns)).alias("document"))


def export_report_sections(entities: DataFrame, scores: DataFrame, categories: DataFrame, findings: DataFrame, ev: DataFrame) -> DataFrame:
    """(investigation_id, section_no, line_no, cells): entity, risk summary, category scores, findings by
    code and evidence by ev_seq, of each investigation in scores; line 0 of the last three is their
    header. Missing identifiers are N/A, a missing score 0 and a missing level UNKNOWN."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    cells_of = lambda *x: F.array(*(c if isinstance(c, Column) else F.lit(c) for c in x))
    known = lambda c: F.coalesce(F.when(F.col(c) != "", F.col(c)), F.lit("N/A"))
    kinds = [c for c in categories.columns if c != "investigation_id"]
    line = F.struct("code", cells_of(text("code"), text("category"), text("severity"), text("confidence"), text("risk_weight"), F.array_join("evidence_ids", ", ")).alias("cells"))
    found = findings.groupBy("investigation_id").agg(F.array_sort(F.collect_list(line)).alias("found"))
    d = scores.join(entities.select("investigation_id", "business_name", "gstin", "cin", "website"), "investigation_id", "left").join(categories, "investigation_id", "left").join(found, "investigation_id", "left")
    none = F.array().cast("array<array<string>>")
    sections = (
        [cells_of(label, known(c)) for label, c in (("Business Name", "business_name"), ("GSTIN", "gstin"), ("CIN", "cin"), ("Website", "website"))],
        [cells_of("Overall Risk Score", F.coalesce("score", F.lit(0)).cast("string")), cells_of("Overall Risk Level", F.coalesce("level", F.lit("UNKNOWN"))), cells_of("Recommendation", recommendation(F.col("score")))],
        [cells_of("Category", "Score"), *(cells_of(c, F.coalesce(F.col(c), F.lit(0)).cast("string")) for c in kinds)],
        [cells_of("Code", "Category", "Severity", "Confidence", "Risk Weight", "Evidence IDs")],
    )
    entry = lambda section, line, cells: F.struct(F.lit(section).alias("section_no"), line.alias("line_no"), cells.alias("cells"))
    lines = [F.array(*(entry(n, F.lit(i), c) for i, c in enumerate(x))) for n, x in enumerate(sections, 1)]
    lines.append(F.transform(F.coalesce(F.transform("found", lambda x: x["cells"]), none), lambda c, i: entry(4, i + 1, c)))
    lines.append(F.array(entry(5, F.lit(0), cells_of("Evidence ID", "Task ID", "Field Name", "Source Name", "Confidence"))))
    head = d.select("investigation_id", F.explode(F.flatten(F.array(*lines))).alias("l")).select("investigation_id", "l.*")
    number = F.row_number().over(Window.partitionBy("investigation_id").orderBy("ev_seq"))
    body = ev.join(scores.select("investigation_id"), "investigation_id", "left_semi").select("investigation_id", F.lit(5).alias("section_no"), number.alias("line_no"), cells_of(*map(text, ("research_result_id", "task_id", "field_name", "source_name", "confidence"))).alias("cells"))
    return head.union(body)
