"""Deterministic risk scoring of many investigations at once.

Order is explicit: ev_seq is the arrival order of a row within its investigation. Every step is
an aggregation with map-side combine; the only rows that move are evidence keys and values.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from probitas.operators.rulebook import Rule, RuleBook

# Rules, levels and statuses that scores depend on.
RULES = [
    ("GST_INACTIVE", 30, "COMPLIANCE", "HIGH"),
    ("COMPANY_STATUS_ADVERSE", 35, "COMPLIANCE", "HIGH"),
    ("LEGAL_NAME_CONFLICT", 25, "IDENTITY", "HIGH"),
    ("ADDRESS_MAJOR_MISMATCH", 10, "CONSISTENCY", "MEDIUM"),
    ("BUSINESS_ACTIVITY_MISMATCH", 10, "CONSISTENCY", "MEDIUM"),
    ("VERY_RECENT_REGISTRATION", 5, "REGISTRATION", "LOW"),
]
LEVELS = [("LOW", 0, 30), ("MODERATE", 31, 60), ("HIGH", 61, 80), ("VERY_HIGH", 81, 100)]
CATEGORIES = ("identity", "registration", "compliance", "consistency", "operational", "activity", "public_footprint")
GST_BAD = ("inactive", "cancelled", "suspended", "no", "invalid", "false")
COMPANY_BAD = ("struck off", "strike off", "strikeoff", "under liquidation", "in liquidation", "liquidated", "dissolved", "deregistered", "de-registered", "wound up", "winding up", "defunct", "dormant")
NAME_FIELDS = ("legal_name", "business_name", "company_name", "establishment_name", "trade_name")
ADDRESS_GROUPS = (("registered_address", "address"), ("establishment_address",), ("principal_business_address", "principal_place_of_business"), ("contact_address",))
LOW_INFORMATION = ("mca_status", "epfo_status", "website_status")
EXCLUDED = ("REJECTED", "ENTITY_MISMATCH", "UNRELATED")
LEGAL_SOURCES, SUPPORTING_SOURCES = ("GST Portal", "MCA Portal"), ("Company Website", "General Web", "Third-Party Source")
VERIFIED_CONFIDENCE = 0.70


def rule_catalog(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(RULES, "code string, weight int, category string, severity string")


def level_catalog(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(LEVELS, "level string, min_score int, max_score int")


def normalize_evidence(ev: DataFrame) -> DataFrame:
    """Missing status becomes UNVERIFIED; values and statuses that say nothing was found have confidence 0."""
    status = F.when(F.coalesce("verification_status", F.lit("")) == "", "UNVERIFIED").otherwise(F.col("verification_status"))
    said = F.upper(F.trim(F.get_json_object("field_value", "$.text")))
    nothing = F.coalesce(F.col("field_value").isin("NOT_FOUND", "UNAVAILABLE") | status.isin("SOURCE_UNAVAILABLE", "NOT_FOUND") | (F.col("field_value").startswith("{") & (said == "NOT_FOUND")), F.lit(False)) | status.isin("SOURCE_UNAVAILABLE", "NOT_FOUND")
    return ev.withColumns({"confidence": F.when(nothing, 0.0).otherwise(F.col("confidence")), "verification_status": status})


def admissible(ev: DataFrame) -> DataFrame:
    """Evidence that may score; of rows that share an id the first that may."""
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    value = F.upper(F.trim("field_value"))
    ok = (
        ~blank(F.col("research_result_id")) & ~blank(F.col("source_name")) & ~blank(F.col("field_name"))
        & F.col("confidence").between(0.5, 1.0) & ~F.coalesce(F.col("field_value"), F.lit("")).isin("", "[]", "{}")
        & ~value.isin("NOT_FOUND", "UNAVAILABLE") & ~F.upper(F.trim("verification_status")).isin("SOURCE_UNAVAILABLE", "NOT_FOUND", *EXCLUDED)
    )
    first = Window.partitionBy("investigation_id", "research_result_id").orderBy("ev_seq")
    return normalize_evidence(ev).filter(ok).withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n")


def is_substantive() -> Column:
    sure = (F.col("confidence") >= VERIFIED_CONFIDENCE) | (F.upper(F.trim("verification_status")) == "VERIFIED")
    return (F.col("field_name") != "candidate_entities") & sure & ~F.col("field_name").isin(*LOW_INFORMATION)


def substantive(adm: DataFrame) -> DataFrame:
    return adm.filter(is_substantive())


#: The rules above, as a book that more rules can be added to.
BOOK = RuleBook(
    tuple(Rule(*r, **how) for r, how in zip(RULES, (
        {"kind": "one_of", "groups": (("gst_status",),), "values": GST_BAD}, {"kind": "one_of", "groups": (("company_status", "registration_status"),), "form": "squeezed", "values": COMPANY_BAD},
        {"kind": "differs", "groups": (NAME_FIELDS,), "form": "name"}, {"kind": "differs", "groups": ADDRESS_GROUPS, "form": "address"}, {"kind": "differs", "groups": (("business_activity",),), "form": "activity"},
        {"kind": "younger_than", "groups": (("registration_date", "incorporation_date"),), "days": 365},
    ), strict=True)), tuple(LEVELS),
)
PAIR_RULES = BOOK.pair_codes


def triggers(adm: DataFrame, book: RuleBook = BOOK) -> DataFrame:
    """(investigation_id, code, grp, norm, row): what each admissible row says to a rule. Rules that one
    row triggers have an empty norm; rules that two different values trigger have the normalised
    value; code '' stands for substantive evidence."""
    sure = F.struct(F.lit("").alias("code"), F.lit(0).alias("grp"), F.lit("").alias("norm"))
    row = F.struct(F.col("ev_seq"), F.col("research_result_id").alias("id"), "confidence").alias("row")
    items = F.array(F.when(is_substantive(), sure), *book.triggers())
    return adm.select("investigation_id", row, F.explode(F.array_compact(items)).alias("t")).select("investigation_id", "t.*", "row")


def risk_profile(ev: DataFrame, book: RuleBook = BOOK) -> DataFrame:
    """(investigation_id, enough, signals) of each investigation with admissible evidence that says
    something to a rule or to sufficiency: one pass over evidence. signals: (code, evidence_ids,
    confidence), empty without substantive evidence.

    Pair rules take the first pair in arrival order: the first usable row and the first later one
    with another value, so the least row of each distinct value is enough, and of these the first
    two of each group; no pairs are formed."""
    least = triggers(admissible(ev), book).groupBy("investigation_id", "code", "grp", "norm").agg(F.min("row").alias("row"))
    rank = F.row_number().over(Window.partitionBy("investigation_id", "code", "grp").orderBy("row.ev_seq"))
    two = least.select("investigation_id", "code", "grp", "row", rank.alias("n")).filter("n <= 2")
    all_ = two.groupBy("investigation_id").agg(F.collect_list(F.struct("code", "grp", "n", "row")).alias("t"))  # two entries at most for each rule and group
    of = lambda code, n: F.filter("t", lambda x: (x["code"] == code) & (x["n"] == n))

    def one(code: str) -> Column:
        hit = F.get(of(code, 1), 0)["row"]
        return F.when(hit.isNotNull(), F.struct(F.lit(code).alias("code"), F.array(hit["id"]).alias("evidence_ids"), hit["confidence"].alias("confidence")))

    def pair(code: str) -> Column:
        grp = F.array_min(F.transform(of(code, 2), lambda x: x["grp"]))  # the first group with two values
        row = lambda n: F.get(F.filter(of(code, n), lambda x: x["grp"] == grp), 0)["row"]
        both = F.struct(F.lit(code).alias("code"), F.array(row(1)["id"], row(2)["id"]).alias("evidence_ids"), ((row(1)["confidence"] + row(2)["confidence"]) / 2).alias("confidence"))
        return F.when(grp.isNotNull(), both)

    enough = F.exists("t", lambda x: x["code"] == "")
    signals = F.array_compact(F.array(*(pair(r.code) if r.kind == "differs" else one(r.code) for r in book.rules)))
    return all_.select("investigation_id", enough.alias("enough"), signals.alias("found")).select("investigation_id", "enough", F.when(F.col("enough"), F.col("found")).otherwise(F.slice("found", 1, 0)).alias("signals"))


def exploded(d: DataFrame) -> DataFrame:
    return d.select("investigation_id", F.explode("signals").alias("s")).select("investigation_id", "s.*")


def first_triggers(adm: DataFrame) -> DataFrame:
    """Rules that one row triggers: (investigation_id, code, evidence_ids, confidence) of the first."""
    rows = triggers(adm).filter((F.col("code") != "") & ~F.col("code").isin(*PAIR_RULES))
    return rows.groupBy("investigation_id", "code").agg(F.min("row").alias("row")).select("investigation_id", "code", F.array("row.id").alias("evidence_ids"), F.col("row.confidence").alias("confidence"))


def conflict_triggers(adm: DataFrame) -> DataFrame:
    """Rules that two rows trigger by different normalised values: the first pair in arrival order."""
    least = triggers(adm).filter(F.col("code").isin(*PAIR_RULES)).groupBy("investigation_id", "code", "grp", "norm").agg(F.min("row").alias("row"))
    rank = F.row_number().over(Window.partitionBy("investigation_id", "code", "grp").orderBy("row.ev_seq"))
    two = least.withColumn("n", rank).filter("n <= 2").groupBy("investigation_id", "code", "grp").agg(F.array_sort(F.collect_list("row")).alias("rows")).filter("size(rows) = 2")
    one = two.groupBy("investigation_id", "code").agg(F.min_by("rows", "grp").alias("rows"))
    return one.select("investigation_id", "code", F.transform("rows", lambda r: r["id"]).alias("evidence_ids"), ((F.col("rows")[0]["confidence"] + F.col("rows")[1]["confidence"]) / 2).alias("confidence"))


def attach_rules(hits: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """hits (code, ...) with category, severity and risk_weight of the rule catalogue; a code it lacks
    is IDENTITY, MEDIUM and weighs 0."""
    rules = rule_catalog(hits.sparkSession) if rules is None else rules
    out = hits.join(F.broadcast(rules), "code", "left")  # else hits are dealt by a few codes
    return out.select("investigation_id", "code", F.coalesce("category", F.lit("IDENTITY")).alias("category"), F.coalesce("severity", F.lit("MEDIUM")).alias("severity"), "evidence_ids", "confidence", F.coalesce("weight", F.lit(0)).alias("risk_weight"))


def risk_signals(ev: DataFrame) -> DataFrame:
    """(investigation_id, code, category, severity, evidence_ids, confidence, risk_weight); none where
    no substantive evidence exists."""
    return attach_rules(exploded(risk_profile(ev)))


def level_of(score: Column, levels=None) -> Column:
    """The first level whose inclusive range holds the score, else UNKNOWN."""
    return reduce(lambda c, x: c.when(score.between(x[1], x[2]), x[0]), levels or LEVELS, F.when(F.lit(False), "")).otherwise("UNKNOWN")


def scores_of(investigations: DataFrame, profile: DataFrame, book: RuleBook = BOOK) -> DataFrame:
    """(investigation_id, score, level, insufficient_evidence, n_signals) of every investigation, from
    risk_profile()'s rows."""
    weight = F.aggregate("signals", F.lit(0), lambda a, x: a + book.weight(x["code"]))
    per = profile.select("investigation_id", "enough", weight.alias("total"), F.size("signals").alias("n"))
    d = investigations.select("investigation_id").join(per, "investigation_id", "left").withColumn("insufficient_evidence", ~F.coalesce("enough", F.lit(False)))
    d = d.withColumn("score", F.when(~F.col("insufficient_evidence"), F.least("total", F.lit(100))).cast("int"))
    level = F.when(F.col("insufficient_evidence"), "INSUFFICIENT_EVIDENCE").otherwise(level_of(F.col("score"), book.levels))
    return d.select("investigation_id", "score", level.alias("level"), "insufficient_evidence", F.coalesce("n", F.lit(0)).cast("long").alias("n_signals"))


def risk_scores(investigations: DataFrame, ev: DataFrame, book: RuleBook = BOOK) -> DataFrame:
    """(investigation_id, score, level, insufficient_evidence, n_signals) of every investigation."""
    return scores_of(investigations, risk_profile(ev, book), book)


def category_scores(signals: DataFrame) -> DataFrame:
    """Seven fixed categories an investigation, each at most 100."""
    return signals.groupBy("investigation_id").agg(*(F.least(F.coalesce(F.sum(F.when(F.lower("category") == c, F.col("risk_weight"))), F.lit(0)), F.lit(100)).cast("int").alias(c) for c in CATEGORIES))


def minimum_evidence(ev: DataFrame, min_legal: int = 1, min_supporting: int = 1) -> DataFrame:
    """(investigation_id, n_legal, n_supporting, met): a flag, not an error."""
    value = F.upper(F.trim(F.coalesce("field_value", F.lit(""))))
    ok = (F.col("confidence") >= 0.5) & ~value.isin("NOT_FOUND", "UNAVAILABLE") & ~F.coalesce("verification_status", F.lit("")).isin("SOURCE_UNAVAILABLE", "NOT_FOUND")
    of = lambda names: F.count_distinct(F.when(ok & F.col("source_name").isin(*names), F.col("source_name")))
    d = ev.groupBy("investigation_id").agg(of(LEGAL_SOURCES).alias("n_legal"), of(SUPPORTING_SOURCES).alias("n_supporting"))
    return d.withColumn("met", (F.col("n_legal") >= min_legal) & (F.col("n_supporting") >= min_supporting))


def replace_risk_signals(store: DataFrame, new: DataFrame, touched: DataFrame) -> DataFrame:
    """Signals of touched investigations are replaced by the new ones, also by none."""
    return store.join(touched.select("investigation_id").distinct(), "investigation_id", "left_anti").unionByName(new)
