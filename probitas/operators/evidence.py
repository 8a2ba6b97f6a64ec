"""The evidence store: validity, upsert, freshness and reuse."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from probitas.cluster import merged, stage
from probitas.functions import text as X
from probitas.operators.pages import is_address_like

# What counts as no fact, and how long a fact stays fresh.
PLACEHOLDERS = ("NOT_FOUND", "UNAVAILABLE", "UNKNOWN", "ERROR", "BLOCKED", "IRRELEVANT", "SOURCE_UNAVAILABLE", "CAPTCHA_REQUIRED", "NOT APPLICABLE", "N/A", "NA", "NONE", "NULL", "SOMETHING WENT WRONG")
REJECTED = ("REJECTED", "ENTITY_MISMATCH", "UNRELATED", "IRRELEVANT")
VERIFICATION_FIELDS = ("gst_status", "mca_status", "website_status")
FRESH_DAYS = (("gst", 7), ("mca", 30), ("company", 30), ("website", 30))
FRESH_DEFAULT = 30
ADDRESS_FIELDS = ("registered_address", "establishment_address", "contact_address", "principal_business_address", "principal_place_of_business", "corporate_address", "address")
NAME_FIELDS = ("legal_name", "company_name", "business_name", "establishment_name", "trade_name")
ACTIVITY_FIELDS = ("business_activity", "nature_of_business", "activity", "principal_business_activity")
TEXT_KEYS, CUT = ("source_text", "snippet", "text", "context", "raw_text"), " …[truncated]"
PORTAL_NAMES = (("gst.gov.in", "gst portal"), ("mca.gov.in", "mca portal"))
KEY = ("investigation_id", "field_name", "source_key", "research_result_id")


def validate_results(d: DataFrame) -> DataFrame:
    """d with errors (array of strings) and is_valid; columns that d lacks are not checked."""
    blank = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
    value = F.upper(F.trim("field_value"))
    checks = [
        F.when(F.col("field_value").isNull(), "field_value is missing").when(F.trim("field_value") == "", "field_value is empty"),
        F.when(~F.coalesce(F.col("confidence").between(0.0, 1.0), F.lit(False)), "confidence must be between 0.0 and 1.0").when(F.col("confidence") <= 0, "confidence must be greater than 0.0"),
        *(F.when(blank(c), f"{c} is empty") for c in ("research_result_id", "task_id", "field_name", "source_name")),
        F.when(value.isin(*PLACEHOLDERS) & F.col("field_name").isin(*VERIFICATION_FIELDS) & (F.upper("field_value") == "UNAVAILABLE"), "verification result is unavailable").when(value.isin(*PLACEHOLDERS), "field_value is a placeholder"),
        F.when(F.upper(F.trim("verification_status")).isin(*REJECTED), "verification_status is rejected"),
    ]
    if "source_url" in d.columns:
        checks.append(F.when(~F.col("source_url").rlike("^https?://[^/?#]+"), "source_url is invalid"))
    return d.withColumn("errors", F.array_compact(F.array(*checks))).withColumn("is_valid", F.size("errors") == 0)


def value_errors(d: DataFrame) -> DataFrame:
    """d with value_errors (array of strings): values that don't have the shape of their group of fields."""
    field, value = F.col("field_name"), F.col("field_value")
    rules = ((ADDRESS_FIELDS, is_address_like, "not an address"), (NAME_FIELDS, X.is_legal_name, "not a legal name"), (ACTIVITY_FIELDS, X.is_activity, "not a business activity"))
    return d.withColumn("value_errors", F.array_compact(F.array(*(F.when(value.isNotNull() & field.isin(*fields) & ~shape(value), said) for fields, shape, said in rules))))


def admit_results(d: DataFrame) -> DataFrame:
    """d with errors of both kinds and is_valid, checked once: stage it where both halves are used."""
    both = value_errors(validate_results(d)).withColumn("errors", F.concat("errors", "value_errors"))
    return both.withColumn("is_valid", F.size("errors") == 0).drop("value_errors")


def split_valid(d: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The valid rows as they are and the others with their errors; the checks are staged, not run twice."""
    checked = stage(admit_results(d), "checked")
    return checked.filter("is_valid").drop("errors", "is_valid"), checked.filter("not is_valid")


def merge_evidence(rows: DataFrame) -> DataFrame:
    """upsert_evidence() of rows that may be merged already, in any order and any number of steps: newest_seq
    is the place of the row that gave the value, status_seq of the one that gave the status."""
    d = rows.withColumn("source_key", F.lower(F.trim("source_name")))
    newest = F.max_by(F.struct("field_value", "confidence", "task_id", "newest_seq"), F.struct("retrieved_at", "newest_seq"))
    status = F.max_by(F.struct("verification_status", "status_seq"), F.struct(F.col("retrieved_at"), -F.col("status_seq")))
    g = d.groupBy(*KEY).agg(newest.alias("n"), status.alias("s"), F.max("retrieved_at").alias("retrieved_at"), F.min_by("source_name", "ev_seq").alias("source_name"), F.min("ev_seq").alias("ev_seq"))
    return g.select("investigation_id", "research_result_id", "n.task_id", "field_name", "n.field_value", "source_name", "n.confidence", "s.verification_status", "retrieved_at", "ev_seq", "n.newest_seq", "s.status_seq")


def unmerged(rows: DataFrame) -> DataFrame:
    """Rows as they arrive, for merge_evidence()."""
    return rows.withColumns({"newest_seq": F.col("ev_seq"), "status_seq": F.col("ev_seq")})


def upsert_evidence(rows: DataFrame) -> DataFrame:
    """Newest row wins by key; one aggregation over store and batch together.

    Value, confidence and task are of the newest row, the last to arrive among equally new ones;
    the status is of the first to arrive among them; the source's spelling is of the first row."""
    return merge_evidence(unmerged(rows)).drop("newest_seq", "status_seq")


def fresh_days(field: Column) -> Column:
    low, out = F.lower(field), F.lit(FRESH_DEFAULT)
    for word, days in reversed(FRESH_DAYS):
        out = F.when(low.contains(word), days).otherwise(out)
    return out


def is_fresh(retrieved_at: Column, field: Column, as_of: Column) -> Column:
    age = F.floor((F.unix_timestamp(as_of.cast("timestamp")) - F.unix_timestamp(retrieved_at.cast("timestamp"))) / 86400)
    return age < fresh_days(field)


def source_key(name: Column) -> Column:
    """Lower-case name; the two names of each portal are one."""
    low = F.lower(F.trim(name))
    return reduce(lambda c, kv: c.when(low == kv[0], kv[1]), PORTAL_NAMES, F.when(F.lit(False), "")).otherwise(low)


def link_evidence_to_tasks(ev: DataFrame, tasks: DataFrame) -> DataFrame:
    """ev with linked, and kind, target and objective in their normal form of the task that it names in its investigation."""
    t = tasks.select("investigation_id", "task_id", F.upper(F.trim("task_type")).alias("kind"), F.lower(F.trim("target")).alias("target"), F.lower(F.trim("objective")).alias("objective"), F.lit(True).alias("linked"))
    return ev.join(t, ["investigation_id", "task_id"], "left").withColumn("linked", F.coalesce("linked", F.lit(False)))


def with_own_task(ev: DataFrame, tasks: DataFrame) -> DataFrame:
    """ev with task, the (task_type, target, objective) of the task that it names in its investigation, else null. tasks
    has a row a task; those of an investigation are joined as one row, so tables dealt by investigation are not dealt again."""
    said = F.struct("task_id", F.struct("task_type", "target", "objective"))
    of = tasks.filter("task_id is not null").groupBy("investigation_id").agg(F.map_from_entries(F.collect_list(said)).alias("tasks_"))
    return ev.join(merged(of), "investigation_id", "left").withColumn("task", F.try_element_at("tasks_", F.col("task_id"))).drop("tasks_")


def normal_task(task: str) -> dict[str, Column]:
    """kind, target and objective of a struct of with_own_task() in their normal form, and linked, as
    link_evidence_to_tasks() has them."""
    low = lambda c: F.lower(F.trim(f"{task}.{c}"))
    return {"kind": F.upper(F.trim(f"{task}.task_type")), "target": low("target"), "objective": low("objective"), "linked": F.col(task).isNotNull()}


def cached_results(wanted: DataFrame, linked: DataFrame, as_of: Column) -> DataFrame:
    """wanted (task_type, target, objective, field_name, source_name, ...) with the newest fresh evidence
    of link_evidence_to_tasks(), of any investigation, for that field and source: found_value, found_at
    and found. Evidence linked to a task serves only tasks of the same type, target and objective."""
    fresh = linked.filter(is_fresh(F.col("retrieved_at"), F.col("field_name"), as_of)).withColumn("source_key", source_key(F.col("source_name")))
    best = F.max(F.struct("retrieved_at", "investigation_id", "ev_seq", "field_value")).alias("x")
    free = fresh.filter("not linked").groupBy("field_name", "source_key").agg(best)
    bound = fresh.filter("linked").groupBy("field_name", "source_key", "kind", "target", "objective").agg(best)
    keyed = wanted.select(F.struct("*").alias("w"), "field_name", source_key(F.col("source_name")).alias("source_key"), F.upper(F.trim("task_type")).alias("kind"), F.lower(F.trim("target")).alias("target"), F.lower(F.trim("objective")).alias("objective"))
    d = keyed.join(bound.withColumnRenamed("x", "own"), ["field_name", "source_key", "kind", "target", "objective"], "left").join(free.withColumnRenamed("x", "any"), ["field_name", "source_key"], "left")
    x = d.select("w.*", F.greatest("own", "any").alias("x_"))
    return x.select(*wanted.columns, F.col("x_.field_value").alias("found_value"), F.col("x_.retrieved_at").alias("found_at"), F.col("x_").isNotNull().alias("found"))


def split_cached(found: DataFrame, *task: str) -> DataFrame:
    """(task..., reusable): a task is reused only if each of its fields was found."""
    return found.groupBy(*(task or ("task_id",))).agg(F.bool_and("found").alias("reusable"))


def evidence_for(ev: DataFrame, investigations: DataFrame) -> DataFrame:
    return ev.join(investigations.select("investigation_id").distinct(), "investigation_id", "left_semi")


def latest_evidence(ev: DataFrame) -> DataFrame:
    """The newest row of each investigation and field."""
    w = Window.partitionBy("investigation_id", "field_name").orderBy(F.desc("retrieved_at"), F.desc("ev_seq"))
    return ev.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def bound_text(value: Column, limit: int = 20_000) -> Column:
    """Values longer than limit are cut and marked."""
    return F.when(F.length(value) > limit, F.concat(F.substring(value, 1, limit), F.lit(CUT))).otherwise(value)


def bound_items(items: Column, names: tuple[str, ...], limit: int = 20_000, each: int = 2_000) -> Column:
    """A list of structs of the given fields whose text fields are cut to `each` characters and marked;
    if its JSON is still longer than limit, the text fields become null."""
    texts = [n for n in names if n in TEXT_KEYS]

    def cut(v: Column) -> Column:
        return F.when(F.length(v) > each, F.concat(F.substring(v, 1, each), F.lit(CUT))).otherwise(v)

    def bounded(given: Column) -> Column:
        short = F.transform(given, lambda x: F.struct(*((cut(x[n]) if n in texts else x[n]).alias(n) for n in names)))
        bare = F.transform(given, lambda x: F.struct(*((F.lit(None).cast("string") if n in texts else x[n]).alias(n) for n in names)))
        chars = lambda v: F.coalesce(F.when(F.length(v) > each, each + len(CUT)).otherwise(F.length(v)), F.lit(0))
        size = F.aggregate(given, F.lit(0).cast("long"), lambda n, x: sum((chars(x[t]) for t in texts), n))
        # JSON takes 1 to 6 characters for one of a text, so it is written only where that leaves the question open
        most = F.length(F.to_json(bare)) + 6 * size + F.size(given) * sum(len(t) + 6 for t in texts)
        over = F.when(size > limit, True).when(most <= limit, False).otherwise(F.length(F.to_json(short)) > limit)
        return F.when(over, bare).otherwise(short)

    return F.transform(F.array(items), bounded)[0]  # items are made once, however often they are looked at
