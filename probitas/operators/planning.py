"""What to research next: identifiers, candidates, tasks, their sources, numbers and budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from probitas.operators.pages import IDENTIFIERS
from probitas.sources.catalog import DISCOVERY, EPFO, GENERAL, GST, MCA, NO_DIRECTORY, THIRD, WEBSITE, by_task_type

# Fields that name an identifier, and what is no value.
OFFERS = {
    "gstin": ("gstin", "tax_id"),
    "cin": ("cin", "company_cin"),
    "epfo_code": ("epfo_code", "establishment_code"),
    "website": ("website", "domain", "company_url"),
    "name": ("legal_name", "company_name"),
}
NO_OFFER = ("NOT_FOUND", "UNAVAILABLE", "NONE")
# Type, identifier, objective with it, search target and objective without it ({} is the value), fields, priority.
VERIFY = (
    (GST, "gstin", "Verify GSTIN {} and retrieve registration status and details.", "{}", "Search GST portal and public records to identify taxpayer details for {}.",
     ("legal_name", "gst_status", "registered_address", "business_activity"), 1),
    (MCA, "cin", "Verify CIN {} and retrieve company registration details.", "{} MCA company registration", "Search MCA corporate registry to verify incorporation and registration for {}.",
     ("legal_name", "company_status", "incorporation_date", "registered_address"), 1),
    (EPFO, "epfo_code", "Verify EPFO code {} and retrieve establishment registration details.", "{} EPFO establishment",
     "Search EPFO establishment records to verify social security and employment registration for {}.", ("establishment_name", "epfo_status", "establishment_address"), 1),
    (WEBSITE, "website", "Analyze company website {} to verify business claims and contact details.", "{} official website",
     "Search and analyze official website for {} to verify operational claims and contact details.", ("website_status", "contact_address", "established_year"), 2),
)
DIRECTORY = ("Search third-party business database ({label}) for {target}.", ("legal_name", "company_status", "registered_address", "business_activity"), 2)
DISCOVER = ("Search public records to discover matching legal entities, GSTIN, and CIN for {}.", ("candidate_entities",), 1)
GENERALLY = ("Perform general web research to identify public footprint, news, and operating claims for {}.", ("candidate_entities", "legal_name"), 2)
TASKS_REASON, ACTIONS_REASON = "Max browser/research tasks limit reached", "Max browser actions limit reached"
# Words that belong to a search rather than to a name.
SITE_WORDS = r"(?i)\s+(?:official\s*website|website|in\s+[A-Za-z]+|company\s*registration|pvt|ltd|limited|private|llp|corp|inc)\b"
SLUG_WORDS = r"(?i)\s+(?:in\s+[A-Za-z]+|mca\s+company\s+registration|epfo\s+establishment|official\s*website|company\s*registration|search|portal|master\s*data)\b"
TERM_WORDS = r"(?i)\s+(?:official\s*website|website|in\s*india|company\s*registration|mca|epfo|establishment|search|portal|master\s*data)\b"
WEB_ADDRESS = r"^(?i:https?://)?[^/?#]*\."
DOMAIN_ENDS = r"\.(com|in|org|net|io|co)$"
RAN = ("COMPLETED", "FAILED")
CANDIDATES = "array<struct<name:string,gstin:string,cin:string,epfo_code:string,website:string,confidence:double>>"


def _given(c: Column) -> Column:
    return F.when(F.trim(c) != "", c)


def _member(kind: str):
    return lambda x: x["c"][kind]


def discovered_identifiers(results: DataFrame) -> DataFrame:
    """(investigation_id, gstin, cin, epfo_code, website, name): the first that a result offers, by
    ev_seq; a list of candidates offers those of its most confident member first. One aggregation."""
    parsed = F.from_json(F.when(F.col("field_name") == "candidate_entities", F.col("field_value")), CANDIDATES)
    ranked = F.array_sort(F.transform(parsed, lambda c, i: F.struct((-F.coalesce(c["confidence"], F.lit(0.0))).alias("o"), i.alias("i"), c.alias("c"))))
    d = results.withColumn("_c", ranked)
    value = F.trim("field_value")
    firsts = []
    for kind, names in OFFERS.items():
        listed = F.get(F.filter(F.transform("_c", _member(kind)), lambda v: F.coalesce(v != "", F.lit(False))), F.lit(0))
        direct = F.when(F.col("field_name").isin(*names) & (value != "") & ~F.upper(value).isin(*NO_OFFER), value)
        offer = F.coalesce(listed, direct)
        firsts.append(F.min_by(offer, F.when(offer.isNotNull(), F.col("ev_seq"))).alias(kind))
    return d.groupBy("investigation_id").agg(*firsts)


def plan_targets(intake: DataFrame, results: DataFrame) -> DataFrame:
    """(investigation_id, gstin, cin, epfo_code, website, name, location): what the user gave goes
    before what was found, but a name that was found goes before the user's."""
    offering = results.filter(F.col("field_name").isin("candidate_entities", *(n for names in OFFERS.values() for n in names)))
    found = discovered_identifiers(offering).select("investigation_id", *(F.col(k).alias(f"found_{k}") for k in OFFERS))
    d = intake.join(found, "investigation_id", "left")
    ids = (F.coalesce(_given(F.col(k)), F.col(f"found_{k}")).alias(k) for k in OFFERS if k != "name")
    return d.select("investigation_id", *ids, F.coalesce("found_name", _given(F.col("business_name"))).alias("name"), _given(F.col("location")).alias("location"))


def _fill(template: str, c: Column) -> Column:
    before, after = template.split("{}")
    return F.concat(F.lit(before), c, F.lit(after))


def _task(pos: int, kind: Column, target: Column, objective: Column, fields: Column, priority: Column) -> Column:
    return F.struct(F.lit(pos).alias("pos"), kind.alias("task_type"), F.trim(target).alias("target"), objective.alias("objective"), fields.alias("required_fields"), priority.alias("priority"))


def _words(words) -> Column:
    return F.array(*map(F.lit, words))


def routes(catalog: DataFrame) -> DataFrame:
    """(task_type, route, label, preferred, fallback): one route a type, but one a directory for
    third-party research."""
    one = by_task_type(catalog).filter(F.col("task_type") != THIRD).select("task_type", F.lit("").alias("route"), F.lit("").alias("label"), "preferred", "fallback")
    each = catalog.filter(F.col("enabled") & F.array_contains("task_types", THIRD) & ~F.col("name").isin(*NO_DIRECTORY))
    order = F.format_string("%05d %05d %s", "priority", "tier", "name")
    return one.union(each.select(F.lit(THIRD), order, "label", F.array("name"), F.array().cast("array<string>")))


def _sources_key(preferred: Column) -> Column:
    return F.array_join(F.array_sort(preferred), "\x1e")


def task_key(kind: Column, target: Column, sources: Column) -> Column:
    return F.concat_ws("\x1f", kind, F.lower(F.trim(target)), sources)


def plan_tasks(intake: DataFrame, results: DataFrame, existing: DataFrame, catalog: DataFrame) -> DataFrame:
    """New tasks of each investigation in six source categories, with numbers after the existing ones.

    existing: (investigation_id, task_type, target, preferred_sources); tasks equal in type, target
    without case, and set of preferred sources are not planned again. An investigation with neither
    name nor identifier gets none."""
    given = [*OFFERS, "location"]
    # one row an investigation from here to the last step: what is joined by investigation is joined before
    # tasks are made of it, so that no task is shuffled or sorted
    t = plan_targets(intake, results).groupBy("investigation_id").agg(F.collect_list(F.struct(*given)).alias("_t"))
    none = F.array().cast("array<string>")
    key = task_key(F.col("task_type"), F.col("target"), _sources_key(F.coalesce("preferred_sources", none)))
    old = existing.groupBy("investigation_id").agg(F.collect_set(key).alias("_old"), F.count("*").alias("_n"))
    names = ("route", "label", "preferred", "fallback")
    of = routes(catalog).groupBy("task_type").agg(F.array_sort(F.collect_list(F.struct(*names, _sources_key(F.col("preferred")).alias("key")))).alias("l"))
    each = of.agg(F.map_from_entries(F.collect_list(F.struct("task_type", "l"))).alias("_routes"))
    d = t.join(old, "investigation_id", "left").crossJoin(F.broadcast(each))

    # lambdas are interpreted, so each does no more than it must: routes bring their part of the key with them, and
    # it is only asked where the investigation has tasks
    def routed(x: Column) -> Column:
        no_route = F.array().cast(each.schema["_routes"].dataType.valueType)
        to = F.coalesce(F.try_element_at("_routes", x["task_type"]), no_route)
        is_new = lambda r: ~F.coalesce(F.array_contains("_old", task_key(x["task_type"], x["target"], r["key"])), F.lit(False))
        to = F.when(F.col("_old").isNull(), to).otherwise(F.filter(to, is_new))
        return F.transform(to, lambda r: F.struct(x["pos"].alias("pos"), *(r[c].alias(c) for c in names), *(x[c].alias(c) for c in ("task_type", "target", "objective", "required_fields", "priority"))))

    made = F.filter(F.flatten(F.transform("_t", _categories)), lambda x: x["target"] != "")
    d = d.withColumn("_tasks", F.flatten(F.transform(made, routed)))
    ordered = F.when(F.size("_t") > 1, F.array_sort("_tasks")).otherwise(F.col("_tasks"))  # tasks of one row come in order
    d = d.select("investigation_id", "_n", F.posexplode(ordered).alias("_k", "_x")).select("investigation_id", "_n", "_k", "_x.*")
    objective = F.replace(F.replace("objective", F.lit("{label}"), F.col("label")), F.lit("{target}"), F.col("target"))
    number = F.format_string("TASK-%03d", F.coalesce("_n", F.lit(0)) + F.col("_k") + 1)
    return d.select("investigation_id", number.alias("task_id"), "task_type", "target", objective.alias("objective"), "required_fields", "priority", "preferred", "fallback")


def _categories(t: Column) -> Column:
    """The tasks of a row of plan_targets() in six categories, without their sources."""
    name = t["name"]
    made = []
    for pos, (kind, key, with_id, search, without, fields, priority) in enumerate(VERIFY):
        given = t[key]
        made.append(_task(pos, F.lit(kind), F.coalesce(given, _fill(search, name)), F.coalesce(_fill(with_id, given), _fill(without, name)), _words(fields), F.lit(priority)))
    target = F.concat_ws(" ", name, t["cin"], t["gstin"])
    made.append(_task(4, F.lit(THIRD), F.when(name.isNotNull(), target), F.lit(DIRECTORY[0]), _words(DIRECTORY[1]), F.lit(DIRECTORY[2])))
    wide = F.coalesce(F.concat(name, F.lit(" in "), t["location"]), name)
    known = F.coalesce(t["gstin"], t["cin"], t["epfo_code"]).isNotNull()
    pick = lambda a, b: F.when(known, a).otherwise(b)
    made.append(_task(5, pick(F.lit(GENERAL), F.lit(DISCOVERY)), wide, pick(_fill(GENERALLY[0], wide), _fill(DISCOVER[0], wide)), pick(_words(GENERALLY[1]), _words(DISCOVER[1])), pick(F.lit(GENERALLY[2]), F.lit(DISCOVER[2]))))
    return F.array(*made)


def number_tasks(new: DataFrame, existing: DataFrame, order: list[str]) -> DataFrame:
    """new with task_id TASK-001 and so on, in order, after the investigation's existing tasks."""
    n = existing.groupBy("investigation_id").agg(F.count("*").alias("_n"))
    k = F.row_number().over(Window.partitionBy("investigation_id").orderBy(*order))
    return new.join(n, "investigation_id", "left").withColumn("task_id", F.format_string("TASK-%03d", F.coalesce("_n", F.lit(0)) + k)).drop("_n")


def route_sources(tasks: DataFrame, catalog: DataFrame) -> DataFrame:
    """tasks with the preferred source and the fallbacks of their type, empty for unknown types."""
    none = F.array().cast("array<string>")
    d = tasks.join(F.broadcast(by_task_type(catalog)), "task_type", "left")
    return d.withColumns({"preferred": F.coalesce("preferred", none), "fallback": F.coalesce("fallback", none)})


def seed_candidates(intake: DataFrame) -> DataFrame:
    """One candidate an investigation, surer the more its intake says; none if it says nothing."""
    has = lambda c: F.coalesce(F.col(c) != "", F.lit(False))
    name = has("business_name")
    sure = (
        F.when(has("gstin") | has("cin"), 0.95)
        .when(name & has("website") & has("location"), 0.80)
        .when(name & (has("website") | has("location")), 0.70)
        .when(name, 0.50)
        .when(has("website") | has("location"), 0.30)
    )
    d = intake.select("investigation_id", F.col("business_name").alias("name"), "gstin", "cin", "website", "location", sure.alias("confidence"))
    return d.filter("confidence is not null")


def merge_candidates(base: DataFrame, extra: DataFrame, source: str = "proposal") -> DataFrame:
    """base and those of extra (investigation_id, pos, name, gstin, cin, confidence) whose names, without
    case, are new: the first of each name, its confidence held to 0 to 0.90. An investigation without
    a base candidate takes none."""
    key = F.lower(F.trim("name"))
    first = (
        extra.filter(F.trim("name") != "").groupBy("investigation_id", key.alias("_key"))
        .agg(F.min_by(F.struct(F.trim("name").alias("name"), "gstin", "cin", F.least(F.greatest(F.coalesce("confidence", F.lit(0.0)), F.lit(0.0)), F.lit(0.90)).alias("confidence")), "pos").alias("x"))
    )
    fresh = first.join(base.select("investigation_id").distinct(), "investigation_id", "left_semi").join(base.select("investigation_id", key.alias("_key")), ["investigation_id", "_key"], "left_anti")
    null = F.lit(None).cast("string")
    return base.withColumn("source", F.lit("intake")).unionByName(fresh.select("investigation_id", "x.name", "x.gstin", "x.cin", null.alias("website"), null.alias("location"), "x.confidence", F.lit(source).alias("source")))


def admit(tasks: DataFrame, order: str, max_tasks: int = 15, max_actions: int = 20) -> DataFrame:
    """tasks with reason, null while the investigation's tasks and actions stay within their limits."""
    w = Window.partitionBy("investigation_id").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    reason = F.when(F.count("*").over(w) > max_tasks, TASKS_REASON).when(F.sum("actions").over(w) > max_actions, ACTIONS_REASON)
    return tasks.withColumn("reason", reason)


IDENTITY = (F.upper, "task_type"), (F.lower, "target"), (F.lower, "objective")


def _identity() -> list[Column]:
    return [F.col("investigation_id"), *(f(F.trim(c)).alias(f"_{c}") for f, c in IDENTITY)]


def upsert_tasks(store: DataFrame, batch: DataFrame) -> DataFrame:
    """store (investigation_id, task_id, task_type, target, objective, status, retry_count, started_at,
    completed_at) after batch (the same without the last three, with seq), row by row in order.

    Rows are the same task if type, target and objective agree without case and outer spaces. A row
    for a task that was started, completed or failed adds a retry; each takes id and status of the
    row and forgets its times. New tasks keep the spelling of their first row."""
    key = ["investigation_id", *(f"_{c}" for _, c in IDENTITY)]
    status = F.coalesce(_given(F.col("status")), F.lit("PENDING"))
    ran = status.isin(*RAN)
    g = batch.groupBy(*_identity()).agg(
        F.min_by(F.struct("task_type", "target", "objective"), "seq").alias("first"),
        F.max_by(F.struct("task_id", status.alias("status"), ran.cast("int").alias("ran")), "seq").alias("last"),
        F.sum(ran.cast("int")).alias("n_ran"),
    )
    d = store.select(*_identity()[1:], *store.columns).join(g, key, "full")
    hit = F.col("last").isNotNull()
    before = F.when(F.col("started_at").isNotNull() | F.col("completed_at").isNotNull() | F.col("status").isin(*RAN), 1).otherwise(0)
    retries = F.coalesce("retry_count", F.lit(0)) + F.when(hit, before + F.col("n_ran") - F.col("last.ran")).otherwise(0)
    return d.select(
        "investigation_id",
        F.when(hit, F.col("last.task_id")).otherwise(F.col("task_id")).alias("task_id"),
        *(F.coalesce(c, f"first.{c}").alias(c) for _, c in IDENTITY),
        F.when(hit, F.col("last.status")).otherwise(F.col("status")).alias("status"),
        retries.cast("int").alias("retry_count"),
        *(F.when(~hit, F.col(c)).alias(c) for c in ("started_at", "completed_at")),
    )


def apply_task_status(tasks: DataFrame, changes: DataFrame) -> DataFrame:
    """tasks after changes (investigation_id, task_id, seq, changed_at, status, error, result), in order of seq:
    the last status, the last start, the last end, the last result and error that were given. Changes
    of unknown tasks are ignored."""
    s = F.col("status")
    last = lambda c, ok: F.max_by(c, F.when(ok, F.col("seq")))
    told = lambda c: F.coalesce(F.col(c) != "", F.lit(False))
    g = changes.groupBy("investigation_id", "task_id").agg(
        F.max_by("status", "seq").alias("_status"),
        last("changed_at", s == "STARTED").alias("_started_at"),
        last("changed_at", s.isin(*RAN)).alias("_completed_at"),
        last("result", (s == "COMPLETED") & told("result")).alias("result_info"),
        last("error", s.isin("FAILED", "HUMAN_INTERVENTION_REQUIRED") & told("error")).alias("error_info"),
    )
    d = tasks.join(g, ["investigation_id", "task_id"], "left")
    new = {c: F.coalesce(f"_{c}", c) for c in ("status", "started_at", "completed_at")}
    return d.withColumns(new).drop(*(f"_{c}" for c in new))


def _identifier(kind: str, c: Column) -> Column:
    return F.nullif(F.regexp_extract(c, IDENTIFIERS[kind], 1), F.lit(""))


def _without(c: Column, *ids: Column) -> Column:
    for i in ids:
        c = F.replace(c, F.coalesce(i, F.lit("")))
    return c


def fetch_frontier(tasks: DataFrame, catalog: DataFrame) -> DataFrame:
    """(investigation_id, task_id, source, pos, url): URLs to try for tasks (investigation_id, task_id,
    task_type, target) at each enabled source of their type, best first and each once.

    A target that is itself a URL stands alone, except at public authorities, where the portal does;
    websites are guessed from the name; directories are asked by CIN and name, name, CIN, GSTIN and
    search, then at their root. A null or empty target leaves the root alone."""
    c = F.col
    of = catalog.filter("enabled").select(F.explode("task_types").alias("task_type"), c("name").alias("source"), "kind", "base_url", "cin_name_url", "name_url", "cin_url", "gstin_url", "search_url")
    t = F.trim("target")
    direct = t.rlike("^https?://") | (t.contains(".") & ~t.contains(" ") & (t.contains("/") | t.rlike(DOMAIN_ENDS)))
    d = tasks.withColumns({"_t": t, "_cin": _identifier("cin", F.upper(t)), "_gstin": _identifier("gstin", F.upper(t)), "_url": F.when(direct, F.when(t.contains("://"), t).otherwise(F.concat(F.lit("https://"), t)))})
    site = F.lower(F.regexp_replace(F.regexp_replace("_t", SITE_WORDS, ""), "[^a-zA-Z0-9]", ""))
    name = F.trim(F.regexp_replace(F.regexp_replace(_without(c("_t"), c("_gstin"), c("_cin")), SLUG_WORDS, ""), r"[^a-zA-Z0-9\s-]", ""))
    slug = F.lower(F.regexp_replace(F.regexp_replace(name, r"\s+", "-"), "^-+|-+$", ""))
    d = d.withColumns({"_site": F.nullif(site, F.lit("")), "_slug": F.nullif(slug, F.lit(""))}).join(F.broadcast(of), "task_type")

    def url(pattern: str, **values: Column) -> Column:
        out = c(pattern)
        for k, v in values.items():
            out = F.replace(out, F.lit("{" + k + "}"), v)  # null where a value is missing
        return out

    guesses = [F.concat(F.lit(a), c("_site"), F.lit(b)) for a, b in (("https://www.", ".com"), ("https://", ".com"), ("https://www.", ".in"))]
    query = F.coalesce("_cin", "_slug", F.nullif(c("_t"), F.lit("")))
    root = F.regexp_replace("base_url", "/+$", "")
    asked = [url("cin_name_url", slug=c("_slug"), cin=c("_cin")), url("name_url", slug=c("_slug")), url("cin_url", cin=c("_cin")), url("gstin_url", gstin=c("_gstin")), url("search_url", query=query), F.concat(root, F.lit("/company/"), c("_slug")), F.concat(root, F.lit("/company/"), c("_cin")), c("base_url")]
    official = (c("kind") == "OFFICIAL_WEBSITE") | (c("task_type") == WEBSITE)
    urls = (
        F.when(F.coalesce(c("target"), F.lit("")) == "", F.array("base_url"))
        .when(official & c("_url").isNull(), F.array(*guesses))
        .when(c("_url").isNotNull() & (official | (c("kind") != "GOVERNMENT")), F.array("_url"))
        .when(c("kind") == "GOVERNMENT", F.array("base_url"))
        .otherwise(F.array(*asked))
    )
    # array_except leaves nulls and repeats out, in order; array_compact would have all of this interpreted
    found = F.array_except(urls, F.array(F.lit(None).cast("string")))
    return d.select("investigation_id", "task_id", "source", F.posexplode(found).alias("pos", "url"))


def search_terms(tasks: DataFrame) -> DataFrame:
    """tasks (task_type, target) with terms: the words to search for, by the task's type."""
    d = tasks.withColumn("_t", F.trim(F.coalesce("target", F.lit(""))))
    t, gstin, cin, name = map(F.col, ("_t", "_gstin", "_cin", "_name"))
    # step by step, so that each is made once for a task and not wherever it is read
    d = d.withColumns({"_gstin": _identifier("gstin", t), "_cin": _identifier("cin", t)})
    d = d.withColumn("_name", F.trim(F.regexp_replace(_without(t, gstin, cin), TERM_WORDS, "")))
    quoted = lambda v, rest="": F.concat(F.lit('"'), v, F.lit('"' + rest))
    kind = F.col("task_type")
    terms = (
        F.when(kind == GST, F.coalesce(quoted(gstin), quoted(name, ' "GST" status')))
        .when(kind == MCA, F.coalesce(quoted(cin), quoted(name, ' "MCA" "company master data"')))
        .when(kind == EPFO, quoted(name, ' "EPFO" establishment'))
        .when((kind == WEBSITE) & t.rlike(WEB_ADDRESS), t)
        .when(kind == WEBSITE, quoted(name, " official website"))
        .otherwise(quoted(F.coalesce(F.nullif(name, F.lit("")), t)))
    )
    return d.withColumn("terms", terms).drop("_t", "_gstin", "_cin", "_name")
