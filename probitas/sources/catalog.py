"""The public sources that research tasks are routed to."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DISCOVERY, GENERAL, THIRD = "ENTITY_DISCOVERY", "GENERAL_WEB_RESEARCH", "THIRD_PARTY_RESEARCH"
GST, MCA, EPFO, WEBSITE = "GST_VERIFICATION", "MCA_VERIFICATION", "EPFO_VERIFICATION", "WEBSITE_VERIFICATION"

# Name, label, kind, tier, priority, confidence, task types, base URL.
SOURCES = (
    ("gst.gov.in", "GST Portal", "GOVERNMENT", 1, 1, 0.95, [GST], "https://services.gst.gov.in/services/searchtp"),
    ("mca.gov.in", "MCA Portal", "GOVERNMENT", 1, 1, 0.95, [MCA], "https://www.mca.gov.in"),
    ("epfindia.gov.in", "EPFO Portal", "GOVERNMENT", 1, 1, 0.90, [EPFO], "https://www.epfindia.gov.in"),
    ("company_website", "Company Website", "OFFICIAL_WEBSITE", 2, 1, 0.85, [WEBSITE], None),
    ("quickcompany.in", "QuickCompany", "THIRD_PARTY_REGISTRY", 3, 2, 0.80, [MCA, THIRD, GST], "https://www.quickcompany.in"),
    ("tofler.in", "Tofler", "THIRD_PARTY_REGISTRY", 3, 2, 0.75, [MCA, THIRD], "https://www.tofler.in"),
    ("zaubacorp.com", "Zauba Corp", "THIRD_PARTY_REGISTRY", 3, 2, 0.75, [MCA, THIRD], "https://www.zaubacorp.com"),
    ("instafinancials.com", "InstaFinancials", "THIRD_PARTY_REGISTRY", 3, 2, 0.75, [MCA, THIRD], "https://www.instafinancials.com"),
    ("falconebiz.com", "Falcon Ebiz", "THIRD_PARTY_REGISTRY", 3, 2, 0.75, [THIRD], "https://www.falconebiz.com"),
    ("third_party", "Third-Party Source", "THIRD_PARTY_REGISTRY", 3, 3, 0.50, [GST, MCA, EPFO, THIRD], "https://www.quickcompany.in"),
    ("generic_web", "General Web", "PUBLIC_DIRECTORY", 4, 4, 0.60, [DISCOVERY, GENERAL, WEBSITE, THIRD], "https://www.quickcompany.in"),
)
# URLs by identifier and name, by name, by CIN, by GSTIN, and of a search.
QUICK = (None, "https://www.quickcompany.in/company/{slug}", "https://www.quickcompany.in/company/{cin}", "https://www.quickcompany.in/company/{gstin}", "https://www.quickcompany.in/search?q={query}")
URLS = {
    "quickcompany.in": QUICK,
    "tofler.in": ("https://www.tofler.in/{slug}/company/{cin}", "https://www.tofler.in/company/{slug}", "https://www.tofler.in/company/{cin}", None, "https://www.tofler.in/search?q={query}"),
    "zaubacorp.com": ("https://www.zaubacorp.com/company/{slug}/{cin}", "https://www.zaubacorp.com/company/{slug}", "https://www.zaubacorp.com/company/{cin}", None, "https://www.zaubacorp.com/company-list/p-1-company.html?q={query}"),
    "instafinancials.com": ("https://www.instafinancials.com/company/{slug}/{cin}", "https://www.instafinancials.com/company/{slug}", "https://www.instafinancials.com/company/{cin}", None, "https://www.instafinancials.com/search?q={query}"),
    "falconebiz.com": ("https://www.falconebiz.com/company/{slug}-{cin}", "https://www.falconebiz.com/company/{slug}", "https://www.falconebiz.com/company/{cin}", None, "https://www.falconebiz.com/search?q={query}"),
    "third_party": QUICK,
    "generic_web": QUICK,
}
CANONICAL = (("GST Portal", "gst.gov.in"), ("MCA Portal", "mca.gov.in"), ("EPFO Portal", "epfindia.gov.in"), ("Company Website", "company_website"), ("General Web", "generic_web"), ("Third-Party Source", "third_party"))
NO_DIRECTORY = ("generic_web", "third_party")
SCHEMA = "name string, label string, kind string, tier int, priority int, confidence double, task_types array<string>, base_url string, cin_name_url string, name_url string, cin_url string, gstin_url string, search_url string, enabled boolean"


def source_catalog(spark: SparkSession) -> DataFrame:
    """The built-in sources; a table of the same columns can take its place."""
    return spark.createDataFrame([(*s, *URLS.get(s[0], (None,) * 5), True) for s in SOURCES], SCHEMA)


def lookup_key(name: Column) -> Column:
    """What names of one source share: letters of any case, and _ and . as -."""
    return F.translate(F.lower(F.trim(name)), "_.", "--")


def find_source(names: DataFrame, catalog: DataFrame, name: str = "source_name") -> DataFrame:
    """names with source, the catalogue's entry: of equal name, else of equal name in lower case, else
    of equal lookup_key(); null if none."""
    s = catalog.select(lookup_key(F.col("name")).alias("key_"), F.struct("name", "kind", "tier", "priority", "confidence").alias("s_"))
    rank = lambda n: F.when(F.col("s_.name") == n, 0).when(F.lower("s_.name") == F.lower(n), 1).otherwise(2)
    d = names.select(F.struct("*").alias("n_"), F.col(name).alias("of_")).distinct().withColumn("key_", lookup_key(F.col("of_"))).join(s, "key_", "left")
    best = d.groupBy("n_").agg(F.min_by("s_", F.struct(rank(F.col("of_")), F.col("s_.name"))).alias("source"))
    return best.select("n_.*", "source")


def canonical_source(name: Column) -> Column:
    """The key of a source's display name; other names stay."""
    return reduce(lambda c, kv: c.when(name == kv[0], kv[1]), CANONICAL, F.when(F.lit(False), "")).otherwise(name)


def by_priority(registry: DataFrame) -> DataFrame:
    """Sources by (priority, name)."""
    return registry.orderBy("priority", "name")


def by_task_type(catalog: DataFrame) -> DataFrame:
    """(task_type, preferred, fallback): the first enabled source of a type, and the rest in order."""
    pairs = catalog.filter("enabled").select(F.explode("task_types").alias("task_type"), F.struct("priority", "tier", "name").alias("s"))
    names = pairs.groupBy("task_type").agg(F.array_sort(F.collect_set("s"))["name"].alias("names"))
    return names.select("task_type", F.slice("names", 1, 1).alias("preferred"), F.expr("slice(names, 2, size(names))").alias("fallback"))


def register_missing(registry: DataFrame, defaults: DataFrame) -> DataFrame:
    """registry with those defaults whose (name, source_type) it lacks."""
    return registry.unionByName(defaults.join(registry, ["name", "source_type"], "left_anti").select(*registry.columns))


def upsert_source(registry: DataFrame, changes: DataFrame) -> DataFrame:
    """registry (name, source_type, authority_tier, enabled) after changes of the same columns: null
    leaves a value as it is, a row without a partner is added, enabled unless it says otherwise."""
    values = [c for c in registry.columns if c not in ("name", "source_type")]
    new = changes.select("name", "source_type", *(F.col(c).alias(f"new_{c}") for c in values))
    d = registry.join(new, ["name", "source_type"], "full")
    merged = {c: F.coalesce(f"new_{c}", c) for c in values}
    merged["enabled"] = F.coalesce(merged["enabled"], F.lit(True))
    return d.select("name", "source_type", *(v.alias(c) for c, v in merged.items()))
