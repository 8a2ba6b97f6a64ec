"""Names of companies in titles and page texts, and the candidates that pages offer."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from probitas.functions import text as X
from probitas.operators.linkage import name_similarity, normalize_entities
from probitas.operators.pages import SPACES

# Where a name ends in a title, and what follows it.
TITLE_TAILS = (
    r"company\s+details", r"company\s+profile", "profile", "overview", r"mca\s+details", "financials", r"company\s+registration", "registration", r"master\s+data", r"corporate\s+identification", "cin", "gstin", r"zauba\s*corp", "tofler",
    "quickcompany", "instafinancials", "shareholders", "directors", r"official\s+site", r"official\s+website", "home", r"about\s+us", r"google\s+search", "duckduckgo", "bing",
)
OTHER_TAILS = (r"\s+financials\s*\|\s*company\s+details", r"\s*,\s*(?:shareholders|directors)", r"\s+at\s+duckduckgo")
REGISTRY_TAILS = (
    r"having\s+(?:cin|gstin|llpin|pan|din|tan)\b", r"(?:cin|gstin|llpin|din|pan|tan)\s*[:#=-]", r"is\s+\d+\s+(?:year|yr|month|mo|week|wk|day)s?\b", r"incorporated\s+(?:on|in|as|since)\b",
    r"registered\s+(?:on|in|at|as|since|under|with|address|office)\b", r"(?:date|year)\s+of\s+(?:incorporation|registration|establishment)\b", r"(?:established|founded|incorporated)\s+(?:on|in)\s+\d",
    r"[ul][0-9]{5}[a-z]{2}[0-9]{4}[a-z]{3}[0-9]{6}\b", r"[0-9]{2}[a-z]{5}[0-9]{4}[a-z][0-9a-z]z[0-9a-z]\b", r"[a-z]{3}-[0-9]{4}\b",
)
SEARCH_TAILS = r"\s+(?:mca\s+company\s+registration|epfo\s+establishment|official\s+website|company\s+registration|master\s+data)\b.*$"
PLACE_TAILS = r",\s*(?:maharashtra|karnataka|delhi|tamil nadu|gujarat|telangana|haryana|uttar pradesh|west bengal|mumbai|bengaluru|bangalore|new delhi|chennai|hyderabad|pune|kolkata|india|bharat)\b.*$"
SLOGANS = (
    "leadership with trust", "where quality matters", "online store", "online electronic", "shopping store", "shopping online", "best deals", "leading provider", "where quality", "welcome to", "your trusted", "buy online", "lowest prices",
    "customer support", "trust and value", "powering the future", "touching lives", "improving the quality of life", "delivering excellence", "world class solutions", "shaping tomorrow", "innovating for growth", "trademarks and logos",
    "s and logos appearing", "logos appearing on", "all rights reserved",
)
# What is no name, as a whole, at its start, or anywhere in it.
NOT_NAMES = (
    "welcome", "home", "login", "index", "the group", "leadership", "trust", "the tata group", "welcome - online", "404 not found", "page not found", "not found", "access denied", "forbidden", "duckduckgo", "search results", "search",
    "of business", "nature of business", "business activity", "registered office", "s and logos appearing on the site", "trademarks and logos appearing on the site", "terms of use", "privacy policy", "all rights reserved",
    "something went wrong", "error", "cin", "gstin", "llpin", "din", "pan", "tan", "having cin", "having gstin", "date of incorporation", "date of registration", "company details", "company profile",
)
NOT_AT_START = ("welcome", "home", "login", "index", "about us", "online store", "online shopping", "search results", "search -", "search for", "companies matching", "404", "503", "502", "500", "403", "401")
NOT_WITHIN = (
    "s and logos appearing", "trademarks and logos", "something went wrong", "access denied", "page not found", "duckduckgo", "bing search", "google search", "yahoo search", "goods & services tax", "goods and services tax",
    "search taxpayer", "ministry of corporate affairs", "mca services", "company master data", "employees' provident fund", "epfindia", "gst portal", "mca portal", "epfo portal", "search results", "companies matching", "search companies", "results for",
)
# Lines that state a name, names with a legal form, and how candidates are given.
NAME_LABEL = (
    r"(?i)(?:legal\s+name(?:\s+of\s+(?:business|taxpayer|company|the\s+taxpayer))?|company\s+name|name\s+of\s+(?:company|business|taxpayer)|establishment\s+name|trade\s+name)\s*[:\-]?\s*([A-Za-z0-9\s.,&()-]+)"
)
LEGAL_SPAN = r"\b([A-Z][A-Za-z0-9.,&-]+(?:\s+[A-Za-z0-9.,&-]+){0,6}\s+(?:Pvt\.?\s*Ltd\.?|Private\s*Limited|Limited|LLC|Inc\.?|Corp\.?))\b"
EXCERPT, OPEN, CLOSE = 1200, "<UNTRUSTED_WEBSITE_CONTENT>\n", "\n</UNTRUSTED_WEBSITE_CONTENT>"
BY_NAME = ("ENTITY_DISCOVERY", "GENERAL_WEB_RESEARCH")
DIRECTORY_SIMILAR, DIRECTORY_CONFIDENCE, DIRECTORY_LEAST = 0.80, 0.85, 0.40

#: What to take out of a name, one after the other; each of the first three cuts at its first place.
CUTS = (
    rf"(?i)(?:\s*[-|–—:]\s*(?:{'|'.join(TITLE_TAILS)})|{'|'.join(OTHER_TAILS)}).*$", rf"(?i)\b(?:{'|'.join(REGISTRY_TAILS)}).*$", r"[.,\-–—:|/&\s]+$", r"(?i)\s+in\s+.*$", f"(?i){SEARCH_TAILS}", f"(?i){PLACE_TAILS}",
    f"(?i)(?:{'|'.join(SLOGANS)}).*$", r"[.\-–—:|/,\s]+$",
)


def _any(c: Column, words, how: str = "contains") -> Column:
    return reduce(lambda a, b: a | b, (getattr(c, how)(w) for w in words))


def legal_name(c: Column) -> Column:
    """A title's or line's company name without markup, site words, registry data and slogans; null if none is left."""
    v = reduce(lambda a, e: F.replace(a, F.lit(e[0]), F.lit(e[1])), X.ENTITIES, F.coalesce(c, F.lit("")))
    v = F.trim(F.regexp_replace(F.regexp_replace(v, "<[^>]+>", " "), SPACES, " "))
    v = reduce(lambda a, p: F.trim(F.regexp_replace(a, p, "")), CUTS, v)
    low = F.lower(v)
    bad = (F.length(v) < 3) | low.isin(*NOT_NAMES) | _any(low, NOT_AT_START, "startswith") | _any(low, NOT_WITHIN) | ~X.is_legal_name(v)
    return F.when(~bad, v)


def _lines(text: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), F.trim), lambda x: x != "")


def page_names(pages: DataFrame) -> DataFrame:
    """pages (title, text, target, task_type, ...) with legal_name: of the first line that states one, else of the
    title, else, for tasks that look for a name, of the target; NOT_FOUND for pages without text or name."""
    said = F.transform(_lines(F.col("text")), lambda x: F.trim(F.regexp_extract(x, NAME_LABEL, 1)))
    stated = F.get(F.array_compact(F.transform(F.filter(said, lambda x: F.length(x) > 3), legal_name)), F.lit(0))
    by_name = F.when(F.col("task_type").isin(*BY_NAME), legal_name(F.col("target")))
    name = F.when(F.trim(F.coalesce("text", F.lit(""))) != "", F.coalesce(stated, legal_name(F.col("title")), by_name))
    return pages.withColumn("legal_name", F.coalesce(name, F.lit("NOT_FOUND")))


def excerpt(text: Column) -> Column:
    """The first characters of a text on one line, between marks of foreign content; empty for empty texts."""
    v = F.substring(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, " ")), 1, EXCERPT)
    return F.when(v == "", "").otherwise(F.concat(F.lit(OPEN), v, F.lit(CLOSE)))


def candidates_in_text(pages: DataFrame, *keys: str) -> DataFrame:
    """(keys, pos, name, source_text, confidence): names with a legal form in a page's text, each once, in order;
    without any, the title's name or the target itself, unless the target alone is no finding. Pages without text offer none."""
    spans = F.flatten(F.transform(_lines(F.col("text")), lambda x: F.regexp_extract_all(x, F.lit(LEGAL_SPAN), F.lit(1))))
    found = F.array_distinct(F.array_compact(F.transform(spans, legal_name)))
    other = F.coalesce(legal_name(F.col("title")), F.col("target"))
    echo = (F.lower(other) == F.lower("target")) & ~F.coalesce(F.col("task_type").isin(*BY_NAME), F.lit(False))
    names = F.when(F.size(found) > 0, found).when(~F.coalesce(echo, F.lit(False)), F.array_compact(F.array(other)))
    d = pages.filter(F.coalesce("text", F.lit("")) != "").select(*keys, F.posexplode(names).alias("pos", "name"), excerpt(F.col("text")).alias("source_text"))
    return d.withColumn("confidence", F.lit(1.0))


def candidate_from_directory(pages: DataFrame) -> DataFrame:
    """pages (title, target, ...) with name (the title, else the target) and its confidence by likeness to the target."""
    named = pages.withColumn("name", F.coalesce(F.nullif("title", F.lit("")), "target"))
    d = normalize_entities(named).withColumnRenamed("e", "found_")
    d = normalize_entities(d.withColumn("kept_", F.col("name")).withColumn("name", F.col("target"))).withColumnRenamed("e", "own_")
    like = name_similarity(F.col("own_"), F.col("found_"))
    confidence = F.when(like >= DIRECTORY_SIMILAR, DIRECTORY_CONFIDENCE).otherwise(F.round(F.greatest(F.lit(DIRECTORY_LEAST), like), 2))
    return d.select(*pages.columns, F.col("kept_").alias("name"), confidence.alias("confidence"))
