"""Addresses, activities, descriptions and websites in page texts, as columns over lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from probitas.operators.identity import target_tokens
from probitas.operators.pages import is_address_like

# Labels of an address in the order in which they are tried, and words that rule lines out.
LABELS = (
    "registered address of", "registered office address of", "principal place of business", "principal place", "registered office address", "registered office", "registered address", "establishment address",
    "corporate office", "office address", "contact address", "address",
)
DENIED = ("no address", "address not", "not published", "not available", "unknown address", "same address", "similar address")
DENIED_LOOSE = ("same address", "similar address", "search", "menu", "nature of business")
NOT_BELOW = ("nature of business", "business activity", "director", "cin", "gstin")
NOT_ABOVE = ("nature of business", "business activity", "search")
STATES = ("maharashtra", "karnataka", "delhi", "tamil nadu", "telangana", "gujarat", "west bengal", "haryana", "uttar pradesh", "mumbai", "bengaluru", "bangalore", "chennai", "hyderabad", "kolkata", "pune", "gurgaon", "noida")
LEAD = r"(?i)^(?:[a-z0-9\s.,&()/-]+\s+is\s+|is\s+|at\s+|is\s+at\s+)"
TAIL = r"(?i)\s+(?:business\s*activity|nature\s+of\s+business|activity|gst\s*status|gstin|cin|status|incorporation|registration\s*date|contact|phone|email|website|date\s*of\s*incorporation|pan)\b.*$"
LOOSE_LEAD = r"(?i)^(?:at\s+|is\s+at\s+|registered\s+address\s+of\s+[a-z0-9\s.,&()/-]+\s+is|principal\s+place\s+of\s+business|registered\s+address|address|office)\s*[:\-]?"
ACTIVITY = r"(?i)(?:principal\s+business\s+activity|business\s+activity(?:\s+description)?|nature\s+of\s+business(?:\s+activities)?|nic\s+(?:code\s+)?description|activity\s+description|industrial\s+class)\s*[:\-]?\s*(.+)"
ACTIVITY_TAIL = r"(?i)\s+(?:cin|gstin|company\s+status|status|date\s+of|registered\s+office)\b.*$"
ACTIVITY_ENDS = r"^[:\-–—\s]+|[.:\-–—\s]+$"
NO_ACTIVITY = (
    "code", "activities", "business activity", "activity", "nic code", "class", "category", "n/a", "na", "error", "none", "not found", "unavailable", "null", "details", "description", "industry", "industrial class", "type", "sector",
)
GLOSS = (
    r"(?i)[\[(]\s*(?:(?:this|also)\s+)?(?:(?:sub[-\s]?class|class|group|division|section|category|heading|code)\s+)?"
    r"(?:includes?|excludes?|including|excluding|incl\.?|excl\.?|covers?|comprises?|comprising|for\s+example|e\.?\s?g\.?|such\s+as|namely|i\.?\s?e\.?|n\.?\s?e\.?\s?c\.?|not\s+elsewhere\s+classified)\b"
)
SITE = r"https?://[a-zA-Z0-9.\-]+"
ABOVE, BELOW, LEAST, CUT = 3, 3, 20, 250


def _any(c: Column, words) -> Column:
    return F.exists(F.array(*map(F.lit, words)), lambda w: c.contains(w))


def text_lines(text: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.trim(x)), lambda x: x != "")


def _stated(line: Column, label: Column) -> Column:
    """What follows an address's label, without filling words and the labels after it; null if it is short."""
    pattern = F.concat(F.lit(r"(?i)\b"), label, F.lit(r"\s*(?:is|:|-)?\s*(.*)"))
    said = F.trim(F.call_function("regexp_extract", line, pattern, F.lit(1)))
    bare = F.trim(F.regexp_replace(F.trim(F.regexp_replace(said, LEAD, "")), TAIL, ""))
    sentence = F.split(bare, r"\.")[0]
    return F.when(F.length(said) > 5, F.when(bare.contains(".") & (F.length(sentence) > 8), F.trim(sentence)).otherwise(bare))


def _first(found: Column) -> Column:
    return F.get(F.filter(found, lambda x: x.isNotNull()), F.lit(0))


def find_addresses(texts: DataFrame) -> DataFrame:
    """texts (..., text, target, confirmed) with address, NOT_FOUND where no line has one: of the first
    line with a label what it states, else the next line, else the next three; else a line with a
    six-digit PIN and a region, alone or with the two above it. Unless the page is confirmed to be the
    target's, a word of the target's name must stand in that line or the three above; a target without
    such words asks for nothing. Null texts have no lines, null targets ask for nothing."""
    names = F.when(~F.coalesce(F.col("confirmed"), F.lit(False)), target_tokens(F.coalesce("target", F.lit("")))).otherwise(F.array().cast("array<string>"))
    d = texts.withColumns({"_lines": text_lines(F.col("text")), "_names": names})
    d = d.withColumn("_low", F.transform("_lines", F.lower))
    lines, low = F.col("_lines"), F.col("_low")

    def linked(i: Column) -> Column:
        start = F.greatest(i - ABOVE, F.lit(0))
        window = F.array_join(F.slice(low, start + 1, i - start + 1), " ")
        return (F.size("_names") == 0) | F.exists("_names", lambda w: window.contains(w))

    def labelled(x: Column, i: Column) -> Column:
        small = F.get(low, i)
        present = F.filter(F.array(*map(F.lit, LABELS)), lambda w: small.contains(w))
        stated = F.transform(present, lambda w: _stated(x, w))
        below = F.array_join(F.filter(F.slice(lines, i + 2, F.lit(BELOW)), lambda y: ~_any(F.lower(y), NOT_BELOW)), ", ")
        tried = F.concat(F.slice(stated, 1, 1), F.array(F.get(lines, i + 1), below), F.slice(stated, F.lit(2), F.lit(len(LABELS))))
        ok = small.contains("address") | _any(small, LABELS)
        return F.when(ok & ~_any(small, DENIED) & linked(i), F.get(F.filter(tried, is_address_like), F.lit(0)))

    def loose(x: Column, i: Column) -> Column:
        small = F.get(low, i)
        start = F.greatest(i - 2, F.lit(0))
        above = F.array_join(F.filter(F.slice(lines, start + 1, i - start + 1), lambda y: ~_any(F.lower(y), NOT_ABOVE)), " | ")
        tried = F.array(F.trim(F.regexp_replace(x, LOOSE_LEAD, "")), above)
        return F.when(x.rlike(r"\b[0-9]{6}\b") & _any(small, STATES) & ~_any(small, DENIED_LOOSE) & linked(i), F.get(F.filter(tried, is_address_like), F.lit(0)))

    address = F.coalesce(_first(F.transform(lines, labelled)), _first(F.transform(lines, loose)), F.lit("NOT_FOUND"))
    return d.withColumn("address", address).drop("_lines", "_low", "_names")


def find_activity(text: Column) -> Column:
    """The first line's activity after a label that is no mere label, number or gloss; else NOT_FOUND."""

    def said(x: Column) -> Column:
        v = F.trim(F.regexp_replace(F.regexp_replace(F.trim(F.regexp_extract(x, ACTIVITY, 1)), ACTIVITY_TAIL, ""), ACTIVITY_ENDS, ""))
        return F.when(~F.lower(v).isin(*NO_ACTIVITY) & (F.length(v) >= 4) & ~v.rlike("^[0-9]+$") & ~v.rlike(GLOSS), v)

    return F.coalesce(_first(F.transform(text_lines(text), said)), F.lit("NOT_FOUND"))


def page_fields(pages: DataFrame) -> DataFrame:
    """(page_id, website, description, activity) of pages (page_id, url, text): the url, else the first
    address of a site in the text; the first line of over 20 characters, cut to 250; the activity."""
    lines, text = text_lines(F.col("text")), F.coalesce("text", F.lit(""))
    site = F.coalesce(F.nullif("url", F.lit("")), F.nullif(F.regexp_extract(text, SITE, 0), F.lit("")), F.lit("NOT_FOUND"))
    told = F.coalesce(F.substring(_first(F.filter(lines, lambda x: F.length(x) > LEAST)), 1, CUT), F.lit("NOT_FOUND"))
    return pages.select("page_id", site.alias("website"), told.alias("description"), find_activity(F.col("text")).alias("activity"))
