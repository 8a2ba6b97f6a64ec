"""Whether a page is about its target: relationship, conflict and verdict, and the gate on them.

A page is first cut down to a profile (title, leading text, identifiers, tokens of the name that it
claims), so that the join with targets carries no page texts.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from probitas.operators.pages import TITLE, fetch_failure, plain_text
from probitas.sources import catalog as C

# Words that don't tell names apart, and how much of a text counts for what.
RELATION_WORDS = (
    "pvt", "ltd", "limited", "private", "llp", "corp", "inc", "co", "company", "official", "website", "the", "and", "in", "india", "services", "solutions", "group",
    "http", "https", "www", "com", "org", "net", "io", "gov", "edu", "html", "htm",
)
NAME_WORDS = ("pvt", "private", "ltd", "limited", "llp", "llc", "inc", "incorporated", "corp", "corporation", "co", "company", "the", "and", "of", "group", "india", "official", "website")
HINTS = (
    "epfo", "epf", "mca", "gst", "gstin", "cin", "establishment", "registration", "registered", "company", "companies", "master", "data", "portal", "search", "records", "record", "verification", "verify", "profile",
    "details", "detail", "financials", "corporate", "affairs", "ministry", "taxpayer",
)
SUFFIXES = "pvt|private|ltd|limited|llp|llc|inc|incorporated|corp|corporation|gmbh|plc"
IDS = {"gstin": r"[0-9]{2}[A-Z]{5}[0-9]{4}[A-Z][0-9A-Z]Z[0-9A-Z]", "cin": "[UL][0-9]{5}[A-Z]{2}[0-9]{4}[A-Z]{3}[0-9]{6}"}
IDS_IN_TARGET = {"gstin": "[0-9]{2}[a-z]{5}[0-9]{4}[a-z][1-9a-z]z[0-9a-z]", "cin": "[ul][0-9]{5}[a-z]{2}[0-9]{4}[a-z]{3}[0-9]{6}"}
GROUP_TITLE = r"\b(?:the\s+[a-z0-9]+\s+group|group\s+of\s+companies|holding\s+company|conglomerate)\b"
TITLE_END = r"\s+[-|–—:]\s+|\s*\|\s*"
RELATION_CHARS, CONFLICT_CHARS, CLAIM_CHARS = 1500, 2000, 2500
WEBSITE_CONFIDENCE = {"TARGET_ENTITY": 0.85, "RELATED_ENTITY": 0.50}

#: Ends of a word in any script; \b differs between engines.
START, STOP = r"(?:^|[^\p{L}\p{N}_])", r"(?:$|[^\p{L}\p{N}_])"
SUFFIX_IN_TITLE = rf"(?i){START}(?:{SUFFIXES}|s\.?a){STOP}"
NAME_SPAN = rf"(?i)([a-z][a-z0-9&.\-'()/ ]{{2,110}}?\b(?:{SUFFIXES})){STOP}"


def relation_tokens(target: Column) -> Column:
    """Whole words of a-z and 0-9 of the lower-cased target, but for common ones; repeats stay."""
    return F.filter(F.split(target, r"[^\p{L}\p{N}_]+"), lambda w: w.rlike("^[a-z0-9]{3,}$") & ~w.isin(*RELATION_WORDS))


def name_tokens(c: Column) -> Column:
    found = F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))
    return F.array_distinct(F.filter(found, lambda w: (F.length(w) > 2) & ~w.isin(*NAME_WORDS)))


def without_hints(tokens: Column) -> Column:
    return F.filter(tokens, lambda w: ~w.isin(*HINTS))


def target_tokens(target: Column) -> Column:
    """Tokens of a target's legal name: closing search words, identifiers and other hints taken out."""
    words = F.split(F.trim(F.regexp_replace(target, r"\s+", " ")), " ")
    last = F.array_max(F.transform(words, lambda w, i: F.when(F.regexp_replace(F.lower(w), "[^a-z]", "").isin(*HINTS), 0).otherwise(i + 1)))
    bare = F.upper(F.array_join(F.slice(words, F.lit(1), last), " "))
    return without_hints(name_tokens(reduce(lambda v, p: F.regexp_replace(v, rf"\b{p}\b", " "), IDS.values(), bare)))


def claimed_tokens(title: Column, text: Column) -> Column:
    """Tokens of the name that a page claims: in its title, and in the first leading line with a legal name."""
    head = F.get(F.split(F.coalesce(title, F.lit("")), TITLE_END), F.lit(0))
    span = lambda c: F.regexp_extract(c, NAME_SPAN, 1)
    titled = without_hints(name_tokens(F.when(span(head) != "", span(head)).otherwise(head)))
    lines = F.transform(F.split(F.substring(text, 1, CLAIM_CHARS), "\n"), lambda x: without_hints(name_tokens(span(F.trim(x)))))
    first = F.coalesce(F.get(F.filter(lines, lambda t: F.size(t) > 0), F.lit(0)), F.array().cast("array<string>"))
    return F.array_union(titled, first)


def _ids(c: Column, pattern: str) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.upper(c), F.lit(rf"\b({pattern})\b"), F.lit(1)))


def page_profiles(pages: DataFrame) -> DataFrame:
    """pages (page_id, host, title, text) as what their identity depends on; nulls are empty."""
    title, text = F.coalesce("title", F.lit("")), F.coalesce("text", F.lit(""))
    return pages.select(
        "page_id", F.regexp_replace(F.lower(F.coalesce("host", F.lit(""))), r"^www\.", "").alias("host"), F.lower(F.trim(title)).alias("title"), F.substring(F.lower(text), 1, RELATION_CHARS).alias("head"),
        *(_ids(F.concat_ws("\n", title, text), p).alias(f"page_{k}") for k, p in IDS.items()), claimed_tokens(title, text).alias("claimed"), name_tokens(title).alias("title_tokens"), title.rlike(SUFFIX_IN_TITLE).alias("incorporated"),
        name_tokens(F.substring(text, 1, CONFLICT_CHARS)).alias("text_tokens"),
    )


def relationship(target: Column, host: Column, title: Column, head: Column) -> Column:
    """TARGET_ENTITY, PARENT_ENTITY, RELATED_ENTITY or UNRELATED, from a target and the columns of a profile."""
    low = F.lower(F.trim(F.coalesce(target, F.lit(""))))
    tokens = relation_tokens(low)
    n, among = F.size(tokens), lambda c: F.size(F.filter(tokens, lambda w: c.contains(w)))
    in_title, in_head = among(title), among(head)
    url = F.regexp_replace(F.regexp_replace(F.regexp_replace(low, "https?://", ""), "/+$", ""), r"^www\.", "")
    own = (host != "") & (low.contains(host) | host.contains(url) | ((n == 1) & host.contains(F.get(tokens, F.lit(0)))))
    said = lambda p: (F.regexp_extract(low, rf"\b({p})\b", 1) != "") & head.contains(F.regexp_extract(low, rf"\b({p})\b", 1))
    return (
        F.when(F.coalesce(own, F.lit(False)) | said(IDS_IN_TARGET["gstin"]) | said(IDS_IN_TARGET["cin"]) | (n == 0), "TARGET_ENTITY")
        .when(title.rlike(GROUP_TITLE) & (n > 1) & (in_title < n), "PARENT_ENTITY")
        .when((in_title == n) | ((n > 1) & (in_title >= n - 1)) | (in_head >= n), "TARGET_ENTITY")
        .when((n > 1) & ((in_title == 1) | (in_head == 1)), "PARENT_ENTITY")
        .when((in_head > 0) | (in_title > 0), "RELATED_ENTITY")
        .otherwise("UNRELATED")
    )


def page_identity(profiles: DataFrame, tasks: DataFrame) -> DataFrame:
    """tasks (page_id, target, ...) with relationship, conflict and verdict (MATCH, CONFLICT or
    INSUFFICIENT) of the page; tasks whose page is unknown go. A null target is the empty string."""
    d = tasks.withColumn("_t", F.coalesce("target", F.lit(""))).withColumns({f"_{k}": _ids(F.col("_t"), p) for k, p in IDS.items()} | {"_name": target_tokens(F.col("_t")), "_all": name_tokens(F.col("_t"))})
    d = d.join(profiles, "page_id")
    both = {k: (F.size(f"_{k}") > 0) & (F.size(f"page_{k}") > 0) for k in IDS}
    same = {k: F.arrays_overlap(f"_{k}", f"page_{k}") for k in IDS}
    differs, agrees = (both["gstin"] & ~same["gstin"]) | (both["cin"] & ~same["cin"]), same["gstin"] | same["cin"]
    stranger = (F.size("_all") >= 2) & (F.size("title_tokens") > 0) & F.col("incorporated") & ~F.arrays_overlap("_all", "title_tokens") & ~F.arrays_overlap("_all", "text_tokens")
    n, shared, extra = F.size("_name"), F.size(F.array_intersect("_name", "claimed")), F.size(F.array_except("claimed", "_name"))
    verdict = (
        F.when(differs, "CONFLICT").when(agrees, "MATCH").when((n == 0) | (F.size("claimed") == 0), "INSUFFICIENT")
        .when((shared <= 1) & (n >= 2), F.when(extra > 0, "CONFLICT").otherwise("INSUFFICIENT"))
        .when((shared * 10 >= n * 6) & (extra == 0), "MATCH").when((extra > 0) & (shared < n), "CONFLICT").otherwise("INSUFFICIENT")
    )
    made = {"relationship": relationship(F.col("_t"), F.col("host"), F.col("title"), F.col("head")), "conflict": differs | stranger, "verdict": verdict}
    return d.select(*tasks.columns, *(c.alias(k) for k, c in made.items()))


def entity_gate(identified: DataFrame) -> DataFrame:
    """identified (task_type, relationship, conflict, verdict) with gate, REJECTED or null, and the
    confidence of an admitted website, else null."""
    kind, rel, conflict = F.col("task_type"), F.col("relationship"), F.col("conflict")
    bad = (
        F.when(kind == C.WEBSITE, ~rel.isin(*WEBSITE_CONFIDENCE)).when(kind == C.THIRD, (F.col("verdict") != "MATCH") | conflict).when(kind == C.GENERAL, conflict)
        .when(kind.isin(C.GST, C.MCA, C.EPFO), (rel == "UNRELATED") & conflict)
    )
    trust = reduce(lambda a, r: a.when((kind == C.WEBSITE) & (rel == r[0]), r[1]), WEBSITE_CONFIDENCE.items(), F.when(F.lit(False), 0.0))
    return identified.withColumns({"gate": F.when(bad, "REJECTED"), "site_confidence": trust})


# Sectors that a page must share with its target, and what vouches for a page.
SECTORS = ("hotel", "resort", "inn", "suites", "motel", "pharma", "pharmaceutical", "hospital", "clinic", "coaching", "academy", "classes", "tuition", "huel", "adult", "casino", "dating", "escort")
PORTALS = (
    "search taxpayer", "goods and services tax", "gst portal", "gst services", "ministry of corporate affairs", "mca services", "company master data", "employees' provident fund", "epfo", "epfindia", "electronic challan",
    "income tax department", "quickcompany", "tofler", "zauba corp", "instafinancials",
)
SIGNALS = ("gst status", "company status", "mca status", "legal name", "cin", "gstin", "private limited", "limited", "pvt ltd", "registered address", "incorporation date")
OUTCOME_WORDS = (
    "limited", "pvt", "ltd", "private", "corporation", "corp", "inc", "incorporated", "co", "company", "and", "the", "official", "website", "registration", "establishment", "search", "portal", "mca", "epfo",
)
LEADING_CHARS, JUDGED_WORDS = 300, 15


def irrelevance(target: Column, title: Column, text: Column) -> Column:
    """IRRELEVANT_SECTOR or IRRELEVANT_CONTENT for a page that has nothing of its target, else null."""
    t, title, text = F.lower(F.trim(F.coalesce(target, F.lit("")))), F.lower(F.coalesce(title, F.lit(""))), F.lower(F.coalesce(text, F.lit("")))
    lead = F.concat(F.lit(" "), F.substring(text, 1, LEADING_CHARS), F.lit(" "))
    has = lambda c, words: F.exists(F.array(*map(F.lit, words)), lambda w: c.contains(w))
    sector = F.exists(F.array(*map(F.lit, SECTORS)), lambda w: ~t.contains(w) & (title.contains(w) | lead.contains(F.concat(F.lit(" "), w, F.lit(" ")))))
    found = {k: F.regexp_extract(t, rf"\b({p})\b", 1) for k, p in IDS_IN_TARGET.items()}
    named = (found["gstin"] != "") | (found["cin"] != "")
    held = reduce(lambda a, b: a | b, ((v != "") & (text.contains(v) | title.contains(v)) for v in found.values()))
    signals = has(text, SIGNALS)
    vouched = has(text, PORTALS) | has(title, PORTALS) | held | (signals & named)
    plain = F.regexp_replace(text, "[^a-z0-9]", "")
    site = F.regexp_replace(F.split(F.trim(F.replace(F.coalesce(F.nullif(F.regexp_extract(t, "^[^/?#]*://([^/?#]+)", 1), F.lit("")), t), F.lit("www."), F.lit(""))), r"\.")[0], "[^a-z0-9]", "")
    words = F.filter(F.split(t, r"[^\p{L}\p{N}_]+"), lambda w: ~w.isin(*OUTCOME_WORDS) & (F.length(w) > 2))
    n, hits = F.size(words), F.size(F.filter(words, lambda w: text.contains(w) | title.contains(w)))
    missing = (
        F.when(t.contains(".") | t.contains("/"), (F.length(site) > 2) & ~plain.contains(site) & ~title.contains(site))
        .when(t.rlike(r"\p{Nd}") & (F.length(t) > 5) & ~t.contains(" "), ~plain.contains(F.regexp_replace(t, "[^a-z0-9]", "")) & ~signals)
        .when(n > 1, (hits < 2) | (hits * 2 < n)).when(n == 1, hits < 1).otherwise(~text.contains(t) & ~title.contains(t))
    )
    judged = F.size(F.filter(F.split(text, r"\s+"), lambda w: w != "")) >= JUDGED_WORDS
    return F.when(sector, "IRRELEVANT_SECTOR").when(judged & ~vouched & missing, "IRRELEVANT_CONTENT")


def page_outcome(pages: DataFrame, tasks: DataFrame) -> DataFrame:
    """tasks (page_id, target, ...) with outcome: why the page (page_id, html) can't be used, from the
    page alone or for this target; null if it can. Null targets are empty strings."""
    text = plain_text(F.col("html"))
    title = F.regexp_extract(F.coalesce("html", F.lit("")), TITLE, 1)
    read = pages.select("page_id", title.alias("_title"), text.alias("_text"), fetch_failure(F.col("html"), text).alias("_failure"))
    outcome = F.coalesce("_failure", irrelevance(F.col("target"), F.col("_title"), F.col("_text")))
    return tasks.join(read, "page_id").select(*(tasks[c] for c in tasks.columns), outcome.alias("outcome"))
