"""Links of result pages and directories: which ones a page offers, how well each fits a task's target,
the best one, and the page it leads to."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from probitas.operators.pages import fetch_failure, plain_text

# Links of result pages, redirects among them, and links to a directory's records.
RESULT_LINK = r"""(?i)href=["']((?:https?:)?//[^"']+|/l/\?[^"']+|/html/\?[^"']+|/lite/\?[^"']+|/url\?[^"']+|/y\.js\?[^"']+)["']"""
REDIRECT = r"""(?:uddg|url\?q)=([^&"']+)"""
RECORD_LINK, RECORD_PATHS = r"""(?i)href=["']([^"'#?]+)["']""", ("/company/", "/companysearchresults/", "/gstin/")
# Sites and sectors that are never the target's, directories, and words that don't tell names apart.
ENGINES = ("duckduckgo.com", "bing.com", "google.com", "yahoo.com", "youtube.com", "facebook.com", "twitter.com", "x.com", "instagram.com", "pinterest.com")
SECTORS = (
    "hotel", "resort", "inn", "suites", "motel", "pharma", "pharmaceutical", "pharmacy", "drugs", "hospital", "clinic", "coaching", "academy", "classes", "tuition", "huel", "adult", "casino", "dating", "escort", "porn", "xxx", "sex",
    "cricinfo", "cricket", "imdb", "movie", "cinema", "football",
)
DIRECTORIES = ("zaubacorp.com", "tofler.in", "instafinancials.com", "quickcompany.in")
AGGREGATORS = (
    "zaubacorp.com", "tofler.in", "quickcompany.in", "instafinancials.com", "indiafilings.com", "company360.in", "economictimes.indiatimes.com", "indiamart.com", "tradeindia.com", "justdial.com", "fundoodata.com", "instahyre.com",
    "ambitionbox.com", "glassdoor.com", "crunchbase.com", "mca.gov.in", "gst.gov.in", "epfindia.gov.in", "incometax.gov.in", "wikipedia.org", "github.com",
)
STOP_WORDS = (
    "pvt", "ltd", "limited", "private", "llp", "corp", "inc", "co", "company", "official", "website", "the", "and", "in", "india", "group", "http", "https", "www", "com", "org", "net", "io", "gov", "edu", "html", "htm",
)
NO_INITIAL = ("pvt", "ltd", "limited", "private", "llp", "the", "and", "in", "co", "inc", "group")
TARGET_IDS = (r"\b([0-9]{2}[a-z]{5}[0-9]{4}[a-z][1-9a-z]z[0-9a-z])\b", r"\b([ul][0-9]{5}[a-z]{2}[0-9]{4}[a-z]{3}[0-9]{6})\b")
ACRONYM_OVERLAP, LEAST_SCORE, KEPT = 0.95, 0.40, ("TARGET_ENTITY", "RELATED_ENTITY")
#: The outcomes (score, relationship) of the rules, by reason.
OUTCOMES = {
    "INVALID_URL": (0.0, "UNRELATED"), "SEARCH_OR_SOCIAL_SITE": (0.0, "UNRELATED"), "OTHER_SECTOR": (0.0, "UNRELATED"), "IDENTIFIER_IN_URL": (1.0, "TARGET_ENTITY"), "NO_DISTINCTIVE_WORD": (0.50, "UNKNOWN"),
    "DIRECTORY_NO_WEBSITE": (0.0, "UNRELATED"), "WEBSITE_STRONG": (0.90, "TARGET_ENTITY"), "WEBSITE_ONE_WORD": (0.35, "PARENT_ENTITY"), "WEBSITE_PARTIAL": (0.50, "RELATED_ENTITY"),
    "DIRECTORY_STRONG": (0.95, "TARGET_ENTITY"), "DIRECTORY_PARTIAL": (0.50, "RELATED_ENTITY"), "THIRD_PARTY_STRONG": (0.75, "TARGET_ENTITY"), "THIRD_PARTY_PARTIAL": (0.40, "RELATED_ENTITY"),
    "STRONG": (0.85, "TARGET_ENTITY"), "MODERATE": (0.60, "RELATED_ENTITY"), "NO_OVERLAP": (0.0, "UNRELATED"),
}


def _holds(c: Column, words) -> Column:
    return reduce(lambda a, b: a | b, (c.contains(w) for w in words))


def site_of(url: Column) -> Column:
    """Host in lower case without www.; empty for what has no scheme."""
    return F.replace(F.lower(F.regexp_extract(url, "^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)), F.lit("www."), F.lit(""))


def _let(value: Column, body) -> Column:
    """body of a value that is computed once, however often body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _overlap(p: Column) -> Column:
    """Number of distinctive words (n), of those in the link (m), and their share (o)."""
    counts = F.struct(F.size(p["tokens"]).alias("n"), F.size(F.filter(p["tokens"], lambda w: p["label"].contains(w) | p["flat"].contains(w))).alias("m"))
    short = (p["acronym"] == p["label"]) | p["path"].contains(F.concat(F.lit("/"), p["acronym"])) | p["site"].contains(F.concat(F.lit("-"), p["acronym"]))
    least = F.when(F.coalesce(short, F.lit(False)), ACRONYM_OVERLAP).otherwise(0.0)
    return _let(counts, lambda c: F.struct(c["n"].alias("n"), c["m"].alias("m"), F.greatest(least, F.when(c["n"] == 0, 0.0).otherwise(c["m"] / c["n"])).alias("o")))


def _reason(p: Column, q: Column, task_type: Column) -> Column:
    stranger = F.exists(F.array(*map(F.lit, SECTORS)), lambda w: (p["site"].contains(w) | p["path"].contains(F.concat(F.lit("/"), w))) & ~p["low"].contains(w))
    named = reduce(lambda a, b: a | b, ((F.regexp_extract(p["low"], i, 1) != "") & F.lower(p["url"]).contains(F.regexp_extract(p["low"], i, 1)) for i in TARGET_IDS))
    website = (
        F.when(_holds(p["site"], AGGREGATORS), "DIRECTORY_NO_WEBSITE").when(q["o"] >= 0.60, "WEBSITE_STRONG").when((q["o"] > 0) & (q["n"] > 1) & (q["m"] == 1), "WEBSITE_ONE_WORD").when(q["o"] > 0, "WEBSITE_PARTIAL").otherwise("NO_OVERLAP")
    )
    kind = F.when(_holds(p["site"], DIRECTORIES), "DIRECTORY").otherwise("THIRD_PARTY")
    third = F.when(q["o"] >= 0.50, F.concat(kind, F.lit("_STRONG"))).when(q["o"] > 0, F.concat(kind, F.lit("_PARTIAL"))).otherwise("NO_OVERLAP")
    return (
        F.when(~p["url"].rlike("^https?://"), "INVALID_URL").when(_holds(p["site"], ENGINES), "SEARCH_OR_SOCIAL_SITE").when(stranger, "OTHER_SECTOR").when(named, "IDENTIFIER_IN_URL").when(q["n"] == 0, "NO_DISTINCTIVE_WORD")
        .when(task_type == "WEBSITE_VERIFICATION", website).when(task_type == "THIRD_PARTY_RESEARCH", third)
        .when(q["o"] >= 0.60, "STRONG").when(q["o"] >= 0.30, "MODERATE").otherwise("NO_OVERLAP")
    )


def search_links(pages: DataFrame) -> DataFrame:
    """(page_id, pos, link): a result page's links to other sites, each once, in order; redirects of
    search engines are decoded, and go unless they lead to http or https. Null pages have none."""

    def target(h: Column) -> Column:
        to = F.regexp_extract(h, REDIRECT, 1)
        decoded = F.coalesce(F.try_url_decode(F.replace(to, F.lit("+"), F.lit("%2B"))), to)
        redirect = h.contains("uddg=") | h.contains("url?q=")
        return F.when(redirect, F.when(decoded.rlike("^https?://"), decoded)).when(h.startswith("//"), F.concat(F.lit("https:"), h)).when(h.rlike("^https?://"), h)

    found = F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(RESULT_LINK), F.lit(1))
    return pages.select("page_id", F.posexplode(F.array_distinct(F.array_compact(F.transform(found, target)))).alias("pos", "link"))


def score_links(links: DataFrame) -> DataFrame:
    """links (url, target, task_type, ...) with score, relationship, reason and overlap: the share of the
    target's distinctive words in the link's host and path, 0.95 at least where its initials stand
    there. Null urls are invalid, null targets have no words, null task types go by the general rule."""
    url, low = F.coalesce("url", F.lit("")), F.lower(F.trim(F.coalesce("target", F.lit(""))))
    words = F.filter(F.split(low, r"[^\p{L}\p{N}_]+"), lambda w: w.rlike("^[a-z0-9]+$"))
    initials = F.filter(words, lambda w: ~w.isin(*NO_INITIAL))
    acronym = F.when(F.size(initials) >= 2, F.array_join(F.transform(initials, lambda w: F.substring(w, 1, 1)), ""))
    path = F.lower(F.regexp_replace(F.regexp_extract(url, "^https?://[^/?#]*([^?#]*)", 1), ";[^/]*$", ""))
    bare = lambda c: F.regexp_replace(c, "[^a-z0-9]", "")
    parts = F.struct(
        low.alias("low"), site_of(url).alias("site"), path.alias("path"), bare(F.get(F.split(site_of(url), r"\."), F.lit(0))).alias("label"), bare(path).alias("flat"),
        F.filter(words, lambda w: (F.length(w) > 2) & ~w.isin(*STOP_WORDS)).alias("tokens"), acronym.alias("acronym"), url.alias("url"),
    )
    scored = _let(parts, lambda p: _let(_overlap(p), lambda q: F.struct(_reason(p, q, F.col("task_type")).alias("reason"), q["o"].alias("overlap"))))
    d = links.withColumn("link_", scored)
    of = lambda i: F.create_map(*(F.lit(x) for k, v in OUTCOMES.items() for x in (k, v[i])))[F.col("link_.reason")]
    return d.select(*links.columns, of(0).alias("score"), of(1).alias("relationship"), "link_.reason", "link_.overlap")


def discover_links(pages: DataFrame, tasks: DataFrame) -> DataFrame:
    """(page_id, task_id, pos, link, score, relationship) for tasks (page_id, task_id, target, task_type):
    links of the task's page to records of the same site that fit the target well enough."""
    site = site_of(F.coalesce("url", F.lit("")))
    found = F.filter(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(RECORD_LINK), F.lit(1)), lambda h: _holds(F.lower(h), RECORD_PATHS))
    whole = F.transform(found, lambda h: F.when(h.startswith("http"), h).otherwise(F.concat(F.lit("https://www."), site, F.lit("/"), F.regexp_replace(h, "^/+", ""))))
    own = F.array_distinct(F.filter(whole, lambda u: F.lower(u).contains(site) & (u != F.coalesce("url", F.lit("")))))
    links = pages.select("page_id", F.posexplode(own).alias("pos", "url"))
    scored = score_links(links.join(tasks.select("page_id", "task_id", "target", "task_type"), "page_id"))
    fit = [reason for reason, (score, relation) in OUTCOMES.items() if score >= LEAST_SCORE or relation in KEPT]
    return scored.filter(F.col("reason").isin(*fit)).select("page_id", "task_id", "pos", F.col("url").alias("link"), "score", "relationship")


def best_links(found: DataFrame) -> DataFrame:
    """(page_id, task_id, link, score): of each task and page the link of highest score, the first of equal ones."""
    best = F.max_by(F.struct("link", "score"), F.struct("score", -F.col("pos")))
    return found.groupBy("page_id", "task_id").agg(best.alias("b")).select("page_id", "task_id", "b.link", "b.score")


def follow_links(pages: DataFrame, tasks: DataFrame, best: DataFrame) -> DataFrame:
    """tasks with used_page_id: the page that the best link leads to, if it was fetched and can be used,
    else the task's own page. Of pages of one url the least id counts. Only ids and urls are joined."""
    usable = pages.filter(fetch_failure(F.col("html"), plain_text(F.col("html"))).isNull()).groupBy(F.col("url").alias("link")).agg(F.min("page_id").alias("to_"))
    led = best.select("page_id", "task_id", "link").join(usable, "link").select("page_id", "task_id", "to_")
    return tasks.join(led, ["page_id", "task_id"], "left").select(*tasks.columns, F.coalesce("to_", "page_id").alias("used_page_id"))
