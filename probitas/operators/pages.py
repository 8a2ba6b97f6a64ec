"""Pages to text, identifiers and links, in column functions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Patterns that results depend on.
SPACES = r"[\s\x{A0}]+"
INJECTIONS = (
    (r"(?i)\bignore\s+(?:previous|all|the|above|below)?\s*instructions\b", "[neutralized prompt injection instruction]"),
    (r"(?i)\bignore\s+rules\b", "[neutralized prompt injection rules]"),
    (r"(?i)\bignore\s+the\s+rules\b", "[neutralized prompt injection rules]"),
    (r"(?i)\bignore\s+previous\s+directives\b", "[neutralized prompt injection directive]"),
    (r"(?i)\byou\s+are\s+now\b", "[neutralized role-play instruction]"),
    (r"(?i)\bsystem\s+(?:prompt|instruction|directives)\b", "[neutralized system label]"),
    (r"(?i)\bdeveloper\s+instructions\b", "[neutralized system label]"),
)
IDENTIFIERS = {
    "gstin": r"\b([0-9]{2}[A-Z]{5}[0-9]{4}[A-Z]{1}[1-9A-Z]{1}Z[0-9A-Z]{1})\b",
    "cin": r"\b([UL][0-9]{5}[A-Z]{2}[0-9]{4}[A-Z]{3}[0-9]{6})\b",
    "epfo_code": r"\b([A-Z]{2}\s*/\s*[A-Z0-9]{3,7}\s*/\s*[0-9]{5,7}(?:\s*/\s*[0-9]{3})?)\b",
    "pan": r"\b([A-Z]{5}[0-9]{4}[A-Z]{1})\b",
}
# Pages that ask for something, are blocked, or found nothing; the first that fits counts.
TITLE = r"(?is)<title[^>]*>(.*?)</title>"
CAPTCHA_TITLES = ("captcha", "robot verification", "verify you are human", "attention required", "security check")
CAPTCHA = (
    "recaptcha", "hcaptcha", "g-recaptcha", "bot verification", "verify you are human", "robot check", "prove you're not a robot", "please solve the captcha", "solve the captcha", "security check to proceed", "complete the captcha",
    "cf-browser-verification", "cf-im-under-attack", "distribute captcha", "enter captcha", "captcha code", "captcha image", "name='captcha'", 'name="captcha"', "id='captcha'", 'id="captcha"',
)
OTP = (
    r"enter\s+(?:the\s+)?(?:[0-9]-digit\s+)?otp", r"please\s+enter\s+(?:the\s+)?otp", r"enter\s+(?:the\s+)?one-time\s+password", r"enter\s+(?:the\s+)?one\s+time\s+password", r"verification\s+code\s+sent\s+to\s+your",
    r"enter\s+verification\s+code\s+sent", r"two-factor\s+authentication\s+required", r"two-factor\s+authentication\s+code", r"""<input[^>]+name=['"](?:otp|otp_code|verification_code)['"]""",
)
LOGIN = ("login required", "please log in", "please sign in", "sign in to your account", "authentication required", "member login", "sign in to proceed", "log in to continue", "sign in to continue")
BLOCKED = (
    "access denied", "403 forbidden", "403 error", "404 not found", "404 error", "page not found", "401 unauthorized", "503 service unavailable", "502 bad gateway", "500 internal server error", "attention required! | cloudflare",
    "cf-browser-verification", "error code 1020", "requested url was rejected", "security check to proceed", "duckduckgo privacy error", "anonymized error code", "protection. privacy. peace of mind",
)
BLOCKED_TITLES = ("access denied", "forbidden", "attention required", "error", "unauthorized", "404", "not found", "page not found", "duckduckgo", "bing search", "google search", "yahoo search")
NO_RESULTS = ("no results found", "0 results", "no records found", "no data found", "record not found", "invalid gstin", "invalid cin", "invalid format")
# Words of a status, in the order in which a line is searched for them.
STATUSES = (
    ("ACTIVE", ("active",)), ("INACTIVE", ("inactive",)), ("CANCELLED", ("cancelled", "canceled")), ("SUSPENDED", ("suspended",)), ("STRIKE OFF", ("strike off", "struck off", "strikeoff")), ("AMALGAMATED", ("amalgamated",)),
    ("UNDER LIQUIDATION", ("under liquidation", "in liquidation")), ("DORMANT", ("dormant",)), ("DISSOLVED", ("dissolved",)),
)
STATUS_WORDS = ("active", "inactive", "cancelled", "suspended", "allocated", "struck off")
FOUNDED = ("incorporated", "incorporation", "established", "founded", "estd")
YEAR, DAY = r"\b(19\d{2}|20\d{2})\b", r"\b\d{1,2}[-/]\d{1,2}[-/]\d{2,4}\b|\b\d{4}[-/]\d{1,2}[-/]\d{1,2}\b"
# What an EPFO record says of an establishment that is gone, else of one that is there.
EPFO_GONE, EPFO_THERE = ("inactive", "closed", "cancelled"), ("active", "exempted", "registered", "establishment details", "epfo")
# Fields in which a task may find its own target, and shapes that belong in few fields.
OWN_TARGET = {
    "ENTITY_DISCOVERY": ("candidate_entities",), "GST_VERIFICATION": ("gstin",), "MCA_VERIFICATION": ("cin",), "EPFO_VERIFICATION": ("epfo_code",),
    "WEBSITE_VERIFICATION": ("website", "website_url", "domain", "candidate_domain", "page_title", "title"),
    "GENERAL_WEB_RESEARCH": ("company_name", "business_name", "legal_name"), "THIRD_PARTY_RESEARCH": ("company_name", "business_name", "legal_name"),
}
# What is no address, and the parts that an address has.
NO_ADDRESS = (
    "not_found", "unavailable", "unknown", "error", "blocked", "irrelevant", "source_unavailable", "captcha_required", "not applicable", "n/a", "na", "none", "null", "something went wrong", "access denied", "403 forbidden", "page not found",
    "404 not found", "503 service unavailable", "502 bad gateway", "500 internal server error", "empty_response",
)
FILINGS = ("patent number", "patent journal", "patent watch", "trademark", "computer science", "amendment", "registration core fields", "core fields", "director details", "signatory details", "shareholder", "balance sheet", "din :", "din:", "pan :", "pan:")
HEADINGS = (
    "nature of business activities", "nature of business", "business activity", "business activities", "principal business activity", "main activity", "activity description", "principal place of business", "principal place",
    "registered office address", "registered office", "registered address", "establishment address", "corporate office", "office address", "contact details", "contact us", "about us", "terms of service", "privacy policy", "copyright",
    "all rights reserved", "company master data", "taxpayer details", "filing status", "director details", "directors / signatory details", "charges / balance sheet", "search taxpayer", "search company", "search results", "navigation",
    "home / about", "view financials", "financial details", "status: active", "gstin / uin", "cin / llpin", "trade name", "legal name", "company status", "date of incorporation", "jurisdiction", "constitution of business", "administrative office",
)
ACTIVITIES = (
    "software publishing", "consultancy and supply", "other service activities", "manufacture of", "wholesale of", "retail trade", "wholesale trade", "legal activities", "accounting, bookkeeping", "management consultancy",
    "architectural and engineering", "advertising and market", "publishing of", "telecommunications", "financial service activities", "insurance, reinsurance", "construction of buildings", "civil engineering", "specialised construction",
    "food and beverage service", "accommodation", "information service activities",
)
PIN = r"\b[1-9][0-9]{5}\b|\b[0-9]{5}(?:-[0-9]{4})?\b"
PARTS = (
    r"floor|flr|ground\s+floor|first\s+floor|second\s+floor|third\s+floor|4th\s+floor|5th\s+floor|6th\s+floor|7th\s+floor|8th\s+floor|9th\s+floor|10th\s+floor", "building|bldg|tower|towers|park|plaza|court|heights|house|mansion|bhavan|bhawan",
    "road|rd|street|st|marg|lane|path|avenue|ave|drive|crescent|way|circle|chowk|bypass|highway", r"plot|no\.?|house\s+no|h\.?no|flat|unit|suite|office|off\.?|room|cabin|premises|block|blk|sector|sec|phase|ph",
    r"nagar|colony|enclave|complex|estate|vihar|puram|wadi|peth|layout|industrial\s+area|ind\s+area|midc|gidc|riico|sez", "point|hub|centre|center|square|sq|cross|main|junction|opposite|opp|near|nr|behind|adj",
)
REGIONS = (
    "maharashtra", "karnataka", "delhi", "new delhi", "tamil nadu", "telangana", "gujarat", "west bengal", "haryana", "uttar pradesh", "mumbai", "bengaluru", "bangalore", "chennai", "hyderabad", "kolkata", "pune", "gurgaon", "gurugram",
    "noida", "ahmedabad", "jaipur", "chandigarh", "kochi", "coimbatore", "indore", "india", "bharat",
)
ANY_SHAPE = ("candidate_entities", "source_text", "page_text", "content")
MARKUP = ((r"(?is)<script[^>]*>.*?</script>", " "), (r"(?is)<style[^>]*>.*?</style>", " "), (r"(?i)<(?:/div|/p|/h[1-6]|/tr|/li|br\s*/?|/td|/section|/article)>", "\n"), (r"<[^>]+>", " "))
LINK = r"""(?i)href=["']([^"']+)["']"""


def neutralize(c: Column) -> Column:
    return reduce(lambda v, p: F.regexp_replace(v, p[0], p[1]), INJECTIONS, c)


def clean(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, SPACES, " "))


def plain_text(html: Column) -> Column:
    plain = reduce(lambda v, p: F.regexp_replace(v, p[0], p[1]), MARKUP, F.coalesce(html, F.lit("")))
    return F.array_join(F.filter(F.transform(F.split(plain, "\n"), clean), lambda x: x != ""), "\n")


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Pages (page_id, url, html) with content_hash, the hex SHA-256 of their HTML."""
    return spark.read.parquet(path).withColumn("content_hash", F.sha2(F.coalesce("html", F.lit("")), 256))


def page_text(pages: DataFrame, *keep: str) -> DataFrame:
    """pages (page_id, html) to (page_id, title, text) and the columns to keep: markup out, one line a
    block, no empty lines."""
    html = F.coalesce("html", F.lit(""))
    title = F.when(html.rlike(r"(?is)<title[^>]*>.*?</title>"), neutralize(clean(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))))
    return pages.select("page_id", title.alias("title"), neutralize(plain_text(html)).alias("text"), *keep)


def identifiers(texts: DataFrame) -> DataFrame:
    """texts with the first GSTIN, CIN, EPFO code and PAN in text, NOT_FOUND where there is none."""
    return texts.select("*", *(F.coalesce(F.nullif(F.regexp_replace(F.regexp_extract("text", p, 1), " ", ""), F.lit("")), F.lit("NOT_FOUND")).alias(k) for k, p in IDENTIFIERS.items()))


def link_table(pages: DataFrame) -> DataFrame:
    """(page_id, pos, link): targets of a page's links, each once, in order."""
    links = F.array_distinct(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(LINK), F.lit(1)))
    return pages.select("page_id", F.posexplode(links).alias("pos", "link"))


def _holds(c: Column, words) -> Column:
    return reduce(lambda a, b: a | b, (c.contains(w) for w in words))


def _fits(c: Column, patterns) -> Column:
    return reduce(lambda a, b: a | b, (c.rlike(p) for p in patterns))


def challenge(html: Column) -> Column:
    """CAPTCHA, OTP or LOGIN_REQUIRED, the first that a page asks for; else null."""
    low = F.lower(html)
    captcha = _holds(F.lower(F.regexp_extract(html, TITLE, 1)), CAPTCHA_TITLES) | _holds(low, CAPTCHA)
    return F.when(captcha, "CAPTCHA").when(_fits(low, OTP), "OTP").when(_fits(low, [rf"\b{w}\b" for w in LOGIN]), "LOGIN_REQUIRED")


def fetch_failure(html: Column, text: Column) -> Column:
    """EMPTY_RESPONSE, BLOCKED_OR_ERROR or NO_RESULTS for a page that can't be used whatever was
    looked for; else null."""
    low, title = F.lower(html), F.lower(F.regexp_extract(html, TITLE, 1))
    return (
        F.when(F.trim(F.regexp_replace(F.coalesce(html, F.lit("")), r"\s+", " ")) == "", "EMPTY_RESPONSE")
        .when(challenge(html).isNotNull() | _holds(low, BLOCKED) | _holds(title, BLOCKED_TITLES), "BLOCKED_OR_ERROR")
        .when(_holds(low, NO_RESULTS), "NO_RESULTS")
        .when(F.coalesce(text, F.lit("")) == "", "EMPTY_RESPONSE")
    )


def page_challenge(pages: DataFrame) -> DataFrame:
    """(page_id, challenge, failure) of each page."""
    return pages.select("page_id", challenge(F.col("html")).alias("challenge"), fetch_failure(F.col("html"), plain_text(F.col("html"))).alias("failure"))


def _first_line(lines: Column, found) -> Column:
    """The first value that found gives for a line, NOT_FOUND if none does."""
    return F.coalesce(F.get(F.array_compact(F.transform(lines, found)), F.lit(0)), F.lit("NOT_FOUND"))


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def _word_of(low: Column, words, name=F.upper) -> Column:
    return F.coalesce(*(F.when(low.contains(w), name(F.lit(w))) for w in words))


def strict_status(text: Column) -> Column:
    """The status named, in whole words, by the first line that speaks of a status and names one."""
    named = lambda low: F.coalesce(*(F.when(_fits(low, [rf"\b{w}\b" for w in words]), s) for s, words in STATUSES))
    return _first_line(_lines(text), lambda x: F.when(F.lower(x).contains("status"), named(F.lower(x))))


def company_status(text: Column) -> Column:
    """A status word of the first line that speaks of a status and has one, else of the first line that has one."""
    spoken = _first_line(_lines(text), lambda x: F.when(F.lower(x).contains("status"), _word_of(F.lower(x), STATUS_WORDS)))
    return F.when(spoken != "NOT_FOUND", spoken).otherwise(_first_line(_lines(text), lambda x: _word_of(F.lower(x), STATUS_WORDS)))


def gst_status(text: Column) -> Column:
    """AVAILABLE if the first line on GST with a status word says active, or, where no line has one,
    any line on GST does; else UNAVAILABLE. As active is looked for first, inactive counts as it."""

    def said(x: Column) -> Column:
        low = F.lower(x)
        other = _holds(low, ("company status", "mca status", "director status"))
        ask = _holds(low, ("status", "active", "suspended", "cancelled", "inactive")) & low.contains("gst") & ~other
        return F.when(ask & low.contains("active"), "AVAILABLE").when(ask & _holds(low, STATUS_WORDS), "UNAVAILABLE")

    first = _first_line(_lines(text), said)
    loose = F.exists(_lines(text), lambda x: F.lower(x).contains("gst") & F.lower(x).contains("active"))
    return F.when(first != "NOT_FOUND", first).when(loose, "AVAILABLE").otherwise("UNAVAILABLE")


def epfo_status(text: Column) -> Column:
    """INACTIVE, AVAILABLE or UNAVAILABLE by the words of an EPFO record; empty and null texts are UNAVAILABLE."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.when(_holds(low, EPFO_GONE), "INACTIVE").when(_holds(low, EPFO_THERE), "AVAILABLE").otherwise("UNAVAILABLE")


def founding_date(text: Column) -> Column:
    """The year, else the date, in the first line on the founding that has either."""
    some = lambda x, p, g: F.nullif(F.regexp_extract(x, p, g), F.lit(""))
    return _first_line(_lines(text), lambda x: F.when(_holds(F.lower(x), FOUNDED), F.coalesce(some(x, YEAR, 1), some(x, DAY, 0))))


def page_facts(texts: DataFrame) -> DataFrame:
    """(page_id, strict_status, company_status, gst_status, founded) from (page_id, text)."""
    t = F.col("text")
    return texts.select("page_id", strict_status(t).alias("strict_status"), company_status(t).alias("company_status"), gst_status(t).alias("gst_status"), founding_date(t).alias("founded"))


def guard_leaks(d: DataFrame) -> DataFrame:
    """d (task_type, target, field_name, field_value) with NOT_FOUND for a value that only repeats the
    task's target, or is shaped like a GSTIN or CIN, in a field that may not hold it."""
    field, value = F.col("field_name"), F.col("field_value")
    own = reduce(lambda a, b: a | b, ((F.col("task_type") == t) & field.isin(*f) for t, f in OWN_TARGET.items()))
    echo = (F.lower(F.trim(value)) == F.lower(F.trim("target"))) & ~F.coalesce(own, F.lit(False))
    upper = F.upper(F.trim(value))
    shaped = lambda k: upper.rlike("^" + IDENTIFIERS[k].removeprefix(r"\b").removesuffix(r"\b") + "$") & ~field.isin(k, *ANY_SHAPE)
    return d.withColumn("field_value", F.when(echo | shaped("gstin") | shaped("cin"), "NOT_FOUND").otherwise(value))


def is_address_like(c: Column) -> Column:
    """Whether a line has an address's parts: a PIN with a part or region, a part and a region in 15
    characters or more, or a PIN and a comma in 20; headings, filings and activities are none. Null is false."""
    v = F.trim(F.coalesce(c, F.lit("")))
    low = F.lower(v)
    starts = lambda words: reduce(lambda a, b: a | b, (low.startswith(w) for w in words))
    none = low.isin(*NO_ADDRESS, *HEADINGS) | _holds(low, FILINGS) | starts([f"{h}{e}" for h in HEADINGS for e in (" -", ":")]) | starts(ACTIVITIES)
    pin, part, region = v.rlike(PIN), _fits(low, [rf"\b(?:{p})\b" for p in PARTS]), _holds(low, REGIONS)
    shaped = (pin & (part | region)) | (part & region & (F.length(v) >= 15)) | (pin & (F.length(v) >= 20) & v.contains(","))
    return (F.length(v) >= 8) & ~none & shaped
