"""Normalisers of names, addresses, identifiers and websites, as columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words and patterns that results depend on.
LEGAL_WORDS = ("PVT", "LTD", "LIMITED", "PRIVATE", "LLP", "CORP", "CORPORATION", "INC", "INCORPORATED", "CO", "COMPANY", "AND", "THE", "OFFICIAL", "WEBSITE", "REGISTRATION", "ESTABLISHMENT", "SEARCH", "PORTAL")
SECTOR_WORDS = ("pharma", "pharmaceutical", "hotel", "resorts", "resort", "hospital", "motors", "motor", "school", "academy", "coaching", "huel", "adult", "spa", "casino", "cinema", "theatre", "restaurant", "cafe", "bar")
NAME_SUFFIXES = ("pvtltd", "privatelimited", "llp", "ltd", "limited", "co", "company")
STREET_WORDS = ("street", "road", "st", "rd", "plot", "sector", "phase", "building", "floor", "nagar", "puram", "lane", "hno", "flat", "office", "address", "addr", "block", "place", "colony", "landmark", "near", "behind", "opposite", "bazar", "market", "extension", "ext", "chowk", "square", "avenue", "drive", "highway")
ADDRESS_FORMS = (
    ("flr|floor|fl", "floor"), ("bldg|building", "building"), ("rd|road", "road"), ("st|street", "street"), ("apt|apartment", "apartment"), ("off|office", "office"), ("pt|point", "point"), ("pl|plot", "plot"),
    ("no|num|number", "no"), ("opp|opposite", "opp"), ("nr|near", "near"), ("dist|district", "dist"), ("sec|sector", "sector"), ("ph|phase", "phase"), (r"hno|house\s+no", "hno"), ("india", ""), ("ind", ""),
)

# What places are introduced by and followed by, and their marks in HTML.
PLACE_HEAD = r"^(?:in\s+|located\s+in\s+|at\s+|from\s+|near\s+|city\s+of\s+|state\s+of\s+)"
PLACE_TAIL = r"\s*[-|–—:]?\s*(?:official\s+website|website|company\s+registration|mca\s+details|search\s+results|cin|gstin)\b.*$"
PLACE_END = r"[.\-–—:|/,\s]+$"
ENTITIES = (("&nbsp;", "\u00a0"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&amp;", "&"))
# What is no legal name.
NAME_TELLS = (
    r"\s+\bin\s+.*$", r"\b[ul][0-9]{5}[a-z]{2}[0-9]{4}[a-z]{3}[0-9]{6}\b", r"\b[0-9]{2}[a-z]{5}[0-9]{4}[a-z][0-9a-z]z[0-9a-z]\b", r"\bhaving\s+(?:cin|gstin|llpin|pan|din|tan)\b", r"\bis\s+\d+\s+(?:year|yr|month|mo|week|wk|day)s?\b",
    r"\b(?:date|year)\s+of\s+(?:incorporation|registration|establishment)\b", r"\b(?:incorporated|registered)\s+(?:on|in|as|since|under|with)\s+\S",
)
NO_NAME = (
    "not_found", "unavailable", "unknown", "error", "blocked", "irrelevant", "source_unavailable", "captcha_required", "not applicable", "n/a", "na", "none", "null", "something went wrong", "access denied", "page not found", "search results", "results for", "duckduckgo", "google search", "bing search",
    "nature of business activities", "nature of business", "business activity", "registered office", "registered address", "contact us", "about us", "terms of use", "privacy policy", "all rights reserved",
)
PORTAL_HEADS = ("welcome", "home", "login", "index", "search", "companies matching", "404", "503", "502", "500", "403")
REGION_NAMES = ("maharashtra", "karnataka", "delhi", "new delhi", "tamil nadu", "telangana", "gujarat", "west bengal", "haryana", "uttar pradesh", "mumbai", "bengaluru", "bangalore", "chennai", "hyderabad", "kolkata", "pune", "gurgaon", "gurugram", "noida", "india", "bharat")
# What is no business activity.
FUNCTION_WORDS = ("of", "and", "the", "in", "for", "with", "to", "or", "on", "at", "by", "from", "a", "an", "as", "including", "related")
MARKUP_TELLS = r"https?://|www\.\w|\S+@\S+\.\S+|<[a-z/][^>]*>|&[a-z]{2,6};"
GLOSS = (
    r"(?i)[\[(]\s*(?:(?:this|also)\s+)?(?:(?:sub[-\s]?class|class|group|division|section|category|heading|code)\s+)?(?:includes?|excludes?|including|excluding|incl\.?|excl\.?|covers?|comprises?|comprising"
    r"|for\s+example|e\.?\s?g\.?|such\s+as|namely|i\.?\s?e\.?|n\.?\s?e\.?\s?c\.?|not\s+elsewhere\s+classified)\b"
)
ID_SHAPES = r"\b[0-9]{2}[A-Z]{5}[0-9]{4}[A-Z][0-9A-Z]Z[0-9A-Z]\b|\b[UL][0-9]{5}[A-Z]{2}[0-9]{4}[A-Z]{3}[0-9]{6}\b"
ACTIVITY_WORD = r"[A-Za-z][A-Za-z&/.\-']*"
BARE_LABEL = (
    r"^(?:the\s+)?(?:nature|type|kind|principal|primary|main|category|class|code|description|details?|industry|sector|line)\s+(?:of\s+)?"
    r"(?:business(?:\s+activit(?:y|ies))?|activit(?:y|ies)|industry|operations?|work)\s*[:\-–—]?$"
)
MENU_SIGN = r"\s[|/•·»›▸≫>]\s|\s[–-]\s\S"


def title_case(c: Column) -> Column:
    """The first letter of each run of letters in upper case, the others in lower case."""
    runs = F.regexp_extract_all(c, F.lit(r"\p{L}+|[^\p{L}]+"), F.lit(0))
    return F.array_join(F.transform(runs, lambda x: F.concat(F.upper(F.substring(x, 1, 1)), F.lower(F.substring(x, 2, 1 << 30)))), "")


def norm_location(c: Column) -> Column:
    """Places without introduction, markup and site words, each once, in title case; null if none."""
    v = reduce(lambda a, e: F.replace(a, F.lit(e[0]), F.lit(e[1])), ENTITIES, F.trim(c))
    v = F.trim(F.regexp_replace(F.trim(F.regexp_replace(v, "<[^>]+>", " ")), f"(?i){PLACE_HEAD}", ""))
    v = F.trim(F.regexp_replace(v, f"(?i){PLACE_TAIL}", ""))
    v = F.regexp_replace(F.trim(F.element_at(F.split(v, "[?&#]"), 1)), PLACE_END, "")
    parts = F.transform(F.split(v, "[,/|;]+"), lambda p: F.trim(F.regexp_replace(title_case(F.trim(p)), PLACE_END, "")))
    return F.nullif(F.array_join(F.array_distinct(F.filter(parts, lambda p: F.length(p) >= 2)), ", "), F.lit(""))


def is_legal_name(c: Column) -> Column:
    """Whether a value has the shape of a company's name: no metadata, header, portal title or region."""
    v = F.trim(F.coalesce(c, F.lit("")))
    low = F.lower(v)
    tells = reduce(lambda a, b: a | b, (low.rlike(p) for p in NAME_TELLS))
    heads = reduce(lambda a, b: a | b, (low.startswith(p) for p in PORTAL_HEADS))
    return (v != "") & (F.length(v) <= 150) & ~tells & ~low.isin(*NO_NAME) & ~heads & ~low.isin(*REGION_NAMES) & ~F.trim(F.replace(low, F.lit(","), F.lit(" "))).isin(*REGION_NAMES)


def is_activity(c: Column) -> Column:
    """Whether a value has the shape of a line of business: one line of words that is no markup, snippet,
    class gloss, identifier, label or menu."""
    v = F.trim(F.coalesce(c, F.lit("")))
    low = F.lower(v)
    words = F.regexp_extract_all(v, F.lit(ACTIVITY_WORD), F.lit(0))
    letters = F.length(F.regexp_replace(v, "[^A-Za-z]", ""))
    snippet = v.contains("…") | v.endswith("...") | v.contains(" ... ") | v.contains("?")
    menu = (F.size(words) >= 5) & F.forall(words, lambda w: w.rlike("^[A-Z]")) & ~F.exists(words, lambda w: F.lower(w).isin(*FUNCTION_WORDS))
    return (
        F.length(v).between(3, 250) & ~v.rlike("[\\n\\r\\t]") & ~low.rlike(MARKUP_TELLS) & ~snippet & ~v.rlike(GLOSS) & (2 * letters >= F.length(v)) & ~F.upper(v).rlike(ID_SHAPES)
        & F.size(words).between(1, 40) & ~low.rlike(BARE_LABEL) & (F.regexp_count(v, F.lit(MENU_SIGN)) < 3) & ~menu
    )


def squeeze(c: Column) -> Column:
    """White space, also of other scripts, to single spaces; none at the ends."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def norm_text(c: Column) -> Column:
    return F.nullif(F.upper(squeeze(c)), F.lit(""))


def norm_identifier(c: Column) -> Column:
    return F.nullif(F.upper(F.regexp_replace(c, r"(?U)\s+", "")), F.lit(""))


def norm_website(c: Column) -> Column:
    """Host in lower case without www., null unless it is a plain host with a dot."""
    v = F.lower(F.trim(c))
    v = F.when(F.instr(v, "://") > 0, v).otherwise(F.concat(F.lit("https://"), v))
    host = F.regexp_replace(F.regexp_extract(v, r"^https?://(?:[^/?#@]*@)?([^/?#:]*)", 1), r"^www\.", "")
    return F.when(host.rlike(r"^[a-z0-9-][a-z0-9.-]*\.[a-z0-9.-]*[a-z0-9-]$"), host)


def name_tokens(c: Column) -> Column:
    words = F.regexp_extract_all(F.upper(F.coalesce(c, F.lit(""))), F.lit(r"\b[A-Z0-9]+\b"), F.lit(0))
    return F.filter(words, lambda w: ~w.isin(*LEGAL_WORDS) & (F.length(w) > 1))


def sector_mask(c: Column) -> Column:
    """A bit for each sector word that the text holds; two names fit if their masks are equal."""
    low = F.lower(F.coalesce(c, F.lit("")))
    return reduce(lambda a, b: a + b, (F.when(low.contains(w), 1 << i).otherwise(0) for i, w in enumerate(SECTOR_WORDS)))


def rule_name(c: Column) -> Column:
    bare = F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]", "")
    return reduce(lambda v, s: F.regexp_replace(v, f"{s}$", ""), NAME_SUFFIXES, bare)


def norm_address(c: Column) -> Column:
    low = F.lower(F.coalesce(c, F.lit("")))
    return F.regexp_replace(reduce(lambda v, f: F.regexp_replace(v, rf"\b({f[0]})\b", f[1]), ADDRESS_FORMS, low), "[^a-z0-9]", "")


def is_full_address(c: Column) -> Column:
    low = F.lower(F.coalesce(c, F.lit("")))
    words = F.regexp_extract_all(low, F.lit(r"(?U)\b\w+\b"), F.lit(0))
    street = F.arrays_overlap(words, F.array(*map(F.lit, STREET_WORDS)))
    return (low != "not_found") & (F.size(words) >= 2) & (street | (F.size(words) >= 5))


def norm_activity(c: Column) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]", "")


# the same in DuckDB's SQL


def sql_rule_name(c: str) -> str:
    return reduce(lambda v, s: f"regexp_replace({v}, '{s}$', '')", NAME_SUFFIXES, f"regexp_replace(lower(coalesce({c}, '')), '[^a-z0-9]', '', 'g')")


def sql_norm_address(c: str) -> str:
    return f"regexp_replace({reduce(lambda v, f: f"regexp_replace({v}, '\\b({f[0]})\\b', '{f[1]}', 'g')", ADDRESS_FORMS, f"lower(coalesce({c}, ''))")}, '[^a-z0-9]', '', 'g')"


def sql_is_full_address(c: str) -> str:
    words = f"regexp_extract_all(lower(coalesce({c}, '')), '\\b\\w+\\b')"
    street = ", ".join(f"'{w}'" for w in STREET_WORDS)
    return f"(lower({c}) <> 'not_found' AND len({words}) >= 2 AND (list_has_any({words}, [{street}]) OR len({words}) >= 5))"


def sql_norm_text(c: str) -> str:
    return f"nullif(upper(trim(regexp_replace({c}, '\\s+', ' ', 'g'))), '')"


def sql_norm_website(c: str) -> str:
    v = f"CASE WHEN contains(lower(trim({c})), '://') THEN lower(trim({c})) ELSE 'https://' || lower(trim({c})) END"
    host = f"regexp_replace(regexp_extract({v}, '^https?://(?:[^/?#@]*@)?([^/?#:]*)', 1), '^www\\.', '')"
    return f"CASE WHEN regexp_matches({host}, '^[a-z0-9-][a-z0-9.-]*\\.[a-z0-9.-]*[a-z0-9-]$') THEN {host} END"


def sql_name_tokens(c: str) -> str:
    legal = ", ".join(f"'{w}'" for w in LEGAL_WORDS)
    return f"list_filter(regexp_extract_all(upper(coalesce({c}, '')), '\\b[A-Z0-9]+\\b'), lambda w: w NOT IN ({legal}) AND length(w) > 1)"


def sql_sector_mask(c: str) -> str:
    return "(" + " + ".join(f"CASE WHEN contains(lower(coalesce({c}, '')), '{w}') THEN {1 << i} ELSE 0 END" for i, w in enumerate(SECTOR_WORDS)) + ")"


def _sql(pattern: str) -> str:
    return pattern.replace("'", "''")


def sql_title_case(c: str) -> str:
    return f"array_to_string(list_transform(regexp_extract_all({c}, '\\p{{L}}+|[^\\p{{L}}]+'), lambda x: upper(x[1]) || lower(x[2:])), '')"


def sql_norm_location(c: str) -> str:
    v = reduce(lambda a, e: f"replace({a}, '{_sql(e[0])}', '{_sql(e[1])}')", ENTITIES, f"trim({c})")
    v = f"trim(regexp_replace(trim(regexp_replace({v}, '<[^>]+>', ' ', 'g')), '(?i){PLACE_HEAD}', ''))"
    v = f"trim(regexp_replace({v}, '(?i){PLACE_TAIL}', ''))"
    v = f"regexp_replace(trim(regexp_split_to_array({v}, '[?&#]')[1]), '{PLACE_END}', '')"
    parts = f"list_transform(regexp_split_to_array({v}, '[,/|;]+'), lambda p: trim(regexp_replace({sql_title_case('trim(p)')}, '{PLACE_END}', '')))"
    return f"nullif(array_to_string(list_reduce(list_transform(list_filter({parts}, lambda p: length(p) >= 2), lambda p: [p]), lambda a, b: CASE WHEN list_contains(a, b[1]) THEN a ELSE list_concat(a, b) END, CAST([] AS VARCHAR[])), ', '), '')"


def sql_is_legal_name(c: str) -> str:
    v = f"trim(coalesce({c}, ''))"
    words = lambda w: ", ".join(f"'{x}'" for x in w)
    tells = " OR ".join(f"regexp_matches(lower({v}), '{_sql(p)}')" for p in NAME_TELLS)
    heads = " OR ".join(f"starts_with(lower({v}), '{p}')" for p in PORTAL_HEADS)
    return f"({v} <> '' AND length({v}) <= 150 AND NOT ({tells}) AND NOT ({heads}) AND lower({v}) NOT IN ({words((*NO_NAME, *REGION_NAMES))}) AND trim(replace(lower({v}), ',', ' ')) NOT IN ({words(REGION_NAMES)}))"


def sql_is_activity(c: str) -> str:
    v = f"trim(coalesce({c}, ''))"
    words = f"regexp_extract_all({v}, '{_sql(ACTIVITY_WORD)}')"
    near = ", ".join(f"'{w}'" for w in FUNCTION_WORDS)
    menu = f"(len({words}) >= 5 AND len(list_filter({words}, lambda w: NOT regexp_matches(w, '^[A-Z]'))) = 0 AND len(list_filter({words}, lambda w: lower(w) IN ({near}))) = 0)"
    return (
        f"(length({v}) BETWEEN 3 AND 250 AND NOT regexp_matches({v}, '[\\n\\r\\t]') AND NOT regexp_matches(lower({v}), '{_sql(MARKUP_TELLS)}') AND NOT (contains({v}, '…') OR suffix({v}, '...') OR contains({v}, ' ... ') OR contains({v}, '?'))"
        f" AND NOT regexp_matches({v}, '{_sql(GLOSS)}') AND 2 * length(regexp_replace({v}, '[^A-Za-z]', '', 'g')) >= length({v}) AND NOT regexp_matches(upper({v}), '{_sql(ID_SHAPES)}') AND len({words}) BETWEEN 1 AND 40"
        f" AND NOT regexp_matches(lower({v}), '{_sql(BARE_LABEL)}') AND len(regexp_extract_all({v}, '{_sql(MENU_SIGN)}')) < 3 AND NOT {menu})"
    )
