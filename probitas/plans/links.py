"""Queries on links of result pages and on names in titles and texts, and their SQL for DuckDB.

Result pages are the given pages with links and a title about one part each, by the same expressions in both engines."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from probitas.functions import text as X
from probitas.operators import links as K
from probitas.operators import names as N
from probitas.operators import pages as P
from probitas.operators import results as R
from probitas.sources.views import ctes, view

RESULTS = """SELECT page_id, url, page_id AS task_id, p_name || ' Private Limited' AS target,
  CASE page_id % 4 WHEN 0 THEN 'WEBSITE_VERIFICATION' WHEN 1 THEN 'THIRD_PARTY_RESEARCH' WHEN 2 THEN 'MCA_VERIFICATION' ELSE 'ENTITY_DISCOVERY' END AS task_type,
  CASE page_id % 6 WHEN 0 THEN p_name || ' Pvt Ltd - Company Details | Tofler' WHEN 1 THEN p_name || ' Limited HAVING CIN U12345MH2001PTC123456' WHEN 2 THEN 'Welcome to ' || p_name WHEN 3 THEN p_name || ' Limited in Pune' WHEN 4 THEN '' ELSE split_part(p_name, ' ', 1) || ' LLP &amp; Co | Where quality matters' END AS title,
  CASE page_id % 3 WHEN 0 THEN 'Trade name: ' || p_name || ' Limited' WHEN 1 THEN 'About Acme ' || p_name || ' Pvt. Ltd. and Other Works Limited\nmore of it' ELSE 'nothing here' END AS text,
  '<a href="/company/' || replace(p_name, ' ', '-') || '"><a href="/company/' || split_part(p_name, ' ', 1) || '"><a HREF="/gstin/27ABCDE1234F1Z5"><a href=''https://duckduckgo.com/l/?uddg=https%3A%2F%2Fwww.' || replace(p_name, ' ', '') || '.com%2Fa%20b+c&x=1''><a href="//zaubacorp.com/' || split_part(p_name, ' ', 2)
    || '"><a href="/url?q=http://hotel-' || split_part(p_name, ' ', 1) || '.org/"><a href="https://indiamart.com/' || p_name || '"><a href="https://tofler.in/x/' || split_part(p_name, ' ', 1) || '">' || html AS html
  FROM {pages} JOIN {part} ON p_partkey = page_id + 1"""


def _results(spark: SparkSession, sf: str) -> DataFrame:
    return spark.sql(RESULTS, pages=spark.read.parquet(f"{sf}/pages.parquet"), part=spark.read.parquet(f"{sf}/part.parquet"))


def _scored(s: SparkSession, d: str) -> DataFrame:
    r = _results(s, d)
    links = K.search_links(r).withColumnRenamed("link", "url").join(r.select("page_id", "target", "task_type"), "page_id")
    return K.score_links(links).select("page_id", "pos", "url", "score", "relationship", "reason", "overlap")


def _found(s: SparkSession, d: str) -> DataFrame:
    return K.discover_links(_results(s, d), _results(s, d))


def _followed(s: SparkSession, d: str) -> DataFrame:
    """Every task follows a link that leads to the page before its own."""
    r = _results(s, d)
    best = r.select((F.col("page_id") + 1).alias("page_id"), F.col("url").alias("link")).withColumn("task_id", F.col("page_id"))
    pages = s.read.parquet(f"{d}/pages.parquet")
    return K.follow_links(pages, r.select("page_id", "task_id"), best)


def _matched(s: SparkSession, d: str) -> DataFrame:
    c = view(s, d, "candidates").select(F.col("candidate_id").alias("target_id"), F.when(F.col("candidate_id") % 5 > 0, F.col("name")).alias("title"))
    t = view(s, d, "targets").select("target_id", F.when(F.col("target_id") % 2 == 0, F.col("name")).otherwise(F.concat(F.substring_index("name", " ", 3), F.lit(" works"))).alias("target"))
    return N.candidate_from_directory(t.join(c, "target_id", "left"))


#: Tasks of three pages each; every seventh has two pages of another company.
TASKS = """SELECT DISTINCT page_id // 3 AS task_id, CASE (page_id // 3) % 3 WHEN 0 THEN 'WEBSITE_VERIFICATION' WHEN 1 THEN 'MCA_VERIFICATION' ELSE 'EPFO_VERIFICATION' END AS task_type, (page_id // 3) % 7 = 0 AS entity_conflict FROM {pages}"""
FETCHES = """SELECT page_id // 3 AS task_id, CAST(page_id % 2 AS INT) AS source_order, CAST(page_id % 3 AS INT) AS url_order, page_id, CASE WHEN page_id % 5 = 0 THEN 'https://www.mca.gov.in/' || page_id ELSE url END AS url,
  CASE WHEN page_id % 4 > 0 THEN 'Source ' || page_id % 4 END AS source_name, CAST(1 + page_id % 4 AS INT) AS tier, CAST(5 + page_id % 5 AS DOUBLE) / CAST(10 AS DOUBLE) AS confidence FROM {pages}"""
FIELDS = ("gstin", "company_status", "candidate_entities", "cin")


def _page_results(s: SparkSession, d: str) -> DataFrame:
    pages = s.read.parquet(f"{d}/pages.parquet")
    as_sql = lambda q: q.replace("//", "DIV").replace("https:DIV", "https://")
    usable = P.page_challenge(pages).select("page_id", F.col("failure").isNull().alias("usable"))
    tasks = s.sql(as_sql(TASKS), pages=pages).withColumn("required_fields", F.array(*map(F.lit, FIELDS)))
    chosen = R.choose_page(tasks, s.sql(as_sql(FETCHES), pages=pages).join(usable, "page_id"))
    text = P.identifiers(P.page_text(pages)).select("page_id", "gstin", "cin", P.company_status(F.col("text")).alias("company_status"), F.substring("title", 1, 20).alias("candidate_entities"))
    values = text.unpivot("page_id", list(FIELDS), "field_name", "field_value").filter("field_value is not null")
    return R.page_results(chosen, values)


def _dispatched(s: SparkSession, d: str) -> DataFrame:
    """All tasks go to one extractor; of those of websites a later one takes care."""
    by = lambda n: lambda t: t.select("page_id", F.lit(n).alias("extractor"))
    known = [(lambda t: F.lit(True), by("general")), (lambda t: t.isin("WEBSITE_VERIFICATION", "ENTITY_DISCOVERY"), by("website")), (lambda t: t == "ENTITY_DISCOVERY", by("discovery"))]
    return R.dispatch(_results(s, d).select("page_id", "task_type"), known)


QUERIES = {
    "x4_x5_page_results": _page_results,
    "e1_dispatch": _dispatched,
    "x17_search_links": lambda s, d: K.search_links(_results(s, d)),
    "x19_score_links": _scored,
    "j24_discover_links": _found,
    "w6_best_links": lambda s, d: K.best_links(_found(s, d)),
    "j24_follow_links": _followed,
    "x12_legal_names": lambda s, d: N.page_names(_results(s, d)).select("page_id", "legal_name"),
    "x12_clean_titles": lambda s, d: _results(s, d).select("page_id", N.legal_name(F.col("title")).alias("name")),
    "x13_candidates": lambda s, d: N.candidates_in_text(_results(s, d), "page_id"),
    "x14_directory_candidates": _matched,
    "x7_epfo_status": lambda s, d: _results(s, d).select("page_id", P.epfo_status(F.concat_ws(" ", "text", F.col("html"))).alias("epfo_status")),
}


# The same in SQL.


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _list(words) -> str:
    return "[" + ", ".join(map(_q, words)) + "]"


def _any(c: str, words, how: str = "contains") -> str:
    return f"(len(list_filter({_list(words)}, lambda w: {how}({c}, w))) > 0)"


def _site(u: str) -> str:
    return f"replace(lower(regexp_extract({u}, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)), 'www.', '')"


def _clean(c: str) -> str:
    v = reduce(lambda a, e: f"replace({a}, {_q(e[0])}, {_q(e[1])})", X.ENTITIES, f"coalesce({c}, '')")
    v = f"trim(regexp_replace(regexp_replace({v}, '<[^>]+>', ' ', 'g'), {_q(P.SPACES)}, ' ', 'g'))"
    return reduce(lambda a, p: f"trim(regexp_replace({a}, {_q(p)}, ''))", N.CUTS, v)


def _proper(v: str) -> str:
    """A cleaned name or null."""
    low = f"lower({v})"
    return f"CASE WHEN length({v}) >= 3 AND NOT list_contains({_list(N.NOT_NAMES)}, {low}) AND NOT {_any(low, N.NOT_AT_START, 'starts_with')} AND NOT {_any(low, N.NOT_WITHIN)} AND {X.sql_is_legal_name(v)} THEN {v} END"


def _scores(source: str) -> str:
    """CTEs up to scored, for rows of source (url, target, task_type, ...)."""
    p = "regexp_replace(regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1), ';[^/]*$', '')"
    named = " OR ".join(f"(regexp_extract(low, {_q(i)}, 1) <> '' AND contains(lower(url), regexp_extract(low, {_q(i)}, 1)))" for i in K.TARGET_IDS)
    sector = f"len(list_filter({_list(K.SECTORS)}, lambda w: (contains(site, w) OR contains(path, '/' || w)) AND NOT contains(low, w))) > 0"
    of = lambda i: "CASE reason " + " ".join(f"WHEN '{k}' THEN {repr(v[i])}" for k, v in K.OUTCOMES.items()) + " END"
    return f"""s1 AS (SELECT *, lower(trim(coalesce(target, ''))) AS low, {_site('url')} AS site, lower({p}) AS path FROM {source}),
  s2 AS (SELECT *, list_filter(regexp_split_to_array(low, '[^\\p{{L}}\\p{{N}}_]+'), lambda w: regexp_full_match(w, '[a-z0-9]+')) AS words, regexp_replace(split_part(site, '.', 1), '[^a-z0-9]', '', 'g') AS label, regexp_replace(path, '[^a-z0-9]', '', 'g') AS flat FROM s1),
  s3 AS (SELECT *, list_filter(words, lambda w: length(w) > 2 AND NOT list_contains({_list(K.STOP_WORDS)}, w)) AS tokens, list_filter(words, lambda w: NOT list_contains({_list(K.NO_INITIAL)}, w)) AS heads FROM s2),
  s4 AS (SELECT *, len(tokens) AS n, len(list_filter(tokens, lambda w: contains(label, w) OR contains(flat, w))) AS m, CASE WHEN len(heads) >= 2 THEN array_to_string(list_transform(heads, lambda w: w[1]), '') END AS acr FROM s3),
  s5 AS (SELECT *, greatest(CASE WHEN n = 0 THEN 0.0 ELSE CAST(m AS DOUBLE) / n END, CASE WHEN acr = label OR contains(path, '/' || acr) OR contains(site, '-' || acr) THEN CAST({K.ACRONYM_OVERLAP} AS DOUBLE) ELSE 0.0 END) AS overlap FROM s4),
  s6 AS (SELECT *, CASE WHEN NOT regexp_matches(url, '^https?://') THEN 'INVALID_URL' WHEN {_any('site', K.ENGINES)} THEN 'SEARCH_OR_SOCIAL_SITE' WHEN {sector} THEN 'OTHER_SECTOR' WHEN {named} THEN 'IDENTIFIER_IN_URL' WHEN n = 0 THEN 'NO_DISTINCTIVE_WORD'
    WHEN task_type = 'WEBSITE_VERIFICATION' THEN CASE WHEN {_any('site', K.AGGREGATORS)} THEN 'DIRECTORY_NO_WEBSITE' WHEN overlap >= 0.6 THEN 'WEBSITE_STRONG' WHEN overlap > 0 AND n > 1 AND m = 1 THEN 'WEBSITE_ONE_WORD' WHEN overlap > 0 THEN 'WEBSITE_PARTIAL' ELSE 'NO_OVERLAP' END
    WHEN task_type = 'THIRD_PARTY_RESEARCH' THEN CASE WHEN overlap = 0 THEN 'NO_OVERLAP' ELSE CASE WHEN {_any('site', K.DIRECTORIES)} THEN 'DIRECTORY' ELSE 'THIRD_PARTY' END || CASE WHEN overlap >= 0.5 THEN '_STRONG' ELSE '_PARTIAL' END END
    WHEN overlap >= 0.6 THEN 'STRONG' WHEN overlap >= 0.3 THEN 'MODERATE' ELSE 'NO_OVERLAP' END AS reason FROM s5),
  scored AS (SELECT *, CAST({of(0)} AS DOUBLE) AS score, {of(1)} AS relationship FROM s6)"""


def oracles(challenge: str, texts: str, facts: str, ids: str) -> dict[str, str]:
    base = "WITH r AS (" + RESULTS.format(pages="pages", part="part").replace("\\n", "' || chr(10) || '") + ")"
    to = f"regexp_extract(h, {_q(K.REDIRECT)}, 1)"
    raw = f"l0 AS (SELECT page_id, regexp_extract_all(html, {_q(K.RESULT_LINK)}, 1) AS hs FROM r), l1 AS (SELECT page_id, unnest(range(1, len(hs) + 1)) AS i, unnest(hs) AS h FROM l0)"
    led = f"""{raw}, l2 AS (SELECT page_id, i, CASE WHEN contains(h, 'uddg=') OR contains(h, 'url?q=') THEN CASE WHEN regexp_matches(url_decode({to}), '^https?://') THEN url_decode({to}) END WHEN starts_with(h, '//') THEN 'https:' || h WHEN regexp_matches(h, '^https?://') THEN h END AS link FROM l1),
  l3 AS (SELECT page_id, link, min(i) AS i FROM l2 WHERE link IS NOT NULL GROUP BY 1, 2), links AS (SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY i) - 1 AS INT) AS pos, link FROM l3)"""
    own = f"""d0 AS (SELECT page_id, url AS page_url, {_site('url')} AS host, task_id, target, task_type, regexp_extract_all(html, {_q(K.RECORD_LINK)}, 1) AS hs FROM r),
  d1 AS (SELECT * EXCLUDE (hs), unnest(range(1, len(hs) + 1)) AS i, unnest(hs) AS h FROM d0), d2 AS (SELECT *, CASE WHEN starts_with(h, 'http') THEN h ELSE 'https://www.' || host || '/' || ltrim(h, '/') END AS url FROM d1 WHERE {_any('lower(h)', K.RECORD_PATHS)}),
  d3 AS (SELECT page_id, task_id, target, task_type, url, min(i) AS i FROM d2 WHERE contains(lower(url), host) AND url <> page_url GROUP BY ALL), d4 AS (SELECT *, CAST(row_number() OVER (PARTITION BY page_id ORDER BY i) - 1 AS INT) AS pos FROM d3), {_scores('d4')},
  found AS (SELECT page_id, task_id, pos, url AS link, score, relationship FROM scored WHERE score >= {K.LEAST_SCORE} OR list_contains({_list(K.KEPT)}, relationship))"""
    said = f"list_filter(list_transform(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(regexp_extract(x, {_q(N.NAME_LABEL)}, 1))), lambda x: length(x) > 3), lambda x: {_clean('x')}), lambda v: ({_proper('v')}) IS NOT NULL)[1]"
    cleaned = f"c AS (SELECT *, {_clean('title')} AS ct, {_clean('target')} AS cg FROM r)"
    spans = f"list_filter(list_transform(flatten(list_transform(string_split(text, chr(10)), lambda x: regexp_extract_all(x, {_q(N.LEGAL_SPAN)}, 1))), lambda x: {_clean('x')}), lambda v: ({_proper('v')}) IS NOT NULL)"
    by_name = f"list_contains({_list(N.BY_NAME)}, task_type)"
    tokens, sector = (lambda c: X.sql_name_tokens(f"trim(upper({c}))")), (lambda c: X.sql_sector_mask(c))
    f1 = "2 * ((k / CAST(na AS DOUBLE)) * (k / CAST(nb AS DOUBLE))) / ((k / CAST(na AS DOUBLE)) + (k / CAST(nb AS DOUBLE)))"
    raw_pages = {k: v.format(pages="pages") for k, v in (("t", TASKS), ("f", FETCHES))}
    return {
        "x4_x5_page_results": f"""WITH t AS ({raw_pages['t']}), f AS ({raw_pages['f']}), bad AS ({challenge}), ti AS ({texts} SELECT page_id, title FROM texts), fa AS ({facts}), id AS ({ids}),
  c AS (SELECT t.*, g.* EXCLUDE (task_id) FROM t LEFT JOIN (SELECT f.* FROM f JOIN bad ON bad.page_id = f.page_id WHERE failure IS NULL QUALIFY row_number() OVER (PARTITION BY task_id ORDER BY source_order, url_order, f.page_id) = 1) g ON g.task_id = t.task_id),
  e AS (SELECT c.*, unnest([1, 2, 3, 4]) AS k, unnest({_list(FIELDS)}) AS field_name FROM c),
  v AS (SELECT e.*, coalesce(CASE field_name WHEN 'gstin' THEN id.gstin WHEN 'cin' THEN id.cin WHEN 'company_status' THEN fa.company_status ELSE substr(ti.title, 1, 20) END, 'NOT_FOUND') AS field_value FROM e LEFT JOIN id ON id.page_id = e.page_id LEFT JOIN fa ON fa.page_id = e.page_id LEFT JOIN ti ON ti.page_id = e.page_id),
  o AS (SELECT *, entity_conflict AND field_name <> 'candidate_entities' AS other FROM v)
SELECT printf('RESULT-%d-%03d', task_id, k) AS result_id, task_id, page_id, field_name, field_value, coalesce(source_name, 'Public Source') AS source_name, url AS source_url, CASE WHEN other OR field_value IN ('NOT_FOUND', 'UNAVAILABLE', 'SOURCE_UNAVAILABLE') THEN 0.0 ELSE coalesce(confidence, 0.0) END AS confidence,
  CASE WHEN other THEN 'REJECTED' WHEN page_id IS NULL THEN 'SOURCE_UNAVAILABLE' WHEN field_value IN ('NOT_FOUND', 'UNAVAILABLE') THEN 'NOT_FOUND' WHEN contains(url, 'gov.in') OR confidence >= 0.7 THEN 'VERIFIED' ELSE 'UNVERIFIED' END AS verification_status,
  CASE WHEN other THEN 5 WHEN page_id IS NULL THEN 4 WHEN field_value NOT IN ('NOT_FOUND', 'UNAVAILABLE') AND contains(url, 'gov.in') THEN 1 ELSE tier END AS tier FROM o""",
        "e1_dispatch": f"{base} SELECT page_id, CASE task_type WHEN 'ENTITY_DISCOVERY' THEN 'discovery' WHEN 'WEBSITE_VERIFICATION' THEN 'website' ELSE 'general' END AS extractor FROM r",
        "x17_search_links": f"{base}, {led} SELECT * FROM links",
        "x19_score_links": f"{base}, {led}, u AS (SELECT l.page_id, pos, link AS url, target, task_type FROM links l JOIN r ON r.page_id = l.page_id), {_scores('u')} SELECT page_id, pos, url, score, relationship, reason, overlap FROM scored",
        "j24_discover_links": f"{base}, {own} SELECT * FROM found",
        "w6_best_links": f"{base}, {own} SELECT page_id, task_id, link, score FROM found QUALIFY row_number() OVER (PARTITION BY page_id, task_id ORDER BY score DESC, pos) = 1",
        "j24_follow_links": f"{base}, x AS ({challenge}), ok AS (SELECT url, min(p.page_id) AS led FROM pages p JOIN x ON x.page_id = p.page_id WHERE failure IS NULL GROUP BY 1), b AS (SELECT page_id + 1 AS page_id, led FROM r JOIN ok ON ok.url = r.url) SELECT r.page_id, r.task_id, coalesce(led, r.page_id) AS used_page_id FROM r LEFT JOIN b ON b.page_id = r.page_id",
        "x12_clean_titles": f"{base}, {cleaned} SELECT page_id, {_proper('ct')} AS name FROM c",
        "x12_legal_names": f"{base}, {cleaned} SELECT page_id, coalesce({said}, {_proper('ct')}, CASE WHEN {by_name} THEN {_proper('cg')} END, 'NOT_FOUND') AS legal_name FROM c",
        "x13_candidates": f"""{base}, {cleaned}, s AS (SELECT *, {spans} AS f, coalesce({_proper('ct')}, target) AS other FROM c), e AS (SELECT page_id, text, CASE WHEN len(f) > 0 THEN f WHEN lower(other) = lower(target) AND NOT {by_name} THEN [] ELSE [other] END AS f FROM s),
  g AS (SELECT page_id, text, unnest(f) AS name, unnest(range(1, len(f) + 1)) AS i FROM e), k AS (SELECT page_id, text, name, min(i) AS i FROM g GROUP BY ALL)
SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY i) - 1 AS INT) AS pos, name, {_q(N.OPEN.strip())} || chr(10) || substr(regexp_replace(text, '\\s+', ' ', 'g'), 1, {N.EXCERPT}) || chr(10) || {_q(N.CLOSE.strip())} AS source_text, CAST(1.0 AS DOUBLE) AS confidence FROM k""",
        "x14_directory_candidates": f"""{ctes('targets', 'candidates')}, p AS (SELECT t.target_id, CASE WHEN t.target_id % 2 = 0 THEN t.name ELSE array_to_string(string_split(t.name, ' ')[1:3], ' ') || ' works' END AS target, CASE WHEN candidate_id % 5 > 0 THEN c.name END AS title FROM targets t LEFT JOIN candidates c ON c.candidate_id = t.target_id),
  n AS (SELECT *, coalesce(title, target) AS name FROM p), w AS (SELECT *, {tokens('target')} AS a, {tokens('name')} AS b, {sector('target')} AS sa, {sector('name')} AS sb FROM n),
  z AS (SELECT *, len(list_distinct(a)) AS na, len(list_distinct(b)) AS nb, len(list_intersect(list_distinct(a), list_distinct(b))) AS k FROM w),
  y AS (SELECT *, CASE WHEN na = 0 OR nb = 0 THEN 0.0 WHEN a = b THEN 1.0 WHEN sa <> sb OR k = 0 THEN 0.0 WHEN len(a) > 1 AND k = 1 THEN round(least(0.30, {f1}), 4) ELSE round({f1}, 4) END AS sim FROM z)
SELECT target_id, target, title, name, CASE WHEN sim >= {N.DIRECTORY_SIMILAR} THEN CAST({N.DIRECTORY_CONFIDENCE} AS DOUBLE) ELSE round(greatest(CAST({N.DIRECTORY_LEAST} AS DOUBLE), sim), 2) END AS confidence FROM y""",
        "x7_epfo_status": f"""{base}, t AS (SELECT page_id, lower(concat_ws(' ', text, html)) AS low FROM r) SELECT page_id, CASE WHEN low = '' THEN 'UNAVAILABLE' WHEN {_any('low', P.EPFO_GONE)} THEN 'INACTIVE' WHEN {_any('low', P.EPFO_THERE)} THEN 'AVAILABLE' ELSE 'UNAVAILABLE' END AS epfo_status FROM t""",
    }
