"""URL filter: path rules first, then a weighted vocabulary found by Aho-Corasick.

One automaton holds all terms, so a url is read once whatever the vocabulary's size. A hit
counts only between boundaries (no letter, mark or number of any script before or after it). A term counts once a
url; a strict term weighs as much as the limit, so one rejects, a soft term weighs 1, so several
distinct ones are needed.

Defined results: a null url, or one without ://, has an empty host and path and no rule; a null
or empty url has no hits and is allowed; repeated rows are judged alike; rules hold for
their host and its subdomains where the path starts with theirs, the longest rule wins; a term that
is both strict and soft is strict; an empty vocabulary hits nothing, an empty table gives an empty
result, urls of any length are read whole, and other columns, whatever their names, change nothing.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from probitas.cluster import ship_package
from probitas.llm.common import lower_az, table

STRICT = ("porn", "porno", "pornstar", "xxx", "xvideos", "hentai", "nsfw", "milf", "camgirl", "camgirls", "escort", "escorts", "adult", "viagra", "cialis", "casino", "casinos", "spam", "warez", "malware", "phishing")
SOFT = ("sex", "sexy", "nude", "nudes", "erotic", "dating", "hot", "girls", "free", "bet", "bets", "betting", "win", "winner", "bonus", "poker", "slots", "jackpot", "lottery", "pills", "pharmacy", "loan", "loans", "payday", "cheap", "discount", "deal", "crack", "keygen", "torrent", "farm", "clickbait", "followers")
LIMIT = 2
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))

_HOST = r"(?s)^.*?://([^/?#]*)"
_PATH = r"(?s)^.*?://[^/?#]*([^?#]*)"


@lru_cache(maxsize=8)
def _automaton(strict: tuple[str, ...], soft: tuple[str, ...]) -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for weight, terms in ((1, soft), (LIMIT, strict)):
        for t in filter(None, terms):
            a.add_word(t, (t, weight))
    if len(a):
        a.make_automaton()
    return a


def _edge(c: str) -> bool:
    """Whether c is neither letter, mark nor number, of any script."""
    return unicodedata.category(c)[0] not in "LMN"


def term_hits(url: str | None, strict: tuple[str, ...] = STRICT, soft: tuple[str, ...] = SOFT) -> tuple[int, int]:
    """Distinct strict and soft terms in a url that is lower-cased already."""
    found, terms = set(), _automaton(strict, soft)
    for end, (term, weight) in terms.iter(url or "") if len(terms) else ():
        start = end - len(term)
        if (start < 0 or _edge(url[start])) and (end + 1 == len(url) or _edge(url[end + 1])):
            found.add((term, weight))
    heavy = sum(w >= LIMIT for _, w in found)
    return heavy, len(found) - heavy


def host_of(url: Column) -> Column:
    return F.coalesce(lower_az(F.regexp_extract(url, _HOST, 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _PATH, 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """struct(rule, verdict) of the longest rule that fits, else null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for h, p, verdict in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def judge_urls(pages: DataFrame, rules=RULES, strict: tuple[str, ...] = STRICT, soft: tuple[str, ...] = SOFT) -> DataFrame:
    """pages (page_id, url) with host, path, rule, verdict, strict_hits, soft_hits."""
    ship_package(pages.sparkSession)

    @F.pandas_udf("strict int, soft int")
    def hits(s: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([term_hits(u, strict, soft) for u in s], columns=["strict", "soft"], dtype="int32")

    d = pages.select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), hits(lower_az(F.col("url"))).alias("hits"))
    d = d.withColumn("fit", rule_of(F.col("host"), F.col("path"), rules))
    bad = (F.col("hits.strict") * LIMIT + F.col("hits.soft")) >= LIMIT
    verdict = F.coalesce(F.col("fit.verdict"), F.when(bad, "block").otherwise("allow"))
    return d.select("page_id", "url", "host", "path", F.col("fit.rule").alias("rule"), verdict.alias("verdict"), F.col("hits.strict").alias("strict_hits"), F.col("hits.soft").alias("soft_hits"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages")).drop("url")


def oracle() -> str:
    def count(terms: tuple[str, ...]) -> str:
        return " + ".join(f"CAST(regexp_matches(u, '(^|[^\\p{{L}}\\p{{M}}\\p{{N}}]){t}($|[^\\p{{L}}\\p{{M}}\\p{{N}}])') AS INTEGER)" for t in terms)

    fits = [(h + p, v, f"((host = '{h}' OR suffix(host, '.{h}')) AND starts_with(path, '{p}'))") for h, p, v in sorted(RULES, key=lambda r: -len(r[0] + r[1]))]
    rule = "CASE " + " ".join(f"WHEN {c} THEN '{r}'" for r, _, c in fits) + " END"
    said = "CASE " + " ".join(f"WHEN {c} THEN '{v}'" for _, v, c in fits) + f" WHEN strict_hits * {LIMIT} + soft_hits >= {LIMIT} THEN 'block' ELSE 'allow' END"
    az = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
    return f"""
WITH p AS (SELECT page_id, translate(coalesce(url, ''), {az}) AS u,
                  coalesce(translate(regexp_extract(url, '^[\\s\\S]*?://([^/?#]*)', 1), {az}), '') AS host,
                  coalesce(regexp_extract(url, '^[\\s\\S]*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
     h AS (SELECT page_id, host, path, {count(STRICT)} AS strict_hits, {count(SOFT)} AS soft_hits FROM p)
SELECT page_id, host, path, {rule} AS rule, {said} AS verdict, CAST(strict_hits AS INTEGER) AS strict_hits, CAST(soft_hits AS INTEGER) AS soft_hits FROM h"""
