"""Queries on addresses, activities and page fields, and their SQL for DuckDB.

An investigation's evidence, a line a row, is the text in which its address and activity are sought.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from probitas.operators import extract as T
from probitas.operators import pages as P
from probitas.sources.views import ctes, view


def _dossiers(spark: SparkSession, sf: str) -> DataFrame:
    """(investigation_id, text, target, confirmed): the evidence's lines in order; the target is a
    company's name, and even ids are confirmed."""
    line = F.concat(F.replace("field_name", F.lit("_"), F.lit(" ")), F.lit(": "), F.col("field_value"))
    lines = F.array_sort(F.collect_list(F.struct("ev_seq", line.alias("line"))))
    d = view(spark, sf, "evidence").groupBy("investigation_id").agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("text"))
    return d.withColumns({"target": F.lit("Alpha Foods Private Limited"), "confirmed": F.col("investigation_id") % 2 == 0})


def _pages(spark: SparkSession, sf: str) -> DataFrame:
    html = spark.read.parquet(f"{sf}/pages.parquet")
    return html.select("page_id", "url", P.neutralize(P.plain_text(F.col("html"))).alias("text"))


QUERIES = {
    "x10_addresses": lambda s, d: T.find_addresses(_dossiers(s, d)).select("investigation_id", "address"),
    "x11_activities": lambda s, d: _dossiers(s, d).select("investigation_id", T.find_activity(F.col("text")).alias("activity")),
    "x15_page_fields": lambda s, d: T.page_fields(_pages(s, d)),
    "f14_address_lines": lambda s, d: view(s, d, "evidence").select("investigation_id", "ev_seq", P.is_address_like(F.col("field_value")).alias("address_like")),
}


# The same in SQL.


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _list(words) -> str:
    return "[" + ", ".join(map(_q, words)) + "]"


def _any(c: str, words) -> str:
    return f"len(list_filter({_list(words)}, lambda w: contains({c}, w))) > 0"


def _like(c: str) -> str:
    """is_address_like of a string that isn't null and has no outer spaces."""
    low = f"lower({c})"
    ruled = f"list_contains({_list((*P.NO_ADDRESS, *P.HEADINGS))}, {low}) OR {_any(low, P.FILINGS)} OR len(list_filter({_list([*(f'{h}{e}' for h in P.HEADINGS for e in (' -', ':')), *P.ACTIVITIES])}, lambda w: starts_with({low}, w))) > 0"
    pin, part, region = f"regexp_matches({c}, {_q(P.PIN)})", f"regexp_matches({low}, {_q(rf'\b(?:{"|".join(P.PARTS)})\b')})", _any(low, P.REGIONS)
    return f"(length({c}) >= 8 AND NOT ({ruled}) AND (({pin} AND ({part} OR {region})) OR ({part} AND {region} AND length({c}) >= 15) OR ({pin} AND length({c}) >= 20 AND contains({c}, ','))))"


def _activity(x: str) -> str:
    return f"trim(regexp_replace(regexp_replace(trim(regexp_extract({x}, {_q(T.ACTIVITY)}, 1)), {_q(T.ACTIVITY_TAIL)}, ''), {_q(T.ACTIVITY_ENDS)}, '', 'g'))"


def _activities(lines: str) -> str:
    return f"coalesce(list_filter(list_transform({lines}, lambda x: {_activity('x')}), lambda v: NOT list_contains({_list(T.NO_ACTIVITY)}, lower(v)) AND length(v) >= 4 AND NOT regexp_full_match(v, '[0-9]+') AND NOT regexp_matches(v, {_q(T.GLOSS)}))[1], 'NOT_FOUND')"


def oracles(texts: str) -> dict[str, str]:
    dossier = f"{ctes("evidence")}, dossier AS (SELECT investigation_id, string_agg(replace(field_name, '_', ' ') || ': ' || field_value, chr(10) ORDER BY ev_seq) AS text FROM evidence GROUP BY 1)"
    split = "list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '')"
    said = f"trim(regexp_extract(x, '(?i)\\b' || w || '\\s*(?:is|:|-)?\\s*(.*)', 1))"
    bare = f"trim(regexp_replace(trim(regexp_replace(said, {_q(T.LEAD)}, '')), {_q(T.TAIL)}, ''))"
    keep = lambda names, no: f"list_filter([{names}], lambda y: y IS NOT NULL AND NOT {_any('lower(y)', no)})"
    return {
        "x11_activities": f"{dossier} SELECT investigation_id, {_activities(split)} AS activity FROM dossier",
        "x15_page_fields": f"""{texts} SELECT t.page_id, coalesce(nullif(url, ''), nullif(regexp_extract(text, {_q(T.SITE)}), ''), 'NOT_FOUND') AS website,
          coalesce(substr(list_filter({split}, lambda x: length(x) > {T.LEAST})[1], 1, {T.CUT}), 'NOT_FOUND') AS description, {_activities(split)} AS activity FROM texts t JOIN pages p ON t.page_id = p.page_id""",
        "f14_address_lines": f"{ctes("evidence")} SELECT investigation_id, ev_seq, {_like('v')} AS address_like FROM (SELECT investigation_id, ev_seq, trim(coalesce(field_value, '')) AS v FROM evidence)",
        "x10_addresses": f"""{dossier}, l AS (SELECT investigation_id, i, x, lower(x) AS low, lag(x, 1) OVER w AS x1, lag(x, 2) OVER w AS x2, lead(x, 1) OVER w AS n1, lead(x, 2) OVER w AS n2, lead(x, 3) OVER w AS n3,
            investigation_id % 2 = 0 OR regexp_matches(lower(concat_ws(' ', lag(x, 3) OVER w, lag(x, 2) OVER w, lag(x, 1) OVER w, x)), 'alpha|foods') AS linked
            FROM (SELECT investigation_id, unnest(s) AS x, generate_subscripts(s, 1) AS i FROM (SELECT investigation_id, {split} AS s FROM dossier)) WINDOW w AS (PARTITION BY investigation_id ORDER BY i)),
          p AS (SELECT *, list_filter({_list(T.LABELS)}, lambda w: contains(low, w)) AS present FROM l WHERE linked AND NOT {_any("low", T.DENIED)}),
          s1 AS (SELECT investigation_id, i, k, {said} AS said FROM (SELECT *, unnest(present) AS w, generate_subscripts(present, 1) AS k FROM p)), s2 AS (SELECT *, {bare} AS bare FROM s1 WHERE length(said) > 5),
          tried AS (SELECT investigation_id, 1 AS pass, i, CASE WHEN k = 1 THEN 0 ELSE k + 2 END AS rank, CASE WHEN contains(bare, '.') AND length(string_split(bare, '.')[1]) > 8 THEN trim(string_split(bare, '.')[1]) ELSE bare END AS v FROM s2
            UNION ALL SELECT investigation_id, 1, i, 1, n1 FROM p WHERE len(present) > 0 UNION ALL SELECT investigation_id, 1, i, 2, array_to_string({keep("n1, n2, n3", T.NOT_BELOW)}, ', ') FROM p WHERE len(present) > 0
            UNION ALL SELECT investigation_id, 2, i, unnest([1, 2]), unnest([trim(regexp_replace(x, {_q(T.LOOSE_LEAD)}, '')), array_to_string({keep("x2, x1, x", T.NOT_ABOVE)}, ' | ')]) FROM l
              WHERE linked AND regexp_matches(x, '\\b[0-9]{{6}}\\b') AND {_any("low", T.STATES)} AND NOT {_any("low", T.DENIED_LOOSE)})
          SELECT d.investigation_id, coalesce(any_value(a.v), 'NOT_FOUND') AS address FROM dossier d LEFT JOIN (SELECT investigation_id, arg_min(v, (pass, i, rank)) AS v FROM tried WHERE v IS NOT NULL AND {_like("trim(v)")} GROUP BY 1) a
            ON d.investigation_id = a.investigation_id GROUP BY 1""",
    }
