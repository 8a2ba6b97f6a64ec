"""Queries of linkage over whole tables, with pairs planted from the targets, and their SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from probitas.operators import linkage as L
from probitas.operators import similarity as M
from probitas.sources.views import ctes, view

#: A record of each target as another source would have it, and whether it is of the same company: one in
#: five is another company with one word in common, one in seven has an identifier of another company.
PLANTED = """SELECT target_id + 1000000000 AS candidate_id, nationkey,
  CASE target_id % 5 WHEN 0 THEN upper(name) WHEN 1 THEN replace(name, ' Private Limited', ' Pvt. Ltd.') WHEN 2 THEN replace(name, split_part(name, ' ', 2) || ' ', '') WHEN 3 THEN split_part(name, ' ', 3) || ' ' || split_part(name, ' ', 1) || ' ' || split_part(name, ' ', 2) || ' Ltd' ELSE split_part(name, ' ', 1) || ' Traders' END AS name,
  CASE WHEN target_id % 2 = 0 THEN location END AS location, CASE WHEN target_id % 3 = 1 THEN website END AS website, CASE WHEN target_id % 7 = 0 THEN '99' || substr(gstin, 3) WHEN target_id % 8 = 0 THEN gstin END AS gstin,
  target_id % 5 < 4 AND NOT (target_id % 7 = 0 AND gstin IS NOT NULL) AS same FROM {targets}"""
_PLAIN = ("candidate_id", "nationkey", "name", "location", "website", "gstin")


def _planted(s: SparkSession, d: str) -> DataFrame:
    return s.sql(PLANTED, targets=view(s, d, "targets"))


def _resolved(s: SparkSession, d: str) -> DataFrame:
    candidates = view(s, d, "candidates").select(*_PLAIN).union(_planted(s, d).select(*_PLAIN))
    return M.corpus_resolve(view(s, d, "targets"), candidates)


def _accuracy(s: SparkSession, d: str) -> DataFrame:
    labels = _planted(s, d).select((F.col("candidate_id") - 1000000000).alias("target_id"), F.when(F.col("same"), F.col("candidate_id")).alias("expected"))
    return L.accuracy_report(_resolved(s, d), labels).select(F.round("accuracy", 9).alias("accuracy"), F.round("false_merge_rate", 9).alias("false_merge_rate"))


QUERIES = {
    "j4_corpus_pairs": lambda s, d: M.corpus_pairs(view(s, d, "targets"), view(s, d, "candidates")).select("target_id", "candidate_id", "score", "exact", "conflict"),
    "j5_corpus_resolve": _resolved,
    "j25_accuracy": _accuracy,
}


def oracles(pairs: str, resolved: str) -> dict[str, str]:
    """The same in SQL over all pairs; pairs are the CTEs of scored pairs of a scope, resolved the statement over them."""
    every = pairs.replace("ON t.nationkey = c.nationkey", "ON TRUE")
    kept = ", reached AS (SELECT * FROM scored WHERE score >= {t} AND target_id IN (SELECT target_id FROM t WHERE t_name IS NOT NULL) AND candidate_id IN (SELECT candidate_id FROM c WHERE c_name IS NOT NULL) OR exact)".format(t=L.THRESHOLD)
    both = ctes("targets", "candidates").replace("candidates AS (", "own AS (") + f""", planted AS ({PLANTED.format(targets='targets')}), candidates AS (SELECT {', '.join(_PLAIN)} FROM own UNION ALL SELECT {', '.join(_PLAIN)} FROM planted)"""
    head = f"{ctes('targets', 'candidates')}{pairs}"
    corpus = resolved.replace(head, f"{both}{every}{kept}").replace("FROM scored)", "FROM reached)")
    return {
        "j4_corpus_pairs": f"{ctes('targets', 'candidates')}{every}{kept} SELECT target_id, candidate_id, score, exact, conflict FROM reached",
        "j5_corpus_resolve": corpus,
        "j25_accuracy": f"""WITH r AS ({corpus}), tg AS ({ctes('targets')} SELECT * FROM targets), l AS (SELECT candidate_id - 1000000000 AS target_id, CASE WHEN same THEN candidate_id END AS expected FROM ({PLANTED.format(targets='tg')})),
  j AS (SELECT expected, CASE WHEN matched THEN candidate_id END AS got FROM l LEFT JOIN r ON r.target_id = l.target_id) SELECT round(avg(CAST(expected IS NOT DISTINCT FROM got AS INT)), 9) AS accuracy, round(avg(CAST(got IS NOT NULL AND expected IS DISTINCT FROM got AS INT)), 9) AS false_merge_rate FROM j""",
    }
