"""Queries with rules as data: a file that changes a weight and the levels, and a table with one rule more."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from probitas.operators import risk as K
from probitas.operators.rulebook import RuleBook, parse_rules, rules_from_table
from probitas.sources.views import ctes, view

RULES_FILE = """
rules:
  GST_INACTIVE: {weight: 40}
  COMPANY_STATUS_ADVERSE: {}
  LEGAL_NAME_CONFLICT: {}
  ADDRESS_MAJOR_MISMATCH: {}
  BUSINESS_ACTIVITY_MISMATCH: {severity: LOW}
risk_levels:
  low: {min: 0, max: 20}
  moderate: {min: 21, max: 50}
  high: {min: 51, max: 80}
  very_high: {min: 81, max: 100}
"""
#: In addition: a status that counts, and a number that differs between rows.
TABLE = [("EPFO_LISTED", 7, "OPERATIONAL", "LOW", "one_of", ["epfo_status"], "text", ["available"]), ("TAX_ID_CONFLICT", 50, "IDENTITY", "HIGH", "differs", ["gstin", "contact_address"], "activity", None)]


def _book(s: SparkSession) -> RuleBook:
    more = s.createDataFrame(TABLE, "code string, weight int, category string, severity string, kind string, fields array<string>, form string, values array<string>")
    return rules_from_table(more, parse_rules(RULES_FILE, K.BOOK))


def _signals(s: SparkSession, d: str, book: RuleBook) -> DataFrame:
    return K.attach_rules(K.exploded(K.risk_profile(view(s, d, "evidence"), book)), book.catalog(s))


def custom_scores(s: SparkSession, d: str) -> DataFrame:
    return K.risk_scores(view(s, d, "investigations"), view(s, d, "evidence"), _book(s))


def custom_signals(s: SparkSession, d: str) -> DataFrame:
    return _signals(s, d, _book(s)).select("investigation_id", "code", "category", "severity", "risk_weight", F.array_join("evidence_ids", ",").alias("evidence_ids"))


QUERIES = {"e3_custom_rule_scores": custom_scores, "e3_custom_rule_signals": custom_signals}


def oracles(signals: str) -> dict[str, str]:
    """signals: the CTEs up to signals, with adm and sub."""
    more = f"""{ctes('investigations', 'evidence')}{signals}, taxes AS (SELECT investigation_id, research_result_id, ev_seq, regexp_replace(lower(field_value), '[^a-z0-9]', '', 'g') AS v FROM adm WHERE field_name IN ('gstin', 'contact_address')),
  tax1 AS (SELECT investigation_id, v, min(ev_seq) AS pos, arg_min(research_result_id, ev_seq) AS id FROM taxes WHERE v <> '' GROUP BY 1, 2), tax2 AS (SELECT investigation_id, list(id ORDER BY pos)[1:2] AS ids FROM tax1 GROUP BY 1 HAVING count(*) > 1),
  epfo AS (SELECT investigation_id, arg_min(research_result_id, ev_seq) AS id FROM adm WHERE field_name = 'epfo_status' AND lower(trim(field_value)) = 'available' GROUP BY 1),
  every AS (SELECT investigation_id, code, category, CASE code WHEN 'BUSINESS_ACTIVITY_MISMATCH' THEN 'LOW' ELSE severity END AS severity, CASE code WHEN 'GST_INACTIVE' THEN 40 ELSE risk_weight END AS risk_weight, evidence_ids FROM signals WHERE code <> 'VERY_RECENT_REGISTRATION'
    UNION ALL SELECT investigation_id, 'EPFO_LISTED', 'OPERATIONAL', 'LOW', 7, id FROM epfo WHERE investigation_id IN (SELECT investigation_id FROM sub)
    UNION ALL SELECT investigation_id, 'TAX_ID_CONFLICT', 'IDENTITY', 'HIGH', 50, array_to_string(ids, ',') FROM tax2 WHERE investigation_id IN (SELECT investigation_id FROM sub))"""
    return {
        "e3_custom_rule_signals": f"{more} SELECT * FROM every",
        "e3_custom_rule_scores": f"""{more}, t AS (SELECT investigation_id, sum(risk_weight) AS total, count(*) AS n FROM every GROUP BY 1), x AS (SELECT i.investigation_id, i.investigation_id NOT IN (SELECT investigation_id FROM sub) AS bare, coalesce(total, 0) AS total, coalesce(n, 0) AS n FROM investigations i LEFT JOIN t ON t.investigation_id = i.investigation_id)
SELECT investigation_id, CASE WHEN NOT bare THEN CAST(least(total, 100) AS INTEGER) END AS score, CASE WHEN bare THEN 'INSUFFICIENT_EVIDENCE' WHEN total <= 20 THEN 'LOW' WHEN total <= 50 THEN 'MODERATE' WHEN total <= 80 THEN 'HIGH' ELSE 'VERY_HIGH' END AS level, bare AS insufficient_evidence, CAST(n AS BIGINT) AS n_signals FROM x""",
    }
