"""Due-diligence tables derived from the driver's tables, in SQL that Spark and DuckDB share.

{t} stands before each base table's name: the prefix of the temporary views here, nothing in DuckDB.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from probitas.cluster import stage_by, tasks_for

BASE = {"investigations": ["orders"], "evidence": ["lineitem"], "targets": ["supplier", "nation", "part"], "candidates": ["customer", "nation", "part"], "attempts": ["events"], "audit_events": ["events"], "intake": ["orders"], "research_tasks": ["lineitem"]}

VIEWS = {
    "investigations": """SELECT o_orderkey AS investigation_id, 'user-' || CAST(o_custkey % 50 AS STRING) AS user_id,
  CASE o_orderstatus WHEN 'F' THEN 'COMPLETED' WHEN 'P' THEN 'FAILED' ELSE 'PENDING_RESEARCH' END AS status, o_orderdate AS created_at,
  CASE WHEN o_orderstatus IN ('F','P') THEN o_orderdate + INTERVAL '1' DAY END AS completed_timestamp FROM {t}orders""",
    "evidence": """SELECT l_orderkey AS investigation_id, 'RES-' || CAST(l_linenumber AS STRING) AS research_result_id, 'TASK-' || CAST(l_partkey % 7 AS STRING) AS task_id,
  CASE l_partkey % 12 WHEN 0 THEN 'gst_status' WHEN 1 THEN 'company_status' WHEN 2 THEN 'legal_name' WHEN 3 THEN 'registered_address' WHEN 4 THEN 'business_activity' WHEN 5 THEN 'incorporation_date'
    WHEN 6 THEN 'epfo_status' WHEN 7 THEN 'candidate_entities' WHEN 8 THEN 'trade_name' WHEN 9 THEN 'gstin' WHEN 10 THEN 'contact_address' ELSE 'company_name' END AS field_name,
  CASE l_partkey % 12
    WHEN 0 THEN CASE l_suppkey % 4 WHEN 0 THEN 'Inactive' WHEN 1 THEN ' cancelled ' WHEN 2 THEN 'NOT_FOUND' ELSE 'Active' END
    WHEN 1 THEN CASE l_suppkey % 5 WHEN 0 THEN 'Struck  Off' WHEN 1 THEN 'Dormant' WHEN 2 THEN 'Suspended' ELSE 'Active' END
    WHEN 2 THEN CASE l_suppkey % 3 WHEN 0 THEN 'Alpha Foods Pvt. Ltd.' WHEN 1 THEN 'Alpha Foods Private Limited' ELSE 'Beta Foods LLP' END
    WHEN 3 THEN CASE l_suppkey % 3 WHEN 0 THEN '12 MG Road, Pune 411001, India' WHEN 1 THEN '12 MG Rd Pune 411001' ELSE '9 Park Street, Kolkata 700016' END
    WHEN 4 THEN CASE l_suppkey % 2 WHEN 0 THEN 'Wholesale trade' ELSE 'Software' END
    WHEN 5 THEN CASE l_suppkey % 3 WHEN 0 THEN '1994-03-01' WHEN 1 THEN '1998-06-15' ELSE '2000-01-10' END
    WHEN 6 THEN 'AVAILABLE' WHEN 7 THEN '[{"name":"Alpha Foods","confidence":0.7}]' WHEN 9 THEN '27ABCDE1234F1Z5' WHEN 10 THEN 'Pune'
    ELSE CASE l_suppkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'ALPHA FOODS LTD' WHEN 2 THEN 'UNAVAILABLE' ELSE 'Alpha Foods' END END AS field_value,
  CASE l_suppkey % 7 WHEN 0 THEN 'GST Portal' WHEN 1 THEN 'MCA Portal' WHEN 2 THEN 'EPFO Portal' WHEN 3 THEN 'Company Website' WHEN 4 THEN 'QuickCompany' WHEN 5 THEN 'Zauba Corp' ELSE 'General Web' END AS source_name,
  CAST(100 - 6 * CAST(round(l_discount * 100) AS INT) AS DOUBLE) / CAST(100 AS DOUBLE) AS confidence,
  CASE l_returnflag || l_linestatus WHEN 'AF' THEN 'VERIFIED' WHEN 'AO' THEN 'UNVERIFIED' WHEN 'NO' THEN 'UNVERIFIED' WHEN 'RF' THEN 'ENTITY_MISMATCH' WHEN 'RO' THEN 'NOT_FOUND' END AS verification_status,
  l_shipdate AS retrieved_at,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_shipdate, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_discount, l_tax) AS ev_seq FROM {t}lineitem""",
    "targets": """SELECT s_suppkey AS target_id, s_nationkey AS nationkey, p_name || ' Private Limited' AS name, n_name AS location,
  CASE WHEN s_suppkey % 3 = 0 THEN replace(p_name, ' ', '') || '.com' END AS website,
  CASE WHEN s_suppkey % 4 = 0 THEN CAST(10 + s_nationkey AS STRING) || 'ABCDE' || lpad(CAST(s_suppkey % 10000 AS STRING), 4, '0') || 'F1Z5' END AS gstin
  FROM {t}supplier JOIN {t}nation ON s_nationkey = n_nationkey JOIN {t}part ON p_partkey = s_suppkey""",
    "candidates": """SELECT c_custkey AS candidate_id, c_nationkey AS nationkey, p_name || CASE c_custkey % 3 WHEN 0 THEN ' Pvt Ltd' WHEN 1 THEN ' Limited' ELSE '' END AS name,
  CASE WHEN c_custkey % 2 = 0 THEN n_name END AS location, CASE WHEN c_custkey % 5 = 0 THEN 'https://www.' || replace(p_name, ' ', '') || '.com/about' END AS website,
  CASE WHEN c_custkey % 4 = 0 THEN CAST(10 + c_nationkey AS STRING) || 'ABCDE' || lpad(CAST(c_custkey % 10000 AS STRING), 4, '0') || 'F1Z5' END AS gstin
  FROM {t}customer JOIN {t}nation ON c_nationkey = n_nationkey JOIN {t}part ON p_partkey = c_custkey""",
    "attempts": """SELECT event_id AS attempt_id, user_id AS investigation_id,
  CASE event_id % 6 WHEN 0 THEN 'gst.gov.in' WHEN 1 THEN 'mca.gov.in' WHEN 2 THEN 'epfindia.gov.in' WHEN 3 THEN 'company_website' WHEN 4 THEN 'zaubacorp.com' ELSE 'generic_web' END AS domain,
  CASE event_type WHEN 'click' THEN 'SUCCESS' WHEN 'view' THEN 'NO_DATA' WHEN 'signup' THEN 'REJECTED' WHEN 'purchase' THEN 'BLOCKED_OR_ERROR' ELSE 'ERROR' END AS status, ts AS started_at,
  CASE event_id % 6 WHEN 0 THEN 'GST Portal' WHEN 1 THEN 'MCA Portal' WHEN 2 THEN 'EPFO Portal' WHEN 3 THEN ' company website' WHEN 4 THEN CASE WHEN event_id % 4 = 0 THEN 'Tofler' ELSE 'Zauba Corp' END ELSE 'General Web' END AS source_name,
  'https://site' || CAST(event_id % 9 AS STRING) || '.in/page' AS url FROM {t}events""",
    "intake": """SELECT o_orderkey AS investigation_id, CASE WHEN o_custkey % 5 <> 0 THEN 'Firm ' || CAST(o_custkey AS STRING) || ' Limited' WHEN o_custkey % 10 = 0 THEN '' END AS business_name,
  CASE WHEN o_custkey % 4 = 0 THEN '27ABCDE' || lpad(CAST(o_custkey % 10000 AS STRING), 4, '0') || 'F1Z5' END AS gstin, CASE WHEN o_custkey % 3 = 0 THEN 'U12345MH2001PTC' || lpad(CAST(o_custkey % 1000000 AS STRING), 6, '0') END AS cin,
  CASE WHEN o_custkey % 7 = 0 THEN 'MH/BAN/' || lpad(CAST(o_custkey % 100000 AS STRING), 5, '0') END AS epfo_code, CASE WHEN o_custkey % 6 = 0 THEN 'firm' || CAST(o_custkey AS STRING) || '.com' END AS website,
  CASE WHEN o_custkey % 8 <> 0 THEN 'Pune' END AS location FROM {t}orders""",
    "research_tasks": """SELECT l_orderkey AS investigation_id, 'TASK-' || lpad(CAST(l_linenumber AS STRING), 3, '0') AS task_id,
  CASE l_partkey % 3 WHEN 0 THEN 'GST_VERIFICATION' WHEN 1 THEN 'mca_verification ' ELSE 'MCA_VERIFICATION' END AS task_type, CASE l_suppkey % 3 WHEN 0 THEN ' Firm ' WHEN 1 THEN 'FIRM' ELSE 'Firm Two' END AS target,
  'Verify it' AS objective, CASE l_returnflag || l_linestatus WHEN 'AF' THEN 'COMPLETED' WHEN 'RF' THEN 'FAILED' WHEN 'NF' THEN 'STARTED' ELSE 'PENDING' END AS status, l_shipdate AS changed_at,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_shipdate, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_discount, l_tax) AS seq FROM {t}lineitem""",
    "audit_events": """SELECT event_id, user_id AS investigation_id,
  CASE event_id % 5 WHEN 0 THEN 'intake' WHEN 1 THEN 'planner' WHEN 2 THEN 'browser_research' WHEN 3 THEN 'risk_analysis' ELSE 'qa' END AS node,
  CASE WHEN event_type = 'error' THEN 'NODE_FAILED' WHEN event_type = 'view' THEN 'NODE_STARTED' ELSE 'NODE_COMPLETED' END AS event_type, ts AS created_at FROM {t}events""",
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    for base in BASE[name]:
        spark.read.parquet(f"{sf_dir}/{base}.parquet").createOrReplaceTempView(f"probitas_{base}")
    return spark.sql(VIEWS[name].replace("{t}", "probitas_"))


def dealt_tasks(spark: SparkSession, sf_dir: str) -> int:
    """Into how many tasks dealt() deals its rows."""
    return tasks_for(spark, spark.read.parquet(f"{sf_dir}/lineitem.parquet").count())  # from the files' footers


def dealt(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view over lineitem with the rows of an investigation in one task, for readers of the rows' order in it: the
    order is made in tasks of bounded size, whatever the size of the table."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").repartition(dealt_tasks(spark, sf_dir), "l_orderkey")
    rows.createOrReplaceTempView("probitas_dealt_lineitem")
    return spark.sql(VIEWS[name].replace("{t}", "probitas_dealt_"))


def by_investigation(spark: SparkSession, sf_dir: str, name: str = "evidence") -> DataFrame:
    """dealt() staged in buckets by investigation: for queries that read it more than once."""
    return stage_by(dealt(spark, sf_dir, name), "investigation_id", dealt_tasks(spark, sf_dir), name)


def ctes(*names: str) -> str:
    """The views as the leading CTEs of a DuckDB statement."""
    return "WITH " + ",\n".join(f"{n} AS ({VIEWS[n].replace('{t}', '')})" for n in names)
