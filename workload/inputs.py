"""Inputs of the registered queries: dirty views over the given tables.

Each view is one SQL text that Spark and DuckDB both run. Faults follow the keys, so counts are
known, and every view has as many rows as its table.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession

AS_OF = dt.date(2026, 1, 1)

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]

VIEWS: dict[str, str] = {}

# Supply chain: one row per order.
VIEWS["dirty_orders"] = """
SELECT o_orderkey AS row_key,
 CASE WHEN o_orderkey % 97 = 0 THEN 'BAD-' || CAST(o_orderkey AS STRING)
      WHEN o_orderkey % 50 = 1 THEN 'ORD-' || lpad(CAST(o_orderkey - 1 AS STRING), CAST(greatest(8, length(CAST(o_orderkey - 1 AS STRING))) AS INT), '0')
      ELSE 'ORD-' || lpad(CAST(o_orderkey AS STRING), CAST(greatest(8, length(CAST(o_orderkey AS STRING))) AS INT), '0') END AS order_id,
 CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE 'SUP-' || lpad(CAST(o_orderkey % 80 AS STRING), 5, '0') END AS supplier_id,
 CASE WHEN o_orderkey % 14 = 0 THEN 'acme SUPPLY' ELSE 'Acme Supply' END AS supplier_name,
 CASE WHEN o_orderkey % 11 = 0 THEN substr(CAST(CAST(o_orderdate AS DATE) AS STRING), 6, 2) || '/' || substr(CAST(CAST(o_orderdate AS DATE) AS STRING), 9, 2) || '/' || substr(CAST(CAST(o_orderdate AS DATE) AS STRING), 1, 4)
      WHEN o_orderkey % 61 = 0 THEN '2099-01-01'
      ELSE CAST(CAST(o_orderdate AS DATE) AS STRING) END AS order_date,
 CASE WHEN o_orderkey % 10 = 0 THEN NULL WHEN o_orderkey % 31 = 0 THEN '1994-12-31' ELSE '2002-06-30' END AS actual_delivery,
 CAST(CASE WHEN o_orderkey % 23 = 0 THEN 0 WHEN o_orderkey % 19 = 0 THEN -(1 + o_orderkey % 50) ELSE 1 + o_orderkey % 50 END AS BIGINT) AS quantity,
 CAST(5 + o_orderkey % 200 AS DOUBLE) AS unit_price,
 CASE WHEN o_orderkey % 37 = 0 THEN NULL
      WHEN o_orderkey % 15 = 0 THEN CAST((1 + o_orderkey % 50) * (5 + o_orderkey % 200) * 2 AS DOUBLE)
      WHEN o_orderkey % 401 = 0 THEN CAST(10000000 AS DOUBLE)
      ELSE CAST((1 + o_orderkey % 50) * (5 + o_orderkey % 200) AS DOUBLE) END AS total_amount,
 CASE WHEN o_orderkey % 21 = 0 THEN '$' || CAST(5 + o_orderkey % 200 AS STRING) ELSE CAST(5 + o_orderkey % 200 AS STRING) END AS price_text,
 CASE WHEN o_orderkey % 13 = 0 THEN 'delivered' WHEN o_orderkey % 29 = 0 THEN ' Delivered ' WHEN o_orderkey % 3 = 0 THEN 'Delivered' WHEN o_orderkey % 3 = 1 THEN 'Ordered' ELSE 'Cancelled' END AS status,
 CASE WHEN o_orderkey % 8 = 0 THEN NULL WHEN o_orderkey % 26 = 1 THEN 'PASS' WHEN o_orderkey % 2 = 0 THEN 'Pass' ELSE 'Pending' END AS quality_check,
 CASE WHEN o_orderkey % 43 = 0 THEN NULL ELSE '2000-01-01' END AS last_updated,
 'batch-1' AS batch_id
FROM orders
"""

# Finance and people: one row per customer.
VIEWS["dirty_customers"] = """
SELECT c_custkey AS row_key,
 'CUST-' || lpad(CAST(c_custkey - c_custkey % 20 % 2 AS STRING), CAST(greatest(5, length(CAST(c_custkey - c_custkey % 20 % 2 AS STRING))) AS INT), '0') AS customer_id,
 CASE WHEN c_custkey % 25 = 0 THEN upper(c_name) WHEN c_custkey % 33 = 0 THEN '  ' ELSE c_name END AS customer_name,
 CASE WHEN c_custkey % 20 = 0 THEN NULL WHEN c_custkey % 18 = 0 THEN 'not-an-email' ELSE 'user' || CAST(c_custkey AS STRING) || '@example.com' END AS email,
 CASE WHEN c_custkey % 16 = 0 THEN '12345' ELSE '(555) 010-' || lpad(CAST(c_custkey % 10000 AS STRING), 4, '0') END AS phone,
 CASE WHEN c_custkey % 24 = 0 THEN '123456789' ELSE lpad(CAST(100 + c_custkey % 900 AS STRING), 3, '0') || '-' || lpad(CAST(10 + c_custkey % 90 AS STRING), 2, '0') || '-' || lpad(CAST(1000 + c_custkey % 9000 AS STRING), 4, '0') END AS ssn,
 CASE WHEN c_custkey % 22 = 0 THEN 'ABCDE' ELSE lpad(CAST(10000 + c_custkey % 80000 AS STRING), 5, '0') END AS zip_code,
 CAST(CASE WHEN c_custkey % 50 = 0 THEN 999 WHEN c_custkey % 41 = 0 THEN -5 ELSE 18 + c_custkey % 70 END AS INT) AS age,
 CASE WHEN c_custkey % 12 = 0 THEN 'm' WHEN c_custkey % 27 = 0 THEN 'FEMALE' WHEN c_custkey % 2 = 0 THEN 'Male' ELSE 'Female' END AS gender,
 CASE WHEN c_custkey % 30 = 0 THEN 'usd' ELSE 'USD' END AS currency,
 c_acctbal AS balance,
 CAST(CASE WHEN c_custkey % 55 = 0 THEN 7 ELSE c_custkey % 2 END AS INT) AS fraud_flag,
 CAST(100000 AS DOUBLE) AS coverage_amount,
 CAST(CASE WHEN c_custkey % 35 = 0 THEN 150000 ELSE 1000 + c_custkey END AS DOUBLE) AS claim_amount,
 CASE WHEN c_custkey % 60 = 0 THEN 'N/A' ELSE c_mktsegment END AS segment,
 CASE WHEN c_custkey % 45 = 0 THEN 'caf' || chr(233) ELSE 'cafe' END AS note,
 CASE WHEN c_custkey % 3 = 0 THEN 'ab' ELSE 'abcdef' END AS abbr
FROM customer
"""

# Copies of whole rows.
VIEWS["dirty_events"] = """
SELECT event_id, user_id, event_type, value FROM events
UNION ALL
SELECT event_id, user_id, event_type, value FROM events WHERE event_id % 16 = 0
"""

# Automotive: one row per part.
VIEWS["dirty_services"] = """
SELECT p_partkey AS row_key,
 CASE WHEN p_partkey % 40 = 0 THEN 'VEH-1' ELSE 'VEH-' || lpad(CAST(p_partkey - p_partkey % 4 AS STRING), CAST(greatest(6, length(CAST(p_partkey - p_partkey % 4 AS STRING))) AS INT), '0') END AS vehicle_id,
 CASE WHEN p_partkey % 17 = 0 THEN 'INVALIDVIN123' WHEN p_partkey % 31 = 0 THEN '1HGBH41JXMI109186' ELSE '1HGBH41JX' || lpad(CAST(p_partkey AS STRING), CAST(greatest(8, length(CAST(p_partkey AS STRING))) AS INT), '0') END AS vin,
 CASE WHEN p_partkey % 12 = 0 THEN 'FORD' WHEN p_partkey % 12 = 1 THEN 'honda' WHEN p_partkey % 3 = 0 THEN 'Ford' ELSE 'Toyota' END AS make,
 p_type AS model,
 CAST(CASE WHEN p_partkey % 53 = 0 THEN 2099 WHEN p_partkey % 47 = 0 THEN 1899 ELSE 1985 + p_partkey % 38 END AS INT) AS year,
 CAST(CASE WHEN p_partkey % 21 = 0 THEN -(p_partkey % 900) - 1 WHEN p_partkey % 59 = 0 THEN 3000000 ELSE p_partkey * 37 % 200000 END AS BIGINT) AS mileage,
 CASE WHEN p_partkey % 9 = 0 THEN 'diesel' WHEN p_partkey % 14 = 0 THEN 'steam' WHEN p_partkey % 2 = 0 THEN 'Hybrid' ELSE 'Electric' END AS engine_type,
 CASE WHEN p_partkey % 13 = 0 THEN NULL WHEN p_partkey % 7 = 0 THEN 'jane o''neil' ELSE 'Jane O''Neil' END AS technician,
 CAST(p_size * 10 AS DOUBLE) AS parts_cost,
 CAST(50 + p_partkey % 100 AS DOUBLE) AS labor_cost,
 CASE WHEN p_partkey % 11 = 0 THEN CAST((p_size * 10 + 50 + p_partkey % 100) * 2 AS DOUBLE) WHEN p_partkey % 45 = 0 THEN CAST(-20 AS DOUBLE) ELSE CAST(p_size * 10 + 50 + p_partkey % 100 AS DOUBLE) END AS cost,
 CASE WHEN p_partkey % 15 = 0 THEN 'active' WHEN p_partkey % 5 = 0 THEN 'Active' WHEN p_partkey % 2 = 0 THEN 'Expired' ELSE 'Not Applicable' END AS warranty_status,
 CASE WHEN p_partkey % 19 = 0 THEN '2027-03-01' WHEN p_partkey % 10 = 0 THEN '31-12-2009' WHEN p_partkey % 10 = 1 THEN '2024/02/29' WHEN p_partkey % 10 = 2 THEN '2023-02-30' ELSE '2024-0' || CAST(1 + p_partkey % 9 AS STRING) || '-15' END AS service_date,
 CASE WHEN p_partkey % 6 = 0 THEN '2022-05-01' ELSE '2025-11-30' END AS updated_at,
 CAST(NULL AS STRING) AS recall_note,
 'garage-7' AS source_system
FROM part
"""

# Insurance: one row per order.
VIEWS["dirty_claims"] = """
SELECT o_orderkey AS row_key,
 CASE WHEN o_orderkey % 90 = 1 THEN 'POL-' || lpad(CAST(o_orderkey - 1 AS STRING), CAST(greatest(7, length(CAST(o_orderkey - 1 AS STRING))) AS INT), '0') ELSE 'POL-' || lpad(CAST(o_orderkey AS STRING), CAST(greatest(7, length(CAST(o_orderkey AS STRING))) AS INT), '0') END AS policy_id,
 CASE WHEN o_orderkey % 7 = 0 THEN NULL WHEN o_orderkey % 101 = 0 THEN 'CLM-X' ELSE 'CLM-' || lpad(CAST(o_orderkey AS STRING), CAST(greatest(8, length(CAST(o_orderkey AS STRING))) AS INT), '0') END AS claim_id,
 'CUST-' || lpad(CAST(o_custkey AS STRING), CAST(greatest(6, length(CAST(o_custkey AS STRING))) AS INT), '0') AS customer_id,
 CASE WHEN o_orderkey % 16 = 0 THEN 'HEALTH' WHEN o_orderkey % 18 = 0 THEN 'pet' WHEN o_orderkey % 2 = 0 THEN 'Health' ELSE 'Auto' END AS policy_type,
 CAST(50000 AS DOUBLE) AS coverage_amount,
 CASE WHEN o_orderkey % 44 = 0 THEN CAST(0 AS DOUBLE) ELSE CAST(100 + o_orderkey % 900 AS DOUBLE) END AS premium,
 CASE WHEN o_orderkey % 52 = 0 THEN CAST(60000 AS DOUBLE) WHEN o_orderkey % 77 = 0 THEN CAST(-5 AS DOUBLE) ELSE CAST(250 + o_orderkey % 500 AS DOUBLE) END AS deductible,
 '2020-01-01' AS policy_start,
 CASE WHEN o_orderkey % 33 = 0 THEN '2019-06-30' ELSE '2024-12-31' END AS policy_end,
 CASE WHEN o_orderkey % 26 = 0 THEN '2025-06-01' WHEN o_orderkey % 12 = 0 THEN NULL WHEN o_orderkey % 41 = 0 THEN '03/15/2021' ELSE '2022-07-04' END AS claim_date,
 CASE WHEN o_orderkey % 20 = 0 THEN CAST(55000 AS DOUBLE) ELSE CAST(1000 + o_orderkey % 9000 AS DOUBLE) END AS claim_amount,
 CASE WHEN o_orderkey % 3 = 0 THEN 'Settled' WHEN o_orderkey % 3 = 1 THEN 'Approved' ELSE 'submitted' END AS claim_status,
 CASE WHEN o_orderkey % 6 = 0 THEN NULL WHEN o_orderkey % 3 = 0 THEN CAST(900 + o_orderkey % 100 AS DOUBLE) ELSE NULL END AS settlement_amount,
 CASE WHEN o_orderkey % 28 = 0 THEN 'tx' ELSE 'TX' END AS state,
 CASE WHEN o_orderkey % 35 = 0 THEN '1234' WHEN o_orderkey % 36 = 0 THEN '12345-6789' ELSE '73301' END AS zip_code
FROM orders
"""

# Finance: one row per order.
VIEWS["dirty_transactions"] = """
SELECT o_orderkey AS row_key,
 CASE WHEN o_orderkey % 89 = 0 THEN 'TX' || CAST(o_orderkey AS STRING) WHEN o_orderkey % 70 = 1 THEN 'TXN-' || lpad(CAST(o_orderkey - 1 AS STRING), CAST(greatest(8, length(CAST(o_orderkey - 1 AS STRING))) AS INT), '0')
  ELSE 'TXN-' || lpad(CAST(o_orderkey AS STRING), CAST(greatest(8, length(CAST(o_orderkey AS STRING))) AS INT), '0') END AS transaction_id,
 CASE WHEN o_orderkey % 14 = 0 THEN NULL WHEN o_orderkey % 45 = 0 THEN 'ACC-12' ELSE 'ACC-' || CAST(1000000 + o_custkey AS STRING) END AS account_id,
 CASE WHEN o_orderkey % 27 = 0 THEN 'ada BERG' ELSE 'Ada Berg' END AS customer_name,
 CASE WHEN o_orderkey % 38 = 0 THEN '4111 1111' ELSE CAST(4000000000000000 + o_orderkey AS STRING) END AS card_number,
 CASE WHEN o_orderkey % 47 = 0 THEN '2031-05-06' WHEN o_orderkey % 53 = 0 THEN 'soon' WHEN o_orderkey % 9 = 0 THEN '11/30/2023' ELSE '2023-11-30' END AS transaction_date,
 CASE WHEN o_orderkey % 41 = 0 THEN NULL WHEN o_orderkey % 32 = 0 THEN CAST(0 AS DOUBLE) ELSE CAST(10 + o_orderkey % 5000 AS DOUBLE) END AS amount,
 CASE WHEN o_orderkey % 15 = 0 THEN 'usd' WHEN o_orderkey % 58 = 0 THEN 'XAU' ELSE 'USD' END AS currency,
 CASE o_orderkey % 4 WHEN 0 THEN 'Credit' WHEN 1 THEN 'Debit' WHEN 2 THEN 'transfer' ELSE 'Fee' END AS transaction_type,
 CASE o_orderkey % 5 WHEN 0 THEN 'Failed' WHEN 1 THEN 'COMPLETED' WHEN 2 THEN 'Pending' ELSE 'Completed' END AS status,
 CAST(o_orderkey * 13 % 60000 AS DOUBLE) AS balance,
 CASE WHEN o_orderkey % 21 = 0 THEN NULL WHEN o_orderkey % 83 = 0 THEN CAST(-1 AS DOUBLE) ELSE CAST(40000 AS DOUBLE) END AS credit_limit
FROM orders
"""

# Healthcare: one row per event.
VIEWS["dirty_admissions"] = """
SELECT event_id AS row_key,
 'PAT-' || lpad(CAST(event_id - event_id % 30 % 2 AS STRING), CAST(greatest(6, length(CAST(event_id - event_id % 30 % 2 AS STRING))) AS INT), '0') AS patient_id,
 CASE WHEN event_id % 34 = 0 THEN 'mary-ann SMITH' ELSE 'Mary-Ann Smith' END AS patient_name,
 CAST(CASE WHEN event_id % 48 = 0 THEN 150 WHEN event_id % 49 = 0 THEN -1 WHEN event_id % 9 = 0 THEN 30 ELSE 2025 - (1940 + event_id % 70) END AS BIGINT) AS age,
 CAST(1940 + event_id % 70 AS STRING) || '-06-15' AS date_of_birth,
 CASE WHEN event_id % 12 = 0 THEN NULL WHEN event_id % 40 = 0 THEN 'XX1' ELSE 'J18.9' END AS diagnosis_code,
 CASE WHEN event_id % 14 = 0 THEN '04/05/2021' WHEN event_id % 63 = 0 THEN '2031-01-01' ELSE '2021-04-05' END AS admission_date,
 CASE WHEN event_id % 22 = 0 THEN '2021-03-01' WHEN event_id % 8 = 0 THEN NULL ELSE '2021-04-15' END AS discharge_date,
 CASE WHEN event_id % 51 = 0 THEN CAST(-500 AS DOUBLE) WHEN event_id % 333 = 0 THEN CAST(50000001 AS DOUBLE) ELSE CAST(500 + event_id % 5000 AS DOUBLE) END AS bill_amount,
 CASE WHEN event_id % 10 = 0 THEN 'ACTIVE' WHEN event_id % 3 = 0 THEN 'Active' WHEN event_id % 3 = 1 THEN 'Discharged' ELSE 'Transferred' END AS status,
 CASE WHEN event_id % 25 = 0 THEN 'paid ' ELSE 'Paid' END AS payment_status
FROM events
"""

# History tables: runs from orders, scores and issues from line items, fixes from line items.
VIEWS["analysis_runs"] = """
SELECT CAST(o_orderkey AS BIGINT) AS run_id, 'set-' || CAST(o_custkey % 20 AS STRING) AS dataset_name,
 CASE o_orderkey % 5 WHEN 0 THEN 'healthcare' WHEN 1 THEN 'finance' WHEN 2 THEN 'insurance' WHEN 3 THEN 'supply_chain' ELSE 'automotive' END AS domain,
 CAST(1000 + o_orderkey % 5000 AS BIGINT) AS row_count, CAST(10 + o_orderkey % 15 AS INT) AS col_count,
 CAST(20 + o_orderkey * 7 % 80 AS DOUBLE) AS overall_score,
 CAST(CAST(o_orderdate AS DATE) AS STRING) AS run_timestamp
FROM orders
"""
VIEWS["run_scores"] = """
SELECT CAST(l_orderkey AS BIGINT) AS run_id, dimension, CAST(min(raw % 101) AS DOUBLE) AS score,
 CAST(count(*) AS BIGINT) AS issues_found
FROM (SELECT l_orderkey, l_partkey * 13 + l_suppkey AS raw,
       CASE l_partkey % 6 WHEN 0 THEN 'completeness' WHEN 1 THEN 'validity' WHEN 2 THEN 'accuracy' WHEN 3 THEN 'timeliness' WHEN 4 THEN 'integrity' ELSE 'lineage' END AS dimension
      FROM lineitem) AS raw_scores
GROUP BY l_orderkey, dimension
"""
VIEWS["issue_log"] = """
SELECT CAST(l_orderkey AS BIGINT) AS run_id,
 CASE l_orderkey % 5 WHEN 0 THEN 'healthcare' WHEN 1 THEN 'finance' WHEN 2 THEN 'insurance' WHEN 3 THEN 'supply_chain' ELSE 'automotive' END AS domain,
 CASE l_partkey % 6 WHEN 0 THEN 'completeness' WHEN 1 THEN 'validity' WHEN 2 THEN 'accuracy' WHEN 3 THEN 'timeliness' WHEN 4 THEN 'integrity' ELSE 'lineage' END AS dimension,
 'col_' || CAST(l_partkey % 12 AS STRING) AS column_name,
 CASE l_suppkey % 4 WHEN 0 THEN 'missing_values' WHEN 1 THEN 'pattern_violation' WHEN 2 THEN 'stale_records' ELSE 'range_violation' END AS issue_type,
 CAST(min(l_partkey * 3 + l_suppkey) AS BIGINT) AS affected_rows,
 CAST(min(l_partkey % 100) AS DOUBLE) / 100 AS affected_pct,
 CASE min(l_suppkey * 7 % 4) WHEN 0 THEN 'CRITICAL' WHEN 1 THEN 'HIGH' WHEN 2 THEN 'MEDIUM' ELSE 'LOW' END AS severity,
 CASE min(l_suppkey % 3) WHEN 0 THEN 'HIGH' WHEN 1 THEN 'MEDIUM' ELSE 'LOW' END AS risk_level,
 'fix_' || CAST(min(l_linenumber) AS STRING) AS fix_action,
 min(l_partkey) % 2 = 0 AS auto_fixable,
 CAST(max(CAST(l_shipdate AS DATE)) AS STRING) AS logged_at
FROM lineitem
GROUP BY l_orderkey, l_partkey % 6, l_partkey % 12, l_suppkey % 4
"""
VIEWS["fix_events"] = """
SELECT CAST(l_orderkey AS BIGINT) * 1000000 + l_partkey * 10 + min(l_linenumber) AS fix_id, CAST(l_orderkey AS BIGINT) AS run_id,
 CASE l_orderkey % 5 WHEN 0 THEN 'healthcare' WHEN 1 THEN 'finance' WHEN 2 THEN 'insurance' WHEN 3 THEN 'supply_chain' ELSE 'automotive' END AS domain,
 CASE l_partkey % 6 WHEN 0 THEN 'completeness' WHEN 1 THEN 'validity' WHEN 2 THEN 'accuracy' WHEN 3 THEN 'timeliness' WHEN 4 THEN 'integrity' ELSE 'lineage' END AS dimension,
 'col_' || CAST(l_partkey % 12 AS STRING) AS column_name,
 CASE min(l_suppkey) % 4 WHEN 0 THEN 'missing_values' WHEN 1 THEN 'pattern_violation' WHEN 2 THEN 'stale_records' ELSE 'range_violation' END AS issue_type,
 'fix_' || CAST(min(l_linenumber) AS STRING) AS fix_action,
 CAST(min(l_quantity) AS BIGINT) AS rows_affected,
 CAST(CASE WHEN min(l_linenumber) = 1 THEN 1 WHEN l_partkey % 9 = 0 THEN 0 ELSE 1 END AS INT) AS success,
 CAST(max(CAST(l_shipdate AS DATE)) AS STRING) AS applied_at
FROM lineitem
GROUP BY l_orderkey, l_partkey
"""

# Principals of an access registry: one row per customer.
VIEWS["principals"] = """
SELECT c_custkey AS principal_id, c_name AS name,
 CASE c_custkey % 6 WHEN 0 THEN 'Lead Data Engineer' WHEN 1 THEN 'Analyst' WHEN 2 THEN 'Marketing Manager' WHEN 3 THEN 'Compliance Officer' WHEN 4 THEN 'External Contractor' ELSE 'Service Account' END AS role,
 CASE c_custkey % 5 WHEN 0 THEN 'Data Engineering' WHEN 1 THEN 'Analytics' WHEN 2 THEN 'Compliance' WHEN 3 THEN 'Marketing Team' ELSE 'External Contractors' END AS access_group,
 c_custkey % 4 < 2 AS can_view_sensitive,
 'user' || CAST(c_custkey AS STRING) || '@example.com' AS email
FROM customer
"""

KEYED = ["dirty_orders", "dirty_customers", "dirty_services", "dirty_claims", "dirty_admissions"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Views that put nearly every row in a group of its own. Their rows are dealt by the first grouping column
# before they are grouped, in pieces of a file split: a task holds the groups of one piece only.
GROUPED = {"run_scores": "l_orderkey", "issue_log": "l_orderkey", "fix_events": "l_orderkey"}
PIECES = 16


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A dirty view over the tables of ``sf_dir``."""
    sql = VIEWS[name]
    for base in TABLES:
        if f"FROM {base}" in sql:
            rows = table(spark, sf_dir, base)
            if name in GROUPED:
                rows = rows.repartition(PIECES * max(rows.rdd.getNumPartitions(), 1), GROUPED[name])
            rows.createOrReplaceTempView(base)
    return spark.sql(sql)


def with_views(sql: str) -> str:
    """``sql`` with the text of every view it names in front, for DuckDB."""
    used = [n for n in VIEWS if n in sql]
    heads = [f"{n} AS ({VIEWS[n].strip()})" for n in used]
    body = sql.strip()
    if not heads:
        return body
    if body.upper().startswith("WITH "):
        return "WITH " + ",\n".join(heads) + ",\n" + body[5:]
    return "WITH " + ",\n".join(heads) + "\n" + body
