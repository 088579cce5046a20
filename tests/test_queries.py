"""The registered queries against DuckDB on the smallest tables.

All queries are checked with ALL_QUERIES=1; the default is one query per family.
"""

import decimal
import math
import os

import pytest

import __spark_entry__ as entry

from .helpers import DATA

SMALL = f"{DATA}/sf0.001"
DEFAULT = [
    "missing_values_orders", "text_profile", "numeric_profile", "exact_duplicates", "duplicate_ids", "duplicate_id_rows",
    "near_duplicates", "survivorship_conflicts", "pattern_violation_customers", "range_violation_services",
    "date_order_orders", "mixed_date_formats_orders", "title_case_services", "statistical_outlier", "extreme_outliers",
    "placeholder_values", "unreadable_chars_documents", "future_dates_services", "pii_columns_customers",
    "declared_fields_healthcare", "declared_checks_insurance", "violation_samples", "fix_impute_median", "fix_id_dedup_parity",
    "fix_standardize_orders", "fix_consistency_orders_log", "fix_winsorize", "fix_golden_record", "fix_pii_plan",
    "fix_pii_tokenize", "fix_low_risk", "learning_patterns", "global_summary", "column_history", "report_recommendations",
    "access_review", "pre_post_comparison", "json_pages", "xml_export", "inject_nulls", "dimension_scores",
]
NAMES = list(entry.queries()) if os.environ.get("ALL_QUERIES") else DEFAULT


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    from workload.inputs import TABLES
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, (float, decimal.Decimal)):
        return None if math.isnan(v) else round(float(v), 8)
    return v


def shaped(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=str)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, duck, name):
    df = entry.queries()[name](spark, SMALL)
    got = shaped(df.columns, df.collect())
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert df.columns
        return
    result = duck.execute(sql)
    columns = [c[0] for c in result.description]
    assert sorted(df.columns) == sorted(columns)
    assert got == shaped(columns, result.fetchall())


def test_registry():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) >= 240 and len(sql) >= 235


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert len(rows) == 22
