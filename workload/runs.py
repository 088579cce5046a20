"""Whole checks: scores, overall score, repair and check again."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from plumbline.functions import fixed_values as fv
from plumbline.operators.fixes import Context
from plumbline.plans import remediation, reports
from plumbline.plans.analysis import analyze
from plumbline.plans.history import Store
from plumbline.plans.issue_rows import issue_rows as rows_of
from plumbline.session import shared_folder

from .detect import (C, NUMBER_DUMMY, O, O_NUMBERS, ORDER_COLUMNS, ORDER_TEXTS, S, TEXT_DUMMY,
                     TOTAL_OFF, _fences, _mixed, _pii_sql)
from .inputs import AS_OF, view
from .registry import date_sql, query

LIMIT = "DATE '2026-01-01'"


def _n(predicate: str) -> str:
    return f"(SELECT count(*) FILTER (WHERE {predicate}) FROM {O})"


TOTAL = f"(SELECT count(*) FROM {O})"
SLACK = [f"(SELECT count(*) FILTER (WHERE x < lo OR x > hi) FROM (SELECT CAST({e} AS DOUBLE) AS x FROM {O}), f_{c})"
         for c, e in O_NUMBERS.items()]
PRESENT = [f"(SELECT count({e}) FROM {O})" for e in O_NUMBERS.values()]
FLAGGED = [f"CASE WHEN {s} * 1.0 / {p} > 0.005 THEN {s} ELSE 0 END" for s, p in zip(SLACK, PRESENT)]
EXTREME = [f"(SELECT count(*) FILTER (WHERE {c} < q1 - 3.0 * (q3 - q1) OR {c} > q3 + 3.0 * (q3 - q1)) FROM {O}, f_{c})"
           for c in ("quantity", "unit_price", "total_amount")]


def _repeat(c: str) -> str:
    return (f"(SELECT coalesce(sum(n), 0) FROM (SELECT count(*) AS n FROM {O} WHERE {c} IS NOT NULL "
            f"GROUP BY {c} HAVING count(*) > 1))")


def _over(c: str, predicate: str, share: float) -> str:
    return f"CASE WHEN {_n(predicate)} > {TOTAL} * {share} THEN {_n(predicate)} ELSE 0 END"


ENUMS = " + ".join(_n(f"lower({c}) NOT IN ({', '.join(repr(x) for x in fv.ENUM_VALUES[c])})")
                   for c in ("status", "quality_check"))
ORDER_OFF = _n(f"{date_sql('actual_delivery')} < {date_sql('order_date')}")
MIXED = " + ".join(f"(SELECT {_mixed(c)[6]['count']} FROM {O})"
                   for c in ("order_date", "actual_delivery", "last_updated"))
ENTITY = (f"(SELECT count(*) FROM (SELECT supplier_id FROM {O} WHERE supplier_id IS NOT NULL GROUP BY supplier_id "
          f"HAVING count(*) > 1 AND ({' OR '.join(f'min({c}) <> max({c})' for c in ('supplier_name', 'order_date', 'status', 'last_updated'))})))")
DUMMIES = " + ".join([_n(f"upper({c}) IN ({TEXT_DUMMY})") for c in ORDER_TEXTS]
                     + [_n(f"{c} IN ({NUMBER_DUMMY})") for c in ("quantity", "unit_price", "total_amount")])

SCORES = {
    "completeness": f"100 - 200.0 * ({' + '.join(_n(f'{c} IS NULL') for c in ORDER_COLUMNS)}) / ({TOTAL} * 13)",
    "uniqueness": f"100 - 30.0 * ({_repeat('order_id')} + {_repeat('supplier_id')} + {_repeat('batch_id')}) / {TOTAL}",
    "validity": ("100 - 300.0 * (" + _n(r"NOT regexp_matches(order_id, '^ORD-\d{8}$')") + " + "
                 + _n("quantity < 1") + " + " + _n("starts_with(price_text, '$')") + f") / ({TOTAL} * 4)"),
    "consistency": f"100 - least(100, 200.0 * ({ORDER_OFF} + {_n(TOTAL_OFF)} + {ENUMS}) / {TOTAL})",
    "standardization": (f"100 - least(100, 200.0 * ({MIXED} + "
                        + _n("regexp_matches(supplier_name, '(^|[^A-Za-z])[a-z]|[A-Za-z][A-Z]')") + " + "
                        + _over("status", "status <> trim(status)", 0.01) + f") / ({TOTAL} * 3))"),
    "accuracy": f"100 - 150.0 * ({' + '.join(FLAGGED)} + {_n('quantity < 0')}) / ({' + '.join(PRESENT)})",
    "timeliness": (f"100 - 50.0 * {_n(date_sql('last_updated') + ' < ' + LIMIT + ' - 9')} / {TOTAL} "
                   f"- 100.0 * {_n(date_sql('order_date') + ' > ' + LIMIT)} / {TOTAL}"),
    "profiling": "100",
    "business_rules": f"100 - least(100, 300.0 * ({_n('quantity <= 0')} + {_n(TOTAL_OFF)}) / {TOTAL})",
    "pii_security": f"100 - 10 * (SELECT count(*) FROM ({_pii_sql(O, {}, ORDER_TEXTS)}))",
    "auditability": f"100 - 20.0 * {_n('last_updated IS NULL')} / {TOTAL}",
    "reconciliation": f"100 - 50.0 * {_n(TOTAL_OFF)} / {TOTAL}",
    "survivorship": f"100 - 200.0 * {ENTITY} / {TOTAL}",
    "accessibility": "100", "conformity": "100",
    "constraints": f"100 - 100.0 * {_n('quantity < 0')} / {TOTAL}",
    "enrichment": f"100 - 20.0 * {_over('price_text', 'length(price_text) BETWEEN 1 AND 2', 0.1)} / {TOTAL}",
    "freshness": f"100 - 80.0 * {_n(date_sql('last_updated') + ' < ' + LIMIT + ' - INTERVAL 24 MONTH')} / {TOTAL}",
    "integrity": f"100 - 150.0 * {_n(chr(39).join(['status = ', 'Delivered', ' AND actual_delivery IS NULL']))} / {TOTAL}",
    "lineage": "60",
    "reasonableness": f"100 - 80.0 * ({' + '.join(EXTREME)}) / {TOTAL}",
    "reliability": f"100 - 100.0 * ({DUMMIES}) / {TOTAL}",
}
SCORE_SQL = (f"WITH {_fences(O, O_NUMBERS, 1.5)}, s AS (" + " UNION ALL ".join(
    f"SELECT '{d}' AS dimension, round(greatest(0, {e}), 2) AS score FROM (SELECT 1)"
    for d, e in SCORES.items()) + ")")
BAND = ("CASE WHEN score < 25 THEN 'CRITICAL' WHEN score < 50 THEN 'HIGH' WHEN score < 70 THEN 'MEDIUM' "
        "WHEN score < 85 THEN 'LOW' ELSE 'OK' END")
WEIGHTS = ", ".join(f"('{d}', {w})" for d, w in fv.DIMENSION_WEIGHTS.items())
PLAIN = {"near_duplicates": False}


def _analysis(spark, sf_dir, v=O, domain="supply_chain", **kw):
    return analyze(view(spark, sf_dir, v), AS_OF, domain, "row_key", PLAIN, **kw)


@query("dimension_scores", f"{SCORE_SQL} SELECT dimension, CAST(score AS DOUBLE) AS score, {BAND} AS severity FROM s")
def dimension_scores(spark, sf_dir):
    return _analysis(spark, sf_dir).scores.select("dimension", "score", "severity")


@query("overall_score", f"""{SCORE_SQL}
SELECT round(v, 2) AS overall_score, CAST(22 AS BIGINT) AS dimensions,
 CASE WHEN v >= 90 THEN 'EXCELLENT' WHEN v >= 70 THEN 'GOOD' WHEN v >= 50 THEN 'FAIR' WHEN v >= 25 THEN 'POOR' ELSE 'CRITICAL' END AS label,
 CASE WHEN v >= 85 THEN 'PASS' ELSE 'FAIL' END AS gate
FROM (SELECT sum(score * weight) / sum(weight) AS v FROM s JOIN (VALUES {WEIGHTS}) w(dimension, weight) USING (dimension))""")
def overall_score(spark, sf_dir):
    return _analysis(spark, sf_dir).overall.select("overall_score", "dimensions", "label", "gate")


def scorecard_of_orders(spark, sf_dir):
    """The scorecard of a full check, the neighbour comparison included."""
    return reports.scorecard(analyze(view(spark, sf_dir, O), AS_OF, "supply_chain", "row_key").scores)


query("full_check_orders")(scorecard_of_orders)


@query("full_check_customers")
def full_check_customers(spark, sf_dir):
    return reports.scorecard(analyze(view(spark, sf_dir, C), AS_OF, "finance", "row_key").scores)


@query("full_check_issues")
def full_check_issues(spark, sf_dir):
    return reports.issue_manifest(analyze(view(spark, sf_dir, S), AS_OF, "automotive", "row_key").issues)


WEIGHTED = f"""SELECT run_id, round(sum(score * CAST(weight AS DOUBLE)) / sum(CAST(weight AS DOUBLE)), 6) AS overall_score, CAST(count(*) AS BIGINT) AS dimensions
FROM run_scores JOIN (VALUES {WEIGHTS}) w(dimension, weight) USING (dimension) GROUP BY run_id"""


@query("overall_score_per_run", WEIGHTED)
def overall_score_per_run(spark, sf_dir):
    weights = F.broadcast(spark.createDataFrame(list(fv.DIMENSION_WEIGHTS.items()),
                                                "dimension string, weight double"))
    joined = view(spark, sf_dir, "run_scores").join(weights, "dimension")
    return joined.groupBy("run_id").agg(
        F.round(F.sum(F.col("score") * F.col("weight")) / F.sum("weight"), 6).alias("overall_score"),
        F.count(F.lit(1)).alias("dimensions"))


CHECKED = ["validity", "consistency", "standardization", "business_rules", "integrity"]


@query("repair_and_recheck", f"""
WITH fixed AS (SELECT * REPLACE (CASE WHEN quantity BETWEEN 1 AND 10000000 THEN quantity END AS quantity) FROM {O})
SELECT 'validity' AS dimension,
 round(100 - 300.0 * (SELECT count(*) FILTER (WHERE NOT regexp_matches(order_id, '^ORD-\\d{{8}}$')) + count(*) FILTER (WHERE quantity < 1) + count(*) FILTER (WHERE starts_with(price_text, '$')) FROM {O}) / ((SELECT count(*) FROM {O}) * 4), 2) AS score_before,
 round(100 - 300.0 * (SELECT count(*) FILTER (WHERE NOT regexp_matches(order_id, '^ORD-\\d{{8}}$')) + count(*) FILTER (WHERE quantity < 1) + count(*) FILTER (WHERE starts_with(price_text, '$')) FROM fixed) / ((SELECT count(*) FROM fixed) * 4), 2) AS score_after,
 CAST(3 AS BIGINT) AS issues_before, CAST(2 AS BIGINT) AS issues_after""")
def repair_and_recheck(spark, sf_dir):
    done = remediation.remediate(view(spark, sf_dir, O), ["validity"], Context(AS_OF, "row_key"),
                                 "supply_chain", PLAIN, check=["validity"])
    return done.comparison.select("dimension", "score_before", "score_after", "issues_before", "issues_after")


@query("repair_and_recheck_all")
def repair_and_recheck_all(spark, sf_dir):
    done = remediation.remediate(view(spark, sf_dir, O), ["standardization", "consistency", "validity"],
                                 Context(AS_OF, "row_key"), "supply_chain", PLAIN, check=CHECKED)
    return done.comparison


# Every row of every issue of a check; one row per broken rule and row.
@query("issue_rows", f"""
SELECT row_key, 'validity' AS dimension, 'quantity' AS column_name, 'range_violation' AS issue_type, CAST(CAST(quantity AS DOUBLE) AS VARCHAR) AS value FROM {O} WHERE quantity < 1
UNION ALL SELECT row_key, 'validity', 'order_id', 'pattern_violation', order_id FROM {O} WHERE NOT regexp_matches(order_id, '^ORD-\\d{{8}}$')
UNION ALL SELECT row_key, 'validity', 'price_text', 'type_mismatch', price_text FROM {O} WHERE starts_with(price_text, '$')
UNION ALL SELECT row_key, 'uniqueness', 'order_id', 'duplicate_ids', order_id FROM {O} WHERE order_id IN (SELECT order_id FROM {O} GROUP BY 1 HAVING count(*) > 1)
UNION ALL SELECT row_key, 'uniqueness', 'supplier_id', 'duplicate_ids', supplier_id FROM {O} WHERE supplier_id IN (SELECT supplier_id FROM {O} GROUP BY 1 HAVING count(*) > 1)
UNION ALL SELECT row_key, 'uniqueness', 'batch_id', 'duplicate_ids', batch_id FROM {O}
UNION ALL SELECT row_key, 'integrity', 'actual_delivery', 'integrity_violation', NULL FROM {O} WHERE status = 'Delivered' AND actual_delivery IS NULL""")
def issue_rows(spark, sf_dir):
    return rows_of(_analysis(spark, sf_dir, dimensions=["validity", "uniqueness", "integrity"]))


@query("issue_row_counts", f"""
SELECT dimension, column_name, issue_type, CAST(count(*) AS BIGINT) AS rows, min(row_key) AS first_key FROM (
 SELECT row_key, 'survivorship' AS dimension, 'customer_id' AS column_name, 'survivorship_conflict' AS issue_type FROM {C} WHERE customer_id IN (
  SELECT customer_id FROM {C} GROUP BY 1 HAVING count(*) > 1 AND (min(customer_name) <> max(customer_name) OR min(email) <> max(email) OR min(phone) <> max(phone)))
 UNION ALL SELECT row_key, 'survivorship', 'customer_id', 'missing_golden_record' FROM {C} WHERE customer_id IN (SELECT customer_id FROM {C} GROUP BY 1 HAVING count(*) > 1)
 UNION ALL SELECT row_key, 'conformity', 'email', 'email_format_violation' FROM {C} WHERE NOT regexp_matches(email, '^[^@]+@[^@]+\\.[^@]+$')
 UNION ALL SELECT row_key, 'conformity', 'zip_code', 'zipcode_format_violation' FROM {C} WHERE NOT regexp_matches(zip_code, '^\\d{{5}}(-\\d{{4}})?$')
 UNION ALL SELECT row_key, 'constraints', 'age', 'constraint_violation_age' FROM {C} WHERE age < 0 OR age > 130
) GROUP BY dimension, column_name, issue_type""")
def issue_row_counts(spark, sf_dir):
    """Written with the run and read back from the history."""
    check = _analysis(spark, sf_dir, C, "finance", dimensions=["survivorship", "conformity", "constraints"])
    store = Store(spark, shared_folder(spark))
    run = store.log_run(check, "customers", dt.datetime(2026, 1, 1), 0.0, rows=True)
    return (store.read("issue_rows").where(F.col("run_id") == run).groupBy("dimension", "column_name", "issue_type")
            .agg(F.count(F.lit(1)).alias("rows"), F.min(F.col("row_key").cast("bigint")).alias("first_key")))
