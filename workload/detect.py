"""Detection queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.functions import fixed_values as fv, scoring
from plumbline.operators import (checks, declared, duplicates, entities, outliers, privacy, profile,
                                 rule, table as tables)
from plumbline.operators.similar import SimilarValues
from plumbline.operators.table import Table
from plumbline.plans import catalogue

from .inputs import AS_OF, table, view
from .registry import SEVERITY, date_sql, issue_sql, query, rule_query, shown

AS_OF_SQL = "DATE '2026-01-01'"
O, C, S, L, A = ("dirty_orders", "dirty_customers", "dirty_services", "dirty_claims",
                 "dirty_admissions")
ORDER_COLUMNS = ["order_id", "supplier_id", "supplier_name", "order_date", "actual_delivery",
                 "quantity", "unit_price", "total_amount", "price_text", "status", "quality_check",
                 "last_updated", "batch_id"]
CUSTOMER_COLUMNS = ["customer_id", "customer_name", "email", "phone", "ssn", "zip_code", "age",
                    "gender", "currency", "balance", "fraud_flag", "coverage_amount", "claim_amount",
                    "segment", "note", "abbr"]
ORDER_TEXTS = [c for c in ORDER_COLUMNS if c not in ("quantity", "unit_price", "total_amount")]
CUSTOMER_TEXTS = ["customer_id", "customer_name", "email", "phone", "ssn", "zip_code", "gender",
                  "currency", "segment", "note", "abbr"]


def keyed(spark, sf_dir, name) -> Table:
    return Table(view(spark, sf_dir, name), "row_key")


# --- shared scoring vocabulary --------------------------------------------------------------------

@query("scoring_bands", """
SELECT run_id, overall_score,
 CASE WHEN overall_score < 25 THEN 'CRITICAL' WHEN overall_score < 50 THEN 'HIGH' WHEN overall_score < 70 THEN 'MEDIUM' WHEN overall_score < 85 THEN 'LOW' ELSE 'OK' END AS severity,
 CASE WHEN overall_score >= 90 THEN 'EXCELLENT' WHEN overall_score >= 70 THEN 'GOOD' WHEN overall_score >= 50 THEN 'FAIR' WHEN overall_score >= 25 THEN 'POOR' ELSE 'CRITICAL' END AS label,
 CASE WHEN overall_score >= 90 THEN 'Excellent' WHEN overall_score >= 70 THEN 'Good' WHEN overall_score >= 50 THEN 'Fair' ELSE 'Critical' END AS dashboard_label,
 CASE WHEN overall_score >= 85 THEN 'PASS' ELSE 'FAIL' END AS gate
FROM analysis_runs""")
def scoring_bands(spark, sf_dir):
    s = F.col("overall_score")
    return view(spark, sf_dir, "analysis_runs").select(
        "run_id", s, scoring.severity_of_score(s).alias("severity"),
        scoring.score_label(s).alias("label"), scoring.dashboard_label(s).alias("dashboard_label"),
        scoring.gate(s).alias("gate"))


@query("scoring_rates", f"""
SELECT run_id, rate, {"CASE WHEN rate >= 0.30 THEN 'CRITICAL' WHEN rate >= 0.10 THEN 'HIGH' WHEN rate >= 0.05 THEN 'MEDIUM' ELSE 'LOW' END"} AS severity,
 CASE WHEN rate >= 0.10 THEN 'HIGH' WHEN rate >= 0.05 THEN 'MEDIUM' ELSE 'LOW' END AS risk,
 rate >= 0.10 AS critical
FROM (SELECT run_id, round(col_count * 10.0 / row_count, 6) AS rate FROM analysis_runs)""")
def scoring_rates(spark, sf_dir):
    rate = F.round(scoring.share(F.col("col_count") * 10.0, F.col("row_count")), 6)
    severity = scoring.severity_of_rate(F.col("rate"))
    return view(spark, sf_dir, "analysis_runs").select("run_id", rate.alias("rate")).select(
        "run_id", "rate", severity.alias("severity"), scoring.risk_of_severity(severity).alias("risk"),
        scoring.is_critical(severity).alias("critical"))


@query("dimension_levels", """
SELECT level, CAST(count(*) AS BIGINT) AS scored FROM run_scores JOIN (VALUES
 ('completeness', 'column'), ('validity', 'column'), ('accuracy', 'column'), ('timeliness', 'table'),
 ('timeliness', 'column'), ('integrity', 'table'), ('lineage', 'table')) v(dimension, level)
 USING (dimension) GROUP BY level""")
def dimension_levels(spark, sf_dir):
    levels = F.broadcast(scoring.dimension_levels(spark))
    return (view(spark, sf_dir, "run_scores").join(levels, "dimension").groupBy("level")
            .agg(F.count(F.lit(1)).alias("scored")))


# --- completeness and profile ------------------------------------------------------------------------

for v, columns, texts in ((O, ORDER_COLUMNS, ORDER_TEXTS), (C, CUSTOMER_COLUMNS, CUSTOMER_TEXTS)):
    short = v.removeprefix("dirty_")
    rule_query(f"missing_values_{short}", v, checks.completeness, "missing_values",
               [(c, f"{c} IS NULL", "rate", "severity", "impute_or_flag", "low") for c in columns])
    if v == C:
        rule_query(f"empty_strings_{short}", v, checks.completeness, "empty_strings",
                   [(c, f"trim({c}) = ''", "rate", "LOW", "replace_with_null", "true")
                    for c in texts])


def _unpivot_nulls(v: str, columns: list[str]) -> str:
    return " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, {i} AS pos, count(*) FILTER (WHERE {c} IS NULL) AS n, "
        f"count(*) AS total FROM {v}" for i, c in enumerate(columns))


@query("completeness_summary", f"""
WITH u AS ({_unpivot_nulls(O, ORDER_COLUMNS)})
SELECT CAST(sum(total) AS BIGINT) AS total_cells, CAST(sum(n) AS BIGINT) AS null_cells,
 round(sum(n) * 100.0 / sum(total), 2) AS null_pct,
 (SELECT column_name FROM u ORDER BY n DESC, pos LIMIT 1) AS most_incomplete_column,
 CAST(count(*) FILTER (WHERE n = 0) AS BIGINT) AS complete_columns,
 CAST(count(*) FILTER (WHERE n > 0) AS BIGINT) AS incomplete_columns FROM u""")
def completeness_summary(spark, sf_dir):
    return profile.completeness_summary(keyed(spark, sf_dir, O))


def _profile_sql(v: str, columns: list[str], kinds: dict[str, str]) -> str:
    return " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, '{kinds.get(c, 'string')}' AS dtype, "
        f"CAST(count(*) - count({c}) AS BIGINT) AS null_count, "
        f"round((count(*) - count({c})) * 100.0 / count(*), 2) AS null_pct, "
        f"CAST(count(DISTINCT {c}) AS BIGINT) AS unique_count, "
        f"round(count(DISTINCT {c}) * 100.0 / count(*), 2) AS unique_pct FROM {v}" for c in columns)


@query("column_profile", _profile_sql(C, CUSTOMER_COLUMNS, {
    "age": "int", "fraud_flag": "int", "balance": "double", "coverage_amount": "double",
    "claim_amount": "double"}))
def column_profile(spark, sf_dir):
    return profile.column_profile(keyed(spark, sf_dir, C))


def _numeric_sql(v: str, columns: list[str]) -> str:
    return " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, round(min({c}), 4) AS minimum, round(max({c}), 4) AS maximum, "
        f"round(avg({c}), 4) AS mean, round(quantile_cont({c}, 0.5), 4) AS median, "
        f"round(stddev_samp({c}), 4) AS std, round(quantile_cont({c}, 0.25), 4) AS q25, "
        f"round(quantile_cont({c}, 0.75), 4) AS q75 "
        f"FROM (SELECT CAST({c} AS DOUBLE) AS {c} FROM {v})" for c in columns)


def _rounded(df, skip=("column_name",), places=4):
    return df.select(*[c if c in skip else F.round(c, places).alias(c) for c in df.columns])


@query("numeric_profile", _numeric_sql(O, ["quantity", "unit_price", "total_amount"]))
def numeric_profile(spark, sf_dir):
    return _rounded(profile.numeric_profile(keyed(spark, sf_dir, O))
                    .drop("exact_minimum", "exact_maximum"))


@query("numeric_profile_lineitem", _numeric_sql("lineitem", [
    "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
    "l_discount", "l_tax"]))
def numeric_profile_lineitem(spark, sf_dir):
    return _rounded(profile.numeric_profile(Table(table(spark, sf_dir, "lineitem")))
                    .drop("exact_minimum", "exact_maximum"))


def _text_sql(v: str, columns: list[str]) -> str:
    return " UNION ALL ".join(
        f"(SELECT '{c}' AS column_name, arg_min({c}, (-n, {c})) AS top_value, CAST(max(n) AS BIGINT) AS top_freq, "
        f"CAST(min(length({c})) AS INT) AS min_length, CAST(max(length({c})) AS INT) AS max_length, "
        f"round(sum(length({c}) * n) * 1.0 / sum(n), 2) AS avg_length "
        f"FROM (SELECT {c}, count(*) AS n FROM {v} WHERE {c} IS NOT NULL GROUP BY {c}))"
        for c in columns)


@query("text_profile", _text_sql(O, ORDER_TEXTS))
def text_profile(spark, sf_dir):
    return profile.text_profile(keyed(spark, sf_dir, O))


@query("text_profile_documents", _text_sql("documents", ["text", "lang", "source"]))
def text_profile_documents(spark, sf_dir):
    return profile.text_profile(Table(table(spark, sf_dir, "documents"), "doc_id"))


@query("dataset_profile", f"""
WITH u AS ({_unpivot_nulls(O, ORDER_COLUMNS)})
SELECT CAST(max(total) AS BIGINT) AS total_rows, 13 AS total_columns, 3 AS numeric_columns,
 10 AS string_columns, 0 AS date_columns, round(sum(n) * 100.0 / sum(total), 2) AS null_rate_overall
FROM u""")
def dataset_profile(spark, sf_dir):
    return profile.dataset_profile(keyed(spark, sf_dir, O))


@query("high_cardinality", """
SELECT 'text' AS column_name, 'high_cardinality' AS issue_type,
 CAST(0 AS BIGINT) AS affected_rows, 0.0::DOUBLE AS affected_pct, 'LOW' AS severity,
 'LOW' AS risk_level, 'review_column_design' AS fix_action, false AS auto_fixable
FROM (SELECT round(count(DISTINCT text) * 100.0 / count(*), 2) AS p FROM documents) WHERE p > 90""")
def high_cardinality(spark, sf_dir):
    t = Table(table(spark, sf_dir, "documents"), "doc_id")
    return shown(profile.high_cardinality(t, t.df.count()))


rule_query("constant_columns", S, checks.profile_flags, "constant_column", [
    ("source_system", None, "MEDIUM", "LOW", "review_or_drop_column", "false",
     {"count": "count(*)", "when": "min(source_system) = max(source_system)"}),
    ("make", None, "MEDIUM", "LOW", "review_or_drop_column", "false",
     {"count": "count(*)", "when": "min(make) = max(make)"})])
rule_query("all_null_columns", S, checks.profile_flags, "all_null_column", [
    ("recall_note", None, "HIGH", "MEDIUM", "drop_column", "false",
     {"count": "count(*)", "when": "count(recall_note) = 0"})])

rule_query("amount_reconciliation_gap", L, checks.reconciliation, "amount_reconciliation_gap", [
    (c, None, "HIGH", "HIGH", "require_source_refresh", "false",
     {"count": f"count(*) - count(try_cast({c} AS DOUBLE))",
      "when": f"count(try_cast({c} AS DOUBLE)) < count(*) * 0.5"})
    for c in ("coverage_amount", "premium", "claim_amount", "settlement_amount")])


@query("insufficient_row_count", "WITH regions AS (SELECT * FROM region) " + issue_sql(
    "regions", "insufficient_row_count", [
        ("DATASET", None, "HIGH", "HIGH", "verify_full_data_load", "false",
         {"count": "count(*)", "when": "count(*) < 10"})]).replace("WITH m AS", ", m AS"))
def insufficient_row_count(spark, sf_dir):
    t = Table(table(spark, sf_dir, "region"), "r_regionkey")
    return shown(rule.measure(t, checks.reconciliation(t)))


def _off(result: str, expected: str) -> str:
    return f"abs({result} - {expected}) > abs({expected}) * 0.01 + 0.01"


TOTAL_OFF = _off("total_amount", "(quantity * unit_price)")
COST_OFF = _off("cost", "(parts_cost + labor_cost)")
rule_query("enrichment_accuracy_product", O, checks.reconciliation, "enrichment_accuracy", [
    ("total_amount", TOTAL_OFF, "HIGH", "HIGH", "recalculate_product", "true")])
rule_query("enrichment_accuracy_sum", S, checks.reconciliation, "enrichment_accuracy", [
    ("cost", COST_OFF, "HIGH", "HIGH", "recalculate_sum", "true")])

# --- uniqueness and survivorship ------------------------------------------------------------------------


@query("exact_duplicates", """
SELECT CAST(sum(n) AS BIGINT) AS total_rows, CAST(sum(n - 1) AS BIGINT) AS duplicate_rows,
 CAST(count(*) AS BIGINT) AS unique_rows, round(count(*) * 100.0 / sum(n), 2) AS uniqueness_rate
FROM (SELECT count(*) AS n FROM dirty_events GROUP BY event_id, user_id, event_type, value)""")
def exact_duplicates(spark, sf_dir):
    return duplicates.repeated_rows(view(spark, sf_dir, "dirty_events"))


@query("exact_duplicates_documents", """
SELECT CAST(sum(n) AS BIGINT) AS total_rows, CAST(sum(n - 1) AS BIGINT) AS duplicate_rows,
 CAST(count(*) AS BIGINT) AS unique_rows, round(count(*) * 100.0 / sum(n), 2) AS uniqueness_rate
FROM (SELECT count(*) AS n FROM documents GROUP BY text, lang)""")
def exact_duplicates_documents(spark, sf_dir):
    return duplicates.repeated_rows(table(spark, sf_dir, "documents"), ["text", "lang"])


@query("duplicate_ids", """
SELECT column_name, CAST(sum(n) AS BIGINT) AS affected_rows, CAST(count(*) AS BIGINT) AS repeated_values
FROM (SELECT 'order_id' AS column_name, order_id AS v, count(*) AS n FROM dirty_orders WHERE order_id IS NOT NULL GROUP BY order_id
 UNION ALL SELECT 'supplier_id', supplier_id, count(*) FROM dirty_orders WHERE supplier_id IS NOT NULL GROUP BY supplier_id
 UNION ALL SELECT 'batch_id', batch_id, count(*) FROM dirty_orders GROUP BY batch_id)
WHERE n > 1 GROUP BY column_name""")
def duplicate_ids(spark, sf_dir):
    return duplicates.repeated_ids(keyed(spark, sf_dir, O))


@query("duplicate_id_top_values", """
SELECT column_name, string_agg(v, ',' ORDER BY n DESC, v) AS top_values FROM (
 SELECT *, row_number() OVER (PARTITION BY column_name ORDER BY n DESC, v) AS r FROM (
  SELECT 'order_id' AS column_name, order_id AS v, count(*) AS n FROM dirty_orders GROUP BY order_id
  UNION ALL SELECT 'supplier_id', supplier_id, count(*) FROM dirty_orders WHERE supplier_id IS NOT NULL GROUP BY supplier_id)
 WHERE n > 1) WHERE r <= 5 GROUP BY column_name""")
def duplicate_id_top_values(spark, sf_dir):
    t = keyed(spark, sf_dir, O)
    return duplicates.listed(duplicates.top_counts(t, ["order_id", "supplier_id"], 5, least=2)).select(
        "column_name", F.concat_ws(",", "sample_values").alias("top_values"))


@query("duplicate_id_rows", """
SELECT row_key, order_id AS value FROM dirty_orders WHERE order_id IN (
 SELECT order_id FROM dirty_orders GROUP BY order_id HAVING count(*) > 1)""")
def duplicate_id_rows(spark, sf_dir):
    return duplicates.repeated_id_rows(keyed(spark, sf_dir, O), "order_id")


@query("duplicate_order_lines", """
SELECT CAST(sum(n) AS BIGINT) AS affected_rows, CAST(count(*) AS BIGINT) AS repeated_values
FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)""")
def duplicate_order_lines(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("line_id"))
    return duplicates.repeated_ids(Table(lines)).select("affected_rows", "repeated_values")


# The longest common subsequence by bit sets, one fold over the characters of the second value.
NEAR = """
WITH n AS (SELECT row_key AS k, customer_name AS v, row_number() OVER (ORDER BY row_key) AS n FROM dirty_customers WHERE customer_name IS NOT NULL),
 p AS (SELECT a.k AS left_key, b.k AS right_key, a.v AS left_value, b.v AS right_value FROM n a JOIN n b ON b.n > a.n AND b.n <= a.n + 19 WHERE a.v <> b.v),
 m AS (SELECT *, CAST(1 AS HUGEINT) << length(left_value) AS top,
  list_transform(string_split(right_value, ''), lambda ch: list_sum(list_transform(range(1, length(left_value) + 1),
   lambda i: CASE WHEN left_value[i] = ch THEN (CAST(1 AS BIGINT) << CAST(i - 1 AS INT)) ELSE 0 END))::BIGINT) AS masks FROM p),
 s AS (SELECT *, list_reduce(list_prepend((top - 1)::BIGINT, masks),
  lambda r, x: ((r + (r & x)) | (r - (r & x))) & (top - 1)::BIGINT) AS rest FROM m)
SELECT left_key, right_key, left_value, right_value, round(ratio, 4) AS ratio FROM (
 SELECT *, 200.0 * (length(left_value) - bit_count(rest)) / (length(left_value) + length(right_value)) AS ratio FROM s)
WHERE ratio >= 90 AND ratio < 100"""


@query("near_duplicates_window", NEAR)
def near_duplicates_window(spark, sf_dir):
    return duplicates.similar_neighbours(keyed(spark, sf_dir, C), "customer_name").withColumn(
        "ratio", F.round("ratio", 4))


# The same comparison for all pairs of different values; a value's masks are made once.
ALL_NEAR = """
WITH n AS (SELECT customer_name AS v, min(row_key) AS k, CAST(count(*) AS BIGINT) AS rows FROM dirty_customers WHERE length(customer_name) > 0 GROUP BY customer_name),
 c AS (SELECT v, ch, sum(CAST(1 AS BIGINT) << CAST(i - 1 AS INT))::BIGINT AS mask
  FROM (SELECT v, unnest(string_split(v, '')) AS ch, generate_subscripts(string_split(v, ''), 1) AS i FROM n) GROUP BY v, ch),
 f AS (SELECT n.*, masks FROM n JOIN (SELECT v, map_from_entries(list((ch, mask))) AS masks FROM c GROUP BY v) USING (v)),
 p AS (SELECT a.k AS left_key, b.k AS right_key, a.v AS left_value, b.v AS right_value, a.rows AS left_rows, b.rows AS right_rows, a.masks,
  (CAST(1 AS BIGINT) << CAST(length(a.v) AS INT)) - 1 AS top
  FROM f a JOIN f b ON a.k < b.k AND 200 * least(length(a.v), length(b.v)) >= 90 * (length(a.v) + length(b.v))
  WHERE levenshtein(a.v, b.v) <= 0.1 * (length(a.v) + length(b.v)) + 1e-9),
 s AS (SELECT *, list_reduce(list_prepend(top, list_transform(string_split(right_value, ''), lambda ch: coalesce(masks[ch], 0))),
  lambda r, x: ((r + (r & x)) | (r - (r & x))) & top) AS rest FROM p),
 near AS (SELECT left_key, right_key, left_value, right_value, left_rows, right_rows,
  200.0 * (length(left_value) - bit_count(rest)) / (length(left_value) + length(right_value)) AS ratio FROM s)"""


@query("near_duplicates", ALL_NEAR + """
SELECT left_key, right_key, left_value, right_value, left_rows, right_rows, round(ratio, 4) AS ratio FROM near WHERE ratio >= 90 AND ratio < 100""")
def near_duplicates(spark, sf_dir):
    return SimilarValues(keyed(spark, sf_dir, C), "customer_name").links().withColumn("ratio", F.round("ratio", 4))


@query("near_duplicate_members", ALL_NEAR + """,
 ends AS (SELECT left_value AS v, right_rows AS r FROM near WHERE ratio >= 90 AND ratio < 100
  UNION ALL SELECT right_value, left_rows FROM near WHERE ratio >= 90 AND ratio < 100),
 counts AS (SELECT v, count(*) AS links, sum(r) AS near_rows FROM ends GROUP BY v)
SELECT row_key, n.k AS class_key, n.rows AS class_rows, CAST(coalesce(links, 0) AS BIGINT) AS links, CAST(coalesce(near_rows, 0) AS BIGINT) AS near_rows
FROM dirty_customers JOIN n ON customer_name = n.v LEFT JOIN counts ON counts.v = n.v""")
def near_duplicate_members(spark, sf_dir):
    return SimilarValues(keyed(spark, sf_dir, C), "customer_name").members()


@query("near_duplicates_documents")
def near_duplicates_documents(spark, sf_dir):
    t = Table(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    return SimilarValues(t, "text").members()


@query("uniqueness_issues", f"""
WITH n AS ({' UNION ALL '.join(f"SELECT '{c}' AS column_name, {c} AS v, count(*) AS n FROM {O} WHERE {c} IS NOT NULL GROUP BY {c} HAVING count(*) > 1" for c in ('order_id', 'supplier_id', 'batch_id'))}),
 s AS (SELECT column_name, CAST(sum(n) AS BIGINT) AS affected_rows, sum(n) * 1.0 / (SELECT count(*) FROM {O}) AS affected_pct FROM n GROUP BY column_name)
SELECT column_name, 'duplicate_ids' AS issue_type, affected_rows, round(affected_pct, 6) AS affected_pct, {SEVERITY} AS severity,
 'HIGH' AS risk_level, 'deduplicate_ids' AS fix_action, false AS auto_fixable FROM s""")
def uniqueness_issues(spark, sf_dir):
    t = keyed(spark, sf_dir, O)
    return shown(duplicates.uniqueness_issues(t, t.df.count()))


COMPARED = ["customer_name", "email", "phone"]


@query("entity_keys", """
SELECT key_column, CAST(count(v) AS BIGINT) AS rows_with_key FROM (
 SELECT 'customer_id' AS key_column, customer_id AS v FROM dirty_claims) GROUP BY key_column""")
def entity_keys(spark, sf_dir):
    t = keyed(spark, sf_dir, L)
    keys = entities.entity_keys(t)
    return t.df.agg(*[F.count(c).alias(c) for c in keys]).unpivot(
        [], keys, "key_column", "rows_with_key")


@query("survivorship_facts", f"""
WITH e AS (SELECT customer_id, count(*) AS n, {' OR '.join(f'min({c}) <> max({c})' for c in COMPARED)} AS conflict
 FROM {C} GROUP BY customer_id HAVING count(*) > 1)
SELECT 'customer_id' AS key_column, CAST(count(*) AS BIGINT) AS repeated_entities,
 CAST(sum(n) AS BIGINT) AS repeated_rows, CAST(count(*) FILTER (WHERE conflict) AS BIGINT) AS conflicting_entities
FROM e""")
def survivorship_facts(spark, sf_dir):
    return entities.survivorship_facts(keyed(spark, sf_dir, C), "customer_id").drop("sample")


@query("survivorship_conflicts", f"""
SELECT customer_id AS entity, CASE {' '.join(f"WHEN min({c}) <> max({c}) THEN '{c}'" for c in COMPARED)} END AS conflict_field,
 CASE {' '.join(f"WHEN min({c}) <> max({c}) THEN min({c})" for c in COMPARED)} END AS smallest,
 CASE {' '.join(f"WHEN min({c}) <> max({c}) THEN max({c})" for c in COMPARED)} END AS largest,
 CAST(count(*) AS BIGINT) AS rows
FROM {C} GROUP BY customer_id HAVING count(*) > 1 AND ({' OR '.join(f'min({c}) <> max({c})' for c in COMPARED)})""")
def survivorship_conflicts(spark, sf_dir):
    return entities.conflicts(keyed(spark, sf_dir, C), "customer_id")


@query("missing_golden_record", f"""
WITH e AS (SELECT count(*) AS n FROM {O} WHERE supplier_id IS NOT NULL GROUP BY supplier_id HAVING count(*) > 1),
 t AS (SELECT count(*) AS total FROM {O})
SELECT 'supplier_id' AS column_name, 'missing_golden_record' AS issue_type, CAST(sum(n) AS BIGINT) AS affected_rows,
 round(sum(n) * 1.0 / any_value(total), 6) AS affected_pct, 'MEDIUM' AS severity, 'HIGH' AS risk_level,
 'designate_golden_record' AS fix_action, false AS auto_fixable FROM e, t""")
def missing_golden_record(spark, sf_dir):
    t = keyed(spark, sf_dir, O)
    return shown(entities.survivorship_issues(t, t.df.count())).where(
        "issue_type = 'missing_golden_record'")


# --- validity, conformity, constraints, business rules, integrity -----------------------------------------

def validity(t):
    return checks.validity(t, AS_OF)


def _pattern(c, p):
    return f"NOT regexp_matches(trim({c}), '{p}')"


FLAG_FORMAT = ("rate", "severity", "flag_or_correct_format", "false")
rule_query("pattern_violation_customers", C, validity, "pattern_violation", [
    ("email", _pattern("email", r"^[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}$"), *FLAG_FORMAT),
    ("phone", _pattern("phone", r"^[\+\d\s\(\)\-\.]{7,20}$"), *FLAG_FORMAT),
    ("ssn", _pattern("ssn", r"^\d{3}-\d{2}-\d{4}$"), *FLAG_FORMAT),
    ("zip_code", _pattern("zip_code", r"^\d{5}(-\d{4})?$"), *FLAG_FORMAT)])
rule_query("pattern_violation_orders", O, validity, "pattern_violation", [
    ("order_id", _pattern("order_id", r"^ORD-\d{8}$"), *FLAG_FORMAT)])
rule_query("pattern_violation_services", S, validity, "pattern_violation", [
    ("vehicle_id", _pattern("vehicle_id", r"^VEH-\d{6}$"), *FLAG_FORMAT),
    ("vin", _pattern("vin", "^[A-HJ-NPR-Z0-9]{17}$"), *FLAG_FORMAT)])
rule_query("pattern_violation_admissions", A, validity, "pattern_violation", [
    ("patient_id", _pattern("patient_id", r"^PAT-\d{6}$"), *FLAG_FORMAT),
    ("diagnosis_code", _pattern("diagnosis_code", r"^[A-Z]\d{2}\.?\d{0,4}[A-Z0-9]?$"), *FLAG_FORMAT)])
CLAMP = ("rate", "severity", "clamp_or_flag", "false")
rule_query("range_violation_orders", O, validity, "range_violation", [
    (c, f"{c} < {lo} OR {c} > {hi}", *CLAMP) for c, lo, hi in
    (("quantity", 1, 10000000), ("unit_price", 0, 1e6), ("total_amount", 0, 1e9))])
rule_query("range_violation_services", S, validity, "range_violation", [
    (c, f"{c} < {lo} OR {c} > {hi}", *CLAMP) for c, lo, hi in
    (("year", 1900, 2026), ("mileage", 0, 2000000), ("parts_cost", 0, 1e6), ("labor_cost", 0, 1e6),
     ("cost", 0, 1e6))])
rule_query("range_violation_claims", L, validity, "range_violation", [
    (c, f"{c} < {lo} OR {c} > {hi}", *CLAMP) for c, lo, hi in
    (("coverage_amount", 0, 1e9), ("premium", 0, 1e7), ("deductible", 0, 1e6),
     ("claim_amount", 0, 1e9), ("settlement_amount", 0, 1e9))])
rule_query("type_mismatch", O, validity, "type_mismatch", [
    ("price_text", "starts_with(price_text, '$')", "HIGH", "MEDIUM", "strip_and_cast_numeric", "true")])
rule_query("email_format_violation", C, checks.conformity, "email_format_violation", [
    ("email", r"NOT regexp_matches(email, '^[^@]+@[^@]+\.[^@]+$')", "rate", "severity",
     "nullify_invalid_emails", "true")])
rule_query("zipcode_format_violation", L, checks.conformity, "zipcode_format_violation", [
    ("zip_code", r"NOT regexp_matches(zip_code, '^\d{5}(?:-\d{4})?$')", "rate", "severity",
     "clean_zipcodes", "true")])
rule_query("constraint_violation_age", A, checks.constraints, "constraint_violation_age", [
    ("age", "age < 0 OR age > 130", "rate", "severity", "clip_age_constraint", "true")])
NEGATIVE = ("rate", "severity", "absolute_value", "true")
rule_query("constraint_negative_orders", O, checks.constraints, "constraint_violation_negative_value", [
    (c, f"try_cast({c} AS DOUBLE) < 0", *NEGATIVE)
    for c in ("quantity", "unit_price", "total_amount", "price_text")])
rule_query("constraint_negative_services", S, checks.constraints, "constraint_violation_negative_value", [
    (c, f"{c} < 0", *NEGATIVE) for c in ("mileage", "parts_cost", "labor_cost", "cost")])


def business_query(name: str, v: str, rule_name: str, specs: list[tuple]) -> None:
    def run(spark, sf_dir):
        t = keyed(spark, sf_dir, v)
        return shown(rule.measure(t, [r for r in checks.business(t) if r.text == f"[{rule_name}]"]))
    query(name, issue_sql(v, "business_rule_violation", specs))(run)


business_query("non_negative_amount", A, "non_negative_amount", [
    ("bill_amount", "bill_amount < 0", "HIGH", "HIGH", "set_to_absolute_value", "false")])
business_query("positive_quantity", O, "positive_quantity", [
    ("quantity", "quantity <= 0", "HIGH", "HIGH", "flag_or_set_to_one", "false")])
business_query("valid_fraud_flag", C, "valid_fraud_flag", [
    ("fraud_flag", "fraud_flag NOT IN (0, 1)", "MEDIUM", "MEDIUM", "coerce_to_binary", "false")])
business_query("claim_not_exceed_coverage", L, "claim_not_exceed_coverage", [
    ("claim_amount vs coverage_amount", "claim_amount > coverage_amount", "HIGH", "HIGH",
     "flag_for_review", "false")])
business_query("deductible_less_than_coverage", L, "deductible_less_than_coverage", [
    ("deductible vs coverage_amount", "deductible >= coverage_amount", "MEDIUM", "MEDIUM",
     "flag_for_review", "false")])
rule_query("calculation_rule_product", O, checks.business, "calculation_rule_violation", [
    ("total_amount", TOTAL_OFF, "HIGH", "HIGH", "recalculate_product", "true")])
rule_query("calculation_rule_sum", S, checks.business, "calculation_rule_violation", [
    ("cost", COST_OFF, "HIGH", "HIGH", "recalculate_sum", "true")])
REVIEW = ("HIGH", "HIGH", "flag_for_review", "false")
rule_query("integrity_delivered", O, checks.integrity, "integrity_violation", [
    ("actual_delivery", "status = 'Delivered' AND actual_delivery IS NULL", *REVIEW)])
rule_query("integrity_discharged", A, checks.integrity, "integrity_violation", [
    ("discharge_date", "status = 'Discharged' AND discharge_date IS NULL", *REVIEW)])
rule_query("integrity_settled", L, checks.integrity, "integrity_violation", [
    ("settlement_amount", "claim_status = 'Settled' AND settlement_amount IS NULL", *REVIEW)])

# --- consistency and standardization ------------------------------------------------------------------------


@query("date_parsing", f"""
SELECT row_key, service_date, {date_sql('service_date')} AS parsed FROM {S}""")
def date_parsing(spark, sf_dir):
    t = keyed(spark, sf_dir, S)
    parsed = t.date("service_date")
    return t.frame().select("row_key", "service_date", parsed.alias("parsed"))


SWAP = ("rate", "HIGH", "swap_dates_or_nullify", "false")


def _before(start, end):
    return f"{date_sql(end)} < {date_sql(start)}"


rule_query("date_order_orders", O, checks.consistency, "date_order_violation", [
    ("order_date↔actual_delivery", _before("order_date", "actual_delivery"), *SWAP)])
rule_query("date_order_claims", L, checks.consistency, "date_order_violation", [
    ("policy_start↔policy_end", _before("policy_start", "policy_end"), *SWAP)])
rule_query("date_order_admissions", A, checks.consistency, "date_order_violation", [
    ("admission_date↔discharge_date", _before("admission_date", "discharge_date"), *SWAP)])
rule_query("calculation_inconsistency", O, checks.consistency, "calculation_inconsistency", [
    ("total_amount", TOTAL_OFF, "rate", "HIGH", "recalculate_product", "true")])
rule_query("calculation_inconsistency_sum", S, checks.consistency, "calculation_inconsistency", [
    ("cost", COST_OFF, "rate", "HIGH", "recalculate_sum", "true")])


def _enum(c):
    values = ", ".join(f"'{x}'" for x in fv.ENUM_VALUES[c])
    return (c, f"lower({c}) NOT IN ({values})", "rate", "LOW", "standardize_enum_values", "true")


for v, columns in ((O, ["status", "quality_check"]), (C, ["gender", "currency"]),
                   (S, ["engine_type", "warranty_status"]), (L, ["policy_type", "claim_status"]),
                   (A, ["status", "payment_status"])):
    rule_query(f"enum_inconsistency_{v.removeprefix('dirty_')}", v, checks.consistency,
               "enum_inconsistency", [_enum(c) for c in columns])
rule_query("referential_interval", L, checks.consistency, "referential_integrity", [
    ("claim_date", f"{date_sql('claim_date')} < {date_sql('policy_start')} OR "
     f"{date_sql('claim_date')} > {date_sql('policy_end')}", *REVIEW)])


def _mixed(c):
    counts = [f"count(*) FILTER (WHERE regexp_matches({c}, '{p}'))" for _, p in fv.DATE_SHAPES]
    return (c, None, "rate", "MEDIUM", "standardize_date_format", "true",
            {"count": f"({' + '.join(counts)} - greatest({', '.join(counts)}))"})


for v, columns in ((O, ["order_date", "actual_delivery", "last_updated"]), (S, ["service_date"]),
                   (A, ["admission_date", "discharge_date", "date_of_birth"])):
    rule_query(f"mixed_date_formats_{v.removeprefix('dirty_')}", v, checks.standardization,
               "mixed_date_formats", [_mixed(c) for c in columns])


def _case_rule(kind):
    return lambda t: [r for r in checks.standardization(t) if r.fix == f"apply_{kind}_case"]


NOT_TITLE = "regexp_matches(trim({0}), '(^|[^A-Za-z])[a-z]|[A-Za-z][A-Z]')"
rule_query("title_case_orders", O, _case_rule("title"), "case_inconsistency", [
    ("supplier_name", NOT_TITLE.format("supplier_name"), "rate", "LOW", "apply_title_case", "true")])
rule_query("title_case_services", S, _case_rule("title"), "case_inconsistency", [
    ("technician", NOT_TITLE.format("technician"), "rate", "LOW", "apply_title_case", "true")])
rule_query("title_case_customers", C, _case_rule("title"), "case_inconsistency", [
    ("customer_name", NOT_TITLE.format("customer_name"), "rate", "LOW", "apply_title_case", "true")])
rule_query("upper_case_customers", C, _case_rule("upper"), "case_inconsistency", [
    ("currency", "currency <> upper(currency)", "rate", "LOW", "apply_upper_case", "true")])
rule_query("upper_case_claims", L, _case_rule("upper"), "case_inconsistency", [
    ("state", "state <> upper(state)", "rate", "LOW", "apply_upper_case", "true")])
DIGITS = r"length(regexp_replace(phone, '[^\d]', '', 'g'))"
rule_query("phone_format_violation", C, checks.standardization, "phone_format_violation", [
    ("phone", f"{DIGITS} < 10 OR {DIGITS} > 15", "rate", "MEDIUM", "standardize_phone_format", "false")])
rule_query("whitespace_issue_orders", O, checks.standardization, "whitespace_issue", [
    (c, f"{c} <> trim({c})", "LOW", "LOW", "strip_whitespace", "true", {"over": 0.01})
    for c in ORDER_TEXTS])
rule_query("whitespace_issue_customers", C, checks.standardization, "whitespace_issue", [
    (c, f"{c} <> trim({c})", "LOW", "LOW", "strip_whitespace", "true", {"over": 0.01})
    for c in CUSTOMER_TEXTS])

# --- accuracy, reasonableness, reliability, accessibility, enrichment -----------------------------------------


def _fences(v, expressions: dict[str, str], k: float) -> str:
    return ", ".join(
        f"f_{c} AS (SELECT quantile_cont(x, 0.25) - {k} * (quantile_cont(x, 0.75) - quantile_cont(x, 0.25)) AS lo, "
        f"quantile_cont(x, 0.75) + {k} * (quantile_cont(x, 0.75) - quantile_cont(x, 0.25)) AS hi, "
        f"quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.75) AS q3, avg(x) AS mean, stddev_pop(x) AS sd, "
        f"count(x) AS n FROM (SELECT CAST({e} AS DOUBLE) AS x FROM {v}))" for c, e in expressions.items())


O_NUMBERS = {"quantity": "quantity", "unit_price": "unit_price", "total_amount": "total_amount",
             "price_text": r"try_cast(regexp_replace(price_text, '[,$]', '', 'g') AS DOUBLE)"}


@query("numeric_text_adoption", f"""
SELECT 'price_text' AS column_name, CAST(count({O_NUMBERS['price_text']}) AS BIGINT) AS readable
FROM {O} HAVING count({O_NUMBERS['price_text']}) > count(*) * 0.5""")
def numeric_text_adoption(spark, sf_dir):
    t = keyed(spark, sf_dir, O)
    adopted = {c: e for c, e in outliers.numeric_views(t).items() if t.is_text(c)}
    return t.frame().agg(*[F.count(e).alias(c) for c, e in adopted.items()]).unpivot(
        [], list(adopted), "column_name", "readable")


def _outlier_sql(v, expressions, k, issue_type, severity, risk, fix, auto, base, over):
    parts = []
    for c, e in expressions.items():
        sev = "CASE WHEN p > 0.05 THEN 'HIGH' ELSE 'MEDIUM' END" if severity == "extreme" else (
            "CASE WHEN p >= 0.30 THEN 'CRITICAL' WHEN p >= 0.10 THEN 'HIGH' WHEN p >= 0.05 THEN 'MEDIUM' ELSE 'LOW' END")
        parts.append(
            f"SELECT '{c}' AS column_name, '{issue_type}' AS issue_type, affected_rows, round(p, 6) AS affected_pct, "
            f"{sev} AS severity, {risk if risk.startswith('CASE') else repr(risk)} AS risk_level, "
            f"'{fix}' AS fix_action, {auto} AS auto_fixable FROM (SELECT affected_rows, affected_rows * 1.0 / {base} AS p FROM ("
            f"SELECT CAST(count(*) FILTER (WHERE x < lo OR x > hi) AS BIGINT) AS affected_rows, count(x) AS present, count(*) AS total "
            f"FROM (SELECT CAST({e} AS DOUBLE) AS x FROM {v}), f_{c} WHERE q1 <> q3 AND n >= 10)) WHERE p > {over}")
    return f"WITH {_fences(v, expressions, k)} " + " UNION ALL ".join(parts)


@query("statistical_outlier", _outlier_sql(O, O_NUMBERS, 1.5, "statistical_outlier", "rate", "MEDIUM",
                                           "cap_winsorize_outliers", "false", "present", 0.005))
def statistical_outlier(spark, sf_dir):
    t = keyed(spark, sf_dir, O)
    views = outliers.numeric_views(t)
    return shown(rule.measure(t, outliers.outlier_rules(t, views, outliers.fences(t, views, 1.5))))


L_NUMBERS = {c: c for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber")}


@query("outlier_report_lineitem", f"WITH {_fences('lineitem', L_NUMBERS, 1.5)} " + " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, round(any_value(q1), 4) AS q1, round(any_value(q3), 4) AS q3, "
    f"round(any_value(lo), 4) AS lower_bound, round(any_value(hi), 4) AS upper_bound, "
    f"CAST(count(*) FILTER (WHERE {c} < lo OR {c} > hi) AS BIGINT) AS outliers, "
    f"CAST(count(*) FILTER (WHERE abs(({c} - mean) / sd) > 3) AS BIGINT) AS z_outliers, "
    f"CAST(count({c}) AS BIGINT) AS values FROM lineitem, f_{c}" for c in L_NUMBERS))
def outlier_report_lineitem(spark, sf_dir):
    t = Table(table(spark, sf_dir, "lineitem").select(*L_NUMBERS))
    return _rounded(outliers.outlier_report(t), ("column_name", "outliers", "z_outliers", "values"))


def accuracy(t):
    return checks.accuracy(t, AS_OF)


IMPOSSIBLE = ("HIGH", "HIGH", "flag_or_correct", "false")
rule_query("impossible_values_services", S, accuracy, "impossible_value", [
    ("mileage", "mileage < 0", *IMPOSSIBLE), ("year", "year < 1900", *IMPOSSIBLE),
    ("year", "year > 2026", *IMPOSSIBLE)])
rule_query("impossible_values_customers", C, accuracy, "impossible_value", [
    ("age", "age < 0", *IMPOSSIBLE), ("age", "age > 130", *IMPOSSIBLE),
    ("fraud_flag", "fraud_flag NOT IN (0, 1)", *IMPOSSIBLE)])
rule_query("impossible_values_orders", O, accuracy, "impossible_value", [
    ("quantity", "quantity < 0", *IMPOSSIBLE)])


@query("extreme_outliers", _outlier_sql(
    O, {c: c for c in ("quantity", "unit_price", "total_amount")}, 3.0, "statistical_outliers",
    "extreme", "CASE WHEN p > 0.05 THEN 'HIGH' ELSE 'MEDIUM' END", "cap_outliers_iqr", "true",
    "total", 0))
def extreme_outliers(spark, sf_dir):
    t = keyed(spark, sf_dir, O)
    views = {c: t.number(c) for c in outliers.extreme_columns(t)}
    return shown(rule.measure(t, outliers.extreme_rules(t, outliers.fences(t, views, 3.0))))


TEXT_DUMMY = ", ".join(f"'{x}'" for x in fv.PLACEHOLDER_TEXT)
NUMBER_DUMMY = ", ".join(str(x) for x in fv.PLACEHOLDER_NUMBERS)
DUMMY = ("rate", "severity", "nullify_dummy_values", "true")
rule_query("placeholder_values", C, checks.reliability, "unreliable_default_values", [
    (c, f"upper({c}) IN ({TEXT_DUMMY})", *DUMMY) if c in CUSTOMER_TEXTS else
    (c, f"{c} IN ({NUMBER_DUMMY})", *DUMMY) for c in CUSTOMER_COLUMNS])
ASCII = ("rate", "severity", "strip_non_ascii", "true")
rule_query("unreadable_chars_customers", C, checks.accessibility, "unreadable_chars", [
    (c, rf"regexp_matches({c}, '[^\x00-\x7F]')", *ASCII) for c in CUSTOMER_TEXTS])


@query("unreadable_chars_documents", issue_sql("documents", "unreadable_chars", [
    (c, rf"regexp_matches({c}, '[^\x00-\x7F]')", *ASCII) for c in ("text", "lang", "source")]))
def unreadable_chars_documents(spark, sf_dir):
    t = Table(table(spark, sf_dir, "documents"), "doc_id")
    return shown(rule.measure(t, checks.accessibility(t)))


rule_query("suboptimal_enrichment", C, checks.enrichment, "suboptimal_enrichment", [
    (c, f"length({c}) BETWEEN 1 AND 2", "LOW", "LOW", "flag_for_enrichment", "false", {"over": 0.10})
    for c in ("customer_name", "email", "phone", "ssn", "segment", "note", "abbr")])

# --- time, lineage, audit ------------------------------------------------------------------------------------


def timely(domain, config=None):
    return lambda t: checks.timeliness(t, AS_OF, checks.freshness_days(domain, config or {}))


rule_query("stale_records_critical", O, timely("supply_chain"), "stale_records_critical", [
    ("last_updated", f"{date_sql('last_updated')} < {AS_OF_SQL} - 730", "rate", "HIGH",
     "flag_for_archival_or_refresh", "false")])


@query("stale_records", "WITH recent AS (SELECT CASE WHEN row_key % 6 = 0 THEN '2025-05-01' ELSE updated_at END AS updated_at FROM dirty_services), "
       + issue_sql("recent", "stale_records", [
           ("updated_at", f"{date_sql('updated_at')} < {AS_OF_SQL} - 90", "rate", "MEDIUM",
            "flag_for_refresh", "false",
            {"when": f"count(*) FILTER (WHERE {date_sql('updated_at')} < {AS_OF_SQL} - 730) = 0"})])[5:])
def stale_records(spark, sf_dir):
    df = view(spark, sf_dir, S).selectExpr(
        "row_key", "CASE WHEN row_key % 6 = 0 THEN '2025-05-01' ELSE updated_at END AS updated_at")
    t = Table(df, "row_key")
    return shown(rule.measure(t, timely("automotive")(t)))


FUTURE = ("rate", "HIGH", "flag_or_nullify_future_dates", "false")
for v, c, d in ((O, "order_date", "supply_chain"), (S, "service_date", "automotive"),
                (A, "admission_date", "healthcare")):
    rule_query(f"future_dates_{v.removeprefix('dirty_')}", v, timely(d), "future_dated_record",
               [(c, f"{date_sql(c)} > {AS_OF_SQL}", *FUTURE)])
    if v != A:
        rule_query(f"ancient_dates_{v.removeprefix('dirty_')}", v, timely(d), "ancient_dates",
                   [(c, f"{date_sql(c)} < {AS_OF_SQL} - 3650", "LOW", "LOW", "flag_for_review", "false",
                 {"over": 0.02})])
ARCHIVE = ("rate", "severity", "flag_for_archive", "false")
rule_query("stale_data_orders", O, lambda t: checks.freshness(t, AS_OF), "stale_data", [
    ("last_updated", f"{date_sql('last_updated')} < {AS_OF_SQL} - INTERVAL 24 MONTH", *ARCHIVE)])
rule_query("stale_data_services", S, lambda t: checks.freshness(t, AS_OF), "stale_data", [
    ("updated_at", f"{date_sql('updated_at')} < {AS_OF_SQL} - INTERVAL 24 MONTH", *ARCHIVE)])


@query("freshness_agreement", """
SELECT domain, CAST(count(*) AS BIGINT) AS runs,
 CASE domain WHEN 'healthcare' THEN 7 WHEN 'finance' THEN 1 WHEN 'insurance' THEN 14 WHEN 'supply_chain' THEN 3 ELSE 30 END AS sla_days
FROM analysis_runs GROUP BY domain""")
def freshness_agreement(spark, sf_dir):
    runs = view(spark, sf_dir, "analysis_runs")
    names = ["healthcare", "finance", "insurance", "supply_chain", "automotive"]
    sla = spark.createDataFrame([(d, checks.freshness_days(d, {})) for d in names],
                                "domain string, sla_days int")
    return (runs.groupBy("domain").agg(F.count(F.lit(1)).alias("runs"))
            .join(F.broadcast(sla), "domain"))


@query("update_column_pick", """
SELECT 'updated_at' AS update_column, CAST(count(updated_at) AS BIGINT) AS filled,
 max(updated_at) AS latest FROM dirty_services""")
def update_column_pick(spark, sf_dir):
    t = keyed(spark, sf_dir, S)
    c = checks.update_column(t)
    return t.df.agg(F.lit(c).alias("update_column"), F.count(c).alias("filled"), F.max(c).alias("latest"))


rule_query("missing_traceability_metadata", C, checks.lineage, "missing_traceability_metadata", [
    (None, None, "MEDIUM", "LOW", "add_default_lineage_metadata", "true", {"count": "count(*)"})])
rule_query("missing_audit_timestamp", C, checks.audit, "missing_audit_timestamp", [
    ("DATASET", None, "MEDIUM", "MEDIUM", "add_audit_timestamp_column", "false", {"count": "count(*)"})])


@query("missing_primary_key", issue_sql("orders", "missing_primary_key", [
    ("DATASET", None, "HIGH", "HIGH", "add_primary_key", "false", {"count": "count(*)"})]))
def missing_primary_key(spark, sf_dir):
    t = Table(table(spark, sf_dir, "orders"))
    return shown(rule.measure(t, [r for r in checks.audit(t) if r.issue_type == "missing_primary_key"]))


rule_query("missing_audit_timestamp_value", O, checks.audit, "missing_audit_timestamp_value", [
    ("last_updated", "last_updated IS NULL", "rate", "MEDIUM", "populate_audit_timestamps", "false")])

# --- personal data ---------------------------------------------------------------------------------------------

NAMED = {"customer_name": "Name", "email": "Email", "phone": "Phone", "ssn": "SSN"}
rule_query("pii_detected_by_name", C, privacy.pii_rules, "pii_detected_by_name", [
    (c, f"{c} IS NOT NULL", "HIGH", "HIGH", "mask_pii", "false") for c in NAMED])


def _winner_sql(c: str, kind: bool) -> str:
    cases = " ".join(
        f"WHEN count(*) FILTER (WHERE regexp_matches({c}, '{p}')) > count({c}) * 0.05 THEN "
        + (f"'{name}'" if kind else f"count(*) FILTER (WHERE regexp_matches({c}, '{p}'))")
        for name, p in fv.PII_PATTERNS)
    return f"CASE {cases} ELSE {'NULL' if kind else 0} END"


def _pii_sql(v: str, named: dict, unnamed: list[str]) -> str:
    parts = [f"SELECT '{c}' AS column_name, '{k}' AS pii_type, 'name' AS detected_by, "
             f"CAST(count({c}) AS BIGINT) AS affected_rows, CAST(count(*) AS BIGINT) AS total_rows FROM {v}"
             for c, k in named.items()]
    parts += [f"SELECT '{c}' AS column_name, {_winner_sql(c, True)} AS pii_type, 'pattern' AS detected_by, "
              f"CAST({_winner_sql(c, False)} AS BIGINT) AS affected_rows, "
              f"CAST(count(*) AS BIGINT) AS total_rows FROM {v}" for c in unnamed]
    return ("SELECT * FROM (" + " UNION ALL ".join(parts)
            + ") WHERE pii_type IS NOT NULL AND affected_rows > 0")


UNNAMED = [c for c in CUSTOMER_TEXTS if c not in NAMED]
PII_CUSTOMERS = _pii_sql(C, NAMED, UNNAMED)


@query("pii_columns_customers", PII_CUSTOMERS)
def pii_columns_customers(spark, sf_dir):
    return privacy.pii_columns(keyed(spark, sf_dir, C))


@query("pii_columns_admissions", _pii_sql(
    A, {"patient_name": "Name", "date_of_birth": "Date of Birth"},
    ["patient_id", "diagnosis_code", "admission_date", "discharge_date", "status", "payment_status"]))
def pii_columns_admissions(spark, sf_dir):
    return privacy.pii_columns(keyed(spark, sf_dir, A))


DOC_COUNTS = ", ".join(
    f"CAST(count(*) FILTER (WHERE regexp_matches(text, '{p}')) AS BIGINT) AS {n.lower().replace(' ', '_')}"
    for n, p in fv.PII_PATTERNS)


@query("pii_pattern_counts_documents", f"SELECT lang, {DOC_COUNTS} FROM documents GROUP BY lang")
def pii_pattern_counts_documents(spark, sf_dir):
    return privacy.pattern_counts(Table(table(spark, sf_dir, "documents"), "doc_id"), "text", ["lang"])


@query("pii_exposure_summary", f"""
SELECT CAST(count(*) AS BIGINT) AS pii_columns, round(count(*) * 100.0 / 16, 1) AS pii_pct,
 (SELECT string_agg(DISTINCT pii_type, ', ' ORDER BY pii_type) FROM ({PII_CUSTOMERS})) AS pii_types,
 CASE WHEN count(*) > 3 THEN 'HIGH' ELSE 'MEDIUM' END AS severity,
 CAST(max(total_rows) AS BIGINT) AS affected_rows FROM ({PII_CUSTOMERS})""")
def pii_exposure_summary(spark, sf_dir):
    return privacy.exposure_summary(keyed(spark, sf_dir, C))


EXAMPLES = ", ".join("('%s', '%s')" % (k, " | ".join(privacy.masked_examples(k))) for k in fv.MASKED_SHAPES)


@query("pii_masked_samples", f"""
SELECT column_name, pii_type, examples FROM ({PII_CUSTOMERS}) JOIN (VALUES {EXAMPLES}) e(pii_type, examples) USING (pii_type)""")
def pii_masked_samples(spark, sf_dir):
    examples = privacy.format_examples(spark).select(
        "pii_type", F.concat_ws(" | ", "masked_examples").alias("examples"))
    return (privacy.pii_columns(keyed(spark, sf_dir, C)).join(F.broadcast(examples), "pii_type")
            .select("column_name", "pii_type", "examples"))


@query("pii_policy_gaps", f"""
SELECT coalesce(p.column_name, d.column_name) AS column_name, d.pii_type,
 CASE WHEN p.column_name IS NOT NULL AND d.column_name IS NOT NULL THEN 'declared and detected'
  WHEN d.column_name IS NOT NULL THEN 'detected, not declared' ELSE 'declared, no such column' END AS status
FROM (VALUES {', '.join(f"('{c}')" for c in catalogue.PII_FIELDS['finance'])}) p(column_name)
FULL JOIN ({PII_CUSTOMERS}) d ON p.column_name = d.column_name""")
def pii_policy_gaps(spark, sf_dir):
    return privacy.policy_gaps(keyed(spark, sf_dir, C), catalogue.PII_FIELDS["finance"])


# --- declared rules ------------------------------------------------------------------------------------------------

@query("declared_checks_supply_chain", f"""
WITH t AS (SELECT *, {date_sql('order_date')} AS od, {date_sql('actual_delivery')} AS ad FROM {O})
SELECT * FROM (
 SELECT 'total_amount_correct' AS rule, CAST(count(*) FILTER (WHERE quantity * unit_price <> 0 AND NOT (abs(total_amount - quantity * unit_price) / (quantity * unit_price) <= 0.01)) AS BIGINT) AS affected_rows, 'HIGH' AS severity, 'recalculate_total' AS fix_action FROM t
 UNION ALL SELECT 'actual_delivery_after_order', CAST(count(*) FILTER (WHERE ad < od) AS BIGINT), 'HIGH', 'flag_for_review' FROM t
 UNION ALL SELECT 'delivered_order_has_actual_delivery', CAST(count(*) FILTER (WHERE status = 'Delivered' AND ad IS NULL) AS BIGINT), 'MEDIUM', 'flag_for_review' FROM t
 UNION ALL SELECT 'cancelled_order_positive_quantity', CAST(count(*) FILTER (WHERE status = 'Cancelled' AND quality_check IS NOT NULL AND quality_check <> 'Pending') AS BIGINT), 'LOW', 'nullify_quality_check' FROM t
) WHERE affected_rows > 0""")
def declared_checks_supply_chain(spark, sf_dir):
    return _declared(spark, sf_dir, O, "supply_chain")


def _declared(spark, sf_dir, v, domain):
    t = keyed(spark, sf_dir, v)
    typed = declared.typed_view(t, catalogue.FIELDS[domain], AS_OF)
    rules = declared.check_rules(typed, catalogue.CHECKS[domain],
                                 set(catalogue.FIELDS[domain]))
    return rule.measure(typed, rules).select(
        F.col("column_name").alias("rule"), "affected_rows", "severity", "fix_action")


def _check_sql(v: str, checks_: list[tuple], extra: str = "") -> str:
    parts = [f"SELECT '{n}' AS rule, CAST(count(*) FILTER (WHERE {p}) AS BIGINT) AS affected_rows, "
             f"'{s}' AS severity, '{f}' AS fix_action FROM t" for n, p, s, f in checks_]
    return (f"WITH t AS (SELECT * {extra} FROM {v}) SELECT * FROM ("
            + " UNION ALL ".join(parts) + ") WHERE affected_rows > 0")


@query("declared_checks_insurance", _check_sql(L, [
    ("policy_end_after_start", "NOT pe > ps", "HIGH", "flag_for_review"),
    ("claim_within_policy_period", "NOT cd BETWEEN ps AND pe", "HIGH", "flag_for_review"),
    ("claim_within_coverage", "claim_amount > coverage_amount", "MEDIUM", "cap_at_coverage_amount"),
    ("settled_claim_has_settlement", "claim_status = 'Settled' AND (settlement_amount IS NULL OR settlement_amount <= 0)", "HIGH", "flag_for_review"),
    ("deductible_less_than_coverage", "deductible >= coverage_amount", "MEDIUM", "flag_for_review")],
    f", {date_sql('policy_start')} AS ps, {date_sql('policy_end')} AS pe, {date_sql('claim_date')} AS cd"))
def declared_checks_insurance(spark, sf_dir):
    return _declared(spark, sf_dir, L, "insurance")


@query("declared_checks_automotive", _check_sql(S, [
    ("cost_equals_parts_plus_labor", "abs(cost - (parts_cost + labor_cost)) > 0.01", "HIGH", "recalculate_total_cost"),
    ("service_date_not_future", f"sd > {AS_OF_SQL}", "MEDIUM", "flag_for_review"),
    ("warranty_service_zero_cost", "warranty_status = 'Active' AND cost > 50", "LOW", "flag_for_review"),
    ("vin_no_invalid_chars", "regexp_matches(vin, '[IOQ]')", "HIGH", "flag_for_correction")],
    f", {date_sql('service_date')} AS sd"))
def declared_checks_automotive(spark, sf_dir):
    return _declared(spark, sf_dir, S, "automotive")


YEARS = "date_diff('month', dob, DATE '2026-01-01') // 12"


@query("declared_checks_healthcare", _check_sql(A, [
    ("discharge_after_admission", "dd < ad", "HIGH", "swap_or_nullify_discharge"),
    ("age_dob_consistency", "abs(age - (2025 - year(dob))) > 1", "MEDIUM", "recalculate_age_from_dob"),
    ("active_patient_requires_diagnosis", "status = 'Active' AND diagnosis_code IS NULL", "HIGH", "flag_for_review"),
    ("bill_amount_positive", "bill_amount < 0", "HIGH", "set_absolute_value")],
    f", {date_sql('admission_date')} AS ad, {date_sql('discharge_date')} AS dd, {date_sql('date_of_birth')} AS dob"))
def declared_checks_healthcare(spark, sf_dir):
    return _declared(spark, sf_dir, A, "healthcare")


def _field_query(name: str, v: str, domain: str, specs: list[tuple], unique: list[str]) -> None:
    """specs: (column, kind, predicate, severity)."""
    def run(spark, sf_dir):
        t = keyed(spark, sf_dir, v)
        found = declared.declared_issues(t, catalogue.FIELDS[domain], [], AS_OF)
        return found.select("column_name", "issue_type", "affected_rows", "severity")
    parts = [f"SELECT '{c}' AS column_name, 'field_{k}' AS issue_type, CAST(count(*) FILTER (WHERE {p}) AS BIGINT) "
             f"AS affected_rows, '{s}' AS severity FROM {v}" for c, k, p, s in specs]
    parts += [f"SELECT '{c}', 'field_unique', CAST(coalesce(sum(n), 0) AS BIGINT), 'HIGH' FROM (SELECT count(*) AS n FROM {v} "
              f"WHERE {c} IS NOT NULL GROUP BY {c} HAVING count(*) > 1)" for c in unique]
    query(name, "SELECT * FROM (" + " UNION ALL ".join(parts) + ") WHERE affected_rows > 0")(run)


def _in(c, values):
    return f"{c} NOT IN ({', '.join(repr(x) for x in values)})"


TITLE = "regexp_matches({0}, '(^|[^A-Za-z])[a-z]|[A-Za-z][A-Z]')"
_field_query("declared_fields_supply_chain", O, "supply_chain", [
    ("order_id", "required", "order_id IS NULL", "HIGH"),
    ("order_id", "pattern", "NOT regexp_matches(order_id, '^ORD-[0-9]{8}$')", "MEDIUM"),
    ("supplier_id", "required", "supplier_id IS NULL", "HIGH"),
    ("supplier_id", "pattern", "NOT regexp_matches(supplier_id, '^SUP-[0-9]{5}$')", "MEDIUM"),
    ("supplier_name", "required", "supplier_name IS NULL", "HIGH"),
    ("supplier_name", "case", TITLE.format("supplier_name"), "LOW"),
    ("order_date", "required", f"{date_sql('order_date')} IS NULL", "HIGH"),
    ("order_date", "not_future", f"{date_sql('order_date')} > {AS_OF_SQL}", "HIGH"),
    ("quantity", "required", "quantity IS NULL", "HIGH"),
    ("quantity", "min", "quantity < 1", "HIGH"),
    ("unit_price", "required", "unit_price IS NULL", "HIGH"),
    ("unit_price", "min", "unit_price < 0.01", "HIGH"),
    ("total_amount", "required", "total_amount IS NULL", "HIGH"),
    ("total_amount", "min", "total_amount < 0", "HIGH"),
    ("status", "enum", _in("status", ["Ordered", "In Transit", "Delivered", "Cancelled", "Returned"]), "MEDIUM"),
    ("status", "case", TITLE.format("status"), "LOW"),
    ("quality_check", "enum", _in("quality_check", ["Pass", "Fail", "Pending"]), "MEDIUM"),
    ("quality_check", "case", TITLE.format("quality_check"), "LOW")], ["order_id"])
_field_query("declared_fields_automotive", S, "automotive", [
    ("vehicle_id", "pattern", "NOT regexp_matches(vehicle_id, '^VEH-[0-9]{6}$')", "MEDIUM"),
    ("vin", "pattern", "NOT regexp_matches(vin, '^[A-HJ-NPR-Z0-9]{17}$')", "MEDIUM"),
    ("make", "enum", _in("make", ["Ford", "Toyota", "Honda", "BMW", "Mercedes", "Chevrolet", "Tesla", "Nissan", "Hyundai", "Kia"]), "MEDIUM"),
    ("make", "case", TITLE.format("make"), "LOW"),
    ("year", "min", "year < 1980", "HIGH"), ("year", "max", "year > 2026", "HIGH"),
    ("mileage", "min", "mileage < 0", "HIGH"), ("mileage", "max", "mileage > 1000000", "HIGH"),
    ("engine_type", "enum", _in("engine_type", ["Gasoline", "Diesel", "Electric", "Hybrid", "Plug-in Hybrid"]), "MEDIUM"),
    ("engine_type", "case", TITLE.format("engine_type"), "LOW"),
    ("service_date", "not_future", f"{date_sql('service_date')} > {AS_OF_SQL}", "HIGH"),
    ("cost", "min", "cost < 0", "HIGH"), ("parts_cost", "min", "parts_cost < 0", "HIGH"),
    ("labor_cost", "min", "labor_cost < 0", "HIGH"),
    ("warranty_status", "enum", _in("warranty_status", ["Active", "Expired", "Not Applicable"]), "MEDIUM"),
    ("warranty_status", "case", TITLE.format("warranty_status"), "LOW")], ["vehicle_id", "vin"])
_field_query("declared_fields_healthcare", A, "healthcare", [
    ("patient_id", "pattern", "NOT regexp_matches(patient_id, '^PAT-[0-9]{6}$')", "MEDIUM"),
    ("patient_name", "case", TITLE.format("patient_name"), "LOW"),
    ("age", "min", "age < 0", "HIGH"), ("age", "max", "age > 130", "HIGH"),
    ("age", "derived", "abs(age - (2025 - CAST(substr(date_of_birth, 1, 4) AS INT))) > 1", "MEDIUM"),
    ("diagnosis_code", "required", "diagnosis_code IS NULL", "HIGH"),
    ("diagnosis_code", "pattern", r"NOT regexp_matches(diagnosis_code, '^[A-Z][0-9]{2}\.?[0-9A-Z]{0,4}$')", "MEDIUM"),
    ("admission_date", "not_future", f"{date_sql('admission_date')} > {AS_OF_SQL}", "HIGH"),
    ("bill_amount", "min", "bill_amount < 0", "HIGH"),
    ("bill_amount", "max", "bill_amount > 10000000", "HIGH"),
    ("status", "enum", _in("status", ["Active", "Discharged", "Deceased", "Transferred"]), "MEDIUM"),
    ("status", "case", TITLE.format("status"), "LOW")], ["patient_id"])


T = "dirty_transactions"
_field_query("declared_fields_finance", T, "finance", [
    ("transaction_id", "pattern", "NOT regexp_matches(transaction_id, '^TXN-[0-9]{8}$')", "MEDIUM"),
    ("account_id", "required", "account_id IS NULL", "HIGH"),
    ("account_id", "pattern", "NOT regexp_matches(account_id, '^ACC-[0-9]{7}$')", "MEDIUM"),
    ("customer_name", "case", TITLE.format("customer_name"), "LOW"),
    ("card_number", "pattern", "NOT regexp_matches(card_number, '^[0-9]{16}$')", "MEDIUM"),
    ("transaction_date", "required", f"{date_sql('transaction_date')} IS NULL", "HIGH"),
    ("transaction_date", "not_future", f"{date_sql('transaction_date')} > {AS_OF_SQL}", "HIGH"),
    ("amount", "required", "amount IS NULL", "HIGH"),
    ("currency", "enum", _in("currency", ["USD", "EUR", "GBP", "JPY", "CAD", "AUD"]), "MEDIUM"),
    ("currency", "case", "currency <> upper(currency)", "LOW"),
    ("transaction_type", "enum", _in("transaction_type", ["Credit", "Debit", "Transfer", "Refund", "Fee"]), "MEDIUM"),
    ("transaction_type", "case", TITLE.format("transaction_type"), "LOW"),
    ("status", "enum", _in("status", ["Completed", "Pending", "Failed", "Reversed"]), "MEDIUM"),
    ("status", "case", TITLE.format("status"), "LOW"),
    ("credit_limit", "min", "credit_limit < 0", "HIGH")], ["transaction_id"])
_field_query("declared_fields_insurance", L, "insurance", [
    ("policy_id", "pattern", "NOT regexp_matches(policy_id, '^POL-[0-9]{7}$')", "MEDIUM"),
    ("claim_id", "pattern", "NOT regexp_matches(claim_id, '^CLM-[0-9]{8}$')", "MEDIUM"),
    ("policy_type", "enum", _in("policy_type", ["Health", "Life", "Auto", "Home", "Commercial"]), "MEDIUM"),
    ("policy_type", "case", TITLE.format("policy_type"), "LOW"),
    ("coverage_amount", "min", "coverage_amount < 1000", "HIGH"), ("premium", "min", "premium < 0.01", "HIGH"),
    ("deductible", "min", "deductible < 0", "HIGH"), ("claim_amount", "min", "claim_amount < 0", "HIGH"),
    ("claim_status", "enum", _in("claim_status", ["Submitted", "Under Review", "Approved", "Rejected", "Settled"]), "MEDIUM"),
    ("claim_status", "case", TITLE.format("claim_status"), "LOW"),
    ("zip_code", "pattern", "NOT regexp_matches(zip_code, '^[0-9]{5}(-[0-9]{4})?$')", "MEDIUM")], ["policy_id", "claim_id"])


@query("declared_checks_finance", _check_sql(T, [
    ("balance_within_credit_limit", "transaction_type = 'Credit' AND balance > credit_limit", "HIGH", "flag_for_review"),
    ("no_zero_amount_transaction", "amount = 0", "MEDIUM", "flag_for_removal"),
    ("failed_transaction_no_credit", "status = 'Failed' AND transaction_type = 'Credit'", "HIGH", "flag_for_review")]))
def declared_checks_finance(spark, sf_dir):
    return _declared(spark, sf_dir, T, "finance")


CUSTOM = [(1, "finance", "balance_positive", "balance >= 0", "HIGH", "flag_for_review", 1),
          (2, "finance", "adult_customer", "age BETWEEN 18 AND 130", "MEDIUM", None, 1),
          (3, "finance", "retired_rule", "age < 0", "LOW", None, 0),
          (4, "insurance", "other_domain", "age < 0", "LOW", None, 1),
          (5, "finance", "unknown_column", "no_such_column > 0", "LOW", None, 1),
          (6, "finance", "dividing", "100 / (age % 5) <= 30", "LOW", "recheck", 1)]


@query("custom_rules", """
SELECT * FROM (SELECT 'balance_positive' AS rule, CAST(count(*) FILTER (WHERE NOT balance >= 0) AS BIGINT) AS affected_rows, 'HIGH' AS severity, 'flag_for_review' AS fix_action FROM dirty_customers
UNION ALL SELECT 'adult_customer', CAST(count(*) FILTER (WHERE NOT age BETWEEN 18 AND 130) AS BIGINT), 'MEDIUM', 'flag_for_review' FROM dirty_customers
UNION ALL SELECT 'dividing', CAST(count(*) FILTER (WHERE age % 5 <> 0 AND NOT 100.0 / nullif(age % 5, 0) <= 30) AS BIGINT), 'LOW', 'recheck' FROM dirty_customers) WHERE affected_rows > 0""")
def custom_rules(spark, sf_dir):
    rules = spark.createDataFrame(CUSTOM, "rule_id int, domain string, rule_name string, "
                                          "rule_expression string, severity string, "
                                          "fix_action string, is_active int")
    typed = declared.typed_view(keyed(spark, sf_dir, C), {}, AS_OF)
    specs = declared.custom_checks(rules, "finance")
    return declared.measured_checks(typed, declared.check_rules(typed, specs, errors={})).select(
        F.col("column_name").alias("rule"), "affected_rows", "severity", "fix_action")


# --- violations and samples -------------------------------------------------------------------------------------------

@query("violation_rows", f"""
SELECT row_key, 'validity' AS dimension, 'quantity' AS column_name, 'range_violation' AS issue_type, CAST(CAST(quantity AS DOUBLE) AS VARCHAR) AS value FROM {O} WHERE quantity < 1
UNION ALL SELECT row_key, 'validity', 'order_id', 'pattern_violation', order_id FROM {O} WHERE NOT regexp_matches(order_id, '^ORD-\\d{{8}}$')
UNION ALL SELECT row_key, 'validity', 'price_text', 'type_mismatch', price_text FROM {O} WHERE starts_with(price_text, '$')""")
def violation_rows(spark, sf_dir):
    t = keyed(spark, sf_dir, O)
    return rule.violations(t, checks.validity(t, AS_OF))


@query("violation_samples", f"""
SELECT 'price_text' AS column_name, string_agg(price_text, ',' ORDER BY row_key) AS samples FROM (SELECT * FROM {O} WHERE starts_with(price_text, '$') ORDER BY row_key LIMIT 5)
UNION ALL SELECT 'order_id', string_agg(order_id, ',' ORDER BY row_key) FROM (SELECT * FROM {O} WHERE NOT regexp_matches(order_id, '^ORD-\\d{{8}}$') ORDER BY row_key LIMIT 5)
UNION ALL SELECT 'quantity', string_agg(CAST(CAST(quantity AS DOUBLE) AS VARCHAR), ',' ORDER BY row_key) FROM (SELECT * FROM {O} WHERE quantity < 1 ORDER BY row_key LIMIT 5)""")
def violation_samples(spark, sf_dir):
    t = keyed(spark, sf_dir, O)
    return rule.samples(t, checks.validity(t, AS_OF)).select(
        "column_name", F.concat_ws(",", "sample_values").alias("samples"))


@query("enum_top_values", f"""
SELECT column_name, string_agg(v, ',' ORDER BY n DESC, v) AS top_values FROM (
 SELECT *, row_number() OVER (PARTITION BY column_name ORDER BY n DESC, v) AS r FROM (
  SELECT 'status' AS column_name, status AS v, count(*) AS n FROM {O} WHERE {_enum('status')[1]} GROUP BY status))
WHERE r <= 5 GROUP BY column_name""")
def enum_top_values(spark, sf_dir):
    t = keyed(spark, sf_dir, O)
    broken = [r for r in checks.consistency(t) if r.issue_type == "enum_inconsistency"]
    counts = (rule.violations(t, broken).groupBy("column_name", "value")
              .agg(F.count(F.lit(1)).alias("rows")))
    return duplicates.top_values(counts, 5).select(
        "column_name", F.concat_ws(",", "sample_values").alias("top_values"))


@query("column_classification", """
SELECT kind, CAST(count(*) AS BIGINT) AS columns, CAST(max(n) AS BIGINT) AS rows FROM (VALUES
 ('o_orderkey', 'numeric'), ('o_custkey', 'numeric'), ('o_totalprice', 'numeric'),
 ('o_orderdate', 'datetime'), ('o_orderstatus', 'categorical'), ('o_orderpriority', 'categorical')) v(c, kind),
 (SELECT count(*) AS n FROM orders) GROUP BY kind""")
def column_classification(spark, sf_dir):
    df = table(spark, sf_dir, "orders")
    return tables.classify(df).groupBy("kind").agg(
        F.count(F.lit(1)).alias("columns"), F.lit(df.count()).alias("rows"))
