"""Repair queries: the repaired rows, and the change logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.operators import entities, privacy
from plumbline.operators.fixes import Context, apply_fix, drop_copies, keep_last
from plumbline.plans import history, remediation

from .detect import A, C, COST_OFF, L, O, S, TOTAL_OFF, NUMBER_DUMMY, TEXT_DUMMY
from .inputs import AS_OF, table, view
from .registry import date_sql, query



def context(**options) -> Context:
    return Context(AS_OF, "row_key", options)


def fix_query(name: str, v: str, dimension: str, changed: dict[str, str], log: str | None = None,
              where: str = "", **options) -> None:
    """Register the repaired columns of a view; ``changed`` maps column to its SQL."""
    columns = ", ".join(f"{e} AS {c}" for c, e in changed.items())

    def run(spark, sf_dir):
        fixed = apply_fix(view(spark, sf_dir, v), dimension, context(**options))
        return fixed.df.select("row_key", *[F.round(c, 6).alias(c) if fixed.df.schema[c].dataType.typeName()
                                            == "double" else c for c in changed])
    query(name, f"SELECT row_key, {columns} FROM {v}{where}")(run)
    if log is not None:
        def run_log(spark, sf_dir):
            fixed = apply_fix(view(spark, sf_dir, v), dimension, context(**options))
            return fixed.log.select("action", "column_name", "rows_affected")
        query(f"{name}_log", log)(run_log)


def log_sql(v: str, steps: list[tuple]) -> str:
    parts = [f"SELECT '{a}' AS action, '{c}' AS column_name, CAST(count(*) FILTER (WHERE {p}) AS BIGINT) "
             f"AS rows_affected FROM {v}" for a, c, p in steps]
    return "SELECT * FROM (" + " UNION ALL ".join(parts) + ") WHERE rows_affected > 0"


def _mode(c: str) -> str:
    return (f"coalesce({c}, (SELECT {c} FROM {O} WHERE {c} IS NOT NULL GROUP BY {c} "
            f"ORDER BY count(*) DESC, {c} LIMIT 1))")


HOLES = ["supplier_id", "actual_delivery", "quality_check", "last_updated"]
MEDIAN = f"(SELECT quantile_cont(total_amount, 0.5) FROM {O})"
fix_query("fix_impute_median", O, "completeness",
          {"total_amount": f"round(coalesce(total_amount, {MEDIAN}), 6)", **{c: _mode(c) for c in HOLES}},
          log_sql(O, [("impute_median", "total_amount", "total_amount IS NULL")]
                  + [("impute_mode", c, f"{c} IS NULL") for c in HOLES]))
fix_query("fix_impute_mean", O, "completeness", {
    "total_amount": f"round(coalesce(total_amount, (SELECT avg(total_amount) FROM {O})), 6)"},
    strategy="mean")
fix_query("fix_impute_zero", O, "completeness", {"total_amount": "coalesce(total_amount, 0)"},
          strategy="zero")
fix_query("fix_impute_unknown", S, "completeness", {"recall_note": "coalesce(recall_note, 'UNKNOWN')"})


@query("fix_exact_dedup", "SELECT DISTINCT event_id, user_id, event_type, value FROM dirty_events")
def fix_exact_dedup(spark, sf_dir):
    return drop_copies(view(spark, sf_dir, "dirty_events"), Context(AS_OF)).df


@query("fix_exact_dedup_log", """
SELECT 'exact_dedup' AS action, 'ALL' AS column_name, CAST(sum(n - 1) AS BIGINT) AS rows_affected
FROM (SELECT count(*) AS n FROM dirty_events GROUP BY event_id, user_id, event_type, value)""")
def fix_exact_dedup_log(spark, sf_dir):
    return drop_copies(view(spark, sf_dir, "dirty_events"), Context(AS_OF)).log.select(
        "action", "column_name", "rows_affected")


@query("fix_id_dedup", """
SELECT row_key, order_id, supplier_id FROM dirty_orders
QUALIFY row_number() OVER (PARTITION BY order_id ORDER BY row_key DESC) = 1""")
def fix_id_dedup(spark, sf_dir):
    return apply_fix(view(spark, sf_dir, O), "uniqueness", context(keys=["order_id"])).df.select(
        "row_key", "order_id", "supplier_id")


@query("fix_id_dedup_null_keys", """
SELECT row_key, claim_id FROM dirty_claims WHERE claim_id IS NULL
UNION ALL SELECT max(row_key), claim_id FROM dirty_claims WHERE claim_id IS NOT NULL GROUP BY claim_id""")
def fix_id_dedup_null_keys(spark, sf_dir):
    return keep_last(view(spark, sf_dir, L).select("row_key", "claim_id"), "claim_id", "row_key")


@query("fix_id_dedup_parity", """
WITH a AS (SELECT * FROM dirty_claims QUALIFY row_number() OVER (PARTITION BY policy_id ORDER BY row_key DESC) = 1),
 b AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY claim_id ORDER BY row_key DESC) = 1)
SELECT row_key, policy_id, claim_id, customer_id FROM b
QUALIFY row_number() OVER (PARTITION BY customer_id ORDER BY row_key DESC) = 1""")
def fix_id_dedup_parity(spark, sf_dir):
    return apply_fix(view(spark, sf_dir, L), "uniqueness", context(parity=True)).df.select(
        "row_key", "policy_id", "claim_id", "customer_id")


@query("fix_id_dedup_lines", """
SELECT l_orderkey, l_linenumber, max(l_partkey * 100000 + l_suppkey) AS kept FROM lineitem
GROUP BY l_orderkey, l_linenumber""")
def fix_id_dedup_lines(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", (F.col("l_partkey") * 100000 + F.col("l_suppkey")).alias("row_key"),
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("line_id"))
    return keep_last(lines, "line_id", "row_key").select(
        "l_orderkey", "l_linenumber", F.col("row_key").alias("kept"))


TITLE = ("array_to_string(list_transform(regexp_extract_all({0}, '([A-Za-z]+|[^A-Za-z]+)'), "
         "lambda x: upper(x[1]) || lower(x[2:])), '')")
NOT_TITLE = "regexp_matches({0}, '(^|[^A-Za-z])[a-z]|[A-Za-z][A-Z]')"


def _iso(c: str) -> str:
    return f"coalesce(CAST({date_sql(c)} AS VARCHAR), {c})"


fix_query("fix_standardize_orders", O, "standardization", {
    "supplier_name": TITLE.format("supplier_name"), "order_date": _iso("order_date"),
    "actual_delivery": _iso("actual_delivery"), "status": "trim(status)",
    "price_text": "CAST(regexp_replace(price_text, '[,$]', '', 'g') AS DOUBLE)"},
    log_sql(O, [("title_case", "supplier_name", NOT_TITLE.format("supplier_name")),
                ("standardize_date", "order_date", f"order_date <> CAST({date_sql('order_date')} AS VARCHAR)"),
                ("strip_whitespace", "status", "status <> trim(status)"),
                ("strip_currency_symbol", "price_text", "starts_with(price_text, '$')")]),
    as_double=True)
fix_query("fix_standardize_services", S, "standardization", {
    "service_date": _iso("service_date"), "technician": TITLE.format("technician")})
fix_query("fix_title_case_words", S, "standardization", {"technician": TITLE.format("technician")},
          title_words=["technician"])
fix_query("fix_upper_case", C, "standardization", {"currency": "upper(currency)"})
fix_query("fix_strip_currency_text", O, "standardization", {
    "price_text": "regexp_replace(price_text, '[,$]', '', 'g')"})
OUT = "CASE WHEN {0} BETWEEN {1} AND {2} THEN {0} END"
fix_query("fix_nullify_range_services", S, "validity", {
    "year": OUT.format("year", 1900, 2026), "mileage": OUT.format("mileage", 0, 2000000)},
    log_sql(S, [("nullify_out_of_range", "year", "year < 1900 OR year > 2026"),
                ("nullify_out_of_range", "mileage", "mileage < 0 OR mileage > 2000000")]))
fix_query("fix_nullify_range_customers", C, "validity", {
    "age": OUT.format("age", 0, 130), "fraud_flag": OUT.format("fraud_flag", 0, 1)})
CANON = ("CASE lower(trim(status)) WHEN 'active' THEN 'Active' WHEN 'cancelled' THEN 'Cancelled' "
         "WHEN 'delivered' THEN 'Delivered' ELSE status END")
NEW_TOTAL = f"CASE WHEN {TOTAL_OFF} THEN round(quantity * unit_price, 2) ELSE total_amount END"
fix_query("fix_consistency_orders", O, "consistency", {
    "status": CANON, "quality_check": "CASE quality_check WHEN 'PASS' THEN 'Pass' ELSE quality_check END",
    "total_amount": f"round({NEW_TOTAL}, 6)"},
    log_sql(O, [("standardize_enum", "status", f"status <> {CANON}"),
                ("standardize_enum", "quality_check", "quality_check = 'PASS'"),
                ("recalculate_total", "total_amount", TOTAL_OFF)]))
fix_query("fix_consistency_services", S, "consistency", {
    "engine_type": "CASE engine_type WHEN 'diesel' THEN 'Diesel' ELSE engine_type END",
    "warranty_status": "CASE warranty_status WHEN 'active' THEN 'Active' ELSE warranty_status END",
    "cost": f"CASE WHEN {COST_OFF} THEN round(parts_cost + labor_cost, 2) ELSE cost END"})


def _clip(v: str, c: str, k: float) -> str:
    q1, q3 = (f"(SELECT quantile_cont(CAST({c} AS DOUBLE), {p}) FROM {v})" for p in (0.25, 0.75))
    return (f"round(CASE WHEN {c} IS NULL THEN NULL ELSE least(greatest(CAST({c} AS DOUBLE), "
            f"{q1} - {k} * ({q3} - {q1})), {q3} + {k} * ({q3} - {q1})) END, 6)")


fix_query("fix_winsorize", O, "accuracy", {"total_amount": _clip(O, "total_amount", 1.5)})
fix_query("fix_cap_extremes", O, "reasonableness", {"total_amount": _clip(O, "total_amount", 3.0)})
fix_query("fix_cap_extremes_admissions", A, "reasonableness", {"bill_amount": _clip(A, "bill_amount", 3.0)})
fix_query("fix_abs_amounts", A, "business_rules", {"bill_amount": "abs(bill_amount)"},
          log_sql(A, [("abs_negative_amounts", "bill_amount", "bill_amount < 0")]))
fix_query("fix_nullify_quantity", O, "business_rules", {
    "quantity": "CASE WHEN quantity > 0 THEN quantity END"})
fix_query("fix_fraud_flag", C, "business_rules", {
    "fraud_flag": "CASE WHEN fraud_flag IN (0, 1) THEN fraud_flag ELSE 0 END",
    "balance": "abs(balance)"})
fix_query("fix_strip_non_ascii", C, "accessibility", {
    "note": r"regexp_replace(note, '[^\x00-\x7F]', '', 'g')"},
    log_sql(C, [("strip_non_ascii", "note", r"regexp_matches(note, '[^\x00-\x7F]')")]))
fix_query("fix_malformed_customers", C, "conformity", {
    "email": r"CASE WHEN regexp_matches(email, '^[^@]+@[^@]+\.[^@]+$') THEN email END",
    "zip_code": r"CASE WHEN regexp_matches(zip_code, '^\d{5}(?:-\d{4})?$') THEN zip_code END"},
    log_sql(C, [("nullify_invalid_emails", "email", r"NOT regexp_matches(email, '^[^@]+@[^@]+\.[^@]+$')"),
                ("clean_zipcodes", "zip_code", r"NOT regexp_matches(zip_code, '^\d{5}(?:-\d{4})?$')")]))
fix_query("fix_clip_age", C, "constraints", {"age": "least(greatest(age, 0), 130)"})
fix_query("fix_placeholders", C, "reliability", {
    "segment": f"CASE WHEN upper(segment) IN ({TEXT_DUMMY}) THEN NULL ELSE segment END",
    "age": f"CASE WHEN age IN ({NUMBER_DUMMY}) THEN NULL ELSE age END"})
fix_query("fix_audit_columns", O, "auditability", {
    "last_updated": "coalesce(last_updated, '2026-01-01 00:00:00')", "created_at": "'2026-01-01 00:00:00'"},
    log_sql(O, [("populate_audit_timestamps", "last_updated", "last_updated IS NULL"),
                ("inject_audit_column", "created_at", "true")]))
fix_query("fix_lineage_columns", O, "lineage", {
    "source_system": "'default_src'", "batch_id": "batch_id", "record_source": "'auto-filled'"},
    log_sql(O, [("add_lineage_metadata", "source_system", "true"),
                ("add_lineage_metadata", "record_source", "true")]))
fix_query("fix_pad_amounts", O, "reconciliation", {
    "total_amount": "coalesce(total_amount, 0)",
    "price_text": "CASE WHEN try_cast(price_text AS DOUBLE) IS NULL THEN '0.0' ELSE price_text END"},
    log_sql(O, [("reconcile_missing_amount", "total_amount", "total_amount IS NULL"),
                ("reconcile_missing_amount", "price_text", "try_cast(price_text AS DOUBLE) IS NULL")]))
fix_query("fix_ancient_dates", O, "timeliness", {
    "order_date": f"CASE WHEN year({date_sql('order_date')}) < 2011 THEN NULL ELSE order_date END",
    "last_updated": f"CASE WHEN year({date_sql('last_updated')}) < 2011 THEN NULL ELSE last_updated END"})
fix_query("fix_flag_integrity", O, "integrity", {
    "to_review": "coalesce(status = 'Delivered' AND actual_delivery IS NULL, false)"},
    flag_column="to_review")
fix_query("fix_flag_freshness", S, "freshness", {
    "to_archive": f"coalesce({date_sql('updated_at')} < DATE '2024-01-01', false)"},
    flag_column="to_archive")
fix_query("fix_flag_enrichment", C, "enrichment", {"to_enrich": " OR ".join(
    f"coalesce(length({c}) BETWEEN 1 AND 2, false)"
    for c in ("customer_name", "email", "phone", "ssn", "segment", "note", "abbr"))},
    flag_column="to_enrich")


@query("fix_profile_baseline", """
SELECT 'lock_profiling_baseline' AS action, CAST(count(*) AS BIGINT) AS rows, 'ALL' AS column_name FROM dirty_orders""")
def fix_profile_baseline(spark, sf_dir):
    fixed = apply_fix(view(spark, sf_dir, O), "profiling", context())
    action, column = fixed.log.select("action", "column_name").first()
    return fixed.df.agg(F.lit(action).alias("action"), F.count(F.lit(1)).alias("rows"),
                        F.lit(column).alias("column_name"))


# --- golden records ----------------------------------------------------------------------------------

GOLD = ["customer_name", "email", "phone", "age", "balance"]


@query("fix_golden_record", "SELECT customer_id, min(row_key) AS row_key, " + ", ".join(
    f"arg_min({c}, row_key) FILTER (WHERE {c} IS NOT NULL) AS {c}" for c in GOLD)
    + " FROM dirty_customers GROUP BY customer_id")
def fix_golden_record(spark, sf_dir):
    fixed = apply_fix(view(spark, sf_dir, C), "survivorship", context())
    return fixed.df.select("customer_id", "row_key", *GOLD)


@query("fix_golden_record_log", """
SELECT 'golden_record_generation' AS action, 'customer_id' AS column_name,
 CAST(count(*) - count(DISTINCT customer_id) AS BIGINT) AS rows_affected FROM dirty_customers""")
def fix_golden_record_log(spark, sf_dir):
    return apply_fix(view(spark, sf_dir, C), "survivorship", context()).log.select(
        "action", "column_name", "rows_affected")


@query("fix_golden_record_null_keys", """
SELECT row_key, supplier_id, supplier_name, order_date FROM dirty_orders WHERE supplier_id IS NULL
UNION ALL SELECT min(row_key), supplier_id, arg_min(supplier_name, row_key), arg_min(order_date, row_key)
FROM dirty_orders WHERE supplier_id IS NOT NULL GROUP BY supplier_id""")
def fix_golden_record_null_keys(spark, sf_dir):
    df = view(spark, sf_dir, O).select("row_key", "supplier_id", "supplier_name", "order_date")
    return entities.golden_records(df, "supplier_id", "row_key")


# --- personal data ------------------------------------------------------------------------------------

MASK = ("CASE WHEN length({0}) > 4 THEN left({0}, 2) || repeat('*', CAST(length({0}) - 4 AS INT)) || right({0}, 2) "
        "WHEN {0} IS NOT NULL THEN '****' END")


@query("fix_pii_plan", f"""
SELECT row_key, upper(substr(sha256(email), 1, 16)) AS email, {MASK.format('phone')} AS phone,
 CAST(NULL AS VARCHAR) AS ssn, CASE WHEN customer_name IS NOT NULL THEN '[REDACTED]' END AS customer_name
FROM dirty_customers""")
def fix_pii_plan(spark, sf_dir):
    plan = {"email": "Encryption", "phone": "Masking", "ssn": "remove", "customer_name": "redact"}
    return apply_fix(view(spark, sf_dir, C), "pii_security", context(fields=plan)).df.select(
        "row_key", "email", "phone", "ssn", "customer_name")


@query("fix_pii_mask_parity", f"""
SELECT row_key, coalesce({MASK.format('email')}, '****') AS email, '[REDACTED]' AS note FROM dirty_customers""")
def fix_pii_mask_parity(spark, sf_dir):
    out, _, _ = privacy.protect(view(spark, sf_dir, C), {"email": "mask", "note": "redact"}, "row_key",
                                parity=True)
    return out.select("row_key", "email", "note")


TOKEN = """(SELECT segment AS value, 'TOKEN-SEGM-' || lpad(CAST(row_number() OVER (ORDER BY min(row_key)) AS VARCHAR), 6, '0') AS token
 FROM dirty_customers GROUP BY segment)"""


@query("fix_pii_tokenize", f"""
SELECT row_key, token AS segment FROM dirty_customers JOIN {TOKEN} t ON segment = value""")
def fix_pii_tokenize(spark, sf_dir):
    out, _, _ = privacy.protect(view(spark, sf_dir, C), {"segment": "tokenize"}, "row_key")
    return out.select("row_key", "segment")


@query("fix_pii_token_map", """
SELECT email AS value, 'TOKEN-EMAI-' || lpad(CAST(row_number() OVER (ORDER BY min(row_key)) AS VARCHAR), 6, '0') AS token
FROM dirty_customers WHERE email IS NOT NULL GROUP BY email""")
def fix_pii_token_map(spark, sf_dir):
    df = view(spark, sf_dir, C).select("row_key", "email")
    return privacy.tokens(df, "email", "row_key").select("value", "token")


@query("fix_pii_default_mode", """
SELECT row_key, upper(substr(sha256(customer_name), 1, 16)) AS customer_name,
 upper(substr(sha256(email), 1, 16)) AS email, upper(substr(sha256(phone), 1, 16)) AS phone,
 upper(substr(sha256(ssn), 1, 16)) AS ssn FROM dirty_customers""")
def fix_pii_default_mode(spark, sf_dir):
    out, _, _ = privacy.protect(view(spark, sf_dir, C), {}, "row_key", default_mode="hash")
    return out.select("row_key", "customer_name", "email", "phone", "ssn")


@query("pii_masking_log", """
SELECT 7::BIGINT AS run_id, 'finance' AS domain, 'email' AS pii_field, 'hash' AS masking_mode,
 CAST(count(email) AS BIGINT) AS rows_masked FROM dirty_customers
UNION ALL SELECT 7, 'finance', 'phone', 'mask', CAST(count(phone) AS BIGINT) FROM dirty_customers""")
def pii_masking_log(spark, sf_dir):
    _, log, _ = privacy.protect(view(spark, sf_dir, C), {"email": "hash", "phone": "mask"}, "row_key")
    return history.masking_log(log, 7, "finance", "2026-01-01T00:00:00").drop("masked_at")


# --- chains ----------------------------------------------------------------------------------------------

@query("fix_low_risk", f"""
SELECT row_key, {TITLE.format('supplier_name')} AS supplier_name,
 {CANON.replace('ELSE status', 'ELSE trim(status)')} AS status, round({NEW_TOTAL}, 6) AS total_amount FROM {O}""")
def fix_low_risk(spark, sf_dir):
    fixed = remediation.apply_low_risk(view(spark, sf_dir, O), context())
    return fixed.df.select("row_key", "supplier_name", "status", F.round("total_amount", 6).alias("total_amount"))


@query("fix_chain_log", log_sql(O, [
    ("nullify_out_of_range", "quantity", "quantity < 1"),
    ("standardize_enum", "status", f"status <> {CANON}"),
    ("standardize_enum", "quality_check", "quality_check = 'PASS'"),
    ("recalculate_total", "total_amount", f"quantity >= 1 AND {TOTAL_OFF}"),
    ("populate_audit_timestamps", "last_updated", "last_updated IS NULL"),
    ("inject_audit_column", "created_at", "true")]))
def fix_chain_log(spark, sf_dir):
    fixed = remediation.apply_all(view(spark, sf_dir, O), ["validity", "consistency", "auditability"],
                                  context())
    return fixed.log.select("action", "column_name", "rows_affected")
