"""Reading, writing and fault injection."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.functions import fixed_values as fv
from plumbline.operators import checks
from plumbline.operators.table import Table
from plumbline.plans import history
from plumbline.session import shared_folder
from plumbline.sources import faults, readers, writers
from plumbline.streaming import monitor

from .detect import C, L, O, S
from .inputs import AS_OF, TABLES, table, view
from .registry import query

# --- reading -----------------------------------------------------------------------------------------


@query("csv_scan", "SELECT p_partkey, p_name, p_size, p_retailprice FROM part")
def csv_scan(spark, sf_dir):
    path = f"{shared_folder(spark)}/part.csv"
    table(spark, sf_dir, "part").write.option("header", True).csv(path)
    return readers.read_file(spark, path).select("p_partkey", "p_name", F.col("p_size").cast("int").alias("p_size"),
                                                 "p_retailprice")


@query("csv_null_tokens", """
SELECT row_key, CASE WHEN segment <> 'N/A' THEN segment END AS segment,
 CASE WHEN row_key % 7 <> 0 THEN age END AS age FROM dirty_customers""")
def csv_null_tokens(spark, sf_dir):
    path = f"{shared_folder(spark)}/customers.csv"
    (view(spark, sf_dir, C).selectExpr("row_key", "segment",
                                       "CASE WHEN row_key % 7 = 0 THEN 'NULL' ELSE CAST(age AS STRING) END AS age")
     .write.option("header", True).csv(path))
    return readers.read_csv(spark, path).select("row_key", "segment", F.col("age").cast("int").alias("age"))


@query("parquet_scan", """
SELECT l_returnflag, CAST(count(*) AS BIGINT) AS rows, round(sum(l_quantity), 2) AS quantity FROM lineitem
WHERE l_quantity > 25 GROUP BY l_returnflag""")
def parquet_scan(spark, sf_dir):
    df = readers.read_file(spark, f"{sf_dir}/lineitem.parquet")
    return df.where("l_quantity > 25").groupBy("l_returnflag").agg(
        F.count(F.lit(1)).alias("rows"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


@query("jsonl_scan", "SELECT conv_id, turn, role FROM conversations")
def jsonl_scan(spark, sf_dir):
    path = f"{shared_folder(spark)}/conversations.jsonl"
    table(spark, sf_dir, "conversations").write.json(path)
    schema = table(spark, sf_dir, "conversations").schema
    return readers.read_file(spark, path, schema=schema).select("conv_id", "turn", "role")


PAGE = ("to_json(named_struct('meta', named_struct('page', any_value(page)), 'data', named_struct('records', "
        "collect_list(named_struct('Id', c_custkey, 'Full Name', c_name, 'geo-info', "
        "named_struct('nation', c_nationkey, 'segment', c_mktsegment))))))")


def _land_pages(spark, sf_dir) -> str:
    """Customers as landed API pages, one JSON document of 100 records each."""
    path = f"{shared_folder(spark)}/pages"
    customers = table(spark, sf_dir, "customer").withColumn("page", F.expr("c_custkey div 100"))
    customers.groupBy("page").agg(F.expr(PAGE).alias("value")) \
        .select("value").write.text(path)
    return path


@query("json_pages", """
SELECT c_custkey AS id, c_name AS full_name, c_nationkey AS geo_info_nation, c_mktsegment AS geo_info_segment FROM customer""")
def json_pages(spark, sf_dir):
    path = _land_pages(spark, sf_dir)
    pages = readers.read_json(spark, path, multi_line=False)
    records = readers.clean_names(readers.flatten(readers.records_at(pages, "data.records")))
    return records.select("id", "full_name", F.col("geo_info_nation").cast("int").alias("geo_info_nation"),
                          "geo_info_segment")


@query("json_properties", """
SELECT event_type, CAST(count(*) AS BIGINT) AS events, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS total
FROM events GROUP BY event_type""")
def json_properties(spark, sf_dir):
    parsed = table(spark, sf_dir, "events").withColumn("data", F.from_json("props", "k BIGINT"))
    flat = readers.flatten(parsed.select("event_type", "data"))
    return flat.groupBy("event_type").agg(F.count(F.lit(1)).alias("events"),
                                          F.sum("data_k").alias("total"))


@query("page_concat", """
SELECT region, CAST(count(*) AS BIGINT) AS rows, CAST(count(c_acctbal) AS BIGINT) AS with_balance FROM (
 SELECT 'customer' AS region, c_acctbal FROM customer UNION ALL SELECT 'supplier', NULL FROM supplier) GROUP BY region""")
def page_concat(spark, sf_dir):
    pages = [table(spark, sf_dir, "customer").select(F.lit("customer").alias("region"), "c_acctbal"),
             table(spark, sf_dir, "supplier").select(F.lit("supplier").alias("region"), "s_name")]
    return readers.combine_pages(pages).groupBy("region").agg(
        F.count(F.lit(1)).alias("rows"), F.count("c_acctbal").alias("with_balance"))


@query("page_concat_capped", "SELECT CAST(least(50000, count(*)) AS BIGINT) AS rows FROM lineitem")
def page_concat_capped(spark, sf_dir):
    capped = readers.combine_pages([table(spark, sf_dir, "lineitem")], 50_000)
    return capped.agg(F.count(F.lit(1)).alias("rows"))


@query("catalog_tables", " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, CAST(count(*) AS BIGINT) AS rows FROM {t}" for t in TABLES))
def catalog_tables(spark, sf_dir):
    for t in TABLES:
        table(spark, sf_dir, t).createOrReplaceTempView(t)
    out = None
    for name in [n for n in readers.list_tables(spark) if n in TABLES]:
        part = spark.table(name).agg(F.lit(name).alias("table_name"), F.count(F.lit(1)).alias("rows"))
        out = part if out is None else out.unionByName(part)
    return out


@query("source_descriptor", """
SELECT 'flat_file' AS source_type, 'orders.parquet' AS label, 'PARQUET' AS file_type, false AS remote,
 CAST(count(*) AS BIGINT) AS rows FROM orders""")
def source_descriptor(spark, sf_dir):
    path = f"{sf_dir}/orders.parquet"
    rows = readers.read_file(spark, path).count()
    return readers.describe(spark, "flat_file", path).select(
        "source_type", "label", "file_type", "remote", F.lit(rows).cast("bigint").alias("rows"))


@query("frame_source", """
SELECT CAST(count(*) AS BIGINT) AS rows, CAST(count(l_discount) AS BIGINT) AS filled FROM (
 SELECT CASE WHEN l_linenumber = 3 THEN NULL ELSE l_discount END AS l_discount FROM lineitem)""")
def frame_source(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").selectExpr(
        "CASE WHEN l_linenumber = 3 THEN double('NaN') ELSE l_discount END AS l_discount")
    return readers.from_frame(df).agg(F.count(F.lit(1)).alias("rows"), F.count("l_discount").alias("filled"))


# --- writing ------------------------------------------------------------------------------------------

@query("csv_export", "SELECT row_key, order_id, quantity FROM dirty_orders")
def csv_export(spark, sf_dir):
    df = view(spark, sf_dir, O).select("row_key", "order_id", "quantity")
    path = writers.write_csv(df, shared_folder(spark), "supply_chain", "20260101_000000")
    return readers.read_csv(spark, path, schema=df.schema)


@query("xml_export", "SELECT row_key, service_date, technician FROM dirty_services")
def xml_export(spark, sf_dir):
    df = view(spark, sf_dir, S).select("row_key", "service_date", "technician")
    path = writers.write_xml(df, f"{shared_folder(spark)}/services.xml")
    return (spark.read.format("xml").option("rowTag", "record").option("nullValue", "")
            .schema(df.schema).load(path))


@query("bundle_export", """
SELECT 'raw' AS part, CAST(count(*) AS BIGINT) AS rows FROM dirty_claims
UNION ALL SELECT 'cleaned', CAST(count(*) AS BIGINT) FROM dirty_claims WHERE premium > 0
UNION ALL SELECT 'change_log', 1""")
def bundle_export(spark, sf_dir):
    raw = view(spark, sf_dir, L)
    log = raw.agg(F.lit("drop").alias("action"), F.count_if(F.expr("premium <= 0")).alias("rows_affected"))
    paths = writers.write_bundle(raw, raw.where("premium > 0"), log, shared_folder(spark))
    out = None
    for part, path in paths.items():
        n = spark.read.parquet(path).agg(F.lit(part).alias("part"), F.count(F.lit(1)).alias("rows"))
        out = n if out is None else out.unionByName(n)
    return out


@query("drilldown_export", """
SELECT dimension, CAST(count(*) AS BIGINT) AS rows, CAST(sum(affected_rows) AS BIGINT) AS affected FROM issue_log
WHERE dimension = 'validity' GROUP BY dimension""")
def drilldown_export(spark, sf_dir):
    issues = view(spark, sf_dir, "issue_log")
    path = writers.write_drilldown(issues, "validity", shared_folder(spark))
    return readers.read_csv(spark, path, schema=issues.schema).groupBy("dimension").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("affected_rows").alias("affected"))


@query("history_append", """
SELECT domain, CAST(2 * count(*) AS BIGINT) AS runs, CAST(max(run_id) AS BIGINT) AS last_run FROM analysis_runs GROUP BY domain""")
def history_append(spark, sf_dir):
    store = history.Store(spark, shared_folder(spark))
    runs = view(spark, sf_dir, "analysis_runs")
    store.append("analysis_runs", runs)
    store.append("analysis_runs", runs)
    return store.read("analysis_runs").groupBy("domain").agg(
        F.count(F.lit(1)).alias("runs"), F.max("run_id").alias("last_run"))


# --- faults --------------------------------------------------------------------------------------------

def _u(key: str, label: str) -> str:
    return f"(CAST('0x' || substr(md5(CAST({key} AS VARCHAR) || '|{label}'), 1, 8) AS BIGINT) / 4294967296.0)"


@query("inject_nulls", f"""
SELECT o_orderkey, CASE WHEN {_u('o_orderkey', 'null o_orderstatus')} >= 0.12 THEN o_orderstatus END AS o_orderstatus FROM orders""")
def inject_nulls(spark, sf_dir):
    df = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    return faults.inject_nulls(df, "o_orderstatus", 0.12, "o_orderkey")


@query("corrupt_values", f"""
SELECT c_custkey, CASE WHEN {_u('c_custkey', 'corrupt c_mktsegment')} < 0.08 THEN lower(c_mktsegment) ELSE c_mktsegment END AS c_mktsegment FROM customer""")
def corrupt_values(spark, sf_dir):
    df = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    return faults.corrupt(df, "c_mktsegment", 0.08, "c_custkey", F.lower)


@query("append_copies", f"""
SELECT o_orderkey, o_orderkey AS copy_of FROM orders
UNION ALL SELECT o_orderkey + 1000000000, o_orderkey FROM orders WHERE {_u('o_orderkey', 'copy')} < 0.06""")
def append_copies(spark, sf_dir):
    df = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderkey").alias("copy_of"))
    return faults.append_copies(df, 0.06, "o_orderkey", {"o_orderkey": F.col("o_orderkey") + 1_000_000_000})


@query("domain_supply_chain", f"""
SELECT 'ORD-' || lpad(CAST(o_orderkey AS VARCHAR), 8, '0') AS order_id,
 CASE WHEN {_u('o_orderkey', 'zero')} < 0.02 THEN 0 ELSE CAST(floor({_u('o_orderkey', 'qty')} * 5000) + 1 AS BIGINT) END AS ordered,
 CASE WHEN {_u('o_orderkey', 'null inspector')} >= 0.15 THEN 1 ELSE 0 END AS inspected FROM orders
UNION ALL SELECT 'ORD-' || CAST(o_orderkey + 1000000000 AS VARCHAR),
 CASE WHEN {_u('(o_orderkey + 1000000000)', 'zero')} < 0.02 THEN 0 ELSE CAST(floor({_u('o_orderkey', 'qty')} * 5000) + 1 AS BIGINT) END,
 CASE WHEN {_u('o_orderkey', 'null inspector')} >= 0.15 THEN 1 ELSE 0 END FROM orders WHERE {_u('o_orderkey', 'copy')} < 0.05""")
def domain_supply_chain(spark, sf_dir):
    t = faults.domain_table("supply_chain", table(spark, sf_dir, "orders"), "o_orderkey")
    return t.select("order_id", F.abs("quantity").alias("ordered"),
                    F.col("inspector").isNotNull().cast("int").alias("inspected"))


# The faults of the other domains: the columns they change, restated over (key, own), where a copy has a
# key of its own. Values are drawn by ``key``, faults after the copying by ``own``.
def _rows(base: str, key: str, rate: float) -> str:
    return (f"WITH r AS (SELECT {key} AS key, {key} AS own FROM {base} "
            f"UNION ALL SELECT {key}, {key} + 1000000000 FROM {base} WHERE {_u(key, 'copy')} < {rate})")


def _one_of(key: str, label: str, values: list) -> str:
    shown = ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in values)
    return f"([{shown}])[CAST(floor({_u(key, label)} * {len(values)}) + 1 AS BIGINT)]"


def _spelled(column: str, value: str, rate: float, spellings: dict) -> str:
    cases = " ".join(f"WHEN {value} = '{v}' THEN {_one_of('own', f'spelling {column}', others)}" for v, others in spellings.items())
    return f"CASE WHEN {_u('own', f'corrupt {column}')} >= {rate} THEN {value} {cases} ELSE {value} END"


def _number(key: str, label: str, low: int, high: int) -> str:
    return f"CAST(floor({_u(key, label)} * {high - low + 1}) + {low} AS BIGINT)"


def _day(key: str, label: str, first: str, days: int) -> str:
    return f"(DATE '{first}' + CAST({_number(key, label, 0, days)} AS INT))"


def _money(key: str, label: str, low: float, high: float, places: int = 2) -> str:
    return f"round({_u(key, label)}::DOUBLE * ({high} - {low})::DOUBLE + {low}, {places})"


def _changed(column: str, rate: float, new: str, old: str, key: str = "own") -> str:
    return f"CASE WHEN {_u(key, f'corrupt {column}')} < {rate} THEN {new} ELSE {old} END"


def _kept(column: str, rate: float, value: str, key: str = "key") -> str:
    return f"CASE WHEN {_u(key, f'null {column}')} >= {rate} THEN {value} END"


_padded = "lpad(CAST({0} AS VARCHAR), CAST(greatest({1}, length(CAST({0} AS VARCHAR))) AS INT), '0')".format


def _mail(key: str, label: str) -> str:
    return f"lower({_one_of(key, f'{label} first', faults.FIRST)}) || '.' || {key} || '@example.org'"


_admitted = _day("key", "admitted", "2020-01-01", 1800)
_layout = _number("own", "layout admission_date", 0, 2)
_care = _spelled("status", _one_of("key", "status", ["Active", "Discharged", "Deceased", "Transferred"]), 0.06, fv.FAULT_SPELLINGS["care_status"])


@query("domain_healthcare", f"""{_rows('events', 'event_id', 0.06)}
SELECT own AS row_key,
 CASE WHEN {_u('own', 'same patient')} < 0.02 THEN 'PAT-' || {_padded(f"((SELECT min(event_id) FROM events) + CAST(floor({_u('own', 'patient taken')} * least(100, (SELECT count(*) FROM events))) AS BIGINT))", 6)}
  ELSE 'PAT-' || {_padded('own', 6)} END AS patient_id,
 CASE WHEN {_u('own', 'same patient')} < 0.02 THEN {_mail('own', 'other patient')} ELSE {_kept('email', 0.05, _mail('key', 'patient'))} END AS email,
 CASE WHEN {_u('own', 'same patient')} < 0.02 THEN {_one_of('own', 'other status', ['Active', 'Transferred'])} ELSE {_care} END AS status,
 {_spelled('gender', _one_of('key', 'gender', ['Male', 'Female', 'Other']), 0.08, fv.FAULT_SPELLINGS['gender'])} AS gender,
 {_changed('admission_date', 0.07, f"CASE {_layout} WHEN 0 THEN strftime({_admitted}, '%m/%d/%Y') WHEN 1 THEN strftime({_admitted}, '%d-%m-%Y') ELSE strftime({_admitted}, '%B %d, %Y') END", f"CAST({_admitted} AS VARCHAR)")} AS admission_date,
 {_changed('discharge_date', 0.03, f"CAST({_day('own', 'early discharge', '2018-06-01', 365)} AS VARCHAR)", f"CAST({_admitted} + CAST({_number('key', 'stay', 0, 30)} AS INT) AS VARCHAR)")} AS discharge_date,
 {_changed('bill_amount', 0.02, _one_of('own', 'bad bill', fv.FAULT_BILLS) + '::DOUBLE', _money('key', 'bill', 500, 250000))} AS bill_amount,
 {_kept('diagnosis_code', 0.12, _one_of('key', 'diagnosis', ['J18.9', 'I21.0', 'E11.9', 'J44.1', 'C34.1']))} AS diagnosis_code
FROM r""")
def domain_healthcare(spark, sf_dir):
    return faults.domain_table("healthcare", table(spark, sf_dir, "events"), "event_id").select(
        "row_key", "patient_id", "email", "status", "gender", "admission_date", "discharge_date", "bill_amount", "diagnosis_code")


_amount = _money("key", "amount", 0.5, 15000)
_type = _one_of("key", "type", ["Credit", "Debit", "Transfer", "Refund", "Fee"])


@query("domain_finance", f"""{_rows('orders', 'o_orderkey', 0.08)},
 w AS (SELECT o_orderkey AS key, row_number() OVER (ORDER BY o_orderkey) - 1 AS i, count(*) OVER () AS n, min(o_orderkey) OVER () AS low, max(o_orderkey) OVER () AS high FROM orders),
 i AS (SELECT key, i, n, CASE WHEN high - low + 1 = n THEN low ELSE 0 END AS low, greatest(1, CAST(floor(n * 0.6180339887498949::DOUBLE) AS BIGINT)) AS step FROM w)
SELECT own AS row_key, 'TXN-' || {_padded('(CASE WHEN own = key THEN low + i ELSE low + (i + step) % n END)', 8)} AS transaction_id,
 {_kept('account_id', 0.07, f"'ACC-' || {_number('key', 'acc', 1000000, 9999999)}")} AS account_id,
 {_spelled('currency', _one_of('key', 'cur', ['USD', 'EUR', 'GBP', 'JPY', 'CAD']), 0.07, fv.FAULT_SPELLINGS['currency'])} AS currency,
 {_changed('transaction_date', 0.03, f"CAST({_day('own', 'ahead', '2030-01-01', 364)} AS VARCHAR)", f"CAST({_day('key', 'date', '2020-01-01', 1800)} AS VARCHAR)")} AS transaction_date,
 CASE WHEN {_u('own', 'dollar')} < 0.05 THEN 1 ELSE 0 END AS has_dollar,
 {_changed('number', 0.02, '0.0::DOUBLE', f"CASE WHEN {_u('own', 'negative')} < 0.04 AND {_type} = 'Credit' THEN -{_amount} ELSE {_amount} END")} AS number,
 {_spelled('status', _one_of('key', 'status', ['Completed', 'Pending', 'Failed', 'Reversed']), 0.06, fv.FAULT_SPELLINGS['payment_state'])} AS status
FROM r JOIN i USING (key)""")
def domain_finance(spark, sf_dir):
    t = faults.domain_table("finance", table(spark, sf_dir, "orders"), "o_orderkey")
    amount = F.col("amount")
    return t.select("row_key", "transaction_id", "account_id", "currency", "transaction_date",
                    amount.startswith("$").cast("int").alias("has_dollar"),
                    F.regexp_replace(amount, "[$]", "").cast("double").alias("number"), "status")


_coverage = _money("key", "coverage", 10000, 2000000)


@query("domain_insurance", f"""{_rows('customer', 'c_custkey', 0.06)}
SELECT own AS row_key, 'POL-' || {_padded('own', 7)} AS policy_id,
 round({_changed('claim_amount', 0.05, f"{_coverage} * {_money('own', 'exceeds', 1.1, 3.0, 4)}", f"round({_coverage} * {_u('key', 'claim')}::DOUBLE * 0.8, 2)")}, 2) AS claim_amount,
 {_changed('policy_end', 0.03, f"CAST({_day('own', 'early end', '2016-06-01', 365)} AS VARCHAR)", f"CAST({_day('key', 'start', '2019-01-01', 1800)} + 730 AS VARCHAR)")} AS policy_end,
 CASE WHEN {_u('key', 'null zip_code')} < 0.05 THEN NULL WHEN {_u('own', 'corrupt zip_code')} < 0.04 THEN {_one_of('own', 'bad zip', fv.FAULT_ZIPS)} ELSE CAST({_number('key', 'zip', 10000, 99999)} AS VARCHAR) END AS zip_code,
 {_spelled('policy_type', _one_of('key', 'type', ['Health', 'Life', 'Auto', 'Home', 'Commercial']), 0.07, fv.FAULT_SPELLINGS['policy_type'])} AS policy_type,
 {_changed('last_updated', 0.1, f"CAST({_day('own', 'stale', '2021-01-01', 900)} AS VARCHAR)", f"CAST({_day('key', 'updated', '2024-01-01', 700)} AS VARCHAR)")} AS last_updated
FROM r""")
def domain_insurance(spark, sf_dir):
    t = faults.domain_table("insurance", table(spark, sf_dir, "customer"), "c_custkey")
    return t.select("row_key", "policy_id", F.round("claim_amount", 2).alias("claim_amount"), "policy_end", "zip_code",
                    "policy_type", "last_updated")


_parts, _labor = _money("key", "parts", 0, 2000), _money("key", "labor", 50, 1500)


@query("domain_automotive", f"""{_rows('part', 'p_partkey', 0.06)}
SELECT own AS row_key, 'SVC-' || {_padded('own', 8)} AS service_id, 'VEH-' || {_padded('key', 6)} AS vehicle_id,
 {_changed('vin', 0.06, _one_of('key', 'bad vin', fv.FAULT_VINS), "translate(upper(substr(md5(CAST(key AS VARCHAR)), 1, 17)), 'IOQ', 'JPR')", 'key')} AS vin,
 {_changed('mileage', 0.02, f"-{_number('key', 'mileage', 0, 250000)}", _number('key', 'mileage', 0, 250000))} AS mileage,
 {_changed('service_date', 0.03, f"CAST({_day('own', 'ahead', '2030-01-01', 179)} AS VARCHAR)", f"CAST({_day('key', 'service', '2021-01-01', 1500)} AS VARCHAR)")} AS service_date,
 {_changed('year', 0.01, _one_of('own', 'bad year', fv.FAULT_YEARS) + '::BIGINT', _number('key', 'year', 1995, 2024))} AS year,
 {_u('own', 'corrupt cost')} < 0.07 AS wrong_cost, {_kept('technician', 0.08, "'x'", 'own')} IS NULL AS no_technician
FROM r""")
def domain_automotive(spark, sf_dir):
    t = faults.domain_table("automotive", table(spark, sf_dir, "part"), "p_partkey")
    right = F.round(F.col("parts_cost") + F.col("labor_cost"), 2)
    return t.select("row_key", "service_id", "vehicle_id", "vin", "mileage", "service_date", "year",
                    (F.abs(F.col("cost") - right) > 0.001).alias("wrong_cost"), F.col("technician").isNull().alias("no_technician"))


# --- rules per time window ---------------------------------------------------------------------------------


@query("violation_rates_by_day", """
SELECT date_trunc('day', ts) AS start, CAST(count(*) AS BIGINT) AS rows, 'range_violation' AS issue_type,
 'quantity' AS column_name, CAST(count(*) FILTER (WHERE event_id % 70 - 5 < 1) AS BIGINT) AS affected_rows,
 round(count(*) FILTER (WHERE event_id % 70 - 5 < 1) * 1.0 / count(*), 6) AS affected_pct FROM events GROUP BY ALL""")
def violation_rates_by_day(spark, sf_dir):
    t = Table(table(spark, sf_dir, "events").selectExpr("ts", "event_id % 70 - 5 AS quantity"))
    out = monitor.violation_rates(t, checks.validity(t, AS_OF), "ts", "1 day")
    return out.withColumn("affected_pct", F.round("affected_pct", 6)).withColumn(
        "start", F.col("start").cast("timestamp_ntz"))
