"""Test tables with known faults, as Spark jobs over any keyed table.

Every draw is a hash of the row key and a label, not a random number: the same row gets the same
value and the same faults on any cluster, after any lost executor, and in SQL.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import fixed_values as fv
from ..operators.ordering import with_row_number

KEY = "__key"
NUMBER = "__number"
RANGE = 4294967296.0


def draw(label: str, key: str = KEY) -> Column:
    """A number in [0, 1) that depends on the row key and the label only."""
    text = F.concat(F.col(key).cast("string"), F.lit("|" + label))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / RANGE


def hit(label: str, rate: float, key: str = KEY) -> Column:
    return draw(label, key) < rate


def inject_nulls(df: DataFrame, column: str, rate: float, key: str) -> DataFrame:
    return df.withColumn(column, F.when(~hit(f"null {column}", rate, key), F.col(column)))


def corrupt(df: DataFrame, column: str, rate: float, key: str, change) -> DataFrame:
    """Apply ``change(column)`` to a share of the non-null values."""
    where = F.col(column).isNotNull() & hit(f"corrupt {column}", rate, key)
    return df.withColumn(column, F.when(where, change(F.col(column))).otherwise(F.col(column)))


def append_copies(df: DataFrame, rate: float, key: str, rekey: dict[str, Column]) -> DataFrame:
    """Add copies of a share of the rows, with new values for the columns in ``rekey``."""
    return df.unionByName(df.where(hit("copy", rate, key)).withColumns(rekey))


def respell(df: DataFrame, column: str, rate: float, spellings: dict[str, list[str]]) -> DataFrame:
    """Another spelling for a share of the values that have one."""
    return corrupt(df, column, rate, KEY, lambda c: F.coalesce(*[
        F.when(c == value, pick(f"spelling {column}", others)) for value, others in spellings.items()], c))


def relayout(df: DataFrame, column: str, rate: float) -> DataFrame:
    """Another layout for a share of the dates."""
    place = whole(f"layout {column}", 0, len(fv.FAULT_DATE_LAYOUTS) - 1)
    return corrupt(df, column, rate, KEY, lambda c: F.coalesce(*[
        F.when(place == i, F.date_format(c.try_cast("date"), layout))
        for i, layout in enumerate(fv.FAULT_DATE_LAYOUTS)], c))


def numbered(df: DataFrame, key: str) -> tuple[DataFrame, int, int]:
    """``df`` with a dense row number, the first number and the rows. Keys without gaps are the numbers;
    others are numbered in their order, in parallel."""
    low, high, n = df.agg(F.min(key), F.max(key), F.count(F.lit(1))).first()
    if n and high - low + 1 == n:
        return df.withColumn(NUMBER, F.col(key)), low, n
    return with_row_number(df, [key], NUMBER), 0, n


def other_number(low: int, n: int) -> Column:
    """The number of another row: a rotation of all numbers, so every row is another's at most once."""
    step = max(1, math.floor(n * 0.6180339887498949))
    return (F.col(NUMBER) - low + step) % max(n, 1) + low


# --- value makers -----------------------------------------------------------------------------------

def code(prefix: str, width: int, shift: int = 0, number: Column | None = None) -> Column:
    """The key, or another number, with leading zeros up to ``width`` digits; longer ones are kept whole."""
    digits = ((F.col(KEY) if number is None else number) + shift).cast("string")
    return F.concat(F.lit(prefix), F.when(F.length(digits) < width, F.lpad(digits, width, "0"))
                    .otherwise(digits))


def whole(label: str, low: int, high: int) -> Column:
    return (F.floor(draw(label) * (high - low + 1)) + low).cast("bigint")


def real(label: str, low: float, high: float, places: int = 2) -> Column:
    return F.round(draw(label) * (high - low) + low, places)


def pick(label: str, values: list[str]) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), whole(label, 1, len(values)).cast("int"))


def day(label: str, first: str, days: int) -> Column:
    return F.date_add(F.lit(first).cast("date"), whole(label, 0, days).cast("int"))


def text_of(date: Column) -> Column:
    return F.date_format(date, "yyyy-MM-dd")


FIRST = ["Ada", "Ben", "Cleo", "Dan", "Eva", "Finn", "Gina", "Hugo", "Iris", "Jan"]
LAST = ["Abel", "Berg", "Cole", "Diaz", "Egan", "Ford", "Gray", "Hill", "Ivey", "Jones"]


def person(label: str) -> Column:
    return F.concat_ws(" ", pick(f"{label} first", FIRST), pick(f"{label} last", LAST))


def mail(label: str) -> Column:
    return F.concat(F.lower(pick(f"{label} first", FIRST)), F.lit("."), F.col(KEY).cast("string"),
                    F.lit("@example.org"))


def phone(label: str) -> Column:
    return F.concat(F.lit("555-"), whole(f"{label} a", 100, 999).cast("string"), F.lit("-"),
                    whole(f"{label} b", 1000, 9999).cast("string"))


def ssn(label: str) -> Column:
    return F.concat_ws("-", whole(f"{label} a", 100, 999).cast("string"),
                       whole(f"{label} b", 10, 99).cast("string"),
                       whole(f"{label} c", 1000, 9999).cast("string"))


def _base(df: DataFrame, key: str) -> DataFrame:
    return df.select(F.col(key).cast("bigint").alias(KEY))


def _nulls(df: DataFrame, domain: str) -> DataFrame:
    for column, rate in fv.FAULT_NULLS[domain].items():
        df = inject_nulls(df, column, rate, KEY)
    return df


def _done(df: DataFrame, drop: list[str] = ()) -> DataFrame:
    return df.withColumnRenamed(KEY, "row_key").drop(*drop)


def _mix_case(df: DataFrame, column: str, rate: float) -> DataFrame:
    return corrupt(df, column, rate, KEY, lambda c: F.when(
        draw(f"case {column}") < 0.5, F.lower(c)).otherwise(F.upper(c)))


# --- the five domains ----------------------------------------------------------------------------------

def healthcare(df: DataFrame, key: str, shift: int) -> DataFrame:
    """``shift`` exceeds every key; copies get their key plus it."""
    born, admitted = day("born", "1930-01-01", 33000), day("admitted", "2020-01-01", 1800)
    t = _base(df, key).select(
        KEY, code("PAT-", 6).alias("patient_id"), person("patient").alias("patient_name"),
        text_of(born).alias("date_of_birth"),
        F.floor(F.months_between(F.lit("2025-01-01").cast("date"), born) / 12).alias("age"),
        pick("gender", ["Male", "Female", "Other"]).alias("gender"), ssn("ssn").alias("ssn"),
        mail("patient").alias("email"), phone("phone").alias("phone"),
        F.concat(whole("house", 1, 99).cast("string"), F.lit(" Oak Street")).alias("address"),
        whole("zip", 10000, 99999).cast("string").alias("zip_code"),
        text_of(admitted).alias("admission_date"),
        text_of(F.date_add(admitted, whole("stay", 0, 30).cast("int"))).alias("discharge_date"),
        pick("diagnosis", ["J18.9", "I21.0", "E11.9", "J44.1", "C34.1"]).alias("diagnosis_code"),
        F.lit("ICD-10").alias("icd_version"),
        pick("treatment", ["Medication", "Surgery", "Therapy", "Observation"]).alias("treatment"),
        person("physician").alias("physician_name"),
        F.concat(F.lit("INS-"), whole("ins", 100000, 999999).cast("string")).alias("insurance_id"),
        real("bill", 500, 250000).alias("bill_amount"),
        pick("paid", ["Paid", "Pending", "Partial", "Denied"]).alias("payment_status"),
        pick("status", ["Active", "Discharged", "Deceased", "Transferred"]).alias("status"),
        text_of(day("updated", "2023-01-01", 1000)).alias("last_updated"))
    t = _nulls(t, "healthcare")
    t = append_copies(t, fv.FAULT_COPIES["healthcare"], KEY, {KEY: F.col(KEY) + shift, "patient_id": code("PAT-", 6, shift)})
    t = corrupt(t, "age", 0.02, KEY, lambda c: pick("bad age", fv.FAULT_AGES).cast("bigint"))
    t = respell(t, "gender", 0.08, fv.FAULT_SPELLINGS["gender"])
    t = respell(t, "status", 0.06, fv.FAULT_SPELLINGS["care_status"])
    t = relayout(t, "admission_date", 0.07)
    t = corrupt(t, "discharge_date", 0.03, KEY, lambda c: text_of(day("early discharge", "2018-06-01", 365)))
    t = corrupt(t, "last_updated", 0.10, KEY, lambda c: text_of(day("stale", "2020-06-01", 900)))
    t = corrupt(t, "ssn", 0.04, KEY, lambda c: pick("bad ssn", fv.FAULT_SSNS))
    t = corrupt(t, "bill_amount", 0.02, KEY, lambda c: pick("bad bill", fv.FAULT_BILLS))
    # Some rows take the id of one of the first hundred patients, with another address and status.
    low, n = df.agg(F.min(F.col(key).cast("bigint")), F.count(F.lit(1))).first()
    same = hit("same patient", 0.02)
    first = F.lit(low or 0) + F.floor(draw("patient taken") * min(n, 100))
    t = (t.withColumn("patient_id", F.when(same, code("PAT-", 6, number=first)).otherwise(F.col("patient_id")))
         .withColumn("email", F.when(same, mail("other patient")).otherwise(F.col("email")))
         .withColumn("status", F.when(same, pick("other status", ["Active", "Transferred"])).otherwise(F.col("status"))))
    t = corrupt(t, "patient_name", 0.01, KEY, lambda c: F.concat(c, F.lit(" ÿϪ")))
    return _done(t)


def finance(df: DataFrame, key: str, shift: int) -> DataFrame:
    """Copies take the transaction id of another row."""
    base, low, n = numbered(_base(df, key), KEY)
    t = base.select(
        KEY, NUMBER, code("TXN-", 8, number=F.col(NUMBER)).alias("transaction_id"),
        F.concat(F.lit("ACC-"), whole("acc", 1000000, 9999999).cast("string")).alias("account_id"),
        F.concat(F.lit("CUST-"), whole("cust", 10000, 99999).cast("string")).alias("customer_id"),
        person("customer").alias("customer_name"), mail("customer").alias("email"),
        phone("phone").alias("phone"),
        text_of(day("date", "2020-01-01", 1800)).alias("transaction_date"),
        real("amount", 0.5, 15000).alias("number"),
        pick("type", ["Credit", "Debit", "Transfer", "Refund", "Fee"]).alias("transaction_type"),
        pick("cur", ["USD", "EUR", "GBP", "JPY", "CAD"]).alias("currency"),
        pick("shop", ["North Mart", "South Mart", "East Mart"]).alias("merchant"),
        pick("cat", ["Grocery", "Retail", "Travel", "Dining"]).alias("merchant_category"),
        real("balance", -500, 50000).alias("balance"),
        real("limit", 1000, 100000).alias("credit_limit"),
        F.when(hit("fraud", 0.1), 1).otherwise(0).alias("fraud_flag"),
        pick("status", ["Completed", "Pending", "Failed", "Reversed"]).alias("status"),
        F.concat(whole("card a", 10000000, 99999999).cast("string"),
                 whole("card b", 10000000, 99999999).cast("string")).alias("card_number"),
        whole("routing", 100000000, 999999999).cast("string").alias("routing_number"),
        text_of(day("updated", "2020-01-01", 1800)).alias("last_updated"))
    t = _nulls(t, "finance")
    t = append_copies(t, fv.FAULT_COPIES["finance"], KEY, {
        KEY: F.col(KEY) + shift, "transaction_id": code("TXN-", 8, number=other_number(low, n))})
    t = t.withColumn("number", F.when(hit("negative", 0.04) & (F.col("transaction_type") == "Credit"),
                                      -F.col("number")).otherwise(F.col("number")))
    t = respell(t, "currency", 0.07, fv.FAULT_SPELLINGS["currency"])
    t = corrupt(t, "transaction_date", 0.03, KEY, lambda c: text_of(day("ahead", "2030-01-01", 364)))
    t = corrupt(t, "number", 0.02, KEY, lambda c: F.lit(0.0))
    plain = F.col("number").cast("string")
    t = t.withColumn("amount", F.when(hit("dollar", 0.05), F.concat(F.lit("$"), plain)).otherwise(plain))
    return _done(respell(t, "status", 0.06, fv.FAULT_SPELLINGS["payment_state"]), ["number", NUMBER])


def insurance(df: DataFrame, key: str, shift: int) -> DataFrame:
    start = day("start", "2019-01-01", 1800)
    t = _base(df, key).select(
        KEY, code("POL-", 7).alias("policy_id"),
        F.when(~hit("no claim", 0.15), code("CLM-", 8)).alias("claim_id"),
        F.concat(F.lit("CUST-"), whole("cust", 10000, 99999).cast("string")).alias("customer_id"),
        person("customer").alias("customer_name"), ssn("ssn").alias("ssn"),
        mail("customer").alias("email"), phone("phone").alias("phone"),
        F.concat(whole("house", 1, 99).cast("string"), F.lit(" Elm Street")).alias("address"),
        whole("zip", 10000, 99999).cast("string").alias("zip_code"),
        pick("state", ["CA", "TX", "FL", "NY", "IL"]).alias("state"),
        pick("type", ["Health", "Life", "Auto", "Home", "Commercial"]).alias("policy_type"),
        real("coverage", 10000, 2000000).alias("coverage_amount"),
        real("premium", 50, 20000).alias("premium"), real("deductible", 250, 9900).alias("deductible"),
        text_of(start).alias("policy_start"),
        text_of(F.date_add(start, 730)).alias("policy_end"),
        text_of(F.date_add(start, whole("claim day", 0, 700).cast("int"))).alias("claim_date"),
        F.round(real("coverage", 10000, 2000000) * draw("claim") * 0.8, 2).alias("claim_amount"),
        pick("status", ["Submitted", "Under Review", "Approved", "Rejected", "Settled"])
        .alias("claim_status"), person("adjuster").alias("adjuster"),
        text_of(day("updated", "2024-01-01", 700)).alias("last_updated"))
    t = t.withColumn("settlement_amount", F.when(F.col("claim_status") == "Settled",
                                                 F.round(F.col("claim_amount") * 0.8, 2)))
    t = _nulls(t, "insurance")
    t = append_copies(t, fv.FAULT_COPIES["insurance"], KEY, {KEY: F.col(KEY) + shift, "policy_id": code("POL-", 7, shift)})
    t = corrupt(t, "claim_amount", 0.05, KEY, lambda c: F.col("coverage_amount") * real("exceeds", 1.1, 3.0, 4))
    t = corrupt(t, "policy_end", 0.03, KEY, lambda c: text_of(day("early end", "2016-06-01", 365)))
    t = corrupt(t, "zip_code", 0.04, KEY, lambda c: pick("bad zip", fv.FAULT_ZIPS))
    t = respell(t, "policy_type", 0.07, fv.FAULT_SPELLINGS["policy_type"])
    return _done(corrupt(t, "last_updated", 0.10, KEY, lambda c: text_of(day("stale", "2021-01-01", 900))))


def supply_chain(df: DataFrame, key: str, shift: int) -> DataFrame:
    ordered = day("ordered", "2022-01-01", 1200)
    expected = F.date_add(ordered, whole("lead", 5, 60).cast("int"))
    t = _base(df, key).select(
        KEY, code("ORD-", 8).alias("order_id"),
        F.concat(F.lit("SUP-"), F.lpad(whole("sup", 1, 79).cast("string"), 5, "0")).alias("supplier_id"),
        F.concat(F.lit("Supplier "), whole("sup", 1, 79).cast("string")).alias("supplier_name"),
        F.concat(F.lit("PRD-"), F.lpad(whole("prd", 1, 199).cast("string"), 6, "0")).alias("product_id"),
        F.concat(F.lit("Product "), whole("prd", 1, 199).cast("string")).alias("product_name"),
        pick("cat", ["Electronics", "Machinery", "Chemicals", "Textiles"]).alias("category"),
        text_of(ordered).alias("order_date"), text_of(expected).alias("expected_delivery"),
        F.when(~hit("undelivered", 0.1), text_of(F.date_add(
            expected, whole("late", -5, 20).cast("int")))).alias("actual_delivery"),
        whole("qty", 1, 5000).alias("quantity"), real("price", 0.5, 10000, 4).alias("unit_price"),
        F.concat(F.lit("WH-"), F.lpad(whole("wh", 1, 14).cast("string"), 3, "0")).alias("warehouse_id"),
        pick("place", ["Chicago, IL", "Dallas, TX", "Seattle, WA"]).alias("warehouse_location"),
        pick("status", ["Ordered", "In Transit", "Delivered", "Cancelled", "Returned"]).alias("status"),
        pick("qc", ["Pass", "Fail", "Pending"]).alias("quality_check"),
        person("inspector").alias("inspector"),
        text_of(day("updated", "2024-01-01", 700)).alias("last_updated"))
    t = t.withColumn("total_amount", F.round(F.col("quantity") * F.col("unit_price"), 2))
    t = _nulls(t, "supply_chain")
    t = corrupt(t, "quantity", 0.04, KEY, lambda c: -F.abs(c))
    t = corrupt(t, "total_amount", 0.07, KEY, lambda c: F.round(c * real("wrong total", 0.5, 1.8, 4), 2))
    start = F.col("order_date").cast("date")
    t = corrupt(t, "actual_delivery", 0.04, KEY, lambda c: text_of(F.date_sub(start, whole("early", 1, 30).cast("int"))))
    t = corrupt(t, "expected_delivery", 0.03, KEY, lambda c: text_of(F.date_sub(start, whole("early plan", 1, 10).cast("int"))))
    t = append_copies(t, fv.FAULT_COPIES["supply_chain"], KEY, {KEY: F.col(KEY) + shift, "order_id": code("ORD-", 8, shift)})
    t = _mix_case(t, "category", 0.06)
    return _done(t.withColumn("quantity", F.when(hit("zero", 0.02), 0).otherwise(F.col("quantity"))))


def automotive(df: DataFrame, key: str, shift: int) -> DataFrame:
    t = _base(df, key).select(
        KEY, code("VEH-", 6).alias("vehicle_id"),
        F.translate(F.upper(F.substring(F.md5(F.col(KEY).cast("string")), 1, 17)), "IOQ", "JPR")
        .alias("vin"),
        pick("make", ["Ford", "Toyota", "Honda", "BMW", "Tesla"]).alias("make"),
        pick("model", ["One", "Two", "Three"]).alias("model"),
        whole("year", 1995, 2024).alias("year"),
        pick("color", ["Red", "Blue", "Black"]).alias("color"),
        pick("engine", ["Gasoline", "Diesel", "Electric", "Hybrid"]).alias("engine_type"),
        whole("mileage", 0, 250000).alias("mileage"),
        F.concat(F.lit("CUST-"), whole("cust", 10000, 99999).cast("string")).alias("customer_id"),
        person("customer").alias("customer_name"), mail("customer").alias("email"),
        phone("phone").alias("phone"), code("SVC-", 8).alias("service_id"),
        text_of(day("service", "2021-01-01", 1500)).alias("service_date"),
        pick("job", ["Oil Change", "Tire Rotation", "Inspection", "Other"]).alias("service_type"),
        person("tech").alias("technician"), real("parts", 0, 2000).alias("parts_cost"),
        real("labor", 50, 1500).alias("labor_cost"),
        text_of(day("inspected", "2024-01-01", 700)).alias("last_inspection"),
        pick("status", ["Active", "Inactive", "Scrapped"]).alias("status"),
        text_of(day("updated", "2023-01-01", 1000)).alias("last_updated"))
    t = t.withColumn("cost", F.round(F.col("parts_cost") + F.col("labor_cost"), 2))
    t = t.withColumn("warranty_status", F.when(F.col("year") >= 2020, "Active").otherwise("Expired"))
    t = corrupt(t, "vin", 0.06, KEY, lambda c: pick("bad vin", fv.FAULT_VINS))
    t = append_copies(t, fv.FAULT_COPIES["automotive"], KEY, {KEY: F.col(KEY) + shift, "service_id": code("SVC-", 8, shift)})
    t = corrupt(t, "cost", 0.07, KEY, lambda c: F.round(c * real("wrong cost", 0.4, 2.0, 4), 2))
    t = _mix_case(t, "make", 0.08)
    t = corrupt(t, "service_date", 0.03, KEY, lambda c: text_of(day("ahead", "2030-01-01", 179)))
    t = corrupt(t, "mileage", 0.02, KEY, lambda c: -F.abs(c))
    t = _nulls(t, "automotive")
    return _done(corrupt(t, "year", 0.01, KEY, lambda c: pick("bad year", fv.FAULT_YEARS).cast("bigint")))


DOMAINS = {"healthcare": healthcare, "finance": finance, "insurance": insurance,
           "supply_chain": supply_chain, "automotive": automotive}


def domain_table(domain: str, df: DataFrame, key: str, shift: int = 1_000_000_000) -> DataFrame:
    """The domain's table with its faults, one row per row of ``df`` plus the copies."""
    return DOMAINS[domain](df, key, shift)
