"""A repair leaves nothing for its detector, and doing it twice changes nothing."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from plumbline.operators import checks, outliers, rule
from plumbline.operators.fixes import FIXES, Context, apply_fix
from plumbline.operators.table import Table
from plumbline.plans import remediation
from workload import inputs

from .helpers import AS_OF, DATA, found, log

SMALL = f"{DATA}/sf0.001"
CONTEXT = Context(AS_OF, "row_key")


def view(spark, name):
    return inputs.view(spark, SMALL, name)


def issues_after(spark, name, dimension, rules_of, **options):
    fixed = apply_fix(view(spark, name), dimension, Context(AS_OF, "row_key", options))
    t = Table(fixed.df, "row_key")
    return found(rule.measure(t, rules_of(t)))


@pytest.mark.parametrize("name, dimension, rules_of", [
    ("dirty_orders", "completeness", lambda t: [r for r in checks.completeness(t) if r.issue_type == "missing_values"]),
    ("dirty_customers", "accessibility", checks.accessibility),
    ("dirty_customers", "conformity", checks.conformity),
    ("dirty_claims", "conformity", checks.conformity),
    ("dirty_customers", "reliability", checks.reliability),
    ("dirty_customers", "constraints", lambda t: [r for r in checks.constraints(t) if r.column == "age"]),
    ("dirty_admissions", "business_rules", checks.business),
    ("dirty_customers", "business_rules", lambda t: [r for r in checks.business(t) if "vs" not in r.column]),
    ("dirty_services", "validity", lambda t: [r for r in checks.validity(t, AS_OF) if r.column in ("year", "mileage")]),
    ("dirty_orders", "consistency", lambda t: [r for r in checks.consistency(t) if r.issue_type == "calculation_inconsistency"]),
    ("dirty_services", "consistency", lambda t: [r for r in checks.consistency(t) if r.issue_type == "calculation_inconsistency"]),
    ("dirty_customers", "lineage", checks.lineage),
    ("dirty_orders", "auditability", checks.audit),
])
def test_repair_clears_its_issue(spark, name, dimension, rules_of):
    t = Table(view(spark, name), "row_key")
    assert found(rule.measure(t, rules_of(t)))
    assert issues_after(spark, name, dimension, rules_of) == {}


def test_winsorized_column_has_no_value_beyond_the_old_fence(spark):
    t = Table(view(spark, "dirty_orders"), "row_key")
    fence = outliers.fences(t, {"total_amount": t.number("total_amount")}, 1.5)["total_amount"]
    fixed = apply_fix(t.df, "accuracy", CONTEXT)
    low, high = fixed.df.agg(F.min("total_amount"), F.max("total_amount")).first()
    assert low >= fence["lower"] and high == fence["upper"]
    assert fixed.df.where("total_amount IS NULL").count() == t.df.where("total_amount IS NULL").count()


@pytest.mark.parametrize("dimension", ["standardization", "validity", "consistency", "accessibility",
                                       "conformity", "constraints", "business_rules", "reliability"])
@pytest.mark.parametrize("name", ["dirty_orders", "dirty_customers"])
def test_repairs_are_idempotent(spark, name, dimension):
    once = apply_fix(view(spark, name), dimension, CONTEXT)
    twice = apply_fix(once.df, dimension, CONTEXT)
    assert log(twice) == {}
    assert once.df.exceptAll(twice.df.select(*once.df.columns)).isEmpty()


@pytest.mark.parametrize("dimension", [d for d in FIXES if d not in ("uniqueness", "survivorship")])
def test_repairs_keep_every_row(spark, dimension):
    df = view(spark, "dirty_claims")
    fixed = apply_fix(df, dimension, CONTEXT)
    assert fixed.df.count() == df.count()
    assert fixed.log.columns == ["dimension", "action", "column_name", "rows_affected", "detail"]


def test_unknown_dimension_changes_nothing(spark):
    df = view(spark, "dirty_claims")
    fixed = apply_fix(df, "no_such_dimension", CONTEXT)
    assert fixed.df is df and fixed.log.count() == 0


def test_aliases(spark):
    fixed = apply_fix(view(spark, "dirty_claims"), "deduplication",
                      Context(AS_OF, "row_key", {"keys": ["policy_id"]}))
    assert fixed.df.groupBy("policy_id").count().where("count > 1").isEmpty()


def test_order_dependent_repairs_need_a_row_key(spark):
    df = view(spark, "dirty_claims")
    for dimension, options in (("uniqueness", {"keys": ["policy_id"]}), ("survivorship", {}),
                               ("pii_security", {"fields": {"customer_id": "tokenize"}})):
        with pytest.raises(ValueError):
            apply_fix(df, dimension, Context(AS_OF, None, options))


def test_unknown_protection_mode(spark):
    with pytest.raises(ValueError):
        apply_fix(view(spark, "dirty_claims"), "pii_security", Context(AS_OF, None, {"fields": {"state": "shred"}}))


def test_text_amounts(spark):
    df = spark.createDataFrame([(1, "-5", "-3"), (2, "$7", None), (3, "x", "9")],
                               "row_key int, price string, cost string")
    fixed = apply_fix(df, "business_rules", CONTEXT).df.orderBy("row_key").collect()
    assert [(r["price"], r["cost"]) for r in fixed] == [("5", "3"), ("$7", None), ("x", "9")]
    kept = apply_fix(df, "standardization", CONTEXT).df.orderBy("row_key").collect()
    assert [r["price"] for r in kept] == ["-5", "7", "x"]


def test_padding_only_below_half(spark):
    df = spark.createDataFrame([(i, None if i < 6 else 1.0, None if i < 4 else 1.0) for i in range(10)],
                               "row_key int, amount double, price double")
    assert log(apply_fix(df, "reconciliation", CONTEXT)) == {("reconcile_missing_amount", "price"): 4}


def test_flag_column(spark):
    fixed = apply_fix(view(spark, "dirty_orders"), "integrity", Context(AS_OF, "row_key", {"flag_column": "f"}))
    assert fixed.df.where("f").count() == 45
    plain = apply_fix(view(spark, "dirty_orders"), "integrity", CONTEXT)
    assert "f" not in plain.df.columns and log(plain) == {("flag_for_review", "ALL"): 0}


def test_chain_is_one_plan_with_all_logs(spark):
    context = Context(AS_OF, "row_key", {"pii_security": {"fields": {"order_id": "hash"}}})
    fixed = remediation.apply_all(view(spark, "dirty_orders"), ["standardization", "consistency", "pii_security"], context)
    dims = {r["dimension"] for r in fixed.log.collect()}
    assert dims == {"standardization", "consistency", "pii_security"}
    assert fixed.df.select("order_id").first()[0].isalnum()


def test_audit_stamp_uses_the_as_of_date(spark):
    out = apply_fix(spark.createDataFrame([(1, None)], "row_key int, last_updated string"), "auditability",
                    Context(dt.date(2025, 5, 5), "row_key")).df.first()
    assert out["last_updated"] == out["created_at"] == "2025-05-05 00:00:00"
