import datetime as dt

import pytest
from pyspark.sql import functions as F

from plumbline.functions import fixed_values as fv, text
from plumbline.operators import checks, declared, duplicates, outliers, privacy, profile, rule
from plumbline.operators.declared import CheckSpec, FieldSpec
from plumbline.operators.table import Table
from plumbline.plans import catalogue

from .helpers import AS_OF, found


def table(spark, rows, schema, key=None):
    return Table(spark.createDataFrame(rows, schema), key)


def test_missing_and_empty(spark):
    t = table(spark, [(1, None, "a"), (2, float("nan"), " "), (3, 1.0, None)], "k int, x double, s string", "k")
    assert found(rule.measure(t, checks.completeness(t))) == {
        ("x", "missing_values"): 2, ("s", "missing_values"): 1, ("s", "empty_strings"): 1}


def test_severity_risk_and_auto_fix_follow_the_rate(spark):
    rows = [(i, None if i < 3 else "a", None if i < 12 else "a") for i in range(100)]
    t = table(spark, rows, "k int, low string, high string", "k")
    got = {r["column_name"]: r for r in rule.measure(t, checks.completeness(t)).collect()}
    assert (got["low"]["severity"], got["low"]["risk_level"], got["low"]["auto_fixable"]) == ("LOW", "LOW", True)
    assert (got["high"]["severity"], got["high"]["risk_level"], got["high"]["auto_fixable"]) == ("HIGH", "HIGH", False)


def test_null_outcome_is_no_violation(spark):
    t = table(spark, [(None, None), ("x", 200), (None, -1)], "email string, age int")
    assert found(rule.measure(t, checks.conformity(t) + checks.constraints(t))) == {
        ("email", "email_format_violation"): 1, ("age", "constraint_violation_age"): 2}


def test_claim_interval_and_deductible(spark):
    rows = [("2020-01-01", "2020-12-31", "2021-01-01", 10.0, 5.0), ("2020-01-01", "2020-12-31", "06/01/2020", 1.0, 5.0),
            (None, "2020-12-31", "2021-01-01", None, 5.0), ("2020-01-01", "2020-12-31", "2020-12-31", 5.0, 5.0)]
    t = table(spark, rows, "policy_start string, policy_end string, claim_date string, deductible double, coverage_amount double")
    assert found(rule.measure(t, checks.consistency(t) + checks.business(t))) == {
        ("claim_date", "referential_integrity"): 1,
        ("deductible vs coverage_amount", "business_rule_violation"): 2}


def test_tolerance_of_derived_columns(spark):
    rows = [(2, 10.0, 20.0), (2, 10.0, 20.2), (2, 10.0, 20.22), (2, 10.0, None)]
    t = table(spark, rows, "quantity int, unit_price double, total_amount double")
    assert found(rule.measure(t, checks.reconciliation(t)))[("total_amount", "enrichment_accuracy")] == 1


def test_row_count_and_all_null_and_constant(spark):
    t = table(spark, [(1, None, 5)] * 3, "a int, b string, c int")
    got = found(rule.measure(t, checks.profile_flags(t) + checks.reconciliation(t)))
    assert got == {("a", "constant_column"): 3, ("c", "constant_column"): 3, ("b", "all_null_column"): 3,
                   ("DATASET", "insufficient_row_count"): 3}


def test_stale_branches(spark):
    t = table(spark, [("2025-12-31",), ("2025-09-01",)], "updated_at string")
    assert found(rule.measure(t, checks.timeliness(t, AS_OF, 30))) == {("updated_at", "stale_records"): 1}
    t = table(spark, [("2023-12-31",), ("2025-09-01",)], "updated_at string")
    assert found(rule.measure(t, checks.timeliness(t, AS_OF, 30))) == {("updated_at", "stale_records_critical"): 1}


def test_dates_may_be_typed(spark):
    t = table(spark, [(dt.date(2030, 1, 1),), (dt.date(2020, 1, 1),)], "order_date date")
    assert found(rule.measure(t, checks.timeliness(t, AS_OF, 30)))[("order_date", "future_dated_record")] == 1


def test_structure_checks(spark):
    t = table(spark, [(1,)] * 10, "a int")
    got = found(rule.measure(t, checks.audit(t) + checks.lineage(t)))
    assert got == {("DATASET", "missing_audit_timestamp"): 10, ("DATASET", "missing_primary_key"): 10,
                   (None, "missing_traceability_metadata"): 10}


def test_many_rules_are_split_over_scans(spark, monkeypatch):
    monkeypatch.setattr(rule, "RULES_PER_SCAN", 3)
    t = table(spark, [(None, 1, None, " ", "b")], "a string, b int, c string, d string, e string")
    assert found(rule.measure(t, checks.completeness(t))) == {
        ("a", "missing_values"): 1, ("c", "missing_values"): 1, ("d", "empty_strings"): 1}


def test_empty_table_has_no_issues(spark):
    t = table(spark, [], "a string, age int, total_amount double, quantity int, unit_price double")
    rules = checks.completeness(t) + checks.profile_flags(t) + checks.reconciliation(t) + checks.accuracy(t, AS_OF)
    assert found(rule.measure(t, rules)) == {}


def test_pii_order_and_threshold(spark):
    rows = [("123-45-6789", "call 555-123-4567", "x")] * 2 + [("n", "n", "123-45-6789")] + [("n", "n", "x")] * 27
    t = table(spark, rows, "a string, b string, c string")
    got = {r["column_name"]: (r["pii_type"], r["affected_rows"]) for r in privacy.pii_columns(t).collect()}
    assert got == {"a": ("SSN", 2), "b": ("Phone", 2)}


def test_policy_gap_states(spark):
    t = table(spark, [("a@b.cd", "plain")], "email string, phone string")
    got = {r["column_name"]: r["status"] for r in privacy.policy_gaps(t, ["email", "ssn"]).collect()}
    assert got == {"email": "declared and detected", "phone": "detected, not declared",
                   "ssn": "declared, no such column"}
    quiet = table(spark, [(None, "x")], "email string, note string")
    assert {r["status"] for r in privacy.policy_gaps(quiet, ["email"]).collect()} == {"declared, not detected"}


def test_numeric_text_is_adopted_when_most_reads(spark):
    t = table(spark, [("$1,000",), ("2",), ("x",)], "price string")
    assert list(outliers.numeric_views(t)) == ["price"]
    t = table(spark, [("$1,000",), ("x",), ("x",)], "price string")
    assert outliers.numeric_views(t) == {}


def test_few_or_equal_values_have_no_fence(spark):
    t = table(spark, [(float(i),) for i in range(9)], "x double")
    assert outliers.fences(t, outliers.numeric_views(t), 1.5) == {}
    t = table(spark, [(1.0,)] * 20 + [(9.0,)], "x double")
    assert outliers.fences(t, outliers.numeric_views(t), 1.5) == {}


def test_declared_unique_required_and_unknown_columns(spark):
    t = table(spark, [("A", 1, "2030-01-01"), ("A", None, "bad"), (None, 3, None)], "id string, n int, d string")
    fields = {"id": FieldSpec(unique=True, required=True), "n": FieldSpec("integer", low=2),
              "d": FieldSpec("date", not_future=True, required=True), "gone": FieldSpec(required=True)}
    specs = [CheckSpec("n_even", "n % 2 = 0", "LOW", "f"), CheckSpec("skipped", "gone > 1", "LOW", "f")]
    assert found(declared.declared_issues(t, fields, specs, AS_OF)) == {
        ("id", "field_required"): 1, ("id", "field_unique"): 2, ("n", "field_min"): 1,
        ("d", "field_required"): 2, ("d", "field_not_future"): 1, ("n_even", "declared_rule_violation"): 2}


@pytest.mark.parametrize("domain", list(catalogue.FIELDS))
def test_catalogue_compiles(spark, domain):
    fields = catalogue.FIELDS[domain]
    names = sorted(set(fields) | {"settlement_amount"})
    t = table(spark, [tuple("x" for _ in names)], ", ".join(f"{n} string" for n in names))
    typed = declared.typed_view(t, {**fields, "settlement_amount": FieldSpec("float")}, AS_OF)
    rules = declared.check_rules(typed, catalogue.CHECKS[domain], set(fields))
    assert len(rules) == len(catalogue.CHECKS[domain])
    rule.measure(typed, rules + declared.field_rules(t, typed, fields)).collect()


def test_bad_rule_text_raises(spark):
    t = declared.typed_view(table(spark, [(1,)], "a int"), {}, AS_OF)
    with pytest.raises(Exception):
        rule.measure(t, declared.check_rules(t, [CheckSpec("x", "a >", "LOW", "f")])).collect()


def test_failing_checks_leave_the_others(spark):
    t = declared.typed_view(table(spark, [(1, 0), (2, 5)], "a int, `B2` int"), {}, AS_OF)
    specs = [CheckSpec(n, c, "LOW", "f") for n, c in (
        ("syntax", "a >"), ("unknown", "gone > 1"), ("dividing", "a / B2 > 1"), ("good", "a > 1"))]
    errors = {}
    rules = declared.check_rules(t, specs, {"B2"}, errors)
    got = {r["column_name"]: r["affected_rows"] for r in declared.measured_checks(t, rules).collect()}
    assert got == {"dividing": 1, "good": 1} and set(errors) == {"syntax", "unknown"}
    assert spark.conf.get("spark.sql.ansi.enabled") == "true"
    absent = CheckSpec("absent", "Address2 > 1", "LOW", "f")
    assert declared.check_rules(t, [absent], {"address2"}) == []


def test_names_with_dots(spark):
    t = table(spark, [("a", 1), ("a", 1), ("b", 2)], "`geo.x_id` string, k int")
    assert duplicates.repeated_rows(t.df).first()["duplicate_rows"] == 1
    assert duplicates.repeated_ids(t).first()["affected_rows"] == 2
    assert {r["issue_type"] for r in duplicates.uniqueness_issues(t, 3).collect()} == {
        "exact_duplicates", "duplicate_ids"}


def test_constant_texts(spark):
    t = table(spark, [("x", "a", None), ("x", "b", None), (None, "a", None)], "s string, v string, n string")
    assert {k[0] for k in found(rule.measure(t, checks.profile_flags(t))) if k[1] == "constant_column"} == {"s"}


def test_profile_ties_and_summary(spark):
    t = table(spark, [("b", 1.0), ("a", 2.0), (None, 10.0)], "s string, x double")
    top = profile.text_profile(t).first()
    assert (top["top_value"], top["top_freq"]) == ("a", 1)
    got = profile.numeric_profile(t).first()
    assert (got["median"], got["q25"], got["q75"]) == (2.0, 1.5, 6.0)
    summary = profile.completeness_summary(t).first()
    assert (summary["null_cells"], summary["most_incomplete_column"]) == (1, "s")
    sketched = {r["column_name"]: r["unique_count"] for r in profile.column_profile(t, exact=False).collect()}
    assert sketched == {"s": 2, "x": 3}
    assert profile.plan_size_mb(t.df) >= 0


def test_samples_are_the_first_in_key_order(spark):
    t = table(spark, [(i, -i) for i in range(1, 20)], "k int, quantity int", "k")
    got = rule.samples(t, [r for r in checks.validity(t, AS_OF)], 3).first()
    assert got["sample_values"] == ["-1.0", "-2.0", "-3.0"]
    kinds = rule.violations(t, checks.validity(t, AS_OF)).groupBy("issue_type").agg(F.count("*").alias("n"))
    assert [(r["issue_type"], r["n"]) for r in kinds.collect()] == [("range_violation", 19)]


def test_cheap_tests_find_what_the_patterns_find(spark):
    """Rules without a regular expression where bytes tell, and patterns tried on texts long enough only."""
    texts = ["", " ", "plain", " led", "trail\t", "café", "é", "~", "!", "a\x7f", "\x7f", " x", "x ", "tab\tin", None,
             "123-45-6789", "x 123-45-6789 y", "4111111111111", "4111111111111111", "555-010-1234", "5550101234", "1999-01-02",
             "1.2.3.4", "A123456", "AB1234567", "A1234567", "123456789", "12345678", "a@b.co", "é 123456789", "7" * 40]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, v string")
    df = df.unionByName(spark.sql("SELECT 100 AS k, CAST(X'80' AS STRING) AS v UNION ALL SELECT 101, CAST(X'41FF42' AS STRING)"))
    t = Table(df, "k")
    readable, = checks.accessibility(t)
    assert "RLIKE" not in readable.predicate
    both = df.select(F.expr(readable.predicate).alias("a"), F.col("v").rlike(text.NON_ASCII).alias("b")).collect()
    assert all(r["a"] == r["b"] for r in both) and sum(r["a"] is True for r in both) >= 5
    space = fv.WHITESPACE
    for r in df.where("k < 100").select("v", text.strip(F.col("v")).alias("s")).collect():
        assert r["s"] == (None if r["v"] is None else r["v"].strip(space))
    tests = privacy.pattern_tests(t, "v")
    found = t.frame().select("v", *[F.expr(test).alias(k) for k, test in tests.items()], *[
        F.col("v").rlike(p).alias("all " + k) for k, p in fv.PII_PATTERNS]).where("k < 100").collect()
    for kind, _ in fv.PII_PATTERNS:
        assert [r[kind] for r in found] == [r["all " + kind] for r in found], kind
        assert kind == "Email" or "octet_length" in tests[kind]
        assert any(r[kind] for r in found), kind
