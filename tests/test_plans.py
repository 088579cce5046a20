"""Whole checks, history and reports."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from plumbline.operators.fixes import Context
from plumbline.plans import history, remediation, reports, scores
from plumbline.plans import analysis as analysis_plan
from plumbline.plans.analysis import DIMENSIONS, analyze
from plumbline.plans.issue_rows import issue_rows
from plumbline.streaming import monitor
from plumbline.operators import checks, rule
from plumbline.operators.table import Table
from workload import inputs

from .helpers import AS_OF, DATA

SMALL = f"{DATA}/sf0.001"
NOW = dt.datetime(2026, 1, 1, 12, 0, 0)


@pytest.fixture(scope="module")
def orders(spark):
    return analyze(inputs.view(spark, SMALL, "dirty_orders"), AS_OF, "supply_chain", "row_key")


# Known counts of the fixture views.
KNOWN = {
    ("completeness", "supplier_id", "missing_values"): 89, ("completeness", "total_amount", "missing_values"): 41,
    ("uniqueness", "order_id", "duplicate_ids"): 58, ("validity", "quantity", "range_violation"): 141,
    ("validity", "price_text", "type_mismatch"): 72, ("constraints", "quantity", "constraint_violation_negative_value"): 75,
    ("consistency", "total_amount", "calculation_inconsistency"): 228,
    ("consistency", "order_date↔actual_delivery", "date_order_violation"): 64,
    ("consistency", "status", "enum_inconsistency"): 48, ("integrity", "actual_delivery", "integrity_violation"): 45,
    ("standardization", "order_date", "mixed_date_formats"): 137, ("standardization", "status", "whitespace_issue"): 48,
    ("accuracy", "total_amount", "statistical_outlier"): 33, ("reasonableness", "total_amount", "statistical_outliers"): 8,
    ("timeliness", "order_date", "future_dated_record"): 22,
    ("auditability", "last_updated", "missing_audit_timestamp_value"): 35,
}


def test_known_counts(orders):
    got = {(r["dimension"], r["column_name"], r["issue_type"]): r["affected_rows"] for r in orders.issues.collect()}
    assert {k: got.get(k) for k in KNOWN} == KNOWN


def test_all_dimensions_are_scored(orders):
    rows = {r["dimension"]: r for r in orders.scores.collect()}
    assert set(rows) == set(DIMENSIONS) and not orders.errors
    assert rows["accessibility"]["score"] == 100 and rows["lineage"]["score"] == 60
    overall = orders.overall.first()
    assert 0 < overall["overall_score"] < 100 and overall["dimensions"] == 22


def test_personal_values_never_show(spark):
    done = analyze(inputs.view(spark, SMALL, "dirty_customers"), AS_OF, "finance", "row_key",
                   dimensions=["pii_security"])
    rows = {r["column_name"]: r for r in done.issues.collect()}
    assert rows["email"]["sample_values"] == ["u***1@***", "u***2@***", "u***3@***"]
    assert rows["DATASET"]["severity"] == "HIGH" and rows["DATASET"]["affected_pct"] == 1.0


def test_issues_carry_the_first_values(spark):
    df = spark.createDataFrame([(i, i % 5 - 2, None if i < 3 else "x") for i in range(20)], "k int, quantity int, note string")
    done = analyze(df, AS_OF, row_key="k", dimensions=["validity", "completeness"])
    got = {r["issue_type"]: r["sample_values"] for r in done.issues.collect()}
    assert [float(v) for v in got["range_violation"]] == [-2.0, -1.0, 0.0] and got["missing_values"] == []


def test_dimension_details_are_stored(spark, tmp_path):
    df = spark.createDataFrame([(1, None), (2, "x")], "k int, s string")
    store = history.Store(spark, str(tmp_path / "details"))
    store.log_run(analyze(df, AS_OF, row_key="k", dimensions=["completeness", "validity"]), "t", dt.datetime(2026, 1, 1), 1.0)
    got = {r["dimension"]: json.loads(r["details_json"]) for r in store.read("dimension_scores").collect()}
    assert got["validity"] == [] and got["completeness"][0]["affected_rows"] == 1


def test_clean_and_empty_tables(spark):
    df = spark.createDataFrame([(i, f"r{i}") for i in range(50)], "k int, remark string")
    done = analyze(df, AS_OF, row_key="k", dimensions=["completeness", "validity", "uniqueness"])
    assert [r["score"] for r in done.scores.collect()] == [100.0] * 3
    empty = analyze(df.limit(0), AS_OF, row_key="k")
    assert empty.facts.total_rows == 0 and empty.scores.count() == 22


def test_a_broken_dimension_does_not_stop_the_others(spark, monkeypatch):
    def broken(table):
        raise RuntimeError("no")
    monkeypatch.setattr(analysis_plan.checks, "integrity", broken)
    done = analyze(spark.createDataFrame([(1, None)], "k int, s string"), AS_OF, row_key="k",
                   dimensions=["integrity", "completeness"])
    assert done.errors == {"integrity": "no"}
    assert [r["dimension"] for r in done.scores.collect()] == ["completeness"]


def test_large_tables_are_not_kept(spark, monkeypatch):
    df = spark.createDataFrame([(1, None)], "k int, s string")
    monkeypatch.setattr(analysis_plan, "SMALL_BYTES_PER_CORE", 0)
    assert analysis_plan.spread_small(df) is None
    assert analyze(df, AS_OF, row_key="k", dimensions=["completeness"]).issues.count() == 1


def test_unknown_weight_counts_one(spark):
    rows = spark.createDataFrame([("completeness", 50.0, 1), ("new", 100.0, 0)],
                                 "dimension string, score double, issues_found int")
    got = scores.overall_score(rows).first()
    assert got["overall_score"] == round((50 * 1.5 + 100) / 2.5, 2) and got["total_issues"] == 1


def test_repair_improves_and_is_learned_from(spark, tmp_path):
    store = history.Store(spark, str(tmp_path / "history"))
    df = inputs.view(spark, SMALL, "dirty_orders")
    done = remediation.remediate(df, ["validity", "consistency"], Context(AS_OF, "row_key"), "supply_chain",
                                 check=["validity", "consistency"])
    rows = {r["dimension"]: r for r in done.comparison.collect()}
    assert rows["validity"]["score_after"] > rows["validity"]["score_before"]
    assert rows["consistency"]["issues_resolved"] > 0
    ids = []
    for _ in range(3):
        ids.append(store.log_run(done.before, "orders", NOW, 1.5))
        store.log_fixes(ids[-1], "supply_chain", done.fixed.log, NOW, done.successes)
    assert ids == sorted(set(ids))
    patterns = {(r["column_name"], r["fix_action"]): r for r in
                history.learning_patterns(store.read("fix_history")).collect()}
    total = patterns["total_amount", "recalculate_total"]
    assert (total["occurrence_count"], total["success_rate"], total["auto_fix_eligible"]) == (3, 1.0, 1)
    again = {(r["column_name"], r["issue_type"]): r for r in history.recurrence(
        store.read("issue_log"), store.read("fix_history")).collect()}
    assert again["total_amount", "calculation_inconsistency"]["fixes"] == 3
    summary = history.global_summary(store.read("analysis_runs"), store.read("dimension_scores"),
                                     store.read("issue_log"), ["validity"]).collect()
    assert [(r["domain"], r["run_id"]) for r in summary] == [("supply_chain", ids[-1])]
    assert summary[0]["total_issues"] == done.before.issues.count()
    assert store.read("audit_trail").count() == 6


def test_rules_store(spark, tmp_path):
    store = history.Store(spark, str(tmp_path / "rules"))
    assert store.rules().count() == 0
    assert store.save_rule("finance", "r1", "a > 0", "HIGH", NOW) == 1
    assert store.save_rule("other", "r2", "a > 0", "LOW", NOW) == 2
    assert [r["rule_name"] for r in store.rules("finance").collect()] == ["r1"]


def test_severity_is_ranked_not_spelled(spark):
    rows = [(1, s, n) for s, n in (("LOW", 9), ("CRITICAL", 1), ("MEDIUM", 5), ("HIGH", 2), ("HIGH", 7))]
    df = spark.createDataFrame(rows, "run_id int, severity string, affected_rows int")
    got = [(r["severity"], r["affected_rows"]) for r in history.issues_of_run(df, 1).collect()]
    assert got == [("CRITICAL", 1), ("HIGH", 7), ("HIGH", 2), ("MEDIUM", 5), ("LOW", 9)]


def test_reports_of_one_run(orders):
    card = reports.scorecard(orders.scores).collect()
    assert [r["score"] for r in card] == sorted(r["score"] for r in card)
    advice = reports.recommendations(orders.issues, orders.scores).collect()
    assert [r["priority"] for r in advice] == [f"P{i + 1}" for i in range(len(advice))] and len(advice) <= 15
    digest = [r["affected_rows"] for r in reports.alert_digest(orders.issues).collect()]
    assert len(digest) == 8 and digest == sorted(digest, reverse=True)
    assert reports.health_summary(orders.scores).first()["total_issues"] == orders.issues.count()
    kinds = reports.one_per_type(orders.issues).collect()
    assert sum(r["occurrences"] for r in kinds) == orders.issues.count()
    same = reports.compare(orders.scores, orders.scores)
    assert reports.improvement(same).first()["reduction_pct"] == 0.0


def test_comparison_with_missing_sides(spark):
    schema = "dimension string, score double, issues_found bigint"
    before = spark.createDataFrame([("a", 50.0, 4), ("b", 70.0, 2)], schema)
    after = spark.createDataFrame([("a", 90.0, 1), ("c", 60.0, 3)], schema)
    got = {r["dimension"]: (r["delta"], r["issues_resolved"]) for r in reports.compare(before, after).collect()}
    assert got == {"a": (40.0, 3), "b": (0.0, 0), "c": (0.0, 0)}


def test_rules_run_on_a_stream(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.sql("SELECT timestamp'2024-01-01 00:10:00' + make_interval(0,0,0,0,id,0,0) AS ts, id - 2 AS quantity "
              "FROM range(6)").write.parquet(source)
    stream = spark.readStream.schema("ts timestamp, quantity bigint").parquet(source)
    t = Table(stream)
    query = (monitor.violation_rates(t, checks.validity(t, AS_OF), "ts", "1 hour").writeStream
             .outputMode("complete").format("memory").queryName("rates")
             .option("checkpointLocation", str(tmp_path / "c")).start())
    query.processAllAvailable()
    query.stop()
    got = spark.table("rates").agg(F.sum("rows"), F.sum("affected_rows")).first()
    assert tuple(got) == (6, 3)


@pytest.mark.parametrize("name, domain", [("dirty_orders", "supply_chain"), ("dirty_customers", "finance"),
                                          ("dirty_services", "automotive")])
def test_rows_of_issues_agree_with_their_counts(spark, name, domain):
    """Every issue that rows cause lists as many rows as it counts, each once; personal values stay hidden."""
    check = analyze(inputs.view(spark, SMALL, name), AS_OF, domain, "row_key")
    rows = issue_rows(check).collect()
    assert len({(r["row_key"], r["dimension"], r["column_name"], r["issue_type"]) for r in rows}) == len(rows)
    got = {}
    for r in rows:
        k = (r["dimension"], r["column_name"], r["issue_type"])
        got[k] = got.get(k, 0) + 1
    whole = {"high_cardinality", "pii_exposure_summary", "survivorship_conflict", "constant_column",
             "missing_traceability_metadata", "missing_audit_timestamp", "mixed_date_formats", "amount_reconciliation_gap",
             "all_null_column", "insufficient_row_count", "missing_primary_key"}
    counted = {}        # two limits of one column are two issues of one type
    for r in check.issues.where(~F.col("issue_type").isin(*whole)).collect():
        k = (r["dimension"], r["column_name"], r["issue_type"])
        counted[k] = counted.get(k, 0) + r["affected_rows"]
    assert {k: got.get(k) for k in counted} == counted
    assert not any(r["value"] for r in rows if r["dimension"] == "pii_security")


def test_rows_of_issues_are_kept_with_the_run(spark, tmp_path):
    check = analyze(inputs.view(spark, SMALL, "dirty_orders"), AS_OF, "supply_chain", "row_key",
                    {"near_duplicates": False}, ["validity", "uniqueness"])
    store = history.Store(spark, str(tmp_path))
    run = store.log_run(check, "orders", NOW, 1.0, rows=True)
    kept = store.read("issue_rows").where(f"run_id = {run}")
    assert kept.count() == issue_rows(check).count() > 0
    assert (tmp_path / "issue_rows" / f"run_id={run}" / "dimension=validity").is_dir()
    for r in store.read("issue_log").collect():
        keys = json.loads(r["row_keys"])
        assert 0 < len(keys) <= 100 and keys == sorted(keys) and len(keys) == min(100, r["affected_rows"])


def test_every_fix_names_the_issue_it_answers(spark, tmp_path):
    """All repairs of a table, personal data included, meet the issues of their columns."""
    df = inputs.view(spark, SMALL, "dirty_customers")
    check = analyze(df, AS_OF, "finance", "row_key", {"near_duplicates": False})
    store = history.Store(spark, str(tmp_path / "all"))
    run = store.log_run(check, "customers", NOW, 1.0)
    options = {"pii_security": {"fields": {"ssn": "mask", "email": "hash", "phone": "redact"}}}
    dimensions = [d for d in DIMENSIONS if d not in ("uniqueness", "survivorship")]
    fixed = remediation.apply_all(df, dimensions, Context(AS_OF, "row_key", options))
    store.log_fixes(run, "finance", fixed.log, NOW)
    fixes = [r for r in store.read("fix_history").collect() if r["rows_affected"]]
    assert {"mask_pii", "hash_pii", "redact_pii", "impute_mode"} <= {r["fix_action"] for r in fixes}
    assert all(r["issue_type"] and r["issue_type"] not in DIMENSIONS for r in fixes)
    met = {r["column_name"] for r in history.recurrence(store.read("issue_log"), store.read("fix_history")).collect()
           if r["fixes"] and r["issue_type"].startswith("pii_")}
    assert met == {"ssn", "email", "phone"}
    orders = inputs.view(spark, SMALL, "dirty_orders")
    capped = remediation.apply_all(orders, ["reasonableness", "accuracy"], Context(AS_OF, "row_key")).log.collect()
    assert {(r["action"], r["issue_type"]) for r in capped} == {
        ("cap_outliers_iqr", "statistical_outliers"), ("winsorize_outliers", "statistical_outlier")}


@pytest.mark.parametrize("name, domain, repairs", [
    ("dirty_orders", "supply_chain", ["validity"]), ("dirty_orders", "supply_chain", ["standardization", "consistency"]),
    ("dirty_customers", "finance", ["conformity", "constraints"])])
def test_incremental_check_equals_a_full_one(spark, name, domain, repairs):
    """Same issues and scores; only rules on changed columns are measured."""
    df = inputs.view(spark, SMALL, name)
    done = remediation.remediate(df, repairs, Context(AS_OF, "row_key"), domain)
    changed = remediation.changed_columns(df, done.fixed)
    assert changed and changed != set(df.columns)
    full = analyze(done.fixed.df, AS_OF, domain, "row_key")
    columns = ["dimension", "column_name", "issue_type", "affected_rows", "affected_pct", "severity", "description"]
    assert sorted(map(str, done.after.issues.select(*columns).collect())) == sorted(
        map(str, full.issues.select(*columns).collect()))
    assert sorted(map(tuple, done.after.scores.collect())) == sorted(map(tuple, full.scores.collect()))
    assert done.after.overall.collect() == full.overall.collect()
    assert 0 < len(done.after.measured) < 0.7 * len(full.measured)
    again = [r for r in done.after.rules if (r.dimension, r.column, r.issue_type) in set(done.after.measured)]
    assert all(rule.columns_read(r, done.after.table) & changed for r in again)


def test_repairs_of_rows_are_checked_in_full(spark):
    df = inputs.view(spark, SMALL, "dirty_orders")
    fixed = remediation.apply_all(df, ["uniqueness"], Context(AS_OF, "row_key", {"uniqueness": {"keys": ["order_id"]}}))
    assert remediation.changed_columns(df, fixed) is None
    added = remediation.apply_all(df, ["lineage"], Context(AS_OF, "row_key"))
    assert remediation.changed_columns(df, added) is None
