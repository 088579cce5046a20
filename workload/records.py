"""History and report queries over run, score, issue and fix tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.functions import fixed_values as fv
from plumbline.operators import privacy
from plumbline.plans import history, reports

from .detect import C, NAMED, PII_CUSTOMERS, keyed
from .inputs import table, view
from .registry import query

KEYS = "domain, dimension, column_name, issue_type"
PATTERNS = f"""SELECT {KEYS}, fix_action, CAST(count(*) AS BIGINT) AS occurrence_count,
 CAST(sum(success) AS BIGINT) AS success_count, CAST(count(*) - sum(success) AS BIGINT) AS failure_count,
 round(sum(success) * 1.0 / count(*), 4) AS success_rate, max(applied_at) AS last_seen,
 CASE WHEN count(*) >= 3 AND sum(success) * 1.0 / count(*) >= 0.95 THEN 1 ELSE 0 END AS auto_fix_eligible
FROM fix_events GROUP BY {KEYS}, fix_action"""


@query("learning_patterns", PATTERNS)
def learning_patterns(spark, sf_dir):
    return history.learning_patterns(view(spark, sf_dir, "fix_events"))


@query("best_fixes", f"""
SELECT {KEYS}, fix_action, occurrence_count, success_rate, auto_fix_eligible FROM ({PATTERNS})
QUALIFY row_number() OVER (PARTITION BY {KEYS} ORDER BY success_rate DESC, occurrence_count DESC, fix_action) = 1""")
def best_fixes(spark, sf_dir):
    return history.best_fixes(history.learning_patterns(view(spark, sf_dir, "fix_events")))


@query("patterns_by_use", f"SELECT {KEYS}, fix_action, occurrence_count FROM ({PATTERNS})")
def patterns_by_use(spark, sf_dir):
    patterns = history.learning_patterns(view(spark, sf_dir, "fix_events"))
    return history.patterns_by_use(patterns).select(*KEYS.split(", "), "fix_action", "occurrence_count")


@query("recent_runs", "SELECT * FROM analysis_runs ORDER BY run_id DESC LIMIT 20")
def recent_runs(spark, sf_dir):
    return history.recent(view(spark, sf_dir, "analysis_runs"), "run_id", 20)


@query("recent_runs_of_domain", """
SELECT * FROM analysis_runs WHERE domain = 'finance' ORDER BY run_id DESC LIMIT 20""")
def recent_runs_of_domain(spark, sf_dir):
    return history.recent(view(spark, sf_dir, "analysis_runs"), "run_id", 20, "finance")


@query("issues_of_run", """
SELECT run_id, dimension, column_name, issue_type, affected_rows, severity FROM issue_log
WHERE run_id = (SELECT max(run_id) FROM issue_log)""")
def issues_of_run(spark, sf_dir):
    issues = view(spark, sf_dir, "issue_log")
    last = issues.agg(F.max("run_id")).first()[0]
    return history.issues_of_run(issues, last).select(
        "run_id", "dimension", "column_name", "issue_type", "affected_rows", "severity")


@query("fix_history", "SELECT fix_id, domain, fix_action, rows_affected FROM fix_events ORDER BY fix_id DESC LIMIT 100")
def fix_history(spark, sf_dir):
    return history.recent(view(spark, sf_dir, "fix_events"), "fix_id", 100).select(
        "fix_id", "domain", "fix_action", "rows_affected")


@query("fix_history_of_domain", """
SELECT fix_id, domain, fix_action, rows_affected FROM fix_events WHERE domain = 'insurance' ORDER BY fix_id DESC LIMIT 100""")
def fix_history_of_domain(spark, sf_dir):
    return history.recent(view(spark, sf_dir, "fix_events"), "fix_id", 100, "insurance").select(
        "fix_id", "domain", "fix_action", "rows_affected")


@query("column_history", """
SELECT 'issue' AS event, logged_at AS at, run_id, dimension, issue_type AS what, affected_rows AS rows
FROM issue_log WHERE domain = 'finance' AND column_name = 'col_3'
UNION ALL SELECT 'fix', applied_at, run_id, dimension, fix_action, rows_affected
FROM fix_events WHERE domain = 'finance' AND column_name = 'col_3'""")
def column_history(spark, sf_dir):
    return history.column_history(view(spark, sf_dir, "issue_log"), view(spark, sf_dir, "fix_events"),
                                  "finance", "col_3")


DIMS = ["completeness", "validity", "accuracy", "timeliness", "integrity", "lineage"]


@query("global_summary", f"""
WITH latest AS (SELECT * FROM analysis_runs QUALIFY row_number() OVER (PARTITION BY domain ORDER BY run_id DESC) = 1)
SELECT domain, run_id, overall_score, row_count,
 CAST((SELECT count(*) FROM issue_log i WHERE i.run_id = latest.run_id) AS BIGINT) AS total_issues,
 {', '.join(f"(SELECT any_value(score) FROM run_scores s WHERE s.run_id = latest.run_id AND s.dimension = '{d}') AS {d}" for d in DIMS)}
FROM latest""")
def global_summary(spark, sf_dir):
    return history.global_summary(*(view(spark, sf_dir, n) for n in
                                    ("analysis_runs", "run_scores", "issue_log")), DIMS)


@query("recurrence", """
SELECT s.domain, s.column_name, s.issue_type, occurrences, runs, CAST(coalesce(fixes, 0) AS BIGINT) AS fixes,
 round(good * 1.0 / fixes, 4) AS fix_success_rate
FROM (SELECT domain, column_name, issue_type, CAST(count(*) AS BIGINT) AS occurrences,
  CAST(count(DISTINCT run_id) AS BIGINT) AS runs FROM issue_log GROUP BY ALL) s
LEFT JOIN (SELECT domain, column_name, issue_type, count(*) AS fixes, sum(success) AS good FROM fix_events
  GROUP BY ALL) f USING (domain, column_name, issue_type)""")
def recurrence(spark, sf_dir):
    return history.recurrence(view(spark, sf_dir, "issue_log"), view(spark, sf_dir, "fix_events"))


# --- reports -----------------------------------------------------------------------------------------

LABEL = ("CASE WHEN score >= 90 THEN 'EXCELLENT' WHEN score >= 70 THEN 'GOOD' WHEN score >= 50 THEN 'FAIR' "
         "WHEN score >= 25 THEN 'POOR' ELSE 'CRITICAL' END")
BAND = ("CASE WHEN score < 25 THEN 'CRITICAL' WHEN score < 50 THEN 'HIGH' WHEN score < 70 THEN 'MEDIUM' "
        "WHEN score < 85 THEN 'LOW' ELSE 'OK' END")


@query("report_scorecard", f"""
SELECT run_id, dimension, round(score, 2) AS score, {LABEL} AS status, issues_found, {BAND} AS severity FROM run_scores""")
def report_scorecard(spark, sf_dir):
    return reports.scorecard(view(spark, sf_dir, "run_scores"))


@query("report_severity_distribution", f"""
SELECT run_id, severity, CAST(count(*) AS BIGINT) AS dimensions FROM (
 SELECT run_id, CASE WHEN score >= 70 THEN 'LOW' ELSE {BAND} END AS severity FROM run_scores) GROUP BY ALL""")
def report_severity_distribution(spark, sf_dir):
    return reports.severity_distribution(view(spark, sf_dir, "run_scores"))


ORDER = "affected_rows DESC, column_name, issue_type"


def _one_run(issues):
    """The log as one long run, so that a dimension holds far more issues than a report shows."""
    return issues.drop("run_id")


@query("report_top_issues", f"""
SELECT run_id, dimension, position, column_name, issue_type, affected_rows,
 round(affected_pct * 100, 1) AS affected_percent, severity, fix_action FROM (
 SELECT *, CAST(row_number() OVER (PARTITION BY run_id, dimension ORDER BY {ORDER}) AS INT) AS position FROM issue_log)
WHERE position <= 15""")
def report_top_issues(spark, sf_dir):
    return reports.top_issues(view(spark, sf_dir, "issue_log"))


@query("report_top_issues_overall", f"""
SELECT dimension, position, affected_rows FROM (
 SELECT *, CAST(row_number() OVER (PARTITION BY dimension ORDER BY {ORDER}) AS INT) AS position FROM issue_log)
WHERE position <= 15""")
def report_top_issues_overall(spark, sf_dir):
    return reports.top_issues(_one_run(view(spark, sf_dir, "issue_log"))).select(
        "dimension", "position", "affected_rows")


@query("report_issue_manifest", """
SELECT run_id, dimension, column_name, issue_type, affected_rows, round(affected_pct * 100, 2) AS affected_percent,
 severity, risk_level, fix_action, CASE WHEN auto_fixable THEN 'Yes' ELSE 'No' END AS auto_fixable FROM issue_log""")
def report_issue_manifest(spark, sf_dir):
    return reports.issue_manifest(view(spark, sf_dir, "issue_log"))


def _recommend(per: int, below: str, limit: str) -> str:
    return f"""
SELECT run_id, 'P' || CAST(place AS VARCHAR) AS priority, dimension, column_name, issue_type, fix_action, severity,
 risk_level, affected_rows FROM (
 SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY score, dimension, r) AS place FROM (
  SELECT i.*, s.score FROM (SELECT *, row_number() OVER (PARTITION BY run_id, dimension ORDER BY {ORDER}) AS r
   FROM issue_log WHERE severity IN ('CRITICAL', 'HIGH')) i
  JOIN run_scores s USING (run_id, dimension) WHERE r <= {per} {below})) {limit}"""


@query("report_recommendations", _recommend(3, "AND s.score < 85", "WHERE place <= 15"))
def report_recommendations(spark, sf_dir):
    return reports.recommendations(view(spark, sf_dir, "issue_log"), view(spark, sf_dir, "run_scores"))


@query("report_recommendation_manifest", _recommend(5, "", ""))
def report_recommendation_manifest(spark, sf_dir):
    return reports.recommendations(view(spark, sf_dir, "issue_log"), view(spark, sf_dir, "run_scores"),
                                   per_dimension=5, below=None, limit=None)


@query("report_alert_digest", """
SELECT run_id, dimension, column_name, issue_type, affected_rows, severity FROM issue_log
ORDER BY affected_rows DESC, run_id, dimension, column_name, issue_type, severity LIMIT 8""")
def report_alert_digest(spark, sf_dir):
    return reports.alert_digest(view(spark, sf_dir, "issue_log"))


@query("report_approvals", """
SELECT run_id, dimension, column_name, issue_type, affected_rows, severity, risk_level, fix_action
FROM issue_log WHERE risk_level IN ('HIGH', 'CRITICAL')""")
def report_approvals(spark, sf_dir):
    return reports.approvals(view(spark, sf_dir, "issue_log"))


@query("report_approval_counts", """
SELECT run_id, CAST(count(*) AS BIGINT) AS to_approve FROM issue_log WHERE risk_level = 'HIGH' GROUP BY run_id""")
def report_approval_counts(spark, sf_dir):
    return reports.approval_counts(view(spark, sf_dir, "issue_log"))


def _mentions(words):
    return " OR ".join(f"contains(lower(role), '{w}') OR contains(lower(access_group), '{w}')" for w in words)


@query("access_review", f"""
SELECT principal_id, role, access_group, CASE
 WHEN ({_mentions(fv.TRUSTED_ROLES)}) AND NOT can_view_sensitive THEN 'GRANT' WHEN {_mentions(fv.TRUSTED_ROLES)} THEN 'KEEP'
 WHEN ({_mentions(fv.UNTRUSTED_ROLES)}) AND can_view_sensitive THEN 'REVOKE' WHEN {_mentions(fv.UNTRUSTED_ROLES)} THEN 'KEEP'
 ELSE 'REVIEW' END AS advice FROM principals""")
def access_review(spark, sf_dir):
    return reports.access_review(view(spark, sf_dir, "principals")).select(
        "principal_id", "role", "access_group", "advice")


@query("over_privileged", f"""
SELECT principal_id, access_group, '{", ".join(sorted(NAMED))}' AS sensitive_columns FROM principals
WHERE access_group IN ('Marketing Team', 'External Contractors', 'Analytics') AND can_view_sensitive""")
def over_privileged(spark, sf_dir):
    found = [r["column_name"] for r in privacy.pii_columns(keyed(spark, sf_dir, C)).collect()]
    return reports.over_privileged(view(spark, sf_dir, "principals"), found).select(
        "principal_id", "access_group", "sensitive_columns")


@query("any_column_search", """
SELECT principal_id, name, role, access_group FROM principals WHERE contains(lower(name), 'analyst')
 OR contains(lower(role), 'analyst') OR contains(lower(access_group), 'analyst') OR contains(lower(email), 'analyst')""")
def any_column_search(spark, sf_dir):
    return reports.search(view(spark, sf_dir, "principals"), "ANALYST").select(
        "principal_id", "name", "role", "access_group")


@query("any_column_search_documents", """
SELECT doc_id FROM documents WHERE contains(lower(text), 'license') OR contains(lower(lang), 'license') OR contains(lower(source), 'license')""")
def any_column_search_documents(spark, sf_dir):
    return reports.search(table(spark, sf_dir, "documents"), "License").select("doc_id")


@query("access_matrix", f"""
SELECT c.column_name, d.column_name IS NOT NULL AS sensitive,
 CASE WHEN d.column_name IS NOT NULL THEN 'Data Engineering, Compliance' ELSE 'Data Engineering, Analytics, Compliance, Marketing Team' END AS groups_with_access
FROM (SELECT unnest(['customer_id','customer_name','email','phone','ssn','zip_code','age','gender','currency','balance','fraud_flag','coverage_amount','claim_amount','segment','note','abbr']) AS column_name) c
LEFT JOIN ({PII_CUSTOMERS}) d USING (column_name)""")
def access_matrix(spark, sf_dir):
    t = keyed(spark, sf_dir, C)
    columns = spark.createDataFrame([(c,) for c in t.columns], "column_name string")
    return reports.access_matrix(columns, privacy.pii_columns(t))


@query("health_summary", """
SELECT run_id, CAST(sum(issues_found) AS BIGINT) AS total_issues,
 CAST(count(*) FILTER (WHERE issues_found > 0) AS BIGINT) AS dimensions_with_issues,
 coalesce(string_agg(dimension, ', ' ORDER BY dimension) FILTER (WHERE score < 70), '') AS critical_dimensions
FROM run_scores GROUP BY run_id""")
def health_summary(spark, sf_dir):
    return reports.health_summary(view(spark, sf_dir, "run_scores"))


@query("one_issue_per_type", f"""
SELECT run_id, dimension, column_name, issue_type, affected_rows, severity, occurrences FROM (
 SELECT *, row_number() OVER (PARTITION BY run_id, dimension ORDER BY {ORDER}) AS r,
  CAST(count(*) OVER (PARTITION BY run_id, dimension) AS BIGINT) AS occurrences FROM issue_log) WHERE r = 1""")
def one_issue_per_type(spark, sf_dir):
    return reports.one_per_type(view(spark, sf_dir, "issue_log"))


@query("issues_minor_major", """
SELECT CASE WHEN risk_level = 'LOW' THEN 'minor' ELSE 'major' END AS size, CAST(count(*) AS BIGINT) AS issues
FROM issue_log GROUP BY ALL""")
def issues_minor_major(spark, sf_dir):
    return reports.by_risk(view(spark, sf_dir, "issue_log")).groupBy("size").agg(
        F.count(F.lit(1)).alias("issues"))


@query("issues_on_columns", """
SELECT run_id, dimension, column_name, issue_type, affected_rows FROM issue_log WHERE column_name IN ('col_1', 'col_7')""")
def issues_on_columns(spark, sf_dir):
    return reports.issues_on_columns(view(spark, sf_dir, "issue_log"), ["col_1", "col_7"]).select(
        "run_id", "dimension", "column_name", "issue_type", "affected_rows")


@query("issues_of_source", """
SELECT run_id, dimension, column_name, issue_type, affected_rows FROM issue_log WHERE column_name IN ('col_2', 'col_5')""")
def issues_of_source(spark, sf_dir):
    mapping = spark.createDataFrame([("ledger", "col_2"), ("ledger", "col_5"), ("claims", "col_8")],
                                    "source string, column_name string")
    return reports.issues_of_source(view(spark, sf_dir, "issue_log"), mapping, "ledger").select(
        "run_id", "dimension", "column_name", "issue_type", "affected_rows")


ADVICE = ", ".join(f"('{d}', '{t}')" for d, t in reports.RECOMMENDATIONS.items())


@query("column_drilldown", f"""
SELECT run_id, dimension, issue_type, affected_rows, risk_level AS severity, recommendation
FROM issue_log LEFT JOIN (VALUES {ADVICE}) a(dimension, recommendation) USING (dimension) WHERE column_name = 'col_4'""")
def column_drilldown(spark, sf_dir):
    return reports.column_drilldown(view(spark, sf_dir, "issue_log"), "col_4")


AFTER = ("SELECT run_id, dimension, least(100, score + run_id % 30) AS score, "
         "CAST(issues_found // 2 AS BIGINT) AS issues_found FROM run_scores WHERE dimension <> 'lineage'")


def _comparison(spark, sf_dir):
    before = view(spark, sf_dir, "run_scores")
    after = before.where("dimension <> 'lineage'").selectExpr(
        "run_id", "dimension", "least(100, score + run_id % 30) AS score",
        "issues_found div 2 AS issues_found")
    return reports.compare(before, after)


COMPARE = f"""SELECT run_id, dimension, b.score AS score_before, coalesce(a.score, b.score) AS score_after,
 round(coalesce(a.score, b.score) - b.score, 1) AS delta, b.issues_found AS issues_before,
 coalesce(a.issues_found, b.issues_found) AS issues_after,
 b.issues_found - coalesce(a.issues_found, b.issues_found) AS issues_resolved
FROM run_scores b LEFT JOIN ({AFTER}) a USING (run_id, dimension)"""


@query("pre_post_comparison", COMPARE)
def pre_post_comparison(spark, sf_dir):
    return _comparison(spark, sf_dir)


@query("pre_post_improvement", f"""
SELECT run_id, CAST(sum(issues_before) AS BIGINT) AS issues_before, CAST(sum(issues_resolved) AS BIGINT) AS issues_resolved,
 round(sum(issues_resolved) * 1.0 / sum(issues_before) * 100, 1) AS reduction_pct FROM ({COMPARE}) GROUP BY run_id""")
def pre_post_improvement(spark, sf_dir):
    return reports.improvement(_comparison(spark, sf_dir))
