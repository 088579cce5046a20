"""Report tables over issues and scores.

Inputs may hold one run or many; with a ``run_id`` column every ranking is per run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions import fixed_values as fv, scoring


def _run(df: DataFrame) -> list[str]:
    return ["run_id"] if "run_id" in df.columns else []


def _order(issues: DataFrame) -> list[Column]:
    """Order in which issues were found; without a number, gravest and largest first."""
    if "issue_no" in issues.columns:
        return [F.asc("issue_no"), F.asc("column_name"), F.asc("issue_type")]
    return [F.desc("affected_rows"), F.asc("column_name"), F.asc("issue_type")]


def scorecard(scores: DataFrame) -> DataFrame:
    """Dimensions from the lowest score up, with label and severity."""
    score = F.col("score")
    return scores.select(
        *_run(scores), "dimension", F.round(score, 2).alias("score"),
        scoring.score_label(score).alias("status"), "issues_found",
        scoring.severity_of_score(score).alias("severity"),
    ).orderBy("score", "dimension")


def severity_distribution(scores: DataFrame) -> DataFrame:
    """Dimensions per severity; LOW and OK count together."""
    band = scoring.severity_of_score(F.col("score"))
    merged = F.when(band.isin("LOW", "OK"), "LOW").otherwise(band)
    return scores.groupBy(*_run(scores), merged.alias("severity")).agg(
        F.count(F.lit(1)).alias("dimensions"))


def top_issues(issues: DataFrame, size: int = 15) -> DataFrame:
    """The first issues of every dimension; ranked inside each task before the shuffle."""
    keys = [*_run(issues), "dimension"]
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*_order(issues)))
    return issues.withColumn("position", rank).where(F.col("position") <= size).select(
        *keys, "position", "column_name", "issue_type", "affected_rows",
        F.round(F.col("affected_pct") * 100, 1).alias("affected_percent"), "severity", "fix_action")


def issue_manifest(issues: DataFrame) -> DataFrame:
    return issues.select(
        *_run(issues), "dimension", "column_name", "issue_type", "affected_rows",
        F.round(F.col("affected_pct") * 100, 2).alias("affected_percent"), "severity", "risk_level",
        "fix_action", F.when(F.col("auto_fixable"), "Yes").otherwise("No").alias("auto_fixable"))


def recommendations(issues: DataFrame, scores: DataFrame, per_dimension: int = 3,
                    below: float | None = 85, limit: int | None = 15) -> DataFrame:
    """Critical issues, worst dimension first, numbered P1, P2, ... within a run."""
    run = _run(issues)
    rank = F.row_number().over(Window.partitionBy(*run, "dimension").orderBy(*_order(issues)))
    critical = (issues.where(scoring.is_critical(F.col("severity")))
                .withColumn("__rank", rank).where(F.col("__rank") <= per_dimension))
    poor = scores if below is None else scores.where(F.col("score") < below)
    joined = critical.join(poor.select(*run, "dimension", "score"), [*run, "dimension"])
    place = Window.partitionBy(*(run or [F.lit(0)])).orderBy("score", "dimension", "__rank")
    numbered = joined.withColumn("__place", F.row_number().over(place))
    if limit is not None:
        numbered = numbered.where(F.col("__place") <= limit)
    return numbered.select(
        *run, F.concat(F.lit("P"), F.col("__place").cast("string")).alias("priority"), "dimension",
        "column_name", "issue_type", "fix_action", "severity", "risk_level", "affected_rows")


def alert_digest(issues: DataFrame, size: int = 8) -> DataFrame:
    """The issues with the most affected rows."""
    columns = [*_run(issues), "dimension", "column_name", "issue_type", "affected_rows", "severity"]
    order = [F.desc("affected_rows")] + [F.asc(c) for c in columns if c != "affected_rows"]
    return issues.select(*columns).orderBy(*order).limit(size)


def approvals(issues: DataFrame) -> DataFrame:
    """Issues whose fix needs approval."""
    return issues.where(F.col("risk_level").isin("HIGH", "CRITICAL")).select(
        *_run(issues), "dimension", "column_name", "issue_type", "affected_rows", "severity",
        "risk_level", "fix_action")


def approval_counts(issues: DataFrame) -> DataFrame:
    run = _run(issues)
    return approvals(issues).groupBy(*run).agg(F.count(F.lit(1)).alias("to_approve"))


def _mentions(c: Column, words: list[str]) -> Column:
    lowered = F.lower(F.coalesce(c, F.lit("")))
    out = F.lit(False)
    for word in words:
        out = out | lowered.contains(word)
    return out


def access_review(principals: DataFrame, role: str = "role", group: str = "access_group",
                  sensitive: str = "can_view_sensitive") -> DataFrame:
    """Advice per principal: GRANT, KEEP, REVOKE or REVIEW."""
    trusted = _mentions(F.col(role), fv.TRUSTED_ROLES) | _mentions(F.col(group), fv.TRUSTED_ROLES)
    untrusted = (_mentions(F.col(role), fv.UNTRUSTED_ROLES)
                 | _mentions(F.col(group), fv.UNTRUSTED_ROLES))
    sees = F.coalesce(F.col(sensitive), F.lit(False))
    return principals.withColumn("advice", F.when(trusted & ~sees, "GRANT").when(trusted, "KEEP")
                                 .when(untrusted & sees, "REVOKE").when(untrusted, "KEEP")
                                 .otherwise("REVIEW"))


def over_privileged(principals: DataFrame, pii_columns: list[str], group: str = "access_group",
                    sensitive: str = "can_view_sensitive") -> DataFrame:
    """Principals of restricted groups that see sensitive columns, with those columns."""
    if not pii_columns:
        return principals.limit(0).withColumn("sensitive_columns", F.lit(""))
    return (principals.where(F.col(group).isin(fv.RESTRICTED_GROUPS) & F.col(sensitive))
            .withColumn("sensitive_columns", F.lit(", ".join(sorted(pii_columns)))))


def search(df: DataFrame, words: str) -> DataFrame:
    """Rows with the text in any column, whatever its case."""
    needle = words.lower()
    hit = F.lit(False)
    for c in df.columns:
        hit = hit | F.coalesce(F.lower(F.col(c).cast("string")).contains(needle), F.lit(False))
    return df.where(hit)


def access_matrix(columns: DataFrame, pii: DataFrame) -> DataFrame:
    """(column_name, sensitive, groups_with_access) from a column list and the detected columns."""
    found = pii.select("column_name", F.lit(True).alias("sensitive"))
    sensitive = F.coalesce("sensitive", F.lit(False))
    return (columns.select("column_name").join(F.broadcast(found), "column_name", "left").select(
        "column_name", sensitive.alias("sensitive"),
        F.when(sensitive, ", ".join(fv.SENSITIVE_GROUPS))
        .otherwise(", ".join(fv.OPEN_GROUPS)).alias("groups_with_access")))


def health_summary(scores: DataFrame) -> DataFrame:
    """Issues in total, dimensions with issues, and the dimensions that score below 70."""
    low = F.when(F.col("score") < 70, F.col("dimension"))
    out = scores.groupBy(*_run(scores)) if _run(scores) else scores.groupBy()
    return out.agg(F.sum("issues_found").cast("bigint").alias("total_issues"),
                   F.count_if(F.col("issues_found") > 0).alias("dimensions_with_issues"),
                   F.concat_ws(", ", F.array_sort(F.collect_list(low))).alias("critical_dimensions"))


def one_per_type(issues: DataFrame, kind: str = "dimension") -> DataFrame:
    """The first issue of every type; a partial pick in each task, no sort of the issues."""
    keys = [*_run(issues), kind]
    rest = [c for c in ("column_name", "issue_type", "affected_rows", "severity") if c != kind]
    order = F.struct("issue_no") if "issue_no" in issues.columns else F.struct(
        -F.col("affected_rows"), "column_name", "issue_type")
    first = F.min_by(F.struct(*rest), order).alias("first")
    return issues.groupBy(*keys).agg(first, F.count(F.lit(1)).alias("occurrences")).select(
        *keys, "first.*", "occurrences")


# --- choosing and comparing -------------------------------------------------------------------------

RECOMMENDATIONS = {
    "completeness": "Require the field at entry and fill gaps with an agreed default.",
    "consistency": "Check related fields against each other when data arrives.",
    "standardization": "Bring values to one agreed format.",
    "enrichment": "Add missing attributes from a trusted reference source.",
    "accuracy": "Compare with the master source and watch for drifting values.",
    "validity": "Test values against patterns and permitted sets.",
    "timeliness": "Shorten delivery and watch the time between source and target.",
    "integrity": "Enforce references and clear orphaned rows.",
    "conformity": "Hold loads to the declared schema.",
    "uniqueness": "Remove copies and index the key as unique.",
    "reasonableness": "Set plausible limits and flag what lies beyond.",
    "lineage": "Record origin and processing steps with each row.",
    "auditability": "Keep the change history of every row.",
    "constraints": "Enforce limits in the database and in the application.",
    "profiling": "Profile regularly and compare with the baseline.",
    "reliability": "Check sources for placeholder values and outages.",
    "accessibility": "Store text in one encoding that every reader accepts.",
    "freshness": "Alert when a delivery misses its agreed age.",
    "pii_security": "Mask, hash or tokenize personal fields.",
    "reconciliation": "Compare counts and sums between source and target.",
    "business_rules": "Run the business rules on every load.",
    "survivorship": "Agree which source wins and build one golden record.",
}


def recommendation_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(RECOMMENDATIONS.items()),
                                 "dimension string, recommendation string")


def column_drilldown(issues: DataFrame, column: str) -> DataFrame:
    """Issues of one column with advice for their dimension."""
    advice = F.broadcast(recommendation_table(issues.sparkSession))
    return (issues.where(F.col("column_name") == column).join(advice, "dimension", "left")
            .select(*_run(issues), "dimension", "issue_type", "affected_rows",
                    F.col("risk_level").alias("severity"), "recommendation"))


def issues_on_columns(issues: DataFrame, columns: list[str]) -> DataFrame:
    return issues.where(F.col("column_name").isin(columns))


def issues_of_source(issues: DataFrame, source_columns: DataFrame, source: str) -> DataFrame:
    """Issues on the columns that a source supplies; the mapping is (source, column_name)."""
    mine = source_columns.where(F.col("source") == source).select("column_name").distinct()
    return issues.join(F.broadcast(mine), "column_name", "left_semi")


def by_risk(issues: DataFrame) -> DataFrame:
    """Every issue as minor (LOW risk) or major."""
    return issues.withColumn("size", F.when(F.col("risk_level") == "LOW", "minor").otherwise("major"))


def compare(before: DataFrame, after: DataFrame) -> DataFrame:
    """Scores and issue counts before and after, per dimension; a missing side counts as unchanged."""
    keys = [*_run(before), "dimension"]
    old = before.select(*keys, F.col("score").alias("b"), F.col("issues_found").alias("bi"))
    new = after.select(*keys, F.col("score").alias("a"), F.col("issues_found").alias("ai"))
    b, a = F.coalesce("b", "a"), F.coalesce("a", "b")
    bi, ai = F.coalesce("bi", "ai"), F.coalesce("ai", "bi")
    return old.join(new, keys, "full_outer").select(
        *keys, b.alias("score_before"), a.alias("score_after"), F.round(a - b, 1).alias("delta"),
        bi.alias("issues_before"), ai.alias("issues_after"), (bi - ai).alias("issues_resolved"))


def improvement(comparison: DataFrame) -> DataFrame:
    """One row (per run): issues before, resolved, and the share resolved in percent."""
    run = _run(comparison)
    grouped = comparison.groupBy(*run) if run else comparison.groupBy()
    before, solved = F.sum("issues_before"), F.sum("issues_resolved")
    return grouped.agg(before.cast("bigint").alias("issues_before"),
                       solved.cast("bigint").alias("issues_resolved"),
                       F.round(scoring.share(solved, before) * 100, 1).alias("reduction_pct"))
