"""Run, issue and fix history as append-only tables, and the questions asked of it."""

from __future__ import annotations

import datetime as dt
import json
import secrets
import time

from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.errors import AnalysisException

from ..functions import scoring
from .issue_rows import first_keys, issue_rows

SCHEMAS = {
    "analysis_runs": "run_id bigint, dataset_name string, domain string, row_count bigint, "
                     "col_count int, overall_score double, run_timestamp string, "
                     "run_duration_sec double, summary_json string",
    "dimension_scores": "run_id bigint, dimension string, score double, issues_found bigint, "
                        "severity string, details_json string",
    "issue_log": "run_id bigint, domain string, dimension string, column_name string, "
                 "issue_type string, description string, affected_rows bigint, "
                 "affected_pct double, severity string, risk_level string, sample_values string, "
                 "row_keys string, logged_at string",
    "issue_rows": "row_key string, column_name string, issue_type string, value string, run_id bigint, "
                  "dimension string",
    "fix_history": "fix_id string, run_id bigint, domain string, dimension string, "
                   "column_name string, issue_type string, fix_action string, fix_params string, "
                   "rows_affected bigint, success int, status string, applied_by string, "
                   "applied_at string, notes string",
    "learning_patterns": "domain string, dimension string, column_name string, issue_type string, "
                         "fix_action string, occurrence_count bigint, success_count bigint, "
                         "failure_count bigint, success_rate double, last_seen string, "
                         "auto_fix_eligible int",
    "custom_business_rules": "rule_id bigint, domain string, rule_name string, "
                             "description string, rule_type string, target_field string, "
                             "rule_expression string, severity string, fix_action string, "
                             "is_active int, created_at string, updated_at string",
    "pii_masking_log": "run_id bigint, domain string, pii_field string, masking_mode string, "
                       "rows_masked bigint, masked_at string",
    "audit_trail": "event_type string, event_detail string, domain string, user_action string, "
                   "timestamp string",
}

# Tables whose rows grow with the checked tables lie in folders that a question about one run reads alone.
PARTITIONS = {"issue_rows": ["run_id", "dimension"]}

class Store:
    """The history tables under one folder, as Parquet."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def read(self, name: str) -> DataFrame:
        reader = self.spark.read.schema(SCHEMAS[name])
        try:
            return reader.parquet(self.path(name))
        except AnalysisException as error:
            if "PATH_NOT_FOUND" in str(error.getCondition()):
                return self.spark.createDataFrame([], SCHEMAS[name])
            raise

    def append(self, name: str, rows: DataFrame) -> None:
        shaped = self.spark.createDataFrame([], SCHEMAS[name]).unionByName(
            rows, allowMissingColumns=True)
        writer = shaped.write.mode("append")
        if name in PARTITIONS:
            writer = writer.partitionBy(*PARTITIONS[name])
        writer.parquet(self.path(name))

    def next_run_id(self) -> int:
        """A run id that no other writer takes, later ones larger: milliseconds since 1970, then 22 random bits."""
        return (time.time_ns() // 1_000_000 << 22) | secrets.randbits(22)

    def log_run(self, analysis, dataset_name: str, at: dt.datetime, seconds: float,
                row_keys: DataFrame | None = None, rows: bool = False) -> int:
        """Append a run with its scores and issues.

        With ``rows``, the keys of all rows of all issues are written too, and the first hundred of each
        stand beside it in the issue log; else ``row_keys`` may bring (dimension, column_name, issue_type,
        row_keys).
        """
        run_id, stamp = self.next_run_id(), at.isoformat()
        if rows:
            key = analysis.table.row_key[0]
            self.append("issue_rows", issue_rows(analysis).select(
                F.col(f"`{key}`").cast("string").alias("row_key"), "column_name", "issue_type", "value",
                F.lit(run_id).cast("bigint").alias("run_id"), "dimension"))
            kind = analysis.table.df.schema[key].dataType
            written = self.read("issue_rows").where(F.col("run_id") == run_id)
            row_keys = first_keys(written.withColumn("row_key", F.col("row_key").cast(kind)), ["row_key"])
        overall = analysis.overall.first()
        run = [(run_id, dataset_name, analysis.domain, analysis.facts.total_rows,
                analysis.facts.columns, float(overall["overall_score"]), stamp, round(seconds, 3),
                json.dumps({"dimensions": overall["dimensions"],
                            "issues": overall["total_issues"], "errors": analysis.errors}))]
        self.append("analysis_runs", self.spark.createDataFrame(run, SCHEMAS["analysis_runs"]))
        # Details: rows per column and issue type, and the share of rows; a few entries a dimension.
        details = analysis.issues.groupBy("dimension").agg(F.to_json(F.array_sort(F.collect_list(F.struct(
            "column_name", "issue_type", "affected_rows", "affected_pct")))).alias("details_json"))
        self.append("dimension_scores", analysis.scores.join(details, "dimension", "left").select(
            F.lit(run_id).cast("bigint").alias("run_id"), "dimension",
            F.round("score", 2).alias("score"), F.col("issues_found").cast("bigint"), "severity",
            F.coalesce("details_json", F.lit("[]")).alias("details_json")))
        issues = analysis.issues
        if row_keys is not None:
            issues = issues.join(row_keys, ["dimension", "column_name", "issue_type"], "left")
            keys = F.to_json("row_keys")
        else:
            keys = F.lit(None).cast("string")
        self.append("issue_log", issues.select(
            F.lit(run_id).cast("bigint").alias("run_id"), F.lit(analysis.domain).alias("domain"),
            "dimension", "column_name", "issue_type", "description", "affected_rows",
            F.round("affected_pct", 4).alias("affected_pct"), "severity", "risk_level",
            F.when(F.size("sample_values") > 0, F.to_json("sample_values")).alias("sample_values"),
            keys.alias("row_keys"), F.lit(stamp).alias("logged_at")))
        self.log_event("analysis_completed", f"run {run_id}", analysis.domain, at)
        return run_id

    def log_fixes(self, run_id: int, domain: str, log: DataFrame, at: dt.datetime,
                  successes: DataFrame | None = None) -> None:
        """Append a change log with the type of the issue that each fix answers. ``successes``
        (dimension, column_name, success) says whether the issue count fell after the fix; without it a
        fix counts as successful."""
        rows = log if "issue_type" in log.columns else log.withColumn("issue_type", F.lit(None).cast("string"))
        if successes is not None:
            rows = rows.join(F.broadcast(successes), ["dimension", "column_name"], "left")
        else:
            rows = rows.withColumn("success", F.lit(1))
        # A repair names the issue type it answers; where it cannot, the run's issue of the column does.
        known = (self.read("issue_log").where(F.col("run_id") == run_id).groupBy("dimension", "column_name")
                 .agg(F.min("issue_type").alias("found_type")))
        rows = rows.join(F.broadcast(known), ["dimension", "column_name"], "left")
        self.append("fix_history", rows.select(
            F.expr("uuid()").alias("fix_id"), F.lit(run_id).cast("bigint").alias("run_id"),
            F.lit(domain).alias("domain"), "dimension", "column_name",
            F.coalesce("issue_type", "found_type").alias("issue_type"),
            F.col("action").alias("fix_action"),
            "rows_affected", F.coalesce("success", F.lit(1)).cast("int").alias("success"),
            F.lit("Applied").alias("status"), F.lit("user").alias("applied_by"),
            F.lit(at.isoformat()).alias("applied_at"), F.col("detail").alias("notes")))
        self.log_event("fix_applied", f"run {run_id}", domain, at)

    def log_masking(self, run_id: int, domain: str, log: DataFrame, at: dt.datetime) -> None:
        self.append("pii_masking_log", masking_log(log, run_id, domain, at.isoformat()))

    def log_event(self, kind: str, detail: str, domain: str | None, at: dt.datetime,
                  action: str | None = None) -> None:
        self.append("audit_trail", self.spark.createDataFrame(
            [(kind, detail, domain, action, at.isoformat())], SCHEMAS["audit_trail"]))

    def save_rule(self, domain: str, name: str, expression: str, severity: str, at: dt.datetime,
                  description: str = "", rule_type: str = "field", target: str | None = None,
                  fix_action: str | None = None) -> int:
        rules = self.read("custom_business_rules")
        rule_id = (rules.agg(F.max("rule_id")).first()[0] or 0) + 1
        stamp = at.isoformat()
        self.append("custom_business_rules", self.spark.createDataFrame(
            [(rule_id, domain, name, description, rule_type, target, expression, severity,
              fix_action, 1, stamp, stamp)], SCHEMAS["custom_business_rules"]))
        return rule_id

    def rules(self, domain: str | None = None) -> DataFrame:
        active = self.read("custom_business_rules").where("is_active = 1")
        return active if domain is None else active.where(F.col("domain") == domain)


def masking_log(log: DataFrame, run_id: int, domain: str, stamp: str) -> DataFrame:
    return log.select(
        F.lit(run_id).cast("bigint").alias("run_id"), F.lit(domain).alias("domain"),
        F.col("column_name").alias("pii_field"), "masking_mode",
        F.col("rows_affected").alias("rows_masked"), F.lit(stamp).alias("masked_at"))


PATTERN_KEYS = ["domain", "dimension", "column_name", "issue_type", "fix_action"]


def learning_patterns(fixes: DataFrame) -> DataFrame:
    """Success counts per kind of fix. The table is an aggregate of the events, so nothing is ever
    updated in place; a fix is trusted after three uses with 95 % success."""
    n, good = F.count(F.lit(1)), F.sum("success")
    rate = good / n
    return fixes.groupBy(*PATTERN_KEYS).agg(
        n.alias("occurrence_count"), good.cast("bigint").alias("success_count"),
        (n - good).cast("bigint").alias("failure_count"), F.round(rate, 4).alias("success_rate"),
        F.max("applied_at").alias("last_seen"),
        F.when((n >= 3) & (rate >= 0.95), 1).otherwise(0).alias("auto_fix_eligible"))


def best_fixes(patterns: DataFrame) -> DataFrame:
    """The most successful fix of every issue, for all issues at once."""
    keys = PATTERN_KEYS[:-1]
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(
        F.desc("success_rate"), F.desc("occurrence_count"), F.asc("fix_action")))
    return (patterns.withColumn("__rank", rank).where(F.col("__rank") == 1)
            .select(*keys, "fix_action", "occurrence_count", "success_rate", "auto_fix_eligible"))


def recent(rows: DataFrame, order: str, limit: int, domain: str | None = None) -> DataFrame:
    """The latest ``limit`` rows, of one domain or of all."""
    if domain is not None:
        rows = rows.where(F.col("domain") == domain)
    return rows.orderBy(F.desc(order)).limit(limit)


def issues_of_run(issues: DataFrame, run_id: int) -> DataFrame:
    """Gravest first, then most rows."""
    return (issues.where(F.col("run_id") == run_id)
            .orderBy(F.desc(scoring.severity_rank(F.col("severity"))), F.desc("affected_rows")))


def patterns_by_use(patterns: DataFrame) -> DataFrame:
    return patterns.orderBy(F.desc("occurrence_count"), *PATTERN_KEYS)


def column_history(issues: DataFrame, fixes: DataFrame, domain: str, column: str) -> DataFrame:
    """Issues and fixes of one column as one timeline, newest first."""
    mine = (F.col("domain") == domain) & (F.col("column_name") == column)
    found = issues.where(mine).select(
        F.lit("issue").alias("event"), F.col("logged_at").alias("at"), "run_id", "dimension",
        F.col("issue_type").alias("what"), F.col("affected_rows").alias("rows"))
    fixed = fixes.where(mine).select(
        F.lit("fix").alias("event"), F.col("applied_at").alias("at"), "run_id", "dimension",
        F.col("fix_action").alias("what"), F.col("rows_affected").alias("rows"))
    return found.unionByName(fixed).orderBy(F.desc("at"))


def latest_runs(runs: DataFrame) -> DataFrame:
    return runs.groupBy("domain").agg(
        F.max("run_id").alias("run_id"),
        F.max_by("overall_score", "run_id").alias("overall_score"),
        F.max_by("row_count", "run_id").alias("row_count"))


def global_summary(runs: DataFrame, scores: DataFrame, issues: DataFrame,
                   dimensions: list[str] | None = None) -> DataFrame:
    """Latest run per domain with its issue count and, on request, a column per dimension.

    The latest runs are one row per domain; they are broadcast so that the long tables are
    filtered where they lie instead of being shuffled.
    """
    latest = latest_runs(runs)
    keys = F.broadcast(latest.select("run_id"))
    counts = (issues.join(keys, "run_id", "left_semi").groupBy("run_id")
              .agg(F.count(F.lit(1)).alias("total_issues")))
    out = latest.join(counts, "run_id", "left").withColumn(
        "total_issues", F.coalesce("total_issues", F.lit(0)))
    if dimensions:
        wide = (scores.join(keys, "run_id", "left_semi").groupBy("run_id")
                .pivot("dimension", dimensions).agg(F.first("score")))
        out = out.join(wide, "run_id", "left")
    return out


def recurrence(issues: DataFrame, fixes: DataFrame) -> DataFrame:
    """How often each issue came up, how often it was fixed, and with what success."""
    keys = ["domain", "column_name", "issue_type"]
    seen = issues.groupBy(*keys).agg(F.count(F.lit(1)).alias("occurrences"),
                                     F.count_distinct("run_id").alias("runs"))
    fixed = fixes.groupBy(*keys).agg(F.count(F.lit(1)).alias("fixes"),
                                     F.sum("success").alias("good"))
    return seen.join(fixed, keys, "left").select(
        *keys, "occurrences", "runs", F.coalesce("fixes", F.lit(0)).alias("fixes"),
        F.round(F.col("good") / F.col("fixes"), 4).alias("fix_success_rate"))
