"""Dimension scores and the overall score, computed from the issue table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from ..functions import fixed_values as fv, scoring


@dataclass
class Facts:
    """What the scores need beyond the issues."""
    total_rows: int
    columns: int
    checked_columns: int = 1      # columns with a pattern or a range
    numeric_cells: int = 0        # non-null cells of the numeric columns
    stale_rows: int = 0           # rows older than three times the agreed freshness
    missing_lineage: int = 0


def score_of(facts: Facts) -> dict[str, str]:
    """One SQL aggregate over the issues of a dimension per dimension."""
    total = float(max(facts.total_rows, 1))
    rows, shares = "sum(affected_rows)", "sum(affected_pct)"

    def of(kind: str, value: str = "affected_rows") -> str:
        return f"sum(CASE WHEN issue_type = '{kind}' THEN {value} ELSE 0 END)"

    def by_share(points: int) -> str:
        return f"100 - {shares} * {points}"

    def capped(points: int, divisor: int = 1) -> str:
        return f"100 - least(100, {rows} / {total * divisor}D * {points})"

    lineage = 60 if facts.missing_lineage > 2 else 100 - 5 * facts.missing_lineage
    return {
        "completeness": f"100 - {of('missing_values')} / {total * max(facts.columns, 1)}D * 200",
        "uniqueness": f"100 - {of('exact_duplicates')} / {total}D * 60"
                      f" - {of('duplicate_ids', 'affected_pct')} * 30",
        "validity": f"100 - {rows} / {total * max(1, facts.checked_columns)}D * 300",
        "consistency": capped(200),
        "standardization": capped(200, 3),
        "accuracy": f"100 - {rows} / {float(max(facts.numeric_cells, 1))}D * 150",
        "timeliness": f"100 - {facts.stale_rows / total}D * 50"
                      f" - {of('future_dated_record')} / {total}D * 100",
        "profiling": "100 - count_if(severity IN ('CRITICAL', 'HIGH')) * 10",
        "business_rules": capped(300),
        "pii_security": "100 - count_if(startswith(issue_type, 'pii_detected')) * 10",
        "auditability": f"100 - {of('missing_audit_timestamp', '25')}"
                        f" - {of('missing_primary_key', '30')}"
                        f" - {of('missing_audit_timestamp_value', 'affected_pct')} * 20",
        "reconciliation": f"100 - {rows} / {total}D * 50",
        "survivorship": f"100 - {of('survivorship_conflict')} / {total}D * 200",
        "accessibility": by_share(100),
        "conformity": by_share(100),
        "constraints": by_share(100),
        "enrichment": by_share(20),
        "freshness": by_share(80),
        "integrity": by_share(150),
        "lineage": str(lineage),
        "reasonableness": by_share(80),
        "reliability": by_share(100),
    }


def dimension_scores(issues: DataFrame, facts: Facts, dimensions: list[str]) -> DataFrame:
    """(dimension, display_name, score, severity, issues_found); clean dimensions included.

    A clean dimension has no issue row; it enters as one empty row so that every formula sees it.
    """
    spark = issues.sparkSession
    every = spark.createDataFrame([(d, d.replace("_", " ").capitalize()) for d in dimensions],
                                  "dimension string, display_name string")
    joined = F.broadcast(every).join(issues, "dimension", "left").selectExpr(
        "dimension", "display_name", "issue_type IS NOT NULL AS real",
        "COALESCE(affected_rows, 0L) AS affected_rows", "COALESCE(affected_pct, 0D) AS affected_pct",
        "COALESCE(issue_type, 'none') AS issue_type", "COALESCE(severity, 'OK') AS severity")
    formulas = score_of(facts)
    cases = " ".join(f"WHEN '{d}' THEN {formulas[d]}" for d in dimensions)
    grouped = joined.groupBy("dimension", "display_name").agg(
        F.expr("count_if(real) AS issues_found"),
        F.expr(f"round(greatest(0D, CAST(CASE dimension {cases} END AS DOUBLE)), 2) AS score"))
    return grouped.select("dimension", "display_name", "score",
                          scoring.severity_of_score(F.col("score")).alias("severity"), "issues_found")


def overall_score(scores: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """One row: weighted mean, label and gate; a dimension without a weight counts 1."""
    weights = weights or fv.DIMENSION_WEIGHTS
    spark = scores.sparkSession
    known = spark.createDataFrame(list(weights.items()), "dimension string, weight double")
    weight = F.coalesce("weight", F.lit(1.0))
    return (scores.join(F.broadcast(known), "dimension", "left")
            .agg(F.coalesce(F.try_divide(F.sum(F.col("score") * weight), F.sum(weight)),
                            F.lit(0.0)).alias("overall_score"),
                 F.count(F.lit(1)).alias("dimensions"), F.sum("issues_found").alias("total_issues"))
            .select(F.round("overall_score", 2).alias("overall_score"), "dimensions",
                    "total_issues", scoring.score_label(F.col("overall_score")).alias("label"),
                    scoring.gate(F.col("overall_score")).alias("gate")))
