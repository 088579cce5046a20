"""Shared scoring vocabulary as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .fixed_values import (COLUMN_DIMENSIONS, DASHBOARD_LABELS, GATE_SCORE, RATE_BANDS,
                           ROW_DIMENSIONS, SCORE_BANDS, SCORE_LABELS,
                           TABLE_AND_COLUMN_DIMENSIONS, TABLE_DIMENSIONS)


def share(n: Column, total: Column) -> Column:
    return F.coalesce(F.try_divide(n, total), F.lit(0.0)).cast("double")


def _banded(value: Column, bands: list, above: bool, rest: str) -> Column:
    out = None
    for limit, label in bands:
        hit = value >= limit if above else value < limit
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return out.otherwise(rest)


def severity_of_rate(rate: Column) -> Column:
    return _banded(rate, RATE_BANDS, True, "LOW")


def severity_of_score(score: Column) -> Column:
    return _banded(score, SCORE_BANDS, False, "OK")


def risk_of_severity(severity: Column) -> Column:
    return (F.when(severity.isin("CRITICAL", "HIGH"), "HIGH")
            .when(severity == "MEDIUM", "MEDIUM").otherwise("LOW"))


def score_label(score: Column) -> Column:
    return _banded(score, SCORE_LABELS, True, "CRITICAL")


def dashboard_label(score: Column) -> Column:
    return _banded(score, DASHBOARD_LABELS, True, "Critical")


def gate(score: Column) -> Column:
    return F.when(score >= GATE_SCORE, "PASS").otherwise("FAIL")


def is_critical(severity: Column) -> Column:
    return severity.isin("CRITICAL", "HIGH")


def severity_rank(severity: Column) -> Column:
    """4 for CRITICAL down to 0 for OK; orders severities by weight, not by spelling."""
    return (F.when(severity == "CRITICAL", 4).when(severity == "HIGH", 3)
            .when(severity == "MEDIUM", 2).when(severity == "LOW", 1).otherwise(0))


def dimension_levels(spark: SparkSession) -> DataFrame:
    """(dimension, level), one row per level a dimension applies to."""
    rows = ([(d, "column") for d in COLUMN_DIMENSIONS + TABLE_AND_COLUMN_DIMENSIONS]
            + [(d, "row") for d in ROW_DIMENSIONS]
            + [(d, "table") for d in TABLE_DIMENSIONS + TABLE_AND_COLUMN_DIMENSIONS])
    return spark.createDataFrame(rows, "dimension string, level string")
