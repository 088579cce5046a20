"""Quartile fences: outliers, extreme outliers and their report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import fixed_values as fv, text
from .quantiles import exact_quantiles
from .rule import Rule
from .table import Table

MIN_VALUES = 10


def numeric_views(table: Table, known: dict[str, bool] | None = None) -> dict[str, Column]:
    """Numeric columns, and text columns of which more than half reads as a number; for the columns of
    ``known`` that is not asked again."""
    known = known or {}
    views = {c: table.number(c) for c in table.numbers}
    named = [c for c in table.texts if text.contains_any(c, fv.NUMERIC_TEXT_WORDS)]
    views.update({c: table.money(c) for c in named if known.get(c)})
    maybe = [c for c in named if c not in known]
    if maybe:
        readable = {c: table.money(c) for c in maybe}
        row = table.frame().agg(F.count(F.lit(1)).alias("total"), *[
            F.count(v).alias(f"n{i}") for i, v in enumerate(readable.values())]).first()
        views.update({c: v for i, (c, v) in enumerate(readable.items())
                      if row[f"n{i}"] > row["total"] * 0.5})
    return views


def fences(table: Table, views: dict[str, Column], factor: float,
           facts: dict | None = None) -> dict[str, dict]:
    """{column: {"lower", "upper", "q1", "q3", "mean", "std", "count"}} where a fence exists."""
    facts = facts or exact_quantiles(table.frame(), views, [0.25, 0.75])
    out = {}
    for c, f in facts.items():
        if f["count"] < MIN_VALUES or f["quantiles"][0] == f["quantiles"][1]:
            continue
        q1, q3 = f["quantiles"]
        spread = q3 - q1
        out[c] = {**f, "q1": q1, "q3": q3, "lower": q1 - factor * spread,
                  "upper": q3 + factor * spread}
    return out


def outside(value: Column, fence: dict) -> Column:
    return (value < fence["lower"]) | (value > fence["upper"])


def outlier_rules(table: Table, views: dict[str, Column], fence_of: dict) -> list[Rule]:
    return [Rule("accuracy", c, "statistical_outlier", outside(views[c], f),
                 base=views[c], over=0.005, risk="MEDIUM", fix="cap_winsorize_outliers",
                 text=f"outside [{f['lower']:.2f}, {f['upper']:.2f}]", value=views[c])
            for c, f in fence_of.items()]


def extreme_columns(table: Table, skip: list[str] = fv.EXTREME_SKIP_WORDS) -> list[str]:
    return [c for c in table.numbers if not text.contains_any(c, skip)]


def extreme_rules(table: Table, fence_of: dict) -> list[Rule]:
    return [Rule("reasonableness", c, "statistical_outliers", outside(table.number(c), f),
                 severity="extreme", fix="cap_outliers_iqr", auto=True,
                 text=f"far outside [{f['lower']:.2f}, {f['upper']:.2f}]", value=table.number(c))
            for c, f in fence_of.items()]


def outlier_report(table: Table, factor: float = 1.5, z: float = 3.0) -> DataFrame:
    """Quartiles, fences, fence and z-score counts per numeric column."""
    views = numeric_views(table)
    fence_of = fences(table, views, factor)
    spark = table.df.sparkSession
    schema = ("column_name string, q1 double, q3 double, lower_bound double, upper_bound double, "
              "outliers bigint, z_outliers bigint, values bigint")
    if not fence_of:
        return spark.createDataFrame([], schema)
    aggregates, cells = [], []
    for i, (c, f) in enumerate(fence_of.items()):
        v = views[c]
        aggregates.append(F.count_if(outside(v, f)).alias(f"o{i}"))
        aggregates.append(F.count_if(F.abs((v - f["mean"]) / f["std"]) > z).alias(f"z{i}"))
        cells.append(F.struct(
            F.lit(c).alias("column_name"), F.lit(f["q1"]).alias("q1"), F.lit(f["q3"]).alias("q3"),
            F.lit(f["lower"]).alias("lower_bound"), F.lit(f["upper"]).alias("upper_bound"),
            F.col(f"o{i}").alias("outliers"), F.col(f"z{i}").alias("z_outliers"),
            F.lit(f["count"]).alias("values")))
    return table.frame().agg(*aggregates).select(F.inline(F.array(*cells)))
