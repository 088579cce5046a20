"""The same rules on a stream: rows broken per rule and time window."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators.rule import Rule
from ..operators.table import Table


def violation_rates(table: Table, rules: list[Rule], time: str, window: str = "1 hour",
                    late: str = "2 hours") -> DataFrame:
    """(start, rows, issue_type, column_name, affected_rows, affected_pct) per window.

    Works on streaming and on batch tables; rows later than ``late`` are left out of a stream.
    """
    rules = [r for r in rules if r.predicate is not None]
    stamped = table.frame().withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    counts = stamped.groupBy(F.window(time, window).alias("w")).agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.count_if(r.test).alias(f"n{i}") for i, r in enumerate(rules)])
    cells = F.array(*[F.struct(F.lit(r.issue_type).alias("issue_type"),
                               F.lit(r.column).alias("column_name"),
                               F.col(f"n{i}").alias("affected_rows"))
                      for i, r in enumerate(rules)])
    return counts.select(F.col("w.start").alias("start"), "rows", F.inline(cells)).withColumn(
        "affected_pct", F.col("affected_rows") / F.col("rows"))
