"""Column and table profiles."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F

from ..functions import fixed_values as fv, scoring, text
from .duplicates import repeat_counts, top_counts
from .quantiles import exact_quantiles
from .rule import ISSUE_SCHEMA
from .table import Table


def null_counts(table: Table) -> DataFrame:
    """(column_name, null_count, total_rows), one scan."""
    counts = table.df.agg(F.count(F.lit(1)).alias("total"), *[
        F.count_if(table.col(c).isNull()).alias(f"n{i}") for i, c in enumerate(table.columns)])
    return counts.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.lit(i).alias("position"),
                 F.col(f"n{i}").alias("null_count"), F.col("total").alias("total_rows"))
        for i, c in enumerate(table.columns)])))


def completeness_summary(table: Table) -> DataFrame:
    """One row: cells, null cells, null share, emptiest column, complete / incomplete columns."""
    worst = F.min_by("column_name", F.struct(-F.col("null_count"), F.col("position")))
    return null_counts(table).agg(
        F.sum("total_rows").alias("total_cells"), F.sum("null_count").alias("null_cells"),
        F.round(scoring.share(F.sum("null_count"), F.sum("total_rows")) * 100, 2).alias("null_pct"),
        worst.alias("most_incomplete_column"),
        F.count_if(F.col("null_count") == 0).alias("complete_columns"),
        F.count_if(F.col("null_count") > 0).alias("incomplete_columns"))


def column_profile(table: Table, exact: bool = True) -> DataFrame:
    """(column_name, dtype, null_count, null_pct, unique_count, unique_pct).

    Exact distinct counts come from one shuffle over all columns; ``exact=False`` sketches them in
    the same scan as the nulls.
    """
    columns = [c for c in table.columns if table.is_simple(c)]
    nulls = null_counts(table).where(F.col("column_name").isin(columns))
    if exact:
        unique = repeat_counts(table, columns).groupBy("column_name").agg(
            F.count(F.lit(1)).alias("unique_count"))
    else:
        sketched = table.df.agg(*[F.approx_count_distinct(table.col(c)).alias(f"u{i}")
                                  for i, c in enumerate(columns)])
        unique = sketched.select(F.inline(F.array(*[
            F.struct(F.lit(c).alias("column_name"), F.col(f"u{i}").alias("unique_count"))
            for i, c in enumerate(columns)])))
    kinds = F.create_map(*[F.lit(x) for c in columns
                           for x in (c, table.kinds[c].simpleString())])
    found = nulls.join(F.broadcast(unique), "column_name", "left")
    n = F.coalesce("unique_count", F.lit(0))
    return found.select(
        "column_name", kinds[F.col("column_name")].alias("dtype"), "null_count",
        F.round(scoring.share(F.col("null_count"), F.col("total_rows")) * 100, 2).alias("null_pct"),
        n.alias("unique_count"),
        F.round(scoring.share(n, F.col("total_rows")) * 100, 2).alias("unique_pct"))


def numeric_profile(table: Table) -> DataFrame:
    """(column_name, minimum, maximum, mean, median, std, q25, q75, exact_minimum, exact_maximum)
    per numeric column.

    The exact ones are texts of the values in the column's own type, since a double holds whole
    numbers up to 2^53 only.
    """
    facts = exact_quantiles(table.df, {c: table.col(c).cast("double") for c in table.numbers},
                            [0.25, 0.5, 0.75], raw={c: table.col(c) for c in table.numbers})
    rows = []
    for c, f in facts.items():
        if f["count"]:
            n = f["count"]
            std = f["std"] * math.sqrt(n / (n - 1)) if n > 1 else None
            q25, q50, q75 = f["quantiles"]
            rows.append((c, float(f["min"]), float(f["max"]), f["mean"], q50, std, q25, q75,
                         str(f["min"]), str(f["max"])))
    return table.df.sparkSession.createDataFrame(
        rows, "column_name string, minimum double, maximum double, mean double, median double, "
              "std double, q25 double, q75 double, exact_minimum string, exact_maximum string")


def text_profile(table: Table) -> DataFrame:
    """(column_name, top_value, top_freq, min_length, max_length, avg_length) per text column.

    Lengths come from one aggregate, the top value from counts by hash; its text is fetched last.
    """
    columns = table.texts
    if not columns:
        return table.df.sparkSession.createDataFrame(
            [], "column_name string, top_value string, top_freq bigint, min_length int, max_length int, avg_length double")
    sizes = [F.length(table.col(c)) for c in columns]
    row = table.df.agg(*[e for i, n in enumerate(sizes) for e in (
        F.min(n).alias(f"lo{i}"), F.max(n).alias(f"hi{i}"), F.sum(n).alias(f"sum{i}"), F.count(n).alias(f"n{i}"))])
    lengths = row.select(F.inline(F.array(*[F.struct(
        F.lit(c).alias("column_name"), F.col(f"lo{i}").alias("min_length"), F.col(f"hi{i}").alias("max_length"),
        F.round(F.try_divide(F.col(f"sum{i}"), F.col(f"n{i}")), 2).alias("avg_length"))
        for i, c in enumerate(columns)])))
    top = top_counts(table, columns, 1).select(
        "column_name", F.col("value").alias("top_value"), F.col("rows").alias("top_freq"))
    return top.join(F.broadcast(lengths), "column_name")


def dataset_profile(table: Table) -> DataFrame:
    """One row: rows, columns, columns by kind, overall null rate."""
    times = sum(table.is_time(c) for c in table.columns)
    return null_counts(table).agg(
        F.max("total_rows").alias("total_rows"),
        F.lit(len(table.columns)).alias("total_columns"),
        F.lit(len(table.numbers)).alias("numeric_columns"),
        F.lit(len(table.texts)).alias("string_columns"), F.lit(times).alias("date_columns"),
        F.round(scoring.share(F.sum("null_count"), F.sum("total_rows")) * 100, 2)
        .alias("null_rate_overall"))


def plan_size_mb(df: DataFrame) -> float:
    """Size Spark expects of the table, in MB; an estimate from statistics, not memory in use."""
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return round(int(str(size)) / 1_048_576, 2)


def high_cardinality(table: Table, total: int, first: int = 0, only: set[str] | None = None) -> DataFrame:
    """Issues for text columns, or ``only`` these, with more than 90 % distinct values.

    A sketch drops the clear cases; only columns near or above the line are counted exactly.
    """
    spark = table.df.sparkSession
    columns = [c for c in table.texts
               if not text.contains_any(c, fv.HIGH_CARDINALITY_SKIP_WORDS) and (only is None or c in only)]
    empty = spark.createDataFrame([], ISSUE_SCHEMA)
    if not columns or not total:
        return empty
    row = table.df.agg(*[F.approx_count_distinct(table.col(c)).alias(f"u{i}")
                         for i, c in enumerate(columns)]).first()
    near = [c for i, c in enumerate(columns) if row[f"u{i}"] > 0.75 * total]
    if not near:
        return empty
    share = F.round(F.col("n") * 100 / total, 2)
    return (repeat_counts(table, near).groupBy("column_name").agg(F.count(F.lit(1)).alias("n"))
            .where(share > 90)
            .select(F.lit("profiling").alias("dimension"), "column_name",
                    F.lit("high_cardinality").alias("issue_type"),
                    F.concat(share.cast("string"), F.lit(" % distinct values"))
                    .alias("description"),
                    F.lit(0).cast("bigint").alias("affected_rows"), F.lit(0.0).alias("affected_pct"),
                    F.lit("LOW").alias("severity"), F.lit("LOW").alias("risk_level"),
                    F.lit("review_column_design").alias("fix_action"),
                    F.lit(False).alias("auto_fixable"),
                    F.array().cast("array<string>").alias("sample_values"),
                    F.lit(first).alias("issue_no")))
