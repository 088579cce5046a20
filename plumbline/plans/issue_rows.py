"""The rows behind the issues of a check: every row key of every issue, without a cap.

All failing predicate rules, those of declared limits included, are listed by one scan that puts out a
row per broken rule and row. Repeated rows, ids and entities and near duplicates are listed from their
own small tables of repeated keys, joined so that no task gets a hot key's rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F

from ..operators import duplicates, entities, privacy
from ..operators.ordering import attach
from ..operators.rule import Rule, violations
from ..operators.similar import SimilarValues
from ..session import cut_lineage
from .analysis import Analysis

KEYS = ["dimension", "column_name", "issue_type"]
PERSONAL = "pii_security"       # values of this dimension are never shown


def issue_rows(check: Analysis) -> DataFrame:
    """(row key, dimension, column_name, issue_type, value) of all issues that rows cause.

    Issues of a whole table or of its column layout (missing columns, too few rows) have no rows.
    """
    table = check.table
    if table is None or not table.row_key:
        raise ValueError("rows of issues need a check with a row key")
    found = {(r["dimension"], r["column_name"], r["issue_type"]) for r in check.issues.select(*KEYS).collect()}
    broken = [r for r in check.rules if (r.dimension, r.column, r.issue_type) in found and r.predicate is not None]
    broken += _personal(check)
    parts = [_shaped(violations(table, broken), table)] if broken else []
    for dimension, column, issue in sorted(found, key=str):
        rows = _grouped_rows(check, column, issue)
        if rows is not None:
            parts.append(rows.select(
                *[f"`{k}`" for k in table.row_key], F.lit(dimension).alias("dimension"),
                F.lit(column).alias("column_name"), F.lit(issue).alias("issue_type"), "value"))
    if not parts:
        empty = table.df.select(*[f"`{k}`" for k in table.row_key]).limit(0)
        return empty.select("*", *[F.lit(None).cast("string").alias(c) for c in [*KEYS, "value"]])
    return reduce(DataFrame.unionByName, parts)


def _personal(check: Analysis) -> list[Rule]:
    """The rules of the rows that hold the personal data found, from what the issues say of its type."""
    rules = []
    for r in check.issues.where(F.col("dimension") == PERSONAL).collect():
        c = r["column_name"]
        if r["issue_type"] == "pii_detected_by_name":
            rules.append(Rule(PERSONAL, c, r["issue_type"], f"{check.table.sql(c)} IS NOT NULL"))
        elif r["issue_type"] == "pii_detected_by_pattern":
            tests = privacy.pattern_tests(check.table, c)
            kind = next(k for k in tests if f" {k}:" in r["description"])
            rules.append(Rule(PERSONAL, c, r["issue_type"], tests[kind]))
    return rules


def _shaped(rows: DataFrame, table) -> DataFrame:
    value = F.when(F.col("dimension") != PERSONAL, F.col("value"))
    return rows.select(*[f"`{k}`" for k in table.row_key], *KEYS, value.alias("value"))


def _grouped_rows(check: Analysis, column: str, issue: str) -> DataFrame | None:
    """(row key, value) of issues that several rows cause together."""
    table = check.table
    if issue == "exact_duplicates":
        return duplicates.copy_rows(table).withColumn("value", F.lit(None).cast("string"))
    if issue in ("duplicate_ids", "missing_golden_record"):
        return duplicates.repeated_id_rows(table, column).withColumn("value", F.col("value").cast("string"))
    if issue == "near_duplicates" and not check.config.get("near_duplicates_window"):
        near = SimilarValues(table, column, check.config.get("fuzzy_threshold", 90))
        return near.members().where("links > 0").select(
            *[f"`{k}`" for k in table.row_key], F.col("class_key").cast("string").alias("value"))
    if issue == "survivorship_conflict":
        torn = cut_lineage(entities.conflicts(table, column).withColumnRenamed("entity", column))
        keys = table.df.select(*[f"`{k}`" for k in table.row_key], f"`{column}`")
        joined = attach(keys, column, torn, ["conflict_field"], "rows")
        return joined.where("conflict_field IS NOT NULL").select(
            *[f"`{k}`" for k in table.row_key], F.col("conflict_field").alias("value"))
    return None


def first_keys(rows: DataFrame, row_key: list[str], size: int = 100) -> DataFrame:
    """(dimension, column_name, issue_type, row_keys): the first ``size`` row keys of every issue.

    The rank filter is applied per task before the shuffle.
    """
    key = F.col(f"`{row_key[0]}`")
    place = F.row_number().over(Window.partitionBy(*KEYS).orderBy(key))
    return (rows.withColumn("place", place).where(F.col("place") <= size).groupBy(*KEYS)
            .agg(F.array_sort(F.collect_list(F.struct("place", key.alias("key")))).alias("s"))
            .select(*KEYS, F.transform("s", lambda s: s["key"]).alias("row_keys")))
