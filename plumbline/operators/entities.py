"""Entities that occur in several rows: conflicts between them and their golden record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import fixed_values as fv, text
from .rule import graded
from .table import Table


def entity_keys(table: Table) -> list[str]:
    return [c for c in table.columns if text.contains_any(c, fv.ENTITY_KEY_WORDS)]


def compared_columns(table: Table, key: str, limit: int | None = None) -> list[str]:
    """All columns whose values should agree within an entity; ``limit`` takes the first few."""
    return [c for c in table.columns if c != key and table.is_simple(c)
            and text.contains_any(c, fv.CONFLICT_WORDS)][:limit]


def _entities(table: Table, key: str) -> DataFrame:
    """One row per repeated entity: its rows and the first column on which they disagree.

    Two values differ exactly when the smallest is not the largest, so no value set is gathered
    and a hot entity shrinks to one row per task before the shuffle.
    """
    compared = compared_columns(table, key)
    ends = [e for i, c in enumerate(compared)
            for e in (F.min(table.col(c)).alias(f"lo{i}"), F.max(table.col(c)).alias(f"hi{i}"))]
    grouped = (table.df.where(table.col(key).isNotNull()).groupBy(table.col(key).alias("entity"))
               .agg(F.count(F.lit(1)).alias("rows"), *ends).where(F.col("rows") > 1))
    first = F.lit(None).cast("string")
    low = high = F.lit(None).cast("string")
    for i in reversed(range(len(compared))):
        differs = F.col(f"lo{i}") != F.col(f"hi{i}")
        first = F.when(differs, F.lit(compared[i])).otherwise(first)
        low = F.when(differs, F.col(f"lo{i}").cast("string")).otherwise(low)
        high = F.when(differs, F.col(f"hi{i}").cast("string")).otherwise(high)
    return grouped.select("entity", "rows", first.alias("conflict_field"),
                          low.alias("smallest"), high.alias("largest"))


def conflicts(table: Table, key: str) -> DataFrame:
    """(entity, conflict_field, smallest, largest, rows) of entities whose rows disagree."""
    return _entities(table, key).where(F.col("conflict_field").isNotNull())


def survivorship_facts(table: Table, key: str) -> DataFrame:
    """One row: key_column, repeated_entities, repeated_rows, conflicting_entities, samples."""
    shown = F.concat(F.col("entity").cast("string"), F.lit(": "), F.col("conflict_field"),
                     F.lit(" has ["), F.col("smallest"), F.lit(", "), F.col("largest"), F.lit("]"))
    found = _entities(table, key)
    return found.agg(
        F.count(F.lit(1)).alias("repeated_entities"),
        F.coalesce(F.sum("rows"), F.lit(0)).alias("repeated_rows"),
        F.count("conflict_field").alias("conflicting_entities"),
        F.min(F.when(F.col("conflict_field").isNotNull(), shown)).alias("sample"),
    ).select(F.lit(key).alias("key_column"), "*")


def survivorship_issues(table: Table, total: int, first: int = 0) -> DataFrame | None:
    out = None
    for i, key in enumerate(entity_keys(table)):
        facts = survivorship_facts(table, key)
        both = facts.select(F.lit(key).alias("column_name"), F.inline(F.array(
            F.struct(F.lit("c").alias("kind"), F.col("conflicting_entities").alias("affected_rows"),
                     F.col("repeated_entities").alias("base"),
                     F.array_compact(F.array("sample")).alias("sample_values")),
            F.struct(F.lit("g").alias("kind"), F.col("repeated_rows").alias("affected_rows"),
                     F.lit(total).cast("bigint").alias("base"),
                     F.array().cast("array<string>").alias("sample_values")))))
        found = graded(both.where("kind = 'c'"), "survivorship", "survivorship_conflict",
                       severity="HIGH", risk="HIGH", fix="apply_survivorship_rules",
                       text="entities with conflicting values", first=first + 2 * i)
        golden = graded(both.where("kind = 'g' AND affected_rows > base * 0.01"), "survivorship",
                        "missing_golden_record", severity="MEDIUM", risk="HIGH",
                        fix="designate_golden_record", text="rows sharing an entity key",
                        first=first + 2 * i + 1)
        part = found.unionByName(golden)
        out = part if out is None else out.unionByName(part)
    return out


def golden_keys(df: DataFrame) -> list[str]:
    return [c for c in df.columns if "id" in c.lower() and text.contains_any(c, fv.ENTITY_WORDS)]


def golden_records(df: DataFrame, key: str, row_key: str, keep_null_keys: bool = True) -> DataFrame:
    """One row per key: per column the first non-null value in row-key order.

    The pick is an aggregate with partial results, so a hot key is merged inside each task.
    """
    rest = [c for c in df.columns if c not in (key, row_key)]

    def first_value(c: str) -> Column:
        return F.expr(f"min_by(`{c}`, `{row_key}`) FILTER (WHERE `{c}` IS NOT NULL)").alias(c)

    merged = (df.where(F.col(key).isNotNull()).groupBy(key)
              .agg(F.min(row_key).alias(row_key), *[first_value(c) for c in rest])
              .select(*df.columns))
    return merged.unionByName(df.where(F.col(key).isNull())) if keep_null_keys else merged
