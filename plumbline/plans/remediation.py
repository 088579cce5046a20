"""Fix, check again, compare."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from ..operators.fixes import Context, Fixed, apply_fix
from ..session import shared_folder
from . import reports
from .analysis import Analysis, analyze

# Repairs that drop or merge rows.
ROW_ACTIONS = {"exact_dedup", "id_dedup", "golden_record_generation"}
LOW_RISK = ["standardization", "consistency"]


def apply_all(df: DataFrame, dimensions: list[str], context: Context) -> Fixed:
    """The repairs of several dimensions, one on top of the other, as one plan.

    ``context.options`` may hold options per dimension under the dimension's name.
    """
    out, logs, maps = df, None, {}
    for dimension in dimensions:
        options = context.options.get(dimension, {})
        fixed = apply_fix(out, dimension, Context(context.as_of, context.row_key, options))
        out = fixed.df
        log = fixed.log if fixed.answered is None else fixed.answered
        logs = log if logs is None else logs.unionByName(log)
        maps.update(fixed.token_maps)
    return Fixed(out, logs, maps)


def apply_low_risk(df: DataFrame, context: Context) -> Fixed:
    return apply_all(df, LOW_RISK, context)


@dataclass
class Remediation:
    before: Analysis
    after: Analysis
    fixed: Fixed

    @property
    def comparison(self) -> DataFrame:
        return reports.compare(self.before.scores, self.after.scores)

    @property
    def successes(self) -> DataFrame:
        """(dimension, column_name, success): did the number of affected rows fall?"""
        keys = ["dimension", "column_name"]
        was = self.before.issues.groupBy(*keys).agg(F.sum("affected_rows").alias("was"))
        now = self.after.issues.groupBy(*keys).agg(F.sum("affected_rows").alias("now"))
        fell = F.coalesce("now", F.lit(0)) < F.col("was")
        return was.join(now, keys, "left").select(*keys, fell.cast("int").alias("success"))


def changed_columns(before: DataFrame, fixed: Fixed) -> set[str] | None:
    """The columns whose values or types a repair changed; None if it changed rows or the columns."""
    if before.columns != fixed.df.columns:
        return None
    done = fixed.log.where("rows_affected > 0").select("action", "column_name").distinct().collect()
    if any(r["action"] in ROW_ACTIONS for r in done):
        return None
    kinds = {f.name: f.dataType for f in before.schema.fields}
    return ({r["column_name"] for r in done} & set(before.columns)) | {
        f.name for f in fixed.df.schema.fields if f.dataType != kinds[f.name]}


def remediate(df: DataFrame, dimensions: list[str], context: Context, domain: str = "unknown",
              config: dict | None = None, before: Analysis | None = None,
              check: list[str] | None = None) -> Remediation:
    """Check, repair the given dimensions, check the repaired table.

    The repaired table is written to the shared folder once, so that the passes of the second check
    read it instead of repeating the repairs. If the repair left the rows and columns as they are, the
    second check measures only the rules that read changed columns.
    """
    before = before or analyze(df, context.as_of, domain, context.row_key, config, check)
    fixed = apply_all(df, dimensions, context)
    path = shared_folder(df.sparkSession)
    fixed.df.write.parquet(path)
    fixed = Fixed(df.sparkSession.read.schema(fixed.df.schema).parquet(path), fixed.log, fixed.token_maps)
    changed = changed_columns(df, fixed)
    after = analyze(fixed.df, context.as_of, domain, context.row_key, config, check,
                    before=None if changed is None else before, changed=changed)
    return Remediation(before, after, fixed)
