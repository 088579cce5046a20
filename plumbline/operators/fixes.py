"""Repairs. A repair is a chain of projections plus a count of the rows each step changes.

``Rewrite`` keeps, for every step, a flag of the rows it changed; the change log is one aggregate
over these flags. Repairs that need facts about the whole table (medians, fences) fetch a few
numbers first and use them as literals.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import dates, fixed_values as fv, text
from . import checks, entities, outliers
from .baseline import Baselines, profile_state
from .duplicates import id_columns, repeated_rows, top_counts, without_copies
from .privacy import protect
from .quantiles import exact_quantiles
from .table import Table

LOG_SCHEMA = ("dimension string, action string, issue_type string, column_name string, rows_affected bigint, "
              "detail string")
LOG_COLUMNS = ["dimension", "action", "issue_type", "column_name", "rows_affected", "detail"]


@dataclass
class Context:
    as_of: dt.date
    row_key: str | None = None
    options: dict = field(default_factory=dict)

    def option(self, name: str, default=None):
        return self.options.get(name, default)


@dataclass
class Fixed:
    df: DataFrame
    log: DataFrame
    token_maps: dict = field(default_factory=dict)
    answered: DataFrame | None = None       # the log of one repair with the issue type that each change answers


class Rewrite:
    def __init__(self, df: DataFrame, dimension: str, context: Context):
        self.source, self.out, self.dimension = df, df, dimension
        self.row_key = context.row_key
        self.steps: list[tuple[str, str, str, str, str]] = []

    @property
    def table(self) -> Table:
        return Table(self.out.drop(*[s[0] for s in self.steps]), self.row_key)

    def change(self, column: str, new: Column, where: Column, action: str, issue: str, detail: str,
               kind: str | None = None) -> None:
        """Replace ``column`` by ``new`` in the rows where ``where`` holds, for an issue of type ``issue``."""
        flag = f"__changed{len(self.steps)}"
        old = F.col(f"`{column}`")
        if kind:
            old = old.cast(kind)
        self.out = (self.out.withColumn(flag, F.coalesce(where, F.lit(False)))
                    .withColumn(column, F.when(F.col(flag), new).otherwise(old)))
        self.steps.append((flag, action, issue, column, detail))

    def add(self, column: str, value: Column, action: str, issue: str, detail: str) -> None:
        """Append a column; counts every row."""
        flag = f"__changed{len(self.steps)}"
        self.out = self.out.withColumn(column, value).withColumn(flag, F.lit(True))
        self.steps.append((flag, action, issue, column, detail))

    def done(self) -> Fixed:
        spark = self.source.sparkSession
        if not self.steps:
            return Fixed(self.source, spark.createDataFrame([], LOG_SCHEMA))
        flags = [s[0] for s in self.steps]
        counts = self.out.agg(*[F.count_if(F.col(f)).alias(f) for f in flags])
        log = counts.select(F.inline(F.array(*[
            F.struct(F.lit(self.dimension).alias("dimension"), F.lit(a).alias("action"),
                     F.lit(t).alias("issue_type"), F.lit(c).alias("column_name"),
                     F.col(f).alias("rows_affected"), F.lit(d).alias("detail"))
            for f, a, t, c, d in self.steps])))
        return Fixed(self.out.drop(*flags), log.where("rows_affected > 0"))


def _note(df: DataFrame, dimension: str, action: str, issue: str | None, detail: str) -> Fixed:
    log = df.sparkSession.createDataFrame([(dimension, action, issue, "ALL", 0, detail)], LOG_SCHEMA)
    return Fixed(df, log)


# --- completeness ---------------------------------------------------------------------------------

def impute(df: DataFrame, context: Context) -> Fixed:
    """Numbers: median, mean or zero. Text: the most frequent value, the smallest on ties."""
    rewrite = Rewrite(df, "completeness", context)
    table = rewrite.table
    strategy = context.option("strategy", "auto")
    columns = [c for c in table.columns if table.is_simple(c)]
    if not columns:
        return rewrite.done()
    row = df.agg(*[F.count_if(table.col(c).isNull()).alias(f"n{i}")
                   for i, c in enumerate(columns)]).first()
    holes = [c for i, c in enumerate(columns) if row[f"n{i}"]]
    numeric = [c for c in holes if table.is_number(c)]
    texts = [c for c in holes if table.is_text(c)]
    facts = exact_quantiles(df, {c: table.col(c).cast("double") for c in numeric}, [0.5]) \
        if numeric and strategy != "zero" else {}
    modes = {}
    if texts:
        modes = {r["column_name"]: r["value"] for r in top_counts(table, texts, 1).collect()}
    for c in numeric:
        if strategy == "zero":
            value, label = 0.0, "zero"
        elif strategy == "mean":
            value, label = facts[c]["mean"], "mean"
        else:
            value, label = (facts[c]["quantiles"] or [None])[0], "median"
        if value is not None:
            rewrite.change(c, F.lit(value), table.col(c).isNull(), f"impute_{label}", "missing_values",
                           f"filled with {label} {round(value, 4)}", kind="double")
    for c in texts:
        value = modes.get(c)
        rewrite.change(c, F.lit("UNKNOWN" if value is None else value), table.col(c).isNull(),
                       "impute_unknown" if value is None else "impute_mode", "missing_values",
                       f"filled with {'UNKNOWN' if value is None else value}")
    return rewrite.done()


# --- uniqueness -----------------------------------------------------------------------------------

def drop_copies(df: DataFrame, context: Context) -> Fixed:
    """Exact copies of a row; a row key takes no part in the comparison and the first row stays."""
    key = context.row_key
    columns = [c for c in df.columns if c != key]
    n = repeated_rows(df, columns)
    log = (n.where("duplicate_rows > 0").select(
        F.lit("uniqueness").alias("dimension"), F.lit("exact_dedup").alias("action"),
        F.lit("exact_duplicates").alias("issue_type"),
        F.lit("ALL").alias("column_name"), F.col("duplicate_rows").alias("rows_affected"),
        F.lit("copies removed").alias("detail")))
    if key is None:     # without identity, the rows themselves must meet
        return Fixed(df.dropDuplicates(), log)
    return Fixed(without_copies(Table(df, key)), log)


def keep_last(df: DataFrame, column: str, row_key: str, parity: bool = False) -> DataFrame:
    """The last row of every id in row-key order. Null ids all stay unless ``parity``.

    The rank filter keeps one row per id and task before the shuffle, so a hot id is harmless.
    """
    group = [F.col(column)]
    if not parity:
        group.append(F.when(F.col(column).isNull(), F.col(row_key)))
    rank = F.row_number().over(Window.partitionBy(*group).orderBy(F.desc(row_key)))
    return df.withColumn("__rank", rank).where(F.col("__rank") == 1).drop("__rank")


def dedup(df: DataFrame, context: Context) -> Fixed:
    """Exact copies, then one row per id column in turn.

    ``keys`` names the id columns. ``parity`` takes every ``id`` / ``*_id`` column, foreign keys
    included, and collapses null ids to one row.
    """
    parity = context.option("parity", False)
    fixed = drop_copies(df, context)
    keys = context.option("keys")
    if keys is None:
        keys = id_columns(Table(df, context.row_key)) if parity else []
    if keys and context.row_key is None:
        raise ValueError("keeping the last row of an id needs a row key")
    out, log = fixed.df, fixed.log
    for c in keys:
        distinct = F.count_distinct(F.col(c))
        lost = F.count(F.lit(1)) - distinct - (
            F.max(F.col(c).isNull().cast("int")) if parity else F.count_if(F.col(c).isNull()))
        log = log.unionByName(out.agg(lost.cast("bigint").alias("rows_affected")).select(
            F.lit("uniqueness").alias("dimension"), F.lit("id_dedup").alias("action"),
            F.lit("duplicate_ids").alias("issue_type"),
            F.lit(c).alias("column_name"), "rows_affected",
            F.lit("kept the last row").alias("detail")).where("rows_affected > 0"))
        out = keep_last(out, c, context.row_key, parity)
    return Fixed(out, log)


# --- standardization and consistency ----------------------------------------------------------------

def standardize(df: DataFrame, context: Context) -> Fixed:
    rewrite = Rewrite(df, "standardization", context)
    names = rewrite.table
    for c in names.texts:
        if text.contains_any(c, context.option("title_words", fv.TITLE_FIX_WORDS)):
            v = F.col(f"`{c}`")
            rewrite.change(c, text.title_case(v), text.not_title_case(v), "title_case", "case_inconsistency", "title case")
    for c in names.texts:
        if c.lower() in fv.UPPER_COLUMNS:
            v = F.col(f"`{c}`")
            rewrite.change(c, F.upper(v), v != F.upper(v), "upper_case", "case_inconsistency", "upper case")
    for c in names.texts:
        if text.contains_any(c, fv.DATE_FIX_WORDS):
            v = F.col(f"`{c}`")
            iso = dates.iso_text(dates.parse_date(v, long_form=True))
            rewrite.change(c, iso, text.strip(v) != iso, "standardize_date", "mixed_date_formats", "ISO date")
    for c in names.texts:
        v = F.col(f"`{c}`")
        rewrite.change(c, text.strip(v), v != text.strip(v), "strip_whitespace", "whitespace_issue", "outer blanks")
    for c in names.texts:
        if text.contains_any(c, fv.MONEY_FIX_WORDS):
            v = F.col(f"`{c}`")
            bare = F.regexp_replace(v, "[$,]", "")
            readable = bare.rlike(fv.NUMBER_TEXT)
            if context.option("as_double", False):
                rewrite.change(c, text.money(v), v.startswith("$"), "strip_currency_symbol", "type_mismatch",
                               "$ removed, cast to a number", kind=None)
                rewrite.out = rewrite.out.withColumn(c, text.number(F.col(f"`{c}`"),
                                                                    names.kinds[c]))
            else:
                rewrite.change(c, F.when(readable, bare), v.startswith("$"),
                               "strip_currency_symbol", "type_mismatch", "$ removed")
    return rewrite.done()


def _recalculate(rewrite: Rewrite, issue: str) -> None:
    actions = {"total_amount": "recalculate_total", "cost": "recalculate_cost"}
    for result, a, b, how in fv.DERIVED_COLUMNS:
        table = rewrite.table
        if not table.has(result, a, b):
            continue
        kinds = table.kinds
        left, right, value = (text.number(F.col(f"`{c}`"), kinds[c]) for c in (a, b, result))
        expected = left * right if how == "product" else left + right
        allowed = F.abs(expected) * fv.DERIVED_SHARE + fv.DERIVED_SLACK
        new = F.round(expected, 2)
        rewrite.change(result, new.cast("string") if table.is_text(result) else new,
                       F.abs(value - expected) > allowed, actions[result], issue, f"{how} of {a}, {b}",
                       kind=None if table.is_text(result) else "double")


def make_consistent(df: DataFrame, context: Context) -> Fixed:
    rewrite = Rewrite(df, "consistency", context)
    table = rewrite.table
    for c, canonical in fv.ENUM_CANONICAL.items():
        if table.has(c) and table.is_text(c):
            v = F.col(f"`{c}`")
            lookup = F.create_map(*[F.lit(x) for pair in canonical.items() for x in pair])
            mapped = F.try_element_at(lookup, F.lower(text.strip(v)))
            rewrite.change(c, mapped, mapped.isNotNull() & (v != mapped), "standardize_enum", "enum_inconsistency",
                           "canonical value")
    _recalculate(rewrite, "calculation_inconsistency")
    return rewrite.done()


# --- validity, accuracy, constraints, reasonableness --------------------------------------------------

def nullify_out_of_range(df: DataFrame, context: Context) -> Fixed:
    rewrite = Rewrite(df, "validity", context)
    table = rewrite.table
    for c, (low, high) in fv.NULLIFY_RANGES.items():
        if table.has(c):
            high = context.as_of.year if high is None else high
            v = text.number(F.col(c), table.kinds[c])
            rewrite.change(c, F.lit(None), (v < low) | (v > high), "nullify_out_of_range", "range_violation",
                           f"outside [{low}, {high}]")
    return rewrite.done()


def _clip(rewrite: Rewrite, columns: list[str], factor: float, action: str, issue: str) -> None:
    table = rewrite.table
    views = {c: table.col(c).cast("double") for c in columns}
    for c, f in outliers.fences(table, views, factor).items():
        v = views[c]
        new = F.least(F.greatest(v, F.lit(f["lower"])), F.lit(f["upper"]))
        row = f"[{round(f['lower'], 4)}, {round(f['upper'], 4)}]"
        rewrite.change(c, new, outliers.outside(v, f), action, issue, f"capped to {row}", kind="double")


def winsorize(df: DataFrame, context: Context) -> Fixed:
    rewrite = Rewrite(df, "accuracy", context)
    _clip(rewrite, rewrite.table.numbers, context.option("iqr_factor", 1.5), "winsorize_outliers",
          "statistical_outlier")
    return rewrite.done()


def cap_extremes(df: DataFrame, context: Context) -> Fixed:
    rewrite = Rewrite(df, "reasonableness", context)
    columns = outliers.extreme_columns(rewrite.table, fv.EXTREME_FIX_SKIP_WORDS)
    _clip(rewrite, columns, 3.0, "cap_outliers_iqr", "statistical_outliers")
    return rewrite.done()


def clip_age(df: DataFrame, context: Context) -> Fixed:
    rewrite = Rewrite(df, "constraints", context)
    table = rewrite.table
    if table.has("age"):
        v = text.number(F.col("age"), table.kinds["age"])
        new = F.least(F.greatest(v, F.lit(0.0)), F.lit(130.0)).cast("int").cast(table.kinds["age"])
        rewrite.change("age", new, (v < 0) | (v > 130), "clip_age_constraint", "constraint_violation_age", "clipped to 0 to 130")
    return rewrite.done()


# --- business rules, reconciliation -----------------------------------------------------------------

def repair_amounts(df: DataFrame, context: Context) -> Fixed:
    rewrite = Rewrite(df, "business_rules", context)
    table = rewrite.table
    for c in table.columns:
        if text.contains_any(c, fv.AMOUNT_FIX_WORDS) and (table.is_number(c) or table.is_text(c)):
            v = F.col(f"`{c}`")
            new = F.regexp_replace(text.strip(v), "^-", "") if table.is_text(c) else F.abs(v)
            rewrite.change(c, new, text.number(v, table.kinds[c]) < 0, "abs_negative_amounts", "business_rule_violation",
                           "absolute value")
    if table.has("quantity"):
        v = text.number(F.col("quantity"), table.kinds["quantity"])
        rewrite.change("quantity", F.lit(None), v <= 0, "nullify_invalid_quantity", "business_rule_violation", "not positive")
    if table.has("fraud_flag"):
        v = text.number(F.col("fraud_flag"), table.kinds["fraud_flag"])
        rewrite.change("fraud_flag", F.lit(0).cast(table.kinds["fraud_flag"]),
                       v.isNull() | ~v.isin(0.0, 1.0), "fix_fraud_flag", "business_rule_violation", "set to 0")
    return rewrite.done()


def pad_amounts(df: DataFrame, context: Context) -> Fixed:
    rewrite = Rewrite(df, "reconciliation", context)
    table = rewrite.table
    columns = [c for c in table.columns if text.contains_any(c, fv.RECONCILED_WORDS)
               and (table.is_number(c) or table.is_text(c))]
    if not columns:
        return rewrite.done()
    views = {c: text.number(F.col(f"`{c}`"), table.kinds[c]) for c in columns}
    row = df.agg(F.count(F.lit(1)).alias("total"), *[
        F.count_if(v.isNull()).alias(f"n{i}") for i, v in enumerate(views.values())]).first()
    for i, c in enumerate(columns):
        if 0 < row[f"n{i}"] < row["total"] * 0.5:
            zero = F.lit("0.0") if table.is_text(c) else F.lit(0).cast(table.kinds[c])
            rewrite.change(c, zero, views[c].isNull(), "reconcile_missing_amount", "amount_reconciliation_gap", "padded with 0")
    return rewrite.done()


# --- accessibility, conformity, reliability -----------------------------------------------------------

def strip_non_ascii(df: DataFrame, context: Context) -> Fixed:
    rewrite = Rewrite(df, "accessibility", context)
    for c in rewrite.table.texts:
        v = F.col(f"`{c}`")
        rewrite.change(c, F.regexp_replace(v, text.NON_ASCII, ""), v.rlike(text.NON_ASCII),
                       "strip_non_ascii", "unreadable_chars", "characters outside ASCII removed")
    return rewrite.done()


def nullify_malformed(df: DataFrame, context: Context) -> Fixed:
    rewrite = Rewrite(df, "conformity", context)
    table = rewrite.table
    for c in table.columns:
        v = table.text(c)
        if "email" in c.lower():
            rewrite.change(c, F.lit(None), ~v.rlike(fv.SIMPLE_EMAIL), "nullify_invalid_emails", "email_format_violation",
                           "not an e-mail address")
        elif "zip" in c.lower():
            rewrite.change(c, F.lit(None), ~v.rlike(fv.SIMPLE_ZIP), "clean_zipcodes", "zipcode_format_violation",
                           "not a 5 or 9 digit code")
    return rewrite.done()


def nullify_placeholders(df: DataFrame, context: Context) -> Fixed:
    rewrite = Rewrite(df, "reliability", context)
    table = rewrite.table
    for c in table.columns:
        where = checks.placeholder(table, c)
        if where is not None:
            rewrite.change(c, F.lit(None), F.expr(where), "nullify_dummy_values", "unreliable_default_values",
                           "placeholder removed")
    return rewrite.done()


# --- time, audit, lineage -------------------------------------------------------------------------

def nullify_ancient(df: DataFrame, context: Context) -> Fixed:
    rewrite = Rewrite(df, "timeliness", context)
    table = rewrite.table
    first_year = context.as_of.year - 15
    for c in table.columns:
        if text.contains_any(c, ["date", "timestamp"]) and (table.is_text(c) or table.is_time(c)):
            parsed = dates.parse_date(F.col(f"`{c}`"), table.kinds[c])
            rewrite.change(c, F.lit(None), F.year(parsed) < first_year, "archive_stale_data", "ancient_dates",
                           f"before {first_year}")
    return rewrite.done()


def add_audit_columns(df: DataFrame, context: Context) -> Fixed:
    rewrite = Rewrite(df, "auditability", context)
    table = rewrite.table
    stamp = F.lit(f"{context.as_of.isoformat()} 00:00:00")
    for c in ("last_updated", "created_at"):
        if not table.has(c):
            rewrite.add(c, stamp, "inject_audit_column", "missing_audit_timestamp", "audit column added")
        elif table.is_number(c):        # seconds since 1970
            rewrite.change(c, stamp.cast("timestamp").cast("long").cast(table.kinds[c]),
                           table.col(c).isNull(), "populate_audit_timestamps", "missing_audit_timestamp_value", "missing stamps filled")
        else:
            rewrite.change(c, stamp.cast(table.kinds[c]), table.col(c).isNull(),
                           "populate_audit_timestamps", "missing_audit_timestamp_value", "missing stamps filled")
    return rewrite.done()


def add_lineage(df: DataFrame, context: Context) -> Fixed:
    rewrite = Rewrite(df, "lineage", context)
    present = set(df.columns)
    for c, value in fv.LINEAGE_DEFAULTS.items():
        if c not in present:
            rewrite.add(c, F.lit(value), "add_lineage_metadata", "missing_traceability_metadata", "default lineage column")
    return rewrite.done()


# --- survivorship and flags -------------------------------------------------------------------------

def build_golden(df: DataFrame, context: Context) -> Fixed:
    """Golden records per entity key, one key after the other."""
    if context.row_key is None:
        raise ValueError("golden records need a row key")
    keep_null = not context.option("parity", False)
    out, log = df, df.sparkSession.createDataFrame([], LOG_SCHEMA)
    for key in context.option("keys") or entities.golden_keys(df):
        merged = F.count(F.col(key)) - F.count_distinct(F.col(key))
        if not keep_null:
            merged = merged + F.count_if(F.col(key).isNull())
        log = log.unionByName(out.agg(merged.alias("rows_affected")).select(
            F.lit("survivorship").alias("dimension"),
            F.lit("golden_record_generation").alias("action"),
            F.lit("survivorship_conflict").alias("issue_type"), F.lit(key).alias("column_name"),
            "rows_affected", F.lit("merged into golden records").alias("detail"))
            .where("rows_affected > 0"))
        out = entities.golden_records(out, key, context.row_key, keep_null)
    return Fixed(out, log)


def protect_personal(df: DataFrame, context: Context) -> Fixed:
    out, log, maps = protect(df, context.option("fields", {}), context.row_key,
                             context.option("default_mode"), context.option("parity", False))
    # How the column was found, by name or by pattern, is known to the check, not to the repair.
    log = log.select(F.lit("pii_security").alias("dimension"), "action", F.lit(None).cast("string").alias("issue_type"),
                     "column_name", "rows_affected", F.col("masking_mode").alias("detail"))
    return Fixed(out, log, maps)


def _flag(dimension: str, action: str, issue: str, detail: str, rules) -> Callable:
    """A repair that changes no value; option ``flag_column`` adds a mark of the rows concerned."""
    def fix(df: DataFrame, context: Context) -> Fixed:
        name = context.option("flag_column")
        if not name:
            return _note(df, dimension, action, issue, detail)
        table = Table(df, context.row_key)
        mark = F.lit(False)
        for rule in rules(table, context):
            mark = mark | F.coalesce(rule.test, F.lit(False))
        frame = table.frame().withColumn(name, mark)
        return Fixed(frame.select(*df.columns, name), _note(df, dimension, action, issue, detail).log)
    return fix


def lock_baseline(df: DataFrame, context: Context) -> Fixed:
    """Keep the table's profile state; the table stays as it is.

    Option ``baseline`` is (folder, name) or (folder, name, batch); the batch is the day by default.
    Without it there is only the log row.
    """
    kept = context.option("baseline")
    if kept:
        root, name, batch = (*kept, context.as_of.isoformat())[:3]
        Baselines(df.sparkSession, root).save(name, batch, profile_state(Table(df, context.row_key)))
    return _note(df, "profiling", "lock_profiling_baseline", None, "profile kept as the baseline")


FIXES: dict[str, Callable[[DataFrame, Context], Fixed]] = {
    "completeness": impute,
    "uniqueness": dedup,
    "standardization": standardize,
    "validity": nullify_out_of_range,
    "consistency": make_consistent,
    "accuracy": winsorize,
    "pii_security": protect_personal,
    "business_rules": repair_amounts,
    "accessibility": strip_non_ascii,
    "conformity": nullify_malformed,
    "constraints": clip_age,
    "enrichment": _flag("enrichment", "flag_for_enrichment", "suboptimal_enrichment", "left for external enrichment",
                        lambda t, x: checks.enrichment(t)),
    "freshness": _flag("freshness", "flag_for_archive", "stale_data", "left for archiving",
                       lambda t, x: checks.freshness(t, x.as_of)),
    "integrity": _flag("integrity", "flag_for_review", "integrity_violation", "left for review",
                       lambda t, x: checks.integrity(t)),
    "lineage": add_lineage,
    "reasonableness": cap_extremes,
    "reliability": nullify_placeholders,
    "survivorship": build_golden,
    "auditability": add_audit_columns,
    "reconciliation": pad_amounts,
    "timeliness": nullify_ancient,
    "profiling": lock_baseline,
}
ALIASES = {"completeness_missing": "completeness", "deduplication": "uniqueness"}


def apply_fix(df: DataFrame, dimension: str, context: Context) -> Fixed:
    """The repair of one dimension; a dimension without a repair leaves the table as it is."""
    fix = FIXES.get(ALIASES.get(dimension, dimension))
    if fix is None:
        return Fixed(df, df.sparkSession.createDataFrame([], LOG_SCHEMA))
    done = fix(df, context)
    return Fixed(done.df, done.log.drop("issue_type"), done.token_maps, done.log)
