"""Declared rules: field limits and condition/check pairs, compiled to predicates.

Rules are written as Spark SQL over a typed view of the table, in which declared dates are dates
and declared numbers are numbers, whatever text they were read from. ``as_of`` is a column of that
view. A rule is broken where its condition holds and its check is false; an unknown check passes.
"""

from __future__ import annotations

import datetime as dt
import re
from dataclasses import dataclass, replace

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, functions as F

from ..functions import dates, text
from .duplicates import value_counts
from .rule import Rule, graded, measure
from .table import Table


@dataclass(frozen=True)
class FieldSpec:
    type: str = "string"
    required: bool = False
    unique: bool = False
    pattern: str | None = None
    one_of: tuple = ()
    low: float | None = None
    high: float | None = None
    not_future: bool = False
    case: str | None = None
    derived_from: str | None = None   # an age in years, from this date of birth
    pii: bool = False


@dataclass(frozen=True)
class CheckSpec:
    name: str
    check: str
    severity: str
    fix: str
    condition: str = "true"


def typed_view(table: Table, fields: dict[str, FieldSpec], as_of: dt.date) -> Table:
    out = []
    for c in table.df.columns:
        kind = fields[c].type if c in fields else None
        source = F.col(f"`{c}`")
        if kind == "date":
            out.append(dates.parse_date(source, table.kinds[c]).alias(c))
        elif kind in ("integer", "float"):
            out.append(text.number(source, table.kinds[c]).alias(c))
        else:
            out.append(source)
    return Table(table.df.select(*out, F.lit(as_of).alias("as_of")), table.row_key)


def _wrong_case(value: Column, case: str) -> Column:
    if case == "title":
        return text.not_title_case(value)
    return value != (F.upper(value) if case == "upper" else F.lower(value))


def field_rules(raw: Table, typed: Table, fields: dict[str, FieldSpec]) -> list[Rule]:
    """Predicates of every limit but uniqueness, which needs a grouping (``unique_issues``)."""
    rules = []

    def add(column: str, kind: str, predicate: Column, value: Column, severity: str) -> None:
        rules.append(Rule("business_rules", column, f"field_{kind}", predicate, severity=severity,
                          text=f"declared {kind} broken", value=value))

    for c, spec in fields.items():
        if not raw.has(c):
            continue
        value = typed.col(c)
        if spec.required:
            add(c, "required", value.isNull(), value, "HIGH")
        if spec.pattern:
            add(c, "pattern", ~typed.text(c).rlike(spec.pattern), value, "MEDIUM")
        if spec.one_of:
            add(c, "enum", ~typed.text(c).isin(list(spec.one_of)), value, "MEDIUM")
        if spec.low is not None:
            add(c, "min", value < spec.low, value, "HIGH")
        if spec.high is not None:
            add(c, "max", value > spec.high, value, "HIGH")
        if spec.not_future:
            add(c, "not_future", value > F.col("as_of"), value, "HIGH")
        if spec.case:
            add(c, "case", _wrong_case(typed.text(c), spec.case), value, "LOW")
        if spec.derived_from and raw.has(spec.derived_from):
            years = F.floor(F.months_between(F.col("as_of"), typed.col(spec.derived_from)) / 12)
            add(c, "derived", F.abs(value - years) > 1, value, "MEDIUM")
    return rules


def unique_issues(table: Table, fields: dict[str, FieldSpec], total: int,
                  first: int = 0) -> DataFrame | None:
    columns = [c for c, s in fields.items() if s.unique and table.has(c)]
    if not columns:
        return None
    facts = (value_counts(table, columns).where(F.col("rows") > 1).groupBy("column_name")
             .agg(F.sum("rows").alias("affected_rows")).withColumn("base", F.lit(total)))
    return graded(facts, "business_rules", "field_unique", severity="HIGH", risk="HIGH",
                  fix="deduplicate_ids", text="declared unique broken", first=first)


def mentioned(spec: CheckSpec) -> set[str]:
    """The words of a check outside its quoted texts, in lower case."""
    bare = re.sub(r"'[^']*'", "", f"{spec.condition} {spec.check}")
    return {(quoted or word).lower() for quoted, word in re.findall(r"`([^`]+)`|([^\W\d]\w*)", bare)}


def check_rules(typed: Table, checks: list[CheckSpec], known: set[str] = frozenset(),
                errors: dict[str, str] | None = None) -> list[Rule]:
    """Rules for the checks; a check on a ``known`` column that this table lacks does not apply.

    With ``errors``, a check that does not resolve against the table is noted there under its name
    and left out, so that the others still count.
    """
    names, columns = {k.lower() for k in known}, {c.lower() for c in typed.df.columns}
    rules = []
    for spec in checks:
        if (mentioned(spec) & names) - columns:
            continue
        try:
            broken = F.expr(f"({spec.condition}) AND NOT ({spec.check})")
            if errors is not None:
                typed.df.where(broken).schema
        except PySparkException as error:
            if errors is None:
                raise
            errors[spec.name] = str(error).split("\n")[0]
            continue
        rules.append(Rule("business_rules", spec.name, "declared_rule_violation", broken,
                          severity=spec.severity, fix=spec.fix, text=f"[{spec.name}]"))
    return rules


def measured_checks(typed: Table, rules: list[Rule]) -> DataFrame:
    """Issues of declared checks; an operation that fails in a row (a division by zero, a cast)
    is null there, so the check says nothing about that row and the others still count.

    Spark fixes how an expression fails when it resolves it, so the flags are resolved without
    ANSI mode and counted as plain columns.
    """
    spark = typed.df.sparkSession
    before = spark.conf.get("spark.sql.ansi.enabled")
    spark.conf.set("spark.sql.ansi.enabled", "false")
    try:
        flags = typed.df.select(*[r.test.alias(f"__check{i}") for i, r in enumerate(rules)])
        flags.schema
    finally:
        spark.conf.set("spark.sql.ansi.enabled", before)
    return measure(Table(flags), [replace(r, predicate=F.col(f"__check{i}"))
                                  for i, r in enumerate(rules)])


def declared_issues(table: Table, fields: dict[str, FieldSpec], checks: list[CheckSpec],
                    as_of: dt.date, errors: dict[str, str] | None = None) -> DataFrame:
    """Issues of a whole rule catalogue entry: one scan for the limits and one for the checks, plus
    one grouping for unique columns. ``errors`` collects checks that do not resolve."""
    typed = typed_view(table, fields, as_of)
    rules = field_rules(table, typed, fields)
    found = measure(typed, rules)
    tests = check_rules(typed, checks, set(fields), errors)
    if tests:
        counted = measured_checks(typed, tests)
        found = found.unionByName(counted.withColumn(
            "issue_no", (F.col("issue_no") + len(rules)).cast("int")))
        rules = rules + tests
    unique = unique_issues(table, fields, table.df.count(), len(rules))
    return found if unique is None else found.unionByName(unique)


def custom_checks(rules: DataFrame, domain: str) -> list[CheckSpec]:
    """Active rules of a domain from the custom rule table (a small configuration table)."""
    rows = (rules.where((F.col("domain") == domain) & (F.col("is_active") == 1))
            .orderBy("rule_id").collect())
    return [CheckSpec(r["rule_name"], r["rule_expression"], r["severity"],
                      r["fix_action"] or "flag_for_review") for r in rows]
