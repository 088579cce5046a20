"""Rules are data: a predicate, how to grade its count, what to do about it.

``measure`` counts every rule in one aggregate over the table and returns the issue table.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import scoring
from .table import PREFIX, Table

ISSUE_SCHEMA = (
    "dimension string, column_name string, issue_type string, description string, "
    "affected_rows bigint, affected_pct double, severity string, risk_level string, "
    "fix_action string, auto_fixable boolean, sample_values array<string>, issue_no int")
ISSUE_COLUMNS = ["dimension", "column_name", "issue_type", "description", "affected_rows",
                 "affected_pct", "severity", "risk_level", "fix_action", "auto_fixable",
                 "sample_values", "issue_no"]

# One aggregate holds at most this many rule counts; more rules are split over several.
RULES_PER_SCAN = 250


@dataclass
class Rule:
    dimension: str
    column: str
    issue_type: str
    predicate: Column | str | None = None  # row predicate or its SQL; null is no violation
    severity: str = "rate"               # "rate", "extreme" or a fixed severity
    risk: str = "severity"               # "severity" or a fixed risk
    fix: str = "flag_for_review"
    auto: bool | str = False             # "low": only when the severity is LOW
    text: str = ""
    value: Column | None = None          # shown in violations and samples
    affected: str | None = None          # SQL aggregate that replaces the predicate's count
    base: Column | None = None           # non-null rows of this are the denominator; else all rows
    over: float = 0.0                    # the share must exceed this
    always: bool = False                 # report even when the count is zero
    when: str | None = None              # SQL aggregate condition for reporting
    note: str | None = None              # SQL aggregate text appended to the description

    @property
    def test(self) -> Column:
        return F.expr(self.predicate) if isinstance(self.predicate, str) else self.predicate


WORDS = re.compile(r"`([^`]+)`|([^\W\d]\w*)")


def columns_read(rule: Rule, table: Table) -> set[str]:
    """The table's columns that a rule reads, also through the columns derived from them.

    Names are taken from the text of its expressions, so a name that stands there for something else
    counts too: the set may be too large, never too small.
    """
    said = " ".join(str(x) for x in (rule.predicate, rule.affected, rule.when, rule.note, rule.base, rule.value)
                    if x is not None)
    words = {(quoted or word).lower() for quoted, word in WORDS.findall(said)}
    return {c for c in table.columns
            if c.lower() in words or any(w.startswith(PREFIX) and w.endswith(f"_{c.lower()}") for w in words)
            or not c.replace("_", "").isalnum()}


META_SCHEMA = (
    "array<struct<issue_no int, dimension string, column_name string, issue_type string, "
    "fix_action string, text string, severity_policy string, risk_policy string, "
    "auto_policy string, over double, always boolean>>")


def _meta(rules: list[Rule], first: int) -> Column:
    """The fixed part of the rules as one literal, so that a hundred rules cost one expression."""
    return F.from_json(F.lit(json.dumps([{
        "issue_no": first + i, "dimension": r.dimension, "column_name": r.column,
        "issue_type": r.issue_type, "fix_action": r.fix,
        "text": r.text or r.issue_type.replace("_", " "), "severity_policy": r.severity,
        "risk_policy": r.risk, "auto_policy": str(r.auto).lower(), "over": float(r.over),
        "always": r.always} for i, r in enumerate(rules)])), META_SCHEMA)


def _counted(frame: DataFrame, rules: list[Rule], first: int) -> DataFrame:
    """One row per rule: its fixed part, count, denominator, report flag and note."""
    # Expressions go to the JVM as SQL text where they can: one call for all of them.
    columns = [r.predicate.alias(f"p{i}") for i, r in enumerate(rules)
               if r.affected is None and not isinstance(r.predicate, str)]
    columns += [r.base.alias(f"v{i}") for i, r in enumerate(rules) if r.base is not None]
    texts = [f"({r.predicate}) AS p{i}" for i, r in enumerate(rules)
             if r.affected is None and isinstance(r.predicate, str)]
    aggregates = ["count(1) AS total"]
    for i, rule in enumerate(rules):
        aggregates.append(f"{rule.affected or f'count_if(p{i})'} AS n{i}")
        if rule.base is not None:
            aggregates.append(f"count(v{i}) AS b{i}")
        if rule.when is not None:
            aggregates.append(f"{rule.when} AS w{i}")
        if rule.note is not None:
            aggregates.append(f"{rule.note} AS t{i}")

    def gather(name: str, cells: list[str]) -> Column:
        return F.expr(f"array({', '.join(cells)}) AS {name}")

    flagged = frame.select("*", *columns) if columns else frame
    flagged = flagged.selectExpr("*", *texts) if texts else flagged
    return (flagged.selectExpr(*aggregates).select(
        _meta(rules, first).alias("m"),
        gather("n", [f"CAST(n{i} AS BIGINT)" for i in range(len(rules))]),
        gather("b", [f"CAST({f'b{i}' if r.base is not None else 'total'} AS BIGINT)"
                     for i, r in enumerate(rules)]),
        gather("w", [f"COALESCE(w{i}, false)" if r.when is not None else "true"
                     for i, r in enumerate(rules)]),
        gather("t", [f"CAST(t{i} AS STRING)" if r.note is not None else "CAST(NULL AS STRING)"
                     for i, r in enumerate(rules)]))
        .select(F.expr("inline(arrays_zip(m, n, b, w, t))"))
        .select("m.*", F.col("n").alias("affected_rows"), F.col("b").alias("base"),
                F.col("w").alias("shown"), F.col("t").alias("note")))


def measure(table: Table, rules: list[Rule]) -> DataFrame:
    """Issue table of ``rules`` over ``table``: one aggregate, no shuffle but its few rows."""
    spark = table.df.sparkSession
    if not rules:
        return spark.createDataFrame([], ISSUE_SCHEMA)
    frame = table.frame()
    counted = None
    for start in range(0, len(rules), RULES_PER_SCAN):
        part = _counted(frame, rules[start:start + RULES_PER_SCAN], start)
        counted = part if counted is None else counted.unionByName(part)
    shares = counted.selectExpr(
        "*", "COALESCE(affected_rows, 0L) AS hits",
        "CAST(COALESCE(try_divide(affected_rows, base), 0) AS DOUBLE) AS affected_pct")
    rate = F.col("affected_pct")
    severity = (F.when(F.col("severity_policy") == "rate", scoring.severity_of_rate(rate))
                .when(F.col("severity_policy") == "extreme",
                      F.when(rate > 0.05, "HIGH").otherwise("MEDIUM"))
                .otherwise(F.col("severity_policy")))
    risk = (F.when(F.col("risk_policy") == "severity", scoring.risk_of_severity(F.col("severity")))
            .otherwise(F.col("risk_policy")))
    return (
        shares.where("shown AND (always OR hits > 0) AND (over = 0 OR affected_pct > over)")
        .select("*", severity.alias("severity"))
        .select("*", risk.alias("risk_level"))
        .selectExpr(
            "dimension", "column_name", "issue_type",
            "concat(concat_ws(' ', text, note), ': ', format_number(hits, 0), ' rows') AS description",
            "hits AS affected_rows", "affected_pct", "severity", "risk_level", "fix_action",
            "auto_policy = 'true' OR (auto_policy = 'low' AND severity = 'LOW') AS auto_fixable",
            "CAST(array() AS ARRAY<STRING>) AS sample_values", "issue_no"))


def violations(table: Table, rules: list[Rule]) -> DataFrame:
    """(row key, dimension, column_name, issue_type, value), one row per broken rule and row."""
    spark = table.df.sparkSession
    keys = [F.col(f"`{k}`") for k in table.row_key]
    hits = []
    for rule in rules:
        if rule.predicate is None:
            continue
        shown = rule.value if rule.value is not None else F.lit(None)
        hits.append(F.when(rule.test, F.struct(
            F.lit(rule.dimension).alias("dimension"), F.lit(rule.column).alias("column_name"),
            F.lit(rule.issue_type).alias("issue_type"), shown.cast("string").alias("value"))))
    if not hits:
        return spark.createDataFrame([], "dimension string, column_name string, "
                                         "issue_type string, value string")
    found = F.filter(F.array(*hits), lambda h: h.isNotNull())
    return table.frame().select(*keys, F.inline(found))


def samples(table: Table, rules: list[Rule], size: int = 5) -> DataFrame:
    """The first ``size`` offending values of every rule, in row-key order.

    The rank filter lets Spark keep ``size`` rows per rule and task before the shuffle, so a rule
    that most rows break costs no more than a rare one.
    """
    keys = [F.col(f"`{k}`") for k in table.row_key]
    group = ["dimension", "column_name", "issue_type"]
    rank = F.row_number().over(Window.partitionBy(*group).orderBy(*keys, F.col("value")))
    return (violations(table, rules)
            .withColumn("__rank", rank).where(F.col("__rank") <= size)
            .groupBy(*group)
            .agg(F.array_sort(F.collect_list(F.struct("__rank", "value"))).alias("s"))
            .select(*group, F.transform("s", lambda s: s["value"]).alias("sample_values")))


def graded(facts: DataFrame, dimension: str, issue_type: str, severity: str = "rate",
           risk: str = "severity", fix: str = "flag_for_review", text: str = "",
           first: int = 0) -> DataFrame:
    """Issue table from (column_name, affected_rows, base [, sample_values]) rows."""
    rate = scoring.share(F.col("affected_rows"), F.col("base"))
    graded_by = scoring.severity_of_rate(F.col("affected_pct")) if severity == "rate" \
        else F.lit(severity)
    sampled = F.col("sample_values") if "sample_values" in facts.columns \
        else F.array().cast("array<string>")
    return (facts.where(F.col("affected_rows") > 0)
            .withColumn("affected_pct", rate)
            .withColumn("severity", graded_by)
            .withColumn("risk_level", scoring.risk_of_severity(F.col("severity"))
                        if risk == "severity" else F.lit(risk))
            .select(F.lit(dimension).alias("dimension"), "column_name",
                    F.lit(issue_type).alias("issue_type"),
                    F.concat(F.lit(text + ": "), F.format_number("affected_rows", 0),
                             F.lit(" rows")).alias("description"),
                    F.col("affected_rows").cast("bigint").alias("affected_rows"),
                    "affected_pct", "severity", "risk_level", F.lit(fix).alias("fix_action"),
                    F.lit(False).alias("auto_fixable"), sampled.alias("sample_values"),
                    F.lit(first).alias("issue_no")))
