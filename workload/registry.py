"""Registry of the queries and of their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from plumbline.operators.rule import Rule, measure
from plumbline.operators.table import Table

from . import inputs

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

ISSUE_VIEW = ["column_name", "issue_type", "affected_rows", "affected_pct", "severity",
              "risk_level", "fix_action", "auto_fixable"]


def query(name: str, sql: str | None = None):
    """Register the decorated function; ``sql`` may name dirty views."""
    def register(function):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = function
        if sql is not None:
            SQL[name] = inputs.with_views(sql)
        return function
    return register


def shown(issues: DataFrame) -> DataFrame:
    return issues.select(*ISSUE_VIEW).withColumn("affected_pct", F.round("affected_pct", 6))


def rule_query(name: str, view: str, rules_of: Callable[[Table], list[Rule]], issue_type: str,
               specs: list[tuple]) -> None:
    """Register a query that measures the rules of one issue type over a view."""
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        table = Table(inputs.view(spark, sf_dir, view), "row_key")
        return shown(measure(table, [r for r in rules_of(table) if r.issue_type == issue_type]))
    query(name, issue_sql(view, issue_type, specs))(run)


SEVERITY = ("CASE WHEN affected_pct >= 0.30 THEN 'CRITICAL' WHEN affected_pct >= 0.10 THEN 'HIGH' "
            "WHEN affected_pct >= 0.05 THEN 'MEDIUM' ELSE 'LOW' END")
RISK = ("CASE WHEN severity IN ('CRITICAL', 'HIGH') THEN 'HIGH' WHEN severity = 'MEDIUM' "
        "THEN 'MEDIUM' ELSE 'LOW' END")


def issue_sql(view: str, issue_type: str, specs: list[tuple]) -> str:
    """SQL for an issue table. A spec is (column, predicate, severity, risk, fix, auto[, options]):
    severity 'rate' or fixed, risk 'severity' or fixed, auto true / false / low; options may hold
    count (an aggregate in place of the predicate's), base, over and when."""
    counts, rows = [], []
    for i, spec in enumerate(specs):
        column, predicate, severity, risk, fix, auto = spec[:6]
        o = spec[6] if len(spec) > 6 else {}
        counts.append(f"{o.get('count') or f'count(*) FILTER (WHERE {predicate})'} AS n{i}")
        counts.append(f"{o.get('base') or 'count(*)'} AS b{i}")
        counts.append(f"{o.get('when') or 'true'} AS w{i}")
        sev = SEVERITY if severity == "rate" else (
            "CASE WHEN affected_pct > 0.05 THEN 'HIGH' ELSE 'MEDIUM' END"
            if severity == "extreme" else f"'{severity}'")
        rsk = RISK if risk == "severity" else f"'{risk}'"
        aut = {"true": "true", "false": "false", "low": "severity = 'LOW'"}[auto]
        name = f"'{column}'" if column is not None else "CAST(NULL AS VARCHAR)"
        rows.append(
            f"SELECT column_name, '{issue_type}' AS issue_type, affected_rows, "
            f"round(affected_pct, 6) AS affected_pct, severity, {rsk} AS risk_level, "
            f"'{fix}' AS fix_action, {aut} AS auto_fixable FROM (SELECT *, {sev} AS severity FROM ("
            f"SELECT {name} AS column_name, CAST(n{i} AS BIGINT) AS affected_rows, "
            f"n{i} * 1.0 / b{i} AS affected_pct FROM m WHERE n{i} > 0 AND w{i}) "
            f"WHERE affected_pct > {o.get('over', 0)})")
    return (f"WITH m AS (SELECT {', '.join(counts)} FROM {view}) "
            + " UNION ALL ".join(rows))


def date_sql(c: str) -> str:
    return (f"CAST(try_strptime(trim({c}), ['%Y-%m-%d', '%m/%d/%Y', '%d-%m-%Y', '%Y/%m/%d']) "
            "AS DATE)")
