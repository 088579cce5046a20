"""The full check of a table.

All predicate rules of all dimensions share one scan. Beyond it: the quartile passes over the
numeric columns, one grouping of row hashes, one grouping per set of keys, and the neighbour
comparison when a row key is given. Only issue rows and a few counts reach the driver.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame

from ..functions import fixed_values as fv
from ..operators import checks, declared, duplicates, entities, outliers, privacy, profile
from ..operators.quantiles import exact_quantiles
from ..operators.rule import ISSUE_SCHEMA, Rule, columns_read, measure, samples
from ..operators.table import Table
from . import scores as score_plan

DIMENSIONS = list(fv.DIMENSION_WEIGHTS)


@dataclass
class Analysis:
    domain: str
    issues: DataFrame
    scores: DataFrame
    facts: score_plan.Facts
    errors: dict[str, str] = field(default_factory=dict)
    table: Table | None = None
    rules: list[Rule] = field(default_factory=list)
    config: dict = field(default_factory=dict)
    numeric_facts: dict = field(default_factory=dict)
    stale_rows: int = 0
    measured: list[tuple] = field(default_factory=list)     # (dimension, column, issue type) counted in this check

    @property
    def overall(self) -> DataFrame:
        return score_plan.overall_score(self.scores)


def predicate_rules(table: Table, domain: str, as_of: dt.date, config: dict,
                    errors: dict | None = None) -> dict[str, list[Rule]]:
    """Rules of every dimension; a dimension whose rules cannot be built is noted in ``errors``."""
    sla = checks.freshness_days(domain, config)
    makers = {
        "completeness": lambda: checks.completeness(table),
        "validity": lambda: checks.validity(table, as_of),
        "consistency": lambda: checks.consistency(table),
        "standardization": lambda: checks.standardization(table),
        "accuracy": lambda: checks.accuracy(table, as_of),
        "timeliness": lambda: checks.timeliness(table, as_of, sla),
        "profiling": lambda: checks.profile_flags(table),
        "business_rules": lambda: checks.business(table),
        "pii_security": lambda: privacy.pii_rules(table),
        "auditability": lambda: checks.audit(table),
        "reconciliation": lambda: checks.reconciliation(table),
        "accessibility": lambda: checks.accessibility(table),
        "conformity": lambda: checks.conformity(table),
        "constraints": lambda: checks.constraints(table),
        "enrichment": lambda: checks.enrichment(table),
        "freshness": lambda: checks.freshness(table, as_of),
        "integrity": lambda: checks.integrity(table),
        "lineage": lambda: checks.lineage(table),
        "reliability": lambda: checks.reliability(table),
    }
    rules: dict[str, list[Rule]] = {}
    for dimension, make in makers.items():
        try:
            rules[dimension] = make()
        except Exception as error:      # one broken dimension must not stop the others
            rules[dimension] = []
            if errors is None:
                raise
            errors[dimension] = str(error)
    return rules


# Below this size per core a table is spread over all cores and kept for the passes of a check.
SMALL_BYTES_PER_CORE = 32 << 20


def spread_small(df: DataFrame) -> DataFrame | None:
    """A persisted, evenly spread copy of a small table; None for a table of many partitions."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores).persist() if size <= SMALL_BYTES_PER_CORE * cores else None


def analyze(df: DataFrame, as_of: dt.date, domain: str = "unknown",
            row_key: str | None = None, config: dict | None = None,
            dimensions: list[str] | None = None, catalogue: tuple | None = None,
            before: Analysis | None = None, changed: set[str] | None = None) -> Analysis:
    """Check ``df`` in the given dimensions (all 22 by default).

    ``row_key`` names a unique ordered column; it takes no part in the checks and gives the order
    for the neighbour comparison. ``catalogue`` is (fields, checks) of declared rules to evaluate.
    A small table is spread over the cores and kept in memory for the passes; a large one is read
    by each pass, pruned to the columns the pass needs.

    ``before`` and ``changed`` check a table again that differs from the one of ``before`` in the values of
    the ``changed`` columns only (same rows, same columns): rules that read none of them keep their
    counts and are not measured.
    """
    small = spread_small(df)
    try:
        done = _analyze(df if small is None else small, as_of, domain, row_key, config, dimensions,
                        catalogue, before, changed)
        done.table.df = df      # later questions read the table itself
        return done
    finally:
        if small is not None:
            small.unpersist()


def _analyze(df: DataFrame, as_of: dt.date, domain: str, row_key: str | None, config: dict | None,
             dimensions: list[str] | None, catalogue: tuple | None, before: Analysis | None = None,
             changed: set[str] | None = None) -> Analysis:
    config = config or {}
    spark = df.sparkSession
    wanted = dimensions or DIMENSIONS
    table = Table(df, row_key)
    errors: dict[str, str] = {}
    by_dimension = predicate_rules(table, domain, as_of, config, errors)
    rules = [r for d in DIMENSIONS if d in wanted for r in by_dimension.get(d, [])]

    views: dict = {}
    facts_of: dict = {}
    if "accuracy" in wanted or "reasonableness" in wanted:
        views = outliers.numeric_views(table, None if before is None else {
            c: c in before.numeric_facts for c in table.columns if c not in changed})
        known = {} if before is None else {c: f for c, f in before.numeric_facts.items() if c in views and c not in changed}
        fresh = {c: v for c, v in views.items() if c not in known}
        facts_of = known | (exact_quantiles(table.frame(), fresh, [0.25, 0.75]) if fresh or not known else {})
        facts_of = {c: facts_of[c] for c in views}
    if "accuracy" in wanted:
        fence_of = outliers.fences(table, views, config.get("outlier_iqr_factor", 1.5), facts_of)
        rules += outliers.outlier_rules(table, views, fence_of)
    if "reasonableness" in wanted:
        kept = outliers.extreme_columns(table)
        fence_of = outliers.fences(table, views, 3.0, {c: facts_of[c] for c in kept})
        rules += outliers.extreme_rules(table, fence_of)

    # Counts that only the scores need travel in the same scan.
    kept_rules = set()      # of the check before
    if before is not None:
        ran_before = {_key(r) for r in before.rules}
        touched = {_key(r) for r in rules if columns_read(r, table) & changed}
        kept_rules = {_key(r) for r in rules} & ran_before - touched
    every, rules = rules, [r for r in rules if _key(r) not in kept_rules]
    old = checks.stale(table, as_of, checks.freshness_days(domain, config))
    stale = Rule("__facts", "stale", "stale", "false" if old is None else old, always=True)
    rules.append(Rule("__facts", "rows", "rows", affected="count(1)", always=True))
    if before is None or columns_read(stale, table) & changed:
        rules.append(stale)
    measured = measure(table, rules).collect()
    counts = {} if before is None else {"stale": before.stale_rows}
    counts |= {r["column_name"]: r["affected_rows"] for r in measured if r["dimension"] == "__facts"}
    total = counts["rows"]
    rows = [tuple(r) for r in measured if r["dimension"] != "__facts"]
    if row_key:
        rows = _with_samples(rows, table, rules, config.get("samples", 3))
    if before is not None:
        rows += [tuple(r) for r in before.issues.collect() if tuple(r[:3]) in kept_rules]
    if "pii_security" in wanted:
        rows = _with_exposure(rows, table, total)

    found = []
    check_errors: dict[str, str] = {}       # declared checks that do not resolve, by name

    def keep(*kinds: str, columns: list[str] | None = None) -> None:
        """Take over the issues of the check before for columns that did not change."""
        if before is not None:
            rows.extend(tuple(r) for r in before.issues.collect() if r["issue_type"] in kinds
                        and (r["column_name"] not in changed if columns is None else r["column_name"] in columns))

    if total and "uniqueness" in wanted:
        if before is None or changed:
            found.append(duplicates.uniqueness_issues(table, total, only=changed))
            keep("duplicate_ids")
        else:
            keep("exact_duplicates", "duplicate_ids")
        if not row_key and config.get("near_duplicates", True) and duplicates.similar_columns(table):
            check_errors["near_duplicates"] = "left out: neighbours need a row key"
        if row_key and config.get("near_duplicates", True):
            keep("near_duplicates")
            for i, c in enumerate(duplicates.similar_columns(table)):
                part = None if before is not None and c not in changed else duplicates.similar_pairs_issue(
                    table, c, total, config.get("fuzzy_threshold", 90), first=1000 + i,
                    window=config.get("near_duplicates_window"))
                if part is not None:
                    found.append(part)
    if total and "profiling" in wanted:
        found.append(profile.high_cardinality(table, total, first=10_000, only=changed))
        keep("high_cardinality")
    if total and "survivorship" in wanted:
        torn = {k: {k, *entities.compared_columns(table, k)} for k in entities.entity_keys(table)}
        if before is None or any(c & changed for c in torn.values()):
            part = entities.survivorship_issues(table, total)
            if part is not None:
                found.append(part)
        else:
            keep("survivorship_conflict", "missing_golden_record", columns=list(torn))
    if catalogue and "business_rules" in wanted:
        found.append(declared.declared_issues(table, *catalogue, as_of, check_errors))
    for part in found:
        rows += [tuple(r) for r in part.collect()]       # issue rows: a few per column
    issues = spark.createDataFrame(rows, ISSUE_SCHEMA)
    rules = [r for r in every if r.dimension != "__facts"]
    facts = score_plan.Facts(
        total_rows=total, columns=len(table.columns),
        checked_columns=checks.validity_checked_columns(table),
        numeric_cells=sum(f["count"] for f in facts_of.values()), stale_rows=counts["stale"],
        missing_lineage=len(checks.missing_lineage(table)))
    ran = [d for d in wanted if d not in errors]
    errors |= check_errors
    return Analysis(domain, issues, score_plan.dimension_scores(issues, facts, ran), facts, errors,
                    table, rules, config, facts_of, counts["stale"],
                    [_key(r) for r in rules if _key(r) not in kept_rules])


def _key(rule: Rule) -> tuple:
    return rule.dimension, rule.column, rule.issue_type


def _with_samples(rows: list[tuple], table: Table, rules: list[Rule], size: int) -> list[tuple]:
    """The first offending values, in row-key order, of the predicate rules that found rows.

    One more scan, over the rules with issues only; each task passes on ``size`` values a rule.
    Personal data is not sampled.
    """
    hit = {tuple(r[:3]) for r in rows if r[4] and r[0] != "pii_security"}
    broken = []
    for rule in rules:
        if (rule.dimension, rule.column, rule.issue_type) in hit and rule.predicate is not None:
            if rule.value is None and rule.column in table.columns:
                rule = replace(rule, value=table.text(rule.column))
            broken.append(rule)
    if not broken or size < 1:
        return rows
    found = {tuple(r[:3]): r["sample_values"] for r in samples(table, broken, size).collect()}
    return [(*r[:10], [v for v in found.get(tuple(r[:3]), r[10]) if v is not None], *r[11:])
            for r in rows]


def _with_exposure(rows: list[tuple], table: Table, total: int) -> list[tuple]:
    """Put the summary in front of the personal-data issues and show masked formats only."""
    kinds = dict(privacy._named(table))
    out, columns = [], []
    for r in rows:
        if r[0] == "pii_security":
            columns.append(r[1])
            kind = kinds.get(r[1]) or next((k for k, _ in fv.PII_PATTERNS if f" {k}:" in r[3]), "")
            r = (*r[:10], privacy.masked_examples(kind, min(3, r[4])), r[11])
        out.append(r)
    if columns:
        share = 100.0 * len(columns) / len(table.columns)
        out.append(("pii_security", "DATASET", "pii_exposure_summary",
                    f"{len(columns)} of {len(table.columns)} columns hold personal data "
                    f"({share:.1f} %)", total, 1.0, "HIGH" if len(columns) > 3 else "MEDIUM", "HIGH",
                    "review_and_mask_all_pii", False, columns, -1))
    return out
