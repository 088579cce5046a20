"""Predicate rules, one function per quality dimension.

Each function looks at column names and kinds only and returns the rules that apply. Nothing is
read here; ``rule.measure`` counts all rules of all dimensions in one scan.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, functions as F

from ..functions import fixed_values as fv, text
from .rule import Rule
from .table import PREFIX, Table


def _days_before(as_of: dt.date, days: int) -> Column:
    return F.lit(as_of - dt.timedelta(days=days))


def _range_of(limits: tuple, as_of: dt.date) -> tuple[float, float]:
    low, high = limits
    return low, as_of.year if high is None else high


def completeness(table: Table) -> list[Rule]:
    rules = [Rule("completeness", c, "missing_values", f"{table.sql(c)} IS NULL",
                  fix="impute_or_flag", auto="low", text="missing values")
             for c in table.columns]
    rules += [Rule("completeness", c, "empty_strings", f"{table.stripped_sql(c)} = ''", risk="LOW",
                   fix="replace_with_null", auto=True, text="empty or blank text", value=table.col(c))
              for c in table.texts]
    return rules


def validity(table: Table, as_of: dt.date) -> list[Rule]:
    rules = []
    for c in table.columns:
        key = fv.PATTERN_OF_COLUMN.get(c.lower())
        if key:
            value = table.stripped(c)
            rules.append(Rule("validity", c, "pattern_violation", ~value.rlike(fv.PATTERNS[key]),
                              fix="flag_or_correct_format", text=f"not in {key} format",
                              value=value))
    for c in table.columns:
        if c.lower() in fv.RANGES and table.is_simple(c):
            low, high = _range_of(fv.RANGES[c.lower()], as_of)
            value = table.number(c)
            rules.append(Rule("validity", c, "range_violation", (value < low) | (value > high),
                              fix="clamp_or_flag", text=f"outside [{low}, {high}]", value=value))
    for c in table.texts:
        if text.contains_any(c, fv.CURRENCY_TEXT_WORDS):
            rules.append(Rule("validity", c, "type_mismatch", table.col(c).startswith("$"),
                              severity="HIGH", risk="MEDIUM", fix="strip_and_cast_numeric",
                              auto=True, text="numbers held as text with a $ sign",
                              value=table.col(c)))
    return rules


def validity_checked_columns(table: Table) -> int:
    return sum(1 for c in table.columns
               if c.lower() in fv.PATTERN_OF_COLUMN or c.lower() in fv.RANGES)


def derived_mismatch(table: Table, result: str, a: str, b: str, how: str) -> Column:
    """The derived column is off by more than the allowed share and slack."""
    left, right = table.number(a), table.number(b)
    expected = left * right if how == "product" else left + right
    allowed = F.abs(expected) * fv.DERIVED_SHARE + fv.DERIVED_SLACK
    return F.abs(table.number(result) - expected) > allowed


def _derived(table: Table):
    return [d for d in fv.DERIVED_COLUMNS if table.has(*d[:3])]


def consistency(table: Table) -> list[Rule]:
    rules = []
    for start, end in fv.DATE_PAIRS:
        if table.has(start, end):
            rules.append(Rule("consistency", f"{start}↔{end}", "date_order_violation",
                              table.date(end) < table.date(start), risk="HIGH",
                              fix="swap_dates_or_nullify", text=f"{end} lies before {start}",
                              value=table.col(end)))
    for result, a, b, how in _derived(table):
        rules.append(Rule("consistency", result, "calculation_inconsistency",
                          derived_mismatch(table, result, a, b, how), risk="HIGH",
                          fix=f"recalculate_{how}", auto=True, text=f"differs from {how} of {a}, {b}",
                          value=table.col(result)))
    for c in table.columns:
        allowed = fv.ENUM_VALUES.get(c.lower())
        if allowed:
            rules.append(Rule("consistency", c, "enum_inconsistency",
                              ~F.lower(table.text(c)).isin(allowed), risk="LOW",
                              fix="standardize_enum_values", auto=True,
                              text="not one of the agreed values", value=table.col(c)))
    if table.has("claim_date", "policy_start", "policy_end"):
        inside = table.date("claim_date").between(table.date("policy_start"),
                                                  table.date("policy_end"))
        known = (table.date("claim_date").isNotNull() & table.date("policy_start").isNotNull()
                 & table.date("policy_end").isNotNull())
        rules.append(Rule("consistency", "claim_date", "referential_integrity", known & ~inside,
                          severity="HIGH", risk="HIGH", text="claim outside the policy period",
                          value=table.col("claim_date")))
    return rules


def _minority(counts: list[str]) -> str:
    return f"{' + '.join(counts)} - greatest({', '.join(counts)})"


def standardization(table: Table) -> list[Rule]:
    rules = []
    for c in fv.MIXED_DATE_COLUMNS:
        if table.has(c) and table.is_text(c):
            # The shapes exclude each other, so the first match decides.
            table.flag("shape", c, lambda c=c: F.expr("CASE " + " ".join(
                f"WHEN `{c}` RLIKE r'{p}' THEN {i}" for i, (_, p) in enumerate(fv.DATE_SHAPES))
                + " END"))
            counts = [f"count_if(`{PREFIX}shape_{c}` = {i})" for i in range(len(fv.DATE_SHAPES))]
            summary = "concat_ws(', ', " + ", ".join(
                f"CASE WHEN {n} > 0 THEN concat('{label} ', {n}) END"
                for n, (label, _) in zip(counts, fv.DATE_SHAPES)) + ")"
            rules.append(Rule("standardization", c, "mixed_date_formats", affected=_minority(counts),
                              risk="MEDIUM", fix="standardize_date_format", auto=True,
                              text="several date formats", note=summary))
    for c in fv.TITLE_COLUMNS:
        if table.has(c):
            value = table.stripped(c)
            rules.append(Rule("standardization", c, "case_inconsistency", text.not_title_case(value),
                              risk="LOW", fix="apply_title_case", auto=True, text="not in title case",
                              value=value))
    for c in fv.UPPER_COLUMNS:
        if table.has(c):
            value = table.text(c)
            rules.append(Rule("standardization", c, "case_inconsistency", value != F.upper(value),
                              risk="LOW", fix="apply_upper_case", auto=True,
                              text="not in upper case", value=value))
    if table.has("phone"):
        shortest, longest = fv.PHONE_DIGITS
        size = F.length(text.digits(table.text("phone")))
        rules.append(Rule("standardization", "phone", "phone_format_violation",
                          (size < shortest) | (size > longest), risk="MEDIUM",
                          fix="standardize_phone_format",
                          text=f"not {shortest} to {longest} digits", value=table.col("phone")))
    rules += [Rule("standardization", c, "whitespace_issue", f"`{c}` != {table.stripped_sql(c)}",
                   severity="LOW", risk="LOW", fix="strip_whitespace", auto=True, over=0.01,
                   text="outer blanks", value=table.col(c))
              for c in table.texts]
    return rules


def accuracy(table: Table, as_of: dt.date) -> list[Rule]:
    """Impossible values; the outlier rules come from ``outliers``."""
    rules = []

    def add(column: str, bad, note: str) -> None:
        if table.has(column):
            value = table.number(column)
            rules.append(Rule("accuracy", column, "impossible_value", bad(value), severity="HIGH",
                              risk="HIGH", fix="flag_or_correct", text=note, value=value))

    add("age", lambda v: v < 0, "negative age")
    add("age", lambda v: v > 130, "age above 130")
    add("mileage", lambda v: v < 0, "negative mileage")
    add("year", lambda v: v < 1900, "year before 1900")
    add("year", lambda v: v > as_of.year, "year in the future")
    add("quantity", lambda v: v < 0, "negative quantity")
    add("fraud_flag", lambda v: ~v.isin(0.0, 1.0), "fraud flag other than 0 or 1")
    return rules


def business(table: Table) -> list[Rule]:
    rules = []

    def add(column: str, predicate: Column, name: str, fix: str, severity: str, value=None) -> None:
        rules.append(Rule("business_rules", column, "business_rule_violation", predicate,
                          severity=severity, risk=severity, fix=fix, text=f"[{name}]", value=value))

    for c in fv.NON_NEGATIVE_COLUMNS:
        if table.has(c):
            v = table.number(c)
            add(c, v < 0, "non_negative_amount", "set_to_absolute_value", "HIGH", v)
    if table.has("quantity"):
        v = table.number("quantity")
        add("quantity", v <= 0, "positive_quantity", "flag_or_set_to_one", "HIGH", v)
    if table.has("fraud_flag"):
        v = table.number("fraud_flag")
        add("fraud_flag", ~v.isin(0.0, 1.0), "valid_fraud_flag", "coerce_to_binary", "MEDIUM", v)
    if table.has("claim_amount", "coverage_amount"):
        v = table.number("claim_amount")
        add("claim_amount vs coverage_amount", v > table.number("coverage_amount"),
            "claim_not_exceed_coverage", "flag_for_review", "HIGH", v)
    if table.has("deductible", "coverage_amount"):
        v = table.number("deductible")
        add("deductible vs coverage_amount", v >= table.number("coverage_amount"),
            "deductible_less_than_coverage", "flag_for_review", "MEDIUM", v)
    for result, a, b, how in _derived(table):
        rules.append(Rule("business_rules", result, "calculation_rule_violation",
                          derived_mismatch(table, result, a, b, how), severity="HIGH", risk="HIGH",
                          fix=f"recalculate_{how}", auto=True, text=f"differs from {how} of {a}, {b}",
                          value=table.col(result)))
    return rules


def reconciliation(table: Table) -> list[Rule]:
    rules = []
    for c in table.columns:
        if text.contains_any(c, fv.RECONCILED_WORDS) and table.is_simple(c):
            readable = f"count({table.number_sql(c)})"
            rules.append(Rule("reconciliation", c, "amount_reconciliation_gap",
                              affected=f"count(1) - {readable}", when=f"{readable} < count(1) * 0.5",
                              severity="HIGH", risk="HIGH", fix="require_source_refresh",
                              text="amounts missing"))
    rules.append(Rule("reconciliation", "DATASET", "insufficient_row_count", affected="count(1)",
                      when="count(1) < 10", severity="HIGH", risk="HIGH",
                      fix="verify_full_data_load", text="too few rows"))
    for result, a, b, how in _derived(table):
        rules.append(Rule("reconciliation", result, "enrichment_accuracy",
                          derived_mismatch(table, result, a, b, how), severity="HIGH", risk="HIGH",
                          fix=f"recalculate_{how}", auto=True, text=f"differs from {how} of {a}, {b}",
                          value=table.col(result)))
    return rules


def integrity(table: Table) -> list[Rule]:
    return [Rule("integrity", needed, "integrity_violation",
                 (table.col(state) == value) & table.col(needed).isNull(), severity="HIGH",
                 text=f"{state} is {value} but {needed} is missing")
            for state, value, needed in fv.COMPLETION_RULES if table.has(state, needed)]


def conformity(table: Table) -> list[Rule]:
    rules = []
    for c in table.columns:
        if "email" in c.lower():
            rules.append(Rule("conformity", c, "email_format_violation",
                              ~table.text(c).rlike(fv.SIMPLE_EMAIL), fix="nullify_invalid_emails",
                              auto=True, text="not an e-mail address", value=table.col(c)))
        elif "zip" in c.lower():
            rules.append(Rule("conformity", c, "zipcode_format_violation",
                              ~table.text(c).rlike(fv.SIMPLE_ZIP), fix="clean_zipcodes", auto=True,
                              text="not a 5 or 9 digit code", value=table.col(c)))
    return rules


def constraints(table: Table) -> list[Rule]:
    rules = []
    if table.has("age"):
        v = table.number("age")
        rules.append(Rule("constraints", "age", "constraint_violation_age", (v < 0) | (v > 130),
                          fix="clip_age_constraint", auto=True, text="age outside 0 to 130", value=v))
    for c in table.columns:
        if text.contains_any(c, fv.NEGATIVE_WORDS) and table.is_simple(c):
            v = table.number(c)
            rules.append(Rule("constraints", c, "constraint_violation_negative_value",
                              f"{table.number_sql(c)} < 0", fix="absolute_value", auto=True,
                              text="negative value", value=v))
    return rules


def accessibility(table: Table) -> list[Rule]:
    return [Rule("accessibility", c, "unreadable_chars", text.non_ascii_sql(f"`{c}`"),
                 fix="strip_non_ascii", auto=True, text="characters outside ASCII",
                 value=table.col(c))
            for c in table.texts]


def enrichment(table: Table) -> list[Rule]:
    return [Rule("enrichment", c, "suboptimal_enrichment", f"length(`{c}`) BETWEEN 1 AND 2",
                 severity="LOW", risk="LOW", fix="flag_for_enrichment", over=0.10,
                 text="one or two characters only", value=table.col(c))
            for c in table.texts
            if not text.contains_any(c, ["code", "id"])
            and c.lower() not in fv.SHORT_TEXT_SKIP_COLUMNS]


def placeholder(table: Table, c: str) -> str | None:
    if table.is_text(c):
        return f"upper(`{c}`) IN ({', '.join(map(repr, fv.PLACEHOLDER_TEXT))})"
    if table.is_number(c):
        return f"{table.sql(c)} IN ({', '.join(map(str, fv.PLACEHOLDER_NUMBERS))})"
    return None


def reliability(table: Table) -> list[Rule]:
    found = [(c, placeholder(table, c)) for c in table.columns]
    return [Rule("reliability", c, "unreliable_default_values", p, fix="nullify_dummy_values",
                 auto=True, text="placeholder values", value=table.col(c))
            for c, p in found if p is not None]


def freshness_days(domain: str, config: dict) -> int:
    return config.get("freshness_sla_days",
                      fv.FRESHNESS_DAYS.get(domain, fv.FRESHNESS_DAYS_OTHER))


def update_column(table: Table) -> str | None:
    return next((c for c in fv.UPDATE_COLUMNS if table.has(c)), None)


def stale(table: Table, as_of: dt.date, sla: int) -> Column | None:
    """Older than three times the agreed freshness."""
    c = update_column(table)
    return None if c is None else table.date(c) < _days_before(as_of, 3 * sla)


def timeliness(table: Table, as_of: dt.date, sla: int) -> list[Rule]:
    rules = []
    c = update_column(table)
    if c:
        date = table.date_sql(c)
        old = table.date(c) < _days_before(as_of, 2 * 365)
        rules.append(Rule("timeliness", c, "stale_records_critical", old, risk="HIGH",
                          fix="flag_for_archival_or_refresh", text="not updated for two years",
                          value=table.col(c)))
        rules.append(Rule("timeliness", c, "stale_records", stale(table, as_of, sla),
                          when=f"count_if({date} < DATE'{as_of - dt.timedelta(730)}') = 0",
                          risk="MEDIUM", fix="flag_for_refresh",
                          text=f"older than 3 x {sla} days", value=table.col(c)))
    events = [c for c in fv.EVENT_DATE_COLUMNS if table.has(c)]
    for c in events:
        future = table.date(c) > F.lit(as_of)
        rules.append(Rule("timeliness", c, "future_dated_record", future, risk="HIGH",
                          fix="flag_or_nullify_future_dates", text="dated in the future, latest",
                          note=f"CAST(max({table.date_sql(c)}) AS STRING)",
                          value=table.col(c)))
    for c in events:
        rules.append(Rule("timeliness", c, "ancient_dates",
                          table.date(c) < _days_before(as_of, 10 * 365), severity="LOW", risk="LOW",
                          over=0.02, text="older than ten years", value=table.col(c)))
    return rules


def freshness(table: Table, as_of: dt.date) -> list[Rule]:
    limit = F.add_months(F.lit(as_of), -24)
    return [Rule("freshness", c, "stale_data", table.date(c) < limit, fix="flag_for_archive",
                 text="older than two years", value=table.col(c))
            for c in table.columns if c.lower() in fv.FRESHNESS_COLUMNS]


def missing_lineage(table: Table) -> list[str]:
    return [c for c in fv.LINEAGE_COLUMNS if not table.has(c)]


def lineage(table: Table) -> list[Rule]:
    if len(missing_lineage(table)) <= 2:
        return []
    return [Rule("lineage", None, "missing_traceability_metadata", affected="count(1)",
                 severity="MEDIUM", risk="LOW", fix="add_default_lineage_metadata", auto=True,
                 text="lineage columns missing")]


def audit(table: Table) -> list[Rule]:
    rules = []
    stamps = [c for c in fv.AUDIT_COLUMNS if table.has(c)]
    if not stamps:
        rules.append(Rule("auditability", "DATASET", "missing_audit_timestamp", affected="count(1)",
                          severity="MEDIUM", risk="MEDIUM", fix="add_audit_timestamp_column",
                          text="no audit column"))
    if not any(c.lower() in fv.KEY_COLUMNS or c.lower().endswith("_id") for c in table.columns):
        rules.append(Rule("auditability", "DATASET", "missing_primary_key", affected="count(1)",
                          severity="HIGH", risk="HIGH", fix="add_primary_key", text="no key column"))
    rules += [Rule("auditability", c, "missing_audit_timestamp_value", f"{table.sql(c)} IS NULL",
                   risk="MEDIUM", fix="populate_audit_timestamps", text="audit value missing")
              for c in stamps]
    return rules


def profile_flags(table: Table) -> list[Rule]:
    """Constant and all-null columns; high cardinality needs a distinct count (``profile``)."""
    rules = []
    for c in table.columns:
        v = table.sql(c)
        if table.is_simple(c):
            # Texts are compared by a 64-bit hash, so that the aggregate stays a hash aggregate.
            same = f"if({v} IS NULL, NULL, xxhash64({v}))" if table.is_text(c) else v
            rules.append(Rule("profiling", c, "constant_column", affected="count(1)",
                              when=f"min({same}) = max({same})", severity="MEDIUM", risk="LOW",
                              fix="review_or_drop_column", text="a single value"))
        rules.append(Rule("profiling", c, "all_null_column", affected="count(1)",
                          when=f"count({v}) = 0", severity="HIGH", risk="MEDIUM",
                          fix="drop_column", text="no value at all"))
    return rules
