"""Personal data: finding the columns, comparing with a declared policy, protecting values."""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import fixed_values as fv
from .ordering import attach, with_row_number
from .rule import Rule
from .table import PREFIX, Table

MIN_SHARE = 0.05


def _named(table: Table) -> list[tuple[str, str]]:
    return [(c, fv.PII_COLUMN_NAMES[c.lower().strip()]) for c in table.columns
            if c.lower().strip() in fv.PII_COLUMN_NAMES]


def _unnamed(table: Table) -> list[str]:
    named = {c for c, _ in _named(table)}
    return [c for c in table.texts if c not in named]


# What every match of a pattern holds, cheaper to look for than the pattern: text without it is not searched.
HELD = {"SSN": "[0-9]-[0-9]{2}-[0-9]", "Credit Card": "[0-9]{13}", "Phone": "[0-9]{4}", "Date of Birth": "[0-9][-/][0-9]{2}[-/]",
        "IP Address": "[0-9][.][0-9]", "Passport": "[A-Z][0-9]{6}", "Driver License": "[A-Z][0-9]{7}", "Bank Routing": "[0-9]{9}"}
# Bytes of the shortest match.
SHORTEST = {"SSN": 11, "Credit Card": 13, "Phone": 10, "Date of Birth": 10, "IP Address": 7, "Passport": 7, "Driver License": 8,
            "Bank Routing": 9}
SHORTEST_DIGIT_MATCH = 7      # no pattern but the e-mail one matches a shorter text
ANY_DIGITS = "[0-9]{2}|[0-9][.][0-9]"


def pattern_tests(table: Table, name: str) -> dict[str, str]:
    """SQL tests of one text column, by type of personal data.

    A text is searched for digits once; only one that has some meets the tests of the single patterns,
    and each pattern only a text that is long enough and holds what all its matches do.
    """
    table.flag("any_digits", name, lambda: F.expr(
        f"length(`{name}`) >= {SHORTEST_DIGIT_MATCH} AND `{name}` RLIKE r'{ANY_DIGITS}'"))
    tests = {}
    for kind, pattern in fv.PII_PATTERNS:
        possible = f"contains(`{name}`, '@')" if "@" in pattern else \
            f"`{PREFIX}any_digits_{name}` AND octet_length(`{name}`) >= {SHORTEST[kind]} AND `{name}` RLIKE r'{HELD[kind]}'"
        tests[kind] = f"{possible} AND `{name}` RLIKE r'{pattern}'"
    return tests


def pattern_counts(table: Table, name: str, by: list[str]) -> DataFrame:
    """One row per value of ``by`` with the number of texts that match each pattern; one scan."""
    tests = pattern_tests(table, name)
    return table.frame().groupBy(*by).agg(*[
        F.expr(f"count_if({test})").alias(kind.lower().replace(" ", "_")) for kind, test in tests.items()])


def _winner(table: Table, name: str) -> tuple[str, str]:
    """SQL for (type, matches) of the first pattern that more than a twentieth of the values match."""
    kinds, hits = [], []
    for kind, test in pattern_tests(table, name).items():
        enough = f"WHEN count_if({test}) > count(`{name}`) * {MIN_SHARE} THEN"
        kinds.append(f"{enough} '{kind}'")
        hits.append(f"{enough} count_if({test})")
    return f"CASE {' '.join(kinds)} END", f"CASE {' '.join(hits)} ELSE 0 END"


def pii_columns(table: Table) -> DataFrame:
    """(column_name, pii_type, detected_by, affected_rows, total_rows); one scan, all values."""
    aggregates, cells = ["count(1) AS total"], []
    found = [(c, "name", f"'{kind}'", f"count({table.sql(c)})") for c, kind in _named(table)]
    found += [(c, "pattern", *_winner(table, c)) for c in _unnamed(table)]
    schema = ("column_name string, pii_type string, detected_by string, affected_rows bigint, "
              "total_rows bigint")
    if not found:
        return table.df.sparkSession.createDataFrame([], schema)
    for i, (c, how, kind, hits) in enumerate(found):
        aggregates += [f"{hits} AS n{i}", f"any_value({kind}) AS k{i}" if how == "name"
                       else f"{kind} AS k{i}"]
        cells.append(f"named_struct('column_name', '{c}', 'pii_type', k{i}, 'detected_by', '{how}', "
                     f"'affected_rows', n{i}, 'total_rows', total)")
    return (table.frame().selectExpr(*aggregates).selectExpr(f"inline(array({', '.join(cells)}))")
            .where("pii_type IS NOT NULL AND affected_rows > 0"))


def pii_rules(table: Table) -> list[Rule]:
    """Rules for the shared scan. No real value is ever shown for this dimension."""
    rules = [Rule("pii_security", c, "pii_detected_by_name", affected=f"count({table.sql(c)})",
                  severity="HIGH", risk="HIGH", fix="mask_pii", text=f"named like {kind}")
             for c, kind in _named(table)]
    for c in _unnamed(table):
        kind, hits = _winner(table, c)
        rules.append(Rule("pii_security", c, "pii_detected_by_pattern", affected=hits,
                          severity="HIGH", risk="HIGH", fix="mask_pii", text="values look like",
                          note=kind))
    return rules


def exposure_summary(table: Table) -> DataFrame:
    """One row if any column holds personal data: columns, share of columns, types, severity."""
    n = F.count(F.lit(1))
    return (pii_columns(table).agg(
        n.alias("pii_columns"),
        F.round(n / F.lit(len(table.columns)) * 100, 1).alias("pii_pct"),
        F.concat_ws(", ", F.array_sort(F.collect_set("pii_type"))).alias("pii_types"),
        F.when(n > 3, "HIGH").otherwise("MEDIUM").alias("severity"),
        F.max("total_rows").alias("affected_rows")).where("pii_columns > 0"))


def masked_examples(kind: str, size: int = 3) -> list[str]:
    """Different invented values that show the format of a kind only; readable digits count up."""
    shape = fv.MASKED_SHAPES.get(kind, f"[Protected: {kind}]")
    out = []
    for i in range(size):
        digits = itertools.cycle(str((i + k) % 10) for k in range(1, 11))
        out.append("".join(next(digits) if c == "#" else c for c in shape))
    return list(dict.fromkeys(out))


def format_examples(spark: SparkSession) -> DataFrame:
    """(pii_type, masked_examples) of every kind."""
    return spark.createDataFrame([(k, masked_examples(k)) for k in fv.MASKED_SHAPES],
                                 "pii_type string, masked_examples array<string>")


def policy_gaps(table: Table, declared: list[str]) -> DataFrame:
    """(column_name, pii_type, status): declared columns against detected ones."""
    spark = table.df.sparkSession
    policy = spark.createDataFrame([(c,) for c in declared], "column_name string")
    present = spark.createDataFrame([(c, True) for c in table.columns],
                                    "column_name string, present boolean")
    policy = policy.join(F.broadcast(present), "column_name", "left").withColumn("declared", F.lit(True))
    found = pii_columns(table).select("column_name", "pii_type", F.lit(True).alias("detected"))
    both = policy.join(found, "column_name", "full_outer")
    status = (F.when(F.col("declared") & F.col("detected"), "declared and detected")
              .when(F.col("detected"), "detected, not declared")
              .when(F.col("present"), "declared, not detected")
              .otherwise("declared, no such column"))
    return both.select("column_name", "pii_type", status.alias("status"))


# --- protection ---------------------------------------------------------------------------------

def hashed(c: Column) -> Column:
    return F.upper(F.substring(F.sha2(c.cast("string"), 256), 1, 16))


def masked(c: Column, parity: bool = False) -> Column:
    text = c.cast("string")
    size = F.length(text)
    out = F.when(size > 4, F.concat(F.left(text, F.lit(2)), F.repeat(F.lit("*"), size - 4),
                                    F.right(text, F.lit(2)))).otherwise("****")
    return out if parity else F.when(text.isNotNull(), out)


def tokens(df: DataFrame, column: str, row_key: str) -> DataFrame:
    """(value, token, rows): tokens numbered by the first appearance of each value.

    Values are counted with partial aggregates, then numbered in parallel.
    """
    values = (df.where(F.col(column).isNotNull())
              .groupBy(F.col(column).cast("string").alias("value"))
              .agg(F.min(row_key).alias("seen"), F.count(F.lit(1)).alias("rows")))
    numbered = with_row_number(values, ["seen", "value"], "n")
    token = F.concat(F.lit(f"TOKEN-{column.upper()[:4]}-"),
                     F.when(F.col("n") < 999_999,
                            F.lpad((F.col("n") + 1).cast("string"), 6, "0"))
                     .otherwise((F.col("n") + 1).cast("string")))
    return numbered.select("value", token.alias("token"), "rows")


def tokenized(df: DataFrame, column: str, row_key: str) -> tuple[DataFrame, DataFrame]:
    """The table with tokens in place of values, and the token map needed to reverse it."""
    mapping = tokens(df, column, row_key)
    texts = df.withColumn(column, F.col(column).cast("string"))
    out = attach(texts, column, mapping.withColumnRenamed("value", column), ["token"], "rows")
    return out.withColumn(column, F.col("token")).select(*df.columns), mapping.drop("rows")


PLAN_WORDS = {"masking": "mask", "encryption": "hash", "tokenization": "tokenize"}


def protect(df: DataFrame, plan: dict[str, str], row_key: str | None = None,
            default_mode: str | None = None, parity: bool = False):
    """Apply {column: mode}; returns (table, log rows DataFrame, {column: token map}).

    Modes: hash, mask, tokenize, remove, redact, or the words Masking, Encryption, Tokenization.
    With ``default_mode`` the detected personal columns missing from the plan get that mode.
    """
    plan = {c: PLAN_WORDS.get(m.lower(), m.lower()) for c, m in plan.items() if c in df.columns}
    if default_mode:
        table = Table(df, row_key)
        for row in pii_columns(table).collect():
            plan.setdefault(row["column_name"], default_mode)
    actions = {"hash": "hash_pii", "mask": "mask_pii", "tokenize": "tokenize_pii",
               "remove": "remove_pii", "redact": "redact_pii"}
    unknown = sorted(set(plan.values()) - set(actions))
    if unknown:
        raise ValueError(f"unknown protection mode: {', '.join(unknown)}")
    schema = "action string, column_name string, masking_mode string, rows_affected bigint"
    if plan:
        counts = df.agg(*[F.count(F.col(c)).alias(f"n{i}") for i, c in enumerate(plan)])
        log = counts.select(F.inline(F.array(*[
            F.struct(F.lit(actions[m]).alias("action"), F.lit(c).alias("column_name"),
                     F.lit(m).alias("masking_mode"), F.col(f"n{i}").alias("rows_affected"))
            for i, (c, m) in enumerate(plan.items())]))).where("rows_affected > 0")
    else:
        log = df.sparkSession.createDataFrame([], schema)
    maps, out = {}, df
    for c, mode in plan.items():
        if mode == "tokenize":
            if row_key is None:
                raise ValueError("tokenize needs a row key for the order of first appearance")
            out, maps[c] = tokenized(out, c, row_key)
    changed = {}
    for c, mode in plan.items():
        value = F.col(f"`{c}`")
        if mode == "hash":
            changed[c] = hashed(value)
        elif mode == "mask":
            changed[c] = masked(value, parity)
        elif mode == "remove":
            changed[c] = F.lit(None).cast(df.schema[c].dataType)
        elif mode == "redact":
            redacted = F.lit("[REDACTED]")
            changed[c] = redacted if parity else F.when(value.isNotNull(), redacted)
    return out.withColumns(changed) if changed else out, log, maps
