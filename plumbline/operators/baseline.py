"""Stored profile baselines and drift.

A profile state is a table of counts, one row per column, part and bucket. States of different days
or files are merged by adding counts (registers by their maximum), in any order and number, and the
result equals the state of all rows at once. Parts:

* ``nulls``: rows without a value; the other rows are those of ``cells``.
* ``cells``: numbers by eighths of powers of two, so a quantile is known within a sixteenth of itself; dates by
  month; other values by one of 256 hash cells.
* ``lengths``: code points of a text, in the cells of numbers.
* ``registers``: 1024 registers of a distinct-count sketch: n is the longest run of leading zeros.
* ``heavy``: values that at least one row in a hundred of that state holds, with their counts. A value
  that common in merged states is that common in one of them at least, so merging loses none; its
  count lacks the states in which it was rarer.

Every entry is a count of at most a few thousand per column, whatever the rows: only these are
shuffled, after partial counts, and a state of a year of days stays small.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.errors import AnalysisException

from ..session import stored
from .table import Table

STATE = "column_name string, kind string, part string, bucket bigint, value string, n bigint"
KEYS = ["column_name", "kind", "part", "bucket", "value"]
HEAVY_SHARE = 100       # a value is heavy if at least one row in so many holds it
REGISTERS = 1024
EXPONENTS = 1100        # above the exponents of all doubles
HASH_CELLS = 256
MAJOR, MODERATE = 0.25, 0.1     # limits of the stability index


def _power(a: Column, guess: Column) -> Column:
    """The exponent of a double from a guess that is off by one at most."""
    return (F.when(F.pow(F.lit(2.0), guess) > a, guess - 1)
            .when(F.pow(F.lit(2.0), guess + 1) <= a, guess + 1).otherwise(guess))


def _cell(x: Column, a: Column, power: Column) -> Column:
    eighth = F.floor((a / F.pow(F.lit(2.0), power) - 1) * 8)
    cell = (power + EXPONENTS) * 8 + eighth + 1
    top = F.lit(float(EXPONENTS * 16))
    return F.when(a == 0, 0).otherwise(F.signum(x) * F.when(a == float("inf"), top).otherwise(cell)).cast("bigint")


def number_cell(x: Column) -> Column:
    """Cell of a double, in the order of the numbers; 0 for zero. All steps are exact."""
    a = F.abs(x)
    return _cell(x, a, _power(a, F.floor(F.log2(a)).cast("double")))


def with_number_cell(df: DataFrame, number: str, name: str) -> DataFrame:
    """``df`` with the ``number_cell`` of a column; each step is a column of its own, worked out once."""
    steps = (df.withColumn("__a", F.abs(F.col(number))).withColumn("__guess", F.floor(F.log2("__a")).cast("double"))
             .withColumn("__power", _power(F.col("__a"), F.col("__guess"))))
    return steps.withColumn(name, _cell(F.col(number), F.col("__a"), F.col("__power"))).drop("__a", "__guess", "__power")


def cell_middle(cell: Column) -> Column:
    """The number in the middle of a cell."""
    code = F.abs(cell) - 1
    low = F.pow(F.lit(2.0), F.floor(code / 8) - EXPONENTS) * (1 + (code % 8) / 8)
    return F.when(cell == 0, 0.0).otherwise(F.signum(cell.cast("double")) * low * (1 + 1 / (16 + 2 * (code % 8))))


def kinds(table: Table) -> dict[str, str]:
    """Columns with a profile and how their values are counted."""
    return {c: "number" if table.is_number(c) else "date" if table.is_time(c) else "text"
            for c in table.columns if table.is_simple(c)}


# Parts of a state as they are counted; the hash cells of all values serve to find the heavy ones.
PARTS = ["nulls", "cells", "registers", "lengths", "hashes"]


def _values(table: Table, kind: dict[str, str]) -> DataFrame:
    """(c, kind, s, x) per row and column: place and kind of the column, the value as text, and as a number: the
    number itself, the month of a date, the code points of a text."""
    def cell(place: int, column: str) -> Column:
        c = table.col(column)
        x = {"number": lambda: c, "date": lambda: F.year(c) * 12 + F.month(c),
             "text": lambda: F.length(c.cast("string"))}[kind[column]]()
        return F.struct(F.lit(place).alias("c"), F.lit(kind[column]).alias("kind"), c.cast("string").alias("s"),
                        x.cast("double").alias("x"))

    return table.df.select(F.inline(F.array(*[cell(i, c) for i, c in enumerate(kind)])))


def _counts(table: Table, kind: dict[str, str]) -> DataFrame:
    """(c, p, bucket, n) of all rows: column and part by place. One scan, and one shuffle of partial counts.

    Columns become rows first, so every step is written once whatever the number of columns, and small
    enough to be compiled.
    """
    values = _values(table, kind).withColumn("name", F.md5(F.col("s").cast("binary")))
    # 13 digits of the hash: 12 bits name a register, 32 its leading zeros, 8 the hash cell.
    values = (values.withColumn("digits", F.conv(F.substring("name", 1, 13), 16, 10).cast("bigint"))
              .withColumn("bits", F.shiftright("digits", 8).bitwiseAND(F.lit(0xFFFFFFFF))))
    values = with_number_cell(values.withColumn("y", F.when(F.col("kind") != "date", F.col("x"))), "y", "number")
    cell = (F.when(F.col("kind") == "number", F.col("number")).when(F.col("kind") == "date", F.col("x").cast("bigint"))
            .otherwise(F.col("digits").bitwiseAND(F.lit(HASH_CELLS - 1))))
    zeros = F.when(F.col("bits") == 0, 33).otherwise(33 - F.length(F.bin("bits")))

    def entry(part: str, bucket: Column, rank: Column | None = None) -> Column:
        return F.struct(F.lit(PARTS.index(part)).alias("p"), bucket.cast("bigint").alias("bucket"),
                        (F.lit(0) if rank is None else rank).cast("bigint").alias("rank"))

    missing = F.array(entry("nulls", F.lit(0)))
    some = [entry("cells", cell), entry("registers", F.shiftright("digits", 40) % REGISTERS, zeros),
            entry("hashes", F.conv(F.substring("name", 20, 3), 16, 10))]
    text = F.array(*some, entry("lengths", F.col("number")))
    entries = F.when(F.col("s").isNull(), missing).when(F.col("kind") == "text", text).otherwise(F.array(*some))
    return (values.select("c", F.inline(entries)).groupBy("c", "p", "bucket")
            .agg(F.count(F.lit(1)).alias("rows"), F.max("rank").alias("rank"))
            .select("c", "p", "bucket", F.when(F.col("p") == PARTS.index("registers"), F.col("rank"))
                    .otherwise(F.col("rows")).alias("n")))


def profile_state(table: Table) -> DataFrame:
    """The state of all rows: (column_name, kind, part, bucket, value, n).

    One scan and one shuffle of partial counts, then one more scan for the heavy values, which looks
    only at values whose hash cell holds enough rows for one. The state, a few thousand rows a column, is
    written, so whatever reads it does not scan again.
    """
    spark, kind = table.df.sparkSession, kinds(table)
    if not kind:
        return spark.createDataFrame([], STATE)
    counted = stored(_counts(table, kind))
    names = F.array(*map(F.lit, kind))
    kept = counted.where(F.col("p") != PARTS.index("hashes")).select(
        names[F.col("c")].alias("column_name"), F.array(*map(F.lit, kind.values()))[F.col("c")].alias("kind"),
        F.array(*map(F.lit, PARTS))[F.col("p")].alias("part"), "bucket", F.lit(None).cast("string").alias("value"), "n")
    return stored(kept.unionByName(heavy(table, kind, counted)))


def heavy(table: Table, kind: dict[str, str], counted: DataFrame) -> DataFrame:
    """State rows of the heavy values.

    A heavy value makes its hash cell heavy. ``counted`` has the rows of the hash cells, a few thousand per
    column, and only values in heavy cells, at most a hundred a column, are counted themselves.
    """
    spark, names = table.df.sparkSession, list(kind)
    whole = [PARTS.index("nulls"), PARTS.index("cells")]
    total = counted.where((F.col("c") == 0) & F.col("p").isin(whole)).agg(F.sum("n")).first()[0] or 0
    found = counted.where((F.col("p") == PARTS.index("hashes")) & (F.lit(HEAVY_SHARE) * F.col("n") >= total)).collect()
    if not found:
        return spark.createDataFrame([], STATE)
    columns = sorted({r["c"] for r in found})
    cells = spark.createDataFrame([(names[r["c"]], f"{r['bucket']:03x}") for r in found], "column_name string, cell string")
    texts = table.df.select(*[table.col(names[i]).cast("string").alias(names[i]) for i in columns]).unpivot(
        [], [f"`{names[i]}`" for i in columns], "column_name", "value").where(F.col("value").isNotNull())
    near = (texts.withColumn("cell", F.substring(F.md5(F.col("value").cast("binary")), 20, 3))
            .join(F.broadcast(cells), ["column_name", "cell"], "left_semi"))
    named = F.create_map(*[F.lit(x) for pair in kind.items() for x in pair])
    return (near.groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("n"))
            .where(F.lit(HEAVY_SHARE) * F.col("n") >= total)
            .select("column_name", named[F.col("column_name")].alias("kind"), F.lit("heavy").alias("part"),
                    F.lit(0).cast("bigint").alias("bucket"), "value", "n"))


def merged(states: DataFrame) -> DataFrame:
    """One state of several."""
    return states.groupBy(*KEYS).agg(
        F.when(F.col("part") == "registers", F.max("n")).otherwise(F.sum("n")).alias("n"))


def summary(state: DataFrame) -> DataFrame:
    """(column_name, kind, rows, nulls, distinct_estimate, median, low, high) per column of a state: numbers
    are the middles of the cells that hold the median and the two ends."""
    part, n = F.col("part"), F.col("n")
    held = F.sum(F.when(part == "registers", F.pow(F.lit(2.0), -n.cast("double")) - 1)) + REGISTERS
    raw = 0.7213 / (1 + 1.079 / REGISTERS) * REGISTERS * REGISTERS / held
    empty = REGISTERS - F.count_if(part == "registers")
    # Few values leave registers empty; their number is then the better measure.
    estimate = F.when((raw <= 2.5 * REGISTERS) & (empty > 0), REGISTERS * F.log(REGISTERS / empty)).otherwise(raw)
    facts = state.groupBy("column_name", "kind").agg(
        F.coalesce(F.sum(F.when(part.isin("cells", "nulls"), n)), F.lit(0)).alias("rows"),
        F.coalesce(F.sum(F.when(part == "nulls", n)), F.lit(0)).alias("nulls"),
        F.round(estimate).cast("bigint").alias("distinct_estimate"))
    cells = state.where("part = 'cells' AND kind = 'number'")
    upto = Window.partitionBy("column_name").orderBy("bucket")
    placed = cells.withColumn("upto", F.sum("n").over(upto)).withColumn("all", F.sum("n").over(
        Window.partitionBy("column_name")))
    middle = F.min_by("bucket", F.when(F.col("upto") * 2 >= F.col("all"), F.col("bucket")))
    numbers = placed.groupBy("column_name").agg(
        cell_middle(middle).alias("median"), cell_middle(F.min("bucket")).alias("low"),
        cell_middle(F.max("bucket")).alias("high"))
    return facts.join(F.broadcast(numbers), "column_name", "left")


def drift(before: DataFrame, after: DataFrame) -> DataFrame:
    """(column_name, part, stability_index, chance, distance, null_change, level): how two states differ.

    ``stability_index`` is the sum over cells of (p - q) * ln(p / q), half a row added to each cell;
    ``chance`` is what two samples of the same rows show on average, and the level counts what goes beyond;
    ``distance`` is the largest difference of the shares up to a cell (numbers, dates, lengths), or half the
    sum of the differences (hash cells); ``null_change`` the change of the share of nulls. Columns that one
    state lacks are left out.
    """
    both = before.withColumn("side", F.lit(0)).unionByName(after.withColumn("side", F.lit(1)))
    sides = (both.where(F.col("part").isin("cells", "lengths")).groupBy("column_name", "kind", "part", "bucket").agg(
        F.sum(F.when(F.col("side") == 0, F.col("n")).otherwise(0)).alias("a"),
        F.sum(F.when(F.col("side") == 1, F.col("n")).otherwise(0)).alias("b")))
    group = Window.partitionBy("column_name", "part")
    upto = group.orderBy("bucket")
    shares = sides.select(
        "*", F.sum("a").over(group).alias("all_a"), F.sum("b").over(group).alias("all_b"),
        F.count(F.lit(1)).over(group).alias("cells"), F.sum("a").over(upto).alias("up_a"), F.sum("b").over(upto).alias("up_b"))
    p = (F.col("a") + 0.5) / (F.col("all_a") + 0.5 * F.col("cells"))
    q = (F.col("b") + 0.5) / (F.col("all_b") + 0.5 * F.col("cells"))
    gap = F.abs(F.col("up_a") / F.col("all_a") - F.col("up_b") / F.col("all_b"))
    apart = F.abs(F.col("a") / F.col("all_a") - F.col("b") / F.col("all_b"))
    hashed = (F.col("kind") == "text") & (F.col("part") == "cells")
    found = shares.where("all_a > 0 AND all_b > 0").groupBy("column_name", "part").agg(
        F.round(F.sum((p - q) * F.log(p / q)), 6).alias("stability_index"),
        F.round((F.max("cells") - 1) * (1 / F.max("all_a") + 1 / F.max("all_b")), 6).alias("chance"),
        F.round(F.max(F.when(~hashed, gap)), 6).alias("gap"), F.round(F.sum(F.when(hashed, apart)) / 2, 6).alias("apart"))
    nulls = both.groupBy("column_name").agg(*[
        (F.sum(F.when((F.col("side") == s) & (F.col("part") == "nulls"), F.col("n")).otherwise(0))
         / F.sum(F.when((F.col("side") == s) & F.col("part").isin("nulls", "cells"), F.col("n")))).alias(f"nulls{s}")
        for s in (0, 1)])
    index = F.col("stability_index") - F.col("chance")
    level = F.when(index >= MAJOR, "MAJOR").when(index >= MODERATE, "MODERATE").otherwise("STABLE")
    return found.join(F.broadcast(nulls), "column_name").select(
        "column_name", "part", "stability_index", "chance", F.coalesce("gap", "apart").alias("distance"),
        F.round(F.col("nulls1") - F.col("nulls0"), 6).alias("null_change"), level.alias("level"))


class Baselines:
    """States kept as a Parquet table, one folder per name and batch (a day, a file, a run)."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def save(self, name: str, batch: str, state: DataFrame) -> None:
        """Keep a state; the state of the same batch is replaced."""
        state.select(*KEYS, "n").write.mode("overwrite").parquet(f"{self.root}/name={name}/batch={batch}")

    def load(self, name: str, batches: list[str] | None = None) -> DataFrame:
        """The merged state of all batches, or of the named ones; empty if there is none."""
        rows = self.batches(name)
        return merged(rows if batches is None else rows.where(F.col("batch").isin(batches)))

    def batches(self, name: str) -> DataFrame:
        """The states of all batches, with their batch."""
        reader = self.spark.read.schema(f"{STATE}, batch string").option("basePath", f"{self.root}/name={name}")
        try:
            return reader.parquet(f"{self.root}/name={name}")
        except AnalysisException as error:
            if "PATH_NOT_FOUND" in str(error.getCondition()):
                return self.spark.createDataFrame([], f"{STATE}, batch string")
            raise


def distinct_error() -> float:
    """Standard error of the distinct estimate."""
    return 1.04 / math.sqrt(REGISTERS)
