"""Repeated rows, repeated ids and nearly equal neighbours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import fixed_values as fv, text
from ..session import cut_lineage, stored
from .ordering import attach, with_row_number
from .rule import graded
from .similar import SimilarValues, nearly_equal
from .table import Table


SALT = 0x2545F491       # start of the second hash of a row
LEAST_VALUES = 10       # fewer values are not compared


def wide_hash(*values: Column) -> list[Column]:
    """Two independent 64-bit hashes of the values; a null differs from every value."""
    cells = [x for v in values for x in (v, v.isNull())]
    return [F.xxhash64(*cells).alias("__h1"), F.xxhash64(F.lit(SALT), *cells).alias("__h2")]


def repeated_rows(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One row: total_rows, duplicate_rows (copies after the first), unique_rows, rate.

    Rows are grouped by a 128-bit hash of their content, so the shuffle carries sixteen bytes and a
    count per row, after partial counts.
    """
    cells = [F.col(f"`{c}`") for c in columns or df.columns]
    counts = df.select(*wide_hash(*cells)).groupBy("__h1", "__h2").count()
    n, copies = F.col("total_rows"), F.col("duplicate_rows")
    return counts.agg(
        F.coalesce(F.sum("count"), F.lit(0)).alias("total_rows"),
        F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("duplicate_rows")).select(
        n, copies, (n - copies).alias("unique_rows"),
        F.when(n > 0, F.round((1 - copies / n) * 100, 2)).otherwise(100.0).alias("uniqueness_rate"))


def id_columns(table: Table) -> list[str]:
    return [c for c in table.columns if c.lower() == "id" or c.lower().endswith("_id")]


PREFIX = 16     # characters of a value that travel with its count


def _values(table: Table, columns: list[str]) -> DataFrame:
    """(column_name, value) of the non-null values of several columns."""
    texts = table.df.select(*[table.col(c).cast("string").alias(c) for c in columns])
    return (texts.unpivot([], [f"`{c}`" for c in columns], "column_name", "value")
            .where(F.col("value").isNotNull()))


def value_counts(table: Table, columns: list[str]) -> DataFrame:
    """(column_name, __h1, __h2, prefix, rows): one row per non-null value of several columns.

    Values are grouped by a 128-bit hash and stay where they are: only the hash, a count and the first
    characters are shuffled, after partial counts.
    """
    return (_values(table, columns)
            .groupBy("column_name", *wide_hash(F.col("value")))
            .agg(F.first(F.substring("value", 1, PREFIX)).alias("prefix"), F.count(F.lit(1)).alias("rows")))


def repeat_counts(table: Table, columns: list[str]) -> DataFrame:
    """(column_name, rows): one row per non-null value of several columns, without the value."""
    return (_values(table, columns).groupBy("column_name", *wide_hash(F.col("value")))
            .agg(F.count(F.lit(1)).alias("rows")).select("column_name", "rows"))


def top_counts(table: Table, columns: list[str], size: int, least: int = 1) -> DataFrame:
    """(column_name, value, rows, place): the ``size`` most frequent values of each column that at least
    ``least`` rows hold, the smallest first on ties.

    The text of a value is fetched only for values that can be among them by count and first characters.
    Each task passes on one text per such value.
    """
    counts = stored(value_counts(table, columns).where(F.col("rows") >= least))
    # Counts and first characters in order: as many of them as values are wanted, so a few rows.
    level = F.row_number().over(Window.partitionBy("column_name").orderBy(F.desc("rows"), F.asc("prefix")))
    levels = (counts.select("column_name", "rows", "prefix").distinct().withColumn("__level", level)
              .where(F.col("__level") <= size).drop("__level"))
    wanted = stored(counts.join(F.broadcast(levels), ["column_name", "rows", "prefix"], "left_semi")
                    .select("column_name", "__h1", "__h2", "rows"))
    keys = ["column_name", "__h1", "__h2"]
    texts = (_values(table, columns).select("column_name", "value", *wide_hash(F.col("value")))
             .join(wanted.select(*keys), keys, "left_semi").groupBy(*keys).agg(F.first("value").alias("value")))
    place = F.row_number().over(Window.partitionBy("column_name").orderBy(F.desc("rows"), F.asc("value")))
    return (texts.join(wanted, keys).withColumn("place", place).where(F.col("place") <= size)
            .select("column_name", "value", "rows", "place"))


def listed(top: DataFrame) -> DataFrame:
    """(column_name, sample_values): the values of ``top_counts`` in their order."""
    return (top.groupBy("column_name")
            .agg(F.array_sort(F.collect_list(F.struct("place", "value"))).alias("s"))
            .select("column_name", F.transform("s", lambda s: s["value"]).alias("sample_values")))


def top_values(counts: DataFrame, size: int) -> DataFrame:
    """(column_name, sample_values) from (column_name, value, rows): the most frequent values, smallest
    first on ties. The rank filter is applied per task before the shuffle."""
    place = F.row_number().over(Window.partitionBy("column_name")
                                .orderBy(F.desc("rows"), F.asc("value")))
    return listed(counts.withColumn("place", place).where(F.col("place") <= size))


def copies(table: Table) -> DataFrame:
    """(__h, first, rows): the rows that occur more than once, by the hash of their values, with the first
    row key. Only hashes and keys are shuffled."""
    cells = [F.col(f"`{c}`") for c in table.columns]
    key = table.row_key[0]
    return stored(table.df.select(F.struct(*wide_hash(*cells)).alias("__h"), F.col(f"`{key}`").alias("__key"))
                  .groupBy("__h").agg(F.count(F.lit(1)).alias("rows"), F.min("__key").alias("first"))
                  .where(F.col("rows") > 1))


def without_copies(table: Table) -> DataFrame:
    """The rows of the table less those that copy a row with a smaller key.

    Rows are told by the hash of their values. The few groups that have copies meet the rows: hot ones
    by broadcast, the others as Spark sees fit for their size, so rows move only if very many differ.
    """
    cells = [F.col(f"`{c}`") for c in table.columns]
    marked = table.df.withColumn("__h", F.struct(*wide_hash(*cells)))
    joined = attach(marked, "__h", copies(table), ["first"], "rows")
    key = F.col(f"`{table.row_key[0]}`")
    return joined.where(F.col("first").isNull() | key.eqNullSafe(F.col("first"))).select(
        *[f"`{c}`" for c in table.df.columns])


def copy_rows(table: Table) -> DataFrame:
    """(row key,): the rows that copy a row with a smaller key; only hashes and keys are joined."""
    cells = [F.col(f"`{c}`") for c in table.columns]
    marked = table.df.select(*table.row_key, F.struct(*wide_hash(*cells)).alias("__h"))
    joined = attach(marked, "__h", copies(table), ["first"], "rows")
    return joined.where(F.col(f"`{table.row_key[0]}`") > F.col("first")).select(*table.row_key)


def repeated_ids(table: Table, columns: list[str] | None = None) -> DataFrame:
    """(column_name, affected_rows, repeated_values): rows whose id occurs more than once."""
    columns = columns or id_columns(table)
    if not columns:
        return table.df.sparkSession.createDataFrame(
            [], "column_name string, affected_rows bigint, repeated_values bigint")
    return (repeat_counts(table, columns).where(F.col("rows") > 1)
            .groupBy("column_name").agg(F.sum("rows").alias("affected_rows"),
                                        F.count(F.lit(1)).alias("repeated_values")))


def repeated_id_rows(table: Table, column: str) -> DataFrame:
    """(row key, value): every row whose id occurs more than once; hot ids are broadcast."""
    counts = cut_lineage(table.df.where(F.col(f"`{column}`").isNotNull()).groupBy(f"`{column}`")
                         .agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > 1)
                         .withColumn("again", F.lit(True)))
    keys = table.df.select(*table.row_key, f"`{column}`")
    return (attach(keys, column, counts, ["again"], "rows").where(F.col("again"))
            .select(*table.row_key, F.col(f"`{column}`").alias("value")))


def similar_columns(table: Table) -> list[str]:
    """All text columns whose names tell of names or labels; id columns are no similar text."""
    keys = set(id_columns(table))
    return [c for c in table.texts if text.contains_any(c, fv.SIMILAR_TEXT_WORDS) and c not in keys]


def similar_neighbours(table: Table, column: str, threshold: float = 90.0, window: int = 19,
                       block: int = 20_000) -> DataFrame:
    """(left_key, right_key, left_value, right_value, ratio) of nearly equal neighbours (parity).

    Values are taken in row-key order and each is compared with the ``window`` values after it,
    over the whole table. Rows are numbered in parallel and cut into blocks; each block also gets
    the first rows of the next, so the comparison is a set of leads inside a block and every row
    meets the same neighbours wherever the cuts fall. Pairs whose lengths or edit distance rule
    out the threshold are dropped before the comparison in Python.
    """
    key = table.row_key[0]
    values = (table.df.where(F.col(f"`{column}`").isNotNull())
              .select(F.col(f"`{key}`").alias("k"), F.col(f"`{column}`").alias("v")))
    numbered = with_row_number(values, ["k", "v"], "n")
    home = F.floor(F.col("n") / block)
    carried = (F.col("n") % block < window) & (F.col("n") >= block)
    copies = F.when(carried, F.array(home, home - 1)).otherwise(F.array(home))
    spread = numbered.withColumn("home", home).withColumn("block", F.explode(copies))
    order = Window.partitionBy("block").orderBy("n")
    after = F.collect_list(F.struct("k", "v")).over(order.rowsBetween(1, window))
    pairs = (spread.withColumn("after", after).where(F.col("block") == F.col("home"))
             .select("k", "v", F.explode("after").alias("o"))
             .select("k", "v", F.col("o.k").alias("k2"), F.col("o.v").alias("v2")))
    return (nearly_equal(pairs, threshold)
            .select(F.col("k").alias("left_key"), F.col("k2").alias("right_key"),
                    F.col("v").alias("left_value"), F.col("v2").alias("right_value"), "ratio"))


def similar_pairs_issue(table: Table, column: str, total: int, threshold: float = 90.0,
                        first: int = 0, window: int | None = None) -> DataFrame | None:
    """Issue of the rows that are in any pair; none for a column of fewer than ten values.

    With ``window`` (parity), only values so near in row-key order are compared.
    """
    if table.df.agg(F.count(table.col(column))).first()[0] < LEAST_VALUES:
        return None
    if window:
        pairs = similar_neighbours(table, column, threshold, window)
        rows = pairs.select(F.explode(F.array("left_key", "right_key")).alias("k")).distinct()
        counted = rows.agg(F.count(F.lit(1)).alias("affected_rows"))
    else:
        found = SimilarValues(table, column, threshold)
        counted = (found.values.join(found.linked(), "h", "left_semi")
                   .agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("affected_rows")))
    facts = counted.select(
        F.lit(column).alias("column_name"), "affected_rows", F.lit(total).alias("base"))
    return graded(facts, "uniqueness", "near_duplicates", severity="MEDIUM", risk="HIGH",
                  fix="fuzzy_deduplication", text="nearly equal values", first=first)


def uniqueness_issues(table: Table, total: int, first: int = 0, only: set[str] | None = None) -> DataFrame:
    """Issues for repeated rows and repeated ids; of the ids, ``only`` those of these columns."""
    copies = repeated_rows(table.df, table.columns).select(
        F.lit("ALL").alias("column_name"), F.col("duplicate_rows").alias("affected_rows"),
        F.col("total_rows").alias("base"))
    found = graded(copies, "uniqueness", "exact_duplicates", risk="HIGH", fix="drop_duplicates",
                   text="copies of another row", first=first)
    names = id_columns(table)
    columns = [c for c in names if only is None or c in only]
    if not columns:
        return found
    facts = repeated_ids(table, columns).select("column_name", "affected_rows")
    facts = (facts.join(F.broadcast(listed(top_counts(table, columns, 5, least=2))), "column_name")
             .withColumn("base", F.lit(total)))
    ids = graded(facts, "uniqueness", "duplicate_ids", risk="HIGH", fix="deduplicate_ids",
                 text="rows with a repeated id", first=first + 1)
    position = F.array_position(F.array(*map(F.lit, names)), F.col("column_name"))
    ids = ids.withColumn("issue_no", (F.lit(first) + position).cast("int"))
    return found.unionByName(ids)
