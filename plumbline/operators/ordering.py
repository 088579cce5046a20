"""Row numbers over a whole table and joins that stand hot keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..session import cut_lineage

# monotonically_increasing_id: task number in the upper bits, place in the task in the lower 33.
PLACE_BITS = 33
HOT_SHARE = 1_000


def with_row_number(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """Number all rows from 0 in the given order, in parallel.

    The rows are range-partitioned and sorted, written once (so that a lost executor cannot change
    the ranges) and numbered by the sizes of the partitions before theirs. Only the sizes, one
    number per partition, reach the driver. ``order`` must end in something nearly unique.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = cut_lineage(df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
                         .withColumn("__place", F.monotonically_increasing_id()))
    part = F.shiftright("__place", PLACE_BITS)
    sizes = placed.groupBy(part.alias("__part")).count().collect()
    start, starts = 0, []
    for row in sorted(sizes, key=lambda r: r["__part"]):
        starts.append((row["__part"], start))
        start += row["count"]
    offsets = spark.createDataFrame(starts, "__part bigint, __start bigint")
    place = F.col("__place").bitwiseAND(F.lit((1 << PLACE_BITS) - 1))
    return (placed.withColumn("__part", part)
            .join(F.broadcast(offsets), "__part")
            .withColumn(name, F.col("__start") + place)
            .drop("__place", "__part", "__start"))


def attach(df: DataFrame, key: str, found: DataFrame, values: list[str], rows: str) -> DataFrame:
    """Left-join ``found`` (one row per key, with its row count in ``rows``) to ``df``.

    Keys holding more than a thousandth of the rows of ``found``, a thousand at most, are broadcast, so
    no task gets a hot key's rows. The others are joined as Spark sees fit for their measured size.
    """
    total = found.agg(F.sum(rows)).first()[0] or 0
    wanted = found.select(F.col(f"`{key}`").alias("__key"), *values, rows)
    hot = wanted.where(F.col(rows) > total / HOT_SHARE).drop(rows).withColumn("__hot", F.lit(True))
    cold = wanted.where(F.col(rows) <= total / HOT_SHARE).drop(rows)
    marked = df.join(F.broadcast(hot), df[f"`{key}`"] == F.col("__key"), "left").drop("__key")
    done = marked.where(F.col(f"`{key}`").isNull() | F.col("__hot")).drop("__hot")
    rest = marked.where(F.col(f"`{key}`").isNotNull() & F.col("__hot").isNull()).drop("__hot", *values)
    joined = rest.join(cold, rest[f"`{key}`"] == F.col("__key"), "left").drop("__key")
    return done.unionByName(joined.select(*done.columns))
