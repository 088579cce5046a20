"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks.

Slot i of the schedule goes to the source in whose share of [0, 1) the point frac(i * golden ratio)
falls, so every stretch of the schedule holds the sources in nearly their target shares. Each
source's documents, in shuffled order, form a stream that is cut into blocks of equal size; the r-th
slot of a source takes the r-th block of its stream, which begins anew after its end.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from .common import stored

GOLDEN = 0.6180339887498949
WEIGHTS = (1, 2, 3)
REPEATS = 3             # a source gives at most this many times its size
BLOCK = 1024            # words per block
STEP = 4096             # slots per chunk when ranks are counted
BUCKETS = 256           # parts of a source's stream when offsets are counted


def sizes(docs: DataFrame, id_column: str = "doc_id", text: str = "text",
          source: str = "source") -> DataFrame:
    """(id, source, size): size counts ``[^\\x20\\x09-\\x0D]+`` in the text, 0 for null."""
    gap = r"[\x20\x09-\x0D]+"
    bare = F.regexp_replace(F.col(text), rf"^{gap}|{gap}$", "")
    words = F.when(F.length(bare) > 0, F.size(F.split(bare, gap))).otherwise(0)
    return docs.select(F.col(id_column).alias("id"), F.col(source).alias("source"),
                       F.coalesce(words, F.lit(0)).cast("long").alias("size"))


def targets(sized: DataFrame, weights: tuple = WEIGHTS, repeats: int = REPEATS) -> DataFrame:
    """(source, source_size, target, quota), one row per source.

    Sources in code-point order, null last, weigh ``weights`` in turn and share the total. A target
    above ``repeats`` times the source's size is cut to it and the excess shared again: with the
    sources ordered by limit per weight, those cut are the first whose limits per weight lie below
    what the others then get. ``quota`` is the target in whole words.
    """
    whole = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.asc_nulls_last("source"))
    turn = F.array(*[F.lit(float(w)) for w in weights])
    rows = (whole.withColumn("weight", F.element_at(
        turn, ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")))
        .withColumn("limit", F.col("source_size") * float(repeats)))
    ratio = Window.orderBy(F.col("limit") / F.col("weight"), F.asc_nulls_last("source"))
    until, everyone = ratio.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    rows = (rows.withColumn("left", F.sum("source_size").over(everyone).cast("double")
                            - F.coalesce(F.sum("limit").over(until), F.lit(0.0)))
            .withColumn("others", F.sum("weight").over(everyone)
                        - F.coalesce(F.sum("weight").over(until), F.lit(0.0)))
            .withColumn("level", F.when(F.col("left") / F.col("others") * F.col("weight") <= F.col("limit"),
                                        F.col("left") / F.col("others"))))
    level = F.max("level").over(everyone)
    rows = rows.withColumn("target", F.least(
        "limit", F.coalesce(level * F.col("weight"), F.col("limit"))))
    return rows.select("source", "source_size", "target",
                       F.floor(F.col("target") + 1e-6).cast("long").alias("quota"))


def schedule(aims: DataFrame, block: int = BLOCK) -> DataFrame:
    """(slot, source, r): the order in which sources give their blocks, r from 0 per source.

    Slots beyond a source's quota are left out; the few slots that the points leave short (the
    discrepancy grows with the logarithm of the length) follow at the end.
    """
    spark = aims.sparkSession
    need = aims.where(F.col("quota") > 0).withColumn("slots", F.ceil(F.col("quota") / block))
    before = Window.orderBy(F.asc_nulls_last("source"))
    every = Window.partitionBy()
    need = (need.withColumn("high", F.sum("slots").over(before) / F.sum("slots").over(every))
            .withColumn("low", (F.sum("slots").over(before) - F.col("slots")) / F.sum("slots").over(every))
            .select("source", "slots", "low", "high"))
    total = need.agg(F.sum("slots")).first()[0] or 0
    tasks = max(1, min(total // 50_000 + 1, 100_000))
    points = spark.range(0, total, 1, tasks).select(
        F.col("id").alias("slot"), F.floor(F.col("id") / STEP).alias("chunk"),
        (F.col("id") * GOLDEN - F.floor(F.col("id") * GOLDEN)).alias("p"))
    cell = F.floor(F.col("p") * 1024)
    wide = need.withColumn("cell", F.explode(F.sequence(
        F.floor(F.col("low") * 1024), F.least(F.floor(F.col("high") * 1024), F.lit(1023)))))
    placed = (points.withColumn("cell", cell).join(wide, "cell")
              .where((F.col("p") >= F.col("low")) & (F.col("p") < F.col("high")))
              .select("slot", "chunk", "source", "slots"))
    key = F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n"))
    placed = placed.withColumn("s", key)
    counts = placed.groupBy("s", "chunk").agg(F.count(F.lit(1)).alias("n"))
    # Chunk counts are summed in two levels, so that no task holds all chunks of a source.
    far = counts.withColumn("part", F.floor(F.col("chunk") / STEP))
    parts = far.groupBy("s", "part").agg(F.sum("n").alias("m"))
    parts = parts.withColumn("ahead", F.sum("m").over(
        Window.partitionBy("s").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)))
    starts = far.withColumn("near", F.sum("n").over(
        Window.partitionBy("s", "part").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)))
    starts = starts.join(parts.drop("m"), ["s", "part"]).select(
        "s", "chunk", (F.coalesce("ahead", F.lit(0)) + F.coalesce("near", F.lit(0))).alias("first"))
    ranked = (placed.withColumn("nth", F.row_number().over(
        Window.partitionBy("s", "chunk").orderBy("slot")) - 1)
        .join(starts, ["s", "chunk"])
        .withColumn("r", F.col("first") + F.col("nth")))
    given = ranked.where(F.col("r") < F.col("slots")).select("slot", "source", "r")
    made = counts.groupBy("s").agg(F.sum("n").alias("made"))
    short = (need.withColumn("s", key).join(made, "s", "left")
             .withColumn("made", F.coalesce("made", F.lit(0)))
             .where(F.col("made") < F.col("slots"))
             .withColumn("end", total + F.sum(F.col("slots") - F.col("made")).over(before))
             .withColumn("r", F.explode(F.sequence("made", F.col("slots") - 1)))
             .select((F.col("end") - F.col("slots") + F.col("r")).alias("slot"), "source", "r"))
    return given.unionByName(short)


def streams(sized: DataFrame) -> DataFrame:
    """(id, source, size, begin): each document's first word in its source's shuffled stream.

    The shuffle orders documents by a digest of their ids. Offsets are summed within ``BUCKETS``
    parts of a stream and over the parts, so a hot source is spread over many tasks.
    """
    digest = F.md5(F.coalesce(F.col("id").cast("string"), F.lit("")).cast("binary"))
    key = F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n"))
    rows = (sized.withColumn("s", key).withColumn("order", digest)
            .withColumn("bucket", F.substring("order", 1, 2)))
    parts = rows.groupBy("s", "bucket").agg(F.sum("size").alias("m"))
    parts = parts.select("s", "bucket", F.coalesce(F.sum("m").over(
        Window.partitionBy("s").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)),
        F.lit(0)).alias("ahead"))
    near = F.coalesce(F.sum("size").over(
        Window.partitionBy("s", "bucket").orderBy("order", "id", "size")
        .rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return (rows.withColumn("near", near).join(parts, ["s", "bucket"])
            .select("id", "source", "s", "size", (F.col("ahead") + F.col("near")).alias("begin")))


def slot_parts(rows: DataFrame, aims: DataFrame, block: int = BLOCK) -> DataFrame:
    """(slot, at, s, begin, id, source, first, end): the words of each document that a slot takes.

    ``first`` and ``end`` (exclusive) count words of the document, ``at`` is the place of the first
    of them in the slot. A document of a small source can come in a slot once per round.
    """
    key = F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n"))
    slots = (schedule(aims, block).withColumn("s", key)
             .join(aims.withColumn("s", key).select("s", "source_size", "quota"), "s")
             .withColumn("from", F.col("r") * block)
             .withColumn("to", F.least((F.col("r") + 1) * block, "quota")))
    # A slot covers part of one round of the stream or of several.
    rounds = F.sequence(F.floor(F.col("from") / F.col("source_size")),
                        F.floor((F.col("to") - 1) / F.col("source_size")))
    cover = (slots.withColumn("round", F.explode(rounds))
             .withColumn("base", F.col("round") * F.col("source_size") - F.col("from"))
             .withColumn("a", F.greatest(-F.col("base"), F.lit(0)))
             .withColumn("b", F.least(F.col("to") - F.col("round") * F.col("source_size"), "source_size"))
             .withColumn("block", F.explode(F.sequence(F.floor(F.col("a") / block),
                                                       F.floor((F.col("b") - 1) / block))))
             .select("s", "block", "slot", "base", "a", "b"))
    pieces = (rows.where(F.col("size") > 0)
              .withColumn("block", F.explode(F.sequence(
                  F.floor(F.col("begin") / block),
                  F.floor((F.col("begin") + F.col("size") - 1) / block)))))
    first = F.greatest("a", "begin", F.col("block") * block)
    end = F.least("b", F.col("begin") + F.col("size"), (F.col("block") + 1) * block)
    # A document's parts in two blocks that one slot covers are one part.
    return (pieces.join(cover, ["s", "block"]).withColumn("first", first).withColumn("end", end)
            .where("first < end").groupBy("slot", "base", "s", "begin", "id", "source")
            .agg(F.min("first").alias("first"), F.max("end").alias("end"))
            .select("slot", (F.col("base") + F.col("first")).alias("at"), "s", "begin", "id", "source",
                    (F.col("first") - F.col("begin")).alias("first"),
                    (F.col("end") - F.col("begin")).alias("end")))


def mixed(docs: DataFrame, id_column: str = "doc_id", text: str = "text", source: str = "source",
          weights: tuple = WEIGHTS, repeats: int = REPEATS, block: int = BLOCK) -> DataFrame:
    """The mix itself, (slot, at, id, source, first_word, end_word): ordered by slot and at, the word
    ranges are the mixed stream. ``end_word`` is exclusive. See ``mix`` for odd rows."""
    sized = stored(sizes(docs, id_column, text, source))
    aims = stored(targets(sized, weights, repeats))
    return slot_parts(streams(sized), aims, block).select(
        "slot", "at", F.col("id").alias(id_column), F.col("source").alias(source),
        F.col("first").alias("first_word"), F.col("end").alias("end_word"))


def mix(docs: DataFrame, id_column: str = "doc_id", text: str = "text", source: str = "source",
        weights: tuple = WEIGHTS, repeats: int = REPEATS, block: int = BLOCK) -> DataFrame:
    """(id, source, size, source_size, target, taken): how many words of each document the mix takes.

    The words are summed over the mix (``mixed``). Slot r of a source covers the words [r * block,
    (r + 1) * block) of the source's stream, cut at its quota; the stream repeats, so a document is
    taken once per round, at most ``repeats`` times. The sum per source is its quota. Null texts
    and texts without words have size 0 and are not taken; a null source is a source of its own.
    Repeated rows are documents of their own, ties in the shuffle go by id and size. An empty table
    gives an empty one; other columns are ignored.
    """
    sized = stored(sizes(docs, id_column, text, source))
    aims = stored(targets(sized, weights, repeats))
    key = F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n"))
    rows = streams(sized)
    taken = (slot_parts(rows, aims, block).groupBy("s", "begin")
             .agg(F.sum(F.col("end") - F.col("first")).alias("taken")))
    # Documents with words begin at different places of their source's stream.
    place = F.when(F.col("size") > 0, F.col("begin"))
    return (rows.withColumn("place", place)
            .join(taken.withColumnRenamed("begin", "place"), ["s", "place"], "left")
            .join(aims.withColumn("s", key).select("s", "source_size", "target"), "s")
            .select(F.col("id").alias(id_column), F.col("source").alias(source), "size",
                    "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken")))
