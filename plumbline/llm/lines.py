"""Line dedup: lines that stand in many documents are dropped everywhere but in one.

Lines are exploded and normalised, their keys hashed, the distinct documents of each hash counted,
lines over the threshold dropped and the others put together again by position.

Only hashes, ids and positions meet in the counting shuffles. A line's key is known by two
independent 64-bit hashes. A row is known by its id and a hash of its text, so rows that share an id
keep their own positions, and equal rows have equal decisions.

Defined results: null and empty texts are one empty line, which is never dropped; rows with the same
id are one document when documents are counted; rows without an id count as no document and are never
the one that keeps a line; repeated rows come back as often as they came; an empty table gives an
empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import stored

LEAST_CHARS = 40        # code points of a key that can be dropped
LEAST_DOCUMENTS = 5     # documents that must hold it
#: Keys with more than this share of the occurrences of all repeated keys, a thousand at most, are hot.
HOT_SHARE = 1_000
BLANKS = " \t\n\u000b\u000c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SALT = 0x1D8AF066


def line_key(line: Column) -> Column:
    """The line without blanks at both ends, A-Z in lower case."""
    bare = F.btrim(line, F.lit(BLANKS))
    plain = F.octet_length(bare) == F.length(bare)          # ASCII only: lower() does the same, faster
    return F.when(plain, F.lower(bare)).otherwise(F.translate(bare, UPPER, LOWER))


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def occurrences(rows: DataFrame, least_chars: int) -> DataFrame:
    """(id, x, h1, h2, pos): the lines whose keys are long enough to be dropped."""
    held = rows.where(F.length("t") >= least_chars).select(
        "id", F.xxhash64("t").alias("x"), F.posexplode(_lines(F.col("t"))).alias("pos", "line"))
    keyed = (held.where(F.length("line") >= least_chars)
             .select("id", "x", "pos", line_key(F.col("line")).alias("key"))
             .where(F.length("key") >= least_chars))
    return keyed.select("id", "x", F.xxhash64("key").alias("h1"),
                        F.xxhash64(F.lit(SALT), "key").alias("h2"), "pos")


def repeated_keys(found: DataFrame, least_documents: int) -> DataFrame:
    """(h1, h2, keeper, rows): keys in enough documents, the largest id that holds each, and their lines.

    Counts are taken per key and document first, so a key that a third of all documents hold is
    counted by many tasks; the second count adds up partial counts.
    """
    per_document = found.groupBy("h1", "h2", "id").agg(F.count(F.lit(1)).alias("rows"))
    return (per_document.groupBy("h1", "h2")
            .agg(F.count("id").alias("documents"), F.max("id").alias("keeper"), F.sum("rows").alias("rows"))
            .where(F.col("documents") >= least_documents).drop("documents"))


def decisions(found: DataFrame, repeated: DataFrame) -> DataFrame:
    """(id, x, dropped): the positions of the lines that each row loses.

    The hottest keys, a thousand at most, are broadcast; all others meet the lines in a shuffle in
    which no key has more than a thousandth of the rows.
    """
    total = repeated.agg(F.sum("rows")).first()[0] or 0
    hot = F.col("rows") > total / HOT_SHARE
    keys = ["h1", "h2"]
    marked = found.join(F.broadcast(repeated.where(hot).drop("rows")), keys, "left")
    done = marked.where("keeper IS NOT NULL")
    rest = (marked.where("keeper IS NULL").drop("keeper")
            .join(repeated.where(~hot).drop("rows"), keys))
    return (done.unionByName(rest).where(~F.col("id").eqNullSafe(F.col("keeper")))
            .groupBy("id", "x").agg(F.collect_set("pos").alias("dropped")))


def dedup(docs: DataFrame, id_column: str = "doc_id", text: str = "text", least_chars: int = LEAST_CHARS,
          least_documents: int = LEAST_DOCUMENTS) -> DataFrame:
    """(id, n_lines, n_dropped, kept): every text without the lines that many documents share.

    A key of at least ``least_chars`` code points that stands in at least ``least_documents`` documents
    loses all its lines, but for those in the largest id that holds it.
    """
    rows = docs.select(F.col(id_column).alias("id"), F.col(text).alias("t"))
    found = stored(occurrences(rows, least_chars))
    repeated = stored(repeated_keys(found, least_documents))
    lost = decisions(found, repeated).withColumnsRenamed({"id": "i", "x": "y"})
    whole = rows.withColumn("x", F.xxhash64("t"))
    joined = whole.join(lost, whole["id"].eqNullSafe(lost["i"]) & (whole["x"] == lost["y"]), "left")
    lines, gone = F.col("lines"), F.col("dropped")
    places = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone)
    kept = F.array_join(F.transform(places, lambda i: F.get(lines, i)), "\n")
    return (joined.withColumn("lines", _lines(F.col("t")))
            .select(F.col("id").alias(id_column), F.size(lines).cast("long").alias("n_lines"),
                    F.when(gone.isNull(), 0).otherwise(F.size(gone)).cast("long").alias("n_dropped"),
                    F.when(gone.isNull(), F.coalesce("t", F.lit(""))).otherwise(kept).alias("kept")))


def digests(kept: DataFrame) -> DataFrame:
    return kept.withColumn("kept_sha256", F.sha2(F.col("kept").cast("binary"), 256)).drop("kept")
