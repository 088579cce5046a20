"""Training-data pipeline: documents in, piece ids out.

Each stage is (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame. All
but the last return the columns of ``documents``; extra columns are dropped. Every stage reads what
its predecessor wrote.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from plumbline.llm import mixing, near_dups, personal_data, quality, sentencepieces
from plumbline.llm.common import read, stored

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality grade is likely the highest (operator 10)."""
    model = quality.train(docs, quality.ratings_of(read(spark, sf_dir, "labels")))
    carried = docs.select("doc_id", "lang", "source", "n_chars", F.col("text").alias("value"), "text")
    graded = quality.grade(carried, model, carry=["lang", "source", "n_chars", "value"])
    return graded.where("selected").withColumnRenamed("value", "text").select(*COLUMNS)


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group (operator 9): the one with the smallest id.

    Groups link texts whose sets of five-word shingles have a similarity of 0.8 or more. Documents without an id are in no group and stay.
    """
    groups = near_dups.groups(docs, words=5).where("kept").select(F.col("doc_id").alias("id")).distinct()
    docs = docs.select(*COLUMNS)
    return (docs.join(groups, docs["doc_id"] == groups["id"], "left_semi")
            .unionByName(docs.where("doc_id IS NULL")))


def private_data_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by its kind in brackets (operator 6); n_chars follows the text."""
    done = personal_data.redact(docs.select(*COLUMNS))
    return done.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix (operator 7): a document comes once for each round that takes words of it, whole;
    documents of which the mix takes no words are left out."""
    taken = mixing.mix(docs).where("taken > 0").select(
        F.col("doc_id").alias("id"), F.ceil(F.col("taken") / F.col("size")).cast("int").alias("times"))
    taken = taken.groupBy("id").agg(F.max("times").alias("times"))
    docs = docs.select(*COLUMNS)
    return (docs.join(taken, docs["doc_id"].eqNullSafe(taken["id"]))
            .withColumn("copy", F.explode(F.sequence(F.lit(1), "times"))).select(*COLUMNS))


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every document, with digests of the ids and of the decoded text (operator 5)."""
    return sentencepieces.digests(sentencepieces.encode(docs))


STAGES = [("quality", good_documents), ("near_duplicates", distinct_documents),
          ("personal_data", private_data_out), ("mix", mixed_sources), ("pieces", pieces)]

#: Models and hashing are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
