"""The corpus pipeline: toxicity, near-duplicates, repeated passages, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenlake.llm import packing, simhash, substrings, toxicity
from lumenlake.llm.common import materialize, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity operator rejects (score 0.5 or more) go."""
    model = toxicity.learn(docs, table(spark, sf_dir, "labels"))
    return toxicity.clean(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of linked fingerprints one row stays, with the smallest doc_id; so do rows without an id.

    The ids that go are the smaller side. Nothing bounds their number, so they are not broadcast. Of rows that repeat with their id
    one stays; rows of one id with different texts stay or go together. Rows without an id pass by, so that they don't meet in one task.
    """
    found = simhash.near_duplicates(spark, docs).where("doc_id is not null").groupBy("doc_id").agg(F.every(F.col("doc_id") != F.col("component_id")).alias("goes"))
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("h"))
    kept = row.where("id is not null").join(found.where("goes").select(F.col("doc_id").alias("id")).hint("merge"), "id", "left_anti")
    first = F.row_number().over(Window.partitionBy("id", "h").orderBy("h"))
    kept = kept.withColumn("nth", first).where("nth = 1").select("row").unionByName(row.where("id is null").select("row"))
    return kept.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that repeat an earlier document's go from the text; every document stays."""
    return substrings.remove(spark, docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(spark, docs)


STAGES = [("toxicity", drop_toxic), ("near_duplicates", drop_near_duplicates), ("substrings", cut_repeats), ("packing", pack)]

#: Neither the learned score nor packing can be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
