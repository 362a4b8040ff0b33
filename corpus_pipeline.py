"""A training-data pipeline: five stages, each an operator whose decisions take effect.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last have the columns
of documents. Nulls, empty and repeated rows are treated as the operators say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkflow.llm import decontaminate, langid, mixing, sharding, similar
from inkflow.llm.common import Stored, documents, row_key, rows_of, store, table


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """``docs`` without the rows that (id, key) name; key is ``row_key``."""
    return docs.withColumn("__key", row_key()).join(Stored(gone).small(), F.expr("__key = key and doc_id <=> id"), "left_anti").select(*docs.columns)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a letter, and those that resemble none of the languages learnt."""
    return without(docs, langid.rejected(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the first document of each group of near-duplicates: five-word shingles, similarity 0.8 or more."""
    groups = similar.groups(docs)
    first = groups.where("doc_id <=> first_id and k = first_k").groupBy(F.col("doc_id").alias("id"), F.col("k").alias("key")).agg(F.count("*").alias("m"))
    return rows_of(docs, first).select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a window of a benchmark item, however small a part of them it is."""
    found = decontaminate.contamination(docs, table(spark, sf_dir, "benchmark"))
    return without(docs, found.where("n_hit > 0").select(F.col("doc_id").alias("id"), F.col("k").alias("key")).distinct())


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or leaves out documents, so that sources have their target sizes."""
    taken = mixing.mix(docs).groupBy(F.col("doc_id").alias("id"), F.col("k").alias("key")).agg(F.count("*").alias("m"), F.sum("copies").alias("copies")).where("copies > 0")
    return rows_of(docs, taken.select("id", "key", "m", F.expr("sequence(1L, copies)").alias("times"))).withColumn("times", F.explode("times")).select(*docs.columns)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Gives every document its shard and slot; the result has the columns of op7_sharding."""
    return sharding.sharded(docs)


STAGES = [("language_id", language_id), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("mixing", mixture), ("sharding", shards)]
#: The stages learn prototypes and iterate; SQL can't express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = documents(spark, sf_dir)
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = store(docs)
    return docs
