"""Streaming forms of the engine's stages."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def run(stream: DataFrame, plan: Callable[[DataFrame], DataFrame], checkpoint: str, function: Callable[[DataFrame, int], None], available_now: bool = True) -> StreamingQuery:
    """Plans each micro-batch and gives the result to the function.

    The source's file limit is the back-pressure; with ``available_now`` the query ends when all
    files that are there have been read. The checkpoint makes a restart go on after the last batch."""
    writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda batch, number: function(plan(batch), number))
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def stage_times(stream: DataFrame, stage: str, ms: str) -> DataFrame:
    """Running totals of time by stage of a stream."""
    return stream.groupBy(stage).agg(F.sum(ms).alias("total"), F.count("*").alias("steps"))


def stream_table(spark: SparkSession, path: str, files_per_batch: int = 1) -> DataFrame:
    """A Parquet table, a file or a folder of files, as a stream of its files."""
    exactly = f"{path[:-1]}[{path[-1]}]"  # the source takes a single file only by a pattern
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files_per_batch).parquet(exactly)
