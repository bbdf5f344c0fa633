"""Append-only event log as a stream: each micro-batch is written once, however often it is run."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossweave.sources.readers import exists


def append_once(stream: DataFrame, target: str, checkpoint: str, name: str = "log", after: Callable[[DataFrame, int], None] | None = None) -> None:
    """Appends stream (with day) to target, and ends when all is read. A micro-batch goes to a folder of its number, source=name/batch=n,
    which is kept beside the rows: a batch that is run again, after a failure between its write and the stream's commit, finds its
    folder finished and writes nothing; one that was cut short is written anew. after(batch, n), if given, follows the write, for what
    may be done more than once, such as delivery to a service.
    """
    spark = stream.sparkSession

    def write(batch: DataFrame, number: int) -> None:
        at = f"{target}/source={name}/batch={number}"
        if not exists(spark, f"{at}/_SUCCESS"):
            batch.write.mode("overwrite").option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "true").partitionBy("day").parquet(at)
        if after:
            after(batch, number)

    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def append_events(spark: SparkSession, source: str, schema, target: str, checkpoint: str, name: str = "log", files: int | None = None, after: Callable[[DataFrame, int], None] | None = None) -> DataFrame:
    """Reads new files under source, `files` in a micro-batch (all unless given), derives the day, and appends to target once; ends when
    all is read. Returns the log, with source, batch and day."""
    stream = spark.readStream.schema(schema)
    stream = stream.option("maxFilesPerTrigger", files) if files else stream
    append_once(stream.parquet(source).withColumn("day", F.to_date("ts")), target, checkpoint, name, after)
    return spark.read.parquet(target)
