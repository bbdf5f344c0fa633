"""The folder that driver and executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

_marked: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where it is unset, a folder in the warehouse. The session's settings stay as they are."""
    return spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_scratch"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the application's part of the shared folder, which goes when the application ends."""
    root = f"{shared_dir(spark).rstrip('/')}/glossweave-{spark.sparkContext.applicationId}"
    if root not in _marked:
        at = spark._jvm.org.apache.hadoop.fs.Path(root)
        store = at.getFileSystem(spark._jsc.hadoopConfiguration())
        store.mkdirs(at)
        store.deleteOnExit(at)
        _marked.add(root)
    return f"{root}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df, written to the shared folder and read back: what several later steps read is worked out once."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dealt(rows: DataFrame) -> DataFrame:
    """rows in no order over four tasks for each core: for work that is costly by row, on a table that may be one small file,
    which is one task."""
    return rows.repartition(4 * rows.sparkSession.sparkContext.defaultParallelism)
