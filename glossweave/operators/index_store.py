"""An index that is kept beside its source: of a folder's files only those that are new or have changed are read again."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossweave.sources.readers import exists, source_key


def versions(spark: SparkSession, path: str) -> dict[str, str]:
    """file: version (of its path and time of change) for a file, or each file right inside a folder but hidden ones; none if it is missing."""
    if not exists(spark, path):
        return {}
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = at.getFileSystem(spark._jsc.hadoopConfiguration())
    files = [s.getPath().toString() for s in store.listStatus(at) if s.isFile() and s.getPath().getName()[:1] not in "._"]
    return {f: hashlib.sha1("\0".join(map(str, source_key(spark, f))).encode()).hexdigest() for f in files}


def kept_index(spark: SparkSession, path: str, folder: str, build: Callable[[DataFrame], DataFrame], schema: str) -> DataFrame:
    """file and the columns of schema: the index of the text files at path, which is kept in folder.

    build takes lines (file, line: its number in the file from 0, value) and returns file and the columns of schema; a line's entries
    may not depend on other files. Each file's part is a folder named by its version. Parts of changed and missing files are
    removed after new ones are written, so a run that fails leaves what was there and the next run does what is left. A missing
    path has no rows.
    """
    now = versions(spark, path)
    new = {f: v for f, v in now.items() if not exists(spark, f"{folder}/version={v}/_done")}
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    root = jvm.org.apache.hadoop.fs.Path(folder)
    store = root.getFileSystem(conf)
    if new:
        named = F.create_map(*[F.lit(x) for kv in new.items() for x in kv])
        lines = spark.read.text(list(new)).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_b"), "value", F.monotonically_increasing_id().alias("_m"))
        # a file that several tasks read is numbered by its splits
        ends = lines.groupBy("file", "_b").agg(F.count(F.lit(1)).alias("_n"), F.min("_m").alias("_low")).alias("e")
        earlier = ends.select("file", F.col("_b").alias("_ob"), F.col("_n").alias("_on"))
        starts = ends.join(earlier, "file").groupBy("file", "_b").agg(F.sum(F.when(F.col("_ob") < F.col("_b"), F.col("_on")).otherwise(0)).alias("_s"), F.first("_low").alias("_low"))
        at = lines.join(starts, ["file", "_b"]).select("file", (F.col("_m") - F.col("_low") + F.col("_s")).alias("line"), "value")
        rows = build(at).withColumn("version", named[F.col("file")])
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("version").parquet(folder)
        for v in new.values():
            # a file without entries has a part too
            store.mkdirs(jvm.org.apache.hadoop.fs.Path(f"{folder}/version={v}"))
            store.create(jvm.org.apache.hadoop.fs.Path(f"{folder}/version={v}/_done"), True).close()
    if store.exists(root):
        for s in store.listStatus(root):
            if s.getPath().getName().startswith("version=") and s.getPath().getName()[8:] not in now.values():
                store.delete(s.getPath(), True)
    wanted = f"file string, {schema}"
    if not now:
        return spark.createDataFrame([], wanted)
    return spark.read.schema(f"{wanted}, version string").parquet(folder).filter(F.col("version").isin(list(now.values()))).drop("version")
