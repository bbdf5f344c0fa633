"""Helpers shared by the training-data operators: scratch tables, gapless ranks, Arrow access."""

from __future__ import annotations

import ctypes
import gc
import os
from collections.abc import Callable, Iterator
from contextlib import contextmanager, suppress

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glossweave.sources.shared import scratch_path

#: The characters that part words: space and \t \n \x0b \x0c \r.
WORD = r"[^\x20\x09-\x0D]+"


#: Scratch tables need no mark of success: one that was not written whole raises. Each mark is two files of the driver.
NO_MARK = {"mapreduce.fileoutputcommitter.marksuccessfuljobs": "false"}
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_end(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the writes inside go when each write has ended: what it wrote is safe in the shared folder."""
    was = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, was)


def scratch_table(df: DataFrame, name: str, compression: str = "zstd", rows: int | None = None, per_file: int = 500_000) -> DataFrame:
    """Writes df to the shared folder and reads it back: lineage ends here and survives lost executors. forget() removes it.
    rows: a bound of how many there are, where it is known; small rows are then dealt to few writers. As many tasks as before
    make them."""
    path = scratch_path(df.sparkSession, name)
    df = df if rows is None else df.repartition(max(1, -(-rows // per_file)))
    with shuffles_end(df.sparkSession):
        df.write.options(**NO_MARK).option("compression", compression).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.scratch = path
    return out


def scratch_buckets(df: DataFrame, name: str, key: str) -> DataFrame:
    """scratch_table() in as many buckets by key as there are shuffle partitions: to group it by key moves no row."""
    spark, path = df.sparkSession, scratch_path(df.sparkSession, name)
    table = os.path.basename(path).replace("-", "_")
    with shuffles_end(spark):
        df.write.bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), key).options(**NO_MARK).option("path", path).option("compression", "zstd").saveAsTable(table)
    out = spark.table(table)
    out.scratch, out.scratch_name = path, table
    return out


def forget(*tables: DataFrame) -> None:
    """Removes scratch tables that nothing reads any more."""
    for t in tables:
        if hasattr(t, "scratch_name"):
            t.sparkSession.sql(f"DROP TABLE IF EXISTS {t.scratch_name}")
        jvm, conf = t.sparkSession._jvm, t.sparkSession._jsc.hadoopConfiguration()
        at = jvm.org.apache.hadoop.fs.Path(t.scratch)
        at.getFileSystem(conf).delete(at, True)


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def fresh(df: DataFrame, name: str) -> str:
    """name, with underscores before it while df has a column of that name."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name = f"_{name}"
    return name


def spread_join(rows: DataFrame, keyed: DataFrame, key: str, count: str, how: str = "inner", total: int | None = None, salts: int = 64) -> DataFrame:
    """rows joined with keyed on key, which keyed holds once each; `count`: how many of rows have the key, `total` in all. A
    key that holds over 1 in 1000 rows (so at most 1000 keys, which are broadcast) is dealt to `salts` tasks, and so are the
    rows without a key, which join nothing."""
    total = keyed.agg(F.sum(count)).first()[0] or 0 if total is None else total
    salt, hot, some = fresh(rows, "_salt"), fresh(rows, "_hot"), F.col(count) > max(1000, total // 1000)
    deal = F.pmod(F.hash(*[F.col(f"`{c}`") for c in rows.columns]), F.lit(salts))
    few = F.broadcast(keyed.filter(some).select(key, F.lit(True).alias(hot)))
    one = rows.join(few, key, "left").withColumn(salt, F.when(F.col(hot) | F.col(key).isNull(), deal).otherwise(0)).drop(hot)
    two = keyed.withColumn(salt, F.explode(F.when(some, F.array(*map(F.lit, range(salts)))).otherwise(F.array(F.lit(0))))).drop(count)
    # the same join at every size
    return one.join(two.hint("merge"), [key, salt], how).drop(salt)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def released(run: Callable, *caches: Callable[[], dict]) -> Callable:
    """run (batches to batches) for mapInArrow, after which the Python worker, which stays for later tasks and for some time beside
    stages that need none, hands its memory back: what caches give is emptied, and free memory goes to the system."""

    def all_of(batches):
        try:
            yield from run(batches)
        finally:
            for c in caches:
                c().clear()
            gc.collect()
            pa.default_memory_pool().release_unused()
            with suppress(OSError, AttributeError):  # only this C library has it
                ctypes.CDLL("libc.so.6").malloc_trim(0)

    return all_of


def list_slices(column: pa.Array) -> Iterator[memoryview]:
    """The bytes of each row of a list<int32> column, little-endian; a null row gives none."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    values, ends = memoryview(column.values.buffers()[1] or b"").cast("B"), column.offsets.to_numpy()
    at = 4 * column.values.offset
    for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
        yield values[at + 4 * a : at + 4 * b]


def int32_lists(rows: list[bytes]) -> pa.Array:
    """A list<int32> column from rows of little-endian bytes."""
    ends = np.zeros(len(rows) + 1, np.int64)
    np.cumsum([len(r) // 4 for r in rows], out=ends[1:])
    if ends[-1] >= 2**31:
        raise ValueError("an Arrow batch holds over 2^31 ids; lower spark.sql.execution.arrow.maxRecordsPerBatch")
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(np.frombuffer(b"".join(rows), np.int32)))


def gapless_rank(df: DataFrame, group: str, order: list[str], size: str | None = None) -> DataFrame:
    """Adds rank (long, from 0 without gaps in each group, by order) and, with size, before (sum of size of earlier rows).

    Rows are dealt by range of (group, order), so a group with a third of all rows spreads over many tasks; each task
    counts in its own run, and offsets come from one count row per task and group, at most tasks + groups rows, which are
    joined. group must not be null; rows that tie in order are interchangeable.
    """
    names = df.columns

    def count(batches):
        part, seen, sums = TaskContext.get().partitionId(), {}, {}
        for b in batches:
            keys = b.column(names.index(group)).to_pylist()
            sizes = b.column(names.index(size)).to_pylist() if size else keys
            ranks, befores = [0] * len(keys), [0] * len(keys)
            for i, k in enumerate(keys):
                ranks[i] = n = seen.get(k, 0)
                seen[k] = n + 1
                if size:
                    befores[i] = n = sums.get(k, 0)
                    sums[k] = n + sizes[i]
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array([part] * len(keys), pa.int32()), pa.array(ranks, pa.int64()), pa.array(befores, pa.int64())],
                [*names, "_part", "_rank", "_before"],
            )

    schema = f"{', '.join(f'`{n}` {t}' for n, t in df.dtypes)}, _part int, _rank long, _before long"
    local = scratch_table(df.repartitionByRange(group, *order).sortWithinPartitions(group, *order).mapInArrow(count, schema), "rank")
    ends = local.groupBy(group, "_part").agg((F.max("_rank") + 1).alias("_n"), F.max(F.col("_before") + (F.col(size) if size else 0)).alias("_s"))
    w = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = ends.select(group, "_part", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_n0"), F.coalesce(F.sum("_s").over(w), F.lit(0)).alias("_s0"))
    # the same join at every size
    out = local.join(starts.hint("merge"), [group, "_part"])
    more = [(F.col("_before") + F.col("_s0")).alias("before")] if size else []
    return out.select(*names, (F.col("_rank") + F.col("_n0")).alias("rank"), *more)
