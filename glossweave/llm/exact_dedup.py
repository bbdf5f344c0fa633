"""Operator 13: exact deduplication by a keyed streaming state. DataFrame functions only.

Two streaming queries over the files of a table, both restartable and run by ingest():

1. Fingerprints: every row becomes (doc_id, digest, file, row): the SHA-256 of its text in normal form, and where the row
   lies. No text is kept. The file sink writes each micro-batch once.
2. State: rows are grouped by digest without a watermark, so no key expires. For each digest the state keeps how many rows
   had it, and the first of them: its doc_id (the smallest) and content locator (file and row). The state lies in RocksDB
   on the executors' disks, with its checkpoint in the shared folder. Copies are summed up in each task before they are
   shuffled, so a text in a third of all rows is one row a task.

verdicts() reads the state back, gives each row the first of its digest, and checks full bytes: the texts of all rows whose
digest was hit twice or more are fetched by locator (file and row, which are unique, so a hot text spreads evenly) and grouped
by digest and whole text. Where one digest has several texts, each text is a group of its own. Files that come later are
taken in by calling ingest() again with the same folder; only new files are read.

Null text counts as empty; empty and blank texts are texts like others (one space and none differ). Of equal texts the row
with the smallest doc_id stays; of rows that share that too, the first by file and row. Rows without a doc_id come last: where
no row of a group has one, keep_id is null and the first row stays. Very long texts are read whole, by one task at a time. An
empty table gives no rows. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glossweave.llm.common import exists, scratch_path, scratch_table

#: A table is read in about so many micro-batches.
BATCHES = 4
ROCKSDB = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
    # else each of many small stores reserves megabytes of disk for its logs
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}


def normal(text: Column) -> Column:
    """text (null: empty) with each run of white space as one space. A lone space, the common case, needs no replacement."""
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+", " ")


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def _located(df: DataFrame) -> DataFrame:
    meta = df.metadataColumn("_metadata")
    return df.select(df["doc_id"].cast("long").alias("doc_id"), normal(df["text"]).alias("text"), meta["file_path"].alias("file"), meta["row_index"].alias("row"))


def _run(spark: SparkSession, stream: DataFrame, kind: str, folder: str, mode: str, **options: str) -> None:
    writer = stream.writeStream.format(kind).outputMode(mode).options(checkpointLocation=folder, **options)
    writer.trigger(availableNow=True).start().awaitTermination()


def ingest(spark: SparkSession, path: str, folder: str, batches: int = BATCHES, digest: Callable[[Column], Column] = sha256) -> None:
    """Takes the rows of the Parquet files at path (doc_id, text), those that folder has not yet seen, into its fingerprints and state."""
    table = spark.read.parquet(path)
    size = table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    # settings of the state are those of a session of its own
    own = spark.newSession()
    for k, v in {**ROCKSDB, "spark.sql.shuffle.partitions": spark.conf.get("spark.sql.shuffle.partitions")}.items():
        own.conf.set(k, v)
    # a pattern stands for a file as for a folder
    source = own.readStream.schema(table.schema).option("maxBytesPerTrigger", max(1, -(-size // batches))).parquet(f"{path[:-1]}[{path[-1]}]")
    prints = _located(source).select("doc_id", digest(F.col("text")).alias("digest"), "file", "row")
    _run(own, prints, "parquet", f"{folder}/seen", "append", path=f"{folder}/prints", compression="zstd")
    read = own.readStream.schema(prints.schema).option("maxBytesPerTrigger", max(1, size // (16 * batches))).parquet(f"{folder}/prints")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "file", "row"))
    _run(own, read.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), first.alias("first")), "noop", f"{folder}/state", "update")


def groups(spark: SparkSession, folder: str) -> DataFrame:
    """digest, n, first (none, doc_id, file, row): what the state holds, a row for each digest."""
    state = spark.read.format("statestore").load(f"{folder}/state")
    return state.select("key.digest", F.col("value.count").alias("n"), F.col("value.min").alias("first"))


def verdicts(spark: SparkSession, path: str, folder: str) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row that folder has taken in from path."""
    if not exists(spark, f"{folder}/state/state"):
        return spark.createDataFrame([], "doc_id long, keep_id long, group_size long, kept boolean, text_sha256 string")
    prints = spark.read.parquet(f"{folder}/prints")
    multi = scratch_table(groups(spark, folder).filter("n > 1"), "hits")
    # the same join at every size; rows of a hot digest are dealt to many tasks by the engine's skew join
    rows = scratch_table(prints.join(multi.hint("merge"), "digest", "left"), "prints")
    hits = rows.filter("n is not null").select("file", "row", "digest")
    docs = _located(spark.read.parquet(path))
    whole = docs.select("file", "row", "text", "doc_id").join(hits.hint("merge"), ["file", "row"])
    counted = whole.groupBy("digest", "text").agg(F.count(F.lit(1)).alias("n"))
    unlike = scratch_table(counted.groupBy("digest").agg(F.count(F.lit(1)).alias("texts")).filter("texts > 1"), "unlike")
    none, first = F.col("doc_id").isNull(), F.col("first")
    sure = rows.join(unlike.hint("merge"), "digest", "left_anti") if not unlike.isEmpty() else rows
    out = sure.select(
        "doc_id",
        F.when(first.isNull(), F.col("doc_id")).otherwise(first["doc_id"]).alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce((F.col("file") == first["file"]) & (F.col("row") == first["row"]), F.lit(True)).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )
    if sure is rows:
        return out
    # digests that several texts share: each whole text is its own group
    shared = whole.join(unlike.select("digest").hint("merge"), "digest", "left_semi")
    one = shared.groupBy("digest", "text").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(none.alias("none"), "doc_id", "file", "row")).alias("first"))
    back = shared.join(one.hint("merge"), ["digest", "text"])
    kept = (F.col("file") == first["file"]) & (F.col("row") == first["row"])
    return out.unionByName(back.select("doc_id", first["doc_id"].alias("keep_id"), F.col("n").alias("group_size"), kept.alias("kept"), F.lower(F.hex("digest")).alias("text_sha256")))


def deduplicate(spark: SparkSession, path: str) -> DataFrame:
    """The verdict on every row of the Parquet table at path."""
    folder = scratch_path(spark, "dedup")
    ingest(spark, path, folder)
    return verdicts(spark, path, folder)


def sql() -> str:
    """What deduplicate() returns for the table documents, for DuckDB."""
    return r"""with d as (select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') as t, row_number() over () as r from documents),
 g as (select *, first_value(doc_id) over w as keep_id, first_value(r) over w as keep_r, count(*) over (partition by t) as group_size from d window w as (partition by t order by doc_id nulls last, r))
 select doc_id, keep_id, group_size, r = keep_r as kept, sha256(t) as text_sha256 from g"""
