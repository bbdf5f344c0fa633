"""Operator 1: token ids in ORC files.

encode_to_orc deals documents by range of doc_id, so files hold ascending, disjoint id ranges, and writes one row for
each document: its ids as array<int> (ORC's integer run-length encoding), with row indexes and a Bloom filter on
doc_id. Stripes are read in parallel; a filter on doc_id prunes files, stripes and row groups by statistics.

Null text counts as empty and gives the end id alone. Rows with a null doc_id come first. Rows that repeat a doc_id are
all kept, in order of a hash of their text. A very long text is one row of one stripe. Other columns are ignored. An empty
table gives an empty file set.
"""

from __future__ import annotations

import zlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glossweave.llm.common import int32_lists, list_slices, scratch_path
from glossweave.llm.tokens import encoder

END_ID = 1
SCHEMA = "part int, doc_id long, local_start long, n_tokens long, ids array<int>"
ORC = {"orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01", "orc.row.index.stride": "1000", "orc.stripe.size": str(32 << 20), "compression": "zstd"}


def encode_to_orc(docs: DataFrame, path: str, tokenizer: str, kind: str = "word", end_id: int = END_ID) -> None:
    """Writes the files of docs (doc_id, text) to path."""

    def encode(batches):
        enc, part, at, end = encoder(tokenizer, kind), TaskContext.get().partitionId(), 0, end_id.to_bytes(4, "little")
        for b in batches:
            rows = [enc.encode(t) + end for t in b.column(1).to_pylist()]
            counts = [len(r) // 4 for r in rows]
            starts = []
            for n in counts:
                starts.append(at)
                at += n
            yield pa.RecordBatch.from_arrays([pa.array([part] * len(rows), pa.int32()), b.column(0), pa.array(starts, pa.int64()), pa.array(counts, pa.int64()), int32_lists(rows)], ["part", "doc_id", "local_start", "n_tokens", "ids"])

    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    # a hash parts the texts of one id, or of none, so that many of them fill several files
    order = ["doc_id", F.xxhash64("text")]
    d.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(encode, SCHEMA).write.options(**ORC).orc(path)


def read_orc(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before), ids. The starts of files come from one row for each file."""
    files = spark.read.schema(SCHEMA).orc(path)
    w = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = files.groupBy("part").agg(F.sum("n_tokens").alias("n")).select("part", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("base"))
    return files.join(F.broadcast(starts), "part").select("doc_id", (F.col("base") + F.col("local_start")).alias("start"), "ids")


def digest(rows: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of rows (doc_id, start, ids)."""

    def crc(batches):
        for b in batches:
            ids = list(list_slices(b.column(2)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([zlib.crc32(x) for x in ids], pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return rows.mapInArrow(crc, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Writes docs' files to the shared folder and returns the digest of what they hold."""
    path = scratch_path(docs.sparkSession, "token-files")
    encode_to_orc(docs, path, tokenizer)
    return digest(read_orc(docs.sparkSession, path))
