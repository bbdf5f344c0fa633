"""Operator 12: importance resampling towards a target distribution, over an integer word dictionary.

Features are runs of 1 to `width` words. How they are counted:

1. Texts of both tables are cut, where they lie, into blocks of about BLOCK words. A block has a dictionary of its distinct
   words with an integer id for each; its runs are tuples of ids. The bytes of each distinct tuple are put together from the
   dictionary and hashed once, and its count and bucket are joined back by the tuple's place. What is stored of a block is a
   bucket number for each run of each document, and how many runs each bucket has.
2. Counts are summed by bucket: a bucket's gain is floor(1000 * ln((t + 1) * (S + buckets) / ((s + 1) * (T + buckets)))),
   for s of S features of the documents and t of T of the target in it. Gains, at most `buckets` numbers, go to the driver
   and on to the tasks.
3. A document's weight is the floored mean of its features' gains, its score adds Gumbel noise of its doc_id, and the highest
   scores of documents with enough words are drawn, in order, by a rank that spreads over tasks.

No text, word or run is shuffled: a row for each bucket and task is, and three numbers a document. A dictionary of all tables
instead would move each distinct word of each block four times. A task holds one block, or one very long text, which is a
block by itself.

Null and blank texts have no features: weight 0, never drawn where `least` is over 0. A null doc_id draws the noise of an empty id
and comes last among ties. Rows that repeat are each scored; rows that tie in score and doc_id take their ranks in any order. An
empty target has T = 0; an empty documents table gives no rows. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossweave.llm.common import forget, gapless_rank, scratch_table

BUCKETS, BLOCK, LEAST, PERCENT, SEED = 10_000, 1_000_000, 20, 10, 2024
#: A word: ASCII digits, letters in lower case, and all beyond ASCII; as bytes of UTF-8.
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

BLOCKS = "target boolean, buckets array<int>, counts array<long>, ids array<long>, lengths array<int>, codes binary"


class _Places(dict):
    def __missing__(self, word):
        self[word] = place = len(self)
        return place


def runs(flat: np.ndarray, lengths: list[int], width: int):
    """(tuples, counts, codes) of the runs of 1 to width entries inside each stretch of flat: codes has the place in tuples of
    every run, shorter runs first, in the order of flat."""
    left = np.concatenate([np.arange(n, 0, -1) for n in lengths]) if lengths else np.zeros(0, np.int64)
    words = int(flat.max()) + 1 if len(flat) else 0
    at, code = np.arange(len(flat)), flat
    level = [(i,) for i in range(words)]
    tuples, counts, codes = list(level), [np.bincount(flat, minlength=words)], [flat]
    for n in range(2, width + 1):
        on = left[at] >= n
        at, code = at[on], code[on]
        keys, code, count = np.unique(code * words + flat[at + n - 1], return_inverse=True, return_counts=True)
        level = [(*level[k // words], k % words) for k in keys.tolist()]
        codes.append(code + len(tuples))
        tuples += level
        counts.append(count)
    return tuples, np.concatenate(counts), np.concatenate(codes)


def blocks(docs: DataFrame, target: bool, width: int, buckets: int) -> DataFrame:
    """The texts of docs (doc_id, text) as BLOCKS: the counts of the buckets that occur, and of each text (id, number of words)
    the buckets of its runs, those of one word of all texts first."""
    kind = np.uint16 if buckets <= 1 << 16 else np.uint32

    def block(places, ids, lengths, flat):
        tuples, counts, codes = runs(np.fromiter(flat, np.int64, len(flat)), lengths, width)
        words = list(places)
        bucket = np.fromiter((zlib.crc32(b" ".join([words[i] for i in t])) % buckets for t in tuples), np.int64, len(tuples))
        total = np.bincount(bucket, counts, buckets).astype(np.int64)
        some = np.nonzero(total)[0]
        row = [pa.array([target]), pa.array([some.astype(np.int32)], pa.list_(pa.int32())), pa.array([total[some]], pa.list_(pa.int64())), pa.array([ids], pa.list_(pa.int64())), pa.array([lengths], pa.list_(pa.int32())), pa.array([bucket[codes].astype(kind).tobytes()])]
        return pa.RecordBatch.from_arrays(row, ["target", "buckets", "counts", "ids", "lengths", "codes"])

    def run(batches):
        places, ids, lengths, flat = _Places(), [], [], []
        for b in batches:
            for d, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                found = WORD.findall((t.as_py() or "").encode().lower())
                flat.extend(map(places.__getitem__, found))
                ids.append(d)
                lengths.append(len(found))
                if len(flat) >= BLOCK:
                    yield block(places, ids, lengths, flat)
                    places, ids, lengths, flat = _Places(), [], [], []
        if ids:
            yield block(places, ids, lengths, flat)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, BLOCKS)


def gains(cut: DataFrame, buckets: int) -> np.ndarray:
    """The gain of each bucket; one that occurs in neither table has the gain of no features. `buckets` rows at most are collected."""
    each = cut.select("target", F.explode(F.arrays_zip("buckets", "counts")).alias("r")).groupBy(F.col("r.buckets").alias("bucket"))
    total = lambda on: F.sum(F.when(on, F.col("r.counts")).otherwise(0))
    rows = each.agg(total(~F.col("target")).alias("s"), total(F.col("target")).alias("t")).collect()
    s, t = np.zeros(buckets), np.zeros(buckets)
    for r in rows:
        s[r["bucket"]], t[r["bucket"]] = r["s"], r["t"]
    ratio = (t + 1.0) * (s.sum() + buckets) / ((s + 1.0) * (t.sum() + buckets))
    return np.array([math.floor(1000 * math.log(x)) for x in ratio.tolist()], np.int64)


def weighed(cut: DataFrame, gain: np.ndarray, width: int) -> DataFrame:
    """doc_id, n_words, n_features, weight of the documents of blocks, by the gains of buckets."""
    kind = np.uint16 if len(gain) <= 1 << 16 else np.uint32

    def run(batches):
        for b in batches:
            for r in b.to_pylist():
                codes = np.frombuffer(r["codes"], kind)
                n, low = np.array(r["lengths"], np.int64), 0
                total, count = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)
                for k in range(width):
                    size = np.maximum(n - k, 0)
                    sums = np.concatenate([[0], np.cumsum(gain[codes[low : low + int(size.sum())]])])
                    ends = np.cumsum(size)
                    total += sums[ends] - sums[ends - size]
                    count, low = count + size, low + int(ends[-1])
                weight = np.floor_divide(total, np.maximum(count, 1))
                yield pa.RecordBatch.from_arrays([pa.array(r["ids"], pa.int64()), pa.array(n), pa.array(count), pa.array(weight)], ["doc_id", "n_words", "n_features", "weight"])

    return cut.filter("not target").select("ids", "lengths", "codes").mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def noise(doc_id: Column, seed: int) -> Column:
    """Gumbel noise of doc_id, in thousandths."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def resample(docs: DataFrame, target: DataFrame, width: int = 1, buckets: int = BUCKETS, percent: int = PERCENT, least: int = LEAST, seed: int = SEED) -> DataFrame:
    """doc_id, n_features, weight, score, rank for every row of docs (doc_id, text), drawn towards target (text)."""
    wanted = target.select(F.lit(None).cast("long").alias("doc_id"), "text")
    cut = scratch_table(blocks(docs, False, width, buckets).unionByName(blocks(wanted, True, width, buckets)), "blocks")
    scored = weighed(cut, gains(cut, buckets), width).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
    scored = scratch_table(scored, "scored")
    forget(cut)
    able = scored.filter(F.col("n_words") >= least)
    drawn = math.floor(percent * able.count() / 100)
    order = able.select("doc_id", "n_features", "weight", "score", F.lit(0).alias("all"), (-F.col("score")).alias("low"), F.col("doc_id").isNull().alias("none"))
    cols = ["doc_id", "n_features", "weight", "score"]
    placed = gapless_rank(order, "all", ["low", "none", "doc_id"]).select(*cols, F.when(F.col("rank") < drawn, F.col("rank") + 1).alias("rank"))
    return placed.unionByName(scored.filter(F.col("n_words") < least).select(*cols, F.lit(None).cast("long").alias("rank")))


def sql() -> str:
    """What resample() returns for the tables documents and benchmark and runs of one word, for DuckDB."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    words = f"regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    return f"""with {CRC32_TABLE},
 d as (select row_number() over () as r, doc_id, {words} as words from documents),
 f as (select r, unnest(words) as word from d), b as (select unnest({words}) as word from benchmark),
 w as (select word, {crc32_sql("word")} % {BUCKETS} as bucket from (select word from f union select word from b), crc_table),
 s as (select bucket, count(*) as s from f join w using (word) group by bucket), t as (select bucket, count(*) as t from b join w using (word) group by bucket),
 g as (select bucket, floor(1000 * ln((coalesce(t, 0) + 1.0::double) * ((select count(*) from f) + {BUCKETS}) / ((s + 1.0::double) * ((select count(*) from b) + {BUCKETS}))))::bigint as gain from s left join t using (bucket)),
 m as (select r, floor(sum(gain)::double / count(*))::bigint as weight from f join w using (word) join g using (bucket) group by r),
 n as (select r, doc_id, len(words) as n_features, coalesce(weight, 0) as weight, ('0x' || substr(sha256('{SEED}:' || doc_id), 1, 8))::bigint as h from d left join m using (r)),
 c as (select *, weight + floor(-1000 * ln(-ln((h + 0.5::double) / 4294967296)))::bigint as score from n),
 k as (select r, row_number() over (order by score desc, doc_id) as rank from c where n_features >= {LEAST}),
 drawn as (select * from k where rank <= (select floor({PERCENT} * count(*) / 100) from k))
 select doc_id, n_features, weight, score, rank from c left join drawn using (r)"""


#: crc_table: one row with the 256 remainders of CRC-32 as a list, for DuckDB.
CRC32_TABLE = """crc_table as (select list(v order by i) as remainders from (select i, list_reduce(list_prepend(i, range(8)), lambda c, k: case when c % 2 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) as v from range(256) x(i)))"""


def crc32_sql(text: str) -> str:
    """CRC-32 of text's UTF-8 bytes, for DuckDB, beside crc_table."""
    octets = f"list_transform(range(octet_length(encode({text}))), lambda i: ('0x' || substr(hex({text}), 2 * i + 1, 2))::bigint)"
    return f"xor(list_reduce(list_prepend(4294967295, {octets}), lambda c, o: xor(c >> 8, remainders[(xor(c, o) & 255) + 1])), 4294967295)"
