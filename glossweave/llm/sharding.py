"""Operator 8: shards by a hierarchical weighted hash tree.

A tree of regions, racks and shards; a document descends it. At each level every child draws -ln(u) / weight, where u
in (0, 1] is a hash of (seed, doc_id, child), and the smallest draw wins, so a child is taken in proportion to its
weight, the number of shards below it. A draw depends on the child alone: when weights change, only documents whose
winner lies in the changed subtree move. Shards fill regions in order, so shard 16 after 0 to 15 opens a region of its
own and takes documents only into itself.

Columns only, no Python. Null doc_id draws as its own key. Null text has size 1 and the crc of no bytes. Equal doc_ids
share a shard, rows that repeat get a slot each. Slots follow doc_id, then crc and size. A very long text is one value of one
row; texts do not move. An empty table gives no rows. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossweave.llm.common import gapless_rank

REGION, RACK = 4, 2
SEED = 20240


def _draw(key: Column, level: str, child: int, weight: float) -> Column:
    u = (F.shiftrightunsigned(F.xxhash64(key, F.lit(f"{SEED}/{level}/{child}")), 11) + 1) * F.lit(2.0**-53)
    return -F.log(u) / F.lit(float(weight))


def _least(key: Column, level: str, children: list[tuple[int, float, Column]]) -> Column:
    """The value of the child that draws least; ties go to the first child."""
    if len(children) == 1:
        return children[0][2]
    draws = F.array(*[F.struct(_draw(key, level, c, w).alias("d"), F.lit(c).alias("c")) for c, w, _ in children])
    won = F.array_min(draws)["c"]
    out = F.when(won == children[0][0], children[0][2])
    for c, _, value in children[1:]:
        out = out.when(won == c, value)
    return out


def tree_shard(key: Column, shards: int, weights: dict[int, float] | None = None, region: int = REGION, rack: int = RACK) -> Column:
    """The shard of key in a tree of so many shards: `region` shards to a region, `rack` to a rack; weights default to 1."""
    if shards < 1 or region % rack:
        raise ValueError("shards must be positive and a region must hold whole racks")
    w = {s: (weights or {}).get(s, 1.0) for s in range(shards)}
    leaves: dict[int, dict[int, list[int]]] = {}
    for s in range(shards):
        leaves.setdefault(s // region, {}).setdefault(s // rack, []).append(s)
    total = lambda xs: math.fsum(w[s] for s in xs)
    regions = []
    for g, racks in leaves.items():
        below = [(r, total(ss), _least(key, "shard", [(s, w[s], F.lit(s)) for s in ss])) for r, ss in racks.items()]
        regions.append((g, total(s for ss in racks.values() for s in ss), _least(key, "rack", below)))
    return _least(key, "region", regions)


def shard_documents(docs: DataFrame, shards: int = 16) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of docs (doc_id, text)."""
    raw = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(F.coalesce("text", F.lit(""))) + 1).cast("long").alias("size"),
        F.crc32(raw).alias("text_crc32"),
        F.lit("key").alias("law"),
        tree_shard(key, shards).cast("int").alias("shard"),
        tree_shard(key, shards + 1).cast("int").alias("grown_shard"),
    )
    out = gapless_rank(rows, "shard", ["doc_id", "text_crc32", "size"])
    return out.select("doc_id", "size", "text_crc32", "law", "shard", F.col("rank").alias("slot"), "grown_shard")
