"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossweave.llm.common import forget, scratch_table, spread_join


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return row[0], row[1]


def connected_components(edges: DataFrame, rows: int | None = None, rounds: int = 60) -> DataFrame:
    """node, component (the smallest node reachable) for every node of edges (u, v: long, null and u = v are ignored).

    Each round is two joins on edges. Nothing is gathered by node: least neighbours are taken before the shuffle, and the
    edges of a node that holds over 1 in 1000 of them are dealt to many tasks. Rounds end when edges stay as they are: each
    node then points at its component's smallest node. An empty table gives no rows. rows: about
    how many edges there are, if that is known. The result's attribute `rows` bounds the number of its rows.
    """
    at = edges.filter(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    at = scratch_table(at, "edges", "none", rows)
    mark = _mark(at)
    for _ in range(rounds):
        if not mark[0]:
            break
        both = at.unionByName(at.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        large = spread_join(both.filter("v > u"), least, "u", "n", total=2 * mark[0]).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
        rest = spread_join(large, least, "u", "n", total=mark[0]).filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = scratch_table(rest.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "edges", "none", mark[0])
        forget(at)
        old, at, mark = mark, new, _mark(new)
        if mark == old:
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    out = at.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(at.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
    out.rows = 2 * mark[0]
    return out
