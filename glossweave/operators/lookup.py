"""Exact and prioritised lookups over tables of requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glossweave.functions.text import normalize, tokens
from glossweave.sources.shared import stored


def exact_index(rows: DataFrame, field: str, row_id: str) -> DataFrame:
    """term, row_id: the postings of the whole normalised field, a row for each, so a hot term is no row of its own."""
    return rows.select(normalize(F.col(field)).alias("term"), row_id).filter("term != ''").distinct()


def inverted_index(rows: DataFrame, fields: list[str], row_id: str) -> DataFrame:
    """term, row_id: the whole normalised field and its words, each once for a row."""
    terms = F.flatten(F.array(*[F.array_union(F.array(normalize(F.col(f))), tokens(F.col(f))) for f in fields]))
    return rows.select(row_id, F.explode(F.array_distinct(terms)).alias("term")).filter("term != ''")


def exact(requests: DataFrame, request: str, rows: DataFrame, field: str) -> DataFrame:
    """Rows whose normalised field equals the normalised request; requests and rows keep their columns."""
    return requests.withColumn("_k", normalize(F.col(request))).join(rows.withColumn("_k", normalize(F.col(field))), "_k").filter("_k != ''").drop("_k")


def composite(requests: DataFrame, rows: DataFrame, keys: dict[str, str]) -> DataFrame:
    """Equal on every pair of normalised keys (request column: row column)."""
    on = [f"_k{i}" for i in range(len(keys))]
    for k, (a, b) in zip(on, keys.items(), strict=True):
        requests, rows = requests.withColumn(k, normalize(F.col(a))), rows.withColumn(k, normalize(F.col(b)))
    return requests.join(rows, on).drop(*on)


def any_field(requests: DataFrame, request: str, rows: DataFrame, fields: list[str], row_id: str) -> DataFrame:
    """request, row_id and the comma list of fields that equal the request; one equi-join over unpivoted fields."""
    legs = F.array(*[F.struct(normalize(F.col(f)).alias("k"), F.lit(i).alias("i"), F.lit(f).alias("f")) for i, f in enumerate(fields)])
    long = rows.select(row_id, F.explode(legs).alias("l")).select(row_id, "l.*").filter("k != ''")
    hits = requests.select(request, normalize(F.col(request)).alias("k")).join(long, "k")
    found = hits.groupBy(request, row_id).agg(F.sort_array(F.collect_set(F.struct("i", "f"))).alias("m"))
    return found.select(request, row_id, F.array_join(F.transform("m", lambda x: x["f"]), ", ").alias("matched_on"))


def short_circuit(first: DataFrame, others: DataFrame, request: list[str]) -> DataFrame:
    """Rows of first, and rows of others for requests that first has none for."""
    return first.unionByName(others.join(first.select(*request).distinct(), request, "left_anti"))


def first_match(candidates: DataFrame, request: list[str], order: list[str | Column]) -> DataFrame:
    w = Window.partitionBy(*request).orderBy(*order)
    return candidates.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def prioritised(requests: DataFrame, request: str, rows: DataFrame, row_id: str, levels: list[tuple[str, Column]]) -> DataFrame:
    """request (normalised), priority (from 1), row_id: the first row of the first level that has the request. A level is a field
    of rows and which rows take part; each level keeps one row of a key before requests meet it."""
    keys = F.array_compact(F.array(*[F.when(on, F.struct(normalize(F.col(f)).alias(request), F.lit(i + 1).alias("priority"))) for i, (f, on) in enumerate(levels)]))
    each = rows.select(row_id, F.explode(keys).alias("l")).select("l.*", row_id).filter(F.col(request) != "")
    first = each.groupBy(request).agg(F.min(F.struct("priority", row_id)).alias("f")).select(request, "f.*")
    return requests.select(normalize(F.col(request)).alias(request)).distinct().join(first, request)


def ranked(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """rows with their place in order as name (long, from 1 without gaps), over all rows but by no single task: rows are sorted by
    range and numbered in each range; the ranges' first numbers come from one row for each range."""
    at = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
    at = stored(at.withColumn("_range", F.shiftright("_id", 33)), "ranked")
    ends = at.groupBy("_range").agg(F.count(F.lit(1)).alias("_rows"), F.min("_id").alias("_low"))
    before = F.coalesce(F.sum("_rows").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = ends.select("_range", (before - F.col("_low") + 1).alias("_start"))
    return at.join(starts, "_range").withColumn(name, F.col("_id") + F.col("_start")).select(*rows.columns, name)


def merge_candidates(candidates: DataFrame, key: str, source: str, order: str) -> DataFrame:
    """key, sources (ordered, each once), first (least order), n."""
    each = candidates.filter(F.col(key) != "").groupBy(key, source).agg(F.min(order).alias("o"), F.count(F.lit(1)).alias("c"))
    merged = each.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("o", source))).alias("s"), F.min("o").alias("first"), F.sum("c").alias("n"))
    return merged.select(key, F.array_join(F.transform("s", lambda x: x[source]), ", ").alias("sources"), "first", "n")


def union_base_first(base: DataFrame, more: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Rows of both, one for each normalised key; base rows win, then the earlier."""
    both = base.withColumn("_s", F.lit(0)).unionByName(more.withColumn("_s", F.lit(1)))
    return first_match(both, [normalize(F.col(k)) for k in keys], ["_s", order]).withColumnRenamed("_s", "origin")
