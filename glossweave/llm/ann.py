"""Operator 10: approximate nearest neighbours by cross-polytope hashing.

Each of TABLES tables has one or two pseudo-rotations (three rounds of random signs and a fast Hadamard transform, on
vectors padded to a power of two) and a bucket for each signed axis, or pair of them. A vector lies in the bucket of its
nearest signed axes; a query probes several, nearest first. Candidates are reranked exactly, in double precision, on the
original vectors. A query whose buckets hold fewer than k rows is compared exactly with all rows of its length, in blocks.

How many tables are used, how many buckets a query probes in each, and whether axes are paired, is fitted for each vector length
on a sample of at most FIT vectors, drawn by hash, without most copies: of all plans whose recall of the sample's own neighbours
is RECALL, the one with the least share of rows to look at, plus COPY for each time that a vector travels: once to each table, and a
query to each bucket that it probes. Where that is no less than for one bucket with all rows, there is one bucket. Where the sample is all there is,
recall is that of the sample; in a larger table neighbours are nearer. Vectors without structure need half of all rows or more;
clustered ones a few in a thousand.

Equal vectors: only the smallest k + 1 ids of a vector can be among k nearest with ties to the smaller id, so the rest leave
before hashing and a vector with very many copies makes no large bucket; nothing is lost. Buckets over BLOCK rows are cut into
blocks which each meet the bucket's queries. Vectors travel as they are given (float32 stays float32).

Vectors that are null, empty, zero, or hold null or non-finite components take no part, neither do null ids; vectors of
other lengths are not compared. Rows that repeat an id and vector count once; an id's other rows are not its neighbours.
An empty table gives no rows. A very long vector is one row of each table. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glossweave.llm.common import scratch_table

TABLES, BLOCK, PAIRS, SEED = 6, 8192, 16384, 11
FIT, RECALL, COPY, ROWS = 8192, 0.95, 0.02, 512
#: Plans with pairs of axes are sought among those of so many probes; those of single axes have no bound.
PAIR_PROBES = 256


def hadamard(x: np.ndarray) -> np.ndarray:
    """The orthonormal fast Hadamard transform of each row; the width is a power of two."""
    n, h = x.shape[1], 1
    while h < n:
        y = x.reshape(len(x), n // (2 * h), 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(len(x), n)
        h *= 2
    return x / np.sqrt(n)


def rotate(x: np.ndarray, table: int) -> np.ndarray:
    width = 1 << max(0, x.shape[1] - 1).bit_length()
    y = np.zeros((len(x), width))
    y[:, : x.shape[1]] = x
    signs = np.random.default_rng([SEED, table, width]).choice([-1.0, 1.0], (3, width))
    for s in signs:
        y = hadamard(y * s)
    return y


def signed(x: np.ndarray, rotation: int) -> np.ndarray:
    """How near each row is to each signed axis."""
    y = rotate(x, rotation)
    return np.concatenate([y, -y], axis=1)


def nearest_first(y: np.ndarray, n: int) -> np.ndarray:
    """The n greatest of each row, greatest first, ties by place."""
    return np.argmax(y, axis=1)[:, None] if n == 1 else np.argsort(-y, axis=1, kind="stable")[:, : max(1, min(n, y.shape[1]))]


def buckets(x: np.ndarray, table: int, probes: int, pairs: bool = False) -> np.ndarray:
    """For each row the nearest buckets of a table, nearest first: signed axes (the axis, or axis + width where negative), or pairs
    of them, one of each of two rotations, by the sum of both."""
    y = signed(x, 2 * table)
    if not pairs:
        return nearest_first(y, probes)
    z = signed(x, 2 * table + 1)
    if probes == 1:
        return nearest_first(y, 1) * y.shape[1] + nearest_first(z, 1)
    # the first `probes` pairs lie among the first axes of either rotation: pair (i, j) has i * j nearer ones
    m = min(probes, y.shape[1])
    i, j = np.array([(i, j) for i in range(m) for j in range(m) if (i + 1) * (j + 1) <= probes]).T
    out = []
    for lo in range(0, len(x), ROWS):
        ys, zs = y[lo : lo + ROWS], z[lo : lo + ROWS]
        a, b = nearest_first(ys, m), nearest_first(zs, m)
        best = nearest_first(np.take_along_axis(ys, a[:, i], 1) + np.take_along_axis(zs, b[:, j], 1), probes)
        out.append(np.take_along_axis(a, i[best], 1) * y.shape[1] + np.take_along_axis(b, j[best], 1))
    return np.concatenate(out)


def fit(x: np.ndarray, tables: int, k: int = 5, every: int = 50, recall: float = RECALL) -> tuple[int, int, bool]:
    """(tables, probes, pairs) of the cheapest plan that finds so much of the k nearest, in the sample x, of its first rows, if
    one in `every` rows is a query; 0 probes: all rows in one bucket."""
    if len(x) <= k + 1:
        return 1, 0, False
    unit = x / np.sqrt((x * x).sum(1))[:, None]
    asked = min(128, len(x))
    near = unit[:asked] @ unit.T
    near[np.arange(asked), np.arange(asked)] = -np.inf
    truth = np.argpartition(-near, k, axis=1)[:, :k]
    best = (1.0 + COPY * (1 + 1 / every), 1, 0, False)
    width = 2 * (1 << max(0, x.shape[1] - 1).bit_length())
    for pairs in (False, True):
        total = min(PAIR_PROBES, width * width) if pairs else width
        # the probe at which each of the neighbours turns up, and what share of rows is looked at by then
        rank, seen = np.full(truth.shape, total), np.zeros(total)
        for t in range(tables):
            held, probed = buckets(unit, t, 1, pairs)[:, 0], buckets(unit[:asked], t, total, pairs)
            hit = held[truth][:, :, None] == probed[:, None, :]
            rank = np.minimum(rank, np.where(hit.any(2), hit.argmax(2), total))
            names, sizes = np.unique(held, return_counts=True)
            place = np.minimum(np.searchsorted(names, probed), len(names) - 1)
            seen += (np.where(names[place] == probed, sizes[place], 0).mean(0) / len(x)).cumsum()
            found = np.bincount(rank.reshape(-1), minlength=total + 1)[:total].cumsum() / truth.size
            enough = np.nonzero(found >= recall)[0]
            if len(enough):
                probes = int(enough[0]) + 1
                best = min(best, (seen[probes - 1] + COPY * (t + 1) * (1 + probes / every), t + 1, probes, pairs))
    return best[1:]


def few_copies(x: np.ndarray, k: int) -> np.ndarray:
    """x with the first k + 1 of equal rows."""
    _, name = np.unique(x, axis=0, return_inverse=True)
    name = name.reshape(-1)
    order = np.argsort(name, kind="stable")
    nth = np.arange(len(x)) - np.searchsorted(name[order], name[order])
    return x[np.sort(order[nth <= k])]


def usable(vector: str) -> Column:
    big = F.array_max(F.transform(vector, lambda x: F.abs(x.cast("double"))))
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double")))
    return F.col(vector).isNotNull() & (F.size(vector) > 0) & ~F.coalesce(bad, F.lit(True)) & (big > 0) & (big < float("inf"))


def _groups(batches, keys: list[str]):
    """(key, table) runs of equal keys; a run may come in several parts."""
    for b in batches:
        if not b.num_rows:
            continue
        k = np.stack([b.column(c).to_numpy().astype(np.int64) for c in keys])
        cuts = [0, *(np.nonzero((k[:, 1:] != k[:, :-1]).any(0))[0] + 1).tolist(), b.num_rows]
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            yield tuple(k[:, lo].tolist()), b.slice(lo, hi - lo)


def nearest(vectors: DataFrame, k: int = 5, every: int = 50, tables: int = TABLES) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest of vectors (vec_id, embedding) for each id divisible by `every`."""
    single = vectors.schema["embedding"].dataType.elementType.typeName() == "float"
    kind, v = (np.float32, "array<float>") if single else (np.float64, "array<double>")
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(v).alias("v"))
    v = scratch_table(v.filter(F.col("vec_id").isNotNull() & usable("v")).distinct(), "vectors")
    w = Window.partitionBy("v").orderBy("vec_id")
    base = v.withColumn("n", F.row_number().over(w)).filter(F.col("n") <= k + 1).drop("n")
    queries = v.filter(F.col("vec_id") % every == 0)
    # at most FIT vectors, the first by hash; each task hands on no more
    drawn = [np.array(r["v"], float) for r in v.select("v").orderBy(F.xxhash64("vec_id", F.lit("fit"))).limit(FIT).collect()]
    lengths = {dim: np.stack([x for x in drawn if len(x) == dim]) for dim in {len(x) for x in drawn}}
    plans = {dim: fit(few_copies(x / np.abs(x).max(1, keepdims=True), k), tables, k, every) for dim, x in lengths.items()}

    def hashed(asked: bool | None):
        """Rows of each bucket, for queries of each that they probe; None: one row for each vector, in one bucket for each length."""

        def run(batches):
            for b in batches:
                ids, lists = b.column(0).to_numpy(), b.column(1)
                size = np.diff(lists.offsets.to_numpy())
                flat = lists.flatten().to_numpy()
                at = np.concatenate([[0], np.cumsum(size)])
                for dim in np.unique(size).tolist():
                    rows = np.nonzero(size == dim)[0]
                    x = np.ascontiguousarray(flat[at[rows][:, None] + np.arange(dim)], kind)
                    unit = x.astype(float) / np.abs(x).max(1, keepdims=True)
                    raw = [r.tobytes() for r in x]
                    # a length that the sample lacks is rare: its rows are compared with each other
                    used, probes, pairs = plans.get(dim, (1, 0, False))
                    for t in range(used) if asked is not None and probes else [-1]:
                        a = buckets(unit, t, probes if asked else 1, pairs) if t >= 0 else np.zeros((len(rows), 1), np.int64)
                        n, p = a.shape
                        take = np.repeat(np.arange(n), p)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(n * p, dim, np.int32)), pa.array(np.full(n * p, t, np.int32)), pa.array(a.reshape(-1).astype(np.int64)), pa.array(ids[rows][take]), pa.array([raw[i] for i in take.tolist()], pa.binary())],
                            ["dim", "t", "axis", "id", "x"],
                        )

        return run

    schema = "dim int, t int, axis long, id long, x binary"
    place = ["dim", "t", "axis"]
    keys = [*place, "block"]

    def rerank(batches):
        at, ids, xs = None, [], []
        for (*key, q), rows in _groups(batches, [*keys, "q"]):
            if key != at:
                at, ids, xs = key, [], []
            some = rows.column("id").to_numpy()
            x = np.frombuffer(b"".join(rows.column("x").to_pylist()), kind).reshape(len(some), key[0]).astype(float)
            # by a power of two, which changes no cosine, so that squares neither overflow nor vanish
            x = np.ldexp(x, -np.frexp(np.abs(x).max(1, keepdims=True))[1])
            if not q:
                ids.append(some)
                xs.append(x)
                continue
            if len(ids) > 1:
                ids, xs = [np.concatenate(ids)], [np.concatenate(xs)]
            if not ids:
                continue
            own, base_x = ids[0], xs[0]
            base_n = np.sqrt((base_x * base_x).sum(1))
            for lo in range(0, len(some), 512):
                qid, qx = some[lo : lo + 512], x[lo : lo + 512]
                qn = np.sqrt((qx * qx).sum(1))
                s = qx @ base_x.T / base_n
                s[qid[:, None] == own] = -np.inf
                first = np.nonzero(np.concatenate([[True], own[1:] != own[:-1]]))[0]
                each = s if len(first) == len(own) else np.maximum.reduceat(s, first, axis=1)
                m = min(k, each.shape[1])
                # every row that rounding could put among the k best ids, so that ties are settled by exact score and id
                least = -np.partition(-each, m - 1, axis=1)[:, m - 1] - qn * (key[0] + 8) * 1e-15
                at_row, at_col = np.nonzero((s >= least[:, None]) & np.isfinite(s))
                score = np.empty(len(at_row))
                for i in range(0, len(at_row), PAIRS):
                    row, col = at_row[i : i + PAIRS], at_col[i : i + PAIRS]
                    score[i : i + PAIRS] = (qx[row] * base_x[col]).sum(1) / (qn[row] * base_n[col])
                order = np.lexsort((-score, own[at_col], at_row))
                row, vec, score = at_row[order], own[at_col[order]], score[order]
                fresh = np.concatenate([[True], (row[1:] != row[:-1]) | (vec[1:] != vec[:-1])])[: len(row)]
                row, vec, score = row[fresh], vec[fresh], score[fresh]
                order = np.lexsort((vec, -score, row))
                row, vec, score = row[order], vec[order], score[order]
                top = np.arange(len(row)) - np.searchsorted(row, row) < k
                yield pa.RecordBatch.from_arrays([pa.array(qid[row[top]]), pa.array(vec[top]), pa.array(score[top])], ["query_id", "vec_id", "score"])

    def met(stored: DataFrame, asked: DataFrame, few: bool = False) -> DataFrame:
        """query_id, vec_id, score of the rows that meet in a bucket, each block of which meets all queries of the bucket. few: buckets are so few that their sizes are broadcast."""
        blocks = stored.groupBy(place).agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
        blocks = F.broadcast(blocks) if few else blocks
        stored = stored.join(blocks, place).withColumn("block", F.pmod(F.xxhash64("id"), "blocks").cast("int")).drop("blocks")
        asked = asked.join(blocks, place).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
        both = stored.withColumn("q", F.lit(0)).unionByName(asked.withColumn("q", F.lit(1)))
        return both.repartition(*keys).sortWithinPartitions(*keys, "q", "id").select(*keys, "q", "id", "x").mapInArrow(rerank, "query_id long, vec_id long, score double")

    def ranked(pairs: DataFrame) -> DataFrame:
        found = pairs.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
        w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

    found = scratch_table(ranked(met(base.mapInArrow(hashed(False), schema), queries.mapInArrow(hashed(True), schema))), "found")
    full = found.filter(F.col("rank") == k).select(F.col("query_id").alias("vec_id"))
    short = scratch_table(queries.join(full, "vec_id", "left_anti"), "short")
    if short.isEmpty():
        return found
    lengths = short.select(F.size("v").alias("length")).distinct()
    same = base.withColumn("length", F.size("v")).join(F.broadcast(lengths), "length", "left_semi").drop("length")
    return ranked(found.select("query_id", "vec_id", "score").unionByName(met(same.mapInArrow(hashed(None), schema), short.mapInArrow(hashed(None), schema), few=True)))
