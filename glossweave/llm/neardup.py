"""Operator 2: near-duplicates by MinHash with sequential Bayesian verification.

1. Each text becomes its set of word shingles (64-bit hashes); rows of equal sets are one class, a node with a number of its own,
   however often the set or a doc_id repeats. Only classes are compared.
2. A class's MinHash signature (up to ROWS hashes for each band) is banded; classes that share a band's key are candidates.
3. Candidates in a bucket are compared batch after batch of signature places. With a uniform prior, after n places with
   m matches the posterior chance that the similarity reaches the threshold is P(Bin(n + 1, t) <= m); a pair goes when
   it is under MISS. Survivors of a bucket are returned as a forest, not as all pairs.
4. Components of survivors are clusters. Inside a cluster the survivors' full sets are compared exactly, and components
   of exact links are the answer. A cluster over CLUSTER nodes is cut into blocks which first meet themselves and PIVOTS
   of its nodes; what that links is one part. Then only blocks meet that hold different parts and sizes that could link.

A linked pair shares no band with chance (1 - t^rows)^bands; there are as many bands as keep that under LOST at the
threshold (30 for 0.85, 46 for 0.8), and it is far less above it. Low thresholds take fewer rows for a band.
Buckets and clusters over a bound are cut into blocks and compared block against block, so nothing unbounded meets in
one task and no pair is left out. Near copies that lie below the threshold of each other cost block pairs.

Null or blank text: no shingles, linked with nothing. Rows that repeat a text are linked; rows that share a doc_id are
one document, whose classes are linked without a comparison. Null doc_id: component_id null, kept. An empty table gives no rows. A very long text is read whole by one
task, and so are two of them when they are compared. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glossweave.llm.common import released, scratch_table, spread_join
from glossweave.llm.components import connected_components

ROWS, BATCH, LOST, MISS = 6, 36, 1e-6, 1e-9
MOST_BANDS = 256
BUCKET, CLUSTER, SHINGLES, PIVOTS, PAIRS = 1024, 512, 4_000_000, 16, 500_000
_random = np.random.default_rng(7)
MULTIPLIERS = _random.integers(0, 2**63, ROWS * MOST_BANDS, np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
PLACES = _random.integers(0, 2**63, 8, np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)


class _Hashes(dict):
    def __missing__(self, word):
        if len(self) > 200_000:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value


_hashes = _Hashes()


def word_hashes() -> dict:
    """The cache of this Python worker."""
    return _hashes


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingle_sets(texts: list, width: int = 5) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; null counts as empty."""
    words = [(t or "").encode().lower().split() for t in texts]
    sizes = [len(w) for w in words]
    flat = np.fromiter((_hashes[w] for ws in words for w in ws), np.uint64, sum(sizes))
    n = max(0, len(flat) - width + 1)
    mixed = np.zeros(n, np.uint64)
    for j in range(width):
        mixed += flat[j : j + n] * PLACES[j]
    mixed = _mix(mixed)
    out, at = [], 0
    for size in sizes:
        if size >= width:
            out.append(np.unique(mixed[at : at + size - width + 1]))
        elif size:
            out.append(_mix((flat[at : at + size] * PLACES[:size]).sum(keepdims=True) + PLACES[7:] * np.uint64(size)))
        else:
            out.append(np.zeros(0, np.uint64))
        at += size
    return out


def banding(threshold: float) -> tuple[int, int]:
    """(rows, bands): the most rows up to ROWS, and the bands, that lose a pair at the threshold with chance under LOST."""
    for rows in range(ROWS, 0, -1):
        bands = max(1, math.ceil(math.log(LOST) / math.log1p(-min(threshold, 1 - 1e-9) ** rows)))
        if bands <= MOST_BANDS:
            return rows, bands
    raise ValueError(f"a threshold of {threshold} needs over {MOST_BANDS} bands")


def signatures(sets: list[np.ndarray], rows: int, bands: int) -> tuple[np.ndarray, np.ndarray]:
    """For non-empty sets: a byte for each signature place, and a key for each band."""
    if not sets:
        return np.zeros((0, rows * bands), np.uint8), np.zeros((0, bands), np.int64)
    flat = np.concatenate(sets)
    starts = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    least = np.empty((len(sets), rows * bands), np.uint64)
    product = np.empty_like(flat)
    for i, a in enumerate(MULTIPLIERS[: rows * bands]):
        np.multiply(flat, a, out=product)
        least[:, i] = np.minimum.reduceat(product, starts)
    keys = np.zeros((len(sets), bands), np.uint64)
    for r in range(rows):
        keys += least[:, r::rows] * PLACES[r]
    keys = _mix(keys + np.arange(bands, dtype=np.uint64) * PLACES[6])
    return ((least >> np.uint64(20)) & np.uint64(255)).astype(np.uint8), keys.view(np.int64)


def _in_blocks(texts: list, most: int = 400_000):
    """Runs of texts of about `most` characters, one text at least."""
    at = size = 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= most:
            yield texts[at : i + 1]
            at, size = i + 1, 0
    if at < len(texts):
        yield texts[at:]


def sign(docs: DataFrame, rows: int, bands: int, width: int = 5) -> DataFrame:
    """doc_id, text_key, n_shingles, set_key (of the whole set), sig, bands of docs (doc_id, text); the last three null without shingles."""

    def run(batches):
        for b in batches:
            counts, prints, sigs, all_keys = [], [], [], []
            for texts in _in_blocks(b.column(1).to_pylist()):
                sets = shingle_sets(texts, width)
                sig, keys = signatures([s for s in sets if len(s)], rows, bands)
                i = 0
                for s in sets:
                    counts.append(len(s))
                    prints.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                    sigs.append(sig[i].tobytes() if len(s) else None)
                    all_keys.append(keys[i] if len(s) else None)
                    i += len(s) > 0
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(counts, pa.int64()), pa.array(prints, pa.binary()), pa.array(sigs, pa.binary()), pa.array(all_keys, pa.list_(pa.int64()))], ["doc_id", "text_key", "n_shingles", "set_key", "sig", "bands"])

    return keyed_texts(docs).mapInArrow(released(run, word_hashes), "doc_id long, text_key long, n_shingles long, set_key binary, sig binary, bands array<long>")


def keyed_texts(docs: DataFrame) -> DataFrame:
    """doc_id, text, text_key: a hash that tells the texts of one doc_id apart."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_key"))


def least_matches(threshold: float, places: int, batch: int, miss: float) -> list[tuple[int, int]]:
    """(n, fewest matches that survive) after each batch. Signature bytes also match by chance, 1 in 256."""
    t = threshold + (1 - threshold) / 256
    out = []
    for n in [*range(batch, places, batch), places]:
        below, m = 0.0, -1
        while below < miss and m < n:
            m += 1
            below += math.comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
        out.append((n, m))
    return out


def _labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest row connected with each of n rows by pairs (a, b)."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _runs(batches, columns: list[str]):
    """Record batches as dicts of arrays that end where the run of equal leading keys ends."""
    held = None
    for b in batches:
        t = pa.Table.from_batches([b])
        t = pa.concat_tables([held, t]) if held is not None else t
        if not t.num_rows:
            continue
        keys = np.stack([t.column(c).to_numpy() for c in columns])
        other = np.nonzero((keys != keys[:, -1:]).any(0))[0]
        cut = other[-1] + 1 if len(other) else 0
        held = t.slice(cut)
        if cut:
            yield t.slice(0, cut).combine_chunks()
    if held is not None and held.num_rows:
        yield held.combine_chunks()


def _block_pairs(df: DataFrame, blocks) -> DataFrame:
    """A row for each pair of blocks (bi <= bj) that the row's node takes part in."""
    d = df.withColumn("_n", blocks.cast("int")).withColumn("_b", F.pmod(F.xxhash64("node"), "_n").cast("int"))
    d = d.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    return d.select(*df.columns, F.least("_b", "_o").alias("bi"), F.greatest("_b", "_o").alias("bj"))


def survivors(nodes: DataFrame, places: int, threshold: float, miss: float = MISS) -> DataFrame:
    """u, v: for each bucket of nodes (node, sig of so many places, bands), a forest over pairs that Bayesian pruning leaves."""
    rows = nodes.select("node", F.explode("bands").alias("key"))
    shared = rows.groupBy("key").agg(F.count(F.lit(1)).alias("m")).filter("m > 1")
    placed = _block_pairs(rows.join(shared, "key"), F.ceil(F.col("m") / BUCKET)).drop("m").join(nodes.select("node", "sig"), "node")
    steps = least_matches(threshold, places, BATCH, miss)

    def run(batches):
        for t in _runs(batches, ["key", "bi", "bj"]):
            node = t.column("node").to_numpy()
            sig = np.frombuffer(b"".join(t.column("sig").to_pylist()), np.uint8).reshape(len(node), -1)
            keys = np.stack([t.column(c).to_numpy().astype(np.int64) for c in ("key", "bi", "bj")])
            new = np.concatenate([[True], (keys[:, 1:] != keys[:, :-1]).any(0)])
            group = np.cumsum(new)
            one, two = [], []
            for k in range(1, len(node)):
                a = np.nonzero(group[:-k] == group[k:])[0]
                if not len(a):
                    break
                matches, at = np.zeros(len(a), np.int32), 0
                for n, fewest in steps:
                    matches += (sig[a, at:n] == sig[a + k, at:n]).sum(1, dtype=np.int32)
                    keep = matches >= fewest
                    a, matches, at = a[keep], matches[keep], n
                    if not len(a):
                        break
                one.append(a)
                two.append(a + k)
                if sum(map(len, one)) > PAIRS:
                    # as many pairs as make the same forest
                    label = _labels(len(node), np.concatenate(one), np.concatenate(two))
                    own = np.nonzero(label != np.arange(len(node)))[0]
                    one, two = [own], [label[own]]
            if one:
                label = _labels(len(node), np.concatenate(one), np.concatenate(two))
                own = label != np.arange(len(node))
                yield pa.RecordBatch.from_arrays([pa.array(node[own]), pa.array(node[label[own]])], ["u", "v"])

    # rows come sorted, so that runs of a key are whole
    return placed.repartition("key", "bi", "bj").sortWithinPartitions("key", "bi", "bj", "node").select("key", "bi", "bj", "node", "sig").mapInArrow(released(run), "u long, v long").distinct()


def _links(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """Which pairs of sets hold 100 * both >= percent * either."""
    n = np.array([len(s) for s in sets], np.int64)
    _, place, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row, shared = np.repeat(np.arange(len(sets)), n), count > 1
    column, keep = np.cumsum(shared)[place] - 1, shared[place]
    row, column, total = row[keep], column[keep], int(shared.sum())
    both = np.zeros((len(sets), len(sets)), np.float64)
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    for low in range(0, total, 4096):
        a, b = np.searchsorted(column, [low, low + 4096])
        m = np.zeros((len(sets), min(4096, total - low)), np.float32)
        m[row[a:b], column[a:b] - low] = 1
        both += m @ m.T
    both = np.rint(both).astype(np.int64)
    return (100 * both >= percent * (n[:, None] + n[None, :] - both)) & (both > 0)


def _compare(placed: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """u, v: a forest over the linked pairs among the nodes placed (node, meeting: long) at one meeting."""

    def run(batches):
        for t in _runs(batches, ["meeting"]):
            node, held = t.column("node").to_numpy(), [np.frombuffer(x, np.uint64) for x in t.column("set").to_pylist()]
            key = t.column("meeting").to_numpy()
            cuts = [0, *(np.nonzero(key[1:] != key[:-1])[0] + 1).tolist(), len(node)]
            us, vs = [], []
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                if hi - lo > 1:
                    a, b = np.nonzero(np.triu(_links(held[lo:hi], percent), 1))
                    label = _labels(hi - lo, a, b)
                    own = np.nonzero(label != np.arange(hi - lo))[0]
                    us.append(node[lo + own])
                    vs.append(node[lo + label[own]])
            if us:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(us)), pa.array(np.concatenate(vs))], ["u", "v"])

    ordered = placed.join(sets, "node").repartition("meeting").sortWithinPartitions("meeting", "node")
    return ordered.select("meeting", "node", "set").mapInArrow(released(run), "u long, v long").distinct()


def exact_links(docs: DataFrame, clusters: DataFrame, rows: int, percent: int, width: int = 5) -> DataFrame:
    """u, v: edges whose components are those of the pairs of a cluster (node, cluster, n_shingles, and doc_id and text_key of a
    row with the node's text; at most so many rows) that hold 100 * both >= percent * either."""

    def run_sets(batches):
        for b in batches:
            sets = [s.tobytes() for texts in _in_blocks(b.column(1).to_pylist()) for s in shingle_sets(texts, width)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sets, pa.binary())], ["node", "set"])

    # rows that repeat doc_id and text leave in the task that reads them, but one
    texts = keyed_texts(docs).filter("doc_id is not null").groupBy("doc_id", "text_key").agg(F.first("text").alias("text"))
    # the same join at every size: whether the cluster's nodes would fit a broadcast must not change the plan
    wanted = texts.join(clusters.select("doc_id", "text_key", "node").hint("merge"), ["doc_id", "text_key"])
    sets = scratch_table(wanted.select("node", "text").mapInArrow(released(run_sets, word_hashes), "node long, set binary"), "sets")
    size = clusters.groupBy("cluster").agg(F.count(F.lit(1)).alias("m"), F.sum("n_shingles").alias("s"))
    blocks = F.ceil(F.greatest(F.col("m") / CLUSTER, F.col("s") / SHINGLES))
    members = scratch_table(spread_join(clusters.select("node", "cluster", "n_shingles"), size.select("cluster", "m", blocks.alias("blocks")), "cluster", "m"), "members", "none", rows)
    small, large = members.filter("blocks = 1"), members.filter("blocks > 1")
    found = scratch_table(_compare(small.select("node", F.col("cluster").alias("meeting")), sets, percent), "links", "none", rows)
    if large.isEmpty():
        return found
    large = scratch_table(large.withColumn("block", F.pmod(F.xxhash64("node", F.lit("block")), "blocks")), "large", "none", rows)
    # each block meets itself and the pivots of its cluster
    chosen = Window.partitionBy("cluster").orderBy(F.xxhash64("node", F.lit("pivot")), "node")
    pivots = large.withColumn("_n", F.row_number().over(chosen)).filter(F.col("_n") <= PIVOTS)
    meet = F.xxhash64("cluster", "block", F.lit("own"))
    both = large.select("node", meet.alias("meeting")).unionByName(pivots.select("node", "cluster", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block")).select("node", meet.alias("meeting")))
    first = scratch_table(_compare(both.distinct(), sets, percent), "links", "none", rows)
    parts = connected_components(first, rows).withColumnRenamed("component", "part")
    large = large.drop("block").join(parts, "node", "left").withColumn("part", F.coalesce("part", "node"))
    weight = large.groupBy("cluster", "part").agg(F.count(F.lit(1)).alias("p"), F.ceil(F.greatest(F.count(F.lit(1)) / CLUSTER, F.sum("n_shingles") / SHINGLES)).alias("cuts"))
    large = large.join(weight.hint("merge"), ["cluster", "part"])
    # a part over a block's size has blocks of its own; smaller ones share blocks, by size of sets
    own = F.col("p") >= CLUSTER
    name = F.when(own, F.xxhash64("part", F.pmod(F.xxhash64("node"), F.col("cuts")))).otherwise(F.xxhash64(F.floor(F.log("n_shingles") / F.log(F.lit(200.0 / (100 + percent)))), F.pmod(F.xxhash64("part"), "blocks")))
    large = scratch_table(large.select("node", "cluster", "n_shingles", F.when(own, F.col("part")).alias("part"), name.alias("block")), "large", "none", rows)
    ranges = large.groupBy("cluster", "block").agg(F.min("n_shingles").alias("low"), F.max("n_shingles").alias("high"), F.max("part").alias("part"), F.count(F.lit(1)).alias("n"))
    one, two = ranges.alias("a"), ranges.alias("b")
    near = (100 * F.least("a.high", "b.high") >= percent * F.greatest("a.low", "b.low")) & ~F.coalesce(F.col("a.part") == F.col("b.part"), F.lit(False))
    pairs = one.join(two, "cluster").filter((F.col("a.block") <= F.col("b.block")) & near)
    meetings = pairs.select("cluster", F.xxhash64("cluster", "a.block", "b.block").alias("meeting"), F.explode(F.array_distinct(F.array("a.block", "b.block"))).alias("block"))
    second = _compare(large.select("node", "cluster", "block").join(meetings.hint("merge"), ["cluster", "block"]).select("node", "meeting"), sets, percent)
    return found.unionByName(first).unionByName(second)


def same_document(rows: DataFrame, classes: DataFrame) -> DataFrame | None:
    """u, v: edges between the classes (set_key, node) of each doc_id of rows (doc_id, set_key) that has several; None if none has."""
    key = F.xxhash64("set_key")
    several = rows.groupBy("doc_id").agg(F.min(key).alias("a"), F.max(key).alias("b")).filter("a <> b").select("doc_id")
    if several.isEmpty():
        return None
    each = rows.join(several.hint("merge"), "doc_id", "left_semi").distinct().join(classes.hint("merge"), "set_key").select("doc_id", "node")
    each = scratch_table(each, "several")
    first = each.groupBy("doc_id").agg(F.min("node").alias("u"), F.count(F.lit(1)).alias("m"))
    return spread_join(each, first, "doc_id", "m").select("u", F.col("node").alias("v"))


def near_duplicates(docs: DataFrame, percent: int = 80, width: int = 5) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of docs (doc_id, text); links from `percent` of common to all shingles."""
    rows, bands = banding(percent / 100)
    signed = scratch_table(sign(docs, rows, bands, width), "signed")
    n = signed.count()
    least = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "text_key"))).alias("least")
    grouped = signed.filter("set_key is not null").groupBy("set_key").agg(least, *[F.first(c).alias(c) for c in ("n_shingles", "sig", "bands")], F.count(F.lit(1)).alias("m"))
    # numbered where they are written, once
    numbered = grouped.filter("least is not null").select("set_key", F.monotonically_increasing_id().alias("node"), "least.*", "n_shingles", "m", "sig", "bands")
    classes = scratch_table(numbered, "classes")
    clusters = connected_components(survivors(classes.select("node", "sig", "bands"), rows * bands, percent / 100), n)
    most = clusters.rows
    clusters = clusters.withColumnRenamed("component", "cluster")
    sized = scratch_table(clusters.join(classes.select("node", "doc_id", "text_key", "n_shingles").hint("merge"), "node"), "clusters", "none", most)
    links = exact_links(docs, sized, most, percent, width)
    same = same_document(signed.filter("set_key is not null and doc_id is not null").select("doc_id", "set_key"), classes.select("set_key", "node"))
    found = connected_components(links if same is None else links.unionByName(same), most if same is None else n)
    # a component is known by its smallest doc_id
    members = scratch_table(found.join(classes.select("node", "doc_id").hint("merge"), "node"), "components", "none", found.rows)
    lowest = members.groupBy("component").agg(F.min("doc_id").alias("lowest"), F.count(F.lit(1)).alias("m"))
    ends = spread_join(members.select("node", "component"), lowest, "component", "m").select("node", "lowest")
    labelled = classes.select("set_key", "node", "doc_id", "m").join(ends.hint("merge"), "node", "left").select("set_key", F.coalesce("lowest", "doc_id").alias("component"), "m")
    out = spread_join(signed.select("doc_id", "n_shingles", "set_key"), scratch_table(labelled, "labelled", "none", n), "set_key", "m", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == F.col("component"), F.lit(True)).alias("kept"))
