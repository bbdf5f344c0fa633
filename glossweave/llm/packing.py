"""Operator 7: packing token sequences by non-negative least squares.

A document of n ids (its tokens and an end id) gives n // window whole windows and a remainder of n % window ids. The
histogram of remainders (window - 1 counts, however many documents there are) goes to the driver. There shallow length
combinations that fill a window exactly (a + b, a + a + b, a + a + a + b) are columns of a matrix; non-negative least
squares finds how often to use each so that together they use up the histogram. Counts are rounded down and never use
more remainders of a length than there are. What is left is packed greedily: laid end to end in order of length and cut
at every window; the last rest is cut into powers of two. So no sequence needs padding.

Ranks within a length are gapless over the whole table; a remainder's combination, copy and place follow from its rank
by arithmetic, so no task holds more than its share. Null text counts as empty (the end id alone). Rows that repeat a
doc_id are packed each. Null doc_id is kept as null. A very long text is encoded by one task, and is one row until its windows
are pieces. Other columns are ignored, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glossweave.llm.common import released, scratch_table
from glossweave.llm.tokens import encoder

WINDOW, END_ID, SWEEPS = 1024, 0, 300


def combinations(window: int) -> list[tuple[int, ...]]:
    """Multisets of two, three or four lengths under window that fill it, the latter two with all but one length equal."""
    pairs = [(a, window - a) for a in range(1, window // 2 + 1)]
    triples = [(a, a, window - 2 * a) for a in range(1, (window - 1) // 2 + 1) if 3 * a != window]
    fours = [(a, a, a, window - 3 * a) for a in range(1, (window - 1) // 3 + 1) if 4 * a != window]
    return pairs + triples + fours


def solve(histogram: np.ndarray, combos: list[tuple[int, ...]], sweeps: int = SWEEPS) -> np.ndarray:
    """Non-negative least squares by cyclic coordinate descent: x >= 0 with A x close to histogram, A[l, j] the number of
    remainders of length l in combination j."""
    rest, x = histogram.astype(float).tolist(), [0.0] * len(combos)
    columns = []
    for c in combos:
        entries = sorted({n: c.count(n) for n in c}.items())
        columns.append((entries, float(sum(k * k for _, k in entries))))
    tolerance = 1e-9 * (1 + float(histogram.sum()))
    for _ in range(sweeps):
        moved = 0.0
        for j, (entries, norm) in enumerate(columns):
            step = max(-x[j], sum(k * rest[n] for n, k in entries) / norm)
            if step:
                x[j] += step
                moved = max(moved, abs(step))
                for n, k in entries:
                    rest[n] -= k * step
        if moved <= tolerance:
            break
    return np.array(x)


def plan(histogram: np.ndarray, window: int = WINDOW) -> dict:
    """How ranks of each length map to combinations.

    uses: rows (length, first rank, count of ranks, times in a copy, place of the first, first sequence, combination);
    used: ranks of each length taken by combinations; base: start of each length's other remainders in the residual
    stream; sequences: how many the combinations make; total: length of the residual stream.
    """
    combos = combinations(window)
    want = np.floor(solve(histogram, combos) + 1e-6).astype(np.int64)
    used, uses, sequence = np.zeros(window, np.int64), [], 0
    for j in np.nonzero(want)[0]:
        c = combos[j]
        counts = sorted({n: c.count(n) for n in c}.items())
        copies = int(min(want[j], *[(histogram[n] - used[n]) // k for n, k in counts]))
        if copies <= 0:
            continue
        place = 0
        for n, k in counts:
            uses.append((n, int(used[n]), copies * k, k, place, sequence, int(j)))
            used[n] += copies * k
            place += n * k
        sequence += copies
    left = (histogram - used) * np.arange(window)
    return {"uses": sorted(uses), "used": used, "base": np.concatenate([[0], np.cumsum(left)[:-1]]), "sequences": sequence, "total": int(left.sum()), "window": window}


def tail(total: int, window: int) -> list[tuple[int, int]]:
    """(start, length) of the sequences that the residual stream's last rest is cut into: powers of two, largest first."""
    at, out = total - total % window, []
    for bit in range(window.bit_length() - 1, -1, -1):
        if total % window & (1 << bit):
            out.append((at, 1 << bit))
            at += 1 << bit
    return out


class Placer:
    """pieces(length, rank) of a remainder: (start in it, length, sequence, offset); length 0 has none."""

    def __init__(self, p: dict):
        self.p, self.starts = p, {}
        for u in p["uses"]:
            firsts, rows = self.starts.setdefault(u[0], ([], []))
            firsts.append(u[1])
            rows.append(u)
        self.ends, self.whole = tail(p["total"], p["window"]), p["total"] // p["window"]

    def pieces(self, n: int, r: int) -> list[tuple[int, int, int, int]]:
        if n == 0:
            return []
        p, window, used = self.p, self.p["window"], int(self.p["used"][n])
        if r < used:
            firsts, rows = self.starts[n]
            _, first, _, times, place, sequence, _ = rows[bisect_right(firsts, r) - 1]
            return [(0, n, sequence + (r - first) // times, place + (r - first) % times * n)]
        at, own, rest = int(p["base"][n]) + (r - used) * n, [], n
        while rest:
            if at // window < self.whole:
                begin, size, sequence = at // window * window, window, at // window
            else:
                i = next(i for i, (s, m) in enumerate(self.ends) if at < s + m)
                begin, size, sequence = *self.ends[i], self.whole + i
            take = min(rest, begin + size - at)
            own.append((n - rest, take, p["sequences"] + sequence, at - begin))
            at, rest = at + take, rest - take
        return own


def pack(docs: DataFrame, tokenizer: str, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset of each piece of docs (doc_id, text).

    Texts are encoded once and never shuffled: the task that encodes a document stores checksums of its whole windows
    and the ids of its remainder. Ranks need no order of documents, so each task counts on its own in every remainder,
    and the counts of earlier tasks (a row for each task and remainder) are joined to its rows.
    """
    end = end_id.to_bytes(4, "little")
    kind = np.dtype("<u2") if max(encoder(tokenizer, "byte").whole.get_vocab_size(), end_id + 1) <= 2**16 else np.dtype("<u4")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))

    def encode(batches):
        enc, part, seen, fulls = encoder(tokenizer, "byte"), TaskContext.get().partitionId(), np.zeros(window, np.int64), np.zeros(window, np.int64)
        for b in batches:
            rows = []
            for text in b.column(1).to_pylist():
                ids = enc.encode(text) + end
                full, rem = divmod(len(ids) // 4, window)
                crcs = [zlib.crc32(ids[4 * window * i : 4 * window * (i + 1)]) for i in range(full)]
                rest = np.frombuffer(ids, np.uint32, rem, 4 * window * full).astype(kind).tobytes()
                rows.append((part, len(ids) // 4, rem, crcs, rest, int(seen[rem]), int(fulls[rem])))
                seen[rem] += 1
                fulls[rem] += full
            types = [pa.int32(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.binary(), pa.int64(), pa.int64()]
            cols = [pa.array(c, t) for c, t in zip(list(zip(*rows, strict=True)) or [[]] * 7, types, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], ["doc_id", "part", "n", "rem", "crcs", "rest", "rank", "before"])

    coded = scratch_table(texts.mapInArrow(released(encode, lambda: encoder(tokenizer, "byte").pieces), "doc_id long, part int, n long, rem int, crcs array<long>, rest binary, rank long, before long"), "coded")
    full = (F.col("n") / window).cast("long")
    ends = scratch_table(coded.groupBy("rem", "part").agg(F.count(F.lit(1)).alias("_n"), F.sum(full).alias("_f")), "ends")
    histogram, windows = np.zeros(window, np.int64), np.zeros(window, np.int64)
    for row in ends.groupBy("rem").agg(F.sum("_n").alias("n"), F.sum("_f").alias("f")).collect():  # at most `window` rows
        histogram[row["rem"]], windows[row["rem"]] = row["n"], row["f"]
    histogram[0] = 0
    p = plan(histogram, window)
    first_full = p["sequences"] + p["total"] // window + len(tail(p["total"], window)) + np.concatenate([[0], np.cumsum(windows)[:-1]])
    w = Window.partitionBy("rem").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = ends.select("rem", "part", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_n0"), F.coalesce(F.sum("_f").over(w), F.lit(0)).alias("_f0"))
    # the same join at every size
    ranked = coded.join(starts.hint("merge"), ["rem", "part"])
    ranked = ranked.select("doc_id", "n", "rem", "crcs", "rest", (F.col("rank") + F.col("_n0")).alias("rank"), (F.col("before") + F.col("_f0")).alias("before"))

    def place(batches):
        placer = Placer(p)
        for b in batches:
            out = []
            for doc, n, rem, crcs, rest, rank, before in zip(*[c.to_pylist() for c in b.columns], strict=True):
                at = int(first_full[rem]) + before
                out += [(doc, i * window, window, crc, n, at + i, 0) for i, crc in enumerate(crcs)]
                ids = np.frombuffer(rest, kind).astype("<u4").tobytes()
                out += [(doc, n - rem + s, m, zlib.crc32(ids[4 * s : 4 * (s + m)]), n, q, o) for s, m, q, o in placer.pieces(rem, rank)]
            cols = list(zip(*out, strict=True)) or [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    return ranked.mapInArrow(released(place), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
