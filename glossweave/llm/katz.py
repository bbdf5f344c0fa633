"""Operator 9: language-model scores with Katz backoff, of any order (3 unless told otherwise).

Tokens are the words of a text, A-Z lower-cased, and one end. A token is predicted from the `order` - 1 symbols before it
in its text, of which one start symbol is the first. For an n-gram hw of count c(hw) > 0

    P(w | h) = d(c(hw)) * c(hw) / c(h),                                     else  P(w | h) = alpha(h) * P(w | h'),

where h' is h without its first symbol, and alpha(h) = (1 - sum of P(w | h) over w seen after h) / (1 - sum of P(w | h')
over the same w) is exact; a history that was not seen backs off with weight 1. A count r up to K is discounted by
Good-Turing's d_r of its order (absolute discounting where the counts of counts do not allow it), a larger one by EPS, so
that every history has mass left for unseen words. Single words are discounted the same way and give what that saves to
one unknown token. So the chances of all known words, the end and the unknown token add up to 1 after every history.

How it runs. Texts are cut into blocks of about BLOCK tokens, which are stored. For each order, a block sends its distinct
n-grams once, with their training counts, to the partition that owns the range of their hashes. The partition adds them up
and stores, for each block, the totals of the block's n-grams: the count tables, partitioned by order and hash. Each block
is then scored from the longest n-gram down. Where it must back off it asks for alpha of the history; the sums that make
alpha up travel from the blocks that own the n-grams to the partition that owns the history, and from there to those who ask.

Memory: a task holds one block, or the n-grams of one of `parts` hash ranges, whose number grows with the blocks. An n-gram
in a third of all texts is one entry of each block. Only a few totals go to the driver. Very long texts make a block of
their own. Tables and shuffles that nothing reads any more are removed as the steps end.

Null or blank text is the end alone. Null doc_id: not held out. Rows that repeat count, and are scored, each. Without
training tokens scores are null; an empty table gives no rows. Symbols are known by 64-bit hashes. Other columns are ignored.
"""

from __future__ import annotations

from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossweave.llm.common import forget, scratch_buckets, scratch_table

ORDER, BLOCK, BLOCKS_PER_PART, K, EPS = 3, 500_000, 4, 5, 1e-3
#: Symbols and keys are even: their last bit is free for a mark.
START, END, LAST = np.uint64(2), np.uint64(4), np.uint64(1)


class _Hashes(dict):
    def __missing__(self, word):
        if len(self) > 400_000:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word) & ~1 if word else int(END)
        return value


_hashes = _Hashes()


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The sorted distinct keys, a place of each in keys, and for each of keys its place among them."""
    order = np.argsort(keys)
    rising = keys[order]
    new = np.concatenate([[True], rising[1:] != rising[:-1]])[: len(keys)]
    place = np.empty(len(keys), np.int64)
    place[order] = np.cumsum(new) - 1
    return rising[new], order[new], place


def join(history: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The key of the n-gram that is made of a history, known by its key, and a word."""
    x = (history ^ (history >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + word
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    return (x ^ (x >> np.uint64(29))) & ~LAST


def squeeze(values: np.ndarray) -> bytes:
    """A numpy array as bytes: the lowest bytes of all values first, then the next, compressed."""
    width = values.dtype.itemsize
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(-1, width).T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def unsqueeze(raw: bytes, dtype) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8).reshape(np.dtype(dtype).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(dtype).reshape(-1)


def squeeze_rising(keys: np.ndarray) -> bytes:
    """Sorted uint64 keys, as the steps between them."""
    return squeeze(np.diff(keys, prepend=np.uint64(0)))


def unsqueeze_rising(raw: bytes) -> np.ndarray:
    return np.cumsum(unsqueeze(raw, np.uint64), dtype=np.uint64)


def batch(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=schema)


def held_out():
    """crc32 of the id as text, mod 5, is 1; a null id is not held out."""
    return F.coalesce(F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 5 == 1, F.lit(False))


BLOCKS = "block long, doc_ids array<long>, held array<boolean>, lengths array<int>, words binary, stream binary"


def blocks(docs: DataFrame) -> DataFrame:
    """Runs of documents: their ids, which are held out, their lengths in tokens, the sorted distinct symbols (START and END
    among them), and for each token the place of its symbol."""
    schema = pa.schema([("block", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("held", pa.list_(pa.bool_())), ("lengths", pa.list_(pa.int32())), ("words", pa.binary()), ("stream", pa.binary())])

    def run(batches):
        part, number, rows, size = TaskContext.get().partitionId(), 0, [], 0

        def block():
            lengths = [len(w) for _, w, _ in rows]
            flat = np.fromiter(map(_hashes.__getitem__, chain.from_iterable(w for _, w, _ in rows)), np.uint64, sum(lengths))
            words, _, stream = distinct(np.concatenate([flat, [START, END]]))
            return batch([{"block": part << 32 | number, "doc_ids": [r[0] for r in rows], "held": [r[2] for r in rows], "lengths": lengths, "words": squeeze_rising(words), "stream": squeeze(stream[:-2].astype(np.uint32))}], schema)

        for b in batches:
            for d, t, held in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                words = (t or "").encode().lower().split()
                words.append(b"")
                rows.append((d, words, held))
                size += len(words)
                if size >= BLOCK:
                    yield block()
                    number, rows, size = number + 1, [], 0
        if rows:
            yield block()

    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", held_out().alias("held"))
    return d.mapInArrow(run, BLOCKS)


class Block:
    """A block's tokens. Arrays run over tokens; `at` is a token's place in its text."""

    def __init__(self, row: dict):
        self.number, self.doc_ids, self.held, self.lengths = row["block"], row["doc_ids"], np.array(row["held"], bool), np.array(row["lengths"], np.int64)
        self.words, self.stream = unsqueeze_rising(row["words"]), unsqueeze(row["stream"], np.uint32).astype(np.int64)
        first = np.cumsum(self.lengths) - self.lengths
        self.doc = np.repeat(np.arange(len(self.lengths)), self.lengths)
        self.at = np.arange(len(self.stream)) - first[self.doc]
        self.train = ~self.held[self.doc]

    def before(self, values: np.ndarray, start) -> np.ndarray:
        """The value of the token before each token; start for a text's first token."""
        out = np.empty_like(values)
        out[1:] = values[:-1]
        out[self.at == 0] = start
        return out

    def keys(self, order: int) -> tuple[np.ndarray, np.ndarray]:
        """The tokens that end an n-gram of an order from 2, and the n-grams' keys."""
        word = self.words[self.stream]
        key = word
        for _ in range(order - 1):
            key = join(self.before(key, START), word)
        tokens = np.nonzero(self.at >= order - 2)[0]
        return tokens, key[tokens]

    def counted(self, order: int, top: int) -> tuple[np.ndarray, np.ndarray]:
        """The sorted distinct keys of an order, and for each 2 * its training count, plus 1 if a held-out text may ask for its
        alpha. Order 1 has START too, which counts texts."""
        if order == 1:
            counts = np.bincount(self.stream[self.train], minlength=len(self.words)) * 2
            counts += np.bincount(self.stream[~self.train], minlength=len(self.words)) > 0
            counts[np.searchsorted(self.words, START)] = 2 * int((~self.held).sum()) + int(self.held.any())
            return self.words, counts
        tokens, keys = self.keys(order)
        marked = np.sort(keys | (~self.train[tokens]).astype(np.uint64))
        names = marked & ~LAST
        first = np.nonzero(np.concatenate([[True], names[1:] != names[:-1]])[: len(names)])[0]
        if not len(first):
            return names, np.zeros(0, np.int64)
        held = np.add.reduceat((marked & LAST).astype(np.int64), first)
        counts = 2 * (np.diff(first, append=len(names)) - held)
        return names[first], counts + (held > 0) if order < top else counts


def ranges(keys: np.ndarray, parts: int):
    """(part, slice) of sorted keys, for each of so many equal ranges of hashes that has any."""
    part = ((keys >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
    cuts = np.concatenate([[0], np.nonzero(part[1:] != part[:-1])[0] + 1, [len(part)]]).tolist()
    for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
        if hi > lo:
            yield int(part[lo]), slice(lo, hi)


def send_counts(cut: DataFrame, order: int, top: int, parts: int) -> DataFrame:
    """part, block, keys and counts: 2 * training count, plus 1 if a held-out text may ask for the n-gram's alpha."""
    schema = pa.schema([("part", pa.int64()), ("block", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary())])

    def run(batches):
        for b in batches:
            for row in b.to_pylist():
                own = Block(row)
                keys, counts = own.counted(order, top)
                yield batch([{"part": p, "block": own.number, "keys": squeeze_rising(keys[s]), "counts": squeeze(counts[s].astype(np.uint32))} for p, s in ranges(keys, parts)], schema)

    return cut.mapInArrow(run, "part long, block long, keys binary, counts binary")


ANSWERS = "block long, ngram int, part long, totals binary, stats array<long>"


def add_up(sent: DataFrame, order: int) -> DataFrame:
    """For each block and part, 4 * total of each of the block's n-grams, plus 2 if some text may ask, plus 1 where the block
    owns it. Rows of block -1 hold n_1 to n_(K+1), the sum of totals and the number of n-grams seen."""
    schema = pa.schema([("block", pa.int64()), ("ngram", pa.int32()), ("part", pa.int64()), ("totals", pa.binary()), ("stats", pa.list_(pa.int64()))])

    def run(t: pa.Table) -> pa.Table:
        rows = sorted(t.to_pylist(), key=lambda r: r["block"])
        keys, counts = [unsqueeze_rising(r["keys"]) for r in rows], np.concatenate([unsqueeze(r["counts"], np.uint32) for r in rows]).astype(np.int64)
        names, _, at = distinct(np.concatenate(keys))
        total = np.rint(np.bincount(at, counts >> 1, len(names))).astype(np.int64)
        asked = np.bincount(at, counts & 1, len(names)) > 0
        seen = np.nonzero(counts >> 1)[0]
        answer = total[at] * 4 + asked[at] * 2
        owner = np.full(len(names), -1)
        owner[at[seen[::-1]]] = seen[::-1]  # the first block that has it
        answer[owner[owner >= 0]] += 1
        real = total[(total > 0) & (names != START)] if order == 1 else total[total > 0]
        stats = [*np.bincount(np.minimum(real, K + 2), minlength=K + 3)[1 : K + 2].tolist(), int(real.sum()), len(real)]
        part, out, lo = rows[0]["part"], [], 0
        for r, k in zip(rows, keys, strict=True):
            out.append({"block": r["block"], "ngram": order, "part": part, "totals": squeeze(answer[lo : lo + len(k)]), "stats": None})
            lo += len(k)
        return pa.Table.from_pylist([*out, {"block": -1, "ngram": order, "part": part, "totals": None, "stats": stats}], schema=schema)

    return sent.groupBy("part").applyInArrow(run, ANSWERS)


def discounts(count_of_counts: list[int]) -> np.ndarray:
    """d_0 (unused), d_1 .. d_K, and d of larger counts, from n_1 .. n_(K+1)."""
    n = [0, *count_of_counts]
    out = np.full(K + 2, 1 - EPS)
    tail = (K + 1) * n[K + 1] / n[1] if n[1] else 1.0
    good = all(n[1 : K + 2]) and tail < 1
    if good:
        turing = [((r + 1) * n[r + 1] / (n[r] * r) - tail) / (1 - tail) for r in range(1, K + 1)]
        good = all(0 < d < 1 for d in turing)
    if not good:
        absolute = n[1] / (n[1] + 2 * n[2]) if n[1] and n[2] else 0.5
        turing = [(r - absolute) / r for r in range(1, K + 1)]
    out[1 : K + 1] = turing
    return out


class Model:
    """What holds for the whole corpus: the discounts of each order, the tokens and types, and the unknown token's chance."""

    def __init__(self, stats: dict[int, list[int]]):
        self.order = max(stats)
        self.d = {k: discounts(s[: K + 1]) for k, s in stats.items()}
        self.tokens, self.types = stats[1][K + 1], stats[1][K + 2]
        small = sum(r * n for r, n in enumerate(stats[1][:K], 1))
        kept = sum(r * n * self.d[1][r] for r, n in enumerate(stats[1][:K], 1)) + (self.tokens - small) * self.d[1][K + 1]
        self.unknown = (self.tokens - kept) / self.tokens if self.tokens else 1.0

    def gain(self, order: int, count: np.ndarray) -> np.ndarray:
        """The discounted count."""
        return self.d[order][np.minimum(count, K + 1)] * count

    def seen(self, order: int, count: np.ndarray, history: np.ndarray) -> np.ndarray:
        """The chance of an n-gram of this count (for single words also 0) after a history of that count."""
        if order == 1:
            return np.where(count > 0, self.gain(1, count) / max(1, self.tokens), self.unknown)
        return self.gain(order, count) / np.maximum(1, history)


#: Rows of sums for a part (ngram: the order of the n-grams that follow the histories), and one row of ngram 0 with a block's scores so far.
WEIGHED = """ngram int, part long, block long, keys binary, a binary, b binary, asked binary, doc_ids array<long>, held array<boolean>, lengths array<int>,
 score array<double>, base array<double>, known array<long>, counts binary, lower binary, rest_doc binary, rest_at binary"""


def weigh(row: dict, answers: list[dict], model: Model, parts: int) -> list[dict]:
    """The block's documents scored but for the weights of the histories where they back off, which it asks for; and for each
    history that may be asked for, the sums over the n-grams that the block owns of their gains (a) and of the gains of
    their lower-order n-grams (b). The one who asks knows by which counts to divide them."""
    own, order = Block(row), model.order
    n = len(own.stream)
    keys, ends, total, asked, owner, where = {}, {}, {}, {}, {}, {}
    for k in range(1, order + 1):
        got = np.concatenate([np.zeros(0, np.int64), *[unsqueeze(r["totals"], np.int64) for r in answers if r["ngram"] == k]])
        if k == 1:
            keys[k], ends[k], tokens, place = own.words, None, np.arange(n), own.stream
            first = int(np.searchsorted(own.words, START))
            texts, start = int(got[first] >> 2), bool(got[first] & 2)
        else:
            tokens, key = own.keys(k)
            keys[k], one, place = distinct(key)
            ends[k] = tokens[one]
        total[k], asked[k], where[k], owner[k] = np.zeros(n, np.int64), np.zeros(n, bool), np.full(n, -1), (got & 1) > 0
        total[k][tokens], asked[k][tokens], where[k][tokens] = got[place] >> 2, (got[place] & 2) > 0, place
    # of the history before each token: its count, whether it may be asked for, its place among the keys of its order
    count, may, place = ({k: own.before(x[k - 1], v if k == 2 else w) for k in range(2, order + 1)} for x, v, w in ((total, texts, 0), (asked, start, False), (where, first, -1)))
    count[1] = np.full(n, model.tokens)

    score, level, out = np.zeros(n), np.minimum(order, own.at + 2), []
    counts, lower, rest_doc, rest_at, base = [], [], [], [], 0
    for k in range(order, 0, -1):
        here = np.nonzero(level == k)[0]
        hit = here if k == 1 else here[total[k][here] > 0]
        score[hit] += np.log10(model.seen(k, total[k][hit], count[k][hit]))
        if k == 1:
            break
        miss = here[total[k][here] == 0]
        level[miss] -= 1
        miss = miss[count[k][miss] > 0]
        m = len(keys[k - 1])
        want = np.full(m, -1)
        want[place[k][miss]] = miss
        mine = ends[k][owner[k]]
        mine = mine[may[k][mine]]
        a = np.bincount(place[k][mine], model.gain(k, total[k][mine]), m)
        b = np.bincount(place[k][mine], model.gain(k - 1, total[k - 1][mine]), m)
        use = np.nonzero((want >= 0) | (a > 0))[0]
        for part, s in ranges(keys[k - 1][use], parts):
            at = use[s]
            out.append({"ngram": k, "part": part, "block": own.number, "keys": squeeze_rising(keys[k - 1][at]), "a": squeeze(a[at]), "b": squeeze(b[at]), "asked": squeeze((want[at] >= 0).astype(np.uint8))})
        names = np.nonzero(want >= 0)[0]
        counts.append(count[k][want[names]])
        lower.append(count[k - 1][want[names]])
        rest_doc.append(own.doc[miss])
        rest_at.append(base + np.searchsorted(names, place[k][miss]))
        base += len(names)
    size = len(own.doc_ids)
    one = np.log10((total[1] + 0.5) / (model.tokens + 0.5 * (model.types + 1)))
    whole = lambda xs: squeeze(np.concatenate(xs).astype(np.int64))
    out.append(
        {
            "ngram": 0, "part": -1, "block": own.number, "doc_ids": own.doc_ids, "held": own.held.tolist(), "lengths": own.lengths.tolist(),
            "score": np.bincount(own.doc, score, size).tolist(), "base": np.bincount(own.doc, one, size).tolist(), "known": np.bincount(own.doc, total[1] > 0, size).astype(np.int64).tolist(),
            "counts": whole(counts), "lower": whole(lower), "rest_doc": whole(rest_doc), "rest_at": whole(rest_at),
        }
    )
    return out


def settle(t: pa.Table, schema: pa.Schema) -> pa.Table:
    """For one part and order: to each block the whole sums of the histories that it asked for, in order of their keys."""
    rows = sorted(t.to_pylist(), key=lambda r: r["block"])
    keys = [unsqueeze_rising(r["keys"]) for r in rows]
    names, _, at = distinct(np.concatenate(keys))
    a, b = (np.bincount(at, np.concatenate([unsqueeze(r[c], np.float64) for r in rows]), len(names)) for c in ("a", "b"))
    out, lo = [], 0
    for r, k in zip(rows, keys, strict=True):
        want = at[lo : lo + len(k)][unsqueeze(r["asked"], bool)]
        lo += len(k)
        if len(want):
            out.append({"block": r["block"], "ngram": r["ngram"], "part": r["part"], "a": squeeze(a[want]), "b": squeeze(b[want])})
    return pa.Table.from_pylist(out, schema=schema)


def finish(row: dict, answers: list[dict], model: Model, schema: pa.Schema) -> pa.Table:
    """The documents of a block with the weights it asked for: answers come longest history first, as they were asked."""
    score = np.array(row["score"])
    counts, lower, doc, at = (unsqueeze(row[c], np.int64) for c in ("counts", "lower", "rest_doc", "rest_at"))
    if len(counts):
        a, b = (np.concatenate([unsqueeze(r[c], np.float64) for r in answers]) for c in ("a", "b"))
        alpha = (1 - a / counts) / (1 - b / lower)
        score += np.bincount(doc, np.log10(alpha)[at], len(score))
    none = np.full(len(score), model.tokens == 0)
    lengths = pa.array(row["lengths"], pa.int64())
    columns = [pa.array(row["doc_ids"], pa.int64()), pa.array(row["held"]), lengths, pa.array(row["known"], pa.int64()), pa.array(np.full(len(score), model.tokens)), pa.array(np.array(row["base"]), mask=none), pa.array(score, mask=none)]
    return pa.Table.from_arrays(columns, schema=schema)


def score(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of docs (doc_id, text)."""
    if order < 2:
        raise ValueError("the order is 2 or more")
    cut = scratch_buckets(blocks(docs), "blocks", "block")
    parts = max(1, -(-cut.count() // BLOCKS_PER_PART))
    counts = [scratch_table(add_up(send_counts(cut, k, order, parts), k), f"counts-{k}") for k in range(1, order + 1)]
    answers = reduce(DataFrame.unionByName, counts)
    # n_1 to n_(K+1), tokens and types of each order: one row for each order comes to the driver
    stats = {k: [0] * (K + 3) for k in range(1, order + 1)}
    for r in answers.filter("block = -1").select("ngram", F.posexplode("stats").alias("i", "n")).groupBy("ngram", "i").agg(F.sum("n").alias("n")).collect():
        stats[r["ngram"]][r["i"]] = r["n"]
    model = Model(stats)

    sums = pa.schema([
        ("ngram", pa.int32()), ("part", pa.int64()), ("block", pa.int64()), ("keys", pa.binary()), ("a", pa.binary()), ("b", pa.binary()), ("asked", pa.binary()), ("doc_ids", pa.list_(pa.int64())),
        ("held", pa.list_(pa.bool_())), ("lengths", pa.list_(pa.int32())), ("score", pa.list_(pa.float64())), ("base", pa.list_(pa.float64())), ("known", pa.list_(pa.int64())),
        ("counts", pa.binary()), ("lower", pa.binary()), ("rest_doc", pa.binary()), ("rest_at", pa.binary()),
    ])
    in_order = lambda t: sorted(t.to_pylist(), key=lambda r: (-r["ngram"], r["part"]))
    weighing = lambda left, right: pa.Table.from_pylist(weigh(left.to_pylist()[0], in_order(right), model, parts), schema=sums)
    weighed = scratch_table(cut.groupBy("block").cogroup(answers.filter("block >= 0").groupBy("block")).applyInArrow(weighing, WEIGHED), "weights")
    forget(cut, *counts)

    alphas = pa.schema([("block", pa.int64()), ("ngram", pa.int32()), ("part", pa.int64()), ("a", pa.binary()), ("b", pa.binary())])
    asked, settled = weighed.select("ngram", "part", "block", "keys", "a", "b", "asked"), []
    for k in range(2, order + 1):
        sums_of = asked.filter(F.col("ngram") == k).groupBy("part").applyInArrow(lambda t: settle(t, alphas), "block long, ngram int, part long, a binary, b binary")
        settled.append(scratch_table(sums_of, f"alphas-{k}"))
    settled = reduce(DataFrame.unionByName, settled)
    out = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])
    state = weighed.filter("ngram = 0").select("block", "doc_ids", "held", "lengths", "score", "base", "known", "counts", "lower", "rest_doc", "rest_at")
    finishing = lambda left, right: finish(left.to_pylist()[0], in_order(right), model, out)
    return state.groupBy("block").cogroup(settled.groupBy("block")).applyInArrow(finishing, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
