"""Katz scores against a plain model that looks every n-gram up in counters, and the sum of its chances."""

import collections
import math
import zlib

import numpy as np
import pytest

from glossweave.llm import katz

SF = "/root/testdata/sf0.001"


def tokens(text):
    low = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode())
    return [*low.split(), None]


class Plain:
    def __init__(self, rows, order):
        self.order, self.c = order, [collections.Counter() for _ in range(order + 1)]
        self.after = [collections.defaultdict(set) for _ in range(order + 1)]
        for doc, text in rows:
            if doc is not None and zlib.crc32(str(doc).encode()) % 5 == 1:
                continue
            line = ["^", *tokens(text)]
            self.c[1]["^",] += 1
            for i in range(1, len(line)):
                for k in range(1, order + 1):
                    if i - k + 1 >= 0:
                        g = tuple(line[i - k + 1 : i + 1])
                        self.c[k][g] += 1
                        self.after[k][g[:-1]].add(g[-1])
        self.n = sum(v for g, v in self.c[1].items() if g != ("^",))
        self.v = len(self.c[1]) - (("^",) in self.c[1])
        self.d = [None]
        for k in range(1, order + 1):
            real = collections.Counter(min(v, 7) for g, v in self.c[k].items() if g != ("^",))
            self.d.append(katz.discounts([real[r] for r in range(1, 7)]))
        known = math.fsum(self.gain(1, g) for g in self.c[1] if g != ("^",))
        self.unknown = 1 - known / self.n if self.n else 1

    def gain(self, k, g):
        return self.d[k][min(self.c[k][g], 6)] * self.c[k][g]

    def chance(self, history, word):
        k = len(history) + 1
        if k == 1:
            return self.gain(1, (word,)) / self.n if self.c[1][word,] else self.unknown
        g = (*history, word)
        if self.c[k][g]:
            return self.gain(k, g) / self.c[k - 1][history]
        if not self.c[k - 1][history]:
            return self.chance(history[1:], word)
        seen = self.after[k][history]
        alpha = (1 - sum(self.gain(k, (*history, w)) for w in seen) / self.c[k - 1][history]) / (1 - sum(self.chance(history[1:], w) for w in seen))
        return alpha * self.chance(history[1:], word)

    def row(self, doc, text):
        line = ["^", *tokens(text)]
        score = math.fsum(math.log10(self.chance(tuple(line[max(0, i - self.order + 1) : i]), line[i])) for i in range(1, len(line)))
        base = math.fsum(math.log10((self.c[1][w,] + 0.5) / (self.n + 0.5 * (self.v + 1))) for w in line[1:])
        return doc, doc is not None and zlib.crc32(str(doc).encode()) % 5 == 1, len(line) - 1, sum(self.c[1][w,] > 0 for w in line[1:]), self.n, base, score


def same(got, want):
    key = lambda r: (r[0] is not None, r[0] or 0, r[2], round(r[6], 6))
    got, want = sorted((tuple(r)[:7] for r in got), key=key), sorted(want, key=key)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    assert np.allclose([r[5:] for r in got], [r[5:] for r in want], rtol=1e-9, atol=1e-9)


ROWS = [
    (1, "the cat sat on the mat"), (2, "the cat sat on the mat"), (3, "The CAT ran"), (4, None), (5, ""), (6, " \n\t"), (7, "É on the É"), (8, "the cat sat on a log"), (None, "the cat"), (None, None),
    (9, "the cat sat here and the cat sat there"), (9, "ran ran ran ran"), (10, "a b c " * 3000), (11, "x"), (12, "on on the cat sat on"), (13, "the dog sat on the mat"), (14, "the mat sat"), (15, "zz yy"),
]


@pytest.mark.parametrize("order", [2, 3, 4])
def test_odd_rows(spark, monkeypatch, order):
    docs = spark.createDataFrame([(*r, 1, "x") for r in ROWS], "doc_id long, text string, part int, block string").repartition(3)
    same(katz.score(docs, order).collect(), [Plain(ROWS, order).row(*r) for r in ROWS])


def test_every_row_of_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    plain = Plain(rows, 3)
    same(katz.score(docs.repartition(4)).collect(), [plain.row(*r) for r in rows])
    words = [w[0] for w in plain.c[1] if w != ("^",)]
    histories = list(plain.c[2])[::4000] + list(plain.c[1])[::900] + [("zz9", "the"), (b"zz9", b"yy9")]
    for h in histories:
        if None not in h:
            assert math.isclose(math.fsum(plain.chance(h[-2:], w) for w in words) + plain.chance(h[-2:], "never"), 1, rel_tol=1e-9)


def test_no_rows_no_training(spark):
    assert katz.score(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    held = next(i for i in range(99) if zlib.crc32(str(i).encode()) % 5 == 1)
    r = katz.score(spark.createDataFrame([(held, "a b")], "doc_id long, text string")).collect()
    assert [tuple(x) for x in r] == [(held, True, 3, 0, 0, None, None)]


def test_squeeze():
    keys = np.unique(np.random.default_rng(1).integers(0, 2**64, 5000, np.uint64))
    assert (katz.unsqueeze_rising(katz.squeeze_rising(keys)) == keys).all() and len(katz.squeeze_rising(keys)) < 8 * len(keys)
    assert katz.unsqueeze_rising(katz.squeeze_rising(keys[:0])).tolist() == []
    d = katz.discounts([10, 4, 2, 1, 1, 1])
    assert all(0 < x < 1 for x in d[1:])
