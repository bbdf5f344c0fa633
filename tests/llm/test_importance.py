"""Importance resampling against a plain version, for runs of one to three words, and against SQL."""

import hashlib
import math
import re
import zlib
from collections import Counter

import pytest

from glossweave.llm import importance
from glossweave.llm.registry import oracle_sql, queries
from tests.compare import both

SCHEMA = "doc_id long, text string, word string, block int, rank int"


def lowered(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


def plain(docs, target, width, buckets, percent, least):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(t))
    feats = lambda w: [" ".join(w[i : i + n]) for n in range(1, width + 1) for i in range(len(w) - n + 1)]
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = Counter(), Counter()
    for _, x in docs:
        s.update(map(bucket, feats(words(x))))
    for x in target:
        t.update(map(bucket, feats(words(x))))
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1.0) * (all_s + buckets) / ((s[b] + 1.0) * (all_t + buckets))))
    out = []
    for d, x in docs:
        f = feats(words(x))
        weight = sum(gain(bucket(g)) for g in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"2024:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        out.append([d, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words(x))])
    able = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for i, r in enumerate(able[: math.floor(percent * len(able) / 100)]):
        r[4] = i + 1
    return sorted((tuple(r[:5]) for r in out), key=repr)


WORDS = "the of Alpha beta été Ünder x1 42 gamma delta ÇA naïve".split()
DOCS = [(i, " ".join(WORDS[(i * 7 + j * j) % 12] for j in range(i % 40))) for i in range(120)]
DOCS += [(200, None), (201, ""), (202, " \n.,"), (None, "alpha " * 30), (3, "beta " * 25), (3, "beta " * 25), (204, "the " * 50_000), (205, "a-b_c d'e" * 9)]
TARGET = ["beta gamma beta", None, "", "Alpha ÉTÉ 42 x1", "unseen words here"]


@pytest.mark.parametrize("width, block", [(1, 250_000), (1, 64), (3, 100)])
def test_resample(spark, monkeypatch, width, block):
    monkeypatch.setattr(importance, "BLOCK", block)
    docs = spark.createDataFrame([(d, t, "w", 1, 2) for d, t in DOCS], SCHEMA).repartition(3)
    target = spark.createDataFrame([(1, t, "w", 1, 2) for t in TARGET], SCHEMA)
    got = importance.resample(docs, target, width, 97, 30, 10)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == plain(DOCS, TARGET, width, 97, 30, 10)


def test_empty(spark):
    none, some = spark.createDataFrame([], SCHEMA), spark.createDataFrame([(i, t, "w", 1, 2) for i, t in enumerate(["one two", None])], SCHEMA)
    assert importance.resample(none, some).count() == importance.resample(none, none).count() == 0
    assert [r.rank for r in importance.resample(some, none, least=1, percent=100).orderBy("doc_id").collect()] == [1, None]


def test_matches_sql(spark):
    mine, other = both(spark, queries()["op12_importance"], oracle_sql()["op12_importance"], "/root/testdata/sf0.001")
    assert mine == other and len(mine[1]) == 200
