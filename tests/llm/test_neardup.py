"""Near-duplicates by brute force: groups above and below the threshold that are cut into blocks, odd rows, banding."""

import numpy as np
import pytest

from glossweave.llm import neardup
from tests.llm.test_llm import brute_components


def group(rng, first, n, words, edits):
    base = [f"w{int(i)}" for i in rng.integers(0, 10**6, words)]
    out = []
    for i in range(n):
        w = list(base)
        for at in rng.integers(0, words, int(rng.integers(0, edits + 1))):
            w[at] = f"x{int(rng.integers(0, 10**6))}"
        out.append((first + i, " ".join(w)))
    return out


@pytest.mark.parametrize("percent", [85, 80, 60])
def test_groups_cut_into_blocks(spark, monkeypatch, percent):
    monkeypatch.setattr(neardup, "CLUSTER", 8)
    monkeypatch.setattr(neardup, "BUCKET", 16)
    monkeypatch.setattr(neardup, "PIVOTS", 2)
    rng = np.random.default_rng(percent)
    rows = group(rng, 0, 60, 120, 1) + group(rng, 100, 70, 120, 3) + group(rng, 200, 40, 60, 2) + group(rng, 300, 30, 300, 9) + group(rng, 400, 20, 30, 0)
    rows += [(500 + i, " ".join(rows[i][1].split()[: 100 - i])) for i in range(40)]
    rng.shuffle(rows)
    docs = spark.createDataFrame([(int(d), t, "x", 1) for d, t in rows], "doc_id long, text string, set_key string, m int").repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(docs, percent).collect()}
    assert got == brute_components([(int(d), t) for d, t in rows], percent)


def test_links_between_parts(spark, monkeypatch):
    """A chain whose ends are far apart: pivots alone do not link it."""
    monkeypatch.setattr(neardup, "CLUSTER", 4)
    monkeypatch.setattr(neardup, "PIVOTS", 1)
    words = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(words[5 * i : 5 * i + 100])) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for percent in (85, 90, 91):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(docs, percent).collect()}
        assert got == brute_components(rows, percent)


def test_banding():
    for t in (0.1, 0.3, 0.5, 0.6, 0.8, 0.85, 0.95, 1.0):
        rows, bands = neardup.banding(t)
        assert bands <= neardup.MOST_BANDS and (1 - min(t, 1 - 1e-9) ** rows) ** bands <= neardup.LOST
    assert neardup.banding(0.85) == (6, 30) and neardup.banding(0.8) == (6, 46)
    with pytest.raises(ValueError):
        neardup.banding(0.01)


def test_long_and_repeated(spark):
    long = " ".join(f"w{i}" for i in range(200_000))
    rows = [(1, long), (2, long + " end"), (3, "a b"), (3, "c d"), (4, "A  b"), (5, ""), (6, None)] + [(10 + i, "one text that is there many times over") for i in range(300)]
    got = sorted((r.doc_id, r.component_id, r.kept) for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    want = [(1, 1, True), (2, 1, False), (3, 3, True), (3, 3, True), (4, 3, False), (5, 5, True), (6, 6, True)] + [(10 + i, 10, i == 0) for i in range(300)]
    assert got == want


@pytest.mark.parametrize("unlike", [False, True])
def test_one_id_many_times(spark, unlike):
    """One doc_id with one text 2,000 times, or with 2,000 texts: a node for each set, whatever its rows."""
    base = [f"w{i}" for i in range(60)]
    rows = [(7, " ".join(base)) for _ in range(2000)] + [(8, " ".join([*base, "end"])), (9, "far away from all of the others here")]
    if unlike:
        rows += [(9, f"text {i} of the many that one id has {i * i}") for i in range(2000)] + [(11, "text 44 of the many that one id has 1936")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {}
    for r in neardup.near_duplicates(docs, 85).collect():
        got.setdefault(r.doc_id, set()).add((r.component_id, r.kept))
    want = {7: {(7, True)}, 8: {(7, False)}, 9: {(9, True)}}
    assert got == (want | {11: {(9, False)}} if unlike else want)


def test_texts_of_one_id_bridge(spark):
    """A document that has two texts links what is near to either."""
    one, two = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    rows = [(3, one), (5, one + " x"), (5, two), (4, two + " y"), (6, "alone in the world of words"), (None, one), (None, None)]
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=repr)
    assert got == sorted([(3, 3, True), (5, 3, False), (5, 3, False), (4, 3, False), (6, 6, True), (None, None, True), (None, None, True)], key=repr)
