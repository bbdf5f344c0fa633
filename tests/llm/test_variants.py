"""Spelling variants against all pairs of words, and against SQL."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest

from glossweave.llm import variants
from glossweave.llm.registry import oracle_sql, queries
from tests.compare import both

SCHEMA = "doc_id long, text string, word string, n int, place int"


def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain(docs, least, twice, times, drop):
    words = Counter()
    for d, t in docs:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            words[run if h % drop else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    words = {w: n for w, n in words.items() if len(w) >= least and n >= twice}
    found = {w: sorted((-words[o], o) for o in words if near(w, o)) for w in words}
    form = {w: f[0][1] for w, f in found.items() if f and -f[0][0] >= times * words[w]}
    out = []
    for w, n in words.items():
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n, len(found[w]), words[form[w]] if w in form else None))
    return sorted(out)


def made(seed):
    """Words of few letters, so that many are near, with counts that fall by tens."""
    rng = np.random.default_rng(seed)
    base = ["".join(rng.choice(list("aabbcé×"), int(rng.integers(3, 7)))) for _ in range(60)]
    docs = []
    for i in range(150):
        take = [base[min(int(x), 59)] for x in rng.geometric(0.12, 40) - 1]
        docs.append((i, " ".join(w.upper() if rng.random() < 0.1 else w for w in take)))
    chain = ["letters", "letterz", "lettrz", "lettrzzz", "lettrzz"]
    docs += [(200 + i, " ".join([w] * k)) for i, (w, k) in enumerate(zip(chain, (3000, 300, 30, 1, 3), strict=True))]
    return docs + [(300, None), (301, ""), (302, "1 2 3 -"), (None, "letters letterz ÀÉÿ"), (5, "aab " * 20), (5, "aab " * 20), (303, "x" * 3000)]


@pytest.mark.parametrize("seed, least, twice, times, drop", [(1, 3, 2, 10, 31), (2, 3, 1, 3, 5), (3, 4, 2, 2, 2)])
def test_all_pairs(spark, seed, least, twice, times, drop):
    docs = made(seed)
    table = spark.createDataFrame([(d, t, "w", 1, 2) for d, t in docs], SCHEMA).repartition(3)
    got = variants.group_variants(table, least, twice, times, drop)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    want = plain(docs, least, twice, times, drop)
    assert sorted(tuple(r) for r in got.collect()) == want
    assert any(r[1] and r[2] != r[1] for r in want)


@pytest.mark.parametrize("chunk", [2, 3, 5])
def test_long_words_in_chunks(spark, monkeypatch, chunk):
    monkeypatch.setattr(variants, "CHUNK", chunk)
    docs = made(4) + [(400 + i, " ".join([w] * 2)) for i, w in enumerate(["aaaaaaa", "aaaaaa", "aabaaa", "baaaaaa", "aaaaaab", "abababab", "bababab", "abababa"])]
    table = spark.createDataFrame([(d, t, "w", 1, 2) for d, t in docs], SCHEMA)
    assert sorted(tuple(r) for r in variants.group_variants(table, 2, 2, 3, 31).collect()) == plain(docs, 2, 2, 3, 31)


def test_very_long_run(spark):
    long = "ab" * 10_000
    docs = [(1, f"{long} {long} {long[:-1]} {long[:-1]} {long[:-1]}x {long[:-1]}x"), (2, "x" + long), (3, "x" + long)]
    got = {(len(r.word), r.word[0], r.word[-1]): r.n_near for r in variants.group_variants(spark.createDataFrame(docs, "doc_id long, text string"), drop=10**6).collect()}
    assert got == {(20000, "a", "b"): 3, (19999, "a", "a"): 2, (20000, "a", "x"): 2, (20001, "x", "b"): 1}


def test_empty(spark):
    assert variants.group_variants(spark.createDataFrame([], SCHEMA)).count() == 0


def test_matches_sql(spark):
    mine, other = both(spark, queries()["op11_spelling_variants"], oracle_sql()["op11_spelling_variants"], "/root/testdata/sf0.001")
    assert mine == other and len(mine[1]) > 100
