"""Coverage over texts that repeat: what is compared, what is moved, and the same results."""

import collections
import random

import pytest
from pyspark.sql import functions as F

from glossweave.operators import evals


def cover(e, a):
    e, a = collections.Counter(e.split()), collections.Counter(a.split())
    return sum(min(n, a[t]) for t, n in e.items()) / sum(e.values())


def test_best_coverage_of_copies(spark):
    """A copy, or a line that differs only in words of no item, is no pair of its own; repeated words count as often as they stand."""
    rng = random.Random(8)
    words = [f"w{i}" for i in range(30)]
    items = {i: " ".join(rng.choices(words, k=12)) for i in range(12)} | {50: "w1 w1 w1 w2"}
    lines = [" ".join(rng.choices(words, k=9)) for _ in range(40)] + ["w1 w1", "w1 w2 w2", "other words alone", ""]
    many = [(i, f"{x} x{i}") for i, x in enumerate(lines * 25)]
    e, a = spark.createDataFrame(list(items.items()), "item long, text string"), spark.createDataFrame(many, "doc long, text string")
    pairs = []
    got = {r.item: r.best for r in evals.best_coverage(e, a, "item", "doc", observe=lambda p: pairs.append(p.count())).collect()}
    assert got == pytest.approx({i: max(cover(x, y) for y in lines) for i, x in items.items()}, abs=1e-9)
    assert sum(pairs) <= 4 * len(items) * len(lines)
    # rows of one id are one text
    both = spark.createDataFrame([(1, "w1 w1"), (1, "w1 w2")], "doc long, text string")
    assert {r.best for r in evals.best_coverage(e.filter("item = 50"), both, "item", "doc").collect()} == {1.0}
    found = {(r.item, r.doc): r.coverage for r in evals.coverage(e, a, "item", "doc", 0.5).collect()}
    want = {(i, d): c for i, x in items.items() for d, y in many if (c := cover(x, y)) >= 0.5}
    assert found == pytest.approx(want, abs=1e-9) and len({d for _, d in found}) > 25


def test_tokens_are_not_moved(spark):
    """Texts are dealt by id once; no step shuffles their tokens one by one."""
    e, a = spark.createDataFrame([(1, "a b")], "item long, text string"), spark.range(300).select(F.col("id").alias("doc"), F.lit("a b c").alias("text"))
    found = evals.coverage(e, a, "item", "doc", 0.9)
    assert found.count() == 300
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "array_intersect" in plan and "sum(least" not in plan
