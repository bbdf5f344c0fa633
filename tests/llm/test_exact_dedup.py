"""Exact deduplication against plain grouping: odd rows, colliding digests, files that come later."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from glossweave.llm import exact_dedup
from glossweave.llm.registry import oracle_sql, queries
from tests.compare import both

SCHEMA = "doc_id long, text string, digest string, n int, _metadata string"


def plain(rows):
    groups = {}
    for d, t in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t or ""), []).append(d)
    out = []
    for t, ids in groups.items():
        ids = sorted(ids, key=lambda d: (d is None, d or 0))
        out += [(d, ids[0], len(ids), i == 0, hashlib.sha256(t.encode()).hexdigest()) for i, d in enumerate(ids)]
    return sorted(out, key=repr)


def write(spark, rows, path, files=3):
    spark.createDataFrame([(d, t, "x", 1, "m") for d, t in rows], SCHEMA).repartition(files).write.mode("append").parquet(path)


def got(df):
    return sorted((tuple(r) for r in df.select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()), key=repr)


ROWS = [(1, "a b"), (2, "a  b"), (3, "a\tb "), (4, "a\tb\n"), (5, ""), (6, None), (7, " "), (8, "\r\n"), (9, "a b"), (9, "a b"), (9, "a b"), (None, "a b"), (None, "lone"), (None, "lone"), (10, "x" * 3_000_000), (11, "x" * 3_000_000), (12, "x" * 2_999_999 + "y"), (-5, "neg"), (4, "neg")]
ROWS += [(100 + i, "hot text") for i in range(2000)]


def test_matches_sql(spark):
    mine, other = both(spark, queries()["op13_exact_dedup"], oracle_sql()["op13_exact_dedup"], "/root/testdata/sf0.001")
    assert mine == other and len(mine[1]) == 200


def test_odd_rows_and_later_files(spark, tmp_path):
    path, folder = str(tmp_path / "docs.parquet"), str(tmp_path / "state")
    write(spark, ROWS, path)
    exact_dedup.ingest(spark, path, folder)
    assert got(exact_dedup.verdicts(spark, path, folder)) == plain(ROWS)
    state = {r.n for r in exact_dedup.groups(spark, folder).collect()}
    assert 2000 in state
    more = [(0, "a b"), (3, "new"), (50, "hot text"), (51, "new")]
    write(spark, more, path, 2)
    exact_dedup.ingest(spark, path, folder)
    exact_dedup.ingest(spark, path, folder)  # nothing new
    assert got(exact_dedup.verdicts(spark, path, folder)) == plain(ROWS + more)


@pytest.mark.parametrize("most", [1, 6])
def test_colliding_digests(spark, tmp_path, most):
    """A digest of the text's length alone, or of its first characters: whole bytes decide."""
    weak = {1: lambda t: F.unhex(F.lpad(F.hex(F.length(t)), 16, "0")), 6: lambda t: F.unhex(F.sha2(F.substring(t, 1, 1), 256))}[most]
    rows = [(i, f"{'ab'[i % 2]}{i % 7}") for i in range(200)] + ROWS[:14]
    path, folder = str(tmp_path / "docs.parquet"), str(tmp_path / "state")
    write(spark, rows, path)
    exact_dedup.ingest(spark, path, folder, digest=weak)
    assert [r[:4] for r in got(exact_dedup.verdicts(spark, path, folder))] == [r[:4] for r in sorted(plain(rows), key=lambda r: repr(r[:4]))]


def test_empty(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "none.parquet"))
    assert got(exact_dedup.deduplicate(spark, str(tmp_path / "none.parquet"))) == []


def test_no_python_and_no_expiry(spark, tmp_path):
    path = str(tmp_path / "docs.parquet")
    write(spark, ROWS[:12], path)
    plan = exact_dedup.deduplicate(spark, path)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "EventTimeWatermark" not in plan
