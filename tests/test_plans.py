"""Ranks and paragraphs over many splits, results of unknown shape, best matches by bound, an index kept by version, odd bridge rows."""

import glob
import os
import random
import time

import pytest
from pyspark.sql import functions as F

from glossweave.operators import bridge, evals, index_store, lookup
from glossweave.sources import readers


@pytest.fixture
def small_splits(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def test_rank(spark):
    rows = spark.range(5000).select(F.pmod(F.hash("id"), F.lit(700)).alias("k"), "id").repartition(7)
    got = lookup.ranked(rows, ["k", "id"], "n")
    assert [(r.k, r.id) for r in got.orderBy("n").collect()] == sorted((r.k, r.id) for r in rows.collect())
    assert [r.n for r in got.orderBy("n").collect()] == list(range(1, 5001)) and lookup.ranked(rows.limit(0), ["k"], "n").count() == 0
    plan = got._jdf.queryExecution().toString()
    assert "Window" in plan and "count" in plan.lower()  # one over ranges, none over rows
    assert evals.case_numbers(rows, ["id"], 3).filter("id = 41").first().case_id == "042"


def test_paragraphs_of_split_file(spark, tmp_path, small_splits):
    rng = random.Random(3)
    parts = ["\n".join(" " * rng.randrange(3) + f"line {rng.randrange(10**6)}  " for _ in range(rng.randrange(1, 12))) for _ in range(120)]
    text = "\n \n" + "".join(p + rng.choice(["\n\n", "\n \t\n", "\n\n\n\n", "\r\n\r\n"]) for p in parts) + " \n\nlast"
    path = tmp_path / "context.txt"
    path.write_text(text, newline="")
    whole = spark.createDataFrame([(text,)], "t string").select(F.posexplode(readers.blocks(F.col("t")))).collect()
    got = readers.context_entries(spark, str(path))
    assert [(r.row_id, r.entry) for r in got.orderBy("row_id").collect()] == [(r.pos, r.col) for r in whole] and len(whole) == 121
    assert spark.read.text(str(path)).rdd.getNumPartitions() > 20
    assert readers.context_entries(spark, str(tmp_path / "none")).count() == 0


def test_results_of_unknown_shape(spark, tmp_path):
    one = '{"results": {"results": [{"s": {"a": 1, "b": true, "c": "2", "d": null}}, {"s": {"a": 2.5, "e": {"x": 1}}}, {}, {"s": 3}]}}'
    (tmp_path / "a.json").write_text(one)
    rows = readers.result_rows(spark, str(tmp_path / "a.json"))
    scores = rows.select("pos", F.variant_get("row", "$.s", "variant").alias("s"))
    assert {r.metric: (r.n, r["mean"]) for r in evals.variant_metric_means(scores, "s").collect()} == {"a": (2, 1.75), "b": (1, 1.0)}
    for i, bad in enumerate(('{"results": {"results": {"a": 1}}}', '{"results": [1]}', "{}", '{"results": {"results": null}}')):
        (tmp_path / f"bad{i}.json").write_text(bad)
        with pytest.raises(Exception, match="no list of results in .*bad"):
            readers.result_rows(spark, str(tmp_path / f"bad{i}.json")).collect()


def test_best_match_by_bound(spark):
    """The same best as over all pairs, of far fewer of them."""
    rng = random.Random(5)
    common, rare = [f"c{i}" for i in range(12)], [f"r{i}" for i in range(4000)]
    texts = [(i, " ".join(rng.choices(common, k=12) + rng.choices(rare, k=6))) for i in range(1500)]
    items = [(i, " ".join(texts[i * 9][1].split()[: 18 - i % 4])) for i in range(60)] + [(100, " ".join(common)), (101, "nothing of it"), (102, ""), (103, None)]
    pairs = []
    e, a = spark.createDataFrame(items, "item long, text string"), spark.createDataFrame([*texts, (9999, None)], "doc long, text string")
    got = {r.item: r.best for r in evals.best_coverage(e, a, "item", "doc", observe=lambda p: pairs.append(p.count())).collect()}
    every = evals.coverage(e, a, "item", "doc", 0.0)
    assert {k: round(v, 9) for k, v in got.items()} == {r.item: round(r.best, 9) for r in every.groupBy("item").agg(F.max("coverage").alias("best")).collect()}
    assert set(got) == {*range(60), 100} and sum(pairs) < every.count() / 4


def test_index_by_version(spark, tmp_path):
    source, folder = tmp_path / "in", str(tmp_path / "index")
    source.mkdir()
    for i in range(3):
        (source / f"{i}.txt").write_text("".join(f"word{i} shared{j}\n" for j in range(20)))

    def build(lines):
        return lookup.inverted_index(lines.withColumn("at", F.struct("file", "line")), ["value"], "at").select("at.file", "term", "at.line")

    def kept():
        d = index_store.kept_index(spark, str(source), folder, build, "term string, line long")
        return {(r.file.rpartition("/")[2], r.term, r.line) for r in d.collect()}

    want = lambda: {(f.name, t, i) for f in source.iterdir() for i, line in enumerate(f.read_text().split("\n")[:-1]) for t in {line, *line.split()}}
    files = lambda: {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{folder}/version=*/*.parquet")}
    assert kept() == want()
    before = files()
    assert kept() == want() and files() == before
    time.sleep(0.01)
    (source / "1.txt").write_text("changed shared0\n\nlast")
    (source / "3.txt").write_text("")
    assert {x for x in kept() if x[1] != ""} == {("1.txt", "changed shared0", 0), ("1.txt", "changed", 0), ("1.txt", "shared0", 0), ("1.txt", "last", 2)} | {x for x in want() if x[0] in ("0.txt", "2.txt")}
    assert len(before.items() & files().items()) == len(before) - len([f for f in before if f not in files()]) > 0
    (source / "0.txt").unlink()
    assert not [x for x in kept() if x[0] == "0.txt"]
    assert index_store.kept_index(spark, str(tmp_path / "none"), str(tmp_path / "no-index"), build, "term string, line long").count() == 0


def test_bridge_odd_rows(spark):
    none = lambda s: spark.createDataFrame([], s)
    two = "row_id long, mingrelian string, english string"
    lexica = bridge.Lexica(none("row_id long, source_language string, target_language string, source_text string, target_text string"), spark.createDataFrame([(1, "ა", "One"), (2, "ბ", "one"), (3, "", None)], two), none("row_id long, russian string, mingrelian string"), none("row_id long, mingrelian string, russian string, georgian string"), spark.createDataFrame([(1, "ა", "", "two"), (2, " Ა", "x", "two"), (3, "დ", None, "three"), (4, "ე", None, "three")], "row_id long, headword string, headword_raw string, translation string"), none("source string, target string, source_text string, target_text string"))
    r = spark.createDataFrame([(1, " ONE ", "english"), (2, None, "english"), (3, " ", "georgian"), (4, "two", "english"), (5, "three", "english"), (6, "one", "english"), (7, "one", "russian")], "request_id long, input_text string, source string")
    assert {x.request_id: (x.leg, x.answer) for x in bridge.to_mingrelian(r, lexica).collect()} == {1: ("direct", "ა"), 4: ("own_sole", "ა"), 6: ("direct", "ა")}
    back = spark.createDataFrame([(1, "ა", "english"), (2, "ა", "georgian"), (3, None, "english")], "request_id long, input_text string, target string")
    assert {x.request_id: (x.leg, x.answer) for x in bridge.from_mingrelian(back, lexica).collect()} == {1: ("direct", "One")}
