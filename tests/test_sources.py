"""Readers on literal files, and the helpers that no SQL can state."""

import os
import unicodedata

import pytest
from pyspark.sql import functions as F

from glossweave.functions import prompts, text
from glossweave.operators import evals, search
from glossweave.sources import readers


def write(path, content):
    path.write_text(content, encoding="utf-8")
    return str(path)


def test_paths_and_missing_files(spark, tmp_path):
    (tmp_path / "b").mkdir()
    at = write(tmp_path / "b" / "x.tsv", "a\tb\n")
    folders = [str(tmp_path / "a"), str(tmp_path / "b")]
    assert readers.resolve(spark, "x.tsv", folders) == at and readers.resolve(spark, "y.tsv", folders) == f"{folders[1]}/y.tsv"
    path, time = readers.source_key(spark, at)
    assert path == at and time > 0 and readers.source_key(spark, f"{at}.none") == (f"{at}.none", None)
    os.utime(at, (1, 1))
    assert readers.source_key(spark, at)[1] == 1000
    gone = str(tmp_path / "gone")
    for read in (readers.sentence_pairs, readers.russian_dictionary, readers.four_column_dictionary, readers.overrides, readers.master_lexicon, readers.eval_cases, readers.context_entries):
        assert read(spark, gone).count() == 0
    assert readers.whole_text(spark, gone) == ""


def test_dictionaries(spark, tmp_path):
    pairs = write(tmp_path / "p", "﻿MINGRELIAN\tenglish\nა\tone\tmore\n only \nmingrelian\tEnglish\nბ \t two\x0bგ\tthree\r\n\tx\ny\t\n")
    assert [(r.mingrelian, r.english) for r in readers.sentence_pairs(spark, pairs).orderBy("row_id", "part").collect()] == [("ა", "one"), ("ბ", "two"), ("გ", "three")]
    gal = write(tmp_path / "g", "short\nRussian\tmingrelian\nд\tდ\nrussian\tMingrelian\n")
    assert [(r.russian, r.mingrelian) for r in readers.russian_dictionary(spark, gal).orderBy("row_id").collect()] == [("д", "დ"), ("russian", "Mingrelian")]
    kk = write(tmp_path / "k", "word\tipa\trussian_def\tgeorgian_def\nw\t\tr\tg\nWord\tIPA\tRussian_def\tGeorgian_def\nw\ti\t\tg\n")
    assert [(r.mingrelian, r.ipa, r.russian, r.georgian) for r in readers.four_column_dictionary(spark, kk).orderBy("row_id").collect()] == [("w", "", "r", "g"), ("Word", "IPA", "Russian_def", "Georgian_def")]
    lexicon = write(tmp_path / "l.csv", 'translation,headword,headword_raw\n"a ""b"", c","x\ny",\n,h,r\nt,,\nt2,,raw\n')
    assert [(r.row_id, r.headword, r.headword_raw, r.translation) for r in readers.master_lexicon(spark, lexicon).orderBy("row_id").collect()] == [(0, "x y", "", 'a "b", c'), (3, "", "raw", "t2")]
    notes = write(tmp_path / "n", "\n\n one\ntwo \n \n\nthree\n")
    assert [(r.row_id, r.entry) for r in readers.context_entries(spark, notes).collect()] == [(0, "one\ntwo"), (1, "three")]


def test_lines_of_many_splits_keep_their_order(spark, tmp_path):
    (tmp_path / "d").mkdir()
    for name, lo, hi in (("a", 0, 900), ("b", 900, 1000), ("c", 1000, 3000)):
        write(tmp_path / "d" / name, "".join(f"{i}\tx{i % 7}\n" for i in range(lo, hi)))
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1500")
    try:
        got = readers.sentence_pairs(spark, str(tmp_path / "d")).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)
    assert sorted((r.row_id, r.mingrelian) for r in got) == [(i, str(i)) for i in range(3000)]


def test_grammar_policies(spark, tmp_path):
    full, short = write(tmp_path / "full", "long grammar"), write(tmp_path / "short", "grammar")
    assert [readers.grammar(spark, p, full, short) for p in (None, "full", " Compact", "NONE", "other")] == ["long grammar", "long grammar", "grammar", "", "long grammar"]
    assert readers.grammar(spark, "compact", full, f"{short}-gone") == ""


def test_composed(spark):
    odd = ["é", "Å", "가", "क़", "é", "გამარჯობა", "плохо", "á̧", None, "", "Ω x"]
    got = {r.i: r.s for r in text.composed(spark.createDataFrame(list(enumerate(odd)), "i int, s string"), "s").collect()}
    assert got == {i: unicodedata.normalize("NFC", x) if x is not None else None for i, x in enumerate(odd)}
    e = spark.createDataFrame([(1, "café noir")], "e long, text string")
    a = spark.createDataFrame([(7, "café noir"), (8, "cafe noir")], "a long, text string")
    assert [(r.e, r.a, r.coverage) for r in evals.coverage(e, a, "e", "a", 0.9).collect()] == [(1, 7, 1.0)]


def test_coverage_meets_on_rare_tokens_only_and_loses_nothing(spark):
    items = [(i, " ".join(["the"] * (i % 4) + [f"w{(i * k) % 11}" for k in range(1, 7)])) for i in range(12)]
    docs = [(j, " ".join(["the", "the"] + [f"w{(j * k) % 11}" for k in range(1, 9)])) for j in range(40)]
    count = lambda s: {w: s.split().count(w) for w in s.split()}
    for least in (0.3, 0.6, 0.9, 1.0):
        want = set()
        for i, x in items:
            for j, y in docs:
                c = sum(min(n, count(y).get(w, 0)) for w, n in count(x).items()) / len(x.split())
                if c >= least:
                    want.add((i, j, round(c, 9)))
        got = evals.coverage(spark.createDataFrame(items, "i long, text string"), spark.createDataFrame(docs, "j long, text string"), "i", "j", least).collect()
        assert {(r.i, r.j, round(r.coverage, 9)) for r in got} == want


def test_words_in_blocks_find_what_one_list_finds(spark, monkeypatch):
    rows = spark.createDataFrame([(i, f"word{i} and ab{i % 9}c (x)yz") for i in range(60)], "row_id long, t string")
    words = spark.createDataFrame([(f"word{i}",) for i in range(0, 60, 2)] + [("b3",), ("xyz",), ("zz",), ("",), (None,)], "word string")
    whole = sorted(tuple(r) for r in search.tiered(words, rows, "t", "row_id").collect())
    monkeypatch.setattr(search, "SMALL", 4)
    assert sorted(tuple(r) for r in search.tiered(words, rows, "t", "row_id").collect()) == whole and len(whole) == 30 + 7 + 60
    shown = search.formatted(search.tiered(words, rows, "t", "row_id"), rows, F.col("t"), "row_id", cap=100).filter("word = 'xyz'").first()
    assert len(shown.output) == 100 and shown.output.startswith("========\nword0 and ab0c (x)yz========\nword1 and") and shown.has_standalone


def test_options_lists_and_blocks(spark):
    rows = spark.createDataFrame([("m", ""), ("n", "x")], "a string, b string")
    assert [r[0] for r in rows.select(evals.option(rows, "model", {"model_var": "a", "model": "z"})).collect()] == ["m", "n"]
    assert [r[0] for r in rows.select(evals.option(rows, "model", {"model": "z"}, "d")).collect()] == ["z", "z"]
    with pytest.raises(Exception, match="no value of 'b' for model"):
        rows.select(evals.option(rows, "model", {"model_var": "b"})).collect()
    assert evals.csv_list(" full, none,,", ["full", "none"]) == ["full", "none"]
    with pytest.raises(ValueError, match="other"):
        evals.csv_list("full,other", ["full"])
    one = [{"target_text": f"t{i}", "headword_raw": None, "translation": "g" if i else "", "matched_on": "m", "source_name": "s"} for i in range(8)]
    df = spark.createDataFrame([(one,), ([],)], "c array<struct<target_text:string,headword_raw:string,translation:string,matched_on:string,source_name:string>>")
    block, none = [r[0] for r in df.select(prompts.token_block(F.lit("w"), F.lit("english"), F.col("c"))).collect()]
    assert none is None and block.count("Candidate ") == 6 and "Candidate 1:\n- Mingrelian: t0\n- Matched on: m\n- Source: s\n\nCandidate 2:\n- Mingrelian: t1\n- Gloss: g" in block
