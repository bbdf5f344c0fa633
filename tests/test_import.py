"""Import of dictionary entries: odd entries, and how often tables are read and glosses worked out."""

from pyspark.sql import functions as F

from glossweave.operators import etl

ENTRY = "line long, lang_code string, pos string, word string, forms array<struct<form:string,tags:array<string>>>, senses array<struct<glosses:array<string>>>"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def entries(spark):
    def good(line, word, *senses, form=None):
        return (line, "xx", "noun", word, None if form is None else [("o", ["x"]), (form, ["romanization"])], [None if g is None else (g,) for g in senses])

    rows = [
        good(1, " Ab  c ", ["One,  two; ONE (x)", "or three or"], form=" R "), good(2, "AB C", ["one", "Two , four"], form="r"), (3, None, None, None, None, None), (4, "en", "noun", "ab", None, None), (5, "xx", None, "ab", None, None),
        (6, "xx", "noun", "word", None, None), (7, "xx", "noun", " ", None, None), (8, "xx", "noun", "-ab", None, None), (9, None, "noun", "ab", None, None), good(10, "odd", None, None, [], [None]),
        good(11, "bad", ["(x)", "Plural of x", "a: b", "x" * 81, "has Entries With y"], ["y; .,; z"]), (12, "xx", "noun", "nil", None, [(None,)]),
    ]
    return spark.createDataFrame(rows, ENTRY)


def test_import_rows_odd_entries(spark):
    rows, reasons = etl.import_rows(entries(spark), "xx", ["noun"])
    want = [(1, 0, 0, 0, "Ab c", "R", "One, two; ONE"), (1, 0, 0, 1, "Ab c", "R", "One"), (1, 0, 0, 2, "Ab c", "R", "two"), (1, 0, 1, 0, "Ab c", "R", "or three or"), (1, 0, 1, 1, "Ab c", "R", "three"), (2, 0, 1, 0, "AB C", "r", "Two , four"), (2, 0, 1, 2, "AB C", "r", "four"), (11, 1, 0, 0, "bad", "", "y; .,; z")]
    assert sorted(map(tuple, rows.collect())) == want
    assert {r.reason: r.n for r in reasons.collect()} == {
        "duplicate": 2, "invalid_json": 1, "other_language": 2, "pos": 1, "empty_word": 1, "affix": 1, "sense_without_gloss": 4, "empty_gloss": 1, "no_clean_gloss_candidate": 1, "gloss_prefix": 1, "gloss_explanation": 1, "long_gloss": 1, "gloss_fragment": 1,
    }


def test_import_reads_entries_once(spark):
    """One scan, one working out of glosses, and work spread over tasks, for either result."""
    one = entries(spark).coalesce(1)
    for df in etl.import_rows(one, "xx", ["noun"]):
        assert plan(df).count("LogicalRDD") == 1 and plan(df).count("array_position") == 1 and "Repartition" in plan(df)


def test_import_summary_odd_rows(spark):
    """One pass over each table; blank ones count as rows but make no pair."""
    names = "headword string, headword_raw string, translation string"
    base = spark.createDataFrame([("A", "x", "One"), (" a ", "y", "one"), (None, "b", "two"), ("  ", "b", "TWO"), (None, None, "z"), ("c", "", None)], names)
    more = spark.createDataFrame([("a", "", "one "), ("A", "", "new"), ("a", "", "NEW"), (None, " B", "two"), ("d", "", " ")], names)
    out = etl.import_summary(base, more)
    assert [r.asDict() for r in out.collect()] == [{"base_rows": 6, "candidate_rows": 5, "combined_rows": 3, "added_rows": 1}]
    assert plan(out).count("LogicalRDD") == 2
    assert tuple(etl.import_summary(base.limit(0), more.limit(0)).first()) == (0, 0, 0, 0)


def test_candidates_odd_glosses(spark):
    """Each part once; the patterns stand in the plan once for the gloss and once for its parts."""
    odd = [None, "", "a", "A; a", "x y,X  Y or or z", " (p) q (r), (s) ", ".;,", "b  c ; B c", "forms x", "ok, plural of x", "İ x; i̇ x", "y" * 91]
    rows = spark.createDataFrame([(i, g) for i, g in enumerate(odd)], "i int, g string")
    got = rows.select("i", etl.candidates(F.col("g"), 90).alias("c"))
    assert {r.i: r.c for r in got.collect()} == {
        0: [], 1: [], 2: [], 3: ["A; a"], 4: ["x y,X Y or or z", "x y"], 5: [], 6: [], 7: ["b c ; B c", "b c"], 8: [], 9: ["ok, plural of x", "ok"], 10: ["İ x; i̇ x", "İ x"], 11: [],
    }
    assert plan(got).count("abbreviation") == 2


def test_gloss_query_spreads_one_file(spark):
    from glossweave.plans.queries import QUERIES

    assert "Repartition" in plan(QUERIES["gloss_split_candidates"](spark, "/root/testdata/sf0.001"))
