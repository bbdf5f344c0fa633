"""Search by runs of characters: which rows are looked at, and the same rows as by pattern over all."""

import re
import unicodedata

from pyspark.sql import functions as F

from glossweave.functions.text import is_substring_match, preverb_strip
from glossweave.operators import search

TEXTS = ["The MIT License, in full.", "m.i.t li-cense", "M I T", "mit\nlicense", "committee", "Größe der GROSSE ſtadt", "ΟΔΟΣ και οδός", "a", "b a", "…—", "x.y", "K is Kelvin", "", None, "naïve re-entry", "reentry", "İstanbul", "გამარჯობა, ქვეყანა", "𝒳𝒴𝒵 letters", "m…i…t"]
WORDS = ["mit", "MIT License", "m.i.t", "it", "k", "a", "…", "--", "STADT", "οδος", "reentry", "re-entry", "zzz", "istanbul", "ქვეყანა", "𝒴𝒵", "x y", "license,", "i̇stanbul"]


def test_same_rows_as_all_rows_by_pattern(spark):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS * 3)], "row_id long, entry string")
    words = spark.createDataFrame([(w,) for w in [*WORDS, None, " "]], "word string")
    whole = F.coalesce("entry", F.lit(""))
    match = is_substring_match(whole, F.col("word"))
    every = {(r.word, r.row_id) for r in rows.join(F.broadcast(words)).filter(match).select("word", "row_id").collect()}
    assert {w for w, _ in every} >= {"mit", "m.i.t", "STADT", "ქვეყანა", "𝒴𝒵", "…", "k"}
    found = {(r.word, r.row_id) for r in search.gram_candidates(words.filter("trim(word) <> ''"), rows, whole, "row_id").collect()}
    assert {(w, i) for w, i in every if re.search(r"[\w\s]", unicodedata.normalize("NFC", w))} <= found
    tiers = {(r.word, r.tier, r.row_id) for r in search.tiered(words, rows, "entry", "row_id", prune=False).collect()}
    one = {w for w, t, _ in tiers if t == 1}
    assert {(w, i) for w, t, i in tiers if t == 2} == {(w, i) for w, i in every if w not in one}


def test_rows_looked_at(spark):
    """Of 3,000 rows a word meets those that have its three rarest runs, or none."""
    rows = spark.createDataFrame([(i, f"common words and number n{i:05d} of them") for i in range(3000)], "row_id long, entry string")
    words = spark.createDataFrame([("n01234",), ("n-0.0/0:17",), ("absent",), ("mon wor",)], "word string")
    count = {r["word"]: r["count"] for r in search.gram_candidates(words, rows, F.col("entry"), "row_id").groupBy("word").count().collect()}
    assert count["n01234"] <= 12 and count["n-0.0/0:17"] <= 30 and "absent" not in count and count["mon wor"] == 3000


def test_empty(spark):
    rows, words = spark.createDataFrame([], "row_id long, entry string"), spark.createDataFrame([("mit",), ("--",)], "word string")
    assert search.tiered(words, rows, "entry", "row_id").count() == 0
    assert search.tiered(words.limit(0), spark.createDataFrame([(1, "mit")], "row_id long, entry string"), "entry", "row_id").count() == 0


def test_standalone_only(spark):
    """Paragraphs in which a word stands alone; without standalone_only also those that only hold it."""
    notes = search.context(spark.createDataFrame([(1, "a ring here"), (2, "bring it"), (3, "ring-ring")], "row_id long, entry string"))
    words = spark.createDataFrame([("ring",), ("rin",), ("zz",)], "word string")
    line = lambda *rows: search.SEPARATOR + "".join(r + "\n" + search.SEPARATOR for r in rows)
    assert {r.word: (r.output, r.has_standalone) for r in notes.search(words, standalone_only=True).collect()} == {"ring": (line("a ring here", "ring-ring"), True)}
    assert {r.word: (r.output, r.has_standalone) for r in notes.search(words).collect()} == {"ring": (line("a ring here", "ring-ring"), True), "rin": (line("a ring here", "bring it", "ring-ring"), False)}


def test_mingrelian_sources_are_kept(spark, monkeypatch):
    """Each source is stored over several files once and searched twice, for the words and for all stems; a case stem goes before a verb's."""
    seen, real = [], search.tiered
    monkeypatch.setattr(search, "tiered", lambda words, rows, *a, **k: seen.append(tuple(sorted(rows.inputFiles()))) or real(words, rows, *a, **k))
    ids = spark.range(400).select(F.col("id").alias("row_id"))
    text = F.element_at(F.create_map(*map(F.lit, [7, "zeta", 8, "realpha", 9, "alphas"])), F.col("row_id").cast("int"))
    pairs = search.sentence_pairs(ids.select("row_id", F.coalesce(text, F.lit("other")).alias("mingrelian"), F.lit("e").alias("english")))
    gal = search.russian_dictionary(ids.select("row_id", F.lit("r").alias("russian"), F.lit("m").alias("mingrelian")))
    kk = search.four_column_dictionary(ids.select("row_id", F.lit("m").alias("mingrelian"), F.lit("i").alias("ipa"), F.lit("r").alias("russian"), F.lit("g").alias("georgian")))
    notes = search.context(ids.select("row_id", F.lit("note").alias("entry")))
    words = spark.createDataFrame([(w,) for w in ["zeta", "zetas", "rezeta", "rezetas", "realphas"]], "word string")
    stems = lambda w: F.when(w.endswith("s"), F.array(F.concat(w, F.lit("y")), F.regexp_replace(w, "s$", ""))).otherwise(F.array().cast("array<string>"))
    got = {r.word: r.output for r in search.from_mingrelian(words, pairs, gal, kk, notes, stems, lambda w: preverb_strip(w, ["re"])).collect()}
    shown = lambda x: search.SEPARATOR + f"Mingrelian: {x}\nEnglish: e\n" + search.SEPARATOR
    more = {"zeta": shown("zeta"), "zetas": f"\n[Case-stripped fallback: zetas → zeta]\n{shown('zeta')}", "rezeta": f"\n[Preverb-stripped fallback: rezeta → zeta]\n{shown('zeta')}", "rezetas": "", "realphas": f"\n[Case-stripped fallback: realphas → realpha]\n{shown('realpha')}"}
    assert got == {w: f"\nResults for {w}:\n{x}" for w, x in more.items()}
    assert len(seen) == 8 and len(set(seen)) == 4 and min(map(len, seen)) > 4
