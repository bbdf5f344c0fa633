"""Prompt sections, the offline client, sinks and routing on small tables."""

from pyspark.sql import functions as F

from glossweave.functions import prompts
from glossweave.operators import bridge, clients
from glossweave.plans import translate
from glossweave.sources import sinks

TEXT = "source string, target string, source_text string, target_text string"


def test_sections_are_measured(spark):
    row = spark.createDataFrame([("a b", "x: one", "rule"), ("a b", " ", "rule")], "text string, entries string, grammar string")
    p = prompts.build(F.col("text"), F.lit("english"), F.lit("mingrelian"), F.lit(None).cast("string"), F.col("entries"), F.col("grammar"))
    full, bare = row.select(p.alias("p"), prompts.measure(p).alias("m")).collect()
    assert (full.m.dict_entries_chars, full.m.grammar_chars, full.m.grammar_included, full.m.prompt_chars) == (6, 4, True, len(full.p))
    assert (bare.m.dict_entries_chars, bare.m.grammar_chars, bare.m.grammar_included) == (0, 0, False)
    assert prompts.GRAMMAR not in bare.p and prompts.ENTRIES not in bare.p


def test_grammar_policy(spark):
    rows = spark.createDataFrame([(" Compact ",), ("none",), ("odd",), (None,)], "p string").select(prompts.grammar_policy(F.col("p")).alias("p")).collect()
    assert [r.p for r in rows] == ["compact", "none", "full", "full"]


def test_null_prompts_are_not_sent(spark):
    def client():
        return lambda texts: [t.upper() for t in texts]

    rows = clients.complete(spark.createDataFrame([(1, "a"), (2, None)], "id long, prompt string"), "prompt", client).orderBy("id").collect()
    assert [r.response for r in rows] == ["A", None] and rows[1].llm_call_ms is None


def test_routes(spark):
    asked = [(1, "One", "english", "mingrelian"), (2, "two", "english", "mingrelian"), (3, "three", "english", "mingrelian"), (4, "four", "english", "georgian"),
             (5, "five words", "english", "mingrelian"), (6, "six", "english", "french"), (7, None, "english", "mingrelian"), (8, "eight", "english", "georgian")]
    requests = spark.createDataFrame(asked, "request_id long, input_text string, source string, target string")
    lexicon = spark.createDataFrame(
        [(1, "english", "mingrelian", " one ", "A", "l"), (2, "english", "mingrelian", "one", "a", "l"), (3, "english", "mingrelian", "two", "B", "l"), (4, "english", "mingrelian", "two", "C", "l"), (5, "english", "mingrelian", None, None, None)],
        "row_id long, source string, target string, source_text string, target_text string, source_name string",
    )
    bridge = spark.createDataFrame([("english", "mingrelian", "three", "D"), ("english", "mingrelian", "two", "never")], TEXT)
    memory = spark.createDataFrame([("english", "georgian", "four", "E")], TEXT)
    words = lambda w: w.select("word", F.concat("word", F.lit(": entry\n")).alias("output"))
    got = {r.request_id: r for r in translate.translate(requests, lexicon, bridge, memory, words, "g").collect()}
    assert {k: (r.response_source, r.translation, r.exact_candidate_count) for k, r in got.items()} == {
        1: ("exact_lexicon", "A", 1), 2: ("llm", "two", 2), 3: ("dictionary_google_bridge", "D", 0), 4: ("google_translate_direct", "E", 0),
        5: ("llm", "five words", 0), 6: ("unsupported", None, 0), 7: ("llm", got[7].translation, 0), 8: ("unsupported", None, 0),
    }
    assert (got[2].has_dictionary_entries, got[2].used_grammar, got[5].has_dictionary_entries, got[5].used_grammar, got[7].used_grammar) == (False, True, True, True, False)
    assert got[1].full_response == "Exact lexicon match:\nA"
    none = requests.limit(0)
    assert translate.translate(none, lexicon.limit(0), bridge.limit(0), memory.limit(0), words).count() == 0


def test_event_checks(spark, tmp_path):
    rows = spark.createDataFrame([(1, "success"), (2, "odd"), (3, None)], "id long, status string").withColumn("created_at", F.lit("2024-01-02").cast("timestamp"))
    refused = sinks.insert_events(rows, str(tmp_path / "t"))
    assert sorted(r.id for r in refused.collect()) == [2, 3]
    assert [r.id for r in spark.read.parquet(str(tmp_path / "t")).collect()] == [1]


def test_delivery_goes_on_after_a_failure(spark, tmp_path):
    folder = str(tmp_path)

    def sender():
        def send(payload):
            import json
            import pathlib

            i = json.loads(payload)["id"]
            if i == 1:
                raise OSError("away")
            pathlib.Path(f"{folder}/{i}").write_text(payload)

        return send

    sinks.deliver(spark.range(3).coalesce(1), sender)
    assert sorted(p.name for p in tmp_path.iterdir()) == ["0", "2"]


def test_candidates_of_every_source(spark):
    """Fifteen targets, of which twelve show; one target that several sources have is one candidate."""
    t = spark.createDataFrame
    lexica = bridge.Lexica(
        t([(1, "English", "Mingrelian", "moon", "own")], "row_id long, source_language string, target_language string, source_text string, target_text string"),
        t([(i, f"m{i:02d}", "Sun ") for i in range(15)] + [(90, "lost", "moon")], "row_id long, mingrelian string, english string"),
        t([], "row_id long, russian string, mingrelian string"), t([(1, "m03", "r", "k1; one")], "row_id long, mingrelian string, russian string, georgian string"),
        t([(1, "M03", "m-three", "sun"), (2, "m03", "", "SUN"), (3, "moonword", "moonword", "moon")], "row_id long, headword string, headword_raw string, translation string"),
        t([], "source string, target string, source_text string, target_text string"),
    )
    asked = t([(x, "english", "mingrelian") for x in ("sun", "moon", "none")] + [("moonword", "mingrelian", "english"), ("k1; one", "georgian", "mingrelian")], "_k string, source string, target string")
    got = {r["_k"]: r for r in translate.exact_candidates(asked, bridge.candidate_rows(lexica)).collect()}
    assert set(got) == {"sun", "moon", "moonword", "k1; one"} and (got["sun"].n, len(got["sun"].candidates)) == (15, 12)
    assert [c.target_text for c in got["sun"].candidates] == [f"m{i:02d}" for i in range(12)]
    three = got["sun"].candidates[3]
    assert (three.source_name, three.matched_on, three.headword, three.headword_raw, three.translation) == ("sentence_pairs, master_lexicon", "english, translation", "m03", "m-three", "Sun ")
    assert [(c.target_text, c.source_name, c.matched_on) for c in got["moon"].candidates] == [("own", "translation_overrides", "English->Mingrelian"), ("moonword", "master_lexicon", "translation")]
    assert [(c.target_text, c.matched_on) for c in got["moonword"].candidates] == [("moon", "headword, headword_raw")]
    block = t([("sun", "english", "mingrelian")], "a string, b string, c string").crossJoin(translate.exact_candidates(asked, bridge.candidate_rows(lexica)).filter("_k = 'sun'")).select(prompts.candidate_block(F.col("a"), F.col("b"), F.col("c"), F.col("candidates"))).first()[0]
    assert block.count("Candidate ") == 12 and "Candidate 4:\n- Mingrelian: m03\n- Mingrelian (Latinized): m-three\n- Gloss: Sun \n- Matched on: english, translation\n- Source: sentence_pairs, master_lexicon" in block


def test_builders_by_pair(spark):
    """A pair's own prompt; a pair without one is not supported."""
    requests = spark.createDataFrame([(1, "a", "english", "mingrelian"), (2, "b", "mingrelian", "english"), (3, "c", "georgian", "mingrelian")], "request_id long, input_text string, source string, target string")
    none = spark.createDataFrame([], "row_id long, source string, target string, source_text string, target_text string, source_name string")
    own = lambda text, *_: F.concat(F.lit(f'{prompts.FINAL} "own '), text, F.lit('" from '))
    out = translate.translate(requests, none, none, none, lambda w: w.select("word", F.lit("").alias("output")), builders={("english", "mingrelian"): own, ("mingrelian", "english"): prompts.build})
    assert {r.request_id: (r.response_source, r.full_response) for r in out.collect()} == {1: ("llm", "<<<TRANSLATION>>>\nown a\n<<<END_TRANSLATION>>>"), 2: ("llm", "<<<TRANSLATION>>>\nb\n<<<END_TRANSLATION>>>"), 3: ("unsupported", None)}
