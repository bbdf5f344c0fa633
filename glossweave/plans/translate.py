"""Batch translation of requests: exact lexicon, bridge, direct machine translation, else a model with evidence."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glossweave.functions import prompts
from glossweave.functions.extract import extract_translation, strip
from glossweave.functions.text import english_variants, georgian_variants, is_low_value, normalize, strip_token
from glossweave.operators import clients

#: Pairs that machine translation answers by itself, and what builds the prompt of each pair that has one.
DIRECT = [("english", "georgian"), ("georgian", "english")]
Builder = Callable[[Column, Column, Column, Column, Column, Column], Column]
BUILDERS: dict[tuple[str, str], Builder] = {pair: prompts.build for pair in [("mingrelian", "english"), ("english", "mingrelian"), ("georgian", "mingrelian"), ("mingrelian", "georgian")]}
PAIR = ["source", "target"]
FIELDS = ["headword", "headword_raw", "translation"]


def _among(pairs: list[tuple[str, str]]):
    return F.concat_ws(">", *PAIR).isin([f"{a}>{b}" for a, b in pairs])


def exact_candidates(requests: DataFrame, lexicon: DataFrame) -> DataFrame:
    """source, target, _k, n (distinct targets, all of them) and candidates (the shortlist) for each key asked for.

    Rows of one target are one candidate: its sources and what they matched on, each once in order, and the first headword,
    headword_raw and translation that are not empty (null where the lexicon has no such column).
    """
    asked = requests.select(*PAIR, "_k").filter("_k != ''").distinct()
    given = lambda c: F.col(c) if c in lexicon.columns else F.lit(None).cast("string")
    rows = lexicon.select(*PAIR, normalize(F.col("source_text")).alias("_k"), normalize(F.col("target_text")).alias("_t"), "row_id", "target_text", "source_name", *[given(c).alias(c) for c in [*FIELDS, "matched_on"]])
    rows = rows.filter("_t != ''").join(asked, [*PAIR, "_k"], "left_semi")
    filled = [F.min(F.when(F.coalesce(c, F.lit("")) != "", F.struct("row_id", c))).alias(c) for c in FIELDS]
    # a row for each source and field of a candidate, however many rows say so
    each = rows.groupBy(*PAIR, "_k", "_t", "source_name", "matched_on").agg(F.min(F.struct("row_id", "target_text")).alias("c"), *filled)
    each = each.groupBy(*PAIR, "_k", "_t").agg(F.min("c").alias("c"), F.sort_array(F.collect_list(F.struct("c.row_id", "source_name", "matched_on"))).alias("s"), *[F.min(c).alias(c) for c in FIELDS])
    parts = F.flatten(F.transform("s", lambda x: F.split(F.coalesce(x["matched_on"], F.lit("")), r"\s*,\s*")))
    matched = F.nullif(F.array_join(F.array_distinct(F.filter(parts, lambda x: x != "")), ", "), F.lit(""))
    sources = F.array_join(F.array_distinct(F.transform("s", lambda x: x["source_name"])), ", ")
    each = each.select(*PAIR, "_k", "c.row_id", "c.target_text", sources.alias("source_name"), *[F.col(f"{c}.{c}").alias(c) for c in FIELDS], matched.alias("matched_on"))
    # two aggregates that never hold more than the shortlist of a key
    count = each.groupBy(*PAIR, "_k").agg(F.count(F.lit(1)).alias("n"))
    ranked = each.withColumn("_n", F.row_number().over(Window.partitionBy(*PAIR, "_k").orderBy("row_id", "target_text"))).filter(F.col("_n") <= prompts.SHORTLIST)
    short = ranked.groupBy(*PAIR, "_k").agg(F.sort_array(F.collect_list(F.struct("_n", "target_text", "source_name", *FIELDS, "matched_on"))).alias("candidates"))
    return count.join(short, [*PAIR, "_k"])


def evidence(requests: DataFrame, lookup_words: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """request_id, entries: what lookup_words (word -> word, output) finds for each word, joined in order of the text."""
    words = requests.select("request_id", F.posexplode(F.split(F.coalesce("input_text", F.lit("")), r"\s+")).alias("pos", "w")).select("request_id", "pos", strip_token(F.col("w"), quotes=False).alias("word")).filter("word != ''")
    found = words.join(lookup_words(words.select("word").distinct()).select("word", "output"), "word")
    return found.groupBy("request_id").agg(F.sort_array(F.collect_list(F.struct("pos", "output"))).alias("e")).select("request_id", F.array_join(F.transform("e", lambda x: x["output"]), "").alias("entries"))


def request_tokens(requests: DataFrame) -> DataFrame:
    """request_id, pos, token, n (tokens of the request): the words of input_text without punctuation around them."""
    words = F.filter(F.transform(F.split(F.coalesce("input_text", F.lit("")), r"(?U)\s+"), lambda w: strip_token(w)), lambda w: w != "")
    return requests.select("request_id", words.alias("w")).select("request_id", F.size("w").alias("n"), F.posexplode("w").alias("pos", "token"))


def token_candidates(tokens: DataFrame, lexicon: DataFrame, source: str, target: str = "mingrelian") -> DataFrame:
    """token, n, candidates: for each of tokens (token) the first targets of its variants in the lexicon, each target once, the
    first TOKEN_SHORTLIST of n. Earlier variants and then earlier rows of the lexicon go first."""
    forms = english_variants(F.col("token")) if source == "english" else georgian_variants(F.col("token"))
    variants = tokens.select("token", F.posexplode(forms).alias("v", "form")).withColumn("_k", normalize(F.col("form")))
    some = lexicon.filter((F.col("source") == source) & (F.col("target") == target))
    given = lambda c: F.col(c) if c in lexicon.columns else F.lit(None).cast("string").alias(c)
    rows = some.select(normalize(F.col("source_text")).alias("_k"), normalize(F.col("target_text")).alias("_t"), "row_id", "target_text", given("headword_raw"), given("translation"), given("matched_on"), "source_name").filter("_t != ''")
    each = variants.join(rows, "_k").groupBy("token", "_t").agg(F.min(F.struct("v", "row_id", "target_text", "headword_raw", "translation", "matched_on", "source_name")).alias("c"))
    count = each.groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    # no more of a token's rows are gathered than are shown
    w = Window.partitionBy("token").orderBy("c.v", "c.row_id", "_t")
    first = each.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= prompts.TOKEN_SHORTLIST)
    short = first.groupBy("token").agg(F.sort_array(F.collect_list(F.struct("_n", "c"))).alias("x"))
    return count.join(short, "token").select("token", "n", F.transform("x", lambda x: x["c"]).alias("candidates"))


def sentence_evidence(requests: DataFrame, lexicon: DataFrame, source: str, lookup_words: Callable[[DataFrame], DataFrame], bridged: str | None = None) -> DataFrame:
    """request_id, entries: for each word of input_text, in order, the shortlist of its candidates, else, unless it carries no
    meaning of its own, what lookup_words (word -> word, output) shows.

    bridged: a column with the sentence in Georgian; where it has text, its words are looked up instead, and it comes first.
    """
    asked = requests.select("request_id", "input_text", F.nullif(F.trim(F.col(bridged) if bridged else F.lit("")), F.lit("")).alias("bridge"))
    parts = []
    for language, rows in ((source, asked.filter("bridge is null")), ("georgian", asked.filter("bridge is not null").withColumn("input_text", F.col("bridge")))):
        words = request_tokens(rows)
        known = token_candidates(words.select("token").distinct(), lexicon, language).select("token", prompts.token_block(F.col("token"), F.lit(language), F.col("candidates")).alias("block"))
        words = words.join(known, "token", "left")
        bare = words.filter(F.col("block").isNull() & ~is_low_value(F.col("token"), language, F.col("n")))
        shown = lookup_words(bare.select(F.col("token").alias("word")).distinct()).select(F.col("word").alias("token"), "output")
        parts += [words.filter("block is not null").select("request_id", "pos", "block"), bare.join(shown, "token").select("request_id", "pos", F.col("output").alias("block"))]
    note = F.concat(F.lit("The whole sentence in Georgian, to tell word senses apart:\n- Georgian: "), "bridge", F.lit("\nIt is context only; the answer is in Mingrelian."))
    parts.append(asked.filter("bridge is not null").select("request_id", F.lit(-1).alias("pos"), note.alias("block")))
    every = reduce(DataFrame.unionByName, parts).withColumn("block", strip(F.col("block"))).filter("block != ''")
    return every.groupBy("request_id").agg(F.sort_array(F.collect_list(F.struct("pos", "block"))).alias("e")).select("request_id", F.array_join(F.transform("e", lambda x: x["block"]), "\n").alias("entries"))


def _metrics(values: dict[str, Column]) -> Column:
    """A map of the values that are not null, as text."""
    every = F.map_from_arrays(F.array(*map(F.lit, values)), F.array(*[c.cast("string") for c in values.values()]))
    return F.map_filter(every, lambda _, v: v.isNotNull())


def translate(
    requests: DataFrame, lexicon: DataFrame, bridge: DataFrame | Callable[[DataFrame], DataFrame], memory: DataFrame, lookup_words: Callable[[DataFrame], DataFrame], grammar: str = "",
    client: Callable[[], clients.Complete] = clients.offline, policy: str = "full", lexicon_enabled: bool = True, builders: dict[tuple[str, str], Builder] = BUILDERS, ask: clients.Ask | None = None, limits: clients.Limits = clients.Limits(),
) -> DataFrame:
    """One row for each request (request_id unique, input_text, source, target).

    lexicon: row_id, source, target, source_text, target_text, source_name; memory, and bridge if it is a table: source, target,
    source_text, target_text; else bridge takes the requests without a candidate and returns request_id and answer, as
    operators.bridge does. ask, if given, answers prompts by the provider and model of each request (columns of requests), each
    distinct prompt once; else client answers all. One distinct candidate answers; several make a shortlist for the model; none tries the bridge. Then come
    direct machine translation for DIRECT pairs and the model for those that have one of builders. Any other pair has response_source
    unsupported and no translation. A null or empty text has no candidates. Returns request_id, translation,
    full_response, response_source, exact_candidate_count, used_llm, has_dictionary_entries, used_grammar, prompt_chars, and
    prompt_metrics: what the route tells of itself, as analytics.event() takes it (policy and lexicon_enabled are told, not acted on).
    """
    r = requests.select("request_id", "input_text", *PAIR, *([c for c in ("provider", "model")] if ask else [])).withColumn("_k", normalize(F.col("input_text")))
    r = r.join(exact_candidates(r, lexicon), [*PAIR, "_k"], "left").withColumn("n", F.coalesce("n", F.lit(0))).drop("_k")
    if isinstance(bridge, DataFrame):
        r = clients.machine_translate(r, bridge).withColumnRenamed("mt_text", "bridged")
    else:
        # the bridge's legs, each with its translations, are for requests without a candidate
        answers = bridge(r.filter("n = 0").select("request_id", "input_text", *PAIR))
        r = r.join(answers.select("request_id", F.col("answer").alias("bridged")), "request_id", "left")
    r = clients.machine_translate(r, memory)
    only = F.when(F.col("n") == 1, F.col("candidates")[0]["target_text"])
    route = F.when(F.col("n") == 1, "exact_lexicon").when((F.col("n") == 0) & F.col("bridged").isNotNull(), "dictionary_google_bridge")
    route = route.when(_among(DIRECT) & F.col("mt_text").isNotNull(), "google_translate_direct").when(_among(list(builders)), "llm").otherwise("unsupported")
    r = r.withColumn("response_source", route)
    # words are looked up only for requests that reach the model without a shortlist
    bare = r.filter("response_source = 'llm' and n = 0")
    r = r.join(evidence(bare, lookup_words), "request_id", "left")
    block = F.when(F.col("n") > 1, prompts.candidate_block(F.col("input_text"), F.col("source"), F.col("target"), F.col("candidates")))
    built = {f: f(F.col("input_text"), F.col("source"), F.col("target"), block, F.col("entries"), F.lit(grammar)) for f in dict.fromkeys(builders.values())}
    prompt = F.coalesce(F.lit(None).cast("string"), *[F.when(_among([p for p, g in builders.items() if g is f]), c) for f, c in built.items()])
    r = r.withColumn("prompt", F.when(F.col("response_source") == "llm", prompt)).withColumn("only", only).drop("candidates", "entries")
    r = clients.ask_once(r, "prompt", ask, limits=limits) if ask else clients.complete(r, "prompt", client)
    source = F.col("response_source")
    told = F.coalesce(*[F.when(F.col("target") == x, extract_translation(F.col("response"), x)) for x in ("english", "georgian", "mingrelian")])
    answer = F.when(source == "exact_lexicon", F.col("only")).when(source == "dictionary_google_bridge", F.col("bridged")).when(source == "google_translate_direct", F.col("mt_text")).when(source == "llm", told)
    heads = {"exact_lexicon": "Exact lexicon match:\n", "dictionary_google_bridge": "Dictionary match (via Google Translate bridge):\n", "google_translate_direct": "Translation (via Google Translate):\n"}
    full = F.col("response")
    for k, head in heads.items():
        full = F.when(source == k, F.concat(F.lit(head), answer)).otherwise(full)
    m = prompts.measure(F.col("prompt"))
    llm, direct = source == "llm", source == "google_translate_direct"
    instant = source.isin("exact_lexicon", "dictionary_google_bridge")
    told_by = F.when(source == "exact_lexicon", "exact_lexicon").when(instant, "dictionary+google_translate")
    codes = F.when(F.col("source") == "english", "google_translate_en_ka").otherwise("google_translate_ka_en")
    on = lambda c: F.when(llm, c)
    metrics = _metrics({
        "reason": F.when(instant, "instant_lookup").when(direct, source).when(llm, "llm"), "method": F.when(direct, codes).otherwise(told_by), "used_llm": F.when(source != "unsupported", llm), "exact_candidate_count": F.when(instant | llm, F.col("n")),
        "master_lexicon_enabled": F.when(source != "unsupported", F.lit(lexicon_enabled)), "grammar_policy": F.when(source != "unsupported", F.lit(policy)), "prompt_characters": on(m["prompt_chars"]), "prompt_chars": on(m["prompt_chars"]), "dict_entries_chars": on(m["dict_entries_chars"]),
        "grammar_chars": on(m["grammar_chars"]), "grammar_included": on(m["grammar_included"]), "used_grammar": on(m["grammar_included"]), "has_dictionary_entries": on(m["dict_entries_chars"] > 0), "used_exact_candidate_shortlist": on(F.col("n") > 1), "skip_word_lookups": on(F.col("n") > 1),
        "llm_call_ms": on(F.col("llm_call_ms")), "response_characters": on(F.length("response")), "translation_characters": on(F.length(told)),
    })
    return r.select(
        "request_id", answer.alias("translation"), full.alias("full_response"), "response_source", F.col("n").alias("exact_candidate_count"), (source == "llm").alias("used_llm"),
        (m["dict_entries_chars"] > 0).alias("has_dictionary_entries"), m["grammar_included"].alias("used_grammar"), m["prompt_chars"].alias("prompt_chars"), metrics.alias("prompt_metrics"),
    )
