"""Derived columns of translation events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossweave.functions.text import clean_visitor_id

#: How a response tells where it came from.
PREFIXES = {"Exact lexicon match:": "exact_lexicon", "Dictionary match (via Google Translate bridge):": "dictionary_google_bridge", "Translation (via Google Translate):": "google_translate_direct"}


def to_bool(c: Column) -> Column:
    x = F.lower(F.btrim(c.cast("string")))
    return F.coalesce(x.isin("1", "true", "yes", "on") | (F.try_to_number(x, F.lit("999999999")).cast("int") != 0), F.lit(False))


def to_int(c: Column) -> Column:
    """Whole numbers only; '12.7' gives null."""
    return F.when(c.rlike(r"^\s*[+-]?\d+\s*$"), c.try_cast("int"))


def response_source(source: Column, method: Column, reason: Column, response: Column, translation: Column) -> Column:
    r = F.btrim(F.coalesce(response, F.lit("")))
    out = F.when(F.btrim(F.coalesce(source, F.lit(""))) != "", F.btrim(source)).when(method == "exact_lexicon", "exact_lexicon")
    out = out.when(method.isin("dictionary+google_translate", "dictionary_google_bridge"), "dictionary_google_bridge")
    out = out.when(reason == "google_translate_direct", "google_translate_direct").when(reason == "instant_lookup", "dictionary_google_bridge")
    for prefix, name in PREFIXES.items():
        out = out.when(r.startswith(prefix), name)
    return out.when(F.coalesce(translation, F.lit("")) != "", "llm").otherwise("unknown")


def first_number(metrics: Column, *names: str) -> Column:
    """The first of the named values of a map that is a number, cut to a whole one; null if none is."""
    return F.coalesce(*[F.try_element_at(metrics, F.lit(n)).try_cast("double").cast("long") for n in names])


def event(rows: DataFrame) -> DataFrame:
    """The event table's row of each request: rows (source_text, target_text, source_language, target_language, response_source,
    prompt_metrics: map<string,string>; and provider, model, duration_ms, used_user_api_key, visitor_id, status, error_message,
    app_origin, referer, user_agent, which are null where rows lack them, status success). Other columns go.

    An empty target counts as none; lengths are in characters; a null map is empty.
    """
    given = lambda c, kind="string": F.col(c).cast(kind) if c in rows.columns else F.lit(None).cast(kind)
    m = F.coalesce(F.col("prompt_metrics"), F.create_map().cast("map<string,string>"))
    get = lambda n: F.try_element_at(m, F.lit(n))
    source, target = F.coalesce(given("source_text"), F.lit("")), F.nullif(given("target_text"), F.lit(""))
    told = F.coalesce(F.nullif(given("response_source"), F.lit("")), F.lit("unknown"))
    dictionary, shortlist = to_bool(get("has_dictionary_entries")), to_bool(get("used_exact_candidate_shortlist"))
    # a value that says nothing leaves the word to its other name
    grammar = F.when(F.coalesce(get("used_grammar"), F.lit("")).isin("", "false", "0"), to_bool(get("grammar_included"))).otherwise(to_bool(get("used_grammar")))
    size = F.when(F.coalesce(get("prompt_characters"), F.lit("")).isin("", "0"), to_int(get("prompt_chars"))).otherwise(to_int(get("prompt_characters")))
    p = path(told, to_bool(get("used_llm")), dictionary, grammar, shortlist)
    return rows.select(
        F.coalesce(given("status"), F.lit("success")).alias("status"), source.alias("source_text"), target.alias("target_text"), given("source_language").alias("source_language"), given("target_language").alias("target_language"),
        given("provider").alias("provider"), given("model").alias("model"), told.alias("response_source"), *[c.alias(n) for n, c in p.items()], dictionary.alias("used_dictionary_entries"), grammar.alias("used_grammar"),
        shortlist.alias("used_exact_candidate_shortlist"), to_int(get("exact_candidate_count")).alias("exact_candidate_count"), size.alias("prompt_characters"), to_int(get("dict_entries_chars")).alias("dictionary_entries_characters"),
        to_int(get("grammar_chars")).alias("grammar_characters"), to_int(get("llm_call_ms")).alias("llm_call_ms"), given("duration_ms", "long").alias("duration_ms"), F.length(source).alias("source_text_length"), F.length(target).alias("target_text_length"),
        F.coalesce(given("used_user_api_key", "boolean"), F.lit(False)).alias("used_user_api_key"), clean_visitor_id(given("visitor_id")).alias("visitor_id"), m.alias("prompt_metrics"), given("error_message").alias("error_message"),
        given("app_origin").alias("app_origin"), given("referer").alias("referer"), given("user_agent").alias("user_agent"),
    )


def milliseconds(seconds: Column) -> Column:
    return (seconds * 1000).cast("long")


def run_id(at: Column) -> Column:
    return F.date_format(at, "yyyyMMdd-HHmmss")


def path(source: Column, used_llm: Column, dictionary: Column, grammar: Column, shortlist: Column) -> dict[str, Column]:
    s = F.coalesce(F.nullif(F.btrim(F.coalesce(source, F.lit(""))), F.lit("")), F.lit("unknown"))
    llm = used_llm | (s == "llm")
    bundle = llm & (dictionary | grammar | shortlist)
    return {"translation_path": F.when(s == "llm", F.when(bundle, "llm_evidence_bundle").otherwise("llm_direct")).otherwise(s), "used_llm": llm, "used_evidence_bundle": bundle}
