"""Prompts as column expressions: candidate shortlists, assembly of sections, and their lengths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from glossweave.functions.extract import CLOSE, OPEN, PLACEHOLDER

#: The lines that open and close sections, by which their lengths are measured.
ENTRIES = "Here are some various dictionary entries for word(s) in that phrase:"
GRAMMAR, GRAMMAR_END = "Here is the Mingrelian grammar information:", "That is the end of the grammar information."
FINAL = "Now remember, we are translating the following sentence:"
POLICIES = ["full", "compact", "none"]
SHORTLIST, TOKEN_SHORTLIST = 12, 6
ANSWER = f"Answer with this block and nothing else:\n{OPEN}\n{PLACEHOLDER}\n{CLOSE}\n"


def grammar_policy(c: Column) -> Column:
    """full, compact or none; null and unknown values give full."""
    x = F.lower(F.btrim(c))
    return F.when(x.isin(POLICIES), x).otherwise("full")


def label(language: Column) -> Column:
    return F.initcap(language)


def candidate_block(text: Column, source: Column, target: Column, candidates: Column) -> Column:
    """The first SHORTLIST of candidates (array of struct with target_text, headword, headword_raw, translation, matched_on,
    source_name), a block each; fields that are empty, and those that do not go with the target, are left out. Null without any."""
    filled = lambda on, name, c: F.when(on & (F.coalesce(c, F.lit("")) != ""), F.concat(F.lit(f"- {name}: "), c))
    to, always = F.lower(target), F.lit(True)

    def entry(x, i):
        own = [filled(to != "mingrelian", "Mingrelian", x["headword"]), filled(to.isin("mingrelian", "english"), "Mingrelian (Latinized)", x["headword_raw"]), filled(to == "mingrelian", "Gloss", x["translation"])]
        return F.concat_ws("\n", F.format_string("Candidate %d:", i + 1), F.concat(F.lit("- "), label(target), F.lit(": "), x["target_text"]), *own, filled(always, "Matched on", x["matched_on"]), filled(always, "Source", x["source_name"]))

    head = F.concat(F.lit('Exact matches of "'), text, F.lit('" ('), label(source), F.lit(" → "), label(target), F.lit("); choose the one that fits, the plainest form in doubt:\n\n"))
    return F.when(F.size(candidates) > 0, F.concat(head, F.array_join(F.transform(F.slice(candidates, 1, SHORTLIST), entry), "\n\n")))


def token_block(token: Column, source: Column, candidates: Column) -> Column:
    """The first TOKEN_SHORTLIST candidates (array of struct with target_text, headword_raw, translation, matched_on, source_name) of
    one word; a candidate's empty fields are left out. Null without any."""
    filled = lambda name, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(f"- {name}: "), c))

    def entry(x, i):
        more = [filled("Mingrelian (Latinized)", x["headword_raw"]), filled("Gloss", x["translation"]), filled("Matched on", x["matched_on"]), filled("Source", x["source_name"])]
        return F.concat_ws("\n", F.format_string("Candidate %d:", i + 1), F.concat(F.lit("- Mingrelian: "), x["target_text"]), *more)

    head = F.concat(F.lit('Candidates for the word "'), token, F.lit('" ('), label(source), F.lit(" → Mingrelian); they are for this word, not for the sentence:\n\n"))
    return F.when(F.size(candidates) > 0, F.concat(head, F.array_join(F.transform(F.slice(candidates, 1, TOKEN_SHORTLIST), entry), "\n\n")))


def build(text: Column, source: Column, target: Column, block: Column, entries: Column, grammar: Column) -> Column:
    """Task, shortlist, dictionary entries, grammar and reminder; an empty section is left out, and so is the grammar where
    neither shortlist nor entries have text."""
    full = lambda c: F.when(F.btrim(c, F.lit(" \n\t\r")) != "", c)
    block, entries = full(block), full(entries)
    grammar = F.when(block.isNotNull() | entries.isNotNull(), full(grammar))
    said = F.concat(F.lit('"'), F.coalesce(text, F.lit("")), F.lit('" from '), label(source), F.lit(" to "), label(target), F.lit(".\n\n"))
    return F.concat_ws(
        "\n",
        F.concat(F.lit("Translate "), said, F.lit(ANSWER)),
        F.concat(F.lit("High-priority evidence:\n\n"), block, F.lit("\n")),
        F.concat(F.lit(f"{ENTRIES}\n\n"), entries, F.lit("\n")),
        F.concat(F.lit(f"{GRAMMAR}\n\n"), grammar, F.lit(f"\n\n{GRAMMAR_END}\n")),
        F.concat(F.lit(f"{FINAL} "), said, F.lit(ANSWER)),
    )


def _after(c: Column, marker: str) -> Column:
    """What follows the first marker; null without one."""
    at = F.locate(marker, c)
    return F.when(at > 0, F.substr(c, at + F.lit(len(marker))))


def _until(c: Column, *markers: str) -> Column:
    ends = [F.nullif(F.locate(m, c), F.lit(0)) for m in markers]
    end = F.least(*ends) if len(ends) > 1 else ends[0]
    return F.when(end.isNotNull(), F.substr(c, F.lit(1), end - 1)).otherwise(c)


def measure(prompt: Column) -> Column:
    """struct(prompt_chars, dict_entries_chars, grammar_chars, grammar_included); a missing section has 0."""
    size = lambda c: F.coalesce(F.length(F.btrim(c, F.lit(" \n\t\r"))), F.lit(0))
    p = F.coalesce(prompt, F.lit(""))
    grammar = size(_until(_after(p, GRAMMAR), GRAMMAR_END))
    return F.struct(F.length(p).alias("prompt_chars"), size(_until(_after(p, ENTRIES), GRAMMAR, FINAL)).alias("dict_entries_chars"), grammar.alias("grammar_chars"), (grammar > 0).alias("grammar_included"))
