"""Import of dictionary dumps: glosses, reject reasons, part-of-speech filter."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glossweave.functions.text import compact, normalize
from glossweave.sources.shared import dealt

#: How glosses begin, and what they hold, that are not translations.
BAD_PREFIXES = [
    "abbreviation of ", "accusative ", "added to ", "alternative form ", "alternative letter-case form ", "archaic form ", "comparative form ",
    "dative ", "definite ", "expresses ", "forms ", "genitive ", "inflection of ", "letter ", "locative ", "nominative ", "obsolete form ",
    "plural ", "suffixed to ", "superlative form ", "the first letter ", "used to ",
]
BAD_FRAGMENTS = [" entries with ", " language header", "written in the georgian script"]
PARTS = r"(?i)\s*(?:;|,|\bor\b)\s*"


def _starts(c: Column) -> Column:
    return c.rlike("^(?:" + "|".join(map(re.escape, BAD_PREFIXES)) + ")")


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value worked out once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _reason(raw: Column, most: int) -> Column:
    """reject_reason of a compact gloss."""
    holds = "|".join(map(re.escape, BAD_FRAGMENTS))

    def reason(low):
        out = F.when(raw == "", "empty_gloss").when(F.length(raw) > most, "long_gloss").when(_starts(low), "gloss_prefix")
        return out.when(low.rlike(holds), "gloss_fragment").when(F.contains(raw, F.lit(":")), "gloss_explanation")

    return _let(F.lower(raw), reason)


def reject_reason(gloss: Column, most: int) -> Column:
    """Null for a gloss that may hold candidates."""
    return _let(compact(gloss), lambda raw: _reason(raw, most))


def _parts(raw: Column, most: int) -> Column:
    """candidates of a compact gloss that is not rejected. Parts of compact text are compact once trimmed."""
    named = lambda x: F.struct(x.alias("x"), F.lower(x).alias("low"))
    fit = lambda p: (p["x"] != "") & (F.length(p["x"]) <= most) & (F.length(p["x"]) != 1) & ~_starts(p["low"])
    every = lambda whole: F.filter(F.transform(F.concat(F.array(whole), F.split(whole, PARTS)), lambda x: named(F.btrim(x, F.lit(" .;,:")))), fit)
    once = lambda parts: _let(F.transform(parts, lambda p: p["low"]), lambda lows: F.filter(parts, lambda p, i: F.array_position(lows, p["low"]) == i + 1))
    whole = compact(F.regexp_replace(raw, r"\s*\([^)]*\)", ""))
    return F.transform(_let(_let(whole, every), once), lambda p: p["x"])


def candidates(gloss: Column, most: int) -> Column:
    """The gloss without parentheses, then its parts; each once by normalised form."""
    none = F.array().cast("array<string>")
    return _let(compact(gloss), lambda raw: F.when(_reason(raw, most).isNull(), _parts(raw, most)).otherwise(none))


def gloss_outcome(gloss: Column, most: int) -> Column:
    """struct(reason, candidates): why a gloss gives no row (reject_reason, or that no candidate is left), null if it gives some."""
    none = F.array().cast("array<string>")
    of = lambda reason, found: F.struct(reason.alias("reason"), found.alias("candidates"))
    found = lambda c: of(F.when(F.size(c) == 0, "no_clean_gloss_candidate"), c)
    return _let(compact(gloss), lambda raw: _let(_reason(raw, most), lambda reason: F.when(reason.isNull(), _let(_parts(raw, most), found)).otherwise(of(reason, none))))


def gloss_reason(gloss: Column, most: int) -> Column:
    """Why a gloss gives no row."""
    return gloss_outcome(gloss, most)["reason"]


def import_rows(entries: DataFrame, language: str, kinds: list[str], most: int = 80) -> tuple[DataFrame, DataFrame]:
    """(rows, reasons) of entries (line, lang_code, pos, word, forms, senses): rows line, headword, headword_raw, translation, one
    for each normalised triple, the first in the file; reasons reason, n of what was left out, and duplicates, most first.

    A line that is no JSON has null for all but line. Either result reads the entries once and works each gloss out once.
    """
    bad = F.col("word").isNull() & F.col("lang_code").isNull() & F.col("senses").isNull()
    e = dealt(entries).withColumn("reason", F.when(bad, "invalid_json").otherwise(entry_reason(F.col("lang_code"), F.col("pos"), F.col("word"), language, kinds)))
    roman, good = F.coalesce(compact(romanization(F.col("forms"))), F.lit("")), F.col("reason").isNull()
    e = e.select("line", "reason", F.when(good, compact(F.col("word"))).alias("headword"), F.when(good, roman).alias("headword_raw"), F.when(good, F.col("senses")).alias("senses"))
    # outer, so that what is left out stays as a row with its reason
    senses = e.select("line", "reason", "headword", "headword_raw", F.posexplode_outer("senses").alias("i", "s")).filter("reason is not null or i is not null")
    glosses = senses.select("line", "reason", "headword", "headword_raw", "i", F.posexplode_outer("s.glosses").alias("j", "g"))
    nothing = F.coalesce("reason", F.when(F.col("j").isNull(), "sense_without_gloss"))
    outcome = F.when(nothing.isNull(), gloss_outcome(F.col("g"), most)).otherwise(F.struct(nothing.alias("reason"), F.array().cast("array<string>").alias("candidates")))
    told = glosses.select("line", "headword", "headword_raw", "i", "j", outcome.alias("o"))
    each = told.select("line", "headword", "headword_raw", "i", "j", F.col("o.reason").alias("reason"), F.posexplode_outer("o.candidates").alias("k", "translation"))
    # all three are compact
    triple = {f"_{c}": F.lower(c) for c in ("headword", "headword_raw", "translation")}
    w = Window.partitionBy(*triple.values()).orderBy("line", "i", "j", "k")
    # a filter on reason would go below the explode and work each outcome out again
    rows = each.filter("k is not null").withColumn("_n", F.row_number().over(w)).filter("_n = 1").select("line", "i", "j", "k", "headword", "headword_raw", "translation")
    groups = each.groupBy("reason", *[F.when(F.col("reason").isNull(), c).alias(a) for a, c in triple.items()]).agg(F.count(F.lit(1)).alias("n"))
    left = groups.select(F.coalesce("reason", F.lit("duplicate")).alias("reason"), F.when(F.col("reason").isNull(), F.col("n") - 1).otherwise(F.col("n")).alias("n"))
    return rows, left.groupBy("reason").agg(F.sum("n").alias("n")).filter("n > 0").orderBy(F.desc("n"), "reason")


def import_summary(base: DataFrame, candidates_: DataFrame) -> DataFrame:
    """base_rows, candidate_rows, combined_rows and added_rows: how many rows (headword, headword_raw, translation) there are, one
    for each normalised headword and translation, with and without the candidates. Each table is read once."""
    key = lambda d: d.select(normalize(F.coalesce(F.nullif(compact(F.col("headword")), F.lit("")), F.col("headword_raw"))).alias("h"), normalize(F.col("translation")).alias("t"))
    both = key(dealt(base)).withColumn("own", F.lit(1)).unionByName(key(candidates_).withColumn("own", F.lit(0)))
    pairs = both.groupBy("h", "t").agg(F.sum("own").alias("base"), F.sum(1 - F.col("own")).alias("more"))
    total, fit = lambda c: F.coalesce(F.sum(c), F.lit(0)), (F.col("h") != "") & (F.col("t") != "")
    return pairs.agg(total("base").alias("base_rows"), total("more").alias("candidate_rows"), F.count_if(fit).alias("combined_rows"), F.count_if(fit & (F.col("base") == 0)).alias("added_rows"))


def entry_reason(lang: Column, pos: Column, word: Column, language: str, kinds: list[str]) -> Column:
    w = compact(word)
    return F.when(lang.isNull() | (lang != language), "other_language").when(~F.coalesce(pos.isin(kinds), F.lit(False)), "pos").when(w == "", "empty_word").when(w.startswith("-") | (F.length(w) <= 1), "affix")


def romanization(forms: Column) -> Column:
    return F.try_element_at(F.filter(forms, lambda f: F.array_contains(f["tags"], "romanization")), F.lit(1))["form"]


def reason_counts(rows: DataFrame, reason: str) -> DataFrame:
    return rows.groupBy(reason).agg(F.count(F.lit(1)).alias("n"))
