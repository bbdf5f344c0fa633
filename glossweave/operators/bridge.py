"""Translation by dictionaries, with machine translation as a bridge between them.

A request goes through an ordered cascade of legs and leaves at its first success, so a later leg, and the machine translation
that it needs, sees only what is left. Dictionaries become one table of entries for each question, with one row for a key: the
first by priority and row. Requests, however many ask for one text, meet that row once each.

Null and blank texts match nothing. A key that has many rows is reduced in each task before it is shuffled. Requests that repeat a
request_id are undefined; everything else may repeat. Empty tables answer nothing. Other columns of the tables are ignored.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossweave.functions.text import FIGURATIVE, bridge_gloss, figurative_split, normalize
from glossweave.operators import clients
from glossweave.sources.shared import stored

#: Languages by their codes, and the other languages that a text is tried in, in order.
CODES = {"en": "english", "ka": "georgian", "ru": "russian"}
VARIANTS = {"english": ["georgian", "russian"], "georgian": ["english", "russian"]}
Leg = Callable[[DataFrame], DataFrame]


@dataclass
class Lexica:
    """overrides (row_id, source_language, target_language, source_text, target_text), pairs (row_id, mingrelian, english), gal
    (row_id, russian, mingrelian), kk (row_id, mingrelian, russian, georgian), lexicon (row_id, headword, headword_raw,
    translation), and memory (source, target, source_text, target_text): what machine translation gives."""

    overrides: DataFrame
    pairs: DataFrame
    gal: DataFrame
    kk: DataFrame
    lexicon: DataFrame
    memory: DataFrame


def primary(gloss: str, code: str) -> Column:
    """The primary meaning of a gloss, the whole gloss where that is empty."""
    return F.coalesce(F.nullif(figurative_split(F.col(gloss), FIGURATIVE[code])["primary"], F.lit("")), F.col(gloss))


def _entries(rows: DataFrame, source: Column | str, target: Column | str, key: str, text: Column | str, priority: int, name: str) -> DataFrame:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    text = text if isinstance(text, Column) else F.col(text)
    return rows.select(lit(source).alias("source"), lit(target).alias("target"), normalize(F.col(key)).alias("_k"), F.lit(priority).alias("priority"), "row_id", text.alias("text"), F.lit(name).alias("source_name")).filter("_k != ''")


def direct_entries(lexica: Lexica) -> DataFrame:
    """source, target, _k, priority, row_id, text, source_name: what each dictionary says by itself; overrides first, then sentence
    pairs, the four-column dictionary and the Russian one."""
    both = lambda rows, a, b, ta, tb, p, name: [_entries(rows, a, b, a, tb, p, name), _entries(rows, b, a, b, ta, p, name)]
    own = _entries(lexica.overrides, normalize(F.col("source_language")), normalize(F.col("target_language")), "source_text", "target_text", 0, "translation_overrides")
    parts = [own, *both(lexica.pairs, "mingrelian", "english", "mingrelian", "english", 1, "sentence_pairs")]
    parts += both(lexica.kk, "mingrelian", "georgian", "mingrelian", primary("georgian", "ka"), 2, "kk.tsv")
    parts += both(lexica.gal, "mingrelian", "russian", "mingrelian", "russian", 3, "gal")
    return reduce(DataFrame.unionByName, parts)


def first_entries(entries: DataFrame) -> DataFrame:
    """source, target, _k, text: the first of each key."""
    first = entries.groupBy("source", "target", "_k").agg(F.min(F.struct("priority", "row_id", "text")).alias("f"))
    return first.select("source", "target", "_k", F.col("f.text").alias("text"))


def sole_entries(lexica: Lexica) -> DataFrame:
    """source, target, _k, text of keys that have one distinct target among overrides (which stand for the dictionaries where there
    are any), sentence pairs, the four-column dictionary and the master lexicon."""
    plain = direct_entries(lexica).filter("priority < 3")
    key = ["source", "target", "_k"]
    least = plain.groupBy(*key).agg(F.min("priority").alias("p"))
    plain = plain.join(least.filter("p = 0").select(*key, F.lit(True).alias("overridden")), key, "left").filter("priority = 0 or overridden is null").drop("overridden")
    more = lexica.lexicon.filter(F.coalesce("translation", F.lit("")) != "")
    heads = F.explode(F.array_distinct(F.array(*[normalize(F.col(c)) for c in ("headword", "headword_raw")])))
    to_english = more.select("row_id", "translation", heads.alias("_h"))
    every = plain.unionByName(_entries(to_english, "mingrelian", "english", "_h", "translation", 5, "master_lexicon"))
    every = every.unionByName(_entries(more, "english", "mingrelian", "translation", "headword", 5, "master_lexicon")).withColumn("_t", normalize(F.col("text"))).filter("_t != ''")
    # least and greatest target of a key tell whether it is the only one
    one = every.groupBy(*key).agg(F.min("_t").alias("a"), F.max("_t").alias("b"), F.min(F.struct("priority", "row_id", "text")).alias("f"))
    return one.filter("a = b").select(*key, F.col("f.text").alias("text"))


def candidate_rows(lexica: Lexica) -> DataFrame:
    """The lexicon that translate() takes: row_id (in order of source and row), source, target, source_text, target_text, source_name,
    headword, headword_raw, translation and matched_on of every exact candidate. Overrides stand for the dictionaries where there are
    any, but not for the master lexicon."""

    def rows(d: DataFrame, source, target, key, text, name, order, head, raw, gloss, matched) -> DataFrame:
        lit = lambda x: x if isinstance(x, Column) else F.lit(x)
        return d.select((F.lit(order << 50) + F.col("row_id")).alias("row_id"), lit(source).alias("source"), lit(target).alias("target"), key.alias("source_text"), text.alias("target_text"), F.lit(name).alias("source_name"), lit(head).cast("string").alias("headword"), lit(raw).cast("string").alias("headword_raw"), gloss.alias("translation"), lit(matched).alias("matched_on"))

    c, o, word, sole = F.col, lexica.overrides, F.col("mingrelian"), primary("georgian", "ka")
    own = rows(o, normalize(c("source_language")), normalize(c("target_language")), c("source_text"), c("target_text"), "translation_overrides", 0, c("source_text"), None, c("target_text"), F.concat("source_language", F.lit("->"), "target_language"))
    plain = [rows(lexica.pairs, a, b, c(a), c(b), "sentence_pairs", 1, word, None, c("english"), a) for a, b in (("mingrelian", "english"), ("english", "mingrelian"))]
    plain += [rows(lexica.kk, "mingrelian", "georgian", word, sole, "kk.tsv", 1, word, None, sole, "mingrelian"), rows(lexica.kk, "georgian", "mingrelian", c("georgian"), word, "kk.tsv", 1, word, None, c("georgian"), "georgian")]
    key = ["source", "target", "_k"]
    over = own.select("source", "target", normalize(F.col("source_text")).alias("_k")).distinct()
    left = reduce(DataFrame.unionByName, plain).withColumn("_k", normalize(F.col("source_text"))).join(over, key, "left_anti").drop("_k")
    m, (h, r) = lexica.lexicon.filter(F.coalesce("translation", F.lit("")) != ""), (normalize(F.col(x)) for x in ("headword", "headword_raw"))
    heads = F.array_compact(F.array(F.when(h != "", F.struct(c("headword").alias("k"), F.when(h == r, "headword, headword_raw").otherwise("headword").alias("on"))), F.when((r != "") & (h != r), F.struct(c("headword_raw").alias("k"), F.lit("headword_raw").alias("on")))))
    to_english = rows(m.withColumn("_e", F.explode(heads)), "mingrelian", "english", c("_e.k"), c("translation"), "master_lexicon", 2, c("headword"), c("headword_raw"), c("translation"), c("_e.on"))
    to_word = rows(m, "english", "mingrelian", c("translation"), c("headword"), "master_lexicon", 2, c("headword"), c("headword_raw"), c("translation"), "translation")
    return reduce(DataFrame.unionByName, [own, left, to_english, to_word]).filter(normalize(F.col("source_text")) != "")


def found_anywhere(lexica: Lexica, target: str) -> DataFrame:
    """_k, mingrelian, text, language: the first entry of any dictionary that has the key in any column, in seven levels; where a
    Mingrelian word has glosses in two languages, the one to translate to target by."""
    p, g, k = lexica.pairs, lexica.gal, lexica.kk
    gloss = bridge_gloss(F.col("russian"), F.col("georgian"), target)
    both = F.when((gloss["gloss"] != "") & (gloss["language"] != ""), gloss).otherwise(F.struct(F.col("georgian").alias("gloss"), F.lit("ka").alias("language")))
    plain = lambda text, code: F.struct((text if isinstance(text, Column) else F.col(text)).alias("gloss"), F.lit(code).alias("language"))
    levels = [
        (p, "mingrelian", plain("english", "en")), (p, "english", plain("english", "en")), (g, "mingrelian", plain("russian", "ru")), (g, "russian", plain("russian", "ru")),
        (k, "mingrelian", both), (k, "georgian", plain(primary("georgian", "ka"), "ka")), (k, "russian", plain(primary("russian", "ru"), "ru")),
    ]
    rows = [d.select(normalize(F.col(c)).alias("_k"), F.lit(i).alias("level"), "row_id", "mingrelian", other.alias("o")) for i, (d, c, other) in enumerate(levels)]
    first = reduce(DataFrame.unionByName, rows).filter("_k != ''").groupBy("_k").agg(F.min(F.struct("level", "row_id", "mingrelian", "o.gloss", "o.language")).alias("f"))
    language = F.create_map(*[F.lit(x) for pair in CODES.items() for x in pair])[F.col("f.language")]
    return first.select("_k", "f.mingrelian", F.col("f.gloss").alias("text"), language.alias("language"))


def cascade(requests: DataFrame, legs: list[tuple[str, Leg]]) -> DataFrame:
    """request_id, leg, answer: for each request the answer of the first leg that has one. A leg gets the requests that are left
    and returns request_id and answer; null and empty answers are none."""
    left, found = requests, []
    for name, leg in legs:
        hit = stored(leg(left).filter(F.coalesce("answer", F.lit("")) != "").select("request_id", F.lit(name).alias("leg"), "answer"), "leg")
        found.append(hit)
        left = left.join(hit.select("request_id"), "request_id", "left_anti")
    return reduce(DataFrame.unionByName, found)


def _probe(entries: DataFrame, text: str = "input_text", source: str | None = None, target: str | None = None) -> Leg:
    """Looks up text as a text of source in entries (source, target, _k, text)."""
    side = lambda name, given: F.lit(given) if given else F.col(name)

    def leg(r: DataFrame) -> DataFrame:
        asked = r.select("request_id", side("source", source).alias("source"), side("target", target).alias("target"), normalize(F.col(text)).alias("_k"))
        return asked.join(entries, ["source", "target", "_k"]).select("request_id", F.col("text").alias("answer"))

    return leg


def _translated(r: DataFrame, memory: DataFrame, text: str, source: Column | str, target: Column | str) -> DataFrame:
    """r with mt_text: text of the language source in the language target, null where machine translation has none."""
    side = lambda x: x if isinstance(x, Column) else F.lit(x)
    asked = r.select(*[F.col(c).alias(f"_own_{c}") for c in r.columns], side(source).alias("source"), side(target).alias("target"), F.col(text).alias("input_text"))
    return clients.machine_translate(asked, memory).select(*[F.col(f"_own_{c}").alias(c) for c in r.columns], "mt_text")


def to_mingrelian(requests: DataFrame, lexica: Lexica) -> DataFrame:
    """request_id, leg, answer of requests (request_id, input_text, source english or georgian) for Mingrelian: what the dictionaries
    say, else the text and then its translations into the other two languages, in order: a sole candidate before the first entry."""
    first, sole = stored(first_entries(direct_entries(lexica)), "first"), stored(sole_entries(lexica), "sole")
    asked, to, parts = requests.withColumn("target", F.lit("mingrelian")), "mingrelian", []
    for source, others in VARIANTS.items():
        legs: list[tuple[str, Leg]] = [("direct", _probe(first, target=to)), ("own_sole", _probe(sole, target=to))]
        for other in others:
            for kind, entries in (("sole", sole), ("first", first)):
                # each leg translates only what is left
                def leg(r: DataFrame, entries=entries, other=other, source=source) -> DataFrame:
                    return _probe(entries, "mt_text", other, to)(_translated(r, lexica.memory, "input_text", source, other))

                legs.append((f"{other}_{kind}", leg))
        parts.append(cascade(asked.filter(F.col("source") == source), legs))
    return reduce(DataFrame.unionByName, parts)


def from_mingrelian(requests: DataFrame, lexica: Lexica) -> DataFrame:
    """request_id, leg, answer of requests (request_id, input_text, target english or georgian) from Mingrelian: what the dictionaries
    say, else the first entry of any of them, as it is where it is in target's language, else translated onward."""
    first = stored(first_entries(direct_entries(lexica)), "first")
    asked, parts = requests.withColumn("source", F.lit("mingrelian")), []
    for target in ("english", "georgian"):
        known = stored(found_anywhere(lexica, target), "anywhere")

        def met(r: DataFrame, known=known) -> DataFrame:
            return r.select("request_id", normalize(F.col("input_text")).alias("_k")).join(known, "_k").select("request_id", "text", "language")

        def same(r: DataFrame, met=met, target=target) -> DataFrame:
            return met(r).filter(F.col("language") == target).select("request_id", F.col("text").alias("answer"))

        def onward(r: DataFrame, met=met, target=target) -> DataFrame:
            return _translated(met(r), lexica.memory, "text", F.col("language"), target).select("request_id", F.col("mt_text").alias("answer"))

        parts.append(cascade(asked.filter(F.col("target") == target), [("direct", _probe(first, source="mingrelian")), ("same_language", same), ("onward", onward)]))
    return reduce(DataFrame.unionByName, parts)
