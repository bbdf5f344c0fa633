"""Standalone and substring search over rows, in tiers, and over several dictionaries at once."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glossweave.functions.text import case_strip, compact, is_standalone_match, is_substring_match, normalize, preverb_strip
from glossweave.operators.lookup import inverted_index
from glossweave.sources.shared import dealt, stored

CAP, SEPARATOR = 10_000, "========\n"
#: So many words meet all rows at once; more of them go in blocks of as many.
SMALL = 10_000
#: What tolerant patterns pass over between the letters of a word.
GAP = r"[^\p{L}\p{N}_\s]+"
#: So many runs of characters at most are sent to every task; of a word, so many of the rarest are looked up.
MOST_GRAMS, PROBES = 200_000, 3


def in_blocks(words: DataFrame, meet: Callable[[DataFrame], DataFrame], n: int | None = None) -> DataFrame:
    """meet(some) of blocks of words that are small enough to send to every task; every word is in one block. n: a bound of how
    many words there are, where it is known."""
    blocks = max(1, -(-(words.count() if n is None else n) // SMALL))
    if blocks == 1:
        return meet(F.broadcast(words))
    # a block by hash holds SMALL words, give or take a few in a hundred
    part = F.pmod(F.xxhash64("word"), F.lit(blocks))
    return reduce(DataFrame.unionByName, [meet(F.broadcast(words.filter(part == i))) for i in range(blocks)])


def bare(c: Column) -> Column:
    """c as tolerant patterns see it: without the characters that may stand between letters, and with one form of each letter."""
    # letters are the same to a pattern if their capitals' small letters are; what stands between keeps the optimizer from lower(c)
    folded = F.translate(F.lower(F.translate(F.upper(F.regexp_replace(c, GAP, "")), "ς", "Σ")), "ς", "σ")
    return F.regexp_replace(folded, GAP, "")


def grams(c: Column, n: int) -> Column:
    """The distinct runs of n characters of c."""
    return F.array_distinct(F.regexp_extract_all(c, F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1)))


def gram_candidates(words: DataFrame, rows: DataFrame, whole: Column, row_id: str) -> DataFrame:
    """word, row_id: rows whose text `whole` may hold a word (of words: word, not blank) as tolerant patterns find it.

    Postings of runs of three characters (one or two for such words) are made for the runs that words have. A word meets the
    rows of all its PROBES rarest runs; a run that no row has ends the search for its words. A word of punctuation alone has no
    runs and is not in the result. Rows without a word's rarest runs are never looked at by pattern.
    """
    keyed = words.select("word", bare(compact(F.col("word"))).alias("_b")).withColumn("_n", F.least(F.length("_b"), F.lit(3))).filter("_n > 0")
    sizes = [r["_n"] for r in keyed.select("_n").distinct().collect()]
    if not sizes:
        return words.select("word").join(rows.select(row_id).limit(0))
    each = lambda c, on: F.flatten(F.array(*[F.when(on(n), grams(c, n)).otherwise(F.array().cast("array<string>")) for n in sizes]))
    asked = stored(keyed.select("word", F.explode(each(F.col("_b"), lambda n: F.col("_n") == n)).alias("gram")), "grams")
    needed = asked.select("gram").distinct()
    # a bounded number of runs goes to every task; more of them are joined by shuffle
    needed = F.broadcast(needed) if needed.count() <= MOST_GRAMS else needed
    postings = rows.select(row_id, bare(whole).alias("_b")).select(row_id, F.explode(each(F.col("_b"), lambda n: F.lit(True))).alias("gram"))
    postings = stored(postings.join(needed, "gram", "left_semi"), "postings")
    df = postings.groupBy("gram").agg(F.count(F.lit(1)).alias("df"))
    rare = Window.partitionBy("word").orderBy(F.coalesce("df", F.lit(0)), "gram")
    probes = asked.join(df, "gram", "left").withColumn("_r", F.row_number().over(rare)).filter(F.col("_r") <= PROBES)
    probes = probes.withColumn("_probes", F.count(F.lit(1)).over(Window.partitionBy("word"))).select("word", "gram", "_probes")
    met = postings.join(probes, "gram").groupBy("word", row_id).agg(F.count(F.lit(1)).alias("_met"), F.max("_probes").alias("_probes"))
    return met.filter("_met = _probes").select("word", row_id)


def tiered(words: DataFrame, rows: DataFrame, texts: str | list[str], row_id: str, prune: bool = True, whole: Column | None = None, index: list[str] | None = None, standalone_only: bool = False) -> DataFrame:
    """word, tier (1: standalone, 2: substring), row_id of distinct words (word).

    A word that the index of the columns `index` (texts unless given) knows is checked only in the rows of its posting list
    (prune); any other word is searched in all rows. A word stands alone in any of texts. Tier 2 is only for words without a
    row in tier 1, and searches `whole` (texts, tab-parted, unless given; it holds all of texts). What is searched in all rows
    meets the rows of its gram_candidates(), and words of punctuation alone meet all rows in blocks of SMALL. Null and blank
    words find nothing.
    """
    texts = [texts] if isinstance(texts, str) else texts
    whole = F.concat_ws("\t", *texts) if whole is None else whole
    words = stored(words.select("word").filter(compact(F.col("word")) != "").distinct(), "words")
    if words.isEmpty():
        return words.select("word", F.lit(1).alias("tier")).join(rows.select(row_id).limit(0))
    odd = words.filter(bare(compact(F.col("word"))) == "")
    n = odd.count()
    alone = reduce(lambda a, b: a | b, [is_standalone_match(F.col(c), F.col("word")) for c in texts])
    some = rows.select(row_id, *dict.fromkeys(texts))
    may = stored(gram_candidates(words, rows, whole, row_id), "candidates")

    def meet(asked: DataFrame, table: DataFrame, matched: Column) -> DataFrame:
        out = may.join(asked, "word", "left_semi").join(table, row_id).filter(matched).select("word", row_id)
        if not n:
            return out
        return out.unionByName(in_blocks(odd.join(asked, "word", "left_semi"), lambda w: table.join(w, matched).select("word", row_id), n))

    if prune:
        keyed = words.withColumn("term", normalize(F.col("word")))
        postings = stored(inverted_index(rows, index or texts, row_id).join(keyed, "term").select("word", row_id), "postings")
        one = postings.join(some, row_id).filter(alone).select("word", row_id)
        one = one.unionByName(meet(words.join(postings.select("word").distinct(), "word", "left_anti"), some, alone))
    else:
        one = meet(words, some, alone)
    one = stored(one, "standalone")
    found = one.select("word", F.lit(1).alias("tier"), row_id)
    if standalone_only:
        return found
    rest = words.join(one.select("word").distinct(), "word", "left_anti")
    two = meet(rest, rows.select(row_id, whole.alias("_whole")), is_substring_match(F.col("_whole"), F.col("word")))
    return found.unionByName(two.select("word", F.lit(2).alias("tier"), row_id))


def formatted(found: DataFrame, rows: DataFrame, entry: Column, row_id: str, cap: int = CAP) -> DataFrame:
    """word, output, has_standalone: the entries of a word's rows in order, each between separators, cut at cap.

    An entry with its separator has over len(SEPARATOR) characters, so no more than cap / len(SEPARATOR) rows of a word can
    show; the rest go before any row is gathered.
    """
    most = cap // len(SEPARATOR) + 1
    w = Window.partitionBy("word").orderBy(row_id)
    first = found.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= most).drop("_n")
    full = first.join(rows.select(row_id, F.substring(entry, 1, cap).alias("_t")), row_id)
    out = full.groupBy("word").agg(F.sort_array(F.collect_list(F.struct(row_id, "_t"))).alias("r"), (F.min("tier") == 1).alias("has_standalone"))
    text = F.concat(F.lit(SEPARATOR), F.array_join(F.transform("r", lambda x: F.concat(x["_t"], F.lit(SEPARATOR))), ""))
    return out.select("word", F.substring(text, 1, cap).alias("output"), "has_standalone")


@dataclass
class Source:
    """A dictionary to search: rows (row_id, ...), the columns in which a word may stand alone, the columns of its index, the
    text for substrings, and how a row is shown. indexed=False looks through all rows for every word. kept: rows is a table that
    many tasks can read."""

    name: str
    rows: DataFrame
    texts: list[str]
    entry: Column
    index: list[str] | None = None
    whole: Column | None = None
    indexed: bool = True
    kept: bool = False

    def keep(self) -> Source:
        """The source with its rows stored over many files: a search reads them several times, and by row at some cost."""
        return self if self.kept else replace(self, rows=stored(dealt(self.rows), "source"), kept=True)

    def search(self, words: DataFrame, standalone_only: bool = False, cap: int = CAP) -> DataFrame:
        """word, output, has_standalone of the words (word) that are found."""
        rows = self.keep().rows
        found = tiered(words, rows, self.texts, "row_id", self.indexed, self.whole, self.index, standalone_only)
        return formatted(found, rows, self.entry, "row_id", cap)


def sentence_pairs(rows: DataFrame) -> Source:
    """Of rows (row_id, mingrelian, english)."""
    return Source("pairs", rows, ["mingrelian", "english"], F.concat(F.lit("Mingrelian: "), "mingrelian", F.lit("\nEnglish: "), "english", F.lit("\n")))


def russian_dictionary(rows: DataFrame) -> Source:
    """Of rows (row_id, russian, mingrelian)."""
    entry = F.concat(F.lit("Mingrelian: "), "mingrelian", F.lit("\nRussian: "), "russian", F.lit("\n"))
    return Source("gal", rows, ["mingrelian", "russian"], entry, whole=F.concat_ws("\t", "russian", "mingrelian"))


def four_column_dictionary(rows: DataFrame) -> Source:
    """Of rows (row_id, mingrelian, ipa, russian, georgian)."""
    from glossweave.functions.text import dictionary_entry

    entry = F.concat(dictionary_entry(F.col("mingrelian"), F.col("russian"), F.col("georgian")), F.lit("\n"))
    every = ["mingrelian", "ipa", "russian", "georgian"]
    return Source("kk", rows, ["mingrelian", "russian", "georgian"], entry, index=every, whole=F.concat_ws("\t", *every))


def context(rows: DataFrame) -> Source:
    """Of rows (row_id, entry): paragraphs. Every word looks through all of them."""
    return Source("context", rows, ["entry"], F.concat(F.trim("entry"), F.lit("\n")), indexed=False)


def _probe(requests: DataFrame, asked: DataFrame, term: str, source: Source, name: str) -> DataFrame:
    """requests with `name` (what the source shows for the column term of asked, empty if nothing) and `name`_alone."""
    found = source.search(asked.select(F.col(term).alias("word"))).select(F.col("word").alias(term), F.col("output").alias(name), F.col("has_standalone").alias(f"{name}_alone"))
    return requests.join(found, term, "left").withColumn(name, F.coalesce(name, F.lit(""))).withColumn(f"{name}_alone", F.coalesce(f"{name}_alone", F.lit(False)))


def _searched(requests: DataFrame, legs: list[tuple[str, str, Source]], fallback: tuple[str, Source] | None = None) -> DataFrame:
    """requests with a column for each leg (name, term column, source), and `any`: some leg has a standalone row; with a fallback
    (term, source) `context`, searched only for requests of which that is not so."""
    asked = out = stored(requests, "requests")
    for name, term, source in legs:
        out = _probe(out, asked, term, source, name)
    out = stored(out.withColumn("any", reduce(lambda a, b: a | b, [F.col(f"{name}_alone") for name, _, _ in legs])), "searched")
    if not fallback:
        return out
    late = out.withColumn("_late", F.when(~F.col("any"), F.col(fallback[0])))
    return stored(_probe(late, late, "_late", fallback[1], "context").drop("_late"), "searched")


def _output(word: Column, *parts: Column) -> Column:
    return F.substring(F.concat(F.lit("\nResults for "), word, F.lit(":\n"), *parts), 1, CAP)


def from_english(requests: DataFrame, pairs: Source, gal: Source, kk: Source, notes: Source) -> DataFrame:
    """word, output of requests (word, russian, georgian: its translations, null where there is none): pairs by the word, gal
    and kk by its Russian, kk by its Georgian; notes by its Georgian if none of them has a standalone row."""
    r, kk = requests.select("word", F.coalesce("russian", "word").alias("ru"), F.coalesce("georgian", "word").alias("ka")).distinct(), kk.keep()
    r = _searched(r, [("pairs", "word", pairs), ("gal", "ru", gal), ("kk_ru", "ru", kk), ("kk_ka", "ka", kk)], ("ka", notes))
    return r.select("word", _output(F.col("word"), F.col("pairs"), F.col("gal"), F.col("kk_ru"), F.col("kk_ka"), F.col("context")).alias("output"))


def from_georgian(requests: DataFrame, pairs: Source, gal: Source, kk: Source, notes: Source) -> DataFrame:
    """word, output of requests (word, english, russian): pairs by its English, kk by the word, gal by its Russian, then notes by
    the word if none of them has a standalone row."""
    r = requests.select("word", F.coalesce("english", "word").alias("en"), F.coalesce("russian", "word").alias("ru")).distinct()
    r = _searched(r, [("pairs", "en", pairs), ("kk", "word", kk), ("gal", "ru", gal)], ("word", notes))
    return r.select("word", _output(F.col("word"), F.col("pairs"), F.col("kk"), F.col("gal"), F.col("context")).alias("output"))


def _stems(lost: DataFrame, stems: list[tuple[str, Column]], pairs: Source, gal: Source, kk: Source, notes: Source) -> DataFrame:
    """word, more: for words of lost, what their first stem that any source knows shows; standalone rows alone where there are any.
    stems: kinds and their stems (array) in order; one search is for all of them."""
    tried = reduce(DataFrame.unionByName, [lost.select("word", F.lit(n).alias("n"), F.lit(kind).alias("kind"), F.posexplode(c).alias("i", "stem")) for n, (kind, c) in enumerate(stems)])
    legs = [("pairs", "stem", pairs), ("gal", "stem", gal), ("kk", "stem", kk), ("context", "stem", notes)]
    s, alone = _searched(tried, legs), F.col("any")
    shown = F.concat(*[F.when(~alone | F.col(f"{name}_alone"), F.col(name)).otherwise("") for name, _, _ in legs])
    head = F.concat(F.lit("\n["), "kind", F.lit("-stripped fallback: "), "word", F.lit(" → "), "stem", F.lit("]\n"))
    hits = s.select("word", "n", "i", shown.alias("shown"), head.alias("head")).filter("shown != ''")
    return hits.groupBy("word").agg(F.min(F.struct("n", "i", F.concat("head", "shown").alias("more"))).alias("m")).select("word", "m.more")


def from_mingrelian(words: DataFrame, pairs: Source, gal: Source, kk: Source, notes: Source, case_stems: Callable[[Column], Column] = case_strip, verb_stem: Callable[[Column], Column] = preverb_strip) -> DataFrame:
    """word, output of words (word): pairs, gal and kk, then notes if none of them has a standalone row. A word that nothing
    matches is tried without its case ending, each stem in order, and then without its preverb."""
    pairs, gal, kk, notes = pairs.keep(), gal.keep(), kk.keep(), notes.keep()
    r = _searched(words.select("word").distinct(), [("pairs", "word", pairs), ("gal", "word", gal), ("kk", "word", kk)], ("word", notes))
    r = r.select("word", F.concat("pairs", "gal", "kk", "context").alias("shown"))
    lost = r.filter("shown = ''").select("word")
    kinds = [("Case", case_stems(F.col("word"))), ("Preverb", F.array_compact(F.array(verb_stem(F.col("word")))))]
    more = _stems(lost, kinds, pairs, gal, kk, notes)
    return r.join(more, "word", "left").select("word", _output(F.col("word"), F.col("shown"), F.coalesce("more", F.lit(""))).alias("output"))
