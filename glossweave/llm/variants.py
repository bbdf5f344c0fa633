"""Operator 11: spelling variants by wildcard groups, without pairs of words. DataFrame functions only.

Words are runs of letters, in lower case for A-Z, of which one letter is left out where a hash of doc_id and run says so; those
that are long enough and occur often enough are the vocabulary (word, n). Two words are near if one inserted, deleted or
replaced letter parts them.

Words are numbered by n, most first, and then in code-point order, so the better of two words is the one of smaller number, and
numbers travel instead of words.

- Replacements: a word is in one group for each of its places, named by (place, what is before, what is after). A group keeps
  its size and its top two words. In each of its groups a word has size - 1 near words, and the best of them is the first
  of the group, or the second for the first itself. Two words meet in one group at most, so sizes add up.
- Insertions and deletions: each distinct deletion of a word is looked up in the vocabulary. What is found is near the longer
  word, and the longer word near it; each side keeps a count and its best only.
- Both are summed up by word. A word's form is its best near word if that is `times` as frequent, and its root where forms end.
  n grows at least `times` fold with each form, so a chain of k forms needs n >= times^k; roots are found by doubling.

A word makes a row for each letter, whatever its number of near words; counts are summed in each task before they are
shuffled, so a word in every document is one row a task. A group has at most as many rows as letters can stand at one place.
Of a word over CHUNK letters a row holds the chunk of the place and hashes (MD5) of what is before and after that chunk.

Null text has no words; neither have empty texts or those without long runs. A null doc_id hashes as an empty id. Rows that
repeat count each. Ties in n go to the smaller word in code-point order. An empty table gives no rows. A very long text is read
whole by one task; a very long run takes time by the square of its length over CHUNK, and room by CHUNK times its length. Other
columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glossweave.llm.common import forget, scratch_table
from glossweave.llm.importance import CRC32_TABLE, crc32_sql
from glossweave.operators.lookup import ranked

LETTERS = r"A-Za-zÀ-ÿ"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LEAST, TWICE, TIMES, DROP = 7, 2, 10, 31
CHUNK = 48


def without(word: Column, place: Column, instead: str = "") -> Column:
    """word with the letter at place (from 1) replaced."""
    return F.concat(F.substr(word, F.lit(1), place - 1), F.lit(instead), F.substr(word, place + 1))


def vocabulary(docs: DataFrame, least: int = LEAST, twice: int = TWICE, drop: int = DROP) -> DataFrame:
    """word, n of docs (doc_id, text): words of `least` letters that occur `twice`."""
    runs = F.explode(F.regexp_extract_all(F.col("text").cast("string"), F.lit(f"[{LETTERS}]{{{least},}}"), F.lit(0)))
    rows = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("_d"), runs.alias("_r"))
    # lower() is quick, and right where there are no letters but those of ASCII
    low = F.when(F.col("_r").rlike(r"[À-ÿ]"), F.translate("_r", UPPER, LOWER)).otherwise(F.lower("_r"))
    rows = rows.select("_d", low.alias("_r")).withColumn("_h", F.crc32(F.concat("_d", F.lit(":"), "_r").cast("binary")))
    word = F.when(F.col("_h") % drop == 0, without(F.col("_r"), (F.col("_h") % F.length("_r") + 1).cast("int"))).otherwise(F.col("_r"))
    return rows.select(word.alias("word")).filter(F.length("word") >= least).groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= twice)


def _digest(part: Column) -> Column:
    return F.when(part == "", F.lit("")).otherwise(F.md5(part.cast("binary")))


def _chunks(words: DataFrame, more: int) -> DataFrame:
    """id, at (before the chunk), and before, chunk and after for each chunk of CHUNK - more letters, chunks being placed as in a word
    that is longer by `more`."""
    count = F.ceil((F.length("word") + more) / CHUNK).cast("int")
    cut = words.select("id", "word", F.explode(F.sequence(F.lit(0), count - 1)).alias("k")).withColumn("at", F.col("k") * CHUNK)
    end = F.col("at") + (CHUNK - more)
    return cut.select("id", "at", _digest(F.substr("word", F.lit(1), F.col("at"))).alias("before"), F.substr("word", F.col("at") + 1, F.lit(CHUNK - more)).alias("chunk"), _digest(F.substr("word", end + 1)).alias("after"))


def _name(*parts: Column | str) -> Column:
    """One string of parts, which hold no bar."""
    return F.concat_ws("|", *parts)


def replaced(words: DataFrame) -> DataFrame:
    """id, near, best: for each group that holds a word (id, word) with others."""
    each = _chunks(words, 0).withColumn("place", F.explode(F.sequence(F.lit(1), F.length("chunk"))))
    group = each.select("id", _name("at", "before", without(F.col("chunk"), F.col("place"), "*"), "after").alias("group"))
    w = Window.partitionBy("group").orderBy("id").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    kept = group.select("id", F.count(F.lit(1)).over(w).alias("size"), F.first("id").over(w).alias("first"), F.nth_value("id", 2).over(w).alias("second"))
    return kept.filter("size > 1").select("id", (F.col("size") - 1).alias("near"), F.when(F.col("first") == F.col("id"), F.col("second")).otherwise(F.col("first")).alias("best"))


def inserted(words: DataFrame) -> DataFrame:
    """id, near, best: for each word (id, word) what its deletions find, and what finds it."""
    shorter = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("chunk")), lambda i: without(F.col("chunk"), i)))
    name = lambda chunk: _name("at", "before", chunk, "after").alias("name")
    cut = _chunks(words, 0).withColumn("one", F.explode(shorter)).select(F.col("id").alias("long"), name("one"))
    found = cut.join(_chunks(words, 1).select(F.col("id").alias("short"), name("chunk")).hint("merge"), "name").select("long", "short")
    # a deletion at the seam of two chunks is found by either
    found = found.distinct()
    ends = found.select(F.explode(F.array(F.struct(F.col("long").alias("id"), F.col("short").alias("best")), F.struct(F.col("short").alias("id"), F.col("long").alias("best")))).alias("e"))
    return ends.groupBy("e.id").agg(F.count(F.lit(1)).alias("near"), F.min("e.best").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """id, root for forms (id, form): each round doubles how far a word looks."""
    at = scratch_table(forms.select("id", F.col("form").alias("root")), "roots")
    while True:
        step = at.select(F.col("id").alias("root"), F.col("root").alias("further"))
        new = scratch_table(at.join(step.hint("merge"), "root", "left").select("id", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        forget(at)
        at = new.select("id", "root")
        if new.filter("moved").isEmpty():
            return at
        at.scratch = new.scratch


def group_variants(docs: DataFrame, least: int = LEAST, twice: int = TWICE, times: int = TIMES, drop: int = DROP) -> DataFrame:
    """word, form, root, n, n_near, form_n of the vocabulary of docs (doc_id, text)."""
    counted = scratch_table(vocabulary(docs, least, twice, drop), "vocabulary")
    words = scratch_table(ranked(counted.withColumn("low", -F.col("n")), ["low", "word"], "id").drop("low"), "words")
    forget(counted)
    near = replaced(words).unionByName(inserted(words)).groupBy("id").agg(F.sum("near").alias("near"), F.min("best").alias("best"))
    rows = words.select("id", "n").join(near.hint("merge"), "id", "left")
    best = words.select(F.col("id").alias("best"), F.col("n").alias("best_n"))
    rows = rows.join(best.hint("merge"), "best", "left")
    good = F.col("best_n") >= times * F.col("n")
    forms = scratch_table(rows.select("id", F.when(good, F.col("best")).alias("form"), F.when(good, F.col("best_n")).alias("form_n"), F.coalesce("near", F.lit(0)).cast("long").alias("n_near")), "forms")
    linked = forms.filter("form is not null")
    named = linked.select("id", "form", "form_n").join(roots(linked).hint("merge"), "id")
    for end in ("form", "root"):
        named = named.withColumnRenamed(end, "_id").join(words.select(F.col("id").alias("_id"), F.col("word").alias(end)).hint("merge"), "_id").drop("_id")
    named = named.select("id", "form", "root", "form_n")
    out = words.join(forms.select("id", "n_near").hint("merge"), "id").join(named.hint("merge"), "id", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def sql() -> str:
    """What group_variants() returns for the table documents, for DuckDB."""
    return rf"""with recursive {CRC32_TABLE},
 r as (select doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{{C0}}-\x{{FF}}]{{{LEAST},}}')), '{UPPER}', '{LOWER}') as run from documents),
 d as (select doc_id, run, count(*) as n from r group by all), h as (select run, n, {crc32_sql("doc_id || ':' || run")} as h from d, crc_table),
 o as (select case when h % {DROP} = 0 then substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) else run end as word, n from h),
 v as materialized (select word, sum(n)::bigint as n from o where length(word) >= {LEAST} group by word having sum(n) >= {TWICE}),
 p as (select word, n, unnest(range(length(word))) as i from v),
 w as (select word, n, substr(word, 1, i) || '*' || substr(word, i + 2) as k from p), c as (select distinct word, n, substr(word, 1, i) || substr(word, i + 2) as k from p),
 near as (select a.word, b.word as other, b.n from w a join w b using (k) where a.word <> b.word union all select c.word, v.word, v.n from c join v on c.k = v.word union all select v.word, c.word, c.n from c join v on c.k = v.word),
 best as (select word, count(*) as n_near, max(n) as other_n from near group by word),
 top as (select word, n_near, other_n, (select min(other) from near x where x.word = best.word and x.n = best.other_n) as other from best),
 f as (select v.word, v.n, coalesce(n_near, 0) as n_near, case when other_n >= {TIMES} * v.n then other end as form, case when other_n >= {TIMES} * v.n then other_n end as form_n from v left join top using (word)),
 walk as (select word, word as root from f union all select walk.word, f.form from walk join f on f.word = walk.root where f.form is not null),
 root as (select walk.word, walk.root from walk join f on f.word = walk.root where f.form is null)
 select f.word, form, root.root, n, n_near, form_n from f join root on root.word = f.word"""
