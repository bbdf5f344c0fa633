"""Queries of the lexicon engine over the stand-in tables, each beside the SQL that DuckDB runs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossweave.functions import extract, prompts, text
from glossweave.operators import analytics, clients, etl, evals, lookup, search
from glossweave.plans import translate
from glossweave.sources import readers, sinks
from glossweave.sources.shared import dealt, scratch_path
from glossweave.streaming.events import append_events

NORM = r"lower(regexp_replace(regexp_replace(coalesce({0},''),'^[\s\p{{Z}}]+|[\s\p{{Z}}]+$','','g'),'[\s\p{{Z}}]+',' ','g'))"
TOK = r"[\p{L}\p{N}_]+"
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
SEARCH_WORDS = ["the", "that", "idiot", "ing.", "MIT License", "zz"]


def n(x: str) -> str:
    return NORM.format(x)


def query(name: str, sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def t(s: SparkSession, d: str, name: str) -> DataFrame:
    return s.read.parquet(f"{d}/{name}.parquet")


@query("normalize_dups", f"select {n('text')} as term, min(doc_id) as first_id, count(*) as n from documents group by 1 having count(*) > 1")
def normalize_dups(s, d):
    return t(s, d, "documents").groupBy(text.normalize(F.col("text")).alias("term")).agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("n")).filter("n > 1")


@query("inverted_index_df", f"""with x as (select doc_id, {n('text')} as term from documents union
 select doc_id, lower(unnest(regexp_extract_all(text,'{TOK}'))) from documents) select term, count(*) as df from x where term <> '' group by 1""")
def inverted_index_df(s, d):
    return lookup.inverted_index(t(s, d, "documents"), ["text"], "doc_id").groupBy("term").agg(F.count(F.lit(1)).alias("df"))


@query("exact_index", f"select {n('p_name')} as term, count(distinct p_partkey) as n, min(p_partkey) as first from part group by 1")
def exact_index(s, d):
    return lookup.exact_index(t(s, d, "part"), "p_name", "p_partkey").groupBy("term").agg(F.count(F.lit(1)).alias("n"), F.min("p_partkey").alias("first"))


@query("exact_lookup", "select distinct '  ' || upper(r.p_name) || ' ' as request, p.p_partkey from part r join part p on lower(r.p_name) = lower(p.p_name)")
def exact_lookup(s, d):
    part = t(s, d, "part").select("p_partkey", "p_name")
    return lookup.exact(part.select(F.concat(F.lit("  "), F.upper("p_name"), F.lit(" ")).alias("request")).distinct(), "request", part, "p_name").select("request", "p_partkey")


@query("override_lookup", "select distinct upper(a.p_type) as p_type, a.p_brand, a.p_name, b.p_retailprice as target from part a join part b on a.p_type = b.p_type and a.p_brand = b.p_brand and a.p_name = b.p_name")
def override_lookup(s, d):
    part = t(s, d, "part")
    requests = part.select(F.upper("p_type").alias("p_type"), "p_brand", "p_name").distinct()
    rows = part.select(F.col("p_type").alias("a"), F.col("p_brand").alias("b"), F.col("p_name").alias("c"), F.col("p_retailprice").alias("target"))
    return lookup.composite(requests, rows, {"p_type": "a", "p_brand": "b", "p_name": "c"}).select("p_type", "p_brand", "p_name", "target").distinct()


@query("or_field_lookup", """with r as (select distinct p_brand as request from part union select distinct p_type from part),
 h as (select request, p_partkey, lower(request)=lower(p_name) as a, lower(request)=lower(p_type) as b, lower(request)=lower(p_brand) as c from r join part on lower(request) in (lower(p_name),lower(p_type),lower(p_brand)))
 select request, p_partkey, concat_ws(', ', case when a then 'p_name' end, case when b then 'p_type' end, case when c then 'p_brand' end) as matched_on from h""")
def or_field_lookup(s, d):
    part = t(s, d, "part")
    requests = part.select(F.col("p_brand").alias("request")).union(part.select("p_type")).distinct()
    return lookup.any_field(requests, "request", part, ["p_name", "p_type", "p_brand"], "p_partkey")


@query("override_short_circuit", """with o as (select p_name, p_partkey from part where p_size <= 10), b as (select p_name, p_partkey from part where p_size > 10)
 select p_name, p_partkey, 'override' as source from o union all select p_name, p_partkey, 'base' from b where p_name not in (select p_name from o)""")
def override_short_circuit(s, d):
    part = t(s, d, "part")
    rows = lambda c, source: part.filter(c).select("p_name", "p_partkey", F.lit(source).alias("source"))
    return lookup.short_circuit(rows("p_size <= 10", "override"), rows("p_size > 10", "base"), ["p_name"])


@query("priority_first_match", """select p_name, priority, p_partkey from (select p_name, p_size // 10 as priority, p_partkey,
 row_number() over (partition by p_name order by p_size // 10, p_partkey) as n from part) where n = 1""")
def priority_first_match(s, d):
    part = t(s, d, "part").select("p_name", F.floor(F.col("p_size") / 10).cast("int").alias("priority"), "p_partkey")
    return lookup.first_match(part, ["p_name"], ["priority", "p_partkey"])


@query("seven_level_priority", """with r as (select distinct lower(p_type) as request from part), l as (
 select lower(p_name) as k, 1 as p, p_partkey from part where p_size % 3 = 0 union all select lower(p_type), 2, p_partkey from part where p_size > 45
 union all select lower(p_brand), 3, p_partkey from part union all select lower(p_name), 4, p_partkey from part
 union all select lower(p_type), 5, p_partkey from part where p_size > 30 union all select lower(p_brand), 6, p_partkey from part union all select lower(p_type), 7, p_partkey from part)
 select request, p as priority, p_partkey from (select request, p, p_partkey, row_number() over (partition by request order by p, p_partkey) as n from r join l on k = request) where n = 1""")
def seven_level_priority(s, d):
    part = t(s, d, "part")
    levels = [("p_name", "p_size % 3 = 0"), ("p_type", "p_size > 45"), ("p_brand", "true"), ("p_name", "true"), ("p_type", "p_size > 30"), ("p_brand", "true"), ("p_type", "true")]
    return lookup.prioritised(part.select(F.col("p_type").alias("request")), "request", part, "p_partkey", [(f, F.expr(on)) for f, on in levels])


@query("candidate_merge_dedupe", """with e as (select lower(p_name) as key, p_brand, min(p_partkey) as o, count(*) as c from part group by 1, 2)
 select key, string_agg(p_brand, ', ' order by o) as sources, min(o) as first, cast(sum(c) as bigint) as n from e group by 1""")
def candidate_merge_dedupe(s, d):
    return lookup.merge_candidates(t(s, d, "part").withColumn("key", text.normalize(F.col("p_name"))), "key", "p_brand", "p_partkey")


@query("token_first_target", f"""with r as (select distinct lower(unnest(regexp_extract_all(p_type,'{TOK}'))) as token from part),
 x as (select p_partkey, lower(unnest(regexp_extract_all(p_type,'{TOK}'))) as token, lower(p_brand) as target from part)
 select token, target, min(p_partkey) as p_partkey from x join r using (token) group by 1, 2""")
def token_first_target(s, d):
    part = t(s, d, "part")
    rows = part.select("p_partkey", text.normalize(F.col("p_brand")).alias("target"), F.explode(F.array_distinct(text.tokens(F.col("p_type")))).alias("token"))
    return lookup.first_match(rows.join(rows.select("token").distinct(), "token"), ["token", "target"], ["p_partkey"]).select("token", "target", "p_partkey")


_EDGE = r"(^|[^\p{L}\p{N}_])"
_GAP = r"[^\p{L}\p{N}_\s]*"


def _pattern(word: str) -> str:
    import re

    return re.escape(word) if len(word) <= 2 else _GAP.join(re.escape(c) for c in word)


@query("standalone_search", f"""select doc_id from documents where regexp_matches(text, '(?i){_EDGE}{_pattern("the")}($|[^\\p{{L}}\\p{{N}}_])')""")
def standalone_search(s, d):
    return t(s, d, "documents").filter(text.is_standalone_match(F.col("text"), F.lit("the"))).select("doc_id")


@query("substring_search", "select item_id, doc_id from benchmark b join documents d on contains(d.text, b.text)")
def substring_search(s, d):
    # a document that contains an item whole holds the item's rarest inner word, so an equi-join on it prunes the pairs
    docs, items = t(s, d, "documents").select("doc_id", "text"), t(s, d, "benchmark").select("item_id", F.col("text").alias("item"))
    words = F.array_distinct(F.split("text", " "))
    inner = items.withColumn("w", F.split("item", " ")).withColumn("w", F.slice("w", F.lit(2), F.greatest(F.size("w") - 2, F.lit(0))))
    needles = inner.select("item_id", F.explode_outer(F.array_distinct("w")).alias("word"))
    grams = docs.select("doc_id", F.explode(words).alias("word"))
    df = grams.join(needles.select("word").distinct(), "word", "left_semi").groupBy("word").agg(F.count(F.lit(1)).alias("df"))
    key = lookup.first_match(needles.filter("word is not null").join(df, "word", "left").fillna(0, ["df"]), ["item_id"], ["df", "word"])
    pruned = grams.join(key.select("item_id", "word"), "word").select("item_id", "doc_id")
    whole = pruned.join(items, "item_id").join(docs, "doc_id").filter(F.contains("text", "item")).select("item_id", "doc_id")
    # items without an inner word prune nothing; they meet all rows, in blocks
    bare = items.join(needles.filter("word is null").select("item_id"), "item_id").select("item_id", F.col("item").alias("word"))
    return whole.unionByName(search.in_blocks(bare, lambda w: docs.join(w, F.contains("text", "word")).select("item_id", "doc_id")))


def _tier_sql() -> str:
    words = ", ".join(f"('{w}', '(?i){_EDGE}{_pattern(w)}($|[^\\p{{L}}\\p{{N}}_])', '(?i){_pattern(w)}')" for w in SEARCH_WORDS)
    return f"""with w(word, one, two) as (values {words}), a as (select word, doc_id from w, documents where regexp_matches(text, one)),
 b as (select word, doc_id from w, documents where word not in (select word from a) and (contains(text, word) or regexp_matches(text, two)))
 select word, 1 as tier, doc_id from a union all select word, 2, doc_id from b"""


@query("tiered_search", _tier_sql())
def tiered_search(s, d):
    words = s.createDataFrame([(w,) for w in SEARCH_WORDS], "word string")
    return search.tiered(words, t(s, d, "documents"), "text", "doc_id", prune=False).select("word", "tier", "doc_id")


_SPACE = r"[\s\x0b\x0c\x1c-\x1f\x{85}\p{Z}]"


def _stripped(x: str) -> str:
    return f"regexp_replace({x}, '^{_SPACE}+|{_SPACE}+$', '', 'g')"


@query("context_block_split", rf"""with x as (select doc_id, list_filter(list_transform(string_split_regex({_stripped('text')}, '\n\s*\n'), lambda b: {_stripped('b')}), lambda b: b <> '') as b from documents)
 select doc_id, unnest(generate_series(0, len(b) - 1)) as pos, unnest(b) as block from x where len(b) > 0""")
def context_block_split(s, d):
    return t(s, d, "documents").select("doc_id", F.posexplode(readers.blocks(F.col("text"))).alias("pos", "block")).withColumn("pos", F.col("pos").cast("long"))


_STOP = ", ".join(f"'{w}'" for w in text.STOP_WORDS["english"])


def _strip(x: str) -> str:
    return f"trim({x}, '" + (text.PUNCTUATION + text.QUOTES).replace("'", "''") + "')"


@query("stopword_filtered_tokens", f"""with x as (select item_id, list_filter(string_split_regex(trim(text), '\\s+'), lambda x: x <> '') as w from benchmark),
 y as (select item_id, len(w) as n, unnest(generate_series(0, len(w) - 1)) as pos, {_strip('unnest(w)')} as token from x)
 select item_id, pos, token from y where token <> '' and not (n > 1 and lower(token) in ({_STOP}))""")
def stopword_filtered_tokens(s, d):
    words = F.filter(F.split(F.trim("text"), r"\s+"), lambda w: w != "")
    x = t(s, d, "benchmark").select("item_id", F.size(words).alias("n"), F.posexplode(words).alias("pos", "w")).withColumn("token", text.strip_token(F.col("w")))
    return x.filter((F.col("token") != "") & ~text.is_low_value(F.col("token"), "english", F.col("n"))).select("item_id", F.col("pos").cast("long").alias("pos"), "token")


_LOW = f"lower({_strip('token')})"


@query("token_variants", f"""with x as (select distinct unnest(string_split_regex(text, '\\s+')) as token from benchmark), y as (select token, {_strip('token')} as w, {_LOW} as l from x),
 z as (select token, w as variant from y union select token, l from y union select token, left(l, length(l) - 2) from y where l like '%''s' and length(l) > 2
 union select token, left(l, length(l) - 3) || 'y' from y where l like '%ies' and length(l) > 4
 union select token, left(l, length(l) - 1) from y where l like '%s' and l not like '%ss' and length(l) > 3 and not (l like '%ies' and length(l) > 4))
 select token, variant from z where trim(variant) <> ''""")
def token_variants(s, d):
    words = t(s, d, "benchmark").select(F.explode(F.split("text", r"\s+")).alias("token")).distinct()
    return words.select("token", F.explode(text.english_variants(F.col("token"))).alias("variant"))


@query("suffix_strip_fallback", """with x as (select distinct unnest(regexp_extract_all(lower(text), '[a-z]+')) as token from benchmark),
 y as (select token, case when token like '%tion' and length(token) >= 7 then 4 when token like '%ing' and length(token) >= 6 then 3 when token like '%ed' and length(token) >= 5 then 2 when token like '%er' and length(token) >= 5 then 2 end as n from x)
 select token, left(token, length(token) - n) as stem from y where n is not null""")
def suffix_strip_fallback(s, d):
    words = t(s, d, "benchmark").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("token")).distinct()
    stems = text.suffix_strip(F.col("token"), ["tion", "ing", "ed", "er"], plurals=[], vowels="abcdefghijklmnopqrstuvwxyz")
    return words.select("token", F.explode(stems).alias("stem"))


@query("preverb_strip_fallback", """with x as (select distinct unnest(regexp_extract_all(lower(text), '[a-z]+')) as token from benchmark),
 y as (select token, regexp_extract(token, '^(?:th|re|in|a)(.{3,})$', 1) as stem from x where length(token) >= 5) select token, stem from y where stem <> ''""")
def preverb_strip_fallback(s, d):
    words = t(s, d, "benchmark").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("token")).distinct()
    return words.select("token", text.preverb_strip(F.col("token"), ["th", "re", "in", "a"]).alias("stem")).filter("stem is not null")


_GLOSS = "p_name || '; ' || p_type || ' or ' || p_brand || ' (x)'"


@query("gloss_split_candidates", f"""with x as (select p_partkey, regexp_replace({_GLOSS}, '\\s*\\([^)]*\\)', '', 'g') as g from part),
 y as (select p_partkey, g as c from x union select p_partkey, unnest(string_split_regex(g, '(?i)\\s*(?:;|,|\\bor\\b)\\s*')) from x)
 select distinct p_partkey, trim(c, ' .;,:') as candidate from y where length(trim(c, ' .;,:')) > 1 and length(trim(c, ' .;,:')) <= 90""")
def gloss_split_candidates(s, d):
    gloss = F.concat("p_name", F.lit("; "), "p_type", F.lit(" or "), "p_brand", F.lit(" (x)"))
    return dealt(t(s, d, "part")).select("p_partkey", F.explode(etl.candidates(gloss, 90)).alias("candidate"))


@query("skip_reason_counts", f"""with x as (select unnest(string_split(text, chr(10))) as g from documents), y as (select g, {n('g')} as l from x),
 z as (select case when l = '' then 'empty_gloss' when length(l) > 200 then 'long_gloss' when {' or '.join(f"starts_with(l, '{p}')" for p in etl.BAD_PREFIXES)} then 'gloss_prefix'
 when {' or '.join(f"contains(l, '{p}')" for p in etl.BAD_FRAGMENTS)} then 'gloss_fragment' when contains(g, ':') then 'gloss_explanation' else 'ok' end as reason from y)
 select reason, count(*) as n from z group by 1""")
def skip_reason_counts(s, d):
    lines = t(s, d, "documents").select(F.explode(F.split("text", "\n")).alias("g"))
    return etl.reason_counts(lines.select(F.coalesce(etl.reject_reason(F.col("g"), 200), F.lit("ok")).alias("reason")), "reason")


@query("dedupe_union_base_first", """with x as (select p_name, p_brand, p_partkey, case when p_partkey % 2 = 0 then 0 else 1 end as origin from part)
 select p_name, p_brand, p_partkey, origin from (select *, row_number() over (partition by lower(p_name), lower(p_brand) order by origin, p_partkey) as n from x) where n = 1""")
def dedupe_union_base_first(s, d):
    part = t(s, d, "part").select("p_name", "p_brand", "p_partkey")
    return lookup.union_base_first(part.filter("p_partkey % 2 = 0"), part.filter("p_partkey % 2 <> 0"), ["p_name", "p_brand"], "p_partkey")


_PAIRS = "select u.conv_id, u.turn, u.text as user_text, a.text as assistant_text from conversations u join conversations a on a.conv_id = u.conv_id and a.turn = u.turn + 1 where u.role = 'user' and a.role = 'assistant'"


@query("dialogue_pairs", _PAIRS)
def dialogue_pairs(s, d):
    c = t(s, d, "conversations")
    user = c.filter("role = 'user'").select("conv_id", "turn", F.col("text").alias("user_text"))
    reply = c.filter("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("assistant_text"))
    return user.join(reply, ["conv_id", "turn"])


@query("unpivot_directions", f"""with p as ({_PAIRS}), x as (select *, case when len(list_filter(string_split_regex(user_text, '\\s+'), lambda x: x <> '')) = 1 and len(list_filter(string_split_regex(assistant_text, '\\s+'), lambda x: x <> '')) = 1 then 'lexical' else 'sentence' end as row_type from p)
 select conv_id, turn, row_type, 'user_text-to-assistant_text' as direction, user_text as input_text, assistant_text as reference_text from x
 union all select conv_id, turn, row_type, 'assistant_text-to-user_text', assistant_text, user_text from x""")
def unpivot_directions(s, d):
    pairs = dialogue_pairs(s, d).withColumn("case", F.struct("conv_id", "turn"))
    out = evals.unpivot_directions(pairs, "case", [("user_text", "assistant_text"), ("assistant_text", "user_text")])
    return out.select("case.conv_id", "case.turn", "row_type", "direction", "input_text", "reference_text")


_ET = r"regexp_extract_all(regexp_replace(lower(text),'[-‐‑‒–—=·•]','','g'),'[\p{L}\p{N}]+')"


@query("token_coverage", f"""with e as (select item_id, t, count(*) as ne from (select item_id, unnest({_ET}) as t from benchmark) group by 1, 2),
 a as (select doc_id, t, count(*) as na from (select doc_id, unnest({_ET}) as t from documents) group by 1, 2), s as (select item_id, sum(ne) as total from e group by 1),
 c as (select item_id, doc_id, sum(least(ne, na)) / max(total) as coverage from e join a using (t) join s using (item_id) group by 1, 2) select item_id, doc_id, coverage from c where coverage >= 0.9""")
def token_coverage(s, d):
    return evals.coverage(t(s, d, "benchmark"), t(s, d, "documents"), "item_id", "doc_id", 0.9)


@query("best_variant_coverage", f"""with v as (select doc_id, unnest(string_split(text, chr(10))) as text from documents), e as (select item_id, t, count(*) as ne from (select item_id, unnest({_ET}) as t from benchmark) group by 1, 2),
 l as (select row_number() over () as line, text from v), a as (select line, t, count(*) as na from (select line, unnest({_ET}) as t from l) group by 1, 2), s as (select item_id, sum(ne) as total from e group by 1),
 c as (select item_id, line, sum(least(ne, na)) / max(total) as x from e join a using (t) join s using (item_id) group by 1, 2) select item_id, max(x) as best from c group by 1""")
def best_variant_coverage(s, d):
    lines = t(s, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "text")).select(F.struct("doc_id", "pos").alias("line"), "text")
    return evals.best_coverage(t(s, d, "benchmark"), lines, "item_id", "line")


@query("reference_signature_match", f"""with s as (select doc_id, array_to_string({_ET}, chr(1)) as sig from documents) select md5(sig) as signature, min(doc_id) as first, count(*) as n from s where sig <> '' group by 1 having count(*) > 1""")
def reference_signature_match(s, d):
    sig = evals.signature(F.col("text"), "english")
    return t(s, d, "documents").select("doc_id", sig.alias("sig")).filter("sig <> ''").groupBy(F.md5(F.col("sig").cast("binary")).alias("signature")).agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")


@query("script_format_gate", r"""select doc_id, cast(len(regexp_extract_all(text,'[A-Za-z]')) as int) as latin, cast(len(regexp_extract_all(text,'[ა-ჿ]')) as int) as mkhedruli, cast(len(regexp_extract_all(text,'[Ѐ-ӿ]')) as int) as cyrillic,
 regexp_matches(text,'[A-Za-z]') and not regexp_matches(text,'[ა-ჿЀ-ӿ]') and len(list_filter(string_split_regex(trim(text, E' \n\t\r'),'\n+'), lambda x: x <> '')) <= 2 and not regexp_matches(text,'(?i)(?:^|\s)(?:translation|translated|output|answer|final)(?:\s|:|$)') as pass from documents""")
def script_format_gate(s, d):
    c = text.script_counts(F.col("text"))
    return t(s, d, "documents").select("doc_id", c["latin"].alias("latin"), c["mkhedruli"].alias("mkhedruli"), c["cyrillic"].alias("cyrillic"), text.script_gate(F.col("text"), "english").alias("pass"))


@query("composite_quality_score", """with x as (select doc_id, quality * 0.93 as q, 1 - toxic as script, case when doc_id % 3 = 0 then 1 else 0 end as ref, case when doc_id % 2 = 0 then 1 else 0 end as strict from labels),
 a as (select *, case when ref >= 1 then greatest(q, 0.95) else q end as s1 from x), b as (select *, case when strict >= 1 and ref < 1 then least(s1, 0.89) else s1 end as s2 from a),
 c as (select doc_id, script, cast(case when script < 1 then least(s2, 0.2) else s2 end as double) as score from b) select doc_id, score, script >= 1 and score >= 0.9 as pass from c""")
def composite_quality_score(s, d):
    strict, ref = F.when(F.col("doc_id") % 2 == 0, 1).otherwise(0), F.when(F.col("doc_id") % 3 == 0, 1).otherwise(0)
    return t(s, d, "labels").select("doc_id", evals.composite_score(F.col("quality") * 0.93, 1 - F.col("toxic"), ref, strict).alias("c")).select("doc_id", "c.*")


@query("direction_summary", """with dim(lang) as (values ('en'), ('de'), ('fr'), ('es'), ('xx')), x as (select lang, quality, toxic from labels join documents using (doc_id))
 select dim.lang, count(x.lang) as n, coalesce(avg(quality), 0) as mean, cast(coalesce(sum(quality), 0) as bigint) as passes, coalesce(avg(1 - toxic), 0) as script_rate from dim left join x using (lang) group by 1""")
def direction_summary(s, d):
    dim = s.createDataFrame([(x,) for x in ("en", "de", "fr", "es", "xx")], "lang string")
    rows = t(s, d, "labels").join(t(s, d, "documents").select("doc_id", "lang"), "doc_id")
    return evals.direction_summary(rows, dim, "lang", F.col("quality"), F.col("quality") == 1, {"script_rate": 1 - F.col("toxic")})


@query("paired_delta", """with b as (select user_id, event_type, max(value) as v from events where event_id % 2 = 0 group by 1, 2), c as (select user_id, event_type, max(value) as v from events where event_id % 2 = 1 group by 1, 2),
 d as (select c.v - b.v as d from b join c using (user_id, event_type)) select count(*) as shared, count(*) filter (d > 0.025) as improved, count(*) filter (d < -0.025) as worse, count(*) filter (d between -0.025 and 0.025) as tie, round(coalesce(avg(d), 0), 6) as mean_delta from d""")
def paired_delta(s, d):
    half = lambda r: t(s, d, "events").filter(F.col("event_id") % 2 == r).groupBy("user_id", "event_type").agg(F.max("value").alias("v"))
    return evals.paired_delta(half(0), half(1), ["user_id", "event_type"], "v")


@query("ablation_full_outer", """with a as (select event_type, user_id, count(*) as n from events where value > 40 group by 1, 2), b as (select event_type, user_id, count(*) as n from events where value <= 40 group by 1, 2)
 select event_type, user_id, a.n as n_on, b.n as n_off, a.n - b.n as delta from a full join b using (event_type, user_id)""")
def ablation_full_outer(s, d):
    side = lambda c, name: t(s, d, "events").filter(c).groupBy("event_type", "user_id").agg(F.count(F.lit(1)).alias(name))
    return evals.on_off(side("value > 40", "n"), side("value <= 40", "n"), ["event_type", "user_id"], "n")


@query("repeat_consistency", """with x as (select user_id, event_type, count(*) as n, count(distinct cast(value as bigint) % 2) as k from events group by 1, 2)
 select count(*) filter (n > 1 and k = 1) as consistent, count(*) filter (k > 1) as inconsistent, count(*) as cases from x""")
def repeat_consistency(s, d):
    runs = t(s, d, "events").select("user_id", "event_type", (F.bround("value").cast("long") % 2).alias("outcome"))
    return evals.consistency(runs, ["user_id", "event_type"], "outcome")


@query("named_metric_means", "select 'k' as metric, count(*) as n, avg(cast(json_extract(props,'$.k') as int)) as mean from events where json_extract(props,'$.k') is not null group by 1")
def named_metric_means(s, d):
    return evals.metric_means(t(s, d, "events").select(F.from_json("props", "map<string,string>").alias("scores")), "scores")


@query("prompt_size_stats", "select lang, min(n_chars) as least, cast(trunc(median(n_chars)) as bigint) as middle, max(n_chars) as most from documents group by 1")
def prompt_size_stats(s, d):
    return evals.size_stats(t(s, d, "documents"), "lang", "n_chars")


@query("pass_rate_rollup", "select lang, count(*) as n, cast(sum(quality) as bigint) as passed, round(avg(quality), 6) as rate from labels join documents using (doc_id) group by rollup(lang)")
def pass_rate_rollup(s, d):
    return evals.pass_rate(t(s, d, "labels").join(t(s, d, "documents").select("doc_id", "lang"), "doc_id"), "lang", F.col("quality") == 1)


@query("sampled_cases", "select p_name from (select distinct p_name from part) order by md5('20260412' || p_name) limit 100")
def sampled_cases(s, d):
    return evals.sampled(t(s, d, "part"), "p_name", 100, 20260412)


@query("accepted_answer_sets", "select lower(p_name) as prompt, array_to_string(list_sort(list(distinct p_brand)), '|') as accepted from part group by 1")
def accepted_answer_sets(s, d):
    return evals.accepted_answers(t(s, d, "part"), "p_name", "p_brand")


@query("path_metrics", """with x as (select event_id, case when event_type = 'error' then 'llm' else event_type end as source, cast(json_extract(props,'$.k') as int) as k from events)
 select event_id, case when source = 'llm' then case when k % 2 = 1 or k % 3 = 0 then 'llm_evidence_bundle' else 'llm_direct' end else source end as translation_path, source = 'llm' as used_llm, source = 'llm' and (k % 2 = 1 or k % 3 = 0) as used_evidence_bundle from x""")
def path_metrics(s, d):
    k = F.get_json_object("props", "$.k").cast("int")
    p = analytics.path(F.when(F.col("event_type") == "error", "llm").otherwise(F.col("event_type")), F.lit(False), k % 2 == 1, k % 3 == 0, F.lit(False))
    return t(s, d, "events").select("event_id", *[c.alias(name) for name, c in p.items()])


@query("response_source_case", """select event_id, case when event_type = 'view' then 'view' when k = 1 then 'exact_lexicon' when k = 2 then 'google_translate_direct' when event_type = 'click' then 'dictionary_google_bridge' when k > 50 then 'llm' else 'unknown' end as response_source from (select *, cast(json_extract(props,'$.k') as int) as k from events)""")
def response_source_case(s, d):
    k, e = F.get_json_object("props", "$.k").cast("int"), F.col("event_type")
    out = analytics.response_source(F.when(e == "view", e), F.when(k == 1, "exact_lexicon"), F.when(k == 2, "google_translate_direct"), F.when(e == "click", "Dictionary match (via Google Translate bridge): x"), F.when(k > 50, "x"))
    return t(s, d, "events").select("event_id", out.alias("response_source"))


@query("visitor_id_clean", "select page_id, case when regexp_full_match(trim(split_part(url,'/',3)), '[A-Za-z0-9][A-Za-z0-9._-]{0,127}') then trim(split_part(url,'/',3)) end as visitor from pages")
def visitor_id_clean(s, d):
    return t(s, d, "pages").select("page_id", text.clean_visitor_id(F.split_part("url", F.lit("/"), F.lit(3))).alias("visitor"))


_OPEN, _CLOSE = extract.OPEN, extract.CLOSE
_TRIM = "'`\"'' '"


def _clean(x: str) -> str:
    """SQL of the lines of x without markers, labels and quotes."""
    lines = f"list_transform(string_split_regex({x}, '\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x{{85}}\\x{{2028}}\\x{{2029}}]'), lambda l: {_stripped('l')})"
    real = f"list_filter({lines}, lambda l: l <> '{_OPEN}' and l <> '{_CLOSE}' and not regexp_matches(l, '(?i)^{extract.PLACEHOLDER}[:\\-\\s]*$'))"
    bare = f"list_transform({real}, lambda l: trim(regexp_replace(l, '(?i)^(final\\s+)?translation\\s*:\\s*', ''), {_TRIM}))"
    return _stripped(f"array_to_string(list_filter({bare}, lambda l: l <> ''), chr(10))")


def _extract_sql() -> str:
    wrapped = f"case turn % 3 when 0 then 'Notes: x' || chr(10) || '{_OPEN}' || chr(10) || coalesce(text, '') || chr(10) || '{_CLOSE} y' when 1 then 'z {_OPEN} ' || coalesce(text, '') else 'Based on a' || chr(10) || 'Final translation: ' || coalesce(text, '') end"
    talk = r"(?i)^\s*(?:[-*]\s+|\d+[.)]\s+|notes?\s*:|based\s+on\b|to\s+translate\b|therefore\b|combining\b|putting\s+it\s+together\b|sentence\s+structure\b|grammar(?:atical)?\b|according\s+to\b)"
    bare = r"trim(regexp_replace(l, '^\s*(?:[-*]\s+|\d+[.)]\s+)', ''), " + _TRIM + ")"
    return f"""with w as (select conv_id, turn, {wrapped} as r from conversations),
 p as (select conv_id, turn, r, {_clean(f"regexp_extract(r, '(?s){_OPEN}\\s*(.*?)\\s*{_CLOSE}', 1)")} as one, {_clean(f"regexp_extract(r, '(?s){_OPEN}\\s*(.*)$', 1)")} as two,
 {_clean("coalesce(list_last(regexp_extract_all(r, '(?im)^(?:final\\s+translation|translation)\\s*:\\s*(.+)$', 1)), '')")} as three,
 list_filter(list_transform(list_filter(string_split(r, chr(10)), lambda l: {_stripped('l')} <> '' and not contains(l, '{_OPEN}') and not contains(l, '{_CLOSE}') and not contains(l, '{extract.PLACEHOLDER}')), lambda l: regexp_replace({bare}, '(?i)^(final\\s+)?translation\\s*:\\s*', '')), lambda l: trim(l) <> '' and not regexp_matches(l, '{talk}') and not contains(l, '**') and not contains(l, '->')) as lines from w)
 select conv_id, turn, coalesce(nullif(one, ''), nullif(two, ''), nullif(three, ''), list_last(list_filter(lines, lambda l: length(l) <= 180 and not regexp_matches(l, '[Ⴀ-ჿ]'))), {_stripped('r')}) as extracted from p"""


@query("extract_translation", _extract_sql())
def extract_translation(s, d):
    """Every row of conversations, wrapped in three ways as a model might."""
    c = t(s, d, "conversations").withColumn("text", F.coalesce("text", F.lit("")))
    wrapped = F.when(F.col("turn") % 3 == 0, F.concat(F.lit("Notes: x\n<<<TRANSLATION>>>\n"), "text", F.lit("\n<<<END_TRANSLATION>>> y"))).when(F.col("turn") % 3 == 1, F.concat(F.lit("z <<<TRANSLATION>>> "), "text")).otherwise(F.concat(F.lit("Based on a\nFinal translation: "), "text"))
    return c.select("conv_id", "turn", extract.extract_translation(wrapped, "english").alias("extracted"))


@query("prompt_section_lengths", r"""select conv_id, turn, cast(length(trim(text, E' \n\t\r')) as int) as section, cast(case when trim(text, E' \n\t\r') <> '' then length(role) else 0 end as int) as tail from conversations""")
def prompt_section_lengths(s, d):
    none = F.lit(None).cast("string")
    m = prompts.measure(prompts.build(F.lit("hello"), F.lit("english"), F.lit("mingrelian"), none, F.col("text"), F.col("role")))
    return t(s, d, "conversations").select("conv_id", "turn", m["dict_entries_chars"].alias("section"), m["grammar_chars"].alias("tail"))


def _gloss(x: str) -> str:
    edge = "E' ;,\\n\\t'"
    inner = f"trim(regexp_replace({x}, '[\\s\\x0b\\x{{85}}\\p{{Z}}]+', ' ', 'g'), {edge})"
    return f"trim(regexp_replace(regexp_replace({inner}, '^\\p{{Nd}}+\\.\\s*', ''), '\\s+\\p{{Nd}}+\\.$', ''), {edge})"


@query("figurative_split", f"""with x as (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as g from documents), y as (select doc_id, g, strpos(lower(g), ' the ') as p from x)
 select doc_id, case when p > 0 then {_gloss("left(g, p - 1)")} else {_gloss("g")} end as primary, case when p > 0 then nullif({_gloss("substr(g, p + 5)")}, '') end as secondary from y""")
def figurative_split(s, d):
    """Every line of documents; a word stands in for a marker."""
    x = t(s, d, "documents").select("doc_id", F.explode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("g"))
    return x.select("doc_id", text.figurative_split(F.col("g"), [" the "]).alias("f")).select("doc_id", "f.*")


@query("bridge_lookup", """with m(src, word) as (values ('cheap', 'economy'), ('little', 'small'), ('none', 'nothing')) select src as request, min(p_partkey) as target from m join part on lower(p_type) = word group by 1""")
def bridge_lookup(s, d):
    """Requests are translated first, and what that gives is looked up."""
    asked = s.createDataFrame([(" Cheap", "x", "y"), ("little", "x", "y"), ("none", "x", "y"), ("unknown", "x", "y")], "input_text string, source string, target string")
    memory = s.createDataFrame([("x", "y", "cheap", "Economy"), ("x", "y", "Little ", "small"), ("x", "y", "none", "nothing"), ("x", "z", "little", "large")], "source string, target string, source_text string, target_text string")
    bridged = clients.machine_translate(asked, memory).select(text.normalize(F.col("input_text")).alias("request"), F.col("mt_text").alias("word"))
    return lookup.first_match(lookup.exact(bridged, "word", t(s, d, "part"), "p_type"), ["request"], ["p_partkey"]).select("request", F.col("p_partkey").alias("target"))


@query("translate_requests", """with r as (select distinct p_name as request_id, 'mingrelian' as target from part union select distinct p_type, 'mingrelian' from part union select distinct p_brand, 'georgian' from part),
 c as (select lower(p_name) as k, count(distinct lower(p_brand)) as n, min(p_brand) as sole from part group by 1), b as (select lower(p_type) as k, min(p_brand) as t from part where p_size > 45 group by 1),
 x as (select request_id, coalesce(n, 0) as n, sole, t, case when n = 1 then 'exact_lexicon' when n is null and t is not null then 'dictionary_google_bridge' when target = 'georgian' then 'google_translate_direct' else 'llm' end as response_source
 from r left join c on target = 'mingrelian' and c.k = lower(request_id) left join b on target = 'mingrelian' and b.k = lower(request_id))
 select request_id, response_source, n as exact_candidate_count, case response_source when 'exact_lexicon' then sole when 'dictionary_google_bridge' then t when 'google_translate_direct' then 'mt ' || request_id else request_id end as translation,
 response_source = 'llm' as used_llm, response_source = 'llm' and n = 0 as has_dictionary_entries from x""")
def translate_requests(s, d):
    part = t(s, d, "part")
    ask = lambda c, target: part.select(F.col(c).alias("request_id"), F.col(c).alias("input_text"), F.lit("english").alias("source"), F.lit(target).alias("target")).distinct()
    requests = ask("p_name", "mingrelian").union(ask("p_type", "mingrelian")).union(ask("p_brand", "georgian"))
    pair = lambda x, a, b, target: x.select(F.lit("english").alias("source"), F.lit(target).alias("target"), F.col(a).alias("source_text"), b.alias("target_text"))
    lexicon = part.select(F.col("p_partkey").alias("row_id"), F.lit("english").alias("source"), F.lit("mingrelian").alias("target"), F.col("p_name").alias("source_text"), F.col("p_brand").alias("target_text"), F.lit("part").alias("source_name"))
    bridge = pair(part.filter("p_size > 45"), "p_type", F.col("p_brand"), "mingrelian")
    memory = pair(part, "p_brand", F.concat(F.lit("mt "), "p_brand"), "georgian")
    entry = lambda words: words.select("word", F.concat(F.lit("\n"), "word", F.lit(": an entry\n")).alias("output"))
    out = translate.translate(requests, lexicon, bridge, memory, entry, "Endings follow stems.")
    return out.select("request_id", "response_source", "exact_candidate_count", "translation", "used_llm", "has_dictionary_entries")


@query("csv_sink", "select doc_id, text, lang from documents")
def csv_sink(s, d):
    path = scratch_path(s, "csv")
    sinks.csv(t(s, d, "documents"), path, ["doc_id", "text", "lang"])
    return s.read.schema("doc_id long, text string, lang string").option("header", True).option("escape", '"').option("multiLine", True).option("emptyValue", "").csv(path)


@query("json_sink", "select event_type, count(*) as n, min(value) as least from events group by 1")
def json_sink(s, d):
    path = scratch_path(s, "json")
    sinks.json(t(s, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("least")), path, single=True)
    return s.read.schema("event_type string, n long, least double").json(path)


@query("event_insert", """select strftime(ts, '%Y-%m-%d') as day, count(*) as n from events where event_type in ('error', 'click') group by 1""")
def event_insert(s, d):
    path, status = scratch_path(s, "events"), F.when(F.col("event_type") == "click", "success").otherwise(F.col("event_type"))
    sinks.insert_events(t(s, d, "events").select("event_id", F.col("ts").alias("created_at"), status.alias("status")), path)
    return s.read.parquet(path).groupBy(F.date_format("day", "yyyy-MM-dd").alias("day")).agg(F.count(F.lit(1)).alias("n"))


@query("event_stream_append", "select strftime(ts, '%Y-%m-%d') as day, count(*) as n from events group by 1")
def event_stream_append(s, d):
    at = scratch_path(s, "stream")
    return append_events(s, f"{d}/events.parquet*", t(s, d, "events").schema, f"{at}/log", f"{at}/checkpoint").groupBy(F.date_format("day", "yyyy-MM-dd").alias("day")).agg(F.count(F.lit(1)).alias("n"))


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which benchmark items stand whole in which documents."""
    return substring_search(spark, sf_dir)
