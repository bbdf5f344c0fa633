"""Queries of the readers and of the search over several dictionaries, on stand-in tables, each beside its SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossweave.functions import text
from glossweave.operators import evals, search
from glossweave.plans import translate
from glossweave.plans.queries import _EDGE, TOK, _pattern, n, query, t
from glossweave.sources import readers
from glossweave.sources.shared import scratch_path

PART = "row_number() over (order by p_partkey)"


def _file(s: SparkSession, rows: DataFrame, order: str, head: list[str]) -> str:
    """A folder of text files, by range, with the lines (line) of rows in order, after the lines of head."""
    first = s.createDataFrame([(float(i - len(head) - 1e9), x) for i, x in enumerate(head)], "o double, line string")
    path = scratch_path(s, "lines")
    first.unionByName(rows.select(F.col(order).cast("double").alias("o"), "line")).repartitionByRange("o").sortWithinPartitions("o").select("line").write.text(path)
    return path


def _tabs(*columns) -> object:
    return F.concat_ws("\t", *columns).alias("line")


@query("scan_sentence_pairs", f"select {PART} + 2 as row_id, p_name as mingrelian, p_type as english from part")
def scan_sentence_pairs(s, d):
    """A header, with a byte-order mark and again later, a row with one cell and one without a text."""
    part = t(s, d, "part").select("p_partkey", _tabs(F.concat(F.lit(" "), "p_name"), "p_type", F.lit("more")))
    path = _file(s, part, "p_partkey", ["﻿Mingrelian\tEnglish ", "one cell", "mingrelian\tenglish"])
    more = scratch_path(s, "lines")
    s.createDataFrame([("x\t \n\ty",)], "line string").write.text(more)
    both = readers.sentence_pairs(s, path).unionByName(readers.sentence_pairs(s, more)).unionByName(readers.sentence_pairs(s, f"{path}-missing"))
    return both.select("row_id", "mingrelian", "english")


@query("scan_russian_dictionary", f"select {PART} + 1 as row_id, p_type as russian, p_name as mingrelian from part union all select cast(count(*) + 2 as bigint), 'Russian', 'Mingrelian' from part")
def scan_russian_dictionary(s, d):
    """The header is the first row with enough cells; a later one is an entry."""
    part = t(s, d, "part").select("p_partkey", _tabs("p_type", "p_name"))
    part = part.unionByName(s.createDataFrame([(10**9, "Russian\tMingrelian")], "p_partkey long, line string"))
    return readers.russian_dictionary(s, _file(s, part, "p_partkey", ["a line without a tab", "Russian\tMingrelian"])).select("row_id", "russian", "mingrelian")


@query("scan_four_columns", f"select {PART} as row_id, p_name as mingrelian, case when p_size > 10 then p_brand else '' end as ipa, p_type as russian, p_brand as georgian from part")
def scan_four_columns(s, d):
    part = t(s, d, "part").select("p_partkey", _tabs("p_name", F.when(F.col("p_size") > 10, F.col("p_brand")).otherwise(""), "p_type", "p_brand"))
    return readers.four_column_dictionary(s, _file(s, part, "p_partkey", ["Word\tIPA\tRussian_def\tGeorgian_def"])).select("row_id", "mingrelian", "ipa", "russian", "georgian")


@query("scan_overrides", f"select {PART} as row_id, 'english' as source_language, 'georgian' as target_language, p_name as source_text, p_type as target_text from part qualify true")
def scan_overrides(s, d):
    part = t(s, d, "part").select("p_partkey", _tabs(F.lit("english"), F.lit("georgian"), "p_name", "p_type"))
    return readers.overrides(s, _file(s, part, "p_partkey", ["source_language\ttarget_language\tsource_text\ttarget_text"])).drop("part")


@query("scan_lexicon", f"select {PART} - 1 as row_id, case when p_size > 5 then p_name else '' end as headword, p_brand || ' \"x\", y' as headword_raw, p_type as translation from part")
def scan_lexicon(s, d):
    cells = t(s, d, "part").select("p_partkey", F.when(F.col("p_size") > 5, F.concat(F.lit("  "), "p_name")).otherwise("").alias("headword"), F.concat("p_brand", F.lit(' "x",  y')).alias("headword_raw"), F.col("p_type").alias("translation"))
    path = scratch_path(s, "lexicon")
    cells.repartitionByRange("p_partkey").sortWithinPartitions("p_partkey").select("translation", "headword", "headword_raw").write.option("header", True).option("escape", '"').option("emptyValue", "").csv(path)
    return readers.master_lexicon(s, path).unionByName(readers.master_lexicon(s, path, enabled=False))


@query("scan_eval_cases", f"select {PART} - 1 as row_id, p_brand as case_id, p_name as input_text, 'a' || chr(10) || p_type as notes, cast(null as varchar) as direction from part")
def scan_eval_cases(s, d):
    cells = t(s, d, "part").select("p_partkey", F.concat(F.lit("a\n"), "p_type").alias("notes"), F.col("p_name").alias("input_text"), F.col("p_brand").alias("case_id"))
    path = scratch_path(s, "cases")
    cells.repartitionByRange("p_partkey").sortWithinPartitions("p_partkey").drop("p_partkey").write.option("header", True).option("escape", '"').csv(path)
    return readers.eval_cases(s, path).select("row_id", "case_id", "input_text", "notes", "direction")


@query("scan_context", f"select {PART} - 1 as row_id, p_name || chr(10) || p_type as entry from part")
def scan_context(s, d):
    part = t(s, d, "part").select("p_partkey", F.concat("p_name", F.lit("\n"), "p_type", F.lit("\n \n")).alias("line"))
    path = _file(s, part, "p_partkey", ["", " "])
    return readers.context_entries(s, path)


@query("scan_jsonl", "select event_type as word, cast(json_extract(props, '$.k') as varchar) as gloss, count(*) as n from events group by 1, 2 union all select null, null, 2")
def scan_jsonl(s, d):
    """Entries with nested senses, two lines that are no JSON, and blank ones."""
    entry = F.to_json(F.struct(F.col("event_type").alias("word"), F.array(F.struct(F.array(F.get_json_object("props", "$.k")).alias("glosses"))).alias("senses")))
    path = _file(s, t(s, d, "events").select("event_id", entry.alias("line")), "event_id", ["{no json", "", "  ", "[1"])
    return readers.kaikki(s, path).groupBy("word", F.col("senses")[0]["glosses"][0].alias("gloss")).agg(F.count(F.lit(1)).alias("n"))


@query("scan_results", """with x as (select * from labels join documents using (doc_id)) select lang as label, metric, count(*) as n, avg(v) as mean from (
 select lang, 'score' as metric, quality / 2.0 as v from x union all select lang, 'clean', case when toxic = 0 then 1.0 else 0.0 end from x where doc_id % 2 = 0 union all select lang, 'size', n_chars + 0.5 from x where doc_id % 3 = 0) group by 1, 2""")
def scan_results(s, d):
    """Documents of results whose rows differ in their fields and in the types of these: numbers, truth values, text and nulls."""
    rows = t(s, d, "labels").join(t(s, d, "documents").select("doc_id", "lang", "n_chars"), "doc_id")
    more = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit(', "size": '), F.col("n_chars") + 0.5, F.lit(', "note": {"a": 1}'))).otherwise(', "size": null, "score2": "0.7"')
    clean = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit(', "clean": '), (F.col("toxic") == 0).cast("string"))).otherwise(', "clean": "true"')
    row = F.concat(F.lit('{"provider": {"label": "'), "lang", F.lit('"}, "namedScores": {"score": '), F.col("quality") / 2, more, clean, F.lit("}}"))
    # a document of a hundred rows or so each
    path = scratch_path(s, "results")
    rows.select(F.floor(F.col("doc_id") / 100).alias("file"), row.alias("r")).groupBy("file").agg(F.array_join(F.collect_list("r"), ",").alias("r")).select(F.concat(F.lit('{"results": {"results": ['), "r", F.lit("]}}")).alias("line")).repartitionByRange(8, "line").write.option("maxRecordsPerFile", 1).text(path)
    found = readers.result_rows(s, path).select(F.variant_get("row", "$.provider.label", "string").alias("label"), F.variant_get("row", "$.namedScores", "variant").alias("scores"))
    return evals.variant_metric_means(found, "scores", ["label"])


# --- search over several dictionaries

_WORDS = ["ring", "small ring", "idget", "Supplier#000000001", "NATION_1", "that", "far 3", "PROMO", "zzz", "rings", "rewidget", "resort", "re", "tion", "place"]
_RU = {"ring": "NATION_1", "that": "SMALL", "zzz": "Supplier#000000002"}
_KA = {"idget": "place", "zzz": "tion", "re": "place"}
_CASES = {"rings": ["ringy", "ring"], "rewidgets": ["rewidgety", "rewidget"]}
_MORE = ["rewidgets", "zzzs"]


def _stems(w):
    """Stand-ins for case endings and preverbs: a final s, and re before a word."""
    return text.suffix_strip(w, ["s"], plurals=[], vowels="aeiou", nominative="y")


def _sources(s, d) -> list[search.Source]:
    part, supplier, nation = t(s, d, "part"), t(s, d, "supplier"), t(s, d, "nation")
    pairs = part.select(F.col("p_partkey").alias("row_id"), F.col("p_name").alias("mingrelian"), F.col("p_type").alias("english"))
    gal = supplier.select(F.col("s_suppkey").alias("row_id"), F.col("s_name").alias("russian"), F.concat(F.lit("nation "), "s_nationkey").alias("mingrelian"))
    kk = nation.select(
        F.col("n_nationkey").cast("long").alias("row_id"), F.col("n_name").alias("mingrelian"), F.concat(F.lit("r"), "n_regionkey").alias("ipa"),
        F.concat("n_name", F.lit(" land; перен. far "), "n_nationkey").alias("russian"), F.concat(F.lit("place "), "n_regionkey").alias("georgian"),
    )
    notes = t(s, d, "benchmark").select(F.col("item_id").alias("row_id"), F.col("text").alias("entry"))
    return [search.sentence_pairs(pairs), search.russian_dictionary(gal), search.four_column_dictionary(kk), search.context(notes)]


_ROWS = {
    "pairs": ("select p_partkey as row_id, p_name as a, p_type as b from part", ["a", "b"], ["a", "b"], "a || chr(9) || b", "'Mingrelian: ' || a || chr(10) || 'English: ' || b || chr(10)", True),
    "gal": ("select s_suppkey as row_id, s_name as a, 'nation ' || s_nationkey as b from supplier", ["b", "a"], ["a", "b"], "a || chr(9) || b", "'Mingrelian: ' || b || chr(10) || 'Russian: ' || a || chr(10)", True),
    "kk": ("select n_nationkey as row_id, n_name as a, 'r' || n_regionkey as i, n_name || ' land; перен. far ' || n_nationkey as b, 'place ' || n_regionkey as c from nation", ["a", "b", "c"], ["a", "i", "b", "c"], "concat_ws(chr(9), a, i, b, c)",
           "'Mingrelian: ' || a || chr(10) || 'Russian primary meaning: ' || a || ' land' || chr(10) || 'Russian secondary figurative meaning: far ' || row_id || chr(10) || 'Georgian primary meaning: ' || c || chr(10)", True),
    "notes": ("select item_id as row_id, text as a from benchmark", ["a"], ["a"], "a", "trim(a) || chr(10)", False),
}
_SEP = "'========' || chr(10)"


def _quoted(x: str | None) -> str:
    return "null" if x is None else "'" + x.replace("'", "''") + "'"


def _search_sql(words: list[str]) -> str:
    """Tables pairs, gal, kk and notes (word, out, alone) of what each source shows for words, as the start of a WITH. Each word's
    patterns are constants: the engine compiles them once."""
    words = list(dict.fromkeys(words))
    parts = [f"words(word) as (values {', '.join(f'({_quoted(w)})' for w in words)})"]
    for name, (rows, texts, index, whole, entry, indexed) in _ROWS.items():
        hits = []
        for w in words:
            alone = " or ".join(f"regexp_matches({c}, {_quoted(f'(?i){_EDGE}{_pattern(w)}($|[^\\p{{L}}\\p{{N}}_])')})" for c in texts)
            hits.append(f"select {_quoted(w)} as word, row_id, {alone} as alone, contains({whole}, {_quoted(w)}) or regexp_matches({whole}, {_quoted(f'(?i){_pattern(w)}')}) as sub from {name}_r")
        terms = " union ".join(f"select row_id, {n(c)} as term from {name}_r union select row_id, lower(unnest(regexp_extract_all({c}, '{TOK}'))) from {name}_r" for c in index)
        parts += [
            f"{name}_r as ({rows})",
            f"{name}_h as materialized ({' union all '.join(hits)})",
            f"{name}_k as materialized (select distinct word, row_id from words join ({terms}) on term = {n('word')} where {'true' if indexed else 'false'})",
            f"{name}_a as materialized (select word, row_id from {name}_h where alone and word not in (select word from {name}_k) union all select word, row_id from {name}_h join {name}_k using (word, row_id) where alone)",
            f"{name}_s as (select word, row_id from {name}_h where sub and word not in (select word from {name}_a))",
            f"{name} as materialized (select word, left({_SEP} || string_agg({entry} || {_SEP}, '' order by row_id), 10000) as out, bool_or(tier) as alone from (select *, true as tier from {name}_a union all select *, false from {name}_s) join {name}_r using (row_id) group by 1)",
        ]
    return ",\n ".join(parts)


def _final(requests: list[tuple], columns: list[str], legs: list[tuple[str, str]], late: str) -> str:
    rows = ", ".join("(" + ", ".join(map(_quoted, r)) + ")" for r in requests)
    outs, alone = " || ".join(f"o{i}" for i in range(len(legs))), " or ".join(f"a{i}" for i in range(len(legs)))
    select = ", ".join(f"coalesce((select out from {s} x where x.word = r.{c}), '') as o{i}, coalesce((select alone from {s} x where x.word = r.{c}), false) as a{i}" for i, (s, c) in enumerate(legs))
    return f"""r({", ".join(columns)}) as (values {rows}), p as (select r.*, {select} from r), shown as (select word, {outs} || case when {alone} then '' else coalesce((select out from notes x where x.word = p.{late}), '') end as body from p)"""


@query("source_search", f"with {_search_sql(_WORDS)} select word, out as output, alone as has_standalone, name from (select *, 'pairs' as name from pairs union all select *, 'gal' from gal union all select *, 'kk' from kk union all select *, 'context' from notes)")
def source_search(s, d):
    words = s.createDataFrame([(w,) for w in _WORDS], "word string")
    return reduce(DataFrame.unionByName, [x.search(words).withColumn("name", F.lit(x.name)) for x in _sources(s, d)])


_EN = [(w, _RU.get(w, w), _KA.get(w, w)) for w in _WORDS]


@query("search_from_english", f"""with {_search_sql([x for r in _EN for x in r])}, {_final(_EN, ["word", "ru", "ka"], [("pairs", "word"), ("gal", "ru"), ("kk", "ru"), ("kk", "ka")], "ka")}
 select word, left(chr(10) || 'Results for ' || word || ':' || chr(10) || body, 10000) as output from shown""")
def search_from_english(s, d):
    asked = s.createDataFrame([(w, _RU.get(w), _KA.get(w)) for w in _WORDS], "word string, russian string, georgian string")
    return search.from_english(asked, *_sources(s, d))


@query("search_from_georgian", f"""with {_search_sql([x for r in _EN for x in r])}, {_final(_EN, ["word", "en", "ru"], [("pairs", "en"), ("kk", "word"), ("gal", "ru")], "word")}
 select word, left(chr(10) || 'Results for ' || word || ':' || chr(10) || body, 10000) as output from shown""")
def search_from_georgian(s, d):
    asked = s.createDataFrame([(w, _RU.get(w), _KA.get(w)) for w in _WORDS], "word string, english string, russian string")
    return search.from_georgian(asked, *_sources(s, d))


def _mingrelian_sql() -> str:
    words = [(w,) for w in _WORDS + _MORE]
    cases = [(w, str(i), x) for w in _WORDS + _MORE if w.endswith("s") and len(w) > 3 for i, x in enumerate([w[:-1] + "y", w[:-1]] if w[-2] not in "aeiou" else [w[:-1]])]
    verbs = [(w, "0", w[2:]) for w in _WORDS + _MORE if w.startswith("re") and len(w) > 4]
    values = lambda x: ", ".join("(" + ", ".join(map(_quoted, r)) + ")" for r in x)
    legs = ["pairs", "gal", "kk", "notes"]
    outs = ", ".join(f"coalesce((select out from {s} x where x.word = stem), '') as {s}_o, coalesce((select alone from {s} x where x.word = stem), false) as {s}_a" for s in legs)
    anyone = " or ".join(f"{s}_a" for s in legs)
    shown = " || ".join(f"case when not ({anyone}) or {s}_a then {s}_o else '' end" for s in legs)

    def tried(name: str, table: str, kind: str, lost: str) -> str:
        return f"""{name} as (select word, arg_min(more, i) as more from (select word, i, chr(10) || '[{kind}-stripped fallback: ' || word || ' → ' || stem || ']' || chr(10) || body as more from
 (select word, i, stem, {shown} as body from (select *, {outs} from {table} where word in ({lost}))) where body <> '') group by 1)"""

    lost = "select word from shown where body = ''"
    every = [x for r in words for x in r] + [x[2] for x in cases + verbs]
    return f"""with {_search_sql(every)}, {_final(words, ["word"], [("pairs", "word"), ("gal", "word"), ("kk", "word")], "word")}, cases(word, i, stem) as (values {values(cases)}), verbs(word, i, stem) as (values {values(verbs)}),
 {tried("by_case", "cases", "Case", lost)}, {tried("by_verb", "verbs", "Preverb", lost + " and word not in (select word from by_case)")}
 select shown.word, left(chr(10) || 'Results for ' || shown.word || ':' || chr(10) || body || coalesce(by_case.more, by_verb.more, ''), 10000) as output from shown left join by_case using (word) left join by_verb using (word)"""


@query("search_from_mingrelian", _mingrelian_sql())
def search_from_mingrelian(s, d):
    words = s.createDataFrame([(w,) for w in _WORDS + _MORE], "word string")
    return search.from_mingrelian(words, *_sources(s, d), case_stems=_stems, verb_stem=lambda w: text.preverb_strip(w, ["re"]))


@query("bridge_gloss", "select n_nationkey as id, case when n_nationkey % 3 = 0 then '' else n_name || ' land' end as english_gloss, case when n_nationkey % 3 = 0 then 'ka' else 'ru' end as english_from, 'place ' || n_regionkey as georgian_gloss from nation")
def bridge_gloss(s, d):
    nation = t(s, d, "nation").withColumn("ru", F.when(F.col("n_nationkey") % 3 == 0, "перен. x").otherwise(F.concat("n_name", F.lit(" land; перен. far")))).withColumn("ka", F.concat(F.lit("1. place "), "n_regionkey"))
    english, georgian = text.bridge_gloss(F.col("ru"), F.col("ka"), "english"), text.bridge_gloss(F.col("ru"), F.col("ka"), "georgian")
    return nation.select(F.col("n_nationkey").alias("id"), F.when(english["language"] == "ru", english["gloss"]).otherwise("").alias("english_gloss"), english["language"].alias("english_from"), georgian["gloss"].alias("georgian_gloss"))


@query("token_candidates", f"""with r as (select distinct p_name as request_id from part), w as (select request_id, unnest(generate_series(0, len(string_split(request_id, ' ')) - 1)) as pos, unnest(string_split(request_id, ' ')) as token from r),
 x as (select distinct token, case k when 0 then token else left(token, length(token) - 1) end as variant, k from w, (values (0), (1)) v(k) where k = 0 or (token like '%s' and length(token) > 3 and token not like '%ss')),
 l as (select {n('regexp_extract(p_name, \'[a-z]+$\')')} as term, lower(p_brand) as target, p_partkey from part), c as (select token, target, min(k * 1000000 + p_partkey) as o from x join l on term = variant group by 1, 2),
 f as (select token, target, row_number() over (partition by token order by o) as rank, count(*) over (partition by token) as n from c)
 select request_id, pos, token, target, rank, n from w join f using (token) where rank <= 6""")
def token_candidates(s, d):
    """The shortlist of each token of each name: its last words stand for a lexicon of words."""
    part = t(s, d, "part")
    lexicon = part.select(F.col("p_partkey").alias("row_id"), F.lit("english").alias("source"), F.lit("mingrelian").alias("target"), F.regexp_extract("p_name", "[a-z]+$", 0).alias("source_text"), F.col("p_brand").alias("target_text"), F.lit("part").alias("source_name"))
    asked = part.select(F.col("p_name").alias("request_id"), F.col("p_name").alias("input_text")).distinct()
    words = translate.request_tokens(asked).select("request_id", "pos", "token")
    found = translate.token_candidates(words.select("token").distinct(), lexicon, "english")
    each = found.select("token", "n", F.posexplode("candidates").alias("rank", "c"))
    return words.join(each, "token").select("request_id", F.col("pos").cast("long").alias("pos"), "token", text.normalize(F.col("c.target_text")).alias("target"), (F.col("rank") + 1).cast("long").alias("rank"), "n")


@query("sentence_evidence", f"""with r as (select distinct 'the ' || p_name as request_id from part), w as (select request_id, unnest(generate_series(0, len(string_split(request_id, ' ')) - 1)) as pos, unnest(string_split(request_id, ' ')) as token from r),
 x as (select distinct token, case k when 0 then token else left(token, length(token) - 1) end as variant, k from w, (values (0), (1)) v(k) where k = 0 or (token like '%s' and length(token) > 3 and token not like '%ss')),
 l as (select {n('regexp_extract(p_name, \'[a-z]+$\')')} as term, p_brand as target, p_partkey from part), c as (select token, target, min(k * 1000000 + p_partkey) as o from x join l on term = variant group by 1, 2),
 f as (select token, target, row_number() over (partition by token order by o) as rank from c),
 b as (select token, 'Candidates for the word "' || token || '" (English → Mingrelian); they are for this word, not for the sentence:' || chr(10) || chr(10) ||
 string_agg('Candidate ' || rank || ':' || chr(10) || '- Mingrelian: ' || target || chr(10) || '- Source: part', chr(10) || chr(10) order by rank) as block from f where rank <= 6 group by 1),
 e as (select request_id, pos, coalesce(block, token || ': an entry') as block from w left join b using (token) where block is not null or token <> 'the')
 select request_id, string_agg(block, chr(10) order by pos) as entries from e group by 1""")
def sentence_evidence(s, d):
    """What a prompt holds of each name: shortlists of its last word, an entry of the others, nothing of the article."""
    part = t(s, d, "part")
    lexicon = part.select(F.col("p_partkey").alias("row_id"), F.lit("english").alias("source"), F.lit("mingrelian").alias("target"), F.regexp_extract("p_name", "[a-z]+$", 0).alias("source_text"), F.col("p_brand").alias("target_text"), F.lit("part").alias("source_name"))
    name = F.concat(F.lit("the "), "p_name")
    asked = part.select(name.alias("request_id"), name.alias("input_text")).distinct()
    entry = lambda words: words.select("word", F.concat(F.lit("\n"), "word", F.lit(": an entry\n")).alias("output"))
    return translate.sentence_evidence(asked, lexicon, "english", entry)
