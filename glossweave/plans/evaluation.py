"""Queries of requests, events, evaluation and import over the stand-in tables, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from glossweave.functions import prompts, text
from glossweave.operators import analytics, etl, evals, requests
from glossweave.plans.queries import n, query, t

_K = "cast(json_extract(props, '$.k') as int)"


def _k(s, d):
    """events with k, the number in props."""
    return t(s, d, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))


@query("event_projection", f"""with x as (select *, {_K} as k, case event_type when 'error' then 'llm' when 'view' then 'unknown' else event_type end as src from events),
 y as (select *, src = 'llm' or k % 7 = 0 as llm, k % 2 = 1 as dict, k % 3 = 0 or k % 5 = 0 as gram from x)
 select event_id, 'success' as status, event_type as source_text, case when k % 5 > 0 then event_type || 'x' end as target_text, src as response_source, llm as used_llm, llm and (dict or gram) as used_evidence_bundle,
 case when src = 'llm' then case when dict or gram then 'llm_evidence_bundle' else 'llm_direct' end else src end as translation_path, gram as used_grammar, case when k % 2 = 0 and k > 0 then k else k + 1 end as prompt_characters,
 case when k % 4 > 0 then k end as exact_candidate_count, cast(length(event_type) as int) as source_text_length, case when k % 5 > 0 then cast(length(event_type) + 1 as int) end as target_text_length, case when k % 6 > 0 then 'u-' || user_id end as visitor_id from y""")
def event_projection(s, d):
    e, yes = _k(s, d), lambda c: F.when(c, "Yes").otherwise("no")
    k = F.col("k")
    metrics = F.map_from_arrays(
        F.array(*map(F.lit, ["used_llm", "has_dictionary_entries", "used_grammar", "grammar_included", "prompt_characters", "prompt_chars", "exact_candidate_count"])),
        F.array(yes(k % 7 == 0), yes(k % 2 == 1), F.when(k % 3 == 0, "1").otherwise(""), F.when(k % 5 == 0, " TRUE").otherwise("0"), F.when(k % 2 == 0, k.cast("string")), (k + 1).cast("string"), F.when(k % 4 > 0, k.cast("string")).otherwise("many")),
    )
    rows = e.select(
        "event_id", F.col("event_type").alias("source_text"), F.when(k % 5 > 0, F.concat("event_type", F.lit("x"))).otherwise("").alias("target_text"), F.lit("english").alias("source_language"), F.lit("georgian").alias("target_language"),
        F.when(F.col("event_type") == "error", "llm").when(F.col("event_type") == "view", "").otherwise(F.col("event_type")).alias("response_source"), metrics.alias("prompt_metrics"), F.col("event_id").cast("string").alias("user_agent"),
        F.concat(F.when(k % 6 > 0, " u-").otherwise("u "), F.col("user_id")).alias("visitor_id"),
    )
    names = ["status", "source_text", "target_text", "response_source", "used_llm", "used_evidence_bundle", "translation_path", "used_grammar", "prompt_characters", "exact_candidate_count", "source_text_length", "target_text_length", "visitor_id"]
    return analytics.event(rows).select(F.col("user_agent").cast("long").alias("event_id"), *names)


@query("request_validation", f"""with x as (select event_id, {_K} as k, event_type from events)
 select event_id, case when k % 9 = 0 then 'empty_prompt' when event_type = 'error' then 'unknown_provider' when k % 4 = 0 then 'source_language' when k % 5 = 0 then 'target_language' when k % 3 = 0 then 'same_language' end as reason from x""")
def request_validation(s, d):
    k = F.col("k")
    rows = _k(s, d).select(
        "event_id", F.when(k % 9 == 0, " \n").otherwise("hello").alias("prompt"), F.when(F.col("event_type") == "click", None).otherwise(F.col("event_type")).alias("provider"),
        F.when(k % 4 == 0, "latin").otherwise("english").alias("source_language"), F.when(k % 5 == 0, None).when(k % 3 == 0, "english").otherwise("georgian").alias("target_language"),
    )
    return rows.select("event_id", requests.reject_reason(rows, ["view", "purchase", "signup"]).alias("reason"))


@query("resolve_models", """with x as (select p_partkey, p_type as provider, case when p_size % 4 = 0 then null else p_brand end as model from part), y as (select p_partkey, provider, coalesce(model, case provider when 'SMALL' then 'Brand#1' when 'LARGE' then 'Brand#2' end) as m from x),
 z as (select p_partkey, provider, case when provider = 'SMALL' and m = 'Brand#1' then 'Brand#3' else m end as model from y) select p_partkey, provider, model, coalesce((provider, model) in (('SMALL', 'Brand#3'), ('PROMO', 'Brand#5')), false) as server_key_allowed from z""")
def resolve_models(s, d):
    rows = t(s, d, "part").select("p_partkey", F.col("p_type").alias("provider"), F.when(F.col("p_size") % 4 == 0, F.when(F.col("p_size") % 8 == 0, "")).otherwise(F.col("p_brand")).alias("model"))
    defaults = s.createDataFrame([("SMALL", "Brand#1"), ("LARGE", "Brand#2")], "provider string, default_model string")
    aliases = s.createDataFrame([("SMALL", "Brand#1", "Brand#3")], "provider string, alias string, current string")
    allowed = s.createDataFrame([("SMALL", "Brand#3"), ("PROMO", "Brand#5")], "provider string, allowed_model string")
    return requests.resolve_models(rows, defaults, aliases, allowed).select("p_partkey", "provider", "model", "server_key_allowed")


_PAIR_OF = "case p_size % 6 when 0 then 'mingrelian>english' when 1 then 'mingrelian>georgian' when 2 then 'english>mingrelian' when 3 then 'georgian>mingrelian' when 4 then 'georgian>english' else 'english>georgian' end"


@query("legacy_output", f"""with x as (select p_partkey, split_part({_PAIR_OF}, '>', 1) as a, split_part({_PAIR_OF}, '>', 2) as b, p_name as src, case when p_partkey % 2 = 0 then 'მა' else p_type end as tgt from part)
 select p_partkey, src as source_text, tgt as target_text, a as source_language, b as target_language, case when a = 'mingrelian' then src when b = 'mingrelian' and p_partkey % 2 = 1 then tgt else '' end as mingrelian_latinized,
 case when b = 'mingrelian' and p_partkey % 2 = 0 then tgt else '' end as mingrelian_mkhedruli, case when a = 'georgian' then src when b = 'georgian' then tgt else '' end as georgian, case when a = 'english' then src when b = 'english' then tgt else '' end as english, 'r' as full_response from x""")
def legacy_output(s, d):
    pairs = F.array(*[F.array(F.lit(a), F.lit(b)) for a, b in [("mingrelian", "english"), ("mingrelian", "georgian"), ("english", "mingrelian"), ("georgian", "mingrelian"), ("georgian", "english"), ("english", "georgian")]])
    part = t(s, d, "part").withColumn("pair", F.get(pairs, F.col("p_size") % 6)).withColumn("tgt", F.when(F.col("p_partkey") % 2 == 0, "მა").otherwise(F.col("p_type")))
    return part.select("p_partkey", *requests.legacy(F.col("pair")[0], F.col("pair")[1], F.col("p_name"), F.col("tgt"), F.lit("r")))


@query("answer_checks", f"""with b as (select p_name, list(distinct {n('p_brand')}) as accepted from part group by 1)
 select p_partkey, list_contains(accepted, {n("'Brand#' || (p_size % 26)")}) as matches, contains(p_name, 'red') or contains(p_name, 'gear') as contains_any, contains(p_name, 'ring') as contains_one from part join b using (p_name)""")
def answer_checks(s, d):
    part = t(s, d, "part")
    expected = part.groupBy("p_name").agg(F.collect_set("p_brand").alias("accepted"))
    output = F.concat(F.lit(" BRAND#"), F.col("p_size") % 26, F.lit("  "))
    return part.join(expected, "p_name").select("p_partkey", evals.matches_any(output, F.col("accepted")).alias("matches"), evals.contains_any(F.col("p_name"), ["red", "gear"]).alias("contains_any"), evals.contains_any(F.col("p_name"), ["ring"]).alias("contains_one"))


@query("language_gate", r"""with x as (select conv_id, turn, trim(text, E' \n\t\r') as x from conversations) select conv_id, turn, regexp_matches(x, '[A-Za-z]') and not regexp_matches(x, '[ა-ჰЀ-ӿ]') and len(list_filter(string_split_regex(x, '\n+'), lambda y: y <> '')) <= 2
 and not regexp_matches(x, '(?i)(translation|translated|output|answer|final)') as english, false as georgian from x""")
def language_gate(s, d):
    return t(s, d, "conversations").select("conv_id", "turn", evals.language_gate(F.col("text"), "english").alias("english"), evals.language_gate(F.col("text"), "georgian").alias("georgian"))


@query("strict_reference", "select doc_id, case when quality = 1 and toxic = 0 then 1 else 0 end as strict from labels")
def strict_reference(s, d):
    rows = t(s, d, "labels")
    target, confidence = F.when(F.col("quality") == 1, "Mingrelian").otherwise("english"), F.when(F.col("toxic") == 0, " High").otherwise("medium")
    return rows.select("doc_id", evals.strict_reference(target, confidence).alias("strict"))


@query("row_helpers", f"""select event_id, case when k % 3 = 0 then 'c' || k else event_type || ':' || user_id end as row_key, case when k % 2 = 0 then value else 0 end as metric, case when k % 2 = 0 then cast(trunc(value) as bigint) else k end as first_number,
 case when k % 4 = 0 then 'response' when k % 5 = 0 then 'row' else 'none' end as meta, '{{"a":' || case when k % 3 = 0 then 'null' else '"' || event_type || '"' end || ',"b":"' || k || '"}}' as case_key, cast(trunc(value * 1000) as bigint) as ms, strftime(ts, '%Y%m%d-%H%M%S') as run,
 case when k % 2 = 0 then event_type else 'd' end as option from (select *, {_K} as k from events)""")
def row_helpers(s, d):
    k = F.col("k")
    e = _k(s, d).withColumn("b", k.cast("string")).withColumn("a", F.when(k % 3 > 0, F.col("event_type")))
    scores = F.when(k % 2 == 0, F.create_map(F.lit("m"), F.col("value").cast("string"))).otherwise(F.create_map(F.lit("m"), F.lit(None).cast("string"), F.lit("o"), k.cast("string")))
    meta = lambda c, v: F.when(c, F.create_map(F.lit("v"), F.lit(v))).otherwise(F.create_map().cast("map<string,string>"))
    found = evals.row_metadata(meta(k % 4 == 0, "response"), meta(k % 5 == 0, "row"))
    return e.select(
        "event_id", evals.row_key(F.when(k % 3 == 0, F.concat(F.lit("c"), k)).otherwise(""), F.col("event_type"), F.col("user_id").cast("string")).alias("row_key"), evals.named_metric(scores, "m").alias("metric"), analytics.first_number(scores, "m", "o").alias("first_number"),
        F.coalesce(F.try_element_at(found, F.lit("v")), F.lit("none")).alias("meta"), evals.case_key(e, ["b", "a"]).alias("case_key"), analytics.milliseconds(F.col("value")).alias("ms"), analytics.run_id(F.col("ts")).alias("run"),
        F.when(k % 2 == 0, evals.option(e, "model", {"model_var": "event_type"})).otherwise(evals.option(e, "model", {}, "d")).alias("option"),
    )


@query("case_numbers", "select doc_id, printf('%03d', row_number() over (order by n_chars, doc_id)) as case_id from documents")
def case_numbers(s, d):
    return evals.case_numbers(t(s, d, "documents").select("doc_id", "n_chars"), ["n_chars", "doc_id"], 3).select("doc_id", "case_id")


_SCORE = "(length(text) % 11) / 10.0"


@query("rubric_scores", f"""select conv_id, turn, case when role = 'user' then null else {_SCORE} end as score, case when role = 'user' then 'no verdict' else 'n' || (length(text) % 11) end as reason, coalesce(case when role <> 'user' then {_SCORE} >= 0.8 end, false) as pass from conversations""")
def rubric_scores(s, d):
    """Every turn judged by a stand-in that answers as judges do: JSON in a fence, or nothing that is JSON."""

    def ask(provider: str, model: str):
        def judge(prompt: str) -> str:
            n = len(prompt.partition("<output>\n")[2].rpartition("\n</output>")[0]) % 11
            return "I would rather not say." if provider == "user" else f'Here it is:\n```json\n{{"pass": true, "score": {n / 10}, "reason": "n{n}"}}\n```'

        return judge

    rows = t(s, d, "conversations").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("output"), F.col("role").alias("provider"), F.lit("judge-1").alias("model"))
    return evals.rubric(rows, "Is it said well?", "output", ask, 0.8).select("conv_id", "turn", "score", "reason", "pass")


@query("provider_summary", """with x as (select case when lang = 'de' then 'unknown' else lang end as provider, quality = 1 as ok, n_chars from labels join documents using (doc_id))
 select provider, count(*) as total, cast(sum(ok::int) as bigint) as passed, avg(ok::int) as pass_rate, min(n_chars) as prompt_chars_min, cast(trunc(median(n_chars)) as bigint) as prompt_chars_median, max(n_chars) as prompt_chars_max from x group by 1""")
def provider_summary(s, d):
    rows = t(s, d, "labels").join(t(s, d, "documents").select("doc_id", "lang", "n_chars"), "doc_id")
    label = F.when(F.col("lang") == "de", F.when(F.col("quality") == 1, "")).otherwise(F.col("lang"))
    return evals.provider_summary(rows, label, F.col("quality") == 1, {"prompt_chars": F.col("n_chars")})


_GRAMMARS = {"full": "Endings follow stems.\nVerbs come last.", "compact": "Endings follow stems.", "none": ""}


@query("prompt_cube", f"""with p(policy, grammar) as (values {', '.join(f"('{k}', {len(v)})" for k, v in _GRAMMARS.items())}), x as (select role as direction, length(trim(text, E' \\n\\t\\r')) as size from conversations)
 select direction, policy, count(*) as cases, cast(trunc(median(size)) as int) as entries_median, cast(max(size) as int) as entries_max, cast(max(case when size > 0 then grammar else 0 end) as int) as grammar_max from x, p group by 1, 2""")
def prompt_cube(s, d):
    """Section sizes of the prompts of every direction, policy and row, as measure() finds them in the built prompt."""
    grammar = F.create_map(*[F.lit(x) for kv in _GRAMMARS.items() for x in kv])
    rows = t(s, d, "conversations").select("role", "text", F.explode(F.array(*map(F.lit, _GRAMMARS))).alias("policy"))
    prompt = prompts.build(F.lit("hello"), F.lit("english"), F.lit("mingrelian"), F.lit(None).cast("string"), F.col("text"), F.try_element_at(grammar, prompts.grammar_policy(F.concat(F.lit(" "), F.upper("policy")))))
    m = rows.select(F.col("role").alias("direction"), "policy", prompts.measure(prompt).alias("m"))
    out = evals.size_summary(m, ["direction", "policy"], {"entries": F.col("m.dict_entries_chars"), "grammar": F.col("m.grammar_chars")})
    return out.select("direction", "policy", "cases", F.col("entries_median").cast("int").alias("entries_median"), "entries_max", "grammar_max")


@query("markdown_report", "select lang, count(*) as n, avg(quality) as mean from labels join documents using (doc_id) group by 1")
def markdown_report(s, d):
    """The rows of a report, read back from its Markdown."""
    rows = t(s, d, "labels").join(t(s, d, "documents").select("doc_id", "lang"), "doc_id").groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.avg("quality").alias("mean"))
    lines = [[c.strip() for c in x.strip("| ").split("|")] for x in evals.markdown(rows, ["lang", "n", "mean"]).split("\n")]
    if lines[0] != ["lang", "n", "mean"] or lines[1] != ["---"] * 3:
        raise ValueError("not the report's head")
    told = s.createDataFrame([(a, int(b), c) for a, b, c in lines[2:]], "lang string, n long, shown string")
    return told.join(rows.select("lang", "mean"), "lang").filter(F.format_number("mean", 3) == F.col("shown")).select("lang", "n", "mean")


def _entries(s, d):
    """Dictionary entries from part: each with the gloss of its type, and one of its brand; some of another language or kind."""
    part = t(s, d, "part")
    gloss = lambda c: F.array(c)
    senses = F.array(F.struct(gloss(F.concat("p_type", F.lit(", "), "p_brand", F.lit("; "), "p_type")).alias("glosses")), F.struct(gloss(F.lit("plural of x")).alias("glosses")), F.struct(F.array().cast("array<string>").alias("glosses")), F.struct(gloss(F.lit("(x)")).alias("glosses")))
    forms = F.array(F.struct(F.lit("other").alias("form"), F.array(F.lit("x")).alias("tags")), F.struct(F.concat(F.lit(" "), "p_brand").alias("form"), F.array(F.lit("romanization")).alias("tags")))
    return part.select(
        F.col("p_partkey").alias("line"), F.when(F.col("p_size") % 10 == 0, "en").otherwise("xx").alias("lang_code"), F.when(F.col("p_size") % 7 == 0, "name").otherwise("noun").alias("pos"),
        F.when(F.col("p_size") % 11 == 0, "-x").otherwise(F.upper("p_name")).alias("word"), forms.alias("forms"), senses.alias("senses"),
    )


_IMPORT = """e as (select *, case when p_size % 10 = 0 then 'other_language' when p_size % 7 = 0 then 'pos' when p_size % 11 = 0 then 'affix' end as reason from part),
 g as (select p_partkey, upper(p_name) as headword, p_brand as raw, p_type, p_brand from e where reason is null),
 c as (select p_partkey, headword, raw, 0 as k, p_type || ', ' || p_brand || '; ' || p_type as translation from g union all select p_partkey, headword, raw, 1, p_type from g union all select p_partkey, headword, raw, 2, p_brand from g),
 r as (select *, row_number() over (partition by lower(headword), lower(raw), lower(translation) order by p_partkey, k) as rn from c)"""


@query("import_rows", f"with {_IMPORT} select headword, raw as headword_raw, translation, p_partkey as line from r where rn = 1")
def import_rows(s, d):
    return etl.import_rows(_entries(s, d), "xx", ["noun", "verb"])[0].select("headword", "headword_raw", "translation", "line")


@query("import_reasons", f"""with {_IMPORT} select reason, count(*) as n from (select reason from e where reason is not null union all select 'duplicate' from r where rn > 1 union all select 'sense_without_gloss' from g
 union all select 'gloss_prefix' from g union all select 'no_clean_gloss_candidate' from g) group by 1""")
def import_reasons(s, d):
    return etl.import_rows(_entries(s, d), "xx", ["noun", "verb"])[1]


@query("import_summary", f"""with {_IMPORT}, b as (select p_name as h, p_type as t from part), x as (select h, lower(t) as t, 1 as own from b union all select lower(headword), lower(translation), 0 from r where rn = 1), m as (select h, t, max(own) as own from x group by 1, 2)
 select (select count(*) from b) as base_rows, (select count(*) from r where rn = 1) as candidate_rows, count(*) as combined_rows, count(*) filter (own = 0) as added_rows from m""")
def import_summary(s, d):
    base = t(s, d, "part").select(F.lit("").alias("headword"), F.col("p_name").alias("headword_raw"), F.col("p_type").alias("translation"))
    return etl.import_summary(base, etl.import_rows(_entries(s, d), "xx", ["noun", "verb"])[0])


@query("coerced_values", f"select event_id, k % 4 in (0, 1) as flag, case when k % 3 = 0 then k end as whole from (select *, {_K} as k from events)")
def coerced_values(s, d):
    k = F.col("k")
    e = _k(s, d).select("event_id", F.when(k % 4 == 0, " Yes").when(k % 4 == 1, "on").when(k % 4 == 2, "off").alias("f"), F.when(k % 3 == 0, F.concat(F.lit(" "), k)).when(k % 3 == 1, "12.7").alias("w"))
    return e.select("event_id", analytics.to_bool(F.col("f")).alias("flag"), analytics.to_int(F.col("w")).alias("whole"))


#: Words of documents, in Mkhedruli letter by letter, with an ending by their length: stand-ins for inflected words.
_LATIN, _MKHEDRULI = "abcdefghijklmnopqrstuvwxyz", "აბცდეფგჰიჯკლმნოპქრსტუვწხყზ"
_ENDED = ["", "ს", "იშ", "ეფს", "ენიშა", "ები", "ში"]
_INFLECTED = f"""select distinct translate(w, '{_LATIN}', '{_MKHEDRULI}') || ['{"', '".join(_ENDED)}'][length(w) % {len(_ENDED)} + 1] as word from (select unnest(regexp_extract_all(lower(text), '[a-z]+')) as w from documents)"""


def _inflected(s, d):
    w = t(s, d, "documents").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("w")).distinct()
    return w.select(F.concat(F.translate("w", _LATIN, _MKHEDRULI), F.get(F.array(*map(F.lit, _ENDED)), F.length("w") % len(_ENDED))).alias("word")).distinct()


def _stems_sql() -> str:
    ends = sorted({*text.CASE_ENDINGS, *[e + v for e in text.EMPHATIC_ENDINGS for v in text.EMPHATIC]}, key=lambda e: (-len(e), e))
    forms = lambda x: f"case when {x} is null then [] when strpos('{text.VOWELS}', right({x}, 1)) = 0 then [{x} || 'ი', {x}] else [{x}] end"
    plural = " || ".join(forms(f"case when ends_with(stem, '{p}') and length(stem) >= {len(p) + 3} then left(stem, length(stem) - {len(p)}) end") for p in text.PLURALS)
    return f"""with w as ({_INFLECTED}), h as (select word, list_filter(['{"', '".join(ends)}'], lambda e: ends_with(word, e) and length(word) - length(e) >= 3)[1] as e from w where length(word) >= 4),
 s as (select word, left(word, length(word) - length(e)) as stem from h where e is not null), f as (select word, unnest({forms("stem")} || {plural}) as stem from s) select distinct word, stem from f where stem <> word"""


@query("case_stems", _stems_sql())
def case_stems(s, d):
    """Stems of every word of documents, inflected by a stand-in."""
    return _inflected(s, d).select("word", F.explode(text.case_strip(F.col("word"))).alias("stem"))


@query("georgian_variants", f"""with w as ({_INFLECTED}), v as (select word, word as variant from w union select word, left(word, length(word) - 3) || x from w, (values (''), ('ი')) e(x) where word like '%ები' and length(word) > 4
 union select word, left(word, length(word) - 2) || x from w, (values (''), ('ი')) e(x) where word like '%ში' and length(word) > 3) select word, variant from v""")
def georgian_variants(s, d):
    return _inflected(s, d).select("word", F.explode(text.georgian_variants(F.col("word"))).alias("variant"))
