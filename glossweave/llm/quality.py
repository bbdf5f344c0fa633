"""Operator 5: quality rules with risk-controlled thresholds. DataFrame functions only.

measure() counts each text. choose_cutoffs() takes labelled holdouts (quality 1: a document that must stay) and, for
each stratum (band of n_words) and each rule, tests a fixed ladder of cutoffs from lenient to strict. At a cutoff, k of
n good documents would be rejected; the cutoff stands if the exact binomial test P(Bin(n, risk) <= k) <= level holds,
which is the Clopper-Pearson bound. Each rule gets risk RISK / rules, so that all rules together falsely reject at most
RISK of a stratum's good documents; the level is DELTA / (strata * rules) (Bonferroni). Within a ladder testing stops
at the first failure (fixed-sequence testing), which needs no further correction. All guarantees hold at once with
probability 1 - DELTA. A stratum with too few good holdouts gets no cutoff and rejects nothing.

Null text has no words and all counts 0; it fails the base rule. Rows that repeat are each judged. Null labels count as
unlabelled; a doc_id labelled twice counts each time. An empty labels table gives no cutoffs, an empty documents table no
rows. A very long text is counted whole, in one row of one task. Other columns, of either table, are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossweave.llm.common import scratch_table

RISK, DELTA = 0.06, 0.05
#: The lower ends of the strata in words.
BANDS = [0, 20, 60, 200, 800]
#: Ladders of cutoffs in percent, lenient to strict, down to 0, so that the bound and not the ladder ends the search;
#: a rule rejects what lies above.
LADDERS = {
    "symbol_pct": [60.0, 50.0, 40.0, 30.0, 25.0, 20.0, 15.0, 12.0, 10.0, 8.0, 6.0, 5.0, 4.0, 3.0, 2.0, 1.0, 0.5, 0.0],
    "dup_line_pct": [95.0, 90.0, 80.0, 70.0, 60.0, 50.0, 40.0, 30.0, 20.0, 15.0, 10.0, 5.0, 2.0, 0.0],
    "repeat_pct": [29.0, 27.0, 25.0, 22.0, 20.0, 15.0, 10.0, 5.0, 2.0, 1.0, 0.0],
}
SPACE = " \t\n\x0b\x0c\r"


def let(value: Column, body) -> Column:
    """body(value) with value computed once, also where body uses it inside a lambda."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _paired(hashes: Column, step: int) -> Column:
    """The hash of each entry with the one `step` later; shorter by step."""
    def pair(h):
        n = F.greatest(F.size(h) - step, F.lit(0))
        return F.zip_with(F.slice(h, F.lit(1), n), F.slice(h, step + 1, n), lambda a, b: F.xxhash64(a, b))

    return let(hashes, pair)


def measure(docs: DataFrame, more: list[str] | None = None) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, base_failed of docs (doc_id, text), and the
    columns `more` of docs as they are.

    A window of 8 words is known by a 64-bit hash made of the hashes of its halves, its quarters and its words.
    """
    more = more or []
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("_t"), *more)
    body = F.btrim("_t", F.lit(SPACE))
    lines = F.filter(F.split("_t", "\n"), lambda s: F.btrim(s, F.lit(SPACE)) != "")
    d = d.select(
        "doc_id",
        *more,
        F.regexp_count("_t", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), F.size(F.array_distinct(x)).cast("long").alias("u"))).alias("_l"),
        F.when(body != "", F.split(body, r"[\x20\x09-\x0D]+")).otherwise(F.array().cast("array<string>")).alias("_w"),
    )
    d = d.select(
        "doc_id",
        *more,
        "n_symbols",
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        (F.col("_l")["n"] - F.col("_l")["u"]).alias("n_dup_lines"),
        F.col("_l")["n"].alias("n_lines"),
        _paired(_paired(_paired(F.transform("_w", lambda w: F.xxhash64(w)), 1), 2), 4).alias("_h"),
    )
    repeats = F.size(F.array_distinct("_h")) < F.size("_h")
    keyed = F.when(repeats, F.array_sort(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    d = d.withColumn("_k", keyed).drop("_h")
    size = F.size("_k")
    later = F.slice("_k", F.lit(2), F.greatest(size - 1, F.lit(0)))
    d = d.withColumn("_l", F.when(F.col("_k").isNotNull(), later))
    # each neighbouring pair of equal windows marks both positions
    pairs = F.zip_with(F.slice("_k", F.lit(1), F.greatest(size - 1, F.lit(0))), "_l", lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])))
    d = d.withColumn("_p", F.when(F.col("_k").isNotNull(), F.sort_array(F.array_distinct(F.flatten(F.filter(pairs, lambda p: p.isNotNull())))))).drop("_k", "_l")
    cover = F.aggregate(
        "_p",
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(-8).alias("last")),
        lambda s, p: F.struct((s["n"] + F.least(p - s["last"], F.lit(8))).cast("long").alias("n"), p.alias("last")),
        lambda s: s["n"],
    )
    d = d.withColumn("n_repeat_words", F.coalesce(cover, F.lit(0).cast("long"))).drop("_p")
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return d.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", failed.alias("base_failed"), *more)


def percent(part: str, whole: str) -> Column:
    return F.when(F.col(whole) > 0, 100.0 * F.col(part) / F.col(whole)).otherwise(0.0)


def scores() -> dict[str, Column]:
    return {"symbol_pct": percent("n_symbols", "word_chars"), "dup_line_pct": percent("n_dup_lines", "n_lines"), "repeat_pct": percent("n_repeat_words", "n_words")}


def stratum() -> Column:
    out = F.lit(0)
    for i, low in enumerate(BANDS):
        out = F.when(F.col("n_words") >= low, i).otherwise(out) if i else out
    return out


def log_gamma(x: Column) -> Column:
    """ln Gamma(x) for x >= 1: Stirling's series at x + 8, error under 1e-12."""
    z = x + 8.0
    low = sum((F.log(x + float(i)) for i in range(1, 8)), F.log(x))
    return (z - 0.5) * F.log(z) - z + 0.9189385332046727 + 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5) - low


def binomial_below(n: Column, k: Column, p: Column) -> Column:
    """P(Bin(n, p) <= k), 1 where k >= n * p (then it is over a half); the sum runs down from k till terms vanish."""
    nd, kd = n.cast("double"), k.cast("double")
    top = log_gamma(nd + 1) - log_gamma(kd + 1) - log_gamma(nd - kd + 1) + kd * F.log(p) + (nd - kd) * F.log(1 - p)
    span = F.least(k, (60 + 45 * F.sqrt(nd * p * (1 - p))).cast("long"))
    terms = F.aggregate(
        F.sequence(F.lit(0).cast("long"), span),
        F.struct(F.lit(1.0).alias("term"), F.lit(0.0).alias("sum")),
        lambda s, j: F.struct((s["term"] * (kd - j) / (nd - kd + j + 1) * (1 - p) / p).alias("term"), (s["sum"] + s["term"]).alias("sum")),
        lambda s: s["sum"],
    )
    return F.when(kd >= nd * p, F.lit(1.0)).otherwise(F.exp(top) * terms)


def choose_cutoffs(measured: DataFrame, labels: DataFrame, risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """stratum and one cutoff column for each rule (null: none): at most len(BANDS) rows.

    Counts by stratum, rule and cutoff cover every labelled good document and are summed before the shuffle.
    """
    good = labels.filter(F.col("quality") == 1).select(F.col("doc_id").cast("long").alias("doc_id"))
    held = measured.join(good, "doc_id").filter(~F.col("base_failed")).withColumn("stratum", stratum())
    ks = [F.sum((s > c).cast("long")).alias(f"{rule}_{i}") for rule, s in scores().items() for i, c in enumerate(LADDERS[rule])]
    wide = held.groupBy("stratum").agg(F.count(F.lit(1)).alias("n"), *ks)
    rule_risk, level = F.lit(risk / len(LADDERS)), delta / (len(LADDERS) * len(BANDS))
    out = wide.select("stratum", *[F.array(*[(binomial_below(F.col("n"), F.col(f"{rule}_{i}"), rule_risk) <= level) for i in range(len(cs))]).alias(rule) for rule, cs in LADDERS.items()])
    chosen = []
    for rule, cs in LADDERS.items():
        passed = F.array_position(F.col(rule), False) - 1  # how many pass before the first that fails; -1: all
        count = F.when(passed < 0, F.lit(len(cs))).otherwise(passed).cast("int")
        chosen.append(F.when(count > 0, F.element_at(F.array(*map(F.lit, cs)), F.greatest(count, F.lit(1)))).alias(f"{rule}_cutoff"))
    return out.select("stratum", *chosen)


def over_cutoffs() -> Column:
    """Whether a measured row, with the cutoffs of its stratum, lies over one of them."""
    over = F.lit(False)
    for rule, s in scores().items():
        over = over | F.coalesce(s > F.col(f"{rule}_cutoff"), F.lit(False))
    return over


def quality_rules(docs: DataFrame, labels: DataFrame, risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """The counts, base_failed and kept of every document. The counts, a few numbers a document, go to the shared folder
    once; cutoffs and verdicts are taken from there."""
    measured = scratch_table(measure(docs), "quality")
    judged = measured.withColumn("stratum", stratum()).join(F.broadcast(choose_cutoffs(measured, labels, risk, delta)), "stratum", "left")
    cols = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    return judged.select(*cols, (~F.col("base_failed") & ~over_cutoffs()).alias("kept"))


def kept_rows(docs: DataFrame, labels: DataFrame, risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """The rows of docs, with all their columns, that quality_rules() keeps. Each row is written once beside its counts, from
    which cutoffs are taken; no text is shuffled."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    measured = scratch_table(measure(docs.select("doc_id", "text", row.alias("_row")), ["_row"]), "quality")
    rows = measured.withColumn("stratum", stratum()).join(F.broadcast(choose_cutoffs(measured.drop("_row"), labels, risk, delta)), "stratum", "left")
    return rows.filter(~F.col("base_failed") & ~over_cutoffs()).select("_row.*")


def sql(risk: float = RISK, delta: float = DELTA) -> str:
    """What quality_rules() returns, over the tables documents and labels, for DuckDB."""
    word, step = r"[^\x20\x09-\x0D]", 7
    level, p = delta / (len(LADDERS) * len(BANDS)), risk / len(LADDERS)
    ladder = ", ".join(f"('{rule}', {i}, {c})" for rule, cs in LADDERS.items() for i, c in enumerate(cs))
    band = " ".join(f"when n_words >= {low} then {i}" for i, low in reversed(list(enumerate(BANDS))))
    return f"""with w as (select row_number() over () as row, doc_id, regexp_extract_all(coalesce(text, ''), '{word}+') as words, len(regexp_extract_all(coalesce(text, ''), '[#*$%&|<>]')) as n_symbols,
 list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '{word}')) as lines from documents),
 windows as (select row, i, array_to_string(words[i:i + {step}], ' ') as k from (select row, words, unnest(generate_series(1, len(words) - {step})) as i from w)),
 twice as (select row, i from (select row, i, count(*) over (partition by row, k) as n from windows) where n > 1),
 cover as (select row, count(distinct i + j) as n from twice, (select unnest(generate_series(0, {step})) as j) group by row),
 m as (select row, doc_id, len(words) as n_words, length(array_to_string(words, '')) as word_chars, n_symbols, len(lines) - len(list_distinct(lines)) as n_dup_lines, len(lines) as n_lines, coalesce(cover.n, 0) as n_repeat_words from w left join cover using (row)),
 b as (select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed, case {band} end as stratum, case when word_chars > 0 then 100.0::double * n_symbols / word_chars else 0 end as symbol_pct,
 case when n_lines > 0 then 100.0::double * n_dup_lines / n_lines else 0 end as dup_line_pct, case when n_words > 0 then 100.0::double * n_repeat_words / n_words else 0 end as repeat_pct from m),
 score as (unpivot b on symbol_pct, dup_line_pct, repeat_pct into name rule value score), ladder(rule, i, c) as (values {ladder}),
 held as (select stratum, rule, i, c, count(*) as n, count(*) filter (score > c) as k from score join labels using (doc_id) join ladder using (rule) where quality = 1 and not base_failed group by all),
 tested as (select *, case when k >= n * {p} then false else (select sum(exp(lgamma(n + 1) - lgamma(x + 1) - lgamma(n - x + 1) + x * ln({p}) + (n - x) * ln(1 - {p}))) from (select unnest(generate_series(0, k)) as x)) <= {level} end as ok from held),
 cutoff as (select stratum, rule, arg_max(c, i) filter (ok and i < first) as c from (select *, coalesce(min(i) filter (not ok) over (partition by stratum, rule), 99) as first from tested) group by all),
 over as (select row, bool_or(score > c) as over from score left join cutoff using (stratum, rule) group by row)
 select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and not coalesce(over, false) as kept from b join over using (row)"""
