"""Scoring and summaries of evaluation rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glossweave.functions.text import composed, coverage_tokens, normalize, strip_space
from glossweave.operators import clients
from glossweave.operators.lookup import ranked
from glossweave.sources.shared import stored


def composite_score(quality: Column, script: Column, reference: Column, strict: Column) -> Column:
    """struct(score, pass): quality in 0..1, raised to .95 by a reference hit, held to .89 where a reference form is
    asked for and missing, and to .2 without the right script; in that order."""
    s = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(quality.cast("double"), F.lit(0.0))))
    ref, ok = F.coalesce(reference, F.lit(0)) >= 1, F.coalesce(script, F.lit(0)) >= 1
    s = F.when(ref, F.greatest(s, F.lit(0.95))).otherwise(s)
    s = F.when((F.coalesce(strict, F.lit(0)) >= 1) & ~ref, F.least(s, F.lit(0.89))).otherwise(s)
    s = F.when(~ok, F.least(s, F.lit(0.2))).otherwise(s)
    return F.struct(s.alias("score"), (ok & (s >= 0.9)).alias("pass"))


#: So many rows of an expected side at most are sent to every task.
MOST_SENT = 200_000


def _sent(rows: DataFrame) -> DataFrame:
    """rows (stored), sent to every task where they are few."""
    return F.broadcast(rows) if rows.count() <= MOST_SENT else rows


def _numbered(rows: DataFrame, key: str, n: str, *more: Column) -> DataFrame:
    """key, ts of rows (key, t, n): each token as often as it counts, the second and later ones told apart by their number, so that
    what two texts have in common is the intersection of two sets."""
    again = F.transform(F.sequence(F.lit(2).cast("long"), F.col(n)), lambda i: F.concat("t", F.lit("\u0001"), i.cast("string")))
    one = F.when(F.col(n) == 1, F.array("t")).otherwise(F.concat(F.array("t"), again))
    return rows.groupBy(key).agg(F.sort_array(F.flatten(F.collect_list(one))).alias("ts"), *more)


def token_counts(expected: DataFrame, actual: DataFrame, expected_id: str, actual_id: str, target: str = "english", distinct: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(expected_id, t, ne, total, before), (expected_id, es, total) and (actual_id, ts), stored: how often an expected text (text)
    has a token, how many tokens it has, and how many of them are rarer; and the _numbered tokens of an expected text, and of an
    actual text those that some expected one has. distinct: one row for actual texts of the same such tokens, actual_id a number.
    """
    e = composed(expected.select(expected_id, "text"), "text").select(expected_id, F.explode(coverage_tokens(F.col("text"), target)).alias("t"))
    e = stored(e.groupBy(expected_id, "t").agg(F.count(F.lit(1)).alias("ne")), "expected")
    known = _sent(stored(e.select("t").distinct(), "known"))
    # texts are dealt by their id once, so that their tokens are not moved
    a = composed(actual.select(actual_id, "text"), "text").repartition(actual_id).select(actual_id, F.explode(coverage_tokens(F.col("text"), target)).alias("t"))
    a = _numbered(a.join(known, "t", "left_semi").groupBy(actual_id, "t").agg(F.count(F.lit(1)).alias("na")), actual_id, "na")
    a = stored(a.select("ts").distinct().select(F.monotonically_increasing_id().alias(actual_id), "ts") if distinct else a, "actual")
    rare = _postings(a, actual_id).groupBy("t").agg(F.count(F.lit(1)).alias("df"))
    own = Window.partitionBy(expected_id)
    order = own.orderBy(F.coalesce("df", F.lit(0)), "t").rowsBetween(Window.unboundedPreceding, -1)
    ranked = e.join(rare, "t", "left").select(expected_id, "t", "ne", F.sum("ne").over(own).alias("total"), F.coalesce(F.sum("ne").over(order), F.lit(0)).alias("before"))
    sets = _numbered(e, expected_id, "ne", F.sum("ne").alias("total")).withColumnRenamed("ts", "es")
    return stored(ranked, "expected"), stored(sets, "expected"), a


def _postings(a: DataFrame, actual_id: str) -> DataFrame:
    """actual_id, t: the tokens of a, and their later numbers, which no other table has as a token."""
    return a.select(actual_id, F.explode("ts").alias("t"))


def _scored(pairs: DataFrame, sets: DataFrame, a: DataFrame, expected_id: str, actual_id: str) -> DataFrame:
    """expected_id, actual_id, coverage of pairs. A text travels once for each of its pairs, its tokens never by themselves."""
    both = pairs.join(a, actual_id).join(sets, expected_id)
    return both.select(expected_id, actual_id, (F.size(F.array_intersect("es", "ts")) / F.col("total")).alias("coverage"))


def coverage(expected: DataFrame, actual: DataFrame, expected_id: str, actual_id: str, least: float, target: str = "english") -> DataFrame:
    """expected_id, actual_id, coverage >= least: multiset share of expected tokens in actual.

    A pair that reaches the least coverage shares one of the item's rarest tokens: those that a match cannot miss all of. Only
    pairs that meet on such a token are counted, so that common words make no pairs. Each table is read once.
    """
    e, sets, a = token_counts(expected, actual, expected_id, actual_id, target)
    probe = stored(e.filter(F.col("before") <= (1 - least) * F.col("total") + 1e-9).select(expected_id, "t"), "probe")
    pairs = _postings(a, actual_id).join(_sent(probe), "t").select(expected_id, actual_id).distinct()
    return _scored(pairs, sets, a, expected_id, actual_id).filter(F.col("coverage") >= least)


def best_coverage(expected: DataFrame, actual: DataFrame, expected_id: str, actual_id: str, target: str = "english", steps: tuple[float, ...] = (0.1, 0.25, 0.5, 1.0), observe: Callable[[DataFrame], None] | None = None) -> DataFrame:
    """expected_id, best: the greatest coverage of each expected text by any one actual text; those that share no token with any go.

    Texts meet on an item's rarest tokens first, a share of its tokens in each step. What has not met on tokens so far covers no
    more than the rest of the item, so a token is passed by where that rest is no more than the item's best. Actual texts of the
    same tokens, as far as items have these, are one. observe, if given, gets each step's pairs.
    """
    e, sets, a = token_counts(expected, actual, expected_id, actual_id, target, distinct=True)
    best: DataFrame | None = None
    for low, high in zip((0.0, *steps), steps, strict=False):
        probe = e.filter((F.col("before") >= low * F.col("total")) & (F.col("before") < high * F.col("total")))
        if best is not None:
            probe = probe.join(best, expected_id, "left").filter(F.col("total") - F.col("before") > F.coalesce("best", F.lit(0.0)) * F.col("total") + 1e-9)
        probe = _sent(stored(probe.select(expected_id, "t"), "probe"))
        pairs = stored(_postings(a, actual_id).join(probe, "t").select(expected_id, actual_id).distinct(), "pairs")
        if observe:
            observe(pairs)
        found = _scored(pairs, sets, a, expected_id, actual_id).select(expected_id, F.col("coverage").alias("best"))
        best = stored((found if best is None else best.unionByName(found)).groupBy(expected_id).agg(F.max("best").alias("best")), "best")
    return best


def signature(text: Column, target: str, ordered: bool = True) -> Column:
    t = coverage_tokens(text, target)
    return F.array_join(t if ordered else F.sort_array(t), "\u0001")


def matches_any(output: Column, expected: Column) -> Column:
    """Whether the normalised output is one of expected (array); blank ones match nothing."""
    real = F.filter(F.coalesce(expected, F.array().cast("array<string>")), lambda x: normalize(x) != "")
    return F.array_contains(F.transform(real, normalize), normalize(output))


def contains_any(output: Column, values: list[str]) -> Column:
    """Whether the output holds one of values as it is."""
    return F.coalesce(F.exists(F.array(*map(F.lit, values)).cast("array<string>"), lambda v: F.contains(output, v)), F.lit(False))


def rubric(rows: DataFrame, instructions: str, output: str, ask: clients.Ask, least: float, evidence: list[str] | None = None, limits: clients.Limits = clients.Limits()) -> DataFrame:
    """rows (provider, model: the judge's) with score (0 to 1), reason and pass: what a judge says of the column output by the
    instructions and the columns of evidence. The judge is asked once for equal prompts.

    The verdict is the JSON object in the response, whatever stands around it. A score outside 0 to 1 is cut; one without a score
    counts 1 or 0 by its pass. A null output, a failed call and a response without a verdict have a null score and do not pass.
    """
    parts = [F.lit(f"{instructions}\n"), *[F.concat(F.lit(f"<{c}>\n"), F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit(f"\n</{c}>\n")) for c in evidence or []], F.lit("<output>\n"), F.col(output), F.lit('\n</output>\nAnswer with JSON: {"pass": true or false, "score": 0.0 to 1.0, "reason": "..."}')]
    told = clients.ask_once(rows.withColumn("_prompt", F.concat(*parts)), "_prompt", ask, limits=limits)
    verdict = F.try_parse_json(F.regexp_extract("response", r"(?s)(\{.*\})", 1))
    passed = F.try_variant_get(verdict, "$.pass", "boolean")
    score = F.coalesce(F.try_variant_get(verdict, "$.score", "double"), passed.cast("double"))
    score = F.when(score.isNotNull() & ~F.isnan(score), F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)))
    reason = F.coalesce(F.try_variant_get(verdict, "$.reason", "string"), F.col("response_error"), F.when(score.isNull() & F.col(output).isNotNull(), "no verdict"))
    agreed = F.coalesce((score >= least) & F.coalesce(passed, F.lit(True)), F.lit(False))
    return told.select(*rows.columns, score.alias("score"), reason.alias("reason"), agreed.alias("pass"))


def language_gate(c: Column, target: str) -> Column:
    """The looser gate: some letter of the target's script, none of the others', at most two lines, no word that wraps an answer
    anywhere in the text."""
    x = strip_space(F.coalesce(c, F.lit("")))
    georgian, latin, cyrillic = F.regexp_count(x, F.lit("[ა-ჰ]")), F.regexp_count(x, F.lit("[A-Za-z]")), F.regexp_count(x, F.lit("[Ѐ-ӿ]"))
    script = (latin > 0) & (georgian == 0) if target == "english" else (georgian > 0) & (latin == 0)
    lines = F.size(F.filter(F.split(x, "\n+"), lambda y: y != ""))
    return script & (cyrillic == 0) & (lines <= 2) & ~x.rlike("(?i)(?:translation|translated|output|answer|final)")


def strict_reference(target: Column, confidence: Column) -> Column:
    """1 where a reference form is asked for: Mingrelian cases of high confidence."""
    return ((F.lower(target) == "mingrelian") & (F.lower(F.trim(F.coalesce(confidence, F.lit("")))) == "high")).cast("int")


def named_metric(scores: Column, name: str) -> Column:
    """A named score, 0 where it is missing."""
    return F.coalesce(F.try_element_at(scores, F.lit(name)).cast("double"), F.lit(0.0))


def row_key(case_id: Column, direction: Column, input_text: Column) -> Column:
    return F.coalesce(F.nullif(case_id, F.lit("")), F.concat(direction, F.lit(":"), input_text))


def case_key(rows: DataFrame, columns: list[str]) -> Column:
    """One string for what a row asked: its columns by name, in order of their names, nulls kept."""
    return F.to_json(F.struct(*[F.col(c) for c in sorted(columns)]), {"ignoreNullFields": "false"})


def row_metadata(response: Column, own: Column) -> Column:
    """The response's metadata (map), else the row's own, else an empty map; an empty one counts as missing."""
    full = lambda m: F.when(F.size(m) > 0, m)
    return F.coalesce(full(response), full(own), F.create_map().cast("map<string,string>"))


def case_numbers(rows: DataFrame, order: list[str], digits: int = 2, name: str = "case_id") -> DataFrame:
    """rows with the number of each in order, from 1, with leading zeros. Rows are numbered where they lie after a sort by range;
    rows that tie take their numbers in any order."""
    return ranked(rows, order, "_n").withColumn(name, F.format_string(f"%0{digits}d", "_n")).drop("_n")


def option(rows: DataFrame, name: str, config: dict[str, str], default: str | None = None) -> Column:
    """A run's option: where the configuration names a column for it (`<name>_var`), that column, an error where it is empty;
    else the configured value, else the default."""
    column = config.get(f"{name}_var")
    if not column:
        return F.lit(config.get(name, default))
    value = F.col(column).cast("string") if column in rows.columns else F.lit(None).cast("string")
    return F.when(F.coalesce(value, F.lit("")) != "", value).otherwise(F.raise_error(F.lit(f"no value of '{column}' for {name}")).cast("string"))


def csv_list(value: str, allowed: list[str]) -> list[str]:
    """The parts of a comma list, trimmed, empty ones gone; an error names those that are not allowed."""
    parts = [x.strip() for x in value.split(",") if x.strip()]
    if bad := [x for x in parts if x not in allowed]:
        raise ValueError(f"not among {', '.join(allowed)}: {', '.join(bad)}")
    return parts


def direction_summary(rows: DataFrame, directions: DataFrame, direction: str, score: Column, passed: Column, metrics: dict[str, Column]) -> DataFrame:
    """For each of directions, whether any row has it: rows, mean score, passes, and the mean of each metric; 0 without rows."""
    means = [F.avg(c.cast("double")).alias(n) for n, c in metrics.items()]
    found = rows.groupBy(direction).agg(F.count(F.lit(1)).alias("n"), F.avg(score.cast("double")).alias("mean"), F.sum(passed.cast("long")).alias("passes"), *means)
    return directions.join(found, direction, "left").fillna(0)


def on_off(on: DataFrame, off: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Both runs' values for each key that either has, and their difference."""
    both = on.select(*keys, F.col(value).alias("n_on")).join(off.select(*keys, F.col(value).alias("n_off")), keys, "full")
    return both.withColumn("delta", F.col("n_on") - F.col("n_off"))


def metric_means(rows: DataFrame, scores: str) -> DataFrame:
    """metric, n, mean of the maps `scores`; values that are no numbers do not count."""
    m = rows.select(F.explode(scores).alias("metric", "v")).withColumn("v", F.col("v").try_cast("double"))
    return m.filter("v is not null").groupBy("metric").agg(F.count(F.lit(1)).alias("n"), F.avg("v").alias("mean"))


def variant_metric_means(rows: DataFrame, scores: str, group: list[str] | None = None) -> DataFrame:
    """group, metric, n, mean of the variants `scores`, whose fields may differ by row: numbers and truth values count, by their own
    types; text that looks like a number does not, nor do nulls and nested values."""
    keys = group or []
    each = rows.select(*keys, F.explode(F.try_variant_get(F.col(scores), "$", "map<string,variant>")).alias("metric", "v"))
    kind = F.schema_of_variant("v")
    number = F.when(kind.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$"), F.try_variant_get("v", "$", "double")).when(kind == "BOOLEAN", F.try_variant_get("v", "$", "boolean").cast("double"))
    return each.select(*keys, "metric", number.alias("v")).filter("v is not null").groupBy(*keys, "metric").agg(F.count(F.lit(1)).alias("n"), F.avg("v").alias("mean"))


def accepted_answers(rows: DataFrame, prompt: str, answer: str) -> DataFrame:
    """prompt (normalised) and accepted: its distinct answers, sorted, parted by a bar."""
    each = rows.select(normalize(F.col(prompt)).alias("prompt"), F.col(answer).alias("a")).distinct()
    return each.groupBy("prompt").agg(F.array_join(F.sort_array(F.collect_list("a")), "|").alias("accepted"))


def sampled(rows: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """n distinct keys drawn by a hash of the seed; a report, so the limit is the feature."""
    return rows.select(key).distinct().orderBy(F.md5(F.concat(F.lit(str(seed)), F.col(key)).cast("binary"))).limit(n)


def size_summary(rows: DataFrame, groups: list[str], sizes: dict[str, Column]) -> DataFrame:
    """Least, middle (cut to a whole number) and greatest of each size by groups, and the number of rows."""
    parts = [x for n, c in sizes.items() for x in (F.min(c).alias(f"{n}_min"), F.median(c).cast("long").alias(f"{n}_median"), F.max(c).alias(f"{n}_max"))]
    return rows.groupBy(*groups).agg(F.count(F.lit(1)).alias("cases"), *parts)


def provider_summary(rows: DataFrame, label: Column, success: Column, sizes: dict[str, Column]) -> DataFrame:
    """By provider ("unknown" without a label): passed, total, pass_rate, and the sizes of prompts."""
    r = rows.withColumn("_label", F.coalesce(F.nullif(label, F.lit("")), F.lit("unknown"))).withColumn("_ok", F.coalesce(success, F.lit(False)).cast("long"))
    passed = r.groupBy("_label").agg(F.sum("_ok").alias("passed"), (F.sum("_ok") / F.count(F.lit(1))).alias("pass_rate"))
    return size_summary(r, ["_label"], sizes).join(passed, "_label").withColumnRenamed("_label", "provider").withColumnRenamed("cases", "total")


def markdown(summary: DataFrame, columns: list[str], most: int = 1000) -> str:
    """A table in Markdown of a summary, for reports that are read by people; one of over `most` rows is an error."""
    cell = lambda v: "" if v is None else f"{v:.3f}" if isinstance(v, float) else str(v)
    found = summary.select(*columns).orderBy(columns[0]).limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"a report of over {most} rows; write it with sinks.csv()")
    return "\n".join(f"| {' | '.join(r)} |" for r in [columns, ["---"] * len(columns), *[[cell(r[c]) for c in columns] for r in found]])


def paired_delta(base: DataFrame, candidate: DataFrame, keys: list[str], score: str, band: float = 0.025) -> DataFrame:
    d = base.select(*keys, F.col(score).alias("b")).join(candidate.select(*keys, F.col(score).alias("c")), keys).select((F.col("c") - F.col("b")).alias("d"))
    count = lambda x: F.coalesce(F.sum(x.cast("long")), F.lit(0).cast("long"))
    better, worse = F.col("d") > band, F.col("d") < -band
    return d.agg(F.count(F.lit(1)).alias("shared"), count(better).alias("improved"), count(worse).alias("worse"), count(~better & ~worse).alias("tie"), F.round(F.coalesce(F.avg("d"), F.lit(0.0)), 6).alias("mean_delta"))


def consistency(runs: DataFrame, keys: list[str], outcome: str) -> DataFrame:
    """Of cases that ran more than once: how many always, and not always, had one outcome."""
    each = runs.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.countDistinct(outcome).alias("k"))
    count = lambda x: F.sum(x.cast("long"))
    return each.agg(count((F.col("n") > 1) & (F.col("k") == 1)).alias("consistent"), count(F.col("k") > 1).alias("inconsistent"), F.count(F.lit(1)).alias("cases"))


def size_stats(rows: DataFrame, group: str, value: str) -> DataFrame:
    return rows.groupBy(group).agg(F.min(value).alias("least"), F.median(value).cast("long").alias("middle"), F.max(value).alias("most"))


def pass_rate(rows: DataFrame, group: str, passed: Column) -> DataFrame:
    """By group and over all (group null)."""
    return rows.rollup(group).agg(F.count(F.lit(1)).alias("n"), F.sum(passed.cast("long")).alias("passed"), F.round(F.avg(passed.cast("double")), 6).alias("rate"))


def unpivot_directions(triples: DataFrame, case: str, languages: list[tuple[str, str]]) -> DataFrame:
    """A row for each triple and direction; lexical where every text is one word."""
    one = F.lit(True)
    for n in sorted({x for pair in languages for x in pair}):
        one = one & (F.size(F.filter(F.split(F.col(n), r"(?U)\s+"), lambda w: w != "")) == 1)
    legs = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(f"{a}-to-{b}").alias("direction"), F.col(a).alias("input_text"), F.col(b).alias("reference_text")) for i, (a, b) in enumerate(languages)])
    d = triples.select(case, F.when(one, "lexical").otherwise("sentence").alias("row_type"), F.explode(legs).alias("l"))
    return d.select(case, "row_type", "l.direction", "l.input_text", "l.reference_text")
