"""Requests to the translator: validation, model names, and the older shape of answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossweave.functions.text import script_counts, strip_space

#: The languages that are translated.
LANGUAGES = ["mingrelian", "georgian", "english"]


def reject_reason(rows: DataFrame, providers: list[str]) -> Column:
    """Why a request (prompt, provider, source_language, target_language) is refused, the first reason that holds; null if none.
    A null provider stands for the default one."""
    known = lambda c: F.coalesce(F.col(c).isin(LANGUAGES), F.lit(False))
    reason = F.when(strip_space(F.coalesce("prompt", F.lit(""))) == "", "empty_prompt")
    reason = reason.when((F.coalesce("provider", F.lit("")) != "") & ~F.col("provider").isin(providers), "unknown_provider")
    return reason.when(~known("source_language"), "source_language").when(~known("target_language"), "target_language").when(F.col("source_language") == F.col("target_language"), "same_language")


def resolve_models(rows: DataFrame, defaults: DataFrame, aliases: DataFrame, allowed: DataFrame) -> DataFrame:
    """rows (provider, model, ...) with model resolved and server_key_allowed.

    An empty model becomes its provider's default (provider, default_model); a retired name its present one (provider, alias,
    current); allowed (provider, allowed_model) names the models that the server's own key may call. Each is a table of the
    configuration, with a row for a name.
    """
    out = rows.join(defaults.select("provider", "default_model"), "provider", "left")
    out = out.withColumn("model", F.coalesce(F.nullif("model", F.lit("")), "default_model")).drop("default_model")
    out = out.join(aliases.select("provider", F.col("alias").alias("model"), "current"), ["provider", "model"], "left")
    out = out.withColumn("model", F.coalesce("current", "model")).drop("current")
    some = allowed.select("provider", F.col("allowed_model").alias("model"), F.lit(True).alias("server_key_allowed")).distinct()
    return out.join(some, ["provider", "model"], "left").withColumn("server_key_allowed", F.coalesce("server_key_allowed", F.lit(False)))


def legacy(source: Column, target: Column, text: Column, translation: Column, response: Column) -> list[Column]:
    """The older answer's columns: each text under its language; Mingrelian by its script, that of the translation where that is
    the Mingrelian side. A field that does not apply is empty."""
    own = F.when(source == "mingrelian", text).when(target == "mingrelian", translation)
    other = {x: F.when(source == x, text).when(target == x, translation) for x in ("georgian", "english")}
    # two languages that are not Mingrelian must be these two
    plain = (source == "mingrelian") | (target == "mingrelian") | source.isin("georgian", "english")
    mkhedruli = script_counts(own)["mkhedruli"] > 0
    filled = lambda c: F.coalesce(F.when(plain, c), F.lit(""))
    return [
        text.alias("source_text"), translation.alias("target_text"), source.alias("source_language"), target.alias("target_language"), filled(F.when(~mkhedruli, own)).alias("mingrelian_latinized"),
        filled(F.when(mkhedruli, own)).alias("mingrelian_mkhedruli"), filled(other["georgian"]).alias("georgian"), filled(other["english"]).alias("english"), response.alias("full_response"),
    ]
