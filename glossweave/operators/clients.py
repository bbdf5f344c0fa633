"""Outside services as operators: a model that completes prompts, and machine translation as a table."""

from __future__ import annotations

import random
import time
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from glossweave.functions.extract import CLOSE, OPEN
from glossweave.functions.prompts import FINAL
from glossweave.functions.text import normalize
from glossweave.sources.shared import stored

#: complete(prompts) gives a response for each prompt.
Complete = Callable[[list[str]], list[str]]


def offline() -> Complete:
    """Echoes the sentence of the prompt in a marked block; stands in for a model where there is no network."""

    def answer(prompt: str) -> str:
        sentence = prompt.rpartition(f'{FINAL} "')[2].partition('" from ')[0]
        return f"{OPEN}\n{sentence}\n{CLOSE}"

    return lambda prompts: [answer(p) for p in prompts]


def complete(rows: DataFrame, prompt: str, client: Callable[[], Complete] = offline) -> DataFrame:
    """rows with response and llm_call_ms (of the row's share of its call); a null prompt is not sent and gives nulls.

    client is called once in each task, on the executor, so credentials are resolved there and never travel. A task that is
    tried again sends its prompts again.
    """
    schema = StructType([*rows.schema.fields, StructField("response", StringType()), StructField("llm_call_ms", LongType())])

    def run(batches):
        send = None
        for b in batches:
            some = b[prompt].notna()
            texts = b.loc[some, prompt].tolist()
            began, answers = time.time(), []
            if texts:
                send = send or client()
                answers = send(texts)
            b["response"] = None
            b["llm_call_ms"] = None
            if texts:
                b.loc[some, "response"] = answers
                b.loc[some, "llm_call_ms"] = int((time.time() - began) * 1000 / len(texts))
            b["llm_call_ms"] = b["llm_call_ms"].astype("Int64")
            yield b

    return rows.mapInPandas(run, schema)


@dataclass(frozen=True)
class Limits:
    """How a task calls a service: so many calls at once, so many tries of each, and seconds before the second try, doubled for each
    later one, with up to half as much again at random."""

    at_once: int = 4
    tries: int = 3
    wait: float = 0.5


#: ask(provider, model) gives what answers one prompt; it is called once in a task for each provider and model.
Ask = Callable[[str, str], Callable[[str], str]]


def _tried(send: Callable[[str], str], prompt: str, limits: Limits) -> tuple[str | None, str | None, int, int]:
    """(answer, error, tries, milliseconds of the last try)."""
    for i in range(1, limits.tries + 1):
        began = time.time()
        try:
            answer, error = send(prompt), None
        except Exception as e:  # noqa: BLE001
            answer, error = None, f"{type(e).__name__}: {e}"
        took = int((time.time() - began) * 1000)
        if error is None or i == limits.tries:
            return answer, error, i, took
        time.sleep(limits.wait * 2 ** (i - 1) * (1 + random.random() / 2))
    raise ValueError("no tries")


def ask_once(rows: DataFrame, prompt: str, ask: Ask, provider: str = "provider", model: str = "model", limits: Limits = Limits()) -> DataFrame:
    """rows with response, response_error, tries and llm_call_ms: each distinct (provider, model, prompt) is sent once, whatever
    rows ask it, and answers are kept in a table before rows meet them by hash, so that no later read sends anything again.

    Provider and model are columns of rows. A null prompt is not sent and gives nulls; so does a call that fails at every try, but
    for its error. Equal prompts are one row a task before they are shuffled. A task that is tried again sends its prompts again.
    """
    key = F.sha2(F.to_json(F.struct(F.col(provider).alias("p"), F.col(model).alias("m"), F.col(prompt).alias("q"))), 256)
    keyed = rows.withColumn("_key", F.when(F.col(prompt).isNotNull(), key))
    asked = keyed.filter("_key is not null").select("_key", F.col(provider).alias("_p"), F.col(model).alias("_m"), F.col(prompt).alias("_q")).dropDuplicates(["_key"])

    def run(batches):
        known: dict[tuple, Callable[[str], str]] = {}
        with ThreadPoolExecutor(limits.at_once) as pool:
            for b in batches:
                for pair in {*zip(b["_p"], b["_m"], strict=True)} - known.keys():
                    known[pair] = ask(*pair)
                sent = [pool.submit(_tried, known[p, m], q, limits) for p, m, q in zip(b["_p"], b["_m"], b["_q"], strict=True)]
                done = [x.result() for x in sent]
                out = b[["_key"]].copy()
                for i, name in enumerate(("response", "response_error", "tries", "llm_call_ms")):
                    out[name] = [x[i] for x in done]
                yield out

    answers = stored(asked.mapInPandas(run, "_key string, response string, response_error string, tries int, llm_call_ms long"), "answers")
    return keyed.join(answers, "_key", "left").drop("_key")


def machine_translate(requests: DataFrame, memory: DataFrame) -> DataFrame:
    """requests (input_text, source, target, ...) with mt_text from memory (source, target, source_text, target_text).

    Null where the memory has no row, as if the service were away. Of several rows for a text the least target_text counts.
    """
    known = memory.select("source", "target", normalize(F.col("source_text")).alias("_k"), "target_text").groupBy("source", "target", "_k").agg(F.min("target_text").alias("mt_text"))
    return requests.withColumn("_k", normalize(F.col("input_text"))).join(known, ["source", "target", "_k"], "left").drop("_k")
