"""Writers: CSV in fixed column order, JSON lines, the event table, and delivery of events to a service."""

from __future__ import annotations

import logging
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glossweave.sources.shared import stored


def csv(df: DataFrame, path: str, columns: list[str], single: bool = False) -> None:
    """CSV with a header and the columns in this order. Null and empty both become an empty cell; quotes are doubled.

    single gives one file for small exports; otherwise each partition writes its own.
    """
    out = df.select(*columns)
    out = out.coalesce(1) if single else out
    out.write.mode("overwrite").option("header", True).option("escape", '"').option("nullValue", "").option("emptyValue", "").csv(path)


def json(df: DataFrame, path: str, single: bool = False) -> None:
    """JSON lines, null fields kept."""
    (df.coalesce(1) if single else df).write.mode("overwrite").option("ignoreNullFields", False).json(path)


#: The event table's columns, those that may not be null, and defaults.
EVENTS = (
    "id string, created_at timestamp, visitor_id string, status string, source_text string, target_text string, source_language string, target_language string, provider string, model string, "
    "response_source string, translation_path string, used_llm boolean, used_evidence_bundle boolean, used_dictionary_entries boolean, used_grammar boolean, used_exact_candidate_shortlist boolean, "
    "exact_candidate_count int, prompt_characters int, dictionary_entries_characters int, grammar_characters int, llm_call_ms int, duration_ms int, source_text_length int, target_text_length int, "
    "used_user_api_key boolean, prompt_metrics string, error_message string, app_origin string, referer string, user_agent string"
)
REQUIRED = ["status", "source_text", "source_language", "target_language"]
DEFAULTS = {"response_source": "unknown", "translation_path": "unknown", "source_text_length": 0, "prompt_metrics": "{}"}
STATUSES = ["success", "error"]


def typed_events(events: DataFrame) -> DataFrame:
    """events as the table has them: every column of EVENTS in its type, defaults filled (id, created_at and false flags too), a map of
    metrics as JSON; and `violation`: the first column, by the table's order, that may not be so, null for a row that the table takes."""
    kinds, have = dict(x.split(" ") for x in EVENTS.split(", ")), dict(events.dtypes)

    def column(name: str, kind: str) -> Column:
        c = F.col(name) if name in have else F.lit(None)
        if name in have and have[name].startswith(("map", "struct")):
            c = F.to_json(c)
        c = c.try_cast(kind) if name in have else c.cast(kind)
        fill = {"id": F.expr("uuid()"), "created_at": F.current_timestamp()}.get(name, F.lit(DEFAULTS.get(name, False if kind == "boolean" else None)))
        return F.coalesce(c, fill.cast(kind)).alias(name)

    # a value that its type cannot hold is no default
    wrong = [F.when(F.col(n).isNotNull() & F.col(n).try_cast(k).isNull(), F.lit(n)) for n, k in kinds.items() if n in have and have[n] != k and not have[n].startswith(("map", "struct"))]
    missing = [F.when(F.col(n).isNull() if n in have else F.lit(True), F.lit(n)) for n in REQUIRED]
    status = F.when(F.col("status").isin(STATUSES), F.lit(None)).otherwise("status") if "status" in have else F.lit("status")
    return events.select(*[column(n, k) for n, k in kinds.items()], F.coalesce(*missing, status, *wrong).alias("violation"))


def _clustered(rows: DataFrame, by: list[Column | str], bloom: list[str], path: str, mode: str) -> None:
    out = rows.repartitionByRange(*by).sortWithinPartitions(*by).write.mode(mode).partitionBy("day")
    for c in bloom:
        # a column that is a dictionary as a whole gets no filter
        out = out.option(f"parquet.bloom.filter.enabled#{c}", "true").option(f"parquet.enable.dictionary#{c}", "false")
    out.parquet(path)


def insert_typed(events: DataFrame, path: str, mode: str = "append") -> DataFrame:
    """Appends the accepted rows of events to the event table under path; returns the refused ones with their violation.

    path/events has a folder for each day, rows in order of created_at, so that times are read by file and row-group statistics, and
    Bloom filters of visitor_id; columns of few values, such as translation_path, are filtered by their dictionaries. path/visitors is the index of rows with a visitor, in order of (visitor_id,
    newest first): a visitor's rows lie in one run of few row groups.
    """
    rows = stored(typed_events(events).withColumn("day", F.to_date("created_at")), "events")
    good = rows.filter("violation is null").drop("violation")
    _clustered(good, ["day", "created_at"], ["visitor_id"], f"{path}/events", mode)
    _clustered(good.filter("visitor_id is not null").select("visitor_id", "created_at", "id", "day"), ["day", "visitor_id", F.desc("created_at")], ["visitor_id"], f"{path}/visitors", mode)
    return rows.filter("violation is not null").drop("day")


def visitor_events(spark: SparkSession, path: str, visitor: str) -> DataFrame:
    """A visitor's events, newest first by the index: only days that the index names are read, and of these the row groups whose times and
    Bloom filters may have the visitor."""
    index = spark.read.parquet(f"{path}/visitors").filter(F.col("visitor_id") == visitor)
    span = index.agg(F.min("created_at").alias("low"), F.max("created_at").alias("high"), F.min("day").alias("first"), F.max("day").alias("last")).first()
    rows = spark.read.parquet(f"{path}/events").filter(F.col("visitor_id") == visitor)
    if span["low"] is None:
        return rows.filter("false")
    return rows.filter(F.col("day").between(F.lit(span["first"]), F.lit(span["last"])) & F.col("created_at").between(F.lit(span["low"]), F.lit(span["high"])))


def check_events(events: DataFrame) -> DataFrame:
    """events with the table's defaults filled and `violation` (null for a row that the table accepts)."""
    filled = {"response_source": "unknown", "translation_path": "unknown", "source_text_length": 0, "used_llm": False, "used_evidence_bundle": False, "used_user_api_key": False}
    out = events.fillna({k: v for k, v in filled.items() if k in events.columns})
    missing = [F.when(F.col(c).isNull(), F.lit(c)) for c in ("source_text", "source_language", "target_language") if c in events.columns]
    bad = F.when(F.coalesce(F.col("status").isin("success", "error"), F.lit(False)), F.lit(None)).otherwise("status")
    return out.withColumn("violation", F.coalesce(*missing, bad))


def insert_events(events: DataFrame, path: str, at: str = "created_at") -> DataFrame:
    """Appends the accepted rows of events to the table at path, a folder for each day; returns the refused rows."""
    checked = check_events(events)
    checked.filter("violation is null").drop("violation").withColumn("day", F.to_date(at)).write.mode("append").partitionBy("day").parquet(path)
    return checked.filter("violation is not null")


def deliver(events: DataFrame, sender: Callable[[], Callable[[str], None]], seconds: float = 2.5) -> None:
    """Sends each row as JSON, best effort: a failure, or a call that takes longer than so many seconds, is logged and the next row
    follows. sender() is called once a task, and again after a call that was left behind."""

    def run(rows):
        pool, send = ThreadPoolExecutor(1), sender()
        for row in rows:
            try:
                pool.submit(send, row.payload).result(timeout=seconds)
            except Exception as e:  # noqa: BLE001
                logging.getLogger(__name__).warning("event not delivered: %s", e or type(e).__name__)
                if isinstance(e, TimeoutError):
                    # the call that hangs keeps its thread; others do not wait for it
                    pool.shutdown(wait=False)
                    pool, send = ThreadPoolExecutor(1), sender()
        pool.shutdown(wait=False)

    events.select(F.to_json(F.struct(*events.columns)).alias("payload")).foreachPartition(run)
