"""Event table, streamed log that is written once, delivery, and model calls, with services that fail."""

import datetime as dt
import glob
import json
import time

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from glossweave.operators import analytics, clients, evals
from glossweave.plans import translate
from glossweave.sources import sinks
from glossweave.streaming.events import append_events


def events(spark, n=2000):
    base = F.lit(dt.datetime(2024, 1, 1)) + F.expr("make_interval(0, 0, 0, 0, 0, id * 3, 0)")
    return spark.range(n).select(
        base.alias("created_at"), F.when(F.col("id") % 3 > 0, F.concat(F.lit("v"), F.col("id") % 100)).alias("visitor_id"), F.when(F.col("id") % 50 == 7, "odd").otherwise("success").alias("status"), F.lit("x").alias("source_text"), F.lit("english").alias("source_language"),
        F.when(F.col("id") % 50 != 9, "georgian").alias("target_language"), F.when(F.col("id") % 50 == 11, "many").otherwise("7").alias("llm_call_ms"), F.create_map(F.lit("a"), F.col("id").cast("string")).alias("prompt_metrics"), F.lit(1).alias("extra"),
    )


def test_event_table(spark, tmp_path):
    path = str(tmp_path / "table")
    refused = {r["violation"]: r["count"] for r in sinks.insert_typed(events(spark), path).groupBy("violation").count().collect()}
    assert refused == {"status": 40, "target_language": 40, "llm_call_ms": 40}
    rows = spark.read.parquet(f"{path}/events")
    kinds = dict(x.split(" ") for x in sinks.EVENTS.split(", "))
    assert dict(rows.dtypes) == kinds | {"day": "date"} and rows.count() == 1880
    one = rows.orderBy("created_at").first()
    assert json.loads(one.prompt_metrics) == {"a": "0"} and one.used_llm is False and one.translation_path == "unknown" and len(one.id) == 36 and one.llm_call_ms == 7
    assert spark.read.parquet(f"{path}/visitors").count() == rows.filter("visitor_id is not null").count()
    want = {r.id for r in rows.filter("visitor_id = 'v31'").collect()}
    assert want and {r.id for r in sinks.visitor_events(spark, path, "v31").collect()} == want
    assert sinks.visitor_events(spark, path, "nobody").count() == 0
    # the index of a day: few row groups may have a visitor, by their statistics alone
    may = every = 0
    for f in glob.glob(f"{path}/visitors/day=*/*.parquet"):
        meta = pq.ParquetFile(f).metadata
        for i in range(meta.num_row_groups):
            c = next(c for c in map(meta.row_group(i).column, range(meta.num_columns)) if c.path_in_schema == "visitor_id")
            every, may = every + 1, may + (c.statistics.min <= "v31" <= c.statistics.max)
    days = {f.split("day=")[1][:10] for f in glob.glob(f"{path}/visitors/day=*/*.parquet")}
    assert may <= 2 * len(days) and every >= len(days)
    spark.conf.set("spark.sql.maxMetadataStringLength", 2000)
    plan = sinks.visitor_events(spark, path, "v31")._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "PartitionFilters: [isnotnull(day" in plan and "EqualTo(visitor_id,v31)" in plan and "GreaterThanOrEqual(created_at" in plan, plan


def test_bloom_filters(spark, tmp_path):
    sinks.insert_typed(events(spark, 200), str(tmp_path / "t"))
    f = glob.glob(f"{tmp_path}/t/events/day=*/*.parquet")[0]
    reader = spark._jvm.org.apache.parquet.hadoop.ParquetFileReader.open(spark._jvm.org.apache.parquet.hadoop.util.HadoopInputFile.fromPath(spark._jvm.org.apache.hadoop.fs.Path(f), spark._jsc.hadoopConfiguration()))
    columns = {c.getPath().toDotString(): c.getBloomFilterOffset() for c in reader.getFooter().getBlocks()[0].getColumns()}
    reader.close()
    assert columns["visitor_id"] > 0 >= columns["source_text"]


def test_stream_writes_once(spark, tmp_path):
    """A failure between a batch's write and its commit: the batch runs again and writes nothing twice."""
    source, log, at = (str(tmp_path / x) for x in ("in", "log", "checkpoint"))
    rows = spark.range(30).select("id", F.lit(dt.datetime(2024, 5, 5)).alias("ts"))
    rows.repartition(3).write.parquet(source)
    ran = []

    def after(batch, n):
        ran.append(n)
        if len(ran) == 2:
            raise RuntimeError("lost after the write")

    with pytest.raises(Exception, match="lost after the write"):
        append_events(spark, source, rows.schema, log, at, files=1, after=after)
    before = {f: pq.ParquetFile(f).metadata.num_rows for f in glob.glob(f"{log}/source=log/batch=1/*/*.parquet")}
    got = append_events(spark, source, rows.schema, log, at, files=1, after=after)
    assert ran == [0, 1, 1, 2] and sorted(r.id for r in got.collect()) == list(range(30))
    assert {f: pq.ParquetFile(f).metadata.num_rows for f in glob.glob(f"{log}/source=log/batch=1/*/*.parquet")} == before
    # nothing new, nothing written; a batch that was cut short is written anew
    assert append_events(spark, source, rows.schema, log, at, files=1).count() == 30


def test_delivery_with_time_limit(spark, tmp_path):
    out = str(tmp_path)

    def sender():
        def send(payload):
            n = json.loads(payload)["id"]
            if n == 2:
                raise OSError("refused")
            if n == 3:
                time.sleep(20)
            with open(f"{out}/{n}", "w") as f:
                f.write(payload)

        return send

    began = time.time()
    sinks.deliver(spark.range(6, numPartitions=1), sender, seconds=0.5)
    assert sorted(p.rpartition("/")[2] for p in glob.glob(f"{out}/*")) == ["0", "1", "4", "5"] and time.time() - began < 18


def counting(folder):
    """A service that keeps a file for each call, and fails at the first try of every prompt that ends in 1."""

    def ask(provider, model):
        def send(prompt):
            name = f"{folder}/{provider}-{model}-{prompt}"
            with open(name, "a") as f:
                f.write(".")
            if prompt.endswith("x") or prompt.endswith("1") and len(open(name).read()) == 1:
                raise OSError("busy")
            return f"{model}:{prompt}"

        return send

    return ask


def test_each_prompt_once(spark, tmp_path):
    folder = str(tmp_path)
    rows = spark.range(3000).select("id", F.when(F.col("id") % 10 != 3, F.concat(F.lit("p"), F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 20))).alias("q"), F.lit("a").alias("provider"), (F.col("id") % 2).cast("string").alias("model")).repartition(5)
    out = clients.ask_once(rows.unionByName(spark.createDataFrame([(-1, "px", "b", "9")], rows.schema)), "q", counting(folder), limits=clients.Limits(4, 3, 0.01))
    got = {r.id: r for r in out.collect()}
    out.count()
    assert len(got) == 3001 and all((r.response == f"{r.model}:{r.q}") if r.q and r.id >= 0 else r.response is None for r in got.values())
    pairs = {(r.model, r.q) for r in got.values() if r.q and r.id >= 0}
    calls = {p.rpartition("/")[2]: len(open(p).read()) for p in glob.glob(f"{folder}/*")}
    assert calls.pop("b-9-px") == 3 and got[-1].response_error == "OSError: busy" and got[-1].tries == 3
    assert calls == {f"a-{m}-{q}": 2 if q.endswith("1") else 1 for m, q in pairs}


def test_rubric(spark):
    def ask(provider, model):
        return lambda prompt: {"a": '{"pass": true, "score": 3}', "b": "{bad", "c": 'x {"pass": false, "score": 0.95, "reason": "no"} y', "d": '{"pass": true}', "e": '{"score": "NaN"}'}[prompt.partition("<output>\n")[2][0]]

    rows = spark.createDataFrame([(x, "p", "m") for x in [*"abcde", None]], "output string, provider string, model string")
    got = {r.output: (r.score, r["pass"], r.reason) for r in evals.rubric(rows, "i", "output", ask, 0.8, ["provider"]).collect()}
    assert got == {"a": (1.0, True, None), "b": (None, False, "no verdict"), "c": (0.95, False, "no"), "d": (1.0, True, None), "e": (None, False, "no verdict"), None: (None, False, None)}


def test_from_request_to_event_table(spark, tmp_path):
    """Requests are translated, each with its own provider and a bridge, and what the routes tell fills the event table."""
    lexicon = spark.createDataFrame([(1, "english", "mingrelian", "water", "წყარი", "pairs"), (2, "english", "mingrelian", "sun", "ბჟა", "pairs"), (3, "english", "mingrelian", "sun", "ბჟა2", "kk")], "row_id long, source string, target string, source_text string, target_text string, source_name string")
    memory = spark.createDataFrame([("english", "georgian", "hello", "გამარჯობა")], "source string, target string, source_text string, target_text string")
    requests = spark.createDataFrame([(1, "Water", "english", "mingrelian", "p1", "m1"), (2, "sun", "english", "mingrelian", "p1", "m1"), (3, "hello", "english", "georgian", "p2", "m2"), (4, "moon", "english", "mingrelian", "p2", "m2"), (5, "odd", "english", "mingrelian", "p2", "m2"), (6, "x", "english", "russian", "p2", "m2")], "request_id long, input_text string, source string, target string, provider string, model string")
    bridge = lambda r: r.filter("input_text = 'moon'").select("request_id", F.lit("თუთა").alias("answer"))
    ask = lambda provider, model: lambda prompt: f"<<<TRANSLATION>>>\n{provider} {model}\n<<<END_TRANSLATION>>>"
    entry = lambda words: words.select("word", F.concat(F.lit("\n"), "word", F.lit(": an entry\n")).alias("output"))
    out = translate.translate(requests, lexicon, bridge, memory, entry, "Endings follow stems.", policy="compact", ask=ask).join(requests, "request_id")
    rows = out.withColumnsRenamed({"input_text": "source_text", "translation": "target_text", "source": "source_language", "target": "target_language"})
    e = {r.source_text: r for r in analytics.event(rows).collect()}
    assert {k: (r.response_source, r.translation_path, r.used_llm, r.exact_candidate_count) for k, r in e.items()} == {
        "Water": ("exact_lexicon", "exact_lexicon", False, 1), "sun": ("llm", "llm_evidence_bundle", True, 2), "hello": ("google_translate_direct", "google_translate_direct", False, None),
        "moon": ("dictionary_google_bridge", "dictionary_google_bridge", False, 0), "odd": ("llm", "llm_evidence_bundle", True, 0), "x": ("unsupported", "unsupported", False, None),
    }
    assert e["sun"].used_exact_candidate_shortlist and e["odd"].used_dictionary_entries and e["odd"].target_text == "p2 m2" and e["odd"].prompt_characters > 0 and e["odd"].prompt_metrics["grammar_policy"] == "compact"
    assert sinks.insert_typed(analytics.event(rows), str(tmp_path / "t")).count() == 0
    assert spark.read.parquet(f"{tmp_path}/t/events").filter("used_llm").count() == 2
