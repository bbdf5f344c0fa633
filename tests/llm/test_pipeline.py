"""Each stage of the corpus pipeline on the smallest tables, against a plain version that starts from the same rows."""

import collections
import zlib

import numpy as np
import public_tokenizers as P
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as pipeline
from glossweave.llm import langid, quality
from tests.llm.test_llm import SF, brute_components


def test_stages(spark, tmp_path):
    stages, docs = dict(pipeline.STAGES), spark.read.parquet(f"{SF}/documents.parquet")
    columns, held = docs.columns, {}

    def step(name, docs):
        out = stages[name](spark, docs, SF)
        out.write.parquet(str(tmp_path / name))
        held[name] = spark.read.parquet(str(tmp_path / name))
        return held[name]

    ids = lambda d: sorted(r.doc_id for r in d.select("doc_id").collect())

    good = step("quality_rules", docs)
    assert good.columns == columns
    assert ids(good) == ids(quality.quality_rules(docs, spark.read.parquet(f"{SF}/labels.parquet")).filter("kept"))

    known = step("language_id", good)
    scores = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(good, good.filter(~langid.held_out())).collect()}
    assert known.columns == columns and ids(known) == sorted(k for k, (lang, p) in scores.items() if lang != "und" and p >= pipeline.LEAST_SCORE)

    single = step("near_dedup", known)
    rows = [(r.doc_id, r.text) for r in known.collect()]
    assert single.columns == columns and ids(single) == sorted({c for _, c in brute_components(rows, 80).values()})

    pieces, t = collections.defaultdict(list), Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    for r in step("packing", single).collect():
        pieces[r.doc_id].append(r)
    for r in single.collect():
        want, at = np.array([*t.encode(r.text or "", add_special_tokens=False).ids, 0], "<u4"), 0
        for p in sorted(pieces.pop(r.doc_id), key=lambda p: p.start):
            assert (p.start, p.doc_tokens, p.ids_crc32) == (at, len(want), zlib.crc32(want[at : at + p.length].tobytes()))
            at += p.length
        assert at == len(want)
    assert not pieces


def test_no_rows_and_odd_rows(spark):
    schema = spark.read.parquet(f"{SF}/documents.parquet").schema
    text = "a plain line of words that goes on for a while so that every rule of the base has enough of them to be content with it"
    odd = spark.createDataFrame([(None, text, "en", None, None), (1, None, None, None, None), (2, "", "en", "s", 0), (3, text, "en", "s", 1), (3, text, "en", "s", 1)], schema)
    for name, stage in pipeline.STAGES:
        assert stage(spark, spark.createDataFrame([], schema), SF).count() == 0, name
    # the row without an id is a copy of row 3, which stays once
    assert sorted(r.doc_id for r in pipeline.dedup_stage(spark, odd, SF).collect()) == [1, 2, 3]
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    assert sum(r.length for r in pipeline.packing_stage(spark, odd, SF).collect()) == sum(len(t.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in odd.collect())


def test_near_copies_without_ids_and_texts_that_share_one(spark):
    words = [f"w{i}" for i in range(60)]
    a, b, c = " ".join(words), " ".join(words[:59]), " ".join(reversed(words))
    rows = [(None, a), (None, b), (None, b), (7, c), (7, "another text under the same id, which is no copy"), (8, c), (5, c + " end"), (None, "alone without an id but with some words")]
    got = pipeline.dedup_stage(spark, spark.createDataFrame(rows, "doc_id long, text string"), SF).collect()
    assert sorted((r.doc_id or 0, r.text) for r in got if r.text not in (a, b)) == [(0, "alone without an id but with some words"), (5, c + " end"), (7, "another text under the same id, which is no copy")]
    assert len([r for r in got if r.text in (a, b)]) == 1 and len(got) == 4


def test_extra_columns_of_clashing_names(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    extra = ["score", "lang_pred", "_key", "_id", "text_hash", "_n", "stratum", "kept", "_row", "component_id", "node", "_salt", "held_out", "_t"]
    for i, c in enumerate(extra):
        docs = docs.withColumn(c, F.lit(i))
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        rows = out.collect()
        assert out.columns == docs.columns and rows, name
        assert all(r[c] == i for r in rows for i, c in enumerate(extra)), name
    assert pipeline.packing_stage(spark, docs, SF).count() > 0
