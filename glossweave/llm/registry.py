"""The queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from glossweave.llm import ann, exact_dedup, html_text, importance, katz, langid, merge_dropout, neardup, packing, quality, sharding, token_files, variants
from glossweave.llm.common import table


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_token_files": lambda s, d: token_files.token_files(table(s, d, "documents"), public_tokenizers.path("word_bpe_49k.json")),
        "op2_near_duplicates": lambda s, d: neardup.near_duplicates(table(s, d, "documents"), 85),
        "op3_merge_dropout": lambda s, d: merge_dropout.round_trip(table(s, d, "documents"), public_tokenizers.path("piece_bpe_32k.model")),
        "op4_language_id": lambda s, d: langid.language_id(table(s, d, "documents")),
        "op5_quality_rules": lambda s, d: quality.quality_rules(table(s, d, "documents"), table(s, d, "labels")),
        "op6_html_text": lambda s, d: html_text.extract(table(s, d, "pages")),
        "op7_packing": lambda s, d: packing.pack(table(s, d, "documents"), public_tokenizers.path("byte_bpe_50k.json")),
        "op8_sharding": lambda s, d: sharding.shard_documents(table(s, d, "documents")),
        "op9_katz_lm": lambda s, d: katz.score(table(s, d, "documents")),
        "op10_nearest": lambda s, d: ann.nearest(table(s, d, "embeddings")),
        "op11_spelling_variants": lambda s, d: variants.group_variants(table(s, d, "documents")),
        "op12_importance": lambda s, d: importance.resample(table(s, d, "documents"), table(s, d, "benchmark")),
        "op13_exact_dedup": lambda s, d: exact_dedup.deduplicate(s, f"{d}/documents.parquet"),
    }


def oracle_sql() -> dict[str, str]:
    return {"op5_quality_rules": quality.sql(), "op11_spelling_variants": variants.sql(), "op12_importance": importance.sql(), "op13_exact_dedup": exact_dedup.sql()}
