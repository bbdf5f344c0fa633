"""Readers of dictionaries and evaluation files. File order is kept as row_id; a missing file gives no rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glossweave.functions.text import compact, normalize
from glossweave.operators.lookup import ranked
from glossweave.sources.shared import stored

KAIKKI = "lang_code string, pos string, word string, forms array<struct<form:string,tags:array<string>>>, senses array<struct<glosses:array<string>>>, _corrupt string"


def _status(spark: SparkSession, path: str):
    """The status of a file or folder in whatever store holds it; None if there is none."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = at.getFileSystem(spark._jsc.hadoopConfiguration())
    return store.getFileStatus(at) if store.exists(at) else None


def exists(spark: SparkSession, path: str) -> bool:
    return _status(spark, path) is not None


def resolve(spark: SparkSession, name: str, folders: list[str]) -> str:
    """The path of name in the first of folders that holds it, else in the last."""
    paths = [f"{f.rstrip('/')}/{name}" for f in folders]
    return next((p for p in paths if _status(spark, p)), paths[-1])


def source_key(spark: SparkSession, path: str) -> tuple[str, int | None]:
    """What a table read from path can be cached by: the path and its time of change in milliseconds, None if it is missing."""
    status = _status(spark, path)
    return path, status.getModificationTime() if status else None


def numbered(rows: DataFrame) -> DataFrame:
    """rows of a file scan with row_id: their number in order of file, place of the split and line, from 0 without gaps.

    Lines are counted inside each split; one row for each split is summed up to the splits' first numbers.
    """
    # rows of a split come in their order, within one task
    at = rows.select("*", F.col("_metadata.file_path").alias("_f"), F.col("_metadata.file_block_start").alias("_b")).withColumn("_m", F.monotonically_increasing_id())
    ends = at.groupBy("_f", "_b").agg(F.min("_m").alias("_low"), F.count(F.lit(1)).alias("_n"))
    w = Window.orderBy("_f", "_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = ends.select("_f", "_b", (F.coalesce(F.sum("_n").over(w), F.lit(0)) - F.col("_low")).alias("_s"))
    return at.join(starts, ["_f", "_b"]).withColumn("row_id", F.col("_m") + F.col("_s")).select("row_id", *rows.columns)


def lines(spark: SparkSession, path: str) -> DataFrame:
    """row_id, value of a text file or folder, read split by split; a missing one has no rows. A line that holds another of
    Unicode's line breaks is several rows with one row_id, which `part` orders."""
    if not _status(spark, path):
        return spark.createDataFrame([], "row_id long, part int, value string")
    return numbered(spark.read.text(path)).select("row_id", F.posexplode(F.split("value", "[\x0b\x0c\x1c-\x1e\x85\u2028\u2029]")).alias("part", "value"))


def is_header(cells: Column, header: list[str]) -> Column:
    same = F.lit(True)
    for i, name in enumerate(header):
        same = same & (normalize(F.regexp_replace(F.get(cells, F.lit(i)), "﻿", "")) == name)
    return same


def tsv(spark: SparkSession, path: str, columns: list[str], required: list[str], header: list[str], header_first_only: bool = False) -> DataFrame:
    """row_id, part and columns: tab-parted, trimmed, no quoting; rows with too few cells, header rows and rows with an empty
    required cell go. header_first_only: a header is one only if it is the first row that has enough cells."""
    cells = lines(spark, path).select("row_id", "part", F.transform(F.split("value", "\t"), compact_edges).alias("c")).filter(F.size("c") >= len(columns))
    drop = is_header(F.col("c"), header)
    if header_first_only:
        # without an order key on the others: one least value, not a sorted table
        first = cells.agg(F.min(F.struct("row_id", "part")).alias("first"))
        cells = cells.join(F.broadcast(first), F.struct("row_id", "part") == F.col("first"), "left")
        drop = drop & F.col("first").isNotNull()
    named = cells.filter(~drop).select("row_id", "part", *[F.get("c", F.lit(i)).alias(n) for i, n in enumerate(columns)])
    for n in required:
        named = named.filter(F.col(n) != "")
    return named


def compact_edges(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def sentence_pairs(spark: SparkSession, path: str) -> DataFrame:
    return tsv(spark, path, ["mingrelian", "english"], ["mingrelian", "english"], ["mingrelian", "english"])


def russian_dictionary(spark: SparkSession, path: str) -> DataFrame:
    return tsv(spark, path, ["russian", "mingrelian"], ["russian", "mingrelian"], ["russian", "mingrelian"], True)


def four_column_dictionary(spark: SparkSession, path: str) -> DataFrame:
    return tsv(spark, path, ["mingrelian", "ipa", "russian", "georgian"], ["mingrelian", "russian", "georgian"], ["word", "ipa", "russian_def", "georgian_def"], True)


def overrides(spark: SparkSession, path: str) -> DataFrame:
    names = ["source_language", "target_language", "source_text", "target_text"]
    return tsv(spark, path, names, names, names)


def blocks(text: Column) -> Column:
    """Paragraphs: parts between blank lines, trimmed, empty ones gone."""
    return F.filter(F.transform(F.split(compact_edges(text), r"\n\s*\n"), compact_edges), lambda x: x != "")


def context_entries(spark: SparkSession, path: str) -> DataFrame:
    """row_id, entry: the paragraphs of a text file or folder, read split by split as one text; a missing one has none.

    Blank lines are counted in each split, and one row for each split is summed up to how many come before it: lines between
    the same blank lines are one paragraph, also where a split ends inside it. Only a paragraph is gathered.
    """
    if not _status(spark, path):
        return spark.createDataFrame([], "row_id long, entry string")
    at = spark.read.text(path, lineSep="\n").select("value", F.col("_metadata.file_path").alias("_f"), F.col("_metadata.file_block_start").alias("_b")).withColumn("_m", F.monotonically_increasing_id())
    at = stored(at.withColumn("_blank", F.col("value").rlike(r"^\s*$").cast("long")), "lines")
    in_split = Window.partitionBy("_f", "_b").orderBy("_m")
    ends = at.groupBy("_f", "_b").agg(F.sum("_blank").alias("_n"))
    earlier = Window.orderBy("_f", "_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = ends.select("_f", "_b", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_s"))
    island = at.withColumn("_i", F.sum("_blank").over(in_split)).join(starts, ["_f", "_b"]).filter("_blank = 0")
    lines_of = F.sort_array(F.collect_list(F.struct("_f", "_b", "_m", "value")))
    whole = island.groupBy((F.col("_i") + F.col("_s")).alias("_p")).agg(compact_edges(F.array_join(F.transform(lines_of, lambda x: x["value"]), "\n")).alias("entry"))
    return ranked(whole.filter("entry != ''"), ["_p"], "_n").select((F.col("_n") - 1).alias("row_id"), "entry")


def table(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """row_id and names (strings) of a CSV file with a header, quoted as usual; a column that the file lacks is null, a missing
    file has no rows. A quoted cell may hold line breaks, so a file is read by one task."""
    if not _status(spark, path):
        return spark.createDataFrame([], T.StructType([T.StructField("row_id", T.LongType()), *[T.StructField(n, T.StringType()) for n in names]]))
    read = spark.read.csv(path, header=True, multiLine=True, escape='"')
    return numbered(read.select(*[F.col(f"`{n}`") if n in read.columns else F.lit(None).cast("string").alias(n) for n in names]))


def master_lexicon(spark: SparkSession, path: str, enabled: bool = True) -> DataFrame:
    """row_id, headword, headword_raw, translation: a translation and one headword are needed; not enabled: no rows."""
    names = ["headword", "headword_raw", "translation"]
    d = table(spark, path, names).select("row_id", *[compact(F.col(n)).alias(n) for n in names])
    return d.filter(F.lit(enabled) & (F.col("translation") != "") & ((F.col("headword") != "") | (F.col("headword_raw") != "")))


EVAL_COLUMNS = [
    "case_id", "direction", "source_language", "target_language", "input_text", "reference_text", "row_type", "english", "georgian", "mingrelian",
    "acceptable_target_variants", "acceptable_mingrelian_variants", "source_page", "confidence", "notes", "mingrelian_source_transcription",
]


def eval_cases(spark: SparkSession, path: str) -> DataFrame:
    """row_id and the columns of an evaluation file, null where it has no such column."""
    return table(spark, path, EVAL_COLUMNS)


def kaikki(spark: SparkSession, path: str) -> DataFrame:
    """line (its number) and the fields of the entries of a JSON-lines dump; a bad line has only _corrupt."""
    rows = numbered(spark.read.text(path)).filter(F.btrim("value") != "")
    return rows.select(F.col("row_id").alias("line"), F.from_json("value", KAIKKI, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}).alias("e")).select("line", "e.*")


def whole_text(spark: SparkSession, path: str) -> str:
    """A whole file as one string, for files that a prompt holds; empty if it is missing."""
    return spark.read.text(path, wholetext=True).first()[0] if _status(spark, path) else ""


def grammar(spark: SparkSession, policy: str | None, full: str, compacted: str) -> str:
    """The grammar text that a policy asks for: full, compact or none; any other is full."""
    policy = (policy or "").strip().lower()
    return "" if policy == "none" else whole_text(spark, compacted if policy == "compact" else full)


def result_rows(spark: SparkSession, path: str) -> DataFrame:
    """file, pos and row (a variant) of each entry of results.results of the JSON files at path, whose fields may differ; each file
    is one document, read by one task. A file whose results is no list is an error that names it."""
    doc = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.parse_json("value").alias("doc"))
    inner = F.when(F.schema_of_variant(F.variant_get("doc", "$.results", "variant")).startswith("OBJECT"), F.variant_get("doc", "$.results.results", "variant"))
    listed = F.coalesce(F.schema_of_variant(inner).startswith("ARRAY"), F.lit(False))
    rows = F.when(listed, F.variant_get(inner, "$", "array<variant>")).otherwise(F.raise_error(F.concat(F.lit("no list of results in "), "file")).cast("array<variant>"))
    return doc.select("file", F.posexplode(rows).alias("pos", "row"))
