"""Line-delimited JSON as exact bytes with line numbers, byte offsets and validation.

Only LF ends a line; one CR before it is dropped. Numbers and offsets come from two prefix
sums: within each split of a file, and over the splits' totals.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexloom.functions.strict_json import json_type, loads_strict
from lexloom.tables import one_per_key

#: Bounds of a line and of a record's forms.
MAX_LINE_BYTES, MAX_ROUTING_FORMS = 64 * 1024 * 1024, 4096

RECORD = "line_number long, byte_offset long, source_bytes binary, lang_code string, word string, routing_forms array<string>, error string"


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_number from 1, byte_offset from 0, source_bytes) of every line, blank ones too."""
    raw = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("file_size"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("at"), F.col("value").cast("binary").alias("raw")
    )
    within = Window.partitionBy("file", "split").orderBy("at")
    length = F.octet_length("raw").cast("long") + 1
    local = raw.withColumn("n", F.row_number().over(within)).withColumn("offset", F.sum(length).over(within) - length)
    splits = raw.groupBy("file", "split").agg(F.count(F.lit(1)).alias("lines"), F.sum(length).alias("bytes"))
    before = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    starts = splits.select("file", "split", F.coalesce(F.sum("lines").over(before), F.lit(0)).alias("l0"), F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("b0"))
    placed = local.join(starts, ["file", "split"]).withColumn("byte_offset", F.col("b0") + F.col("offset"))
    ended = F.col("byte_offset") + F.octet_length("raw") < F.col("file_size")
    stripped = F.when(ended & (F.substring(F.col("raw"), -1, 1) == F.lit(b"\r")), F.expr("substring(raw, 1, octet_length(raw) - 1)")).otherwise(F.col("raw"))
    return placed.select("file", (F.col("l0") + F.col("n")).alias("line_number"), "byte_offset", stripped.alias("source_bytes"))


def examine(raw: bytes | None, language: str) -> tuple[str | None, str | None, list[str] | None, str | None]:
    """(lang_code, word, routing_forms, error) of a line; lang_code is null if the line isn't selected."""
    none = (None, None, None)
    if raw is None or raw == b"":
        return (*none, "is empty")
    if len(raw) > MAX_LINE_BYTES:
        return (*none, f"exceeds {MAX_LINE_BYTES} bytes")
    try:
        text = raw.decode("utf-8")
    except UnicodeDecodeError as e:
        return (*none, f"is not UTF-8 (valid through byte {e.start})")
    if not text.lstrip().startswith("{"):
        return (*none, "is not a JSON object")
    try:
        record = loads_strict(text)
    except (ValueError, RecursionError):
        return (*none, "is malformed JSON")
    if "lang_code" not in record:
        return (*none, None)
    code = record["lang_code"]
    if not isinstance(code, str):
        return (*none, f"has {json_type(code)} `lang_code`; expected a string")
    if code != language:
        return (*none, None)
    if "word" not in record:
        return (*none, "has no `word`")
    word = record["word"]
    if not isinstance(word, str):
        return (*none, f"has {json_type(word)} `word`; expected a string")
    if not word:
        return (*none, "has an empty `word`")
    forms = record.get("forms", [])
    if not isinstance(forms, list):
        return (*none, f"has {json_type(forms)} `forms`; expected an array")
    routed: list[str] = []
    for i, item in enumerate(forms):
        if not isinstance(item, dict):
            return (*none, f"has {json_type(item)} `forms[{i}]`; expected an object")
        if "form" not in item:
            return (*none, f"has no `forms[{i}].form`")
        form = item["form"]
        if not isinstance(form, str):
            return (*none, f"has {json_type(form)} `forms[{i}].form`; expected a string")
        if form not in ("", "-"):
            routed.append(form)
            if len(routed) > MAX_ROUTING_FORMS:
                return (*none, f"exceeds the {MAX_ROUTING_FORMS}-routing-form limit")
    return code, word, routed, None


def select(scanned: DataFrame, language: str) -> DataFrame:
    """Records of one language, and a row with an error for each line that is refused.

    scanned: line_number, byte_offset, source_bytes. Lines of other languages and without a
    language give no row.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in RECORD.split(", ")]
        kinds = (pa.int64(), pa.int64(), pa.binary(), pa.string(), pa.string(), pa.list_(pa.string()), pa.string())
        for batch in batches:
            out = []
            for line, offset, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                code, word, forms, error = examine(raw, language)
                if code is not None or error is not None:
                    out.append((line, offset, raw, code, word, forms, error))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], names)

    return scanned.select("line_number", "byte_offset", "source_bytes").mapInArrow(rows, RECORD)


def from_table(table: DataFrame, line: str, offset: str, text: str) -> DataFrame:
    """A table of lines as a scan; of a line loaded again the newest content (by loaded_at, if there is one) counts."""
    order = [c for c in ("loaded_at",) if c in table.columns]
    read = table.select(F.col(line).alias("line_number"), F.col(offset).alias("byte_offset"), F.col(text).cast("binary").alias("source_bytes"), *order)
    return one_per_key(read, "line_number", order).drop(*order)


def capture_facts(spark: SparkSession, path: str) -> DataFrame:
    """(file, size_bytes, sha256, line_feeds) of whole files."""
    spaced = F.regexp_replace(F.hex("content"), "(..)", "$1 ")
    feeds = (F.length(spaced) - F.length(F.replace(spaced, F.lit("0A "), F.lit("")))) / 3
    files = spark.read.format("binaryFile").load(path)
    return files.select(F.col("path").alias("file"), F.col("length").alias("size_bytes"), F.sha2("content", 256).alias("sha256"), feeds.cast("long").alias("line_feeds"))
