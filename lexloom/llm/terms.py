"""Frequency of every distinct term and term sequence (problem 2).

Suffix-sorted counting: each sequence gives one suffix per position, cut to ``longest`` terms.
Suffixes go to tasks by their first term and are sorted in reverse lexicographic order there,
so that a sequence directly follows all its extensions. A stack with one level per term then
holds the counts and record sets of the open prefixes; a level is closed when the common
prefix gets shorter, and adds itself to the level below.

A first term with more than HOT rows, which a third of all records may share, is split by a salt
taken from the record, into parts of about HOT rows; all others go whole. Salts hold disjoint
records, so both counts add up exactly, and a record set never holds more than one part. Equal
suffixes of one record are combined before they are sent, so a suffix without extensions needs
no record set: its rows are its records.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.functions.strict_json import items, loads_object
from lexloom.tables import materialized, one_per_key

#: A term is rare in at most this many records, common in more than this share of all records.
RARE_RECORDS = 2
COMMON_SHARE = 0.25
#: Rows of one first term that go to one task.
HOT = 1 << 20
COUNTED = "field_name string, gram array<string>, occurrences long, records long"


def _stack_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (field, suffix, record, n) sorted by field and reverse suffix order, to counts of all prefixes."""
    path: list[str] = []
    levels: list[list] = []  # of path[: i + 1]: occurrences, records, and their set once an extension has been closed
    field: str | None = None
    out: list[tuple] = []

    def pop_to(depth: int) -> None:
        while len(path) > depth:
            occurrences, records, held = levels.pop()
            out.append((field, list(path), occurrences, len(held) if held is not None else len(records)))
            path.pop()
            if levels:
                below = levels[-1]
                below[0] += occurrences
                if below[2] is None:
                    below[2] = set(below[1])
                below[2].update(records if held is None else held)

    def flush() -> pa.RecordBatch:
        columns = [[r[i] for r in out] for i in range(4)]
        out.clear()
        kinds = (pa.string(), pa.list_(pa.string()), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["field_name", "gram", "occurrences", "records"])

    for batch in batches:
        for name, suffix, record, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            common = 0
            if name == field:
                for a, b in zip(path, suffix, strict=False):
                    if a != b:
                        break
                    common += 1
            pop_to(common)
            field = name
            for term in suffix[common:]:
                path.append(term)
                levels.append([0, array("q"), None])
            last = levels[-1]
            last[0] += n
            if last[2] is None:
                last[1].append(record)  # rows are combined by record: each is another one
            else:
                last[2].add(record)
        if len(out) > 10_000:
            yield flush()
    pop_to(0)
    yield flush()


def gram_counts(sequences: DataFrame, longest: int = 1, hot: int = HOT) -> DataFrame:
    """(field_name, gram, occurrences, records) for every sequence of up to ``longest`` terms.

    sequences: field_name, record (long), terms (array of strings). occurrences counts every
    place, records distinct values of ``record``. Null terms cut a sequence in two; null or
    empty sequences and an empty table give no rows. Terms are compared exactly as written.
    hot: first terms with more rows are split into parts of about so many.
    """
    spark = sequences.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    at = sequences.where("field_name is not null and record is not null and terms is not null").select("field_name", "record", "terms", F.posexplode("terms").alias("at", "first")).where("first is not null")
    window = F.slice("terms", F.col("at") + 1, longest)
    gap = F.array_position(F.transform(window, lambda t: t.isNull()), True)
    suffix = F.when(gap > 0, F.slice(window, 1, (gap - 1).cast("int"))).otherwise(window)
    combined = materialized(at.select("field_name", suffix.alias("suffix"), "record").groupBy("field_name", "suffix", "record").agg(F.count(F.lit(1)).alias("n")))
    first = F.col("suffix")[0]
    split = combined.groupBy("field_name", first.alias("first")).agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > hot)
    split = split.select("field_name", "first", F.ceil(F.col("rows") / hot).alias("salts"))
    salted = combined.withColumn("first", first).join(split, ["field_name", "first"], "left").withColumn("salt", F.pmod(F.xxhash64("record"), F.coalesce("salts", F.lit(1))))
    routed = salted.repartition(parts, "field_name", "first", "salt").sortWithinPartitions(F.col("field_name"), "salt", F.desc("suffix"), "record")
    # A salt ends with its own pops: the field handed to the stack carries it.
    tagged = routed.select(F.concat_ws("\x00", "field_name", F.col("salt").cast("string")).alias("field"), "suffix", "record", "n")
    counted = tagged.mapInArrow(_stack_counts, COUNTED)
    return counted.groupBy(F.substring_index("field_name", "\x00", 1).alias("field_name"), "gram").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))


def record_terms(lines: DataFrame) -> DataFrame:
    """(record, field_name, position, terms) of the lines that are JSON objects; one row with field_name '' marks each record.

    Lines with one number are one record: the newest content, if there is loaded_at. Fields
    that aren't lists and items that aren't strings are passed over.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for line, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                record = loads_object(text)
                if record is None:
                    continue
                out.append((line, "", 0, []))
                lists = [("categories", 0, record.get("categories"))]
                for i, sense in enumerate(items(record.get("senses"))):
                    if isinstance(sense, dict):
                        lists += [("senses.tags", i, sense.get("tags")), ("senses.topics", i, sense.get("topics"))]
                for name, i, terms in lists:
                    found = [t for t in items(terms) if isinstance(t, str)]
                    if found:
                        out.append((line, name, i, found))
            kinds = (pa.int64(), pa.string(), pa.int32(), pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], ["record", "field_name", "position", "terms"])

    order = [c for c in ("loaded_at",) if c in lines.columns]
    read = lines.select("source_line_number", "source_json", *order).where("source_line_number is not null and source_json is not null")
    once = one_per_key(read, "source_line_number", order).select("source_line_number", "source_json")
    return once.mapInArrow(rows, "record long, field_name string, position int, terms array<string>")


def marked(counts: DataFrame, records: DataFrame) -> DataFrame:
    """Adds the share of all records and a mark: rare, common or null. records: one row per record."""
    total = F.lit(records.count())
    mark = F.when(F.col("records") <= RARE_RECORDS, "rare").when(F.col("records") > total * COMMON_SHARE, "common")
    return counts.withColumn("share", F.try_divide(F.col("records"), total)).withColumn("mark", mark)
