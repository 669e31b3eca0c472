"""Order-dependent computations without a window over everything.

Prefix sums take two steps, within buckets of the order key and over the buckets' totals. Folds
that can't be split (greedy shards, running digests) stream a sorted group through one task
with constant memory; they read only what they need.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexloom.tables import materialized

#: Order keys in one bucket of a prefix sum.
BUCKET = 1 << 16


def prefix_sum(rows: DataFrame, group: list[str], order: str, value: Column, name: str) -> DataFrame:
    """Adds the sum of ``value`` over all earlier rows of the group. order: whole numbers, distinct within a group, not null."""
    bucketed = rows.withColumn("__v", value).withColumn("__b", F.floor(F.col(order) / BUCKET))
    within = Window.partitionBy(*group, "__b").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy(*group).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    totals = bucketed.groupBy(*group, "__b").agg(F.sum("__v").alias("__t"))
    starts = totals.select(*group, "__b", F.coalesce(F.sum("__t").over(before), F.lit(0)).alias("__s"))
    local = bucketed.withColumn("__l", F.coalesce(F.sum("__v").over(within), F.lit(0)))
    return local.join(starts, [*group, "__b"]).withColumn(name, F.col("__s") + F.col("__l")).drop("__v", "__b", "__s", "__l")


def dense_ordinals(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Adds each row's place (from 0) in the order of all rows: sorted by ranges, then the rows of all ranges before."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    local = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    # An id holds the partition in its upper and the place within it in its lower 33 bits.
    sorted_ = materialized(local.withColumn("__id", F.monotonically_increasing_id()))
    part, at = F.shiftright("__id", 33), F.col("__id").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = sorted_.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("__n"))
    before = F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))  # one row per partition
    starts = sizes.select("__part", F.coalesce(before, F.lit(0)).alias("__start"))
    placed = sorted_.withColumn("__part", part).join(F.broadcast(starts), "__part")  # at most as many rows as partitions
    return placed.withColumn(name, F.col("__start") + at).drop("__id", "__part", "__start")


def greedy_shards(rows: DataFrame, group: str, order: str, size: str, target: int) -> DataFrame:
    """(group, order, shard): a shard is closed before the record that would take it beyond ``target``, unless it is empty."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, shard, used, filled = None, 0, 0, False
        for batch in batches:
            out = []
            for key, _, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key != now:
                    now, shard, used, filled = key, 0, 0, False
                if filled and used + n > target:
                    shard, used = shard + 1, 0
                used, filled = used + n, True
                out.append(shard)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.int32())], ["g", "o", "shard"])

    read = rows.select(F.col(group).cast("string").alias("g"), F.col(order).cast("long").alias("o"), F.col(size).cast("long").alias("n"))
    sorted_ = read.repartition("g").sortWithinPartitions("g", "o")
    return sorted_.mapInArrow(fold, "g string, o long, shard int").select(F.col("g").alias(group), F.col("o").alias(order), "shard")


def stream_digests(rows: DataFrame, group: list[str], order: str, domain: str, frame: Column) -> DataFrame:
    """(group, digest, n_records): the SHA-256 over a domain and the framed rows of each group in order."""
    start = len(domain.encode()).to_bytes(8, "big") + domain.encode()

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, running, n = None, None, 0
        out: list[tuple] = []
        for batch in batches:
            for key, frame_ in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if running is None or key != now:
                    if running is not None:
                        out.append((now, running.hexdigest(), n))
                    now, running, n = key, hashlib.sha256(start), 0
                running.update(frame_)
                n += 1
        if running is not None:
            out.append((now, running.hexdigest(), n))
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.string()), pa.array([r[1] for r in out], pa.string()), pa.array([r[2] for r in out], pa.int64())], ["g", "digest", "n_records"])

    read = rows.select(F.to_json(F.struct(*group)).alias("g"), F.col(order).alias("o"), frame.alias("f"))
    made = read.repartition("g").sortWithinPartitions("g", "o").select("g", "f").mapInArrow(fold, "g string, digest string, n_records long")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.select(*group).schema.fields)
    return made.select(F.from_json("g", schema).alias("k"), "digest", "n_records").select("k.*", "digest", "n_records")
