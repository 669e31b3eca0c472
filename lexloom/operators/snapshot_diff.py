"""What changed between consecutive full snapshots (problem 1).

Every row is tagged with the side it is on: a snapshot is the later side of one pair and the
earlier side of the next. Snapshots of a pack are numbered, and a tag is one bit of a mask,
so the union of all sides needs no copies of rows. Masks hold 63 snapshots; longer series
continue in the next block, which repeats the last snapshot of the block before, so that
each pair lies in one block.

Two aggregations, both combined on the map side: the first is keyed by (key, row hash) and
so splits a key that holds a third of all rows, the second gets one row for each distinct
hash of a key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.tables import broadcast_if_small

#: Pairs in one mask of 63 usable bits.
PAIRS = 62


def snapshot_days(packs: DataFrame) -> DataFrame:
    """(pack_id, pack_revision, day, k): k numbers the days of a pack from 0.

    Several builds of one day are one snapshot. Rows without pack, revision or date are left out.
    """
    from pyspark.sql import Window

    days = packs.select("pack_id", "pack_revision", F.substring("kaikki_extraction_date", 1, 10).alias("day")).dropna().distinct()
    return days.withColumn("k", F.dense_rank().over(Window.partitionBy("pack_id").orderBy("day")) - 1)


def changes(rows: DataFrame, key: str, row_hash: str, series: str, k: str) -> DataFrame:
    """(series, key, pair, kind) for each key that differs between snapshots ``pair`` and ``pair + 1``.

    rows: one row per record and snapshot, ``k`` the snapshot's number within ``series``.
    kind: ``added``, ``removed`` or ``changed`` (the sets of distinct hashes differ).
    Rows with a null key are left out; a null hash is a value like any other. Rows delivered
    twice count once. An empty table gives no rows. Other columns are ignored.
    """
    base = rows.where(F.col(key).isNotNull() & F.col(k).isNotNull()).select(
        F.col(series).alias("series"), F.col(key).alias("key"), F.coalesce(F.col(row_hash), F.lit(b"\x00null")).alias("hash"), F.col(k).cast("int").alias("k")
    )
    bit = lambda c: F.call_function("shiftleft", F.lit(1).cast("long"), c)
    tagged = base.select(
        "series",
        "key",
        "hash",
        F.explode(
            F.when(
                (F.col("k") % PAIRS == 0) & (F.col("k") > 0),
                F.array(
                    F.struct(F.floor(F.col("k") / PAIRS).cast("int").alias("block"), bit(F.lit(0)).alias("mask")),
                    F.struct((F.floor(F.col("k") / PAIRS) - 1).cast("int").alias("block"), bit(F.lit(PAIRS)).alias("mask")),
                ),
            ).otherwise(F.array(F.struct(F.floor(F.col("k") / PAIRS).cast("int").alias("block"), bit((F.col("k") % PAIRS).cast("int")).alias("mask"))))
        ).alias("tag"),
    )
    by_hash = tagged.groupBy("series", "key", "hash", F.col("tag.block").alias("block")).agg(F.bit_or("tag.mask").alias("mask"))
    by_key = by_hash.groupBy("series", "key", "block").agg(
        F.bit_or("mask").alias("present"), F.bit_or(F.col("mask").bitwiseXOR(F.shiftright("mask", 1))).alias("differs")
    )
    has = lambda c, b: F.call_function("shiftright", F.col(c), b).bitwiseAND(F.lit(1).cast("long")) == 1

    def kind(b: Column) -> Column:
        before, after = has("present", b), has("present", b + 1)
        return F.when(before & after, F.when(has("differs", b), "changed")).when(after, "added").when(before, "removed")

    found = F.transform(F.sequence(F.lit(0), F.lit(PAIRS - 1)), lambda b: F.struct(b.alias("bit"), kind(b).alias("kind")))
    return by_key.select("series", "key", "block", F.explode(F.filter(found, lambda x: x["kind"].isNotNull())).alias("c")).select(
        "series", "key", (F.col("block") * PAIRS + F.col("c.bit")).cast("int").alias("pair"), F.col("c.kind").alias("kind")
    )


def snapshot_changes(records: DataFrame, packs: DataFrame) -> DataFrame:
    """(pack_id, from_date, to_date, authored_headword, change_kind) over all consecutive snapshots.

    A row belongs to the snapshot of its pack_revision, whenever it was delivered. Rows whose
    revision no pack has are left out. A snapshot without rows still counts as one, so all
    headwords before it are removed and all after it are added.
    """
    days = snapshot_days(packs)
    of_revision = broadcast_if_small(days.select("pack_revision", "pack_id", "k").distinct())
    rows = records.select("pack_revision", "authored_headword", "record_sha256").join(of_revision, "pack_revision")
    found = changes(rows, "authored_headword", "record_sha256", "pack_id", "k")
    named = days.select("pack_id", "k", "day").distinct()
    pairs = named.alias("a").join(named.alias("b"), (F.col("a.pack_id") == F.col("b.pack_id")) & (F.col("b.k") == F.col("a.k") + 1))
    pairs = pairs.select(F.col("a.pack_id").alias("series"), F.col("a.k").alias("pair"), F.col("a.day").alias("from_date"), F.col("b.day").alias("to_date"))
    # A removal after the newest snapshot isn't a change: the inner join drops pairs without a later side.
    return found.join(broadcast_if_small(pairs), ["series", "pair"]).select(
        F.col("series").alias("pack_id"), "from_date", "to_date", F.col("key").alias("authored_headword"), F.col("kind").alias("change_kind")
    )
