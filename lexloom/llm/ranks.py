"""Ranks within groups of which one may hold a third of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ranked(rows: DataFrame, group: list[str], order: list[Column], spread: Column, name: str = "rank") -> DataFrame:
    """Adds each row's place (from 0) in its group, first by a salt taken from ``spread``, then by ``order``.

    A group is sorted in as many parts as there are salts; what all parts before a part hold is
    added from their counts. The order within a group is a fixed one for fixed rows, up to rows
    that are equal in ``spread`` and ``order``, which get different ranks.
    """
    salts = max(64, 2 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    salted = rows.withColumn("__salt", F.pmod(spread, F.lit(salts)).cast("int"))
    sizes = salted.groupBy(*group, "__salt").agg(F.count(F.lit(1)).alias("__n"))
    before = F.sum("__n").over(Window.partitionBy(*group).orderBy("__salt").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select(*group, "__salt", F.coalesce(before, F.lit(0)).alias("__start"))
    local = F.row_number().over(Window.partitionBy(*group, "__salt").orderBy(*order)) - 1
    return salted.withColumn("__at", local).join(starts, [*group, "__salt"]).withColumn(name, F.col("__start") + F.col("__at")).drop("__salt", "__start", "__at")
