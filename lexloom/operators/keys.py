"""The inverted index: six classes of lookup keys.

Classes 1 to 3 are the headword as authored, composed and folded, 4 to 6 the same of its
forms. Within a record a key of a class is kept once, with the first form that gives it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.functions.unicode import lookup_keys


def key_table(records: DataFrame) -> DataFrame:
    """(match_class, key, selected_ordinal, authored_key_ordinal).

    records: selected_ordinal, word, routing_forms. A null word or form gives no key; a null or
    empty list of forms gives classes 1 to 3 alone; the headword's keys have authored ordinal 0.
    """
    word = records.select("selected_ordinal", F.lit(0).alias("base"), F.lit(0).alias("authored_key_ordinal"), F.col("word").alias("text"))
    forms = records.select("selected_ordinal", F.lit(3).alias("base"), F.posexplode("routing_forms").alias("authored_key_ordinal", "text"))
    authored = word.unionByName(forms).where("text is not null").select("*", lookup_keys(F.col("text")).alias("keys"))
    each = authored.select("selected_ordinal", "authored_key_ordinal", "base", F.posexplode("keys").alias("n", "key"))
    return each.groupBy((F.col("base") + F.col("n") + 1).alias("match_class"), "key", "selected_ordinal").agg(F.min("authored_key_ordinal").cast("int").alias("authored_key_ordinal"))


def sorted_index(keys: DataFrame, partitions: int) -> DataFrame:
    """Clustered by class and key, sorted as the index is read."""
    return keys.repartition(partitions, "match_class", "key").sortWithinPartitions("match_class", F.col("key").cast("binary"), "selected_ordinal", "authored_key_ordinal")


def differences(expected: DataFrame, stored: DataFrame, columns: list[str]) -> DataFrame:
    """Rows (with their multiplicity) that are in one table only: side is missing or surplus. Nulls are equal to nulls."""
    both = expected.select(*columns, F.lit(1).alias("__n")).unionByName(stored.select(*columns, F.lit(-1).alias("__n")))
    found = both.groupBy(*columns).agg(F.sum("__n").alias("__n")).where("__n <> 0")
    return found.select(*columns, F.when(F.col("__n") > 0, "missing").otherwise("surplus").alias("side"), F.abs("__n").alias("n_rows"))


def orphans(keys: DataFrame, records: DataFrame, column: str) -> DataFrame:
    """Keys whose record is gone."""
    return keys.join(records.select(column).distinct(), column, "left_anti")
