"""Batch lookup: staged key classes, limits, views and their outcomes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexloom.functions.text import primary_subtag
from lexloom.functions.unicode import lookup_keys
from lexloom.tables import broadcast_if_small

#: Bounds of a query.
MAX_QUERY_BYTES, MAX_RESULTS, DEFAULT_LIMIT = 4096, 100, 20


def lookup(queries: DataFrame, keys: DataFrame, limit: int = DEFAULT_LIMIT) -> DataFrame:
    """(query, match_class, selected_ordinal, rank, truncated): the first class of each query that has any record.

    queries: query (distinct strings). An empty query has no result, whatever the limit; one of
    more than 4096 bytes is refused by query_errors and gives no rows here. keys: match_class, key (string),
    selected_ordinal; repeated rows count once. truncated says that more records match than
    the limit shows.
    """
    asked = queries.select("query").where((F.col("query") != "") & (F.octet_length("query") <= MAX_QUERY_BYTES)).distinct()
    if not 1 <= limit <= MAX_RESULTS:
        raise ValueError(f"limit must be 1 to {MAX_RESULTS}")
    stages = asked.select("query", F.posexplode(F.concat(lookup_keys(F.col("query")), lookup_keys(F.col("query")))).alias("n", "key"))
    stages = broadcast_if_small(stages.select("query", (F.col("n") + 1).alias("match_class"), "key"))
    # The index is only scanned: no shuffle but that of the hits, whose extra rows are dropped before it.
    hits = keys.select("match_class", "key", "selected_ordinal").join(stages, ["match_class", "key"]).select("query", "match_class", "selected_ordinal").distinct()
    # In this order the first limit + 1 rows of a query decide; a partial top-k keeps no more of them on either side of the shuffle.
    by_query = Window.partitionBy("query")
    rank = F.row_number().over(by_query.orderBy("match_class", "selected_ordinal"))
    top = hits.withColumn("rank", rank).where(F.col("rank") <= limit + 1).withColumn("best", F.min("match_class").over(by_query)).where("match_class = best")
    cut = F.count(F.lit(1)).over(by_query) > limit
    return top.withColumn("truncated", cut).where(F.col("rank") <= limit).select("query", "match_class", "selected_ordinal", "rank", "truncated")


def query_errors(queries: DataFrame, limit: int) -> DataFrame:
    """(query, error) for queries that are refused; an empty query never is."""
    bad = F.when(F.col("query") == "", None).when(F.octet_length("query") > MAX_QUERY_BYTES, "Limit").when(~F.lit(limit).between(1, MAX_RESULTS), "Limit")
    return queries.select("query", bad.alias("error")).where("error is not null")


def with_records(hits: DataFrame, records: DataFrame) -> DataFrame:
    """Hits with their records' facts; a hit whose record is gone keeps nulls."""
    return hits.join(records, "selected_ordinal", "left")


def outcome(asked: Column, failed: Column, n_matches: Column, n_translations: Column, target: Column) -> Column:
    """Failed, NoEntry, NoTranslation (with its matches) or Completed."""
    return F.when(failed, "Failed").when(~asked | (n_matches == 0), "NoEntry").when(target.isNotNull() & (n_translations == 0), "NoTranslation").otherwise("Completed")


def view_order(views: DataFrame, hint: str | None) -> DataFrame:
    """Adds place: views of the hinted language first, else as given. views: view_pos, language."""
    match = F.lit(False) if hint is None else primary_subtag(F.col("language")) == primary_subtag(F.lit(hint))
    # Views are configuration: a handful of rows.
    return views.withColumn("place", F.row_number().over(Window.orderBy(F.coalesce(match, F.lit(False)).desc(), "view_pos")))


def view_errors(views: DataFrame) -> DataFrame:
    """(view_id, error): empty identifiers, empty targets and identifiers that repeat."""
    n = F.count(F.lit(1)).over(Window.partitionBy("view_id"))
    error = F.when(F.col("view_id") == "", "empty view id").when(F.col("target_language") == "", "empty target language").when(n > 1, "duplicate view id")
    return views.select("view_id", error.alias("error")).where("error is not null")
