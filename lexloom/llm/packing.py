"""Filling fixed-capacity containers with texts (problem 7).

Bulk-synchronous best fit, largest texts first. A round takes all texts of one size and matches
them with the gaps in order: the successor of the size among the open gaps is filled first,
each container with as many texts as fit, then the next gap, and last new containers are
opened. Conflicts never arise, as the texts of a round are told apart by their rank and the
containers of one gap by theirs: the i-th text goes to the i-th place. Then gaps are updated
and the next round begins. This is exactly what best fit does when it takes one text after the
other in falling order of size.

A round needs no texts, only how many there are of its size. Sizes and gaps are whole numbers
up to the capacity, and equal gaps are runs of containers, so the state of all rounds is bounded by the
capacity and not by the data; the sweep over it runs on the driver, while texts are ranked,
matched and written in parallel, with one shuffle for the ranks.
"""

from __future__ import annotations

from bisect import bisect_left, insort

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.llm.ranks import ranked
from lexloom.llm.tokens import VOCABULARY, token_count
from lexloom.tables import broadcast_if_small, materialized, spread

SEGMENT = "size int, first_rank long, last_rank long, container long, each int, start int"


def rounds(counts: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """(segments, containers) for counts of texts by size (1 to capacity).

    A segment: texts of a size with ranks from first to last go, ``each`` to a container, to
    containers numbered from ``container`` on, the first of each at token ``start``.
    """
    gaps: list[int] = []
    runs: dict[int, list[tuple[int, int]]] = {}  # gap: runs of containers (first, how many)
    segments: list[tuple[int, int, int, int, int, int]] = []
    opened = 0

    def put(gap: int, first: int, n: int) -> None:
        if gap > 0 and n > 0:
            if gap not in runs:
                insort(gaps, gap)
                runs[gap] = []
            runs[gap].append((first, n))

    for size in sorted(counts, reverse=True):
        rank, left = 0, counts[size]
        while left:
            at = bisect_left(gaps, size)
            if at < len(gaps):
                gap = gaps[at]
                first, n = runs[gap].pop()
                if not runs[gap]:
                    del runs[gap]
                    gaps.pop(at)
            else:
                gap, first = capacity, opened
                n = -(-left // (capacity // size))
                opened += n
            each = gap // size
            taken = min(n, -(-left // each))
            put(gap, first + taken, n - taken)
            used = min(left, taken * each)
            segments.append((size, rank, rank + used - 1, first, each, capacity - gap))
            last = used - (taken - 1) * each
            put(gap - each * size, first, taken - 1)
            put(gap - last * size, first + taken - 1, 1)
            rank, left = rank + used, left - used
    return segments, opened


def pack(documents: DataFrame, capacity: int, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, piece, tokens, first_token, container, start) for each piece of each document.

    A text of at most ``capacity`` tokens is one piece, piece 0. A longer one is cut into full
    pieces and a rest, each a piece of its own. container numbers from 0; start is the token of
    the container at which the piece begins. A document with a null or empty text has one piece
    of 0 tokens in container 0. Repeated rows are separate documents; a null doc_id is kept.
    Other columns are ignored.
    """
    if capacity < 1:
        raise ValueError("a container must hold at least one token")
    sizes = materialized(spread(documents.select("doc_id", "text")).select("doc_id", token_count(F.col("text"), vocabulary).alias("all_tokens")))
    empty = sizes.where("all_tokens = 0").select(
        "doc_id", F.lit(0).alias("piece"), F.lit(0).alias("tokens"), F.lit(0).cast("long").alias("first_token"), F.lit(0).cast("long").alias("container"), F.lit(0).cast("long").alias("start")
    )
    last = F.ceil(F.col("all_tokens") / capacity).cast("int") - 1
    pieces = sizes.where("all_tokens > 0").select("doc_id", "all_tokens", F.explode(F.sequence(F.lit(0), last)).alias("piece"))
    pieces = pieces.select("doc_id", "piece", F.least(F.lit(capacity), F.col("all_tokens") - F.col("piece") * capacity).cast("int").alias("size"))
    counts = {r["size"]: r["n"] for r in pieces.groupBy("size").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most capacity rows
    segments, _ = rounds(counts, capacity)
    plan = documents.sparkSession.createDataFrame(segments, SEGMENT)
    of_size = plan.groupBy("size").agg(F.array_sort(F.collect_list(F.struct("first_rank", "last_rank", "container", "each", "start"))).alias("segments"))
    numbered = ranked(pieces, ["size"], [F.col("doc_id"), F.col("piece")], F.xxhash64("doc_id", "piece"))
    mine = F.filter("segments", lambda s: (s["first_rank"] <= F.col("rank")) & (F.col("rank") <= s["last_rank"]))[0]
    placed = numbered.join(broadcast_if_small(of_size), "size").withColumn("s", mine)
    at = F.col("rank") - F.col("s.first_rank")
    return placed.select(
        "doc_id",
        "piece",
        F.col("size").alias("tokens"),
        (F.col("piece").cast("long") * capacity).alias("first_token"),
        (F.col("s.container") + F.floor(at / F.col("s.each"))).cast("long").alias("container"),
        (F.col("s.start") + at % F.col("s.each") * F.col("size")).cast("long").alias("start"),
    ).unionByName(empty)


def report(packed: DataFrame, capacity: int) -> DataFrame:
    """One row: containers, tokens, the share of unused space, and the containers that any packing needs at least."""
    used = packed.agg(F.max("container").alias("last"), F.sum("tokens").alias("tokens"), F.count_if(F.col("piece") > 0).alias("cuts"))
    n = F.coalesce(F.col("last") + 1, F.lit(0)).cast("long")
    return used.select(n.alias("containers"), F.coalesce("tokens", F.lit(0)).alias("tokens"), "cuts", F.ceil(F.col("tokens") / capacity).alias("needed"), (1 - F.col("tokens") / (n * capacity)).alias("unused"))
