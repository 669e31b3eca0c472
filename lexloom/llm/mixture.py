"""Mixing sources to target weights (problem 8).

Documents are counted by source and exact token length. A source that is larger than its
budget gives whole passes first; for the rest of the budget each length gives its proportional
number of documents, and a bounded-knapsack dynamic programme over *all* counts, those taken
(which may go back) and those left (which may come in), settles the difference to the largest
sum that any choice of documents reaches. Which documents of a length are taken follows a
seeded hash: their ranks are found in parallel, hot lengths in salted parts.

The programme is exact. It starts on the sums near the proportional choice and stops when it
meets the budget (or the last multiple of the lengths' common divisor below it), which nothing
can beat; else it widens its window until that holds all sums, or all that an optimal choice
can need: any two choices differ by exchanges whose running sum stays within the longest
length W, and those of them that sum to zero can be left out, so at most 2 W documents change
and no order of the lengths leads further than W * W away.

The driver holds one number per source and distinct length, never documents.
"""

from __future__ import annotations

import math
import random

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexloom.llm.ranks import ranked
from lexloom.llm.tokens import VOCABULARY, token_count
from lexloom.tables import broadcast_if_small, materialized, spread

def subset(counts: dict[int, int], budget: int) -> dict[int, int]:
    """How many of each length to take, at most ``counts``, so that the sum is the largest one up to ``budget``."""
    items, sums, trace = [], 1, []
    full = (1 << (budget + 1)) - 1
    for length in sorted(counts, reverse=True):
        left = min(counts[length], budget // length) if length > 0 else 0
        n = 1
        while left > 0:
            n = min(n, left)
            items.append((length, n))
            trace.append(sums)
            sums = (sums | sums << (length * n)) & full
            left -= n
            n *= 2
    target, chosen = sums.bit_length() - 1, {}
    for (length, n), before in zip(reversed(items), reversed(trace), strict=True):
        if not before >> target & 1:
            chosen[length] = chosen.get(length, 0) + n
            target -= length * n
    return chosen


def settle(counts: dict[int, int], taken: dict[int, int], budget: int, seed: int = 0) -> dict[int, int]:
    """``taken`` with documents put back and taken in, so that its sum is the largest one up to ``budget`` that ``counts`` allow."""
    unit = math.gcd(*counts)
    now = sum(length * n for length, n in taken.items()) // unit
    goal = budget // unit - now
    most = sum(length * n for length, n in counts.items()) // unit - now
    longest = max(counts) // unit
    order = sorted(counts)
    random.Random(seed).shuffle(order)
    reach = 2 * longest
    while True:
        low, high = max(-now, min(0, goal) - reach), min(most, max(0, goal) + reach)
        full = (1 << (high - low + 1)) - 1
        sums, trace = 1 << -low, []
        for length in order:
            for sign, left in ((1, counts[length] - taken.get(length, 0)), (-1, taken.get(length, 0))):
                step, n = length // unit, 1
                left = min(left, (high - low) // step)
                while left > 0 and not (low <= goal <= high and sums >> (goal - low) & 1):
                    n = min(n, left)
                    trace.append((length, sign * n, sums))
                    sums |= (sums << step * n) & full if sign > 0 else sums >> step * n
                    left -= n
                    n *= 2
        best = (sums & ((1 << (min(goal, high) - low + 1)) - 1)).bit_length() - 1
        if best + low == goal or (low, high) == (-now, most) or reach >= longest * longest:
            break
        reach *= 4
    chosen = dict(taken)
    for length, n, before in reversed(trace):
        if not before >> best & 1:
            chosen[length] = chosen.get(length, 0) + n
            best -= n * length // unit
    return {length: n for length, n in chosen.items() if n}


def part_of(counts: dict[int, int], budget: int, seed: int) -> dict[int, int]:
    """How many of each length to take for ``budget`` tokens: the largest sum up to it, near the lengths' own distribution."""
    counts = {length: n for length, n in counts.items() if length > 0 and n > 0}
    total = sum(length * n for length, n in counts.items())
    if budget <= 0 or total <= 0:
        return {}
    if budget >= total:
        return counts
    # Every total/budget-th document along the lengths, from a seeded start: the lengths keep their distribution.
    taken, seen, start = {}, 0, random.Random(seed).randrange(total)
    for length in sorted(counts):
        before = (seen * budget + start) // total
        seen += counts[length]
        taken[length] = (seen * budget + start) // total - before
    return settle(counts, taken, budget, seed)


def budgets(totals: dict[str, int], targets: dict[str, tuple[float, int]], total_tokens: int | None) -> dict[str, int]:
    """Tokens each source should give. Without a total: the largest one at which every source that has text reaches its share."""
    usable = {s: (share, repeats) for s, (share, repeats) in targets.items() if share > 0 and repeats > 0 and totals.get(s, 0) > 0}
    if not usable:
        return {}
    whole = total_tokens if total_tokens is not None else min(repeats * totals[s] / share for s, (share, repeats) in usable.items())
    return {s: min(int(share * whole + 1e-6), repeats * totals[s]) for s, (share, repeats) in usable.items()}


def select(documents: DataFrame, targets: DataFrame, total_tokens: int | None = None, seed: int = 7, vocabulary: str = VOCABULARY) -> tuple[DataFrame, DataFrame]:
    """(selection, report).

    selection: (doc_id, source, tokens, repeats), repeats from 1 to the source's max_repeats.
    report: one row per target with the tokens wanted and taken and the share really got.

    targets: source, target_share, max_repeats; one row per source (of repeated rows the one
    with the largest share counts). Null shares and repeats count as 0. Sources without text
    get nothing and are reported; documents of other or null sources and without tokens aren't
    taken. Repeated rows are separate documents. Other columns are ignored.
    """
    spark = documents.sparkSession
    wanted: dict[str, tuple[float, int]] = {}
    for r in targets.select("source", "target_share", "max_repeats").where("source is not null").distinct().orderBy("target_share", "max_repeats").collect():
        wanted[r.source] = (float(r.target_share or 0), int(r.max_repeats or 0))
    sized = documents.join(broadcast_if_small(targets.select("source").where("source is not null").distinct()), "source", "left_semi")
    sized = materialized(spread(sized.select("doc_id", "source", "text")).select("doc_id", "source", token_count(F.col("text"), vocabulary).alias("tokens")).where("tokens > 0"))
    lengths: dict[str, dict[int, int]] = {}
    for r in sized.groupBy("source", "tokens").agg(F.count(F.lit(1)).alias("n")).collect():
        lengths.setdefault(r.source, {})[r.tokens] = r.n
    totals = {s: sum(k * n for k, n in c.items()) for s, c in lengths.items()}
    plan, passes = [], []
    for source, budget in budgets(totals, wanted, total_tokens).items():
        whole = min(budget // totals[source], wanted[source][1])
        passes.append((source, whole))
        if whole < wanted[source][1]:
            plan += [(source, length, n) for length, n in part_of(lengths[source], budget - whole * totals[source], seed).items()]
    more = spark.createDataFrame(plan, "source string, tokens int, more long")
    every = spark.createDataFrame(passes, "source string, whole int")
    seeded = F.xxhash64(F.lit(seed), F.col("doc_id"))
    placed = ranked(sized, ["source", "tokens"], [seeded, F.col("doc_id")], seeded).join(broadcast_if_small(every), "source").join(broadcast_if_small(more), ["source", "tokens"], "left")
    repeats = F.col("whole") + F.when(F.col("rank") < F.coalesce("more", F.lit(0)), 1).otherwise(0)
    selection = placed.select("doc_id", "source", "tokens", repeats.cast("int").alias("repeats")).where("repeats > 0")
    made = selection.groupBy("source").agg(F.sum(F.col("tokens").cast("long") * F.col("repeats")).alias("taken_tokens"), F.count(F.lit(1)).alias("documents"), F.max("repeats").alias("most_repeats"))
    goal = budgets(totals, wanted, total_tokens)
    asked = spark.createDataFrame([(s, share, n, totals.get(s, 0), goal.get(s, 0)) for s, (share, n) in wanted.items()], "source string, target_share double, max_repeats int, source_tokens long, budget_tokens long")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    joined = asked.join(made, "source", "left").select("source", "target_share", "max_repeats", "source_tokens", "budget_tokens", zero("taken_tokens"), zero("documents"), zero("most_repeats"))
    total = F.sum("taken_tokens").over(Window.partitionBy())  # one row per source
    shares = joined.withColumn("actual_share", F.coalesce(F.try_divide(F.col("taken_tokens"), total), F.lit(0.0)))
    return selection, shares
