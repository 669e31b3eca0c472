import itertools
import random

import pytest

from lexloom.llm import mixture

DOCUMENTS = "doc_id long, text string, source string, tokens int, rank long, repeats int"
TARGETS = "source string, target_share double, max_repeats int, note string"


@pytest.mark.parametrize("seed", range(6))
def test_subset_reaches_the_largest_sum(seed):
    rng = random.Random(seed)
    counts = {rng.randrange(1, 30): rng.randrange(1, 4) for _ in range(5)}
    budget = rng.randrange(0, 90)
    best = max(s for s in (sum(k * n for k, n in zip(counts, pick, strict=True)) for pick in itertools.product(*[range(n + 1) for n in counts.values()])) if s <= budget)
    chosen = mixture.subset(counts, budget)
    assert sum(k * n for k, n in chosen.items()) == best and all(n <= counts[k] for k, n in chosen.items())


@pytest.mark.parametrize("seed", range(6))
def test_part_is_exact_where_it_can_be(seed):
    rng = random.Random(seed)
    counts = {1 + int(rng.expovariate(0.01)): rng.randrange(1, 50) for _ in range(300)} | {1: 3, 20_000: 4}
    total = sum(k * n for k, n in counts.items())
    for budget in (0, 1, total // 3, total - 1):
        chosen = mixture.part_of(counts, budget, seed)
        assert sum(k * n for k, n in chosen.items()) == budget and all(0 < n <= counts[k] for k, n in chosen.items())


@pytest.mark.parametrize("seed", range(60))
def test_part_is_the_largest_sum_of_all_counts_without_short_texts(seed):
    rng = random.Random(seed)
    counts = {rng.randrange(65, 6000): rng.randrange(1, 9) for _ in range(6)}
    budget = rng.randrange(1, sum(k * n for k, n in counts.items()))
    size = lambda chosen: sum(k * n for k, n in chosen.items())
    chosen = mixture.part_of(counts, budget, seed)
    assert size(chosen) == size(mixture.subset(counts, budget)) and all(0 < n <= counts[k] for k, n in chosen.items())


def test_part_is_the_largest_sum_where_lengths_share_a_divisor():
    assert mixture.part_of({3000: 2, 5000: 2}, 11000, 7) == {3000: 2, 5000: 1}
    assert mixture.part_of({7000: 4, 9000: 4}, 34000, 1) == {7000: 1, 9000: 3}
    for counts, budget, best in (({6000: 10**5, 5998: 10**5, 4002: 10**5}, 123_456_789, 123_456_788), ({5987: 10**6, 6011: 10**6}, 123_456_789, 123_456_789)):
        assert sum(k * n for k, n in mixture.part_of(counts, budget, 1).items()) == best


def test_shares_caps_and_dirty_rows(spark):
    rng = random.Random(2)
    text = lambda: " ".join(["lantern"] * rng.randrange(1, 60))
    docs = [(i, text(), "big", 0, 0, 0) for i in range(300)] + [(1000 + i, text(), "small", 0, 0, 0) for i in range(20)] + [(2000 + i, text(), "other", 0, 0, 0) for i in range(50)] + [(3000, None, "small", 0, 0, 0), (3001, "", "big", 0, 0, 0), (3002, "x", None, 0, 0, 0), (0, docs_text := text(), "big", 0, 0, 0)]
    assert docs_text
    targets = [("big", 0.6, 2, "n"), ("small", 0.3, 2, "n"), ("small", 0.3, 2, "n"), ("none", 0.1, 3, "n"), (None, 0.5, 1, "n")]
    d, t = spark.createDataFrame(docs, DOCUMENTS), spark.createDataFrame(targets, TARGETS)
    selection, report = mixture.select(d, t)
    rows, shares = selection.collect(), {r.source: r for r in report.collect()}
    assert set(shares) == {"big", "small", "none"}
    assert shares["none"].taken_tokens == 0 and shares["small"].most_repeats == 2 and shares["small"].documents == 20
    assert shares["small"].taken_tokens == 2 * shares["small"].source_tokens and abs(shares["big"].actual_share - 2 / 3) < 0.001
    assert all(1 <= r.repeats <= 2 for r in rows) and {r.source for r in rows} == {"big", "small"}
    assert sorted(map(tuple, mixture.select(d, t)[0].collect())) == sorted(map(tuple, rows))
    fixed = {r.source: r for r in mixture.select(d, t, total_tokens=10**9)[1].collect()}
    assert all(fixed[s].taken_tokens == 2 * fixed[s].source_tokens for s in ("big", "small"))


def test_empty(spark):
    d, t = spark.createDataFrame([], DOCUMENTS), spark.createDataFrame([("a", 1.0, 1, "n"), ("b", None, None, "n")], TARGETS)
    selection, report = mixture.select(d, t)
    assert selection.count() == 0 and {r.actual_share for r in report.collect()} == {0.0}
    selection, report = mixture.select(spark.createDataFrame([(1, "x", "a", 0, 0, 0)], DOCUMENTS), t.limit(0))
    assert selection.count() == 0 and report.count() == 0
