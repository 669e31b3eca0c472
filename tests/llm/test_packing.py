import random
from bisect import bisect_left, insort
from collections import Counter, defaultdict

import pytest

from lexloom.llm import packing
from lexloom.llm.tokens import encoding

DOCUMENTS = "doc_id long, text string, size int, rank long, container string"


def best_fit(sizes, capacity):
    """Gaps of the containers when texts go one after the other, largest first."""
    gaps = []
    for s in sorted(sizes, reverse=True):
        at = bisect_left(gaps, s)
        gap = gaps.pop(at) if at < len(gaps) else capacity
        insort(gaps, gap - s)
    return gaps


@pytest.mark.parametrize("seed", range(8))
def test_rounds_are_best_fit(seed):
    rng = random.Random(seed)
    capacity = rng.choice([1, 7, 50, 400])
    sizes = [min(capacity, 1 + int(rng.expovariate(6 / capacity))) for _ in range(rng.randrange(600))]
    sizes += [max(1, capacity // 3)] * (len(sizes) // 2)
    segments, opened = packing.rounds(dict(Counter(sizes)), capacity)
    used = defaultdict(list)
    for size, a, b, first, each, start in segments:
        for r in range(a, b + 1):
            used[first + (r - a) // each].append((start + (r - a) % each * size, size))
    for places in used.values():
        places.sort()
        assert all(x + n <= y for (x, n), (y, _) in zip(places, places[1:], strict=False)) and places[-1][0] + places[-1][1] <= capacity
    assert sorted(s for p in used.values() for _, s in p) == sorted(sizes)
    assert sorted(used) == list(range(opened))
    assert sorted(capacity - sum(s for _, s in p) for p in used.values()) == best_fit(sizes, capacity)


def test_documents(spark):
    rng = random.Random(5)
    texts = [" ".join(rng.choice(["lantern", "猫", "a"]) for _ in range(rng.choice([1, 3, 9, 30, 90]))) for _ in range(120)] + [None, "", "x" * 3000] + ["same text"] * 40
    rows = [(i, t, 1, 2, "c") for i, t in enumerate(texts)] + [(0, texts[0], 1, 2, "c"), (None, "no id", 1, 2, "c")]
    capacity = 64
    out = packing.pack(spark.createDataFrame(rows, DOCUMENTS), capacity).collect()
    tokens = lambda t: len(encoding().encode_ordinary(t or ""))
    by = defaultdict(list)
    for r in out:
        by[r.doc_id].append(r)
    for i, t, *_ in rows[1:-2]:
        pieces = sorted(by[i], key=lambda r: r.piece)
        assert sum(r.tokens for r in pieces) == tokens(t)
        assert len(pieces) == max(1, -(-tokens(t) // capacity)) and [r.first_token for r in pieces] == [k * capacity for k in range(len(pieces))]
    assert len(by[0]) == 2 * max(1, -(-tokens(texts[0]) // capacity)) and len(by[None]) == 1
    filled = defaultdict(list)
    for r in out:
        if r.tokens:
            filled[r.container].append((r.start, r.tokens))
    for places in filled.values():
        places.sort()
        assert all(x + n <= y for (x, n), (y, _) in zip(places, places[1:], strict=False)) and sum(places[-1]) <= capacity
    report = packing.report(spark.createDataFrame(out, "doc_id long, piece int, tokens int, first_token long, container long, start long"), capacity).first()
    assert report.containers == len(filled) and report.needed <= report.containers <= report.needed + 2


def test_empty_and_bad_capacity(spark):
    empty = spark.createDataFrame([], DOCUMENTS)
    assert packing.pack(empty, 10).count() == 0
    assert packing.report(packing.pack(empty, 10), 10).first().containers == 0
    with pytest.raises(ValueError):
        packing.pack(empty, 0)
