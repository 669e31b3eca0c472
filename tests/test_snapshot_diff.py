import random
from collections import defaultdict

from lexloom.operators.snapshot_diff import changes, snapshot_changes

RECORDS = "pack_revision string, authored_headword string, record_sha256 binary, delivered_at string, key string, block int"
PACKS = "pack_id string, pack_revision string, kaikki_extraction_date string"


def brute(rows, last):
    sets = defaultdict(lambda: defaultdict(set))
    for series, key, h, k in rows:
        if key is not None:
            sets[series, key][k].add(h)
    out = set()
    for (series, key), by in sets.items():
        for k in range(last):
            a, b = by.get(k, set()), by.get(k + 1, set())
            if a != b:
                out.add((series, key, k, "changed" if a and b else "added" if b else "removed"))
    return out


def test_against_sets_over_many_snapshots(spark):
    rng = random.Random(1)
    rows = [(rng.choice("xy"), rng.choice([None, "", "a", "b", "hot", "hot"]), rng.choice([None, b"1", b"2"]), rng.randrange(140)) for _ in range(1500)]
    rows += rows[:50]
    df = spark.createDataFrame(rows, "series string, key string, h binary, k int")
    found = {(r.series, r.key, r.pair, r.kind) for r in changes(df, "key", "h", "series", "k").collect()}
    assert {x for x in found if x[2] < 139} == brute(rows, 139)


def test_days_builds_late_and_repeated_rows(spark):
    packs = [("p", "r1", "2026-01-01"), ("p", "r2", "2026-02-01T05:00:00Z"), ("p", "r2b", "2026-02-01"), ("p", "r3", "2026-03-01"), ("p", "r1", "2026-01-01"), ("q", "s1", "2026-01-15"), ("p", None, "2026-04-01"), ("p", "r5", None)]
    records = [("r1", "a", b"1", "x", "k", 0), ("r1", "a", b"1", "late", "k", 0), ("r1", "b", b"1", "x", "k", 0), ("r2", "a", b"1", "x", "k", 0), ("r2b", "a", b"2", "x", "k", 0), ("r3", "c", b"3", "x", "k", 0), ("s1", "z", b"1", "x", "k", 0), ("gone", "n", b"1", "x", "k", 0), ("r1", None, b"1", "x", "k", 0)]
    found = {tuple(r) for r in snapshot_changes(spark.createDataFrame(records, RECORDS), spark.createDataFrame(packs, PACKS)).collect()}
    assert found == {
        ("p", "2026-01-01", "2026-02-01", "a", "changed"),
        ("p", "2026-01-01", "2026-02-01", "b", "removed"),
        ("p", "2026-02-01", "2026-03-01", "a", "removed"),
        ("p", "2026-02-01", "2026-03-01", "c", "added"),
    }


def test_empty_tables(spark):
    packs = spark.createDataFrame([("p", "r1", "2026-01-01")], PACKS)
    assert snapshot_changes(spark.createDataFrame([], RECORDS), packs).count() == 0
    assert snapshot_changes(spark.createDataFrame([("r1", "a", b"1", "x", "k", 0)], RECORDS), packs.limit(0)).count() == 0
