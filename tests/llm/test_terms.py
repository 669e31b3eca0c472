import json
import random
from collections import Counter, defaultdict

import pytest

from lexloom.llm import terms

SEQUENCES = "field_name string, record long, terms array<string>, gram string, n int"


def brute(rows, longest):
    counts, records = Counter(), defaultdict(set)
    for field, record, seq, *_ in rows:
        if field is None or record is None or seq is None:
            continue
        for i in range(len(seq)):
            for j in range(i + 1, min(i + longest, len(seq)) + 1):
                if None in seq[i:j]:
                    break
                counts[field, tuple(seq[i:j])] += 1
                records[field, tuple(seq[i:j])].add(record)
    return {(k, n, len(records[k])) for k, n in counts.items()}


@pytest.mark.parametrize("longest,hot", [(1, terms.HOT), (2, 1), (3, 5), (4, 300)])
def test_against_counting(spark, longest, hot):
    rng = random.Random(longest)
    rows = [(rng.choice(["f", "g", None]), rng.choice([*range(20), None]), rng.choice([None, [], [rng.choice(["hot", "hot", "a", "b", "", None]) for _ in range(rng.randrange(6))]]), "x", 1) for _ in range(400)]
    rows += rows[:30]
    found = terms.gram_counts(spark.createDataFrame(rows, SEQUENCES), longest, hot).collect()
    assert {((r.field_name, tuple(r.gram)), r.occurrences, r.records) for r in found} == brute(rows, longest)
    assert len(found) == len(brute(rows, longest))


def test_records_marks_and_dirty_lines(spark):
    record = {"categories": ["c", "c", 1, None], "senses": [{"tags": ["t"]}, {"tags": "x", "topics": ["o"]}, 5], "tags": ["not counted"]}
    lines = [(i, json.dumps(record)) for i in range(8)] + [(0, json.dumps(record)), (8, "[]"), (9, None), (10, ""), (11, "{"), (12, json.dumps({"categories": ["rare", "x" * 100_000]})), (None, "{}")]
    found = terms.record_terms(spark.createDataFrame(lines, "source_line_number long, source_json string"))
    marks = {(r.field_name, r.gram[0]): (r.occurrences, r.records, r.mark) for r in terms.marked(terms.gram_counts(found.where("field_name <> ''")), found.where("field_name = ''")).collect()}
    assert marks == {("categories", "c"): (16, 8, "common"), ("senses.tags", "t"): (8, 8, "common"), ("senses.topics", "o"): (8, 8, "common"), ("categories", "rare"): (1, 1, "rare"), ("categories", "x" * 100_000): (1, 1, "rare")}


def test_empty(spark):
    empty = spark.createDataFrame([], SEQUENCES)
    assert terms.gram_counts(empty).count() == 0
    assert terms.marked(terms.gram_counts(empty), empty).count() == 0
