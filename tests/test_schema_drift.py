import json
import random

import pytest

from lexloom.operators import schema_drift

FILES = "file_name string, source_line_number long, source_json string, path string, pair int"


def files(spark, by_file):
    rows = [(f"x-{name}.jsonl", i, line if isinstance(line, str) or line is None else json.dumps(line), "clash", 7) for name, lines in by_file.items() for i, line in enumerate(lines)]
    return spark.createDataFrame(rows, FILES)


def report(spark, by_file):
    return {(r.file_name, r.field_path, r.change_kind, r.new_path) for r in schema_drift.changes(schema_drift.drift(files(spark, by_file))).collect()}


def test_rename_add_remove_retype_and_parents(spark):
    old = [{"word": w, "kind": w + "!", "n": 1, "gone": {"a": 1}, "s": [{"code": w}, {"code": "x"}]} for w in "abcd"]
    new = [{"word": w, "type": w + "!", "n": "1", "fresh": {"b": True}, "s": [{"lang": w}, {"lang": "x"}]} for w in "abcd"]
    assert report(spark, {"20260101": old, "20260201": new, "20260301": new}) == {
        ("x-20260201.jsonl", "kind", "renamed", "type"),
        ("x-20260201.jsonl", "n", "retyped", ""),
        ("x-20260201.jsonl", "gone", "removed", ""),
        ("x-20260201.jsonl", "gone.a", "removed", ""),
        ("x-20260201.jsonl", "fresh", "added", ""),
        ("x-20260201.jsonl", "fresh.b", "added", ""),
        ("x-20260201.jsonl", "s.code", "renamed", "s.lang"),
    }


def test_other_values_are_no_rename_and_a_renamed_parents_fields_end(spark):
    old = [{"word": w, "a": w, "p": {"q": w}} for w in "abcd"]
    new = [{"word": w, "b": w + "other", "r": {"q": w}} for w in "abcd"]
    found = report(spark, {"20260101": old, "20260201": new})
    assert {x[1:] for x in found} == {("a", "removed", ""), ("b", "added", ""), ("p", "renamed", "r"), ("p.q", "removed", ""), ("r.q", "added", "")}


def test_move_to_another_parent_is_reported(spark):
    old = [{"word": w, "p": {"v": w, "k": 1}, "o": {"k": 1}} for w in "abcd"]
    new = [{"word": w, "p": {"k": 1}, "o": {"v": w, "k": 1}} for w in "abcd"]
    df = files(spark, {"20260101": old, "20260201": new})
    found = {(r.change_kind, r.field_path, r.new_path) for r in schema_drift.drift(df).collect()}
    assert found == {("moved", "p.v", "o.v")}


def test_bad_lines_nulls_and_few_files(spark):
    good = [{"word": "a", "x": 1}]
    assert report(spark, {"20260101": [*good, "[1]", "{", None, "", '"s"', '{"a":1} x']}) == set()
    assert report(spark, {"20260101": good, "20260201": ["nope"]}) == {("x-20260201.jsonl", "word", "removed", ""), ("x-20260201.jsonl", "x", "removed", "")}
    assert schema_drift.drift(files(spark, {"20260101": good}).limit(0)).count() == 0


def test_unified_records(spark):
    by = {"20260101": [{"word": "a", "kind": "x", "n": 1, "tags": "t", "title": ["u", "v"], "s": [{"code": "c", "k": 1}]}], "20260201": [{"word": "a", "type": "x", "n": "1", "tags": ["t"], "title": "u、v", "s": [{"lang": "c", "k": 1}]}]}
    df = files(spark, by)
    table = schema_drift.unify(df, schema_drift.drift(df))
    rows = [r.asDict(True) for r in table.drop("file_name", "source_line_number").collect()]
    assert rows == [{"n": "1", "s": [{"k": 1, "lang": "c"}], "tags": ["t"], "title": "u、v", "type": "x", "word": "a"}] * 2
    counted = {(r.field_path, r.new_path, r.kind, r.target, r.n) for r in schema_drift.conversions(df, schema_drift.drift(df)).collect()}
    assert counted == {("n", "n", "integer", "string", 1), ("tags", "tags", "string", "array", 1), ("title", "title", "array", "string", 1)}


def test_unified_moves_gone_fields_and_clashes(spark):
    old = [{"word": w, "p": {"v": w, "k": 1}, "o": {"k": 1}, "gone": {"x": [1, 2.5]}, "file_name": "f", "It's": True, "it's": w} for w in "abcd"]
    new = [{"word": w, "p": {"k": 1}, "o": {"v": w, "k": 1}, "it's": w} for w in "abcd"]
    df = files(spark, {"20260101": old, "20260201": new})
    table = schema_drift.unify(df, schema_drift.drift(df))
    assert table.columns == ["file_name", "source_line_number", "It's", "file_name_2", "gone", "it's_2", "o", "p", "word"]
    rows = {(r.file_name[2:10], r.word): r.asDict(True) for r in table.collect()}
    assert len(rows) == 8 and all(r["o"] == {"k": 1, "v": w} and r["p"] == {"k": 1} and r["it's_2"] == w for (_, w), r in rows.items())
    assert rows["20260101", "a"]["gone"] == {"x": [1.0, 2.5]} and rows["20260201", "a"]["gone"] is None and rows["20260101", "b"]["file_name_2"] == "f"


def test_unified_dirty_lines(spark):
    good = {"word": "a", "x": [{"y": None}, "z", {"y": 3}]}
    df = files(spark, {"20260101": [good, "[1]", "{", None, "", '"s"', '{"word":1} x', '{"word":1},{"word":2}', '{"word":"twice","word":"b"}', {}], "20260201": [good]})
    rows = [r for r in schema_drift.unify(df, schema_drift.drift(df)).orderBy("file_name", "source_line_number").collect()]
    assert [r.word for r in rows] == ["a", "b", None, "a"] and rows[0].x == ['{"y":null}', "z", '{"y":3}']
    empty = files(spark, {"20260101": [None]})
    assert schema_drift.unify(empty, schema_drift.drift(empty)).count() == 0


@pytest.mark.parametrize("seed", range(30))
def test_moves_and_renames_are_matched_at_least_cost(seed):
    # Leaves under two parents that both files have: any one-to-one matching of ended and begun leaves, by brute force.
    rng = random.Random(seed)
    old = [f"{p}.{k}" for p in "pq" for k in "abc" if rng.random() < 0.6]
    new = [f"{p}.{k}" for p in "pq" for k in "abc" if rng.random() < 0.6]
    old, new = [x for x in old if x not in new], [x for x in new if x not in old]
    near = lambda x, y: (x[0] == y[0]) != (x[2] == y[2])
    off = {(x, y): rng.choice([0.0, 0.2, 0.4, 0.9]) for x in old for y in new if near(x, y)}
    price = lambda x, y: off.get((x, y), 9) + (schema_drift.MOVE if x[0] != y[0] else 0) if off.get((x, y), 9) < schema_drift.SAME else 9

    def best(left, free):
        if not left:
            return float(len(free))
        return min([1 + best(left[1:], free)] + [price(left[0], y) + best(left[1:], [z for z in free if z != y]) for y in free])

    diff = schema_drift.TreeDiff({"p", "q", *old}, {"p", "q", *new}, off)
    script = diff.align()[1]
    lost, gained = [o for k, o, _ in script if k == "removed"], [n for k, _, n in script if k == "added"]
    moves = diff.moves(lost, gained)
    found = sum(price(o, n) for k, o, n in script if k == "renamed") + sum(price(o, n) for o, n in moves.items()) + len(lost) + len(gained) - 2 * len(moves)
    assert found >= best(old, new) - 1e-9 and (found <= best(old, new) + 0.5)


def test_assignment_is_optimal():
    import itertools
    import random

    rng = random.Random(3)
    for n in (1, 2, 4, 5):
        cost = [[rng.random() for _ in range(n)] for _ in range(n)]
        best = min(sum(cost[i][p[i]] for i in range(n)) for p in itertools.permutations(range(n)))
        assert abs(sum(cost[i][j] for i, j in enumerate(schema_drift._assignment(cost))) - best) < 1e-9
