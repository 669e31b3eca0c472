import json

from lexloom.operators.flatten import TreeAutomaton, nested, subtype, supertype, variants

LINES = "source_line_number long, source_json string, variant string, payload string"
RECORD = {
    "word": "w",
    "senses": [{"glosses": ["g"], "examples": [{"ref": "r"}, {"text": "t", "ref": 3}, "odd", {"text": ""}]}, {"translations": [{"word": "a"}]}, "odd", {"sounds": [{"audio": "x.ogg"}]}],
    "translations": [{"note": "n"}, {"word": "b", "tags": ["x"]}],
    "sounds": [{"audio": "y.ogg"}, {"audio": None}],
    "examples": [{"text": "not of a sense"}],
}


def rows(spark, texts):
    return spark.createDataFrame([(i, t, "v", "p") for i, t in texts], LINES)


def test_positions_and_dirty_lines(spark):
    texts = [(1, json.dumps(RECORD)), (1, json.dumps(RECORD)), (2, "[]"), (3, None), (4, ""), (5, json.dumps(RECORD)[:-3]), (6, '{"senses": 5, "sounds": {"audio": "z"}}'), (7, "{}"), (None, json.dumps(RECORD))]
    made = supertype(rows(spark, texts), False)
    found = {tuple(r) for r in made.where("subtype in ('text', 'word', 'audio')").select("source_line_number", "child_kind", "sense_pos", "item_pos").collect()}
    assert found == {(1, "example", 0, 1), (1, "translation", 1, 0), (1, "sound", 3, 0), (1, "translation", -1, 1), (1, "sound", -1, 0), (1, "example", -1, 0)}
    # Nothing is left out: every other child is routed elsewhere, once.
    rest = sorted(tuple(r) for r in made.where("subtype not in ('text', 'word', 'audio')").select("source_line_number", "child_kind", "subtype", "sense_pos", "item_pos").collect())
    assert rest == [(1, "example", "other", 0, 3), (1, "example", "ref", 0, 0), (1, "example", "value", 0, 2), (1, "sound", "other", -1, 1), (1, "translation", "note", -1, 0)]
    assert supertype(rows(spark, []), False).count() == 0


def test_typed_tables_keep_links_and_variants(spark):
    made = supertype(rows(spark, [(1, json.dumps(RECORD))]))
    example = subtype(made, "example", route="text").where("sense_pos = 0").first()
    assert (example.item_pos, example.text, example.ref) == (1, "t", 3)
    assert {(r.sense_pos, r.subtype) for r in subtype(made, "sense").collect()} == {(0, "glosses"), (1, "other"), (2, "value"), (3, "other")}
    assert [(r.item_pos, r.payload) for r in subtype(made, "example", route="value").collect()] == [(2, '"odd"')]
    assert sum(r.n for r in variants(made).collect()) == made.count()


def test_automaton_states_are_shapes():
    a, b = TreeAutomaton(), TreeAutomaton()
    assert a.run({"x": 1, "y": ["s"]}) == b.run({"y": ["t", "u"], "x": 2.5})
    assert len({a.run(v) for v in ({"x": 1}, {"x": "1"}, {"x": None}, {"x": True}, {"x": []}, {"x": {}}, {"y": 1})}) == 7


def test_long_texts(spark):
    long = "あ" * 300_000
    made = supertype(rows(spark, [(1, json.dumps({"senses": [{"examples": [{"text": long}]}]}))]))
    assert subtype(made, "example").first().text == long


def test_no_field_is_lost_and_nested_lists_have_tables(spark):
    senses = [
        {"glosses": ["g"], "form_of": [{"word": "a", "tags": ["t"]}, "odd", {"word": "b"}], "sense_index": 3, "odd`one": True},
        {"glosses": "not a list", "more": [{"a": 0.5, "b": "x"}], "sense_index": 2.5, "payload": 1, "Glosses": 2, "mixed": "x"},
        {"mixed": ["y"], "form_of": [{"word": "c", "extra": 1}], "more": [{"a": 1}], "deep": [{"parts": [{"n": 1}]}], "pairs": [[1, 2]]},
    ]
    made = supertype(rows(spark, [(1, json.dumps({"senses": senses}))]))
    table = {r.sense_pos: r.asDict(True) for r in subtype(made, "sense").collect()}
    assert [json.loads(table[i]["payload"]) for i in range(3)] == senses
    assert [json.loads(x) if x[0] == "{" else x for x in table[0]["form_of"]] == senses[0]["form_of"]
    assert table[0]["odd`one"] is True and [table[i]["sense_index"] for i in range(3)] == [3.0, 2.5, None]
    assert table[1]["mixed"] == "x" and json.loads(table[2]["mixed"]) == ["y"]
    assert [table[i]["more"] for i in (1, 2)] == [[{"a": 0.5, "b": "x"}], [{"a": 1.0, "b": None}]]
    lists = nested(made)
    assert {(r.child_kind, r.sense_pos, r.path, r.list_pos) for r in lists.collect()} == {
        ("sense.form_of", 0, "form_of", 0), ("sense.form_of", 0, "form_of", 2), ("sense.form_of", 2, "form_of", 0), ("sense.more", 1, "more", 0), ("sense.more", 2, "more", 0), ("sense.deep", 2, "deep", 0), ("sense.deep.parts", 2, "deep[0].parts", 0), ("sense.pairs", 2, "pairs", 0),
    }
    assert [(r.list_pos, r.word, r.tags) for r in subtype(lists, "sense.form_of").orderBy("sense_pos", "list_pos").collect()] == [(0, "a", ["t"]), (2, "b", None), (0, "c", None)]


def test_a_variant_is_routed_to_its_own_columns(spark):
    made = supertype(rows(spark, [(1, json.dumps({"sounds": [{"audio": "a", "flag": True}, {"audio": "b", "note": "n"}]}))]))
    flagged = made.where("item_pos = 0").first().variant
    routed = subtype(made, "sound", flagged)
    assert routed.columns == ["source_line_number", "subtype", "sense_pos", "item_pos", "variant", "audio", "flag", "payload"]
    assert [(r.audio, r.flag) for r in routed.collect()] == [("a", True)]


def test_of_a_line_loaded_again_the_newest_content_counts(spark):
    old, new = (json.dumps({"sounds": [{"audio": a}] * n}) for a, n in (("old", 2), ("new", 1)))
    lines = spark.createDataFrame([(1, new, 2), (1, old, 1), (1, new, 2), (2, old, 1)], "source_line_number long, source_json string, loaded_at long")
    found = sorted((r.source_line_number, r.item_pos, json.loads(r.payload)["audio"]) for r in supertype(lines).collect())
    assert found == [(1, 0, "new"), (2, 0, "old"), (2, 1, "old")]
