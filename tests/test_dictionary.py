import hashlib
import json

import pytest
from pyspark.sql import functions as F

from lexloom.operators import audio, catalog, keys, lookup, order, pack, project
from lexloom.sources import jsonl
from lexloom.streaming.ingest import ingest

IDENTITY = {
    "pack_id": "xx-lexicon", "corpus_language": "xx", "wiktionary_edition": "xxwiktionary", "wiktionary_dump_date": "2026-01-01", "kaikki_extraction_date": "2026-01-02", "source_url": "https://x.example/a",
    "compressed_source_sha256": "0" * 64, "uncompressed_source_sha256": "1" * 64, "wiktextract_revision": "a", "wikitextprocessor_revision": "b", "builder_revision": "c", "target_shard_payload_bytes": 1,
    "source_manifest": "{}", "license_manifest_json": "{}", "minimum_app_version": "1",
}


def write(path, *records, raw=b""):
    path.write_bytes(b"".join(json.dumps(r, ensure_ascii=False).encode() + b"\n" for r in records) + raw)
    return str(path)


def rec(word, *forms, **more):
    return {"word": word, "lang_code": "xx", "forms": [{"form": f} for f in forms]} | more


def table(spark, path):
    good = jsonl.select(jsonl.lines(spark, path), "xx").where("error is null")
    good = order.prefix_sum(good, [], "line_number", F.lit(1).cast("long"), "selected_ordinal")
    return keys.key_table(good)


def test_lines_offsets_endings_and_errors(spark, tmp_path):
    raw = b'{"word":"a","lang_code":"xx"}\r\n\n\xff\n[1]\n{"lang_code":"yy"}\n{"lang_code":1}\n{"lang_code":"xx","word":""}\n{"a":1,"a":2}\n{"lang_code":"xx","word":"w","forms":[{}]}\n{"word":"z","lang_code":"xx"}\r'
    path = tmp_path / "x.jsonl"
    path.write_bytes(raw)
    rows = sorted(jsonl.lines(spark, str(path)).collect(), key=lambda r: r.line_number)
    parts = raw.split(b"\n")
    assert [r.line_number for r in rows] == list(range(1, len(parts) + 1))
    assert [r.byte_offset for r in rows] == [sum(len(p) + 1 for p in parts[:i]) for i in range(len(parts))]
    assert bytes(rows[0].source_bytes).endswith(b"}") and bytes(rows[-1].source_bytes).endswith(b"\r")
    found = {r.line_number: (r.word, r.error) for r in jsonl.select(jsonl.lines(spark, str(path)), "xx").collect()}
    assert found == {
        1: ("a", None), 2: (None, "is empty"), 3: (None, "is not UTF-8 (valid through byte 0)"), 4: (None, "is not a JSON object"), 6: (None, "has number `lang_code`; expected a string"), 7: (None, "has an empty `word`"),
        8: (None, "is malformed JSON"), 9: (None, "has no `forms[0].form`"), 10: ("z", None),
    }
    assert jsonl.capture_facts(spark, str(path)).first().line_feeds == raw.count(b"\n")


def test_index_and_stages(spark, tmp_path):
    path = write(tmp_path / "x.jsonl", rec("Straße"), rec("strasse"), rec("strasse"))
    index = table(spark, path)
    ask = lambda q, limit=20: sorted((r.match_class, r.selected_ordinal, r.truncated) for r in lookup.lookup(spark.createDataFrame([(q,)], "query string"), index, limit).collect())
    assert ask("strasse", 1) == [(1, 1, True)]
    assert ask("STRASSE") == [(3, 0, False), (3, 1, False), (3, 2, False)]
    assert ask("") == [] and ask("nowhere") == []
    with pytest.raises(ValueError):
        ask("x", 101)
    assert table(spark, write(tmp_path / "y.jsonl", rec("one"), rec("run", "Ran", "ran"))).count() == 11
    forms = {(r.match_class, r.key): r.authored_key_ordinal for r in table(spark, write(tmp_path / "z.jsonl", rec("x", "", "-", "CAFÉ", "CAFÉ", "café"))).collect()}
    assert forms[6, "café"] == 0 and forms[4, "CAFÉ"] == 1


def test_key_differences_are_multisets(spark):
    a = spark.createDataFrame([(1, "x"), (1, "x"), (2, None)], "n int, key string")
    b = spark.createDataFrame([(1, "x"), (3, "y"), (2, None)], "n int, key string")
    assert {tuple(r) for r in keys.differences(a, b, ["n", "key"]).collect()} == {(1, "x", "missing", 1), (3, "y", "surplus", 1)}


def test_views_and_outcomes(spark):
    views = spark.createDataFrame([(0, "fr"), (1, "ja"), (2, "en-GB"), (3, "ja-Jpan")], "view_pos int, language string")
    place = lambda hint: [r.view_pos for r in lookup.view_order(views, hint).orderBy("place").collect()]
    assert place("ja-Jpan") == [1, 3, 0, 2] and place("EN_gb") == [2, 0, 1, 3] and place(None) == [0, 1, 2, 3]
    bad = spark.createDataFrame([("a", "", 1), ("b", None, 1), ("b", "en", 2), ("", None, 3)], "view_id string, target_language string, x int")
    assert sorted(r.error for r in lookup.view_errors(bad).collect()) == ["duplicate view id", "duplicate view id", "empty target language", "empty view id"]
    row = spark.range(1).select(*[lookup.outcome(F.lit(True), F.lit(f), F.lit(n), F.lit(t), F.lit(l).cast("string")).alias(str(i)) for i, (f, n, t, l) in enumerate([(True, 1, 1, None), (False, 0, 0, None), (False, 2, 0, "en"), (False, 2, 1, "en"), (False, 2, 0, None)])]).first()
    assert list(row) == ["Failed", "NoEntry", "NoTranslation", "Completed", "Completed"]


def test_pack_round_trip_and_tampering(spark, tmp_path):
    path = write(tmp_path / "x.jsonl", rec("one"), {"word": "other", "lang_code": "yy"}, rec("two", "twos"), rec("three"))
    out = str(tmp_path / "pack")
    manifest = pack.build(spark, IDENTITY, path, out)
    assert (manifest["record_count"], manifest["shards"]) == (3, 3)
    tables = pack.open_pack(spark, out, "verify", manifest["pack_revision"])
    first = min(tables["entries"].collect(), key=lambda r: r.selected_ordinal)
    body = json.dumps(rec("one"), ensure_ascii=False).encode()
    assert bytes(first.record_sha256) == hashlib.sha256(body).digest()
    assert pack.build(spark, IDENTITY, path, str(tmp_path / "again"))["selected_stream_sha256"] == manifest["selected_stream_sha256"]
    with pytest.raises(pack.PackError):
        pack.build(spark, IDENTITY, path, out)
    with pytest.raises(pack.PackError):
        pack.open_pack(spark, out, "installed", "f" * 64)
    broken = tables | {"lookup_keys": tables["lookup_keys"].where("match_class <> 4")}
    assert {r.check for r in pack.checks(broken, manifest).where("n_bad > 0").collect()} == {"keys"}
    broken = tables | {"entries": tables["entries"].withColumn("byte_offset", F.col("byte_offset") + 1)}
    assert "facts_agree" in {r.check for r in pack.checks(broken, manifest).where("n_bad > 0").collect()}
    bad = write(tmp_path / "bad.jsonl", rec("x"), raw=b"{\n")
    with pytest.raises(pack.PackError, match="line 2"):
        pack.build(spark, IDENTITY, bad, str(tmp_path / "none"))
    assert not (tmp_path / "none").exists()


def test_prefix_sums_and_greedy_shards(spark):
    rows = spark.createDataFrame([("g", i * 40_000, i + 1) for i in range(12)], "g string, o long, n long")
    got = sorted((r.o, r.s) for r in order.prefix_sum(rows, ["g"], "o", F.col("n"), "s").collect())
    assert got == [(i * 40_000, i * (i + 1) // 2) for i in range(12)]
    assert [r["shard"] for r in order.greedy_shards(rows, "g", "o", "n", 7).orderBy("o").collect()] == [0, 0, 0, 1, 2, 3, 4, 5, 6, 7, 8, 9]


RICH = {
    "word": "run", "lang_code": "en", "lang": "English", "pos": "verb", "etymology_texts": ["one", "two"], "etymology_number": 2, "tags": ["x"],
    "sounds": [{"ipa": "r", "audio": "File:en_run.ogg", "zh_pron": "z"}, {"audio": "none"}], "forms": [{"form": "ran", "ipa": "a", "ipas": ["b"], "ruby": [["a", "b"]]}],
    "senses": [{"glosses": ["g"], "note": "n", "notes": ["m"], "examples": [{"text": "t", "english": "e", "bold_text_offsets": [[0, 1]]}], "translations": [{"word": "courir", "code": "fr"}], "form_of": [{"word": "x"}]}],
    "translations": [{"word": "laufen", "lang_code": "de"}, {"word": "courir", "lang_code": "fr"}, {"note": "see", "code": "fr"}], "synonyms": [{"word": "dash"}], "contraction": [{"word": "c"}],
    "descendants": [{"word": "a", "descendants": [{"word": "b"}]}, {"word": "c"}], "unknown": {"kept": None},
}


def entry(spark, record, bounds=project.EXHAUSTIVE, target=None):
    df = spark.createDataFrame([(1, json.dumps(record))], "n int, body string")
    return project.entries(df, "body", bounds, target).first()


def test_projection(spark):
    e = entry(spark, RICH).entry
    assert (e.headword, e.etymology_number, e.etymology["items"], e.pronunciations["items"][0].audio, e.pronunciations["items"][0].zh_pronunciation, e.pronunciations["items"][1].audio) == ("run", "2", ["one", "two"], "En run.ogg", "z", None)
    assert e.forms["items"][0].ipa == ["a", "b"] and e.forms["items"][0].ruby[0].text == "b"
    sense = e.senses["items"][0]
    assert sense.notes == ["n", "m"] and sense.examples["items"][0].translation == "e" and sense.form_of[0].word == "x"
    assert [g.kind for g in e.relations] == ["synonyms", "contractions"]
    assert [(d.depth, d.word) for d in e.descendants["items"]] == [(0, "a"), (1, "b"), (0, "c")]
    fr = entry(spark, RICH, target="fr").entry
    assert (fr.translations.total, fr.sense_translation_total, fr.translations["items"][1].note) == (2, 1, "see")
    small = entry(spark, RICH, project.Bounds(text_bytes=2, strings=1, translations=1, senses=0)).entry
    assert small.headword == "ru" and small.truncated and small.senses["total"] == 1 and small.senses["items"] == [] and len(small.translations["items"]) == 1


@pytest.mark.parametrize(
    "field,value",
    [
        ("lang", None), ("pos", 1), ("tags", "x"), ("tags", [1]), ("senses", {}), ("senses", [1]), ("forms", [{"form": 1}]), ("forms", [{"ruby": [["a"]]}]), ("sounds", [{"not_same_pronunciation": "yes"}]), ("etymology_text", 1),
        ("etymology_number", -1), ("etymology_number", 1.5), ("etymology_number", True), ("translations", [{}]), ("translations", [{"word": "x", "lang_code": 1}]), ("descendants", [{"descendants": 1}]), ("form_of", [{}]),
        ("senses", [{"examples": [{"bold_text_offsets": [[2, 1]]}]}]), ("synonyms", [None]), ("notes", [1]),
    ],
)
def test_wrong_shapes_name_the_field(spark, field, value):
    row = entry(spark, RICH | {field: value})
    assert row.entry is None and field in row.error


def test_sections(spark):
    df = spark.createDataFrame([(1, json.dumps(RICH)), (2, "{"), (3, None)], "n int, body string")
    rows = {r.n: r for r in project.section(df, "n", "body", "descendants", 1, 1).collect()}
    assert (rows[1].total, json.loads(rows[1].page)[0]["word"]) == (3, "b") and rows[2].error and rows[3].error
    assert {r.n: r for r in project.section(df, "n", "body", "examples", 0, 5, sense=4).collect()}[1].error == "no such sense: 4"
    with pytest.raises(ValueError):
        project.section(df, "n", "body", "forms", 0, 257)


def test_recordings(spark):
    names = spark.createDataFrame([("File:a_b.ogg",), ("A b.ogg",), ("bad",), (None,)], "audio string")
    assert {(r.file_name, r.authored, r.n) for r in audio.references(names).collect()} == {("A b.ogg", None, 2), (None, "bad", 1)}
    words = spark.createDataFrame([("x", None), ("x", None), (None, None), ("a", "u")], "s string, u string")
    known = audio.dictionary(words, ["s", "u"], "o")
    assert sorted((r.o, r.s) for r in known.collect()) == [(0, "a"), (1, "x")]
    assert sorted(str(r.o) for r in audio.encoded(words, known, ["s", "u"], "o").collect()) == ["0", "1", "1", "None"]
    titles, hops = spark.createDataFrame([("a",), ("z",)], "title string"), spark.createDataFrame([("a", "b"), ("b", "c")], "source string, target string")
    assert {tuple(r) for r in audio.resolve_aliases(titles, hops).collect()} == {("a", "c"), ("z", "z")}
    page = json.dumps({"title": "File:A.ogg", "imageinfo": [{"sha1": "x", "size": 5, "url": "https://u?x=1", "extmetadata": {"Artist": {"value": "me"}, "AttributionRequired": {"value": "true"}}}]})
    facts = audio.page_facts(spark.createDataFrame([(page,), ('{"title": "File:B", "missing": ""}',), ("{",)], "page string")).collect()
    assert (facts[0].source_size_bytes, facts[0].original_url, facts[0].attribution_required) == (5, "https://u", True) and facts[1].source_sha1 is None and facts[2].source_title is None


FACTS = "file_name string, status int, reason string, reference_count long, source_title string, source_sha1 binary, source_timestamp string, source_media_type string, source_size_bytes long, description_url string, license_short_name string, license_identifier string, license_url string, author_text string, author_urls array<string>, attribution_required boolean, blob_sha256 string, blob_size_bytes long"


def test_collection_round_trip(spark, tmp_path):
    rows = [
        ("A.ogg", 1, None, 2, "File:A.ogg", b"1" * 20, "t", "audio/ogg", 5, "https://commons.wikimedia.org/wiki/File:A.ogg", "CC0", None, None, "me", ["https://u"], True, "aa", 7),
        ("B.ogg", 1, None, 1, "File:Other.ogg", b"2" * 20, "t", "audio/ogg", 5, "https://elsewhere", "CC0", None, None, "", [], False, "aa", 7),
        ("C.ogg", 3, "missing", 1, None, None, None, None, None, None, None, None, None, None, [], None, None, None),
    ]
    df = spark.createDataFrame(rows, FACTS)
    meta = {"pack_id": "p", "corpus_language": "xx", "source_corpus_pack_id": "c", "source_corpus_revision": "ab" * 32, "acquired_at": "t", "delivery": "remote", "builder_revision": "b", "minimum_app_version": "1", "encoder_profile": "", "format_version": 1}
    revision = audio.build_collection(df, str(tmp_path / "a"), meta, 3)
    assert audio.build_collection(df.orderBy(F.desc("file_name")), str(tmp_path / "b"), meta, 3) == revision
    tables = audio.open_collection(spark, str(tmp_path / "a"), revision)
    back = {r.file_name: r for r in tables["recordings"].collect()}
    assert (back["A.ogg"].source_title, back["A.ogg"].description_url, back["A.ogg"].author_urls, back["A.ogg"].license_short_name) == ("File:A.ogg", rows[0][9], ["https://u"], "CC0")
    assert (back["B.ogg"].source_title, back["B.ogg"].description_url, back["B.ogg"].author_text, back["C.ogg"].source_title) == ("File:Other.ogg", "https://elsewhere", None, None)
    assert audio.collection_errors(tables).where("n_bad > 0").count() == 0
    broken = tables | {"recordings": tables["recordings"].withColumn("reason", F.lit("x"))}
    assert [r.check for r in audio.collection_errors(broken).where("n_bad > 0").collect()] == ["status"]
    with pytest.raises(ValueError):
        audio.open_collection(spark, str(tmp_path / "a"), "0" * 64)
    found = spark.createDataFrame([("b", None, 1), ("a", None, 2), (None, "bad", 3)], "file_name string, authored string, n long")
    assert json.loads(audio.reference_set(found)) == {"schema_version": 1, "files": [["a", 2], ["b", 1]], "invalid": [["bad", 3]]}


def ogg(serial, flags, granule, body):
    return b"OggS\0" + bytes([flags]) + granule.to_bytes(8, "little", signed=True) + serial + bytes(8) + bytes([1, len(body)]) + body


def test_opus_length(spark):
    head = b"OpusHead\1\1" + (312).to_bytes(2, "little") + bytes(7)
    good = ogg(b"abcd", 2, 0, head) + ogg(b"abcd", 0, 48000, b"x") + ogg(b"abcd", 4, 96312, b"y")
    assert audio.opus_milliseconds(good) == 2000
    assert audio.opus_milliseconds(good + b"z") is None and audio.opus_milliseconds(good[:-1]) is None and audio.opus_milliseconds(b"") is None
    assert [r[0] for r in spark.createDataFrame([(good,), (None,)], "b binary").select(audio.opus_duration("b")).collect()] == [2000, None]


RELEASE = {"pack_id": "p", "pack_revision": "r", "minimum_app_version": "1", "installed_bytes": 3, "assets": [{"file_name": "manifest.json", "url": "https://x", "size_bytes": 1}, {"file_name": "b", "url": "https://x", "size_bytes": 2}]}
CORPUS = {"pack_type": "corpus", "manifest_file": "manifest.json", "corpus_language": "ja", "wiktionary_edition": "e", "wiktionary_dump_date": "d", "monolingual": True, "bilingual_targets": ["en"], "licenses": ["x"], "release": RELEASE}


def test_catalogues(spark):
    good = {"catalog_version": 1, "catalog_revision": "a", "generated_at": "b", "packs": [CORPUS]}
    bad = [
        good | {"catalog_version": 2}, good | {"extra": 1}, good | {"packs": [CORPUS, CORPUS]}, good | {"packs": [CORPUS | {"bilingual_targets": ["ja"]}]}, good | {"packs": [CORPUS | {"licenses": []}]},
        good | {"packs": [CORPUS | {"release": RELEASE | {"installed_bytes": 4}}]}, good | {"packs": [CORPUS | {"manifest_file": "m"}]}, good | {"packs": [CORPUS | {"release": RELEASE | {"assets": []}}]},
    ]
    docs = spark.createDataFrame([(i, json.dumps(d)) for i, d in enumerate([good, *bad])] + [(98, "{"), (99, None)], "n int, body string")
    assert {r.n for r in catalog.errors(docs, "n", "body", catalog.catalog_errors).collect()} == {*range(1, 9), 98, 99}
    sizes = catalog.installed_sizes(catalog.assets(docs.where("n = 0"), "body")).first()
    assert sizes.agrees and sizes.asset_bytes == 3
    assert json.loads(catalog.assemble([CORPUS], "a", "b")) == good
    assert catalog.manifest_errors({"manifest_version": 1, "format_version": 1, "record_count": 1, "uncompressed_bytes": 1, "assets": [{"role": "index", "file_name": "i", "size_bytes": 1}, {"role": "data", "file_name": "d", "size_bytes": 1}]}) == []


def test_snapshots():
    edition = {"schema_version": 1, "wiktionary_edition": "e", "corpus_language": "ja", "pack_id": "p", "origin": {"source_url": "s", "info_url": "i"}, "target_shard_payload_bytes": 1, "license_manifest": {}, "minimum_app_version": "1"}
    snapshot = {
        "schema_version": 1, "wiktionary_edition": "e", "captured_at": "2026-01-03", "dump_date": "2026-01-01", "extraction_date": "2026-01-02", "origin": {"source_url": "s", "info_url": "i"}, "wiktextract_revision": "a",
        "wikitextprocessor_revision": "b", "compressed": {"size_bytes": 3, "sha256": "f" * 64}, "uncompressed": {"size_bytes": 9, "sha256": "e" * 64, "line_count": 1},
        "mirror": {"repository": "o/n", "release_tag": "source-e-20260101-ffffffffffff", "parts": [{"file_name": "a", "size_bytes": 3}], "info_page": {"file_name": "i", "size_bytes": 1}},
    }
    assert catalog.snapshot_errors({"edition": edition, "snapshot": snapshot}) == []
    assert catalog.corpus_identity(edition, snapshot, "x")["kaikki_extraction_date"] == "2026-01-02"
    for change in ({"extraction_date": "2025-01-01"}, {"dump_date": "x"}, {"wiktextract_revision": ""}, {"wiktionary_edition": "z"}, {"compressed": {"size_bytes": 4, "sha256": "f" * 64}}):
        with pytest.raises(ValueError):
            catalog.corpus_identity(edition, snapshot | change, "x")


def test_streaming_ingest(spark, tmp_path):
    (tmp_path / "in").mkdir()
    run = lambda: ingest(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "check"), "xx").awaitTermination()
    write(tmp_path / "in" / "a.jsonl", rec("a"), rec("b"), {"lang_code": "yy"}, raw=b"{\n")
    run()
    write(tmp_path / "in" / "b.jsonl", rec("c"))
    run()
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted((r.word or "", r.error or "") for r in rows) == [("", "is malformed JSON"), ("a", ""), ("b", ""), ("c", "")]


def test_release_and_route_differences(spark):
    schema = "file_name string, size_bytes long, sha256 string"
    declared = spark.createDataFrame([("a", 1, "x"), ("b", 2, None), ("c", 3, "x"), ("d", 4, "x"), ("e", 5, "x")], schema)
    published = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y"), ("c", 9, "x"), ("d", 4, "z"), ("f", 1, "x")], schema)
    assert {tuple(r) for r in catalog.published_differences(declared, published).collect()} == {("c", "size differs"), ("d", "digest differs"), ("e", "not published")}
    assert {tuple(r) for r in catalog.route_differences(declared.where("file_name < 'c'"), published.where("file_name in ('b', 'f')")).collect()} == {("a", "surplus"), ("f", "missing")}
    docs = spark.createDataFrame([(0, json.dumps({"catalog_version": 1, "catalog_revision": "a", "generated_at": "b", "packs": [CORPUS | {"release": RELEASE | {"assets": [{"file_name": "manifest.json", "url": "https://x/tag-1/manifest.json", "size_bytes": 3, "sha256": "s"}]}}]}))], "n int, body string")
    rows = catalog.assets(docs, "body")
    assert [(r.tag, r.n_tags) for r in catalog.release_tags(rows).collect()] == [("tag-1", 1)]
    assert catalog.expected_pack(rows, "p", "r", "manifest.json").first().sha256 == "s" and catalog.expected_pack(rows, "p", "q", "manifest.json").count() == 0


def test_package_is_sent_where_it_is_missing(spark):
    from lexloom.tables import ship

    ship(spark)
    ship(spark)
    assert spark.range(4).mapInPandas(lambda it: (__import__("pandas").DataFrame({"n": [len(__import__("lexloom").__name__)] * len(p)}) for p in it), "n long").first().n == 7
