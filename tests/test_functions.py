import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexloom.functions import digest, text, unicode
from lexloom.functions.strict_json import DuplicateKey, loads_object, loads_strict


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "v string").select(f(F.col("v")).alias("x")).first().x


def framed(*parts):
    return b"".join(len(p).to_bytes(8, "big") + p for p in parts)


def test_folding_keeps_what_casing_loses(spark):
    assert one(spark, "Straße", unicode.folded) == "strasse"
    assert one(spark, "ΣΊΣΥΦΟΣ", unicode.folded) == "σίσυφοσ"
    assert one(spark, "café ", unicode.lookup_keys) == ["café ", "café ", "café "]
    assert one(spark, None, unicode.nfc) is None


@pytest.mark.parametrize("value,limit", [("abc", 3), ("abcd", 3), ("ねこ", 4), ("ねこ", 3), ("ねこ", 2), ("😀x", 4), ("😀x", 3), ("", 5)])
def test_bounded(spark, value, limit):
    got = one(spark, value, lambda c: unicode.bounded(c, limit))
    assert (got.value, got.truncated) == (value.encode()[:limit].decode("utf-8", "ignore"), len(value.encode()) > limit)


def test_frames_and_identities(spark):
    row = spark.createDataFrame([("ab" * 32, 7, bytes(32), None)], "r string, n long, s binary, z string")
    got = row.select(digest.entry_id(F.col("r"), F.col("n"), F.col("s")), F.sha2(F.concat(digest.optional(F.col("z")), digest.optional(F.col("r"))), 256)).first()
    assert got[0] == hashlib.sha256(framed(b"ELDICT-ENTRY-ID-V1", bytes.fromhex("ab" * 32), (7).to_bytes(8, "big"), bytes(32))).hexdigest()
    assert got[1] == hashlib.sha256(b"\0" + b"\1" + framed(b"ab" * 32)).hexdigest()


def test_routing(spark):
    names = ["", "a", "Ja-neko.ogg", "猫.opus", "x" * 300]
    rows = spark.createDataFrame([(n,) for n in names], "v string").select("v", digest.chunk_for(F.col("v"), 7).alias("c"), digest.fnv_shard(F.col("v"), 5).alias("s")).collect()
    for r in rows:
        assert r.c == int.from_bytes(hashlib.sha256(r.v.encode()).digest()[:8], "big") % 7
        h = 14695981039346656037
        for b in r.v.encode():
            h = (h ^ b) * 1099511628211 % 2**64
        assert r.s == h % 5 + 1
    with pytest.raises(ValueError):
        digest.chunk_for(F.col("v"), 0)


@pytest.mark.parametrize(
    "authored,expected",
    [
        ("Ja-neko.ogg", "Ja-neko.ogg"), ("File:File:ja_neko.ogg", "Ja neko.ogg"), ("file:a.b", "A.b"), ("  x　 y__z.oga ", "X y z.oga"), ("caf%C3%A9.ogg", "Café.ogg"), ("bad%zz.ogg", "Bad%zz.ogg"), ("%FF.ogg", "%FF.ogg"),
        ("nodot", None), ("", None), ("a/b.ogg", None), ("a|b.ogg", None), ("ß.ogg", "SS.ogg"), ("a\tb.ogg", "A b.ogg"), ("a" * 260 + ".x", None), (None, None),
    ],
)
def test_file_names(spark, authored, expected):
    assert one(spark, authored, text.commons_file_name) == expected


def test_description_url(spark):
    assert one(spark, "File:A b (c)~é*;.ogg", text.description_url) == text.PAGE + "File:A_b_(c)~%C3%A9*;.ogg"


def test_predicates(spark):
    check = lambda f, good, bad: [one(spark, v, f) for v in good + bad] == [True] * len(good) + [False] * len(bad)
    assert check(text.is_pack_id, ["a", "ja-lexicon", "a" * 64], ["", "A", "1a", "a-", "a--b", "a" * 65])
    assert check(text.is_hex_digest, ["0" * 64], ["0" * 63, "A" * 64])
    assert check(text.is_iso_date_prefix, ["2026-09-01", "2026-09-01T00"], ["2026-9-1", ""])
    assert check(text.is_catalog_asset, ["a.b", "_x"], [".x", "", "a/b", "é"])
    assert check(text.is_routed_form, ["x", " "], ["", "-"])
    assert check(text.is_safe_file_name, ["a b", "x.y"], ["", "..", "a/b", "a\\b"])
    assert one(spark, "EN_gb", text.primary_subtag) == "en"


def test_author_markup():
    assert text.author_of('<a href="//x.example/a?b&amp;c" title="t">A &lt;B&gt;</a><br>line   two <b>x') == ("A <B>\nline two x", ["https://x.example/a?b&c"])
    assert text.author_of("a < b") == ("a", [])
    assert text.author_of('<p>x</p><a href=http://y>y</a><a href="http://y">z</a><a href="/rel">w</a>') == ("x\nyzw", ["http://y"])
    assert text.decode_entities("?a=1&#38;b=2&#x26;c=3&#38;lt;&amp;#38;&#xD800;&#9999999;&#x110000;") == "?a=1&b=2&c=3&lt;&#38;&#xD800;&#9999999;&#x110000;"
    assert text.author_of('<a href="https://x.example/?a=1&#38;b=2">A &#38; B</a>') == ("A & B", ["https://x.example/?a=1&b=2"])
    assert text.decode_entities("&amp;lt; &#x41;&#66; &bogus; &#39;&nbsp;|& ;") == "&lt; AB &bogus; ' |& ;"


def test_strict_objects():
    assert loads_object('{"a": 1}') == {"a": 1}
    for bad in (None, "", "[]", "1", '{"a": NaN}', '{"a":1} x', "{'a': 1}", '{"a": "\\ud800"}', "{" * 5000):
        assert loads_object(bad) is None
    with pytest.raises(DuplicateKey):
        loads_strict('{"a": 1, "a": 2}')
    assert loads_strict('{"a": {"b": 1, "b": 2}}') == {"a": {"b": 2}}


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=40))
def test_percent_decoding_round_trip(value):
    coded = "".join(f"%{b:02X}" if random.Random(i).random() < 0.5 or b >= 128 or b == 37 else chr(b) for i, b in enumerate(value.encode("utf-8", "surrogatepass")))
    if "\ud800" <= max(value, default="a") <= "\udfff":
        return
    assert text.percent_decoded(coded) == value or coded == value
