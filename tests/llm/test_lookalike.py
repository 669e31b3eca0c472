import unicodedata

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from lexloom.llm import lookalike

SAME = [
    ("ＡＢ１", "AB1"), ("ｶﾞﾊﾟｰ", "ガパー"), ("が", "が"), ("é", "é"), ("⼠", "士"), ("亮", "亮"), ("a​b﻿", "ab"), ("a b", "a b"), ("　x ", "x"), ("а", "a"), ("Ο", "O"), ("ロ口", "口ロ"), ("へび", "ヘび"),
    ("ベ", "べ"), ("ギナ一", "ギナー"), ("ア―", "アー"), ("ホ·ル", "ホ・ル"), ("q̣̇", "q̣̇"), ("Å", "Å"), ("한", "한"), ("soft­hyphen", "softhyphen"), ("八゙", "バ"),
]
DIFFERENT = [("A", "a"), ("é", "e"), ("か", "が"), ("つ", "っ"), ("り", "リ"), ("ソ", "ン"), ("ab", "a b"), ("千", "チ"), ("ア", "ァ"), ("は", "ぱ"), ("x", "х" "y")]


def forms(spark, texts):
    rows = lookalike.canonical(spark.createDataFrame([(t, "c", 1) for t in texts], "text string, form string, at int")).collect()
    return {r.text: r.form for r in rows}


def test_pairs(spark):
    found = forms(spark, [x for pair in SAME + DIFFERENT for x in pair] + [None, "", " ", "​"])
    for a, b in SAME:
        assert found[a] == found[b], (a, b)
    for a, b in DIFFERENT:
        assert found[a] != found[b], (a, b)
    assert found[""] == found[" "] == found["​"] == "" and None not in found


def test_letters_of_other_alphabets_and_merely_similar_ones(spark):
    found = forms(spark, ["ν", "v", "ρ", "p", "Ꭺ", "A", "ɡ", "g", "ᴏ", "o", "α", "a", "Ⅴ", "γ", "y", "г", "r", "υ", "u", "ı", "i", "ɑ", "Ν", "n"])
    assert all(found[a] == found[b] for a, b in ("νv", "ρp", "ᎪA", "ɡg", "ᴏo"))
    assert all(found[a] != found[b] for a, b in ("αa", "γy", "гr", "υu", "ıi", "ɑa", "Νn"))


def test_texts_that_need_no_exploding_are_told_by_the_table(spark):
    import re

    table = lookalike.mapping(lookalike.same_shape(spark))
    plain = re.compile(re.sub(r"\\x\{([0-9a-f]+)\}", lambda m: re.escape(chr(int(m[1], 16))), lookalike.unchanged(table)))
    mapped = {c for c, _ in table}
    assert all(plain.match(t) for t in ("a", "a b", "かな", "漢字 仮名", "x  y")) and not any(plain.match(t) for t in ("", " a", "a ", "é", "ｱ", "a\u0301", "口", "へ", "각"))
    assert not any(plain.match(c) for c in mapped)


def test_pairs_of_a_set_in_byte_order(spark):
    texts = ["ab", "ａb", "a​b", "ab", None, "other"]
    got = {tuple(r) for r in lookalike.look_alikes(spark.createDataFrame([(t,) for t in texts], "text string")).collect()}
    three = sorted({"ab", "ａb", "a​b"}, key=str.encode)
    assert got == {(a, b) for i, a in enumerate(three) for b in three[i + 1 :]}
    assert lookalike.look_alikes(spark.createDataFrame([], "text string")).count() == 0


#: The shapes of a session, taken once for the comparison below.
SHAPES = [lookalike.SAME_SHAPE]


@pytest.fixture(autouse=True)
def shapes(spark):
    SHAPES[0] = lookalike.same_shape(spark)


def brute(text):
    """The same form by way of the standard library, one text at a time."""
    table = {c: "".join(x for x, _ in to) for c, to in lookalike.mapping(SHAPES[0])}
    return unicodedata.normalize("NFC", "".join(table.get(c, c) for c in text)).strip(" ")


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text(alphabet=st.one_of(st.characters(exclude_categories=("Cs", "Co", "Cn"), max_codepoint=0x2FFFF), st.sampled_from("かが゙゚ﾞｶaе̣́ ​")), max_size=12), min_size=20, max_size=60))
def test_against_the_standard_library(spark, texts):
    for text, form in forms(spark, texts).items():
        assert unicodedata.normalize("NFC", form) == brute(text), text


def test_long_text_is_whole(spark):
    text = "がｱ " * 30_000
    assert forms(spark, [text])[text] == ("がア " * 30_000).strip()


@pytest.mark.parametrize("c", ["ℎ", "①", "²", "㌔"])
def test_compatibility_characters_stay(spark, c):
    assert forms(spark, [c])[c] == c
