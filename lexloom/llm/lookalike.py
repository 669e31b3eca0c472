"""One consistent form for texts that look the same (problem 4).

Texts are exploded to positioned code points and joined with one broadcast table that says what
each code point becomes: nothing (no visible glyph), a plain space, its canonical or width
decomposition, or the letter of the same shape. Combining marks are put in order of their
class, the pieces are rebuilt and recomposed. The table follows from the character database and
the confusables of the Unicode library that Spark ships, by rule, and has some fourteen
thousand rows, whatever the data. Texts of code points that stay as they are need no exploding.
"""

from __future__ import annotations

import sys
import unicodedata
from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.tables import materialized

#: Letters and signs that have the same shape as one of another script or block.
SAME_SHAPE = {
    # Cyrillic
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "Х": "X", "Ѕ": "S", "І": "I", "Ј": "J", "Ү": "Y", "Ԛ": "Q", "Ԝ": "W", "Ғ": "F",
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "ѕ": "s", "і": "i", "ј": "j", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w",
    # Greek
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "ο": "o", "ϳ": "j",
    # Armenian
    "Օ": "O", "օ": "o", "ց": "g",
    # Han and kana
    "口": "ロ", "囗": "ロ", "二": "ニ", "力": "カ", "工": "エ", "八": "ハ", "夕": "タ", "卜": "ト", "丿": "ノ", "へ": "ヘ",
    # Long strokes
    "一": "ー", "—": "ー", "―": "ー", "─": "ー",
    # Dots between words
    "·": "・", "‧": "・", "•": "・", "∙": "・", "⋅": "・", "ᐧ": "・",
    # Hyphens
    "‐": "-", "‑": "-", "−": "-", "﹣": "-",
}

#: Scripts whose letters of one case look like Latin letters of that case, by the first word of their names.
ALPHABETS = {"GREEK", "CYRILLIC", "CHEROKEE", "COPTIC", "LISU", "DESERET"}
#: Letters that the confusables hold for others but that are merely similar.
MERELY_SIMILAR = set("αγισυͷᴦгѡҽѵУҮүꙇӏⲅꭵꮁ𐐕𐐛𐐠𐐽𐑈")

#: Characters without a glyph that aren't format or control characters.
NO_GLYPH = ["͏", "ᅟ", "ᅠ", "ㅤ", "ﾠ", "឴", "឵", *map(chr, range(0x180B, 0x1810)), *map(chr, range(0xFE00, 0xFE10)), *map(chr, range(0xE0100, 0xE01F0))]

#: Blocks whose compatibility decomposition is another code point for the same character.
SAME_CHARACTER = [range(0x2E80, 0x2FD6), range(0x2160, 0x2180), range(0xF900, 0xFB00), range(0x2F800, 0x2FA20)]

#: Code points in one piece; a piece also takes the marks that follow it, so none is cut from its base.
PIECE = 256


@cache
def alphabets() -> str:
    """Letters of ALPHABETS, small capitals and the script g, which may look like plain Latin letters."""
    named = ((chr(n), unicodedata.name(chr(n), "")) for n in range(0x100, 0x20000) if unicodedata.category(chr(n)) in ("Lu", "Ll"))
    return "".join(c for c, name in named if c not in MERELY_SIMILAR and (name.split(" ")[0] in ALPHABETS or name.startswith("LATIN LETTER SMALL CAPITAL ") and name[-2:] in (" C", " O", " S", " V", " W", " Z") or name == "LATIN SMALL LETTER SCRIPT G"))


def same_shape(spark: SparkSession) -> dict[str, str]:
    """SAME_SHAPE and the letters that the Unicode library's confusables give the shape of one Latin letter of the same case."""
    jvm = getattr(spark, "_jvm", None)
    if jvm is None:  # no driver JVM at hand: the fixed values alone
        return dict(SAME_SHAPE)
    latin = "".join(map(chr, [*range(65, 91), *range(97, 123)]))
    letters = latin + alphabets()
    skeletons = jvm.com.ibm.icu.text.SpoofChecker.Builder().build().getSkeleton("\n".join(letters)).split("\n")
    shape = dict(zip(letters, skeletons, strict=True))
    owner = {(shape[c], c.isupper()): c for c in latin}
    found = {c: owner[shape[c], unicodedata.category(c) == "Lu"] for c in alphabets() if (shape[c], unicodedata.category(c) == "Lu") in owner}
    return {c: to for c, to in found.items() if unicodedata.normalize("NFD", c) == c} | SAME_SHAPE


def _one(c: str, same: dict[str, str]) -> str:
    """What ``c`` becomes in a decomposed text."""
    if c.isspace() or unicodedata.category(c) in ("Zs", "Zl", "Zp"):
        return " "
    if c in NO_GLYPH or unicodedata.category(c) in ("Cf", "Cc"):
        return ""
    kind, _, target = unicodedata.decomposition(c).partition("> ")
    if not target:
        parts = unicodedata.normalize("NFD", c)
        return same.get(c, c) if parts == c else "".join(_one(p, same) for p in parts)
    if kind in ("<wide", "<narrow") or any(ord(c) in r for r in SAME_CHARACTER) and len(target.split()) == 1:
        return "".join(_one(chr(int(x, 16)), same) for x in target.split())
    return same.get(c, c)


_tables: dict[frozenset, list] = {}


def mapping(same: dict[str, str] = SAME_SHAPE) -> list[tuple[str, list[tuple[str, int]]]]:
    """(code point, [(code point, combining class)]) of all that change or are combining."""
    out = _tables.get(frozenset(same.items()))
    if out is None:
        out = _tables[frozenset(same.items())] = []
        for n in range(sys.maxunicode + 1):
            c = chr(n)
            if 0xD800 <= n < 0xE000 or unicodedata.category(c) in ("Cn", "Co"):
                continue
            to = _one(c, same)
            if to != c or unicodedata.combining(c):
                out.append((c, [(x, unicodedata.combining(x)) for x in to]))
    return out


#: Blocks in which no two code points compose: ASCII, kana, Han.
PLAIN = [range(0x21, 0x7F), range(0x3041, 0x3097), range(0x30A1, 0x30FB), range(0x4E00, 0xA000)]


def unchanged(table: list[tuple]) -> str:
    """A pattern of texts in which every code point of PLAIN stays as it is; spaces only between others."""
    mapped = {ord(c) for c, _ in table}
    ranges: list[list[int]] = []
    for n in (n for block in PLAIN for n in block if n not in mapped):
        if ranges and ranges[-1][1] == n - 1:
            ranges[-1][1] = n
        else:
            ranges.append([n, n])
    kept = "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in ranges)
    return f"^[{kept}](?:[{kept} ]*[{kept}])?$"


def canonical(texts: DataFrame, column: str = "text") -> DataFrame:
    """(text, form) for each distinct text: texts that look the same get equal forms, all others distinct ones.

    White space of any kind becomes a space, none stays at either end; runs of spaces stay
    runs. Case, accents, voicing marks and the size of kana stay. A null text gives no row, an
    empty text and one without any glyph the form ''. Texts of any length are read whole, in
    pieces that keep marks with their bases. One shuffle by number serves both groupings.
    """
    # Rows of code points carry a number instead of their text; the text itself goes with the first one only.
    spark = texts.sparkSession
    table = mapping(same_shape(spark))
    known = materialized(texts.select(F.col(column).alias("text")).where("text is not null").distinct().withColumn("id", F.monotonically_increasing_id()).withColumn("stays", F.col("text").rlike(unchanged(table))))
    stay, known = known.where("stays").select("text", F.col("text").alias("form")), known.where("not stays").drop("stays")
    cut = F.regexp_extract_all("text", F.lit(r"(?s).{1,%d}[\p{M}\p{Cf}ﾞﾟᅠ-ᇿ]*" % PIECE), F.lit(0))
    pieces = known.repartition("id").select("id", "text", F.posexplode_outer(cut).alias("piece", "part")).withColumn("own", F.when(F.coalesce("piece", F.lit(0)) == 0, F.col("text")))
    points = pieces.select("id", "piece", "own", F.posexplode_outer(F.split(F.coalesce("part", F.lit("")), "")).alias("at", "ch")).withColumn("own", F.when(F.coalesce("at", F.lit(0)) == 0, F.col("own")))
    # The table is built by rule and bounded by the character set.
    joined = points.join(F.broadcast(spark.createDataFrame(table, "ch string, becomes array<struct<ch: string, class: int>>")), "ch", "left")
    plain = F.array(F.struct(F.col("ch").alias("ch"), F.lit(0).alias("class")))
    rows = joined.groupBy("id", "piece").agg(F.array_sort(F.collect_list(F.struct("at", F.coalesce("becomes", plain).alias("becomes")))).alias("rows"), F.max("own").alias("own"))
    flat = F.flatten(F.transform("rows", lambda r: r["becomes"]))
    # Each code point gets the number of bases before it; sorting by (base, class, place) is the canonical order of marks.
    numbered = F.transform(flat, lambda x, i: F.struct(i.alias("i"), x["ch"].alias("ch"), x["class"].alias("class")))
    based = F.aggregate(
        numbered,
        F.struct(F.lit(0).alias("base"), F.expr("cast(array() as array<struct<base: int, class: int, i: int, ch: string>>)").alias("done")),
        lambda acc, x: F.struct(
            (acc["base"] + F.when(x["class"] == 0, 1).otherwise(0)).alias("base"),
            F.concat(acc["done"], F.array(F.struct((acc["base"] + F.when(x["class"] == 0, 1).otherwise(0)).alias("base"), x["class"].alias("class"), x["i"].alias("i"), x["ch"].alias("ch")))).alias("done"),
        ),
        lambda acc: acc["done"],
    )
    # Pieces without marks are in order already.
    marks = F.exists(flat, lambda x: x["class"] > 0)
    ordered = F.when(marks, F.array_join(F.transform(F.array_sort(based), lambda x: x["ch"]), "")).otherwise(F.array_join(F.transform(flat, lambda x: x["ch"]), ""))
    parts = rows.select("id", "piece", "own", ordered.alias("part"))
    whole = parts.groupBy("id").agg(F.max("own").alias("text"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("piece", "part"))), lambda p: p["part"]), "").alias("form"))
    return whole.select("text", F.call_function("java_method", F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), F.trim("form"), F.lit(False)).alias("form")).unionByName(stay)


def look_alikes(texts: DataFrame, column: str = "text") -> DataFrame:
    """(text_a, text_b): all pairs of different texts with one form, text_a before text_b in UTF-8 byte order."""
    forms = canonical(texts, column).where("form <> ''")
    a, b = forms.select("form", F.col("text").alias("text_a")), forms.select("form", F.col("text").alias("text_b"))
    return a.join(b, "form").where("text_a < text_b").select("text_a", "text_b")
