"""File names, titles, URLs, predicates and author markup."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Where a title's page is, by default.
PAGE = "https://commons.wikimedia.org/wiki/"


def percent_decoded(value: str) -> str:
    """Each % with two hexadecimal digits decoded; as it was if the result isn't UTF-8.

    A sequence that is cut off or malformed stays. A sign counts as a digit there, as in the
    format this follows. The last two bytes of a text start no sequence.
    """
    raw = value.encode("utf-8", "surrogatepass")

    def one(m: re.Match) -> bytes:
        return bytes([int(m[1], 16)])

    try:
        return re.sub(rb"%((?:[0-9A-Fa-f]|\+(?=[0-9A-Fa-f]))[0-9A-Fa-f])", one, raw).decode("utf-8")
    except UnicodeDecodeError:
        return value


@F.pandas_udf(T.StringType())
def _decoded(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in batches:
        yield batch.map(lambda v: percent_decoded(v) if isinstance(v, str) and "%" in v else v)


def commons_file_name(authored: Column) -> Column:
    """The normalized file name, null if it isn't a plausible one.

    Decoded, trimmed, repeated prefixes dropped, underscores and white space made single
    spaces, first letter upper case.
    """
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(_decoded(authored), r"(?U)^\s+|\s+$", ""), "^(File:)+", ""), "^(file:)+", "")
    name = F.regexp_replace(F.regexp_replace(F.translate(bare, "_", " "), r"(?U)\s+", " "), "^ | $", "")
    plausible = (name != "") & (F.octet_length(name) <= 255) & F.contains(name, F.lit(".")) & ~name.rlike(r"[/\\#<>\[\]|{}\p{Cc}]")
    return F.when(plausible, F.concat(F.upper(F.substring(name, 1, 1)), F.substring(name, F.lit(2), F.length(name))))


def commons_title(name: Column) -> Column:
    return F.concat(F.lit("File:"), name)


def description_url(title: Column, page: str = PAGE) -> Column:
    """Spaces as underscores, letters, digits and -_.;:@$!*(),/~ as they are, all other bytes in percent form."""
    encoded = F.regexp_replace(F.url_encode(title), r"\+", "_")
    for code, plain in (("%3B", ";"), ("%3A", ":"), ("%40", "@"), ("%24", "$"), ("%21", "!"), ("%28", "("), ("%29", ")"), ("%2C", ","), ("%2F", "/"), ("%7E", "~")):
        encoded = F.replace(encoded, F.lit(code), F.lit(plain))
    return F.concat(F.lit(page), encoded)


def primary_subtag(tag: Column) -> Column:
    return F.lower(F.regexp_extract(tag, "^[^-_]*", 0))


def is_pack_id(value: Column) -> Column:
    return value.rlike("^[a-z](-?[a-z0-9])*$") & (F.length(value) <= 64)


def is_hex_digest(value: Column) -> Column:
    return value.rlike("^[0-9a-f]{64}$")


def is_iso_date_prefix(value: Column) -> Column:
    return value.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}")


def is_routed_form(value: Column) -> Column:
    return (value != "") & (value != "-")


def is_safe_file_name(value: Column) -> Column:
    """One ordinary path component."""
    return (value != "") & ~value.isin(".", "..") & ~value.rlike(r"[/\\]")


def is_catalog_asset(value: Column) -> Column:
    return value.rlike(r"^[A-Za-z0-9_-][A-Za-z0-9._-]{0,254}$")


def is_catalog_text(value: Column) -> Column:
    return (value != "") & (F.octet_length(value) <= 2048) & ~value.rlike(r"\p{Cc}")


def is_absolute_url(value: Column) -> Column:
    return value.rlike("^https?://") & (F.octet_length(value) <= 2048)


def shard_file(ordinal: Column) -> Column:
    return F.format_string("data-%03d", ordinal)


def digest_prefix(sha256_hex: Column, n_bytes: int = 8) -> Column:
    return F.substring(sha256_hex, 1, 2 * n_bytes)


def original_path(sha1_hex: Column) -> Column:
    """The content-addressed place of an original."""
    return F.concat_ws("/", F.lit("originals"), F.substring(sha1_hex, 1, 2), sha1_hex)


_NAMED = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " "}
_ENTITY = re.compile(rf"&(?:({'|'.join(_NAMED)})|#[xX]([0-9A-Fa-f]{{1,7}})|#([0-9]{{1,8}}));")


def decode_entities(text: str) -> str:
    """Six named entities and numeric ones, each once; what they give isn't read again, anything else stays."""

    def one(m: re.Match) -> str:
        if m[1]:
            return _NAMED[m[1]]
        code = int(m[2], 16) if m[2] else int(m[3])
        return chr(code) if code < 0x110000 and not 0xD800 <= code < 0xE000 else m[0]

    return _ENTITY.sub(one, text)


def author_of(markup: str) -> tuple[str, list[str]]:
    """(text, links) of an HTML fragment: block tags break lines, white space collapses, links are absolute and distinct."""
    text, links, at = [], [], 0
    for m in re.finditer(r"<([^>]*)>", markup):
        text.append(markup[at : m.start()])
        at = m.end()
        name = re.split(r"[\s/]", m[1].lstrip("/"), maxsplit=1)[0].lower()
        if name in ("br", "li", "p", "div", "tr"):
            text.append("\n")
        elif name == "a":
            href = re.search(r"""href=(?:"([^"]*)"|'([^']*)'|([^\s"']\S*))""", m[1], re.I)
            url = decode_entities(next(g for g in href.groups() if g is not None)) if href else ""
            url = f"https:{url}" if url.startswith("//") else url
            if url.startswith(("https://", "http://")) and url not in links:
                links.append(url)
    rest = markup[at:]
    text.append(rest.partition("<")[0])
    lines = [" ".join(line.split()) for line in decode_entities("".join(text)).split("\n")]
    return "\n".join(line for line in lines if line), links


@F.pandas_udf(T.StructType([T.StructField("text", T.StringType()), T.StructField("urls", T.ArrayType(T.StringType()))]))
def author_from_html(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        found = [author_of(v) if isinstance(v, str) else (None, None) for v in batch]
        yield pd.DataFrame({"text": [f[0] for f in found], "urls": [f[1] for f in found]})


def page_statement(markup: Column, pattern: str) -> Column:
    """A pattern's first group in a page's text: tags dropped, white space collapsed."""
    plain = F.regexp_replace(F.regexp_replace(markup, "<[^>]*>", " "), r"\s+", " ")
    return F.regexp_extract(plain, pattern, 1)
