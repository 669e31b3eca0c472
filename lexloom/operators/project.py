"""Typed, bounded projections of nested records.

What each object holds is declared below, field by field; one interpreter reads the
declarations. It runs once per record in an Arrow pass, because a projection must stop at the
first field of a wrong type and say which, null is not the same as absent there, and descendants
nest without a bound. The result is a struct column; sections and counts are plain Spark on it.

Windows check only the items inside them. An absent list has offset 0, total 0 and no items.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass, fields, replace
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.functions.strict_json import loads_strict

UNBOUNDED = 1 << 62


@dataclass(frozen=True)
class Bounds:
    """How much of each section a projection shows."""

    text_bytes: int = UNBOUNDED
    strings: int = UNBOUNDED
    etymology: int = UNBOUNDED
    pronunciations: int = UNBOUNDED
    hyphenations: int = UNBOUNDED
    forms: int = UNBOUNDED
    senses: int = UNBOUNDED
    examples_per_sense: int = UNBOUNDED
    translations: int = UNBOUNDED
    relations: int = UNBOUNDED
    descendants: int = UNBOUNDED
    notes: int = UNBOUNDED
    categories: int = UNBOUNDED


#: The three presets.
EXHAUSTIVE = Bounds()
SUMMARY = Bounds(text_bytes=4096, strings=32, etymology=0, pronunciations=8, hyphenations=0, forms=0, senses=16, examples_per_sense=0, translations=16, relations=0, descendants=0, notes=0, categories=0)
DETAIL = Bounds(text_bytes=16 * 1024, strings=256, etymology=16, pronunciations=64, hyphenations=16, forms=256, senses=256, examples_per_sense=16, translations=256, relations=256, descendants=256, notes=64, categories=256)
MAX_PAGE = 256

#: Relation kinds in their order, and the two whose field has another name.
RELATIONS = "synonyms antonyms hypernyms hyponyms holonyms meronyms troponyms paronyms coordinate-terms instances derived related compounds abbreviations contractions proverbs idioms expressions collocations phrases cognates morphologies anagrams various".split()
RELATION_FIELDS = {"coordinate-terms": "coordinate_terms", "contractions": "contraction"}

#: The known fields of each object. ``a|b``: b is read only if a is absent; ``a+b``: the text a, then the texts b.
OBJECTS = {
    "pronunciation": "ipa:text enpr:text zh_pronunciation=zh-pron|zh_pron:text hangeul:text homophone:text romanization=roman:text form:text rhymes:text text:text note:text other:text sense:text alternative:text not_same_pronunciation:flag audio:file audio_ipa=audio-ipa:text homophones:texts hyphenation:texts tags:texts raw_tags:texts topics:texts",
    "hyphenation": "parts:texts sense:text tags:texts raw_tags:texts",
    "form": "form:text! romanization=roman:text ipa=ipa+ipas:texts hiragana:text article:text literal_meaning:text source:text sense:text sense_index:index pronouns:texts ruby:ruby tags:texts raw_tags:texts topics:texts",
    "example": "translation=translation|english:text text:text text_emphasis=bold_text_offsets:emphasis translation_emphasis=bold_translation_offsets:emphasis romanization=roman:text romanization_emphasis=bold_roman_offsets:emphasis literal_meaning:text reference=ref:text note:text example_type=type:text ruby:ruby tags:texts raw_tags:texts",
    "translation": "word:text note:text language_code=lang_code&code:text translation=translation|english:text language_name=lang:text alt:text sense:text sense_index:index taxonomic:text romanization=roman:text traditional_writing:text other:text source:text uncertain:flag ruby:ruby tags:texts raw_tags:texts topics:texts",
    "relation": "translation=translation|english:text word:text alt:text extra:text qualifier:text romanization=roman:text sense:text sense_index:index note:text alternative_spelling:text literal_meaning:text taxonomic:text source:text language_name=lang:text language_code=lang_code:text ruby:ruby tags:texts raw_tags:texts topics:texts",
    "descendant": "word:text language_name=lang:text language_code=lang_code:text romanization=roman:text sense:text sense_index:index ruby:ruby tags:texts raw_tags:texts",
    "lemma": "word:required extra:text romanization=roman:text tags:texts",
    "classifier": "classifier:text! tags:texts raw_tags:texts",
    "sense": "notes=note+notes:texts glosses:texts raw_glosses:texts qualifier:text taxonomic:text sense_index:index tags:texts raw_tags:texts topics:texts categories:texts sense_ids=senseid:texts wikidata:texts wikipedia:texts",
    "entry": "language_name=lang:text part_of_speech=pos:text part_of_speech_title=pos_title:text literal_meaning:text etymology_number:index tags:texts raw_tags:texts",
}

#: Columns of each kind of field.
KINDS = {"text": "string", "text!": "string", "required": "string", "file": "string", "index": "string", "flag": "boolean", "texts": "array<string>", "ruby": "array<struct<base: string, text: string>>", "emphasis": "array<struct<start: bigint, end: bigint>>"}


class ProjectionError(ValueError):
    """Names the field that has a wrong type."""


def declared(kind: str) -> list[tuple[str, str, str]]:
    """(name, source, field kind) of an object's fields."""
    out = []
    for item in OBJECTS[kind].split():
        left, _, how = item.rpartition(":")
        name, _, source = left.partition("=")
        out.append((name, source or name, how))
    return out


def struct_of(kind: str, *more: str) -> str:
    parts = [f"{name}: {KINDS[how]}" for name, _, how in declared(kind)]
    return f"struct<{', '.join([*parts, 'truncated: boolean', *more])}>"


def window_of(item: str) -> str:
    return f"struct<offset: bigint, total: bigint, items: array<{item}>>"


_GROUPS = f"array<struct<kind: string, relations: {window_of(struct_of('relation'))}>>"
_SENSE_MORE = [
    *[f"{x}: array<{struct_of('lemma')}>" for x in ("form_of", "alt_of", "compound_of")],
    f"classifiers: array<{struct_of('classifier')}>",
    f"examples: {window_of(struct_of('example'))}",
    f"translations: {window_of(struct_of('translation'))}",
    f"relations: {_GROUPS}",
]
ENTRY = struct_of(
    "entry",
    "headword: string",
    "language_code: string",
    f"form_of: array<{struct_of('lemma')}>",
    f"alt_of: array<{struct_of('lemma')}>",
    f"classifiers: array<{struct_of('classifier')}>",
    f"etymology: {window_of('string')}",
    f"pronunciations: {window_of(struct_of('pronunciation'))}",
    f"hyphenations: {window_of(struct_of('hyphenation'))}",
    f"forms: {window_of(struct_of('form'))}",
    f"senses: {window_of(struct_of('sense', *_SENSE_MORE))}",
    f"translations: {window_of(struct_of('translation'))}",
    "sense_translation_total: bigint",
    f"relations: {_GROUPS}",
    f"descendants: {window_of(struct_of('descendant', 'depth: int'))}",
    f"notes: {window_of('string')}",
    f"categories: {window_of('string')}",
)


def inside(context: str, index: int) -> str:
    """An index belongs inside the quoted name that a context ends with."""
    return f"{context[:-1]}[{index}]`" if context.endswith("`") else f"{context}[{index}]"


def cut(text: str, limit: int) -> tuple[str, bool]:
    raw = text.encode("utf-8")
    return (text, False) if len(raw) <= limit else (raw[:limit].decode("utf-8", "ignore"), True)


def file_name(value: str) -> str | None:
    from lexloom.functions.text import percent_decoded

    bare = percent_decoded(value).strip()
    for prefix in ("File:", "file:"):
        while bare.startswith(prefix):
            bare = bare[len(prefix) :]
    name = " ".join(bare.replace("_", " ").split())
    if not name or len(name.encode()) > 255 or "." not in name or any(c in "/\\#<>[]|{}" or ord(c) < 32 or 127 <= ord(c) < 160 for c in name):
        return None
    return name[0].upper() + name[1:]


class Projector:
    def __init__(self, bounds: Bounds, target: str | None = None) -> None:
        self.bounds, self.target = bounds, target
        self.declared = {k: declared(k) for k in OBJECTS}

    def fail(self, context: str, what: str) -> Any:
        raise ProjectionError(f"{context} is not {what}")

    def array(self, value: Any, context: str) -> list:
        return value if isinstance(value, list) else self.fail(context, "an array")

    def object(self, value: Any, context: str) -> dict:
        return value if isinstance(value, dict) else self.fail(context, "an object")

    def _text(self, holder: dict, name: str, context: str, seen: list[bool]) -> str | None:
        if name not in holder:
            return None
        if not isinstance(holder[name], str):
            self.fail(f"{context} `{name}`", "a string")
        value, was_cut = cut(holder[name], self.bounds.text_bytes)
        seen[0] |= was_cut
        return value

    def _texts(self, holder: dict, name: str, context: str, seen: list[bool]) -> list[str]:
        if name not in holder:
            return []
        found = self.array(holder[name], f"{context} `{name}`")
        for i, item in enumerate(found):
            if not isinstance(item, str):
                self.fail(inside(f"{context} `{name}`", i), "a string")
        seen[0] |= len(found) > self.bounds.strings
        kept = [cut(x, self.bounds.text_bytes) for x in found[: self.bounds.strings]]
        seen[0] |= any(was_cut for _, was_cut in kept)
        return [x for x, _ in kept]

    def _pairs(self, holder: dict, name: str, context: str, seen: list[bool], good: Callable[[Any], bool], what: str) -> list[list]:
        if name not in holder:
            return []
        found = self.array(holder[name], f"{context} `{name}`")
        for i, item in enumerate(found):
            if not (isinstance(item, list) and len(item) == 2 and good(item)):
                self.fail(inside(f"{context} `{name}`", i), what)
        seen[0] |= len(found) > self.bounds.strings
        return found[: self.bounds.strings]

    def _field(self, holder: dict, source: str, how: str, context: str, seen: list[bool]) -> Any:
        if how == "flag":
            value = holder.get(source)
            return value if source not in holder or isinstance(value, bool) else self.fail(f"{context} `{source}`", "a boolean")
        if how == "index":
            value = holder.get(source)
            if source in holder and not isinstance(value, str):
                if isinstance(value, bool) or not isinstance(value, int) or not 0 <= value < 1 << 64:
                    self.fail(f"{context} `{source}`", "an index")
                return str(value)
            return self._text(holder, source, context, seen)
        if how == "required" and source not in holder:
            raise ProjectionError(f"{context} has no `{source}`")
        if how == "ruby":
            pairs = self._pairs(holder, source, context, seen, lambda p: all(isinstance(x, str) for x in p), "a pair of strings")
            made = []
            for base, text in pairs:
                (b, x), (t, y) = cut(base, self.bounds.text_bytes), cut(text, self.bounds.text_bytes)
                seen[0] |= x or y
                made.append({"base": b, "text": t})
            return made
        if how == "emphasis":
            number = lambda x: isinstance(x, int) and not isinstance(x, bool) and x >= 0
            return [{"start": a, "end": b} for a, b in self._pairs(holder, source, context, seen, lambda p: number(p[0]) and number(p[1]) and p[0] <= p[1], "a range")]
        if "+" in source:
            first, rest = source.split("+")
            one = self._text(holder, first, context, seen)
            return ([] if one is None else [one]) + self._texts(holder, rest, context, seen)
        if how == "texts":
            return self._texts(holder, source, context, seen)
        if "&" in source:  # both are checked, the first one wins
            first, second = source.split("&")
            a, b = self._text(holder, first, context, seen), self._text(holder, second, context, seen)
            return b if a is None else a
        value = None
        for name in source.split("|"):
            value = self._text(holder, name, context, seen)
            if value is not None:
                break
        if how == "file":
            return None if value is None else file_name(value)
        return "" if value is None and how == "text!" else value

    def read(self, kind: str, value: Any, context: str) -> dict:
        """The declared fields of one object and whether any was cut."""
        holder, seen = self.object(value, context), [False]
        out = {name: self._field(holder, source, how, context, seen) for name, source, how in self.declared[kind]}
        if kind == "translation" and out["word"] is None and out["note"] is None:
            raise ProjectionError(f"{context} has neither a `word` nor a `note` field")
        return out | {"truncated": seen[0]}

    def window(self, value: Any, absent: bool, context: str, offset: int, limit: int, item: Callable[[Any, str], Any]) -> dict:
        if absent:
            return {"offset": 0, "total": 0, "items": []}
        found = self.array(value, context)
        return {"offset": offset, "total": len(found), "items": [item(x, inside(context, offset + i)) for i, x in enumerate(found[offset : offset + limit])]}

    def listed(self, kind: str, holder: dict, name: str, context: str, offset: int, limit: int) -> dict:
        return self.window(holder.get(name), name not in holder, f"{context} `{name}`", offset, limit, lambda v, c: self.read(kind, v, c))

    def strings(self, holder: dict, name: str, context: str, offset: int, limit: int) -> dict:
        def one(v: Any, c: str) -> str:
            return cut(v if isinstance(v, str) else self.fail(c, "a string"), self.bounds.text_bytes)[0]

        return self.window(holder.get(name), name not in holder, f"{context} `{name}`", offset, limit, one)

    def etymology(self, record: dict, offset: int, limit: int) -> dict:
        if "etymology_text" not in record:
            return self.strings(record, "etymology_texts", "record", offset, limit)
        text = record["etymology_text"]
        if not isinstance(text, str):
            self.fail("record `etymology_text`", "a string")
        return {"offset": offset, "total": 1, "items": [cut(text, self.bounds.text_bytes)[0]] if offset == 0 and limit > 0 else []}

    def matches(self, item: dict, context: str) -> bool:
        code = next((item[k] for k in ("lang_code", "code") if k in item), None)
        name = "lang_code" if "lang_code" in item else "code"
        if name in item and not isinstance(code, str):
            self.fail(f"{context} `{name}`", "a string")
        return self.target is None or code == self.target

    def translations(self, holder: dict, context: str, offset: int, limit: int) -> dict:
        if "translations" not in holder:
            return {"offset": 0, "total": 0, "items": []}
        where = f"{context} `translations`"
        total, items = 0, []
        for i, item in enumerate(self.array(holder["translations"], where)):
            at = inside(where, i)
            if self.matches(self.object(item, at), at):
                if total >= offset and len(items) < limit:
                    items.append(self.read("translation", item, at))
                total += 1
        return {"offset": offset, "total": total, "items": items}

    def relation_groups(self, holder: dict, context: str, limit: int) -> list[dict]:
        found = [{"kind": kind, "relations": self.listed("relation", holder, RELATION_FIELDS.get(kind, kind), context, 0, limit)} for kind in RELATIONS]
        return [g for g in found if g["relations"]["total"] > 0]

    def descendants(self, record: dict, offset: int, limit: int) -> dict:
        page: dict = {"offset": offset, "total": 0, "items": []}
        if "descendants" not in record:
            return page
        open_ = [(iter(enumerate(self.array(record["descendants"], "record `descendants`"))), "record `descendants`")]
        while open_:
            level, context = open_[-1]
            step = next(level, None)
            if step is None:
                open_.pop()
                continue
            at = inside(context, step[0])
            node = self.object(step[1], at)
            if page["total"] >= offset and len(page["items"]) < limit:
                page["items"].append(self.read("descendant", node, at) | {"depth": len(open_) - 1})
            page["total"] += 1
            if "descendants" in node:
                below = f"{at} `descendants`"
                open_.append((iter(enumerate(self.array(node["descendants"], below))), below))
        return page

    def sense(self, value: Any, context: str) -> dict:
        holder = self.object(value, context)
        out = self.read("sense", holder, context)
        for name in ("form_of", "alt_of", "compound_of"):
            out[name] = self.listed("lemma", holder, name, context, 0, self.bounds.strings)["items"]
        out["classifiers"] = self.listed("classifier", holder, "classifiers", context, 0, self.bounds.strings)["items"]
        out["examples"] = self.listed("example", holder, "examples", context, 0, self.bounds.examples_per_sense)
        out["translations"] = self.translations(holder, context, 0, self.bounds.translations)
        out["relations"] = self.relation_groups(holder, context, self.bounds.relations)
        return out

    def entry(self, record: dict) -> dict:
        b = self.bounds
        out = self.read("entry", record, "record")
        (out["headword"], x), (out["language_code"], y) = cut(record["word"], b.text_bytes), cut(record["lang_code"], b.text_bytes)
        out["truncated"] |= x or y
        total = 0
        if "senses" in record:
            for i, sense in enumerate(self.array(record["senses"], "record `senses`")):
                at = f"record `senses[{i}]`"
                held = self.object(sense, at)
                if "translations" in held:
                    where = f"{at} `translations`"
                    total += sum(self.matches(self.object(t, inside(where, k)), inside(where, k)) for k, t in enumerate(self.array(held["translations"], where)))
        out["sense_translation_total"] = total
        for name in ("form_of", "alt_of"):
            out[name] = self.listed("lemma", record, name, "record", 0, b.strings)["items"]
        out["classifiers"] = self.listed("classifier", record, "classifiers", "record", 0, b.strings)["items"]
        out["etymology"] = self.etymology(record, 0, b.etymology)
        out["pronunciations"] = self.listed("pronunciation", record, "sounds", "record", 0, b.pronunciations)
        out["hyphenations"] = self.listed("hyphenation", record, "hyphenations", "record", 0, b.hyphenations)
        out["forms"] = self.listed("form", record, "forms", "record", 0, b.forms)
        out["senses"] = self.window(record.get("senses"), "senses" not in record, "record `senses`", 0, b.senses, self.sense)
        out["translations"] = self.translations(record, "record", 0, b.translations)
        out["relations"] = self.relation_groups(record, "record", b.relations)
        out["descendants"] = self.descendants(record, 0, b.descendants)
        out["notes"] = self.strings(record, "notes", "record", 0, b.notes)
        out["categories"] = self.strings(record, "categories", "record", 0, b.categories)
        return out

    def section(self, record: dict, kind: str, offset: int, limit: int, sense: int | None = None) -> dict:
        """One page of one section; those of a sense need its position."""
        holder, context = record, "record"
        if sense is not None:
            found = self.array(record.get("senses", []), "record `senses`")
            if not 0 <= sense < len(found):
                raise ProjectionError(f"no such sense: {sense}")
            context = f"record `senses[{sense}]`"
            holder = self.object(found[sense], context)
        if kind == "etymology":
            return self.etymology(record, offset, limit)
        if kind == "senses":
            return self.window(record.get("senses"), "senses" not in record, "record `senses`", offset, limit, self.sense)
        if kind == "translations":
            return self.translations(holder, context, offset, limit)
        if kind == "descendants":
            return self.descendants(record, offset, limit)
        if kind in ("notes", "categories"):
            return self.strings(holder, kind, context, offset, limit)
        if kind in RELATIONS:
            return self.listed("relation", holder, RELATION_FIELDS.get(kind, kind), context, offset, limit)
        name = {"pronunciations": "sounds"}.get(kind, kind)
        return self.listed(kind[:-1], holder, name, context, offset, limit)


def entries(records: DataFrame, text: str, bounds: Bounds = DETAIL, target: str | None = None) -> DataFrame:
    """Adds entry (struct) and error: one of them is null. The other columns stay.

    records: ``text`` holds the record's JSON, which has a word and a language code. Null and
    malformed text is an error like any other.
    """
    for f in fields(bounds):
        if getattr(bounds, f.name) < (1 if f.name == "text_bytes" else 0):
            raise ValueError(f"{f.name} is out of range")
    kept = [c for c in records.columns]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in records.schema.fields), f"entry {ENTRY}, error string"])
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_type(_parse_datatype_string(ENTRY))
    at = kept.index(text)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        projector = Projector(bounds, target)
        for batch in batches:
            made, errors = [], []
            for value in batch.column(at).to_pylist():
                try:
                    record = loads_strict(value if isinstance(value, str) else (value or b"").decode("utf-8"))
                    if not isinstance(record, dict) or not isinstance(record.get("word"), str) or not isinstance(record.get("lang_code"), str):
                        raise ProjectionError("record has no word or language code")
                    made.append(projector.entry(record))
                    errors.append(None)
                except (ValueError, RecursionError) as e:
                    made.append(None)
                    errors.append(str(e) if isinstance(e, ProjectionError) else "record is malformed JSON")
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, arrow), pa.array(errors, pa.string())], [*kept, "entry", "error"])

    return records.mapInArrow(rows, schema)


def section(records: DataFrame, key: str, text: str, kind: str, offset: int, limit: int, sense: int | None = None, target: str | None = None, bounds: Bounds = DETAIL) -> DataFrame:
    """(key, total, page (JSON), error): one page of a section of each record. limit: 1 to 256."""
    if not 1 <= limit <= MAX_PAGE:
        raise ValueError(f"limit must be 1 to {MAX_PAGE}")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        projector = Projector(bounds, target)
        for batch in batches:
            totals, pages, errors = [], [], []
            for value in batch.column(1).to_pylist():
                try:
                    page = projector.section(loads_strict(value or ""), kind, offset, limit, sense)
                    found = (page["total"], json.dumps(page["items"], ensure_ascii=False), None)
                except (ValueError, RecursionError) as e:
                    found = (None, None, str(e))
                for column, x in zip((totals, pages, errors), found, strict=True):
                    column.append(x)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(totals, pa.int64()), pa.array(pages, pa.string()), pa.array(errors, pa.string())], [key, "total", "page", "error"])

    return records.select(key, text).mapInArrow(rows, f"`{key}` {records.schema[key].dataType.simpleString()}, total long, page string, error string")


# In the JVM, over variants: the parts that need no first-error rule.


def parsed(text: Column) -> Column:
    return F.try_parse_json(text)


def listed(record: Column, path: str) -> Column:
    """A list as variants, empty if it is absent or no list."""
    return F.coalesce(F.try_variant_get(record, path, "array<variant>"), F.array().cast("array<variant>"))


def window(values: Column, offset: int, limit: int) -> Column:
    """struct(offset, total, items)."""
    return F.struct(F.when(F.size(values) > 0, offset).otherwise(0).alias("offset"), F.size(values).alias("total"), F.slice(values, offset + 1, limit).alias("items"))


def in_language(translations: Column, target: str | None) -> Column:
    """Translations into one language; all without a target."""
    if target is None:
        return translations
    code = lambda t: F.coalesce(F.try_variant_get(t, "$.lang_code", "string"), F.try_variant_get(t, "$.code", "string"))
    return F.filter(translations, lambda t: code(t) == target)


def with_bounds(bounds: Bounds, **changes: int) -> Bounds:
    return replace(bounds, **changes)
