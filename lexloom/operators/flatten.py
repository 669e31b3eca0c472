"""Nested records into related flat tables (problem 6).

A bottom-up tree automaton reads each child object: the state of a leaf is its JSON type (an
empty string has its own), the state of a list the set of its items' states, the state of an
object its keys with their states. The state an object ends in is its structural variant, and
the state decides to which subtype table it goes (an example with a text, one with a reference
only, a sound with an audio, ...). No child is left out: what fits no subtype goes to ``other``,
an item that isn't an object to ``value``. One object of each variant tells the fields and types
of all; a subtype's table has the columns of all its variants, and a variant can have a table of
its own. All share the supertype's keys (line, sense_pos, item_pos) and so keep the link to
their parents. Other nested lists (form_of, synonyms, ...) give child tables as well.

One Arrow pass reads each line once: strict JSON and unbounded nesting are beyond the built-in
parsers. Typing the subtype tables runs in the JVM again.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import reduce
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.functions.strict_json import items, loads_object
from lexloom.tables import materialized, one_per_key

#: Kinds of children and the lists that hold them.
KINDS = {"example": "examples", "translation": "translations", "sound": "sounds"}

#: Subtypes of each kind by the field and type that a state must have, in this order.
SUBTYPES = {
    "sense": (("form_of", "array"), ("glosses", "array")),
    "example": (("text", "string"), ("ref", "string")),
    "translation": (("word", "string"), ("note", "string")),
    "sound": (("audio", "string"), ("ipa", "string"), ("homophones", "array")),
}

SUPER = "source_line_number long, child_kind string, subtype string, sense_pos int, item_pos int, variant string, payload string"

#: Columns that each subtype table has even if no variant does; further ones come from the variants that occur.
TYPED = {
    "sense": "glosses array<string>, tags array<string>, raw_tags array<string>, topics array<string>, categories array<string>, note string",
    "example": "text string, translation string, english string, roman string, ref string, bold_text_offsets array<array<long>>",
    "translation": "word string, lang string, lang_code string, code string, note string, sense string, roman string, tags array<string>",
    "sound": "audio string, ipa string, oga_url string, other string, tags array<string>, homophones array<string>",
}


class TreeAutomaton:
    """Deterministic and bottom-up; equal subtrees of shape share one state."""

    def __init__(self) -> None:
        self.states: dict[tuple, str] = {}
        self.fields: dict[str, dict[str, str]] = {}  # of the states of objects: the type of each field
        self.routes: dict[tuple[str, str], str] = {}

    def _state(self, *rule: Any) -> str:
        found = self.states.get(rule)
        if found is None:
            found = self.states[rule] = hashlib.blake2b(repr(rule).encode(), digest_size=6).hexdigest()
        return found

    def run(self, value: Any) -> str:
        """The state in which ``value`` ends. Its name depends on the shape alone, so it is the same in every task."""
        if isinstance(value, dict):
            state = self._state("object", *sorted((k, self.run(v)) for k, v in value.items()))
            if state not in self.fields:
                self.fields[state] = {k: self._leaf(v) for k, v in value.items()}
            return state
        if isinstance(value, list):
            return self._state("array", *sorted({self.run(v) for v in value}))
        return self._leaf(value)

    @staticmethod
    def _leaf(value: Any) -> str:
        if value is None:
            return "null"
        if isinstance(value, bool):
            return "boolean"
        if isinstance(value, str):
            return "string" if value else "empty"
        return {dict: "object", list: "array"}.get(type(value), "number")

    def route(self, kind: str, state: str) -> str:
        """The subtype table of a child of ``kind`` that ended in ``state``."""
        found = self.routes.get((kind, state))
        if found is None:
            fields = self.fields.get(state)
            fits = [] if fields is None else [field for field, of in SUBTYPES[kind] if fields.get(field) == of]
            found = self.routes[kind, state] = "value" if fields is None else fits[0] if fits else "other"
        return found


def children(record: dict) -> Iterator[tuple[str, int, int, Any]]:
    """(kind, sense_pos, item_pos, value) of each sense and each item of a list of children."""
    for sense_pos, holder in [(-1, record), *enumerate(items(record.get("senses")))]:
        if sense_pos >= 0:
            yield "sense", sense_pos, sense_pos, holder
        if isinstance(holder, dict):
            for kind, name in KINDS.items():
                for item_pos, item in enumerate(items(holder.get(name))):
                    yield kind, sense_pos, item_pos, item


def supertype(lines: DataFrame, with_payload: bool = True) -> DataFrame:
    """One row per sense and child of each line, with its structural variant and the subtype table it is routed to.

    lines: source_line_number, source_json and, if there is one, loaded_at. Lines that aren't a
    JSON object (null, empty and malformed ones too) give no rows; of a line loaded again the
    newest content counts. Lists that aren't lists stay in their parent's payload. Children of
    the record itself have sense_pos -1.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = TreeAutomaton()
        for batch in batches:
            out: list[list] = [[], [], [], [], [], [], []]
            for line, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for kind, sense_pos, item_pos, item in children(loads_object(text) or {}):
                    if not with_payload and kind == "sense":
                        continue
                    own = kind == "sense" and isinstance(item, dict)
                    body = {k: v for k, v in item.items() if not (k in KINDS.values() and isinstance(v, list))} if own else item
                    state = automaton.run(body)
                    row = (line, kind, automaton.route(kind, state), sense_pos, item_pos, state, json.dumps(body, ensure_ascii=False) if with_payload else None)
                    for column, value in zip(out, row, strict=True):
                        column.append(value)
            kinds = (pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], [c.split()[0] for c in SUPER.split(", ")])

    order = [c for c in ("loaded_at",) if c in lines.columns]
    read = lines.select("source_line_number", "source_json", *order).where("source_line_number is not null and source_json is not null")
    return one_per_key(read, "source_line_number", order).select("source_line_number", "source_json").mapInArrow(rows, SUPER)


def variants(super_rows: DataFrame) -> DataFrame:
    """(child_kind, subtype, variant, n): how many children of each shape there are, and where they are routed."""
    return super_rows.groupBy("child_kind", "subtype", "variant").agg(F.count(F.lit(1)).alias("n"))


def _type(value: Any) -> Any:
    """The type of a JSON value: a name, [type of items], {field: type}, or None if it can't tell (null, empty lists)."""
    if isinstance(value, dict):
        return {k: _type(v) for k, v in value.items()}
    if isinstance(value, list):
        return [reduce(_merged, map(_type, value), None)]
    if value is None:
        return None
    if isinstance(value, bool):
        return "boolean"
    return "string" if isinstance(value, str) else "bigint" if isinstance(value, int) and abs(value) < 1 << 63 else "double"


def _merged(a: Any, b: Any) -> Any:
    """The type that holds values of both; JSON text (string) if none else does."""
    if a is None or b is None or a == b:
        return b if a is None else a
    if isinstance(a, dict) and isinstance(b, dict):
        return {k: _merged(a.get(k), b.get(k)) for k in sorted({*a, *b})}
    if isinstance(a, list) and isinstance(b, list):
        return [_merged(a[0], b[0])]
    return "double" if {str(a), str(b)} == {"bigint", "double"} else "string"


def _sql(kind: Any) -> str:
    if isinstance(kind, list):
        return f"array<{_sql(kind[0])}>"
    if isinstance(kind, dict) and kind and len({k.casefold() for k in kind}) == len(kind):
        return f"struct<{','.join(f'{_quoted(k)}:{_sql(t)}' for k, t in kind.items())}>"
    return kind if isinstance(kind, str) else "string"


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _columns(own: DataFrame, base: str) -> str:
    """The schema of all variants' fields: the columns of ``base``, then the others by name; fields whose type differs are JSON text."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = sorted({(k, json.dumps(_type(v), sort_keys=True)) for text in batch.column(0).to_pylist() if isinstance(x := json.loads(text), dict) for k, v in x.items()})
            yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.string()) for i in (0, 1)], ["field", "type"])

    # Numbers share a state: their variants may need a wider type than one object shows, so whole and other numbers are told apart.
    exact = F.regexp_like("payload", F.lit(r":\s*-?\d+(\.\d|[eE])|\d{18}"))
    one = own.groupBy("variant", exact).agg(F.first("payload").alias("payload")).select("payload")
    types: dict[str, Any] = {}
    for r in one.mapInArrow(rows, "field string, type string").distinct().collect():  # field names and types, not rows
        types[r.field] = _merged(types.get(r.field), json.loads(r.type))
    taken = {"source_line_number", "child_kind", "subtype", "sense_pos", "item_pos", "path", "list_pos", "variant", "payload"} | {c.split()[0].casefold() for c in base.split(", ") if c}
    more = []
    for field, kind in sorted(types.items()):
        if field.casefold() not in taken:
            taken.add(field.casefold())
            more.append(f"{_quoted(field)} {_sql(kind)}")
    return ", ".join([*([base] if base else []), *more])


def subtype(super_rows: DataFrame, kind: str, variant: str | None = None, route: str | None = None) -> DataFrame:
    """The typed table of one subtype or variant, or of a whole kind: the supertype's keys, the variant, the columns of all variants in it, and the payload.

    super_rows: of supertype() or nested(). route: a subtype of SUBTYPES, ``other`` or ``value``.
    A kind's table has the columns of TYPED in any case, a subtype's or variant's only its own. A value of another type than the column's is null there, and a
    field named like a key or like another field but for case has no column; the payload keeps both.
    """
    own = super_rows.where(F.col("child_kind") == kind)
    own = own if variant is None else own.where(F.col("variant") == variant)
    own = materialized(own if route is None else own.where(F.col("subtype") == route))
    schema = _columns(own, TYPED.get(kind, "") if variant is None and route is None else "")
    keys = [c for c in own.columns if c not in ("child_kind", "payload")]
    if not schema:
        return own.select(*keys, "payload")
    return own.select(*keys, F.from_json("payload", schema).alias("x"), F.col("payload").alias("__payload")).select(*keys, "x.*", F.col("__payload").alias("payload"))


def nested(super_rows: DataFrame) -> DataFrame:
    """One row per object or list in any list inside a sense or child, at any depth: the child tables of form_of, synonyms and the like.

    child_kind is the parent's kind and the fields down to the list (``sense.form_of``), path the
    same with the positions in lists above, list_pos the position in the list itself. A list in a
    list has its JSON text as payload.
    """

    def lists(value: Any, kind: str, path: str) -> Iterator[tuple[str, str, int, Any]]:
        if isinstance(value, dict):
            for k, v in value.items():
                yield from lists(v, f"{kind}.{k}", f"{path}.{k}" if path else k)
        elif isinstance(value, list):
            for i, item in enumerate(value):
                if isinstance(item, (dict, list)):
                    yield kind, path, i, item
                    yield from lists(item, kind if isinstance(item, dict) else f"{kind}[]", f"{path}[{i}]")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = TreeAutomaton()
        names = ["source_line_number", "child_kind", "sense_pos", "item_pos", "path", "list_pos", "variant", "payload"]
        kinds = (pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.string(), pa.string())
        for batch in batches:
            out = [
                (line, kind, sense_pos, item_pos, path, i, automaton.run(item), json.dumps(item, ensure_ascii=False))
                for line, parent, sense_pos, item_pos, text in zip(*(c.to_pylist() for c in batch.columns), strict=True)
                for kind, path, i, item in lists(json.loads(text), parent, "")
            ]
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in out], t) for j, t in enumerate(kinds)], names)

    read = super_rows.select("source_line_number", "child_kind", "sense_pos", "item_pos", "payload")
    return read.mapInArrow(rows, "source_line_number long, child_kind string, sense_pos int, item_pos int, path string, list_pos int, variant string, payload string")
