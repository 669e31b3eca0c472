"""Strict JSON objects, read once per line in Python.

Spark's own parsers accept text after the first value and drop duplicate or null members
differently, so a line counts as an object only if a strict parser says so.
"""

from __future__ import annotations

import json
from typing import Any


def _no_constant(name: str) -> Any:
    raise ValueError(name)


def loads_object(text: str | None) -> dict | None:
    """The object written in ``text``; None for null, malformed text and other JSON values."""
    if text is None:
        return None
    try:
        value = json.loads(text, parse_constant=_no_constant)
        if "\\ud" in text or "\\uD" in text:
            json.dumps(value, ensure_ascii=False).encode("utf-8")  # half of a surrogate pair is no text
    except (ValueError, RecursionError):
        return None
    return value if isinstance(value, dict) else None


def json_type(value: Any) -> str:
    """null, boolean, number, string, array or object."""
    if value is None:
        return "null"
    if isinstance(value, bool):
        return "boolean"
    if isinstance(value, (int, float)):
        return "number"
    if isinstance(value, str):
        return "string"
    return "array" if isinstance(value, list) else "object"


def items(value: Any) -> list:
    """The elements of a list, none for anything else."""
    return value if isinstance(value, list) else []


class DuplicateKey(ValueError):
    """A key stands twice in the outermost object."""


def loads_strict(text: str) -> object:
    """The value written in ``text``; DuplicateKey or another ValueError if it isn't strict JSON.

    Nested objects may repeat a key, the last one counts.
    """
    last: list = []

    def pairs(found: list) -> dict:
        last[:] = [found]
        return dict(found)

    value = json.loads(text, parse_constant=_no_constant, object_pairs_hook=pairs)
    if isinstance(value, dict) and last and len(last[0]) != len(value):
        raise DuplicateKey("duplicate key")
    json.dumps(value, ensure_ascii=False).encode("utf-8")
    return value
