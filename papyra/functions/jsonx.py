"""JSON out of free text."""

from __future__ import annotations

import json
import re

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TOKEN = re.compile(r'"(?:[^"\\]|\\.)*"?|[{}\[\]]', re.DOTALL)


def largest(text: str, opens: str, closes: str) -> str | None:
    """The longest balanced part between the two signs, the first of equals; signs inside quotes don't count."""
    best = None
    for m in re.finditer(re.escape(opens), text):
        if best and len(text) - m.start() <= len(best):
            break
        depth = 0
        for t in _TOKEN.finditer(text, m.start()):
            depth += (t[0] == opens) - (t[0] == closes)
            if not depth and t[0] == closes:
                part = text[m.start() : t.end()]
                best = part if best is None or len(part) > len(best) else best
                break
    return best


def recovered(text: str | None, field: str | None = None) -> str | None:
    """A JSON object from a model's answer, as text: fences are dropped, then the whole, the largest object and the largest
    list are tried; a bare list is put under ``field``. Null if nothing can be read."""
    t = (text or "").strip()
    if t.startswith("```"):
        t = re.sub(r"\A`{3,}[^\S\n]*(?:json)?[^\S\n]*\n?|\n?\s*`{3,}\s*\Z", "", t).strip()

    def wrapped(items: object) -> object:
        if isinstance(items, dict):
            return items
        if isinstance(items, list):
            if len(items) == 1 and isinstance(items[0], dict) and (field is None or field in items[0]):
                return items[0]
            if field:
                return {field: items}
        return None

    for part in (t, largest(t, "{", "}"), largest(t, "[", "]")):
        try:
            found = wrapped(json.loads(part)) if part else None
        except ValueError:
            continue
        if found is not None:
            return json.dumps(found, ensure_ascii=False)
    return None


def string_leaves(value: object) -> list[str]:
    if isinstance(value, str):
        return [value]
    inner = value.values() if isinstance(value, dict) else value if isinstance(value, list) else ()
    return [s for v in inner for s in string_leaves(v)]


def recovered_of(column, field: str | None = None):
    @F.arrow_udf(T.StringType())
    def run(c: pa.Array) -> pa.Array:
        return pa.array([recovered(t, field) for t in c.to_pylist()], pa.string())

    return run(column)
