"""Builtins of rule bodies as Column functions.

A value builtin maps its input (Column, kind) pairs to one (Column, kind), NULL for no result.  A multi
builtin maps them to (array-of-struct Column, kinds of its outputs), exploded into rows.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .values import to_json


def java_pattern(pattern: str) -> str:
    """The pattern for Java's engine: named groups, end of text; look-around and back-references are refused."""
    if re.search(r"\(\?<?[=!]|\\[1-9]", pattern):
        raise ValueError(f"pattern {pattern!r} uses look-around or back-references")
    out, inside, i = [], False, 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            out.append(pattern[i : i + 2])
            i += 2
            continue
        inside = c == "[" or inside and c != "]"
        out.append(r"\z" if c == "$" and not inside else c)
        i += 1
    return "".join(out).replace("(?P<", "(?<")


def _search(text, pattern):
    """A pattern that varies by row; one that does not compile matches nothing, where rlike would fail the query."""
    try:
        return text is not None and pattern is not None and re.search(pattern, text) is not None
    except re.error:
        return False


def text_test(name: str, hay: Column, needle: Column, constant) -> Column:
    if name == "@regex_match":
        test = hay.rlike(java_pattern(constant)) if isinstance(constant, str) else F.udf(_search, T.BooleanType(), useArrow=True)(hay, needle)
    else:
        test = {"@contains": hay.contains, "@starts_with": hay.startswith, "@ends_with": hay.endswith}[name](needle)
    return F.coalesce(test, F.lit(False))


def _text(c: Column) -> Column:
    return F.get(F.from_json(F.concat(F.lit("["), c, F.lit("]")), "array<string>"), F.lit(0))


def as_string(c: Column, kind: str) -> Column | None:
    """The string, NULL for other values; None if the kind is never a string."""
    if kind == "string":
        return c
    return F.when(c.startswith('"'), _text(c)) if kind == "json" else None


def json_get(whole, key):
    (c, kind), (k, key_kind) = whole, key
    if kind not in ("json", "string"):
        return F.lit(None).cast("string"), "json"
    if key_kind == "string":
        found = F.element_at(F.from_json(c, "map<string,variant>"), k)
        return F.when(c.startswith("{"), F.to_json(found)), "json"
    found = F.get(F.from_json(c, "array<variant>"), k.cast("int"))
    return F.when(c.startswith("["), F.to_json(found)), "json"


def json_len(whole):
    c, _ = whole
    return F.when(c.startswith("["), F.json_array_length(c)).when(c.startswith("{"), F.size(F.json_object_keys(c))).cast("bigint"), "integer"


def json_type(value):
    c, kind = value
    if kind != "json":
        return F.lit(kind), "string"
    first = F.substring(c, 1, 1)
    number = F.when(c.rlike("^-?[0-9]+$"), "integer").otherwise("float")
    return F.when(first == "{", "object").when(first == "[", "array").when(first == '"', "string").when(first == "n", "null").when(first == "#", "id").when(first.isin("t", "f"), "bool").otherwise(number), "string"


def json_slice(whole, start):
    (c, _), (n, _) = whole, start
    items = F.from_json(F.when(c.startswith("["), c), "array<variant>")
    rest = F.concat(F.lit("["), F.array_join(F.transform(F.slice(items, n.cast("int") + 1, F.greatest(F.size(items), F.lit(1))), lambda v: F.to_json(v)), ","), F.lit("]"))
    return F.when((n >= 0) & (n <= F.size(items)), rest), "json"


def json_each(whole):
    items = F.from_json(F.when(whole[0].startswith("["), whole[0]), "array<variant>")
    return F.transform(items, lambda v: F.struct(F.to_json(v).alias("o0"))), ["json"]


def json_items(whole):
    items = F.map_entries(F.from_json(F.when(whole[0].startswith("{"), whole[0]), "map<string,variant>"))
    return F.transform(items, lambda e: F.struct(e["key"].alias("o0"), F.to_json(e["value"]).alias("o1"))), ["string", "json"]


def seconds(value) -> Column:
    c, kind = value
    if kind in ("integer", "float"):
        return c.cast("double")
    text = as_string(c, kind)
    moment = F.unix_micros(F.try_to_timestamp(text)) / F.lit(1_000_000.0)
    return F.coalesce(moment, c.try_cast("double")) if kind == "json" else moment


def time_diff(a, b):
    return seconds(a) - seconds(b), "float"


VALUES = {"@json_get": (3, json_get), "@json_len": (2, json_len), "@json_type": (2, json_type), "@json_slice": (3, json_slice), "@time_diff": (3, time_diff)}
MULTI = {"@json_each": (1, json_each), "@json_items": (2, json_items)}
__all__ = ["MULTI", "VALUES", "as_string", "java_pattern", "text_test", "to_json"]
