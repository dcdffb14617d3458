"""Values by kind: integer, float, string, bool, id (synthetic, equal to ids only), and json for everything else.

json is the encoding of values whose kind varies by row: canonical JSON text, so that equal texts are
equal values and null is a value; an id among them is # and its number, which no JSON text is.  Columns of one kind stay native, for pushdown and code generation.
"""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMBERS = ("integer", "float")


class Id(int):
    """A synthetic id as a constant."""


def kind_of(dtype: T.DataType) -> str:
    if isinstance(dtype, T.ByteType | T.ShortType | T.IntegerType | T.LongType):
        return "integer"
    if isinstance(dtype, T.FloatType | T.DoubleType | T.DecimalType):
        return "float"
    return "bool" if isinstance(dtype, T.BooleanType) else "string"


def native(column: Column, dtype: T.DataType) -> tuple[Column, str]:
    """A table's column as a value: timestamps become RFC 3339 text, nested types canonical JSON."""
    if isinstance(dtype, T.TimestampType | T.TimestampNTZType | T.DateType):
        return F.date_format(column.cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"), "string"
    if isinstance(dtype, T.ArrayType | T.MapType | T.StructType):
        return F.to_json(column), "json"
    kind = kind_of(dtype)
    return column.cast({"integer": "bigint", "float": "double", "bool": "boolean", "string": "string"}[kind]), kind


def literal(value) -> tuple[Column, str]:
    if value is None:
        return F.lit("null"), "json"
    if isinstance(value, bool):
        return F.lit(value), "bool"
    if isinstance(value, Id):
        return F.lit(int(value)).cast("bigint"), "id"
    if isinstance(value, int):
        return F.lit(value).cast("bigint"), "integer"
    if isinstance(value, float):
        return F.lit(value), "float"
    if isinstance(value, list | dict):
        return F.lit(json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)), "json"
    return F.lit(value), "string"


def to_json(column: Column, kind: str) -> Column:
    """Canonical JSON text of a value."""
    if kind == "json":
        return column
    if kind == "id":
        return F.concat(F.lit("#"), column.cast("string"))
    if kind == "float":
        whole = (column == F.floor(column)) & (F.abs(column) < F.lit(2.0**63))
        return F.when(whole, column.cast("decimal(20,0)").cast("string")).otherwise(column.cast("string"))
    if kind == "string":
        text = F.to_json(F.array(column))
        return F.coalesce(F.substring(text, 2, F.length(text) - 2), F.lit("null"))
    return F.coalesce(column.cast("string"), F.lit("null"))


def same(a: Column, ka: str, b: Column, kb: str) -> Column:
    """Identity of values; null is equal to itself, kinds never convert but for whole floats."""
    if ka == kb:
        return a.eqNullSafe(b)
    if ka in NUMBERS and kb in NUMBERS:
        return ordered("=", a, ka, b, kb)
    if "json" in (ka, kb):
        return to_json(a, ka).eqNullSafe(to_json(b, kb))
    return F.lit(False)


_TESTS = {"=": lambda a, b: a == b, "<": lambda a, b: a < b, ">": lambda a, b: a > b, "<=": lambda a, b: a <= b, ">=": lambda a, b: a >= b}


def ordered(op: str, a: Column, ka: str, b: Column, kb: str) -> Column:
    """a op b where both are numbers or both strings, false where they are not or are NaN."""
    test = _TESTS[op]
    if "json" in (ka, kb):
        ja, jb = to_json(a, ka), to_json(b, kb)
        number = lambda j: F.when(j.rlike("^-?[0-9]"), j.try_cast("double"))
        string = lambda j: F.when(j.startswith('"'), F.get(F.from_json(F.concat(F.lit("["), j, F.lit("]")), "array<string>"), F.lit(0)))
        na, nb, sa, sb = number(ja), number(jb), string(ja), string(jb)
        return F.coalesce(F.when(na.isNotNull(), test(na, nb)).when(sa.isNotNull(), test(sa, sb)), F.lit(False))
    if ka == kb == "integer" or ka == kb == "string":
        return F.coalesce(test(a, b), F.lit(False))
    if ka not in NUMBERS or kb not in NUMBERS:
        return F.lit(False)
    sane = F.lit(True)
    for c, k in ((a, ka), (b, kb)):
        if k == "float":
            sane = sane & ~F.isnan(c)
    result = test(a.cast("double"), b.cast("double"))
    if ka != kb:  # a big integer's double may equal what the integer does not
        def exact(c):
            return F.when((c >= F.lit(-(2.0**63))) & (c < F.lit(2.0**63)), c.cast("decimal(38,10)"))

        ia, ib = (a.cast("decimal(38,10)"), exact(b)) if ka == "integer" else (exact(a), b.cast("decimal(38,10)"))
        result = F.when(a.cast("double") == b.cast("double"), F.coalesce(test(ia, ib), result)).otherwise(result)
    return F.coalesce(sane & result, F.lit(False))


def compare(op: str, a: Column, ka: str, b: Column, kb: str) -> Column:
    if op == "=":
        return same(a, ka, b, kb)
    return ~same(a, ka, b, kb) if op == "!=" else ordered(op, a, ka, b, kb)


def arithmetic(op: str, a: Column, ka: str, b: Column, kb: str) -> tuple[Column, str]:
    """(value, kind); NULL where there is no result.  Integer overflow fails the query under ANSI."""
    if "json" in (ka, kb):
        number = lambda c, k: F.when(to_json(c, k).rlike("^-?[0-9]"), to_json(c, k).try_cast("double"))
        a, b, ka, kb = number(a, ka), number(b, kb), "float", "float"
    if ka not in NUMBERS or kb not in NUMBERS:
        return F.lit(None).cast("bigint"), "integer"
    kind = "integer" if ka == kb == "integer" else "float"
    a, b = (c.cast("bigint" if kind == "integer" else "double") for c in (a, b))
    if op in ("/", "mod"):
        if op == "mod":
            return F.when(b != 0, F.try_mod(a, b)), kind
        return F.when(b != 0, F.call_function("div", a, b) if kind == "integer" else a / b), kind
    return {"+": a + b, "-": a - b, "*": a * b}[op], kind
