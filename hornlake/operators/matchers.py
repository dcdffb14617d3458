"""Matchers: batches of patterns against string columns of loaded relations.

Each yields (value, pattern) pairs, distinct.  Values are reduced to distinct ones first; patterns are
part of the expression (there are as many as a configuration lists), so no join is needed and a
scan stays in generated code.
"""

from __future__ import annotations

import base64
import ipaddress
import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.builtins import java_pattern


GATED = 4  # with more patterns, one expression goes before them


def dash_forms(pattern: str) -> list[str]:
    """A leading - or / and its alternative."""
    return [pattern, {"-": "/", "/": "-"}[pattern[0]] + pattern[1:]] if pattern[:1] in ("-", "/") else [pattern]


def base64_needles(pattern: bytes) -> list[str]:
    """What the pattern's base64 must hold at each of the three alignments, without shared characters."""
    found = []
    for shift in range(3):
        text = base64.b64encode(b"\0" * shift + pattern).decode().rstrip("=")
        head = (shift * 8 + 5) // 6
        tail = (shift + len(pattern)) * 8 // 6
        if text[head:tail]:
            found.append(text[head:tail])
    return found


def _in_network(value: Column, pattern: str) -> Column:
    net = ipaddress.ip_network(pattern, strict=False)
    if net.version == 4:
        parts = F.split(value, r"\.")
        number = reduce(lambda a, b: a * 256 + b, [F.get(parts, F.lit(i)).try_cast("bigint") for i in range(4)])
        octet = r"(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
        low = int(net.network_address)
        return F.when(value.rlike(rf"^{octet}(\.{octet}){{3}}\z"), number.between(low, low + net.num_addresses - 1))

    @F.udf("boolean", useArrow=True)
    def inside(text):  # IPv6 literals have too many forms for expressions
        try:
            return ipaddress.ip_address(text) in net
        except ValueError:
            return False

    return F.when(value.contains(":"), inside(value))


def tests(kind: str, value: Column, pattern: str, case_insensitive: bool = False, windash: bool = False) -> Column:
    """True where the value matches the pattern."""
    if case_insensitive and kind in ("contains", "starts_with", "ends_with"):
        value, lowered = F.lower(value), pattern.lower()
    else:
        lowered = pattern
    forms = dash_forms(lowered) if windash and kind in ("contains", "starts_with") else [lowered]
    if kind == "contains":
        return reduce(lambda a, b: a | b, [value.contains(f) for f in forms])
    if kind == "starts_with":
        return reduce(lambda a, b: a | b, [value.startswith(f) for f in forms])
    if kind == "ends_with":
        return value.endswith(lowered)
    if kind == "regex_match":
        return value.rlike(("(?i)" if case_insensitive else "") + java_pattern(pattern))
    if kind in ("base64", "base64_utf16le"):
        needles = base64_needles(pattern.encode("utf-16-le" if kind == "base64_utf16le" else "utf-8"))
        return reduce(lambda a, b: a | b, [value.contains(n) for n in needles], F.lit(False))
    if kind == "cidr":
        return F.coalesce(_in_network(value, pattern), F.lit(False))
    raise ValueError(f"unknown matcher {kind}")


NAMES = {"base64": "base64_contains", "base64_utf16le": "base64_utf16le_contains", "cidr": "cidr_match"}


def produced(kind: str, case_insensitive: bool = False, windash: bool = False) -> str:
    """The predicate that a matcher fills."""
    base = NAMES.get(kind, kind)
    return ("ci_" if case_insensitive and kind not in NAMES else "") + ("wd_" if windash and kind in ("contains", "starts_with") else "") + base


def gate(kind: str, value: Column, patterns: list[str], case_insensitive: bool, windash: bool) -> Column | None:
    """One regular expression that every matching value passes, None where there is no such form.

    It only keeps values from the patterns' own tests, so it may let more pass but never fewer.
    """
    if kind == "regex_match":
        whole = "|".join(f"(?:{java_pattern(p)})" for p in patterns)
        return value.rlike(("(?i)" if case_insensitive else "") + whole)
    if kind in ("contains", "starts_with", "ends_with"):
        plain = [p for q in patterns for p in (dash_forms(q) if windash and kind != "ends_with" else [q])]
    elif kind in ("base64", "base64_utf16le"):
        plain = [n for p in patterns for n in base64_needles(p.encode("utf-16-le" if kind == "base64_utf16le" else "utf-8"))]
        case_insensitive = False
    else:
        return None
    if case_insensitive:
        value, plain = F.lower(value), [p.lower() for p in plain]
    if not plain:
        return F.lit(False)
    whole = "|".join(re.sub(r"[^A-Za-z0-9_\s]", lambda m: "\\" + m[0], p) for p in dict.fromkeys(plain))
    return value.rlike({"starts_with": rf"\A(?:{whole})", "ends_with": rf"(?:{whole})\z"}.get(kind, whole))


def match(df: DataFrame, column: str, kind: str, patterns: list[str], case_insensitive: bool = False, windash: bool = False) -> DataFrame:
    """(c0: value, c1: pattern) for each distinct string and each pattern that it matches."""
    values = df.select(F.col(column).alias("c0")).where("c0 IS NOT NULL").distinct()
    if len(patterns) > GATED and (test := gate(kind, F.col("c0"), patterns, case_insensitive, windash)) is not None:
        values = values.where(test)
    hits = F.array_compact(F.array(*[F.when(tests(kind, F.col("c0"), p, case_insensitive, windash), F.lit(p)) for p in dict.fromkeys(patterns)]))
    return values.select("c0", F.explode(hits).alias("c1"))
