"""Expressions of source mappings over a JSON record called `value`, and imperative programs.

The subset: member access (value.a.b, value["k"], value.list[0]), literals, arrays, ==, !=, <, <=, >, >=,
&&, ||, !, `in [..]`, ??, parentheses.  Anything else is refused.  A result is a (Column, kind) of
functions.values; what is missing is null.

A program is statements joined by `;`: `let x = e`, `let id = fresh_id()`, `assert("p", [e, ...])`,
`map(list, statements)` with `#` as the element, `match_contains("p", key, text, patterns)` and its
like, `e && statement`, `e ? statement : statement`.  Predicate names are literals, so that each
assertion is a relation of its own: a projection of the records, after an explode for each map around
it.  Only fresh_id() costs a pass, as all relations must see the same ids: its records are written first.
"""

from __future__ import annotations

import itertools
import json
import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.builtins import as_string, text_test
from ..functions.values import compare, literal, to_json
from .database import Relation
from .storage import materialize

_TOKEN = re.compile(r"""\s*(?:(?P<text>"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*')|(?P<number>-?\d+(?:\.\d+)?)|(?P<name>[A-Za-z_]\w*)|(?P<sign>==|!=|<=|>=|&&|\|\||\?\?|[.\[\](),<>!;=#?:]))""")
_MATCHES = {"match_contains": "@contains", "match_starts_with": "@starts_with", "match_ends_with": "@ends_with", "match_regex": "@regex_match"}
_STATEMENTS = ("let", "assert", "map", *_MATCHES)
_LEVELS = [["??"], ["||", "or"], ["&&", "and"], ["==", "!=", "<", "<=", ">", ">=", "in"]]


class MappingError(ValueError):
    """An expression outside the subset."""


class _Expression:
    def __init__(self, text: str, record: Column):
        self.text, self.names, self.tokens, at = text, {"value": (record, "variant")}, [], 0
        while text[at:].strip():
            m = _TOKEN.match(text, at)
            if not m:
                raise MappingError(f"cannot read {text[at:]!r}")
            self.tokens.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.at = 0

    def peek(self, n: int = 0):
        return self.tokens[self.at + n][1] if self.at + n < len(self.tokens) else ""

    def take(self, want: str | None = None):
        if self.at >= len(self.tokens) or want and self.peek() != want:
            raise MappingError(f"expected {want or 'a value'} in {self.text!r}")
        self.at += 1
        return self.tokens[self.at - 1]

    def whole(self):
        found = self.level(0)
        if self.at < len(self.tokens):
            raise MappingError(f"{self.peek()!r} is not supported in {self.text!r}")
        return found

    def level(self, n: int):
        if n == len(_LEVELS):
            return self.unary()
        left = self.level(n + 1)
        while self.peek() in _LEVELS[n] and self.peek(1) not in _STATEMENTS:
            op = self.take()[1]
            if op == "in":
                self.take("[")
                items = []
                while self.peek() != "]":
                    items.append(self.level(0))
                    if self.peek() == ",":
                        self.take()
                self.take("]")
                hit = F.lit(False)
                for item in items:
                    hit = hit | compare("=", *left, *item)
                left = hit, "bool"
                continue
            right = self.level(n + 1)
            if op == "??":
                a, b = to_json(*left), to_json(*right)
                left = F.when(a == "null", b).otherwise(a), "json"
            elif op in ("&&", "and"):
                left = truth(*left) & truth(*right), "bool"
            elif op in ("||", "or"):
                left = truth(*left) | truth(*right), "bool"
            else:
                left = compare("=" if op == "==" else op, *left, *right), "bool"
        return left

    def unary(self):
        if self.peek() in ("!", "not"):
            self.take()
            return ~truth(*self.unary()), "bool"
        if self.peek() == "(":
            self.take()
            inner = self.level(0)
            self.take(")")
            return inner
        kind, text = self.take()
        if kind == "text":
            return literal(self.string(text))
        if kind == "number":
            return literal(float(text) if "." in text else int(text))
        if text in ("true", "false", "nil"):
            return literal({"true": True, "false": False, "nil": None}[text])
        if text == "[":
            items = [to_json(*item) for item in self.items("]")]
            return F.concat(F.lit("["), F.concat_ws(",", *items), F.lit("]")), "json"
        if text not in self.names:
            raise MappingError(f"{text!r} is not supported in {self.text!r}")
        held, kind = self.names[text]
        path = "$"
        while self.peek() in (".", "["):
            if self.take()[1] == ".":
                path += f"['{self.take()[1]}']"
            else:
                sort, key = self.take()
                path += f"[{key}]" if sort == "number" else f"['{key[1:-1]}']"
                self.take("]")
        if path == "$" and kind != "variant":
            return held, kind
        if kind not in ("variant", "json"):
            return literal(None)
        found = F.try_variant_get(held if kind == "variant" else F.try_parse_json(held), path, "variant")
        return F.coalesce(F.to_json(found), F.lit("null")), "json"

    @staticmethod
    def string(text: str) -> str:
        return json.loads(text) if text[0] == '"' else text[1:-1]

    def items(self, end: str) -> list[tuple[Column, str]]:
        """Expressions between commas, up to the closing sign, which is taken."""
        found = []
        while self.peek() != end:
            found.append(self.level(0))
            if self.peek() != end:
                self.take(",")
        self.take(end)
        return found


class _Program(_Expression):
    """Runs statements over a frame of records; facts: the relations of each (predicate, arity)."""

    def __init__(self, text: str, rows: DataFrame, ids: Iterator[int], n_ids: int):
        super().__init__(text, F.col("record"))
        self.rows, self.ids, self.n_ids, self.slots = rows, ids, n_ids, itertools.count()
        self.facts: dict[tuple[str, int], list[Relation]] = {}
        self.numbered = False

    def statements(self, ends: tuple[str, ...]) -> None:
        while True:
            self.statement()
            if self.peek() != ";":
                break
            self.take()
            if self.peek() in ends:
                break
        if self.peek() not in ends:
            raise MappingError(f"{self.peek()!r} is not supported in {self.text!r}")

    def inner(self, rows: DataFrame, names: dict, run, ends=None) -> None:
        """Statements over other rows; names and rows are as before afterwards."""
        outer = self.rows, self.names
        self.rows, self.names = rows, self.names | names
        run(ends) if ends else run()
        self.rows, self.names = outer

    def fresh(self) -> tuple[Column, str]:
        """A column that numbers the rows, unlike every other one of the load."""
        name = f"_id{next(self.slots)}"
        number = F.monotonically_increasing_id() * F.lit(self.n_ids) + F.lit(next(self.ids))
        self.rows, self.numbered = materialize(self.rows.withColumn(name, number)), True
        return F.col(name), "id"

    def value(self) -> tuple[Column, str]:
        if self.peek() == "fresh_id":
            self.take(), self.take("("), self.take(")")
            return self.fresh()
        return self.level(0)

    def statement(self) -> None:
        word = self.peek()
        if word == "let":
            self.take()
            name = self.take()[1]
            self.take("=")
            self.names = self.names | {name: self.value()}
        elif word == "assert":
            self.take(), self.take("(")
            name = self.predicate()
            self.take("[")
            args = []
            while self.peek() != "]":
                args.append(self.value())
                if self.peek() != "]":
                    self.take(",")
            self.take("]"), self.take(")")
            self.emit(name, self.rows, args)
        elif word in _MATCHES:
            self.take(), self.take("(")
            name = self.predicate()
            key, hay, patterns = self.items(")")
            slot = f"_p{next(self.slots)}"
            rows = self.rows.withColumn(slot, F.explode(F.from_json(to_json(*patterns), "array<variant>")))
            needle, text = as_string(F.to_json(slot), "json"), as_string(*hay)
            hit = F.lit(False) if text is None else text_test(_MATCHES[word], text, needle, None)
            self.emit(name, rows.where(needle.isNotNull() & hit), [key, (needle, "string")])
        elif word == "map":
            self.take(), self.take("(")
            whole = to_json(*self.level(0))
            self.take(",")
            slot = f"_e{next(self.slots)}"
            rows = self.rows.withColumn(slot, F.explode(F.from_json(F.when(whole.startswith("["), whole), "array<variant>")))
            self.inner(rows, {"#": (F.col(slot), "variant")}, self.block, (")",))
            self.take(")")
        elif word == "(":
            self.group()
        else:
            test = truth(*self.level(0))
            if self.peek() in ("&&", "and"):
                self.take()
                self.inner(self.rows.where(test), {}, self.statement)
            elif self.peek() == "?":
                self.take()
                self.inner(self.rows.where(test), {}, self.statement)
                self.take(":")
                self.inner(self.rows.where(~test), {}, self.statement)

    def block(self, ends) -> None:
        self.group() if self.peek() == "(" else self.statements(ends)

    def group(self) -> None:
        self.take("(")
        self.statements((")",))
        self.take(")")

    def predicate(self) -> str:
        kind, text = self.take()
        if kind != "text":
            raise MappingError(f"a predicate's name must be a literal in {self.text!r}")
        if self.peek() == ",":
            self.take()
        return self.string(text)

    def emit(self, name: str, rows: DataFrame, args: list[tuple[Column, str]]) -> None:
        df = rows.select(*[c.alias(f"c{i}") for i, (c, _) in enumerate(args)])
        df = df.distinct()
        if self.numbered:  # a variant counts as 2 KB, so Spark takes what is left without it for a hundredth of its size and would broadcast it
            df = df.hint("merge")
        self.facts.setdefault((name, len(args)), []).append(Relation(df, [k for _, k in args]))


def run_program(text: str, rows: DataFrame, ids: Iterator[int] | None = None, n_ids: int | None = None) -> dict[tuple[str, int], list[Relation]]:
    """The relations that an imperative program asserts over (record variant) rows.

    ids: numbers below n_ids for the fresh_id() calls, one each, shared by all programs of a load.
    A list that is null or no list maps to nothing.
    """
    program = _Program(text, rows, ids or itertools.count(), n_ids or max(1, text.count("fresh_id")))
    program.statements(("",))
    return program.facts


def truth(column: Column, kind: str) -> Column:
    """Literally true; every other value is not."""
    return F.coalesce(column, F.lit(False)) if kind == "bool" else F.coalesce(column == "true", F.lit(False)) if kind == "json" else F.lit(False)


def compile_expression(text: str, record: Column) -> tuple[Column, str]:
    """The expression over a VARIANT column."""
    return _Expression(text, record).whole()
