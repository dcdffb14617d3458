"""Rule programs: syntax tree, parser and printer.

Statements end in '.' (facts, rules) or '?' (queries).  `Head :- A, B.` derives, `Head :- R = sum(X) : A.`
aggregates, `not`, comparisons, `X is Expr` and `@builtin(...)` stand in bodies, object and array patterns
in arguments become builtin atoms while parsing.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field


@dataclass(frozen=True)
class Var:
    name: str

    @property
    def anonymous(self) -> bool:
        return self.name[0] == "?"

    def __str__(self):
        return self.name


@dataclass(frozen=True)
class Const:
    value: object

    def __str__(self):
        return json.dumps(self.value, ensure_ascii=False)


@dataclass(frozen=True)
class Op:
    op: str
    left: object
    right: object

    def __str__(self):
        return f"({self.left} {self.op} {self.right})"


@dataclass(frozen=True)
class Atom:
    """A predicate or an @builtin over terms, maybe negated."""

    name: str
    terms: tuple
    negated: bool = False

    def __str__(self):
        return ("not " if self.negated else "") + f"{self.name}({', '.join(map(str, self.terms))})"


@dataclass(frozen=True)
class Compare:
    op: str
    left: object
    right: object

    def __str__(self):
        return f"{self.left} {self.op} {self.right}"


@dataclass(frozen=True)
class Is:
    var: object
    expr: object

    def __str__(self):
        return f"{self.var} is {self.expr}"


@dataclass(frozen=True)
class Aggregate:
    kind: str
    result: Var
    term: object

    def __str__(self):
        return f"{self.result} = {self.kind}" + ("" if self.kind == "count" else f"({self.term})")


@dataclass(frozen=True)
class Rule:
    head: Atom
    body: tuple = ()
    aggregate: Aggregate | None = None
    doc: str = field(default="", compare=False)

    def __str__(self):
        if not self.body:
            return f"{self.head}."
        over = f"{self.aggregate} : " if self.aggregate else ""
        return f"{self.head} :- {over}{', '.join(map(str, self.body))}."


@dataclass(frozen=True)
class Query:
    body: tuple

    def __str__(self):
        return f"{', '.join(map(str, self.body))}?"


class ProgramError(ValueError):
    """A program that does not parse or is not valid; the message has line and column if they are known."""


_TOKENS = re.compile(
    r"""(?P<space>\s+)|(?P<doc>%%[^\n]*)|(?P<comment>%[^\n]*)|(?P<string>"(?:[^"\\\n]|\\.)*")"""
    r"""|(?P<number>\d+\.\d+(?:[eE][+-]?\d+)?|\d+(?:[eE][+-]?\d+)?)|(?P<anon>\?\d+)|(?P<name>@?[^\W\d]\w*)"""
    r"""|(?P<sign>:-|!=|<=|>=|[-.,()?:=<>+*/{}\[\]|])"""
)
AGGREGATES = ("count", "sum", "min", "max")
COMPARISONS = ("=", "!=", "<", ">", "<=", ">=")


class _Parser:
    def __init__(self, text: str):
        self.text, self.at, self.fresh, self.extra = text, 0, 0, []
        self.tokens, self.docs, self.warnings, place, doc = [], {}, [], 0, []
        while place < len(text):
            m = _TOKENS.match(text, place)
            if not m:
                raise self.error(f"unexpected {text[place]!r}", place)
            if m.lastgroup == "doc":
                doc.append(m.group()[2:].strip())
            elif m.lastgroup == "space" and m.group().count("\n") > 1 and doc:
                self.warnings.append(f"line {text.count(chr(10), 0, place) + 1}: documentation is not followed by a statement")
                doc = []
            elif m.lastgroup not in ("space", "comment"):
                if doc:
                    self.docs[len(self.tokens)] = "\n".join(doc)
                    doc = []
                self.tokens.append((m.lastgroup, m.group(), place))
                if m.lastgroup == "anon":
                    self.fresh = max(self.fresh, int(m.group()[1:]) + 1)
            place = m.end()
        if doc:
            self.warnings.append("documentation at the end is not followed by a statement")
        self.tokens.append(("end", "", len(text)))

    def error(self, what: str, place: int | None = None) -> ProgramError:
        place = self.tokens[self.at][2] if place is None else place
        line, column = self.text.count("\n", 0, place) + 1, place - self.text.rfind("\n", 0, place)
        return ProgramError(f"line {line}, column {column}: {what}")

    def peek(self, n: int = 0) -> str:
        return self.tokens[min(self.at + n, len(self.tokens) - 1)][1]

    def kind(self, n: int = 0) -> str:
        return self.tokens[min(self.at + n, len(self.tokens) - 1)][0]

    def take(self, want: str | None = None) -> str:
        if want is not None and self.peek() != want:
            raise self.error(f"expected {want!r}, found {self.peek()!r}")
        self.at += 1
        return self.tokens[self.at - 1][1]

    def anonymous(self) -> Var:
        self.fresh += 1
        return Var(f"?{self.fresh - 1}")

    def program(self) -> list:
        found = []
        while self.kind() != "end":
            found.append(self.statement())
        return found

    def statement(self):
        doc, start = self.docs.get(self.at, ""), self.at
        self.extra = []
        first = self.literal()
        if self.peek() in (",", "?"):
            body = self.body([first])
            self.take("?")
            return Query(body)
        if not isinstance(first, Atom) or first.negated or first.name[0] == "@":
            raise self.error("a head must be a plain predicate", self.tokens[start][2])
        if self.extra:
            raise self.error("patterns are not allowed in heads", self.tokens[start][2])
        if self.peek() == ".":
            self.take()
            if any(isinstance(t, Var) for t in first.terms):
                raise self.error("a fact's terms must be constants", self.tokens[start][2])
            return Rule(first, doc=doc)
        self.take(":-")
        aggregate = None
        if self.kind() == "name" and self.peek(1) == "=" and self.peek(2) in AGGREGATES and self.peek(3) in (":", "("):
            result, _, kind, term = Var(self.take()), self.take(), self.take(), Const(1)
            if kind != "count":
                self.take("(")
                term = self.term()
                self.take(")")
            self.take(":")
            aggregate = Aggregate(kind, result, term)
        body = self.body([self.literal()])
        self.take(".")
        return Rule(first, body, aggregate, doc)

    def body(self, found: list) -> tuple:
        """The literals from the first on, each followed by the getters of its patterns."""
        found += self.extra
        while self.peek() == ",":
            self.take()
            self.extra = []
            found.append(self.literal())
            found += self.extra
        return tuple(found)

    def literal(self):
        if self.peek() == "not" and self.kind(1) == "name":
            self.take()
            kept, self.extra = self.extra, []
            atom = self.literal()
            if self.extra:
                raise self.error("patterns are not allowed under negation")
            self.extra = kept
            if not isinstance(atom, Atom):
                raise self.error("only predicates can be negated")
            return Atom(atom.name, atom.terms, True)
        if self.kind() == "name" and self.peek(1) == "(":
            name = self.take()
            self.take("(")
            terms = []
            while self.peek() != ")":
                terms.append(self.argument())
                if self.peek() != ")":
                    self.take(",")
            self.take(")")
            return Atom(name, tuple(terms))
        left = self.expression()
        if self.peek() == "is":
            self.take()
            return Is(left, self.expression())
        if self.peek() not in COMPARISONS:
            raise self.error(f"expected a comparison, found {self.peek()!r}")
        return Compare(self.take(), left, self.expression())

    def argument(self):
        if self.peek() == "{":
            return self.object_pattern()
        if self.peek() == "[":
            return self.array_pattern()
        return self.term()

    def object_pattern(self) -> Var:
        whole, fields = self.anonymous(), 0
        self.take("{")
        while self.peek() != "}":
            key = self.take()
            if key[0] != '"' and not key[0].islower():
                raise self.error("quote keys that do not begin with a lower-case letter")
            key = json.loads(key) if key[0] == '"' else key
            self.take(":")
            self.getter("@json_get", whole, Const(key))
            fields += 1
            if self.peek() != "}":
                self.take(",")
        self.take("}")
        if not fields:
            self.extra.append(Atom("@json_type", (whole, Const("object"))))
        return whole

    def getter(self, name: str, whole: Var, key: Const) -> None:
        slot = len(self.extra)
        value = self.argument()
        self.extra.insert(slot, Atom(name, (whole, key, value)))

    def array_pattern(self) -> Var:
        whole, n = self.anonymous(), 0
        self.take("[")
        while self.peek() not in ("]", "|"):
            self.getter("@json_get", whole, Const(n))
            n += 1
            if self.peek() == ",":
                self.take()
        if self.peek() == "|":
            self.take()
            self.extra.append(Atom("@json_slice", (whole, Const(n), self.term())))
        else:
            self.extra.append(Atom("@json_len", (whole, Const(n))))
        self.take("]")
        return whole

    def term(self):
        if self.peek() == "-":
            self.take()
            if self.kind() != "number":
                raise self.error("expected a number")
            return Const(-self.number())
        kind, text = self.kind(), self.peek()
        if kind == "number":
            return Const(self.number())
        if kind == "string":
            self.take()
            return Const(json.loads(text))
        if text == "?" or text == "_":
            self.take()
            return self.anonymous()
        if kind in ("name", "anon") and text[0] != "@":
            self.take()
            return Const({"true": True, "false": False, "null": None}[text]) if text in ("true", "false", "null") else Var(text)
        raise self.error(f"expected a term, found {text!r}")

    def number(self):
        text = self.take()
        return int(text) if text.isdigit() else float(text)

    def expression(self):
        left = self.product()
        while self.peek() in ("+", "-"):
            left = Op(self.take(), left, self.product())
        return left

    def product(self):
        left = self.unary()
        while self.peek() in ("*", "/", "mod"):
            left = Op(self.take(), left, self.unary())
        return left

    def unary(self):
        if self.peek() == "(":
            self.take()
            inner = self.expression()
            self.take(")")
            return inner
        if self.peek() == "-" and self.kind(1) != "number":
            self.take()
            return Op("-", Const(0), self.unary())
        return self.term()


def parse(text: str) -> list:
    """The Rules and Queries of a program."""
    return _Parser(text).program()


def doc_warnings(text: str) -> list[str]:
    """Blocks of documentation that a blank line or the end of the program separates from a statement."""
    return _Parser(text).warnings


def variables(x) -> set[str]:
    """Names of the variables in a term, expression, literal or tuple of them."""
    if isinstance(x, Var):
        return {x.name}
    if isinstance(x, tuple):
        return set().union(*map(variables, x))
    if isinstance(x, Op | Compare):
        return variables(x.left) | variables(x.right)
    if isinstance(x, Is):
        return variables(x.var) | variables(x.expr)
    return variables(x.terms) if isinstance(x, Atom) else set()
