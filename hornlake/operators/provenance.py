"""Why a fact holds: one witness per fact, as a single step or a tree.

A program evaluated with trace=True keeps what each round added.  A fact's witness is looked up among
the relations as they were before the fact's own round, so derivations are well founded, and nothing
is recorded while joining.  Each step is one filtered query; only a witness row comes to the driver.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from ..functions.values import Id
from ..plans.language import Aggregate, Atom, Const, Rule, Var, variables
from ..sources.database import Database, union
from .fixpoint import Program
from .rules import derive, solve

MAX_DEPTH, MAX_NODES, SAMPLES = 8, 200, 10


@dataclass
class Derivation:
    """A fact and its premises; rule None for a base fact.

    group: the number of an aggregate's solutions, of which `body` has one entry per sampled one.
    """

    fact: Atom
    rule: str | None = None
    doc: str = ""
    detail: list[str] = field(default_factory=list)
    body: list[Derivation] = field(default_factory=list)
    group: int | None = None
    repeated: bool = False
    truncated: bool = False

    def __str__(self):
        return "\n".join(self.lines())

    def lines(self, depth: int = 0) -> list[str]:
        pad = "  " * depth
        mark = " (seen above)" if self.repeated else " (cut)" if self.truncated else "" if self.rule else " (base)"
        if self.group is not None:
            mark += f" ({self.group} solutions, {len(self.body)} shown)"
        out = [f"{pad}{self.fact}{mark}"] + ([f"{pad}  by {self.rule}"] if self.rule else [])
        out += [f"{pad}  where {d}" for d in self.detail]
        return out + [line for b in self.body for line in b.lines(depth + 1)]


def _swap(x, bound: dict):
    """A term, expression or literal with variables replaced by constants."""
    if isinstance(x, Var):
        return bound.get(x.name, x)
    if isinstance(x, Const) or isinstance(x, str | bool):
        return x
    if isinstance(x, tuple):
        return tuple(_swap(v, bound) for v in x)
    return type(x)(*[_swap(v, bound) for v in x.__dict__.values()])


class Explainer:
    """Explanations over the database that a traced program derived from `base`."""

    def __init__(self, program: Program, base: Database):
        if not program.trace:
            raise ValueError("explanations need a program with trace=True")
        self.program, self.base = program, base
        self.derived = program.transform(base)

    @staticmethod
    def holds(db: Database, fact: Atom) -> bool:
        """Whether the fact is among the rows; nulls are values here, not wildcards."""
        rel = db.relations.get((fact.name, len(fact.terms)))
        found = rel is not None and solve(Rule(Atom("_", ()), (fact,)), db, Program("").functions)
        return bool(found) and not found[0].df.isEmpty()

    def step(self, fact: Atom) -> Derivation | None:
        """The fact with its premises, none of them explained; None if it does not hold."""
        if not self.holds(self.derived, fact):
            return None
        if self.holds(self.base, fact):
            return Derivation(fact)
        db = self._before(fact)
        for rule in self.program.rules:
            if (rule.head.name, len(rule.head.terms)) != (fact.name, len(fact.terms)):
                continue
            if not rule.body:
                if rule.head == fact:
                    return Derivation(fact, str(rule), rule.doc)
                continue
            if any(isinstance(t, Const) and t != v for t, v in zip(rule.head.terms, fact.terms, strict=True)):
                continue
            bound: dict = {}
            if any(isinstance(t, Var) and bound.setdefault(t.name, v) != v for t, v in zip(rule.head.terms, fact.terms, strict=True)):
                continue
            if found := self._aggregate(rule, fact, bound, db) if rule.aggregate else self._plain(rule, fact, bound, db):
                return found
        return Derivation(fact)

    def _before(self, fact: Atom) -> Database:
        """The derived relations, those of the fact's recursive group as they were before its round."""
        group = self.program.group_of(fact.name)
        rounds = {k: v for k, v in self.program.rounds.items() if k[0] in group}
        if not rounds:
            return self.derived
        mine = rounds.get((fact.name, len(fact.terms)), [])
        when = next((n for n, rel in mine if self.holds(Database(self.base.spark, {(fact.name, len(fact.terms)): rel}), fact)), 0)
        relations = {k: r for k, r in self.derived.relations.items() if k[0] not in group}
        for key, parts in rounds.items():
            if earlier := [rel for n, rel in parts if n < when]:
                relations[key] = union(earlier)
            elif key in self.base.relations:
                relations[key] = self.base.relations[key]
        return Database(self.base.spark, relations)

    def _ground(self, rule: Rule, bound: dict, row, kinds: dict) -> tuple[list[Atom], list[str]]:
        """(premises, other conditions) of a solution."""
        def constant(name):
            value = row[f"v_{name}"]
            if kinds[name] == "id" or kinds[name] == "json" and value[0] == "#":
                return Const(Id(str(value).lstrip("#")))
            return Const(json.loads(value) if kinds[name] == "json" else value)

        held = bound | {n: constant(n) for n in kinds if n not in bound}
        body = [_swap(b, held) for b in rule.body]
        fact = [isinstance(b, Atom) and b.name[0] != "@" and not b.negated for b in body]
        return [b for b, f in zip(body, fact, strict=True) if f], [str(b) for b, f in zip(body, fact, strict=True) if not f]

    @staticmethod
    def _whole(rule: Rule) -> Rule:
        """The rule with a name for each anonymous variable of a positive atom, so that witnesses have all values."""
        n = 0
        body = []
        used = [v for b in rule.body for v in variables(b)]
        for b in rule.body:
            if isinstance(b, Atom) and not b.negated and b.name[0] != "@":
                terms = []
                for t in b.terms:
                    if isinstance(t, Var) and t.anonymous and used.count(t.name) == 1:
                        t, n = Var(f"_w{n}"), n + 1
                    terms.append(t)
                b = Atom(b.name, tuple(terms))
            body.append(b)
        return Rule(rule.head, tuple(body), rule.aggregate, rule.doc)

    def _plain(self, rule: Rule, fact: Atom, bound: dict, db: Database) -> Derivation | None:
        full = self._whole(rule)
        left = sorted(set().union(*(variables(b) for b in full.body if not (isinstance(b, Atom) and b.negated))) - bound.keys())
        found = solve(Rule(Atom("_", tuple(map(Var, left))), _swap(full.body, bound)), db, self.program.functions)
        row = found and found[0].df.limit(1).collect()
        if not row:
            return None
        premises, detail = self._ground(full, bound, row[0], {n: k for n, k in found[0].kinds.items() if n in left})
        return Derivation(fact, str(rule), rule.doc, detail, [Derivation(p) for p in premises])

    def _aggregate(self, rule: Rule, fact: Atom, bound: dict, db: Database) -> Derivation | None:
        full = self._whole(rule)
        keys = {n: v for n, v in bound.items() if n != rule.aggregate.result.name}
        term = _swap(rule.aggregate.term, keys)
        grouped = Rule(_swap(full.head, keys), _swap(full.body, keys), Aggregate(rule.aggregate.kind, rule.aggregate.result, term))
        made = derive(grouped, db, self.program.functions)
        if made is None or not self.holds(Database(db.spark, {(fact.name, len(fact.terms)): made}), fact):
            return None
        solutions, _ = solve(grouped, db, self.program.functions)
        out = Derivation(fact, str(rule), rule.doc, group=solutions.df.count())
        for row in solutions.df.limit(SAMPLES).collect():
            premises, detail = self._ground(full, keys, row, solutions.kinds)
            out.body.append(Derivation(fact, str(rule), "", detail, [Derivation(p) for p in premises]))
        return out

    def tree(self, fact: Atom, max_depth: int = MAX_DEPTH, max_nodes: int = MAX_NODES) -> Derivation | None:
        """The fact's derivation down to base facts; a fact met again is only referred to.

        The caps bound the output: a node beyond them is cut.
        """
        seen: set[str] = set()
        nodes = 1

        def grow(fact: Atom, depth: int) -> Derivation:
            nonlocal nodes
            if str(fact) in seen:
                return Derivation(fact, repeated=True)
            seen.add(str(fact))
            found = self.step(fact) or Derivation(fact)
            for holder in found.body if found.group is not None else [found]:
                premises, holder.body = holder.body, []
                for p in premises:
                    if depth >= max_depth or nodes >= max_nodes:
                        holder.truncated = True
                        break
                    nodes += 1
                    holder.body.append(grow(p.fact, depth + 1))
            return found

        return grow(fact, 0) if self.holds(self.derived, fact) else None
