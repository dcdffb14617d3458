"""A session: data, rules that can change, cached fixpoints, catalogue and explanations."""

from __future__ import annotations

from pyspark.sql import DataFrame

from .operators.fixpoint import Program, run_query
from .operators.provenance import MAX_DEPTH, MAX_NODES, Derivation, Explainer
from .operators.rules import Functions
from .plans.language import Atom, parse
from .sources.database import Database, Relation
from .sources.storage import hold


class Session:
    """Rules are evaluated once per change; a query then runs on the derived database."""

    def __init__(self, db: Database, rules: str = "", functions: Functions | None = None):
        self.db, self.functions = db, functions or Functions()
        self.text, self.cached, self.traced = rules, None, None
        self.program = Program(rules, self.functions)

    def set_rules(self, rules: str) -> None:
        """Replace the rules; if they are not valid the old ones stay."""
        self.program, self.text, self.cached, self.traced = Program(rules, self.functions), rules, None, None

    def set_data(self, db: Database) -> None:
        self.db, self.cached, self.traced = db, None, None

    def derived(self) -> Database:
        if self.cached is None:
            made = self.program.transform(self.db) if self.program.rules else self.db
            new = {k: Relation(hold(r.df)[0], r.kinds) for k, r in made.relations.items() if r is not self.db.relations.get(k)}
            self.cached = Database(made.spark, made.relations | new)  # evaluated once, not once a query
        return self.cached

    def query(self, text: str, limit: int = 100) -> DataFrame:
        """At most min(limit, 1000) distinct solutions, in order."""
        found = run_query(self.derived(), text, self.functions)
        return found.orderBy(*found.columns).limit(min(limit, 1000)) if found.columns else found.limit(1)

    def answer(self, text: str, limit: int = 100) -> dict:
        """{"columns", "rows", "total", "truncated"}: at most min(limit, 1000) solutions in order, and how many there are."""
        found = run_query(self.derived(), text, self.functions)
        total, most = found.count(), min(limit, 1000)
        rows = [tuple(r) for r in self.query(text, limit).collect()]
        return {"columns": found.columns, "rows": rows, "total": total, "truncated": total > most}

    def render(self, text: str, limit: int = 100) -> str:
        """The solutions as lines of `name = value`, and a note where there are more."""
        found = self.answer(text, limit)
        if not found["columns"]:
            return "yes" if found["total"] else "no"
        lines = [", ".join(f"{c} = {v}" for c, v in zip(found["columns"], r, strict=True)) for r in found["rows"]]
        return "\n".join([*lines, f"... {found['total'] - len(lines)} more"] if found["truncated"] else lines or ["no"])

    def predicates(self) -> list[dict]:
        """Name, arity, count and documentation of each relation."""
        docs: dict[str, list[str]] = {}
        for r in self.program.rules:
            if r.doc:
                docs.setdefault(r.head.name, []).append(r.doc)
        return [{"name": n, "arity": a, "count": c, "doc": "\n\n".join(docs.get(n, []))} for (n, a), c in sorted(self.derived().counts().items())]

    def describe(self, name: str) -> dict:
        """The rules that derive and that use a predicate, and its facts by arity."""
        uses = lambda r: any(isinstance(b, Atom) and b.name == name for b in r.body)
        return {"derived_by": [str(r) for r in self.program.rules if r.head.name == name], "used_by": [str(r) for r in self.program.rules if uses(r)], "counts": {a: r.df.count() for (n, a), r in sorted(self.derived().relations.items()) if n == name}}

    def dependencies(self, name: str) -> dict[str, list[str]]:
        """Predicates that a predicate reads, directly or not, and those that read it."""
        edges = {(r.head.name, b.name) for r in self.program.rules for b in r.body if isinstance(b, Atom) and b.name[0] != "@"}

        def reach(start: str, forward: bool) -> list[str]:
            seen, todo = set(), [start]
            while todo:
                at = todo.pop()
                for a, b in edges:
                    here, there = (a, b) if forward else (b, a)
                    if here == at and there not in seen:
                        seen.add(there)
                        todo.append(there)
            return sorted(seen)

        return {"reads": reach(name, True), "read_by": reach(name, False)}

    def explainer(self) -> Explainer:
        if self.traced is None:
            self.traced = Explainer(Program(self.text, self.functions, trace=True), self.db)
        return self.traced

    def explain(self, fact: str) -> dict | None:
        """One derivation of a ground fact: {"fact", "rule", "premises", "detail", "solutions"}; rule None for a base fact.

        None if the fact is not there.  Premises are positive body atoms with the values of one
        witness, of an aggregate those of its first sampled solution, whose number is in "solutions".
        """
        found = self.explainer().step(ground(fact))
        if found is None:
            return None
        one = found.body[0] if found.group else found
        return {"fact": str(found.fact), "rule": found.rule, "premises": [str(b.fact) for b in one.body], "detail": one.detail, "solutions": found.group}

    def explain_tree(self, fact: str, max_depth: int = MAX_DEPTH, max_nodes: int = MAX_NODES) -> Derivation | None:
        """The derivation of a ground fact down to base facts, None if the fact is not there."""
        return self.explainer().tree(ground(fact), max_depth, max_nodes)


def ground(fact: str) -> Atom:
    return parse(fact.rstrip(". ") + ".")[0].head
