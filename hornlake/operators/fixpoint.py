"""Evaluation of a program: groups of predicates in order, recursive ones to their fixpoint.

A round joins only what the last round added (the delta) with all that is known, drops what is known
by an anti join, and holds the rest in the shared folder (small rounds in memory), so lineage stays
short and a lost executor costs one round.  Predicates that are closures by their rules are evaluated
by contraction and powers, see closure.
"""

from __future__ import annotations

import time
import uuid
from contextlib import contextmanager, nullcontext
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.analysis import check_rule, needed, strata
from ..plans.language import Atom, Compare, ProgramError, Query, Rule, Var, parse, variables
from ..sources.config import check_types
from ..sources.database import SQL_TYPES, Database, Relation, from_frame, from_tuples, joint_kinds, union
from ..sources.storage import SMALL_ROWS, hold
from .closure import Closure, closure, closure_by_hubs, generations
from .pairs import halves, unique
from .rules import Functions, derive

MAX_ROUNDS = 10_000
COMPACT_ROUNDS = 8
BROADCAST_ROWS = 200_000


@dataclass
class Stratum:
    """Profile of one evaluated group."""

    predicates: list[str]
    rules: int
    rounds: int
    facts: int
    seconds: float


def closure_base(name: str, loops: list[Rule], seeds: list[Rule], loaded: bool) -> bool:
    """True if the recursive rules make the predicate the transitive closure of what it has without them.

    r(X,Y) :- r(X,Z), r(Z,Y) always does.  With one edge atom in the place of an r, that holds only
    where r(X,Y) :- e(X,Y) is all that r has; loaded: it has facts besides its rules.
    """
    if len(loops) != 1 or loops[0].aggregate or len(loops[0].body) != 2 or not all(isinstance(b, Atom) and not b.negated and len(b.terms) == 2 for b in loops[0].body):
        return False
    head, (first, second) = loops[0].head, loops[0].body
    if len(head.terms) != 2 or not all(isinstance(t, Var) for t in (*head.terms, *first.terms, *second.terms)):
        return False
    for left, right in ((first, second), (second, first)):
        if left.terms[0] == head.terms[0] and left.terms[1] == right.terms[0] and right.terms[1] == head.terms[1] and len({*head.terms, left.terms[1]}) == 3:
            break
    else:
        return False
    if first.name == second.name == name:
        return True
    edge = first.name if second.name == name else second.name
    if loaded or len(seeds) != 1 or seeds[0].aggregate or len(seeds[0].body) != 1 or not isinstance(seeds[0].body[0], Atom):
        return False
    base = seeds[0].body[0]
    return base.name == edge != name and not base.negated and base.terms == seeds[0].head.terms and len(set(base.terms)) == 2 and all(isinstance(t, Var) for t in base.terms)


def generation_base(name: str, loops: list[Rule], seeds: list[Rule]) -> str | None:
    """The relation e where the rules are r(A,B) :- e(A,P), e(B,P) and r(A,B) :- e(A,P), r(P,Q), e(B,Q)."""
    if len(loops) != 1 or len(seeds) != 1 or len(seeds[0].body) != 2 or len(loops[0].body) != 3:
        return None
    for r in (loops[0], seeds[0]):
        if r.aggregate or not all(isinstance(b, Atom) and not b.negated and len(b.terms) == 2 and all(isinstance(t, Var) for t in b.terms) for b in (r.head, *r.body)):
            return None
    edge, other = seeds[0].body[0].name, [b for b in loops[0].body if b.name != name]
    (a, b), (x, y) = seeds[0].head.terms, loops[0].head.terms
    middle = next((b for b in loops[0].body if b.name == name), None)
    if middle is None or len(other) != 2 or {o.name for o in other} | {o.name for o in seeds[0].body} != {edge} or len({x, y, *middle.terms}) != 4:
        return None
    hub = seeds[0].body[0].terms[1]
    if len({a, b, hub}) != 3 or {o.terms for o in seeds[0].body} != {(a, hub), (b, hub)} or {o.terms for o in other} != {(x, middle.terms[0]), (y, middle.terms[1])}:
        return None
    return edge


class Cancelled(ProgramError):
    """The evaluation was cancelled."""


class FactLimitError(ProgramError):
    """More facts were derived than allowed."""


class Cancel:
    """Cancels evaluations that were given it: their Spark jobs are interrupted, and no round begins."""

    def __init__(self):
        self.tag, self.spark, self.asked = f"hornlake-{uuid.uuid4().hex}", None, False

    def cancel(self) -> None:
        self.asked = True
        if self.spark is not None:
            self.spark.sparkContext.cancelJobsWithTag(self.tag)

    @contextmanager
    def watch(self, spark):
        self.spark = spark
        spark.sparkContext.addJobTag(self.tag)
        try:
            self.check()
            yield
        except Exception as e:
            if self.asked and not isinstance(e, Cancelled):
                raise Cancelled("the evaluation was cancelled") from e
            raise
        finally:
            spark.sparkContext.removeJobTag(self.tag)

    def check(self) -> None:
        if self.asked:
            raise Cancelled("the evaluation was cancelled")


class Program:
    """A parsed and checked rule program.

    externals: (predicate, arity) -> function of {position: frame with the distinct values that can
    matter in a column `value`} to a DataFrame; it is called once per evaluation.  A position is left out where some
    occurrence has neither a constant nor a variable that an atom over loaded relations binds.
    declarations: constants and arities of rules are checked against them.
    trace: keep what each round of a recursive group added, in `rounds`, for provenance.Explainer; rules are
    then evaluated as they stand, closures too.
    fact_limit: how many facts one transform may derive, in all groups; base and inline facts do not count.
    """

    def __init__(self, text: str, functions: Functions | None = None, max_rounds: int = MAX_ROUNDS, fact_limit: int | None = None, externals: dict | None = None, declarations: list[dict] | None = None, trace: bool = False):
        statements = parse(text)
        self.externals, self.trace = externals or {}, trace
        self.rounds: dict[tuple[str, int], list[tuple[int, Relation]]] = {}
        self.functions = functions or Functions()
        self.rules = [s for s in statements if isinstance(s, Rule)]
        self.queries = [s for s in statements if isinstance(s, Query)]
        self.max_rounds, self.fact_limit, self.profile = max_rounds, fact_limit, []
        self.derived, self.cancel = 0, None
        for r in self.rules:
            check_rule(r, self.functions.arities(), self.functions.outputs())
        check_types(self.rules, declarations or [])
        self.order = strata(self.rules)
        self.closed = set()  # predicates whose closure some other is
        for name in [g[0] for g in self.order if len(g) == 1]:
            own = [r for r in self.rules if r.head.name == name and r.body]
            loops = [r for r in own if any(isinstance(b, Atom) and b.name == name for b in r.body)]
            seeds = [r for r in own if r not in loops]
            if closure_base(name, loops, seeds, False) and len(seeds) == 1:
                self.closed |= {b.name for b in seeds[0].body if isinstance(b, Atom)}

    def group_of(self, name: str) -> list[str]:
        """The predicates that are evaluated together with one."""
        return next((g for g in self.order if name in g), [])

    def transform(self, db: Database, goals: set[str] | None = None, cancel: Cancel | None = None) -> Database:
        """db with the derived relations, of the goals' rules only if goals are given."""
        rules = needed(self.rules, goals) if goals else self.rules
        self.profile, self.rounds, self.derived, self.cancel, self.given = [], {}, 0, cancel, set(db.relations)
        with cancel.watch(db.spark) if cancel else nullcontext():
            for key, fetch in self.externals.items():
                if fetched := self._external(db, key, fetch, rules):
                    db = db.extend({key: fetched})
            for group in self.order:
                own = [r for r in rules if r.head.name in group]
                if own:
                    began = time.time()
                    db, rounds, facts = self._group(db, group, own)
                    self.profile.append(Stratum(group, len(own), rounds, facts, time.time() - began))
        return db

    def _bounded(self, df: DataFrame, expected: int | None = None) -> tuple[DataFrame, int]:
        """The rows and their number, or FactLimitError if they pass the limit; no more than one above it are made."""
        if self.cancel:
            self.cancel.check()
        left = None if self.fact_limit is None else max(0, self.fact_limit - self.derived)
        kept, n = hold(df if left is None else df.limit(left + 1), expected)
        if left is not None and n > left:
            raise FactLimitError(f"more than {self.fact_limit} facts derived")
        self.derived += n
        return kept, n

    def _external(self, db: Database, key: tuple[str, int], fetch, rules: list[Rule]) -> Relation | None:
        uses = [(r, b) for r in rules for b in r.body if isinstance(b, Atom) and (b.name, len(b.terms)) == key]
        if not uses:
            return None
        derived = {r.head.name for r in self.rules}
        values = {}
        for i in range(key[1]):
            parts = [self._candidates(db, r, b.terms[i], derived | set(n for n, _ in self.externals)) for r, b in uses]
            if all(p is not None for p in parts):
                values[i] = reduce(lambda a, b: a.unionByName(b), parts).distinct()
        rel = from_frame(fetch(values))
        if len(rel.kinds) != key[1]:
            raise ProgramError(f"{key[0]} gave {len(rel.kinds)} columns, not {key[1]}")
        return Relation(rel.df.distinct(), rel.kinds)

    @staticmethod
    def _candidates(db: Database, rule: Rule, term, unknown: set[str]):
        """(value) the distinct values a term of an external atom can take, None if they are not known."""
        if not isinstance(term, Var):
            return from_tuples(db.spark, [(term.value,)]).df.toDF("value")
        for b in rule.body:
            if isinstance(b, Atom) and not b.negated and b.name not in unknown and term in b.terms and (b.name, len(b.terms)) in db.relations:
                return db.relations[b.name, len(b.terms)].df.select(F.col(f"c{b.terms.index(term)}").alias("value")).distinct()
        return None

    def _group(self, db: Database, group: list[str], rules: list[Rule]) -> tuple[Database, int, int]:
        facts: dict[tuple[str, int], list[tuple]] = {}
        for r in rules:
            if not r.body:
                facts.setdefault((r.head.name, len(r.head.terms)), []).append(tuple(t.value for t in r.head.terms))
        if facts:
            db = db.extend({k: from_tuples(db.spark, rows) for k, rows in facts.items()})
        keys = {(r.head.name, len(r.head.terms)) for r in rules}
        loaded = {k for k in keys if k in db.relations}
        rules = [r for r in rules if r.body]
        loops = [r for r in rules if any(isinstance(b, Atom) and b.name in group for b in r.body)]
        if loops and not loaded and (made := self._generations(db, group, keys, loops, rules)) is not None:
            return made
        parts: dict[tuple[str, int], list[Relation]] = {}
        for r in rules:
            if r not in loops and (rel := derive(r, db, self.functions, plain=r.head.name in self.closed)) is not None:
                parts.setdefault((r.head.name, len(r.head.terms)), []).append(rel)
        facts_found = -1
        for key, rels in parts.items():
            rel = rels[0] if len(rels) == 1 else (lambda u: Relation(u.df.distinct(), u.kinds))(union(rels))
            if self.fact_limit is not None:
                if key in db.relations:
                    rel = self._unknown(rel, db.relations[key])
                kept, n = self._bounded(rel.df)
                rel, facts_found = Relation(kept, rel.kinds), max(0, facts_found) + n
            db = db.extend({key: rel})
        if not loops:
            return db, 1, facts_found
        if not self.trace and len(group) == 1:
            seeds = [r for r in rules if r not in loops]
            if len(keys) == 1 and closure_base(group[0], loops, seeds, bool(loaded)):
                if (key := next(iter(keys))) not in db.relations:
                    return db, 0, 0
                if (made := self._closure(db, key, [] if loaded else seeds)) is not None:
                    return made
        return self._loop(db, group, loops)

    def _closure(self, db: Database, key: tuple[str, int], seeds: list[Rule]) -> tuple[Database, int, int] | None:
        """The predicate replaced by its transitive closure; None if its positions are of different kinds.

        seeds: all that it has without recursion.
        """
        rel = db.relations[key]
        if rel.kinds[0] != rel.kinds[1] or rel.kinds[0] == "float":
            return None
        if self.cancel:
            self.cancel.check()
        if (found := self._by_hubs(db, seeds)) is None:
            edges = rel.df.toDF("a", "b")
            if not edges.where("a IS NULL OR b IS NULL").isEmpty():
                return None
            found = closure(edges)
        self.derived += found.count
        if self.fact_limit is not None and self.derived > self.fact_limit:
            raise FactLimitError(f"more than {self.fact_limit} facts derived")
        whole = Relation(found.rows().toDF("c0", "c1"), rel.kinds)
        return Database(db.spark, db.relations | {key: whole}), found.rounds, found.count

    def _generations(self, db: Database, group: list[str], keys: set, loops: list[Rule], rules: list[Rule]) -> tuple[Database, int, int] | None:
        """The predicate by classes, where it is same generation over a relation that gives each node one parent."""
        if self.trace or self.fact_limit is not None or len(group) != 1 or len(keys) != 1:
            return None
        edge = generation_base(group[0], loops, [r for r in rules if r not in loops])
        rel = db.relations.get((edge, 2)) if edge and edge not in group else None
        if rel is None or rel.kinds[0] != rel.kinds[1] or rel.kinds[0] == "float":
            return None
        parents = rel.df.toDF("a", "b")
        if not parents.where("a IS NULL OR b IS NULL").isEmpty() or not unique(parents.distinct(), ["a"]):
            return None
        if self.cancel:
            self.cancel.check()
        found = generations(parents)
        self.derived += found.count
        whole = Relation(found.rows().toDF("c0", "c1"), rel.kinds)
        return Database(db.spark, db.relations | {next(iter(keys)): whole}), found.rounds, found.count

    def _by_hubs(self, db: Database, seeds: list[Rule]) -> Closure | None:
        """The closure of edges that one rule makes of two halves, without the edges; None where that is not so."""
        if self.fact_limit is not None or len(seeds) != 1 or len(seeds[0].body) != 1:
            return None
        base = seeds[0].body[0]
        if not isinstance(base, Atom) or base.negated or base.terms != seeds[0].head.terms or len(set(base.terms)) != 2 or not all(isinstance(t, Var) for t in base.terms):
            return None
        made = [r for r in self.rules if r.head.name == base.name and len(r.head.terms) == 2]
        if len(made) != 1 or (base.name, 2) in self.given or any(isinstance(b, Atom) and b.name in self.group_of(base.name) for b in made[0].body) or (cut := halves(made[0])) is None:
            return None
        a, b = made[0].head.terms
        if len(cut.across) > 1 or any(not isinstance(t, Compare) or t.op != "!=" or {t.left, t.right} != {a, b} for t in cut.across):
            return None
        sides, kinds = [], []
        for half, end in ((cut.left, a), (cut.right, b)):
            if (rel := derive(half, db, self.functions)) is None:
                return None
            at = [t.name for t in half.head.terms]
            sides.append(rel.df.select(F.col(f"c{at.index(end.name)}").alias("a" if end == a else "b"), F.col(f"c{at.index(cut.hub)}").alias("k")))
            kinds.append((rel.kinds[at.index(end.name)], rel.kinds[at.index(cut.hub)]))
        if kinds[0] != kinds[1] or "float" in kinds[0] or any(not d.where(d[0].isNull()).isEmpty() for d in sides):
            return None
        return closure_by_hubs(*sides, SQL_TYPES[kinds[0][0]], bool(cut.across))

    @staticmethod
    def _unknown(fresh: Relation, known: Relation, few: bool = False) -> Relation:
        """The rows of fresh, distinct, that are not known.

        few: fresh is small, so known rows are met with it before they are sent anywhere.
        """
        kinds = joint_kinds([fresh.kinds, known.kinds])
        width = range(len(kinds))
        left, right = fresh.aligned(kinds).distinct(), known.aligned(kinds).toDF(*[f"k{i}" for i in width])
        on = reduce(lambda a, b: a & b, [F.col(f"c{i}").eqNullSafe(F.col(f"k{i}")) for i in width])
        if few:
            right = right.join(F.broadcast(left), on, "left_semi")
        return Relation(left.join(right, on, "left_anti"), kinds)

    def _loop(self, db: Database, group: list[str], loops: list[Rule]) -> tuple[Database, int, int]:
        pieces: dict[tuple[str, int], list[Relation]] = {}
        sizes: dict[tuple[str, int], int] = {}
        for key, rel in list(db.relations.items()):
            if key[0] in group:
                kept, sizes[key] = hold(rel.df.distinct())
                pieces[key] = [Relation(kept, rel.kinds)]
        delta = {k: v[0] for k, v in pieces.items()}
        if self.trace:
            self.rounds |= {k: [(0, v)] for k, v in delta.items()}
        total, rounds, last = sum(sizes.values()), 0, max(sizes.values(), default=0)
        while True:
            db = Database(db.spark, db.relations | {k: union(v) for k, v in pieces.items()})
            found: dict[tuple[str, int], list[Relation]] = {}
            for r in loops:
                for i, b in enumerate(r.body):
                    if isinstance(b, Atom) and not b.negated and (b.name, len(b.terms)) in delta:
                        if (rel := derive(r, db, self.functions, (i, delta[b.name, len(b.terms)]))) is not None:
                            found.setdefault((r.head.name, len(r.head.terms)), []).append(rel)
            delta, most = {}, 0
            for key, rels in found.items():
                fresh, known = union(rels), db.relations.get(key)
                if known is None:
                    fresh = Relation(fresh.df.distinct(), fresh.kinds)
                elif sizes[key] > SMALL_ROWS:  # so that only what was found is dealt anew, not all that is known
                    kept, n = hold(fresh.df.distinct(), 2 * last)
                    fresh = self._unknown(Relation(kept, fresh.kinds), known, n <= BROADCAST_ROWS)
                else:
                    fresh = self._unknown(fresh, known)
                kept, n = self._bounded(fresh.df, 2 * last)
                if n:
                    fresh = Relation(kept, fresh.kinds)
                    delta[key], total, most = fresh, total + n, max(most, n)
                    sizes[key] = sizes.get(key, 0) + n
                    if self.trace:
                        self.rounds.setdefault(key, []).append((rounds + 1, fresh))
                    pieces.setdefault(key, []).append(fresh)
                    if len(pieces[key]) > COMPACT_ROUNDS:
                        whole = union(pieces[key])
                        kept, _ = hold(whole.df, sizes[key])
                        pieces[key] = [Relation(kept, whole.kinds)]
            rounds, last = rounds + 1, most
            if not delta:
                return Database(db.spark, db.relations | {k: union(v) for k, v in pieces.items()}), rounds, total
            if rounds >= self.max_rounds:
                raise ProgramError(f"{group} has no fixpoint after {rounds} rounds")


def run_query(db: Database, query: str | Query, functions: Functions | None = None):
    """The distinct named variables of a query's solutions, a column each.

    Anonymous variables and those that begin with an underscore are projected out.
    """
    q = parse(query)[0] if isinstance(query, str) else query
    positive = [b for b in q.body if not (isinstance(b, Atom) and b.negated)]
    names = sorted(n for n in set().union(*map(variables, positive)) if n[0] not in "?_")
    rule = Rule(Atom("_q_", tuple(Var(n) for n in names)), q.body)
    check_rule(rule, (functions or Functions()).arities(), (functions or Functions()).outputs())
    rel = derive(rule, db, functions or Functions())
    if rel is None:
        return db.spark.createDataFrame([], ", ".join(f"{n} string" for n in names))
    return rel.df.toDF(*names)
