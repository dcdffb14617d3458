"""A rule body as DataFrame operations.

Solutions are rows with a column per variable.  Atoms join on shared variables in order of
connectivity; tests and computed values come as soon as their inputs are there; an atom that gives
nothing used later is a semi join (but in aggregates, which count solutions); negation is an anti join
after all else.  Catalyst orders, prunes and pushes down from there.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import builtins
from ..functions.values import NUMBERS, arithmetic, compare, literal, same, to_json
from ..plans.analysis import TESTS
from ..plans.language import Atom, Compare, Const, Is, Op, ProgramError, Rule, Var, variables
from ..sources.database import SQL_TYPES, Database, Relation
from .pairs import PER_TASK, halves, matched, unique


MOST_OUTPUTS = 64


@dataclass
class Functions:
    """Builtins by name: (arity or -1, function); multi: (number of outputs, function)."""

    values: dict[str, tuple[int, Callable]] = field(default_factory=lambda: dict(builtins.VALUES))
    multi: dict[str, tuple[int, Callable]] = field(default_factory=lambda: dict(builtins.MULTI))

    def __post_init__(self):
        if taken := sorted(TESTS.keys() & (self.values.keys() | self.multi.keys())):
            raise ProgramError(f"{', '.join(taken)} cannot be replaced: text tests bind nothing")
        for name, (n, _) in self.multi.items():
            if not 0 <= n <= MOST_OUTPUTS:
                raise ProgramError(f"{name} has {n} outputs")

    def arities(self) -> dict[str, int]:
        fixed = {n: (a + 1 if n in builtins.MULTI else -1) for n, (a, _) in self.multi.items()}
        return TESTS | {n: a for n, (a, _) in self.values.items()} | fixed

    def outputs(self) -> dict[str, int]:
        return {n: 1 for n in self.values} | {n: k for n, (k, _) in self.multi.items()}


def returned(name: str, found, outputs: int | None = None):
    """What a builtin gave, if it is a Column and a kind (as many kinds as outputs), else ProgramError."""
    good = isinstance(found, tuple) and len(found) == 2 and isinstance(found[0], Column)
    kinds = [found[1]] if good and outputs is None else found[1] if good else []
    if not good or not isinstance(kinds, list | tuple) or not set(kinds) <= SQL_TYPES.keys() or len(kinds) != (1 if outputs is None else outputs):
        raise ProgramError(f"{name} must give a column and {'its kind' if outputs is None else f'{outputs} kinds'} of {sorted(SQL_TYPES)}, not {found!r}")
    return found


class Solutions:
    """Partial solutions of a body: df has a column v_<name> for each bound variable."""

    def __init__(self, df: DataFrame | None, kinds: dict[str, str]):
        self.df, self.kinds = df, kinds

    def value(self, term) -> tuple[Column, str]:
        return literal(term.value) if isinstance(term, Const) else (F.col(f"v_{term.name}"), self.kinds[term.name])

    def where(self, test: Column) -> Solutions:
        return Solutions(self.df.where(test), self.kinds)

    def bind(self, term, column: Column, kind: str) -> Solutions:
        """term = column: a new variable, or an equality; rows without a value go."""
        if isinstance(term, Var) and term.name not in self.kinds:
            df = self.df.withColumn(f"v_{term.name}", column).where(F.col(f"v_{term.name}").isNotNull())
            return Solutions(df, self.kinds | {term.name: kind})
        return self.where(column.isNotNull() & same(*self.value(term), column, kind))

    def keep(self, names: set[str]) -> Solutions:
        kept = {n: k for n, k in self.kinds.items() if n in names}
        return self if kept == self.kinds else Solutions(self.df.select(*[f"v_{n}" for n in kept]), kept)


def atom_rows(atom: Atom, rel: Relation, linked: set[str]) -> tuple[DataFrame, dict[str, str], bool]:
    """(rows, kinds, whole): constants and repeated variables applied; whole: no position was dropped.

    linked: anonymous variables that patterns use elsewhere in the body.
    """
    df, kinds, first = rel.df, {}, {}
    for i, t in enumerate(atom.terms):
        c, k = F.col(f"c{i}"), rel.kinds[i]
        if isinstance(t, Const):
            v, vk = literal(t.value)
            df = df.where(c == v if k == vk and k != "json" else same(c, k, v, vk))
        elif t.name in first:
            df = df.where(same(F.col(f"c{first[t.name]}"), kinds[t.name], c, k))
        elif not t.anonymous or t.name in linked:
            first[t.name], kinds[t.name] = i, k
    whole = not any(isinstance(t, Var) and t.name not in first for t in atom.terms)
    return df.select(*[F.col(f"c{i}").alias(f"v_{n}") for n, i in first.items()], *([F.lit(1).alias("_one")] if not first else [])), kinds, whole


def joined(left: Solutions, rows: DataFrame, kinds: dict[str, str], how: str) -> Solutions:
    shared = [n for n in kinds if n in left.kinds]
    right = rows.select(*[F.col(f"v_{n}").alias(f"r_{n}") for n in kinds], *([F.col("_one")] if "_one" in rows.columns else []))
    tests = [same(F.col(f"v_{n}"), left.kinds[n], F.col(f"r_{n}"), kinds[n]) for n in shared]
    on = reduce(lambda a, b: a & b, tests) if tests else F.lit(True)
    if how in ("left_semi", "left_anti"):
        return Solutions(left.df.join(right, on, how), left.kinds)
    df = left.df.join(right, on, "inner") if shared else left.df.crossJoin(right)
    fresh = [n for n in kinds if n not in left.kinds]
    return Solutions(df.select(*[f"v_{n}" for n in left.kinds], *[F.col(f"r_{n}").alias(f"v_{n}") for n in fresh]), left.kinds | {n: kinds[n] for n in fresh})


def expression(e, s: Solutions) -> tuple[Column, str]:
    return arithmetic(e.op, *expression(e.left, s), *expression(e.right, s)) if isinstance(e, Op) else s.value(e)


def solve(rule: Rule, db: Database, functions: Functions, swap: tuple[int, Relation] | None = None) -> tuple[Solutions, bool] | None:
    """(solutions, exact) of the rule's body, None if a positive atom's relation is missing.

    swap: (position in the body, relation) that stands in for that atom, the delta of a round.
    exact: every solution's bound variables determine it, so that projection onto all is distinct.
    """
    counting = rule.aggregate is not None
    pending = list(enumerate(rule.body))
    wanted = variables(rule.head) | (variables(rule.aggregate.term) if counting else set())
    s, exact = Solutions(None, {}), True
    seen = [v for b in rule.body for v in variables(b)]
    linked = {v for v in seen if v[0] == "?" and seen.count(v) > 1}

    def needed_later(but: int) -> set[str]:
        return wanted.union(*(variables(b) for i, b in pending if i != but), *(variables(b) for b in negated))

    def relation(i: int, b: Atom) -> Relation | None:
        return swap[1] if swap and swap[0] == i else db.relations.get((b.name, len(b.terms)))

    negated = [b for _, b in pending if isinstance(b, Atom) and b.negated]
    pending = [(i, b) for i, b in pending if not (isinstance(b, Atom) and b.negated)]
    if swap:  # the small delta leads
        pending.sort(key=lambda p: p[0] != swap[0])
    while pending:
        ready = None
        for i, b in pending:
            if s.df is None and any(isinstance(x, Atom) and x.name[0] != "@" for _, x in pending):
                break
            if isinstance(b, Compare) and variables(b) <= s.kinds.keys():
                ready = i, b
            elif isinstance(b, Is) and variables(b.expr) <= s.kinds.keys():
                ready = i, b
            elif isinstance(b, Atom) and b.name[0] == "@":
                n = len(b.terms) - functions.outputs().get(b.name, 0)
                if variables(b.terms[:n]) <= s.kinds.keys():
                    ready = i, b
            if ready:
                break
        if ready is None:
            plain = [(i, b) for i, b in pending if isinstance(b, Atom) and b.name[0] != "@"]
            if not plain:
                raise ProgramError(f"no order binds {[str(b) for _, b in pending]} in {rule}, bound are {sorted(s.kinds)}")
            ready = max(plain, key=lambda p: (s.df is None and bool(swap) and p[0] == swap[0], bool(variables(p[1]) & s.kinds.keys()), -p[0]))
        i, b = ready
        if s.df is None and not (isinstance(b, Atom) and b.name[0] != "@"):
            s = Solutions(db.spark.range(1).select(F.lit(1).alias("_one")), {})
        if isinstance(b, Compare):
            s = s.where(compare(b.op, *expression(b.left, s), *expression(b.right, s)))
        elif isinstance(b, Is):
            s = s.bind(b.var, *expression(b.expr, s))
        elif b.name in TESTS:
            hay, needle = (builtins.as_string(*s.value(t)) for t in b.terms)
            constant = b.terms[1].value if isinstance(b.terms[1], Const) else None
            s = s.where(builtins.text_test(b.name, hay, needle, constant) if hay is not None and needle is not None else F.lit(False))
        elif b.name in functions.values:
            column, kind = returned(b.name, functions.values[b.name][1](*[s.value(t) for t in b.terms[:-1]]))
            s = s.bind(b.terms[-1], column, kind)
        elif b.name in functions.multi:
            n, make = functions.multi[b.name]
            column, kinds = returned(b.name, make(*[s.value(t) for t in b.terms[: len(b.terms) - n]]), n)
            s = Solutions(s.df.withColumn("_o", F.explode(column)), s.kinds)
            for j, (t, k) in enumerate(zip(b.terms[len(b.terms) - n :], kinds, strict=True)):
                s = s.bind(t, F.col(f"_o.o{j}"), k)
            s = Solutions(s.df.drop("_o"), s.kinds)
            exact = False
        else:
            rel = relation(i, b)
            if rel is None:
                return None
            rows, kinds, whole = atom_rows(b, rel, linked)
            later = needed_later(i)
            if s.df is None:
                s = Solutions(rows, kinds)
                exact = whole
            elif not counting and not (kinds.keys() - s.kinds.keys()) & later:
                s = joined(s, rows.select(*[f"v_{n}" for n in kinds if n in s.kinds] or ["_one" if "_one" in rows.columns else F.lit(1).alias("_one")]), {n: k for n, k in kinds.items() if n in s.kinds}, "left_semi")
            else:
                s = joined(s, rows, kinds, "inner")
                exact = exact and whole
        pending = [p for p in pending if p[0] != i]
        if not counting:
            later = needed_later(-1)
            exact = exact and s.kinds.keys() <= later
            s = s.keep(later) if later & s.kinds.keys() else s
    for b in negated:
        rel = db.relations.get((b.name, len(b.terms)))
        if rel is not None:
            rows, kinds, _ = atom_rows(b, rel, linked)
            s = joined(s, rows, kinds, "left_anti")
    return s, exact and not (s.kinds.keys() - variables(rule.head))


def head_rows(rule: Rule, s: Solutions) -> Relation:
    values = [s.value(t) for t in rule.head.terms]
    return Relation(s.df.select(*[c.alias(f"c{i}") for i, (c, _) in enumerate(values)]), [k for _, k in values])


def core(half: Rule, hub: str) -> bool:
    """True if one atom of the half has all that its other atoms have, so that it makes no pairs itself."""
    atoms = [variables(b) for b in half.body if isinstance(b, Atom) and not b.negated and b.name[0] != "@"]
    return any(hub in a and all(x <= a for x in atoms) for a in atoms) and not any(isinstance(b, Atom) and b.name[0] == "@" for b in half.body)


def paired(rule: Rule, db: Database, functions: Functions) -> Relation | None:
    """The head rows where two halves meet in a variable and make far more pairs than they have rows, else None.

    Pairs need no distinct where the head's part of a half is a key of it, and the other's with the hub too.
    """
    cut = halves(rule)
    if cut is None or not core(cut.left, cut.hub) or not core(cut.right, cut.hub):
        return None
    sides, kinds = [], {}
    for half, s in ((cut.left, "l"), (cut.right, "r")):
        if (rel := derive(half, db, functions)) is None or rel.df.isStreaming:
            return None
        names = [t.name for t in half.head.terms]
        kinds |= {f"{s}_{n}": k for n, k in zip(names, rel.kinds, strict=True)}
        sides.append(rel.df.toDF(*[f"{s}_k0" if n == cut.hub else f"v_{n}" for n in names]))
    kind = kinds[f"l_{cut.hub}"]
    if kind != kinds[f"r_{cut.hub}"] or kind == "float":
        return None
    s = Solutions(None, {n[2:]: k for n, k in kinds.items()})
    s.kinds.pop(cut.hub)
    test = F.lit(True)
    for b in cut.across:
        if cut.hub in variables(b):
            return None
        test = test & compare(b.op, *expression(b.left, s), *expression(b.right, s))
    rows, n = matched(*sides, 1, test)
    if n <= PER_TASK:
        return None
    out = head_rows(rule, Solutions(rows, s.kinds))
    ends = [[c for c in d.columns if c[2:] in variables(rule.head)] for d in sides]
    for (df, key), (other, rest), k in (((sides[0], ends[0]), (sides[1], ends[1]), "r_k0"), ((sides[1], ends[1]), (sides[0], ends[0]), "l_k0")):
        if unique(df, key) and unique(other, [*rest, k]):
            return out
    return Relation(out.df.distinct(), out.kinds)


def derive(rule: Rule, db: Database, functions: Functions, swap=None, plain: bool = False) -> Relation | None:
    """The rule's head rows, distinct; None if there can be none.

    plain: without a look at how many they are, for rows that may never be read.
    """
    if swap is None and not plain and (made := paired(rule, db, functions)) is not None:
        return made
    found = solve(rule, db, functions, swap)
    if found is None:
        return None
    s, exact = found
    if rule.aggregate is None:
        out = head_rows(rule, s)
        return out if exact else Relation(out.df.distinct(), out.kinds)
    a = rule.aggregate
    keys = [t for t in rule.head.terms if isinstance(t, Var) and t.name != a.result.name]
    if a.kind == "count":
        made, kind = F.count(F.lit(1)), "integer"
    else:
        c, kind = s.value(a.term)
        made = None
        if kind == "json":
            text = to_json(c, kind)
            wrong = F.raise_error(F.lit(f"{a.kind} over a value that is not a number"))
            text = F.when(text.rlike("^-?[0-9]"), text).otherwise(wrong.cast("string"))
            c = text.try_cast("double")
            if a.kind != "sum":  # the winner stays as it is; doubles decide, and digits where they are equal
                made, kind = {"min": F.min, "max": F.max}[a.kind](F.struct(c.alias("d"), text.try_cast("decimal(38,10)").alias("e"), text.alias("text")))["text"], "json"
            else:
                kind = "float"
        if kind not in NUMBERS and made is None:
            raise TypeError(f"{a.kind} needs numbers: {rule}")
        if kind == "float":
            c = F.when(F.isnan(c), F.raise_error(F.lit(f"{a.kind} over NaN")).cast("double")).otherwise(c)
        made = {"sum": F.sum, "min": F.min, "max": F.max}[a.kind](c) if made is None else made
    names = list(dict.fromkeys(f"v_{t.name}" for t in keys))
    grouped = s.df.groupBy(*names).agg(made.alias(f"v_{a.result.name}"), F.count(F.lit(1)).alias("_n"))
    grouped = grouped.where("_n > 0").drop("_n") if not names else grouped.drop("_n")
    return head_rows(rule, Solutions(grouped, s.kinds | {a.result.name: kind}))
