"""Recursion against plain Python: closures with and without seeds, limits, cancellation, exact minima and maxima."""

import random
import threading
import time

import pytest

from hornlake.operators import closure as closing
from hornlake.operators import fixpoint
from hornlake.operators.fixpoint import Cancel, Cancelled, FactLimitError, Program
from hornlake.sources import storage
from hornlake.sources.database import Database, from_tuples


def rows(spark, text, name, relations, **how):
    db = Database(spark, {(n, len(r[0])): from_tuples(spark, r) for n, r in relations.items()})
    return sorted(tuple(r) for r in Program(text, **how).transform(db).facts(name, 2).collect())


def least(base, step):
    known = set(base)
    while more := step(known) - known:
        known |= more
    return sorted(known)


LINEAR = "r(X,Y) :- e(X,Y). r(X,Y) :- r(X,Z), e(Z,Y)."
SEEDED = {
    "facts of its own": ("r(5,6). r(6,7). " + LINEAR, {}),
    "loaded facts": (LINEAR, {"r": [(5, 6), (6, 7)]}),
    "right linear": ("r(5,6). r(6,7). r(X,Y) :- e(X,Y). r(X,Y) :- e(X,Z), r(Z,Y).", {}),
}


@pytest.mark.parametrize("case", SEEDED)
def test_seeded_closures_follow_the_rules(spark, case):
    text, more = SEEDED[case]
    edges = [(1, 2), (2, 3), (3, 5), (7, 8), (8, 7)]
    left = "e(X,Z), r(Z,Y)" not in text
    step = lambda r: {(a, d) for a, b in (r if left else edges) for c, d in (edges if left else r) if b == c}
    expected = least([*edges, (5, 6), (6, 7)], step)
    assert rows(spark, text, "r", {"e": edges, **more}) == expected
    assert rows(spark, text, "r", {"e": edges, **more}, trace=True) == expected
    assert ((5, 7) in expected) is not left or (5, 7) not in expected


def test_nonlinear_closure_closes_seeds_too(spark):
    assert rows(spark, "r(5,6). r(X,Y) :- e(X,Y). r(X,Y) :- r(X,Z), r(Z,Y).", "r", {"e": [(1, 5), (6, 7)]}) == [(1, 5), (1, 6), (1, 7), (5, 6), (5, 7), (6, 7)]


GRAPHS = {
    "sparse": lambda r: {(r.randint(0, 30), r.randint(0, 30)) for _ in range(30)},
    "dense": lambda r: {(r.randint(0, 12), r.randint(0, 12)) for _ in range(90)},
    "chain and ring": lambda r: {(i, i + 1) for i in range(17)} | {(20 + i, 20 + (i + 1) % 11) for i in range(11)} | {(3, 25)},
    "triangles": lambda r: {(3 * k + i, 3 * k + (i + 1) % 3) for k in range(6) for i in range(3)} | {(3 * k, 3 * k + 4) for k in range(5)} | {(r.randint(0, 20), r.randint(0, 20)) for _ in range(6)},
    "loops": lambda r: {(1, 1), (1, 2), (4, 4), (2, 3)},
}


@pytest.mark.parametrize("small", [storage.SMALL_ROWS, 3])
@pytest.mark.parametrize("kind", GRAPHS)
def test_closure_equals_the_plain_loop(spark, kind, small, monkeypatch):
    monkeypatch.setattr(storage, "SMALL_ROWS", small)
    monkeypatch.setattr(fixpoint, "SMALL_ROWS", small)
    monkeypatch.setattr(closing, "DENSE", 1)
    edges = sorted(GRAPHS[kind](random.Random(kind)))
    expected = least(edges, lambda r: {(a, d) for a, b in r for c, d in edges if b == c})
    assert rows(spark, LINEAR, "r", {"e": edges}) == expected
    found = closing.closure(spark.createDataFrame(edges, "a bigint, b bigint"))
    assert found.count == len(expected)


def test_the_loop_itself(spark, monkeypatch):
    monkeypatch.setattr(storage, "SMALL_ROWS", 3)
    monkeypatch.setattr(fixpoint, "SMALL_ROWS", 3)
    edges = sorted(GRAPHS["sparse"](random.Random(5)))
    expected = least(edges, lambda r: {(a, d) for a, b in r for c, d in edges if b == c})
    assert rows(spark, LINEAR, "r", {"e": edges}, trace=True) == expected


def test_fact_limit_counts_all_derived_facts(spark):
    data = {"a": [(i,) for i in range(300)]}
    db = Database(spark, {("a", 1): from_tuples(spark, data["a"])})
    with pytest.raises(FactLimitError):
        Program("cp(X, Y) :- a(X), a(Y).", fact_limit=1000).transform(db)
    with pytest.raises(FactLimitError):
        Program("b(X) :- a(X). c(X) :- b(X). d(X) :- c(X).", fact_limit=899).transform(db)
    made = Program("b(X) :- a(X). c(X) :- b(X). d(X) :- c(X).", fact_limit=900)
    assert made.transform(db).count("d", 1) == 300 and [s.facts for s in made.profile] == [300, 300, 300]
    with pytest.raises(FactLimitError):
        Program("r(X,Y) :- n(X,Y). r(X,Y) :- r(X,Z), n(Z,Y). n(X,Y) :- a(X), Y is X + 1.", fact_limit=5000).transform(db)


def test_cancellation(spark):
    stop, db = Cancel(), Database(spark)
    program = Program("n(1). n(Y) :- n(X), Y is X + 1.")
    timer = threading.Timer(3.0, stop.cancel)
    timer.start()
    began = time.time()
    with pytest.raises(Cancelled):
        program.transform(db, cancel=stop)
    assert time.time() - began < 30
    with pytest.raises(Cancelled):
        program.transform(db, cancel=stop)
    assert Program("p(1).").transform(db).count("p", 1) == 1


def test_extremes_of_mixed_kinds_are_exact(spark):
    data = {"p": [("a", 9007199254740993), ("a", 1.5), ("a", 9007199254740992.0), ("b", -3), ("b", 2.5)]}
    db = Database(spark, {("p", 2): from_tuples(spark, data["p"])})
    out = Program("hi(K, M) :- M = max(V) : p(K, V). lo(K, M) :- M = min(V) : p(K, V).").transform(db)
    assert sorted(map(tuple, out.facts("hi", 2).collect())) == [("a", "9007199254740993"), ("b", "2.5")]
    assert sorted(map(tuple, out.facts("lo", 2).collect())) == [("a", "1.5"), ("b", "-3")]


HUBS = "link(A, B) :- l(A, K), r(B, K)%s. goal(A, B) :- link(A, B). goal(A, B) :- goal(A, C), link(C, B)."


@pytest.mark.parametrize("other", ["", ", A != B", ", A != B, on(A), not off(B)"])
def test_closure_of_edges_that_meet_in_hubs(spark, other, monkeypatch):
    rnd = random.Random(other)
    for ends, hubs, n in ((12, 5, 12),):
        left, right = ([(rnd.randrange(ends), rnd.randrange(hubs)) for _ in range(n)] for _ in "lr")
        on, off = {i for i in range(ends) if i % 3}, {0, 4}
        link = {(a, b) for a, k in left for b, j in right if k == j and (a != b or not other) and ("on" not in other or (a in on and b not in off))}
        data = {"l": sorted(set(left)), "r": sorted(set(right)), "on": [(i,) for i in on], "off": [(i,) for i in off]}
        assert rows(spark, HUBS % other, "goal", data) == least(link, lambda r: {(a, d) for a, b in r for c, d in link if b == c})


def test_hubs_are_not_made_into_pairs(spark, monkeypatch):
    held = []
    monkeypatch.setattr(closing, "hold", lambda df, *a: held.append(storage.hold(df, *a)) or held[-1])
    data = {"l": [(i, i % 2) for i in range(600)], "r": [(i, i % 2) for i in range(600)]}
    assert len(rows(spark, HUBS % ", A != B", "goal", data)) == 2 * 300 * 300
    assert max(n for _, n in held) <= 2 * (600 + 600 + 2)


@pytest.mark.parametrize("kind", ["tree", "two parents", "ring"])
def test_same_generation_by_classes(spark, kind, monkeypatch):
    held = []
    monkeypatch.setattr(closing, "hold", lambda df, *a: held.append(storage.hold(df, *a)) or held[-1])
    up = {"tree": [(i, i // 2) for i in range(2, 60)], "two parents": [(i, i // 2) for i in range(2, 14)] + [(9, 2), (13, 5)], "ring": [(0, 2), (1, 0), (2, 1), (3, 0), (4, 3), (5, 4), (8, 9)]}[kind]
    step = lambda r: {(a, b) for a, p in up for b, q in up if p == q or (p, q) in r}
    assert rows(spark, "g(A, B) :- e(A, P), e(B, P). g(A, B) :- e(A, P), g(P, Q), e(B, Q).", "g", {"e": up}) == least(set(), step)
    assert bool(held) is (kind != "two parents") and all(n <= len(up) for _, n in held)
