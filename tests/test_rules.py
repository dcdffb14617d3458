import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from hornlake.operators.fixpoint import Program, run_query
from hornlake.operators.rules import Functions
from hornlake.plans import store
from hornlake.plans.language import Const, ProgramError, Rule, doc_warnings, parse
from hornlake.session import Session
from hornlake.sources.database import Database, canonical, from_tuples


def facts(spark, text, name, arity, relations=None, **how):
    db = Database(spark, {(n, len(rows[0])): from_tuples(spark, rows) for n, rows in (relations or {}).items()})
    out = Program(text, **how).transform(db)
    return sorted(map(tuple, out.facts(name, arity).collect()), key=str)


CASES = [
    ('p(1). p(2). r(X) :- p(X), X > 1.', "r", 1, [(2,)]),
    ('p(1,1). p(1,2). r(X) :- p(X, X).', "r", 1, [(1,)]),
    ('p("10",10). r(X) :- p(X, Y), X = Y.', "r", 1, []),
    ('p("10",10). r(X) :- p(X, Y), X != Y.', "r", 1, [("10",)]),
    ('p("a"). r(X) :- p(X), X > 3.', "r", 1, []),
    ("r(X) :- X is 7 / 2.", "r", 1, [(3,)]),
    ("r(X) :- X is -7 mod 2.", "r", 1, [(-1,)]),
    ("r(X) :- X is 2 + 3 * 4 - (1 - 5).", "r", 1, [(18,)]),
    ("p(0). p(2). r(X, Y) :- p(X), Y is 10 / X.", "r", 2, [(2, 5)]),
    ('p("abc"). p("xbc"). r(X) :- p(X), @starts_with(X, "a"), @ends_with(X, "c"), @contains(X, "b"), @regex_match(X, "^a.c$").', "r", 1, [("abc",)]),
    ("p(1). p(2). q(2). r(X) :- p(X), not q(X).", "r", 1, [(1,)]),
    ("p(1). r(X) :- p(X), not absent(X, _).", "r", 1, [(1,)]),
    ("p(1). q(5). r(X) :- p(X), not q(?).", "r", 1, []),
    ('p("a",1). p("a",2). p("b",5). r(K, N) :- N = count : p(K, _). ', "r", 2, [("a", 2), ("b", 1)]),
    ('p("a",1). p("a",2). r(N) :- N = sum(1) : p(_, _).', "r", 1, [(2,)]),
    ('p("a",1). p("a",2). p("b",5). r(K, S) :- S = max(V) : p(K, V).', "r", 2, [("a", 2), ("b", 5)]),
    ('p("a",1). r(N) :- N = count : p("zzz", _).', "r", 1, []),
    ("n(1). n(Y) :- n(X), X < 5, Y is X + 1. r(S) :- S = sum(X) : n(X).", "r", 1, [(15,)]),
    ("e(1,2). e(2,3). e(3,1). r(X,Y) :- e(X,Y). r(X,Y) :- r(X,Z), r(Z,Y).", "r", 2, [(a, b) for a in (1, 2, 3) for b in (1, 2, 3)]),
    ("e(1,2). e(2,3). o(X,Y) :- e(X,Y). o(X,Y) :- r(X,Z), e(Z,Y). r(X,Y) :- o(X,Z), e(Z,Y).", "r", 2, [(1, 3)]),
    ("p(1, true). p(2, false). r(X) :- p(X, true).", "r", 1, [(1,)]),
]


@pytest.mark.parametrize("text,name,arity,expected", CASES)
def test_program(spark, text, name, arity, expected):
    assert facts(spark, text, name, arity) == sorted(expected, key=str)


def test_nulls_are_values(spark):
    assert facts(spark, "r(X) :- p(X, X).", "r", 1, {"p": [(None, None), (1, None), (7, 7.0)]}) == [("7",), ("null",)]
    assert facts(spark, "r(X) :- p(X), not q(X).", "r", 1, {"p": [(None,), (1,)], "q": [(None,), ("x",)]}) == [("1",)]


def test_json(spark):
    data = {"p": [(1, {"name": "a.tmp", "l": [1, 2, 2]}), (2, {"name": "b", "l": []}), (3, [5, 6])]}
    assert facts(spark, 'r(I) :- p(I, {name: N}), @ends_with(N, ".tmp").', "r", 1, data) == [(1,)]
    assert facts(spark, "r(N) :- N = count : p(_, {l: L}), @json_each(L, _).", "r", 1, data) == [(3,)]
    assert facts(spark, "r(H, T) :- p(_, [H | T]).", "r", 2, data) == [("5", "[6]")]
    assert facts(spark, "r(I, T, N) :- p(I, J), @json_type(J, T), @json_len(J, N).", "r", 3, data) == [(1, "object", 2), (2, "object", 2), (3, "array", 2)]
    assert facts(spark, 'r(D) :- D is 1, @time_diff("2024-01-01T00:00:10Z", "2024-01-01T00:00:00Z", D2), D2 = 10.', "r", 1) == [(1,)]
    assert canonical({"b": 1.0, "a": [1e2, "é"]}) == '{"a":[100,"é"],"b":1}'


@pytest.mark.parametrize(
    "text",
    ["p(X) :- q(Y).", "p(X) :- q(X), not p(X).", "p(X) :- q(X), @nope(X).", "p(X :- q(X).", "p(Y) :- Y is X + 1, q(X).", "p(X).", "p({a: 1}).", "p(X) :- q(X), not r({a: X}).", "c(N) :- N = count(X) : q(X).", "p(N) :- N = sum(X) : p(X)."],
)
def test_refused(text):
    with pytest.raises(ProgramError):
        Program(text)


def test_limits_and_errors(spark):
    with pytest.raises(ProgramError):
        facts(spark, "n(1). n(Y) :- n(X), Y is X + 1.", "n", 1, max_rounds=3)
    with pytest.raises(ProgramError):
        facts(spark, "n(1). n(Y) :- n(X), Y is X + 1.", "n", 1, fact_limit=2)
    with pytest.raises(TypeError):
        facts(spark, 'p("a"). r(M) :- M = max(X) : p(X).', "r", 1)
    with pytest.raises(Exception, match="(?i)overflow"):
        facts(spark, "p(9223372036854775807). r(Y) :- p(X), Y is X + 1.", "r", 1)


def test_session(spark):
    s = Session(Database(spark), '%% direct links\ne(1,2). e(2,3).\nr(X,Y) :- e(X,Y). r(X,Y) :- r(X,Z), e(Z,Y).', Functions())
    assert [tuple(x) for x in s.query("r(1, Y), not e(1, Y)?").collect()] == [(3,)]
    assert s.explain("r(1,3)")["premises"] == ["r(1, 2)", "e(2, 3)"]
    assert s.explain("r(3,1)") is None
    assert s.dependencies("r") == {"reads": ["e", "r"], "read_by": ["r"]}
    assert {p["name"]: p["count"] for p in s.predicates()} == {"e": 2, "r": 3}
    assert run_query(s.derived(), "r(_, _Y), e(X, _)?").columns == ["X"]


CONSTANTS = st.one_of(st.integers(-99, 99), st.text("ab\"\\\n", max_size=4), st.sampled_from([True, False, None, 1.5]))


@settings(max_examples=60, deadline=None)
@given(st.lists(CONSTANTS, min_size=1, max_size=3))
def test_print_and_parse(values):
    rule = Rule(parse("p(1).")[0].head.__class__("p", tuple(map(Const, values))))
    assert str(parse(str(rule))[0]) == str(rule)
    text = "r(X, N) :- p(X, ?0), not q(X), X > (1 + (2 * X)), N is (X mod 3)."
    assert str(parse(text)[0]) == text


def closure(edges):
    known = set(edges)
    while more := {(a, d) for a, b in known for c, d in edges if b == c} - known:
        known |= more
    return known


@pytest.mark.parametrize("seed", range(3))
def test_random_graphs(spark, seed):
    rnd = random.Random(seed)
    edges = list({(rnd.randint(0, 12), rnd.randint(0, 12)) for _ in range(18)})
    nodes = sorted({n for e in edges for n in e})
    text = "r(X,Y) :- e(X,Y). r(X,Y) :- r(X,Z), e(Z,Y). u(X,Y) :- n(X), n(Y), not r(X,Y). c(X,N) :- N = count : u(X,_)."
    got = facts(spark, text, "c", 2, {"e": edges, "n": [(n,) for n in nodes]})
    reach = closure(edges)
    left = {x: sum((x, y) not in reach for y in nodes) for x in nodes}
    assert got == sorted(((x, n) for x, n in left.items() if n), key=str)


def test_externals(spark):
    asked = []

    def fetch(values):
        asked.append({i: sorted(r.value for r in v.collect()) for i, v in values.items()})
        return spark.createDataFrame([(1, "one"), (2, "two"), (9, "nine")], "k bigint, n string")

    db = Database(spark, {("p", 1): from_tuples(spark, [(1,), (2,)])})
    out = Program("r(X, N) :- p(X), name(X, N). s(N) :- name(9, N).", externals={("name", 2): fetch}).transform(db)
    assert asked == [{0: [1, 2, 9]}]
    assert sorted(map(tuple, out.facts("r", 2).collect())) == [(1, "one"), (2, "two")]
    assert [tuple(r) for r in out.facts("s", 1).collect()] == [("nine",)]


def test_explanations(spark):
    text = """
    %% what follows what
    r(X, Y) :- e(X, Y).
    r(X, Y) :- r(X, Z), e(Z, Y).
    n(X, N) :- N = count : r(X, _).
    far(X) :- n(X, N), N > 2, not stop(X), M is N + 1, @starts_with("abc", "a").
    """
    edges = [(1, 2), (2, 3), (3, 1), (5, 1)]
    s = Session(Database(spark, {("e", 2): from_tuples(spark, edges)}), text)
    tree = s.explain_tree("far(5)")
    assert str(tree.body[0].fact) == "n(5, 3)" and tree.body[0].group == 3 and len(tree.body[0].body) == 3
    assert tree.detail == ["3 > 2", "not stop(5)", "4 is (3 + 1)", '@starts_with("abc", "a")']

    def leaves(d):
        return [d] if not d.body else [x for b in d.body for x in leaves(b)]

    assert all(x.fact.name == "e" or x.repeated for x in leaves(tree))
    assert {str(x.fact) for x in leaves(tree) if x.fact.name == "e"} <= {f"e({a}, {b})" for a, b in edges}
    loop = s.explain_tree("r(1, 1)")  # a fact on a cycle is never its own premise
    assert "r(1, 1)" not in {str(x.fact) for b in loop.body for x in [b, *leaves(b)]}
    assert s.explain_tree("far(1)") is not None and s.explain_tree("far(9)") is None
    assert s.explain_tree("r(5, 3)", max_depth=1).body[0].truncated
    assert s.explain("n(5, 3)")["solutions"] == 3 and s.explain("n(5, 4)") is None
    assert s.explain("e(1, 2)")["rule"] is None


def test_declarations():
    known = [{"name": "p", "terms": [{"name": "a", "type": "integer"}, {"name": "b"}]}, {"name": "free"}]
    Program('r(X) :- p(1, X), free(X, 2), q("x").', declarations=known)
    for bad in ('r(X) :- p("a", X).', "r(X) :- p(X).", "p(1.5, 2)."):
        with pytest.raises(ProgramError):
            Program(bad, declarations=known)


def test_rule_store(tmp_path):
    text = "%% first\na(X) :- b(X).\nc(1, 2).\na(X) :- d(X), not c(X, _)."
    assert store.export(text, f"{tmp_path}") == ["a_1.dl", "c_2.dl"]
    assert parse(store.read(f"{tmp_path}")) == [parse(text)[i] for i in (0, 2, 1)]
    assert parse(store.read(f"{tmp_path}"))[0].doc == "first"
    (tmp_path / "x_3.dl").write_text("y(1).")
    with pytest.raises(ProgramError):
        store.read(f"{tmp_path}")
    assert doc_warnings("%% lost\n\np(1).") and not doc_warnings("%% kept\np(1).")


def test_patterns_that_vary_by_row(spark):
    data = {"p": [("abc", "^a"), ("abc", "("), ("abc", "x")]}
    assert facts(spark, "r(P) :- p(T, P), @regex_match(T, P).", "r", 1, data) == [("^a",)]


@pytest.mark.parametrize("repeated", [False, True])
def test_many_pairs_meet_in_blocks_without_a_distinct(spark, repeated, monkeypatch):
    from hornlake.operators import pairs, rules
    from hornlake.sources.database import from_frame

    monkeypatch.setattr(pairs, "SIDE", 8)
    for module in (pairs, rules):
        monkeypatch.setattr(module, "PER_TASK", 50)
    left = [(i, None if i % 3 == 1 else i % 3, i % 7) for i in range(60)] + [(1, 0, 3)] * repeated
    right = [(100 + i, None if i % 4 == 1 else i % 4, i % 5) for i in range(90)] + [(100, None, 2)] * repeated
    db = Database(spark, {(n, 3): from_frame(spark.createDataFrame(r, "a bigint, k bigint, v bigint")) for n, r in (("l", left), ("r", right))})
    out = Program("goal(A, B) :- l(A, K, X), r(B, K, Y), X < Y.").transform(db).facts("goal", 2)
    expected = sorted({(a, b) for a, k, x in left for b, j, y in right if k == j and x < y})
    assert sorted(map(tuple, out.collect())) == expected
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.startswith("Aggregate") is repeated and "l_key" in plan


def test_self_join_in_blocks_needs_no_distinct(spark, monkeypatch):
    from hornlake.operators import pairs, rules

    monkeypatch.setattr(pairs, "SIDE", 4)
    for module in (pairs, rules):
        monkeypatch.setattr(module, "PER_TASK", 50)
    db = Database(spark, {("s", 2): from_tuples(spark, [(i, i % 3) for i in range(40)])})
    out = Program("goal(A, B) :- s(A, N), s(B, N), A < B.").transform(db).facts("goal", 2)
    assert sorted(map(tuple, out.collect())) == [(a, b) for a in range(40) for b in range(a + 1, 40) if a % 3 == b % 3]
    assert not out._jdf.queryExecution().optimizedPlan().toString().startswith("Aggregate")
