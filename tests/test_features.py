"""Gates before patterns, refused builtins, inserts, answers with totals, streams that go on after an error."""

import random

import pytest
from pyspark.sql import functions as F

from hornlake.functions.builtins import MULTI, VALUES
from hornlake.operators import matchers
from hornlake.operators.fixpoint import Program
from hornlake.operators.relational import insert, select, statement
from hornlake.operators.rules import Functions
from hornlake.plans.language import ProgramError
from hornlake.session import Session
from hornlake.sources.database import Database, from_tuples


@pytest.mark.parametrize("how", [{}, {"case_insensitive": True}, {"windash": True}])
@pytest.mark.parametrize("kind", ["contains", "starts_with", "ends_with", "regex_match", "base64"])
def test_gate_loses_nothing(spark, kind, how, monkeypatch):
    rnd = random.Random(kind)
    letters = "aAbB-/.*+([é€ \n"
    texts = ["".join(rnd.choices(letters, k=rnd.randint(0, 9))) for _ in range(150)] + ["c2VjcmV0", "xx\n", "z-a", "-a", "a.b", "(B", "(", "A"]
    patterns = ["-a", "/B", "a.b", "*", "(", "é", "secret", "b\n", "A+"]
    if kind == "regex_match":
        patterns = ["^a", "(?i)b$", "a|B", "[-/]a", "é+", r"\.", "(?-i)A"]
    df = spark.createDataFrame([(t,) for t in texts], "v string")
    found = []
    for gated in (0, 1000):
        monkeypatch.setattr(matchers, "GATED", gated)
        found.append({tuple(r) for r in matchers.match(df, "v", kind, patterns, **how).collect()})
    assert found[0] == found[1] and found[0]


def test_refused_builtins(spark):
    with pytest.raises(ProgramError):
        Functions(VALUES | {"@contains": (2, lambda a: a[0])})
    with pytest.raises(ProgramError):
        Functions(multi=MULTI | {"@ends_with": (1, lambda a: a)})
    for bad in (lambda a: a[0][0], lambda a: (a[0][0], "number"), lambda a: None):
        with pytest.raises(ProgramError):
            Program("p(1). r(Y) :- p(X), @own(X, Y).", Functions(VALUES | {"@own": (2, bad)})).transform(Database(spark))
    wrong = lambda a: (F.array(F.struct(a[0][0].alias("o0"))), ["integer", "integer"])
    with pytest.raises(ProgramError):
        Program("p(1). r(Y) :- p(X), @many(X, Y).", Functions(multi=MULTI | {"@many": (1, wrong)})).transform(Database(spark))


def test_insert(spark):
    t = spark.createDataFrame([(1, "a", 10), (2, "b", 20)], "k int, s string, n int")
    made = insert("t", "k", "s").values(2, "x").values(3, "c").values(3, "d")
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert len(rows(made.frame(spark, {"t": t}))) == 5
    assert rows(made.on_conflict("k").frame(spark, {"t": t})) == [(1, "a", 10), (2, "b", 20), (3, "c", None)]
    assert rows(made.on_conflict("k", update=("s",)).frame(spark, {"t": t})) == [(1, "a", 10), (2, "x", 20), (3, "d", None)]
    assert rows(made.on_conflict("k").returning(spark, {"t": t}, "k", "s")) == [(3, "c")]
    assert rows(made.on_conflict("k", update=("s",)).returning(spark, {"t": t}, "k", "s")) == [(2, "x"), (3, "d")]
    with pytest.raises(ValueError):
        made.values(1)


def test_names_are_bound_for_one_statement(spark):
    spark.range(3).createOrReplaceTempView("t")
    t = spark.createDataFrame([(7,)], "id int")
    assert [r.id for r in select("t", "id").frame(spark, {"t": t}).collect()] == [7]
    assert [r.n for r in statement(spark, "SELECT count(*) AS n FROM t WHERE id > ?", {"t": t}, 6).collect()] == [1]
    assert spark.table("t").count() == 3
    select("u", "id").frame(spark, {"u": t})
    assert not spark.catalog.tableExists("u")


def test_answers(spark):
    s = Session(Database(spark, {("p", 1): from_tuples(spark, [(i,) for i in range(5)])}), "r(X) :- p(X), X > 0.")
    assert s.answer("r(X)?", 2) == {"columns": ["X"], "rows": [(1,), (2,)], "total": 4, "truncated": True}
    assert s.render("r(X)?", 3) == "X = 1\nX = 2\nX = 3\n... 1 more" and s.render("r(9)?") == "no" and s.render("r(1)?") == "yes"
    assert s.describe("r")["counts"] == {1: 4}
