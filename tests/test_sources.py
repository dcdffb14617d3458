import gzip
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from hornlake.operators import matchers
from hornlake.operators.relational import select
from hornlake.sources.database import Database, from_tuples
from hornlake.sources.config import ConfigError, check, mistyped, read_config, read_patterns, term_names
from hornlake.sources.jsonl import browse, encode, load, mapped, merged, probe, records, rejected
from hornlake.sources.mapping import MappingError, run_program
from hornlake.streaming.operators import rate_limited, reevaluate, subscribed
from hornlake.operators.fixpoint import Program


def test_jsonl(spark, tmp_path):
    rows = [{"id": 1, "kind": "A", "ip": "10.0.0.7", "cmd": "-enc x"}, {"id": 2, "kind": "B", "deep": {"n": 3}}, {"id": 2.0, "kind": "B", "deep": {"n": 3}}]
    with gzip.open(tmp_path / "x.jsonl.gz", "wt") as f:
        f.write("﻿" + "\n\n".join(map(json.dumps, rows)) + "\n")
    config = {
        "sources": [{"file": "x.jsonl.gz", "mappings": [
            {"predicate": "ev", "args": ["value.id", "value.deep.n ?? 0"], "filter": 'value.kind in ["A", "B"] && value.id != 5'},
            {"predicate": "cmd", "args": ["value.cmd"], "filter": 'value.kind == "A"'},
        ]}],
        "matchers": [{"predicate": "cmd", "term": 0, "contains": ["/ENC"], "case_insensitive": True, "windash": True}],
    }
    db = load(spark, config, f"{tmp_path}/")
    assert sorted(map(tuple, db.facts("ev", 2).collect())) == [("1", "0"), ("2", "3")]
    assert [tuple(r) for r in db.facts("ci_wd_contains", 2).collect()] == [("-enc x", "/ENC")]
    assert db.query("ev", 2, None).count() == 1
    assert [r.value for r in encode(db.relations["ev", 2], "ev", ["id", "n"]).orderBy("value").collect()] == ['{"ev":{"id":1,"n":0}}', '{"ev":{"id":2,"n":3}}']
    (tmp_path / "bad.jsonl").write_text('{"a": 1}\n[1]\n')
    with pytest.raises(Exception, match="not a JSON object"):
        records(spark, f"{tmp_path}/bad.jsonl").collect()
    with pytest.raises(MappingError):
        mapped(records(spark, f"{tmp_path}/x.jsonl.gz"), ["len(value)"])
    assert read_patterns(" a \n# no\n\nb") == ["a", "b"]


@pytest.mark.parametrize(
    "kind,patterns,how,expected",
    [
        ("contains", ["bc", "Q"], {}, {("abc", "bc")}),
        ("starts_with", ["AB"], {"case_insensitive": True}, {("abc", "AB")}),
        ("ends_with", ["bc"], {}, {("abc", "bc")}),
        ("regex_match", ["^a.c$", "^x"], {}, {("abc", "^a.c$")}),
        ("cidr", ["10.0.0.0/8", "2001:db8::/32"], {}, {("10.1.2.3", "10.0.0.0/8"), ("2001:db8::1", "2001:db8::/32")}),
        ("base64", ["secret"], {}, {("eHNlY3JldHg=", "secret"), ("c2VjcmV0", "secret")}),
    ],
)
def test_matchers(spark, kind, patterns, how, expected):
    df = spark.createDataFrame([("abc",), ("abc",), (None,), ("10.1.2.3",), ("2001:db8::1",), ("eHNlY3JldHg=",), ("c2VjcmV0",)], "v string")
    assert {tuple(r) for r in matchers.match(df, "v", kind, patterns, **how).collect()} == expected


def test_builder(spark):
    a, b = spark.createDataFrame([(1, 2), (2, 5)], "k int, v int"), spark.createDataFrame([(1, "x")], "k int, n string")
    made = select("a", "a.k", "n").left_join("b", "a.k = b.k").where("v > ?", 1).order_by("a.k DESC").limit(2)
    assert [tuple(r) for r in made.rows(spark, {"a": a, "b": b})] == [(2, None), (1, "x")]
    assert made.first(spark, {"a": a, "b": b}).n is None


def test_streams(spark, tmp_path):
    spark.createDataFrame([(1, 2, "a/b", 1.0), (2, 3, "a/b", 2.0), (3, 4, "ab", 3.0), (4, 5, "a/b", 20.0)], "x int, y int, topic string, s double").coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("x int, y int, topic string, s double").parquet(f"{tmp_path}/in")
    seen = {}
    program = Program("r(X,Y) :- e(X,Y). r(X,Y) :- r(X,Z), e(Z,Y).")
    q = reevaluate(stream.select("x", "y"), "e", f"{tmp_path}/store", Database(spark, {("u", 1): from_tuples(spark, [(1,)])}), program, lambda db, n: seen.update({n: db.facts("r", 2).count()})).start()
    q.processAllAvailable(), q.stop()
    assert list(seen.values()) == [10]
    limited = rate_limited(subscribed(stream, "topic", "a"), "topic", "s", 1, 10.0)
    q = limited.writeStream.format("memory").queryName("limited").outputMode("append").start()
    q.processAllAvailable(), q.stop()
    assert sorted((r.seconds, r.allowed) for r in spark.table("limited").collect()) == [(1.0, True), (2.0, False), (20.0, True)]


MAILS = [
    {"from": "a", "to": ["x", "y", "y"], "files": [{"n": "f", "h": 1}, {"n": "g"}], "text": "-enc abc"},
    {"from": "a", "to": ["x"], "text": 5},
    {"from": "a", "to": ["x"], "text": 5},
]
PROGRAM = """
let id = fresh_id();
let who = value.from;
assert("mail", [id, who]);
map(value.to, assert("to", [id, #]));
map(value.files, (
  let fid = fresh_id();
  assert("file", [id, fid, #.n, #.h])
));
match_contains("hit", id, value.text, ["enc", "zzz"]);
match_regex("like", who, value.text, ["^-", "("]);
value.text == 5 ? assert("five", [id]) : assert("other", [id]);
value.text == 5 && assert("kind", [value.text]);
"""


def test_imperative_mappings(spark, tmp_path):
    (tmp_path / "m.jsonl").write_text("\n".join(map(json.dumps, MAILS)))
    (tmp_path / "words.txt").write_text("# names\nx\n")
    (tmp_path / "c.yaml").write_text(
        "sources:\n  - file: m.jsonl\n    mappings:\n      - expr: |\n" + "".join(f"          {line}\n" for line in PROGRAM.splitlines())
        + "      - {predicate: sender, args: [value.from]}\nmatchers:\n  - {predicate: to, term: 1, contains_from: words.txt}\n"
        + "declarations:\n  - {name: mail, terms: [{name: id, type: id}, {name: from, type: integer}]}\n"
    )
    config = read_config(f"{tmp_path}/c.yaml")
    db = load(spark, config, f"{tmp_path}/")
    rows = lambda name, n: sorted(map(tuple, db.facts(name, n).collect()), key=str)
    mails = rows("mail", 2)
    assert len({i for i, _ in mails}) == 3 and {w for _, w in mails} == {'"a"'}
    assert len(rows("to", 2)) == 4 and {i for i, _ in rows("to", 2)} == {i for i, _ in mails}
    files = rows("file", 4)
    assert sorted(f[2:] for f in files) == [('"f"', "1"), ('"g"', "null")]
    assert len({f[1] for f in files} | {i for i, _ in mails}) == 5
    assert [r[1] for r in rows("hit", 2)] == ["enc"] and rows("like", 2) == [('"a"', "^-")]
    assert len(rows("five", 1)) == 2 and len(rows("other", 1)) == 1 and rows("kind", 1) == [("5",)]
    assert rows("contains", 2) == [("x", "x")] and rows("sender", 1) == [('"a"',)]
    out = Program('r(T) :- mail(I, _), to(I, T). n(I) :- mail(I, _), I = 1. t(T) :- mail(I, _), @json_type(I, T).').transform(db)
    assert sorted(r[0] for r in out.facts("r", 1).collect()) == ['"x"', '"y"']
    assert out.facts("n", 1).count() == 0 and [r[0] for r in out.facts("t", 1).collect()] == ["id"]
    assert mistyped(db.relations["mail", 2], config["declarations"][0]).count() == 3
    line = json.loads(encode(db.relations["mail", 2], "mail", term_names(config["declarations"])["mail", 2]).first().value)
    assert line["mail"]["from"] == "a" and line["mail"]["id"] in {i for i, _ in mails}
    assert probe(spark, 'assert("seen", [value.host]); map(value.l, assert("e", [#]))', {"host": "h", "l": [1]}) == {"seen": [('"h"',)], "e": [("1",)]}
    for bad in ('assert(value.x, [1])', 'assert("p", value)', "launch(1)", 'map(value.l, assert("p", [#])'):
        with pytest.raises(MappingError):
            probe(spark, bad, {"x": 1})


def test_archives_and_checks(spark, tmp_path):
    schema = {"sources": [{"file": "m.jsonl", "mappings": [{"predicate": "p", "args": ["value.from"], "filter": "value.text"}]}]}
    with zipfile.ZipFile(tmp_path / "all.zip", "w") as z:
        z.writestr("m.jsonl", "\n".join(map(json.dumps, MAILS)))
        z.writestr("s.json", json.dumps(schema))
    config = read_config(f"{tmp_path}/all.zip")
    assert config["sources"] == schema["sources"]
    assert load(spark, config, f"{tmp_path}/all.zip/").facts("p", 1).count() == 0
    assert rejected(records(spark, f"{tmp_path}/all.zip/m.jsonl"), "value.text").count() == 3
    assert [r.value for r in browse(spark, f"{tmp_path}/all.zip/m.jsonl", 1, 1).collect()] == [json.dumps(MAILS[1])]
    assert browse(spark, f"{tmp_path}/all.zip/m.jsonl", contains="-ENC").count() == 1
    for bad in (
        {"sources": [{"file": "x", "mappings": [{"predicate": "p", "expr": "1"}]}]}, {"sources": [{"file": "x", "mappings": [{}]}]},
        {"matchers": [{"predicate": "p", "term": 0}]}, {"matchers": [{"predicate": "p", "term": 0, "cidr": ["nope"]}]},
        {"matchers": [{"predicate": "p", "term": 0, "contains_from": "x"}]}, {"declarations": [{"name": "p", "terms": [{"name": "1"}, {}]}]},
    ):
        with pytest.raises(ConfigError):
            check(bad)


@pytest.mark.parametrize("more", ["", '; assert("a", [id, 1])'])
def test_numbered_records_are_not_broadcast(spark, more):
    records = spark.range(50).select(F.try_parse_json(F.to_json(F.struct("id"))).alias("record"))
    made = run_program('let id = fresh_id(); assert("a", [id, value.id]); assert("b", [id, value.id])' + more, records)
    db = Database(spark, {k: merged(v) for k, v in made.items()})
    out = Program("goal(I, V) :- a(I, V), b(I, V).").transform(db).facts("goal", 2)
    assert "BroadcastHashJoin" not in out._jdf.queryExecution().executedPlan().toString()
    assert out.count() == 50
