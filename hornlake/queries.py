"""The library's queries, each a rule program (or matcher, or builder) with its SQL for DuckDB.

A program's goal predicate becomes a frame whose columns are cast and named as the SQL has them.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.builtins import MULTI, VALUES
from .operators import matchers
from .operators.fixpoint import Program
from .operators.relational import insert, select, statement
from .operators.rules import Functions
from .session import Session
from .sources.config import term_names
from .sources.database import Database, from_frame
from .sources.jsonl import encode, load, merged
from .sources.mapping import run_program
from .sources.storage import shared_dir

JSON_COLUMNS = {"events": ("props",)}
QUERIES: dict = {}
SQL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def program(name: str, tables: str, text: str, columns: str, sql: str | None, functions=None, before=None) -> None:
    """Register a program; columns: 'name type' of the goal predicate `goal`."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        db = Database.tables(spark, sf_dir, JSON_COLUMNS, tables.split())
        db = before(db) if before else db
        out = Program(text, functions).transform(db, {"goal"})
        wanted = [c.split() for c in columns.split(", ")]
        return out.facts("goal", len(wanted)).select(*[F.col(f"c{i}").cast(t).alias(n) for i, (n, t) in enumerate(wanted)])

    QUERIES[name] = run
    if sql:
        SQL[name] = sql


program("q01_scan", "region", "goal(K, N) :- region(K, N).", "k bigint, n string", "SELECT CAST(r_regionkey AS BIGINT) k, r_name n FROM region")
program("q02_constant", "orders", 'goal(K) :- orders(K, _, "F", _, _, _).', "k bigint", "SELECT DISTINCT CAST(o_orderkey AS BIGINT) k FROM orders WHERE o_orderstatus = 'F'")
program("q03_filter", "events", "goal(E, V) :- events(E, _, _, _, V, _), V > 100.", "e bigint, v double", "SELECT DISTINCT CAST(event_id AS BIGINT) e, value v FROM events WHERE value > 100")
program("q04_range", "events", "goal(E) :- events(E, _, _, _, V, _), V >= 50, V < 60.", "e bigint", "SELECT DISTINCT CAST(event_id AS BIGINT) e FROM events WHERE value >= 50 AND value < 60")
program("q05_not_equal", "events", 'goal(E, T) :- events(E, _, _, T, _, _), T != "error".', "e bigint, t string", "SELECT DISTINCT CAST(event_id AS BIGINT) e, event_type t FROM events WHERE event_type <> 'error'")
program("q06_distinct", "events", "goal(T) :- events(_, _, _, T, _, _).", "t string", "SELECT DISTINCT event_type t FROM events")
program("q07_join", "customer nation", "goal(C, N) :- customer(C, _, K, _, _), nation(K, N, _).", "c bigint, n string", "SELECT CAST(c_custkey AS BIGINT) c, n_name n FROM customer JOIN nation ON c_nationkey = n_nationkey")
program("q08_join4", "region nation customer orders", "goal(O, R) :- orders(O, C, _, _, _, _), customer(C, _, N, _, _), nation(N, _, K), region(K, R).", "o bigint, r string", "SELECT DISTINCT CAST(o_orderkey AS BIGINT) o, r_name r FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
program("q09_self_join", "supplier", "goal(A, B) :- supplier(A, _, N, _), supplier(B, _, N, _), A < B.", "a bigint, b bigint", "SELECT CAST(x.s_suppkey AS BIGINT) a, CAST(y.s_suppkey AS BIGINT) b FROM supplier x JOIN supplier y ON x.s_nationkey = y.s_nationkey AND x.s_suppkey < y.s_suppkey")
program("q10_theta_join", "supplier customer", "goal(S, C) :- supplier(S, _, N, A), customer(C, _, N, B, _), B > A.", "s bigint, c bigint", "SELECT CAST(s_suppkey AS BIGINT) s, CAST(c_custkey AS BIGINT) c FROM supplier JOIN customer ON s_nationkey = c_nationkey AND c_acctbal > s_acctbal")
program("q11_cross", "region", "goal(A, B) :- region(_, A), region(_, B).", "a string, b string", "SELECT x.r_name a, y.r_name b FROM region x CROSS JOIN region y")
program("q12_semi_join", "customer orders", 'goal(C) :- customer(C, _, _, _, _), orders(_, C, _, _, _, "1-URGENT").', "c bigint", "SELECT CAST(c_custkey AS BIGINT) c FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')")
program("q13_anti_join", "events", 'big(U) :- events(_, _, U, "purchase", V, _), V > 150. goal(U) :- events(_, _, U, _, _, _), not big(U).', "u bigint", "SELECT DISTINCT CAST(user_id AS BIGINT) u FROM events e WHERE NOT EXISTS (SELECT 1 FROM events x WHERE x.user_id = e.user_id AND x.event_type = 'purchase' AND x.value > 150)")
program("q14_anti_join2", "events", "seen(U, T) :- events(_, _, U, T, V, _), V > 100. user(U) :- events(_, _, U, _, _, _). kind(T) :- events(_, _, _, T, _, _). goal(U, T) :- user(U), kind(T), not seen(U, T).", "u bigint, t string", "SELECT CAST(u AS BIGINT) u, t FROM (SELECT DISTINCT user_id u FROM events) CROSS JOIN (SELECT DISTINCT event_type t FROM events) WHERE NOT EXISTS (SELECT 1 FROM events WHERE user_id = u AND event_type = t AND value > 100)")
program("q15_union", "customer supplier", "goal(N) :- customer(_, _, N, B, _), B > 9000. goal(N) :- supplier(_, _, N, B), B > 9000.", "n bigint", "SELECT CAST(c_nationkey AS BIGINT) n FROM customer WHERE c_acctbal > 9000 UNION SELECT s_nationkey FROM supplier WHERE s_acctbal > 9000")
program("q16_intersect", "customer supplier", "a(N) :- customer(_, _, N, B, _), B > 5000. b(N) :- supplier(_, _, N, B), B > 5000. goal(N) :- a(N), b(N).", "n bigint", "SELECT CAST(c_nationkey AS BIGINT) n FROM customer WHERE c_acctbal > 5000 INTERSECT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000")
program("q17_except", "customer supplier", "b(N) :- supplier(_, _, N, B), B > 5000. goal(N) :- customer(_, _, N, _, _), not b(N).", "n bigint", "SELECT CAST(c_nationkey AS BIGINT) n FROM customer EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000")
program("q18_count", "events", "goal(U, N) :- N = count : events(_, _, U, _, _, _).", "u bigint, n bigint", "SELECT CAST(user_id AS BIGINT) u, count(*) n FROM events GROUP BY 1")
program("q19_count_join", "lineitem orders customer", "goal(K, N) :- N = count : lineitem(O, _, _, _, _, _, _, _, _, _, _), orders(O, C, _, _, _, _), customer(C, _, K, _, _).", "k bigint, n bigint", "SELECT CAST(c_nationkey AS BIGINT) k, count(*) n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY 1")
program("q20_count_all", "lineitem", "goal(N) :- N = count : lineitem(_, _, _, _, _, _, _, _, _, _, _).", "n bigint", "SELECT count(*) n FROM lineitem")
program("q21_count_none", "events", 'goal(N) :- N = count : events(_, _, _, "absent", _, _).', "n bigint", "SELECT count(*) n FROM events WHERE event_type = 'absent' HAVING count(*) > 0")
program("q22_count_distinct", "events", "pair(T, U) :- events(_, _, U, T, _, _). goal(T, N) :- N = count : pair(T, _).", "t string, n bigint", "SELECT event_type t, count(DISTINCT user_id) n FROM events GROUP BY 1")
program("q23_sum_integer", "lineitem", "goal(F, S) :- S = sum(N) : lineitem(_, _, _, N, _, _, _, _, F, _, _).", "f string, s bigint", "SELECT l_returnflag f, CAST(sum(l_linenumber) AS BIGINT) s FROM lineitem GROUP BY 1")
program("q24_sum_float", "lineitem", "goal(F, L, S) :- S = sum(Q) : lineitem(_, _, _, _, Q, _, _, _, F, L, _).", "f string, l string, s double", "SELECT l_returnflag f, l_linestatus l, sum(l_quantity) s FROM lineitem GROUP BY 1, 2")
program("q25_min", "orders", "goal(P, M) :- M = min(T) : orders(_, _, _, T, _, P).", "p string, m double", "SELECT o_orderpriority p, min(o_totalprice) m FROM orders GROUP BY 1")
program("q26_max", "orders", "goal(P, M) :- M = max(T) : orders(_, _, _, T, _, P).", "p string, m double", "SELECT o_orderpriority p, max(o_totalprice) m FROM orders GROUP BY 1")
program("q27_having", "events", "n(U, N) :- N = count : events(_, _, U, _, _, _). goal(U, N) :- n(U, N), N > 60.", "u bigint, n bigint", "SELECT CAST(user_id AS BIGINT) u, count(*) n FROM events GROUP BY 1 HAVING count(*) > 60")
program("q28_argmax", "orders", "m(C, M) :- M = max(T) : orders(_, C, _, T, _, _). goal(C, O) :- m(C, M), orders(O, C, _, M, _, _).", "c bigint, o bigint", "SELECT CAST(o_custkey AS BIGINT) c, CAST(o_orderkey AS BIGINT) o FROM orders JOIN (SELECT o_custkey k, max(o_totalprice) m FROM orders GROUP BY 1) ON o_custkey = k AND o_totalprice = m")
program("q29_average", "lineitem", "s(F, S) :- S = sum(Q) : lineitem(_, _, _, _, Q, _, _, _, F, _, _). n(F, N) :- N = count : lineitem(_, _, _, _, _, _, _, _, F, _, _). goal(F, A) :- s(F, S), n(F, N), A is S / N.", "f string, a double", "SELECT l_returnflag f, sum(l_quantity) / count(*) a FROM lineitem GROUP BY 1")
program("q30_arithmetic", "lineitem", "goal(O, N, R) :- lineitem(O, _, _, N, _, P, D, _, _, _, _), R is P * (1 - D), R > 50000.", "o bigint, n bigint, r double", "SELECT DISTINCT CAST(l_orderkey AS BIGINT) o, CAST(l_linenumber AS BIGINT) n, l_extendedprice * (1 - l_discount) r FROM lineitem WHERE l_extendedprice * (1 - l_discount) > 50000")
program("q31_div_mod", "orders", "goal(K, D, M) :- orders(K, _, _, _, _, _), D is K / 7, M is K mod 7.", "k bigint, d bigint, m bigint", "SELECT DISTINCT CAST(o_orderkey AS BIGINT) k, CAST(o_orderkey // 7 AS BIGINT) d, CAST(o_orderkey % 7 AS BIGINT) m FROM orders")
program("q32_div_zero", "customer", "goal(K, X) :- customer(K, _, _, _, _), X is 10 / (K mod 3).", "k bigint, x bigint", "SELECT CAST(c_custkey AS BIGINT) k, CAST(10 // (c_custkey % 3) AS BIGINT) x FROM customer WHERE c_custkey % 3 <> 0")
program("q33_contains", "part", 'goal(K, N) :- part(K, N, _, _, _, _), @contains(N, "ar").', "k bigint, n string", "SELECT CAST(p_partkey AS BIGINT) k, p_name n FROM part WHERE contains(p_name, 'ar')")
program("q34_starts_with", "pages", 'goal(P, U) :- pages(P, U, _), @starts_with(U, "https://").', "p bigint, u string", "SELECT CAST(page_id AS BIGINT) p, url u FROM pages WHERE starts_with(url, 'https://')")
program("q35_ends_with", "pages", 'goal(P, U) :- pages(P, U, _), @ends_with(U, "1").', "p bigint, u string", "SELECT CAST(page_id AS BIGINT) p, url u FROM pages WHERE ends_with(url, '1')")
program("q36_regex_match", "documents", 'goal(D) :- documents(D, T, _, _, _), @regex_match(T, "[0-9]{3}-[0-9]{4}").', "d bigint", "SELECT CAST(doc_id AS BIGINT) d FROM documents WHERE regexp_matches(text, '[0-9]{3}-[0-9]{4}')")
EDGES = "edge(X, Y) :- part(X, _, _, _, S, _), S > 1, Y is X + 1, part(Y, _, _, _, _, _). "
EDGE_SQL = "edge AS (SELECT a.p_partkey::BIGINT x, b.p_partkey::BIGINT y FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1 WHERE a.p_size > 1)"
program("q37_linear_recursion", "part", EDGES + "goal(X, Y) :- edge(X, Y). goal(X, Y) :- goal(X, Z), edge(Z, Y).", "x bigint, y bigint", f"WITH RECURSIVE {EDGE_SQL}, r AS (SELECT x, y FROM edge UNION SELECT r.x, edge.y FROM r JOIN edge ON r.y = edge.x) SELECT x, y FROM r")
RING = "next(A, B) :- nation(A, _, _), B is (A * 3 + 1) mod 25. next(A, B) :- nation(A, _, R), nation(B, _, R), B is A + 5. "
RING_SQL = "nxt AS (SELECT n_nationkey::BIGINT a, CAST((n_nationkey * 3 + 1) % 25 AS BIGINT) b FROM nation UNION SELECT p.n_nationkey::BIGINT, q.n_nationkey::BIGINT FROM nation p JOIN nation q ON p.n_regionkey = q.n_regionkey AND q.n_nationkey = p.n_nationkey + 5)"
CLOSURE_SQL = f"WITH RECURSIVE {RING_SQL}, r AS (SELECT a, b FROM nxt UNION SELECT r.a, nxt.b FROM r JOIN nxt ON r.b = nxt.a)"
program("q38_cyclic_recursion", "nation", RING + "goal(A, B) :- next(A, B). goal(A, B) :- next(A, C), goal(C, B).", "a bigint, b bigint", f"{CLOSURE_SQL} SELECT a, b FROM r")
program("q39_nonlinear_recursion", "nation", RING + "goal(A, B) :- next(A, B). goal(A, B) :- goal(A, C), goal(C, B).", "a bigint, b bigint", f"{CLOSURE_SQL} SELECT a, b FROM r")
program("q40_mutual_recursion", "nation", RING + "odd(A, B) :- next(A, B). odd(A, B) :- goal(A, C), next(C, B). goal(A, B) :- odd(A, C), next(C, B).", "a bigint, b bigint", f"WITH RECURSIVE {RING_SQL}, r AS (SELECT a, b, 1 p FROM nxt UNION SELECT r.a, nxt.b, 1 - r.p FROM r JOIN nxt ON r.b = nxt.a) SELECT a, b FROM r WHERE p = 0")
program("q41_negation_over_recursion", "nation", RING + "reach(A, B) :- next(A, B). reach(A, B) :- reach(A, C), next(C, B). goal(A, B) :- nation(A, _, _), nation(B, _, _), not reach(A, B).", "a bigint, b bigint", f"{CLOSURE_SQL} SELECT x.n_nationkey::BIGINT a, y.n_nationkey::BIGINT b FROM nation x CROSS JOIN nation y WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.a = x.n_nationkey AND r.b = y.n_nationkey)")
program("q42_components", "part", EDGES + "link(X, Y) :- edge(X, Y). link(X, Y) :- edge(Y, X). reach(X, X) :- part(X, _, _, _, _, _). reach(X, Y) :- link(X, Y). reach(X, Y) :- reach(X, Z), reach(Z, Y). goal(X, C) :- C = min(Y) : reach(X, Y).", "x bigint, c bigint", f"WITH RECURSIVE {EDGE_SQL}, link AS (SELECT x, y FROM edge UNION SELECT y, x FROM edge), r AS (SELECT p_partkey::BIGINT x, p_partkey::BIGINT y FROM part UNION SELECT r.x, link.y FROM r JOIN link ON r.y = link.x) SELECT x, min(y) c FROM r GROUP BY 1")
TREE = "parent(C, P) :- supplier(C, _, _, _), C > 1, P is C / 2. "
program("q43_same_generation", "supplier", TREE + "goal(A, B) :- parent(A, P), parent(B, P). goal(A, B) :- parent(A, P), goal(P, Q), parent(B, Q).", "a bigint, b bigint", "WITH RECURSIVE parent AS (SELECT s_suppkey::BIGINT c, (s_suppkey // 2)::BIGINT p FROM supplier WHERE s_suppkey > 1), g AS (SELECT x.c a, y.c b FROM parent x JOIN parent y ON x.p = y.p UNION SELECT x.c, y.c FROM g JOIN parent x ON x.p = g.a JOIN parent y ON y.p = g.b) SELECT a, b FROM g")
program("q44_counter", "region", "goal(0). goal(Y) :- goal(X), X < 8, Y is X + 1.", "n bigint", "SELECT n::BIGINT n FROM range(0, 9) t(n)")
program("q45_json_get", "events", 'goal(E, K) :- events(E, _, _, _, _, P), @json_get(P, "k", K).', "e bigint, k bigint", "SELECT DISTINCT event_id::BIGINT e, CAST(json_extract(props, '$.k') AS BIGINT) k FROM events")
program("q46_object_pattern", "events", "goal(E, K) :- events(E, _, _, _, _, {k: K}), K > 50.", "e bigint, k bigint", "SELECT DISTINCT event_id::BIGINT e, CAST(json_extract(props, '$.k') AS BIGINT) k FROM events WHERE CAST(json_extract(props, '$.k') AS BIGINT) > 50")
program("q47_json_len_type", "events", "goal(E, T, N) :- events(E, _, _, _, _, P), @json_type(P, T), @json_len(P, N).", "e bigint, t string, n bigint", "SELECT DISTINCT event_id::BIGINT e, lower(json_type(props)) t, CAST(len(json_keys(props)) AS BIGINT) n FROM events")
program("q48_json_items", "events", "goal(E, K, V) :- events(E, _, _, _, _, P), @json_items(P, K, V).", "e bigint, k string, v string", "SELECT DISTINCT event_id::BIGINT e, 'k' k, CAST(json_extract(props, '$.k') AS VARCHAR) v FROM events")
program("q49_json_each", "embeddings", "goal(V, N) :- N = count : embeddings(V, L, _), @json_each(L, _).", "v bigint, n bigint", "SELECT vec_id::BIGINT v, len(embedding)::BIGINT n FROM embeddings WHERE len(embedding) > 0")


def nation_lists(db: Database) -> Database:
    """start(region, list of its nations' keys)."""
    nation = db.relations["nation", 3].df
    lists = nation.groupBy(F.col("c2").alias("region")).agg(F.array_sort(F.collect_list("c0")).alias("keys"))
    return db.extend({("start", 2): from_frame(lists)})


program("q50_list_recursion", "nation", "walk(R, L) :- start(R, L). walk(R, T) :- walk(R, [_ | T]). goal(R, H) :- walk(R, [H | _]).", "r bigint, h bigint", "SELECT n_regionkey::BIGINT r, n_nationkey::BIGINT h FROM nation", before=nation_lists)
program("q51_time_diff", "events", 'at(U, T) :- events(_, T, U, "purchase", V, _), V > 100. goal(U, D) :- at(U, A), at(U, B), @time_diff(B, A, D), D > 0, D < 86400.', "u bigint, d double", "SELECT DISTINCT a.user_id::BIGINT u, (epoch_us(b.ts) - epoch_us(a.ts)) / 1000000.0::DOUBLE d FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = 'purchase' AND b.event_type = 'purchase' AND a.value > 100 AND b.value > 100 WHERE epoch_us(b.ts) > epoch_us(a.ts) AND epoch_us(b.ts) - epoch_us(a.ts) < 86400000000")
OWN = Functions(VALUES | {"@length": (2, lambda t: (F.length(t[0]).cast("bigint"), "integer"))}, MULTI | {"@words": (1, lambda t: (F.transform(F.split(t[0], " "), lambda w: F.struct(w.alias("o0"))), ["string"]))})
program("q52_user_builtin", "documents", "goal(D, N) :- documents(D, T, _, _, _), @length(T, N).", "d bigint, n bigint", "SELECT doc_id::BIGINT d, length(text)::BIGINT n FROM documents", OWN)
program("q53_multi_builtin", "documents", "goal(L, N) :- N = count : documents(_, T, L, _, _), @words(T, _).", "l string, n bigint", "SELECT lang l, CAST(sum(len(string_split(text, ' '))) AS BIGINT) n FROM documents GROUP BY 1", OWN)
program("q61_ownership_cycle", "customer orders", "own(N, C) :- customer(C, _, N, _, _). total(T) :- T = count : customer(_, _, _, _, _). moved(A, B) :- total(T), customer(A, _, _, _, _), B is (A * 7 + 3) mod T, customer(B, _, _, _, _). goal(N, A, B) :- own(N, A), moved(A, M), own(O, M), moved(M, B), own(N, B), O != N.", "n bigint, a bigint, b bigint", "WITH moved AS (SELECT x.c_custkey a, y.c_custkey b FROM customer x JOIN customer y ON y.c_custkey = (x.c_custkey * 7 + 3) % (SELECT count(*) FROM customer)) SELECT DISTINCT p.c_nationkey::BIGINT n, p.c_custkey::BIGINT a, r.c_custkey::BIGINT b FROM customer p JOIN moved m1 ON m1.a = p.c_custkey JOIN customer q ON q.c_custkey = m1.b JOIN moved m2 ON m2.a = q.c_custkey JOIN customer r ON r.c_custkey = m2.b AND r.c_nationkey = p.c_nationkey WHERE q.c_nationkey <> p.c_nationkey")
program("q62_taint", "part events", EDGES + 'goal(X) :- events(_, _, X, "error", V, _), V > 120. goal(Y) :- goal(X), edge(X, Y).', "x bigint", f"WITH RECURSIVE {EDGE_SQL}, r AS (SELECT DISTINCT user_id::BIGINT x FROM events WHERE event_type = 'error' AND value > 120 UNION SELECT edge.y FROM r JOIN edge ON r.x = edge.x) SELECT x FROM r")


def q54_external(spark, sf_dir):
    """A relation that a function supplies for the keys that the program can ask for."""
    db = Database.tables(spark, sf_dir, names=["nation"])
    fetch = lambda keys: keys[0].select("value", F.concat(F.lit("code-"), F.col("value").cast("string")))
    made = Program("goal(N, C) :- nation(K, N, _), code(K, C).", externals={("code", 2): fetch})
    return made.transform(db).facts("goal", 2).toDF("n", "c")


QUERIES["q54_external"] = q54_external
SQL["q54_external"] = "SELECT n_name n, concat('code-', n_nationkey) c FROM nation"


def matcher(name: str, of: str, column: str, kind: str, patterns: list[str], condition: str | None, **how) -> None:
    QUERIES[name] = lambda spark, sf_dir: matchers.match(table(spark, sf_dir, of), column, kind, patterns, **how).toDF("value", "pattern")
    if condition:
        listed = ", ".join("('" + p.replace("'", "''") + "')" for p in patterns)
        SQL[name] = f"SELECT DISTINCT {column} AS value, pattern FROM {of}, (VALUES {listed}) p(pattern) WHERE {condition}"


matcher("q55_matcher_contains", "pages", "url", "contains", ["page", "src1", "/2"], "contains(url, pattern)")
matcher("q56_matcher_ci_ends_with", "pages", "url", "ends_with", ["7", "HTML", "/X"], "ends_with(lower(url), lower(pattern))", case_insensitive=True)
matcher("q57_matcher_regex", "documents", "text", "regex_match", ["[0-9]{4}", "idiot|moron", "^The"], "regexp_matches(text, pattern)")
matcher("q58_matcher_windash", "documents", "text", "contains", ["-1", "/a", "scum"], "contains(text, pattern) OR (pattern = '-1' AND contains(text, '/1')) OR (pattern = '/a' AND contains(text, '-a'))", windash=True)


def q59_matcher_base64(spark, sf_dir):
    coded = table(spark, sf_dir, "benchmark").select(F.translate(F.base64(F.encode("text", "utf-8")), "\r\n", "").alias("coded"))
    return matchers.match(coded, "coded", "base64", ["thing", "the on"]).toDF("value", "pattern")


QUERIES["q59_matcher_base64"] = q59_matcher_base64
SQL["q59_matcher_base64"] = """SELECT DISTINCT coded AS value, pattern FROM (SELECT to_base64(encode(text)) coded FROM benchmark), (VALUES ('thing'), ('the on')) p(pattern)
WHERE contains(coded, substr(to_base64(encode(pattern)), 1, length(pattern) * 8 // 6))
OR contains(coded, substr(to_base64(encode('a' || pattern)), 3, (length(pattern) + 1) * 8 // 6 - 2))
OR contains(coded, substr(to_base64(encode('aa' || pattern)), 4, (length(pattern) + 2) * 8 // 6 - 3))"""


def q60_matcher_cidr(spark, sf_dir):
    hosts = table(spark, sf_dir, "customer").select(F.concat_ws(".", F.lit(10), F.expr("c_custkey % 4"), F.expr("c_custkey % 256"), F.lit(7)).alias("ip"))
    return matchers.match(hosts, "ip", "cidr", ["10.0.0.0/16", "10.1.16.0/20"]).toDF("value", "pattern")


QUERIES["q60_matcher_cidr"] = q60_matcher_cidr
SQL["q60_matcher_cidr"] = "WITH h AS (SELECT DISTINCT c_custkey % 4 b, c_custkey % 256 c FROM customer) SELECT concat('10.', b, '.', c, '.7') AS value, pattern FROM h, (VALUES ('10.0.0.0/16'), ('10.1.16.0/20')) p(pattern) WHERE (pattern = '10.0.0.0/16' AND b = 0) OR (pattern = '10.1.16.0/20' AND b = 1 AND c BETWEEN 16 AND 31)"


def q63_select_builder(spark, sf_dir):
    made = select("nation", "n_name", "count(c_custkey) AS customers").left_join("customer", "c_nationkey = n_nationkey", "c_acctbal > 0")
    made = made.where("n_regionkey < ?", 4).group_by("n_name").having("count(c_custkey) > 10").order_by("customers DESC", "n_name").limit(10)
    return made.frame(spark, {n: table(spark, sf_dir, n) for n in ("nation", "customer")})


QUERIES["q63_select_builder"] = q63_select_builder
SQL["q63_select_builder"] = "SELECT n_name, count(c_custkey) AS customers FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey AND c_acctbal > 0 WHERE n_regionkey < 4 GROUP BY n_name HAVING count(c_custkey) > 10 ORDER BY customers DESC, n_name LIMIT 10"

# Records as a JSON-lines source gives them; a program asserts several relations over each.
EVENT_PROGRAM = """
let who = value.user_id;
assert("event", [value.event_id, who, value.event_type]);
value.event_type in ["error", "click"] && assert("watched", [value.event_id, value.detail.k]);
map(value.tags, assert("tag", [who, #]));
match_starts_with("kind", who, value.event_type, ["e", "pu"])
"""


def asserted(spark, sf_dir, text=EVENT_PROGRAM) -> Database:
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", F.from_json("props", "k bigint").alias("detail"), F.array("event_type", F.expr("concat('u', user_id % 7)")).alias("tags"))
    records = events.select(F.try_parse_json(F.to_json(F.struct("*"))).alias("record"))
    return Database(spark, {k: merged(v) for k, v in run_program(text, records).items()})


def q64_imperative_mapping(spark, sf_dir):
    out = Program("goal(U, N, K) :- n(U, N), top(U, K). n(U, N) :- N = count : event(E, U, T), watched(E, _). top(U, K) :- K = max(D) : event(E, U, _), watched(E, D).").transform(asserted(spark, sf_dir))
    return out.facts("goal", 3).select(*[F.col(f"c{i}").cast("double").cast("bigint").alias(c) for i, c in enumerate(("u", "n", "k"))])


def q65_mapped_list(spark, sf_dir):
    out = Program("goal(T, N) :- N = count : tag(_, T).").transform(asserted(spark, sf_dir))
    return out.facts("goal", 2).select(F.from_json(F.concat(F.lit("["), "c0", F.lit("]")), "array<string>")[0].alias("t"), F.col("c1").alias("n"))


def q66_mapped_matches(spark, sf_dir):
    return asserted(spark, sf_dir).facts("kind", 2).select(F.col("c0").cast("bigint").alias("u"), F.col("c1").alias("p"))


def q67_fresh_ids(spark, sf_dir):
    """Every record has an id of its own, the same in all relations that the program asserts."""
    db = asserted(spark, sf_dir, 'let id = fresh_id(); assert("a", [id, value.event_type]); map(value.tags, assert("b", [id, #]))')
    out = Program("goal(T, N) :- N = count : a(I, T), b(I, T).").transform(db)
    return out.facts("goal", 2).select(F.from_json(F.concat(F.lit("["), "c0", F.lit("]")), "array<string>")[0].alias("t"), F.col("c1").alias("n"))


QUERIES |= {q.__name__: q for q in (q64_imperative_mapping, q65_mapped_list, q66_mapped_matches, q67_fresh_ids)}
SQL["q64_imperative_mapping"] = "SELECT user_id::BIGINT u, count(*)::BIGINT n, max(CAST(json_extract(props, '$.k') AS BIGINT)) k FROM events WHERE event_type IN ('error', 'click') GROUP BY 1"
SQL["q65_mapped_list"] = "SELECT t, count(DISTINCT u)::BIGINT n FROM (SELECT user_id u, event_type t FROM events UNION ALL SELECT user_id, concat('u', user_id % 7) FROM events) GROUP BY 1"
SQL["q66_mapped_matches"] = "SELECT DISTINCT user_id::BIGINT u, p FROM events, (VALUES ('e'), ('pu')) x(p) WHERE starts_with(event_type, p)"
SQL["q67_fresh_ids"] = "SELECT event_type t, count(*)::BIGINT n FROM events GROUP BY 1"

FLAGSHIP = """
% Users with several error events of high detail, who share a value with another such user, reach others.
hot(U, K) :- events(_, _, U, "error", V, {k: K}), V > 20.
errors(U, N) :- N = count : events(_, _, U, "error", _, _).
suspect(U) :- errors(U, N), N > 4, hot(U, _).
calm(U) :- events(_, _, U, "purchase", V, _), V > 400.
link(A, B) :- hot(A, K), hot(B, K), A != B, suspect(A), not calm(B).
goal(A, B) :- link(A, B).
goal(A, B) :- goal(A, C), link(C, B).
"""
program("flagship", "events", FLAGSHIP, "a bigint, b bigint", """
WITH RECURSIVE hot AS (SELECT DISTINCT user_id u, CAST(json_extract(props, '$.k') AS BIGINT) k FROM events WHERE event_type = 'error' AND value > 20),
suspect AS (SELECT user_id u FROM events WHERE event_type = 'error' AND user_id IN (SELECT u FROM hot) GROUP BY 1 HAVING count(*) > 4),
link AS (SELECT DISTINCT x.u::BIGINT a, y.u::BIGINT b FROM hot x JOIN hot y ON x.k = y.k AND x.u <> y.u WHERE x.u IN (SELECT u FROM suspect) AND NOT EXISTS (SELECT 1 FROM events WHERE user_id = y.u AND event_type = 'purchase' AND value > 400)),
r AS (SELECT a, b FROM link UNION SELECT r.a, link.b FROM r JOIN link ON r.b = link.a) SELECT a, b FROM r""")

# Forms that the queries above leave out.
program("q68_seeded_closure", "nation", RING + "goal(100, 3). goal(X, Y) :- next(X, Y). goal(X, Y) :- goal(X, Z), next(Z, Y).", "a bigint, b bigint", f"WITH RECURSIVE {RING_SQL}, r AS ((SELECT a, b FROM nxt UNION SELECT 100::BIGINT, 3::BIGINT) UNION SELECT r.a, nxt.b FROM r JOIN nxt ON r.b = nxt.a) SELECT a, b FROM r")
program("q69_repeated_variable", "lineitem", "goal(O, N) :- lineitem(O, _, N, N, _, _, _, _, _, _, _).", "o bigint, n bigint", "SELECT DISTINCT l_orderkey::BIGINT o, l_suppkey::BIGINT n FROM lineitem WHERE l_suppkey = l_linenumber")
program("q70_empty_negation", "region customer", "rich(C) :- customer(C, _, _, B, _), B > 99999999. goal(N) :- region(_, N), not rich(_).", "n string", "SELECT r_name n FROM region WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_acctbal > 99999999)")
program("q71_membership", "customer orders", 'vip(C) :- customer(C, _, _, B, _), B > 9000. goal(O) :- orders(O, C, "F", _, _, _), vip(C).', "o bigint", "SELECT DISTINCT o_orderkey::BIGINT o FROM orders WHERE o_orderstatus = 'F' AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 9000)")
program("q72_precedence", "nation", "goal(K, X, Y) :- nation(K, _, R), X is -K + R * 2 - (3 - K), Y is -(K - R) mod 4.", "k bigint, x bigint, y bigint", "SELECT n_nationkey::BIGINT k, (-n_nationkey + n_regionkey * 2 - (3 - n_nationkey))::BIGINT x, (-(n_nationkey - n_regionkey) % 4)::BIGINT y FROM nation")
program("q73_is_on_bound", "nation", "goal(K, Y) :- nation(K, _, R), K is R * 5, Y is R.", "k bigint, y bigint", "SELECT n_nationkey::BIGINT k, n_regionkey::BIGINT y FROM nation WHERE n_nationkey = n_regionkey * 5")
program("q74_mixed_numbers", "supplier nation", "odd(X) :- nation(_, N, _), X is N + 1. goal(K, X) :- supplier(K, _, N, _), X is N / 2.0, not odd(_).", "k bigint, x double", "SELECT s_suppkey::BIGINT k, s_nationkey / 2.0::DOUBLE x FROM supplier")
program("q75_extreme_of_json", "events", "goal(T, H, L) :- hi(T, H), lo(T, L). hi(T, M) :- M = max(K) : events(_, _, _, T, _, {k: K}). lo(T, M) :- M = min(K) : events(_, _, _, T, _, {k: K}).", "t string, h bigint, l bigint", "SELECT event_type t, max(CAST(json_extract(props, '$.k') AS BIGINT)) h, min(CAST(json_extract(props, '$.k') AS BIGINT)) l FROM events GROUP BY 1")
program("q76_constant_sum", "events", "goal(T, N) :- N = sum(2) : events(_, _, _, T, _, _).", "t string, n bigint", "SELECT event_type t, (2 * count(*))::BIGINT n FROM events GROUP BY 1")
matcher("q77_matcher_many", "pages", "url", "starts_with", ["https://a", "https://b", "https://s", "http://", "https://w", "ftp"], "starts_with(url, pattern)")
matcher("q78_matcher_many_ci", "documents", "text", "contains", ["IDIOT", "Moron", "scum", "c++", "a.b", "the ("], "contains(lower(text), lower(pattern))", case_insensitive=True)


def q79_pattern_query(spark, sf_dir):
    return Database.tables(spark, sf_dir, names=["nation"]).query("nation", None, None, 1).select(F.col("c0").alias("k"), F.col("c1").alias("n"))


def q80_fact_counts(spark, sf_dir):
    db = Database.tables(spark, sf_dir, names=["region", "nation", "customer"])
    return spark.createDataFrame([(n, a, c) for (n, a), c in db.counts().items()], "name string, arity bigint, facts bigint")


def q81_predicates(spark, sf_dir):
    listed = Session(Database.tables(spark, sf_dir, names=["region", "nation"]), "%% where nations lie\nin(N, R) :- nation(_, N, K), region(K, R).").predicates()
    return spark.createDataFrame([(p["name"], p["arity"], p["count"], p["doc"]) for p in listed], "name string, arity bigint, facts bigint, doc string")


def q82_json_lines(spark, sf_dir):
    """Nations as compressed JSON lines, read back by a mapping with a filter."""
    path = f"{shared_dir(spark)}/lines-{uuid.uuid4().hex}"
    table(spark, sf_dir, "nation").select(F.to_json(F.struct("*")).alias("value")).write.option("compression", "gzip").text(path)
    config = {"sources": [{"file": path, "mappings": [{"predicate": "n", "args": ["value.n_nationkey", "value.n_name"], "filter": "value.n_regionkey != 1"}]}]}
    facts = load(spark, config).facts("n", 2)
    return facts.select(F.col("c0").cast("bigint").alias("k"), F.from_json(F.concat(F.lit("["), "c1", F.lit("]")), "array<string>")[0].alias("n"))


def q83_encoder(spark, sf_dir):
    declared = [{"name": "nation", "terms": [{"name": "id"}, {"name": "name"}, {"name": "region"}]}]
    rel = Database.tables(spark, sf_dir, names=["nation"]).relations["nation", 3]
    return encode(rel, "nation", term_names(declared)["nation", 3])


def q84_matcher_utf16(spark, sf_dir):
    coded = table(spark, sf_dir, "nation").select("n_name", F.base64(F.encode("n_name", "UTF-16LE")).alias("coded"))
    hits = matchers.match(coded, "coded", "base64_utf16le", ["NATION", "A", "_1"])
    return coded.join(hits, coded.coded == hits.c0).select(F.col("n_name").alias("name"), F.col("c1").alias("pattern"))


def q85_explanation(spark, sf_dir):
    """The premises of one fact: the first nation and its region."""
    db = Database.tables(spark, sf_dir, names=["region", "nation"])
    first = db.facts("nation", 3).orderBy("c0").first()
    found = Session(db, "lies(N, R) :- nation(_, N, K), region(K, R).").explain(f'lies("{first.c1}", "{db.query("region", first.c2, None).first().c1}")')
    return spark.createDataFrame([(p,) for p in found["premises"]], "premise string")


def q86_insert(spark, sf_dir):
    made = insert("nation", "n_nationkey", "n_name", "n_regionkey").values(3, "renamed", 9).values(1000, "new", 2).values(1000, "again", 3)
    return made.on_conflict("n_nationkey", update=("n_name",)).frame(spark, {"nation": table(spark, sf_dir, "nation")}).select(F.col("n_nationkey").cast("bigint").alias("k"), F.col("n_name").alias("n"), F.col("n_regionkey").cast("bigint").alias("r"))


def q87_raw_statement(spark, sf_dir):
    tables = {n: table(spark, sf_dir, n) for n in ("nation", "region")}
    return statement(spark, "SELECT r_name, count(*) AS nations FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey > ? GROUP BY r_name", tables, 4)


def q88_offset(spark, sf_dir):
    return select("nation", "n_name").order_by("n_name").limit(7).offset(5).frame(spark, {"nation": table(spark, sf_dir, "nation")})


def q89_session_query(spark, sf_dir):
    found = Session(Database.tables(spark, sf_dir, names=["nation", "region"]), "lies(N, R) :- nation(_, N, K), region(K, R).").query("lies(N, R), nation(K, N, _), K > 3?", 8)
    return found.select(F.col("K").alias("k"), F.col("N").alias("n"), F.col("R").alias("r"))


QUERIES |= {q.__name__: q for q in (q79_pattern_query, q80_fact_counts, q81_predicates, q82_json_lines, q83_encoder, q84_matcher_utf16, q85_explanation, q86_insert, q87_raw_statement, q88_offset, q89_session_query)}
SQL |= {
    "q79_pattern_query": "SELECT n_nationkey::BIGINT k, n_name n FROM nation WHERE n_regionkey = 1",
    "q80_fact_counts": "SELECT 'region' AS name, 2::BIGINT arity, count(*) facts FROM region UNION ALL SELECT 'nation', 3, count(*) FROM nation UNION ALL SELECT 'customer', 5, count(*) FROM customer",
    "q81_predicates": "SELECT 'in' AS name, 2::BIGINT arity, count(*) facts, 'where nations lie' AS doc FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT 'nation', 3, count(*), '' FROM nation UNION ALL SELECT 'region', 2, count(*), '' FROM region",
    "q82_json_lines": "SELECT n_nationkey::BIGINT k, n_name n FROM nation WHERE n_regionkey <> 1",
    "q83_encoder": """SELECT concat('{"nation":{"id":', n_nationkey, ',"name":"', n_name, '","region":', n_regionkey, '}}') AS value FROM nation""",
    "q84_matcher_utf16": "SELECT n_name AS name, pattern FROM nation, (VALUES ('NATION'), ('A'), ('_1')) p(pattern) WHERE contains(n_name, pattern)",
    "q85_explanation": """WITH f AS (SELECT * FROM nation ORDER BY n_nationkey LIMIT 1) SELECT concat('nation(', n_nationkey, ', "', n_name, '", ', n_regionkey, ')') AS premise FROM f UNION ALL SELECT concat('region(', r_regionkey, ', "', r_name, '")') FROM f JOIN region ON n_regionkey = r_regionkey""",
    "q86_insert": "SELECT n_nationkey::BIGINT k, CASE WHEN n_nationkey = 3 THEN 'renamed' ELSE n_name END n, n_regionkey::BIGINT r FROM nation UNION ALL SELECT 1000, 'again', 2",
    "q87_raw_statement": "SELECT r_name, count(*) AS nations FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey > 4 GROUP BY r_name",
    "q88_offset": "SELECT n_name FROM nation ORDER BY n_name LIMIT 7 OFFSET 5",
    "q89_session_query": "SELECT n_nationkey::BIGINT k, n_name n, r_name r FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey > 3 ORDER BY k, n, r LIMIT 8",
}
