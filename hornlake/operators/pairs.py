"""Pairs that far outnumber the rows they come from, made where they are read.

Rows of one class (or key) are dealt into blocks, and two blocks meet in one task: what is sent
grows with rows / SIDE and not with pairs, and one class with most rows is spread like any other.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.language import Atom, Compare, Rule, Var, variables
from ..sources.storage import hold

SIDE = 2048  # rows of a block
PER_TASK = 4_000_000  # pairs of a task, about
MOST_TASKS = 2_000


def expanded(pairs: DataFrame, members: DataFrame, total: int, alone: bool = True) -> DataFrame:
    """(a, b): for pairs (a, b) of classes all pairs of their members (node, class).

    total: about how many they are.  alone: nodes that members lacks are classes of their own, else they are left out.
    """
    if alone:
        ends = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
        members = members.select("node", "class").union(ends.join(members.select("class").distinct().toDF("node"), "node", "left_anti").select("node", F.col("node").alias("class")))
    sizes = members.groupBy("class").count()
    dealt = members.join(sizes, "class").select("class", F.pmod(F.xxhash64("node"), F.ceil(F.col("count") / F.lit(SIDE))).alias("block"), "node")
    blocks = dealt.select("class", "block").distinct()
    met = pairs.select("a", "b").join(blocks.toDF("a", "i"), "a").join(blocks.toDF("b", "j"), "b")
    left = met.join(dealt.toDF("a", "i", "u"), ["a", "i"]).select("a", "b", "i", "j", "u")
    right = met.join(dealt.toDF("b", "j", "v"), ["b", "j"]).select("a", "b", "i", "j", "v")
    keys = ["a", "b", "i", "j"]
    if total > PER_TASK:
        tasks = max(pairs.sparkSession.sparkContext.defaultParallelism, min(MOST_TASKS, total // PER_TASK))
        left, right = left.repartition(tasks, *keys), right.repartition(tasks, *keys).hint("shuffle_hash")
    return left.join(right, keys).select(F.col("u").alias("a"), F.col("v").alias("b"))


@dataclass
class Halves:
    """A body as two that share the variable hub alone; across: comparisons between them."""

    left: Rule
    right: Rule
    hub: str
    across: list[Compare]


def halves(rule: Rule) -> Halves | None:
    """The rule cut at a variable outside its head, so that each half has a part of the head; None if there is none."""
    head = variables(rule.head)
    if rule.aggregate or len(head) != len(rule.head.terms) or not all(isinstance(t, Var) for t in rule.head.terms):
        return None
    positive = [b for b in rule.body if isinstance(b, Atom) and not b.negated and b.name[0] != "@"]
    for hub in sorted(set().union(*map(variables, positive)) - head):
        parts: list[tuple[set[str], list]] = []
        for b in rule.body:
            if not isinstance(b, Compare):
                own = variables(b) - {hub}
                met = [p for p in parts if p[0] & own]
                parts = [p for p in parts if not p[0] & own] + [(own.union(*(p[0] for p in met)), [x for p in met for x in p[1]] + [b])]
        sides = [p for p in parts if p[0] & head]
        if len(sides) != 2 or not all(any(b in positive and hub in variables(b) for b in p[1]) for p in sides):
            continue
        if not rule.head.terms[0].name in sides[0][0]:
            sides.reverse()
        sides[0][1].extend(b for p in parts if not p[0] & head for b in p[1])
        sides[0][0].update(*(p[0] for p in parts if not p[0] & head))
        across = []
        for b in rule.body:
            if isinstance(b, Compare):
                side = next((p for p in sides if variables(b) <= p[0] | {hub}), None)
                side[1].append(b) if side else across.append(b)
        used = head.union(*map(variables, across))
        made = [Rule(Atom(n, tuple(Var(v) for v in sorted(used & p[0] | {hub}))), tuple(sorted(p[1], key=rule.body.index))) for n, p in zip(("_left", "_right"), sides, strict=True)]
        return Halves(*made, hub, across)
    return None


def unique(df: DataFrame, columns: list[str]) -> bool:
    return df.groupBy(*columns).count().where("count > 1").isEmpty()


def matched(left: DataFrame, right: DataFrame, keys: int, test) -> tuple[DataFrame, int]:
    """(left x right where l_k0.. equal r_k0.. and the test holds; pairs before the test), null keys equal.

    Where pairs are many, the rows of each key that has more than a block are dealt into blocks, and left
    blocks meet right ones in tasks of their own.
    """
    names = range(keys)
    on = reduce(lambda a, b: a & b, [F.col(f"l_k{i}").eqNullSafe(F.col(f"r_k{i}")) for i in names])
    counts = [d.groupBy(*[F.col(f"{s}_k{i}") for i in names]).agg(F.count(F.lit(1)).alias(f"{s}_n")) for d, s in ((left, "l"), (right, "r"))]
    both = counts[0].join(counts[1], on)
    total = both.agg(F.sum(F.col("l_n").cast("double") * F.col("r_n"))).first()[0] or 0
    whole = left.join(right, on).where(test)
    if total <= PER_TASK:
        return whole, int(total)
    full, _ = hold(both.where(F.greatest("l_n", "r_n") > SIDE).select(*[F.col(f"l_k{i}").alias(f"k{i}") for i in names], "l_n", "r_n").withColumn("_no", F.monotonically_increasing_id()))
    if full.isEmpty():
        return whole, int(total)
    dealt = []
    tasks = max(left.sparkSession.sparkContext.defaultParallelism, min(MOST_TASKS, int(total // PER_TASK)))
    for df, s, o in ((left, "l", "r"), (right, "r", "l")):
        met = reduce(lambda a, b: a & b, [F.col(f"{s}_k{i}").eqNullSafe(F.col(f"k{i}")) for i in names])
        own, other = (F.ceil(F.col(f"{x}_n") / F.lit(SIDE)).cast("bigint") for x in (s, o))
        rows = df.join(F.broadcast(full), met).withColumn("_own", F.pmod(F.xxhash64(*df.columns), own)).withColumn("_other", F.explode(F.sequence(F.lit(0).cast("bigint"), other - 1)))
        block = [F.col(c).alias(f"{s}_{n}") for c, n in (("_no", "key"), ("_own", s), ("_other", o))]
        names_of = [f"{s}_{n}" for n in ("key", "l", "r")]
        dealt.append(rows.select(*block, *df.columns).repartition(tasks, *names_of))
    same = reduce(lambda a, b: a & b, [F.col(f"l_{n}") == F.col(f"r_{n}") for n in ("key", "l", "r")])
    hot = dealt[0].join(dealt[1].hint("shuffle_hash"), same).where(test).select(*left.columns, *right.columns)
    cold = left.join(F.broadcast(full), reduce(lambda a, b: a & b, [F.col(f"l_k{i}").eqNullSafe(F.col(f"k{i}")) for i in names]), "left_anti")
    return hot.union(cold.join(right, on).where(test).select(*left.columns, *right.columns)), int(total)
