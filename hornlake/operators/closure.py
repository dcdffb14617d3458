"""Transitive closure of a binary relation, by contraction and powers.

1. Pairs that reach each other both ways are one class: components over such pairs are contracted until
   none is left, so that a dense or cyclic part costs its edges and not its paths.
2. What is left is closed by powers: with R the pairs within 2^k - 1 steps and P those at 2^k steps,
   R := R + P + R.P and P := P.P, so that a chain costs its pairs once and rounds are logarithmic.
   Where R finds new classes, it is contracted and takes the place of the edges.
3. Pairs of classes are expanded to pairs of members, when they are read, block by block.

Where the edges are themselves pairs that meet in a hub, e(A,B) :- l(A,K), r(K,B), the hubs become nodes, so that
a hub of n ends costs n edges and not n * n, see closure_by_hubs.

All steps are joins on one key and distinct; small steps stay in memory (storage.hold).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.storage import hold
from .pairs import expanded

DENSE = 4  # classes are looked for again where pairs outnumber edges by this


@dataclass
class Closure:
    """pairs (a, b) between classes; members (node, class), only of classes that are not their own node.

    alone: nodes without a class are their own; else members has all that count.
    """

    pairs: DataFrame
    members: DataFrame | None
    count: int
    rounds: int
    alone: bool = True

    def rows(self) -> DataFrame:
        """(a, b): all pairs of nodes, distinct."""
        return self.pairs if self.members is None else expanded(self.pairs, self.members, self.count, self.alone)


def classes(links: DataFrame, n: int) -> DataFrame:
    """(node, class): the least node that each node of undirected links (a, b) is connected with.

    Labels take the least of their neighbours' and then their label's label, until none moves.
    """
    both, _ = hold(links.union(links.select("b", "a")).distinct(), 2 * n)
    labels, count = hold(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("class")), 2 * n)
    while True:
        seen = both.join(labels.toDF("b", "other"), "b").groupBy("a").agg(F.min("other").alias("other"))
        nearer = labels.join(seen.withColumnRenamed("a", "node"), "node").select("node", F.col("class").alias("was"), F.least("class", "other").alias("class"))
        jumped = nearer.join(labels.toDF("class", "further"), "class").select("node", "was", F.least("class", "further").alias("class"))
        fresh, _ = hold(jumped, count)
        labels = fresh.select("node", "class")
        if fresh.where("class <> was").isEmpty():
            return labels


def renamed(pairs: DataFrame, of: DataFrame) -> DataFrame:
    """Pairs with both ends replaced by their class."""
    for side in ("a", "b"):
        pairs = pairs.join(of.toDF(side, "_class"), side, "left").withColumn(side, F.coalesce("_class", side)).drop("_class")
    return pairs.select("a", "b").distinct()


def contracted(edges: DataFrame, n: int, members: DataFrame | None) -> tuple[DataFrame, int, DataFrame | None]:
    """(edges between classes, their number, members) once no two classes are linked both ways."""
    while True:
        back = edges.select(F.col("b").alias("a"), F.col("a").alias("b"))
        mutual, found = hold(edges.where("a < b").join(back, ["a", "b"], "left_semi"), n)
        if not found:
            return edges, n, members
        of = classes(mutual, found)
        if members is not None:
            older = members.join(of.toDF("class", "_class"), "class", "left").select("node", F.coalesce("_class", "class").alias("class"))
            of_nodes = of.join(members.select("node"), "node", "left_anti")
            members, _ = hold(older.unionByName(of_nodes))
        else:
            members = of
        edges, n = hold(renamed(edges, of), n)


def closure(edges: DataFrame) -> Closure:
    """edges: columns a and b of one type, without nulls."""
    edges, n = hold(edges.select("a", "b").distinct())
    edges, n, members = contracted(edges, n, None)
    loops, rounds = edges.where("a = b"), 0
    reach, n = hold(edges.where("a <> b"), n)
    power, known = reach, n  # reach: pairs of 1 to 2^k steps, power: those of 2^k
    while n:
        shift = power.select(F.col("a").alias("b"), F.col("b").alias("to"))
        wider, total = hold(reach.union(reach.join(shift, "b").select("a", F.col("to").alias("b"))).distinct(), 2 * known)
        rounds += 1
        if total == known:
            break
        ahead, more = hold(power.join(shift, "b").select("a", F.col("to").alias("b")).distinct(), 2 * known)
        reach, known, power = wider, total, ahead
        if not more:
            break
        if known > DENSE * n:
            closer, _, joint = contracted(reach, known, members)
            if joint is not members:
                members = joint
                loops = hold(renamed(loops.union(closer.where("a = b")), members))[0]
                reach, n = hold(closer.where("a <> b"))
                power, known = reach, n
    return finished(reach.union(loops).distinct(), members, rounds)


def finished(pairs: DataFrame, members: DataFrame | None, rounds: int) -> Closure:
    pairs, n = hold(pairs)
    if members is not None:
        sizes = members.groupBy("class").count()
        for side in ("a", "b"):
            pairs_of = pairs if side == "a" else counted
            counted = pairs_of.join(sizes.toDF(side, f"n_{side}"), side, "left")
        n = counted.agg(F.sum(F.coalesce("n_a", F.lit(1)) * F.coalesce("n_b", F.lit(1)))).first()[0] or 0
    return Closure(pairs, members, n, rounds)


def closure_by_hubs(left: DataFrame, right: DataFrame, kind: str, other: bool) -> Closure:
    """The closure of the edges a -> b with left (a, k) and right (k, b), of a <> b only if other.

    Nodes and hubs are classes of the graph a -> k -> b.  Leaving out edges from a node to itself changes
    only which nodes reach themselves: those in a cycle with another node.  kind: the SQL type of a and b.
    """
    node = lambda c: F.concat(F.lit("n"), F.col(c).cast("string")).alias(c)
    hub = lambda c: F.coalesce(F.concat(F.lit("k"), F.col("k").cast("string")), F.lit("h")).alias(c)
    edges, n = hold(left.select(node("a"), hub("b")).union(right.select(hub("a"), node("b"))).distinct())
    found = closure(edges)
    ends = edges.select("a").union(edges.select("b")).where("startswith(a, 'n')").distinct().toDF("node")
    of = ends.withColumn("class", F.col("node")) if found.members is None else ends.join(found.members, "node", "left").withColumn("class", F.coalesce("class", "node"))
    users, _ = hold(of.select(F.expr("substring(node, 2)").cast(kind).alias("node"), "class"), n)
    sizes = users.groupBy("class").count()
    pairs = found.pairs.join(sizes.toDF("a", "n_a"), "a").join(sizes.toDF("b", "n_b"), "b")
    if other:
        pairs, _ = hold(pairs.select("a", "b", "n_a", "n_b"))
        apart = pairs.where("a <> b")
        back = apart.select(F.col("b").alias("a"), F.col("a").alias("b"))
        twice = apart.join(back, ["a", "b"], "left_semi").select("a").distinct()
        same = pairs.where("a = b")
        pairs = apart.union(same.where("n_a > 1")).union(same.where("n_a = 1").join(twice, "a", "left_semi"))
    kept, _ = hold(pairs.select("a", "b", "n_a", "n_b"))
    return Closure(kept.select("a", "b"), users, kept.agg(F.sum(F.col("n_a") * F.col("n_b"))).first()[0] or 0, found.rounds, alone=False)


def generations(parents: DataFrame) -> Closure:
    """The pairs with a common ancestor the same number of steps up, for (a, b): b is the one parent of a.

    With one parent each this is an equivalence: nodes are one class where their parents are one, or one class
    in the round before; a node without a parent is alike to none.  Rounds are as many as the depth.
    """
    parents, n = hold(parents.select("a", "b").distinct())
    labels, classes_left, rounds = parents.select(F.col("a").alias("node"), F.col("a").alias("class")), n, 0
    while True:
        up = parents.join(labels.toDF("b", "class"), "b", "left").select("a", F.coalesce("class", "b").alias("up"))
        fresh = up.join(up.groupBy("up").agg(F.min("a").alias("class")), "up").select(F.col("a").alias("node"), "class")
        labels, _ = hold(fresh, n)
        found, rounds = labels.where("node = class").count(), rounds + 1
        if found == classes_left:
            break
        classes_left = found
    sizes, _ = hold(labels.groupBy("class").count(), classes_left)
    total = sizes.agg(F.sum(F.col("count") * F.col("count"))).first()[0] or 0
    return Closure(sizes.select(F.col("class").alias("a"), F.col("class").alias("b")), labels, total, rounds, alone=False)
