"""Builders over tables: SELECT with joins, where, grouping, order and limits, INSERT with conflict rules, raw queries."""

from __future__ import annotations

from contextlib import contextmanager
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType
from pyspark.sql.window import Window


@contextmanager
def bound(spark: SparkSession, tables: dict[str, DataFrame]):
    """The names stand for the tables within; what they stood for before is put back."""
    views = {t.name.lower() for t in spark.catalog.listTables() if t.isTemporary}
    before = {n: spark.table(n) for n in tables if n.lower() in views}
    try:
        for name, df in tables.items():
            df.createOrReplaceTempView(name)
        yield
    finally:
        for name in tables:
            before[name].createOrReplaceTempView(name) if name in before else spark.catalog.dropTempView(name)


def statement(spark: SparkSession, sql: str, tables: dict[str, DataFrame], *args) -> DataFrame:
    """The rows of a raw query over tables that are bound for it alone."""
    with bound(spark, tables):
        return spark.sql(sql, args=list(args)) if args else spark.sql(sql)


@dataclass(frozen=True)
class Insert:
    """Rows to add to a table; a frame is never changed, so `frame` gives the table as it is afterwards."""

    table: str
    columns: tuple[str, ...]
    rows: tuple[tuple, ...] = ()
    keys: tuple[str, ...] = ()
    update: tuple[str, ...] = ()

    def values(self, *row) -> Insert:
        """One more row, of as many values as columns."""
        if len(row) != len(self.columns):
            raise ValueError(f"{len(row)} values for {len(self.columns)} columns")
        return replace(self, rows=(*self.rows, row))

    def on_conflict(self, *keys: str, update: tuple[str, ...] = ()) -> Insert:
        """A row whose keys are in the table, or in an earlier row, is left out, or sets the given columns there."""
        return replace(self, keys=keys, update=update)

    def added(self, spark: SparkSession, tables: dict[str, DataFrame]) -> DataFrame:
        """The new rows in the table's columns, others null."""
        have = tables[self.table]
        new = spark.createDataFrame([(*r, n) for n, r in enumerate(self.rows)], StructType([*[have.schema[c] for c in self.columns], StructField("_turn", LongType())]))
        return new.select(*[F.col(c) if c in self.columns else F.lit(None).cast(have.schema[c].dataType).alias(c) for c in have.columns], "_turn")

    def frame(self, spark: SparkSession, tables: dict[str, DataFrame]) -> DataFrame:
        have, new = tables[self.table], self.added(spark, tables)
        if not self.keys:
            return have.unionByName(new.drop("_turn"))
        if any(c not in self.columns for c in self.keys):
            raise ValueError("a key of the conflict rule is not among the columns")
        first = Window.partitionBy(*self.keys).orderBy("_turn")
        last = first.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        rest = [F.last(c).over(last).alias(c) if c in self.update else F.first(c).over(last).alias(c) for c in have.columns if c not in self.keys]
        one = new.withColumn("_n", F.row_number().over(first)).select(*self.keys, *rest, "_n").where("_n = 1").drop("_n")
        one = one.select(*[F.col(c).alias(f"new_{c}") for c in have.columns])
        met = [have[k] == one[f"new_{k}"] for k in self.keys]
        kept = have.join(F.broadcast(one), met, "left").select(*[F.when(F.col(f"new_{self.keys[0]}").isNotNull(), F.col(f"new_{c}")).otherwise(have[c]).alias(c) if c in self.update else have[c] for c in have.columns])
        return kept.unionByName(one.join(have, met, "left_anti").toDF(*have.columns))

    def returning(self, spark: SparkSession, tables: dict[str, DataFrame], *columns: str) -> DataFrame:
        """Columns of the rows that are added or, by the conflict rule, changed."""
        after = self.frame(spark, tables)
        if not self.keys:
            return self.added(spark, tables).select(*columns)
        new = self.added(spark, tables).select(*self.keys).distinct()
        if not self.update:
            new = new.join(tables[self.table], list(self.keys), "left_anti")
        return after.join(F.broadcast(new), list(self.keys), "left_semi").select(*columns)


def insert(table: str, *columns: str) -> Insert:
    return Insert(table, columns)


@dataclass(frozen=True)
class Select:
    """Clauses of one kind are and-ed; every method returns a new builder."""

    table: str
    columns: tuple[str, ...] = ("*",)
    joins: tuple[str, ...] = ()
    wheres: tuple[str, ...] = ()
    groups: tuple[str, ...] = ()
    havings: tuple[str, ...] = ()
    orders: tuple[str, ...] = ()
    most: int | None = None
    skip: int | None = None
    args: tuple = ()

    def _on(self, how: str, table: str, on: tuple[str, ...]) -> Select:
        return replace(self, joins=(*self.joins, f"{how} {table} ON {' AND '.join(f'({c})' for c in on)}"))

    def join(self, table: str, *on: str) -> Select:
        return self._on("JOIN", table, on)

    def left_join(self, table: str, *on: str) -> Select:
        return self._on("LEFT JOIN", table, on)

    def where(self, clause: str, *args) -> Select:
        return replace(self, wheres=(*self.wheres, clause), args=(*self.args, *args))

    def group_by(self, *columns: str) -> Select:
        return replace(self, groups=(*self.groups, *columns))

    def having(self, clause: str) -> Select:
        return replace(self, havings=(*self.havings, clause))

    def order_by(self, *columns: str) -> Select:
        return replace(self, orders=(*self.orders, *columns))

    def limit(self, n: int) -> Select:
        return replace(self, most=n)

    def offset(self, n: int) -> Select:
        return replace(self, skip=n)

    def sql(self) -> str:
        both = lambda word, clauses: f" {word} " + " AND ".join(f"({c})" for c in clauses) if clauses else ""
        text = f"SELECT {', '.join(self.columns)} FROM {self.table}" + "".join(f" {j}" for j in self.joins) + both("WHERE", self.wheres)
        text += f" GROUP BY {', '.join(self.groups)}" * bool(self.groups) + both("HAVING", self.havings)
        text += f" ORDER BY {', '.join(self.orders)}" * bool(self.orders)
        return text + (f" LIMIT {self.most}" if self.most is not None else "") + (f" OFFSET {self.skip}" if self.skip is not None else "")

    def frame(self, spark: SparkSession, tables: dict[str, DataFrame]) -> DataFrame:
        """The rows; tables are bound for this statement only."""
        with bound(spark, tables):
            return spark.sql(self.sql(), args=list(self.args)) if self.args else spark.sql(self.sql())

    def first(self, spark, tables):
        return self.frame(spark, tables).first()

    def rows(self, spark, tables):
        return self.frame(spark, tables).toLocalIterator()


def select(table: str, *columns: str) -> Select:
    return Select(table, columns or ("*",))
