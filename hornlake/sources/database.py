"""Relations by (predicate, arity): sets of tuples in columns c0, c1, ... with a kind each."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.values import literal, native, to_json

SQL_TYPES = {"integer": "bigint", "float": "double", "string": "string", "bool": "boolean", "id": "bigint", "json": "string"}


@dataclass
class Relation:
    df: DataFrame
    kinds: list[str]

    def aligned(self, kinds: list[str]) -> DataFrame:
        """The rows with positions encoded as the given kinds (equal ones, float for integer, or json)."""
        out = []
        for i, (have, want) in enumerate(zip(self.kinds, kinds, strict=True)):
            c = F.col(f"c{i}")
            out.append((c if have == want else c.cast("double") if want == "float" else to_json(c, have)).alias(f"c{i}"))
        return self.df.select(*out)


def canonical(value) -> str:
    """Canonical JSON text: sorted keys, whole floats as integers, non-finite numbers refused."""
    def plain(v):
        if isinstance(v, float) and v.is_integer() and -(2.0**63) <= v < 2.0**63:
            return int(v)
        if isinstance(v, dict):
            return {str(k): plain(x) for k, x in v.items()}
        return [plain(x) for x in v] if isinstance(v, list | tuple) else v

    return json.dumps(plain(value), sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def joint_kinds(many: list[list[str]]) -> list[str]:
    return [k.pop() if len(k := set(ks)) == 1 else "json" for ks in zip(*many)]


def union(parts: list[Relation]) -> Relation:
    """All rows, duplicates kept; positions of several kinds become json."""
    kinds = joint_kinds([p.kinds for p in parts])
    df = parts[0].aligned(kinds)
    for p in parts[1:]:
        df = df.unionByName(p.aligned(kinds))
    return Relation(df, kinds)


def from_frame(df: DataFrame, json_columns: tuple[str, ...] = ()) -> Relation:
    """A DataFrame's columns in order as a relation; its rows are trusted to be distinct."""
    values = [native(F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields]
    kinds = ["json" if f.name in json_columns else k for f, (_, k) in zip(df.schema.fields, values, strict=True)]
    return Relation(df.select(*[c.alias(f"c{i}") for i, (c, _) in enumerate(values)]), kinds)


def from_tuples(spark: SparkSession, rows: list[tuple]) -> Relation:
    """Constant tuples; a column of several kinds, of lists, dicts or None is json."""
    def kind(v):
        if isinstance(v, float) and v.is_integer() and abs(v) < 2**63:
            return "integer"
        return "json" if v is None or isinstance(v, list | dict) else literal(v)[1]

    kinds = joint_kinds([[kind(v) for v in r] for r in rows])
    encode = lambda v, k: canonical(v) if k == "json" else int(v) if k == "integer" else v
    data = list(dict.fromkeys(tuple(encode(v, k) for v, k in zip(r, kinds, strict=True)) for r in rows))
    schema = ", ".join(f"c{i} {SQL_TYPES[k]}" for i, k in enumerate(kinds))
    return Relation(spark.createDataFrame(data, schema), kinds)


class Database:
    """An immutable mapping of (predicate, arity) to relations."""

    def __init__(self, spark: SparkSession, relations: dict[tuple[str, int], Relation] | None = None):
        self.spark, self.relations = spark, dict(relations or {})

    def extend(self, added: dict[tuple[str, int], Relation]) -> Database:
        """A copy with more rows; a relation that is there already becomes the set union."""
        merged = dict(self.relations)
        for key, rel in added.items():
            if key in merged:
                both = union([merged[key], rel])
                rel = Relation(both.df.distinct(), both.kinds)
            merged[key] = rel
        return Database(self.spark, merged)

    @classmethod
    def tables(cls, spark: SparkSession, sf_dir: str, json_columns: dict[str, tuple[str, ...]] | None = None, names=()) -> Database:
        """Parquet tables, every column in file order."""
        return cls(spark, {(n, len(d.columns)): from_frame(d, (json_columns or {}).get(n, ())) for n in names for d in [spark.read.parquet(f"{sf_dir}/{n}.parquet")]})

    def predicates(self) -> list[tuple[str, int]]:
        return [k for k, r in self.relations.items() if not r.df.isEmpty()]

    def facts(self, name: str, arity: int) -> DataFrame:
        rel = self.relations.get((name, arity))
        return rel.df if rel else self.spark.createDataFrame([], ", ".join(f"c{i} string" for i in range(arity)) or "c string")

    def count(self, name: str, arity: int) -> int:
        return self.facts(name, arity).count()

    def counts(self) -> dict[tuple[str, int], int]:
        return {k: r.df.count() for k, r in self.relations.items()}

    def query(self, name: str, *terms) -> DataFrame:
        """Rows whose positions equal the given constants; None is a wildcard."""
        rel = self.relations.get((name, len(terms)))
        if rel is None:
            return self.facts(name, len(terms))
        df = rel.df
        for i, t in enumerate(terms):
            if t is not None:
                c, k = literal(t)
                df = df.where(F.col(f"c{i}") == (to_json(c, k) if rel.kinds[i] == "json" else c) if rel.kinds[i] in (k, "json") else F.lit(False))
        return df
