"""JSON lines in and out: records, mappings to facts, pattern files, the encoder."""

from __future__ import annotations

import io
import itertools
import json
import zipfile

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.values import to_json
from ..operators import matchers
from .config import KINDS, check
from .database import Database, Relation, union
from .mapping import compile_expression, run_program, truth

LONGEST = 10 << 20


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """(value) the lines of a text file, gzip by suffix; `archive.zip/member` reads a member of an archive.

    An archive has no index by line, so one task streams a member; unpack large ones first.
    """
    archive, mark, member = path.partition(".zip/")
    if not mark:
        return spark.read.text(path)

    def unpack(batches):
        for batch in batches:
            for body in batch.column(0).to_pylist():
                with zipfile.ZipFile(io.BytesIO(body)) as z, z.open(member) as f:
                    text = io.TextIOWrapper(f, "utf-8", newline="\n")
                    while part := list(itertools.islice(text, 4096)):
                        yield pa.RecordBatch.from_arrays([pa.array([x.rstrip("\r\n") for x in part], pa.string())], ["value"])

    return spark.read.format("binaryFile").load(f"{archive}.zip").select("content").mapInArrow(unpack, "value string")


def records(spark: SparkSession, path: str) -> DataFrame:
    """(record variant) for each line; byte-order marks and blank lines skipped.

    A line that is not one JSON object, or is longer than LONGEST bytes, fails the query.
    """
    lines = text_lines(spark, path).select(F.regexp_replace("value", "^﻿", "").alias("line")).where(F.trim("line") != "")
    parsed = F.try_parse_json("line")
    blank = F.trim("line") == ""  # filters may be tested together, in any order
    bad = ~blank & (parsed.isNull() | (F.substring(F.ltrim(F.col("line")), 1, 1) != "{") | (F.octet_length("line") > LONGEST))
    error = F.raise_error(F.concat(F.lit("not a JSON object, or too long: "), F.substring("line", 1, 200)))
    return lines.select(F.when(bad, error.cast("string")).otherwise(F.col("line")).alias("line")).select(F.try_parse_json("line").alias("record"))


def browse(spark: SparkSession, path: str, offset: int = 0, limit: int = 20, contains: str = "") -> DataFrame:
    """(value) raw lines that hold a text, from an offset on, each cut after 4 KiB of characters."""
    lines = text_lines(spark, path)
    kept = lines.where(F.lower("value").contains(contains.lower())) if contains else lines
    return kept.offset(offset).limit(limit).select(F.substring("value", 1, 4096).alias("value"))


def rejected(rows: DataFrame, keep: str) -> DataFrame:
    """(record) records whose filter is neither true nor false, which a mapping drops."""
    column, kind = compile_expression(keep, F.col("record"))
    sane = F.lit(True) if kind == "bool" else F.coalesce(column.isin("true", "false"), F.lit(False)) if kind == "json" else F.lit(False)
    return rows.where(~sane).select(F.to_json("record").alias("record"))


def probe(spark: SparkSession, program: str, record: dict) -> dict[str, list[tuple]]:
    """What an imperative program asserts over one record, by predicate."""
    rows = spark.createDataFrame([(json.dumps(record),)], "line string").select(F.try_parse_json("line").alias("record"))
    found: dict[str, list[tuple]] = {}
    for (name, _), rels in run_program(program, rows).items():
        found.setdefault(name, []).extend(tuple(r) for rel in rels for r in rel.df.collect())
    return found


def mapped(rows: DataFrame, args: list[str], keep: str | None = None) -> Relation:
    """Distinct facts of the records that pass `keep`."""
    if keep:
        rows = rows.where(truth(*compile_expression(keep, F.col("record"))))
    values = [compile_expression(a, F.col("record")) for a in args]
    return Relation(rows.select(*[c.alias(f"c{i}") for i, (c, _) in enumerate(values)]).distinct(), [k for _, k in values])


def strings(rel: Relation, position: int) -> DataFrame:
    """(c0) the strings of a position."""
    c = F.col(f"c{position}")
    if rel.kinds[position] == "json":
        c = F.when(c.startswith('"'), F.get(F.from_json(F.concat(F.lit("["), c, F.lit("]")), "array<string>"), F.lit(0)))
    elif rel.kinds[position] != "string":
        c = F.lit(None).cast("string")
    return rel.df.select(c.alias("c0"))


def load(spark: SparkSession, config: dict, base: str = "") -> Database:
    """A database from {"sources": [{"file", "mappings": [{"predicate", "args", "filter"} or {"expr"}]}],
    "matchers": [{"predicate", "term", "case_insensitive", "windash", "contains": [...], ...}],
    "declarations": [...]}, as config.read_config gives it.

    Matchers read loaded facts only, of the predicate at any arity that has the term.
    """
    check(config)
    found: dict[tuple[str, int], list[Relation]] = {}
    programs = [m["expr"] for s in config.get("sources", ()) for m in s["mappings"] if m.get("expr")]
    ids, n_ids = itertools.count(), max(1, sum(p.count("fresh_id") for p in programs))
    for source in config.get("sources", ()):
        rows = records(spark, base + source["file"])
        for m in source["mappings"]:
            if m.get("expr"):
                for key, rels in run_program(m["expr"], rows, ids, n_ids).items():
                    found.setdefault(key, []).extend(rels)
            else:
                found.setdefault((m["predicate"], len(m["args"])), []).append(mapped(rows, m["args"], m.get("filter")))
    relations = {k: merged(v) for k, v in found.items()}
    added: dict[tuple[str, int], list[Relation]] = {}
    for m in config.get("matchers", ()):
        how = {k: m.get(k, False) for k in ("case_insensitive", "windash")}
        for kind in KINDS:
            for (name, arity), rel in relations.items() if m.get(kind) else ():
                if name == m["predicate"] and m["term"] < arity:
                    hits = matchers.match(strings(rel, m["term"]), "c0", kind, m[kind], **how)
                    added.setdefault((matchers.produced(kind, **how), 2), []).append(Relation(hits, ["string", "string"]))
    return Database(spark, relations | {k: merged(v) for k, v in added.items()})


def merged(rels: list[Relation]) -> Relation:
    """The set union; relations of one part are sets already.  A union is never broadcast: its parts' sizes may be far off."""
    whole = union(rels)
    return rels[0] if len(rels) == 1 else Relation(whole.df.distinct().hint("merge"), whole.kinds)


def encode(rel: Relation, predicate: str, names: list[str] | None = None) -> DataFrame:
    """(value string): one {"predicate": {"name": value}} line per fact; positions name undeclared terms."""
    names = names or [str(i) for i in range(len(rel.kinds))]
    if len(set(names)) != len(names):
        raise ValueError(f"{predicate} has a term name twice")
    quoted = lambda s: to_json(F.lit(s), "string")
    number = lambda c: F.regexp_replace(c, "^#", "")  # an id is written as its number
    fields = [F.concat(quoted(n), F.lit(":"), number(to_json(F.col(f"c{i}"), k))) for i, (n, k) in enumerate(zip(names, rel.kinds, strict=True))]
    return rel.df.select(F.concat(F.lit("{"), quoted(predicate), F.lit(":{"), F.concat_ws(",", *fields), F.lit("}}")).alias("value"))
