"""Exact dedup by content sort.

Normalised texts are range-partitioned by sampled splitters and sorted (spilling to disk), so equal
texts are adjacent; a window over full texts compares neighbours and finds each group's survivor.
The sort key is (first HEAD_CHARS characters, hash, text): the splitters sampled for the driver are
cut from the first two, so their size does not depend on text lengths, and a beginning that many
different texts share is still split.

Groups of at least a 1/HOT_SHARE share of all rows would sit on one splitter, so they are decided before
the sort: there are at most HOT_SHARE of them, a map-side aggregate shows that their hash stands for one text,
and (hash, survivor, size) are broadcast, a few bytes each whatever the texts' length.  A hash of
several texts is not hot; its rows are sorted.

Defined cases: a null text is the empty text; null ids never survive a non-null one (all null: all
kept); rows repeating the surviving id with the same text are one document and all stay.  Columns of docs
may have any names; one that is called as an added column is replaced by it (see `added`).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import absent, materialize, partitions

HOT_SHARE = 2000
HOT_LEAST = 32
HEAD_CHARS = 32


ADDED = ("keep_id", "group_size", "kept", "text_sha256")


def exact_dedup(docs: DataFrame, keep: str = "min", normalise: Column | None = None, added: tuple[str, ...] = ADDED) -> DataFrame:
    """All rows and columns of docs, with keep_id, group_size, kept and text_sha256 added.

    keep: "min" keeps the smallest doc_id of equal texts, "max" the largest.
    normalise: the Column that is compared, the text itself by default.
    added: the names of the four added columns.
    """
    best = {"min": F.min, "max": F.max}[keep]
    body = F.coalesce(F.col("text").cast("string"), F.lit("")) if normalise is None else normalise
    own = [c for c in docs.columns if c.lower() not in {a.lower() for a in added}]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in own] or [F.lit(0).alias("none")]).alias("row"), F.col("doc_id").alias("id"), body.alias("body"))
    rows = rows.withColumn("hash", F.xxhash64("body"))

    narrow = materialize(rows.select("id", "hash"))
    sizes = narrow.groupBy("hash").agg(best("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    hot = materialize(sizes.where(F.col("group_size") >= max(HOT_LEAST, narrow.count() // HOT_SHARE)))
    texts = rows.select("hash", "body").join(F.broadcast(hot.select("hash")), "hash", "left_semi").groupBy("hash", "body").agg(F.count(F.lit(1)).alias("n"))
    single = texts.groupBy("hash").agg(F.count(F.lit(1)).alias("texts")).where("texts = 1")
    hot = F.broadcast(materialize(hot.join(F.broadcast(single.select("hash")), "hash", "left_semi")))
    common = rows.join(hot, "hash")

    rare = rows.join(hot, "hash", "left_anti").withColumn("head", F.substring("body", 1, HEAD_CHARS))
    rare = rare.repartitionByRange(partitions(docs.sparkSession), "head", "hash")
    equal = Window.partitionBy("head", "hash", "body")
    rare = rare.withColumn("keep_id", best("id").over(equal)).withColumn("group_size", F.count(F.lit(1)).over(equal))
    values = F.col("keep_id"), F.col("group_size"), F.col("id").eqNullSafe(F.col("keep_id")), F.sha2(F.col("body").cast("binary"), 256)
    out = [*[F.col("row").getField(c).alias(c) for c in own], *[v.alias(a) for v, a in zip(values, added, strict=True)]]
    return rare.select(*out).unionByName(common.select(*out))


def survivors(docs: DataFrame, keep: str = "min") -> DataFrame:
    """docs, all columns as they are, with only the surviving rows of each group of equal texts."""
    added = tuple(absent(docs.columns, a) for a in ADDED)
    return exact_dedup(docs, keep, added=added).where(F.col(f"`{added[2]}`")).select(*[F.col(f"`{c}`") for c in docs.columns])


def op1_exact_dedup(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return exact_dedup(docs, keep="max").select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


QUERIES = {"op1_exact_dedup": op1_exact_dedup}
SQL = {
    "op1_exact_dedup": """
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, sha256(body) AS text_sha256
FROM (SELECT doc_id, body, max(doc_id) OVER (PARTITION BY body) AS keep_id, count(*) OVER (PARTITION BY body) AS group_size
      FROM (SELECT doc_id, coalesce(text, '') AS body FROM documents))"""
}
