"""Sharding by jump consistent hashing (Lamping and Veach): no ring table, and one shard more takes
only its own fraction of the keys.

The jump recurrence is the published one.  Its pseudo-random stream is xxHash64 of the previous state
instead of a wrapping multiplication, which ANSI arithmetic forbids; monotonicity needs only that the
stream depends on the key alone.  At most `shards` jumps happen; for more than STEPS shards the
chance that a key needs more than STEPS of them is below 1e-25, and the query fails if one does.

Defined cases: a null id is a key of its own, a null text has no bytes, repeated rows land together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import dense_rank_blocks, id_text, materialize

STEPS = 128
BLOCK_ROWS = 200_000


def jump_shard(key: Column, shards: int) -> Column:
    """The shard of a 64-bit key among `shards`."""
    state = lambda k, b, j: F.struct(k.alias("k"), b.alias("b"), j.alias("j"))
    first = state(F.xxhash64(key), F.lit(-1).cast("bigint"), F.lit(0).cast("bigint"))

    def step(s, _):
        draw = (F.shiftrightunsigned(s["k"], 33) + 1).cast("double") / F.lit(float(1 << 31))
        ahead = F.floor((s["j"] + 1).cast("double") / draw).cast("bigint")
        return F.when(s["j"] < shards, state(F.xxhash64(s["k"]), s["j"], ahead)).otherwise(s)

    return F.aggregate(F.sequence(F.lit(1), F.lit(min(shards, STEPS))), first, step, lambda s: F.when(s["j"] >= shards, s["b"].cast("int")).otherwise(F.raise_error(F.lit("a key needs more jumps than STEPS")).cast("int")))


def shard(docs: DataFrame, shards: int, overhead: int = 16) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) per document; texts are not shuffled."""
    rows = id_text(docs).select("doc_id", (F.octet_length("text") + overhead).cast("bigint").alias("size"), F.crc32(F.col("text").cast("binary")).alias("text_crc32"))
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    rows = rows.withColumn("shard", jump_shard(F.xxhash64(key), shards)).withColumn("grown_shard", jump_shard(F.xxhash64(key), shards + 1))
    rows = materialize(rows)  # a few numbers per document, so that texts are read once
    blocks = max(8, rows.count() // (shards * BLOCK_ROWS) + 1)
    ranked = dense_rank_blocks(rows, "shard", ["doc_id", "size", "text_crc32"], "slot", blocks)
    return ranked.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", F.col("slot").cast("bigint").alias("slot"), "grown_shard")


def op2_sharding(spark, sf_dir):
    return shard(spark.read.parquet(f"{sf_dir}/documents.parquet"), 40)


QUERIES = {"op2_sharding": op2_sharding}
SQL = {}
