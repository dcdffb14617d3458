"""Shared pieces: reading documents, cutting lineage, connected components, ranks without a single task."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import sys
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_text(docs: DataFrame) -> DataFrame:
    """Only (doc_id bigint, text string); a null text counts as empty, other columns cannot clash."""
    return docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )


def row_key() -> Column:
    """64-bit key of a row; rows that repeat both id and text share it and share every decision."""
    return F.xxhash64(F.col("doc_id"), F.col("text"))


def absent(columns: list[str], name: str) -> str:
    """The name, with underscores before it until no column of the table is called so (letter case aside)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def without(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """docs, all columns as they are, without the rows of `keys` (doc_id, uid), uid being row_key()."""
    key, own = absent(docs.columns, "uid"), absent(docs.columns, "own_id")
    body = F.coalesce(F.col("text").cast("string"), F.lit(""))
    marked = docs.withColumn(own, F.col("doc_id").cast("bigint")).withColumn(key, F.xxhash64(own, body))
    gone = checked(materialize(keys.select(F.col("doc_id").alias("gone_id"), F.col("uid").alias("gone_uid"))))
    on = (marked[key] == gone["gone_uid"]) & marked[own].eqNullSafe(gone["gone_id"])
    return marked.join(gone, on, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


@functools.cache
def _own_dir() -> str:
    return "file://" + tempfile.mkdtemp(prefix="hornlake-")


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; a temporary one only where that is unset and Spark runs on this machine alone."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return (named or _own_dir()).rstrip("/")


BATCH_LIMIT, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 1_900_000


@contextlib.contextmanager
def small_batches(spark: SparkSession):
    """Meanwhile Python workers get record batches of about BATCH_BYTES, unless the session has a limit of its own.

    Spark's 64 MB stand in buffers of an executor and again in each worker, as texts and as Python's objects.
    """
    own = spark.conf.get(BATCH_LIMIT, None) is not None
    if not own:
        spark.conf.set(BATCH_LIMIT, str(BATCH_BYTES))
    try:
        yield
    finally:
        if not own:
            spark.conf.unset(BATCH_LIMIT)


def materialize(df: DataFrame) -> DataFrame:
    """Write to the shared folder and read back: lineage ends there and survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{uuid.uuid4().hex}"
    with small_batches(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Delete the files behind a materialized frame that nothing reads any more."""
    jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
    for parent in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(parent)
        path.getFileSystem(conf).delete(path, True)


BROADCAST_IDS = 2_000_000


def checked(ids: DataFrame) -> DataFrame:
    """Materialized 64-bit ids, to be broadcast if there are at most BROADCAST_IDS, else to be shuffled."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


def components(edges: DataFrame) -> DataFrame:
    """(id, component): the smallest id reachable over undirected edges (a, b), for ids on some edge.

    Minimum labels spread over edges, then each label jumps to its own label's label, so the number
    of rounds follows the logarithm of the diameter.  All work is joins and partial aggregates.
    """
    both = edges.select(F.col("a").alias("src"), F.col("b").alias("dst"))
    both = materialize(both.union(both.select("dst", "src")).where("src <> dst").distinct())
    labels = materialize(both.groupBy("src").agg(F.min("dst").alias("m")).select(F.col("src").alias("id"), F.least("src", "m").alias("component")))
    while True:
        near = both.join(labels.select(F.col("id").alias("dst"), "component"), "dst").groupBy("src").agg(F.min("component").alias("near"))
        spread = labels.join(near, labels.id == near.src).select("id", F.col("component").alias("was"), F.least("component", "near").alias("component"))
        jump = labels.select(F.col("id").alias("component"), F.col("component").alias("further"))
        fresh = materialize(spread.join(jump, "component").select("id", "was", F.least("component", "further").alias("component")))
        moved = fresh.where("component <> was").limit(1).count()
        forget(labels)
        labels = fresh.select("id", "component")
        if not moved:
            return labels


def dense_rank_blocks(df: DataFrame, group: str, order: list[str], out: str, blocks: int) -> DataFrame:
    """Gapless 0-based positions of rows within `group` without one task per group.

    Rows fall into blocks by a hash of the order columns; a block's rows are numbered by a window and
    shifted by the sizes of the group's earlier blocks (a table of groups x blocks rows).
    """
    cut = df.withColumn("_block", F.pmod(F.xxhash64(*order), F.lit(blocks)).cast("int"))
    before = Window.partitionBy(group).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    sizes = cut.groupBy(group, "_block").agg(F.count(F.lit(1)).alias("_n"))
    starts = sizes.select(group, "_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inner = Window.partitionBy(group, "_block").orderBy(*order)
    ranked = cut.withColumn("_at", F.row_number().over(inner) - 1)
    return ranked.join(starts, [group, "_block"]).withColumn(out, F.col("_start") + F.col("_at")).drop("_block", "_at", "_start")


def chunks(batch, text: int, most: int = 2_000_000, words: bool = False):
    """The record batch in slices of about `most` bytes of text, at least a row each.

    words: the caller uses the worker's cache of words; for all others it goes, as a worker outlives its operator.
    """
    import pyarrow.compute as pc

    if not words and (pretokens := sys.modules.get(f"{__package__}.pretokens")):
        pretokens.word_ids.cache_clear()
    start = held = 0
    for i, n in enumerate(pc.binary_length(batch.column(text)).to_pylist()):
        if held and held + n > most:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if start < batch.num_rows:
        yield batch.slice(start)
    give_back()


def give_back() -> None:
    """Return memory that a worker's allocators hold without need: executors share a limit with them."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # where the C library has no malloc_trim
        ctypes.CDLL(None).malloc_trim(0)
