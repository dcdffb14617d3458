"""Intermediate results: small ones in memory, all others in the folder that all executors share."""

from __future__ import annotations

import functools
import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

SMALL_ROWS = 20_000


@functools.cache
def _own_dir() -> str:
    return "file://" + tempfile.mkdtemp(prefix="hornlake-")


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a temporary one only where that is unset and Spark runs on this machine alone."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return (named or _own_dir()).rstrip("/")


def materialize(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it back."""
    path = f"{shared_dir(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Delete the files behind a materialized frame that nothing reads any more."""
    jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
    for parent in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(parent)
        path.getFileSystem(conf).delete(path, True)


def hold(df: DataFrame, expected: int | None = None) -> tuple[DataFrame, int]:
    """(the rows, cut off from their plan; their number), after one job.

    Rows are kept in memory where there are at most SMALL_ROWS.  expected: a guess of their number; well
    beyond the bound they are written at once.
    """
    if expected is None or expected <= SMALL_ROWS:
        few = df.limit(SMALL_ROWS + 1).toArrow()
        if few.num_rows <= SMALL_ROWS:
            return df.sparkSession.createDataFrame(few, df.schema) if few.num_rows else df.sparkSession.createDataFrame([], df.schema), few.num_rows
    seen = Observation()
    kept = materialize(df.observe(seen, F.count(F.lit(1)).alias("n")))
    return kept, seen.get["n"]
