"""Streaming forms: re-evaluation when data arrives, topics by prefix, a sliding-window rate limiter."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.fixpoint import Program
from ..sources.database import Database, from_frame


def reevaluate(stream: DataFrame, predicate: str, store: str, db: Database, program: Program, publish: Callable[[Database, int], None], failed: Callable[[Exception, int], None] | None = None):
    """A stream writer: each batch joins the relation kept at `store`, then the whole program runs again.

    A batch is stored under its own number, so a repeated batch replaces itself.  publish gets the
    derived database.  If evaluation fails, what was published stays; the stream goes on if `failed` is given, which
    gets the error, and stops otherwise.
    """

    def run(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{store}/batch={number}")
        held = batch.sparkSession.read.schema(batch.schema).parquet(f"{store}/batch=*").distinct()
        try:
            made = program.transform(db.extend({(predicate, len(batch.columns)): from_frame(held)}))
        except Exception as e:
            if failed is None:
                raise
            failed(e, number)
        else:
            publish(made, number)

    return stream.writeStream.foreachBatch(run)


def subscribed(stream: DataFrame, topic: str, prefix: str) -> DataFrame:
    """Events whose topic is the prefix or lies below it."""
    below = F.col(topic).startswith(prefix.rstrip("/") + "/")
    return stream.where((F.col(topic) == prefix) | below) if prefix else stream


def rate_limited(stream: DataFrame, key: str, seconds: str, most: int, window: float, idle: float | None = None) -> DataFrame:
    """(key, seconds, allowed): at most `most` events a key in any trailing window; denied ones do not count.

    Within a batch a key's events count in order of their time; with `idle`, what is known of a key
    goes after so many seconds without its events; the stream then has batches without data, too.
    """

    def decide(keys, frames: Iterator[pd.DataFrame], state):
        if state.hasTimedOut:
            state.remove()
            return
        recent = list(state.get[0]) if state.exists else []
        times = sorted(float(at) for frame in frames for at in frame[seconds])  # a key's whole batch, one number an event
        allowed = []
        for at in times:
            recent = [t for t in recent if t > at - window]
            allowed.append(len(recent) < most)
            if allowed[-1]:
                recent.append(at)
        state.update((recent,))
        if idle is not None:
            state.setTimeoutDuration(max(1, int(idle * 1000)))
        yield pd.DataFrame({"key": pd.Series([keys[0]] * len(times)), "seconds": times, "allowed": allowed})

    kind = stream.schema[key].dataType.simpleString()
    return stream.groupBy(key).applyInPandasWithState(decide, f"key {kind}, seconds double, allowed boolean", "recent array<double>", "append", "NoTimeout" if idle is None else "ProcessingTimeTimeout")
