"""Best-fit packing under several capacities.

Every bin has residual capacities of tokens, documents and attention cost (the sum of squared
lengths).  Items go in order of falling length; among the bins that can take an item under every
capacity, the one of the best score wins: the largest weighted dot product of item and residual
("dot"), or the smallest weighted norm of what would be left ("norm", best fit).

Items of one length are alike, so the search runs over a histogram of at most `tokens` lengths and
over classes of bins with equal residuals, not over items: its size does not grow with the corpus.
It yields runs (length, first rank, count, first bin, offset), and each item finds its bin by its rank
among items of its length.  Ranks come from blocks, so no length is gathered in one task.

Defined cases: null or empty text is the single id 0; repeated rows are packed each; null ids stay.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, dense_rank_blocks, id_text, materialize

END_ID = 0
BLOCK_ROWS = 200_000
RUNS_BOUND = 2_000_000


def _cut(tokens: int):
    def run(batches):
        from .pretokens import word_ids

        words = word_ids()
        for batch in batches:
            for part in chunks(batch, 1, 500_000, words=True):
                doc, number, start, length, crc = [], [], [], [], []
                split = [words.split(t) for t in part.column(1).to_pylist()]
                known = words.learn(set().union(*split))
                for d, s in zip(part.column(0).to_pylist(), split, strict=True):
                    ids = b"".join(map(known.__getitem__, s)) + b"\0\0\0\0"
                    for i, at in enumerate(range(0, len(ids), 4 * tokens)):
                        piece = ids[at : at + 4 * tokens]
                        doc.append(d), number.append(i), start.append(at // 4), length.append(len(piece) // 4), crc.append(zlib.crc32(piece))
                yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(number, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def pieces(docs: DataFrame, tokens: int = 2048) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): documents as ids and 0, longer ones cut."""
    cut = id_text(docs).mapInArrow(_cut(tokens), "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint")
    return materialize(cut)  # a few numbers per piece, so that texts are read once


def plan(counts: dict[int, int], tokens: int, documents: int | None = None, attention: int | None = None, rule: str = "norm", weights=(1.0, 1.0, 1.0)):
    """Runs (length, first rank, count, first bin, offset) that place counts[length] items of each length.

    A length longer than `tokens`, or whose square passes `attention`, gets no bin: ValueError.
    """
    whole = (tokens, documents or tokens, attention or tokens * tokens)
    scale = np.array(weights) / np.array(whole, float)
    classes: dict[tuple, list[list[int]]] = {}  # residuals -> runs of bins [first, count], offset is tokens - residual
    runs, bins = [], 0
    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        need = (length, 1, length * length)
        if any(n > c for n, c in zip(need, whole, strict=True)):
            raise ValueError(f"an item of {length} tokens fits no bin")
        fits = [r for r in classes if all(n <= c for n, c in zip(need, r, strict=True))]
        if fits:
            room = np.array(fits, float)
            score = -(room * scale) @ (np.array(need) * scale) if rule == "dot" else np.linalg.norm((room - need) * scale, axis=1)
            fits = [fits[i] for i in np.argsort(score, kind="stable")]
        queue = fits
        while left:
            if queue:
                residual = queue.pop(0)
                held = classes.pop(residual)
            else:
                per_bin = min(c // n for c, n in zip(whole, need, strict=True))
                residual, held = whole, [[bins, fresh := math.ceil(left / per_bin)]]
                bins += fresh
            while left and held:
                first, n = held.pop()
                take = min(n, left)
                if take < n:
                    held.append([first + take, n - take])
                runs.append((length, rank, take, first, tokens - residual[0]))
                rank, left = rank + take, left - take
                after = tuple(c - x for c, x in zip(residual, need, strict=True))
                classes.setdefault(after, []).append([first, take])
                if left and all(n <= c for n, c in zip(need, after, strict=True)) and after not in queue:
                    queue.insert(0, after)  # the same bins may take another of these
            if held:
                classes.setdefault(residual, []).extend(held)
    return runs, bins


def pack(items: DataFrame, tokens: int = 2048, **how) -> DataFrame:
    """items, whose `length` is at most tokens, with sequence_id and offset added (in the place of columns so called)."""
    rows = items.select(F.col("length").cast("bigint").alias("length"), F.struct(*[F.col(f"`{c}`") for c in items.columns]).alias("item"))
    counts = {r.length: r["count"] for r in rows.groupBy("length").count().collect()}  # at most `tokens` rows
    runs, _ = plan(counts, tokens, **how)
    by_length: dict[int, list] = {}
    for run in runs:
        by_length.setdefault(run[0], []).append(run)
    # A length's ranks are cut into about as many steps as it has runs, so that an item meets the few runs of its step.
    steps = {length: max(1, counts[length] // len(held)) for length, held in by_length.items()}
    table = [(length, at, rank, n, first, offset) for length, rank, n, first, offset in runs for at in range(rank // steps[length], (rank + n - 1) // steps[length] + 1)]
    met = items.sparkSession.createDataFrame(table, "length bigint, step bigint, first_rank bigint, n bigint, first bigint, offset bigint")
    met = F.broadcast(met) if len(table) <= RUNS_BOUND else met
    sizes = items.sparkSession.createDataFrame(list(steps.items()), "length bigint, width bigint")
    blocks = max(8, sum(counts.values()) // BLOCK_ROWS + 1)
    ranked = dense_rank_blocks(rows, "length", ["item"], "rank", blocks).join(F.broadcast(sizes), "length").withColumn("step", F.expr("rank div width"))
    found = ranked.join(met, ["length", "step"]).where("rank >= first_rank AND rank < first_rank + n")
    own = [c for c in items.columns if c.lower() not in ("sequence_id", "offset")]
    return found.select(*[F.col("item").getField(c).alias(c) for c in own], (F.col("first") + F.col("rank") - F.col("first_rank")).alias("sequence_id"), F.col("offset"))


def op5_packing(spark, sf_dir):
    return pack(pieces(spark.read.parquet(f"{sf_dir}/documents.parquet")))


QUERIES = {"op5_packing": op5_packing}
SQL = {}
