"""Removal of every byte covered by a string of `length` bytes that also starts anywhere else.

Method: a sparse form of suffix-array dedup.  Sorting all suffixes by external induction carries a tuple
of eight bytes and more per input byte through several passes, which exceeds four times the input on
disk and half a microsecond a byte; see the README.  Here only sampled suffixes are grouped, and the
windows between samples are induced from them:

1. Each window of `length` bytes is represented by its minimizer, the least of its GRAM-byte hashes, the
   leftmost on ties.  Equal windows have equal minimizers at equal offsets.  Neighbouring windows
   with one minimizer form a run; runs (about one per 85 bytes) carry hashes of minimizer and region.
2. Runs whose minimizer occurs once are unique.  Where all runs of a minimizer have equal regions, all
   their windows repeat.  Otherwise one copy of each distinct region is fetched, and its windows are
   compared in full with those of the minimizer's other regions.
3. Minimizers with more than GROUP distinct regions are split further, by the hash of each window.

Texts travel once, dealt by document; partial aggregates fold copies before they travel.

Defined cases: null is the empty text; shorter texts lose nothing; repeated rows are copies of each
other; null ids are kept.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, id_text, materialize, partitions, row_key

LENGTH, GRAM, GROUP = 200, 32, 2000
SEGMENT = 1 << 22
_PLACE = np.uint64((1 << 23) - 1)
_BYTES = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_STEP = 0x9E3779B97F4A7C15


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each GRAM-byte string of data, by doubling."""
    h, power, width = _BYTES[data], _STEP, 1
    while width < GRAM:
        h = h[:-width] * np.uint64(power) + h[width:]
        power, width = power * power % (1 << 64), 2 * width
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def runs(data: np.ndarray, starts: np.ndarray) -> tuple:
    """(first window, number of windows, minimizer hash) of each run; starts: where texts begin, and the end.

    data: concatenated texts, fewer than 2^23 bytes.
    """
    h = gram_hashes(data)
    least = (h & ~_PLACE) | np.arange(len(h), dtype=np.uint64)
    width, span = 1, LENGTH - GRAM + 1
    while 2 * width <= span:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    rest = span - width
    least = np.minimum(least[: len(least) - rest], least[rest:]) if rest else least
    at = (least & _PLACE).astype(np.int64)
    inside = np.zeros(len(at) + 1, np.int32)  # windows within one text
    sizes = np.diff(starts) - LENGTH + 1
    good = sizes > 0
    np.add.at(inside, starts[:-1][good], 1)
    np.add.at(inside, starts[:-1][good] + sizes[good], -1)
    inside = np.cumsum(inside[:-1]) > 0
    fresh = np.ones(len(at), bool)
    fresh[1:] = (at[1:] != at[:-1]) | ~inside[:-1]
    fresh[starts[:-1][good]] = True
    first = np.flatnonzero(fresh & inside)
    ends = np.flatnonzero(np.append(fresh[1:] | ~inside[1:], True) & inside) + 1
    return first, ends - first, h[at[first]]


def _runs(batches):
    def flush(held):
        data = np.frombuffer(b"".join(t for _, _, t in held), np.uint8)
        if len(data) < LENGTH:
            return None
        starts = np.cumsum([0, *(len(t) for _, _, t in held)])
        first, n, key = runs(data, starts)
        text = np.searchsorted(starts, first, "right") - 1
        whole, digest = data.tobytes(), xxhash.xxh3_64_intdigest
        region = np.fromiter((digest(whole[a : a + k + LENGTH - 1]) for a, k in zip(first.tolist(), n.tolist())), np.uint64, len(first))
        uid = np.array([u for u, _, _ in held], np.int64)[text]
        at = first - starts[text] + np.array([o for _, o, _ in held], np.int64)[text]
        return pa.RecordBatch.from_arrays([pa.array(uid), pa.array(at), pa.array(n.astype(np.int32)), pa.array(key.view(np.int64)), pa.array(region.view(np.int64))], ["uid", "at", "n", "key", "region"])

    for batch in (part for batch in batches for part in chunks(batch, 1, 1 << 20)):
        held, size = [], 0
        for u, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            for o in range(0, max(1, len(t) - LENGTH + 1), SEGMENT):  # windows of long texts are dealt over segments
                piece = t[o : o + SEGMENT + LENGTH - 1]
                if size + len(piece) > SEGMENT and held:
                    if (out := flush(held)) is not None:
                        yield out
                    held, size = [], 0
                held.append((u, o, piece))
                size += len(piece)
        if held and (out := flush(held)) is not None:
            yield out


def _regions(length):
    """Rows (key, region, copies, text of the region) from rows (uid, doc_id, text, wanted)."""

    def run(batches):
        for batch in (part for batch in batches for part in chunks(batch, 2)):
            out = []
            for text, wanted in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                out += [(w["key"], w["region"], w["copies"], text[w["at"] : w["at"] + w["n"] + length - 1]) for w in wanted]
            cols = list(zip(*out)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.binary()))], ["key", "region", "copies", "body"])

    return run


def spans_of(flags: list[bool]) -> list[tuple[int, int]]:
    """[from, to) of the true stretches."""
    edge = np.flatnonzero(np.diff(np.concatenate(([0], np.asarray(flags, np.int8), [0]))))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist()))


_SPANS = "key bigint, region bigint, spans array<struct<f:int,t:int>>"


def _span_batch(rows):
    kind = pa.list_(pa.struct([("f", pa.int32()), ("t", pa.int32())]))
    cols = [[r[0] for r in rows], [r[1] for r in rows], [[{"f": f, "t": t} for f, t in r[2]] for r in rows]]
    return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], kind)], ["key", "region", "spans"])


def _compare(batches):
    """Repeated windows of each region, from rows (key, region, copies, body) sorted by key."""

    def decide(group):
        count: Counter = Counter()
        for _, _, copies, body in group:
            for s in range(len(body) - LENGTH + 1):
                count[body[s : s + LENGTH]] += copies
        return _span_batch([(k, r, spans_of([count[body[s : s + LENGTH]] > 1 for s in range(len(body) - LENGTH + 1)])) for k, r, _, body in group])

    group: list = []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if group and row[0] != group[0][0]:
                yield decide(group)
                group = []
            group.append(row)
    if group:
        yield decide(group)


def _windows(batches):
    for batch in batches:
        for key, region, copies, body in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            marks = [xxhash.xxh3_128_digest(body[s : s + LENGTH]) for s in range(len(body) - LENGTH + 1)]
            n = len(marks)
            yield pa.RecordBatch.from_arrays([pa.array([key] * n, pa.int64()), pa.array([region] * n, pa.int64()), pa.array([copies] * n, pa.int64()), pa.array(range(n), pa.int32()), pa.array(marks, pa.binary())], ["key", "region", "copies", "s", "mark"])


def _remove(batches):
    for batch in (part for batch in batches for part in chunks(batch, 2)):
        cols = [[], [], [], [], []]
        for doc, text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            merged: list[list[int]] = []
            for x in sorted((s["f"], s["t"]) for s in spans or ()):
                if merged and x[0] <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], x[1])
                else:
                    merged.append(list(x))
            kept, at = [], 0
            for f, t in merged:
                kept.append(text[at:f])
                at = t
            kept.append(text[at:])
            body = b"".join(kept)
            for c, v in zip(cols, (doc, len(text), len(text) - len(body), len(merged), body)):
                c.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])


def suffix_dedup(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept) per document; kept is the remaining bytes."""
    spark = docs.sparkSession
    rows = id_text(docs).select(row_key().alias("uid"), "doc_id", F.col("text").cast("binary").alias("text"))
    texts = rows.repartition(partitions(spark), "uid")
    all_runs = materialize(rows.select("uid", "text").mapInArrow(_runs, "uid bigint, at bigint, n int, key bigint, region bigint"))
    keys = all_runs.groupBy("key").agg(F.count(F.lit(1)).alias("rows"), F.min("region").alias("lo"), F.max("region").alias("hi"))
    keys = materialize(keys.where("rows > 1").selectExpr("key", "lo <> hi AS mixed"))  # so that a hot key's join can be split
    met = materialize(all_runs.join(keys, "key"))

    kinds = met.where("mixed").groupBy("key", "region").agg(F.count(F.lit(1)).alias("copies"), F.min(F.struct("uid", "at", "n")).alias("one"))
    wanted = kinds.select("one.uid", F.struct("key", "region", "copies", "one.at", "one.n").alias("w")).groupBy("uid").agg(F.collect_list("w").alias("wanted"))
    found = texts.join(wanted.hint("shuffle_hash"), "uid").select("uid", "doc_id", "text", "wanted")
    bodies = materialize(found.mapInArrow(_regions(LENGTH), "key bigint, region bigint, copies bigint, body binary"))
    large = materialize(bodies.groupBy("key").count().where(F.col("count") > GROUP).select("key"))
    usual = bodies.join(large, "key", "left_anti").repartition(partitions(spark), "key").sortWithinPartitions("key").mapInArrow(_compare, _SPANS)
    marks = bodies.join(large, "key", "left_semi").mapInArrow(_windows, "key bigint, region bigint, copies bigint, s int, mark binary")
    again = marks.groupBy("key", "mark").agg(F.sum("copies").alias("c")).where("c > 1").select("key", "mark")
    split = marks.join(again, ["key", "mark"]).groupBy("key", "region").agg(F.collect_list(F.struct(F.col("s").alias("f"), (F.col("s") + 1).alias("t"))).alias("spans"))
    spans = usual.unionByName(split)

    part = met.where("mixed").join(spans, ["key", "region"]).select("uid", "at", F.explode("spans").alias("s"))
    part = part.select("uid", (F.col("at") + F.col("s.f")).alias("f"), (F.col("at") + F.col("s.t") + LENGTH - 1).alias("t"))
    full = met.where("NOT mixed").select("uid", F.col("at").alias("f"), (F.col("at") + F.col("n") + LENGTH - 1).alias("t"))
    flags = full.unionByName(part).groupBy("uid").agg(F.collect_list(F.struct("f", "t")).alias("spans"))
    return texts.join(flags.hint("shuffle_hash"), "uid", "left").select("uid", "doc_id", "text", "spans").mapInArrow(_remove, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary")


def op6_suffix_dedup(spark, sf_dir):
    found = suffix_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {"op6_suffix_dedup": op6_suffix_dedup}
SQL = {}
