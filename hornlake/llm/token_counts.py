"""Token counts without ids: pieces are counted once per distinct pre-token and joined to each
document's pre-token frequencies.

1. Pre-tokens are counted per task and summed: a table of distinct pre-tokens, frequencies and pieces.
2. The most frequent ones, at most HEAD_WORDS of at most HEAD_CHARS characters and LONG_WORDS of up to
   LONG_CHARS, are broadcast: those of a frequency of 2^p and more for the least p that keeps the bound.
3. One pass over the texts sums the head's pieces in place and emits (document, pre-token, frequency)
   only for the rest, which joins the table by shuffle and is summed per document.

Any text goes this way, whatever its script (see pretokens).
Defined cases: null or empty text has no tokens; null ids are kept; repeated rows are all returned.
"""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, id_text, materialize, row_key

HEAD_WORDS, HEAD_CHARS = 1 << 17, 24
LONG_WORDS, LONG_CHARS = 1 << 12, 500
FLUSH_WORDS = 200_000


def _frequencies(batches):
    from .pretokens import word_ids

    words, counts = word_ids(), Counter()
    out = lambda c: pa.RecordBatch.from_arrays([pa.array(list(c), pa.string()), pa.array(list(c.values()), pa.int64())], ["word", "n"])
    for batch in batches:
        for part in chunks(batch, 0, words=True):
            for text in part.column(0).to_pylist():
                counts.update(words.split(text))
            if len(counts) > FLUSH_WORDS:
                yield out(counts)
                counts = Counter()
    yield out(counts)


def _pieces(batches):
    from .pretokens import word_ids

    words = word_ids()
    for batch in batches:
        distinct = batch.column(0).to_pylist()
        known = words.learn(set(distinct))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([len(known[w]) // 4 for w in distinct], pa.int64())], ["word", "n", "pieces"])


def _counter(head_of):
    def run(batches):
        from .pretokens import word_ids

        words, head = word_ids(), head_of.value
        get = head.get
        for part in (part for batch in batches for part in chunks(batch, 2, words=True)):
            uid, doc, size, base, tail, freq = [], [], [], [], [], []
            for u, d, text in zip(*(part.column(i).to_pylist() for i in range(3)), strict=True):
                total, rest = 0, {}
                for w, n in Counter(words.split(text)).items():
                    if (k := get(w)) is None:
                        rest[w] = n
                    else:
                        total += k * n
                uid.append(u), doc.append(d), size.append(len(text.encode())), base.append(total), tail.append(list(rest)), freq.append(list(rest.values()))
            yield pa.RecordBatch.from_arrays([pa.array(uid, pa.int64()), pa.array(doc, pa.int64()), pa.array(size, pa.int64()), pa.array(base, pa.int64()), pa.array(tail, pa.list_(pa.string())), pa.array(freq, pa.list_(pa.int64()))], ["uid", "doc_id", "n_bytes", "base", "words", "ns"])

    return run


def frequent(pieces: DataFrame, above: int, upto: int, most: int) -> dict[str, int]:
    """Pieces of at most `most` words of more than `above` and at most `upto` characters: those of a frequency of 2^p for the least p that allows it."""
    ranked = pieces.where(F.length("word").between(above + 1, upto)).withColumn("power", F.floor(F.log2("n")))
    least, held = 63, 0
    for r in sorted(ranked.groupBy("power").count().collect(), reverse=True):  # at most 64 rows
        held += r["count"]
        if held > most:
            break
        least = r.power
    return {r.word: r.pieces for r in ranked.where(F.col("power") >= least).select("word", "pieces").collect()}


def token_counts(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_tokens) per document."""
    spark = docs.sparkSession
    rows = id_text(docs).withColumn("uid", row_key())
    summed = rows.select("text").mapInArrow(_frequencies, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    pieces = materialize(summed.mapInArrow(_pieces, "word string, n bigint, pieces bigint"))
    head = spark.sparkContext.broadcast(frequent(pieces, 0, HEAD_CHARS, HEAD_WORDS) | frequent(pieces, HEAD_CHARS, LONG_CHARS, LONG_WORDS))
    schema = "uid bigint, doc_id bigint, n_bytes bigint, base bigint, words array<string>, ns array<bigint>"
    counted = rows.select("uid", "doc_id", "text").mapInArrow(_counter(head), schema)
    # One row for the document itself (its word is unique to it and joins nothing), one per other pre-token.
    own = F.struct(F.concat(F.lit("\n"), F.col("uid").cast("string")).alias("word"), F.lit(0).cast("bigint").alias("n"), F.col("base"), F.lit(1).alias("copies"))
    others = F.transform(F.arrays_zip("words", "ns"), lambda x: F.struct(x["words"].alias("word"), x["ns"].alias("n"), F.lit(0).cast("bigint").alias("base"), F.lit(0).alias("copies")))
    parts = counted.select("uid", "doc_id", "n_bytes", F.inline(F.concat(F.array(own), others)))
    joined = parts.join(pieces.select("word", "pieces"), "word", "left")
    total = F.sum(F.col("base") + F.col("n") * F.coalesce("pieces", F.lit(0)))
    sums = joined.groupBy("uid", "doc_id", "n_bytes").agg(total.alias("total"), F.sum("copies").alias("copies"))
    return sums.select("doc_id", "n_bytes", F.expr("total div copies").alias("n_tokens"), F.explode(F.expr("sequence(1, copies)")).alias("_")).drop("_")


def op9_token_counts(spark, sf_dir):
    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet")).withColumn("over_limit", F.col("n_tokens") > 2048)


QUERIES = {"op9_token_counts": op9_token_counts}
SQL = {}
