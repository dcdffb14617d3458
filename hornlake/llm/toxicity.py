"""Toxicity by nearest labelled examples.

A bounded sample of labelled rows (SAMPLE per class) is the training set.  Every word of its texts is a term; a
document becomes a vector of its terms by TF-IDF times an evidence factor, from FAINT for words
that are alike in both classes to STRONG for those that clearly mark one, and of one background term that all texts share.
Document frequencies are counted over all documents; only the evidence comes from the sample.

The sampled examples form a block-max inverted index over all terms: postings in blocks of BLOCK examples with each
block's largest weight per term.  A query bounds every block's best cosine, opens the blocks of the highest
bounds and then those whose bound can still reach the k-th best: the neighbours are exact.  Votes
weigh by closeness and by how the sample thinned each class; isotonic regression over the examples'
own left-out votes turns them into probabilities, and the nearest examples are the evidence.

Index size is bounded by SAMPLE and the words of the sampled texts, so it is broadcast.  Labels of held-out ids never count.

Defined cases: null or empty texts are scored like texts without any known word; without labels of
both classes the score is 0.0; null ids are scored; a labelled id's repeated rows are all examples, up
to 2 SAMPLE rows a class by hash; conflicting labels of an id count as toxic.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, give_back, id_text, materialize, row_key, without

SAMPLE, BLOCK, NEIGHBOURS = 1000, 64, 25
ROWS = 500  # vectors that a worker holds as Python's numbers
FAINT, STRONG, LONG, FIRST_BLOCKS = 0.05, 10.0, 200, 4
FOLDS = 5
WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> Counter:
    return Counter(WORD.findall(text.lower()))


def held_out(doc_id):
    """True for ids whose labels may not be learnt."""
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0


def _examples(batches):
    for batch in (part for batch in batches for part in chunks(batch, 2)):
        counts = [words_of(t) for t in batch.column(2).to_pylist()]
        kind = pa.list_(pa.string()), pa.list_(pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(3), pa.array([list(c) for c in counts], kind[0]), pa.array([list(c.values()) for c in counts], kind[1])], ["uid", "doc_id", "toxic", "words", "freqs"])


def _vectors(terms):
    def run(batches):
        known = terms.value
        for batch in (part for batch in batches for part in chunks(batch, 2)):
            index, freq = [], []
            for text in batch.column(2).to_pylist():
                counts = words_of(text)
                ids = [(known[w], n) for w, n in counts.items() if w in known]
                index.append([i for i, _ in ids]), freq.append([n for _, n in ids])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(index, pa.list_(pa.int32())), pa.array(freq, pa.list_(pa.int32()))], ["uid", "doc_id", "terms", "freqs"])

    return run


def evidence(toxic: np.ndarray, clean: np.ndarray, n1: int, n0: int) -> np.ndarray:
    """FAINT and up to STRONG more, by a quarter of the squared score of a test that the word's rates differ; counts are examples with the word."""
    rates = np.log((toxic + 0.5) / (n1 + 1)) - np.log((clean + 0.5) / (n0 + 1))
    return FAINT + np.minimum(STRONG, rates**2 / (1 / (toxic + 0.5) + 1 / (clean + 0.5)) / 4)


def unit_vector(index, freqs, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Term numbers in order and weights of a unit vector; the last number is the background term.

    weight: IDF times evidence of each term.
    """
    index, freqs = np.asarray(index, np.int64), np.asarray(freqs, float)
    order = np.argsort(index)
    ids = np.append(index[order], len(weight))
    values = np.append((1 + np.log(freqs[order])) * weight[ids[:-1]], 1.0)
    return ids, values / np.linalg.norm(values)


class BlockMaxIndex:
    """Unit vectors of labelled examples; equal vectors share an entry.  counts: (clean, toxic) weights.

    Terms of LONG and more postings have them as rows of dense blocks with a maximum a block; the few of
    all other terms are added up for all examples at once.
    """

    def __init__(self, examples, n_terms: int):
        entries: dict[tuple, list] = {}
        for ids, weights, toxic, weight, doc in examples:
            e = entries.setdefault(self.key(ids, weights), [0, 0.0, 0.0, [], ids, weights])
            e[0] += 1
            e[1 + toxic] += weight
            e[3] = e[3][:3] if len(e[3]) >= 3 else [*e[3], (doc, toxic)]
        order = sorted(entries, key=lambda k: (entries[k][2] > 0, k))  # a block's examples are of one class, most often
        self.entries = [entries[k] for k in order]
        self.number = {k: n for n, k in enumerate(order)}
        self.sizes = np.array([e[0] for e in self.entries])
        self.blocks = -(-len(order) // BLOCK)
        terms = np.concatenate([e[4] for e in self.entries])
        values = np.concatenate([e[5] for e in self.entries])
        of = np.repeat(np.arange(len(self.entries)), [len(e[4]) for e in self.entries])
        by_term = np.argsort(terms, kind="stable")
        self.of, self.values = of[by_term], values[by_term]
        self.starts = np.searchsorted(terms[by_term], np.arange(n_terms + 2))
        held = np.diff(self.starts)
        self.row = np.where(held >= LONG, np.cumsum(held >= LONG) - 1, -1)
        self.dense = np.zeros((self.blocks, int((held >= LONG).sum()), BLOCK))
        for t in np.flatnonzero(held >= LONG):
            at = self.of[self.starts[t] : self.starts[t + 1]]
            self.dense[at // BLOCK, self.row[t], at % BLOCK] = self.values[self.starts[t] : self.starts[t + 1]]
        self.most = self.dense.max(axis=2)

    @staticmethod
    def key(ids: np.ndarray, weights: np.ndarray) -> tuple[bytes, bytes]:
        return ids.tobytes(), np.round(weights, 9).tobytes()

    def nearest(self, ids, weights, k: int, without: int | None = None) -> list[tuple[float, int, float]]:
        """(cosine, entry, share of the entry's rows that count) of the exact k nearest rows.

        without: an entry one of whose rows is left out.  Equal cosines go by entry number.
        """
        row = self.row[ids]
        rows, strong = row[row >= 0], weights[row >= 0]
        scores = np.zeros(self.blocks * BLOCK)
        few = ids[row < 0]
        if len(few):
            lows, highs = self.starts[few], self.starts[few + 1]
            counts = highs - lows
            at = np.arange(counts.sum()) + np.repeat(lows - np.cumsum(counts) + counts, counts)
            scores += np.bincount(self.of[at], self.values[at] * np.repeat(weights[row < 0], counts), self.blocks * BLOCK)
        scores = scores.reshape(self.blocks, BLOCK)
        sizes = np.zeros(self.blocks * BLOCK, np.int64)
        sizes[: len(self.sizes)] = self.sizes
        if without is not None:
            sizes[without] -= 1
        bound = self.most[:, rows] @ strong + scores.max(axis=1)
        order = np.argsort(-bound, kind="stable")
        opened = np.zeros(0, np.int64)
        least = -1.0
        for some in (order[:FIRST_BLOCKS], order[FIRST_BLOCKS:]):
            some = some[bound[some] >= least - 1e-12]
            scores[some] += strong @ self.dense[some[:, None], rows] if len(rows) else 0.0
            opened = np.concatenate([opened, (some[:, None] * BLOCK + np.arange(BLOCK)).ravel()])
            flat = np.round(scores.ravel()[opened], 12)
            best = opened[np.lexsort((opened, -flat))]
            until = np.searchsorted(np.cumsum(sizes[best]), k)
            least = round(float(scores.ravel()[best[until]]), 12) if until < len(best) else -1.0
        out, left = [], k
        for e in best:
            if left <= 0 or (s := round(float(scores.ravel()[e]), 12)) <= 0:
                break
            if sizes[e]:
                out.append((s, int(e), min(1.0, left / sizes[e])))
                left -= sizes[e]
        return out

    def vote(self, ids, weights, k: int, without: tuple[int, int, float] | None = None) -> tuple[float, list]:
        """Share of toxic votes in the k nearest rows, and the nearest rows as (doc_id, toxic, cosine)."""
        votes, evidence = [0.0, 0.0], []
        for cosine, e, share in self.nearest(ids, weights, k, without and without[0]):
            near = share / (0.02 + 1 - cosine)
            for toxic in (0, 1):
                own = without[2] if without and without[0] == e and without[1] == toxic else 0.0
                votes[toxic] += near * max(0.0, self.entries[e][1 + toxic] - own)
            evidence += [(d, t, round(cosine, 6)) for d, t in self.entries[e][3]]
        return votes[1] / (sum(votes) or 1.0), evidence[:3]


def isotonic(scores: list[float], labels: list[int], weights: list[float]) -> tuple[list[float], list[float]]:
    """Steps (from score, probability) of the weighted least-squares rising fit (pooled neighbours)."""
    pools: list[list[float]] = []
    for s, y, w in sorted(zip(scores, labels, weights, strict=True)):
        if pools and pools[-1][0] == s:
            pools[-1][1] += w * y
            pools[-1][2] += w
        else:
            pools.append([s, w * y, w])
        while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
            _, y2, w2 = pools.pop()
            pools[-1][1] += y2
            pools[-1][2] += w2
    return [p[0] for p in pools], [p[1] / p[2] for p in pools]


def sample(labels: DataFrame) -> tuple[DataFrame, dict[int, float]]:
    """At most SAMPLE learnable ids per class, and the weight of one example of each class."""
    known = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    known = known.where(F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sizes = {r.toxic: r["count"] for r in known.groupBy("toxic").count().collect()}
    parts = [known.where(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE) for c in (0, 1)]
    return parts[0].unionByName(parts[1]), {c: max(1.0, n / SAMPLE) for c, n in sizes.items()}


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(uid, doc_id, score, evidence) per document; uid is row_key() of (doc_id, text)."""
    spark = docs.sparkSession
    rows = id_text(docs).withColumn("uid", row_key()).select("uid", "doc_id", "text")
    nothing = F.lit(0.0).alias("score"), F.array().cast("array<string>").alias("evidence")
    picked, thin = sample(labels)
    picked = materialize(picked)
    sizes = {r.toxic: r["count"] for r in picked.groupBy("toxic").count().collect()}
    if len(sizes) < 2:
        return rows.select("uid", "doc_id", *nothing)
    texts = rows.join(F.broadcast(picked), "doc_id").select("uid", "doc_id", "text", "toxic")  # at most 2 x SAMPLE ids
    texts = [texts.where(F.col("toxic") == c).orderBy(F.xxhash64("uid"), "uid").limit(2 * SAMPLE) for c in (0, 1)]
    held = texts[0].unionByName(texts[1]).mapInArrow(_examples, "uid bigint, doc_id bigint, toxic int, words array<string>, freqs array<bigint>").collect()
    sizes = Counter(r.toxic for r in held)
    if len(sizes) < 2:
        return rows.select("uid", "doc_id", *nothing)
    terms = {w: i for i, w in enumerate(sorted(set().union(*(r.words for r in held))))}
    marked = np.zeros((2, len(terms)))
    for r in held:
        marked[r.toxic, [terms[w] for w in r.words]] += 1
    vectors = materialize(rows.mapInArrow(_vectors(spark.sparkContext.broadcast(terms)), "uid bigint, doc_id bigint, terms array<int>, freqs array<int>"))
    total = vectors.count()
    weight = np.full(len(terms), math.log1p(total))
    for r in vectors.select(F.explode("terms").alias("t")).groupBy("t").count().toLocalIterator():  # a row per term of the bounded sample
        weight[r.t] = math.log((1 + total) / (1 + r["count"])) + 0.1
    weight *= evidence(marked[1], marked[0], sizes[1], sizes[0])
    examples = [(*unit_vector([terms[w] for w in r.words], r.freqs, weight), r.toxic, thin[r.toxic], r.doc_id) for r in held]
    index = BlockMaxIndex(examples, len(terms))
    raw, known = [], {}
    for ids, weights, toxic, part, _ in examples:
        key = (index.number[index.key(ids, weights)], toxic, part)
        if key not in known:
            known[key] = index.vote(ids, weights, NEIGHBOURS, key)[0]
        raw.append(known[key])
    steps = isotonic(raw, [e[2] for e in examples], [e[3] for e in examples])
    index.number = None
    for e in index.entries:
        e[4] = e[5] = None  # the postings have them
    model = spark.sparkContext.broadcast((index, weight, steps))

    def run(batches):
        index, weight, (starts, levels) = model.value
        for batch in (batch.slice(at, ROWS) for batch in batches for at in range(0, batch.num_rows, ROWS)):
            out, near = [], []
            for ids, freqs in zip(*(batch.column(i).to_pylist() for i in (2, 3)), strict=True):
                vote, found = index.vote(*unit_vector(ids, freqs, weight), NEIGHBOURS)
                level = levels[max(0, bisect_right(starts, vote) - 1)]
                out.append(min(1.0, max(0.0, 0.998 * level + 0.001 + 0.001 * (2 * vote - 1)))), near.append([f"{d}:{t}:{c:g}" for d, t, c in found])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.float64()), pa.array(near, pa.list_(pa.string()))], ["uid", "doc_id", "score", "evidence"])
        give_back()

    return vectors.mapInArrow(run, "uid bigint, doc_id bigint, score double, evidence array<string>")


def keep_clean(docs: DataFrame, labels: DataFrame, most: float = 0.5) -> DataFrame:
    """docs, all columns, without those that score `most` or more."""
    return without(docs, score(docs, labels).where(F.col("score") >= most).select("doc_id", "uid"))


def op3_toxicity(spark, sf_dir):
    found = score(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    out = F.coalesce(held_out(F.col("doc_id")), F.lit(False))
    return found.select("doc_id", out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence")


QUERIES = {"op3_toxicity": op3_toxicity}
SQL = {}
