"""The pipeline's stages, each on its own input, at sf0.001."""

import random

import corpus_pipeline
import pyarrow as pa
from hornlake.llm import pretokens, simhash
from hornlake.llm.common import BATCH_BYTES, BATCH_LIMIT, chunks, materialize

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    sizes = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {(r.doc_id, r.text) for r in docs.collect()}
        docs = materialize(stage(spark, docs, SF))
        after = {(r.doc_id, r.text) for r in docs.collect()}
        assert docs.columns == columns and after <= before, name
        if name == "exact dedup":
            assert len({t for _, t in after}) == len(after) == len({t for _, t in before})
        sizes.append(len(after))
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] > 0.6 * sizes[0]
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert {r.doc_id for r in packed} == {r.doc_id for r in docs.collect()}
    assert len(corpus_pipeline.run(spark, SF).collect()) == len(packed)


def test_columns_that_clash_are_kept(spark):
    names = ["_uid", "uid", "gone_uid", "own_id", "_body", "_hash", "_head", "keep_id", "group_size", "kept", "text_sha256", "score"]
    rows = [(i, text, *[f"{n}-{i}" for n in names]) for i, text in enumerate(["a b c d e f", "a b c d e f", None, "", "idiot", "other words here"])]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, " + ", ".join(f"`{n}` string" for n in names))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        assert {tuple(r) for r in out.collect()} <= set(rows), name
    assert {r.doc_id for r in corpus_pipeline.STAGES[2][1](spark, docs, SF).collect()} == {0, 2, 4, 5}
    empty = docs.where("false")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0, name


def test_near_dedup_links_fingerprints_and_similar_texts(spark):
    """One document stays of each component of both kinds of links: first and last by similarity alone, last and second by fingerprints alone."""
    rnd = random.Random(3)
    words = lambda n: [f"w{rnd.randrange(9000)}" for _ in range(n)]
    texts = [" ".join(words(120)) for _ in range(5)]
    for _ in range(6):
        line, ends = words(9), [words(40), words(60)]  # repeated, the line decides every bit, and the sets see the ends
        texts += [" ".join(t) for t in (line * 2 + ends[0], line * 40 + ends[1], line * 40 + ends[0])]
    sets = [set(simhash.shingles(t.encode(), 5)) for t in texts]
    prints = [simhash.majority(simhash._hashes(simhash.shingles(t.encode(), 3))) for t in texts]
    close = lambda i, j: 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])
    linked = lambda i, j: (prints[i] ^ prints[j]).bit_count() <= 2
    pairs = [(i, j) for j in range(len(texts)) for i in range(j)]
    assert sum(linked(*p) and not close(*p) for p in pairs) == sum(close(*p) and not linked(*p) for p in pairs) == 6
    least = list(range(len(texts)))
    for _ in texts:
        for i, j in pairs:
            if close(i, j) or linked(i, j):
                least[i] = least[j] = min(least[i], least[j])
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    assert {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, SF).collect()} == set(least)


def test_near_dedup_indexes_only_texts_that_could_be_similar(spark):
    """Every text of a similar pair stays in the join, of 400 unrelated ones few do; a slice that lacks a row loses none."""
    rnd = random.Random(4)
    words = lambda n: [f"w{rnd.randrange(9000)}" for _ in range(n)]
    rows = [("alone", words(rnd.randint(3, 400))) for _ in range(400)] + [("pair", []), ("pair", [])]
    for n in (4, 5, 30, 300):
        base = words(n)
        rows += [("pair", base), ("pair", base + words(n // 8)), ("part", base[: n // 2] + words(n))]
    rnd.shuffle(rows)
    docs = spark.createDataFrame([(i, " ".join(t).encode(), k) for i, (k, t) in enumerate(rows)], "uid bigint, text binary, kind string")
    left = [r.uid for r in simhash.hopeful(docs.select("uid", "text")).collect()]
    kinds = [rows[i][0] for i in left]
    assert len(left) == len(set(left)) and kinds.count("pair") == 10 and kinds.count("alone") < 20
    dealt = docs.select("uid", "text").coalesce(1).mapInArrow(simhash._dealt(7), "slice bigint, part int, sent bigint, body binary, by binary")
    counted = dealt.coalesce(1).mapInArrow(simhash._repeated, "slice bigint, sent bigint, body binary, by binary").toArrow()
    whole, lacking = (sum(b.num_rows for b in simhash._hopeless(t.to_batches())) for t in (counted, counted.slice(1)))
    assert counted.num_rows == 8 and whole >= 380 and lacking == 0


def test_workers_hold_small_batches_and_no_other_operators_words(spark):
    """12 MB of texts in one partition come to a worker bit by bit; the session's own limit stays; only tokenising keeps the cache of words."""
    docs = spark.range(4000).selectExpr("id AS doc_id", "repeat('word ', 600) AS text").coalesce(1)

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes]), pa.array([batch.num_rows])], ["bytes", "rows"])

    seen = lambda: materialize(docs.mapInArrow(sizes, "bytes bigint, rows bigint")).agg({"bytes": "max", "rows": "sum"}).first()
    found = seen()
    assert found["max(bytes)"] < 2 * BATCH_BYTES and found["sum(rows)"] == 4000
    assert spark.conf.get(BATCH_LIMIT, None) is None
    spark.conf.set(BATCH_LIMIT, "5000000")
    try:
        assert 4_000_000 < seen()["max(bytes)"] < 6_000_000 and spark.conf.get(BATCH_LIMIT) == "5000000"
    finally:
        spark.conf.unset(BATCH_LIMIT)
    batch, words = pa.RecordBatch.from_arrays([pa.array(["some text"])], ["text"]), pretokens.word_ids()
    assert sum(part.num_rows for part in chunks(batch, 0, words=True)) == 1 and pretokens.word_ids() is words
    assert sum(part.num_rows for part in chunks(batch, 0)) == 1 and pretokens.word_ids() is not words
