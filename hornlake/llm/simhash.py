"""SimHash near-dedup by meet-in-the-middle ball hashing.

Every distinct fingerprint emits all its variants within half the radius.  Two fingerprints within the
radius share a variant, and those that share one are within the radius, so a variant's fingerprints are
linked to the least of them: links grow with the rows, never with a group's square.  Links are verified
by their differing bits, and components spread over distinct fingerprints only.

keep_linked removes what fingerprints link and, as they miss most pairs at a similarity of 0.8, what the exact
join of near_duplicates links beside them: documents that share a shingle of their prefixes (see buckets) are
candidates, and candidate pairs are verified by the Jaccard similarity of their distinct five-word shingles
until no pair could link two components.

Defined cases: null is the empty text; no words give fingerprint zero, linked like any other; fewer
words than a shingle form one; null ids are kept, a component of null ids has a null id; repeated rows
share fingerprint and component.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import checked, chunks, components, forget, give_back, id_text, materialize, partitions, row_key, without

SEED = 42
SHINGLE, HEADS, CROWD, BEFORE = 5, 3, 16, 32  # the similarity is 4/5
SAMPLED, COMMON = 5000, 200_000  # documents to sample at least, shingles that come last in prefixes
PART_BYTES, KEY_BITS, MOST_PARTS = 16_000_000, 24, 60_000  # text to a part of the shingles, their bits in it, parts at most


def shingles(text: bytes, width: int) -> list[bytes]:
    """Space-joined word shingles, repeats included; A-Z lower-cased; fewer words: the whole sequence."""
    words = text.lower().split()
    if len(words) < width:
        return [b" ".join(words)] if words else []
    return list(map(b" ".join, zip(*[words[i:] for i in range(width)])))


def majority(hashes: np.ndarray) -> int:
    """The 64-bit number of the bits that over half of the hashes have."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 14):
        part = hashes[at : at + (1 << 14)].astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1).sum(0, dtype=np.int32)
    return int.from_bytes(np.packbits(ones * 2 > len(hashes)).tobytes(), "big") if len(hashes) else 0


def _hashes(parts) -> np.ndarray:
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(s, SEED) for s in parts), np.uint64)


def _fingerprint(width: int):
    def run(batches):
        for batch in (part for batch in batches for part in chunks(batch, 1)):
            prints = [majority(_hashes(shingles(t, width))) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(prints, np.uint64).view(np.int64))], ["doc_id", "fp"])

    return run


def masks(bits: int, most: int) -> list[int]:
    """Signed 64-bit numbers with at most `most` of the lowest `bits` bits set."""
    found = [sum(1 << i for i in c) for k in range(most + 1) for c in itertools.combinations(range(bits), k)]
    return [m - (1 << 64) if m >= 1 << 63 else m for m in found]


def ball_links(prints: DataFrame, bits: int, radius: int) -> DataFrame:
    """Links (a, b) among distinct numbers `fp` that connect all pairs within an even radius."""
    if radius % 2:
        raise ValueError("the radius must be even: half of it on either side")
    shifts = F.array(*[F.lit(m) for m in masks(bits, (radius + 1) // 2)])
    spread = prints.select("fp", F.explode(shifts).alias("mask")).select("fp", F.col("fp").bitwiseXOR(F.col("mask")).alias("variant"))
    least = spread.withColumn("a", F.min("fp").over(Window.partitionBy("variant"))).where("a <> fp").select("a", F.col("fp").alias("b"))
    return least.distinct().where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)


def simhash_components(docs: DataFrame, width: int = 3, radius: int = 2) -> DataFrame:
    """(doc_id, fp, component_id): components of fingerprints linked at `radius` (even) or fewer bits."""
    rows = id_text(docs).select("doc_id", F.col("text").cast("binary").alias("text"))
    prints = materialize(rows.mapInArrow(_fingerprint(width), "doc_id bigint, fp bigint"))
    distinct = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    joined = components(ball_links(distinct.select("fp"), 64, radius))
    of = distinct.join(joined.withColumnRenamed("id", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    best = of.groupBy("component").agg(F.min("least").alias("component_id"))
    ids = materialize(of.join(best, "component").select("fp", "component_id"))
    return prints.join(ids, "fp").select("doc_id", "fp", "component_id")


def _shingle_sets(batches):
    for batch in (part for batch in batches for part in chunks(batch, 1)):
        sets = [np.unique(_hashes(set(shingles(t, SHINGLE)))).view(np.int64) for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], ["uid", "words"])


def _dealt(parts: int):
    """Of each slice of documents a row per part with its shingles' last KEY_BITS and, as steps, their documents;
    and a row with the slice's uids and sizes, and in `sent` how many rows the others are."""

    def run(batches):
        for batch in (part.slice(at, 1 << 16) for batch in batches for part in chunks(batch, 1) for at in range(0, part.num_rows, 1 << 16)):
            sets = [np.unique(_hashes(set(shingles(t, SHINGLE)))) for t in batch.column(1).to_pylist()]
            sizes = np.array([len(h) for h in sets], np.int64)
            all_ = np.concatenate(sets)
            part = (all_ >> np.uint64(KEY_BITS)) % np.uint64(parts)
            order = np.argsort(part.astype(np.uint16), kind="stable")
            keys = np.ascontiguousarray(all_[order].astype("<u4").view(np.uint8).reshape(-1, 4)[:, : KEY_BITS // 8])
            docs, part = np.repeat(np.arange(len(sets)), sizes)[order], part[order]
            cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(part)] if len(part) else [0]
            uids = np.asarray(batch.column(0)).astype(np.int64).tobytes()
            name = xxhash.xxh64_intdigest(uids, SEED)
            out = [(int(part[a]), -1, keys[a:b].tobytes(), np.diff(docs[a:b], prepend=0).astype("<u2").tobytes()) for a, b in itertools.pairwise(cuts)]
            out.append((name % parts, len(out), uids, sizes.tobytes()))
            part, sent, body, by = zip(*out, strict=True)
            names = np.full(len(out), name, np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(part, pa.int32()), pa.array(sent, pa.int64()), pa.array(body, pa.binary()), pa.array(by, pa.binary())], ["slice", "part", "sent", "body", "by"])

    return run


def _repeated(batches):
    """Rows of _dealt with, in place of their shingles, the documents of those whose key stands more than once in the part."""
    found = {}
    for batch in batches:
        for name, part, sent, body, by in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            found.setdefault(part, []).append((name, sent, body, by))
    for rows in found.values():
        own = [r for r in rows if r[1] < 0]
        keys = np.zeros((sum(len(r[2]) for r in own) * 8 // KEY_BITS, 4), np.uint8)
        keys[:, : KEY_BITS // 8] = np.frombuffer(b"".join(r[2] for r in own), np.uint8).reshape(-1, KEY_BITS // 8)
        keys = keys.view("<u4").ravel()
        ordered, twice = np.sort(keys), np.zeros(1 << KEY_BITS, bool)
        twice[ordered[1:][ordered[1:] == ordered[:-1]]] = True
        twice, at, out = twice[keys], 0, [r for r in rows if r[1] >= 0]
        for name, sent, _, by in own:
            docs = np.cumsum(np.frombuffer(by, "<u2"), dtype=np.int64)
            out.append((name, sent, b"", docs[twice[at : at + len(docs)]].astype("<u2").tobytes()))
            at += len(docs)
        names, sent, body, by = zip(*out, strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(sent, pa.int64()), pa.array(body, pa.binary()), pa.array(by, pa.binary())], ["slice", "sent", "body", "by"])
        give_back()


def _hopeless(batches):
    """Uids of documents with fewer repeated shingles than 4/5 of theirs; none of a slice that lacks rows."""
    found = {}
    for batch in batches:
        for name, sent, body, by in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            heads, bodies = found.setdefault(name, ([], []))
            if sent >= 0:
                heads.append((sent, body, by))
            else:
                bodies.append(by)
    for heads, bodies in found.values():
        if heads and len(bodies) == sum(h[0] for h in heads):
            uids, sizes = (np.frombuffer(b, np.int64) for b in heads[0][1:])
            count = np.bincount(np.frombuffer(b"".join(bodies), "<u2"), minlength=len(uids))
            yield pa.RecordBatch.from_arrays([pa.array(uids[count < sizes - sizes // 5])], ["uid"])


def hopeful(rows: DataFrame) -> DataFrame:
    """rows (uid, text), materialized, but for those that no other can be similar to.

    A text shares 4/5 of its shingles with any similar one, so so many must stand in another text.  Shingles are
    counted whole, by part and KEY_BITS of their hash: different ones may be taken for one, which only leaves more rows.
    A row stays unless all that was sent of its slice has come.
    """
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = min(MOST_PARTS, size // PART_BYTES + partitions(rows.sparkSession))
    dealt = rows.mapInArrow(_dealt(parts), "slice bigint, part int, sent bigint, body binary, by binary").repartition(parts, "part")
    counted = dealt.mapInArrow(_repeated, "slice bigint, sent bigint, body binary, by binary").repartition(parts, "slice")
    gone = materialize(counted.mapInArrow(_hopeless, "uid bigint").distinct())
    ids = materialize(rows.select("uid").join(checked(gone), "uid", "left_anti").distinct())
    left = materialize(rows.join(checked(ids), "uid", "left_semi"))
    for done in (gone, ids):
        forget(done)
    return left


def common_shingles(rows: DataFrame) -> np.ndarray:
    """At most COMMON hashes of shingles that several of the sampled documents hold, the rarest first.

    They only set the order in which prefixes are taken; which pairs are found doesn't depend on them.
    """
    share = max(1, min(32, rows.count() // SAMPLED))
    picked = rows.where(F.pmod(F.xxhash64("uid"), F.lit(share)) == 0)
    held = picked.mapInArrow(_shingle_sets, "uid bigint, words array<bigint>").select(F.explode("words").alias("w")).groupBy("w").count().where("count > 2")
    most = held.orderBy(F.desc("count"), "w").limit(COMMON).collect()
    return np.array([r.w for r in reversed(most)], np.int64).view(np.uint64)


def _prefixes(shared):
    def run(batches):
        common = shared.value
        order = np.argsort(common)
        ranked = common[order]
        for batch in (part for batch in batches for part in chunks(batch, 1)):
            size, tokens = [], []
            for text in batch.column(1).to_pylist():
                h = np.unique(_hashes(set(shingles(text, SHINGLE))))
                n = len(h)
                if len(ranked) and n:
                    at = np.minimum(np.searchsorted(ranked, h), len(ranked) - 1)
                    known = ranked[at] == h
                    h = np.concatenate([h[~known], common[np.sort(order[at[known]])]])
                size.append(n)
                tokens.append(h[: n // 5 + 1].view(np.int64) if n else np.zeros(1, np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size, pa.int64()), pa.array(tokens, pa.list_(pa.int64()))], ["uid", "size", "tokens"])

    return run


def buckets(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(bucket, uid, size, score): documents that share a shingle of their prefixes, as any two documents
    of a similarity of 0.8 do; and (uid, size, score, held): the shared shingles of each prefix.

    Of n shingles the first n - ceil(0.8 n) + 1 = n div 5 + 1 in an order that all documents share are the prefix.
    Buckets of the same members are one.  score: how many documents hold the prefix's shingles on
    average, greatest for the text that a family of copies comes from.
    """
    shared = rows.sparkSession.sparkContext.broadcast(common_shingles(rows))
    index = rows.mapInArrow(_prefixes(shared), "uid bigint, size bigint, tokens array<bigint>").select(F.explode("tokens").alias("bucket"), "uid", "size")
    of = Window.partitionBy("bucket")
    members = [F.count(F.lit(1)).over(of).alias("n"), F.bit_xor(F.xxhash64("uid")).over(of).alias("x"), F.bit_xor(F.xxhash64("uid", F.lit(1))).over(of).alias("y")]
    index = index.repartition("bucket").dropDuplicates(["bucket", "uid", "size"]).select("bucket", "uid", "size", *members)
    index = materialize(index.where("n > 1"))
    score = F.sum("n") / F.expr("first(size) div 5 + 1")
    held = materialize(index.groupBy("uid").agg(F.first("size").alias("size"), score.alias("score"), F.collect_list("bucket").alias("held")))
    one = index.groupBy("n", "x", "y").agg(F.min("bucket").alias("bucket")).select("bucket")
    found = materialize(index.select("bucket", "uid", "size").join(one, "bucket", "left_semi").join(held.select("uid", "score"), "uid"))
    forget(index)
    return found, held


def verified(rows: DataFrame, held: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) whose five-word shingles have a Jaccard similarity of 0.8 or more, materialized.

    Of two prefixes the one that ends first holds no shared shingle that the other lacks, so two texts
    share at most what the prefixes share and the rest of one text.  Only pairs for which that can do
    have their texts fetched.
    """
    near = pairs.join(held.select(F.col("uid").alias("a"), F.col("size").alias("size_a"), F.col("held").alias("held_a")), "a")
    near = near.join(held.select(F.col("uid").alias("b"), F.col("size").alias("size_b"), F.col("held").alias("held_b")), "b")
    most = F.size(F.array_intersect("held_a", "held_b")) + F.expr("greatest(size_a - size_a div 5, size_b - size_b div 5) - 1")
    pairs = materialize(near.where(9 * most >= 4 * (F.col("size_a") + F.col("size_b"))).select("a", "b"))
    wanted = materialize(pairs.select(F.explode(F.array("a", "b")).alias("uid")).distinct())
    sets = materialize(rows.join(checked(wanted), "uid", "left_semi").mapInArrow(_shingle_sets, "uid bigint, words array<bigint>").dropDuplicates(["uid"]))
    both = pairs.join(sets.toDF("a", "words_a"), "a").join(sets.toDF("b", "words_b"), "b")
    shared = F.size(F.array_intersect("words_a", "words_b"))
    union = F.size("words_a") + F.size("words_b") - shared
    found = materialize(both.where(5 * shared >= 4 * union).select("a", "b"))
    for done in (pairs, wanted, sets):
        forget(done)
    return found


def nearest_fits(known: DataFrame) -> DataFrame:
    """Members (bucket, uid, size, solid, ...) that could be similar to their bucket's smallest other one.

    solid: a bound on the shingles that a text shares with any other; texts share at most the lesser of theirs.
    """
    least = known.groupBy("bucket").agg(F.min(F.struct("size", "uid")).alias("one"))
    second = known.join(least, "bucket").where("uid <> one.uid").groupBy("bucket").agg(F.first("one").alias("one"), F.min("size").alias("two"))
    nearest = F.when(F.col("uid") == F.col("one.uid"), F.col("two")).otherwise(F.col("one.size"))
    return known.join(second, "bucket").where(9 * F.col("solid") >= 4 * (F.col("size") + F.greatest(nearest, F.expr("size - size div 5")))).select(*known.columns)


def sharper(rows: DataFrame, left: DataFrame) -> DataFrame:
    """(bucket, uid, size, component, solid, before): members of crowded buckets in buckets anew.

    Only shingles that two texts of left hold can be shared, and a partner shares at least 4/5 of the text's
    size.  So of those shingles, the ones that fewest texts of left hold first, the first solid - ceil(0.8 size) + 1
    are the prefix; a text with fewer than ceil(0.8 size) has no partner.
    before: up to BEFORE of the prefix ahead of the bucket's shingle, so that a pair is met where it first meets.
    """
    ids = materialize(left.select("uid", "size", "component").distinct())
    words = rows.join(checked(ids.select("uid")), "uid", "left_semi").mapInArrow(_shingle_sets, "uid bigint, words array<bigint>").dropDuplicates(["uid"])
    words = materialize(words)
    each = words.select("uid", F.explode("words").alias("w"))
    again = materialize(each.groupBy("w").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))  # so that a hot shingle's join can be split
    lists = each.join(again, "w").groupBy("uid").agg(F.array_sort(F.collect_list(F.struct("n", "w"))).alias("held"))
    known = lists.join(ids, "uid").withColumn("solid", F.size("held"))
    known = known.withColumn("prefix", F.expr("transform(slice(held, 1, greatest(0, solid - (size - size div 5) + 1)), x -> x.w)"))
    places = F.transform("prefix", lambda w, i: F.struct(w.alias("bucket"), F.slice("prefix", F.lit(1), F.least(i, F.lit(BEFORE))).alias("before")))
    known = materialize(known.select("uid", "size", "component", "solid", F.inline(places)).select("bucket", "uid", "size", "component", "solid", "before"))
    found = materialize(nearest_fits(known))
    for done in (ids, words, again, known):
        forget(done)
    return found


def fingerprint_links(docs: DataFrame, width: int = 3, radius: int = 2) -> DataFrame:
    """Links (a, b) of row_key()s that join each component of simhash_components to its least member."""
    found = simhash_components(id_text(docs).select(row_key().alias("doc_id"), "text"), width, radius)
    return materialize(found.where("doc_id <> component_id").select(F.col("doc_id").alias("a"), F.col("component_id").alias("b")).distinct())


def labelled(members: DataFrame, labels: DataFrame) -> DataFrame:
    """members with their component, which is their own uid where labels (id, component) has none."""
    return members.join(labels.select(F.col("id").alias("uid"), "component"), "uid", "left").withColumn("component", F.coalesce("component", "uid"))


def near_duplicates(docs: DataFrame, links: DataFrame | None = None) -> DataFrame:
    """(uid, component) of documents with a near duplicate; uid is row_key() of (doc_id, text).

    Components are those of all pairs of a similarity of 0.8, and of links (a, b) if given, whose pairs need not
    be met again.  In each bucket one member meets all that are
    not yet linked to it, and leaves: that of the greatest score, in every other turn the smallest.
    After HEADS turns the members of buckets of up to CROWD meet in pairs; those of larger ones do in sharper
    buckets, where that could still make a link (see nearest_fits).
    Buckets within one component are done, so a large group of copies costs its size, not its square.
    """
    rows = hopeful(id_text(docs).select(row_key().alias("uid"), F.col("text").cast("binary").alias("text")))
    left, held = buckets(rows)
    left = left.withColumn("component", F.col("uid")) if links is None else labelled(left, components(links))
    edges, labels = links, None
    apart = "uid <> head AND component <> head_component AND 5 * least(size, head_size) >= 4 * greatest(size, head_size)"
    for turn in range(HEADS + 1):
        if turn < HEADS:
            rank = F.struct("score", "uid", "size", "component") if turn % 2 == 0 else F.struct((-F.col("size")).alias("rank"), "uid", "size", "component")
            heads = left.groupBy("bucket").agg(F.max(rank).alias("h"))
            heads = heads.select("bucket", F.col("h.uid").alias("head"), F.col("h.size").alias("head_size"), F.col("h.component").alias("head_component"))
            met = left.join(heads, "bucket").where(apart)
        else:
            bound = held.select("uid", (F.expr("size - size div 5 - 1") + F.size("held")).cast("int").alias("solid"))
            left = left.join(bound, "uid")
            crowds = left.groupBy("bucket").count().where(F.col("count") > CROWD).select("bucket")
            few = left.join(crowds, "bucket", "left_anti").select("bucket", "uid", "size", "component", "solid").withColumn("before", F.array().cast("array<bigint>"))
            crowded = materialize(nearest_fits(left.join(crowds, "bucket", "left_semi")))
            left = few.unionByName(sharper(rows, crowded))
            heads = left.select("bucket", F.col("uid").alias("head"), F.col("size").alias("head_size"), F.col("component").alias("head_component"), F.col("solid").alias("head_solid"), F.col("before").alias("head_before"))
            met = left.join(heads, "bucket").where(apart + " AND uid < head AND 9 * least(solid, head_solid) >= 4 * (size + head_size) AND NOT arrays_overlap(before, head_before)")
        pairs = materialize(met.select(F.least("uid", "head").alias("a"), F.greatest("uid", "head").alias("b")).distinct())
        found = verified(rows, held, pairs)
        forget(pairs)
        edges = found if edges is None else edges.unionByName(found)
        labels = components(edges)
        if turn < HEADS:
            left = left.join(heads.select("bucket", F.col("head").alias("uid")), ["bucket", "uid"], "left_anti").drop("component")
            left = labelled(left, labels)
            mixed = left.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("bucket")
            left = materialize(left.join(mixed, "bucket", "left_semi"))
            if left.isEmpty():
                break
    return labels.withColumnRenamed("id", "uid")


def keep_one(docs: DataFrame, links: DataFrame | None = None) -> DataFrame:
    """docs, all columns as they are, with only one document of each group (see near_duplicates): that of the least doc_id.

    Null ids come last; rows that repeat the one that stays stay with it.
    """
    ids = id_text(docs).select("doc_id", row_key().alias("uid")).distinct()
    grouped = materialize(ids.join(near_duplicates(docs, links), "uid"))
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "uid")
    best = grouped.groupBy("component").agg(F.min(order).alias("best")).select("component", "best.uid")
    return without(docs, grouped.join(best, ["component", "uid"], "left_anti").select("doc_id", "uid"))


def keep_linked(docs: DataFrame) -> DataFrame:
    """keep_one over the links of fingerprints (those of op7_simhash) and of the exact join together."""
    return keep_one(docs, fingerprint_links(docs))


def op7_simhash(spark, sf_dir):
    found = simhash_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


QUERIES = {"op7_simhash": op7_simhash}
SQL = {}
