r"""Benchmark decontamination by template canonicalisation.

Text becomes typed words: numbers <num>, words that are capitalised inside a
sentence <name>, and a unit after a number <unit>.  A word is typed where it stands, in items and documents alike; at
the beginning of a sentence it is a name if it is one elsewhere in the text and never in lower case.  Windows of
WINDOW typed words, and of plain words, are hashed on both sides and joined:

1. The distinct window hashes of all items are a table.  A bitmap of them of BITS bits, whatever the
   benchmark's size, lets documents leave out windows that no item has.
2. Documents' distinct windows join the table; a document that has less than COVER of an item's distinct windows is out.
3. What is left is verified as a pair of texts: within a stretch of the item's length and a half the document holds
   COVER of the item's windows themselves, most of the matched words are literal, and slots are consistent:
   one value in the item stands for one value in the document wherever it occurs.  Covered by windows of plain words
   a document is contaminated without more conditions, so no copy is lost by the typing of its words or by letter case.

Defined cases: null text matches nothing; items with fewer than WINDOW words are one shorter window and
match that exact sequence; empty items match nothing; repeated documents are decided alike, repeated items
are one; item ids may be null.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from itertools import compress

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checked, chunks, id_text, materialize, row_key, without

WINDOW, COVER, LITERAL, CONSISTENT = 5, 0.8, 0.5, 0.9
BITS = 1 << 23
# Units of measure that may follow a number.
UNITS = frozenset("mm cm m km in ft yd mi mg g kg lb oz ml l s ms min h hr hrs kb mb gb tb hz khz mhz ghz w kw v a usd eur percent".split())
TOKEN = re.compile(r"[^\W\d_]+|\d+(?:[.,]\d+)*|[.!?:;\n|]")
STOPS = frozenset(".!?:;\n|")


def typed(text: str) -> tuple[list[str], list[str]]:
    """(typed words, plain words) of a text; literal words are lower-case."""
    kinds, plain, starts, lower, last = [], [], [], set(), "."
    for token in TOKEN.findall(text):
        if token in STOPS:
            last = token
            continue
        low = token.lower()
        if token[0].isdigit():
            kind = "<num>"
        elif last == "<num>" and low in UNITS:
            kind = "<unit>"
        elif last not in STOPS and token[0] != low[0] and token[1:] == low[1:] and len(token) > 1:
            kind = "<name>"
        else:
            kind = low
            if token == low:
                lower.add(low)
            elif last in STOPS and token[1:] == low[1:]:
                starts.append(len(kinds))
        kinds.append(kind), plain.append(low)
        last = kind
    if starts:
        names = {p for k, p in zip(kinds, plain, strict=True) if k == "<name>"} - lower
        for at in starts:
            if plain[at] in names:
                kinds[at] = "<name>"
    return kinds, plain


def windows(kinds: list[str]) -> list[tuple[str, ...]]:
    if len(kinds) < WINDOW:
        return [tuple(kinds)] if kinds else []
    return list(zip(*[kinds[i:] for i in range(WINDOW)]))


class Index:
    """Benchmark items by the windows of their templates and of their plain words."""

    def __init__(self, items: list[tuple[int | None, str]]):
        self.items = [(i, *typed(t)) for i, t in items]
        self.places = self.placed(1), self.placed(2)
        self.distinct = [tuple(len(set(windows(words))) for words in item[1:]) for item in self.items]
        self.short = any(len(k) < WINDOW for _, k, _ in self.items)

    def placed(self, form: int) -> dict[tuple, list[tuple[int, int]]]:
        places = defaultdict(list)
        for n, item in enumerate(self.items):
            for at, w in enumerate(windows(item[form])):
                places[w].append((n, at))
        return dict(places)

    def hits(self, places, words: list[str]) -> dict[int, list[tuple[int, int]]]:
        """Per item the places (in the text, in the item) of its windows."""
        hits, all_windows = defaultdict(list), windows(words)
        for at in compress(range(len(all_windows)), map(places.__contains__, all_windows)):
            for n, there in places[all_windows[at]]:
                hits[n].append((at, there))
        if self.short:
            for size in range(1, WINDOW):
                for at, w in enumerate(zip(*[words[i:] for i in range(size)])):
                    if len(words) >= WINDOW or size < len(words):
                        for n, there in places.get(w, ()):
                            hits[n].append((at, there))
        return hits

    def matches(self, text: str) -> list[tuple[int | None, float, bool]]:
        """(item id, share of its windows found, verbatim) of each item that contaminates the text."""
        kinds, plain = typed(text)
        found = {}
        for form, words in enumerate((kinds, plain)):
            for n, pairs in self.hits(self.places[form], words).items():
                need = COVER * self.distinct[n][form]
                if len({p for _, p in pairs}) >= need and (best := self.stretch(n, pairs, need, form, kinds, plain)):
                    other = found.get(n, best)
                    found[n] = best[0], max(best[1], other[1]), best[2] or other[2]
        return list(found.values())

    def stretch(self, n, pairs, need, form, kinds, plain):
        item, mine, words = self.items[n]
        reach, pairs = len(mine) * 3 // 2 + WINDOW, sorted(pairs)
        key = windows(words if form else mine)
        counts, distinct, low = defaultdict(int), 0, 0
        for high, (at, there) in enumerate(pairs):
            counts[key[there]] += 1
            distinct += counts[key[there]] == 1
            while at - pairs[low][0] > reach:
                gone = key[pairs[low][1]]
                counts[gone] -= 1
                distinct -= counts[gone] == 0
                low += 1
            if distinct >= need and (seen := "verbatim" if form else self.consistent(pairs[low : high + 1], mine, words, kinds, plain)):
                return item, distinct / self.distinct[n][form], seen == "verbatim"
        return None

    @staticmethod
    def consistent(pairs, mine, words, kinds, plain):
        """"verbatim", "template" or None by the words that the windows align.

        A window that the item holds twice also meets its other place: of an item's place only the hit
        of the most frequent offset counts.
        """
        width = min(WINDOW, len(mine))
        offsets = Counter(at - there for at, there in pairs)
        chosen: dict[int, tuple] = {}
        for at, there in pairs:
            chosen[there] = max(chosen.get(there, (0, 0)), (offsets[at - there], -at))
        pairs = [(-at, there) for there, (_, at) in chosen.items()]
        aligned = {(there + k, at + k) for at, there in pairs for k in range(width)}
        slots, literal = defaultdict(lambda: defaultdict(int)), 0
        for i, j in aligned:
            if mine[i][0] == "<" and mine[i][-1] == ">":
                slots[mine[i], words[i]][plain[j]] += 1
            else:
                literal += 1
        if literal < LITERAL * len(aligned):
            return None
        total = sum(sum(v.values()) for v in slots.values())
        if sum(max(v.values()) for v in slots.values()) < CONSISTENT * total:
            return None
        return "verbatim" if all(set(v) == {value} for (_, value), v in slots.items()) else "template"


class WindowHashes:
    """64-bit hashes of windows by rolling sums of word hashes; words are kept up to a bound."""

    def __init__(self):
        self.known: dict[str, int] = {}

    def words(self, words: list[str]) -> np.ndarray:
        known = self.known
        if len(known) > 200_000:
            known.clear()
        try:
            return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        except KeyError:
            for w in words:
                if w not in known:
                    known[w] = xxhash.xxh3_64_intdigest(w)
            return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))

    def both(self, kinds: list[str], plain: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of typed and of plain words; most words are typed as themselves."""
        h = self.words(plain)
        at = [i for i, k in enumerate(kinds) if k[0] == "<"]
        if not at:
            return h, h
        marked = h.copy()
        marked[at] = self.words([kinds[i] for i in at])
        return marked, h


def all_windows(h: np.ndarray, sizes: set[int]):
    """Hashes of the windows of WINDOW words (of all, if there are fewer) and of the given lesser sizes."""
    for size in {min(WINDOW, len(h)), *(k for k in sizes if k < len(h))} - {0}:
        total = h[: len(h) - size + 1] + np.uint64(size)
        for i in range(1, size):
            total *= _STEP
            total += h[i : len(h) - size + 1 + i]
        total ^= total >> np.uint64(31)
        total *= _MIX
        yield total


_STEP, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def _item_windows(batches):
    hashes = WindowHashes()
    for batch in batches:
        out = [[], [], [], []]
        for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            for form, h in enumerate(hashes.both(*typed(text))):
                found = np.unique(np.concatenate([*all_windows(h, set()), h[:0]])).view(np.int64).tolist()
                for column, v in zip(out, ([item] * len(found), [form] * len(found), found, [min(WINDOW, len(h))] * len(found)), strict=True):
                    column += v
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.int32()))], ["item", "form", "h", "words"])


def _document_windows(shared):
    def run(batches):
        bits, sizes = shared.value
        hashes = WindowHashes()

        def held(h):
            """The distinct windows that some item may have."""
            kept = []
            for w in all_windows(h, sizes):
                at = w & np.uint64(BITS - 1)
                kept.append(w[bits[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1) == 1])
            return np.unique(np.concatenate(kept)) if kept else h

        for batch in (part for batch in batches for part in chunks(batch, 2)):
            uids, docs, forms, found = [], [], [], []
            for uid, doc, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                marked, plain = hashes.both(*typed(text))
                first = held(marked)
                for form, h in enumerate((first, first if marked is plain else held(plain))):
                    if len(h):
                        uids.append(np.full(len(h), uid)), docs.extend([doc] * len(h))
                        forms.append(np.full(len(h), form, np.int32)), found.append(h.view(np.int64))
            if uids:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(uids)), pa.array(docs, pa.int64()), pa.array(np.concatenate(forms)), pa.array(np.concatenate(found))], ["uid", "doc_id", "form", "h"])

    return run


def _verify(batches):
    for batch in (part for batch in batches for part in chunks(batch, 1)):
        got = []
        for doc, text, items in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            got += [(doc, *m) for m in Index([(i["item_id"], i["text"]) for i in items]).matches(text)]
        if got:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*got), (pa.int64(), pa.int64(), pa.float64(), pa.bool_()))], ["doc_id", "item_id", "coverage", "verbatim"])


def _pairs(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(uid, doc_id, text, items array<struct<item_id, text>>) of documents and the items whose windows they hold."""
    spark = docs.sparkSession
    rows = id_text(docs).withColumn("uid", row_key())
    items = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).distinct()
    items = items.withColumn("item", F.xxhash64("item_id", "text"))
    windows = materialize(items.select("item", "text").mapInArrow(_item_windows, "item bigint, form int, h bigint, words int"))
    at = F.expr(f"h & {BITS - 1}")  # BITS is a power of two, so that this is the unsigned remainder
    marks = windows.select(F.shiftright(at, 6).alias("word"), (at % 64).alias("bit")).groupBy("word").agg(F.bit_or(F.expr("shiftleft(1L, CAST(bit AS INT))")).alias("bits"))
    bits = np.zeros(BITS // 64, np.int64)
    for r in marks.collect():  # at most BITS / 64 rows
        bits[r.word] = r.bits
    sizes = {r.words for r in windows.where(F.col("words") < WINDOW).select("words").distinct().collect()}  # at most WINDOW - 1 rows
    shared = spark.sparkContext.broadcast((bits.view(np.uint64), sizes))
    met = rows.select("uid", "doc_id", "text").mapInArrow(_document_windows(shared), "uid bigint, doc_id bigint, form int, h bigint")
    needed = windows.groupBy("item", "form").agg(F.count(F.lit(1)).alias("of"))
    found = met.join(windows.select("item", "form", "h"), ["form", "h"]).groupBy("uid", "doc_id", "item", "form").agg(F.count_distinct("h").alias("met"))
    found = found.join(needed, ["item", "form"]).where(F.col("met") >= COVER * F.col("of")).select("uid", "item").distinct()
    wanted = materialize(found.join(items, "item").groupBy("uid").agg(F.collect_list(F.struct("item_id", "text")).alias("items")))
    few = rows.join(checked(wanted.select("uid")), "uid", "left_semi")
    return few.join(wanted, "uid").select("uid", "doc_id", "text", "items")


def findings(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, coverage, verbatim) for each contaminated document and item."""
    return _pairs(docs, benchmark).select("doc_id", "text", "items").mapInArrow(_verify, "doc_id bigint, item_id bigint, coverage double, verbatim boolean")


def _dirty(batches):
    for batch in (part for batch in batches for part in chunks(batch, 2)):
        keep = [bool(Index([(i["item_id"], i["text"]) for i in items]).matches(text)) for text, items in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
        yield batch.select(["uid", "doc_id"]).filter(pa.array(keep, pa.bool_()))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs, all columns as they are, without contaminated documents."""
    return without(docs, _pairs(docs, benchmark).mapInArrow(_dirty, "uid bigint, doc_id bigint"))


def op4_decontaminate(spark, sf_dir):
    return findings(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


QUERIES = {"op4_decontaminate": op4_decontaminate}
SQL = {}
