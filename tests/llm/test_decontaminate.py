"""The hash join of windows against a comparison of every document with every item, and copies in odd forms."""

import random

from hornlake.llm import decontaminate
from hornlake.llm.decontaminate import COVER, Index, typed, windows

SF = "/root/testdata/sf0.001"


def every_pair(docs, items):
    return [(d, *m) for d, t in docs for item in dict.fromkeys(items) for m in Index([item]).matches(t or "")]


def test_join_equals_every_pair(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    rnd = random.Random(2)
    for n, (_, text) in enumerate(rnd.sample(items, 6)):
        words = text.split()
        cut = rnd.randint(0, len(words) // 4)
        docs += [(10_000 + n, f"{docs[n][1]} {text} {docs[n + 1][1]}"), (20_000 + n, " ".join(words[cut:])), (30_000 + n, text.upper())]
    items += [(900, "John has 3 apples and Mary has 5 apples so together they own 8 apples"), (901, "two words"), (902, ""), (903, None), (None, "one null item with seven plain words"), (901, "two words")]
    docs += [(40_000, "Then Paul has 4 pears and Anna has 9 apples so together they own 13 apples"), (40_001, "two words"), (40_002, "say two words now"), (40_003, None), (40_004, ""), (40_005, "ONE null ITEM with seven plain WORDS"), (None, "two words"), (40_001, "two words")]
    got = decontaminate.findings(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id int, text string")).collect()
    expected = every_pair(docs, [(i, t or "") for i, t in items])
    key = lambda r: tuple((x is None, x if x is not None else 0) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(expected, key=key) and len(got) > 15


def test_letter_case_and_surroundings(spark):
    item = "In total Anna has 12 apples and The Big Market Gives Of It a crate for every child"
    docs = [(1, item.lower()), (2, item.upper()), (3, f"The Big Market Has And Gives Of It. {item}"), (4, "nothing of the kind is here"), (5, "x " * 20_000 + item)]
    got = decontaminate.findings(spark.createDataFrame(docs, "doc_id int, text string"), spark.createDataFrame([(7, item)], "item_id int, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(1, 7), (2, 7), (3, 7), (5, 7)}


def test_recall_of_verbatim_passages(spark):
    """Every (document, item) of sf0.01 that holds COVER of an item's plain windows in one stretch is found."""
    sf = "/root/testdata/sf0.01"
    docs, bench = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    found = {(r.doc_id, r.item_id) for r in decontaminate.findings(docs, bench).collect()}
    items = [(r.item_id, windows(typed(r.text)[1])) for r in bench.collect()]
    cases = lost = 0
    for r in docs.collect():
        held = set(windows(typed(r.text)[1]))
        for item, parts in items:
            if set(parts) <= held:
                cases, lost = cases + 1, lost + ((r.doc_id, item) not in found)
    assert cases > 10 and lost == 0 and COVER == 0.8
