"""The operators against brute force on small fixtures with nulls, ties, repeats, long and empty texts."""

import collections
import hashlib
import random
import re
import struct
import zlib

import pytest
import xxhash
from pyspark.sql import functions as F

from hornlake.llm import decontaminate, exact_dedup, line_dedup, packing, pretokens, secret_scan, sharding, simhash, suffix_dedup, token_counts, toxicity

SCHEMA = "doc_id bigint, text string, uid string, kept string, `count` int, source string"
WORDS = "the of and alpha beta gamma delta eins zwei drei Größe naïve don't it's 42 7 x".split()


def texts():
    rnd = random.Random(5)
    out = [None, "", "", " ", "a", "a", "one two", "Σίσυφος <|endoftext|> İ 漢字 \x1c", "A\nB 1\nA\n\nB 2\r\nB 3", "password = hunter22 token:abc AKIA" + "B" * 17 + " " + "0af" * 9]
    base = [rnd.choice(WORDS) for _ in range(120)]
    for i in range(6):
        edited = list(base)
        if i:
            edited[i * 7] = f"edit{i}"
        out.append(" ".join(edited))
    out += [" ".join(rnd.choice(WORDS) for _ in range(n)) for n in (3, 40, 300, 6000)]
    return out + ["y" * 500, "y" * 500, "copy of a text " * 20, "copy of a text " * 20]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i if i % 9 else None, t, "u", "k", 1, None) for i, t in enumerate(texts())]
    return spark.createDataFrame(rows + [rows[-1], rows[6]], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def plain(docs):
    return [(r.doc_id, r.text or "") for r in docs.collect()]


def bag(rows):
    return collections.Counter(map(tuple, rows))


@pytest.mark.parametrize("keep", ["min", "max"])
@pytest.mark.parametrize("hot", [2, 32])
def test_exact_dedup(docs, empty, plain, keep, hot, monkeypatch):
    monkeypatch.setattr(exact_dedup, "HOT_LEAST", hot)  # both ways: folded before the sort, and sorted
    groups = collections.defaultdict(list)
    for i, t in plain:
        groups[t].append(i)
    best = {t: {"min": min, "max": max}[keep]((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    got = exact_dedup.exact_dedup(docs, keep)
    assert set(docs.columns) - {"kept"} < set(got.columns)
    expected = bag((i, best[t], len(groups[t]), i == best[t], hashlib.sha256(t.encode()).hexdigest()) for i, t in plain)
    assert bag(got.select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()) == expected
    assert exact_dedup.exact_dedup(empty).count() == 0


def test_sharding(docs, empty, plain):
    got = sharding.shard(docs, 7).collect()
    slots = collections.defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
        assert r.grown_shard in (r.shard, 7) and 0 <= r.shard < 7
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert bag((r.doc_id, r.size, r.text_crc32) for r in got) == bag((i, len(t.encode()) + 16, zlib.crc32(t.encode())) for i, t in plain)
    assert len({(r.doc_id, r.shard) for r in got}) == len({r.doc_id for r in got})
    assert sharding.shard(empty, 7).count() == 0


def jump(key, shards):
    """The published recurrence, with this module's stream."""
    state, b, j = xxhash.xxh64_intdigest(struct.pack("<Q", key), 42), -1, 0
    while j < shards:
        b = j
        draw = ((state >> 33) + 1) / float(1 << 31)
        j = int((b + 1) / draw)
        state = xxhash.xxh64_intdigest(struct.pack("<Q", state), 42)
    return b


@pytest.mark.parametrize("shards", [1, 7, 40, 41])
def test_jump_row_by_row(spark, shards):
    keys = [*range(-3, 400), 2**62, -(2**63)]
    got = spark.createDataFrame([(k,) for k in keys], "k bigint").select("k", sharding.jump_shard(F.col("k"), shards).alias("s")).collect()
    assert {r.k: r.s for r in got} == {k: jump(k % 2**64, shards) for k in keys}


def test_jump_balance(spark):
    from pyspark.sql import functions as F

    key = F.xxhash64("id")
    rows = spark.range(20000).select(sharding.jump_shard(key, 10).alias("a"), sharding.jump_shard(key, 11).alias("b"))
    sizes = [r["count"] for r in rows.groupBy("a").count().collect()]
    assert len(sizes) == 10 and max(sizes) < 2300 and min(sizes) > 1700
    assert rows.where("a <> b AND b <> 10").count() == 0
    assert 1500 < rows.where("b = 10").count() < 2150


def test_secret_scan(docs, empty, plain):
    rules = [("assign", re.compile(r"""(?:(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), lambda m: len(m[1]) >= 6), ("access", re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20), ("hex", re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 24)]
    expected = bag((i, tuple(sorted((m.start(), k, m.end()) for k, (_, p, ok) in enumerate(rules) for m in p.finditer(t) if ok(m)))) for i, t in plain)
    found, fresh = secret_scan.scan(docs)
    got = found.collect()
    assert bag((r.doc_id, tuple(map(tuple, r.found))) for r in got) == expected and any(r.found for r in got)
    again, added = secret_scan.scan(docs, fresh)
    assert added.count() == 0 and bag((r.doc_id, tuple(map(tuple, r.found))) for r in again.collect()) == expected
    assert secret_scan.scan(empty)[0].count() == 0


def test_token_counts_and_pieces(docs, empty, plain):
    library = pretokens.WordIds().library
    assert bag(token_counts.token_counts(docs).collect()) == bag((i, len(t.encode()), len(library.encode(t, add_special_tokens=False).ids)) for i, t in plain)
    assert token_counts.token_counts(empty).count() == 0
    expected = collections.Counter()
    for i, t in plain:
        ids = library.encode(t, add_special_tokens=False).ids + [0]
        for n, at in enumerate(range(0, len(ids), 512)):
            part = ids[at : at + 512]
            expected[i, n, at, len(part), zlib.crc32(struct.pack(f"<{len(part)}I", *part))] += 1
    pieces = packing.pieces(docs, 512)
    assert bag(pieces.collect()) == expected
    packed = packing.pack(pieces, 512).collect()
    bins = collections.defaultdict(list)
    for r in packed:
        bins[r.sequence_id].append((r.offset, r.length))
    for held in bins.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 512
    assert len(packed) == sum(expected.values()) and packing.pack(packing.pieces(empty), 512).count() == 0


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_plan(rule):
    rnd = random.Random(3)
    for _ in range(20):
        counts = {rnd.randint(1, 100): rnd.randint(1, 400) for _ in range(30)}
        runs, bins = packing.plan(counts, 100, documents=9, attention=9000 if max(counts) <= 94 else None, rule=rule)
        load, seen = collections.defaultdict(list), collections.Counter()
        for length, rank, n, first, offset in runs:
            for k in range(n):
                load[first + k].append((offset, length))
                seen[length, rank + k] += 1
        assert seen == collections.Counter({(length, i): 1 for length, n in counts.items() for i in range(n)}) and len(load) == bins
        for held in load.values():
            held.sort()
            assert sum(x for _, x in held) <= 100 and len(held) <= 9
            assert [o for o, _ in held] == [sum(x for _, x in held[:i]) for i in range(len(held))]


def brute_simhash(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", bytes(c + 32 if 65 <= c <= 90 else c for c in text.encode()))
    parts = [b" ".join(words[k : k + 3]) for k in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << k for k in range(64) if sum(h >> k & 1 for h in hashes) * 2 > len(hashes))


def test_simhash(docs, empty, plain):
    prints = [brute_simhash(t) for _, t in plain]
    parent = list(range(len(plain)))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a in range(len(plain)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= 2:
                parent[find(a)] = find(b)
    least = collections.defaultdict(list)
    for n, (i, _) in enumerate(plain):
        least[find(n)].append(i)
    low = {k: min((i for i in v if i is not None), default=None) for k, v in least.items()}
    got = simhash.simhash_components(docs).collect()
    assert bag((r.doc_id, r.fp % (1 << 64), r.component_id) for r in got) == bag((i, prints[n], low[find(n)]) for n, (i, _) in enumerate(plain))
    assert simhash.simhash_components(empty).count() == 0


def test_keep_one(docs, empty, plain):
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    left = [r.text for r in kept.collect()]
    sets = {t: set(simhash.shingles((t or "").encode(), 5)) for t in left}
    for a in sets:
        for b in sets:
            if a != b and (sets[a] or sets[b]):
                assert len(sets[a] & sets[b]) < 0.8 * len(sets[a] | sets[b])
    assert {"one two", "a", "y" * 500} <= set(left)
    assert simhash.keep_one(empty).count() == 0


def jaccard_components(texts):
    sets = [set(simhash.shingles(t.encode(), 5)) for t in texts]
    of = list(range(len(sets)))
    for a in range(len(sets)):
        for b in range(a):
            if of[a] != of[b] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                of = [of[b] if x == of[a] else x for x in of]
    return len(set(of))


@pytest.mark.parametrize("base_too", [True, False])
def test_keep_one_family(spark, base_too):
    """Copies within 0.8 of their base and mostly not of each other, with and without the base."""
    rnd = random.Random(8)
    base = [f"w{rnd.randrange(3000)}" for _ in range(300)]
    family = [" ".join(base)] * base_too + [" ".join(f"x{rnd.randrange(10**6)}" if rnd.random() < 0.02 else w for w in base) for _ in range(300)]
    family += [" ".join(f"z{rnd.randrange(3000)}" for _ in range(200)) for _ in range(20)]
    rnd.shuffle(family)
    left = simhash.keep_one(spark.createDataFrame(list(enumerate(family)), "doc_id bigint, text string")).count()
    assert left == jaccard_components(family)


def test_keep_one_recall(spark):
    """Every pair at 0.8 to 0.9 is found: text appended, text trimmed, words replaced."""
    rnd = random.Random(9)
    word = lambda: f"w{rnd.randrange(5000)}"
    kinds, rows = ("appended", "trimmed", "scattered"), []
    for kind in kinds:
        for n in range(200):
            while True:
                base = [word() for _ in range(300)]
                k = rnd.randint(30, 75)
                other = {"appended": base + [word() for _ in range(k)], "trimmed": base[: 300 - k * 4 // 5], "scattered": [word() if rnd.random() < 0.02 else w for w in base]}[kind]
                a, b = (set(simhash.shingles(" ".join(t).encode(), 5)) for t in (base, other))
                if 4 * len(a | b) <= 5 * len(a & b) and 10 * len(a & b) <= 9 * len(a | b):
                    break
            rows += [(kind, " ".join(base)), (kind, " ".join(other))]
    docs = spark.createDataFrame([(i, t, k) for i, (k, t) in enumerate(rows)], "doc_id bigint, text string, kind string")
    left = collections.Counter(r.kind for r in simhash.keep_one(docs).select("kind").collect())
    assert left == dict.fromkeys(kinds, 200)


def test_suffix_dedup(docs, empty, plain, monkeypatch):
    count = collections.Counter(t.encode()[s : s + 200] for _, t in plain for s in range(len(t.encode()) - 199))
    expected = collections.Counter()
    for i, t in plain:
        body = t.encode()
        gone = bytearray(len(body))
        for s in range(len(body) - 199):
            if count[body[s : s + 200]] > 1:
                gone[s : s + 200] = b"\1" * 200
        left = bytes(c for c, g in zip(body, gone) if not g)
        expected[i, len(body), len(body) - len(left), len(re.findall(b"\1+", bytes(gone))), left] += 1
    for group, segment in ((2000, 1 << 22), (1, 600)):  # usual and split minimizers, whole and dealt texts
        monkeypatch.setattr(suffix_dedup, "GROUP", group)
        monkeypatch.setattr(suffix_dedup, "SEGMENT", segment)
        assert bag((*r[:4], bytes(r[4])) for r in suffix_dedup.suffix_dedup(docs).collect()) == expected
    assert suffix_dedup.suffix_dedup(empty).count() == 0


def test_line_dedup(spark, docs, empty, plain):
    shared = "this notice stands in every text of the set"
    fields = "user {} logged in from the north gate at noon today"
    names = ["ann", "bob", "cat", "dan"]
    rows = [(i, f"own line {chr(97 + i)} only here\n{shared}\ncounter {i} of 9\n{fields.format(names[i])}\n\nlast") for i in range(4)]
    got = {r.doc_id: r for r in line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id int, text string")).collect()}
    for i in range(4):
        assert got[i].n_lines == 6 and got[i].kept_text.startswith(f"own line {chr(97 + i)} only here\n")
        assert shared not in got[i].kept_text and "counter" not in got[i].kept_text and names[i] not in got[i].kept_text
        assert got[i].n_dropped == 4
    fewer = line_dedup.line_dedup(docs).collect()
    assert len(fewer) == len(plain) and line_dedup.line_dedup(empty).count() == 0


def test_generalised_fields(spark):
    rows = [(i, f"disk {n} on the third rack reports that all is well now") for i, n in enumerate(["alpha", "beta", "gamma", "delta"])]
    rows += [(9, "disk omega on the entirely different thing nobody else has ever written")]
    rows = [(i, "server " + t) for i, t in rows]
    got = {r.doc_id: r.n_dropped for r in line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id int, text string")).collect()}
    assert got == {0: 1, 1: 1, 2: 1, 3: 1, 9: 0}


def test_two_templates_in_a_leaf(spark):
    rows = [(i, f"the new service on {kind} {name} is up and running again") for i, (kind, name) in enumerate((k, n) for k in ("host", "port") for n in ("ann", "bob", "cat", "dan"))]
    rows += [(20 + i, f"the new service on line {' '.join(random.Random(i).choices(WORDS, k=6))}") for i in range(3)]
    got = {r.doc_id: r.n_dropped for r in line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id int, text string")).collect()}
    assert got == {i: int(i < 8) for i in (*range(8), 20, 21, 22)}


def brute_lines(rows, min_docs=3):
    """{(doc, line number)} dropped, by the rules of the module's docstring alone."""
    masked = {(d, n): " ".join("<*>" if re.search("[0-9]", w) else w for w in line.split(" ") if w) for d, t in rows for n, line in enumerate((t or "").split("\n"))}
    holders = collections.defaultdict(set)
    for (d, _), line in masked.items():
        if line:
            holders[line].add(d)
    dropped, leaves = {line for line, ds in holders.items() if len(ds) >= min_docs}, collections.defaultdict(list)
    for line in holders:
        words = line.split(" ")
        if len(words) >= line_dedup.LEAST_TOKENS:
            for part in (0, 1):
                leaves[len(words), part, *words[part * line_dedup.LEAD : (part + 1) * line_dedup.LEAD]].append(line)
    for (_, part, *_), lines in leaves.items():
        others = lambda line: [f for f in enumerate(line.split(" ")) if f[0] // line_dedup.LEAD != part]  # noqa: E731, B023
        held = collections.Counter()
        for line in lines:
            held.update({f: len(holders[line]) for f in others(line)})
        groups = collections.defaultdict(list)
        for line in lines:
            same = tuple(f for f in others(line) if held[f] >= min_docs)
            if same and len(same) + line_dedup.LEAD >= line_dedup.SIMILAR * len(line.split(" ")):
                groups[same].append(line)
        for group in groups.values():
            if len(set().union(*(holders[line] for line in group))) >= min_docs:
                dropped.update(group)
    return {at for at, line in masked.items() if line in dropped}


@pytest.mark.parametrize("seed", range(2))
def test_line_dedup_brute_force(spark, seed):
    rnd = random.Random(seed)
    forms = ["user {} came in from the north gate at noon", "see {} for more on this and {} other things today", "all rights are reserved by {} and its partners in trade", "{} is {} here", "short {}"]
    value = lambda: rnd.choice(["ann", "bob", "cat", "dan", "eve", "7", "x9"] + [f"v{chr(97 + i)}z" for i in range(20)])
    line = lambda: rnd.choice(forms).replace("{}", value(), 1).replace("{}", value()) if rnd.random() < 0.7 else " ".join(rnd.choices(WORDS, k=rnd.randint(0, 9)))
    rows = [(i, "\n".join(line() for _ in range(rnd.randint(0, 5)))) for i in range(60)]
    rows += [(100, None), (101, ""), (102, rows[0][1])]
    gone = brute_lines(rows)
    got = {r.doc_id: r for r in line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id int, text string")).collect()}
    for d, t in rows:
        lines = (t or "").split("\n")
        kept = [x for n, x in enumerate(lines) if (d, n) not in gone]
        assert (got[d].n_lines, got[d].n_dropped, got[d].kept_text) == (len(lines), len(lines) - len(kept), "\n".join(kept)), d
    assert any(got[d].n_dropped for d, _ in rows)


def test_decontaminate(spark, docs, empty):
    item = "In total Anna has 12 apples and gives 5 kg of them to Bob before Anna leaves the big market in Paris for work"
    bench = spark.createDataFrame([(1, item, 0), (2, None, 0), (3, "", 0), (4, "two words", 0)], "item_id int, text string, doc_id int")
    rows = [
        (1, "before it. " + item + " and after", "x"),
        (2, item.replace("Anna", "Carla").replace("12", "77").replace("Bob", "Mike").replace("Paris", "Rome"), "x"),
        (3, item.replace("has 12", "sees no").replace("gives 5 kg", "wants none").replace("leaves", "finds"), "x"),
        (4, "the of and", "x"), (None, item.upper(), "x"), (6, None, "x"), (7, "two words", "x"), (8, "two words more", "x"),
    ]
    df = spark.createDataFrame(rows, "doc_id int, text string, item_id string")
    got = {(r.doc_id, r.item_id): r.verbatim for r in decontaminate.findings(df, bench).collect()}
    assert got[1, 1] is True and got[2, 1] is False and got[7, 4] is True
    assert not {d for d, _ in got} & {3, 4, 6}
    assert {r.doc_id for r in decontaminate.clean(df, bench).collect()} >= {3, 4, 6}
    assert decontaminate.findings(empty, bench).count() == 0 and decontaminate.findings(docs, bench.limit(0)).count() == 0
    mixed = item.replace("before Anna", "before Dora").replace("has 12", "has 12")
    assert [m for m in decontaminate.Index([(1, item)]).matches(mixed) if m[2]] == []


def test_decontaminate_typing():
    """A copy pasted inside a sentence, in a long text whose headings capitalise its words."""
    item = "The river is wide and the old bridge is long, et the men of the town walk over it when the sun is low"
    heading = "Notes On The River And The Old Bridge Is It Wide Et Long When Men Walk Over Town Sun Low Of"
    index = decontaminate.Index([(1, item)])
    filler = " ".join(f"other{chr(97 + n % 26)} words{chr(97 + n // 26)}" for n in range(500))
    for text in (f"as they said {item} and so on", f"{heading}. {filler} as they said {item} {filler}", item.title()):
        assert [(m[0], m[2]) for m in index.matches(text)] == [(1, True)]
    changed = "Anna sees the wide river and the old bridge of the town before Bob walks over it when the sun is low"
    long = f"{heading}. {filler}. " + changed.replace("Anna", "Carla").replace("Bob", "Mike")
    assert [m[0] for m in decontaminate.Index([(1, "In time " + changed)]).matches(long.replace("Carla", "In time Carla"))] == [1]
    assert index.matches(f"{heading}. {filler}") == []


def test_decontaminate_problems():
    """Items of numbers and names mostly, and items that repeat their own windows."""
    sums = "7 + 5 = 12 and 8 + 6 = 14"
    apples = "John has 3 apples and Mary has 5 apples and Tom has 7 apples"
    index = decontaminate.Index([(1, sums), (2, apples)])
    for n, item in ((1, sums), (2, apples)):
        assert [(m[0], m[2]) for m in index.matches(f"see this. {item}. And so on")] == [(n, True)]
    other = "so Anna has 4 apples and Carla has 6 apples and Mike has 9 apples"
    assert [(m[0], m[2]) for m in index.matches(other)] == [(2, False)]
    assert index.matches("9 + 1 = 10 and 2 + 2 = 4") == []


def test_toxicity(spark, empty):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = {r.doc_id: r for r in toxicity.op3_toxicity(spark, sf).collect()}
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for i, r in got.items())
    wrong = sum(got[i].predicted != y for i, y in truth.items() if got[i].held_out)
    assert wrong <= 0.1 * sum(got[i].held_out for i in truth)
    assert toxicity.score(empty, labels).count() == 0
    odd = spark.createDataFrame([(None, None, 1), (5, "", 2), (5, "", 2), (6, "moron idiot scum " * 3, 3)], "doc_id bigint, text string, toxic int")
    assert toxicity.score(odd, labels.limit(0)).count() == 4
    assert [r.score for r in toxicity.score(odd, labels).collect()] == [0.0] * 4  # no labelled row is among these
    assert toxicity.keep_clean(docs, labels).columns == docs.columns


def test_block_max_is_exact():
    import numpy as np

    rnd = random.Random(1)
    idf = np.linspace(1, 3, 40)

    def vector():
        ids = sorted(rnd.sample(range(40), rnd.randint(0, 5)))
        return toxicity.unit_vector(ids, [rnd.randint(1, 4) for _ in ids], idf)

    examples = [(*vector(), rnd.randint(0, 1), 1.0, n) for n in range(700)]
    index = toxicity.BlockMaxIndex(examples, 40)
    for _ in range(30):
        ids, weights = vector()
        q = dict(zip(ids.tolist(), weights))
        all_rows = sorted((round(float(sum(q.get(int(t), 0) * w for t, w in zip(e[0], e[1]))), 9) for e in examples), reverse=True)[:25]
        near = index.nearest(ids, weights, 25)
        mine = [round(c, 9) for c, e, share in near for _ in range(round(share * index.sizes[e]))]
        assert mine == pytest.approx(all_rows, abs=1e-8)
    starts, levels = toxicity.isotonic([0.1, 0.2, 0.2, 0.3, 0.9], [0, 1, 0, 0, 1], [1.0] * 5)
    assert levels == sorted(levels) and levels[0] == 0 and levels[-1] == 1
