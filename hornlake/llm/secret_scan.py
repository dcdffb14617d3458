r"""Secret scans with an incremental blob ledger.

Every version of a text is addressed by its SHA-256.  The ledger holds (blob, rule_version) pairs that
were scanned and what was found; a run scans only the pairs the ledger lacks, once per blob however
many paths carry it, and joins the findings back to all paths.

Spans come from native regular expressions: splitting a text by a pattern gives the gaps between its
leftmost non-overlapping matches, and running lengths of gaps and matches give the positions.

Defined cases: a null text is empty and has no spans; a null id is a path like any other; repeated
rows repeat their findings.  Offsets count code points, the end is exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import id_text, materialize

# Kinds in order, pattern, test of a match's least length.
RULES = [
    ("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+""", None),
    ("access", r"AKIA[A-Z0-9]+", 20),
    ("hex", r"[0-9a-f]{24,}+", 24),
]
ASSIGN_VALUE = r"""^(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)$"""
RULE_VERSION = "base-1"
BLOCK = 128


def spans(text: Column, rank: int, kind: str, pattern: str, least: int | None) -> Column:
    """array<struct<s, k, e>> of the matches that pass, s and e in code points."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    empty = F.array().cast("array<struct<s:int,k:int,e:int>>")

    def step(acc, pair):
        start = acc["at"] + F.length(pair["gap"])
        end = start + F.length(pair["hit"])
        passes = F.length(pair["hit"]) >= least if least else F.length(F.regexp_extract(pair["hit"], ASSIGN_VALUE, 1)) >= 6
        span = F.array(F.struct(start.alias("s"), F.lit(rank).alias("k"), end.alias("e")))
        return F.struct(end.alias("at"), F.when(passes, F.concat(acc["out"], span)).otherwise(acc["out"]).alias("out"))

    def block(acc, some):
        walked = F.aggregate(some, F.struct(acc["at"].alias("at"), empty.alias("out")), step)
        return F.struct(walked["at"].alias("at"), F.concat(acc["out"], F.array(walked["out"])).alias("out"))

    pairs = F.arrays_zip(found.alias("hit"), F.slice(gaps, 1, F.greatest(F.size(found), F.lit(0))).alias("gap"))
    # Matches in blocks, so that what a step copies is bounded and a text's cost is linear in its matches.
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(found) - 1) / BLOCK).cast("int")), lambda i: F.slice(pairs, i * BLOCK + 1, BLOCK))
    nested = F.array().cast("array<array<struct<s:int,k:int,e:int>>>")
    walked = F.aggregate(blocks, F.struct(F.lit(0).alias("at"), nested.alias("out")), block, lambda acc: F.flatten(acc["out"]))
    return F.when(text.rlike(pattern), walked).otherwise(empty)


def scan_blobs(blobs: DataFrame) -> DataFrame:
    """(blob, rule_version, found) for rows of (blob, text)."""
    all_spans = F.concat(*[spans(F.col("text"), i, *rule) for i, rule in enumerate(RULES)])
    return blobs.select("blob", F.lit(RULE_VERSION).alias("rule_version"), F.array_sort(all_spans).alias("found"))


def scan(docs: DataFrame, ledger: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(findings per path, ledger entries that this run adds).

    ledger: (blob, rule_version, found) of earlier runs; pairs in it are not scanned again.
    """
    rows = id_text(docs).withColumn("blob", F.sha2(F.col("text").cast("binary"), 256))
    unseen = rows
    if ledger is not None:
        unseen = rows.join(ledger.where(F.col("rule_version") == RULE_VERSION).select("blob"), "blob", "left_anti")
    fresh = materialize(scan_blobs(unseen.groupBy("blob").agg(F.first("text").alias("text"))))
    known = fresh if ledger is None else fresh.unionByName(ledger.where(F.col("rule_version") == RULE_VERSION).select("blob", "rule_version", "found"))
    return rows.select("doc_id", "blob").join(known.select("blob", "found"), "blob"), fresh


def op10_secret_scan(spark, sf_dir):
    """Two runs over all documents: the first finds half of the versions, the second all, with the first one's ledger."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    _, ledger = scan(docs.where(F.coalesce(F.xxhash64("text") >= 0, F.lit(True))))
    found, _ = scan(docs, ledger)
    kinds = F.array(*[F.lit(k) for k, _, _ in RULES])
    text = F.array_join(F.transform("found", lambda x: F.concat_ws(":", F.get(kinds, x["k"]), x["s"], x["e"])), ",")
    count = lambda i: F.size(F.filter("found", lambda x: x["k"] == i)).cast("bigint")
    return found.select("doc_id", *[count(i).alias(f"n_{k}") for i, (k, _, _) in enumerate(RULES)], F.sha2(text.cast("binary"), 256).alias("base_sha256"), text.alias("spans"))


QUERIES = {"op10_secret_scan": op10_secret_scan}
def _sql() -> str:
    """Gaps and matches of each pattern in turn give the positions, as in `spans`."""
    plain = [(k, p.replace("}+", "}"), least) for k, p, least in RULES]
    quote = lambda t: "'" + t.replace("'", "''") + "'"
    parts = []
    for rank, (kind, pattern, least) in enumerate(plain):
        passes = f"length(hits[i]) >= {least}" if least else f"length(regexp_extract(hits[i], {quote(ASSIGN_VALUE)}, 1)) >= 6"
        place = "list_sum(list_transform(gaps[1:i], lambda g: length(g)))::BIGINT + coalesce(list_sum(list_transform(hits[1:i - 1], lambda h: length(h))), 0)::BIGINT"
        parts.append(f"SELECT rid, {rank} AS k, '{kind}' AS kind, {place} AS s, {place} + length(hits[i]) AS e FROM (SELECT rid, hits, gaps, unnest(range(1, len(hits) + 1)) AS i FROM (SELECT rid, regexp_extract_all(t, {quote(pattern)}) AS hits, string_split_regex(t, {quote(pattern)}) AS gaps FROM d)) WHERE {passes}")
    counts = ", ".join(f"count(*) FILTER (WHERE k = {i}) AS n_{kind}" for i, (kind, _, _) in enumerate(plain))
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
found AS ({' UNION ALL '.join(parts)}),
summed AS (SELECT rid, {counts}, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k) AS spans FROM found GROUP BY rid)
SELECT doc_id, {', '.join(f'coalesce(n_{k}, 0) AS n_{k}' for k, _, _ in plain)}, sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN summed USING (rid)"""


SQL = {"op10_secret_scan": _sql()}
