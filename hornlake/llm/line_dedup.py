r"""Line dedup with a log-template tree of fixed depth.

A line's tokens that hold a digit become <*>.  The tree's first level is the token count.  Below it a line goes
by its first LEAD tokens, and also, past a wildcard child at each of these, by the next LEAD: so it hangs at two
leaves, and lines that differ in a leading token still meet.  Which leaves a line is in depends on the line alone.

A leaf holds several templates.  Its own tokens are constant, and so is another token if lines of
min_docs documents of the leaf have it at its position, counting a document once a distinct line; all other
tokens are variable fields.
Lines with the same constants, at least SIMILAR of their tokens, form a generalised template.  Templates,
masked or generalised, that occur in min_docs documents are dropped from all of them.

Only hashes of lines travel to be counted; counts are pre-aggregated per task, so a line found in a
third of all documents costs one row per task, and the most frequent dropped templates (at most
HOT_SHARE) meet the lines by broadcast.

Defined cases: null text is empty; blank lines never count as templates and stay; repeated rows are
one document; a document with no other lines becomes empty or blank; lines of fewer than LEAST_TOKENS are
not generalised, nor are those with a field in either LEAD tokens; a value that min_docs documents of a leaf
share is a constant, and its lines a template of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import forget, id_text, materialize, partitions, row_key

LEAD, SIMILAR = 3, 0.7
LEAST_TOKENS = 8  # of fewer, one field is too much to tell a template from sentences alike
HOT_SHARE = 2000
TEMPLATE = ["n_tokens", "t1", "t2"]


def masked_line(line: Column) -> Column:
    """The line with single spaces and <*> for tokens that hold a digit; most lines only get scanned."""
    odd = line.rlike(r"[\t\r\f]|\x20\x20")
    squeezed = F.trim(F.when(odd, F.regexp_replace(line, r"[\x20\t\r\f]+", " ")).otherwise(line))
    return F.when(line.rlike("[0-9]"), F.regexp_replace(squeezed, r"(?<![^\x20])[^\x200-9]*+[0-9][^\x20]*+", "<*>")).otherwise(squeezed)


def parsed_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, uid, line_no, n_tokens, t1, t2, leaves) of every line; leaves: hashes, null where there are too few tokens."""
    lines = docs.select("doc_id", "uid", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    lines = lines.select("doc_id", "uid", "line_no", masked_line(F.col("line")).alias("masked"))
    spaces = F.octet_length("masked") - F.octet_length(F.replace("masked", F.lit(" "), F.lit("")))
    lines = lines.withColumn("n_tokens", F.when(F.col("masked") == "", 0).otherwise(spaces + 1))
    part = lambda i: F.xxhash64("n_tokens", F.lit(i), F.substring_index(F.substring_index("masked", " ", (i + 1) * LEAD), " ", -LEAD))
    hashes = F.xxhash64("masked").alias("t1"), F.xxhash64(F.lit(1), "masked").alias("t2")
    return lines.select("doc_id", "uid", "line_no", "n_tokens", *hashes, F.when(F.col("n_tokens") >= LEAST_TOKENS, F.array(part(0), part(1))).alias("leaves"))


def generalised(texts: DataFrame, weights: DataFrame, per_doc: DataFrame, min_docs: int) -> DataFrame:
    """Masked templates (TEMPLATE columns) that belong to a generalised template of min_docs documents.

    texts: (uid, text), dealt by uid.  One representative line per template is read from there.
    weights: (TEMPLATE, docs, at, leaves) per masked template; per_doc: (TEMPLATE, uid).
    """
    below = weights.where("leaves IS NOT NULL").select(*TEMPLATE, "docs", "at", F.posexplode("leaves").alias("part", "leaf"))
    leaves = below.groupBy("leaf").agg(F.sum("docs").alias("leaf_docs"), F.count(F.lit(1)).alias("kinds"), F.min("docs").alias("rarest"))
    leaves = leaves.where((F.col("leaf_docs") >= min_docs) & (F.col("kinds") > 1) & (F.col("rarest") < min_docs))
    held = below.join(leaves.select("leaf"), "leaf").groupBy(*TEMPLATE).agg(F.first("docs").alias("docs"), F.first("at").alias("at"), F.collect_set(F.struct("part", "leaf")).alias("leaves"))
    wanted = held.select("at.uid", F.struct(F.col("at.line_no").alias("line_no"), *TEMPLATE, "docs", "leaves").alias("one")).groupBy("uid").agg(F.collect_list("one").alias("reps"))
    found = texts.join(wanted.hint("shuffle_hash"), "uid").select(F.split("text", "\n").alias("parts"), F.explode("reps").alias("r"))
    bodies = found.select("r.*", masked_line(F.get("parts", F.col("r.line_no"))).alias("masked"))
    places = F.transform(F.split("masked", " "), lambda w, i: F.xxhash64(i, w))
    cells = materialize(bodies.select(*TEMPLATE, "docs", "leaves", places.alias("fields")))
    rest = F.expr(f"CASE part WHEN 0 THEN slice(fields, {LEAD + 1}, n_tokens) ELSE concat(slice(fields, 1, {LEAD}), slice(fields, {2 * LEAD + 1}, n_tokens)) END")
    each = cells.select("n_tokens", "t1", "docs", F.inline("leaves"), "fields")
    fields = each.select("leaf", "t1", "docs", F.explode(rest).alias("field"))
    constant = fields.groupBy("leaf", "field").agg(F.sum("docs").alias("held")).where(F.col("held") >= min_docs).select("leaf", "field")
    same = fields.select("leaf", "t1", "field").join(constant, ["leaf", "field"]).groupBy("leaf", "t1").agg(F.count(F.lit(1)).alias("same"), F.bit_xor("field").alias("constants"))
    kinds = cells.select(*TEMPLATE, "docs", F.inline("leaves")).join(same, ["leaf", "t1"])
    kinds = materialize(kinds.where(F.col("same") + LEAD >= SIMILAR * F.col("n_tokens")).select(*TEMPLATE, "docs", "leaf", "constants"))
    forget(cells)
    groups = kinds.groupBy("leaf", "constants").agg(F.max("docs").alias("most"), F.sum("docs").alias("all")).where((F.col("all") >= min_docs))
    rare = materialize(kinds.where(F.col("docs") < min_docs).join(groups, ["leaf", "constants"]))
    sure = rare.where(F.col("most") >= min_docs)
    # Each of these templates is in fewer than min_docs documents, so no key is hot here.
    spread = per_doc.join(rare.where(F.col("most") < min_docs).select(*TEMPLATE, "leaf", "constants"), TEMPLATE)
    spread = spread.groupBy("leaf", "constants").agg(F.count_distinct("uid").alias("n")).where(F.col("n") >= min_docs).select("leaf", "constants")
    return sure.select(*TEMPLATE).unionByName(rare.join(spread, ["leaf", "constants"], "left_semi").select(*TEMPLATE)).distinct()


def line_dedup(docs: DataFrame, min_docs: int = 3) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept_text) per document."""
    rows = id_text(docs).withColumn("uid", row_key())
    texts = rows.select("uid", "text").repartition(partitions(docs.sparkSession), "uid")
    known = materialize(parsed_lines(rows))
    per_doc = materialize(known.where("n_tokens > 0").groupBy(*TEMPLATE, "uid").agg(F.min("line_no").alias("line_no"), F.first("leaves").alias("leaves")))
    weights = per_doc.groupBy(*TEMPLATE).agg(F.count(F.lit(1)).alias("docs"), F.min(F.struct("uid", "line_no")).alias("at"), F.first("leaves").alias("leaves"))
    weights = materialize(weights)
    often = weights.where(F.col("docs") >= min_docs).select(*TEMPLATE, "docs")
    least = max(min_docs, per_doc.count() // HOT_SHARE)
    other = generalised(texts, weights, per_doc.select(*TEMPLATE, "uid"), min_docs).withColumn("docs", F.lit(0).cast("bigint"))
    dropped = materialize(often.unionByName(other))
    forget(per_doc), forget(weights)
    hot, usual = dropped.where(F.col("docs") >= least).select(*TEMPLATE), dropped.where(F.col("docs") < least).select(*TEMPLATE)
    lines = known.select("uid", "doc_id", "line_no", *TEMPLATE)
    met = lines.join(F.broadcast(hot.withColumn("hot", F.lit(True))), TEMPLATE, "left")
    rest = met.where("hot IS NULL").join(usual.withColumn("usual", F.lit(True)), TEMPLATE, "left").select("uid", "doc_id", "line_no", F.coalesce("usual", F.lit(False)).alias("drop"))
    flags = met.where("hot").select("uid", "doc_id", "line_no", F.lit(True).alias("drop")).unionByName(rest)
    flags = flags.groupBy("uid").agg(F.max("doc_id").alias("doc_id"), F.array_sort(F.collect_set(F.struct("line_no", "drop"))).alias("flags"))
    out = texts.join(flags.hint("shuffle_hash"), "uid")
    pairs = F.filter(F.arrays_zip(F.split("text", "\n").alias("line"), F.col("flags.drop").alias("drop")), lambda x: ~x["drop"])
    return out.select(
        "doc_id",
        F.size("flags").cast("bigint").alias("n_lines"),
        F.size(F.filter("flags", lambda x: x["drop"])).cast("bigint").alias("n_dropped"),
        F.array_join(F.transform(pairs, lambda x: x["line"]), "\n").alias("kept_text"),
    )


def op8_line_dedup(spark, sf_dir):
    out = line_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    body = F.col("kept_text").cast("binary")
    return out.select("doc_id", "n_lines", "n_dropped", F.length(body).cast("bigint").alias("kept_bytes"), F.sha2(body, 256).alias("kept_sha256"))


QUERIES = {"op8_line_dedup": op8_line_dedup}
SQL = {
    "op8_line_dedup": r"""
WITH u AS (SELECT row_number() OVER () AS uid, doc_id, t, copies FROM (SELECT doc_id, coalesce(text, '') AS t, count(*) AS copies FROM documents GROUP BY ALL)),
lines AS (SELECT uid, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS line_no FROM u),
masked AS (SELECT uid, line_no, line, array_to_string(list_transform(string_split(trim(regexp_replace(line, '[ \t\r\f]+', ' ', 'g')), ' '), lambda w: CASE WHEN regexp_matches(w, '[0-9]') THEN '<*>' ELSE w END), ' ') AS m FROM lines),
held AS (SELECT m, count(DISTINCT uid) AS docs, string_split(m, ' ') AS ws FROM masked WHERE m <> '' GROUP BY m),
leaves AS (SELECT m, docs, ws, len(ws) AS n, o, array_to_string(ws[3 * o + 1:3 * o + 3], ' ') AS lead FROM held, (SELECT unnest(range(0, 2)) AS o) WHERE len(ws) >= 8),
fields AS (SELECT * FROM (SELECT m, docs, n, o, lead, ws, unnest(range(1, n + 1)) AS pos FROM leaves) WHERE pos NOT BETWEEN 3 * o + 1 AND 3 * o + 3),
constants AS (SELECT n, o, lead, pos, ws[pos] AS word FROM fields GROUP BY ALL HAVING sum(docs) >= 3),
kinds AS (SELECT f.n, f.o, f.lead, f.m, string_agg(f.pos || ':' || c.word, ' ' ORDER BY f.pos) AS same FROM fields f JOIN constants c ON f.n = c.n AND f.o = c.o AND f.lead = c.lead AND f.pos = c.pos AND f.ws[f.pos] = c.word
          GROUP BY f.n, f.o, f.lead, f.m HAVING count(*) + 3 >= 0.7::DOUBLE * f.n),
groups AS (SELECT n, o, lead, same FROM kinds JOIN (SELECT DISTINCT uid, m FROM masked) USING (m) GROUP BY ALL HAVING count(DISTINCT uid) >= 3),
gone AS (SELECT m FROM held WHERE docs >= 3 UNION SELECT m FROM kinds JOIN groups USING (n, o, lead, same)),
kept AS (SELECT uid, count(*) AS n_lines, count(gone.m) AS n_dropped, coalesce(string_agg(line, chr(10) ORDER BY line_no) FILTER (WHERE gone.m IS NULL), '') AS body FROM masked LEFT JOIN gone USING (m) GROUP BY uid)
SELECT doc_id, n_lines, n_dropped, strlen(body)::BIGINT AS kept_bytes, sha256(body) AS kept_sha256 FROM u JOIN kept USING (uid), range(copies)"""
}
