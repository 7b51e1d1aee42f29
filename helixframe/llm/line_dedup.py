"""Line dedup by distinct-site spread.

Lines are split at '\\n' and compared without ASCII white space at their ends, by two 64-bit hashes. Each line's
HyperLogLog sketch of the sites (sources) that carry it merges by aggregation, so a very frequent line is combined
before the shuffle. Where the estimate is so close to the threshold that the sketch's error could decide, the
distinct sites are counted exactly. A line of at least min_sites sites is boilerplate: its first place (the smallest
document, then the smallest line number) stays and all its other places go.

The places of all lines are written once and read by each of these steps. What joins them are the lines near or above the
threshold: counted first, they are broadcast up to MOST_BROADCAST of them, and beyond it their places are salted, so that the
places of one very common line never meet in one task. A text is put together again from its lines in one pass over them.

Cases: a null text stays null and an empty one empty; empty lines are never boilerplate; a null source is one site
of its own; repeated rows are treated alike, so a first place in a repeated row stays in each of them; rows that share a doc_id
with different texts are told by their texts' hash; a null doc_id is allowed and sorts first; texts of any number of lines work; an
empty table gives an empty result. Other columns pass through whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import discard, stash, table

MIN_SITES = 8
#: The sketch has 2^LG_K registers, and so a standard error of 1.04 / sqrt(2^LG_K); NEAR of these on either side count as near.
LG_K, NEAR = 10, 4
MOST_BROADCAST, SALTS = 100_000, 64
WHITE = " \t\n\x0b\x0c\r"


def line_key(line: Column) -> Column:
    return F.struct(F.xxhash64(line).alias("a"), F.xxhash64(F.lit("line"), line).alias("b"))


def places(docs: DataFrame) -> DataFrame:
    """(key, site, doc, pos): each non-empty line's places; doc tells rows apart also where doc_id is null."""
    # the hash of a text is taken before its lines fan out, not once a line
    whole = docs.select(F.struct(F.col("doc_id").alias("id"), F.xxhash64("text").alias("text")).alias("doc"), F.coalesce("source", F.lit("")).alias("site"), F.col("text"))
    lines = whole.select("doc", "site", F.posexplode(F.split("text", "\n")).alias("pos", "line")).withColumn("line", F.btrim("line", F.lit(WHITE)))
    return lines.filter("line != ''").select(line_key(F.col("line")).alias("key"), "site", "doc", "pos")


def at_lines(found: DataFrame, lines: DataFrame, n: int) -> DataFrame:
    """The places found of the n lines, with the lines' columns."""
    if n <= MOST_BROADCAST:
        return found.join(F.broadcast(lines), "key")
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    salted = found.withColumn("salt", F.pmod(F.xxhash64("doc", "pos"), F.lit(SALTS)).cast("int"))
    return salted.join(lines.select("*", salts), ["key", "salt"]).drop("salt")


def boilerplate(found: DataFrame, min_sites: int) -> DataFrame:
    """(key, first) of the lines on at least min_sites sites, stashed; first: the place that stays."""
    margin = 1 + NEAR * 1.04 / 2 ** (LG_K / 2) * min_sites
    spread = found.groupBy("key").agg(
        F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(LG_K))).alias("sites"), F.min(F.struct("doc", "pos")).alias("first")
    )
    spread = stash(spread.filter(F.col("sites") >= min_sites - margin), "spread")
    near = F.col("sites") <= min_sites + margin
    n = spread.filter(near).count()
    counted = (
        at_lines(found, spread.filter(near).select("key"), n).select("key", "site").distinct()
        .groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") >= min_sites)
    )
    sure = spread.filter(~near).select("key", "first")
    return stash(sure.unionByName(spread.filter(near).select("key", "first").join(counted.select("key"), "key", "left_semi")), "boilerplate")


def without(lines: Column, removed: Column) -> Column:
    """lines joined again but for those at the ascending positions removed, in one pass: each position stands for the kept ones before it and itself."""
    before = F.concat(F.array(F.lit(-1)), removed)
    runs = F.zip_with(removed, before, lambda r, p: F.when(r.isNull(), F.array().cast("array<boolean>")).otherwise(F.concat(F.array_repeat(F.lit(True), r - p - 1), F.array(F.lit(False)))))
    marked = F.zip_with(lines, F.flatten(runs), lambda line, keep: F.struct(line.alias("line"), F.coalesce(keep, F.lit(True)).alias("keep")))
    return F.array_join(F.transform(F.filter(marked, lambda x: x["keep"]), lambda x: x["line"]), "\n")


def cleaned(docs: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """(doc, text, n_lines, n_removed) of each row of docs: doc holds all its columns, text is without the boilerplate lines."""
    found = stash(places(docs), "places")
    lines = boilerplate(found, min_sites)
    gone = (
        at_lines(found, lines, lines.count()).filter(F.struct("doc", "pos") != F.col("first"))
        .groupBy(F.col("doc.id").alias("g_id"), F.col("doc.text").alias("g_text")).agg(F.array_sort(F.collect_set("pos")).alias("removed"))
    )
    gone = stash(gone, "removed-lines")
    discard(found)
    discard(lines)
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.xxhash64("text").alias("d_text"))
    # one way at every size: documents with removed lines grow with the documents
    marked = whole.join(gone.hint("merge"), F.col("doc.doc_id").eqNullSafe(F.col("g_id")) & (F.col("d_text") == F.col("g_text")), "left")
    split = F.split("doc.text", "\n")
    text = F.when(F.col("removed").isNull(), F.col("doc.text")).otherwise(without(split, F.col("removed")))
    return marked.select("doc", text.alias("text"), F.coalesce(F.size(split), F.lit(0)).alias("n_lines"), F.coalesce(F.size("removed"), F.lit(0)).alias("n_removed"))


def remove_boilerplate(docs: DataFrame, min_sites: int = MIN_SITES, drop_emptied: bool = False) -> DataFrame:
    """docs with the boilerplate lines taken out of text; with drop_emptied without the rows in which nothing else stood."""
    rows = cleaned(docs, min_sites)
    if drop_emptied:
        rows = rows.filter((F.col("n_removed") == 0) | (F.btrim("text", F.lit(WHITE)) != ""))
    return rows.select(*[F.col("text") if c == "text" else F.col("doc").getField(c).alias(c) for c in docs.columns])


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return cleaned(docs).select("doc.doc_id", "n_lines", "n_removed", F.length("text").alias("n_chars"), F.md5("text").alias("text_md5"))


ORACLE_SQL = f"""
WITH lines AS (
  SELECT doc_id, coalesce(source, '') AS site, pos - 1 AS pos, string_split(text, chr(10))[pos] AS line
  FROM (SELECT doc_id, source, text, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS pos FROM documents)),
trimmed AS (SELECT *, trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare FROM lines),
spread AS (
  SELECT bare, min((doc_id, pos)) AS first_place FROM trimmed WHERE bare <> '' GROUP BY bare HAVING count(DISTINCT site) >= {MIN_SITES}),
judged AS (
  SELECT t.doc_id, t.pos, t.line, s.bare IS NOT NULL AND s.first_place <> (t.doc_id, t.pos) AS gone
  FROM trimmed t LEFT JOIN spread s ON t.bare = s.bare),
texts AS (
  SELECT doc_id, CAST(count(*) AS INT) AS n_lines, CAST(count(*) FILTER (gone) AS INT) AS n_removed,
         coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '') AS text
  FROM judged GROUP BY doc_id)
SELECT d.doc_id, coalesce(t.n_lines, 0) AS n_lines, coalesce(t.n_removed, 0) AS n_removed,
       CAST(CASE WHEN d.text IS NULL THEN NULL ELSE length(t.text) END AS INT) AS n_chars, CASE WHEN d.text IS NOT NULL THEN md5(t.text) END AS text_md5
FROM documents d LEFT JOIN texts t ON d.doc_id = t.doc_id
"""
