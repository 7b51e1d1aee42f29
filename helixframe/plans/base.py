"""Callset, curated and reference tables derived from the generic tables, for the engine and as SQL, and the register of queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.contigs import fold_contig
from ..functions.genotypes import authored_genotype, genotype_from_gt, state_of
from ..operators.aggregates import LEAST_BREADTH
from ..operators.filters import quality_filter
from ..sources.prepared import prepare
from ..sources.scratch import scratch

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

#: The shipped quality filter.
FILTERS = {"passing": ["PASS", "."], "depth": 10, "quality": 20}
FLANK = 3600


def query(name: str, sql: str | None = None):
    """Registers a query and its SQL, which may use the views of VIEWS."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if sql:
            need: list[str] = []
            for v in reversed(VIEWS):  # a view uses earlier ones only
                if v in sql or any(v in VIEWS[n] for n in need):
                    need.insert(0, v)
            head = ", ".join(f"{v} AS ({VIEWS[v]})" for v in need)
            text = sql.strip()
            ORACLE_SQL[name] = f"WITH {head}, {text[5:]}" if need and text.startswith("WITH ") else f"WITH {head} {text}" if need else text
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def base_at(n: Column) -> Column:
    return F.substr(F.lit("ACGT"), (n % 4).cast("int") + 1, F.lit(1))


def contig_of(n: Column, mito: str) -> Column:
    k = n % 25
    return F.when(k == 22, "X").when(k == 23, "Y").when(k == 24, mito).otherwise((k + 1).cast("string"))


def callset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls of ten samples as they were read."""
    part, line = F.col("l_partkey"), F.col("l_linenumber")
    rs = lambda c: F.concat(F.lit("rs"), F.col(c).cast("string"))
    return table(spark, sf_dir, "lineitem").select(
        (F.col("l_suppkey") % 10).alias("sample"),
        (F.col("l_orderkey") * 10 + line).alias("rec"),
        F.concat(F.lit("chr"), contig_of(part, "M")).alias("chrom"),
        (part * 97 + line).alias("start"),
        F.when(line == 7, None).when(line == 6, F.concat(rs("l_partkey"), F.lit(";"), rs("l_orderkey"))).otherwise(rs("l_partkey")).alias("rsid"),
        base_at(part).alias("ref"),
        F.when(line == 4, F.concat(base_at(part + 1), F.lit("|"), base_at(part + 2))).otherwise(base_at(part + line)).alias("alt"),
        F.col("l_quantity").alias("qual"),
        F.col("l_quantity").cast("int").alias("dp"),
        F.when(F.col("l_linestatus") == "O", "PASS").otherwise("").alias("filter"),
        F.when(line == 4, "1/2").when(F.col("l_returnflag") == "A", "0/1").when(F.col("l_returnflag") == "N", "1/1").otherwise("./.").alias("gt"),
    )


def normalised(calls: DataFrame) -> DataFrame:
    return calls.withColumns({"chrom": fold_contig(F.col("chrom")), "genotype": genotype_from_gt(F.col("gt"), F.col("ref"), F.col("alt"))})


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalised and quality-filtered calls."""
    return normalised(quality_filter(callset(spark, sf_dir), **FILTERS))


def lead_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lead table as authored: genotype is text."""
    key = F.col("p_partkey")
    a, b = base_at(key), base_at(key + 1)
    weight = (F.col("p_size") - 25) / F.lit(10.0)
    return table(spark, sf_dir, "part").select(
        contig_of(key, "MT").alias("chrom"), (key * 97 + 1).alias("start"), F.concat(F.lit("rs"), key.cast("string")).alias("rsid"),
        F.when(key % 30 == 0, "TT").otherwise(base_at(key)).alias("ref"),
        F.when(key % 2 == 0, F.concat_ws("/", F.least(a, b), F.greatest(a, b))).when(key % 7 == 0, F.concat_ws("|", b, a)).when(key % 5 == 0, F.concat_ws("/", a, a)).otherwise(F.concat_ws("|", a, b)).alias("genotype"),
        weight.alias("weight"), state_of(weight).alias("state"), F.col("p_brand").alias("gene"), F.col("p_type").alias("category"), F.lit("core").alias("module"), key.alias("key"),
    )


def lead(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lead table with genotype as an array."""
    return lead_text(spark, sf_dir).withColumn("genotype", authored_genotype(F.col("genotype")))


def slim_lead(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lead(spark, sf_dir).select("chrom", "start", "rsid", "ref", "genotype", "weight", "state", "module")


def sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Called sites of many contigs."""
    seconds = F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', CAST(ts AS TIMESTAMP_NTZ))")
    return table(spark, sf_dir, "events").select((F.col("user_id") % 20).cast("string").alias("chrom"), seconds.alias("start"))


def reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The big variation table."""
    key = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(
        contig_of(key, "MT").alias("chrom"), (key * 97 + 1).alias("start"), F.concat(F.lit("rs"), key.cast("string")).alias("id"), base_at(key).alias("ref"), base_at(key + 1).alias("alt"), F.col("p_retailprice").alias("score"),
    )


def prepared_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The big variation table as it is prepared for joins by position, under a name of its own."""
    path = scratch(spark, "prepared")
    return prepare(reference(spark, sf_dir), path, path.rsplit("/", 1)[1].replace("-", "_"), buckets=8)


def studies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Study rows; those of every seventh customer name a place and no rsID."""
    cust = F.col("o_custkey")
    return table(spark, sf_dir, "orders").select(
        F.when(cust % 7 != 0, F.concat(F.lit("rs"), cust.cast("string"))).alias("rsid"), contig_of(cust, "MT").alias("chrom"), (cust * 97 + 1).alias("start"), base_at(cust).alias("ref"),
        F.col("o_orderkey").cast("string").alias("pmid"), F.col("o_orderpriority").alias("conclusion"),
    )


def clinvar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of a clinical VCF as fields."""
    key = F.col("p_partkey")
    text = lambda *c: F.concat(*[x if isinstance(x, Column) else F.lit(x) for x in c])
    significance = F.when(key % 4 == 0, "Pathogenic").when(key % 4 == 1, "Benign/Likely_benign").when(key % 4 == 2, "Pathogenic/Likely_pathogenic").otherwise("Uncertain_significance")
    return table(spark, sf_dir, "part").select(
        key.alias("record_id"), contig_of(key, "MT").alias("chrom"), (key * 97 + 1).alias("start"), base_at(key).alias("ref"),
        F.when(key % 11 == 0, text(base_at(key + 1), "N")).when(key % 13 == 0, base_at(key)).otherwise(base_at(key + 1)).alias("alt"),
        text("CLNSIG=", significance, ";GENEINFO=", F.col("p_brand"), ":1|", F.col("p_type"), ":2;RS=", key.cast("string"), "|9;CLNDN=", F.col("p_name")).alias("info"),
        (key % 5).cast("int").alias("stars"), F.col("p_brand").alias("gene"),
    )


_BASE = "substr('ACGT', CAST(({0}) % 4 AS INT) + 1, 1)"
_CONTIG = "CASE {0} % 25 WHEN 22 THEN 'X' WHEN 23 THEN 'Y' WHEN 24 THEN '{1}' ELSE CAST({0} % 25 + 1 AS VARCHAR) END"
_A, _B = _BASE.format("p_partkey"), _BASE.format("p_partkey + 1")
_GENOTYPE = "list_sort(list_transform(regexp_extract_all(gt, '[0-9]+'), lambda i: list_concat([ref], string_split(alt, '|'))[CAST(i AS INT) + 1]))"

VIEWS = {
    "v_callset": f"""SELECT l_suppkey % 10 AS sample, l_orderkey * 10 + l_linenumber AS rec, concat('chr', {_CONTIG.format('l_partkey', 'M')}) AS chrom,
      l_partkey * 97 + l_linenumber AS start,
      CASE WHEN l_linenumber = 7 THEN NULL WHEN l_linenumber = 6 THEN concat('rs', l_partkey, ';rs', l_orderkey) ELSE concat('rs', l_partkey) END AS rsid,
      {_BASE.format('l_partkey')} AS ref,
      CASE WHEN l_linenumber = 4 THEN concat({_BASE.format('l_partkey + 1')}, '|', {_BASE.format('l_partkey + 2')}) ELSE {_BASE.format('l_partkey + l_linenumber')} END AS alt,
      l_quantity AS qual, CAST(trunc(l_quantity) AS INT) AS dp, CASE WHEN l_linestatus = 'O' THEN 'PASS' ELSE '' END AS filter,
      CASE WHEN l_linenumber = 4 THEN '1/2' WHEN l_returnflag = 'A' THEN '0/1' WHEN l_returnflag = 'N' THEN '1/1' ELSE './.' END AS gt FROM lineitem""",
    "v_calls": f"""SELECT * REPLACE (CASE substr(chrom, 4) WHEN 'M' THEN 'MT' ELSE substr(chrom, 4) END AS chrom), {_GENOTYPE} AS genotype
      FROM v_callset WHERE filter IN ('PASS', '.', '') AND dp >= 10 AND qual >= 20""",
    "v_text": f"""SELECT {_CONTIG.format('p_partkey', 'MT')} AS chrom, p_partkey * 97 + 1 AS start, concat('rs', p_partkey) AS rsid,
      CASE WHEN p_partkey % 30 = 0 THEN 'TT' ELSE {_A} END AS ref,
      CASE WHEN p_partkey % 2 = 0 THEN concat(least({_A}, {_B}), '/', greatest({_A}, {_B})) WHEN p_partkey % 7 = 0 THEN concat({_B}, '|', {_A})
           WHEN p_partkey % 5 = 0 THEN concat({_A}, '/', {_A}) ELSE concat({_A}, '|', {_B}) END AS genotype,
      CAST(p_size - 25 AS DOUBLE) / CAST(10 AS DOUBLE) AS weight, CASE WHEN p_size > 25 THEN 'protective' WHEN p_size < 25 THEN 'risk' ELSE 'neutral' END AS state,
      p_brand AS gene, p_type AS category, 'core' AS module, p_partkey AS key FROM part""",
    "v_lead": "SELECT * REPLACE (list_filter(regexp_split_to_array(genotype, '[/|]'), lambda x: length(x) > 0) AS genotype) FROM v_text",
    "v_sites": "SELECT CAST(user_id % 20 AS VARCHAR) AS chrom, CAST(floor(epoch(ts)) AS BIGINT) AS start FROM events",
    "v_reference": f"SELECT {_CONTIG.format('p_partkey', 'MT')} AS chrom, p_partkey * 97 + 1 AS start, concat('rs', p_partkey) AS id, {_A} AS ref, {_B} AS alt, p_retailprice AS score FROM part",
    "v_studies": f"""SELECT CASE WHEN o_custkey % 7 <> 0 THEN concat('rs', o_custkey) END AS rsid, {_CONTIG.format('o_custkey', 'MT')} AS chrom, o_custkey * 97 + 1 AS start,
      {_BASE.format('o_custkey')} AS ref, CAST(o_orderkey AS VARCHAR) AS pmid, o_orderpriority AS conclusion FROM orders""",
    "v_clinvar": f"""SELECT p_partkey AS record_id, {_CONTIG.format('p_partkey', 'MT')} AS chrom, p_partkey * 97 + 1 AS start, {_A} AS ref,
      CASE WHEN p_partkey % 11 = 0 THEN concat({_B}, 'N') WHEN p_partkey % 13 = 0 THEN {_A} ELSE {_B} END AS alt,
      CASE p_partkey % 4 WHEN 0 THEN 'Pathogenic' WHEN 1 THEN 'Benign/Likely_benign' WHEN 2 THEN 'Pathogenic/Likely_pathogenic' ELSE 'Uncertain_significance' END AS sig,
      p_partkey, p_brand, p_type, p_name, CAST(p_partkey % 5 AS INT) AS stars, p_brand AS gene FROM part""",
    "v_probed": "SELECT c.* FROM v_calls c WHERE EXISTS (SELECT 1 FROM v_lead l WHERE l.chrom = c.chrom AND l.start = c.start)",
    "v_annotated": """SELECT c.*, l.rsid AS rsid_core, l.ref AS ref_core, l.weight, l.state, l.module, l.gene, l.category FROM v_probed c LEFT JOIN v_lead l
      ON c.chrom = l.chrom AND c.start = l.start AND c.genotype = l.genotype WHERE l.ref IS NULL OR l.ref = c.ref""",
}

#: A callset counts as a whole genome from so many sites on; the tables here are small.
RUN_SITES = 100
#: Views of whether rows of a callset may be restored: variants only, enough sites, wide coverage.
ENABLED = f"""gaps AS (SELECT chrom, start, start - lag(start) OVER (PARTITION BY chrom ORDER BY start) AS gap FROM (SELECT DISTINCT chrom, start FROM v_calls WHERE regexp_full_match(chrom, '[0-9]+|X|Y|MT'))),
  spans AS (SELECT count(*) AS n, sum(least(gap, {2 * FLANK})) AS covered, max(start) - min(start) AS span FROM gaps GROUP BY chrom),
  facts AS (SELECT coalesce(sum(n), 0) >= {RUN_SITES} AND CASE WHEN sum(span) > 0 THEN sum(covered) / sum(span) ELSE 0 END >= {LEAST_BREADTH}
    AND NOT (SELECT coalesce(bool_or(contains(alt, 'NON_REF') OR contains(filter, 'RefCall')), false) FROM v_calls) AS enabled FROM spans)"""
