"""Queries: sources and sinks, text functions, curated-table builds, and new samples as a stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import contigs as C
from ..functions import genotypes as G
from ..functions import literature as T
from ..operators import aggregates as A
from ..operators import curate as U
from ..operators import filters as L
from ..operators import joins as J
from ..operators import panels as N
from ..operators import ports as P
from ..sources import block_gzip, tables, vcf
from ..sources.scratch import scratch
from ..streaming import arrivals
from . import base as B
from .base import query
from .normalise import level

_HEAD = [
    "##fileformat=VCFv4.2", '##INFO=<ID=END,Number=1,Type=Integer,Description="end">', '##INFO=<ID=SRC,Number=1,Type=String,Description="source">',
    '##INFO=<ID=DP,Number=1,Type=Integer,Description="depth">', '##FORMAT=<ID=GT,Number=1,Type=String,Description="genotype">', '##FORMAT=<ID=DP,Number=1,Type=Integer,Description="depth">',
    '##FORMAT=<ID=AD,Number=R,Type=Integer,Description="depths">', "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tS1",
]


def _vcf_text(spark, d, blocks=False):
    """VCF text of the callset in a new folder, as block-gzip files if blocks: header lines stand in the first part."""
    rows = B.callset(spark, d)
    dot = lambda c: F.coalesce(F.nullif(F.col(c).cast("string"), F.lit("")), F.lit("."))
    ad = F.concat(F.col("dp").cast("string"), F.lit(","), (F.col("dp") + 1).cast("string"))
    line = F.concat_ws("\t", "chrom", F.col("start").cast("string"), dot("rsid"), "ref", F.replace("alt", F.lit("|"), F.lit(",")), dot("qual"), dot("filter"), F.concat(F.lit("SRC=s"), F.col("sample").cast("string"), F.lit(";DP="), F.col("dp").cast("string")), F.lit("GT:AD"), F.concat_ws(":", "gt", ad))
    path = scratch(spark, "vcf")
    head = spark.createDataFrame([("\n".join(_HEAD),)], "value string")
    whole = head.unionByName(rows.select(line.alias("value")))
    if blocks:
        block_gzip.write_lines(whole, path, ".vcf.gz")
    else:
        whole.write.text(path)
    return path


_READ = f"SELECT chrom, count(*) AS n, CAST(sum(start) AS BIGINT) AS places, count(rsid) AS named, count(*) FILTER (filter = '') AS unfiltered, CAST(sum(dp) AS BIGINT) AS depth, CAST(sum(dp * 2 + 1) AS BIGINT) AS reads, count(DISTINCT array_to_string({B._GENOTYPE}, '/')) AS genotypes, round(sum(qual), 3) AS quality FROM v_callset GROUP BY chrom"


def _read(df):
    return df.groupBy("chrom").agg(
        F.count("*").alias("n"), F.sum("start").alias("places"), F.count("rsid").alias("named"), F.count_if(F.col("filter") == "").alias("unfiltered"), F.sum("DP").alias("depth"),
        F.sum(F.aggregate("AD", F.lit(0), lambda s, x: s + x)).alias("reads"), F.countDistinct(F.array_join("genotype", "/")).alias("genotypes"), F.round(F.sum("qual"), 3).alias("quality"),
    )


@query("src_01", _READ)
def src_01(spark, d):
    return _read(vcf.read_vcf(spark, _vcf_text(spark, d)))


@query("src_01_block_gzip", _READ)
def src_01_block_gzip(spark, d):
    return _read(vcf.read_vcf(spark, _vcf_text(spark, d, blocks=True)))


@query("mart_00", "SELECT c.sample, c.chrom, array_to_string(c.genotype, '/') AS genotype, count(*) AS n, any_value(b.before) AS before FROM v_calls c JOIN (SELECT sample, count(*) AS before FROM v_callset GROUP BY sample) b ON c.sample = b.sample GROUP BY ALL")
def mart_00(spark, d):
    """A callset normalised: VCF text read, contigs folded, genotypes computed, quality filtered with its accounting, written by sample and read back."""
    raw = vcf.read_vcf(spark, _vcf_text(spark, d)).withColumns({"chrom": C.fold_contig(F.col("chrom")), "sample": F.substr("SRC", F.lit(2)).cast("bigint")})
    whole = L.accounted(raw, scratch(spark, "normalised"), "sample", **B.FILTERS)
    return whole.kept.groupBy("sample", "chrom", F.array_join("genotype", "/").alias("genotype")).agg(F.count("*").alias("n")).join(whole.account.select("sample", "before"), "sample")


@query("src_02", "SELECT 'AD,DP,GT,SRC' AS columns, count(*) AS n FROM v_callset")
def src_02(spark, d):
    path = _vcf_text(spark, d)
    info, form = vcf.header_fields(spark, path)
    return vcf.read_vcf(spark, path, info, form).agg(F.lit(",".join(sorted([*info, *form]))).alias("columns"), F.count("*").alias("n"))


@query("src_05", _READ)
def src_05(spark, d):
    to = scratch(spark, "calls") + ".parquet"
    vcf.vcf_to_parquet(spark, _vcf_text(spark, d), to)
    return _read(vcf.read_vcf(spark, to))


@query("src_06", "SELECT key, weight FROM v_lead")
def src_06(spark, d):
    path = scratch(spark, "module")
    tables.write_table(B.lead(spark, d), path)
    return tables.module_table(spark, path, ["key", "weight"])


@query("src_10", "SELECT s_suppkey, lower(s_name) AS s_name FROM supplier")
def src_10(spark, d):
    upper = B.table(spark, d, "supplier").select(F.col("s_suppkey").alias("S_SUPPKEY"), F.lower("s_name").alias("S_NAME"))
    return tables.lower_names(upper)


_CSV = "SELECT CAST(key AS VARCHAR) AS key, concat('say \"', gene, '\", then go') AS note, CASE WHEN key % 2 = 0 THEN '' ELSE state END AS state FROM v_lead WHERE key % 10 <> 3"


@query("src_11", _CSV)
def src_11(spark, d):
    path = scratch(spark, "authored")
    mark = F.when(F.col("key") % 10 == 3, F.concat(F.lit("#"), F.col("key").cast("string"))).otherwise(F.col("key").cast("string"))
    rows = B.lead(spark, d).select(mark.alias("key"), F.concat(F.lit('say "'), "gene", F.lit('", then go')).alias("note"), F.when(F.col("key") % 2 != 0, F.concat(F.lit(" "), "state")).alias("state"))
    tables.write_csv(rows, path)
    return tables.authored_csv(spark, path)


@query("src_12", "SELECT rsid, ref, alt AS alts, chrom, CAST(start AS VARCHAR) AS start FROM (SELECT id AS rsid, * EXCLUDE id FROM v_reference)")
def src_12(spark, d):
    path = scratch(spark, "resolution")
    tables.write_csv(B.reference(spark, d).select(F.col("id").alias("rsid"), "ref", F.col("alt").alias("alts"), "chrom", "start"), path)
    return tables.authored_csv(spark, path)


@query("src_13", "SELECT chrom, count(*) AS n FROM v_clinvar WHERE sig LIKE '%athogenic%' GROUP BY chrom")
def src_13(spark, d):
    path = scratch(spark, "clinvar")
    line = F.concat_ws("\t", "chrom", F.col("start").cast("string"), F.col("record_id").cast("string"), "ref", "alt", F.lit("."), F.lit("."), "info")
    B.clinvar(spark, d).select(line.alias("value")).write.text(path)
    return tables.pathogenic_lines(spark, path).groupBy(F.col("f")[0].alias("chrom")).agg(F.count("*").alias("n"))


@query("src_16", "SELECT gene, count(*) AS n FROM v_clinvar GROUP BY gene")
def src_16(spark, d):
    path = scratch(spark, "snapshot")
    tables.write_table(B.clinvar(spark, d), path)
    return spark.read.parquet(path).groupBy("gene").agg(F.count("*").alias("n"))


@query("snk_01", "SELECT sample, count(*) AS n FROM v_annotated GROUP BY sample")
def snk_01(spark, d):
    done = tables.write_table(J.annotate_by_position(B.calls(spark, d), B.lead(spark, d), "core"), scratch(spark, "annotated"))
    return done.groupBy("sample").agg(F.count("*").alias("n"))


@query("snk_02", "SELECT count(*) AS n FROM v_calls")
def snk_02(spark, d):
    """The written table counts as many rows as were observed while it was written."""
    from pyspark.sql import Observation

    seen = Observation()
    done = tables.write_table(B.calls(spark, d).observe(seen, F.count("*").alias("n")), scratch(spark, "calls"))
    return done.agg(F.count("*").alias("n")).filter(F.col("n") == seen.get["n"])


@query("snk_03", "SELECT c.chrom, count(r.id) AS found FROM v_calls c LEFT JOIN v_reference r ON c.chrom = r.chrom AND c.start = r.start AND c.ref = r.ref AND c.alt = r.alt GROUP BY c.chrom")
def snk_03(spark, d):
    done = tables.write_table(J.annotate_by_reference(B.calls(spark, d), B.reference(spark, d)), scratch(spark, "referenced"))
    return done.groupBy("chrom").agg(F.count("id").alias("found"))


@query("snk_04", "SELECT chrom, count(*) AS n, CAST(sum(start) AS BIGINT) AS places, count(weight) AS weighted, round(sum(weight), 3) AS weight, count(DISTINCT gene) AS genes FROM v_annotated GROUP BY chrom")
def snk_04(spark, d):
    """Exported as VCF text and read back."""
    path = scratch(spark, "export")
    df = J.annotate_by_position(B.calls(spark, d), B.lead(spark, d), "core").select("chrom", "start", "rsid", "ref", "alt", "qual", "filter", "weight", "gene")
    vcf.write_vcf(df, path)
    back = vcf.read_vcf(spark, path, {"weight": "double", "gene": "string"}, {})
    return back.groupBy("chrom").agg(F.count("*").alias("n"), F.sum("start").alias("places"), F.count("weight").alias("weighted"), F.round(F.sum("weight"), 3).alias("weight"), F.countDistinct("gene").alias("genes"))


@query("snk_06", "SELECT CAST(key AS VARCHAR) AS key, array_to_string(genotype, ';') AS genotype FROM v_lead")
def snk_06(spark, d):
    path = scratch(spark, "csv")
    tables.write_csv(B.lead(spark, d).select("key", "genotype"), path)
    return spark.read.csv(path, header=True, schema="key string, genotype string")


_CELL = "CASE key % 5 WHEN 0 THEN concat('PMID 00', key + 1000, '; PMID: ', key + 2000, ' and PMID ', key + 1000) WHEN 1 THEN concat(key + 1000, ', ', key + 5000, ', 12') WHEN 2 THEN concat('https://x.org/', key + 1000) WHEN 3 THEN concat('PMID 123456789', key) ELSE '' END"
_IDS = "CASE key % 5 WHEN 0 THEN concat(key + 1000, ',', key + 2000) WHEN 1 THEN concat(key + 1000, ',', key + 5000) ELSE '' END"


@query("sc_20", f"SELECT key, {_IDS} AS pmids, CASE key % 5 WHEN 3 THEN 1 ELSE 0 END AS rejected FROM v_lead")
def sc_20(spark, d):
    k, n = F.col("key") % 5, lambda by: (F.col("key") + by).cast("string")
    cell = (
        F.when(k == 0, F.concat(F.lit("PMID 00"), n(1000), F.lit("; PMID: "), n(2000), F.lit(" and PMID "), n(1000)))
        .when(k == 1, F.concat(n(1000), F.lit(", "), n(5000), F.lit(", 12"))).when(k == 2, F.concat(F.lit("https://x.org/"), n(1000)))
        .when(k == 3, F.concat(F.lit("PMID 123456789"), n(0))).otherwise("")
    )
    ids = T.article_ids(cell)
    return B.lead(spark, d).select("key", F.array_join(T.accepted(ids), ",").alias("pmids"), F.size(T.rejected(ids)).alias("rejected"))


@query("sc_18", "SELECT key, CASE key % 3 WHEN 0 THEN '5e-8' WHEN 1 THEN '<0.05' ELSE '0.01' END AS text, CASE key % 3 WHEN 0 THEN CAST(5e-8 AS DOUBLE) WHEN 2 THEN CAST(0.01 AS DOUBLE) END AS value FROM v_lead")
def sc_18(spark, d):
    raw = F.when(F.col("key") % 3 == 0, "5e−8 ").when(F.col("key") % 3 == 1, "<0.05").otherwise(" 0.01")
    return B.lead(spark, d).select("key", T.p_value_text(raw).alias("text"), T.p_value(raw).alias("value"))


@query("sc_21", "SELECT key, CASE WHEN key % 2 = 0 THEN 'Привет' ELSE 'plain é' END AS text FROM v_lead")
def sc_21(spark, d):
    garbled = "Привет".encode().decode("cp1251")
    return B.lead(spark, d).select("key", T.unscrambled(F.when(F.col("key") % 2 == 0, F.lit(garbled)).otherwise("plain é")).alias("text"))


@query("sc_22", "SELECT key, CASE WHEN key % 4 = 3 THEN 'unknown' ELSE gene END AS gene FROM v_lead")
def sc_22(spark, d):
    """The first symbol of a cell that is official; the first as it is where none is."""
    rows = B.lead(spark, d)
    cell = F.when(F.col("key") % 4 == 0, F.concat(F.lit("zzz, "), "gene", F.lit("; Brand#1"))).when(F.col("key") % 4 == 3, "unknown").otherwise(F.concat("gene", F.lit(" (alias)")))
    each = rows.select("key", F.posexplode(T.gene_tokens(cell)).alias("pos", "token"))
    known = B.table(spark, d, "part").select(F.col("p_brand").alias("token"), F.lit(True).alias("known")).distinct()
    found = each.join(known, "token", "left").groupBy("key").agg(F.min_by("token", F.when(F.col("known"), F.col("pos"))).alias("hit"), F.min_by("token", "pos").alias("first"))
    return found.select("key", F.coalesce("hit", "first").alias("gene"))


@query("sc_23", "SELECT record_id, sig AS significance, concat(p_brand, ',', p_type) AS genes, record_id % 4 IN (0, 2) AS pathogenic, concat('rs', record_id) AS rsid, p_name AS condition FROM v_clinvar")
def sc_23(spark, d):
    info = F.col("info")
    return B.clinvar(spark, d).select("record_id", T.info_value(info, "CLNSIG").alias("significance"), F.array_join(T.genes_of(info), ",").alias("genes"), T.has_pathogenic(T.info_value(info, "CLNSIG")).alias("pathogenic"), T.first_rs(info).alias("rsid"), T.info_value(info, "CLNDN").alias("condition"))


@query("sc_24", "SELECT key, CASE WHEN key % 2 = 0 THEN 'First one. Second two!' ELSE 'word word word word' END AS text FROM v_lead")
def sc_24(spark, d):
    text = F.when(F.col("key") % 2 == 0, "First one.  Second\n two! Third is far too long.").otherwise("word word word word word word")
    return B.lead(spark, d).select("key", T.trimmed(text, 22).alias("text"))


@query("sc_25", "SELECT record_id, concat_ws(' ', p_name, concat('(', sig, ')'), CASE WHEN stars > 2 THEN 'reviewed' END) AS conclusion FROM v_clinvar")
def sc_25(spark, d):
    info = F.col("info")
    return B.clinvar(spark, d).select("record_id", F.concat_ws(" ", T.info_value(info, "CLNDN"), F.concat(F.lit("("), T.info_value(info, "CLNSIG"), F.lit(")")), F.when(F.col("stars") > 2, "reviewed")).alias("conclusion"))


_BLANK = "SELECT r.chrom, r.start, r.id, CASE WHEN r.chrom IN ('Y', 'MT') THEN [''] ELSE [concat(least(r.ref, r.alt), '/', greatest(r.ref, r.alt)), concat(r.alt, '/', r.alt)] END AS g FROM v_reference r"


@query("sc_15", f"SELECT id, unnest(g) AS genotype FROM ({_BLANK})")
def sc_15(spark, d):
    return U.fill_genotypes(B.reference(spark, d).withColumn("genotype", F.lit(""))).select("id", "genotype")


_FATE = "CASE WHEN key % 5 = 0 THEN 'unplaced' WHEN contains(genotype, '|') THEN 'impossible' WHEN len(list_filter(string_split(genotype, '/'), lambda x: x NOT IN (a, b))) = 0 THEN 'kept' ELSE 'impossible' END"
_PRUNED = f"SELECT l.key, l.rsid, {_FATE} AS fate FROM (SELECT t.*, {B._BASE.format('t.key')} AS a, {B._BASE.format('t.key + 1')} AS b FROM v_text t) l"


def _pruned(spark, d):
    resolution = B.reference(spark, d).filter(F.substr("id", F.lit(3)).cast("bigint") % 5 != 0).select(F.col("id").alias("rsid"), "ref", F.col("alt").alias("alts"))
    return U.prune(B.lead_text(spark, d), resolution).select("key", "rsid", "fate")


@query("sc_28", _PRUNED)
def sc_28(spark, d):
    return _pruned(spark, d)


@query("ag_20", "SELECT id AS rsid, concat(least(ref, alt), ',', greatest(ref, alt)) AS alleles FROM v_reference")
def ag_20(spark, d):
    return A.alleles_by_rsid(B.reference(spark, d).select(F.col("id").alias("rsid"), "ref", F.col("alt").alias("alts"))).select("rsid", F.array_join("alleles", ",").alias("alleles"))


@query("mart_11", f"WITH p AS ({_PRUNED}) SELECT s.rsid, s.pmid FROM v_studies s WHERE s.rsid IS NULL OR s.rsid IN (SELECT rsid FROM p WHERE fate <> 'impossible')")
def mart_11(spark, d):
    return U.without_orphans(B.studies(spark, d).select("rsid", "pmid"), _pruned(spark, d).filter("fate <> 'impossible'"))


@query("jn_23", "SELECT s.rsid, s.pmid FROM v_studies s WHERE s.rsid IS NULL OR s.rsid IN (SELECT rsid FROM v_lead WHERE weight > 0)")
def jn_23(spark, d):
    return U.without_orphans(B.studies(spark, d).select("rsid", "pmid"), B.lead(spark, d).filter("weight > 0"))


#: (rsid, genotype or '*', field, new value): of parts 3, 6, 9 and 12, and of one that isn't there.
CORRECTIONS = [("rs6", "*", "weight", "-9"), ("rs6", "*", "state", "protective"), ("rs12", "*", "genotype", "T/T"), ("rs12", "T/T", "weight", "4.5"), ("rs9", "*", "drop", ""), ("rs999999999", "*", "weight", "1")]
_CORRECTED = "SELECT key, CASE rsid WHEN 'rs12' THEN 'T/T' ELSE genotype END AS genotype, CASE rsid WHEN 'rs6' THEN CAST(-9 AS DOUBLE) WHEN 'rs12' THEN CAST(4.5 AS DOUBLE) ELSE weight END AS weight, CASE rsid WHEN 'rs6' THEN 'protective' WHEN 'rs12' THEN 'protective' ELSE state END AS state FROM v_text WHERE rsid <> 'rs9'"


@query("jn_24", _CORRECTED)
def jn_24(spark, d):
    return U.corrected(B.lead_text(spark, d).select("key", "rsid", "genotype", "weight", "state"), CORRECTIONS).select("key", "genotype", "weight", "state")


@query("jn_25", "SELECT rsid, pmid, CASE WHEN rsid = 'rs10' THEN 'checked' ELSE conclusion END AS conclusion FROM v_studies WHERE rsid IS NULL OR rsid <> 'rs11'")
def jn_25(spark, d):
    return U.corrected(B.studies(spark, d).select("rsid", "pmid", "conclusion"), [("rs10", "*", "conclusion", "checked"), ("rs11", "*", "drop", "")], "pmid")


@query("jn_24_unmatched", "SELECT 'rs999999999' AS rsid, '*' AS genotype, 'weight' AS field, '1' AS new_value FROM v_lead LIMIT 1")
def jn_24_unmatched(spark, d):
    return U.unmatched_corrections(B.lead_text(spark, d).select("key", "rsid", "genotype", "weight", "state"), CORRECTIONS)


_MANY = "SELECT key, genotype, CASE WHEN key % 4 = 0 THEN CAST(-1 - key AS DOUBLE) ELSE weight END AS weight, CASE WHEN key % 8 = 0 THEN 'alt' WHEN key % 4 = 0 THEN 'risk' ELSE state END AS state FROM v_text WHERE key % 6 <> 5"


@query("jn_24_many", _MANY)
def jn_24_many(spark, d):
    """Corrections as a table, more than half as many as there are rows, folded in their order: weights, then states, and rows that go."""
    rows = B.lead_text(spark, d).select("key", "rsid", "genotype", "weight", "state")
    one = lambda where, n, other, field, value: rows.filter(where).select((F.col("key") * 4 + n).cast("int").alias("n"), "rsid", other.alias("other"), F.lit(field).alias("field"), value.cast("string").alias("new_value"))
    every = F.lit("*")
    corrections = one("key % 4 = 0", 0, every, "weight", -1 - F.col("key")).unionByName(one("key % 8 = 0", 1, F.col("genotype"), "state", F.lit("alt"))).unionByName(one("key % 6 = 5", 2, every, "drop", F.lit("")))
    return U.corrected(rows, corrections.unionByName(one("key % 8 = 4", 3, F.lit("Z/Z"), "state", F.lit("ref")))).select("key", "genotype", "weight", "state")


_PANEL_STATS = "SELECT reason, count(*) AS n, count(DISTINCT gene) AS genes FROM (SELECT CASE WHEN sig NOT LIKE 'Patho%' THEN 'not_pathogenic' WHEN NOT regexp_full_match(alt, '[ACGT]+') THEN 'not_acgt' WHEN ref = alt THEN 'same_allele' ELSE 'matched' END AS reason, upper(gene) AS gene FROM v_clinvar) GROUP BY reason"


@query("ag_23", _PANEL_STATS)
def ag_23(spark, d):
    records = B.clinvar(spark, d)
    reason = F.when(~T.has_pathogenic(T.info_value(F.col("info"), "CLNSIG")), "not_pathogenic").otherwise(F.coalesce(G.allele_rejection(F.col("ref"), F.col("alt")), F.lit("matched")))
    return records.groupBy(reason.alias("reason")).agg(F.count("*").alias("n"), F.countDistinct(F.upper("gene")).alias("genes"))


@query("ag_26", "SELECT (SELECT count(*) FROM v_lead) AS rows_before, (SELECT count(*) FROM v_lead WHERE weight > 0) AS rows_after, 'tier' AS added, 'gene' AS removed")
def ag_26(spark, d):
    before = B.lead(spark, d)
    return U.table_delta(before, before.filter("weight > 0").drop("gene").withColumn("tier", F.lit("")))


@query("mart_13", "SELECT count(*) AS rows_before, count(*) AS rows_after, '' AS added, '' AS removed, true AS superset, true AS same_keys, 0 AS buckets_changed, CAST(0 AS BIGINT) AS lost, CAST(0 AS BIGINT) AS gained FROM v_lead")
def mart_13(spark, d):
    """A table written and read back keeps its rows, columns and contents: both are read once, for their fingerprints."""
    before = B.lead(spark, d)
    return U.release_delta(before, tables.write_table(before, scratch(spark, "round-trip")), ["key"])


@query("mart_13_changed", "SELECT count(*) AS rows_before, count(*) FILTER (key % 9 <> 0) AS rows_after, 'tier' AS added, 'gene' AS removed, false AS superset, false AS same_keys, count(*) FILTER (key % 4 = 0 OR key % 9 = 0) AS lost, count(*) FILTER (key % 4 = 0 AND key % 9 <> 0) AS gained FROM v_lead")
def mart_13_changed(spark, d):
    """Two releases: the later one has other weights for some rows, lacks others and a column, and has a new one."""
    before = B.lead(spark, d)
    after = before.filter("key % 9 <> 0").withColumns({"weight": F.when(F.col("key") % 4 == 0, F.col("weight") + 100).otherwise(F.col("weight")), "tier": F.lit("")}).drop("gene")
    return U.release_delta(before, after, ["key"]).drop("buckets_changed")


@query("wn_02", "SELECT gene, min(key) AS key FROM v_lead GROUP BY gene")
def wn_02(spark, d):
    return J.first_per_key(B.lead(spark, d), ["gene"], "key").select("gene", "key")


@query("wn_03", "SELECT rsid, pmid FROM (SELECT *, row_number() OVER (PARTITION BY rsid ORDER BY length(conclusion) DESC, CAST(pmid AS BIGINT)) AS n FROM v_studies WHERE rsid IS NOT NULL) WHERE n = 1")
def wn_03(spark, d):
    rows = B.studies(spark, d).filter("rsid IS NOT NULL")
    return J.first_per_key(rows, ["rsid"], F.length("conclusion").desc(), F.col("pmid").cast("bigint")).select("rsid", "pmid")


_CITED = "SELECT rsid AS variant, CASE WHEN CAST(pmid AS BIGINT) % 50 = 0 THEN concat('PMC', pmid) ELSE pmid END AS pmid FROM v_studies WHERE rsid IS NOT NULL"


@query("wn_04", f"WITH c AS ({_CITED}), r AS (SELECT *, regexp_full_match(pmid, '[0-9]+') AS sound, row_number() OVER (PARTITION BY variant, regexp_full_match(pmid, '[0-9]+') ORDER BY pmid) AS n FROM c) SELECT variant, coalesce(array_to_string(list_sort(list(pmid) FILTER (sound AND n <= 5)), ','), '') AS kept, count(*) FILTER (sound AND n > 5) AS dropped, count(*) FILTER (NOT sound) AS unsound FROM r GROUP BY variant")
def wn_04(spark, d):
    marked = F.when(F.col("pmid").cast("bigint") % 50 == 0, F.concat(F.lit("PMC"), "pmid")).otherwise(F.col("pmid"))
    return U.capped(B.studies(spark, d).filter("rsid IS NOT NULL").select(F.col("rsid").alias("variant"), marked.alias("pmid")), 5)


@query("wn_06", "SELECT gene, category, min(key) AS key, count(*) - 1 AS duplicates FROM v_lead GROUP BY gene, category")
def wn_06(spark, d):
    return U.without_duplicates(B.lead(spark, d), ["gene", "category"], "key").select("gene", "category", "key", "duplicates")


_TWO = "WITH x AS (SELECT concat('rs', o_custkey) AS variant_key, CAST(o_orderkey % 20 AS VARCHAR) AS pmid, o_orderpriority AS conclusion, CASE WHEN o_orderkey % 2 = 0 THEN 0 ELSE 1 END AS priority FROM orders) SELECT variant_key, pmid, conclusion, priority FROM (SELECT *, row_number() OVER (PARTITION BY variant_key, pmid ORDER BY priority, conclusion) AS n FROM x) WHERE n = 1"


def _merged(spark, d):
    rows = B.table(spark, d, "orders").select(F.concat(F.lit("rs"), F.col("o_custkey").cast("string")).alias("variant_key"), (F.col("o_orderkey") % 20).cast("string").alias("pmid"), F.col("o_orderpriority").alias("conclusion"), "o_orderkey")
    return U.merged_studies([rows.filter("o_orderkey % 2 = 0").drop("o_orderkey"), rows.filter("o_orderkey % 2 = 1").drop("o_orderkey")])


@query("wn_07", _TWO)
def wn_07(spark, d):
    return _merged(spark, d)


@query("st_05", f"SELECT priority, count(*) AS n FROM ({_TWO}) GROUP BY priority")
def st_05(spark, d):
    return _merged(spark, d).groupBy("priority").agg(F.count("*").alias("n"))


@query("st_06", "SELECT rsid, gene FROM v_lead UNION ALL SELECT concat('rs', s_suppkey), 'curated' FROM supplier")
def st_06(spark, d):
    extra = B.table(spark, d, "supplier").select(F.lit("curated").alias("gene"), F.concat(F.lit("rs"), F.col("s_suppkey").cast("string")).alias("rsid"))
    return B.lead(spark, d).select("rsid", "gene").unionByName(extra)


_PANEL_RECORDS = """k AS (SELECT *, CASE WHEN record_id % 3 = 0 THEN concat('rs', record_id % 30) ELSE concat('rs', record_id) END AS rsid FROM v_clinvar WHERE sig LIKE 'Patho%' AND stars >= 1 AND upper(gene) IN ('BRAND#2', 'BRAND#7', 'BRAND#11', 'BRAND#19', 'BRAND#3', 'BRAND#9')),
  fit AS (SELECT * FROM k WHERE regexp_full_match(alt, '[ACGT]+') AND ref <> alt),
  lost AS (SELECT rsid FROM fit GROUP BY rsid HAVING count(DISTINCT (chrom, start, ref, alt)) > 1),
  named AS (SELECT fit.*, lost.rsid IS NOT NULL AS several, CASE WHEN lost.rsid IS NULL THEN fit.rsid ELSE concat_ws(':', chrom, start, ref, alt) END AS identity FROM fit LEFT JOIN lost ON fit.rsid = lost.rsid),
  grown AS (SELECT identity, CASE WHEN NOT several THEN rsid END AS rsid, upper(gene) AS gene, unnest(CASE WHEN chrom IN ('Y', 'MT') THEN [''] ELSE [concat(least(ref, alt), '/', greatest(ref, alt)), concat(alt, '/', alt)] END) AS genotype FROM named),
  cites AS (SELECT DISTINCT rsid AS variant, pmid FROM v_studies WHERE rsid IN (SELECT rsid FROM grown WHERE rsid IS NOT NULL)),
  capped AS (SELECT *, row_number() OVER (PARTITION BY variant ORDER BY pmid) AS n FROM cites)"""


def _gene_panel(spark, d):
    records = B.clinvar(spark, d)
    rsid = F.when(F.col("record_id") % 3 == 0, F.concat(F.lit("rs"), (F.col("record_id") % 30).cast("string"))).otherwise(T.first_rs(F.col("info")))
    genes = spark.createDataFrame([(g,) for g in ("Brand#2", "brand#7", "BRAND#11", "Brand#19", "old3", "typo", "unknown")], "gene string")
    official = B.table(spark, d, "part").select(F.col("p_brand").alias("symbol")).unionByName(spark.createDataFrame([("Brand#3",), ("Brand#9",), ("Brand#2",), ("Brand#19",)], "symbol string")).distinct()
    curated = spark.createDataFrame([("typo", "Brand#9")], "gene string, symbol string")
    synonyms = spark.createDataFrame([("old3", "Brand#3")], "synonym string, symbol string")
    cited = B.studies(spark, d).filter("rsid IS NOT NULL").select("rsid", "pmid")
    return N.build_panel(records.withColumns({"rsid": rsid, "genes": F.array("gene")}), genes, curated, official, synonyms, cited, 1, 2)


@query("mart_06", f"WITH {_PANEL_RECORDS} SELECT gene, count(*) AS rows_, count(DISTINCT identity) AS variants, count(DISTINCT rsid) AS by_rsid FROM grown GROUP BY gene")
def mart_06(spark, d):
    """A gene panel: symbols reconciled, pathogenic records of its genes, of enough stars and fit alleles, rsIDs that name several places told by coordinate, genotypes filled."""
    return _gene_panel(spark, d).variants.groupBy("gene").agg(F.count("*").alias("rows_"), F.countDistinct("identity").alias("variants"), F.countDistinct("rsid").alias("by_rsid"))


@query("mart_06_studies", f"WITH {_PANEL_RECORDS} SELECT variant, coalesce(array_to_string(list_sort(list(pmid) FILTER (n <= 2)), ','), '') AS kept, count(*) FILTER (n > 2) AS dropped, CAST(0 AS BIGINT) AS unsound FROM capped GROUP BY variant")
def mart_06_studies(spark, d):
    return _gene_panel(spark, d).studies


@query("mart_06_counters", f"""WITH {_PANEL_RECORDS} SELECT 'symbols changed' AS name, 2 AS n UNION ALL SELECT 'symbols unresolved', 1 + (SELECT count(*) FROM (VALUES ('brand#7'), ('BRAND#11')) t(x)) UNION ALL SELECT 'records in panel', count(*) FROM k
  UNION ALL SELECT 'identities by coordinate', count(*) FROM lost UNION ALL SELECT 'variants', count(DISTINCT identity) FROM grown UNION ALL SELECT 'rows', count(*) FROM grown
  UNION ALL SELECT 'citations dropped', count(*) FILTER (n > 2) FROM capped UNION ALL SELECT 'rejected: not_acgt', count(*) FROM k WHERE NOT regexp_full_match(alt, '[ACGT]+') HAVING count(*) > 0
  UNION ALL SELECT 'rejected: same_allele', count(*) FROM k WHERE regexp_full_match(alt, '[ACGT]+') AND ref = alt HAVING count(*) > 0""")
def mart_06_counters(spark, d):
    return _gene_panel(spark, d).counters


_TOLD = "CASE WHEN p_partkey % 2 = 0 THEN concat('slashed ', p_type) WHEN p_partkey % 3 = 0 THEN concat('bare ', p_type) END"


def _drug_annotations(spark, d):
    key = F.col("p_partkey")
    genotype = F.concat_ws("/", F.least(B.base_at(key), B.base_at(key + 1)), F.greatest(B.base_at(key), B.base_at(key + 1)))
    part = B.table(spark, d, "part").select(key.alias("annotation_id"), genotype.alias("genotype"), F.col("p_brand").alias("gene"), F.col("p_name").alias("drug"), level().alias("level"), "p_type")
    rows = part.drop("p_type")
    slashed = part.filter("annotation_id % 2 = 0").select("annotation_id", "genotype", F.concat(F.lit("slashed "), "p_type").alias("text"))
    bare = part.filter("annotation_id % 3 = 0").select("annotation_id", F.regexp_replace("genotype", "/", "").alias("genotype"), F.concat(F.lit("bare "), "p_type").alias("text"))
    return N.build_drug_annotations(rows, slashed.unionByName(bare))


@query("mart_07", f"SELECT p_brand AS gene, count(*) AS annotations, count(DISTINCT p_name) AS drugs, count({_TOLD}) AS told, count(DISTINCT {_TOLD}) AS texts FROM part WHERE p_size % 7 < 4 GROUP BY p_brand")
def mart_07(spark, d):
    """Drug annotations of enough evidence, with the text of their genotype."""
    told, _ = _drug_annotations(spark, d)
    return told.groupBy("gene").agg(F.count("*").alias("annotations"), F.countDistinct("drug").alias("drugs"), F.count("text").alias("told"), F.countDistinct("text").alias("texts"))


@query("mart_07_counters", f"SELECT count(DISTINCT p_partkey) AS annotations, count(DISTINCT p_name) AS drugs, count(DISTINCT p_brand) AS genes, count({_TOLD}) AS texts FROM part WHERE p_size % 7 < 4")
def mart_07_counters(spark, d):
    return _drug_annotations(spark, d)[1]


@query("mart_08", "SELECT rsid, genotype, weight, state FROM (SELECT rsid, genotype, weight, CASE WHEN weight > 0 THEN 'protective' WHEN weight < 0 THEN 'risk' ELSE 'neutral' END AS state, row_number() OVER (PARTITION BY rsid, genotype ORDER BY weight) AS n FROM (SELECT concat('rs', p_partkey % 300) AS rsid, concat(least(a, b), '/', greatest(a, b)) AS genotype, CAST(p_size - 25 AS DOUBLE) / CAST(10 AS DOUBLE) AS weight FROM (SELECT *, " + B._A + " AS a, " + B._B + " AS b FROM part))) WHERE n = 1")
def mart_08(spark, d):
    """An authored source adapted: genotype and weight read from text, state by sign, one row for each variant and genotype."""
    key = F.col("p_partkey")
    source = B.table(spark, d, "part").select(F.concat(F.lit("rs"), (key % 300).cast("string")).alias("rsid"), F.concat(B.base_at(key + 1), B.base_at(key)).alias("pair"), F.replace(((F.col("p_size") - 25) / F.lit(10.0)).cast("string"), F.lit("."), F.lit(",")).alias("raw"))
    rows = source.withColumns({"genotype": G.slash_genotype(F.col("pair")), "weight": G.parse_weight(F.col("raw"))}).withColumn("state", G.state_of(F.col("weight")))
    return U.without_duplicates(rows, ["rsid", "genotype"], "weight").select("rsid", "genotype", "weight", "state")


_A, _B = B._A, B._B
_WEIGHED = f"""w AS (SELECT p_partkey AS line, CASE WHEN p_partkey % 13 = 0 THEN concat('x', p_partkey) ELSE concat('rs', p_partkey % 300) END AS rsid,
    CASE WHEN p_partkey % 11 <> 0 THEN concat(least({_A}, {_B}), '/', greatest({_A}, {_B})) END AS genotype, CAST(p_size - 25 AS DOUBLE) / CAST(10 AS DOUBLE) AS weight,
    CASE WHEN p_partkey % 2 = 0 THEN concat('of row ', p_partkey) END AS own FROM part),
  m AS (SELECT concat('rs', p_partkey) AS rsid, p_brand AS gene, p_type AS told, p_partkey AS line FROM part)"""


def _weight_tables(spark, d):
    key, part = F.col("p_partkey"), B.table(spark, d, "part")
    weights = part.select(
        key.alias("line"), F.when(key % 13 == 0, F.concat(F.lit("x"), key.cast("string"))).otherwise(F.concat(F.lit("rs"), (key % 300).cast("string"))).alias("rsid"),
        F.when(key % 11 == 0, "--").otherwise(F.concat(B.base_at(key + 1), F.lit("|"), B.base_at(key))).alias("genotype"),
        F.replace(((F.col("p_size") - 25) / F.lit(10.0)).cast("string"), F.lit("."), F.lit(",")).alias("weight"), F.when(key % 2 == 0, F.concat(F.lit("of row "), key.cast("string"))).otherwise(" ").alias("conclusion"),
    )
    meta = part.select(key.alias("line"), F.concat(F.lit("rs"), key.cast("string")).alias("rsid"), F.col("p_brand").alias("gene"), F.col("p_type").alias("conclusion"), F.concat(F.lit("PMID "), (key + 5000).cast("string")).alias("pmids"), F.lit("").alias("population"))
    studies = B.studies(spark, d).select(F.col("pmid").cast("bigint").alias("line"), "rsid", F.concat(F.lit("PMID: "), (F.col("pmid").cast("bigint") % 40 + 5000).cast("string")).alias("cell"), "conclusion", F.lit("x").alias("population"), F.lit("Significant").alias("association"))
    return P.port_weights(weights, meta, studies)


@query("mart_08_three_table", f"WITH {_WEIGHED}, v AS (SELECT w.rsid, genotype, weight, CASE WHEN weight > 0 THEN 'protective' WHEN weight < 0 THEN 'risk' ELSE 'neutral' END AS state, coalesce(own, told, '') AS conclusion, gene, row_number() OVER (PARTITION BY w.rsid, genotype ORDER BY w.line) AS n, count(*) OVER (PARTITION BY w.rsid, genotype) - 1 AS duplicates FROM w LEFT JOIN m ON w.rsid = m.rsid WHERE w.rsid LIKE 'rs%' AND genotype IS NOT NULL) SELECT rsid, genotype, weight, state, conclusion, gene, duplicates FROM v WHERE n = 1")
def mart_08_three_table(spark, d):
    """Weights joined with what is known of their variants; the first of equal variants and genotypes stays."""
    return _weight_tables(spark, d).variants.drop("category")


@query("mart_08_three_table_rejected", f"WITH {_WEIGHED} SELECT reason, count(*) AS n, count(DISTINCT rsid) AS ids FROM (SELECT rsid, CASE WHEN rsid NOT LIKE 'rs%' THEN 'invalid rsid' ELSE 'invalid genotype' END AS reason FROM w WHERE rsid NOT LIKE 'rs%' OR genotype IS NULL UNION ALL SELECT DISTINCT rsid, 'vanished' FROM w WHERE rsid LIKE 'rs%' AND rsid NOT IN (SELECT rsid FROM w WHERE genotype IS NOT NULL)) GROUP BY reason")
def mart_08_three_table_rejected(spark, d):
    return _weight_tables(spark, d).rejected.groupBy("reason").agg(F.count("*").alias("n"), F.countDistinct("rsid").alias("ids"))


@query("mart_08_three_table_studies", "WITH s AS (SELECT rsid, CAST(CAST(pmid AS BIGINT) % 40 + 5000 AS VARCHAR) AS pmid, conclusion, 'x' AS population, 'significant' AS significance, CAST(pmid AS BIGINT) AS line FROM v_studies WHERE rsid IS NOT NULL UNION ALL SELECT concat('rs', p_partkey), CAST(p_partkey + 5000 AS VARCHAR), p_type, NULL, NULL, p_partkey + 1099511627776 FROM part) SELECT rsid, pmid, conclusion, population, significance FROM (SELECT *, row_number() OVER (PARTITION BY rsid, pmid ORDER BY line) AS n FROM s) WHERE n = 1")
def mart_08_three_table_studies(spark, d):
    """The dedicated table of studies, topped up from the variants' cells."""
    return _weight_tables(spark, d).studies


_EFFECTS = f"""a AS (SELECT p_partkey AS line, CASE WHEN p_partkey % 13 = 0 THEN concat('x', p_partkey) ELSE concat('rs', p_partkey % 300) END AS rsid, CASE WHEN p_partkey % 9 = 0 THEN 'N' WHEN p_partkey % 4 = 0 THEN {B._BASE.format('p_partkey % 300')} ELSE {B._BASE.format('p_partkey % 300 + 1')} END AS allele,
    p_partkey % 2 = 0 AS hom, CAST(p_size - 25 AS DOUBLE) / CAST(10 AS DOUBLE) AS weight, p_size % 6 AS category_id FROM part),
  f AS (SELECT concat('rs', o_custkey) AS rsid, CASE WHEN o_custkey % 3 = 0 THEN '' ELSE o_orderpriority END AS told, o_custkey % 30 AS gene_id, row_number() OVER (PARTITION BY o_custkey ORDER BY length(CASE WHEN o_custkey % 3 = 0 THEN '' ELSE o_orderpriority END) DESC, o_orderkey) AS n FROM orders),
  best AS (SELECT rsid, told, n_name AS gene FROM f LEFT JOIN nation ON gene_id = n_nationkey WHERE n = 1),
  g AS (SELECT a.*, CASE WHEN allele <> 'N' AND r.id IS NULL AND hom THEN concat(allele, '/', allele) WHEN allele <> 'N' AND hom THEN concat(allele, '/', allele) WHEN allele = 'N' OR r.id IS NULL THEN NULL WHEN allele = r.ref THEN concat(least(r.ref, r.alt), '/', greatest(r.ref, r.alt)) ELSE concat(least(allele, r.ref), '/', greatest(allele, r.ref)) END AS genotype FROM a LEFT JOIN v_reference r ON a.rsid = r.id)"""


@query("mart_08_longevity", f"WITH {_EFFECTS}, v AS (SELECT g.rsid, genotype, weight, CASE WHEN weight > 0 THEN 'protective' WHEN weight < 0 THEN 'risk' ELSE 'neutral' END AS state, coalesce(nullif(told, ''), concat('Longevity-associated variant in ' || gene, ''), 'Longevity-associated variant') AS conclusion, gene, r_name AS category, row_number() OVER (PARTITION BY g.rsid, genotype ORDER BY line) AS n, count(*) OVER (PARTITION BY g.rsid, genotype) - 1 AS duplicates FROM g LEFT JOIN best ON g.rsid = best.rsid LEFT JOIN region ON category_id = r_regionkey WHERE g.rsid LIKE 'rs%' AND genotype IS NOT NULL) SELECT rsid, genotype, weight, state, CASE WHEN conclusion = '' THEN 'Longevity-associated variant' ELSE conclusion END AS conclusion, gene, category, duplicates FROM v WHERE n = 1")
def mart_08_longevity(spark, d):
    """Effect alleles with dimensions: genotypes by the reference's alleles, the longest conclusion of each variant's findings."""
    key, part, cust = F.col("p_partkey"), B.table(spark, d, "part"), F.col("o_custkey")
    alleles = part.select(
        key.alias("line"), F.when(key % 13 == 0, F.concat(F.lit("x"), key.cast("string"))).otherwise(F.concat(F.lit("rs"), (key % 300).cast("string"))).alias("rsid"),
        F.when(key % 9 == 0, "N").when(key % 4 == 0, B.base_at(key % 300)).otherwise(B.base_at(key % 300 + 1)).alias("allele"), F.when(key % 2 == 0, "hom").otherwise("Heterozygous").alias("zygosity"),
        ((F.col("p_size") - 25) / F.lit(10.0)).cast("string").alias("weight"), (F.col("p_size") % 6).alias("category_id"),
    )
    findings = B.table(spark, d, "orders").select(
        F.col("o_orderkey").alias("line"), F.concat(F.lit("rs"), cust.cast("string")).alias("rsid"), F.when(cust % 3 == 0, " ").otherwise(F.col("o_orderpriority")).alias("conclusion"), (cust % 30).alias("gene_id"),
        (cust % 25).alias("population_id"), F.lit("significant").alias("association"), F.concat(F.lit("PMID "), F.col("o_orderkey").cast("string")).alias("cell"),
    )
    nation = B.table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))
    region = B.table(spark, d, "region").select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("name"))
    return P.port_effect_alleles(alleles, findings, nation, region, nation, B.reference(spark, d)).variants


_NAMED = f"""n AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 10 = 0 THEN '' WHEN p_partkey % 17 = 0 THEN concat('q', p_partkey) ELSE concat('rs', p_partkey) END AS rsid, p_brand AS gene,
    CASE p_partkey % 6 WHEN 0 THEN 'stated' WHEN 1 THEN 'alleles' WHEN 2 THEN 'indel' ELSE 'none' END AS kind, p_partkey % 3 AS zyg, {_A} AS a, {_B} AS b, {B._BASE.format('p_partkey + 2')} AS c, p_partkey % 5 = 0 AS several, p_type AS told,
    p_size % 2 = 0 AS listed, p_brand IN ('Brand#3', 'Brand#7') AS grounded FROM part),
  chosen AS (SELECT * FROM n WHERE rsid LIKE 'rs%' AND (listed OR (grounded AND kind = 'indel'))),
  sets AS (SELECT *, CASE kind WHEN 'stated' THEN [concat(a, '/', a)] WHEN 'none' THEN CASE WHEN several THEN [] ELSE CASE zyg WHEN 0 THEN [concat(b, '/', b)] WHEN 1 THEN [concat(least(a, b), '/', greatest(a, b))] ELSE [concat(least(a, b), '/', greatest(a, b)), concat(b, '/', b)] END END
    ELSE list_transform(CASE zyg WHEN 0 THEN ['hom'] WHEN 1 THEN ['het'] ELSE ['het', 'hom'] END, lambda z: CASE WHEN z = 'hom' THEN concat(CASE WHEN kind = 'indel' THEN b || 'T' ELSE b END, '/', CASE WHEN kind = 'indel' THEN b || 'T' ELSE b END)
      ELSE concat(least(a, CASE WHEN kind = 'indel' THEN b || 'T' ELSE b END), '/', greatest(a, CASE WHEN kind = 'indel' THEN b || 'T' ELSE b END)) END) END AS genotypes FROM chosen)"""


def _named_alleles(spark, d):
    key, part = F.col("p_partkey"), B.table(spark, d, "part")
    rs = F.concat(F.lit("rs"), key.cast("string"))
    kind, named = key % 6, (key % 6).isin(1, 2)
    source = part.select(
        key.alias("line"), F.when(key % 10 == 0, " ").when(key % 17 == 0, F.concat(F.lit("q"), key.cast("string"))).otherwise(rs).alias("rsid"), F.col("p_brand").alias("gene"),
        F.when(kind == 0, F.concat(B.base_at(key), B.base_at(key))).alias("genotype"), F.when(named, B.base_at(key)).alias("ref"), F.when(kind == 1, F.lower(B.base_at(key + 1))).when(kind == 2, F.concat(B.base_at(key + 1), F.lit("T"))).alias("alt"),
        F.when(key % 3 == 0, "Homozygous").when(key % 3 == 1, "het").otherwise("both").alias("zygosity"), F.col("p_type").alias("conclusion"),
    )
    keep = part.filter("p_size % 2 = 0").select(rs.alias("rsid"), F.array((key + 7000).cast("string")).alias("pmids"), F.when(key % 4 == 0, "reviewed").alias("conclusion"))
    genes = spark.createDataFrame([("Brand#3", ["81", "82"]), ("Brand#7", ["83"])], "gene string, pmids array<string>")
    alts = F.when(key % 5 == 0, F.concat_ws("|", B.base_at(key + 1), B.base_at(key + 2))).otherwise(B.base_at(key + 1))
    reference = part.select(rs.alias("id"), B.base_at(key).alias("ref"), alts.alias("alts"))
    supp = F.col("s_suppkey")
    additions = B.table(spark, d, "supplier").select(F.concat(F.lit("rs90000"), supp.cast("string")).alias("rsid"), F.lit("added").alias("gene"), F.array(F.lit("A/G"), F.lit("G/G")).alias("genotypes"), F.lit("").alias("conclusion"), F.array(F.lit("99")).alias("pmids"))
    return P.port_named_alleles(source, keep, genes, reference, additions)


@query("mart_08_superhuman", f"WITH {_NAMED} SELECT rsid, genotype, 'protective' AS state, CASE WHEN listed AND k % 4 = 0 THEN 'reviewed' ELSE told END AS conclusion, gene FROM (SELECT *, unnest(genotypes) AS genotype FROM sets) UNION ALL SELECT concat('rs90000', s_suppkey), unnest(['A/G', 'G/G']), 'protective', 'Beneficial variant', 'added' FROM supplier")
def mart_08_superhuman(spark, d):
    """Named alleles in two passes over a keep-list; genotypes as the source states them, or as the locus allows."""
    return _named_alleles(spark, d).variants.select("rsid", "genotype", "state", "conclusion", "gene")


@query("mart_08_superhuman_rejected", f"WITH {_NAMED} SELECT reason, count(*) AS n FROM (SELECT CASE WHEN rsid NOT LIKE 'rs%' THEN 'invalid rsid' ELSE 'unnamed' END AS reason FROM n WHERE rsid <> '' AND NOT (rsid LIKE 'rs%' AND (listed OR (grounded AND kind = 'indel'))) UNION ALL SELECT 'ambiguous allele' FROM sets WHERE len(genotypes) = 0) GROUP BY reason")
def mart_08_superhuman_rejected(spark, d):
    return _named_alleles(spark, d).rejected.groupBy("reason").agg(F.count("*").alias("n"))


@query("mart_09", f"SELECT key, concat('rs', key) AS variant_key, {B._CONTIG.format('key', 'MT')} AS chrom, key * 97 + 1 AS start, array_to_string(regexp_split_to_array(genotype, '[/|]'), ',') AS genotype, concat(ref, ';', 'T') AS alts FROM v_text")
def mart_09(spark, d):
    """Authored rows, half of them by rsID and half by place, compiled: identity resolved, genotype and alternates as lists."""
    even = F.col("key") % 2 == 0
    rows = B.lead_text(spark, d).select("key", F.when(even, F.col("rsid")).alias("rsid"), F.when(~even, F.col("chrom")).alias("chrom"), F.when(~even, F.col("start")).alias("start"), "ref", "genotype", F.concat("ref", F.lit(",,T")).alias("alts"))
    done = U.compile_weights(rows, B.reference(spark, d))
    return done.select("key", "variant_key", "chrom", "start", F.array_join("genotype", ",").alias("genotype"), F.array_join("alts", ";").alias("alts"))


@query("mart_09_studies", f"WITH s AS (SELECT CASE WHEN CAST(pmid AS BIGINT) % 5 = 0 THEN NULL WHEN rsid IS NULL THEN concat('rs', CAST((start - 1) / 97 AS BIGINT)) ELSE rsid END AS variant_key, start, conclusion, pmid FROM v_studies), r AS (SELECT variant_key, conclusion, unnest([CAST(CAST(pmid AS BIGINT) + 10000 AS VARCHAR), CAST(CAST(pmid AS BIGINT) + 20000 AS VARCHAR)]) AS pmid FROM s) SELECT variant_key, pmid, min(conclusion) AS conclusion FROM r GROUP BY ALL")
def mart_09_studies(spark, d):
    """Authored studies, some by rsID, some by place and some of no variant, with several article numbers in a cell, compiled by variant."""
    n = lambda by: (F.col("pmid").cast("bigint") + by).cast("string")
    none = F.col("pmid").cast("bigint") % 5 == 0
    by_place = F.col("rsid").isNull() & ~none
    authored = B.studies(spark, d).select(
        F.when(~none, F.col("rsid")).alias("rsid"), F.when(by_place, F.col("chrom")).alias("chrom"), F.when(by_place, F.col("start")).alias("start"), "ref", "conclusion",
        F.concat(F.lit("PMID: "), n(10000), F.lit("; PMID "), n(20000)).alias("pmid"),
    )
    return U.compile_studies(authored, B.reference(spark, d))


@query("mart_09_annotations", "SELECT rsid AS variant_key, genotype, state AS conclusion, CASE WHEN key % 3 = 0 THEN 'none' END AS negatives, gene, category FROM v_text UNION ALL SELECT rsid, genotype, state, 'smokers', gene, category FROM v_text WHERE key % 4 = 0")
def mart_09_annotations(spark, d):
    """Facts of authored rows once for each variant, genotype, conclusion and negatives."""
    rows = B.lead_text(spark, d).withColumns({"conclusion": F.col("state"), "phenotype": F.lit(None).cast("string"), "negatives": F.when(F.col("key") % 3 == 0, "none")})
    other = rows.filter("key % 4 = 0").withColumn("negatives", F.lit("smokers"))
    return U.compile_annotations(rows.unionByName(rows).unionByName(other)).drop("phenotype")


_ODD = """v AS (SELECT key, CASE WHEN key % 29 = 0 THEN '' WHEN key % 9 = 0 THEN concat('x', rsid) ELSE rsid END AS rsid, CASE WHEN key % 29 = 0 THEN '' WHEN key % 31 = 0 THEN '99' ELSE chrom END AS chrom,
    CASE WHEN key % 29 = 0 OR key % 23 = 0 THEN '' ELSE CAST(start AS VARCHAR) END AS start, CASE WHEN contains(genotype, '/') AND key % 8 = 0 THEN reverse(genotype) ELSE genotype END AS genotype,
    CASE WHEN key % 4 = 0 AND state = 'risk' THEN 7 WHEN key % 4 = 0 AND state = 'protective' THEN -7 ELSE weight END AS weight, CASE WHEN key % 37 = 0 THEN 'odd' ELSE state END AS state FROM v_text),
  twice AS (SELECT key, rsid, chrom, start, genotype FROM v UNION ALL SELECT key, rsid, chrom, start, genotype FROM v WHERE key % 41 = 0 UNION ALL SELECT key, rsid, chrom, CAST(CAST(start AS BIGINT) + 1 AS VARCHAR), 'moved' FROM v WHERE key % 43 = 0 AND start <> ''),
  every AS (SELECT * FROM v UNION ALL SELECT * FROM v WHERE key % 41 = 0 UNION ALL SELECT key, rsid, chrom, CAST(CAST(start AS BIGINT) + 1 AS VARCHAR), 'moved', NULL, '' FROM v WHERE key % 43 = 0 AND start <> ''),
  named AS (SELECT *, CASE WHEN rsid <> '' THEN rsid ELSE concat(chrom, ':', start) END AS name FROM every)"""


@query("mart_10", f"""WITH {_ODD} SELECT rule, severity, count(*) AS n FROM (
  SELECT 'unsorted_genotype' AS rule, 'error' AS severity FROM every WHERE contains(genotype, '/') AND list_sort(string_split(genotype, '/')) <> string_split(genotype, '/')
  UNION ALL SELECT 'bad_rsid', 'error' FROM every WHERE rsid LIKE 'x%' UNION ALL SELECT 'unknown_state', 'error' FROM every WHERE state = 'odd' UNION ALL SELECT 'unknown_contig', 'error' FROM every WHERE chrom = '99'
  UNION ALL SELECT 'no_identifier', 'error' FROM every WHERE rsid = '' AND chrom = '' AND start = '' UNION ALL SELECT 'partial_position', 'error' FROM every WHERE (chrom = '') <> (start = '')
  UNION ALL SELECT 'positive_risk', 'warning' FROM every WHERE state = 'risk' AND weight > 0 UNION ALL SELECT 'negative_protective', 'warning' FROM every WHERE state = 'protective' AND weight < 0
  UNION ALL SELECT 'duplicate_variant', 'error' FROM (SELECT name, genotype FROM named GROUP BY ALL HAVING count(*) > 1)
  UNION ALL SELECT 'two_positions', 'error' FROM (SELECT rsid FROM every WHERE rsid <> '' AND start <> '' GROUP BY rsid HAVING count(DISTINCT (chrom, start)) > 1)
  UNION ALL SELECT 'duplicate_study', 'error' FROM (SELECT rsid, pmid FROM (SELECT rsid, pmid FROM v_studies UNION ALL SELECT rsid, pmid FROM v_studies WHERE CAST(pmid AS BIGINT) % 50 = 0) GROUP BY ALL HAVING count(*) > 1)
  UNION ALL SELECT 'orphan_study', 'warning' FROM (SELECT DISTINCT rsid FROM v_studies WHERE rsid IS NOT NULL AND rsid NOT IN (SELECT rsid FROM every))) GROUP BY ALL""")
def mart_10(spark, d):
    """Every rule of the checks of authored tables, on rows that breach each of them."""
    k = F.col("key")
    none = k % 29 == 0
    swapped = F.when(F.col("genotype").contains("/") & (k % 8 == 0), F.reverse("genotype")).otherwise(F.col("genotype"))
    fourth = k % 4 == 0
    weight = F.when(fourth & (F.col("state") == "risk"), "7").when(fourth & (F.col("state") == "protective"), "-7").otherwise(F.col("weight").cast("string"))
    rows = B.lead_text(spark, d).select(
        "key", F.when(none, "").when(k % 9 == 0, F.concat(F.lit("x"), "rsid")).otherwise(F.col("rsid")).alias("rsid"), F.when(none, "").when(k % 31 == 0, "99").otherwise(F.col("chrom")).alias("chrom"),
        F.when(none | (k % 23 == 0), "").otherwise(F.col("start").cast("string")).alias("start"), swapped.alias("genotype"), weight.alias("weight"), F.when(k % 37 == 0, "odd").otherwise(F.col("state")).alias("state"),
    )
    moved = rows.filter("key % 43 = 0 AND start <> ''").withColumns({"start": (F.col("start").cast("bigint") + 1).cast("string"), "genotype": F.lit("moved"), "weight": F.lit(None).cast("string"), "state": F.lit("")})
    studies = B.studies(spark, d).select("rsid", "pmid")
    studies = studies.unionByName(studies.filter(F.col("pmid").cast("bigint") % 50 == 0))
    return U.problems(rows.unionByName(rows.filter("key % 41 = 0")).unionByName(moved).drop("key"), studies).groupBy("rule", "severity").agg(F.count("*").alias("n"))


@query("mart_10_without_studies", "SELECT 'missing_studies' AS rule, 'error' AS severity, count(*) AS n FROM (SELECT 1 FROM v_text LIMIT 1)")
def mart_10_without_studies(spark, d):
    """Sound rows without any study."""
    rows = B.lead_text(spark, d).filter(~F.col("genotype").contains("/")).select("rsid", "chrom", F.col("start").cast("string").alias("start"), "genotype", F.col("weight").cast("string").alias("weight"), "state")
    return U.problems(rows, B.studies(spark, d).select("rsid", "pmid").limit(0)).groupBy("rule", "severity").agg(F.count("*").alias("n"))


def _drop_folder(spark, d):
    """VCF text of samples under a folder of their user, as samples arrive: each task's calls of a user are one sample, so that files don't grow with the table."""
    path = scratch(spark, "arrivals")
    dot = F.coalesce("rsid", F.lit("."))
    line = F.concat_ws("\t", "chrom", F.col("start").cast("string"), dot, "ref", F.replace("alt", F.lit("|"), F.lit(",")), F.col("qual").cast("string"), "filter", F.concat(F.lit("DP="), F.col("dp").cast("string")), F.lit("GT"), "gt")
    B.callset(spark, d).select(F.concat(F.lit("user"), F.col("sample").cast("string")).alias("user"), line.alias("value")).write.partitionBy("user").text(path)
    return path


@query("str_01", "SELECT sample AS n_sample, count(*) AS n FROM v_callset GROUP BY sample")
def str_01(spark, d):
    """Every file of the folder once, by a file stream; its lines by user."""
    folder, name = _drop_folder(spark, d), "arrived_lines"
    out, done = scratch(spark, name), scratch(spark, "checkpoint")
    arrivals.lines_by_file(spark, folder).writeStream.format("parquet").option("path", out).option("checkpointLocation", done).trigger(availableNow=True).start().awaitTermination()
    counted = spark.read.schema("source string, value string").parquet(out).groupBy("source").agg(F.count("*").alias("n"))
    user = F.regexp_extract(arrivals.sample_key(F.col("source")), r"user=user([0-9]+)/", 1).cast("bigint")
    return counted.groupBy(user.alias("n_sample")).agg(F.sum("n").alias("n"))


@query("str_02", "SELECT sample AS n_sample, 'core' AS module, count(*) AS written, count(module) AS matched FROM v_annotated GROUP BY sample UNION ALL SELECT sample, 'risks', count(*), count(module) FROM v_annotated a WHERE EXISTS (SELECT 1 FROM v_lead l WHERE l.state = 'risk' AND l.chrom = a.chrom AND l.start = a.start) GROUP BY sample")
def str_02(spark, d):
    """New samples normalised, quality-filtered and annotated with all modules, batch by batch; each batch leaves its rows and its outcomes."""
    out, done = scratch(spark, "annotated-samples"), scratch(spark, "checkpoint")
    lead = B.lead(spark, d)
    readers = {"core": lambda: lead, "risks": lambda: lead.filter("state = 'risk'"), "lost": lambda: tables.module_table(spark, scratch(spark, "missing"))}
    arrivals.annotate_arrivals(spark, _drop_folder(spark, d), readers, out, done, B.FILTERS).awaitTermination()
    user = F.regexp_extract("sample", r"user=user([0-9]+)/", 1).cast("bigint")
    return arrivals.arrived(spark, out).groupBy(user.alias("n_sample"), F.col("run_module").alias("module")).agg(F.count("*").alias("written"), F.count("module").alias("matched"))


@query("str_02_outcomes", "SELECT module, kind, reason, CAST(coalesce(written, 0) AS BIGINT) AS written FROM (VALUES ('core', 'ok', NULL), ('lost', 'failed', 'PATH_NOT_FOUND')) m(module, kind, reason) LEFT JOIN (SELECT 'core' AS module, count(*) AS written FROM v_annotated) USING (module)")
def str_02_outcomes(spark, d):
    """The outcomes of all batches, summed by module."""
    out, done = scratch(spark, "annotated-samples"), scratch(spark, "checkpoint")
    lead = B.lead(spark, d)
    arrivals.annotate_arrivals(spark, _drop_folder(spark, d), {"core": lambda: lead, "lost": lambda: tables.module_table(spark, scratch(spark, "missing"))}, out, done, B.FILTERS).awaitTermination()
    return arrivals.outcomes(spark, out).groupBy("module", "kind", "reason").agg(F.sum("written").alias("written"))
