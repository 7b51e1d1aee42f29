"""Queries: contigs, projections, filters, genotype functions and callset facts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import contigs as C
from ..functions import genotypes as G
from ..operators import aggregates as A
from ..operators import filters as L
from ..operators import joins as J
from ..operators import runs as R
from ..sources import tables, vcf
from ..sources.scratch import scratch
from . import base as B
from .base import query


@query("prj_01", "SELECT replace(chrom, 'chr', '') AS chrom, count(*) AS n, count(rsid) AS with_rsid FROM v_callset GROUP BY 1")
def prj_01(spark, d):
    return B.callset(spark, d).withColumn("chrom", C.strip_chr(F.col("chrom"))).groupBy("chrom").agg(F.count("*").alias("n"), F.count("rsid").alias("with_rsid"))


@query("prj_02", "SELECT CASE WHEN rec % 3 = 0 THEN NULL ELSE substr(chrom, 4) END AS chrom, count(*) AS n FROM v_callset GROUP BY 1")
def prj_02(spark, d):
    messy = F.when(F.col("rec") % 3 == 0, "  ").when(F.col("rec") % 3 == 1, F.concat(F.lit(" "), F.upper("chrom"))).otherwise(F.col("chrom"))
    return B.callset(spark, d).select(C.strip_any_chr(messy).alias("chrom")).groupBy("chrom").agg(F.count("*").alias("n"))


@query("prj_03", "SELECT concat('chr', substr(chrom, 4)) AS chrom, count(*) AS n FROM v_callset GROUP BY 1")
def prj_03(spark, d):
    mixed = F.when(F.col("rec") % 2 == 0, C.strip_chr(F.col("chrom"))).otherwise(F.col("chrom"))
    return B.callset(spark, d).select(C.with_chr(mixed).alias("chrom")).groupBy("chrom").agg(F.count("*").alias("n"))


@query("prj_04", "SELECT chrom AS chrom_as_is, substr(chrom, 4) AS chrom_bare, chrom AS chrom_prefixed, count(*) AS n FROM v_callset GROUP BY 1, 2, 3")
def prj_04(spark, d):
    return C.candidate_spellings(B.callset(spark, d)).groupBy("chrom_as_is", "chrom_bare", "chrom_prefixed").agg(F.count("*").alias("n"))


@query("prj_05", "SELECT bool_or(starts_with(chrom, 'chr')) AS prefixed, array_to_string(list_sort(list(DISTINCT chrom)), ',') AS names, count(DISTINCT chrom) AS n_names FROM v_callset")
def prj_05(spark, d):
    return C.naming_style(B.callset(spark, d))


@query("prj_06", "SELECT substr(chrom, 4) AS chrom, 'stripped' AS chrom_action, count(*) AS n FROM v_callset GROUP BY 1")
def prj_06(spark, d):
    return C.harmonise(B.callset(spark, d), B.reference(spark, d)).groupBy("chrom", "chrom_action").agg(F.count("*").alias("n"))


@query("prj_08", "SELECT CASE substr(chrom, 4) WHEN 'M' THEN 'MT' ELSE substr(chrom, 4) END AS chrom, min(start) AS low, max(start) AS high FROM v_callset GROUP BY 1")
def prj_08(spark, d):
    return B.callset(spark, d).withColumn("chrom", C.fold_contig(F.col("chrom"))).groupBy("chrom").agg(F.min("start").alias("low"), F.max("start").alias("high"))


@query("prj_09", "SELECT 'gene,state,weight' AS columns, count(*) AS n FROM v_lead")
def prj_09(spark, d):
    df = B.lead(spark, d).select("chrom", "start", "rsid", "ref", "genotype", "weight", "state", "gene")
    return df.agg(F.lit(",".join(sorted(vcf.annotation_columns(df)))).alias("columns"), F.count("*").alias("n"))


@query("prj_10", "SELECT chrom, start, CAST(NULL AS VARCHAR) AS phenotype, gene FROM v_lead")
def prj_10(spark, d):
    df = B.lead(spark, d).select("chrom", "start", "gene")
    return df.withColumns({c: F.lit(None).cast("string") for c in ("gene", "phenotype") if c not in df.columns})


@query("prj_11", "SELECT id, id AS rsid, chrom, start FROM v_reference")
def prj_11(spark, d):
    return B.reference(spark, d).select("id", F.col("id").alias("rsid"), "chrom", "start")


@query("prj_12", "SELECT chrom, start, rsid_core AS rsid, weight FROM v_annotated WHERE module IS NOT NULL")
def prj_12(spark, d):
    df = J.annotate_by_position(B.calls(spark, d), B.lead(spark, d), "core").filter("module IS NOT NULL")
    return df.drop("rsid").withColumnRenamed("rsid_core", "rsid").select("chrom", "start", "rsid", "weight")


@query("prj_13", "SELECT 'called' AS genotype_evidence, count(*) AS n FROM v_annotated")
def prj_13(spark, d):
    return J.annotate_by_position(B.calls(spark, d), B.lead(spark, d), "core").groupBy("genotype_evidence").agg(F.count("*").alias("n"))


@query("prj_14", "SELECT coalesce(rsid, '') AS rsid, array_to_string(genotype, '/') AS genotype, coalesce(gene, '') AS gene, coalesce(state, '') AS state, coalesce(CAST(weight AS VARCHAR), '') AS weight, CASE WHEN len(genotype) < 2 THEN '' WHEN genotype[1] = genotype[2] THEN 'hom' ELSE 'het' END AS zygosity FROM v_annotated")
def prj_14(spark, d):
    df = J.annotate_by_position(B.calls(spark, d), B.lead(spark, d), "core")
    texts = {c: F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("rsid", "gene", "state", "weight")}
    return df.withColumn("zygosity", G.zygosity(F.col("genotype"))).withColumns(texts).select("rsid", F.array_join("genotype", "/").alias("genotype"), "gene", "state", "weight", "zygosity")


_KEPT = "SELECT sample, count(*) AS n, CAST(sum(start) AS BIGINT) AS places FROM v_callset WHERE {} GROUP BY sample"


def _kept(df):
    return df.groupBy("sample").agg(F.count("*").alias("n"), F.sum("start").alias("places"))


@query("flt_01", _KEPT.format("filter IN ('PASS', '.', '') AND dp >= 10 AND qual >= 20"))
def flt_01(spark, d):
    return _kept(L.quality_filter(B.callset(spark, d), **B.FILTERS))


@query("flt_02", _KEPT.format("filter IN ('.', '')"))
def flt_02(spark, d):
    return _kept(L.quality_filter(B.callset(spark, d), passing=["."]))


@query("flt_04", _KEPT.format("rsid LIKE 'rs%'"))
def flt_04(spark, d):
    return _kept(L.only_rs(B.callset(spark, d)))


@query("flt_05", "SELECT count(*) FILTER (l.ref <> c.ref) AS discarded FROM v_probed c JOIN v_lead l ON c.chrom = l.chrom AND c.start = l.start AND c.genotype = l.genotype")
def flt_05(spark, d):
    return J.contradicted(B.calls(spark, d), B.slim_lead(spark, d))


@query("flt_06", "SELECT chrom, start, sample, weight FROM v_annotated WHERE module IS NOT NULL")
def flt_06(spark, d):
    return L.matched_rows(J.annotate_by_position(B.calls(spark, d), B.lead(spark, d), "core")).select("chrom", "start", "sample", "weight")


_HOM_LEAD = """WITH hom AS (SELECT chrom, start, ref, CASE WHEN key % 4 = 0 THEN [ref, ref] ELSE genotype END AS genotype, CASE WHEN key % 9 = 0 THEN 2 END AS locus_count FROM v_lead
  UNION ALL SELECT chrom, start, 'GG' AS ref, ['GG', 'GG'] AS genotype, NULL AS locus_count FROM v_lead WHERE key % 12 = 0),
  clear AS (SELECT chrom, start FROM hom GROUP BY ALL HAVING count(DISTINCT ref) = 1),
  fit AS (SELECT h.* FROM hom h JOIN clear c USING (chrom, start) WHERE coalesce(locus_count, 1) <= 1 AND len(genotype) > 0 AND len(list_filter(genotype, lambda g: g <> ref)) = 0) """


def _hom_lead(spark, d):
    lead = B.lead(spark, d)
    own = lead.select("chrom", "start", "ref", F.when(F.col("key") % 4 == 0, F.array("ref", "ref")).otherwise(F.col("genotype")).alias("genotype"), F.when(F.col("key") % 9 == 0, 2).alias("locus_count"))
    other = lead.filter("key % 12 = 0").select("chrom", "start", F.lit("GG").alias("ref"), F.array(F.lit("GG"), F.lit("GG")).alias("genotype"), F.lit(None).cast("int").alias("locus_count"))
    return own.unionByName(other)


@query("flt_07", _HOM_LEAD + "SELECT chrom, start, ref FROM fit")
def flt_07(spark, d):
    return L.hom_ref_rows(_hom_lead(spark, d)).select("chrom", "start", "ref")


@query("flt_08", "SELECT chrom, count(*) AS n FROM v_calls WHERE regexp_full_match(chrom, '[0-9]+|X|Y|MT') GROUP BY 1")
def flt_08(spark, d):
    return L.primary_only(B.calls(spark, d)).groupBy("chrom").agg(F.count("*").alias("n"))


@query("flt_09", "SELECT s_suppkey AS source, s_name AS attribution FROM supplier WHERE s_nationkey % 2 = 0")
def flt_09(spark, d):
    rows = B.table(spark, d, "supplier").select(F.col("s_suppkey").alias("source"), F.col("s_name").alias("attribution"), F.when(F.col("s_nationkey") % 2 == 0, "annotation").otherwise("raw").alias("layer"))
    return rows.filter("layer = 'annotation'").drop("layer") if "layer" in rows.columns else rows


_LEVEL = "CASE p_size % 7 WHEN 0 THEN '1A' WHEN 1 THEN '1B' WHEN 2 THEN '2A' WHEN 3 THEN '2B' WHEN 4 THEN '3' WHEN 5 THEN '4' ELSE '' END"


def level(c="p_size"):
    return F.element_at(F.array(*map(F.lit, [*G.EVIDENCE, ""])), (F.col(c) % 7 + 1).cast("int"))


@query("flt_10", f"SELECT p_partkey, {_LEVEL} AS level FROM part WHERE p_size % 7 < 4")
def flt_10(spark, d):
    return B.table(spark, d, "part").select("p_partkey", level().alias("level")).filter(G.evidence_rank(F.col("level")) >= G.evidence_rank(F.lit("2B")))


@query("flt_11", "SELECT record_id FROM v_clinvar WHERE sig IN ('Pathogenic', 'Pathogenic/Likely_pathogenic') AND stars >= 2")
def flt_11(spark, d):
    from ..functions.literature import info_value

    return B.clinvar(spark, d).withColumn("sig", info_value(F.col("info"), "CLNSIG")).filter(F.col("sig").isin("Pathogenic", "Pathogenic/Likely_pathogenic") & (F.col("stars") >= 2)).select("record_id")


@query("flt_12", "SELECT CASE WHEN NOT regexp_full_match(alt, '[ACGT]+') THEN 'not_acgt' WHEN ref = alt THEN 'same_allele' ELSE 'kept' END AS reason, count(*) AS n FROM v_clinvar GROUP BY 1")
def flt_12(spark, d):
    return B.clinvar(spark, d).groupBy(F.coalesce(G.allele_rejection(F.col("ref"), F.col("alt")), F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


@query("flt_13", "SELECT count(*) FILTER (regexp_full_match(rsid, 'rs[0-9]+')) AS valid, count(*) FILTER (rsid IS NULL OR NOT regexp_full_match(rsid, 'rs[0-9]+')) AS invalid FROM v_callset")
def flt_13(spark, d):
    valid = F.coalesce(F.col("rsid").rlike("^rs[0-9]+$"), F.lit(False))
    return B.callset(spark, d).agg(F.count_if(valid).alias("valid"), F.count_if(~valid).alias("invalid"))


@query("flt_14", "SELECT key, gene, weight FROM v_lead WHERE contains(lower(gene), 'brand#1') AND weight >= 0.5 AND lower(category) IN ('economy', 'promo')")
def flt_14(spark, d):
    items = [{"field": "gene", "operator": "contains", "value": "BRAND#1"}, {"field": "weight", "operator": ">=", "value": 0.5}, {"field": "category", "operator": "isAnyOf", "value": ["Economy", "PROMO"]}]
    return L.grid_filter(B.lead(spark, d), items).select("key", "gene", "weight")


@query("flt_15", "SELECT sample, count(*) FILTER (chrom = 'Y') AS on_y, count(*) AS n FROM v_calls GROUP BY sample")
def flt_15(spark, d):
    return B.calls(spark, d).groupBy("sample").agg(F.count_if(F.col("chrom").isin("Y", "chrY")).alias("on_y"), F.count("*").alias("n"))


@query("flt_16", _KEPT.format("dp > 30 AND gt = '0/1'"))
def flt_16(spark, d):
    return _kept(B.callset(spark, d).filter((F.col("dp") > 30) & (F.col("gt") == "0/1")))


@query("sc_01", "SELECT gt, ref, alt, array_to_string(" + B._GENOTYPE + ", '/') AS genotype, count(*) AS n FROM v_callset GROUP BY ALL")
def sc_01(spark, d):
    df = B.callset(spark, d).withColumn("genotype", F.array_join(G.genotype_from_gt(F.col("gt"), F.col("ref"), F.col("alt")), "/"))
    return df.groupBy("gt", "ref", "alt", "genotype").agg(F.count("*").alias("n"))


@query("sc_02", "SELECT key, array_to_string(genotype, ',') AS genotype, len(genotype) AS n FROM v_lead")
def sc_02(spark, d):
    return B.lead(spark, d).select("key", F.array_join("genotype", ",").alias("genotype"), F.size("genotype").cast("long").alias("n"))


@query("sc_03", "SELECT key, CASE WHEN contains(genotype, '|') THEN genotype ELSE array_to_string(list_sort(string_split(genotype, '/')), '/') END AS genotype_key FROM v_text")
def sc_03(spark, d):
    return B.lead_text(spark, d).select("key", G.genotype_key(G.authored_genotype(F.col("genotype")), F.col("genotype").contains("|")).alias("genotype_key"))


@query("sc_04", "SELECT CASE WHEN len(genotype) < 2 THEN '' WHEN genotype[1] = genotype[2] THEN 'hom' ELSE 'het' END AS zygosity, count(*) AS n FROM v_calls GROUP BY 1")
def sc_04(spark, d):
    return B.calls(spark, d).groupBy(G.zygosity(F.col("genotype")).alias("zygosity")).agg(F.count("*").alias("n"))


@query("sc_05", "SELECT allele, count(*) AS n FROM (SELECT unnest(string_split(alt, '|')) AS allele FROM v_callset) GROUP BY 1")
def sc_05(spark, d):
    return B.callset(spark, d).select(F.explode(G.alt_alleles(F.col("alt"))).alias("allele")).groupBy("allele").agg(F.count("*").alias("n"))


_STATED = "CASE key % 5 WHEN 0 THEN ' ' WHEN 1 THEN 'Risk' END"
_DIRECTION = f"CASE WHEN key % 5 = 1 THEN 'risk' WHEN key % 2 = 0 THEN CASE WHEN weight > 0 THEN 'protective' WHEN weight < 0 THEN 'risk' ELSE 'neutral' END WHEN state IN ('risk', 'protective') THEN state ELSE 'neutral' END"


def _direction():
    stated = F.when(F.col("key") % 5 == 0, " ").when(F.col("key") % 5 == 1, "Risk")
    return G.direction(stated, F.when(F.col("key") % 2 == 0, "significant").otherwise(F.col("state")), F.col("weight"))


@query("sc_06", f"SELECT key, {_DIRECTION} AS direction FROM v_lead")
def sc_06(spark, d):
    return B.lead(spark, d).select("key", _direction().alias("direction"))


@query("sc_07", "SELECT key, tier, concat(upper(substr(replace(tier, '_', ' '), 1, 1)), substr(replace(tier, '_', ' '), 2)) AS label FROM (SELECT key, CASE WHEN key % 4 = 0 THEN 'likely_pathogenic' WHEN key % 4 = 1 THEN 'pathogenic' WHEN key % 4 = 2 THEN 'benign' WHEN key % 8 = 3 THEN 'uncertain_significance' ELSE '' END AS tier FROM v_lead)")
def sc_07(spark, d):
    k = F.col("key") % 4
    tier = G.clinical_tier(F.when(k == 0, "Likely_Pathogenic").otherwise(" "), k == 1, k == 2, F.col("key") % 8 == 3)
    return B.lead(spark, d).select("key", tier.alias("tier"), G.tier_label(tier).alias("label"))


@query("sc_08", f"SELECT key, CASE WHEN weight > 0 THEN 1 WHEN weight < 0 THEN -1 ELSE CASE {_DIRECTION} WHEN 'protective' THEN 1 WHEN 'risk' THEN -1 ELSE 0 END END AS sign FROM v_lead")
def sc_08(spark, d):
    return B.lead(spark, d).select("key", G.variant_sign(F.col("weight"), _direction()).alias("sign"))


@query("sc_09", f"SELECT {_LEVEL} AS level, CASE WHEN p_size % 7 < 6 THEN 6 - p_size % 7 ELSE 0 END AS rank, count(*) AS n FROM part GROUP BY ALL")
def sc_09(spark, d):
    return B.table(spark, d, "part").groupBy(level().alias("level"), G.evidence_rank(F.lower(level())).alias("rank")).agg(F.count("*").alias("n"))


@query("sc_10", "SELECT coalesce(rsid, concat(chrom, ':', start, ':', ref)) AS study_key, count(*) AS n FROM v_studies GROUP BY 1")
def sc_10(spark, d):
    return B.studies(spark, d).groupBy(G.study_key(F.col("rsid"), F.col("chrom"), F.col("start"), F.col("ref")).alias("study_key")).agg(F.count("*").alias("n"))


@query("sc_11", "SELECT ref, alt, CASE WHEN contains(alt, '|') THEN NULL ELSE concat(least(ref, alt), '/', greatest(ref, alt)) END AS genotype, count(*) AS n FROM v_callset GROUP BY ALL")
def sc_11(spark, d):
    return B.callset(spark, d).withColumn("genotype", G.slash_genotype(F.concat(F.lower("alt"), "ref"))).groupBy("ref", "alt", "genotype").agg(F.count("*").alias("n"))


_PAIR = "CASE WHEN key % 3 = 0 THEN concat(alt, '/', alt) WHEN key % 2 = 0 THEN concat(least(ref, alt), '/', greatest(ref, alt)) END"


@query("sc_12", "SELECT rec, CASE rec % 3 WHEN 0 THEN concat(a, '/', a) WHEN 1 THEN concat(least(ref, a), '/', greatest(ref, a)) END AS genotype FROM (SELECT rec, ref, string_split(alt, '|')[1] AS a FROM v_callset WHERE ref <> string_split(alt, '|')[1])")
def sc_12(spark, d):
    df = B.callset(spark, d).withColumn("allele", F.split("alt", "[|]")[0]).filter("allele <> ref")
    zyg = F.when(F.col("rec") % 3 == 0, "hom").when(F.col("rec") % 3 == 1, "het").otherwise("?")
    return df.select("rec", G.genotype_of(F.col("allele"), zyg, F.col("ref"), F.col("alt")).alias("genotype"))


@query("sc_13", "SELECT rec, concat(least(ref, a), '/', greatest(ref, a)) AS genotype FROM (SELECT rec, ref, string_split(alt, '|')[1] AS a FROM v_callset WHERE contains(alt, '|'))")
def sc_13(spark, d):
    df = B.callset(spark, d).filter("contains(alt, '|')")
    return df.select("rec", G.genotype_of(F.col("ref"), F.lit("Heterozygous"), F.col("ref"), F.col("alt")).alias("genotype"))


@query("sc_14", "SELECT rec, g AS genotype FROM (SELECT rec, unnest([concat(least(ref, alt), '/', greatest(ref, alt)), concat(alt, '/', alt)]) AS g FROM v_callset WHERE NOT contains(alt, '|') AND ref <> alt)")
def sc_14(spark, d):
    each = lambda z: G.genotype_of(F.col("alt"), F.lit(z), F.col("ref"), F.col("alt"))
    df = B.callset(spark, d).filter(~F.col("alt").contains("|") & (F.col("ref") != F.col("alt")))
    return df.select("rec", F.explode(F.array(each("het"), each("hom"))).alias("genotype"))


@query("sc_16", "SELECT key, CASE WHEN weight > 0 THEN 'protective' WHEN weight < 0 THEN 'risk' ELSE 'neutral' END AS state FROM v_lead")
def sc_16(spark, d):
    return B.lead(spark, d).select("key", G.state_of(F.col("weight")).alias("state"))


@query("sc_17", "SELECT key, CASE WHEN key % 4 = 0 THEN NULL ELSE weight END AS weight FROM v_lead")
def sc_17(spark, d):
    text = F.col("weight").cast("string")
    raw = F.when(F.col("key") % 4 == 0, "n/a").when(F.col("key") % 4 == 1, F.replace(text, F.lit("."), F.lit(","))).otherwise(F.concat(F.lit(" "), text))
    return B.lead(spark, d).select("key", G.parse_weight(raw).alias("weight"))


@query("sc_19", "SELECT key, CASE key % 3 WHEN 0 THEN 'significant' WHEN 1 THEN 'non-significant' END AS verdict FROM (SELECT p_partkey AS key FROM part)")
def sc_19(spark, d):
    raw = F.when(F.col("p_partkey") % 3 == 0, " Significant").when(F.col("p_partkey") % 3 == 1, "not significant").otherwise("maybe")
    return B.table(spark, d, "part").select(F.col("p_partkey").alias("key"), G.significance(raw).alias("verdict"))


@query("sc_26", "SELECT length(ref) <> length(alt) AS indel, regexp_full_match(alt, '[ACGT]+') AS bases, count(*) AS n FROM v_clinvar GROUP BY ALL")
def sc_26(spark, d):
    return B.clinvar(spark, d).groupBy(G.is_indel(F.col("ref"), F.col("alt")).alias("indel"), G.is_base(F.col("alt")).alias("bases")).agg(F.count("*").alias("n"))


@query("sc_27", "SELECT rec, CAST(dp * 2 + 1 AS BIGINT) AS total, list_max([CAST(dp AS DOUBLE) / (dp * 2 + 1), CAST(dp + 1 AS DOUBLE) / (dp * 2 + 1)]) AS most FROM v_callset")
def sc_27(spark, d):
    df = B.callset(spark, d).withColumn("ad", F.array(F.col("dp"), F.col("dp") + 1))
    total = F.aggregate("ad", F.lit(0).cast("bigint"), lambda s, x: s + x)
    df = df.withColumn("total", total).withColumn("vaf", F.transform("ad", lambda x: x / F.col("total")))
    return df.filter((F.size("vaf") == 2) & F.forall("vaf", lambda x: (x >= 0) & (x <= 1))).select("rec", "total", F.array_max("vaf").alias("most"))


@query("ag_02", "SELECT count(*) FILTER (contains(genotype, '|')) AS phased, count(*) FILTER (contains(genotype, '|') AND list_sort(string_split(genotype, '|')) <> string_split(genotype, '|')) AS unmatchable FROM v_text")
def ag_02(spark, d):
    return A.phased_counts(B.lead_text(spark, d))


@query("ag_03", "SELECT coalesce(bool_or(starts_with(rsid, 'rs')), false) AS has_rsid FROM v_callset")
def ag_03(spark, d):
    return A.any_rsid(B.callset(spark, d))


@query("ag_04", "SELECT CASE WHEN bool_or(contains(alt, 'NON_REF') OR contains(filter, 'RefCall')) THEN 'all_sites' ELSE 'variant_only' END AS mode FROM v_callset")
def ag_04(spark, d):
    return A.input_mode(B.callset(spark, d))


_GAPS = "WITH s AS (SELECT DISTINCT chrom, start FROM v_sites), g AS (SELECT *, start - lag(start) OVER (PARTITION BY chrom ORDER BY start) AS gap FROM s), per AS (SELECT chrom, sum(least(gap, 7200)) AS covered, max(start) - min(start) AS span FROM g GROUP BY chrom) "


@query("ag_05", _GAPS + "SELECT CAST(sum(covered) AS BIGINT) AS covered, CAST(sum(span) AS BIGINT) AS span, CAST(sum(covered) AS DOUBLE) / CAST(sum(span) AS DOUBLE) AS breadth FROM per")
def ag_05(spark, d):
    return A.coverage_breadth(B.sites(spark, d), B.FLANK).select("covered", "span", "breadth")


@query("ag_06", "SELECT chrom, start, count(DISTINCT ref) AS refs FROM (SELECT chrom, start, ref FROM v_lead UNION ALL SELECT chrom, start, ref FROM v_reference) GROUP BY ALL HAVING count(DISTINCT ref) > 1")
def ag_06(spark, d):
    both = B.lead(spark, d).select("chrom", "start", "ref").unionByName(B.reference(spark, d).select("chrom", "start", "ref"))
    return both.groupBy("chrom", "start").agg(F.countDistinct("ref").alias("refs")).filter("refs > 1")


_SCOPE = _GAPS.replace("FROM v_sites", "FROM v_sites WHERE regexp_full_match(chrom, '[0-9]+|X|Y|MT')") + "SELECT (SELECT count(*) FROM s) AS sites, round(CAST(sum(covered) AS DOUBLE) / CAST(sum(span) AS DOUBLE), 6) AS breadth, CASE WHEN (SELECT count(*) FROM s) < {0} OR sum(covered) / sum(span) < 0.75 THEN 'targeted' ELSE 'wgs' END AS scope, CASE WHEN (SELECT count(*) FROM s) < {0} THEN 'few sites' WHEN sum(covered) / sum(span) < 0.75 THEN 'narrow' ELSE 'wide' END AS reason FROM per"


@query("ag_07", _SCOPE.format(1_000_000))
def ag_07(spark, d):
    return A.callset_scope(B.sites(spark, d), B.FLANK)


@query("wn_01", _GAPS + "SELECT chrom, start, gap FROM g")
def wn_01(spark, d):
    return A.gaps(B.sites(spark, d))


@query("so_01", "SELECT DISTINCT chrom, start FROM v_sites ORDER BY chrom, start")
def so_01(spark, d):
    return B.sites(spark, d).distinct().orderBy("chrom", "start")


@query("ag_24", "SELECT sample, count(*) AS before, count(*) FILTER (filter IN ('PASS', '.', '') AND dp >= 10 AND qual >= 20) AS after, count(*) FILTER (NOT (filter IN ('PASS', '.', '') AND dp >= 10 AND qual >= 20)) AS removed FROM v_callset GROUP BY sample")
def ag_24(spark, d):
    df = B.callset(spark, d)
    kept = F.coalesce(L.quality_condition(df, **B.FILTERS), F.lit(False))
    return df.groupBy("sample").agg(F.count("*").alias("before"), F.count_if(kept).alias("after"), F.count_if(~kept).alias("removed"))


@query("mart_02", _HOM_LEAD + f""", {B.ENABLED}, called AS (SELECT DISTINCT chrom, start FROM v_calls), absent AS (SELECT f.* FROM fit f WHERE NOT EXISTS (SELECT 1 FROM called c WHERE c.chrom = f.chrom AND c.start = f.start)),
  far AS (SELECT a.chrom, a.start, a.ref, a.genotype, min(abs(a.start - c.start)) AS restored_flank_bp FROM absent a JOIN called c ON a.chrom = c.chrom GROUP BY ALL)
  SELECT CAST(NULL AS BIGINT) AS sample, chrom, start, ref, CAST(NULL AS VARCHAR) AS alt, array_to_string(genotype, '/') AS genotype, CAST(NULL AS DOUBLE) AS qual, 'restored_hom_ref' AS genotype_evidence, restored_flank_bp
  FROM far WHERE restored_flank_bp <= {B.FLANK} AND (SELECT enabled FROM facts)""")
def mart_02(spark, d):
    """Restored reference genotypes as rows of the callset, where its mode and scope allow them."""
    kept = B.calls(spark, d).select("sample", "chrom", "start", "rsid", "ref", "alt", "qual", "filter", "genotype")
    calls = tables.write_table(kept, scratch(spark, "calls"))  # scope, mode and restoration read it
    rows = R.restored_rows(calls, _hom_lead(spark, d), B.FLANK)
    if not R.context_of(calls, B.FLANK, B.RUN_SITES).restores:
        rows = rows.limit(0)
    return rows.select("sample", "chrom", "start", "ref", "alt", F.array_join("genotype", "/").alias("genotype"), "qual", "genotype_evidence", "restored_flank_bp")


@query("jn_08", "SELECT l.chrom, l.start, l.key FROM v_lead l WHERE NOT EXISTS (SELECT 1 FROM v_calls c WHERE c.chrom = l.chrom AND c.start = l.start)")
def jn_08(spark, d):
    return J.absent_sites(B.lead(spark, d).select("chrom", "start", "key"), B.calls(spark, d))


@query("jn_09", _HOM_LEAD + "SELECT DISTINCT chrom, start FROM hom EXCEPT SELECT chrom, start FROM clear")
def jn_09(spark, d):
    return J.ambiguous_loci(_hom_lead(spark, d))


@query("jn_10", f"""WITH s AS (SELECT DISTINCT chrom, start FROM v_sites), q AS (SELECT DISTINCT CAST((user_id + 1) % 20 AS VARCHAR) AS chrom, CAST(floor(epoch(ts)) AS BIGINT) + 1777 AS start FROM events),
  near AS (SELECT q.chrom, q.start, min(abs(q.start - s.start)) AS distance FROM q JOIN s ON q.chrom = s.chrom GROUP BY ALL) SELECT * FROM near WHERE distance <= {B.FLANK}""")
def jn_10(spark, d):
    s = B.sites(spark, d)
    asked = B.table(spark, d, "events").select(((F.col("user_id") + 1) % 20).cast("string").alias("chrom"), (F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', CAST(ts AS TIMESTAMP_NTZ))") + 1777).alias("start")).distinct()
    return J.nearest_within(asked, s, B.FLANK)
