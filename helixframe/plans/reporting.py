"""Queries: report marts, grid reads and polygenic scores."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import genotypes as G
from ..operators import aggregates as A
from ..operators import filters as L
from ..operators import joins as J
from ..operators import runs as R
from ..operators.ranking import SortedView
from ..sources import prepared, tables
from ..sources.scratch import scratch
from . import base as B
from .base import query
from .normalise import _LEVEL, level

_STATES = "SELECT module, count(*) AS n, count(*) FILTER (state = 'protective') AS protective, count(*) FILTER (state = 'risk') AS risk, count(*) FILTER (state = 'neutral') AS neutral, round(sum(weight), 3) AS total, round(avg(weight), 3) AS mean, min(weight) AS least, max(weight) AS most FROM v_lead GROUP BY module"


@query("ag_09", _STATES)
def ag_09(spark, d):
    return A.by_state(B.lead(spark, d))


@query("ag_10", "SELECT CASE WHEN p_size % 3 = 0 THEN p_type ELSE p_brand END AS trait, count(*) AS n_models, min(concat('EFO', p_size)) AS efo_id, CAST(trunc(avg(p_size * 10)) AS BIGINT) AS avg_variants, min(p_size * 10) AS min_variants, max(p_size * 10) AS max_variants, array_to_string(list_sort(list(concat('PGS', p_partkey))), ', ') AS pgs_ids FROM part GROUP BY 1")
def ag_10(spark, d):
    models = B.table(spark, d, "part").select(
        F.when(F.col("p_size") % 3 == 0, F.col("p_type")).otherwise(" ").alias("trait_efo"), F.col("p_brand").alias("trait_reported"), F.concat(F.lit("EFO"), F.col("p_size").cast("string")).alias("trait_efo_id"),
        (F.col("p_size") * 10).alias("n_variants"), F.concat(F.lit("PGS"), F.col("p_partkey").cast("string")).alias("pgs_id"),
    )
    return A.traits(models)


#: The fixed categories of a report; some have no row here.
CATEGORIES = ["ECONOMY", "PROMO", "STANDARD", "SMALL", "empty", "other"]
_CATEGORY = "CASE WHEN key % 10 = 0 THEN NULL ELSE category END"


@query("ag_11", f"WITH c AS (SELECT unnest({CATEGORIES}) AS category), r AS (SELECT coalesce({_CATEGORY}, 'other') AS category, count(*) AS variants, count(*) FILTER (weight > 0) AS positive, count(*) FILTER (weight < 0) AS negative, sum(weight) AS net FROM v_lead GROUP BY 1) SELECT c.category, coalesce(variants, 0) AS variants, coalesce(positive, 0) AS positive, coalesce(negative, 0) AS negative, round(coalesce(net, 0.0), 2) AS net_weight FROM c LEFT JOIN r USING (category)")
def ag_11(spark, d):
    rows = B.lead(spark, d).withColumns({"category": F.when(F.col("key") % 10 != 0, F.col("category")), "sign": G.variant_sign(F.col("weight"), F.lit("neutral"))})
    return A.by_category(rows, spark.createDataFrame([(c,) for c in CATEGORIES], "category string"))


_SUMMARY = "SELECT module, count(*) AS total, count(*) FILTER (weight > 0) AS positive, count(*) FILTER (weight < 0) AS negative, round(sum(weight), 2) AS net_weight, CAST(0 AS BIGINT) AS restored FROM v_annotated WHERE module IS NOT NULL GROUP BY module"


@query("ag_12", _SUMMARY)
def ag_12(spark, d):
    return A.module_summary(J.annotate_by_position(B.calls(spark, d), B.lead(spark, d), "core").filter("module IS NOT NULL"))


_DRUGS = f"SELECT drug, max(CASE WHEN p_size % 7 < 6 THEN 6 - p_size % 7 ELSE 0 END) AS best_rank, array_to_string(list_sort(list(DISTINCT p_brand)), ',') AS genes, count(*) AS n, count(*) FILTER (p_size % 7 < 2) AS guideline FROM (SELECT *, CASE WHEN p_partkey % 9 = 0 THEN '(drug not stated)' ELSE p_name END AS drug, {_LEVEL} AS level FROM part) GROUP BY drug"


def _drugs(spark, d):
    return B.table(spark, d, "part").select(F.when(F.col("p_partkey") % 9 == 0, " ").otherwise(F.col("p_name")).alias("drug"), level().alias("evidence_level"), F.col("p_brand").alias("gene"))


@query("ag_13", _DRUGS)
def ag_13(spark, d):
    return A.by_drug(_drugs(spark, d))


@query("ag_14", "SELECT concat('src', s_nationkey) AS source, 'CC0' AS license, concat('by ', s_nationkey) AS attribution, '' AS notice, array_to_string(list_sort(list(DISTINCT concat('m', s_suppkey % 3))), ',') AS modules, bool_and(CASE WHEN s_suppkey % 2 = 0 THEN true END) AS commercial_use FROM supplier GROUP BY 1, 2, 3, 4")
def ag_14(spark, d):
    n = F.col("s_nationkey").cast("string")
    rows = B.table(spark, d, "supplier").select(
        F.concat(F.lit("src"), n).alias("source"), F.lit("CC0").alias("license"), F.concat(F.lit("by "), n).alias("attribution"), F.lit("").alias("notice"),
        F.concat(F.lit("m"), (F.col("s_suppkey") % 3).cast("string")).alias("module"), F.when(F.col("s_suppkey") % 2 == 0, True).alias("commercial_use"),
    )
    return A.credits(rows)


@query("ag_17", "SELECT DISTINCT gene FROM v_clinvar WHERE sig LIKE 'Patho%' AND stars >= 3 ORDER BY gene")
def ag_17(spark, d):
    from ..functions.literature import has_pathogenic, info_value

    return B.clinvar(spark, d).filter(has_pathogenic(info_value(F.col("info"), "CLNSIG")) & (F.col("stars") >= 3)).select("gene").distinct().orderBy("gene")


@query("ag_21", "SELECT count(*) FILTER (key % 6 = 0) AS unplaced, count(*) AS total FROM v_lead")
def ag_21(spark, d):
    rows = B.lead(spark, d).withColumn("chrom", F.when(F.col("key") % 6 != 0, F.col("chrom")))
    return rows.agg(F.count_if(F.col("chrom").isNull()).alias("unplaced"), F.count("*").alias("total"))


@query("ag_22", "SELECT count(DISTINCT p_partkey) AS annotations, count(DISTINCT p_name) AS drugs, count(DISTINCT p_brand) AS genes FROM part")
def ag_22(spark, d):
    return B.table(spark, d, "part").agg(F.countDistinct("p_partkey").alias("annotations"), F.countDistinct("p_name").alias("drugs"), F.countDistinct("p_brand").alias("genes"))


@query("ag_29", "SELECT sample, count(*) AS n, CASE WHEN count(*) >= 1000000 THEN 'wgs' ELSE 'array' END AS kind, CASE WHEN count(*) >= 2000000 THEN 0.97::DOUBLE WHEN count(*) >= 1000000 THEN 0.8::DOUBLE WHEN count(*) >= 300000 THEN 0.75::DOUBLE ELSE 0.85::DOUBLE END AS confidence FROM v_callset GROUP BY sample")
def ag_29(spark, d):
    kind, confidence = A.sample_kind(F.col("n"))
    return B.callset(spark, d).groupBy("sample").agg(F.count("*").alias("n")).select("sample", "n", kind.alias("kind"), confidence.alias("confidence"))


@query("so_02", "SELECT category, key, weight, row_number() OVER (PARTITION BY category ORDER BY abs(weight) DESC, key) AS place FROM v_lead")
def so_02(spark, d):
    """Places inside categories, of which a few hold all rows: from the places in the whole sorted table."""
    rows = B.lead(spark, d).select("category", "key", "weight")
    view = SortedView.write(rows, scratch(spark, "by-category"), "category", F.abs("weight").desc(), "key")
    return view.ranked("place", by=["category"])


_RANK = "CASE WHEN key % 7 < 6 THEN 6 - key % 7 ELSE 0 END"


@query("so_03", f"SELECT key, row_number() OVER (PARTITION BY module ORDER BY abs(weight) DESC, {_RANK} DESC, key) AS place FROM v_lead")
def so_03(spark, d):
    rows = B.lead(spark, d).select("module", "key", F.abs("weight").alias("size"), G.evidence_rank(level("key")).alias("evidence"))
    view = SortedView.write(rows, scratch(spark, "by-module"), "module", F.desc("size"), F.desc("evidence"), "key")
    return view.ranked("place", by=["module"]).select("key", "place")


@query("so_04", f"SELECT drug, best_rank, n FROM ({_DRUGS}) ORDER BY best_rank DESC, n DESC, drug")
def so_04(spark, d):
    return A.by_drug(_drugs(spark, d)).orderBy(F.desc("best_rank"), F.desc("n"), "drug").select("drug", "best_rank", "n")


_PAGES = "(n - 1) // 40 IN (0, 1, 2) OR n > (SELECT count(*) FROM v_lead WHERE weight > 0) - 40"


@query("so_05", f"SELECT n - 1 AS row_index, key, gene, weight FROM (SELECT *, row_number() OVER (ORDER BY gene, weight DESC, key) AS n FROM v_lead WHERE weight > 0) WHERE {_PAGES}")
def so_05(spark, d):
    """A filtered and sorted view, written once; its first three pages and its last one are read from the files that hold them."""
    rows = B.lead(spark, d).filter("weight > 0").select("key", "gene", "weight")
    view = SortedView.write(rows, scratch(spark, "view"), "gene", F.desc("weight"), "key")
    last = max(120, view.total() - 40)
    return view.page(0, 120, "row_index").unionByName(view.page(last, 40, "row_index"))


@query("so_06", "SELECT key, gene, (SELECT count(*) FROM v_lead) AS total FROM v_lead ORDER BY weight DESC, key LIMIT 50 OFFSET 100")
def so_06(spark, d):
    """A page by offset, with the number of all rows, from the view's index."""
    view = SortedView.write(B.lead(spark, d).select("key", "gene", "weight"), scratch(spark, "view"), F.desc("weight"), "key")
    return view.page(100, 50).select("key", "gene", F.lit(view.total()).cast("long").alias("total"))


@query("wn_05", "SELECT row_number() OVER (ORDER BY weight DESC, key) - 1 AS row_index, key FROM v_lead")
def wn_05(spark, d):
    """Every row's place in the whole table."""
    view = SortedView.write(B.lead(spark, d).select("key", "weight"), scratch(spark, "view"), F.desc("weight"), "key")
    return view.ranked("n").select((F.col("n") - 1).alias("row_index"), "key")


@query("so_07", "SELECT DISTINCT gene AS value FROM v_lead WHERE (SELECT count(DISTINCT gene) FROM v_lead) <= 100 ORDER BY 1")
def so_07(spark, d):
    values = B.lead(spark, d).select(F.col("gene").cast("string").alias("value")).dropna().distinct().limit(101)
    return values.withColumn("n", F.count("*").over(Window.partitionBy())).filter("n <= 100").select("value").orderBy("value")


@query("so_08", "SELECT category, key FROM (SELECT category, key, row_number() OVER (PARTITION BY category ORDER BY abs(weight) DESC, key) AS n FROM v_lead) WHERE n <= 10")
def so_08(spark, d):
    order = Window.partitionBy("category").orderBy(F.abs("weight").desc(), "key")
    return B.lead(spark, d).withColumn("n", F.row_number().over(order)).filter("n <= 10").select("category", "key")


_CITED = """st AS (SELECT coalesce(rsid, concat(chrom, ':', start, ':', ref)) AS study_key, count(*) AS n FROM v_studies GROUP BY 1),
  rows_ AS (SELECT a.*, CAST(substr(rsid_core, 3) AS BIGINT) AS k, coalesce(st.n, 0) AS studies FROM v_annotated a LEFT JOIN st ON a.rsid_core = st.study_key WHERE module IS NOT NULL)"""


def _report_rows(spark, d):
    """Matched rows with the module's rsID in the callset's place, enriched by what is known of their variants, and the number of their studies."""
    df = J.annotate_by_position(B.calls(spark, d), B.slim_lead(spark, d), "core")
    df = L.matched_rows(df).drop("rsid").withColumnRenamed("rsid_core", "rsid")
    full = J.with_annotations(df, B.lead(spark, d).select("rsid", "gene", "category"))
    keyed = B.studies(spark, d).withColumn("study_key", G.study_key(F.col("rsid"), F.col("chrom"), F.col("start"), F.col("ref")))
    found = J.studies_of(full.select(F.col("rsid").alias("study_key")), keyed).select(F.col("study_key").alias("rsid"), "n_studies")
    return full.join(found, "rsid", "left").withColumn("n_studies", F.coalesce("n_studies", F.lit(0)))


@query("mart_03", f"WITH {_CITED} SELECT coalesce(category, 'other') AS category, gene, count(*) AS variants, round(sum(weight), 2) + CAST(0 AS DOUBLE) AS net_weight, count(*) FILTER (studies > 0) AS cited, CAST(sum(studies) AS BIGINT) AS studies FROM rows_ GROUP BY ALL")
def mart_03(spark, d):
    """The report's rows by category and gene, with their studies."""
    return _report_rows(spark, d).groupBy(F.coalesce("category", F.lit("other")).alias("category"), "gene").agg(
        F.count("*").alias("variants"), (F.round(F.sum("weight"), 2) + F.lit(0.0)).alias("net_weight"), F.count_if(F.col("n_studies") > 0).alias("cited"), F.sum("n_studies").alias("studies")
    )


_MART_DRUG = "CASE WHEN k % 9 = 0 THEN '(drug not stated)' ELSE concat('drug ', k % 40) END"


@query("mart_03_drugs", f"WITH {_CITED} SELECT {_MART_DRUG} AS drug, max(CASE WHEN k % 7 < 6 THEN 6 - k % 7 ELSE 0 END) AS best_rank, array_to_string(list_sort(list(DISTINCT gene)), ',') AS genes, count(*) AS n, count(*) FILTER (k % 7 < 2) AS guideline FROM rows_ GROUP BY 1")
def mart_03_drugs(spark, d):
    """The report's drugs, for a lead table of drugs and evidence."""
    key = F.col("key")
    drugs = B.lead(spark, d).withColumns({"drug": F.when(key % 9 == 0, " ").otherwise(F.concat(F.lit("drug "), (key % 40).cast("string"))), "evidence_level": level("key")})
    return A.by_drug(L.matched_rows(J.annotate_by_position(B.calls(spark, d), drugs, "core")))


_SCORING = f"sc AS (SELECT concat('PGS', p_brand) AS pgs_id, {B._CONTIG.format('p_partkey', 'MT')} AS chrom, p_partkey * 97 + 1 AS start, {B._B} AS effect_allele, CAST(p_size AS DOUBLE) / CAST(100 AS DOUBLE) AS effect_weight FROM part)"
_SCORES = f"WITH {_SCORING}, j AS (SELECT sc.*, c.sample, len(list_filter(c.genotype, lambda g: g = sc.effect_allele)) AS dosage FROM sc JOIN v_calls c ON sc.chrom = c.chrom AND sc.start = c.start), z AS (SELECT pgs_id, count(*) AS total FROM sc GROUP BY pgs_id), s AS (SELECT sample, pgs_id, round(sum(dosage * effect_weight), 6) AS score, count(DISTINCT (chrom, start)) AS matched FROM j GROUP BY ALL), f AS (SELECT s.*, total, round(CAST(matched AS DOUBLE) / total, 6) AS match_rate, CAST(matched AS DOUBLE) / total < 0.1 AS low_match FROM s JOIN z USING (pgs_id)) "


def _scoring(spark, d):
    k = F.col("p_partkey")
    return B.table(spark, d, "part").select(F.concat(F.lit("PGS"), "p_brand").alias("pgs_id"), B.contig_of(k, "MT").alias("chrom"), (k * 97 + 1).alias("start"), B.base_at(k + 1).alias("effect_allele"), (F.col("p_size") / F.lit(100.0)).alias("effect_weight"))


def _scores(spark, d):
    scoring = _scoring(spark, d)
    rows = J.score_rows(B.calls(spark, d).select("sample", "chrom", "start", "genotype"), scoring)
    return A.polygenic_scores(rows, scoring.groupBy("pgs_id").agg(F.count("*").alias("total")))


@query("jn_28", f"WITH {_SCORING} SELECT pgs_id, count(*) AS n, CAST(sum(len(list_filter(c.genotype, lambda g: g = sc.effect_allele))) AS BIGINT) AS dosage FROM sc JOIN v_calls c ON sc.chrom = c.chrom AND sc.start = c.start GROUP BY pgs_id")
def jn_28(spark, d):
    rows = J.score_rows(B.calls(spark, d).select("sample", "chrom", "start", "genotype"), _scoring(spark, d))
    return rows.groupBy("pgs_id").agg(F.count("*").alias("n"), F.sum("dosage").alias("dosage"))


@query("jn_29", f"WITH {_SCORING} SELECT r.chrom, count(*) AS n FROM v_reference r WHERE EXISTS (SELECT 1 FROM sc WHERE effect_weight > 0.25 AND sc.chrom = r.chrom AND sc.start = r.start) GROUP BY r.chrom")
def jn_29(spark, d):
    """The prepared universe reduced once to the positions that any score uses; it isn't shuffled."""
    wanted = _scoring(spark, d).filter("effect_weight > 0.25").select("chrom", "start").distinct()
    return prepared.at_positions(B.prepared_reference(spark, d), wanted).groupBy("chrom").agg(F.count("*").alias("n"))


@query("ag_27", _SCORES + "SELECT * FROM f")
def ag_27(spark, d):
    return _scores(spark, d)


@query("ag_28", _SCORES + "SELECT a.sample, a.pgs_id, a.score, round(CAST(count(*) FILTER (b.score <= a.score) AS DOUBLE) / count(*), 6) AS percentile, true AS exact FROM f a JOIN f b ON a.pgs_id = b.pgs_id GROUP BY ALL")
def ag_28(spark, d):
    scores = tables.write_table(_scores(spark, d).select("sample", "pgs_id", "score"), scratch(spark, "scores"))  # read several times
    return A.percentiles(scores, scores.select("pgs_id", "score"))


@query("ag_28_sketched", _SCORES + "SELECT count(*) AS n, true AS close, 0 AS exact FROM f")
def ag_28_sketched(spark, d):
    """All distributions by quantile sketches: no percentile is further from the exact one than the sketch's error."""
    scores = tables.write_table(_scores(spark, d).select("sample", "pgs_id", "score"), scratch(spark, "scores"))
    exact, near = (A.percentiles(scores, scores.select("pgs_id", "score"), n) for n in (A.EXACT_ROWS, 0))
    both = near.join(exact.select("sample", "pgs_id", F.col("percentile").alias("true_one")), ["sample", "pgs_id"])
    return both.agg(F.count("*").alias("n"), F.coalesce(F.bool_and(F.abs(F.col("percentile") - F.col("true_one")) <= 0.005), F.lit(True)).alias("close"), F.count_if("exact").cast("int").alias("exact"))


@query("ag_30", _SCORES + "SELECT z.pgs_id, count(f.sample) AS samples, CASE WHEN count(f.sample) = 0 THEN 'failed' ELSE 'ok' END AS outcome FROM (SELECT * FROM z UNION ALL SELECT 'PGSnone', 0) z LEFT JOIN f ON z.pgs_id = f.pgs_id GROUP BY ALL")
def ag_30(spark, d):
    wanted = _scoring(spark, d).select("pgs_id").distinct().unionByName(spark.createDataFrame([("PGSnone",)], "pgs_id string"))
    joined = wanted.join(_scores(spark, d).groupBy("pgs_id").agg(F.count("*").alias("samples")), "pgs_id", "left")
    return joined.select("pgs_id", F.coalesce("samples", F.lit(0)).alias("samples"), F.when(F.col("samples").isNull(), "failed").otherwise("ok").alias("outcome"))


_RESTORED = f"""WITH {B.ENABLED}, {_SCORING}, u AS (SELECT chrom, start, min(ref) AS ref FROM v_reference GROUP BY ALL), base AS (SELECT sc.*, CASE WHEN u.ref IS NULL THEN NULL WHEN u.ref = effect_allele THEN 2 * effect_weight ELSE 0 END AS base FROM sc LEFT JOIN u USING (chrom, start)),
  whole AS (SELECT pgs_id, coalesce(sum(base), 0) AS whole, count(base) AS known, count(*) AS total FROM base GROUP BY pgs_id),
  j AS (SELECT sc.pgs_id, sc.chrom, sc.start, c.sample, sum(len(list_filter(c.genotype, lambda g: g = sc.effect_allele)) * effect_weight) AS part FROM sc JOIN v_calls c ON sc.chrom = c.chrom AND sc.start = c.start GROUP BY ALL),
  s AS (SELECT sample, j.pgs_id, sum(part) AS part, coalesce(sum(base), 0) AS back, count(*) AS n, count(base) AS n_known FROM j JOIN base b ON j.pgs_id = b.pgs_id AND j.chrom = b.chrom AND j.start = b.start GROUP BY ALL),
  f AS (SELECT sample, s.pgs_id, round(CASE WHEN enabled THEN part - back + whole ELSE part END, 6) AS score, round(CAST(CASE WHEN enabled THEN n + known - n_known ELSE n END AS DOUBLE) / total, 6) AS match_rate FROM s JOIN whole USING (pgs_id), facts) """


def _cohort(spark, d):
    """Every sample's scores; positions without a call count as the reference's genotype where the callset allows it. The reference is reduced to the scores' positions once."""
    calls, scoring = B.calls(spark, d), _scoring(spark, d)
    rows = J.score_rows(calls.select("sample", "chrom", "start", "genotype"), scoring)
    if R.context_of(calls, B.FLANK, B.RUN_SITES).restores:
        universe = prepared.at_positions(B.prepared_reference(spark, d), scoring).select("chrom", "start", "ref")
        return A.restored_scores(rows, scoring, universe)
    return A.polygenic_scores(rows, scoring.groupBy("pgs_id").agg(F.count("*").alias("total")))


@query("mart_12", _RESTORED + "SELECT a.sample, a.pgs_id, a.score, a.match_rate, round(CAST(count(*) FILTER (b.score <= a.score) AS DOUBLE) / count(*), 6) AS percentile, round(median(b.score), 6) AS median, round(max(b.score) - min(b.score), 6) AS spread FROM f a JOIN f b ON a.pgs_id = b.pgs_id GROUP BY ALL")
def mart_12(spark, d):
    """Scores of all samples with their percentiles in the cohort, its median and its spread."""
    scores = tables.write_table(_cohort(spark, d).select("sample", "pgs_id", "score", "match_rate"), scratch(spark, "scores"))
    ranked = A.percentiles(scores, scores.select("pgs_id", "score"))
    about = scores.groupBy("pgs_id").agg(F.round(F.percentile("score", F.lit(0.5)), 6).alias("median"), F.round(F.max("score") - F.min("score"), 6).alias("spread"))
    return scores.join(ranked.select("sample", "pgs_id", "percentile"), ["sample", "pgs_id"]).join(about, "pgs_id").select("sample", "pgs_id", "score", "match_rate", "percentile", "median", "spread")


@query("prs_low", _SCORES + "SELECT pgs_id, bool_or(low_match) AS any_low FROM f GROUP BY pgs_id")
def prs_low(spark, d):
    return _scores(spark, d).groupBy("pgs_id").agg(F.bool_or("low_match").alias("any_low"))
