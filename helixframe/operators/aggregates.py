"""Aggregates over callsets, annotated tables, reports and scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.contigs import is_primary
from ..functions.genotypes import evidence_rank

#: A callset of fewer primary sites, or of less breadth, covers targets only.
LEAST_SITES, LEAST_BREADTH = 1_000_000, 0.75


def written_and_matched(annotated: DataFrame) -> DataFrame:
    return annotated.agg(F.count("*").alias("written"), (F.count("module") if "module" in annotated.columns else F.count("*")).alias("matched"))


def phased_counts(lead: DataFrame) -> DataFrame:
    """Phased rows, and those of them in an order that no sorted call can equal; genotype is text."""
    parts = F.split("genotype", "[|]")
    phased = F.col("genotype").contains("|")
    return lead.agg(F.count_if(phased).alias("phased"), F.count_if(phased & (parts != F.array_sort(parts))).alias("unmatchable"))


def any_rsid(calls: DataFrame) -> DataFrame:
    return calls.agg(F.coalesce(F.bool_or(F.col("rsid").startswith("rs")), F.lit(False)).alias("has_rsid"))


def input_mode(calls: DataFrame) -> DataFrame:
    """all_sites if any record is a reference block, else variant_only."""
    block = F.col("alt").contains("NON_REF") | F.col("filter").contains("RefCall")
    return calls.agg(F.when(F.coalesce(F.bool_or(block), F.lit(False)), "all_sites").otherwise("variant_only").alias("mode"))


def gaps(sites: DataFrame, width: int = 1 << 22) -> DataFrame:
    """Distinct sites with the gap to the one before on their contig (null for its first).

    The site before is found inside bins of width positions; a bin's first site takes the last site of the nearest bin before it from
    a list of the contig's bins, as long as the contig divided by width. So no task holds a contig.
    """
    own = sites.select("chrom", "start").distinct().withColumn("bin", F.floor(F.col("start") / width))
    ends = own.groupBy("chrom", "bin").agg(F.max("start").alias("high"))
    ladder = ends.groupBy("chrom").agg(F.collect_list(F.struct("bin", "high")).alias("ladder"))
    below = F.filter("ladder", lambda x: x["bin"] < F.col("bin"))
    before = ends.join(ladder, "chrom").select("chrom", "bin", F.array_max(F.transform(below, lambda x: x["high"])).alias("before"))
    order = Window.partitionBy("chrom", "bin").orderBy("start")
    placed = own.withColumn("lag", F.lag("start").over(order)).join(before, ["chrom", "bin"])
    return placed.select("chrom", "start", (F.col("start") - F.coalesce("lag", "before")).alias("gap"))


def coverage_breadth(sites: DataFrame, flank: int) -> DataFrame:
    """One row: number of distinct sites, covered, span and breadth. A site covers at most 2 * flank of the gap before it, a contig's first site just that."""
    per = gaps(sites).groupBy("chrom").agg(F.count("*").alias("n"), F.sum(F.least(F.col("gap"), F.lit(2 * flank))).alias("covered"), (F.max("start") - F.min("start")).alias("span"))
    total = per.agg(*[F.coalesce(F.sum(a), F.lit(0)).alias(b) for a, b in (("n", "sites"), ("covered", "covered"), ("span", "span"))])
    return total.withColumn("breadth", F.when(F.col("span") > 0, F.col("covered") / F.col("span")).otherwise(0.0))


def callset_scope(sites: DataFrame, flank: int, least_sites: int = LEAST_SITES, least_breadth: float = LEAST_BREADTH) -> DataFrame:
    """One row: number of primary sites, breadth, and scope with its reason."""
    counted = coverage_breadth(sites.filter(is_primary(F.col("chrom"))), flank)
    few, narrow = F.col("sites") < least_sites, F.col("breadth") < least_breadth
    return counted.select("sites", F.round("breadth", 6).alias("breadth"), F.when(few | narrow, "targeted").otherwise("wgs").alias("scope"), F.when(few, "few sites").when(narrow, "narrow").otherwise("wide").alias("reason"))


def by_state(df: DataFrame) -> DataFrame:
    side = lambda s: F.count_if(F.col("state") == s).alias(s)
    return df.groupBy("module").agg(
        F.count("*").alias("n"), side("protective"), side("risk"), side("neutral"), F.round(F.sum("weight"), 3).alias("total"),
        F.round(F.avg("weight"), 3).alias("mean"), F.min("weight").alias("least"), F.max("weight").alias("most"),
    )


def traits(models: DataFrame) -> DataFrame:
    """By trait (the ontology's name where given): models, first ontology id, variants, and the ordered list of models."""
    named = F.coalesce(F.nullif(F.trim("trait_efo"), F.lit("")), F.col("trait_reported"))
    return models.groupBy(named.alias("trait")).agg(
        F.count("*").alias("n_models"), F.min("trait_efo_id").alias("efo_id"), F.avg("n_variants").cast("bigint").alias("avg_variants"),
        F.min("n_variants").alias("min_variants"), F.max("n_variants").alias("max_variants"), F.array_join(F.array_sort(F.collect_list("pgs_id")), ", ").alias("pgs_ids"),
    )


def by_category(rows: DataFrame, categories: DataFrame) -> DataFrame:
    """Every category, empty ones too: variants, positive, negative, net weight. A null category is other; ones outside are left out."""
    counted = rows.groupBy(F.coalesce("category", F.lit("other")).alias("category")).agg(
        F.count("*").alias("variants"), F.count_if(F.col("sign") > 0).alias("positive"), F.count_if(F.col("sign") < 0).alias("negative"), F.sum("weight").alias("net")
    )
    joined = categories.join(counted, "category", "left")
    return joined.select("category", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("variants", "positive", "negative")], F.round(F.coalesce("net", F.lit(0.0)), 2).alias("net_weight"))


def module_summary(rows: DataFrame) -> DataFrame:
    """By module: called rows and their net weight; restored rows are counted apart."""
    called = F.coalesce(F.col("genotype_evidence"), F.lit("called")) == "called"
    return rows.groupBy("module").agg(
        F.count_if(called).alias("total"), F.count_if(called & (F.col("weight") > 0)).alias("positive"), F.count_if(called & (F.col("weight") < 0)).alias("negative"),
        F.round(F.coalesce(F.sum(F.when(called, F.col("weight"))), F.lit(0.0)), 2).alias("net_weight"), F.count_if(~called).alias("restored"),
    )


def by_drug(rows: DataFrame) -> DataFrame:
    """By drug: best evidence, genes, rows and those with guideline evidence."""
    drug = F.coalesce(F.nullif(F.trim("drug"), F.lit("")), F.lit("(drug not stated)"))
    rank = evidence_rank(F.col("evidence_level"))
    return rows.groupBy(drug.alias("drug")).agg(
        F.max(rank).alias("best_rank"), F.array_join(F.array_sort(F.collect_set(F.nullif(F.trim("gene"), F.lit("")))), ",").alias("genes"), F.count("*").alias("n"), F.count_if(rank >= 5).alias("guideline")
    )


def credits(rows: DataFrame) -> DataFrame:
    """Licence rows once for each source, licence, attribution and notice, with their modules in order."""
    return rows.groupBy("source", "license", "attribution", "notice").agg(F.array_join(F.array_sort(F.collect_set("module")), ",").alias("modules"), F.bool_and("commercial_use").alias("commercial_use"))


def collapsed_identities(records: DataFrame) -> DataFrame:
    """rsIDs that name several places or alleles, but for those with several alternates of one ref; and the rows they would lose."""
    named = records.groupBy("rsid").agg(F.countDistinct("chrom", "start", "ref", "alt").alias("places"))
    protected = records.groupBy("rsid", "chrom", "start", "ref").agg(F.countDistinct("alt").alias("alts")).filter("alts > 1").select("rsid").distinct()
    return named.filter("places > 1").join(protected, "rsid", "left_anti").select("rsid", "places", (F.col("places") - 1).alias("lost"))


def ambiguous_rsids_cleared(rows: DataFrame) -> DataFrame:
    """rows with rsid null where it names several positions."""
    several = rows.groupBy("rsid").agg(F.countDistinct("chrom", "start").alias("places")).filter("places > 1").select("rsid", F.lit(True).alias("several"))
    return rows.join(several, "rsid", "left").withColumn("rsid", F.when(F.col("several").isNull(), F.col("rsid"))).drop("several")


def alleles_by_rsid(resolution: DataFrame) -> DataFrame:
    alleles = F.explode(F.array_union(F.array("ref"), F.filter(F.split("alts", "[,|]"), lambda x: x != ""))).alias("allele")
    return resolution.select("rsid", alleles).groupBy("rsid").agg(F.array_sort(F.collect_set("allele")).alias("alleles"))


def polygenic_scores(rows: DataFrame, sizes: DataFrame) -> DataFrame:
    """By sample and score: sum of dosage times weight, matched rows, match rate, and whether it is low. sizes: pgs_id, total.

    Rows are summed by position first, so that positions are counted by the same shuffle.
    """
    by_place = rows.groupBy("sample", "pgs_id", "chrom", "start").agg(F.sum(F.col("dosage") * F.col("effect_weight")).alias("part"))
    return _rated(by_place.groupBy("sample", "pgs_id").agg(F.sum("part").alias("score"), F.count("*").alias("matched")), sizes)


def _rated(summed: DataFrame, sizes: DataFrame) -> DataFrame:
    rate = F.col("matched") / F.col("total")
    return summed.join(sizes, "pgs_id").select("sample", "pgs_id", F.round("score", 6).alias("score"), "matched", "total", F.round(rate, 6).alias("match_rate"), (rate < 0.1).alias("low_match"))


def restored_scores(rows: DataFrame, scoring: DataFrame, universe: DataFrame) -> DataFrame:
    """As polygenic_scores, where a scoring position without a call counts as the reference's genotype: of a callset of variants only that covers a whole genome.

    rows: the scoring rows with every sample's calls, as score_rows gives them; universe: chrom, start, ref. What all positions of a score add without any call is summed once, and each
    sample's called positions take their share back, so that no table of samples times positions is made.
    """
    known = universe.groupBy("chrom", "start").agg(F.min("ref").alias("u_ref"))
    base = scoring.join(known, ["chrom", "start"], "left").withColumn("base", F.when(F.col("u_ref").isNotNull(), F.when(F.col("u_ref") == F.col("effect_allele"), 2).otherwise(0) * F.col("effect_weight")))
    whole = base.groupBy("pgs_id").agg(F.coalesce(F.sum("base"), F.lit(0.0)).alias("whole"), F.count("base").alias("known"), F.count("*").alias("total"))
    own = base.groupBy("pgs_id", "chrom", "start").agg(F.sum("base").alias("base"))
    by_place = rows.groupBy("sample", "pgs_id", "chrom", "start").agg(F.sum(F.col("dosage") * F.col("effect_weight")).alias("part"))
    called = by_place.join(own, ["pgs_id", "chrom", "start"]).groupBy("sample", "pgs_id").agg(
        F.sum("part").alias("part"), F.coalesce(F.sum("base"), F.lit(0.0)).alias("back"), F.count("*").alias("n"), F.count("base").alias("n_known")
    )
    joined = called.join(whole, "pgs_id").withColumns({"score": F.col("part") - F.col("back") + F.col("whole"), "matched": F.col("n") + F.col("known") - F.col("n_known")})
    return _rated(joined.select("sample", "pgs_id", "score", "matched"), whole.select("pgs_id", "total"))


#: Distributions of more rows are ranked by quantile sketches; k of a sketch, which errs by about 0.4 % of the rows, and the steps of the ranks that are read from it.
EXACT_ROWS, SKETCH_K, STEPS = 100_000, 800, 500


def percentiles(scores: DataFrame, distribution: DataFrame, exact_rows: int = EXACT_ROWS) -> DataFrame:
    """scores (sample, pgs_id, score) with the share of the score's reference distribution at or below it, and whether that is exact.

    Distributions of up to exact_rows are ranked row by row. Larger ones are sketches (KLL) that merge by aggregation, so that no task holds a distribution.
    """
    total = distribution.groupBy("pgs_id").agg(F.count("*").alias("n"))
    small, big = total.filter(F.col("n") <= exact_rows), total.filter(F.col("n") > exact_rows)
    rows = distribution.join(small.select("pgs_id"), "pgs_id", "left_semi")
    marked = rows.select("pgs_id", "score", F.lit(None).cast("long").alias("sample"), F.lit(0).alias("kind")).unionByName(scores.select("pgs_id", "score", F.col("sample").cast("long").alias("sample"), F.lit(1).alias("kind")))
    below = F.sum(F.when(F.col("kind") == 0, 1).otherwise(0)).over(Window.partitionBy("pgs_id").orderBy("score", "kind").rowsBetween(Window.unboundedPreceding, 0))
    exact = marked.join(small, "pgs_id").withColumn("below", below).filter("kind = 1")
    exact = exact.select("sample", "pgs_id", "score", F.round(F.col("below") / F.col("n"), 6).alias("percentile"), F.lit(True).alias("exact"))
    sketches = distribution.join(big.select("pgs_id"), "pgs_id", "left_semi").groupBy("pgs_id").agg(F.kll_sketch_agg_double(F.col("score").cast("double"), F.lit(SKETCH_K)).alias("sketch"))
    steps = sketches.select("pgs_id", F.kll_sketch_get_quantile_double("sketch", F.array(*[F.lit(i / STEPS) for i in range(STEPS + 1)])).alias("steps"))
    rank = F.greatest(F.size(F.filter("steps", lambda q: q <= F.col("score"))) - 1, F.lit(0)) / STEPS
    near = scores.select(F.col("sample").cast("long").alias("sample"), "pgs_id", "score").join(steps, "pgs_id")
    return exact.unionByName(near.select("sample", "pgs_id", "score", F.round(rank, 6).alias("percentile"), F.lit(False).alias("exact")))


def sample_kind(n: Column) -> tuple[Column, Column]:
    """Kind and confidence of a sample by its number of rows."""
    kind = F.when(n >= 1_000_000, "wgs").otherwise("array")
    return kind, F.when(n >= 2_000_000, 0.97).when(n >= 1_000_000, 0.80).when(n >= 300_000, 0.75).otherwise(0.85)
