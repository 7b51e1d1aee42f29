"""Joins of variant tables: annotation by position or identifier, nearest site, lookups and resolution.

Curated tables are small, yet no side is broadcast by hint: their size is not known here, and the adaptive planner
broadcasts what is below its threshold and splits hot keys of sort-merge joins.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.genotypes import genotype_key


def suffix_join(left: DataFrame, right: DataFrame, on: Sequence[str], suffix: str, how: str = "left") -> DataFrame:
    """An equality join that keeps left's columns and gives right's columns of equal name a suffix."""
    renamed = right.select(*[F.col(c).alias(c if c in on else f"{c}_{suffix}" if c in left.columns else c) for c in right.columns])
    return left.join(renamed, list(on), how).select(*left.columns, *[c for c in renamed.columns if c not in on])


def first_per_key(df: DataFrame, keys: Sequence[str], *order: Column | str) -> DataFrame:
    """One row for each key: the first by order."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__rank", rank).filter("__rank = 1").drop("__rank")


def at_positions(calls: DataFrame, lead: DataFrame) -> DataFrame:
    """Calls at a position that the lead table has."""
    return calls.join(lead.select("chrom", "start").distinct(), ["chrom", "start"], "left_semi")


def annotate_by_position(calls: DataFrame, lead: DataFrame, module: str) -> DataFrame:
    """Calls at the lead's positions with its columns where the genotype is equal; rows that contradict the lead's ref go.

    Calls at a probed position without a match stay, with null module columns. Both sides have chrom, start and genotype
    (an array, sorted in calls and as authored in lead). A lead without ref contradicts nothing.
    """
    joined = matched_at_positions(calls, lead, module)
    if "ref" in lead.columns:
        stated = F.col(f"ref_{module}")
        joined = joined.filter(stated.isNull() | (stated == F.col("ref")))
    return joined.withColumn("genotype_evidence", F.lit("called"))


def matched_at_positions(calls: DataFrame, lead: DataFrame, suffix: str, by: Sequence[str] = ()) -> DataFrame:
    """Calls at the lead's positions with its columns where the genotype is equal, null ones where none is; with columns by, so for each of their values.

    The lead's few rows at a position are nested first, so that one join, and one shuffle of the calls, finds both the positions and
    the genotypes.
    """
    rest = [c for c in lead.columns if c not in ("chrom", "start", "genotype", *by)]
    nested = lead.groupBy("chrom", "start", *by).agg(F.collect_list(F.struct("genotype", *rest)).alias("__rows"))
    hits = F.filter("__rows", lambda r: r["genotype"] == F.col("genotype"))
    joined = calls.join(nested, ["chrom", "start"]).select(*calls.columns, *by, F.explode_outer(hits).alias("__hit"))
    return joined.select(*calls.columns, *by, *[F.col("__hit").getField(c).alias(f"{c}_{suffix}" if c in calls.columns else c) for c in rest])


def contradicted(calls: DataFrame, lead: DataFrame) -> DataFrame:
    """How many joined rows the ref check discards, in one row."""
    joined = suffix_join(at_positions(calls, lead), lead, ["chrom", "start", "genotype"], "m")
    return joined.agg(F.count_if(F.col("ref_m").isNotNull() & (F.col("ref_m") != F.col("ref"))).alias("discarded"))


class NoIdentifiers(ValueError):
    """A callset without rsIDs can't be joined by them."""


def annotate_by_rsid(calls: DataFrame, lead: DataFrame, module: str) -> DataFrame:
    """Calls one of whose identifiers (apart by ';') the lead has, with its columns where the genotype is equal too.

    Raises NoIdentifiers where no call has an rsID, which a read up to the first that has one tells.
    """
    if calls.filter(F.col("rsid").startswith("rs")).isEmpty():
        raise NoIdentifiers("no call has an rsID")
    keyed = calls.withColumn("__rs", F.explode_outer(F.split("rsid", ";")))
    wanted = lead.select(F.col("rsid").alias("__rs")).distinct()
    side = lead.withColumnRenamed("rsid", "__rs")
    joined = suffix_join(keyed.join(wanted, "__rs", "left_semi"), side, ["__rs", "genotype"], module)
    return joined.drop("__rs").withColumn("genotype_evidence", F.lit("called"))


def join_strategy(lead: DataFrame) -> DataFrame:
    """One row: strategy (position, rsid or unsupported) and the columns that are missing for a join by position."""
    missing = [c for c in ("chrom", "start", "genotype") if c not in lead.columns]
    placed = F.coalesce(F.bool_or(F.col("chrom").isNotNull() & F.col("start").isNotNull()), F.lit(False)) if not missing else F.lit(False)
    able = F.lit("rsid" in lead.columns and "genotype" in lead.columns)
    return lead.agg(F.max(F.lit(1)).alias("__any"), placed.alias("__placed")).select(
        F.when(F.col("__placed"), "position").when(able, "rsid").otherwise("unsupported").alias("strategy"), F.lit(",".join(missing)).alias("missing")
    )


def annotate_by_reference(calls: DataFrame, reference: DataFrame, on: Sequence[str] = ("chrom", "start", "ref", "alt")) -> DataFrame:
    """Calls with a big reference's columns; without a matching partition these are null."""
    return suffix_join(calls, reference, on, "ensembl")


def absent_sites(candidates: DataFrame, called: DataFrame) -> DataFrame:
    return candidates.join(called.select("chrom", "start"), ["chrom", "start"], "left_anti")


def ambiguous_loci(lead: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Positions spelled with more than one ref, of each lead that the columns by tell apart."""
    keys = ["chrom", "start", *by]
    return lead.filter("chrom IS NOT NULL AND start IS NOT NULL").groupBy(*keys).agg(F.countDistinct("ref").alias("refs")).filter("refs > 1").select(*keys)


def nearest_within(candidates: DataFrame, sites: DataFrame, most: int) -> DataFrame:
    """Candidates with the distance to the nearest site of their contig, where that is at most most.

    Both are binned by most; a candidate meets its own bin and both neighbours, so the join is by equality and its size
    that of sites near candidates. Of a bin only the sites' extremes can be nearest to another bin, so for neighbouring
    bins these two are enough; inside the own bin the nearest come from two running windows.
    """
    bin_of = F.floor(F.col("start") / most)
    own = sites.select("chrom", "start", bin_of.alias("bin"), F.lit(0).alias("kind")).distinct()
    ends = own.groupBy("chrom", "bin").agg(F.min("start").alias("low"), F.max("start").alias("high"))
    asked = candidates.select("chrom", "start").distinct().withColumns({"bin": bin_of, "kind": F.lit(1)})
    order = Window.partitionBy("chrom", "bin").orderBy("start", "kind")
    site = F.when(F.col("kind") == 0, F.col("start"))
    before = F.last(site, True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first(site, True).over(order.rowsBetween(0, Window.unboundedFollowing))
    inside = own.unionByName(asked).withColumns({"before": before, "after": after}).filter("kind = 1")
    near = inside.join(ends.select("chrom", (F.col("bin") + 1).alias("bin"), F.col("high").alias("left")), ["chrom", "bin"], "left")
    near = near.join(ends.select("chrom", (F.col("bin") - 1).alias("bin"), F.col("low").alias("right")), ["chrom", "bin"], "left")
    gaps = [F.abs(F.col("start") - F.col(c)) for c in ("before", "after", "left", "right")]
    found = near.select("chrom", "start", F.least(*gaps).alias("distance")).filter(F.col("distance") <= most)
    return candidates.join(found, ["chrom", "start"])


def enrich(weights: DataFrame, annotations: DataFrame, on: Sequence[str], dedup: bool) -> DataFrame:
    """gene, category and phenotype of annotations; with dedup at most one annotation a key, so that no row multiplies."""
    wanted = [c for c in ("gene", "category", "phenotype") if c in annotations.columns]
    right = annotations.select(*on, *wanted)
    if dedup:
        right = first_per_key(right, on, *[F.col(c).asc_nulls_last() for c in wanted])
    return suffix_join(weights, right, on, "annotation")


def annotations_keying(weights: DataFrame, annotations: DataFrame) -> str:
    """How annotations are told apart: by genotype where both sides have variant_key and a genotype, weights' one as an array; else by variant_key; else by rsid."""
    w, a = dict(weights.dtypes), set(annotations.columns)
    if "variant_key" in w and "variant_key" in a:
        return "genotype" if "genotype" in a and w.get("genotype") == "array<string>" else "variant_key"
    return "rsid"


def with_annotations(weights: DataFrame, annotations: DataFrame) -> DataFrame:
    """weights with gene, category and phenotype of annotations, keyed as annotations_keying says. By genotype, every annotation counts; the other keyings take one a key, so that no row multiplies."""
    keying = annotations_keying(weights, annotations)
    if keying != "genotype":
        return enrich(weights, annotations, [keying], dedup=True)
    phased = F.col("phased") if "phased" in weights.columns else F.lit(False)
    keyed = weights.withColumn("__authored", genotype_key(F.col("genotype"), phased))
    return enrich(keyed, annotations.withColumnRenamed("genotype", "__authored"), ["variant_key", "__authored"], dedup=False).drop("__authored")


def wide_export(base: DataFrame, modules: dict[str, DataFrame], on: Sequence[str]) -> DataFrame:
    """base with every module's columns under the module's name, one row a key of each module."""
    for name, module in modules.items():
        rest = [c for c in module.columns if c not in on]
        single = first_per_key(module, on, *[F.col(c).asc_nulls_last() for c in rest])
        base = base.join(single.select(*on, *[F.col(c).alias(f"{name}_{c}") for c in rest]), list(on), "left")
    return base


def studies_of(wanted: DataFrame, studies: DataFrame) -> DataFrame:
    """(study_key, n_studies, pmids) of the wanted keys; both sides have study_key."""
    used = studies.join(wanted.select("study_key").distinct(), "study_key", "left_semi")
    return used.groupBy("study_key").agg(F.count("*").alias("n_studies"), F.array_join(F.array_sort(F.collect_set("pmid")), ",").alias("pmids"))


def resolve(variants: DataFrame, reference: DataFrame) -> DataFrame:
    """Rows with rsid or place filled from the reference (chrom, start, id, ref), and resolved; given values win.

    The reference is reduced to what the variants name before it is joined back.
    """
    by_id = reference.join(variants.select(F.col("rsid").alias("id")).filter("id IS NOT NULL").distinct(), "id", "left_semi")
    by_id = first_per_key(by_id, ["id"], "chrom", "start", "ref").select(F.col("id").alias("rsid"), F.col("chrom").alias("__c"), F.col("start").alias("__s"))
    by_place = reference.join(variants.filter("rsid IS NULL").select("chrom", "start").distinct(), ["chrom", "start"], "left_semi")
    by_place = first_per_key(by_place, ["chrom", "start"], "id").select("chrom", "start", F.col("id").alias("__id"))
    named = variants.filter("rsid IS NOT NULL").join(by_id, "rsid", "left").withColumns({"chrom": F.coalesce("chrom", "__c"), "start": F.coalesce("start", "__s")}).drop("__c", "__s")
    placed = variants.filter("rsid IS NULL").join(by_place, ["chrom", "start"], "left").withColumn("rsid", F.col("__id")).drop("__id")
    return named.unionByName(placed).withColumn("resolved", F.col("chrom").isNotNull() & F.col("start").isNotNull() & F.col("rsid").isNotNull())


def fan_out(authored: DataFrame, resolution: DataFrame) -> DataFrame:
    """Each authored row once for each locus of its key, with locus_index from 0 and locus_count (1 without a locus)."""
    over = Window.partitionBy("row_id")
    joined = authored.join(resolution, "variant_key", "left")
    return joined.withColumns({"locus_index": F.row_number().over(over.orderBy("chrom", "start", "ref")).cast("long") - 1, "locus_count": F.count("*").over(over)})


def members_of_panel(records: DataFrame, panel: DataFrame) -> DataFrame:
    """Records with hit, their first gene (by place in genes) that the panel has, in capitals on both sides."""
    each = records.select("record_id", F.posexplode("genes").alias("pos", "gene"))
    hits = each.withColumn("gene", F.upper("gene")).join(panel.select(F.upper("gene").alias("gene")).distinct(), "gene", "left_semi")
    return records.join(hits.groupBy("record_id").agg(F.min_by("gene", "pos").alias("hit")), "record_id")


def reconciled(genes: DataFrame, curated: DataFrame, official: DataFrame, synonyms: DataFrame) -> DataFrame:
    """(gene, symbol, changed): a curated fix, else the official symbol, else a mitochondrial one as it is, else a synonym's symbol; unresolved ones stay."""
    joined = (
        genes.join(curated.select("gene", F.col("symbol").alias("fix")), "gene", "left")
        .join(official.select(F.col("symbol").alias("gene"), F.lit(True).alias("known")).distinct(), "gene", "left")
        .join(first_per_key(synonyms, ["synonym"], "symbol").select(F.col("synonym").alias("gene"), F.col("symbol").alias("other")), "gene", "left")
    )
    symbol = F.coalesce("fix", F.when(F.col("known"), F.col("gene")), F.when(F.col("gene").startswith("MT-"), F.col("gene")), "other")
    return joined.select("gene", F.coalesce(symbol, "gene").alias("symbol"), (F.coalesce(symbol, "gene") != F.col("gene")).alias("changed"), symbol.isNull().alias("unresolved"))


def score_rows(calls: DataFrame, scoring: DataFrame, contigs: Sequence[str] = ("chrom", "start")) -> DataFrame:
    """Scoring rows of all scores with every sample's calls at their place, and the dosage of the effect allele."""
    joined = scoring.join(calls, list(contigs))
    return joined.withColumn("dosage", F.size(F.filter("genotype", lambda a: a == F.col("effect_allele"))))
