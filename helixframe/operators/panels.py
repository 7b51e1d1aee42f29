"""Builds of module tables from raw sources: a gene panel from clinical records, and drug annotations with their texts."""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.genotypes import allele_rejection, evidence_rank
from ..functions.literature import has_pathogenic, info_value, trimmed
from .aggregates import collapsed_identities
from .curate import capped, fill_genotypes, without_duplicates
from .joins import first_per_key, members_of_panel, reconciled


class Panel(NamedTuple):
    """variants: identity, rsid, chrom, start, ref, alt, genotype, gene, duplicates; studies: variant, kept, dropped, unsound; counters: name, n."""

    variants: DataFrame
    studies: DataFrame
    counters: DataFrame


def build_panel(records: DataFrame, genes: DataFrame, curated: DataFrame, official: DataFrame, synonyms: DataFrame, citations: DataFrame, least_stars: int, most_citations: int) -> Panel:
    """records: record_id, rsid, chrom, start, ref, alt, info, stars, genes; genes: gene; citations: rsid, pmid.

    The panel's symbols are brought to the official ones. Pathogenic records of enough stars, of its genes, of fit alleles stay; those whose rsID names several places
    are known by their coordinate. Each becomes its het and hom rows; each variant keeps its first citations.
    """
    symbols = reconciled(genes, curated, official, synonyms)
    wanted = records.filter(has_pathogenic(info_value(F.col("info"), "CLNSIG")) & (F.col("stars") >= least_stars))
    members = members_of_panel(wanted, symbols.select(F.col("symbol").alias("gene"))).withColumn("reason", allele_rejection(F.col("ref"), F.col("alt")))
    fit = members.filter("reason IS NULL").drop("reason")
    several = collapsed_identities(fit.filter("rsid IS NOT NULL")).select("rsid", F.lit(True).alias("several"))
    place = F.concat_ws(":", "chrom", "start", "ref", "alt")
    named = fit.join(several, "rsid", "left").withColumn("identity", F.when(F.col("several").isNull() & F.col("rsid").isNotNull(), F.col("rsid")).otherwise(place))
    rows = fill_genotypes(named.select("identity", F.when(F.col("several").isNull(), F.col("rsid")).alias("rsid"), "chrom", "start", "ref", "alt", F.lit("").alias("genotype"), F.col("hit").alias("gene"), "record_id"))
    variants = without_duplicates(rows, ["identity", "genotype"], "record_id").drop("record_id")
    cited = citations.join(variants.select("rsid").filter("rsid IS NOT NULL").distinct(), "rsid", "left_semi")
    studies = capped(cited.select(F.col("rsid").alias("variant"), "pmid").distinct(), most_citations)
    count = lambda name, df, of=F.count("*"): df.agg(of.cast("long").alias("n")).select(F.lit(name).alias("name"), F.coalesce("n", F.lit(0)).alias("n"))
    rejected = members.filter("reason IS NOT NULL").groupBy(F.concat(F.lit("rejected: "), "reason").alias("name")).agg(F.count("*").alias("n"))
    counters = [
        count("symbols changed", symbols, F.count_if("changed")), count("symbols unresolved", symbols, F.count_if("unresolved")), count("records in panel", members),
        count("identities by coordinate", named, F.countDistinct(F.when(F.col("several"), F.col("rsid")))), count("variants", variants, F.countDistinct("identity")), count("rows", variants),
        count("citations dropped", studies, F.sum("dropped")), rejected,
    ]
    return Panel(variants, studies, reduce(DataFrame.unionByName, counters))


def texts_of(rows: DataFrame, texts: DataFrame, key: str) -> DataFrame:
    """rows (key, genotype) with the text of their genotype, and where that has none of the genotype without its separator; of several the first by text."""
    bare = F.regexp_replace("genotype", "[/|]", "")
    slashed = first_per_key(texts.select(key, "genotype", F.col("text").alias("__a")), [key, "genotype"], "__a")
    plain = first_per_key(texts.select(key, F.col("genotype").alias("__bare"), F.col("text").alias("__b")), [key, "__bare"], "__b")
    joined = rows.withColumn("__bare", bare).join(slashed, [key, "genotype"], "left").join(plain, [key, "__bare"], "left")
    return joined.withColumn("text", F.coalesce("__a", "__b")).drop("__a", "__b", "__bare")


def build_drug_annotations(rows: DataFrame, texts: DataFrame, least: str = "2B", limit: int = 600) -> tuple[DataFrame, DataFrame]:
    """The annotations of enough evidence with their trimmed texts, and one row of counts: annotations, drugs, genes and rows with a text.

    rows: annotation_id, genotype, gene, drug, level; texts: annotation_id, genotype, text.
    """
    kept = rows.filter(evidence_rank(F.col("level")) >= evidence_rank(F.lit(least)))
    told = texts_of(kept, texts, "annotation_id").withColumn("text", trimmed(F.col("text"), limit))
    counts = told.agg(F.countDistinct("annotation_id").alias("annotations"), F.countDistinct("drug").alias("drugs"), F.countDistinct("gene").alias("genes"), F.count("text").alias("texts"))
    return told, counts
