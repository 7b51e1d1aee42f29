"""Contig names as columns: stripping, prefixing, folding, and the style of a whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PRIMARY = r"^(?:\d+|X|Y|MT)$"


def strip_chr(chrom: Column) -> Column:
    """Without a leading 'chr' in this spelling."""
    return F.regexp_replace(chrom, "^chr", "")


def strip_any_chr(chrom: Column) -> Column:
    """Trimmed, without 'chr' in any case; null when nothing but blanks is there."""
    bare = F.trim(chrom)
    return F.when(bare != "", F.regexp_replace(bare, "(?i)^chr", ""))


def with_chr(chrom: Column) -> Column:
    """Prefixed with 'chr', whatever prefix it had."""
    return F.concat(F.lit("chr"), strip_any_chr(chrom))


def candidate_spellings(df: DataFrame, chrom: str = "chrom") -> DataFrame:
    """Three spellings to try against tables of unknown style."""
    return df.withColumns({"chrom_as_is": F.col(chrom), "chrom_bare": strip_any_chr(F.col(chrom)), "chrom_prefixed": with_chr(F.col(chrom))})


def fold_contig(chrom: Column) -> Column:
    """chr1 and 1 become 1, chrM, M, chrMT and MT become MT; scaffolds and other contigs stay as they are."""
    bare = strip_chr(chrom)
    return F.when(bare.isin("M", "MT"), "MT").when(bare.rlike(r"^(?:[1-9]|1\d|2[0-2]|X|Y)$"), bare).otherwise(chrom)


def is_primary(chrom: Column) -> Column:
    return chrom.rlike(PRIMARY)


def naming_style(df: DataFrame, chrom: str = "chrom") -> DataFrame:
    """One row: prefixed (any name starts with chr), how many names there are, and their sorted list."""
    return df.agg(
        F.coalesce(F.bool_or(F.startswith(F.lower(chrom), F.lit("chr"))), F.lit(False)).alias("prefixed"),
        F.array_join(F.array_sort(F.collect_set(chrom)), ",").alias("names"),
        F.countDistinct(chrom).alias("n_names"),
    )


def harmonise(df: DataFrame, reference: DataFrame, chrom: str = "chrom") -> DataFrame:
    """df with its contigs spelled as in reference, and the action taken. The reference's style is one row, so it is broadcast."""
    want = naming_style(reference, chrom).select(F.col("prefixed").alias("__want"))
    have = naming_style(df, chrom).select(F.col("prefixed").alias("__have"))
    joined = df.join(F.broadcast(want.crossJoin(have)))
    action = F.when(F.col("__want") == F.col("__have"), "none").when(F.col("__want"), "prefixed").otherwise("stripped")
    spelled = F.when(action == "none", F.col(chrom)).when(action == "prefixed", with_chr(F.col(chrom))).otherwise(strip_any_chr(F.col(chrom)))
    return joined.withColumns({chrom: spelled, "chrom_action": action}).drop("__want", "__have")
