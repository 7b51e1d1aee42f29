"""Genotypes, alleles, weights and clinical labels as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Evidence levels, strongest first.
EVIDENCE = ["1A", "1B", "2A", "2B", "3", "4"]


def blank_to_null(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def genotype_from_gt(gt: Column, ref: Column, alt: Column) -> Column:
    """Sorted alleles that the GT's digits name, from ref and then the alternates split at '|'; an index past them gives a null allele."""
    alternates = F.when(F.contains(alt, F.lit("|")), F.split(alt, r"\|")).otherwise(F.array(alt))
    alleles = F.concat(F.array(ref), alternates)
    named = F.transform(F.regexp_extract_all(gt, F.lit("[0-9]+"), 0), lambda i: F.get(alleles, i.cast("int")))
    # most calls are of two one-digit indices, which need no loop over the GT's text
    first, second = (F.get(alleles, F.substring(gt, at, 1).try_cast("int")) for at in (1, 3))
    plain = (F.length(gt) == 3) & F.substring(gt, 2, 1).isin("/", "|") & first.isNotNull() & second.isNotNull()
    return F.when(plain, F.array(F.least(first, second), F.greatest(first, second))).otherwise(F.array_sort(named))


def authored_genotype(genotype: Column) -> Column:
    """An authored genotype as an array in its own order: split at '/' or '|', empty parts dropped."""
    return F.filter(F.split(genotype, "[/|]"), lambda x: F.length(x) > 0)


def genotype_key(genotype: Column, phased: Column) -> Column:
    """The authored text of a genotype array: phased ones joined by '|' as they are, others sorted and joined by '/'."""
    return F.when(F.coalesce(phased, F.lit(False)), F.array_join(genotype, "|")).otherwise(F.array_join(F.array_sort(genotype), "/"))


def zygosity(genotype: Column) -> Column:
    return F.when(F.coalesce(F.size(genotype), F.lit(0)) < 2, "").when(genotype[0] == genotype[1], "hom").otherwise("het")


def alt_alleles(alts: Column) -> Column:
    """Alternates from text split at ',' or '|'; empty ones dropped."""
    return F.filter(F.split(alts, "[,|]"), lambda x: F.length(x) > 0)


def direction(stated: Column, state: Column, weight: Column) -> Column:
    """The stated direction in lower case; if blank, the state, where 'significant' takes its side from the weight."""
    by_weight = F.when(weight > 0, "protective").when(weight < 0, "risk").otherwise("neutral")
    state = F.lower(F.trim(state))
    return F.coalesce(F.lower(blank_to_null(stated)), F.when(state == "significant", by_weight).when(state.isin("protective", "risk"), state), F.lit("neutral"))


def clinical_tier(clin_sig: Column, pathogenic: Column, benign: Column, clinvar: Column) -> Column:
    flags = F.when(pathogenic, "pathogenic").when(benign, "benign").when(clinvar, "uncertain_significance").otherwise("")
    return F.coalesce(F.lower(blank_to_null(clin_sig)), flags)


def tier_label(tier: Column) -> Column:
    """Words apart, the first letter large."""
    words = F.replace(tier, F.lit("_"), F.lit(" "))
    return F.concat(F.upper(F.substring(words, 1, 1)), F.substr(words, F.lit(2)))


def variant_sign(weight: Column, direction_: Column) -> Column:
    by_direction = F.when(direction_ == "protective", 1).when(direction_ == "risk", -1).otherwise(0)
    return F.when(weight.isNotNull() & (weight != 0), F.signum(weight).cast("int")).otherwise(by_direction)


def evidence_rank(level: Column) -> Column:
    """6 for 1A down to 1 for 4; 0 for anything else."""
    at = F.array_position(F.array(*map(F.lit, EVIDENCE)), F.upper(F.trim(level)))
    return F.when(at > 0, len(EVIDENCE) + 1 - at).otherwise(0).cast("int")


def study_key(rsid: Column, chrom: Column, start: Column, ref: Column) -> Column:
    place = F.when(chrom.isNotNull() & start.isNotNull() & ref.isNotNull(), F.concat_ws(":", chrom, start, ref))
    return F.coalesce(blank_to_null(rsid), place)


def slash_genotype(pair: Column) -> Column:
    """Two letters with or without a separator, sorted and joined by '/'; null for anything else."""
    letters = F.upper(F.regexp_replace(F.trim(pair), "[/|]", ""))
    return F.when(letters.rlike("^[ACGT]{2}$"), F.array_join(F.array_sort(F.split(letters, "")), "/"))


def genotype_of(allele: Column, zygosity_: Column, ref: Column, alts: Column) -> Column:
    """The genotype that an allele and a zygosity mean; het pairs it with ref, or ref with the first other alternate."""
    other = F.when(allele == ref, F.element_at(F.filter(alt_alleles(alts), lambda x: x != allele), 1)).otherwise(ref)
    zyg = F.lower(F.trim(zygosity_))
    het = F.when(other.isNotNull(), F.array_join(F.array_sort(F.array(allele, other)), "/"))
    usable = allele.rlike("^[ACGT]+$")
    return F.when(usable & zyg.isin("hom", "homozygous"), F.concat_ws("/", allele, allele)).when(usable & zyg.isin("het", "heterozygous"), het)


def state_of(weight: Column) -> Column:
    return F.when(weight > 0, "protective").when(weight < 0, "risk").otherwise("neutral")


def parse_weight(raw: Column) -> Column:
    """A number; a decimal comma is accepted; null otherwise."""
    text = F.trim(raw)
    return F.coalesce(text.try_cast("double"), F.replace(text, F.lit(","), F.lit(".")).try_cast("double"))


def significance(raw: Column) -> Column:
    text = F.lower(F.trim(raw))
    return F.when(text == "significant", "significant").when(text.isin("non-significant", "not significant", "nonsignificant"), "non-significant")


def is_base(allele: Column) -> Column:
    return allele.rlike("^[ACGT]+$")


def is_indel(ref: Column, alt: Column) -> Column:
    return F.length(ref) != F.length(alt)


def allele_rejection(ref: Column, alt: Column, most: int = 50) -> Column:
    """Why a pair of alleles can't be used; null if it can."""
    return (
        F.when(~is_base(ref) | ~is_base(alt) | ref.isNull() | alt.isNull(), "not_acgt")
        .when(ref == alt, "same_allele")
        .when((F.length(ref) > most) | (F.length(alt) > most), "too_long")
    )
