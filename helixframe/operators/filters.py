"""Row filters."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.contigs import is_primary
from .joins import absent_sites, ambiguous_loci, nearest_within


def first_present(df: DataFrame, *names: str) -> str | None:
    """The first of these columns that df has, in whatever case."""
    have = {c.lower(): c for c in df.columns}
    return next((have[n.lower()] for n in names if n.lower() in have), None)


def _number(df: DataFrame, name: str, kind: str) -> Column:
    """A column as a number. One that is a number is left as it is, so that the condition reaches the scan."""
    return F.col(name) if isinstance(df.schema[name].dataType, T.NumericType) else F.col(name).cast("string").try_cast(kind)


def quality_condition(df: DataFrame, passing: Sequence[str] = (), depth: float = 0, quality: float = 0) -> Column | None:
    """FILTER in the list ('.' and '' are one value), depth and quality at least so much; only for columns that exist and limits that are set."""
    conditions = []
    if passing and (c := first_present(df, "filter")):
        allowed = [*passing, *({".", ""} if {".", ""} & set(passing) else ())]
        conditions.append(F.col(c).isin(allowed))
    if depth and (c := first_present(df, "dp")):
        conditions.append(_number(df, c, "bigint") >= depth)
    if quality and (c := first_present(df, "qual")):
        conditions.append(_number(df, c, "double") >= quality)
    return reduce(lambda a, b: a & b, conditions) if conditions else None


def quality_filter(df: DataFrame, passing: Sequence[str] = (), depth: float = 0, quality: float = 0) -> DataFrame:
    condition = quality_condition(df, passing, depth, quality)
    return df if condition is None else df.filter(condition)


class Accounted(NamedTuple):
    """kept: the rows that pass, as they were written; account: rows before, after and removed."""

    kept: DataFrame
    account: DataFrame


def accounted(df: DataFrame, path: str, by: str, passing: Sequence[str] = (), depth: float = 0, quality: float = 0) -> Accounted:
    """Writes df with the filter's verdict to path, in folders by verdict, so that one pass both filters and accounts: what passes is read from its own folder."""
    condition = quality_condition(df, passing, depth, quality)
    passes = F.lit(True) if condition is None else F.coalesce(condition, F.lit(False))
    df.withColumn("passes", passes).write.mode("overwrite").option("compression", "zstd").partitionBy("passes").parquet(path)
    done = df.sparkSession.read.schema(T.StructType([*df.schema.fields, T.StructField("passes", T.BooleanType())])).parquet(path)
    account = done.groupBy(by).agg(F.count("*").alias("before"), F.count_if("passes").alias("after"), F.count_if(~F.col("passes")).alias("removed"))
    return Accounted(done.filter("passes").drop("passes"), account)


def only_rs(df: DataFrame) -> DataFrame:
    return df.filter(F.col("rsid").startswith("rs"))


def matched_rows(df: DataFrame) -> DataFrame:
    """Annotated rows: the first of these columns that exists is not null."""
    return df.filter(F.col(first_present(df, "module", "conclusion", "state", "weight")).isNotNull())


def hom_ref_rows(lead: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Lead rows at one unambiguous place whose genotype is the reference allele throughout. by: columns that tell leads apart."""
    once = F.coalesce(F.col("locus_count"), F.lit(1)) <= 1 if "locus_count" in lead.columns else F.lit(True)
    placed = lead.filter("chrom IS NOT NULL AND start IS NOT NULL AND ref IS NOT NULL").filter(once)
    whole = placed.filter((F.size("genotype") > 0) & F.forall("genotype", lambda g: g == F.col("ref")))
    return whole.join(ambiguous_loci(lead, by), ["chrom", "start", *by], "left_anti")


def restored(lead: DataFrame, called: DataFrame, most: int) -> DataFrame:
    """Hom-ref rows at places without a call whose nearest call on the contig is at most most away, with the distance."""
    return nearest_within(absent_sites(hom_ref_rows(lead), called), called, most).withColumnRenamed("distance", "restored_flank_bp")


def primary_only(df: DataFrame, chrom: str = "chrom") -> DataFrame:
    return df.filter(is_primary(F.col(chrom)))


#: What an item of a grid filter may ask for.
OPERATORS = {
    "contains": lambda c, v: F.lower(c.cast("string")).contains(str(v).lower()),
    "equals": lambda c, v: F.lower(c.cast("string")) == str(v).lower(),
    "startsWith": lambda c, v: F.startswith(F.lower(c.cast("string")), F.lit(str(v).lower())),
    "endsWith": lambda c, v: F.endswith(F.lower(c.cast("string")), F.lit(str(v).lower())),
    "isEmpty": lambda c, v: c.isNull() | (c.cast("string") == ""),
    "isNotEmpty": lambda c, v: c.isNotNull() & (c.cast("string") != ""),
    "isAnyOf": lambda c, v: F.lower(c.cast("string")).isin([str(x).lower() for x in v]),
    "=": lambda c, v: c == v, "!=": lambda c, v: c != v, ">": lambda c, v: c > v, ">=": lambda c, v: c >= v, "<": lambda c, v: c < v, "<=": lambda c, v: c <= v,
}


def grid_filter(df: DataFrame, items: Sequence[dict], every: bool = True) -> DataFrame:
    """Rows that fit the items (field, operator, value), all of them or any; strings compare without case."""
    conditions = [OPERATORS[i["operator"]](F.col(i["field"]), i.get("value")) for i in items]
    return df.filter(reduce((lambda a, b: a & b) if every else (lambda a, b: a | b), conditions)) if conditions else df
