"""A big reference prepared once for many joins by position: nested by position, bucketed and sorted, so that joins don't shuffle it.

A row of a prepared table is a position with all its variants, so that the position alone is the key: it is what the buckets are dealt by, whatever else a
join compares. A table is written once, at a path that all executors share, and opened by any later session.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

KEYS = ["chrom", "start"]
#: The nested variants of a position.
ROWS = "variants"
#: Rows of a bucket, about, where no number of buckets is given.
BUCKET_ROWS = 20_000_000


def prepare(reference: DataFrame, path: str, name: str, buckets: int | None = None) -> DataFrame:
    """Writes the reference to path as a table of this name, and opens it."""
    rest = [c for c in reference.columns if c not in KEYS]
    nested = reference.groupBy(*KEYS).agg(F.sort_array(F.collect_list(F.struct(*rest))).alias(ROWS))
    buckets = buckets or max(1, -(-reference.count() // BUCKET_ROWS))
    # one file a bucket: the rows are dealt as the buckets are
    dealt = nested.repartition(buckets, *KEYS)
    dealt.write.bucketBy(buckets, *KEYS).sortBy(*KEYS).format("parquet").option("path", path).option("compression", "zstd").mode("overwrite").saveAsTable(name)
    return reference.sparkSession.table(name)


def open_prepared(spark: SparkSession, path: str, name: str, buckets: int, schema: T.StructType) -> DataFrame:
    """The table written to path by an earlier session, under a name in this one. buckets and schema are those it was written with."""
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    clustered = f"CLUSTERED BY ({', '.join(KEYS)}) SORTED BY ({', '.join(KEYS)}) INTO {int(buckets)} BUCKETS"
    spark.sql(f"CREATE TABLE IF NOT EXISTS `{name}` ({columns}) USING parquet {clustered} LOCATION {json.dumps(path)}")
    return spark.table(name)


def annotate(calls: DataFrame, prepared: DataFrame, on: Sequence[str] = ("ref", "alt"), suffix: str = "ensembl") -> DataFrame:
    """Calls with the columns of the reference's variants at their position that agree in the columns on; null ones without. Only the calls are shuffled."""
    fields = [f.name for f in prepared.schema[ROWS].dataType.elementType.fields if f.name not in on]
    hits = F.filter(ROWS, lambda r: reduce(lambda a, b: a & b, [r[c] == F.col(c) for c in on], F.lit(True)))
    joined = calls.join(prepared, KEYS, "left").select(*calls.columns, F.explode_outer(hits).alias("__hit"))
    return joined.select(*calls.columns, *[F.col("__hit").getField(c).alias(f"{c}_{suffix}" if c in calls.columns else c) for c in fields])


def at_positions(prepared: DataFrame, wanted: DataFrame) -> DataFrame:
    """The reference's variants at the wanted positions, one row each. Only the wanted positions are shuffled."""
    kept = prepared.join(wanted.select(*KEYS).distinct(), KEYS, "left_semi")
    return kept.select(*KEYS, F.inline(ROWS))
