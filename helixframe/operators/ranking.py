"""Order numbers and pages of whole tables without a window over them.

A table is sorted once by ranges and written; a row's place is the number of rows in the files before its own and its place in its file. An index of
the files, a row each, is all that has to be summed, and all that has to be looked at to find the files of a page.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The columns of an index: a file, its rows and the rows before it.
INDEX = "file string, n long, first long"


class SortedView:
    """A table sorted by order, written to path once, with the index of its files beside it."""

    #: Files whose index is broadcast.
    MOST_FILES = 100_000

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType) -> None:
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema

    @classmethod
    def write(cls, df: DataFrame, path: str, *order: Column | str, files: int | None = None) -> SortedView:
        """Sorts and writes df. Equal rows by order stand in any order, so order ends with what tells rows apart."""
        ranges = df.repartitionByRange(*([files] if files else []), *order).sortWithinPartitions(*order)
        view = cls(df.sparkSession, path, df.schema)
        ranges.write.mode("overwrite").option("compression", "zstd").parquet(f"{view.path}/rows")
        sizes = view.rows().groupBy(F.col("__file").alias("file")).agg(F.count("*").alias("n"))
        number = F.regexp_extract("file", "part-([0-9]+)", 1).cast("long")
        before = F.sum("n").over(Window.orderBy(number, "file").rowsBetween(Window.unboundedPreceding, -1))  # a row for each file, numbered in order
        sizes.withColumn("first", F.coalesce(before, F.lit(0))).coalesce(1).write.mode("overwrite").parquet(f"{view.path}/index")
        return view

    def rows(self, *files: str) -> DataFrame:
        """Rows with their file and their place in it; of these files only, where some are named."""
        at = [f"{self.path}/rows/{f}" for f in files] or [f"{self.path}/rows"]
        read = self.spark.read.schema(self.schema).parquet(*at)
        return read.select(*self.schema.names, F.element_at(F.split("_metadata.file_path", "/"), -1).alias("__file"), F.col("_metadata.row_index").alias("__row"))

    def index(self) -> DataFrame:
        return self.spark.read.schema(INDEX).parquet(f"{self.path}/index")

    def total(self) -> int:
        return self.index().agg(F.sum("n")).first()[0] or 0

    def page_files(self, offset: int, limit: int) -> list[tuple[str, int]]:
        """(file, rows before it) of the files that hold the rows from offset on: as many as the page touches."""
        touched = self.index().filter((F.col("first") < offset + limit) & (F.col("first") + F.col("n") > offset))
        return [(r["file"], r["first"]) for r in touched.select("file", "first").collect()]

    def page(self, offset: int, limit: int, place: str | None = None) -> DataFrame:
        """The rows from offset on, at most limit; with place their numbers from 0 as a column of this name. Only the page's files are opened."""
        found = self.page_files(offset, limit)
        if not found:
            return self.spark.createDataFrame([], T.StructType([*self.schema.fields, *([T.StructField(place, T.LongType())] if place else [])]))
        firsts = F.create_map(*[F.lit(x) for pair in found for x in pair])
        number = (firsts[F.col("__file")] + F.col("__row")).cast("long")
        rows = self.rows(*[f for f, _ in found]).withColumn("__at", number).filter((F.col("__at") >= offset) & (F.col("__at") < offset + limit))
        return rows.orderBy("__at").select(*self.schema.names, *([F.col("__at").alias(place)] if place else []))

    def ranked(self, place: str = "place", by: Sequence[str] = ()) -> DataFrame:
        """All rows with their place from 1; with by, columns that order begins with, their place among the rows of equal ones."""
        firsts = self.index().select(F.col("file").alias("__file"), "first")
        few = self.index().count() <= self.MOST_FILES
        numbered = self.rows().join(F.broadcast(firsts) if few else firsts, "__file").withColumn("__at", F.col("first") + F.col("__row"))
        if not by:
            return numbered.select(*self.schema.names, (F.col("__at") + 1).alias(place))
        starts = numbered.groupBy(*by).agg(F.min("__at").alias("__start"))
        same = [F.col(f"r.{c}").eqNullSafe(F.col(f"s.{c}")) for c in by]
        joined = numbered.alias("r").join(starts.alias("s"), same)
        return joined.select(*[F.col(f"r.{c}").alias(c) for c in self.schema.names], (F.col("r.__at") - F.col("s.__start") + 1).alias(place))
