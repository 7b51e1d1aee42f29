"""Curated and reference tables as sources, results as sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def module_table(spark: SparkSession, url: str, columns: list[str] | None = None) -> DataFrame:
    df = spark.read.parquet(url)
    return df.select(*columns) if columns else df


def reference_view(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A view over all Parquet files of a folder, by column name."""
    df = spark.read.option("mergeSchema", True).parquet(folder)
    df.createOrReplaceTempView(name)
    return df


#: Contigs that are broadcast at most.
MOST_CONTIGS = 100_000


def only_needed(reference: DataFrame, calls: DataFrame, by: str = "chrom") -> DataFrame:
    """The reference's rows on the calls' contigs. reference is partitioned by that column: its other partitions aren't read, as the planner prunes them by the join's other side.

    That needs a broadcast side, a row a contig, which are counted first; beyond MOST_CONTIGS the join is left to the planner. Contigs are text, in the calls and in the partitions' names.
    """
    needed = calls.select(F.col(by).cast("string").alias("__needed")).distinct()
    side = F.broadcast(needed) if needed.limit(MOST_CONTIGS + 1).count() <= MOST_CONTIGS else needed
    return reference.join(side, reference[by].cast("string") == needed["__needed"], "left_semi")


def lower_names(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.lower() for c in df.columns])


def authored_csv(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """All cells as trimmed text, null as ''; blank rows and rows that start with '#' go."""
    df = spark.read.csv(path, header=True, inferSchema=False, multiLine=True, quote='"', escape='"', sep=sep)
    df = df.select(*[F.coalesce(F.trim(c), F.lit("")).alias(c) for c in df.columns])
    return df.filter((F.concat(*df.columns) != "") & ~F.startswith(F.col(df.columns[0]), F.lit("#")))


def symbol_map(genes: DataFrame) -> DataFrame:
    """(synonym, symbol) of a table with symbol, synonyms apart by '|', and line, its order; the first line wins."""
    each = genes.select("symbol", "line", F.explode(F.split("synonyms", r"\|")).alias("synonym")).filter("synonym NOT IN ('', '-')")
    order = F.row_number().over(Window.partitionBy("synonym").orderBy("line", "symbol"))
    return each.withColumn("n", order).filter("n = 1").select("synonym", "symbol")


def pathogenic_lines(spark: SparkSession, path: str) -> DataFrame:
    """Fields of the VCF lines that may hold a pathogenic record, by a cheap test before the split."""
    lines = spark.read.text(path).filter(~F.col("value").startswith("#") & F.col("value").contains("athogenic"))
    return lines.select(F.split("value", "\t").alias("f")).filter(F.size("f") >= 8)


def write_table(df: DataFrame, path: str) -> DataFrame:
    """Parquet with zstd by Spark's commit protocol; the table read back."""
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header; lists are joined by ';'."""
    kinds = dict(df.dtypes)
    df.select(*[F.array_join(c, ";").alias(c) if kinds[c].startswith("array") else F.col(c) for c in df.columns]).write.mode("overwrite").csv(path, header=True, quote='"', escape='"')


def manifest(outcomes: DataFrame, path: str) -> DataFrame:
    """A run's outcomes as JSON, and read back."""
    outcomes.write.mode("overwrite").json(path)
    return outcomes.sparkSession.read.schema(outcomes.schema).json(path)
