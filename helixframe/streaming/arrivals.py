"""New samples as they arrive: a file stream finds VCF files, each batch is normalised, filtered and annotated with all modules.

The stream's checkpoint is the rule for what was seen. A batch has a folder of its own, by its number, for its rows and one for its outcomes, and overwrites both: a
batch that runs twice leaves one copy. Of several files of one sample in a batch (one.vcf beside one.vcf.gz) the first by name is taken; a sample that comes again in
a later batch replaces what it left before.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.contigs import fold_contig
from ..functions.genotypes import genotype_from_gt
from ..operators.filters import quality_filter
from ..operators.runs import BY, OUTCOME, Context, annotate_run

LINES = "value string"
#: A batch holds several samples, each of which would need a scope of its own for rows to be restored.
MANY_SAMPLES = Context("variant_only", 0, 0.0, "targeted", "a batch of samples", True)


def sample_key(path: Column) -> Column:
    """user/sample, from .../user/sample.vcf or .vcf.gz or .txt."""
    return F.regexp_extract(F.substring_index(path, "/", -2), r"^([^/]+/[^/]+?)(?:\.vcf)?(?:\.gz|\.txt)?$", 1)


def lines_by_file(spark: SparkSession, folder: str, files_per_batch: int = 100) -> DataFrame:
    """(source, value) of the lines of files that weren't seen before; folder holds a folder for each user."""
    lines = spark.readStream.schema(LINES).option("maxFilesPerTrigger", files_per_batch).format("text").load(f"{folder}/*")
    return lines.select(F.col("_metadata.file_path").alias("source"), "value")


def arriving_lines(spark: SparkSession, folder: str, files_per_batch: int = 100) -> DataFrame:
    """(sample, value) of the lines of files that weren't seen before."""
    return lines_by_file(spark, folder, files_per_batch).select(sample_key(F.col("source")).alias("sample"), "value")


def records_of(lines: DataFrame) -> DataFrame:
    """Normalised calls of VCF lines, with their sample."""
    f = F.col("__f")
    gt = F.get(F.split(f[9], ":"), (F.array_position(F.split(f[8], ":"), "GT") - 1).cast("int"))
    fields = lines.filter(~F.col("value").startswith("#") & (F.col("value") != "")).select("sample", F.split("value", "\t").alias("__f"))
    calls = fields.select(
        "sample", fold_contig(f[0]).alias("chrom"), f[1].try_cast("bigint").alias("start"), F.nullif(f[2], F.lit(".")).alias("rsid"),
        f[3].alias("ref"), F.replace(f[4], F.lit(","), F.lit("|")).alias("alt"), f[5].try_cast("double").alias("qual"), f[6].alias("filter"),
        F.regexp_extract(F.concat(F.lit(";"), f[7]), ";DP=([0-9]+)", 1).try_cast("int").alias("dp"), gt.alias("gt"),
    )
    return calls.withColumn("genotype", genotype_from_gt(F.col("gt"), F.col("ref"), F.col("alt")))


def one_file_a_sample(lines: DataFrame) -> DataFrame:
    """The lines of each sample's first file by name, with their sample, which the source names unless a column does.

    A batch has no more samples than files, so the list of them is broadcast, and names are taken apart once a file: a shuffle by sample would bring all of a sample's
    lines to one task, and a stream's plans aren't adaptive.
    """
    own = ["sample"] if "sample" in lines.columns else []
    files = lines.select("source", *own).distinct()
    named = files if own else files.withColumn("sample", sample_key(F.col("source")))
    first = named.groupBy("sample").agg(F.min_by("source", "source").alias("source"))  # min would let the optimizer drop the distinct, and read names from every line
    return lines.join(F.broadcast(first), ["source", *own]).drop("source")


def annotate_arrivals(spark: SparkSession, folder: str, readers: dict[str, Callable[[], DataFrame]], to: str, checkpoint: str, filters: Mapping | None = None) -> StreamingQuery:
    """Starts the stream; it ends when all that is there has been processed. filters: arguments of the quality filter."""
    return (
        lines_by_file(spark, folder).writeStream.foreachBatch(lambda batch, number: store(batch, number, readers, to, filters))
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def store(batch: DataFrame, number: int, readers: dict[str, Callable[[], DataFrame]], to: str, filters: Mapping | None = None) -> None:
    """Writes the rows and outcomes of one batch, in place of what the same batch has left."""
    calls = quality_filter(records_of(one_file_a_sample(batch)), **(filters or {}))
    found = annotate_run(calls, readers, f"{to}/rows/batch={number}", 0, MANY_SAMPLES)
    found.write.mode("overwrite").json(f"{to}/outcomes/batch={number}")


def outcomes(spark: SparkSession, to: str) -> DataFrame:
    """Outcomes of all batches, with the batch's number."""
    return spark.read.schema(f"{OUTCOME}, batch long").json(f"{to}/outcomes")


def arrived(spark: SparkSession, to: str) -> DataFrame:
    """The rows of all samples by module; of a sample that came in several batches those of the last."""
    rows = spark.read.option("mergeSchema", True).parquet(f"{to}/rows")
    last = rows.groupBy("sample").agg(F.max("batch").alias("batch"))
    return rows.join(last, ["sample", "batch"], "left_semi").withColumn(BY, F.col(BY).cast("string"))
