"""VCF text as a table, and tables as VCF text."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.genotypes import genotype_from_gt
from . import block_gzip
from .scratch import scratch

CORE = ["chrom", "start", "end", "rsid", "ref", "alt", "qual", "filter"]
#: INFO names that are left out by default: they repeat other columns.
NOT_READ = ["END"]
_TYPES = {"Integer": "int", "Float": "float", "Flag": "boolean"}
_HEADER = re.compile(r"##(INFO|FORMAT)=<ID=([^,>]+),Number=([^,>]+),Type=([^,>]+)")


def files_of(spark: SparkSession, path: str) -> list[str]:
    """The files at or under the path that hold anything, by name."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    listed, files = root.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(root, True), []
    while listed.hasNext():
        f = listed.next()
        if f.getLen() and not f.getPath().getName().startswith(("_", ".")):
            files.append(f.getPath().toString())
    return sorted(files)


def header_lines(spark: SparkSession, path: str) -> list[str]:
    """The lines from a VCF's start up to its first record: of the first file of the path, by name, that begins with '#'. Nothing after them is read."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    codecs = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(conf)
    for file in map(jvm.org.apache.hadoop.fs.Path, files_of(spark, path)):
        codec = codecs.getCodecByName("gzip") if file.getName().endswith(".bgz") else codecs.getCodec(file)
        raw = file.getFileSystem(conf).open(file)
        stream = codec.createInputStream(raw) if codec else raw
        reader = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(stream, "UTF-8"))
        try:
            lines = []
            while (line := reader.readLine()) is not None and line.startswith("#"):
                lines.append(line)
        finally:
            reader.close()
        if lines:
            return lines
    return []


def header_fields(spark: SparkSession, path: str) -> tuple[dict[str, str], dict[str, str]]:
    """INFO and FORMAT columns with their types, from the header's lines alone; a name in both stays with INFO."""
    info: dict[str, str] = {}
    form: dict[str, str] = {}
    for line in header_lines(spark, path):
        if found := _HEADER.match(line):
            section, name, number, kind = found.groups()
            kind = _TYPES.get(kind, "string")
            single = number in ("0", "1") or kind == "string"
            (info if section == "INFO" else form)[name] = kind if single else f"array<{kind}>"
    return {k: v for k, v in info.items() if k not in NOT_READ}, {k: v for k, v in form.items() if k not in info}


def _typed(text: Column, kind: str) -> Column:
    known = F.nullif(text, F.lit("."))
    if kind.startswith("array<"):
        return F.transform(F.split(known, ","), lambda x: x.try_cast(kind[6:-1]))
    return known if kind == "string" else known.try_cast(kind)


def text_lines(spark: SparkSession, path: str, keep: Sequence[str] = ()) -> DataFrame:
    """(value, keep) of all lines at the path; files of block-gzip are read by as many tasks as their size asks for."""
    if any(c in path for c in "*?[{"):  # a pattern is left to Spark's reader
        return spark.read.text(path).select("value", *keep)
    files = files_of(spark, path)
    found = set(block_gzip.blocked(spark, files))
    if not found:
        return spark.read.text(path).select("value", *keep)
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    base = path if root.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(root).isDirectory() else None
    lines = block_gzip.read_lines(spark, sorted(found), base, keep)
    if rest := [f for f in files if f not in found]:
        lines = lines.unionByName(spark.read.option("basePath", path).text(rest).select("value", *keep))
    return lines


def read_vcf(spark: SparkSession, path: str, info: dict[str, str] | None = None, formats: dict[str, str] | None = None, genotype: bool = True, tasks: int | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """One row for each record of VCF text (plain, .gz or .bgz), or a Parquet copy as it is.

    FILTER '.' becomes '', an ID '.' null, several alternates are apart by '|'. formats: FORMAT columns of the first sample, {} for none. A block-gzip file is split among tasks, another .gz file
    is one task; tasks deals its rows out after the read. keep: columns of the folder's own partitions that stay.
    """
    if path.rstrip("/").endswith(".parquet"):
        return spark.read.parquet(path)
    if info is None or formats is None:
        found = header_fields(spark, path)
        info, formats = found[0] if info is None else info, found[1] if formats is None else formats
    lines = text_lines(spark, path, keep).filter(~F.col("value").startswith("#") & (F.col("value") != ""))
    f = F.split("value", "\t")
    if tasks:
        lines = lines.repartition(tasks)
    keys, values = F.split(f[8], ":"), F.split(f[9], ":")
    at = lambda name: F.get(values, (F.array_position(keys, name) - 1).cast("int"))
    in_info = lambda name: F.nullif(F.regexp_extract(F.concat(F.lit(";"), f[7], F.lit(";")), f";{name}=([^;]*);", 1), F.lit(""))
    flag = lambda name: F.concat(F.lit(";"), f[7], F.lit(";")).contains(f";{name};")
    columns = [
        f[0].alias("chrom"), f[1].try_cast("bigint").alias("start"), (f[1].try_cast("bigint") + F.length(f[3])).alias("end"), F.nullif(f[2], F.lit(".")).alias("rsid"),
        f[3].alias("ref"), F.replace(f[4], F.lit(","), F.lit("|")).alias("alt"), f[5].try_cast("double").alias("qual"), F.when(f[6] == ".", "").otherwise(f[6]).alias("filter"),
        *[(flag(n) if k == "boolean" else _typed(in_info(n), k)).alias(n) for n, k in info.items()],
        *[_typed(at(n), k).alias(n) for n, k in formats.items()], *keep,
    ]
    df = lines.select(*columns)
    if genotype and "GT" in formats:
        df = df.withColumn("genotype", genotype_from_gt(F.col("GT"), F.col("ref"), F.col("alt")))
    return df


def vcf_to_parquet(spark: SparkSession, path: str, to: str, overwrite: bool = False, **options) -> DataFrame:
    """The table at to, made from the VCF where it isn't there yet or is to be overwritten."""
    try:
        if not overwrite:
            return spark.read.parquet(to)
    except Exception as e:  # only a path that isn't there means that it's to be made
        if "PATH_NOT_FOUND" not in str(e):
            raise
    read_vcf(spark, path, **options).write.mode("overwrite").option("compression", "zstd").parquet(to)
    return spark.read.parquet(to)


def annotation_columns(df: DataFrame, explicit: Sequence[str] | None = None, formats: Sequence[str] = ("GT", "GQ", "DP", "AD", "VAF", "PL", "genotype")) -> list[str]:
    """Columns that go to INFO: those named, else all but the core, the FORMAT columns and rsid."""
    return [c for c in explicit if c in df.columns] if explicit else [c for c in df.columns if c not in CORE and c not in formats]


def info_type(kind: T.DataType) -> str:
    if isinstance(kind, T.IntegralType):
        return "Integer"
    return "Float" if isinstance(kind, T.FractionalType) else "Flag" if isinstance(kind, T.BooleanType) else "String"


def vcf_lines(df: DataFrame, columns: Sequence[str] | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """(chrom, start, line) of each row, and its columns keep; empty fields are filled as VCF wants them."""
    fields = annotation_columns(df, columns)
    kinds = dict(zip(df.columns, (f.dataType for f in df.schema.fields), strict=True))
    text = lambda c: F.array_join(c, ",") if isinstance(kinds[c], T.ArrayType) else F.regexp_replace(F.col(c).cast("string"), r"[;\s=]", "_")
    entries = [F.when(F.col(c), c) if isinstance(kinds[c], T.BooleanType) else F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{c}="), text(c))) for c in fields]
    or_dot = lambda c: F.coalesce(F.nullif(F.col(c).cast("string"), F.lit("")), F.lit(".")) if c in df.columns else F.lit(".")
    info = F.concat_ws(";", *entries) if entries else F.lit("")
    line = F.concat_ws("\t", or_dot("chrom"), or_dot("start"), or_dot("rsid"), or_dot("ref"), F.replace(or_dot("alt"), F.lit("|"), F.lit(",")), or_dot("qual"), or_dot("filter"), F.coalesce(F.nullif(info, F.lit("")), F.lit(".")))
    return df.select(*keep, "chrom", "start", line.alias("line"))


def _head(df: DataFrame, columns: Sequence[str] | None) -> list[str]:
    kinds = {f.name: info_type(f.dataType) for f in df.schema.fields}
    return ["##fileformat=VCFv4.2", *(f'##INFO=<ID={c},Number={0 if kinds[c] == "Flag" else "." if kinds[c] == "String" else 1},Type={kinds[c]},Description="{c}">' for c in annotation_columns(df, columns)), "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO"]


def write_vcf(df: DataFrame, path: str, columns: Sequence[str] | None = None, compress: bool = False) -> None:
    """VCF text in order of chrom and start, range-partitioned; the header stands in the first part. df is computed once, before the sort samples it. compress: as block-gzip files."""
    spark = df.sparkSession
    header = spark.createDataFrame([(0, None, i, line) for i, line in enumerate(_head(df, columns))], "body int, chrom string, start long, line string")
    done = scratch(spark, "lines")
    vcf_lines(df, columns).select(F.lit(1).alias("body"), "chrom", F.col("start").cast("long").alias("start"), "line").write.option("compression", "zstd").parquet(done)
    rows = header.unionByName(spark.read.schema(header.schema).parquet(done))
    order = ["body", "chrom", "start"]  # the header before all records, those without a contig among them
    lines = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("line")
    if compress:
        block_gzip.write_lines(lines, path, ".vcf.gz")
    else:
        lines.write.mode("overwrite").text(path)


def write_sample_vcfs(df: DataFrame, path: str, sample: str = "sample", columns: Sequence[str] | None = None) -> None:
    """VCF text of each sample in a folder of its own, sample=..., with its header; a sample's records are dealt to files by contig."""
    spark = df.sparkSession
    fields = [c for c in annotation_columns(df, columns) if c != sample]
    head = spark.createDataFrame([(i, line) for i, line in enumerate(_head(df, fields))], "start long, line string").withColumns({"body": F.lit(0), "chrom": F.lit("")})
    lines = df.select(F.col(sample), *[F.col(c) for c in df.columns if c != sample])
    body = vcf_lines(lines, fields, keep=[sample]).withColumns({"start": F.col("start").cast("long"), "body": F.lit(1)})
    headers = df.select(sample).distinct().join(F.broadcast(head))  # a header's lines for each sample
    rows = body.unionByName(headers.select(*body.columns))
    rows.repartition(sample, "body", "chrom").sortWithinPartitions(sample, "body", "chrom", "start").select(sample, "line").write.mode("overwrite").partitionBy(sample).text(path)
