"""VCF text in and out, and the file stream."""

import os

from helixframe.functions.contigs import harmonise
from helixframe.sources import vcf
from helixframe.streaming import arrivals

TEXT = """##fileformat=VCFv4.2
##INFO=<ID=DP,Number=1,Type=Integer,Description="x">
##INFO=<ID=DB,Number=0,Type=Flag,Description="x">
##FORMAT=<ID=GT,Number=1,Type=String,Description="x">
##FORMAT=<ID=DP,Number=1,Type=Integer,Description="x">
##FORMAT=<ID=AD,Number=R,Type=Integer,Description="x">
#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tS
chr1\t10\t.\tA\tG,T\t15.9\t.\tDP=7;DB\tGT:AD\t1/2:1,2,.
chr2\t20\trs5\tAC\tA\t.\tPASS\t.\tGT:AD\t0/1:3,4
"""


def written(folder, name, text=TEXT):
    os.makedirs(folder, exist_ok=True)
    path = os.path.join(folder, name)
    with open(path, "w") as f:
        f.write(text)
    return path


def test_read_vcf(spark, tmp_path):
    df = vcf.read_vcf(spark, written(tmp_path, "a.vcf"))
    a, b = df.orderBy("start").collect()
    assert (a["rsid"], a["alt"], a["filter"], a["DP"], a["DB"], a["AD"], a["genotype"]) == (None, "G|T", "", 7, True, [1, 2, None], ["G", "T"])
    assert (b["rsid"], b["qual"], b["end"], b["DP"], b["DB"], b["genotype"]) == ("rs5", None, 22, None, False, ["A", "AC"])


def test_export_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("1", 5, "rs1", "A", "G|T", None, "", 1.5, ["a", "b"], True), ("2", 3, None, "C", "T", 9.0, "PASS", None, None, False)], "chrom string, start long, rsid string, ref string, alt string, qual double, filter string, weight double, notes array<string>, flag boolean")
    vcf.write_vcf(df, str(tmp_path / "out"))
    back = vcf.read_vcf(spark, str(tmp_path / "out"), {"weight": "double", "notes": "array<string>", "flag": "boolean"}, {}).drop("end")
    assert sorted(map(str, back.select(*df.columns).collect())) == sorted(map(str, df.collect()))


def test_harmonise(spark):
    df = spark.createDataFrame([("chr1",), ("chrX",)], "chrom string")
    bare = spark.createDataFrame([("1",)], "chrom string")
    assert {tuple(r) for r in harmonise(df, bare).collect()} == {("1", "stripped"), ("X", "stripped")}
    assert {tuple(r) for r in harmonise(bare, df).collect()} == {("chr1", "prefixed")}


def test_stream_takes_new_files_only(spark, tmp_path):
    drop, out, done = str(tmp_path / "drop"), str(tmp_path / "out"), str(tmp_path / "done")
    lead = spark.createDataFrame([("1", 10, "rs1", "A", ["G", "T"], 1.0)], "chrom string, start long, rsid string, ref string, genotype array<string>, weight double")
    written(f"{drop}/ann", "one.vcf")
    arrivals.annotate_arrivals(spark, drop, {"m": lambda: lead}, out, done).awaitTermination()
    assert [(r["sample"], r["weight"]) for r in arrivals.arrived(spark, out).collect()] == [("ann/one", 1.0)]
    written(f"{drop}/bob", "two.vcf")
    arrivals.annotate_arrivals(spark, drop, {"m": lambda: lead}, out, done).awaitTermination()
    assert sorted(r["sample"] for r in arrivals.arrived(spark, out).collect()) == ["ann/one", "bob/two"]


def test_header_is_read_up_to_the_first_record(spark, tmp_path):
    path = written(tmp_path / "folder", "part-00001.vcf", TEXT + "##INFO=<ID=LATE,Number=1,Type=String,Description=\"x\">\n")
    written(tmp_path / "folder", "part-00000.vcf", "")
    written(tmp_path / "folder", "part-00002.vcf", "chr9\t1\t.\tA\tC\t.\t.\t.\tGT\t0/1\n")
    for place in (path, str(tmp_path / "folder")):
        assert vcf.header_lines(spark, place) == TEXT.splitlines()[:7]
        info, formats = vcf.header_fields(spark, place)
        assert info == {"DP": "int", "DB": "boolean"} and formats == {"GT": "string", "AD": "array<int>"}
    import gzip

    with gzip.open(tmp_path / "z.vcf.gz", "wt") as f:
        f.write(TEXT)
    assert vcf.header_lines(spark, str(tmp_path / "z.vcf.gz")) == TEXT.splitlines()[:7]
    assert vcf.header_lines(spark, written(tmp_path / "none", "x.vcf", "chr9\t1\n")) == []


def test_sample_exports(spark, tmp_path):
    df = spark.createDataFrame([(1, "1", 5, "A", "G", 1.5), (2, "1", 7, "A", "C", None), (2, "2", 3, "C", "T", 2.5)], "sample long, chrom string, start long, ref string, alt string, weight double")
    vcf.write_sample_vcfs(df, str(tmp_path / "out"))
    assert vcf.header_lines(spark, str(tmp_path / "out" / "sample=2"))[-1].startswith("#CHROM")
    back = vcf.read_vcf(spark, str(tmp_path / "out"), {"weight": "double"}, {}, keep=["sample"])
    assert sorted(map(str, back.select("sample", "chrom", "start", "ref", "alt", "weight").collect())) == sorted(map(str, df.withColumn("sample", df["sample"].cast("int")).collect()))
