"""Joins, filters, aggregates and curation on small frames."""

import random

from pyspark.sql import functions as F

from helixframe.operators import aggregates as A
from helixframe.operators import curate as U
from helixframe.operators import filters as L
from helixframe.operators import joins as J

CALLS = "sample int, chrom string, start long, rsid string, ref string, alt string, genotype array<string>"


def calls(spark):
    rows = [
        (1, "1", 10, "rs1;rs2", "A", "G", ["A", "G"]), (1, "1", 20, "rs3", "G", "A", ["A", "G"]), (1, "2", 10, None, "T", "C", ["C", "T"]), (1, "3", 5, "rs9", "C", "T", ["T", "T"]),
    ]
    return spark.createDataFrame(rows, CALLS)


def lead(spark):
    rows = [("1", 10, "rs2", "A", ["A", "G"], 1.5), ("1", 20, "rs3", "GTGTCT", ["A", "G"], 2.0), ("2", 10, "rs7", None, ["T", "C"], -1.0)]
    return spark.createDataFrame(rows, "chrom string, start long, rsid string, ref string, genotype array<string>, weight double").withColumn("module", F.lit("m"))


def test_position_annotation(spark):
    got = {(r["chrom"], r["start"]): r for r in J.annotate_by_position(calls(spark), lead(spark), "m").collect()}
    assert set(got) == {("1", 10), ("2", 10)}  # 1:20 contradicts the ref, 3:5 isn't probed
    assert got["1", 10]["weight"] == 1.5 and got["1", 10]["rsid_m"] == "rs2" and got["1", 10]["rsid"] == "rs1;rs2"
    assert got["2", 10]["weight"] is None  # an unsorted authored genotype never equals a sorted call
    counted = A.written_and_matched(J.annotate_by_position(calls(spark), lead(spark), "m")).first()
    assert (counted["written"], counted["matched"]) == (2, 1)


def test_lead_without_ref(spark):
    assert J.annotate_by_position(calls(spark), lead(spark).drop("ref"), "m").filter("weight = 2.0").count() == 1


def test_rsid_annotation(spark):
    got = J.annotate_by_rsid(calls(spark), lead(spark), "m")
    assert [(r["rsid"], r["weight"]) for r in got.orderBy("rsid").collect()] == [("rs1;rs2", 1.5), ("rs3", 2.0)]


def test_strategy(spark):
    one = lambda df: J.join_strategy(df).first().asDict()
    assert one(lead(spark)) == {"strategy": "position", "missing": ""}
    assert one(lead(spark).drop("chrom", "start"))["strategy"] == "rsid"
    assert one(lead(spark).drop("genotype")) == {"strategy": "unsupported", "missing": "genotype"}
    assert one(lead(spark).limit(0))["strategy"] == "rsid"


def test_nearest_within_equals_brute_force(spark):
    rng = random.Random(3)
    sites = [(str(rng.randint(1, 3)), rng.randint(0, 5000)) for _ in range(300)]
    asked = [(str(rng.randint(1, 4)), rng.randint(-200, 5200)) for _ in range(300)]
    for most in (1, 7, 60):
        got = {(r["chrom"], r["start"]): r["distance"] for r in J.nearest_within(spark.createDataFrame(asked, "chrom string, start long"), spark.createDataFrame(sites, "chrom string, start long"), most).collect()}
        want = {a: min((abs(a[1] - s[1]) for s in sites if s[0] == a[0]), default=10**9) for a in asked}
        assert got == {k: v for k, v in want.items() if v <= most}


def test_hom_ref_and_restoration(spark):
    rows = [
        ("1", 100, "A", ["A", "A"], 1), ("1", 200, "C", ["C", "C"], None), ("1", 200, "G", ["G", "G"], None), ("1", 300, "T", ["T", "T"], 2),
        ("1", 400, "AT", ["AT", "AT"], 1), ("1", 500, "A", [], 1), ("2", 100, "A", ["A"], None), ("9", 1, "A", ["A", "A"], 1),
    ]
    table = spark.createDataFrame(rows, "chrom string, start long, ref string, genotype array<string>, locus_count int")
    assert {(r["chrom"], r["start"]) for r in L.hom_ref_rows(table).collect()} == {("1", 100), ("1", 400), ("2", 100), ("9", 1)}
    called = spark.createDataFrame([("1", 100), ("1", 580), ("2", 99)], "chrom string, start long")
    found = {(r["chrom"], r["start"]): r["restored_flank_bp"] for r in L.restored(table, called, 180).collect()}
    assert found == {("1", 400): 180, ("2", 100): 1}


def test_quality_filter(spark):
    rows = [("PASS", 30, 50.0), ("", 30, 50.0), ("LowQual", 30, 50.0), ("PASS", 5, None)]
    df = spark.createDataFrame(rows, "filter string, dp int, qual double")
    assert L.quality_filter(df, ["PASS", "."], 10, 20).count() == 2
    assert L.quality_filter(df).count() == 4 and L.quality_filter(df.select("qual"), ["PASS"], 10, 0).count() == 4


def test_scope(spark):
    even = spark.range(2000).select(F.lit("1").alias("chrom"), (F.col("id") * 100).alias("start"))
    clustered = spark.range(2000).select(F.lit("1").alias("chrom"), (F.col("id") % 1000 + F.floor(F.col("id") / 1000) * 10_000_000).alias("start"))
    assert A.callset_scope(even, 100, 1000).first()["scope"] == "wgs"
    assert A.callset_scope(even, 100, 5000).first()["reason"] == "few sites"
    assert A.callset_scope(clustered, 100, 1000).first()["reason"] == "narrow"
    assert A.callset_scope(even.limit(0), 100, 1).first()["breadth"] == 0.0


def test_phased_counts(spark):
    df = spark.createDataFrame([("A|G",), ("G|A",), ("A/G",), ("C/C",)], "genotype string")
    assert tuple(A.phased_counts(df).first()) == (2, 1)


def test_enrichment_keeps_the_height(spark):
    notes = spark.createDataFrame([("rs1", "G1"), ("rs1", "G2"), ("rs2", "G3")], "rsid string, gene string")
    weights = spark.createDataFrame([("rs1", 1.0), ("rs2", 2.0)], "rsid string, weight double")
    assert [(r["rsid"], r["gene"]) for r in J.enrich(weights, notes, ["rsid"], True).orderBy("rsid").collect()] == [("rs1", "G1"), ("rs2", "G3")]
    assert J.enrich(weights, notes, ["rsid"], False).count() == 3


def test_corrections(spark):
    rows = spark.createDataFrame([("rs1", "A/A", 1.0, "protective"), ("rs2", "A/G", 1.0, "protective"), ("rs3", "A/G", 1.0, "protective"), (None, "A/G", 1.0, "x")], "rsid string, genotype string, weight double, state string")
    fixes = [("rs1", "*", "weight", "-2"), ("rs2", "A/G", "weight", "-1"), ("rs2", "*", "state", "neutral"), ("rs3", "A/G", "drop", ""), ("rs3", "A/G", "weight", "9"), ("rs1", "G/G", "weight", "5")]
    got = {r["rsid"]: (r["weight"], r["state"]) for r in U.corrected(rows, fixes).collect()}
    assert got == {"rs1": (-2.0, "risk"), "rs2": (-1.0, "neutral"), None: (1.0, "x")}
    assert {(r["rsid"], r["new_value"]) for r in U.unmatched_corrections(rows, fixes).collect()} == {("rs3", "9"), ("rs1", "5")}


def test_resolution(spark):
    reference = spark.createDataFrame([("1", 5, "rs1", "A"), ("2", 6, "rs2", "C")], "chrom string, start long, id string, ref string")
    asked = spark.createDataFrame([(1, "rs1", None, None), (2, None, "2", 6), (3, "rs2", "7", 70), (4, "rs99", None, None), (5, None, "9", 9)], "k int, rsid string, chrom string, start long")
    got = {r["k"]: (r["rsid"], r["chrom"], r["start"], r["resolved"]) for r in J.resolve(asked, reference).collect()}
    assert got == {1: ("rs1", "1", 5, True), 2: ("rs2", "2", 6, True), 3: ("rs2", "7", 70, True), 4: ("rs99", None, None, False), 5: (None, "9", 9, False)}


def test_problems(spark):
    rows = [("x1", "1", "5", "A/G", "1", "risk"), ("rs2", "1", "", "G/A", "1", "odd"), ("", "", "", "A/G", "-1", "protective"), ("rs3", "99", "7", "A/G", "1", "")]
    found = {(r["rule"]) for r in U.problems(spark.createDataFrame(rows, "rsid string, chrom string, start string, genotype string, weight string, state string"), spark.createDataFrame([("rs8", "1"), ("rs8", "1")], "rsid string, pmid string")).collect()}
    assert found == {"bad_rsid", "positive_risk", "unsorted_genotype", "unknown_state", "partial_position", "no_identifier", "negative_protective", "unknown_contig", "duplicate_study", "orphan_study"}


def test_grid_filter(spark):
    df = spark.createDataFrame([("Abc", 1), ("xyz", 2), (None, 3)], "s string, n int")
    assert L.grid_filter(df, [{"field": "s", "operator": "contains", "value": "AB"}]).count() == 1
    assert L.grid_filter(df, [{"field": "s", "operator": "isEmpty"}, {"field": "n", "operator": ">", "value": 1}], every=False).count() == 2
    assert L.grid_filter(df, []).count() == 3


def test_gaps_over_bins(spark):
    rows = [("1", x) for x in (3, 5, 5, 9, 40, 41, 99)] + [("2", 7), ("3", 95), ("3", 5)]
    got = {(r["chrom"], r["start"]): r["gap"] for r in A.gaps(spark.createDataFrame(rows, "chrom string, start long"), width=10).collect()}
    assert got == {("1", 3): None, ("1", 5): 2, ("1", 9): 4, ("1", 40): 31, ("1", 41): 1, ("1", 99): 58, ("2", 7): None, ("3", 5): None, ("3", 95): 90}


def test_quality_filter_reaches_the_scan(spark, tmp_path):
    spark.createDataFrame([(5, 30.0), (20, 10.0), (20, 30.0)], "dp int, qual double").write.parquet(str(tmp_path / "t"))
    df = L.quality_filter(spark.read.parquet(str(tmp_path / "t")), depth=10, quality=20)
    assert df.count() == 1 and "GreaterThanOrEqual(dp,10)" in df._jdf.queryExecution().executedPlan().toString()
    text = L.quality_filter(spark.createDataFrame([("x", "30"), ("11", "25")], "dp string, qual string"), depth=10, quality=20)
    assert text.count() == 1


def test_content_delta(spark):
    a = spark.createDataFrame([(1, "x"), (1, "x"), (2, "y")], "k int, t string")
    b = spark.createDataFrame([(1, "x"), (2, "z"), (3, None)], "k int, t string")
    assert tuple(U.content_delta(a, b).first()) == (2, 2) and tuple(U.content_delta(a, a).first()) == (0, 0)
