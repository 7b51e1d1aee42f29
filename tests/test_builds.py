"""Builds of module tables, release comparison, percentiles, restored scores and streamed batches on small fixtures."""

import random

import pytest
from pyspark.sql import functions as F

from helixframe.operators import aggregates as A
from helixframe.operators import curate as U
from helixframe.operators import filters as L
from helixframe.operators import joins as J
from helixframe.operators import panels as N
from helixframe.operators import ports as P
from helixframe.streaming import arrivals


def rows_of(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def test_weights_with_a_table_of_variants(spark):
    weights = [(1, "rs1", "AG", "1,5", "own"), (2, "rs1", "G|A", "9", ""), (3, "rs2", "TT", "-2", " "), (4, "rs3", "-", "1", "x"), (5, "q7", "AA", "1", "x"), (6, "rs4", "CC", None, None), (7, None, "AA", "1", "x")]
    meta = [(1, "rs2", "G1", "old", "PMID 1111"), (2, "rs2", "G2", "of variant", "PMID 2222; PMID 3333"), (3, "rs1", " ", "", "")]
    dedicated = [(1, "rs2", "PMID 2222", "dedicated", "EU", "significant")]
    found = P.port_weights(
        spark.createDataFrame(weights, "line long, rsid string, genotype string, weight string, conclusion string"),
        spark.createDataFrame(meta, "line long, rsid string, gene string, conclusion string, pmids string").withColumn("population", F.lit("")),
        spark.createDataFrame(dedicated, "line long, rsid string, cell string, conclusion string, population string, association string"),
    )
    assert rows_of(found.variants, "rsid", "genotype", "weight", "state", "conclusion", "gene", "duplicates") == sorted(
        [("rs1", "A/G", 1.5, "protective", "own", None, 1), ("rs2", "T/T", -2.0, "risk", "of variant", "G2", 0), ("rs4", "C/C", None, "neutral", "", None, 0)], key=repr
    )
    assert rows_of(found.rejected, "rsid", "reason") == sorted([("rs3", "invalid genotype"), ("q7", "invalid rsid"), (None, "invalid rsid"), ("rs3", "vanished")], key=repr)
    assert rows_of(found.studies, "rsid", "pmid", "conclusion", "significance") == [("rs2", "2222", "dedicated", "significant"), ("rs2", "3333", "of variant", None)]


def test_effect_alleles_with_dimensions(spark):
    alleles = [(1, "rs1", "A", "het", "1", 1), (2, "rs1", "G", "Homozygous", "2", 9), (3, "rs2", "C", "het", "1", 1), (4, "rs2", "C", "hom", "1", 1), (5, "rs1", "Z", "hom", "1", 1)]
    findings = [(1, "rs1", "short", 7, 1, "Significant", "PMID 1234"), (2, "rs1", "much longer", 7, 1, "not significant", "PMID 1234; PMID 5678"), (3, "rs1", "as long....", 8, 1, "", "")]
    dims = spark.createDataFrame([(1, "one"), (7, "seven")], "id int, name string")
    found = P.port_effect_alleles(
        spark.createDataFrame(alleles, "line long, rsid string, allele string, zygosity string, weight string, category_id int"),
        spark.createDataFrame(findings, "line long, rsid string, conclusion string, gene_id int, population_id int, association string, cell string"),
        dims, dims, dims, spark.createDataFrame([("rs1", "A", "G|T")], "id string, ref string, alt string"),
    )
    assert rows_of(found.variants, "rsid", "genotype", "conclusion", "gene", "category") == sorted(
        [("rs1", "A/G", "much longer", "seven", "one"), ("rs1", "G/G", "much longer", "seven", None), ("rs2", "C/C", "Longevity-associated variant", None, "one")], key=repr
    )
    assert rows_of(found.rejected, "rsid", "reason") == [("rs1", "unresolved genotype"), ("rs2", "unresolved genotype")]
    assert rows_of(found.studies, "rsid", "pmid", "population", "significance") == [("rs1", "1234", "one", "significant"), ("rs1", "5678", "one", "non-significant")]


def test_named_alleles(spark):
    source = [
        (1, "rs1", "G", "CC", None, None, None), (2, "rs2", "G", None, None, None, "het"), (3, "rs3", "G", None, None, None, "both"), (4, "rs4", "G", None, "A", "T", "hom"), (5, "rs5", "G", None, "A", "AT", "x"),
        (6, "rs6", "G", None, "A", "T", "hom"), (7, " ", "G", None, None, None, None), (8, "y1", "G", None, None, None, None), (9, "rs7", "H", None, None, "g", "both"),
    ]
    keep = [("rs1", ["11"], None), ("rs2", ["12"], "override"), ("rs3", ["13"], None), ("rs4", ["14"], " "), ("rs7", ["15"], None)]
    reference = [("rs2", "A", "G"), ("rs3", "A", "G|T"), ("rs7", "A", "C|T")]
    found = P.port_named_alleles(
        spark.createDataFrame(source, "line long, rsid string, gene string, genotype string, ref string, alt string, zygosity string").withColumn("conclusion", F.lit("told")),
        spark.createDataFrame(keep, "rsid string, pmids array<string>, conclusion string"), spark.createDataFrame([("G", ["99"])], "gene string, pmids array<string>"),
        spark.createDataFrame(reference, "id string, ref string, alts string"), spark.createDataFrame([("rs90", "N", ["A/G"], "", ["77"])], "rsid string, gene string, genotypes array<string>, conclusion string, pmids array<string>"),
    )
    got = rows_of(found.variants, "rsid", "genotype", "conclusion", "weight")
    want = [("rs1", "C/C", "told"), ("rs2", "A/G", "override"), ("rs4", "T/T", "told"), ("rs5", "A/AT", "told"), ("rs5", "AT/AT", "told"), ("rs90", "A/G", "Beneficial variant")]
    want += [("rs7", g, "told") for g in ("A/C", "C/C", "A/T", "T/T", "A/G", "G/G")]
    assert got == sorted([(*w, None) for w in want], key=repr)
    assert rows_of(found.rejected, "rsid", "reason") == [("rs3", "ambiguous allele"), ("rs6", "unnamed"), ("y1", "invalid rsid")]
    assert ("rs5", "99") in rows_of(found.studies, "rsid", "pmid") and ("rs90", "77") in rows_of(found.studies, "rsid", "pmid")


def test_a_gene_panel(spark):
    info = lambda sig: f"CLNSIG={sig};RS=1"
    rows = [
        (1, "rs1", "1", 5, "A", "G", info("Pathogenic"), 2, ["AA"]), (2, "rs9", "1", 7, "A", "G", info("Pathogenic"), 2, ["zz", "bb"]), (3, "rs9", "1", 8, "A", "G", info("Likely_pathogenic"), 2, ["BB"]), (4, "rs4", "1", 9, "A", "AN", info("Pathogenic"), 2, ["AA"]),
        (5, "rs5", "1", 10, "A", "G", info("Benign"), 2, ["AA"]), (6, "rs6", "1", 11, "A", "G", info("Pathogenic"), 0, ["AA"]), (7, "rs7", "MT", 12, "A", "G", info("Pathogenic"), 2, ["AA"]), (8, None, "1", 13, "A", "C", info("Pathogenic"), 2, ["AA"]),
        (9, "rs8", "1", 14, "A", "C", info("Pathogenic"), 2, ["AA"]), (10, "rs8", "1", 14, "A", "T", info("Pathogenic"), 2, ["AA"]),
    ]
    one = lambda rows, c: spark.createDataFrame(rows, c)
    found = N.build_panel(
        one(rows, "record_id long, rsid string, chrom string, start long, ref string, alt string, info string, stars int, genes array<string>"), one([("AA",), ("old",), ("none",)], "gene string"),
        one([], "gene string, symbol string"), one([("AA",), ("BB",)], "symbol string"), one([("old", "BB")], "synonym string, symbol string"), one([("rs1", "3"), ("rs1", "1"), ("rs1", "1"), ("rs1", "2"), ("rs9", "4"), ("rs1", "x")], "rsid string, pmid string"), 1, 2,
    )
    identities = {(r[0], r[1]) for r in rows_of(found.variants, "identity", "genotype")}
    assert {i for i, _ in identities} == {"rs1", "1:7:A:G", "1:8:A:G", "rs7", "1:13:A:C", "rs8"}
    assert {g for i, g in identities if i == "rs7"} == {""} and {g for i, g in identities if i == "rs8"} == {"A/C", "C/C", "A/T", "T/T"}
    assert rows_of(found.studies, "variant", "kept", "dropped", "unsound") == [("rs1", "1,2", 1, 1)]
    counters = dict(rows_of(found.counters, "name", "n"))
    assert counters == {"symbols changed": 1, "symbols unresolved": 1, "records in panel": 8, "identities by coordinate": 1, "variants": 6, "rows": 13, "citations dropped": 1, "rejected: not_acgt": 1}


def test_drug_annotations(spark):
    rows = spark.createDataFrame([(1, "A/G", "g", "d", "1A"), (2, "A/G", "g", "e", "2b"), (3, "C/C", "h", "e", "3"), (4, "T/T", "h", "f", "2A")], "annotation_id long, genotype string, gene string, drug string, level string")
    texts = spark.createDataFrame([(1, "A/G", "slashed"), (1, "AG", "plain"), (2, "AG", "Only plain. It is rather long")], "annotation_id long, genotype string, text string")
    told, counts = N.build_drug_annotations(rows, texts, limit=12)
    assert rows_of(told, "annotation_id", "text") == [(1, "slashed"), (2, "Only plain."), (4, None)] and tuple(counts.first()) == (3, 3, 2, 2)


def test_keyings_of_annotations(spark):
    weights = spark.createDataFrame([(1, "v1", "rs1", ["A", "G"], False), (2, "v1", "rs1", ["G", "A"], True)], "k int, variant_key string, rsid string, genotype array<string>, phased boolean")
    notes = spark.createDataFrame([("v1", "rs1", "A/G", "g1"), ("v1", "rs1", "A/G", "g2"), ("v1", "rs1", "G|A", "g3")], "variant_key string, rsid string, genotype string, gene string")
    assert rows_of(J.with_annotations(weights, notes), "k", "gene") == [(1, "g1"), (1, "g2"), (2, "g3")]
    assert rows_of(J.with_annotations(weights, notes.drop("genotype")), "k", "gene") == [(1, "g1"), (2, "g1")]
    assert J.annotations_keying(weights.drop("variant_key"), notes) == "rsid" and J.annotations_keying(weights.withColumn("genotype", F.lit("A/G")), notes) == "variant_key"


def test_releases_are_compared_by_fingerprints(spark):
    rows = [(i, None if i % 5 else "x", float(i)) for i in range(500)]
    a = spark.createDataFrame(rows, "k long, t string, w double")
    b = spark.createDataFrame(list(reversed(rows)), "k long, t string, w double").repartition(5)
    same = U.release_delta(a, b, ["k"]).first()
    assert (same["rows_before"], same["same_keys"], same["superset"], same["buckets_changed"], same["lost"], same["gained"]) == (500, True, True, 0, 0, 0)
    swapped = a.withColumns({"t": F.when(F.col("k") == 7, "None").otherwise(F.col("t"))})
    found = U.release_delta(a, swapped.drop("w").withColumn("extra", F.lit(1)), ["k"]).first()
    assert (found["added"], found["removed"], found["superset"], found["same_keys"], found["buckets_changed"], found["lost"], found["gained"]) == ("extra", "w", False, True, 1, 1, 1)
    twice = U.release_delta(a, a.unionByName(a.filter("k = 3")), ["k"]).first()
    assert (twice["rows_after"], twice["same_keys"], twice["lost"], twice["gained"]) == (501, False, 0, 1)
    assert U.release_delta(a.limit(0), a.limit(0), ["k"]).first()["buckets_changed"] == 0


def test_percentiles_of_big_distributions(spark):
    rng = random.Random(3)
    values = {"big": [rng.gauss(0, 1) for _ in range(20_000)], "ties": [float(i % 3) for i in range(9_000)], "small": [1.0, 2.0, 2.0, 5.0]}
    distribution = spark.createDataFrame([(p, v) for p, vs in values.items() for v in vs], "pgs_id string, score double")
    asked = [(i, p, x) for p in values for i, x in enumerate((-9.0, 0.0, 1.0, 2.0, 0.37, 99.0))]
    got = A.percentiles(spark.createDataFrame(asked, "sample long, pgs_id string, score double"), distribution, exact_rows=1000).collect()
    assert len(got) == len(asked)
    for r in got:
        true = sum(v <= r["score"] for v in values[r["pgs_id"]]) / len(values[r["pgs_id"]])
        assert r["exact"] == (r["pgs_id"] == "small") and abs(r["percentile"] - true) <= (1e-6 if r["exact"] else 0.008)


def test_positions_without_a_call_count_as_reference(spark):
    scoring = [("p", "1", 1, "A", 0.5), ("p", "1", 2, "G", 1.0), ("p", "1", 3, "T", 2.0), ("p", "1", 9, "T", 4.0), ("q", "1", 1, "C", 8.0)]
    scoring = spark.createDataFrame(scoring, "pgs_id string, chrom string, start long, effect_allele string, effect_weight double")
    universe = spark.createDataFrame([("1", 1, "A"), ("1", 2, "C"), ("1", 3, "T")], "chrom string, start long, ref string")
    calls = spark.createDataFrame([(1, "1", 1, ["A", "C"]), (1, "1", 9, ["T", "T"]), (2, "1", 3, ["C", "C"]), (2, "1", 3, ["C", "C"])], "sample long, chrom string, start long, genotype array<string>")
    got = {(r["sample"], r["pgs_id"]): (r["score"], r["matched"], r["total"]) for r in A.restored_scores(J.score_rows(calls, scoring), scoring, universe).collect()}
    assert got == {(1, "p"): (0.5 + 0 + 4.0 + 8.0, 4, 4), (1, "q"): (8.0, 1, 1), (2, "p"): (1.0, 3, 4)}


def test_a_filter_that_accounts_for_itself(spark, tmp_path):
    df = spark.createDataFrame([(1, 5, "PASS"), (1, 30, "PASS"), (2, None, "PASS")], "sample long, dp int, filter string")
    found = L.accounted(df, str(tmp_path / "a"), "sample", passing=["PASS"], depth=10)
    assert rows_of(found.kept, "sample", "dp") == [(1, 30)] and rows_of(found.account, "sample", "before", "after", "removed") == [(1, 2, 1, 1), (2, 1, 0, 1)]


HEAD = "##fileformat=VCFv4.2\n#CHROM\tPOS\n"


def line(pos, dp=30, gt="0/1"):
    return f"chr1\t{pos}\trs{pos}\tA\tG\t50\tPASS\tDP={dp}\tGT\t{gt}\n"


@pytest.fixture
def folder(tmp_path):
    import gzip

    path = tmp_path / "in" / "ann"
    path.mkdir(parents=True)
    (path / "one.vcf").write_text(HEAD + line(5) + line(7, dp=3) + line(9))
    with gzip.open(path / "one.vcf.gz", "wt") as f:
        f.write(HEAD + line(5) + line(7, dp=3) + line(9))
    (path / "two.vcf").write_text(HEAD + line(5, gt="1/1"))
    return tmp_path


def test_batches_leave_one_copy(spark, folder):
    lead = spark.createDataFrame([("1", 5, "rs5", "A", ["A", "G"], "m")], "chrom string, start long, rsid string, ref string, genotype array<string>, module string")

    def bad():
        raise RuntimeError("gone")

    readers, to = {"m": lambda: lead, "bad": bad}, str(folder / "out")
    arrivals.annotate_arrivals(spark, str(folder / "in"), readers, to, str(folder / "seen"), {"depth": 10}).awaitTermination()
    first = rows_of(arrivals.arrived(spark, to), "sample", "start", "module")
    assert first == [("ann/one", 5, "m"), ("ann/two", 5, None)]
    lines = spark.createDataFrame([("ann/two", line(5, gt="0/1").rstrip("\n"), "two.vcf"), ("ann/three", line(5).rstrip("\n"), "three.vcf")], "sample string, value string, source string")
    for _ in range(2):  # a batch that runs twice
        arrivals.store(lines, 1, readers, to, {"depth": 10})
    assert rows_of(arrivals.arrived(spark, to), "sample", "start", "module") == [("ann/one", 5, "m"), ("ann/three", 5, "m"), ("ann/two", 5, "m")]
    assert rows_of(arrivals.outcomes(spark, to), "batch", "module", "kind", "reason", "written") == [(0, "bad", "failed", "RuntimeError", 0), (0, "m", "ok", None, 2), (1, "bad", "failed", "RuntimeError", 0), (1, "m", "ok", None, 2)]


def test_an_addition_stays_beside_a_source_row_of_the_same_variant_and_genotype(spark):
    one = lambda rows, c: spark.createDataFrame(rows, c)
    found = P.port_named_alleles(
        one([(1, "rs90", "G", "A/G", None, None, None, "told"), (2, "rs90", "G", "GA", None, None, None, "again")], "line long, rsid string, gene string, genotype string, ref string, alt string, zygosity string, conclusion string"),
        one([("rs90", ["1"], None)], "rsid string, pmids array<string>, conclusion string"), one([], "gene string, pmids array<string>"), one([], "id string, ref string, alts string"),
        one([("rs90", "N", ["A/G", "G/G"], "", ["77"])], "rsid string, gene string, genotypes array<string>, conclusion string, pmids array<string>"),
    )
    assert rows_of(found.variants, "rsid", "genotype", "conclusion", "gene", "duplicates") == [("rs90", "A/G", "Beneficial variant", "N", 0), ("rs90", "A/G", "told", "G", 1), ("rs90", "G/G", "Beneficial variant", "N", 0)]


def test_the_names_of_arriving_samples(spark):
    paths = ["file:/in/ann/one.vcf", "file:/in/ann/one.vcf.gz", "s3://b/user=user1/part-0.c000.txt", "/in/ann/plain", "/in/ann/.vcf", "/in/ann/a.vcf.txt", "one.vcf"]
    found = [r[0] for r in spark.createDataFrame([(i, p) for i, p in enumerate(paths)], "n int, p string").orderBy("n").select(arrivals.sample_key(F.col("p"))).collect()]
    assert found == ["ann/one", "ann/one", "user=user1/part-0.c000", "ann/plain", "ann/.vcf", "ann/a", ""]


def test_lines_of_a_batch_are_not_shuffled_by_their_sample(spark):
    """Ten samples are ten tasks, however long they are, and a stream's plans aren't adaptive."""
    lines = spark.range(100).select(F.lit("u/s").alias("sample"), F.col("id").cast("string").alias("value"), F.when(F.col("id") < 60, "u/s.vcf").otherwise("u/s.vcf.gz").alias("source"))
    threshold = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(threshold)
    spark.conf.set(threshold, -1)
    try:
        first = arrivals.one_file_a_sample(lines)
        plan = first._jdf.queryExecution().executedPlan().toString()
        assert first.count() == 60
    finally:
        spark.conf.set(threshold, before)
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
