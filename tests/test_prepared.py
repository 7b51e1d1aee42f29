"""The prepared reference, places and pages of sorted views, pruning by joins, corrections as a fold, and rows without a contig or a variant."""

import random

import pytest
from pyspark.sql import functions as F

from helixframe.operators import curate as U
from helixframe.operators.ranking import SortedView
from helixframe.sources import prepared, tables, vcf


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def no_broadcast(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


@pytest.fixture
def reference(spark):
    rows = [("1", i * 3, "A", "CGT"[i % 3], f"rs{i}", i / 2) for i in range(300)] + [("1", 3, "A", "T", "rs1t", 9.0), ("2", 3, "AA", "T", "rs2", None), ("2", 3, None, "T", "rs3", 1.0)]
    return spark.createDataFrame(rows, "chrom string, start long, ref string, alt string, id string, score double")


def test_a_prepared_reference_is_not_shuffled(spark, reference, no_broadcast, tmp_path):
    done = prepared.prepare(reference, str(tmp_path / "ref"), "prepared_a", buckets=4)
    rows = [(n, "1", 3 * n, "A", "CGT"[n % 3]) for n in range(0, 400, 7)] + [(-1, "1", 3, "A", "T"), (-2, "2", 3, "AA", "T"), (-3, "2", 3, None, "T"), (-4, None, 3, "A", "T")]
    calls = spark.createDataFrame(rows, "n long, chrom string, start long, ref string, alt string")
    joined = prepared.annotate(calls, done)
    assert plan_of(joined).count("Exchange hashpartitioning") == 1 and "Bucketed: true" in plan_of(joined)
    want = {tuple(r) for r in calls.join(reference, ["chrom", "start", "ref", "alt"], "left").select("n", "chrom", "start", "ref", "alt", "id", "score").collect()}
    assert {tuple(r) for r in joined.collect()} == want and joined.columns == ["n", "chrom", "start", "ref", "alt", "id", "score"]
    found = prepared.at_positions(done, calls)
    assert plan_of(found.filter("chrom = '1'")).count("Bucketed: true") == 1
    assert found.count() == reference.join(calls.select("chrom", "start").distinct(), ["chrom", "start"], "left_semi").count() and set(found.columns) == set(reference.columns)
    again = prepared.open_prepared(spark, str(tmp_path / "ref"), "prepared_again", 4, done.schema)
    assert plan_of(prepared.annotate(calls, again)).count("Exchange hashpartitioning") == 1
    assert {tuple(r) for r in prepared.annotate(calls, again).collect()} == want


def test_places_and_pages(spark, tmp_path):
    rng = random.Random(2)
    rows = [(rng.choice("abc") if i % 3 else "hot", rng.choice([None, 1.5, -2.0, 0.0]), i) for i in range(2000)]
    df = spark.createDataFrame(rows, "kind string, x double, key long").repartition(7)
    view = SortedView.write(df, str(tmp_path / "view"), "kind", F.desc("x"), "key", files=9)
    in_order = sorted(rows, key=lambda r: (r[0], r[1] is None, -(r[1] or 0), r[2]))
    assert view.total() == 2000
    assert {(r["key"], r["place"]) for r in view.ranked().collect()} == {(r[2], n + 1) for n, r in enumerate(in_order)}
    seen, want = {}, set()
    for kind, _, key in in_order:
        seen[kind] = seen.get(kind, 0) + 1
        want.add((key, seen[kind]))
    ranked = view.ranked("at", by=["kind"])
    assert {(r["key"], r["at"]) for r in ranked.collect()} == want and "Window" not in plan_of(ranked)
    for offset, limit in ((0, 10), (995, 40), (1990, 40), (2000, 5)):
        page = view.page(offset, limit, "n")
        assert [(r["n"], r["key"]) for r in page.collect()] == [(offset + i, r[2]) for i, r in enumerate(in_order[offset : offset + limit])]
        assert len(view.page_files(offset, limit)) <= 2 and len(page.inputFiles()) <= 2
    empty = SortedView.write(df.limit(0), str(tmp_path / "empty"), "key")
    assert empty.total() == 0 and empty.page(0, 10).collect() == [] and empty.ranked().collect() == []


def test_null_groups_are_ranked(spark, tmp_path):
    df = spark.createDataFrame([(None, 2), (None, 1), ("a", 5)], "kind string, key long")
    view = SortedView.write(df, str(tmp_path / "view"), "kind", "key")
    assert sorted((r["key"], r["place"]) for r in view.ranked(by=["kind"]).collect()) == [(1, 1), (2, 2), (5, 1)]


def test_partitions_are_pruned_by_the_join(spark, reference, tmp_path):
    reference.unionByName(reference.withColumn("chrom", F.lit("X"))).write.partitionBy("chrom").parquet(str(tmp_path / "parts"))
    calls = spark.createDataFrame([("X", 5, 40), ("1", 6, 3)], "chrom string, start long, dp int")
    found = tables.only_needed(tables.reference_view(spark, str(tmp_path / "parts"), "parts"), calls.filter("dp > 10"))
    assert "dynamicpruning" in plan_of(found) and {r["chrom"] for r in found.collect()} == {"X"}
    files = found.select("_metadata.file_path").distinct().collect()
    assert files and all("chrom=X" in r[0] for r in files)


def brute_corrected(rows, corrections):
    out = []
    for row in rows:
        now = dict(row)
        for rsid, other, field, value in corrections:
            if now["rsid"] == rsid and other in ("*", now["genotype"] or ""):
                if field == "drop":
                    now = None
                    break
                now[field] = float(value) if field == "weight" else value
                if field == "weight":
                    now["state"] = "protective" if now["weight"] > 0 else "risk" if now["weight"] < 0 else "neutral"
        if now:
            out.append(tuple(now.values()))
    return sorted(out, key=repr)


def test_corrections_fold_in_their_order(spark):
    rng = random.Random(7)
    rows = [{"key": i, "rsid": rng.choice([None, "rs1", "rs2", "rs3", "rs4"]), "genotype": rng.choice([None, "A/G", "T/T"]), "weight": 1.0, "state": "protective"} for i in range(60)]
    values = {"weight": ["-1", "2.5", "0"], "state": ["alt", "ref"], "genotype": ["A/G", "C/C"], "rsid": ["rs1", "rs3", "rs9"], "drop": [""]}
    df = spark.createDataFrame([tuple(r.values()) for r in rows], "key long, rsid string, genotype string, weight double, state string")
    for _ in range(6):
        corrections = []
        for _ in range(12):
            field = rng.choice([*values, "weight", "state"])
            corrections.append((rng.choice(["rs1", "rs2", "rs3", "rs9"]), rng.choice(["*", "*", "A/G", "C/C"]), field, rng.choice(values[field])))
        assert sorted((tuple(r) for r in U.corrected(df, corrections).collect()), key=repr) == brute_corrected(rows, corrections)
    assert U.corrected(df, []).count() == 60
    with pytest.raises(ValueError):
        U.corrected(df, [("rs1", "*", "nothing", "1")])


def test_thousands_of_corrections_plan_like_two(spark):
    df = spark.createDataFrame([(1, "rs7", "A/G", 1.0, "protective"), (2, "rs6000", "A/G", 1.0, "protective")], "key long, rsid string, genotype string, weight double, state string")
    few, many = [("rs7", "*", "weight", "-3"), ("rs8", "*", "weight", "1")], [(f"rs{i}", "*", "weight", str(-i)) for i in range(5000)]
    lines = [len(U.corrected(df, c)._jdf.queryExecution().optimizedPlan().toString().splitlines()) for c in (few, many)]
    assert lines[0] == lines[1]
    assert sorted((r["key"], r["weight"], r["state"]) for r in U.corrected(df, many).collect()) == [(1, -7.0, "risk"), (2, 1.0, "protective")]
    left = U.unmatched_corrections(df, many)
    assert left.columns == ["rsid", "genotype", "field", "new_value"] and left.count() == 4999


def test_a_record_without_a_contig_comes_after_the_header(spark, tmp_path):
    df = spark.createDataFrame([(None, 5, "A", 1.5), ("1", None, "C", 2.5), ("1", 7, "G", None)], "chrom string, start long, ref string, weight double")
    vcf.write_vcf(df, str(tmp_path / "out"))
    assert vcf.header_lines(spark, str(tmp_path / "out"))[-1].startswith("#CHROM") and set(vcf.header_fields(spark, str(tmp_path / "out"))[0]) == {"weight"}
    assert sorted((r["chrom"], r["ref"], r["weight"]) for r in vcf.read_vcf(spark, str(tmp_path / "out")).collect()) == [(".", "A", 1.5), ("1", "C", 2.5), ("1", "G", None)]
    assert sorted(r["start"] or 0 for r in vcf.read_vcf(spark, str(tmp_path / "out")).collect()) == [0, 5, 7]


def test_studies_without_a_variant_stay(spark):
    reference = spark.createDataFrame([("1", 5, "rs1", "A")], "chrom string, start long, id string, ref string")
    rows = [("rs1", None, None, None, "PMID 1234"), (None, None, None, None, "PMID 5678"), (None, "1", 5, "A", "PMID 77777")]
    studies = spark.createDataFrame(rows, "rsid string, chrom string, start long, ref string, pmid string").withColumn("conclusion", F.lit("c"))
    assert {(r["variant_key"], r["pmid"]) for r in U.compile_studies(studies, reference).collect()} == {("rs1", "1234"), (None, "5678"), ("rs1", "77777")}
