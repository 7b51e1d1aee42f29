"""An annotation run over modules that fit, don't fit, can't be read, and fail while they are written."""

import json

import pytest
from pyspark.sql import functions as F

from helixframe.operators import joins as J
from helixframe.operators import runs as R

CALL = "sample long, chrom string, start long, rsid string, ref string, alt string, filter string, genotype array<string>"
LEAD = "chrom string, start long, rsid string, ref string, genotype array<string>, weight double, module string"
WHOLE = R.Context("variant_only", 5, 1.0, "wgs", "wide", True)


@pytest.fixture
def calls(spark):
    rows = [(1, "1", 5, "rs1;rs9", "A", "G", "PASS", ["A", "G"]), (1, "1", 9, None, "C", "T", "PASS", ["C", "T"]), (2, "2", 7, "rs7", "T", "C", "PASS", ["C", "C"])]
    return spark.createDataFrame(rows, CALL)


@pytest.fixture
def lead(spark):
    rows = [("1", 5, "rs1", "A", ["A", "G"], 1.0, "m"), ("1", 9, "rs2", "G", ["C", "T"], 2.0, "m"), ("1", 12, "rs3", "T", ["T", "T"], 3.0, "m"), ("2", 7, "rs7", None, ["T", "T"], 4.0, "m"), ("1", 400, "rs4", "A", ["A", "A"], 5.0, "m")]
    return spark.createDataFrame(rows, LEAD)


def counts(outcomes):
    return {r["module"]: (r["kind"], r["reason"], r["written"], r["matched"], r["restored"]) for r in outcomes.collect()}


def test_outcomes_and_tables_of_a_run(spark, calls, lead, tmp_path):
    def bad():
        raise RuntimeError("no such release")

    broken = str(tmp_path / "broken")
    spark.range(3).selectExpr("cast(id as string)").write.text(broken)
    readers = {
        "arrays": lambda: lead, "texts": lambda: lead.withColumn("genotype", F.array_join("genotype", "|")), "bad": bad, "gone": lambda: spark.read.parquet(str(tmp_path / "nowhere")),
        "odd": lambda: lead.select("weight"), "ids": lambda: lead.select("rsid", "genotype", F.col("weight").cast("int").alias("weight"), F.lit("x").alias("note")),
        "corrupt": lambda: spark.read.schema(lead.schema).option("pathGlobFilter", "*.txt").parquet(broken), "places": lambda: lead.withColumn("start", F.col("start").cast("string")),
    }
    to = str(tmp_path / "run")
    outcomes = R.annotate_run(calls, readers, to, 100, WHOLE, {"arrays": "weights"})
    found = counts(outcomes)
    assert found["arrays"] == found["texts"] == ("ok", None, 2, 1, 1)  # the call at 9 contradicts the lead's ref
    assert found["bad"][:2] == ("failed", "RuntimeError") and found["gone"][:2] == ("failed", "PATH_NOT_FOUND") and found["odd"][:2] == ("skipped", R.NO_KEY)
    assert found["corrupt"][0] == "failed" and found["corrupt"][1].startswith("FAILED_READ_FILE") and found["places"][:2] == ("failed", "TypeError")
    assert found["ids"] == ("ok", None, 2, 1, 0)
    rows = R.annotated_table(spark, to, outcomes, "texts")
    assert rows.columns == [*calls.columns, "rsid_texts", "ref_texts", "weight", "module", "genotype_evidence", "restored_flank_bp"]
    assert [(r["start"], r["sample"], r["rsid_texts"], r["genotype_evidence"], r["restored_flank_bp"]) for r in rows.orderBy("chrom", "start").collect()] == [(5, 1, "rs1", "called", None), (12, None, "rs3", "restored_hom_ref", 3), (7, 2, None, "called", None)]
    ids = R.annotated_table(spark, to, outcomes, "ids")
    assert "note" in ids.columns and "module" not in ids.columns and sorted((r["start"], r["weight"], r["note"]) for r in ids.collect() if r["weight"]) == [(5, 1.0, "x")]
    with pytest.raises(ValueError):
        R.annotated_table(spark, to, outcomes, "bad")
    assert json.loads(outcomes.filter("module = 'arrays'").first()["schema"])["type"] == "struct" and outcomes.filter("lead_table = 'weights'").count() == 1


def test_a_module_that_fails_while_it_is_written_stops_no_other(spark, calls, lead, tmp_path):
    late = lead.withColumn("note", F.when(F.col("weight") > 0, F.raise_error(F.lit("late"))).otherwise(F.lit("")).cast("string"))
    to = str(tmp_path / "run")
    outcomes = R.annotate_run(calls, {"first": lambda: lead, "late": lambda: late, "last": lambda: lead.filter("weight < 2")}, to, 100, WHOLE)
    found = counts(outcomes)
    assert found["first"] == ("ok", None, 2, 1, 1) and found["last"] == ("ok", None, 1, 1, 0) and found["late"][0] == "failed" and found["late"][2:] == (0, 0, 0)
    assert {r[R.BY]: r["count"] for r in spark.read.parquet(to).groupBy(R.BY).count().collect()} == {"first": 3, "last": 1}


def test_rows_are_restored_only_where_the_callset_allows_it(spark, calls, lead, tmp_path):
    assert R.context_of(calls, 100).scope == "targeted" and not R.context_of(calls, 100).restores
    assert R.context_of(calls, 100, least_sites=1).restores
    blocks = calls.withColumn("alt", F.lit("<NON_REF>"))
    assert R.context_of(blocks, 100, least_sites=1).mode == "all_sites" and not R.context_of(blocks, 100, least_sites=1).restores
    for n, context in enumerate((WHOLE._replace(scope="targeted"), WHOLE._replace(mode="all_sites"))):
        assert counts(R.annotate_run(calls, {"m": lambda: lead}, f"{tmp_path}/{n}", 100, context))["m"] == ("ok", None, 2, 1, 0)


def test_a_callset_without_rsids(spark, calls, lead, tmp_path):
    none = calls.withColumn("rsid", F.lit(None).cast("string"))
    assert not R.context_of(none, 100).has_rsid
    found = counts(R.annotate_run(none, {"ids": lambda: lead.select("rsid", "genotype"), "m": lambda: lead}, str(tmp_path / "run"), 100, WHOLE._replace(has_rsid=False)))
    assert found["ids"][:2] == ("failed", R.NO_RSID) and found["m"][0] == "ok"
    with pytest.raises(J.NoIdentifiers):
        J.annotate_by_rsid(none, lead, "m")


def test_a_run_that_writes_nothing(spark, calls, lead, tmp_path):
    to = str(tmp_path / "run")
    outcomes = R.annotate_run(calls, {"m": lambda: lead.filter("weight > 99")}, to, 100, WHOLE)
    assert R.annotated_table(spark, to, outcomes, "m").collect() == []
    assert counts(R.annotate_run(calls, {}, str(tmp_path / "none"), 100, WHOLE)) == {}


def test_a_locus_ambiguous_in_one_module_is_restored_in_another(spark, calls, lead, tmp_path):
    twice = lead.unionByName(lead.filter("start = 12").withColumns({"ref": F.lit("TT"), "genotype": F.array(F.lit("TT"), F.lit("TT"))}))
    found = counts(R.annotate_run(calls, {"clear": lambda: lead, "twice": lambda: twice}, str(tmp_path / "run"), 100, WHOLE))
    assert found["clear"][4] == 1 and found["twice"][4] == 0
