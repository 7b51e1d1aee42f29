"""Column functions against their cases."""

import pytest
from pyspark.sql import functions as F

from helixframe.functions import contigs as C
from helixframe.functions import genotypes as G
from helixframe.functions import literature as T


def values(spark, rows, schema, column):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"place int, {schema}")
    return [r["x"] for r in df.select("place", column.alias("x")).orderBy("place").collect()]


def test_genotype_from_gt(spark):
    rows = [("0/1", "A", "G"), ("1/1", "A", "G"), ("1/2", "A", "G|T"), ("./.", "A", "G"), ("1|0", "T", "C"), (None, "A", "G"), ("0/3", "A", "G"), ("1", "A", "G")]
    got = values(spark, rows, "gt string, ref string, alt string", G.genotype_from_gt(F.col("gt"), F.col("ref"), F.col("alt")))
    assert got[:6] == [["A", "G"], ["G", "G"], ["G", "T"], [], ["C", "T"], None]
    assert None in got[6] and got[7] == ["G"]


def test_authored_genotype_keeps_its_order(spark):
    rows = [("C/C",), ("A/G",), ("G|A",), ("T",), ("G/",), (None,)]
    assert values(spark, rows, "g string", G.authored_genotype(F.col("g"))) == [["C", "C"], ["A", "G"], ["G", "A"], ["T"], ["G"], None]


def test_contigs(spark):
    names = [("chrM",), ("M",), ("MT",), ("chr1",), ("1",), ("X",), ("chrUn_KI270302v1",), ("HLA-A*01",), ("chr23",)]
    assert values(spark, names, "c string", C.fold_contig(F.col("c"))) == ["MT", "MT", "MT", "1", "1", "X", "chrUn_KI270302v1", "HLA-A*01", "chr23"]
    assert values(spark, [(" CHR7 ",), ("  ",), (None,)], "c string", C.strip_any_chr(F.col("c"))) == ["7", None, None]
    assert values(spark, [("chrX",), ("2",)], "c string", C.with_chr(F.col("c"))) == ["chrX", "chr2"]


@pytest.mark.parametrize(("level", "rank"), [("1A", 6), ("1b", 5), (" 2A", 4), ("2B", 3), ("3", 2), ("4", 1), ("", 0), (None, 0)])
def test_evidence_rank(spark, level, rank):
    assert values(spark, [(level,)], "l string", G.evidence_rank(F.col("l"))) == [rank]


def test_zygosity_and_signs(spark):
    assert values(spark, [(["A", "A"],), (["A", "G"],), (["A"],), ([],), (None,)], "g array<string>", G.zygosity(F.col("g"))) == ["hom", "het", "", "", ""]
    rows = [("Protective ", "x", 0.0), (None, "significant", -1.0), ("", "risk", 2.0), (None, None, None)]
    direction = G.direction(F.col("d"), F.col("s"), F.col("w"))
    assert values(spark, rows, "d string, s string, w double", direction) == ["protective", "risk", "risk", "neutral"]
    assert values(spark, rows, "d string, s string, w double", G.variant_sign(F.col("w"), direction)) == [1, -1, 1, 0]


def test_two_letter_genotypes(spark):
    assert values(spark, [("ga",), ("A/G",), ("AGT",), ("",), ("A|-",)], "p string", G.slash_genotype(F.col("p"))) == ["A/G", "A/G", None, None, None]


def test_genotype_of_allele(spark):
    rows = [("G", "hom", "A", "G"), ("G", "het", "A", "G"), ("A", "Heterozygous", "A", "G|T"), ("-", "hom", "A", "G"), ("G", "?", "A", "G")]
    assert values(spark, rows, "a string, z string, ref string, alt string", G.genotype_of(F.col("a"), F.col("z"), F.col("ref"), F.col("alt"))) == ["G/G", "A/G", "A/G", None, None]


def test_weights_and_tiers(spark):
    assert values(spark, [("1,5",), (" 2.5 ",), ("x",), (None,)], "w string", G.parse_weight(F.col("w"))) == [1.5, 2.5, None, None]
    rows = [("Likely_Pathogenic", True, False, False), (None, True, True, True), (" ", False, True, True), (None, False, False, True), (None, None, None, None)]
    tier = G.clinical_tier(F.col("s"), F.col("p"), F.col("b"), F.col("c"))
    assert values(spark, rows, "s string, p boolean, b boolean, c boolean", tier) == ["likely_pathogenic", "pathogenic", "benign", "uncertain_significance", ""]
    assert values(spark, rows[:1], "s string, p boolean, b boolean, c boolean", G.tier_label(tier)) == ["Likely pathogenic"]


def test_article_ids(spark):
    rows = [("PMID 0123, PMID:456 and 99999",), ("12345; 678901, 12",), ("https://x.org/12345",), ("https://pubmed.ncbi.nlm.nih.gov/12345",), ("PMID 1234567890",), (None,)]
    assert values(spark, rows, "r string", T.article_ids(F.col("r"))) == [["123", "456"], ["12345", "678901"], [], ["12345"], ["1234567890"], None]
    assert values(spark, rows[4:5], "r string", T.accepted(T.article_ids(F.col("r")))) == [[]]


def test_trimmed(spark):
    rows = [("One. Two. Three.",), ("a" * 30,), ("many words in a row",), ("short",), (None,)]
    spaced = [("One.\n Two.  Three is long.",), ("  many   words  ",)]
    assert values(spark, spaced, "t string", T.trimmed(F.col("t"), 10)) == ["One. Two.", "many words"]
    assert values(spark, rows, "t string", T.trimmed(F.col("t"), 10)) == ["One. Two.", "a" * 10, "many words", "short", None]


def test_info_fields(spark):
    rows = [("CLNSIG=Benign;CLNSIG=Pathogenic/Low;GENEINFO=AB:1|CD:2;RS=12|3",), ("X=1",), (None,)]
    assert values(spark, rows, "i string", T.info_value(F.col("i"), "CLNSIG")) == ["Pathogenic/Low", None, None]
    assert values(spark, rows, "i string", T.genes_of(F.col("i"))) == [["AB", "CD"], None, None]
    assert values(spark, rows, "i string", T.has_pathogenic(T.info_value(F.col("i"), "CLNSIG"))) == [True, False, False]
    assert values(spark, rows, "i string", T.first_rs(F.col("i"))) == ["rs12", None, None]


def test_unscrambled(spark):
    word = "Привет"
    rows = [(word.encode().decode("cp1251"),), (word,), ("café",), (None,)]
    assert values(spark, rows, "t string", T.unscrambled(F.col("t"))) == [word, word, "café", None]


def test_allele_rejection(spark):
    rows = [("A", "G"), ("A", "A"), ("A", "N"), ("A", "C" * 51), (None, "A")]
    assert values(spark, rows, "r string, a string", G.allele_rejection(F.col("r"), F.col("a"))) == [None, "same_allele", "not_acgt", "too_long", "not_acgt"]
