"""Queries: annotation joins, lookups, resolution, unions and reference annotation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import contigs as C
from ..functions import genotypes as G
from ..functions import literature as T
from ..operators import aggregates as A
from ..operators import curate as U
from ..operators import filters as L
from ..operators import joins as J
from ..operators import runs as R
from ..sources import prepared, tables, vcf
from ..sources.scratch import scratch
from . import base as B
from .base import query
from .normalise import _HOM_LEAD, _hom_lead

_SHOWN = "sample, chrom, start, array_to_string(genotype, '/') AS genotype, weight"


def _shown(df):
    return df.select("sample", "chrom", "start", F.array_join("genotype", "/").alias("genotype"), "weight")


@query("jn_01", f"SELECT {_SHOWN} FROM v_annotated")
def jn_01(spark, d):
    return _shown(J.annotate_by_position(B.calls(spark, d), B.lead(spark, d), "core"))


_BY_RSID = "WITH k AS (SELECT *, unnest(string_split(rsid, ';')) AS rs FROM v_calls WHERE rsid IS NOT NULL), p AS (SELECT k.* FROM k WHERE EXISTS (SELECT 1 FROM v_lead l WHERE l.rsid = k.rs)), j AS (SELECT p.*, l.weight, l.module, l.state, l.gene, l.category FROM p LEFT JOIN v_lead l ON l.rsid = p.rs AND l.genotype = p.genotype) "


@query("jn_02", _BY_RSID + f"SELECT rsid, {_SHOWN} FROM j")
def jn_02(spark, d):
    df = J.annotate_by_rsid(B.calls(spark, d), B.lead(spark, d), "core")
    return df.select("rsid", "sample", "chrom", "start", F.array_join("genotype", "/").alias("genotype"), "weight")


@query("jn_03", "SELECT sample, count(*) AS n FROM v_probed GROUP BY sample")
def jn_03(spark, d):
    return J.at_positions(B.calls(spark, d), B.lead(spark, d)).groupBy("sample").agg(F.count("*").alias("n"))


@query("jn_04", _BY_RSID + "SELECT sample, count(*) AS n FROM p GROUP BY sample")
def jn_04(spark, d):
    keyed = B.calls(spark, d).withColumn("rs", F.explode_outer(F.split("rsid", ";")))
    wanted = B.lead(spark, d).select(F.col("rsid").alias("rs")).distinct()
    return keyed.join(wanted, "rs", "left_semi").groupBy("sample").agg(F.count("*").alias("n"))


@query("jn_05", "SELECT * FROM (VALUES ('placed', 'position', ''), ('unplaced', 'rsid', ''), ('no_genotype', 'unsupported', 'genotype')) t(kind, strategy, missing) WHERE EXISTS (SELECT 1 FROM v_lead)")
def jn_05(spark, d):
    lead = B.slim_lead(spark, d)
    kinds = {"placed": lead, "unplaced": lead.withColumns({"chrom": F.lit(None).cast("string"), "start": F.lit(None).cast("long")}), "no_genotype": lead.drop("genotype")}
    out = None
    for kind, df in kinds.items():
        one = J.join_strategy(df).withColumn("kind", F.lit(kind))
        out = one if out is None else out.unionByName(one)
    return out


_REF_JOIN = "SELECT c.sample, c.chrom, c.start, c.ref, c.alt, r.id, r.score FROM v_calls c LEFT JOIN v_reference r ON c.chrom = r.chrom AND c.start = r.start AND c.ref = r.ref AND c.alt = r.alt"


@query("jn_06", _REF_JOIN)
def jn_06(spark, d):
    """Against the reference as it was prepared: only the calls are shuffled."""
    return prepared.annotate(B.calls(spark, d), B.prepared_reference(spark, d)).select("sample", "chrom", "start", "ref", "alt", "id", "score")


@query("jn_07", _REF_JOIN)
def jn_07(spark, d):
    B.calls(spark, d).createOrReplaceTempView("calls_for_reference")
    B.reference(spark, d).createOrReplaceTempView("reference_variants")
    return spark.sql("""SELECT c.sample, c.chrom, c.start, c.ref, c.alt, r.id, r.score FROM calls_for_reference c
      LEFT JOIN reference_variants r ON c.chrom = r.chrom AND c.start = r.start AND c.ref = r.ref AND c.alt = r.alt""")


def _reference_folder(spark, d):
    """The reference as Parquet partitioned by chrom, in a new folder."""
    path = scratch(spark, "reference")
    B.reference(spark, d).write.partitionBy("chrom").option("compression", "zstd").parquet(path)
    return path


@query("src_07", "SELECT chrom, count(*) AS n, sum(score) AS score FROM v_reference GROUP BY chrom")
def src_07(spark, d):
    tables.reference_view(spark, _reference_folder(spark, d), "whole_reference")
    return spark.sql("SELECT CAST(chrom AS STRING) AS chrom, count(*) AS n, sum(score) AS score FROM whole_reference GROUP BY chrom")


@query("src_08", "SELECT r.chrom, count(*) AS n FROM v_reference r WHERE r.chrom IN (SELECT chrom FROM v_calls WHERE dp >= 40 AND contains(alt, '|') AND ref = 'A' AND sample = 3) GROUP BY r.chrom")
def src_08(spark, d):
    """The partitions that the calls need are found while the query runs, by pruning from the join; no contig comes to the driver."""
    needed = B.calls(spark, d).filter("dp >= 40 AND contains(alt, '|') AND ref = 'A' AND sample = 3")
    whole = tables.reference_view(spark, _reference_folder(spark, d), "needed_reference")
    return tables.only_needed(whole, needed).groupBy(F.col("chrom").cast("string").alias("chrom")).agg(F.count("*").alias("n"))


@query("src_09", "SELECT chrom, start, CAST(NULL AS VARCHAR) AS id FROM v_calls WHERE chrom = 'MT'")
def src_09(spark, d):
    other = B.reference(spark, d).filter("chrom = '1'")
    return J.annotate_by_reference(B.calls(spark, d).filter("chrom = 'MT'"), other).select("chrom", "start", "id")


@query("src_15", "SELECT chrom, start, ref, alt FROM v_reference WHERE score > 950")
def src_15(spark, d):
    return B.reference(spark, d).filter("score > 950").select("chrom", "start", "ref", "alt")


@query("jn_11", """WITH l AS (SELECT t.key, t.rsid, t.genotype AS authored, t.gene, t.category, t.weight FROM v_text t),
  a AS (SELECT rsid, authored, gene, category FROM l UNION ALL SELECT rsid, authored, concat(gene, 'x'), category FROM l WHERE key % 2 = 0 UNION ALL SELECT rsid, 'Z/Z', concat('a', gene), category FROM l WHERE key % 3 = 0),
  one AS (SELECT rsid, min(gene) AS gene, min(category) AS category FROM a GROUP BY rsid),
  g AS (SELECT l.*, CASE WHEN contains(authored, '|') THEN authored ELSE array_to_string(list_sort(string_split(authored, '/')), '/') END AS gkey FROM l)
  SELECT 'genotype' AS keying, g.key, g.weight, a.gene, a.category FROM g LEFT JOIN a ON g.rsid = a.rsid AND g.gkey = a.authored
  UNION ALL SELECT k.keying, l.key, l.weight, one.gene, one.category FROM l LEFT JOIN one USING (rsid), (VALUES ('variant_key'), ('rsid')) k(keying)""")
def jn_11(spark, d):
    """Annotations by each of the three keyings, which their columns decide."""
    text = B.lead_text(spark, d)
    notes = text.select("key", F.col("rsid").alias("variant_key"), "rsid", "genotype", "gene", "category")
    notes = notes.unionByName(notes.filter("key % 2 = 0").withColumn("gene", F.concat("gene", F.lit("x")))).unionByName(notes.filter("key % 3 = 0").withColumns({"gene": F.concat(F.lit("a"), "gene"), "genotype": F.lit("Z/Z")})).drop("key")
    weights = text.select("key", F.col("rsid").alias("variant_key"), "rsid", G.authored_genotype(F.col("genotype")).alias("genotype"), F.col("genotype").contains("|").alias("phased"), "weight")
    ways = [(weights, notes), (weights, notes.drop("genotype")), (weights.drop("variant_key"), notes)]
    shown = [J.with_annotations(w, a).select(F.lit(J.annotations_keying(w, a)).alias("keying"), "key", "weight", "gene", "category") for w, a in ways]
    return shown[0].unionByName(shown[1]).unionByName(shown[2])


_WIDE = "WITH s AS (SELECT DISTINCT chrom, start, ref, alt FROM v_calls), m AS (SELECT chrom, start, ref, alt, min(score) AS score FROM v_reference WHERE score < 1200 GROUP BY ALL), n AS (SELECT chrom, start, ref, alt, min(id) AS id FROM v_reference GROUP BY ALL) SELECT s.*, m.score AS m_score, n.id AS n_id FROM s LEFT JOIN m USING (chrom, start, ref, alt) LEFT JOIN n USING (chrom, start, ref, alt)"


@query("jn_12", _WIDE)
def jn_12(spark, d):
    ref, on = B.reference(spark, d), ["chrom", "start", "ref", "alt"]
    return J.wide_export(B.calls(spark, d).select(*on).distinct(), {"m": ref.filter("score < 1200").select(*on, "score"), "n": ref.select(*on, "id")}, on)


@query("jn_13", "WITH k AS (SELECT *, coalesce(rsid, concat(chrom, ':', start, ':', ref)) AS study_key FROM v_studies), w AS (SELECT rsid AS study_key FROM v_lead UNION SELECT concat(chrom, ':', start, ':', ref) FROM v_lead) SELECT study_key, count(*) AS n_studies, array_to_string(list_sort(list(DISTINCT pmid)), ',') AS pmids FROM k WHERE study_key IN (SELECT study_key FROM w) GROUP BY study_key")
def jn_13(spark, d):
    place = F.concat_ws(":", "chrom", "start", "ref")
    lead = B.lead(spark, d)
    wanted = lead.select(F.col("rsid").alias("study_key")).unionByName(lead.select(place.alias("study_key")))
    keyed = B.studies(spark, d).withColumn("study_key", G.study_key(F.col("rsid"), F.col("chrom"), F.col("start"), F.col("ref")))
    return J.studies_of(wanted, keyed)


_AUTHORED = "a AS (SELECT key, CASE WHEN key % 2 = 0 THEN rsid END AS rsid, CASE WHEN key % 2 = 1 THEN chrom END AS chrom, CASE WHEN key % 2 = 1 THEN start END AS start FROM v_lead UNION ALL SELECT -1, 'rs999999999', NULL, NULL)"


def _authored(spark, d):
    even = F.col("key") % 2 == 0
    rows = B.lead(spark, d).select("key", F.when(even, F.col("rsid")).alias("rsid"), F.when(~even, F.col("chrom")).alias("chrom"), F.when(~even, F.col("start")).alias("start"))
    return rows.unionByName(spark.createDataFrame([(-1, "rs999999999", None, None)], rows.schema))


@query("jn_14", f"WITH {_AUTHORED} SELECT key, concat('rs', CASE WHEN key < 0 THEN 999999999 ELSE key END) AS rsid, CASE WHEN key >= 0 THEN {B._CONTIG.format('key', 'MT')} END AS chrom, CASE WHEN key >= 0 THEN key * 97 + 1 END AS start, key >= 0 AS resolved FROM a")
def jn_14(spark, d):
    return J.resolve(_authored(spark, d), B.reference(spark, d)).select("key", "rsid", "chrom", "start", "resolved")


@query("jn_15", "SELECT r.id, r.ref, r.alt FROM v_reference r WHERE r.id IN (SELECT rsid FROM v_lead WHERE weight > 1)")
def jn_15(spark, d):
    wanted = B.lead(spark, d).filter("weight > 1").select(F.col("rsid").alias("id")).distinct()
    return J.first_per_key(B.reference(spark, d).join(wanted, "id", "left_semi"), ["id"], "ref", "alt").select("id", "ref", "alt")


_FAN = "WITH r AS (SELECT id AS variant_key, chrom, start, ref FROM v_reference UNION ALL SELECT id, chrom, start + 50, ref FROM v_reference WHERE CAST(substr(id, 3) AS BIGINT) % 5 = 0) SELECT l.key, r.chrom, r.start, row_number() OVER (PARTITION BY l.key ORDER BY r.chrom, r.start, r.ref) - 1 AS locus_index, count(*) OVER (PARTITION BY l.key) AS locus_count FROM v_lead l LEFT JOIN r ON r.variant_key = l.rsid"


def _fan(spark, d):
    ref = B.reference(spark, d).select(F.col("id").alias("variant_key"), "chrom", "start", "ref")
    both = ref.unionByName(ref.filter(F.substr("variant_key", F.lit(3)).cast("bigint") % 5 == 0).withColumn("start", F.col("start") + 50))
    authored = B.lead(spark, d).select(F.col("key").alias("row_id"), F.col("rsid").alias("variant_key"))
    return J.fan_out(authored, both).select(F.col("row_id").alias("key"), "chrom", "start", "locus_index", "locus_count")


@query("jn_16", _FAN)
def jn_16(spark, d):
    return _fan(spark, d)


@query("wn_08", _FAN)
def wn_08(spark, d):
    return _fan(spark, d)


@query("jn_17", "SELECT s.rsid, s.pmid FROM v_studies s WHERE s.rsid IN (SELECT rsid FROM v_lead)")
def jn_17(spark, d):
    return B.studies(spark, d).join(B.lead(spark, d).select("rsid").distinct(), "rsid").select("rsid", "pmid")


_PANEL = "(SELECT 'BRAND#2' AS gene UNION ALL SELECT 'BRAND#7' UNION ALL SELECT 'PROMO')"


def _panel(spark):
    return spark.createDataFrame([("Brand#2",), ("brand#7",), ("PROMO",)], "gene string")


@query("jn_18", "SELECT record_id, CASE WHEN upper(p_brand) IN ('BRAND#2', 'BRAND#7') THEN upper(p_brand) ELSE upper(p_type) END AS hit FROM v_clinvar WHERE upper(p_brand) IN ('BRAND#2', 'BRAND#7') OR upper(p_type) = 'PROMO'")
def jn_18(spark, d):
    records = B.clinvar(spark, d).select("record_id", T.genes_of(F.col("info")).alias("genes"))
    return J.members_of_panel(records, _panel(spark)).select("record_id", "hit")


@query("jn_19", "SELECT s_suppkey, n_name, r_name FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey")
def jn_19(spark, d):
    nation, region = B.table(spark, d, "nation"), B.table(spark, d, "region")
    supplier = B.table(spark, d, "supplier")
    return supplier.join(nation, supplier["s_nationkey"] == nation["n_nationkey"], "left").join(region, F.col("n_regionkey") == F.col("r_regionkey"), "left").select("s_suppkey", "n_name", "r_name")


@query("jn_20", "SELECT key, CASE WHEN key % 2 = 0 THEN concat('slashed ', category) WHEN key % 3 = 0 THEN concat('bare ', category) END AS text FROM v_text")
def jn_20(spark, d):
    """Text by (id, genotype), and where that has none by the genotype without its separator."""
    rows = B.lead_text(spark, d).select("key", "genotype", "category")
    bare = F.regexp_replace("genotype", "[/|]", "")
    first = rows.filter("key % 2 = 0").select("key", "genotype", F.concat(F.lit("slashed "), "category").alias("a"))
    second = rows.filter("key % 3 = 0").select("key", bare.alias("bare"), F.concat(F.lit("bare "), "category").alias("b"))
    joined = rows.withColumn("bare", bare).join(J.first_per_key(first, ["key", "genotype"], "a"), ["key", "genotype"], "left").join(J.first_per_key(second, ["key", "bare"], "b"), ["key", "bare"], "left")
    return joined.select("key", F.coalesce("a", "b").alias("text"))


@query("jn_21", "SELECT count(*) AS matched, (SELECT count(*) FROM v_lead) AS total, round(CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM v_lead), 6) AS rate FROM v_lead l JOIN v_reference r ON l.rsid = r.id AND l.ref = r.ref")
def jn_21(spark, d):
    lead = B.lead(spark, d)
    found = lead.join(B.reference(spark, d).select(F.col("id").alias("rsid"), "ref", F.lit(True).alias("hit")), ["rsid", "ref"], "left")
    return found.agg(F.count("hit").alias("matched"), F.count("*").alias("total")).withColumn("rate", F.round(F.col("matched") / F.col("total"), 6))


@query("jn_22", "SELECT c.sample, c.start, l.weight FROM v_calls c JOIN v_lead l ON c.rsid = l.rsid WHERE l.gene = 'Brand#3' AND l.state = 'risk'")
def jn_22(spark, d):
    """The calls of a small list: the risks of one gene."""
    few = B.lead(spark, d).filter("gene = 'Brand#3' AND state = 'risk'").select("rsid", "weight")
    return B.calls(spark, d).join(few, "rsid").select("sample", "start", "weight")


_SYMBOLS = "SELECT DISTINCT p_brand AS gene FROM part UNION SELECT 'MT-ND1' UNION SELECT 'old2' UNION SELECT 'nowhere' UNION SELECT 'typo'"


@query("jn_26", f"WITH g AS ({_SYMBOLS}), m AS (SELECT gene, CASE gene WHEN 'typo' THEN 'Brand#9' WHEN 'old2' THEN 'Brand#2' ELSE gene END AS symbol FROM g) SELECT gene, symbol, gene <> symbol AS changed, gene = 'nowhere' AS unresolved FROM m")
def jn_26(spark, d):
    official = B.table(spark, d, "part").select(F.col("p_brand").alias("symbol")).distinct()
    genes = official.select(F.col("symbol").alias("gene")).unionByName(spark.createDataFrame([("MT-ND1",), ("old2",), ("nowhere",), ("typo",)], "gene string"))
    curated = spark.createDataFrame([("typo", "Brand#9")], "gene string, symbol string")
    synonyms = official.select(F.concat(F.lit("old"), F.regexp_extract("symbol", "([0-9]+)", 1)).alias("synonym"), "symbol")
    return J.reconciled(genes, curated, official, synonyms)


@query("src_14", "SELECT concat('old', p_size % 10) AS synonym, arg_min(p_brand, (p_partkey, p_brand)) AS symbol FROM part GROUP BY 1")
def src_14(spark, d):
    rows = B.table(spark, d, "part").select(F.col("p_brand").alias("symbol"), F.col("p_partkey").alias("line"), F.concat(F.lit("old"), (F.col("p_size") % 10).cast("string"), F.lit("|-|")).alias("synonyms"))
    return tables.symbol_map(rows)


@query("jn_27", "SELECT record_id, CASE WHEN record_id % 5 = 0 THEN concat(chrom, ':', start, ':', ref, ':', alt) ELSE concat('rs', record_id) END AS identity FROM v_clinvar")
def jn_27(spark, d):
    """Records by identity: the rsID but where several places share it, then the whole coordinate."""
    records = B.clinvar(spark, d).withColumn("rsid", T.first_rs(F.col("info")))
    shared = records.select("rsid", "chrom", "start", "ref", "alt").unionByName(records.filter("record_id % 5 = 0").select("rsid", "chrom", (F.col("start") + 7).alias("start"), "ref", "alt"))
    clear = A.ambiguous_rsids_cleared(shared).select("chrom", "start", "ref", "alt", F.coalesce("rsid", F.concat_ws(":", "chrom", "start", "ref", "alt")).alias("identity"))
    index = J.first_per_key(clear, ["chrom", "start", "ref", "alt"], "identity")
    return records.join(index, ["chrom", "start", "ref", "alt"], "left").select("record_id", "identity")


@query("ag_19", "SELECT record_id, CASE WHEN record_id % 5 <> 0 THEN concat('rs', record_id) END AS rsid FROM v_clinvar")
def ag_19(spark, d):
    records = B.clinvar(spark, d).select("record_id", T.first_rs(F.col("info")).alias("rsid"), "chrom", "start")
    shared = records.unionByName(records.filter("record_id % 5 = 0").select(F.lit(None).cast("long").alias("record_id"), "rsid", "chrom", (F.col("start") + 7).alias("start")))
    return A.ambiguous_rsids_cleared(shared).filter("record_id IS NOT NULL").select("record_id", "rsid")


@query("ag_18", "SELECT concat('rs', p_partkey % 100) AS rsid, count(DISTINCT p_partkey) AS places, count(DISTINCT p_partkey) - 1 AS lost FROM part GROUP BY 1 HAVING count(DISTINCT p_partkey) > 1 AND concat('rs', min(p_partkey % 100)) <> 'rs7'")
def ag_18(spark, d):
    ref = B.reference(spark, d).withColumn("n", F.substr("id", F.lit(3)).cast("bigint"))
    records = ref.select(F.concat(F.lit("rs"), (F.col("n") % 100).cast("string")).alias("rsid"), "chrom", "start", "ref", "alt")
    extra = ref.filter("n = 7").select(F.lit("rs7").alias("rsid"), "chrom", "start", "ref", F.lit("GGG").alias("alt"))
    return A.collapsed_identities(records.unionByName(extra))


@query("ag_01", "SELECT count(*) AS written, count(module) AS matched FROM v_annotated")
def ag_01(spark, d):
    return A.written_and_matched(J.annotate_by_position(B.calls(spark, d), B.lead(spark, d), "core"))


_UNION = _HOM_LEAD + f""", called AS (SELECT DISTINCT chrom, start FROM v_calls), absent AS (SELECT DISTINCT chrom, start, ref FROM fit f WHERE NOT EXISTS (SELECT 1 FROM called c WHERE c.chrom = f.chrom AND c.start = f.start)),
  far AS (SELECT a.chrom, a.start, a.ref, min(abs(a.start - c.start)) AS flank FROM absent a JOIN called c ON a.chrom = c.chrom GROUP BY ALL),
  both_ AS (SELECT chrom, start, ref, sample, 'called' AS genotype_evidence, CAST(NULL AS BIGINT) AS restored_flank_bp FROM v_annotated UNION ALL SELECT chrom, start, ref, NULL, 'restored_hom_ref', flank FROM far WHERE flank <= {B.FLANK}) """


def _union(spark, d):
    calls = B.calls(spark, d)
    called = J.annotate_by_position(calls, B.lead(spark, d), "core").select("chrom", "start", "ref", "sample", "genotype_evidence")
    sites = tables.write_table(calls.select("chrom", "start").distinct(), scratch(spark, "sites"))  # three joins read them
    found = L.restored(_hom_lead(spark, d), sites, B.FLANK).select("chrom", "start", "ref", "restored_flank_bp").distinct()
    return called.unionByName(found.withColumn("genotype_evidence", F.lit("restored_hom_ref")), allowMissingColumns=True)


@query("st_01", _UNION + "SELECT * FROM both_")
def st_01(spark, d):
    return _union(spark, d)


@query("st_02", _UNION + "SELECT chrom, start, ref, restored_flank_bp FROM both_ WHERE genotype_evidence = 'restored_hom_ref'")
def st_02(spark, d):
    return _union(spark, d).filter("genotype_evidence = 'restored_hom_ref'").select("chrom", "start", "ref", "restored_flank_bp")


@query("ag_08", _UNION + "SELECT genotype_evidence, count(*) AS n, max(restored_flank_bp) AS farthest FROM both_ GROUP BY ALL")
def ag_08(spark, d):
    return _union(spark, d).groupBy("genotype_evidence").agg(F.count("*").alias("n"), F.max("restored_flank_bp").alias("farthest"))


@query("st_03", "SELECT DISTINCT rsid FROM v_lead WHERE weight <= 0 AND rsid NOT IN (SELECT rsid FROM v_lead WHERE weight > 0)")
def st_03(spark, d):
    lead = B.lead(spark, d)
    return U.vanished(lead, lead.filter("weight > 0"))


@query("st_04", "SELECT count(*) AS common FROM (SELECT rsid FROM v_lead INTERSECT SELECT rsid FROM v_studies)")
def st_04(spark, d):
    return B.lead(spark, d).select("rsid").intersect(B.studies(spark, d).select("rsid")).agg(F.count("*").alias("common"))


_OUTCOMES = f"""WITH {B.ENABLED}, c AS (SELECT count(*) AS written, count(module) AS matched FROM v_annotated), """ + _BY_RSID[5:].rstrip() + f""", r AS (SELECT count(*) AS written, count(module) AS matched FROM j),
  few AS (SELECT count(*) AS written, count(l.chrom) AS matched FROM v_calls c LEFT JOIN (SELECT * FROM v_lead WHERE state = 'risk') l ON c.chrom = l.chrom AND c.start = l.start AND c.genotype = l.genotype
    WHERE (l.ref IS NULL OR l.ref = c.ref) AND EXISTS (SELECT 1 FROM v_lead p WHERE p.state = 'risk' AND p.chrom = c.chrom AND p.start = c.start)),
  hom_ref AS (SELECT * FROM v_lead WHERE len(genotype) > 0 AND len(list_filter(genotype, lambda g: g <> ref)) = 0 AND (SELECT enabled FROM facts)),
  restored AS (SELECT h.key, h.state, h.chrom, h.start, min(abs(h.start - c.start)) AS flank FROM hom_ref h JOIN (SELECT DISTINCT chrom, start FROM v_calls) c ON h.chrom = c.chrom GROUP BY ALL HAVING min(abs(h.start - c.start)) BETWEEN 1 AND {B.FLANK}),
  n AS (SELECT count(*) AS every, count(*) FILTER (state = 'risk') AS risks FROM restored),
  o AS (SELECT 'core' AS module, 'position' AS strategy, 'ok' AS kind, NULL AS reason, written, matched, every AS restored FROM c, n UNION ALL SELECT 'typed', 'position', 'ok', NULL, written, matched, every FROM c, n
    UNION ALL SELECT 'risks', 'position', 'ok', NULL, written, matched, risks FROM few, n
    UNION ALL SELECT 'ids', 'rsid', 'ok', NULL, written, matched, 0 FROM r UNION ALL SELECT 'diplotypes', 'unsupported', 'skipped', 'no way to join', 0, 0, 0
    UNION ALL SELECT 'lost', NULL, 'failed', 'PATH_NOT_FOUND', 0, 0, 0 UNION ALL SELECT 'broken', NULL, 'failed', 'ValueError', 0, 0, 0
    UNION ALL SELECT 'numbered', NULL, 'failed', 'TypeError', 0, 0, 0 UNION ALL SELECT 'corrupt', NULL, 'failed', 'FAILED_READ_FILE.NO_HINT', 0, 0, 0) """


def _run(spark, d):
    """A run over nine modules: three by position, one of them with genotypes as text, one by rsID, one without a way to join; tables that are missing, that raise, with keys
    of the wrong kind, and of files that aren't Parquet. Returns the folder and the outcomes."""
    lead = B.lead(spark, d)

    def broken():
        raise ValueError("not a table")

    def corrupt():
        path = scratch(spark, "corrupt")
        B.table(spark, d, "nation").select("n_name").write.text(path)
        return spark.read.schema(lead.schema).option("pathGlobFilter", "*.txt").parquet(path)

    readers = {
        "core": lambda: lead, "typed": lambda: B.lead_text(spark, d), "risks": lambda: lead.filter("state = 'risk'"),
        "ids": lambda: lead.withColumns({"chrom": F.lit(None).cast("string"), "start": F.lit(None).cast("long")}),
        "diplotypes": lambda: lead.select("module", "gene"), "lost": lambda: tables.module_table(spark, scratch(spark, "missing")), "broken": broken,
        "numbered": lambda: lead.withColumn("genotype", F.lit(1)), "corrupt": corrupt,
    }
    calls, to = tables.write_table(B.calls(spark, d), scratch(spark, "calls")), scratch(spark, "run")  # a run reads its callset many times
    return to, R.annotate_run(calls, readers, to, B.FLANK, R.context_of(calls, B.FLANK, B.RUN_SITES))


def manifest(spark, d):
    """The run's outcomes written as JSON and read back."""
    return tables.manifest(_run(spark, d)[1], scratch(spark, "manifest"))


@query("mart_01", _OUTCOMES + " SELECT o.*, written + restored AS stored FROM o")
def mart_01(spark, d):
    """All modules by the strategy that fits each, written as one annotated table a module; what can't be is recorded and stops no other. stored: rows read back from each one's table."""
    to, outcomes = _run(spark, d)
    stored = spark.read.parquet(to).groupBy(F.col(R.BY).alias("module")).agg(F.count("*").alias("stored"))
    shown = outcomes.select("module", "strategy", "kind", "reason", "written", "matched", "restored").join(stored, "module", "left")
    return shown.withColumn("stored", F.coalesce("stored", F.lit(0)))


@query("mart_01_table", _OUTCOMES + """SELECT sample, 'called' AS genotype_evidence, count(*) AS n, count(module) AS matched, round(sum(weight), 3) + CAST(0 AS DOUBLE) AS weight, count(rsid_core) AS named, CAST(NULL AS BIGINT) AS farthest FROM v_annotated GROUP BY sample
  UNION ALL SELECT NULL, 'restored_hom_ref', count(*), count(*), (SELECT round(sum(l.weight), 3) + CAST(0 AS DOUBLE) FROM v_lead l JOIN restored x ON l.key = x.key), count(*), max(flank) FROM restored HAVING count(*) > 0""")
def mart_01_table(spark, d):
    """One module's annotated table of the run: called rows by sample, and restored ones. A sum that rounds to zero has no sign."""
    to, outcomes = _run(spark, d)
    rows = R.annotated_table(spark, to, outcomes, "typed")
    return rows.groupBy("sample", "genotype_evidence").agg(
        F.count("*").alias("n"), F.count("module").alias("matched"), (F.round(F.sum("weight"), 3) + F.lit(0.0)).alias("weight"), F.count("rsid_typed").alias("named"), F.max("restored_flank_bp").alias("farthest")
    )


@query("snk_07", _OUTCOMES + "SELECT module, kind, written, matched, restored FROM o")
def snk_07(spark, d):
    return manifest(spark, d).select("module", "kind", "written", "matched", "restored")


@query("ag_15", _OUTCOMES + "SELECT module, kind, reason, substr(md5(concat_ws(':', module, kind, reason)), 1, 12) AS digest FROM o WHERE kind <> 'ok'")
def ag_15(spark, d):
    """The modules of a run that gave nothing, from its manifest."""
    digest = F.substring(F.md5(F.concat_ws(":", "module", "kind", "reason")), 1, 12)
    return manifest(spark, d).filter("kind <> 'ok'").select("module", "kind", "reason", digest.alias("digest"))


@query("ag_25", _OUTCOMES + "SELECT module, CAST(written AS BIGINT) AS written, CAST(matched AS BIGINT) AS matched, CAST(restored AS BIGINT) AS restored FROM o WHERE kind = 'ok'")
def ag_25(spark, d):
    """Totals of a run by module: rows written, matched and restored."""
    return manifest(spark, d).filter("kind = 'ok'").groupBy("module").agg(*[F.sum(c).alias(c) for c in ("written", "matched", "restored")])


@query("mart_04", "SELECT r.chrom, count(*) AS calls, count(x.id) AS found FROM v_calls r LEFT JOIN v_reference x ON r.chrom = x.chrom AND r.start = x.start AND r.ref = x.ref AND r.alt = x.alt GROUP BY r.chrom")
def mart_04(spark, d):
    """Calls whose contigs are spelled otherwise than the reference's, brought to its spelling, joined with the prepared reference and written; counted from what was written."""
    calls = B.calls(spark, d).withColumn("chrom", F.concat(F.lit("chr"), "chrom"))
    done = tables.write_table(prepared.annotate(C.harmonise(calls, B.reference(spark, d)).drop("chrom_action"), B.prepared_reference(spark, d)), scratch(spark, "referenced"))
    return done.groupBy("chrom").agg(F.count("*").alias("calls"), F.count("id").alias("found"))


@query("mart_05", _WIDE.replace("WITH s AS (SELECT DISTINCT chrom, start, ref, alt FROM v_calls)", "WITH s AS (SELECT sample, chrom, start, ref, alt FROM v_calls)").replace("SELECT s.*,", ", w AS (SELECT s.*,") .replace("GROUP BY ALL) , w", "GROUP BY ALL), w") + ") SELECT sample, count(*) AS n, CAST(sum(start) AS BIGINT) AS places, count(n_id) AS named, count(m_score) AS scored, round(sum(m_score), 2) AS score FROM w GROUP BY sample")
def mart_05(spark, d):
    """Every sample's calls with all modules' columns, exported as VCF text in a folder of its own and read back."""
    ref, on = B.reference(spark, d), ["chrom", "start", "ref", "alt"]
    wide = J.wide_export(B.calls(spark, d).select("sample", *on), {"m": ref.filter("score < 1200").select(*on, "score"), "n": ref.select(*on, "id")}, on)
    path = scratch(spark, "sample-exports")
    vcf.write_sample_vcfs(wide, path)
    back = vcf.read_vcf(spark, path, {"m_score": "double", "n_id": "string"}, {}, keep=["sample"])
    return back.groupBy(F.col("sample").cast("long").alias("sample")).agg(
        F.count("*").alias("n"), F.sum("start").alias("places"), F.count("n_id").alias("named"), F.count("m_score").alias("scored"), F.round(F.sum("m_score"), 2).alias("score")
    )
