"""Building curated tables: corrections, checks, pruning, expansion, resolution and release comparison."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.genotypes import alt_alleles, authored_genotype, blank_to_null, state_of
from ..functions.literature import accepted, article_ids
from .aggregates import alleles_by_rsid
from .joins import first_per_key, resolve

Correction = tuple[str, str, str, str]
#: Columns of corrections as a table: n is their order, other a genotype (or whatever the second key is) or '*'.
CORRECTIONS = "n int, rsid string, other string, field string, new_value string"


def reached(corrections: Sequence[Correction]) -> dict[str, set[str]]:
    """By rsID, the rsIDs under which its corrections may find a row: its own, and those that corrections of the rsID lead to."""
    moves: dict[str, set[str]] = {}
    for rsid, _, field, value in corrections:
        if field == "rsid":
            moves.setdefault(rsid, set()).add(value)
    found = {}
    for start in {c[0] for c in corrections}:
        seen, todo = {start}, [start]
        while todo:
            more = moves.get(todo.pop(), set()) - seen
            seen |= more
            todo += more
        found[start] = seen
    return found


def correction_table(spark: SparkSession, corrections: Sequence[Correction]) -> DataFrame:
    """The corrections that rows of each rsID (of) may meet, in their order."""
    by_rsid: dict[str, list[tuple]] = {}
    for n, c in enumerate(corrections):
        by_rsid.setdefault(c[0], []).append((n, *c))
    rows = [(of, *c) for of, seen in reached(corrections).items() for rsid in seen for c in by_rsid.get(rsid, [])]
    return spark.createDataFrame(rows, f"of string, {CORRECTIONS}")


def apply_corrections(rows: DataFrame, corrections: Sequence[Correction] | DataFrame, second: str = "genotype") -> DataFrame:
    """rows after corrections (rsid, genotype or '*', field, new value) in their order, each seeing what earlier ones made.

    A field 'drop' takes the row out and ends its corrections; a new weight also sets state by its sign, which a later
    correction of state overrides. hits holds the numbers of the corrections that matched. The corrections of an rsID are one ordered list, joined to
    its rows and folded there, so that the plan is the same for any number of them. As a table (CORRECTIONS) they are looked up by the rsID that a row comes with.
    """
    spark, kinds = rows.sparkSession, dict(rows.dtypes)
    listed = not isinstance(corrections, DataFrame)
    table = correction_table(spark, corrections) if listed else corrections.withColumn("of", F.col("rsid"))
    named = {c[2] for c in corrections} - {"drop"} if listed else set(rows.columns)
    if unknown := named - set(rows.columns):
        raise ValueError(f"corrections of unknown columns: {', '.join(sorted(unknown))}")
    fields = [c for c in rows.columns if c in named | {"rsid", second} or c == "state" and "weight" in named]
    nested = table.groupBy(F.col("of").alias("__of")).agg(F.array_sort(F.collect_list(F.struct("n", "rsid", "other", "field", "new_value"))).alias("__todo"))
    none = F.lit(None).cast("array<int>")

    def merge(now: Column, c: Column) -> Column:
        match = ~now["gone"] & now["rsid"].eqNullSafe(c["rsid"]) & ((c["other"] == "*") | (F.coalesce(now[second].cast("string"), F.lit("")) == c["other"]))
        made = []
        for f in fields:
            value = F.when(match & (c["field"] == f), c["new_value"].cast(kinds[f]))
            if f == "state" and "weight" in fields:
                value = value.when(match & (c["field"] == "weight"), state_of(c["new_value"].cast(kinds["weight"])))
            made.append(value.otherwise(now[f]).alias(f))
        hits = F.when(match, F.concat(F.coalesce(now["hits"], F.array().cast("array<int>")), F.array(c["n"]))).otherwise(now["hits"])
        return F.struct(*made, (now["gone"] | (match & (c["field"] == "drop"))).alias("gone"), hits.alias("hits"))

    begin = F.struct(*[F.col(f) for f in fields], F.lit(False).alias("gone"), none.alias("hits"))
    joined = rows.join(nested, F.col("rsid") == F.col("__of"), "left")
    folded = joined.withColumn("__now", F.when(F.col("__todo").isNull(), begin).otherwise(F.aggregate("__todo", begin, merge)))
    shown = [F.col("__now").getField(c).alias(c) if c in fields else F.col(c) for c in rows.columns]
    return folded.select(*shown, F.col("__now.gone").alias("__gone"), F.coalesce("__now.hits", F.array().cast("array<int>")).alias("hits"))


def corrected(rows: DataFrame, corrections: Sequence[Correction] | DataFrame, second: str = "genotype") -> DataFrame:
    return apply_corrections(rows, corrections, second).filter("NOT __gone").drop("__gone", "hits")


def unmatched_corrections(rows: DataFrame, corrections: Sequence[Correction] | DataFrame, second: str = "genotype") -> DataFrame:
    """The corrections that no row met."""
    known = corrections if isinstance(corrections, DataFrame) else rows.sparkSession.createDataFrame([(n, *c) for n, c in enumerate(corrections)], CORRECTIONS)
    hit = apply_corrections(rows, corrections, second).select(F.explode("hits").alias("n")).distinct()
    return known.join(hit, "n", "left_anti").drop("n").withColumnRenamed("other", second)


def without_duplicates(rows: DataFrame, keys: Sequence[str], *order: str) -> DataFrame:
    """First row a key, with duplicates: how many others it had."""
    over = Window.partitionBy(*keys)
    ranked = rows.withColumns({"__n": F.row_number().over(over.orderBy(*order)), "duplicates": F.count("*").over(over) - 1})
    return ranked.filter("__n = 1").drop("__n")


def capped(citations: DataFrame, most: int) -> DataFrame:
    """(variant, kept, dropped): at most most article numbers of a variant, by number text; ids of other than 1 to 8 digits count apart; a cap of 0 keeps one."""
    sound = citations.withColumn("sound", F.col("pmid").rlike("^[0-9]{1,8}$"))
    order = F.row_number().over(Window.partitionBy("variant", "sound").orderBy("pmid"))
    ranked = sound.withColumn("n", order)
    keep = F.col("sound") & (F.col("n") <= max(1, most))
    return ranked.groupBy("variant").agg(
        F.array_join(F.array_sort(F.collect_list(F.when(keep, F.col("pmid")))), ",").alias("kept"), F.count_if(F.col("sound") & ~keep).alias("dropped"), F.count_if(~F.col("sound")).alias("unsound")
    )


def merged_studies(sources: Sequence[DataFrame]) -> DataFrame:
    """Studies (variant_key, pmid) of several sources; the first source that has one wins."""
    every = reduce(DataFrame.unionByName, [s.withColumn("priority", F.lit(i)) for i, s in enumerate(sources)])
    return first_per_key(every, ["variant_key", "pmid"], "priority", "conclusion")


def fill_genotypes(rows: DataFrame) -> DataFrame:
    """Placeholder rows (blank genotype) as het and hom rows of ref and alt on diploid contigs; others as they are."""
    able = (F.trim(F.coalesce("genotype", F.lit(""))) == "") & F.col("ref").isNotNull() & F.col("alt").isNotNull() & ~F.col("chrom").isin("Y", "MT")
    made = F.array(F.array_join(F.array_sort(F.array("ref", "alt")), "/"), F.concat_ws("/", "alt", "alt"))
    return rows.withColumn("genotype", F.explode(F.when(able, made).otherwise(F.array("genotype"))))


def prune(rows: DataFrame, resolution: DataFrame) -> DataFrame:
    """rows with fate: kept, impossible (an allele that its locus doesn't have) or unplaced (kept, but no locus is known)."""
    parts = F.split("genotype", "/")
    joined = rows.join(alleles_by_rsid(resolution), "rsid", "left")
    fate = F.when(F.col("alleles").isNull(), "unplaced").when(F.size(F.array_except(parts, "alleles")) == 0, "kept").otherwise("impossible")
    return joined.withColumn("fate", fate).drop("alleles")


def without_orphans(studies: DataFrame, rows: DataFrame) -> DataFrame:
    """Studies that name no variant, or one that rows still have."""
    blank = blank_to_null(F.col("rsid")).isNull()
    return studies.filter(blank).unionByName(studies.filter(~blank).join(rows.select("rsid").distinct(), "rsid", "left_semi").select(*studies.columns))


def vanished(before: DataFrame, after: DataFrame, key: str = "rsid") -> DataFrame:
    return before.select(key).distinct().join(after.select(key).distinct(), key, "left_anti")


#: The states a row may have.
STATES = ["risk", "protective", "neutral", "significant", "alt", "ref"]


def problems(variants: DataFrame, studies: DataFrame) -> DataFrame:
    """(rule, severity, key) of every breach, of all rules at once. variants: rsid, chrom, start, genotype, weight, state as text; studies: rsid, pmid."""
    key = F.coalesce(blank_to_null(F.col("rsid")), F.concat_ws(":", "chrom", "start"))
    blank = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
    weight = F.col("weight").try_cast("double")
    parts = F.split("genotype", "/")
    rules = {
        ("bad_rsid", "error"): ~blank("rsid") & ~F.col("rsid").rlike("^rs[0-9]+$"),
        ("unsorted_genotype", "error"): F.col("genotype").contains("/") & (parts != F.array_sort(parts)),
        ("unknown_state", "error"): ~blank("state") & ~F.lower(F.trim("state")).isin(STATES),
        ("unknown_contig", "error"): ~blank("chrom") & ~F.col("chrom").rlike(r"^(?:[1-9]|1\d|2[0-2]|X|Y|MT)$"),
        ("no_identifier", "error"): blank("rsid") & blank("chrom") & blank("start"),
        ("partial_position", "error"): blank("chrom") != blank("start"),
        ("positive_risk", "warning"): (F.lower("state") == "risk") & (weight > 0),
        ("negative_protective", "warning"): (F.lower("state") == "protective") & (weight < 0),
    }
    breaches = F.filter(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.struct(F.lit(r).alias("rule"), F.lit(s).alias("severity"))) for (r, s), c in rules.items()]), lambda x: x.isNotNull())
    found = variants.select(key.alias("key"), F.explode(breaches).alias("b")).select("b.rule", "b.severity", "key")
    repeated = variants.groupBy(key.alias("key"), "genotype").count().filter("count > 1").select(F.lit("duplicate_variant").alias("rule"), F.lit("error").alias("severity"), "key")
    moved = variants.filter(~blank("rsid") & ~blank("start")).groupBy(F.col("rsid").alias("key")).agg(F.countDistinct("chrom", "start").alias("n")).filter("n > 1").select(F.lit("two_positions").alias("rule"), F.lit("error").alias("severity"), "key")
    cited = studies.groupBy(F.col("rsid").alias("key"), "pmid").count().filter("count > 1").select(F.lit("duplicate_study").alias("rule"), F.lit("error").alias("severity"), "key")
    orphans = studies.filter(~blank("rsid")).select("rsid").distinct().join(variants.select("rsid").distinct(), "rsid", "left_anti").select(F.lit("orphan_study").alias("rule"), F.lit("warning").alias("severity"), F.col("rsid").alias("key"))
    none = studies.agg(F.count("*").alias("n")).filter("n = 0").select(F.lit("missing_studies").alias("rule"), F.lit("error").alias("severity"), F.lit("").alias("key"))
    return reduce(DataFrame.unionByName, [found, repeated, moved, cited, orphans, none])


def variant_key(rsid: str = "rsid", alts: str | None = None) -> Column:
    """rsID, else chrom:start:ref, with the alternates where they are given."""
    place = F.concat_ws(":", "chrom", "start", "ref", *([alts] if alts else []))
    return F.coalesce(blank_to_null(F.col(rsid)), F.when(F.col("chrom").isNotNull() & F.col("start").isNotNull(), place))


def compile_weights(authored: DataFrame, reference: DataFrame) -> DataFrame:
    """Authored rows (rsid, chrom, start, ref, genotype, alts, weight, ...) with identity resolved, genotype and alts as arrays, and variant_key."""
    filled = resolve(authored, reference)
    return filled.withColumns({"genotype": authored_genotype(F.col("genotype")), "alts": alt_alleles(F.col("alts")), "variant_key": variant_key()})


#: Keys of the annotations of each generation of tables.
ANNOTATION_KEYS = {1: ["rsid"], 2: ["variant_key", "conclusion"], 3: ["variant_key", "genotype", "conclusion", "negatives"]}


def compile_annotations(authored: DataFrame, generation: int = 3) -> DataFrame:
    """The facts of authored rows once for each of the keys of a generation of tables; negatives is null where authored rows have none."""
    keys = ANNOTATION_KEYS[generation]
    if "negatives" not in authored.columns:
        authored = authored.withColumn("negatives", F.lit(None).cast("string"))
    return first_per_key(authored.withColumn("variant_key", variant_key()), keys, "gene", "phenotype", "category").select(*keys, "gene", "phenotype", "category")


def content_delta(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row: how many rows of the common columns stand in one table and not in the other, repeated rows counted."""
    common = [c for c in before.columns if c in after.columns]
    a, b = before.select(*common), after.select(*common)
    rows = a.withColumn("side", F.lit(1)).unionByName(b.withColumn("side", F.lit(-1))).groupBy(*common).agg(F.sum("side").alias("more"))
    return rows.agg(F.coalesce(F.sum(F.greatest("more", F.lit(0))), F.lit(0)).alias("lost"), F.coalesce(F.sum(F.greatest(-F.col("more"), F.lit(0))), F.lit(0)).alias("gained"))


#: Buckets in which releases are compared.
BUCKETS = 1024


def fingerprints(df: DataFrame, keys: Sequence[str], columns: Sequence[str], buckets: int = BUCKETS) -> DataFrame:
    """(bucket, rows, whole, keyed): of the rows of each bucket of keys their number and sums of hashes that don't depend on their order, of the columns and of the keys alone."""
    told = lambda cs: F.xxhash64(*[x for c in cs for x in (F.col(c), F.col(c).isNull())])  # noqa: E731  a null hashes to nothing by itself
    added = lambda h: F.sum(h.cast("decimal(38,0)"))
    rows = df.select(told(keys).alias("k"), told(columns).alias("h"), F.xxhash64(F.lit("again"), told(columns)).alias("g"))
    return rows.groupBy(F.pmod("k", F.lit(buckets)).alias("bucket")).agg(F.count("*").alias("rows"), F.struct(added(F.col("h")), added(F.col("g"))).alias("whole"), added(F.xxhash64("k")).alias("keyed"))


def release_delta(before: DataFrame, after: DataFrame, keys: Sequence[str], buckets: int = BUCKETS) -> DataFrame:
    """One row on two releases of a table: rows, columns added and removed, whether the columns are a superset and the keys the same, buckets that differ, and rows lost and gained.

    Both are read once for their fingerprints; only the rows of the buckets that differ are read again and compared, none where the releases are equal.
    """
    common = [c for c in before.columns if c in after.columns]
    a, b = (fingerprints(df, keys, common, buckets) for df in (before, after))
    both = a.alias("a").join(b.alias("b"), "bucket", "full")
    differ = ~F.col("a.whole").eqNullSafe(F.col("b.whole")) | ~F.col("a.rows").eqNullSafe(F.col("b.rows"))
    facts = both.select("bucket", F.col("a.rows").alias("x"), F.col("b.rows").alias("y"), differ.alias("differ"), F.col("a.keyed").eqNullSafe(F.col("b.keyed")).alias("keyed")).collect()  # a row a bucket
    changed = [r["bucket"] for r in facts if r["differ"]]
    one = before.sparkSession.createDataFrame(
        [(sum(r["x"] or 0 for r in facts), sum(r["y"] or 0 for r in facts), ",".join(sorted(set(after.columns) - set(before.columns))), ",".join(sorted(set(before.columns) - set(after.columns))),
          set(before.columns) <= set(after.columns), all(r["keyed"] for r in facts), len(changed))],
        "rows_before long, rows_after long, added string, removed string, superset boolean, same_keys boolean, buckets_changed int",
    )
    if not changed:
        return one.withColumns({"lost": F.lit(0).cast("long"), "gained": F.lit(0).cast("long")})
    of = F.pmod(F.xxhash64(*[x for c in keys for x in (F.col(c), F.col(c).isNull())]), F.lit(buckets)).isin(changed)
    return one.crossJoin(content_delta(before.filter(of).select(*common), after.filter(of).select(*common)))  # one row each


def compile_studies(studies: DataFrame, reference: DataFrame) -> DataFrame:
    """Authored studies (rsid or place, pmid as text, conclusion) by variant_key: one row for each accepted article number and variant, identity resolved.

    A study that names no variant stays, with a null key.
    """
    filled = resolve(studies, reference).withColumn("variant_key", variant_key())
    each = filled.select("variant_key", "conclusion", F.explode(accepted(article_ids(F.col("pmid")))).alias("pmid"))
    return first_per_key(each, ["variant_key", "pmid"], "conclusion").select("variant_key", "pmid", "conclusion")


def table_delta(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row: rows before and after, columns added and removed."""
    added = ",".join(sorted(set(after.columns) - set(before.columns)))
    removed = ",".join(sorted(set(before.columns) - set(after.columns)))
    one = before.agg(F.count("*").alias("rows_before")).crossJoin(after.agg(F.count("*").alias("rows_after")))  # one row each
    return one.withColumns({"added": F.lit(added), "removed": F.lit(removed)})
