"""An annotation run: all modules over a callset, into one table partitioned by module, with an outcome for each.

Modules of one strategy are joined in one pass over the calls, restored rows come from one more, and one write lays all of it down by
module; what was written is counted while it is written. A module that can't be opened, has no way to join, has keys of the wrong kind or fails while
it is read is an outcome and stops no other: where the joint write fails, each module is tried alone, and what succeeded is written again without the others.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.genotypes import authored_genotype
from .aggregates import LEAST_BREADTH, LEAST_SITES, callset_scope, input_mode
from .filters import hom_ref_rows
from .joins import absent_sites, join_strategy, matched_at_positions, nearest_within

OUTCOME = "module string, strategy string, kind string, reason string, lead_table string, schema string, written long, matched long, restored long"
#: The partition column of a run's table, and what a module's columns of a callset's names end with there.
BY, SUFFIX = "run_module", "module"
#: Why no row can be restored or joined.
NO_KEY, NO_RSID = "no way to join", "no call has an rsID"


class Context(NamedTuple):
    """What a callset allows: restoration needs a callset of variants only that covers a whole genome."""

    mode: str
    sites: int
    breadth: float
    scope: str
    reason: str
    has_rsid: bool

    @property
    def restores(self) -> bool:
        return self.mode == "variant_only" and self.scope == "wgs"


def context_of(calls: DataFrame, flank: int, least_sites: int = LEAST_SITES, least_breadth: float = LEAST_BREADTH) -> Context:
    """One row of facts about the callset."""
    named = F.coalesce(F.bool_or(F.col("rsid").startswith("rs")), F.lit(False)).alias("has_rsid")
    facts = input_mode(calls).crossJoin(calls.agg(named)).crossJoin(callset_scope(calls, flank, least_sites, least_breadth)).first()  # one row each
    return Context(facts["mode"], facts["sites"], facts["breadth"], facts["scope"], facts["reason"], facts["has_rsid"])


def reason_of(e: Exception) -> str:
    """Spark's name of the error's condition, which a failed job has in its text only; else the error's type."""
    found = re.search(r"\[([A-Z][A-Z0-9_]+(?:\.[A-Z0-9_]+)*)\]", str(e))
    return getattr(e, "getCondition", lambda: None)() or (found[1] if found else type(e).__name__)


def read_modules(readers: dict[str, Callable[[], DataFrame]]) -> tuple[dict[str, DataFrame], dict[str, str]]:
    """The modules' tables that can be opened, their keys as calls have them, and why the others can't: a module that raises stops no other."""
    tables, reasons = {}, {}
    for name, read in readers.items():
        try:
            tables[name] = usable(read())
        except Exception as e:  # whatever a module's source raises is its outcome
            reasons[name] = reason_of(e)
    return tables, reasons


def usable(lead: DataFrame) -> DataFrame:
    """A module's table with keys of the kinds that calls have: genotype as an array (text is split as authored), chrom and rsid as text, start as a whole number.

    A TypeError names a key that can't be one.
    """
    kinds = {f.name: f.dataType for f in lead.schema.fields}
    keys: dict[str, Column] = {}
    for name in ("chrom", "rsid", "ref"):
        if name in kinds and not isinstance(kinds[name], (T.StringType, T.NullType)):
            raise TypeError(f"{name} is {kinds[name].simpleString()}")
        if name in kinds:
            keys[name] = F.col(name).cast("string")
    if "start" in kinds:
        if not isinstance(kinds["start"], (T.IntegralType, T.NullType)):
            raise TypeError(f"start is {kinds['start'].simpleString()}")
        keys["start"] = F.col("start").cast("bigint")
    if "genotype" in kinds:
        kind = kinds["genotype"]
        if isinstance(kind, T.StringType):
            keys["genotype"] = authored_genotype(F.col("genotype"))
        elif not (isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StringType)):
            raise TypeError(f"genotype is {kind.simpleString()}")
    return lead.withColumns(keys) if keys else lead


def strategies(tables: dict[str, DataFrame]) -> tuple[dict[str, str], dict[str, str]]:
    """The way each module joins, and why others can't be read: one job for all, and one each only where that fails."""
    one = {n: join_strategy(t).select(F.lit(n).alias("module"), "strategy") for n, t in tables.items()}
    if not one:
        return {}, {}
    try:
        return {r["module"]: r["strategy"] for r in reduce(DataFrame.unionByName, one.values()).collect()}, {}  # a row a module
    except Exception:
        found, reasons = {}, {}
        for name, df in one.items():
            try:
                found[name] = df.first()["strategy"]
            except Exception as e:
                reasons[name] = reason_of(e)
        return found, reasons


def common_types(tables: Sequence[DataFrame]) -> list[DataFrame]:
    """The tables with equal types for columns of equal names: numbers become double, anything else that differs text."""
    kinds: dict[str, list[T.DataType]] = {}
    for t in tables:
        for f in t.schema.fields:
            kinds.setdefault(f.name, []).append(f.dataType)
    cast = {}
    for name, found in kinds.items():
        if any(k != found[0] for k in found[1:]):
            real = [k for k in found if not isinstance(k, T.NullType)]
            if real and all(k == real[0] for k in real):
                cast[name] = real[0]
            else:
                cast[name] = T.DoubleType() if all(isinstance(k, T.NumericType) for k in real) else T.StringType()
    as_text = lambda c, k: F.array_join(c, "/") if isinstance(k, T.ArrayType) else F.col(c)
    out = []
    for t in tables:
        own = {f.name: f.dataType for f in t.schema.fields}
        out.append(t.withColumns({c: (as_text(c, own[c]) if cast[c] == T.StringType() else F.col(c)).cast(cast[c]) for c in own if c in cast}))
    return out


def _joint(leads: dict[str, DataFrame]) -> DataFrame:
    """All leads as one table with their module's name in job and a mark that is never null."""
    tables = common_types(list(leads.values()))
    named = [t.withColumns({"job": F.lit(n), "__found": F.lit(True)}) for n, t in zip(leads, tables, strict=True)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), named)


def _by_position(calls: DataFrame, leads: dict[str, DataFrame]) -> DataFrame:
    joined = matched_at_positions(calls, _joint(leads), SUFFIX, ["job"])
    stated = f"ref_{SUFFIX}"
    return joined.filter(F.col(stated).isNull() | (F.col(stated) == F.col("ref"))) if stated in joined.columns else joined


def _by_rsid(calls: DataFrame, leads: dict[str, DataFrame]) -> DataFrame:
    lead = _joint(leads)
    rest = [c for c in lead.columns if c not in ("rsid", "genotype", "job")]
    nested = lead.withColumnRenamed("rsid", "__rs").groupBy("__rs", "job").agg(F.collect_list(F.struct("genotype", *rest)).alias("__rows"))
    hits = F.filter("__rows", lambda r: r["genotype"] == F.col("genotype"))
    keyed = calls.withColumn("__rs", F.explode(F.split("rsid", ";"))).join(nested, "__rs")
    joined = keyed.select(*calls.columns, "job", F.explode_outer(hits).alias("__hit"))
    return joined.select(*calls.columns, "job", *[F.col("__hit").getField(c).alias(f"{c}_{SUFFIX}" if c in calls.columns else c) for c in rest])


def restored_rows(calls: DataFrame, lead: DataFrame, flank: int, by: Sequence[str] = ()) -> DataFrame:
    """Hom-ref rows of the lead that no call stands at and a call stands near, as rows of the annotated table.

    The callset's columns are null but for chrom, start, ref and genotype; the lead's columns of equal names get the suffix. by: columns that tell leads apart.
    """
    found = nearest_within(absent_sites(hom_ref_rows(lead, by), calls), calls.select("chrom", "start").distinct(), flank)
    filled = {"chrom", "start", "ref", "genotype"}
    kinds = {f.name: f.dataType for f in calls.schema.fields}
    own = [F.col(c).cast(k).alias(c) if c in filled else F.lit(None).cast(k).alias(c) for c, k in kinds.items()]
    keys = {"chrom", "start", "genotype", *by}
    rest = [F.col(c).alias(f"{c}_{SUFFIX}" if c in kinds else c) for c in lead.columns if c not in keys]
    return found.select(*own, *by, *rest, F.lit("restored_hom_ref").alias("genotype_evidence"), F.col("distance").alias("restored_flank_bp"))


def annotated(calls: DataFrame, leads: dict[str, tuple[str, DataFrame]], flank: int | None = None) -> DataFrame:
    """Called rows, and with flank restored ones too, of all leads, which are (strategy, table) by module; job holds the module."""
    parts = []
    for strategy, join in (("position", _by_position), ("rsid", _by_rsid)):
        if own := {n: t for n, (s, t) in leads.items() if s == strategy}:
            parts.append(join(calls, own).withColumns({"genotype_evidence": F.lit("called"), "restored_flank_bp": F.lit(None).cast("bigint")}))
    placed = {n: t for n, (_, t) in leads.items() if {"chrom", "start", "ref", "genotype"} <= set(t.columns)}
    if flank is not None and placed:
        parts.append(restored_rows(calls, _joint(placed), flank, ["job"]))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), common_types(parts))


def _write(rows: DataFrame, modules: Sequence[str], to: str, mode: str) -> dict[str, tuple[int, int, int]]:
    """Writes rows by module, and counts each one's rows written, matched and restored meanwhile."""
    seen = Observation()
    called = F.col("genotype_evidence") == "called"
    counts = []
    for i, name in enumerate(modules):
        own = F.col("job") == name
        counts += [F.count_if(own & called).alias(f"written_{i}"), F.count_if(own & called & F.coalesce("__found", F.lit(False))).alias(f"matched_{i}"), F.count_if(own & ~called).alias(f"restored_{i}")]
    rows.observe(seen, *counts).withColumnRenamed("job", BY).drop("__found").write.mode(mode).option("compression", "zstd").partitionBy(BY).parquet(to)
    return {n: tuple(seen.get[f"{c}_{i}"] for c in ("written", "matched", "restored")) for i, n in enumerate(modules)}


def annotate_run(calls: DataFrame, readers: dict[str, Callable[[], DataFrame]], to: str, flank: int, context: Context, lead_tables: dict[str, str] | None = None) -> DataFrame:
    """The run's outcomes (OUTCOME), a row for each module; their annotated rows are written to to, a folder a module.

    kind: ok, skipped (no way to join) or failed, with the reason. Rows are restored where the context allows it.
    """
    spark = calls.sparkSession
    tables, reasons = read_modules(readers)
    ways, unread = strategies(tables)
    reasons |= unread
    skipped = {n: NO_KEY for n, way in ways.items() if way == "unsupported"}
    if not context.has_rsid:
        reasons |= {n: NO_RSID for n, way in ways.items() if way == "rsid"}
    leads = {n: (way, tables[n]) for n, way in ways.items() if n not in skipped and n not in reasons}
    limit = flank if context.restores else None
    counts: dict[str, tuple[int, int, int]] = {}
    schemas: dict[str, T.StructType] = {}
    if leads:
        try:
            rows = annotated(calls, leads, limit)
            counts = _write(rows, list(leads), to, "overwrite")
            schemas = {n: own_schema(calls, lead, rows) for n, lead in leads.items()}
        except Exception:
            mode = "overwrite"
            for name, lead in leads.items():
                try:
                    rows = annotated(calls, {name: lead}, limit)
                    counts |= _write(rows, [name], to, mode)
                    schemas[name] = own_schema(calls, lead, rows)
                    mode = "append"
                except Exception as e:
                    reasons[name] = reason_of(e)
    found = []
    for name in readers:
        kind = "failed" if name in reasons else "skipped" if name in skipped else "ok"
        schema = schemas[name].json() if kind == "ok" else None
        found.append((name, ways.get(name), kind, reasons.get(name) or skipped.get(name), (lead_tables or {}).get(name), schema, *counts.get(name, (0, 0, 0))))
    return spark.createDataFrame(found, OUTCOME)


def own_schema(calls: DataFrame, lead: tuple[str, DataFrame], rows: DataFrame) -> T.StructType:
    """The columns of one module's annotated table, of those of the run's rows."""
    way, table = lead
    keys = {"genotype", *(("chrom", "start") if way == "position" else ("rsid",))}
    names = [*calls.columns, *[f"{c}_{SUFFIX}" if c in calls.columns else c for c in table.columns if c not in keys], "genotype_evidence", "restored_flank_bp"]
    return T.StructType([rows.schema[c] for c in names])


def annotated_table(spark: SparkSession, to: str, outcomes: DataFrame, module: str) -> DataFrame:
    """The annotated rows of one module of a run that was written to to: only its folder is read, and only its own columns; those of a callset's names end with the module's name."""
    row = outcomes.filter(F.col("module") == module).first()
    if row is None or row["kind"] != "ok":
        raise ValueError(f"{module} gave no table")
    schema = T.StructType.fromJson(json.loads(row["schema"]))
    rows = spark.read.schema(T.StructType([*schema.fields, T.StructField(BY, T.StringType())])).parquet(to).filter(F.col(BY) == module)
    return rows.select(*[F.col(c).alias(f"{c[: -len(SUFFIX)]}{module}" if c.endswith(f"_{SUFFIX}") else c) for c in schema.names])
