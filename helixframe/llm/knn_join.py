"""Exact top-k search by inner product: a Voronoi kNN join.

Components become floor(1024 * x) and a score is the integer inner product. With one more coordinate, sqrt(M - |x|^2) for
data (M: the largest squared norm) and 0 for queries, the largest inner product is the smallest Euclidean distance, so
that the triangle inequality holds. Queries and data are grouped into the cells of their nearest pivots, of which there are about
as many as the square root of the number of rows, MOST_PIVOTS at most. From summaries of
the cells (radius of a query cell; the smallest distances to the pivot in a data cell, its number of rows and its radius) follows for each
query cell a distance within which each of its queries has its k nearest, and from this the data cells that can hold any of
them: whole cells drop first, then single rows whose distance to the query cell's pivot, or to the plane between the pivots of
their own cell and the query cell, is too large. Query cells that need much the same data cells are one group, as long as the rows saved by shipping them
once are worth the products added (SHIPPED products a row); where no cell can be left out, all queries are one group and data is shipped
once for each block of QUERY_BLOCK queries. Summaries hold a vec_id once, at its smallest distance, since a query passes over all rows of
its own vec_id and these must not stand for its k nearest. Groups are split into blocks of queries and chunks of data by hashes of ids, so that the
size of a local problem is bounded however many rows share a cell or a vector; local winners are merged by rank.

Pivots are rows of a sample, each the farthest from those before it. The driver sees the sample and the summaries: SAMPLED * MOST_PIVOTS vectors, at most MOST_PIVOTS * (k + 1) distances.

Cases: vectors null, empty, or holding null or non-finite components, and rows with a null vec_id, take no part; a shorter
vector counts as padded with zeros; rows with one vec_id exclude each other, and of several query vectors under one vec_id the smallest is answered; ties go to the smaller
vec_id; with fewer candidates than k all are returned; an empty table gives an empty result. Only vec_id and embedding
are read, so other columns can't clash. Scores are exact while they fit 64-bit integers.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import stash, table

SCALE, K, EVERY = 1024, 10, 100
MOST_PIVOTS, QUERY_BLOCK, DATA_CHUNK, SLICE = 256, 2048, 8192, 256
#: Rows sampled for each pivot.
SAMPLED = 8
#: Inner products that cost about as much as one more row of data shipped.
SHIPPED = 2000


def clean(rows: DataFrame) -> DataFrame:
    """vec_id and embedding of the rows that take part."""
    sound = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.select("vec_id", "embedding").filter(F.col("vec_id").isNotNull() & (F.size("embedding") > 0) & sound)


def _unpacked(column: pa.Array, kind: str, size: int) -> np.ndarray:
    """A matrix from binary vectors, padded to size columns."""
    if not len(column):
        return np.zeros((0, size), dtype=kind)
    found = [np.frombuffer(x.as_buffer(), dtype=kind) for x in column]
    if all(len(x) == size for x in found):
        return np.stack(found)
    out = np.zeros((len(found), size), dtype=kind)
    for row, x in zip(out, found, strict=True):
        row[: len(x)] = x
    return out


def top(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k largest scores, largest first, ties to the smaller id."""
    if len(scores) > k:
        able = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
    else:
        able = np.arange(len(scores))
    return able[np.lexsort((ids[able], -scores[able]))[:k]]


def needed_cells(limits: np.ndarray, apart: np.ndarray, reach: np.ndarray) -> np.ndarray:
    """For each query cell and data cell whether a row of the latter can be among the k nearest of a query of the former.

    limits: the distance from a query cell's pivot within which its queries' nearest lie; reach: the data cells' radii; apart: distances
    of the query cells' pivots from the data cells' pivots.
    """
    return apart - reach[None] <= limits[:, None]


def spread_pivots(sample: np.ndarray, count: int) -> np.ndarray:
    """Positions of count rows of the sample, each the farthest from those before it."""
    picked = [0] if len(sample) else []
    far = ((sample - sample[:1]) ** 2).sum(axis=1)
    while len(picked) < count and len(sample) and far.max() > 0:
        picked.append(int(far.argmax()))
        far = np.minimum(far, ((sample - sample[picked[-1]]) ** 2).sum(axis=1))
    return np.array(picked, dtype=int)


def grouped(needs: np.ndarray, asked: np.ndarray, rows: np.ndarray) -> list[list[int]]:
    """Query cells (rows of needs, with asked queries each) in groups, joined as long as that costs less than it saves in shipped rows."""
    groups: list[tuple[list[int], np.ndarray, int]] = []
    for i in np.argsort(-(needs @ rows), kind="stable").tolist():
        best = None
        for g, (_, need, n) in enumerate(groups):
            saved = int(rows[need & needs[i]].sum())
            added = int(asked[i] * rows[need & ~needs[i]].sum() + n * rows[needs[i] & ~need].sum())
            gain = saved * SHIPPED - added
            if gain > 0 and (best is None or gain > best[0]):
                best = gain, g
        if best is None:
            groups.append(([i], needs[i].copy(), int(asked[i])))
        else:
            cells, need, n = groups[best[1]]
            groups[best[1]] = ([*cells, i], need | needs[i], n + int(asked[i]))
    return [cells for cells, _, _ in groups]


def plan(rows: DataFrame, k: int, every: int):
    """What search joins: queries (query_id, v) and data (vec_id, v) by group, block and chunk, and the vectors' types."""
    whole = F.transform("embedding", lambda x: F.floor(x.cast("double") * SCALE))
    sound = clean(rows).select("vec_id", whole.alias("v"))
    size, most, n = sound.agg(F.max(F.size("v")), F.max(F.array_max(F.transform("v", F.abs))), F.count("*")).first()
    size, most = size or 0, most or 0
    kind = "<i2" if most < 1 << 15 else "<i4" if most < 1 << 31 else "<i8"
    exact = np.float64 if size * most * most < 1 << 53 else np.int64

    @F.arrow_udf(T.StructType([T.StructField("v", T.BinaryType()), T.StructField("norm", T.DoubleType())]))
    def packed(v: pa.Array) -> pa.Array:
        found = [np.asarray(x.values.to_numpy(), dtype=kind) for x in v]
        return pa.StructArray.from_arrays([pa.array([x.tobytes() for x in found], pa.binary()), pa.array([float((x.astype(float) ** 2).sum()) for x in found], pa.float64())], ["v", "norm"])

    data = stash(sound.select("vec_id", packed("v").alias("p")).select("vec_id", "p.*"), "vectors")
    longest = data.agg(F.max("norm")).first()[0] or 0.0
    count = min(MOST_PIVOTS, max(16, math.isqrt(n)))
    heads = data.orderBy(F.xxhash64("vec_id"), "vec_id", "v").limit(SAMPLED * count).select("v").collect()
    sample = _unpacked(pa.array([bytes(r["v"]) for r in heads], pa.binary()), kind, size).astype(float)
    lifted = np.sqrt(np.maximum(longest - (sample**2).sum(axis=1), 0))
    picked = spread_pivots(np.column_stack([sample, lifted]), count)
    pivots, lifts = sample[picked], lifted[picked]

    def to_pivots(column: pa.Array, norms: np.ndarray, lifted: bool) -> np.ndarray:
        x = _unpacked(column, kind, size).astype(float)
        lift = np.sqrt(np.maximum(longest - norms, 0)) if lifted else np.zeros(len(x))
        return np.sqrt(np.maximum(norms[:, None] + (pivots**2).sum(axis=1) - 2 * x @ pivots.T + (lift[:, None] - lifts) ** 2, 0))

    near = T.StructType([T.StructField("cell", T.IntegerType()), T.StructField("d", T.DoubleType())])

    def nearest(lifted: bool):
        @F.arrow_udf(near)
        def found(v: pa.Array, norm: pa.Array) -> pa.Array:
            d = to_pivots(v, norm.to_numpy(zero_copy_only=False), lifted)
            return pa.StructArray.from_arrays([pa.array(d.argmin(axis=1), pa.int32()), pa.array(d.min(axis=1))], ["cell", "d"])

        return found

    asked = data.filter(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min(F.struct("v", "norm")).alias("q"))
    queries = stash(asked.select(F.col("vec_id").alias("query_id"), "q.v", nearest(False)("q.v", "q.norm").alias("c")).select("query_id", "v", "c.*"), "queries")
    by_cell = Window.partitionBy("cell").orderBy("d", "vec_id")
    placed = stash(data.select("vec_id", nearest(True)("v", "norm").alias("c")).select("vec_id", "c.*"), "placed")
    inner = placed.groupBy("cell", "vec_id").agg(F.min("d").alias("d")).withColumn("r", F.row_number().over(by_cell)).filter(F.col("r") <= k + 1).select("cell", "vec_id", "d").collect()
    held = placed.groupBy("cell").agg(F.max("d").alias("radius"), F.count("*").alias("n")).collect()
    groups = sorted(queries.groupBy("cell").agg(F.max("d").alias("radius"), F.count("*").alias("n")).collect())

    cells = np.array([r["cell"] for r in inner], dtype=int)
    depth = np.array([r["d"] for r in inner], dtype=float)
    names = np.array([r["vec_id"] for r in inner], dtype=np.int64)
    apart = np.sqrt(np.maximum(((pivots[:, None] - pivots[None]) ** 2).sum(axis=2) + (lifts[:, None] - lifts[None]) ** 2, 0))
    own = np.array([g["cell"] for g in groups], dtype=int)
    radius = np.array([g["radius"] for g in groups], dtype=float)
    limits = np.zeros(len(groups))
    for i, cell in enumerate(own):
        upper = radius[i] + apart[cell, cells] + depth
        order = np.argsort(upper, kind="stable")
        upper = upper[order[np.sort(np.unique(names[order], return_index=True)[1])]]  # of each vec_id the smallest, in order
        limits[i] = radius[i] + (upper[k] if len(upper) > k else np.inf) + 1e-6 * (1 + radius[i] + np.sqrt(longest))
    reach, rows_in = np.full(len(pivots), -np.inf), np.zeros(len(pivots), dtype=np.int64)
    for r in held:
        reach[r["cell"]], rows_in[r["cell"]] = r["radius"], r["n"]
    needs = needed_cells(limits, apart[own], reach) & (rows_in > 0)[None] if len(own) else np.zeros((0, len(pivots)), dtype=bool)
    joined = grouped(needs, np.array([g["n"] for g in groups], dtype=np.int64), rows_in)
    group_of = {int(own[i]): g for g, members in enumerate(joined) for i in members}
    blocks = [max(1, -(-sum(groups[i]["n"] for i in members) // QUERY_BLOCK)) for members in joined]
    # of each group as many as its cells have rows for, so that queries go nowhere where pruning has left nothing
    chunks = [max(1, -(-int(rows_in[needs[members].any(axis=0)].sum()) // DATA_CHUNK)) for members in joined]
    order_at = np.array([i for members in joined for i in members], dtype=int)  # query cells by group, and their pivots
    order_of = own[order_at] if len(own) else order_at
    firsts = np.cumsum([0, *map(len, joined)])[:-1].astype(int) if joined else np.zeros(0, dtype=int)

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def wanted(v: pa.Array, norm: pa.Array) -> pa.Array:
        d = to_pivots(v, norm.to_numpy(zero_copy_only=False), True)
        cell = d.argmin(axis=1)
        own_d = d[np.arange(len(d)), cell]
        out = []
        for at in range(0, len(d), 2048):
            part, c, mine = d[at : at + 2048][:, order_of], cell[at : at + 2048], own_d[at : at + 2048, None]
            gap = np.maximum(apart[order_of][:, c].T, 1e-12)
            # a row is nearer to its own pivot than to the query cell's, and so beyond the plane between them by so much; a query is on the other side
            plane = (part**2 - mine**2) / (2 * gap)
            able = needs[order_at][:, c].T & (part <= limits[order_at]) & ((plane <= (limits - radius)[order_at]) | (order_of == c[:, None]))
            found = np.logical_or.reduceat(able, firsts, axis=1) if len(firsts) else np.zeros((len(part), 0), dtype=bool)
            out += [np.flatnonzero(row).tolist() for row in found]
        return pa.array(out, pa.list_(pa.int32()))

    chunk_count = F.create_map(*[F.lit(x) for pair in enumerate(chunks) for x in pair]) if chunks else F.create_map(F.lit(0), F.lit(1))
    count_of = F.create_map(*[F.lit(x) for pair in enumerate(blocks) for x in pair]) if blocks else F.create_map(F.lit(0), F.lit(1))
    cell_group = F.create_map(*[F.lit(x) for pair in group_of.items() for x in pair]) if group_of else F.create_map(F.lit(0), F.lit(0))
    left = queries.select("query_id", "v", cell_group[F.col("cell")].alias("cell"))
    left = left.select(
        "query_id", "v", "cell", F.pmod(F.xxhash64("query_id"), count_of[F.col("cell")]).cast("int").alias("block"),
        F.explode(F.sequence(F.lit(0), chunk_count[F.col("cell")] - 1)).alias("chunk"),
    )
    right = data.select("vec_id", "v", F.explode(wanted("v", "norm")).alias("cell"))
    right = right.select("vec_id", "v", F.pmod(F.xxhash64("vec_id", F.lit(1)), chunk_count[F.col("cell")]).cast("int").alias("chunk"), "cell", F.explode(F.sequence(F.lit(0), count_of[F.col("cell")] - 1)).alias("block"))
    return left, right, kind, size, exact


def search(rows: DataFrame, k: int = K, every: int = EVERY) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best of each row whose vec_id is divisible by every."""
    left, right, kind, size, exact = plan(rows, k, every)

    def solve(asking: pa.Table, having: pa.Table) -> pa.Table:
        out: list[list[np.ndarray]] = [[], [], []]
        if asking.num_rows and having.num_rows:
            ids = having["vec_id"].to_numpy()
            base = _unpacked(having["v"].combine_chunks(), kind, size).astype(exact)
            names = asking["query_id"].to_numpy()
            for at in range(0, len(names), SLICE):
                part = _unpacked(asking["v"].slice(at, SLICE).combine_chunks(), kind, size).astype(exact)
                for name, scores in zip(names[at : at + SLICE], (part @ base.T).astype(np.int64), strict=True):
                    others = np.flatnonzero(ids != name)
                    best = others[top(scores[others], ids[others], k)]
                    for column, x in zip(out, (np.full(len(best), name), ids[best], scores[best]), strict=True):
                        column.append(x)
        return pa.table({c: pa.array(np.concatenate(x) if x else np.zeros(0, dtype=np.int64), pa.int64()) for c, x in zip(("query_id", "vec_id", "score"), out, strict=True)})

    key = ["cell", "block", "chunk"]
    local = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(solve, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return local.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op3_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"))


ORACLE_SQL = f"""
WITH sound AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, d.vec_id, CAST(list_dot_product(q.v, d.v) AS BIGINT) AS score
  FROM sound q JOIN sound d ON q.vec_id % {EVERY} = 0 AND q.vec_id <> d.vec_id),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= {K}
"""
