"""Approximate nearest neighbours: NN-descent builds the neighbour graph, greedy search over it answers queries.

Rows of one vector are one class, which its smallest vec_id stands for: graph and search see each vector once, and an answer
lists the smallest vec_ids of a class, k + 1 at most, as no more of one class can be among a query's k nearest.

With one more coordinate, sqrt(M - |x|^2) for data (M: the largest squared norm) and 0 for queries, nearness by inner product
is nearness by distance, so that graph and search follow one order. The graph starts from random blocks and from cells, in which each vector
meets all others of its block: TREES times, vectors go to the nearest of pivots drawn from a bounded sample of vectors, about a pivot for
each LEAF vectors; beyond MOST pivots cells are those of two or more draws together; large cells are split. Each round of NN-descent then
joins, at every vector, its neighbours and the vectors that have it as neighbour: of two of them, of which at least one came by an edge that the last
round found, each that improves the other's list is a candidate, and lists keep the best NEIGHBOURS. Rounds end
when at most a share SETTLED of all edges is new, so that a larger table gets the rounds that it needs. The
vectors around a very popular one are dealt to blocks of about BLOCK: all take part and none makes a task large. Vectors travel in 8 bits
a component, each on a scale of its own largest component, with their exact squared norms, and nearness leaves out what M adds to
all pairs, so that a vector of any length leaves the others' nearness as it is. Graph and search order vectors by these rounded components;
the scores that are returned are computed from the original vectors in double precision.

For the search an edge holds in both directions: a vector's row lists its neighbours and the nearest that have it as neighbour, 2 * NEIGHBOURS
in all, each with its vector, so that one join takes a query to all of them. A query's search starts at its own row and the LONGEST longest vectors,
which the graph's distance puts far from all and which have large products. Each step expands its best WIDTH candidates that aren't expanded yet,
scores what they list and keeps the BEAM best, until no query has a candidate left to expand: a beam only
gets better, so that none is expanded twice and the steps end by themselves. Queries that are done take no part in later steps. Each
table of a round or step is deleted when the next one is written.

Cases: vectors null, empty, zero or holding null or non-finite components, and rows with a null vec_id, take no part; a shorter
vector counts as padded with zeros; of rows with one vec_id the one with the smallest vector takes part; ties go to the
smaller vec_id; with fewer candidates than k all are returned (one block then holds them all); an empty table gives an
empty result. Only vec_id and embedding are read, so other columns can't clash.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bytestext as bt
from .knn_join import clean
from .shared import discard, partitions, short_batches, stash, table

K, EVERY = 20, 20
NEIGHBOURS, TREES, LEAF, MOST, BLOCK, SETTLED = 32, 32, 4096, 1024, 64, 0.01
BEAM, WIDTH, LONGEST = 256, 64, 32
#: Rounds of at most this share of new edges leave out centers without one; steps of at most so many asked rows broadcast them.
FEW, SMALL = 0.02, 20_000
FAR = 3e38


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary column, and how many each row has."""
    if not len(column):
        return np.zeros(0, dtype=np.uint8), np.zeros(0, dtype=np.int32)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]], np.diff(at)


def _blobs(counts: np.ndarray, values: np.ndarray) -> pa.Array:
    """A binary column of so many values a row."""
    values = np.ascontiguousarray(values)
    width = values.nbytes // max(1, len(values))
    at = (np.concatenate([[0], np.cumsum(counts)]) * width).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(at), pa.py_buffer(values)])


def _vectors(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The 8-bit vectors as 32-bit floats, a row each, their scales and squared norms; a row of column may hold several."""
    raw = _bytes(column)[0].reshape(-1, size + 16)
    tail = np.ascontiguousarray(raw[:, size:]).view("<f8")
    return raw[:, :size].view(np.int8).astype(np.float32), tail[:, 0], tail[:, 1]


def _sides(vectors: tuple[np.ndarray, ...], longest: float) -> tuple[np.ndarray, np.ndarray]:
    """Two matrices, a row a vector: products of rows of the one with rows of the other are inner products, less longest, with the coordinate sqrt(longest - norm) added."""
    x, scales, norms = vectors
    root = math.sqrt(longest)
    low = norms / (root + np.sqrt(np.maximum(longest - norms, 0)))  # root - sqrt(longest - norm)
    x, ones = x * scales[:, None].astype(np.float32), np.ones(len(x))
    left = np.stack([low, -root * low, ones], axis=1).astype(np.float32)
    right = np.stack([low, ones, -root * low], axis=1).astype(np.float32)
    return np.concatenate([x, left], axis=1), np.concatenate([x, right], axis=1)


def _finger(ids: np.ndarray) -> np.ndarray:
    return (bt.mix(ids.astype(np.int64).view(np.uint64)) & np.uint64(0xFFFF)).astype("<u2")


def _lists(counts: np.ndarray, values: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(values))


def _places(groups: np.ndarray) -> np.ndarray:
    """The place of each row in its group, from 0; rows of a group stand together."""
    first = np.flatnonzero(np.concatenate([[True], groups[1:] != groups[:-1]])) if len(groups) else np.zeros(0, dtype=np.int64)
    return np.arange(len(groups)) - np.repeat(first, np.diff([*first, len(groups)]))


def _top(near: np.ndarray, k: int) -> np.ndarray:
    """The columns of the k largest of each row."""
    width = near.shape[1]
    if k >= width:
        return np.broadcast_to(np.arange(width), near.shape)
    return np.argpartition(near, width - k, axis=1)[:, width - k :]


def _about(near: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(counts, places in the flat matrix) of the k largest of each row, and of few more, found by the k-th largest of 4 * k columns' maxima."""
    count, width = near.shape
    parts = 4 * k
    if width > 2 * parts:
        bound = np.partition(near[:, : width // parts * parts].reshape(count, -1, parts).max(axis=1), parts - k, axis=1)[:, parts - k]
        at = np.flatnonzero(near >= bound[:, None])
        if len(at) <= 2 * k * count:
            return np.bincount(at // width, minlength=count), at
    return np.full(count, min(k, width)), (np.arange(count)[:, None] * width + _top(near, k)).ravel()


def _nearest(count: int, rows: np.ndarray, ids: np.ndarray, near: np.ndarray, done: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """(counts, ids, near, done): of each of count rows its k nearest ids, once each, nearest first; an id is done where one of its entries is."""
    order = np.argsort(rows.astype(np.int16 if count < 1 << 15 else np.int64), kind="stable")
    rows, place = rows[order], _places(rows[order])
    shape = count, int(place.max(initial=0)) + 1
    all_ids, all_near, all_done = np.full(shape, np.iinfo(np.int64).max), np.full(shape, -np.inf, dtype=np.float32), np.zeros(shape, dtype=bool)
    for whole, part in ((all_ids, ids), (all_near, near), (all_done, done)):
        whole[rows, place] = part[order]
    order = np.argsort(all_ids, axis=1)
    all_ids, all_near, all_done = (np.take_along_axis(x, order, axis=1) for x in (all_ids, all_near, all_done))
    first = np.ones(shape, dtype=bool)
    first[:, 1:] = all_ids[:, 1:] != all_ids[:, :-1]
    at = np.flatnonzero(first)
    single = np.full(shape, -np.inf, dtype=np.float32)
    if len(at):
        single.ravel()[at] = np.maximum.reduceat(all_near.ravel(), at)
        all_done.ravel()[at] = np.logical_or.reduceat(all_done.ravel(), at)
    picked = np.sort(_top(single, k), axis=1)  # ties stay by id
    picked = np.take_along_axis(picked, np.argsort(-np.take_along_axis(single, picked, axis=1), axis=1, kind="stable"), axis=1)
    near = np.take_along_axis(single, picked, axis=1)
    keep = near > -np.inf
    return keep.sum(axis=1), np.take_along_axis(all_ids, picked, axis=1)[keep], near[keep], np.take_along_axis(all_done, picked, axis=1)[keep]


def by_group(key: str, solve: Callable[[pa.Table, list[int]], pa.Table]):
    """A mapInArrow function over rows that come ordered by key: solve gets whole groups, many at a time, and where they begin and end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # of one group, the last one so far
        for batch in batches:
            for at in range(0, batch.num_rows, 20_000):
                rows = batch.slice(at, 20_000)
                if held and rows[key][-1] == held[-1][key][-1]:  # as keys are ordered, one group
                    held.append(rows)
                    continue
                table = pa.Table.from_batches([*held, rows]).combine_chunks()
                column = table[key].to_numpy()
                edges = [0, *(np.flatnonzero(column[1:] != column[:-1]) + 1).tolist()]
                if edges[-1]:
                    yield from solve(table.slice(0, edges[-1]), edges).to_batches()
                held = table.slice(edges[-1]).to_batches()
        if held:
            table = pa.Table.from_batches(held).combine_chunks()
            yield from solve(table, [0, table.num_rows]).to_batches()

    return run


def _only(column: pa.ChunkedArray) -> pa.Array:
    """The column as one array."""
    return column.chunk(0) if column.num_chunks == 1 else column.combine_chunks()


def best(edges: DataFrame, k: int) -> DataFrame:
    """The k nearest v of each u; an edge is old where one of its rows is."""

    def pick(rows: pa.Table, edges: list[int]) -> pa.Table:
        counts = np.diff(edges)
        owner = np.repeat(np.arange(len(counts)), counts)
        kept, vs, near, old = _nearest(len(counts), owner, *(rows[c].to_numpy() for c in ("v", "near", "old")), k)
        return pa.table({"u": np.repeat(rows["u"].to_numpy()[edges[:-1]], kept), "v": vs, "near": near, "old": old})

    ordered = edges.select("u", "v", "near", "old").repartition(partitions(edges.sparkSession), "u").sortWithinPartitions("u")
    return ordered.mapInArrow(by_group("u", pick), "u long, v long, near float, old boolean")


def start(vectors: DataFrame, size: int, n: int, longest: float) -> DataFrame:
    """Edges (u, v, near) among vectors that share a random block or a cell of random pivots, the best NEIGHBOURS of each."""
    spark, wanted = vectors.sparkSession, max(1.0, n / LEAF)
    draws = max(1, math.ceil(math.log(wanted) / math.log(MOST)))
    width = math.ceil(wanted ** (1 / draws))
    # a cell holds about wanted ** -0.5 of a vector's nearest
    trees = min(TREES, math.ceil(2 * math.sqrt(wanted))) if width > 1 else 0
    listed = NEIGHBOURS // 2 if trees else NEIGHBOURS
    heads = vectors.orderBy(F.xxhash64("vec_id", F.lit(7)), "vec_id").limit(trees * draws * width).select("v").collect()
    pivots = _sides(_vectors(pa.array([bytes(r["v"]) for r in heads], pa.binary()), size), longest)[1]
    dealt = np.random.default_rng(5).permutation(len(pivots))

    @F.arrow_udf(T.ArrayType(T.LongType()))
    def cells(v: pa.Array) -> pa.Array:
        x = _sides(_vectors(v, size), longest)[0]
        codes = np.zeros((len(x), trees), dtype=np.int64)
        for at in range(trees * draws):
            codes[:, at % trees] = codes[:, at % trees] * width + (x @ pivots[dealt[at :: trees * draws]].T).argmax(axis=1)
        return _lists(np.full(len(x), trees), codes.ravel())

    coded = stash(vectors.select("vec_id", "v", cells("v").alias("cells")), "cells")
    in_cell = coded.select("vec_id", "v", F.posexplode("cells").alias("tree", "cell"))
    split = coded.select(F.posexplode("cells").alias("tree", "cell")).groupBy("tree", "cell").agg(F.ceil(F.count("*") / (2 * LEAF)).alias("blocks")).filter("blocks > 1")
    block = F.pmod(F.xxhash64("vec_id", "tree"), F.coalesce("blocks", F.lit(1).cast("long")))
    placed = in_cell.join(split, ["tree", "cell"], "left").select("vec_id", "v", F.xxhash64("tree", "cell", block).alias("group"))
    block = F.pmod(F.xxhash64("vec_id", F.lit(3)), F.lit(max(1, n // LEAF)))
    random = vectors.select("vec_id", "v", block.alias("group"))

    def meet(rows: pa.Table, edges: list[int]) -> pa.Table:
        ids, (left, right) = rows["vec_id"].to_numpy(), _sides(_vectors(_only(rows["v"]), size), longest)
        counts, vs, values = [], [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.float32)]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            k, rest = min(listed, b - a - 1), range(a, b)
            for at in rest[:: 128 if k else b - a]:
                near = left[at : min(at + 128, b)] @ right[a:b].T
                near[np.arange(len(near)), at - a + np.arange(len(near))] = -np.inf
                each, picked = _about(near, k) if k else (np.zeros(1, dtype=np.int64), np.zeros(0, dtype=np.int64))
                counts.append(each)
                vs.append(ids[a + picked % (b - a)])
                values.append(near.ravel()[picked])
        counts = np.concatenate(counts)
        return pa.table({"u": ids, "v": _blobs(counts, np.concatenate(vs)), "near": _blobs(counts, np.concatenate(values))})

    def merged(rows: pa.Table, edges: list[int]) -> pa.Table:
        """The best of what a vector found in all its blocks."""
        us, counts = rows["u"].to_numpy()[edges[:-1]], np.diff(edges)
        vs, lengths = _bytes(_only(rows["v"]))
        owner = np.repeat(np.repeat(np.arange(len(counts)), counts), lengths // 8)
        near = _bytes(_only(rows["near"]))[0].view("<f4")
        counts, vs, near, _ = _nearest(len(us), owner, vs.view("<i8"), near, np.zeros(len(near), dtype=bool), NEIGHBOURS)
        return pa.table({"u": np.repeat(us, counts), "v": vs, "near": near})

    # groups are told by one number, which Spark sorts by digits; two that happen to share it only meet
    ordered = placed.unionByName(random).repartition(partitions(spark), "group").sortWithinPartitions("group")
    met = ordered.mapInArrow(by_group("group", meet), "u long, v binary, near binary")
    met = met.repartition(partitions(spark), "u").sortWithinPartitions("u")
    found = stash(met.mapInArrow(by_group("u", merged), "u long, v long, near float"), "start")
    discard(coded)
    return found


def improve(graph: DataFrame, vectors: DataFrame, size: int, longest: float, few: bool = False) -> DataFrame:
    """One round of NN-descent: graph with the candidates from all local joins. few: most vectors may have no new edge, and are left out as centers."""

    @F.arrow_udf(T.BinaryType())
    def fingers(ids: pa.Array) -> pa.Array:
        at, flat = ids.offsets.to_numpy(), _finger(ids.values.to_numpy())
        return pa.array([flat[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)], pa.binary())

    known = graph.groupBy("u").agg(F.min("near").alias("least"), F.count("*").alias("n"), F.collect_list("v").alias("vs"))
    least = F.when(F.col("n") < NEIGHBOURS, F.lit(float("-inf"))).otherwise(F.col("least")).cast("float")
    members = vectors.join(known.select(F.col("u").alias("vec_id"), least.alias("least"), fingers("vs").alias("known")), "vec_id")
    popular = graph.groupBy("v").agg(F.ceil(F.count("*") / BLOCK).cast("long").alias("blocks")).filter("blocks > 1").withColumnRenamed("v", "center")
    around = graph.select(F.col("v").alias("center"), F.col("u").alias("vec_id"), "old").join(popular, "center", "left").select(
        "center", "vec_id", "old", F.pmod(F.xxhash64("vec_id", F.lit(9)), F.coalesce("blocks", F.lit(1).cast("long"))).alias("block")
    )
    forward = graph.select(F.col("u").alias("center"), F.col("v").alias("vec_id"), "old")
    # a popular center's own neighbours meet each block of those around it
    more = forward.join(popular, "center").select("center", "vec_id", "old", F.explode(F.sequence(F.lit(1).cast("long"), F.col("blocks") - 1)).alias("block"))
    rows = forward.withColumn("block", F.lit(0).cast("long")).unionByName(more).unionByName(around)
    if few:
        rows = rows.join(graph.filter("NOT old").select(F.explode(F.array("u", "v")).alias("center")).distinct(), "center", "left_semi")
    rows = rows.select(F.xxhash64("center", "block").alias("group"), "vec_id", "old").join(members.hint("shuffle_hash"), "vec_id")

    def meet(rows: pa.Table, edges: list[int]) -> pa.Table:
        ids, least, fresh = rows["vec_id"].to_numpy(), rows["least"].to_numpy(), ~rows["old"].to_numpy()
        # a vector that comes both ways stands twice: the new edge counts
        group = np.repeat(np.arange(len(edges) - 1), np.diff(edges))
        order = np.lexsort((~fresh, ids, group))
        twice = np.zeros(len(ids), dtype=bool)
        twice[order[1:]] = (ids[order[1:]] == ids[order[:-1]]) & (group[order[1:]] == group[order[:-1]])
        left, right = _sides(_vectors(_only(rows["v"]), size), longest)
        us, vs, values = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.float32)]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            new = fresh[a:b]
            if b - a < 2 or not new.any():
                continue
            near = left[a:b] @ right[a:b].T
            good = near > least[a:b, None]
            if not new.all():
                good &= new[:, None] | new
            u, v = np.nonzero(good)
            us.append(u + a)
            vs.append(v + a)
            values.append(near[u, v])
        u, v, near = np.concatenate(us), np.concatenate(vs), np.concatenate(values)
        keep = ~twice[u] & ~twice[v] & (u != v)
        u, v, near, own = u[keep], v[keep], near[keep], _finger(ids)
        raw, lengths = _bytes(_only(rows["known"]))
        held = np.repeat(own[:, None], NEIGHBOURS, axis=1)
        held[np.arange(NEIGHBOURS) < lengths[:, None] // 2] = raw.view("<u2")
        keep = ~(held[u] == own[v][:, None]).any(axis=1)
        u, v, near = u[keep], v[keep], near[keep]
        order = np.lexsort((-near, u))
        order = order[_places(u[order]) < NEIGHBOURS]
        return pa.table({"u": ids[u[order]], "v": ids[v[order]], "near": near[order]})

    ordered = rows.repartition(partitions(graph.sparkSession), "group").sortWithinPartitions("group")
    found = ordered.mapInArrow(by_group("group", meet), "u long, v long, near float").withColumn("old", F.lit(False))
    return best(graph.withColumn("old", F.lit(True)).unionByName(found), NEIGHBOURS)


def build(vectors: DataFrame, size: int, n: int, longest: float) -> DataFrame:
    """The neighbour graph (u, v, near, old) of vectors (vec_id, v)."""
    first = start(vectors, size, n, longest)
    graph = stash(first.withColumn("old", F.lit(False)), "graph")
    discard(first)
    edges = new = 1
    while True:
        before, graph = graph, stash(improve(graph, vectors, size, longest, new <= FEW * edges), "graph")
        discard(before)
        edges, new = graph.agg(F.count("*"), F.count_if(~F.col("old"))).first()
        if new <= SETTLED * edges:
            return graph


def adjacent(graph: DataFrame, vectors: DataFrame) -> DataFrame:
    """(u, ids, xs): each vector's neighbours and the nearest that have it as neighbour, 2 * NEIGHBOURS at most, with their vectors."""
    rank = F.row_number().over(Window.partitionBy("u").orderBy(F.desc("near"), "v"))
    back = graph.select(F.col("v").alias("u"), F.col("u").alias("v"), "near").withColumn("r", rank).filter(F.col("r") <= 2 * NEIGHBOURS)
    both = graph.select("u", "v", "near", F.lit(0).alias("back")).unionByName(back.select("u", "v", "near", F.lit(1).alias("back")))
    single = both.repartition(partitions(graph.sparkSession), "u").groupBy("u", "v").agg(F.max("near").alias("near"), F.min("back").alias("back"))
    rank = F.row_number().over(Window.partitionBy("u").orderBy("back", F.desc("near"), "v"))
    edges = single.withColumn("r", rank).filter(F.col("r") <= 2 * NEIGHBOURS).select("u", "v")
    full = edges.join(vectors.select(F.col("vec_id").alias("v"), F.col("v").alias("x")).hint("shuffle_hash"), "v")

    def together(rows: pa.Table, edges: list[int]) -> pa.Table:
        raw, _ = _bytes(_only(rows["x"]))
        counts = np.diff(edges)
        return pa.table({"u": rows["u"].to_numpy()[edges[:-1]], "ids": _blobs(counts, rows["v"].to_numpy()), "xs": _blobs(counts, raw.reshape(rows.num_rows, -1))})

    ordered = full.repartition(partitions(graph.sparkSession), "u").sortWithinPartitions("u")
    return ordered.mapInArrow(by_group("u", together), "u long, ids binary, xs binary")


def search(rows: DataFrame, k: int = K, every: int = EVERY) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each row whose vec_id is divisible by every."""
    spark = rows.sparkSession
    short_batches(spark, 10_000, 16 << 20)
    single = stash(clean(rows).filter(F.exists("embedding", lambda x: x != 0)).groupBy("vec_id").agg(F.min("embedding").alias("embedding")), "single")
    square = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    classes = single.groupBy("embedding").agg(F.min("vec_id").alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    sound = single.join(classes, "embedding", "left").select("vec_id", "embedding", F.coalesce("first", "vec_id").alias("first"), square.alias("norm"))
    sound = stash(sound, "sound")
    discard(single)
    firsts = sound.filter("vec_id = first")
    dims, longest, n = firsts.agg(F.max(F.size("embedding")), F.max("norm"), F.count("*")).first()
    size, longest = dims or 0, longest or 1.0
    unit = 1.0 if 1e-12 <= longest <= 1e30 else math.sqrt(longest)  # products fit 32-bit floats
    longest /= unit * unit

    @F.arrow_udf(T.BinaryType())
    def packed(embedding: pa.Array, norm: pa.Array) -> pa.Array:
        """In steps of 1/127 of the vector's largest component; the step and the squared norm follow."""
        out = np.zeros((len(embedding), size), dtype=np.float64)
        for row, x in zip(out, embedding, strict=True):
            row[: len(x)] = x.values.to_numpy()
        steps = np.abs(out).max(axis=1) / 127 if size else np.zeros(len(out))
        tail = np.stack([steps / unit, norm.to_numpy(zero_copy_only=False) / (unit * unit)], axis=1).astype("<f8")
        whole = np.clip(np.round(out / steps[:, None]), -127, 127).astype(np.int8)
        return pa.array([x.tobytes() + t.tobytes() for x, t in zip(whole, tail, strict=True)], pa.binary())

    vectors = stash(firsts.select("vec_id", packed("embedding", "norm").alias("v")), "vectors")
    graph = build(vectors, size, n, longest)
    near_by = stash(adjacent(graph, vectors), "adjacent")
    discard(graph)
    heads = vectors.join(firsts.orderBy(F.desc("norm"), "vec_id").limit(LONGEST).select("vec_id"), "vec_id").orderBy("vec_id").collect()
    long_ids, long_vectors = np.array([r["vec_id"] for r in heads], dtype=np.int64), pa.array([bytes(r["v"]) for r in heads], pa.binary())

    def nearness(q: tuple[np.ndarray, ...], v: tuple[np.ndarray, ...], at: np.ndarray) -> np.ndarray:
        """Inner products of v's rows with those of q that at names."""
        (x, s, _), (y, t, _) = q, v
        return np.clip(np.einsum("ij,ij->i", x[at], y) * (s[at] * t), -FAR, FAR).astype(np.float32)

    def expanded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each asked row of the graph the ids that are nearer to the query than least."""
        for batch in batches:
            for begin in range(0, batch.num_rows, 500):
                rows = batch.slice(begin, 500)
                raw, lengths = _bytes(rows["ids"])
                ids, owner = raw.view("<i8"), np.repeat(np.arange(rows.num_rows), lengths // 8)
                near = nearness(_vectors(rows["q"], size), _vectors(rows["xs"], size), owner)
                query, least = rows["query_id"].to_numpy(), rows["least"].to_numpy()
                keep = (near > least[owner]) & (ids != query[owner])
                counts = np.bincount(owner[keep], minlength=len(query))
                yield pa.record_batch({"query_id": query, "ids": _blobs(counts, ids[keep]), "nears": _blobs(counts, near[keep])})

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Beams with what was found for them; the WIDTH best that weren't expanded before now are. A beam without entries begins with the longest vectors."""
        heads = _vectors(long_vectors, size)
        for batch in batches:
            for begin in range(0, batch.num_rows, 500):
                rows = batch.slice(begin, 500)
                query, many = rows["query_id"].to_numpy(), np.arange(rows.num_rows)
                owner = np.repeat(many, rows["ids"].value_lengths().to_numpy())
                ids, near, done = rows["ids"].flatten().to_numpy(), rows["nears"].flatten().to_numpy(), rows["done"].flatten().to_numpy(zero_copy_only=False)
                now = np.flatnonzero(~done)
                done = done.copy()
                done[now[_places(owner[now]) < WIDTH]] = True
                lists, more = rows["found_ids"], rows["found_nears"]
                raw, lengths = _bytes(lists.flatten())
                found = np.repeat(np.repeat(many, lists.value_lengths().to_numpy()), lengths // 8)
                parts = [(owner, ids, near, done), (found, raw.view("<i8"), _bytes(more.flatten())[0].view("<f4"), np.zeros(len(found), dtype=bool))]
                empty = np.flatnonzero(rows["ids"].value_lengths().to_numpy() == 0)
                if len(empty) and len(long_ids):
                    at, head = np.repeat(empty, len(long_ids)), np.tile(np.arange(len(long_ids)), len(empty))
                    values = nearness(_vectors(rows["q"], size), tuple(c[head] for c in heads), at)
                    other = long_ids[head] != query[at]
                    parts.append((at[other], long_ids[head][other], values[other], np.zeros(other.sum(), dtype=bool)))
                counts, ids, near, done = _nearest(len(query), *(np.concatenate(c) for c in zip(*parts, strict=True)), BEAM)
                yield pa.record_batch({"query_id": query, "q": rows["q"], "ids": _lists(counts, ids), "nears": _lists(counts, near), "done": _lists(counts, done)})

    beams = "query_id long, q binary, ids array<long>, nears array<float>, done array<boolean>"

    def step(beam: DataFrame, asked: DataFrame) -> DataFrame:
        asked = F.broadcast(asked) if asked.count() <= SMALL else asked.hint("shuffle_hash")
        found = near_by.join(asked, "u").select("query_id", "q", "least", "ids", "xs").mapInArrow(expanded, "query_id long, ids binary, nears binary")
        found = found.filter("length(ids) > 0").groupBy("query_id").agg(F.collect_list("ids").alias("found_ids"), F.collect_list("nears").alias("found_nears"))
        none = [F.coalesce(c, F.array().cast("array<binary>")).alias(c) for c in ("found_ids", "found_nears")]
        return beam.join(found, "query_id", "left").select(*beam.columns, *none).mapInArrow(merged, beams)

    asking = sound.filter(F.col("vec_id") % every == 0).select(F.col("first").alias("vec_id")).distinct()
    empty = [F.array().cast(f"array<{kind}>").alias(c) for c, kind in (("ids", "long"), ("nears", "float"), ("done", "boolean"))]
    asked = stash(vectors.join(asking, "vec_id", "left_semi").select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"), *empty), "asked")
    own = asked.select("query_id", "q", F.col("query_id").alias("u"), F.lit(float("-inf")).cast("float").alias("least"))
    beam = stash(step(asked, own), "beam")
    while True:
        open_ids = F.transform(F.filter(F.arrays_zip("ids", "done"), lambda x: ~x["done"]), lambda x: x["ids"])
        least = F.when(F.size("ids") < BEAM, F.lit(float("-inf"))).otherwise(F.try_element_at("nears", F.lit(BEAM))).cast("float")
        chosen = stash(beam.select("query_id", "q", least.alias("least"), F.explode(F.slice(open_ids, 1, WIDTH)).alias("u")), "chosen")
        if chosen.isEmpty():
            break
        before, beam = beam, stash(step(beam, chosen), "beam")
        discard(before)
        discard(chosen)
    for left in (chosen, asked, near_by, vectors):
        discard(left)

    # the k + 1 nearest classes hold the k nearest rows, as each has a row of its own and the query is one row
    pairs = beam.select("query_id", F.explode(F.concat("ids", F.array("query_id"))).alias("vec_id"))
    pairs = pairs.join(sound.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q")), "query_id").join(sound.select("vec_id", "embedding"), "vec_id")
    product = F.aggregate(F.zip_with("q", "embedding", lambda a, b: F.coalesce(a.cast("double") * b.cast("double"), F.lit(0.0))), F.lit(0.0), lambda s, x: s + x)
    scored = pairs.select("query_id", "vec_id", product.alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    nearest = scored.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= k + 1).select("query_id", F.col("vec_id").alias("first"), "score")
    places = F.row_number().over(Window.partitionBy("first").orderBy("vec_id"))
    members = sound.select("first", "vec_id").withColumn("r", places).filter(F.col("r") <= k + 1).drop("r")
    listed = nearest.join(members, "first").withColumn("r", F.row_number().over(order)).filter(F.col("r") <= k + 1)
    listed = listed.groupBy(F.col("query_id").alias("first")).agg(F.sort_array(F.collect_list(F.struct("r", "vec_id", "score"))).alias("of"))
    queries = sound.filter(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), "first")
    others = F.slice(F.filter("of", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    return queries.join(listed, "first").select("query_id", F.posexplode(others).alias("at", "x")).select("query_id", (F.col("at") + 1).alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.score").alias("score"))


def op7_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"))
