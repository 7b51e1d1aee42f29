"""MinHash near-dedup by a multi-index Hamming join over b-bit signatures.

A document's set holds its distinct 5-word shingles. Its signature has SLOTS min-hashes of BITS bits each. Two sets of
similarity 0.75 differ in a quarter of the slots on average; the signature-distance threshold MAX_DIFFERENT lies 4.6
standard deviations above, so that about one pair in 10^5 at exactly 0.75 is beyond it, and far fewer above. By the
pigeonhole principle, of the CHUNKS chunks of CHUNK slots at least one has at most one differing slot, as
MAX_DIFFERENT < 2 * CHUNKS. All errors a chunk may have are enumerated as index keys: the chunk without one of its
slots, each in turn. So all pairs within the threshold share a key.

Work follows links and not pairs:
1. documents with equal sets become one class (an aggregation); classes that share a bucket with another are candidates,
   and only their texts are read again, for their full sets;
2. in rounds, each bucket's smallest document is its hub, each candidate is confirmed against the smallest hub of its
   buckets, and components are found; the next round leaves out what is in the hub's component. This takes groups of near
   copies together with one pair a document and round;
3. in buckets that still hold several components, the documents outside the bucket's largest component meet all of the bucket that are
   in other components; all pairs within MAX_DIFFERENT are confirmed on full sets, and components found again. Pairs inside a component are never made;
4. where more than FEW documents stand outside the largest component (variants of one text that mostly aren't similar
   enough), a pair for each two would be a quadratic table. Documents that such buckets connect are one group; a group is
   dealt to blocks of sets of like sizes, and those outside meet the group block by block: one product of two matrices counts all common
   shingles of two blocks exactly, and only links are given out. A document travels once for each block of the others and not once a pair.

Components are found by alternating minimum steps over edges (joins and aggregations), each written to the shared
folder. Nothing is collected. Joins are plain sort-merge joins, which the adaptive planner splits where a key is hot.

Cases: null and empty texts have no shingles, n_shingles 0, and are linked with nothing; with fewer than five words the
whole sequence is the one shingle; repeated doc_ids are one document (its rows' sets count as members of one
component and each row comes back); a null doc_id is a document of its own that isn't linked and is kept; an empty table
gives an empty result. remove_near_copies passes all other columns through whatever their names.
"""

from __future__ import annotations

import gc
from collections.abc import Iterator
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bytestext as bt
from .shared import discard, short_batches, stash, table

WORDS, NUMERATOR, DENOMINATOR = 5, 75, 100
SLOTS, BITS, CHUNK = 64, 16, 4
#: Documents outside a bucket's largest component that still meet the bucket as a whole, and documents of a bucket to one salt.
FEW, SALT_ROWS = 32, 4096
#: Bands of set sizes grow by this factor; similar sets lie at most APART bands apart. A block holds about so many sets and shingles at most.
BAND, APART = 1.1, 4
BLOCK_SETS, BLOCK_SHINGLES = 512, 1 << 20
ROUNDS = 3
CHUNKS = SLOTS // CHUNK
MAX_DIFFERENT = 2 * CHUNKS - 1
LONGS = SLOTS * BITS // 64
_FACTORS = bt.mix(np.arange(1, SLOTS + 1, dtype=np.uint64), 1) | np.uint64(1)
_SHIFTS = bt.mix(np.arange(1, SLOTS + 1, dtype=np.uint64), 2)


def shingle_sets(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Chunk by chunk: the distinct shingle hashes of the rows one after another, ascending in each row, and the rows' counts."""
    for _, _, flat, offsets in bt.chunks(texts):
        flat = bt.LOWER[flat]
        starts, ends, rows = bt.spans(flat, offsets, bt.SOLID)
        words = bt.hash_spans(flat, starts, ends)
        grams = bt.gram_hashes(words, WORDS)
        where, counts = bt.gram_rows(rows, WORDS)
        values = grams[where]
        owners = np.repeat(np.arange(len(counts)), counts)
        few = np.flatnonzero((np.diff(rows) > 0) & (np.diff(rows) < WORDS))
        if len(few):
            whole = np.array([bt.gram_hashes(words[rows[i] : rows[i + 1]], int(rows[i + 1] - rows[i]))[0] for i in few], dtype=np.uint64)
            values, owners = np.concatenate([values, whole]), np.concatenate([owners, few])
        order = np.lexsort((values, owners))
        values, owners = values[order], owners[order]
        new = np.ones(len(values), dtype=bool)
        new[1:] = (values[1:] != values[:-1]) | (owners[1:] != owners[:-1])
        yield values[new], np.bincount(owners[new], minlength=len(counts))


def signatures(values: np.ndarray, counts: np.ndarray, slots: int, bits: int) -> np.ndarray:
    """A row of slots * bits / 64 64-bit integers for each row that has shingles."""
    at = bt.bounds(counts[counts > 0])
    out = np.zeros((len(at) - 1, slots), dtype=np.uint64)
    low = 0
    while low < len(at) - 1:
        high = max(low + 1, int(np.searchsorted(at, at[low] + 50_000, side="right")) - 1)
        part, edges = values[at[low] : at[high]], at[low:high] - at[low]
        for j in range(slots):
            out[low:high, j] = np.minimum.reduceat(part * _FACTORS[j] + _SHIFTS[j], edges)
        low = high
    out = (out >> np.uint64(20)) & np.uint64((1 << bits) - 1)
    return np.bitwise_or.reduce(out.reshape(len(out), -1, 64 // bits) << (np.arange(64 // bits, dtype=np.uint64) * np.uint64(bits)), axis=2)


def _sum_by_row(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    sums = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(values)))
    at = bt.bounds(counts)
    return sums[at[1:]] - sums[at[:-1]]


FULL = [f"s{i}" for i in range(LONGS)]
_NAMES = ["n", "a", "b", *FULL]


def _longs(parts: list[np.ndarray]) -> pa.Array:
    return pa.array(np.ascontiguousarray(np.concatenate(parts) if parts else np.zeros(0, dtype=np.int64)).astype(np.uint64).view(np.int64))


@F.arrow_udf(T.StructType([T.StructField(x, T.LongType()) for x in _NAMES]))
def describe(texts: pa.Array) -> pa.Array:
    """Set size, a 128-bit digest of the set, and the signature."""
    parts: list[list[np.ndarray]] = [[] for _ in _NAMES]
    for values, counts in shingle_sets(texts):
        sig = np.zeros((len(counts), LONGS), dtype=np.uint64)
        if len(values):
            sig[counts > 0] = signatures(values, counts, SLOTS, BITS)
        for part, x in zip(parts, [counts, _sum_by_row(bt.mix(values, 5), counts), _sum_by_row(bt.mix(values, 6), counts), *sig.T], strict=True):
            part.append(x)
    return pa.StructArray.from_arrays([_longs(p) for p in parts], _NAMES)


@F.arrow_udf(T.BinaryType())
def full_sets(texts: pa.Array) -> pa.Array:
    """The distinct shingle hashes, ascending, as bytes."""
    out: list[bytes] = []
    for values, counts in shingle_sets(texts):
        at = bt.bounds(counts)
        out += [values[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)]
    return pa.array(out, pa.binary())


def common_counts(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many shingles each two of the sets have in common, exactly."""
    both = np.intersect1d(np.concatenate(left), np.concatenate(right))
    out = np.zeros((len(left), len(right)), dtype=np.float32)  # whole numbers under 2^24
    if not len(both):
        return out

    def cells(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(x) for x in sets])
        at = np.minimum(np.searchsorted(both, flat), len(both) - 1)
        hit = both[at] == flat
        order = np.argsort(at[hit], kind="stable")
        return at[hit][order], owner[hit][order]

    sides = cells(left), cells(right)
    for low in range(0, len(both), 4096):
        parts = []
        for (at, owner), n in zip(sides, out.shape, strict=True):
            a, b = np.searchsorted(at, (low, low + 4096))
            matrix = np.zeros((n, min(4096, len(both) - low)), dtype=np.float32)
            matrix[owner[a:b], at[a:b] - low] = 1
            parts.append(matrix)
        out += parts[0] @ parts[1].T
    return out


def block_links(asking: pa.Table, having: pa.Table) -> pa.Table:
    """(u, v): the links between the documents of two blocks (doc_id, c, set) that are in different components."""
    if not asking.num_rows or not having.num_rows:
        return pa.table({"u": pa.array([], pa.int64()), "v": pa.array([], pa.int64())})
    (ids, cs, sets), (ids_, cs_, sets_) = (
        (t["doc_id"].to_numpy(), t["c"].to_numpy(), [np.frombuffer(x.as_buffer(), dtype=np.uint64) for x in t["set"]]) for t in (asking, having)
    )
    both = common_counts(sets, sets_).astype(np.int64)
    total = np.array([len(x) for x in sets])[:, None] + np.array([len(x) for x in sets_])[None]
    at, at_ = np.nonzero((DENOMINATOR * both >= NUMERATOR * (total - both)) & (cs[:, None] != cs_[None]))
    return pa.table({"u": pa.array(ids[at]), "v": pa.array(ids_[at_])})


@F.arrow_udf(T.LongType())
def common(left: pa.Array, right: pa.Array) -> pa.Array:
    """Sizes of the sets' intersections."""
    out = []
    for x, y in zip(left, right, strict=True):
        x, y = (np.frombuffer(v.as_buffer(), dtype=np.uint64) for v in (x, y))
        x, y = (x, y) if len(x) < len(y) else (y, x)
        at = np.minimum(np.searchsorted(y, x), len(y) - 1)
        out.append(int(np.count_nonzero(y[at] == x)))
    return pa.array(out, pa.int64())


def index_keys(sig: list[Column]) -> Column:
    """One key for each chunk and each of its slots, made of the chunk's other slots."""
    keys = []
    for i in range(CHUNKS):  # a chunk of four 16-bit slots is one 64-bit integer of the signature
        for j in range(CHUNK):
            keys.append(F.xxhash64(F.lit(i * CHUNK + j), sig[i].bitwiseAND(F.lit(_signed(~(0xFFFF << (BITS * j)))))))
    return F.array(*keys)


def _signed(x: int) -> int:
    x &= 0xFFFFFFFFFFFFFFFF
    return x - (1 << 64) if x >> 63 else x


def different_slots(left: str, right: str) -> Column:
    """The distance of two signatures in slots."""
    apart = [F.col(f"{left}.{name}").bitwiseXOR(F.col(f"{right}.{name}")) for name in FULL]
    return reduce(add, [(x.bitwiseAND(F.lit(_signed(0xFFFF << (BITS * j)))) != 0).cast("int") for x in apart for j in range(CHUNK)])


def similar_sizes(left: Column, right: Column) -> Column:
    return DENOMINATOR * F.least(left, right) >= NUMERATOR * F.greatest(left, right)


def bucket_pairs(placed: DataFrame, stats: DataFrame, heads: DataFrame) -> DataFrame:
    """(u, v): the pairs of different components, one of them outside its bucket's largest, that are within MAX_DIFFERENT.

    placed: key, doc_id, c; stats: key, n, largest of the buckets in question; heads: doc_id, n and signature. The bucket as a whole is
    dealt to salts, and each of the few others goes to all of them.
    """
    salts = F.ceil(F.col("size") / SALT_ROWS).cast("int")
    rows = placed.join(stats.select("key", F.col("n").alias("size"), "largest"), "key").join(heads.select("doc_id", "n", *FULL), "doc_id")
    few = rows.filter(F.col("c") != F.col("largest")).withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1)))
    whole = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id"), salts).cast("int"))
    p, q = few.alias("p"), whole.alias("q")
    meet = (F.col("p.key") == F.col("q.key")) & (F.col("p.salt") == F.col("q.salt")) & (F.col("p.c") != F.col("q.c"))
    near = similar_sizes(F.col("p.n"), F.col("q.n")) & (different_slots("p", "q") <= MAX_DIFFERENT)
    return p.join(q, meet & near).select(F.least("p.doc_id", "q.doc_id").alias("u"), F.greatest("p.doc_id", "q.doc_id").alias("v")).distinct()


def group_links(placed: DataFrame, hot: DataFrame, sets: DataFrame) -> DataFrame:
    """(u, v): the links between different components among documents that hot buckets connect. placed: key, doc_id, c; hot: key, largest."""
    rows = placed.join(hot.select("key", "largest"), "key")
    firsts = rows.groupBy("key").agg(F.min("doc_id").alias("v"))
    groups = components(rows.join(firsts, "key").select(F.col("doc_id").alias("u"), "v"))
    members = rows.groupBy("doc_id").agg(F.first("c").alias("c"), F.max(F.col("c") != F.col("largest")).alias("outside"))
    members = members.join(groups, "doc_id", "left").withColumn("group", F.coalesce("component", "doc_id"))
    size = (F.length("set") / 8).cast("long")
    members = members.join(sets, "doc_id").select("doc_id", "c", "outside", "group", "set", size.alias("size"), F.floor(F.log(size.cast("double")) / F.log(F.lit(BAND))).alias("band"))
    members = stash(members, "grouped")

    def dealt(side: DataFrame) -> tuple[DataFrame, DataFrame]:
        """The side's documents with their block in group and band, and the blocks' numbers."""
        room = F.greatest(F.ceil(F.count("*") / BLOCK_SETS), F.ceil(F.sum("size") / BLOCK_SHINGLES))
        counts = stash(side.groupBy("group", "band").agg(room.alias("blocks")), "blocks")
        return side.join(counts, ["group", "band"]).withColumn("block", F.pmod(F.xxhash64("doc_id", F.lit(5)), "blocks")).drop("blocks"), counts

    (asking, left), (having, right) = dealt(members.filter("outside")), dealt(members.toDF(*(f"_{c}" for c in members.columns)).toDF(*members.columns))
    near = F.explode(F.sequence(F.col("band") - APART, F.col("band") + APART)).alias("to")
    meets = left.select("group", "band", "blocks", near).join(right.select("group", F.col("band").alias("to"), F.col("blocks").alias("others")), ["group", "to"])
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    key = ["group", "band", "block", "to", "other"]
    asking = asking.join(meets.select("group", "band", "to", "others"), ["group", "band"]).withColumn("other", each("others")).select(*key, "doc_id", "c", "set")
    having = having.withColumnsRenamed({"band": "to", "block": "other"}).join(meets.select("group", "band", "to", "blocks"), ["group", "to"]).withColumn("block", each("blocks")).select(*key, "doc_id", "c", "set")
    drop = lambda t: t.select(["doc_id", "c", "set"])
    return asking.groupBy(*key).cogroup(having.groupBy(*key)).applyInArrow(lambda a, b: block_links(drop(a), drop(b)), "u long, v long")


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (u, v) whose full sets are similar enough. sets: doc_id, set."""
    left = pairs.join(sets.select(F.col("doc_id").alias("u"), F.col("set").alias("x")), "u")
    both = left.join(sets.select(F.col("doc_id").alias("v"), F.col("set").alias("y")), "v")
    both = both.select("u", "v", ((F.length("x") + F.length("y")) / 8).cast("long").alias("total"), common("x", "y").alias("both"))
    return both.filter(DENOMINATOR * F.col("both") >= NUMERATOR * (F.col("total") - F.col("both"))).select("u", "v")


def labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """rows (key, doc_id) with c, the document's component."""
    return stash(rows.join(labels, "doc_id", "left").select("key", "doc_id", F.coalesce("component", "doc_id").alias("c")), "labelled")


def components(edges: DataFrame) -> DataFrame:
    """(doc_id, component): the smallest document that each document of edges (u, v) is linked with, over any steps.

    Each round replaces every edge by edges to smaller documents: first each document's larger neighbours go to its
    smallest neighbour, then its smaller neighbours and itself do. Rounds end when all edges are stars.
    """
    now = stash(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct(), "edges")
    while True:
        ways = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = ways.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = ways.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = stash(large, "edges")
        small_least = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(small_least, "u")
        small = stash(moved.select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).filter("u <> v").distinct(), "edges")
        discard(now)
        discard(large)
        roles = small.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(small.select(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
        roles = roles.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
        if roles.filter("up > 1 OR up = 1 AND down = 1").isEmpty():
            return small.select(F.col("u").alias("doc_id"), F.col("v").alias("component"))
        now = small


def link(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of docs, which has doc_id and text."""
    short_batches(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    known = stash(docs.select("doc_id", describe("text").alias("d")).select("doc_id", "d.*"), "signatures")
    classes = known.filter("n > 0 AND doc_id IS NOT NULL").groupBy("n", "a", "b").agg(
        F.min(F.struct("doc_id", *FULL)).alias("r")
    )
    heads = stash(classes.select("n", "a", "b", "r.*"), "heads")
    keys = index_keys([F.col(c) for c in FULL])
    keyed = heads.select(F.explode(keys).alias("key"), "doc_id")
    hubs = keyed.groupBy("key").agg(F.min("doc_id").alias("hub"), F.max("doc_id").alias("top")).filter("hub <> top").select("key", "hub")
    shared = stash(keyed.join(hubs, "key"), "buckets")
    candidates = shared.select("doc_id").distinct()
    sets = stash(docs.join(candidates, "doc_id", "left_semi").select("doc_id", full_sets("text").alias("set")), "sets")

    # rows that share a doc_id are one document, so their classes are linked
    member = stash(known.join(heads.select("n", "a", "b", F.col("doc_id").alias("head")), ["n", "a", "b"], "left").select("doc_id", "n", F.when(F.col("doc_id").isNotNull(), F.col("head")).alias("head")), "members")
    twice = member.groupBy("doc_id").agg(F.min("head").alias("low"), F.max("head").alias("high")).filter("low <> high").select("doc_id", "low")
    own = member.join(twice, "doc_id").filter("head <> low").select(F.col("head").alias("u"), F.col("low").alias("v"))
    links, rows = own, shared.select("key", "doc_id", F.col("doc_id").alias("c"))
    for _ in range(ROUNDS):
        hubs = rows.groupBy("key").agg(F.min(F.struct("doc_id", "c")).alias("h"))
        rest = stash(rows.join(hubs, "key").filter(F.col("c") != F.col("h.c")).select("key", "doc_id", F.col("h.doc_id").alias("hub")), "rest")
        pairs = stash(rest.groupBy("doc_id").agg(F.min("hub").alias("hub")).select(F.col("hub").alias("u"), F.col("doc_id").alias("v")), "hub-pairs")
        labels = components(links.unionByName(confirmed(pairs, sets)))
        discard(pairs)
        links = labels.select(F.col("doc_id").alias("u"), F.col("component").alias("v"))
        rows = labelled(rest.select("key", "doc_id"), labels)
        discard(rest)
        gc.collect()  # lets go of plans, and so of their shuffle files
    placed = labelled(shared.select("key", "doc_id"), labels)
    discard(shared)
    parts = placed.groupBy("key", "c").agg(F.count("*").alias("m"))
    stats = parts.groupBy("key").agg(F.sum("m").alias("n"), F.max(F.struct("m", "c")).alias("top"), F.count("*").alias("parts")).filter("parts > 1")
    stats = stash(stats.select("key", "n", F.col("top.c").alias("largest"), (F.col("n") - F.col("top.m")).alias("outside")), "stats")
    pairs = bucket_pairs(placed, stats.filter(F.col("outside") <= FEW), heads)
    found = links.unionByName(confirmed(stash(pairs, "pairs"), sets))
    hot = stats.filter(F.col("outside") > FEW)
    if not hot.isEmpty():
        found = found.unionByName(group_links(placed, hot, sets))
    labels = components(found)
    ended = member.join(labels.select(F.col("doc_id").alias("head"), "component"), "head", "left")
    return ended.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "head", "doc_id").alias("component_id"))


def remove_near_copies(docs: DataFrame) -> DataFrame:
    """docs with the smallest document of each component only."""
    gone = link(docs).filter("doc_id <> component_id").select(F.col("doc_id").alias("__gone__")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["__gone__"], "left_anti")


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link(table(spark, sf_dir, "documents")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


ORACLE_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, md5(s) AS s FROM (
    SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
      ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM words)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
pairs AS (
  SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (
  SELECT u, v FROM pairs JOIN sizes x ON u = x.doc_id JOIN sizes y ON v = y.doc_id WHERE 100 * c >= 75 * (x.n + y.n - c)),
reach AS (
  SELECT doc_id AS u, doc_id AS v FROM documents UNION SELECT r.u, l.v FROM reach r JOIN links l ON r.v = l.u)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, r.c AS component_id, d.doc_id = r.c AS kept
FROM documents d LEFT JOIN sizes s ON d.doc_id = s.doc_id JOIN (SELECT u, min(v) AS c FROM reach GROUP BY u) r ON r.u = d.doc_id
"""
