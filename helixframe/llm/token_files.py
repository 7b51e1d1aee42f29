"""Token files: frequency-ranked ids in byte-aligned variable-length coding with separate control bytes.

Ids are counted over all documents and ranked, the most frequent first. A rank takes one to four bytes, little-endian;
two bits of a control byte give its length less one, four ranks to a control byte. A block holds whole documents in
ascending order: their ids' counts, the control bytes and the data bytes; blocks are rows of Parquet files in the shared
folder, and the ranking is a file beside them. Decoding looks up each control byte's four lengths in a table and
gathers all data bytes of a block at once.

Documents are dealt to ranges in the order of doc_id, then of a hash of the ids, then of a row number, so that a doc_id (or
null) that many rows share is split too. The cuts are quantiles, by bytes of ids, of a sample of these keys alone: they
decide where files end and nothing else. There are as many ranges as shuffle partitions, and more where a range would
pass RANGE_BYTES; file k holds range k. Where a document's ids begin is a sum over the ranges, then over the blocks of a
range, then inside a block.

Cases: a null or empty text is the end id alone; rows with a null doc_id come first; rows with one doc_id are ordered by
their ids' hash, and equal rows come back as often as they were; a text longer than a block has one of its own; an empty
table gives an empty result. Only doc_id and text are read, so other columns can't clash.
"""

from __future__ import annotations

import bisect
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bytestext as bt
from .segments import encoder
from .shared import partitions, short_batches, stash, stash_path, table

END = 2
#: A block ends with the document that brings it to so many ids.
BLOCK_IDS = 1 << 18
#: A range holds about so many bytes of ids at most.
RANGE_BYTES = 64 << 20
#: Keys sampled for each cut.
SAMPLED = 100
#: Ranges at most, however many ids there are (each then holds more), and keys sampled at most.
MOST_RANGES, MOST_KEYS = 20_000, 400_000
LENGTHS = ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3) + 1


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def token_ids(path: str, end: int):
    """A UDF from text to its ids and the end id, as little-endian unsigned 32-bit integers."""

    @F.arrow_udf(T.BinaryType())
    def ids(texts: pa.Array) -> pa.Array:
        out: list[bytes] = []
        for values, counts in encoder(path).encode(texts):
            at = bt.bounds(counts)
            out += [np.append(values[a:b], values.dtype.type(end)).astype("<u2" if end < 1 << 16 and values.dtype == np.uint16 else "<u4").tobytes() for a, b in zip(at[:-1], at[1:], strict=True)]
        return pa.array(out, pa.binary())

    return ids


def width(path: str, end: int) -> int:
    """Bytes an id takes in the intermediate table."""
    return 2 if encoder(path).kind == np.uint16 and end < 1 << 16 else 4


def count_ids(tokens: DataFrame, size: int) -> DataFrame:
    """(id, n) over all rows' ids of size bytes each."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, dtype=np.int64)
        for batch in batches:
            for part in batch.column(0):
                if part.is_valid:
                    found = np.bincount(np.frombuffer(part.as_buffer(), dtype=f"<u{size}"))
                    if len(found) > len(total):
                        found[: len(total)] += total
                        total = found
                    else:
                        total[: len(found)] += found
        ids = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(total[ids])], ["id", "n"])

    return tokens.select("ids").mapInArrow(counted, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


#: Stands for a null doc_id in keys of ranges.
NO_ID = -(1 << 63)


def range_cuts(tokens: DataFrame, parts: int) -> list[tuple[int, bool, int, int]]:
    """The keys (doc_id, whether it has one, hash, row) at which parts - 1 ranges end, with about equal bytes of ids between them."""
    if parts < 2:
        return []
    share = min(1.0, min(SAMPLED * parts, MOST_KEYS) / max(1, tokens.count()))
    found = tokens.select("doc_id", "h", "row", "size").sample(share, seed=1).collect()  # about MOST_KEYS rows at most
    keys = sorted(((NO_ID if r["doc_id"] is None else r["doc_id"], r["doc_id"] is not None, r["h"], r["row"]), r["size"]) for r in found)
    before = np.cumsum([size for _, size in keys])
    at = np.searchsorted(before, before[-1] * np.arange(1, parts) / parts) if keys else []
    return sorted({keys[i][0] for i in at})


def pack_ranks(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of the ranks."""
    ranks = ranks.astype("<u4")
    size = 1 + (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    codes = np.zeros(-(-len(ranks) // 4) * 4, dtype=np.uint8)
    codes[: len(ranks)] = size - 1
    control = codes.reshape(-1, 4) << np.array([0, 2, 4, 6], dtype=np.uint8)
    data = ranks.view(np.uint8).reshape(-1, 4)[np.arange(4) < size[:, None]]
    return np.bitwise_or.reduce(control, axis=1).tobytes(), data.tobytes()


def unpack_ranks(control: np.ndarray, data: np.ndarray, n: int) -> np.ndarray:
    """The n ranks, by table lookup of the control bytes."""
    size = LENGTHS[control].reshape(-1)[:n]
    at = np.cumsum(size) - size
    out = data[at].astype(np.uint32)
    for k in (1, 2, 3):
        more = np.flatnonzero(size > k)
        if not len(more):
            break
        out[more] |= data[at[more] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


_BLOCKS = "part int, inside long, doc_ids array<long>, counts array<int>, n long, control binary, data binary"


def write_files(docs: DataFrame, path: str, end: int = END) -> tuple[str, list[int]]:
    """Encode all texts and write the files. Returns the files' path and the ids by rank."""
    spark = docs.sparkSession
    short_batches(spark)
    size, parts = width(path, end), partitions(spark)
    texts = docs.select("doc_id", token_ids(path, end)("text").alias("ids"), F.monotonically_increasing_id().alias("row"))
    tokens = stash(texts.select("doc_id", "row", F.xxhash64("ids").alias("h"), F.length("ids").alias("size"), "ids"), "ids")
    counts = count_ids(tokens, size).orderBy(F.desc("n"), "id").collect()  # as many rows as the vocabulary has at most
    ranked = [r["id"] for r in counts]
    rank_of = np.zeros(max(ranked, default=0) + 1, dtype=np.uint32)
    rank_of[ranked] = np.arange(len(ranked))
    parts = min(MOST_RANGES, max(parts, math.ceil(sum(r["n"] for r in counts) * size / RANGE_BYTES)))
    cuts = range_cuts(tokens, parts)
    cut_docs = np.array([c[0] for c in cuts], dtype=np.int64)

    def range_of(doc_ids: pa.Array, hashes: pa.Array, rows: pa.Array) -> np.ndarray:
        docs_ = doc_ids.fill_null(NO_ID).to_numpy(zero_copy_only=False)
        low, high = (np.searchsorted(cut_docs, docs_, side=side) for side in ("left", "right"))
        for i in np.flatnonzero(low < high).tolist():  # a document at a cut
            low[i] = bisect.bisect_left(cuts, (int(docs_[i]), doc_ids[i].is_valid, hashes[i].as_py(), rows[i].as_py()))
        return low

    @F.arrow_udf(T.StructType([T.StructField("part", T.IntegerType()), T.StructField("n", T.IntegerType()), T.StructField("control", T.BinaryType()), T.StructField("data", T.BinaryType())]))
    def coded(doc_ids: pa.Array, hashes: pa.Array, rows: pa.Array, ids: pa.Array) -> pa.Array:
        part = range_of(doc_ids, hashes, rows)
        found, sizes = [], []
        for x in ids:
            ranks = rank_of[np.frombuffer(x.as_buffer(), dtype=f"<u{size}")]
            found.append(pack_ranks(ranks))
            sizes.append(len(ranks))
        return pa.StructArray.from_arrays(
            [pa.array(part, pa.int32()), pa.array(sizes, pa.int32()), pa.array([c for c, _ in found], pa.binary()), pa.array([d for _, d in found], pa.binary())],
            ["part", "n", "control", "data"],
        )

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, inside, held, total = None, 0, [], 0  # inside: ids of this range before the block

        def ended() -> pa.RecordBatch:
            sizes = np.array([h[1] for h in held])
            codes = [((np.frombuffer(h[2], dtype=np.uint8)[:, None] >> np.array([0, 2, 4, 6], dtype=np.uint8)) & 3).reshape(-1)[: h[1]] for h in held]
            flat = np.concatenate(codes)
            flat = np.append(flat, np.zeros(-len(flat) % 4, dtype=np.uint8)).reshape(-1, 4) << np.array([0, 2, 4, 6], dtype=np.uint8)
            row = {"part": [part], "inside": [inside], "doc_ids": [[h[0] for h in held]], "counts": [sizes.tolist()], "n": [int(sizes.sum())],
                   "control": [np.bitwise_or.reduce(flat, axis=1).tobytes()], "data": [b"".join(h[3] for h in held)]}
            return pa.RecordBatch.from_pydict(row, pa.schema([("part", pa.int32()), ("inside", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("counts", pa.list_(pa.int32())), ("n", pa.int64()), ("control", pa.binary()), ("data", pa.binary())]))

        for batch in batches:
            for p, doc, n, control, data in zip(*(batch.column(i) for i in range(5)), strict=True):
                if held and (p.as_py() != part or total >= BLOCK_IDS):
                    yield ended()
                    inside, held, total = inside + total, [], 0
                if p.as_py() != part:
                    part, inside = p.as_py(), 0
                held.append((doc.as_py(), n.as_py(), control.as_py(), data.as_py()))
                total += held[-1][1]
        if held:
            yield ended()

    rows = tokens.select("doc_id", "h", "row", coded("doc_id", "h", "row", "ids").alias("c"))
    rows = rows.select(F.col("c.part").alias("part"), "doc_id", F.col("c.n").alias("n"), F.col("c.control").alias("control"), F.col("c.data").alias("data"), "h", "row")
    ordered = rows.repartitionById(parts, "part").sortWithinPartitions("part", F.col("doc_id").asc_nulls_first(), "h", "row").drop("h", "row")
    files = stash_path(spark, "token-files")
    ordered.mapInArrow(blocks, _BLOCKS).write.option("compression", "zstd").parquet(f"{files}/blocks")
    spark.createDataFrame([(i, x) for i, x in enumerate(ranked)], "rank int, id long").write.parquet(f"{files}/ranks")
    return files, ranked


def read_files(spark: SparkSession, files: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of every document: ids as little-endian unsigned 32-bit integers."""
    ids = np.array([r["id"] for r in spark.read.parquet(f"{files}/ranks").orderBy("rank").collect()], dtype="<u4")
    stored = spark.read.schema(_BLOCKS).parquet(f"{files}/blocks")
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = stored.groupBy("part").agg(F.sum("n").alias("n")).select("part", before.alias("before"))  # a row for each range

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, doc_ids, counts, control, data in zip(*(batch.column(i) for i in range(5)), strict=True):
                sizes = counts.values.to_numpy().astype(np.int64)
                at = bt.bounds(sizes)
                control, data = (np.frombuffer(x.as_buffer(), dtype=np.uint8) for x in (control, data))
                found = ids[unpack_ranks(control, data, int(at[-1]))]
                yield pa.RecordBatch.from_arrays(
                    [doc_ids.values, pa.array(at[:-1] + begin.as_py()), pa.array(sizes), pa.array([found[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)], pa.binary())],
                    ["doc_id", "start", "n_tokens", "ids"],
                )

    # ranges has MOST_RANGES rows at most
    joined = stored.join(F.broadcast(ranges), "part").select((F.col("before") + F.col("inside")).alias("begin"), "doc_ids", "counts", "control", "data")
    return joined.mapInArrow(decoded, "doc_id long, start long, n_tokens long, ids binary")


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    files, _ = write_files(table(spark, sf_dir, "documents"), vocabulary())
    return read_files(spark, files).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
