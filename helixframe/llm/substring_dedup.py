"""Substring dedup by a count-min prefilter.

A window is WINDOW consecutive words of one text, compared by 96 bits of hashes. The first pass counts every window of
every text in count-min sketches, one a task: ROWS rows of two-bit counters that stop at 3. The sketches travel in blocks, as the gaps between the
counters in use, and are merged by addition that stops at 3 as well, so that a merged counter is never below the smaller of 3 and the number of a
window's places. The second pass reads the texts again and keeps the windows whose smallest counter is 2 or more: all repeated ones, and few others.
They alone are grouped exactly:
1. inside a task each window's places are sorted by document. Places beyond the task's smallest document of that window are decided at
   once, so that a window that a third of all documents share leaves a task as one document's places and not as a third of all rows;
2. what is left is dealt by hash to shards of some million windows at most, in one shuffle of compressed columns. A shard's windows meet in memory,
   are sorted by window and document, and all places beyond a window's smallest document are decided.
Decided places travel as stretches of consecutive windows to shards of documents, and each text is put together again from the words outside them.

The sketch's width follows the number of windows, up to MOST_CELLS counters a row (64 MB in all), which is what makes it fit to be broadcast. Where it is
rather full, another pass counts only what it lets through in a sketch of other hashes, so that at 10^8 distinct windows some 3 in 100 of those that aren't
repeated are kept. From about 3 * 10^8 windows on a sketch of this size would let through nearly all, and is left out: the exact grouping, which
needs no sketch to be right, then has all windows to do, in one shuffle of some 15 bytes a window, spread by their hashes.

Cases: a null text has no words; a text of fewer than WINDOW words has no window and stays whole; a null doc_id counts as
smaller than all others; rows that share a doc_id are one document, so that none of them removes words of another, and each comes
back with its own text's verdicts (told by the text's hash); ties between equal documents therefore stay; texts of any length work, one at a time where
they are long; an empty table gives an empty result. without_repeats passes all other columns through whatever their names.
"""

from __future__ import annotations

import hashlib
import math
import uuid
import zlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bytestext as bt
from .shared import partitions, short_batches, stash, table

WINDOW = 13
#: Rows of the sketch; its counters a row at least and at most; counters a row to a window that are wanted; counters of a block.
ROWS, LEAST_CELLS, MOST_CELLS, ROOMY, BLOCK = 2, 1 << 22, 1 << 27, 2, 1 << 22
#: Sketches in a row at most, and the windows to a counter at which one is enough.
MOST_ROUNDS, ENOUGH = 3, 0.5
#: Windows that a task counts, and those that it keeps, before it passes them on; windows of a shard at most, were all of them kept.
COUNTED, KEPT, SHARD = 1 << 22, 1 << 19, 1 << 22
#: Bytes of text to a word, for the sketch's width and the number of shards only.
WORD_BYTES = 6
SMALLEST = -(1 << 63)

_lane = [np.arange(256, dtype=np.uint16) >> np.uint16(2 * i) & np.uint16(3) for i in range(4)]
#: Sums of four two-bit counters that stop at 3, for each two bytes.
ADDED = np.bitwise_or.reduce([np.minimum(x[:, None] + x[None, :], 3) << np.uint16(2 * i) for i, x in enumerate(_lane)]).astype(np.uint8).ravel()


def windows(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Chunk by chunk: first and end row, the windows' two hashes, their positions and how many each row has."""
    for first, end, flat, offsets in bt.chunks(texts):
        starts, ends, rows = bt.spans(flat, offsets, bt.SOLID)
        words = bt.hash_spans(flat, starts, ends)
        where, counts = bt.gram_rows(rows, WINDOW)
        yield first, end, bt.gram_hashes(words, WINDOW)[where], bt.gram_hashes(bt.mix(words, 5), WINDOW)[where], where - np.repeat(rows[:-1], counts), counts


class Sketch(NamedTuple):
    """A merged sketch as the tasks get it: its blocks, broadcast, and the number of its round, which its hashes depend on."""

    blocks: Broadcast
    name: str
    width: int
    turn: int


def cells(hashes: np.ndarray, row: int, width: int, turn: int) -> np.ndarray:
    """The window's counters in a row of the sketch of a round."""
    return (bt.mix(hashes, 11 + row + ROWS * turn) >> np.uint64(20)) & np.uint64(width - 1)


def gaps(at: np.ndarray) -> bytes:
    """Ascending numbers as bytes: each one's distance from the last, 255 standing for so much and going on."""
    apart = np.diff(at, prepend=0)
    more = apart // 255
    out = np.full(int(more.sum()) + len(at), 255, dtype=np.uint8)
    out[np.cumsum(more + 1) - 1] = apart % 255
    return out.tobytes()


def of_gaps(data: bytes) -> np.ndarray:
    steps = np.frombuffer(data, dtype=np.uint8)
    return np.cumsum(steps, dtype=np.int64)[steps != 255]


def counted(at: np.ndarray) -> np.ndarray:
    """A block in which the counters at the ascending numbers are counted, four to a byte."""
    new = np.flatnonzero(np.diff(at, prepend=-1))
    times, at = np.minimum(np.diff(np.append(new, len(at))), 3), at[new]
    value = times.astype(np.uint8) << (2 * (at & 3)).astype(np.uint8)
    first = np.flatnonzero(np.diff(at >> 2, prepend=-1))
    block = np.zeros(BLOCK // 4, dtype=np.uint8)
    if len(first):
        block[at[first] >> 2] = np.bitwise_or.reduceat(value, first)
    return block


def _of_blocks(number: int, data: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([number], pa.int32()), pa.array([data], pa.binary())], ["block", "counters"])


def sketch_of(docs: DataFrame, width: int, before: Sketch | None = None) -> Sketch:
    """The merged sketch of all windows, or of those that the sketch before estimates repeated."""
    turn = before.turn + 1 if before else 0

    def passed_on(found: list[list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
        for row in range(ROWS):
            at = np.sort(np.concatenate(found[row])).astype(np.int64)
            edges = np.searchsorted(at, np.arange(0, width + 1, BLOCK))
            for i, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
                if b > a:
                    yield _of_blocks(row * (width // BLOCK) + i, gaps(at[a:b] - i * BLOCK))
            found[row].clear()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[list[np.ndarray]] = [[] for _ in range(ROWS)]
        n = 0
        for batch in batches:
            for _, _, hashes, _, _, _ in windows(batch.column(0)):
                if before:
                    hashes = hashes[estimate(before, hashes) >= 2]
                for row in range(ROWS):
                    found[row].append(cells(hashes, row, width, turn).astype(np.uint32))
                n += len(hashes)
                if n >= COUNTED:
                    yield from passed_on(found)
                    n = 0
        if n:
            yield from passed_on(found)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                more = counted(of_gaps(data.as_buffer()))
                sums[block] = ADDED[(sums[block].astype(np.uint16) << np.uint16(8)) | more] if block in sums else more
        for block, counters in sums.items():
            yield _of_blocks(block, zlib.compress(counters, 1))

    kind = "block int, counters binary"
    # a task holds the blocks that are dealt to it once each, however many tasks have counted
    merged = docs.select("text").mapInArrow(count, kind).repartition("block").mapInArrow(merge, kind)
    blocks = [tuple(x) for x in merged.collect()]  # ROWS * width / 4 bytes at most
    return Sketch(docs.sparkSession.sparkContext.broadcast(blocks), uuid.uuid4().hex, width, turn)


_counters: dict[str, list[np.ndarray]] = {}  # of one sketch at most


def counters_of(sketch: Sketch) -> list[np.ndarray]:
    """The rows of a sketch, unpacked once a process."""
    if sketch.name not in _counters:
        _counters.clear()
        rows = [np.zeros(sketch.width // 4, dtype=np.uint8) for _ in range(ROWS)]
        for number, counters in sketch.blocks.value:
            row, i = divmod(number, sketch.width // BLOCK)
            rows[row][i * (BLOCK // 4) : (i + 1) * (BLOCK // 4)] = np.frombuffer(zlib.decompress(counters), dtype=np.uint8)
        _counters[sketch.name] = rows
    return _counters[sketch.name]


def estimate(sketch: Sketch, hashes: np.ndarray) -> np.ndarray:
    least = np.full(len(hashes), 3, dtype=np.uint8)
    for row, counters in enumerate(counters_of(sketch)):
        at = cells(hashes, row, sketch.width, sketch.turn)
        np.minimum(least, counters[at >> np.uint64(2)] >> (2 * (at & np.uint64(3))).astype(np.uint8) & np.uint8(3), out=least)
    return least


def rounds_for(n: int, width: int) -> int:
    """Sketches in a row that pay for n windows: each counts what the one before lets through, as long as that is clearly less; none where the first would let through nearly all."""
    rounds, load = 0, n / width
    while rounds < MOST_ROUNDS:
        through = load * (1 - math.exp(-load)) ** ROWS
        if through > 0.8 * load:
            break
        rounds += 1
        if load <= ENOUGH:
            break
        load = through
    return rounds


def _planes(x: np.ndarray) -> bytes:
    """An array byte by byte of its numbers, the first bytes of all of them together: so like bytes meet."""
    return x.view(np.uint8).reshape(len(x), x.itemsize).T.tobytes()


#: What a shard gets of a task: windows still open by ascending hash (the gaps, 32 more bits, document, position), decided stretches
#: (document, first position, length), and the documents that both name (doc, tag).
_COLUMNS = [[np.uint64, np.uint32, np.uint32, np.uint32], [np.uint32, np.uint32, np.uint32], [np.int64, np.int64]]


def pack(tables: list[list[np.ndarray]]) -> bytes:
    sizes = np.array([len(t[0]) for t in tables], dtype=np.int64).tobytes()
    return zlib.compress(sizes + b"".join(_planes(np.ascontiguousarray(x, dtype=k)) for t, kinds in zip(tables, _COLUMNS, strict=True) for x, k in zip(t, kinds, strict=True)), 1)


def unpack(data: bytes) -> list[list[np.ndarray]]:
    flat = np.frombuffer(zlib.decompress(data), dtype=np.uint8)
    at, tables = 8 * len(_COLUMNS), []
    for n, kinds in zip(flat[:at].view(np.int64).tolist(), _COLUMNS, strict=True):
        table = []
        for kind in kinds:
            wide = np.dtype(kind).itemsize
            table.append(np.ascontiguousarray(flat[at : at + n * wide].reshape(wide, n).T).view(kind).ravel())
            at += n * wide
        tables.append(table)
    return tables


def _settled(a: np.ndarray, b: np.ndarray, doc: np.ndarray, *more: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Which places stand beyond their window's smallest document, and all columns, both by window and document."""
    order = np.lexsort((doc, b, a))
    columns = [x[order] for x in (a, b, doc, *more)]
    a, b, doc = columns[:3]
    new = np.ones(len(a), dtype=bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    at = np.flatnonzero(new)
    return doc > np.repeat(doc[at], np.diff(np.append(at, len(a)))), columns


def _stretches(doc: np.ndarray, tag: np.ndarray, pos: np.ndarray, n: np.ndarray) -> list[np.ndarray]:
    """doc, tag, first position and length of stretches, those that touch as one."""
    order = np.lexsort((pos, tag, doc))
    doc, tag, pos, n = doc[order], tag[order], pos[order], n[order]
    new = np.ones(len(doc), dtype=bool)
    new[1:] = (doc[1:] != doc[:-1]) | (tag[1:] != tag[:-1]) | (pos[1:] > pos[:-1] + n[:-1])
    at = np.flatnonzero(new)
    last = np.append(at[1:], len(doc)) - 1
    return [doc[at], tag[at], pos[at], pos[last] + n[last] - pos[at]] if len(doc) else [doc, tag, pos, n]


def _blob(shard: int, data: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([data], pa.binary())], ["shard", "data"])


def _dealt(found: list[tuple[np.ndarray, ...]], shards: int) -> Iterator[pa.RecordBatch]:
    """Kept windows for each shard: those that a smaller document gathered too has are decided, the others stay open."""
    gone, (a, b, doc, tag, pos) = _settled(*(np.concatenate(x) for x in zip(*found, strict=True)))
    decided = _stretches(doc[gone], tag[gone], pos[gone], np.ones(int(gone.sum()), dtype=np.int64))
    a, b, doc, tag, pos = (x[~gone] for x in (a, b, doc, tag, pos))
    of_open = ((a >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)  # ascends with a
    of_decided = decided[0] % shards
    order = np.argsort(of_decided, kind="stable")
    of_decided, decided = of_decided[order], [x[order] for x in decided]
    opens, closed = (np.searchsorted(x, np.arange(shards + 1)) for x in (of_open, of_decided))
    for k in np.flatnonzero((np.diff(opens) > 0) | (np.diff(closed) > 0)).tolist():
        i, j = slice(opens[k], opens[k + 1]), slice(closed[k], closed[k + 1])
        docs, names = np.unique(np.stack([np.concatenate([doc[i], decided[0][j]]), np.concatenate([tag[i], decided[1][j]])], axis=1), axis=0, return_inverse=True)
        names, n = names.ravel(), i.stop - i.start
        data = pack([[np.diff(a[i], prepend=np.uint64(0)), b[i], names[:n], pos[i]], [names[n:], decided[2][j], decided[3][j]], [docs[:, 0], docs[:, 1]]])
        yield _blob(k, data)


_NO_OPEN = [np.zeros(0, dtype=k) for k in _COLUMNS[0]]


def _decided_in(parts: list[bytes], shards: int) -> Iterator[pa.RecordBatch]:
    """The decided stretches of a shard of windows, for each shard of documents."""
    opened, decided = [], []
    for data in parts:
        (a, b, names, pos), (own, first, n), (doc, tag) = unpack(data)
        opened.append((np.cumsum(a), b, doc[names], tag[names], pos.astype(np.int64)))
        decided.append((doc[own], tag[own], first.astype(np.int64), n.astype(np.int64)))
    gone, (_, _, doc, tag, pos) = _settled(*(np.concatenate(x) for x in zip(*opened, strict=True)))
    decided.append((doc[gone], tag[gone], pos[gone], np.ones(int(gone.sum()), dtype=np.int64)))
    found = _stretches(*(np.concatenate(x) for x in zip(*decided, strict=True)))
    of = found[0] % shards
    order = np.argsort(of, kind="stable")
    found = [x[order] for x in found]
    edges = np.searchsorted(of[order], np.arange(shards + 1))
    for k in np.flatnonzero(np.diff(edges)).tolist():
        doc, tag, pos, n = (x[edges[k] : edges[k + 1]] for x in found)
        docs, names = np.unique(np.stack([doc, tag], axis=1), axis=0, return_inverse=True)
        yield _blob(k, pack([_NO_OPEN, [names.ravel(), pos, n], [docs[:, 0], docs[:, 1]]]))


def _spans_of(parts: list[bytes], _: int) -> Iterator[pa.RecordBatch]:
    """The spans of a shard of documents, a row for each text."""
    decided = []
    for data in parts:
        _, (own, first, n), (doc, tag) = unpack(data)
        decided.append((doc[own], tag[own], first.astype(np.int64), n.astype(np.int64)))
    doc, tag, pos, n = _stretches(*(np.concatenate(x) for x in zip(*decided, strict=True)))
    new = np.ones(len(doc), dtype=bool)
    new[1:] = (doc[1:] != doc[:-1]) | (tag[1:] != tag[:-1])
    at = np.flatnonzero(new)
    spans = pa.StructArray.from_arrays([pa.array(pos.astype(np.int32)), pa.array(n.astype(np.int32))], names=["pos", "n"])
    lists = pa.ListArray.from_arrays(pa.array(np.append(at, len(doc)).astype(np.int32)), spans)
    yield pa.RecordBatch.from_arrays([pa.array(doc[at]), pa.array(tag[at]), lists], ["doc", "tag", "spans"])


def kept_windows(docs: DataFrame, sketch: Sketch | None, shards: int) -> DataFrame:
    """(shard, data) of the windows of (doc, tag, text) rows that the sketch estimates repeated, of all of them without one."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple[np.ndarray, ...]] = []
        n = 0
        for batch in batches:
            doc, tag = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            for first, end, a, b, pos, counts in windows(batch.column(2)):
                kept = np.flatnonzero(estimate(sketch, a) >= 2) if sketch else np.arange(len(a))
                of = np.repeat(np.arange(first, end), counts)[kept]
                found.append((a[kept], (b[kept] >> np.uint64(32)).astype(np.uint32), doc[of], tag[of], pos[kept]))
                n += len(kept)
                if n >= KEPT:
                    yield from _dealt(found, shards)
                    found, n = [], 0
        if n:
            yield from _dealt(found, shards)

    return docs.select("doc", "tag", "text").mapInArrow(look, "shard int, data binary")


def by_shard(rows: DataFrame, shards: int, solve: Callable[[list[bytes], int], Iterator[pa.RecordBatch]], kind: str) -> DataFrame:
    """What solve makes of each shard's data."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[bytes] = []
        now = None
        for batch in batches:
            for shard, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if shard != now and parts:
                    yield from solve(parts, shards)
                    parts = []
                now = shard
                parts.append(data.as_py())
        if parts:
            yield from solve(parts, shards)

    return rows.repartition(min(shards, 2 * partitions(rows.sparkSession)), "shard").sortWithinPartitions("shard").mapInArrow(run, kind)


def _named(docs: DataFrame) -> DataFrame:
    """doc and tag tell texts apart; row holds all of the docs' columns."""
    return docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(SMALLEST)).alias("doc"), F.coalesce(F.xxhash64("text"), F.lit(0)).alias("tag"),
        F.col("text"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
    )


def repeated_spans(docs: DataFrame) -> DataFrame:
    """(doc, tag, spans) of the texts that repeat windows of smaller documents; spans: array of (pos, n), n windows from word pos on."""
    spark = docs.sparkSession
    short_batches(spark)
    named = _named(docs.select("doc_id", "text")).select("doc", "tag", "text")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    width = LEAST_CELLS
    while width < min(MOST_CELLS, ROOMY * size // WORD_BYTES):
        width *= 2
    sketch = None
    for _ in range(rounds_for(size // WORD_BYTES, width)):
        last, sketch = sketch, sketch_of(docs, width, sketch)
        if last:
            last.blocks.destroy()
    shards = max(partitions(spark), size // WORD_BYTES // SHARD + 1)
    kept = kept_windows(named, sketch, shards)
    decided = by_shard(kept, shards, _decided_in, "shard int, data binary")
    out = stash(by_shard(decided, shards, _spans_of, "doc long, tag long, spans array<struct<pos int, n int>>"), "repeats")
    if sketch:
        sketch.blocks.destroy()
    return out


_CUT = T.StructType([T.StructField("text", T.StringType()), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("sha256", T.StringType())])


@F.arrow_udf(_CUT)
def cut(texts: pa.Array, spans: pa.Array) -> pa.Array:
    """The words outside the spans joined by one space, the counts, and the digest of what is left."""
    out: list[list] = [[], [], [], []]
    for text, found in zip(texts, spans, strict=True):
        words = (text.as_py() or "").encode().split()  # at ASCII white space
        n = len(words)
        if found.is_valid:
            pos, more = (found.values.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1))
            cover = np.zeros(n + 1, dtype=np.int64)
            np.add.at(cover, pos, 1)
            np.add.at(cover, pos + more + WINDOW - 1, -1)
            words = [words[i] for i in np.flatnonzero(np.cumsum(cover[:-1]) == 0).tolist()]
        joined = b" ".join(words)
        for column, value in zip(out, (joined.decode(), n, n - len(words), hashlib.sha256(joined).hexdigest()), strict=True):
            column.append(value)
    return pa.StructArray.from_arrays([pa.array(x, k) for x, k in zip(out, (pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=_CUT.names)


def _marked(docs: DataFrame) -> DataFrame:
    spans = repeated_spans(docs)
    # one way at every size: texts with repeats grow with the texts
    return _named(docs).join(spans.hint("merge"), ["doc", "tag"], "left")


def without_repeats(docs: DataFrame) -> DataFrame:
    """docs; a text that repeats windows of smaller documents becomes its other words joined by one space, all others stay as they are."""
    marked = _marked(docs)
    text: Column = F.when(F.col("spans").isNull(), F.col("row.text")).otherwise(cut("text", "spans")["text"])
    return marked.select(*[text.alias(c) if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns])


def op12_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = _marked(docs).select("row.doc_id", cut("text", "spans").alias("cut"))
    return found.select("doc_id", "cut.n_words", "cut.n_removed", F.col("cut.sha256").alias("kept_sha256"))


ORACLE_SQL = f"""
WITH split AS (
  SELECT doc_id, coalesce(doc_id, {SMALLEST}) AS doc, row_number() OVER () AS r,
         regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words
  FROM documents),
windows AS (
  SELECT r, doc, i, array_to_string(words[i:i + {WINDOW - 1}], ' ') AS win
  FROM (SELECT r, doc, words, unnest(range(1, len(words) - {WINDOW - 2})) AS i FROM split WHERE len(words) >= {WINDOW})),
firsts AS (SELECT win, min(doc) AS first_doc FROM windows GROUP BY win HAVING min(doc) < max(doc)),
gone AS (
  SELECT DISTINCT r, unnest(range(i, i + {WINDOW})) AS i FROM windows JOIN firsts USING (win) WHERE doc > first_doc),
placed AS (SELECT r, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS i FROM split),
kept AS (
  SELECT p.r, count(*) FILTER (g.i IS NOT NULL) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY p.i) FILTER (g.i IS NULL), '') AS text
  FROM placed p LEFT JOIN gone g ON p.r = g.r AND p.i = g.i GROUP BY p.r)
SELECT s.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(k.text, '')) AS kept_sha256
FROM split s LEFT JOIN kept k ON s.r = k.r
"""
