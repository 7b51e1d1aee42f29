"""Best-fit packing: patterns of few documents, fitted to the histogram of lengths by non-negative least squares.

Only the histogram of piece lengths (as many rows as a sequence has tokens at most) comes to the driver. There, patterns of
one to MOST_IN_PATTERN lengths that fill a sequence as well as the lengths present allow are enumerated, repeat counts
are fitted to the histogram by non-negative least squares, rounded down, and what is left is packed by best-fit
decreasing on counts, into the room of the patterns first. Patterns take no more than a few documents, so that they are
tried from several fills on, and best-fit decreasing alone too (all it takes where all lengths are short): the plan with
the fewest sequences counts. All of this grows with the number of distinct lengths and not with the number of documents. The plan gives each length ranges of ranks; a piece's rank among those of its length
comes from counts by (length, salt) and its place in its own salt, so that no length makes a task large.

Cases: a null or empty text is its end id alone, of length 1; only documents longer than a sequence are cut, so that all
pieces but the first are full; repeated rows are packed each on its own; a null doc_id is allowed; an empty table gives
an empty result. Only doc_id and text are read, so other columns can't clash.
"""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bytestext as bt
from .segments import encoder
from .shared import short_batches, stash, table
from .token_files import vocabulary

SIZE, END = 2048, 0
MOST_IN_PATTERN, PARTNERS, ROUNDS = 6, 24, 200
#: Plans are tried with the patterns that fill at least such a share of a sequence; with none where it is over 1.
FILLS = (1.0, 2.0, 0.98, 0.9, 0.0)
#: A salt holds about so many pieces.
SALT_ROWS = 50_000


def cut_pieces(path: str, size: int, end: int):
    """A UDF from text to its pieces' lengths and checksums."""

    @F.arrow_udf(T.ArrayType(T.StructType([T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType())])))
    def pieces(texts: pa.Array) -> pa.Array:
        lengths, sums, each = [], [], []
        for values, counts in encoder(path).encode(texts):
            at = bt.bounds(counts)
            for a, b in zip(at[:-1], at[1:], strict=True):
                ids = np.append(values[a:b], 0).astype("<u4")
                ids[-1] = end
                cuts = [0, *range((len(ids) - 1) % size + 1, len(ids) + 1, size)]
                each.append(len(cuts) - 1)
                for x, y in zip(cuts[:-1], cuts[1:], strict=True):
                    lengths.append(y - x)
                    sums.append(zlib.crc32(ids[x:y].tobytes()))
        rows = pa.StructArray.from_arrays([pa.array(lengths, pa.int64()), pa.array(sums, pa.int64())], ["length", "ids_crc32"])
        return pa.ListArray.from_arrays(pa.array(bt.bounds(np.array(each, dtype=np.int64)).astype(np.int32)), rows)

    return pieces


def enumerate_patterns(counts: np.ndarray) -> np.ndarray:
    """Rows of MOST_IN_PATTERN lengths, descending and padded with 0: counts[n] pieces have length n, and a sequence len(counts) - 1 tokens.

    From each length as the largest: with each of some second lengths spread over those that fit, then by the largest length that fits.
    """
    size = len(counts) - 1
    present = np.flatnonzero(counts)
    fits = np.zeros(size + 1, dtype=np.int64)  # the largest length present of at most n; 0 if none
    fits[present] = present
    fits = np.maximum.accumulate(fits)
    first, second = [], []
    for n in present:
        able = present[present <= min(n, size - n)]
        picked = able[np.unique(np.linspace(0, len(able) - 1, PARTNERS).astype(int))] if len(able) else able
        second += [0, *picked.tolist()]
        first += [n] * (1 + len(picked))
    rows = np.zeros((len(first), MOST_IN_PATTERN), dtype=np.int64)
    rows[:, 0], rows[:, 1] = first, second
    room = size - rows[:, 0] - rows[:, 1]
    for k in range(2, MOST_IN_PATTERN):
        rows[:, k] = np.where(rows[:, 1] > 0, fits[np.minimum(room, size)], 0)
        room = room - rows[:, k]
    return np.unique(-np.sort(-rows, axis=1), axis=0)


def fit_repeats(patterns: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Non-negative repeat counts whose use of lengths comes nearest to counts, by multiplicative updates of least squares, weighted by the patterns' fill."""
    target = counts.astype(float)
    target[0] = 0
    fill = patterns.sum(axis=1) / (len(counts) - 1)
    used = patterns > 0
    worth = fill**8  # patterns that waste room start low
    gain = np.where(used, target[patterns], 0).sum(axis=1)
    x = worth * gain / np.maximum(used.sum(axis=1), 1) / PARTNERS
    for _ in range(ROUNDS):
        made = np.bincount(patterns.ravel(), weights=np.repeat(x, patterns.shape[1]), minlength=len(counts))
        pull = np.where(used, made[patterns], 0).sum(axis=1)
        x = np.where(pull > 0, x * gain / np.maximum(pull, 1e-12), 0.0)
    return x


def plan(counts: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """(lengths, repeats) of all sequences that hold counts[n] pieces of each length n."""
    left = counts.copy()
    left[0] = 0
    size = len(counts) - 1
    out = [((size,), int(left[size]))] if left[size] else []
    left[size] = 0
    if not left.any():
        return out
    patterns = enumerate_patterns(left)
    fills = patterns.sum(axis=1) / size
    least = -(-int(left @ np.arange(size + 1)) // size)
    best, tried = None, set()
    for fill in FILLS:
        able = patterns[fills >= fill]
        if len(able) in tried:
            continue
        tried.add(len(able))
        found = best_fit(*repeat(able, left), size)
        number = sum(repeats for _, repeats in found)
        if best is None or number < best[0]:
            best = number, found
        if number == least:
            break
    return out + best[1]


def repeat(patterns: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, list[tuple[tuple[int, ...], int]]]:
    """The counts that are left over by patterns at their fitted repeats, and (lengths, repeats) of these."""
    left, out = counts.copy(), []
    repeats = fit_repeats(patterns, left) if len(patterns) else np.zeros(0)
    for k in np.argsort(-repeats, kind="stable"):
        wanted = int(repeats[k])
        if not wanted:
            break
        lengths, each = np.unique(patterns[k][patterns[k] > 0], return_counts=True)
        fit = min(wanted, int((left[lengths] // each).min()))
        if fit:
            left[lengths] -= fit * each
            out.append((tuple(int(n) for n in patterns[k] if n), fit))
    return left, out


def best_fit(counts: np.ndarray, begun: list[tuple[tuple[int, ...], int]], size: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing on counts, into the sequences begun and new ones: equal sequences with equal room are one entry with their number."""
    open_: dict[int, list[list]] = defaultdict(list)  # by room: [number, lengths]
    rooms = np.zeros(size + 1, dtype=bool)

    def put(number: int, lengths: tuple[int, ...], room: int) -> None:
        if number:
            open_[room].append([number, lengths])
            rooms[room] = True

    for lengths, repeats in begun:
        put(repeats, lengths, size - sum(lengths))
    for n in np.flatnonzero(counts)[::-1]:
        n, c = int(n), int(counts[n])
        while c:
            able = np.flatnonzero(rooms[n:])
            if not len(able):
                per = size // n
                full, rest = divmod(c, per)
                put(full, (n,) * per, size - per * n)
                put(1 if rest else 0, (n,) * rest, size - rest * n)
                break
            # once in the tightest room, the next of this length finds the same sequence the tightest
            room = n + int(able[0])
            group = open_[room][-1]
            each = min(room // n, c)
            take = min(c // each, group[0])
            group[0] -= take
            if not group[0]:
                open_[room].pop()
                rooms[room] = bool(open_[room])
            put(take, (*group[1], *(n,) * each), room - each * n)
            c -= take * each
    merged: dict[tuple[int, ...], int] = defaultdict(int)
    for groups in open_.values():
        for number, lengths in groups:
            merged[lengths] += number
    return sorted(merged.items(), reverse=True)


def places(planned: list[tuple[tuple[int, ...], int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each range of ranks, in order: its length, first rank, the sequence of that rank and the offset inside the sequence."""
    rows, sequence, used = [], 0, defaultdict(int)
    for lengths, repeats in planned:
        offset = 0
        for n in lengths:
            rows.append((n, used[n], sequence, offset))
            used[n] += repeats
            offset += n
        sequence += repeats
    rows.sort()
    return tuple(np.array(x, dtype=np.int64) for x in zip(*rows, strict=True)) if rows else (np.zeros(0, dtype=np.int64),) * 4


def dealt(pieces: DataFrame, salts: int) -> DataFrame:
    """pieces with a salt, by the number of the row, so that rows that repeat one another are dealt out like all others."""
    return pieces.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(salts)))


def pack_pieces(pieces: DataFrame, size: int = SIZE) -> DataFrame:
    """pieces, which has doc_id, piece, length, ids_crc32 and row, a number of its own for each row, with sequence_id and offset."""
    found = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # size rows at most
    counts = np.zeros(size + 1, dtype=np.int64)
    counts[list(found)] = list(found.values())
    length_of, rank_of, sequence_of, offset_of = places(plan(counts))

    @F.arrow_udf(T.StructType([T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())]))
    def placed(lengths: pa.Array, ranks: pa.Array) -> pa.Array:
        n, r = (np.asarray(x, dtype=np.int64) for x in (lengths, ranks))
        at = np.searchsorted((length_of << 44) + rank_of, (n << 44) + r, side="right") - 1
        return pa.StructArray.from_arrays([pa.array(sequence_of[at] + r - rank_of[at]), pa.array(offset_of[at])], ["sequence_id", "offset"])

    salts = max(16, int(counts.sum()) // SALT_ROWS)
    salted = dealt(pieces, salts)
    by_salt = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = salted.withColumn("place", F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32", "row")))
    ranked = ranked.join(by_salt.select("length", "salt", before.alias("before")), ["length", "salt"])
    where = placed("length", F.col("before") + F.col("place") - 1)
    return ranked.withColumn("where", where).select(*[c for c in pieces.columns if c != "row"], "where.*")


def pack(docs: DataFrame, path: str, size: int = SIZE, end: int = END) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of all pieces of docs, which has doc_id and text."""
    short_batches(docs.sparkSession)
    cut = docs.select("doc_id", cut_pieces(path, size, end)("text").alias("pieces"))
    cut = cut.select("doc_id", F.posexplode("pieces").alias("piece", "p"), F.col("pieces")[0]["length"].alias("head"))
    start = F.when(F.col("piece") == 0, F.lit(0)).otherwise(F.col("head") + (F.col("piece") - 1) * size).cast("long")
    row = F.monotonically_increasing_id().alias("row")  # written, and so the same whenever it's read
    return pack_pieces(stash(cut.select("doc_id", "piece", start.alias("start"), "p.length", "p.ids_crc32", row), "pieces"), size)


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), vocabulary())
