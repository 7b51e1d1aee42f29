"""Periodic run detection by recompression.

A run is a stretch of consecutive words with smallest period q (words q apart are identical), of at least LEAST words and at least
two periods, that no neighbouring word extends keeping the period.

The texts of a batch are numbered word by word and parsed together into a run-length grammar, level by level: block compression
replaces each stretch of one repeated symbol by a new symbol, pair compression splits the symbols into left and right ones and replaces
each left-right pair; equal stretches are parsed alike but for their ends. The longest common extension of two positions climbs the levels
while the symbols ahead agree, and descends where they first differ, with at most one step on each level. Extensions to the left are
those of the mirrored grammar. A run of period p holds a multiple i of p with equal words at i and i + p, so that the
candidates are the places of that harmonic grid, n log n in all: those at which fewer words agree than any run needs are left out, and the
grammar answers the exact extensions of the others. A stretch found with several periods has the smallest.

All texts of a batch share each of these numpy steps; the grammar is built of the texts with candidates only. A text is looked at by one task,
and nothing is shuffled. Memory follows the batch's words, or those of the one text that is longer; candidates are settled MOST_CANDIDATES at a time.

Cases: a null text and one without words have no run, and an empty collapsed text; a null doc_id is passed on; ties between runs
of equal length go to the smaller start; repeated rows have equal results; texts of one word repeated work at any length; an empty
table gives an empty result. find_runs passes all other columns through whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bytestext as bt
from .shared import short_batches, table

LEAST = 12
#: Equal neighbours that a candidate of any period has at least, itself among them: max(p, LEAST - p).
NEAR = LEAST // 2
MOST_CANDIDATES = 1 << 20
#: Words of a batch that are parsed together, about.
TOGETHER = 400_000
#: Ways to split the symbols that pair compression tries on each level.
SPLITS = 3


class Level(NamedTuple):
    """Symbols of one level; length: words under each; parent: each one's place on the level above; first: the first place under each place of the level above, and an end; blocks: how the level above came about."""

    symbols: np.ndarray
    length: np.ndarray
    parent: np.ndarray
    first: np.ndarray
    blocks: bool

    def mirrored(self) -> Level:
        n, above = len(self.symbols), len(self.first) - 1
        return Level(self.symbols[::-1], self.length[::-1], above - 1 - self.parent[::-1], n - self.first[::-1], self.blocks)


def _number(*parts: np.ndarray) -> np.ndarray:
    """Equal numbers for equal rows of the parts."""
    out = parts[0].astype(np.int64)
    for more in parts[1:]:
        out = np.unique(out * (int(more.max()) + 1) + more, return_inverse=True)[1].ravel()
    return out


def _above(symbols: np.ndarray, length: np.ndarray, starts: np.ndarray, new: np.ndarray, blocks: bool) -> tuple[Level, np.ndarray, np.ndarray]:
    """The level whose places from starts on become the symbols new, with those and their lengths."""
    first = np.append(starts, len(symbols))
    parent = np.repeat(np.arange(len(starts)), np.diff(first))
    return Level(symbols, length, parent, first, blocks), new, np.add.reduceat(length, starts)


def grammar(words: np.ndarray) -> tuple[list[Level], np.ndarray]:
    """The levels of a text's grammar and the symbols on top, which are all different."""
    symbols, length, levels = np.unique(words, return_inverse=True)[1].ravel(), np.ones(len(words), dtype=np.int64), []
    while np.bincount(symbols).max() > 1:
        starts = np.flatnonzero(np.diff(symbols, prepend=-1))
        if len(starts) < len(symbols):
            times = np.diff(np.append(starts, len(symbols)))
            level, symbols, length = _above(symbols, length, starts, _number(symbols[starts], times), True)
            levels.append(level)
            continue
        best, seed = symbols[:0], 0
        while seed < SPLITS or not len(best):
            side = (bt.mix(symbols.astype(np.uint64), len(levels) * 101 + seed) >> np.uint64(40)) & np.uint64(1)
            for left in (0, 1):
                pairs = np.flatnonzero((side[:-1] == left) & (side[1:] != left))
                best = max(best, pairs, key=len)
            seed += 1
        second = np.zeros(len(symbols) + 1, dtype=np.int64)
        second[best + 1] = 1
        starts = np.flatnonzero(second[:-1] == 0)
        pair = second[starts + 1]
        other = np.where(pair == 1, symbols[np.minimum(starts + 1, len(symbols) - 1)] + 1, 0)
        level, symbols, length = _above(symbols, length, starts, _number(symbols[starts], other), False)
        levels.append(level)
    return levels, symbols


def common(levels: list[Level], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many words agree from the words a and b on; a < b, and some word from either on stands nowhere else."""
    a, b, agree = a.copy(), b.copy(), np.zeros(len(a), dtype=np.int64)
    stopped = np.full(len(a), len(levels))
    up = np.arange(len(a))
    for n, level in enumerate(levels):
        x, y = a[up], b[up]
        s, first, parent = level.symbols, level.first, level.parent
        inside = np.flatnonzero((first[parent[x]] != x) | (first[parent[y]] != y))
        if len(inside):
            k, x, y = up[inside], x[inside], y[inside]
            left, right = first[parent[x] + 1] - x, first[parent[y] + 1] - y
            step = np.where(s[x] == s[y], np.minimum(left, right) if level.blocks else 1, 0)
            agree[k] += step * level.length[x]
            a[k], b[k] = x + step, y + step
            ended = (step == 0) | (level.blocks & (left != right))
            stopped[k[ended]] = n
            going = np.ones(len(up), dtype=bool)
            going[inside[ended]] = False
            up = up[going]
        a[up], b[up] = parent[a[up]], parent[b[up]]
    for n in range(len(levels) - 1, -1, -1):
        level = levels[n]
        k = np.flatnonzero(stopped > n)
        s, first = level.symbols, level.first
        x, y = first[a[k]], first[b[k]]
        both = np.minimum(first[a[k] + 1] - x, first[b[k] + 1] - y) if level.blocks else 1
        step = np.where(s[x] == s[y], both, 0)
        agree[k] += step * level.length[x]
        a[k], b[k] = x + step, y + step
    return agree


def grid(words: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(place, period) of equal words a period apart at the multiples of each period up to most, about MOST_CANDIDATES at a time."""
    places: list[np.ndarray] = []
    periods: list[int] = []
    n = 0
    for p in range(1, most + 1):
        at = np.flatnonzero(words[:-p:p] == words[p::p]) * p
        if len(at):
            places.append(at)
            periods.append(p)
            n += len(at)
        if n >= MOST_CANDIDATES:
            yield np.concatenate(places), np.repeat(periods, [len(x) for x in places])
            places, periods, n = [], [], 0
    if n:
        yield np.concatenate(places), np.repeat(periods, [len(x) for x in places])


def likely(words: np.ndarray, at: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Which candidates have NEAR equal neighbours or more, themselves among them."""
    total = np.ones(len(at), dtype=np.int64)
    for way in (1, -1):
        alive = np.arange(len(at))
        for step in range(1, NEAR):
            x = at[alive] + way * step
            y = x + p[alive]
            alive = alive[(x >= 0) & (y < len(words))]
            x = at[alive] + way * step
            alive = alive[words[x] == words[x + p[alive]]]
            total[alive] += 1
    return np.flatnonzero(total >= NEAR)


def runs_of(words: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text, start, length and period of all runs, by text, start and period, of texts of numbered words; at: where each begins, and an end."""
    sizes = np.diff(at)
    # each text gets a word of its own before it, and the last one after it as well, so that no stretch leaves its text
    place = np.arange(len(words)) + np.repeat(np.arange(len(sizes)), sizes) + 1
    apart = np.full(len(words) + len(sizes) + 1, -1, dtype=np.int64)
    apart[place] = words
    fences = np.flatnonzero(apart < 0)
    apart[fences] = -1 - np.arange(len(fences))
    found: list[tuple[np.ndarray, ...]] = []
    built, levels, mirrored, moved = np.zeros(len(sizes), dtype=bool), [], [], np.zeros(0)
    for i, p in grid(apart, int(sizes.max(initial=0)) // 2):
        text = np.searchsorted(fences, i) - 1
        keep = np.flatnonzero((text >= 0) & (text == np.searchsorted(fences, i + p) - 1))
        keep = keep[likely(apart, i[keep], p[keep])]
        if not len(keep):
            continue
        i, p, text = i[keep], p[keep], text[keep]
        if not built[text].all():
            built[:] = False
            built[text] = True
            used = np.repeat(np.append(built, False), np.diff(np.append(fences, len(apart))))
            used[fences[1:]] |= built  # the word after a text
            moved = np.cumsum(used) - 1
            levels, _ = grammar(apart[used])
            mirrored = [x.mirrored() for x in levels]
        ahead = common(levels, moved[i], moved[i + p])
        size = int(moved[-1])
        behind = common(mirrored, size - moved[i + p] + 1, size - moved[i] + 1)
        start, length = i - behind, ahead + behind + p
        keep = length >= np.maximum(LEAST, 2 * p)
        found.append((text[keep], (start - fences[text] - 1)[keep], length[keep], p[keep]))
    if not found:
        none = np.zeros(0, dtype=np.int64)
        return none, none, none, none
    text, start, length, p = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.lexsort((p, length, start, text))
    text, start, length, p = text[order], start[order], length[order], p[order]
    new = np.ones(len(text), dtype=bool)
    new[1:] = (text[1:] != text[:-1]) | (start[1:] != start[:-1]) | (length[1:] != length[:-1])
    text, start, length, p = text[new], start[new], length[new], p[new]
    order = np.lexsort((p, start, text))
    return text[order], start[order], length[order], p[order]


def _together(texts: pa.Array) -> Iterator[list[list[bytes]]]:
    """The words of the texts, as many texts at a time as hold about TOGETHER words."""
    batch: list[list[bytes]] = []
    n = 0
    for text in texts:
        words = (text.as_py() or "").encode().split()  # at ASCII white space
        batch.append(words)
        n += len(words) + 1
        if n >= TOGETHER:
            yield batch
            batch, n = [], 0
    if batch:
        yield batch


_RUN = T.StructType([T.StructField(x, T.LongType()) for x in ("start", "length", "period")])
_FOUND = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("runs", T.ArrayType(_RUN)), T.StructField("collapsed", T.StringType())])


@F.arrow_udf(_FOUND)
def runs_and_rest(texts: pa.Array) -> pa.Array:
    """The runs of each text by start and period, and its words but for those that a run contains after its first period, joined by one space."""
    sizes, each, rest = [], [], []
    columns: list[list[np.ndarray]] = [[], [], []]
    for batch in _together(texts):
        numbers: dict[bytes, int] = {}
        counts = np.array([len(x) for x in batch], dtype=np.int64)
        words = np.fromiter((numbers.setdefault(w, len(numbers)) for text in batch for w in text), dtype=np.int64, count=int(counts.sum()))
        text, start, length, period = runs_of(words, bt.bounds(counts))
        edges = np.searchsorted(text, np.arange(len(batch) + 1))
        for k, own in enumerate(batch):
            a, b = edges[k], edges[k + 1]
            if a < b:
                cover = np.zeros(len(own) + 1, dtype=np.int64)
                np.add.at(cover, start[a:b] + period[a:b], 1)
                np.add.at(cover, start[a:b] + length[a:b], -1)
                own = [own[i] for i in np.flatnonzero(np.cumsum(cover[:-1]) == 0).tolist()]
            rest.append(b" ".join(own).decode())
        sizes.extend(counts.tolist())
        each.extend(np.diff(edges).tolist())
        for column, values in zip(columns, (start, length, period), strict=True):
            column.append(values)
    values = pa.StructArray.from_arrays([pa.array(np.concatenate(x) if x else np.zeros(0, dtype=np.int64)) for x in columns], names=_RUN.names)
    runs = pa.ListArray.from_arrays(pa.array(bt.bounds(np.array(each, dtype=np.int64)).astype(np.int32)), values)
    return pa.StructArray.from_arrays([pa.array(sizes, pa.int64()), runs, pa.array(rest, pa.string())], names=_FOUND.names)


def find_runs(docs: DataFrame, text: str = "text") -> DataFrame:
    """(row, found): each row of docs as a struct of all its columns, and its text's n_words, runs and collapsed text."""
    short_batches(docs.sparkSession)
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), runs_and_rest(F.col(f"`{text}`")).alias("found"))


def repeat_tail(doc_id: Column, text: Column) -> Column:
    """One text in ten with its end replaced by a stretch of it repeated, where and how long by the checksum of its doc_id."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10)
    words = F.array_remove(F.split(text, "[\\x20\\x09-\\x0D]+"), "")
    n = F.size(words)
    a = g % n
    p = 1 + F.floor((n - a) / (3 + g % 8))
    as_int = lambda c: c.cast("int")
    tail = F.flatten(F.array_repeat(F.slice(words, as_int(a + 1), as_int(p)), as_int(F.ceil((n - a) / p))))
    whole = F.concat(F.slice(words, F.lit(1), as_int(a)), F.slice(tail, F.lit(1), as_int(n - a)))
    return F.when((h % 10 == 0) & (n > 0), F.array_join(whole, " ")).otherwise(text)


def op13_period_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    docs = docs.select("doc_id", repeat_tail(F.col("doc_id"), F.col("text")).alias("text"))
    found = find_runs(docs).select("row.doc_id", "found.runs", "found.collapsed")
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256")
    ).select(
        "doc_id", "n_runs", (-F.col("best.start")).alias("start"), "best.length", (-F.col("best.period")).alias("period"),
        F.expr("(1000 * best.length) div (-best.period)").alias("exponent_milli"), "runs_sha256", "collapsed_sha256",
    )
