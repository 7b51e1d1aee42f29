"""Conversation structure repair by a run-length DP.

Turns of a conversation, by turn (nulls first), become symbols of a role (system, user, assistant or other, by its initial) and a fault
(none, truncated, blank, duplicate). The cheapest edits that leave roles of the form (s?(ua)+)? come from a DP over four states (nothing yet, after
the system's, a user's, an assistant's turn): each symbol is a min-plus matrix of the costs between states, its insertions included.
Equal consecutive symbols are collapsed to runs; a run is one application of the binary powers of its matrix, which a task keeps, to the costs behind
it. The audit is unrolled from the first state on, by the least letter that keeps the cost, through halves of runs that are remembered.

Costs: Keep 0, Rerole to user or assistant 2, Delete 3 (all that blank and duplicate turns can have), Insert an empty turn of user or assistant 2;
a truncated turn that stays adds 1. Of audits of equal cost the ASCII-least counts.

At scale: equal turns at one place are counted before they are shuffled; whether role and text were seen earlier comes from each text's first
turn (an aggregation and a join, which the adaptive planner splits where a text is hot), texts told by 128 bits of hashes. Symbols are dealt by ranges of (conversation, turn),
so a conversation with a third of all turns spreads over many tasks, and leaves them as runs: what then meets in one task is one byte
and one count a run, no more than its audit, which is one value of the result. Repaired turns are written by a pass over the turns of each
conversation in order, in bounded memory (a digest of them has to be taken in order). Nothing is collected.

Cases: a null role or text is one space, hence no known role and a blank text; a null turn comes first and leaves no gap; a null conv_id
is a conversation of its own; turns of one number are ordered by role, then by the text's hash; repeated rows follow one another, and all but the first
are duplicates; a conversation without rows has zeros, an empty audit and the digest of nothing; an empty text is blank; texts of any length work; an
empty table gives an empty result. Only conv_id, turn, role and text are read, so other columns can't clash.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import discard, partitions, short_batches, stash, table

WHITE = " \t\n\x0b\x0c\r"
SOLID = r"[^\x20\x09-\x0D]"
#: Faults as they stand in a symbol, beside four times the place of the role's initial in ROLES (3: none of them).
NONE, TRUNCATED, BLANK, DUPLICATE = range(4)
ROLES = "sua"
LEGAL = {(0, 1), (1, 2), (2, 1)}
#: States: nothing yet, after the system's, after a user's, after an assistant's turn.
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = (USER, USER, ASSISTANT, USER)
REROLE, DELETE, INSERT, LEFT_TRUNCATED = 2, 3, 2, 1
NEVER = 1 << 40
#: Costs behind the last turn: the insertions that are still needed.
BEHIND = (0, 2 * INSERT, INSERT, 0)

Costs = tuple[int, int, int, int]


def kept(symbol: int, state: int) -> int | None:
    """The state after the turn is kept."""
    role = symbol // 4
    if symbol % 4 >= BLANK or role > 2:
        return None
    return (SYSTEM if state == START else None) if role == 0 else (USER if state != USER else None) if role == 1 else (ASSISTANT if state == USER else None)


def edits(symbol: int, state: int) -> Iterator[tuple[str, int, int]]:
    """(letter, cost, state after it) of the edits that a turn can have, by letter."""
    yield "D", DELETE, state
    if symbol % 4 < BLANK:
        cost = LEFT_TRUNCATED * (symbol % 4 == TRUNCATED)
        after = kept(symbol, state)
        if after is not None:
            yield "K", cost, after
        yield "R", REROLE + cost, NEXT[state]


@functools.cache
def power(symbol: int, k: int) -> tuple[Costs, ...]:
    """The costs between states over 2^k turns of one symbol."""
    if k:
        half = power(symbol, k - 1)
        return tuple(tuple(min(min(half[i][m] + half[m][j] for m in range(4)), NEVER) for j in range(4)) for i in range(4))
    bare = [[min((c for _, c, after in edits(symbol, i) if after == j), default=NEVER) for j in range(4)] for i in range(4)]
    rows = []
    for i in range(4):
        ways = [(0, i), (INSERT, NEXT[i]), (2 * INSERT, NEXT[NEXT[i]])]  # a third insertion would come back to a state
        rows.append(tuple(min(cost + bare[m][j] for cost, m in ways) for j in range(4)))
    return tuple(rows)


def before(symbol: int, times: int, behind: Costs) -> Costs:
    """The costs to the end from each state before a run, from those behind it."""
    k = 0
    while times:
        if times & 1:
            behind = tuple(min(step + cost for step, cost in zip(row, behind, strict=True)) for row in power(symbol, k))
        times >>= 1
        k += 1
    return behind


@functools.lru_cache(maxsize=1 << 14)
def choices(symbol: int, times: int, behind: Costs, state: int) -> tuple[str, int]:
    """The letters of a run from a state on, and the state behind it."""
    if times > 1:
        half = 1 << (times - 1).bit_length() - 1
        first, middle = choices(symbol, times - half, level(before(symbol, half, behind)), state)
        second, end = choices(symbol, half, behind, middle)
        return first + second, end
    ahead, letters = before(symbol, 1, behind), ""
    while True:
        ways = {letter: after for letter, cost, after in edits(symbol, state) if cost + behind[after] == ahead[state]}
        if "D" not in ways and INSERT + ahead[NEXT[state]] == ahead[state]:
            letters, state = letters + "I", NEXT[state]
            continue
        letter = min(ways)
        return letters + letter, ways[letter]


def level(costs: Costs) -> Costs:
    """Costs without what they have in common, so that equal choices are remembered as one."""
    least = min(costs)
    return tuple(min(c - least, NEVER) for c in costs)


def audit_of(runs: list[tuple[int, int]]) -> tuple[int, str]:
    """The least cost of a conversation's runs of symbols, and its audit."""
    behind: list[Costs] = [BEHIND]
    cost = 0
    for symbol, times in reversed(runs):
        ahead = before(symbol, times, behind[-1])
        cost += min(ahead)
        behind.append(level(ahead))
    state, parts = START, []
    for (symbol, times), after in zip(runs, reversed(behind[:-1]), strict=True):
        letters, state = choices(symbol, times, after, state)
        parts.append(letters)
    return cost + behind[-1][START], "".join(parts) + "I" * (BEHIND[state] // INSERT)


def illegal_pairs(runs: list[tuple[int, int]]) -> int:
    inside = sum(times - 1 for _, times in runs)
    return inside + sum((a // 4, b // 4) not in LEGAL for (a, _), (b, _) in zip(runs[:-1], runs[1:], strict=True))


def merged(parts: list[dict]) -> list[tuple[int, int]]:
    """The runs of a conversation from those of its parts."""
    runs: list[tuple[int, int]] = []
    for part in sorted(parts, key=lambda x: (x["part"], x["seq"])):
        for symbol, times in zip(part["symbols"], part["times"], strict=True):
            if runs and runs[-1][0] == symbol:
                runs[-1] = symbol, runs[-1][1] + times
            elif times:
                runs.append((symbol, times))
    return runs


def damage(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copies) of the rows that are left after one in five is damaged, by the checksum of its conversation and turn."""
    name = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    kind = F.crc32(F.concat(name[0], F.lit(":"), name[1]).cast("binary")) % 20
    role, text = (F.coalesce(F.col(c), F.lit(" ")) for c in ("role", "text"))
    return rows.withColumn("kind", kind).filter("kind != 0").select(
        "conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(role).alias("role"),
        F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.when(F.col("kind") == 3, 2).otherwise(1).alias("copies"),
    )


def turns_of(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copies) of undamaged rows."""
    role, text = (F.coalesce(F.col(c), F.lit(" ")).alias(c) for c in ("role", "text"))
    return rows.select("conv_id", "turn", role, text, F.lit(1).alias("copies"))


ORDER = ["conv_id", "turn", "role", "a", "b"]


def _hashed(turns: DataFrame) -> DataFrame:
    return turns.withColumns({"a": F.xxhash64("text"), "b": F.xxhash64(F.lit("turn"), F.col("text"))})


def symbols(turns: DataFrame) -> DataFrame:
    """(ORDER, symbol, rest, more): each distinct turn's symbol, and that of the more turns that repeat it."""
    solid = F.col("text").rlike(SOLID)
    ended = F.substring(F.rtrim("text", F.lit(WHITE)), -1, 1).isin(".", "!", "?")
    fault = F.when(~solid, BLANK).when(ended, NONE).otherwise(TRUNCATED)
    once = _hashed(turns).groupBy(*ORDER, fault.alias("fault")).agg(F.sum("copies").alias("n"))
    place = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    firsts = once.groupBy(F.col("conv_id").alias("f_conv"), F.col("role").alias("f_role"), F.col("a").alias("f_a"), F.col("b").alias("f_b")).agg(F.min(place).alias("first"))
    same = F.col("conv_id").eqNullSafe(F.col("f_conv")) & (F.col("role") == F.col("f_role")) & (F.col("a") == F.col("f_a")) & (F.col("b") == F.col("f_b"))
    role = F.col("role")
    initial = F.lit(4) * F.when(role.startswith("s"), 0).when(role.startswith("u"), 1).when(role.startswith("a"), 2).otherwise(3)
    again = F.when(F.col("fault") == BLANK, BLANK).otherwise(DUPLICATE)
    first = F.when(~F.col("turn").eqNullSafe(F.col("first.turn")), again).otherwise(F.col("fault"))
    return once.join(firsts, same).select(*ORDER, (initial + first).cast("int").alias("symbol"), (initial + again).cast("int").alias("rest"), (F.col("n") - 1).alias("more"))


def _new(values: pa.Array) -> np.ndarray:
    """Where a value differs from the one before it; nulls are equal."""
    new = np.ones(len(values), dtype=bool)
    if len(values) > 1:
        a, b = values[1:], values[:-1]
        differ = pc.fill_null(pc.not_equal(a, b), False).to_numpy(zero_copy_only=False)
        new[1:] = differ | (pc.is_null(a).to_numpy(zero_copy_only=False) != pc.is_null(b).to_numpy(zero_copy_only=False))
    return new


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(conv_id, part, seq, symbols, times) of ordered (conv_id, symbol, rest, more) rows: the runs of each conversation in each batch."""
    part, seq = TaskContext.get().partitionId(), 0
    for batch in batches:
        conv = batch.column(0)
        starts = np.flatnonzero(_new(conv))
        if not len(starts):
            continue
        first, rest, more = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (1, 2, 3))
        value, times = (np.stack(x, axis=1).ravel() for x in ((first, rest), (np.ones(len(first), dtype=np.int64), more)))
        filled = np.flatnonzero(times)
        own = np.zeros(2 * len(first), dtype=bool)
        own[2 * starts] = True
        value, times, own = value[filled], times[filled], own[filled]
        new = own.copy()
        new[1:] |= value[1:] != value[:-1]
        at = np.flatnonzero(new)
        edges = np.append(np.flatnonzero(own[at]), len(at))
        sums = pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), pa.array(np.add.reduceat(times, at)))
        data = value[at].astype(np.uint8).tobytes()
        names = pa.array([data[i:j] for i, j in zip(edges[:-1], edges[1:], strict=True)], pa.binary())
        n = len(starts)
        yield pa.RecordBatch.from_arrays([conv.take(pa.array(starts)), pa.array([part] * n, pa.int32()), pa.array([seq] * n, pa.int32()), names, sums], ["conv_id", "part", "seq", "symbols", "times"])
        seq += 1


def _judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        columns: list[list] = [[] for _ in range(6)]
        for parts in batch.column(1).to_pylist():
            runs = merged(parts)
            faults = [sum(times for symbol, times in runs if symbol % 4 == x) for x in (BLANK, DUPLICATE, TRUNCATED)]
            for column, value in zip(columns, (*faults, illegal_pairs(runs), *audit_of(runs)), strict=True):
                column.append(value)
        yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(x, pa.int64()) for x in columns[:5]], pa.array(columns[5], pa.string())], ["conv_id", *VERDICT])


VERDICT = ["blank", "duplicate", "truncated", "illegal", "cost", "audit"]


def _schema(turns: DataFrame, *more: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField("conv_id", turns.schema["conv_id"].dataType), *[T.StructField(c, k) for c, k in more]])


def audits(turns: DataFrame) -> DataFrame:
    """(conv_id, VERDICT) of the conversations of turns: counts of faults and illegal pairs, the least cost and its audit."""
    found = stash(symbols(turns), "symbols")
    ordered = found.repartitionByRange(partitions(turns.sparkSession), *ORDER).sortWithinPartitions(*ORDER).select("conv_id", "symbol", "rest", "more")
    runs = ordered.mapInArrow(_runs, _schema(turns, ("part", T.IntegerType()), ("seq", T.IntegerType()), ("symbols", T.BinaryType()), ("times", T.ArrayType(T.LongType()))))
    whole = runs.groupBy("conv_id").agg(F.collect_list(F.struct("part", "seq", "symbols", "times")).alias("parts"))
    out = stash(whole.mapInArrow(_judged, _schema(turns, *[(c, T.LongType()) for c in VERDICT[:5]], ("audit", T.StringType()))), "audits")
    discard(found)
    return out


class Conversation:
    """Repaired turns of one conversation, while its turns come in order."""

    def __init__(self, audit: str) -> None:
        self.letters, self.at, self.state = audit, 0, START

    def _of_next(self, text: str) -> tuple[str, str]:
        self.state = NEXT[self.state]
        return ("user" if self.state == USER else "assistant"), text

    def inserted(self) -> Iterator[tuple[str, str]]:
        while self.at < len(self.letters) and self.letters[self.at] == "I":
            self.at += 1
            yield self._of_next("")

    def turn(self, role: str, text: str) -> Iterator[tuple[str, str]]:
        yield from self.inserted()
        letter = self.letters[self.at]
        self.at += 1
        if letter == "K":
            self.state = (SYSTEM, USER, ASSISTANT)[ROLES.index(role[0])]
            yield role, text
        elif letter == "R":
            yield self._of_next(text)


def _replayed(turns: DataFrame, verdicts: DataFrame) -> DataFrame:
    """(conv_id, audit, role, text, copies): each conversation's audit, then its turns in order. A conversation is in one partition."""
    heads = verdicts.select("conv_id", F.lit(0).alias("kind"), "audit")
    both = heads.unionByName(_hashed(turns).withColumn("kind", F.lit(1)), allowMissingColumns=True)
    return both.repartition("conv_id").sortWithinPartitions("conv_id", "kind", *ORDER[1:]).select("conv_id", "audit", "role", "text", "copies")


def _replay(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, Iterator[tuple[str, str]]]]:
    """(conv_id, repaired turns) bit by bit; a conversation's end comes as None in the turns' place."""
    now, conv = None, None
    for batch in batches:
        for conv_id, audit, role, text, copies in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if audit is not None:
                if now:
                    yield conv, now.inserted()
                    yield conv, None
                now, conv = Conversation(audit), conv_id
            else:
                for _ in range(copies):
                    yield conv, now.turn(role, text)
    if now:
        yield conv, now.inserted()
        yield conv, None


def _in_arrow(kind: pa.Schema, make: Callable[[Iterator[pa.RecordBatch]], Iterator[tuple]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for row in make(batches):
            rows.append(row)
            if len(rows) == 1000:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kind.types, strict=True)], schema=kind)
                rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kind.types, strict=True)], schema=kind)

    return run


def _arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def repaired(turns: DataFrame, verdicts: DataFrame | None = None) -> DataFrame:
    """(conv_id, pos, role, text) of all conversations after their cheapest edits; turns: as turns_of or damage give them."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        pos = 0
        for conv, some in _replay(batches):
            if some is None:
                pos = 0
                continue
            for role, text in some:
                yield conv, pos, role, text
                pos += 1

    schema = _schema(turns, ("pos", T.LongType()), ("role", T.StringType()), ("text", T.StringType()))
    short_batches(turns.sparkSession)
    return _replayed(turns, audits(turns) if verdicts is None else verdicts).mapInArrow(_in_arrow(_arrow(schema), rows), schema)


def digests(turns: DataFrame, verdicts: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256) of the repaired turns as role:text, joined by line feeds."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        seen, digest = False, hashlib.sha256()
        for conv, some in _replay(batches):
            if some is None:
                yield conv, digest.hexdigest()
                seen, digest = False, hashlib.sha256()
                continue
            for role, text in some:
                digest.update(f"{'\n' if seen else ''}{role}:{text}".encode())
                seen = True

    schema = _schema(turns, ("repaired_sha256", T.StringType()))
    short_batches(turns.sparkSession)
    return _replayed(turns, verdicts).mapInArrow(_in_arrow(_arrow(schema), rows), schema)


def gaps(turns: DataFrame) -> DataFrame:
    """(conv_id, gaps): numbers missing between the first and the last turn."""
    missing: Column = F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")
    return turns.groupBy("conv_id").agg(F.coalesce(missing, F.lit(0)).cast("long").alias("gaps"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    turns = damage(rows)
    verdicts = audits(turns)
    # all parts hold a row a conversation at most, so that a union and one aggregation join them, the null conv_id included
    parts = rows.select("conv_id").unionByName(gaps(turns), allowMissingColumns=True)
    parts = parts.unionByName(verdicts, allowMissingColumns=True).unionByName(digests(turns, verdicts), allowMissingColumns=True)
    found = parts.groupBy("conv_id").agg(*[F.max(c).alias(c) for c in ("gaps", *VERDICT, "repaired_sha256")])
    longs = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", *VERDICT[:5])]
    return found.select("conv_id", *longs, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))
