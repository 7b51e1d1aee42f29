"""Conversation repair, substring dedup and periodic runs against brute force on small fixtures, with nulls, empty and long texts, ties, repeats and clashing names."""

import functools
import hashlib
import os
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from helixframe.llm import bytestext as bt
from helixframe.llm import conversation_repair as repair
from helixframe.llm import period_runs, substring_dedup

SMALL = "/root/testdata/sf0.001"


def split(text):
    return (text or "").encode().split()


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


# conversations


def brute_faults(rows):
    """rows: (role, text) in order."""
    out, seen = [], set()
    for role, text in rows:
        solid = split(text)
        out.append("blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1].decode()[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def brute_audit(rows, faults):
    def add(cost, letter, rest):
        return cost + rest[0], letter + rest[1]

    @functools.cache
    def inserting(i, state, left=3):
        """(cost, letters) from row i on; state: the last initial so far, '' for none."""
        after = {"": "u", "s": "u", "u": "a", "a": "u"}[state]
        found = [(0, "")] if i == len(rows) and state in ("", "a") else []
        if left:
            found.append(add(2, "I", inserting(i, after, left - 1)))  # more in a row than three never pay
        if i < len(rows):
            role, fault = rows[i][0][:1], faults[i]
            found.append(add(3, "D", inserting(i + 1, state)))
            if fault not in ("blank", "duplicate"):
                extra = int(fault == "truncated")
                if (state, role) in {("", "s"), ("", "u"), ("s", "u"), ("u", "a"), ("a", "u")}:
                    found.append(add(extra, "K", inserting(i + 1, role)))
                found.append(add(2 + extra, "R", inserting(i + 1, after)))
        return min(found, default=(10**9, ""))

    return inserting(0, "")


def brute_repaired(rows, letters):
    out, rest, last = [], iter(rows), ""
    for x in letters:
        after = "assistant" if last == "u" else "user"
        if x == "I":
            out.append((after, ""))
        else:
            role, text = next(rest)
            if x == "D":
                continue
            out.append((role, text) if x == "K" else (after, text))
        last = out[-1][0][0]
    return out


def brute_conversations(rows, damaged):
    """(conv_id, turn, role, text) rows; as op11 returns them. Ties between equal turns must be equal rows or have different roles."""
    found = defaultdict(list)
    for conv, turn, role, text in rows:
        found[conv] += []
        role, text = (" " if x is None else x for x in (role, text))
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20 if damaged else 9
        if kind == 0:
            continue
        text = "" if kind == 1 else text.translate(str.maketrans("", "", ".!?")) if kind == 2 else text
        found[conv] += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    out = {}
    for conv, turns in found.items():
        turns.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2]))
        numbers = [t for t, _, _ in turns if t is not None]
        own = [x[1:] for x in turns]
        faults = brute_faults(own)
        cost, letters = brute_audit(own, faults)
        initials = [r[:1] for r, _ in own]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials[:-1], initials[1:], strict=True))
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        digest = sha("\n".join(f"{r}:{t}" for r, t in brute_repaired(own, letters)))
        out[conv] = (gaps, *[faults.count(x) for x in ("blank", "duplicate", "truncated")], illegal, cost, letters, digest)
    return out


@pytest.fixture(scope="module")
def chats():
    rng = random.Random(3)
    rows = [(None, 1, "user", "Hi."), (None, 2, "assistant", "Hello."), (1, None, "user", None), (1, 5, None, "x"), (2, 0, "user", " \t"), (3, 1, "tool", "run."), (3, 1, "tool", "run.")]
    for conv in range(10, 120):
        for turn in range(rng.randint(0, 9)):
            text = rng.choice(["Yes.", "No!", "", " \n", "cut off", "Why?", "line\nend.", "Déjà vu. "])
            rows.append((conv, rng.choice([turn, turn + 3, None]), rng.choice(["system", "user", "user", "assistant", "assistant", "tool", ""]), text))
    seen, out = {}, []
    for conv, turn, role, text in rows:  # one text for each turn: ties between texts are ordered by hash
        out.append((conv, turn, role, seen.setdefault((conv, turn), text)))
    out += [(200, i, "user" if i % 2 == 0 else "assistant", f"t{i}.") for i in range(3000)] + [(201, i, "user", f"t{i}") for i in range(2000)]
    return out + [out[5]] * 2


COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
CLASH = "kind string, part long, symbol string, audit string, `a.b` string"


def chat_frame(spark, rows):
    return spark.createDataFrame([(*r, "k", 1, "s", "a", "d") for r in rows], f"conv_id long, turn long, role string, text string, {CLASH}")


@pytest.mark.parametrize("short", [True, False])
def test_repair_equals_brute_force(spark, chats, tmp_path, short):
    rows = [r for r in chats if r[0] is None or r[0] < 200] if short else chats
    chat_frame(spark, rows).repartition(5).write.parquet(f"{tmp_path}/conversations.parquet")
    got = repair.op11_conversation_repair(spark, str(tmp_path))
    assert got.columns == COLUMNS
    found = got.collect()
    if short:
        assert {r[0]: tuple(r)[1:] for r in found} == brute_conversations(rows, True)
    long = {r.conv_id: r for r in found}
    assert len(found) == len({r[0] for r in rows})
    if not short:  # too deep for the brute force: what must hold of it
        assert long[200].illegal == brute_illegal(chats, 200) and len(long[200].audit.replace("I", "")) == brute_rows(chats, 200)


def brute_rows(rows, conv):
    kinds = [zlib.crc32(f"{c}:{t}".encode()) % 20 for c, t, _, _ in rows if c == conv]
    return sum({0: 0, 3: 2}.get(k, 1) for k in kinds)


def brute_illegal(rows, conv):
    own = sorted(r for r in rows if r[0] == conv)
    kinds = [(zlib.crc32(f"{c}:{t}".encode()) % 20, r) for c, t, r, _ in own]
    initials = [("u" if k == 4 else r[0]) for k, r in kinds if k for _ in range(2 if k == 3 else 1)]
    return sum(a + b not in ("su", "ua", "au") for a, b in zip(initials[:-1], initials[1:], strict=True))


def test_runs_of_symbols_equal_brute_force():
    rng = random.Random(8)
    for _ in range(300):
        symbols = [x for _ in range(rng.randint(0, 4)) for x in [rng.randrange(16)] * rng.choice([1, 2, 3, 7])]
        runs: list = []
        for x in symbols:
            runs[-1:] = [(x, runs[-1][1] + 1)] if runs and runs[-1][0] == x else [*runs[-1:], (x, 1)]
        rows = [("suax"[x // 4] + str(i), "") for i, x in enumerate(symbols)]
        faults = [["", "truncated", "blank", "duplicate"][x % 4] for x in symbols]
        assert repair.audit_of(runs) == brute_audit(rows, faults)
    assert repair.audit_of([(9, 1_000_000)])[0] == 3_000_000 // 2 or len(repair.audit_of([(9, 1_000_000)])[1]) >= 1_000_000


def test_repaired_turns_have_legal_roles(spark, chats):
    turns = repair.turns_of(chat_frame(spark, [r for r in chats if r[0] is None or r[0] < 60]))
    by_conv = defaultdict(list)
    for r in repair.repaired(turns).collect():
        by_conv[r.conv_id].append((r.pos, r.role[0]))
    for rows in by_conv.values():
        initials = "".join(x for _, x in sorted(rows))
        assert [p for p, _ in sorted(rows)] == list(range(len(rows))) and initials.lstrip("s") == "ua" * (len(initials.lstrip("s")) // 2) and initials.count("s") <= 1


def test_a_hot_conversation_spreads(spark):
    rows = [(7, i, "user", f"t{i}.") for i in range(4000)] + [(i + 100, 0, "user", "hi.") for i in range(8000)]
    found = repair.symbols(repair.turns_of(chat_frame(spark, rows)))
    dealt = found.repartitionByRange(6, *repair.ORDER).selectExpr("spark_partition_id() AS p", "conv_id").filter("conv_id = 7").groupBy("p").count().collect()
    assert len(dealt) >= 2 and max(r["count"] for r in dealt) < 3000


def test_repair_of_nothing(spark, tmp_path):
    chat_frame(spark, []).write.parquet(f"{tmp_path}/conversations.parquet")
    assert repair.op11_conversation_repair(spark, str(tmp_path)).collect() == []


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test data")
def test_op11_on_the_small_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = {r[0]: tuple(r)[1:] for r in repair.op11_conversation_repair(spark, SMALL).collect()}
    assert got == brute_conversations(rows, True)


# repeated windows


def brute_windows(rows):
    first = {}
    for i, text in rows:
        w = split(text)
        for k in range(len(w) - 12):
            key = tuple(w[k : k + 13])
            first[key] = min(first.get(key, (1, 0)), (0, -(1 << 63)) if i is None else (0, i))
    out = []
    for i, text in rows:
        w, gone = split(text), set()
        for k in range(len(w) - 12):
            if first[tuple(w[k : k + 13])] < ((0, -(1 << 63)) if i is None else (0, i)):
                gone.update(range(k, k + 13))
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), sha(kept)))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def passages():
    rng = random.Random(6)
    word = lambda: rng.choice(["alpha", "beta", "gamma", "délta", "日本", "x"]) + str(rng.randint(0, 30))
    shared = [" ".join(word() for _ in range(rng.choice([12, 13, 14, 60]))) for _ in range(8)]
    rows = [(None, shared[3]), (None, "one two"), (0, None), (1, ""), (2, " \n\t"), (3, "a " * 12), (4, "a " * 13), (5, "a  " * 40), (6, "a\n" * 41)]
    for i in range(10, 90):
        parts = [" ".join(word() for _ in range(rng.randint(0, 30))) for _ in range(3)]
        rows.append((i, (" " + rng.choice(["\n", " "])).join([parts[0], rng.choice(shared), parts[1], rng.choice(shared), parts[2]])))
    rows += [(100, rows[20][1]), (101, rows[20][1]), (20, "another text of the same number " + shared[7]), (102, " ".join(word() for _ in range(30_000)))]
    rows += [(103, rows[-1][1]), (104, "tail"), rows[30], rows[30]]
    return rows


def text_frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", 1, "d", "p", "r") for i, t in rows], "doc_id long, text string, lang string, tag long, doc string, `a.b` string, row string")


def test_repeats_equal_brute_force(spark, passages, tmp_path):
    text_frame(spark, passages).repartition(7).write.parquet(f"{tmp_path}/documents.parquet")
    got = substring_dedup.op12_substring_dedup(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_words", "n_removed", "kept_sha256"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute_windows(passages)


@pytest.mark.parametrize("rounds", [0, 1, 3])
def test_no_number_of_sketches_loses_windows(spark, passages, tmp_path, monkeypatch, rounds):
    monkeypatch.setattr(substring_dedup, "rounds_for", lambda n, width: rounds)
    monkeypatch.setattr(substring_dedup, "KEPT", 500)
    monkeypatch.setattr(substring_dedup, "COUNTED", 700)
    rng = random.Random(9)
    rows = passages + [(200 + i, " ".join(str(rng.randrange(9)) for _ in range(200))) for i in range(30)]
    text_frame(spark, rows).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = substring_dedup.op12_substring_dedup(spark, str(tmp_path))
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute_windows(rows)


def test_texts_without_repeats_stay_as_they_are(spark, passages):
    docs = text_frame(spark, passages)
    got = substring_dedup.without_repeats(docs)
    assert got.columns == docs.columns
    left = {(r.doc_id, r.text) for r in got.collect()}
    assert {(2, " \n\t"), (1, ""), (0, None), (3, "a " * 12), (4, "a " * 13), (104, "tail")} <= left and (103, "") in left
    assert substring_dedup.without_repeats(docs.limit(0)).collect() == []


def test_rounds_follow_the_load():
    width = substring_dedup.MOST_CELLS
    assert [substring_dedup.rounds_for(n, width) for n in (0, width // 4, width, 10 * width)] == [1, 1, 2, 0]


def test_gaps_and_packed_columns_come_back():
    rng = np.random.default_rng(1)
    at = np.sort(rng.integers(0, 1 << 22, 5000))
    assert (substring_dedup.of_gaps(substring_dedup.gaps(at)) == at).all()
    block = substring_dedup.counted(at)
    value, times = np.unique(at, return_counts=True)
    assert (block[value >> 2] >> (2 * (value & 3)).astype(np.uint8) & 3 == np.minimum(times, 3)).all()
    tables = [[rng.integers(0, 1 << 30, n).astype(k) for k in kinds] for n, kinds in zip((7, 0, 3), substring_dedup._COLUMNS, strict=True)]
    for a, b in zip(tables, substring_dedup.unpack(substring_dedup.pack(tables)), strict=True):
        assert all((x == y).all() and x.dtype == y.dtype for x, y in zip(a, b, strict=True))


def test_a_window_of_a_third_of_all_documents_leaves_a_task_once(spark):
    shared = " ".join(f"w{i}" for i in range(20))
    rows = [(i, shared if i % 3 == 0 else f"own {i}") for i in range(3000)]
    docs = text_frame(spark, rows).repartition(4)
    named = substring_dedup._named(docs).select("doc", "tag", "text")
    sketch = substring_dedup.sketch_of(docs, substring_dedup.LEAST_CELLS)
    opened = [len(substring_dedup.unpack(r.data)[0][0]) for r in substring_dedup.kept_windows(named, sketch, 4).collect()]
    assert sum(opened) <= 4 * 8
    assert sum(x.n for r in substring_dedup.repeated_spans(docs).collect() for x in r.spans) == 999 * 8


# periodic runs


def brute_runs(w):
    found = {}
    for p in range(1, len(w) // 2 + 1):
        i = 0
        while i + p < len(w):
            s = i
            while i + p < len(w) and w[i] == w[i + p]:
                i += 1
            if i - s + p >= max(12, 2 * p):
                found.setdefault((s, i - s + p), p)
            i += i == s
    return sorted(((s, n, p) for (s, n), p in found.items()), key=lambda r: (r[0], r[2]))


def brute_row(i, text, damaged=True):
    w = split(text)
    n = len(w)
    h = zlib.crc32(str(i).encode()) if i is not None else 1
    if damaged and h % 10 == 0 and n:
        a, g = h // 10 % n, h // 10
        p = 1 + (n - a) // (3 + g % 8)
        w = w[:a] + [w[a + (k - a) % p] for k in range(a, n)]
    runs = brute_runs(w)
    gone = {k for s, m, p in runs for k in range(s + p, s + m)}
    best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=None)
    head = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (i, len(runs), *head, sha("".join(f"{s},{m},{p}\n" for s, m, p in runs)), sha(b" ".join(x for k, x in enumerate(w) if k not in gone)))


def test_runs_equal_brute_force():
    rng = random.Random(1)
    for _ in range(150):
        texts = []
        for _ in range(rng.randint(1, 6)):
            n = rng.randint(0, 120)
            w = [rng.randrange(rng.choice([1, 2, 3, 20])) for _ in range(n)]
            for _ in range(rng.randint(0, 3)):
                if n > 5:
                    a, e = sorted(rng.sample(range(n + 1), 2))
                    p = rng.randint(1, max(1, (n - a) // 2))
                    for i in range(a, e):
                        w[i] = w[a + (i - a) % p]
            texts.append(w)
        found = period_runs.runs_of(np.array([x for w in texts for x in w], dtype=np.int64), bt.bounds(np.array([len(w) for w in texts])))
        assert list(zip(*[x.tolist() for x in found], strict=True)) == [(k, *r) for k, w in enumerate(texts) for r in brute_runs(w)]


def test_extensions_of_long_words():
    """Fibonacci words hold runs of all sizes, a word of one letter one run; both are parsed in few levels."""
    a, b = [0], [0, 1]
    while len(b) < 3000:
        a, b = b, b + a
    found = period_runs.runs_of(np.array(b), np.array([0, len(b)]))
    assert list(zip(*[x.tolist() for x in found[1:]], strict=True)) == brute_runs(b)
    levels, top = period_runs.grammar(np.array([5] * 100_000 + [6]))
    assert len(levels) == 1 and len(top) == 2
    assert [x.tolist() for x in period_runs.runs_of(np.array([7] * 50_000), np.array([0, 50_000]))] == [[0], [0], [50_000], [1]]


def test_candidates_settled_in_parts(monkeypatch):
    monkeypatch.setattr(period_runs, "MOST_CANDIDATES", 50)
    w = ([1, 2, 3, 4, 5, 6, 7] * 30 + [8, 9] * 40 + list(range(10, 40))) * 3
    found = period_runs.runs_of(np.array(w + [1] * 20), np.array([0, len(w), len(w) + 20]))
    assert list(zip(*[x.tolist() for x in found], strict=True)) == [(0, *r) for r in brute_runs(w)] + [(1, 0, 20, 1)]


def test_op13_equals_brute_force(spark, passages, tmp_path):
    rng = random.Random(2)
    rows = passages[:-5] + [(300 + i, " ".join(rng.choice("ab") for _ in range(rng.randint(0, 80)))) for i in range(60)] + [(400, "x " * 5000), (400, "x " * 5000), (401, "a b c " * 5)]
    text_frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = period_runs.op13_period_runs(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert {k for _, k in got.dtypes} == {"bigint", "string"}
    want = [brute_row(i, t) for i, t in rows if t is None or len(t) < 9000] + [(400, *brute_row(400, "x " * 60)[1:])] * 0
    found = sorted((tuple(r) for r in got.collect() if r.doc_id != 400), key=repr)
    assert found == sorted((r for r in want if r[0] != 400), key=repr)
    assert [(r.n_runs, r.start, r.length, r.period) for r in got.filter("doc_id = 400").collect()] == [(1, 0, 5000, 1)] * 2


def test_runs_of_nothing_and_clashing_names(spark):
    docs = text_frame(spark, [(1, "a b " * 10), (None, None)])
    found = period_runs.find_runs(docs).select("row.*", "found.runs", "found.collapsed").orderBy("doc_id").collect()
    assert [(r.doc_id, r.lang, r.collapsed, [tuple(x) for x in r.runs]) for r in found] == [(None, "en", "", []), (1, "en", "a b", [(0, 20, 2)])]
    assert period_runs.find_runs(docs.limit(0)).collect() == []


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test data")
def test_op13_on_the_small_table(spark):
    rows = [r for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    short = {r.doc_id for r in rows if len(split(r.text)) < 700}
    got = sorted(tuple(r) for r in period_runs.op13_period_runs(spark, SMALL).collect() if r.doc_id in short)
    assert len(short) > 100 and got == sorted(brute_row(*r) for r in rows if r.doc_id in short)
