"""Operators on documents against brute force on small fixtures, with nulls, empty and long texts, ties, repeats and clashing names."""

import hashlib
import random
import re
import time
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from helixframe.llm import license_scan, line_dedup, near_dedup, packing, quality, sampled_pieces, token_files

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
#: Columns whose names operators use inside.
CLASH = "key string, row long, n long, pos int, component string, __gone__ string"
SCHEMA = f"doc_id long, text string, source string, lang string, {CLASH}"


def frame(spark, rows):
    """Rows of (doc_id, text, source)."""
    return spark.createDataFrame([(i, t, s, "en", "k", 1, 2, 3, "c", "g") for i, t, s in rows], SCHEMA)


def words(rng, n):
    return " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "épsilon", "zeta", "eta", "theta"]) + str(rng.randint(0, 9)) for _ in range(n))


def thue_morse(n, a, b):
    """Strings whose polynomial hashes modulo 2^64 don't tell a from b from 1,024 letters on."""
    return "".join(a if bin(i).count("1") % 2 == 0 else b for i in range(n))


MORSE = [thue_morse(n, *x) for n in (1024, 2048) for x in ("ab", "ba")]


@pytest.fixture(scope="module")
def mixed(spark):
    rng = random.Random(4)
    base = words(rng, 80)
    rows = [(0, None, "a"), (1, "", None), (2, "   \n\t ", "a"), (3, "One two three", "a"), (4, "one  TWO three", "b"), (5, base, "a"), (6, base, "b"), (7, base.upper(), "c")]
    for i in range(8, 40):
        w = base.split()
        for _ in range(rng.randint(1, 12)):
            w[rng.randrange(80)] = "edit" + str(rng.randint(0, 99))
        rows.append((i, " ".join(w), "s" + str(i % 5)))
    rows += [(i, words(rng, rng.randint(1, 60)), "z") for i in range(40, 60)]
    rows += [(60, words(rng, 30_000), "long"), (61, "Ünïcödé 日本 🙂 <|endoftext|> it's", "u"), (62, "x" * 20_000, "u")]
    rows += [(63 + i, t, "m") for i, t in enumerate(MORSE)]
    return rows + [rows[5]]  # a repeated row


# near copies


def brute_components(rows):
    sets = {}
    for i, t, _ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
        sets[i] = {tuple(w)} if 0 < len(w) < 5 else {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
    up = {i: i for i in sets}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in sets:
        for j in sets:
            if i < j and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = sorted((top(i), top(j)))
                up[b] = a
    return {i: (len(sets[i]), top(i)) for i in sets}


def test_near_copies_equal_brute_force(spark, mixed):
    got = near_dedup.link(frame(spark, mixed)).collect()
    assert len(got) == len(mixed)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute_components(mixed)
    kept = near_dedup.remove_near_copies(frame(spark, mixed))
    assert kept.columns == frame(spark, []).columns
    assert {r["doc_id"] for r in kept.collect()} == {i for i, (_, c) in brute_components(mixed).items() if i == c}


def test_near_copies_of_odd_rows(spark):
    assert near_dedup.link(frame(spark, [])).count() == 0
    got = near_dedup.link(frame(spark, [(None, "a b c d e f", "x"), (None, "a b c d e f", "x"), (1, "a b c d e f", "x")])).collect()
    assert sorted((r["doc_id"], r["component_id"]) for r in got if r["doc_id"]) == [(1, 1)] and len(got) == 3
    same = near_dedup.link(frame(spark, [(1, "a b c d e", ""), (1, "q w r t y", ""), (2, "a b c d e", ""), (3, "q w r t y", "")])).collect()
    assert {r["component_id"] for r in same} == {1}  # one id, two texts: one document


def test_chains_become_one_component(spark):
    rng = random.Random(9)
    w = [f"w{i}" for i in range(60)]
    rows = [(0, " ".join(w), "")]
    for i in range(1, 25):  # each differs from the one before in one word at a time
        w[rng.randrange(60)] = f"new{i}"
        rows.append((i, " ".join(w), ""))
    got = near_dedup.link(frame(spark, rows)).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == {i: c for i, (_, c) in brute_components(rows).items()}


def test_many_unlinked_variants_of_one_text(spark, monkeypatch):
    """Variants at a similarity of about 0.7 with few links among them have no pair for each two, and the links of brute force."""
    rng = random.Random(21)
    base = [f"w{i}" for i in range(1000)]
    rows = []
    for i in range(2000):
        w = list(base)
        if i % 50 == 49:  # a near copy of the one before
            w = rows[-1][1].split()
            w[rng.randrange(1000)] = f"again{i}"
        else:
            for k in range(19):
                w[rng.randrange(1000)] = f"edit{i}x{k}"
        rows.append((i, " ".join(w), ""))
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in (t.split() for _, t, _ in rows)]
    own = {tuple(base[k : k + 5]): k for k in range(len(base) - 4)}
    matrix = np.zeros((len(sets), len(own)), dtype=np.float32)
    for i, s in enumerate(sets):
        matrix[i, [own[g] for g in s if g in own]] = 1
    both = matrix @ matrix.T  # edited shingles are shared with a near copy only
    for i in range(49, 2000, 50):
        both[i, i - 1] = both[i - 1, i] = len(sets[i] & sets[i - 1])
    sizes = np.array([len(s) for s in sets])
    up = np.arange(len(sets))
    for i, j in zip(*np.nonzero(np.tril(100 * both >= 75 * (sizes[:, None] + sizes[None] - both), -1)), strict=True):
        a, b = sorted((up[i], up[j]))
        up[up == b] = a
    made = []
    real = near_dedup.confirmed
    monkeypatch.setattr(near_dedup, "confirmed", lambda pairs, sets: made.append(pairs.count()) or real(pairs, sets))
    got = near_dedup.link(frame(spark, rows)).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == {i: int(c) for i, c in enumerate(up)}
    assert len(set(up.tolist())) > 1500 and sum(made) < 60_000  # of two million


# lines


def brute_lines(rows, least):
    sites, first = defaultdict(set), {}
    for i, t, s in rows:
        for k, line in enumerate((t or "").split("\n")):
            if bare := line.strip(line_dedup.WHITE):
                sites[bare].add(s or "")
                first[bare] = min(first.get(bare, (i, k)), (i, k))
    out = {}
    for i, t, _ in rows:
        if t is not None:
            out[i] = "\n".join(x for k, x in enumerate(t.split("\n")) if not (b := x.strip(line_dedup.WHITE)) or len(sites[b]) < least or first[b] == (i, k))
    return out


def test_lines_equal_brute_force(spark):
    rng = random.Random(5)
    pool = [f"line {i}" for i in range(12)] + ["", "  ", "\tpadded \r"]
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randint(0, 8))), f"s{rng.randint(0, 9)}" if i % 7 else None) for i in range(80)]
    rows += [(80, None, "s1"), (81, "", "s1")]
    for least in (2, 5, 9):
        got = line_dedup.remove_boilerplate(frame(spark, rows), least)
        assert {r["doc_id"]: r["text"] for r in got.collect() if r["text"] is not None} == brute_lines(rows, least)
    assert got.columns == frame(spark, []).columns
    counts = {r["id"]: (r["n_lines"], r["n_removed"]) for r in line_dedup.cleaned(frame(spark, rows), 2).select("doc.doc_id", "n_lines", "n_removed").toDF("id", "n_lines", "n_removed").collect()}
    kept = brute_lines(rows, 2)
    assert counts[80] == (0, 0) and all(counts[i][0] == len(t.split("\n")) for i, t, _ in rows if t is not None)
    assert all(counts[i][1] == counts[i][0] - len(kept[i].split("\n")) for i, t, _ in rows if kept.get(i))
    assert line_dedup.remove_boilerplate(frame(spark, [])).count() == 0


def test_lines_without_a_broadcast(spark, monkeypatch):
    rng = random.Random(15)
    rows = [(i, "\n".join(rng.choice(["common", "rare " + str(i), "half"]) for _ in range(6)), f"s{i % 11}") for i in range(60)]
    monkeypatch.setattr(line_dedup, "MOST_BROADCAST", 0)
    assert {r["doc_id"]: r["text"] for r in line_dedup.remove_boilerplate(frame(spark, rows)).collect()} == brute_lines(rows, line_dedup.MIN_SITES)


def test_lines_of_a_table_with_names_of_our_own(spark):
    names = "n_lines int, n_removed string, removed array<int>, doc string, site int, d_text long, g_id long"
    rows = [(i, "same\nown " + str(i), f"s{i}", 7, "x", [1], "d", 4, 5, 6) for i in range(9)]
    docs = spark.createDataFrame(rows, f"doc_id long, text string, source string, {names}")
    got = line_dedup.remove_boilerplate(docs).collect()
    assert all(tuple(r)[3:] == (7, "x", [1], "d", 4, 5, 6) for r in got) and len(got) == 9
    assert {r["doc_id"]: r["text"] for r in got} == {i: ("same\n" if not i else "") + f"own {i}" for i in range(9)}


def test_lines_of_a_very_long_text(spark):
    long = "\n".join(f"line {i % 50_000}" if i % 3 else "header" for i in range(100_000))
    rows = [(0, long, "a")] + [(i, "header", f"s{i}") for i in range(1, 10)]
    began = time.perf_counter()
    got = {r["doc_id"]: r["text"] for r in line_dedup.remove_boilerplate(frame(spark, rows)).collect()}
    assert time.perf_counter() - began < 60
    assert got == brute_lines(rows, line_dedup.MIN_SITES)


def test_repeated_rows_and_null_ids_keep_the_first_place(spark):
    rows = [(1, "same", f"s{i}") for i in range(9)] + [(None, "same", "t1"), (2, "same", "t2")]
    got = [(r["doc_id"], r["text"]) for r in line_dedup.remove_boilerplate(frame(spark, rows)).collect()]
    assert sorted(got, key=str) == sorted([(1, "")] * 9 + [(2, ""), (None, "same")], key=str)


# licences


def brute_base(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    found = [(k, label) for p, label in license_scan.BASE for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
    return len(w), len(found), min((f[0] for f in found), default=None), max((f[0] for f in found), default=None), ",".join(sorted({f[1] for f in found}))


def test_base_phrases_equal_brute_force(spark, mixed):
    texts = ["Under the MIT License! under the mit license", "CC BY-NC, cc by nc cc by nc", "Apache License, Version 2.0", "under the mit licence", "x" * 5000 + " under the MIT license", "by nc"]
    rows = [*mixed, *((100 + i, t, "l") for i, t in enumerate(texts)), (None, texts[0], "n"), (100, texts[0], "again")]
    got = license_scan.scan(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    want = sorted(((i, *brute_base(t)) for i, t, _ in rows), key=str)
    assert sorted(((r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in got), key=str) == want
    assert license_scan.scan(frame(spark, [])).count() == 0


def test_own_templates_bear_edits(spark):
    text = license_scan.TEMPLATES[0][0].split()
    edited = text[:9] + ["kindly"] + text[9:15] + text[16:]
    rows = [(1, "intro " + " ".join(edited) + " end", ""), (2, " ".join(text[:8]), ""), (3, " ".join(sorted(text)), ""), (4, " ".join(text[:3] * 40), "")]
    got = {r["doc_id"]: (r["base_labels"], r["labels"], r["score"]) for r in license_scan.scan(frame(spark, rows)).collect()}
    assert got[1][:2] == ("", "mit") and 0.6 <= got[1][2] < 1
    assert got[2] == got[3] == got[4] == ("", "", 0.0)  # one gram many times covers few words


# tokens


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(token_files.vocabulary())


def test_token_files_give_back_all_ids(spark, mixed, tokenizer):
    files, _ = token_files.write_files(frame(spark, mixed), token_files.vocabulary())
    got = token_files.read_files(spark, files).collect()
    start, want = 0, []
    for i, t, _ in sorted(mixed, key=lambda r: r[0]):
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, token_files.END]
        want.append((i, start, len(ids), np.array(ids, dtype="<u4").tobytes()))
        start += len(ids)
    assert sorted((r["doc_id"], r["start"], r["n_tokens"], bytes(r["ids"])) for r in got) == want
    empty, _ = token_files.write_files(frame(spark, []), token_files.vocabulary())
    assert token_files.read_files(spark, empty).count() == 0


def test_token_files_of_shared_and_missing_ids(spark, tokenizer, monkeypatch):
    monkeypatch.setattr(token_files, "RANGE_BYTES", 64)  # many ranges, so that they split rows of one doc_id
    rows = [(7, f"text {i % 9}", "") for i in range(60)] + [(None, f"none {i % 3}", "") for i in range(30)] + [(i, "x", "") for i in (3, -(2**63), 9)] + [(7, None, "")]
    files, _ = token_files.write_files(frame(spark, rows), token_files.vocabulary())
    blocks = spark.read.parquet(f"{files}/blocks").select("part", "doc_ids", F.col("_metadata.file_name").alias("file")).collect()
    order = [i for r in sorted(blocks, key=lambda r: (r["file"], r["part"])) for i in r["doc_ids"]]
    assert order == sorted((i for i, _, _ in rows), key=lambda i: (i is not None, i or 0)) and len({r["file"] for r in blocks}) > 4
    got = token_files.read_files(spark, files).collect()
    encoded = lambda t: np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, token_files.END], dtype="<u4").tobytes()
    assert sorted(((r["doc_id"], bytes(r["ids"])) for r in got), key=str) == sorted(((i, encoded(t)) for i, t, _ in rows), key=str)
    starts = sorted((r["start"], r["n_tokens"]) for r in got)
    assert [a for a, _ in starts] == np.cumsum([0, *(n for _, n in starts[:-1])]).tolist()


def test_stretches_are_told_by_bytes(monkeypatch, tokenizer, mixed):
    import pyarrow as pa

    from helixframe.llm import bytestext as bt
    from helixframe.llm import segments

    real = bt.hash_spans
    monkeypatch.setattr(bt, "hash_spans", lambda *a: real(*a) & np.uint64(0xFF))  # nearly all hashes clash
    texts = [t for _, t, _ in mixed] * 2
    coder, at = segments.Encoder(token_files.vocabulary()), 0
    for ids, counts in coder.encode(pa.array(texts)):
        for part in np.split(ids, np.cumsum(counts)[:-1]):
            assert part.tolist() == tokenizer.encode(texts[at] or "", add_special_tokens=False).ids
            at += 1
    assert at == len(texts) and coder.known.clashing
    model, at = sampled_pieces.Lattice(sampled_pieces.model_path()), 0
    for ids, counts in model.encode(pa.array(texts), np.zeros(len(texts), dtype=np.uint64)):
        for back in model.decode(ids, counts):
            assert back == (texts[at] or "").encode()
            at += 1
    assert at == len(texts)


def test_ranks_of_all_lengths():
    ranks = np.array([0, 255, 256, 65535, 65536, 2**24 - 1, 2**24, 2**32 - 1, 7])
    control, data = token_files.pack_ranks(ranks)
    assert len(data) == 1 + 1 + 2 + 2 + 3 + 3 + 4 + 4 + 1
    assert (token_files.unpack_ranks(np.frombuffer(control, np.uint8), np.frombuffer(data, np.uint8), len(ranks)) == ranks).all()


def test_packing(spark, mixed, tokenizer):
    rows = packing.pack(frame(spark, mixed), token_files.vocabulary()).collect()
    want = []
    for i, t, _ in mixed:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, packing.END], dtype="<u4")
        cuts = [0, *range((len(ids) - 1) % packing.SIZE + 1, len(ids) + 1, packing.SIZE)]
        want += [(i, k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True))]
    assert sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == sorted(want)
    used = defaultdict(list)
    for r in rows:
        used[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in used.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= packing.SIZE
    assert len(used) == -(-sum(r["length"] for r in rows) // packing.SIZE)
    assert packing.pack(frame(spark, []), token_files.vocabulary()).count() == 0


def test_plans_hold_every_piece():
    rng = np.random.default_rng(2)
    for lengths in (rng.integers(1, 65, 3000), np.full(500, 40), rng.choice([1, 33, 64], 1000), np.array([], dtype=int)):
        counts = np.bincount(lengths, minlength=65)
        used = np.zeros(65, dtype=int)
        for pattern, repeats in packing.plan(counts.copy()):
            assert sum(pattern) <= 64 and repeats > 0
            for n in pattern:
                used[n] += repeats
        assert (used == counts).all()
    repeats = packing.fit_repeats(np.array([[6, 4], [5, 5]]), np.bincount([6] * 8 + [4] * 8 + [5] * 6, minlength=11))
    assert np.allclose(repeats, [8, 3], atol=0.1)


def test_short_lengths_fill_sequences():
    number = lambda lengths: sum(r for _, r in packing.plan(np.bincount(lengths, minlength=packing.SIZE + 1)))
    assert number(np.full(20_000, 100)) == 1000
    assert number(np.ones(10_000, dtype=int)) == 5
    chats = np.random.default_rng(6).integers(1, 342, 30_000)
    assert number(chats) == -(-chats.sum() // packing.SIZE)
    # patterns beat best-fit alone, and the shortest ones go into their room
    assert number(np.repeat([1000, 700, 340, 1], 600)) < 650


def test_sampled_pieces(spark, mixed):
    path = sampled_pieces.model_path()
    rows = [*mixed, (70, "▁ literal ▁▁ and  spaces   ", ""), (71, "\x00\x01", ""), (None, "null key", ""), (None, "null key", "")]
    coded = sampled_pieces.encode(frame(spark, rows), path)
    back = coded.select("doc_id", "text", "ids", sampled_pieces.decode_udf(path)(F.coalesce("ids", F.array().cast("array<int>"))).alias("back")).collect()
    assert all(r["back"] == (r["text"] or "") and (r["ids"] is None) == (r["text"] is None) for r in back)
    again = {(r["doc_id"], r["text"]): r["ids"] for r in sampled_pieces.encode(frame(spark, rows[::-1]).repartition(3), path).collect()}
    assert all(again[r["doc_id"], r["text"]] == r["ids"] for r in back)
    trips = sampled_pieces.round_trip(frame(spark, rows), path).collect()
    assert all(r["lossless"] for r in trips) and sorted(r["n_pieces"] for r in trips) == sorted(len(r["ids"] or []) for r in back)
    assert sampled_pieces.round_trip(frame(spark, []), path).count() == 0
    five, six = (next(r["ids"] for r in back if r["doc_id"] == i) for i in (5, 6))
    assert five != six  # one text, two keys


def test_segmentations_follow_their_weights():
    model = sampled_pieces.lattice(sampled_pieces.model_path())
    import pyarrow as pa

    pieces = {p: i for i, p in enumerate(model.pieces) if len(p) > 1 or i > 258}

    def ways(text):
        if not text:
            yield (), 0.0
        for n in range(1, len(text) + 1):
            if (i := pieces.get(text[:n])) is not None:
                for rest, weight in ways(text[n:]):
                    yield (i, *rest), weight + model.weights[i]

    all_ways = dict(ways(b" hear"))
    total = sum(np.exp(w) for w in all_ways.values())
    seen = defaultdict(int)
    n = 20_000
    for ids, counts in model.encode(pa.array(["hear"] * n), np.arange(n, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)):
        at = np.concatenate(([0], np.cumsum(counts)))
        for a, b in zip(at[:-1], at[1:], strict=True):
            seen[tuple(ids[a:b].tolist())] += 1
    assert set(seen) <= set(all_ways)
    for way, weight in all_ways.items():
        p = np.exp(weight) / total
        assert abs(seen[way] / n - p) < 5 * np.sqrt(p * (1 - p) / n) + 1e-4


# quality


def test_quality(spark):
    rng = random.Random(6)
    good = lambda: ". ".join(words(rng, 12).capitalize() for _ in range(rng.randint(3, 9)))
    bad = lambda: rng.choice([lambda: " ".join(["Buy"] * rng.randint(20, 90)), lambda: words(rng, 60).replace(" ", "### "), lambda: words(rng, 60).upper().replace(" ", "!! ")])()
    rows, labels = [], []
    for i in range(400):
        y = int(rng.random() < 0.7)
        rows.append((i, good() if y else bad(), "s"))
        labels.append((i, y if i != 7 else None, 0))
    rows += [(1000, None, "s"), (1001, "", "s"), (None, "some text", "s"), (1002, "x" * 100_000, "s"), rows[0]]
    table = spark.createDataFrame([*labels, (5000, 1, 0)], "doc_id long, quality int, toxic int")
    got = quality.score(frame(spark, rows), table).collect()
    assert len(got) == len(rows)
    for r in got:
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= quality.KEEP_FROM)
        assert r["held_out"] == (r["doc_id"] is None or zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
    scores = {r["doc_id"]: r for r in got}
    held = [(scores[i]["predicted"], y) for i, y, _ in labels if scores[i]["held_out"] and y is not None]
    assert sum(a == b for a, b in held) / len(held) > 0.95
    kept = quality.keep_good(frame(spark, rows), table)
    assert kept.columns == frame(spark, []).columns
    assert {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in got if r["predicted"]}


def test_scores_equal_a_plain_discriminant(spark):
    import pyarrow as pa

    rng = random.Random(16)
    rows, labels = [], []
    for i in range(300):
        y = int(rng.random() < 0.6)
        text = ". ".join(words(rng, 9).capitalize() for _ in range(rng.randint(2, 9))) if y else " ".join(rng.choice(["BUY", "now!", words(rng, 2)]) for _ in range(rng.randint(5, 60)))
        rows.append((i, text, "s"))
        labels.append((i, y))
    got = {r["doc_id"]: r["score"] for r in quality.score(frame(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int")).collect()}
    x = np.concatenate(list(quality.statistics(pa.array([t for _, t, _ in rows]))))
    y = np.array([q for _, q in labels])
    use = np.array([zlib.crc32(str(i).encode()) % 5 != 0 for i, _ in labels])
    size, logs = x.shape[1], []
    own = [np.cov(x[use & (y == c)].T, bias=True) for c in (0, 1)]
    n = [int((use & (y == c)).sum()) for c in (0, 1)]
    pooled = (n[0] * own[0] + n[1] * own[1]) / sum(n)
    for c in (0, 1):
        part = n[c] / (n[c] + 2 * size) * (1 - quality.TO_POOLED)
        cov = part * own[c] + (1 - part) * pooled
        cov = (1 - quality.TO_DIAGONAL) * cov + quality.TO_DIAGONAL * np.diag(np.diag(cov)) + quality.RIDGE * np.eye(size)
        away = x - x[use & (y == c)].mean(axis=0)
        logs.append(np.log(n[c] / sum(n)) - 0.5 * np.linalg.slogdet(cov)[1] - 0.5 * (away * np.linalg.solve(cov, away.T).T).sum(axis=1))
    bent = np.clip(2 * np.arcsinh((logs[1] - logs[0]) / 2), -quality.MOST, quality.MOST)
    odds = np.array([np.log(got[i] / (1 - got[i])) if 0 < got[i] < 1 else np.nan for i, _ in labels])
    sure = np.isfinite(odds) & (np.abs(odds) < 20)
    slope, shift = np.polyfit(bent[sure], odds[sure], 1)
    assert slope > 0 and np.allclose(odds[sure], slope * bent[sure] + shift, atol=1e-5)


def test_quality_without_labels(spark):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r["score"] for r in quality.score(frame(spark, [(1, "a", ""), (2, None, "")]), none).collect()} == {0.5}
    assert quality.score(frame(spark, []), none).count() == 0
    one = spark.createDataFrame([(1, 1), (2, 1), (3, 1), (4, 1)], "doc_id long, quality int")
    assert quality.score(frame(spark, [(i, "text", "") for i in range(6)]), one).first()["score"] > 0.5


def test_hashes_tell_texts_apart():
    import pyarrow as pa

    from helixframe.llm import bytestext as bt

    rng = random.Random(1)
    texts = [None, "", *(words(rng, rng.randint(0, 40)) for _ in range(200)), "y" * 700_000]
    seen = {}
    for row, end, flat, offsets in bt.chunks(pa.array(texts), 4000):
        starts, ends, rows = bt.spans(flat, offsets, bt.SOLID)
        hashes = bt.hash_spans(flat, starts, ends)
        for i in range(row, end):
            own = slice(rows[i - row], rows[i - row + 1])
            assert [bytes(flat[a:b]).decode() for a, b in zip(starts[own], ends[own], strict=True)] == (texts[i] or "").split()
        for a, b, h in zip(starts, ends, hashes, strict=True):
            digest = hashlib.md5(bytes(flat[a:b])).digest()
            assert seen.setdefault(int(h), digest) == digest


def test_pieces_that_repeat_are_dealt_out(spark):
    rows = [(None, 0, 0, 1, 5)] * 3000 + [(i, 0, 0, 1 + i % 50, i) for i in range(6000)]
    pieces = spark.createDataFrame([(*r, n) for n, r in enumerate(rows)], "doc_id long, piece int, start long, length long, ids_crc32 long, row long")
    found = packing.dealt(pieces, 16).groupBy("salt").agg(F.count_if(F.col("doc_id").isNull()).alias("same")).collect()
    assert len(found) == 16 and max(r["same"] for r in found) < 2 * 3000 / 16
    packed = packing.pack_pieces(pieces).collect()
    used = defaultdict(list)
    for r in packed:
        used[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in used.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= packing.SIZE
    assert len(packed) == 9000 and len(used) == -(-sum(r[3] for r in rows) // packing.SIZE)


def test_lines_of_a_table_with_dots_in_its_names(spark):
    docs = spark.createDataFrame([(i, f"own {i}\nthe same line", f"s{i}", "x") for i in range(9)], "doc_id long, text string, source string, `a.b` string")
    got = line_dedup.remove_boilerplate(docs)
    assert got.columns == docs.columns and sorted(r["text"] for r in got.collect())[:2] == ["own 0\nthe same line", "own 1"]


def test_cuts_of_token_files_are_bounded(spark, mixed, monkeypatch):
    monkeypatch.setattr(token_files, "RANGE_BYTES", 1000)
    monkeypatch.setattr(token_files, "MOST_RANGES", 5)
    monkeypatch.setattr(token_files, "MOST_KEYS", 20)
    files, _ = token_files.write_files(frame(spark, mixed).select("doc_id", "text"), token_files.vocabulary())
    assert spark.read.parquet(f"{files}/blocks").agg(F.max("part")).first()[0] <= 5
    got = token_files.read_files(spark, files).orderBy("start").collect()
    assert [r["doc_id"] for r in got] == sorted(r[0] for r in mixed) and all(b["start"] == a["start"] + a["n_tokens"] for a, b in zip(got[:-1], got[1:], strict=True))
