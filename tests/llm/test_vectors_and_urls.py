"""Vector search and URL rules against brute force on small fixtures."""

import math
import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from helixframe.llm import ann, knn_join, url_rules

VECTORS = "vec_id long, embedding array<float>, label int, v string, norm string, cell string"


def vectors(spark, rows):
    return spark.createDataFrame([(i, e, 0, "v", "n", "c") for i, e in rows], VECTORS)


def odd_rows():
    nan, inf = float("nan"), float("inf")
    return [(None, [1.0, 1.0]), (9001, None), (9002, [1.0, None]), (9003, [nan, 1.0]), (9004, [inf, 0.0]), (9005, [])]


def test_exact_search_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(300, 8)).astype(np.float32)
    rows = [(i, base[i].tolist()) for i in range(300)]
    rows += [(1000 + i, base[7].tolist()) for i in range(40)]  # one vector many times: ties go to the smaller id
    rows += [(2000, base[0][:3].tolist()), (2001, [0.0] * 8)]
    got = knn_join.search(vectors(spark, rows + odd_rows() + rows[:1])).collect()
    whole = {i: np.floor(1024 * np.array([*e, *[0.0] * (8 - len(e))], dtype=np.float32).astype(float)).astype(int) for i, e in rows}
    for q in [i for i in whole if i % 100 == 0]:
        want = sorted((-int(whole[q] @ whole[i]), i) for i in [*whole, 0] if i != q)[:10]  # row 0 is there twice
        assert [(r["rank"], r["vec_id"], r["score"]) for r in sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])] == [(k + 1, i, -s) for k, (s, i) in enumerate(want)]
    assert {r["query_id"] for r in got} == {i for i in whole if i % 100 == 0}


def test_exact_search_of_an_id_on_many_rows(spark):
    # the longest vector is drawn as pivot, and its own rows are nearer to it than any other
    few = [(100, [8.0, 0.0])] * 12 + [(i, [0.5 * i, 1.0]) for i in (1, 2, 3, 4)]
    assert [(r["query_id"], r["vec_id"]) for r in knn_join.search(vectors(spark, few)).orderBy("rank").collect()] == [(100, 4), (100, 3), (100, 2), (100, 1)]
    base = np.round(np.random.default_rng(9).normal(size=(200, 4)), 2).astype(np.float32)
    rows = [(i, base[i].tolist()) for i in range(200)]
    for q in (0, 100):  # some of the rows of one id lie elsewhere
        rows += [(q, [20.0, q / 100, 0.0, 0.0])] * 15 + [(q, [0.0, 20.0, 0.0, q / 100])] * 15
    whole = [(i, np.floor(1024 * np.array(e, dtype=np.float32).astype(float)).astype(int)) for i, e in rows]
    got = knn_join.search(vectors(spark, rows)).collect()
    for q in (0, 100):
        own = [(r["vec_id"], r["score"]) for r in sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])]
        assert any(own == [(i, -s) for s, i in sorted((-int(v @ x), i) for i, x in whole if i != q)[:10]] for at, v in whole if at == q)  # one row of a repeated query is answered


def test_clustered_data_is_hardly_replicated(spark):
    rng = np.random.default_rng(12)
    centers = rng.normal(size=(40, 8))
    centers *= 10 / np.linalg.norm(centers, axis=1, keepdims=True)
    base = (centers[rng.integers(0, 40, 3000)] + 0.05 * rng.normal(size=(3000, 8))).astype(np.float32)
    frame = vectors(spark, [(i, base[i].tolist()) for i in range(3000)])
    left, right, *_ = knn_join.plan(frame, 10, 100)
    assert right.count() < 1.5 * 3000 and right.select("cell").distinct().count() > 5
    assert left.count() <= 2 * 30  # a query goes to chunks of its own group only
    met = left.join(right, ["cell", "block", "chunk"]).count()
    assert met < 0.3 * 30 * 3000  # of all products
    whole = np.floor(1024 * base.astype(float))
    got = knn_join.search(frame).collect()
    for q in range(0, 3000, 100):
        want = sorted((-int(whole[q] @ x), i) for i, x in enumerate(whole) if i != q)[:10]
        assert [(r["vec_id"], r["score"]) for r in sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])] == [(i, -s) for s, i in want]
    flat = rng.normal(size=(600, 64)).astype(np.float32)  # nothing can be left out here: shipped once
    assert knn_join.plan(vectors(spark, [(i, x.tolist()) for i, x in enumerate(flat)]), 10, 100)[1].count() == 600


def test_exact_search_of_few_rows(spark):
    assert knn_join.search(vectors(spark, [])).count() == 0
    assert knn_join.search(vectors(spark, odd_rows())).count() == 0
    assert [(r["query_id"], r["vec_id"], r["score"]) for r in knn_join.search(vectors(spark, [(100, [1.0]), (1, [-0.5])])).collect()] == [(100, 1, 1024 * -512)]
    big = knn_join.search(vectors(spark, [(100, [3000.0, 1.0]), (1, [2000.0, 2.0])])).first()
    assert big["score"] == 3000 * 1024 * 2000 * 1024 + 1024 * 2048


def test_nearest_neighbours(spark):
    rng = np.random.default_rng(4)
    centers = rng.normal(size=(6, 16))
    base = (centers[rng.integers(0, 6, 800)] + 0.4 * rng.normal(size=(800, 16))).astype(np.float32)
    rows = [(i, base[i].tolist()) for i in range(800)] + [(9100, [0.0] * 16)]
    got = ann.search(vectors(spark, rows + odd_rows())).collect()
    exact = base.astype(float) @ base.astype(float).T
    found = 0
    for q in range(0, 800, 20):
        own = sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in own] == list(range(1, 21))
        assert all(math.isclose(r["score"], exact[q, r["vec_id"]], rel_tol=1e-9) for r in own)
        assert [(-r["score"], r["vec_id"]) for r in own] == sorted((-r["score"], r["vec_id"]) for r in own)
        order = [i for i in np.argsort(-exact[q], kind="stable") if i != q][:20]
        found += len({r["vec_id"] for r in own} & set(order))
    assert found / (40 * 20) >= 0.9


def test_one_long_vector_leaves_recall(spark):
    rng = np.random.default_rng(11)
    centers = rng.normal(size=(6, 16))
    base = (centers[rng.integers(0, 6, 1601)] + 0.4 * rng.normal(size=(1601, 16))).astype(np.float32)
    base[1600] *= 1000
    got = ann.search(vectors(spark, [(i, base[i].tolist()) for i in range(1601)])).collect()
    exact = base.astype(float) @ base.astype(float).T
    recall = {q: len({r["vec_id"] for r in got if r["query_id"] == q} & set([i for i in np.argsort(-exact[q], kind="stable") if i != q][:20])) / 20 for q in range(0, 1601, 20)}
    assert np.mean([recall[q] for q in range(0, 1600, 20)]) >= 0.9
    assert recall[1600] >= 0.9
    assert all(any(r["vec_id"] == 1600 and r["rank"] == 1 for r in got if r["query_id"] == q) for q in range(0, 1600, 20) if exact[q, 1600] == np.delete(exact[q], q).max())


def test_rounds_and_steps_end_by_themselves(spark, monkeypatch):
    """Rounds go on until few edges are new, steps until no beam has a candidate left; of all tables written only the last beam and the vectors stay."""
    rng = np.random.default_rng(12)
    base = rng.normal(size=(3000, 24)).astype(np.float32)
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    written, fresh, left = [], [], []
    stash, discard = ann.stash, ann.discard

    def noted(df, name):
        back = stash(df, name)
        written.append((name, id(back), back))
        if name == "graph":
            fresh.append(back.filter("NOT old").count() / back.count())
        elif name == "chosen":
            left.append(back.count())
        return back

    gone = []
    monkeypatch.setattr(ann, "stash", noted)
    monkeypatch.setattr(ann, "discard", lambda df: (gone.append(id(df)), discard(df)))
    got = ann.search(vectors(spark, [(i, base[i].tolist()) for i in range(3000)])).collect()
    assert fresh[0] == 1 and fresh[-1] <= ann.SETTLED and all(f > ann.SETTLED for f in fresh[:-1])
    assert left[-1] == 0 and all(left[:-1])
    assert sorted(name for name, at, _ in written if at not in gone) == ["beam", "sound"]
    exact = base[::20].astype(float) @ base.astype(float).T
    exact[np.arange(150), np.arange(0, 3000, 20)] = -np.inf
    best = {20 * i: set(np.argsort(-row)[:20].tolist()) for i, row in enumerate(exact)}
    assert sum(r["vec_id"] in best[r["query_id"]] for r in got) / (150 * 20) >= 0.9


def test_copies_of_a_vector_are_one_class(spark, monkeypatch):
    """Graph and search see 90 vectors, not 1,800 rows; of a vector's many rows the smallest ids are listed."""
    rng = np.random.default_rng(21)
    few = rng.integers(-3, 4, size=(90, 6)).astype(np.float32)
    few[:, 0] = np.arange(90) // 10 + 1  # no zero vector
    few = np.unique(few, axis=0)
    at = np.concatenate([np.zeros(900, dtype=int), rng.integers(0, len(few), 900)])[rng.permutation(1800)]  # one vector is half of all rows
    sizes, stash = [], ann.stash

    def noted(df, name):
        back = stash(df, name)
        if name in ("vectors", "asked"):
            sizes.append(back.count())
        return back

    monkeypatch.setattr(ann, "stash", noted)
    got = ann.search(vectors(spark, [(i, few[x].tolist()) for i, x in enumerate(at)])).collect()
    assert sizes[0] == len(np.unique(at)) and sizes[1] == len(np.unique(at[::20]))
    assert len(got) == 90 * 20
    exact = few[at].astype(float) @ few[at].astype(float).T  # whole numbers, so that ties are exact
    for q in range(0, 1800, 20):
        want = [i for i in np.lexsort((np.arange(1800), -exact[q])) if i != q][:20]
        own = sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])
        assert [(r["rank"], r["vec_id"], r["score"]) for r in own] == [(n + 1, i, exact[q, i]) for n, i in enumerate(want)]


def test_cells_of_two_draws_leave_little_to_rounds(spark, monkeypatch):
    rng = np.random.default_rng(22)
    base = rng.normal(size=(3000, 64)).astype(np.float32)
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    new, stash = [], ann.stash

    def noted(df, name):
        back = stash(df, name)
        if name == "graph":
            new.append(back.filter("NOT old").count() / back.count())
        return back

    monkeypatch.setattr(ann, "stash", noted)
    monkeypatch.setattr(ann, "LEAF", 200)
    monkeypatch.setattr(ann, "MOST", 4)  # 15 cells: two draws of 4 pivots
    got = ann.search(vectors(spark, [(i, base[i].tolist()) for i in range(3000)])).collect()
    assert len(new) <= 4 and new[1] < 0.3
    exact = base[::20].astype(float) @ base.astype(float).T
    exact[np.arange(150), np.arange(0, 3000, 20)] = -np.inf
    best = {20 * i: set(np.argsort(-row)[:20].tolist()) for i, row in enumerate(exact)}
    assert sum(r["vec_id"] in best[r["query_id"]] for r in got) / (150 * 20) >= 0.95


def test_nearest_of_lists_and_groups_over_batches():
    rng = np.random.default_rng(23)
    for _ in range(50):
        n, many, k = int(rng.integers(1, 9)), int(rng.integers(0, 200)), int(rng.integers(1, 20))
        rows, ids, done = rng.integers(0, n, many), rng.integers(0, 40, many), rng.random(many) < 0.3
        near = (rng.integers(0, 8, 40)[ids] / 8).astype(np.float32)
        counts, *lists = ann._nearest(n, rows, ids, near, done, k)
        for row, at in enumerate(np.cumsum([0, *counts])[:-1]):
            own = {i: (near[(rows == row) & (ids == i)].max(), done[(rows == row) & (ids == i)].any()) for i in ids[rows == row]}
            found = list(zip(*(x[at : at + counts[row]] for x in lists), strict=True))
            assert len(found) == min(k, len(own)) and all(own[i] == (v, d) for i, v, d in found)
            assert found == sorted(found, key=lambda x: (-x[1], x[0])) and [v for _, v, _ in found] == sorted((v for v, _ in own.values()), reverse=True)[:k]
    for width in (5, 65, 3000):
        for near in (rng.normal(size=(40, width)).astype(np.float32), np.ones((40, width), dtype=np.float32)):
            counts, at = ann._about(near, 16)
            for row, begin in enumerate(np.cumsum([0, *counts])[:-1]):
                own = at[begin : begin + counts[row]]
                assert set(own // width) == {row} and sorted(near.ravel()[own])[::-1][:16] == sorted(near[row])[::-1][:16]
            assert len(at) <= 2 * 16 * 40
    key = np.repeat(np.arange(6), [3, 45_000, 1, 1, 20_000, 7])
    batches = pa.table({"k": key, "x": np.arange(len(key))}).to_batches(max_chunksize=30_001)
    solved = list(ann.by_group("k", lambda rows, edges: pa.table({"k": rows["k"].to_numpy()[edges[:-1]], "n": np.diff(edges), "x": np.add.reduceat(rows["x"].to_numpy(), edges[:-1])}))(iter(batches)))
    whole = pa.Table.from_batches(solved)
    assert whole["k"].to_pylist() == list(range(6)) and whole["n"].to_pylist() == [3, 45_000, 1, 1, 20_000, 7]
    assert whole["x"].to_pylist() == [int(np.flatnonzero(key == i).sum()) for i in range(6)]


def test_nearest_neighbours_of_few_rows(spark):
    assert ann.search(vectors(spark, odd_rows())).count() == 0
    got = ann.search(vectors(spark, [(20, [1.0, 0.0]), (1, [0.5, 0.0]), (2, [0.5, 0.0]), (3, [-1.0, 2.0])])).collect()
    assert [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in sorted(got, key=lambda r: r["rank"])] == [(20, 1, 1, 0.5), (20, 2, 2, 0.5), (20, 3, 3, -1.0)]


def fitting(h, p, host, path):
    return (host == h or host.endswith("." + h)) and path.startswith(p)


def brute_verdict(url, rules):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
        host, tail = rest[:cut].translate(str.maketrans(url_rules.UPPER, url_rules.SMALL)), rest[cut:]
        path = tail[: min((tail.find(c) for c in "?#" if c in tail), default=len(tail))]
    if not any(fitting(h, p, host, path) for h, p, _ in rules):
        return host, path, None, "block" if not host or any(fitting(h, p, host, path) for h, p, _ in url_rules.OWN_RULES) else "allow"
    fits = [(len(h) + len(p), len(h), h + p, p, v) for h, p, v in rules if fitting(h, p, host, path)]
    return host, path, max(fits)[2], max(fits)[4]


def test_urls_equal_brute_force(spark):
    rng = random.Random(8)
    hosts = ["com", "example.com", "www.example.com", "a.www.example.com", "xexample.com", "net", "b.net", "example.net", "org", "com.org", "WWW.Example.COM", "", "casino-win.org", "example.com:80", ".com", "win.casino", "casino", "a.bet.", "bets.bet", "ex-ample.com", "a..com"]
    tails = ["", "/", "/en/x", "/en", "/es/", "/fr/a?b#c", "?q=/en/", "#f", "/EN/"]
    urls = [f"{rng.choice(['http', 'https', ''])}://{rng.choice(hosts)}{rng.choice(tails)}" for _ in range(400)] + [None, "", "no-scheme.com/en/", "http://a://b.com/", "x" * 5000]
    rules = [*url_rules.BASE_RULES, ("b.net", "/", "allow"), ("example.com", "/", "block"), ("example.com", "/", "block")]
    pages = spark.createDataFrame([(i, u, "h", "k", 1, []) for i, u in enumerate(urls)] + [(0, urls[0], "h", "k", 1, []), (None, urls[0], "h", "k", 1, [])], "page_id long, url string, html string, key string, kind int, stack array<int>")
    frame = spark.createDataFrame(rules, "host string, path string, verdict string")
    for many in (None, True):
        got = url_rules.judge(pages, frame, many).collect()
        assert len(got) == len(urls) + 2
        for r in got:
            assert (r["host"], r["path"], r["rule"], r["verdict"]) == brute_verdict(urls[r["page_id"] or 0], set(rules))
    assert url_rules.judge(pages.limit(0), frame).count() == 0


def test_native_plan(spark):
    df = url_rules.judge(spark.createDataFrame([(1, "http://a.com/")], "page_id long, url string").withColumn("x", F.lit(1)), spark.createDataFrame(url_rules.BASE_RULES, "host string, path string, verdict string"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_pages_that_repeat_are_dealt_out(spark):
    rows = [(7, "https://a.com/x")] * 3000 + [(i, f"https://b{i}.org/") for i in range(6000)]
    pages = spark.createDataFrame(rows, "page_id long, url string").repartition(3)
    found = pages.withColumn("bucket", url_rules.any_bucket(16)).groupBy("bucket").agg(F.count_if(F.col("page_id") == 7).alias("same"), F.count("*").alias("n")).collect()
    assert len(found) == 16 and max(r["n"] for r in found) < 2 * 9000 / 16 and max(r["same"] for r in found) < 3 * 3000 / 16
    rules = spark.createDataFrame(url_rules.BASE_RULES, "host string, path string, verdict string")
    assert url_rules.judge(pages, rules).groupBy("rule", "verdict").count().filter("rule = 'com/' AND verdict = 'allow'").first()["count"] == 3000
