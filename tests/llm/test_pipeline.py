"""The pipeline's stages on the smallest tables, each against a plain version on its own input."""

import os
from collections import defaultdict

import pytest

import corpus_pipeline as P
from helixframe.llm import line_dedup, packing, quality, shared

from .test_documents import brute_components, brute_lines

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_stages(spark):
    docs = shared.table(spark, DATA, "documents")
    assert [n for n, _ in P.STAGES] == ["quality", "line_dedup", "near_dedup", "packing"]
    first = shared.stash(P.STAGES[0][1](spark, docs, DATA), "t1")
    good = {r["doc_id"] for r in quality.score(docs, shared.table(spark, DATA, "labels")).filter("predicted = 1").collect()}
    assert {r["doc_id"] for r in first.collect()} == good and 0 < len(good) < docs.count()

    second = shared.stash(P.STAGES[1][1](spark, first, DATA), "t2")
    rows = [(r["doc_id"], r["text"], r["source"]) for r in first.collect()]
    want = {i: t for i, t in brute_lines(rows, line_dedup.MIN_SITES).items() if t.strip() or t == dict((a, b) for a, b, _ in rows)[i]}
    assert {r["doc_id"]: r["text"] for r in second.collect()} == want
    assert all(r["n_chars"] == len(r["text"]) for r in second.collect())

    third = shared.stash(P.STAGES[2][1](spark, second, DATA), "t3")
    rows = [(r["doc_id"], r["text"], "") for r in second.collect()]
    assert {r["doc_id"] for r in third.collect()} == {i for i, (_, c) in brute_components(rows).items() if i == c}
    assert first.columns == second.columns == third.columns == docs.columns

    packed = P.STAGES[3][1](spark, third, DATA).collect()
    assert {r["doc_id"] for r in packed} == {r["doc_id"] for r in third.collect()}
    used = defaultdict(int)
    for r in packed:
        used[r["sequence_id"]] += r["length"]
    assert max(used.values()) <= packing.SIZE
    assert sorted(map(tuple, P.run(spark, DATA).drop("sequence_id", "offset").collect())) == sorted(tuple(r)[:5] for r in packed)


def test_stages_of_odd_rows(spark, tmp_path):
    """Null, empty, repeated and very long texts, null ids, and columns with names that stages use inside."""
    text = " ".join(f"Word{i} stands here." for i in range(60))
    rows = [(i, f"{text} Number {i} is its own, and so are {i + 1} and {i * 7}.\n\nshared line {i % 2}", f"site{i}") for i in range(12)]
    rows += [(20, None, "a"), (21, "", None), (None, text, "b"), (None, None, None), rows[3], (22, "x" * 50_000, "c"), (23, text, "d"), (23, text, "d")]
    names = "n_lines int, n_removed int, removed string, doc string, predicted int, component_id long, piece int, length string, `a.b` string, n_chars long"
    docs = spark.createDataFrame([(*r, 1, 2, "r", "d", 3, 4, 5, "l", "dot", 6) for r in rows], f"doc_id long, text string, source string, {names}")
    spark.createDataFrame([(i, i % 2, 0) for i in range(12)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for name, stage in P.STAGES:
        got = shared.stash(stage(spark, docs, str(tmp_path)), name)
        if name != "packing":
            assert got.columns == docs.columns
            assert {tuple(r)[3:-1] for r in got.collect()} <= {(1, 2, "r", "d", 3, 4, 5, "l", "dot")}
        none = stage(spark, docs.limit(0), str(tmp_path))
        assert none.count() == 0 and none.columns == got.columns
    kept = P.STAGES[1][1](spark, docs, str(tmp_path)).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["text"] is None) for r in kept) == sorted((i is None, i or 0, t is None) for i, t, _ in rows)
    assert all((r["n_chars"] is None) == (r["text"] is None) and r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in kept)
    near = P.STAGES[2][1](spark, docs, str(tmp_path)).collect()
    want = {i for i, c in brute_components([r for r in rows if r[0] is not None]).items() if i == c[1]}
    assert {r["doc_id"] for r in near if r["doc_id"] is not None} == want and sum(r["doc_id"] is None for r in near) == 2
    packed = P.STAGES[3][1](spark, docs, str(tmp_path)).collect()
    assert len({(r["doc_id"], r["piece"]) for r in packed if r["doc_id"] is not None}) == len([r for r in packed if r["doc_id"] is not None]) - 2
