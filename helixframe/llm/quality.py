"""Quality classifier: regularised quadratic discriminant over transformed document statistics.

A document's statistics (shares of kinds of bytes, word lengths, repetition, line lengths) are taken over its whole text and
transformed so that they are roughly bell-shaped: logits of smoothed shares, logarithms of sizes. Each class has a mean
and a covariance, shrunk towards the pooled covariance and towards its diagonal. They come from sums over all labelled
rows that may be learned from, added up by Spark: what reaches the driver is a matrix for each class. A score is the
difference of the two Mahalanobis log-densities and the log prior, by the inverses of the cached Cholesky factors,
calibrated by a logistic curve on the histogram of the training rows' differences (BINS bins).

Cases: null and empty texts have the statistics of an empty text and are scored like any other; labels other than 0 and 1
and null labels are left out; a doc_id with several labels takes the largest; a null doc_id is held out; repeated rows are
scored alike; if a class has no row to learn from, every score is the smoothed share of label 1 (0.5 without labels); an
empty table gives an empty result. Sums are added in the order in which tasks end, so scores can differ between runs in their last
digits. keep_good passes all other columns through whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bytestext as bt
from .shared import discard, short_batches, stash, table

KEEP_FROM = 0.3
TO_POOLED, TO_DIAGONAL, RIDGE = 0.15, 0.05, 1e-3
BINS, MOST = 2048, 30.0
SYMBOLS = b"#$%&*|<>{}[]\\^~=+_@"
_IN = {
    "upper": bt.byte_class((0x41, 0x5A)),
    "lower": bt.byte_class((0x61, 0x7A)),
    "digit": bt.byte_class((0x30, 0x39)),
    "beyond": bt.byte_class((0x80, 0xFF)),
    "stop": bt.byte_class((0x2C, 0x2C), (0x2E, 0x2E), (0x3A, 0x3B), (0x3F, 0x3F)),
    "shout": bt.byte_class((0x21, 0x21)),
    "symbol": np.isin(np.arange(256), list(SYMBOLS)),
    "pipe": bt.byte_class((0x7C, 0x7C)),
    "white": ~bt.SOLID,
}
STATISTICS = 16
#: Bytes of text looked at together.
CHUNK = 1 << 18


def _share(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """Logit of a smoothed share."""
    p = (part + 0.5) / (np.maximum(whole, part) + 1.0)
    return np.log(p / (1 - p + 1e-9))


def statistics(texts: pa.Array) -> Iterator[np.ndarray]:
    """Chunk by chunk, a row of STATISTICS numbers for each text."""
    for _, _, flat, offsets in bt.chunks(texts, CHUNK):
        n = len(offsets) - 1
        kinds = np.bincount(np.repeat(np.arange(n) * 256, np.diff(offsets)) + flat, minlength=n * 256).reshape(n, 256)
        of = {k: kinds[:, m].sum(axis=1) for k, m in _IN.items()}
        solid = np.diff(offsets) - of["white"]
        letters = of["upper"] + of["lower"]
        starts, ends, rows = bt.spans(flat, offsets, bt.SOLID)
        words, lengths = np.diff(rows), ends - starts
        owner = np.repeat(np.arange(n), words)
        hashes = bt.hash_spans(flat, starts, ends)
        order = np.lexsort((hashes, owner))
        new = np.ones(len(order), dtype=bool)
        new[1:] = (hashes[order][1:] != hashes[order][:-1]) | (owner[order][1:] != owner[order][:-1])
        distinct = np.bincount(owner[order][new], minlength=n)
        runs = np.diff(np.append(np.flatnonzero(new), len(order)))
        common = np.zeros(n, dtype=np.int64)
        np.maximum.at(common, owner[order][new], runs)
        again = np.bincount(owner[1:][(hashes[1:] == hashes[:-1]) & (owner[1:] == owner[:-1])], minlength=n)
        marked = np.bincount(owner[(_IN["symbol"] | _IN["shout"])[flat[ends - 1]]], minlength=n) if len(ends) else np.zeros(n)
        capital = np.bincount(owner[_IN["upper"][flat[starts]]], minlength=n) if len(starts) else np.zeros(n)
        total, squares = (np.bincount(owner, weights=w, minlength=n) for w in (lengths, lengths.astype(float) ** 2))
        mean = total / np.maximum(words, 1)
        lines = kinds[:, 10] + 1
        yield np.stack(
            [
                np.log1p(words), np.log1p(mean), np.log1p(np.sqrt(np.maximum(squares / np.maximum(words, 1) - mean**2, 0))), np.log1p(np.diff(offsets) / lines),
                _share(of["upper"], letters), _share(of["digit"], solid), _share(of["beyond"], solid), _share(of["stop"], solid), _share(of["shout"], solid),
                _share(of["symbol"], solid), _share(of["pipe"], solid), _share(again, words), _share(common, words), _share(marked, words), _share(capital, words),
                np.log(distinct + 1.0) - 0.8 * np.log(words + 1.0),
            ],
            axis=1,
        )


@F.arrow_udf(T.ArrayType(T.DoubleType()))
def describe(texts: pa.Array) -> pa.Array:
    rows = np.concatenate([np.zeros((0, STATISTICS)), *statistics(texts)])
    return pa.ListArray.from_arrays(pa.array(np.arange(0, rows.size + 1, STATISTICS, dtype=np.int32)), pa.array(rows.ravel()))


@dataclass
class Model:
    """Means, inverses of Cholesky factors and log constants of classes 0 and 1, and the calibration; None where a class is missing."""

    means: np.ndarray
    factors: np.ndarray
    constants: np.ndarray
    slope: float = 1.0
    shift: float = 0.0

    def difference(self, x: np.ndarray) -> np.ndarray:
        """Log-density and prior of class 1 less those of class 0, kept within MOST of 0 by a bent scale."""
        logs = [self.constants[c] - 0.5 * (((x - self.means[c]) @ self.factors[c].T) ** 2).sum(axis=1) for c in (0, 1)]
        return np.clip(np.arcsinh((logs[1] - logs[0]) / 2) * 2, -MOST, MOST)

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.slope * self.difference(x) + self.shift)))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, STATISTICS)


def class_sums(rows: DataFrame) -> DataFrame:
    """(quality, i, value) over rows with x and quality: number, sums and sums of products, numbered through."""

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, (STATISTICS + 1) ** 2))
        for batch in batches:
            x = np.column_stack([np.ones(batch.num_rows), _matrix(batch.column(0))])
            y = batch.column(1).to_numpy(zero_copy_only=False)
            for c in (0, 1):
                total[c] += (x[y == c].T @ x[y == c]).ravel()
        each = total.shape[1]
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat([0, 1], each)), pa.array(np.tile(np.arange(each), 2)), pa.array(total.ravel())], ["quality", "i", "value"])

    return rows.select("x", "quality").mapInArrow(added, "quality long, i long, value double").groupBy("quality", "i").agg(F.sum("value").alias("value"))


def calibrate(values: np.ndarray, counts: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic curve through the counts of classes 0 and 1 at values, by Newton steps with a light pull to slope 1, shift 0."""
    w = np.array([1.0, 0.0])
    x = np.column_stack([values, np.ones(len(values))])
    n = counts.sum(axis=0)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -500, 500)))
        gradient = x.T @ (counts[1] - n * p) - (w - [1.0, 0.0])
        step = np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + np.eye(2), gradient)
        w = w + np.clip(step, -1, 1)
        if np.abs(step).max() < 1e-9:
            break
    return float(max(w[0], 1e-3)), float(w[1])


def fit(described: DataFrame, labels: DataFrame) -> Model | float:
    """The model of described (doc_id, x) and labels (doc_id, quality), from rows that aren't held out; a share if a class is missing."""
    known = labels.filter("quality IN (0, 1)").groupBy("doc_id").agg(F.max("quality").cast("long").alias("quality"))
    rows = stash(described.join(known, "doc_id").filter(~held_out(F.col("doc_id"))).select("x", "quality"), "labelled")
    sums = np.zeros((2, (STATISTICS + 1) ** 2))
    for r in class_sums(rows).collect():  # two matrices
        sums[r["quality"], r["i"]] = r["value"]
    sums = sums.reshape(2, STATISTICS + 1, STATISTICS + 1)
    n = sums[:, 0, 0]
    if not n.all():
        return float((n[1] + 1) / (n.sum() + 2))
    means = sums[:, 0, 1:] / n[:, None]
    own = sums[:, 1:, 1:] / n[:, None, None] - means[:, :, None] * means[:, None, :]
    pooled = (own * n[:, None, None]).sum(axis=0) / n.sum()
    factors, constants = [], []
    for c in (0, 1):
        trust = n[c] / (n[c] + 2 * STATISTICS)  # a class of few rows leans on the pooled covariance
        shrunk = own[c] * trust * (1 - TO_POOLED) + pooled * (1 - trust * (1 - TO_POOLED))
        shrunk = shrunk * (1 - TO_DIAGONAL) + np.diag(np.diag(shrunk)) * TO_DIAGONAL + RIDGE * np.eye(STATISTICS)
        root = np.linalg.cholesky(shrunk)
        factors.append(np.linalg.inv(root))
        constants.append(np.log(n[c] / n.sum()) - np.log(np.diag(root)).sum())
    model = Model(means, np.array(factors), np.array(constants))

    @F.arrow_udf(T.LongType())
    def bin_of(x: pa.Array) -> pa.Array:
        return pa.array(((model.difference(_matrix(x)) + MOST) / (2 * MOST) * (BINS - 1)).round().astype(np.int64))

    counts = np.zeros((2, BINS))
    for r in rows.groupBy("quality", bin_of("x").alias("bin")).count().collect():  # BINS rows a class
        counts[r["quality"], r["bin"]] = r["count"]
    model.slope, model.shift = calibrate(np.linspace(-MOST, MOST, BINS), counts)
    return model


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of each row of docs, which has doc_id and text."""
    short_batches(docs.sparkSession)
    described = stash(docs.select("doc_id", describe("text").alias("x")), "statistics")
    model = fit(described, labels.select("doc_id", "quality"))
    if isinstance(model, float):
        value = F.lit(model)
    else:

        @F.arrow_udf(T.DoubleType())
        def scored(x: pa.Array) -> pa.Array:
            return pa.array(model.scores(_matrix(x)))

        value = scored("x")
    found = described.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), value.alias("score"))
    return found.withColumn("predicted", (F.col("score") >= KEEP_FROM).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that score at least KEEP_FROM, each by its own text: one pass that neither joins nor shuffles them, after the fit's own."""
    short_batches(docs.sparkSession)
    described = stash(docs.select("doc_id", describe("text").alias("x")), "statistics")
    model = fit(described, labels.select("doc_id", "quality"))
    discard(described)
    if isinstance(model, float):
        return docs if model >= KEEP_FROM else docs.limit(0)

    @F.arrow_udf(T.BooleanType())
    def good(texts: pa.Array) -> pa.Array:
        return pa.array(np.concatenate([np.zeros(0, dtype=bool), *(model.scores(x) >= KEEP_FROM for x in statistics(texts))]))

    return docs.filter(good("text"))


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
