"""Quality classifier: random Fourier features of document statistics, ridge regression, isotonic calibration.

Statistics are eleven numbers from one pass over a text's bytes. ``fit`` standardises them, maps them
to random Fourier features (an approximation of a Gaussian kernel), sums the normal equations by
partition, solves them for ridge scores, and calibrates the scores isotonically on labelled rows
held out by a hash of doc_id, counted by steps of 1 / BINS of the score. All labelled rows are used.

Defined results: a null text counts as an empty one; labels with a null id or quality are left out;
several labels of a document all count; without labels of both classes every document gets the
labels' mean (1 without labels), so nothing is rejected unless all labels say so; extra columns are
passed through by ``filter_quality`` and ignored elsewhere; ties and repeated rows get equal scores;
doc_id is a whole number (or a string of one); very long texts are read whole, as one row of work arrays of about 30 bytes a byte of text;
an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

CLASSES = np.full(256, 6, np.int64)
CLASSES[128:] = 7
CLASSES[65:91], CLASSES[97:123], CLASSES[48:58] = 0, 1, 2
CLASSES[[9, 11, 12, 13, 32]], CLASSES[10] = 3, 4
CLASSES[[ord(c) for c in ".,;:'\"!?-()"]] = 5
N_STATS, N_FEATURES, SLOTS, BINS = 11, 256, 8, 100_000


def statistics(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """A row of N_STATS numbers for each text."""
    n, size = len(off) - 1, np.diff(off)
    counts = np.bincount(np.repeat(np.arange(n) * 8, size) + CLASSES[data], minlength=8 * n).reshape(n, 8).astype(float)
    start, end, first = C.words(data, off)
    n_words, total = np.diff(first), np.maximum(size, 1)
    length = np.bincount(np.repeat(np.arange(n), n_words), weights=(end - start).astype(float), minlength=n) / np.maximum(n_words, 1)
    long_words = np.bincount(np.repeat(np.arange(n), n_words), weights=(end - start > 15).astype(float), minlength=n) / np.maximum(n_words, 1)
    h = C.hash_ranges(data, start, end)
    again = np.zeros(len(h))
    again[1:] = h[1:] == h[:-1]
    again[first[:-1][n_words > 0]] = 0  # a text's first word follows none
    again = np.bincount(np.repeat(np.arange(n), n_words), weights=again, minlength=n) / np.maximum(n_words, 1)
    cols = [np.log1p(size), np.log1p(n_words), length, long_words, (counts[:, 1] + counts[:, 7]) / total, 10 * counts[:, 0] / total, 10 * counts[:, 2] / total, 10 * counts[:, 5] / total, 10 * counts[:, 6] / total, 10 * counts[:, 4] / np.maximum(n_words, 1), 10 * again]
    return np.stack(cols, 1)


def matrix(lists: pa.Array) -> np.ndarray:
    return np.asarray(lists.flatten()).reshape(-1, N_STATS)


def _stats_batches(batches):
    for b in C.sub_batches(batches):
        x = statistics(*C.text_bytes(C.column(b, "text")))
        yield pa.record_batch([C.column(b, "doc_id"), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), N_STATS).cast(pa.list_(pa.float64()))], ["doc_id", "x"])


def projection(seed: int = 11, gamma: float = 0.05) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.Generator(np.random.PCG64(seed))
    return rng.normal(0, np.sqrt(2 * gamma), (N_STATS, N_FEATURES)), rng.uniform(0, 2 * np.pi, N_FEATURES)


def fourier(x: np.ndarray, mean: np.ndarray, sd: np.ndarray) -> np.ndarray:
    """Features whose inner products approximate exp(-gamma * squared distance), and a constant."""
    w, b = projection()
    return np.hstack([np.sqrt(2 / N_FEATURES) * np.cos((x - mean) / sd @ w + b), np.ones((len(x), 1))])


@dataclass
class Model:
    mean: np.ndarray
    sd: np.ndarray
    weights: np.ndarray
    knots: np.ndarray  # scores from which a value holds
    values: np.ndarray
    prior: float = 1.0

    def scores(self, x: np.ndarray) -> np.ndarray:
        return fourier(x, self.mean, self.sd) @ self.weights if len(self.weights) else np.full(len(x), self.prior)

    def calibrated(self, s: np.ndarray) -> np.ndarray:
        if not len(self.knots):
            return np.full(len(s), self.prior)
        return self.values[np.clip(np.searchsorted(self.knots, s, "right") - 1, 0, len(self.knots) - 1)]

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        s = np.round(self.scores(x), 9)
        return s, self.calibrated(s)


def isotonic(total: np.ndarray, good: np.ndarray) -> np.ndarray:
    """Pool adjacent violators: the non-decreasing fit to good / total, by least squares weighted by total."""
    stack: list[list[float]] = []
    for n, g in zip(total, good):
        stack.append([g, n, 1])
        while len(stack) > 1 and stack[-2][0] * stack[-1][1] >= stack[-1][0] * stack[-2][1]:
            g2, n2, c2 = stack.pop()
            stack[-1][0] += g2
            stack[-1][1] += n2
            stack[-1][2] += c2
    return np.concatenate([np.full(int(c), g / n) for g, n, c in stack]) if stack else np.zeros(0)


def _merge_sums(batches):
    sums: dict[int, np.ndarray] = {}
    for b in batches:
        for slot, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            a = np.frombuffer(blob)
            sums[slot] = sums[slot] + a if slot in sums else a
    yield pa.record_batch([pa.array(list(sums), pa.int32()), pa.array([a.tobytes() for a in sums.values()], pa.binary())], ["slot", "sums"])


def _partition_sums(mean, sd):
    def sums(batches):
        d = N_FEATURES + 1
        a = np.zeros((d, d + 1))
        for b in batches:
            y = C.column(b, "y").to_numpy()
            z = fourier(matrix(C.column(b, "x")), mean, sd)
            a += z.T @ np.hstack([z, y[:, None]])
        if a.any():
            yield pa.record_batch([pa.array([int(abs(a[0, 0]) * 1e6) % SLOTS], pa.int32()), pa.array([a.tobytes()], pa.binary())], ["slot", "sums"])

    return sums


def _binned(model):
    def score(batches):
        for b in batches:
            if b.num_rows:
                s = model.scores(matrix(C.column(b, "x")))
                yield pa.record_batch([pa.array(np.floor(s * BINS).astype(np.int64)), C.column(b, "y")], ["k", "y"])

    return score


def fit(docs: DataFrame, labels: DataFrame, ridge: float = 1e-3, held_out: int = 5) -> Model:
    """The model of the labelled documents; one in ``held_out`` is kept for the calibration."""
    stats = C.texts(docs).mapInArrow(C.tidy(_stats_batches), "doc_id long, x array<double>")
    known = labels.where("quality is not null and doc_id is not null").select("doc_id", F.col("quality").cast("double").alias("y"))
    rows = C.checkpoint(stats.join(known, "doc_id").withColumn("held", F.pmod(F.xxhash64("doc_id"), F.lit(held_out)) == 0))
    head = rows.agg(F.count("*"), F.avg("y"), F.min("y"), F.max("y"), *[f(F.col("x")[i]) for i in range(N_STATS) for f in (F.avg, F.stddev_pop)], F.max("held"), F.min("held")).first()
    n, prior, low, high = head[:4]
    nothing = np.zeros(0)
    if not n or low == high:
        return Model(nothing, nothing, nothing, nothing, nothing, prior if n else 1.0)
    mean = np.array(head[4 : 4 + 2 * N_STATS : 2])
    sd = np.maximum(np.array(head[5 : 5 + 2 * N_STATS : 2]), 1e-6)
    train = rows.where("not held") if not head[-1] else rows
    sums = train.select("x", "y").mapInArrow(_partition_sums(mean, sd), "slot int, sums binary")
    total = sum(np.frombuffer(r.sums) for r in sums.repartition(SLOTS, "slot").mapInArrow(_merge_sums, "slot int, sums binary").collect())
    d = N_FEATURES + 1
    a = total.reshape(d, d + 1)
    weights = np.linalg.solve(a[:, :d] + ridge * n * np.eye(d) / d, a[:, d])
    model = Model(mean, sd, weights, nothing, nothing, prior)
    held = rows.where("held") if head[-2] else rows
    bins = sorted(held.select("x", "y").mapInArrow(_binned(model), "k long, y double").groupBy("k").agg(F.count("*").alias("n"), F.sum("y").alias("good")).collect())
    model.values = isotonic(np.array([b.n for b in bins], float), np.array([b.good for b in bins]))
    model.knots = np.array([b.k for b in bins]) / BINS
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, prob (calibrated probability of good quality) and keep (prob of a half or more) of every document."""

    def run(batches):
        for b in C.sub_batches(batches):
            s, p = model.predict(statistics(*C.text_bytes(C.column(b, "text"))))
            yield pa.record_batch([C.column(b, "doc_id"), pa.array(s), pa.array(p), pa.array(p >= 0.5)], ["doc_id", "score", "prob", "keep"])

    return C.texts(docs).mapInArrow(C.tidy(run), "doc_id long, score double, prob double, keep boolean")


def filter_quality(docs: DataFrame, model: Model) -> DataFrame:
    """The documents that the classifier keeps, all columns as they were."""

    @F.arrow_udf("boolean")
    def keeps(text: pa.Array) -> pa.Array:
        parts = [model.predict(statistics(*C.text_bytes(C.column(b, "text"))))[1] >= 0.5 for b in C.sub_batches([pa.record_batch([text], ["text"])])]
        C.release()
        return pa.array(np.concatenate(parts) if parts else np.zeros(0, bool))

    return docs.where(keeps(docs["text"]))


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.read(spark, sf_dir, "documents")
    return score(docs, fit(docs, C.read(spark, sf_dir, "labels")))
