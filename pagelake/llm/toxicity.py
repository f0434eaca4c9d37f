"""Toxicity: a convolutional text classifier over hashed word embeddings, trained in numpy.

A word (a run of letters and digits, folded) is embedded as the sum of the rows that its hash and the
hashes of its first 4, 5, 6, 7 and 9 bytes select from one table of 2**BUCKET_BITS;
rows that fewer than MIN_DOCS training documents select stay zero; one dimension starts from the
log-odds of toxicity. FILTERS filters of
each width in WIDTHS slide over a text's words; the largest response of each, rectified, feeds a logistic
output. Training uses Adagrad on at most ``sample`` labelled documents that are there, those of the least hashes of doc_id; a
quarter of them, by another hash, is left out. Thresholds come from every labelled document that wasn't trained on, scored where
it lies: each language's is where F1 is best (half-way between the scores next to it, which are counted by steps of
1 / STEPS_OF_SCORE); a language with fewer than MIN_POSITIVE toxic ones there has the threshold of all. Where no such document is toxic, all
labelled ones are used, the trained ones too. Whole texts are read, in training and scoring.

Defined results: a null text counts as an empty one, of no words, scored like any other; labels with a
null id or toxic, and of documents that aren't there, are left out; several labels of one document all count, equal rows are trained on once; a null or unknown language
has the threshold of all; without labels of both classes nothing is toxic; repeated rows and equal texts get equal scores; of documents
with equal hashes those of the lesser ids are trained on; doc_id is a whole number (or a string of one); very long texts are read whole, about 30 bytes of
memory a byte of a text; extra columns are ignored; an empty table gives an empty one.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C
from .simhash import _WORD, fold

BUCKET_BITS, DIM, WIDTHS, FILTERS = 17, 8, (1, 2, 3), 8
PREFIXES = (4, 5, 6, 7, 9)
#: Share of the distinct words that a training batch leaves out, so that no word relies on others.
DROPPED = 0.5
#: At most so many labelled documents are fitted to.
STEPS_OF_SCORE = 100_000
SAMPLE, EPOCHS, STEPS, BATCH, MIN_POSITIVE, MIN_DOCS = 12_000, 8, 600, 64, 8, 4
N_FILTERS = len(WIDTHS) * FILTERS


def hashed_words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The distinct words' hashes and buckets, each word's place among them, and every row's first word."""
    start, end = C.runs(_WORD[data], off)
    first = np.searchsorted(start, off)
    prefix = C.prefix_hash(C.BYTE_VALUES[fold(data)])
    hashes, once, word = np.unique(C.range_hash(prefix, start, end), return_index=True, return_inverse=True)
    start, end = start[once], end[once]
    ends = [end, *[np.minimum(start + n, end) for n in PREFIXES]]
    salted = [C.mix(C.range_hash(prefix, start, e) + np.uint64(k * 0x632BE59B)) >> np.uint64(64 - BUCKET_BITS) for k, e in enumerate(ends)]
    return hashes, np.stack(salted, 1).astype(np.int32), word, first


def word_buckets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct words' buckets, each word's place among them, and every row's first word, part by part to keep the work arrays small."""
    parts = [hashed_words(*C.text_bytes(b.column(0))) for b in C.sub_batches([pa.record_batch([texts], ["text"])])]
    if not parts:
        return np.zeros((0, len(PREFIXES) + 1), np.int32), np.zeros(0, np.int32), np.zeros(1, np.int64)
    _, once, place = np.unique(np.concatenate([p[0] for p in parts]), return_index=True, return_inverse=True)
    buckets = np.concatenate([p[1] for p in parts])[once]
    edge = np.cumsum([0, *[len(p[0]) for p in parts]])
    word = np.concatenate([place[e : e + len(p[0])].astype(np.int32)[p[2]] for e, p in zip(edge, parts)])
    return buckets, word, np.concatenate([[0], np.cumsum(np.concatenate([np.diff(p[3]) for p in parts]))])


@dataclass
class Net:
    table: np.ndarray
    kernels: list[np.ndarray]  # by width: width x DIM x FILTERS
    shift: np.ndarray
    out: np.ndarray
    bias: float = 0.0
    thresholds: dict[str, float] = field(default_factory=dict)
    threshold: float = 2.0

    def responses(self, vectors: np.ndarray, word: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, list, np.ndarray, np.ndarray]:
        """Every row's largest response of each filter, all windows' responses by width, where the rows' windows lie, and the padded words."""
        n = len(first) - 1
        # two empty words stand after each text, a third for one without words, so that any has a window of any width
        pad, count = max(WIDTHS) - 1, np.diff(first)
        size = np.maximum(count, 1) + pad
        at = np.cumsum(size) - size
        padded = np.full(int(size.sum()), len(vectors), np.int64)
        padded[C.ragged(at, count)] = word
        known = np.vstack([vectors, np.zeros((1, DIM), np.float32)])
        edge = np.stack([at, at + size - pad], 1)  # windows begin at a text's words, or at its first place
        top, every = np.empty((n, N_FILTERS), np.float32), []
        for k, (width, kernel) in enumerate(zip(WIDTHS, self.kernels)):
            r = known @ kernel[0]
            total = r[padded]
            for j in range(1, width):
                total[:-j] += (known @ kernel[j])[padded[j:]]
            top[:, k * FILTERS : (k + 1) * FILTERS] = np.maximum.reduceat(total, edge.ravel(), 0)[::2]
            every.append(total)
        return top, every, edge, padded

    def embed(self, buckets: np.ndarray) -> np.ndarray:
        return self.table[buckets].sum(1)

    def logits(self, top: np.ndarray) -> np.ndarray:
        return np.maximum(top + self.shift, 0) @ self.out + self.bias

    def score(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        _, buckets, word, first = hashed_words(data, off)
        if not len(off) - 1:
            return np.zeros(0)
        z = self.logits(self.responses(self.embed(buckets), word, first)[0]).astype(np.float64)
        return np.round(1 / (1 + np.exp(-np.clip(z, -30, 30))), 6)

    def toxic(self, score: np.ndarray, lang: list) -> np.ndarray:
        return score >= np.array([self.thresholds.get(x, self.threshold) for x in lang])


def fresh(seed: int = 5) -> Net:
    rng = np.random.Generator(np.random.PCG64(seed))
    kernels = [(rng.normal(0, 0.5, (w, DIM, FILTERS)) / np.sqrt(w)).astype(np.float32) for w in WIDTHS]
    return Net(rng.normal(0, 0.3, (1 << BUCKET_BITS, DIM)).astype(np.float32), kernels, np.zeros(N_FILTERS, np.float32), rng.normal(0.3, 0.1, N_FILTERS).astype(np.float32), -2.0)


def _documents(buckets: np.ndarray, word: np.ndarray, first: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many texts, and how many toxic ones, select each row of the table."""
    n, toxic = np.zeros(1 << BUCKET_BITS), np.zeros(1 << BUCKET_BITS)
    for lo in range(0, len(first) - 1, 500):
        edge = first[lo : lo + 501]
        row = np.repeat(np.arange(len(edge) - 1), np.diff(edge))
        pair = np.unique(row * len(buckets) + word[edge[0] : edge[-1]])
        row, own = pair // max(1, len(buckets)), pair % max(1, len(buckets))
        for k in range(buckets.shape[1]):
            chosen = np.unique(row << BUCKET_BITS | buckets[own, k])
            bucket = chosen & ((1 << BUCKET_BITS) - 1)
            n += np.bincount(bucket, minlength=len(n))
            toxic += np.bincount(bucket, y[lo + (chosen >> BUCKET_BITS)], len(n))
    return n, toxic


def gradients(net: Net, vectors: np.ndarray, local: np.ndarray, first: np.ndarray, y: np.ndarray, heavy: np.ndarray) -> tuple[list, float, np.ndarray]:
    """Of the mean weighted logistic loss of some texts: by shift, out and kernels, by the bias, and by the words' vectors."""
    top, every, edge, padded = net.responses(vectors, local, first)
    hidden = np.maximum(top + net.shift, 0)
    p = 1 / (1 + np.exp(-np.clip(hidden @ net.out + net.bias, -30, 30)))
    g = ((p - y) * heavy / len(y)).astype(np.float32)
    g_top = g[:, None] * net.out * (hidden > 0)
    known = np.vstack([vectors, np.zeros((1, DIM), np.float32)])
    g_known = np.zeros_like(known)
    grads = [g_top.sum(0), g @ hidden]
    span = edge[:, 1] - edge[:, 0]
    inside = C.ragged(edge[:, 0], span)
    begin = np.cumsum(span) - span
    for k, (width, kernel) in enumerate(zip(WIDTHS, net.kernels)):
        part = slice(k * FILTERS, (k + 1) * FILTERS)
        is_top = every[k][inside] == np.repeat(top[:, part], span, 0)
        # the first window of each maximum
        hit = np.flatnonzero(is_top.T.ravel())
        filt, place = hit // len(inside), hit % len(inside)
        row = np.searchsorted(begin, place, "right") - 1
        _, once = np.unique(filt * len(y) + row, return_index=True)
        filt, place, row = filt[once], place[once], row[once]
        weight = g_top[row, k * FILTERS + filt]
        g_kernel = np.zeros_like(kernel)
        for j in range(width):
            at = padded[inside[place] + j]
            np.add.at(g_kernel[j].T, filt, weight[:, None] * known[at])
            np.add.at(g_known, at, weight[:, None] * kernel[j].T[filt])
        grads.append(g_kernel)
    return grads, float(g.sum()), g_known[:-1]


def train(texts: pa.Array, y: np.ndarray, epochs: int = EPOCHS, rate: float = 0.1, seed: int = 5, steps: int = STEPS) -> Net:
    """Adagrad on the weighted logistic loss, ``epochs`` times over and for ``steps`` batches at least; only the windows that a maximum came from pass gradients on."""
    net = fresh(seed)
    rng = np.random.Generator(np.random.PCG64(seed + 1))
    buckets, word, first = word_buckets(texts)
    heavy = np.where(y > 0, min(8.0, 0.5 * (len(y) - y.sum()) / max(1, y.sum())) if len(y) else 1.0, 1.0)
    among, toxic = _documents(buckets, word, first, y)
    # one dimension starts from the log-odds of toxicity, so that telling words are the maxima from the first
    odds = np.log((toxic + 0.5) / (y.sum() + 1)) - np.log((among - toxic + 0.5) / (len(y) - y.sum() + 1))
    net.table[:, 0] = 0.2 * np.clip(odds, -3, 3)
    frozen = among < MIN_DOCS
    net.table[frozen] = 0
    epochs = max(epochs, -(-steps * BATCH // max(1, len(y))))
    parameters = [net.shift, net.out, *net.kernels]
    squares = [np.full_like(p, 1e-2) for p in parameters]
    table_squares = np.full(len(net.table), 1e-2, np.float32)
    bias_square = 1e-2
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for lo in range(0, len(order), BATCH):
            rows = order[lo : lo + BATCH]
            size = first[rows + 1] - first[rows]
            words = word[C.ragged(first[rows], size)]
            own, local = np.unique(words, return_inverse=True)
            there = rng.random(len(own)) >= DROPPED
            vectors = net.embed(buckets[own]) * there[:, None].astype(np.float32)
            grads, g_bias, g_known = gradients(net, vectors, local, np.concatenate([[0], np.cumsum(size)]), y[rows], heavy[rows])
            for value, square, grad in zip(parameters, squares, grads):
                square += grad * grad
                value -= rate * grad / np.sqrt(square)
            bias_square += g_bias**2
            net.bias -= rate * g_bias / np.sqrt(bias_square)
            touched = np.flatnonzero(np.any(g_known, 1) & there)
            at, of = buckets[own[touched]].ravel(), np.repeat(g_known[touched], buckets.shape[1], 0)
            at, of = at[~frozen[at]], of[~frozen[at]]
            rows_of, back = np.unique(at, return_inverse=True)
            total = np.zeros((len(rows_of), DIM), np.float32)
            np.add.at(total, back, of)
            table_squares[rows_of] += (total * total).sum(1)
            net.table[rows_of] -= rate * total / np.sqrt(table_squares[rows_of])[:, None]
    return net


def best_threshold(score: np.ndarray, toxic: np.ndarray, n: np.ndarray | None = None) -> float:
    """Where F1 is best, half-way to the next lower score; each score stands for ``n`` documents, ``toxic`` of them toxic."""
    order = np.argsort(-score, kind="stable")
    s, hits, found = score[order], np.cumsum(toxic[order]), np.cumsum((np.ones(len(score)) if n is None else n)[order])
    f1 = 2 * hits / (found + toxic.sum())
    last = np.append(s[1:] != s[:-1], True)
    k = int(np.where(last, f1, -1).argmax())
    return float((s[k] + (s[k + 1] if k + 1 < len(s) else 0.0)) / 2)


def known(labels: DataFrame) -> DataFrame:
    return labels.where("doc_id is not null and toxic is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("double").alias("y")).withColumn("h", F.xxhash64("doc_id"))


def trained(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[Net, list[int]]:
    """A net without thresholds, and the ids of the documents that it was trained on, none if there aren't two classes."""
    there = known(labels).join(docs.select(F.col("doc_id").cast("long").alias("doc_id")), "doc_id", "left_semi")
    chosen = there.distinct().orderBy("h", "doc_id", "y").limit(sample)
    rows = C.texts(docs, "lang").join(F.broadcast(chosen), "doc_id").select("h", "doc_id", "y", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("t", F.xxhash64("text")).dropDuplicates(["doc_id", "y", "t"]).orderBy("h", "doc_id", "y", "t").limit(sample).toArrow()
    y = rows.column("y").to_numpy()
    if not len(y) or y.min() == y.max():
        return fresh(), []
    held = (rows.column("h").to_numpy() >> 7) % 4 == 0
    if not y[~held].any() or y[~held].all():
        held[:] = False
    text = rows.column("text").cast(pa.large_string()).combine_chunks()
    return train(text.filter(pa.array(~held)), y[~held]), rows.column("doc_id").to_numpy()[~held].tolist()


def calibrate(net: Net, raw: DataFrame, labels: DataFrame, ids: list[int]) -> None:
    """The thresholds, from the scores of all labelled documents but those trained on, counted by language and step."""
    if not ids:
        return
    seen = F.broadcast(raw.sparkSession.createDataFrame([(x, True) for x in sorted(set(ids))], "doc_id long, seen boolean"))
    rows = raw.join(known(labels).select("doc_id", "y"), "doc_id").join(seen, "doc_id", "left")
    step = F.floor(F.col("score") * STEPS_OF_SCORE).cast("int")
    found = rows.groupBy("lang", step.alias("step"), F.col("seen").isNull().alias("unseen")).agg(F.count("*").alias("n"), F.sum("y").alias("toxic")).collect()
    use = [r for r in found if r.unseen]
    if not sum(r.toxic for r in use):
        use = found

    def threshold(rows):
        return best_threshold(*(np.array(x, float) for x in zip(*((r.step / STEPS_OF_SCORE, r.toxic, r.n) for r in rows))))

    net.threshold = threshold(use)
    for x in {r.lang for r in use} - {None}:
        own = [r for r in use if r.lang == x]
        if sum(r.toxic for r in own) >= MIN_POSITIVE:
            net.thresholds[x] = threshold(own)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Net:
    """Trained on ``sample`` labelled documents at most, calibrated on all others."""
    net, ids = trained(docs, labels, sample)
    calibrate(net, raw_scores(docs, net), labels, ids)
    return net


def raw_scores(docs: DataFrame, net: Net) -> DataFrame:
    """doc_id, lang, score (probability) of every document."""

    def run(batches):
        for b in C.sub_batches(batches):
            yield pa.record_batch([C.column(b, "doc_id"), C.column(b, "lang"), pa.array(net.score(*C.text_bytes(C.column(b, "text"))))], ["doc_id", "lang", "score"])

    return C.texts(docs, "lang").mapInArrow(C.tidy(run), "doc_id long, lang string, score double")


def judged(raw: DataFrame, net: Net) -> DataFrame:
    """The scores with toxic: at or above the language's threshold."""
    own = F.lit(net.threshold)
    for lang, threshold in net.thresholds.items():
        own = F.when(F.col("lang") == lang, threshold).otherwise(own)
    return raw.withColumn("toxic", F.col("score") >= own)


def score(docs: DataFrame, net: Net) -> DataFrame:
    """doc_id, lang, score (probability) and toxic of every document."""
    return judged(raw_scores(docs, net), net)


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = C.read(spark, sf_dir, "documents"), C.read(spark, sf_dir, "labels")
    net, ids = trained(docs, labels)
    raw = C.checkpoint(raw_scores(docs, net))
    calibrate(net, raw, labels, ids)
    return judged(raw, net)
