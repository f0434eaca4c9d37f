"""Language-model scores by deleted interpolation of word n-grams.

The symbols are the text's words (runs of bytes that are no ASCII white space, as they stand) and an end
after the last. One document in HELD, by a hash of doc_id, is held out: maximum-likelihood estimates of
orders three to one and a uniform one over the vocabulary, from the others, are mixed with weights that
expectation-maximisation learns on the held-out words, a set of weights for each bucket of the context's
frequency (by powers of two). With these weights, estimates from all documents score every document.

No table of counts is ever in one place. Documents are worked on in units of about UNIT bytes, held out or
not; a unit's distinct n-grams, as 56 bits of a hash, go to the part of the key space that they lie in,
where the counts of all units are added up, and the sums go back to the units that hold the n-gram. A unit
finds them in its file in the shared folder, in the order of its sorted keys. What it holds out lies in another
file, equal rows of estimates once with their number, which every round of expectation-maximisation maps into
memory. The mixture's weights and three sums are all that the driver sees.

Defined results: a null text has null scores; one without words has no symbols, log-probability 0 and a
null perplexity, and isn't counted; n_symbols counts the end; rows of a null doc_id count and are scored;
repeated rows count each time, and equal texts score alike; doc_id is a whole number (or a string of one); very long texts are read whole, as one row of work arrays of about 30 bytes a byte of text,
and one fills a unit by itself; extra columns are ignored; an empty table gives an empty one.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

ORDER, HELD, BUCKETS, ROUNDS = 3, 10, 48, 40
UNIT, PART, KEY_BITS = 12 << 20, 16 << 20, 56
BEGIN, END = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)
SCHEMA = "doc_id long, n_symbols int, log_prob double, perplexity double"


def pack(x: np.ndarray) -> bytes:
    """Compressed whole numbers, byte by byte of all of them, as the high bytes are mostly alike."""
    return pa.compress(np.ascontiguousarray(x.astype(np.int64).view(np.uint8).reshape(-1, 8).T).tobytes(), codec="zstd", asbytes=True) if len(x) else b""


def unpack(packed: bytes, n: int) -> np.ndarray:
    if not n:
        return np.zeros(0, np.int64)
    return np.ascontiguousarray(np.frombuffer(pa.decompress(packed, 8 * n, codec="zstd"), np.uint8).reshape(8, n).T).view(np.int64).ravel()


def sequence(texts: list[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all texts' words, each text's followed by END, and each text's number of symbols."""
    parts, sizes = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for b in C.sub_batches(iter(texts)):
        data, off = C.text_bytes(C.column(b, "text"))
        start, end, first = C.words(data, off)
        n = np.diff(first)
        size = n + (n > 0)
        w = np.full(size.sum(), END)
        inside = np.ones(len(w), bool)
        inside[np.cumsum(size)[n > 0] - 1] = False
        w[inside] = C.hash_ranges(data, start, end)
        parts.append(w)
        sizes.append(size)
    return np.concatenate(parts), np.concatenate(sizes)


def keys_of(w: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every symbol's keys of orders one to three, and whether it is its text's first. Keys of order one are odd."""
    first = np.zeros(len(w), bool)
    first[(np.cumsum(size) - size)[size > 0]] = True
    back = np.concatenate([[BEGIN], w])[:-1]
    back[first] = BEGIN
    two = C.mix(back * C.MIX1 + w)
    before = np.concatenate([[BEGIN], two])[:-1]  # the context of two: the last symbol's pair
    before[first] = BEGIN
    three = C.mix(before * C.MIX2 + w + BEGIN)
    keys = np.stack([C.mix(w), two, three])
    keys >>= np.uint64(64 - KEY_BITS)
    keys &= ~np.uint64(1)
    keys[0] |= np.uint64(1)
    return keys.view(np.int64), first


def units(batches, size: int):
    """Number, whether held out, and rows: whole documents in their order, cut where ``size`` bytes are reached, whatever the batches."""
    task = TaskContext.get().partitionId() if TaskContext.get() else 0
    rows, filled, number = {0: [], 1: []}, [0, 0], [0, 0]
    for b, kind in itertools.product(batches, (0, 1)):
        own = b.filter(pa.array(np.asarray(C.column(b, "held").to_numpy(zero_copy_only=False), bool) == bool(kind)))
        if not own.num_rows:
            continue
        end = np.cumsum(np.diff(C.text_bytes(C.column(own, "text"))[1]))
        at = 0
        while at < own.num_rows:
            base = end[at - 1] if at else 0
            to = min(int(np.searchsorted(end, base + size - filled[kind])) + 1, own.num_rows)
            rows[kind].append(own.slice(at, to - at))
            filled[kind] += int(end[to - 1] - base)
            at = to
            if filled[kind] >= size:
                yield task << 32 | number[kind] << 1 | kind, kind, rows[kind]
                rows[kind], filled[kind], number[kind] = [], 0, number[kind] + 1
    for kind in (0, 1):
        if rows[kind]:
            yield task << 32 | number[kind] << 1 | kind, kind, rows[kind]


def _send(parts, size):
    """A unit's distinct keys and their counts, by part of the key space; also where it has none."""
    edges = np.array([(k << KEY_BITS) // parts for k in range(parts + 1)], np.int64)

    def send(batches):
        for unit, _, rows in units(batches, size):
            keys = keys_of(*sequence(rows))[0].ravel()
            keys.sort()
            new = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
            n, keys = np.diff(np.append(new, len(keys))), keys[new]
            cut = np.searchsorted(keys, edges)
            out = [(pack(np.diff(keys[a:z], prepend=edges[p])), pack(n[a:z]), z - a) for p, (a, z) in enumerate(itertools.pairwise(cut))]
            yield pa.record_batch([pa.array(range(parts), pa.int32()), pa.array([unit] * parts, pa.int64()), pa.array([r[2] for r in out], pa.int64()), pa.array([r[0] for r in out], pa.binary()), pa.array([r[1] for r in out], pa.binary())], ["part", "unit", "size", "keys", "n"])

    return send


def _by(name, batches):
    """Runs of rows of equal ``name``, from rows sorted by it."""
    rows = (r for b in batches for r in zip(*(x.to_pylist() for x in b.columns)))
    at = 0 if name == "part" else 1
    return itertools.groupby(rows, key=lambda r: r[at])


def _add(parts):
    """For each unit's keys of a part, the counts in all documents and, to held-out units, those in the others; the part's words and symbols."""

    def add(batches):
        for part, rows in _by("part", batches):
            rows = list(rows)
            low, size = (part << KEY_BITS) // parts, np.array([r[2] for r in rows])
            keys = np.concatenate([low + np.cumsum(unpack(r[3], r[2])) for r in rows])
            n = np.concatenate([unpack(r[4], r[2]) for r in rows])
            held = np.repeat(np.array([r[1] & 1 for r in rows]), size)
            order = np.argsort(keys, kind="stable")
            key = keys[order]
            new = np.concatenate([[True], key[1:] != key[:-1]]) if len(key) else np.zeros(0, bool)
            group = np.empty(len(key), np.int64)
            group[order] = np.cumsum(new) - 1
            total, train = (np.bincount(group, x, new.sum()).astype(np.int64) for x in (n, n * (1 - held)))
            word = (key[new] & 1).astype(bool)
            sums = int(word.sum()), int(train[word].sum()), int(total[word].sum())
            cut = np.concatenate([[0], np.cumsum(size)])
            for r, a, z in zip(rows, cut, cut[1:]):
                own = group[a:z]
                counts = np.concatenate([total[own], train[own]]) if r[1] & 1 else total[own]
                yield pa.record_batch([pa.array([x], t) for x, t in zip((part, r[1], r[2], pack(counts), *sums), (pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()))], ["part", "unit", "size", "counts", "words", "train", "total"])

    return add


def _keep(path):
    """One file for each unit: its counts in the order of its keys."""

    def keep(batches):
        for unit, rows in _by("unit", batches):
            kinds, found, sums = 1 + (unit & 1), [], np.zeros(3, np.int64)
            for r in rows:
                found.append(unpack(r[3], kinds * r[2]).reshape(kinds, -1))
                sums += r[4:]
            counts = np.concatenate(found, 1)
            C.save(path, f"unit-{unit}", np.frombuffer(np.int64(counts.shape[1]).tobytes() + pack(counts.ravel()), np.uint8))
            yield pa.record_batch([pa.array([int(x)], pa.int64()) for x in sums], ["words", "train", "total"])

    return keep


@dataclass
class Counts:
    path: str
    size: int
    words: int
    train: int
    total: int


def prepared(docs: DataFrame) -> DataFrame:
    return C.texts(docs, (F.pmod(F.xxhash64("doc_id"), F.lit(HELD)) == 0).alias("held"))


def count(docs: DataFrame, size: int = UNIT) -> Counts:
    """Counts of all n-grams, as every unit's file in the shared folder, the number of words and of the symbols of the training and of all documents."""
    spark, path = docs.sparkSession, C.fresh_path(docs.sparkSession, "ngrams")
    text_bytes = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), text_bytes // PART + 1)
    sent = prepared(docs).mapInArrow(C.tidy(_send(parts, size)), "part int, unit long, size long, keys binary, n binary")
    added = sent.repartition(parts, "part").sortWithinPartitions("part").mapInArrow(C.tidy(_add(parts)), "part int, unit long, size long, counts binary, words long, train long, total long")
    back = added.repartition(parts, "unit").sortWithinPartitions("unit", "part").mapInArrow(C.tidy(_keep(path)), "words long, train long, total long")
    sums = back.agg(*[F.coalesce(F.max(c), F.lit(0)) for c in ("words", "train", "total")]).first()
    return Counts(path, size, *sums)


def estimates(rows: list[pa.RecordBatch], unit: int, counts: Counts, train: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Every symbol's estimates, of order three first and the uniform one last, its context's count, and the texts' numbers of symbols."""
    w, size = sequence(rows)
    if not len(w):
        return np.zeros((0, ORDER + 1)), np.zeros(0, np.int64), size
    keys, first = keys_of(w, size)
    # each symbol's place among the unit's keys by one sort, as a search for each takes three times as long
    order = np.argsort(keys.ravel())
    key = keys.ravel()[order]
    rank = np.zeros(len(key), np.int32)
    np.cumsum(key[1:] != key[:-1], out=rank[1:])
    del key, keys
    file = np.asarray(C.load(counts.path, f"unit-{unit}", np.uint8))
    n = int(file[:8].view(np.int64)[0])
    if n != rank[-1] + 1:
        raise ValueError("the documents came in another order than when they were counted")
    found = np.empty(len(order), np.int64)
    found[order] = unpack(file[8:].tobytes(), n * (1 + (unit & 1)))[n * train :][rank]
    one, two, three = found.reshape(ORDER, -1)
    del order, rank
    texts = one[np.flatnonzero(w == END)[0]]  # as often as a text ends, one begins
    before_two, before_three = (np.where(first, texts, np.concatenate([[0], x[:-1]])) for x in (one, two))
    p = np.stack([three / np.maximum(before_three, 1), two / np.maximum(before_two, 1), one / max(counts.train if train else counts.total, 1), np.full(len(w), 1 / counts.words)], 1)
    return p, before_three, size


def buckets(n: np.ndarray) -> np.ndarray:
    """0 for contexts that didn't occur, then one for each doubling of the count."""
    return np.minimum(np.where(n > 0, np.floor(np.log2(np.maximum(n, 1))) + 1, 0), BUCKETS - 1).astype(np.int64)


NAMES = [f"p{k}" for k in range(ORDER + 1)]


def alike(bucket: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Edges of the buckets, the estimates in their order, equal rows once, and how often each row occurs."""
    h = np.zeros(len(p), np.uint64)
    for k in range(p.shape[1]):
        h = C.mix(h * C.MIX1 + np.ascontiguousarray(p[:, k]).view(np.uint64))
    order = np.argsort((bucket.astype(np.uint64) << np.uint64(56)) | (h >> np.uint64(8)))
    p, bucket = p[order], bucket[order]
    new = np.flatnonzero(np.concatenate([[True], (bucket[1:] != bucket[:-1]) | (p[1:] != p[:-1]).any(1)])) if len(p) else np.zeros(0, np.int64)
    return np.searchsorted(bucket[new], np.arange(BUCKETS + 1)), p[new], np.diff(np.append(new, len(p))).astype(float)


def held_files(docs: DataFrame, counts: Counts) -> DataFrame:
    """unit: those with documents held out, whose symbols' estimates from the other documents now lie in a file each."""

    def run(batches):
        for unit, _, rows in units(batches, counts.size):
            p, context, _ = estimates(rows, unit, counts, True)
            edges, p, n = alike(buckets(context), p)
            C.save(counts.path, f"held-{unit}", np.concatenate([edges.astype(float), n, p.ravel()]))
            yield pa.record_batch([pa.array([unit], pa.int64())], ["unit"])

    return C.written(prepared(docs).where("held").mapInArrow(C.tidy(run), "unit long"), "held-out")


def load_held(counts: Counts, unit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    file = C.load(counts.path, f"held-{unit}", float)
    edges = file[: BUCKETS + 1].astype(np.int64)
    n = edges[-1]
    return edges, file[BUCKETS + 1 :][n:].reshape(n, ORDER + 1), file[BUCKETS + 1 :][:n]


def held_out(docs: DataFrame, counts: Counts) -> DataFrame:
    """Bucket and estimates, from the other documents, of every symbol held out."""

    def run(batches):
        for unit in itertools.chain.from_iterable(C.column(b, "unit").to_pylist() for b in batches):
            edges, p, n = load_held(counts, unit)
            bucket, n = np.repeat(np.arange(BUCKETS, dtype=np.int32), np.diff(edges)), n.astype(np.int64)
            yield pa.record_batch([pa.array(np.repeat(bucket, n))] + [pa.array(np.repeat(p[:, k], n)) for k in range(ORDER + 1)], ["bucket", *NAMES])

    return held_files(docs, counts).mapInArrow(C.tidy(run), "bucket int, " + ", ".join(f"{x} double" for x in NAMES))


def mass(edges: np.ndarray, p: np.ndarray, n: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The shares of each estimate in the symbols' probabilities, summed by bucket."""
    total = np.zeros((BUCKETS, p.shape[1]))
    for b in np.flatnonzero(np.diff(edges)):
        own = p[edges[b] : edges[b + 1]]
        total[b] = weights[b] * (n[edges[b] : edges[b + 1]] / (own @ weights[b]) @ own)
    return total


def learn_weights(held: DataFrame, counts: Counts, rounds: int = ROUNDS) -> np.ndarray:
    """Mixture weights by bucket that make the held-out symbols likeliest, by expectation-maximisation over the units' files."""
    weights, seen = np.full((BUCKETS, ORDER + 1), 1 / (ORDER + 1)), np.zeros(BUCKETS, bool)
    held = held.repartition(int(held.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def step(weights):
        def run(batches):
            total = np.zeros((BUCKETS, ORDER + 1))
            for unit in itertools.chain.from_iterable(C.column(b, "unit").to_pylist() for b in batches):
                total += mass(*load_held(counts, unit), weights)
            some = np.flatnonzero(total.sum(1))
            yield pa.record_batch([pa.array(some.astype(np.int32))] + [pa.array(total[some, k]) for k in range(ORDER + 1)], ["bucket", *NAMES])

        return run

    for _ in range(rounds):
        total = np.zeros((BUCKETS, ORDER + 1))
        for row in held.mapInArrow(step(weights), "bucket int, " + ", ".join(f"{x} double" for x in NAMES)).groupBy("bucket").agg(*[F.sum(x).alias(x) for x in NAMES]).collect():
            total[row.bucket] += row[1:]
        seen = total.sum(1) > 0
        weights[seen] = total[seen] / total[seen].sum(1, keepdims=True)
        weights = np.maximum(weights, 1e-6)
        weights /= weights.sum(1, keepdims=True)
    for b in np.flatnonzero(~seen) if seen.any() else ():  # a bucket without held-out symbols takes the nearest one's weights
        weights[b] = weights[np.flatnonzero(seen)[np.abs(np.flatnonzero(seen) - b).argmin()]]
    return weights


@dataclass
class Model:
    counts: Counts
    weights: np.ndarray


def fit(docs: DataFrame, size: int = UNIT) -> Model:
    counts = count(docs, size)
    return Model(counts, learn_weights(held_files(docs, counts), counts))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_symbols, log_prob (natural) and perplexity (by symbol) of every document that the model was fitted to."""
    counts, weights = model.counts, model.weights

    def run(batches):
        for unit, _, rows in units(batches, counts.size):
            p, context, size = estimates(rows, unit, counts, False)
            log = np.concatenate([np.zeros(0), *(np.log((weights[buckets(context[k : k + (1 << 16)])] * p[k : k + (1 << 16)]).sum(1)) for k in range(0, len(p), 1 << 16))])
            del p, context
            some, total = size > 0, np.zeros(len(size))
            if some.any():
                total[some] = np.add.reduceat(log, (np.cumsum(size) - size)[some])
            total = np.round(total, 6)
            whole = pa.Table.from_batches(rows)
            null = ~np.asarray(whole.column("text").is_valid())
            yield pa.record_batch([whole.column("doc_id").combine_chunks(), pa.array(size.astype(np.int32), mask=null), pa.array(total, mask=null), pa.array(np.exp(-total / np.maximum(size, 1)), mask=null | ~some)], ["doc_id", "n_symbols", "log_prob", "perplexity"])

    return prepared(docs).mapInArrow(C.tidy(run), SCHEMA)


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.read(spark, sf_dir, "documents")
    return score(docs, fit(docs))
