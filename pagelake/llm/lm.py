"""Language-model scores by deleted interpolation of n-grams.

The symbols are the text's bytes in 64 classes (letters folded, digits one class, bytes of multi-byte
characters by their low bits), so that all counts of order four fit one array of 2**24, whatever the
corpus. Counts of all documents are gathered: every partition sends the counts of the n-grams it saw. One
document in HELD, by a hash of doc_id, is held out: maximum-likelihood estimates of orders four to one
and a uniform one, from the others, are mixed with weights that expectation-maximisation learns on the
held-out counts, a set of weights for each bucket of the context's frequency (by powers of two). With
these weights, estimates from all documents give the final table of log-probabilities, which workers
map into memory from the shared folder.

Defined results: a null text has null scores; an empty one has no symbols, log-probability 0 and a null
perplexity; contexts that never occurred use the shorter ones that did, the uniform estimate at last; rows
of a null doc_id count and are scored; repeated rows count each time; extra columns are ignored; an
empty table gives an empty one.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

ORDER, SYMBOLS, HELD, BUCKETS, ROUNDS = 4, 64, 10, 48, 40
CELLS, SLOT_BITS = SYMBOLS**ORDER, 18
SCHEMA = "doc_id long, n_symbols int, log_prob double, perplexity double"


def _classes() -> np.ndarray:
    """0 stands before a text's first symbol."""
    c = np.zeros(256, np.uint32)
    c[:32] = c[127] = 63
    c[33:127] = 42 + np.arange(94) % 6
    c[65:91] = c[97:123] = 1 + np.arange(26)
    c[48:58], c[32], c[10] = 27, 28, 29
    c[[9, 11, 12, 13]] = 30
    c[[ord(x) for x in ".,;:'\"!?-()"]] = 31 + np.arange(11)
    c[128:192] = 48 + np.arange(64) % 8
    c[192:196], c[195], c[196:208], c[208:224], c[224:227], c[227:240], c[240:] = 56, 57, 58, 59, 60, 61, 62
    return c


CLASSES = _classes()


def codes(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """For every byte, its class and the three before it in its text, six bits each."""
    c = CLASSES[data]
    out = c.copy()
    for k in range(1, ORDER):
        out[k:] |= c[:-k] << np.uint32(6 * k) if len(c) > k else np.uint32(0)
    for k in range(ORDER - 1):  # a text's first symbols have shorter contexts
        at = off[:-1] + k
        at = at[at < off[1:]]
        out[at] &= np.uint32((1 << 6 * (k + 1)) - 1)
    return out


def _counts(batches):
    total = np.zeros((2, CELLS), np.uint32)
    for b in C.sub_batches(batches):
        data, off = C.text_bytes(C.column(b, "text"))
        held = np.repeat(np.asarray(C.column(b, "held").to_numpy(zero_copy_only=False), bool), np.diff(off))
        code = codes(data, off)
        for kind, which in enumerate((~held, held)):
            seen, n = np.unique(code[which], return_counts=True)
            total[kind, seen] += n.astype(np.uint32)
    yield from _sparse(total.reshape(2, -1, 1 << SLOT_BITS))


def _sparse(total, slots=None):
    rows = []
    for kind in range(2):
        for slot in range(total.shape[1]):
            seen = np.flatnonzero(total[kind, slot])
            if len(seen):
                rows.append((kind, slots[slot] if slots else slot, seen.astype(np.uint32).tobytes(), total[kind, slot, seen].astype(np.int64).tobytes()))
    yield pa.record_batch([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int32(), pa.int32(), pa.binary(), pa.binary()))], ["kind", "slot", "seen", "n"])


def _merge(batches):
    total: dict[int, np.ndarray] = {}
    for b in batches:
        for kind, slot, seen, n in zip(*(x.to_pylist() for x in b.columns)):
            at = total.setdefault(slot, np.zeros((2, 1 << SLOT_BITS), np.int64))
            at[kind, np.frombuffer(seen, np.uint32)] += np.frombuffer(n, np.int64)
    for slot, counts in total.items():
        yield from _sparse(counts[:, None, :], [slot])


def count(docs: DataFrame) -> np.ndarray:
    """Counts of all n-grams of order four, of the training and of the held-out documents: two rows of 2**24."""
    schema = "kind int, slot int, seen binary, n binary"
    texts = C.texts(docs.where("text is not null")).select("text", (F.pmod(F.xxhash64("doc_id"), F.lit(HELD)) == 0).alias("held"))
    spread = min(CELLS >> SLOT_BITS, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    total = np.zeros((2, CELLS >> SLOT_BITS, 1 << SLOT_BITS), np.int64)
    for row in texts.mapInArrow(C.tidy(_counts), schema).repartition(spread, "slot").mapInArrow(C.tidy(_merge), schema).toLocalIterator():
        total[row.kind, row.slot, np.frombuffer(row.seen, np.uint32)] = np.frombuffer(row.n, np.int64)
    return total.reshape(2, CELLS)


class Estimates:
    """Maximum-likelihood estimates of each order, from counts of order four."""

    def __init__(self, counts: np.ndarray):
        table = counts.reshape(-1, SYMBOLS)
        self.tables = [table]  # by order, from four down to one: context x symbol
        while len(self.tables[-1]) > 1:
            self.tables.append(self.tables[-1].reshape(SYMBOLS, -1, SYMBOLS).sum(0))
        self.contexts = [t.sum(1) for t in self.tables]

    def buckets(self, context: np.ndarray) -> np.ndarray:
        """0 for contexts that didn't occur, then one for each doubling of the count."""
        n = self.contexts[0][context]
        return np.minimum(np.where(n > 0, np.floor(np.log2(np.maximum(n, 1))) + 1, 0), BUCKETS - 1).astype(np.int64)

    def of(self, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each n-gram's estimates (the uniform one last) and whether its contexts occurred."""
        p, there = np.zeros((len(code), ORDER + 1)), np.ones((len(code), ORDER + 1), bool)
        symbol, context = code % SYMBOLS, code // SYMBOLS
        for k, (table, n) in enumerate(zip(self.tables, self.contexts)):
            own = context % len(table)
            there[:, k] = n[own] > 0
            p[:, k] = table[own, symbol] / np.maximum(n[own], 1)
        p[:, -1] = 1 / SYMBOLS
        return p, there


def learn_weights(train: Estimates, held: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Mixture weights by bucket that make the held-out counts likeliest, by expectation-maximisation."""
    weights = np.full((BUCKETS, ORDER + 1), 1 / (ORDER + 1))
    code = np.flatnonzero(held)
    if not len(code):
        return weights
    n = held[code].astype(float)
    p, _ = train.of(code)
    bucket = train.buckets(code // SYMBOLS)
    for _ in range(rounds):
        share = weights[bucket] * p
        share *= (n / share.sum(1))[:, None]
        mass = np.stack([np.bincount(bucket, share[:, k], BUCKETS) for k in range(ORDER + 1)], 1)
        seen = mass.sum(1) > 0
        weights[seen] = mass[seen] / mass[seen].sum(1, keepdims=True)
        weights = np.maximum(weights, 1e-6)
        weights /= weights.sum(1, keepdims=True)
    for b in range(BUCKETS):  # a bucket without held-out counts takes the nearest one's weights
        if not seen[b]:
            weights[b] = weights[np.flatnonzero(seen)[np.abs(np.flatnonzero(seen) - b).argmin()]]
    return weights


def log_probabilities(estimates: Estimates, weights: np.ndarray, step: int = 1 << SLOT_BITS) -> np.ndarray:
    """The log-probability of every symbol after every context of three; each context's sum to one."""
    out = np.empty(CELLS, np.float32)
    for at in range(0, CELLS, step):
        code = np.arange(at, at + step)
        p, there = estimates.of(code)
        w = weights[estimates.buckets(code // SYMBOLS)] * there
        out[at : at + step] = np.log((w * p).sum(1) / w.sum(1))
    return out


@dataclass
class Model:
    path: str
    weights: np.ndarray


def fit(docs: DataFrame) -> Model:
    counts = count(docs)
    weights = learn_weights(Estimates(counts[0]), counts[1])
    path = C.fresh_path(docs.sparkSession, "lm")
    C.save(path, "log-probabilities", log_probabilities(Estimates(counts.sum(0)), weights))
    return Model(path, weights)


def scores(data: np.ndarray, off: np.ndarray, table: np.ndarray) -> np.ndarray:
    """The log-probability of each text."""
    out = np.zeros(len(off) - 1)
    some = np.flatnonzero(np.diff(off))
    if len(some):
        out[some] = np.add.reduceat(table[codes(data, off)].astype(np.float64), off[some])
    return out


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_symbols, log_prob (natural) and perplexity (by symbol) of every document."""
    path = model.path

    def run(batches):
        table = C.load(path, "log-probabilities", np.float32)
        for b in C.sub_batches(batches):
            text = C.column(b, "text")
            data, off = C.text_bytes(text)
            null, n = ~np.asarray(text.is_valid()), np.diff(off)
            total = np.round(scores(data, off, table), 6)
            perplexity = np.exp(-total / np.maximum(n, 1))
            yield pa.record_batch([C.column(b, "doc_id"), pa.array(n.astype(np.int32), mask=null), pa.array(total, mask=null), pa.array(perplexity, mask=null | (n == 0))], ["doc_id", "n_symbols", "log_prob", "perplexity"])

    return C.texts(docs).mapInArrow(C.tidy(run), SCHEMA)
