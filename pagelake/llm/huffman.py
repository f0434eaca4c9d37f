"""Token ids as bits: canonical, length-limited Huffman codes from the ids' counts over all rows.

Counts are summed by partition and then by id; lengths of at most MAX_BITS come from the
package-merge method; codes are canonical (by length, then id), so that lengths alone describe them.
Each row's ids become one bit string, and the bit offset of every block of BLOCK ids is kept: blocks
decode independently, here all side by side, one table look-up an id.

Defined results: null ids have null bits, checkpoints and exact; no ids have an empty bit string and no checkpoint; a table
with one distinct id uses codes of one bit; repeated rows are coded alike; extra columns are ignored;
an empty table gives an empty one; doc_id is a whole number (or a string of one); very long texts are read whole, as one row of work arrays of about 30 bytes a byte of text; checkpoints are of 32 bits,
so a row holds at most 2**31 bits; ids of equal count get shorter codes by the greater id first. An id that the counts lack can't be coded: ValueError.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe
from . import common as C

MAX_BITS, BLOCK = 20, 256
SCHEMA = "doc_id long, n_tokens int, n_bits long, bits binary, checkpoints array<int>, exact boolean"


def lengths(counts: np.ndarray, most: int = MAX_BITS) -> np.ndarray:
    """The optimal code lengths of at most ``most`` bits; 0 where the count is."""
    used = np.flatnonzero(counts)
    n = len(used)
    out = np.zeros(len(counts), np.uint8)
    if n <= 1:
        out[used] = 1
        return out
    if n > 1 << most:
        raise ValueError(f"{n} ids can't have codes of at most {most} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    weight = counts[order].astype(np.float64)
    leaf, row = [], weight
    for _ in range(most - 1):
        leaf.append(None)
        pairs = row[: len(row) // 2 * 2].reshape(-1, 2).sum(1)
        both = np.concatenate([weight, pairs])
        rank = np.argsort(both, kind="stable")
        row, leaf[-1] = both[rank], rank < n
    take = 2 * n - 2
    bits = np.zeros(n, np.int64)
    for is_leaf in reversed(leaf):
        leaves = int(is_leaf[:take].sum())
        bits[:leaves] += 1
        take = 2 * (take - leaves)
    bits[:take] += 1
    out[order] = bits
    return out


class Code:
    """Canonical codes of the lengths, and the decoding table: what the next MAX_BITS bits begin with."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits.astype(np.int64)
        self.size = max(1, int(self.bits.max(initial=1)))
        order = np.flatnonzero(self.bits)
        order = order[np.argsort(self.bits[order], kind="stable")]
        span = np.int64(1) << (self.size - self.bits[order])
        start = np.cumsum(span) - span
        self.codes = np.zeros(len(bits), np.uint64)
        self.codes[order] = (start >> (self.size - self.bits[order])).astype(np.uint64)
        self.symbol = np.zeros(1 << self.size, np.int32)
        self.symbol[: int(span.sum())] = np.repeat(order, span)

    def encode(self, ids: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bytes of all rows' bit strings, each row's number of bits, and the bit offset of every id in its row."""
        size = self.bits[ids]
        if len(ids) and not size.all():
            raise ValueError("an id has no code")
        edge = np.concatenate([[0], np.cumsum(n)])
        ends = np.concatenate([[0], np.cumsum(size)])
        total = np.diff(ends[edge])
        first = np.concatenate([[0], np.cumsum(-(-total // 8))])
        inside = ends[:-1] - np.repeat(ends[edge[:-1]], n)
        at = inside + np.repeat(first[:-1] * 8, n)
        words = np.zeros(int(first[-1]) // 4 + 3, np.uint64)
        if len(ids):
            shifted = self.codes[ids] << (64 - size - (at & 31)).astype(np.uint64)
            word = at >> 5
            new = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            words[word[new]] |= np.bitwise_or.reduceat(shifted >> np.uint64(32), new)
            words[word[new] + 1] |= np.bitwise_or.reduceat(shifted & np.uint64(0xFFFFFFFF), new)
        return words.astype(">u4").view(np.uint8)[: int(first[-1])], total, inside

    def decode(self, data: np.ndarray, start: np.ndarray, n: np.ndarray) -> np.ndarray:
        """The ids of blocks of n ids that start at the given bits, in the blocks' order."""
        out = np.zeros(int(n.sum()), np.int32)
        if not len(out):
            return out
        wide = np.zeros(len(data) + 8, np.uint32)
        wide[: len(data)] = data
        peek = (wide[:-4] << np.uint32(24)) | (wide[1:-3] << np.uint32(16)) | (wide[2:-2] << np.uint32(8)) | wide[3:-1]
        order = np.argsort(-n, kind="stable")
        at, left, place = start[order], n[order], (np.cumsum(n) - n)[order]
        live, mask = len(order), (1 << self.size) - 1
        for k in range(int(left[0])):
            live = int(np.searchsorted(-left[:live], -k, "left"))
            here = at[:live]
            found = self.symbol[(peek[here >> 3].astype(np.int64) >> (32 - self.size - (here & 7))) & mask]
            out[place[:live] + k] = found
            at[:live] = here + self.bits[found]
        return out


def blocks(n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Blocks in each row, every block's first id, and its number of ids."""
    per = -(-n // BLOCK)
    edge = np.cumsum(n) - n
    k = C.ragged(np.zeros(len(n), np.int64), per)
    first = np.repeat(edge, per) + k * BLOCK
    return per, first, np.minimum(BLOCK, np.repeat(n, per) - k * BLOCK)


def _ids(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    data, off = C.text_bytes(C.column(batch, "packed"))
    return np.frombuffer(data.tobytes(), np.uint16).astype(np.int64), np.diff(off) // 2


def _counts(size: int):
    def count(batches):
        total = np.zeros(size, np.int64)
        for b in C.sub_batches(batches, "packed"):
            total += np.bincount(_ids(b)[0], minlength=size)
        used = np.flatnonzero(total)
        yield pa.record_batch([pa.array(used.astype(np.int32)), pa.array(total[used])], ["id", "n"])

    return count


def pack(docs: DataFrame, path: str = bpe.VOCABULARY) -> DataFrame:
    """doc_id and the text's byte-level BPE ids, packed as two bytes each."""

    def run(batches):
        vocab = bpe.vocabulary(path)
        if len(vocab.length) > 1 << 16:
            raise ValueError("two bytes hold no id beyond 65,535")
        for b in C.sub_batches(batches):
            text = C.column(b, "text")
            data, off = C.text_bytes(text)
            ids, start, count = vocab.encode(data, off)
            n = np.diff(np.concatenate([[0], np.cumsum(count)])[np.searchsorted(start, off)])
            yield pa.record_batch([C.column(b, "doc_id"), C.binary_array(ids.astype(np.uint16).view(np.uint8), 2 * n, np.asarray(text.is_valid()))], ["doc_id", "packed"])

    return C.texts(docs).mapInArrow(C.tidy(run), "doc_id long, packed binary")


def fit(packed: DataFrame, size: int = 1 << 16, most: int = MAX_BITS) -> Code:
    """The code of the ids' counts over all rows; at most ``size`` counts reach the driver."""
    counts = np.zeros(size, np.int64)
    for row in packed.select("packed").mapInArrow(_counts(size), "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():
        counts[row.id] = row.n
    return Code(lengths(counts, most))


def encode(packed: DataFrame, code: Code) -> DataFrame:
    """Every row's bits, checkpoints and exact: whether the blocks, decoded from their checkpoints, give the ids back."""
    lengths_of = code.bits.astype(np.uint8)

    def run(batches):
        own = Code(lengths_of)
        for b in C.sub_batches(batches, "packed"):
            ids, n = _ids(b)
            valid = np.asarray(C.column(b, "packed").is_valid())
            data, total, inside = own.encode(ids, n)
            per, first, size = blocks(n)
            size_bytes = -(-total // 8)
            start = inside[first] + np.repeat(8 * (np.cumsum(size_bytes) - size_bytes), per)
            wrong = np.flatnonzero(own.decode(data, start, size) != ids)
            exact = np.ones(len(n), bool)
            exact[np.searchsorted(np.cumsum(n), wrong, "right")] = False
            columns = [C.column(b, "doc_id"), pa.array(n.astype(np.int32), mask=~valid), pa.array(total, mask=~valid), C.binary_array(data, size_bytes, valid), C.list_array(inside[first].astype(np.int32), per, pa.int32(), valid), pa.array(exact, mask=~valid)]
            yield pa.record_batch(columns, ["doc_id", "n_tokens", "n_bits", "bits", "checkpoints", "exact"])

    return packed.select("doc_id", "packed").mapInArrow(C.tidy(run), SCHEMA)


def decode(coded: DataFrame, code: Code) -> DataFrame:
    """doc_id and ids of coded rows, from their checkpoints."""
    lengths_of = code.bits.astype(np.uint8)

    def run(batches):
        own = Code(lengths_of)
        for b in batches:
            ids = []
            for n, bits, marks in zip(*(C.column(b, c).to_pylist() for c in ("n_tokens", "bits", "checkpoints"))):
                ids.append(None if bits is None else own.decode(np.frombuffer(bits, np.uint8), np.array(marks, np.int64), np.minimum(BLOCK, n - BLOCK * np.arange(len(marks)))))
            yield pa.record_batch([C.column(b, "doc_id"), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return coded.select("doc_id", "n_tokens", "bits", "checkpoints").mapInArrow(C.tidy(run), "doc_id long, ids array<int>")


def code_rows(spark: SparkSession, code: Code) -> DataFrame:
    """id and its code's length, of the ids that have one: as codes are canonical, all that decoding needs."""
    used = np.flatnonzero(code.bits)
    return spark.createDataFrame([(int(k), int(code.bits[k])) for k in used], "id int, length int")


def code_of(rows: DataFrame, size: int = 1 << 16) -> Code:
    bits = np.zeros(size, np.uint8)
    for r in rows.collect():
        bits[r.id] = r.length
    return Code(bits)


def write(docs: DataFrame, folder: str) -> None:
    """The documents' coded rows as Parquet in folder/rows, and the code in folder/code."""
    packed = C.checkpoint(pack(docs))
    code = fit(packed)
    code_rows(docs.sparkSession, code).coalesce(1).write.parquet(f"{folder}/code")
    encode(packed, code).write.parquet(f"{folder}/rows")


def read(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id and ids of what ``write`` wrote."""
    return decode(spark.read.parquet(f"{folder}/rows"), code_of(spark.read.parquet(f"{folder}/code")))


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's coded row, with ``code``: the table of the code's lengths in the shared folder, for ``code_of``."""
    packed = C.checkpoint(pack(C.read(spark, sf_dir, "documents")))
    code = fit(packed)
    path = f"{C.shared_folder(spark).rstrip('/')}/huffman-{hashlib.sha256(code.bits.tobytes()).hexdigest()[:16]}"
    code_rows(spark, code).coalesce(1).write.mode("overwrite").parquet(path)
    return encode(packed, code).withColumn("code", F.lit(path))
