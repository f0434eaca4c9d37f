"""Shared helpers: shared-folder checkpoints, Arrow text buffers and vectorised hashing.

Text is worked on as the contiguous byte buffer of an Arrow batch, cut into sub-batches of about
``SUB_BYTES`` so that the 8-byte-per-byte work arrays stay small whatever the documents' lengths.
"""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SUB_BYTES = 1 << 19
MIX1, MIX2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
#: A random 64-bit value for each byte value: what the polynomial hashes add up.
BYTE_VALUES = np.random.Generator(np.random.PCG64(20240229)).integers(1, 1 << 63, 256, dtype=np.uint64)
ASCII_SPACE = np.zeros(256, dtype=bool)
ASCII_SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers: dict[int, np.ndarray] = {}
_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of a registered query. Such queries run with 1,000 rows an Arrow batch where the session has Spark's default of 10,000, as rows of text are large; operators by themselves leave the session as it is."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint(df: DataFrame) -> DataFrame:
    """Eagerly written to the shared checkpoint folder, lineage cut."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, spark.checkpoint.dir. One of our own is made only where none is named and Spark runs on one machine; on a cluster that is an error."""
    context = spark.sparkContext
    named = context.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not named:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="pagelake-"))
    return named or context.getCheckpointDir()


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows, written as Parquet in the shared folder and read again."""
    path = fresh_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.parquet(path)


def texts(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id (a whole number, or a string of one, as long), text and more columns, on their way to Python."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *more)


def unused(df: DataFrame, name: str) -> str:
    """A name for a column of our own that no column of ``df`` has, whatever the case of its letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def release() -> None:
    """Gives freed memory back to the system, as a Python worker lives on between tasks."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def tidy(run: Callable) -> Callable:
    """The function over a partition's batches, with its memory given back at the end."""

    def tidied(batches):
        try:
            yield from run(batches)
        finally:
            release()

    return tidied


def plan_bytes(df: DataFrame) -> int:
    """The optimizer's size estimate: for a plain scan, the bytes of its files."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def parts_for(df: DataFrame, rows_bytes: float, each: int = 16 << 20) -> int:
    """Partitions so that each gets about ``each`` bytes, if the operator makes ``rows_bytes`` per input byte."""
    size = min(plan_bytes(df), 1 << 60)
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), int(size * rows_bytes / each) + 1)


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def sub_batches(batches: Iterator[pa.RecordBatch], text: str = "text", budget: int = SUB_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches that hold about ``budget`` bytes of text, one row at least."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        off = offsets_of(column(batch, text))
        start = 0
        while start < n:
            end = max(start + 1, int(np.searchsorted(off, off[start] + budget, "right")) - 1)
            yield batch.slice(start, min(end, n) - start)
            start = end


def offsets_of(arr: pa.Array) -> np.ndarray:
    wide = pa.types.is_large_string(arr.type) or pa.types.is_large_binary(arr.type)
    return np.frombuffer(arr.buffers()[1], np.int64 if wide else np.int32)[arr.offset : arr.offset + len(arr) + 1]


def text_bytes(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of an Arrow string array and the rows' offsets in them; a null has none."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    if not len(arr):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = offsets_of(arr).astype(np.int64)
    buf = arr.buffers()[2]
    data = np.frombuffer(buf, np.uint8)[off[0] : off[-1]] if buf is not None else np.zeros(0, np.uint8)
    if arr.null_count:
        valid = np.asarray(arr.is_valid())
        if np.any(np.diff(off)[~valid]):
            keep = np.repeat(valid, np.diff(off))
            off = np.concatenate([[0], np.cumsum(np.where(valid, np.diff(off), 0))])
            return data[keep], off
    return data, off - off[0]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of BASE and of its inverse modulo 2**64, at least n of each."""
    if 0 not in _powers or len(_powers[0]) < n:
        size = max(n, SUB_BYTES + 1024)
        for k, b in ((0, BASE), (1, INVERSE)):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            _powers[k] = np.multiply.accumulate(p)
    return _powers[0][:n], _powers[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads every bit over the whole word."""
    h = h ^ (h >> np.uint64(33))
    h *= MIX1
    h ^= h >> np.uint64(33)
    h *= MIX2
    h ^= h >> np.uint64(33)
    return h


def prefix_hash(values: np.ndarray) -> np.ndarray:
    """P with P[j] - P[i] = sum of values[i:j] * BASE**position, modulo 2**64."""
    p = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(len(values))[0], out=p[1:])
    return p


def range_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the ranges; equal for equal content, wherever it lies."""
    return mix((prefix[end] - prefix[start]) * powers(len(prefix))[1][start] + (end - start).astype(np.uint64) * MIX2)


def runs(inside: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of True that don't cross a row's border."""
    if not len(inside):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    before = np.empty_like(inside)
    before[0], before[1:] = False, inside[:-1]
    after = np.empty_like(inside)
    after[-1], after[:-1] = False, inside[1:]
    borders = off[(off > 0) & (off < len(inside))]
    before[borders] = False
    after[borders - 1] = False
    return np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1


def words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words (runs of bytes that are no ASCII white space), and each row's first word."""
    start, end = runs(~ASCII_SPACE[data], off)
    return start, end, np.searchsorted(start, off)


def hash_ranges(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return range_hash(prefix_hash(BYTE_VALUES[data]), start, end)


def ragged(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """start[0] .. start[0]+length[0]-1, start[1] .. and so on, joined."""
    total = int(length.sum())
    if not total:
        return np.zeros(0, np.int64)
    first = np.cumsum(length) - length
    return np.arange(total, dtype=np.int64) + np.repeat(start - first, length)


def blocks(cost: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Neighbouring rows whose cost is at most the limit, one row at least."""
    edge, lo = np.concatenate([[0], np.cumsum(cost)]), 0
    while lo < len(cost):
        hi = max(lo + 1, int(np.searchsorted(edge, edge[lo] + limit, "right")) - 1)
        yield lo, hi
        lo = hi


def _validity(valid: np.ndarray | None) -> pa.Buffer | None:
    return None if valid is None or valid.all() else pa.py_buffer(np.packbits(valid, bitorder="little").tobytes())


def list_array(values: np.ndarray, lengths: np.ndarray, kind: pa.DataType, valid: np.ndarray | None = None) -> pa.Array:
    """A list of each length; null where not valid."""
    off = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=off[1:])
    return pa.Array.from_buffers(pa.list_(kind), len(lengths), [_validity(valid), pa.py_buffer(off)], children=[pa.array(values, kind)])


def binary_array(data: np.ndarray, lengths: np.ndarray, valid: np.ndarray | None = None) -> pa.Array:
    """A byte string of each length; null where not valid."""
    off = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=off[1:])
    return pa.Array.from_buffers(pa.binary(), len(lengths), [_validity(valid), pa.py_buffer(off), pa.py_buffer(np.ascontiguousarray(data))])


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _filesystem(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def save(path: str, name: str, array: np.ndarray) -> None:
    """An array's bytes as a file of a shared folder; a task that runs again replaces it by the same bytes."""
    system, folder = _filesystem(path)
    system.create_dir(folder)
    part = f"{folder}/{name}.{uuid.uuid4().hex}"
    with system.open_output_stream(part) as out:
        out.write(np.ascontiguousarray(array).view(np.uint8).data)
    system.move(part, f"{folder}/{name}")


def load(path: str, name: str, kind: type) -> np.ndarray:
    """The array that ``save`` wrote; mapped into memory where the folder is a mounted one."""
    system, folder = _filesystem(path)
    if isinstance(system, fs.LocalFileSystem):
        return np.memmap(f"{folder}/{name}", kind, "r")
    with system.open_input_file(f"{folder}/{name}") as file:
        return np.frombuffer(file.read(), kind)
