"""Substring dedup: repeated windows of WINDOW words, found behind a Count-min prefilter.

The text's words are its runs of bytes that are no ASCII white space. Every window of WINDOW words is
hashed. First pass: each partition sketches its windows in ROWS rows of cells (a saturating count in
each), sends the cells it touched, and the sketches are merged block by block into two-bit counts, of
which only "two or more" is kept: a bit a cell. As a count-min estimate never falls below the true count,
a window that occurs twice has its bit set in every row. Second pass: only windows whose bits are all
set are grouped, exactly, by their hashes. A window whose first occurrence, by doc_id and place, is
another is a repeat; the repeats of a document that overlap make one span.

The sketch's width follows the input's size up to MAX_WIDTH_BITS; beyond that more windows reach the second
pass, and still none is lost. The merged sketch lies in the shared folder, and workers map it into memory.

Defined results: null ids and null or empty texts have no spans, nor have texts of fewer words than a window; rows of
one doc_id and text count once; a document's own repeats count; of equal windows the first by doc_id and
place stays, and at equal doc_id and place (two texts under one doc_id) neither is later; extra columns pass through ``remove_repeats``, whatever
their names, and are ignored elsewhere; doc_id is a whole number (or a string of one); very long texts are read whole, as one row of work arrays of about 30 bytes a byte of text, up to 2 GB,
as offsets are of 32 bits; an empty table gives an empty result. "Equal" is by a hash of 64 bits: among n windows about n * n / 2**65 pairs
of different ones are taken for equal, one for a billion windows in 37 such corpora, thousands at 10**12 windows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common as C

WINDOW, ROWS, BLOCKS = 50, 2, 64
MIN_WIDTH_BITS, MAX_WIDTH_BITS = 20, 31
#: Windows that a task sketches before it sends the cells it touched.
FLUSH = 1 << 23
_ODD = [np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)]
_kept: dict = {}


def windows(data: np.ndarray, off: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, row, and first and last byte (exclusive) of every window of ``size`` words."""
    start, end, first = C.words(data, off)
    count = np.maximum(np.diff(first) - size + 1, 0)
    row = np.repeat(np.arange(len(count)), count)
    at = C.ragged(first[:-1], count)
    if not len(at):
        return np.zeros(0, np.uint64), row, at, at
    words = C.hash_ranges(data, start, end)
    return C.range_hash(C.prefix_hash(words), at, at + size), row, start[at], end[at + size - 1]


def cells(hashes: np.ndarray, row: int, bits: int) -> np.ndarray:
    return ((hashes * _ODD[row]) >> np.uint64(64 - bits)).astype(np.uint32)


def pack_gaps(values: np.ndarray) -> np.ndarray:
    """Rising values as one-byte gaps; a gap of 255 or more takes further bytes of 255 each."""
    gap = np.diff(values.astype(np.int64), prepend=0)
    more = gap // 255
    out = np.full(len(gap) + int(more.sum()), 255, np.uint8)
    out[np.cumsum(more + 1) - 1] = gap % 255
    return out


def unpack_gaps(packed: np.ndarray) -> np.ndarray:
    return np.cumsum(packed.astype(np.int64))[packed != 255]


def _sketch(size: int, bits: int):
    per = bits - int(np.log2(BLOCKS))

    def send(hashes):
        h = np.concatenate(hashes)
        for row in range(ROWS):
            touched = np.sort(cells(h, row, bits))
            new = np.flatnonzero(np.concatenate([[True], touched[1:] != touched[:-1]]))
            twice = np.diff(np.append(new, len(touched))) > 1
            touched = touched[new]
            edge = np.searchsorted(touched, np.arange(BLOCKS + 1, dtype=np.int64) << per)
            for block in range(BLOCKS):
                lo, hi = edge[block], edge[block + 1]
                if hi > lo:
                    yield block * ROWS + row, pack_gaps(touched[lo:hi] - np.uint32(block << per)).tobytes(), np.packbits(twice[lo:hi]).tobytes()

    def batch(rows):
        return pa.record_batch([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary())], ["part", "gaps", "twice"])

    def sketch(batches):
        hashes, n = [], 0
        for b in C.sub_batches(batches):
            hashes.append(windows(*C.text_bytes(C.column(b, "text")), size)[0])
            n += len(hashes[-1])
            if n > FLUSH:
                yield from (batch([r]) for r in send(hashes))
                hashes, n = [], 0
        if n:
            yield from (batch([r]) for r in send(hashes))

    return sketch


def _merge(path: str, bits: int):
    width = (1 << bits) // BLOCKS

    def merge(batches):
        counts: dict[int, np.ndarray] = {}
        for b in batches:
            for part, gaps, twice in zip(b.column(0).to_pylist(), b.column(1), b.column(2)):
                at = unpack_gaps(np.frombuffer(gaps.as_buffer(), np.uint8))
                count = counts.setdefault(part, np.zeros(width, np.uint8))
                more = count[at] + np.uint8(1) + np.unpackbits(np.frombuffer(twice.as_buffer(), np.uint8))[: len(at)]
                count[at] = np.minimum(more, 2)
        for part, count in counts.items():
            C.save(path, f"part-{part}", np.packbits(count >= 2, bitorder="little"))
        yield pa.record_batch([pa.array(list(counts), pa.int32())], ["part"])

    return merge


def _merged(path: str, bits: int, parts: list[int]) -> list[list]:
    """The merged bits by row and block; None where a block has no cell."""
    if path not in _kept:
        _kept.clear()
        _kept[path] = [[C.load(path, f"part-{b * ROWS + r}", np.uint8) if b * ROWS + r in parts else None for b in range(BLOCKS)] for r in range(ROWS)]
    return _kept[path]


def may_repeat(hashes: np.ndarray, sketch: list[list], bits: int) -> np.ndarray:
    """Whether the estimated count of each window is two or more."""
    live = np.arange(len(hashes))
    per = np.uint32(bits - int(np.log2(BLOCKS)))
    for row in range(ROWS):
        cell = cells(hashes[live], row, bits)
        order = np.argsort(cell >> per, kind="stable")
        edge = np.searchsorted((cell >> per)[order], np.arange(BLOCKS + 1))
        ok = np.zeros(len(live), bool)
        for block, flags in enumerate(sketch[row]):
            which = order[edge[block] : edge[block + 1]]
            if flags is not None and len(which):
                inside = cell[which] & np.uint32((1 << int(per)) - 1)
                ok[which] = (flags[inside >> np.uint32(3)] >> (inside & np.uint32(7)).astype(np.uint8)) & 1
        live = live[ok]
    return live


def _select(path: str, size: int, bits: int, parts: list[int]):
    def select(batches):
        sketch = _merged(path, bits, parts)
        for b in C.sub_batches(batches):
            data, off = C.text_bytes(C.column(b, "text"))
            h, row, start, end = windows(data, off, size)
            live = may_repeat(h, sketch, bits)
            if len(live):
                # offsets in characters: the bytes before, less those that continue a character
                chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
                row, base = row[live], chars[off[row[live]]]
                span = (chars[start[live]] - base) << 32 | (chars[end[live]] - base)
                yield pa.record_batch([pa.array(h[live].astype(np.int64)), C.column(b, "doc_id").take(pa.array(row)), pa.array(span)], ["h", "doc_id", "span"])

    return select


def width_bits(docs: DataFrame) -> int:
    """About four cells for each window of the input, by the size of its files."""
    return int(np.clip(np.ceil(np.log2(max(1, C.plan_bytes(docs)) * 1.1)), MIN_WIDTH_BITS, MAX_WIDTH_BITS))


def repeated_windows(docs: DataFrame, size: int = WINDOW, bits: int | None = None) -> DataFrame:
    """doc_id, span and first (doc_id and span) of every window that occurred earlier; a span is its start << 32 | its end, in characters."""
    bits = bits or width_bits(docs)
    texts = C.texts(docs.where("doc_id is not null and text <> ''"))
    path = C.fresh_path(docs.sparkSession, "sketch")
    touched = texts.mapInArrow(C.tidy(_sketch(size, bits)), "part int, gaps binary, twice binary")
    spread = min(BLOCKS * ROWS, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    parts = [r.part for r in touched.repartition(spread, "part").mapInArrow(C.tidy(_merge(path, bits)), "part int").collect()]
    found = texts.mapInArrow(C.tidy(_select(path, size, bits, parts)), "h long, doc_id long, span long")
    place = F.struct("doc_id", "span")
    return found.withColumn("first", F.min(place).over(W.partitionBy("h"))).where(F.col("first") != place).select("doc_id", "span", "first")


def _unite(batches):
    """Per document, the overlapping or touching windows (equal ones of repeated rows too) as one span, with the document of the first window's first occurrence."""
    for b in batches:
        if not b.num_rows:
            continue
        lists = C.column(b, "spans")
        n = np.diff(C.offsets_of(lists))
        flat = lists.flatten()
        span, source = np.asarray(flat.field(0)), np.asarray(flat.field(1))
        row = np.repeat(np.arange(len(n)), n)
        order = np.lexsort((span, row))
        row, span, source = row[order], span[order], source[order]
        start, end = span >> 32, span & 0xFFFFFFFF
        # a window's end never falls below an earlier start's: the last end so far, within the row
        reach = np.maximum.accumulate(end + row * (1 << 33))
        new = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (start[1:] + row[1:] * (1 << 33) > reach[:-1])]))
        last = np.append(new[1:], len(row)) - 1
        ids = C.column(b, "doc_id").take(pa.array(row[new]))
        yield pa.record_batch([ids, pa.array(start[new].astype(np.int32)), pa.array((reach[last] - row[new] * (1 << 33)).astype(np.int32)), pa.array(source[new])], ["doc_id", "start", "end", "first_doc_id"])


def repeats(docs: DataFrame, size: int = WINDOW, bits: int | None = None) -> DataFrame:
    """doc_id, start, end (in characters) and first_doc_id of every maximal span of windows that occurred earlier."""
    later = repeated_windows(docs, size, bits)
    listed = later.groupBy("doc_id").agg(F.collect_list(F.struct("span", F.col("first.doc_id").alias("source"))).alias("spans"))
    return listed.mapInArrow(_unite, "doc_id long, start int, end int, first_doc_id long")


def remove_repeats(docs: DataFrame, size: int = WINDOW) -> DataFrame:
    """The documents, their repeated spans cut out of the text; all columns stay. Rows of one doc_id must have one text."""
    own, cuts = C.unused(docs, "id"), C.unused(docs, "spans")
    spans = repeats(docs, size).groupBy(F.col("doc_id").alias(own)).agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias(cuts))

    @F.arrow_udf("string")
    def cut(text: pa.Array, spans: pa.Array) -> pa.Array:
        out = []
        for t, s in zip(text.to_pylist(), spans.to_pylist()):
            if s:
                edges = [0, *[x for span in s for x in (span["start"], span["end"])], len(t)]
                t = "".join(t[a:b] for a, b in zip(edges[::2], edges[1::2]))
            out.append(t)
        return pa.array(out, pa.string())

    both = docs.join(spans.hint("shuffle_hash"), F.col("doc_id").cast("long") == F.col(own), "left")
    return both.select(*[F.when(F.col(cuts).isNull(), F.col("text")).otherwise(cut("text", cuts)).alias(c) if c == "text" else F.col(f"`{c}`") for c in docs.columns])


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats(C.read(spark, sf_dir, "documents"))


#: DuckDB SQL for op1: every window of 50 words, its first occurrence, and the later ones' overlapping spans.
SQL = r"""
WITH parts AS (SELECT doc_id, generate_subscripts(cs, 1) AS i, unnest(cs) AS c
               FROM (SELECT doc_id, regexp_extract_all(text, '[\t\n\x0B\f\r ]*[^\t\n\x0B\f\r ]+') AS cs FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL)),
words AS (SELECT doc_id, i, regexp_extract(c, '[^\t\n\x0B\f\r ]+$') AS word, sum(length(c)) OVER (PARTITION BY doc_id ORDER BY i) AS e FROM parts),
win AS (SELECT doc_id, e - length(word) AS s, lead(e, 49) OVER (PARTITION BY doc_id ORDER BY i) AS e,
               md5(string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 49 FOLLOWING)) AS h FROM words),
grp AS (SELECT doc_id, s, e, first_value(doc_id) OVER g AS fd, first_value(s) OVER g AS fs FROM win WHERE e IS NOT NULL WINDOW g AS (PARTITION BY h ORDER BY doc_id, s)),
later AS (SELECT doc_id, s, e, fd, max(e) OVER (PARTITION BY doc_id ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM grp WHERE doc_id <> fd OR s <> fs),
isle AS (SELECT *, sum(CASE WHEN reach IS NULL OR s > reach THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY s) AS k FROM later)
SELECT doc_id, CAST(min(s) AS INTEGER) AS start, CAST(max(e) AS INTEGER) AS "end", arg_min(fd, s) AS first_doc_id FROM isle GROUP BY doc_id, k
"""
