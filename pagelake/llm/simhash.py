"""SimHash near-dedup over deletion-variant signatures.

A signature has BITS bits: the signs of the sums of +-1 vectors of a text's words (runs of letters
and digits, folded), each word weighted by the root of its frequency. Signatures that differ by at most
MAX_BITS = 36 bits are near; every such pair is found, in two passes.

The first finds most of them at a small price. A signature is cut into SEGMENTS; each is indexed by its
variants with one bit left out (a wildcard), variants are joined by equality and the members of each bucket
verified by Hamming distance. Up to 2 * SEGMENTS - 1 = 17 bits some segment differs by at most one, so that
a variant is shared; beyond, a pair of independently differing bits has a common variant with the chances that
``chance`` gives: 0.997 at 20 bits, 0.95 at 24, 0.84 at 28, 0.66 at 32 and 0.49 at 36.

The second finds what is left: pairs of different groups of the first pass. The bits are cut into ``pieces``,
each with a radius, whose sum with their number is one more than the limit, so that near signatures differ by at
most the radius in one of the pieces. Signatures are sorted by the piece's value; each looks up all values within
the radius, and what is there and of another group is compared in full. Tasks are a piece of two blocks of about
BLOCK signatures, read from the shared folder, so that memory is bounded; work still grows with the square of the
signatures, by the small share of pairs that agree in a piece by chance.

Equal signatures are joined first. Buckets of more than one signature are kept as member lists, equal
lists once; a bucket's verified pairs are reduced to a spanning forest, which leaves the connected
components as all its pairs would; components over the corpus are found by alternating large-star
and small-star steps. There is no cap on a bucket's members.

Defined results: null ids and texts without a letter or digit are in no group; rows of one doc_id
are one document, which is linked by the signature of each of them; ties keep the least doc_id; extra columns pass through whatever their names;
doc_id is a whole number (or a string of one); very long texts are read whole, as one row of work arrays of about 30 bytes a byte of text; an
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

BITS, SEGMENTS, MAX_BITS = 256, 9, 36
LONGS = BITS // 64
CUTS = np.linspace(0, BITS, SEGMENTS + 1).astype(int)
#: Signatures of a block of the second pass, pairs compared at a time, and the most bits of a piece that are looked up.
BLOCK, PAIRS, PIECE_BITS = 1 << 20, 1 << 14, 21

#: Bytes of a word: ASCII letters and digits, and all of a multi-byte character; ASCII capitals folded.
_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[65:91] = _WORD[97:123] = _WORD[128:] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
#: Latin capitals of two bytes (C3 80 to C3 9E) lie 32 below their small letters.
_SIGNS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.float32)


def fold(data: np.ndarray) -> np.ndarray:
    out = _FOLD[data]
    if len(data) > 1:
        capital = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)) + 1
        out[capital] += 32
    return out


def signatures(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """LONGS unsigned words for each text, and whether it has any word."""
    n = len(off) - 1
    start, end = C.runs(_WORD[data], off)
    first = np.searchsorted(start, off)
    out = np.zeros((n, LONGS), np.uint64)
    if not len(start):
        return out, np.zeros(n, bool)
    h = C.hash_ranges(fold(data), start, end)
    row = np.repeat(np.arange(n), np.diff(first))
    # the distinct words of each text and their frequencies
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    new = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (row[1:] != row[:-1])]))
    weight = np.sqrt(np.diff(np.concatenate([new, [len(h)]]))).astype(np.float32)
    h, row = h[new], row[new]
    edges = np.searchsorted(row, np.arange(n + 1))
    step = 64
    for a in range(0, n, step):
        z = min(a + step, n)
        lo, hi = edges[a], edges[z]
        key = (row[lo:hi] - a) * 256
        for k in range(LONGS):
            x = C.mix(h[lo:hi] + np.uint64(0x632BE59BD9B4E019 * (k + 1) & (2**64 - 1)))
            word = np.zeros(z - a, np.uint64)
            for byte in range(8):
                v = ((x >> np.uint64(8 * byte)) & np.uint64(255)).astype(np.int64)
                hist = np.bincount(key + v, weights=weight[lo:hi], minlength=(z - a) * 256).reshape(z - a, 256).astype(np.float32)
                up = 2 * (hist @ _SIGNS) - hist.sum(1, keepdims=True) > 1e-3
                word |= (up * (1 << np.arange(8))).sum(1).astype(np.uint64) << np.uint64(8 * byte)
            out[a:z, k] = word
    return out, np.diff(first) > 0


def distances(sigs: np.ndarray, one: np.ndarray) -> np.ndarray:
    return np.bitwise_count(sigs ^ one).sum(-1)


def variants(sigs: np.ndarray) -> np.ndarray:
    """BITS keys for each signature: every segment with each of its bits left out."""
    bits = np.unpackbits(np.ascontiguousarray(sigs).view(np.uint8), axis=1, bitorder="little").astype(np.uint64)
    out = np.empty((len(sigs), BITS), np.uint64)
    for s in range(SEGMENTS):
        lo, hi = CUTS[s], CUTS[s + 1]
        value = (bits[:, lo:hi] << np.arange(hi - lo, dtype=np.uint64)).sum(1).astype(np.uint64)
        for j in range(hi - lo):
            rest = value & ~np.uint64(1 << j)
            out[:, lo + j] = (rest << np.uint64(16)) | np.uint64(lo + j)
    return out


def chance(bits: int, tries: int = 20_000, seed: int = 3) -> float:
    """The share of signatures with so many differing bits, anywhere, that have a segment with one at most."""
    rng = np.random.default_rng(seed)
    at = rng.random((tries, BITS)).argpartition(bits, 1)[:, :bits] if bits else np.zeros((tries, 0), int)
    segment = np.searchsorted(CUTS, at, "right") - 1
    counts = np.stack([(segment == s).sum(1) for s in range(SEGMENTS)], 1)
    return float((counts.min(1) <= 1).mean())


def forest(sigs: np.ndarray, limit: int = MAX_BITS) -> np.ndarray:
    """For each signature, the least index that it is connected with by pairs of at most ``limit`` bits."""
    n = len(sigs)
    root = np.full(n, -1)
    for i in range(n):
        if root[i] >= 0:
            continue
        root[i], todo = i, [i]
        while todo:
            free = np.flatnonzero(root < 0)
            if not len(free):
                break
            hit = free[distances(sigs[free], sigs[todo.pop()]) <= limit]
            root[hit] = i
            todo.extend(hit.tolist())
    return root


def _sign(batches):
    for b in C.sub_batches(batches):
        sigs, some = signatures(*C.text_bytes(C.column(b, "text")))
        rows = pa.array(np.flatnonzero(some))
        s = sigs[some].astype(np.int64)
        yield pa.record_batch([C.column(b, "doc_id").take(rows)] + [pa.array(s[:, k]) for k in range(LONGS)], ["doc_id"] + [f"s{k}" for k in range(LONGS)])


def _keys(parts):
    """Variant keys, cut to 48 bits, by part of the key space: sorted by signature, with each signature's number of keys."""

    def keys(batches):
        for b in batches:
            for at in range(0, b.num_rows, 4_000):
                piece = b.slice(at, 4_000)
                sigs = np.stack([C.column(piece, f"s{k}").to_numpy() for k in range(LONGS)], 1).astype(np.uint64)
                rep = C.column(piece, "rep").to_numpy()
                key = C.mix(variants(sigs).ravel()) >> np.uint64(16)
                part = (key % np.uint64(parts)).astype(np.uint32)
                order = np.argsort(part, kind="stable")
                edge = np.searchsorted(part[order], np.arange(parts + 1))
                key, owner = key[order], order // BITS
                rows = []
                for p in np.flatnonzero(np.diff(edge)):
                    lo, hi = edge[p], edge[p + 1]
                    new = np.flatnonzero(np.concatenate([[True], owner[lo + 1 : hi] != owner[lo : hi - 1]]))
                    count = np.diff(np.append(new, hi - lo))
                    rows.append((int(p), np.ascontiguousarray(key[lo:hi].view(np.uint8).reshape(-1, 8)[:, :6]).tobytes(), rep[owner[lo + new]].tobytes(), count.astype(np.uint16).tobytes()))
                yield pa.record_batch([pa.array([r[0] for r in rows], pa.int32())] + [pa.array([r[k] for r in rows], pa.binary()) for k in (1, 2, 3)], ["part", "keys", "reps", "counts"])

    return keys


def _unpacked(batches):
    for b in batches:
        for keys, reps, counts in zip(*(C.column(b, c) for c in ("keys", "reps", "counts"))):
            six = np.frombuffer(keys.as_buffer(), np.uint8).reshape(-1, 6)
            key = np.zeros((len(six), 8), np.uint8)
            key[:, :6] = six
            yield key.view(np.uint64).ravel(), np.repeat(np.frombuffer(reps.as_buffer(), np.int64), np.frombuffer(counts.as_buffer(), np.uint16))


def _buckets(batches):
    """The member lists of more than one of a partition of keys, equal lists once."""
    parts = list(_unpacked(batches))
    if not parts:
        return
    key, rep = (np.concatenate(x) for x in zip(*parts))
    order = np.argsort(key, kind="stable")
    key, rep = key[order], rep[order]
    edges = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]]))
    size = np.diff(edges)
    many = size > 1
    rep, size = rep[np.repeat(many, size)], size[many]
    if not len(size):
        return
    at = np.cumsum(size) - size
    rep = rep[np.lexsort((rep, np.repeat(np.arange(len(size)), size)))]
    name = C.range_hash(C.prefix_hash(C.mix(rep.astype(np.uint64))), at, at + size).astype(np.int64)
    _, once = np.unique(name, return_index=True)
    flat = C.ragged(at[once], size[once])
    yield pa.record_batch([pa.array(np.repeat(name[once], size[once])), pa.array(rep[flat])], ["bucket", "rep"])


def linked(bucket: np.ndarray, rep: np.ndarray, sigs: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of each bucket's pairs within the limit; rows sorted by bucket and rep."""
    first = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
    size = np.diff(np.append(first, len(bucket)))
    head = np.repeat(first, size)
    near = distances(sigs, sigs[head]) <= limit
    a, b = [rep[head]], [rep]
    keep = [near & (np.arange(len(rep)) != head)]
    for k in np.flatnonzero(np.logical_or.reduceat(~near, first) & (size > 2)) if len(first) else ():
        at = slice(first[k], first[k] + size[k])
        root = forest(sigs[at], limit)
        keep[0][at] = False
        a.append(rep[at][root])
        b.append(rep[at])
        keep.append(root != np.arange(size[k]))
    keep = np.concatenate(keep)
    return np.concatenate(a)[keep], np.concatenate(b)[keep]


def _verify(limit, rows=1 << 16):
    """Pairs of ids, of rows sorted by bucket and id, some whole buckets at a time."""

    def pairs(table):
        sigs = np.stack([table.column(f"s{k}").to_numpy() for k in range(LONGS)], 1).astype(np.uint64)
        a, b = linked(table.column("bucket").to_numpy(), table.column("least").to_numpy(), sigs, limit)
        return pa.record_batch([pa.array(a), pa.array(b)], ["a", "b"])

    def verify(batches):
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= rows:
                table = pa.Table.from_batches(held)
                bucket = table.column("bucket").to_numpy()
                whole = int(np.searchsorted(bucket, bucket[-1]))
                if whole:
                    yield pairs(table.slice(0, whole))
                held = table.slice(whole).to_batches()
                n -= whole
        if n:
            yield pairs(pa.Table.from_batches(held))

    return verify


def pieces(limit: int) -> list[tuple[int, int, int]]:
    """First bit, bits and radius of pieces such that signatures within the limit differ by at most the radius in one of them."""
    n = limit // 3 + 1
    radius = np.full(n, 2)
    for k in range(3 * n - limit - 1):
        radius[k % n] -= 1
    cuts = np.concatenate([[0], np.cumsum(np.array([8, 15, 21])[radius])])
    cuts = np.round(cuts * (BITS / cuts[-1])).astype(int)
    return [(int(lo), int(min(hi - lo, PIECE_BITS)), int(r)) for lo, hi, r in zip(cuts, cuts[1:], radius)]


def piece_values(sigs: np.ndarray, lo: int, bits: int) -> np.ndarray:
    """The value of so many bits from ``lo`` on, of each column of LONGS rows."""
    k, shift = divmod(lo, 64)
    value = sigs[k] >> np.uint64(shift)
    if shift + bits > 64:
        value = value | (sigs[k + 1] << np.uint64(64 - shift))
    return (value & np.uint64((1 << bits) - 1)).astype(np.int64)


class Sorted:
    """Signatures by a piece's value and their group; runs of both equal, and each value's first run."""

    def __init__(self, sigs: np.ndarray, group: np.ndarray, lo: int, bits: int):
        value = piece_values(sigs, lo, bits)
        order = np.lexsort((group, value))
        value, group, self.sigs = value[order], group[order], np.ascontiguousarray(sigs[:, order])
        self.groups = group
        self.at = np.flatnonzero(np.concatenate([[True], (value[1:] != value[:-1]) | (group[1:] != group[:-1])]))
        self.size = np.diff(np.append(self.at, len(value)))
        self.value, self.group = value[self.at], group[self.at]
        self.first = np.concatenate([[0], np.cumsum(np.bincount(self.value, minlength=1 << bits))])


def _runs(a: Sorted, b: Sorted, bits: int, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of runs of different groups whose values are within the radius; of one table's with itself each once."""
    single = [1 << k for k in range(bits)]
    masks = {0} | (set(single) if radius else set()) | ({x | y for x in single for y in single} if radius > 1 else set())
    for mask in sorted(masks):
        if a is b and not mask:
            run = np.arange(len(a.value))
            lo, hi = run + 1, b.first[a.value + 1]
        else:
            run = np.flatnonzero(a.value & (1 << (mask.bit_length() - 1)) == 0) if a is b else np.arange(len(a.value))
            other = a.value[run] ^ mask
            lo, hi = b.first[other], b.first[other + 1]
        some = np.flatnonzero(hi > lo)
        run, lo, n = run[some], lo[some], (hi - lo)[some]
        for x, y in C.blocks(n, PAIRS):
            left, right = np.repeat(run[x:y], n[x:y]), C.ragged(lo[x:y], n[x:y])
            apart = np.flatnonzero(a.group[left] != b.group[right])
            if len(apart):
                yield left[apart], right[apart]


def _rows(a: Sorted, b: Sorted, left: np.ndarray, right: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The rows of pairs of runs, every one of the left with every one of the right."""
    single = (a.size[left] == 1) & (b.size[right] == 1)
    yield a.at[left[single]], b.at[right[single]]
    left, right = left[~single], right[~single]
    for x, y in C.blocks(a.size[left], PAIRS):
        n = a.size[left[x:y]]
        i, other = C.ragged(a.at[left[x:y]], n), np.repeat(right[x:y], n)
        n = b.size[other]
        for p, q in C.blocks(n, PAIRS):
            yield np.repeat(i[p:q], n[p:q]), C.ragged(b.at[other[p:q]], n[p:q])


def _once(pairs: np.ndarray) -> np.ndarray:
    """The different columns of two rows."""
    pairs = pairs[:, np.lexsort(pairs)]
    return pairs[:, np.concatenate([[True], (pairs[:, 1:] != pairs[:, :-1]).any(0)])[: pairs.shape[1]]]


def across(a: Sorted, b: Sorted, bits: int, radius: int, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Lesser and greater group, once each, of all pairs of different groups within the limit whose pieces are within the radius."""
    found, n = [np.zeros((2, 0), np.int64)], 0
    for left, right in _runs(a, b, bits, radius):
        for i, j in _rows(a, b, left, right):
            d = np.bitwise_count(a.sigs[0][i] ^ b.sigs[0][j]).astype(np.int16)
            for k in range(1, LONGS):
                d += np.bitwise_count(a.sigs[k][i] ^ b.sigs[k][j])
                near = np.flatnonzero(d <= limit)
                d, i, j = d[near], i[near], j[near]
            if len(i):
                one, two = a.groups[i], b.groups[j]
                found.append(np.stack([np.minimum(one, two), np.maximum(one, two)]))
                n += len(i)
                if n > max(16 * PAIRS, found[0].shape[1]):
                    found, n = [_once(np.concatenate(found, axis=1))], 0
    return tuple(_once(np.concatenate(found, axis=1)))


def _save_block(path):
    """A partition's signatures and groups as one file of the shared folder; its number and rows."""

    def save(batches):
        columns = [f"s{k}" for k in range(LONGS)] + ["group"]
        held = [np.stack([C.column(b, c).to_numpy() for c in columns]) for b in batches if b.num_rows]
        if held:
            block = TaskContext.get().partitionId()
            C.save(path, str(block), np.concatenate(held, axis=1))
            yield pa.record_batch([pa.array([block], pa.int32())], ["block"])

    return save


def _search(path, tasks, limit):
    """The groups that each task's piece of two blocks links."""

    def block(name):
        table = np.array(C.load(path, str(name), np.int64)).reshape(LONGS + 1, -1)
        return table[:LONGS].view(np.uint64), table[LONGS]

    def search(batches):
        for batch in batches:
            for task in C.column(batch, "id").to_pylist():
                one, two, (lo, bits, radius) = tasks[task]
                a = Sorted(*block(one), lo, bits)
                b = a if one == two else Sorted(*block(two), lo, bits)
                x, y = across(a, b, bits, radius, limit)
                yield pa.record_batch([pa.array(x), pa.array(y)], ["a", "b"])

    return search


def missing(grouped: DataFrame, rows: int, limit: int) -> DataFrame:
    """Pairs of groups, the lesser first, that some signatures of theirs within the limit link; ``grouped`` has s0 .. and group."""
    spark = grouped.sparkSession
    path = C.fresh_path(spark, "signatures")
    saved = grouped.repartition(rows // BLOCK + 1, "rep").mapInArrow(C.tidy(_save_block(path)), "block int").collect()
    blocks = sorted(r.block for r in saved)
    tasks = [(x, y, piece) for k, x in enumerate(blocks) for y in blocks[k:] for piece in pieces(limit)]
    found = spark.range(0, len(tasks), 1, max(len(tasks), 1)).mapInArrow(C.tidy(_search(path, tasks, limit)), "a long, b long")
    return found.distinct()


def components(edges: DataFrame) -> DataFrame:
    """id and group, the least id connected with it, for every id of the edges a, b (a < b)."""
    edges = C.checkpoint(edges.distinct())
    before = None
    while True:
        # large-star: a vertex's greater neighbours join the least of its neighbourhood
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a and b <> m").select(F.col("m").alias("a"), "b").distinct()
        # small-star: its smaller neighbours, and it, join the least of them
        down = large.select(F.col("b").alias("v"), F.col("a").alias("u"))
        low = down.groupBy("v").agg(F.min("u").alias("m"))
        edges = C.checkpoint(down.join(low, "v").select(F.col("m").alias("a"), F.explode(F.array("u", "v")).alias("b")).where("a <> b").distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    groups = edges.select(F.col("b").alias("id"), F.col("a").alias("group"))
    return groups.union(edges.select(F.col("a").alias("id"), F.col("a").alias("group")).distinct())


def groups(docs: DataFrame, limit: int = MAX_BITS) -> DataFrame:
    """doc_id, group_id (its least doc_id) and keep of every document that has a near copy."""
    names = [f"s{k}" for k in range(LONGS)]
    signed = C.texts(docs.where("doc_id is not null and text is not null")).mapInArrow(C.tidy(_sign), "doc_id long, " + ", ".join(f"{x} long" for x in names))
    return groups_of_signatures(C.checkpoint(signed.distinct()), limit)


def groups_of_signatures(signed: DataFrame, limit: int = MAX_BITS) -> DataFrame:
    """The same from doc_id and each of its different signatures' s0 .. ."""
    names = [f"s{k}" for k in range(LONGS)]
    # rep is the signature's own number, least its least doc_id, which other signatures may have, too
    distinct = C.checkpoint(signed.groupBy(*names).agg(F.min("doc_id").alias("least"), F.count("*").alias("n")).withColumn("rep", F.monotonically_increasing_id()))
    same = signed.join(distinct.where("n > 1"), names).where("doc_id <> least").select(F.col("least").alias("a"), F.col("doc_id").alias("b"))
    rows = distinct.count()
    parts = max(int(signed.sparkSession.conf.get("spark.sql.shuffle.partitions")), rows * BITS // 1_000_000 + 1)
    keys = distinct.select("rep", *names).mapInArrow(C.tidy(_keys(parts)), "part int, keys binary, reps binary, counts binary")
    members = keys.repartition(parts, "part").mapInArrow(C.tidy(_buckets), "bucket long, rep long").distinct()
    signed_members = members.join(distinct.select("rep", "least", *names), "rep").drop("rep").repartition("bucket").sortWithinPartitions("bucket", "least")
    near = signed_members.mapInArrow(C.tidy(_verify(limit)), "a long, b long").where("a <> b")
    if limit > 2 * SEGMENTS - 1:
        first = components(near).select(F.col("id").alias("least"), "group")
        grouped = distinct.join(first, "least", "left").select("rep", *names, F.coalesce("group", "least").alias("group"))
        near = first.where("least <> group").select(F.col("group").alias("a"), F.col("least").alias("b")).union(missing(grouped, rows, limit))
    found = components(same.union(near))
    return found.select(F.col("id").alias("doc_id"), F.col("group").alias("group_id"), (F.col("id") == F.col("group")).alias("keep"))


def filter_near_copies(docs: DataFrame, limit: int = MAX_BITS) -> DataFrame:
    """The documents without all but one of each group of near copies; the columns stay."""
    own = C.unused(docs, "id")
    gone = groups(docs, limit).where("not keep").select(F.col("doc_id").alias(own))
    return docs.join(gone.hint("shuffle_hash"), F.col("doc_id").cast("long") == F.col(own), "left_anti")


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups(C.read(spark, sf_dir, "documents"))
