"""Benchmark decontamination by the q-gram lemma.

Texts are compared by their characters, lower-cased one by one and white space made a space, so
that offsets stay. A benchmark item is cut into pieces of PIECE characters that overlap by half (a
shorter item is one piece); a document leaks an item if some piece lies in it with at most
floor(RATE * length) edits. By the q-gram lemma such a place shares at least length + 1 - q * (edits + 1)
q-grams with the piece, on edits + 1 neighbouring diagonals: shared q-grams are counted in bands of twice
that many diagonals, each overlapping the next by half, and bands that reach the bound are verified
by a banded alignment over all their diagonals. q is Q = 8 where that leaves a bound of one at least,
and SHORT_Q = 5 for the few short lengths (10 to 15, 20 to 23, 30 and 31 characters) where it wouldn't.
Nothing that the definition asks for is missed.

Equal q-grams in a row, as in indented code or ruled tables, are one run, in texts and in pieces; the pairs of two
runs on each diagonal are a trapezium, whose sums over half bands are added in closed form. Before that, a
piece is left out for a text that doesn't hold enough of its q-grams anywhere. Very long texts are searched in
overlapping stretches of STRETCH diagonals, on one grid of bands.

The benchmark's rows are spread over parts of about PART_BYTES; one task indexes each and lays the index into the shared
folder, from where workers map them all: one pass over the documents, whatever the benchmark's size.

Defined results: null texts leak nothing; items shorter than Q characters, or null, are no items; an
item of null or repeated item_id counts under that id, every one of its rows' pieces by itself; among equally good places the
first by start, then end, is given; null doc_ids and rows of one doc_id are searched one by
one, every row giving its own results; doc_id and item_id are whole numbers (or strings of such); extra columns pass through
``filter_leaks``, whatever their names, and are ignored elsewhere; very long texts are searched whole; empty tables give no leaks.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe
from . import common as C

Q, SHORT_Q, PIECE, RATE = 8, 5, 96, 0.1
PART_BYTES, TABLE_BITS = 8 << 20, 22
#: Diagonals of a stretch: a multiple of every band's step, 1 to 10. Entries counted at a time.
STRETCH, AT_ONCE = 2520 * 26, 1 << 21
SCHEMA = "doc_id long, item_id long, edits int, pieces int, start int, end int"
_kept: dict = {}


def _folds() -> np.ndarray:
    """Every codepoint's lower-case one, if it is a single one; white space's is the space."""
    if "folds" not in _kept:
        table = np.arange(0x110000, dtype=np.int32)
        for c in range(0x1E944):
            low = chr(c).lower()
            if len(low) == 1:
                table[c] = ord(low)
        table[bpe.WHITE] = 32
        _kept["folds"] = table
    return _kept["folds"]


def characters(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Folded codepoints of the texts, and the rows' offsets in them."""
    code, at = bpe.codepoints(data)
    return _folds()[code], np.searchsorted(at, off)


def grams(code: np.ndarray, q: int = Q) -> np.ndarray:
    """A 32-bit hash of the q (8 or 5) characters from each position on."""
    h = (code.astype(np.uint32) + np.uint32(1)) * np.uint32(0x9E3779B1)
    h ^= h >> np.uint32(15)
    for k, m in ((1, 0x85EBCA6B), (2, 0xC2B2AE35), (4, 0x27D4EB2F)) if q == 8 else ((1, 0x85EBCA6B), (2, 0xC2B2AE35), (1, 0x27D4EB2F)):
        if len(h) <= k:
            return np.zeros(0, np.uint32)
        h = h[:-k] * np.uint32(m) + h[k:]
    h ^= h >> np.uint32(16)
    h *= np.uint32(0x2C1B3C6D)
    return h ^ (h >> np.uint32(15))


def _heads(*same: np.ndarray) -> np.ndarray:
    """Where a row differs from the one before in one of the arrays."""
    new = np.ones(len(same[0]), bool)
    if len(new) > 1:
        new[1:] = same[0][1:] != same[0][:-1]
        for x in same[1:]:
            new[1:] |= x[1:] != x[:-1]
    return np.flatnonzero(new)


def _below(x: np.ndarray, m: np.ndarray) -> np.ndarray:
    """The sum of clip(t, 0, m) over all t below x."""
    x = np.maximum(x, 0)
    inside = np.minimum(x, m + 1)
    return inside * (inside - 1) // 2 + (x - inside) * m


class Grams:
    """Where the q-grams of some pieces lie in them: runs of equal ones, and each piece's number of places by q-gram."""

    NAMES = ("of", "hash", "first", "piece", "at", "length", "places")

    def __init__(self, codes: list[np.ndarray], of: np.ndarray, q: int):
        hashes = [grams(codes[p], q) for p in of]
        flat = np.concatenate([np.zeros(0, np.uint32), *hashes])
        piece = np.repeat(np.arange(len(of)), [len(h) for h in hashes]).astype(np.int64)
        at = np.concatenate([np.zeros(0, np.int64), *[np.arange(len(h)) for h in hashes]])
        head = _heads(flat, piece)
        length = np.diff(np.append(head, len(flat)))
        order = np.lexsort((at[head], piece[head], flat[head]))
        self.of, self.q = of, q
        self.piece, self.at, self.length = piece[head][order], at[head][order], length[order]
        self.hash, first = np.unique(flat[head][order], return_index=True)
        self.first = np.append(first, len(head))
        # how many places of the piece the q-gram has, at its first run there; 0 at further ones
        self.places = np.zeros(len(head), np.int64)
        if len(head):
            both = _heads(np.repeat(np.arange(len(first)), np.diff(self.first)), self.piece)
            self.places[both] = np.add.reduceat(self.length, both)
        self._table()

    def _table(self):
        """Whether some q-gram's hash begins with these bits; the runs by piece, and each run's q-gram."""
        self.table = np.zeros(1 << TABLE_BITS, bool)
        self.table[self.hash >> np.uint32(32 - TABLE_BITS)] = True
        self.place = np.repeat(np.arange(len(self.hash)), np.diff(self.first))
        self.by = np.argsort(self.piece, kind="stable")
        self.runs = np.bincount(self.piece, minlength=len(self.of))
        self.opens = np.cumsum(self.runs) - self.runs

    def save(self, path: str, name: str) -> None:
        for x in self.NAMES:
            C.save(path, f"{name}-{x}", getattr(self, x))

    @classmethod
    def load(cls, path: str, name: str, q: int) -> Grams:
        self = cls.__new__(cls)
        self.q = q
        for x in cls.NAMES:
            setattr(self, x, C.load(path, f"{name}-{x}", np.uint32 if x == "hash" else np.int64))
        self._table()
        return self


class Index:
    """The pieces of items and where each q-gram lies in them."""

    def __init__(self, items: list[tuple], piece: int = PIECE, rate: float = RATE):
        codes, owner = [], []
        for item, text in items:
            code = _folds()[np.array([ord(c) for c in text or ""], np.int64)]
            if len(code) < Q:
                continue
            step = max(1, piece // 2)
            for at in sorted({*range(0, max(1, len(code) - piece), step), max(0, len(code) - piece)}):
                codes.append(code[at : at + piece])
                owner.append(item)
        size = np.array([len(c) for c in codes], np.int64)
        self._set(owner, np.concatenate([np.zeros(0, np.int32), *codes]), size, np.array([int(rate * n + 1e-9) for n in size], np.int64))
        short = size + 1 - Q * (self.edits + 1) < 1
        self.grams = [Grams(codes, of, q) for q, of in ((Q, np.flatnonzero(~short)), (SHORT_Q, np.flatnonzero(short))) if len(of)]

    def _set(self, owner, flat, size, edits):
        self.owner, self.flat, self.size, self.edits = owner, flat, size, edits
        self.codes = np.split(flat, np.cumsum(size)[:-1]) if len(size) else []
        self.longest = int(size.max(initial=0))

    def save(self, path: str, name: str) -> None:
        for g in self.grams:
            g.save(path, f"{name}-{g.q}")
        C.save(path, f"{name}-flat", self.flat)
        C.save(path, f"{name}-size", self.size)
        C.save(path, f"{name}-edits", self.edits)
        C.save(path, name, np.frombuffer(json.dumps({"owner": self.owner, "q": [g.q for g in self.grams]}).encode(), np.uint8))

    @classmethod
    def load(cls, path: str, name: str) -> Index:
        self, head = cls.__new__(cls), json.loads(bytes(C.load(path, name, np.uint8)))
        self.grams = [Grams.load(path, f"{name}-{q}", q) for q in head["q"]]
        self._set(head["owner"], *((C.load(path, f"{name}-{x}", kind) if head["owner"] else np.zeros(0, kind)) for x, kind in (("flat", np.int32), ("size", np.int64), ("edits", np.int64))))
        return self

    def bands(self, code: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, piece and first diagonal (of the row) of the bands that reach the bound."""
        out = [(np.zeros(0, np.int64),) * 3]
        size = np.diff(off)
        if size.max(initial=0) <= STRETCH + self.longest:
            out += [self._bands(g, code, off) for g in self.grams]
        else:
            for r in range(len(size)):
                for base in range(0, int(size[r]), STRETCH):
                    part = code[off[r] + base : min(off[r] + base + STRETCH + 4 * self.longest, off[r + 1])]
                    for g in self.grams:
                        _, piece, diagonal = self._bands(g, part, np.array([0, len(part)]))
                        out.append((np.full(len(piece), r), piece, diagonal + base))
        row, piece, diagonal = (np.concatenate(x) for x in zip(*out))
        order = np.lexsort((diagonal, piece, row))
        row, piece, diagonal = row[order], piece[order], diagonal[order]
        once = _heads(row, piece, diagonal)
        return row[once], piece[once], diagonal[once]

    def _bands(self, g: Grams, code, off):
        none = (np.zeros(0, np.int64),) * 3
        h = grams(code, g.q)
        at = np.flatnonzero(g.table[h >> np.uint32(32 - TABLE_BITS)])
        if not len(at):
            return none
        place = np.searchsorted(g.hash, h[at])
        place[place == len(g.hash)] = 0
        ok = g.hash[place] == h[at]
        at, place = at[ok], place[ok]
        if not len(at):
            return none
        # runs of equal q-grams, by row and q-gram
        row = np.searchsorted(off, at, "right") - 1
        head = _heads(place, row, at - np.arange(len(at)))
        m = np.diff(np.append(head, len(at)))
        order = np.lexsort((at[head], place[head], row[head]))
        at, place, row, m = at[head][order] - off[row[head][order]], place[head][order], row[head][order], m[order]
        once = _heads(row, place)
        runs = np.diff(np.append(once, len(row)))
        pieces, q_grams = len(g.of), len(g.hash)
        edits = self.edits[g.of]
        least = self.size[g.of] + 1 - g.q * (edits + 1)
        # pieces that have enough of their q-grams anywhere in the row
        n = g.first[place[once] + 1] - g.first[place[once]]
        opens = np.append(_heads(row[once]), len(once))
        wanted = []
        for a, z in C.blocks(np.diff(np.append(0, np.cumsum(n))[opens]), AT_ONCE):
            own = slice(opens[a], opens[z])
            entry = C.ragged(g.first[place[once[own]]], n[own])
            pair = np.repeat(row[once[own]], n[own]) * pieces + g.piece[entry]
            order = np.argsort(pair, kind="stable")
            new = _heads(pair[order])
            if len(new):
                pair, held = pair[order][new], np.add.reduceat(g.places[entry][order], new)
                wanted.append(pair[held >= least[pair % pieces]])
        wanted = np.concatenate([np.zeros(0, np.int64), *wanted])
        # their runs that meet the row's, and the shared q-grams on the diagonals of each half band
        key, found = row[once] * q_grams + place[once], [(np.zeros(0, np.int64),) * 2]
        for a, z in C.blocks(g.runs[wanted % pieces], AT_ONCE):
            pair = wanted[a:z]
            entry = g.by[C.ragged(g.opens[pair % pieces], g.runs[pair % pieces])]
            spot = np.repeat(np.arange(a, z), g.runs[pair % pieces])
            ask = wanted[spot] // pieces * q_grams + g.place[entry]
            u = np.minimum(np.searchsorted(key, ask), len(key) - 1)
            ok = key[u] == ask
            entry, spot, u = entry[ok], spot[ok], u[ok]
            opens = np.append(_heads(spot), len(spot))
            for c, d in C.blocks(np.add.reduceat(runs[u], opens[:-1]), AT_ONCE):
                own = slice(opens[c], opens[d])
                text = C.ragged(once[u[own]], runs[u[own]])
                found += self._count(g, np.repeat(spot[own], runs[u[own]]), at[text], m[text], np.repeat(entry[own], runs[u[own]]), wanted, least, edits + 1)
        spot, band = (np.concatenate(x) for x in zip(*found))
        piece = wanted[spot] % pieces
        return wanted[spot] // pieces, g.of[piece], band * (edits + 1)[piece] - self.longest

    def _count(self, g, spot, at, m, entry, wanted, least, steps):
        """Bands that reach the bound, as places in ``wanted`` and numbers of half bands, from pairs of runs sorted by ``spot``."""
        length = g.length[entry]
        step = steps[wanted[spot] % len(g.of)]
        low = at - g.at[entry] - length + 1 + self.longest
        first = low // step
        count = (low + m + length - 2) // step - first + 1
        opens = np.append(_heads(spot), len(spot))
        for a, z in C.blocks(np.add.reduceat(count, opens[:-1]), AT_ONCE):
            own = slice(opens[a], opens[z])
            n = count[own]
            band, w = C.ragged(first[own], n), np.repeat(step[own], n)
            size, runs = np.repeat(length[own], n), np.repeat(m[own], n)
            x = band * w - np.repeat(low[own], n) + 1 - size
            total = _below(x + w + size, runs) - _below(x + w, runs) - _below(x + size, runs) + _below(x, runs)
            most = int(band.max()) + 2
            key = np.repeat(spot[own], n) * most + band
            order = np.argsort(key, kind="stable")
            new = _heads(key[order])
            total, key = np.add.reduceat(total[order], new), key[order][new]
            both = total.copy()
            both[:-1] += np.where(key[1:] == key[:-1] + 1, total[1:], 0)
            # bands that begin a step before their first shared q-gram hold the same ones as those that begin with it
            key = key[both >= least[wanted[key // most] % len(g.of)]]
            yield key // most, key % most

    def verify(self, code: np.ndarray, off: np.ndarray, row: np.ndarray, piece: np.ndarray, diagonal: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Least edits of the piece anywhere on each band's diagonals, and where in the row that place starts and ends."""
        edits, start, end = (np.zeros(len(row), np.int64) for _ in range(3))
        for size, e in sorted(set(zip(self.size[piece].tolist(), self.edits[piece].tolist()))):
            same = np.flatnonzero((self.size[piece] == size) & (self.edits[piece] == e))
            for k in range(0, len(same), 4096):
                which = same[k : k + 4096]
                pattern = np.stack([self.codes[p] for p in piece[which]])
                edits[which], start[which], end[which] = self._align(code, off, row[which], pattern, diagonal[which], int(e))
        return edits, start, end

    def _align(self, code, off, row, pattern, diagonal, e):
        low = diagonal - e
        width = 2 * (e + 1) + 2 * e
        column = np.arange(width, dtype=np.int32)
        one = np.int32(1 << 10)  # an edit; below it, the diagonal on which the alignment began
        best = np.broadcast_to(column, (len(row), width)).copy()
        lo, hi = off[row], off[row + 1]
        big = np.int32(1 << 29)
        for i in range(pattern.shape[1]):
            at = (lo + low + i)[:, None] + column
            inside = (at >= lo[:, None]) & (at < hi[:, None])
            same = inside & (code[np.clip(at, 0, len(code) - 1)] == pattern[:, i : i + 1])
            now = best + np.where(same, np.int32(0), one)
            now[:, :-1] = np.minimum(now[:, :-1], best[:, 1:] + one)
            now[:, -1] = np.minimum(now[:, -1], big)
            best = np.minimum.accumulate(now - column * one, 1) + column * one
        found = best.argmin(1)
        value = best[np.arange(len(row)), found]
        length = hi - lo
        return value >> 10, np.clip(low + (value & 1023), 0, length), np.clip(low + pattern.shape[1] + found, 0, length)

    def leaks(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, ...]:
        """Row, piece, edits, start and end (in characters) of every verified band."""
        if not len(self.size) or not len(data):
            return tuple(np.zeros(0, np.int64) for _ in range(5))
        code, off = characters(data, off)
        row, piece, diagonal = self.bands(code, off)
        edits, start, end = self.verify(code, off, row, piece, diagonal)
        ok = edits <= self.edits[piece]
        return row[ok], piece[ok], edits[ok], start[ok], end[ok]


def indexed(benchmark: DataFrame) -> tuple[str, int]:
    """The shared folder with the indices of the benchmark's parts, and their number."""
    spark, path = benchmark.sparkSession, C.fresh_path(benchmark.sparkSession, "benchmark")
    items = benchmark.where("text is not null").select(F.col("item_id").cast("long"), "text")
    parts = int(items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]) // PART_BYTES + 1

    def build(batches):
        rows = [r for b in batches for r in zip(*(x.to_pylist() for x in b.columns))]
        part = TaskContext.get().partitionId()
        Index(rows).save(path, f"part-{part}")
        yield pa.record_batch([pa.array([part], pa.int32())], ["part"])

    return path, items.repartition(parts).mapInArrow(build, "part int").count()


def _parts(path: str, parts: int) -> list[Index]:
    if ("parts", path) not in _kept:
        _kept.pop(_kept.pop("last", None), None)
        _kept["parts", path], _kept["last"] = [Index.load(path, f"part-{k}") for k in range(parts)], ("parts", path)
    return _kept["parts", path]


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, edits, pieces, start, end: each item that a document leaks, with its best piece's place in characters."""
    path, parts = indexed(benchmark)

    def run(batches):
        for b in C.sub_batches(batches):
            text, ids = C.text_bytes(C.column(b, "text")), C.column(b, "doc_id").to_pylist()
            found: dict = {}
            for k, index in enumerate(_parts(path, parts)):
                for r, p, e, s, t in zip(*(x.tolist() for x in index.leaks(*text))):
                    own = found.setdefault((r, index.owner[p]), [(e, s, t), set()])
                    own[0] = min(own[0], (e, s, t))
                    own[1].add((k, p))
            rows = [(ids[r], item, best[0], len(seen), best[1], best[2]) for (r, item), (best, seen) in found.items()]
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32()]
            yield pa.record_batch([pa.array([x[k] for x in rows], kind) for k, kind in enumerate(kinds)], ["doc_id", "item_id", "edits", "pieces", "start", "end"])

    return C.texts(docs).mapInArrow(C.tidy(run), SCHEMA)


def filter_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that leak no item, all columns as they were."""
    path, parts = indexed(benchmark)

    @F.arrow_udf("boolean")
    def clean(text: pa.Array) -> pa.Array:
        out = []
        for b in C.sub_batches([pa.record_batch([text], ["text"])]):
            ok, data = np.ones(b.num_rows, bool), C.text_bytes(b.column(0))
            for index in _parts(path, parts):
                ok[index.leaks(*data)[0]] = False
            out.append(ok)
        C.release()
        return pa.array(np.concatenate(out) if out else np.zeros(0, bool))

    return docs.where(clean(docs["text"]))


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(C.read(spark, sf_dir, "documents"), C.read(spark, sf_dir, "benchmark"))
