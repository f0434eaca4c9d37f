"""Byte-level BPE: pre-tokenisation by codepoint classes and a transition scan, cached pair merging.

Each character's class comes from an array over all codepoints. The pre-tokeniser is an automaton of
eight states; a class is a function from state to state, and as functions compose associatively, the
state before every character is found by a scan: blocks of characters are composed side by side,
the blocks' functions are scanned by doubling, and the states are filled in from each block's entry
state. No regular expression is used. The slices are looked up in a direct-mapped cache of merged
slices that a Python worker keeps over its tasks; those it lacks are merged all at once, one lowest
pair a step, and long ones with a heap. The slices' byte offsets are kept beside the ids, so that any
slice decodes by itself.

The vocabulary is a public file of token bytes and ranks; its path is a parameter.

Defined results: a null text has null ids, slices and exact; an empty one has empty lists; every row
is encoded, repeated ones alike; extra columns are ignored; an empty table gives an empty one.
Doc_id is a whole number (or a string of one); very long texts are read whole, as one row of work arrays of about 30 bytes a byte of text,
up to 2 GB; pairs of equal rank are merged from the left; equal texts have equal ids, also under one doc_id.
"""

from __future__ import annotations

import base64
import heapq
import unicodedata
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import common as C

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
LETTER, NUMBER, OTHER, BLANK, SPACE, CUT1, CUT2 = range(7)
#: States: in letters, in numbers, in others, after white space, after a space, one letter of a contraction to come, two, contraction complete.
IN_L, IN_N, IN_O, IN_W, IN_S, ONE, TWO, DONE = range(8)
WHITE = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
STEP = 64
SLOTS, WIDTH, LONG = 1 << 19, 12, 48
NONE = np.int32(2**31 - 1)
SCHEMA = "doc_id long, n_tokens int, ids array<int>, slices array<int>, exact boolean"


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Next state and whether a token starts, by symbol * 8 + state; symbols from 8 on begin a row."""
    go, cut = np.zeros((16, 8), np.uint8), np.ones((16, 8), bool)
    go[LETTER] = [IN_L, IN_L, IN_L, IN_L, IN_L, DONE, ONE, IN_L]
    go[NUMBER], go[OTHER], go[BLANK], go[SPACE] = IN_N, IN_O, IN_W, IN_S
    go[CUT1], go[CUT2] = ONE, TWO
    go[CUT1, [IN_O, IN_S]] = go[CUT2, [IN_O, IN_S]] = IN_O
    cut[LETTER, [IN_L, IN_S, ONE, TWO]] = False
    cut[NUMBER, [IN_N, IN_S]] = False
    for s in (OTHER, CUT1, CUT2):
        cut[s, [IN_O, IN_S]] = False
    for s in (BLANK, SPACE):
        cut[s, [IN_W, IN_S]] = False
    for s in range(7):  # a row's first character: as after a complete token
        go[8 + s] = go[s, DONE]
    return go.ravel(), cut.ravel()


GO, CUT = _tables()
_kept: dict = {}


def classes() -> np.ndarray:
    """The class of every codepoint."""
    if "classes" not in _kept:
        kind = {"L": LETTER, "N": NUMBER}
        table = np.array([kind.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)], np.uint8)
        table[WHITE] = BLANK
        table[32] = SPACE
        _kept["classes"] = table
    return _kept["classes"]


def codepoints(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each character's codepoint and byte offset."""
    at = np.flatnonzero((data & 0xC0) != 0x80)
    code = data[at].astype(np.int32)
    high = np.flatnonzero(code >= 0x80)
    lead = code[high]
    for low, top, size in ((0xC0, 0xE0, 2), (0xE0, 0xF0, 3), (0xF0, 0x100, 4)):
        which = high[(lead >= low) & (lead < top)]
        which = which[at[which] + size <= len(data)]
        value = code[which] & (0x7F >> size)
        for k in range(1, size):
            value = (value << 6) | (data[at[which] + k] & 0x3F)
        code[which] = value
    return code, at


def scan(symbols: np.ndarray) -> np.ndarray:
    """The state before every symbol, by composing transition functions."""
    n = len(symbols)
    blocks = -(-n // STEP)
    padded = np.zeros(blocks * STEP, np.uint8)
    padded[:n] = symbols
    columns = np.ascontiguousarray(padded.reshape(blocks, STEP).T).astype(np.intp) * 8
    maps = np.broadcast_to(np.arange(8, dtype=np.uint8), (blocks, 8))
    for j in range(STEP):
        maps = GO[columns[j][:, None] + maps]
    maps, d = maps.astype(np.intp), 1
    while d < blocks:  # inclusive scan of the blocks' functions by doubling
        maps = np.concatenate([maps[:d], np.take_along_axis(maps[d:], maps[:-d], 1)])
        d *= 2
    state = np.full(blocks, DONE, np.uint8)
    state[1:] = maps[:-1, DONE]
    out = np.empty((STEP, blocks), np.uint8)
    for j in range(STEP):
        out[j] = state
        state = GO[columns[j] + state]
    return out.T.reshape(-1)[:n]


def pretokenise(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Byte offsets at which the slices of the texts start; empty texts have none."""
    if not len(data):
        return np.zeros(0, np.int64)
    code, at = codepoints(data)
    n = len(code)
    symbols = classes()[code]
    first = np.zeros(n, bool)
    first[np.searchsorted(at, off[:-1][np.diff(off) > 0])] = True
    near = np.zeros(n + 2, np.int32)
    near[:n] = code
    other_row = np.ones(n + 2, bool)
    other_row[:n] = first
    quote = np.flatnonzero(code == 39)
    a, b = near[quote + 1], near[quote + 2]
    within1, within2 = ~other_row[quote + 1], ~(other_row[quote + 1] | other_row[quote + 2])
    s, t, m, d, r, e, v, ll = map(ord, "stmdrevl")
    symbols[quote[within2 & (((a == r) & (b == e)) | ((a == v) & (b == e)) | ((a == ll) & (b == ll)))]] = CUT2
    symbols[quote[within1 & ((a == s) | (a == t) | (a == m) | (a == d))]] = CUT1
    white = (symbols == BLANK) | (symbols == SPACE)
    symbols[first] += 8
    starts = CUT[symbols.astype(np.intp) * 8 + scan(symbols)]
    # the last of several white characters goes to what follows it in the same text
    follows = np.zeros(n, bool)
    follows[:-1] = white[:-1] & ~white[1:] & ~first[1:]
    return at[starts | follows]


class Vocabulary:
    """Token bytes by id, and the ids that pairs of ids merge into."""

    def __init__(self, path: str):
        ranks = dict(map(bytes.split, Path(path).read_bytes().splitlines()))
        self.ranks = {base64.b64decode(token): int(rank) for token, rank in ranks.items()}
        size = max(self.ranks.values()) + 1
        tokens = [b""] * size
        for token, rank in self.ranks.items():
            tokens[rank] = token
        self.length = np.array([len(t) for t in tokens])
        self.start = np.cumsum(self.length) - self.length
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self.single = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        pairs = [(self.ranks[t[:k]], self.ranks[t[k:]], r) for t, r in self.ranks.items() for k in range(1, len(t)) if t[:k] in self.ranks and t[k:] in self.ranks]
        left, right, to = (np.array(x, np.int64) for x in zip(*pairs))
        self.levels = self._hashed(left << 20 | right, to.astype(np.int32))
        self.keys = np.zeros(SLOTS, np.uint64)
        self.count = np.zeros(SLOTS, np.uint8)
        self.cached = np.zeros(SLOTS * WIDTH, np.int32)

    @staticmethod
    def _slot(key: np.ndarray, level: int, bits: int) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(C.BASE + 2 * level)) >> np.uint64(64 - bits)).astype(np.intp)

    def _hashed(self, keys: np.ndarray, values: np.ndarray) -> list:
        levels, bits = [], 20
        while len(keys):
            table, to = np.full(1 << bits, -1, np.int64), np.full(1 << bits, NONE, np.int32)
            slot = self._slot(keys, len(levels), bits)
            _, once = np.unique(slot, return_index=True)
            table[slot[once]], to[slot[once]] = keys[once], values[once]
            rest = np.ones(len(keys), bool)
            rest[once] = False
            keys, values = keys[rest], values[rest]
            levels.append((bits, table, to))
            bits = max(bits - 2, 10)
        return levels

    def merged(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The id of each pair's concatenation, NONE where there is none or either id is negative."""
        key = left.astype(np.int64) << 20 | right.astype(np.int64)
        key[(left < 0) | (right < 0)] = -2
        out = np.full(key.shape, NONE, np.int32)
        for level, (bits, table, to) in enumerate(self.levels):
            slot = self._slot(key, level, bits)
            hit = table[slot] == key
            out[hit] = to[slot[hit]]
        return out

    def merge_long(self, piece: bytes) -> list[int]:
        """One slice: a heap of pairs over a linked list."""
        ids = [int(self.single[b]) for b in piece]
        n = len(ids)
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        text = [bytes([b]) for b in piece]
        heap = [(r, i, 2) for i in range(n - 1) if (r := self.ranks.get(text[i] + text[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, size = heapq.heappop(heap)
            if not alive[i] or (j := after[i]) >= n or len(text[i]) + len(text[j]) != size or self.ranks.get(text[i] + text[j]) != r:
                continue
            text[i], ids[i], alive[j], after[i] = text[i] + text[j], r, False, after[j]
            if after[i] < n:
                before[after[i]] = i
            for k in (before[i], i):
                if k >= 0 and after[k] < n and (r := self.ranks.get(text[k] + text[after[k]])) is not None:
                    heapq.heappush(heap, (r, k, len(text[k]) + len(text[after[k]])))
        return [x for x, a in zip(ids, alive) if a]

    def merge(self, data: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all slices in order, and how many each has."""
        m = len(start)
        count, parts = np.zeros(m, np.int64), []
        low = 0
        for high in (1, 4, 8, 12, 16, 24, LONG):
            which = np.flatnonzero((length > low) & (length <= high))
            low = high
            if len(which):
                ids = np.full((len(which), high), -1, np.int32)
                inside = np.arange(high) < length[which][:, None]
                ids[inside] = self.single[data[C.ragged(start[which], length[which])]]
                ids = self._lowest_first(ids)
                count[which] = (ids >= 0).sum(1)
                parts.append((which, ids))
        long = np.flatnonzero(length > LONG)
        slow = [self.merge_long(data[start[i] : start[i] + length[i]].tobytes()) for i in long]
        count[long] = [len(x) for x in slow]
        at = np.cumsum(count) - count
        out = np.empty(int(count.sum()), np.int32)
        for which, ids in parts:
            out[C.ragged(at[which], count[which])] = ids[ids >= 0]
        for i, x in zip(long, slow):
            out[at[i] : at[i] + len(x)] = x
        return out, count

    def _lowest_first(self, ids: np.ndarray) -> np.ndarray:
        width = ids.shape[1]
        if width == 1:
            return ids
        done, rows = ids, np.arange(len(ids))
        ranks = self.merged(ids[:, :-1], ids[:, 1:])
        column = np.arange(width)
        while True:
            p = ranks.argmin(1)
            best = ranks[np.arange(len(ids)), p]
            go = best < NONE
            if not go.all():
                done[rows[~go]] = ids[~go]
                ids, ranks, rows, p, best = ids[go], ranks[go], rows[go], p[go], best[go]
            if not len(ids):
                return done
            r = np.arange(len(ids))
            # the pair becomes one id, what lies behind it moves up
            move = np.minimum(column + (column > p[:, None]), width - 1)
            ids = np.take_along_axis(ids, move, 1)
            ids[:, -1] = -1
            ids[r, p] = best
            ranks = np.take_along_axis(ranks, np.minimum(move[:, :-1], width - 2), 1)
            ranks[:, -1] = NONE
            behind = np.minimum(p + 1, width - 1)
            here = self.merged(ids[r, p], np.where(behind > p, ids[r, behind], -1))
            ranks[r, np.minimum(p, width - 2)] = here
            left = np.flatnonzero(p > 0)
            ranks[left, p[left] - 1] = self.merged(ids[left, p[left] - 1], ids[left, p[left]])

    def encode(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all texts in order, the slices' byte offsets, and how many ids each slice has."""
        start = pretokenise(data, off)
        end = np.append(start[1:], len(data))
        key = C.hash_ranges(data, start, end) | np.uint64(1)
        slot = (key >> np.uint64(64 - 19)).astype(np.intp)
        count = self.count[slot].astype(np.int64)
        miss = np.flatnonzero(self.keys[slot] != key)
        _, once, back = np.unique(key[miss], return_index=True, return_inverse=True)
        new = miss[once]
        fresh, n = self.merge(data, start[new], end[new] - start[new])
        at = np.cumsum(n) - n
        count[miss] = n[back]
        place = np.cumsum(count) - count
        out = np.empty(int(count.sum()), np.int32)
        known = np.ones(len(start), bool)
        known[miss] = False
        known = np.flatnonzero(known)
        out[C.ragged(place[known], count[known])] = self.cached[C.ragged(slot[known] * WIDTH, count[known])]
        out[C.ragged(place[miss], count[miss])] = fresh[C.ragged(at[back], n[back])]
        _, one = np.unique(slot[new], return_index=True)  # of several new slices of a slot, one is kept
        keep = one[n[one] <= WIDTH]
        self.keys[slot[new[keep]]], self.count[slot[new[keep]]] = key[new[keep]], n[keep]
        self.cached[C.ragged(slot[new[keep]] * WIDTH, n[keep])] = fresh[C.ragged(at[keep], n[keep])]
        return out, start, count

    def decode(self, ids: np.ndarray) -> np.ndarray:
        return self.bytes[C.ragged(self.start[ids], self.length[ids])]


def vocabulary(path: str = VOCABULARY) -> Vocabulary:
    if path not in _kept:
        _kept[path] = Vocabulary(path)
    return _kept[path]


def encoded(text: pa.Array, vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ids, ids of each text, slices' offsets in their text, slices of each text, and whether each text decodes exactly."""
    data, off = C.text_bytes(text)
    ids, start, count = vocab.encode(data, off)
    edge = np.searchsorted(start, off)
    total = np.concatenate([[0], np.cumsum(count)])[edge]
    back = vocab.decode(ids)
    same = len(back) == len(data)
    wrong = np.flatnonzero(back != data) if same else np.zeros(0, np.int64)
    exact = np.full(len(text), same)
    exact[np.searchsorted(off, wrong, "right") - 1] = False
    return ids, np.diff(total), start - np.repeat(off[:-1], np.diff(edge)), np.diff(edge), exact


def encode(docs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """doc_id, n_tokens, ids, slices (their byte offsets) and exact (the ids decode to the text) of every document."""

    def run(batches):
        vocab = vocabulary(path)
        for b in C.sub_batches(batches):
            text = C.column(b, "text")
            ids, n, slices, m, exact = encoded(text, vocab)
            valid = np.asarray(text.is_valid())
            columns = [C.column(b, "doc_id"), pa.array(n.astype(np.int32), mask=~valid), C.list_array(ids, n, pa.int32(), valid), C.list_array(slices.astype(np.int32), m, pa.int32(), valid), pa.array(exact, mask=~valid)]
            yield pa.record_batch(columns, ["doc_id", "n_tokens", "ids", "slices", "exact"])

    return C.texts(docs).mapInArrow(C.tidy(run), SCHEMA)


def decode(tokens: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """doc_id and text of rows with doc_id and ids; null ids have a null text, ids of no whole character U+FFFD."""

    def run(batches):
        vocab = vocabulary(path)
        for b in batches:
            ids = C.column(b, "ids")
            text = [vocab.decode(np.asarray(x.values, np.int64)).tobytes().decode("utf-8", "replace") if x.is_valid else None for x in ids]
            yield pa.record_batch([C.column(b, "doc_id"), pa.array(text, pa.string())], ["doc_id", "text"])

    return tokens.select("doc_id", "ids").mapInArrow(C.tidy(run), "doc_id long, text string")


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(C.read(spark, sf_dir, "documents"))
