"""BPE, Huffman coding, decontamination and audio against other implementations and plain versions."""

import base64
import random

import cases
import numpy as np
import pyarrow as pa
import pytest

from pagelake.llm import bpe, decontam, huffman, media
from pagelake.llm import common as C

PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
ODD = ["'", "'s", "re", "ll", "ve", "d", "t", " ", "  ", "\n", "\t", "a", "é", "漢", "1", "²", "!", "—", "😀", "m", "don't", "ABC", "　", "\x85", "0", "x" * 60, "ing", "é"]


@pytest.fixture(scope="module")
def other():
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in open(bpe.VOCABULARY, "rb"))}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_against_another_encoder(other):
    import regex

    rng = random.Random(1)
    texts = ["".join(rng.choice(ODD) for _ in range(rng.randint(0, 30))) for _ in range(1500)] + ["", "a" * 500, "!" * 300, " " * 200, "  x", "x \n"]
    for _ in range(2):  # the second time from the cache
        ids, n, slices, m, exact = bpe.encoded(pa.array(texts), bpe.vocabulary())
        at, cut = np.concatenate([[0], np.cumsum(n)]), np.concatenate([[0], np.cumsum(m)])
        for k, t in enumerate(texts):
            assert ids[at[k] : at[k + 1]].tolist() == other.encode_ordinary(t)
            assert slices[cut[k] : cut[k + 1]].tolist() == [len(t[: x.start()].encode()) for x in regex.finditer(PATTERN, t)]
        assert exact.all()


def test_scan_against_a_loop():
    rng = np.random.default_rng(4)
    for n in (0, 1, 63, 64, 65, 1000, 5000):
        symbols = rng.integers(0, 7, n).astype(np.uint8)
        state, want = bpe.DONE, []
        for s in symbols:
            want.append(state)
            state = bpe.GO[int(s) * 8 + state]
        assert bpe.scan(symbols).tolist() == want


def test_merge_long_is_the_same_as_bulk():
    v, rng = bpe.vocabulary(), random.Random(6)
    words = ["".join(rng.choice(["the", "ing", "a", "é", "q"]) for _ in range(rng.randint(1, 9))).encode() for _ in range(300)]
    data, off = C.text_bytes(pa.array(words, pa.binary()))
    ids, n = v.merge(data, off[:-1], np.diff(off))
    at = np.concatenate([[0], np.cumsum(n)])
    assert all(ids[at[k] : at[k + 1]].tolist() == v.merge_long(w) for k, w in enumerate(words))


def test_bpe_rows(spark, other):
    rows = cases.nasty()
    got = bpe.encode(cases.frame(spark, rows))
    back = sorted((r.doc_id or -1, r.text or "", r.text is None) for r in bpe.decode(got).collect())
    assert back == sorted((r[0] or -1, r[1] or "", r[1] is None) for r in rows)
    for r in got.collect():
        assert (r.ids is None) == (r.exact is None) == (r.n_tokens is None) == (r.slices is None) and r.exact in (True, None)
    assert bpe.encode(cases.frame(spark, [])).count() == 0


def plain_lengths_cost(counts, most):
    items = sorted((w, (k,)) for k, w in enumerate(counts) if w)
    row = items
    for _ in range(most - 1):
        pairs = [(row[k][0] + row[k + 1][0], row[k][1] + row[k + 1][1]) for k in range(0, len(row) - 1, 2)]
        row = sorted(items + pairs, key=lambda x: x[0])
    return sum(w for w, _ in row[: 2 * len(items) - 2])


def test_huffman_lengths_are_optimal():
    rng = np.random.default_rng(0)
    for _ in range(200):
        counts = rng.integers(0, int(rng.choice([3, 50, 100_000])), rng.integers(2, 30))
        if (counts > 0).sum() < 2:
            continue
        most = int(rng.integers(5, 12))
        bits = huffman.lengths(counts, most)
        assert bits.max() <= most and sum(2.0 ** -int(b) for b in bits if b) == 1
        assert (bits.astype(int) * counts).sum() == plain_lengths_cost(counts, most)
    assert huffman.lengths(np.array([0, 7, 0])).tolist() == [0, 1, 0] and not huffman.lengths(np.zeros(3, int)).any()
    with pytest.raises(ValueError):
        huffman.lengths(np.ones(9), 3)


def test_huffman_canonical():
    code = huffman.Code(huffman.lengths(np.array([50, 1, 9, 9, 20, 0])))
    pairs = sorted((int(n), int(c)) for n, c in zip(code.bits, code.codes) if n)
    last = 0
    for k, (n, c) in enumerate(pairs):
        last = 0 if k == 0 else (last + 1) << (n - pairs[k - 1][0])
        assert c == last
    with pytest.raises(ValueError):
        code.encode(np.array([5]), np.array([1]))


def test_huffman_round_trip(spark):
    rows = cases.nasty()
    frame = cases.frame(spark, rows)
    packed = huffman.pack(frame)
    code = huffman.fit(packed)
    coded = huffman.encode(packed, code)
    for r in coded.collect():
        assert r.exact in (True, None) and (r.bits is None) == (r.n_tokens is None or r.exact is None)
        if r.bits is not None:
            assert len(r.bits) == -(-r.n_bits // 8) and len(r.checkpoints) == -(-r.n_tokens // huffman.BLOCK) and r.checkpoints == sorted(r.checkpoints)
    want = sorted((r.doc_id or -1, repr(r.ids)) for r in bpe.encode(frame).collect())
    assert sorted((r.doc_id or -1, repr(r.ids)) for r in huffman.decode(coded, code).collect()) == want
    empty = huffman.pack(cases.frame(spark, []))
    assert huffman.encode(empty, huffman.fit(empty)).count() == 0


def test_leaks_against_every_alignment():
    rng = random.Random(3)

    def edit(s, k):
        s = list(s)
        for _ in range(k):
            i, o = rng.randrange(len(s)), rng.random()
            if o < 0.4:
                s[i] = rng.choice("abcxyz")
            elif o < 0.7:
                s.insert(i, rng.choice("abc"))
            elif len(s) > 1:
                del s[i]
        return "".join(s)

    items = [(i, cases.prose(rng, rng.randint(1, 14))) for i in range(8)] + [(None, "null item id of some length"), (9, None), (10, "short")]
    index = decontam.Index(items)
    docs = [cases.prose(rng, rng.randint(1, 12)) + " " + edit(t := items[rng.randrange(8)][1], rng.randint(0, max(1, len(t) // 7))) + " " + cases.prose(rng, rng.randint(1, 8)) for _ in range(60)] + ["", "a", None, items[0][1].upper().replace(" ", "\n")]
    row, piece, edits, start, end = index.leaks(*C.text_bytes(pa.array(docs)))
    got: dict = {}
    for r, p, e in zip(row.tolist(), piece.tolist(), edits.tolist()):
        got[r, p] = min(got.get((r, p), 99), e)
    fold = lambda s: "".join(chr(decontam._folds()[ord(c)]) for c in s)
    want = {}
    for r, d in enumerate(docs):
        for p, code in enumerate(index.codes):
            e = cases.fitted_edits("".join(map(chr, code)), fold(d or ""))
            if e <= index.edits[p]:
                want[r, p] = e
    assert got == want and len(want) > 30
    for r, p, e, s, t in zip(row, piece, edits, start, end):
        assert cases.fitted_edits("".join(map(chr, index.codes[p])), fold(docs[r])[s:t]) == e


def test_leak_rows_and_filter(spark):
    rng = random.Random(5)
    items = tuple(cases.prose(rng, 30) for _ in range(3))
    rows = cases.nasty(items=items)
    frame = cases.frame(spark, rows)
    bench = spark.createDataFrame([(k, t) for k, t in enumerate(items)] + [(None, None), (7, ""), (8, "short")], "item_id long, text string")
    got = {(r.doc_id, r.item_id, r.edits) for r in decontam.leaks(frame, bench).collect()}
    assert got == {(600 + k, k, 0) for k in range(3)}
    kept = decontam.filter_leaks(frame, bench)
    assert kept.columns == frame.columns and kept.count() == len(rows) - 3
    none = bench.limit(0)
    assert decontam.leaks(frame, none).count() == 0 and decontam.filter_leaks(frame, none).count() == len(rows)
    assert decontam.leaks(cases.frame(spark, []), bench).count() == 0


@pytest.mark.parametrize("key", range(0, 240, 7))
def test_audio_round_trip(key):
    rng = random.Random(key)
    payload = bytes(rng.randrange(97, 123) for _ in range(rng.choice([0, 1, 50, 400, 6000])))
    data = media.mux(payload, key)
    s = media.parse(data)
    protected = key % 3 == 0
    carried = b"".join(data[o + (6 if protected else 4) : o + media.header(data, o).size()] for o in s.offsets)
    assert carried[: len(payload)] == payload and not carried[len(payload) :].strip(b"\0")
    assert s.crc_bad == (sum(k % 11 == 5 for k in range(1, s.frames + 1)) if protected else 0) and (not protected or s.crc_good + s.crc_bad == s.frames)
    assert s.samples == sum(media.header(data, o).samples for o in s.offsets) and s.duration == (s.samples / s.sampling if s.frames else 0)
    assert not s.table or (s.table_frames == s.frames and len(s.toc) == 100)
    if payload and key % 2:
        assert s.tags["title"] == f"document {key}" and s.tags["artist"] == "mpeg"


def frame_of(word, body=b""):
    h = media.header(word, 0)
    return word + body + bytes(h.size() - 4 - len(body))


def test_audio_by_hand():
    plain = frame_of(b"\xff\xfb\x90\x00")
    assert len(plain) == 417
    s = media.parse(plain * 5)
    assert (s.frames, s.samples, s.resyncs, s.skipped, s.bitrate, s.channels) == (5, 5 * 1152, 0, 0, round(417 * 8 * 44100 / 1152), 2)
    s = media.parse(plain * 3 + b"junk\xff\xfb" + plain * 3 + plain[:100])  # damage, and a frame cut off
    assert (s.frames, s.resyncs, s.skipped) == (6, 2, 106)
    lame = frame_of(b"\xff\xfb\x90\x00", bytes(32) + b"Info\0\0\0\x03" + (5).to_bytes(4, "big") + (2502).to_bytes(4, "big") + b"LAME3.100" + bytes(12) + bytes([576 >> 4, (576 & 15) << 4 | 1000 >> 8, 1000 & 255]))
    s = media.parse(lame + plain * 5)
    assert (s.table, s.table_frames, s.table_bytes, s.delay, s.padding, s.samples) == ("Info", 5, 2502, 576, 1000, 5 * 1152 - 1576)
    vbri = frame_of(b"\xff\xfb\x90\x00", bytes(32) + b"VBRI" + bytes(6) + (834).to_bytes(4, "big") + (2).to_bytes(4, "big") + bytes([0, 2, 0, 1, 0, 2, 0, 1]) + b"\x01\xa1\x01\xa1")
    s = media.parse(vbri + plain * 2)
    assert (s.table, s.table_frames, s.toc) == ("VBRI", 2, [417, 417])
    free = b"\xff\xfb\x00\x00" + bytes(296)
    s = media.parse(free * 4)
    assert (s.frames, s.skipped) == (4, 0)


def test_audio_tags():
    title = "\x01".encode() + "Título".encode("utf-16")
    tag = b"TIT2" + bytes([0, 0, 0, len(title)]) + b"\0\0" + title
    s = media.parse(b"ID3\x04\0\0" + bytes([0, 0, 0, len(tag)]) + tag + frame_of(b"\xff\xfb\x90\x00") * 2 + b"TAG" + b"Old".ljust(30, b"\0") + b"Me".ljust(30, b"\0") + bytes(30) + b"1999" + bytes(28) + bytes([0, 3, 17]))
    assert s.tags == {"title": "Título", "artist": "Me", "year": "1999", "track": "3", "genre": "17"} and s.frames == 2
    for cut in range(0, 60, 7):  # tags cut short
        media.parse((b"ID3\x03\0\0\0\0\x02\x01" + tag)[:cut])


def test_crc_bit_by_bit():
    rng = random.Random(1)
    for _ in range(50):
        data, bits = bytes(rng.randrange(256) for _ in range(9)), rng.randrange(1, 65)
        v = 0xFFFF
        for k in range(bits):
            top = v >> 15 ^ data[k // 8] >> (7 - k % 8) & 1
            v = (v << 1 ^ (0x8005 if top & 1 else 0)) & 0xFFFF
        assert media.crc16(data, bits) == v


def test_audio_noise_and_rows(spark):
    rng = random.Random(2)
    for _ in range(300):
        media.parse(bytes(rng.choice([255, 251, 0x90, 0, 250, rng.randrange(256)]) for _ in range(rng.randint(0, 300))))
    rows = [(1, None, "x"), (2, b"", "x"), (3, media.mux(b"abc" * 900, 3), "x"), (None, b"\xff", "x")]
    got = {r.doc_id: r for r in media.describe(spark.createDataFrame(rows, "doc_id long, content binary, title string")).collect()}
    assert got[1].frames is None and got[2].frames == 0 and got[2].duration == 0 and got[3].frames > 3 and got[None].frames == 0
    carried = media.describe(media.carried(cases.frame(spark, cases.nasty())))
    assert carried.count() == len(cases.nasty()) and media.describe(media.carried(cases.frame(spark, []))).count() == 0
