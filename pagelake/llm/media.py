"""MPEG audio columns: tags, frames, variable-bitrate tables, checksums, exact durations and seek offsets.

``parse`` reads one stream. Tags (ID3v2 at the start, APEv2 and ID3v1 at the end) are read and left
out; between them frames are followed from header to header. A header counts only if it is valid and the
next one, where the frame ends, is of the same version, layer and sampling rate (or the audio ends
there); where that fails, the search goes on byte by byte (resynchronisation), and what it passes over is
counted. A frame cut off by the end isn't counted. The first frame's Xing, Info or VBRI table is read and carries no audio. Checksums
(CRC-16 of the header's second half and the side information or bit allocation) are verified in all three layers.
Durations are exact: samples over the sampling rate, less the encoder's delay and padding where a table names them.

The driver's tables hold no audio, so ``mux`` lays every document's bytes into the frames of a stream
of its own, of varying versions, layers, rates, tags, tables, checksums and damage; ``op2`` parses these.

Defined results: null content has null columns; empty content or content without a frame has no frames
and duration 0; damaged or cut tags are taken as far as they go; repeated rows are parsed alike; extra
columns are ignored; an empty table gives an empty one. doc_id is a whole number (or a string of one); very long content is read whole, as one row of work arrays of about 30 bytes a byte of content;
rows of equal content have equal results, also under one id.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import common as C

#: kbit/s by (MPEG-1?, layer).
RATES = {
    (True, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (True, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (True, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (False, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (False, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (False, 3): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
SAMPLING = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}
VERSIONS = {3: "1", 2: "2", 0: "2.5"}
#: Bits of allocation by subband in layer II, for each of its tables.
ALLOCATION = {"a": (4,) * 11 + (3,) * 12 + (2,) * 4, "b": (4,) * 11 + (3,) * 12 + (2,) * 7, "c": (4, 4) + (3,) * 6, "d": (4, 4) + (3,) * 10, "lsf": (4,) * 4 + (3,) * 7 + (2,) * 19}
TEXT_FRAMES = {"TIT2": "title", "TT2": "title", "TPE1": "artist", "TP1": "artist", "TALB": "album", "TAL": "album", "TYER": "year", "TYE": "year", "TDRC": "year", "TRCK": "track", "TRK": "track", "TCON": "genre", "TCO": "genre"}
APE_ITEMS = {"title": "title", "artist": "artist", "album": "album", "year": "year", "track": "track", "genre": "genre"}
TAGS = ("title", "artist", "album", "year", "track", "genre")


def _crc_table() -> tuple[int, ...]:
    out = []
    for byte in range(256):
        v = byte << 8
        for _ in range(8):
            v = ((v << 1) ^ 0x8005) & 0xFFFF if v & 0x8000 else v << 1
        out.append(v)
    return tuple(out)


CRC = _crc_table()


def crc16(data: bytes, bits: int | None = None, start: int = 0xFFFF) -> int:
    """CRC-16 of the first ``bits`` bits."""
    v, whole = start, len(data) if bits is None else bits // 8
    for byte in data[:whole]:
        v = ((v << 8) & 0xFFFF) ^ CRC[(v >> 8) ^ byte]
    for k in range(0 if bits is None else bits % 8):
        v = ((v << 1) ^ 0x8005 if ((v >> 15) ^ (data[whole] >> (7 - k))) & 1 else v << 1) & 0xFFFF
    return v


@dataclass(frozen=True, slots=True)
class Header:
    version: int  # 3: MPEG-1, 2: MPEG-2, 0: MPEG-2.5
    layer: int
    protected: bool
    rate: int  # bit/s, 0: free
    sampling: int
    padding: int
    mode: int
    extension: int

    @property
    def samples(self) -> int:
        return 384 if self.layer == 1 else 1152 if self.layer == 2 or self.version == 3 else 576

    @property
    def side(self) -> int:
        """Bytes of layer III's side information."""
        return (17 if self.mode == 3 else 32) if self.version == 3 else (9 if self.mode == 3 else 17)

    def size(self, free: int = 0) -> int:
        """The frame's bytes; ``free``: those of an unpadded frame of free rate."""
        if self.layer == 1:
            return free + 4 * self.padding if not self.rate else (12 * self.rate // self.sampling + self.padding) * 4
        return free + self.padding if not self.rate else self.samples // 8 * self.rate // self.sampling + self.padding


_headers: dict[int, Header | None] = {}


def header(data: bytes, at: int) -> Header | None:
    """The valid header at a place, if there is one."""
    if at + 4 > len(data) or data[at] != 0xFF or data[at + 1] & 0xE0 != 0xE0:
        return None
    word = int.from_bytes(data[at + 1 : at + 4], "big") & 0xFFFFF3  # without the private, copyright and original bits' effect
    if word not in _headers:
        version, layer = word >> 19 & 3, 4 - (word >> 17 & 3)
        rate, sampling = word >> 12 & 15, word >> 10 & 3
        if version == 1 or layer == 4 or rate == 15 or sampling == 3 or word & 3 == 2:
            _headers[word] = None
        else:
            _headers[word] = Header(version, layer, not word >> 16 & 1, RATES[version == 3, layer][rate] * 1000, SAMPLING[version][sampling], word >> 9 & 1, word >> 6 & 3, word >> 4 & 3)
    return _headers[word]


def alike(a: Header, b: Header | None) -> bool:
    return b is not None and (a.version, a.layer, a.sampling, not a.rate) == (b.version, b.layer, b.sampling, not b.rate)


def allocation_bits(h: Header, frame: bytes) -> int | None:
    """Bits after the checksum that it covers; None if the frame is too short for them."""
    if h.layer == 3:
        return 8 * h.side
    channels, bound = (1, 32) if h.mode == 3 else (2, 4 * (h.extension + 1) if h.mode == 1 else 32)
    if h.layer == 1:
        return 4 * (channels * bound + 32 - bound)
    if h.version != 3:
        table = ALLOCATION["lsf"]
    else:
        rate = h.rate // 1000 // channels
        if (h.sampling == 48000 and (rate >= 56 or not rate)) or 56 <= rate <= 80:
            table = ALLOCATION["a"]
        elif rate >= 96 or not rate:
            table = ALLOCATION["b"]
        else:
            table = ALLOCATION["d" if h.sampling == 32000 else "c"]
    body = int.from_bytes(frame[6:70], "big")
    left = 8 * len(frame[6:70])
    used = scfsi = 0
    for band, bits in enumerate(table):
        for _ in range(channels if band < bound else 1):
            left -= bits
            if left < 0:
                return None
            used += bits
            if body >> left & ((1 << bits) - 1):
                scfsi += 2 * (1 if band < bound else channels)
    return used + scfsi


def checksum(h: Header, frame: bytes) -> bool | None:
    """Whether a protected frame's checksum is right; None for a frame too short to tell."""
    bits = allocation_bits(h, frame)
    if bits is None or len(frame) < 6 + -(-bits // 8):
        return None
    return crc16(frame[6:], bits, crc16(frame[2:4])) == int.from_bytes(frame[4:6], "big")


def _syncsafe(b: bytes) -> int:
    return (b[0] & 127) << 21 | (b[1] & 127) << 14 | (b[2] & 127) << 7 | b[3] & 127


def _text(raw: bytes) -> str:
    if not raw:
        return ""
    coding = {0: "latin-1", 1: "utf-16", 2: "utf-16-be", 3: "utf-8"}.get(raw[0], "latin-1")
    return raw[1:].decode(coding, "replace").split("\0")[0].strip()


def id3v2(data: bytes) -> tuple[dict[str, str], int]:
    """The text frames of the tag that data starts with, and the tag's bytes."""
    if len(data) < 10 or data[:3] != b"ID3" or data[3] == 255:
        return {}, 0
    version, flags, size = data[3], data[5], _syncsafe(data[6:10])
    end = 10 + size
    body = data[10:end]
    if flags & 128 and version < 4:
        body = body.replace(b"\xff\x00", b"\xff")
    at = 0
    if flags & 64 and version > 2 and len(body) >= 4:  # an extended header
        at = _syncsafe(body[:4]) if version == 4 else 4 + int.from_bytes(body[:4], "big")
    name, head = (3, 6) if version == 2 else (4, 10)
    out: dict[str, str] = {}
    while at + head <= len(body) and body[at]:
        key = body[at : at + name].decode("latin-1")
        raw = body[at + name : at + name + (3 if version == 2 else 4)]
        n = _syncsafe(raw) if version == 4 else int.from_bytes(raw, "big")
        value = body[at + head : at + head + n]
        if version == 4 and flags & 128:
            value = value.replace(b"\xff\x00", b"\xff")
        if key in TEXT_FRAMES:
            out.setdefault(TEXT_FRAMES[key], _text(value))
        at += head + n
    return out, min(len(data), end + (10 if flags & 16 and version == 4 else 0))


def id3v1(data: bytes) -> dict[str, str]:
    """The fixed tag of the last 128 bytes."""
    tag = data[-128:]
    if len(tag) < 128 or tag[:3] != b"TAG":
        return {}
    read = lambda a, b: tag[a:b].split(b"\0")[0].decode("latin-1").strip()
    out = {"title": read(3, 33), "artist": read(33, 63), "album": read(63, 93), "year": read(93, 97)}
    if not tag[125] and tag[126]:
        out["track"] = str(tag[126])
    if tag[127] != 255:
        out["genre"] = str(tag[127])
    return {k: v for k, v in out.items() if v}


def ape(data: bytes) -> tuple[dict[str, str], int]:
    """The items of the APEv2 tag that data ends with, and the tag's bytes."""
    foot = data[-32:]
    if len(foot) < 32 or foot[:8] != b"APETAGEX":
        return {}, 0
    size, count, flags = (int.from_bytes(foot[a : a + 4], "little") for a in (12, 16, 20))
    if size < 32 or size > len(data):
        return {}, 0
    body, at, out = data[len(data) - size : len(data) - 32], 0, {}
    for _ in range(count):
        if at + 9 > len(body) or (stop := body.find(b"\0", at + 8)) < 0:
            break
        n = int.from_bytes(body[at : at + 4], "little")
        key = body[at + 8 : stop].decode("latin-1").lower()
        if key in APE_ITEMS:
            out.setdefault(APE_ITEMS[key], body[stop + 1 : stop + 1 + n].decode("utf-8", "replace").split("\0")[0])
        at = stop + 1 + n
    return out, min(len(data), size + (32 if flags >> 31 else 0))


@dataclass
class Stream:
    version: str | None = None
    layer: int | None = None
    sampling: int | None = None
    channels: int | None = None
    frames: int = 0
    samples: int = 0
    duration: float = 0.0
    bitrate: int | None = None  # mean, bit/s
    variable: bool = False
    table: str | None = None
    table_frames: int | None = None
    table_bytes: int | None = None
    toc: list[int] = field(default_factory=list)
    delay: int = 0
    padding: int = 0
    resyncs: int = 0
    skipped: int = 0
    crc_good: int = 0
    crc_bad: int = 0
    tags: dict[str, str] = field(default_factory=dict)
    offsets: list[int] = field(default_factory=list)


def _vbr_table(data: bytes, at: int, h: Header, size: int, out: Stream) -> bool:
    """Reads a Xing, Info or VBRI table from the frame; whether there is one."""
    frame = data[at : at + size]
    place = 4 + h.side + (2 if h.protected else 0)
    for here in (place, 4 + h.side):
        name = frame[here : here + 4]
        if h.layer == 3 and name in (b"Xing", b"Info"):
            flags, k = int.from_bytes(frame[here + 4 : here + 8], "big"), here + 8
            if flags & 1:
                out.table_frames, k = int.from_bytes(frame[k : k + 4], "big"), k + 4
            if flags & 2:
                out.table_bytes, k = int.from_bytes(frame[k : k + 4], "big"), k + 4
            if flags & 4:
                out.toc, k = list(frame[k : k + 100]), k + 100
            k += 4 * bool(flags & 8)
            if frame[k : k + 4] in (b"LAME", b"Lavf", b"Lavc") and len(frame) >= k + 24:
                out.delay, out.padding = frame[k + 21] << 4 | frame[k + 22] >> 4, (frame[k + 22] & 15) << 8 | frame[k + 23]
            out.table = name.decode()
            return True
    if h.layer == 3 and frame[36:40] == b"VBRI" and len(frame) >= 62:
        out.table = "VBRI"
        out.table_bytes, out.table_frames = int.from_bytes(frame[46:50], "big"), int.from_bytes(frame[50:54], "big")
        entries, scale, width, _ = (int.from_bytes(frame[a : a + 2], "big") for a in (54, 56, 58, 60))
        raw = frame[62 : 62 + entries * width]
        out.toc = [scale * int.from_bytes(raw[a : a + width], "big") for a in range(0, len(raw) - width + 1, width)] if width else []
        return True
    return False


def _free_size(data: bytes, at: int, h: Header, end: int) -> int:
    """An unpadded frame's bytes in a stream of free rate: the way to the next header like this one; 0 if there is none."""
    step = 4 if h.layer == 1 else 1
    k = at + 24
    while (k := data.find(b"\xff", k, end - 3)) >= 0:
        other = header(data, k)
        if alike(h, other):
            size = k - at - step * h.padding
            after = k + size + step * other.padding
            if after == end or alike(h, header(data, after)):
                return size
        k += 1
    return 0


def parse(data: bytes) -> Stream:
    out = Stream()
    first, begin = id3v2(data)
    last1 = id3v1(data)
    end = len(data) - (128 if last1 or data[-128:-125] == b"TAG" and len(data) >= 128 else 0)
    middle, n = ape(data[:end])
    end = max(begin, end - n)
    out.tags = last1 | middle | first
    at, kind, free, lost = begin, None, 0, False
    seconds: dict[int, int] = {}
    rates, total = set(), 0
    while at + 4 <= end:
        h = header(data, at)
        size = 0
        if h is not None and (kind is None or alike(kind, h)):
            if not h.rate and not free:
                free = _free_size(data, at, h, end)
            size = h.size(free) if h.rate or free else 0
        good = size > 4 and at + size <= end
        if good and at + size < end and not alike(h, header(data, at + size)):
            # a frame that runs right up to damage counts if it follows another without a gap
            good = kind is not None and not lost
        if not good:
            following = data.find(b"\xff", at + 1, end)
            following = end if following < 0 else following
            if not lost and out.frames:
                out.resyncs += 1
            lost = True
            out.skipped += following - at
            at = following
            continue
        if kind is None:
            kind = h
            out.version, out.layer, out.sampling, out.channels = VERSIONS[h.version], h.layer, h.sampling, 1 if h.mode == 3 else 2
            if _vbr_table(data, at, h, size, out):
                at, lost = at + size, False
                continue
        lost = False
        if h.protected:
            ok = checksum(h, data[at : at + size])
            out.crc_good += ok is True
            out.crc_bad += ok is False
        out.offsets.append(at)
        out.frames += 1
        seconds[h.sampling] = seconds.get(h.sampling, 0) + h.samples
        rates.add(h.rate)
        total += size
        at += size
    out.skipped += max(0, end - at)
    out.samples = max(0, sum(seconds.values()) - out.delay - out.padding)
    if out.frames:
        out.duration = out.samples / kind.sampling
        out.bitrate = round(total * 8 * kind.sampling / sum(seconds.values()))
    out.variable = len(rates) > 1
    return out


def mux(payload: bytes, key: int) -> bytes:
    """A stream whose frames carry the payload; what kind, tags, tables and damage it has follows from the key."""
    layer = (3, 3, 3, 2, 1, 3, 2, 3)[key % 8]
    version = (3, 2, 3, 0)[key // 8 % 4] if layer == 3 else (3, 2)[key // 8 % 2]
    mode, sampling, protect, variable = (0, 1, 3)[key // 3 % 3], key // 5 % 3, key % 3 == 0, key % 4 == 1
    steps = (9, 11, 7, 10) if variable else (9,)
    parts, number, place = [], 0, 0

    def frame(step: int, body: bytes) -> tuple[bytes, int]:
        word = 0xFFE00000 | version << 19 | (4 - layer) << 17 | (not protect) << 16 | step << 12 | sampling << 10 | (number % 2) << 9 | mode << 6 | (key % 4) << 4
        raw = word.to_bytes(4, "big")
        h = header(raw, 0)
        room = h.size() - (6 if protect else 4)
        taken = body[:room]
        whole = bytearray(raw + (b"\0\0" if protect else b"") + taken + bytes(room - len(taken)))
        if protect:
            bits = allocation_bits(h, bytes(whole))
            if bits is not None:
                whole[4:6] = crc16(bytes(whole[6:]), bits, crc16(bytes(whole[2:4]))).to_bytes(2, "big")
        return bytes(whole), room

    if key % 2:
        title = f"document {key}".encode()
        text = b"TIT2" + (len(title) + 1).to_bytes(4, "big") + b"\0\0\x03" + title + b"TPE1\0\0\0\x05\0\0\0mpeg"
        n = len(text) + 16
        parts.append(b"ID3\x03\0\0" + bytes([n >> 21 & 127, n >> 14 & 127, n >> 7 & 127, n & 127]) + text + bytes(16))
    frames = []
    while place < len(payload):
        whole, room = frame(steps[number % len(steps)], payload[place:])
        place += room
        number += 1
        if protect and number % 11 == 5:
            whole = whole[:4] + bytes([whole[4] ^ 0xFF]) + whole[5:]  # a wrong checksum
        frames.append(whole)
        if number % 13 == 7 and key % 5 == 2:
            frames.append(b"damage\xff\xfa" * (1 + key % 3))
    if variable and layer == 3 and frames:
        count, size = number, sum(map(len, frames))
        toc = bytes(min(255, 256 * k // 100) for k in range(100))
        body = b"\0" * ((17 if mode == 3 else 32) if version == 3 else (9 if mode == 3 else 17)) + b"Xing\0\0\0\x07" + count.to_bytes(4, "big") + size.to_bytes(4, "big") + toc
        parts.append(frame(9, body)[0])
    parts += frames
    if key % 7 == 3:
        item = b"Album"
        value = f"shelf {key % 100}".encode()
        body = len(value).to_bytes(4, "little") + bytes(4) + item + b"\0" + value
        parts.append(body + b"APETAGEX" + (2000).to_bytes(4, "little") + (len(body) + 32).to_bytes(4, "little") + (1).to_bytes(4, "little") + bytes(12))
    if key % 3 == 1:
        parts.append(b"TAG" + f"document {key}".encode()[:30].ljust(30, b"\0") + bytes(60) + b"2024" + bytes(28) + bytes([0, key % 255, 12]))
    return b"".join(parts)


FIELDS = [
    ("version", pa.string()), ("layer", pa.int32()), ("sampling", pa.int32()), ("channels", pa.int32()), ("frames", pa.int32()), ("samples", pa.int64()), ("duration", pa.float64()),
    ("bitrate", pa.int32()), ("variable", pa.bool_()), ("table", pa.string()), ("table_frames", pa.int64()), ("table_bytes", pa.int64()), ("toc", pa.list_(pa.int64())), ("delay", pa.int32()), ("padding", pa.int32()),
    ("resyncs", pa.int32()), ("skipped", pa.int64()), ("crc_good", pa.int32()), ("crc_bad", pa.int32()), ("offsets", pa.list_(pa.int64())),
]
SCHEMA = (
    "doc_id long, version string, layer int, sampling int, channels int, frames int, samples long, duration double, bitrate int, variable boolean, `table` string, table_frames long, "
    "table_bytes long, toc array<long>, delay int, padding int, resyncs int, skipped long, crc_good int, crc_bad int, offsets array<long>, " + ", ".join(f"{t} string" for t in TAGS)
)


def _rows(ids: pa.Array, contents) -> pa.RecordBatch:
    streams = [None if c is None else parse(c) for c in contents]
    columns = [pa.array([None if s is None else getattr(s, name) for s in streams], kind) for name, kind in FIELDS]
    tags = [pa.array([None if s is None else s.tags.get(t) for s in streams], pa.string()) for t in TAGS]
    return pa.record_batch([ids, *columns, *tags], ["doc_id", *[f[0] for f in FIELDS], *TAGS])


def describe(audio: DataFrame) -> DataFrame:
    """What ``parse`` finds in every row's content (binary), by doc_id."""

    def run(batches):
        for b in C.sub_batches(batches, "content"):
            yield _rows(C.column(b, "doc_id"), C.column(b, "content").to_pylist())

    return audio.select("doc_id", "content").mapInArrow(C.tidy(run), SCHEMA)


def carried(docs: DataFrame) -> DataFrame:
    """doc_id and content: a stream that carries the document's bytes."""

    def run(batches):
        for b in C.sub_batches(batches):
            pairs = zip(C.column(b, "doc_id").to_pylist(), C.column(b, "text").to_pylist())
            yield pa.record_batch([C.column(b, "doc_id"), pa.array([None if t is None else mux(t.encode(), i or 0) for i, t in pairs], pa.binary())], ["doc_id", "content"])

    return C.texts(docs).mapInArrow(C.tidy(run), "doc_id long, content binary")


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return describe(carried(C.read(spark, sf_dir, "documents")))
