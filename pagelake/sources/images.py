"""Page images as arrays: decoding, colour modes, sizes and crops.

Pillow decodes where it is installed; PNG (8 bits a channel, not interlaced) and PNM files are read without it.
"""

from __future__ import annotations

import io
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

try:
    from PIL import Image
except ImportError:
    Image = None

PNG = b"\x89PNG\r\n\x1a\n"


def to_rgb(pixels: np.ndarray) -> np.ndarray:
    """Grey, grey with alpha, RGB or RGBA as RGB; alpha is left out."""
    if pixels.ndim == 2:
        pixels = pixels[:, :, None]
    if pixels.shape[2] in (2, 4):
        pixels = pixels[:, :, :-1]
    return np.ascontiguousarray(np.broadcast_to(pixels, (*pixels.shape[:2], 3)) if pixels.shape[2] == 1 else pixels[:, :, :3])


def _chunks(content: bytes):
    at = len(PNG)
    while at + 8 <= len(content):
        (size,) = struct.unpack(">I", content[at : at + 4])
        yield content[at + 4 : at + 8], content[at + 8 : at + 8 + size]
        at += 12 + size


def _png(content: bytes) -> np.ndarray:
    parts = list(_chunks(content))
    width, height, depth, kind, _, _, interlaced = struct.unpack(">IIBBBBB", dict(parts)[b"IHDR"])
    if depth != 8 or interlaced:
        raise ValueError("only PNG of eight bits a channel, not interlaced, is read without Pillow")
    channels = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[kind]
    raw = np.frombuffer(zlib.decompress(b"".join(d for k, d in parts if k == b"IDAT")), np.uint8).reshape(height, 1 + width * channels)
    out = np.zeros((height + 1, width + 1, channels), np.int32)  # a border of zeros above and to the left
    for y in range(height):
        row, above = raw[y, 1:].reshape(width, channels).astype(np.int32), out[y, 1:]
        match raw[y, 0]:
            case 0:
                line = row
            case 1:
                line = np.cumsum(row, 0) & 255
            case 2:
                line = (row + above) & 255
            case way:
                line = out[y + 1, 1:]
                for x in range(width):
                    left, up, corner = out[y + 1, x], out[y, x + 1], out[y, x]
                    if way == 3:
                        guess = (left + up) // 2
                    else:
                        p = left + up - corner
                        a, b, c = abs(p - left), abs(p - up), abs(p - corner)
                        guess = np.where((a <= b) & (a <= c), left, np.where(b <= c, up, corner))
                    line[x] = (row[x] + guess) & 255
        out[y + 1, 1:] = line
    pixels = out[1:, 1:].astype(np.uint8)
    return np.frombuffer(dict(parts)[b"PLTE"], np.uint8).reshape(-1, 3)[pixels[:, :, 0]] if kind == 3 else pixels


def _pnm(content: bytes) -> np.ndarray:
    fields, at = [], 0
    while len(fields) < 4:
        line_end = content.index(b"\n", at)
        fields += content[at:line_end].split(b"#")[0].split()
        at = line_end + 1
    if fields[3] != b"255":
        raise ValueError("only PNM of eight bits a channel is read without Pillow")
    return np.frombuffer(content, np.uint8, offset=at).reshape(int(fields[2]), int(fields[1]), 3 if fields[0] == b"P6" else 1)


def decode(content: bytes) -> np.ndarray:
    """Rows, columns and RGB; an error for what can't be read."""
    if Image is not None:
        return np.asarray(Image.open(io.BytesIO(content)).convert("RGB"))
    if content[: len(PNG)] == PNG:
        return to_rgb(_png(content))
    if content[:2] in (b"P5", b"P6"):
        return to_rgb(_pnm(content))
    raise ValueError("an image of this kind needs the library Pillow")


def encode(pixels: np.ndarray) -> bytes:
    """RGB pixels as PNG."""
    height, width = pixels.shape[:2]
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    rows = np.zeros((height, 1 + 3 * width), np.uint8)
    rows[:, 1:] = pixels.reshape(height, -1)
    return PNG + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows.tobytes(), 6)) + chunk(b"IEND", b"")


def decoded(pages: DataFrame) -> DataFrame:
    """The pages with width and height; null where the image can't be read."""
    keep = [c for c in pages.columns if c not in ("width", "height")]
    schema = ", ".join(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in keep) + ", width int, height int"

    def run(batches):
        for b in batches:
            sizes = []
            for content in b.column(b.schema.get_field_index("content")).to_pylist():
                try:
                    sizes.append(decode(content).shape[1::-1])
                except Exception:  # noqa: BLE001  a page that can't be read mustn't end the job
                    sizes.append((None, None))
            yield pa.record_batch([*[b.column(b.schema.get_field_index(c)) for c in keep], *[pa.array([s[k] for s in sizes], pa.int32()) for k in (0, 1)]], [*keep, "width", "height"])

    return pages.mapInArrow(run, schema)


def crops(rows: DataFrame, pages: DataFrame, most: int = 64) -> DataFrame:
    """The rows (with page_id, x0, y0, x1, y1) with ``content``, their part of the page as PNG; null where there is no image.

    The rows are gathered by page, so each page is sent and decoded once; ``most`` crops make an Arrow batch.
    """
    keep = [c for c in rows.columns if c != "content"]
    inner = rows.select("page_id", F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"))
    listed = inner.groupBy("page_id").agg(F.collect_list("row").alias("rows")).join(pages.select("page_id", "content"), "page_id", "left").select("rows", "content")
    schema = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep) + ", content binary"

    def cut(pixels, row):
        x0, y0, x1, y1 = max(0, row["x0"]), max(0, row["y0"]), row["x1"], row["y1"]
        part = pixels[y0:y1, x0:x1]
        return encode(part) if part.size else None

    def run(batches):
        for b in batches:
            kinds = [*b.column(0).type.value_type]
            for items, content in zip(b.column(0), b.column(1)):
                try:
                    pixels = decode(content.as_py())
                except Exception:  # noqa: BLE001
                    pixels = None
                items = items.as_py()
                for k in range(0, len(items), most):
                    some = items[k : k + most]
                    found = [None if pixels is None else cut(pixels, r) for r in some]
                    yield pa.record_batch([*[pa.array([r[f.name] for r in some], f.type) for f in kinds], pa.array(found, pa.binary())], [*[f.name for f in kinds], "content"])

    return listed.mapInArrow(run, schema)


def resized(pixels: np.ndarray, width: int, height: int) -> np.ndarray:
    """Bilinear, by the centres of the pixels."""

    def axis(new, old):
        at = np.clip((np.arange(new) + 0.5) * old / new - 0.5, 0, old - 1)
        low = np.floor(at).astype(int)
        return low, np.minimum(low + 1, old - 1), (at - low).astype(np.float32)

    (y0, y1, fy), (x0, x1, fx) = axis(height, pixels.shape[0]), axis(width, pixels.shape[1])
    rows = pixels[y0] * (1 - fy)[:, None, None] + pixels[y1] * fy[:, None, None]
    return np.rint(rows[:, x0] * (1 - fx)[None, :, None] + rows[:, x1] * fx[None, :, None]).astype(np.uint8)


def letterboxed(pixels: np.ndarray, side: int, grey: int = 114) -> np.ndarray:
    """The image, never enlarged, in the middle of a grey square; as a model's input: channels first, between 0 and 1."""
    height, width = pixels.shape[:2]
    r = min(side / height, side / width, 1.0)
    w, h = round(width * r), round(height * r)
    if (w, h) != (width, height):
        pixels = resized(pixels, max(w, 1), max(h, 1))
    out = np.full((side, side, 3), grey, np.uint8)
    top, left = round((side - h) / 2 - 0.1), round((side - w) / 2 - 0.1)
    out[top : top + pixels.shape[0], left : left + pixels.shape[1]] = pixels
    return (out.transpose(2, 0, 1)[None] / np.float32(255)).astype(np.float32)
