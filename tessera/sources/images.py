"""Image files as DataFrames: bitmaps, PNG, the fifth-generation delta codec and the eighth.

An image is a row (path, width, height, channels, data): 8-bit samples row by row, RGB or ARGB.
Files are read with Spark's binaryFile source and decoded in Arrow batches; images are
independent, so there is no shuffle. A file that cannot be read gets an error and no pixels.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import gen8

SCHEMA = "path string, width int, height int, channels int, data binary, error string"

# Bitmaps: uncompressed, 24 or 32 bits, bottom-up unless the height is negative, rows padded to four bytes.


def decode_bmp(raw: bytes) -> np.ndarray:
    if raw[:2] != b"BM":
        raise ValueError("not a bitmap")
    offset, size, width, height, _, depth, packing = struct.unpack_from("<IIiiHHI", raw, 10)
    if size < 40 or packing or depth not in (24, 32) or width <= 0 or not height:
        raise ValueError("only uncompressed bitmaps of 24 or 32 bits are read")
    rows, n = abs(height), depth // 8
    stride = (width * n + 3) // 4 * 4
    pixels = np.frombuffer(raw, np.uint8, rows * stride, offset).reshape(rows, stride)[:, : width * n].reshape(rows, width, n)
    pixels = pixels[::-1] if height > 0 else pixels
    return pixels[:, :, [2, 1, 0]] if n == 3 else pixels[:, :, [3, 2, 1, 0]]


def encode_bmp(image: np.ndarray) -> bytes:
    """32 bits only where some alpha is not 255."""
    if image.shape[2] == 4:
        image = image[:, :, [3, 2, 1, 0]] if (image[:, :, 0] != 255).any() else image[:, :, [3, 2, 1]]
    else:
        image = image[:, :, ::-1]
    rows, width, n = image.shape
    stride = (width * n + 3) // 4 * 4
    body = np.zeros((rows, stride), np.uint8)
    body[:, : width * n] = image[::-1].reshape(rows, width * n)
    header = b"BM" + struct.pack("<IHHI", 54 + body.size, 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, width, rows, 1, 8 * n, 0, body.size, 2835, 2835, 0, 0)
    return header + body.tobytes()


# PNG: 8-bit RGB and RGBA are written; gray, palettes, 16 bits and tRNS are read, always to ARGB.


def unfiltered(data: bytes, rows: int, stride: int, step: int) -> np.ndarray:
    lines = np.frombuffer(data, np.uint8).reshape(rows, stride + 1)
    out = np.zeros((rows, stride), np.uint8)
    above = np.zeros(stride, np.uint8)
    for y in range(rows):
        kind, line = lines[y, 0], lines[y, 1:]
        if kind == 0:
            now = line.copy()
        elif kind == 2:
            now = line + above
        elif kind == 1:
            now = np.cumsum(line.reshape(-1, step), axis=0, dtype=np.uint8).ravel()
        elif kind in (3, 4):
            now = np.zeros(stride, np.uint8)
            for x in range(stride):
                a = int(now[x - step]) if x >= step else 0
                b = int(above[x])
                if kind == 3:
                    guess = (a + b) // 2
                else:
                    c = int(above[x - step]) if x >= step else 0
                    p = a + b - c
                    guess = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
                now[x] = (int(line[x]) + guess) & 255
        else:
            raise ValueError(f"filter {kind}")
        out[y] = above = now
    return out


def decode_png(raw: bytes) -> np.ndarray:
    if raw[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("not a PNG")
    at, parts, chunks = 8, [], {}
    while at < len(raw):
        size, kind = struct.unpack_from(">I4s", raw, at)
        body = raw[at + 8 : at + 8 + size]
        if zlib.crc32(kind + body) != struct.unpack_from(">I", raw, at + 8 + size)[0]:
            raise ValueError("a chunk's checksum is wrong")
        if kind == b"IDAT":
            parts.append(body)
        else:
            chunks[kind] = body
        at += 12 + size
    width, height, depth, color, _, _, lace = struct.unpack(">IIBBBBB", chunks[b"IHDR"])
    if lace:
        raise ValueError("interlaced PNG files are not read")
    samples = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[color]
    stride = (width * samples * depth + 7) // 8
    lines = unfiltered(zlib.decompress(b"".join(parts)), height, stride, max(1, samples * depth // 8))
    if depth == 16:
        lines = lines[:, ::2]
    elif depth < 8:
        bits = np.unpackbits(lines, axis=1).reshape(height, -1, depth)
        lines = (bits * (1 << np.arange(depth)[::-1])).sum(axis=2).astype(np.uint8)[:, :width]
    pixels = lines[:, : width * samples].reshape(height, width, samples)
    alpha = np.full((height, width, 1), 255, np.uint8)
    extra = chunks.get(b"tRNS")
    if color == 3:
        table = np.frombuffer(chunks[b"PLTE"], np.uint8).reshape(-1, 3)
        if extra:
            alphas = np.full(256, 255, np.uint8)
            alphas[: len(extra)] = np.frombuffer(extra, np.uint8)
            alpha = alphas[pixels]
        rgb = table[pixels[:, :, 0]]
    elif color in (0, 4):
        scale = 255 // ((1 << depth) - 1) if depth < 8 else 1
        if color == 4:
            alpha = pixels[:, :, 1:]
        elif extra:
            clear = struct.unpack(">H", extra)[0] >> (8 if depth == 16 else 0)
            alpha = np.where(pixels == clear, 0, 255).astype(np.uint8)
        rgb = np.repeat(pixels[:, :, :1] * np.uint8(scale), 3, axis=2)
    else:
        rgb = pixels[:, :, :3]
        if color == 6:
            alpha = pixels[:, :, 3:]
        elif extra:
            clear = np.array([v >> (8 if depth == 16 else 0) for v in struct.unpack(">HHH", extra)])
            alpha = np.where((rgb == clear).all(axis=2, keepdims=True), 0, 255).astype(np.uint8)
    return np.concatenate((alpha, rgb), axis=2)


def encode_png(image: np.ndarray) -> bytes:
    pixels = image[:, :, [1, 2, 3, 0]] if image.shape[2] == 4 else image
    rows, width, n = pixels.shape
    lines = np.zeros((rows, width * n + 1), np.uint8)
    lines[:, 1:] = pixels.reshape(rows, width * n)
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    head = struct.pack(">IIBBBBB", width, rows, 8, 6 if n == 4 else 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines.tobytes())) + chunk(b"IEND", b"")


# The fifth generation: stripes of four lines; each plane is the difference to the line above, then
# to the left, and blue and red relative to green. Two running sums modulo 256 undo it at once.

#: The first eleven bytes.
MAGIC_5 = b"TLG5.0\x00raw\x1a"
STRIPE = 4


def unpacked(raw: bytes, want: int, window: bytearray, at: int) -> tuple[bytes, int]:
    """Literals and copies from a ring of 4096 bytes: a flag bit each, low bit first; copies are 12 bits of place and 4 of length."""
    out = bytearray()
    i = 0
    while i < len(raw) and len(out) < want:
        flags = raw[i]
        i += 1
        for bit in range(8):
            if i >= len(raw):
                break
            if flags >> bit & 1:
                word = raw[i] | raw[i + 1] << 8
                i += 2
                place, size = word & 4095, word >> 12
                if size == 15:
                    size += raw[i]
                    i += 1
                for _ in range(size + 3):
                    c = window[place]
                    place = (place + 1) & 4095
                    window[at] = c
                    out.append(c)
                    at = (at + 1) & 4095
            else:
                c = raw[i]
                i += 1
                window[at] = c
                out.append(c)
                at = (at + 1) & 4095
    return bytes(out), at


def decode_5(raw: bytes) -> np.ndarray:
    if raw[:11] != MAGIC_5:
        raise ValueError("not of the fifth generation")
    colors, width, height, stripe = struct.unpack_from("<BIII", raw, 11)
    if colors not in (3, 4) or not (width and height and stripe):
        raise ValueError("a header field is out of range")
    at = 24 + 4 * ((height - 1) // stripe + 1)
    planes = np.zeros((colors, height, width), np.uint8)
    window, place = bytearray(4096), 0
    for y in range(0, height, stripe):
        rows = min(stripe, height - y)
        for c in range(colors):
            method, size = struct.unpack_from("<BI", raw, at)
            body = raw[at + 5 : at + 5 + size]
            at += 5 + size
            if method == 0:
                body, place = unpacked(body, rows * width, window, place)
            elif method != 1:
                raise ValueError(f"method {method}")
            planes[c, y : y + rows] = np.frombuffer(body, np.uint8, rows * width).reshape(rows, width)
    planes[0] += planes[1]
    planes[2] += planes[1]
    planes = np.cumsum(np.cumsum(planes, axis=2, dtype=np.uint8), axis=1, dtype=np.uint8)
    alpha = planes[3] if colors == 4 else np.full((height, width), 255, np.uint8)
    return np.stack((alpha, planes[2], planes[1], planes[0]), axis=2)


def encode_5(image: np.ndarray, colors: int | None = None) -> bytes:
    argb = image if image.shape[2] == 4 else np.concatenate((np.full((*image.shape[:2], 1), 255, np.uint8), image), axis=2)
    colors = colors or (4 if (argb[:, :, 0] != 255).any() else 3)
    planes = argb[:, :, [3, 2, 1, 0][:colors]].transpose(2, 0, 1)
    for axis in (1, 2):
        planes = np.diff(planes, axis=axis, prepend=np.uint8(0))
    planes = planes.copy()
    planes[0] -= planes[1]
    planes[2] -= planes[1]
    height, width = planes.shape[1:]
    stripes = [b"".join(struct.pack("<BI", 1, p.size) + p.tobytes() for p in planes[:, y : y + STRIPE]) for y in range(0, height, STRIPE)]
    return MAGIC_5 + struct.pack("<BIII", colors, width, height, STRIPE) + b"".join(struct.pack("<I", len(s)) for s in stripes) + b"".join(stripes)


def decode(raw: bytes) -> np.ndarray:
    """By the first bytes; a container of the codec's is unwrapped."""
    if raw[:11] == b"TLG0.0\x00sds\x1a":
        raw = raw[15:]
    for magic, f in ((b"BM", decode_bmp), (b"\x89PNG", decode_png), (MAGIC_5, decode_5), (gen8.MAGIC, gen8.decode)):
        if raw.startswith(magic):
            return f(raw)
    raise ValueError("an unknown format")


ENCODERS: dict[str, Callable[[np.ndarray], bytes]] = {"bmp": encode_bmp, "png": encode_png, "gen5": encode_5, "gen8": gen8.encode}


def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            row: dict = {"path": path, "width": None, "height": None, "channels": None, "data": None, "error": None}
            try:
                image = decode(raw)
                row |= {"height": image.shape[0], "width": image.shape[1], "channels": image.shape[2], "data": image.tobytes()}
            except (ValueError, struct.error, zlib.error, IndexError, KeyError) as e:
                row["error"] = str(e) or type(e).__name__
            yield pa.RecordBatch.from_pylist([row], schema=pa.schema([("path", pa.string()), ("width", pa.int32()), ("height", pa.int32()), ("channels", pa.int32()), ("data", pa.binary()), ("error", pa.string())]))


def read_images(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
    return files.select("path", "content").mapInArrow(scanned, SCHEMA)


def encoded(images: DataFrame, form: str) -> DataFrame:
    """(path, bytes) of decoded images in another format."""
    encode = ENCODERS[form]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            out = [encode(np.frombuffer(r["data"], np.uint8).reshape(r["height"], r["width"], r["channels"])) for r in rows]
            yield pa.RecordBatch.from_pydict({"path": pa.array([r["path"] for r in rows], pa.string()), "bytes": pa.array(out, pa.binary())})

    return images.where("error is null").select("path", "width", "height", "channels", "data").mapInArrow(run, "path string, bytes binary")
