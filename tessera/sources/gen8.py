"""The eighth generation: tiles of searched blocks in adaptive bit streams.

A file is a header with its own cost table and one length-prefixed payload a tile. Blocks of a
tile are searched (operators.block_search), their settings written as five sequences in the
cheapest of three ways, and their values routed to eight row streams, each with one adaptive mean
over the whole tile. Tiles are independent: a scan explodes them and decodes each in a task.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np

from ..functions.arrays import N, SIDE, scan_orders
from ..functions.costs import DEFAULT, bit_lengths
from ..functions.scalars import PERMUTATIONS
from ..operators import block_search as B

#: The first eleven bytes, the header flags and the tile's size.
MAGIC = b"TLG8.0\x00raw\x1a"
HAS_TABLE, TAIL = 1, 8
TILE_WIDTH, TILE_HEIGHT = 8192, 80
#: Bits of a predictor, filter, scan, coder and interleave setting.
WIDTHS = (4, 7, 4, 2, 2)
Table = list[tuple[int, int, list[int]]]


class Bits:
    """Bits in the order they are written, lowest first."""

    def __init__(self) -> None:
        self.out: list[str] = []
        self.size = 0

    def put(self, value: int, width: int) -> None:
        if width:
            self.raw(format(value & ((1 << width) - 1), f"0{width}b")[::-1])

    def raw(self, bits: str) -> None:
        self.out.append(bits)
        self.size += len(bits)

    def gamma(self, value: int) -> None:
        zeros = value.bit_length() - 1
        self.raw("0" * zeros + "1")
        self.put(value, zeros)

    def run(self, n: int) -> None:
        self.raw("0" if n == 1 else "10" if n == 2 else "11")
        if n > 2:
            self.gamma(n - 2)

    def number(self, value: int) -> None:
        while value > 127:
            self.put(value | 128, 8)
            value >>= 7
        self.put(value, 8)

    def align(self, to: int) -> None:
        self.raw("0" * (-self.size % to))

    def bytes(self) -> bytes:
        text = np.frombuffer("".join(self.out).encode(), np.uint8) & 1
        return np.packbits(text, bitorder="little").tobytes()


class Reader:
    def __init__(self, raw: bytes) -> None:
        self.text = (np.unpackbits(np.frombuffer(raw, np.uint8), bitorder="little") + 48).tobytes().decode()
        self.at = 0

    def get(self, width: int) -> int:
        bits = self.text[self.at : self.at + width]
        if len(bits) < width:
            raise ValueError("the payload ends early")
        self.at += width
        return int(bits[::-1], 2) if width else 0

    def zeros(self, most: int) -> int:
        """Zeros before the next one, which is taken too; `most` zeros end the search before it."""
        end = self.text.find("1", self.at, self.at + most)
        if end < 0:
            if self.at + most > len(self.text):
                raise ValueError("the payload ends early")
            self.at += most
            return most
        n = end - self.at
        self.at = end + 1
        return n

    def gamma(self) -> int:
        zeros = self.zeros(32)
        if zeros > 31:
            raise ValueError("a number is too long")
        return (1 << zeros) + self.get(zeros)

    def run(self) -> int:
        return 1 if not self.get(1) else 2 if not self.get(1) else self.gamma() + 2

    def number(self) -> int:
        value = shift = 0
        while True:
            byte = self.get(8)
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value


@lru_cache(64)
def low_of(counts: tuple[int, ...]) -> list[int]:
    return bit_lengths(list(counts))


class Row:
    """A row's mean and cost table over a tile."""

    def __init__(self, rise: int, fall: int, counts: list[int]) -> None:
        self.rise, self.fall, self.low, self.a = rise, fall, low_of(tuple(counts)), 0

    def bits(self) -> int:
        return self.low[min((self.a + 8) >> 4, 1023)]

    def after(self, m: int) -> None:
        ratio = self.rise if self.a < m else self.fall
        self.a = ((m << 4) * ratio + self.a * (16 - ratio) + 8) >> 4

    def write(self, out: Bits, m: int) -> None:
        k = self.bits()
        if m >> k >= 16:
            out.raw("0" * 16)
            out.gamma(m - 15)
        else:
            out.raw("0" * (m >> k) + "1")
            out.put(m, k)
        self.after(m)

    def read(self, of: Reader) -> int:
        k = self.bits()
        q = of.zeros(16)
        m = of.gamma() + 15 if q == 16 else (q << k) + of.get(k)
        self.after(m)
        return m


def mapped(v: int) -> int:
    return 2 * v if v >= 0 else -2 * v - 1


def write_row(out: Bits, values: list[int], row: int, table: Table) -> None:
    state = Row(*table[row])
    if row in (0, 1, 2, 6):
        for v in values:
            state.write(out, mapped(v))
        return
    out.put(int(values[0] != 0), 1)
    for zero, a, b in runs_of([v == 0 for v in values]):
        out.run(b - a)
        if not zero:
            for v in values[a:b]:
                state.write(out, mapped(v) - 1)


def read_row(of: Reader, n: int, row: int, table: Table) -> list[int]:
    state = Row(*table[row])
    unmapped = lambda m: -(m + 1) // 2 if m & 1 else m // 2
    if row in (0, 1, 2, 6):
        return [unmapped(state.read(of)) for _ in range(n)]
    out: list[int] = []
    zero = not of.get(1)
    while len(out) < n:
        size = of.run()
        if len(out) + size > n:
            raise ValueError("a run is too long")
        out += [0] * size if zero else [unmapped(state.read(of) + 1) for _ in range(size)]
        zero = not zero
    return out


def runs_of(values: list) -> Iterator[tuple]:
    """(value, start, end) of equal neighbours."""
    start = 0
    for i in range(1, len(values) + 1):
        if i == len(values) or values[i] != values[start]:
            yield values[start], start, i
            start = i


def write_settings(out: Bits, columns: list[list[int]]) -> None:
    """Five sequences, each raw, with same-as-before flags or as runs: the cheapest, the first of equals."""
    modes = []
    for values, width in zip(columns, WIDTHS, strict=True):
        runs = list(runs_of(values))
        numbers = sum(8 * max(1, -(-(b - a - 1).bit_length() // 7)) for _, a, b in runs)
        costs = [len(values) * width, width * len(runs) + len(values) - 1, width * len(runs) + numbers]
        modes.append(costs.index(min(costs)))
        out.put(modes[-1], 2)
    for values, width, mode in zip(columns, WIDTHS, modes, strict=True):
        if mode == 2:
            for v, a, b in runs_of(values):
                out.put(v, width)
                out.number(b - a - 1)
            continue
        for i, v in enumerate(values):
            if mode and i:
                out.put(int(v == values[i - 1]), 1)
            if not (mode and i and v == values[i - 1]):
                out.put(v, width)


def read_settings(of: Reader, n: int) -> list[list[int]]:
    modes, columns = [of.get(2) for _ in WIDTHS], []
    for mode, width in zip(modes, WIDTHS, strict=True):
        values: list[int] = []
        while len(values) < n:
            if mode == 0:
                values.append(of.get(width))
            elif mode == 1:
                values.append(values[-1] if values and of.get(1) else of.get(width))
            elif mode == 2:
                v = of.get(width)
                values += [v] * (of.number() + 1)
            else:
                raise ValueError("an unknown way of writing settings")
        if len(values) > n:
            raise ValueError("a run of settings is too long")
        columns.append(values)
    return columns


def routes(coder: int, components: int, interleave: int) -> list[int]:
    """The row of each component; interleaved blocks go to one row as a whole."""
    return [6 + coder] if interleave else [3 * coder + (c if c < 3 else 0) for c in range(components)]


def scan(shape: tuple[int, int], which: int) -> list[int]:
    return list(scan_orders().values())[which] if shape == (SIDE, SIDE) else list(range(shape[0] * shape[1]))


def grid(height: int, width: int) -> Iterator[tuple[int, int, int, int]]:
    for y in range(0, height, SIDE):
        for x in range(0, width, SIDE):
            yield y, x, min(SIDE, height - y), min(SIDE, width - x)


def widened(tile: np.ndarray) -> np.ndarray:
    """(components, height + 1, width + 2): zeros above and on both sides."""
    height, width, components = tile.shape
    wide = np.zeros((components, height + 1, width + 2), np.int64)
    wide[:, 1:, 1:-1] = tile.transpose(2, 0, 1)
    return wide


def settings_of(wides: list[np.ndarray], scans: list[int] | None = None) -> list[list[tuple]]:
    """The best setting of each block of each widened tile; blocks of all tiles are searched together."""
    scans = list(range(len(scan_orders()))) if scans is None else scans
    cells = [list(grid(w.shape[1] - 1, w.shape[2] - 2)) for w in wides]
    found: list[list[tuple]] = [[()] * len(c) for c in cells]
    shapes: dict[tuple[int, int, int], list[tuple[int, int]]] = {}
    for t, own in enumerate(cells):
        for i, (_, _, h, w) in enumerate(own):
            shapes.setdefault((len(wides[t]), h, w), []).append((t, i))
    for (_, h, w), own in shapes.items():
        for a in range(0, len(own), B.TOGETHER):
            part = own[a : a + B.TOGETHER]
            windows = np.stack([wides[t][:, y : y + h + 1, x : x + w + 2] for t, i in part for y, x, _, _ in (cells[t][i],)])
            for (t, i), best in zip(part, B.search_windows(windows, scans if (h, w) == (SIDE, SIDE) else [0]), strict=True):
                found[t][i] = best[:3]
    return found


def encode_tile(wide: np.ndarray, found: list[tuple]) -> bytes:
    """A widened tile of 3 or 4 components and its blocks' settings: settings and streams."""
    components, height, width = len(wide), wide.shape[1] - 1, wide.shape[2] - 2
    cells = list(grid(height, width))
    columns: list[list[int]] = [[], [], [], [], []]
    rows: list[list[int]] = [[] for _ in range(8)]
    for i, (y, x, h, w) in enumerate(cells):
        rank, _, coder = found[i]
        predictor, code, order, interleave = rank // 1536, rank // 16 % 96, rank // 2 % 8, rank % 2
        window = wide[None, :, y : y + h + 1, x : x + w + 2]
        v = B.filtered(B.residuals_of(window, predictor), code)[0][:, scan((h, w), order)]
        for column, value in zip(columns, (predictor, code, order, coder, interleave), strict=True):
            column.append(value)
        if interleave:
            rows[6 + coder] += v.T.ravel().tolist()
        else:
            for c, row in enumerate(routes(coder, components, 0)):
                rows[row] += v[c].tolist()
    out = Bits()
    write_settings(out, columns)
    out.align(8)
    for row, values in enumerate(rows):
        if values:
            write_row(out, values, row, DEFAULT)
    out.align(32)
    return out.bytes()


def unfiltered(v: np.ndarray, code: int) -> np.ndarray:
    d0 = v[0]
    d1 = v[1] + [0, d0, B.half(d0), B.half(3 * d0)][(code >> 2) & 3]
    d2 = v[2] + [0, d0, d1, B.half(d0 + d1)][code & 3]
    out = v.copy()
    for place, d in zip(PERMUTATIONS[(code >> 4) % 6], (d0, d1, d2), strict=True):
        out[place] = d
    return out


def decode_tile(raw: bytes, height: int, width: int, components: int, table: Table) -> np.ndarray:
    of, cells = Reader(raw), list(grid(height, width))
    settings = list(zip(*read_settings(of, len(cells)), strict=True))
    if any(s[0] > 7 for s in settings):
        raise ValueError("an unknown predictor")
    of.at += -of.at % 8
    sizes = [0] * 8
    for (_, _, h, w), (_, _, _, coder, interleave) in zip(cells, settings, strict=True):
        for row in routes(coder, components, interleave):
            sizes[row] += h * w * (components if interleave else 1)
    rows = [read_row(of, n, row, table) if n else [] for row, n in enumerate(sizes)]
    places = [0] * 8

    def take(row: int, n: int) -> np.ndarray:
        places[row] += n
        return np.array(rows[row][places[row] - n : places[row]], np.int64)

    left = np.zeros((components, height, width), np.int64)
    guess = np.zeros((height, width), np.int64)
    for (y, x, h, w), (predictor, code, order, coder, interleave) in zip(cells, settings, strict=True):
        n = h * w
        if interleave:
            v = take(6 + coder, n * components).reshape(n, components).T
        else:
            v = np.stack([take(row, n) for row in routes(coder, components, 0)])
        back = np.empty_like(v)
        back[:, scan((h, w), order)] = v
        left[:, y : y + h, x : x + w] = unfiltered(back, code).reshape(components, h, w)
        guess[y : y + h, x : x + w] = predictor
    out = np.empty((components, height, width), np.uint8)
    kinds = guess.tolist()
    for c in range(components):
        above = [0] * (width + 2)
        for y, rest in enumerate(left[c].tolist()):  # a pixel needs the one before it, so pixels come one after another
            line, kind_of = [0] * (width + 2), kinds[y]
            for x in range(width):
                kind = kind_of[x]
                if kind == 0:
                    a, b, corner = line[x], above[x + 1], above[x]
                    high, low = (a, b) if a > b else (b, a)
                    p = low if corner > high else high if corner < low else a + b - corner
                elif kind == 4:
                    p = line[x]
                elif kind == 5:
                    p = above[x + 1]
                elif kind == 6:
                    p = above[x]
                elif kind == 7:
                    p = above[x + 2]
                elif kind == 1:
                    p = line[x] + above[x] + 1 >> 1
                else:
                    p = above[x + 1] + above[x if kind == 2 else x + 2] + 1 >> 1
                p += rest[x]
                line[x + 1] = 0 if p < 0 else 255 if p > 255 else p
            out[c, y] = line[1:-1]
            above = line
    return out.transpose(1, 2, 0)


def encode(image: np.ndarray, scans: list[int] | None = None) -> bytes:
    return encode_all([image], scans)[0]


def encode_all(images: Sequence[np.ndarray], scans: list[int] | None = None) -> list[bytes]:
    """Files of images; small ones are best given many at a time, since their blocks are searched together."""
    corners = [[(y, x) for y in range(0, image.shape[0], TILE_HEIGHT) for x in range(0, image.shape[1], TILE_WIDTH)] for image in images]
    wides = [widened(image[y : y + TILE_HEIGHT, x : x + TILE_WIDTH]) for image, own in zip(images, corners, strict=True) for y, x in own]
    tiles = map(encode_tile, wides, settings_of(wides, scans))
    body = b"".join(struct.pack("<11H", rise, fall, *counts) for rise, fall, counts in DEFAULT)
    files = []
    for image, own in zip(images, corners, strict=True):
        height, width, components = image.shape
        out = [MAGIC, struct.pack("<BB", components, HAS_TABLE), len(body).to_bytes(3, "little"), bytes([TAIL]), struct.pack("<QQQQ", TILE_WIDTH, TILE_HEIGHT, width, height), body]
        for _ in own:
            tile = next(tiles)
            out += [struct.pack("<I", len(tile)), tile]
        files.append(b"".join(out))
    return files


def decode(raw: bytes) -> np.ndarray:
    if raw[:11] != MAGIC:
        raise ValueError("not of the eighth generation")
    components, flags = raw[11], raw[12]
    size = int.from_bytes(raw[13:16], "little")
    if components not in (3, 4):
        raise ValueError("a header field is out of range")
    tile_w, tile_h, width, height = struct.unpack_from("<QQQQ", raw, 17)
    at, table = 49, DEFAULT
    if flags & HAS_TABLE:
        table = [(r[0], r[1], list(r[2:])) for r in (struct.unpack_from("<11H", raw, at + 22 * i) for i in range(8))]
        at += size
    out = np.zeros((height, width, components), np.uint8)
    for y in range(0, height, tile_h):
        for x in range(0, width, tile_w):
            (n,) = struct.unpack_from("<I", raw, at)
            h, w = min(tile_h, height - y), min(tile_w, width - x)
            out[y : y + h, x : x + w] = decode_tile(raw[at + 4 : at + 4 + n], h, w, components, table)
            at += 4 + n
    return out


assert N == SIDE * SIDE
