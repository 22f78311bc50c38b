"""Media columns as lossless WebP: an encoder for payloads and a decoder for the lossless format.

A payload becomes RGB pixels, 64 to a row; up to 32 rows are one still image, more are the frames of an animation, placed below
each other. The decoder reads every part of the lossless format: simple and normal prefix codes, meta prefix codes, back-references,
the colour cache, and the predictor, cross-colour, subtract-green and palette transforms.

Images decode side by side: those with the same codes advance one pixel a step, all together, as columns of numpy arrays, so a
column of many small images costs few operations a pixel. The encoder writes colour cache hits, back-references for runs, and one of
three fixed sets of transforms and prefix codes (from fixed models of byte frequencies, so that equal texts give equal files),
whichever takes the fewest bits for a frame: text (predictor with the black mode, codes of letters), smooth (left predictor and
cross-colour, codes of small differences), and marks (a palette of 16 grey pixels of white space and rules, two to a byte).

Defined cases: null text counts as empty; an empty payload is one row of spaces; any length is held (a frame for every 32 rows);
rows are independent, so ties and repeated rows repeat their values; a null doc_id is kept; further columns are ignored; an empty
table gives an empty result. A file that is cut off or breaks the format raises WebPError.
"""

from __future__ import annotations

import hashlib
import heapq
import struct
import zlib
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from inkstone.llm.common import map_batches, texts_of

WIDTH, FRAME_ROWS, ROW_BYTES = 64, 32, 192
CACHE_BITS = 8
#: Frames that are decoded together, and characters of text that are stored together; both bound the memory.
LANES, PORTION_CHARS = 2048, 1 << 22
#: Fixed values of the format: the order of code length codes, and the neighbours (x, y) that the first 120 distances mean.
LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
NEIGHBOURS = (
    (0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2), (0, 3), (3, 0), (1, 3), (-1, 3),
    (3, 1), (-3, 1), (2, 3), (-2, 3), (3, 2), (-3, 2), (0, 4), (4, 0), (1, 4), (-1, 4), (4, 1), (-4, 1), (3, 3), (-3, 3), (2, 4), (-2, 4),
    (4, 2), (-4, 2), (0, 5), (3, 4), (-3, 4), (4, 3), (-4, 3), (5, 0), (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5), (-2, 5), (5, 2), (-5, 2),
    (4, 4), (-4, 4), (3, 5), (-3, 5), (5, 3), (-5, 3), (0, 6), (6, 0), (1, 6), (-1, 6), (6, 1), (-6, 1), (2, 6), (-2, 6), (6, 2), (-6, 2),
    (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6), (6, 3), (-6, 3), (0, 7), (7, 0), (1, 7), (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1),
    (4, 6), (-4, 6), (6, 4), (-6, 4), (2, 7), (-2, 7), (7, 2), (-7, 2), (3, 7), (-3, 7), (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5),
    (8, 0), (4, 7), (-4, 7), (7, 4), (-7, 4), (8, 1), (8, 2), (6, 6), (-6, 6), (8, 3), (5, 7), (-5, 7), (7, 5), (-7, 5), (8, 4), (6, 7),
    (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7),
)
NEIGHBOUR_X, NEIGHBOUR_Y = (np.array(v, np.int64) for v in zip(*NEIGHBOURS, strict=True))
HASH = 0x1E35A7BD
U = np.uint64


class WebPError(ValueError):
    """The file is cut off or breaks the format."""


# ---------------------------------------------------------------- prefix codes


def huffman_lengths(weights: list[int], most: int = 15) -> list[int]:
    """Code lengths of a prefix code; symbols of weight 0 have none. Flattens the weights until no length exceeds most."""
    lengths = [0] * len(weights)
    used = [s for s, w in enumerate(weights) if w]
    if len(used) == 1:
        lengths[used[0]] = 1
        return lengths
    floor = 0
    while True:
        heap = [(max(weights[s], floor), s, (s,)) for s in used]
        heapq.heapify(heap)
        depth = dict.fromkeys(used, 0)
        while len(heap) > 1:
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            for s in a[2] + b[2]:
                depth[s] += 1
            heapq.heappush(heap, (a[0] + b[0], min(a[1], b[1]), a[2] + b[2]))
        if max(depth.values(), default=0) <= most:
            for s, d in depth.items():
                lengths[s] = d
            return lengths
        floor = max(1, 2 * floor, sum(weights) >> 20)


def canonical(lengths: list[int]) -> list[int]:
    """Codes of the lengths, bit-reversed as the format stores them."""
    count, code, nxt = [0] * 17, 0, [0] * 17
    for n in lengths:
        count[n] += n > 0
    for n in range(1, 16):
        code = (code + count[n - 1]) << 1
        nxt[n] = code
    out = [0] * len(lengths)
    for s, n in enumerate(lengths):
        if n:
            out[s] = int(f"{nxt[n]:0{n}b}"[::-1], 2)
            nxt[n] += 1
    return out


@dataclass
class Code:
    """table[bits & mask] is symbol << 4 | length."""

    table: np.ndarray
    mask: int
    longest: int

    @staticmethod
    def of(lengths: list[int]) -> Code:
        used = [s for s, n in enumerate(lengths) if n]
        if len(used) <= 1:
            return Code(np.array([(used[0] if used else 0) << 4], np.int64), 0, 0)
        most = max(lengths)
        if sum(1 << (most - n) for n in lengths if n) != 1 << most:
            raise WebPError("prefix code is not complete")
        table = np.zeros(1 << most, np.int64)
        for s, (n, c) in enumerate(zip(lengths, canonical(lengths), strict=True)):
            if n:
                table[c :: 1 << n] = s << 4 | n
        return Code(table, (1 << most) - 1, most)

    @staticmethod
    def single(symbol: int) -> Code:
        return Code(np.array([symbol << 4], np.int64), 0, 0)


class Bits:
    """Reads bits, least significant first."""

    def __init__(self, data: bytes, at: int = 0):
        self.n, self.at, self.size = int.from_bytes(data, "little"), at, len(data) * 8

    def read(self, n: int) -> int:
        if self.at + n > self.size:
            raise WebPError("cut off")
        value = (self.n >> self.at) & ((1 << n) - 1)
        self.at += n
        return value

    def symbol(self, code: Code) -> int:
        e = int(code.table[(self.n >> self.at) & code.mask])
        self.at += e & 15
        if self.at > self.size:
            raise WebPError("cut off")
        return e >> 4


def read_code(bits: Bits, alphabet: int) -> Code:
    if bits.read(1):
        two = bits.read(1)
        symbols = [bits.read(8 if bits.read(1) else 1)] + ([bits.read(8)] if two else [])
        if max(symbols) >= alphabet:
            raise WebPError("symbol outside its alphabet")
        if not two or symbols[0] == symbols[1]:
            return Code.single(symbols[0])
        lengths = [0] * alphabet
        for s in symbols:
            lengths[s] = 1
        return Code.of(lengths)
    of_lengths = [0] * 19
    for k in LENGTH_ORDER[: 4 + bits.read(4)]:
        of_lengths[k] = bits.read(3)
    code = Code.of(of_lengths)
    left = 2 + bits.read(2 + 2 * bits.read(3)) if bits.read(1) else alphabet
    lengths, last = [], 8
    while len(lengths) < alphabet and left > 0:
        left -= 1
        s = bits.symbol(code)
        if s < 16:
            lengths.append(s)
            last = s or last
        else:
            repeat = bits.read((2, 3, 7)[s - 16]) + (3, 3, 11)[s - 16]
            if len(lengths) + repeat > alphabet:
                raise WebPError("code lengths run over")
            lengths += [last if s == 16 else 0] * repeat
    return Code.of(lengths + [0] * (alphabet - len(lengths)))


# ---------------------------------------------------------------- decoding


@dataclass
class Header:
    """What stands before the pixels of one entropy-coded image."""

    groups: list[list[Code]]
    cache_bits: int
    meta: np.ndarray | None = None
    meta_bits: int = 0
    transforms: list[tuple] = field(default_factory=list)
    width: int = 0
    end: int = 0


def blocks(n: int, bits: int) -> int:
    return (n + (1 << bits) - 1) >> bits


def read_spatial(bits: Bits, data: bytes, width: int, height: int, main: bool) -> tuple[Header, int]:
    """The cache size, meta codes and prefix codes of an image of width columns."""
    cache_bits = bits.read(4) if bits.read(1) else 0
    if cache_bits > 11:
        raise WebPError("colour cache too large")
    h, groups = Header([], cache_bits, width=width), 1
    if main and bits.read(1):
        h.meta_bits = bits.read(3) + 2
        sub = sub_image(bits, data, blocks(width, h.meta_bits), blocks(height, h.meta_bits))
        h.meta = ((sub >> 8) & 0xFFFF).astype(np.int64)
        groups = int(h.meta.max()) + 1
    for _ in range(groups):
        h.groups.append([read_code(bits, n) for n in (280 + (1 << cache_bits if cache_bits else 0), 256, 256, 256, 40)])
    h.end = bits.at
    return h, groups


def sub_image(bits: Bits, data: bytes, width: int, height: int) -> np.ndarray:
    """An image inside the header: (height, width) ARGB."""
    h, _ = read_spatial(bits, data, width, height, False)
    pixels, ends = decode_lanes(h, [data], np.array([h.end]), np.array([width * height]), width)
    bits.at = int(ends[0])
    return pixels[0].reshape(height, width)


def read_header(data: bytes) -> tuple[int, int, Header]:
    bits = Bits(data)
    if bits.read(8) != 0x2F:
        raise WebPError("not a lossless image")
    width, height = bits.read(14) + 1, bits.read(14) + 1
    bits.read(1)
    if bits.read(3):
        raise WebPError("unknown version")
    transforms, seen, columns = [], set(), width
    while bits.read(1):
        kind = bits.read(2)
        if kind in seen:
            raise WebPError("a transform comes twice")
        seen.add(kind)
        if kind in (0, 1):
            size = bits.read(3) + 2
            transforms.append((kind, columns, size, sub_image(bits, data, blocks(columns, size), blocks(height, size))))
        elif kind == 2:
            transforms.append((kind, columns))
        else:
            n = bits.read(8) + 1
            steps = sub_image(bits, data, n, 1)[0].astype(np.uint32).view(np.uint8).reshape(n, 4)
            palette = np.zeros(256, np.uint32)
            palette[:n] = np.ascontiguousarray(np.cumsum(steps, 0, dtype=np.uint8)).view(np.uint32)[:, 0]
            size = 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0
            transforms.append((kind, columns, size, palette))
            columns = blocks(columns, size)
    h, _ = read_spatial(bits, data, columns, height, True)
    h.transforms = transforms
    return width, height, h


def decode_lanes(h: Header, datas: list[bytes], bit: np.ndarray, pixels: np.ndarray, width: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Pixels of images that share a header, and the bit where each ends. Every lane makes its pixel i in step i."""
    order = np.argsort(-pixels, kind="stable")
    offsets = np.concatenate([[0], np.cumsum([len(d) + 16 for d in datas])])
    raw = np.frombuffer(b"".join(d + bytes(16) for d in datas), np.uint8)
    word = np.ndarray((len(raw) - 7,), "<u8", raw, strides=(1,))
    at = (bit + offsets[:-1] * 8)[order]
    limit = (offsets[:-1] + np.array([len(d) for d in datas]))[order] * 8
    sizes = pixels[order]
    n_lanes, steps = len(datas), int(sizes[0]) if len(datas) else 0
    out = np.zeros((steps, n_lanes), np.int64)
    cache = np.zeros((n_lanes, 1 << h.cache_bits), np.int64)
    left, back = np.zeros(n_lanes, np.int64), np.ones(n_lanes, np.int64)
    live = np.searchsorted(-sizes, -np.arange(steps), "left")
    copying = False
    lanes_all = np.arange(n_lanes)

    def peek(p: np.ndarray) -> np.ndarray:
        return word[p >> 3] >> (p & 7).astype(U)

    for i in range(steps):
        k = int(live[i])
        lanes = lanes_all[:k]
        fresh = lanes[left[:k] == 0] if copying else lanes
        for which, group in enumerate(h.groups) if len(fresh) else ():
            mine = fresh
            if h.meta is not None:
                if h.meta[(i // width) >> h.meta_bits, (i % width) >> h.meta_bits] != which:
                    continue
            green, red, blue, alpha, far = group
            p = at[mine]
            w = peek(p)
            e = green.table[(w & U(green.mask)).astype(np.int64)]
            symbol, n = e >> 4, e & 15
            plain = symbol < 256
            some = mine
            if not plain.all():
                at[mine] = p + n
                rest = np.flatnonzero(~plain)
                hits = rest[symbol[rest] >= 280]
                out[i, mine[hits]] = cache[mine[hits], symbol[hits] - 280]
                refs = rest[symbol[rest] < 280]
                if len(refs):
                    lane = mine[refs]
                    length = prefixed(peek, at, lane, symbol[refs] - 256)
                    e = far.table[(peek(at[lane]) & U(far.mask)).astype(np.int64)]
                    at[lane] += e & 15
                    code = prefixed(peek, at, lane, e >> 4)
                    near = np.minimum(code, 120) - 1
                    distance = np.where(code > 120, code - 120, np.maximum(1, NEIGHBOUR_X[near] + NEIGHBOUR_Y[near] * width))
                    if (distance > i).any():
                        raise WebPError("a back-reference starts before the image")
                    left[lane], back[lane] = length, distance
                    copying = True
                pick = np.flatnonzero(plain)
                some, p, w, symbol, n = mine[pick], p[pick], w[pick], symbol[pick], n[pick]
            w = w >> n.astype(U)
            p = p + n
            e = red.table[(w & U(red.mask)).astype(np.int64)]
            n = e & 15
            p += n
            value = symbol << 8 | (e >> 4) << 16
            w = w >> n.astype(U) if green.longest + red.longest + blue.longest + alpha.longest <= 57 else peek(p)
            e = blue.table[(w & U(blue.mask)).astype(np.int64)]
            n = e & 15
            p += n
            value |= e >> 4
            e = alpha.table[((w >> n.astype(U)) & U(alpha.mask)).astype(np.int64)]
            at[some] = p + (e & 15)
            out[i, some] = value | (e >> 4) << 24
        if copying:
            run = lanes[left[:k] > 0]
            out[i, run] = out[i - back[run], run]
            left[run] -= 1
            copying = bool(len(run))
        if h.cache_bits:
            row = out[i, :k]
            cache[lanes, ((row * HASH) & 0xFFFFFFFF) >> (32 - h.cache_bits)] = row
    if (at > limit).any():
        raise WebPError("cut off")
    inverse = np.argsort(order)
    images = [out[: int(pixels[j]), inverse[j]] for j in range(n_lanes)]
    return images, at[inverse] - offsets[:-1] * 8


def prefixed(peek, at: np.ndarray, lane: np.ndarray, prefix: np.ndarray) -> np.ndarray:
    """Lengths and distances: a prefix symbol with extra bits."""
    extra = np.where(prefix < 4, 0, (prefix - 2) >> 1)
    value = np.where(prefix < 4, prefix, (2 + (prefix & 1)) << extra)
    value = value + (peek(at[lane]).astype(np.int64) & ((1 << extra) - 1))
    at[lane] += extra
    return value + 1


def channels(argb: np.ndarray) -> np.ndarray:
    """(..., 4) unsigned bytes: blue, green, red, alpha."""
    return np.ascontiguousarray(argb.astype(np.uint32)).view(np.uint8).reshape(*argb.shape, 4).copy()


def inverse_one_mode(image: np.ndarray, mode: int) -> None:
    """inverse_predictor where all blocks have mode 0 (black), 1 (left) or 2 (top): running sums of bytes."""
    image[0, :1, 3] += np.uint8(255)
    image[0] = np.cumsum(image[0], 0, dtype=np.uint8)
    image[:, 0] = np.cumsum(image[:, 0], 0, dtype=np.uint8)
    if mode == 0:
        image[1:, 1:, 3] += np.uint8(255)
    elif mode == 1:
        image[1:] = np.cumsum(image[1:], 1, dtype=np.uint8)
    else:
        image[:, 1:] = np.cumsum(image[:, 1:], 0, dtype=np.uint8)


def inverse_predictor(image: np.ndarray, size: int, modes: np.ndarray) -> None:
    """Adds to each residual its prediction from the pixels before; image is (height, width, 4), in place."""
    kinds = np.unique((modes >> 8) & 15)
    if len(kinds) == 1 and kinds[0] < 3:
        return inverse_one_mode(image, int(kinds[0]))
    height, width, _ = image.shape
    black = np.array([0, 0, 0, 255], np.int64)
    average = lambda a, b: (a + b) >> 1
    done = image.astype(np.int64)
    for y in range(height):
        for x in range(width):
            if not y:
                guess = done[y, x - 1] if x else black
            elif not x:
                guess = done[y - 1, x]
            else:
                left, top, corner = done[y, x - 1], done[y - 1, x], done[y - 1, x - 1]
                right = done[y - 1, x + 1] if x + 1 < width else done[y, 0]
                mode = int(modes[y >> size, x >> size] >> 8) & 15
                if mode == 0 or mode > 13:
                    guess = black
                elif mode <= 4:
                    guess = (left, top, right, corner)[mode - 1]
                elif mode == 5:
                    guess = average(average(left, right), top)
                elif mode <= 8:
                    guess = average(*((left, corner), (left, top), (corner, top))[mode - 6])
                elif mode == 9:
                    guess = average(top, right)
                elif mode == 10:
                    guess = average(average(left, corner), average(top, right))
                elif mode == 11:
                    guess = left if np.abs(top - corner).sum() < np.abs(left - corner).sum() else top
                elif mode == 12:
                    guess = np.clip(left + top - corner, 0, 255)
                else:
                    mean = average(left, top)
                    guess = np.clip(mean + ((mean - corner) / 2).astype(np.int64), 0, 255)
            done[y, x] = (done[y, x] + guess) & 255
    image[:] = done


def inverse_cross_colour(image: np.ndarray, size: int, elements: np.ndarray) -> None:
    height, width, _ = image.shape
    e = channels(elements)
    e = (e[0, 0] if e.shape[:2] == (1, 1) else e[np.arange(height)[:, None] >> size, np.arange(width)[None, :] >> size]).view(np.int8).astype(np.int16)
    green = image[..., 1].view(np.int8).astype(np.int16)
    image[..., 2] += ((e[..., 0] * green) >> 5).astype(np.uint8)
    red = image[..., 2].view(np.int8).astype(np.int16)
    image[..., 0] += (((e[..., 1] * green) >> 5) + ((e[..., 2] * red) >> 5)).astype(np.uint8)


def inverse_transforms(h: Header, height: int, argb: np.ndarray) -> np.ndarray:
    """(height, width, 4) blue, green, red, alpha from the pixels as coded."""
    image = channels(argb.reshape(height, h.width))
    for kind, columns, *rest in reversed(h.transforms):
        if kind == 0:
            inverse_predictor(image, *rest)
        elif kind == 1:
            inverse_cross_colour(image, *rest)
        elif kind == 2:
            image[..., 0] += image[..., 1]
            image[..., 2] += image[..., 1]
        else:
            size, palette = rest
            index = image[..., 1].astype(np.int64)
            if size:
                x, width = np.arange(columns), 8 >> size
                index = (index[:, x >> size] >> ((x & ((1 << size) - 1)) * width)) & ((1 << width) - 1)
            image = channels(palette[index])
    return image


def parse_file(data: bytes) -> list[tuple[int, int, bytes]]:
    """(x, y, lossless image) of the still image or of each frame."""
    if len(data) < 20 or data[:4] != b"RIFF" or data[8:12] != b"WEBP" or struct.unpack_from("<I", data, 4)[0] + 8 > len(data):
        raise WebPError("not a WebP file")
    out, at, x, y, end = [], 12, 0, 0, struct.unpack_from("<I", data, 4)[0] + 8
    while at + 8 <= end:
        name, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        if name == b"ANMF":
            x, y = (2 * int.from_bytes(data[at + 8 + k : at + 11 + k], "little") for k in (0, 3))
            at += 24
            continue
        if name == b"VP8L":
            if at + 8 + size > end:
                raise WebPError("cut off")
            out.append((x, y, data[at + 8 : at + 8 + size]))
        elif name == b"VP8 ":
            raise WebPError("not a lossless image")
        at += 8 + size + (size & 1)
    if not out:
        raise WebPError("no image")
    return out


def decode_files(files: list[bytes]) -> list[np.ndarray]:
    """Pixel arrays (height, width, 4: red, green, blue, alpha) of WebP files."""
    frames = [(f, *frame) for f, data in enumerate(files) for frame in parse_file(data)]
    heads: list[tuple[int, int, Header]] = []
    shared: dict[int, list[int]] = {}
    known: list[tuple[int, int, Header]] = []
    for k, (_, _, _, data) in enumerate(frames):
        # A header without meta codes, whose transforms have one block, doesn't depend on the height: what follows byte 5 tells whether it is the same.
        size = int.from_bytes(data[1:5], "little")
        width, height = (size & 0x3FFF) + 1, ((size >> 14) & 0x3FFF) + 1
        for value, own, h in known:
            if width == own and height <= 512 and (int.from_bytes(data[5 : 5 + (h.end - 33) // 8], "little") & ((1 << (h.end - 40)) - 1)) == value and len(data) * 8 >= h.end and data[0] == 0x2F and data[4] < 32:
                heads.append((width, height, h))
                break
        else:
            heads.append(read_header(data))
            h = heads[-1][2]
            if h.meta is None and all(t[0] > 1 or (t[2] == 9 and heads[-1][0] <= 512 and heads[-1][1] <= 512) for t in h.transforms):
                known.append((int.from_bytes(data[5 : 5 + (h.end - 33) // 8], "little") & ((1 << (h.end - 40)) - 1), heads[-1][0], h))
        shared.setdefault(id(heads[-1][2]), []).append(k)
    images: list[np.ndarray | None] = [None] * len(frames)
    for ks in shared.values():
        by_width: dict[int, list[int]] = {}
        for k in ks:
            by_width.setdefault(heads[k][0], []).append(k)
        for width, mine in by_width.items():
            h = heads[mine[0]][2]
            columns = h.width or width
            for at in range(0, len(mine), LANES):
                part = mine[at : at + LANES]
                pixels, _ = decode_lanes(h, [frames[k][3] for k in part], np.full(len(part), h.end), np.array([columns * heads[k][1] for k in part]), columns)
                for k, argb in zip(part, pixels, strict=True):
                    if h.transforms:
                        images[k] = inverse_transforms(h, heads[k][1], argb)
                    else:
                        images[k] = channels(argb.reshape(heads[k][1], width))
    out: list[np.ndarray] = []
    at = 0
    for f in range(len(files)):
        own = []
        while at < len(frames) and frames[at][0] == f:
            own.append(at)
            at += 1
        if len(own) == 1:
            whole = images[own[0]]
        else:
            whole = np.zeros((max(frames[k][2] + images[k].shape[0] for k in own), max(frames[k][1] + images[k].shape[1] for k in own), 4), np.uint8)
            for k in own:
                _, x, y, _ = frames[k]
                whole[y : y + images[k].shape[0], x : x + images[k].shape[1]] = images[k]
        out.append(whole[..., [2, 1, 0, 3]])
    return out


# ---------------------------------------------------------------- encoding


class Writer:
    def __init__(self):
        self.n, self.size = 0, 0

    def put(self, value: int, n: int) -> None:
        self.n |= value << self.size
        self.size += n


def write_code(out: Writer, lengths: list[int]) -> None:
    """A normal prefix code, its lengths coded with runs of zeros."""
    items: list[tuple[int, int, int]] = []
    at = 0
    while at < len(lengths):
        run = 1
        while at + run < len(lengths) and lengths[at + run] == lengths[at]:
            run += 1
        if not lengths[at] and run >= 3:
            run = min(run, 138)
            items.append((17, run - 3, 3) if run <= 10 else (18, run - 11, 7))
            at += run
        else:
            items.append((lengths[at], 0, 0))
            at += 1
    weights = [0] * 19
    for s, _, _ in items:
        weights[s] += 1
    of = huffman_lengths(weights, 7)
    codes = canonical(of)
    alone = sum(n > 0 for n in of) == 1
    out.put(0, 1)
    out.put(15, 4)
    for k in LENGTH_ORDER:
        out.put(of[k], 3)
    out.put(0, 1)
    for s, extra, n in items:
        if not alone:
            out.put(codes[s], of[s])
        out.put(extra, n)


def write_single(out: Writer, symbol: int) -> None:
    out.put(1 | 0 << 1 | 1 << 2 | symbol << 3, 11)


def byte_weights() -> list[int]:
    """A fixed model of bytes in text: letters by rank of how common they are, few marks, and a little of everything else."""
    weights = [2] * 256
    for rank, c in enumerate("etaonirshdlucmfpgwbyvkqxjz"):
        weights[ord(c)] = 4000 // (rank + 4)
        weights[ord(c.upper())] = 160 // (rank + 4)
    for c, w in ((" ", 1500), (",", 90), (".", 110), ("\n", 60)):
        weights[ord(c)] = w
    for b in range(0x80, 0xC0):
        weights[b] = 6
    weights[0xC3] = 60
    return weights


#: The grey pixels of the palette: white space and what rules are made of.
GREYS = sorted(b" \t\n\r-=_.*#~+/|0x")


@dataclass
class Model:
    """The fixed codes of one kind of frame: symbols' codes and lengths as arrays, the header's bits after the sizes, the alpha and the columns as coded."""

    code: list[np.ndarray]
    length: list[np.ndarray]
    header: int
    header_bits: int
    alpha: int
    columns: int


def write_pixel(out: Writer, green: int, red: int, blue: int, alpha: int) -> None:
    """An image of one pixel inside the header: no cache, codes of one symbol each."""
    out.put(0, 1)
    for symbol in (green, red, blue, alpha, 0):
        write_single(out, symbol)


def write_palette(out: Writer, colours: list[int]) -> None:
    """The palette's pixels as differences, byte by byte, with codes made for them."""
    rows = np.array([[g, g, g, 255] for g in colours], np.uint8)
    steps = np.diff(np.concatenate([np.zeros((1, 4), np.uint8), rows]), axis=0).tolist()
    out.put(0, 1)
    lengths = []
    for channel, alphabet in ((0, 280), (1, 256), (2, 256), (3, 256)):
        weights = [0] * alphabet
        for step in steps:
            weights[step[channel]] += 1
        lengths.append(huffman_lengths(weights))
        write_code(out, lengths[-1])
    write_single(out, 0)
    codes = [canonical(n) for n in lengths]
    for step in steps:
        for symbol, code, n in zip(step, codes, lengths, strict=True):
            out.put(code[symbol], n[symbol])


@lru_cache(maxsize=3)
def fixed_model(kind: str) -> Model:
    out, alpha, columns = Writer(), 0, WIDTH
    near = [4000 // (1 + min(b, 256 - b)) ** 2 + 2 for b in range(256)]
    colour = {"text": byte_weights(), "smooth": near, "marks": [2 + 40 * (b in (0, 17)) for b in range(256)]}[kind]
    if kind == "marks":
        alpha, columns = 255, WIDTH // 2
        out.put(1 | 3 << 1, 3)
        out.put(len(GREYS) - 1, 8)
        write_palette(out, GREYS)
    else:
        out.put(1 | 0 << 1, 3)
        out.put(7, 3)
        write_pixel(out, int(kind == "smooth"), 0, 0, 255)
    if kind == "smooth":
        out.put(1 | 1 << 1, 3)
        out.put(7, 3)
        write_pixel(out, 32, 0, 32, 255)
    total = sum(colour)
    green = [w * 8 for w in colour] + [total // 100] * 12 + [0] * 12 + [max(1, total * 6 // 1000)] * (1 << CACHE_BITS)
    green = [w or 1 for w in green]
    lengths = [huffman_lengths(green), huffman_lengths(colour), huffman_lengths(colour)]
    out.put(0, 1)
    out.put(1, 1)
    out.put(CACHE_BITS, 4)
    out.put(0, 1)
    for n in lengths:
        write_code(out, n)
    write_single(out, alpha)
    write_single(out, 1)
    return Model([np.array(canonical(n), U) for n in lengths], [np.array(n, np.int64) for n in lengths], out.n, out.size, alpha, columns)


def residuals(pixels: np.ndarray, cuts: np.ndarray, left: bool) -> np.ndarray:
    """Pixels (n, 3) less their prediction: the left one in a frame's first row, the one above in its first column, elsewhere the left one or black."""
    place = np.arange(len(pixels)) - np.repeat(cuts[:-1], np.diff(cuts))
    out = pixels.copy()
    first_column = np.flatnonzero((place % WIDTH == 0) & (place > 0))
    beside = np.flatnonzero((place % WIDTH > 0) if left else (place > 0) & (place < WIDTH))
    out[beside] -= pixels[beside - 1]
    out[first_column] -= pixels[first_column - WIDTH]
    return out


def coded_pixels(pixels: np.ndarray, cuts: np.ndarray) -> list[tuple[str, np.ndarray, np.ndarray, np.ndarray]]:
    """(kind, numbers of frames, their pixels as coded, cuts) of each kind: every frame goes to the kind that takes the fewest bits for its literals."""
    frames, sizes = np.arange(len(cuts) - 1), np.diff(cuts)
    text, smooth = residuals(pixels, cuts, False), residuals(pixels, cuts, True)
    smooth[:, 0] -= smooth[:, 1]
    smooth[:, 2] -= smooth[:, 1]
    bits = []
    for kind, coded in (("text", text), ("smooth", smooth)):
        m = fixed_model(kind)
        of = m.length[1][coded[:, 0]] + m.length[0][coded[:, 1]] + m.length[2][coded[:, 2]]
        bits.append(np.add.reduceat(of, cuts[:-1]) + m.header_bits)
    grey = np.full(256, -1, np.int64)
    grey[GREYS] = np.arange(len(GREYS))
    marked = (pixels[:, 0] == pixels[:, 1]) & (pixels[:, 1] == pixels[:, 2]) & (grey[pixels[:, 1]] >= 0)
    all_marks = np.add.reduceat(marked, cuts[:-1], dtype=np.int64) == sizes
    chosen = np.where(all_marks, 2, (bits[1] < bits[0]).astype(np.int64))
    owner, out = np.repeat(chosen, sizes), []
    for k, (kind, coded) in enumerate((("text", text), ("smooth", smooth), ("marks", pixels))):
        mine = frames[chosen == k]
        if not len(mine):
            continue
        own, n = coded[owner == k], sizes[mine]
        if kind == "marks":
            index = grey[own[:, 1]].astype(np.uint8).reshape(-1, 2)
            own, n = np.zeros((len(index), 3), np.uint8), n // 2
            own[:, 1] = index[:, 0] | index[:, 1] << 4
        out.append((kind, mine, own, np.concatenate([[0], np.cumsum(n)])))
    return out


def encode_frames(pixels: np.ndarray, cuts: np.ndarray, m: Model) -> list[bytes]:
    """Lossless images, 64 wide, of consecutive stretches of pixels as coded (n, 3: red, green, blue)."""
    n = len(pixels)
    px = pixels[:, 0].astype(np.int64) << 16 | pixels[:, 1].astype(np.int64) << 8 | pixels[:, 2]
    argb = px | m.alpha << 24
    first = np.zeros(n, bool)
    first[cuts[:-1]] = True
    same = np.zeros(n, bool)
    same[1:] = px[1:] == px[:-1]
    same &= ~first
    edge = np.flatnonzero(np.diff(np.concatenate([[0], same.view(np.int8), [0]])))
    begin, end = edge[::2], edge[1::2]
    # A run also breaks where a frame starts: there same is false.
    long = end - begin >= 3
    begin, end = begin[long], end[long]
    depth = np.zeros(n + 1, np.int64)
    depth[begin] += 1
    depth[end] -= 1
    covered = np.cumsum(depth)[:-1] > 0
    frame = np.repeat(np.arange(len(cuts) - 1), np.diff(cuts))
    slot = ((argb * HASH) & 0xFFFFFFFF) >> (32 - CACHE_BITS)
    order = np.argsort(frame << CACHE_BITS | slot, kind="stable")
    key = (frame << CACHE_BITS | slot)[order]
    hit = np.zeros(n, bool)
    hit[order[1:]] = (key[1:] == key[:-1]) & (px[order][1:] == px[order][:-1])
    r, g, b = (pixels[:, k] for k in range(3))
    ng, nr, nb = m.length[0][g], m.length[1][r], m.length[2][b]
    value = m.code[0][g] | m.code[1][r] << ng.astype(U) | m.code[2][b] << (ng + nr).astype(U)
    bits = ng + nr + nb
    symbol = 280 + slot[hit]
    value[hit], bits[hit] = m.code[0][symbol], m.length[0][symbol]
    length = end - begin
    less = length - 1
    top = np.frexp(np.maximum(less, 1))[1] - 1
    prefix = np.where(less < 2, less, 2 * top + ((less >> np.maximum(top - 1, 0)) & 1))
    extra = np.where(less < 4, 0, top - 1)
    symbol = 256 + prefix
    value[begin] = m.code[0][symbol] | (less & ((1 << extra) - 1)).astype(U) << m.length[0][symbol].astype(U)
    bits[begin] = m.length[0][symbol] + extra
    covered[begin] = False
    keep = np.flatnonzero(~covered)
    value, bits, frame = value[keep], bits[keep], frame[keep]
    # Each frame gets whole 64-bit words; the header's bits come first.
    total = np.bincount(frame, bits, len(cuts) - 1).astype(np.int64) + 40 + m.header_bits
    words = (total + 63) // 64 + 1
    base = np.concatenate([[0], np.cumsum(words)])
    before = np.cumsum(bits) - bits
    start = np.searchsorted(frame, np.arange(len(cuts) - 1))
    place = before - before[start][frame] + base[frame] * 64 + 40 + m.header_bits
    packed = np.zeros(int(base[-1]), U)
    at, shift = place >> 6, (place & 63).astype(U)
    heads = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    packed[at[heads]] = np.bitwise_or.reduceat(value << shift, heads)
    over = np.flatnonzero((place & 63) + bits > 64)
    packed[at[over] + 1] |= value[over] >> (U(64) - shift[over])
    raw = packed.tobytes()
    out = []
    n_header = (40 + m.header_bits + 7) // 8
    for k in range(len(cuts) - 1):
        height = int(cuts[k + 1] - cuts[k]) // m.columns
        head = 0x2F | (WIDTH - 1) << 8 | (height - 1) << 22 | m.header << 40
        data = raw[base[k] * 8 : base[k] * 8 + (int(total[k]) + 7) // 8]
        front = (int.from_bytes(data[:n_header], "little") | head).to_bytes(n_header, "little")
        out.append(front + data[n_header:])
    return out


def chunk(name: bytes, data: bytes) -> bytes:
    return name + struct.pack("<I", len(data)) + data + bytes(len(data) & 1)


def file_of(images: list[bytes], rows: int) -> bytes:
    u24 = lambda v: v.to_bytes(3, "little")
    if len(images) == 1:
        body = chunk(b"VP8L", images[0])
    else:
        body = chunk(b"VP8X", bytes([2, 0, 0, 0]) + u24(WIDTH - 1) + u24(rows - 1)) + chunk(b"ANIM", bytes(6))
        for k, image in enumerate(images):
            own = min(FRAME_ROWS, rows - k * FRAME_ROWS)
            body += chunk(b"ANMF", u24(0) + u24(k * FRAME_ROWS // 2) + u24(WIDTH - 1) + u24(own - 1) + u24(0) + b"\2" + chunk(b"VP8L", image))
    return b"RIFF" + struct.pack("<I", len(body) + 4) + b"WEBP" + body


def payload_of(text: str | None) -> tuple[int, bytes]:
    raw = (text or "").encode()
    return len(raw), raw + b" " * (-len(raw) % ROW_BYTES if raw else ROW_BYTES)


def encode_payloads(payloads: list[bytes]) -> list[bytes]:
    cuts = [0]
    counts = []
    for p in payloads:
        rows = len(p) // ROW_BYTES
        own = [min(FRAME_ROWS, rows - y) for y in range(0, rows, FRAME_ROWS)]
        counts.append((len(own), rows))
        for r in own:
            cuts.append(cuts[-1] + r * WIDTH)
    pixels = np.frombuffer(b"".join(payloads), np.uint8).reshape(-1, 3)
    images: list[bytes] = [b""] * (len(cuts) - 1)
    for kind, frames, coded, own in coded_pixels(pixels, np.array(cuts)):
        for k, image in zip(frames.tolist(), encode_frames(coded, own, fixed_model(kind)), strict=True):
            images[k] = image
    out, at = [], 0
    for n, rows in counts:
        out.append(file_of(images[at : at + n], rows))
        at += n
    return out


def feature(image: np.ndarray) -> str:
    """Size, sums of the channels, and of the differences across and down."""
    a = image[..., :3].astype(np.int64)
    sums = a.sum((0, 1))
    return f"{image.shape[1]}x{image.shape[0]}:" + ":".join(map(str, [*sums.tolist(), int(np.abs(np.diff(a, axis=1)).sum()), int(np.abs(np.diff(a, axis=0)).sum())]))


SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def store_and_read(docs: DataFrame, with_media: bool = False) -> DataFrame:
    """One row for each document: its payload stored as WebP, read back, and features of the pixels; with_media adds the file."""

    def run(batches):
        from inkstone.llm.bpe import portions

        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            done = 0
            for texts in portions([t or "" for t in batch.column("text").to_pylist()], PORTION_CHARS):
                sizes, payloads = zip(*map(payload_of, texts), strict=True)
                media = encode_payloads(list(payloads))
                images = decode_files(media)
                back = [np.ascontiguousarray(i[..., :3]).tobytes() for i in images]
                cols = {
                    "doc_id": pa.array(ids[done : done + len(texts)], pa.int64()), "n_bytes": pa.array(sizes, pa.int64()), "payload_bytes": pa.array([len(b) for b in back], pa.int64()),
                    "payload_sha256": pa.array([hashlib.sha256(b).hexdigest() for b in back], pa.string()), "tail_crc32": pa.array([zlib.crc32(b[-16:]) for b in back], pa.int64()),
                    "media_bytes": pa.array([len(f) for f in media], pa.int64()), "media_sha256": pa.array([hashlib.sha256(f).hexdigest() for f in media], pa.string()), "feature": pa.array(map(feature, images), pa.string()),
                }
                if with_media:
                    cols["media"] = pa.array(media, pa.binary())
                done += len(texts)
                yield pa.RecordBatch.from_pydict(cols)

    return map_batches(texts_of(docs), run, SCHEMA + ", media binary" * with_media)
