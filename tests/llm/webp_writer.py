"""A plain encoder for lossless WebP images with every transform, for tests of the decoder."""

import numpy as np

from inkstone.llm import webp
from inkstone.llm.webp import Writer, blocks, canonical, huffman_lengths, write_code


def write_any_code(out, weights):
    """A code for the symbols used; returns (codes, lengths)."""
    used = [s for s, w in enumerate(weights) if w]
    if len(used) <= 1:
        s = used[0] if used else 0
        if s < 256:
            webp.write_single(out, s)
            return {s: (0, 0)}
        weights = list(weights)
        weights[0] += 1
    lengths = huffman_lengths(list(weights))
    write_code(out, lengths)
    return {s: (c, n) for s, (c, n) in enumerate(zip(canonical(lengths), lengths, strict=True)) if n}


def prefix(value):
    """(symbol, extra bits, extra value) of a length or distance."""
    v = value - 1
    if v < 4:
        return v, 0, 0
    top = v.bit_length() - 1
    extra = top - 1
    return 2 * top + (v >> (top - 1) & 1), extra, v & ((1 << extra) - 1)


def entropy_coded(out, argb, cache_bits=0, main=False, matches=None, meta_bits=0):
    """argb: (h, w) pixels. matches: {pixel: (length, distance)} back-references. meta_bits: two groups of codes by parity of the block."""
    h, w = argb.shape
    flat = [int(x) for x in argb.ravel()]
    out.put(int(cache_bits > 0), 1)
    if cache_bits:
        out.put(cache_bits, 4)
    groups = 1
    if main:
        out.put(int(meta_bits > 0), 1)
        if meta_bits:
            out.put(meta_bits - 2, 3)
            bw, bh = blocks(w, meta_bits), blocks(h, meta_bits)
            which = np.add.outer(np.arange(bh), np.arange(bw)) % 2
            entropy_coded(out, which << 8 | 0xFF << 24)
            groups = 2
    tokens, cache, at = [], {}, 0
    while at < len(flat):
        n, d = (matches or {}).get(at, (0, 0))
        slot = lambda p: ((p * webp.HASH) & 0xFFFFFFFF) >> (32 - cache_bits)
        if n:
            tokens.append((at, "copy", n, d))
        elif cache_bits and cache.get(slot(flat[at])) == flat[at]:
            tokens.append((at, "cache", slot(flat[at]), 0))
            n = 1
        else:
            tokens.append((at, "plain", flat[at], 0))
            n = 1
        if cache_bits:
            for p in flat[at : at + n]:
                cache[slot(p)] = p
        at += n
    group = lambda i: int(which[(i // w) >> meta_bits, (i % w) >> meta_bits]) if groups == 2 else 0
    weights = [[[0] * n for n in (280 + (1 << cache_bits if cache_bits else 0), 256, 256, 256, 40)] for _ in range(groups)]
    for i, kind, a, b in tokens:
        g = weights[group(i)]
        if kind == "plain":
            for k, shift in enumerate((8, 16, 0, 24)):
                g[k][a >> shift & 255] += 1
        elif kind == "cache":
            g[0][280 + a] += 1
        else:
            g[0][256 + prefix(a)[0]] += 1
            g[4][prefix(b + 120)[0]] += 1
    codes = [[write_any_code(out, x) for x in g] for g in weights]
    for i, kind, a, b in tokens:
        g = codes[group(i)]
        if kind == "plain":
            for k, shift in enumerate((8, 16, 0, 24)):
                out.put(*g[k][a >> shift & 255])
        elif kind == "cache":
            out.put(*g[0][280 + a])
        else:
            for code, offset, value in ((g[0], 256, a), (g[4], 0, b + 120)):
                s, n, extra = prefix(value)
                out.put(*code[offset + s])
                out.put(extra, n)


def predict(done, y, x, mode):
    """The prediction from finished pixels, channel by channel, written apart from the decoder's."""
    black = [0, 0, 0, 255]
    if not y:
        return done[y][x - 1] if x else black
    if not x:
        return done[y - 1][x]
    left, top, corner = done[y][x - 1], done[y - 1][x], done[y - 1][x - 1]
    right = done[y - 1][x + 1] if x + 1 < len(done[0]) else done[y][0]
    avg = lambda p, q: [(a + b) // 2 for a, b in zip(p, q, strict=True)]
    clamp = lambda v: max(0, min(255, v))
    if mode == 11:
        guess = [a + b - c for a, b, c in zip(left, top, corner, strict=True)]
        to_left = sum(abs(g - a) for g, a in zip(guess, left, strict=True))
        to_top = sum(abs(g - b) for g, b in zip(guess, top, strict=True))
        return left if to_left < to_top else top
    if mode == 12:
        return [clamp(a + b - c) for a, b, c in zip(left, top, corner, strict=True)]
    if mode == 13:
        return [clamp(m + int((m - c) / 2)) for m, c in zip(avg(left, top), corner, strict=True)]
    return {0: black, 1: left, 2: top, 3: right, 4: corner, 5: avg(avg(left, right), top), 6: avg(left, corner), 7: avg(left, top), 8: avg(corner, top), 9: avg(top, right), 10: avg(avg(left, corner), avg(top, right))}[mode]


def signed(v):
    return v - 256 if v > 127 else v


def image(argb, transforms=(), cache_bits=0, matches=None, meta_bits=0):
    """A lossless image of (h, w) pixels 0xAARRGGBB. transforms: any of palette, green, cross, predictor, in coding order."""
    h, w = argb.shape
    out = Writer()
    out.put(0x2F, 8)
    out.put(w - 1, 14)
    out.put(h - 1, 14)
    out.put(1, 1)
    out.put(0, 3)
    px = [[[int(p) & 255, int(p) >> 8 & 255, int(p) >> 16 & 255, int(p) >> 24 & 255] for p in row] for row in argb]
    for t in transforms:
        width = len(px[0])
        out.put(1, 1)
        if t == "palette":
            table = sorted({tuple(p) for row in px for p in row})
            out.put(3, 2)
            out.put(len(table) - 1, 8)
            steps = [[(c - d) & 255 for c, d in zip(p, table[i - 1] if i else (0, 0, 0, 0), strict=True)] for i, p in enumerate(table)]
            entropy_coded(out, np.array([[b | g << 8 | r << 16 | a << 24 for b, g, r, a in steps]], np.int64))
            size = 3 if len(table) <= 2 else 2 if len(table) <= 4 else 1 if len(table) <= 16 else 0
            bits, packed = 8 >> size, []
            for row in px:
                line = [[0, 0, 0, 255] for _ in range(blocks(width, size))]
                for x, p in enumerate(row):
                    line[x >> size][1] |= table.index(tuple(p)) << (x & ((1 << size) - 1)) * bits
                packed.append(line)
            px = packed
        elif t == "green":
            out.put(2, 2)
            px = [[[(b - g) & 255, g, (r - g) & 255, a] for b, g, r, a in row] for row in px]
        elif t == "predictor":
            out.put(0, 2)
            out.put(0, 3)
            modes = np.arange(blocks(h, 2) * blocks(width, 2)).reshape(blocks(h, 2), -1) % 14
            entropy_coded(out, modes.astype(np.int64) << 8 | 0xFF << 24)
            px = [[[(v - g) & 255 for v, g in zip(px[y][x], predict(px, y, x, int(modes[y >> 2, x >> 2])), strict=True)] for x in range(width)] for y in range(h)]
        else:
            out.put(1, 2)
            out.put(0, 3)
            rng = np.random.default_rng(4)
            e = rng.integers(0, 256, (blocks(h, 2), blocks(width, 2), 3))
            entropy_coded(out, (e[..., 0] | e[..., 1] << 8 | e[..., 2] << 16 | 0xFF << 24).astype(np.int64))
            new = []
            for y in range(h):
                line = []
                for x in range(width):
                    b, g, r, a = px[y][x]
                    to_red, to_blue, red_to_blue = (signed(int(v)) for v in e[y >> 2, x >> 2])
                    line.append([(b - (to_blue * signed(g) >> 5) - (red_to_blue * signed(r) >> 5)) & 255, g, (r - (to_red * signed(g) >> 5)) & 255, a])
                new.append(line)
            px = new
    out.put(0, 1)
    entropy_coded(out, np.array([[b | g << 8 | r << 16 | a << 24 for b, g, r, a in row] for row in px], np.int64), cache_bits, True, matches, meta_bits)
    data = out.n.to_bytes((out.size + 7) // 8, "little")
    body = webp.chunk(b"VP8L", data)
    return b"RIFF" + (len(body) + 4).to_bytes(4, "little") + b"WEBP" + body
