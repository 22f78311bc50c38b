"""The decoder on every part of the lossless format, against a separately written encoder."""

import numpy as np
import pytest

from inkstone.llm import webp
from tests.llm.webp_writer import image


def noise(h, w, colours=None, seed=0):
    rng = np.random.default_rng(seed)
    if colours:
        return rng.choice(rng.integers(0, 2**32, colours), (h, w)).astype(np.int64)
    smooth = np.add.outer(np.arange(h) * 3, np.arange(w) * 5)
    return (smooth % 256 | (smooth // 2 % 256) << 8 | (rng.integers(0, 8, (h, w)) + smooth) % 256 << 16 | (255 - smooth % 7) << 24).astype(np.int64)


def pixels(argb):
    return np.stack([argb >> 16 & 255, argb >> 8 & 255, argb & 255, argb >> 24 & 255], -1).astype(np.uint8)


@pytest.mark.parametrize("transforms", [(), ("green",), ("cross",), ("predictor",), ("green", "cross", "predictor"), ("predictor", "cross", "green")])
@pytest.mark.parametrize("size", [(1, 1), (9, 13), (20, 5)])
def test_transforms(transforms, size):
    argb = noise(*size)
    assert (webp.decode_files([image(argb, transforms)])[0] == pixels(argb)).all()


@pytest.mark.parametrize("colours", [1, 2, 4, 16, 40, 200])
def test_palettes(colours):
    argb = noise(17, 19, colours)
    assert (webp.decode_files([image(argb, ("palette",))])[0] == pixels(argb)).all()
    assert (webp.decode_files([image(argb, ("palette", "predictor"))])[0] == pixels(argb)).all()


@pytest.mark.parametrize("cache_bits", [0, 1, 6, 11])
@pytest.mark.parametrize("meta_bits", [0, 2, 3])
def test_cache_meta_codes_and_back_references(cache_bits, meta_bits):
    argb = noise(24, 20, 9, seed=cache_bits)
    flat = argb.ravel()
    matches = {}
    for at, length, distance in ((60, 30, 20), (150, 1, 7), (200, 100, 1), (310, 40, 139), (400, 25, 399)):
        for i in range(length):
            flat[at + i] = flat[at + i - distance]
        matches[at] = (length, distance)
    assert (webp.decode_files([image(argb, (), cache_bits, matches, meta_bits)])[0] == pixels(argb)).all()


def test_near_distances_follow_the_neighbour_map():
    assert len(webp.NEIGHBOURS) == 120 and len(set(webp.NEIGHBOURS)) == 120
    rank = [(abs(x) if x >= 0 else abs(x)) ** 2 + y**2 for x, y in webp.NEIGHBOURS]
    assert rank == sorted(rank)


def test_mixed_files_decode_together():
    stills = [noise(8, 8, 5, s) for s in range(4)]
    payloads = [webp.payload_of("text " * n)[1] for n in (1, 50, 3000)]
    files = [f for pair in zip([image(a) for a in stills[:3]], webp.encode_payloads(payloads), strict=True) for f in pair]
    got = webp.decode_files(files)
    for k in range(3):
        assert (got[2 * k] == pixels(stills[k])).all()
        assert got[2 * k + 1][..., :3].tobytes() == payloads[k]


@pytest.mark.parametrize("spoil", [lambda f: b"", lambda f: f[:30], lambda f: f[:-20], lambda f: b"RIFX" + f[4:], lambda f: f[:20] + b"\x00" + f[21:], lambda f: f[:24] + b"\xff" + f[25:]])
def test_broken_files_raise(spoil):
    with pytest.raises(webp.WebPError):
        webp.decode_files([spoil(image(noise(12, 12)))])
