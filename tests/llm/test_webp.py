"""The decoder on streams that use every part of the format, written by a plain encoder."""

import numpy as np
import pytest

from astrolane.llm import webp


def put_image(out, argb, main=False, cache_bits=0, groups=None, side=2, copies=True):
    """argb (h, w) -> entropy-coded pixels: colour cache, copies of the row above or of earlier pixels, code groups."""
    height, width = argb.shape
    flat = argb.ravel().tolist()
    out.put(1 if cache_bits else 0, 1)
    if cache_bits:
        out.put(cache_bits, 4)
    if main:
        out.put(0 if groups is None else 1, 1)
        if groups is not None:
            out.put(side - 2, 3)
            put_image(out, (groups.astype(np.uint32) << 8) | 0xFF000000, copies=False)
    n_groups = 1 if groups is None else int(groups.max()) + 1
    tokens, cache, at = [], {}, 0  # (group, [(alphabet, symbol, extra value, extra width)])
    while at < len(flat):
        g = 0 if groups is None else int(groups[at // width >> side, at % width >> side])
        best = (0, 0)
        if copies:
            for back in (1, width, width + 1, 5, 200):
                n = 0
                while back <= at and at + n < len(flat) and n < 4096 and flat[at + n] == flat[at + n - back]:
                    n += 1
                best = max(best, (n, back))
        key = (webp.CACHE_FACTOR * flat[at] & 0xFFFFFFFF) >> (32 - cache_bits) if cache_bits else None
        if best[0] >= 4:
            n, back = best
            code = next((i + 1 for i, (dx, dy) in enumerate(webp.NEAR) if dx + dy * width == back), back + len(webp.NEAR))
            s, v, w = webp.prefix_of(n)
            s2, v2, w2 = webp.prefix_of(code)
            tokens.append((g, [(0, 256 + s, v, w), (4, s2, v2, w2)]))
        elif cache_bits and cache.get(key) == flat[at]:
            n = 1
            tokens.append((g, [(0, 280 + key, 0, 0)]))
        else:
            n, p = 1, flat[at]
            tokens.append((g, [(0, p >> 8 & 255, 0, 0), (1, p >> 16 & 255, 0, 0), (2, p & 255, 0, 0), (3, p >> 24, 0, 0)]))
        for p in flat[at : at + n]:
            if cache_bits:
                cache[(webp.CACHE_FACTOR * p & 0xFFFFFFFF) >> (32 - cache_bits)] = p
        at += n
    sizes = (280 + (1 << cache_bits if cache_bits else 0), 256, 256, 256, 40)
    codes = []
    for g in range(n_groups):
        counts = [np.zeros(n, np.int64) for n in sizes]
        for own, parts in tokens:
            if own == g:
                for alphabet, symbol, _, _ in parts:
                    counts[alphabet][symbol] += 1
        codes.append([webp.put_code(out, c) for c in counts])
    for g, parts in tokens:
        for alphabet, symbol, value, width_ in parts:
            code, lengths = codes[g][alphabet]
            out.put(int(code[symbol]), int(lengths[symbol]))
            out.put(value, width_)


def encode(argb, steps=(), **options):
    height, width = argb.shape
    out = webp.BitWriter()
    out.put(0x2F, 8)
    out.put(width - 1, 14)
    out.put(height - 1, 14)
    out.put(1, 1)
    out.put(0, 3)
    for kind, *more in steps:
        out.put(1 | kind << 1, 3)
        if kind == webp.PREDICTOR:
            modes, side = more
            out.put(side - 2, 3)
            put_image(out, (modes.astype(np.uint32) << 8) | 0xFF000000)
            c = webp._channels(argb).astype(np.int64)
            rest = np.zeros_like(c)
            for y in range(height):
                for x in range(argb.shape[1]):
                    if y == 0:
                        guess = c[0, x - 1] if x else np.array([0, 0, 0, 255])
                    elif x == 0:
                        guess = c[y - 1, 0]
                    else:
                        right = c[y - 1, x + 1] if x + 1 < argb.shape[1] else c[y, 0]
                        guess = webp.predicted(int(modes[y >> side, x >> side]), c[y, x - 1], c[y - 1, x], right, c[y - 1, x - 1])
                    rest[y, x] = (c[y, x] - guess) & 255
            argb = webp._argb(rest)
        elif kind == webp.CROSS_COLOUR:
            elements, side = more
            out.put(side - 2, 3)
            put_image(out, elements)
            argb = webp.undo_cross_colour(argb, elements, side, sign=-1)
        elif kind == webp.SUBTRACT_GREEN:
            c = webp._channels(argb).copy()
            c[..., 0] -= c[..., 1]
            c[..., 2] -= c[..., 1]
            argb = webp._argb(c)
        else:
            colours = np.unique(argb)
            out.put(len(colours) - 1, 8)
            deltas = np.diff(webp._channels(colours).astype(np.int64), axis=0, prepend=0) & 255
            put_image(out, webp._argb(deltas)[None])
            index = np.searchsorted(colours, argb)
            b = webp.palette_bits(len(colours))
            pad = -argb.shape[1] % (1 << b)
            index = np.pad(index, ((0, 0), (0, pad))).reshape(height, -1, 1 << b)
            argb = ((index << (np.arange(1 << b) * (8 >> b))).sum(axis=2).astype(np.uint32) << 8) | np.uint32(0xFF000000)
    out.put(0, 1)
    put_image(out, argb, main=True, **options)
    data = out.bytes()
    pad = len(data) & 1
    return b"RIFF" + (12 + len(data) + pad).to_bytes(4, "little") + b"WEBPVP8L" + len(data).to_bytes(4, "little") + data + b"\0" * pad


def picture(height=23, width=37, colours=None, seed=0):
    rng = np.random.default_rng(seed)
    if colours:
        return rng.choice(rng.integers(0, 1 << 32, colours, dtype=np.uint64).astype(np.uint32), (height, width))
    y, x = np.mgrid[:height, :width]
    c = np.stack([x * 5 + y, x + y * 3, x * 2 + rng.integers(0, 9, (height, width)), 255 - y], axis=-1) & 255
    return webp._argb(c)


def check(argb, **kw):
    got = webp.decode(encode(argb, **kw))
    assert (got == webp._channels(argb)[..., [2, 1, 0, 3]]).all()


def blocks(argb, side, low, high, seed=1):
    shape = (-(-argb.shape[0] >> side), -(-argb.shape[1] >> side))
    return np.random.default_rng(seed).integers(low, high, shape)


def test_plain_cache_and_copies():
    for argb in (picture(), picture(colours=3), np.full((9, 200), 0x80402010, np.uint32), picture(1, 1), picture(300, 3, colours=2)):
        check(argb)
        check(argb, cache_bits=4)
        check(argb, copies=False)


@pytest.mark.parametrize("mode", range(14))
def test_each_predictor(mode):
    argb = picture()
    check(argb, steps=[(webp.PREDICTOR, np.full(((23 >> 3) + 1, (37 >> 3) + 1), mode), 3)])


def test_mixed_predictors_and_all_transforms():
    argb = picture()
    modes, elements = blocks(argb, 2, 0, 14), blocks(argb, 3, 0, 1 << 24).astype(np.uint32)
    check(argb, steps=[(webp.PREDICTOR, modes, 2), (webp.CROSS_COLOUR, elements, 3), (webp.SUBTRACT_GREEN,)])
    check(argb, steps=[(webp.CROSS_COLOUR, elements, 3)], cache_bits=6)


@pytest.mark.parametrize("colours", [2, 3, 4, 11, 16, 17, 200])
def test_palettes(colours):
    check(picture(colours=colours, width=37), steps=[(webp.PALETTE,)])


def test_code_groups():
    argb = picture()
    check(argb, groups=blocks(argb, 2, 0, 3), side=2)
    check(argb, groups=blocks(argb, 3, 0, 5), side=3, cache_bits=3, steps=[(webp.SUBTRACT_GREEN,)])


def test_damaged_files_are_noticed():
    data = encode(picture())
    for bad in (data[:-30], b"JUNK" + data[4:], data[:20] + b"\0" + data[21:]):
        with pytest.raises(webp.CorruptImage):
            webp.decode(bad)


def test_long_codes_are_limited():
    lengths = webp.code_lengths(np.array([1, 1] + [2**i for i in range(1, 30)]))
    assert lengths.max() <= 15 and sum(2.0**-n for n in lengths.tolist()) == 1
