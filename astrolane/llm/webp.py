"""Lossless WebP (VP8L, RFC 9649): a decoder to pixel arrays and the encoder that media columns are written with.

Prefix codes are decoded for a whole image at once: the symbol and the length of the code that would start at every
bit are looked up with array operations, which gives the position after each token; following those positions
(eight tokens a step, by composing the array with itself) finds the tokens that are really there.  Images with
several prefix-code groups or with a colour cache depend on what came before and are read token by token.
"""

from __future__ import annotations

import hashlib
import heapq
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import text_or_empty

#: Fixed values of the format: order of code-length codes, and the near pixels that distance codes 1 to 120 mean.
CODE_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
NEAR = (
    (0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2), (0, 3), (3, 0), (1, 3), (-1, 3), (3, 1), (-3, 1), (2, 3), (-2, 3),
    (3, 2), (-3, 2), (0, 4), (4, 0), (1, 4), (-1, 4), (4, 1), (-4, 1), (3, 3), (-3, 3), (2, 4), (-2, 4), (4, 2), (-4, 2), (0, 5), (3, 4), (-3, 4), (4, 3), (-4, 3), (5, 0),
    (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5), (-2, 5), (5, 2), (-5, 2), (4, 4), (-4, 4), (3, 5), (-3, 5), (5, 3), (-5, 3), (0, 6), (6, 0), (1, 6), (-1, 6), (6, 1), (-6, 1),
    (2, 6), (-2, 6), (6, 2), (-6, 2), (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6), (6, 3), (-6, 3), (0, 7), (7, 0), (1, 7), (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1),
    (4, 6), (-4, 6), (6, 4), (-6, 4), (2, 7), (-2, 7), (7, 2), (-7, 2), (3, 7), (-3, 7), (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5), (8, 0), (4, 7), (-4, 7), (7, 4),
    (-7, 4), (8, 1), (8, 2), (6, 6), (-6, 6), (8, 3), (5, 7), (-5, 7), (7, 5), (-7, 5), (8, 4), (6, 7), (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7),
)
CACHE_FACTOR = 0x1E35A7BD
ROW = 192
MAX_SIDE = 1 << 14
PREDICTOR, CROSS_COLOUR, SUBTRACT_GREEN, PALETTE = range(4)


class CorruptImage(ValueError):
    pass


class Bits:
    """Reads numbers from the least significant bit on."""

    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at, self.end = data, at, 8 * len(data)

    def read(self, n: int) -> int:
        at = self.at
        self.at = at + n
        if self.at > self.end:
            raise CorruptImage("the image ends early")
        return int.from_bytes(self.data[at >> 3 : (at + n + 7) >> 3], "little") >> (at & 7) & ((1 << n) - 1)


class PrefixCode:
    """Lookup tables by the next `depth` bits: symbol and code length.  One symbol alone takes no bits."""

    def __init__(self, lengths: np.ndarray):
        used = np.flatnonzero(lengths)
        if not len(used):
            used, lengths = np.array([0]), np.zeros(1, np.int64)
        if len(used) == 1:
            self.depth, self.symbols, self.lengths = 0, np.array([used[0]], np.int32), np.zeros(1, np.int32)
            return
        self.depth = int(lengths.max())
        self.symbols, self.lengths = np.zeros(1 << self.depth, np.int32), np.zeros(1 << self.depth, np.int32)
        filled = 0
        for symbol, n, code in zip(used.tolist(), lengths[used].tolist(), canonical(lengths)[used].tolist(), strict=True):
            self.symbols[code :: 1 << n] = symbol
            self.lengths[code :: 1 << n] = n
            filled += 1 << (self.depth - n)
        if filled != 1 << self.depth:
            raise CorruptImage("a prefix code is not complete")

    def next(self, bits: Bits) -> int:
        if not self.depth:
            return int(self.symbols[0])
        at = bits.at
        look = int.from_bytes(bits.data[at >> 3 : (at >> 3) + 3], "little") >> (at & 7) & ((1 << self.depth) - 1)
        bits.at = at + int(self.lengths[look])
        if bits.at > bits.end:
            raise CorruptImage("the image ends early")
        return int(self.symbols[look])


@lru_cache(maxsize=512)
def _small_code(lengths: bytes) -> PrefixCode:
    return PrefixCode(np.frombuffer(lengths, np.uint8).astype(np.int64))


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Codes in the order in which their bits are stored."""
    out, code, last = np.zeros(len(lengths), np.int64), 0, 0
    used = np.flatnonzero(lengths)
    for symbol in used[np.argsort(lengths[used], kind="stable")].tolist():
        n = int(lengths[symbol])
        code <<= n - last
        last = n
        out[symbol] = int(f"{code:0{n}b}"[::-1], 2)
        code += 1
    return out


def read_code(bits: Bits, alphabet: int) -> PrefixCode:
    lengths = np.zeros(alphabet, np.int64)
    if bits.read(1):
        two, wide = bits.read(1), bits.read(1)
        symbols = [bits.read(8 if wide else 1)] + ([bits.read(8)] if two else [])
        if max(symbols) >= alphabet:
            raise CorruptImage("a symbol outside of its alphabet")
        lengths[symbols] = 1
        return _small_code(lengths[: max(symbols) + 1].astype(np.uint8).tobytes())
    meta = np.zeros(19, np.uint8)
    for i in range(bits.read(4) + 4):
        meta[CODE_ORDER[i]] = bits.read(3)
    code = _small_code(meta.tobytes())
    left = 2 + bits.read(2 + 2 * bits.read(3)) if bits.read(1) else alphabet
    at, last = 0, 8
    while at < alphabet and left:
        left -= 1
        s = code.next(bits)
        if s < 16:
            lengths[at] = s
            at, last = at + 1, s or last
        else:
            n, value = (3 + bits.read(2), last) if s == 16 else (3 + bits.read(3), 0) if s == 17 else (11 + bits.read(7), 0)
            if at + n > alphabet:
                raise CorruptImage("code lengths run over the alphabet")
            lengths[at : at + n] = value
            at += n
    return PrefixCode(lengths)


def prefixed(prefix: int, bits: Bits) -> int:
    if prefix < 4:
        return prefix + 1
    extra = (prefix - 2) >> 1
    return ((2 + (prefix & 1)) << extra) + bits.read(extra) + 1


def distance_of(code: int, width: int) -> int:
    if code > len(NEAR):
        return code - len(NEAR)
    dx, dy = NEAR[code - 1]
    return max(1, dx + dy * width)


def read_image(bits: Bits, width: int, height: int, main: bool) -> np.ndarray:
    """Entropy-coded pixels as uint32 ARGB."""
    cache_bits = bits.read(4) if bits.read(1) else 0
    if cache_bits > 11:
        raise CorruptImage("colour cache too large")
    groups_of, side = None, 0
    n_groups = 1
    if main and bits.read(1):
        side = bits.read(3) + 2
        across = -(-width >> side)
        groups_of = (read_image(bits, across, -(-height >> side), False) >> 8) & 0xFFFF
        groups_of = groups_of.reshape(-1, across)
        n_groups = int(groups_of.max()) + 1
    sizes = (256 + 24 + (1 << cache_bits if cache_bits else 0), 256, 256, 256, 40)
    groups = [[read_code(bits, n) for n in sizes] for _ in range(n_groups)]
    if n_groups == 1 and not cache_bits:
        return _read_at_once(bits, groups[0], width, width * height)
    return _read_in_turn(bits, groups, groups_of, side, cache_bits, width, width * height)


def _read_in_turn(bits, groups, groups_of, side, cache_bits, width, total):
    out = np.zeros(total, np.uint32)
    cache, shift, cached = [0] * (1 << cache_bits), 32 - cache_bits, 0
    at = 0
    while at < total:
        group = groups[0] if groups_of is None else groups[int(groups_of[at // width >> side, at % width >> side])]
        s = group[0].next(bits)
        if s < 256:
            red, blue, alpha = (group[i].next(bits) for i in (1, 2, 3))
            out[at] = alpha << 24 | red << 16 | s << 8 | blue
            at += 1
        elif s < 280:
            n = prefixed(s - 256, bits)
            back = distance_of(prefixed(group[4].next(bits), bits), width)
            if back > at or at + n > total:
                raise CorruptImage("a reference outside of the image")
            for i in range(at, at + n):
                out[i] = out[i - back]
            at += n
        else:
            while cached < at:
                cache[(CACHE_FACTOR * int(out[cached]) & 0xFFFFFFFF) >> shift] = int(out[cached])
                cached += 1
            out[at] = cache[s - 280]
            at += 1
    return out


def _read_at_once(bits, group, width, total):
    if not any(code.depth for code in group[:4]):  # pixels of no bits: all the same
        green, red, blue, alpha = (int(code.symbols[0]) for code in group[:4])
        if green >= 256:
            raise CorruptImage("a reference outside of the image")
        return np.full(total, alpha << 24 | red << 16 | green << 8 | blue, np.uint32)
    data = np.frombuffer(bits.data[bits.at >> 3 :] + b"\0\0\0\0", np.uint8).astype(np.int32)
    words = data[:-3] | data[1:-2] << 8 | data[2:-1] << 16
    n = 8 * (len(words) - 1)
    first = bits.at & 7
    look = (words[:-1, None] >> np.arange(8, dtype=np.int32)).ravel()  # at least 17 bits from every position on
    here = np.arange(n, dtype=np.int32)
    pad = np.zeros(1, np.int32)

    def table(code: PrefixCode, at):
        part = look[np.minimum(at, n - 1)] & ((1 << code.depth) - 1)
        return code.symbols[part], at + code.lengths[part]

    green, after = table(group[0], here)
    literal_end, others = after, []
    for code in group[1:4]:
        if code.depth:
            symbols, literal_end = table(code, literal_end)
        else:
            symbols = int(code.symbols[0])
        others.append(symbols)
    follow, count, backs = literal_end, None, None
    ref = np.flatnonzero(green >= 256).astype(np.int32) if int(group[0].symbols.max()) >= 256 else pad[:0]
    if len(ref):
        follow, count = literal_end.copy(), np.ones(n, np.int64)

        def value(prefix, at):
            extra = np.where(prefix < 4, 0, (prefix - 2) >> 1)
            wide = words[np.minimum(at >> 3, len(words) - 1)].astype(np.int64) | data[np.minimum((at >> 3) + 3, len(data) - 1)].astype(np.int64) << 24
            base = np.where(prefix < 4, prefix, (2 + (prefix & 1)) << extra)
            return base + ((wide >> (at & 7)) & ((1 << extra) - 1)) + 1, at + extra

        length, at = value(green[ref].astype(np.int64) - 256, after[ref])
        prefix, at = table(group[4], at)
        codes, at = value(prefix.astype(np.int64), at)
        follow[ref], count[ref] = at, length
        backs = np.zeros(n, np.int64)
        backs[ref] = codes
    hop = np.concatenate([np.minimum(follow, n), pad + n]).astype(np.int32)
    far = hop
    for _ in range(3):
        far = far[far]
    steps, at, jumps = [], first, memoryview(far)
    while at < n:
        steps.append(at)
        at = jumps[at]
    tokens = np.empty((len(steps), 8), np.int32)
    tokens[:, 0] = steps
    for i in range(1, 8):
        tokens[:, i] = hop[tokens[:, i - 1]]
    tokens = tokens.ravel()
    tokens = tokens[: int(np.searchsorted(tokens, n))] if len(tokens) and tokens[-1] >= n else tokens
    ends = np.arange(1, len(tokens) + 1) if count is None else np.cumsum(count[tokens])
    used = int(np.searchsorted(ends, total)) + 1
    if used > len(tokens) or ends[used - 1] != total:
        raise CorruptImage("the image ends early")
    tokens, ends = tokens[:used], ends[:used]
    stop = int(follow[tokens[-1]])
    if stop > n:
        raise CorruptImage("the image ends early")
    bits.at = (bits.at & ~7) + stop
    channels = [np.uint32(x) if isinstance(x, int) else x[tokens].astype(np.uint32) for x in others]
    literal = channels[2] << np.uint32(24) | channels[0] << np.uint32(16) | green[tokens].astype(np.uint32) << np.uint32(8) | channels[1]
    special = np.flatnonzero(green[tokens] >= 256) if count is not None else ()
    if not len(special):
        return literal
    out, done = np.zeros(total, np.uint32), 0
    for i in special.tolist():
        begin, end = int(ends[i - 1]) if i else 0, int(ends[i])
        out[begin - (i - done) : begin] = literal[done:i]
        back = distance_of(int(backs[tokens[i]]), width)
        if back > begin:
            raise CorruptImage("a reference outside of the image")
        if back >= end - begin:
            out[begin:end] = out[begin - back : end - back]
        else:
            out[begin:end] = np.resize(out[begin - back : begin], end - begin)
        done = i + 1
    if done < used:
        out[total - (used - done) :] = literal[done:]
    return out


def _channels(argb: np.ndarray) -> np.ndarray:
    return argb.astype("<u4").view(np.uint8).reshape(*argb.shape, 4)  # blue, green, red, alpha


def _argb(channels: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(channels.astype(np.uint8)).view("<u4").reshape(channels.shape[:-1])


def predicted(mode: int, left, top, right, corner):
    """The prediction of each channel (int arrays of 4) from the pixels to the left, above, above right, above left."""
    half = lambda a, b: (a + b) >> 1
    if mode == 11:
        towards_left, towards_top = np.abs(top - corner).sum(-1, keepdims=True), np.abs(left - corner).sum(-1, keepdims=True)
        return np.where(towards_left < towards_top, left, top)
    if mode == 12:
        return np.clip(left + top - corner, 0, 255)
    if mode == 13:
        mean = half(left, top)
        step = mean - corner
        return np.clip(mean + np.sign(step) * (np.abs(step) >> 1), 0, 255)
    simple = {1: lambda: left, 2: lambda: top, 3: lambda: right, 4: lambda: corner, 5: lambda: half(half(left, right), top), 6: lambda: half(left, corner), 7: lambda: half(left, top), 8: lambda: half(corner, top), 9: lambda: half(top, right), 10: lambda: half(half(left, corner), half(top, right))}
    return simple[mode]() if mode in simple else np.array([0, 0, 0, 255])


def undo_predictor(argb: np.ndarray, modes: np.ndarray, side: int) -> np.ndarray:
    """Rows in turn; within a row runs of one mode at once where the mode does not look to the left."""
    height, width = argb.shape
    rest = _channels(argb).astype(np.int64)
    out = np.zeros((height, width, 4), np.int64)
    rest[0, 0, 3] += 255
    out[0] = np.cumsum(rest[0], axis=0) & 255
    for y in range(1, height):
        above, row = out[y - 1], out[y]
        row[0] = (rest[y, 0] + above[0]) & 255
        x = 1
        while x < width:
            mode = int(modes[y >> side, x >> side])
            end = min(width, ((x >> side) + 1) << side)
            if mode in (2, 3, 4, 8, 9) or mode in (0, 14, 15):
                right = np.concatenate([above[x + 1 : end + 1], row[:1]])[: end - x]
                row[x:end] = (rest[y, x:end] + predicted(mode, None, above[x:end], right, above[x - 1 : end - 1])) & 255
            elif mode == 1:
                row[x:end] = (np.cumsum(rest[y, x:end], axis=0) + row[x - 1]) & 255
            else:
                for i in range(x, end):
                    right = above[i + 1] if i + 1 < width else row[0]
                    row[i] = (rest[y, i] + predicted(mode, row[i - 1], above[i], right, above[i - 1])) & 255
            x = end
    return _argb(out)


def undo_cross_colour(argb: np.ndarray, elements: np.ndarray, side: int, sign: int = 1) -> np.ndarray:
    """sign 1 decodes; -1 is the encoder's side."""
    height, width = argb.shape
    signed = lambda x: x.astype(np.int8).astype(np.int64)
    blocks = _channels(elements)[np.arange(height)[:, None] >> side, np.arange(width)[None, :] >> side]
    green_to_red, green_to_blue, red_to_blue = (signed(blocks[..., i]) for i in range(3))
    c = _channels(argb).astype(np.int64)
    green, red_in = signed(c[..., 1]), c[..., 2].copy()
    red = (c[..., 2] + sign * (green_to_red * green >> 5)) & 255
    blue = c[..., 0] + sign * (green_to_blue * green >> 5)
    blue = blue + sign * (red_to_blue * signed(red if sign > 0 else red_in) >> 5)
    c[..., 2], c[..., 0] = red, blue & 255
    return _argb(c)


def undo_green(argb: np.ndarray) -> np.ndarray:
    c = _channels(argb).copy()
    c[..., 0] += c[..., 1]
    c[..., 2] += c[..., 1]
    return _argb(c)


def palette_bits(size: int) -> int:
    return 3 if size <= 2 else 2 if size <= 4 else 1 if size <= 16 else 0


def undo_palette(argb: np.ndarray, colours: np.ndarray, width: int) -> np.ndarray:
    b = palette_bits(len(colours))
    packed = (argb >> 8) & 255
    if b:
        depth = 8 >> b
        packed = ((packed[..., None] >> (np.arange(1 << b) * depth).astype(np.uint32)) & ((1 << depth) - 1)).reshape(len(argb), -1)[:, :width]
    return np.append(colours, np.zeros(256 - len(colours), np.uint32))[packed].astype(np.uint32)


def decode(data: bytes) -> np.ndarray:
    """A lossless WebP file -> (height, width, 4) array of red, green, blue, alpha."""
    if data[:4] != b"RIFF" or data[8:16] != b"WEBPVP8L" or len(data) < 8 + int.from_bytes(data[4:8], "little"):
        raise CorruptImage("not a lossless WebP file")
    stream = data[20 : 20 + int.from_bytes(data[16:20], "little")]
    bits = Bits(stream)
    if bits.read(8) != 0x2F:
        raise CorruptImage("bad signature")
    width, height = bits.read(14) + 1, bits.read(14) + 1
    bits.read(1)
    if bits.read(3):
        raise CorruptImage("unknown version")
    transforms, across = [], width
    while bits.read(1):
        kind = bits.read(2)
        if kind in [t[0] for t in transforms]:
            raise CorruptImage("a transform is there twice")
        if kind in (PREDICTOR, CROSS_COLOUR):
            side = bits.read(3) + 2
            columns = -(-across >> side)
            transforms.append((kind, read_image(bits, columns, -(-height >> side), False).reshape(-1, columns), side))
        elif kind == PALETTE:
            deltas = read_image(bits, bits.read(8) + 1, 1, False)
            colours = _argb(np.cumsum(_channels(deltas), axis=0) & 255)
            transforms.append((kind, colours, across))
            across = -(-across >> palette_bits(len(colours)))
        else:
            transforms.append((kind, None, 0))
    argb = read_image(bits, across, height, True).reshape(height, across)
    for kind, more, number in reversed(transforms):
        if kind == PREDICTOR:
            argb = undo_predictor(argb, (more >> 8) & 255, number)
        elif kind == CROSS_COLOUR:
            argb = undo_cross_colour(argb, more, number)
        elif kind == SUBTRACT_GREEN:
            argb = undo_green(argb)
        else:
            argb = undo_palette(argb, more, number)
    return _channels(argb)[..., [2, 1, 0, 3]]


def code_lengths(counts: np.ndarray, most: int = 15) -> np.ndarray:
    """Huffman code lengths of at most `most` bits; rare symbols are made commoner until they fit."""
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.int64)
    if len(used) < 2:
        lengths[used] = 1
        return lengths
    weights = counts[used].astype(np.int64)
    while True:
        heap = [(w, i) for i, w in enumerate(weights.tolist())]
        heapq.heapify(heap)
        parent = [0] * (2 * len(used) - 1)
        for node in range(len(used), 2 * len(used) - 1):
            a, i = heapq.heappop(heap)
            b, j = heap[0]
            parent[i] = parent[j] = node
            heapq.heapreplace(heap, (a + b, node))
        depth = [0] * len(parent)
        for node in range(len(parent) - 2, -1, -1):
            depth[node] = depth[parent[node]] + 1
        found = np.array(depth[: len(used)])
        if found.max() <= most:
            lengths[used] = found
            return lengths
        weights = weights // 2 + 1


class BitWriter:
    def __init__(self):
        self.values: list[np.ndarray] = []
        self.widths: list[np.ndarray] = []

    def put(self, value: int, width: int) -> None:
        self.values.append(np.array([value], np.int64))
        self.widths.append(np.array([width], np.int64))

    def put_all(self, values: np.ndarray, widths: np.ndarray) -> None:
        self.values.append(values)
        self.widths.append(widths)

    def bytes(self) -> bytes:
        values, widths = np.concatenate(self.values), np.concatenate(self.widths)
        ends = np.cumsum(widths)
        within = np.arange(int(ends[-1])) - np.repeat(ends - widths, widths)
        return np.packbits(((np.repeat(values, widths) >> within) & 1).astype(np.uint8), bitorder="little").tobytes()


#: Code lengths of the code-length alphabet as this encoder writes them: 0-13 in four bits, 14, 15, 17 and 18 in five.
_META = np.array([4] * 14 + [5, 5, 0, 5, 5])
_META_CODES = canonical(_META)


def put_code(out: BitWriter, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Write a prefix code for symbols with these counts; gives codes and their lengths."""
    used = np.flatnonzero(counts)
    if len(used) < 2 and (not len(used) or used[0] < 256):
        symbol = int(used[0]) if len(used) else 0
        out.put(1 | 1 << 2 | symbol << 3, 11)
        return np.zeros(len(counts), np.int64), np.zeros(len(counts), np.int64)
    lengths = code_lengths(counts)
    if len(used) == 1:  # a symbol that the short form cannot name: beside another one
        lengths[0] = 1
    codes = canonical(lengths)
    out.put((19 - 4) << 1, 5)
    for s in CODE_ORDER:
        out.put(int(_META[s]), 3)
    out.put(0, 1)
    at, n, flat = 0, len(counts), lengths.tolist()
    values, widths = [], []
    while at < n:
        if flat[at]:
            values.append(int(_META_CODES[flat[at]]))
            widths.append(int(_META[flat[at]]))
            at += 1
            continue
        run = 1
        while at + run < n and run < 138 and not flat[at + run]:
            run += 1
        if run < 3:
            run = 1
            values.append(int(_META_CODES[0]))
            widths.append(4)
        else:
            s, extra, base = (17, 3, 3) if run < 11 else (18, 7, 11)
            values.append(int(_META_CODES[s]) | (run - base) << 5)
            widths.append(5 + extra)
        at += run
    out.put_all(np.array(values), np.array(widths))
    return codes, lengths


def prefix_of(value: int) -> tuple[int, int, int]:
    """Prefix symbol, extra bits and their number, of a length or distance code from 1."""
    v = value - 1
    if v < 4:
        return v, 0, 0
    top = v.bit_length() - 1
    second = v >> (top - 1) & 1
    return 2 * top + second, v & ((1 << (top - 1)) - 1), top - 1


def long_runs(samples: np.ndarray, least: int = 16) -> list[tuple[int, int]]:
    """(position, length) where at least `least` samples repeat the one before."""
    same = np.concatenate([[False], samples[1:] == samples[:-1], [False]])
    edges = np.flatnonzero(same[1:] != same[:-1]) + 1
    return [(at, min(4096, end - at)) for begin, end in edges.reshape(-1, 2).tolist() if end - begin >= least for at in range(begin, end, 4096)]


def encode_grey(samples: np.ndarray, width: int) -> bytes:
    """8-bit samples, rows of `width`, as a lossless WebP with equal channels: red and blue vanish by the
    subtract-green transform, long runs become references to the pixel before."""
    height = len(samples) // width
    if not (1 <= width <= MAX_SIDE and 1 <= height <= MAX_SIDE) or width * height != len(samples):
        raise ValueError("samples do not fill an image of an allowed size")
    out = BitWriter()
    out.put(0x2F | (width - 1) << 8 | (height - 1) << 22, 8 + 14 + 14 + 1 + 3)
    out.put(1 | SUBTRACT_GREEN << 1, 4)  # a transform, then no more; no colour cache
    out.put(0, 2)
    runs = long_runs(samples)
    keep = np.ones(len(samples), bool)
    symbols, extra_value, extra_width = samples.astype(np.int64), None, None
    if runs:
        at = np.array([a for a, _ in runs])
        prefixes = [prefix_of(n) for _, n in runs]
        for a, n in runs:
            keep[a + 1 : a + n] = False
        symbols[at] = [256 + p[0] for p in prefixes]
        extra_value, extra_width = np.zeros(len(samples), np.int64), np.zeros(len(samples), np.int64)
        extra_value[at], extra_width[at] = [p[1] for p in prefixes], [p[2] for p in prefixes]
    symbols = symbols[keep]
    codes, lengths = put_code(out, np.bincount(symbols, minlength=280))
    for symbol in (0, 0, 255, 1):  # red, blue and alpha are constant; every reference has distance code 2, the pixel before
        out.put(1 | 1 << 2 | symbol << 3, 11)
    values, widths = codes[symbols], lengths[symbols]
    if runs:
        values = values | extra_value[keep] << widths
        widths = widths + extra_width[keep]
    out.put_all(values, widths)
    data = out.bytes()
    pad = len(data) & 1
    return b"RIFF" + (12 + len(data) + pad).to_bytes(4, "little") + b"WEBPVP8L" + len(data).to_bytes(4, "little") + data + b"\0" * pad


def encode_payload(payload: bytes, row: int = ROW) -> bytes:
    """A payload of whole rows as one image, or as several one behind another where it is higher than the format allows."""
    samples = np.frombuffer(payload, np.uint8)
    most = row * (MAX_SIDE - 1)
    return b"".join(encode_grey(samples[at : at + most], row) for at in range(0, len(samples), most))


def images_of(media: bytes) -> list[np.ndarray]:
    out, at = [], 0
    while at < len(media):
        size = 8 + int.from_bytes(media[at + 4 : at + 8], "little")
        out.append(decode(media[at : at + size]))
        at += size
    return out


def payload_of(images: list[np.ndarray]) -> bytes:
    for x in images:
        if not ((x[..., 0] == x[..., 1]).all() and (x[..., 1] == x[..., 2]).all()):
            raise CorruptImage("channels differ")
    return b"".join(np.ascontiguousarray(x[..., 1]).tobytes() for x in images)


def features_of(images: list[np.ndarray]) -> str:
    """Size, sum, sum of squares, sum of steps to the right, and used levels of the grey values: whole numbers only."""
    grey = [x[..., 1].astype(np.int64) for x in images]
    total, squares, steps = (int(sum(f(g).sum() for g in grey)) for f in (lambda g: g, lambda g: g * g, lambda g: np.abs(np.diff(g, axis=1))))
    levels = len(np.unique(np.concatenate([np.unique(g) for g in grey])))
    return f"w={images[0].shape[1]};h={sum(len(g) for g in grey)};sum={total};sq={squares};dx={steps};levels={levels}"


def store_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", row: int = ROW) -> DataFrame:
    """id_col, n_bytes and media: each whole text (null: empty) in UTF-8, filled up with spaces to whole rows, as WebP."""
    schema = T.StructType([docs.schema[id_col], T.StructField("n_bytes", T.LongType()), T.StructField("media", T.BinaryType())])

    def run(batches):
        for batch in batches:
            seen: dict[str, tuple[int, bytes]] = {}
            for text in batch.column(1).to_pylist():
                if text not in seen:
                    data = text.encode("utf-8", "surrogatepass")
                    seen[text] = (len(data), encode_payload(data + b" " * (-len(data) % row if data else row), row))
            pairs = [seen[t] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.binary())], names=[id_col, "n_bytes", "media"])

    return docs.select(id_col, text_or_empty(text_col).alias("text")).mapInArrow(run, schema)


def read_media(stored: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Decode the media column: payload (bytes), media_bytes, media_sha256 and feature."""
    schema = T.StructType([stored.schema[id_col], T.StructField("n_bytes", T.LongType()), T.StructField("payload", T.BinaryType()), T.StructField("media_bytes", T.LongType()), T.StructField("media_sha256", T.StringType()), T.StructField("feature", T.StringType())])

    def run(batches):
        for batch in batches:
            seen: dict[bytes, tuple] = {}
            rows = []
            for media in batch.column(2).to_pylist():
                if media not in seen:
                    images = images_of(media)
                    seen[media] = (payload_of(images), len(media), hashlib.sha256(media).hexdigest(), features_of(images))
                rows.append(seen[media])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.binary(), pa.int64(), pa.string(), pa.string())))], names=[f.name for f in schema.fields])

    return stored.mapInArrow(run, schema)


def digests(read: DataFrame, id_col: str = "doc_id", tail: int = 16) -> DataFrame:
    payload = F.col("payload")
    return read.select(id_col, "n_bytes", F.octet_length(payload).cast("long").alias("payload_bytes"), F.sha2(payload, 256).alias("payload_sha256"), F.crc32(F.substring(payload, -tail, tail)).alias("tail_crc32"), "media_bytes", "media_sha256", "feature")


