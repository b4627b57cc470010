"""Ids of distinct chunks of text, held by a worker up to a bound."""

from __future__ import annotations

import zlib
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

MAX_HELD = 300_000  # chunks, some 180 bytes each; workers keep them from task to task
BATCH_BYTES = 4 << 20


class Grown:
    """An array that doubles its room."""

    def __init__(self, kind):
        self.room, self.n = np.zeros(1 << 16, kind), 0

    def add(self, values: np.ndarray) -> None:
        n = self.n + len(values)
        if n > len(self.room):
            room = np.zeros(max(n, 2 * len(self.room)), self.room.dtype)
            room[: self.n] = self.room[: self.n]
            self.room = room
        self.room[self.n : n] = values
        self.n = n


def spans(begin: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """begin, begin + 1, ... begin + length - 1 of every span, one after another."""
    ends = np.cumsum(lengths, dtype=np.int64)
    return np.repeat(begin - (ends - lengths), lengths) + np.arange(int(ends[-1]) if len(ends) else 0)


class HeldChunks:
    """Chunk -> its ids and a flag.  learn(chunks) of a subclass adds distinct new chunks."""

    def __init__(self):
        self.clear()

    def make_room(self) -> None:
        """Beyond the bound, keep the chunks that most batches held, at most half of what there is room for."""
        if len(self.held) <= MAX_HELD:
            return
        used = self.used.room[: self.used.n]
        least = max(2, int(np.partition(used, -(MAX_HELD // 2))[-(MAX_HELD // 2)]) + 1)
        kept = np.flatnonzero(used >= least)
        names = np.array(list(self.held), object)[kept]
        ids, sizes, flags = self.pool.room[spans(self.begin.room[kept], self.size.room[kept])], self.size.room[kept], self.flag.room[kept]
        self.clear()
        self.add(names.tolist(), ids, sizes, flags)

    def clear(self) -> None:
        self.held: dict[str, int] = {}
        self.pool, self.begin, self.size, self.used, self.flag = Grown(np.uint32), Grown(np.int64), Grown(np.int32), Grown(np.int32), Grown(bool)

    def add(self, chunks: list[str], ids: np.ndarray, sizes: np.ndarray, flags: np.ndarray | None = None) -> None:
        self.held.update(zip(chunks, range(len(self.held), len(self.held) + len(chunks)), strict=True))
        self.begin.add(self.pool.n + np.cumsum(sizes, dtype=np.int64) - sizes)
        self.size.add(sizes)
        self.used.add(np.zeros(len(sizes), np.int32))
        self.pool.add(ids)
        self.flag.add(np.ones(len(sizes), bool) if flags is None else flags)

    def ids_of(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the chunks at these places, one after another, and their numbers."""
        lengths = self.size.room[at]
        return self.pool.room[spans(self.begin.room[at], lengths)], lengths

    def numbers(self, chunks: list[str], distinct: bool = False) -> np.ndarray:
        """Places of chunks, learning the new ones."""
        at = np.fromiter(map(self.held.get, chunks, repeat(-1)), np.int64, len(chunks))
        new = np.flatnonzero(at < 0)
        if len(new):
            names = [chunks[i] for i in new.tolist()]
            self.learn(names if distinct else list(dict.fromkeys(names)))
            at[new] = np.fromiter(map(self.held.__getitem__, names), np.int64, len(names))
        self.used.room[at] += 1
        return at


def parts_of(texts: pa.Array):
    """Slices of about BATCH_BYTES bytes."""
    of = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)) // BATCH_BYTES
    borders = [0, *(np.flatnonzero(np.diff(of)) + 1).tolist(), len(texts)]
    return [texts.slice(a, b - a) for a, b in zip(borders[:-1], borders[1:], strict=True) if a < b]


def split_at_spaces(texts: pa.Array) -> tuple[pa.Array, list[str], np.ndarray, np.ndarray]:
    """Distinct chunks (a column, and a list), the number of each chunk's text in it, and where each text's chunks stop."""
    lists = pc.split_pattern(texts, " ")
    stops = lists.offsets.to_numpy().astype(np.int64)
    coded = lists.flatten().dictionary_encode()
    return coded.dictionary, coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy(), stops - stops[0]


def ended(ids: np.ndarray, counts: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and numbers of ids with end_id after each text."""
    out = np.full(len(ids) + len(counts), end_id, "<u4")
    out[np.arange(len(ids)) + np.repeat(np.arange(len(counts)), counts)] = ids
    return out, counts + 1


def checksums(ids: np.ndarray, stops: np.ndarray, lengths: np.ndarray) -> list[int]:
    """CRC-32 of the ids before each stop, as little-endian 32-bit numbers."""
    data = memoryview(ids.astype("<u4", copy=False)).cast("B")
    return [zlib.crc32(data[4 * (b - n) : 4 * b]) for b, n in zip(stops.tolist(), lengths.tolist(), strict=True)]
