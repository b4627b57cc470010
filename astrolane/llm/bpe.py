"""Byte-level BPE ids through the tokenizers library, each distinct chunk of text encoded once.

In a text without two neighbouring white-space characters every space begins a word of the library's pre-tokenizer,
and no word reaches beyond one.  The ids of such a text are those of its first chunk and of each later chunk with
its space.  Arrow cuts texts at spaces and numbers the distinct chunks of a batch; the library is asked only for
chunks that this worker does not hold, all of a batch in one text.  Texts that hold neighbouring white space or an
added token go through the library whole, as do all texts of tokenizers with another pre-tokenizer.  Of new chunks
the library gets the parts before and after line feeds, and before and in the marks at their ends, each distinct one once.
"""

from __future__ import annotations

import json
import os
import re
import string
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .chunks import HeldChunks, parts_of, split_at_spaces

#: Python's class of white space holds all of the library's.
SPACE = re.compile(r"\s")
MARKS = string.punctuation
LATIN = "\u024f"  # up to here all agree on what letters and digits are


def edges(chunks: list[str], column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Whether chunks begin, and whether they end, with white space; empty ones do both."""
    stops = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2] or b"\0", np.uint8)
    some = np.flatnonzero(np.diff(stops))
    out = []
    for at, end in ((stops[:-1], 0), (stops[1:] - 1, -1)):
        flag = np.ones(len(chunks), bool)
        byte = data[at[some]]
        flag[some] = byte <= 32
        for i in some[byte >= 128].tolist():
            flag[i] = chunks[i][end].isspace()
        out.append(flag)
    return out[0], out[1]


def before_marks(chunk: str) -> tuple[str, ...]:
    """The chunk up to the marks at its end, and these; the chunk alone unless a letter or digit stands before them."""
    core = chunk.rstrip(MARKS)
    if len(core) < len(chunk) and core and core[-1] <= LATIN and core[-1].isalnum():
        return core, " " + chunk[len(core) :]
    return (chunk,)


def parts_of_chunks(chunks: list[str]) -> dict[str, tuple[str, ...]]:
    """For chunks that the library's words do not cross at line feeds, or before marks at the end: the chunks they consist of.

    Marks after a letter or digit are one word, and so is a line feed between two others; the words after them have no
    space before them.
    """
    out = {}
    ends = [c.rstrip(MARKS) for c in chunks]
    for c in [c for c, e in zip(chunks, ends, strict=True) if c is not e]:
        found = before_marks(c)
        if len(found) > 1:
            out[c] = found
    for c in [c for c in chunks if "\n" in c]:
        out.pop(c, None)
        first, *others = c.split("\n")
        if c.split() == [first[1:] if first[:1] == " " else first, *others]:
            out[c] = (*before_marks(first), *(y for x in others for y in (" \n", *before_marks(" " + x))))
    return out


class ByteBpe(HeldChunks):
    def __init__(self, path: str):
        os.environ.setdefault("RAYON_NUM_THREADS", "1")  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        config = json.loads(self.tokenizer.to_str())
        cut = config["pre_tokenizer"] or {}
        self.by_chunks = cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space") and not config["normalizer"]
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        vocabulary = self.tokenizer.get_vocab()
        self.spaced = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        for token, i in vocabulary.items():
            self.spaced[i] = token.startswith("Ġ")  # the byte-level alphabet's space
        super().__init__()

    def library(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)

    def learn(self, chunks: list[str]) -> None:
        """Encode new chunks; one with a leading space is a text's first one, others follow a space."""
        parts = parts_of_chunks(chunks)
        if not parts:
            self.ask(chunks)
            return
        held = self.held
        new = dict.fromkeys(x for x in chain.from_iterable(parts.values()) if x not in held)
        new.update(dict.fromkeys(c for c in chunks if c not in parts))
        self.ask(list(new))
        ids, sizes = self.ids_of(np.fromiter(map(held.__getitem__, chain.from_iterable(parts.values())), np.int64))
        ends = np.cumsum(np.fromiter(map(len, parts.values()), np.int64, len(parts)))
        self.add(list(parts), ids, np.diff(np.cumsum(sizes, dtype=np.int64)[ends - 1], prepend=0))

    def ask(self, chunks: list[str]) -> None:
        """Encode chunks through the library."""
        odd, plain = [c for c in chunks if c[:1] == " "], [c for c in chunks if c[:1] != " "]
        if len(" ".join(plain).split()) != len(plain):
            odd += [c for c in plain if not c or SPACE.search(c)]
            plain = [c for c in plain if c and not SPACE.search(c)]
        ids = self.library(" " + " ".join(plain)) if plain else np.zeros(0, np.uint32)
        starts = np.flatnonzero(self.spaced[ids])
        if len(starts) != len(plain):
            raise ValueError("the tokenizer does not begin a word at each space")
        self.add(plain, ids, np.diff(np.append(starts, len(ids))))
        if odd:
            found = [e.ids for e in self.tokenizer.encode_batch_fast([c[1:] if c[:1] == " " else " " + c for c in odd], add_special_tokens=False)]
            self.add(odd, np.fromiter(chain.from_iterable(found), np.uint32), np.fromiter(map(len, found), np.int64, len(found)))

    def encode(self, texts: pa.Array | list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after another, and the number of ids of each text."""
        texts = pa.array(texts, pa.string()) if isinstance(texts, list) else texts
        found = [self._encode(part) for part in parts_of(texts)]
        return np.concatenate([np.zeros(0, np.uint32), *(x for x, _ in found)]), np.concatenate([np.zeros(0, np.int64), *(n for _, n in found)])

    def _encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if not self.by_chunks:
            found = self.tokenizer.encode_batch_fast(texts.to_pylist(), add_special_tokens=False)
            parts = [np.array(e.ids, np.uint32) for e in found]
            return np.concatenate(parts), np.array([len(p) for p in parts], np.int64)
        self.make_room()
        column, chunks, which, stops = split_at_spaces(texts)
        first = which[stops[:-1]]
        opens, closes = edges(chunks, column)
        # white space at a text's own ends has no neighbour there
        inner_open, inner_close = opens[which], closes[which]
        inner_open[stops[:-1]] = inner_close[stops[1:] - 1] = False
        n_chunks = np.diff(stops)
        whole = set(np.repeat(np.arange(len(texts)), n_chunks)[inner_open | inner_close].tolist())
        for s in self.special:
            whole |= set(np.flatnonzero(pc.match_substring(texts, s).to_numpy(zero_copy_only=False)).tolist())
        of_chunk = self.numbers(chunks, distinct=True)[which]
        of_chunk[stops[:-1]] = self.numbers([" " + chunks[i] for i in first.tolist()])
        flat, lengths = self.ids_of(of_chunk)
        borders = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])[stops]
        if whole:
            parts = [self.library(texts[i].as_py()) if i in whole else flat[borders[i] : borders[i + 1]] for i in range(len(texts))]
            return np.concatenate(parts), np.array([len(p) for p in parts], np.int64)
        return flat, np.diff(borders)


@lru_cache(maxsize=2)
def byte_bpe(path: str) -> ByteBpe:
    """One per Python worker, so chunks stay known from task to task."""
    return ByteBpe(path)
