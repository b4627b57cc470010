"""SentencePiece models on the tokenizers library: ids, decoding, and parity with the original library.

The model file is read as a protobuf message; its normaliser, white-space marker, scores and byte fallback become a
tokenizers pipeline: a unigram model with the pieces' scores, or a BPE model whose merges follow from them.
Where no piece holds a white-space marker behind another character, no piece spans two words, so a text's ids are
its words' ids; then each worker encodes, and decodes, a distinct word once, in multithreaded batches.  Models
without this property, and texts with neighbouring spaces, are encoded whole.  The original library encodes every
whole text too, for the comparison.
"""

from __future__ import annotations

import os
import re
import struct
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .chunks import HeldChunks, checksums, parts_of, split_at_spaces
from .common import text_or_empty

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
THREADS = 2
ROWS_AT_ONCE = 2048


def fields(data: bytes):
    """(number, value) of a protobuf message: integers, bytes, and floats' raw bytes."""
    at = 0

    def varint():
        nonlocal at
        out = shift = 0
        while True:
            byte = data[at]
            at += 1
            out |= (byte & 127) << shift
            if byte < 128:
                return out
            shift += 7

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
            continue
        size = 8 if kind == 1 else 4 if kind == 5 else varint()
        yield key >> 3, data[at : at + size]
        at += size


@dataclass
class Model:
    pieces: list[tuple[str, float, int]]
    unigram: bool
    byte_fallback: bool
    charsmap: bytes
    dummy_prefix: bool
    squeeze: bool
    unknown: int


def parse(data: bytes) -> Model:
    """Fixed field numbers of the model message: 1 pieces (1 text, 2 score, 3 kind), 2 trainer (3 model type,
    35 byte fallback), 3 normaliser (2 character map, 3 dummy prefix, 4 remove extra white space)."""
    out = Model([], True, False, b"", True, True, 0)
    for number, value in fields(data):
        if number == 1:
            text, score, kind = "", 0.0, NORMAL
            for n, v in fields(value):
                if n == 1:
                    text = v.decode()
                elif n == 2:
                    (score,) = struct.unpack("<f", v)
                elif n == 3:
                    kind = v
            if kind == UNKNOWN:
                out.unknown = len(out.pieces)
            out.pieces.append((text, score, kind))
        elif number == 2:
            for n, v in fields(value):
                if n == 3:
                    out.unigram = v == 1
                elif n == 35:
                    out.byte_fallback = bool(v)
        elif number == 3:
            for n, v in fields(value):
                if n == 2:
                    out.charsmap = v
                elif n == 3:
                    out.dummy_prefix = bool(v)
                elif n == 4:
                    out.squeeze = bool(v)
    return out


def merges_of(model: Model) -> list[tuple[str, str]]:
    """All splits of each piece into two pieces; better scores first."""
    score = {p: s for p, s, kind in model.pieces if kind in (NORMAL, USER_DEFINED)}
    ranks = {p: i for i, (p, _, _) in enumerate(model.pieces)}
    found = []
    for piece, s in score.items():
        for i in range(1, len(piece)):
            left, right = piece[:i], piece[i:]
            if left in score and right in score:
                found.append((-s, ranks[piece], ranks[left], ranks[right], left, right))
    return [(m[4], m[5]) for m in sorted(found)]


def build(model: Model):
    """The tokenizers pipeline of a model."""
    from tokenizers import AddedToken, Regex, Tokenizer, decoders, models, normalizers

    vocabulary = {p: i for i, (p, _, _) in enumerate(model.pieces)}
    if model.unigram:
        core = models.Unigram([(p, s) for p, s, _ in model.pieces], model.unknown, model.byte_fallback)
    else:
        core = models.BPE(vocabulary, merges_of(model), unk_token=model.pieces[model.unknown][0], fuse_unk=True, byte_fallback=model.byte_fallback)
    out = Tokenizer(core)
    steps = [normalizers.Precompiled(model.charsmap)] if model.charsmap else []
    steps += [normalizers.Replace(Regex(" {2,}"), " "), normalizers.Strip(True, True)] if model.squeeze else []
    steps += [normalizers.Prepend(MARK)] if model.dummy_prefix else []
    out.normalizer = normalizers.Sequence([*steps, normalizers.Replace(" ", MARK)])
    out.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse(), *([decoders.Strip(" ", 1, 0)] if model.dummy_prefix else [])])
    own = [AddedToken(p, normalized=False) for p, _, kind in model.pieces if kind == USER_DEFINED]
    if own:
        out.add_tokens(own)
    return out


def by_words(model: Model) -> bool:
    """Whether words can be encoded apart: no marker behind another character in any piece, none defined by users."""
    inside = re.compile(f"[^{MARK}]{MARK}")
    return not any(kind == USER_DEFINED or kind == NORMAL and inside.search(p) for p, _, kind in model.pieces)


class Codec(HeldChunks):
    """The flag of a held chunk: it is decoded to itself."""

    def __init__(self, path: str):
        os.environ.setdefault("RAYON_NUM_THREADS", str(THREADS))  # as many as a task may use, before the pool starts
        import sentencepiece
        from tokenizers import Tokenizer

        with open(path, "rb") as f:
            self.model = parse(f.read())
        self.tokenizer = build(self.model)
        self.core = Tokenizer(self.tokenizer.model)
        self.original = sentencepiece.SentencePieceProcessor(model_file=path)
        m = self.model
        self.split = by_words(m) and m.dummy_prefix and not m.charsmap and not m.squeeze
        super().__init__()

    def learn(self, chunks: list[str]) -> None:
        """Encode new chunks, each behind a marker, and decode them again."""
        ids = [e.ids for e in self.core.encode_batch_fast([MARK + c for c in chunks], add_special_tokens=False)]
        back = self.decode(ids)
        fits = np.fromiter((a == b for a, b in zip(back, chunks, strict=True)), bool, len(chunks))
        self.add(chunks, np.fromiter(chain.from_iterable(ids), np.uint32), np.fromiter(map(len, ids), np.int64, len(ids)), fits)

    def agrees(self, texts: list[str], ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Whether the original library gives each whole text the same ids."""
        theirs = self.original.encode(texts, num_threads=THREADS) if texts else []
        sizes = np.fromiter(map(len, theirs), np.int64, len(theirs))
        flat = np.fromiter(chain.from_iterable(theirs), np.uint32, int(sizes.sum()))
        if np.array_equal(sizes, counts) and np.array_equal(flat, ids):
            return np.ones(len(texts), bool)
        a, b = np.cumsum(sizes), np.cumsum(counts)
        return np.array([n == m and np.array_equal(flat[x - n : x], ids[y - m : y]) for n, m, x, y in zip(sizes, counts, a, b, strict=True)], bool)

    def fits(self, text: str, ids: np.ndarray) -> bool:
        """Whether the ids of a whole text are decoded to it, or to its normalised form."""
        back = self.decode([ids.tolist()])[0]
        return back == text or back == self.original.normalize(text).replace(MARK, " ").removeprefix(" " if self.model.dummy_prefix else "")

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids if t else [], np.uint32) for e, t in zip(self.tokenizer.encode_batch_fast(texts, add_special_tokens=False), texts, strict=True)]

    def encode(self, texts: pa.Array | list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids one after another, their number per text, and whether the original agrees on the whole text."""
        return self.coded(texts)[:3]

    def coded(self, texts: pa.Array | list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids one after another, their number per text, whether the original agrees, and whether decoding gives the text back."""
        texts = pa.array(texts, pa.string()) if isinstance(texts, list) else texts
        empty = (np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, bool))
        return tuple(map(np.concatenate, zip(empty, *map(self._encode, parts_of(texts)), strict=True)))

    def _encode(self, texts: pa.Array):
        plain = texts.to_pylist()
        if not self.split:
            parts = self.whole(plain)
            ids, counts = np.concatenate(parts), np.array([len(p) for p in parts], np.int64)
            return ids, counts, self.agrees(plain, ids, counts), np.array([self.fits(t, x) for t, x in zip(plain, parts, strict=True)], bool)
        self.make_room()
        _, chunks, which, stops = split_at_spaces(texts)
        # neighbouring spaces make one word of several markers, and so may a marker in the text
        odd = np.array([not c or MARK in c for c in chunks], bool)[which]
        n_chunks = np.diff(stops)
        whole = np.unique(np.repeat(np.arange(len(texts)), n_chunks)[odd])
        at = self.numbers(chunks)[which]
        ids, lengths = self.ids_of(at)
        borders = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])[stops]
        fits = np.logical_and.reduceat(self.flag.room[at], stops[:-1])
        counts = np.diff(borders)
        if len(whole):
            again = dict(zip(whole.tolist(), self.whole([plain[i] for i in whole.tolist()]), strict=True))
            parts = [again[i] if i in again else ids[borders[i] : borders[i + 1]] for i in range(len(plain))]
            ids, counts = np.concatenate(parts), np.array([len(p) for p in parts], np.int64)
        fits[whole] = False
        ends = np.cumsum(counts)
        for i in np.flatnonzero(~fits).tolist():  # what chunks do not show is decided on the whole text
            fits[i] = self.fits(plain[i], ids[ends[i] - counts[i] : ends[i]])
        return ids, counts, self.agrees(plain, ids, counts), fits

    def decode(self, ids: list[list[int]]) -> list[str]:
        return self.tokenizer.decode_batch(ids, skip_special_tokens=False)


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def encode_documents(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Per row: id_col, n_tokens, ids_crc32 (little-endian 32-bit ids), parity, audited, round_trip (and ids).

    parity: the original library gives the same ids for the whole text; it is asked for every row, so audited is
    always true.  round_trip: decoding gives the text back, or its normalised form.  A null or empty text has no ids
    and agrees.  Texts of any length are encoded whole.  Repeated rows and equal ids come back each by itself, an
    empty table gives no rows, and other columns, whatever their names, are not read.
    """
    schema = T.StructType([docs.schema[id_col], T.StructField("n_tokens", T.LongType()), T.StructField("ids_crc32", T.LongType()), T.StructField("parity", T.BooleanType()), T.StructField("audited", T.BooleanType()), T.StructField("round_trip", T.BooleanType())] + ([T.StructField("ids", T.ArrayType(T.IntegerType()))] if with_ids else []))

    def run(batches):
        tool = codec(model_path)
        for batch in batches:
            for at in range(0, len(batch), ROWS_AT_ONCE):
                part = batch.slice(at, ROWS_AT_ONCE)
                ids, counts, same, fits = tool.coded(part.column(1))
                stops = np.cumsum(counts)
                columns = [part.column(0), pa.array(counts), pa.array(checksums(ids, stops, counts), pa.int64()), pa.array(same), pa.array(np.ones(len(same), bool)), pa.array(fits)]
                columns += [pa.ListArray.from_arrays(pa.array(np.append(0, stops).astype(np.int32)), pa.array(ids.astype(np.int32)))] if with_ids else []
                yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in schema.fields])

    return docs.select(id_col, text_or_empty(text_col).alias("text")).mapInArrow(run, schema)
