"""Katz backoff language model of order 3: Good-Turing discounts, exactly normalised backoff weights.

P(w | h) = d(c) * c(h, w) / (c(h) + 1/2)   if the training texts hold (h, w), c = c(h, w)
         = alpha(h) * P(w | h')            otherwise, h' being h without its first word, or P(w | h') where h never
                                           precedes anything
P(w)     = (c(w) + 1/2) / (N + (V + 1) / 2), all unknown words together being one more word.

alpha(h) is what the discounts leave of h's mass over what P(. | h') gives to the words not seen after h, so each
P(. | h) sums to one.  Half a count is set aside in every context, so that words after a context whose followers are
all frequent (and undiscounted) keep a probability.  h has up to two words; a text's first word follows the start.

Texts become batches of word numbers, stored once.  A batch asks for the counts of its distinct words, pairs and
triples in range partitions of 64-bit keys; a partition adds up all batches' counts and answers every batch in its
order of keys.  The count tables are thus split by key range, no word or pair gathers rows (a batch asks once however
often it holds it), and nothing of the corpus but some totals reaches the driver.  Triples are split by the key of
their first two words, so a partition also sums up what alpha of a pair takes; of a triple it needs the counts of its
last two words, which the batch knows by then.  An answer on triples has two bits each, and the counts above one.
Triples go in ROUNDS, each over a part of the partitions, which bounds the disk that their exchange takes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, partitions, release, staged, text_or_empty
from .jaccard import WordHashes

BATCH_TOKENS = 1_000_000
PART_KEYS = 800_000
GT_LIMIT = 5
ROUNDS = 2
END = np.uint64(xxhash.xxh3_64_intdigest(b"end\n"))  # words hold no line feeds
START = np.uint64(xxhash.xxh3_64_intdigest(b"start\n"))

_DOCS = "batch long, ids array<long>, train binary, sizes array<int>, words binary, tokens binary"
_ASK = "part long, batch long, width int, keys binary, counts binary"
_REPLY = "batch long, part long, n int, counts binary, owner binary, totals array<long>"


def word_batches(docs: DataFrame, batch_tokens: int = BATCH_TOKENS) -> DataFrame:
    """(id, train, text) -> batches: ids, training flags, token counts, sorted word hashes, word number of each token."""

    def run(batches):
        from pyspark import TaskContext

        known, number = WordHashes(), TaskContext.get().partitionId() << 32
        ids, train, parts, n = [], [], [], 0

        def flush():
            sizes = [len(p) for p in parts]
            words, tokens = np.unique(np.concatenate([*parts, np.array([START])]), return_inverse=True)
            return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([np.array(train, np.uint8).tobytes()], pa.binary()), pa.array([sizes], pa.list_(pa.int32())), pa.array([words.tobytes()], pa.binary()), pa.array([tokens[:-1].astype(np.int32).tobytes()], pa.binary())], names=["batch", "ids", "train", "sizes", "words", "tokens"])

        for batch in batches:
            for id_, flag, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                found = text.encode("utf-8", "surrogatepass").lower().split()
                ids.append(id_)
                train.append(flag)
                parts.append(np.append(np.fromiter(map(known.__getitem__, found), np.uint64, len(found)), END))
                n += len(found) + 1
                if n >= batch_tokens:
                    yield flush()
                    number, ids, train, parts, n = number + 1, [], [], [], 0
        if parts:
            yield flush()

    return docs.mapInArrow(run, _DOCS)


class Batch:
    """One batch: words (sorted hashes), tokens, the token before each (or the start), and its distinct pairs."""

    def __init__(self, row: dict):
        self.ids = row["ids"]
        self.sizes = np.array(row["sizes"], np.int64)
        self.train = np.frombuffer(row["train"], np.uint8).astype(bool)
        self.words = np.frombuffer(row["words"], np.uint64)
        self.tokens = np.frombuffer(row["tokens"], np.int32).astype(np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.token_train = np.repeat(self.train, self.sizes)
        self.start = int(np.searchsorted(self.words, START))

    def word_counts(self) -> np.ndarray:
        out = np.bincount(self.tokens[self.token_train], minlength=len(self.words))
        out[self.start] = int(self.train.sum())
        return out

    def pairs(self):
        """Per distinct pair in ascending order of keys: key, context, word; and each token's pair."""
        before = np.empty_like(self.tokens)
        before[1:] = self.tokens[:-1]
        before[self.starts] = self.start
        a, b = self.words[before], self.words[self.tokens]
        keys = (a ^ (a >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + b
        keys = (keys ^ (keys >> np.uint64(32))) * np.uint64(0xC2B2AE3D27D4EB4F)
        keys, of_token = np.unique(keys, return_inverse=True)
        context, word = np.empty(len(keys), np.int64), np.empty(len(keys), np.int64)
        context[of_token], word[of_token] = before, self.tokens
        return keys, context, word, of_token

    def triples(self, of_token: np.ndarray):
        """Per distinct triple, by first pair and last word: the place of its first pair, its word; the tokens that
        end a triple, and the triple of each."""
        ends = np.ones(len(self.tokens), bool)
        ends[self.starts] = False
        at = np.flatnonzero(ends)
        codes, of_end = np.unique(of_token[at - 1] * len(self.words) + self.tokens[at], return_inverse=True)
        return codes // len(self.words), codes % len(self.words), at, of_end


def rows_of(table: pa.Table) -> list[dict]:
    return table.to_pylist()


def split_keys(keys: np.ndarray, parts: int) -> np.ndarray:
    """Borders of the key-range partitions in ascending keys: parts + 1 positions."""
    of = ((keys >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
    return np.searchsorted(of, np.arange(parts + 1, dtype=np.uint64))


def packed_keys(keys: np.ndarray) -> tuple[int, bytes]:
    """Ascending keys as differences of 6 or 8 bytes."""
    steps = np.diff(keys, prepend=np.uint64(0))
    width = 6 if len(steps) and int(steps.max()) < 1 << 48 else 8
    return width, steps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def unpacked_keys(width: int, data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8).reshape(-1, width)
    steps = np.zeros((len(raw), 8), np.uint8)
    steps[:, :width] = raw
    return np.cumsum(steps.view("<u8").ravel(), dtype=np.uint64)


def packed_counts(counts: np.ndarray) -> bytes:
    """Small numbers in a byte each, larger ones in full behind."""
    large = counts >= 255
    return np.where(large, 255, counts).astype(np.uint8).tobytes() + counts[large].astype("<i8").tobytes()


def unpacked_counts(n: int, data: bytes) -> np.ndarray:
    out = np.frombuffer(data, np.uint8, n).astype(np.int64)
    out[out == 255] = np.frombuffer(data, "<i8", offset=n)
    return out


def numbered(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct values in order, the place of each value among them, and where each is met first."""
    distinct, inverse = np.unique(values, return_inverse=True)
    first = np.empty(len(distinct), np.int64)
    first[inverse[::-1]] = np.arange(len(values) - 1, -1, -1)  # the last one written is the first one met
    return distinct, inverse, first


def ask(batches: DataFrame, level: int, parts: int) -> DataFrame:
    """Each batch's distinct words (level 1) or pairs (level 2) with their counts in its training texts."""

    def run(tables):
        for table in tables:
            for row in rows_of(table):
                batch = Batch(row)
                if level == 1:
                    keys, counts = batch.words, batch.word_counts()
                else:
                    keys, _, _, of_token = batch.pairs()
                    counts = np.bincount(of_token[batch.token_train], minlength=len(keys))
                borders, columns = split_keys(keys, parts), [[] for _ in range(5)]
                for part in np.flatnonzero(np.diff(borders)).tolist():
                    mine = slice(borders[part], borders[part + 1])
                    for column, value in zip(columns, (part, row["batch"], *packed_keys(keys[mine]), packed_counts(counts[mine])), strict=True):
                        column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["part", "batch", "width", "keys", "counts"])

    return batches.mapInArrow(run, _ASK)


def counted(asked: DataFrame) -> DataFrame:
    """Add up each partition's counts.  To every batch: the totals of its keys, and which pairs it is to sum over.

    One row more per partition has, without the start symbol, the sum of counts, the number of keys with a count,
    and how many keys have the counts 1 to GT_LIMIT + 1.
    """

    def run(table: pa.Table) -> pa.Table:
        rows = sorted(rows_of(table), key=lambda r: r["batch"])
        keys = [unpacked_keys(r["width"], r["keys"]) for r in rows]
        counts = [unpacked_counts(len(k), r["counts"]) for k, r in zip(keys, rows, strict=True)]
        distinct, inverse, first = numbered(np.concatenate(keys))
        total = np.bincount(inverse, weights=np.concatenate(counts), minlength=len(distinct)).astype(np.int64)
        owner = np.zeros(len(inverse), bool)
        owner[first] = True
        of_key, at, out = total[inverse], 0, []
        for r, k in zip(rows, keys, strict=True):
            mine = slice(at, at + len(k))
            out.append({"batch": r["batch"], "part": r["part"], "n": len(k), "counts": packed_counts(of_key[mine]), "owner": np.packbits(owner[mine]).tobytes(), "totals": None})
            at += len(k)
        real = total[distinct != START]
        sums = [int(real.sum()), int((real > 0).sum()), *np.bincount(real[(real > 0) & (real <= GT_LIMIT + 1)], minlength=GT_LIMIT + 2)[1:].tolist()]
        out.append({"batch": None, "part": rows[0]["part"], "n": None, "counts": None, "owner": None, "totals": sums})
        return pa.Table.from_pylist(out, schema=pa.schema([("batch", pa.int64()), ("part", pa.int64()), ("n", pa.int32()), ("counts", pa.binary()), ("owner", pa.binary()), ("totals", pa.list_(pa.int64()))]))

    return asked.groupBy("part").applyInArrow(run, _REPLY)


def totals_of(replies: DataFrame) -> list[int]:
    sums = [F.coalesce(F.sum(F.col("totals")[i]), F.lit(0)).alias(f"t{i}") for i in range(GT_LIMIT + 3)]
    return [int(x) for x in replies.where("batch is null").agg(*sums).first()]


def discounts(n: list[int], limit: int = GT_LIMIT) -> np.ndarray:
    """d[r] for r = 0 .. limit + 1: Good-Turing with Katz's correction; n[r - 1] is how many pairs have count r.

    Where counts of counts give no discount between 0 and 1 (few or oddly repeated texts), 1 - D / r with
    D = n1 / (n1 + 2 n2) takes its place.  Counts above the limit keep their value, d = 1.
    """
    d = np.ones(limit + 2)
    n1, n2 = n[0], n[1]
    absolute = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
    tail = (limit + 1) * n[limit] / n1 if n1 else 1.0
    for r in range(1, limit + 1):
        turing = (r + 1) * n[r] / (r * n[r - 1]) if n[r - 1] else 0.0
        value = (turing - tail) / (1 - tail) if tail < 1 else 0.0
        d[r] = value if 0.0 < value < 1.0 else 1 - absolute / r
    return d


def replies_in_order(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The answers to one batch, one after another in the order of its keys."""
    counts, owner = [], []
    for r in sorted(rows_of(table), key=lambda r: r["part"]):
        counts.append(unpacked_counts(r["n"], r["counts"]))
        owner.append(np.unpackbits(np.frombuffer(r["owner"], np.uint8), count=r["n"]).astype(bool))
    return np.concatenate(counts), np.concatenate(owner)


_STATE = "batch long, ids array<long>, train binary, sizes array<int>, words binary, tokens binary, word_counts binary, pair_counts binary, owner binary"


def with_counts(batches: DataFrame, replies: DataFrame) -> DataFrame:
    """Batches with the counts of their words and pairs, and which pairs they are to sum over."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        row = rows_of(left)[0]
        levels = right.column("level").to_numpy()
        c1, _ = replies_in_order(right.filter(pa.array(levels == 1)))
        c2, owner = replies_in_order(right.filter(pa.array(levels == 2)))
        out = row | {"word_counts": packed_counts(c1), "pair_counts": packed_counts(c2), "owner": np.packbits(owner).tobytes()}
        types = [pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.list_(pa.int32()), *[pa.binary()] * 5]
        return pa.Table.from_arrays([pa.array([out[f]], t) for f, t in zip(_FIELDS, types, strict=True)], names=_FIELDS)

    return batches.groupBy("batch").cogroup(replies.groupBy("batch")).applyInArrow(run, _STATE)


_FIELDS = [f.split()[0] for f in _STATE.split(", ")]


def used_contexts(c1: np.ndarray, c2: np.ndarray, owner: np.ndarray, context: np.ndarray) -> np.ndarray:
    """The words after which the batch meets words that were never seen there, or whose pairs it is to sum over."""
    out = np.zeros(len(c1), bool)
    out[context[(c2 == 0) & (c1[context] > 0)]] = True
    out[context[owner & (c2 > 0)]] = True
    return np.flatnonzero(out)


def counts_of(row: dict, batch: Batch, n_pairs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    owner = np.unpackbits(np.frombuffer(row["owner"], np.uint8), count=n_pairs).astype(bool)
    return unpacked_counts(len(batch.words), row["word_counts"]), unpacked_counts(n_pairs, row["pair_counts"]), owner


def ask_backoff(states: DataFrame, parts: int, d: np.ndarray, totals: tuple[int, int]) -> DataFrame:
    """Of each context of one word that a batch uses, its count and the batch's share of its sums (of every pair, the
    first batch that holds it has the share)."""
    n_train, vocabulary = totals

    def run(tables):
        for table in tables:
            for row in rows_of(table):
                batch = Batch(row)
                pairs, context, word, _ = batch.pairs()
                c1, c2, owner = counts_of(row, batch, len(pairs))
                order, mine = used_contexts(c1, c2, owner, context), owner & (c2 > 0)
                kept, p1 = d[np.minimum(c2, len(d) - 1)] * c2, (c1 + 0.5) / (n_train + 0.5 * (vocabulary + 1))
                seen, lower = (np.bincount(context[mine], weights=w[mine], minlength=len(batch.words))[order] for w in (kept, p1[word]))
                keys, counts = batch.words[order], c1[order]
                borders, columns = split_keys(keys, parts), [[] for _ in range(7)]
                for part in np.flatnonzero(np.diff(borders)).tolist():
                    mine = slice(borders[part], borders[part + 1])
                    for column, value in zip(columns, (part, row["batch"], *packed_keys(keys[mine]), packed_counts(counts[mine]), seen[mine].tobytes(), lower[mine].tobytes()), strict=True):
                        column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int32(), *[pa.binary()] * 4), strict=True)], names=["part", "batch", "width", "keys", "counts", "seen", "lower"])

    return states.mapInArrow(run, _ASK + ", seen binary, lower binary")


def backoff_weights(asked: DataFrame) -> DataFrame:
    """log10 alpha of every context that a batch backs off from."""

    def run(table: pa.Table) -> pa.Table:
        rows = sorted(rows_of(table), key=lambda r: r["batch"])
        keys = [unpacked_keys(r["width"], r["keys"]) for r in rows]
        counts = np.concatenate([unpacked_counts(len(k), r["counts"]) for k, r in zip(keys, rows, strict=True)])
        distinct, inverse, first = numbered(np.concatenate(keys))
        seen, lower = (np.bincount(inverse, weights=np.concatenate([np.frombuffer(r[c]) for r in rows]), minlength=len(distinct)) for c in ("seen", "lower"))
        alpha = np.log10((1 - seen / (counts[first] + 0.5)) / (1 - lower))[inverse]
        stops = np.cumsum([len(k) for k in keys])
        return pa.Table.from_pylist([{"batch": r["batch"], "part": r["part"], "alpha": alpha[stop - len(k) : stop].tobytes()} for r, k, stop in zip(rows, keys, stops, strict=True)], schema=pa.schema([("batch", pa.int64()), ("part", pa.int64()), ("alpha", pa.binary())]))

    return asked.groupBy("part").applyInArrow(run, "batch long, part long, alpha binary")


_ASK3 = "part long, batch long, width int, keys binary, context_counts binary, followers binary, words binary, counts binary, pair_counts binary"
_REPLY3 = "batch long, part long, n int, seen binary, several binary, counts binary, classes binary, lower binary, totals array<long>"


def ask_triples(states: DataFrame, parts: int, turn: int, rounds: int) -> DataFrame:
    """Each batch's distinct triples, by their first pair, with their counts in its training texts; of the pair the
    count of its last word, of the triple the count of its last two words, both in all training texts."""

    def run(tables):
        for table in tables:
            for row in rows_of(table):
                batch = Batch(row)
                keys, context, word, of_token = batch.pairs()
                c1, c2, _ = counts_of(row, batch, len(keys))
                pair, last, at, of_end = batch.triples(of_token)
                counts = np.bincount(of_end[batch.token_train[at]], minlength=len(pair))
                tail = np.zeros(len(pair), np.int64)
                tail[of_end] = of_token[at]  # the pair of a triple's last two words
                stops = np.append(np.flatnonzero(np.diff(pair, prepend=-1)), len(pair))  # triples are in order of their first pair
                used, followers = pair[stops[:-1]], np.diff(stops)
                short = (batch.words >> np.uint64(24))[last].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]
                borders, columns = split_keys(keys[used], parts), [[] for _ in range(9)]
                for part in np.flatnonzero(np.diff(borders)).tolist():
                    if part % rounds == turn:
                        mine, inside = slice(borders[part], borders[part + 1]), slice(stops[borders[part]], stops[borders[part + 1]])
                        values = (part, row["batch"], *packed_keys(keys[used[mine]]), c1[word[used[mine]]].astype("<i8").tobytes(), packed_counts(followers[mine]), short[inside].tobytes(), packed_counts(counts[inside]), packed_counts(c2[tail[inside]]))
                        for column, value in zip(columns, values, strict=True):
                            column.append(value)
                types = (pa.int64(), pa.int64(), pa.int32(), *[pa.binary()] * 6)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=[f.split()[0] for f in _ASK3.split(", ")])

    return states.mapInArrow(run, _ASK3)


def counted_triples(asked: DataFrame, d2: np.ndarray) -> DataFrame:
    """To every batch: which of its triples are seen, and seen several times, with these counts; and of each seen pair
    after which it has an unseen word, how many words were seen after it once, twice, ... up to GT_LIMIT times, how
    often those above it, and what P(. | last word) gives to all of them.  One row more has the totals."""

    def run(table: pa.Table) -> pa.Table:
        rows = sorted(rows_of(table), key=lambda r: r["batch"])
        keys = [unpacked_keys(r["width"], r["keys"]) for r in rows]
        words = [np.frombuffer(r["words"], np.uint8).reshape(-1, 5) for r in rows]
        followers = [unpacked_counts(len(k), r["followers"]) for k, r in zip(keys, rows, strict=True)]
        counts = np.concatenate([unpacked_counts(len(w), r["counts"]) for w, r in zip(words, rows, strict=True)])
        pair_counts = np.concatenate([unpacked_counts(len(w), r["pair_counts"]) for w, r in zip(words, rows, strict=True)])
        before = np.concatenate([np.frombuffer(r["context_counts"], "<i8") for r in rows])
        every_key, of_key = np.unique(np.concatenate(keys), return_inverse=True)
        of_context = np.repeat(np.arange(len(of_key)), np.concatenate(followers))
        raw = np.concatenate(words)
        wide = np.zeros((len(raw), 8), np.uint8)
        wide[:, :5] = raw
        codes = of_key[of_context].astype(np.uint64) << np.uint64(40) | wide.view("<u8").ravel()
        distinct, inverse, first = numbered(codes)
        total = np.bincount(inverse, weights=counts, minlength=len(distinct)).astype(np.int64)
        key, seen = (distinct >> np.uint64(40)).astype(np.int64), total > 0
        c2 = pair_counts[first]
        given = d2[np.minimum(c2, len(d2) - 1)] * c2 / (before[of_context[first]] + 0.5)
        lower = np.bincount(key[seen], weights=given[seen], minlength=len(every_key))
        classes = np.stack([np.bincount(key[total == r], minlength=len(every_key)) for r in range(1, GT_LIMIT + 1)] + [np.bincount(key, weights=np.where(total > GT_LIMIT, total, 0), minlength=len(every_key)).astype(np.int64)], axis=1)
        of_triple, at, at_key, out = total[inverse], 0, 0, []
        for r, k, w in zip(rows, keys, words, strict=True):
            mine = of_triple[at : at + len(w)]
            local = of_context[at : at + len(w)] - at_key
            own = of_key[at_key : at_key + len(k)]
            asked_of = own[(np.bincount(local[mine == 0], minlength=len(k)) > 0) & (classes[own].any(axis=1))]
            several = mine > 1
            out.append({"batch": r["batch"], "part": r["part"], "n": len(w), "seen": np.packbits(mine > 0).tobytes(), "several": np.packbits(several).tobytes(), "counts": packed_counts(mine[several]), "classes": packed_counts(classes[asked_of].ravel()), "lower": lower[asked_of].tobytes(), "totals": None})
            at, at_key = at + len(w), at_key + len(k)
        sums = [int(total.sum()), int(seen.sum()), *np.bincount(total[seen & (total <= GT_LIMIT + 1)], minlength=GT_LIMIT + 2)[1:].tolist()]
        out.append({f.split()[0]: None for f in _REPLY3.split(", ")} | {"part": rows[0]["part"], "totals": sums})
        return pa.Table.from_pylist(out, schema=pa.schema([("batch", pa.int64()), ("part", pa.int64()), ("n", pa.int32()), *[(f, pa.binary()) for f in ("seen", "several", "counts", "classes", "lower")], ("totals", pa.list_(pa.int64()))]))

    return asked.groupBy("part").applyInArrow(run, _REPLY3)


def triple_counts(rows: list[dict], contexts: np.ndarray, seen_context: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Answers in order -> counts of the batch's triples; the seen contexts (places) with unseen triples, their classes, lower sums."""
    rows = sorted(rows, key=lambda r: r["part"])
    parts, classes, lower = [np.zeros(0, np.int64)], [np.zeros((0, GT_LIMIT + 1), np.int64)], [np.zeros(0)]
    for r in rows:
        bits = lambda name, n=r["n"], r=r: np.unpackbits(np.frombuffer(r[name], np.uint8), count=n).astype(bool)
        several, own = bits("several"), np.frombuffer(r["lower"])
        c = bits("seen").astype(np.int64)
        c[several] = unpacked_counts(int(several.sum()), r["counts"])
        parts.append(c)
        lower.append(own)
        classes.append(unpacked_counts(len(own) * (GT_LIMIT + 1), r["classes"]).reshape(-1, GT_LIMIT + 1))
    c3 = np.concatenate(parts)
    asked = np.flatnonzero((np.bincount(contexts[c3 == 0], minlength=len(seen_context)) > 0) & seen_context)
    return c3, asked, np.concatenate(classes), np.concatenate(lower)


def finished(states: DataFrame, answers: DataFrame, d2: np.ndarray, d3: np.ndarray, totals: tuple[int, int], id_col: str) -> DataFrame:
    """The score of every text: each token's highest order that was seen, with the weights of those above it."""
    n_train, vocabulary = totals

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        row, replies = rows_of(left)[0], rows_of(right)
        batch = Batch(row)
        keys, context, word, of_token = batch.pairs()
        c1, c2, owner = counts_of(row, batch, len(keys))
        log1 = np.log10((c1 + 0.5) / (n_train + 0.5 * (vocabulary + 1)))
        # order 2
        alpha = np.zeros(len(batch.words))
        alpha[used_contexts(c1, c2, owner, context)] = np.concatenate([np.zeros(0), *(np.frombuffer(r["alpha"]) for r in sorted((r for r in replies if r["level"] == 1), key=lambda r: r["part"]))])
        kept = d2[np.minimum(c2, len(d2) - 1)] * c2
        backed = np.where(c1[context] > 0, alpha[context], 0.0) + log1[word]
        log2 = np.where(c2 > 0, np.log10(np.where(c2 > 0, kept, 1.0) / (c1[context] + 0.5)), backed)
        # order 3
        pair, _, at, of_end = batch.triples(of_token)
        c3, asked, classes, lower = triple_counts([r for r in replies if r["level"] == 3], pair, c2 > 0)
        weights = np.append(d3[1 : GT_LIMIT + 1] * np.arange(1, GT_LIMIT + 1), 1.0)
        alpha2 = np.zeros(len(keys))
        alpha2[asked] = np.log10((1 - classes @ weights / (c2[asked] + 0.5)) / (1 - lower))
        kept = d3[np.minimum(c3, len(d3) - 1)] * c3
        logs = log2[of_token]
        c = c3[of_end]
        logs[at] = np.where(c > 0, np.log10(np.where(c > 0, kept[of_end], 1.0) / (c2[pair[of_end]] + 0.5)), alpha2[pair[of_end]] + logs[at])
        per_text = lambda values: np.add.reduceat(values, batch.starts) if len(batch.starts) else np.zeros(0)
        known = (c1 > 0)[batch.tokens].astype(np.int64)
        return pa.Table.from_arrays([pa.array(batch.ids, pa.int64()), pa.array(~batch.train), pa.array(batch.sizes), pa.array(per_text(known)), pa.array(per_text(log1[batch.tokens])), pa.array(per_text(logs))], names=[id_col, "held_out", "n_tokens", "n_known", "base_score", "score"])

    return states.groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(run, f"`{id_col}` long, held_out boolean, n_tokens long, n_known long, base_score double, score double")


def score_texts(docs: DataFrame, train, id_col: str = "doc_id", text_col: str = "text", batch_tokens: int = BATCH_TOKENS, rounds: int = ROUNDS) -> DataFrame:
    """Learn from the rows where the boolean column `train` holds, score all rows.

    Per row: id_col, held_out, n_tokens (words and one end), n_known, train_tokens, base_score, score; log10.
    Null or empty texts are their end alone.  Repeated rows count, and come back, each by itself.  Without training
    rows every word is unknown and the only word, so all scores are 0.  An empty table gives no rows.  A text of any
    length lies in one batch.  Other columns, whatever their names, are not read.
    """
    spark = docs.sparkSession
    batches = staged(word_batches(docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(train, F.lit(False)).cast("int").alias("train"), text_or_empty(text_col).alias("text")), batch_tokens), "word-batches")
    size = batches.agg(F.coalesce(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x)), F.lit(0))).first()[0]
    parts = max(partitions(spark), int(size) // PART_KEYS + 1)
    words = staged(counted(ask(batches, 1, parts)), "word-counts")
    release(spark)
    pairs = staged(counted(ask(batches, 2, parts)), "pair-counts")
    release(spark)
    n_train, vocabulary, *_ = totals_of(words)
    d2 = discounts(totals_of(pairs)[2:])
    both = words.withColumn("level", F.lit(1)).union(pairs.withColumn("level", F.lit(2))).where("batch is not null").select("batch", "part", "level", "n", "counts", "owner")
    states = staged(with_counts(batches, both), "counted-batches")
    discard(batches, words, pairs)
    release(spark)
    alphas = staged(backoff_weights(ask_backoff(states, parts, d2, (n_train, vocabulary))), "backoff-weights")
    release(spark)
    triples = []
    for turn in range(rounds):
        triples.append(staged(counted_triples(ask_triples(states, parts, turn, rounds), d2), "triple-counts"))
        release(spark)
    counts3 = triples[0]
    for more in triples[1:]:
        counts3 = counts3.union(more)
    d3 = discounts(totals_of(counts3)[2:])
    nothing = [F.lit(None).cast("binary").alias(c) for c in ("seen", "several", "counts", "classes", "lower")]
    answers = alphas.select("batch", "part", F.lit(1).alias("level"), "alpha", F.lit(None).cast("int").alias("n"), *nothing)
    answers = answers.union(counts3.where("batch is not null").select("batch", "part", F.lit(3).alias("level"), F.lit(None).cast("binary").alias("alpha"), "n", "seen", "several", "counts", "classes", "lower"))
    return finished(states, answers, d2, d3, (n_train, vocabulary), id_col).withColumn("train_tokens", F.lit(n_train).cast("long"))
