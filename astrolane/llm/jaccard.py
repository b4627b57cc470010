"""Documents whose word-shingle sets overlap: an exact similarity join on count vectors.

1. A document becomes the set of its distinct word shingles (64-bit hashes).  Documents with equal sets are one class.
2. Classes meet in blocks: 28 keys per class, each made of two minima of the set.  Two sets with a Jaccard index of
   0.8 share no key with a probability of 0.36**28, 4e-13; the chance falls further above 0.8.  Blocks only decide
   which classes are compared; they bring no pair of their own.
3. In each block every class is first checked against the block's smallest class (a star, not all pairs); verified
   links give preliminary components.
4. Blocks that still hold several components are joined by an R-tree over count vectors: shingles are hashed into
   groups, a class is the point of its group counts, and the summed coordinate minima of two points (or of the upper
   corners of two tree nodes) bound the overlap of any sets below.  Pairs that the bound cannot rule out and that
   are not yet connected are verified on the sets: first the best rated pair of each class with each other
   component, which joins most components that belong together, then all that are left.
Blocks beyond a fixed size are cut into chunks that meet two at a time, so no task holds an unbounded block.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected_components
from .common import bitmap_size, bits_set, discard, frugal, partitions, release, staged, text_or_empty

WORDS = 5
PERCENT = 80
BANDS = 28
CHUNK = 2048
ROUNDS = (1, None)
LEAF = 32
MAX_CACHED = 300_000

_ODD = [np.uint64(z) for z in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)]


def _stream(n: int, seed: int) -> np.ndarray:
    """n odd 64-bit multipliers."""
    return np.array([xxhash.xxh3_64_intdigest(b"%d-%d" % (seed, i)) | 1 for i in range(n)], np.uint64)


_HASH_A, _HASH_B, _STEP = _stream(2 * BANDS, 1), _stream(2 * BANDS, 2), _stream(64, 3)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _ODD[0]
    return (x ^ (x >> np.uint64(29))) * _ODD[1]


class WordHashes(dict):
    """64-bit hashes of words (bytes), remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > MAX_CACHED:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def shingle_set(text: str, known: WordHashes, words: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the text's shingles: words are runs without ASCII white space, A-Z in lower case.

    A text with fewer words is one shingle, a text without words none.
    """
    hashes = np.fromiter(map(known.__getitem__, text.encode("utf-8", "surrogatepass").lower().split()), np.uint64)
    n = len(hashes)
    if not n:
        return hashes
    size = min(words, n)
    out = hashes[: n - size + 1] * _STEP[0]
    for k in range(1, size):
        out = _mix(out) + hashes[k : n - size + 1 + k] * _STEP[k % 64]
    out = np.sort(_mix(out + np.uint64(size)))
    return out[np.concatenate([[True], out[1:] != out[:-1]])]


def band_keys(shingles: np.ndarray) -> np.ndarray:
    """Each key hashes two minima of the set under independent hash functions."""
    low = None
    for at in range(0, len(shingles), 2048):
        part = shingles[at : at + 2048, None]
        m = (part ^ (part >> np.uint64(32))) * _HASH_A + _HASH_B
        m = (m ^ (m >> np.uint64(32))).min(axis=0)
        low = m if low is None else np.minimum(low, m)
    return (_mix(low[0::2]) + _mix(low[1::2] + np.uint64(1)) + np.arange(BANDS, dtype=np.uint64) * _ODD[0]).view(np.int64)


def group_bits(n: int) -> int:
    """log2 of the number of groups: two to four shingles a group on average, 32 to 4096 groups."""
    return min(12, max(5, int(n).bit_length() - 2))


def count_vector(shingles: np.ndarray) -> np.ndarray:
    groups = 1 << group_bits(len(shingles))
    return np.minimum(np.bincount((shingles & np.uint64(groups - 1)).astype(np.int64), minlength=groups), 65535).astype(np.uint16)


def folded(vector: np.ndarray, groups: int) -> np.ndarray:
    """The vector over fewer groups, each the sum of those it takes in.  A full counter stays full."""
    parts = vector.reshape(-1, groups)
    return np.where((parts == 65535).any(axis=0), 65535, np.minimum(parts.sum(axis=0, dtype=np.int64), 65535)).astype(np.uint16)


def keys_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """id, n_shingles, signature (of the whole set; null without words) and keys."""

    def run(batches):
        known = WordHashes()
        for batch in batches:
            n, signature, keys = [], [], []
            for text in batch.column(1).to_pylist():
                s = shingle_set(text, known, words)
                n.append(len(s))
                signature.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                keys.append(band_keys(s) if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(signature, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], names=["id", "n_shingles", "signature", "keys"])

    return docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text")).mapInArrow(frugal(run), "id long, n_shingles long, signature binary, keys array<long>")


def id_bitmap(ids: DataFrame, most_bits: int = 1 << 27) -> np.ndarray:
    """One hashed bit per id, in a bitmap of bounded size (16 MB): a filter that lets every given id through.

    It is sized for the number of ids; beyond the bound it lets more of the others through, and no id is lost.
    """
    size = bitmap_size(ids.count(), most_bits)
    return bits_set(ids.selectExpr(f"pmod(xxhash64(id), {size}L) AS bit"), size)


def sets_of(docs: DataFrame, bitmap: np.ndarray, words: int) -> DataFrame:
    """(id, text) -> id, n, points (count vector), keys and shingles, as packed bytes, of the ids in the bitmap."""
    bits = len(bitmap) * 64

    def run(batches):
        known = WordHashes()
        for batch in batches:
            at = batch.column(2).to_numpy()
            hit = ((bitmap[at >> 6] >> (at & 63)) & 1).astype(bool)
            part = batch.filter(pa.array(hit))
            found = [shingle_set(t, known, words) for t in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(s) for s in found], pa.int64()), pa.array([count_vector(s).tobytes() for s in found], pa.binary()), pa.array([band_keys(s).tobytes() if len(s) else b"" for s in found], pa.binary()), pa.array([s.tobytes() for s in found], pa.binary())], names=["id", "n", "points", "keys", "shingles"])

    return docs.where("id is not null").select("id", "text", F.pmod(F.xxhash64("id"), F.lit(bits)).alias("bit")).mapInArrow(frugal(run), "id long, n long, points binary, keys binary, shingles binary")


def verified(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs (a, b) whose sets satisfy 100 * intersection >= percent * union."""
    side = sets.select("id", "points", "shingles")
    both = pairs.join(side.toDF("a", "points_a", "set_a"), "a").join(side.toDF("b", "points_b", "set_b"), "b").select("a", "b", "points_a", "points_b", "set_a", "set_b")

    def run(batches):
        for batch in batches:
            keep = []
            for pa_, pb, sa, sb in zip(*(batch.column(i) for i in range(2, 6)), strict=True):
                na, nb = len(sa.as_buffer()) // 8, len(sb.as_buffer()) // 8
                need = -(-percent * (na + nb) // (100 + percent))
                ok = min(na, nb) >= need
                if ok:
                    va, vb = np.frombuffer(pa_.as_buffer(), np.uint16), np.frombuffer(pb.as_buffer(), np.uint16)
                    groups = min(len(va), len(vb))
                    va, vb = (v if len(v) == groups else folded(v, groups) for v in (va, vb))
                    bound = np.minimum(va, vb)
                    ok = bound.max(initial=0) == 65535 or int(bound.sum(dtype=np.int64)) >= need
                if ok:
                    ab = np.concatenate([np.frombuffer(sa.as_buffer(), np.uint64), np.frombuffer(sb.as_buffer(), np.uint64)])
                    ab.sort(kind="stable")
                    ok = int((ab[1:] == ab[:-1]).sum()) >= need
                keep.append(ok)
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(frugal(run), "a long, b long")


class CountTree:
    """An R-tree, bulk loaded from points in a given order, with upper corners of its nodes and least set sizes."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray, parts: np.ndarray):
        self.points, self.sizes, self.parts = points, sizes, parts
        self.levels = []  # from leaves up: upper corners, least sizes, smallest and largest component
        starts = np.arange(0, len(points), LEAF)
        level = tuple(f.reduceat(x, starts, axis=0) for f, x in ((np.maximum, points), (np.minimum, sizes), (np.minimum, parts), (np.maximum, parts)))
        self.levels.append(level)
        while len(self.levels[-1][0]) > 1:
            starts = np.arange(0, len(self.levels[-1][0]), LEAF)
            level = tuple(f.reduceat(x, starts, axis=0) for f, x in zip((np.maximum, np.minimum, np.minimum, np.maximum), self.levels[-1], strict=True))
            self.levels.append(level)

    def join(self, other: "CountTree", percent: int):
        """Pairs (i of self, j of other), from different components, whose bound on the overlap reaches what is needed."""
        todo = [(len(self.levels) - 1, 0, len(other.levels) - 1, 0)]
        while todo:
            la, ia, lb, ib = todo.pop()
            a, b = self.levels[la], other.levels[lb]
            if a[2][ia] == a[3][ia] == b[2][ib] == b[3][ib]:
                continue
            if np.minimum(a[0][ia], b[0][ib]).sum(dtype=np.int64) * (100 + percent) < percent * (a[1][ia] + b[1][ib]):
                continue
            if la == 0 and lb == 0:
                yield from self._leaves(ia, other, ib, percent)
            elif la >= lb:
                todo += [(la - 1, i, lb, ib) for i in range(ia * LEAF, min((ia + 1) * LEAF, len(self.levels[la - 1][0])))]
            else:
                todo += [(la, ia, lb - 1, i) for i in range(ib * LEAF, min((ib + 1) * LEAF, len(other.levels[lb - 1][0])))]

    def _leaves(self, ia: int, other: "CountTree", ib: int, percent: int):
        a, b = slice(ia * LEAF, (ia + 1) * LEAF), slice(ib * LEAF, (ib + 1) * LEAF)
        na, nb = self.sizes[a], other.sizes[b]
        total = na[:, None] + nb[None, :]
        open_ = (self.parts[a][:, None] != other.parts[b][None, :]) & (np.minimum(na[:, None], nb[None, :]) * (100 + percent) >= percent * total)
        if open_.any():
            i, j = np.nonzero(open_)
            bound = np.minimum(self.points[a][i], other.points[b][j]).sum(axis=1, dtype=np.int64)
            ok = bound * (100 + percent) >= percent * total[i, j]
            if ok.any():
                i, j = i[ok], j[ok]
                yield i + ia * LEAF, j + ib * LEAF, bound[ok] / total[i, j]


def best_of(ids, parts, first, second, rating, most: int | None):
    """Of all candidate pairs (positions), the `most` best rated of every row with every other component."""
    if most is None or len(first) <= most:
        return first, second
    keep = np.zeros(len(first), bool)
    for mine, theirs in ((first, second), (second, first)):
        order = np.lexsort((ids[theirs], -rating, parts[theirs], mine))
        new = np.concatenate([[True], (np.diff(mine[order]) != 0) | (np.diff(parts[theirs][order]) != 0)])
        start = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
        keep[order[np.arange(len(order)) - start < most]] = True
    return first[keep], second[keep]


def tree_pairs(block: int, rows: list[tuple], percent: int, most: int | None = None) -> list[tuple[int, int]]:
    """rows (id, component, n, vector, side, keys) -> candidate pairs; of two sides, only pairs across them.

    A pair that meets in several blocks belongs to that of its first common key and is left out elsewhere.
    """
    ids, parts, sizes = (np.array([r[i] for r in rows], np.int64) for i in range(3))
    by_bits: dict[tuple[int, int], list[int]] = {}
    for i, row in enumerate(rows):
        by_bits.setdefault((len(row[3]).bit_length() - 1, row[4]), []).append(i)
    sides = sorted({r[4] for r in rows})
    found: list[tuple] = []

    def tree(part: list[int], groups: int):
        at = np.array(part)
        at = at[np.lexsort((ids[at], sizes[at], parts[at]))]
        points = np.stack([rows[i][3] if len(rows[i][3]) == groups else folded(rows[i][3], groups) for i in at])
        if points.max(initial=0) == 65535:  # full counters bound nothing
            points = np.where(points == 65535, np.int64(1) << 40, points.astype(np.int64))
        return at, CountTree(points, sizes[at], parts[at])

    for k, s in sorted(by_bits):
        for m in (k, k + 1):
            for t in sides:
                if (len(sides) > 1 and s == t) or (m == k and s > t) or (m, t) not in by_bits:
                    continue
                at_a, a = tree(by_bits[k, s], 1 << k)
                same = (k, s) == (m, t)
                at_b, b = (at_a, a) if same else tree(by_bits[m, t], 1 << k)
                for i, j, rating in a.join(b, percent):
                    if same:
                        half = i < j
                        i, j, rating = i[half], j[half], rating[half]
                    found.append((at_a[i], at_b[j], rating))
    if not found:
        return []
    first, second, rating = (np.concatenate(x) for x in zip(*found, strict=True))
    keys = np.stack([r[5] for r in rows])
    band = int(np.flatnonzero(keys[0] == block)[0])
    mine = ~(keys[first, :band] == keys[second, :band]).any(axis=1)
    first, second = best_of(ids, parts, first[mine], second[mine], rating[mine], most)
    x, y = np.minimum(ids[first], ids[second]), np.maximum(ids[first], ids[second])
    return list(set(zip(x.tolist(), y.tolist(), strict=True)))


def block_pairs(rows: DataFrame, percent: int = PERCENT, most: int | None = None) -> DataFrame:
    """rows (block, task, side, id, component, n, points, keys) -> distinct pairs (a, b) that the trees leave."""

    def as_batch(found):
        return pa.RecordBatch.from_pydict({"a": pa.array([p[0] for p in found], pa.int64()), "b": pa.array([p[1] for p in found], pa.int64())})

    def run(batches):
        held, key = [], None
        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(8)]
            found: set = set()
            for block, task, side, id_, component, n, points, keys in zip(*columns, strict=True):
                if (block, task) != key:
                    found.update(tree_pairs(key[0], held, percent, most) if len(held) > 1 else ())
                    held, key = [], (block, task)
                held.append((id_, component, n, np.frombuffer(points, np.uint16), side, np.frombuffer(keys, np.int64)))
            yield as_batch(found)
        yield as_batch(tree_pairs(key[0], held, percent, most) if len(held) > 1 else ())

    return rows.repartition(partitions(rows.sparkSession), "block", "task").sortWithinPartitions("block", "task").mapInArrow(frugal(run), "a long, b long").distinct()


def chunked(rows: DataFrame, sizes: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Send each row of a block to the tasks of its chunk: one task for a small block, else one for every two chunks."""
    count = F.greatest(F.lit(1), F.ceil(F.col("m") / chunk)).cast("int")
    mine = F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int")
    tasks = F.when(F.col("chunks") == 1, F.array(F.lit(0))).otherwise(F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda j: F.least(F.col("mine"), j) * F.col("chunks") + F.greatest(F.col("mine"), j)))
    placed = rows.join(sizes.withColumn("chunks", count), "block").withColumn("mine", mine)
    # in the task of one chunk all rows are on one side; in a task of two chunks the larger chunk is side 1
    exploded = placed.withColumn("task", F.explode(tasks))
    low = F.floor(F.col("task") / F.col("chunks"))
    side = F.when((F.col("chunks") > 1) & (low != F.col("task") % F.col("chunks")) & (F.col("mine") != low), 1).otherwise(0).cast("int")
    return exploded.select("block", F.col("task").cast("long").alias("task"), side.alias("side"), "id", "component")


def similar_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT, chunk: int = CHUNK) -> DataFrame:
    """One row per row of docs: id_col, n_shingles, component_id (the smallest id that links reach, itself included).

    Null and empty texts have no shingles and link with nothing.  Rows that share an id count as one node.  Rows
    without an id keep their n_shingles and have no component.  Equal texts always link.
    """
    spark = docs.sparkSession
    ids = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    keys = staged(keys_of(ids, "id", "text", words), "shingle-keys")
    some = keys.where("signature is not null and id is not null")
    classes = staged(some.groupBy("signature").agg(F.min("id").alias("id")), "classes")
    members = some.join(classes, ["signature", "id"]).dropDuplicates(["signature"])
    postings = staged(members.select("id", F.col("n_shingles").alias("n"), F.explode("keys").alias("block")), "postings")
    pivots = postings.groupBy("block").agg(F.min(F.struct("id", "n")).alias("pivot"), F.max("id").alias("last")).where("pivot.id <> last")
    pivots = staged(pivots.select("block", F.col("pivot.id").alias("pivot"), F.col("pivot.n").alias("pivot_n")), "pivots")
    shared = staged(postings.join(pivots, "block"), "shared-blocks")
    discard(postings, pivots)
    release(spark)
    fit = F.least("n", "pivot_n") * (100 + percent) >= percent * (F.col("n") + F.col("pivot_n"))  # sets of other sizes cannot link
    stars = staged(shared.where(F.col("id") != F.col("pivot")).where(fit).select(F.col("pivot").alias("a"), F.col("id").alias("b")).distinct(), "stars")
    wanted = staged(shared.select("id").distinct(), "shared-ids")
    sets = staged(sets_of(ids.select("id", text_or_empty("text").alias("text")), id_bitmap(wanted), words), "sets")
    discard(wanted)
    links = staged(verified(stars, sets, percent), "links")
    release(spark)
    tested, parts = stars, connected_components(links)
    spent = [shared, sets, stars, links]
    for most in ROUNDS:
        placed = staged(shared.select("block", "id").join(parts.toDF("id", "component"), "id", "left").select("block", "id", F.coalesce("component", "id").alias("component")), "placed")
        mixed = staged(placed.groupBy("block").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count(F.lit(1)).alias("m")).where("lo <> hi").select("block", "m"), "mixed-blocks")
        # rows find their tasks before the points come to them, so points are exchanged once
        rows = chunked(placed, mixed, chunk).join(sets.select("id", "n", "points", "keys"), "id").select("block", "task", "side", "id", "component", "n", "points", "keys")
        pairs = staged(block_pairs(rows, percent, most).join(tested, ["a", "b"], "left_anti"), "tree-pairs")
        needed = staged(pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct(), "paired-ids")
        more = staged(verified(pairs, sets.join(needed, "id", "left_semi"), percent), "links")
        tested = tested.union(pairs)
        discard(placed, mixed, needed)
        release(spark)
        spent += [pairs, more]
        if not more.isEmpty():
            links = links.union(more)
            spent.append(parts)
            parts = connected_components(links)
    by_class = staged(classes.join(parts.toDF("id", "component"), "id", "left").select("signature", F.coalesce("component", "id").alias("component_id")), "class-components")
    discard(*spent, parts)
    out = keys.select("id", "n_shingles", "signature").join(by_class, "signature", "left")
    return out.select(F.col("id").cast(docs.schema[id_col].dataType).alias(id_col), "n_shingles", F.coalesce("component_id", "id").alias("component_id"))
