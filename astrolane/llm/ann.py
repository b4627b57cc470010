"""Near-duplicate vectors by a flat, robust-pruned graph.

Vectors that link with nothing stay out of the graph: every vector goes to one bucket of each of some tables, by its
signs on random hyperplanes, and in a bucket all pairs are compared by 64 further signs.  Tables and bits follow from
the number of rows so that a pair at the limit is missed with a chance of `miss`; a vector with a close sketch in any
bucket is indexed.

Vectors of one label are dealt to overlapping shards (each to its nearest pivots, if the second is nearly as close).
Every shard builds a graph in which a vector keeps a close neighbour only if no kept one is closer to it (robust
pruning, slack ALPHA) and takes in reverse edges, pruned again where they are many; the adjacency lists of a vector
from its shards are united.  Each vector is then searched for: a greedy walk from the shard's medoids with a short
beam, which widens around everything it finds in range until nothing new is.  What it meets is verified by the
cosine in double precision.  Every link found joins components; a link counts in one shard only (the first that holds
both), so no list of all pairs is made: a shard passes on a count for each vector and a spanning forest of its
links.  The recall against brute force is audited on all vectors whose id is divisible by 100; below the target the
index is built again with more overlap and a wider beam.

Equal vectors are one class throughout.  Shards that pivots cannot split (very many vectors in one spot) are cut
into chunks which meet two at a time.
"""

from __future__ import annotations

import logging
import math
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected_components
from .chunks import spans
from .common import bits_set, bitmap_size, discard, partitions, staged

LEAST = 0.98
log = logging.getLogger(__name__)


@dataclass(frozen=True)
class Settings:
    shard_rows: int = 512  # shards larger than twice this are split
    overlap: int = 2
    margin: float = 0.2  # a second pivot takes a vector only if it is nearly as close as the first
    degree: int = 24
    pool: int = 48
    beam: int = 24
    alpha: float = 1.2
    slack: float = 0.03  # the walk goes on through what lies so far below the limit
    chunk: int = 2048
    round_pivots: int = 16_384  # broadcast at once: at most so many vectors
    queries: int = 16_384  # of the audit: at most so many vectors are broadcast at once
    screen: bool = True  # leave vectors without a close sketch out of the graph
    bucket_rows: int = 32
    bucket_most: int = 4096
    miss: float = 0.002
    recall: float = 0.95
    seed: int = 5


def read_rows(rows: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """id, label, v of the given rows."""
    kind = rows.schema[vector_col].dataType.simpleString()
    vector = F.col(vector_col) if kind in ("array<float>", "array<double>") else F.col(vector_col).cast("array<double>")
    return rows.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"), vector.alias("v"))


def directions(column: pa.Array):
    """(rows, unit vectors) for every length of vectors; without those that link with nothing."""
    lengths = np.asarray(pc.fill_null(pc.list_value_length(column), 0))
    values = np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64)  # nulls become NaN
    starts = np.cumsum(lengths, dtype=np.int64) - lengths
    for n in np.unique(lengths[lengths > 0]).tolist():
        at = np.flatnonzero(lengths == n)
        v = values[starts[at, None] + np.arange(n)]
        top = np.abs(v).max(axis=1)
        good = np.isfinite(top) & (top > 0)
        v = v[good] / top[good, None]
        if len(v):
            yield at[good], v / np.sqrt((v * v).sum(axis=1))[:, None]


def labelled(batch: pa.RecordBatch):
    """(rows, unit vectors, cls and check) of a batch (id, label, v): 128 bits that name the label and the vector."""
    labels = batch.column(1).to_pylist()
    for at, unit in directions(batch.column(2)):
        some = np.array([labels[i] is not None for i in at.tolist()], bool)
        at, unit = at[some], unit[some]
        if len(at):
            names = b"".join(xxhash.xxh3_128_digest(v.tobytes() + labels[i].encode()) for i, v in zip(at.tolist(), unit, strict=True))
            yield at, unit, np.frombuffer(names, "<i8").reshape(-1, 2)


def named(source: DataFrame) -> DataFrame:
    """id, label, cls, check of every row; no cls if it links with nothing."""

    def run(batches):
        for batch in batches:
            names, known = np.zeros((len(batch), 2), np.int64), np.zeros(len(batch), bool)
            for at, _, both in labelled(batch):
                names[at], known[at] = both, True
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(names[:, i], mask=~known) for i in range(2))], names=["id", "label", "cls", "check"])

    return source.mapInArrow(run, "id long, label string, cls long, check long")


def vectors_of(source: DataFrame, bitmap: np.ndarray | None = None) -> DataFrame:
    """id, label, cls, check, vec (packed doubles) of the rows that can link; given a bitmap, of classes with a bit in it."""

    def run(batches):
        for batch in batches:
            for at, unit, names in labelled(batch):
                if bitmap is not None:
                    bit = names[:, 0] & (64 * len(bitmap) - 1)  # the size is a power of two
                    hit = (bitmap[bit >> 6] >> (bit & 63) & 1).astype(bool)
                    at, unit, names = at[hit], unit[hit], names[hit]
                part = batch.take(pa.array(at))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(names[:, 0]), pa.array(names[:, 1]), pa.array([v.tobytes() for v in unit], pa.binary())], names=["id", "label", "cls", "check", "vec"])

    return source.where("id is not null").mapInArrow(run, "id long, label string, cls long, check long, vec binary")


def sketch_plan(n: int, least: float, s: Settings) -> tuple[int, int]:
    """Bits of a table's keys and number of tables: about bucket_rows unrelated rows of a label share a key, and a pair
    with a cosine of `least` shares none with a probability of at most `miss`."""
    bits = max(0, math.ceil(math.log2(max(1, n / s.bucket_rows))))
    same = (1 - math.acos(min(1.0, max(-1.0, least))) / math.pi) ** bits
    return bits, 1 if same >= 1 else max(1, math.ceil(math.log(s.miss) / math.log(1 - same)))


def bucketed(source: DataFrame, bits: int, tables: int, seed: int) -> DataFrame:
    """key, cls, sketch: every class that can link, in one bucket of each table.

    A key holds the signs on `bits` random hyperplanes, the sketch those on 64 others.
    """

    def run(batches):
        planes: dict[int, np.ndarray] = {}
        weights = 1 << np.arange(bits, dtype=np.int64)
        for batch in batches:
            labels = batch.column(1).to_pylist()
            for at, unit, names in labelled(batch):
                n = unit.shape[1]
                if n not in planes:
                    planes[n] = np.random.default_rng([seed, n]).normal(size=(n, bits * tables + 64))
                _, first = np.unique(names[:, 0], return_index=True)  # copies come once
                at, unit, names = at[first], unit[first], names[first]
                signs = unit @ planes[n] > 0
                sketch = np.packbits(signs[:, -64:], axis=1).view("<i8")[:, 0]
                keys = signs[:, :-64].reshape(len(at), tables, bits) @ weights
                part = {x: xxhash.xxh3_64_intdigest(x.encode(), n) for x in {labels[i] for i in at.tolist()}}
                base = np.array([part[labels[i]] for i in at.tolist()], np.uint64)
                step = (keys * tables + np.arange(tables)).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
                mixed = base[:, None] ^ step
                mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xC2B2AE3D27D4EB4F)
                yield pa.RecordBatch.from_arrays([pa.array(mixed.view(np.int64).ravel()), pa.array(np.repeat(names[:, 0], tables)), pa.array(np.repeat(sketch, tables))], names=["key", "cls", "sketch"])

    return source.where("id is not null").mapInArrow(run, "key long, cls long, sketch long")


def close_in_buckets(key: np.ndarray, cls: np.ndarray, sketch: np.ndarray, differ: int, most: int) -> np.ndarray:
    """Rows (sorted by key) that differ in at most `differ` bits from another class of their bucket; all of a bucket of more than `most`."""
    starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    size = np.diff(np.append(starts, len(key)))
    close = np.repeat(size > most, size)
    left = np.repeat(starts + size, size) - np.arange(len(key))  # rows from here to the bucket's end
    at = np.flatnonzero(~close & (left > 1))
    step = 1
    while len(at):
        near = at[(np.bitwise_count(sketch[at] ^ sketch[at + step]) <= differ) & (cls[at] != cls[at + step])]
        close[near] = close[near + step] = True
        step += 1
        at = at[left[at] > step]
    return close


def suspects(source: DataFrame, n: int, least: float, s: Settings) -> DataFrame:
    """cls of the vectors that may link with another: the graph is built over these.

    Every pair of a bucket is compared by sketches, so a vector stays out only if all tables part it from all it links
    with (`miss` for a single pair at the limit, far less for closer or several ones).
    """
    bits, tables = sketch_plan(n, least, s)
    differ, most = math.ceil(64 * math.acos(min(1.0, max(-1.0, least))) / math.pi) + 8, s.bucket_most
    rows = bucketed(source, bits, tables, s.seed)

    def run(batches):
        held, hot = [np.zeros(0, np.int64)] * 3, None
        for batch in batches:
            now = [np.concatenate([h, batch.column(i).to_numpy()]) for i, h in enumerate(held)]
            if hot is not None:  # more of a bucket that is let through whole
                end = int(np.searchsorted(now[0], hot, "right"))
                yield pa.RecordBatch.from_arrays([pa.array(now[1][:end])], names=["cls"])
                now = [x[end:] for x in now]
            if not len(now[0]):
                held = now
                continue
            hot, at = None, int(np.searchsorted(now[0], now[0][-1], "left"))
            held = [x[at:] for x in now]
            found = [now[1][:at][close_in_buckets(*(x[:at] for x in now), differ, most)]]
            if len(held[0]) > most:
                hot = int(held[0][0])
                found.append(held[1])
                held = [x[:0] for x in held]
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.concatenate(found)))], names=["cls"])
        yield pa.RecordBatch.from_arrays([pa.array(np.unique(held[1][close_in_buckets(*held, differ, most)]))], names=["cls"])

    return rows.repartition(partitions(rows.sparkSession), "key").sortWithinPartitions("key").mapInArrow(run, "cls long").distinct()


def matrix(column) -> np.ndarray:
    parts = [np.frombuffer(x.as_buffer(), np.float64) for x in column]
    return np.stack(parts) if parts else np.zeros((0, 1))


def apart(pivots: np.ndarray, least: float) -> np.ndarray:
    """Without pivots that are within twice a link's angle of an earlier one: several in one group of near copies would cut it."""
    limit = math.cos(min(math.pi, 2 * math.acos(min(1.0, max(-1.0, least)))))
    kept = [0]
    for i in range(1, len(pivots)):
        if (pivots[kept] @ pivots[i]).max() < limit:
            kept.append(i)
    return pivots[kept]


def sharded(classes: DataFrame, s: Settings, least: float = LEAST) -> DataFrame:
    """(cls, label, vec) -> shards: the ids of the shards of each class, nearest first.  Labels and dimensions part shards."""
    spark = classes.sparkSession
    now = staged(classes.select("cls", F.xxhash64("label", F.octet_length("vec")).alias("shard")).select("cls", "shard", F.lit(False).alias("done")), "shards")
    while True:
        sizes = now.where("NOT done").groupBy("shard").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 2 * s.shard_rows)
        fan = F.least(F.lit(64), F.ceil(F.col("n") / s.shard_rows)).cast("int")
        large = staged(sizes.withColumn("fan", fan).orderBy(F.desc("n"), "shard").limit(s.round_pivots // 64), "large-shards")
        if large.isEmpty():
            discard(large)
            break
        # Broadcast: at most round_pivots // 64 shards, each with at most 64 pivots.
        inside = now.join(F.broadcast(large), "shard")
        likely = inside.where(F.pmod(F.xxhash64("cls", F.lit(s.seed)), F.col("n")) < 4 * F.col("fan")).select("shard", "cls", "fan")
        picked = likely.groupBy("shard").agg(F.slice(F.array_sort(F.collect_list(F.struct(F.xxhash64("cls").alias("h"), "cls"))), 1, F.first("fan")).alias("p"))
        pivots = {}
        for r in picked.select("shard", F.explode("p.cls").alias("cls")).join(classes.select("cls", "vec"), "cls").orderBy("shard", "cls").collect():
            pivots.setdefault(r["shard"], []).append(np.frombuffer(r["vec"], np.float64))
        pivots = {k: apart(np.stack(v), least) for k, v in pivots.items()}
        overlap, margin, seed = s.overlap, s.margin, s.seed

        def split(batches, pivots=pivots, overlap=overlap, margin=margin, seed=seed):
            for batch in batches:
                shards, vectors = batch.column(1).to_numpy(), matrix(batch.column(2))
                owner, out, done = [], [], []
                for shard in np.unique(shards):
                    at = np.flatnonzero(shards == shard)
                    p = pivots.get(int(shard))
                    if p is None or len(p) < 2:
                        owner += at.tolist()
                        out += [int(shard)] * len(at)
                        done += [True] * len(at)
                        continue
                    sims = vectors[at] @ p.T
                    near = np.argsort(-sims, axis=1, kind="stable")[:, :overlap]
                    close = np.take_along_axis(sims, near, axis=1)
                    close = close >= close[:, :1] - margin
                    names = np.array([hash((int(shard), i, seed)) for i in range(len(p))], np.int64)
                    owner += np.repeat(at, close.sum(axis=1)).tolist()
                    out += names[near[close]].tolist()
                    done += [False] * int(close.sum())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner, pa.int64())), pa.array(out, pa.int64()), pa.array(done, pa.bool_())], names=["cls", "shard", "done"])

        parts = inside.select("cls", "shard").join(classes.select("cls", "vec"), "cls").select("cls", "shard", "vec").mapInArrow(split, "cls long, shard long, done boolean")
        after = staged(parts.union(now.join(F.broadcast(large.select("shard")), "shard", "left_anti").select("cls", "shard", "done")).distinct(), "shards")
        # a child nearly as large as its parent lies in one spot: no further splits
        stuck = after.where("NOT done").groupBy("shard").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > 0.95 * large.agg(F.max("n")).first()[0])
        after = staged(after.join(stuck.select("shard", F.lit(True).alias("stuck")), "shard", "left").select("cls", "shard", (F.col("done") | F.coalesce("stuck", F.lit(False))).alias("done")), "shards")
        discard(now, large)
        now = after
    return now.groupBy("cls").agg(F.array_sort(F.collect_set("shard")).alias("shards"))


def units(classes: DataFrame, shards: DataFrame, s: Settings) -> DataFrame:
    """unit, first, second, chunk, shard, cls, mult, vec, shards: the rows of every task."""
    rows = classes.join(shards, "cls").withColumn("shard", F.explode("shards"))
    size = rows.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).withColumn("chunks", F.greatest(F.lit(1), F.ceil(F.col("n") / s.chunk)).cast("int"))
    dealt = rows.join(size, "shard").withColumn("chunk", F.pmod(F.xxhash64("cls"), F.col("chunks")).cast("int"))
    other = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    pair = other.withColumn("first", F.least("chunk", "other")).withColumn("second", F.greatest("chunk", "other"))
    return pair.select(F.xxhash64("shard", "first", "second").alias("unit"), "first", "second", "chunk", "shard", "cls", "mult", "vec", "shards")


def pruned(sims: np.ndarray, own: int, candidates: np.ndarray, degree: int, alpha: float) -> list[int]:
    """Robust pruning: nearest candidates first, without those that a kept one is alpha times closer to."""
    left = candidates[np.argsort(-sims[own, candidates], kind="stable")]
    kept: list[int] = []
    while len(left) and len(kept) < degree:
        p = int(left[0])
        kept.append(p)
        left = left[1:]
        left = left[alpha * (1 - sims[p, left]) > 1 - sims[own, left]]
    return kept


def build_graph(vectors: np.ndarray, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Edges of every row, one row after another, and where each row's begin (and the last one's end)."""
    n = len(vectors)
    sims = vectors @ vectors.T
    np.fill_diagonal(sims, -2.0)
    rng = np.random.default_rng(s.seed)
    pool = min(s.pool, n - 1)
    found = [np.zeros(0, np.int64)]
    for at in range(0, n, 512):  # all rows of a part are pruned at once, one kept neighbour a step
        rows = np.arange(at, min(n, at + 512))
        near = np.argpartition(-sims[rows], pool - 1, axis=1)[:, :pool] if pool > 0 else np.zeros((len(rows), 0), np.int64)
        near = np.sort(np.concatenate([near, rng.integers(0, n, (len(rows), 16))], axis=1), axis=1)
        open_ = near != rows[:, None]
        open_[:, 1:] &= near[:, 1:] != near[:, :-1]
        own = np.take_along_axis(sims[rows], near, axis=1)
        order = np.argsort(-own, axis=1, kind="stable")
        near, own, open_ = (np.take_along_axis(x, order, axis=1) for x in (near, own, open_))
        for _ in range(s.degree):
            left = open_.any(axis=1)
            if not left.all():
                rows, near, own, open_ = rows[left], near[left], own[left], open_[left]
            if not len(rows):
                break
            first = open_.argmax(axis=1)
            kept = near[np.arange(len(rows)), first]
            found += [rows * n + kept, kept * n + rows]  # the edge and its reverse
            open_[np.arange(len(rows)), first] = False
            open_ &= s.alpha * (1 - sims[kept[:, None], near]) > 1 - own
    edges = np.unique(np.concatenate(found))
    starts = np.searchsorted(edges, np.arange(n + 1) * n)
    crowded = np.flatnonzero(np.diff(starts) > 2 * s.degree)  # reverse edges are pruned again where there are too many
    if len(crowded):
        again = [i * n + np.array(pruned(sims, i, edges[starts[i] : starts[i + 1]] % n, s.degree, s.alpha)) for i in crowded.tolist()]
        edges = np.sort(np.concatenate([edges[~np.isin(edges // n, crowded)], *again]))
        starts = np.searchsorted(edges, np.arange(n + 1) * n)
    return edges % n, starts


def medoids(vectors: np.ndarray, n: int = 4) -> list[int]:
    """The vector nearest to the mean, then those farthest from the ones taken."""
    taken = [int(np.argmax(vectors @ vectors.mean(axis=0)))]
    closest = vectors @ vectors[taken[0]]
    while len(taken) < min(n, len(vectors)):
        taken.append(int(np.argmin(closest)))
        closest = np.maximum(closest, vectors @ vectors[taken[-1]])
    return taken


def range_search(vectors: np.ndarray, edges: np.ndarray, starts: np.ndarray, entries: list[int], query: int, s: Settings, least: float) -> np.ndarray:
    """Rows met with a cosine of at least `least` to row `query`; the walk starts at the entries and the query's place is not known to it."""
    seen = np.zeros(len(vectors), bool)
    q = vectors[query]
    at = np.array(entries)
    seen[at] = True
    pool_at, pool_sim, open_ = at, vectors[at] @ q, np.ones(len(at), bool)
    found: list[np.ndarray] = []
    while True:
        wide = open_ & (pool_sim >= least - s.slack)  # all that lies in range is gone through at once
        if not wide.any():
            rank = np.argsort(-pool_sim, kind="stable")[: s.beam]
            pool_at, pool_sim, open_ = pool_at[rank], pool_sim[rank], open_[rank]
            if not open_.any():
                break
            wide = np.zeros(len(open_), bool)
            wide[np.flatnonzero(open_)[:4]] = True
        begin = starts[pool_at[wide]]
        met = np.zeros(len(vectors), bool)
        met[edges[spans(begin, starts[pool_at[wide] + 1] - begin)]] = True
        open_ = open_ & ~wide
        step = np.flatnonzero(met & ~seen)
        seen[step] = True
        sim = vectors[step] @ q
        found.append(step[sim >= least])
        pool_at, pool_sim, open_ = np.concatenate([pool_at, step]), np.concatenate([pool_sim, sim]), np.concatenate([open_, np.ones(len(step), bool)])
    found.append(at[vectors[at] @ q >= least])
    hits = np.concatenate(found)
    return hits[hits != query]


def searched(rows: DataFrame, least: float, s: Settings) -> DataFrame:
    """Per unit: (a, null, n) adds n links to class a; (a, b, null) is an edge of the unit's spanning forest."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("cls")
        cls, mult, chunk = (table.column(c).to_numpy() for c in ("cls", "mult", "chunk"))
        first, second, shard = (table.column(c)[0].as_py() for c in ("first", "second", "shard"))
        vectors, shards = matrix(table.column("vec")), table.column("shards").to_pylist()
        lists = table.column("neighbours").combine_chunks()
        owner = np.repeat(np.arange(len(cls)), np.asarray(pc.fill_null(pc.list_value_length(lists), 0)))
        found = np.asarray(lists.flatten())
        place = np.minimum(np.searchsorted(cls, found), len(cls) - 1)
        here = (cls[place] == found) & (place != owner)
        edges, starts = place[here], np.concatenate([[0], np.cumsum(np.bincount(owner[here], minlength=len(cls)))])
        entries, n = medoids(vectors), len(cls)
        linked = np.zeros((n, n), bool)  # a unit has at most two chunks
        for i in range(n):
            linked[i, range_search(vectors, edges, starts, entries, i, s, least)] = True
        linked |= linked.T  # what one of the two finds, both have found
        # every link that was found joins, wherever it is counted
        label, before = np.arange(n), None
        while before is None or (label != before).any():
            before = label
            label = np.array([min(before[i], before[row].min(initial=n)) for i, row in enumerate(linked)])
            label = label[label]
        joined = np.flatnonzero(label != np.arange(n))
        # a link counts in the first shard that holds both, in the unit of its chunks
        earlier = sorted({x for names in shards for x in names if x < shard})
        place = {x: i for i, x in enumerate(earlier)}
        inside = np.zeros((n, max(1, len(earlier))), np.float32)
        for i, names in enumerate(shards):
            inside[i, [place[x] for x in names if x < shard]] = 1
        for at in range(0, n, 512):
            part = slice(at, at + 512)
            low, high = np.minimum(chunk[part, None], chunk[None, :]), np.maximum(chunk[part, None], chunk[None, :])
            linked[part] &= (low == first) & (high == second) & (inside[part] @ inside.T == 0)
        total = linked @ mult
        counted = np.flatnonzero(total)
        a, b = np.concatenate([cls[joined], cls[counted]]), [*cls[label[joined]].tolist(), *[None] * len(counted)]
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "n": pa.array([*[None] * len(joined), *total[counted].tolist()], pa.int64())})

    return rows.groupBy("unit").applyInArrow(run, "a long, b long, n long")


def adjacency(rows: DataFrame, s: Settings) -> DataFrame:
    """cls -> neighbours: the lists that its units built, united."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("cls")
        cls = table.column("cls").to_numpy()
        edges, starts = build_graph(matrix(table.column("vec")), s)
        return pa.table({"cls": pa.array(cls), "near": pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array(cls[edges], pa.int64()))})

    lists = rows.groupBy("unit").applyInArrow(run, "cls long, near array<long>")
    return lists.select("cls", F.explode("near").alias("near")).groupBy("cls").agg(F.collect_set("near").alias("neighbours"))


def audit(source: DataFrame, counts: DataFrame, least: float, s: Settings) -> float:
    """Links found over links there are, of all rows whose id is divisible by 100 (if there are none, of one in a
    hundred by hash, or of all), asked against all rows in rounds of at most `queries` broadcast vectors."""
    tests = ("id % 100 = 0", "pmod(xxhash64(id), 100) = 0", "true")
    for test in tests:
        asked = staged(vectors_of(source.where(test)).dropDuplicates(["cls"]).select("cls", "label", "vec"), "asked")
        n = asked.count()
        if n:
            break
        discard(asked)
    else:
        return 1.0
    found, turn = [0.0, 0.0], 0
    turns = 1 if n <= s.queries else -(-5 * n // (4 * s.queries))  # a quarter more than needed, so that each stays within the bound
    for turn in range(turns):
        part = asked.where(F.pmod(F.xxhash64("cls", F.lit("turn")), F.lit(turns)) == turn).collect()
        if part:
            found = [x + y for x, y in zip(found, _audit_some(source, counts, least, part), strict=True)]
    discard(asked)
    return 1.0 if not found[0] else found[1] / found[0]


def _audit_some(source: DataFrame, counts: DataFrame, least: float, asked: list) -> tuple[float, float]:
    """Brute force: single precision rules out what is far below the limit, double precision decides the rest."""
    ids = np.array([r["cls"] for r in asked])
    groups: dict[tuple, list[int]] = {}
    for i, r in enumerate(asked):
        groups.setdefault((r["label"], len(r["vec"]) // 8), []).append(i)
    stacked = {k: (np.array(v), np.stack([np.frombuffer(asked[i]["vec"], np.float64) for i in v])) for k, v in groups.items()}
    del groups, asked

    def run(batches):
        total = np.zeros(len(ids), np.int64)
        single = {k: v.astype(np.float32) for k, (_, v) in stacked.items()}
        for batch in batches:
            labels = batch.column(1).dictionary_encode()
            code = labels.indices.fill_null(-1).to_numpy()
            for at, unit, names in labelled(batch):
                for i, label in enumerate(labels.dictionary.to_pylist()):
                    rows, k = np.flatnonzero(code[at] == i), (label, unit.shape[1])
                    if k not in stacked:
                        continue
                    mine, queries = stacked[k]
                    for some in np.array_split(rows, max(1, -(-len(rows) // 256))):
                        x, y = np.nonzero(unit[some].astype(np.float32) @ single[k].T >= least - 1e-4)
                        for part in range(0, len(x), 1 << 16):
                            a, b = some[x[part : part + (1 << 16)]], y[part : part + (1 << 16)]
                            hit = ((unit[a] * queries[b]).sum(axis=1) >= least) & (names[a, 0] != ids[mine[b]])
                            total += np.bincount(mine[b[hit]], minlength=len(ids))
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(total)], names=["cls", "n"])

    true = source.where("id is not null").mapInArrow(run, "cls long, n long").groupBy("cls").agg(F.sum("n").alias("n_true"))
    both = true.join(counts, "cls", "left").agg(F.sum("n_true"), F.sum(F.least(F.coalesce("n", F.lit(0)), "n_true"))).first()
    return float(both[0] or 0), float(both[1] or 0)


def near_vectors(rows: DataFrame, least: float = LEAST, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", settings: Settings = Settings()) -> DataFrame:
    """One row per row: id_col, n_links (other rows of its label with a cosine of at least `least`), component_id
    (the smallest id that links reach) and kept (it is that one).

    Rows with a null label, or a vector that is null, empty, zero or holds nulls or non-finite numbers, link with
    nothing.  Vectors of different lengths do not link.  Repeated rows link with each other, rows with equal ids
    and different vectors are told apart by their vectors, and rows without an id link with nothing.
    """
    source = read_rows(rows, id_col, vector_col, label_col)
    own = staged(named(source), "vector-names")
    some = own.where("cls is not null and id is not null")
    most = some.groupBy("label").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    tries = [settings, replace(settings, overlap=settings.overlap + 2, margin=2.0, beam=4 * settings.beam, slack=0.1, shard_rows=2 * settings.shard_rows, miss=settings.miss / 100)]
    for s in tries:
        bitmap = None
        if s.screen:
            few = staged(suspects(source, most, least, s), "suspects")
            size = bitmap_size(few.count())
            bitmap = bits_set(few.selectExpr(f"cls & {size - 1}L AS bit"), size)
            discard(few)
        grouped = vectors_of(source, bitmap).groupBy("cls", "check", "label", "vec").agg(F.count(F.lit(1)).alias("mult"))
        classes = staged(grouped, "vector-classes")
        lists = staged(sharded(classes, s, least), "shard-lists")
        work = staged(units(classes, lists, s), "units")
        near = staged(adjacency(work, s), "adjacency")
        found = staged(searched(work.join(near, "cls", "left"), least, s), "found")
        counts = staged(found.where("b is null").groupBy("a").agg(F.sum("n").alias("n")).select(F.col("a").alias("cls"), "n"), "counts")
        discard(work, near, classes, lists)
        recall = audit(source, counts, least, s)
        if recall >= s.recall:
            break
    if recall < 0.9:
        raise RuntimeError(f"recall {recall:.3f} is below 0.9")
    if recall < settings.recall:
        log.warning("recall %.3f is below the target of %.3f", recall, settings.recall)
    parts = connected_components(found.where("b is not null").select("a", "b")).toDF("cls", "component")
    linked = counts.join(parts, "cls", "full_outer")
    groups = some.groupBy("cls", "check").agg(F.min("id").alias("least_id"), F.count(F.lit(1)).alias("mult"))
    of_class = staged(groups.join(linked, "cls", "left").where("mult > 1 or n is not null or component is not null").select("cls", "check", "least_id", (F.coalesce("n", F.lit(0)) + F.col("mult") - 1).alias("n_links"), F.coalesce("component", "cls").alias("component")), "class-links")
    smallest = of_class.groupBy("component").agg(F.min("least_id").alias("component_id"))
    out = own.join(staged(of_class.join(smallest, "component").select("cls", "check", "n_links", "component_id"), "class-links"), ["cls", "check"], "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id"))
    return out.select(F.col("id").alias(id_col), F.when(F.col("id").isNotNull(), F.coalesce("n_links", F.lit(0))).otherwise(0).cast("long").alias("n_links"), component.alias("component_id"), (component == F.col("id")).alias("kept"))
