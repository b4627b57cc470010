"""Toxicity by a factorization machine over hashed terms.

score = sigmoid(w0 + sum w_i + sum over pairs of <v_i, v_j>) over the hashed terms that a text holds.  The factor
vectors give every pair of terms a weight of its own, so an insult next to a group's name can count for more
than the two apart.  The machine is fitted on a bounded, documented sample of labelled rows, each distinct text
once, with every term that chance does not explain; every other row is only scored, in one pass without a shuffle.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, frugal, staged, text_or_empty

TERM = re.compile(r"[^\W_]+")
BUCKETS = 1 << 22
MAX_LABELLED = 20_000
PREFIX = 5
LEAST_CHI = 25.0  # a term that is chance reaches it once in millions
MAX_CACHED = 300_000
SCORED_AT_ONCE = 256


@dataclass(frozen=True)
class FactorizationMachine:
    """buckets[i] is feature i's term bucket; bias, linear (m,) and factors (m, k) are the fitted weights."""

    buckets: np.ndarray
    bias: float
    linear: np.ndarray
    factors: np.ndarray

    def scores(self, active: list[list[int]]) -> np.ndarray:
        parts = [self._scores(active[at : at + SCORED_AT_ONCE]) for at in range(0, len(active), SCORED_AT_ONCE)]
        return np.concatenate(parts) if parts else np.zeros(0)

    def _scores(self, active: list[list[int]]) -> np.ndarray:
        out = np.full(len(active), self.bias)
        sizes = np.array([len(a) for a in active])
        some = np.flatnonzero(sizes)
        if len(some):
            flat = np.concatenate([np.asarray(active[i], np.int64) for i in some])
            at = np.concatenate([[0], np.cumsum(sizes[some])[:-1]])
            v = self.factors[flat]
            sums, squares = np.add.reduceat(v, at, axis=0), np.add.reduceat(v * v, at, axis=0)
            out[some] += np.add.reduceat(self.linear[flat], at) + 0.5 * (sums * sums - squares).sum(axis=1)
        return 1.0 / (1.0 + np.exp(-np.clip(out, -40.0, 40.0)))


def bucket_of(term: str) -> int:
    return zlib.crc32(term.encode()) & (BUCKETS - 1)


def buckets_of(word: str) -> tuple[int, int]:
    """A word's terms: itself, and its first letters, which inflected and disguised forms share."""
    return bucket_of(word), bucket_of(f"{word[:PREFIX]}-")


def _buckets(text: str) -> list[int]:
    return sorted({b for t in set(TERM.findall(text.lower())) for b in buckets_of(t)})


def gradients(held: np.ndarray, y: np.ndarray, importance: np.ndarray, bias: float, linear: np.ndarray, factors: np.ndarray):
    """The mean weighted logistic loss of rows (0/1 matrix of held features) and its gradients."""
    sums = held @ factors
    margin = bias + held @ linear + 0.5 * ((sums**2).sum(1) - held @ (factors**2).sum(1))
    loss = float((importance * (np.logaddexp(0, margin) - y * margin)).mean())
    g = importance * (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - y) / len(y)
    return loss, g.sum(), held.T @ g, held.T @ (g[:, None] * sums) - factors * (held.T @ g)[:, None]


def balanced(y: np.ndarray) -> np.ndarray:
    """Weights that make both classes count alike."""
    share = min(max(float(y.mean()), 1e-3), 1 - 1e-3)
    return np.where(y > 0, 0.5 / share, 0.5 / (1 - share)).astype(np.float32)


def fit_weights(rows: list[np.ndarray], toxic: np.ndarray, n_features: int, k: int = 8, epochs: int = 40, seed: int = 7) -> tuple[float, np.ndarray, np.ndarray]:
    """Class-balanced logistic loss with weight decay, by Adam over mini-batches.  rows: each one's feature ids."""
    rng = np.random.default_rng(seed)
    y = toxic.astype(np.float32)
    importance = balanced(y)
    params = [np.zeros(1, np.float32), np.zeros(n_features, np.float32), rng.normal(0, 0.02, (n_features, k)).astype(np.float32)]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for at in range(0, len(order), 256):
            pick = order[at : at + 256]
            # only the columns of features that this batch holds
            held, place = np.unique(np.concatenate([rows[i] for i in pick]), return_inverse=True)
            b = np.zeros((len(pick), len(held)), np.float32)
            b[np.repeat(np.arange(len(pick)), [len(rows[i]) for i in pick]), place] = 1
            _, of_bias, of_linear, of_factors = gradients(b, y[pick], importance[pick], params[0], params[1][held], params[2][held])
            grads = [np.array([of_bias]), 1e-5 * params[1], 1e-4 * params[2]]
            grads[1][held] += of_linear
            grads[2][held] += of_factors
            step += 1
            for p, d, m, v in zip(params, grads, first, second, strict=True):
                m += 0.1 * (d - m)
                v += 0.001 * (d * d - v)
                p -= 0.03 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return float(params[0][0]), params[1].astype(np.float64), params[2].astype(np.float64)


def labelled_sample(labels: DataFrame, label_col: str, id_col: str = "doc_id", max_rows: int = MAX_LABELLED) -> DataFrame:
    """At most max_rows labelled ids, those with the smallest hashes; conflicting labels of an id count as 1."""
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
    one = known.groupBy(id_col).agg(F.max(F.col(label_col).cast("int")).alias("label"))
    return one.orderBy(F.xxhash64(id_col), id_col).limit(max_rows)


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text", max_rows: int = MAX_LABELLED) -> FactorizationMachine:
    """Fit on the distinct texts of at most max_rows labelled ids; conflicting labels of a text count as 1.

    Features are all term buckets whose chi-square against the label chance would not explain, however many.  Copies
    count once, there and in the fit, so a group of them gives its words no more weight than one text does.
    Without rows of both classes the machine has no features and gives every text the base rate.  Rows without an
    id, label or text teach nothing but the base rate; labels of ids that docs lacks are passed over.
    """
    sample = labelled_sample(labels, label_col, id_col, max_rows)

    def terms(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([_buckets(t) for t in batch.column(1).to_pylist()], pa.list_(pa.int32()))], names=["label", "buckets"])

    # Broadcast: at most max_rows pairs of numbers.
    known = docs.select(id_col, text_or_empty(text_col).alias("text")).join(F.broadcast(sample), id_col)
    hashed = staged(known.groupBy("text").agg(F.max("label").alias("label")).select("label", "text").mapInArrow(frugal(terms), "label int, buckets array<int>"), "terms")
    totals = {r["label"]: r["n"] for r in hashed.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    pos, neg = totals.get(1, 0), totals.get(0, 0)
    if not pos or not neg:
        discard(hashed)
        rate = pos / (pos + neg) if pos + neg else 0.0
        rate = min(max(rate, 1e-6), 1 - 1e-6)
        return FactorizationMachine(np.zeros(0, np.int64), float(np.log(rate / (1 - rate))), np.zeros(0), np.zeros((0, 1)))
    n = float(pos + neg)
    counts = hashed.select("label", F.explode("buckets").alias("bucket")).groupBy("bucket").agg(F.sum("label").cast("double").alias("a"), F.count(F.lit(1)).cast("double").alias("m"))
    a, m = F.col("a"), F.col("m")
    gap = a * n - m * pos
    chi = gap * gap * n / (m * (n - m) * float(pos) * float(neg) + F.lit(1e-9))
    chosen = counts.where((m >= 4) & (m < n) & (chi >= LEAST_CHI)).select("bucket").toArrow()
    buckets = np.sort(chosen.column("bucket").to_numpy().astype(np.int64))

    def places(batches):
        for batch in batches:
            lists = batch.column(1)
            found = lists.flatten().to_numpy()
            of_row = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy())
            at = np.searchsorted(buckets, found)
            hit = np.append(buckets, -1)[at] == found
            ends = np.cumsum(np.bincount(of_row[hit], minlength=len(lists)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.array(at[hit], pa.int32()))], names=["label", "hit"])

    # at most max_rows lists; put in order here, so that the fit does not depend on the order of tasks
    rows = [(x.values.to_numpy(), y) for batch in hashed.mapInArrow(frugal(places), "label int, hit array<int>").toArrow().to_batches() for x, y in zip(batch.column(1), batch.column(0).to_pylist(), strict=True)]
    discard(hashed)
    rows.sort(key=lambda r: (r[0].astype(">u4").tobytes(), r[1]))
    bias, linear, factors = fit_weights([r[0] for r in rows], np.array([r[1] for r in rows]), len(buckets))
    return FactorizationMachine(buckets, bias, linear, factors)


def score(docs: DataFrame, machine: FactorizationMachine, keep: list[str], text_col: str = "text", name: str = "score") -> DataFrame:
    """The columns of `keep` and the score of each whole text; a null or empty text has the bias alone.

    A kept column with the name of the score gives way to it.  Repeated rows and equal ids come back each by itself.
    """
    keep = [c for c in keep if c != name]
    schema = T.StructType([*(docs.schema[c] for c in keep), T.StructField(name, T.DoubleType())])

    def run(batches):
        of_bucket = {int(b): i for i, b in enumerate(machine.buckets)}
        known: dict[str, tuple[int, ...]] = {}
        for batch in batches:
            active = []
            for text in batch.column(len(keep)).to_pylist():
                found: set[int] = set()
                for term in set(TERM.findall(text.lower())):
                    hit = known.get(term)
                    if hit is None:
                        if len(known) > MAX_CACHED:
                            known.clear()
                        hit = known[term] = tuple(of_bucket[b] for b in buckets_of(term) if b in of_bucket)
                    found.update(hit)
                active.append(np.fromiter(found, np.int64, len(found)))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), pa.array(machine.scores(active))], names=[*keep, name])

    return docs.select(*keep, text_or_empty(text_col)).mapInArrow(frugal(run), schema)


def held_out(id_col: str = "doc_id", parts: int = 3):
    """Rows that no label is learnt from: crc32 of the id as text leaves 1 when divided by `parts`."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % parts == 1, F.lit(False))


THRESHOLD = 0.7


def classify(docs: DataFrame, labels: DataFrame, keep: list[str] | None = None, id_col: str = "doc_id", **options) -> DataFrame:
    """Fit on the labelled rows that are not held out, then score every row of docs; keeps the named columns.

    Null and empty texts have the bias alone, repeated rows come back each by itself, equal scores are equal, an empty
    table gives no rows.  Columns that are not kept, whatever their names, are not read.
    """
    machine = fit(docs, labels.where(~held_out(id_col)), id_col=id_col, **options)
    return score(docs, machine, keep or [id_col])
