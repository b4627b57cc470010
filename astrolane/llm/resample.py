"""Quality selection by importance resampling.

Two generative models over hashed n-grams are counted: one over texts labelled good (the target), one over all
texts (raw).  A text's importance weight is the ratio of its probabilities under the two; adding Gumbel noise
to the log weight and taking the k largest draws k texts without replacement in proportion to the weights.
N-grams are words and word pairs, and pairs of word shapes with a mark for a repeated word, so that capitals,
symbols and repetition weigh even where every word is new.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, frugal, staged, text_or_empty
from .toxicity import labelled_sample

TOKEN = re.compile(r"\w+|[^\w\s]+")
BUCKETS = 1 << 14
SHAPES = 1 << 12
MAX_LABELLED = 20_000
MAX_CACHED = 300_000


def shape_of(token: str) -> int:
    if token[0].isalnum() or token[0] == "_":
        if token.isdigit():
            return 1
        if token.islower():
            return 2
        if token.isupper():
            return 3 if len(token) > 1 else 4
        return 5 if token.istitle() else 6
    return 7 + zlib.crc32(token.encode()) % 1009


class Hasher:
    """Counts of hashed n-grams of one text at a time; remembers the hashes of words."""

    def __init__(self):
        self.known: dict[str, tuple[int, int]] = {}

    def grams(self, text: str) -> np.ndarray:
        known, pairs = self.known, []
        for token in TOKEN.findall(text):
            pair = known.get(token)
            if pair is None:
                if len(known) > MAX_CACHED:
                    known.clear()
                pair = known[token] = (zlib.crc32(token.lower().encode()), shape_of(token))
            pairs.append(pair)
        if not pairs:
            return np.zeros(0, np.int64)
        both = np.array(pairs, np.uint64)
        words, shapes = both[:, 0], both[:, 1]
        mixed = (words[:-1] * np.uint64(0x9E3779B97F4A7C15) + words[1:] * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(40)
        same = (words[:-1] == words[1:]).astype(np.uint64)
        shaped = (shapes[:-1] * np.uint64(2654435761) + shapes[1:] * np.uint64(2 * 40503) + same * np.uint64(97)) % np.uint64(SHAPES)
        return np.concatenate([words % np.uint64(BUCKETS), mixed % np.uint64(BUCKETS), shaped + np.uint64(BUCKETS)]).astype(np.int64)


def count_grams(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Counts of all hashed n-grams of docs.  Tasks add up their own rows first; the result has a fixed length."""

    def run(batches):
        hasher, total = Hasher(), np.zeros(BUCKETS + SHAPES, np.int64)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                total += np.bincount(hasher.grams(text), minlength=len(total))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["bucket", "n"])

    rows = docs.select(text_or_empty(text_col).alias("text")).mapInArrow(frugal(run), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(BUCKETS + SHAPES, np.int64)
    for r in rows:
        out[r["bucket"]] = r["n"]
    return out


def log_ratios(target: np.ndarray, raw: np.ndarray, smoothing: float = 1.0) -> np.ndarray:
    """log(target / raw) per bucket; words and shapes are separate distributions, both smoothed alike."""
    out = np.zeros(len(raw))
    for part in (slice(0, BUCKETS), slice(BUCKETS, None)):
        t, r = target[part] + smoothing, raw[part] + smoothing
        out[part] = np.log(t / t.sum()) - np.log(r / r.sum())
    return out


def weigh(docs: DataFrame, ratios: np.ndarray, keep: list[str], seed: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The columns of `keep`, log_weight of the whole text, and gumbel_key = log_weight + noise hashed from the id."""
    schema = T.StructType([*(docs.schema[c] for c in keep), T.StructField("log_weight", T.DoubleType())])

    def run(batches):
        hasher = Hasher()
        for batch in batches:
            weights = [float(ratios[hasher.grams(t)].sum()) for t in batch.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), pa.array(weights, pa.float64())], names=[*keep, "log_weight"])

    uniform = (F.pmod(F.xxhash64(F.lit(seed), F.col(id_col)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    weighed = docs.select(*keep, text_or_empty(text_col)).mapInArrow(frugal(run), schema)
    return weighed.withColumn("gumbel_key", F.col("log_weight") - F.log(-F.log(uniform)))


def kth_largest(frame: DataFrame, column: str, k: int, gather: int = 10_000) -> float | None:
    """The exact k-th largest value, by narrowing a histogram; the driver sees at most 4096 counts or `gather` values."""
    ends = frame.agg(F.min(column).alias("lo"), F.max(column).alias("hi"), F.count(column).alias("n")).first()
    if not ends["n"] or k < 1:
        return None
    lo, hi, n, skip = ends["lo"], ends["hi"], ends["n"], 0  # skip: values above hi
    k = min(k, n)
    while n > gather and lo < hi:
        width = (hi - lo) / 4096
        part = F.least(F.floor((F.col(column) - lo) / width), F.lit(4095))
        inside = frame.where(F.col(column).between(lo, hi))
        counts = sorted(((r["part"], r["n"], r["lo"], r["hi"]) for r in inside.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"), F.min(column).alias("lo"), F.max(column).alias("hi")).collect()), reverse=True)
        for _, count, low, high in counts:
            if skip + count >= k:
                lo, hi, n = low, high, count
                break
            skip += count
    if lo == hi:
        return lo
    values = sorted((r[0] for r in frame.where(F.col(column).between(lo, hi)).select(column).collect()), reverse=True)
    return values[k - skip - 1]


def parting(weights: np.ndarray, label: np.ndarray, cost: float = 5.0) -> float:
    """The weight from which on labelled rows count as good: bad rows kept plus cost times good rows lost is least.

    In the middle of a gap between labelled weights; minus infinity unless rows of both labels are there.
    """
    if not len(weights) or label.all() or not label.any():
        return float("-inf")
    order = np.argsort(weights, kind="stable")
    w, good = weights[order], label[order] == 1
    loss = np.concatenate([[0.0], np.cumsum(np.where(good, cost, -1.0))])
    edges = np.concatenate([[-np.inf], (w[:-1] + w[1:]) / 2, [np.inf]])
    return float(edges[int(np.argmin(loss))])


def resample(docs: DataFrame, labels: DataFrame, keep: list[str] | None = None, share: float | None = None, seed: int = 11, label_col: str = "quality", max_rows: int = MAX_LABELLED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The k rows of docs drawn by importance: the columns of `keep`, log_weight and gumbel_key.

    The target model is counted over at most max_rows labelled good texts; the raw model over all texts.
    k is `share` of the rows; by default as many rows as weigh at least what parts good from bad among those
    labelled, where losing a good row counts as five bad ones kept.  Rows whose key ties with the k-th stay with it (repeated rows live or go together).
    Null or empty texts have weight 0.  Without labelled rows of both kinds every row is kept.  An empty table gives no
    rows.  Kept columns named log_weight or gumbel_key give way to those; other columns are not read.
    """
    asked = keep or [id_col]
    keep = [id_col, *(c for c in asked if c not in (id_col, "log_weight", "gumbel_key"))]
    sample = staged(labelled_sample(labels, label_col, id_col, max_rows), "quality-sample").toDF("__id", "__label")
    # Broadcast: at most max_rows pairs of numbers.
    good = docs.select(id_col, text_col).join(F.broadcast(sample.where("__label = 1")), F.col(id_col) == F.col("__id"))
    target = count_grams(good, text_col)
    ratios = log_ratios(target, count_grams(docs, text_col)) if target.any() else np.zeros(BUCKETS + SHAPES)
    weighed = staged(weigh(docs, ratios, keep, seed, id_col, text_col), "weighed")
    if share is None:
        known = weighed.join(F.broadcast(sample), F.col(id_col) == F.col("__id")).groupBy("__id", "__label").agg(F.min("log_weight").alias("w")).select("__label", "w").collect()
        k = weighed.where(F.col("log_weight") >= parting(np.array([r["w"] for r in known]), np.array([r["__label"] for r in known]))).count()
    else:
        k = int(np.ceil(share * weighed.count()))
    least = kth_largest(weighed, "gumbel_key", k)
    drawn = weighed.where(F.col("gumbel_key") >= F.lit(least)) if least is not None else weighed.limit(0)
    return drawn.select(*(c for c in asked if c in keep), "log_weight", "gumbel_key")
