"""Shared plumbing: input tables, the cluster's shared folder, lineage cuts."""

from __future__ import annotations

import ctypes
import gc
import os
import time
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.staging import discard, remove_path, scratch_path, shared_dir, staged


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished steps, which it does once their plans are garbage.

    Two passes: the first frees the plans, the second what only they had referred to.
    """
    for _ in range(2):
        gc.collect()
        spark._jvm.System.gc()
        time.sleep(0.4)


def give_back() -> None:
    """Return what the allocators of this process hold but do not use to the system (malloc: where it can)."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def frugal(run):
    """run, a function of Arrow batches, whose worker gives its free memory back when a task ends.

    Spark keeps workers for later tasks, and each would keep the most that any task took beside those at work.
    """

    def task(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return task


__all__ = ["bitmap_size", "bits_set", "discard", "frugal", "give_back", "local_path", "open_file", "partitions", "release", "remove_path", "scratch_path", "shared_dir", "staged", "table", "text_or_empty", "write_file"]


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def bitmap_size(n: int, most_bits: int = 1 << 27) -> int:
    """Bits for n hashed values: a power of two, some 32 a value, at most 16 MB."""
    return min(most_bits, max(1 << 13, 1 << (32 * n).bit_length()))


def bits_set(bits: DataFrame, size: int) -> np.ndarray:
    """A bitmap (64-bit words) of the places in column bit."""
    words = bits.selectExpr("bit DIV 64 AS word", "shiftleft(1L, CAST(bit % 64 AS INT)) AS one").groupBy("word").agg(F.bit_or("one").alias("bits"))
    table = words.toPandas()
    out = np.zeros(size // 64, np.int64)
    out[table["word"].to_numpy(np.int64)] = table["bits"].to_numpy(np.int64)
    return out


def text_or_empty(column: str):
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def local_path(uri: str) -> str | None:
    """A path that plain file calls can open, or None if the URI needs a file-system client."""
    if uri.startswith("file:"):
        return "/" + uri[5:].lstrip("/")
    return uri if uri.startswith("/") else None


def write_file(uri: str, chunks) -> int:
    """Publish chunks of bytes as one file: a temporary name first, then a rename.

    A retried or speculative attempt writes another temporary file, so readers never see half a file.
    """
    path = local_path(uri)
    token = uuid.uuid4().hex
    size = 0
    if path is not None:
        os.makedirs(os.path.dirname(path), exist_ok=True)
        part = f"{path}.{token}.tmp"
        with open(part, "wb") as out:
            for chunk in chunks:
                out.write(chunk)
                size += len(chunk)
        os.replace(part, path)
        return size
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(uri)
    system.create_dir(os.path.dirname(inner), recursive=True)
    part = f"{inner}.{token}.tmp"
    with system.open_output_stream(part) as out:
        for chunk in chunks:
            out.write(chunk)
            size += len(chunk)
    system.move(part, inner)
    return size


def open_file(uri: str):
    path = local_path(uri)
    if path is not None:
        return open(path, "rb")
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(uri)
    return system.open_input_file(inner)
