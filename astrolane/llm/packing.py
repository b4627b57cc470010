"""Best-fit packing planned over a length histogram.

The driver sees only how many pieces have each length: at most `capacity` numbers, whatever the corpus holds.
Best-fit decreasing runs over those counts, moving whole runs of equal bins at a time, and yields a plan of slots:
"pieces of this length with ranks a..b go to sequences s, s+1, ... at this offset".  Documents then take their slots
by their rank within their length.  Ranks come from two levels (a bucket's base and a rank inside the bucket), so a
length that a third of all pieces share is ranked by many tasks.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import byte_bpe
from .chunks import checksums, ended, spans
from .common import frugal, partitions, staged, text_or_empty

CAPACITY = 2048
ROWS_AT_ONCE = 2048
RANKS = 1 << 40  # more pieces of one length than any corpus has


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32 (and ids).

    A document is its ids plus end_id (a null or empty text: end_id alone).  Documents of at most `capacity` ids
    are one piece; longer ones are cut so that every piece but the first has exactly `capacity` ids.
    """
    if capacity < 1:
        raise ValueError("capacity must be positive")
    names = [id_col, "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])]
    id_type = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField(id_col, id_type), T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType())] + ([T.StructField("ids", T.ArrayType(T.IntegerType()))] if with_ids else []))

    def cut(batches):
        bpe = byte_bpe(tokenizer_path)
        for batch in batches:
            for at in range(0, len(batch), ROWS_AT_ONCE):
                part = batch.slice(at, ROWS_AT_ONCE)
                ids, n = ended(*bpe.encode(part.column(1)), end_id)
                first = (n - 1) % capacity + 1
                pieces = (n - first) // capacity + 1
                owner, piece = np.repeat(np.arange(len(n)), pieces), spans(np.zeros(len(n), np.int64), pieces)
                start = np.where(piece > 0, first[owner] + (piece - 1) * capacity, 0)
                length = np.where(piece > 0, capacity, first[owner])
                stops = np.cumsum(length)
                columns = [pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(checksums(ids, stops, length), pa.int64())]
                columns += [pa.ListArray.from_arrays(pa.array(np.append(0, stops).astype(np.int32)), pa.array(ids.astype(np.int32)))] if with_ids else []
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(owner)), *columns], names=names)

    return docs.select(id_col, text_or_empty(text_col).alias("text")).mapInArrow(frugal(cut), schema)


def plan_slots(histogram: dict[int, int], capacity: int = CAPACITY) -> pd.DataFrame:
    """Best-fit decreasing over counts: rows (length, rank, n, sequence, offset).

    Bins with equal free space are kept as runs of consecutive sequence numbers.  Each step moves one run, or
    splits it once a length is used up, so the plan's size depends on the capacity, not on the number of pieces.
    """
    free: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]
    some = np.zeros(capacity + 1, bool)
    opened, rows = 0, []
    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        if not 1 <= length <= capacity:
            raise ValueError(f"a piece of {length} ids cannot be packed")
        while left:
            found = np.flatnonzero(some[length:])
            if len(found):
                space = length + int(found[0])
                first, count = free[space].pop()
            else:  # as many new bins as this length alone needs
                space, first, count = capacity, opened, -(-left // (capacity // length))
                opened += count
            n = min(left, count)
            rows.append((length, rank, n, first, capacity - space))
            if n < count:
                free[space].append((first + n, count - n))
            free[space - length].append((first, n))
            some[space], some[space - length] = bool(free[space]), True
            some[0] = False
            left, rank = left - n, rank + n
    return pd.DataFrame(rows, columns=["length", "rank", "n", "sequence", "offset"]).sort_values(["length", "rank"], ignore_index=True)


def ranked(pieces: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """pieces with rank: 0, 1, ... within each length, in an order that depends on the data alone."""
    buckets = max(32, partitions(pieces.sparkSession))
    spread = pieces.withColumn("bucket", F.pmod(F.xxhash64(id_col, "piece"), F.lit(buckets)).cast("int"))
    inside = Window.partitionBy("length", "bucket").orderBy(id_col, "piece", "start", "ids_crc32")
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = spread.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n")).select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return spread.withColumn("inside", F.row_number().over(inside) - 1).join(bases, ["length", "bucket"]).withColumn("rank", F.col("base") + F.col("inside")).drop("bucket", "base", "inside")


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Every piece of every document with its sequence_id and offset; sequences are gapless from offset 0.

    Null texts count as empty.  Repeated rows are documents of their own.  An empty table packs into no rows.
    Other columns of docs, whatever their names, are not read.
    """
    pieces = staged(token_pieces(docs, tokenizer_path, capacity, end_id, id_col, text_col, with_ids), "pieces")
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    plan = plan_slots(histogram, capacity)
    code = plan["length"].to_numpy(np.int64) * RANKS + plan["rank"].to_numpy(np.int64)
    first_rank, first_seq, offsets = (plan[c].to_numpy(np.int64) for c in ("rank", "sequence", "offset"))
    names = [f.name for f in pieces.schema.fields]
    schema = T.StructType([*pieces.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def place(batches):
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "rank"))
            slot = np.searchsorted(code, length * RANKS + rank, "right") - 1
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(first_seq[slot] + rank - first_rank[slot]), pa.array(offsets[slot])], names=[*names, "sequence_id", "offset"])

    return ranked(pieces, id_col).select(*names, "rank").mapInArrow(frugal(place), schema)


def sequences(packed: DataFrame) -> DataFrame:
    """The packed sequences themselves, from pack(..., with_ids=True): sequence_id, n_tokens, ids.

    A group is one sequence, at most `capacity` ids.
    """
    grouped = packed.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    return grouped.select("sequence_id", "n_tokens", F.flatten(F.col("parts.ids")).alias("ids"))


