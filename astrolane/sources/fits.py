"""FITS binary tables: headers on the driver, rows by byte ranges on the executors."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

CARD, BLOCK = 80, 2880
ROW_INDEX = "_original_row_index"
#: FITS column codes, as big-endian numpy types and Spark types.
_CODES = {"L": ("S1", T.BooleanType()), "B": ("u1", T.ShortType()), "I": (">i2", T.ShortType()), "J": (">i4", T.IntegerType()), "K": (">i8", T.LongType()), "E": (">f4", T.FloatType()), "D": (">f8", T.DoubleType())}

#: Bytes of an element of the column codes that are passed over.
_WIDTHS = {"C": 8, "M": 16, "P": 8, "Q": 16}


def _header(f) -> dict[str, str]:
    cards = {}
    while True:
        block = f.read(BLOCK)
        if len(block) < BLOCK:
            raise ValueError("a FITS header ends early")
        for i in range(0, BLOCK, CARD):
            card = block[i : i + CARD].decode("ascii", "replace")
            if card.startswith("END"):
                return cards
            if card[8:10] == "= ":
                value = card[10:].strip()
                cards[card[:8].strip()] = re.match(r"'((?:[^']|'')*)'", value)[1].rstrip() if value.startswith("'") else value.split("/")[0].strip()


def table_header(path: str, hdu: int = 1) -> dict:
    """Place and layout of a binary table: data offset, row length, n_rows, columns (name, numpy type, Spark type, width)."""
    with open(path, "rb") as f:
        for at in range(hdu + 1):
            cards = _header(f)
            start = f.tell()
            axes = [int(cards[f"NAXIS{i + 1}"]) for i in range(int(cards.get("NAXIS", 0)))]
            size = abs(int(cards.get("BITPIX", 8))) // 8 * int(np.prod(axes)) + int(cards.get("PCOUNT", 0)) if axes else 0
            if at < hdu:
                f.seek(start + -(-size // BLOCK) * BLOCK)
    if cards.get("XTENSION") != "BINTABLE":
        raise ValueError(f"{path}: extension {hdu} is not a binary table")
    columns, scales = [], {}
    for i in range(1, int(cards["TFIELDS"]) + 1):
        repeat, code = re.match(r"(\d*)([A-Z])", cards[f"TFORM{i}"]).groups()
        n, name = int(repeat) if repeat else 1, cards[f"TTYPE{i}"]
        if code == "A":
            columns.append((name, f"S{n}", T.StringType(), 1))
        elif code in _CODES:
            kind, spark_type = _CODES[code]
            scale, zero, null = float(cards.get(f"TSCAL{i}", 1)), float(cards.get(f"TZERO{i}", 0)), cards.get(f"TNULL{i}")
            if code in "BIJKED" and (scale != 1 or zero or null is not None):
                scales[name] = (scale, zero, None if null is None or code in "ED" else int(null))
                # a shift by whole numbers, as unsigned columns have it, stays whole
                spark_type = spark_type if scale == 1 and not zero else T.LongType() if scale == 1 and zero == int(zero) and code in "BIJK" else T.DoubleType()
            columns.append((name, kind, spark_type, n))
        else:  # bits, complex numbers, variable lengths: only their width is known
            columns.append((name, f"V{-(-n // 8) if code == 'X' else n * _WIDTHS[code]}", None, 1))
    return {"offset": start, "row_bytes": axes[0], "n_rows": axes[1], "columns": columns, "scales": scales}


def read_fits(spark: SparkSession, path: str, columns: list[str] | None = None, hdu: int = 1, where: dict | None = None, rows_per_task: int = 250_000) -> DataFrame:
    """A binary table as a DataFrame with the number of each row.  Vector columns are arrays, strings are trimmed.

    Scales, zeros and null values of the header are applied, logical columns are booleans.  Columns of bits, complex
    numbers or variable length cannot be read, and are left out unless they are asked for by name.

    where: equalities {column: value}; they are tested first, and only rows that pass are decoded further.  Each task
    reads one range of rows; the file must lie where executors can open it.
    """
    head = table_header(path, hdu)
    known = {c[0]: c for c in head["columns"]}
    wanted = columns or [c[0] for c in head["columns"] if c[2] is not None]
    missing = [c for c in [*wanted, *(where or {})] if c not in known]
    if missing:
        raise ValueError(f"{path} has no columns {missing}")
    odd = [c for c in [*wanted, *(where or {})] if known[c][2] is None]
    if odd:
        raise ValueError(f"{path}: columns {odd} are of kinds that are not supported")
    layout = np.dtype([(n, k, (w,)) if w > 1 else (n, k) for n, k, _, w in head["columns"]])
    if layout.itemsize != head["row_bytes"]:
        raise ValueError(f"{path}: rows are {head['row_bytes']} bytes, columns {layout.itemsize}")
    fields = [T.StructField(n, T.ArrayType(known[n][2]) if known[n][3] > 1 else known[n][2]) for n in wanted]
    schema = T.StructType([T.StructField(ROW_INDEX, T.LongType()), *fields])

    def decoded(name: str, data: np.ndarray) -> pa.Array:
        kind = known[name][2]
        if isinstance(kind, T.StringType):
            return pa.array([x.decode("ascii", "replace").strip() for x in data.tolist()], pa.string())
        null = np.zeros(data.shape, bool)
        if isinstance(kind, T.BooleanType):
            native, null = data == b"T", (data != b"T") & (data != b"F")
        else:
            native = data.astype(data.dtype.newbyteorder("=") if data.dtype.base.kind != "u" else np.int16)
            scale, zero, missing = head["scales"].get(name, (1.0, 0.0, None))
            null = native == missing if missing is not None else null
            if isinstance(kind, T.LongType):
                native = native.astype(np.int64) + np.int64(zero) if zero else native.astype(np.int64)
            elif scale != 1 or zero:
                native = native * scale + zero
        if native.ndim > 1:
            flat = pa.array(native.ravel(), mask=null.ravel())
            return pa.ListArray.from_arrays(pa.array(np.arange(len(native) + 1) * native.shape[1], pa.int32()), flat)
        return pa.array(native, mask=null)

    def run(batches):
        for batch in batches:
            for begin in batch.column(0).to_pylist():
                n = min(rows_per_task, head["n_rows"] - begin)
                with open(path, "rb") as f:
                    f.seek(head["offset"] + begin * layout.itemsize)
                    table = np.frombuffer(f.read(n * layout.itemsize), layout)
                keep = np.ones(len(table), bool)
                for name, value in (where or {}).items():
                    values = decoded(name, table[name])
                    keep &= np.array([x == value for x in values.to_pylist()], bool)
                table, out = table[keep], [pa.array(begin + np.flatnonzero(keep))]
                out += [decoded(field.name, table[field.name]) for field in fields]
                yield pa.RecordBatch.from_arrays(out, names=[f.name for f in schema.fields])

    starts = spark.range(0, max(1, head["n_rows"]), rows_per_task, numPartitions=max(1, -(-head["n_rows"] // rows_per_task)))
    return starts.mapInArrow(run, schema)


def write_fits(path: str, columns: dict[str, np.ndarray]) -> None:
    """A small binary table from arrays: numbers, rows of vectors, or strings."""
    codes = {"i2": "I", "i4": "J", "i8": "K", "f4": "E", "f8": "D", "u1": "B"}
    arrays = {n: np.asarray(a).astype("S") if np.asarray(a).dtype.kind == "U" else np.asarray(a) for n, a in columns.items()}
    kind = lambda a: f"{a.dtype.itemsize}A" if a.dtype.kind == "S" else f"{a.shape[1] if a.ndim > 1 else 1}{codes[a.dtype.str[1:]]}"
    layout = np.dtype([(n, a.dtype.newbyteorder(">"), a.shape[1:]) for n, a in arrays.items()])
    table = np.zeros(len(next(iter(arrays.values()))), layout)
    for n, a in arrays.items():
        table[n] = a

    def block(cards: list[tuple[str, object]]) -> bytes:
        value = lambda v: f"'{v}'".ljust(20) if isinstance(v, str) else ("T" if v is True else str(v)).rjust(20)
        text = "".join(f"{k:<8}= {value(v)}".ljust(CARD) for k, v in cards) + "END".ljust(CARD)
        return text.ljust(-(-len(text) // BLOCK) * BLOCK).encode()

    cards = [("XTENSION", "BINTABLE"), ("BITPIX", 8), ("NAXIS", 2), ("NAXIS1", layout.itemsize), ("NAXIS2", len(table)), ("PCOUNT", 0), ("GCOUNT", 1), ("TFIELDS", len(arrays))]
    for i, (n, a) in enumerate(arrays.items(), 1):
        cards += [(f"TTYPE{i}", n), (f"TFORM{i}", kind(a))]
    data = table.tobytes()
    with open(path, "wb") as f:
        f.write(block([("SIMPLE", True), ("BITPIX", 8), ("NAXIS", 0)]) + block(cards) + data.ljust(-(-len(data) // BLOCK) * BLOCK, b"\0"))
