"""WARC archives: write, normalise a monolithic gzip file to one member per record with a sidecar index, read back.

Each task writes its rows as one gzip stream per file, the form that plain compression of an archive gives and that
cannot be entered in the middle.  The normaliser inflates such a file once from beginning to end, whatever its
members, compresses every record as a member of its own, and writes an index of offsets beside it, so that any
record can be read by one seek.  Only one record is held at a time.  Files go to the cluster's shared folder under
fresh names, published by a rename; the rows that name them come from committed tasks only.
"""

from __future__ import annotations

import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, open_file, partitions, remove_path, scratch_path, staged, write_file

MIN_REVISIT = 100
FILE_BYTES = 32 << 20
CHUNK = 1 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"


def record_types(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """id, url, payload, digest, refers_to: of equal payloads of at least MIN_REVISIT bytes the smallest id is stored,
    the others revisit it.  Rows without an id, and rows that share the smallest one, are stored."""
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(payload_col).cast("string"), F.lit("")).alias("payload")).withColumn("digest", F.sha2(F.col("payload").cast("binary"), 256))
    large = rows.where((F.octet_length("payload") >= MIN_REVISIT) & F.col("id").isNotNull()).select("id", "digest")
    first = staged(large.groupBy("digest").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first <> last").select("digest", "first"), "first-pages")
    revisits = staged(large.join(first, "digest").where("id <> first").distinct(), "revisits")
    return rows.join(revisits, ["id", "digest"], "left").select("id", "url", "payload", "digest", F.col("first").alias("refers_to"))


def record_urn(row_id: int | None, digest: str) -> str:
    return f"<urn:row:{'' if row_id is None else row_id}:{digest}>"


def row_of_urn(urn: str) -> int | None:
    row_id = urn.strip("<>").split(":")[2]
    return int(row_id) if row_id else None


def warc_record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in headers), f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def page_record(row_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    target = "".join(c for c in url or "urn:none" if c.isprintable()).strip() or "urn:none"
    headers = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", record_urn(row_id, digest)), ("WARC-Date", DATE), ("WARC-Target-URI", target), ("WARC-Payload-Digest", f"sha256:{digest}")]
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    if refers_to is not None:
        headers += [("WARC-Refers-To", record_urn(refers_to, digest)), ("WARC-Profile", PROFILE)]
        payload = b""
    return warc_record([*headers, ("Content-Type", "application/http;msgtype=response")], http + payload)


def write_monolithic(rows: DataFrame, folder: str, file_bytes: int = FILE_BYTES) -> DataFrame:
    """record_types' rows as archives, each a single gzip stream: path, n_records."""

    def run(batches):
        chunks, n, size, press = [], 0, 0, None

        def publish():
            path = f"{folder}/raw-{uuid.uuid4().hex}.warc.gz"
            write_file(path, [*chunks, press.flush()])
            return pa.RecordBatch.from_pydict({"path": [path], "n_records": pa.array([n], pa.int64())})

        for batch in batches:
            for row_id, url, payload, digest, refers_to in zip(*(batch.column(i) for i in range(5)), strict=True):
                if press is None:
                    press = zlib.compressobj(1, zlib.DEFLATED, 31)
                    chunks.append(press.compress(warc_record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", DATE), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n")))
                record = page_record(row_id.as_py(), url.as_py(), payload.as_buffer().to_pybytes(), digest.as_py(), refers_to.as_py())
                chunks.append(press.compress(record))
                n, size = n + 1, size + len(record)
                if size >= file_bytes:
                    yield publish()
                    chunks, n, size, press = [], 0, 0, None
        if n:
            yield publish()

    return rows.mapInArrow(run, "path string, n_records long")


def inflated(uri: str) -> Iterator[bytes]:
    """The bytes of a gzip file, across all of its members, at most CHUNK at once; a file that is not compressed comes as it is.

    ValueError for a member whose end, and with it checksum and length, is missing.  Zeros behind a member are passed over.
    """
    with open_file(uri) as source:
        data = source.read(CHUNK)
        if data[:2] != b"\x1f\x8b":
            while data:
                yield data
                data = source.read(CHUNK)
            return
        press = None
        while data:
            if press is None:
                data = data.lstrip(b"\0")
                if data:
                    press = zlib.decompressobj(31)
            while data and press is not None:
                yield press.decompress(data, CHUNK)
                data = press.unconsumed_tail
                if press.eof:
                    data, press = press.unused_data, None
                    break
            data = data or source.read(CHUNK)
        while press is not None and not press.eof:  # what the last bytes still hold
            more = press.decompress(b"", CHUNK)
            if not more and not press.eof:
                raise ValueError(f"{uri} ends inside a gzip member")
            yield more


def records(stream: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes, bytes]]:
    """(headers with lower-case names, block, whole record) in turn."""
    held = bytearray()

    def fill(n: int) -> bool:
        while len(held) < n:
            more = next(stream, None)
            if more is None:
                return False
            held.extend(more)
        return True

    while True:
        while held[:2] == b"\r\n":
            del held[:2]
        at = held.find(b"\r\n\r\n")
        while at < 0:
            if not fill(len(held) + 1):
                if held.strip():
                    raise ValueError("an archive ends inside a record's headers")
                return
            at = held.find(b"\r\n\r\n")
        if at == 0:
            del held[:4]
            continue
        lines = held[:at].decode("utf-8", "replace").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
        headers = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
        end = at + 4 + int(headers["content-length"])
        if not fill(end):
            raise ValueError("an archive ends inside a record")
        yield headers, bytes(held[at + 4 : end]), bytes(held[:end]) + b"\r\n\r\n"
        del held[:end]


def normalise_file(source: str, target: str, level: int = 6) -> int:
    """Rewrite one archive with a gzip member per record, and target + '.idx': a JSON line for each record."""
    index: list[bytes] = []

    def members():
        at = 0
        for headers, _, whole in records(inflated(source)):
            press = zlib.compressobj(level, zlib.DEFLATED, 31)
            member = press.compress(whole) + press.flush()
            entry = {"offset": at, "length": len(member), "type": headers.get("warc-type"), "id": headers.get("warc-record-id"), "uri": headers.get("warc-target-uri"), "digest": headers.get("warc-payload-digest")}
            index.append(json.dumps(entry).encode() + b"\n")
            at += len(member)
            yield member

    write_file(target, members())
    write_file(f"{target}.idx", index)
    return len(index)


def normalise(files: DataFrame, folder: str) -> DataFrame:
    """(path, ...) of archives in any gzip form -> (path, n_records) of their normalised copies in `folder`."""

    def run(batches):
        for batch in batches:
            for source in batch.column(0).to_pylist():
                target = f"{folder}/{uuid.uuid4().hex}.warc.gz"
                n = normalise_file(source, target)
                yield pa.RecordBatch.from_pydict({"path": [target], "n_records": pa.array([n], pa.int64())})

    return files.select("path").repartition(partitions(files.sparkSession), "path").mapInArrow(run, "path string, n_records long")


def read_record(uri_or_file, offset: int, length: int) -> tuple[dict[str, str], bytes]:
    """One record by its place in the index."""
    source = open_file(uri_or_file) if isinstance(uri_or_file, str) else uri_or_file
    source.seek(offset)
    headers, block, _ = next(records(iter([zlib.decompress(source.read(length), 31)])))
    return headers, block


def read_archives(files: DataFrame, with_payload: bool = False) -> DataFrame:
    """Read normalised archives through their indexes: id, uri, record_type, payload_bytes, payload_digest, refers_to.

    A stored payload is hashed again and must have the digest of its headers.
    """

    def run(batches):
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows = []
                with open_file(f"{path}.idx") as f:
                    entries = [json.loads(line) for line in f.read().splitlines()]
                with open_file(path) as source:
                    for entry in entries:
                        if entry["type"] not in ("response", "revisit"):
                            continue
                        headers, block = read_record(source, entry["offset"], entry["length"])
                        http, _, payload = block.partition(b"\r\n\r\n")
                        size = int(http.lower().split(b"content-length:")[1].split(b"\r\n")[0])
                        digest = headers["warc-payload-digest"].removeprefix("sha256:")
                        if entry["type"] == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
                            raise ValueError(f"record {entry['id']} in {path} does not have its digest")
                        refers = headers.get("warc-refers-to")
                        rows.append({"id": row_of_urn(headers["warc-record-id"]), "uri": headers["warc-target-uri"], "record_type": entry["type"], "payload_bytes": size, "payload_digest": digest, "refers_to": row_of_urn(refers) if refers else None} | ({"payload": payload if entry["type"] == "response" else None} if with_payload else {}))
                        if len(rows) == 2000:
                            yield pa.RecordBatch.from_pylist(rows, schema=schema)
                            rows = []
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    schema = pa.schema([("id", pa.int64()), ("uri", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64())] + ([("payload", pa.binary())] if with_payload else []))
    ddl = "id long, uri string, record_type string, payload_bytes long, payload_digest string, refers_to long" + (", payload binary" if with_payload else "")
    return files.select("path").repartition(partitions(files.sparkSession), "path").mapInArrow(run, ddl)


def archive(pages: DataFrame, folder: str | None = None, **columns) -> DataFrame:
    """Write pages as archives, normalise them, and name the results: path, n_records.

    Null payloads count as empty.  An empty table gives no files.  The single-stream archives are deleted once their
    normalised copies are written.
    """
    folder = folder or scratch_path(pages.sparkSession, "warc")
    raw = staged(write_monolithic(record_types(pages, **columns), f"{folder}/raw"), "raw-archives")
    out = staged(normalise(raw, f"{folder}/records"), "archives")
    remove_path(pages.sparkSession, f"{folder}/raw")
    discard(raw)
    return out
