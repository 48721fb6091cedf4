"""WARC archives of pages: writing, a normaliser for monolithic gzip files, and reading by a sidecar index.

The writer makes whole-file gzip streams, in which no record can be reached without inflating all before it. The
normaliser inflates such a stream once, rewrites every record as a gzip member of its own, and writes an index of offsets
beside the archive. The reader goes by the index. Files are written through Arrow's file systems, under names that no other
attempt of a task uses; only the files that a finished task reports are read.
"""

from __future__ import annotations

import contextlib
import gzip
import json
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seaweft.llm.common import bound_batches, durable, rows_of, shared_dir

#: Bytes of payload after which a new archive begins; payloads from this length on may be revisited.
ROTATE, LEAST_REVISIT = 64 << 20, 100
#: Compression of monolithic files, which don't last, and of members.
FAST, SMALL = 1, 6
CHUNK = 1 << 20
#: Tasks that delete files, at most.
DELETERS = 1000
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record(kind: str, headers: dict[str, object], block: bytes) -> bytes:
    """A WARC record; headers without a value are left out."""
    lines = ["WARC/1.1", f"WARC-Type: {kind}", *(f"{k}: {v}" for k, v in headers.items() if v is not None), f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def page_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """A response with the payload, or a revisit with the headers alone."""
    target = None if not url else "".join(c if 32 < ord(c) != 127 else f"%{ord(c):02X}" for c in url)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    headers = {
        "WARC-Record-ID": f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}')}>", "WARC-Date": DATE, "WARC-Target-URI": target,
        "WARC-Payload-Digest": f"sha256:{digest}", "Content-Type": "application/http;msgtype=response",
        "X-Page-ID": page_id, "X-Payload-Bytes": len(payload),
    }
    if refers_to is None:
        return record("response", headers, http + payload)
    return record("revisit", headers | {"WARC-Refers-To": f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{refers_to}:{digest}')}>", "WARC-Profile": PROFILE, "X-Refers-To-Page": refers_to}, http)


def read_records(stream: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes, bytes]]:
    """(headers, block, whole record) of each record in inflated bytes; holds one record at a time."""
    held, ended = bytearray(), False

    def more() -> bool:
        nonlocal ended
        part = next(stream, None)
        ended = part is None
        held.extend(part or b"")
        return not ended

    while True:
        while (end := held.find(b"\r\n\r\n")) < 0:
            if not more():
                if held.strip():
                    raise ValueError("a record is cut off")
                return
        head = bytes(held[:end]).decode()
        first, *lines = head.split("\r\n")
        if not first.startswith("WARC/"):
            raise ValueError(f"not a WARC record: {first[:40]!r}")
        headers = dict(line.split(": ", 1) for line in lines)
        length = int(headers["Content-Length"])
        while len(held) < end + 8 + length:
            if not more():
                raise ValueError("a record is cut off")
        block = bytes(held[end + 4 : end + 4 + length])
        yield headers, block, bytes(held[: end + 8 + length])
        del held[: end + 8 + length]


def inflate(file: BinaryIO) -> Iterator[bytes]:
    """Inflated parts of a gzip file of one or more members."""
    z = zlib.decompressobj(31)
    while raw := file.read(CHUNK):
        while raw:
            part = z.decompress(raw, 8 * CHUNK)
            if part:
                yield part
            if z.eof:
                raw, z = z.unused_data, zlib.decompressobj(31)
            else:
                raw = z.unconsumed_tail
    if tail := z.flush():
        yield tail


def payload_of(block: bytes) -> bytes:
    """What follows the HTTP headers."""
    return block[block.index(b"\r\n\r\n") + 4 :]


def normalise_file(system: fs.FileSystem, path: str, to: str) -> int:
    """Rewrite one archive: `to`.warc.gz with a member for each record, and `to`.idx with a JSON line for each member."""
    n = offset = 0
    with system.open_input_stream(path, compression=None) as source, system.open_output_stream(f"{to}.warc.gz", compression=None) as out, system.open_output_stream(f"{to}.idx", compression=None) as index:
        for headers, _, whole in read_records(inflate(source)):
            member = gzip.compress(whole, SMALL, mtime=0)
            out.write(member)
            index.write((json.dumps({"offset": offset, "length": len(member), "type": headers["WARC-Type"], "id": headers.get("WARC-Record-ID"), "uri": headers.get("WARC-Target-URI")}) + "\n").encode())
            offset += len(member)
            n += 1
    return n


def indexed(system: fs.FileSystem, stem: str) -> Iterator[dict]:
    with system.open_input_stream(f"{stem}.idx", compression=None) as f:
        held = b""
        while part := f.read(CHUNK):
            *lines, held = (held + part).split(b"\n")
            yield from map(json.loads, lines)


def revisits(pages: DataFrame, *, least: int = LEAST_REVISIT) -> DataFrame:
    """`pages` (page_id, url, payload, payload_digest) with refers_to, the smallest page_id of equal payloads.

    Only payloads of at least `least` bytes are revisited. Equal digests are counted before they are shuffled, and the
    table of digests that occur twice is written, so that it is broadcast only if its files are under Spark's limit; a
    digest that many rows share is then joined by a sort-merge join, whose large partitions Spark splits.
    """
    spark = pages.sparkSession
    long = pages.where(F.octet_length("payload") >= least)
    path = f"{shared_dir(spark).rstrip('/')}/warc-digests-{uuid.uuid4().hex}"
    long.groupBy("payload_digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("payload_digest", "first").write.parquet(path)
    first = spark.read.parquet(path).select(F.col("payload_digest").alias("__digest"), "first")
    joined = pages.join(first, (F.col("payload_digest") == F.col("__digest")) & (F.octet_length("payload") >= least), "left")
    return joined.select(*pages.columns, F.when(F.col("first") != F.col("page_id"), F.col("first")).alias("refers_to"))


def write_archives(pages: DataFrame, folder: str, *, rotate: int = ROTATE) -> DataFrame:
    """Write monolithic archives of (page_id, url, payload, payload_digest, refers_to): (path, records) of each, durable."""
    source = pages.select("page_id", "url", "payload", "payload_digest", "refers_to")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = fs.FileSystem.from_uri(folder)
        system.create_dir(base, recursive=True)
        out = sink = None
        done: list[tuple[str, int]] = []
        name, n, size = "", 0, 0

        def close() -> None:
            nonlocal out
            out.close()
            sink.close()
            done.append((name, n))
            out = None

        for b in rows_of(batches):
            for row in zip(*(c.to_pylist() for c in b.columns)):
                if out is None:
                    name, n, size = f"{base}/whole-{uuid.uuid4().hex}.warc.gz", 0, 0
                    sink = system.open_output_stream(name, compression=None)
                    out = gzip.GzipFile(fileobj=sink, mode="wb", compresslevel=FAST, mtime=0)
                    out.write(record("warcinfo", {"WARC-Record-ID": f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>", "WARC-Date": DATE, "Content-Type": "application/warc-fields"}, b"format: WARC File Format 1.1\r\n"))
                out.write(page_record(*row))
                n, size = n + 1, size + len(row[2])
                if size >= rotate:
                    close()
        if out is not None:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in done], pa.string()), pa.array([x[1] for x in done], pa.int64())], ["path", "records"])

    return durable(source.mapInArrow(run, "path string, records bigint"))


def normalise(archives: DataFrame, folder: str) -> DataFrame:
    """Normalise the archives in column `path`: (stem, records) of each, durable. The monolithic files stay."""
    files = max(1, archives.count())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = fs.FileSystem.from_uri(folder)
        for b in rows_of(batches):
            stems = [f"{base}/members-{uuid.uuid4().hex}" for _ in range(b.num_rows)]
            counts = [normalise_file(system, path, stem) for path, stem in zip(b.column(0).to_pylist(), stems)]
            yield pa.RecordBatch.from_arrays([pa.array(stems), pa.array(counts, pa.int64())], ["stem", "records"])

    return durable(archives.select("path").repartition(files).mapInArrow(run, "stem string, records bigint"))


RECORDS = "page_id bigint, url string, record_type string, payload binary, payload_bytes bigint, payload_digest string, refers_to bigint"


def read_archives(normalised: DataFrame, folder: str) -> DataFrame:
    """Every response and revisit of normalised archives, each read at its offset. A revisit has no payload of its own."""
    files = max(1, normalised.count())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, _ = fs.FileSystem.from_uri(folder)
        names = [x.split()[0] for x in RECORDS.split(", ")]
        kinds = [pa.int64(), pa.string(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.int64()]
        for b in rows_of(batches):
            for stem in b.column(0).to_pylist():
                rows, size = [], 0
                with system.open_input_file(f"{stem}.warc.gz") as f:
                    for at in indexed(system, stem):
                        if at["type"] not in ("response", "revisit"):
                            continue
                        f.seek(at["offset"])
                        ((h, block, _),) = read_records(iter([gzip.decompress(f.read(at["length"]))]))
                        number = lambda k: int(h[k]) if k in h else None  # noqa: B023, E731
                        rows.append((number("X-Page-ID"), h.get("WARC-Target-URI"), at["type"], payload_of(block) if at["type"] == "response" else None, number("X-Payload-Bytes"), h["WARC-Payload-Digest"].removeprefix("sha256:"), number("X-Refers-To-Page")))
                        size += len(block)
                        if len(rows) >= 512 or size >= 4 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
                            rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    return normalised.select("stem").repartition(files).mapInArrow(run, RECORDS)


def archive(pages: DataFrame, folder: str | None = None, *, least: int = LEAST_REVISIT, rotate: int = ROTATE, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Write a record for each page, normalise the archives, and read all records back (columns as in RECORDS).

    A null payload is the empty payload; a null id or URL is left out of the record and null again when read; rows that
    repeat the smallest id of equal payloads are all responses. The folder must be one that all executors share; the
    default is a new one in the shared folder. The monolithic files are deleted, by tasks, once all normalised ones are there. Files that
    failed attempts of a task left are never read; they stay until the folder is emptied, as does the folder.
    """
    spark = pages.sparkSession
    bound_batches(spark)
    folder = folder or f"{shared_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    named = pages.select(F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"), F.sha2(payload, 256).alias("payload_digest"))
    whole = write_archives(revisits(named, least=least), folder, rotate=rotate)
    members = normalise(whole, folder)

    def delete(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, _ = fs.FileSystem.from_uri(folder)
        for b in rows_of(batches):
            for path in b.column(0).to_pylist():
                with contextlib.suppress(FileNotFoundError):  # an attempt before this one may have got as far
                    system.delete_file(path)
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], ["n"])

    whole.select("path").repartition(max(1, min(whole.count(), DELETERS))).mapInArrow(delete, "n bigint").agg(F.sum("n")).collect()
    return read_archives(members, folder)
