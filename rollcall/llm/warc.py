"""WARC archives: a deterministic sharded writer, and a reader.

Writing: records are sorted by range of their id, each range is written by one task into files that are rolled when their
compressed size passes a limit, and every header, length and digest is made anew. Files are written under temporary
names and renamed when complete; each task then gives a manifest row for each file, and the manifest is the commit: a
reader takes only files that it names. A task that runs twice writes the same bytes under the same names, as names follow
from the range and contents hold no clock time.

Payloads that occur more than once, of at least `least` bytes, are stored once: the record with the smallest id is
a response, the others are revisits that name it. Several rows may share that smallest id; then all of them are responses.

Null payloads count as empty, null ids sort first and never give their name to a group; a group whose ids are all null is
responses. Repeated rows are records of their own, and an empty table gives an empty archive. Only id, address and payload are read, so
other columns and their names don't matter.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rollcall.sources.lineage import cut_lineage

#: A file is closed when it has so many bytes.
ROLL = 32 << 20
#: Part of every record; a fixed date keeps archives reproducible.
DATE = "2024-01-01T00:00:00Z"
MANIFEST = "file string, bytes long, records long, first_id long, last_id long"
RECORD = (
    "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, "
    "stored_digest string, payload binary"
)
_NAMES = [x.split()[0] for x in RECORD.split(", ")]
_KINDS = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary()]
_END = b"\r\n\r\n"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}/{digest}')}>"


def header_value(text: str) -> str:
    """One line: control characters, which could end the header, are percent-encoded."""
    return re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m.group()):02X}", text)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One record as a gzip member of its own."""
    revisit = refers_to is not None
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d" % len(payload) + _END
    block = http if revisit else http + payload
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", record_id(page_id, digest)),
        ("WARC-Date", DATE),
    ]
    if url is not None:
        fields.append(("WARC-Target-URI", header_value(url)))
    if page_id is not None:
        fields.append(("X-Page-ID", str(page_id)))
    if revisit:
        fields += [
            ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
            ("WARC-Refers-To", record_id(refers_to, digest)),
            ("X-Refers-To-Page-ID", str(refers_to)),
        ]
    fields += [
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("X-Payload-Length", str(len(payload))),
        ("WARC-Block-Digest", f"sha1:{base32_sha1(block)}"),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    return gzip.compress(head.encode() + block + _END, 6, mtime=0)


def records(stream: BinaryIO) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of an archive of gzip members, read as a stream."""
    data = gzip.GzipFile(fileobj=stream)
    while line := data.readline():
        if line.rstrip() != b"WARC/1.1":
            raise ValueError(f"no record begins with {line[:40]!r}")
        head = {}
        while line := data.readline().rstrip(b"\r\n"):
            key, _, value = line.decode().partition(": ")
            head[key] = value
        block = data.read(int(head["Content-Length"]))
        if data.read(4) != _END or f"sha1:{base32_sha1(block)}" != head["WARC-Block-Digest"]:
            raise ValueError(f"damaged record {head['WARC-Record-ID']}")
        yield head, block


def copies(pages: DataFrame, least: int) -> DataFrame:
    """`sha, first` of the payloads that occur more than once. Counted in the tasks first, so a payload that a third of all
    pages have is a row for each task."""
    held = pages.where(F.col("size") >= least).groupBy("sha").agg(
        F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")
    )
    return held.where("n > 1 and first is not null").select("sha", "first")


def rows_of(batches: Iterator[pa.RecordBatch], most: int = 200) -> Iterator[tuple]:
    for batch in batches:
        for at in range(0, batch.num_rows, most):
            yield from zip(*(c.to_pylist() for c in batch.slice(at, most).columns), strict=True)


def commit(store, out, temp: str, name: str) -> None:
    """Close a file and give it its name; an earlier run of the same task may have left the same file."""
    out.close()
    try:
        store.move(temp, name)
    except OSError:
        store.delete_file(name)
        store.move(temp, name)


def write(pages: DataFrame, folder: str, roll: int = ROLL, least: int = 0) -> DataFrame:
    """Write `pages` (page_id, url, html) as archives into `folder`, which all executors reach, and return the manifest,
    which is also stored there."""

    def archived(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        part, done, out = TaskContext.get().partitionId(), [], None
        for page_id, url, html, sha, first in rows_of(batches):
            digest = base64.b32encode(bytes.fromhex(sha)).decode()
            refers_to = first if first is not None and first != page_id else None
            data = record(page_id, url, html.encode("utf-8", "surrogatepass"), digest, refers_to)
            if out is None:
                temp = f"{root}/_temporary-{uuid.uuid4().hex}"
                out = store.open_output_stream(temp)
                done.append({"file": f"pages-{part:06d}-{len(done):06d}.warc.gz", "bytes": 0, "records": 0, "first_id": page_id})
            out.write(data)
            now = done[-1]
            now |= {"bytes": now["bytes"] + len(data), "records": now["records"] + 1, "last_id": page_id}
            if now["bytes"] >= roll:
                out = commit(store, out, temp, f"{root}/{now['file']}")
        if out is not None:
            commit(store, out, temp, f"{root}/{done[-1]['file']}")
        kinds = {"file": pa.string(), "bytes": pa.int64(), "records": pa.int64(), "first_id": pa.int64(), "last_id": pa.int64()}
        yield pa.RecordBatch.from_arrays([pa.array([x[n] for x in done], k) for n, k in kinds.items()], list(kinds))

    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"),
        F.sha1(F.encode(html, "utf-8")).alias("sha"),
    )
    size = F.octet_length("html").alias("size")
    known = cut_lineage(copies(rows.select("page_id", "sha", size), least))  # Spark knows its size, and broadcasts a small one
    ranged = rows.join(known, "sha", "left").select("page_id", "url", "html", "sha", "first").repartitionByRange(
        "page_id", "sha", "url"
    )
    ranged.sortWithinPartitions("page_id", "sha", "url").mapInArrow(archived, MANIFEST).write.parquet(f"{folder}/manifest")
    return pages.sparkSession.read.schema(MANIFEST).parquet(f"{folder}/manifest")


def read(spark: SparkSession, folder: str) -> DataFrame:
    """Every record of the archives that the manifest of `folder` names, with its payload. The payload of a revisit is
    null, as it stands with the record that it names. `stored_digest` is made from the payload as read."""

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        for (file,) in rows_of(batches):
            rows, held = [], 0
            with store.open_input_stream(f"{root}/{file}", compression=None) as stream:
                for head, block in records(stream):
                    payload = block[block.index(_END) + len(_END) :] if head["WARC-Type"] == "response" else None
                    page, refers = head.get("X-Page-ID"), head.get("X-Refers-To-Page-ID")
                    rows.append((
                        page and int(page), head.get("WARC-Target-URI"), head["WARC-Type"], refers and int(refers),
                        int(head["X-Payload-Length"]) if payload is None else len(payload),
                        head["WARC-Payload-Digest"].removeprefix("sha1:"),
                        payload if payload is None else base32_sha1(payload), payload,
                    ))
                    held += len(block)
                    if held >= 4 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), _KINDS, strict=True)], _NAMES)
                        rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), _KINDS, strict=True)], _NAMES)

    files = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest").select("file")
    # a task for each archive: dealt out one by one, and a number that is given is not folded into fewer tasks
    return files.coalesce(1).repartition(max(1, files.count())).mapInArrow(parsed, RECORD)
