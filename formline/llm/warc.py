"""WARC archives: writing, normalising whole-file gzip streams to one member a record, reading by offset.

``write`` stores records as whole-file gzip streams (one member holds all records of a file), the form that cannot be
entered in the middle. ``normalise`` inflates such a stream once, from front to back, rewrites every record as a gzip
member of its own and writes a sidecar offset index. ``read`` goes through the index: each record is one ranged read.

Archives are written by the tasks through Arrow's file systems into the shared folder. A file name belongs to one task
attempt, and only the names that a finished attempt returns enter the staged tables, so a lost executor leaves at most an
unlisted file. A file holds about ``segment_bytes`` of records; memory is bounded by the largest record.

Defined cases: null html is an empty payload; a null url leaves the target out; a null page_id makes a record whose id says
``null``, which is never referred to. Of equal payloads of at least ``min_bytes`` the largest page_id is the response; rows
that repeat that page_id are responses too, so no record ever refers to itself. Other columns are ignored. An empty table
gives no archive and no row. A damaged archive raises.
"""

from __future__ import annotations

import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from formline.session import run_dir, staged

MIN_BYTES = 1000
SEGMENT_BYTES = 64 << 20
SALTS = 16
INDEX = "archive string, offset bigint, length bigint, record_id string"
RECORD = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"
URN = "<urn:page:{}>"


def plan_records(pages: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """page_id, url, payload, digest and the page each record revisits (null for a response).

    The largest page_id of a payload is a map-side reduced maximum. Only payloads that occur again are joined back, on
    digest and salt, so a payload that a third of all pages share is spread over many tasks.
    """
    rows = pages.select(
        "page_id", "url", F.coalesce(F.encode("html", "UTF-8"), F.lit(b"")).alias("payload"),
    ).select(
        "*", F.sha1("payload").alias("digest"), F.sha2("payload", 256).alias("strong"),
        F.pmod(F.hash("page_id"), F.lit(SALTS)).alias("salt"),
    )
    again = (
        rows.where(F.length("payload") >= min_bytes).groupBy("strong")
        .agg(F.max("page_id").alias("first_id"), F.count(F.lit(1)).alias("n")).where("n > 1")
        .select("strong", "first_id", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    )
    return rows.join(again, ["strong", "salt"], "left").select(
        "page_id", "url", "payload", "digest",
        F.when(~F.col("first_id").eqNullSafe(F.col("page_id")), F.col("first_id")).alias("refers_to"),
    )


def record_bytes(page_id, url, payload: bytes, digest: str, refers_to) -> bytes:
    """One WARC/1.1 record with its closing blank lines. A revisit carries no payload, only its digest and length."""
    if refers_to is None:
        http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
        kind, block = "response", http + payload
    else:
        kind, block = "revisit", b"HTTP/1.1 200 OK\r\n\r\n"
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {URN.format('null' if page_id is None else page_id)}",
        "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Payload-Length: {len(payload)}",
    ]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if refers_to is not None:
        head += [f"WARC-Refers-To: {URN.format(refers_to)}",
                 "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode() + block + b"\r\n\r\n"


def records(stream) -> Iterator[tuple[dict[str, str], bytes, bytes]]:
    """Headers, block and raw bytes of each record of an inflated stream, read once from front to back."""
    while line := stream.readline():
        if line == b"\r\n":
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:40]!r}")
        head, raw = {}, [line]
        while (line := stream.readline()) not in (b"\r\n", b""):
            name, _, value = line.decode().partition(":")
            head[name.lower()] = value.strip()
            raw.append(line)
        size = int(head["content-length"])
        block = stream.read(size)
        if len(block) != size:
            raise ValueError("the archive ends inside a record")
        yield head, block, b"".join([*raw, b"\r\n", block, b"\r\n\r\n"])


def write(rows: DataFrame, folder: str, level: int = 3, segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """Write planned records as whole-file gzip streams; one row (archive) a file."""

    def task(batches):
        fs, root = arrow_fs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        out, size = None, 0
        for batch in batches:
            for row in zip(*(batch.column(c) for c in range(batch.num_columns)), strict=True):
                if out is None:
                    name = f"{root}/whole-{uuid.uuid4().hex}.warc.gz"
                    sink = fs.open_output_stream(name, compression=None)
                    out, size = zlib.compressobj(level, wbits=31), 0
                data = record_bytes(*(v.as_py() for v in row))
                sink.write(out.compress(data))
                size += len(data)
                if size >= segment_bytes:
                    sink.write(out.flush())
                    sink.close()
                    out = None
                    yield pa.RecordBatch.from_pydict({"archive": [name]})
        if out is not None:
            sink.write(out.flush())
            sink.close()
            yield pa.RecordBatch.from_pydict({"archive": [name]})

    return rows.select("page_id", "url", "payload", "digest", "refers_to").mapInArrow(task, "archive string")


def normalise(archives: DataFrame, folder: str, level: int = 6) -> DataFrame:
    """Inflate each archive once, rewrite every record as its own member beside a ``.idx`` sidecar; the index rows."""

    def task(batches):
        fs, root = arrow_fs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        for batch in batches:
            for source in batch.column("archive").to_pylist():
                name = f"{root}/members-{uuid.uuid4().hex}.warc.gz"
                ids, offsets, at = [], [], 0
                with fs.open_input_stream(source, compression=None) as raw, gzip.GzipFile(fileobj=raw) as stream, \
                        fs.open_output_stream(name, compression=None) as out:
                    for head, _, data in records(stream):
                        deflate = zlib.compressobj(level, wbits=31)
                        member = deflate.compress(data) + deflate.flush()
                        out.write(member)
                        ids.append(head["warc-record-id"])
                        offsets.append((at, len(member)))
                        at += len(member)
                with fs.open_output_stream(f"{name}.idx", compression=None) as side:
                    side.write("".join(f"{o}\t{n}\t{i}\n" for (o, n), i in zip(offsets, ids, strict=True)).encode())
                yield pa.RecordBatch.from_pydict({
                    "archive": pa.array([name] * len(ids), pa.string()),
                    "offset": pa.array([o for o, _ in offsets], pa.int64()),
                    "length": pa.array([n for _, n in offsets], pa.int64()), "record_id": pa.array(ids, pa.string()),
                })

    spread = max(1, archives.count())
    return archives.repartition(spread, "archive").mapInArrow(task, INDEX)


def _page(urn: str | None) -> int | None:
    value = urn and urn.removeprefix("<urn:page:").removesuffix(">")
    return None if value in (None, "null") else int(value)


def read(index: DataFrame, folder: str, with_payload: bool = False) -> DataFrame:
    """One row a record, each by a ranged read of its member. Length and digest of a response are taken from the payload
    itself and must equal its header; a revisit has those of the payload it stands for in its header."""

    def task(batches):
        fs, _ = arrow_fs.FileSystem.from_uri(folder)
        name, file = None, None
        for batch in batches:
            rows = []
            for archive, offset, length in zip(*(batch.column(c).to_pylist() for c in ("archive", "offset", "length")),
                                               strict=True):
                if archive != name:
                    name, file = archive, fs.open_input_file(archive)
                file.seek(offset)
                with gzip.GzipFile(fileobj=pa.BufferReader(file.read(length))) as stream:
                    head, block, _ = next(records(stream))
                digest = head["warc-payload-digest"].removeprefix("sha1:")
                size, payload = int(head["warc-payload-length"]), None
                if head["warc-type"] == "response":
                    payload = block.partition(b"\r\n\r\n")[2]
                    if (len(payload), hashlib.sha1(payload).hexdigest()) != (size, digest):
                        raise ValueError(f"{archive}: the payload at {offset} does not have its digest")
                rows.append((_page(head["warc-record-id"]), size, digest, head["warc-type"],
                             _page(head.get("warc-refers-to")), *[payload] * with_payload))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), *[pa.binary()] * with_payload]
            names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", *["payload"] * with_payload]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)

    spread = max(1, index.select("archive").distinct().count())
    placed = index.repartition(spread, "archive").sortWithinPartitions("archive", "offset")
    return placed.mapInArrow(task, RECORD + ", payload binary" * with_payload)


def archive_pages(pages: DataFrame, min_bytes: int = MIN_BYTES) -> tuple[DataFrame, str]:
    """Write ``pages``, normalise the archives; the staged index and the folder of the archives."""
    folder = run_dir(pages.sparkSession, "warc")
    whole = staged(write(plan_records(pages, min_bytes), f"{folder}/archives"), f"{folder}/whole")
    return staged(normalise(whole, f"{folder}/archives"), f"{folder}/index"), f"{folder}/archives"


def round_trip(pages: DataFrame) -> DataFrame:
    """Write, normalise and read back: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    index, folder = archive_pages(pages)
    return read(index, folder)
