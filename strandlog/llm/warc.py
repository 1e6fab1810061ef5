"""WARC archives with a splittable reader (operator 10).

Writer: every record is a gzip member of its own.  Of records with equal payloads of at least
``min_bytes`` bytes the one with the smallest id is a response, the others are revisit records that
name it and hold no payload.  Each task writes one file through pyarrow's file systems into the
shared folder: first under a name of its own attempt, then moved into place, so a repeated task
replaces its file by an equal one.

Reader: files are cut into byte ranges.  A task seeks to its range and looks for the gzip magic;
a candidate counts as a member only if it inflates to a WARC version line and complete record
headers of any length, so a magic inside compressed data is passed over.  A task owns the records that
start inside its range and reads the last of them beyond it; the place after an owned member is the
next candidate, so nothing is read twice or missed.  A member that is cut off, and bytes between two
members of a range, are errors: nothing is passed over silently.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlog.llm.common import own_folder

MAGIC = b"\x1f\x8b\x08"
RANGE = 8 << 20  #: bytes of an archive that one task owns
READ = 1 << 20
STEP = 1 << 16  #: bytes inflated at once in search of the end of a record's headers
WRITTEN = "path string, size long"


def member(kind: str, record: int, url: str | None, payload: bytes, digest: str, size: int, refers_to: int | None) -> bytes:
    """One record as a gzip member; a revisit carries headers only."""
    body = payload if kind == "response" else b""
    lines = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{record}>", "WARC-Date: 2024-01-01T00:00:00Z",
        f"WARC-Target-URI: {' '.join((url or 'about:blank').split())}", f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Bytes: {size}",
    ]
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head = "\r\n".join([*lines, "Content-Type: text/html; charset=utf-8", f"Content-Length: {len(body)}", "", ""]).encode()
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(head + body + b"\r\n\r\n") + packer.flush()


def plan(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", body_col: str = "html", min_bytes: int = 100) -> DataFrame:
    """(id, url, body, digest, size, refers_to): what is to be written; refers_to is null for responses.

    Payloads are equal if their SHA-256 are.  Only ids and digests are grouped, with partial
    aggregation; bodies move once, by id, and those of revisits not at all.  A row without an id
    is always a response and never referred to.
    """
    own = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), F.coalesce(F.col(body_col), F.lit("")).cast("binary").alias("body"))
    own = own.withColumn("digest", F.sha2("body", 256)).withColumn("size", F.octet_length("body").cast("long"))
    first = own.filter(F.col("size") >= min_bytes).groupBy("digest").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("digest", "first")
    again = own.select("id", "digest", "size").filter(F.col("size") >= min_bytes).join(first, "digest").filter(F.col("id") != F.col("first")).select("id", "digest", F.col("first").alias("refers_to")).distinct()
    return own.join(again, ["id", "digest"], "left")


def write(records: DataFrame, folder: str) -> DataFrame:
    """Writes the archives and returns (path, size) of the files, as an eager result in a small table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        final = f"{root}/{task.partitionId():06d}.warc.gz"
        own = f"{final}.{task.taskAttemptId()}"
        size = 0
        with store.open_output_stream(own, compression=None) as out:
            for batch in batches:
                for i in range(batch.num_rows):
                    r = {n: batch.column(j)[i].as_py() for j, n in enumerate(batch.schema.names)}
                    kind = "response" if r["refers_to"] is None else "revisit"
                    data = member(kind, "" if r["id"] is None else r["id"], r["url"], r["body"] or b"", r["digest"], r["size"], r["refers_to"])
                    out.write(data)
                    size += len(data)
        store.move(own, final)
        if size:
            yield pa.RecordBatch.from_arrays([pa.array([final]), pa.array([size], pa.int64())], ["path", "size"])

    body = F.when(F.col("refers_to").isNull(), F.col("body"))
    return records.select("id", "url", body.alias("body"), "digest", "size", "refers_to").mapInArrow(run, WRITTEN)


def _headers(data: bytes) -> dict[str, str] | None:
    """The headers at the front of a record, if they are complete and valid."""
    end = data.find(b"\r\n\r\n")
    if not data.startswith(b"WARC/1.") or end < 0:
        return None
    try:
        pairs = [x.split(": ", 1) for x in data[:end].decode().split("\r\n")[1:]]
        out = {k.lower(): v for k, v in pairs}
        int(out["content-length"])
        return out if "warc-type" in out else None
    except (ValueError, KeyError):
        return None


def records_in(handle, start: int, end: int) -> Iterator[tuple[dict[str, str], bytes]]:
    """The records that start in [start, end) of an open archive."""
    at, data, base, owned = start, b"", start, False  # data: the bytes from base on

    def more() -> bool:
        nonlocal data
        new = handle.read_at(min(READ, max(0, handle.size() - base - len(data))), base + len(data)) if base + len(data) < handle.size() else b""
        data += new
        return bool(new)

    def starts() -> bool:
        """Whether a member with valid record headers, however long, starts at the front of the data."""
        unpack, head, used, rest = zlib.decompressobj(31), bytearray(), 0, b""
        try:
            while not unpack.eof:
                if not rest:
                    if used == len(data) and not more():
                        return False
                    rest = data[used : used + STEP]
                    used += len(rest)
                seen = max(0, len(head) - 3)
                head += unpack.decompress(rest, STEP)
                rest = unpack.unconsumed_tail
                if not head.startswith(b"WARC/1."[: len(head)]):
                    return False
                if head.find(b"\r\n\r\n", seen) >= 0:
                    return _headers(bytes(head)) is not None
        except zlib.error:
            pass
        return False

    while at < end:
        data, base = data[at - base :] if at - base <= len(data) else b"", at
        after = at
        found = data.find(MAGIC)
        while found < 0 and base + len(data) - 2 < end:
            keep = max(0, len(data) - 2)
            data, base = data[keep:], base + keep
            if not more():
                break
            found = data.find(MAGIC)
        if owned and after < handle.size() and (found < 0 or base + found != after):
            raise ValueError(f"no record starts at byte {after}, after the one before")
        if found < 0 or base + found >= end:
            return
        at = base + found
        data, base = data[found:], at
        if not starts():
            if owned:
                raise ValueError(f"no record starts at byte {after}, after the one before")
            at += 1
            continue
        unpack, parts, used = zlib.decompressobj(31), [], 0
        while not unpack.eof:
            if used == len(data) and not more():
                break
            parts.append(unpack.decompress(data[used:]))
            used = len(data) - len(unpack.unused_data)
        if not unpack.eof:
            raise ValueError(f"the record at byte {at} is cut off")
        content = b"".join(parts)
        head = _headers(content)
        body = content.find(b"\r\n\r\n") + 4
        if len(content) < body + int(head["content-length"]):
            raise ValueError(f"the record at byte {at} is shorter than its headers say")
        yield head, content[body : body + int(head["content-length"])]
        at, owned = base + used, True


def read(spark: SparkSession, files: DataFrame, folder: str, width: int = RANGE) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, url, payload) of all records.

    ``payload`` is null for revisits, whose bytes and digest come from their headers; those of a
    response are taken from its payload, which must match the header.
    """
    ranges = files.select("path", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(width).cast("long"))).alias("start"))

    def number(uri: str | None) -> int | None:
        digits = (uri or "").removeprefix("<urn:page:").removesuffix(">")
        return int(digits) if digits else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(folder)
        names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "payload"]
        types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]
        for batch in batches:
            for path, size, start in zip(*(c.to_pylist() for c in batch.columns)):
                rows, held = [], 0
                with store.open_input_file(path) as handle:
                    if handle.size() != size:
                        raise ValueError(f"{path} has {handle.size()} bytes, not {size}")
                    for head, payload in records_in(handle, start, min(size, start + width)):
                        response = head["warc-type"] == "response"
                        digest = hashlib.sha256(payload).hexdigest() if response else head["warc-payload-digest"].removeprefix("sha256:")
                        if response and f"sha256:{digest}" != head["warc-payload-digest"]:
                            raise ValueError(f"payload of {head['warc-record-id']} in {path} differs from its digest")
                        rows.append((number(head["warc-record-id"]), len(payload) if response else int(head["x-payload-bytes"]), digest, head["warc-type"], number(head.get("warc-refers-to")), head["warc-target-uri"], payload if response else None))
                        held += len(payload) + 300
                        if held > 4 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    spread = ranges.repartition(max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))), "path", "start")
    return spread.mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary")


def archive(pages: DataFrame, **columns) -> DataFrame:
    """Writes one record per page into a new folder of the shared folder and reads the archives back."""
    from strandlog.llm.common import staged

    folder = f"{own_folder(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    files = staged(write(plan(pages, **columns), folder), "warc-files")
    return read(pages.sparkSession, files, folder)
