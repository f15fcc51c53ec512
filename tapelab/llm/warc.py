"""WARC archives: one gzip member per record, written and read by Spark tasks.

Writing: pages of one payload digest meet in a join with the digest's smallest key, so every page knows whether it is
the response or a revisit. Each task turns its pages into gzip members, one a record whatever its length, and bundles them into
archives of about ARCHIVE_BYTES. Spark's text sink commits an archive as one line of a file of its own, so lost executors and repeated
tasks leave no half archive, and any file system that Spark writes to will do. The sink ends the line with a separator, which is an
empty gzip member: an archive is its records' members and a last one without content.

Reading: a sequential reader decompresses each member piece by piece, frames the block by Content-Length, and verifies
the block digest and, for responses, the payload digest. Spark hands a task one archive at a time; those written here are bounded by
ARCHIVE_BYTES and a record, others must be below 2 GB.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapelab.llm.common import hot_join

#: Fixed values of the format.
VERSION = b"WARC/1.1"
PROFILE = b"http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: An archive ends with the record that brings it to so many bytes.
ARCHIVE_BYTES = 16 << 20
#: A gzip member without content.
END_MARK = bytes.fromhex("1f8b08000000000000ff03000000000000000000")
#: Equal payloads shorter than this are not worth a revisit.
LEAST_REVISIT = 100
CHUNK = 1 << 14


def record_id(key: int | None) -> bytes:
    return b"<urn:page:%s>" % (b"null" if key is None else b"%d" % key)


def key_of(rid: bytes) -> int | None:
    key = rid.strip()[len(b"<urn:page:") : -1]
    return None if key == b"null" else int(key)


def member(headers: list[tuple[bytes, bytes]], block: bytes) -> bytes:
    """One record as one gzip member."""
    head = VERSION + b"\r\n" + b"".join(b"%s: %s\r\n" % h for h in headers) + b"Content-Length: %d\r\n\r\n" % len(block)
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(head) + z.compress(block) + z.compress(b"\r\n\r\n") + z.flush()


def clean_uri(url: str | None, key: int | None) -> bytes:
    out = "".join(c for c in url or "" if c > " " and c != "\x7f")
    return out.encode("utf-8", "replace") or record_id(key)[1:-1]


def record(key: int | None, url: str | None, payload: bytes, digest: str, n_bytes: int, refers_to: int | None, revisit: bool, date: str) -> bytes:
    """The gzip member of one page."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % n_bytes
    block = http if revisit else http + payload
    head = [
        (b"WARC-Type", b"revisit" if revisit else b"response"), (b"WARC-Record-ID", record_id(key)), (b"WARC-Target-URI", clean_uri(url, key)), (b"WARC-Date", date.encode()),
        (b"WARC-Block-Digest", b"sha256:" + hashlib.sha256(block).hexdigest().encode()), (b"Content-Type", b"application/http; msgtype=response"), (b"WARC-Payload-Digest", b"sha256:" + digest.encode()),
    ]
    if revisit:
        head += [(b"WARC-Profile", PROFILE), (b"WARC-Refers-To", record_id(refers_to))]
    return member(head, block)


def records(data) -> Iterator[tuple[dict[bytes, bytes], bytes]]:
    """(headers, block) of each member of an archive, in turn; members without content are none. ValueError where the framing or a block digest is wrong."""
    view, at = memoryview(data), 0
    while at < len(view):
        start, z, out = at, zlib.decompressobj(31), bytearray()
        while not z.eof:
            if at >= len(view):
                raise ValueError(f"the member at byte {start} is cut off")
            try:
                out += z.decompress(view[at : at + CHUNK])
            except zlib.error as e:
                raise ValueError(f"the member at byte {start} is damaged: {e}") from e
            at += CHUNK
        at = min(at, len(view)) - len(z.unused_data)
        if not out:
            continue
        end = out.find(b"\r\n\r\n")
        lines = bytes(out[:end]).split(b"\r\n")
        if end < 0 or not lines[0].startswith(b"WARC/"):
            raise ValueError(f"no record begins at byte {start}")
        head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(b":") for x in lines[1:])}
        n = int(head[b"content-length"])
        block = bytes(out[end + 4 : end + 4 + n])
        if len(block) != n or out[end + 4 + n :] != b"\r\n\r\n":
            raise ValueError(f"the record at byte {start} isn't framed by its Content-Length")
        if (want := head.get(b"warc-block-digest")) and want != b"sha256:" + hashlib.sha256(block).hexdigest().encode():
            raise ValueError(f"the record at byte {start} doesn't match its block digest")
        yield head, block


def mark_revisits(pages: DataFrame, key: str = "page_id", payload: str = "html", url: str = "url") -> DataFrame:
    """key, url, payload (binary; null is empty; null for revisits), digest, n_bytes, refers_to, revisit.

    Of rows with equal payloads of at least 100 bytes, the one with the smallest key is the response. Rows that repeat
    that key are responses too; a null key is never referred to, and a null-key row revisits only a row that has a key.
    """
    body = pages.select(F.col(key).cast("long").alias("key"), F.col(url).cast("string").alias("url"), F.coalesce(F.col(payload).cast("binary"), F.lit(b"")).alias("payload"))
    body = body.withColumns({"digest": F.sha2("payload", 256), "n_bytes": F.octet_length("payload").cast("long")})
    first = body.filter(F.col("n_bytes") >= LEAST_REVISIT).groupBy("digest").agg(F.min("key").alias("first_key"), F.count(F.lit(1)).alias("n")).filter("n > 1 and first_key is not null")
    out = hot_join(body, first.drop("n"), ["digest"], "left")
    out = out.withColumn("revisit", F.expr("first_key is not null and (key is null or key <> first_key)"))
    return out.select("key", "url", F.when(~F.col("revisit"), F.col("payload")).alias("payload"), "digest", "n_bytes", F.when(F.col("revisit"), F.col("first_key")).alias("refers_to"), "revisit")


def write_warc(pages: DataFrame, path: str, key: str = "page_id", payload: str = "html", url: str = "url", date: str = "1970-01-01T00:00:00Z", archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Writes a record per row to archives below ``path``; an archive ends with the record that brings it to ``archive_bytes``.

    Null payloads are empty. Rows that repeat are records of their own. An empty table gives an empty file.
    """

    def archives(batches):
        held, size = [], 0
        for b in batches:
            cols = [b.column(i) for i in range(b.num_columns)]
            for i in range(b.num_rows):
                k, u, p, d, n, r, v = (c[i].as_py() for c in cols)
                held.append(record(k, u, p or b"", d, n, r, v, date))
                size += len(held[-1])
                if size >= archive_bytes:
                    yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], ["archive"])
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], ["archive"])

    out = mark_revisits(pages, key, payload, url).mapInArrow(archives, "archive binary")
    # the sink writes a line's bytes as they are, and the separator in this encoding, in which each byte is a character
    sink = out.select(F.col("archive").cast("string").alias("value")).write.option("encoding", "ISO-8859-1").option("lineSep", END_MARK.decode("iso-8859-1"))
    sink.option("maxRecordsPerFile", 1).text(path)


def read_warc(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """A row per record: page_id, url, payload_bytes, payload_digest, record_type, refers_to (and payload, null for revisits).

    A wrong frame or digest fails the read. Records of other types than response and revisit are passed over. Empty payloads are of 0 bytes;
    no archives give no rows.
    """
    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * with_payload
    types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()] + [pa.binary()] * with_payload
    names = [x.split()[0] for x in schema.split(", ")]

    def rows(content):
        for head, block in records(content):
            if head.get(b"warc-type") not in (b"response", b"revisit"):
                continue
            cut = block.index(b"\r\n\r\n") + 4
            http = {k.strip().lower(): v.strip() for k, _, v in (x.partition(b":") for x in block[:cut].split(b"\r\n")[1:])}
            digest, kind = head[b"warc-payload-digest"].removeprefix(b"sha256:").decode(), head[b"warc-type"].decode()
            body = block[cut:]
            if kind == "response" and hashlib.sha256(body).hexdigest() != digest:
                raise ValueError(f"{head[b'warc-record-id']!r} doesn't match its payload digest")
            refers = key_of(head[b"warc-refers-to"]) if kind == "revisit" else None
            row = (key_of(head[b"warc-record-id"]), head[b"warc-target-uri"].decode("utf-8", "replace"), int(http[b"content-length"]), digest, kind, refers)
            yield (*row, body if kind == "response" else None) if with_payload else row

    def parse(batches):
        for b in batches:
            for i in range(b.num_rows):
                out, size = [], 0
                for row in rows(b.column(0)[i].as_buffer()):
                    out.append(row)
                    size += 200 + (len(row[-1] or b"") if with_payload else 0)
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)
                        out, size = [], 0
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return files.select("content").mapInArrow(parse, schema)
