"""WARC archives: a writer and a sequential reader.

An archive is a chain of gzip members, one for each record.  The writer makes members in Python tasks and Spark's own text writer puts them
into files, so archives go to whatever store the folder is in and a lost task is committed once.  That writer ends each row with a separator,
for which it is given the zero byte: a gzip member ends with the high byte of the record's length, which is zero for records below 16 MiB, so
the separator is that byte and the file is a plain chain of members.  Larger records are followed by a zero byte of padding, which gzip
readers skip.

The reader takes archives one at a time, inflates step by step, frames records by Content-Length, and checks payload digests.

Records of equal payloads of at least ``least`` bytes: the one with the largest page_id is a response, others are revisits of it without
payload.  Rows that share that page_id are all responses.  A null page_id is below all others.  A null url or page_id has no header; control
characters in a url are escaped.  A null html is an empty payload.  Repeated rows give a record each.  An empty table gives empty archives and
no rows.  Other columns take no part.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronocohort.llm.base import batches, small_batches

LEAST = 1000
ARCHIVE_BYTES = 16 << 20
STEP = 1 << 16
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, verified boolean, payload binary"


def payload(html: str = "html") -> Column:
    return F.encode(F.coalesce(F.col(html).cast("string"), F.lit("")), "UTF-8")


def plan(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """(page_id, url, body, refers_to): refers_to is null for responses.  Digests of payloads that occur more than once are counted before
    any payload moves; only their rows can be revisits."""
    rows = pages.select("page_id", "url", payload().alias("body")).withColumn("digest", F.when(F.length("body") >= least, F.sha1("body")))
    last = rows.where("digest is not null").groupBy("digest").agg(F.max("page_id").alias("last"), F.count("*").alias("n")).where("n > 1").drop("n")
    out = rows.join(last, "digest", "left")
    return out.select("page_id", "url", "body", F.when(~F.col("page_id").eqNullSafe(F.col("last")), F.col("last")).alias("refers_to"))


def _record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'page {page_id} {digest}')}>"


def member(page_id: int | None, url: str | None, body: bytes, refers_to: int | None) -> bytes:
    """One record as a gzip member."""
    sha = hashlib.sha1(body)
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: %d\r\n\r\n" % len(body)
    block = http if refers_to is not None else http + body
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {_record_id(page_id, sha.hexdigest())}", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + "".join(f"%{ord(c):02X}" if ord(c) < 33 or ord(c) == 127 else c for c in url))
    if page_id is not None:
        head.append(f"WARC-X-Page-ID: {page_id}")
    head.append(f"WARC-Payload-Digest: sha1:{base64.b32encode(sha.digest()).decode()}")
    if refers_to is not None:
        head += [f"WARC-Refers-To: {_record_id(refers_to, sha.hexdigest())}", f"WARC-X-Refers-To-Page-ID: {refers_to}", f"WARC-Profile: {PROFILE}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    data = "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def write(planned: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Write archives of about ``archive_bytes`` (more only where a single record is larger) below ``folder``."""
    small_batches(planned.sparkSession)
    schema = pa.schema([("archive", pa.int64()), ("value", pa.binary())])

    def pack(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = archive = 0
        for batch in stream:
            out = []
            for row in zip(*(batch.column(i) for i in range(4))):
                made = member(*(x.as_py() for x in row))
                if size and size + len(made) > archive_bytes:
                    archive, size = archive + 1, 0
                size += len(made)
                out.append((archive, made[:-1] if made[-1] == 0 else made))
            yield from batches(out, schema)

    packed = planned.select("page_id", "url", "body", "refers_to").mapInArrow(pack, "archive long, value binary")
    packed.select("archive", F.col("value").cast("string").alias("value")).write.partitionBy("archive").option("lineSep", "\x00").text(folder)


class Reader:
    """Records of one archive in order."""

    def __init__(self, data: memoryview):
        self.data, self.at = data, 0

    def _member(self) -> Iterator[bytes]:
        """The content of the gzip member at this place, inflated step by step."""
        z = zlib.decompressobj(31)
        while not z.eof:
            some = z.unconsumed_tail or self.data[self.at : self.at + STEP]
            if not z.unconsumed_tail:
                self.at += len(some)
                if not some:
                    raise ValueError("archive ends within a record")
            if out := z.decompress(some, STEP):
                yield out
        self.at -= len(z.unused_data)

    def __iter__(self) -> Iterator[tuple[dict[str, str], bytearray]]:
        while True:
            while self.at < len(self.data) and self.data[self.at] == 0:  # padding
                self.at += 1
            if self.at >= len(self.data):
                return
            yield self._record()

    def _record(self) -> tuple[dict[str, str], bytearray]:
        held, parts = bytearray(), self._member()
        while (cut := held.find(b"\r\n\r\n")) < 0:
            held += next(parts, None) or self._broken("a record without end of header")
        lines = held[:cut].decode("utf-8").split("\r\n")
        if not lines[0].startswith("WARC/"):
            self._broken("no WARC record")
        head = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
        block = held[cut + 4 :]
        for part in parts:
            block += part
        n = int(head["content-length"])
        if len(block) != n + 4 or block[n:] != b"\r\n\r\n":
            self._broken("Content-Length does not frame the record")
        del block[n:]
        return head, block

    def _broken(self, what: str):
        raise ValueError(f"{what}, near byte {self.at} of the archive")


def _row(head: dict[str, str], block: bytearray, with_payload: bool) -> tuple:
    cut = block.find(b"\r\n\r\n") + 4
    http = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in block[:cut].decode("latin-1").split("\r\n"))}
    told = base64.b32decode(head["warc-payload-digest"].removeprefix("sha1:")).hex()
    full = head["warc-type"] == "response"
    body = memoryview(block)[cut:]
    if full and (hashlib.sha1(body).hexdigest() != told or len(body) != int(http["content-length"])):
        raise ValueError(f"payload digest of {head['warc-record-id']} does not hold")
    number = {k: int(head[k]) if k in head else None for k in ("warc-x-page-id", "warc-x-refers-to-page-id")}
    return (number["warc-x-page-id"], head.get("warc-target-uri"), head["warc-type"], int(http["content-length"]), told, number["warc-x-refers-to-page-id"], full, bytes(body) if with_payload and full else None)


def read(spark: SparkSession, folder: str, with_payload: bool = True) -> DataFrame:
    """The records of all archives below ``folder``.  ``verified``: the payload was there and its digest held; a digest that fails is an error."""
    small_batches(spark)
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("verified", pa.bool_()), ("payload", pa.binary())])

    def unpack(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            for archive in batch.column(0):
                yield from batches((_row(head, block, with_payload) for head, block in Reader(memoryview(archive.as_buffer()))), schema, 256)

    archives = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("content")
    return archives.mapInArrow(unpack, RECORD)
