"""Document fingerprints by a homomorphic multiset hash of paragraphs.

Every paragraph (what stands between line feeds) is hashed to a wide vector, and a text's fingerprint is the sum of its paragraphs' vectors.
The vector has EXACT lanes, the BLAKE2b digest of the paragraph, added modulo 2^64; and LIKE lanes, in which each sentence of the paragraph
adds +1 or -1 by its XXH3 hashes, modulo 2^32.  Sums do not know the order, so texts with the same paragraphs in any order have equal
fingerprints; and paragraphs are inserted or deleted by adding or subtracting their vectors, without the rest of the text.

The sum over LIKE lanes of squares estimates the sum over sentences of squared counts, and that of a difference the squared differences of
counts (a tug-of-war sketch).  Likeness is 1 - |a - b|^2 / (|a|^2 + |b|^2), at least 0: twice the shared sentences by all sentences, if none
repeats; 1 for equal sentences, within about 0.06 of 0 for texts that share nothing.  Where neither text has a sentence it is 1 if the fingerprints
are equal, else 0.  Lanes would wrap beyond 2^31 sentences.

``edited`` fingerprints every document and its text with the last half replaced by the start of the next document.  Documents are cut into ranges of
(doc_id, hash of the text, running number) at sampled bounds; the first document of each range goes to the range before it as well, so each range finds the
next document of all its own while it streams by, one at a time.  Texts are shuffled once.  The edited fingerprint is the document's, less the
paragraphs cut off, plus those put in.

A null text counts as empty; an empty text is one empty paragraph without sentences.  Null doc_ids come first.  Rows with one doc_id follow the hash of
the text; equal rows follow each other, so any two of them may be exchanged.  A single row is its own next.  Empty tables give empty results.  Very long
texts are held whole, two at a time.  Other columns take no part.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronocohort.llm.base import batches, shuffle_width, small_batches, text_of

EXACT = 8
LIKE = 256
SENTENCE = re.compile(r"[^.!?。！？]+[.!?。！？]*")
#: Ranges of documents for each shuffle partition, ranges at most, sampled keys for each range.
RANGES, MOST_RANGES, SAMPLE = 8, 1 << 16, 8

Vector = tuple[np.ndarray, np.ndarray]


def vector(paragraphs: list[str], slice_at: int = 1 << 14) -> Vector:
    """Sum of the paragraphs' vectors."""
    exact, like = np.zeros(EXACT, np.uint64), np.zeros(LIKE, np.uint32)
    for at in range(0, len(paragraphs), slice_at):
        digests = b"".join([hashlib.blake2b(p.encode()).digest() for p in paragraphs[at : at + slice_at]])
        exact += np.frombuffer(digests, "<u8").reshape(-1, EXACT).sum(0, dtype=np.uint64)
    marks: list[bytes] = []
    for p in paragraphs:
        for s in SENTENCE.findall(p):
            if s := s.strip():
                s = s.encode()
                marks.append(xxhash.xxh3_128_digest(s) + xxhash.xxh3_128_digest(s, 1))
        if len(marks) >= slice_at:
            like += _signs(marks)
            marks = []
    return exact, like + _signs(marks)


def _signs(marks: list[bytes]) -> np.ndarray:
    ones = np.unpackbits(np.frombuffer(b"".join(marks), np.uint8).reshape(-1, LIKE // 8), axis=1).sum(0, dtype=np.int64)
    return (2 * ones - len(marks)).astype(np.uint32)


def plus(a: Vector, b: Vector) -> Vector:
    return a[0] + b[0], a[1] + b[1]


def minus(a: Vector, b: Vector) -> Vector:
    return a[0] - b[0], a[1] - b[1]


def packed(v: Vector) -> str:
    """The fingerprint as text: base64 of the lanes, little-endian."""
    return base64.b64encode(v[0].astype("<u8").tobytes() + v[1].astype("<u4").tobytes()).decode()


def unpacked(fingerprint: str) -> Vector:
    data = base64.b64decode(fingerprint)
    return np.frombuffer(data[: 8 * EXACT], "<u8"), np.frombuffer(data[8 * EXACT :], "<u4")


def fingerprint(text: str | None) -> str:
    return packed(vector((text or "").split("\n")))


def changed(fingerprint_: str, insert: list[str] = [], delete: list[str] = []) -> str:
    """The fingerprint after paragraphs were inserted and deleted."""
    return packed(minus(plus(unpacked(fingerprint_), vector(insert)), vector(delete)))


def likeness(a: Vector, b: Vector) -> float:
    x, y, d = (v.view(np.int32).astype(np.float64) for v in (a[1], b[1], a[1] - b[1]))
    both = float(x @ x + y @ y)
    if not both:
        return float(np.array_equal(a[0], b[0]))
    return max(0.0, 1.0 - float(d @ d) / both)


def _edit(text: str, after: str) -> tuple[Vector, Vector, str]:
    """Vectors of the text and of its edited text, and the edited text: the last half of the code points gives way to the first as many of ``after``."""
    cut = len(text) - len(text) // 2
    start = text.rfind("\n", 0, cut) + 1
    kept = vector(text[: start - 1].split("\n")) if start else (np.zeros(EXACT, np.uint64), np.zeros(LIKE, np.uint32))
    put = text[start:cut] + after[: len(text) // 2]
    return plus(kept, vector(text[start:].split("\n"))), plus(kept, vector(put.split("\n"))), text[:start] + put


_OUT = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])


def _pairs(stream: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, tuple]]:
    """Each document with its next; rows are (p, ghost, doc_id, text) in order, a range ends with the first document after it."""
    held = None
    for batch in stream:
        for i in range(batch.num_rows):
            p, ghost, doc_id, text = (batch.column(c)[i].as_py() for c in range(4))
            if held and held[0] == p:
                yield held, (p, ghost, doc_id, text)
            held = None if ghost else (p, ghost, doc_id, text)


def _judge(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows() -> Iterator[tuple]:
        waiting = None
        for (_, _, doc_id, text), (_, ghost, _, after) in _pairs(stream):
            own, new, body = _edit(text, after)
            if waiting:  # the document before, whose next is this one
                yield (*waiting[:6], likeness(waiting[6], own))
            row = (doc_id, len(text), hashlib.sha256(body.encode()).hexdigest(), packed(own), packed(new), likeness(own, new), own)
            waiting = None if ghost else row
            if ghost:
                yield (*row[:6], likeness(own, vector(after.split("\n"))))

    return batches(rows(), _OUT, 500)


def edited(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) with the columns of _OUT."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of("text").alias("text")).withColumn("u", F.monotonically_increasing_id())
    rows = rows.withColumn("h", F.xxhash64("text"))
    ranges = min(MOST_RANGES, RANGES * shuffle_width(spark))
    n = docs.count()
    sample = rows.sample(min(1.0, SAMPLE * ranges / max(1, n)), 7).select("doc_id", "h", "u").collect()
    keys = sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["h"], r["u"]) for r in sample)
    bounds = keys[SAMPLE :: SAMPLE]

    @F.arrow_udf(T.IntegerType())
    def place(doc_id: pa.Array, h: pa.Array, u: pa.Array) -> pa.Array:
        columns = zip(doc_id.to_pylist(), h.to_pylist(), u.to_pylist())
        return pa.array([bisect.bisect_right(bounds, (d is not None, d or 0, x, y)) for d, x, y in columns], pa.int32())

    rows = rows.withColumn("p", place("doc_id", "h", "u"))
    first = rows.groupBy("p").agg(F.min(F.struct("doc_id", "h", "u"))["u"].alias("u")).orderBy("p").collect()  # one row for each range
    before = [(r["u"], first[i - 1]["p"]) for i, r in enumerate(first)]
    ghosts = F.broadcast(spark.createDataFrame(before, "u long, before int"))
    to = F.array(F.struct(F.col("p"), F.lit(False).alias("ghost")))
    to = F.when(F.col("before").isNotNull(), F.concat(to, F.array(F.struct(F.col("before").alias("p"), F.lit(True).alias("ghost"))))).otherwise(to)
    sent = rows.join(ghosts, "u", "left").select(F.explode(to).alias("to"), "doc_id", "h", "u", "text").select("to.p", "to.ghost", "doc_id", "h", "u", "text")
    sent = sent.repartition("p").sortWithinPartitions("p", "ghost", "doc_id", "h", "u")
    return sent.select("p", "ghost", "doc_id", "text").mapInArrow(_judge, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
