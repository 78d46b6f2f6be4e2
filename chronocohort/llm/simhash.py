"""SimHash near-duplicates through deletion-variant signatures.

A fingerprint of 64 bits is cut into three segments.  Two fingerprints that differ in at most four bits agree in some segment up to one bit,
as two bits in each of three segments would make six.  For every segment each fingerprint posts its variants with one position left out;
two segment values that differ in at most one bit share a variant.  There is one variant for each bit, 64 in all.

Documents with one fingerprint are one node.  Equal variants meet by an equality shuffle; within a variant's run distinct fingerprints are
compared and verified.  A run never emits all its pairs: it gives a spanning forest of its verified links, which keeps what is connected
connected.  Components are then found by star contraction in Spark rounds, each written to the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronocohort.llm.base import raw_texts, small_batches
from chronocohort.session import durable

SEED = 42
DISTANCE = 4
SEGMENTS = ((0, 22), (22, 21), (43, 21))  # first bit, width
_BITS = np.array([[(b >> (7 - k)) & 1 for k in range(8)] for b in range(256)], np.int64)


def fingerprint(data: bytes, shingle: int = 4, slice_at: int = 1 << 18) -> int:
    """SimHash of the word shingles of one text in UTF-8, as an unsigned 64-bit number; 0 without words."""
    words = data.lower().split()  # bytes: A-Z only
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    if len(words) <= shingle:
        starts, stops = [0], [len(joined)]
    else:
        starts = np.concatenate([[0], ends[:-shingle] + 1]).tolist()
        stops = ends[shingle - 1 :].tolist()
    set_bits = np.zeros((8, 8), np.int64)
    digest = xxhash.xxh64_digest
    for at in range(0, len(starts), slice_at):
        hashes = b"".join([digest(joined[a:b], SEED) for a, b in zip(starts[at : at + slice_at], stops[at : at + slice_at])])
        columns = np.frombuffer(hashes, np.uint8).reshape(-1, 8)
        for k in range(8):
            set_bits[k] += np.bincount(columns[:, k], minlength=256) @ _BITS
    return int.from_bytes(np.packbits((set_bits.ravel() * 2 > len(starts)).astype(np.uint8)).tobytes(), "big")


def _signed(values: list[int]) -> pa.Array:
    return pa.array(np.array(values, np.uint64).view(np.int64))


@F.arrow_udf(T.LongType())
def _fingerprints(texts: pa.Array) -> pa.Array:
    return _signed([fingerprint(x) for x in raw_texts(texts)])


# Called nondeterministic so that no filter on a fingerprint is moved below and has it evaluated a second time.
_fingerprints_once = _fingerprints.asNondeterministic()


def fingerprints(text: str = "text") -> Column:
    """The fingerprint of a text column as a signed long; a null text counts as empty."""
    return _fingerprints_once(F.col(text))


def variants(fp: str = "fp") -> Column:
    """64 keys: the left-out bit and what remains of its segment."""
    keys = []
    for first, width in SEGMENTS:
        segment = F.shiftrightunsigned(F.col(fp), first).bitwiseAND((1 << width) - 1)
        for bit in range(width):
            kept = segment.bitwiseAND(((1 << width) - 1) ^ (1 << bit))
            keys.append((kept + F.lit((first + bit) << 22)).cast("int"))
    return F.array(*keys)


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Star edges (member, smallest member) with the components of the edges (u, v)."""
    if not len(u):
        return u, v
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    label = np.arange(len(nodes))
    while True:
        np.minimum.at(label, label[a], label[b])
        np.minimum.at(label, label[b], label[a])
        while not np.array_equal(jumped := label[label], label):
            label = jumped
        if np.array_equal(label[a], label[b]):
            break
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def _near(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count((a ^ b).view(np.uint64)) <= DISTANCE  # of signed numbers it would count the absolute value


def _spread(run: np.ndarray, cells: int = 1 << 20) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Links of one long run, found by growing components: what is reached is compared only with what is not reached yet."""
    us, vs, left = [], [], run
    while len(left):
        root, left = left[0], left[1:]
        frontier = np.array([root], run.dtype)
        while len(frontier) and len(left):
            hit = np.zeros(len(left), bool)
            step = max(1, cells // len(left))
            for k in range(0, len(frontier), step):
                hit |= _near(frontier[k : k + step, None], left[None, :]).any(0)
            frontier, left = left[hit], left[~hit]
            us.append(frontier)
            vs.append(np.full(len(frontier), root, run.dtype))
    return us, vs


def links(keys: np.ndarray, fps: np.ndarray, long_run: int = 48) -> tuple[np.ndarray, np.ndarray]:
    """Verified links of whole runs of equal keys (sorted), as a forest."""
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    length = np.diff(np.r_[first, len(keys)])
    us, vs = [], []
    for start, n in zip(first[length > long_run], length[length > long_run]):
        a, b = _spread(fps[start : start + n])
        us += a
        vs += b
    rest = np.repeat((length > 1) & (length <= long_run), length)
    keys, fps = keys[rest], fps[rest]
    at, j = np.arange(len(keys)), 1
    while len(at):
        at = at[at + j < len(keys)]
        at = at[keys[at + j] == keys[at]]
        ok = at[_near(fps[at], fps[at + j])]
        us.append(fps[ok])
        vs.append(fps[ok + j])
        j += 1
    if not us:
        return fps[:0], fps[:0]
    return forest(np.concatenate(us), np.concatenate(vs))


def _meet(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, fp) sorted by key in, forest edges (a, b) out.  Only the last key's run is carried over."""
    names = ["a", "b"]
    keys, fps = np.zeros(0, np.int32), np.zeros(0, np.int64)
    u, v = fps, fps

    def flush(u, v):
        for k in range(0, len(u), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(u[k : k + (1 << 16)]), pa.array(v[k : k + (1 << 16)])], names=names)

    held, n = [], 0
    for batch in stream:
        held.append((batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)))
        n += batch.num_rows
        if n < 200_000:
            continue
        keys, fps = (np.concatenate([x, *(h[i] for h in held)]) for i, x in enumerate((keys, fps)))
        held, n = [], 0
        cut = int(np.searchsorted(keys, keys[-1]))
        a, b = links(keys[:cut], fps[:cut])
        keys, fps = keys[cut:], fps[cut:]
        u, v = np.concatenate([u, a]), np.concatenate([v, b])
        if len(u) > 400_000:
            u, v = forest(u, v)
            if len(u) > 200_000:
                yield from flush(u, v)
                u, v = u[:0], v[:0]
    keys, fps = (np.concatenate([x, *(h[i] for h in held)]) for i, x in enumerate((keys, fps)))
    if len(keys):
        a, b = links(keys, fps)
        u, v = forest(np.concatenate([u, a]), np.concatenate([v, b]))
    yield from flush(u, v)


def edges(nodes: DataFrame) -> DataFrame:
    """Links (a, b) that connect the distinct fingerprints ``fp`` as all links within the distance would."""
    small_batches(nodes.sparkSession)
    posted = nodes.select(F.explode(variants()).alias("key"), "fp").repartition("key").sortWithinPartitions("key")
    return posted.mapInArrow(_meet, "a long, b long").distinct()


def components(links_: DataFrame, rounds: int = 50) -> DataFrame:
    """(node, root) for every node of the edges (a, b): root is the smallest node reachable.  Alternating large and small stars."""
    now = durable(links_.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = None
    for _ in range(rounds):
        both = now.select("a", "b").union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        now = durable(small.select("e.a", "e.b").where("a <> b").distinct())
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == mark:
            break
        mark = seen
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))


def near_duplicates(prints: DataFrame) -> DataFrame:
    """``prints`` (doc_id, fp) with ``root``, the component's name, and ``component_id``, the smallest doc_id that links of at most four bits reach.

    Documents without words have fingerprint 0 and link like any other.  A null doc_id never names a component unless all ids in it are null,
    then component_id is null.  Repeated rows come out as often as they go in.  An empty table gives an empty result.
    """
    nodes = durable(prints.groupBy("fp").agg(F.min("doc_id").alias("first")))
    roots = components(edges(nodes)).withColumnRenamed("node", "fp")
    named = nodes.join(roots, "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    classes = named.groupBy("root").agg(F.min("first").alias("component_id"))
    return prints.join(named.join(classes, "root").select("fp", "root", "component_id"), "fp")


def survivors(near: DataFrame) -> DataFrame:
    """(doc_id, fp) of the one document that stays of each component: the smallest doc_id, null last, and of its rows the smallest fingerprint."""
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "fp")).alias("first")
    return near.groupBy("root").agg(first).select("first.doc_id", "first.fp")
