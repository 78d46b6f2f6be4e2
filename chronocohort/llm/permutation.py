"""Approximate nearest neighbours with a permutation index.

A vector is represented by its nearest pivots in order.  It is posted, once, in the inverted files of its ``POSTED`` nearest pivots; a posting
holds the order, the vector and its ids.  A query reads the files of its own ``READ`` nearest pivots (of more, until these hold ``FLOOR`` postings),
and meets each entry once: in the file that is nearest to the query of those that have it.  There entries are ranked by how much closer the two
orders are than orders that share no pivot (the induced footrule distance), and those down to the query's bar are reranked by the exact cosine in
double precision.  The bar is the closeness that the ``depth`` best of all entries reach, estimated from a bounded sample of entries; of each piece
of a file the ``LEAST`` best are reranked in any case, so every query finds k neighbours if there are so many.

The number of pivots grows with the square root of the number of entries, so files do as well: a query reads about READ * POSTED / ``SPREAD`` * sqrt(n)
postings of n entries, up to ``MOST_PIVOTS`` pivots (67 million entries); beyond that, in proportion to n.  Long files are cut into pieces by hash, the queries of
a pivot into blocks; each piece meets each block of its own pivot only.  Pivots and sample are the vectors with the smallest hashes; every vector
is indexed.  Equal vectors are one entry with their k + 1 smallest ids, which is all that a list of k neighbours can show of them, so copies
neither crowd out others nor pile up.  Near copies that share one order reach the bar together and are all reranked.

Vectors that are null, zero, or hold null or non-finite components, and rows without vec_id, take no part.  Shorter vectors count as
filled up with zeros.  Rows that repeat a vec_id are all candidates, and all are queries; of their results each id is listed once, with its best score.  Rows
with the query's own id are no candidates.  Equal scores go to the smaller id.  An empty table gives an empty result; other columns take no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronocohort.llm.base import small_batches
from chronocohort.session import durable

SPREAD = 4  # pivots for each unit of the square root of the number of entries
LEAST_PIVOTS, MOST_PIVOTS = 256, 1 << 15
PREFIX = 128  # places of each order that the footrule counts
POSTED = 4  # files that an entry is posted in
READ = 128  # files that a query reads
FLOOR = 4096  # postings that a query has before it at least
DEPTH = 5  # entries reranked for a query, for each unit of the square root of their number
LEAST_DEPTH = 500
LEAST = 16  # entries reranked of each piece of a file
SAMPLE = 4096  # entries from which a query's bar is estimated
PIECE, MOST_PIECE = 1024, 1 << 16  # postings in a piece of a file
PIECES = 4096  # pieces that are worth having; more only where files are longer than MOST_PIECE
BLOCK = 4096  # queries in a block


def valid(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id, v): distinct usable rows, in double precision."""
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("v"))
    usable = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("v", lambda x: x != 0)
    return rows.where(F.col("vec_id").isNotNull() & F.coalesce(usable, F.lit(False))).distinct()


def entries(rows: DataFrame, k: int) -> DataFrame:
    """(v, ids): the distinct vectors, with their k + 1 smallest ids."""
    least = rows.withColumn("n", F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))).where(F.col("n") <= k + 1)
    return least.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))


def _matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    length = np.diff(lists.offsets.to_numpy())
    flat = lists.values.slice(lists.offsets[0].as_py(), int(length.sum())).to_numpy(zero_copy_only=False)
    out = np.zeros((len(length), dim))
    out[np.repeat(np.arange(len(length)), length), np.arange(len(flat)) - np.repeat(np.cumsum(length) - length, length)] = flat
    return out


def _flat(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def orders(x: np.ndarray, pivots: np.ndarray, width: int) -> np.ndarray:
    """For each row its ``width`` nearest of ``pivots`` (of length 1) by cosine, nearest first."""
    near = -(_flat(x) @ pivots.T)
    some = np.sort(np.argpartition(near, width - 1, axis=1)[:, :width], axis=1)
    return np.take_along_axis(some, np.argsort(np.take_along_axis(near, some, 1), axis=1, kind="stable"), 1).astype(np.uint16)


def closeness(order: np.ndarray, place: np.ndarray) -> np.ndarray:
    """How much closer than strangers' each row of ``order`` is to a query that has pivots at ``place``: half of what footrule saves."""
    width = order.shape[1]
    return np.maximum(width - np.maximum(np.arange(width, dtype=np.int32), place[order]), 0).sum(axis=1)


def _bytes(x: np.ndarray) -> list[bytes]:
    """A row each; vectors in single precision where that holds them."""
    if x.dtype == np.float64 and np.array_equal(x.astype(np.float32), x):
        x = x.astype(np.float32)
    return [r.tobytes() for r in x]


def _vectors(rows: list[bytes], dim: int) -> np.ndarray:
    out = np.empty((len(rows), dim))
    for i, r in enumerate(rows):
        out[i] = np.frombuffer(r, np.float32 if len(r) == 4 * dim else np.float64)
    return out


ENTRY = "pivot int, ids array<long>, places binary, v binary"
ASKED = "pivot int, place int, query_id long, places binary, v binary, bar int"


def _post(pivots: np.ndarray):
    """Entries in, postings out."""
    dim, width = pivots.shape[1], min(PREFIX, len(pivots))

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            if not batch.num_rows:
                continue
            x = _matrix(batch["v"], dim)
            order = orders(x, pivots, width)
            files = order[:, :POSTED]
            row = pa.array(np.repeat(np.arange(len(x)), files.shape[1]))
            rest = [batch["ids"], pa.array(_bytes(order), pa.binary()), pa.array(_bytes(x), pa.binary())]
            yield pa.RecordBatch.from_arrays([pa.array(files.ravel().astype(np.int32)), *[c.take(row) for c in rest]], names=["pivot", "ids", "places", "v"])

    return run


def _ask(pivots: np.ndarray, lengths: np.ndarray, sample: np.ndarray, share: float):
    """Queries in, a row for each file that a query reads out."""
    dim, width = pivots.shape[1], min(PREFIX, len(pivots))
    nth = int(share * len(sample))

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            if not batch.num_rows:
                continue
            x = _matrix(batch["v"], dim)
            rows = []
            for own, order, v in zip(batch["vec_id"].to_pylist(), orders(x, pivots, len(pivots)), _bytes(x)):
                files = max(READ, int(np.searchsorted(np.cumsum(lengths[order]), FLOOR)) + 1)
                order = order[:files]
                place = np.full(len(pivots), len(pivots), np.int32)
                place[order] = np.arange(len(order))
                near = closeness(sample[:, :width], place)
                bar = int(np.partition(near, -nth - 1)[-nth - 1]) if nth < len(near) else -1
                rows += [(int(p), i, own, order.tobytes(), v, bar) for i, p in enumerate(order) if lengths[p]]
            types = [pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=["pivot", "place", "query_id", "places", "v", "bar"])

    return run


def _meet(n_pivots: int, dim: int, k: int):
    """A piece of a file and a block of the queries that read it in, the nearest entries that they meet here first out."""
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        if left.num_rows and right.num_rows:
            left = left.take(pa.array(np.argsort([i[0] for i in left["ids"].to_pylist()], kind="stable")))
            ids, x = left["ids"].to_pylist(), _vectors(left["v"].to_pylist(), dim)
            norm = np.linalg.norm(x, axis=1)
            order = np.frombuffer(b"".join(left["places"].to_pylist()), np.uint16).reshape(len(ids), -1)
            files = order[:, :POSTED]
            place = np.full(n_pivots, n_pivots, np.int32)
            columns = [right[c].to_pylist() for c in ("place", "query_id", "places", "bar")]
            for here, own, read, bar, q in zip(*columns, _vectors(right["v"].to_pylist(), dim)):
                read = np.frombuffer(read, np.uint16)
                place[read] = np.arange(len(read))
                first = np.flatnonzero(place[files].min(axis=1) == here)
                near = closeness(order[first], place)
                place[read] = n_pivots
                best = np.flatnonzero(near >= bar)
                if len(best) < LEAST:
                    best = np.argsort(-near, kind="stable")[:LEAST]  # ties to the smaller id
                best = first[best]
                score = (x[best] * q).sum(axis=1) / (norm[best] * np.linalg.norm(q))
                least = np.partition(score, -(k + 1))[-(k + 1)] if len(score) > k else -np.inf
                found = sorted((-score[i], m) for i in np.flatnonzero(score >= least) for m in ids[best[i]] if m != own)
                out += [(own, m, -s) for s, m in found[:k]]
        return pa.table([pa.array([r[i] for r in out], f.type) for i, f in enumerate(schema)], schema=schema)

    return run


def _least(index: DataFrame, n: int, dim: int, salt: int) -> np.ndarray:
    """The ``n`` vectors with the smallest hashes; n is bounded."""
    rows = index.select("v").orderBy(F.xxhash64("v", F.lit(salt)), "v").limit(n).collect()
    out = np.zeros((len(rows), dim))
    for i, r in enumerate(rows):
        out[i, : len(r["v"])] = r["v"]
    return out


def _every(n: Column) -> Column:
    return F.explode(F.sequence(F.lit(0), n - 1))


def search(rows: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """The ``k`` nearest found of ``rows`` for each of ``queries`` (both vec_id, v): query_id, rank, vec_id, score."""
    spark = rows.sparkSession
    small_batches(spark)
    index, asked = durable(entries(rows, k)), durable(queries)
    shape = index.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("dim")).first()
    n, dim = shape["n"], max(shape["dim"] or 1, asked.agg(F.max(F.size("v"))).first()[0] or 1)
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    pivots = _flat(_least(index, min(MOST_PIVOTS, max(LEAST_PIVOTS, int(SPREAD * n**0.5))), dim, 0))
    sample = orders(_least(index, SAMPLE, dim, 1), pivots, min(PREFIX, len(pivots)))
    postings = durable(index.mapInArrow(_post(pivots), ENTRY))

    lengths = np.zeros(len(pivots), np.int64)
    for r in postings.groupBy("pivot").count().collect():  # at most a row for each pivot
        lengths[r["pivot"]] = r["count"]
    depth = max(LEAST_DEPTH, DEPTH * n**0.5)
    asking = durable(asked.mapInArrow(_ask(pivots, lengths, sample, depth / n), ASKED))
    piece = min(MOST_PIECE, max(PIECE, int(lengths.sum()) // PIECES))
    files = spark.createDataFrame([(p, -(-int(m) // piece)) for p, m in enumerate(lengths) if m], "pivot int, pieces int")
    readers = asking.groupBy("pivot").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    tiles = F.broadcast(files.join(readers, "pivot"))  # at most a row for each pivot

    left = postings.join(tiles, "pivot").withColumn("piece", F.pmod(F.xxhash64("v"), F.col("pieces")).cast("int")).withColumn("block", _every(F.col("blocks")))
    right = asking.join(tiles, "pivot").withColumn("block", F.pmod(F.xxhash64("query_id", "v"), F.col("blocks")).cast("int")).withColumn("piece", _every(F.col("pieces")))
    tile = ["pivot", "piece", "block"]
    left, right = left.select(*tile, "ids", "places", "v"), right.select(*tile, "place", "query_id", "places", "v", "bar")
    found = left.groupBy(tile).cogroup(right.groupBy(tile)).applyInArrow(_meet(len(pivots), dim, k), "query_id long, vec_id long, score double")
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
