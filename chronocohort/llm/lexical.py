"""Ranked lexical search with a document FP-tree.

The items to search for have few terms, so every document is restricted to them: a vector of (term, tf), its terms ordered by document
frequency, the most frequent first.  Vectors that begin with the same terms share a path of a trie.  Every node keeps, for its subtree, the
maximum tf of each term and the minimum of the documents' length measure m; a score grows with tf and falls with m, so these two bound the
score of all documents below.  Each item walks each tree depth first, the most promising child first, and leaves out subtrees whose bound
is below its k-th best score so far; documents in the buckets at the leaves are scored exactly.

Spark deals the work: one pass restricts whole texts, with document frequencies and lengths summed over all documents; the tasks of a second
pass build trees of as many documents as fit a fixed number of cells (documents x terms) and carry each item's best k from tree to tree;
what the tasks found is ranked in two levels.  Nothing is joined to items but the k best of each task.  Items are searched once for each
distinct set of terms, in blocks of about BLOCK_TERMS terms, so what travels with the tasks is bounded whatever the number of items; every
block reads the documents anew.

A null text has no terms.  Items without terms, and a table without terms, give no rows; neither do empty tables.  Very long texts are cut into
terms piece by piece.  Equal scores rank by ascending doc_id, null last; repeated documents and repeated items count and rank as rows of their
own.  Other columns take no part, whatever their names.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronocohort.llm.base import small_batches, text_of
from chronocohort.session import durable

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What terms are made of stays, letters A-Z get lower case, all else becomes a blank.
_PLAIN = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256)).lower()

BLOCK_TERMS = 1 << 14
CELLS = 1 << 22
LEAF = 48
PIECE = 1 << 20


def terms_of(text: str) -> Column:
    return F.regexp_extract_all(F.translate(text_of(text), UPPER, LOWER), F.lit(TERM), F.lit(0))


def pieces(data: bytes) -> Iterator[list[bytes]]:
    """The terms of one text in UTF-8, some at a time."""
    plain = data.translate(_PLAIN)
    at = 0
    while len(plain) - at > PIECE:
        stop = plain.find(b" ", at + PIECE)
        if stop < 0:
            break
        yield plain[at:stop].split()
        at = stop
    yield plain[at:].split()


def restricted(docs: DataFrame, number: dict[bytes, int], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n, terms, tfs) of each document with a term: n counts all its terms, the arrays list those that ``number`` numbers."""
    get = number.get

    def cut(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            lengths, sizes, ids, tfs, kept = [], [], [], [], []
            for row, body in enumerate(batch.column(1).cast(pa.large_binary())):
                n, found = 0, Counter()
                for piece in pieces(body.as_py() or b""):
                    n += len(piece)
                    found.update(map(get, piece))
                found.pop(None, None)
                if n:
                    kept.append(row)
                    lengths.append(n)
                    sizes.append(len(found))
                    ids.extend(found)
                    tfs.extend(found.values())
            ends = pa.array(np.r_[0, np.cumsum(np.array(sizes, np.int64))].astype(np.int32))
            lists = [pa.ListArray.from_arrays(ends, pa.array(x, pa.int32())) for x in (ids, tfs)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(kept, pa.int64())), pa.array(lengths, pa.int64()), *lists], names=["doc_id", "n", "terms", "tfs"])

    small_batches(docs.sparkSession)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(cut, "doc_id long, n long, terms array<int>, tfs array<int>")


def scores(weights: np.ndarray, tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Score of each row of ``tf`` (rows x terms); with maxima of tf and minima of m, a bound."""
    tf = tf.astype(np.int64)
    return (weights * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[:, None]))).sum(1)


class Tree:
    """FP-tree of some documents: ``tf`` (documents x terms, terms by falling frequency), ``m`` and ``ids`` of the documents.

    Chains of nodes with one child are one node.  A node is a run of documents in the order of their paths; children of a node stand together.
    Small neighbours share a bucket.
    """

    def __init__(self, tf: np.ndarray, m: np.ndarray, ids: list):
        paths = np.packbits(tf > 0, axis=1)
        order = sorted(range(len(paths)), key=lambda i: paths[i].tobytes(), reverse=True)
        self.tf, self.m, self.ids, paths = tf[order], m[order], [ids[i] for i in order], paths[order]
        self.runs, self.children = [(0, len(order))], [None]
        shared, same = self._shared(paths)
        at = 0
        while at < len(self.runs):
            lo, hi = self.runs[at]
            inner = shared[lo : hi - 1]  # terms that documents lo + i and lo + i + 1 share from the root on
            if hi - lo > LEAF and not same[lo : hi - 1].all():
                parts = self._buckets([lo, *(np.flatnonzero(inner == inner.min()) + lo + 1).tolist(), hi])
                self.children[at] = (len(self.runs), len(self.runs) + len(parts))
                self.runs += parts
                self.children += [None] * len(parts)
            at += 1
        self._bounds()

    @staticmethod
    def _shared(paths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For neighbours: the number of terms at the start of both paths, and whether they are equal."""
        bits = np.bitwise_count(paths)
        so_far = np.cumsum(bits, axis=1, dtype=np.int64) - bits
        differ = paths[1:] ^ paths[:-1]
        byte = (differ != 0).argmax(1) if paths.shape[1] else np.zeros(len(differ), np.int64)
        rows = np.arange(len(differ))
        value = differ[rows, byte].astype(np.int64)
        kept = 8 - np.frexp(value.astype(np.float64))[1]  # bits of the byte before the first that differs
        before = np.bitwise_count((paths[:-1][rows, byte].astype(np.int64) << kept) >> 8)
        same = value == 0
        return np.where(same, so_far[:-1, -1] + bits[:-1, -1], so_far[:-1][rows, byte] + before), same

    @staticmethod
    def _buckets(cuts: list[int]) -> list[tuple[int, int]]:
        out: list[tuple[int, int]] = []
        for lo, hi in zip(cuts, cuts[1:]):
            if out and hi - out[-1][0] <= LEAF:
                out[-1] = (out[-1][0], hi)
            else:
                out.append((lo, hi))
        return out

    def _bounds(self) -> None:
        leaves = sorted((lo, at) for at, (lo, _) in enumerate(self.runs) if self.children[at] is None)
        starts, at = [lo for lo, _ in leaves], [k for _, k in leaves]
        self.most = np.zeros((len(self.runs), self.tf.shape[1]), self.tf.dtype)
        self.least = np.zeros(len(self.runs), np.int64)
        self.most[at] = np.maximum.reduceat(self.tf, starts, axis=0)
        self.least[at] = np.minimum.reduceat(self.m, starts)
        for k in range(len(self.runs) - 1, -1, -1):
            if self.children[k]:
                a, b = self.children[k]
                self.most[k] = self.most[a:b].max(0)
                self.least[k] = self.least[a:b].min()

    def search(self, columns: np.ndarray, weights: np.ndarray, best: list[tuple], k: int) -> list[tuple]:
        """``best``, at most k sorted entries (-score, no id, doc_id), brought up to date with the documents of this tree."""
        bound = lambda a, b: scores(weights, self.most[a:b, columns], self.least[a:b])
        todo = [(int(bound(0, 1)[0]), 0)]
        while todo:
            top, node = todo.pop()
            needed = -best[-1][0] if len(best) == k else 1
            if top < needed:
                continue
            if self.children[node]:
                a, b = self.children[node]
                tops = bound(a, b)
                todo += [(int(tops[i]), a + int(i)) for i in np.argsort(tops) if tops[i] >= needed]
                continue
            lo, hi = self.runs[node]
            found = scores(weights, self.tf[lo:hi, columns], self.m[lo:hi])
            if len(found) > k:
                needed = max(needed, int(np.partition(found, -k)[-k]))
            hits = [(-int(found[i]), self.ids[lo + i] is None, self.ids[lo + i] or 0) for i in np.flatnonzero(found >= needed)]
            if hits:
                best = sorted(best + hits)[:k]
        return best


def _searched(vectors: DataFrame, place: np.ndarray, queries: list[tuple[str, np.ndarray, np.ndarray]], total: int, words: int, k: int) -> DataFrame:
    """(q, doc_id, score, part): the k best documents of each query among those of each task."""
    width = len(place)
    many = max(LEAF, CELLS // width)

    def walk(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [[] for _ in queries]
        ids, lengths, rows, columns, tfs = [], [], [], [], []

        def grow() -> None:
            tf = np.zeros((len(ids), width), np.uint32)
            tf[np.concatenate(rows), place[np.concatenate(columns)]] = np.concatenate(tfs)
            m = np.array([10 + 90 * n * total // words for n in lengths], np.int64)
            tree = Tree(tf, m, ids.copy())
            for i, (_, at, weights) in enumerate(queries):
                best[i] = tree.search(at, weights, best[i], k)

        for batch in stream:
            for doc_id, n, terms, counts in zip(*(c.to_pylist() if i < 2 else c for i, c in enumerate(batch.columns))):
                if not len(terms):
                    continue
                found = terms.values.to_numpy()
                rows.append(np.full(len(found), len(ids)))
                columns.append(found)
                tfs.append(counts.values.to_numpy())
                ids.append(doc_id)
                lengths.append(n)
                if len(ids) == many:
                    grow()
                    for x in (ids, lengths, rows, columns, tfs):
                        x.clear()
        if ids:
            grow()
        out = [(q, None if no else doc_id, -score) for (q, _, _), b in zip(queries, best) for score, no, doc_id in b]
        q, doc_id, score = zip(*out) if out else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(q, pa.string()), pa.array(doc_id, pa.int64()), pa.array(score, pa.int64())], names=["q", "doc_id", "score"])

    return vectors.select("doc_id", "n", "terms", "tfs").mapInArrow(walk, "q string, doc_id long, score long").withColumn("part", F.spark_partition_id() % 64)


def _block(docs: DataFrame, items: list, k: int) -> DataFrame | None:
    """(q, rank, doc_id, score) of the distinct items (q, terms) of one block."""
    number = {t: i for i, t in enumerate(sorted({t.encode() for _, terms in items for t in terms}))}
    vectors = durable(restricted(docs, number))
    total, words = vectors.agg(F.count("*"), F.sum("n")).first()
    df = np.zeros(len(number), np.int64)
    for r in vectors.select(F.explode("terms").alias("t")).groupBy("t").count().collect():
        df[r["t"]] = r["count"]
    place = np.empty(len(number), np.int64)
    place[np.lexsort((np.arange(len(number)), -df))] = np.arange(len(number))
    queries = []
    for q, terms in items:
        known = [i for i in (number[t.encode()] for t in terms) if df[i]]
        if known:
            weights = [math.floor(1000 * math.log((2 * total + 2) / (2 * int(df[i]) + 1))) for i in known]
            queries.append((q, place[known], np.array(weights, np.int64)))
    if not queries:
        return None
    order = [F.desc("score"), F.col("doc_id").asc_nulls_last()]
    first = Window.partitionBy("q", "part").orderBy(*order)
    found = _searched(vectors, place, queries, total, words, k).withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= k)
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(*order))).where(F.col("rank") <= k).select("q", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """(item_id, rank, doc_id, score): the k documents (doc_id, text) with the highest scores above 0 for each of ``items`` (item_id, text)."""
    asked = items.select("item_id", F.array_sort(F.array_distinct(terms_of("text"))).alias("terms")).where(F.size("terms") > 0)
    asked = durable(asked.withColumn("q", F.sha2(F.array_join("terms", " "), 256)))
    distinct = durable(asked.groupBy("q").agg(F.first("terms").alias("terms")))
    blocks = max(1, math.ceil((distinct.agg(F.sum(F.size("terms"))).first()[0] or 0) / BLOCK_TERMS))
    found = None
    for b in range(blocks):
        rows = distinct.where(F.pmod(F.xxhash64("q"), F.lit(blocks)) == b).orderBy("q").collect()
        hits = _block(docs, [(r["q"], r["terms"]) for r in rows], k) if rows else None
        if hits is not None:
            found = durable(hits) if found is None else found.unionByName(durable(hits))
    if found is None:
        return asked.select("item_id", F.lit(0).alias("rank"), F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("score")).limit(0)
    return asked.select("item_id", "q").join(found, "q").select("item_id", "rank", "doc_id", "score")


ORACLE = rf"""
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{TERM}') AS terms FROM documents),
sized AS (SELECT *, CAST(len(terms) AS BIGINT) AS n FROM docs WHERE len(terms) > 0),
whole AS (SELECT CAST(count(*) AS BIGINT) AS total, CAST(sum(n) AS BIGINT) AS words FROM sized),
items AS (SELECT row_number() OVER () AS iid, item_id, unnest(list_distinct(regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{TERM}'))) AS term FROM benchmark),
tfs AS (SELECT rid, term, CAST(count(*) AS BIGINT) AS tf FROM (SELECT rid, unnest(terms) AS term FROM sized) WHERE term IN (SELECT term FROM items) GROUP BY rid, term),
weights AS (SELECT term, CAST(floor(1000 * ln((2 * total + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS w FROM tfs, whole GROUP BY term, total),
measures AS (SELECT rid, doc_id, 10 + (90 * n * total) // words AS m FROM sized, whole),
scored AS (
  SELECT iid, any_value(item_id) AS item_id, rid, any_value(doc_id) AS doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
  FROM items JOIN weights USING (term) JOIN tfs USING (term) JOIN measures USING (rid) GROUP BY iid, rid),
ranked AS (SELECT *, row_number() OVER (PARTITION BY iid ORDER BY score DESC, doc_id NULLS LAST) AS r FROM scored WHERE score > 0)
SELECT item_id, CAST(r AS INTEGER) AS rank, doc_id, score FROM ranked WHERE r <= 10
"""
