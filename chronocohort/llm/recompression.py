"""Substring deduplication by recompression.

A text is a sequence of word names.  A recompression round replaces each maximal run of one symbol by a new name, and then each pair of a
symbol of the left class followed by one of the right class.  Names are hashes of what they stand for and classes are bits of names, so all
executors give equal substrings equal names, in the same places, without a common dictionary.  Only at the rim of a substring symbols depend
on what surrounds it.  For every symbol the span of words that decides about it is carried along; a symbol whose span lies within a window of
``WINDOW`` words is found in every copy of the window.

Each window is represented by one symbol: of those it decides, one of the highest level, the one whose span has the largest hash.  Neighbouring windows mostly
share theirs.  A window can only repeat if its symbol does, so Spark counts symbols (a few for each hundred words) and only windows whose
symbol occurs twice are hashed in full, 96 bits, and looked up: all but the first occurrence of a window repeat it.  Words in repeating windows go.

How rows move: documents belong to chunks by a hash of doc_id and text, so rows without doc_id, or with one, do not meet; only rows alike in both do.  Tasks sum up what they have of a symbol or a window before they send it to the bucket of its
hash, one record from each batch or chunk at most, and buckets answer chunks; so neither a passage that a third of all documents share nor a
huge group of copies meets in one task.  Documents of equal words are told apart first; only the first of each is searched for windows.

The order of occurrences is by doc_id (null last), then by a hash of the words, then by place.  Rows with equal doc_id and words are one document and get the same
result; rows that share a doc_id only are documents in the order of that hash.  A null text has no words.  Documents shorter than a window stay whole.  Very long texts are parsed in
overlapping slices, which gives the same symbols, as windows decide them.  Empty tables give empty results; other columns take no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronocohort.llm.base import raw_texts, shuffle_width, small_batches
from chronocohort.session import durable

WINDOW = 20
ROUNDS = 2
CHUNK_BYTES = 3 << 20  # of text that one Python call takes, about
BUCKET_BYTES = 24 << 20  # of text for each bucket of hashes
SLICE = 1 << 19  # words parsed at once
LAST = np.iinfo(np.int64).max  # in place of a null doc_id

KEY = np.dtype([("key", "<u8"), ("chunk", "<i4")])
FIRST = np.dtype([("a", "<u8"), ("b", "<u4"), ("doc", "<i8"), ("chunk", "<i4")])
#: A window as FIRST, with the hash of its document's words, which tells documents of one doc_id apart.
SEEN = np.dtype([("a", "<u8"), ("b", "<u4"), ("doc", "<i8"), ("words", "<u8"), ("chunk", "<i4")])
HASH = np.dtype([("a", "<u8"), ("b", "<u4")])
COPY = np.dtype([("a", "<u8"), ("doc", "<i8")])
#: Kinds of messages.  To buckets: symbols, documents, windows; to chunks: repeated symbols, later copies, repeated windows.
SYMBOLS, DOCUMENTS, WINDOWS, REPEATED, COPIES, LATER = range(6)
MESSAGE = "kind int, dest long, payload binary"

_ODD = np.array([0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93], np.uint64)
_BACK = np.array([pow(int(x), -1, 1 << 64) for x in _ODD], np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words:
    """Words of several documents in a row: names, and hashes of any span of them."""

    def __init__(self, documents: list[list[bytes]]):
        self.length = np.fromiter(map(len, documents), np.int64, len(documents))
        self.stop = np.cumsum(self.length)
        self.start = self.stop - self.length
        digest = xxhash.xxh3_128_digest
        self.name = np.frombuffer(b"".join([digest(w) for d in documents for w in d]), ">u8").reshape(-1, 2).astype(np.uint64)
        self.doc = np.repeat(np.arange(len(documents)), self.length)
        n = len(self.name)
        self.sums, self.back = [], []
        for k in range(2):
            power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, _ODD[k])]))
            self.sums.append(np.concatenate([[np.uint64(0)], np.cumsum(self.name[:, k] * power[:n])]))
            self.back.append(np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, _BACK[k])])))

    def span(self, lo: np.ndarray, hi: np.ndarray, k: int = 0) -> np.ndarray:
        """Hash of the words lo to hi."""
        return _mix((self.sums[k][hi] - self.sums[k][lo]) * self.back[k][lo] + (hi - lo).astype(np.uint64))

    def windows(self) -> np.ndarray:
        """First words of all windows."""
        at = np.arange(len(self.name))
        return at[at + WINDOW <= self.stop[self.doc]]

    def hashes(self, at: np.ndarray) -> np.ndarray:
        out = np.empty(len(at), HASH)
        out["a"] = self.span(at, at + WINDOW, 0)
        out["b"] = (self.span(at, at + WINDOW, 1) >> np.uint64(32)).astype(np.uint32)
        return out


def levels(words: Words) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each level, from single words up, the spans (lo, hi) that decide about its symbols.  Spans that leave the document decide nothing."""
    name, doc = words.name[:, 0], words.doc
    lo = np.arange(len(name))
    hi = lo + 1
    out = [(lo, hi)]
    outside_lo, outside_hi = words.start - 1, words.stop + 1

    def neighbour(span: np.ndarray, at: np.ndarray, of: np.ndarray, outside: np.ndarray) -> np.ndarray:
        inside = (at >= 0) & (at < len(doc))
        inside &= doc[np.where(inside, at, 0)] == of
        return np.where(inside, span[np.where(inside, at, 0)], outside[of])

    for _ in range(ROUNDS if len(name) else 0):
        # Runs.  That a run ends is decided by the symbols next to it.
        at = np.flatnonzero(np.r_[True, (name[1:] != name[:-1]) | (doc[1:] != doc[:-1])])
        length = np.diff(np.r_[at, len(name)])
        d = doc[at]
        lo, hi = neighbour(lo, at - 1, d, outside_lo), neighbour(hi, at + length, d, outside_hi)
        name = np.where(length > 1, _mix(name[at] + _mix(length.astype(np.uint64))), name[at])
        doc = d
        # Pairs.  A pair is decided by itself; that a symbol stays single, by the one it could have joined.
        left = (_mix(name) & np.uint64(1)).astype(bool)
        joins = np.zeros(len(name), bool)
        joins[:-1] = left[:-1] & ~left[1:] & (doc[1:] == doc[:-1])
        joined = np.r_[False, joins[:-1]]
        i = np.arange(len(name))
        after = neighbour(hi, i + 1, doc, outside_hi)
        before = neighbour(lo, i - 1, doc, outside_lo)
        hi = np.where(left, after, hi)
        lo = np.where(~left & ~joined, before, lo)
        name = np.where(joins, _mix(name * np.uint64(3) + _mix(np.r_[name[1:], name[:1]])), name)
        name, doc, lo, hi = (x[~joined] for x in (name, doc, lo, hi))
        out.append((lo, hi))
    return out


def symbols(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each window: its first word, the hash of its symbol, the symbol's place, and whether the window holds that symbol twice."""
    n = len(words.name)
    valid = np.zeros(n + 1, bool)
    valid[words.windows()] = True
    best, place, twice = np.zeros(n + 1, np.uint64), np.zeros(n + 1, np.int64), np.zeros(n + 1, bool)
    for level, (lo, hi) in reversed(list(enumerate(levels(words)))):
        open_ = valid & (best == 0)
        if not open_.any():
            break
        ok = (lo >= 0) & (hi <= n) & (hi - lo <= WINDOW)
        lo, hi = lo[ok], hi[ok]
        d = words.doc[lo]
        counted = np.r_[0, np.cumsum(open_)]
        ok = (lo >= words.start[d]) & (hi <= words.stop[d]) & (counted[lo + 1] > counted[np.maximum(hi - WINDOW, 0)])
        ok[1:] &= lo[1:] != lo[:-1]  # of spans with one beginning the shortest; it is in every window that the others are in
        lo, hi = lo[ok], hi[ok]
        key = _mix(words.span(lo, hi) + np.uint64(level)) | np.uint64(1)
        room = WINDOW - (hi - lo)
        for back in range(int(room.max(initial=-1)) + 1):
            some = (room >= back) & (lo >= back)
            p, k, at = lo[some] - back, key[some], lo[some]
            some = open_[p]
            p, k, at = p[some], k[some], at[some]
            now = best[p]
            twice[p[now == k]] = True
            more = k > now
            p, k, at = p[more], k[more], at[more]
            best[p], place[p], twice[p] = k, at, False
    at = np.flatnonzero(valid)
    return at, best[at], place[at], twice[at]


def slices(documents: list[list[bytes]]) -> Iterator[tuple[np.ndarray, np.ndarray, Words]]:
    """(document, first word there, words) of pieces that hold every window once, each of about SLICE words."""
    held: list[tuple[int, int, list[bytes]]] = []
    n = 0
    for d, words in enumerate(documents):
        for at in range(0, max(1, len(words) - WINDOW + 1), SLICE):
            piece = words[at : at + SLICE + WINDOW - 1]
            if held and n + len(piece) > SLICE:
                yield _piece(held)
                held, n = [], 0
            held.append((d, at, piece))
            n += len(piece)
    if held:
        yield _piece(held)


def _piece(held):
    return np.array([h[0] for h in held]), np.array([h[1] for h in held]), Words([h[2] for h in held])


def _messages(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    kind, dest, payload = zip(*rows) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(kind, pa.int32()), pa.array(dest, pa.int64()), pa.array(payload, pa.binary())], names=["kind", "dest", "payload"])


def _dealt(kind: int, dest: np.ndarray, records: np.ndarray) -> list[tuple[int, int, bytes]]:
    """A message for each destination."""
    order = np.argsort(dest, kind="stable")
    dest, records = dest[order], records[order]
    cuts = np.flatnonzero(np.r_[True, dest[1:] != dest[:-1]]) if len(dest) else []
    ends = [*cuts[1:], len(dest)] if len(dest) else []
    return [(kind, int(dest[a]), records[a:b].tobytes()) for a, b in zip(cuts, ends)]


def _once(records: np.ndarray) -> np.ndarray:
    """Distinct records in the order of their fields."""
    names = records.dtype.names
    r = records[np.lexsort([records[x] for x in reversed(names)])]
    if not len(r):
        return r
    return r[np.r_[True, np.logical_or.reduce([r[x][1:] != r[x][:-1] for x in names])]]


def _among(records: np.ndarray, held: np.ndarray) -> np.ndarray:
    """Whether each record is one of ``held``, distinct records in order of their two fields."""
    out = np.zeros(len(records), bool)
    if not len(held):
        return out
    first, second = held.dtype.names
    begin, end = np.searchsorted(held[first], records[first]), np.searchsorted(held[first], records[first], "right")
    step = 0
    while len(live := np.flatnonzero(begin + step < end)):
        out[live] |= held[second][begin[live] + step] == records[second][live]
        step += 1
    return out


def _order(records: np.ndarray) -> np.ndarray:
    """By hash, then by document."""
    within = [records["words"]] if "words" in records.dtype.names else []
    return np.lexsort([*within, records["doc"], records["b"], records["a"]])


def _firsts(records: np.ndarray) -> np.ndarray:
    """Whether a record is of the first document of its hash; of equal ones the first counts."""
    order = _order(records)
    r = records[order]
    new = np.r_[True, (r["a"][1:] != r["a"][:-1]) | (r["b"][1:] != r["b"][:-1])] if len(r) else np.zeros(0, bool)
    out = np.zeros(len(r), bool)
    out[order[new]] = True
    return out


def _later(records: np.ndarray) -> np.ndarray:
    """Whether the hash of a record has one of a smaller document."""
    order = _order(records)
    r = records[order]
    new = np.r_[True, (r["a"][1:] != r["a"][:-1]) | (r["b"][1:] != r["b"][:-1])] if len(r) else np.zeros(0, bool)
    first = np.maximum.accumulate(np.where(new, np.arange(len(r)), 0)) if len(r) else np.zeros(0, np.int64)
    out = np.zeros(len(r), bool)
    later = r["doc"] > r["doc"][first]
    if "words" in r.dtype.names:
        later |= (r["doc"] == r["doc"][first]) & (r["words"] > r["words"][first])
    out[order[later]] = True
    return out


def _own(records: np.ndarray, later: np.ndarray) -> np.ndarray:
    """Whether a record is of the first document of its hash, and the first of that in its chunk."""
    at = np.flatnonzero(~later)
    r = records[at]
    order = np.lexsort((r["chunk"], r["b"], r["a"]))
    s = r[order]
    new = np.logical_or.reduce([s[x][1:] != s[x][:-1] for x in ("a", "b", "chunk")]) if len(s) else np.zeros(0, bool)
    out = np.zeros(len(records), bool)
    out[at[order[np.r_[True, new] if len(s) else new]]] = True
    return out


def _digest(documents: list[list[bytes]]) -> np.ndarray:
    raw = np.frombuffer(b"".join(xxhash.xxh3_128_digest(b" ".join(d)) for d in documents), ">u8").reshape(-1, 2).astype(np.uint64)
    out = np.empty(len(raw), HASH)
    out["a"], out["b"] = raw[:, 0], (raw[:, 1] >> np.uint64(32)).astype(np.uint32)
    return out


def _ids(column) -> np.ndarray:
    return column.fill_null(LAST).to_numpy(zero_copy_only=False) if isinstance(column, pa.Array) else column.combine_chunks().fill_null(LAST).to_numpy(zero_copy_only=False)


def _announce(buckets: int):
    """Documents in, messages out: to buckets what each batch has of symbols and documents, to chunks what the batch can tell by itself."""

    def held(ids: np.ndarray, chunks: np.ndarray, documents: list[list[bytes]]) -> list[tuple[int, int, bytes]]:
        full = [i for i, d in enumerate(documents) if len(d) >= WINDOW]
        ids, chunks, documents = ids[full], chunks[full], [documents[i] for i in full]
        record = np.empty(len(documents), FIRST)
        record[["a", "b"]] = _digest(documents) if documents else np.empty(0, HASH)
        record["doc"], record["chunk"] = ids, chunks
        later = _later(record)
        first = _own(record, later)
        rows = _dealt(DOCUMENTS, (record["a"][first] % np.uint64(buckets)).astype(np.int64), record[first])
        rows += _dealt(COPIES, chunks[later].astype(np.int64), record[later][["a", "doc"]].astype(COPY))
        documents, chunks = [documents[i] for i in np.flatnonzero(first)], chunks[first]
        found = []
        for of, _, words in slices(documents):
            at, key, place, twice = symbols(words)
            if not len(at):
                continue
            new = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (place[1:] != place[:-1])])
            order = new[np.lexsort((place[new], key[new]))]
            k, p = key[order], place[order]
            order = order[np.r_[True, (k[1:] != k[:-1]) | (p[1:] != p[:-1])]]
            seen = np.empty(len(order), KEY)
            seen["key"], seen["chunk"] = key[order], chunks[of[words.doc[at[order]]]]
            often = np.empty(int(twice.sum()), KEY)
            often["key"], often["chunk"] = key[twice], chunks[of[words.doc[at[twice]]]]
            found += [seen, often, often]
        if found:
            all_ = np.concatenate(found)
            all_ = all_[np.lexsort((all_["chunk"], all_["key"]))]
            new = np.r_[True, all_["key"][1:] != all_["key"][:-1]]
            times = np.diff(np.r_[np.flatnonzero(new), len(all_)])
            often = np.repeat(times > 1, times)
            known = _once(all_[often])
            rows += _dealt(REPEATED, known["chunk"].astype(np.int64), known["key"])
            ask = all_[new].copy()
            ask["chunk"][times > 1] = -1  # answered already
            rows += _dealt(SYMBOLS, ((ask["key"] >> np.uint64(1)) % np.uint64(buckets)).astype(np.int64), ask)
        return rows

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, chunks, documents, size = [], [], [], 0
        for batch in stream:
            own, at = _ids(batch.column(0)), batch.column(1).to_numpy(zero_copy_only=False)
            for i, text in enumerate(raw_texts(batch.column(2))):
                ids.append(own[i])
                chunks.append(at[i])
                documents.append(text.split())
                size += len(text)
                if size >= CHUNK_BYTES:
                    yield _messages(held(np.array(ids, np.int64), np.array(chunks, np.int32), documents))
                    ids, chunks, documents, size = [], [], [], 0
        if documents:
            yield _messages(held(np.array(ids, np.int64), np.array(chunks, np.int32), documents))

    return run


def _answer(group: pa.Table) -> pa.Table:
    """All messages to one bucket in, its answers to chunks out; messages to a chunk pass, each content once."""
    kind, dest = group["kind"][0].as_py(), group["dest"][0].as_py()
    data = b"".join(x.as_py() for x in group["payload"])
    if kind == SYMBOLS:
        asked = np.frombuffer(data, KEY)
        asked = asked[np.argsort(asked["key"], kind="stable")]
        start = np.flatnonzero(np.r_[True, asked["key"][1:] != asked["key"][:-1]])
        times = np.diff(np.r_[start, len(asked)])
        often = (times > 1) | (np.minimum.reduceat(asked["chunk"], start) < 0)
        told = _once(asked[np.repeat(often, times) & (asked["chunk"] >= 0)])
        rows = _dealt(REPEATED, told["chunk"].astype(np.int64), told["key"])
    elif kind in (DOCUMENTS, WINDOWS):
        asked = np.frombuffer(data, FIRST if kind == DOCUMENTS else SEEN)
        told = asked[_later(asked)]
        if kind == DOCUMENTS:
            rows = _dealt(COPIES, told["chunk"].astype(np.int64), told[["a", "doc"]].astype(COPY))
        else:
            rows = _dealt(LATER, told["chunk"].astype(np.int64), told[["a", "b"]].astype(HASH))
    else:
        held = np.unique(np.frombuffer(data, "<u8")) if kind == REPEATED else _once(np.frombuffer(data, COPY))
        rows = [(kind, dest, held.tobytes())]
    return pa.Table.from_batches([_messages(rows)])


def _mail(table: pa.Table, kind: int, dtype) -> np.ndarray:
    return np.frombuffer(b"".join(p.as_py() for k, p in zip(table["kind"].to_pylist(), table["payload"]) if k == kind), dtype)


def _chunk(left: pa.Table) -> tuple[np.ndarray, np.ndarray, list[list[bytes]], np.ndarray]:
    """doc_ids, hashes of the words and words of the documents of a chunk, in order and each once; and which of them each row is."""
    ids = _ids(left["doc_id"])
    texts = [x for part in left["text"].chunks for x in raw_texts(part)]
    keys = [(int(i), b" ".join(t.split())) for i, t in zip(ids, texts)]
    hashed = {k: int.from_bytes(xxhash.xxh3_128_digest(k[1])[:8], "big") for k in set(keys)}  # as _digest gives it
    order = sorted(hashed, key=lambda k: (k[0], hashed[k], k[1]))
    number = {k: i for i, k in enumerate(order)}
    return np.array([k[0] for k in order], np.int64), np.array([hashed[k] for k in order], np.uint64), [k[1].split() for k in order], np.array([number[k] for k in keys], np.int64)


def _copies(ids: np.ndarray, hashed: np.ndarray, table: pa.Table) -> np.ndarray:
    """Which documents of a chunk are copies of earlier ones."""
    own = np.empty(len(ids), COPY)
    own["a"], own["doc"] = hashed, ids
    return _among(own, _once(_mail(table, COPIES, COPY)))


def _look_up(buckets: int):
    """A chunk's documents and the symbols known to repeat in, messages about windows to buckets out."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        rows: list[tuple[int, int, bytes]] = []
        if left.num_rows:
            chunk = left["chunk"][0].as_py()
            ids, hashed, documents, _ = _chunk(left)
            repeated = np.unique(_mail(right, REPEATED, "<u8"))
            search = np.flatnonzero(~_copies(ids, hashed, right))
            found = []
            for of, _, words in slices([documents[i] for i in search]):
                at, key, _, twice = symbols(words)
                if not len(at):
                    continue
                if len(repeated):
                    twice |= repeated[np.minimum(np.searchsorted(repeated, key), len(repeated) - 1)] == key
                at = at[twice]
                record = np.empty(len(at), SEEN)
                record[["a", "b"]] = words.hashes(at)
                doc = search[of[words.doc[at]]]
                record["doc"], record["words"], record["chunk"] = ids[doc], hashed[doc], chunk
                found.append(record[_firsts(record)])
            if found:
                record = np.concatenate(found)
                record = record[_firsts(record)]
                rows = _dealt(WINDOWS, ((record["a"] >> np.uint64(7)) % np.uint64(buckets)).astype(np.int64), record)
        return pa.Table.from_batches([_messages(rows)])

    return run


def _strike(left: pa.Table, right: pa.Table) -> pa.Table:
    """A chunk's documents and the answers about its windows in, documents without repeating words out."""
    out = {"doc_id": pa.array([], pa.int64()), "n_words": pa.array([], pa.int64()), "n_removed": pa.array([], pa.int64()), "kept": pa.array([], pa.string())}
    if left.num_rows:
        ids, hashed, documents, row = _chunk(left)
        copies, later = _copies(ids, hashed, right), _once(_mail(right, LATER, HASH))
        gone = [np.full(len(d), c and len(d) >= WINDOW) for d, c in zip(documents, copies.tolist())]
        search = np.flatnonzero(~copies)
        hashes, of_window, first_word = [], [], []
        for of, begin, words in slices([documents[i] for i in search]):
            at = words.windows()
            hashes.append(words.hashes(at))
            of_window.append(search[of[words.doc[at]]])
            first_word.append(at - words.start[words.doc[at]] + begin[words.doc[at]])
        if hashes:
            h, d, w = np.concatenate(hashes), np.concatenate(of_window), np.concatenate(first_word)
            order = np.lexsort((h["b"], h["a"]))  # stable: in the order of documents and words
            s = h[order]
            repeats = np.zeros(len(h), bool)
            repeats[order[1:]] = (s["a"][1:] == s["a"][:-1]) & (s["b"][1:] == s["b"][:-1])
            repeats |= _among(h, later)
            hit = np.unique(d[repeats])
            for i, begin, end in zip(hit, np.searchsorted(d, hit), np.searchsorted(d, hit, "right")):
                firsts = w[begin:end][repeats[begin:end]]
                steps = np.bincount(firsts, minlength=len(documents[i]) + 1) - np.bincount(firsts + WINDOW, minlength=len(documents[i]) + 1)
                gone[i] = np.cumsum(steps)[:-1] > 0
        kept = [b" ".join(x for x, g in zip(doc, off.tolist()) if not g).decode("utf-8", "replace") for doc, off in zip(documents, gone)]
        out = {"doc_id": left["doc_id"], "n_words": pa.array([len(documents[i]) for i in row], pa.int64()), "n_removed": pa.array([int(gone[i].sum()) for i in row], pa.int64()), "kept": pa.array([kept[i] for i in row], pa.string())}
    return pa.table(out)


def deduplicate(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) without repeating words: doc_id, n_words, n_removed, kept (the words that stay, joined by a blank)."""
    spark = docs.sparkSession
    small_batches(spark)
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    chunks, buckets = max(shuffle_width(spark), size // CHUNK_BYTES), max(shuffle_width(spark), size // BUCKET_BYTES)
    placed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks)).cast("int").alias("chunk"), F.col("text").cast("string").alias("text"))
    told = durable(placed.mapInArrow(_announce(buckets), MESSAGE).groupBy("kind", "dest").applyInArrow(_answer, MESSAGE))
    grouped = placed.groupBy("chunk")

    def to_chunks(messages: DataFrame):
        return messages.select(F.col("dest").cast("int").alias("chunk"), "kind", "payload").groupBy("chunk")

    windows = grouped.cogroup(to_chunks(told)).applyInArrow(_look_up(buckets), MESSAGE)
    answers = durable(windows.groupBy("kind", "dest").applyInArrow(_answer, MESSAGE))
    mail = to_chunks(answers.unionByName(told.where(F.col("kind") == COPIES)))
    return grouped.cogroup(mail).applyInArrow(_strike, "doc_id long, n_words long, n_removed long, kept string")
