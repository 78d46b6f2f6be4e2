"""Byte-level BPE, encoded by speculation and verification, and decoding.

A text is cut into words by the tokenizer's pattern.  For each distinct word a greedy longest match proposes tokens.  A token sequence is the
BPE encoding exactly if every token encodes to itself and every adjacent pair is compatible, that is, no merge would ever fire across their
border.  Both are tested for whole arrays of tokens and pairs at once; only words that fail are merged exactly, by rank.

Null texts count as empty; empty texts have no tokens; repeated rows are encoded alike; very long texts are taken piece by piece.  Strings
of added tokens are those tokens.  A null list of ids decodes to the empty text, ids outside the vocabulary are left out.
"""

from __future__ import annotations

import heapq
import json
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, islice

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from chronocohort.llm.base import small_batches

#: Fixed value: the pattern of byte-level BPE that splits a text into words.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

SLICE = 1 << 19  # characters of text in work at once
WORDS = 1 << 16  # words of a long text in work at once
KEPT = 1 << 16  # distinct words in each half of the memory


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in the vocabulary: printable bytes for themselves, the others from U+0100 on in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class Pieces:
    """The bytes of each token of a tokenizer file in JSON; enough to decode."""

    def __init__(self, source: str):
        spec = json.loads(source)
        pre = spec["pre_tokenizer"]
        if spec["model"]["type"] != "BPE" or spec.get("normalizer") or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or spec["model"].get("ignore_merges"):
            raise ValueError("only byte-level BPE without normalizer and prefix space is supported")
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
            raise ValueError("added tokens that take in their surroundings are not supported")
        self.spec, letter = spec, byte_letters()
        self.ids = {bytes(map(letter.__getitem__, t)): i for t, i in spec["model"]["vocab"].items()}
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.size = 1 + max([*self.ids.values(), *self.added.values()])
        flat = {i: b for b, i in self.ids.items()} | {i: c.encode() for c, i in self.added.items()}
        pieces = [flat.get(i, b"") for i in range(self.size)]
        self.length = np.array([len(p) for p in pieces], np.int64)
        self.start = np.cumsum(self.length) - self.length
        self.bytes = np.frombuffer(b"".join(pieces), np.uint8)

    def decode(self, ids: np.ndarray, step: int = 1 << 18) -> str:
        parts = []
        ids = ids[(ids >= 0) & (ids < self.size)]
        for at in range(0, len(ids), step):
            some = ids[at : at + step]
            length = self.length[some]
            ends = np.cumsum(length)
            parts.append(self.bytes[np.repeat(self.start[some] - ends + length, length) + np.arange(ends[-1])].tobytes())
        return b"".join(parts).decode("utf-8", "replace")


class Vocabulary(Pieces):
    """Tokens and merges of a tokenizer file in JSON."""

    def __init__(self, source: str):
        super().__init__(source)
        spec = self.spec
        self.longest = ahocorasick.Automaton()
        for t, i in self.ids.items():
            self.longest.add_word(t.decode("latin-1"), i)
        self.longest.make_automaton()
        known = spec["model"]["vocab"]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        left = np.array([known[a] for a, _ in pairs], np.int64)
        right = np.array([known[b] for _, b in pairs], np.int64)
        made = np.array([known[a + b] for a, b in pairs], np.int64)
        self.made = made.tolist()
        self.ranks = {k: r for r, k in enumerate((left * self.size + right).tolist())}
        self.single = [self.ids[bytes([b])] for b in range(256)]
        self.first = [self.ranks.get(a * self.size + b, len(self.made)) for a in self.single for b in self.single]  # ranks of all pairs of bytes
        self.rank = np.full(self.size, -1)  # of the merge that makes a token; base tokens have none
        self.left, self.right = np.full(self.size, -1), np.full(self.size, -1)
        self.rank[made], self.left[made], self.right[made] = np.arange(len(made)), left, right
        order = np.argsort(left * self.size + right)
        self.keys, self.key_rank = (left * self.size + right)[order], order
        # The test of pairs needs merges to come after those that make their parts.
        self.ordered = bool((self.rank[left] < np.arange(len(made))).all() and (self.rank[right] < np.arange(len(made))).all() and len(np.unique(made)) == len(made))
        self.sound = self._sound(made, left, right)

    def _rank_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of the merge of each pair; beyond all ranks where there is none."""
        key = a * self.size + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.key_rank[at], len(self.keys)) if len(self.keys) else np.full(len(key), 1)

    def compatible(self, a: np.ndarray, b: np.ndarray, before: np.ndarray | int | None = None) -> np.ndarray:
        """For each pair of tokens whether no merge of rank below ``before`` fires across the border.

        Go back in time: of the two pieces at the border, the one that was made last is replaced by its part next to the border.  At each
        moment, a merge of both pieces must not come before either is built into its own next piece; the left one wins ties.
        """
        none = len(self.keys)
        a, b = a.copy(), b.copy()
        until_a = np.full(len(a), none) if before is None else np.broadcast_to(before, a.shape).copy()
        until_b = until_a - 1 if before is not None else until_a.copy()
        ok, live = np.ones(len(a), bool), np.arange(len(a))
        while len(live):
            x, y = a[live], b[live]
            r = self._rank_of(x, y)
            clash = (r < none) & (r < until_a[live]) & (r <= until_b[live])
            ok[live[clash]] = False
            rx, ry = self.rank[x], self.rank[y]
            on = ~clash & ((rx >= 0) | (ry >= 0))
            go_a, go_b = on & (rx > ry), on & (rx <= ry)
            i, j = live[go_a], live[go_b]
            until_a[i], a[i] = rx[go_a], self.right[x[go_a]]
            until_b[j], b[j] = ry[go_b], self.left[y[go_b]]
            live = live[on]
        return ok

    def _sound(self, made: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Tokens that encode to themselves: both parts do, and nothing fires across the parts before they merge."""
        sound = np.zeros(self.size, bool)
        sound[[i for b, i in self.ids.items() if len(b) == 1]] = True
        apart = self.compatible(left, right, np.arange(len(made)))
        for t, a, b, ok in zip(made.tolist(), left.tolist(), right.tolist(), apart.tolist()):
            sound[t] = ok and sound[a] and sound[b]
        return sound

    def propose(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Greedy longest matches of all words: tokens, and the word of each.  Words are kept apart by a letter that stands for no byte."""
        found = list(self.longest.iter_long("\u0100".join([w.decode("latin-1") for w in words])))
        end, token = np.array(found, np.int64).reshape(-1, 2).T
        stops = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        return token, np.searchsorted(stops, end, "right")

    def merge(self, word: bytes) -> list[int]:
        """Exact BPE: the merge of lowest rank first, from the left."""
        if len(word) > 64:
            return self._merge_long(word)
        ranks, size, made, none, first = self.ranks.get, self.size, self.made, len(self.made), self.first
        token = list(map(self.single.__getitem__, word))
        rank = [first[a << 8 | b] for a, b in zip(word, word[1:])]
        while rank and (r := min(rank)) < none:
            i = rank.index(r)
            t = token[i] = made[r]
            del token[i + 1], rank[i]
            if i:
                rank[i - 1] = ranks(token[i - 1] * size + t, none)
            if i < len(rank):
                rank[i] = ranks(t * size + token[i + 1], none)
        return token

    def _merge_long(self, word: bytes) -> list[int]:
        """The same with a heap, for words that are long."""
        ranks, size = self.ranks, self.size
        token = [self.single[b] for b in word]
        n = len(token)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, a, b) for i, (a, b) in enumerate(zip(token, token[1:])) if (r := ranks.get(a * size + b)) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i] if token[i] == a else n
            if j >= n or token[j] != b:
                continue
            token[i], token[j], after[i] = self.made[r], -1, after[j]
            if after[i] < n:
                before[after[i]] = i
            for k in (before[i], i):
                if k >= 0 and after[k] < n and (m := ranks.get(token[k] * size + token[after[k]])) is not None:
                    heapq.heappush(heap, (m, k, token[k], token[after[k]]))
        return [t for t in token if t >= 0]

    def encode_words(self, words: list[bytes]) -> list[bytes]:
        """Propose, verify all proposals together, merge those that fail.  Ids come as int32 in bytes."""
        if not words:
            return []
        token, word = self.propose(words)
        size = np.fromiter(map(len, words), np.int64, len(words))
        bad = np.bincount(word, self.length[token], len(words)) != size
        bad |= np.bincount(word[~self.sound[token]], minlength=len(words)) > 0
        if self.ordered:
            inner = word[1:] == word[:-1]
            pair, at = np.unique(token[:-1][inner] * self.size + token[1:][inner], return_inverse=True)
            fits = self.compatible(pair // self.size, pair % self.size)
            bad |= np.bincount(word[1:][inner][~fits[at]], minlength=len(words)) > 0
        else:
            bad[:] = True
        flat = token.astype(np.int32).tobytes()
        stop = (4 * np.cumsum(np.bincount(word, minlength=len(words)))).tolist()
        return [array("i", self.merge(w)).tobytes() if f else flat[a:b] for w, f, a, b in zip(words, bad.tolist(), [0, *stop], stop)]


class Encoder:
    """Encodes in one Python worker; remembers the tokens of words it has seen."""

    def __init__(self, source: str):
        self.vocabulary = Vocabulary(source)
        self.words = regex.compile(PATTERN)
        added = sorted(self.vocabulary.added, key=len, reverse=True)
        self.added = regex.compile("|".join(map(regex.escape, added))) if added else None
        self.known: dict = {}
        self.older: dict = {}

    def cut(self, text: str) -> Iterator:
        """Words of a text; an added token comes as its id in a tuple."""
        at = 0
        for m in self.added.finditer(text) if self.added else ():
            yield from self.words.findall(text[at : m.start()])
            yield (self.vocabulary.added[m.group()],)
            at = m.end()
        if len(text) - at <= SLICE:
            yield from self.words.findall(text[at:] if at else text)
        else:
            yield from (m.group() for m in self.words.finditer(text, at))

    def learn(self, words: set) -> None:
        """Words in use move to the young half of the memory; what the old half has left is forgotten when the young one is full."""
        if len(self.known) > KEPT:
            self.known, self.older = {}, self.known
        new = words.difference(self.known)
        again = new.intersection(self.older)
        self.known.update((w, self.older[w]) for w in again)
        plain = []
        for w in new.difference(again):
            if isinstance(w, str):
                plain.append(w)
            else:
                self.known[w] = array("i", w).tobytes()
        self.known.update(zip(plain, self.vocabulary.encode_words([w.encode() for w in plain])))

    def ids(self, words: list) -> np.ndarray:
        return np.frombuffer(b"".join(map(self.known.__getitem__, words)), np.int32)

    def encode(self, texts: list[str]) -> Iterator[np.ndarray]:
        held: list[list] = []
        size = 0
        for text in texts:
            if len(text) > SLICE:
                yield from self._flush(held)
                held, size, parts, words = [], 0, [], self.cut(text)
                while some := list(islice(words, WORDS)):
                    self.learn(set(some))
                    parts.append(self.ids(some))
                yield np.concatenate(parts)
                continue
            held.append(list(self.cut(text)))
            size += len(text)
            if size > SLICE:
                yield from self._flush(held)
                held, size = [], 0
        yield from self._flush(held)

    def _flush(self, held: list[list]) -> Iterator[np.ndarray]:
        self.learn(set(chain.from_iterable(held)))
        yield from map(self.ids, held)


@lru_cache(maxsize=1)
def shared_encoder(source: str) -> Encoder:
    """One for a Python worker: later tasks find the tables built and the words of earlier ones known."""
    return Encoder(source)


@lru_cache(maxsize=1)
def shared_pieces(source: str) -> Pieces:
    return Pieces(source)


def load(spark: SparkSession, path: str) -> Broadcast:
    """The tokenizer file, read on the driver and sent to the executors; a vocabulary has a fixed size of a few MB."""
    with open(path, encoding="utf-8") as f:
        return spark.sparkContext.broadcast(f.read())


def encoder(spark: SparkSession, file: Broadcast):
    """A function of a text column that gives its token ids."""
    small_batches(spark)

    @F.arrow_udf("array<int>")
    def encode(stream: Iterator[pa.Array]) -> Iterator[pa.Array]:
        coder = shared_encoder(file.value)
        for texts in stream:
            lists = list(coder.encode([x.as_py() or "" for x in texts]))
            offsets = np.cumsum([0, *map(len, lists)])
            yield pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate([*lists, np.zeros(0, np.int32)])))

    return encode


def decoder(spark: SparkSession, file: Broadcast):
    """A function of a column of token ids that gives the text."""
    small_batches(spark)

    @F.arrow_udf("string")
    def decode(stream: Iterator[pa.Array]) -> Iterator[pa.Array]:
        pieces = shared_pieces(file.value)
        for lists in stream:
            yield pa.array([pieces.decode(x.values.drop_null().to_numpy()) if x.is_valid else "" for x in lists], pa.string())

    return decode
