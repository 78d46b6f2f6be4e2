import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from chronocohort.llm import lexical as L

TERM = re.compile(L.TERM)


def plain(text):
    return ["".join(c.lower() if "A" <= c <= "Z" else c for c in t) for t in TERM.findall(text or "")]


def brute(docs, items, k=10):
    """(item_id, rank, doc_id, score) with plain loops over all documents."""
    counts = [(d, Counter(plain(t))) for d, t in docs]
    counts = [(d, c) for d, c in counts if c]
    total, words = len(counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item, text in items:
        found = []
        for d, c in counts:
            m = 10 + 90 * sum(c.values()) * total // words
            score = sum(math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in set(plain(text)) if c[t])
            if score > 0:
                found.append((-score, d is None, d or 0))
        out += [(item, r, None if no else d, -s) for r, (s, no, d) in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=str)


def searched(spark, docs, items, k=10):
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    return sorted((tuple(r) for r in L.search(d, spark.createDataFrame(items, "item_id long, text string"), k).collect()), key=str)


def corpus(rng, n):
    words = [f"w{i}" for i in range(60)] + ["É", "é", "naïve", "x1"]
    weights = [1 / (i + 1) for i in range(len(words))]
    return [(i, " ".join(rng.choices(words, weights, k=rng.randint(1, 40)))) for i in range(n)]


@pytest.mark.parametrize("cells", [1 << 22, 6400])
def test_against_brute_force(spark, monkeypatch, cells):
    rng = random.Random(3)
    docs = corpus(rng, 700)
    docs += [(700 + i, docs[5][1]) for i in range(200)]  # a large group of copies
    docs += [(None, "W3 w40 É"), (None, docs[6][1]), (3, docs[3][1]), (901, None), (902, ""), (903, "?! --"), (904, "w1 " * 40_000)]
    items = [(i, docs[i * 3][1]) for i in range(25)] + [(25, None), (26, "..."), (27, "W1,w2;É"), (27, "unheard of"), (0, docs[0][1]), (None, "w9 x1")]
    monkeypatch.setattr(L, "CELLS", cells)
    monkeypatch.setattr(L, "BLOCK_TERMS", 1 << 14 if cells > 6400 else 40)
    monkeypatch.setattr(L, "PIECE", 1000)
    assert searched(spark, docs, items) == brute(docs, items)


def test_empty_tables_and_clashing_columns(spark):
    assert searched(spark, [], [(1, "a")]) == [] and searched(spark, [(1, "a")], []) == []
    assert searched(spark, [(1, "a b")], [(1, "c")]) == []
    docs = spark.createDataFrame([(1, "a b", 5, 6, 7, "q"), (2, "b", 5, 6, 7, "q")], "doc_id int, text string, n int, rank int, score int, q string")
    items = spark.createDataFrame([(9, "A", 1, 2)], "item_id int, text string, doc_id int, part int")
    assert [tuple(r)[:3] for r in L.search(docs, items).collect()] == [(9, 1, 1)]


def test_term_cuts_agree(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choice("aZ09 _-.\x7f\x00é 𝒳\n\t'") for _ in range(50)) for _ in range(200)]
    got = [r.t for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string").orderBy("i").select(L.terms_of("text").alias("t")).collect()]
    assert got == [plain(t) for t in texts]
    assert [[w.decode() for p in L.pieces(t.encode()) for w in p] for t in texts] == got


def test_bounds_hold_and_paths_are_shared():
    rng = np.random.default_rng(1)
    tf = (rng.random((600, 40)) < np.linspace(0.9, 0.05, 40)) * rng.integers(1, 9, (600, 40))
    tree = L.Tree(tf.astype(np.uint32), rng.integers(10, 400, 600), list(range(600)))
    assert len(tree.runs) > 20
    for (lo, hi), most, least, kids in zip(tree.runs, tree.most, tree.least, tree.children):
        assert (tree.tf[lo:hi].max(0) == most).all() and tree.m[lo:hi].min() == least
        if kids:  # children are parted where the fewest leading terms are shared
            assert [tree.runs[kids[0]][0], tree.runs[kids[1] - 1][1]] == [lo, hi]
    paths = [tuple(np.flatnonzero(r)) for r in tree.tf]
    first = [p[0] if p else None for p in paths]
    assert all(first[i] == first[i - 1] or first[i] not in first[:i] for i in range(1, 600))  # documents with one first term stand together


def test_search_prunes():
    rng = np.random.default_rng(2)
    tf = (rng.random((2000, 30)) < 0.3) * rng.integers(1, 3, (2000, 30))
    tf[:, 29] = 0
    tf[:12, 29] = 9  # a rare term
    tree = L.Tree(tf.astype(np.uint32), np.full(2000, 100), list(range(2000)))
    seen = []
    plain_scores = L.scores
    try:
        L.scores = lambda w, t, m: seen.append(len(t)) or plain_scores(w, t, m)
        got = tree.search(np.array([29, 3]), np.array([5000, 10]), [], 10)
    finally:
        L.scores = plain_scores
    assert {d for _, _, d in got} <= set(range(12)) and sum(seen) < 1500
