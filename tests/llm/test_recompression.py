import hashlib
import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from chronocohort.llm import recompression as R


def brute(rows):
    """Windows in the order of doc_id (null last), then of a hash of the words; equal rows are one document."""
    words = [(i, tuple((t or "").encode().split())) for i, t, *_ in rows]
    seen, result = set(), {}
    for i, w in sorted(set(words), key=lambda d: (d[0] is None, d[0] or 0, xxhash.xxh3_128_digest(b" ".join(d[1])))):
        gone = [False] * len(w)
        for k in range(len(w) - 19):
            if w[k : k + 20] in seen:
                gone[k : k + 20] = [True] * 20
            seen.add(w[k : k + 20])
        result[i, w] = (len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone) if not g)).hexdigest())
    return sorted(((i is None, i), *result[i, w]) for i, w in words)


def run(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, chunk string").repartition(5)
    got = R.deduplicate(df).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256)).collect()
    return sorted(((r[0] is None, r[0]), *r[1:]) for r in got)


def corpus(seed, n):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        letters = rng.choice([["a"], ["a", "b"], list("abc"), [f"w{k}" for k in range(300)]])
        words = [rng.choice(letters) for _ in range(rng.randint(0, 150))]
        if rows and rng.random() < 0.5:
            other = (rng.choice(rows)[1] or "").split()
            at = rng.randint(0, max(0, len(other) - 10))
            words[5:5] = other[at : at + rng.randint(15, 70)]
        rows.append((rng.choice([i, i, i, i // 2]), "  ".join(words), "clash"))
    rows += [rows[3]] * 3 + [(1000 + k, rows[7][1], None) for k in range(30)] + [(None, rows[8][1], None), (None, "x " * 30, None), (2000, None, None), (2001, "", None), (2002, "short one", None), (-5, rows[9][1], None)]
    return rows


def test_against_brute_force(spark):
    rows = corpus(1, 250)
    assert run(spark, rows) == brute(rows)


def test_a_third_of_all_rows_without_doc_id(spark):
    rows = [(None if k % 3 == 0 else 7 if k % 3 == 1 else i, t, c) for k, (i, t, c) in enumerate(corpus(6, 240))]
    rows += [(None, f" {rows[0][1]}\n", None), (7, f"{rows[1][1]} ", None)]  # other white space, same words
    assert run(spark, rows) == brute(rows)


def test_long_texts_are_parsed_in_slices(spark, monkeypatch):
    rng = random.Random(4)
    passage = " ".join(f"p{k}" for k in range(120))
    rows = [(i, " ".join(f"u{rng.randrange(40)}" for _ in range(900)) + " " + passage + " " + "z " * 70, None) for i in range(8)]
    want = brute(rows)
    monkeypatch.setattr(R, "SLICE", 64)
    assert run(spark, rows) == want


def test_windows_decide_their_symbols():
    """The symbol of a window is the same whatever surrounds it."""
    rng = random.Random(2)
    for letters in ("ab", "abcdefgh", [f"w{k}" for k in range(50)]):
        inner = [rng.choice(letters).encode() for _ in range(45)]
        seen = []
        for _ in range(12):
            left, right = ([rng.choice(letters).encode() for _ in range(rng.randint(0, 30))] for _ in range(2))
            at, key, place, _ = R.symbols(R.Words([left + inner + right, inner]))
            here = (at >= len(left)) & (at + R.WINDOW <= len(left) + len(inner))
            alone = at >= len(left) + len(inner) + len(right)
            seen.append(key[here].tolist())
            assert key[alone].tolist() == seen[0]
        assert all(s == seen[0] for s in seen)


def test_high_levels_stand_for_most_windows():
    rng = np.random.default_rng(0)
    words = R.Words([[f"w{k}".encode() for k in rng.integers(0, 500, 20000)]])
    at, key, place, _ = R.symbols(words)
    assert len(np.unique(place)) < 0.25 * len(at)


def test_empty(spark):
    assert run(spark, []) == []
