import random

import numpy as np
import xxhash

from chronocohort.llm import simhash as S


def brute_print(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    shingles = [b" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints):
    """smallest index reachable for each."""
    label = list(range(len(prints)))
    x = np.array(prints, np.uint64)
    near = [np.flatnonzero(np.bitwise_count(x ^ v) <= 4) for v in x]
    for i in range(len(x)):
        todo = [i]
        while todo:
            j = todo.pop()
            for k in near[j]:
                if label[k] > label[i]:
                    label[k] = label[i]
                    todo.append(k)
    return label


def test_fingerprints(spark):
    rng = random.Random(1)
    texts = [None, "", " \t\n", "One", "a b c", "a b c d", "É İ K é\x85x y"] + [" ".join(rng.choice(["A", "b", "cd", "é"]) for _ in range(rng.randint(1, 80))) for _ in range(60)]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string").select("i", S.fingerprints().alias("fp")).collect()
    assert {r.i: r.fp % (1 << 64) for r in got} == {i: brute_print(t) for i, t in enumerate(texts)}
    long = " ".join(rng.choice("abcdefg") for _ in range(5000))
    assert S.fingerprint(long.encode(), slice_at=100) == brute_print(long)


def test_shingles_hash_as_the_sql_function(spark):
    assert spark.sql("select xxhash64('a b c d')").first()[0] % (1 << 64) == xxhash.xxh64_intdigest(b"a b c d", 42)


def flipped(rng, value, n):
    for b in rng.sample(range(64), n):
        value ^= 1 << b
    return value


def test_components_against_brute_force(spark):
    rng = random.Random(7)
    prints = []
    for _ in range(60):
        base = rng.getrandbits(64)
        prints.append(base)
        for n in (3, 4, 4, 5, 6, 8):
            prints.append(flipped(rng, rng.choice(prints[-3:]), n))
    ball = rng.getrandbits(64)
    prints += [flipped(rng, ball, rng.randint(0, 3)) for _ in range(400)] + [0, 1, 15, 31]
    rng.shuffle(prints)
    rows = [(i, p - (1 << 64) if p >> 63 else p) for i, p in enumerate(prints)]
    got = {r.doc_id: r.component_id for r in S.near_duplicates(spark.createDataFrame(rows, "doc_id long, fp long")).collect()}
    assert [got[i] for i in range(len(prints))] == brute_components(prints)


def test_every_link_meets(spark):
    """The runs of single variants, small and long, keep exactly what all links connect."""
    rng = np.random.default_rng(2)
    fps = np.unique((rng.integers(0, 1 << 20, 3000) & rng.integers(0, 1 << 20, 3000)).astype(np.int64))
    u, v = S.links(np.zeros(len(fps), np.int32), fps)
    small = S.links(np.zeros(len(fps), np.int32), fps, long_run=1 << 30)
    label = brute_components([int(x) for x in fps])
    root = {int(x): int(fps[label[i]]) for i, x in enumerate(fps)}
    for a, b in ((u, v), small):
        assert {int(x): int(y) for x, y in zip(*S.forest(a, b))} == {x: y for x, y in root.items() if x != y}


def test_repeated_null_and_empty(spark):
    rows = [(None, 0), (3, 0), (3, 0), (None, 1 << 40 | 0xFFFF), (9, 7)]
    got = S.near_duplicates(spark.createDataFrame(rows, "doc_id long, fp long"))
    assert sorted((r.doc_id or -1, r.component_id or -1) for r in got.collect()) == [(-1, -1), (-1, 3), (3, 3), (3, 3), (9, 3)]
    assert sorted((r.doc_id or -1, r.fp) for r in S.survivors(got).collect()) == [(-1, 1 << 40 | 0xFFFF), (3, 0)]
    assert S.near_duplicates(spark.createDataFrame([], "doc_id long, fp long")).count() == 0
    assert S.near_duplicates(spark.createDataFrame([(1, None)], "doc_id long, text string").select("doc_id", S.fingerprints().alias("fp"))).first().fp == 0
