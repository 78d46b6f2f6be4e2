import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from chronocohort.llm import trie as T


def brute(rows):
    """Nodes from whole paths, sums from plain recursion over all nodes below."""
    turns = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            turns[c].append(((turn is not None, turn or 0), hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest(), (role, text)))
    own = {c: [t for *_, t in sorted(v)] for c, v in turns.items()}
    paths = {}
    for c, mine in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (abs(c) % 20 if c >= 0 else -(abs(c) % 20))
        paths[c] = tuple(own.get(base, [])[:h] + mine[h:])
    members = defaultdict(list)
    for c, p in paths.items():
        for d in range(len(p) + 1):
            members[p[:d]].append(c)
    words = lambda p: len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
    below, children = defaultdict(list), defaultdict(int)
    for p in members:
        for d in range(len(p) + 1):
            below[p[:d]].append(p)
        if p:
            children[p[:-1]] += 1
    out = []
    for p, who in members.items():
        ends = ",".join(str(c) for c in sorted(who) if len(paths[c]) == len(p))
        out.append((min(who), len(p), min(members[p[:-1]]) if p else None, len(who), children[p], sum(not children[x] for x in below[p]),
                    sum((len(members[x]) - 1) * words(x) for x in below[p]), hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def built(spark, rows, local=T.LOCAL):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)
    return sorted((tuple(r) for r in T.trie(df, local).collect()), key=str)


def talk(rng, n):
    rows = []
    for c in rng.sample(range(3 * n), n):
        for t in range(rng.randint(1, 7)):
            rows.append((c, rng.choice([t, t, t * 10 - 3]), rng.choice(["user", "assistant", None]), rng.choice(["", None, "a b", "hello  there\nyou", "x"])))
    return rows


@pytest.mark.parametrize("local", [T.LOCAL, 8])
def test_against_brute_force(spark, local):
    rng = random.Random(11)
    rows = talk(rng, 150)
    rows += [(-45, 1, "user", "neg"), (-40, 1, "user", "base"), (-40, 2, "user", "two"), (None, 1, "user", "nobody"), (7, None, None, None), (7, None, "u", "twice"), (7, None, "u", "twice")]
    rows += [(9000 + i, t, "user", f"copy {t}") for i in range(60) for t in range(4)]  # a large group of copies
    assert built(spark, rows, local) == brute(rows)


def test_one_conversation_holds_a_third(spark):
    rng = random.Random(12)
    rows = talk(rng, 40) + [(1000, t, "user", f"turn {t % 7}") for t in range(300)] + [(1003, t, "user", f"turn {t % 7}") for t in range(280)]
    assert built(spark, rows, 50) == brute(rows)


def test_turnless_and_empty(spark):
    assert built(spark, []) == [] and built(spark, [(None, 1, "a", "b")]) == []
    rows = [(c, 0, "user", "hi") for c in range(41, 60)]  # conversation 40 is absent
    assert built(spark, rows) == brute(rows) and any(r[1] == 0 and r[7] != hashlib.sha256(b"").hexdigest() for r in brute(rows))


def test_local_split_gives_subtree_sums():
    rng = random.Random(13)
    for n in (1, 2, 3, 10, 200):
        for shape in (lambda i: i - 1, lambda i: 0, lambda i: rng.randrange(i)):  # a chain, a star, any tree
            parent = [-1] + [shape(i) for i in range(1, n)]
            weights = [(rng.randint(0, 5), rng.randint(0, 9)) for _ in range(n)]
            sums = [list(w) for w in weights]
            for v in range(n - 1, 0, -1):
                sums[parent[v]] = [a + b for a, b in zip(sums[parent[v]], sums[v])]
            assert T.split(parent, weights) == [tuple(s) for s in sums]


def test_extra_columns(spark):
    rows = [(1, 0, "user", "a", 5, 6, "z"), (2, 0, "user", "b", 5, 6, "z")]
    df = spark.createDataFrame(rows, "conv_id int, turn int, role string, text string, depth int, node int, top string")
    assert sorted((r.conv_id, r.depth) for r in T.trie(df).collect()) == sorted((r[0], r[1]) for r in brute([r[:4] for r in rows]))
