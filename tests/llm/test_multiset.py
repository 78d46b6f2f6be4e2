import hashlib
import random

import numpy as np

from chronocohort.llm import multiset as M


def brute(rows):
    """Every fingerprint from its whole text; rows in order of doc_id, no ties."""
    rows = sorted(((d, t or "") for d, t in rows), key=lambda r: (r[0] is not None, r[0] or 0))
    out = []
    for i, (d, t) in enumerate(rows):
        after = rows[(i + 1) % len(rows)][1]
        half = len(t) // 2
        new = t[: len(t) - half] + after[:half]
        a, b, c = (M.unpacked(M.fingerprint(x)) for x in (t, new, after))
        out.append((d, len(t), hashlib.sha256(new.encode()).hexdigest(), M.fingerprint(t), M.fingerprint(new), M.likeness(a, b), M.likeness(a, c)))
    return out


def texts(rng, n):
    sentence = lambda: " ".join(rng.choice(["ab", "cé", "def", "𝒳y", "zz"]) for _ in range(rng.randint(3, 9))) + rng.choice(". ! ? 。".split())
    return ["\n".join(" ".join(sentence() for _ in range(rng.randint(0, 4))) for _ in range(rng.randint(1, 9))) for _ in range(n)]


def run(spark, rows, parts=5):
    return [tuple(r) for r in M.edited(spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)).collect()]


def test_against_brute_force(spark):
    rng = random.Random(4)
    rows = list(zip(rng.sample(range(10_000), 400), texts(rng, 400))) + [(-7, None), (20_000, ""), (20_001, "\n\n"), (None, "x. y."), (20_002, "a" * 30_000 + "\n" + "Same line.\n" * 40_000)]
    for parts in (1, 7):
        got = run(spark, rows, parts)
        assert sorted(got, key=lambda r: (r[0] is not None, r[0] or 0)) == brute(rows)


def test_single_and_empty(spark):
    assert run(spark, [(5, "One. Two.\nThree. Four.")]) == brute([(5, "One. Two.\nThree. Four.")])
    assert run(spark, []) == []


def test_hot_ids_and_repeated_rows(spark):
    rng = random.Random(6)
    rows = [(1, t) for t in texts(rng, 60)] + [(2, "same. text.\nhere.")] * 300 + [(None, t) for t in texts(rng, 40)] + [(None, None)] * 5
    got, again = run(spark, rows, 3), run(spark, rows, 11)
    assert len(got) == len(rows) and sorted(got, key=str) == sorted(again, key=str)  # whatever the layout
    same = [r for r in got if r[0] == 2]
    assert sum(r[6] == 1.0 for r in same) == 299 and len({r[3] for r in same}) == 1


def test_order_does_not_count_and_paragraphs_come_and_go():
    rng = random.Random(8)
    for text in texts(rng, 50):
        p = text.split("\n")
        shuffled = rng.sample(p, len(p))
        assert M.fingerprint("\n".join(shuffled)) == M.fingerprint(text)
        assert M.changed(M.fingerprint(text), insert=["new one."], delete=[p[0]]) == M.fingerprint("\n".join(p[1:] + ["new one."]))
        assert M.fingerprint(text + "\n") != M.fingerprint(text) != M.fingerprint(text + " ")
    assert M.fingerprint(None) == M.fingerprint("") != M.fingerprint("\n")


def test_likeness_estimates_shared_sentences():
    rng = random.Random(9)
    for n, shared in ((40, 0), (40, 10), (200, 100), (200, 180), (50, 50)):
        a = [f"sentence {rng.random()}." for _ in range(n)]
        b = a[:shared] + [f"other {rng.random()}." for _ in range(n - shared)]
        near = M.likeness(M.vector(a), M.vector(rng.sample(b, n)))
        assert abs(near - shared / n) < 0.2 and (shared < n or near == 1.0)
    assert M.likeness(M.vector([""]), M.vector([""])) == 1.0 and M.likeness(M.vector([""]), M.vector(["", ""])) == 0.0
    many = M.vector(["Same."] * 50_000)
    assert M.likeness(many, many) == 1.0 and np.abs(many[1].view(np.int32)).max() == 50_000


def test_extra_columns(spark):
    rows = spark.createDataFrame([(1, "a. b.", 1, 2, "x"), (2, "c.", 1, 2, "x")], "doc_id int, text string, p int, u int, ghost string")
    assert sorted(r.doc_id for r in M.edited(rows).collect()) == [1, 2]
