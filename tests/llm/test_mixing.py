import hashlib
import random

import pytest

from chronocohort.llm import mixing as M


def brute(rows, weights=(5, 2, 1)):
    sized = [(i, s, len((t or "").encode().split()), hashlib.md5((t or "").encode()).hexdigest()) for i, t, s, *_ in rows]
    names = sorted({s for _, s, *_ in sized}, key=lambda s: (s is None, s or ""))
    total = {s: sum(n for _, x, n, _ in sized if x == s) for s in names}
    weight = {s: weights[k % 3] for k, s in enumerate(names)}
    full, target = set(), {}
    while True:
        left = 1.5 * sum(total.values()) - sum(2 * total[s] for s in full)
        open_ = [s for s in names if s not in full]
        target = {s: 2.0 * total[s] if s in full else left * weight[s] / sum(weight[x] for x in open_) for s in names}
        over = {s for s in open_ if target[s] > 2 * total[s]}
        if not over:
            break
        full |= over
    out = []
    for s in names:
        want = int(target[s] + 0.5)
        whole = want // total[s] if total[s] else 0
        budget = want - whole * total[s]
        def u(i, m):
            return (int(hashlib.md5(f"0:{'' if i is None else i}:{m}".encode()).hexdigest()[:13], 16) + 0.5) / (1 << 52)
        for i, n, m in sorted(((i, n, m) for i, x, n, m in sized if x == s), key=lambda d: (u(d[0], d[2]), d[0] is not None, d[0] or 0, d[2])):
            extra = max(0, min(n, budget))
            budget -= extra
            out.append((i, s, n, total[s], target[s], whole * n + extra))
    return out


def rows_of(n, seed):
    rng = random.Random(seed)
    rows = [(i, rng.choice([None, "", " \n"]) if i % 17 == 0 else " ".join("w" * rng.randint(1, 4) for _ in range(rng.choice([1, 5, 60, 400]))), rng.choice(["a"] * 8 + ["b", "c", "é", None, "d"]), 7) for i in range(n)]
    return rows + [(5, "x y z", "a", 1), (5, "x y z", "a", 1), (None, "p q", "b", 2), (3, None, "empty", 0)]


def run(spark, rows):
    sized = M.sizes(spark.createDataFrame(rows, "doc_id long, text string, source string, size int"))
    return M.mix(sized).collect()


@pytest.mark.parametrize("n", [5, 60, 700])
def test_against_brute_force(spark, n):
    rows = rows_of(n, n)
    got = [(r.doc_id, r.source, r.size, r.source_size, r.target, r.taken) for r in run(spark, rows)]
    order = lambda r: (r[0] is None, r[0] or 0, r[1] is None, r[1] or "", r[2], r[5])
    for g, w in zip(sorted(got, key=order), sorted(brute(rows), key=order), strict=True):
        assert g[:4] == w[:4] and g[5] == w[5] and g[4] == pytest.approx(w[4])


def test_rows_without_doc_id_and_rows_alike(spark, monkeypatch):
    """A third of all rows has no doc_id and one text, a third no doc_id; pieces of rows alike are short."""
    monkeypatch.setattr(M, "PIECE", 7)
    monkeypatch.setattr(M, "BINS", 1)
    rng = random.Random(8)
    rows = [(None, "one two three", "a", 0) for _ in range(100)] + [(None, " ".join(["w"] * rng.randint(0, 30)), rng.choice("ab"), 0) for _ in range(100)] + [(i, "x " * (i % 40), rng.choice("abc"), 0) for i in range(100)]
    order = lambda r: (r[0] is None, r[0] or 0, r[1], r[2], r[3])
    got = sorted(((r.doc_id, r.source, r.size, r.taken) for r in run(spark, rows)), key=order)
    assert got == sorted(((i, s, n, t) for i, s, n, _, _, t in brute(rows)), key=order)


def test_sources_meet_their_targets_to_the_word(spark):
    got = run(spark, rows_of(700, 9))
    for s in {r.source for r in got}:
        own = [r for r in got if r.source == s]
        assert sum(r.taken for r in own) == int(own[0].target + 0.5) <= 2 * own[0].source_size
    assert all(r.taken == r.copies * r.size + r.part and 0 <= r.taken <= 2 * r.size and (r.part < r.size or r.part == 0) for r in got)


def test_nothing(spark):
    assert run(spark, []) == []
    assert [r.taken for r in run(spark, [(1, None, None, 0)])] == [0]
