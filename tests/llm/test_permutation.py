import numpy as np

from chronocohort.llm import permutation as P

SCHEMA = "vec_id long, embedding array<float>, label int, v string"


def brute(rows, step, k):
    x = [(i, np.array(v, np.float32).astype(float)) for i, v, *_ in rows if i is not None and v is not None and all(c is not None and np.isfinite(c) for c in v) and any(v)]
    out = {}
    for i, q in x:
        if i % step == 0:
            best = {}
            for j, v in x:
                if j != i and len(v) == len(q):
                    best[j] = max(best.get(j, -9), float(v @ q / np.linalg.norm(v) / np.linalg.norm(q)))
            for j, s in best.items():
                out.setdefault(i, {})[j] = max(out.get(i, {}).get(j, -9), s)
    return {i: sorted(((-round(s, 9), j) for j, s in c.items()))[:k] for i, c in out.items()}


def run(spark, rows, step=5, k=5):
    table = P.valid(spark.createDataFrame(rows, SCHEMA))
    got = {}
    for r in P.search(table, table.where(f"vec_id % {step} = 0"), k).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (-round(r.score, 9), r.vec_id)
    return {q: [c[i] for i in range(1, len(c) + 1)] for q, c in got.items()}


def vectors(n, seed, dim=16):
    rng = np.random.default_rng(seed)
    return [(i, [float(x) for x in v.astype(np.float32)], i % 3, "clash") for i, v in enumerate(rng.normal(size=(n, dim)))]


def test_small_tables_are_searched_exactly(spark):
    rows = vectors(150, 1)
    same = rows[7][1]
    rows += [(200 + i, same, 0, None) for i in range(40)] + [(7, same, 0, None)]
    rows += [(None, same, 0, None), (300, None, 0, None), (305, [0.0] * 16, 0, None), (310, [float("nan")] * 16, 0, None), (315, [None] * 16, 0, None), (320, [float("inf")] + [1.0] * 15, 0, None), (325, [], 0, None)]
    got, want = run(spark, rows), brute(rows, 5, 5)
    assert set(got) == set(want)
    for q in want:
        assert [(s, j) for s, j in got[q]] == want[q], q


def test_few_candidates_and_none(spark):
    assert run(spark, vectors(3, 2), 1, 5) == brute(vectors(3, 2), 1, 5)
    assert run(spark, vectors(1, 2)) == {} and run(spark, []) == {}


def recall(got, want):
    return np.mean([len({j for _, j in got[q]} & {j for _, j in want[q]}) / len(want[q]) for q in want])


def test_recall_with_a_shallow_rerank_and_short_pieces(spark, monkeypatch):
    monkeypatch.setattr(P, "LEAST_DEPTH", 100)
    monkeypatch.setattr(P, "PIECE", 30)
    monkeypatch.setattr(P, "BLOCK", 7)
    rows = vectors(4000, 3, 32)
    got, want = run(spark, rows, 40), brute(rows, 40, 5)
    assert len(want) == 100 and recall(got, want) >= 0.9
    assert all(len(c) == 5 for c in got.values())


def test_a_third_of_near_copies(spark, monkeypatch):
    monkeypatch.setattr(P, "PIECE", 200)
    rng = np.random.default_rng(5)
    rows = vectors(2000, 4, 16)
    rows += [(5000 + i, [float(x) for x in (np.array(rows[3][1]) + rng.normal(size=16) * 1e-3).astype(np.float32)], 0, None) for i in range(1000)]
    got, want = run(spark, rows, 50), brute(rows, 50, 5)
    assert recall(got, want) >= 0.9 and all(len(c) == 5 for c in got.values())


def test_an_entry_is_met_once_and_by_exact_score(spark):
    rows = vectors(1500, 6, 8)
    table = P.valid(spark.createDataFrame(rows, SCHEMA))
    found = P.search(table, table.where("vec_id % 100 = 0"), 5).collect()
    assert len({(r.query_id, r.vec_id) for r in found}) == len(found) == 75
    by_id = {i: np.array(v, np.float32).astype(float) for i, v, *_ in rows}
    for r in found:
        a, b = by_id[r.query_id], by_id[r.vec_id]
        assert abs(r.score - a @ b / np.linalg.norm(a) / np.linalg.norm(b)) < 1e-12


def test_files_read_grow_slower_than_the_table():
    rng = np.random.default_rng(7)
    read = []
    for n in (4000, 16000):
        x = rng.normal(size=(n, 16))
        pivots = P._flat(x[: max(P.LEAST_PIVOTS, int(P.SPREAD * n**0.5))])
        lengths = np.bincount(P.orders(x, pivots, P.POSTED).ravel(), minlength=len(pivots))
        read.append(lengths[P.orders(x[:50], pivots, P.READ)].sum(axis=1).mean())
    assert read[1] < 2.6 * read[0]
