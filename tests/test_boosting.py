"""Histogram boosting against a plain fit, whatever the layout of the rows; stored models and rescoring."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronocohort.functions import scalars as S
from chronocohort.operators import boosting as B
from chronocohort.operators import evaluate as E
from chronocohort.operators import features as FE
from chronocohort.operators import sequence as Q

ROWS = "row_id long, part string, label int, features array<int>, bins array<int>"


def data(n=400, seed=1):
    """Dense and sparse features; the label depends on two of them and on what is missing."""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        cells = {f: rng.randint(0, 9) for f in range(4) if rng.random() < 0.8} | {rng.randint(4, 300_000 if rng.random() < 0.2 else 12): rng.randint(1, 3) for _ in range(3)}
        y = int(rng.random() < 1 / (1 + math.exp(4 - cells.get(0, 8) * 0.8 + cells.get(1, 0) * 0.3 - 2 * (5 in cells))))
        out.append((rng.getrandbits(62), ("train", "train", "val", "test")[i % 4], y, *map(list, zip(*sorted(cells.items())))))
    return out


def plain_hash(x, seed, salt):
    m = (1 << 64) - 1
    z = (x + (seed * 1_000_003 + salt) * 0x9E3779B97F4A7C15) & m
    z = ((z ^ (z >> 30)) * 0xBF58476D1CE4E5B9) & m
    z = ((z ^ (z >> 27)) * 0x94D049BB133111EB) & m
    return ((z ^ (z >> 31)) >> 11) / (1 << 53)


def plain_fit(rows, first, last, seed, s):
    """Scores of all rows by the trees of the best round: every split tried on every row."""
    cells = [dict(zip(f, b)) for *_, f, b in rows]
    train = [i for i, r in enumerate(rows) if r[1] == "train"]
    pos = sum(rows[i][2] for i in train)
    weight = (len(train) - pos) / pos
    margin, history, curve = [0.0] * len(rows), [], []

    def cut(x):
        return x - s.alpha if x > s.alpha else x + s.alpha if x < -s.alpha else 0.0

    def worth(g, h):
        t = cut(g / B.SCALE)
        return t * t / (h / B.SCALE + s.penalty)

    for round_ in range(s.rounds):
        g, h = {}, {}
        for i in train:
            if plain_hash(rows[i][0], seed, 2 * round_) < s.rows:
                p, w = float(B.probability(np.float64(margin[i]))), weight if rows[i][2] else 1.0
                g[i], h[i] = int(np.rint((p - rows[i][2]) * w * B.SCALE)), int(np.rint(p * (1 - p) * w * B.SCALE))
        columns = sorted({f for i in g for f in cells[i] if first <= f < last and plain_hash(f, seed, 2 * round_ + 1) < s.columns})

        def grow(members, used, depth):
            G, H = sum(g[i] for i in used), sum(h[i] for i in used)
            best = None
            for f in columns if depth < s.depth else ():
                have = [i for i in used if f in cells[i]]
                for b in sorted({cells[i][f] for i in have}):
                    for missing in (True, False):
                        left = [i for i in used if (cells[i][f] <= b if f in cells[i] else missing)]
                        lg, lh = sum(g[i] for i in left), sum(h[i] for i in left)
                        if lh >= s.least_weight * B.SCALE and H - lh >= s.least_weight * B.SCALE:
                            gain = worth(lg, lh) + worth(G - lg, H - lh) - worth(G, H)
                            if gain > 1e-9 and (best is None or gain > best[0]):
                                best = (gain, f, b, missing)
            if best is None:
                return {i: -cut(G / B.SCALE) / (H / B.SCALE + s.penalty) * s.step for i in members}
            goes = lambda i: cells[i][best[1]] <= best[2] if best[1] in cells[i] else best[3]
            return grow([i for i in members if goes(i)], [i for i in used if goes(i)], depth + 1) | grow([i for i in members if not goes(i)], [i for i in used if not goes(i)], depth + 1)

        values = grow(range(len(rows)), list(g), 0)
        margin = [m + values[i] for i, m in enumerate(margin)]
        history.append(margin)
        val = [(min(int(B.probability(np.float64(margin[i])) * B.RANKS), B.RANKS - 1), r[2]) for i, r in enumerate(rows) if r[1] == "val"]
        wins = [(a > b) + (a == b) / 2 for a, x in val for b, y in val if x and not y]
        curve.append(sum(wins) / len(wins))
        best = curve.index(max(curve)) + 1
        if len(curve) - best >= s.patience:
            break
    return [float(B.probability(np.float64(m))) for m in history[best - 1]], best


SETTINGS = B.Settings(rounds=10, patience=4, depth=3, step=0.3, least_weight=2.0)


@pytest.mark.parametrize("parts", [1, 6])
def test_scores_equal_a_plain_fit(spark, parts):
    rows = data()
    df = spark.createDataFrame(rows, ROWS).repartition(parts)
    models = [B.Model("low", 3, 0, 4), B.Model("all", 3, 0, B.WIDTH), B.Model("all", 4, 0, B.WIDTH), B.Model("high", 3, 4, B.WIDTH)]
    fitted = B.kept(B.fit(df, models, SETTINGS))
    again = B.from_table(B.as_table(spark, fitted))
    got = {(r.variant, r.seed, r.row_id): (r.prob_cardiotoxic, r.n_trees) for r in B.score(df, again).collect()}
    for m in fitted:
        expected, best = plain_fit(rows, m.first, m.last, m.seed, SETTINGS)
        assert len(m.trees) == best
        for r, p in zip(rows, expected):
            assert got[m.name, m.seed, r[0]] == (pytest.approx(p, abs=1e-12), best)


def test_boosting_stops_after_its_patience_and_learns(spark):
    df = spark.createDataFrame(data(1600, 5), ROWS).repartition(3)
    model = B.fit(df, [B.Model("all", 1, 0, B.WIDTH)], B.Settings(rounds=60, patience=5, step=0.3))[0]
    assert len(model.curve) == 60 or len(model.curve) - model.best() == 5
    scored = B.score(df.where("part = 'test'"), B.kept([model]), ["label"]).withColumnRenamed("label", "true_label")
    assert E.auroc(scored).first()["auroc"] > 0.8


def test_without_validation_or_positive_rows(spark):
    rows = [(i, "train", 0, [0], [i % 3]) for i in range(40)]
    model = B.fit(spark.createDataFrame(rows, ROWS), [B.Model("all", 1, 0, 9)], B.Settings(rounds=3))[0]
    assert len(model.trees) == 3 and not model.curve and model.best() == 3
    assert all(r.prob_cardiotoxic < 0.5 for r in B.score(spark.createDataFrame(rows, ROWS), [model]).collect())


def test_edits_move_scores_only_through_tokens_the_trees_use(spark):
    """Token 30 decides the label, token 40 is noise too rare to be split on."""
    rng = random.Random(2)
    key = "subject_id long, cycle_number int"
    people, seqs, splits = [], [], []
    for i in range(300):
        hit = rng.random() < 0.5
        people.append((i, 1, int(hit), *[1.0 if j == 0 else None for j in range(len(FE.CLINICAL))]))
        seqs.append((i, 1, [S.CLS, *([30] * rng.randint(1, 3) if hit else []), 31, *([40] if i == 7 else [])]))
        splits.append((i, ("train", "val", "test")[i % 3]))
    table = spark.createDataFrame(people, f"{key}, binary_label int, " + ", ".join(f"f_{c} double" for c in FE.CLINICAL))
    seq = spark.createDataFrame(seqs, f"{key}, concept_ids array<int>")
    parts = spark.createDataFrame(splits, "subject_id long, split string")
    cuts = FE.clinical_cuts(table)
    rows = FE.model_rows(table, parts, seq, cuts)
    models = FE.fit_trees(rows, ["bow", "combined"], settings=B.Settings(rounds=4, patience=3, step=0.5))
    assert {f for m in models for t in m.trees for f, _, _ in t.splits.values()} == {30 + len(FE.CLINICAL)}
    vocab = spark.createDataFrame([(t, i) for i, t in enumerate(S.RESERVED)] + [("lab::used", 30), ("medication::rare", 40)], "token string, id int")
    edits = {"used": Q.perturb_zero(seq, vocab, "lab::"), "unused": Q.perturb_zero(seq, vocab, "medication::")}
    got = FE.rescore(rows, {n: FE.model_rows(table, parts, e, cuts) for n, e in edits.items()}, models)
    held = {i for i, _, ids in seqs if 30 in ids}
    for r in got.collect():
        assert r.delta_prob == (pytest.approx(0) if r.edit == "unused" or r.subject_id not in held else r.delta_prob)
        assert r.edit == "unused" or r.subject_id not in held or r.delta_prob < -0.1
    assert got.count() == 300 * 2 * 2
    assert FE.tree_runs(rows, models).select(F.count_distinct("variant"), F.count("*")).first()[:] == (2, 200)


def test_token_bins_are_monotone(spark):
    got = [r[0] for r in spark.range(1, 5000).orderBy("id").select(FE.token_bin(F.col("id"))).collect()]
    assert got[:16] == list(range(1, 17)) and got == sorted(got) and max(got) < B.BINS


def test_cuts_are_all_values_or_percentiles(spark):
    rows = spark.range(5000).select(F.lit(0).alias("x"), *[(F.col("id") % (7 if i else 5000)).cast("double").alias(f"f_{c}") for i, c in enumerate(FE.CLINICAL)])
    cuts = FE.clinical_cuts(rows)
    assert cuts[1] == [float(i) for i in range(7)] and 200 < len(cuts[0]) < B.BINS and cuts[0] == sorted(cuts[0])


def test_rows_of_one_file_are_dealt_over_the_cores(spark):
    df = spark.createDataFrame(data(), ROWS).coalesce(1)
    assert df.rdd.getNumPartitions() == 1 and B._dealt(df).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_sums_stay_exact_beyond_the_integers_of_doubles(spark):
    cells = [(i, "train", 0, [0, 3], [i % 2, 1], [0.0]) for i in range(8)]
    batch = spark.createDataFrame(cells, f"{ROWS}, margins array<double>").toArrow().combine_chunks().to_batches()[0]
    block = B.Block(batch)
    g = np.full(8, (1 << 58) + 1, np.int64)
    place, cell, total, n = block.cell_sums(np.array([True, False, True]), np.where(np.arange(8) < 6, 0, -1), 1, g, np.ones(8, np.int64))
    assert list(zip(place, cell, total, n)) == [(0, 0, 3 * ((1 << 58) + 1), 3), (0, 2, 6 * ((1 << 58) + 1), 6)]


def test_blocks_hold_each_row_of_train_and_val_once(spark):
    """Passes read blocks that are packed once; test rows are not among them, and train rows are apart from val rows."""
    rows = data(1000, 7)
    models = [B.Model("all", 1, 0, B.WIDTH)] * 2
    found = list(B._blocks(iter(B._packed(spark.createDataFrame(rows, ROWS).repartition(3), models).toArrow().to_batches())))
    assert max(b.n for b in found) <= -(-750 // (2 * spark.sparkContext.defaultParallelism)) and all(b.margins.shape == (2, b.n) for b in found)
    got = {}
    for b in found:
        cells = [[] for _ in range(b.n)]
        for c, x, y in zip(b.cells, b.starts, b.starts[1:]):
            for r in b.rows[x:y]:
                cells[r].append(divmod(int(c), B.BINS))
        got |= {int(i): ("train" if b.train else "val", int(y), c) for i, y, c in zip(b.row_id, b.label, cells)}
    assert sum(b.n for b in found) == 750
    assert got == {i: (part, y, list(zip(f, b))) for i, part, y, f, b in rows if part != "test"}


@pytest.mark.parametrize("weightless", [False, True])
def test_sums_of_the_heavier_node_are_what_the_lighter_one_leaves(spark, weightless):
    rng, rows = np.random.default_rng(3), data(600, 9)
    table = spark.createDataFrame(rows, ROWS).toArrow()
    block = B.Block(table)
    cells = np.array([f * B.BINS + b for *_, fs, bs in rows for f, b in zip(fs, bs)])
    at = np.array([i for i, r in enumerate(rows) for _ in r[3]])
    g, h = rng.integers(-99, 99, 600), rng.integers(0 if weightless else 1, 9, 600)
    kept, place = rng.random(len(block.cells)) < 0.7, rng.integers(-1, 3, 600)
    expected = {}
    for i, c in zip(at, cells):
        if place[i] >= 0 and kept[np.searchsorted(block.cells, c)]:
            x, y = expected.get((place[i], c), (0, 0))
            expected[place[i], c] = (x + g[i], y + h[i])
    assert {(p, block.cells[c]): (x, y) for p, c, x, y in zip(*block.cell_sums(kept, place, 3, g, h))} == expected

    blocks = B._packed(spark.createDataFrame(rows, ROWS), model := [B.Model("all", 1, 0, B.WIDTH)])
    tree = B.Tree({0: (0, 4, True)})
    if weightless:  # derivatives of 0 in rows that are there: their cells stay
        blocks = spark.createDataFrame([r.asDict() | {"margins": np.where(np.arange(r.n) % 2, 40.0, -40.0).tobytes()} for r in blocks.collect()], B.BLOCKS)
    s = B.Settings(rows=1.0, columns=1.0, least_weight=0.0 if weightless else 1.0)

    def read(nodes, whole=False):
        return blocks.mapInArrow(lambda stream: B._pass(stream, [(0, model[0], [], tree if nodes != [0] else B.Tree(), nodes)], s, 0, whole), B.SUMS)

    totals = {}
    for r in read([1, 2]).where("feature = 0").groupBy("node").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).collect():
        totals[0, r.node] = (r.g, r.h)  # of rows with the feature: any two numbers do
    both = B.best_splits(read([1, 2]), totals, s)
    light = B.best_splits(read([0]).unionAll(read([1])), totals, s, {(0, 0): [(2, 1)], (0, 1): [(1, 1), (2, -1)]})
    assert sorted(both) == sorted(light) and (weightless or len(both) == 2)


def test_rows_of_samples_with_repeated_and_missing_keys(spark):
    """Token arrays of one key are counted together; arrays, tokens and values may be missing, and a sample without a split is left out."""
    low = len(S.RESERVED)
    first, second, third, *_ = FE.CLINICAL
    people = [(1, 1, 1, 2.5, None), (1, 2, 0, 0.0, 9.0), (2, 1, None, None, 1.0), (3, 1, 1, 1.0, 1.0), (4, None, 0, 7.0, None)]
    rows = spark.createDataFrame(people, f"subject_id long, cycle_number int, binary_label int, f_{first} double, f_{second} double")
    rows = rows.select("*", F.lit(float("nan")).alias(f"f_{third}"), *[F.lit(None).cast("double").alias(f"f_{c}") for c in FE.CLINICAL[3:]])
    seqs = [(1, 1, [S.CLS, low, low, None, low + 2]), (1, 1, [low] * 15), (1, 1, None), (1, 2, []), (2, 1, [low + 1] * 40 + [0]), (4, None, [low])]
    cuts = [[0.0, 2.5, 3.0], [1.0], [1.0, 2.0], *[[] for _ in FE.CLINICAL[3:]]]
    parts = spark.createDataFrame([(1, "train"), (2, "val"), (4, "test")], "subject_id long, split string")
    got = FE.model_rows(rows, parts, spark.createDataFrame(seqs, "subject_id long, cycle_number int, concept_ids array<int>"), cuts)
    n = len(FE.CLINICAL)
    assert sorted((r.subject_id, r.cycle_number, r.part, r.label, list(zip(r.features, r.bins))) for r in got.collect()) == [
        (1, 1, "train", 1, [(0, 1), (2, 2), (n + low, 16), (n + low + 2, 1)]), (1, 2, "train", 0, [(0, 0), (1, 1), (2, 2)]),
        (2, 1, "val", None, [(1, 0), (2, 2), (n + low + 1, 17)]), (4, None, "test", 0, [(0, 3), (2, 2)])]
    counts = np.arange(1, 70_000)
    assert [r[0] for r in spark.range(1, 70_000).orderBy("id").select(FE.token_bin(F.col("id"))).collect()] == FE.token_bins(counts).tolist()


def test_scores_after_edits_are_joined_by_sample_not_by_model(spark):
    rows = [(i, 1, "test", i % 2, [0], [i % 5]) for i in range(40)]
    df = spark.createDataFrame(rows, "subject_id long, cycle_number int, part string, label int, features array<int>, bins array<int>")
    models = [B.Model("a", 1, 0, 9, [B.Tree({0: (0, 2, True)}, {1: 1.0, 2: -1.0})]), B.Model("a", 2, 0, 9, [B.Tree({}, {0: 0.5})]), B.Model("b", 1, 0, 9)]
    got = FE.rescore(df, {"none": df, "all": df.withColumn("bins", F.array(F.lit(4)))}, models)
    assert got.columns == ["subject_id", "cycle_number", "variant", "seed", "edit", "prob_perturb", "prob_orig", "delta_prob"]
    low, high = (float(B.probability(np.float64(x))) for x in (-1.0, 1.0))
    expected = {(i, v, s, e): (p if e == "none" else q, p) for i in range(40) for v, s, p, q in (("a", 1, high if i % 5 <= 2 else low, low), ("a", 2, *[float(B.probability(np.float64(0.5)))] * 2), ("b", 1, 0.5, 0.5)) for e in ("none", "all")}
    found = got.collect()
    assert len(found) == len(expected) and {(r.subject_id, r.variant, r.seed, r.edit): (r.prob_perturb, r.prob_orig) for r in found} == expected
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate explode") < plan.index("Join Inner")  # 40 rows a side are joined, not 40 for each model


def test_scores_of_the_trees_are_stored_once_for_all_queries(spark):
    from chronocohort.plans.queries import REGISTRY
    from chronocohort.plans.workspace import Workspace

    rows = [(i, 1, "test" if i % 2 else "train", i % 3 % 2, [0, 40], [i % 5, 1]) for i in range(60)]
    df = spark.createDataFrame(rows, "subject_id long, cycle_number int, part string, label int, features array<int>, bins array<int>")
    trees = B.as_table(spark, [B.Model(v, s, 0, 9, [B.Tree({0: (0, 2, True)}, {1: 1.0, 2: -1.0})]) for v in FE.VARIANTS for s in (1, 2)])
    ws = Workspace(spark, "/nowhere", {"tree_data": df, "trees": trees})
    for name in ("eval_seed_summary_trees", "model_gbt"):
        out = REGISTRY[name](ws)
        assert "MapInArrow" not in out._jdf.queryExecution().optimizedPlan().toString()
        assert out.count() == {"eval_seed_summary_trees": 18, "model_gbt": 180}[name]
    assert {(r.variant, r.n_features) for r in out.collect()} == {("clinical", 1), ("bow", 1), ("combined", 2)}
