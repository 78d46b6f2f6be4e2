"""Skew-safe operators against brute force, with one key holding more than a third of the rows."""

import random
from datetime import timedelta

import numpy as np
from pyspark.sql import functions as F

from small import DAY0

from chronocohort.operators import evaluate as E
from chronocohort.operators.ordering import as_of, carried, exact_quantiles, large_keys, magnitude_chunk, prefix_sums, running_index
from chronocohort.operators.split import check_split, split_patients
from chronocohort.operators.timeline import join_fitted


def skewed(n=3000, seed=1):
    rng = random.Random(seed)
    return [(1 if rng.random() < 0.5 else rng.randint(2, 40), round(rng.choice([rng.gauss(0, 1e-3), rng.gauss(0, 50), rng.expovariate(1e-4)]), 6), i) for i in range(n)]


def test_running_index_cuts_every_key(spark):
    data = skewed()
    df = spark.createDataFrame(data, "k int, v double, i int")
    got = running_index(df, ["k"], [F.col("v"), F.col("i")], magnitude_chunk(F.col("v"), 2), "place")
    assert "_chunk" not in got.columns
    place = {r["i"]: r["place"] for r in got.collect()}
    for k in {d[0] for d in data}:
        for n, d in enumerate(sorted((d for d in data if d[0] == k), key=lambda d: d[1:]), 1):
            assert place[d[2]] == n


def test_running_index_with_struct_chunks(spark):
    data = [(h, t, i) for i, (h, t) in enumerate((1 if n % 2 else n % 9, n % 3) for n in range(900))]
    df = spark.createDataFrame(data, "h int, t int, i int")
    chunk = F.struct((F.col("i") / 100).cast("int").alias("a"), F.lit(0).alias("b"))
    place = {r["i"]: r["place"] for r in running_index(df, ["h", "t"], [F.col("i")], chunk, "place").collect()}
    for key in {d[:2] for d in data}:
        assert [place[d[2]] for d in data if d[:2] == key] == list(range(1, sum(d[:2] == key for d in data) + 1))


def test_prefix_sums(spark):
    data = skewed()
    got = prefix_sums(spark.createDataFrame(data, "k int, v double, i int").withColumn("one", F.lit(1)), [], [F.col("v"), F.col("i")], magnitude_chunk(F.col("v")), {"n": "one"})
    assert {r["i"]: r["n"] for r in got.collect()} == {d[2]: n for n, d in enumerate(sorted(data, key=lambda d: d[1:]), 1)}


def test_chunks_follow_the_order(spark):
    values = [-1e9, -1000.0, -999.9999, -1.0, -1e-7, 0.0, 1e-12, 0.1, 0.99999, 1.0, 9.999, 10.0, 999.99999, 1000.0, 1000.1, 1e15]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "v double").select(magnitude_chunk(F.col("v"))).collect()]
    assert got == sorted(got)


def test_exact_quantiles(spark):
    data = skewed()
    got = exact_quantiles(spark.createDataFrame(data + [(99, 5.0, 0), (98, None, 0)], "k int, v double, i int"), ["k"], "v", {"a": 0.25, "b": 0.5, "c": 0.75}).collect()
    assert {r["k"] for r in got} == {d[0] for d in data} | {99}
    for r in got:
        values = [d[1] for d in data if d[0] == r["k"]] or [5.0]
        np.testing.assert_allclose([r["a"], r["b"], r["c"]], np.quantile(values, [0.25, 0.5, 0.75]), rtol=1e-12, atol=1e-12)


def test_fitted_lookup_keeps_every_row(spark):
    data = skewed(400)
    small = spark.createDataFrame([(k, k * 10) for k in range(1, 30)], "k int, x int")
    got = join_fitted(spark.createDataFrame(data, "k int, v double, i int"), small, ["k"])
    assert sorted((r["i"], r["x"]) for r in got.collect()) == [(i, k * 10 if k < 30 else None) for k, _, i in data]


def test_infinite_values_have_chunks_of_their_own(spark):
    inf = float("inf")
    values = [-inf, -1e300, -1.0, 0.0, 1.0, 2.0, 1e308, inf]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "v double").select(magnitude_chunk(F.col("v"))).collect()]
    assert got == sorted(got) and len(set(got)) == len(values)
    df = spark.createDataFrame([(1, v) for v in (1.0, 2.0, inf, inf, inf)] + [(2, v) for v in (-inf, 1.0, 2.0)], "k int, v double")
    assert {r["k"]: (r["m"], r["u"]) for r in exact_quantiles(df, ["k"], "v", {"m": 0.5, "u": 0.75}).collect()} == {1: (inf, inf), 2: (1.0, 1.5)}


def scored(spark, pairs):
    return spark.createDataFrame([(float(p), int(y)) for p, y in pairs], "prob_cardiotoxic double, true_label int")


def test_areas_with_ties(spark):
    rng = random.Random(3)
    pairs = [(rng.randint(0, 20) / 20, int(rng.random() < 0.4)) for _ in range(300)]
    pos, neg = [p for p, y in pairs if y], [p for p, y in pairs if not y]
    area = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))
    ap, last = 0.0, 0.0
    for t in sorted({p for p, _ in pairs}, reverse=True):
        tp, n = sum(p >= t for p in pos), sum(p >= t for p, _ in pairs)
        ap, last = ap + (tp / len(pos) - last) * tp / n, tp / len(pos)
    df = scored(spark, pairs)
    assert abs(E.auroc(df).first()[0] - area) < 1e-12 and abs(E.auprc(df).first()[0] - ap) < 1e-12


def test_metrics_when_undefined(spark):
    one = scored(spark, [(0.2, 1), (0.3, 1)])
    assert E.auroc(one).first()[0] is None
    r = E.confusion(one).first()
    assert (r["precision"], r["f1"], r["specificity"], r["sensitivity"]) == (0.0, 0.0, 0.0, 0.0)
    runs = spark.createDataFrame([("a", 0.5, 0.5, 0.5, 0.5, 0.5, 0.5)], "variant string, " + ", ".join(f"{m} double" for m in E.METRICS))
    assert {x["std"] for x in E.seed_summary(runs, "variant").collect()} == {0.0}


def test_threshold_sweep_counts_each_score_once(spark):
    pairs = [(0.05, 0), (0.5, 1), (0.5, 0), (0.95, 1), (0.2, 0), (0.0, 1)]
    for r in E.threshold_sweep(scored(spark, pairs)).collect():
        tp = sum(p >= r["threshold"] and y for p, y in pairs)
        tn = sum(p < r["threshold"] and not y for p, y in pairs)
        assert abs(r["sensitivity"] - tp / 3) < 1e-9 and abs(r["specificity"] - tn / 3) < 1e-9


def test_split_is_exclusive_stratified_and_stable(spark):
    samples = spark.createDataFrame([(s, c, int(s % 4 == 0)) for s in range(1, 201) for c in (1, 2)] + [(999, 1, 2)], "subject_id long, cycle_number int, binary_label int")
    got = split_patients(samples, 42)
    assert [tuple(r) for r in check_split(samples, got).collect()] == [(1, 201)]
    counts = {(r[0], r[1]): r[2] for r in got.groupBy("patient_label", "split").count().collect()}
    assert counts[(1, "test")] == 8 and counts[(0, "test")] == 22 and counts[(1, "val")] == round(42 * 0.15 / 0.85)
    assert counts[(2, "test")] == 1  # a stratum of one goes to test
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, split_patients(samples.repartition(7), 42).collect()))


def test_carried_folds_match_a_plain_loop(spark):
    rng = random.Random(5)
    data = [(k, p, rng.choice([None, rng.randint(0, 9)])) for k, n in (("hot", 400), ("b", 30), ("c", 1)) for p in rng.sample(range(2000), n)]
    df = spark.createDataFrame(data, "k string, p int, v int")
    folds = {"s": ("sum", "v"), "m": ("max", "v"), "l": ("last", "v")}
    got = {(r.k, r.p): (r.s, r.m, r.l) for r in carried(df, ["k"], (F.shiftright("p", 4), F.shiftright("p", 8)), ["p"], folds).collect()}
    for k in ("hot", "b", "c"):
        seen = []
        for p, v in sorted((p, v) for kk, p, v in data if kk == k):
            seen += [] if v is None else [v]
            assert got[k, p] == ((sum(seen), max(seen), seen[-1]) if seen else (None, None, None))


def test_as_of_takes_what_lies_strictly_before(spark):
    rng = random.Random(6)
    at = lambda: DAY0 + timedelta(days=rng.choice([0, 1, 40, 400, 4000]) * rng.random())
    marks = [(rng.choice([1, 1, 2]), at(), rng.randint(0, 99)) for _ in range(300)] + [(1, DAY0, 5), (1, DAY0, 7)]
    asked = [(rng.choice([1, 2, 3]), at(), i) for i in range(100)] + [(1, DAY0, 100), (1, marks[0][1], 101), (1, None, 102)]
    left = spark.createDataFrame(asked, "k int, t timestamp_ntz, i int")
    right = spark.createDataFrame(marks, "k int, u timestamp_ntz, v int")
    got = {r.i: (r.n, r.top, r.last) for r in as_of(left, right, ["k"], "t", "u", {"n": ("sum", F.lit(1)), "top": ("max", F.col("v")), "last": ("last", F.col("v"))}).collect()}
    for k, t, i in asked:
        before = sorted((u, v) for kk, u, v in marks if kk == k and t is not None and u < t)
        assert got[i] == ((len(before), max(v for _, v in before), before[-1][1]) if before else (None, None, None)), i


def shuffles(df):
    """Exchanges of the plan as it was run, without those of broadcasts."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    return plan.count("Exchange hashpartitioning")


def test_only_large_keys_are_cut(spark):
    data = skewed()
    df = spark.createDataFrame([*data, (None, 1.0, -1)], "k int, v double, i int")
    for whole in (0, 100, 10**6):
        got = running_index(df, ["k"], [F.col("v"), F.col("i")], magnitude_chunk(F.col("v"), 2), "place", large_keys(df, ["k"], whole))
        place = {r["i"]: r["place"] for r in got.collect()}
        assert len(place) == len(data)
        for k in {d[0] for d in data}:
            assert [place[d[2]] for d in sorted((d for d in data if d[0] == k), key=lambda d: d[1:])] == list(range(1, sum(d[0] == k for d in data) + 1))
    assert shuffles(got) <= 2  # the rows once, and the counts of the keys


def test_rows_are_found_as_of_a_time_with_and_without_large_keys(spark):
    rng = random.Random(7)
    right = [(1 if rng.random() < 0.5 else rng.randint(2, 9), DAY0 + timedelta(hours=rng.randint(0, 9000)), rng.randint(0, 99)) for _ in range(900)]
    left = [(rng.randint(1, 10), i, DAY0 + timedelta(hours=rng.randint(0, 9000))) for i in range(300)] + [(None, 300, DAY0), (1, 301, None)]
    marks = spark.createDataFrame(right, "k int, u timestamp_ntz, v int")
    asked = spark.createDataFrame(left, "k int, i int, t timestamp_ntz")
    for whole in (0, 100, 10**6):
        folds = {"n": ("sum", F.lit(1)), "top": ("max", F.col("v")), "last": ("last", F.col("v"))}
        got = as_of(asked, marks, ["k"], "t", "u", folds, large_keys(marks, ["k"], whole))
        assert got.columns == ["k", "i", "t", "n", "top", "last"]
        found = {r.i: r for r in got.collect()}
        assert len(found) == len(left)
        for k, i, t in left:
            past = sorted((u, v) for kk, u, v in right if t is not None and kk == k and u < t)
            assert tuple(found[i])[3:] == ((len(past), max(v for _, v in past), past[-1][1]) if past else (None, None, None))


def test_rows_that_lie_by_key_are_not_shuffled_again(spark):
    df = spark.createDataFrame(skewed(), "k int, v double, i int").repartition("k")
    got = running_index(df, ["k", "v"], [F.col("i")], F.col("i"), "place", large_keys(df, ["k"]))
    initial = got._jdf.queryExecution().executedPlan().toString()
    got.collect()
    assert got._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].count("Exchange hashpartitioning(k#") == 1
    assert "left_anti" in initial.lower() or "leftanti" in initial.lower()
