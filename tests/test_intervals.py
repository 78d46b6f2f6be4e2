"""The index of dyadic time cells against brute force, one patient with half of all rows."""

import random
from datetime import date, timedelta

from pyspark.sql import functions as F

from small import at

from chronocohort.operators import temporal as T

ZERO = date(2020, 1, 1)


def patient(rng):
    return 1 if rng.random() < 0.5 else rng.randint(2, 9)


def days(seed=1):
    """Overlapping spans of one day to six years, some before 1970, some empty or without an end; points with repeats and gaps."""
    rng = random.Random(seed)
    day = lambda: ZERO + timedelta(days=rng.choice([rng.randint(-20000, -17000), rng.randint(0, 3000), rng.randint(0, 60)]))
    spans = []
    for i in range(300):
        f = day()
        spans.append((patient(rng), i, f, f + timedelta(days=rng.choice([-3, 0, 0, 1, 7, 30, 64, 127, 128, 365, 2190]))))
    spans += [(1, 300, None, ZERO), (1, 301, ZERO, None), (None, 302, ZERO, ZERO)]
    points = [(patient(rng), day()) for _ in range(400)]
    return spans, points + points[:20] + [(1, None), (None, ZERO)]


def frames(spark):
    spans, points = days()
    return spans, points, spark.createDataFrame(spans, "subject_id int, i int, f date, l date"), spark.createDataFrame(points, "subject_id int, d date")


def holds(s, p):
    return None not in (*s, *p) and s[0] == p[0] and s[2] <= p[1] <= s[3]


def test_pairs_are_those_of_brute_force(spark):
    spans, points, left, right = frames(spark)
    got = T.interval_join(left, right, ["subject_id"], (F.col("f"), F.col("l")), F.col("d"), F.col("d").between(F.col("f"), F.col("l")))
    assert got.columns == ["subject_id", "i", "f", "l", "d"]
    key = lambda r: (r[1], r[4])
    assert sorted(map(tuple, got.collect()), key=key) == sorted(((*s, p[1]) for s in spans for p in points if holds(s, p)), key=key)


def test_days_between(spark):
    spans, points, left, right = frames(spark)
    got = T.exists_day_between(left.where("subject_id IS NOT NULL"), right, "d", "f", "l", "found", ["subject_id", "i"]).collect()
    assert {r.i: r.found for r in got} == {s[1]: int(any(holds(s, p) for p in points)) for s in spans if s[0] is not None}


def test_instants_within_a_day_count(spark):
    rng = random.Random(2)
    spans = [(patient(rng), i, at(a), at(a + rng.choice([1, 1.5, 30, 400]))) for i, a in enumerate(rng.random() * 900 for _ in range(200))]
    points = [(patient(rng), at(rng.random() * 1300)) for _ in range(150)] + [(s[0], s[2]) for s in spans[:20]] + [(s[0], s[3]) for s in spans[20:40]]
    left = spark.createDataFrame(spans, "subject_id int, i int, a timestamp_ntz, u timestamp_ntz")
    right = spark.createDataFrame(points, "subject_id int, t timestamp_ntz")
    got = T.exists_in_interval(left, right, "t", left["a"], left["u"], "found", ["subject_id", "i"]).collect()
    assert {r.i: r.found for r in got} == {s[1]: int(any(p[0] == s[0] and s[2] < p[1] <= s[3] for p in points)) for s in spans}


def test_candidates_are_in_proportion_to_hits(spark):
    """A patient with 4,000 days and 2,000 spans of a week: 8,000,000 pairs, 14,000 hits, and few candidates beside them."""
    left = spark.range(2000).select(F.lit(1).alias("subject_id"), F.expr("date_add(date'2010-01-01', cast(id * 2 as int))").alias("f"), F.lit(6).alias("n"))
    left = left.withColumn("l", F.date_add("f", F.col("n")))
    right = spark.range(4000).select(F.lit(1).alias("subject_id"), F.expr("date_add(date'2010-01-01', cast(id as int))").alias("d"))
    met = T.interval_join(left, right, ["subject_id"], (F.col("f"), F.col("l")), F.col("d"), F.lit(True)).count()
    assert met <= 4 * 7 * 2000


def test_no_spans_and_no_points(spark):
    _, _, left, right = frames(spark)
    test = (["subject_id"], (F.col("f"), F.col("l")), F.col("d"), F.col("d").between(F.col("f"), F.col("l")))
    assert T.interval_join(left.limit(0), right, *test).count() == 0
    assert T.interval_join(left, right.limit(0), *test).count() == 0
