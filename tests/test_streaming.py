"""Cycles of a file stream against the batch form: late rows, merged and open cycles, a patient with a third of all rows."""

import random

from pyspark.sql import functions as F

from small import at, rows

from chronocohort.functions.drugs import WINDOWS_UNIFORM
from chronocohort.operators.exposure import cycles_by_class
from chronocohort.streaming import cycles as stream

SCHEMA = "subject_id int, drug_class string, drug string, starttime timestamp_ntz"


def feed(seed=4):
    """Three files of 100 days each; neighbours overlap by up to 20 days, so rows come late; gaps of 7 and 8 days are common."""
    rng = random.Random(seed)
    files = []
    for n in range(3):
        part, day = [], {}
        for _ in range(120):
            key = (1 if rng.random() < 0.4 else rng.randint(2, 5), rng.choice(["taxane", "anthracycline"]))
            day[key] = day.get(key, n * 100 - 20 * rng.random()) + rng.choice([0, 0.2, 1, 3, 7, 7, 8, 8, 15])
            part += [(*key, rng.choice(["a", "b", "c"]), at(max(0, day[key])))] * rng.choice([1, 1, 3])
        files.append([r for r in part if r[3] < at(n * 100 + 100)])
    return files


def streamed(spark, folder, files, lateness):
    """Each file is one run of the stream; cycles closed so far are kept between runs."""
    source = f"{folder}/source"
    for part in files:
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        starts = spark.readStream.schema(SCHEMA).parquet(source)
        stream.append_cycles(starts, f"{folder}/out", f"{folder}/state", lateness)
    return spark.read.parquet(f"{folder}/out"), spark.read.parquet(source)


def same_as_batch(closed, starts):
    got, want = stream.whole_cycles(closed, starts, WINDOWS_UNIFORM), cycles_by_class(starts, WINDOWS_UNIFORM)
    assert got.columns == want.columns
    assert rows(got, *got.columns) == rows(want, *want.columns)
    return want


def test_late_rows_within_the_watermark(spark, tmp_path):
    closed, starts = streamed(spark, tmp_path, feed(), "40 days")
    want = same_as_batch(closed, starts)
    facts = closed.columns
    last = starts.agg(F.max(F.to_date("starttime"))).first()[0]
    early = want.where(F.date_add("cycle_end_date", 8) <= F.date_sub(F.lit(last), 40))
    assert rows(closed, *facts) == rows(early, *facts) and closed.count() > 10


def test_rows_later_than_the_watermark_are_not_lost(spark, tmp_path):
    files = feed(5)
    files.append([(1, "taxane", "late", at(10.5)), (1, "taxane", "late", at(13)), (2, "anthracycline", "late", at(60))])
    closed, starts = streamed(spark, tmp_path, files, "1 day")
    assert closed.agg(F.sum("n_prescription_rows_in_cycle")).first()[0] < starts.count()
    assert "late" not in " ".join(r.drugs_in_cycle for r in closed.collect())
    same_as_batch(closed, starts)


def test_setting_is_put_back(spark, tmp_path):
    name = "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition"
    before = spark.conf.get(name, None)
    closed, starts = streamed(spark, tmp_path, [[(1, "taxane", "a", at(0))]], "1 day")
    assert spark.conf.get(name, None) == before and closed.count() == 0
    same_as_batch(closed, starts)
