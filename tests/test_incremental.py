"""A store of cycles that grows by batches against a full build."""

import os
import random

from small import at, rows

from chronocohort.functions.drugs import WINDOWS_UNIFORM
from chronocohort.operators.exposure import cycles_by_class
from chronocohort.plans import incremental as I

SCHEMA = "subject_id int, drug_class string, drug string, starttime timestamp_ntz"


def starts(n, patients, seed):
    rng = random.Random(seed)
    return [(rng.choice(patients), rng.choice(["taxane", "anthracycline"]), rng.choice("abc"), at(rng.randint(0, 150) + rng.choice([0, 0.3]))) for _ in range(n)]


def files(folder):
    """Size and time of every data file of days and cycles."""
    found = {}
    for table in ("days", "cycles"):
        for root, _, names in os.walk(f"{folder}/{table}"):
            found |= {f"{root}/{n}": (os.stat(f"{root}/{n}").st_mtime_ns, os.stat(f"{root}/{n}").st_size) for n in names}
    return found


def check(spark, folder, so_far):
    frame = spark.createDataFrame(so_far, SCHEMA)
    got, want = I.cycles(spark, folder, frame, WINDOWS_UNIFORM), cycles_by_class(frame, WINDOWS_UNIFORM)
    assert got.columns == want.columns and rows(got, *got.columns) == rows(want, *want.columns)


def test_batches_equal_a_full_build(spark, tmp_path):
    folder = str(tmp_path)
    I.create(spark, folder, parts=8)
    everybody = [1] * 10 + list(range(2, 20)) + [None]
    first, more = starts(400, everybody, 1), starts(60, [1, 5], 2) + starts(5, [None], 3) + [(77, "taxane", "a", at(3))]
    I.add(folder, "first", spark.createDataFrame(first, SCHEMA))
    check(spark, folder, first)
    before, (_, old) = files(folder), I._newest(spark, folder)
    I.add(folder, "more", spark.createDataFrame(more, SCHEMA))
    check(spark, folder, first + more)
    after, (number, new) = files(folder), I._newest(spark, folder)
    assert all(after[f] == before[f] for f in before)  # nothing written before is touched
    changed = {p for p in new if new[p] != old[p]}
    assert number == 2 and 1 <= len(changed) <= 4 and len({new[p] for p in changed}) == 1
    written = {f.split("part=")[1].split("/")[0] for f in after if f not in before and "part=" in f}
    assert written == {str(p) for p in changed}
    I.add(folder, "more", spark.createDataFrame(more, SCHEMA))  # the same batch again
    assert files(folder) == after
    check(spark, folder, first + more)


def test_run_that_was_cut_off_and_empty_batches(spark, tmp_path, monkeypatch):
    folder = str(tmp_path)
    I.create(spark, folder, parts=3)
    check(spark, folder, [])
    first, more = starts(50, [1, 2, 3], 4), starts(20, [2, 3], 5)
    I.add(folder, "none", spark.createDataFrame([], SCHEMA))
    I.add(folder, "first", spark.createDataFrame(first, SCHEMA))
    publish = I._publish

    def lost(*_):
        raise RuntimeError("lost")

    monkeypatch.setattr(I, "_publish", lost)
    try:
        I.add(folder, "more", spark.createDataFrame(more, SCHEMA))
    except RuntimeError:
        pass
    check(spark, folder, first)
    monkeypatch.setattr(I, "_publish", publish)
    I.add(folder, "more", spark.createDataFrame(more, SCHEMA))
    check(spark, folder, first + more)
