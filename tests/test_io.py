import json

import pytest
from pyspark.sql import functions as F
from small import Tables, adm, at, rows

from chronocohort.plans.workspace import Workspace
from chronocohort.session import durable, shared_folder
from chronocohort.sources import readers, schemas, sinks
from chronocohort.sources.adapters import Clinic


def test_parquet_is_preferred_and_types_are_coerced(spark, tmp_path):
    stem = str(tmp_path / "patients")
    (tmp_path / "patients.csv").write_text("subject_id,anchor_age,anchor_year,dod\n1,50,2020,2021-01-02\n2,60,2020,\n")
    assert readers.read_parquet_else_csv(spark, stem, schemas.PATIENTS).dtypes == [("subject_id", "bigint"), ("anchor_age", "int"), ("anchor_year", "int"), ("dod", "date")]
    spark.createDataFrame([("7", "30", 2020, None)], "subject_id string, anchor_age string, anchor_year int, dod date").write.parquet(f"{stem}.parquet")
    assert rows(readers.read_pruned(spark, stem, schemas.PATIENTS, ["subject_id", "anchor_age"]), "subject_id", "anchor_age") == [(7, 30)]
    with pytest.raises(FileNotFoundError):
        readers.read_parquet_else_csv(spark, str(tmp_path / "none"), schemas.PATIENTS)


def test_run_tree_prefers_metric_file(spark, tmp_path):
    for path, value in (("a/seed1/test_metrics.json", 0.1), ("a/seed1/test_metrics_auroc.json", 0.2), ("a/seed2/test_metrics.json", 0.3),
                        ("b/test_metrics.json", 0.4), ("b/config.json", 9.0), ("c/x/y/test_metrics.json", 0.5), ("a/seed2/test_metrics_f1.json", 0.9)):
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(json.dumps({"auroc": value}))
    assert rows(readers.read_runs(spark, str(tmp_path)), "grp", "seed", "preferred", "auroc") == [
        ("a", "seed1", 1, 0.2), ("a", "seed2", 0, 0.3), ("b", None, 0, 0.4), ("c/x/y", None, 0, 0.5)]


def test_semi_join_scan_adds_no_rows(spark):
    t = Tables(spark, admissions=[adm(1, 1, at(0), at(1)), adm(2, 1, at(5), at(6))], labevents=[(1, 1, 50912, at(0), "abnormal", 1.0), (1, 9, 50912, at(0), None, 1.0), (2, 1, 1, at(0), None, 1.0)])
    subjects = spark.createDataFrame([(1,), (1,)], "subject_id long")
    assert rows(readers.semi_join_scan(t.labevents, subjects, t.admissions), "subject_id", "hadm_id") == [(1, 1)]


def test_written_stage_survives_and_keeps_types(spark):
    df = spark.createDataFrame([(1, at(0))], "a long, t timestamp_ntz")
    again = durable(df)
    assert again.dtypes == df.dtypes and again.inputFiles()[0].split(":")[-1].startswith("/") and shared_folder(spark) in again.inputFiles()[0]


def test_split_membership(spark):
    samples = spark.createDataFrame([(1, 0), (1, 11), (1, 2), (2, 3)], "subject_id long, row_idx long")
    splits = spark.createDataFrame([(1, "test"), (2, "train")], "subject_id long, split string")
    assert rows(sinks.split_membership(samples, splits, 42), "split", "n_cycles", "row_indices") == [("test", 3, "0;2;11"), ("train", 1, "3")]


def test_sorted_sink(spark, tmp_path):
    out = sinks.write_table(spark.range(5).select((4 - F.col("id")).alias("x")), str(tmp_path / "t"), ["x"], csv=True)
    assert rows(out, "x") == [(i,) for i in range(5)] and (tmp_path / "t.csv").exists()


def test_order_lines_are_joined_once_for_all_tables(spark, tmp_path):
    spark.createDataFrame([(i, i % 3, at(i)) for i in range(12)], "o_orderkey long, o_custkey long, o_orderdate timestamp_ntz").write.parquet(f"{tmp_path}/orders.parquet")
    lines = [(i % 13, 7 * i, i, 1 + i % 3, float(i), 10.0 * i, "RAN"[i % 3], at(i)) for i in range(60)]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_returnflag string, l_shipdate timestamp_ntz").write.parquet(f"{tmp_path}/lineitem.parquet")
    stored, plain = Workspace(spark, str(tmp_path)), Clinic(spark, str(tmp_path))
    for name in ("diagnoses", "prescriptions", "echo", "procedures", "labevents"):
        got = getattr(stored, name)
        assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()
        assert rows(got, *got.columns) == rows(getattr(plain, name), *got.columns) != []
    assert set(stored.stages) == {"lines"}


def test_partitions_of_the_clinical_jobs_are_small(spark, tmp_path):
    Clinic(spark, str(tmp_path))
    assert int(spark.conf.get("spark.sql.adaptive.coalescePartitions.initialPartitionNum")) >= 480


def test_stages_are_packed_tightly(spark):
    stored = durable(spark.range(10))
    assert all(".zstd." in f for f in stored.inputFiles()) and stored.inputFiles()
