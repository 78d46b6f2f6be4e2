"""Readers: declared-schema CSV, parquet with CSV fallback, pruned scans, run-metric trees."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

METRICS = ("auroc", "auprc", "f1", "sensitivity", "specificity", "loss")


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)


def read_pruned(spark: SparkSession, path: str, schema: T.StructType, columns: Sequence[str]) -> DataFrame:
    """Only the named columns; the projection reaches the CSV or parquet scan."""
    return read_parquet_else_csv(spark, path, schema).select(*columns)


def _exists(spark: SparkSession, path: str) -> bool:
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jpath)


def read_parquet_else_csv(spark: SparkSession, stem: str, schema: T.StructType) -> DataFrame:
    """``stem.parquet`` when present, else ``stem.csv``; columns coerced to the schema either way."""
    if _exists(spark, f"{stem}.parquet"):
        found = spark.read.parquet(f"{stem}.parquet")
    elif _exists(spark, f"{stem}.csv"):
        found = read_csv(spark, f"{stem}.csv", schema)
    else:
        raise FileNotFoundError(f"neither {stem}.parquet nor {stem}.csv exists")
    return found.select([F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])


def semi_join_scan(big: DataFrame, subjects: DataFrame, admissions: DataFrame) -> DataFrame:
    """Rows of the largest table whose patient and admission are both in the cohort.

    Both filters are distinct key sets, so two left-semi joins drop rows without adding any; Spark
    broadcasts a key set only where its measured size allows.
    """
    return (big.join(subjects.select("subject_id").distinct(), "subject_id", "left_semi")
            .join(admissions.select("hadm_id").distinct(), "hadm_id", "left_semi"))


def read_runs(spark: SparkSession, root: str, metric: str = "auroc") -> DataFrame:
    """Metric files below ``root``: one row per run directory, group and seed taken from the path.

    A run may hold ``test_metrics_<metric>.json`` (preferred) and ``test_metrics.json`` (fallback).
    Accepts ``group/seed/file`` and ``group/file`` layouts, ``name=value`` folders included, and
    files that a Spark job wrote as folders of part files.
    """
    schema = T.StructType([T.StructField(m, T.DoubleType()) for m in METRICS])
    raw = (spark.read.schema(schema).option("recursiveFileLookup", True).json(root)
           .withColumn("path", F.regexp_replace(F.input_file_name(), r"%3D", "=")))
    base = root.rstrip("/").split(":")[-1].lstrip("/")
    rel = F.regexp_extract("path", rf"/\Q{base}\E/(.*)$", 1)
    parts = F.transform(F.split(rel, "/"), lambda p: F.regexp_replace(p, r"^[A-Za-z_]+=", ""))
    at = F.array_position(F.transform(parts, lambda p: p.rlike(r"^test_metrics.*\.json$")), True).cast("int")
    runs = (raw.withColumn("parts", parts).withColumn("at", at).where("at >= 2")
            .withColumn("file", F.element_at("parts", F.col("at")))
            .withColumn("run", F.array_join(F.slice("parts", F.lit(1), F.col("at") - 1), "/"))
            .withColumn("grp", F.when(F.col("at") <= 3, F.element_at("parts", 1)).otherwise(F.col("run")))
            .withColumn("seed", F.when(F.col("at") == 3, F.element_at("parts", 2)))
            .where(F.col("file").isin(f"test_metrics_{metric}.json", "test_metrics.json"))
            .withColumn("preferred", (F.col("file") != "test_metrics.json").cast("int")))
    best = Window.partitionBy("run").orderBy(F.desc("preferred"))
    return (runs.withColumn("pick", F.row_number().over(best)).where("pick = 1")
            .select("grp", "seed", "preferred", *METRICS))
