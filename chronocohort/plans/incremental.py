"""Stored exposure days and cycles that new prescriptions are merged into.

A store is a folder that all executors reach, with one writer at a time.  Patients are dealt into ``parts`` by hash; each part has files of days and files of
cycles, in a folder of the version that last touched it.  A manifest names that version for every part.  It is written last, as one file, so a
run that was cut off leaves the store as it was; files are never overwritten, and readers of an older manifest go on undisturbed.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronocohort.operators.exposure import GAP_DAYS, cycles_of_days, exposure_days, with_windows

KEYS = ["subject_id", "drug_class"]


def _part(parts: int) -> Column:
    return F.pmod(F.xxhash64("subject_id"), F.lit(parts)).cast("int")


def _manifests(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/manifest")


def _newest(spark: SparkSession, folder: str) -> tuple[int, dict[int, str | None]]:
    """Number of the newest manifest and the version of every part; a store has a fixed number of parts, so this is bounded."""
    rows = _manifests(spark, folder)
    number = rows.agg(F.max("number")).first()[0]
    return number, {r.part: r.version for r in rows.where(F.col("number") == number).select("part", "version").collect()}


def _publish(spark: SparkSession, folder: str, number: int, batch: str | None, versions: Mapping[int, str | None]) -> None:
    rows = [(number, batch, part, version) for part, version in sorted(versions.items())]
    spark.createDataFrame(rows, "number int, batch string, part int, version string").coalesce(1).write.mode("append").parquet(f"{folder}/manifest")


def _stored(spark: SparkSession, folder: str, table: str, versions: Mapping[int, str | None], schema: str) -> DataFrame:
    paths = [f"{folder}/{table}/{version}/part={part}" for part, version in sorted(versions.items()) if version]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def _schema(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)


def create(spark: SparkSession, folder: str, parts: int = 64) -> None:
    """An empty store.  More parts make smaller rewrites: an update reads and writes the parts of the patients it touches."""
    _publish(spark, folder, 0, None, {part: None for part in range(parts)})


def add(folder: str, batch: str, starts: DataFrame, gap_days: int = GAP_DAYS) -> None:
    """Merge the drug starts of a batch into the store; a batch whose name is known already changes nothing, so a run may be repeated.

    Days are merged by minimum, sum and union of sets; cycles are built again from the merged days for the patients of the batch only, those of other
    patients in the same parts are copied, and the files of other parts stay as they are.  An empty batch only records its name.
    """
    spark = starts.sparkSession
    number, versions = _newest(spark, folder)
    if not _manifests(spark, folder).where(F.col("batch") == batch).isEmpty():
        return
    fresh, part = exposure_days(starts, KEYS), _part(len(versions))
    cycles_schema = _schema(cycles_of_days(fresh, gap_days))
    version = f"{number + 1:06d}-{uuid.uuid4().hex}"
    fresh.withColumn("part", part).write.partitionBy("part").parquet(f"{folder}/fresh/{version}")
    fresh = spark.read.schema(_schema(fresh) + ", part int").parquet(f"{folder}/fresh/{version}")
    touched = {r.part: versions[r.part] for r in fresh.select("part").distinct().collect()}
    if touched:
        old = _stored(spark, folder, "days", touched, _schema(fresh.drop("part")))
        merged = old.unionByName(fresh.drop("part")).groupBy(*KEYS, "start_date").agg(
            F.min("first_starttime_that_day").alias("first_starttime_that_day"), F.sum("n_prescription_rows_that_day").alias("n_prescription_rows_that_day"),
            *[F.array_distinct(F.flatten(F.collect_set(c))).alias(c) for c in ("drugs", "classes")])
        merged.withColumn("part", part).repartition("part").write.partitionBy("part").parquet(f"{folder}/days/{version}")
        now = {p: version for p in touched}
        patients = fresh.select(F.col("subject_id").alias("_touched")).distinct()
        of_batch = F.col("subject_id").eqNullSafe(F.col("_touched"))
        days = _stored(spark, folder, "days", now, _schema(merged)).join(patients, of_batch, "left_semi")
        others = _stored(spark, folder, "cycles", touched, cycles_schema).join(patients, of_batch, "left_anti")
        (others.unionByName(cycles_of_days(days, gap_days)).withColumn("part", part).repartition("part")
         .write.partitionBy("part").parquet(f"{folder}/cycles/{version}"))
        versions |= now
    _publish(spark, folder, number + 1, batch, versions)


def cycles(spark: SparkSession, folder: str, like: DataFrame, windows: Mapping[str, tuple[int, str]]) -> DataFrame:
    """The result of ``cycles_by_class`` over all batches; ``like`` is any frame of drug starts, for the types of its columns."""
    _, versions = _newest(spark, folder)
    return with_windows(_stored(spark, folder, "cycles", versions, _schema(cycles_of_days(exposure_days(like, KEYS)))), windows)
