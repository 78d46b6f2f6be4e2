"""Patient-level stratified split by a hash order: deterministic, exclusive, distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronocohort.operators.ordering import prefix_sums

TEST_SHARE = 0.15
VAL_SHARE_OF_REST = 0.15 / (0.70 + 0.15)


def patient_labels(samples: DataFrame) -> DataFrame:
    """A patient is positive when any cycle is."""
    return samples.groupBy("subject_id").agg(F.max("binary_label").alias("patient_label"))


def split_patients(samples: DataFrame, seed: int = 42) -> DataFrame:
    """Per stratum the first max(1, round(share * n)) patients in hash order go to test, the next to val.

    There are only two strata, so each is numbered by prefix sums over 4,096 hash chunks.
    """
    people = patient_labels(samples).withColumn("h", F.md5(F.concat(F.lit(f"{seed}-"), F.col("subject_id").cast("string")))).withColumn("one", F.lit(1))
    ranked = prefix_sums(people, ["patient_label"], [F.col("h"), F.col("subject_id")], F.substring("h", 1, 3), {"rank": "one"})
    sizes = people.groupBy("patient_label").agg(F.count("*").alias("n"))  # one row per label value
    test = F.greatest(F.lit(1), F.bround(F.col("n") * TEST_SHARE, 0)).cast("bigint")
    rest = F.col("n") - F.col("k_test")
    val = F.when(rest > 0, F.greatest(F.lit(1), F.bround(rest * VAL_SHARE_OF_REST, 0)).cast("bigint")).otherwise(0)
    sizes = sizes.withColumn("k_test", test).withColumn("k_val", val).drop("n")
    split = F.when(F.col("rank") <= F.col("k_test"), "test").when(F.col("rank") <= F.col("k_test") + F.col("k_val"), "val").otherwise("train")
    return ranked.join(F.broadcast(sizes), "patient_label").select("subject_id", "patient_label", split.alias("split"))


def check_split(samples: DataFrame, splits: DataFrame) -> DataFrame:
    """Patients of the samples by the number of splits they are in; a clean partition has one row, n_splits = 1."""
    per = samples.select("subject_id").distinct().join(splits.select("subject_id", "split").distinct(), "subject_id", "left")
    return (per.groupBy("subject_id").agg(F.count("split").alias("n_splits")).groupBy("n_splits").agg(F.count("*").alias("n_patients")))


def row_positions(samples: DataFrame) -> DataFrame:
    """0-based row index of each sample in (patient, cycle) order, as positional users of a split need it."""
    from chronocohort.operators.ordering import magnitude_chunk

    one = samples.withColumn("one", F.lit(1))
    order = [F.col("subject_id"), F.col("cycle_number")]
    return (prefix_sums(one, [], order, magnitude_chunk(F.col("subject_id")), {"_i": "one"})
            .withColumn("row_idx", F.col("_i") - 1).drop("one", "_i"))
