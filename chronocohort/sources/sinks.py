"""Writers.  Each returns what a later reader sees, so a job can check what it wrote."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_table(df: DataFrame, path: str, sort_columns: Sequence[str] = (), csv: bool = False) -> DataFrame:
    """Parquet, and CSV beside it on request; the global sort is a range shuffle done only here."""
    out = df.orderBy(*sort_columns) if sort_columns else df
    out.write.parquet(f"{path}.parquet")
    written = df.sparkSession.read.parquet(f"{path}.parquet")
    if csv:
        written.write.option("header", True).csv(f"{path}.csv")
    return written


def split_membership(samples: DataFrame, splits: DataFrame, seed: int) -> DataFrame:
    """One row per patient: split, cycle count and its row indices joined by ';'."""
    return (samples.join(splits.select("subject_id", "split"), "subject_id")
            .groupBy("split", "subject_id")
            .agg(F.count("*").alias("n_cycles"),
                 F.array_join(F.transform(F.array_sort(F.collect_list("row_idx")), lambda x: x.cast("string")), ";")
                 .alias("row_indices"))
            .select(F.lit(seed).alias("seed"), "split", "subject_id", "n_cycles", "row_indices"))


def prediction_rows(scored: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The per-sample result table with the thresholded prediction and a correctness flag."""
    predicted = (F.col("prob_cardiotoxic") >= threshold).cast("int")
    return scored.select(
        "split", "split_pos", "row_idx", "subject_id", "cycle_number", "prediction_time", "true_label",
        predicted.alias("pred_label"), F.round("prob_cardiotoxic", 6).alias("prob_cardiotoxic"),
        (predicted == F.col("true_label")).cast("int").alias("correct"))
