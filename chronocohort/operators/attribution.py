"""Aggregations of token attribution rows: sample keys, position, token, rollout_score, ig_score_l2, ig_score_signed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronocohort.functions import scalars as S


def described(df: DataFrame) -> DataFrame:
    return df.withColumn("label", S.token_label(F.col("token"))).withColumn("event_type", S.token_type(F.col("token")))


def population(df: DataFrame) -> DataFrame:
    """Mean, sample deviation, standard error and |mean| of the signed score per token."""
    out = described(df).groupBy("token", "label", "event_type").agg(
        F.avg("ig_score_signed").alias("mean_ig_signed"), F.stddev_samp("ig_score_signed").alias("std_ig_signed"), F.count("*").alias("n"))
    return out.withColumn("sem_ig_signed", F.col("std_ig_signed") / F.sqrt("n")).withColumn("abs_mean_ig", F.abs("mean_ig_signed"))


def feature_aggregation(df: DataFrame, sample: Sequence[str]) -> DataFrame:
    """Per sample and token: occurrences, mean scores, where and when they lie."""
    return described(df).groupBy(*sample, "token", "label", "event_type").agg(
        F.count("*").alias("n"), F.avg("rollout_score").alias("mean_rollout"), F.avg("ig_score_l2").alias("mean_ig_l2"),
        F.avg("ig_score_signed").alias("mean_ig_signed"), F.stddev_samp("ig_score_signed").alias("std_ig_signed"),
        F.avg("visit").alias("mean_visit"), F.avg("days_before").alias("mean_days_before"),
        F.min("days_before").alias("earliest_days"), F.max("days_before").alias("latest_days"))


def by_event_type(df: DataFrame) -> DataFrame:
    """Summed scores per event type with its place in the fixed order; absent types do not appear."""
    place = S.literal_map({name: i for i, name in enumerate(S.EVENT_TYPES)})
    return (described(df).groupBy("event_type").agg(F.sum("rollout_score").alias("rollout_score"), F.sum("ig_score_l2").alias("ig_score_l2"))
            .withColumn("place", F.try_element_at(place, F.col("event_type"))))


def top_tokens(df: DataFrame, k: int, score: str = "ig_score_l2") -> DataFrame:
    """The k rows with the highest score over everything; each task keeps k rows."""
    return df.orderBy(F.desc(score), *[F.col(c) for c in df.columns if c != score]).limit(k)


def token_by_cycle(df: DataFrame, patient: str, cycle: str, k: int) -> DataFrame:
    """Top-k tokens of a patient over all its cycles, one row per token and cycle in which it occurs, with the highest score there.

    Candidates are the tokens at the k best positions of each cycle; of these the k with the highest score in any cycle stay, ranked by it.
    A cycle without a row counts 0.  Both rank limits run before the shuffle too, so a long sequence does not gather in one task.
    """
    best = Window.partitionBy(patient, cycle).orderBy(F.desc("rollout_score"), "token", "position")
    candidates = df.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k).select(patient, "token").distinct()
    cells = df.groupBy(patient, "token", cycle).agg(F.max("rollout_score").alias("score")).join(candidates, [patient, "token"], "left_semi")
    order = Window.partitionBy(patient).orderBy(F.desc("peak"), "token")
    ranked = (cells.groupBy(patient, "token").agg(F.max("score").alias("peak")).withColumn("rank", F.row_number().over(order))
              .where(F.col("rank") <= k).drop("peak"))
    return cells.join(ranked, [patient, "token"])
