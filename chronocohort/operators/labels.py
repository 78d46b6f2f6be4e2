"""Window labels.  The label is derived once; every flag follows from it and the history flag."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EXCLUDED, POSITIVE, CENSORED, NEGATIVE, UNKNOWN = (
    "exclude_already_toxic", "positive", "censored_death", "negative_observed", "unknown_insufficient_followup")
UNKNOWN_MAIN = "unknown_no_followup_evidence"


def window_end() -> Column:
    return F.expr("prediction_time + toxicity_window_days * INTERVAL '1' DAY")


def _binary(label: Column) -> Column:
    return F.when(label == POSITIVE, 1).when(label == NEGATIVE, 0)


def label_five_way(df: DataFrame, event: str, died_name: str = "died_in_window_before_event",
                   history: str = "has_pre_existing_hf_or_cmp") -> DataFrame:
    """Already toxic, positive, censored by death, negative observed, insufficient follow-up: first match wins.

    Needs prediction_time, prediction_window_end, death_time, last_observation_time, the event and history columns.
    The window is (index, end]; an event inside it wins over an earlier death.
    """
    ev, start, end, death = F.col(event), F.col("prediction_time"), F.col("prediction_window_end"), F.col("death_time")
    died = (death > start) & (death <= end) & (ev.isNull() | (ev > death))
    seen = F.col("last_observation_time") >= end
    label = F.col("label")
    modelled = label.isin(POSITIVE, NEGATIVE).cast("int")
    return (df.withColumn("observed_through_prediction_window", F.when(seen, 1).otherwise(0))
            .withColumn(died_name, F.when(died, 1).otherwise(0))
            .withColumn("label", F.when(ev <= start, EXCLUDED).when(ev <= end, POSITIVE).when(died, CENSORED)
                        .when(seen, NEGATIVE).otherwise(UNKNOWN))
            .withColumn("binary_label", _binary(label))
            .withColumn("eligible_strict", F.when(F.col(history) == 1, 0).otherwise(modelled))
            .withColumn("eligible_inclusive", modelled))


def label_four_way(df: DataFrame, event: str = "first_toxicity_time") -> DataFrame:
    """The older labels: no death class, follow-up evidence decides."""
    ev, start, end = F.col(event), F.col("prediction_time"), F.col("prediction_window_end")
    seen = F.col("last_observation_time") >= end
    label = F.col("label")
    return (df.withColumn("toxicity_in_window", F.when((ev > start) & (ev <= end), 1).otherwise(0))
            .withColumn("observed_through_prediction_window", F.when(seen, 1).otherwise(0))
            .withColumn("label", F.when(ev <= start, EXCLUDED).when(ev <= end, POSITIVE).when(seen, NEGATIVE)
                        .otherwise(UNKNOWN_MAIN))
            .withColumn("binary_label", _binary(label))
            .withColumn("eligible_for_binary_label", label.isin(POSITIVE, NEGATIVE).cast("int")))


def binary_table(table: DataFrame, eligible: str = "eligible_inclusive", baseline_floor: float | None = None) -> DataFrame:
    """Rows with a usable label; the newer main chain also asks for a baseline that is missing or high enough."""
    kept = table.where((F.col(eligible) == 1) & F.col("label").isin(POSITIVE, NEGATIVE))
    if baseline_floor is not None:
        kept = kept.where(F.col("baseline_lvef").isNull() | (F.col("baseline_lvef") >= baseline_floor))
    return kept


HORIZONS = (90, 180, 365)


def multi_horizon(samples: DataFrame, event: str = "first_event_time") -> DataFrame:
    """Each sample three times: 90- and 180-day labels from the event time, 365 keeps the label.

    The event must lie after the index, at most w whole-or-fractional days later.
    """
    ev, start = F.col(event), F.col("prediction_time")
    tasks = []
    for task, days in enumerate(HORIZONS):
        inside = (ev > start) & (ev <= F.expr(f"prediction_time + INTERVAL '{days}' DAY"))
        label = F.col("binary_label") if days == 365 else F.when(inside, 1).otherwise(0)
        tasks.append(F.struct(F.lit(task).alias("task_id"), F.lit(days).alias("window_days"), label.cast("int").alias("task_label")))
    keep = [c for c in samples.columns if c not in ("binary_label", event)]
    return samples.select("*", F.explode(F.array(*tasks)).alias("t")).select(
        *keep, "t.task_id", "t.window_days", F.col("t.task_label").alias("binary_label"))
