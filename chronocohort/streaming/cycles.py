"""Exposure cycles of a stream of drug starts: session state with a watermark, and a batch step that makes the result whole."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronocohort.operators.exposure import GAP_DAYS, cycles_of_days, exposure_days, text_set, with_windows
from chronocohort.operators.ordering import union_all

KEYS = ["subject_id", "drug_class"]
_LOCAL_MERGE = "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition"


def _drug_lists(pairs: Column) -> Column:
    """The distinct drug lists of the days of a cycle, out of its distinct (day, drug) pairs."""
    days = F.array_distinct(F.transform(pairs, lambda p: p["day"]))
    one_day = lambda d: text_set(F.array_distinct(F.transform(F.filter(pairs, lambda p: p["day"] == d), lambda p: p["drug"])))
    return text_set(F.array_distinct(F.transform(days, one_day)))


def closed_cycles(starts: DataFrame, lateness: str = "30 days", gap_days: int = GAP_DAYS) -> DataFrame:
    """Cycles per patient and class of a streamed table of drug starts; each comes out once, when the watermark has passed its end.

    The state of an open cycle is its distinct (day, drug) pairs and counts, so it is bounded by the calendar and the drugs, not by rows.  A start
    that comes up to ``lateness`` after later ones joins its cycle or merges two; what comes later still is not in any closed cycle
    (see ``whole_cycles``).  Days are those of the session's time zone.
    """
    # gaps are counted in days, so half a day more than the gap parts them without relying on whether its bound belongs to the session
    session = F.session_window("day", f"{gap_days * 24 + 12} hours").alias("session")
    days = starts.withColumn("day", F.to_date("starttime").cast("timestamp")).withWatermark("day", lateness)
    cycles = days.groupBy(*KEYS, session).agg(
        F.min("starttime").alias("prediction_time"), F.to_date(F.min("day")).alias("cycle_start_date"), F.to_date(F.max("day")).alias("cycle_end_date"),
        F.collect_set(F.struct("day", "drug")).alias("pairs"), F.count("*").alias("n_prescription_rows_in_cycle"))
    return cycles.select(
        *KEYS, "prediction_time", "cycle_start_date", "cycle_end_date",
        F.size(F.array_distinct(F.transform("pairs", lambda p: p["day"]))).cast("long").alias("n_exposure_start_days_in_cycle"),
        "n_prescription_rows_in_cycle", _drug_lists(F.col("pairs")).alias("drugs_in_cycle"))


def append_cycles(starts: DataFrame, out: str, checkpoint: str, lateness: str = "30 days", gap_days: int = GAP_DAYS) -> None:
    """Bring the Parquet table ``out`` of closed cycles up to what the stream holds now.

    Call again when more has come: offsets and open cycles are kept under ``checkpoint``, a folder all executors reach, and a run that
    was cut off goes on where it stopped.  Sessions are merged before the shuffle, so a key with most of the rows sends its sessions alone.
    """
    spark = starts.sparkSession
    before = spark.conf.get(_LOCAL_MERGE, None)
    spark.conf.set(_LOCAL_MERGE, "true")
    try:
        (closed_cycles(starts, lateness, gap_days).writeStream.format("parquet").outputMode("append").option("path", out)
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination())
    finally:
        if before is None:
            spark.conf.unset(_LOCAL_MERGE)
        else:
            spark.conf.set(_LOCAL_MERGE, before)


def whole_cycles(closed: DataFrame, starts: DataFrame, windows: Mapping[str, tuple[int, str]], gap_days: int = GAP_DAYS) -> DataFrame:
    """The result of ``cycles_by_class`` over ``starts``, with ``closed`` cycles taken as they are where they hold all their rows.

    Open cycles are the rows after a key's last closed day.  A key is built anew as a whole if rows came too late for its closed cycles: if these
    count other than the rows up to that day, or if a later row lies within the gap.  Cycles are numbered here, over both kinds.
    """
    ends = closed.groupBy(*KEYS).agg(F.max("cycle_end_date").alias("_end"), F.sum("n_prescription_rows_in_cycle").alias("_closed"))
    # keys may be NULL, and a NULL key is a key
    same = lambda a, b: F.col(f"{a}.subject_id").eqNullSafe(F.col(f"{b}.subject_id")) & F.col(f"{a}.drug_class").eqNullSafe(F.col(f"{b}.drug_class"))
    dated = starts.alias("s").join(ends.alias("e"), same("s", "e"), "left").select("s.*", "_end", "_closed").withColumn("_day", F.to_date("starttime"))
    late = (dated.where("_end IS NOT NULL").groupBy(*KEYS, "_end", "_closed")
            .agg(F.count_if(F.col("_day") <= F.col("_end")).alias("_seen"), F.min(F.when(F.col("_day") > F.col("_end"), F.col("_day"))).alias("_next"))
            .where((F.col("_seen") != F.col("_closed")) | (F.datediff("_next", "_end") <= gap_days)).select(*KEYS, F.lit(True).alias("_late")))
    left = dated.alias("s").join(late.alias("l"), same("s", "l"), "left").where("_end IS NULL OR _day > _end OR _late").select(*[f"s.{c}" for c in starts.columns])
    kept = closed.alias("c").join(late.alias("l"), same("c", "l"), "left_anti")
    built = cycles_of_days(exposure_days(left, KEYS), gap_days)
    facts = [c for c in closed.columns if c not in KEYS]
    both = union_all([kept.select(*KEYS, *facts), built.select(*KEYS, *facts)])
    numbered = both.withColumn("cycle_number", F.row_number().over(Window.partitionBy(*KEYS).orderBy("cycle_start_date")))
    return with_windows(numbered, windows)
