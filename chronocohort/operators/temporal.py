"""Temporal joins against one anchor row per patient, and intervals per cycle."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def asof_lookback(anchor: DataFrame, measures: DataFrame, anchor_time: str, value: str, reach: str = "INTERVAL '365' DAY",
                  prefer: str = "high", outputs: tuple[str, str] = ("baseline_time", "baseline")) -> DataFrame:
    """The last measurement strictly before the anchor and no older than ``reach``; NULLs when there is none.

    An equi join on the patient, then one max over (time, value): the aggregate combines before the
    shuffle, so neither the number of measurements nor a hot patient has to fit one task.  Among
    equal times the higher (or lower) value wins; a missing value loses.
    """
    t, v = F.col("measurement_datetime"), F.col(value)
    inside = measures.join(anchor, "subject_id").where(
        (t < F.col(anchor_time)) & (t >= F.expr(f"{anchor_time} - {reach}")))
    rank = v if prefer == "high" else -v
    best = inside.groupBy("subject_id").agg(F.max(F.struct(t.alias("t"), rank.alias("r"), v.alias("v"))).alias("b"))
    return anchor.join(best, "subject_id", "left").select(
        *anchor.columns, F.col("b.t").alias(outputs[0]), F.col("b.v").alias(outputs[1]))


def range_followup(anchor: DataFrame, measures: DataFrame, anchor_time: str, until: str | None = None,
                   inclusive: bool = False) -> DataFrame:
    """Measurements after the anchor (from it, when inclusive), optionally before anchor + ``until``."""
    t = F.col("measurement_datetime")
    after = (t >= F.col(anchor_time)) if inclusive else (t > F.col(anchor_time))
    if until:
        after = after & (t < F.expr(f"{anchor_time} + {until}"))
    return measures.join(anchor, "subject_id").where(after)


def first_by(df: DataFrame, key: str, order: Sequence[Column], keep: Sequence[str]) -> DataFrame:
    """The first row per key by ``order``: a min over a struct, which combines before the shuffle.

    Order columns must not be NULL where it matters; pass coalesced expressions.
    """
    ranked = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)], *[F.col(c) for c in keep])
    return df.groupBy(key).agg(F.min(ranked).alias("m")).select(key, *[F.col(f"m.{c}").alias(c) for c in keep])


def daily_bounds(points: DataFrame, time: str) -> DataFrame:
    """Earliest and latest time per patient and day: all that an interval test needs, bounded by the calendar."""
    return points.groupBy("subject_id", F.to_date(time).alias("day")).agg(
        F.min(time).alias("day_first"), F.max(time).alias("day_last"))


def exists_in_interval(left: DataFrame, points: DataFrame, time: str, after: Column, until: Column, name: str,
                       keys: Sequence[str]) -> DataFrame:
    """0/1: has the patient any point in (after, until]?  Intervals span at least one day.

    Points are first cut to two per day, which loses none that matters to an interval of a day or more; then see ``interval_join``.
    """
    spans = left.select(*keys, after.alias("_a"), until.alias("_u"))
    days = daily_bounds(points, time).select("subject_id", F.explode(F.array("day_first", "day_last")).alias("_p"))
    hit = interval_join(spans, days, ["subject_id"], (F.to_date("_a"), F.to_date("_u")), F.to_date("_p"),
                        (F.col("_p") > F.col("_a")) & (F.col("_p") <= F.col("_u")), "left_semi")
    return left.join(hit.select(*keys).distinct().withColumn(name, F.lit(1)), list(keys), "left").withColumn(name, F.coalesce(F.col(name), F.lit(0)))


def interval_join(spans: DataFrame, points: DataFrame, keys: Sequence[str], span_days: tuple[Column, Column], point_day: Column,
                  holds: Column, how: str = "inner") -> DataFrame:
    """Each span with each point for which ``holds``, or with ``how="left_semi"`` each span that has such a point (maybe twice).

    An index of dyadic time cells: the level of a span is the number of binary digits of its length in days, so it meets at most two cells of
    2^level days; a point has one cell per level.  Rows meet by an equi join on (keys, level, cell) and ``holds``, the exact test, decides.
    So a key's rows are dealt over its cells, no task orders or pairs the whole history of a key, and the candidates of a span lie within
    four times its length.  Points are multiplied by the levels in use alone, a handful and never more than 32.

    ``span_days`` are the first and the last date that may hold a point, ``point_day`` is the date of a point.  Spans with a NULL or a
    last date before the first match nothing, nor do points without date or key.  Column names other than ``keys`` must differ.
    """
    first, last = (F.unix_date(d) for d in span_days)
    leveled = (spans.withColumns({"_first": first, "_last": last}).where("_first <= _last")
               .withColumn("_level", F.length(F.bin(F.col("_last") - F.col("_first")))))
    celled = leveled.withColumn("_cell", F.explode(F.expr("sequence(shiftright(_first, _level), shiftright(_last, _level))")))
    levels = leveled.agg(F.collect_set("_level")).scalar()
    marked = (points.withColumnsRenamed({k: f"_p_{k}" for k in keys}).withColumn("_day", F.unix_date(point_day)).where("_day IS NOT NULL")
              .withColumn("_levels", levels).withColumn("_p_level", F.explode("_levels"))
              .withColumn("_p_cell", F.expr("shiftright(_day, _p_level)")).drop("_levels", "_day"))
    met = reduce(lambda c, k: c & (F.col(k) == F.col(f"_p_{k}")), keys,
                 (F.col("_level") == F.col("_p_level")) & (F.col("_cell") == F.col("_p_cell")))
    return celled.join(marked, met & holds, how).drop("_first", "_last", "_level", "_cell", "_p_level", "_p_cell", *[f"_p_{k}" for k in keys])


def exists_day_between(left: DataFrame, points: DataFrame, day: str, first: str, last: str, name: str,
                       keys: Sequence[str]) -> DataFrame:
    """0/1: has the patient a point on a day between two dates, both included?"""
    days = points.select("subject_id", F.col(day).alias("_d")).distinct()
    spans = left.select(*keys, F.col(first).alias("_f"), F.col(last).alias("_l"))
    hit = interval_join(spans, days, ["subject_id"], (F.col("_f"), F.col("_l")), F.col("_d"), F.col("_d").between(F.col("_f"), F.col("_l")), "left_semi")
    return left.join(hit.select(*keys).distinct().withColumn(name, F.lit(1)), list(keys), "left").withColumn(name, F.coalesce(F.col(name), F.lit(0)))


def first_class_patients(spans: DataFrame, drug_class: str) -> DataFrame:
    """Patients with the class and no other class strictly earlier; equal times keep the patient."""
    mine = spans.where(F.col("drug_class") == drug_class).select("subject_id", F.col("first_class_drug_time").alias("mine"))
    others = spans.where(F.col("drug_class") != drug_class).groupBy("subject_id").agg(
        F.min("first_class_drug_time").alias("other"))
    return mine.join(others, (mine.subject_id == others.subject_id) & (others.other < mine.mine), "left_anti").select("subject_id")
