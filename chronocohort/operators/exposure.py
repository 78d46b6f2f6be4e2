"""Drug exposures: classification, start days, gaps, cycles."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronocohort.functions.drugs import FALLBACK_DAYS, TEN_CLASSES, Classifier, window_table
from chronocohort.session import durable

GAP_DAYS = 7


def text_set(items: Column) -> Column:
    """A set of texts in order, joined the way the output tables show it."""
    return F.array_join(F.array_sort(items), " | ")


def listed_drugs(prescriptions: DataFrame, pattern: str) -> DataFrame:
    """Rows with a start time whose lower-cased drug matches ``pattern``."""
    return (prescriptions.where(F.col("drug").isNotNull() & F.col("starttime").isNotNull())
            .withColumn("drug", F.lower("drug")).where(F.col("drug").rlike(pattern)))


def listed_drugs_like(prescriptions: DataFrame, terms: Sequence[str]) -> DataFrame:
    """The substring form of the prefilter."""
    hit = F.lit(False)
    for term in terms:
        hit = hit | F.col("drug").contains(term)
    return (prescriptions.where(F.col("drug").isNotNull() & F.col("starttime").isNotNull())
            .withColumn("drug", F.lower("drug")).where(hit))


def classify(prescriptions: DataFrame, classifier: Classifier) -> DataFrame:
    """Listed drugs with their class.  Without a fallback, an unclassified row is no exposure and goes.

    Tables repeat a few thousand drug names billions of times, so the patterns run once per distinct name; the rows
    then take their class from the table of listed names.  Its size is measured when it is there: Spark broadcasts it if it is small and
    splits hot names otherwise.  Names and listed names are stored, or Spark would move the patterns below the distinct and, as the join's
    condition holds for both sides, to every row.
    """
    base = (prescriptions.where(F.col("drug").isNotNull() & F.col("starttime").isNotNull())
            .withColumn("drug", F.lower("drug")))
    names = durable(base.select("drug").distinct())
    listed = durable(names.where(F.col("drug").rlike(classifier.any_name)).withColumn(
        "drug_class", classifier.class_of(F.col("drug"))).where("drug_class IS NOT NULL"))
    return base.join(listed, "drug").select(*base.columns, "drug_class")


def first_exposure(starts: DataFrame, name: str = "first_drug_time") -> DataFrame:
    return starts.groupBy("subject_id").agg(F.min("starttime").alias(name))


def class_span(starts: DataFrame) -> DataFrame:
    return starts.groupBy("subject_id", "drug_class").agg(
        F.min("starttime").alias("first_class_drug_time"), F.max("starttime").alias("last_class_drug_time"))


def exposure_days(starts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per key and calendar day, with the distinct drugs and classes of the day as arrays.

    This is the pre-aggregation everything later builds on: after it a patient has at most one row per
    day (and class), so the windows over days are bounded by the calendar, however many rows came in.
    """
    return starts.groupBy(*keys, F.to_date("starttime").alias("start_date")).agg(
        F.min("starttime").alias("first_starttime_that_day"),
        F.count("*").alias("n_prescription_rows_that_day"),
        F.collect_set("drug").alias("drugs"),
        F.collect_set("drug_class").alias("classes"))


def with_gaps(days: DataFrame, keys: Sequence[str]) -> DataFrame:
    previous = F.lag("start_date").over(Window.partitionBy(*keys).orderBy("start_date"))
    return (days.withColumn("previous_start_date", previous)
            .withColumn("days_since_previous_start", F.datediff("start_date", "previous_start_date")))


def with_cycles(days: DataFrame, keys: Sequence[str], gap_days: int = GAP_DAYS) -> DataFrame:
    """A gap of more than ``gap_days`` opens the next cycle; the cycle number is the running sum of openings."""
    opens = F.when(F.col("previous_start_date").isNull() | (F.col("days_since_previous_start") > gap_days), 1).otherwise(0)
    running = Window.partitionBy(*keys).orderBy("start_date").rowsBetween(Window.unboundedPreceding, 0)
    return (with_gaps(days, keys).withColumn("is_new_cycle", opens)
            .withColumn("cycle_number", F.sum("is_new_cycle").over(running).cast("int")))


def _span() -> list[Column]:
    return [F.min("first_starttime_that_day").alias("prediction_time"),
            F.min("start_date").alias("cycle_start_date"),
            F.max("start_date").alias("cycle_end_date"),
            F.count_distinct("start_date").alias("n_exposure_start_days_in_cycle"),
            F.sum("n_prescription_rows_that_day").alias("n_prescription_rows_in_cycle")]


def cycles_of_days(days: DataFrame, gap_days: int = GAP_DAYS) -> DataFrame:
    """Cycles per patient and class out of their exposure days.  The drug list joins the distinct *day lists*, as defined."""
    keys = ["subject_id", "drug_class"]
    days = with_cycles(days, keys, gap_days).withColumn("day_list", text_set(F.col("drugs")))
    # start_date is unique per key here, so counting rows counts distinct days
    spans = [c for c in _span()]
    spans[3] = F.count("*").alias("n_exposure_start_days_in_cycle")
    return days.groupBy(*keys, "cycle_number").agg(*spans, text_set(F.collect_set("day_list")).alias("drugs_in_cycle"))


def with_windows(cycles: DataFrame, windows: Mapping[str, tuple[int, str]]) -> DataFrame:
    """Cycles per patient and class with the toxicity window of the class."""
    return cycles.join(F.broadcast(window_table(cycles.sparkSession, windows)), "drug_class", "left").select(
        "subject_id", "drug_class", "cycle_number", "prediction_time", "cycle_start_date", "cycle_end_date",
        "n_exposure_start_days_in_cycle", "n_prescription_rows_in_cycle", "drugs_in_cycle",
        "toxicity_window_days", "window_rationale")


def cycles_by_class(starts: DataFrame, windows: Mapping[str, tuple[int, str]], gap_days: int = GAP_DAYS) -> DataFrame:
    """Cycles per patient and class, with windows."""
    return with_windows(cycles_of_days(exposure_days(starts, ["subject_id", "drug_class"]), gap_days), windows)


def _class_lookup(windows: Mapping[str, tuple[int, str]], part: int) -> Column:
    return F.create_map(*[F.lit(x) for name, spec in windows.items() for x in (name, spec[part])])


def class_flags(classes: Column, names: Sequence[str] = tuple(TEN_CLASSES)) -> list[Column]:
    return [F.array_contains(classes, n).cast("int").alias(f"exposed_{n}") for n in names]


def cycles_joint(starts: DataFrame, windows: Mapping[str, tuple[int, str]] | None, fallback_text: str = "fallback",
                 gap_days: int = GAP_DAYS, strict_reference: bool = False) -> DataFrame:
    """Cycles per patient over all classes.

    ``windows=None`` gives every cycle the uniform window and no rationale column.  The counts are
    those of the days; ``strict_reference`` multiplies them by the rows of each day, which is what joining
    the days back to the raw rows does.  The sets come from the day arrays, so the raw rows are read once.
    """
    keys = ["subject_id"]
    days = with_cycles(exposure_days(starts, keys), keys, gap_days)
    rows = F.col("n_prescription_rows_that_day")
    spans = _span()
    spans[3] = F.count("*").alias("n_exposure_start_days_in_cycle")
    if strict_reference:
        spans[4] = F.sum(rows * rows).alias("n_prescription_rows_in_cycle")
    cycles = days.groupBy(*keys, "cycle_number").agg(
        *spans,
        F.array_distinct(F.flatten(F.collect_set("drugs"))).alias("drugs"),
        F.array_distinct(F.flatten(F.collect_set("classes"))).alias("classes"))
    head = ["subject_id", "cycle_number", "prediction_time", "cycle_start_date", "cycle_end_date",
            "n_exposure_start_days_in_cycle", "n_prescription_rows_in_cycle",
            text_set(F.col("drugs")).alias("drugs_in_cycle"), text_set(F.col("classes")).alias("drug_classes_in_cycle")]
    if windows is None:
        return cycles.select(*head, F.lit(FALLBACK_DAYS).alias("toxicity_window_days"), *class_flags(F.col("classes")))
    days_of, why_of = _class_lookup(windows, 0), _class_lookup(windows, 1)
    longest = F.array_max(F.transform("classes", lambda c: F.coalesce(F.try_element_at(days_of, c), F.lit(FALLBACK_DAYS))))
    reasons = F.array_distinct(F.transform("classes", lambda c: F.coalesce(F.try_element_at(why_of, c), F.lit(fallback_text))))
    return cycles.select(*head, longest.alias("toxicity_window_days"), text_set(reasons).alias("window_rationales"),
                         *class_flags(F.col("classes")))


def join_days_to_rows(starts: DataFrame) -> DataFrame:
    """Cycle days joined back to the raw rows of the day: the fan-out form of the joint cycle counts."""
    days = with_cycles(exposure_days(starts, ["subject_id"]), ["subject_id"]).select(
        "subject_id", "start_date", "cycle_number", "n_prescription_rows_that_day")
    raw = starts.select("subject_id", F.to_date("starttime").alias("start_date"), "pharmacy_id", "drug", "drug_class")
    return raw.join(days, ["subject_id", "start_date"])
