"""Clinical event timeline: visits, four event types as tokens, quartile buckets, vocabulary, encoding."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronocohort.functions import scalars as S
from chronocohort.operators.ordering import dense_ranks, exact_quantiles, large_keys, running_index, union_all
from chronocohort.session import durable

QUARTILES = {"p25": 0.25, "p50": 0.5, "p75": 0.75}
COLUMNS = ["subject_id", "hadm_id", "admittime", "event_time", "event_type", "concept_token", "event_priority", "visit_id"]


def join_fitted(big: DataFrame, fitted: DataFrame, on: list[str], stored: bool = False) -> DataFrame:
    """Left join to a fitted lookup (vocabulary, cut-offs) whose keys may be hot in ``big``.

    The lookup is written once to the shared folder (unless ``stored`` says it is), so Spark plans with its true size: a small one is
    broadcast, and where it is not, hot keys are split at run time.
    """
    return big.join(fitted if stored else durable(fitted), on, "left")


def visits(admissions: DataFrame, subjects: DataFrame | None = None) -> DataFrame:
    """Admissions of the cohort with a running visit number per patient by (admission time, id)."""
    kept = admissions.select("subject_id", "hadm_id", "admittime", "dischtime")
    if subjects is not None:
        kept = kept.join(subjects.select("subject_id").distinct(), "subject_id", "left_semi")
    chunk = F.coalesce(F.date_trunc("HOUR", "admittime"), F.lit("9999-12-31").cast("timestamp"))
    return running_index(kept, ["subject_id"], [F.col("admittime").asc_nulls_last(), F.col("hadm_id").asc()], chunk, "visit_id", large_keys(admissions, ["subject_id"]))


def _stay(visit_rows: DataFrame, *columns: str) -> DataFrame:
    """What events take from their admission.

    The condition holds for all visits; with one, Spark counts them as a selection and may filter the events by their admissions before it shuffles them.
    """
    return visit_rows.where("coalesce(visit_id, 0) >= 0").select("hadm_id", "admittime", "visit_id", *columns)


def _coded(kind: str) -> Column:
    return F.concat(F.lit(f"{kind}::"), "icd_code", F.lit("_ICDver"), F.col("icd_version").cast("string"))


def diagnosis_events(diagnoses: DataFrame, visit_rows: DataFrame) -> DataFrame:
    """Dated at discharge."""
    return diagnoses.join(_stay(visit_rows, "dischtime"), "hadm_id").select(
        "subject_id", "hadm_id", "admittime", F.col("dischtime").alias("event_time"), F.lit("diagnosis").alias("event_type"),
        _coded("diagnosis").alias("concept_token"), F.col("seq_num").alias("event_priority"), "visit_id")


def procedure_events(procedures: DataFrame, visit_rows: DataFrame) -> DataFrame:
    return procedures.join(_stay(visit_rows), "hadm_id").select(
        "subject_id", "hadm_id", "admittime", F.col("chartdate").cast("timestamp_ntz").alias("event_time"),
        F.lit("procedure").alias("event_type"), _coded("procedure").alias("concept_token"),
        F.col("seq_num").alias("event_priority"), "visit_id")


def medication_rows(prescriptions: DataFrame, visit_rows: DataFrame) -> DataFrame:
    """Dated prescriptions of cohort admissions with the normalised name and 0-based order within a start time.

    What the order needs of a row is worked out before the join, so a column that nothing else reads (the dose, without buckets) is not shuffled.
    """
    number = F.coalesce("pharmacy_id", F.lit(-1))
    # rows without a number are ordered by name alone, so names cut them; rows of one name may be exchanged, so a hash of the dose cuts those
    same = F.pmod(F.xxhash64("dose_val_rx"), F.lit(64))
    dated = prescriptions.where("starttime IS NOT NULL").withColumns({
        "drug_norm": F.trim(F.lower(F.coalesce("drug", F.lit("nan")))), "_same": F.when(number == -1, same).otherwise(0)}).drop("drug")
    chunk = F.struct(F.floor(number / 4096).alias("n"), F.when(number == -1, F.col("drug_norm")).otherwise("").alias("d"), F.col("_same").alias("s"))
    ranked = running_index(dated.join(_stay(visit_rows), "hadm_id"), ["subject_id", "hadm_id", "starttime"], [number, F.col("drug_norm"), F.col("visit_id")], chunk, "_rank",
                           large_keys(prescriptions, ["hadm_id"]))
    return ranked.withColumn("event_priority", (F.col("_rank") - 1).cast("int")).drop("_rank", "_same")


def medication_events(prescriptions: DataFrame, visit_rows: DataFrame, bucket: bool = False) -> DataFrame:
    rows = medication_rows(prescriptions, visit_rows)
    token = F.concat(F.lit("medication::"), F.col("drug_norm"))
    if bucket:
        rows = rows.withColumn("dose", S.first_number(F.col("dose_val_rx")))
        rows = join_fitted(rows, exact_quantiles(rows, ["drug_norm"], "dose", QUARTILES), ["drug_norm"])
        token = F.concat(token, S.quartile_suffix(F.col("dose"), F.col("p25"), F.col("p50"), F.col("p75"), "_dose_Q"))
    return rows.select("subject_id", "hadm_id", "admittime", F.col("starttime").alias("event_time"),
                       F.lit("medication").alias("event_type"), token.alias("concept_token"), "event_priority", "visit_id")


def lab_rows(labevents: DataFrame, visit_rows: DataFrame, panel: str = "abnormal", cardiac_only: bool = False) -> DataFrame:
    """Stored labs of cohort patients and admissions; ``panel`` is 'abnormal' (flag set) or 'all'."""
    if panel not in ("abnormal", "all"):
        raise ValueError(f"panel must be 'abnormal' or 'all', not {panel!r}")
    kept = labevents.where("storetime IS NOT NULL")
    if panel == "abnormal":
        kept = kept.where("flag IS NOT NULL")
    if cardiac_only:
        kept = kept.where(F.col("itemid").isin(S.CARDIAC_LABS))
    subjects = visit_rows.select("subject_id").distinct()
    return kept.join(_stay(visit_rows), "hadm_id").join(subjects, "subject_id", "left_semi")


def lab_events(labevents: DataFrame, visit_rows: DataFrame, panel: str = "abnormal", cardiac_only: bool = False,
               bucket: bool = False) -> DataFrame:
    rows = lab_rows(labevents, visit_rows, panel, cardiac_only)
    token = F.concat(F.lit("lab::"), F.col("itemid").cast("string"))
    if bucket:
        rows = join_fitted(rows, exact_quantiles(rows, ["itemid"], "valuenum", QUARTILES), ["itemid"])
        token = F.concat(token, S.quartile_suffix(F.col("valuenum"), F.col("p25"), F.col("p50"), F.col("p75"), "_Q"))
    return rows.select("subject_id", "hadm_id", "admittime", F.col("storetime").alias("event_time"), F.lit("lab").alias("event_type"),
                       token.alias("concept_token"), F.lit(0).alias("event_priority"), "visit_id")


@dataclass(frozen=True)
class TimelineOptions:
    panel: str = "abnormal"
    cardiac_only: bool = False
    bucket_labs: bool = False
    bucket_medications: bool = False


def timeline(tables, subjects: DataFrame | None = None, options: TimelineOptions = TimelineOptions()) -> DataFrame:
    """All dated events of the cohort's admissions, one row each."""
    v = durable(visits(tables.admissions, subjects))  # all four kinds of events read it
    events = union_all([
        diagnosis_events(tables.diagnoses, v),
        procedure_events(tables.procedures, v),
        medication_events(tables.prescriptions, v, options.bucket_medications),
        lab_events(tables.labevents, v, options.panel, options.cardiac_only, options.bucket_labs)])
    return (events.where("event_time IS NOT NULL").withColumn("visit_id", F.coalesce("visit_id", F.lit(0)).cast("int"))
            .withColumn("event_priority", F.col("event_priority").cast("int")).select(*COLUMNS))


def vocabulary(events: DataFrame) -> DataFrame:
    """token -> id: reserved tokens first, then the distinct tokens in binary order, dense from 0."""
    spark = events.sparkSession
    reserved = spark.sql("SELECT * FROM VALUES " + ", ".join(f"('{t}', {i})" for i, t in enumerate(S.RESERVED)) + " AS r(token, id)")
    found = events.select(F.col("concept_token").alias("token")).where("token IS NOT NULL").distinct().where(~F.col("token").isin(S.RESERVED))
    return reserved.unionByName(dense_ranks(found, "token", "n").select("token", (F.col("n") + len(S.RESERVED)).cast("int").alias("id")))


def encode(events: DataFrame, vocab: DataFrame) -> DataFrame:
    """Token and type ids; a token outside the (stored) vocabulary becomes [UNK], an unknown type 'special'."""
    types = S.literal_map(S.TYPE_IDS)
    lookup = vocab.select(F.col("token").alias("concept_token"), F.col("id").alias("_id"))
    return join_fitted(events, lookup, ["concept_token"], stored=True).select(
        *events.columns, F.coalesce("_id", F.lit(S.UNK)).alias("concept_id"),
        F.coalesce(F.try_element_at(types, F.col("event_type")), F.lit(0)).alias("type_id"))
