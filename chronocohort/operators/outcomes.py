"""Cohort membership, coded history and events, echo events, death and follow-up."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronocohort.functions.codes import CANCER_HISTORY, CARDIOMYOPATHY, HEART_FAILURE, PRIOR_CANCER, CodeSet, active_cancer
from chronocohort.operators.exposure import text_set
from chronocohort.operators.temporal import asof_lookback, first_by, range_followup


def eligible_patients(diagnoses: DataFrame) -> DataFrame:
    """Distinct patients with an active or a past cancer code; one scan, one distinct."""
    return diagnoses.where(active_cancer() | CANCER_HISTORY.matches()).select("subject_id").distinct()


def with_admission(coded: DataFrame, anchor: DataFrame, admissions: DataFrame) -> DataFrame:
    """anchor x coded diagnoses (patient) x admissions (admission id).

    The selective code filter has already run, so the patient join sees few rows; neither side is
    broadcast unless Spark measures it small.
    """
    stays = admissions.select("hadm_id", "admittime", "dischtime")
    return coded.select("subject_id", "hadm_id", "icd_code", "icd_version").join(anchor, "subject_id").join(stays, "hadm_id")


def prior_diagnosis_patients(anchor: DataFrame, anchor_time: str, diagnoses: DataFrame, admissions: DataFrame) -> DataFrame:
    """Patients with a cancer code in an admission that began no later than the anchor."""
    rows = with_admission(diagnoses.where(PRIOR_CANCER.matches()), anchor, admissions)
    return rows.where(F.col("admittime") <= F.col(anchor_time)).select("subject_id").distinct()


HISTORY = {"has_pre_existing_hf": HEART_FAILURE, "has_pre_existing_cmp": CARDIOMYOPATHY}


def coded_facts(anchor: DataFrame, diagnoses: DataFrame, admissions: DataFrame, incident: CodeSet,
                history: Mapping[str, CodeSet] = HISTORY, strict_reference: bool = False) -> DataFrame:
    """Per patient, in one pass over the coded rows: history flags and the first incident admission.

    History means discharge at or before the first drug, incident means admission after it; an admission that
    spans the first drug is neither.  ``strict_reference`` drops the date test for version-10 history
    codes, as an AND/OR precedence slip in the joint chains does.
    """
    wanted = incident
    for codes in history.values():
        wanted = wanted | codes
    rows = with_admission(diagnoses.where(wanted.matches()), anchor, admissions)
    before = F.col("dischtime").isNotNull() & (F.col("dischtime") <= F.col("first_drug_time"))

    def past(codes: CodeSet) -> Column:
        hit = codes.matches() & before
        if strict_reference:
            hit = hit | CodeSet({10: codes.versions[10]}).matches()
        return F.max(F.when(hit, 1).otherwise(0))

    is_incident = incident.matches() & (F.col("admittime") > F.col("first_drug_time"))
    per_stay = rows.groupBy("subject_id", "hadm_id", "admittime").agg(
        *[past(codes).alias(name) for name, codes in history.items()],
        F.collect_set(F.when(is_incident, F.col("icd_code"))).alias("codes"))
    event = F.struct("admittime", "hadm_id", text_set(F.col("codes")).alias("codes"))
    return per_stay.groupBy("subject_id").agg(
        *[F.max(name).alias(name) for name in history],
        F.min(F.when(F.size("codes") > 0, event)).alias("e")).select(
        "subject_id", *history,
        F.col("e.admittime").alias("hf_event_time"), F.col("e.hadm_id").alias("hf_hadm_id"),
        F.col("e.codes").alias("hf_icd_codes"))


def history_flags(anchor: DataFrame, facts: DataFrame, history: Sequence[str] = tuple(HISTORY)) -> DataFrame:
    """One row per cohort patient; flags default to 0; combined flags over the two and over all."""
    flags = [F.coalesce(F.col(n), F.lit(0)).alias(n) for n in history]
    out = anchor.select("subject_id").join(facts.select("subject_id", *history), "subject_id", "left").select("subject_id", *flags)
    out = out.withColumn("has_pre_existing_hf_or_cmp", F.greatest("has_pre_existing_hf", "has_pre_existing_cmp"))
    if len(history) > 2:
        out = out.withColumn("has_pre_existing_cardiac", F.greatest(*history))
    return out


def lvef_values(echo: DataFrame, exact_name: bool = False, keep_failed: bool = False) -> DataFrame:
    """LVEF rows with the text result cast safely; ``keep_failed`` keeps rows whose cast gives NULL."""
    named = F.col("measurement") if exact_name else F.lower("measurement")
    rows = echo.where((named == "lvef") & F.col("result").isNotNull()).select(
        "subject_id", "measurement_datetime", F.expr("try_cast(result AS DOUBLE)").alias("lvef_value"))
    return rows if keep_failed else rows.where("lvef_value IS NOT NULL")


def gls_values(echo: DataFrame) -> DataFrame:
    """Strain rows by name pattern; only negative values follow the sign convention."""
    name = F.lower("measurement")
    hit = name.contains("gls") | name.contains("global longitudinal") | name.contains("global_longitudinal")
    return echo.where(hit & F.col("result").isNotNull()).select(
        "subject_id", "measurement_datetime", F.expr("try_cast(result AS DOUBLE)").alias("gls_value")).where("gls_value < 0")


def lvef_drop_events(baseline: DataFrame, lvef: DataFrame, anchor_time: str = "first_drug_time", floor: float | None = 50,
                     inclusive: bool = False) -> DataFrame:
    """Follow-up values at least 10 points under the baseline and below 50."""
    able = baseline.where("baseline_lvef IS NOT NULL")
    if floor is not None:
        able = able.where(F.col("baseline_lvef") >= floor)
    drop = F.col("baseline_lvef") - F.col("lvef_value")
    return (range_followup(able, lvef, anchor_time, inclusive=inclusive)
            .where((drop >= 10) & (F.col("lvef_value") < 50))
            .select("subject_id", F.col("measurement_datetime").alias("event_time"), F.lit("lvef_ctrcd").alias("event_type"),
                    "baseline_lvef", F.col("lvef_value").alias("event_lvef"), drop.alias("lvef_drop_pp")))


def gls_relative_events(baseline: DataFrame, gls: DataFrame, anchor_time: str = "first_drug_time") -> DataFrame:
    """Follow-up strain more than 15 % worse than a negative baseline."""
    change = (F.col("gls_value") - F.col("baseline_gls")) / F.abs("baseline_gls")
    return (range_followup(baseline.where("baseline_gls < 0"), gls, anchor_time).where(change > 0.15)
            .select("subject_id", F.col("measurement_datetime").alias("event_time"),
                    F.lit("gls_subclinical").alias("event_type"), "baseline_gls",
                    F.col("gls_value").alias("event_gls"), change.alias("gls_relative_decrease")))


ECHO_COLUMNS = ["first_echo_event_time", "first_echo_event_type", "baseline_lvef", "event_lvef", "lvef_drop_pp",
                "baseline_gls", "event_gls", "gls_relative_decrease"]


def echo_baselines(anchor: DataFrame, echo: DataFrame) -> tuple[DataFrame, DataFrame]:
    lvef = asof_lookback(anchor, lvef_values(echo), "first_drug_time", "lvef_value", outputs=("baseline_lvef_time", "baseline_lvef"))
    gls = asof_lookback(anchor, gls_values(echo), "first_drug_time", "gls_value", prefer="low",
                        outputs=("baseline_gls_time", "baseline_gls"))
    return lvef, gls


def echo_measures(echo: DataFrame) -> DataFrame:
    """Both kinds in one pass: 0 = LVEF, 1 = strain (negative values only)."""
    name, value = F.lower("measurement"), F.expr("try_cast(result AS DOUBLE)")
    strain = name.contains("gls") | name.contains("global longitudinal") | name.contains("global_longitudinal")
    kind = F.when(name == "lvef", 0).when(strain & (value < 0), 1)
    return (echo.select("subject_id", "measurement_datetime", kind.alias("kind"), value.alias("value"))
            .where("kind IS NOT NULL AND value IS NOT NULL"))


def first_echo_event(anchor: DataFrame, echo: DataFrame, lookback: str = "INTERVAL '365' DAY") -> DataFrame:
    """Earliest LVEF or strain event per patient; LVEF wins ties, then the larger change.

    Two passes over the measurements, whatever the number of kinds: one for the baselines, one for the
    follow-up values against them.
    """
    measures = echo_measures(echo)
    t, v, lvef = F.col("measurement_datetime"), F.col("value"), F.col("kind") == 0
    start = F.col("first_drug_time")
    prior = measures.join(anchor, "subject_id").where((t < start) & (t >= F.expr(f"first_drug_time - {lookback}")))
    base = (prior.groupBy("subject_id", "first_drug_time", "kind")
            .agg(F.max(F.struct(t.alias("t"), F.when(lvef, v).otherwise(-v).alias("r"), v.alias("b"))).alias("m"))
            .select("subject_id", "first_drug_time", "kind", F.col("m.b").alias("base")))
    change = F.when(lvef, F.col("base") - v).otherwise((v - F.col("base")) / F.abs("base"))
    hits = (measures.join(base, ["subject_id", "kind"]).where(t > start).withColumn("change", change)
            .where((lvef & (F.col("base") >= 50) & (F.col("change") >= 10) & (v < 50)) | (~lvef & (F.col("base") < 0) & (F.col("change") > 0.15))))
    first = first_by(hits.withColumn("event_time", t), "subject_id", [t, F.col("kind"), -F.col("change")],
                     ["event_time", "kind", "base", "value", "change"])

    def only(kind: int, column: str) -> Column:
        return F.when(F.col("kind") == kind, F.col(column))

    values = [only(0, "base"), only(0, "value"), only(0, "change"), only(1, "base"), only(1, "value"), only(1, "change")]
    return first.select("subject_id", F.col("event_time").alias("first_echo_event_time"),
                        F.when(lvef, "lvef_ctrcd").otherwise("gls_subclinical").alias("first_echo_event_type"),
                        *[c.alias(n) for c, n in zip(values, ECHO_COLUMNS[2:])])


def combined_event(anchor: DataFrame, facts: DataFrame, echo_event: DataFrame) -> DataFrame:
    """The earlier of admission and echo event, admission winning ties; all detail columns kept."""
    both = (anchor.select("subject_id").join(facts.select("subject_id", "hf_event_time", "hf_hadm_id", "hf_icd_codes"), "subject_id", "left")
            .join(echo_event, "subject_id", "left"))
    hf, echo = F.col("hf_event_time"), F.col("first_echo_event_time")
    kind = F.when(hf.isNotNull() & (echo.isNull() | (hf <= echo)), "hf_admission").otherwise(F.col("first_echo_event_type"))
    return both.select("subject_id", F.least(hf, echo).alias("first_event_time"), kind.alias("first_event_type"),
                       "hf_event_time", "hf_hadm_id", "hf_icd_codes", *ECHO_COLUMNS)


def stay_bounds(admissions: DataFrame) -> DataFrame:
    """Per patient: last admission or discharge, and last in-hospital death time; one pass for both uses."""
    return admissions.groupBy("subject_id").agg(
        F.max(F.greatest("admittime", "dischtime")).alias("last_stay_time"), F.max("deathtime").alias("last_deathtime"))


def death_times(anchor: DataFrame, patients: DataFrame, stays: DataFrame) -> DataFrame:
    """In-hospital time, else the date of death at midnight; only patients with a date of death."""
    dead = patients.where("dod IS NOT NULL").groupBy("subject_id").agg(F.max("dod").alias("dod"))
    return (dead.join(anchor.select("subject_id"), "subject_id", "left_semi").join(stays, "subject_id", "left")
            .select("subject_id", F.coalesce("last_deathtime", F.col("dod").cast("timestamp_ntz")).alias("death_time")))


def last_observations(anchor: DataFrame, starts: DataFrame, stays: DataFrame) -> DataFrame:
    """Latest admission, discharge or cohort drug start per cohort patient."""
    drugs = starts.groupBy("subject_id").agg(F.max("starttime").alias("last_drug"))
    return (anchor.select("subject_id").join(drugs, "subject_id", "left").join(stays, "subject_id", "left")
            .select("subject_id", F.greatest("last_drug", "last_stay_time").alias("last_observation_time")))
