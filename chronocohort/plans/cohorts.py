"""Cohort plans: one spec per variant, one build for the newer chains, one for the older, one for the year master."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronocohort.functions import codes as C
from chronocohort.functions import drugs as D
from chronocohort.operators import exposure as X
from chronocohort.operators import labels as L
from chronocohort.operators import outcomes as O
from chronocohort.operators import temporal as T
from chronocohort.operators.ordering import union_all
from chronocohort.session import durable


@dataclass(frozen=True)
class CohortSpec:
    name: str
    grain: str = "by_class"  # or "joint"
    classifier: D.Classifier = D.TEN
    windows: Mapping[str, tuple[int, str]] | None = field(default_factory=lambda: D.WINDOWS_UNIFORM)
    incident: C.CodeSet = C.BROAD_CV
    history: Mapping[str, C.CodeSet] = field(default_factory=lambda: O.HISTORY)
    echo: bool = True
    strict_history: str = "has_pre_existing_hf_or_cmp"
    first_class: str | None = None
    strict_reference: bool = False


SPECS = {s.name: s for s in [
    CohortSpec("pan_cancer_ctrcd"),
    CohortSpec("pan_cancer_bimodal", windows=D.WINDOWS_BIMODAL),
    CohortSpec("broad_cv", history={**O.HISTORY, "has_pre_existing_arrhythmia": C.ARRHYTHMIA},
               strict_history="has_pre_existing_cardiac"),
    CohortSpec("narrow_cv", incident=C.NARROW_CV),
    CohortSpec("hf", classifier=D.THREE, windows=D.WINDOWS_THREE, incident=C.HEART_FAILURE, echo=False),
    CohortSpec("hf_v2", classifier=D.THREE, windows=D.WINDOWS_THREE, incident=C.HEART_FAILURE),
    CohortSpec("first_class_only", windows=D.WINDOWS_FIRST_CLASS, first_class="anthracycline"),
    CohortSpec("per_cycle", grain="joint", windows=D.WINDOWS_PER_CYCLE, incident=C.HEART_FAILURE),
    CohortSpec("uniform_365", grain="joint", windows=None, incident=C.HEART_FAILURE),
    CohortSpec("per_cycle_strict", grain="joint", windows=D.WINDOWS_PER_CYCLE, incident=C.HEART_FAILURE, strict_reference=True),
]}


def kept(tables, name: str, build) -> DataFrame:
    """A part that several cohorts share, written once: among the stages of ``tables`` if it keeps any, else for this use."""
    return tables.stage(name, build) if hasattr(tables, "stage") else durable(build())


def shared_name(classifier: D.Classifier) -> str:
    known = {"ten": D.TEN, "three": D.THREE, "main_v1": D.MAIN_V1, "main_v2": D.MAIN_V2}
    return next((k for k, v in known.items() if v == classifier), f"classes_{hash(repr(classifier)) & 0xFFFFFFFF:08x}")


class Cohort:
    """Stages of one cohort over clinical tables; each stage is a lazy DataFrame.

    Cohorts of one classifier share drug starts, index times, echo events, deaths and last observations.  ``stored`` builds on these, written
    once (they hold only listed drugs, and facts of patients with such drugs).
    """

    def __init__(self, spec: CohortSpec, tables):
        self.spec, self.tables = spec, tables

    @cached_property
    def stored(self) -> "Cohort":
        copy = Cohort(self.spec, self.tables)
        copy.__dict__["stored"] = copy
        shared = shared_name(self.spec.classifier)
        copy.__dict__["eligible"] = kept(self.tables, "eligible", lambda: self.eligible)
        for part in ("starts", "anchor", "stays", "deaths", "observed", *(["echo_event"] if self.spec.echo else [])):
            copy.__dict__[part] = kept(self.tables, "stays" if part == "stays" else f"{part}_{shared}", lambda: getattr(Cohort(self.spec, self.tables).over(copy), part))
        return copy

    def over(self, other: "Cohort") -> "Cohort":
        """The same cohort, building on what ``other`` has written."""
        self.__dict__.update({k: v for k, v in other.__dict__.items() if k in ("eligible", "starts", "anchor", "stays")})
        return self

    @cached_property
    def eligible(self) -> DataFrame:
        return O.eligible_patients(self.tables.diagnoses)

    @cached_property
    def starts(self) -> DataFrame:
        return X.classify(self.tables.prescriptions, self.spec.classifier).join(self.eligible, "subject_id", "left_semi")

    @cached_property
    def anchor(self) -> DataFrame:
        return X.first_exposure(self.starts)

    @cached_property
    def cycles(self) -> DataFrame:
        s = self.spec
        if s.grain == "joint":
            return X.cycles_joint(self.starts, s.windows, strict_reference=s.strict_reference)
        cycles = X.cycles_by_class(self.starts, s.windows)
        if s.first_class is None:
            return cycles
        first = T.first_class_patients(X.class_span(self.starts), s.first_class)
        cycles = cycles.where(F.col("drug_class") == s.first_class).join(first, "subject_id", "left_semi")
        others = self.starts.where(F.col("drug_class") != s.first_class).select("subject_id", F.to_date("starttime").alias("start_date"))
        return T.exists_day_between(cycles, others, "start_date", "cycle_start_date", "cycle_end_date",
                                    "has_concurrent_other_class", ["subject_id", "cycle_number"])

    @cached_property
    def facts(self) -> DataFrame:
        s, t = self.spec, self.tables
        return O.coded_facts(self.anchor, t.diagnoses, t.admissions, s.incident, s.history, s.strict_reference)

    @cached_property
    def history(self) -> DataFrame:
        return O.history_flags(self.anchor, self.facts, list(self.spec.history))

    @cached_property
    def echo_event(self) -> DataFrame:
        return O.first_echo_event(self.anchor, self.tables.echo)

    @cached_property
    def events(self) -> DataFrame:
        if not self.spec.echo:
            return self.facts.select("subject_id", "hf_event_time", "hf_hadm_id", "hf_icd_codes")
        return O.combined_event(self.anchor, self.facts, self.echo_event)

    @cached_property
    def stays(self) -> DataFrame:
        return O.stay_bounds(self.tables.admissions)

    @cached_property
    def deaths(self) -> DataFrame:
        return O.death_times(self.anchor, self.tables.patients, self.stays)

    @cached_property
    def observed(self) -> DataFrame:
        return O.last_observations(self.anchor, self.starts, self.stays)

    def assemble(self, events: DataFrame) -> DataFrame:
        """cycles + per-patient facts: every right side has one row per patient, so no fan-out and one key."""
        return (self.cycles.withColumn("prediction_window_end", L.window_end())
                .join(events, "subject_id", "left").join(self.history, "subject_id", "left")
                .join(self.deaths, "subject_id", "left").join(self.observed, "subject_id", "left"))

    @cached_property
    def table(self) -> DataFrame:
        if self.stored is not self:
            return self.stored.table
        s = self.spec
        event, died = ("first_event_time", "died_in_window_before_event") if s.echo else ("hf_event_time", "died_in_window_before_hf")
        return L.label_five_way(self.assemble(self.events), event, died, s.strict_history)

    @cached_property
    def echo_only_table(self) -> DataFrame:
        """The optional stage: the same cycles, labelled by echo events alone."""
        if self.stored is not self:
            return self.stored.echo_only_table
        return L.label_five_way(self.assemble(self.echo_event), "first_echo_event_time", "died_in_window_before_echo_event").drop(
            "n_exposure_start_days_in_cycle", "n_prescription_rows_in_cycle", "window_rationale")

    @cached_property
    def strict(self) -> DataFrame:
        return L.binary_table(self.table, "eligible_strict")

    @cached_property
    def inclusive(self) -> DataFrame:
        return L.binary_table(self.table, "eligible_inclusive")


@dataclass(frozen=True)
class MainSpec:
    name: str
    classifier: D.Classifier
    outcome: C.CodeSet
    prior_diagnosis: bool
    baseline_floor: float | None
    death_is_followup: bool


MAIN_SPECS = {s.name: s for s in [
    MainSpec("main_v1", D.MAIN_V1, C.MAIN_V1_CV, False, None, False),
    MainSpec("main_v2", D.MAIN_V2, C.MAIN_V2_CV, True, 50, True),
]}


class MainCohort:
    """The older joint chain: diagnosis or LVEF event from the first drug on, four labels."""

    def __init__(self, spec: MainSpec, tables, strict_reference: bool = False):
        self.spec, self.tables, self.strict_reference = spec, tables, strict_reference

    @cached_property
    def stored(self) -> "MainCohort":
        copy = MainCohort(self.spec, self.tables, self.strict_reference)
        copy.__dict__["stored"] = copy
        shared = shared_name(self.spec.classifier)
        copy.__dict__["eligible"] = kept(self.tables, "eligible", lambda: self.eligible)
        copy.__dict__["drugs"] = kept(self.tables, f"drugs_{shared}", lambda: self.drugs)
        copy.__dict__["anchor"] = kept(self.tables, f"anchor_{self.spec.name}", lambda: MainCohort.anchor.func(copy))
        copy.__dict__["outcome_admissions"] = kept(self.tables, f"outcomes_{self.spec.name}", lambda: MainCohort.outcome_admissions.func(copy))
        return copy

    @cached_property
    def drugs(self) -> DataFrame:
        return X.classify(self.tables.prescriptions, self.spec.classifier)

    @cached_property
    def eligible(self) -> DataFrame:
        return O.eligible_patients(self.tables.diagnoses)

    @cached_property
    def anchor(self) -> DataFrame:
        first = X.first_exposure(self.drugs, "first_oncology_time").join(self.eligible, "subject_id", "left_semi")
        if self.spec.prior_diagnosis:
            prior = O.prior_diagnosis_patients(first, "first_oncology_time", self.tables.diagnoses, self.tables.admissions)
            first = first.join(prior, "subject_id", "left_semi")
        return first

    @cached_property
    def cycles(self) -> DataFrame:
        return X.cycles_joint(self.drugs.join(self.eligible, "subject_id", "left_semi"), D.WINDOWS_MAIN, "Fallback window",
                              strict_reference=self.strict_reference)

    @cached_property
    def lvef(self) -> DataFrame:
        return O.lvef_values(self.tables.echo, exact_name=True)

    @cached_property
    def baseline(self) -> DataFrame:
        return T.asof_lookback(self.anchor, self.lvef, "first_oncology_time", "lvef_value", outputs=("baseline_time", "baseline_lvef"))

    @cached_property
    def lvef_events(self) -> DataFrame:
        return O.lvef_drop_events(self.baseline, self.lvef, "first_oncology_time", self.spec.baseline_floor, inclusive=True)

    @cached_property
    def flagged_admissions(self) -> DataFrame:
        """Admissions of cohort patients with the outcome flag and the distinct list of all their codes."""
        rows = O.with_admission(self.tables.diagnoses, self.anchor, self.tables.admissions)
        return rows.groupBy("subject_id", "first_oncology_time", "hadm_id", "admittime").agg(
            F.max(F.when(self.spec.outcome.matches(), 1).otherwise(0)).alias("cv_event"),
            X.text_set(F.collect_set("icd_code")).alias("cv_event_icd_codes"))

    @cached_property
    def outcome_admissions(self) -> DataFrame:
        """The flagged ones of these: outcome codes pick the admissions first, so only their codes are listed."""
        diagnoses = self.tables.diagnoses
        hits = O.with_admission(diagnoses.where(self.spec.outcome.matches()), self.anchor, self.tables.admissions)
        hits = hits.select("subject_id", "first_oncology_time", "hadm_id", "admittime").distinct()
        codes = diagnoses.select("subject_id", "hadm_id", "icd_code").join(hits, ["subject_id", "hadm_id"])
        return codes.groupBy("subject_id", "first_oncology_time", "hadm_id", "admittime").agg(
            X.text_set(F.collect_set("icd_code")).alias("cv_event_icd_codes"))

    @cached_property
    def first_event(self) -> DataFrame:
        lvef = self.lvef_events.select("subject_id", F.col("event_time").alias("first_toxicity_time"),
                                       F.lit("lvef_ctrctd").alias("first_toxicity_type"),
                                       F.col("event_lvef").alias("first_event_lvef"),
                                       F.col("lvef_drop_pp").alias("first_absolute_lvef_drop"))
        coded = self.outcome_admissions.where("admittime >= first_oncology_time").select(
            "subject_id", F.col("admittime").alias("first_toxicity_time"),
            F.lit("cv_diagnosis_admission").alias("first_toxicity_type"),
            F.col("cv_event_icd_codes").alias("first_cv_event_icd_codes"))
        order = [F.col("first_toxicity_time"), F.col("first_toxicity_type"),
                 F.coalesce(-F.col("first_absolute_lvef_drop"), F.lit(0.0)), F.coalesce("first_cv_event_icd_codes", F.lit(""))]
        return T.first_by(union_all([lvef, coded]), "subject_id", order,
                          ["first_toxicity_time", "first_toxicity_type", "first_event_lvef", "first_absolute_lvef_drop",
                           "first_cv_event_icd_codes"])

    @cached_property
    def history(self) -> DataFrame:
        return (self.outcome_admissions.where("admittime < first_oncology_time").select("subject_id").distinct()
                .withColumn("pre_existing_cv_history", F.lit(1)))

    @cached_property
    def observations(self) -> DataFrame:
        t = self.tables
        parts = [t.admissions.select("subject_id", F.col("admittime").alias("observation_time")),
                 self.lvef.select("subject_id", F.col("measurement_datetime").alias("observation_time")),
                 self.drugs.select("subject_id", F.col("starttime").alias("observation_time"))]
        if self.spec.death_is_followup:
            parts.append(t.patients.where("dod IS NOT NULL").select("subject_id", F.col("dod").cast("timestamp_ntz").alias("observation_time")))
        return union_all(parts)

    @cached_property
    def table(self) -> DataFrame:
        if self.stored is not self:
            return self.stored.table
        last = self.observations.groupBy("subject_id").agg(F.max("observation_time").alias("last_observation_time"))
        cycles = T.exists_in_interval(
            self.cycles.withColumn("prediction_window_end", L.window_end()), self.observations, "observation_time",
            F.col("prediction_time"), F.col("prediction_window_end"), "has_observation_in_prediction_window",
            ["subject_id", "cycle_number"])
        joined = (cycles.join(self.first_event, "subject_id", "left").join(self.history, "subject_id", "left")
                  .join(self.baseline.drop("first_oncology_time"), "subject_id", "left").join(last, "subject_id", "left")
                  .withColumn("pre_existing_cv_history", F.coalesce("pre_existing_cv_history", F.lit(0))))
        return L.label_four_way(joined)

    @cached_property
    def binary(self) -> DataFrame:
        return L.binary_table(self.table, "eligible_for_binary_label", self.spec.baseline_floor)


class YearMaster:
    """One row per patient: diagnoses, LVEF and admissions within one calendar year of the first drug."""

    YEAR = "INTERVAL '1' YEAR"

    def __init__(self, tables, classifier: D.Classifier = D.MAIN_V1):
        self.tables, self.classifier = tables, classifier

    @cached_property
    def anchor(self) -> DataFrame:
        listed = X.listed_drugs(self.tables.prescriptions, self.classifier.any_name)
        return X.first_exposure(listed, "first_oncology_time").join(O.eligible_patients(self.tables.diagnoses), "subject_id", "left_semi")

    @cached_property
    def flagged_admissions(self) -> DataFrame:
        coded = self.tables.diagnoses.where(C.ONE_YEAR_CV.matches())
        return (O.with_admission(coded, self.anchor, self.tables.admissions)
                .select("subject_id", "hadm_id", "admittime", "first_oncology_time").distinct())

    @cached_property
    def cv(self) -> DataFrame:
        """History flag and one-year outcome from the same rows."""
        t, a = F.col("admittime"), F.col("first_oncology_time")
        inside = (t >= a) & (t < F.expr(f"first_oncology_time + {self.YEAR}"))
        return self.flagged_admissions.groupBy("subject_id").agg(
            F.max(F.when(inside, 1)).alias("cv_event_1yr"),
            F.min(F.when(inside, t)).alias("first_cv_event_time_1yr"),
            F.count_distinct(F.when(inside, F.col("hadm_id"))).alias("n_cv_event_admissions_1yr"),
            F.max(F.when(t < a, 1)).alias("pre_existing_cv_history"))

    @cached_property
    def lvef(self) -> DataFrame:
        values = O.lvef_values(self.tables.echo, exact_name=True, keep_failed=True)
        base = T.asof_lookback(self.anchor, values, "first_oncology_time", "lvef_value", self.YEAR,
                               outputs=("baseline_time", "baseline_lvef"))
        after = T.range_followup(base, values, "first_oncology_time", self.YEAR, inclusive=True)
        v, drop = F.col("lvef_value"), F.col("baseline_lvef") - F.col("lvef_value") >= 10
        follow = after.groupBy("subject_id").agg(
            F.count(v).alias("n_values"), F.min(v).alias("worst_followup_lvef_1yr"),
            F.min("measurement_datetime").alias("first_followup_lvef_time_1yr"),
            F.max(F.when(drop, 1).otherwise(0)).alias("lvef_drop_10_1yr"),
            F.max(F.when(v < 50, 1).otherwise(0)).alias("lvef_below_50_1yr"),
            F.max(F.when(drop & (v < 50), 1).otherwise(0)).alias("definite_lvef_ctrcd_1yr"))
        flags = ["lvef_drop_10_1yr", "lvef_below_50_1yr", "definite_lvef_ctrcd_1yr"]
        return base.join(follow, "subject_id", "left").select(
            "subject_id", "first_oncology_time", "baseline_time", "baseline_lvef",
            F.col("baseline_lvef").isNotNull().cast("int").alias("has_baseline_lvef"),
            F.coalesce((F.col("n_values") > 0).cast("int"), F.lit(0)).alias("has_followup_lvef_1yr"),
            "worst_followup_lvef_1yr", "first_followup_lvef_time_1yr",
            *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in flags])

    @cached_property
    def followup(self) -> DataFrame:
        t = F.col("admittime")
        return (self.tables.admissions.select("subject_id", "hadm_id", "admittime").join(self.anchor, "subject_id")
                .where((t >= F.col("first_oncology_time")) & (t < F.expr(f"first_oncology_time + {self.YEAR}")))
                .groupBy("subject_id").agg(F.lit(1).alias("has_followup_admission_1yr"),
                                           F.min("admittime").alias("first_followup_admission_time_1yr"),
                                           F.count_distinct("hadm_id").alias("n_followup_admissions_1yr")))

    @cached_property
    def table(self) -> DataFrame:
        def flag(name):
            return F.coalesce(F.col(name), F.lit(0))

        event = F.greatest(flag("cv_event_1yr"), flag("definite_lvef_ctrcd_1yr"))
        seen = F.greatest(flag("has_followup_lvef_1yr"), flag("has_followup_admission_1yr"))
        joined = (self.lvef.join(self.cv, "subject_id", "left").join(self.followup, "subject_id", "left"))
        return joined.select(
            "subject_id", "first_oncology_time", flag("cv_event_1yr").alias("cv_event_1yr"), "has_baseline_lvef",
            "has_followup_lvef_1yr", "baseline_time", "baseline_lvef", "first_followup_lvef_time_1yr",
            "worst_followup_lvef_1yr", "lvef_drop_10_1yr", "lvef_below_50_1yr", "definite_lvef_ctrcd_1yr",
            flag("pre_existing_cv_history").alias("pre_existing_cv_history"), event.alias("cardiotoxicity_1yr"),
            F.greatest(flag("cv_event_1yr"), seen).alias("has_outcome_evidence_1yr"),
            F.when(event == 1, "positive").when(seen == 1, "negative_observed").otherwise("unknown_no_followup_evidence")
            .alias("cardiotoxicity_label_1yr"),
            F.greatest(event, seen).alias("eligible_for_binary_label_1yr"))
