from datetime import date

from pyspark.sql import functions as F
from small import Tables, adm, at, dx, pat, rows, rx

from chronocohort.operators import labels as L
from chronocohort.operators import outcomes as O
from chronocohort.plans.cohorts import MAIN_SPECS, SPECS, Cohort, CohortSpec, MainCohort


def label(spark, event=None, death=None, last=None, history=0):
    df = spark.createDataFrame([(at(0), at(365), event, death, last, history)],
                               "prediction_time timestamp_ntz, prediction_window_end timestamp_ntz, ev timestamp_ntz, death_time timestamp_ntz, "
                               "last_observation_time timestamp_ntz, has_pre_existing_hf_or_cmp int")
    r = L.label_five_way(df, "ev").first()
    return r["label"], r["binary_label"], r["eligible_strict"], r["eligible_inclusive"], r["died_in_window_before_event"]


def test_five_way_bounds(spark):
    assert label(spark, event=at(0))[0] == "exclude_already_toxic"
    assert label(spark, event=at(365))[:4] == ("positive", 1, 1, 1)
    assert label(spark, event=at(365), history=1)[:4] == ("positive", 1, 0, 1)
    assert label(spark, event=at(30), death=at(30))[0] == "positive"
    assert label(spark, event=at(40), death=at(30)) == ("positive", 1, 1, 1, 1)
    assert label(spark, event=at(400), death=at(30)) == ("censored_death", None, 0, 0, 1)
    assert label(spark, death=at(365))[0] == "censored_death"
    assert label(spark, death=at(0), last=at(365))[0] == "negative_observed"
    assert label(spark, last=at(365))[:2] == ("negative_observed", 0)
    assert label(spark, last=at(365, -1))[0] == "unknown_insufficient_followup"
    assert label(spark)[0] == "unknown_insufficient_followup"


ANCHOR = "subject_id long, first_drug_time timestamp_ntz"


def test_history_and_incident_bounds(spark):
    anchor = spark.createDataFrame([(i, at(100)) for i in range(1, 6)], ANCHOR)
    t = Tables(spark, admissions=[adm(1, 1, at(90), at(110)), adm(2, 2, at(90), at(100)), adm(3, 3, at(100), at(120)), adm(4, 4, at(100, 1), at(120)),
                                  adm(5, 5, at(130), at(131)), adm(6, 5, at(130), at(132))],
               diagnoses=[dx(1, 1, "I50"), dx(2, 2, "I50"), dx(3, 3, "I50"), dx(4, 4, "I50"), dx(4, 4, "I21", seq=2), dx(5, 6, "I509"), dx(5, 5, "I42")])
    facts = O.coded_facts(anchor, t.diagnoses, t.admissions, O.HEART_FAILURE | O.CARDIOMYOPATHY)
    assert rows(O.history_flags(anchor, facts), "subject_id", "has_pre_existing_hf", "has_pre_existing_hf_or_cmp") == [
        (1, 0, 0), (2, 1, 1), (3, 0, 0), (4, 0, 0), (5, 0, 0)]
    incident = facts.where("hf_event_time IS NOT NULL")
    assert rows(incident, "subject_id", "hf_hadm_id", "hf_icd_codes") == [(4, 4, "I50"), (5, 5, "I42")]
    loose = O.coded_facts(anchor, t.diagnoses, t.admissions, O.HEART_FAILURE, strict_reference=True)
    assert [r[1] for r in rows(O.history_flags(anchor, loose), "subject_id", "has_pre_existing_hf")] == [1, 1, 1, 1, 1]


def echo(subject, when, value, kind="LVEF"):
    return (subject, when, kind, value)


def test_baseline_bounds_and_drops(spark):
    anchor = spark.createDataFrame([(i, at(400)) for i in range(1, 8)], ANCHOR)
    t = Tables(spark, echo=[
        echo(1, at(400), "60"), echo(2, at(35), "60"), echo(2, at(34, 86399), "70"),
        echo(3, at(399), "59"), echo(3, at(500), "49"), echo(4, at(399), "60"), echo(4, at(500), "50"),
        echo(5, at(399), "-20", "GLS avg"), echo(5, at(500), "-17", "global longitudinal strain"), echo(6, at(399), "-20", "gls"), echo(6, at(501), "-16.9", "GLS"),
        echo(7, at(399), "60"), echo(7, at(399), "62"), echo(7, at(398), "n/a"), echo(7, at(450), "45"), echo(7, at(450), "40")])
    lvef, _ = O.echo_baselines(anchor, t.echo)
    assert rows(lvef, "subject_id", "baseline_lvef") == [(1, None), (2, 60.0), (3, 59.0), (4, 60.0), (5, None), (6, None), (7, 62.0)]
    assert rows(O.lvef_drop_events(lvef, O.lvef_values(t.echo)), "subject_id", "event_lvef") == [(3, 49.0), (7, 40.0), (7, 45.0)]
    first = O.first_echo_event(anchor, t.echo)
    assert rows(first, "subject_id", "first_echo_event_type", "baseline_lvef", "event_lvef", "event_gls") == [
        (3, "lvef_ctrcd", 59.0, 49.0, None), (6, "gls_subclinical", None, None, -16.9), (7, "lvef_ctrcd", 62.0, 40.0, None)]


def test_admission_wins_tie_with_echo(spark):
    t = Tables(spark, prescriptions=[rx(1, at(100))], diagnoses=[dx(1, 1, "C50"), dx(1, 2, "I50")], admissions=[adm(1, 1, at(90), at(95)), adm(2, 1, at(150), at(160))],
               echo=[echo(1, at(99), "65"), echo(1, at(150), "40")], patients=[pat(1)])
    assert rows(Cohort(SPECS["pan_cancer_ctrcd"], t).events, "first_event_type", "event_lvef") == [("hf_admission", 40.0)]


def test_death_needs_date_of_death(spark):
    anchor = spark.createDataFrame([(i, at(0)) for i in (1, 2, 3)], ANCHOR)
    t = Tables(spark, patients=[pat(1, date(2020, 5, 1)), pat(2, None), pat(3, date(2020, 5, 1))],
               admissions=[adm(1, 1, at(1), at(2), at(2)), adm(2, 2, at(1), at(2), at(2))])
    deaths = O.death_times(anchor, t.patients, O.stay_bounds(t.admissions))
    assert rows(deaths.withColumn("d", F.col("death_time").cast("string")), "subject_id", "d") == [(1, str(at(2))), (3, "2020-05-01 00:00:00")]


def test_cohort_table_runs_on_empty_tables(spark):
    t = Tables(spark)
    for spec in (SPECS["pan_cancer_ctrcd"], SPECS["uniform_365"], SPECS["first_class_only"]):
        assert Cohort(spec, t).table.count() == 0
    assert MainCohort(MAIN_SPECS["main_v2"], t).table.count() == 0


def test_main_chain_counts_event_at_first_drug(spark):
    t = Tables(spark, prescriptions=[rx(1, at(100))], diagnoses=[dx(1, 1, "C50"), dx(1, 2, "428", 9)], admissions=[adm(1, 1, at(90), at(95)), adm(2, 1, at(100), at(101))])
    m = MainCohort(MAIN_SPECS["main_v2"], t)
    assert rows(m.table, "label", "first_toxicity_type") == [("exclude_already_toxic", "cv_diagnosis_admission")]


def test_custom_spec(spark):
    t = Tables(spark, prescriptions=[rx(1, at(0)), rx(1, at(20), "taxol")], diagnoses=[dx(1, 1, "C50")], admissions=[adm(1, 1, at(0), at(500))])
    table = Cohort(CohortSpec("mine", grain="joint", windows=None, echo=False), t).table
    assert rows(table, "cycle_number", "label") == [(1, "negative_observed"), (2, "negative_observed")]


def test_multi_horizon(spark):
    samples = spark.createDataFrame([(1, 1, at(0), 1, at(90)), (2, 1, at(0), 1, at(90.5)), (3, 1, at(0), 0, None), (4, 1, at(0), 0, at(-1))],
                                    "subject_id long, cycle_number int, prediction_time timestamp_ntz, binary_label int, first_event_time timestamp_ntz")
    assert rows(L.multi_horizon(samples), "subject_id", "window_days", "binary_label") == sorted(
        [(1, 90, 1), (1, 180, 1), (1, 365, 1), (2, 90, 0), (2, 180, 1), (2, 365, 1), (3, 90, 0), (3, 180, 0), (3, 365, 0), (4, 90, 0), (4, 180, 0), (4, 365, 0)], key=lambda r: tuple(map(str, r)))
