from small import Tables, at, dx, rows, rx

from chronocohort.functions import drugs as D
from chronocohort.operators import exposure as X
from chronocohort.operators import temporal as T


def starts(spark, data):
    return X.classify(Tables(spark, prescriptions=data).prescriptions, D.TEN)


def test_gap_of_seven_days_continues_and_eight_opens(spark):
    days = X.with_cycles(X.exposure_days(starts(spark, [rx(1, at(0)), rx(1, at(7)), rx(1, at(15))]), ["subject_id"]), ["subject_id"])
    assert [r[0] for r in rows(days.orderBy("start_date"), "cycle_number")] == [1, 1, 2]


def test_two_classes_on_one_day(spark):
    s = starts(spark, [rx(1, at(0)), rx(1, at(0, 60), "Paclitaxel")])
    assert rows(X.cycles_by_class(s, D.WINDOWS_UNIFORM), "drug_class", "cycle_number") == [("anthracycline", 1), ("taxane", 1)]
    joint = X.cycles_joint(s, D.WINDOWS_PER_CYCLE)
    assert rows(joint, "cycle_number", "exposed_anthracycline", "exposed_taxane", "toxicity_window_days", "drug_classes_in_cycle") == [
        (1, 1, 1, 365, "anthracycline | taxane")]


def test_strict_reference_squares_rows_of_a_day(spark):
    s = starts(spark, [rx(1, at(0, i), pharmacy=i) for i in range(3)] + [rx(1, at(2))])
    assert rows(X.cycles_joint(s, None), "n_exposure_start_days_in_cycle", "n_prescription_rows_in_cycle") == [(2, 4)]
    assert rows(X.cycles_joint(s, None, strict_reference=True), "n_prescription_rows_in_cycle") == [(10,)]


def test_first_class_tie_keeps_patient(spark):
    s = starts(spark, [rx(1, at(0)), rx(1, at(0), "Paclitaxel"), rx(2, at(1)), rx(2, at(0), "Paclitaxel")])
    assert rows(T.first_class_patients(X.class_span(s), "anthracycline"), "subject_id") == [(1,)]


def test_classification_order_and_fallback(spark):
    t = Tables(spark, prescriptions=[rx(1, at(0), "Ado-Trastuzumab Emtansine"), rx(1, at(0), "Aspirin"), rx(1, at(0), "5FU cream"), rx(2, at(0), None)])
    expected = [("5fu cream", "fluoropyrimidine"), ("ado-trastuzumab emtansine", "her2_targeted")]
    assert rows(X.classify(t.prescriptions, D.TEN), "drug", "drug_class") == expected
    only = D.Classifier({"her2_targeted": "trastuzumab"}, prefilter="trastuzumab|5fu", fallback="other_oncology")
    assert rows(X.classify(t.prescriptions, only), "drug_class") == [("her2_targeted",), ("other_oncology",)]


def test_interval_tests_on_their_bounds(spark):
    left = spark.createDataFrame([(1, 1, at(0, 100), at(10)), (2, 1, at(0), at(10)), (3, 1, at(0), at(10))], "subject_id long, cycle_number int, a timestamp_ntz, u timestamp_ntz")
    points = spark.createDataFrame([(1, at(0, 100)), (1, at(10, 1)), (2, at(10)), (3, at(5)), (3, at(5, 9))], "subject_id long, t timestamp_ntz")
    out = T.exists_in_interval(left, points, "t", left["a"], left["u"], "found", ["subject_id", "cycle_number"])
    assert rows(out, "subject_id", "found") == [(1, 0), (2, 1), (3, 1)]


def test_code_sets(spark):
    from chronocohort.functions import codes as C

    t = Tables(spark, diagnoses=[dx(1, 1, "I5021"), dx(1, 1, "I5021", 9), dx(1, 1, "4280", 9), dx(1, 1, "I514"), dx(1, 1, "I5181"), dx(1, 1, "C449"),
                                 dx(1, 1, "C50"), dx(1, 1, "1730", 9), dx(1, 1, "2080", 9), dx(1, 1, "V1011", 9)])
    assert rows(t.diagnoses.where(C.HEART_FAILURE.matches()), "icd_code", "icd_version") == [("4280", 9), ("I5021", 10)]
    assert rows(t.diagnoses.where(C.BROAD_CV.matches()), "icd_code") == [("4280",), ("I5021",), ("I514",)]
    assert rows(t.diagnoses.where(C.MAIN_V2_CV.matches()), "icd_code") == [("4280",), ("I5021",), ("I5021",), ("I514",), ("I5181",)]
    assert rows(t.diagnoses.where(C.active_cancer()), "icd_code") == [("2080",), ("C50",)]
    procedures = spark.createDataFrame([("9925", 9), ("99251", 9), ("9229", 9), ("D7001ZZ", 10)], "icd_code string, icd_version int")
    assert rows(procedures.where(C.TREATMENT_PROCEDURES.matches()), "icd_code") == [("9229",), ("9925",), ("D7001ZZ",)]


def test_patterns_run_on_names_and_not_on_rows(spark):
    plan = starts(spark, [rx(1, at(0)), rx(2, at(0), "Aspirin")])._jdf.queryExecution().optimizedPlan().toString()
    assert "RLIKE" not in plan and "CASE WHEN" not in plan
