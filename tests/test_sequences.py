import random

import pytest
from pyspark.sql import functions as F
from small import Tables, adm, at, rows, rx

from chronocohort.functions import scalars as S
from chronocohort.operators import features as FE
from chronocohort.operators import labels as L
from chronocohort.operators import sequence as Q
from chronocohort.operators import timeline as TL
from chronocohort.session import durable, tune_tables

EVENTS = ("subject_id long, hadm_id long, admittime timestamp_ntz, event_time timestamp_ntz, event_type string, concept_token string, event_priority int, "
          "visit_id int, concept_id int, type_id int")
SAMPLES = "subject_id long, cycle_number int, prediction_time timestamp_ntz, binary_label int"


def event(subject, when, visit, token, kind="lab", cid=30):
    return (subject, visit, at(visit), when, kind, token, 0, visit, cid, S.TYPE_IDS[kind])


def brute(events, samples, length, gaps, delimiters):
    """Token lists by a plain loop."""
    out = {}
    for sid, cycle, when, _ in samples:
        kept = sorted((e for e in events if e[0] == sid and e[3] < when), key=lambda e: (e[7] or 10**9, e[3], e[4], e[6], e[5]))
        ids, prev, day0 = [], None, None
        for e in kept:
            day, v = max(0, (e[3] - at(0)).days + 7305), e[7]
            if prev is None or v != prev:
                if prev:
                    ids += [S.V_END] if delimiters else []
                    if gaps and v != 0:
                        g = max(0, day - day0)
                        token = f"W{g // 7}" if g < 28 else f"M{g // 30}" if g < 360 else "LT"
                        ids.append(S.RESERVED.index(token) if token in S.RESERVED else S.UNK)
                ids += [S.V_START] if delimiters and v != 0 else []
            ids.append(e[8])
            prev, day0 = v, day
        if prev and delimiters:
            ids.append(S.V_END)
        out[sid, cycle] = ([S.CLS] + ids[-(length - 1):], len(ids) + 1)
    return out


@pytest.mark.parametrize("gaps,delimiters,length", [(False, False, 8), (True, False, 9), (True, True, 10), (False, True, 500)])
def test_sequences_match_a_plain_loop(spark, gaps, delimiters, length):
    rng = random.Random(length)
    events = []
    for sid in range(1, 9):
        for visit in range(0, rng.randint(0, 7)):
            for i in range(rng.randint(1, 6)):
                # visits overlap in time, and some events lie long before or after their neighbours
                events.append(event(sid, at(visit * rng.choice([3, 29, 200]) + rng.random() * 40), visit, f"t{i}{visit}", rng.choice(["lab", "diagnosis"]), rng.randint(21, 60)))
    samples = [(sid, c, at(rng.random() * 400), 0) for sid in range(1, 10) for c in (1, 2)]
    got = Q.sequences(spark.createDataFrame(samples, SAMPLES), spark.createDataFrame(events, EVENTS), length, gaps, delimiters).collect()
    expected = brute(events, samples, length, gaps, delimiters)
    assert len(got) == len(samples)
    for r in got:
        ids, raw = expected[r["subject_id"], r["cycle_number"]]
        assert r["concept_ids"] == ids and r["raw_seq_len"] == raw and r["seq_len"] == len(ids) == len(r["dates"])


def test_event_at_index_is_excluded_and_empty_history_gives_cls(spark):
    events = spark.createDataFrame([event(1, at(5), 1, "a"), event(1, at(4), 1, "b", cid=31)], EVENTS)
    samples = spark.createDataFrame([(1, 1, at(5), 0), (2, 1, at(5), 0)], SAMPLES)
    got = {r["subject_id"]: r for r in Q.sequences(samples, events, 10).collect()}
    assert got[1]["concept_ids"] == [S.CLS, 31] and got[1]["position_ids"] == [0, 1]
    assert got[2]["concept_ids"] == [S.CLS] and got[2]["seq_len"] == 1 and got[2]["raw_seq_len"] == 1


def test_classes_with_one_cycle_number_keep_apart(spark):
    events = spark.createDataFrame([event(1, at(d), 1, f"e{d}", cid=30 + d) for d in range(6)], EVENTS)
    samples = spark.createDataFrame([(1, 1, "a", at(2), 0), (1, 1, "b", at(4), 1)], "subject_id long, cycle_number int, drug_class string, prediction_time timestamp_ntz, binary_label int")
    got = {r["drug_class"]: (r["concept_ids"], r["raw_seq_len"]) for r in Q.sequences(samples, events, 50).collect()}
    assert got == {"a": ([S.CLS, 30, 31], 3), "b": ([S.CLS, 30, 31, 32, 33], 5)}
    counts = rows(FE.bag_of_words(Q.sequences(samples, events, 50)), "drug_class", "token_id", "n")
    assert counts == [("a", 30, 1), ("a", 31, 1), ("b", 30, 1), ("b", 31, 1), ("b", 32, 1), ("b", 33, 1)]


def test_samples_that_share_a_key_are_an_error(spark):
    samples = spark.createDataFrame([(1, 1, at(2), 0), (1, 1, at(4), 0)], SAMPLES)
    with pytest.raises(Exception, match="share a key"):
        Q.sequences(samples, spark.createDataFrame([event(1, at(0), 1, "a")], EVENTS), 50).collect()


def test_a_hot_visit_brings_each_sample_only_its_newest_rows(spark):
    """One visit of many rows and many cycles within and after it: joined rows stay within samples x length."""
    n, length, cycles = 20_000, 20, 40
    start = F.expr("timestamp_ntz'2020-01-01 00:00:00'")
    events = spark.range(n).select(
        F.lit(1).cast("long").alias("subject_id"), F.lit(1).cast("long").alias("hadm_id"), start.alias("admittime"), (start + F.expr("make_dt_interval(0, 0, 0, id)")).alias("event_time"),
        F.lit("lab").alias("event_type"), F.concat(F.lit("t"), F.col("id").cast("string")).alias("concept_token"), F.lit(0).alias("event_priority"), F.lit(1).alias("visit_id"),
        (F.col("id") + 21).cast("int").alias("concept_id"), F.lit(3).alias("type_id"))
    samples = spark.createDataFrame([(1, c, at(0, c * 1000), 0) for c in range(1, cycles + 1)], SAMPLES)
    placed = Q.placed(events)
    whole, visits = Q.history(samples, placed)
    assert Q.newest_rows(whole, visits, placed, length).count() == cycles * length
    for r in Q.sequences(samples, events, length).collect():
        before = min(n, r["cycle_number"] * 1000)
        assert r["raw_seq_len"] == before + 1 and r["concept_ids"] == [S.CLS, *range(before - length + 1 + 21, before + 21)]


def test_horizons_repeat_the_sequence(spark):
    seqs = Q.sequences(spark.createDataFrame([(1, 1, at(3), 1)], SAMPLES), spark.createDataFrame([event(1, at(1), 1, "a", cid=33)], EVENTS), 9)
    horizons = L.multi_horizon(spark.createDataFrame([(1, 1, at(3), 1, at(120))], SAMPLES + ", first_event_time timestamp_ntz"))
    assert rows(Q.horizon_sequences(seqs, horizons), "window_days", "binary_label", "concept_ids") == [(180, 1, [2, 33]), (365, 1, [2, 33]), (90, 0, [2, 33])]


def test_gap_tokens(spark):
    days = spark.createDataFrame([(d,) for d in (0, 27, 28, 29, 30, 359, 360)], "d int")
    assert [r[0] for r in days.select(S.gap_id(F.col("d"))).collect()] == [S.RESERVED.index(t) if t else 1 for t in ("W0", "W3", None, None, "M1", "M11", "LT")]


def test_quartile_suffix_is_closed_above(spark):
    df = spark.createDataFrame([(x,) for x in (1.0, 2.0, 2.5, 4.0, 9.0, None)], "v double")
    got = [r[0] for r in df.select(S.quartile_suffix(F.col("v"), F.lit(1.0), F.lit(2.0), F.lit(4.0), "_Q")).collect()]
    assert got == ["_Q1", "_Q2", "_Q3", "_Q3", "_Q4", ""]


def test_vocabulary_and_unknown_token(spark):
    events = spark.createDataFrame([event(1, at(1), 1, t) for t in ("lab::b", "lab::a", "diagnosis::Z", "[UNK]", "lab::a")], EVENTS).drop("concept_id", "type_id")
    vocab = TL.vocabulary(events)
    assert dict(rows(vocab.where("id > 20"), "token", "id")) == {"diagnosis::Z": 21, "lab::a": 22, "lab::b": 23}
    other = spark.createDataFrame([event(1, at(1), 1, "lab::zzz")], EVENTS).drop("concept_id", "type_id")
    assert rows(TL.encode(other, vocab), "concept_id", "type_id") == [(1, 3)]


def arrays(spark, ids, visits):
    return spark.createDataFrame([(1, 1, ids, visits)], "subject_id long, cycle_number int, concept_ids array<int>, visit_ids array<int>")


def ids_of(df):
    return df.first()["concept_ids"]


def test_edits_keep_position_zero(spark):
    vocab = spark.createDataFrame([(t, i) for i, t in enumerate(S.RESERVED)] + [("lab::a", 21), ("lab::b", 22), ("medication::x", 23)], "token string, id int")
    seq = arrays(spark, [2, 21, 23, 22, 21], [0, 1, 1, 2, 4])
    assert ids_of(Q.perturb_zero(seq, vocab, "lab::")) == [2, 0, 23, 0, 0]
    assert ids_of(Q.perturb_zero(seq, vocab, "[CLS")) == [2, 21, 23, 22, 21]
    assert ids_of(Q.perturb_replace(seq, vocab, "lab::a", "medication::x")) == [2, 23, 23, 22, 23]
    assert ids_of(Q.perturb_replace(seq, vocab, "lab::a", "nothing")) == [2, 21, 23, 22, 21]
    assert ids_of(Q.perturb_visit(seq, -1)) == [2, 21, 23, 22, 0]
    assert ids_of(Q.perturb_visit(seq, 0)) == [2, 0, 0, 22, 21]
    assert ids_of(Q.perturb_visit(seq, 3)) == ids_of(Q.perturb_visit(seq, -4)) == [2, 21, 23, 22, 21]


def test_token_labels(spark):
    df = spark.createDataFrame([(t,) for t in ("[CLS]", "lab::50912_Q1", "lab::1", "diagnosis::I500_ICDver10", "medication::" + "x" * 30, "other::v")], "t string")
    assert [tuple(r) for r in df.select(S.token_label(F.col("t")), S.token_type(F.col("t"))).collect()] == [
        ("[CLS]", "special"), ("lab:Creatinine", "lab"), ("lab:1", "lab"), ("dx:I500", "diagnosis"), ("rx:" + "x" * 22, "medication"), ("other::v", "special")]


def test_a_hot_patient_with_long_overlapping_visits(spark):
    """One patient has a third of all visits and many samples; visits overlap, some end years later, some events have no visit."""
    rng = random.Random(3)
    events = []
    for sid, n in [(1, 150), *[(s, 10) for s in range(2, 32)]]:
        for visit in range(1, n + 1):
            begin = visit * 9 + rng.random() * 5
            for i in range(rng.randint(1, 4)):
                events.append(event(sid, at(begin + rng.choice([0, 0.01, 1, 20, 900]) * rng.random()), visit, f"t{i}{visit}", rng.choice(["lab", "diagnosis"]), rng.randint(21, 60)))
        events += [event(sid, at(rng.random() * 1500), 0, f"z{i}") for i in range(5)]
    samples = [(sid, c, at(rng.random() * 1500), 0) for sid in range(1, 33) for c in range(1, 41 if sid == 1 else 3)]
    got = Q.sequences(spark.createDataFrame(samples, SAMPLES), spark.createDataFrame(events, EVENTS), 40, True, True).collect()
    expected = brute(events, samples, 40, True, True)
    assert len(got) == len(samples)
    for r in got:
        assert (r["concept_ids"], r["raw_seq_len"]) == expected[r["subject_id"], r["cycle_number"]]


def test_no_window_orders_a_whole_patient(spark, capsys):
    """Windows over events and visits are cut by chunk as well as by patient."""
    events = spark.createDataFrame([event(1, at(1), 1, "a")], EVENTS)
    Q.visit_summary(Q.placed(events)).explain("extended")
    windows = [line for line in capsys.readouterr().out.split("== Physical Plan ==")[1].splitlines() if "Window [" in line]
    assert windows and all("_c" in w.rsplit("], [", 1)[0] for w in windows)


def test_vocabulary_of_tokens_that_begin_alike(spark):
    tokens = spark.range(5000).select(F.format_string("medication::the same long beginning %07d", F.col("id")).alias("concept_token"))
    vocab = TL.vocabulary(tokens.unionByName(tokens).repartition(7)).where("id > 20")
    assert [r["id"] for r in vocab.orderBy("token").collect()] == list(range(21, 5021))


def test_first_positions_of_visits_match_a_plain_loop(spark):
    rng, ids, visits = random.Random(4), {}, {}
    for c in range(30):
        n = rng.choice([0, 1, 5, 60])
        ids[c], visits[c] = [rng.choice([S.PAD, 5, 30, 31]) for _ in range(n)], [rng.choice([0, 1, 2, 9]) for _ in range(n)]
    made = [(c % 3, c, ids[c], [2] * len(ids[c]), visits[c], list(range(len(ids[c])))) for c in ids]
    seqs = spark.createDataFrame(made, "subject_id long, cycle_number int, concept_ids array<int>, type_ids array<int>, visit_ids array<int>, dates array<int>")
    for k in (1, 3):
        want, seen = [], {}
        for c in ids:
            for i, (x, v) in enumerate(zip(ids[c], visits[c])):
                if x != S.PAD:
                    seen[c, v] = seen.get((c, v), 0) + 1
                    if seen[c, v] <= k:
                        want.append((c % 3, c, i, x, 2, v, i, seen[c, v]))
        got = Q.first_per_visit(seqs, k)
        assert sorted(tuple(r) for r in got.collect()) == sorted(want) and want


def test_prescriptions_are_joined_without_their_doses(spark):
    tables = Tables(spark, prescriptions=[rx(1, at(1), drug=" Aspirin", pharmacy=None, dose=d) for d in ("1 mg", "2 mg")] + [rx(1, at(1), drug=None, pharmacy=7)],
                    admissions=[adm(1, 1, at(0), at(9))])
    visits = TL.visits(tables.admissions)
    events = TL.medication_events(tables.prescriptions, visits)
    assert rows(events, "concept_token", "event_priority", "visit_id") == [("medication::aspirin", 0, 1), ("medication::aspirin", 1, 1), ("medication::nan", 2, 1)]
    plan = events._jdf.queryExecution().optimizedPlan().toString()
    used = [line for line in plan.splitlines() if "dose_val_rx" in line and "LogicalRDD" not in line]
    assert used and all("AS _same" in line for line in used)
    assert rows(TL.medication_events(tables.prescriptions, visits, bucket=True), "event_priority") == [(0,), (1,), (2,)]


def history_of_many(seed):
    rng = random.Random(seed)
    events = [event(sid, at(rng.random() * 300), rng.randint(0, 4), f"t{rng.randint(0, 30)}", rng.choice(["lab", "diagnosis"]), rng.randint(21, 60))
              for sid in range(1, 9) for _ in range(rng.choice([0, 3, 40]))]
    samples = [(sid, c, at(rng.random() * 300), c % 2) for sid in range(1, 10) for c in (1, 2, 3)] + [(None, 1, at(9), 0)]
    return samples, events


@pytest.mark.parametrize("most", [0, 10, 10**6])
def test_held_and_ranged_patients_give_one_result(spark, most):
    samples, events = history_of_many(5)
    known = Q.past(spark.createDataFrame(samples, SAMPLES), spark.createDataFrame(events, EVENTS), most)
    assert (known.ranged is None) == (most == 10**6)
    expected = brute(events, samples, 12, True, True)
    got = Q.sequences_of(known, 12, True, True).collect()
    assert {(r["subject_id"], r["cycle_number"]): r["concept_ids"] for r in got} == {k: ids for k, (ids, _) in expected.items()} and len(got) == len(samples)
    assert all(r["raw_seq_len"] == expected[r["subject_id"], r["cycle_number"]][1] for r in got)
    visits = {}
    for sid, cycle, when, _ in samples:
        for v in {e[7] for e in events if e[0] == sid}:
            times = [e[3] for e in events if e[0] == sid and e[7] == v]
            if min(times) < when:
                visits[sid, cycle, v] = (sum(t < when for t in times), max(t for t in times if t < when), int(max(times) < when))
    found = Q.events_before(known).collect()
    assert {tuple(r)[:3]: tuple(r)[3:] for r in found} == visits and len(found) == len(visits)


def test_sequences_of_stored_histories_shuffle_nothing(spark):
    samples, events = history_of_many(6)
    known = Q.past(spark.createDataFrame(samples, SAMPLES), spark.createDataFrame(events, EVENTS))
    for df in (Q.sequences_of(known, 12), Q.sequences_of(known, 12, True, True), Q.events_before(known)):
        assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()


def test_a_visit_to_zero_is_found_once_for_each_row(spark):
    seqs = Q.sequences(spark.createDataFrame([(1, 1, at(9), 1)], SAMPLES), spark.createDataFrame([event(1, at(v), v, "a", cid=30 + v) for v in (1, 2, 3)], EVENTS), 9)
    stored = spark.createDataFrame(seqs.collect(), seqs.schema)
    for offset, expected in ((-1, [S.CLS, 31, 32, 0]), (1, [S.CLS, 31, 0, 33]), (3, [S.CLS, 31, 32, 33]), (-4, [S.CLS, 31, 32, 33])):
        got = Q.perturb_visit(stored, offset)
        assert got.columns == seqs.columns and got.collect()[0]["concept_ids"] == expected
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert plan.count("array_distinct") == 1 and "array_sort(" not in plan and "Generate" in plan  # no comparator in lambdas, and a node between


def test_scans_of_stages_are_cut_small(spark):
    tune_tables(spark)
    spark.conf.set("spark.sql.files.minPartitionNum", "1")
    try:
        stored = durable(spark.range(200_000, numPartitions=8).select(*[F.rand(i).alias(f"x{i}") for i in range(16)]))
        assert stored.rdd.getNumPartitions() > 1
    finally:
        spark.conf.unset("spark.sql.files.minPartitionNum")


def test_events_are_filtered_by_their_admissions_before_the_shuffle(spark):
    tune_tables(spark)
    size, broadcast = "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold", "spark.sql.autoBroadcastJoinThreshold"
    before = {name: spark.conf.get(name) for name in (size, broadcast)}
    diagnoses = [(s, 10 * s + k, 1, 10, f"I5{k}") for s in range(1, 40) for k in range(3)]
    tables = Tables(spark, admissions=[adm(10 * s + k, s, at(k), at(k + 1)) for s in range(1, 40) for k in range(2)], diagnoses=diagnoses)
    some = durable(TL.visits(tables.admissions, spark.createDataFrame([(3,), (7,)], "subject_id long")))
    try:
        spark.conf.set(size, "0")
        spark.conf.set(broadcast, "-1")
        events = TL.diagnosis_events(durable(tables.diagnoses), some)
        assert "might_contain" in events._jdf.queryExecution().optimizedPlan().toString()
        assert rows(events, "subject_id", "hadm_id") == [(3, 30), (3, 31), (7, 70), (7, 71)]
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
