"""One registered query per operator; each takes the workspace and returns a DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronocohort.functions import codes as C
from chronocohort.functions import drugs as D
from chronocohort.functions import scalars as S
from chronocohort.operators import attribution as A
from chronocohort.operators import boosting
from chronocohort.operators import evaluate as E
from chronocohort.operators import exposure as X
from chronocohort.operators import features as FE
from chronocohort.operators import labels as L
from chronocohort.operators import outcomes as O
from chronocohort.operators import reports as R
from chronocohort.operators import sequence as Q
from chronocohort.operators import split as SP
from chronocohort.operators import temporal as T
from chronocohort.operators import timeline as TL
from chronocohort.operators.ordering import exact_quantiles, large_keys, running_index, union_all
from chronocohort.plans import incremental
from chronocohort.plans.workspace import SEQ_LEN, Workspace, workspace
from chronocohort.session import durable, output_path
from chronocohort.sources import readers, schemas, sinks
from chronocohort.streaming import cycles as stream

REGISTRY: dict[str, Callable[[Workspace], DataFrame]] = {}


def query(fn: Callable[[Workspace], DataFrame]) -> Callable[[Workspace], DataFrame]:
    REGISTRY[fn.__name__] = fn
    return fn


def runnable(fn: Callable[[Workspace], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(workspace(spark, sf_dir))

    return run


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    for c in columns:
        df = df.withColumn(c, F.round(c, digits))
    return df


def text(column: str) -> Column:
    """An array of numbers as one text, for comparing results across engines."""
    return F.array_join(F.transform(column, lambda x: x.cast("string")), " ").alias(column)


# Sources and sinks


@query
def src_csv(ws):
    path = output_path(ws.spark, "patients")
    ws.patients.write.option("header", True).csv(path)
    return readers.read_csv(ws.spark, path, schemas.PATIENTS)


@query
def src_pruned(ws):
    stem = output_path(ws.spark, "admissions")
    ws.admissions.write.parquet(f"{stem}.parquet")
    return readers.read_pruned(ws.spark, stem, schemas.ADMISSIONS, ["subject_id", "hadm_id", "admittime"])


@query
def src_semijoin_scan(ws):
    eligible = O.eligible_patients(ws.diagnoses)
    stays = ws.admissions.join(eligible, "subject_id", "left_semi")
    return readers.semi_join_scan(ws.labevents.where("storetime IS NOT NULL AND flag IS NOT NULL"), eligible, stays)


@query
def src_parquet_else_csv(ws):
    both, only = output_path(ws.spark, "procedures"), output_path(ws.spark, "procedures")
    ws.procedures.write.parquet(f"{both}.parquet")
    ws.procedures.write.option("header", True).csv(f"{only}.csv")
    return union_all([readers.read_parquet_else_csv(ws.spark, stem, schemas.PROCEDURES).withColumn("found", F.lit(kind))
                      for stem, kind in ((both, "parquet"), (only, "csv"))])


@query
def src_inline_values(ws):
    counts = ws.cohort("pan_cancer_ctrcd").starts.groupBy("drug_class").agg(F.count("*").alias("n_rows"))
    return (D.window_table(ws.spark, D.WINDOWS_BIMODAL).join(counts, "drug_class", "left")
            .withColumn("n_rows", F.coalesce("n_rows", F.lit(0))))


@query
def src_json_runs(ws):
    root = output_path(ws.spark, "runs")
    plain = E.run_metrics(ws.scored, ["variant", "seed"]).withColumn("file", F.lit("test_metrics.json"))
    tuned = E.run_metrics(ws.scored.where("seed % 2 = 0"), ["variant", "seed"], 0.3).withColumn("file", F.lit("test_metrics_auroc.json"))
    runs = plain.unionByName(tuned).select("variant", "seed", "file", *readers.METRICS)
    runs.write.partitionBy("variant", "seed", "file").json(root)
    return rounded(readers.read_runs(ws.spark, root, "auroc"), *readers.METRICS)


@query
def sink_table(ws):
    return sinks.write_table(ws.cohort("pan_cancer_ctrcd").cycles, output_path(ws.spark, "cycles"),
                             ["subject_id", "drug_class", "cycle_number"], csv=True)


@query
def sink_sequences(ws):
    stored = sinks.write_table(Q.pad(ws.sequences, SEQ_LEN), output_path(ws.spark, "sequences"))
    return stored.select(*Q.SAMPLE, text("concept_ids"), text("attention_mask"), "seq_len")


@query
def sink_vocab_meta(ws):
    path = output_path(ws.spark, "vocab")
    vocab = sinks.write_table(ws.vocab, path)
    facts = sinks.write_table(R.sequence_stats(ws.sequences, SEQ_LEN), f"{path}-facts")
    names = ["n_samples", "n_positive", "n_truncated", "max_seq_len_observed"]
    return vocab.select("token", F.col("id").cast("bigint").alias("value")).unionByName(
        R.unpivot(facts, names, "bigint").select(F.concat(F.lit("meta:"), "variable").alias("token"), "value"))


@query
def sink_predictions(ws):
    return sinks.write_table(sinks.prediction_rows(ws.scored), output_path(ws.spark, "predictions"))


@query
def sink_splits(ws):
    return sinks.write_table(sinks.split_membership(ws.samples, ws.splits, 42), output_path(ws.spark, "splits"))


# Projections, filters, predicates


@query
def code_range_filter(ws):
    return ws.diagnoses.where(C.active_cancer()).select("subject_id", "hadm_id", "seq_num", "icd_code", "icd_version").distinct()


@query
def code_prefix_filter(ws):
    sets = {"hf": C.HEART_FAILURE, "hf_cmp": C.HEART_FAILURE | C.CARDIOMYOPATHY, "arrhythmia": C.ARRHYTHMIA, "broad": C.BROAD_CV,
            "narrow": C.NARROW_CV, "prior": C.PRIOR_CANCER, "past": C.CANCER_HISTORY, "main_v1": C.MAIN_V1_CV, "main_v2": C.MAIN_V2_CV,
            "one_year": C.ONE_YEAR_CV}
    flags = ws.diagnoses.select("subject_id", "hadm_id", "seq_num", "icd_code", "icd_version",
                                *[s.matches().cast("int").alias(f"is_{n}") for n, s in sets.items()])
    return flags.where(F.greatest(*[f"is_{n}" for n in sets]) == 1)


@query
def procedure_filter(ws):
    return ws.procedures.where(C.TREATMENT_PROCEDURES.matches()).select("subject_id", "hadm_id", "seq_num", "chartdate", "icd_code", "icd_version")


@query
def drug_regex_prefilter(ws):
    lists = {"ten": D.TEN, "three": D.THREE, "main_v1": D.MAIN_V1, "main_v2": D.MAIN_V2}
    rows = X.listed_drugs(ws.prescriptions, "|".join(c.any_name for c in lists.values()))
    return rows.select("subject_id", "hadm_id", "pharmacy_id", "starttime", "drug",
                       *[F.col("drug").rlike(c.any_name).cast("int").alias(f"in_{n}") for n, c in lists.items()])


@query
def drug_like_prefilter(ws):
    return X.listed_drugs_like(ws.prescriptions, D.LIKE_TERMS).select("subject_id", "hadm_id", "pharmacy_id", "starttime", "drug")


@query
def drug_classify(ws):
    rows = ws.prescriptions.where("starttime IS NOT NULL").withColumn("drug", F.lower("drug"))
    d = F.col("drug")
    return rows.select("subject_id", "hadm_id", "pharmacy_id", "starttime", "drug", D.TEN.class_of(d).alias("class_ten"),
                       D.THREE.class_of(d).alias("class_three"), D.MAIN_V2.class_of(d).alias("class_main"))


@query
def class_group_map(ws):
    rows = ws.prescriptions.withColumn("drug_class", D.TEN.class_of(F.lower("drug")))
    return rows.groupBy("drug_class").agg(F.count("*").alias("n")).withColumn("drug_group", D.reporting_group(F.col("drug_class")))


@query
def measurement_extract(ws):
    return union_all([O.lvef_values(ws.echo).select("subject_id", "measurement_datetime", F.lit("lvef").alias("kind"), F.col("lvef_value").alias("value")),
                      O.gls_values(ws.echo).select("subject_id", "measurement_datetime", F.lit("gls").alias("kind"), F.col("gls_value").alias("value"))])


@query
def threshold_filter(ws):
    return O.lvef_values(ws.echo, exact_name=True).where("lvef_value < 50")


@query
def year_filter(ws):
    return ws.admissions.where(F.year("admittime").isin(1996, 1999)).select("subject_id", "hadm_id", "admittime", "dischtime")


@query
def lab_filter(ws):
    return ws.labevents.where(F.col("storetime").isNotNull() & F.col("flag").isNotNull() & F.col("itemid").isin(S.CARDIAC_LABS)).select(
        "subject_id", "hadm_id", "itemid", "storetime", "flag")


@query
def membership_filter(ws):
    return ws.admissions.join(O.eligible_patients(ws.diagnoses), "subject_id", "left_semi").select("subject_id", "hadm_id", "admittime")


@query
def null_defaults(ws):
    flags = O.eligible_patients(ws.diagnoses).withColumn("is_eligible", F.lit(1))
    return (ws.patients.join(flags, "subject_id", "left").fillna({"is_eligible": 0})
            .select("subject_id", "is_eligible", F.coalesce("dod", F.lit("9999-12-31").cast("date")).alias("dod")))


@query
def binary_table_filter(ws):
    c, m = ws.cohort("pan_cancer_ctrcd"), ws.main("main_v2")
    keys = ["subject_id", "cycle_number", "label", "binary_label"]
    return union_all([c.strict.select(F.lit("strict").alias("kind"), "drug_class", *keys),
                      c.inclusive.select(F.lit("inclusive").alias("kind"), "drug_class", *keys),
                      m.binary.select(F.lit("main").alias("kind"), F.lit(None).cast("string").alias("drug_class"), *keys)])


# Joins


@query
def join_inner_chain(ws):
    c = ws.cohort("pan_cancer_ctrcd")
    return O.with_admission(ws.diagnoses.where(C.BROAD_CV.matches()), c.anchor, ws.admissions)


@query
def join_cohort_restrict(ws):
    return ws.cohort("pan_cancer_ctrcd").starts.select("subject_id", "hadm_id", "pharmacy_id", "starttime", "drug", "drug_class")


@query
def join_left_assemble(ws):
    c = ws.cohort("pan_cancer_ctrcd")
    return c.assemble(c.events).select("subject_id", "drug_class", "cycle_number", "first_event_time", "has_pre_existing_hf_or_cmp",
                                       "death_time", "last_observation_time")


@query
def join_left_lookup(ws):
    v = TL.visits(ws.admissions, O.eligible_patients(ws.diagnoses))
    return ws.procedures.join(v.select("hadm_id", "admittime", "visit_id"), "hadm_id", "left").select(
        "subject_id", "hadm_id", "seq_num", "admittime", "visit_id")


@query
def join_dim_broadcast(ws):
    starts = ws.cohort("pan_cancer_ctrcd").starts
    return starts.join(F.broadcast(D.window_table(ws.spark, D.WINDOWS_BIMODAL)), "drug_class", "left").select(
        "subject_id", "pharmacy_id", "starttime", "drug_class", "toxicity_window_days", "window_rationale")


@query
def join_semi_in(ws):
    return ws.echo.join(ws.cohort("pan_cancer_ctrcd").anchor, "subject_id", "left_semi")


@query
def join_anti_first_class(ws):
    spans = X.class_span(ws.cohort("pan_cancer_ctrcd").starts)
    return union_all([T.first_class_patients(spans, c).withColumn("first_class", F.lit(c)) for c in ("anthracycline", "taxane")])


@query
def join_exists_range(ws):
    keys = ["subject_id", "cycle_number"]
    concurrent = ws.cohort("first_class_only").stored.cycles.select(*keys, F.lit("concurrent").alias("kind"), F.col("has_concurrent_other_class").alias("found"))
    m = ws.main("main_v2").stored
    seen = T.exists_in_interval(m.cycles.withColumn("prediction_window_end", L.window_end()), m.observations, "observation_time",
                                F.col("prediction_time"), F.col("prediction_window_end"), "found", keys)
    return concurrent.unionByName(seen.select(*keys, F.lit("observed").alias("kind"), "found"))


@query
def join_asof_lookback(ws):
    lvef, gls = O.echo_baselines(ws.cohort("pan_cancer_ctrcd").anchor, ws.echo)
    return lvef.join(gls.drop("first_drug_time"), "subject_id")


@query
def join_range_followup(ws):
    return T.range_followup(ws.cohort("pan_cancer_ctrcd").anchor, O.lvef_values(ws.echo), "first_drug_time", "INTERVAL '1' YEAR", inclusive=True)


@query
def join_day_expand(ws):
    rows = X.join_days_to_rows(ws.cohort("uniform_365").starts)
    return rows.groupBy("subject_id", "cycle_number").agg(
        F.count("*").alias("n_joined_rows"), F.count_distinct("start_date").alias("n_days"),
        F.sum("n_prescription_rows_that_day").alias("n_prescription_rows_joined"))


@query
def join_cumulative_window(ws):
    """Events before each index time per sample and visit, and whether they are the whole visit."""
    return Q.events_before(ws.past)


@query
def join_enrich_samples(ws):
    table = ws.cohort("per_cycle").table.select(*Q.SAMPLE, "drug_classes_in_cycle", "n_prescription_rows_in_cycle")
    enriched = ws.sample_keys.select(*Q.SAMPLE).join(table, Q.SAMPLE, "left")
    primary = enriched.where("drug_classes_in_cycle IS NOT NULL").groupBy("subject_id").agg(
        F.min_by("drug_classes_in_cycle", "cycle_number").alias("primary_drug_class"))
    return enriched.join(primary, "subject_id", "left")


@query
def intersect_patients(ws):
    listed = X.listed_drugs(ws.prescriptions, D.TEN.any_name).select("subject_id")
    procedures = ws.procedures.where(C.TREATMENT_PROCEDURES.matches()).select("subject_id")
    low = O.lvef_values(ws.echo).where("lvef_value < 50").select("subject_id")
    eligible = O.eligible_patients(ws.diagnoses)
    return union_all([eligible.join(other, "subject_id", "left_semi").withColumn("other", F.lit(n))
                      for n, other in (("drugs", listed), ("procedures", procedures), ("low_lvef", low))])


# Aggregations


@query
def agg_first_exposure(ws):
    return ws.cohort("pan_cancer_ctrcd").anchor


@query
def agg_class_span(ws):
    return X.class_span(ws.cohort("pan_cancer_ctrcd").starts)


def _days(df, keys):
    return df.select(*keys, "start_date", "first_starttime_that_day", "n_prescription_rows_that_day",
                     X.text_set(F.col("drugs")).alias("drugs_that_day"), X.text_set(F.col("classes")).alias("classes_that_day"))


@query
def agg_exposure_days(ws):
    starts = ws.cohort("pan_cancer_ctrcd").starts
    by_class = _days(X.exposure_days(starts, ["subject_id", "drug_class"]), ["subject_id", "drug_class"])
    return by_class.unionByName(_days(X.exposure_days(starts, ["subject_id"]), ["subject_id"]), allowMissingColumns=True)


@query
def agg_cycles_by_class(ws):
    return ws.cohort("pan_cancer_ctrcd").cycles


@query
def agg_cycles_joint(ws):
    return ws.cohort("per_cycle").cycles


@query
def agg_pivot_flags(ws):
    flags = [F.max(F.when(F.col("drug_class") == c, 1).otherwise(0)).alias(f"exposed_{c}") for c in D.TEN_CLASSES]
    return ws.cohort("pan_cancer_ctrcd").starts.groupBy("subject_id").agg(*flags)


@query
def agg_admission_flag(ws):
    return union_all([ws.main(n).flagged_admissions.withColumn("chain", F.lit(n)) for n in ("main_v1", "main_v2")])


@query
def agg_outcome_1yr(ws):
    return ws.year.cv.where("cv_event_1yr = 1").drop("pre_existing_cv_history")


@query
def agg_lvef_outcome_1yr(ws):
    return ws.year.lvef


@query
def agg_followup_1yr(ws):
    return ws.year.followup


@query
def agg_last_observation(ws):
    main = ws.main("main_v2").observations.groupBy("subject_id").agg(F.max("observation_time").alias("last_observation_time"))
    return ws.cohort("pan_cancer_ctrcd").observed.withColumn("chain", F.lit("class")).unionByName(main.withColumn("chain", F.lit("main")))


@query
def agg_death_time(ws):
    return ws.cohort("pan_cancer_ctrcd").deaths


@query
def agg_count_stats(ws):
    return union_all([R.count_stats(ws.admissions, "subject_id").withColumn("rows_of", F.lit("admissions")),
                      R.count_stats(ws.echo, "subject_id").withColumn("rows_of", F.lit("echo"))])


@query
def agg_distinct_patients(ws):
    tables = {"echo": ws.echo, "procedures": ws.procedures.where(C.TREATMENT_PROCEDURES.matches()), "diagnoses": ws.diagnoses, "patients": ws.patients}
    return union_all([df.agg(F.count_distinct("subject_id").alias("n_patients")).withColumn("table_name", F.lit(n)) for n, df in tables.items()])


@query
def agg_label_breakdown(ws):
    return R.breakdown(ws.cohort("pan_cancer_ctrcd").table, ["drug_class", "label"])


@query
def agg_binary_breakdown(ws):
    return R.breakdown(ws.cohort("pan_cancer_ctrcd").inclusive, ["drug_class", "label", "binary_label"])


@query
def agg_class_breakdown(ws):
    table = ws.main("main_v1").table
    return union_all([R.breakdown(table, ["drug_classes_in_cycle"], "toxicity_in_window").withColumn("by", F.lit("class")),
                      R.breakdown(table, ["cycle_number"], "toxicity_in_window").withColumn("by", F.lit("cycle"))])


@query
def agg_preexisting_breakdown(ws):
    return R.preexisting_breakdown(ws.cohort("broad_cv").table, ["has_pre_existing_hf", "has_pre_existing_cmp", "has_pre_existing_arrhythmia"])


@query
def agg_patient_status(ws):
    return R.patient_status(ws.cohort("pan_cancer_ctrcd").table)


@query
def agg_patient_summary(ws):
    return R.patient_summary(ws.main("main_v1").table, L.UNKNOWN_MAIN)


@query
def agg_cohort_accounting(ws):
    c = ws.cohort("pan_cancer_ctrcd")
    return R.accounting({"eligible": c.eligible, "first_drug": c.anchor, "table": c.table, "inclusive": c.inclusive, "strict": c.strict})


@query
def agg_group_quartiles(ws):
    labs = exact_quantiles(ws.labevents, ["itemid"], "valuenum", TL.QUARTILES)
    doses = exact_quantiles(ws.prescriptions.select(F.trim(F.lower("drug")).alias("drug"), S.first_number(F.col("dose_val_rx")).alias("dose")),
                            ["drug"], "dose", TL.QUARTILES)
    out = labs.select(F.concat(F.lit("lab "), F.col("itemid").cast("string")).alias("item"), *TL.QUARTILES).unionByName(
        doses.select(F.concat(F.lit("dose "), "drug").alias("item"), *TL.QUARTILES))
    return rounded(out, *TL.QUARTILES)


@query
def agg_describe_missing(ws):
    return R.describe_missing(R.year_labels(ws.year.table), ["baseline_lvef", "worst_followup_lvef_1yr", "days_baseline_to_drug", "days_drug_to_first_followup_lvef"])


@query
def agg_flag_summary(ws):
    return R.flag_summary(ws.year.table)


@query
def agg_label_component(ws):
    return R.label_components(R.year_labels(ws.year.table))


@query
def agg_label_pct(ws):
    labels = R.compare_labels(ws.year.table)
    overview = union_all([R.year_overview(ws.year.table, x).select(F.lit(n).alias("cohort"), F.col("metric").alias("label"), F.col("value").alias("n"))
                          for x, n in ((False, "full_cohort"), (True, "excluded_pre_existing_cv_history"))])
    return labels.unionByName(overview, allowMissingColumns=True)


@query
def agg_seq_stats(ws):
    return R.sequence_stats(ws.sequences, SEQ_LEN)


@query
def agg_dataset_summary(ws):
    return R.dataset_summary(ws.sequences, ws.vocab, SEQ_LEN)


@query
def agg_split_summary(ws):
    return R.split_summary(ws.samples, ws.splits)


# Windows


@query
def win_gap(ws):
    keys = ["subject_id", "drug_class"]
    return X.with_gaps(X.exposure_days(ws.cohort("pan_cancer_ctrcd").starts, keys), keys).select(
        *keys, "start_date", "previous_start_date", "days_since_previous_start")


@query
def win_sessionize(ws):
    starts = ws.cohort("pan_cancer_ctrcd").starts
    out = []
    for keys in (["subject_id", "drug_class"], ["subject_id"]):
        out.append(X.with_cycles(X.exposure_days(starts, keys), keys).select(*keys, "start_date", "is_new_cycle", "cycle_number"))
    return union_all(out)


@query
def win_sessionize_stream(ws):
    """The cycles of ``agg_cycles_by_class`` from a file stream of drug starts: closed by the watermark, the rest and late keys in batch."""
    cohort = ws.cohort("pan_cancer_ctrcd")
    source, out, state = (output_path(ws.spark, f"stream-{part}") for part in ("source", "cycles", "state"))
    cohort.starts.repartitionByRange("starttime").write.parquet(source)
    starts = ws.spark.readStream.schema(cohort.starts.schema).parquet(source)
    stream.append_cycles(starts, out, state)
    return stream.whole_cycles(ws.spark.read.parquet(out), ws.spark.read.parquet(source), cohort.spec.windows)


@query
def materialize_incremental(ws):
    """The cycles of ``agg_cycles_by_class`` from a store that takes one half of the drug starts, then the other."""
    cohort = ws.cohort("pan_cancer_ctrcd")
    folder, half = output_path(ws.spark, "store"), F.pmod(F.xxhash64("subject_id", "starttime", "drug"), F.lit(2))
    starts = durable(cohort.starts)
    incremental.create(ws.spark, folder)
    for n in range(2):
        incremental.add(folder, f"half {n}", starts.where(half == n))
    return incremental.cycles(ws.spark, folder, starts, cohort.spec.windows)


@query
def win_first_event(ws):
    return ws.cohort("pan_cancer_ctrcd").facts.where("hf_event_time IS NOT NULL").select("subject_id", "hf_event_time", "hf_hadm_id", "hf_icd_codes")


@query
def win_first_of_union(ws):
    return ws.main("main_v1").first_event


@query
def win_visit_number(ws):
    return TL.visits(ws.admissions).select("subject_id", "hadm_id", "admittime", "visit_id")


@query
def win_event_priority(ws):
    return TL.medication_rows(ws.prescriptions, TL.visits(ws.admissions)).select("subject_id", "hadm_id", "starttime", "pharmacy_id", "drug_norm", "event_priority")


@query
def win_share_in_group(ws):
    return R.share_in_group(R.year_labels(ws.year.table), "pre_existing_cv_history", "label")


@query
def win_visit_change(ws):
    order = Window.partitionBy(*Q.SAMPLE).orderBy("position")
    rows = Q.token_rows(ws.sequences).where("position > 0")
    prev_visit, prev_date = F.lag("visit_id").over(order), F.lag("date").over(order)
    out = rows.select(*Q.SAMPLE, "position", "visit_id", prev_visit.alias("previous_visit"), prev_date.alias("previous_date"),
                      (F.col("date") - prev_date).alias("days"))
    return out.where(F.col("previous_visit").isNull() | (F.col("previous_visit") != F.col("visit_id")))


@query
def win_tail_k(ws):
    return ws.build_sequences(max_seq_len=32).select(*Q.SAMPLE, text("concept_ids"), "seq_len", "raw_seq_len")


@query
def win_first_value(ws):
    return ws.cohort("per_cycle").cycles.groupBy("subject_id").agg(F.min_by("drug_classes_in_cycle", "cycle_number").alias("first_class"))


# Sort, limit, top-k


@query
def sort_export(ws):
    return ws.cohort("pan_cancer_ctrcd").cycles.select("subject_id", "drug_class", "cycle_number", "prediction_time").orderBy(
        "subject_id", "drug_class", "cycle_number")


@query
def sort_timeline(ws):
    rows = ws.timeline
    chunk = F.struct(Q.visit_rank().alias("v"), F.date_trunc("HOUR", "event_time").alias("h"))
    ranked = running_index(rows, ["subject_id"], Q.order_within_patient(), chunk, "place", large_keys(rows, ["subject_id"]))
    return ranked.select("subject_id", "visit_id", "event_time", "event_type", "event_priority", "concept_token", "place")


@query
def limit_preview(ws):
    return ws.admissions.orderBy("subject_id", "hadm_id").limit(25).select("subject_id", "hadm_id", "admittime")


@query
def topk_global(ws):
    top = A.top_tokens(ws.attributions.select("subject_id", "position", "token", "ig_score_l2", "rollout_score"), 40).select(
        F.lit("token").alias("kind"), "subject_id", "position", "ig_score_l2")
    busy = ws.main("main_v1").table.groupBy("subject_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "subject_id").limit(10)
    return top.unionByName(busy.select(F.lit("subject").alias("kind"), "subject_id", F.col("n").alias("position")), allowMissingColumns=True)


@query
def topk_per_group(ws):
    return Q.first_per_visit(ws.sequences, 3).select(*Q.SAMPLE, "visit_id", "position", "concept_id", "rank_in_visit")


# Set operations


@query
def set_union_distinct(ws):
    active = ws.diagnoses.where(C.active_cancer()).select("subject_id")
    return active.union(ws.diagnoses.where(C.CANCER_HISTORY.matches()).select("subject_id")).distinct()


@query
def set_union_all(ws):
    c = ws.cohort("pan_cancer_ctrcd")
    stays = ws.admissions.join(c.anchor, "subject_id", "left_semi")
    return union_all([stays.select("subject_id", F.col("admittime").alias("observation_time"), F.lit("admission").alias("kind")),
                      stays.where("dischtime IS NOT NULL").select("subject_id", F.col("dischtime").alias("observation_time"), F.lit("discharge").alias("kind")),
                      c.starts.select("subject_id", F.col("starttime").alias("observation_time"), F.lit("drug_administration").alias("kind"), "drug_class")])


@query
def set_concat_events(ws):
    return ws.timeline.groupBy("event_type").agg(F.count("*").alias("n"), F.count_distinct("subject_id").alias("n_patients"),
                                                   F.count_distinct("concept_token").alias("n_tokens"))


@query
def set_distinct(ws):
    return ws.diagnoses.where(C.BROAD_CV.matches()).select("subject_id", "icd_code").dropDuplicates()


@query
def set_difference(ws):
    known = ws.timeline.select(F.col("concept_token").alias("token")).distinct()
    return known.join(ws.vocab.where(F.col("id") < len(S.RESERVED)), "token", "left_anti")


# Scalar functions


@query
def fn_string(ws):
    d = F.lower("drug")
    return ws.prescriptions.select("subject_id", "pharmacy_id", "starttime", d.alias("lowered"), F.substring("drug", 1, 3).alias("head"),
                                   F.col("drug").like("%mab").cast("int").alias("is_mab"), (~d.like("asp%")).cast("int").alias("not_asp"),
                                   F.split(F.concat(F.lit("medication::"), F.trim(d)), "::")[1].alias("name"),
                                   F.col("drug").startswith("Tra").cast("int").alias("starts_tra"))


@query
def fn_regex(ws):
    return ws.prescriptions.select("subject_id", "pharmacy_id", "starttime", F.lower("drug").rlike("rubicin|mab$").cast("int").alias("hit"),
                                   S.first_number(F.col("dose_val_rx")).alias("dose"))


@query
def fn_cast(ws):
    return ws.echo.select("subject_id", "measurement_datetime", "measurement", F.expr("try_cast(result AS DOUBLE)").alias("value"),
                          F.expr("try_cast(result AS INT)").alias("whole"), F.to_date("measurement_datetime").alias("day"),
                          F.expr("CAST(try_to_timestamp(result) AS TIMESTAMP_NTZ)").alias("as_time"))


@query
def fn_date(ws):
    return ws.admissions.select("hadm_id", F.to_date("admittime").alias("day"), F.datediff("dischtime", "admittime").alias("days"),
                                F.year("admittime").alias("year"), F.expr("admittime + INTERVAL '90' DAY").alias("plus_90"),
                                F.expr("admittime - INTERVAL '1' YEAR").alias("minus_year"), S.days_since_epoch(F.col("admittime")).alias("epoch_days"))


@query
def fn_math(ws):
    v = F.expr("try_cast(result AS DOUBLE)")
    return ws.echo.select("subject_id", "measurement_datetime", "measurement", F.abs(v).alias("size"), F.round(v / 7, 6).alias("ratio"),
                          (v - 50).alias("diff"), F.floor(v / 10).alias("tens"), F.greatest(F.lit(0.0), F.least(F.lit(45.0), v)).alias("clipped"))


@query
def fn_conditional(ws):
    v = F.expr("try_cast(result AS DOUBLE)")
    return ws.echo.select("subject_id", "measurement_datetime", "measurement", F.coalesce(v, F.lit(-1.0)).alias("value"),
                          F.when(v < 0, "negative").when(v < 40, "low").when(v < 50, "mid").when(v.isNotNull(), "high").otherwise("missing").alias("band"))


@query
def fn_age(ws):
    rows = ws.admissions.join(ws.patients, "subject_id", "left")
    years = S.age_years(F.col("anchor_age"), F.col("anchor_year"), F.col("admittime"))
    return rows.select("hadm_id", years.alias("age_years"), S.age_bucket(years).alias("age_id"))


@query
def fn_gap_token(ws):
    gap = F.expr("CAST(hadm_id % 400 AS INT)")
    return ws.admissions.select("hadm_id", S.gap_token(gap).alias("token"), S.gap_id(gap).alias("token_id"))


@query
def fn_quartile_bucket(ws):
    labs = ws.labevents
    cuts = exact_quantiles(labs, ["itemid"], "valuenum", TL.QUARTILES)
    rows = TL.join_fitted(labs.select("subject_id", "hadm_id", "itemid", "storetime", "valuenum"), cuts, ["itemid"])
    return rows.select("subject_id", "hadm_id", "itemid", "storetime",
                       S.quartile_suffix(F.col("valuenum"), F.col("p25"), F.col("p50"), F.col("p75"), "_Q").alias("suffix"))


@query
def fn_token_label(ws):
    return A.described(ws.attributions).groupBy("token", "label", "event_type").agg(F.count("*").alias("n"))


@query
def fn_array(ws):
    ids = F.col("concept_ids")
    return ws.sequences.select(*Q.SAMPLE, F.size(ids).alias("n"), F.array_join(F.transform(
        F.expr("slice(concept_ids, greatest(size(concept_ids) - 2, 1), 3)"), lambda x: x.cast("string")), " ").alias("tail"),
        F.get(ids, F.lit(0)).alias("head"), F.array_contains(ids, S.UNK).cast("int").alias("has_unknown"),
        F.array_position(ids, F.element_at(ids, -1)).alias("first_place_of_last"))


@query
def fn_json(ws):
    parsed = ws.raw("events").withColumn("p", F.from_json("props", "k BIGINT"))
    return parsed.select("event_id", F.col("p.k").alias("k"), F.to_json(F.struct(F.col("p.k").alias("k"), F.col("user_id").alias("user"))).alias("text"))


# Outcome and label operators


@query
def eligible_patients(ws):
    return O.eligible_patients(ws.diagnoses)


@query
def prior_dx_check(ws):
    first = X.first_exposure(X.classify(ws.prescriptions, D.MAIN_V2), "first_oncology_time")
    return O.prior_diagnosis_patients(first, "first_oncology_time", ws.diagnoses, ws.admissions)


@query
def preexisting_flags(ws):
    return ws.cohort("broad_cv").history


@query
def incident_event(ws):
    return ws.cohort("narrow_cv").facts.where("hf_event_time IS NOT NULL").select("subject_id", "hf_event_time", "hf_hadm_id", "hf_icd_codes")


@query
def lvef_drop_event(ws):
    c = ws.cohort("pan_cancer_ctrcd")
    new = O.lvef_drop_events(O.echo_baselines(c.anchor, ws.echo)[0], O.lvef_values(ws.echo))
    old = ws.main("main_v1").lvef_events
    return union_all([new.withColumn("chain", F.lit("class")), old.withColumn("chain", F.lit("main"))]).drop("event_type")


@query
def gls_relative_event(ws):
    c = ws.cohort("pan_cancer_ctrcd")
    return rounded(O.gls_relative_events(O.echo_baselines(c.anchor, ws.echo)[1], O.gls_values(ws.echo)), "gls_relative_decrease")


@query
def first_echo_event(ws):
    return rounded(ws.cohort("pan_cancer_ctrcd").echo_event, "gls_relative_decrease")


@query
def combined_event(ws):
    return rounded(ws.cohort("pan_cancer_ctrcd").events, "gls_relative_decrease")


@query
def label_5way(ws):
    return ws.cohort("pan_cancer_ctrcd").table.select("subject_id", "drug_class", "cycle_number", "label")


@query
def label_4way(ws):
    return ws.main("main_v1").table.select("subject_id", "cycle_number", "label", "binary_label", "toxicity_in_window", "eligible_for_binary_label")


@query
def label_flags(ws):
    return ws.cohort("pan_cancer_ctrcd").table.select(
        "subject_id", "drug_class", "cycle_number", "binary_label", "eligible_strict", "eligible_inclusive",
        "observed_through_prediction_window", "died_in_window_before_event")


@query
def label_1yr_master(ws):
    return ws.year.table.select("subject_id", "cv_event_1yr", "definite_lvef_ctrcd_1yr", "cardiotoxicity_1yr", "has_outcome_evidence_1yr",
                                "cardiotoxicity_label_1yr", "eligible_for_binary_label_1yr")


@query
def label_echo_only(ws):
    return rounded(ws.cohort("hf").echo_only_table, "gls_relative_decrease")


@query
def label_multi_horizon(ws):
    return L.multi_horizon(ws.samples.select("subject_id", "cycle_number", "prediction_time", "binary_label", "first_event_time"))


# Cohort pipelines


def _cohort(name):
    def run(ws):
        table = ws.cohort(name).table
        return rounded(table, "gls_relative_decrease") if "gls_relative_decrease" in table.columns else table

    return run


for _name in ("pan_cancer_ctrcd", "pan_cancer_bimodal", "broad_cv", "narrow_cv", "hf", "hf_v2", "first_class_only", "per_cycle", "per_cycle_strict", "uniform_365"):
    REGISTRY[f"cohort_{_name}"] = _cohort(_name)


@query
def cohort_main_v1(ws):
    return ws.main("main_v1").table


@query
def cohort_main_v2(ws):
    return ws.main("main_v2").table


@query
def cohort_1yr_master(ws):
    return ws.year.table


# Sequences


@query
def seq_events(ws):
    return ws.build_timeline()


@query
def seq_vocab(ws):
    return TL.vocabulary(ws.timeline)


@query
def seq_encode(ws):
    return ws.encoded.groupBy("subject_id", "visit_id", "concept_id", "type_id").agg(F.count("*").alias("n"))


def _sequence_text(df):
    return df.select(*Q.sample_key(df), text("concept_ids"), text("type_ids"), text("visit_ids"), text("dates"), "seq_len", "raw_seq_len")


@query
def seq_window(ws):
    return _sequence_text(ws.build_sequences())


@query
def seq_gap_tokens(ws):
    return _sequence_text(ws.build_sequences(gaps=True))


@query
def seq_visit_delims(ws):
    return _sequence_text(ws.build_sequences(gaps=True, delimiters=True))


# The same over cycles that are counted per drug class: the class is part of the sample's key.


@query
def seq_window_by_class(ws):
    return _sequence_text(ws.class_sequences)


@query
def seq_visit_delims_by_class(ws):
    return _sequence_text(Q.sequences_of(ws.class_past, 600, gaps=True, delimiters=True))


@query
def feat_bow_by_class(ws):
    return FE.bag_of_words(ws.class_sequences)


@query
def feat_clinical_by_class(ws):
    cohort = ws.cohort("pan_cancer_ctrcd")
    return FE.clinical(ws.class_samples, ws.class_table, O.echo_baselines(cohort.anchor, ws.echo)[0])


@query
def seq_multi_horizon(ws):
    """Every sequence once per horizon, with the horizon's task and label."""
    horizons = L.multi_horizon(ws.samples.select("subject_id", "cycle_number", "prediction_time", "binary_label", "first_event_time"))
    return Q.horizon_sequences(ws.sequences, horizons).select(*Q.SAMPLE, "task_id", "window_days", "binary_label", text("concept_ids"), "seq_len")


@query
def seq_pad_mask(ws):
    return Q.pad(ws.sequences).select(*Q.SAMPLE, text("concept_ids"), text("position_ids"), text("attention_mask"))


def _bucketed(ws, kind, **options):
    rows = ws.build_timeline(TL.TimelineOptions(**options)).where(F.col("event_type") == kind)
    return rows.groupBy("concept_token").agg(F.count("*").alias("n"), F.count_distinct("subject_id").alias("n_patients"))


@query
def seq_bucket_labs(ws):
    return _bucketed(ws, "lab", bucket_labs=True, panel="all")


@query
def seq_bucket_meds(ws):
    return _bucketed(ws, "medication", bucket_medications=True)


@query
def seq_decode(ws):
    return Q.decode(ws.sequences, ws.vocab)


@query
def seq_lookup(ws):
    return Q.subject_cycles(ws.samples, ws.splits).select("subject_id", "cycle_number", "row_idx", "split", "prediction_time", "binary_label")


@query
def seq_show(ws):
    return Q.visit_type_counts(ws.sequences)


@query
def seq_perturb_zero(ws):
    return Q.perturb_zero(ws.sequences, ws.vocab, "lab::").select(*Q.SAMPLE, text("concept_ids"))


@query
def seq_perturb_replace(ws):
    return Q.perturb_replace(ws.sequences, ws.vocab, "medication::aspirin", "medication::imatinib").select(*Q.SAMPLE, text("concept_ids"))


@query
def seq_perturb_visit(ws):
    last = Q.perturb_visit(ws.sequences, -1).select(*Q.SAMPLE, F.lit(-1).alias("visit_offset"), text("concept_ids"))
    return last.unionByName(Q.perturb_visit(ws.sequences, 2).select(*Q.SAMPLE, F.lit(2).alias("visit_offset"), text("concept_ids")))


@query
def split_patients(ws):
    return union_all([SP.split_patients(ws.samples, seed).withColumn("seed", F.lit(seed)) for seed in (42, 43)])


@query
def split_check(ws):
    return SP.check_split(ws.samples, ws.splits)


# Features and model data


def _clinical(ws, fit_on=None):
    return FE.clinical(ws.sample_keys, ws.cohort_table, ws.baselines, fit_on)


@query
def feat_clinical(ws):
    return _clinical(ws)


@query
def feat_bow(ws):
    return FE.bag_of_words(ws.sequences)


@query
def feat_combined(ws):
    return FE.combined(_clinical(ws), FE.bag_of_words(ws.sequences))


@query
def feat_scale(ws):
    rows = _clinical(ws)
    train = rows.join(ws.splits.where("split = 'train'"), "subject_id", "left_semi")
    return rounded(FE.scale(rows, train), *[f"f_{c}" for c in FE.CLINICAL])


@query
def feat_class_weight(ws):
    train = ws.samples.join(ws.splits.where("split = 'train'"), "subject_id", "left_semi")
    return FE.class_weights(train)


@query
def model_gbt(ws):
    """The test samples scored by three feature variants and two seeds (settings TREES); the statement holds samples, split, labels and the
    number of features that each variant sees of a sample."""
    sizes = {v: F.size(F.filter("features", lambda x: (x >= a) & (x < b))).alias(f"n_{v}") for v, (a, b) in FE.VARIANTS.items()}  # noqa: B023
    known = ws.tree_data.where("part = 'test'").select(*Q.SAMPLE, *sizes.values())
    sees = [F.when(F.col("variant") == v, F.col(f"n_{v}")) for v in sizes]
    scored = ws.tree_scores.join(known, Q.SAMPLE)
    return scored.where("prob_cardiotoxic between 0 and 1").select(*Q.SAMPLE, "split", "variant", "seed", "true_label", F.coalesce(*sees).alias("n_features"))


@query
def model_gbt_split(ws):
    """The first split of each feature variant with all rows and features: the figures that boosting starts from."""
    settings = boosting.Settings(rounds=1, depth=1, rows=1.0, columns=1.0)
    train = ws.splits.where("split = 'train'")
    cuts = FE.clinical_cuts(_clinical(ws).join(train, "subject_id", "left_semi"))
    data = durable(FE.model_rows(_clinical(ws), ws.splits, ws.sequences, cuts))
    models = [boosting.Model(v, 0, a, b) for v, (a, b) in FE.VARIANTS.items()]
    n = len(FE.CLINICAL)
    rows = []  # one for each variant
    for r in boosting.first_splits(data, models, settings):
        f, b = r["feature"], r["bin"]
        rows.append((models[r["model"]].name, FE.CLINICAL[f] if f < n else f"token_{f - n}", float(cuts[f][b] if f < n else b), r["missing_left"], round(r["gain"], 6), r["left_g"], r["left_h"]))
    return ws.spark.createDataFrame(rows, "variant string, feature string, at_most double, missing_left boolean, gain double, left_g long, left_h long")


@query
def pca_project(ws):
    """Three sets of vectors in the plane fitted to their union, in numbers that do not depend on the signs of the axes: means,
    variances and correlation of the coordinates, and how many vectors there are."""
    rows = ws.raw("embeddings")
    sets = {f"part_{i}": rows.where(F.col("vec_id") % 3 == i) for i in range(3)}
    out = FE.pca_joint(sets, "vec_id", "embedding")
    facts = out.agg(F.count("*").alias("n"), F.count_distinct("source", "vec_id").alias("n_ids"), F.count_distinct("source").alias("n_sources"),
                    F.round(F.abs(F.avg("pc1")), 6).alias("mean_1"), F.round(F.abs(F.avg("pc2")), 6).alias("mean_2"),
                    F.round(F.abs(F.covar_samp("pc1", "pc2")), 6).alias("covariance"), F.round(F.var_samp("pc1"), 4).alias("variance_1"),
                    (F.var_samp("pc1") >= F.var_samp("pc2")).alias("ordered"))
    return facts


# Evaluation

RATES = ["accuracy", "precision", "sensitivity", "specificity", "f1"]


@query
def eval_confusion(ws):
    return rounded(union_all([E.confusion(ws.scored, ["variant"], t).withColumn("threshold", F.lit(t)) for t in (0.5, 0.85)]), *RATES)


@query
def eval_auroc(ws):
    return rounded(union_all([E.auroc(ws.scored), E.auroc(ws.scored, ["variant"])]), "auroc")


@query
def eval_auprc(ws):
    return rounded(union_all([E.auprc(ws.scored), E.auprc(ws.scored, ["variant"])]), "auprc")


@query
def eval_logloss(ws):
    return rounded(E.log_loss(ws.scored, ["variant"]), "loss")


@query
def eval_threshold_sweep(ws):
    return rounded(E.threshold_sweep(ws.scored, 0.05, 0.7), "sensitivity", "specificity", "youden", "f1", "precision")


@query
def eval_per_task(ws):
    return rounded(E.run_metrics(ws.scored, ["task_id"]), *RATES, "auroc", "auprc", "loss")


@query
def eval_seed_summary(ws):
    return rounded(E.seed_summary(E.run_metrics(ws.scored, ["variant", "seed"]), "variant"), "mean", "std", "min", "max")


@query
def eval_history_band(ws):
    return rounded(E.history_band(ws.history, "variant", "loss"), "mean", "low", "high")


@query
def eval_seed_summary_trees(ws):
    """Run metrics of the fitted trees on the test samples, summed up over seeds."""
    return rounded(E.seed_summary(E.run_metrics(ws.tree_scores, ["variant", "seed"]), "variant"), "mean", "std", "min", "max")


@query
def eval_delta_prob_trees(ws):
    """Every sample scored by the stored trees again after edits of its sequence."""
    edits = {"zero_labs": Q.perturb_zero(ws.sequences, ws.vocab, "lab::"), "zero_last_visit": Q.perturb_visit(ws.sequences, -1),
             "replace_aspirin": Q.perturb_replace(ws.sequences, ws.vocab, "medication::aspirin", "medication::imatinib")}
    return rounded(FE.rescore(ws.tree_data, {n: ws.tree_rows(df) for n, df in edits.items()}, ws.trees), "prob_orig", "prob_perturb", "delta_prob")


@query
def eval_delta_prob(ws):
    return rounded(E.delta_probability(ws.scored, ws.edited_scores, ["row_idx"]), "prob_orig", "prob_perturb", "delta_prob")


# Attribution summaries


@query
def attr_population(ws):
    return rounded(A.population(ws.attributions), "mean_ig_signed", "std_ig_signed", "sem_ig_signed", "abs_mean_ig")


@query
def attr_feature_agg(ws):
    return rounded(A.feature_aggregation(ws.attributions, ["subject_id", "cycle_number"]),
                   "mean_rollout", "mean_ig_l2", "mean_ig_signed", "std_ig_signed", "mean_visit", "mean_days_before")


@query
def attr_event_type(ws):
    return rounded(A.by_event_type(ws.attributions), "rollout_score", "ig_score_l2", digits=4)


@query
def attr_feature_by_cycle(ws):
    return A.token_by_cycle(ws.attributions, "subject_id", "cycle_number", 5)
