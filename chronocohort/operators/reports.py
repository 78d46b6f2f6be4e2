"""Breakdowns and summaries of modelling tables, the year master, samples and sequences."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronocohort.functions import scalars as S
from chronocohort.operators import labels as L
from chronocohort.operators.ordering import exact_quantiles, union_all


def label_list(df: DataFrame, column: str, values: Sequence[str]) -> DataFrame:
    rows = ", ".join(f"('{v}', {i})" for i, v in enumerate(values))
    return df.sparkSession.sql(f"SELECT * FROM VALUES {rows} AS l({column}, rank)")


def breakdown(df: DataFrame, by: Sequence[str], positive: str | None = None) -> DataFrame:
    """Rows and distinct patients per group, NULL groups kept, positive rows summed on request.

    Rows are first merged per (group, patient), so the distinct count is a plain count after the shuffle.
    """
    first = df.groupBy(*by, "subject_id").agg(F.count("*").alias("n"), *([F.sum(positive).alias("p")] if positive else []))
    out = [F.sum("n").alias("n_cycle_rows"), F.count("subject_id").alias("n_patients")]
    if positive:
        out.append(F.coalesce(F.sum("p"), F.lit(0)).alias("n_positive_rows"))
    return first.groupBy(*by).agg(*out)


def preexisting_breakdown(df: DataFrame, flags: Sequence[str]) -> DataFrame:
    return df.select("subject_id", *flags).distinct().groupBy(*flags).agg(F.count("*").alias("n_patients"))


def patient_status(df: DataFrame, unknown: str = L.UNKNOWN) -> DataFrame:
    """One status per patient: positive > negative > unknown > only excluded > unclassified."""
    def has(label: str) -> Column:
        return F.max((F.col("label") == label).cast("int"))

    flags = df.groupBy("subject_id").agg(has(L.POSITIVE).alias("p"), has(L.NEGATIVE).alias("n"), has(unknown).alias("u"),
                                         has(L.EXCLUDED).alias("x"))
    return flags.select("subject_id", F.when(F.col("p") == 1, "positive_patient").when(F.col("n") == 1, "negative_observed_patient")
                        .when(F.col("u") == 1, "unknown_patient").when(F.col("x") == 1, "only_excluded_rows_review")
                        .otherwise("unclassified_review").alias("patient_status"))


def patient_summary(df: DataFrame, unknown: str = L.UNKNOWN) -> DataFrame:
    return patient_status(df, unknown).groupBy("patient_status").agg(F.count("*").alias("n_patients"))


def accounting(stages: Mapping[str, DataFrame]) -> DataFrame:
    """Attrition: distinct patients per stage."""
    return union_all([df.agg(F.count_distinct("subject_id").alias("n_patients")).select(F.lit(f"patients_in_{name}").alias("metric"), "n_patients")
                      for name, df in stages.items()])


def count_stats(df: DataFrame, key: str) -> DataFrame:
    """Distribution of the number of rows per key.

    Counts are merged into (count, frequency) first; there are few distinct counts, so the exact median is cheap.
    """
    sizes = df.groupBy(key).agg(F.count("*").alias("n")).groupBy("n").agg(F.count("*").alias("f"))
    total = F.sum("f")
    mean = F.sum(F.col("n") * F.col("f")) / total
    moments = sizes.agg(total.alias("num_keys"), mean.alias("mean"), F.expr("percentile(n, 0.5, f)").alias("median"),
                        F.min("n").alias("min"), F.max("n").alias("max"),
                        F.sum(F.col("n") * F.col("n") * F.col("f")).cast("double").alias("sq"))
    spread = F.sqrt((F.col("sq") - F.col("num_keys") * F.col("mean") * F.col("mean")) / (F.col("num_keys") - 1))
    return moments.select("num_keys", F.round("mean", 6).alias("mean"), F.round("median", 6).alias("median"), "min", "max",
                          F.round(spread, 6).alias("std"))


YEAR_FLAGS = ["cv_event_1yr", "has_baseline_lvef", "has_followup_lvef_1yr", "lvef_drop_10_1yr", "lvef_below_50_1yr",
              "definite_lvef_ctrcd_1yr", "pre_existing_cv_history", "cardiotoxicity_1yr", "has_outcome_evidence_1yr"]


def year_labels(master: DataFrame, exclude_history: bool = False) -> DataFrame:
    """The master with its three-way label and the two gap columns in whole days."""
    kept = master.where("pre_existing_cv_history = 0") if exclude_history else master
    label = (F.when(F.col("cardiotoxicity_1yr") == 1, "positive").when(F.col("has_outcome_evidence_1yr") == 1, "negative").otherwise("unknown"))

    def whole_days(late: str, early: str) -> Column:
        return F.floor((F.unix_micros(F.col(late).cast("timestamp")) - F.unix_micros(F.col(early).cast("timestamp"))) / F.lit(86_400_000_000)).cast("int")

    return (kept.withColumn("label", label).withColumn("days_baseline_to_drug", whole_days("first_oncology_time", "baseline_time"))
            .withColumn("days_drug_to_first_followup_lvef", whole_days("first_followup_lvef_time_1yr", "first_oncology_time")))


def unpivot(df: DataFrame, columns: Sequence[str], kind: str = "double") -> DataFrame:
    pairs = ", ".join(f"'{c}', CAST({c} AS {kind})" for c in columns)
    return df.selectExpr(f"stack({len(columns)}, {pairs}) AS (variable, value)")


def describe_missing(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """count, mean, std, min, exact quartiles, max and missingness, one row per column."""
    long = unpivot(df, columns)
    basic = long.groupBy("variable").agg(
        F.count("value").alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.round(F.stddev_samp("value"), 6).alias("std"),
        F.min("value").alias("min"), F.max("value").alias("max"), F.sum(F.col("value").isNull().cast("int")).alias("n_missing"),
        F.round(F.avg(F.col("value").isNull().cast("int")) * 100, 2).alias("pct_missing"))
    q = exact_quantiles(long, ["variable"], "value", {"p25": 0.25, "p50": 0.5, "p75": 0.75})
    return basic.join(q, "variable", "left").select(
        "variable", "n", "mean", "std", "min", *[F.round(c, 6).alias(c) for c in ("p25", "p50", "p75")], "max", "n_missing", "pct_missing")


def flag_summary(df: DataFrame, flags: Sequence[str] = tuple(YEAR_FLAGS)) -> DataFrame:
    return unpivot(df, flags, "int").groupBy("variable").agg(
        F.sum("value").alias("n_positive"), F.count("*").alias("n_total"),
        F.round(F.sum("value") / F.count("*") * 100, 2).alias("pct_positive"))


def label_components(df: DataFrame, flags: Sequence[str] = tuple(YEAR_FLAGS)) -> DataFrame:
    return df.groupBy("label").agg(*[F.round(F.avg(c) * 100, 2).alias(f"pct_{c}") for c in flags])


LABEL_ORDER = ["positive", "negative", "unknown"]


def label_percent(df: DataFrame, cohort: str) -> DataFrame:
    """Counts and percentages for the fixed label list, zero where a label is absent."""
    counts = df.groupBy("label").agg(F.count("*").alias("n"))
    full = label_list(df, "label", LABEL_ORDER).join(counts, "label", "left").select("label", F.coalesce("n", F.lit(0)).alias("n"))
    total = F.sum("n").over(Window.partitionBy())  # three rows
    return full.select(F.lit(cohort).alias("cohort"), "label", "n", F.round(F.col("n") / F.nullif(total, F.lit(0)) * 100, 2).alias("pct"))


def compare_labels(master: DataFrame) -> DataFrame:
    return label_percent(year_labels(master), "full_cohort").unionByName(
        label_percent(year_labels(master, True), "excluded_pre_existing_cv_history"))


def year_overview(master: DataFrame, exclude_history: bool) -> DataFrame:
    applied = F.lit(1 if exclude_history else 0)
    kept = F.when((applied == 0) | (F.col("pre_existing_cv_history") == 0), 1)
    row = master.agg(F.count("*").alias("original_n_patients"), F.count(kept).alias("analyzed_n_patients"),
                     F.count_distinct(F.when(kept == 1, F.col("subject_id"))).alias("unique_subjects"))
    row = row.withColumn("excluded_due_to_pre_existing_cv_history", F.col("original_n_patients") - F.col("analyzed_n_patients"))
    row = row.withColumn("excluded_cv_history_applied", applied.cast("bigint"))
    names = ["original_n_patients", "analyzed_n_patients", "excluded_due_to_pre_existing_cv_history", "excluded_cv_history_applied", "unique_subjects"]
    return unpivot(row, names, "bigint").select(F.col("variable").alias("metric"), "value")


def share_in_group(df: DataFrame, group: str, item: str) -> DataFrame:
    """Counts per (group, item) and their share of the group; the window runs over counts only."""
    counts = df.groupBy(group, item).agg(F.count("*").alias("n"))
    return counts.withColumn("pct", F.round(F.col("n") / F.sum("n").over(Window.partitionBy(group)) * 100, 2))


def sequence_stats(seqs: DataFrame, max_seq_len: int, count_full_as_truncated: bool = False) -> DataFrame:
    """One row on sequence lengths, truncation and labels.  Lengths are bounded, so (length, frequency) is small."""
    cut = (F.col("seq_len") == max_seq_len) if count_full_as_truncated else (F.col("raw_seq_len") > max_seq_len)
    top = F.array_max("visit_ids")
    per = seqs.groupBy("seq_len").agg(F.count("*").alias("f"), F.sum(cut.cast("int")).alias("cut"), F.sum("binary_label").alias("pos"), F.max(top).alias("v"))
    n = F.sum("f")
    mean = F.sum(F.col("seq_len") * F.col("f")) / n
    var = F.sum(F.col("seq_len") * F.col("seq_len") * F.col("f")) / n - mean * mean
    return per.agg(n.alias("n_samples"), F.sum("pos").alias("n_positive"), (n - F.sum("pos")).alias("n_negative"),
                   F.round(F.sum("pos") / n, 6).alias("positive_rate"), F.round(mean, 6).alias("mean_seq_len"),
                   F.round(F.expr("percentile(seq_len, 0.5, f)"), 6).alias("median_seq_len"), F.round(F.sqrt(var), 6).alias("std_seq_len"),
                   F.min("seq_len").alias("min_seq_len"), F.max("seq_len").alias("max_seq_len_observed"),
                   F.sum("cut").alias("n_truncated"), F.max("v").alias("max_visit_id"))


LENGTH_EDGES = [0, 50, 100, 200, 300, 400, 500]


def dataset_summary(seqs: DataFrame, vocab: DataFrame, max_seq_len: int) -> DataFrame:
    """Dataset facts as (section, item, value) rows."""
    def rows(df: DataFrame, section: str, item: str | Column, value: str | Column) -> DataFrame:
        item = F.lit(item) if isinstance(item, str) else item
        value = F.col(value) if isinstance(value, str) else value
        return df.select(F.lit(section).alias("section"), item.cast("string").alias("item"), value.cast("double").alias("value"))

    patients = seqs.groupBy("subject_id").agg(F.count("*").alias("n"), F.max("cycle_number").alias("last"), F.max("binary_label").alias("positive"))
    sizes = patients.groupBy("n").agg(F.count("*").alias("f"), F.max("last").alias("last"), F.sum("positive").alias("positive"))
    cohort = sizes.agg(F.sum("f").alias("n_patients"), F.sum(F.col("n") * F.col("f")).alias("n_samples"), F.max("last").alias("max_cycle"),
                       F.round(F.sum(F.col("n") * F.col("f")) / F.sum("f"), 6).alias("mean_cycles"),
                       F.expr("percentile(n, 0.5, f)").alias("median_cycles"), F.sum("positive").alias("positive_patients"))
    cohort_rows = unpivot(cohort, cohort.columns).select(F.lit("cohort").alias("section"), F.col("variable").alias("item"), "value")
    edge = F.lit(0)
    for low in LENGTH_EDGES[1:]:
        edge = F.when(F.col("seq_len") >= low, low).otherwise(edge)
    lengths = seqs.groupBy(edge.alias("edge")).agg(F.count("*").alias("n"))
    ages = seqs.groupBy("age_id").agg(F.count("*").alias("n"))
    types = vocab.where(F.col("token").contains("::")).groupBy(F.split("token", "::")[0].alias("type")).agg(F.count("*").alias("n"))
    used = seqs.select(F.explode("concept_ids").alias("id")).where(F.col("id") > S.V_END).distinct().agg(F.count("*").alias("n"))
    return union_all([
        cohort_rows, rows(lengths, "length_from", F.col("edge"), "n"), rows(ages, "age_decade", F.col("age_id"), "n"),
        rows(types, "vocab_type", F.col("type"), "n"), rows(used, "vocabulary", "used", "n"),
        rows(vocab.agg(F.count("*").alias("n")), "vocabulary", "size", "n")])


def split_summary(samples: DataFrame, splits: DataFrame) -> DataFrame:
    """Patients, samples, positives and percentages per split; one pre-aggregated row per patient."""
    per = samples.groupBy("subject_id").agg(F.count("*").alias("n"), F.sum("binary_label").alias("p"))
    by = per.join(splits.select("subject_id", "split"), "subject_id").groupBy("split").agg(
        F.count("*").alias("n_patients"), F.sum("n").alias("n_samples"), F.sum("p").alias("n_positive"))
    share = F.round(100 * F.col("n_patients") / F.sum("n_patients").over(Window.partitionBy()), 1)  # three rows
    return by.select("split", "n_patients", "n_samples", "n_positive", (F.col("n_samples") - F.col("n_positive")).alias("n_negative"),
                     F.round(100 * F.col("n_positive") / F.col("n_samples"), 1).alias("pct_positive"), share.alias("pct_patients"))
