"""Metrics of scored samples.  Scores are merged to distinct values before anything is ordered."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronocohort.operators.ordering import magnitude_chunk, prefix_sums

P, Y = "prob_cardiotoxic", "true_label"


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(0.0)


def rates(df: DataFrame) -> DataFrame:
    """Metric columns from tp, fp, fn, tn; undefined ratios are 0."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return (df.withColumn("accuracy", _ratio(tp + tn, tp + fp + fn + tn)).withColumn("precision", _ratio(tp, tp + fp))
            .withColumn("sensitivity", _ratio(tp, tp + fn)).withColumn("specificity", _ratio(tn, tn + fp))
            .withColumn("f1", _ratio(2 * tp, 2 * tp + fp + fn)))


def confusion(df: DataFrame, by: Sequence[str] = (), threshold: float = 0.5) -> DataFrame:
    hit, yes = F.col(P) >= threshold, F.col(Y) == 1

    def n(c: Column) -> Column:
        return F.count(F.when(c, 1))

    return rates(df.groupBy(*by).agg(n(hit & yes).alias("tp"), n(hit & ~yes).alias("fp"), n(~hit & yes).alias("fn"), n(~hit & ~yes).alias("tn")))


def score_steps(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Positives and negatives per distinct score."""
    return df.groupBy(*by, F.col(P).alias("s")).agg(F.sum(Y).alias("pos"), F.sum(1 - F.col(Y)).alias("neg"))


def _curves(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Score steps with the running counts from the lowest score up and the group's totals: all that the metrics need, from one scan."""
    steps = score_steps(df, by)
    running = prefix_sums(steps, by, [F.col("s")], magnitude_chunk(F.col("s")), {"pos_upto": "pos", "neg_upto": "neg"})
    totals = steps.groupBy(*by).agg(F.sum("pos").alias("all_pos"), F.sum("neg").alias("all_neg"))
    return running.join(totals, list(by)) if by else running.crossJoin(F.broadcast(totals))  # one row


def _auroc() -> Column:
    """Rank-sum area with ties counted half; NULL when only one class is present."""
    area = F.sum(F.col("pos") * (F.col("neg_upto") - F.col("neg") / 2))
    return area / F.nullif(F.sum("pos") * F.sum("neg"), F.lit(0))


def _auprc() -> Column:
    """Average precision: recall steps times precision over distinct scores, from the highest down."""
    pos_down = F.col("all_pos") - F.col("pos_upto") + F.col("pos")
    neg_down = F.col("all_neg") - F.col("neg_upto") + F.col("neg")
    return F.sum(F.col("pos") * pos_down / (pos_down + neg_down)) / F.nullif(F.sum("pos"), F.lit(0))


def auroc(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return _curves(df, by).groupBy(*by).agg(_auroc().alias("auroc"))


def auprc(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return _curves(df, by).groupBy(*by).agg(_auprc().alias("auprc"))


EPS = 2.220446049250313e-16


def _loss() -> Column:
    p = F.least(F.greatest(F.col("s"), F.lit(EPS)), F.lit(1 - EPS))
    return F.sum(-F.log(p) * F.col("pos") - F.log(1 - p) * F.col("neg")) / F.nullif(F.sum("pos") + F.sum("neg"), F.lit(0))


def log_loss(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return score_steps(df, by).groupBy(*by).agg(_loss().alias("loss"))


def threshold_sweep(df: DataFrame, step: float = 0.05, target_sensitivity: float = 0.70) -> DataFrame:
    """All thresholds in one pass: each score counts once, in the bucket of thresholds it reaches.

    Marks the best Youden J (lowest threshold on ties), overall and among those with enough sensitivity.
    """
    levels = []
    while round(step * (len(levels) + 1), 3) < 1.0:
        levels.append(round(step * (len(levels) + 1), 3))
    reached = F.size(F.filter(F.array(*[F.lit(t) for t in levels]), lambda t: t <= F.col(P)))
    counts = df.groupBy(reached.alias("k")).agg(F.sum(Y).alias("pos"), F.sum(1 - F.col(Y)).alias("neg"))
    buckets = counts.agg(F.collect_list(F.struct("k", "pos", "neg")).alias("b"))  # one row, at most len(levels) + 1 buckets
    each = F.explode(F.array(*[F.struct(F.lit(i + 1).alias("level"), F.lit(t).alias("threshold")) for i, t in enumerate(levels)]))
    joined = buckets.select("b", each.alias("x")).select("b", "x.level", "x.threshold")

    def part(name: str, above: bool) -> Column:
        kept = F.filter("b", lambda x: (x["k"] >= F.col("level")) if above else (x["k"] < F.col("level")))
        return F.aggregate(F.transform(kept, lambda x: x[name]), F.lit(0).cast("bigint"), lambda a, x: a + x)

    out = rates(joined.select("threshold", part("pos", True).alias("tp"), part("neg", True).alias("fp"), part("pos", False).alias("fn"), part("neg", False).alias("tn")))
    j = F.col("sensitivity") + F.col("specificity") - 1
    out = out.withColumn("youden", F.round(j, 9)).withColumn("meets", F.col("sensitivity") >= target_sensitivity)
    best = Window.partitionBy().orderBy(F.desc("youden"), "threshold")  # one row per threshold
    best_target = Window.partitionBy().orderBy(F.desc("meets"), F.desc("youden"), "threshold")
    return out.select("threshold", "sensitivity", "specificity", "youden", "f1", "precision",
                      (F.row_number().over(best) == 1).cast("int").alias("best_j"),
                      ((F.row_number().over(best_target) == 1) & F.col("meets")).cast("int").alias("best_target"))


METRICS = ["auroc", "auprc", "f1", "sensitivity", "specificity", "loss"]


def run_metrics(df: DataFrame, by: Sequence[str], threshold: float = 0.5) -> DataFrame:
    """All run metrics per group (task, variant, seed, ...), from one table of score steps."""
    hit = F.col("s") >= threshold

    def n(column: str, kept: Column) -> Column:
        return F.sum(F.when(kept, F.col(column)).otherwise(0))

    out = _curves(df, list(by)).groupBy(*by).agg(
        n("pos", hit).alias("tp"), n("neg", hit).alias("fp"), n("pos", ~hit).alias("fn"), n("neg", ~hit).alias("tn"),
        _auroc().alias("auroc"), _auprc().alias("auprc"), _loss().alias("loss"))
    return rates(out)


def seed_summary(runs: DataFrame, group: str, sort_by: str = "auroc") -> DataFrame:
    """Mean, sample deviation (0 for one run), min and max per group and metric; groups ranked by one mean."""
    pairs = ", ".join(f"'{m}', {m}" for m in METRICS)
    long = runs.selectExpr(group, f"stack({len(METRICS)}, {pairs}) AS (metric, value)")
    stats = long.groupBy(group, "metric").agg(F.count("value").alias("n"), F.avg("value").alias("mean"),
                                              F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias("std"), F.min("value").alias("min"), F.max("value").alias("max"))
    lead = stats.where(F.col("metric") == sort_by).select(group, F.col("mean").alias("_lead"))
    ranked = lead.withColumn("rank", F.row_number().over(Window.partitionBy().orderBy(F.desc("_lead"), group))).drop("_lead")  # one row per group
    return stats.join(ranked, group)


def history_band(history: DataFrame, group: str, metric: str) -> DataFrame:
    """Per epoch mean and mean +- sample deviation over seeds, cut to the shortest run of the group."""
    shortest = history.groupBy(group, "seed").agg(F.count("*").alias("n")).groupBy(group).agg(F.min("n").alias("shortest"))
    order = Window.partitionBy(group, "seed").orderBy("epoch")
    kept = history.withColumn("step", F.row_number().over(order)).join(shortest, group).where("step <= shortest")
    s = F.coalesce(F.stddev_samp(metric), F.lit(0.0))
    return kept.groupBy(group, "step").agg(F.avg(metric).alias("mean"), (F.avg(metric) - s).alias("low"), (F.avg(metric) + s).alias("high"))


def delta_probability(original: DataFrame, perturbed: DataFrame, key: Sequence[str]) -> DataFrame:
    """Score after an edit minus the score before, per sample and edit."""
    before = original.select(*key, F.col(P).alias("prob_orig"))
    return perturbed.join(before, list(key)).select(*key, "edit", "prob_orig", F.col(P).alias("prob_perturb"),
                                                    (F.col(P) - F.col("prob_orig")).alias("delta_prob"))
