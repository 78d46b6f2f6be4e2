"""Feature tables, scaling, class weights and the tree baseline."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronocohort.functions import scalars as S
from chronocohort.functions.drugs import MAIN_CLASSES
from chronocohort.operators import boosting
from chronocohort.operators.ordering import exact_quantiles, union_all
from chronocohort.operators.sequence import sample_key
from chronocohort.session import durable

CLINICAL = [f"exposed_{c}" for c in MAIN_CLASSES] + [
    "has_pre_existing_hf_or_cmp", "baseline_lvef", "cycle_number", "toxicity_window_days",
    "n_prescription_rows_in_cycle", "n_exposure_start_days_in_cycle"]


def clinical(samples: DataFrame, cohort: DataFrame, baselines: DataFrame, fit_on: DataFrame | None = None) -> DataFrame:
    """The sixteen structured features; a missing baseline takes the median over the patients of ``fit_on`` (default: all rows).

    The baseline is the true as-of value, not the one that event tables fill only for positives.  Where cycles are counted per class, a
    sample is exposed to its own class.
    """
    key = sample_key(samples)
    structured = [c for c in CLINICAL if c not in ("cycle_number", "baseline_lvef")]

    def value(name: str) -> Column:
        exposed = "drug_class" in key and name.startswith("exposed_")
        return (F.col("drug_class") == name.removeprefix("exposed_")).cast("int") if exposed else F.col(name)

    table = cohort.select(*key, *[value(c).alias(c) for c in structured])
    rows = (samples.select(*key, "binary_label").join(table, key, "left")
            .join(baselines.select("subject_id", "baseline_lvef"), "subject_id", "left"))
    if fit_on is not None:
        rows = durable(rows)  # the median reads them several times
    fitted = rows if fit_on is None else rows.join(fit_on.select("subject_id").distinct(), "subject_id", "left_semi")
    median = exact_quantiles(fitted.withColumn("all", F.lit(1)), ["all"], "baseline_lvef", {"m": 0.5}).select("m").scalar()
    fills = {"baseline_lvef": median, "n_prescription_rows_in_cycle": F.lit(1.0)}
    values = [F.coalesce(F.col(c).cast("double"), fills.get(c, F.lit(None)).cast("double")).alias(f"f_{c}") for c in CLINICAL]
    return rows.select(*key, "binary_label", *values)


def bag_of_words(seqs: DataFrame) -> DataFrame:
    """Token counts per sample in sparse long form; reserved tokens and padding left out."""
    key = sample_key(seqs)
    return (seqs.select(*key, F.explode("concept_ids").alias("token_id")).where(F.col("token_id") >= len(S.RESERVED))
            .groupBy(*key, "token_id").agg(F.count("*").alias("n")))


def combined(clinical_rows: DataFrame, bow: DataFrame) -> DataFrame:
    """Clinical features and token counts in one sparse long table (feature, value)."""
    key = sample_key(clinical_rows)
    pairs = ", ".join(f"'{c}', f_{c}" for c in CLINICAL)
    left = clinical_rows.selectExpr(*key, f"stack({len(CLINICAL)}, {pairs}) AS (feature, value)")
    right = bow.select(*key, F.concat(F.lit("token_"), F.col("token_id").cast("string")).alias("feature"), F.col("n").cast("double").alias("value"))
    return left.unionByName(right)


def scale(rows: DataFrame, train: DataFrame, features: Sequence[str] = tuple(CLINICAL)) -> DataFrame:
    """Standardise with the mean and population deviation of the training rows; a constant column keeps scale 1."""
    moments = train.agg(F.struct(*[F.avg(f"f_{c}").alias(f"m_{c}") for c in features], *[F.stddev_pop(f"f_{c}").alias(f"s_{c}") for c in features]).alias("s")).scalar()
    fitted = rows.withColumn("_s", moments)
    deviation = {c: F.when(F.col(f"_s.s_{c}") > 0, F.col(f"_s.s_{c}")).otherwise(1.0) for c in features}
    scaled = [((F.col(f"f_{c}") - F.col(f"_s.m_{c}")) / deviation[c]).alias(f"f_{c}") for c in features]
    return fitted.select(*sample_key(rows), "binary_label", *scaled)


def class_weights(samples: DataFrame) -> DataFrame:
    """neg/pos ratio and inverse-rate weights."""
    p, n = F.sum("binary_label"), F.count("*")
    return samples.agg(n.alias("n"), p.alias("n_positive"),
                       F.round(F.coalesce((n - p) / F.nullif(p, F.lit(0)), F.lit(1.0)), 6).alias("scale_pos_weight"),
                       F.round(n / F.nullif(n - p, F.lit(0)), 6).alias("weight_negative"),
                       F.round(n / F.nullif(p, F.lit(0)), 6).alias("weight_positive"))


VARIANTS = {"clinical": (0, len(CLINICAL)), "bow": (len(CLINICAL), boosting.WIDTH), "combined": (0, boosting.WIDTH)}


def clinical_cuts(train: DataFrame) -> list[list[float]]:
    """Bounds of the bins of each clinical feature: all its values if there are fewer than BINS, else as many percentiles."""
    most = boosting.BINS - 1
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col(f"f_{c}").alias("x")) for i, c in enumerate(CLINICAL)])).alias("v")
    values = durable(train.select(each).select("v.*").where("x is not null").distinct())  # rows are read once; counts of distinct values need no more
    counts = {r["i"]: r["n"] for r in values.groupBy("i").agg(F.approx_count_distinct("x", 0.01).alias("n")).collect()}
    few = [i for i in range(len(CLINICAL)) if counts.get(i, 0) < most * 0.9]  # the count is within a few per cent
    found = {r["i"]: r["x"] for r in values.where(F.col("i").isin(few)).groupBy("i").agg(F.array_sort(F.collect_set("x")).alias("x")).collect()}  # at most BINS numbers for each feature
    many = [i for i in range(len(CLINICAL)) if i not in few]
    if many:
        shares = [i / most for i in range(most)] + [1.0]
        row = train.agg(*[F.array_sort(F.array_distinct(F.percentile_approx(f"f_{CLINICAL[i]}", shares, 100_000))) for i in many]).first()
        found |= dict(zip(many, row))
    return [list(found.get(i) or [])[: most - 1] for i in range(len(CLINICAL))]


def token_bin(n: Column) -> Column:
    """Counts to 16 as they are, larger ones by powers of two."""
    return F.when(n <= 16, n).otherwise(F.least(F.lit(boosting.BINS - 1), 16 + F.floor(F.log2(n / 16.0)))).cast("int")


def token_bins(n: np.ndarray) -> np.ndarray:
    """The same of an array."""
    large = np.maximum(n, 16) / 16.0
    return np.where(n <= 16, n, np.minimum(boosting.BINS - 1, 16 + np.floor(np.log(large) / np.log(2.0)).astype(np.int64)))


def _cells(table: pa.RecordBatch, cuts: list[list[float]]) -> tuple[pa.Array, pa.Array]:
    """Features and bins of each row, in the order of the features: clinical ones, then tokens by their number."""
    n = table.num_rows
    facts = [table.column(f"f_{c}") for c in CLINICAL]
    known = np.stack([x.is_valid().to_numpy(zero_copy_only=False) for x in facts], axis=1)
    place = np.stack([np.searchsorted(np.array(cuts[i], float), x.fill_null(0.0).to_numpy()) for i, x in enumerate(facts)], axis=1)
    at, feature = np.nonzero(known)
    ids = table.column("ids")
    row = np.repeat(np.arange(n), np.diff(ids.offsets.to_numpy()))  # a row without a list has none
    token = ids.flatten().fill_null(0).to_numpy().astype(np.int64)
    row, token = (x[token >= len(S.RESERVED)] for x in (row, token))
    width = int(token.max(initial=0)) + 1
    codes = row * width + token
    if n * width <= 8 * len(codes):
        counts = np.bincount(codes, minlength=n * width)
        codes = np.flatnonzero(counts)
        counts = counts[codes]
    else:
        codes, counts = np.unique(codes, return_counts=True)
    row, token = np.divmod(codes, width)
    order = np.argsort(np.r_[at, row], kind="stable")
    offsets = pa.array(np.r_[0, np.cumsum(np.bincount(at, minlength=n) + np.bincount(row, minlength=n))].astype(np.int32))
    cells = (np.r_[feature, token + len(CLINICAL)], np.r_[place[known], token_bins(counts)])
    return tuple(pa.ListArray.from_arrays(offsets, pa.array(x[order].astype(np.int32))) for x in cells)


def model_rows(rows: DataFrame, splits: DataFrame, seqs: DataFrame, cuts: list[list[float]]) -> DataFrame:
    """One row per sample for ``boosting``: its clinical features and its tokens, each with its bin; what is missing has no entry.

    Tokens stay in the arrays they come in; only these arrays are shuffled, and counted within a sample's row."""
    key = sample_key(rows)
    words = seqs.groupBy(*key).agg(F.flatten(F.collect_list("concept_ids")).alias("ids"))
    facts = [f"f_{c}" for c in CLINICAL]
    out = (rows.join(splits.select("subject_id", F.col("split").alias("part")), "subject_id").join(words, key, "left")
           .select(*key, F.xxhash64(*key).alias("row_id"), "part", F.col("binary_label").cast("int").alias("label"), *[F.col(c).cast("double").alias(c) for c in facts], "ids"))
    keep = [*key, "row_id", "part", "label"]

    def binned(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], *_cells(batch, cuts)], names=[*keep, "features", "bins"])

    return out.mapInArrow(binned, T.StructType([*[out.schema[c] for c in keep], *T.StructType.fromDDL("features array<int>, bins array<int>").fields]))


def fit_trees(data: DataFrame, variants: Sequence[str] = tuple(VARIANTS), seeds: Sequence[int] = (42,), settings: boosting.Settings = boosting.Settings()) -> list[boosting.Model]:
    """A model for each variant and seed, cut at its best round; all are grown side by side."""
    return boosting.kept(boosting.fit(data, [boosting.Model(v, s, *VARIANTS[v]) for v in variants for s in seeds], settings))


def tree_runs(data: DataFrame, models: list[boosting.Model]) -> DataFrame:
    """The test samples scored by every model."""
    key = sample_key(data)
    scored = boosting.score(data.where("part = 'test'"), models, [*key, "part", "label"])
    return scored.withColumnsRenamed({"part": "split", "label": "true_label"})


def rescore(original: DataFrame, edits: Mapping[str, DataFrame], models: list[boosting.Model]) -> DataFrame:
    """Score of every sample by every model before and after each edit of its features, and the difference."""
    key = sample_key(original)
    before = boosting.score_all(original, models, key).withColumnRenamed("scores", "before")
    after = union_all([boosting.score_all(df, models, key).withColumn("edit", F.lit(name)) for name, df in edits.items()])
    # samples are joined with the scores of all models side by side; only then is there a row for each model
    of_model = F.array(*[F.struct(F.lit(m.name).alias("variant"), F.lit(m.seed).alias("seed"), F.get("scores", F.lit(i)).alias("prob_perturb"), F.get("before", F.lit(i)).alias("prob_orig")) for i, m in enumerate(models)])
    each = after.join(before, key).select(*key, "edit", F.explode(of_model).alias("x"))
    return each.select(*key, "x.variant", "x.seed", "edit", "x.prob_perturb", "x.prob_orig").withColumn("delta_prob", F.col("prob_perturb") - F.col("prob_orig"))


def pca_project(vectors: DataFrame, ids: Sequence[str], vector_column: str, k: int = 2) -> DataFrame:
    """Centred projection on the first k principal components; signs are free."""
    from pyspark.ml.feature import PCA, StandardScaler
    from pyspark.ml.functions import array_to_vector, vector_to_array

    rows = vectors.select(*ids, array_to_vector(F.transform(vector_column, lambda x: x.cast("double"))).alias("v"))
    centred = StandardScaler(withMean=True, withStd=False, inputCol="v", outputCol="c").fit(rows).transform(rows)
    done = PCA(k=k, inputCol="c", outputCol="p").fit(centred).transform(centred).withColumn("a", vector_to_array("p"))
    return done.select(*ids, *[F.col("a")[i].alias(f"pc{i + 1}") for i in range(k)])


def pca_joint(sets: Mapping[str, DataFrame], id_column: str, vector_column: str, k: int = 2) -> DataFrame:
    """Any number of named sets in the plane fitted to their union; ``source`` names the set, ids stay."""
    named = [df.select(F.lit(name).alias("source"), id_column, vector_column) for name, df in sets.items()]
    return pca_project(union_all(named), ["source", id_column], vector_column, k)
