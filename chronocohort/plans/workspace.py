"""The pipelines over one folder of tables: cohorts, samples, timeline, sequences, scored samples."""

from __future__ import annotations

from functools import cached_property, lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronocohort.operators import boosting
from chronocohort.operators import features as FE
from chronocohort.operators import sequence as Q
from chronocohort.operators import timeline as TL
from chronocohort.operators.labels import binary_table
from chronocohort.operators.outcomes import echo_baselines
from chronocohort.operators.split import row_positions, split_patients
from chronocohort.plans.cohorts import MAIN_SPECS, SPECS, Cohort, MainCohort, YearMaster
from chronocohort.session import durable
from chronocohort.sources.adapters import Clinic

SEQ_LEN = 600
#: Of the registered tree runs: larger steps and less patience than the operator's defaults (500 rounds, patience 30, step 0.05).
TREES = boosting.Settings(rounds=60, patience=8, step=0.3)


class Workspace(Clinic):
    """Clinical tables plus the stages built on them; one instance per job.

    Stage outputs that the pipeline hands on as files (modelling samples, vocabulary, sequences) are written once per session
    and folder and kept in ``stages``; everything else is planned anew by each job.
    """

    def __init__(self, spark: SparkSession, folder: str, stages: dict | None = None):
        super().__init__(spark, folder)
        self.stages = {} if stages is None else stages

    def stage(self, name: str, build) -> DataFrame:
        if name not in self.stages:
            self.stages[name] = durable(build())
        return self.stages[name]

    @property
    def lines(self) -> DataFrame:
        """Order lines with their patient, joined and stored once: five clinical tables are columns of it, which only a scan of stored columns can prune and filter."""
        return self.stage("lines", lambda: Clinic(self.spark, self.folder).lines)

    @lru_cache(maxsize=None)
    def cohort(self, name: str) -> Cohort:
        return Cohort(SPECS[name], self)

    @lru_cache(maxsize=None)
    def main(self, name: str, strict_reference: bool = False) -> MainCohort:
        return MainCohort(MAIN_SPECS[name], self, strict_reference)

    @cached_property
    def year(self) -> YearMaster:
        return YearMaster(self)

    @property
    def cohort_table(self) -> DataFrame:
        """Stage 1 output: the full joint modelling table."""
        return self.stage("cohort_table", lambda: self.cohort("uniform_365").table)

    def build_samples(self) -> DataFrame:
        table = binary_table(self.cohort_table, "eligible_inclusive").select(
            "subject_id", "cycle_number", "prediction_time", "binary_label", "first_event_time", "drug_classes_in_cycle", "drugs_in_cycle")
        return row_positions(Q.with_age(table, self.patients))

    @property
    def samples(self) -> DataFrame:
        """Stage 1 output: the inclusive rows with age and row index."""
        return self.stage("samples", self.build_samples)

    @cached_property
    def sample_keys(self) -> DataFrame:
        return self.samples.select("subject_id", "cycle_number", "prediction_time", "binary_label", "age_id")

    def build_timeline(self, options: TL.TimelineOptions = TL.TimelineOptions()) -> DataFrame:
        return TL.timeline(self, self.samples, options)

    @property
    def timeline(self) -> DataFrame:
        """Stage 2 input: the samples' patients' events, which vocabulary and sequences share."""
        return self.stage("timeline", self.build_timeline)

    @property
    def vocab(self) -> DataFrame:
        return self.stage("vocab", lambda: TL.vocabulary(self.timeline))

    @property
    def encoded(self) -> DataFrame:
        return TL.encode(self.timeline, self.vocab)

    @property
    def past(self) -> Q.Past:
        """Ordered events and histories: the same for plain sequences, gaps, delimiters and any length."""
        if "past" not in self.stages:
            self.stages["past"] = Q.past(self.sample_keys, self.encoded)
        return self.stages["past"]

    def build_sequences(self, **options) -> DataFrame:
        return Q.sequences_of(self.past, options.pop("max_seq_len", SEQ_LEN), **options)

    @property
    def sequences(self) -> DataFrame:
        """Stage 2 output: plain sequences, written once for the users of stage 2."""
        return self.stage("sequences", self.build_sequences)

    @property
    def class_table(self) -> DataFrame:
        return self.stage("class_table", lambda: self.cohort("pan_cancer_ctrcd").table)

    @property
    def class_samples(self) -> DataFrame:
        """Samples whose cycles are counted per drug class, so a patient may have the same cycle number several times."""
        table = binary_table(self.class_table, "eligible_inclusive").select("subject_id", "cycle_number", "drug_class", "prediction_time", "binary_label")
        return self.stage("class_samples", lambda: table)

    @property
    def class_past(self) -> Q.Past:
        if "class_past" not in self.stages:
            events = self.stage("class_timeline", lambda: TL.timeline(self, self.class_samples))
            vocab = self.stage("class_vocab", lambda: TL.vocabulary(events))
            self.stages["class_past"] = Q.past(self.class_samples, TL.encode(events, vocab))
        return self.stages["class_past"]

    @property
    def class_sequences(self) -> DataFrame:
        return self.stage("class_sequences", lambda: Q.sequences_of(self.class_past, SEQ_LEN))

    @property
    def splits(self) -> DataFrame:
        """One row per patient, written once: all that is fitted or scored joins it."""
        return self.stage("splits", lambda: split_patients(self.samples, 42))

    @cached_property
    def tree_cuts(self) -> list[list[float]]:
        train = self.splits.where("split = 'train'").select("subject_id")
        return FE.clinical_cuts(self.tree_clinical.join(train, "subject_id", "left_semi"))

    @property
    def tree_clinical(self) -> DataFrame:
        """Clinical features; a missing baseline takes the median of the training patients."""
        return self.stage("tree_clinical", lambda: FE.clinical(self.sample_keys, self.cohort_table, self.baselines, self.splits.where("split = 'train'")))

    def tree_rows(self, seqs: DataFrame) -> DataFrame:
        return FE.model_rows(self.tree_clinical, self.splits, seqs, self.tree_cuts)

    @property
    def tree_data(self) -> DataFrame:
        return self.stage("tree_data", lambda: self.tree_rows(self.sequences))

    @property
    def trees(self) -> list[boosting.Model]:
        """The fitted tree models, stored as a stage; scoring and rescoring read them from there."""
        return boosting.from_table(self.stage("trees", lambda: boosting.as_table(self.spark, FE.fit_trees(self.tree_data, seeds=(42, 43), settings=TREES))))

    @property
    def tree_scores(self) -> DataFrame:
        """The test samples scored by every tree model."""
        return self.stage("tree_scores", lambda: FE.tree_runs(self.tree_data, self.trees))

    @cached_property
    def baselines(self) -> DataFrame:
        return echo_baselines(self.cohort("uniform_365").anchor, self.echo)[0]

    # Scored samples, run history and attributions over the driver's tables (fixtures, see FIXTURES.md).

    @cached_property
    def scored(self) -> DataFrame:
        return self.raw("orders").select(
            F.lit("test").alias("split"), F.col("o_orderkey").alias("split_pos"), F.col("o_orderkey").alias("row_idx"),
            F.col("o_custkey").alias("subject_id"), F.expr("CAST(1 + o_orderkey % 4 AS INT)").alias("cycle_number"),
            F.col("o_orderdate").alias("prediction_time"),
            F.expr("CASE WHEN (o_orderkey * 31 + o_custkey) % 3 = 0 THEN 1 ELSE 0 END").alias("true_label"),
            F.expr("((o_orderkey * 7919) % 1000) / 1000.0D").alias("prob_cardiotoxic"),
            F.expr("lower(replace(o_orderpriority, ' ', '_'))").alias("variant"),
            F.expr("CAST(o_orderkey % 5 AS INT)").alias("seed"), F.expr("CAST(o_orderkey % 3 AS INT)").alias("task_id"))

    @cached_property
    def edited_scores(self) -> DataFrame:
        return self.raw("orders").select(
            F.col("o_orderkey").alias("row_idx"), F.expr("CASE WHEN o_orderkey % 2 = 0 THEN 'zero_labs' ELSE 'drop_last_visit' END").alias("edit"),
            F.expr("((o_orderkey * 6101) % 1000) / 1000.0D").alias("prob_cardiotoxic"))

    @cached_property
    def history(self) -> DataFrame:
        """Epoch losses per variant and seed; seeds stop at different epochs."""
        return (self.scored.withColumn("epoch", F.expr("CAST(1 + (row_idx * 7919) % (10 + seed) AS INT)"))
                .groupBy("variant", "seed", "epoch").agg(F.avg("prob_cardiotoxic").alias("loss")))

    @cached_property
    def attributions(self) -> DataFrame:
        token = F.expr("CASE l_linenumber % 4 WHEN 0 THEN concat('diagnosis::', icd, '_ICDver', ver) WHEN 1 THEN concat('lab::', item)"
                       " WHEN 2 THEN concat('medication::', lower(drug)) ELSE '[CLS]' END")
        rx = self.lines.withColumn("icd", F.expr("CASE WHEN l_partkey % 2 = 0 THEN 'I500' ELSE '4280' END"))
        rx = (rx.withColumn("ver", F.expr("CASE WHEN l_partkey % 2 = 0 THEN '10' ELSE '9' END"))
              .withColumn("item", F.expr("element_at(array('50912', '51006', '59999', '51222_Q1'), CAST(1 + l_suppkey % 4 AS INT))"))
              .withColumn("drug", F.expr("element_at(array('Doxorubicin HCl', 'Imatinib', 'Trastuzumab emtansine conjugate'), CAST(1 + l_partkey % 3 AS INT))")))
        return rx.select(
            F.col("o_custkey").alias("subject_id"), F.expr("CAST(1 + l_orderkey % 7 AS INT)").alias("cycle_number"),
            F.expr("l_orderkey * 10 + l_linenumber").alias("position"), token.alias("token"),
            (F.col("l_extendedprice") / 77777).alias("rollout_score"), (F.abs(F.col("l_quantity") - 25) / 25).alias("ig_score_l2"),
            (F.col("l_quantity") - 25).alias("ig_score_signed"), F.expr("CAST(1 + l_suppkey % 6 AS INT)").alias("visit"),
            F.expr("-CAST(l_partkey % 400 AS DOUBLE)").alias("days_before"))


_STAGES: dict[tuple[str, str], dict] = {}


def workspace(spark: SparkSession, folder: str) -> Workspace:
    """A new job's workspace; jobs of one session over one folder share its stage outputs.  Files that change during a session are not noticed."""
    return Workspace(spark, folder, _STAGES.setdefault((spark.sparkContext.applicationId, folder), {}))
