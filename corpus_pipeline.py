"""From documents to training tokens, in five stages; each is written as Parquet and read again by the next.

A stage takes (spark, docs, sf_dir).  All but the last return the columns of ``docs``, also columns that documents do not have by rights.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronocohort.llm import bpe, ledger, mixing, quality, simhash
from chronocohort.llm.base import WORD, table
from chronocohort.session import durable, output_path, tune

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
SEED = 0


def _packed(docs: DataFrame, **needed: Column) -> DataFrame:
    """The whole row as one struct, so that no column of it can clash with what a stage adds."""
    return docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), *[c.alias(k) for k, c in needed.items()])


def _key() -> Column:
    """A key of doc_id that is never null: no number is written as the empty text."""
    return F.coalesce(F.col("doc_id").cast("string"), F.lit(""))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base test and are probably good by the votes of all rules.  Votes are fitted on this stage's input."""
    tune(spark)
    model = quality.posterior(quality.measures(docs.select("text")))
    judged = quality.judge(quality.measures(_packed(docs, text=F.col("text"))), model)
    return judged.where("kept").select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that with the smallest doc_id.  Of repeated rows one stays, too."""
    tune(spark)
    simhash.small_batches(spark)
    prints = durable(docs.select("doc_id", simhash.fingerprints().alias("fp")))
    first = simhash.survivors(simhash.near_duplicates(prints)).select(_key().alias("k"), "fp")
    marked = _packed(docs, k=_key(), fp=simhash.fingerprints())
    return marked.join(first, ["k", "fp"], "left_semi").dropDuplicates(["k", "fp"]).select("row.*")


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a credential; runs of digits alone are none."""
    tune(spark)
    book = ledger.Ledger(spark, output_path(spark, "ledger"))
    ledger.scan(docs.select("text"), book, [], rules=ledger.CREDENTIALS)
    return ledger.clean(docs, book, rules=ledger.CREDENTIALS)


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; of the one at which a source reaches its target, a last copy is cut after the words that
    still fit, joined by a blank, and its n_chars are counted anew."""
    tune(spark)
    taken = mixing.mix(mixing.sizes(docs), SEED).where("copies > 0 or part > 0")
    same = ["k", "s", "mark"]  # rows alike in these have one text
    s = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("")).alias("s")
    order = Window.partitionBy(*same)
    taken = taken.select(_key().alias("k"), s, "mark", "copies", "part").withColumn("i", F.row_number().over(order.orderBy(F.desc("copies"), F.desc("part"))))
    rows = _packed(docs, k=_key(), s=s, mark=mixing.mark_of())
    rows = rows.withColumn("i", F.row_number().over(order.orderBy("mark")))
    takes = F.concat(F.transform(F.sequence(F.lit(0), F.col("copies")), lambda x: F.lit(-1).cast("long")), F.array("part"))
    takes = F.filter(F.slice(takes, F.lit(2), F.size(takes)), lambda x: x != 0)
    out = rows.join(taken.select(*same, "i", takes.alias("takes")), [*same, "i"]).select("row", F.explode("takes").alias("words"))
    text = F.when(F.col("words") < 0, F.col("row.text")).otherwise(F.array_join(F.slice(F.regexp_extract_all(F.col("row.text"), F.lit(WORD), F.lit(0)), F.lit(1), F.col("words").cast("int")), " "))
    out = out.withColumn("row", out["row"].withField("text", text))
    if "n_chars" in docs.columns:
        out = out.withColumn("row", out["row"].withField("n_chars", F.when(F.col("words") < 0, F.col("row.n_chars")).otherwise(F.length("row.text"))))
    return out.select("row.*")


def bpe_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokens of each document, and whether decoding them gives its text again."""
    import public_tokenizers

    tune(spark)
    file = bpe.load(spark, public_tokenizers.path("byte_bpe_50k.json"))
    encode, decode = bpe.encoder(spark, file), bpe.decoder(spark, file)
    coded = docs.select("doc_id", "source", "text", encode("text").alias("ids"))
    both = coded.withColumn("decoded", decode("ids"))
    return both.select("doc_id", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("restored"))


STAGES: list[tuple[str, Stage]] = [
    ("quality rules", quality_rules),
    ("near duplicates", near_duplicates),
    ("secret scans", secret_scans),
    ("mixing sources", mixing_sources),
    ("bpe tokens", bpe_tokens),
]

#: Expectation-maximisation, components and byte-pair merging cannot be said in SQL; tests hold every stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
