"""Secret scans over an incremental ledger of blobs.  DataFrame functions only.

Every version of every path is addressed by the SHA-256 of its text.  The ledger, a folder of Parquet tables, remembers which (blob, rule
version) pairs were scanned and what was found.  A scan takes the distinct blobs, drops the pairs the ledger has, runs the missing rules
over whole texts, appends to the ledger and joins the findings of each blob back to all its paths.  A rule whose pattern changes gets a new
version and is the only one that runs again.

Positions are counted in code points, ends exclusive.  A null text counts as empty.  Equal texts share one blob, so copies cost one scan.
Empty tables give empty results; columns besides the path columns and the text take no part.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronocohort.llm.base import text_of
from chronocohort.session import durable


@dataclass(frozen=True)
class Rule:
    """Leftmost non-overlapping matches of ``pattern`` whose group ``group`` has at least ``least`` characters."""

    kind: str
    pattern: str
    least: int
    group: int = 0
    version: int = 1

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


# A run of hex digits, or of capitals and digits after AKIA, that is too short fails as a whole, so the least length may stand in the pattern.
RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 12, 2),
    Rule("access", r"AKIA[A-Z0-9]{14,}", 18),
    Rule("hex", r"[0-9a-f]{16,}", 16),
)

#: Rules by which documents are removed: as above, but a run of hex digits counts only if it holds a letter.
CREDENTIALS = (*RULES[:2], Rule("hex", r"(?<![0-9a-f])(?=[0-9]*+[a-f])[0-9a-f]{16,}", 16, version=2))

FINDING = "blob binary, rule string, kind string, start long, end long"
SCANNED = "blob binary, rule string"


def blob(text: str = "text") -> Column:
    return F.unhex(F.sha2(text_of(text), 256))


class Ledger:
    """Tables ``scanned`` and ``findings`` below one folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _read(self, name: str, schema: str) -> DataFrame:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        there = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)
        return self.spark.read.schema(schema).parquet(f"{self.folder}/{name}") if there else self.spark.createDataFrame([], schema)

    @property
    def findings(self) -> DataFrame:
        """Each once, also if a lost run had appended them before."""
        return self._read("findings", FINDING).distinct()

    @property
    def scanned(self) -> DataFrame:
        return self._read("scanned", SCANNED)

    def add(self, findings: DataFrame, scanned: DataFrame) -> None:
        findings.write.mode("append").parquet(f"{self.folder}/findings")
        scanned.write.mode("append").parquet(f"{self.folder}/scanned")  # last: what is not listed here is scanned again


def _hits(rule: Rule, text: Column, wanted: Column) -> Column:
    """Array of (rule, k, gap before the match, its length, whether it counts)."""
    found = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    counts = (lambda hit: F.length(F.regexp_extract(hit, rule.pattern, rule.group)) >= rule.least) if rule.group else (lambda hit: F.length(hit) >= rule.least)
    pieces = F.split(text, rule.pattern, -1)
    rows = F.zip_with(F.sequence(F.lit(1), F.size(found)), F.arrays_zip(found.alias("hit"), F.slice(pieces, F.lit(1), F.size(found)).alias("gap")), lambda k, x: F.struct(
        F.lit(rule.key).alias("rule"), F.lit(rule.kind).alias("kind"), k.alias("k"), F.length(x["gap"]).cast("long").alias("gap"), F.length(x["hit"]).cast("long").alias("n"), counts(x["hit"]).alias("ok")))
    return F.when(wanted & text.rlike(rule.pattern), rows).otherwise(F.array().cast("array<struct<rule:string,kind:string,k:int,gap:bigint,n:bigint,ok:boolean>>"))


def find(blobs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Findings of ``blobs`` (blob, body, todo: the rule keys to run)."""
    hits = F.concat(*[_hits(r, F.col("body"), F.array_contains("todo", r.key)) for r in rules])
    rows = blobs.select("blob", F.explode(hits).alias("h")).select("blob", "h.*")
    so_far = F.sum(F.col("gap") + F.col("n")).over(Window.partitionBy("blob", "rule").orderBy("k").rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("end", so_far).where("ok").select("blob", "rule", "kind", (F.col("end") - F.col("n")).alias("start"), "end")


def scan(versions: DataFrame, ledger: Ledger, paths: list[str], text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Bring the ledger up to date with ``versions`` and return (paths, blob): one row for each version."""
    keys = F.array(*[F.lit(r.key) for r in rules])
    named = durable(versions.select(*paths, blob(text).alias("blob")))
    seen = ledger.scanned.where(F.col("rule").isin([r.key for r in rules])).groupBy("blob").agg(F.collect_set("rule").alias("seen"))
    missing = durable(named.select("blob").distinct().join(seen, "blob", "left").select("blob", F.array_except(keys, F.coalesce("seen", F.array().cast("array<string>"))).alias("todo")).where(F.size("todo") > 0))
    bodies = versions.select(blob(text).alias("blob"), text_of(text).alias("body")).groupBy("blob").agg(F.first("body").alias("body"))
    ledger.add(find(bodies.join(missing, "blob"), rules), missing.select("blob", F.explode("todo").alias("rule")))
    return named


def spans(ledger: Ledger, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(blob, found): the spans of each blob that has any, by start and then by rule, as structs (start, rule_no, kind, end)."""
    number = F.create_map(*[F.lit(x) for i, r in enumerate(rules) for x in (r.key, i)])
    rows = ledger.findings.withColumn("rule_no", F.element_at(number, F.col("rule"))).where(F.col("rule_no").isNotNull())
    return rows.groupBy("blob").agg(F.array_sort(F.collect_list(F.struct("start", "rule_no", "kind", "end"))).alias("found"))


def join_back(named: DataFrame, ledger: Ledger, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``named`` with ``found``, an empty array where a version has no secret."""
    none = F.array().cast("array<struct<start:bigint,rule_no:int,kind:string,end:bigint>>")
    return named.join(spans(ledger, rules), "blob", "left").withColumn("found", F.coalesce("found", none))


def clean(docs: DataFrame, ledger: Ledger, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Rows of ``docs`` whose text the ledger lists no secret by ``rules`` for."""
    at = "_blob" + "_" * max(len(c) for c in docs.columns)
    dirty = ledger.findings.where(F.col("rule").isin([r.key for r in rules])).select(F.col("blob").alias(at)).distinct()
    return docs.withColumn(at, blob(text)).join(dirty, at, "left_anti").select(*docs.columns)
