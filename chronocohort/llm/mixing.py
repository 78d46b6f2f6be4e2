"""Mixing sources to target weights by Pareto order sampling.

Sources share a budget of words by weight; a source gets at most ``most`` times what it has, and what it cannot take is shared again.  With
``target / source size`` as expected copies of each document, the whole part is allocated for certain and the fraction p is the inclusion
probability of one more copy.  Documents are ranked by random odds over inclusion odds, (u / (1 - u)) / (p / (1 - p)), and taken in that
order until the source's fixed size, in words, is reached; of the last one only the words that still fit are taken.  So each source meets
its target to the word, and reruns agree: u comes from a hash of seed, doc_id and text, so rows without doc_id, or with one, fall all over a source.

The ranking never sorts a whole source: keys fall into bins, more of them in longer sources, bin totals give offsets, and only the bin in which the
target falls is ordered.  In it rows alike in doc_id and text are counted, not ordered, and dealt out again in pieces.  Sources are few: one row of each
is ordered in one task, as is one row of each bin of a source.

A null text has no words and is taken 0 times; very long texts count as any other.  The null source is a source of its own, after all others.  A null
doc_id hashes like an empty one.  Rows alike in doc_id and text tie: they may be taken differently, but their number of copies in all is
fixed.  Empty tables, and sources without words, give nothing to take.  Other columns take no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronocohort.llm.base import WORD
from chronocohort.session import durable

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2
BINS = 1024  # of a source at least
BIN_ROWS = 4096  # rows in a bin, about
PIECE = 4096  # rows alike that one task deals out


def size_of(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text).cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def sizes(docs: DataFrame, source: str = "source", text: str = "text") -> DataFrame:
    """(doc_id, source, size, mark), stored; the mark is a digest of the text."""
    return durable(docs.select("doc_id", F.col(source).alias("source"), size_of(text).alias("size"), mark_of(text).alias("mark")))


def mark_of(text: str = "text") -> Column:
    return F.md5(F.coalesce(F.col(text).cast("string"), F.lit("")))


def uniform(seed: int) -> Column:
    """In (0, 1), from 52 bits of an MD5 of seed, doc_id and mark."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("mark")))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 52))


def targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """(source, source_size, n_rows, target, whole, budget) for each source: copies allocated for certain, and words still to take.

    Filling by weight until none is above its limit ends at one level t with target = least(limit, weight * t).  Sources reach their limit in
    the order of limit / weight, so t follows from running totals over the sources, of which there is one row each.
    """
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_rows"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (rank % len(weights) + 1).cast("int"))
    rows = totals.withColumn("weight", weight).withColumn("cap", F.col("source_size") * most)
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before, whole = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    level = (F.lit(share) * F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0))) / (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    capped = F.col("cap") <= F.col("level") * F.col("weight")
    rows = rows.withColumn("level", level).withColumn("full", F.min(F.when(capped, 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    last = F.min(F.when(F.col("full") == 0, F.struct(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source", "level"))).over(whole)["level"]
    target = F.when(F.col("full") == 1, F.col("cap").cast("double")).otherwise(last * F.col("weight"))
    rows = rows.withColumn("target", target)
    copies = F.when(F.col("source_size") > 0, F.floor(F.floor(F.col("target") + 0.5) / F.col("source_size"))).otherwise(0)
    return rows.withColumn("whole", copies).select("source", "source_size", "n_rows", "target", "whole", (F.floor(F.col("target") + 0.5) - F.col("whole") * F.col("source_size")).alias("budget"))


def mix(sized: DataFrame, seed: int = 0, **shares) -> DataFrame:
    """``sized`` (doc_id, source, size, mark) with ``source_size``, ``target``, ``copies`` (whole copies taken), ``part`` (words taken of one more,
    fewer than all) and ``taken``."""
    plan = durable(targets(sized, **shares).withColumn("source_no", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))))
    p = F.col("budget") / F.col("source_size")
    u = F.col("u")
    key = F.when(F.col("budget") > 0, (u / (1 - u)) / (p / (1 - p)))
    rows = sized.withColumn("u", uniform(seed)).join(plan, sized["source"].eqNullSafe(plan["source"])).drop(plan["source"]).withColumn("odds", key)
    # The bin follows u, which orders a source's documents as the odds do.
    rows = rows.withColumn("bin", F.floor(u * F.greatest(F.lit(BINS), F.ceil(F.col("n_rows") / BIN_ROWS))))
    bins = rows.where("odds is not null").groupBy("source_no", "bin").agg(F.sum("size").alias("words"))
    upto = Window.partitionBy("source_no").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = bins.withColumn("before", F.coalesce(F.sum("words").over(upto), F.lit(0)))
    rows = rows.join(bins, ["source_no", "bin"], "left")
    cut = F.coalesce((F.col("before") < F.col("budget")) & (F.col("before") + F.col("words") > F.col("budget")), F.lit(False))
    rows = rows.withColumn("cut", cut)
    shown = ["doc_id", "source", "size", "mark", "source_size", "target", "whole"]
    alike = rows.where("cut").groupBy(*shown, "source_no", "bin", "odds", "budget", "before").agg(F.count("*").alias("n"))
    in_bin = Window.partitionBy("source_no", "bin").orderBy("odds", "doc_id", "mark").rowsBetween(Window.unboundedPreceding, -1)
    left = F.col("budget") - F.col("before") - F.coalesce(F.sum(F.col("n") * F.col("size")).over(in_bin), F.lit(0))
    alike = alike.withColumn("left", left).withColumn("piece", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / PIECE))))
    each = F.explode(F.sequence(F.col("piece") * PIECE, F.least(F.col("n"), (F.col("piece") + 1) * PIECE) - 1))
    ordered = alike.repartition("source_no", "mark", "piece").withColumn("i", each)
    ordered = ordered.withColumn("extra", F.greatest(F.lit(0), F.least(F.col("size"), F.col("left") - F.col("i") * F.col("size")))).select(*shown, "extra")
    plain = rows.where("not cut").withColumn("extra", F.when(F.coalesce(F.col("before") < F.col("budget"), F.lit(False)), F.col("size")).otherwise(0)).select(*shown, "extra")
    out = plain.unionByName(ordered).withColumn("extra", F.col("extra").cast("long"))
    full = (F.col("extra") == F.col("size")) & (F.col("size") > 0)
    return out.select("doc_id", "source", "size", "mark", "source_size", "target", F.when(F.col("size") > 0, F.col("whole") + full.cast("long")).otherwise(0).alias("copies"), F.when(full, 0).otherwise(F.col("extra")).alias("part"), (F.col("whole") * F.col("size") + F.col("extra")).alias("taken"))


ORACLE = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         md5(coalesce(text, '')) AS mark, (CAST('0x' || substr(md5('0:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))), 1, 13) AS BIGINT) + 0.5) / 4503599627370496.0::DOUBLE AS u
  FROM documents),
totals AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS s, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w FROM sized GROUP BY source),
-- every level at which just the sources with a smaller limit for their weight are full; the right one is the lowest that no open source exceeds
levels AS (
  SELECT c.r, (1.5::DOUBLE * (SELECT sum(s) FROM totals) - coalesce(sum(2 * a.s) FILTER (WHERE a.s::DOUBLE / a.w < c.r), 0)) / sum(a.w) FILTER (WHERE a.s::DOUBLE / a.w >= c.r) AS t
  FROM totals a, (SELECT DISTINCT s::DOUBLE / w AS r FROM totals) c GROUP BY c.r),
level AS (SELECT DISTINCT t, r FROM levels WHERE t < 2 * r ORDER BY r LIMIT 1),
plan AS (
  SELECT source, s, w, CASE WHEN (SELECT count(*) FROM level) = 0 OR 2.0::DOUBLE * s <= (SELECT t FROM level) * w THEN 2.0::DOUBLE * s ELSE (SELECT t FROM level) * w END AS target FROM totals),
share AS (
  SELECT *, CAST(floor(target + 0.5) AS BIGINT) AS words, CASE WHEN s > 0 THEN CAST(floor(target + 0.5) AS BIGINT) // s ELSE 0 END AS whole FROM plan),
ranked AS (
  SELECT d.doc_id, d.size, p.s, p.target, p.whole, p.words - p.whole * p.s AS budget,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.u, d.doc_id, d.mark ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM sized d JOIN share p ON d.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(s AS BIGINT) AS source_size, target, CAST(whole * size + greatest(0, least(size, budget - before)) AS BIGINT) AS taken FROM ranked
"""
