"""Ordered computations that stay exact and distributed when one key, or one order, holds most rows.

A plain ``row_number`` or ``percentile`` sends a whole key to one task.  Here a key is cut into
chunks that are monotone in the order: chunk totals are pre-aggregated before the shuffle, their running
sum is small, and only (key, chunk) rows are ever ordered together.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronocohort.session import durable


#: Rows of one key that one task may order; larger keys are cut into chunks.
WHOLE = 1 << 16


def large_keys(df: DataFrame, keys: Sequence[str], whole: int = WHOLE) -> DataFrame:
    """The keys with more than ``whole`` rows: there are at most rows / ``whole`` of them."""
    return df.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > whole).select(*keys)


def _with_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return reduce(lambda d, k: d.where(F.col(k).isNotNull()), keys, df)


def _marked(df: DataFrame, large: DataFrame | None) -> DataFrame:
    """``df`` with ``_large``: whether its key is among the few ``large`` ones (see ``large_keys``), or true without them."""
    if large is None:
        return df.withColumn("_large", F.lit(True))
    return df.join(F.broadcast(large.withColumn("_large", F.lit(True))), large.columns, "left")


def running_index(df: DataFrame, keys: Sequence[str], order: Sequence[Column], chunk: Column, name: str, large: DataFrame | None = None) -> DataFrame:
    """Exact 1-based position of each row within its key.

    ``chunk`` must not be NULL and must not decrease along ``order``.  Keys are cut into their chunks: only rows of one
    (key, chunk) are ordered together, and the running sum of chunk totals gives each chunk its offset.  With ``large`` (``large_keys`` of some of
    ``keys``) only keys found there are cut; any other is ordered in one piece, so its rows are shuffled at most once, not at all if they lie by key already, and nothing is counted ahead.
    """
    known = _with_keys(df, keys)
    if large is not None:
        few = F.broadcast(large)
        whole = Window.partitionBy(*keys).orderBy(*order)
        rest = known.join(few, large.columns, "left_anti").select(*df.columns, F.row_number().over(whole).cast("long").alias(name))
        return rest.unionByName(running_index(known.join(few, large.columns, "left_semi"), keys, order, chunk, name))
    marked = known.withColumn("_chunk", chunk)
    totals = marked.groupBy(*keys, "_chunk").agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*keys, "_chunk", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    within = Window.partitionBy(*keys, "_chunk").orderBy(*order)
    return (marked.join(offsets, [*keys, "_chunk"]).withColumn(name, F.col("_before") + F.row_number().over(within))
            .select(*df.columns, name))


def prefix_sums(df: DataFrame, keys: Sequence[str], order: Sequence[Column], chunk: Column,
                sums: Mapping[str, str]) -> DataFrame:
    """Inclusive running sums along ``order`` within ``keys``; ``sums`` maps output name -> value column.

    Every key is cut into chunks, so ``keys`` may be empty or few.
    """
    work = df.withColumn("_chunk", chunk).withColumn("_k", F.lit(0))
    by = ["_k", *keys]
    totals = work.groupBy(*by, "_chunk").agg(*[F.sum(v).alias(f"_t_{n}") for n, v in sums.items()])
    earlier = Window.partitionBy(*by).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*by, "_chunk", *[F.coalesce(F.sum(f"_t_{n}").over(earlier), F.lit(0)).alias(f"_b_{n}")
                                            for n in sums])
    within = Window.partitionBy(*by, "_chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    joined = work.join(offsets, [*by, "_chunk"])
    for n, v in sums.items():
        joined = joined.withColumn(n, F.col(f"_b_{n}") + F.sum(v).over(within))
    return joined.drop("_k", "_chunk", *[f"_b_{n}" for n in sums])


_RUNNING = {"sum": F.sum, "max": F.max, "last": lambda v: F.last(v, ignorenulls=True)}


def _total(how: str, value: str, along: Sequence[str]) -> Column:
    """A chunk's contribution to what comes after it."""
    if how != "last":
        return _RUNNING[how](value)
    return F.max_by(value, F.when(F.col(value).isNotNull(), F.struct(*along)))


def _joined(how: str, *parts: Column) -> Column:
    """One fold out of consecutive parts, the earliest first; a part may be NULL."""
    if how == "sum":
        return reduce(lambda a, b: F.coalesce(a + b, a, b), parts)
    return F.greatest(*parts) if how == "max" else F.coalesce(*reversed(parts))


def carried(df: DataFrame, keys: Sequence[str], levels: tuple[Column, Column], order: Sequence[str], folds: Mapping[str, tuple[str, str]], large: DataFrame | None = None) -> DataFrame:
    """Inclusive running ``folds`` (output name -> (sum, max or last non-NULL, value column)) along ``order`` within ``keys``.

    ``levels`` are a fine and a coarse chunk, neither NULL nor decreasing along the order, the fine one inside the coarse one.  Rows are ordered only
    within a fine chunk; totals of fine chunks are ordered only within a coarse one; the totals of a key's coarse chunks are one array.  So
    no task orders all rows of a key, and none holds all its fine chunks.  The number of coarse chunks of a key must be bounded by what they mean (years).
    With ``large`` (``large_keys`` of some of ``keys``) only keys found there are cut, any other is ordered in one piece.
    """
    work = _marked(_with_keys(df, keys), large)
    work = work.withColumns({"_c0": F.when(F.col("_large"), levels[0]), "_c1": F.when(F.col("_large"), levels[1])})
    fine = work.where("_large").groupBy(*keys, "_c0", "_c1").agg(*[_total(how, v, order).alias(f"_t_{n}") for n, (how, v) in folds.items()])
    earlier = Window.partitionBy(*keys, "_c1").orderBy("_c0").rowsBetween(Window.unboundedPreceding, -1)
    coarse = fine.groupBy(*keys, "_c1").agg(*[_total(how, f"_t_{n}", ["_c0"]).alias(f"_t_{n}") for n, (how, _) in folds.items()])
    whole = coarse.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_c1", *[f"_t_{n}" for n in folds]))).alias("_all"))
    offsets = fine.withColumns({f"_e_{n}": _RUNNING[how](f"_t_{n}").over(earlier) for n, (how, _) in folds.items()}).join(whole, list(keys))
    offsets = offsets.withColumn("_past", F.filter("_all", lambda x: x["_c1"] < F.col("_c1")))
    before = []
    for n, (how, _) in folds.items():
        past = F.filter(F.transform("_past", lambda x: x[f"_t_{n}"]), lambda x: x.isNotNull())  # noqa: B023
        if how == "sum":
            past = F.when(F.size(past) > 0, F.aggregate(past, past[0] - past[0], lambda a, x: a + x))
        else:
            past = F.array_max(past) if how == "max" else F.get(past, F.size(past) - 1)
        before.append(_joined(how, past, F.col(f"_e_{n}")).alias(f"_b_{n}"))
    within = Window.partitionBy(*keys, "_c0").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = work.join(offsets.select(*keys, "_c0", *before), [*keys, "_c0"], "inner" if large is None else "left")
    out = out.withColumns({n: _joined(how, F.col(f"_b_{n}"), _RUNNING[how](v).over(within)) for n, (how, v) in folds.items()})
    return out.select(*df.columns, *folds)


def as_of(left: DataFrame, right: DataFrame, keys: Sequence[str], left_at: str, right_at: str, folds: Mapping[str, tuple[str, Column]], large: DataFrame | None = None) -> DataFrame:
    """``left`` with ``folds`` over all rows of ``right`` whose ``right_at`` lies strictly before ``left_at``.

    Folds are sum, max, or the last value; of values with one time the largest counts as the last.  Rows of both sides are put in one order and the rows of ``left``
    take what has been carried to them, so each side is shuffled once.  Days are the fine chunks and years the coarse ones, and the last mark of each
    is carried into the next (see ``carried``).  Rows of one time are merged first where a key is cut: in all keys, or with ``large`` only in those.
    """
    merge = {"sum": F.sum, "max": F.max, "last": F.max}
    values = {f"_v_{n}": v for n, (_, v) in folds.items()}
    last = [f"_v_{n}" for n, (how, _) in folds.items() if how == "last"]
    marks = _with_keys(right, [*keys, right_at])
    plain = None
    if large is not None and len(last) < 2:
        plain = marks.join(F.broadcast(large), large.columns, "left_anti").select(*keys, F.col(right_at).alias("_at"), *[v.alias(n) for n, v in values.items()])
        marks = marks.join(F.broadcast(large), large.columns, "left_semi")
    marks = marks.groupBy(*keys, F.col(right_at).alias("_at")).agg(*[merge[how](v).alias(f"_v_{n}") for n, (how, v) in folds.items()])
    marks = (marks if plain is None else plain.unionByName(marks)).withColumn("_kind", F.lit(1))
    rest = [c for c in left.columns if c not in (*keys, left_at)]
    asked = left.select(*keys, F.col(left_at).alias("_at"), F.struct(F.lit(0).alias("_"), *rest).alias("_row"), F.lit(0).alias("_kind"))
    both = marks.unionByName(_with_keys(asked, [*keys, "_at"]), allowMissingColumns=True)
    found = carried(both, keys, (F.to_date("_at"), F.year("_at")), ["_at", "_kind", *last], {n: (how, f"_v_{n}") for n, (how, _) in folds.items()}, large).where("_kind = 0")
    unknown = asked.where(reduce(lambda a, b: a | b, [F.col(c).isNull() for c in (*keys, "_at")])).select(
        *keys, "_at", "_row", *[F.lit(None).cast(both.schema[f"_v_{n}"].dataType if how != "sum" else found.schema[n].dataType).alias(n) for n, (how, _) in folds.items()])
    out = found.select(*keys, "_at", "_row", *folds).unionByName(unknown)
    return out.select(*[F.col(c) if c in keys else F.col("_at").alias(c) if c == left_at else F.col(f"_row.{c}").alias(c) for c in left.columns], *folds)


def dense_ranks(distinct: DataFrame, column: str, name: str) -> DataFrame:
    """0-based rank of each value of ``column``, whose values differ, over all of them.

    Ranges of values at sampled bounds are written to the shared folder, each with the number of its partition; the counts of all ranges, one number for each,
    give the offsets.  No task orders more than a range, however alike the values begin.
    """
    spark = distinct.sparkSession
    cut = durable(distinct.select(column).repartitionByRange(column).withColumn("_range", F.spark_partition_id()))
    at, offsets = 0, []
    for r in cut.groupBy("_range").count().orderBy("_range").collect():
        offsets.append((r["_range"], at))
        at += r["count"]
    before = F.broadcast(spark.createDataFrame(offsets, "_range int, _before long"))  # one row for each partition
    within = Window.partitionBy("_range").orderBy(column)
    return cut.join(before, "_range").select(column, (F.col("_before") + F.row_number().over(within) - 1).alias(name))


def magnitude_chunk(value: Column, digits: int = 4) -> Column:
    """Order-preserving chunk of a number: its decade and leading ``digits`` digits, as one long; infinities have their own.

    Needs no pass over the data, and gives at most 9 * 10^(digits-1) chunks per decade and sign.
    """
    size = F.abs(value.cast("double"))
    endless = size == float("inf")
    finite = F.when(endless | (size == 0), F.lit(1.0)).otherwise(size)
    decade = F.floor(F.log10(finite))
    lead = F.floor(finite / F.pow(F.lit(10.0), decade - (digits - 1)))
    code = F.when(endless, F.lit(1000 * 10 ** (digits + 1)).cast("long")).otherwise(((decade + 400) * F.lit(10 ** (digits + 1)) + lead).cast("long"))
    return F.when(size == 0, F.lit(0).cast("long")).when(value < 0, -code).otherwise(code)


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str, probabilities: Mapping[str, float]) -> DataFrame:
    """Exact quantiles per key with linear interpolation, one column per entry of ``probabilities``.

    Equal values are merged before the shuffle; the chunk that holds each wanted rank is found from
    chunk totals, and only those chunks are ordered.
    """
    v = F.col(value).cast("double")
    counts = (df.where(v.isNotNull() & ~F.isnan(v)).groupBy(*keys, v.alias("_v")).agg(F.count("*").alias("_c"))
              .withColumn("_chunk", magnitude_chunk(F.col("_v"))))
    along = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*keys)
    totals = (counts.groupBy(*keys, "_chunk").agg(F.sum("_c").alias("_t"))
              .withColumn("_upto", F.sum("_t").over(along)).withColumn("_n", F.sum("_t").over(whole)))
    ranks = []
    for name, p in probabilities.items():
        at = (F.col("_n") - 1) * F.lit(float(p))
        for side, rank in (("lo", F.floor(at)), ("hi", F.ceil(at))):
            ranks.append(F.struct(F.lit(name).alias("q"), F.lit(side).alias("side"), rank.cast("long").alias("rank"),
                                  (at - F.floor(at)).alias("frac")))
    wanted = (totals.withColumn("_w", F.explode(F.array(*ranks))).select(*keys, "_chunk", "_upto", "_t", "_w.*")
              .where((F.col("rank") < F.col("_upto")) & (F.col("rank") >= F.col("_upto") - F.col("_t"))))
    inside = Window.partitionBy(*keys, "_chunk", "q", "side").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    found = (counts.join(wanted, [*keys, "_chunk"])
             .withColumn("_cum", F.col("_upto") - F.col("_t") + F.sum("_c").over(inside))
             .where((F.col("rank") < F.col("_cum")) & (F.col("rank") >= F.col("_cum") - F.col("_c"))))

    def pick(name: str, side: str) -> Column:
        return F.max(F.when((F.col("q") == name) & (F.col("side") == side), F.col("_v")))

    def share(name: str) -> Column:
        return F.max(F.when(F.col("q") == name, F.col("frac")))

    return found.groupBy(*keys).agg(*[
        F.when(pick(n, "lo") == pick(n, "hi"), pick(n, "lo")).otherwise(pick(n, "lo") + (pick(n, "hi") - pick(n, "lo")) * share(n)).alias(n)
        for n in probabilities])


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
