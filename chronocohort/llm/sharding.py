"""Sharding by k-d tree partitioning.

All rows start in one node that is to become ``shards`` leaves.  Each round splits every node that still holds several leaves: along the
widest of its metadata dimensions, at the weighted quantile that gives both sides their share of the bytes, until every leaf has the target
bytes.  Quantiles are distributed: rows of all nodes are summed into bins of the split key, the bin with the quantile is cut into bins again,
until the key is exact or the bin holds less than ``slack`` of a shard.  Only these bounded tables reach the driver.

A split key is the quantised dimension followed by a hash of the row, so that rows with equal metadata, however many, split as well.
A category lies where the more frequent ones end, as a share of all rows; sizes are taken by logarithm.  A node's width along a dimension is its share of the
whole table's, so that no dimension is widest by its unit.  A null counts as its own value.  Only rows that are equal in doc_id, text and metadata are told apart by a
running number, so that copies, too, can be spread; which of them has which number makes no difference, so shards and slots follow from the rows alone,
in whatever files and order they lie.  Very long texts are hashed and leave the job at once.  An empty table gives an empty result; other columns take no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronocohort.operators.ordering import magnitude_chunk, prefix_sums, running_index
from chronocohort.session import durable

DIM_BITS, HASH_BITS = 16, 46
BINS = 2048
CHUNKS = 256
OVERHEAD = 16  # bytes a row counts besides its text


def _scaled(value: Column) -> Column:
    """A number of at least 0 on a logarithmic scale of 16 bits; null first."""
    return F.coalesce(F.least(F.lit((1 << DIM_BITS) - 1), F.floor(F.log2(F.greatest(value, F.lit(0)) + 1) * 1024).cast("long") + 1), F.lit(0))


def _placed(df: DataFrame, column: str) -> DataFrame:
    """``df`` with ``column`` replaced by the place of its value on a scale of 16 bits: the share of rows that hold a more frequent value (ties: a smaller one)."""
    counts = durable(df.groupBy(column).agg(F.count("*").alias("n")))
    upto = prefix_sums(counts, [], [F.desc("n"), F.col(column)], -magnitude_chunk(F.col("n")), {"upto": "n"})
    whole = F.broadcast(counts.agg(F.sum("n").alias("whole")))  # one row
    place = F.floor((F.col("upto") - F.col("n")) / F.col("whole") * ((1 << DIM_BITS) - 1)).cast("long")
    return df.join(upto.crossJoin(whole).select(column, place.alias("_place")), column).drop(column).withColumnRenamed("_place", column)


def rows(docs: DataFrame) -> DataFrame:
    """(doc_id, size, text_crc32, dims, tie), stored: what the tree needs, without texts."""
    size = F.coalesce(F.octet_length(F.col("text")), F.lit(0)).cast("long") + OVERHEAD
    null = F.lit("\0null")
    out = docs.select("doc_id", size.alias("size"), F.coalesce(F.crc32(F.encode(F.col("text"), "UTF-8")), F.lit(0)).cast("long").alias("text_crc32"), F.xxhash64("text").alias("digest"),
                      F.coalesce(F.col("lang").cast("string"), null).alias("lang"), F.coalesce(F.col("source").cast("string"), null).alias("source"), _scaled(F.col("n_chars")).alias("chars"), F.col("n_chars"))
    same = F.md5(F.to_json(F.struct("doc_id", "size", "text_crc32", "digest", "lang", "source", "n_chars")))
    out = durable(out.withColumn("same", same).withColumn("at", F.monotonically_increasing_id()))
    out = running_index(out, ["same"], [F.col("at")], F.shiftright("at", 33), "copy")  # a chunk for each partition that was read
    out = _placed(_placed(out, "lang"), "source")
    tie = F.pmod(F.xxhash64("same", "copy"), F.lit(1 << HASH_BITS))
    return durable(out.select("doc_id", "size", "text_crc32", F.array("lang", "source", "chars", _scaled(F.col("size"))).alias("dims"), tie.alias("tie")))


def _key(dim: Column) -> Column:
    return F.element_at("dims", dim + 1) * F.lit(1 << HASH_BITS) + F.col("tie")


def _small(df: DataFrame, rows: list[tuple], schema: str) -> DataFrame:
    """A table of at most as many rows as there are shards."""
    return F.broadcast(df.sparkSession.createDataFrame(rows, schema))


def _route(df: DataFrame, splits: dict[int, tuple[int, int]]) -> DataFrame:
    """The nodes after one round: 2v for rows of node v below the split's bound, else 2v + 1."""
    cuts = _small(df, [(v, d, bound) for v, (d, bound) in splits.items()], "node int, dim int, bound long")
    above = F.coalesce(_key(F.col("dim")) >= F.col("bound"), F.lit(False)).cast("int")
    return df.join(cuts, "node", "left").withColumn("node", F.col("node") * 2 + above).drop("dim", "bound")


def _quantiles(df: DataFrame, want: dict[int, tuple[int, int, int, int]], slack: float) -> dict[int, int]:
    """For each node, (dim, low, high, bytes) the least key bound so that about ``bytes`` lie below it."""
    done: dict[int, int] = {}
    while want:
        step = {v: -(-(hi - lo + 1) // BINS) for v, (_, lo, hi, _) in want.items()}
        cuts = _small(df, [(v, d, lo, hi, step[v]) for v, (d, lo, hi, _) in want.items()], "node int, dim int, lo long, hi long, step long")
        part = df.join(cuts, "node").select("node", "size", "lo", "hi", "step", _key(F.col("dim")).alias("k")).where("k between lo and hi")
        found: dict[int, dict[int, int]] = {}
        for r in part.groupBy("node", F.expr("int((k - lo) div step)").alias("bin")).agg(F.sum("size").alias("bytes")).collect():  # at most nodes * BINS rows
            found.setdefault(r["node"], {})[r["bin"]] = r["bytes"]
        after = {}
        for v, (d, lo, hi, left) in want.items():
            done[v] = hi + 1
            for b in sorted(found.get(v, {})):
                held = found[v][b]
                if held <= left:
                    left -= held
                    continue
                start, end = lo + b * step[v], min(hi, lo + (b + 1) * step[v] - 1)
                done[v] = start if 2 * left < held else end + 1
                if step[v] > 1 and held > slack:
                    after[v] = (d, start, end, left)
                break
        want = after
    return done


def assign(table: DataFrame, shards: int, slack_share: float = 0.0005) -> DataFrame:
    """``table`` (see ``rows``) with ``shard``, 0 to shards - 1, of about equal bytes."""
    df = table.withColumn("node", F.lit(0))
    leaves = {0: shards}
    whole = table.agg(F.sum("size")).first()[0] or 0
    root: list[int] = []
    while max(leaves.values()) > 1:
        open_ = [v for v, n in leaves.items() if n > 1]
        spread = F.struct(*[F.struct(F.min(F.element_at("dims", i + 1)).alias("lo"), F.max(F.element_at("dims", i + 1)).alias("hi")).alias(f"d{i}") for i in range(4)])
        stats = {r["node"]: r for r in df.where(F.col("node").isin(open_)).groupBy("node").agg(F.sum("size").alias("bytes"), spread.alias("s")).collect()}  # a row for each node
        root = root or [stats[0]["s"][i]["hi"] - stats[0]["s"][i]["lo"] for i in range(4) if 0 in stats]
        want = {}
        for v in open_:
            if v in stats:
                widths = [((stats[v]["s"][i]["hi"] - stats[v]["s"][i]["lo"]) / max(1, root[i]), -i) for i in range(4)]
                d = -max(widths)[1]
                lo, hi = stats[v]["s"][d]["lo"] << HASH_BITS, ((stats[v]["s"][d]["hi"] + 1) << HASH_BITS) - 1
                want[v] = (d, lo, hi, stats[v]["bytes"] * (leaves[v] // 2) // leaves[v])
        bounds = _quantiles(df, dict(want), whole / shards * slack_share)
        df = durable(_route(df, {v: (want[v][0], bounds[v]) for v in want}))
        leaves = {c: n for v, k in leaves.items() for c, n in (((2 * v, k // 2), (2 * v + 1, k - k // 2)) if k > 1 else ((2 * v, 1),))}
    numbers = _small(df, [(v, i) for i, v in enumerate(sorted(leaves))], "node int, shard int")
    return df.join(numbers, "node").drop("node")


def slots(assigned: DataFrame) -> DataFrame:
    """With ``slot``, gapless from 0 in each shard.  A shard is numbered in chunks by hash; chunk counts give the offsets."""
    chunked = durable(assigned.withColumn("chunk", F.floor(F.col("tie") / (1 << HASH_BITS) * CHUNKS).cast("int")))
    counts = chunked.groupBy("shard", "chunk").agg(F.count("*").alias("n"))
    before = counts.select("shard", "chunk", F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    place = F.row_number().over(Window.partitionBy("shard", "chunk").orderBy("tie", "doc_id")) - 1
    return chunked.withColumn("place", place).join(before, ["shard", "chunk"]).withColumn("slot", (F.col("before") + F.col("place")).cast("long")).drop("before", "place", "chunk")


def write(docs: DataFrame, sharded: DataFrame, folder: str) -> None:
    """Write the documents as one folder of Parquet files for each shard.  ``docs`` must have unique doc_ids here."""
    docs.join(sharded.select("doc_id", "shard", "slot"), "doc_id").write.partitionBy("shard").parquet(folder)


