"""Helpers shared by the operators: batch limits for Arrow, column names that cannot clash, packed rows."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that separates words: blank and U+0009 to U+000D.  ``bytes.split()`` cuts at exactly these.
SPACES = r"\x20\x09-\x0D"
WORD = rf"[^{SPACES}]+"

#: Arrow batches that go to Python hold at most so many rows and about so many bytes.
BATCH_ROWS = 1000
BATCH_BYTES = 8 << 20


def small_batches(spark: SparkSession) -> None:
    """Keep what one Python worker holds at a time small; long texts arrive a few at a time."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names like those given that no column of ``df`` has, whatever the case of its letters."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def text_of(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def raw_texts(batch: pa.Array) -> Iterator[bytes]:
    """UTF-8 of each text, one at a time; null counts as empty."""
    for x in batch.cast(pa.large_binary()):
        yield x.as_py() or b""


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def batches(rows: Iterable[tuple], schema: pa.Schema, size: int = BATCH_ROWS) -> Iterator[pa.RecordBatch]:
    """Cut a stream of row tuples into record batches."""
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield _batch(held, schema)
            held = []
    if held:
        yield _batch(held, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
