"""Spark helpers of the text operators."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeloom.sources.staging import stage, staging_root

__all__ = ["bounded", "filter_bits", "fresh", "held_out", "map_batches", "numbered", "pick", "stage", "stage_by"]


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """The named columns under fixed names; others, whatever they are called, are left out."""
    return df.select(*[F.col(f"`{source}`").alias(name) for name, source in columns.items()])


def map_batches(df: DataFrame, f: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """``f`` on each Arrow batch of ``df``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows and (out := f(batch)) is not None:
                yield out

    return df.mapInArrow(run, schema)


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with underscores in front until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def numbered(df: DataFrame) -> tuple[DataFrame, str]:
    """``df`` written once with a key of its own for each row, whatever ids the rows have, and the key's name."""
    key = fresh(df, "row_key")
    return stage(df.withColumn(key, F.monotonically_increasing_id())), key


def filter_bits(entries: int, least: int, most: int = 28) -> int:
    """Address bits of a filter of so many entries: sixteen bits an entry, between ``least`` and ``most`` (32 MB).

    A filter that is too small for its entries lets more through, which costs time and loses nothing.
    """
    return min(most, max(least, (16 * max(entries, 1) - 1).bit_length()))


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text leaves 1 when divided by 3; a null id is never held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def bounded(df: DataFrame, rows: int, what: str) -> list:
    """The rows of a small result on the driver; more than ``rows`` is an error."""
    out = df.limit(rows + 1).collect()
    if len(out) > rows:
        raise ValueError(f"{what}: more than {rows} rows")
    return out


def stage_by(df: DataFrame, column: str, buckets: int) -> DataFrame:
    """As ``stage``, in buckets of ``column``, so that grouping by it needs no shuffle."""
    spark, name = df.sparkSession, f"staged_{uuid.uuid4().hex}"
    path = f"{staging_root(spark)}/tapeloom-stage/{name}"
    writer = df.write.bucketBy(buckets, column).option("path", path).option("compression", "zstd")
    writer.format("parquet").saveAsTable(name)
    return spark.table(name)
