"""Helpers for tables of embedding vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def complete(vectors: Column, largest: float) -> Column:
    """Whether a vector is there, and all its entries are, finite and of at most ``largest`` in size."""
    return F.coalesce(F.forall(vectors, lambda c: F.coalesce(F.abs(c.cast("double")) <= largest, F.lit(False))), F.lit(False))


def of_common_length(df: DataFrame, column: str) -> tuple[DataFrame, int]:
    """The rows whose vector has the most frequent length (the longer of equally frequent ones), and that length.

    An inner product, or a mean, of vectors of several lengths has no meaning, so other rows are left
    out.  No rows, or only empty vectors: length 0.
    """
    sizes = df.groupBy(F.size(column).alias("size")).count().orderBy(F.desc("count"), F.desc("size")).limit(1).collect()
    length = sizes[0]["size"] if sizes else 0
    return df.where(F.size(column) == length), length


def scaled(vectors: Column, scale: int, offset: int = 0) -> Column:
    """floor(scale * c) + offset of each entry c, taken as double, as long."""
    return F.transform(vectors, lambda c: F.floor(c.cast("double") * F.lit(float(scale))).cast("bigint") + F.lit(offset).cast("bigint"))
