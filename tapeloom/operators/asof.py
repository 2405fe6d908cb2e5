"""As-of selection on an even grid of sample dates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def as_of_samples(df: DataFrame, first: Column, step: int, samples: int, columns: list[str]) -> DataFrame:
    """Last row of each security at or before every sample ordinal.

    Sample i sits at ordinal first + i * step.  A bar answers the first sample at
    or after it; gaps are closed by stretching each answer to the next one.
    """
    index = F.greatest(F.ceil((F.col("ord") - first) / F.lit(float(step))), F.lit(0))
    own = (
        df.withColumn("sample", index.cast("int")).where(F.col("sample") < samples)
        .groupBy("entity", "sample").agg(F.max_by(F.struct(*columns), "ord").alias("last"))
    )
    w = Window.partitionBy("entity").orderBy("sample")
    until = F.coalesce(F.lead("sample").over(w) - 1, F.lit(samples - 1))
    stretched = own.withColumn("until", until)
    return stretched.select(
        "entity", F.explode(F.sequence("sample", "until")).alias("sample"), "last.*"
    )


def sampled_span(bars: DataFrame, first: Column, step: int, samples: int, lookback: int) -> DataFrame:
    """The bars that rules of ``lookback`` bars can meet at the samples of ``as_of_samples``.

    Bars after the last sample go, and of those up to the first one all but the newest ``lookback`` of each
    security, however long its history is.
    """
    kept = bars.where(F.col("ord") <= first + step * (samples - 1))
    newest = Window.partitionBy("entity").orderBy(F.col("ord").desc()).rowsBetween(Window.unboundedPreceding, 0)
    before = F.sum((F.col("ord") <= first).cast("int")).over(newest)
    return kept.withColumn("_before", before).where(F.col("_before") <= lookback).drop("_before")
