"""Streaks, runs, dwell times and other islands over an ordered series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def streaks(df: DataFrame, keys: list[str], ordinal: str = "ord", out: str = "streak") -> DataFrame:
    """Length so far of the run of consecutive ordinals ending at each row."""
    w = Window.partitionBy(*keys).orderBy(ordinal)
    df = df.withColumn("_island", F.col(ordinal) - F.row_number().over(w))
    inside = Window.partitionBy(*keys, "_island").orderBy(ordinal)
    return df.withColumn(out, F.row_number().over(inside)).drop("_island")


def sign_runs(df: DataFrame, keys: list[str], order: str, change: str) -> DataFrame:
    """Runs of equal non-zero sign: share of days in runs of 3 or more, longest run.

    A zero (or missing) change ends a run and belongs to none.
    """
    w = Window.partitionBy(*keys).orderBy(order)
    sign = F.signum(F.coalesce(F.col(change).cast("double"), F.lit(0.0)))
    df = df.withColumn("_s", sign)
    starts = (F.col("_s") != F.lag("_s", 1, 0.0).over(w)).cast("int")
    df = df.withColumn("_run", F.sum(starts).over(w))
    runs = df.where(F.col("_s") != 0).groupBy(*keys, "_run").agg(F.count(F.lit(1)).alias("n"))
    found = runs.groupBy(*keys).agg(
        F.sum(F.when(F.col("n") >= 3, F.col("n")).otherwise(0)).alias("_long"),
        F.sum("n").alias("_days"), F.max("n").alias("max_run"),
    )
    every = df.select(*keys).distinct().join(found, keys, "left")
    return every.select(
        *keys, F.coalesce(F.col("_long") / F.col("_days"), F.lit(0.0)).alias("persistent_share"),
        F.coalesce("max_run", F.lit(0)).alias("max_run"),
    )


def dwell_runs(df: DataFrame, keys: list[str], state: str, order: str) -> DataFrame:
    """Run lengths of a state over the observed rows of a key (gaps pause, they do not reset)."""
    w = Window.partitionBy(*keys).orderBy(order)
    same = Window.partitionBy(*keys, state).orderBy(order)
    df = df.withColumn("_seq", F.row_number().over(w))
    df = df.withColumn("_island", F.col("_seq") - F.row_number().over(same))
    return df.groupBy(*keys, state, "_island").agg(F.count(F.lit(1)).alias("duration")).drop("_island")


def weak_duration(active: Column, trigger: Column, keys: list[str], order: str, df: DataFrame) -> DataFrame:
    """Rows since the first trigger inside the current active stretch (0 when not running)."""
    w = Window.partitionBy(*keys).orderBy(order)
    df = df.withColumn("_active", active).withColumn("_trigger", trigger)
    df = df.withColumn("_pos", F.row_number().over(w))
    df = df.withColumn("_island", F.sum((~F.col("_active")).cast("int")).over(w))
    inside = Window.partitionBy(*keys, "_island").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    start = F.min(F.when(F.col("_active") & F.col("_trigger"), F.col("_pos"))).over(inside)
    lasted = F.when(F.col("_active") & start.isNotNull(), F.col("_pos") - start + 1).otherwise(0)
    return df.withColumn("weak_duration", lasted).drop("_active", "_trigger", "_pos", "_island")
