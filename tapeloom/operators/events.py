"""Limit-up / limit-down and suspension events, and their counts inside windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.operators.bars import by_entity
from tapeloom.operators.calendar import with_ordinal


def limit_flags(bars: DataFrame, *keep: str | Column) -> DataFrame:
    """Per bar: touched the upper or lower limit (previous close +-10 %, with tolerance); ``keep`` names further columns."""
    prev = F.lag("close").over(by_entity())
    df = bars.withColumn("_prev", prev)
    up, down = F.col("_prev") * 1.1, F.col("_prev") * 0.9

    def tolerance(limit):
        return F.greatest(F.abs(limit) * F.lit(1e-5), F.lit(0.001))

    return df.select(
        "entity", "bar_date",
        F.coalesce(F.col("close") >= up - tolerance(up), F.lit(False)).alias("up"),
        F.coalesce(F.col("close") <= down + tolerance(down), F.lit(False)).alias("down"),
        (F.abs(F.col("close") / F.col("_prev") - 1) * 100).alias("abs_pct"), *keep,
    )


def suspended_weeks(bars: DataFrame, cal: DataFrame) -> DataFrame:
    """Per bar: calendar dates without a bar since the previous bar of the security."""
    dated = with_ordinal(bars.select("entity", "bar_date"), cal)
    gap = F.col("ord") - F.lag("ord").over(by_entity()) - 1
    return dated.select("entity", "bar_date", F.coalesce(gap, F.lit(0)).alias("gap"))


def bar_events(bars: DataFrame, cal: DataFrame) -> DataFrame:
    """``limit_flags`` and ``suspended_weeks`` of each bar, from one pass over a security."""
    gap = F.col("ord") - F.lag("ord").over(by_entity()) - 1
    dated = with_ordinal(bars.select("entity", "bar_date", "close"), cal).withColumn("_gap", F.coalesce(gap, F.lit(0)))
    return limit_flags(dated, F.col("_gap").alias("gap"))


def events_of_few(windows: DataFrame, per_bar: DataFrame) -> DataFrame:
    """``window_events`` of windows of which a security has few, such as its newest ones.

    They meet the security's bars where those lie, so neither side is shuffled again; the pairs are its windows
    times its bars.
    """
    bar = per_bar.select(F.col("entity").alias("_e"), F.col("bar_date").alias("_day"), "up", "down", "abs_pct", "gap")
    inside = windows.join(bar, (F.col("entity") == F.col("_e")) & F.col("_day").between(F.col("start_date"), F.col("end_date")))
    return inside.groupBy(*windows.columns).agg(
        F.count_if("up").alias("up_count"), F.count_if("down").alias("down_count"),
        F.coalesce(F.sum(F.when(F.col("_day") > F.col("start_date"), F.col("gap"))), F.lit(0)).alias("suspension_count"),
        F.max("abs_pct").alias("max_abs_pct"),
    )


def window_events(windows: DataFrame, limits: DataFrame, gaps: DataFrame, longest: int) -> DataFrame:
    """Counts of events, and the largest move, between start_date and end_date of each window of at most ``longest`` bars.

    Counting is a difference of running totals at the two window ends.  The largest move is the greater of
    two blocks of the greatest power of two that fits, one from each end, so every bar keeps the maxima of
    the blocks that end with it, and no window meets the bars inside it.
    """
    per_bar = limits.join(gaps, ["entity", "bar_date"])
    w = by_entity().rowsBetween(Window.unboundedPreceding, 0)
    levels = range(max(longest, 1).bit_length())
    totals = per_bar.select(
        "entity", "bar_date", F.row_number().over(by_entity()).alias("at"),
        F.sum(F.col("up").cast("int")).over(w).alias("u"), F.sum(F.col("down").cast("int")).over(w).alias("d"),
        F.sum("gap").over(w).alias("g"), F.col("up").cast("int").alias("u0"), F.col("down").cast("int").alias("d0"),
        F.array(*[F.max("abs_pct").over(by_entity().rowsBetween(1 - 2**j, 0)) for j in levels]).alias("most"),
    )
    first = totals.select(
        "entity", F.col("bar_date").alias("start_date"), (F.col("u") - F.col("u0")).alias("u1"),
        (F.col("d") - F.col("d0")).alias("d1"), F.col("g").alias("g1"), F.col("at").alias("at1"),
    )
    last = totals.select("entity", F.col("bar_date").alias("end_date"), "u", "d", "g", "at", F.col("most").alias("late"))
    counted = windows.join(first, ["entity", "start_date"]).join(last, ["entity", "end_date"])
    bars = F.col("at") - F.col("at1") + 1
    level = F.length(F.bin(bars)) - 1
    counted = counted.withColumn("_level", level).withColumn("_mid", F.col("at1") + F.call_function("shiftleft", F.lit(1), F.col("_level")) - 1)
    middle = totals.select("entity", F.col("at").alias("_mid"), F.col("most").alias("early"))
    both = counted.join(middle, ["entity", "_mid"])
    return both.withColumns({
        "up_count": F.col("u") - F.col("u1"), "down_count": F.col("d") - F.col("d1"), "suspension_count": F.col("g") - F.col("g1"),
        "max_abs_pct": F.greatest(F.get("early", F.col("_level")), F.get("late", F.col("_level"))),
    }).drop("u", "d", "g", "u1", "d1", "g1", "at", "at1", "early", "late", "_level", "_mid")
