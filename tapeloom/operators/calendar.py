"""Trading calendar: the distinct dates present in the data, with ordinals.

A calendar has at most one row per day, so it stays small whatever the size of
the bar table; that bound is what allows the explicit broadcast below.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def trading_calendar(bars: DataFrame) -> DataFrame:
    """(bar_date, ord) with ord counted from 0."""
    dates = bars.select("bar_date").distinct()
    return dates.withColumn("ord", F.row_number().over(Window.orderBy("bar_date")) - 1)


def with_ordinal(df: DataFrame, cal: DataFrame) -> DataFrame:
    """Attach the calendar ordinal (the calendar is bounded by days, see above)."""
    return df.join(F.broadcast(cal), "bar_date")


def last_dates(cal: DataFrame, n: int, until: Column | None = None) -> DataFrame:
    """The last n dates up to `until`, ascending, numbered 1..n."""
    picked = cal if until is None else cal.where(F.col("bar_date") <= until)
    picked = picked.orderBy(F.col("bar_date").desc()).limit(n)
    return picked.withColumn("seq", F.row_number().over(Window.orderBy("bar_date")))


def nth_newest(cal: DataFrame, back: int) -> Column:
    """The date `back` steps before the newest one, as a scalar subquery."""
    newest = cal.orderBy(F.col("bar_date").desc()).limit(back + 1)
    return newest.agg(F.min("bar_date")).scalar()


def rotation_samples(cal: DataFrame, lookback: int = 120, step: int = 5) -> DataFrame:
    """Every `step`-th date of the last `lookback` dates, first one at position `step`."""
    window = last_dates(cal, lookback)
    picked = window.where((F.col("seq") - 1) % step == step - 1)
    return picked.select(
        "bar_date", "ord", (F.row_number().over(Window.orderBy("bar_date")) - 1).alias("sample")
    )


def timeline_dates(cal: DataFrame, step: int = 5) -> DataFrame:
    """Dates whose ordinal is a multiple of `step`, plus the newest date."""
    newest = cal.agg(F.max("ord")).scalar()
    return cal.where((F.col("ord") % step == 0) | (F.col("ord") == newest))


def period_ends(cal: DataFrame) -> DataFrame:
    """Last trading date per ISO week and per month: (frequency, period, bar_date)."""
    week = F.concat_ws(
        "-", F.extract(F.lit("YEAROFWEEK"), F.col("bar_date")).cast("string"),
        F.lpad(F.weekofyear("bar_date").cast("string"), 2, "0"),
    )
    month = F.date_format("bar_date", "yyyyMM")
    tagged = cal.select(
        "bar_date",
        F.explode(F.array(
            F.struct(F.lit("weekly").alias("frequency"), week.alias("period")),
            F.struct(F.lit("monthly").alias("frequency"), month.alias("period")),
        )).alias("k"),
    )
    return tagged.groupBy("k.frequency", "k.period").agg(F.max("bar_date").alias("bar_date"))
