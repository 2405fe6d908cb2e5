"""Industry health: mainline confirmation, weakening and cooling of a daily panel.

Input: one row per (bar_date, industry_code) with b_count, b_breadth and
eligible_count.  A date holds one row per industry and an industry one row per
date, so both window partitions are bounded by the catalog and the calendar.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.functions.scalars import strict
from tapeloom.operators.runs import weak_duration

EPS = 1e-9


def _series() -> Window:
    return Window.partitionBy("industry_code").orderBy("bar_date")


def _mean(name: str, n: int, back: int = 0) -> Column:
    return strict(F.avg(name), name, _series().rowsBetween(1 - n - back, -back), n)


def _yes(cond: Column) -> Column:
    return F.coalesce(cond, F.lit(False))


def rank_share(value: str, keys: list[str]) -> Column:
    """Average-tie rank share inside a small group."""
    w = Window.partitionBy(*keys).orderBy(value)
    ties = F.count(F.lit(1)).over(Window.partitionBy(*keys, value))
    return (F.rank().over(w) + (ties - 1) / F.lit(2.0)) / F.count(F.lit(1)).over(Window.partitionBy(*keys))


def health_fields(panel: DataFrame) -> DataFrame:
    """Rank share, mainline flag, raw drop, smoothed weakening and formal cooling.

    Differences of means are compared with a 1e-9 slack so that equal means do
    not count as a fall through rounding.
    """
    df = panel.withColumn("b_rank_pct", rank_share("b_breadth", ["bar_date"]))
    w = _series()
    df = df.withColumns({
        "_pr": F.lag("b_rank_pct").over(w), "_pb": F.lag("b_breadth").over(w), "_pc": F.lag("b_count").over(w),
    })
    w20, w5 = w.rowsBetween(-19, 0), w.rowsBetween(-4, 0)
    high = F.sum((F.col("_pr") >= 0.75).cast("int"))
    middle = F.expr("percentile(_pr, 0.5)")
    mainline = (
        (strict(high, "_pr", w20, 20) >= 12)
        & (strict(middle, "_pr", w20, 20) >= 0.75)
        & (strict(middle, "_pr", w5, 5) >= 0.75)
        & (strict(F.avg("_pb"), "_pb", w20, 20) > 0)
    )
    fields = {
        "mainline": _yes(mainline),
        "raw_drop": _yes((F.col("b_count") <= F.col("_pc") - 1) & (F.col("b_breadth") < F.col("_pb"))),
        "delta_rank_formal": _mean("b_rank_pct", 5) - _mean("b_rank_pct", 15, 5),
        "delta_breadth_formal": _mean("b_breadth", 5) - _mean("b_breadth", 15, 5),
    }
    for n in (3, 5):
        fields[f"change_{n}d_count"] = _mean("b_count", n) - _mean("b_count", n, n)
        fields[f"_breadth_{n}"] = _mean("b_breadth", n) - _mean("b_breadth", n, n)
        fields[f"delta_rank_{n}"] = _mean("b_rank_pct", n) - _mean("b_rank_pct", n, n)
    df = df.withColumns(fields)

    def smooth(n: int) -> Column:
        return _yes(
            (F.col(f"change_{n}d_count") < -EPS) & (F.col(f"_breadth_{n}") < -EPS) & (F.col(f"delta_rank_{n}") <= -0.10 + EPS)
        )

    cooling = _yes(
        (F.col("delta_rank_formal") <= -0.15 + EPS) & (F.col("delta_breadth_formal") < -EPS) & F.col("mainline")
    )
    df = df.withColumns({"smooth3": smooth(3), "smooth5": smooth(5), "cooling": cooling})
    return df.drop("_pr", "_pb", "_pc", "_breadth_3", "_breadth_5")


def health_snapshot(fields: DataFrame) -> DataFrame:
    """Pool share and rank, status and weak duration per date and industry."""
    active = F.col("smooth3") | F.col("smooth5") | F.col("cooling")
    df = weak_duration(active, F.col("smooth3"), ["industry_code"], "bar_date", fields)
    day = Window.partitionBy("bar_date")
    order = day.orderBy(F.col("b_count").desc(), F.col("b_breadth").desc(), "industry_code")
    status = F.when(F.col("cooling"), "cooling").when(F.col("smooth3") | F.col("smooth5"), "weakening").otherwise("stable")
    return df.withColumns({
        "pool_total": F.sum("b_count").over(day),
        "pool_share": F.coalesce(F.try_divide(F.col("b_count"), F.sum("b_count").over(day)), F.lit(0.0)),
        "pool_rank": F.row_number().over(order),
        "status": status,
    }).withColumn("marked", (F.col("pool_rank") == 1) | ((F.col("status") != "stable") & (F.col("weak_duration") >= 3)))
