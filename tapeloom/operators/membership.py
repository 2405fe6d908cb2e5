"""Point-in-time membership and listing state from validity intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MISSING_CODE = -1
MISSING_NAME = "missing"


def valid_on(day: Column, in_date: Column, out_date: Column, end_inclusive: bool) -> Column:
    ends = out_date >= day if end_inclusive else out_date > day
    return (in_date <= day) & (out_date.isNull() | ends)


def industry_on(
    facts: DataFrame, membership: DataFrame, end_inclusive: bool = False,
    fill_missing: bool = True,
) -> DataFrame:
    """Attach the latest membership valid on each row's date.

    Intervals are first folded to one row per security (its list of intervals),
    so the join is a plain 1:1 equi-join on the security, with no row growth and
    no regrouping of the fact side afterwards.
    """
    folded = membership.groupBy("entity").agg(
        F.collect_list(F.struct("in_date", "out_date", "industry_code", "industry")).alias("_spans")
    )
    hit = F.array_max(F.filter(
        "_spans",
        lambda s: valid_on(F.col("bar_date"), s["in_date"], s["out_date"], end_inclusive),
    ))
    out = facts.join(folded, "entity", "left").withColumn("_hit", hit)
    code, name = F.col("_hit.industry_code"), F.col("_hit.industry")
    if fill_missing:
        code = F.coalesce(code, F.lit(MISSING_CODE))
        name = F.coalesce(name, F.lit(MISSING_NAME))
    return (
        out.withColumn("industry_code", code).withColumn("industry", name).drop("_spans", "_hit")
    )


def listed_on(day: Column) -> Column:
    """Listed on the day: list_date inclusive, delist_date exclusive."""
    return (F.col("list_date") <= day) & (
        F.col("delist_date").isNull() | (F.col("delist_date") > day)
    )


def active_listing(facts: DataFrame, securities: DataFrame) -> DataFrame:
    """Keep rows whose security is listed on the row's date."""
    life = securities.select("entity", "list_date", "delist_date")
    return (
        facts.join(life, "entity").where(listed_on(F.col("bar_date"))).drop("list_date", "delist_date")
    )
