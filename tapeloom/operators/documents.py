"""Nested breadth documents, assembled bottom-up from pieces that share their keys.

Industries with one or two members are small: they stand for themselves in details and together as the block
``other``, so every piece (counts, flows, lists, series) is tagged with its blocks first and the same
aggregates then build single industries and ``other`` alike.  Lists inside a document are bounded by the list
size, the number of industries and the days of a series.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OTHER = "other"
_CHANGE = ("lag", "comparison_date", "new_count", "retained_count", "exit_count", "net_change")


def small(top_count: Column) -> Column:
    return top_count.isin(1, 2)


def _rates(df: DataFrame, k: int) -> DataFrame:
    return df.withColumns({
        "selection_rate": F.coalesce(F.try_divide("top_count", "eligible"), F.lit(0.0)), "top_share": F.col("top_count") / float(k),
    })


def _flows(blocks: DataFrame, keys: list[str]) -> DataFrame:
    """Counts of each block and lag: flows add up over the industries of ``other``."""
    flows = {c: F.sum(c).alias(c) for c in ("new_count", "retained_count", "exit_count")}
    return blocks.groupBy(*keys, "lag").agg(
        *flows.values(), F.max("comparison_date").alias("comparison_date"), F.sum(F.col("new_count") - F.col("exit_count")).alias("net_change"),
        F.sum("eligible").alias("eligible"), F.sum("top_count").alias("top_count"), F.min("industry").alias("industry"),
        F.array_sort(F.collect_list("industry_code")).alias("codes"),
    )


def snapshot_blocks(industry: DataFrame, k: int) -> DataFrame:
    """(template_id, ord, bar_date, block): counts, rates, components and changes by lag of each shown block.

    ``industry`` has a row for each template, date, lag and industry.
    """
    shown = industry.where(F.col("top_count") > 0)
    code = F.col("industry_code").cast("string")
    tagged = shown.withColumn("block", F.when(small(F.col("top_count")), OTHER).otherwise(code))
    keys = ["template_id", "ord", "bar_date", "block"]
    change = F.struct(*_CHANGE)
    is_other = F.col("block") == OTHER
    per = _flows(tagged, keys).groupBy(*keys).agg(
        F.max("eligible").alias("eligible"), F.max("top_count").alias("top_count"), F.array_sort(F.collect_list(change)).alias("changes"),
        F.when(is_other, OTHER).otherwise(F.min("industry")).alias("name"),
        F.when(is_other, F.first("codes")).otherwise(F.array().cast("array<bigint>")).alias("components"),
    )
    return _rates(per, k)


def timelines(blocks: DataFrame) -> DataFrame:
    """template_id, as_of, start_date, layout_order and snapshots: blocks of all dates in one order.

    The order is by all that a block counted over the dates, then by name and code.
    """
    totals = blocks.groupBy("template_id", "block").agg(F.sum("top_count").alias("total"), F.min("name").alias("name"))
    order = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("total")).alias("less"), "name", "block"))), lambda b: b["block"])
    layout = totals.groupBy("template_id").agg(order.alias("layout_order"))
    row = F.struct(
        F.array_position("layout_order", F.col("block")).alias("position"), "block", "name", "eligible", "top_count", "selection_rate",
        "top_share", "components", "changes",
    )
    days = blocks.join(layout, "template_id").groupBy("template_id", "bar_date").agg(F.array_sort(F.collect_list(row)).alias("blocks"))
    # without the position, which is that of the block in layout_order
    plain = F.transform("blocks", lambda b: b.dropFields("position"))
    docs = days.withColumn("blocks", plain).groupBy("template_id").agg(
        F.array_sort(F.collect_list(F.struct("bar_date", "blocks")), _by_date).alias("snapshots"),
        F.min("bar_date").alias("start_date"), F.max("bar_date").alias("as_of"),
    )
    return docs.join(layout, "template_id")


def _by_date(a: Column, b: Column) -> Column:
    return F.datediff(a["bar_date"], b["bar_date"])


def details(now: DataFrame, states: DataFrame, series: DataFrame, days: Column, k: int, default_lag: int) -> DataFrame:
    """template_id, industries and other (null without small industries) of one date.

    ``now``     a row for each template, lag and industry of the date
    ``states``  members of the lists with cur and prior (industry_code, rank) and their state, for each lag
    ``series``  counts of each industry and date;  ``days`` the dates of a series, as an array
    """
    base = now.where(F.col("lag") == default_lag)
    code = F.col("industry_code").cast("string")
    homes = base.select(
        "template_id", "industry_code",
        F.explode(F.when(small(F.col("top_count")), F.array(code, F.lit(OTHER))).otherwise(F.array(code))).alias("block"),
    )
    keys = ["template_id", "block"]
    flows = _flows(now.join(homes, ["template_id", "industry_code"]), keys)

    side = F.coalesce("cur", "prior")
    listed = states.withColumn("industry_code", side["industry_code"]).join(homes, ["template_id", "industry_code"])
    stock = F.struct(side["rank"].alias("rank"), "entity", "state")
    lists = listed.groupBy(*keys, "lag").agg(
        F.array_sort(F.collect_list(stock)).alias("stocks"),
        F.array_sort(F.collect_list(F.when(F.col("cur").isNotNull(), F.struct(F.col("cur.rank").alias("rank"), "entity")))).alias("current"),
    )
    no_stock = F.array().cast("array<struct<rank:int,entity:bigint,state:string>>")
    both = flows.join(lists, [*keys, "lag"], "left").withColumn("stocks", F.coalesce("stocks", no_stock))
    own = F.col("lag") == default_lag
    change = F.struct(*_CHANGE, "stocks")
    blocks = both.groupBy(*keys).agg(
        F.array_sort(F.collect_list(change), lambda a, b: a["lag"] - b["lag"]).alias("changes"),
        F.max(F.when(own, F.col("eligible"))).alias("eligible"), F.max(F.when(own, F.col("top_count"))).alias("top_count"),
        F.min("industry").alias("industry"), F.max(F.when(own, F.col("current"))).alias("current"),
    )

    counts = series.join(homes, ["template_id", "industry_code"]).groupBy(*keys, "bar_date").agg(
        F.sum("top_count").alias("top_count"), F.sum("eligible").alias("eligible")
    )
    grid = homes.select(*keys).distinct().withColumn("bar_date", F.explode(days))
    points = _rates(grid.join(counts, [*keys, "bar_date"], "left").fillna(0, ["top_count", "eligible"]), k)
    lines = points.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("bar_date", "top_count", "eligible", "selection_rate"))).alias("series"))

    parts = base.where(small(F.col("top_count"))).groupBy("template_id").agg(
        F.array_sort(F.collect_list(F.struct("industry_code", "industry", "top_count"))).alias("components")
    ).withColumn("block", F.lit(OTHER))
    whole = blocks.join(lines, keys).join(parts, keys, "left")
    row = F.struct(
        F.col("block"), F.when(F.col("block") == OTHER, OTHER).otherwise(F.col("industry")).alias("name"), "eligible", "top_count",
        "selection_rate", "top_share", F.coalesce("current", F.array().cast("array<struct<rank:int,entity:bigint>>")).alias("current"),
        "changes", "series", F.coalesce("components", F.array().cast("array<struct<industry_code:bigint,industry:string,top_count:bigint>>")).alias("components"),
    )
    ranked = _rates(whole, k).select("template_id", "block", "top_count", "industry", row.alias("row"))
    order = F.struct((-F.col("top_count")).alias("less"), "industry", "block", "row")
    single = F.when(F.col("block") != OTHER, order)
    return ranked.groupBy("template_id").agg(
        F.transform(F.array_sort(F.collect_list(single), _by_place), lambda b: b["row"]).alias("industries"),
        F.max_by("row", F.col("block") == OTHER).alias("_last"), F.max(F.col("block") == OTHER).alias("_has"),
    ).select("template_id", "industries", F.when(F.col("_has"), F.col("_last")).alias("other"))


def _by_place(a: Column, b: Column) -> Column:
    """Most members first, then by name and code."""
    out = F.lit(0)
    for field in ("block", "industry", "less"):
        out = F.when(a[field] < b[field], -1).when(a[field] > b[field], 1).otherwise(out)
    return out
