"""Entry, retain and exit flows between snapshots.

Every member row speaks twice: once as "current" at its own snapshot and once as
"prior" at the snapshot that will look back at it.  One aggregate over (snapshot,
security) then yields the three states; there is no self join and no set is
collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def shifted_states(
    members: DataFrame, keys: list[str], lags: list[int], group: list[str], newest: Column
) -> DataFrame:
    """(keys, lag, ord, entity, cur_*, prior_*, state) for current vs `lag` ordinals earlier."""
    payload = F.struct(*group)
    lag = F.explode(F.array(*[F.lit(n) for n in lags])).alias("lag")
    base = members.select(*keys, "ord", "entity", payload.alias("g"), lag)
    sides = F.array(
        F.struct(F.col("ord").alias("ord"), F.col("g").alias("cur"), F.lit(None).cast(base.schema["g"].dataType).alias("prior")),
        F.struct((F.col("ord") + F.col("lag")).alias("ord"), F.lit(None).cast(base.schema["g"].dataType).alias("cur"), F.col("g").alias("prior")),
    )
    spoken = base.select(*keys, "lag", "entity", F.explode(sides).alias("s"))
    merged = spoken.select(*keys, "lag", "entity", "s.*").where(F.col("ord") <= newest)
    both = merged.groupBy(*keys, "lag", "ord", "entity").agg(
        F.max("cur").alias("cur"), F.max("prior").alias("prior")
    )
    state = (
        F.when(F.col("cur").isNotNull() & F.col("prior").isNotNull(), "retained")
        .when(F.col("cur").isNotNull(), "new").otherwise("exit")
    )
    return both.withColumn("state", state)


def flow_counts(states: DataFrame, keys: list[str]) -> DataFrame:
    """Counts per state of already keyed rows."""
    return states.groupBy(*keys).agg(
        F.count_if(F.col("state") == "new").alias("new_count"),
        F.count_if(F.col("state") == "retained").alias("retained_count"),
        F.count_if(F.col("state") == "exit").alias("exit_count"),
    )


def flows_to_last_seen(
    seen: DataFrame, selected: DataFrame, keys: list[str], order: str = "ord"
) -> DataFrame:
    """Flows of a group against the last snapshot in which that group appeared.

    ``seen``      one row per (keys, order) where the group exists
    ``selected``  member rows (keys, order, entity)
    """
    w = Window.partitionBy(*keys).orderBy(order)
    steps = seen.select(*keys, order).withColumn("_next", F.lead(order).over(w))
    placed = selected.join(steps, [*keys, order])
    sides = F.array(
        F.struct(F.col(order).alias("at"), F.lit(1).alias("c"), F.lit(0).alias("p")),
        F.struct(F.col("_next").alias("at"), F.lit(0).alias("c"), F.lit(1).alias("p")),
    )
    spoken = placed.select(*keys, "entity", F.explode(sides).alias("s")).where(F.col("s.at").isNotNull())
    both = spoken.groupBy(*keys, F.col("s.at").alias(order), "entity").agg(
        F.max("s.c").alias("c"), F.max("s.p").alias("p")
    )
    counted = both.groupBy(*keys, order).agg(
        F.sum(F.col("c") * (1 - F.col("p"))).alias("new_count"),
        F.sum(F.col("c") * F.col("p")).alias("retained_count"),
        F.sum(F.col("p") * (1 - F.col("c"))).alias("exit_count"),
    )
    return seen.select(*keys, order).join(counted, [*keys, order], "left").fillna(
        0, ["new_count", "retained_count", "exit_count"]
    )
