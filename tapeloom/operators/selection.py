"""Greedy quota filling over named profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeloom.sources.staging import stage


def fill_quotas(scored: DataFrame, quotas: dict[str, int]) -> DataFrame:
    """Fill each profile's quota in order, never reusing a sample or a group.

    ``scored``: (profile, entity, grp, profile_score).  Ranked picking that skips
    used groups equals taking the best sample of every unused group, so each step
    is one aggregate and a sorted limit.  Only the chosen keys (at most the sum of
    the quotas) return to the driver to exclude them from the next step.
    """
    pool = stage(scored.withColumn("_h", F.sha2(F.col("entity").cast("string"), 256)))
    used: list[int] = []
    chosen: list[tuple] = []
    for profile, quota in quotas.items():
        left = pool.where(F.col("profile") == profile)
        if used:
            left = left.where(~F.col("grp").isin(used))
        # Highest score first; between equal scores the smaller hash.
        key = F.struct((-F.col("profile_score")).alias("s"), F.col("_h").alias("h"))
        best = left.groupBy("grp").agg(F.min_by(F.struct("entity", "profile_score", key.alias("k")), key).alias("b"))
        rows = best.orderBy("b.k").limit(quota).select("grp", "b.entity", "b.profile_score").collect()
        if len(rows) < quota:
            raise ValueError(f"profile {profile}: {quota} samples requested, {len(rows)} available")
        used += [r.grp for r in rows]
        chosen += [(profile, r.entity, r.grp, r.profile_score) for r in rows]
    return scored.sparkSession.createDataFrame(chosen, "profile string, entity long, grp long, profile_score double")
