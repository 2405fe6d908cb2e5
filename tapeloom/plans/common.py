"""Frames shared by several plan modules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeloom.functions.ranking import order_positions, top_k
from tapeloom.operators.calendar import with_ordinal
from tapeloom.operators.membership import industry_on
from tapeloom.plans import similarity as sim
from tapeloom.sources.tables import Market

K = 100  # members of a daily list


def best_first() -> list:
    return [F.col("score").desc(), F.col("entity")]


def scored(m: Market, days: DataFrame | None = None) -> DataFrame:
    """Every listed score (on ``days`` only, if given) with its calendar ordinal."""
    return with_ordinal(sim.scores(m, days), m.cal)


def panel(m: Market, days: DataFrame | None = None) -> DataFrame:
    """Scores with industry (no rank): the central derived fact."""
    return with_ordinal(sim.scores(m, days, industry=True), m.cal)


def ranked(m: Market) -> DataFrame:
    """Scores with their full cross-section rank and group size."""
    return order_positions(scored(m), ["template_id", "bar_date"], "score", ["entity"])


def daily_top(m: Market, k: int = K) -> DataFrame:
    """First k per date and template, with industry attached to the kept rows only."""
    best = top_k(scored(m), ["template_id", "bar_date"], best_first(), k)
    return industry_on(best, m.membership)
