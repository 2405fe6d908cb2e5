"""Industry rotation over a fixed grid of sample dates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.functions.ranking import top_k
from tapeloom.operators.asof import as_of_samples, sampled_span
from tapeloom.operators.membership import industry_on, listed_on
from tapeloom.operators.patterns import RULES, pattern_scores
from tapeloom.functions.scalars import round_even

# Fixed values of the rotation study.
SAMPLES = 24
STEP = 5
RECENT = 4
SLOPE_EPSILON = 0.25
RAPID_DELTA = 3
VISIBLE = 12
DIRECTION_SLOTS = 4


def universe(securities: DataFrame, samples: DataFrame, flags: DataFrame, membership: DataFrame, boards: list[str]) -> DataFrame:
    """Eligible securities per sample date: board, listed, not flagged, with industry (inclusive end).

    The 24 sample dates ride along as one literal array per security, so the
    expansion is a local explode; nothing is cross joined.
    """
    grid = samples.agg(F.array_sort(F.collect_list(F.struct("sample", "bar_date")))).scalar()
    rows = (
        securities.where(F.col("board").isin(boards))
        .select("entity", "name", "list_date", "delist_date", F.explode(grid).alias("s"))
        .select("entity", "name", "list_date", "delist_date", "s.sample", "s.bar_date")
        .where(listed_on(F.col("bar_date")))
        .join(flags.select("entity", "bar_date"), ["entity", "bar_date"], "left_anti")
    )
    return industry_on(rows, membership, end_inclusive=True, fill_missing=False).drop("list_date", "delist_date")


def top_by_sample(bars_with_ord: DataFrame, eligible: DataFrame, first: Column, category: str, k: int) -> DataFrame:
    """Top-k of one pattern per sample date, scored on the last bar at or before it."""
    score = f"score_{category}"
    near = sampled_span(bars_with_ord, first, STEP, SAMPLES, RULES["screen"]["lookback_bars"])
    scored = pattern_scores(near, (category,)).select("entity", "bar_date", "ord", score)
    last = as_of_samples(scored, first, STEP, SAMPLES, [score])
    passed = last.where(F.col(score) >= RULES[category]["minimum_score"])
    joined = passed.join(eligible, ["entity", "sample"]).withColumn("score", round_even(F.col(score), 2))
    return top_k(joined, ["sample"], [F.col("score").desc(), F.col("entity")], k)


def matrix(top: DataFrame, membership: DataFrame, samples: DataFrame) -> DataFrame:
    """Industry x sample counts with zeros, the change to the previous sample (first against 0), and the securities by rank."""
    grid = samples.agg(F.array_sort(F.collect_list(F.struct("sample", "bar_date")))).scalar()
    catalog = membership.select("industry_code", "industry").distinct()
    cells = catalog.select("industry_code", "industry", F.explode(grid).alias("s")).select("industry_code", "industry", "s.*")
    counts = top.where(F.col("industry_code").isNotNull()).groupBy("sample", "industry_code").agg(
        F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(F.struct("rank", "entity", "score"))).alias("stocks")  # at most a list's members
    )
    full = cells.join(counts, ["sample", "industry_code"], "left").fillna(0, ["n"])
    full = full.withColumn("stocks", F.coalesce("stocks", F.array().cast(counts.schema["stocks"].dataType)))
    w = Window.partitionBy("industry_code").orderBy("sample")
    return full.withColumn("change", F.col("n") - F.lag("n", 1, 0).over(w))


def features(cells: DataFrame) -> DataFrame:
    """Slope and persistence of the last four samples, recent change, effective and cumulative count."""
    # every industry has a row for every sample
    newest = F.max("sample").over(Window.partitionBy("industry_code"))
    recent = F.col("_recent")
    per = cells.withColumn("_recent", F.col("sample") > newest - RECENT).groupBy("industry_code", "industry").agg(
        F.sum("n").alias("cumulative"),
        F.array_sort(F.collect_list(F.when(recent, F.struct("sample", "n")))).alias("last"),
        F.regr_slope(F.when(recent, F.col("n")), F.when(recent, F.col("sample"))).alias("slope"),
    ).withColumn("counts", F.transform("last", lambda x: x["n"]))
    slope = round_even(F.coalesce("slope", F.lit(0.0)), 2)
    steps = F.zip_with(F.slice("counts", 2, RECENT - 1), F.slice("counts", 1, RECENT - 1), lambda b, a: b - a)
    same = F.size(F.filter(steps, lambda d: F.signum(d.cast("double")) == F.signum(F.col("slope")))) / F.lit(RECENT - 1.0)
    positive = F.filter("counts", lambda n: n > 0)
    return (
        per.withColumn("slope", slope)
        .withColumn("persistence", F.when(F.abs("slope") < SLOPE_EPSILON, 0.0).otherwise(round_even(same, 2)))
        .withColumn("recent_change", F.element_at("counts", -1) - F.element_at("counts", 1))
        .withColumn("effective", F.coalesce(F.try_element_at(positive, F.lit(-1)), F.lit(0)))
        .withColumn("current_count", F.element_at("counts", -1))
        .drop("last")
    )


def ranks(feats: DataFrame) -> DataFrame:
    """Level rank, rotation rank and status; one row per industry (bounded by the catalog)."""
    level = Window.orderBy(F.col("current_count").desc(), F.col("cumulative").desc(), "industry_code")
    speed = Window.orderBy(F.abs("slope").desc(), F.col("persistence").desc(), F.col("effective").desc(), "industry_code")
    df = feats.withColumn("current_rank", F.row_number().over(level)).withColumn("rotation_rank", F.row_number().over(speed))
    now, before = F.element_at("counts", -1), F.try_element_at("counts", F.lit(-2))
    up, down = F.col("slope") >= SLOPE_EPSILON, F.col("slope") <= -SLOPE_EPSILON
    status = (
        F.when(up & (before <= 1) & (now - before >= RAPID_DELTA), "rapid_start")
        .when(up & (F.col("persistence") >= 0.66), "steady_rise")
        .when(up, "rising")
        .when((F.col("current_rank") <= 5) & down & (F.array_max("counts") > now), "high_ebb")
        .when(down, "falling")
        .otherwise("flat")
    )
    return df.withColumn("status", status)


def select_active(ranked: DataFrame, limit: int = VISIBLE) -> DataFrame:
    """Up to `limit` industries: first 4 rising, first 4 falling, then the fastest of the rest."""
    active = ranked.where(F.exists("counts", lambda n: n != 0))
    side = F.when(F.col("slope") >= SLOPE_EPSILON, 1).when(F.col("slope") <= -SLOPE_EPSILON, -1).otherwise(0)
    w = Window.partitionBy("_side").orderBy("rotation_rank")
    df = active.withColumn("_side", side).withColumn("_n", F.row_number().over(w))
    tier = (
        F.when((F.col("_side") == 1) & (F.col("_n") <= DIRECTION_SLOTS), 0)
        .when((F.col("_side") == -1) & (F.col("_n") <= DIRECTION_SLOTS), 1).otherwise(2)
    )
    picked = df.orderBy(tier, "rotation_rank").limit(limit).drop("_side", "_n")
    shown = Window.orderBy(F.col("slope").desc(), F.col("persistence").desc(), F.col("effective").desc(), "industry_code")
    return picked.withColumn("display", F.row_number().over(shown))


def summary(ranked: DataFrame, cells: DataFrame) -> DataFrame:
    """One row: coverage, strongest, fastest, concentration and new Top-10 industries."""
    last = cells.agg(F.max("sample")).scalar()
    order = Window.orderBy(F.col("prev").desc(), "industry_code")
    start = Window.orderBy(F.col("start").desc())
    wide = cells.groupBy("industry_code").agg(
        F.max(F.when(F.col("sample") == last - 1, F.col("n"))).alias("prev"),
        F.max(F.when(F.col("sample") == last - RECENT + 1, F.col("n"))).alias("start"),
    )
    wide = wide.withColumn("prev_rank", F.row_number().over(order)).withColumn("start_rank", F.row_number().over(start))
    df = ranked.join(wide, "industry_code")
    up, down = F.col("slope") >= SLOPE_EPSILON, F.col("slope") <= -SLOPE_EPSILON
    fast = -F.col("rotation_rank")
    out = df.agg(
        F.count_if(F.col("current_count") > 0).alias("covered"),
        F.min_by(F.when(F.col("current_count") > 0, F.col("industry")), "current_rank").alias("strongest"),
        F.max_by(F.when(up, F.col("industry")), F.when(up, fast)).alias("fastest_up"),
        F.max_by(F.when(down, F.col("industry")), F.when(down, fast)).alias("fastest_down"),
        F.count_if(up).alias("rising"), F.count_if(down).alias("falling"),
        F.sum(F.when(F.col("current_rank") <= 3, F.col("current_count"))).alias("top3"),
        F.sum(F.when(F.col("start_rank") <= 3, F.col("start"))).alias("top3_start"),
        F.count_if((F.col("current_rank") <= 10) & (F.col("prev_rank") > 10)).alias("new_top10"),
    )
    delta = F.col("top3") - F.col("top3_start")
    state = F.when(delta >= 5, "concentrating").when(delta <= -5, "spreading").otherwise("stable")
    return out.withColumn("concentration", state)
