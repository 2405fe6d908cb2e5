"""Rule scores (0-100) of three independent chart patterns, one row per bar.

All inputs are row frames of the same security window, so one sort per security
serves every column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.functions.ranking import top_k
from tapeloom.functions.scalars import clamp, ratio, reasons, round_even
from tapeloom.operators.bars import by_entity
from tapeloom.sources.staging import stage

# Rule parameters and weights of the three patterns.
RULES = {
    "screen": {"lookback_bars": 120, "minimum_bars": 60},
    "breakout": {
        "minimum_bars": 60, "minimum_score": 42, "momentum": 0.16, "breakout": 0.05,
        "volume_ratio": 1.55, "max_extension": 0.22,
        "weights": {"momentum": 30, "breakout": 30, "volume": 18, "trend_fit": 12, "first_wave": 10},
    },
    "pullback": {
        "minimum_bars": 80, "minimum_score": 40, "trend_return": 0.12, "drawdown_min": 0.025,
        "drawdown_max": 0.18, "ma_distance": 0.10, "max_retracement": 0.62, "max_volatility": 0.035,
        "weights": {"trend": 28, "drawdown": 24, "ma_support": 18, "retracement": 14, "consolidation": 8, "trend_fit": 8},
    },
    "range_bounce": {
        "minimum_bars": 100, "minimum_score": 38, "window": 80, "max_position": 0.32, "min_width": 0.15,
        "min_bounce": 0.015, "max_trend": 0.25,
        "weights": {"lower_position": 36, "bounce": 24, "range_width": 14, "sideways_fit": 14, "support_touches": 12},
    },
}
CATEGORIES = ("breakout", "pullback", "range_bounce")


def _frame(n: int, skip: int = 0) -> Window:
    return by_entity().rowsBetween(1 - n - skip, -skip)


def _ago(name: str, n: int) -> Column:
    return F.lag(name, n).over(by_entity())


def _change(name: str, n: int) -> Column:
    return ratio(F.col(name), _ago(name, n), 1.0) - 1


def with_running_sums(bars: DataFrame) -> DataFrame:
    """Running sums of a security's history, from which any trailing fit or mean follows.

    A trailing regression or average is a difference of two running sums, so its
    cost per bar does not depend on the window length.  Prices enter relative to
    the first close, which keeps the sums small.
    """
    past = by_entity().rowsBetween(Window.unboundedPreceding, 0)
    df = bars.withColumns({
        "_i": F.row_number().over(by_entity()).cast("double"),
        "_c0": F.first("close").over(past),
        "_prev": F.lag("close").over(by_entity()),
    })
    u = F.col("close") / F.col("_c0") - 1
    moved = F.coalesce((F.col("close") != F.col("_prev")).cast("int"), F.lit(0))
    return df.withColumns({
        "_s1": F.sum(u).over(past), "_s2": F.sum(u * u).over(past), "_s3": F.sum(u * F.col("_i")).over(past),
        "_moves": F.sum(moved).over(past),
    })


def fit_columns(n: int, slope: str, fit: str) -> tuple[dict[str, Column], dict[str, Column]]:
    """Two column layers over running sums: window sums, then (scaled slope, R2) of the last n closes."""
    def part(name: str) -> Column:
        return F.col(name) - F.coalesce(_ago(name, n), F.lit(0.0))

    sums = {
        f"_w1_{n}": part("_s1"), f"_w2_{n}": part("_s2"), f"_w3_{n}": part("_s3"),
        f"_first_{n}": _ago("close", n - 1), f"_moves_{n}": F.col("_moves") - _ago("_moves", n - 1),
    }
    s1 = F.col(f"_w1_{n}")
    cross = F.col(f"_w3_{n}") - (F.col("_i") - (n - 1) / 2) * s1
    xx, yy = n * (n * n - 1) / 12, F.col(f"_w2_{n}") - s1 * s1 / n
    moved = F.coalesce(F.col(f"_moves_{n}") > 0, F.lit(False))
    scaled = cross / xx * (n - 1) * F.col("_c0") / F.col(f"_first_{n}")
    return sums, {
        slope: F.when(moved, scaled).otherwise(0.0),
        fit: F.when(moved, clamp(F.try_divide(cross * cross, xx * yy))).otherwise(0.0),
    }


def mean_close(n: int) -> Column:
    return F.col("_c0") * (F.col(f"_w1_{n}") / n + 1)


def linear_fit(bars: DataFrame, n: int, slope: str, fit: str) -> DataFrame:
    """Scaled slope and R2 of the last n closes over the first of them (0 for a flat window)."""
    sums, fits = fit_columns(n, slope, fit)
    df = with_running_sums(bars).withColumns(sums).withColumns(fits)
    return df.drop(*[c for c in df.columns if c.startswith("_")])


def _breakout_layers() -> tuple[dict, dict, Column, Column]:
    c, w = RULES["breakout"], RULES["breakout"]["weights"]
    base = {
        "return_20": _change("close", 20),
        "breakout": ratio(F.col("close"), F.max("close").over(_frame(35, 5)), 1.0) - 1,
        "volume_ratio": ratio(F.avg("volume").over(_frame(5)), F.avg("volume").over(_frame(20, 5)), 1.0),
    }
    derived = {"extension": ratio(F.col("close"), mean_close(20), 1.0) - 1}
    ret, brk, vol, ext = (F.col(n) for n in ("return_20", "breakout", "volume_ratio", "extension"))
    slope, fit = F.col("slope_20"), F.col("fit_20")
    score = (
        w["momentum"] * clamp(ret / c["momentum"])
        + w["breakout"] * clamp((brk + 0.015) / (c["breakout"] + 0.015))
        + w["volume"] * clamp((vol - 0.8) / (c["volume_ratio"] - 0.8))
        + w["trend_fit"] * fit * clamp(slope / 0.15)
        + w["first_wave"] * (1 - clamp(F.greatest(ext, F.lit(0.0)) / c["max_extension"]))
    )
    weak = (ret < 0.03) | (brk < -0.035) | (ext > c["max_extension"] * 1.5)
    notes = reasons([
        (ret >= c["momentum"] * 0.65, "fast 20-bar rise"),
        (brk >= 0, "above the recent platform"),
        (vol >= c["volume_ratio"], "rising volume"),
        (ext.between(0, c["max_extension"]), "first-wave distance to the average"),
        ((fit >= 0.65) & (slope > 0), "clean short trend"),
    ], "short structure close to a breakout")
    return base, derived, F.when(weak, score * 0.62).otherwise(score), notes


def _pullback_layers() -> tuple[dict, dict, Column, Column]:
    c, w = RULES["pullback"], RULES["pullback"]["weights"]
    close = F.col("close")
    base = {
        "return_60": _change("close", 60),
        "_peak": F.max("high").over(_frame(30)),
        "_base": F.min("close").over(_frame(60)),
        "_vol": F.stddev_pop("_ret").over(_frame(10)),
    }
    derived = {
        "drawdown": (F.col("_peak") - close) / F.col("_peak"),
        "ma_distance": F.least(F.abs(close / mean_close(20) - 1), F.abs(close / mean_close(40) - 1)),
        "retracement": (F.col("_peak") - close) / F.greatest(F.col("_peak") - F.col("_base"), F.lit(1e-9)),
        "_ma60": mean_close(60),
    }
    ret, dd, dist, back, vol = (F.col(n) for n in ("return_60", "drawdown", "ma_distance", "retracement", "_vol"))
    middle, half = (c["drawdown_min"] + c["drawdown_max"]) / 2, (c["drawdown_max"] - c["drawdown_min"]) / 2
    bonus = F.when(close >= F.col("_ma60"), 0.15).otherwise(0.0)
    score = (
        w["trend"] * clamp(ret / c["trend_return"])
        + w["drawdown"] * (1 - clamp(F.abs(dd - middle) / half))
        + w["ma_support"] * F.least(F.lit(1.0), 1 - clamp(dist / c["ma_distance"]) + bonus)
        + w["retracement"] * (1 - clamp(F.abs(back - 0.44) / 0.44))
        + w["consolidation"] * (1 - clamp(vol / c["max_volatility"]))
        + w["trend_fit"] * F.col("fit_60") * clamp(F.col("slope_60") / 0.20)
    )
    weak = (ret < 0.04) | (close < F.col("_ma60") * 0.95) | (dd > c["drawdown_max"] * 1.4)
    notes = reasons([
        (ret >= c["trend_return"], "medium trend intact"),
        (dd.between(c["drawdown_min"], c["drawdown_max"]), "shallow drawdown"),
        (dist <= c["ma_distance"], "back at average support"),
        (back.between(0.32, c["max_retracement"]), "near a 38/50 % retracement"),
        (vol <= c["max_volatility"], "volatility contracting"),
    ], "structure close to a trend pullback")
    return base, derived, F.when(weak, score * 0.62).otherwise(score), notes


def _range_layers() -> tuple[dict, dict, Column, Column]:
    c, w = RULES["range_bounce"], RULES["range_bounce"]["weights"]
    n = c["window"]
    base = {
        "_top": F.max("high").over(_frame(n)),
        "_bottom": F.min("low").over(_frame(n)),
        "_lows": F.collect_list("low").over(_frame(n)),
        "bounce_5": _change("close", 5),
        "_long": _change("close", n - 1),
    }
    span = F.greatest(F.col("_top") - F.col("_bottom"), F.lit(1e-9))
    derived = {
        "range_position": (F.col("close") - F.col("_bottom")) / span,
        "range_width": span / F.greatest(F.col("_bottom"), F.lit(1e-9)),
        "touches": F.size(F.filter("_lows", lambda x: x <= F.col("_bottom") + span * 0.08)),
        "sideways": (1 - clamp(F.abs("_long") / c["max_trend"])) * (1 - F.abs(F.col("slope_80"))),
    }
    pos, width, bounce, side, touch = (
        F.col(x) for x in ("range_position", "range_width", "bounce_5", "sideways", "touches")
    )
    score = (
        w["lower_position"] * (1 - clamp(pos / c["max_position"]))
        + w["bounce"] * clamp((bounce + 0.01) / (c["min_bounce"] + 0.01))
        + w["range_width"] * clamp(width / c["min_width"])
        + w["sideways_fit"] * clamp(side)
        + w["support_touches"] * clamp(touch / 4)
    )
    weak = (pos > c["max_position"] * 1.5) | (width < c["min_width"] * 0.6)
    notes = reasons([
        (pos <= c["max_position"], "at the lower edge of the range"),
        (bounce >= c["min_bounce"], "short bounce from the edge"),
        (width >= c["min_width"], "range wide enough"),
        (touch >= 3, "support tested repeatedly"),
        (side >= 0.55, "good sideways fit"),
    ], "structure close to a range bounce")
    return base, derived, F.when(weak, score * 0.58).otherwise(score), notes


_LAYERS = {"breakout": _breakout_layers, "pullback": _pullback_layers, "range_bounce": _range_layers}
_FITS = {"breakout": (20,), "pullback": (20, 40, 60), "range_bounce": (80,)}


def pattern_scores(bars: DataFrame, categories: tuple[str, ...] = CATEGORIES, only: Column | None = None) -> DataFrame:
    """Scores and reasons of the chosen patterns for every bar (null below the minimum history).

    Columns are added layer by layer (running sums, window columns, metrics,
    scores): five projections whatever the number of patterns.  ``only`` says which bars
    are scored; the others leave after the window columns, the last layer that looks back.
    """
    df = with_running_sums(bars.withColumn("volume", F.coalesce(F.col("volume"), F.lit(0.0))))
    df = df.withColumns({
        "n_past": F.least(F.col("_i").cast("int"), F.lit(RULES["screen"]["lookback_bars"])),
        "_ret": F.col("close") / F.col("_prev") - 1,
    })
    base, fits, derived, final = {}, {}, {}, {}
    for n in sorted({n for c in categories for n in _FITS[c]}):
        sums, columns = fit_columns(n, f"slope_{n}", f"fit_{n}")
        base |= sums
        fits |= columns
    for c in categories:
        window_columns, metrics, score, notes = _LAYERS[c]()
        base |= window_columns
        derived |= metrics
        enough = F.col("n_past") >= RULES[c]["minimum_bars"]
        final[f"score_{c}"] = F.when(enough, score)
        final[f"reasons_{c}"] = F.when(enough, notes)
    df = df.withColumns(base)
    df = df if only is None else df.where(only)
    df = df.withColumns(fits).withColumns(derived).withColumns(final)
    return df.drop(*[name for name in df.columns if name.startswith("_")])


def recent_bars(bars: DataFrame, n: int = RULES["screen"]["lookback_bars"]) -> DataFrame:
    """Only the last n bars of each security: no rule looks further back."""
    return top_k(bars, ["entity"], [F.col("bar_date").desc()], n, "_rn").drop("_rn")


def latest_matches(bars: DataFrame) -> DataFrame:
    """One row per security: status, primary category and the list of matches at its last bar.

    The rows are written, so that what callers filter or explode never becomes a predicate on the score formulas: the
    optimizer would put the whole formulas into it and go through their aliases until the driver has no memory left.
    """
    recent = recent_bars(bars).withColumn("next_date", F.lead("bar_date").over(by_entity()))
    return stage(_matches(pattern_scores(recent, only=F.col("next_date").isNull())))


def matches_on(bars: DataFrame, days: dict[str, Column]) -> DataFrame:
    """``latest_matches`` as of each named day, with the name as ``day``; one pass over the bars whatever the number of days.

    Kept are the bars up to the newest day, of those up to the earliest one the last of each security, as no rule looks further back.
    """
    first, last = F.array_min(F.array(*days.values())), F.array_max(F.array(*days.values()))
    back = Window.partitionBy("entity").orderBy(F.col("bar_date").desc()).rowsBetween(Window.unboundedPreceding, 0)
    old = F.sum((F.col("bar_date") <= first).cast("int")).over(back)
    near = bars.where(F.col("bar_date") <= last).withColumn("_old", old).where(F.col("_old") <= RULES["screen"]["lookback_bars"]).drop("_old")
    near = near.withColumn("next_date", F.lead("bar_date").over(by_entity()))

    def newest_on(day: Column) -> Column:
        return (F.col("bar_date") <= day) & (F.col("next_date").isNull() | (F.col("next_date") > day))

    named = F.array_compact(F.array(*[F.when(newest_on(d), F.lit(name)) for name, d in days.items()]))
    near = near.withColumn("days", named)
    return _matches(pattern_scores(near, only=F.size("days") > 0).withColumn("day", F.explode("days")), "day")


def _matches(last: DataFrame, *keep: str) -> DataFrame:
    """Status, primary category and matches of scored bars."""
    options = F.array(*[
        F.struct(
            round_even(F.col(f"score_{c}"), 2).alias("score"), F.lit(-i).alias("priority"), F.lit(c).alias("category"),
            F.slice(f"reasons_{c}", 1, 4).alias("reasons"),
            (F.col(f"score_{c}") >= RULES[c]["minimum_score"]).alias("passed"),
        )
        for i, c in enumerate(CATEGORIES)
    ])
    matches = F.filter(options, lambda o: F.coalesce(o["passed"], F.lit(False)))
    status = (
        F.when(F.col("n_past") < RULES["screen"]["minimum_bars"], "not_calculated")
        .when(F.size("matches") > 0, "matched").otherwise("no_match")
    )
    return (
        last.withColumn("matches", matches).withColumn("status", status)
        .withColumn("primary", F.array_max("matches"))
        .select(*keep, "entity", "bar_date", "close", "n_past", "status", "matches", "primary")
    )


def category_list(matches: DataFrame) -> DataFrame:
    """Long form: one row per security and matched category."""
    return matches.select("entity", "bar_date", F.explode("matches").alias("m")).select(
        "entity", "bar_date", "m.category", "m.score", "m.reasons"
    )
