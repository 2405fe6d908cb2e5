"""Shape facts of 120-bar windows.

One row per window carries the bounded arrays c, h, l, v (close, high, low,
volume, oldest first).  All facts are array expressions on that row, so a window
is self-contained: nothing before its first bar or after its last can leak in,
and windows are scored in parallel without further shuffles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.functions.scalars import clamp, flag, mean_of, ratio
from tapeloom.operators.bars import by_entity

N = 120
FIELDS = {"c": "close", "h": "high", "l": "low", "v": "volume"}


def latest_windows(bars: DataFrame, as_of: Column) -> DataFrame:
    """The newest complete window of every security that ends on as_of."""
    newest = Window.partitionBy("entity").orderBy(F.col("bar_date").desc())
    tail = bars.where(F.col("bar_date") <= as_of).withColumn("_rn", F.row_number().over(newest)).where(F.col("_rn") <= N)
    point = F.struct("bar_date", *[F.col(src).alias(k) for k, src in FIELDS.items()])
    packed = tail.groupBy("entity").agg(F.array_sort(F.collect_list(point)).alias("w"))
    packed = packed.withColumn("bar_date", F.element_at("w", -1)["bar_date"])
    return _unpack(packed.where((F.size("w") == N) & (F.col("bar_date") == as_of)))


def sliding_windows(bars: DataFrame, stride: int) -> DataFrame:
    """Windows ending at every `stride`-th bar of a security, and at its last bar."""
    # One array per security (bounded by the calendar), cut at the stops only.
    point = F.struct("pos", "bar_date", *[F.col(src).alias(k) for k, src in FIELDS.items()])
    whole = bars.groupBy("entity").agg(F.array_sort(F.collect_list(point)).alias("all")).where(F.size("all") >= N)
    n = F.size("all")
    stops = F.filter(F.sequence(F.lit(N), n), lambda i: ((i - N) % stride == 0) | (i == n))
    cut = whole.select("entity", "all", F.explode(stops).alias("stop"))
    return _unpack(cut.select("entity", F.get("all", F.col("stop") - 1)["bar_date"].alias("bar_date"), F.slice("all", F.col("stop") - N + 1, N).alias("w")))


def _unpack(df: DataFrame) -> DataFrame:
    good = F.forall("w", lambda p: (p["c"] > 0) & p["h"].isNotNull() & p["l"].isNotNull() & p["v"].isNotNull())
    def taken(field: str) -> Column:
        # not w[field]: that counts as cheap, so the optimizer would take the array out again at every use, inside lambdas too
        return F.transform("w", lambda p: p[field]).alias(field)

    return df.where(good).select("entity", "bar_date", *[taken(k) for k in FIELDS])


def at(arr: str, i: int | Column) -> Column:
    """Element by 0-based position; a negative int counts from the end."""
    if isinstance(i, int):
        return F.get(arr, F.lit(i if i >= 0 else N + i))
    return F.get(arr, i)


def part(arr: str, start: int | Column, count: int) -> Column:
    begin = F.lit(start + 1) if isinstance(start, int) else start + 1
    return F.slice(arr, begin.cast("int"), F.lit(count))


def last(arr: str, n: int) -> Column:
    return part(arr, N - n, n)


def total(arr: Column) -> Column:
    return F.aggregate(arr, F.lit(0.0), lambda a, x: a + x)


def mean(arr: Column, n: int) -> Column:
    return total(arr) / n


def deviation(arr: Column, n: Column | int) -> Column:
    """Population standard deviation of n values in one pass."""
    start = F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("b"))
    size = F.lit(n).cast("double") if isinstance(n, int) else n.cast("double")
    return F.aggregate(
        arr, start,
        lambda s, x: F.struct((s["a"] + x).alias("a"), (s["b"] + x * x).alias("b")),
        lambda s: F.sqrt(F.greatest(s["b"] / size - (s["a"] / size) * (s["a"] / size), F.lit(0.0))),
    )


def fit_of(values: Column, first: Column, n: int) -> Column:
    """struct(slope, fit) of n closes given relative to the window's first close.

    ``values`` are close / c0 - 1, ``first`` is the close the slope refers to.
    """
    start = F.struct(*[F.lit(0.0).alias(k) for k in ("k", "a", "b", "d")])

    def step(s: Column, x: Column) -> Column:
        return F.struct(
            (s["k"] + 1).alias("k"), (s["a"] + x).alias("a"), (s["b"] + x * x).alias("b"), (s["d"] + x * s["k"]).alias("d")
        )

    def finish(s: Column) -> Column:
        cross = s["d"] - s["a"] * ((n - 1) / 2)
        xx, yy = n * (n * n - 1) / 12, s["b"] - s["a"] * s["a"] / n
        return F.struct(cross.alias("cross"), yy.alias("yy"), (cross * cross / xx).alias("explained"))

    raw = F.aggregate(values, start, step, finish)
    xx = n * (n * n - 1) / 12
    return F.struct(
        (raw["cross"] / xx * (n - 1) * F.col("c0") / first).alias("slope"),
        F.when(raw["yy"] > 1e-15, clamp(raw["explained"] / raw["yy"])).otherwise(0.0).alias("fit"),
    )


def first_position(arr: Column, value: Column) -> Column:
    """0-based position of the first occurrence."""
    return F.array_position(arr, value) - 1


def shared_facts(windows: DataFrame) -> DataFrame:
    """The 84 facts of each window; key columns entity and bar_date are kept."""
    r = F.transform(F.sequence(F.lit(1), F.lit(N - 1)), lambda i: F.get("c", i) / F.get("c", i - 1) - 1)
    df = windows.withColumn("c0", at("c", 0)).withColumns({
        "u": F.transform("c", lambda x: x / F.col("c0") - 1),
        "r": r,
        "now": at("c", -1),
        # First bar of the last 16 that closes 0.3 % above the high of the 20 bars before it.
        "ev": F.try_element_at(
            F.filter(
                F.sequence(F.lit(N - 16), F.lit(N - 1)),
                lambda i: F.get("c", i) >= F.array_max(F.slice("h", i - 19, F.lit(20))) * 1.003,
            ),
            F.lit(1),
        ),
    })
    now = F.col("now")
    layer: dict[str, Column] = {"e": F.coalesce("ev", F.lit(N - 1)), "ce": F.coalesce("ev", F.lit(N))}
    for n in (3, 5, 10, 20, 60, 119):
        layer[f"return_{n}"] = ratio(now, at("c", N - 1 - n), 1.0) - 1
    for n in (10, 20, 60, 120):
        layer[f"_fit_{n}"] = fit_of(last("u", n), at("c", N - n), n)
    for n in (5, 10, 20, 60, 120):
        layer[f"_ma_{n}"] = mean(last("c", n), n)
    for n in (5, 20, 60, 120):
        layer[f"_top_{n}"] = F.array_max(last("h", n))
        layer[f"_bottom_{n}"] = F.array_min(last("l", n))
    layer["_low_10"] = F.array_min(last("l", 10))
    layer["_prior_20"] = F.array_max(part("h", N - 23, 20))
    layer["_prior_60"] = F.array_max(part("h", N - 63, 60))
    layer["_early"] = F.array_max(part("h", 0, N - 30))
    for n in (10, 20, 60):
        layer[f"volatility_{n}"] = deviation(last_returns(n), n)
    for n in (20, 60):
        layer[f"positive_day_ratio_{n}"] = F.size(F.filter(last_returns(n), lambda x: x > 0)) / F.lit(float(n))
    df = df.withColumns(layer)

    e = F.col("e")
    layer = {}
    for n in (10, 20, 60, 120):
        layer[f"trend_slope_{n}"] = F.col(f"_fit_{n}")["slope"]
        layer[f"trend_fit_{n}"] = F.col(f"_fit_{n}")["fit"]
    for n in (5, 10, 20, 60, 120):
        layer[f"ma{n}_extension"] = ratio(now, F.col(f"_ma_{n}"), 1.0) - 1
    steps = [(5, 10), (10, 20), (20, 60), (60, 120)]
    layer["ma_alignment"] = mean_of([flag(F.col(f"_ma_{a}") >= F.col(f"_ma_{b}")) for a, b in steps])
    for n in (20, 60, 120):
        layer[f"drawdown_{n}"] = F.greatest(F.lit(0.0), 1 - ratio(now, F.col(f"_top_{n}"), 1.0))
        layer[f"range_position_{n}"] = ratio(now - F.col(f"_bottom_{n}"), F.col(f"_top_{n}") - F.col(f"_bottom_{n}"), 0.5)
    for n in (20, 60):
        layer[f"breakout_vs_prior_{n}"] = ratio(now, F.col(f"_prior_{n}"), 1.0) - 1
    layer["_peak_at"] = (first_position(last("h", 60), F.col("_top_60")) + (N - 60)).cast("int")
    layer["_resistance"] = F.array_max(F.slice("h", e - 19, F.lit(20)))
    layer["_since"] = F.lit(N) - e
    layer["old_high_gap_120"] = ratio(now, F.col("_early"), 1.0) - 1
    layer["days_since_old_high"] = (N - 1 - first_position(part("h", 0, N - 30), F.col("_early"))).cast("double")
    layer["old_high_rejection_count"] = F.size(F.filter(
        F.sequence(F.lit(1), F.lit(N - 32)),
        lambda i: (F.get("h", i) >= F.col("_early") * 0.97) & (F.get("h", i) >= F.get("h", i - 1)) & (F.get("h", i) >= F.get("h", i + 1)),
    )).cast("double")
    layer["breakout_day_return"] = ratio(at("c", e), at("c", e - 1), 1.0) - 1
    layer["breakout_volume_ratio"] = ratio(at("v", e), mean(part("v", e - 20, 20), 20), 1.0)
    layer["breakout_approach_return_5"] = ratio(at("c", e - 1), at("c", e - 6), 1.0) - 1
    layer["breakout_approach_positive_ratio_10"] = F.size(F.filter(part("r", e - 11, 10), lambda x: x > 0)) / F.lit(10.0)
    calm = F.when(F.col("ev").isNull(), F.lit(19)).otherwise(F.lit(20))
    layer["pre_breakout_volatility_20"] = deviation(F.slice("r", e - calm, calm), calm)
    up = F.filter(last_returns(20), lambda x: x > 0)
    layer["largest_up_day_share_20"] = ratio(F.coalesce(F.array_max(up), F.lit(0.0)), total(up), 0.0)
    layer["volume_ratio_5_20"] = ratio(mean(last("v", 5), 5), mean(part("v", N - 25, 20), 20), 1.0)
    moved = F.arrays_zip(last_returns(20).alias("r"), last("v", 20).alias("v"))

    def traded(keep) -> Column:
        kept = F.filter(moved, keep)
        return F.coalesce(F.try_divide(F.aggregate(kept, F.lit(0.0), lambda a, x: a + x["v"]), F.size(kept)), F.lit(0.0))

    layer["up_down_volume_ratio_20"] = ratio(traded(lambda x: x["r"] > 0), traded(lambda x: x["r"] < 0), 1.0)
    layer["close_location_5"] = ratio(now - F.col("_bottom_5"), F.col("_top_5") - F.col("_bottom_5"), 0.5)
    layer["rebound_from_10_low"] = ratio(now, F.col("_low_10"), 1.0) - 1
    layer["prior_return_60_ex_last_10"] = ratio(at("c", N - 11), at("c", N - 61), 1.0) - 1
    layer["worst_5day_return_20"] = F.array_min(F.transform(
        F.sequence(F.lit(N - 20), F.lit(N - 1)), lambda i: F.get("c", i) / F.get("c", i - 5) - 1
    ))
    spans = F.transform(F.sequence(F.lit(N - 14), F.lit(N - 1)), lambda i: F.greatest(
        F.get("h", i) - F.get("l", i), F.abs(F.get("h", i) - F.get("c", i - 1)), F.abs(F.get("l", i) - F.get("c", i - 1))
    ))
    layer["atr_14_pct"] = ratio(mean(spans, 14), now, 0.0)
    ce = F.col("ce")
    for n in (40, 60, 100):
        layer[f"pre_breakout_context_bars_{n}"] = F.lit(float(n))
        layer[f"_cfit_{n}"] = fit_of(part("u", ce - n, n), at("c", ce - n), n)
        layer[f"_ctop_{n}"] = F.array_max(part("h", ce - n, n))
        layer[f"_clow_{n}"] = F.array_min(part("l", ce - n, n))
        layer[f"_cmean_{n}"] = mean(part("c", ce - n, n), n)
        layer[f"pre_breakout_return_{n}"] = ratio(at("c", ce - 1), at("c", ce - n), 1.0) - 1
    df = df.withColumns(layer)

    hit = F.col("ev").isNotNull()
    res = F.col("_resistance")
    peak_at = F.col("_peak_at")
    layer = {
        "days_since_60_high": (N - 1 - peak_at).cast("double"),
        "breakout_age": F.when(hit, (N - 1 - e).cast("double")).otherwise(99.0),
        "breakout_hold_margin": F.when(hit, ratio(F.array_min(F.slice("c", e + 1, F.col("_since"))), res, 1.0) - 1).otherwise(-1.0),
        "breakout_current_margin": F.when(hit, ratio(now, res, 1.0) - 1).otherwise(-1.0),
        "breakout_post_event_drawdown": F.when(
            hit, F.greatest(F.lit(0.0), 1 - ratio(now, F.array_max(F.slice("h", e + 1, F.col("_since"))), 1.0))
        ).otherwise(1.0),
        "breakout_resistance_window": F.when(hit, 20.0).otherwise(0.0),
        "pullback_duration_60": (N - 1 - peak_at).cast("double"),
        "_peak": F.get("h", peak_at),
        "_prior_low": F.array_min(F.slice("l", F.greatest(peak_at - 60, F.lit(0)) + 1, F.least(peak_at, F.lit(60)) + 1)),
        "pre_breakout_context_bars": F.lit(40.0),
    }
    for n in (40, 60, 100):
        top, low, end = F.col(f"_ctop_{n}"), F.col(f"_clow_{n}"), at("c", ce - 1)
        layer[f"pre_breakout_trend_slope_{n}"] = F.col(f"_cfit_{n}")["slope"]
        layer[f"pre_breakout_trend_fit_{n}"] = F.col(f"_cfit_{n}")["fit"]
        layer[f"pre_breakout_range_width_{n}"] = ratio(top - low, F.col(f"_cmean_{n}"), 0.0)
        layer[f"pre_breakout_range_position_{n}"] = ratio(end - low, top - low, 0.5)
        layer[f"pre_breakout_drawdown_from_high_{n}"] = F.greatest(F.lit(0.0), 1 - ratio(end, top, 1.0))
    turn = [
        clamp(F.col("return_3") / 0.05), clamp(F.col("return_5") / 0.08), flag(now >= F.col("_ma_10")),
        clamp(F.col("close_location_5")), clamp(F.col("rebound_from_10_low") / 0.10),
    ]
    layer["turn_confirmation"] = mean_of(turn)
    df = df.withColumns(layer)
    peak, low = F.col("_peak"), F.col("_prior_low")
    depth = F.greatest(F.lit(0.0), 1 - ratio(now, peak, 1.0))
    stale = [1 - clamp(F.abs("return_60") / 0.15), 1 - clamp(F.col("trend_fit_60")), clamp(F.col("days_since_60_high") / 40.0)]
    df = df.withColumns({
        "breakout_confirmed": flag(hit & (F.col("breakout_age") >= 1) & (F.col("breakout_hold_margin") >= -0.015)),
        "pullback_speed_60": depth / F.greatest(F.col("pullback_duration_60"), F.lit(1.0)),
        "prior_advance_before_peak": F.greatest(F.lit(0.0), ratio(peak, low, 1.0) - 1),
        "retracement_of_prior_advance": ratio(peak - now, peak - low, 0.0),
        "range_staleness_60": mean_of(stale),
    })
    return df.select("entity", "bar_date", *[F.col(k) for k in FIELDS], *FACTS)


def last_returns(n: int) -> Column:
    return F.slice("r", F.lit(N - 1 - n + 1), F.lit(n))


FACT_GROUPS = {
    "fact_returns": [f"return_{n}" for n in (3, 5, 10, 20, 60, 119)],
    "fact_trend": [f"trend_{k}_{n}" for n in (10, 20, 60, 120) for k in ("slope", "fit")],
    "fact_ma": [f"ma{n}_extension" for n in (5, 10, 20, 60, 120)] + ["ma_alignment"],
    "fact_range": [f"{k}_{n}" for n in (20, 60, 120) for k in ("drawdown", "range_position")],
    "fact_prior_breakout": ["breakout_vs_prior_20", "breakout_vs_prior_60"],
    "fact_high_age": ["days_since_60_high"],
    "fact_breakout_event": [
        "breakout_age", "breakout_hold_margin", "breakout_current_margin", "breakout_post_event_drawdown",
        "breakout_confirmed", "breakout_day_return", "breakout_resistance_window", "breakout_volume_ratio",
    ],
    "fact_pre_context": [
        f"pre_breakout_{k}_{n}" for n in (40, 60, 100)
        for k in ("context_bars", "return", "trend_slope", "trend_fit", "range_width", "range_position", "drawdown_from_high")
    ] + ["pre_breakout_context_bars"],
    "fact_approach": ["breakout_approach_return_5", "breakout_approach_positive_ratio_10", "pre_breakout_volatility_20"],
    "fact_spike": ["largest_up_day_share_20"],
    "fact_old_high": ["old_high_gap_120", "days_since_old_high", "old_high_rejection_count"],
    "fact_volatility": ["volatility_10", "volatility_20", "volatility_60", "positive_day_ratio_20", "positive_day_ratio_60"],
    "fact_volume": ["volume_ratio_5_20", "up_down_volume_ratio_20"],
    "fact_short": ["close_location_5", "rebound_from_10_low", "prior_return_60_ex_last_10"],
    "fact_pullback": ["pullback_duration_60", "pullback_speed_60", "prior_advance_before_peak", "retracement_of_prior_advance"],
    "fact_worst5": ["worst_5day_return_20"],
    "fact_turn": ["turn_confirmation"],
    "fact_stale": ["range_staleness_60"],
    "fact_atr": ["atr_14_pct"],
}
FACTS = [f for group in FACT_GROUPS.values() for f in group]

PATH_FACTS = [
    "max_drawdown_120", "max_drawdown_60", "worst_return_5", "worst_return_10", "anchor_up_ratio",
    "recent_pullback_depth_40", "recent_pullback_low_age", "recent_recovery_fraction",
]


def deepest_drawdown(arr: Column) -> Column:
    """struct(worst, at): the largest 1 - x / running peak and the 0-based place where it is first reached.

    One pass with four numbers; an array of all drawdowns would be copied for every element.
    """
    start = F.struct(F.lit(0.0).alias("peak"), F.lit(-1.0).alias("worst"), F.lit(-1).alias("at"), F.lit(0).alias("k"))

    def step(s: Column, x: Column) -> Column:
        peak = F.greatest(s["peak"], x)
        fall = 1 - x / peak
        deeper = fall > s["worst"]
        return F.struct(
            peak.alias("peak"), F.greatest(s["worst"], fall).alias("worst"), F.when(deeper, s["k"]).otherwise(s["at"]).alias("at"), (s["k"] + 1).alias("k")
        )

    return F.aggregate(arr, start, step, lambda s: F.struct(s["worst"].alias("worst"), s["at"].alias("at")))


def path_facts(windows: DataFrame) -> DataFrame:
    """Eight path-risk facts of each window."""
    def worst(n: int) -> Column:
        return F.array_min(F.transform(F.sequence(F.lit(n), F.lit(N - 1)), lambda i: F.get("c", i) / F.get("c", i - n) - 1))

    anchors = F.filter(F.sequence(F.lit(10), F.lit(N - 10), F.lit(10)), lambda i: F.get("c", i) > F.get("c", i - 10))
    df = windows.withColumns({
        "_dd120": deepest_drawdown(F.col("c")), "_dd60": deepest_drawdown(last("c", 60)),
        "_c40": last("c", 40), "_dd40": deepest_drawdown(last("c", 40)),
        "worst_return_5": worst(5), "worst_return_10": worst(10), "anchor_up_ratio": F.size(anchors) / F.lit(11.0),
    }).withColumns({
        "max_drawdown_120": F.col("_dd120.worst"), "max_drawdown_60": F.col("_dd60.worst"),
        "recent_pullback_depth_40": F.col("_dd40.worst"), "_trough": F.col("_dd40.at"),
    })
    trough = F.get("_c40", F.col("_trough"))
    peak = F.array_max(F.slice("_c40", F.lit(1), F.col("_trough") + 1))
    df = df.withColumns({"_low": trough, "_peak": peak})
    span = F.col("_peak") - F.col("_low")
    recovered = F.when(span > 0, (F.get("_c40", F.lit(39)) - F.col("_low")) / span).otherwise(0.0)
    df = df.withColumns({
        "recent_pullback_low_age": (39 - F.col("_trough")).cast("double"), "recent_recovery_fraction": recovered,
    })
    return df.drop(*[x for x in df.columns if x.startswith("_")])
