"""Shape scores: declarative terms over the facts, profiles, priors and template distance.

A term is a tuple (kind, fact, numbers...):

``ramp``  0 at the first number, 1 at the second       ``fall``  1 - ramp
``down``  ramp of the negated fact                      ``band``  1 inside [a, b], soft edge s
``in``    1 when a <= fact <= b                         ``raw``   the fact itself
``abs``   its size                                      ``value`` a number in place of a fact
``steps`` by ranges (from, to, value at from, slope), inside [0, 1], 0 elsewhere

Terms combine as ``most``, ``least``, ``product`` (of any number) and ``ratio``; ``none`` is 1 unless all
findings of one of its groups hold.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeloom.functions.scalars import band, clamp, flag, mean_of, ramp

# Calibration profiles (mean of their terms).
PROFILES = {
    "breakout_clean_confirmed": [
        ("in", "breakout_age", 1, 3), ("ramp", "breakout_hold_margin", -0.015, 0.025), ("ramp", "breakout_vs_prior_20", 0.0, 0.06),
        ("ramp", "trend_slope_60", 0.0, 0.20), ("band", "ma20_extension", 0.01, 0.16, 0.10), ("ramp", "breakout_volume_ratio", 0.8, 1.8)],
    "breakout_day_unconfirmed": [
        ("in", "breakout_age", 0, 0), ("ramp", "breakout_vs_prior_20", 0.0, 0.08), ("ramp", "breakout_day_return", 0.02, 0.10),
        ("ramp", "breakout_volume_ratio", 0.9, 2.0), ("band", "ma20_extension", 0.02, 0.20, 0.12)],
    "breakout_downtrend_lookalike": [
        ("down", "trend_slope_60", 0.03, 0.25), ("down", "return_60", 0.03, 0.25), ("ramp", "rebound_from_10_low", 0.04, 0.16),
        ("band", "breakout_vs_prior_20", -0.18, 0.01, 0.10)],
    "breakout_near_boundary": [
        ("band", "breakout_vs_prior_20", -0.025, 0.025, 0.05), ("ramp", "return_5", 0.01, 0.10), ("band", "old_high_gap_120", -0.05, 0.03, 0.08),
        ("fall", "range_staleness_60", 0.65, 0.95)],
    "breakout_stage_day": [
        ("in", "breakout_age", 0, 0), ("ramp", "breakout_day_return", 0.025, 0.10), ("ramp", "breakout_volume_ratio", 1.0, 2.8),
        ("ramp", "breakout_vs_prior_20", 0.0, 0.07), ("ramp", "breakout_approach_return_5", 0.0, 0.08), ("ramp", "breakout_approach_positive_ratio_10", 0.45, 0.75)],
    "breakout_stage_hold_1_3": [
        ("in", "breakout_age", 1, 3), ("raw", "breakout_confirmed"), ("ramp", "breakout_hold_margin", -0.015, 0.025),
        ("ramp", "breakout_current_margin", 0.0, 0.08), ("fall", "breakout_post_event_drawdown", 0.03, 0.10), ("ramp", "breakout_volume_ratio", 0.9, 2.2)],
    "breakout_stage_aging_5_15": [
        ("in", "breakout_age", 5, 15), ("raw", "breakout_confirmed"), ("ramp", "breakout_hold_margin", -0.015, 0.025),
        ("band", "breakout_current_margin", 0.0, 0.16, 0.10), ("fall", "breakout_post_event_drawdown", 0.05, 0.16), ("ramp", "trend_slope_20", 0.01, 0.20)],
    "breakout_stage_range_retest": [
        ("band", "breakout_vs_prior_20", -0.015, 0.045, 0.05), ("ramp", "return_5", 0.02, 0.10), ("ramp", "old_high_rejection_count", 3.0, 8.0),
        ("fall", "trend_fit_60", 0.35, 0.75), ("ramp", "breakout_volume_ratio", 0.9, 2.5)],
    "breakout_stage_downtrend_surge": [
        ("down", "trend_slope_60", 0.03, 0.25), ("down", "return_60", 0.03, 0.25), ("ramp", "return_3", 0.05, 0.16),
        ("ramp", "breakout_volume_ratio", 1.0, 3.0), ("band", "breakout_vs_prior_20", -0.02, 0.08, 0.08)],
    "trend_clean": [
        ("ramp", "return_60", 0.08, 0.35), ("ramp", "trend_slope_60", 0.06, 0.30), ("ramp", "trend_fit_60", 0.45, 0.90),
        ("fall", "drawdown_60", 0.08, 0.22), ("ramp", "ma_alignment", 0.50, 1.0), ("fall", "range_staleness_60", 0.45, 0.85)],
    "trend_old_high": [
        ("ramp", "return_60", 0.08, 0.30), ("ramp", "trend_fit_60", 0.35, 0.85), ("band", "old_high_gap_120", -0.04, 0.035, 0.06),
        ("ramp", "days_since_old_high", 35.0, 90.0), ("fall", "drawdown_60", 0.10, 0.25)],
    "trend_overextended": [
        ("ramp", "return_60", 0.15, 0.50), ("ramp", "ma20_extension", 0.12, 0.28), ("ramp", "largest_up_day_share_20", 0.25, 0.65),
        ("ramp", "trend_slope_60", 0.10, 0.40)],
    "trend_range_boundary": [
        ("ramp", "range_staleness_60", 0.55, 0.95), ("band", "return_60", -0.08, 0.12, 0.10), ("ramp", "days_since_60_high", 20.0, 50.0),
        ("fall", "trend_fit_60", 0.20, 0.60)],
    "pullback_shallow_confirmed": [
        ("ramp", "prior_advance_before_peak", 0.10, 0.35), ("band", "drawdown_60", 0.05, 0.16, 0.08), ("band", "pullback_duration_60", 3.0, 20.0, 12.0),
        ("ramp", "turn_confirmation", 0.45, 0.85), ("fall", "range_staleness_60", 0.55, 0.90)],
    "pullback_deep_fast": [
        ("ramp", "prior_advance_before_peak", 0.18, 0.50), ("ramp", "drawdown_60", 0.20, 0.38), ("ramp", "pullback_speed_60", 0.012, 0.035),
        ("down", "worst_5day_return_20", 0.08, 0.22)],
    "pullback_long_stale": [
        ("ramp", "prior_advance_before_peak", 0.10, 0.35), ("ramp", "pullback_duration_60", 25.0, 50.0), ("ramp", "range_staleness_60", 0.45, 0.90),
        ("fall", "turn_confirmation", 0.45, 0.80)],
    "pullback_moderate": [
        ("ramp", "prior_advance_before_peak", 0.12, 0.35), ("band", "drawdown_60", 0.12, 0.24, 0.10), ("band", "pullback_duration_60", 5.0, 25.0, 15.0),
        ("ramp", "turn_confirmation", 0.30, 0.75)],
}

# How many samples each calibration profile receives.
QUOTAS = {
    "breakout_clean_confirmed": 3, "breakout_day_unconfirmed": 2, "breakout_downtrend_lookalike": 2, "breakout_near_boundary": 3,
    "trend_clean": 3, "trend_old_high": 2, "trend_overextended": 1, "trend_range_boundary": 1,
    "pullback_shallow_confirmed": 2, "pullback_deep_fast": 2, "pullback_long_stale": 2, "pullback_moderate": 1,
}
# The second set, stages of a breakout.
STAGE_QUOTAS = {
    "breakout_stage_day": 2, "breakout_stage_hold_1_3": 3, "breakout_stage_aging_5_15": 3,
    "breakout_stage_range_retest": 2, "breakout_stage_downtrend_surge": 2,
}

# Weighted priors (weight, term), hard findings (fact, comparison, limit) and penalty.
PRIORS = {
    "visual": {
        "penalty": 0.35,
        "terms": [
            (1.5, ("band", "return_119", 0.20, 0.90, 0.25)), (1.5, ("band", "return_60", 0.12, 0.48, 0.18)),
            (2.0, ("ramp", "prior_return_60_ex_last_10", 0.06, 0.24)), (2.0, ("ramp", "trend_fit_120", 0.38, 0.78)),
            (2.0, ("ramp", "trend_fit_60", 0.50, 0.86)), (1.5, ("band", "trend_slope_60", 0.10, 0.42, 0.18)),
            (1.5, ("band", "trend_slope_120", 0.12, 0.65, 0.25)), (1.5, ("ramp", "ma_alignment", 0.70, 1.0)),
            (1.5, ("fall", "drawdown_60", 0.10, 0.23)), (1.5, ("fall", "range_staleness_60", 0.42, 0.78)),
            (1.25, ("fall", "volatility_20", 0.026, 0.050)), (1.25, ("fall", "volatility_60", 0.028, 0.052)),
            (1.5, ("fall", "largest_up_day_share_20", 0.25, 0.52)), (1.25, ("band", "ma20_extension", 0.0, 0.10, 0.08)),
            (2.0, ("band", "terminal_concentration", 0.12, 0.62, 0.35)), (0.75, ("band", "positive_day_ratio_60", 0.50, 0.68, 0.14)),
        ],
        "findings": [
            ("prior_return_60_ex_last_10", "<=", 0), ("volatility_20", ">=", 0.055), ("largest_up_day_share_20", ">=", 0.55),
            ("range_staleness_60", ">=", 0.80), ("weakest_full_rise", "<=", 0),
        ],
    },
    "healthy": {
        "penalty": 0.20,
        "terms": [
            (1.5, ("band", "return_119", 0.20, 0.72, 0.22)), (1.0, ("band", "return_60", 0.10, 0.38, 0.16)),
            (1.75, ("ramp", "prior_return_60_ex_last_10", 0.06, 0.22)), (2.0, ("ramp", "trend_fit_120", 0.55, 0.86)),
            (1.25, ("ramp", "trend_fit_60", 0.55, 0.86)), (3.5, ("fall", "max_drawdown_120", 0.075, 0.145)),
            (2.5, ("fall", "max_drawdown_60", 0.055, 0.12)), (2.0, ("ramp", "worst_return_10", -0.13, -0.045)),
            (1.25, ("fall", "volatility_20", 0.022, 0.040)), (1.25, ("fall", "volatility_60", 0.024, 0.042)),
            (1.0, ("fall", "largest_up_day_share_20", 0.24, 0.45)), (1.0, ("band", "ma20_extension", -0.02, 0.085, 0.07)),
            (1.5, ("band", "terminal_concentration", 0.08, 0.55, 0.25)), (1.5, ("ramp", "anchor_up_ratio", 0.55, 0.82)),
            (1.0, ("ramp", "ma_alignment", 0.72, 1.0)),
        ],
        "findings": [
            ("max_drawdown_120", ">", 0.145), ("max_drawdown_60", ">", 0.12), ("worst_return_10", "<", -0.13), ("return_119", "<", 0.18),
            ("trend_fit_120", "<", 0.50), ("prior_return_60_ex_last_10", "<", 0.04), ("terminal_concentration", ">", 0.68), ("volatility_60", ">", 0.045),
        ],
    },
    "breakout": {
        "penalty": 0.20,
        "terms": [
            (3.0, ("raw", "freshness")), (3.0, ("raw", "setup_quality")), (5.0, ("raw", "transition_quality")), (4.0, ("raw", "not_uptrend")),
            (2.5, ("ramp", "breakout_hold_margin", -0.018, 0.015)), (2.5, ("band", "breakout_current_margin", 0.004, 0.085, 0.06)),
            (2.0, ("fall", "breakout_post_event_drawdown", 0.02, 0.085)), (2.0, ("raw", "structure_quality")),
            (0.75, ("ramp", "breakout_vs_prior_60", -0.14, 0.018)), (0.75, ("ramp", "range_position_120", 0.50, 0.96)),
            (0.5, ("ramp", "old_high_gap_120", -0.25, 0.025)), (1.5, ("band", "breakout_day_return", 0.015, 0.095, 0.075)),
            (1.0, ("band", "breakout_volume_ratio", 0.95, 2.60, 1.60)), (1.25, ("band", "breakout_approach_return_5", -0.025, 0.10, 0.09)),
            (0.75, ("band", "breakout_approach_positive_ratio_10", 0.40, 0.80, 0.30)), (1.0, ("fall", "pre_breakout_volatility_20", 0.025, 0.052)),
            (1.25, ("fall", "largest_up_day_share_20", 0.34, 0.65)), (1.5, ("ramp", "breakout_contrast", 1.2, 3.5)),
        ],
        "findings": [
            ("breakout_age", ">", 15), ("breakout_current_margin", "<", -0.015), ("breakout_hold_margin", "<", -0.03),
            ("breakout_post_event_drawdown", ">", 0.10), ("breakout_day_return", ">", 0.15), ("breakout_day_return", "<", -0.02),
            ("pre_breakout_volatility_20", ">", 0.065), ("largest_up_day_share_20", ">", 0.75), ("breakout_resistance_window", "<", 20),
            ("pre_breakout_context_bars", "<", 35), ("setup_quality", "<", 0.40), ("transition_quality", "<", 0.40), ("not_uptrend", "<", 1),
        ],
    },
    "pullback": {
        "penalty": 0.20,
        "terms": [
            (2.5, ("band", "prior_advance_before_peak", 0.16, 0.55, 0.25)), (2.5, ("band", "drawdown_60", 0.018, 0.105, 0.075)),
            (3.0, ("band", "recent_pullback_depth_40", 0.035, 0.13, 0.075)), (2.0, ("band", "recent_pullback_low_age", 2.0, 12.0, 8.0)),
            (2.5, ("band", "recent_recovery_fraction", 0.28, 1.02, 0.35)), (1.5, ("band", "pullback_duration_60", 3.0, 16.0, 10.0)),
            (1.5, ("fall", "pullback_speed_60", 0.010, 0.030)), (2.0, ("band", "retracement_of_prior_advance", 0.12, 0.48, 0.28)),
            (2.0, ("ramp", "worst_5day_return_20", -0.13, -0.045)), (3.0, ("ramp", "turn_confirmation", 0.48, 0.86)),
            (1.5, ("band", "return_3", 0.008, 0.065, 0.055)), (1.25, ("band", "return_5", 0.012, 0.10, 0.075)),
            (1.25, ("band", "rebound_from_10_low", 0.018, 0.10, 0.075)), (1.0, ("band", "ma10_extension", -0.015, 0.065, 0.06)),
            (1.5, ("band", "trend_slope_60", 0.04, 0.42, 0.25)), (1.0, ("fall", "range_staleness_60", 0.42, 0.75)),
            (1.5, ("fall", "max_drawdown_120", 0.12, 0.24)),
        ],
        "findings": [
            ("prior_advance_before_peak", "<", 0.12), ("drawdown_60", ">", 0.18), ("recent_pullback_depth_40", "<", 0.025),
            ("recent_pullback_depth_40", ">", 0.18), ("recent_pullback_low_age", ">", 18), ("recent_recovery_fraction", "<", 0.15),
            ("recent_recovery_fraction", ">", 1.25), ("retracement_of_prior_advance", ">", 0.65), ("pullback_duration_60", ">", 27),
            ("worst_5day_return_20", "<", -0.14), ("turn_confirmation", "<", 0.40), ("return_3", "<", -0.02), ("trend_slope_60", "<", -0.06),
            ("max_drawdown_120", ">", 0.27),
        ],
    },
}

# Feature weights of the three independent category scorers.
WEIGHTS = {
    "fresh_breakout": {
        "breakout_age": 2.5, "breakout_hold_margin": 2.5, "breakout_current_margin": 2.0, "breakout_post_event_drawdown": 2.0,
        "breakout_confirmed": 2.5, "breakout_day_return": 1.0, "breakout_volume_ratio": 1.0, "breakout_approach_return_5": 1.0,
        "breakout_approach_positive_ratio_10": 1.0, "pre_breakout_volatility_20": 0.75, "largest_up_day_share_20": 0.75,
        "breakout_vs_prior_20": 2.0, "breakout_vs_prior_60": 1.25, "old_high_rejection_count": 0.75, "trend_slope_60": 1.0,
        "trend_fit_60": 0.75, "ma20_extension": 1.0},
    "healthy_uptrend": {
        "return_20": 1.0, "return_60": 1.5, "return_119": 1.25, "trend_slope_20": 1.0, "trend_slope_60": 2.0, "trend_slope_120": 1.5,
        "trend_fit_20": 0.75, "trend_fit_60": 1.5, "trend_fit_120": 1.25, "ma20_extension": 0.75, "ma60_extension": 1.0, "ma_alignment": 1.5,
        "drawdown_60": 1.5, "drawdown_120": 1.25, "old_high_gap_120": 0.75, "days_since_old_high": 0.5, "old_high_rejection_count": 0.5,
        "range_staleness_60": 1.5},
    "pullback_strengthening": {
        "prior_advance_before_peak": 2.0, "drawdown_20": 1.25, "drawdown_60": 1.75, "pullback_duration_60": 1.5, "pullback_speed_60": 1.5,
        "worst_5day_return_20": 1.0, "retracement_of_prior_advance": 1.75, "turn_confirmation": 2.5, "return_3": 1.0, "return_5": 1.0,
        "rebound_from_10_low": 1.25, "ma10_extension": 0.75, "ma20_extension": 0.75, "trend_slope_60": 1.25, "trend_fit_60": 0.75,
        "range_staleness_60": 1.5},
}
CATEGORY_KEYS = tuple(WEIGHTS)

# Ceilings per category as (ceiling, code, message, groups); one group of which all hold is enough.
CAPS = {
    "fresh_breakout": [
        (0.75, "no_detectable_breakout", "no breakout within the last 15 bars", [[("breakout_age", ">=", 99)]]),
        (2.0, "breakout_day_ceiling", "breakout day not yet confirmed", [[("breakout_age", "=", 0)]]),
        (1.0, "breakout_stale", "breakout older than 15 bars", [[("breakout_age", ">", 15)]]),
        (0.75, "lost_breakout_level", "fell back below the level", [[("breakout_hold_margin", "<", -0.03)]]),
        (0.75, "post_breakout_weakness", "drawdown after the breakout too deep", [[("breakout_post_event_drawdown", ">", 0.12)]]),
        (1.0, "no_meaningful_structure_break", "no 20 or 60 bar structure broken",
         [[("breakout_vs_prior_20", "<", -0.03), ("breakout_vs_prior_60", "<", -0.05)]])],
    "healthy_uptrend": [
        (0.75, "non_rising_midterm_structure", "60 bar structure not rising", [[("trend_slope_60", "<=", 0), ("return_60", "<=", 0)]]),
        (1.0, "trend_drawdown_broken", "60 bar drawdown too deep", [[("drawdown_60", ">", 0.25)]]),
        (1.0, "stale_range", "moving sideways in a wide range", [[("range_staleness_60", ">", 0.85)]]),
        (1.25, "single_spike_distortion", "recent rise rests on one day", [[("largest_up_day_share_20", ">", 0.65)]])],
    "pullback_strengthening": [
        (0.75, "no_prior_advance", "no rise before the pullback", [[("prior_advance_before_peak", "<", 0.08)]]),
        (0.75, "pullback_too_deep", "pullback near or beyond the rise before it",
         [[("drawdown_60", ">", 0.30)], [("retracement_of_prior_advance", ">", 0.90)]]),
        (1.0, "pullback_too_long", "pullback turning into a range", [[("pullback_duration_60", ">", 40)]]),
        (0.75, "no_turn_confirmation", "no turn near the score date", [[("turn_confirmation", "<", 0.25)]]),
        (1.0, "pullback_too_fast", "deep and fast pullback of late", [[("worst_5day_return_20", "<", -0.18)]])],
}


def term(t: tuple) -> Column:
    kind, first, *p = t
    if kind in ("most", "least", "product", "ratio"):
        parts = [term(x) for x in (first, *p)]
        if kind in ("most", "least"):
            return (F.greatest if kind == "most" else F.least)(*parts)
        return reduce(Column.__mul__ if kind == "product" else Column.__truediv__, parts)
    if kind == "none":
        return flag(~reduce(Column.__or__, [_all([holds(x) for x in group]) for group in (first, *p)]))
    if kind == "value":
        return F.lit(float(first))
    c = F.col(first)
    if kind == "steps":
        out = F.lit(0.0)
        for low, high, start, slope in p:
            out = F.when(c.between(low, high), clamp(F.lit(float(start)) + (c - low) * slope)).otherwise(out)
        return out
    if kind == "ramp":
        return ramp(c, *p)
    if kind == "fall":
        return 1 - ramp(c, *p)
    if kind == "down":
        return ramp(-c, *p)
    if kind == "band":
        return band(c, *p)
    if kind == "in":
        return flag(c.between(*p))
    return F.abs(c) if kind == "abs" else c


def holds(finding: tuple) -> Column:
    name, op, limit = finding
    c, v = F.col(name), F.lit(float(limit))
    return {"<": c < v, "<=": c <= v, ">": c > v, ">=": c >= v, "=": c == v}[op]


def profile_scores(facts: DataFrame, keys: list[str]) -> DataFrame:
    """Long form: one row per window and calibration profile."""
    options = F.array(*[
        F.struct(F.lit(name).alias("profile"), mean_of([term(t) for t in terms]).alias("profile_score"))
        for name, terms in PROFILES.items()
    ])
    return facts.select(*keys, F.explode(options).alias("p")).select(*keys, "p.*")


# Rises before a breakout that count as an established trend, by bars looked back:
# return, slope and fit above these; the last two only while the transition is below the limit.
RISES = ((40, 0.06, 0.045, 0.70, None), (100, 0.08, 0.07, 0.60, None), (60, 0.10, 0.10, 0.50, 0.40), (100, 0.18, 0.15, 0.50, 0.40))


def _before(measure: str, bars: int) -> str:
    return f"pre_breakout_{measure}_{bars}"


def _rise(bars: int, gain: float, slope: float, fit: float, below: float | None) -> tuple:
    limits = (("return", gain), ("trend_slope", slope), ("trend_fit", fit))
    group = tuple((_before(measure, bars), ">", limit) for measure, limit in limits)
    return group if below is None else (("transition", "<", below), *group)


# Derived inputs of the priors, layer by layer; a layer may use those before it.
CONTEXT = (
    {
        "terminal_concentration": ("ratio", ("most", ("value", 0.0), ("raw", "return_20")), ("most", ("value", 0.05), ("raw", "return_119"))),
        "weakest_full_rise": ("least", ("raw", "trend_slope_120"), ("raw", "return_119")),
        "breakout_contrast": ("ratio", ("raw", "breakout_day_return"), ("most", ("value", 0.008), ("raw", "pre_breakout_volatility_20"))),
        "freshness": ("steps", "breakout_age", (0, 0, 0.72, 0.0), (1, 3, 1.0, 0.0), (4, 7, 0.82, -0.12), (8, 15, 0.38, -0.04)),
        "structure_quality": ("steps", "breakout_resistance_window", (20, 59, 0.72, 0.0), (60, 1e9, 1.0, 0.0)),
        "tilt": ("abs", _before("trend_slope", 40)),
        "decline": ("product", ("down", _before("return", 40), 0.05, 0.24), ("down", _before("trend_slope", 40), 0.04, 0.24)),
        **{f"rise_{n}": ("most", ("raw", _before("return", n)), ("raw", _before("trend_slope", n))) for n in (60, 100)},
    },
    {
        "pause": ("product", ("band", _before("return", 40), -0.12, 0.08, 0.10), ("fall", "tilt", 0.08, 0.22),
                  ("band", _before("range_width", 40), 0.05, 0.24, 0.16)),
        "reset": ("most", ("raw", "decline"), ("fall", "rise_100", 0.15, 0.30), ("fall", _before("range_position", 100), 0.70, 0.92),
                  ("ramp", _before("drawdown_from_high", 100), 0.04, 0.12)),
    },
    {
        "setup_quality": ("most", ("raw", "pause"), ("raw", "decline")),
        "transition": ("most", ("raw", "decline"), ("product", ("raw", "pause"), ("fall", "rise_60", 0.08, 0.18), ("raw", "reset"))),
    },
    {"not_uptrend": ("none", *[_rise(*row) for row in RISES])},
    {"transition_quality": ("least", ("raw", "transition"), ("steps", "not_uptrend", (0, 0, 0.20, 0.0), (1, 1, 1.0, 0.0)))},
)


def with_context(df: DataFrame) -> DataFrame:
    """The columns of ``CONTEXT``, a projection for each layer."""
    for layer in CONTEXT:
        df = df.withColumns({name: term(t) for name, t in layer.items()})
    return df


def prior_scores(df: DataFrame, priors: tuple[str, ...] = tuple(PRIORS)) -> DataFrame:
    """prior_<name> and clean_<name> for facts joined with path facts."""
    df = with_context(df)
    layer = {}
    for name in priors:
        spec = PRIORS[name]
        weight = sum(w for w, _ in spec["terms"])
        score = mean_of([F.lit(w) * term(t) for w, t in spec["terms"]]) * len(spec["terms"]) / weight
        broken = F.array(*[holds(f) for f in spec["findings"]])
        layer[f"_bad_{name}"] = F.size(F.filter(broken, lambda x: x))
        layer[f"_raw_{name}"] = score
    df = df.withColumns(layer)
    return df.withColumns({
        **{f"prior_{n}": F.when(F.col(f"_bad_{n}") > 0, F.col(f"_raw_{n}") * PRIORS[n]["penalty"]).otherwise(F.col(f"_raw_{n}")) for n in priors},
        **{f"clean_{n}": F.col(f"_bad_{n}") == 0 for n in priors},
    })


def long_facts(facts: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, category, feature, weight, value): the features each category scorer uses."""
    cells = F.array(*[
        F.struct(F.lit(c).alias("category"), F.lit(f).alias("feature"), F.lit(w).alias("weight"), F.col(f).alias("value"))
        for c, features in WEIGHTS.items() for f, w in features.items()
    ])
    return facts.select(*keys, F.explode(cells).alias("x")).select(*keys, "x.*")


def ceilings(facts: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, category, ceiling, hits, codes, messages): the lowest ceiling that applies, 3 when none does."""
    cells = []
    for category, rules in CAPS.items():
        hits = F.array_compact(F.array(*[
            F.when(
                reduce(Column.__or__, [_all([holds(c) for c in group]) for group in groups]),
                F.struct(F.lit(float(limit)).alias("limit"), F.lit(code).alias("code"), F.lit(message).alias("message")),
            )
            for limit, code, message, groups in rules
        ]))
        cells.append(F.struct(F.lit(category).alias("category"), hits.alias("hits")))
    rows = facts.select(*keys, F.explode(F.array(*cells)).alias("x")).select(*keys, "x.*")
    return rows.withColumns({
        "ceiling": F.coalesce(F.array_min("hits.limit"), F.lit(3.0)), "codes": F.col("hits.code"), "messages": F.col("hits.message"),
    }).withColumn("hits", F.size("hits"))


def _all(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


def squared(value: Column, median: Column, scale: Column) -> Column:
    d = (value - median) / scale
    return F.least(d * d, F.lit(64.0))


def category_scores(facts: DataFrame, model: DataFrame, scales: DataFrame, keys: list[str]) -> DataFrame:
    """Template distance, raw and capped score, and the five largest contributors per category.

    model   (category, feature, median, robust_scale)     scales  (category, distance_scale)
    """
    long = long_facts(facts, keys).join(model, ["category", "feature"])
    part = F.col("weight") * squared(F.col("value"), F.col("median"), F.col("robust_scale"))
    per = long.withColumn("contribution", part).groupBy(*keys, "category").agg(
        F.sqrt(F.sum("contribution") / F.sum("weight")).alias("distance"),
        F.slice(F.sort_array(F.collect_list(F.struct("contribution", "feature")), asc=False), 1, 5).alias("contributors"),
    )
    df = per.join(scales, "category").join(ceilings(facts, keys), [*keys, "category"])
    step = F.col("distance") / F.greatest(F.col("distance_scale"), F.lit(1e-6))
    df = df.withColumn("raw_score", clamp(3 * F.exp(-0.5 * step * step), 0.0, 3.0))
    return df.withColumn("score", F.least("raw_score", "ceiling"))
