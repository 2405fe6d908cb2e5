"""Page-stable adjustment, verdict rules, declared terms: known numbers."""

from __future__ import annotations

import datetime as dt
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from tapeloom.operators import bars as B
from tapeloom.operators import shape as S
from tapeloom.operators.verdicts import Rule, evaluate, evaluate_sql, one_row
from tapeloom.plans.sets import leader_removal
from tapeloom.plans.sql_terms import term_sql

START = dt.date(2024, 1, 1)


def series(spark, factors: dict, days: int = 40):
    """Bars of rising closes for each security, and its (day, factor or None) table."""
    bars, table = [], []
    for entity, known in factors.items():
        for d in range(days):
            close = 10.0 + d + entity
            bars.append((entity, START + dt.timedelta(d), close, close + 1, close - 1, close, 5.0, 50.0))
        table += [(entity, START + dt.timedelta(d), f) for d, f in known.items()]
    frame = spark.createDataFrame(bars, "entity long, bar_date date, open double, high double, low double, close double, volume double, amount double")
    return B.with_previous_close(frame), spark.createDataFrame(table, "entity long, bar_date date, adj_factor double")


def adjusted(pages, factors, mode="qfq", latest=39):
    rows = B.adjust_pages(pages, factors, F.lit(START + dt.timedelta(latest)), mode).collect()
    return {(r.entity, (r.bar_date - START).days): r for r in rows}


def gaps(seed: int) -> dict:
    r = random.Random(seed)
    return {d: (round(1 + d / 7, 3) if r.random() < 0.2 else None) for d in range(40)} | {0: 1.0}


@pytest.mark.parametrize("size", [1, 7, 13, 40])
def test_pages_put_together_equal_the_full_series(spark, size):
    bars, factors = series(spark, {1: gaps(1), 2: gaps(2), 3: {0: 2.0}})
    whole = adjusted(B.in_pages(bars, 1000), factors)
    parts = adjusted(B.in_pages(bars, size), factors)
    assert len(whole) == 120 and parts.keys() == whole.keys()
    for key, row in whole.items():
        for name in ("open", "high", "low", "close", "pre_close", "change", "pct_chg", "used"):
            assert parts[key][name] == row[name], (key, name)


def test_any_page_alone_equals_its_place_in_the_series(spark):
    bars, factors = series(spark, {1: gaps(3), 2: gaps(4)})
    whole = adjusted(B.in_pages(bars, 1000), factors)
    old = bars.where(F.col("bar_date").between(START + dt.timedelta(11), START + dt.timedelta(17))).withColumn("page", F.lit(0))
    for key, row in adjusted(old, factors).items():
        assert row.close == whole[key].close and row.pre_close == whole[key].pre_close


def test_known_numbers_of_a_page(spark):
    bars, factors = series(spark, {1: {0: 1.0, 20: 2.0}})
    got = adjusted(bars.withColumn("page", F.lit(0)), factors)
    assert got[1, 39].close == 50.0 and got[1, 19].close == 15.0 and got[1, 20].close == 31.0  # halved before the factor doubled
    assert got[1, 20].pre_close == 30.0 and got[1, 20].change == 1.0 and got[1, 20].pct_chg == 3.33
    hfq = adjusted(bars.withColumn("page", F.lit(0)), factors, "hfq")
    assert hfq[1, 19].close == 30.0 and hfq[1, 20].close == 62.0 and hfq[1, 20].used == "hfq"
    assert got[1, 0].warning == "factors end early: the last one goes on"


def test_a_security_without_factors_stays_raw_and_says_so(spark):
    bars, factors = series(spark, {1: {3: 2.0}, 2: {5: None}})
    got = adjusted(B.in_pages(bars, 10), factors)
    assert {r.used for (e, _), r in got.items() if e == 2} == {"raw"} and got[2, 7].close == 19.0 and got[2, 7].warning.startswith("no factor")
    # the oldest page of security 1 fills its leading gap backward
    assert got[1, 0].used == "qfq" and got[1, 0].close == 11.0


def test_missing_and_wrong_factors_are_error_rows(spark):
    bars, factors = series(spark, {1: {d: 1.0 for d in range(40)}, 2: {0: 1.0, 10: 1.5}, 3: {d: (-1.0 if d == 4 else 1.0) for d in range(40)}})
    found = {r.entity: r for r in B.adjustment_errors(B.attach_factors(bars, factors), F.lit(START + dt.timedelta(12))).collect()}
    assert sorted(found) == [2, 3]
    assert (found[2].error, found[2].n_missing, found[2].since) == ("missing factor", 2, START + dt.timedelta(11))
    assert (found[3].error, found[3].n_not_positive, found[3].since) == ("factor not positive", 1, START + dt.timedelta(4))


RULES = (
    Rule("one", "w", (("high", (("x", ">=", 0.8),)), ("middle", (("x", ">=", 0.5), ("y", "<", 2)))), "low", ("z",)),
    Rule("or", "w", (("yes", (("x", ">", 0.9),)), ("yes", (("y", "<=", 1),))), "no"),
    Rule("fixed", "w", otherwise="supported", evidence=("z",)),
)


@pytest.mark.parametrize(("x", "y", "z", "want"), [
    (0.8, 5.0, 1.0, ("high", "no", "supported")), (0.5, 1.9, None, ("middle", "no", "supported")), (0.5, 2.0, 0.0, ("low", "no", "supported")),
    (0.95, 9.0, 0.0, ("high", "yes", "supported")), (0.1, 1.0, 0.0, ("low", "yes", "supported")), (None, None, None, ("low", "no", "supported")),
])
def test_verdict_rules(spark, x, y, z, want):
    measures = spark.createDataFrame([("x", x), ("y", y), ("z", z), ("unused", 1.0)], "measure string, value double")
    rows = evaluate(one_row(measures, ["x", "y", "z"]), RULES).collect()
    assert tuple(next(r.decision for r in rows if r.id == rule.id) for rule in RULES) == want
    assert [(r.id, r.measure) for r in rows] == [("one", "x"), ("one", "y"), ("one", "z"), ("or", "x"), ("or", "y"), ("fixed", "z")]
    value = lambda v: "null::double" if v is None else f"{v!r}::double"
    sql = evaluate_sql(RULES, f"(select {value(x)} as x, {value(y)} as y, {value(z)} as z)")
    assert [tuple(r) for r in duckdb.sql(f"select id, decision, measure, value from ({sql})").fetchall()] == [(r.id, r.decision, r.measure, r.value) for r in rows]


@pytest.mark.parametrize(("t", "value", "want"), [
    (("steps", "x", (0, 0, 0.72, 0.0), (1, 3, 1.0, 0.0), (4, 7, 0.82, -0.12), (8, 15, 0.38, -0.04)), 6.0, 0.58),
    (("steps", "x", (0, 0, 0.72, 0.0), (8, 15, 0.38, -0.04)), 15.0, 0.10), (("steps", "x", (0, 0, 0.72, 0.0)), 99.0, 0.0),
    (("most", ("raw", "x"), ("value", 0.5)), 0.25, 0.5), (("least", ("raw", "x"), ("abs", "x")), -2.0, -2.0),
    (("product", ("raw", "x"), ("ramp", "x", 0.0, 4.0), ("value", 3)), 2.0, 3.0), (("ratio", ("value", 3), ("most", ("raw", "x"), ("value", 0.5))), 0.1, 6.0),
    (("none", (("x", ">", 1.0), ("x", "<", 3.0)), (("x", ">", 9.0),)), 2.0, 0.0), (("none", (("x", ">", 1.0), ("x", "<", 3.0)), (("x", ">", 9.0),)), 4.0, 1.0),
])
def test_terms_in_both_languages(spark, t, value, want):
    assert spark.createDataFrame([(value,)], "x double").select(S.term(t)).first()[0] == pytest.approx(want)
    assert duckdb.sql(f"select {term_sql(t)} from (select {value}::double as x)").fetchall()[0][0] == pytest.approx(want)


def test_context_by_hand(spark):
    fact = {
        "return_20": 0.1, "return_119": 0.02, "trend_slope_120": 0.3, "breakout_day_return": 0.04, "pre_breakout_volatility_20": 0.02, "breakout_age": 5.0,
        "breakout_resistance_window": 20.0, "pre_breakout_return_40": 0.0, "pre_breakout_trend_slope_40": -0.15, "pre_breakout_range_width_40": 0.32,
        "pre_breakout_trend_fit_40": 0.1, "pre_breakout_return_60": 0.10, "pre_breakout_trend_slope_60": 0.13, "pre_breakout_trend_fit_60": 0.1,
        "pre_breakout_return_100": 0.3, "pre_breakout_trend_slope_100": 0.2, "pre_breakout_trend_fit_100": 0.55,
        "pre_breakout_range_position_100": 0.92, "pre_breakout_drawdown_from_high_100": 0.08,
    }
    row = S.with_context(spark.createDataFrame([tuple(fact.values())], ", ".join(f"{c} double" for c in fact))).first()
    assert row.terminal_concentration == pytest.approx(2.0) and row.weakest_full_rise == 0.02 and row.breakout_contrast == pytest.approx(2.0)
    assert row.freshness == pytest.approx(0.70) and row.structure_quality == 0.72
    # pause: inside the band, half of the tilt, half of the soft edge; no decline, as the return did not fall
    assert row.pause == pytest.approx(0.25) and row.decline == 0.0 and row.setup_quality == pytest.approx(0.25)
    # reset: half of the drawdown; rise of 60 bars halves what is left
    assert row.reset == pytest.approx(0.5) and row.transition == pytest.approx(0.0625)
    # rise of 100 bars over all three limits while the transition is weak: an established trend
    assert row.not_uptrend == 0.0 and row.transition_quality == pytest.approx(0.0625)


def test_caps_name_what_they_found(spark):
    names = sorted({c for rules in S.CAPS.values() for *_, groups in rules for group in groups for c, *_ in group})
    calm = {"breakout_age": 2.0, "trend_slope_60": 0.1, "prior_advance_before_peak": 0.5, "turn_confirmation": 0.9}
    both = calm | {"drawdown_60": 0.5, "retracement_of_prior_advance": 0.95, "prior_advance_before_peak": 0.05}
    rows = [(i, *[d.get(n, 0.0) for n in names]) for i, d in enumerate((calm, both))]
    got = {(r.entity, r.category): r for r in S.ceilings(spark.createDataFrame(rows, "entity int, " + ", ".join(f"{n} double" for n in names)), ["entity"]).collect()}
    assert got[0, "pullback_strengthening"].hits == 0 and got[0, "pullback_strengthening"].ceiling == 3.0
    deep = got[1, "pullback_strengthening"]  # two ways to be too deep are one finding
    assert deep.codes == ["no_prior_advance", "pullback_too_deep"] and deep.hits == 2 and deep.ceiling == 0.75
    assert got[1, "healthy_uptrend"].codes == ["trend_drawdown_broken"] and got[1, "healthy_uptrend"].messages == ["60 bar drawdown too deep"]


def test_leaders_of_every_template_are_removed(spark):
    rows = [(t, START, code, e, score) for t in (1, 2) for code, scores in ((1, [0.9, 0.8, 0.75, 0.6]), (None, [0.95])) for e, score in enumerate(scores, 10 * (code or 9))]
    got = {(r.template_id, r.industry_code, r.without): r for r in leader_removal(spark.createDataFrame(rows, "template_id int, bar_date date, industry_code int, entity long, score double"), 0.7).collect()}
    assert len(got) == 8 and all(got[1, c, k][3:] == got[2, c, k][3:] for c in (1, None) for k in (1, 3))
    one, three = got[2, 1, 1], got[2, 1, 3]
    assert (one.eligible, one.above, one.top100, one.eligible_left, one.above_left, one.top100_left) == (4, 3, 4, 3, 2, 3)
    assert (three.eligible_left, three.above_left, three.above_rate_left) == (1, 0, 0.0) and got[1, None, 3].above_rate_left == 0.0
