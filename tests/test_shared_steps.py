"""Steps that parts of a query share are done once, with the results of the separate ones."""

from __future__ import annotations

import datetime as dt
import random

from pyspark.sql import functions as F

from tapeloom.functions import ranking
from tapeloom.operators import events, patterns
from tapeloom.operators import similarity as S
from tapeloom.plans import breadth, dynamics
from tapeloom.plans import patterns as plans_patterns
from tapeloom.plans.registry import QUERIES
from tapeloom.sources.tables import Market

FOLDER = "/root/testdata/sf0.001"
DAY = dt.date(2024, 1, 5)


def counted(monkeypatch, module, name: str) -> list:
    """Calls of a function of a module, as they come."""
    calls, real = [], getattr(module, name)
    monkeypatch.setattr(module, name, lambda *a, **k: (calls.append(a), real(*a, **k))[1])
    return calls


def test_verdicts_score_the_panel_once(spark, monkeypatch):
    rolling, latest = counted(monkeypatch, S, "rolling_scores"), counted(monkeypatch, S, "latest_scores")
    dynamics.verdict_measures(Market(spark, FOLDER))
    assert (len(rolling), len(latest)) == (1, 1)


def test_events_of_few_windows_equal_those_of_any(spark):
    r = random.Random(8)
    days = [DAY + dt.timedelta(7 * d) for d in range(40)]
    bars = [(e, d, round(10 * r.uniform(0.8, 1.25), 3)) for e in range(4) for d in days if r.random() < 0.8 or d in (days[0], days[-1])]
    frame = spark.createDataFrame(bars, "entity long, bar_date date, close double")
    cal = spark.createDataFrame([(d, i) for i, d in enumerate(days)], "bar_date date, ord int")
    own = {e: sorted(d for x, d, _ in bars if x == e) for e in range(4)}
    windows = [(t, e, own[e][-n], own[e][-1]) for t, n in ((1, 3), (2, 12), (3, 16)) for e in range(4)]
    asked = spark.createDataFrame(windows, "template_id int, entity long, start_date date, end_date date")
    names = ["template_id", "entity", "up_count", "down_count", "suspension_count", "max_abs_pct"]
    few = events.events_of_few(asked, events.bar_events(frame, cal)).select(*names).collect()
    any_ = events.window_events(asked, events.limit_flags(frame), events.suspended_weeks(frame, cal), 16).select(*names).collect()
    assert sorted(few) == sorted(any_) and len(few) == len(windows)
    assert any(x.suspension_count for x in few)


def test_detail_documents_score_once(spark, monkeypatch):
    rolling = counted(monkeypatch, S, "rolling_scores")
    breadth.detail_documents(Market(spark, FOLDER))
    assert len(rolling) == 1


def test_newest_days_of_an_industry_equal_the_whole_table(spark):
    m = Market(spark, FOLDER)
    newest = m.cal.agg({"ord": "max"}).first()[0]
    whole, some = breadth.industry_daily(m), breadth.industry_daily(m, 30)
    names = sorted(whole.columns)
    expected = [r for r in whole.select(*names).collect() if r.ord > newest - 30]
    assert expected and sorted(expected) == sorted(some.select(*names).collect())


def test_threshold_view_scores_once(spark, monkeypatch):
    rolling = counted(monkeypatch, S, "rolling_scores")
    QUERIES["thr_view"].build(Market(spark, FOLDER))
    assert len(rolling) == 1


def test_matches_of_several_days_equal_those_of_each(spark):
    m = Market(spark, FOLDER)
    days = sorted(r.bar_date for r in m.cal.collect())
    asked = {"a": days[-2], "b": days[-12], "c": days[90], "d": days[30]}
    names = ["entity", "bar_date", "close", "n_past", "status", "matches", "primary"]
    got = patterns.matches_on(m.bars0, {k: F.lit(d) for k, d in asked.items()}).select("day", *names).collect()
    for key, day in asked.items():
        each = patterns.latest_matches(m.bars0.where(F.col("bar_date") <= day)).select(*names).collect()
        assert each and sorted(tuple(r)[1:5] for r in got if r.day == key) == sorted(tuple(r)[:4] for r in each)
        assert {r.entity: r.matches for r in got if r.day == key} == {r.entity: r.matches for r in each}


def test_runs_of_a_history_share_one_pass(spark, monkeypatch):
    passes = counted(monkeypatch, patterns, "pattern_scores")
    plans_patterns.run_history(Market(spark, FOLDER))
    assert len(passes) == 1


def test_rank_shares_join_no_rows_and_hold_for_any_split(spark, monkeypatch):
    r = random.Random(3)
    rows = [(g, i, r.choice([None, 1.0, 1.0, 1.0, round(r.uniform(0, 3), 2)])) for g in ("a", "b") for i in range(400)]
    df = spark.createDataFrame(rows, "g string, id int, v double")
    plan = ranking.average_rank_share(df, ["g"], "v", "p")._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan
    expected = {}
    for g in ("a", "b"):
        known = [v for x, _, v in rows if x == g and v is not None]
        for _, i, v in (x for x in rows if x[0] == g):
            expected[g, i] = None if v is None else (sum(k < v for k in known) + (known.count(v) + 1) / 2) / len(known)
    for limit in (1 << 16, 50):
        monkeypatch.setattr(ranking, "RANGE_ROWS", limit)
        assert {(x.g, x.id): x.p for x in ranking.average_rank_share(df, ["g"], "v", "p").collect()} == expected
