"""Small hand-made frames with known numbers, and brute-force twins."""

from __future__ import annotations

import datetime as dt
import hashlib
import hmac
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tapeloom.functions import ranking
from tapeloom.functions.ranking import average_rank_share, exact_quantiles, order_positions, prefix_share
from tapeloom.operators import bars as B
from tapeloom.operators import calendar as C
from tapeloom.functions.scalars import padded
from tapeloom.operators import dynamics, events, flows, metrics, rotation, runs, sampling
from tapeloom.operators import facts as X
from tapeloom.operators import similarity as S
from tapeloom.operators.asof import as_of_samples, sampled_span
from tapeloom.operators.selection import fill_quotas
from tapeloom.plans import similarity as sim
from tapeloom.plans.relational import pair_counts
from tapeloom.sources import store, tables
from tapeloom.sources.tables import Market

DAY = dt.date(2025, 1, 1)
BAR = "entity long, bar_date date, open double, high double, low double, close double, volume double, amount double"


def day(i: int) -> dt.date:
    return DAY + dt.timedelta(days=i)


def bars_of(spark, closes: dict[int, list[float]]):
    rows = [(e, day(i), c, c * 1.01, c * 0.99, c, 100.0, c * 100) for e, cs in closes.items() for i, c in enumerate(cs)]
    return spark.createDataFrame(rows, BAR)


def test_forward_adjustment_halves_old_price(spark):
    raw = spark.createDataFrame([(1, day(0), 10.0, 1.0), (1, day(1), 20.0, 2.0)], "entity long, bar_date date, close double, adj_factor double")
    got = B.adjust_prices(raw, "batch_qfq", ("close",)).orderBy("bar_date").collect()
    assert [r.close for r in got] == [5.0, 20.0]


def test_normalize_repairs_and_deduplicates(spark):
    rows = [
        (1, "2026-01-02", 1, "10", "9", "12", "11", "5", "1"),
        (1, "20260102", 2, "10", "9", "12", "11.5", "-5", None),
        (1, "20260103", 3, None, "9", "12", "11", "5", "1"),
        (1, "bad", 4, "10", "9", "12", "11", "5", "1"),
    ]
    raw = spark.createDataFrame(rows, "entity long, trade_date string, ingest int, open string, high string, low string, close string, volume string, amount string")
    got = B.normalize_bars(raw).collect()
    assert len(got) == 1
    r = got[0]
    assert (r.bar_date, r.close, r.high, r.low, r.volume, r.amount) == (dt.date(2026, 1, 2), 11.5, 12.0, 9.0, 0.0, 0.0)


def test_resample_quarter_and_year(spark):
    rows = [
        (1, dt.date(2025, 12, 30), 9.0, 10.0, 8.0, 9.5, 9.0, 1.0, 1.0), (1, dt.date(2026, 1, 5), 12.0, 13.0, 11.0, 12.5, 9.5, 3.0, 1.0),
        (1, dt.date(2026, 3, 31), 13.0, 14.0, 12.0, 13.5, 12.5, 4.0, 1.0), (1, dt.date(2026, 7, 2), 14.0, 15.0, 13.0, 14.5, 13.5, 5.0, 1.0),
    ]
    df = spark.createDataFrame(rows, "entity long, bar_date date, open double, high double, low double, close double, pre_close double, volume double, amount double")
    q = {r.bucket: r for r in B.resample_bars(df, "1q").collect()}
    first = q[dt.date(2026, 1, 1)]
    assert (first.open, first.high, first.low, first.close, first.volume) == (12.0, 14.0, 11.0, 13.5, 7.0)
    assert B.resample_bars(df, "1y").count() == 2


def test_rolling_scores_match_brute_force_across_batches(spark):
    rng = np.random.default_rng(1)
    closes = {e: np.exp(np.cumsum(rng.normal(0, 0.02, n)) + 2).tolist() for e, n in ((1, 40), (2, 9), (3, 31), (4, 12))}
    closes[5] = [7.0] * 15
    book = S.TemplateBook(((7, tuple(z(closes[1][:10]))), (9, tuple(z(closes[3][:4])))))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = {(r.template_id, r.entity, r.bar_date): r.score for r in S.rolling_scores(bars_of(spark, closes), book).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = {}
    for key, t in book.templates:
        for e, cs in closes.items():
            for i in range(len(t) - 1, len(cs)):
                x = np.log(cs[i - len(t) + 1 : i + 1])
                want[(key, e, day(i))] = 0.0 if x.std() <= 1e-12 else float(np.mean((x - x.mean()) / x.std() * np.array(t)))
    assert got.keys() == want.keys()
    assert max(abs(got[k] - want[k]) for k in want) < 1e-9
    assert abs(got[(7, 1, day(9))] - 1) < 1e-9


def z(values):
    x = np.log(values)
    return ((x - x.mean()) / x.std()).tolist()


def test_latest_scores_skip_flat_and_short(spark):
    closes = {1: [float(x) for x in range(10, 22)], 2: [5.0] * 12, 3: [1.0, 2.0], 4: [float(x) for x in range(30, 18, -1)]}
    book = S.TemplateBook(((1, tuple(z(closes[1][-6:]))),))
    got = {r.entity: r.score for r in S.latest_scores(bars_of(spark, closes), book, F.lit(day(11))).collect()}
    assert set(got) == {1, 4}
    assert abs(got[1] - 1) < 1e-12 and got[4] < 0


@pytest.mark.parametrize("rows_of_a_window", [1 << 16, 100])
def test_ranks_and_quantiles_with_a_hot_value(spark, monkeypatch, rows_of_a_window):
    monkeypatch.setattr(ranking, "RANGE_ROWS", rows_of_a_window)
    random.seed(3)
    rows = [("a", 5.0 if i % 3 == 0 else random.choice([1.0, 2.5, random.random() * 100]), i) for i in range(3000)]
    rows += [("b", float(i), i) for i in range(7)]
    pdf = pd.DataFrame(rows, columns=["g", "v", "id"])
    df = spark.createDataFrame(rows, "g string, v double, id long")
    got = average_rank_share(df, ["g"], "v", "p").toPandas().sort_values(["g", "id"])
    want = pdf.assign(p=pdf.groupby("g")["v"].rank(pct=True, method="average")).sort_values(["g", "id"])
    assert np.allclose(got["p"], want["p"])
    q = exact_quantiles(df, ["g"], "v", {"q10": 0.1, "q50": 0.5, "q99": 0.99}).toPandas().set_index("g")
    for name, p in (("q10", 0.1), ("q50", 0.5), ("q99", 0.99)):
        for g, part in pdf.groupby("g"):
            assert abs(q.loc[g, name] - np.quantile(part["v"], p)) < 1e-9
    order = order_positions(df, ["g"], "v", ["id"]).toPandas().sort_values(["g", "rank"])
    expect = pdf.sort_values(["g", "v", "id"], ascending=[True, False, True])
    assert order["id"].tolist() == expect["id"].tolist()
    assert order.groupby("g")["rank"].apply(list).map(lambda r: r == list(range(1, len(r) + 1))).all()


@pytest.mark.parametrize("tie", ["id long", "id string"])
def test_one_value_spreads_over_many_windows(spark, monkeypatch, tie):
    monkeypatch.setattr(ranking, "RANGE_ROWS", 100)
    name = str if tie.endswith("string") else int
    rows = [("a", 5.0 if i % 10 else float(i), name(i * 7919 % 2000)) for i in range(2000)]
    df = spark.createDataFrame(rows, f"g string, v double, {tie}")
    ranged = ranking._with_part(ranking._with_range(ranking.stage(df), ["g"], "v", 20), ["g"], "id")
    assert ranged.groupBy("g", "_range", "_part").count().agg(F.max("count")).first()[0] <= 250
    for falling in (True, False):
        got = [r.id for r in order_positions(df, ["g"], "v", ["id"], descending=falling).orderBy("rank").collect()]
        assert got == [r[2] for r in sorted(rows, key=lambda r: (-r[1] if falling else r[1], r[2]))]


def test_prefix_shares_equal_brute_force(spark):
    r = random.Random(4)
    rows = [(g, i * 3, r.randrange(9)) for g, n in (("a", 1), ("b", 2), ("c", 70), ("d", 129)) for i in range(n)]
    got = {(x.g, x.o): x.p for x in prefix_share(spark.createDataFrame(rows, "g string, o int, v int"), ["g"], "o", "v", "p").collect()}
    for g, o, v in rows:
        past = [w for h, q, w in rows if h == g and q <= o]
        assert got[g, o] == sum(w <= v for w in past) / len(past)
    assert len(got) == len(rows)


def test_window_events_equal_brute_force(spark):
    r = random.Random(6)
    bars = [(e, DAY + dt.timedelta(d), round(10 * r.uniform(0.8, 1.25), 3)) for e in (1, 2) for d in range(40)]
    frame = spark.createDataFrame(bars, "entity long, bar_date date, close double")
    windows = [(e, DAY + dt.timedelta(a), DAY + dt.timedelta(b)) for e in (1, 2) for a in range(40) for b in range(a, min(a + 17, 40))]
    limits = events.limit_flags(frame)
    gaps = limits.select("entity", "bar_date", F.lit(0).alias("gap"))
    got = events.window_events(spark.createDataFrame(windows, "entity long, start_date date, end_date date"), limits, gaps, 17).collect()
    move = {(x.entity, x.bar_date): x for x in limits.collect()}
    assert len(got) == len(windows)
    for x in got:
        inside = [v for (e, d), v in move.items() if e == x.entity and x.start_date <= d <= x.end_date]
        assert (x.up_count, x.down_count) == (sum(v.up for v in inside), sum(v.down for v in inside))
        assert x.max_abs_pct == max((v.abs_pct for v in inside if v.abs_pct is not None), default=None)


def test_pair_counts_equal_all_pairs(spark):
    random.seed(5)
    rows = [("x", random.randint(0, 3), float(random.randint(0, 9)), i) for i in range(80)]
    got = pair_counts(spark.createDataFrame(rows, "category string, rating int, score double, sample_id long")).collect()[0]
    pairs = [(a, b) for a in rows for b in rows if a[1] > b[1]]
    assert got.comparable == len(pairs)
    assert got.concordant == sum(a[2] > b[2] for a, b in pairs)
    assert got.tied == sum(a[2] == b[2] for a, b in pairs)


def test_strata_match_near_equal_split(spark):
    for n in (5, 8, 10, 3):
        df = spark.range(1, n + 1).select(metrics.stratum(F.col("id"), F.lit(n)).alias("s"), "id").orderBy("id")
        want = [k + 1 for k, part in enumerate(np.array_split(np.arange(n), 4)) for _ in part]
        assert [r.s for r in df.collect()] == want


def test_hmac_and_splits(spark):
    secret = b"key"
    df = spark.createDataFrame([(str(i),) for i in range(50)], "k string")
    got = df.select("k", sampling.hmac_sha256(secret, F.col("k")).alias("h"), sampling.hash_split(F.col("k")).alias("s")).collect()
    for r in got:
        assert r.h == hmac.new(secret, r.k.encode(), hashlib.sha256).hexdigest()
        pos = int(hashlib.sha256(r.k.encode()).hexdigest(), 16) / 2**256
        assert r.s == ("template" if pos < 0.5 else "tuning" if pos < 0.75 else "final_evaluation")
    groups = spark.range(1, 25).select(F.col("id").alias("rank"), F.lit(24).alias("n"))
    counts = {r.split: r["count"] for r in sampling.grouped_split(groups, "rank", "n").groupBy("split").count().collect()}
    assert counts == {"template": 12, "tuning": 6, "final_evaluation": 6}


def test_quota_filling_equals_greedy_loop(spark):
    random.seed(2)
    rows = [(p, e, e % 5, round(random.random(), 1)) for p in ("a", "b") for e in range(20)]
    got = {(r.profile, r.entity) for r in fill_quotas(spark.createDataFrame(rows, "profile string, entity long, grp long, profile_score double"), {"a": 2, "b": 3}).collect()}
    want, used = set(), set()
    for profile, quota in (("a", 2), ("b", 3)):
        ranked = sorted((r for r in rows if r[0] == profile), key=lambda r: (-r[3], hashlib.sha256(str(r[1]).encode()).hexdigest()))
        left = quota
        for _, e, g, _s in ranked:
            if g not in used and left:
                want.add((profile, e)), used.add(g)
                left -= 1
    assert got == want


def test_rotation_slope_and_persistence(spark):
    def row(code, counts):
        full = [0] * 20 + counts
        return [(code, f"i{code}", i, n) for i, n in enumerate(full)]

    cells = spark.createDataFrame(row(1, [0, 1, 2, 3]) + row(2, [8, 6, 4, 2]) + row(3, [0, 2, 1, 3]) + row(4, [5, 5, 5, 5]), "industry_code int, industry string, sample int, n long")
    got = {r.industry_code: (r.slope, r.persistence) for r in rotation.features(cells).collect()}
    assert got == {1: (1.0, 1.0), 2: (-2.0, 1.0), 3: (0.8, 0.67), 4: (0.0, 0.0)}


def test_as_of_samples_carry_forward(spark):
    df = spark.createDataFrame([(1, 0, "a"), (1, 3, "b"), (1, 11, "c"), (2, 9, "d")], "entity long, ord int, v string")
    got = {(r.entity, r.sample): r.v for r in as_of_samples(df, F.lit(4), 5, 3, ["v"]).collect()}
    assert got == {(1, 0): "b", (1, 1): "b", (1, 2): "c", (2, 1): "d", (2, 2): "d"}


def test_flow_identities_on_a_hot_group(spark):
    random.seed(4)
    rows = [("hot" if e % 3 else "cold", o, e) for o in range(6) for e in random.sample(range(60), 30)]
    members = spark.createDataFrame(rows, "g string, ord int, entity long")
    got = {(r.g, r.ord): r for r in flows.flows_to_last_seen(members.select("g", "ord").distinct(), members, ["g"]).collect()}
    for g in ("hot", "cold"):
        before: set = set()
        for o in range(6):
            now = {e for gg, oo, e in rows if gg == g and oo == o}
            r = got[(g, o)]
            assert (r.new_count, r.retained_count, r.exit_count) == (len(now - before), len(now & before), len(before - now))
            before = now


def test_weak_duration_state_machine(spark):
    random.seed(6)
    rows = [(1, i, random.random() < 0.6, random.random() < 0.4) for i in range(200)]
    df = spark.createDataFrame(rows, "k int, i int, a boolean, t boolean")
    got = [r.weak_duration for r in runs.weak_duration(F.col("a"), F.col("t"), ["k"], "i", df).orderBy("i").collect()]
    want, start = [], None
    for _, i, a, t in rows:
        start = None if not a else (start if start is not None else (i if t else None))
        want.append(i - start + 1 if start is not None else 0)
    assert got == want


def test_ranking_document_is_rejected_on_any_mismatch(spark, tmp_path):
    items = [{"rank": i, "entity": i, "score": 1 - i / 100, "end_date": "20250101", "window_bars": 50} for i in range(1, 4)]
    good = {"template_id": "ok", "algorithm": store.ALGORITHM, "as_of": "20250101", "items": items}
    bad = [
        {**good, "template_id": "algo", "algorithm": "x"}, {**good, "template_id": "date", "as_of": "20240101"},
        {**good, "template_id": "short", "items": items[:2]}, {**good, "template_id": "order", "items": [{**items[0], "score": 0.1}, *items[1:]]},
        {**good, "template_id": "dup", "items": [items[0], {**items[1], "entity": 1}, items[2]]},
    ]
    import json

    path = tmp_path / "r.json"
    path.write_text("\n".join(json.dumps(d) for d in [good, *bad]))
    got = store.read_rankings(spark, str(path), F.lit("20250101"), 3)
    assert {r.template_id for r in got.collect()} == {"ok"} and got.count() == 3


def test_rotation_samples_are_every_fifth_of_the_last_120(spark):
    cal = spark.createDataFrame([(day(i), i) for i in range(130)], "bar_date date, ord int")
    got = [r.ord for r in C.rotation_samples(cal).orderBy("sample").collect()]
    assert got == list(range(14, 130, 5)) and len(got) == 24


def test_long_codes_are_not_cut(spark):
    rows = spark.createDataFrame([(1,), (999_999,), (1_000_001,)], "entity long")
    assert [r.c for r in rows.select(padded("entity").alias("c")).collect()] == ["000001", "999999", "1000001"]


def test_later_factor_does_not_fill_a_gap_as_of_a_day(spark):
    rows = [(1, day(0), 10.0, 1.0), (1, day(1), 20.0, 2.0), (1, day(2), 30.0, None), (1, day(3), 40.0, 8.0)]
    raw = spark.createDataFrame([(e, d, c, c, c, c, f) for e, d, c, f in rows],
                                "entity long, bar_date date, open double, high double, low double, close double, adj_factor double")
    got = {r.bar_date: r.close for r in B.adjust_as_of(raw, F.lit(day(2)).cast("date")).collect()}
    assert got == {day(0): 5.0, day(1): 20.0}  # the bar whose factor comes later is left out


def test_states_of_five_templates(spark):
    names = dynamics.state_names([1, 2, 3, 4, 5])
    st = spark.createDataFrame([("w", s, 1, t) for s, t in ((0, "t5"), (1, "t5"), (2, "none"))], "frequency string, seq int, entity long, state string")
    counts = {(r.seq, r.state): r["count"] for r in dynamics.state_counts(st.withColumn("bar_date", F.lit(None)), names).collect()}
    assert counts[(0, "t5")] == 1 and len({s for _, s in counts}) == 7
    moves = {(r.from_state, r.to_state): r["count"] for r in dynamics.transitions(st, names).collect()}
    assert moves[("t5", "t5")] == 1 and moves[("t5", "none")] == 1 and sum(moves.values()) == 2


def test_rotation_features_of_a_short_history(spark):
    cells = spark.createDataFrame([(7, "x", s, n) for s, n in enumerate([9, 9, 9, 9, 9, 9, 1, 2, 3, 4])], "industry_code long, industry string, sample int, n long")
    r = rotation.features(cells).first()
    assert (r.counts, r.slope, r.recent_change, r.effective, r.current_count) == ([1, 2, 3, 4], 1.0, 3, 4, 4)


def test_only_wanted_days_are_scored(spark):
    rng = random.Random(8)
    bars = bars_of(spark, {e: [rng.uniform(5, 15) for _ in range(40)] for e in (1, 2)})
    book = S.TemplateBook(((1, tuple(np.linspace(-1.5, 1.5, 12))),))
    full = {(r.entity, r.bar_date): r.score for r in S.rolling_scores(bars, book).collect()}
    days = spark.createDataFrame([(day(3),), (day(20),), (day(39),)], "bar_date date")
    some = {(r.entity, r.bar_date): r.score for r in S.rolling_scores(bars, book, days).collect()}
    assert some == {k: v for k, v in full.items() if k[1] in (day(20), day(39))}


def test_registry_blocks_equal_single_scores(spark, monkeypatch):
    monkeypatch.setattr(S, "TEMPLATE_BLOCK", 3)
    monkeypatch.setattr(S, "SECURITY_BLOCK", 4)
    r = random.Random(12)
    bars = [(e, DAY + dt.timedelta(d), 10 * r.uniform(0.5, 2)) for e in range(1, 14) for d in range(30 if e != 5 else 29)]
    bars = [(e, d, 0.0 if (e, (d - DAY).days) == (6, 25) else 7.0 if e == 7 else c) for e, d, c in bars]  # 5 ends early, 6 has a price of 0, 7 is flat
    z = lambda n: (lambda v: ((v - v.mean()) / v.std()).tolist())(np.array([r.random() for _ in range(n)]))
    registry = [(k, z(n)) for k, n in enumerate([8, 8, 12, 3, 30, 31, 8, 12, 20, 3, 4], 100)]
    frame = spark.createDataFrame(bars, "entity long, bar_date date, close double")
    books = spark.createDataFrame(registry, "template_id long, z array<double>")
    got = {(x.template_id, x.rank): (x.entity, x.score) for x in S.best_of_registry(frame, books, F.lit(DAY + dt.timedelta(29)), 4).collect()}
    want = {}
    for key, vector in registry:
        scored = []
        for e in range(1, 14):
            closes = [c for b, d, c in bars if b == e][-len(vector):]
            if e not in (5, 7) and len(closes) == len(vector) and min(closes) > 0:
                x = np.log(closes)
                scored.append((-float(np.dot(vector, x) / (len(x) * x.std())), e))
        want |= {(key, i): (e, -s) for i, (s, e) in enumerate(sorted(scored)[:4], 1)}
    assert got.keys() == want.keys() and len({k for k, _ in got}) == 10
    assert all(got[k][0] == want[k][0] and abs(got[k][1] - want[k][1]) < 1e-9 for k in want)
    assert S.best_of_registry(frame, books.limit(0), F.lit(DAY), 4).count() == 0


def test_registry_scores_copies_once_and_ties_go_to_the_smaller_security(spark, monkeypatch):
    monkeypatch.setattr(S, "SECURITY_BLOCK", 8)
    r = np.random.default_rng(5)
    own = {e: np.exp(r.normal(size=24)).tolist() for e in range(1, 8)}
    bars = [(e + 100 * copy, DAY + dt.timedelta(d), c) for e, closes in own.items() for copy in range(30) for d, c in enumerate(closes)]
    z = [((v - v.mean()) / v.std()).tolist() for v in (np.log(own[e]) for e in (3, 6, 3))]
    frame = spark.createDataFrame(bars, "entity long, bar_date date, close double")
    tails = frame.groupBy("entity").agg(F.sort_array(F.collect_list("close")).alias("closes"))
    once = {tuple(x.entities) for x in S.equal_windows(tails, 3).collect()}
    assert once == {(e, e + 100, e + 200) for e in own}
    books = spark.createDataFrame(list(enumerate(z, 1)), "template_id long, z array<double>")
    got = sorted((x.template_id, x.rank, x.entity) for x in S.best_of_registry(frame, books, F.lit(DAY + dt.timedelta(23)), 3).collect())
    assert got == [(t, i + 1, e + 100 * i) for t, e in ((1, 3), (2, 6), (3, 3)) for i in range(3)]


def test_screened_scores_equal_a_full_sort():
    r = np.random.default_rng(8)
    z, x = r.normal(size=(300, 9)), np.round(np.exp(0.02 * r.normal(size=(4500, 9))), 2)
    z[:20] *= 40  # not standardised: scores beyond 1 and -1 are cut there and tie
    entities, names = np.arange(4500) * 2 + 1, np.arange(300) * 3
    table = S.pa.table({"entity": r.permutation(entities), "closes": list(x)})
    got = S._block_scorer(3)(S.pa.table({"shape": names, "z": list(z)}), table).to_pydict()
    logs, who = np.log(np.stack(table.column("closes").to_pylist())), table.column("entity").to_numpy()
    sigma = logs.std(1)
    logs, who, sigma = logs[sigma > S.FLAT], who[sigma > S.FLAT], sigma[sigma > S.FLAT]
    scores = np.clip(np.einsum("ik,jk->ij", z, logs) / (9 * sigma), -1, 1)
    want = {(n, who[j]): scores[i, j] for i, n in enumerate(names) for j in np.lexsort((who, -scores[i].round(12)))[:3]}
    mine = dict(zip(zip(got["shape"], got["entity"]), got["score"]))
    assert len(mine) == 900
    for n in names:  # equal to the full sort but for windows that tie within rounding
        assert np.allclose(sorted(v for (t, _), v in mine.items() if t == n), sorted(v for (t, _), v in want.items() if t == n), atol=1e-12)


def test_backward_fill_reads_a_history_once(spark):
    rows = [(1, DAY + dt.timedelta(d), None if d % 3 else float(d)) for d in range(10)] + [(2, DAY, None), (2, DAY + dt.timedelta(1), 5.0)]
    filled = spark.createDataFrame(rows, "entity long, bar_date date, f double").withColumn("g", B.fill_backward("f"))
    got = {(r.entity, (r.bar_date - DAY).days): r.g for r in filled.collect()}
    assert got == {**{(1, d): float(-(-d // 3) * 3) for d in range(10)}, (2, 0): 5.0, (2, 1): 5.0}
    assert "FOLLOWING" not in filled._jdf.queryExecution().toString().upper()


def test_binned_quantiles_equal_a_full_sort(spark, monkeypatch):
    monkeypatch.setattr(ranking, "BINNED_ROWS", 20)
    ordered, real = [], ranking.value_positions
    monkeypatch.setattr(ranking, "value_positions", lambda df, *a: (ordered.append(df.count()), real(df, *a))[1])
    r = random.Random(4)
    groups = {
        "even": [r.uniform(-1, 1) for _ in range(900)], "ties": [float(r.randrange(4)) for _ in range(300)], "flat": [2.5] * 50,
        "far": [r.gauss(0, 1) for _ in range(200)] + [1e300, -1e300], "wide": [-1.7e308, 1.7e308, 0.0, 1.0, 2.0], "one": [7.0], None: [3.0, 1.0],
    }
    rows = [(k, v) for k, vs in groups.items() for v in vs] + [("even", None)]
    points = {"lo": 0.05, "mid": 0.5, "hi": 0.99, "first": 0.0, "last": 1.0}
    got = {x.k: x for x in exact_quantiles(spark.createDataFrame(rows, "k string, v double"), ["k"], "v", points).collect()}
    assert got.keys() == groups.keys()
    for k, vs in groups.items():
        for name, p in points.items():
            spot = (len(vs) - 1) * p
            low, high = (sorted(vs)[i] for i in (math.floor(spot), math.ceil(spot)))
            assert got[k][name] == pytest.approx(low + (high - low) * (spot - math.floor(spot)), rel=1e-12), (k, name)
    assert ordered[0] < 900  # not every row is ordered


def test_states_without_collected_lists(spark):
    rows = [("weekly", 0, DAY, e, t, q) for e, qs in {1: (0, 0, 0), 2: (0, 1, 0), 3: (1, 0, 1), 4: (1, 1, 1)}.items() for t, q in zip((2, 10, 1), qs)]
    st = dynamics.states(spark.createDataFrame(rows, "frequency string, seq int, bar_date date, entity int, template_id long, q int").withColumn("q", F.col("q") == 1), [1, 2, 10])
    assert {r.entity: (r.state, r.labels) for r in st.collect()} == {1: ("none", "none"), 2: ("t10", "t10"), 3: ("mixed", "t1+t2"), 4: ("mixed", "t1+t10+t2")}
    assert "collect_list" not in st._jdf.queryExecution().toString()


def test_scores_carry_columns_of_their_last_bar(spark):
    book = S.TemplateBook(((1, (-1.0, 0.0, 1.0)), (2, (1.0, -1.0))))
    bars = spark.createDataFrame([(e, DAY + dt.timedelta(d), 5.0 + d * e % 4, f"i{e}{d}", d % 2 == 0) for e in (1, 2) for d in range(6)],
                                 "entity long, bar_date date, close double, name string, open boolean")
    every = {(r.template_id, r.entity, r.bar_date): r.score for r in S.rolling_scores(bars, book).collect()}
    got = S.rolling_scores(bars, book, only=F.col("open"), carry=("name",)).collect()
    assert {(r.template_id, r.entity, r.bar_date): r.score for r in got} == {k: v for k, v in every.items() if (k[2] - DAY).days % 2 == 0}
    assert all(r.name == f"i{r.entity}{(r.bar_date - DAY).days}" for r in got)


def test_panel_rows_are_not_shuffled_again(spark):
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = sim.scores(Market(spark, "/root/testdata/sf0.001"), industry=True)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert "Exchange" not in plan[:plan.index("MapInArrow")]


def test_deepest_drawdown_in_one_pass(spark):
    r = random.Random(9)
    series = [[r.uniform(1, 2) for _ in range(40)] for _ in range(20)] + [[4.0, 2.0, 8.0, 4.0], [1.0, 2.0, 3.0], [5.0]]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(series)], "i int, c array<double>").select("i", X.deepest_drawdown(F.col("c")).alias("d"))
    for row in df.collect():
        falls = [1 - x / max(series[row.i][:k + 1]) for k, x in enumerate(series[row.i])]
        assert (row.d.worst, row.d["at"]) == (max(falls), falls.index(max(falls)))
    assert "array_append" not in df._jdf.queryExecution().toString()


def test_tasks_by_security_follow_the_rows(spark, monkeypatch):
    monkeypatch.setattr(tables, "TASK_ROWS", 100)
    m = Market(spark, "/root/testdata/sf0.001")
    rows = m.bars0.count()
    assert m.bars_by_security.rdd.getNumPartitions() == -(-rows // 100) and m.bars.rdd.getNumPartitions() == -(-rows // 100)
    assert m.bars.count() == rows


def test_window_arrays_are_taken_out_once(spark):
    rows = [(1, i + 1, DAY + dt.timedelta(i), 5.0 + i % 7, 6.0 + i % 7, 4.0 + i % 7, 100.0) for i in range(130)]
    bars = spark.createDataFrame(rows, "entity long, pos int, bar_date date, close double, high double, low double, volume double")
    facts = X.shared_facts(X.sliding_windows(bars, 15))
    plan = facts._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("w#") < 20 and facts.count() == 2


def test_sampled_span_keeps_what_samples_look_back_at(spark):
    rows = [(e, o) for e in (1, 2, 3) for o in range(60) if e == 1 or (e == 2 and o % 7 == 0) or (e == 3 and o > 30)]
    got = {}
    for r in sampled_span(spark.createDataFrame(rows, "entity int, ord int"), F.lit(20), 5, 4, 6).collect():
        got.setdefault(r.entity, []).append(r.ord)
    assert sorted(got[1]) == list(range(15, 36)) and sorted(got[2]) == [0, 7, 14, 21, 28, 35] and sorted(got[3]) == list(range(31, 36))
