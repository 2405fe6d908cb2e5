"""Window functions over bars, scores and daily series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.functions.ranking import average_rank_share, exact_quantiles, order_positions, prefix_share
from tapeloom.functions.scalars import strict
from tapeloom.operators import bars as B
from tapeloom.operators.calendar import rotation_samples, with_ordinal
from tapeloom.operators.runs import dwell_runs, sign_runs, streaks, weak_duration
from tapeloom.plans import similarity as sim
from tapeloom.plans.common import K, daily_top, ranked, scored
from tapeloom.plans.registry import query
from tapeloom.sources.tables import Market

def by_t():
    """Daily series of one template; one row per date, so bounded by the calendar."""
    return Window.partitionBy("template_id").orderBy("bar_date")


def series(m: Market, rows: DataFrame | None = None) -> DataFrame:
    """Daily market series per template: eligible and counts above the three fixed lines, of ``rows`` if scored already."""
    return (scored(m) if rows is None else rows).groupBy("template_id", "bar_date", "ord").agg(
        F.count(F.lit(1)).alias("eligible"),
        F.count_if(F.col("score") >= 0.70).alias("n70"),
        F.count_if(F.col("score") >= 0.75).alias("n75"),
        F.count_if(F.col("score") >= 0.80).alias("n80"),
    )


@query("win_rank_dense_order", "template_id:i bar_date:d entity:i rank:i", "select template_id, bar_date, entity, rank from ranked")
def _(m: Market) -> DataFrame:
    return ranked(m)


@query("win_rank_pct_avg", "bar_date:d entity:i pct:f",
       """select bar_date, entity, (rank() over (partition by bar_date order by v) + (count(*) over (partition by bar_date, v) - 1) / 2.0e0)
          / count(*) over (partition by bar_date) as pct from (select bar_date, entity, floor(volume / 50) as v from bars0)""")
def _(m: Market) -> DataFrame:
    df = m.bars0.select("bar_date", "entity", F.floor(F.col("volume") / 50).alias("v"))
    return average_rank_share(df, ["bar_date"], "v", "pct")


@query("win_percentile_from_rank", "template_id:i bar_date:d entity:i percentile:f",
       "select template_id, bar_date, entity, (n_group - rank + 1) * 100.0e0 / n_group as percentile from ranked")
def _(m: Market) -> DataFrame:
    n = F.col("n_group")
    return ranked(m).withColumn("percentile", (n - F.col("rank") + 1) / n * 100)


def quintile(position, total):
    """Q1..Q5 by first-come rank share; not ntile, whose group sizes differ."""
    return F.concat(F.lit("Q"), F.ceil(F.lit(5) * position / total).cast("string"))


@query("win_quintile", "bar_date:d entity:i quintile:s",
       """select bar_date, entity, 'Q' || cast(cast(ceil(5.0e0 * row_number() over (partition by bar_date order by total_mv, entity)
          / count(*) over (partition by bar_date)) as integer) as varchar) as quintile from caps""")
def _(m: Market) -> DataFrame:
    pos = order_positions(m.caps, ["bar_date"], "total_mv", ["entity"], descending=False)
    return pos.withColumn("quintile", quintile(F.col("rank"), F.col("n_group")))


def position_label(share):
    return F.when(share >= 2 / 3, "high").when(share <= 1 / 3, "low").otherwise("mid")


_POS = """(select *, (select count(*) from mkt h where h.template_id = k.template_id and h.ord <= k.ord and h.n70 <= k.n70) * 1.0e0
  / (select count(*) from mkt h where h.template_id = k.template_id and h.ord <= k.ord) as p from mkt k)"""


@query("win_expanding_position", "template_id:i bar_date:d p:f label:s",
       f"select template_id, bar_date, p, case when p >= 2/3.0e0 then 'high' when p <= 1/3.0e0 then 'low' else 'mid' end as label from {_POS}")
def _(m: Market) -> DataFrame:
    df = prefix_share(series(m), ["template_id"], "bar_date", "n70", "p")
    return df.withColumn("label", position_label(F.col("p")))


def weekly_p99(m: Market) -> DataFrame:
    return exact_quantiles(sim.scores(m).select("template_id", "bar_date", "score"), ["template_id", "bar_date"], "score", {"p99": 0.99})


@query("win_full_position", "template_id:i bar_date:d p:f",
       "select template_id, bar_date, cume_dist() over (partition by template_id order by floor(p99 * 1e9)) as p from mkt")
def _(m: Market) -> DataFrame:
    # One row per date: the partition is bounded by the calendar.
    w = Window.partitionBy("template_id").orderBy(F.floor(F.col("p99") * 1e9))
    return weekly_p99(m).withColumn("p", F.cume_dist().over(w))


@query("win_lag_diff", "template_id:i bar_date:d change_1:i change_5:i",
       "select template_id, bar_date, n70 - lag(n70) over w as change_1, n70 - lag(n70, 5) over w as change_5 from mkt window w as (partition by template_id order by bar_date)")
def _(m: Market) -> DataFrame:
    n = F.col("n70")
    return series(m).withColumn("change_1", n - F.lag("n70").over(by_t())).withColumn("change_5", n - F.lag("n70", 5).over(by_t()))


@query("win_moving_average", "template_id:i bar_date:d ma5:f",
       "select template_id, bar_date, avg(n70) over (partition by template_id order by bar_date rows between 4 preceding and current row) as ma5 from mkt")
def _(m: Market) -> DataFrame:
    return series(m).withColumn("ma5", F.avg("n70").over(by_t().rowsBetween(-4, 0)))


@query("win_chart_ma", "entity:i bar_date:d ma5:f ma10:f ma20:f ma60:f",
       "select entity, bar_date, " + ", ".join(
           f"case when count(*) over w{n} = {n} then avg(close) over w{n} end as ma{n}" for n in (5, 10, 20, 60)
       ) + " from bars0 window " + ", ".join(
           f"w{n} as (partition by entity order by bar_date rows between {n - 1} preceding and current row)" for n in (5, 10, 20, 60)))
def _(m: Market) -> DataFrame:
    df = m.bars0
    for n in (5, 10, 20, 60):
        df = df.withColumn(f"ma{n}", strict(F.avg("close"), "close", B.by_entity().rowsBetween(1 - n, 0), n))
    return df


@query("win_rolling_strict", "entity:i bar_date:d mean20:f median20:f sum20:f",
       """select entity, bar_date, case when count(x) over w = 20 then avg(x) over w end as mean20,
          case when count(x) over w = 20 then quantile_cont(x, 0.5) over w end as median20, case when count(x) over w = 20 then sum(x) over w end as sum20
          from (select *, lag(close) over (partition by entity order by bar_date) as x from bars0)
          window w as (partition by entity order by bar_date rows between 19 preceding and current row)""")
def _(m: Market) -> DataFrame:
    df = m.bars0.withColumn("x", F.lag("close").over(B.by_entity()))
    w = B.by_entity().rowsBetween(-19, 0)
    return (
        df.withColumn("mean20", strict(F.avg("x"), "x", w, 20))
        .withColumn("median20", strict(F.expr("percentile(x, 0.5)"), "x", w, 20))
        .withColumn("sum20", strict(F.sum("x"), "x", w, 20))
    )


@query("win_shifted_mean", "entity:i bar_date:d before:f before15:f",
       """select entity, bar_date, case when count(*) over a = 5 then avg(close) over a end as before, case when count(*) over b = 15 then avg(close) over b end as before15
          from bars0 window a as (partition by entity order by bar_date rows between 9 preceding and 5 preceding),
            b as (partition by entity order by bar_date rows between 19 preceding and 5 preceding)""")
def _(m: Market) -> DataFrame:
    w = B.by_entity()
    return m.bars0.withColumn("before", strict(F.avg("close"), "close", w.rowsBetween(-9, -5), 5)).withColumn(
        "before15", strict(F.avg("close"), "close", w.rowsBetween(-19, -5), 15)
    )


@query("win_rolling_reference", "template_id:i bar_date:d reference:f",
       "select template_id, bar_date, quantile_cont(p99, 0.75) over (partition by template_id order by bar_date rows between 26 preceding and 1 preceding) as reference from mkt")
def _(m: Market) -> DataFrame:
    return weekly_p99(m).withColumn("reference", F.expr("percentile(p99, 0.75)").over(by_t().rowsBetween(-26, -1)))


@query("win_recent_slope", "template_id:i bar_date:d slope:f",
       """select template_id, bar_date, regr_slope(n70, ord) over w as slope from mkt
          window w as (partition by template_id order by bar_date rows between 3 preceding and current row)
          qualify count(*) over w = 4""")
def _(m: Market) -> DataFrame:
    w = by_t().rowsBetween(-3, 0)
    df = series(m).withColumn("slope", F.regr_slope(F.col("n70"), F.col("ord")).over(w))
    return df.withColumn("_n", F.count(F.lit(1)).over(w)).where(F.col("_n") == 4)


@query("win_persistence", "template_id:i bar_date:d persistence:f",
       """with s as (select *, regr_slope(n70, ord) over w as slope, count(*) over w as c, n70 - lag(n70) over (partition by template_id order by bar_date) as d from mkt
            window w as (partition by template_id order by bar_date rows between 3 preceding and current row)),
          t as (select *, d as d0, lag(d) over (partition by template_id order by bar_date) as d1, lag(d, 2) over (partition by template_id order by bar_date) as d2 from s)
          select template_id, bar_date, case when abs(round_even(slope * 100, 0) / 100) < 0.25 then 0.0e0
            else (case when sign(d0) = sign(slope) then 1.0e0 else 0 end + case when sign(d1) = sign(slope) then 1 else 0 end + case when sign(d2) = sign(slope) then 1 else 0 end) / 3 end as persistence
          from t where c = 4""")
def _(m: Market) -> DataFrame:
    w = by_t().rowsBetween(-3, 0)
    df = (
        series(m).withColumn("slope", F.regr_slope(F.col("n70"), F.col("ord")).over(w))
        .withColumn("_n", F.count(F.lit(1)).over(w))
        .withColumn("_d", F.col("n70") - F.lag("n70").over(by_t()))
        .withColumn("_ds", F.collect_list("_d").over(by_t().rowsBetween(-2, 0)))
    )
    moved = F.size(F.filter("_ds", lambda d: F.signum(d.cast("double")) == F.signum("slope"))) / F.lit(3.0)
    quiet = F.abs(F.rint(F.col("slope") * 100) / 100) < 0.25
    return df.where(F.col("_n") == 4).withColumn("persistence", F.when(quiet, 0.0).otherwise(moved))


@query("win_streak", "template_id:i bar_date:d entity:i streak:i",
       """select template_id, bar_date, entity, row_number() over (partition by template_id, entity, g order by ord) as streak
          from (select *, ord - row_number() over (partition by template_id, entity order by ord) as g from daily)""")
def _(m: Market) -> DataFrame:
    return streaks(daily_top(m), ["template_id", "entity"])


_RUNS = """(with d as (select template_id, ord, sign(coalesce(n70 - lag(n70, 5) over (partition by template_id order by ord), 0)) as s from mkt),
  r as (select *, ord - row_number() over (partition by template_id, s order by ord) as g from d),
  l as (select template_id, s, g, count(*) as n from r where s <> 0 group by all)
  select template_id, sum(case when n >= 3 then n else 0 end) * 1.0e0 / sum(n) as persistent_share, max(n) as max_run from l group by 1)"""


@query("win_sign_runs", "template_id:i persistent_share:f max_run:i",
       f"select z.template_id, coalesce(persistent_share, 0) as persistent_share, coalesce(max_run, 0) as max_run from zlists z left join {_RUNS} r on z.template_id = r.template_id")
def _(m: Market) -> DataFrame:
    df = series(m).withColumn("change", F.col("n70") - F.lag("n70", 5).over(by_t()))
    return sign_runs(df, ["template_id"], "bar_date", "change")


@query("win_dwell", "entity:i state:s duration:i n:i",
       """with s as (select entity, bar_date, case when close >= open then 'up' else 'down' end as state from bars0),
          g as (select *, row_number() over (partition by entity order by bar_date) - row_number() over (partition by entity, state order by bar_date) as g from s),
          l as (select entity, state, g, count(*) as duration from g group by all)
          select entity, state, duration, count(*) as n from l group by all""")
def _(m: Market) -> DataFrame:
    state = F.when(F.col("close") >= F.col("open"), "up").otherwise("down")
    runs = dwell_runs(m.bars0.select("entity", "bar_date", state.alias("state")), ["entity"], "state", "bar_date")
    return runs.groupBy("entity", "state", "duration").agg(F.count(F.lit(1)).alias("n"))


@query("win_weak_duration", "entity:i bar_date:d weak_duration:i",
       """with s as (select entity, bar_date, row_number() over (partition by entity order by bar_date) as pos, close < open as active, close < open and volume % 3 < 1.5 as trig from bars0),
          i as (select *, sum(case when active then 0 else 1 end) over (partition by entity order by bar_date) as island from s),
          m as (select *, min(case when active and trig then pos end) over (partition by entity, island order by bar_date) as st from i)
          select entity, bar_date, case when active and st is not null then pos - st + 1 else 0 end as weak_duration from m""")
def _(m: Market) -> DataFrame:
    active = F.col("close") < F.col("open")
    return weak_duration(active, active & (F.col("volume") % 3 < 1.5), ["entity"], "bar_date", m.bars0)


@query("win_max_drawdown", "entity:i max_drawdown:f",
       """select entity, min(close / peak - 1) as max_drawdown from (select entity, close, max(close) over (partition by entity order by bar_date) as peak
          from qfq where pos > n_bars - 120) group by 1""")
def _(m: Market) -> DataFrame:
    tail = m.qfq.where(F.col("pos") > F.col("n_bars") - 120)
    peak = F.max("close").over(B.by_entity().rowsBetween(Window.unboundedPreceding, 0))
    return tail.withColumn("dd", F.col("close") / peak - 1).groupBy("entity").agg(F.min("dd").alias("max_drawdown"))


@query("win_forward_fill", "entity:i bar_date:d filled:f",
       "select entity, bar_date, last_value(adj_factor ignore nulls) over (partition by entity order by bar_date rows between unbounded preceding and current row) as filled from factors")
def _(m: Market) -> DataFrame:
    return m.factors.withColumn("filled", B.fill_forward("adj_factor"))


@query("win_backward_fill", "entity:i bar_date:d filled:f",
       "select entity, bar_date, first_value(adj_factor ignore nulls) over (partition by entity order by bar_date rows between current row and unbounded following) as filled from factors")
def _(m: Market) -> DataFrame:
    return m.factors.withColumn("filled", B.fill_backward("adj_factor"))
