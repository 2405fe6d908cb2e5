"""Daily Top-K breadth, industry health and the fixed-threshold study."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.functions.ranking import prefix_share, top_k
from tapeloom.functions.scalars import corr_or_null, flag
from tapeloom.operators import documents as N
from tapeloom.operators import health as H
from tapeloom.operators.calendar import timeline_dates
from tapeloom.operators.flows import flow_counts, flows_to_last_seen, shifted_states
from tapeloom.operators.membership import industry_on
from tapeloom.operators.runs import sign_runs
from tapeloom.plans import similarity as sim
from tapeloom.plans.common import K, best_first, daily_top, panel
from tapeloom.plans.registry import query
from tapeloom.plans.sources import _fresh
from tapeloom.plans.relational import industry_counts, other_rollup
from tapeloom.plans.windows import position_label, series
from tapeloom.sources import store
from tapeloom.sources.staging import stage
from tapeloom.sources.tables import Market

LINES = (0.70, 0.75, 0.80)
HISTORY_DAYS, SERIES_DAYS, LAGS, DEFAULT_LAG = 252, 60, (10, 20), 10
_ICOLS = "template_id:i ord:i industry_code:i"


@query("brd_membership", "template_id:i bar_date:d rank:i entity:i score:f window_start:d industry_code:i",
       """select d.template_id, d.bar_date, d.rank, d.entity, d.score, b.bar_date as window_start, d.industry_code
          from daily d join bars b on b.entity = d.entity and b.pos = d.pos - d.n + 1""")
def _(m: Market) -> DataFrame:
    return daily_top(m)


def daily_base(m: Market, newest_days: int | None = None) -> DataFrame:
    """Panel rows, scored and written once for a query; of the newest dates only, if so many are asked for."""
    def build() -> DataFrame:
        days = None if newest_days is None else m.cal.where(F.col("ord") > m.cal.agg(F.max("ord")).scalar() - newest_days)
        return stage(panel(m, days).select("template_id", "bar_date", "ord", "entity", "score", "industry_code", "industry"))

    return m.once(f"daily base {newest_days}", build)


def daily_list(m: Market, newest_days: int | None = None) -> DataFrame:
    """The Top-K of ``daily_base``, written once for a query."""
    return m.once(f"daily list {newest_days}", lambda: stage(top_k(daily_base(m, newest_days), ["template_id", "ord"], best_first(), K)))


def industry_daily(m: Market, days: int | None = None) -> DataFrame:
    """(template, lag, ord, industry): eligible and Top-K counts with flows against `lag` days earlier.

    With ``days`` only the newest of them, for which the dates that a lag looks back to are scored too.
    """
    scored_days = None if days is None else days + max(LAGS)
    base, top = daily_base(m, scored_days), daily_list(m, scored_days)
    keys = ["template_id", "ord"]
    counts = base.groupBy(*keys, "industry_code").agg(F.count(F.lit(1)).alias("eligible"))
    lags = counts.select(*keys, "industry_code", "eligible", F.explode(F.array(*[F.lit(n) for n in LAGS])).alias("lag"))
    newest = m.cal.agg(F.max("ord")).scalar()
    states = shifted_states(top, ["template_id"], list(LAGS), ["industry_code"], newest).withColumn(
        "industry_code", F.coalesce("cur.industry_code", "prior.industry_code")
    )
    flows = flow_counts(states, ["template_id", "lag", "ord", "industry_code"])
    out = lags.join(flows, ["template_id", "lag", "ord", "industry_code"], "full_outer").fillna(0)
    if days is not None:
        out = out.where(F.col("ord") > newest - days)
    now = F.col("new_count") + F.col("retained_count")
    return out.withColumns({
        "top_count": now,
        "selection_rate": F.coalesce(F.try_divide(now, F.col("eligible")), F.lit(0.0)),
        "top_share": now / F.lit(float(K)),
    })


@query("brd_industry_daily", _ICOLS + " lag:i eligible:i top_count:i selection_rate:f top_share:f new_count:i retained_count:i exit_count:i",
       """select *, case when eligible > 0 then top_count * 1.0e0 / eligible else 0 end as selection_rate, top_count / 100.0e0 as top_share from brdind""")
def _(m: Market) -> DataFrame:
    return industry_daily(m)


def named_industry_daily(m: Market, days: int | None = None) -> DataFrame:
    """``industry_daily`` with the name of the industry and the date that a lag compares with."""
    names = m.membership.select("industry_code", "industry").distinct()
    earlier = m.cal.select(F.col("bar_date").alias("comparison_date"), F.col("ord").alias("_then"))
    rows = industry_daily(m, days).join(names, "industry_code", "left").withColumn("industry", F.coalesce("industry", F.lit("missing")))
    rows = rows.join(earlier, F.col("ord") - F.col("lag") == F.col("_then"), "left").drop("_then")
    return rows.join(m.cal.select("ord", "bar_date"), "ord")


_NAMED_SQL = """
nid as (select b.*, case when b.industry_code = -1 then 'missing' else n.n_name end as industry, c.bar_date, p.bar_date as comparison_date
  from brdind b join cal c on c.ord = b.ord left join cal p on p.ord = b.ord - b.lag left join nation n on n.n_nationkey = b.industry_code),
tags as (select *, case when top_count in (1, 2) then 'other' else cast(industry_code as varchar) end as block, case when top_count in (1, 2) then 'other' else industry end as block_name from nid)"""


@query("brd_snapshot", "template_id:i ord:i block:s name:s eligible:i top_count:i selection_rate:f top_share:f components:s lag:i comparison_date:d new_count:i retained_count:i exit_count:i net_change:i",
       f"""with {_NAMED_SQL} select template_id, ord, block, any_value(block_name) as name, sum(eligible) as eligible, sum(top_count) as top_count, sum(top_count) * 1.0e0 / sum(eligible) as selection_rate,
            sum(top_count) / 100.0e0 as top_share, coalesce(string_agg(cast(industry_code as varchar), ',' order by industry_code) filter (where block = 'other'), '') as components,
            lag, any_value(comparison_date) as comparison_date, sum(new_count) as new_count, sum(retained_count) as retained_count, sum(exit_count) as exit_count, sum(new_count - exit_count) as net_change
          from tags where top_count > 0 and (ord % 5 = 0 or ord = (select max(ord) from cal)) group by template_id, ord, block, lag""")
def _(m: Market) -> DataFrame:
    sampled = named_industry_daily(m).join(F.broadcast(timeline_dates(m.cal).select("ord")), "ord", "left_semi")
    blocks = N.snapshot_blocks(sampled, K)
    return blocks.select(
        "template_id", "ord", "block", "name", "eligible", "top_count", "selection_rate", "top_share", F.explode("changes").alias("c"),
        F.array_join(F.transform("components", lambda c: c.cast("string")), ",").alias("components"),
    ).select("*", "c.*")


def timeline_blocks(m: Market) -> DataFrame:
    days = timeline_dates(m.cal).select("bar_date")
    counts = industry_counts(m).join(F.broadcast(days), "bar_date", "left_semi")
    return other_rollup(counts, ["template_id", "bar_date"])


_BLOCKS = """
blk as (select i.template_id, i.bar_date, case when top_count in (1, 2) then 'other' else industry end as block, sum(top_count) as top_count, sum(eligible) as eligible
  from indday i where top_count > 0 and (ord % 5 = 0 or ord = (select max(ord) from cal)) group by 1, 2, 3)"""


@query("brd_layout_order", "template_id:i position:i block:s total:i",
       f"with {_BLOCKS} select template_id, row_number() over (partition by template_id order by sum(top_count) desc, block) as position, block, sum(top_count) as total from blk group by template_id, block")
def _(m: Market) -> DataFrame:
    totals = timeline_blocks(m).groupBy("template_id", "block").agg(F.sum("top_count").alias("total"))
    w = Window.partitionBy("template_id").orderBy(F.col("total").desc(), "block")
    return totals.withColumn("position", F.row_number().over(w))


def timeline_documents(m: Market) -> DataFrame:
    """One document a template: sampled snapshots of the last 252 days, blocks in one order for all of them."""
    newest = m.cal.agg(F.max("ord")).scalar()
    days = timeline_dates(m.cal).where(F.col("ord") > newest - HISTORY_DAYS).select("ord")
    sampled = named_industry_daily(m, HISTORY_DAYS).join(F.broadcast(days), "ord", "left_semi")
    return N.timelines(N.snapshot_blocks(sampled, K))


@query("brd_timeline", "template_id:i bar_date:d place:i position:i block:s name:s eligible:i top_count:i selection_rate:f components:i lag:i comparison_date:d new_count:i retained_count:i exit_count:i",
       f"""with {_NAMED_SQL}, b as (select template_id, ord, bar_date, block, any_value(block_name) as name, lag, sum(eligible) as eligible, sum(top_count) as top_count, count(*) as parts,
            any_value(comparison_date) as comparison_date, sum(new_count) as new_count, sum(retained_count) as retained_count, sum(exit_count) as exit_count
          from tags where top_count > 0 and ord > (select max(ord) from cal) - {HISTORY_DAYS} and (ord % 5 = 0 or ord = (select max(ord) from cal)) group by template_id, ord, bar_date, block, lag),
          lay as (select template_id, block, row_number() over (partition by template_id order by sum(top_count) desc, any_value(name), block) as position from b where lag = {DEFAULT_LAG} group by 1, 2)
          select b.*, lay.position, dense_rank() over (partition by b.template_id, b.ord order by lay.position) as place, top_count * 1.0e0 / eligible as selection_rate,
            case when block = 'other' then parts else 0 end as components from b join lay using (template_id, block)""")
def _(m: Market) -> DataFrame:
    flat = timeline_documents(m).select("template_id", "layout_order", F.explode("snapshots").alias("s")).select(
        "template_id", "layout_order", "s.bar_date", F.posexplode("s.blocks").alias("place", "b")
    )
    rows = flat.select("template_id", "bar_date", (F.col("place") + 1).alias("place"), F.array_position("layout_order", F.col("b.block")).alias("position"),
                       "b.*", F.explode("b.changes").alias("c"))
    return rows.withColumn("components", F.size("components")).select("*", "c.*")


@query("brd_series60", "template_id:i industry_code:i bar_date:d top_count:i eligible:i rate:f",
       """with d as (select bar_date from cal order by bar_date desc limit 60), i as (select distinct template_id, industry_code from indday)
          select i.template_id, i.industry_code, d.bar_date, coalesce(x.top_count, 0) as top_count, coalesce(x.eligible, 0) as eligible, coalesce(x.top_count * 1.0e0 / x.eligible, 0) as rate
          from i cross join d left join indday x on x.template_id = i.template_id and x.industry_code = i.industry_code and x.bar_date = d.bar_date""")
def _(m: Market) -> DataFrame:
    days = m.cal.orderBy(F.col("bar_date").desc()).limit(60).agg(F.array_sort(F.collect_list("bar_date"))).scalar()
    counts = stage(industry_counts(m))
    grid = counts.select("template_id", "industry_code").distinct().withColumn("bar_date", F.explode(days))
    full = grid.join(counts.drop("industry"), ["template_id", "industry_code", "bar_date"], "left").fillna(0)
    return full.withColumn("rate", F.coalesce("selection_rate", F.lit(0.0)))


def detail_documents(m: Market) -> DataFrame:
    """One document a template for the newest date: blocks with their lists, changes, 60 day series and components."""
    newest = m.cal.agg(F.max("ord")).scalar()
    daily = stage(named_industry_daily(m, SERIES_DAYS))
    now = daily.where(F.col("ord") == newest)
    top = daily_list(m, SERIES_DAYS + max(LAGS)).where((newest - F.col("ord")).isin(0, *LAGS))
    states = shifted_states(top, ["template_id"], list(LAGS), ["industry_code", "rank"], newest).where(F.col("ord") == newest)
    days = m.cal.where(F.col("ord") > newest - SERIES_DAYS).agg(F.array_sort(F.collect_list("bar_date"))).scalar()
    return N.details(now, states, daily.where(F.col("lag") == DEFAULT_LAG), days, K, DEFAULT_LAG)


DETAIL = "template_id:i block:s kind:s lag:i item:s rank:i n:i of:i rate:f"
_DETAIL_SQL = f"""with {_NAMED_SQL}, now as (select * from tags where ord = (select max(ord) from cal)),
  home as (select template_id, industry_code, unnest(case when top_count in (1, 2) then [cast(industry_code as varchar), 'other'] else [cast(industry_code as varchar)] end) as block from now where lag = {DEFAULT_LAG}),
  own as (select h.block, n.* exclude (block) from now n join home h using (template_id, industry_code)),
  st as (select f.*, h.block from flowst f join home h on h.template_id = f.template_id and h.industry_code = coalesce(f.c, f.p) where f.ord = (select max(ord) from cal)),
  days as (select bar_date, ord from cal where ord > (select max(ord) from cal) - {SERIES_DAYS}),
  pts as (select h.template_id, h.block, d.bar_date, coalesce(sum(n.top_count), 0) as n, coalesce(sum(n.eligible), 0) as of
    from home h cross join days d left join nid n on n.template_id = h.template_id and n.industry_code = h.industry_code and n.ord = d.ord and n.lag = {DEFAULT_LAG} group by 1, 2, 3)
  select template_id, block, 'summary' as kind, cast(null as bigint) as lag, case when block = 'other' then 'other' else any_value(industry) end as item, cast(null as bigint) as rank, sum(top_count) as n, sum(eligible) as of,
    coalesce(sum(top_count) * 1.0e0 / nullif(sum(eligible), 0), 0) as rate from own where lag = {DEFAULT_LAG} group by 1, 2
  union all select template_id, block, 'change', lag, strftime(any_value(comparison_date), '%Y%m%d'), sum(retained_count), sum(new_count), sum(exit_count), sum(new_count - exit_count) from own group by template_id, block, lag
  union all select template_id, block, 'current', null, cast(entity as varchar), cr, null, null, null from st where lag = {DEFAULT_LAG} and c is not null
  union all select template_id, block, state, lag, cast(entity as varchar), coalesce(cr, pr), null, null, null from st
  union all select template_id, block, 'point', null, strftime(bar_date, '%Y%m%d'), null, n, of, coalesce(n * 1.0e0 / nullif(of, 0), 0) from pts
  union all select template_id, 'other', 'component', null, cast(industry_code as varchar), null, top_count, null, null from now where lag = {DEFAULT_LAG} and top_count in (1, 2)"""


def detail_rows(documents: DataFrame) -> DataFrame:
    """Every field of the detail documents as flat rows."""
    block = documents.select("template_id", F.explode(F.concat("industries", F.array_compact(F.array("other")))).alias("b")).select("template_id", "b.*")
    none, text = F.lit(None).cast("bigint"), F.lit(None).cast("double")

    def rows(kind, source: DataFrame, lag=none, item=none, rank=none, n=none, of=none, rate=text) -> DataFrame:
        kind = F.lit(kind) if isinstance(kind, str) else kind
        named = {"kind": kind, "lag": lag.cast("bigint"), "item": item.cast("string"), "rank": rank.cast("bigint"), "n": n.cast("bigint"), "of": of.cast("bigint"), "rate": rate.cast("double")}
        return source.select("template_id", "block", *[c.alias(k) for k, c in named.items()])

    change = block.select("template_id", "block", F.explode("changes").alias("c"))
    stocks = change.select("template_id", "block", "c.lag", F.explode("c.stocks").alias("s"))
    current = block.select("template_id", "block", F.explode("current").alias("s"))
    point = block.select("template_id", "block", F.explode("series").alias("p"))
    parts = block.select("template_id", "block", F.explode("components").alias("p"))
    day = lambda c: F.date_format(c, "yyyyMMdd")
    out = [
        rows("summary", block, item=F.col("name"), n=F.col("top_count"), of=F.col("eligible"), rate=F.col("selection_rate")),
        rows("change", change, F.col("c.lag"), day(F.col("c.comparison_date")), F.col("c.retained_count"), F.col("c.new_count"), F.col("c.exit_count"), F.col("c.net_change")),
        rows("current", current, item=F.col("s.entity"), rank=F.col("s.rank")), rows(F.col("s.state"), stocks, F.col("lag"), F.col("s.entity"), F.col("s.rank")),
        rows("point", point, item=day(F.col("p.bar_date")), n=F.col("p.top_count"), of=F.col("p.eligible"), rate=F.col("p.selection_rate")),
        rows("component", parts, item=F.col("p.industry_code"), n=F.col("p.top_count")),
    ]
    return reduce(DataFrame.unionByName, out)


@query("brd_detail", DETAIL, _DETAIL_SQL)
def _(m: Market) -> DataFrame:
    return detail_rows(stage(detail_documents(m)))


@query("snk_nested_json", DETAIL, _DETAIL_SQL)
def _(m: Market) -> DataFrame:
    """The detail documents written as JSON, one folder a template, and read again with their declared schema."""
    documents, path = detail_documents(m), _fresh(m, "nested")
    schema = documents.schema
    store.write_nested_json(documents, path, "template_id")
    return detail_rows(stage(m.spark.read.schema(schema).json(path)))


@query("brd_ranking", "template_id:i rank:i entity:i name:s industry:s score:f",
       "select d.template_id, d.rank, d.entity, s.name, d.industry, d.score from daily d join securities s on d.entity = s.entity where d.ord = (select max(ord) from cal)")
def _(m: Market) -> DataFrame:
    newest = m.cal.agg(F.max("ord")).scalar()
    return daily_top(m).where(F.col("ord") == newest).join(m.securities.select("entity", "name"), "entity")


# ---------------------------------------------------------------- health


@query("hlth_latest_panel", "industry_code:i eligible_count:i b_count:i b_breadth:f",
       sim.BLEND_SQL + "select industry_code, count(*) as eligible_count, count(case when b_rank <= 100 then 1 end) as b_count, count(case when b_rank <= 100 then 1 end) * 1.0e0 / count(*) as b_breadth from bi group by 1")
def _(m: Market) -> DataFrame:
    scored = stage(sim.blended(m))
    key = F.floor(F.col("bscore") * F.lit(1e9) + 0.5)
    best = scored.orderBy(key.desc(), F.col("entity")).limit(K).select("entity", F.lit(1).alias("hit"))
    base = industry_on(scored.join(best, "entity", "left").withColumn("bar_date", m.as_of), m.membership)
    out = base.where(F.col("industry_code") >= 0).groupBy("industry_code").agg(
        F.count(F.lit(1)).alias("eligible_count"), F.count("hit").alias("b_count")
    )
    return out.withColumn("b_breadth", F.col("b_count") / F.col("eligible_count"))


def health_panel(m: Market) -> DataFrame:
    """(date, industry): members, members among the day's best blended scores, and their share."""
    scored = stage(sim.blended_daily(m))
    key = F.floor(F.col("bscore") * F.lit(1e9) + 0.5)
    best = top_k(scored, ["bar_date"], [key.desc(), F.col("entity")], K).select("bar_date", "entity", F.lit(1).alias("hit"))
    base = industry_on(scored.join(best, ["bar_date", "entity"], "left"), m.membership).where(F.col("industry_code") >= 0)
    out = base.groupBy("bar_date", "industry_code", "industry").agg(
        F.count(F.lit(1)).alias("eligible_count"), F.count("hit").alias("b_count")
    )
    return out.withColumn("b_breadth", F.col("b_count") / F.col("eligible_count"))


def _health(name: str, columns: str, sql: str) -> None:
    @query(name, "industry_code:i bar_date:d " + columns, sql)
    def _(m: Market) -> DataFrame:
        return H.health_fields(health_panel(m))


_health("hlth_mainline", "b_rank_pct:f mainline:b", "select industry_code, bar_date, rk as b_rank_pct, mainline from health")
_health("hlth_weakening", "delta_rank_3:f delta_rank_5:f smooth3:b smooth5:b",
        "select industry_code, bar_date, dr3 as delta_rank_3, dr5 as delta_rank_5, smooth3, smooth5 from health")
_health("hlth_cooling", "delta_rank_formal:f delta_breadth_formal:f cooling:b",
        "select industry_code, bar_date, drf as delta_rank_formal, dbf as delta_breadth_formal, cooling from health")
_health("hlth_raw", "raw_drop:b", "select industry_code, bar_date, raw_drop from health")


@query("hlth_snapshot", "bar_date:d industry_code:i pool_total:i pool_share:f pool_rank:i change_3d_count:f status:s weak_duration:i marked:b",
       """select *, pool_rank = 1 or (status <> 'stable' and weak_duration >= 3) as marked from (
          select bar_date, industry_code, sum(b_count) over (partition by bar_date) as pool_total, coalesce(b_count * 1.0e0 / nullif(sum(b_count) over (partition by bar_date), 0), 0) as pool_share,
            row_number() over (partition by bar_date order by b_count desc, b_breadth desc, industry_code) as pool_rank, dc3 as change_3d_count,
            case when cooling then 'cooling' when smooth3 or smooth5 then 'weakening' else 'stable' end as status, weak_duration from healthd)""")
def _(m: Market) -> DataFrame:
    return H.health_snapshot(H.health_fields(health_panel(m)))


# ---------------------------------------------------------------- fixed thresholds


def market_daily(m: Market, rows: DataFrame | None = None) -> DataFrame:
    """Counts above each fixed line with change and average; lines ride as a column.  ``rows`` are scores that exist already."""
    lines = F.array(*[
        F.struct(F.lit(t).alias("threshold"), F.col(f"n{int(round(t * 100))}").alias("above")) for t in LINES
    ])
    long = series(m, rows).select("template_id", "bar_date", "ord", "eligible", F.explode(lines).alias("l")).select(
        "template_id", "bar_date", "ord", "eligible", "l.threshold", "l.above"
    )
    w = Window.partitionBy("threshold", "template_id").orderBy("bar_date")
    return long.withColumns({
        "change_1d": F.col("above") - F.lag("above").over(w),
        "change_5d": F.col("above") - F.lag("above", 5).over(w),
        "ma5": F.avg("above").over(w.rowsBetween(-4, 0)),
    })


def with_position(market: DataFrame) -> DataFrame:
    """The place of each count in its own history, and its label."""
    placed = prefix_share(market, ["threshold", "template_id"], "bar_date", "above", "position")
    return placed.withColumn("label", position_label(F.col("position")))


THR_SQL = """
lines as (select unnest([0.7e0, 0.75e0, 0.8e0]) as threshold),
mk0 as (select l.threshold, k.template_id, k.bar_date, k.ord, k.eligible, case l.threshold when 0.7e0 then n70 when 0.75e0 then n75 else n80 end as above from mkt k, lines l),
mkd as (select *, above - lag(above) over w as change_1d, above - lag(above, 5) over w as change_5d, avg(above) over (partition by threshold, template_id order by bar_date rows between 4 preceding and current row) as ma5
  from mk0 window w as (partition by threshold, template_id order by bar_date))"""


@query("thr_market_daily", "threshold:f template_id:i bar_date:d eligible:i above:i change_1d:i change_5d:i ma5:f position:f label:s",
       f"""with {THR_SQL}, p as (select *, (select count(*) from mk0 h where h.threshold = k.threshold and h.template_id = k.template_id and h.ord <= k.ord and h.above <= k.above) * 1.0e0
            / (select count(*) from mk0 h where h.threshold = k.threshold and h.template_id = k.template_id and h.ord <= k.ord) as position from mkd k)
          select *, case when position >= 2/3.0e0 then 'high' when position <= 1/3.0e0 then 'low' else 'mid' end as label from p""")
def _(m: Market) -> DataFrame:
    return with_position(stage(market_daily(m)))


def industry_threshold_daily(m: Market, lines: tuple[float, ...] = LINES) -> DataFrame:
    """Per line, template, date and industry: counts, flows and leader-removed counts."""
    base = daily_base(m)
    keys = ["template_id", "ord", "industry_code"]
    top = daily_list(m).groupBy(*keys).agg(F.count(F.lit(1)).alias("top_count"))
    counted = base.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("eligible"), *[F.count_if(F.col("score") >= t).alias(f"n{i}") for i, t in enumerate(lines)]
    ).join(top, keys, "left").fillna(0)
    long = counted.select(
        *keys, "eligible", "top_count",
        F.explode(F.array(*[F.struct(F.lit(t).alias("threshold"), F.col(f"n{i}").alias("above")) for i, t in enumerate(lines)])).alias("l"),
    ).select(*keys, "eligible", "top_count", "l.*")
    members = base.where(F.col("score") >= min(lines)).select(
        *keys, "entity", F.explode(F.filter(F.array(*[F.lit(t) for t in lines]), lambda t: F.col("score") >= t)).alias("threshold")
    )
    flows = flows_to_last_seen(long.select("threshold", *keys), members, ["threshold", "template_id", "industry_code"])
    out = long.join(flows, ["threshold", *keys], "left")
    for k in (1, 3):
        # Leaders are the highest scores of the group, so removing k of them subtracts from both counts.
        out = out.withColumns({
            f"eligible_without_top{k}": F.greatest(F.col("eligible") - k, F.lit(0)),
            f"above_without_top{k}": F.greatest(F.col("above") - k, F.lit(0)),
            f"top_without_top{k}": F.greatest(F.col("top_count") - k, F.lit(0)),
        })
    return out.withColumn("above_rate", F.col("above") / F.col("eligible")).withColumn("top_share", F.col("top_count") / F.lit(float(K)))


IND_SQL = """
lines as (select unnest([0.7e0, 0.75e0, 0.8e0]) as threshold),
pr as (select p.*, row_number() over (partition by template_id, ord, industry_code order by score desc, entity) as rn from panel p),
thi as (select l.threshold, template_id, ord, industry_code, count(*) as eligible, count(case when rank <= 100 then 1 end) as top_count, count(case when score >= threshold then 1 end) as above,
  count(case when rn > 1 then 1 end) as eligible_without_top1, count(case when rn > 3 then 1 end) as eligible_without_top3,
  count(case when score >= threshold and rn > 1 then 1 end) as above_without_top1, count(case when score >= threshold and rn > 3 then 1 end) as above_without_top3,
  count(case when rank <= 100 and rn > 1 then 1 end) as top_without_top1, count(case when rank <= 100 and rn > 3 then 1 end) as top_without_top3,
  count(case when score >= threshold then 1 end) * 1.0e0 / count(*) as above_rate, count(case when rank <= 100 then 1 end) / 100.0e0 as top_share
  from pr, lines l group by 1, 2, 3, 4)"""
_FLOW_SQL = """
nx as (select template_id, industry_code, ord, lead(ord) over (partition by template_id, industry_code order by ord) as nxt from (select distinct template_id, industry_code, ord from panel)),
sel as (select l.threshold, p.template_id, p.industry_code, p.ord, p.entity, nx.nxt from panel p join nx using (template_id, industry_code, ord), lines l where p.score >= l.threshold),
sp as (select threshold, template_id, industry_code, ord as o, entity, 1 as c, 0 as p from sel union all select threshold, template_id, industry_code, nxt, entity, 0, 1 from sel where nxt is not null),
bo as (select threshold, template_id, industry_code, o, entity, max(c) as c, max(p) as p from sp group by all),
fl as (select threshold, template_id, industry_code, o as ord, sum(c * (1 - p)) as new_count, sum(c * p) as retained_count, sum(p * (1 - c)) as exit_count from bo group by all)"""


@query("thr_industry_daily", "threshold:f template_id:i ord:i industry_code:i eligible:i above:i top_count:i new_count:i retained_count:i exit_count:i above_without_top1:i above_without_top3:i eligible_without_top3:i top_without_top1:i",
       f"""with {IND_SQL}, {_FLOW_SQL} select t.*, coalesce(new_count, 0) as new_count, coalesce(retained_count, 0) as retained_count, coalesce(exit_count, 0) as exit_count
         from thi t left join fl using (threshold, template_id, industry_code, ord)""")
def _(m: Market) -> DataFrame:
    return industry_threshold_daily(m)


def evaluate(market: DataFrame, low_limit: int = 5, high_limit: int = 200) -> DataFrame:
    """Per line and template: extreme shares, lag-1 correlations, persistence and support."""
    keys = ["threshold", "template_id"]
    base = stage(market)
    w = Window.partitionBy(*keys).orderBy("bar_date")
    lagged = base.withColumns({"_pa": F.lag("above").over(w), "_pm": F.lag("ma5").over(w)})
    stats = lagged.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("days"),
        F.expr("percentile(above, array(0.1, 0.5, 0.9))").alias("q"),
        F.avg(flag(F.col("above") <= low_limit)).alias("low_share"),
        F.avg(flag(F.col("above") >= high_limit)).alias("high_share"),
        corr_or_null("_pa", "above").alias("level_corr"), corr_or_null("_pm", "ma5").alias("ma5_corr"),
    )
    runs = sign_runs(base, keys, "bar_date", "change_5d")
    df = stats.join(runs, keys)
    usable = (F.col("low_share") < 0.5) & (F.col("high_share") < 0.5)
    steady = (F.coalesce("ma5_corr", F.lit(0.0)) >= 0.85) & (F.col("persistent_share") >= 0.5) & (F.col("max_run") >= 5)
    return df.withColumns({
        "p10": F.col("q")[0], "median": F.col("q")[1], "p90": F.col("q")[2], "usable": usable, "supported": usable & steady,
    }).drop("q")


EVAL_SQL = f"""{THR_SQL},
lg as (select *, lag(above) over w as pa, lag(ma5) over w as pm from mkd window w as (partition by threshold, template_id order by bar_date)),
st as (select threshold, template_id, count(*) as days, quantile_cont(above, 0.1) as p10, median(above) as median, quantile_cont(above, 0.9) as p90,
  avg(case when above <= 5 then 1.0e0 else 0 end) as low_share, avg(case when above >= 200 then 1.0e0 else 0 end) as high_share,
  covar_pop(pa, above) / nullif(stddev_pop(pa) * (stddev_pop(above) filter (where pa is not null)), 0) as level_corr,
  covar_pop(pm, ma5) / nullif(stddev_pop(pm) * (stddev_pop(ma5) filter (where pm is not null)), 0) as ma5_corr from lg group by 1, 2),
rs as (select threshold, template_id, ord, sign(coalesce(change_5d, 0)) as s from mkd),
rg as (select *, ord - row_number() over (partition by threshold, template_id, s order by ord) as g from rs),
rl as (select threshold, template_id, s, g, count(*) as n from rg where s <> 0 group by all),
rr as (select threshold, template_id, sum(case when n >= 3 then n else 0 end) * 1.0e0 / sum(n) as ps, max(n) as mr from rl group by 1, 2),
ev as (select st.*, coalesce(ps, 0) as persistent_share, coalesce(mr, 0) as max_run, low_share < 0.5 and high_share < 0.5 as usable,
  low_share < 0.5 and high_share < 0.5 and coalesce(ma5_corr, 0) >= 0.85 and coalesce(ps, 0) >= 0.5 and coalesce(mr, 0) >= 5 as supported from st left join rr using (threshold, template_id))"""


@query("thr_evaluate", "threshold:f template_id:i days:i median:f p10:f p90:f low_share:f high_share:f level_corr:f ma5_corr:f persistent_share:f max_run:i usable:b supported:b",
       f"with {EVAL_SQL} select * from ev")
def _(m: Market) -> DataFrame:
    return evaluate(market_daily(m))


@query("thr_choose", "threshold:f decision:s supported_templates:i worst_share:f mean_corr:f chosen:b",
       f"""with {EVAL_SQL}, cand as (select threshold, count(case when supported then 1 end) as supported_templates, max(greatest(low_share, high_share)) as worst_share, avg(coalesce(ma5_corr, 0)) as mean_corr, count(*) as n from ev group by 1),
          dec as (select *, case when supported_templates = n then 'supported' when supported_templates >= 2 then 'weak' else 'rejected' end as decision from cand)
          select *, decision = 'supported' and row_number() over (order by case when decision = 'supported' then 0 else 1 end, worst_share, -mean_corr, threshold) = 1 as chosen from dec""")
def _(m: Market) -> DataFrame:
    cand = evaluate(market_daily(m)).groupBy("threshold").agg(
        F.count_if(F.col("supported")).alias("supported_templates"),
        F.max(F.greatest("low_share", "high_share")).alias("worst_share"),
        F.avg(F.coalesce("ma5_corr", F.lit(0.0))).alias("mean_corr"), F.count(F.lit(1)).alias("n"),
    )
    decision = (
        F.when(F.col("supported_templates") == F.col("n"), "supported").when(F.col("supported_templates") >= 2, "weak").otherwise("rejected")
    )
    df = cand.withColumn("decision", decision)
    # One row per candidate line: three rows.
    order = Window.orderBy(F.when(F.col("decision") == "supported", 0).otherwise(1), "worst_share", -F.col("mean_corr"), "threshold")
    return df.withColumn("chosen", (F.row_number().over(order) == 1) & (F.col("decision") == "supported"))


_PAIRS = {
    "count_corr": ("above", "top_count"), "rate_corr": ("above_rate", "top_share"),
    "top1_corr": ("above_without_top1", "top_without_top1"), "top3_corr": ("above_without_top3", "top_without_top3"),
    "d1_corr": ("da1", "dt1"), "d5_corr": ("da5", "dt5"),
    "top1_d5_corr": ("da5_1", "dt5_1"), "top3_d5_corr": ("da5_3", "dt5_3"),
}
_WITHIN = ("d1_corr", "d5_corr", "top1_d5_corr", "top3_d5_corr")


def guarded_corr(x: str, y: str) -> Column:
    """Correlation, null below three complete pairs or when a side is constant."""
    both = F.count_if(F.col(x).isNotNull() & F.col(y).isNotNull())
    return F.when(both >= 3, corr_or_null(x, y))


def industry_evaluation(daily: DataFrame) -> DataFrame:
    """Median of cross-industry correlations per date and of within-industry correlations."""
    w = Window.partitionBy("threshold", "template_id", "industry_code").orderBy("ord")

    def diff(c: str, n: int) -> Column:
        return F.col(c) - F.lag(c, n).over(w)

    df = stage(daily).withColumns({
        "da1": diff("above", 1), "dt1": diff("top_count", 1), "da5": diff("above", 5), "dt5": diff("top_count", 5),
        "da5_1": diff("above_without_top1", 5), "dt5_1": diff("top_without_top1", 5),
        "da5_3": diff("above_without_top3", 5), "dt5_3": diff("top_without_top3", 5),
    })
    keys = ["threshold", "template_id"]
    cross = df.groupBy(*keys, "ord").agg(*[guarded_corr(*xy).alias(n) for n, xy in _PAIRS.items()])
    inside = df.groupBy(*keys, "industry_code").agg(*[guarded_corr(*_PAIRS[n]).alias(f"within_{n}") for n in _WITHIN])
    a = cross.groupBy(*keys).agg(*[F.expr(f"percentile({n}, 0.5)").alias(n) for n in _PAIRS], F.count(F.lit(1)).alias("dates"))
    b = inside.groupBy(*keys).agg(*[F.expr(f"percentile(within_{n}, 0.5)").alias(f"within_{n}") for n in _WITHIN])
    return a.join(b, keys)


def _gc(x: str, y: str) -> str:
    ok = f"{x} is not null and {y} is not null"
    return (f"case when count(case when {ok} then 1 end) >= 3 then covar_pop({x}, {y}) / nullif((stddev_pop({x}) filter (where {ok})) * (stddev_pop({y}) filter (where {ok})), 0) end")


@query("thr_industry_eval", "threshold:f template_id:i dates:i " + " ".join(f"{n}:f" for n in _PAIRS) + " " + " ".join(f"within_{n}:f" for n in _WITHIN),
       f"""with {IND_SQL}, df as (select *, above - lag(above) over w as da1, top_count - lag(top_count) over w as dt1, above - lag(above, 5) over w as da5, top_count - lag(top_count, 5) over w as dt5,
            above_without_top1 - lag(above_without_top1, 5) over w as da5_1, top_without_top1 - lag(top_without_top1, 5) over w as dt5_1,
            above_without_top3 - lag(above_without_top3, 5) over w as da5_3, top_without_top3 - lag(top_without_top3, 5) over w as dt5_3
            from thi window w as (partition by threshold, template_id, industry_code order by ord)),
          cr as (select threshold, template_id, ord, {', '.join(f'{_gc(*xy)} as {n}' for n, xy in _PAIRS.items())} from df group by 1, 2, 3),
          wi as (select threshold, template_id, industry_code, {', '.join(f'{_gc(*_PAIRS[n])} as within_{n}' for n in _WITHIN)} from df group by 1, 2, 3)
          select a.*, {', '.join('b.within_' + n for n in _WITHIN)} from (select threshold, template_id, count(*) as dates, {', '.join(f'median({n}) as {n}' for n in _PAIRS)} from cr group by 1, 2) a
          join (select threshold, template_id, {', '.join(f'median(within_{n}) as within_{n}' for n in _WITHIN)} from wi group by 1, 2) b using (threshold, template_id)""")
def _(m: Market) -> DataFrame:
    return industry_evaluation(industry_threshold_daily(m))


VIEW_LINE, VIEW_TOP = 0.75, 30
_VIEW = "template_id:i kind:s key:s text:s n:i a:i b:i c:i d:i x:f y:f"


@query("thr_view", _VIEW,
       f"""with {THR_SQL}, {", ".join(x.strip() for x in IND_SQL.strip().split("lines as (select unnest([0.7e0, 0.75e0, 0.8e0]) as threshold),")[1:])}, {_FLOW_SQL.strip()},
          v as (select * from mkd where threshold = {VIEW_LINE}e0), p as (select *, (select count(*) from v h where h.template_id = v.template_id and h.ord <= v.ord and h.above <= v.above) * 1.0e0
            / (select count(*) from v h where h.template_id = v.template_id and h.ord <= v.ord) as position, row_number() over (partition by template_id order by bar_date desc) as rn from v),
          it as (select t.*, coalesce(new_count, 0) as new_count, coalesce(retained_count, 0) as retained_count, coalesce(exit_count, 0) as exit_count,
              above - lag(above, 5) over (partition by template_id, industry_code order by ord) as change_5d, row_number() over (partition by template_id, industry_code order by ord desc) as rn
            from thi t left join fl using (threshold, template_id, industry_code, ord) where threshold = {VIEW_LINE}e0)
          select template_id, 'summary' as kind, strftime(bar_date, '%Y%m%d') as key, case when position >= 2/3.0e0 then 'high' when position <= 1/3.0e0 then 'low' else 'mid' end as text,
            above as n, coalesce(change_1d, 0) as a, coalesce(change_5d, 0) as b, null as c, null as d, ma5 as x, position as y from p where rn = 1
          union all select template_id, 'point', strftime(bar_date, '%Y%m%d'), null, above, null, null, null, null, ma5, null from p where rn <= {SERIES_DAYS}
          union all select template_id, 'top', cast(entity as varchar), industry, rank, case when score >= {VIEW_LINE}e0 then 1 else 0 end, null, null, null, score, null from daily where ord = (select max(ord) from cal) and rank <= {VIEW_TOP}
          union all select it.template_id, 'industry', cast(it.industry_code as varchar), case when it.industry_code = -1 then 'missing' else n.n_name end, above, new_count, retained_count, exit_count, coalesce(change_5d, 0), top_share, top_count
            from it left join nation n on n.n_nationkey = it.industry_code where ord = (select max(ord) from cal)
          union all select it.template_id, 'industry point', cast(it.industry_code as varchar), strftime(c.bar_date, '%Y%m%d'), above, null, null, null, null, null, null from it join cal c on c.ord = it.ord where rn <= {SERIES_DAYS}""")
def _(m: Market) -> DataFrame:
    """What a page of one fixed line shows, every kind of row in one table."""
    newest = m.cal.agg(F.max("ord")).scalar()
    market = stage(with_position(stage(market_daily(m, daily_base(m)).where(F.abs(F.col("threshold") - VIEW_LINE) < 1e-8))))
    industry = stage(industry_threshold_daily(m, (VIEW_LINE,)).join(m.cal.select("ord", "bar_date"), "ord"))
    by_industry = Window.partitionBy("template_id", "industry_code").orderBy("ord")
    latest = Window.partitionBy("template_id", "industry_code").orderBy(F.col("ord").desc())
    industry = industry.withColumns({"change_5d": F.col("above") - F.lag("above", 5).over(by_industry), "rn": F.row_number().over(latest)})
    names = m.membership.select("industry_code", "industry").distinct()
    named = industry.join(names, "industry_code", "left").withColumn("industry", F.coalesce("industry", F.lit("missing")))
    recent = market.withColumn("rn", F.row_number().over(Window.partitionBy("template_id").orderBy(F.col("bar_date").desc())))
    best = daily_list(m).where((F.col("ord") == newest) & (F.col("rank") <= VIEW_TOP))

    def rows(kind: str, df: DataFrame, **columns: Column | str) -> DataFrame:
        picked = {"kind": F.lit(kind)} | {c: F.lit(None) for c in ("key", "text", "n", "a", "b", "c", "d", "x", "y")}
        picked |= {c: F.col(v) if isinstance(v, str) else v for c, v in columns.items()}
        kinds = {"kind": "string", "key": "string", "text": "string", "x": "double", "y": "double"}
        return df.select("template_id", *[v.cast(kinds.get(c, "bigint")).alias(c) for c, v in picked.items()])

    day = F.date_format("bar_date", "yyyyMMdd")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    parts = [
        rows("summary", recent.where(F.col("rn") == 1), key=day, text="label", n="above", a=zero("change_1d"), b=zero("change_5d"), x="ma5", y="position"),
        rows("point", recent.where(F.col("rn") <= SERIES_DAYS), key=day, n="above", x="ma5"),
        rows("top", best, key="entity", text="industry", n="rank", a=(F.col("score") >= VIEW_LINE).cast("int"), x="score"),
        rows("industry", named.where(F.col("ord") == newest), key="industry_code", text="industry", n="above", a="new_count", b="retained_count",
             c="exit_count", d=zero("change_5d"), x="top_share", y="top_count"),
        rows("industry point", named.where(F.col("rn") <= SERIES_DAYS), key="industry_code", text=day, n="above"),
    ]
    return reduce(DataFrame.unionByName, parts)
