"""Cleaning, adjustment, resampling and projections of bars."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.functions.ranking import top_k
from tapeloom.functions.scalars import padded, strict
from tapeloom.operators import bars as B
from tapeloom.operators import calendar as C
from tapeloom.operators.membership import industry_on
from tapeloom.plans import similarity as sim
from tapeloom.plans.registry import query
from tapeloom.sources.tables import Market

_OHLC = "open:f high:f low:f close:f"


def dirty(m: Market) -> DataFrame:
    """Bars as they may arrive: two date spellings, repeats, swapped envelope, gaps, bad dates."""
    b = m.bars
    swap = F.col("pos") % 5 == 0
    first = b.select(
        "entity", F.date_format("bar_date", "yyyy-MM-dd").alias("trade_date"), F.lit(1).alias("ingest"),
        F.when(~((F.col("entity") % 11 == 0) & (F.col("pos") % 7 == 0)), F.col("open")).alias("open"),
        F.when(swap, F.col("low")).otherwise(F.col("high")).alias("high"),
        F.when(swap, F.col("high")).otherwise(F.col("low")).alias("low"),
        "close", F.when(F.col("pos") % 4 != 0, F.col("volume")).alias("volume"), "amount",
    )
    again = b.where(F.col("pos") % 6 == 0).select(
        "entity", F.date_format("bar_date", "yyyyMMdd").alias("trade_date"), F.lit(2).alias("ingest"),
        "open", "high", "low", (F.col("close") * 1.01).alias("close"), F.lit(-1.0).alias("volume"), "amount",
    )
    broken = b.where(F.col("pos") % 9 == 0).select(
        "entity", F.lit("19980231x").alias("trade_date"), F.lit(3).alias("ingest"),
        "open", "high", "low", "close", "volume", "amount",
    )
    return first.unionByName(again).unionByName(broken)


_CLEAN = """
with raw as (
  select entity, bar_date, 1 as ingest, case when not (entity % 11 = 0 and pos % 7 = 0) then open end as open,
    case when pos % 5 = 0 then low else high end as high, case when pos % 5 = 0 then high else low end as low,
    close, case when pos % 4 <> 0 then volume end as volume, amount from bars
  union all
  select entity, bar_date, 2, open, high, low, close * 1.01e0, -1.0e0, amount from bars where pos % 6 = 0),
clean as (
  select entity, bar_date, open, greatest(open, high, low, close) as high, least(open, high, low, close) as low, close,
    greatest(coalesce(volume, 0), 0) as volume, amount
  from raw where open is not null
  qualify row_number() over (partition by entity, bar_date order by ingest desc) = 1)
"""


@query("prj_normalize_bars", f"entity:i bar_date:d {_OHLC} volume:f amount:f", _CLEAN + "select * from clean")
def _(m: Market) -> DataFrame:
    return B.normalize_bars(dirty(m))


@query("prj_chart_bars", "entity:i bar_date:d high:f low:f ma20:f",
       _CLEAN + """select entity, bar_date, high, low, case when n = 20 and ma between low / 4 and high * 4 then ma end as ma20
       from (select *, avg(close) over w as ma, count(*) over w as n from clean
             window w as (partition by entity order by bar_date rows between 19 preceding and current row))""")
def _(m: Market) -> DataFrame:
    clean = B.normalize_bars(dirty(m))
    frame = B.by_entity().rowsBetween(-19, 0)
    ma = strict(F.avg("close"), "close", frame, 20)
    return clean.withColumn("ma20", ma).withColumn(
        "ma20", B.chart_average_guard(F.col("ma20"), F.col("low"), F.col("high"))
    )


@query("prj_adjust_qfq", f"entity:i bar_date:d {_OHLC}", "select * from qfq")
def _(m: Market) -> DataFrame:
    return m.qfq


def _fills(measure: str, tail: str) -> str:
    return f"""
select entity, bar_date, {measure}
from (select *, last_value(f ignore nulls) over (partition by entity order by bar_date rows between unbounded preceding and unbounded following) as anchor
  from (select *, coalesce(ff, first_value(ff ignore nulls) over (partition by entity order by bar_date rows between current row and unbounded following)) as f
    from (select *, last_value(adj_factor ignore nulls) over (partition by entity order by bar_date rows between unbounded preceding and current row) as ff from barsf)))
{tail}"""


def _round(expr: str, digits: int) -> str:
    return f"round_even(({expr}) * 1e{digits}, 0) / 1e{digits}"


@query("prj_adjust_chart_qfq", "entity:i bar_date:d open:f close:f",
       _fills(f"{_round('open * (f / anchor)', 4)} as open, {_round('close * (f / anchor)', 4)} as close", ""))
def _(m: Market) -> DataFrame:
    return B.adjust_prices(m.bars_with_factor, "chart_qfq")


_PAGE_SIZE = 100
_PAGED = f"""
raw as (select b.*, lag(close) over (partition by entity order by bar_date) as pre_close,
    (row_number() over (partition by entity order by bar_date desc) - 1) // {_PAGE_SIZE} + 1 as page from barsf b),
whole as (select *, coalesce(ff, first_value(ff ignore nulls) over (partition by entity order by bar_date rows between current row and unbounded following)) as f
    from (select *, last_value(adj_factor ignore nulls) over (partition by entity order by bar_date rows between unbounded preceding and current row) as ff from raw)),
anchors as (select entity, arg_max(adj_factor, bar_date) filter (where adj_factor is not null) as anchor,
    max(bar_date) filter (where adj_factor is not null) as until from barsf group by 1)"""


def _adjusted_sql(multiplier: str, source: str = "whole join anchors using (entity)") -> str:
    """Prices of the full series times a multiplier: what the pages have to add up to."""
    prices = ", ".join(f"{_round(f'{c} * ({multiplier})', 4)} as {c}" for c in (*B.PRICES, "pre_close"))
    return f"""select *, {_round('change / pre_close * 100', 2)} as pct_chg from (select *, {_round('close - pre_close', 2)} as change from (
        select entity, bar_date, page, until, volume, amount, {prices} from {source}))"""


_BAR = f"{_OHLC} pre_close:f change:f pct_chg:f"


@query("prj_adjust_page", f"page:i entity:i bar_date:d {_BAR} used:s warning:s",
       f"""with {_PAGED} select page, entity, bar_date, open, high, low, close, pre_close, change, pct_chg, 'qfq' as used,
         case when until < (select max(bar_date) from cal) then 'factors end early: the last one goes on' end as warning from ({_adjusted_sql('f / anchor')})""")
def _(m: Market) -> DataFrame:
    pages = B.in_pages(B.with_previous_close(m.bars0), _PAGE_SIZE)
    return B.adjust_pages(pages, m.factors, C.nth_newest(m.cal, 0))


@query("prj_adjust_hfq", f"entity:i bar_date:d {_BAR}",
       f"with {_PAGED} select entity, bar_date, open, high, low, close, pre_close, change, pct_chg from ({_adjusted_sql('f')})")
def _(m: Market) -> DataFrame:
    pages = B.in_pages(B.with_previous_close(m.bars0), _PAGE_SIZE)
    return B.adjust_pages(pages, m.factors, C.nth_newest(m.cal, 0), "hfq")


@query("prj_adjust_errors", "entity:i error:s n_missing:i n_not_positive:i since:d",
       """select entity, 'missing factor' as error, count(*) as n_missing, 0 as n_not_positive, min(bar_date) as since from (
            select *, first_value(adj_factor ignore nulls) over (partition by entity order by bar_date rows between current row and unbounded following) as f
            from barsf where bar_date <= (select d from dayref)) where f is null group by 1""")
def _(m: Market) -> DataFrame:
    return B.adjustment_errors(m.bars_in_place, m.as_of)


@query("prj_adjust_review_qfq", "entity:i bar_date:d open:f close:f",
       f"""select entity, bar_date, {_round('open * (f / anchor)', 2)} as open, {_round('close * (f / anchor)', 2)} as close
       from (select *, last_value(f) over (partition by entity order by bar_date rows between unbounded preceding and unbounded following) as anchor
         from (select *, first_value(adj_factor ignore nulls) over (partition by entity order by bar_date rows between current row and unbounded following) as f from barsf))
       where f is not null""")
def _(m: Market) -> DataFrame:
    return B.adjust_prices(m.bars_with_factor, "review_qfq")


_SAMPLE = """
with win as (select *, row_number() over (partition by entity order by bar_date desc) as rn, max(bar_date) over (partition by entity) as last_day
  from barsf where bar_date <= (select d from dayref)),
cut as (select * from win where rn <= 120 qualify count(*) over (partition by entity) = 120),
ff as (select *, last_value(adj_factor ignore nulls) over (partition by entity order by bar_date rows between unbounded preceding and current row) as ff from cut),
fb as (select *, coalesce(ff, first_value(ff ignore nulls) over (partition by entity order by bar_date rows between current row and unbounded following)) as f from ff),
adj as (select *, f / last_value(f) over (partition by entity order by bar_date rows between unbounded preceding and unbounded following) as m from fb),
anon as (select entity, bar_date, -(rn - 1) as t,
  open * m * 100 / first_value(close * m) over (partition by entity order by bar_date) as open,
  high * m * 100 / first_value(close * m) over (partition by entity order by bar_date) as high,
  low * m * 100 / first_value(close * m) over (partition by entity order by bar_date) as low,
  close * m * 100 / first_value(close * m) over (partition by entity order by bar_date) as close,
  volume / coalesce(median(case when volume > 0 then volume end) over (partition by entity), 1) as volume,
  open * m as adj_open, close * m as adj_close from adj)
"""


def sample_windows(m: Market, n: int = 120) -> DataFrame:
    """Last n bars up to the as-of date, factors filled inside the window only."""
    newest = Window.partitionBy("entity").orderBy(F.col("bar_date").desc())
    cut = (
        m.bars_with_factor.where(F.col("bar_date") <= m.as_of)
        .withColumn("rn", F.row_number().over(newest))
        .where(F.col("rn") <= n)
        .withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("entity")))
        .where(F.col("_n") == n)
    )
    return B.adjust_prices(cut, "sample_qfq")


def anonymous_windows(m: Market, n: int = 120) -> DataFrame:
    """Price scaled to a first close of 100, volume to its median non-zero value, dates to t = -(n-1)..0."""
    w = B.by_entity()
    whole = Window.partitionBy("entity")
    df = sample_windows(m, n).withColumn("_base", F.first("close").over(w))
    mid = F.expr("percentile(case when volume > 0 then volume end, 0.5)").over(whole)
    df = df.withColumn("volume", F.col("volume") / F.coalesce(mid, F.lit(1.0))).withColumn("t", 1 - F.col("rn"))
    for name in B.PRICES:
        df = df.withColumn(name, F.col(name) * 100 / F.col("_base"))
    return df.select("entity", "bar_date", "t", *B.PRICES, "volume")


@query("prj_adjust_sample_qfq", "entity:i bar_date:d open:f close:f",
       _SAMPLE + "select entity, bar_date, adj_open as open, adj_close as close from anon")
def _(m: Market) -> DataFrame:
    return sample_windows(m)


@query("prj_anonymise_window", f"entity:i t:i {_OHLC} volume:f", _SAMPLE + "select entity, t, open, high, low, close, volume from anon")
def _(m: Market) -> DataFrame:
    return anonymous_windows(m)


@query("prj_latest_factor", "entity:i adj_factor:f",
       "select entity, arg_max(adj_factor, bar_date) filter (where adj_factor is not null) as adj_factor from factors where bar_date <= (select d from dayref) group by 1")
def _(m: Market) -> DataFrame:
    known = m.factors.where(F.col("adj_factor").isNotNull() & (F.col("bar_date") <= m.as_of))
    return known.groupBy("entity").agg(F.max_by("adj_factor", "bar_date").alias("adj_factor"))


@query("prj_change_pct", "entity:i bar_date:d change:f pct_chg:f",
       """select entity, bar_date, close - p as change, (close - p) / p * 100 as pct_chg
          from (select *, lag(close) over (partition by entity order by bar_date) as p from bars0)""")
def _(m: Market) -> DataFrame:
    return B.with_change(B.with_previous_close(m.bars0))


@query("prj_index100", "entity:i bar_date:d index_100:f",
       "select entity, bar_date, close / first_value(close) over (partition by entity order by bar_date) * 100 as index_100 from qfq")
def _(m: Market) -> DataFrame:
    return B.index_100(m.qfq, ["entity"])


@query("prj_resolve_code", "raw:s entity:i",
       """with basic as (select entity, lpad(cast(entity as varchar), cast(greatest(6, length(cast(entity as varchar))) as integer), '0') as symbol, lpad(cast(entity as varchar), cast(greatest(6, length(cast(entity as varchar))) as integer), '0') || '.SH' as code from securities),
          asked as (select case when entity % 3 = 0 then lower(code) when entity % 3 = 1 then cast(entity as varchar) || ' ' else ' ' || symbol end as raw from basic)
          select a.raw, coalesce(x.entity, y.entity) as entity from asked a
          left join basic x on upper(trim(a.raw)) = x.code left join basic y on lpad(upper(trim(a.raw)), cast(greatest(6, length(trim(a.raw))) as integer), '0') = y.symbol""")
def _(m: Market) -> DataFrame:
    symbol = padded("entity")
    basic = m.securities.select("entity", symbol.alias("symbol"), F.concat(symbol, F.lit(".SH")).alias("code"))
    raw = (
        F.when(F.col("entity") % 3 == 0, F.lower("code"))
        .when(F.col("entity") % 3 == 1, F.concat(F.col("entity").cast("string"), F.lit(" ")))
        .otherwise(F.concat(F.lit(" "), F.col("symbol")))
    )
    asked = basic.select(raw.alias("raw")).withColumn("q", F.upper(F.trim("raw")))
    exact = basic.select(F.col("code").alias("q"), F.col("entity").alias("e1"))
    by_symbol = basic.select(F.col("symbol").alias("q6"), F.col("entity").alias("e2"))
    found = asked.join(exact, "q", "left").withColumn("q6", padded("q")).join(by_symbol, "q6", "left")
    return found.select("raw", F.coalesce("e1", "e2").alias("entity"))


@query("prj_stock_profile", "entity:i name:s close:f total_mv:f industry:s is_st:b warnings:s",
       """select s.entity, s.name, b.close, c.total_mv, coalesce(mm.industry, 'missing') as industry, f.entity is not null as is_st,
            concat_ws(';', case when b.entity is null then 'no quote' end, case when f.entity is not null then 'flagged' end) as warnings
          from securities s
          left join (select * from bars0 where bar_date = (select d from dayref)) b on s.entity = b.entity
          left join (select * from caps where bar_date = (select d from dayref)) c on s.entity = c.entity
          left join (select * from flags where bar_date = (select d from dayref)) f on s.entity = f.entity
          left join (select entity, arg_max(industry, in_date) as industry from membership where in_date <= (select d from dayref)
                     and (out_date is null or out_date > (select d from dayref)) group by 1) mm on s.entity = mm.entity""")
def _(m: Market) -> DataFrame:
    day = m.as_of
    on_day = F.col("bar_date") == day
    quote = m.bars0.where(on_day).select("entity", "close", (F.col("amount") / 1000.0).alias("total_mv"))
    flagged = m.flags.where(on_day).select("entity", F.lit(True).alias("st"))
    base = industry_on(m.securities.withColumn("bar_date", day), m.membership)
    df = base.join(quote, "entity", "left").join(flagged, "entity", "left")
    notes = F.array_compact(F.array(
        F.when(F.col("close").isNull(), "no quote"), F.when(F.col("st"), "flagged")
    ))
    return df.withColumn("is_st", F.coalesce("st", F.lit(False))).withColumn("warnings", F.array_join(notes, ";"))


@query("prj_candidate_bars", "template_id:i rank:i entity:i n:i first_close:f last_close:f",
       """select template_id, rank, entity, (select count(*) from qfqnow q where q.entity = r.entity and q.pos between r.pos - r.n + 1 and r.pos) as n,
            (select close from qfqnow q where q.entity = r.entity and q.pos = r.pos - r.n + 1) as first_close,
            (select close from qfqnow q where q.entity = r.entity and q.pos = r.pos) as last_close
          from (select *, row_number() over (partition by template_id order by score desc, entity) as rank
                from nowscores) r where rank <= 20""")
def _(m: Market) -> DataFrame:
    best = top_k(sim.latest(m), ["template_id"], [F.col("score").desc(), F.col("entity")], 20)
    bars = m.qfq_now.select("entity", "bar_date", *B.PRICES, "volume")
    joined = best.join(bars, "entity").where(F.col("bar_date").between(F.col("start_date"), F.col("end_date")))
    nested = joined.groupBy("template_id", "rank", "entity").agg(
        F.array_sort(F.collect_list(F.struct("bar_date", *B.PRICES, "volume"))).alias("bars")
    )
    return nested.select(
        "template_id", "rank", "entity", F.size("bars").alias("n"),
        F.col("bars")[0]["close"].alias("first_close"), F.element_at("bars", -1)["close"].alias("last_close"),
    )


@query("prj_sparkline", "entity:i sparkline:s",
       """select entity, string_agg(cast(cast(floor(close * 100 + 0.5e0) as bigint) as varchar), ',' order by bar_date) as sparkline
          from (select * from bars0 qualify row_number() over (partition by entity order by bar_date desc) <= 8) group by 1""")
def _(m: Market) -> DataFrame:
    tail = top_k(m.bars0, ["entity"], [F.col("bar_date").desc()], 8)
    cents = F.floor(F.col("close") * 100 + 0.5).cast("string")
    line = F.array_sort(F.collect_list(F.struct("bar_date", cents.alias("c"))))["c"]
    return tail.groupBy("entity").agg(F.array_join(line, ",").alias("sparkline"))


def cap_tier(mv):
    """Size tier in units of 10^4: <50, <200, <1000, larger, missing (fixed cut points)."""
    yi = mv / 1e4
    return (
        F.when(mv.isNull(), "missing").when(yi < 50, "<50").when(yi < 200, "50-200")
        .when(yi < 1000, "200-1000").otherwise(">=1000")
    )


@query("prj_cap_tier", "entity:i bar_date:d tier:s",
       """select entity, bar_date, case when total_mv is null then 'missing' when total_mv / 1e4 < 50 then '<50'
            when total_mv / 1e4 < 200 then '50-200' when total_mv / 1e4 < 1000 then '200-1000' else '>=1000' end as tier from valuation""")
def _(m: Market) -> DataFrame:
    return m.valuation.withColumn("tier", cap_tier(F.col("total_mv")))


def heat_level(count):
    """Fixed heat bands: 0, 1-2, 3-4, 5-7, 8-10, more."""
    return (
        F.when(count <= 0, 0).when(count <= 2, 1).when(count <= 4, 2)
        .when(count <= 7, 3).when(count <= 10, 4).otherwise(5)
    )


@query("prj_heat_level", "entity:i bar_date:d level:i",
       """select entity, bar_date, case when v <= 0 then 0 when v <= 2 then 1 when v <= 4 then 2 when v <= 7 then 3 when v <= 10 then 4 else 5 end as level
          from (select entity, bar_date, volume % 13 as v from bars0)""")
def _(m: Market) -> DataFrame:
    return m.bars0.withColumn("level", heat_level(F.col("volume") % 13))


_KEY = {
    "1w": "bar_date + cast((5 - isodow(bar_date) + 7) % 7 as integer)",
    "1m": "date_trunc('month', bar_date)", "1q": "date_trunc('quarter', bar_date)", "1y": "date_trunc('year', bar_date)",
}


def _resample_sql(period: str, source: str = "pb") -> str:
    return f"""(select *, close - pre_close as change, (close - pre_close) / pre_close * 100 as pct_chg from (
      select entity, {_KEY[period]} as bucket, max(bar_date) as bar_date, arg_min(open, bar_date) as open, max(high) as high, min(low) as low,
        arg_max(close, bar_date) as close, arg_min(pre_close, bar_date) filter (where true) as pre_close, sum(volume) as volume, sum(amount) as amount
      from {source} group by 1, 2))"""


_PB = "with pb as (select *, coalesce(lag(close) over (partition by entity order by bar_date), open) as pre_close from bars0) "


def _with_prev(m: Market) -> DataFrame:
    df = B.with_previous_close(m.bars_by_security)
    return df.withColumn("pre_close", F.coalesce("pre_close", "open"))


def _register_resample(period: str, name: str) -> None:
    @query(f"agg_resample_{name}", f"entity:i bar_date:d {_OHLC} pre_close:f volume:f amount:f change:f pct_chg:f",
           _PB + f"select * from {_resample_sql(period)}")
    def _(m: Market) -> DataFrame:
        return B.resample_bars(_with_prev(m), period)


for _period, _name in (("1w", "week"), ("1m", "month"), ("1q", "quarter"), ("1y", "year")):
    _register_resample(_period, _name)


@query("agg_resample", "period:s entity:i bar_date:d open:f close:f volume:f pct_chg:f",
       _PB + " union all ".join(f"select '{p}' as period, entity, bar_date, open, close, volume, pct_chg from {_resample_sql(p)}" for p in _KEY))
def _(m: Market) -> DataFrame:
    daily = _with_prev(m)
    parts = [B.resample_bars(daily, p).withColumn("period", F.lit(p)) for p in _KEY]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query("top_bars_page", "entity:i returned:i returned_start:d returned_end:d last_close:f last_change:f oldest_available:d newest_available:d has_more_before:b has_more_after:b",
       f"""with {_PAGED}, paged as ({_adjusted_sql('f / anchor')})
          select p.entity, p.returned, p.returned_start, p.returned_end, p.last_close, p.last_change, b.oldest_available, b.newest_available,
          returned_start > oldest_available as has_more_before, returned_end < newest_available as has_more_after
          from (select entity, count(*) as returned, min(bar_date) as returned_start, max(bar_date) as returned_end, arg_max(close, bar_date) as last_close, arg_max(change, bar_date) as last_change
            from (select * from {_resample_sql('1m', '(select * from paged where bar_date <= (select d from dayref))')}
              qualify row_number() over (partition by entity order by bar_date desc) <= 24) group by 1) p
          join (select entity, min(bar_date) as oldest_available, max(bar_date) as newest_available from bars0 group by 1) b on p.entity = b.entity""")
def _(m: Market) -> DataFrame:
    # The page ends at the as-of date; its anchor is that of every other page.
    visible = B.with_previous_close(m.bars0).where(F.col("bar_date") <= m.as_of).withColumn("page", F.lit(0))
    adjusted = B.adjust_pages(visible, m.factors, C.nth_newest(m.cal, 0))
    return B.bars_page(adjusted, m.bars0, "1m", 24)
