"""Shared SQL frames for the oracle statements (DuckDB dialect)."""

FRAMES: dict[str, str] = {}

FRAMES["bars0"] = """
select l_suppkey as entity,
  cast(l_shipdate as date) + cast((5 - isodow(cast(l_shipdate as date)) + 7) % 7 as integer) as bar_date,
  arg_min(l_extendedprice/l_quantity, struct_pack(a:=l_shipdate,b:=l_orderkey,c:=l_linenumber,d:=l_partkey,e:=l_extendedprice)) as open,
  max(l_extendedprice/l_quantity) as high, min(l_extendedprice/l_quantity) as low,
  arg_max(l_extendedprice/l_quantity, struct_pack(a:=l_shipdate,b:=l_orderkey,c:=l_linenumber,d:=l_partkey,e:=l_extendedprice)) as close,
  sum(l_quantity) as volume, sum(l_extendedprice) as amount
from lineitem group by 1, 2"""

FRAMES["bars"] = """
select *, row_number() over (partition by entity order by bar_date) as pos,
  count(*) over (partition by entity) as n_bars from bars0"""

FRAMES["cal"] = """
select bar_date, row_number() over (order by bar_date) - 1 as ord
from (select distinct bar_date from bars0)"""

FRAMES["dayref"] = """
select max(bar_date) as d, max(ord) as o from cal where bar_date < (select max(bar_date) from cal)"""

FRAMES["factors"] = """
select entity, bar_date,
  case when pos % 17 = 0 and pos < n_bars then cast(null as double)
       else 1.0e0 + 0.1e0*floor(pos/50.0e0) end as adj_factor
from bars"""

FRAMES["barsf"] = """
select b.*, f.adj_factor from bars b left join factors f on b.entity = f.entity and b.bar_date = f.bar_date"""

FRAMES["qfq"] = """
select entity, bar_date, open*m as open, high*m as high, low*m as low, close*m as close,
  volume, amount, pos, n_bars
from (select *, f / last_value(f) over (partition by entity order by bar_date
        rows between unbounded preceding and unbounded following) as m
      from (select *, first_value(adj_factor ignore nulls) over (partition by entity order by bar_date
              rows between current row and unbounded following) as f from barsf))"""

# the same with what is known at the as-of date
FRAMES["qfqnow"] = FRAMES["qfq"].replace("barsf)", "barsf where bar_date <= (select d from dayref))") + " where f is not null"

FRAMES["securities"] = """
select s_suppkey as entity, s_name as name,
  case s_suppkey % 3 when 0 then 'main' when 1 then 'growth' else 'star' end as board,
  date '1995-01-06' + cast((s_suppkey % 5)*30 as integer) as list_date,
  case when s_suppkey % 10 = 9 then date '2000-12-29' end as delist_date
from supplier"""

FRAMES["membership"] = """
select s_suppkey as entity, n.n_nationkey as industry_code, n.n_name as industry,
  date '1995-01-01' as in_date, case when s_suppkey % 4 = 0 then date '1998-06-26' end as out_date
from supplier join nation n on s_nationkey = n.n_nationkey
union all
select s_suppkey, n.n_nationkey, n.n_name, date '1998-06-26', cast(null as date)
from supplier join nation n on (s_nationkey + 7) % 25 = n.n_nationkey
where s_suppkey % 4 = 0"""

FRAMES["flags"] = """
select b.entity, b.bar_date from bars0 b join cal c on b.bar_date = c.bar_date
where (b.entity*7 + c.ord) % 40 = 0"""

FRAMES["valuation"] = """
select o_custkey as entity, last_day(cast(o_orderdate as date)) as bar_date, sum(o_totalprice) as total_mv
from orders group by 1, 2"""

FRAMES["caps"] = """select entity, bar_date, amount/1000.0e0 as total_mv from bars0"""

FRAMES["templates"] = """
select entity as template_id, n, t, bar_date, ln(close) as x, close,
  (ln(close) - avg(ln(close)) over (partition by entity)) / stddev_pop(ln(close)) over (partition by entity) as z
from (select *, pos - 20 as t, case entity when 1 then 50 when 2 then 80 when 3 then 55 else 80 end as n
      from qfq where entity between 1 and 4)
where t between 1 and n"""

FRAMES["zlists"] = """select template_id, any_value(n) as n, list(z order by t) as zl from templates group by template_id"""

FRAMES["xlists"] = """
select entity, bar_date, pos,
  list(ln(close)) over w50 as l50, stddev_pop(ln(close)) over w50 as s50,
  list(ln(close)) over w55 as l55, stddev_pop(ln(close)) over w55 as s55,
  list(ln(close)) over w80 as l80, stddev_pop(ln(close)) over w80 as s80
from qfq
window w50 as (partition by entity order by bar_date rows between 49 preceding and current row),
  w55 as (partition by entity order by bar_date rows between 54 preceding and current row),
  w80 as (partition by entity order by bar_date rows between 79 preceding and current row)"""

FRAMES["allscores"] = """
select template_id, entity, bar_date, pos, n,
  case when s > 1e-12 then d / (n * s) else 0.0e0 end as score
from (select z.template_id, x.entity, x.bar_date, x.pos, z.n,
        case z.n when 50 then x.s50 when 55 then x.s55 else x.s80 end as s,
        list_dot_product(z.zl, case z.n when 50 then x.l50 when 55 then x.l55 else x.l80 end) as d
      from xlists x join zlists z on x.pos >= z.n)"""

FRAMES["xlistsnow"] = FRAMES["xlists"].replace("from qfq", "from qfqnow")
FRAMES["nowscores"] = FRAMES["allscores"].replace("xlists", "xlistsnow").replace("x.pos >= z.n", "x.pos >= z.n and x.bar_date = (select d from dayref)")
# future bars that must not matter: three times the price, another factor
FRAMES["barsplus"] = """
select entity, bar_date, open, high, low, close, volume, amount, pos, n_bars, adj_factor from barsf
union all select entity, bar_date + 70, open * 3, high * 3, low * 3, close * 3, volume, amount, pos + 1000, n_bars, 9.0e0 from barsf
where bar_date = (select d from dayref)"""
FRAMES["qfqplus"] = FRAMES["qfqnow"].replace("barsf", "barsplus")
FRAMES["xlistsplus"] = FRAMES["xlists"].replace("from qfq", "from qfqplus")
FRAMES["plusscores"] = FRAMES["nowscores"].replace("xlistsnow", "xlistsplus")

FRAMES["scores"] = """
select a.template_id, a.entity, a.bar_date, a.pos, a.n, a.score
from allscores a join securities s on a.entity = s.entity
where s.list_date <= a.bar_date and (s.delist_date is null or s.delist_date > a.bar_date)"""

FRAMES["ranked"] = """
select s.*, c.ord, row_number() over (partition by template_id, s.bar_date order by score desc, entity) as rank,
  count(*) over (partition by template_id, s.bar_date) as n_group
from scores s join cal c on s.bar_date = c.bar_date"""

FRAMES["panel"] = """
select r.*, coalesce(m.industry_code, -1) as industry_code, coalesce(m.industry, 'missing') as industry
from ranked r left join membership m on r.entity = m.entity and m.in_date <= r.bar_date
  and (m.out_date is null or m.out_date > r.bar_date)
qualify row_number() over (partition by r.template_id, r.entity, r.bar_date order by m.in_date desc) = 1"""

FRAMES["mkt"] = """
select template_id, s.bar_date, c.ord, count(*) as eligible, count(case when score >= 0.7e0 then 1 end) as n70,
  count(case when score >= 0.75e0 then 1 end) as n75, count(case when score >= 0.8e0 then 1 end) as n80,
  max(score) as max_score, median(score) as median_score, quantile_cont(score, 0.05) as p05, quantile_cont(score, 0.95) as p95,
  quantile_cont(score, 0.99) as p99, avg(case when score < 0 then 1.0e0 else 0.0e0 end) as negative_share, min(score) as min_score
from scores s join cal c on s.bar_date = c.bar_date group by all"""

FRAMES["daily"] = """select * from panel where rank <= 100"""

FRAMES["events_per_bar"] = """
select entity, bar_date, close, pct, case when pct >= 10 - 1e-9 then 1 else 0 end as up, case when pct <= -10 + 1e-9 then 1 else 0 end as down
from (select *, (close / lag(close) over (partition by entity order by bar_date) - 1) * 100 as pct from bars0)"""


def _w(n: int, skip: int = 0) -> str:
    return f"over (partition by entity order by bar_date rows between {n - 1 + skip} preceding and {skip} preceding)" if skip else (
        f"over (partition by entity order by bar_date rows between {n - 1} preceding and current row)")


_E = "over (partition by entity order by bar_date)"
FRAMES["patw"] = f"""
select entity, bar_date, pos, close, high, low, volume, least(pos, 120) as n_past,
  close / lag(close, 20) {_E} - 1 as ret20, close / lag(close, 60) {_E} - 1 as ret60, close / lag(close, 5) {_E} - 1 as b5, close / lag(close, 79) {_E} - 1 as r79,
  close / max(close) {_w(35, 5)} - 1 as brk, avg(volume) {_w(5)} / avg(volume) {_w(20, 5)} as vr, close / avg(close) {_w(20)} - 1 as ext,
  avg(close) {_w(20)} as ma20, avg(close) {_w(40)} as ma40, avg(close) {_w(60)} as ma60,
  regr_slope(close, pos) {_w(20)} * 19 / first_value(close) {_w(20)} as s20, regr_r2(close, pos) {_w(20)} as f20,
  regr_slope(close, pos) {_w(60)} * 59 / first_value(close) {_w(60)} as s60, regr_r2(close, pos) {_w(60)} as f60,
  regr_slope(close, pos) {_w(80)} * 79 / first_value(close) {_w(80)} as s80, regr_r2(close, pos) {_w(80)} as f80,
  max(high) {_w(30)} as peak, min(close) {_w(60)} as base, stddev_pop(ret) {_w(10)} as cv,
  max(high) {_w(80)} as rh, min(low) {_w(80)} as rl, list(low) {_w(80)} as lows
from (select *, close / lag(close) {_E} - 1 as ret from bars)"""


def _cl(x: str) -> str:
    return f"greatest(0.0e0, least(1.0e0, {x}))"


FRAMES["pats"] = f"""
select entity, bar_date, pos, n_past, close,
  case when pos >= 60 then (30 * {_cl('ret20 / 0.16e0')} + 30 * {_cl('(brk + 0.015e0) / 0.065e0')} + 18 * {_cl('(vr - 0.8e0) / 0.75e0')}
    + 12 * {_cl('f20')} * {_cl('s20 / 0.15e0')} + 10 * (1 - {_cl('greatest(ext, 0) / 0.22e0')}))
    * case when ret20 < 0.03 or brk < -0.035 or ext > 0.22e0 * 1.5e0 then 0.62e0 else 1 end end as score_breakout,
  case when pos >= 80 then (28 * {_cl('ret60 / 0.12e0')} + 24 * (1 - {_cl('abs((peak - close) / peak - 0.1025e0) / 0.0775e0')})
    + 18 * case when close >= ma60 then least(1, 1 - {_cl('least(abs(close / ma20 - 1), abs(close / ma40 - 1)) / 0.1e0')} + 0.15e0) else 1 - {_cl('least(abs(close / ma20 - 1), abs(close / ma40 - 1)) / 0.1e0')} end
    + 14 * (1 - {_cl('abs((peak - close) / greatest(peak - base, 1e-9) - 0.44e0) / 0.44e0')}) + 8 * (1 - {_cl('cv / 0.035e0')}) + 8 * {_cl('f60')} * {_cl('s60 / 0.2e0')})
    * case when ret60 < 0.04 or close < ma60 * 0.95e0 or (peak - close) / peak > 0.18e0 * 1.4e0 then 0.62e0 else 1 end end as score_pullback,
  case when pos >= 100 then (36 * (1 - {_cl('(close - rl) / greatest(rh - rl, 1e-9) / 0.32e0')}) + 24 * {_cl('(b5 + 0.01e0) / 0.025e0')} + 14 * {_cl('greatest(rh - rl, 1e-9) / rl / 0.15e0')}
    + 14 * {_cl(f"(1 - {_cl('abs(r79) / 0.25e0')}) * (1 - abs(s80))")} + 12 * {_cl('len(list_filter(lows, lambda x: x <= rl + greatest(rh - rl, 1e-9) * 0.08e0)) / 4.0e0')})
    * case when (close - rl) / greatest(rh - rl, 1e-9) > 0.32e0 * 1.5e0 or greatest(rh - rl, 1e-9) / rl < 0.15e0 * 0.6e0 then 0.58e0 else 1 end end as score_range_bounce
from patw"""

FRAMES["patlong"] = """
select entity, bar_date, pos, n_past, category, raw, round_even(raw * 100, 0) / 100 as score, prio from (
  select entity, bar_date, pos, n_past, 'breakout' as category, score_breakout as raw, 42 as lim, 0 as prio from pats
  union all select entity, bar_date, pos, n_past, 'pullback', score_pullback, 40, -1 from pats
  union all select entity, bar_date, pos, n_past, 'range_bounce', score_range_bounce, 38, -2 from pats)
where raw >= lim"""

FRAMES["samples"] = """
select bar_date, ord, (row_number() over (order by bar_date)) - 1 as sample from (
  select *, row_number() over (order by bar_date) as seq from cal
  where ord <= (select o from dayref) and ord > (select o from dayref) - 120)
where (seq - 1) % 5 = 4"""

FRAMES["universe"] = """
select x.sample, x.bar_date, s.entity, s.name, m.industry_code, m.industry
from samples x join securities s on s.list_date <= x.bar_date and (s.delist_date is null or s.delist_date > x.bar_date)
left join flags f on f.entity = s.entity and f.bar_date = x.bar_date
left join membership m on m.entity = s.entity and m.in_date <= x.bar_date and (m.out_date is null or m.out_date >= x.bar_date)
where s.board in ('main', 'star') and f.entity is null
qualify row_number() over (partition by x.sample, s.entity order by m.in_date desc) = 1"""

FRAMES["rottop"] = """
select * from (select sample, bar_date, entity, industry_code, score, row_number() over (partition by sample order by score desc, entity) as rank
  from (select u.sample, u.bar_date, u.entity, u.industry_code, p.score
    from universe u join (select x.sample, b.entity, max(b.bar_date) as last_bar from samples x join bars0 b on b.bar_date <= x.bar_date group by 1, 2) l
      on l.sample = u.sample and l.entity = u.entity
    join patlong p on p.entity = u.entity and p.bar_date = l.last_bar and p.category = 'breakout'))
where rank <= 100"""

FRAMES["rotmat"] = """
select i.industry_code, i.industry, x.sample, x.bar_date, coalesce(c.n, 0) as n, coalesce(c.n, 0) - coalesce(lag(coalesce(c.n, 0)) over (partition by i.industry_code order by x.sample), 0) as change
from (select distinct industry_code, industry from membership) i cross join samples x
left join (select sample, industry_code, count(*) as n from rottop group by 1, 2) c on c.sample = x.sample and c.industry_code = i.industry_code"""

FRAMES["rotfeat"] = """
select f.*, case when abs(slope) < 0.25 then 0.0e0 else round_even((case when sign(n3 - n2) = sign(slope) then 1.0e0 else 0 end + case when sign(n2 - n1) = sign(slope) then 1 else 0 end
    + case when sign(n1 - n0) = sign(slope) then 1 else 0 end) / 3 * 100, 0) / 100 end as persistence,
  case when n3 > 0 then n3 when n2 > 0 then n2 when n1 > 0 then n1 else n0 end as effective, n3 - n0 as recent_change, n3 as current_count
from (select industry_code, any_value(industry) as industry, sum(n) as cumulative,
    max(case when sample = (select max(sample) from samples) - 3 then n end) as n0, max(case when sample = (select max(sample) from samples) - 2 then n end) as n1, max(case when sample = (select max(sample) from samples) - 1 then n end) as n2, max(case when sample = (select max(sample) from samples) then n end) as n3,
    round_even(regr_slope(n, sample) filter (where sample > (select max(sample) from samples) - 4) * 100, 0) / 100 as slope from rotmat group by 1) f"""

FRAMES["rotrank"] = """
select *, case when slope >= 0.25 and n2 <= 1 and n3 - n2 >= 3 then 'rapid_start' when slope >= 0.25 and persistence >= 0.66 then 'steady_rise'
  when slope >= 0.25 then 'rising' when current_rank <= 5 and slope <= -0.25 and greatest(n0, n1, n2, n3) > n3 then 'high_ebb' when slope <= -0.25 then 'falling' else 'flat' end as status
from (select *, row_number() over (order by n3 desc, cumulative desc, industry_code) as current_rank,
  row_number() over (order by abs(slope) desc, persistence desc, effective desc, industry_code) as rotation_rank from rotfeat)"""

FRAMES["indday"] = """
select template_id, bar_date, ord, industry_code, any_value(industry) as industry, count(*) as eligible, count(case when rank <= 100 then 1 end) as top_count
from panel group by 1, 2, 3, 4"""

FRAMES["flowst"] = """
select template_id, lag, o as ord, entity, max(c) as c, max(p) as p, max(cr) as cr, max(pr) as pr,
  case when max(c) is not null and max(p) is not null then 'retained' when max(c) is not null then 'new' else 'exit' end as state
from (select d.template_id, l.lag, d.ord as o, d.entity, d.industry_code as c, null as p, d.rank as cr, null as pr from daily d, (select unnest([10, 20]) as lag) l
  union all select d.template_id, l.lag, d.ord + l.lag, d.entity, null, d.industry_code, null, d.rank from daily d, (select unnest([10, 20]) as lag) l where d.ord + l.lag <= (select max(ord) from cal))
group by 1, 2, 3, 4"""

FRAMES["brdind"] = """
select coalesce(i.template_id, f.template_id) as template_id, coalesce(i.lag, f.lag) as lag, coalesce(i.ord, f.ord) as ord, coalesce(i.industry_code, f.industry_code) as industry_code,
  coalesce(i.eligible, 0) as eligible, coalesce(i.top_count, 0) as top_count, coalesce(f.n, 0) as new_count, coalesce(f.r, 0) as retained_count, coalesce(f.x, 0) as exit_count
from (select i.*, l.lag from indday i, (select unnest([10, 20]) as lag) l) i
full join (select template_id, lag, ord, coalesce(c, p) as industry_code, count(case when state = 'new' then 1 end) as n, count(case when state = 'retained' then 1 end) as r,
    count(case when state = 'exit' then 1 end) as x from flowst group by all) f
  on i.template_id = f.template_id and i.lag = f.lag and i.ord = f.ord and i.industry_code = f.industry_code"""

FRAMES["bcurves"] = """
select template_id, list(z order by i) as zl from (
  select template_id, i, (y - avg(y) over g) / stddev_pop(y) over g as z from (
    select template_id, i, zl[cast(floor(p) as integer) + 1] + (zl[least(cast(floor(p) as integer) + 2, n)] - zl[cast(floor(p) as integer) + 1]) * (p - floor(p)) as y
    from (select *, i * (n - 1) / 79.0e0 as p from (select *, unnest(range(80)) as i from zlists where template_id <= 3)))
  window g as (partition by template_id))
group by template_id"""

FRAMES["bscores"] = """
select x.entity, x.bar_date, avg(pct) as bscore from (
  select *, (rank() over (partition by template_id, bar_date order by s) + (count(*) over (partition by template_id, bar_date, s) - 1) / 2.0e0)
    / count(*) over (partition by template_id, bar_date) as pct
  from (select c.template_id, l.entity, l.bar_date, round_even(case when l.s80 > 1e-12 then list_dot_product(c.zl, l.l80) / (80 * l.s80) else 0 end * 1e9, 0) as s
    from (select * from xlists where pos >= 80) l cross join bcurves c join securities q on q.entity = l.entity
    where q.list_date <= l.bar_date and (q.delist_date is null or q.delist_date > l.bar_date))) x
group by 1, 2"""

FRAMES["healthp"] = """
select r.bar_date, c.ord, w.m.industry_code as industry_code, any_value(w.m.industry) as industry, count(*) as eligible_count,
  count(case when r.b_rank <= 100 then 1 end) as b_count, count(case when r.b_rank <= 100 then 1 end) * 1.0e0 / count(*) as b_breadth
from (select *, row_number() over (partition by bar_date order by floor(bscore * 1e9 + 0.5e0) desc, entity) as b_rank from bscores) r
join cal c on c.bar_date = r.bar_date
join (select x.entity, x.bar_date, arg_max(struct_pack(industry_code := y.industry_code, industry := y.industry), y.in_date) as m
  from bscores x join membership y on y.entity = x.entity and y.in_date <= x.bar_date and (y.out_date is null or y.out_date > x.bar_date) group by 1, 2) w
  on w.entity = r.entity and w.bar_date = r.bar_date
group by r.bar_date, c.ord, w.m.industry_code"""

FRAMES["healthr"] = """
select *, (rank() over (partition by bar_date order by b_breadth) + (count(*) over (partition by bar_date, b_breadth) - 1) / 2.0e0) / count(*) over (partition by bar_date) as rk
from healthp"""


def _hw(a: int, b: int) -> str:
    end = "current row" if b == 0 else f"{b} preceding"
    return f"over (partition by industry_code order by bar_date rows between {a} preceding and {end})"


def _hm(x: str, n: int, back: int = 0) -> str:
    w = _hw(n - 1 + back, back)
    return f"case when count({x}) {w} = {n} then avg({x}) {w} end"


FRAMES["healthl"] = """
select *, lag(rk) over (partition by industry_code order by bar_date) as pr, lag(b_breadth) over (partition by industry_code order by bar_date) as pb,
  lag(b_count) over (partition by industry_code order by bar_date) as pc from healthr"""

FRAMES["healthm"] = f"""
select *, coalesce(count(pr) {_hw(19, 0)} = 20 and count(case when pr >= 0.75 then 1 end) {_hw(19, 0)} >= 12 and quantile_cont(pr, 0.5) {_hw(19, 0)} >= 0.75
    and quantile_cont(pr, 0.5) {_hw(4, 0)} >= 0.75 and avg(pb) {_hw(19, 0)} > 0, false) as mainline,
  coalesce(b_count <= pc - 1 and b_breadth < pb, false) as raw_drop,
  {_hm('rk', 3)} - {_hm('rk', 3, 3)} as dr3, {_hm('rk', 5)} - {_hm('rk', 5, 5)} as dr5,
  {_hm('b_count', 3)} - {_hm('b_count', 3, 3)} as dc3, {_hm('b_count', 5)} - {_hm('b_count', 5, 5)} as dc5,
  {_hm('b_breadth', 3)} - {_hm('b_breadth', 3, 3)} as db3, {_hm('b_breadth', 5)} - {_hm('b_breadth', 5, 5)} as db5,
  {_hm('rk', 5)} - {_hm('rk', 15, 5)} as drf, {_hm('b_breadth', 5)} - {_hm('b_breadth', 15, 5)} as dbf
from healthl"""

FRAMES["health"] = """
select *, coalesce(dc3 < -1e-9 and db3 < -1e-9 and dr3 <= -0.1e0 + 1e-9, false) as smooth3, coalesce(dc5 < -1e-9 and db5 < -1e-9 and dr5 <= -0.1e0 + 1e-9, false) as smooth5,
  coalesce(drf <= -0.15e0 + 1e-9 and dbf < -1e-9 and mainline, false) as cooling from healthm"""

FRAMES["healthd"] = """
select *, case when act and st is not null then pos - st + 1 else 0 end as weak_duration from (
  select *, min(case when act and smooth3 then pos end) over (partition by industry_code, island order by bar_date) as st from (
    select *, sum(case when act then 0 else 1 end) over (partition by industry_code order by bar_date) as island from (
      select *, smooth3 or smooth5 or cooling as act, row_number() over (partition by industry_code order by bar_date) as pos from health)))"""

FRAMES["w120"] = """
select entity, (select d from dayref) as bar_date, list(close order by pos) as c, list(high order by pos) as h, list(low order by pos) as l, list(volume order by pos) as v
from (select *, max(bar_date) over (partition by entity) as d2, row_number() over (partition by entity order by bar_date desc) as rn from qfqnow)
where rn <= 120 and d2 = (select d from dayref) group by entity having count(*) = 120"""

FRAMES["w120e"] = """
select *, coalesce(ev, 119) as e, coalesce(ev, 120) as ce, c[120] as now,
  list_max(h[coalesce(ev, 119) - 19 : coalesce(ev, 119)]) as res, list_position(h[61:120], list_max(h[61:120])) + 59 as pk, list_max(h[1:90]) as early
from (select *, list_filter(range(104, 120), lambda i: c[i + 1] >= list_max(h[i - 19 : i]) * 1.003e0)[1] as ev,
  list_transform(range(1, 120), lambda i: c[i + 1] / c[i] - 1) as r from w120)"""

FRAMES["wl120"] = """
select entity, bar_date, i, c[i + 1] as x, h[i + 1] as hi, l[i + 1] as lo, ce, c from (select *, unnest(range(120)) as i from w120e)"""


def _fit_sql() -> str:
    parts = []
    for n in (10, 20, 60, 120):
        parts.append(f"(regr_slope(x, i) filter (where i >= {120 - n})) * {n - 1} / max(case when i = {120 - n} then x end) as trend_slope_{n}, regr_r2(x, i) filter (where i >= {120 - n}) as trend_fit_{n}")
    for n in (40, 60, 100):
        parts.append(f"(regr_slope(x, i) filter (where i between ce - {n} and ce - 1)) * {n - 1} / max(case when i = ce - {n} then x end) as pre_breakout_trend_slope_{n}, regr_r2(x, i) filter (where i between ce - {n} and ce - 1) as pre_breakout_trend_fit_{n}")
    return ", ".join(parts)


FRAMES["wfit"] = f"select entity, {_fit_sql()} from wl120 group by entity"


def _facts_sql() -> str:
    out = []
    for n in (3, 5, 10, 20, 60, 119):
        out.append(f"now / c[{120 - n}] - 1 as return_{n}")
    for n in (5, 10, 20, 60, 120):
        out.append(f"now / list_avg(c[{121 - n}:120]) - 1 as ma{n}_extension")
    pairs = [(5, 10), (10, 20), (20, 60), (60, 120)]
    out.append("(" + " + ".join(f"case when list_avg(c[{121 - a}:120]) >= list_avg(c[{121 - b}:120]) then 0.25e0 else 0 end" for a, b in pairs) + ") as ma_alignment")
    for n in (20, 60, 120):
        out.append(f"greatest(0, 1 - now / list_max(h[{121 - n}:120])) as drawdown_{n}")
        out.append(f"(now - list_min(l[{121 - n}:120])) / (list_max(h[{121 - n}:120]) - list_min(l[{121 - n}:120])) as range_position_{n}")
    out += ["now / list_max(h[98:117]) - 1 as breakout_vs_prior_20", "now / list_max(h[58:117]) - 1 as breakout_vs_prior_60",
            "119 - pk as days_since_60_high", "case when ev is null then 99 else 119 - ev end as breakout_age",
            "case when ev is null then -1 else list_min(c[ev + 1:120]) / res - 1 end as breakout_hold_margin",
            "case when ev is null then -1 else now / res - 1 end as breakout_current_margin",
            "case when ev is null then 1 else greatest(0, 1 - now / list_max(h[ev + 1:120])) end as breakout_post_event_drawdown",
            "case when ev is not null and ev < 119 and list_min(c[ev + 1:120]) / res - 1 >= -0.015 then 1 else 0 end as breakout_confirmed",
            "c[e + 1] / c[e] - 1 as breakout_day_return", "case when ev is null then 0 else 20 end as breakout_resistance_window",
            "v[e + 1] / list_avg(v[e - 19:e]) as breakout_volume_ratio"]
    for n in (40, 60, 100):
        out += [f"{n} as pre_breakout_context_bars_{n}", f"c[ce] / c[ce - {n - 1}] - 1 as pre_breakout_return_{n}",
                f"(list_max(h[ce - {n - 1}:ce]) - list_min(l[ce - {n - 1}:ce])) / list_avg(c[ce - {n - 1}:ce]) as pre_breakout_range_width_{n}",
                f"(c[ce] - list_min(l[ce - {n - 1}:ce])) / (list_max(h[ce - {n - 1}:ce]) - list_min(l[ce - {n - 1}:ce])) as pre_breakout_range_position_{n}",
                f"greatest(0, 1 - c[ce] / list_max(h[ce - {n - 1}:ce])) as pre_breakout_drawdown_from_high_{n}"]
    out += ["40 as pre_breakout_context_bars", "c[e] / c[e - 5] - 1 as breakout_approach_return_5",
            "len(list_filter(r[e - 10:e - 1], lambda x: x > 0)) / 10.0e0 as breakout_approach_positive_ratio_10",
            "list_aggregate(r[case when ev is null then e - 19 else e - 20 end:e - 1], 'stddev_pop') as pre_breakout_volatility_20",
            "coalesce(list_max(list_filter(r[100:119], lambda x: x > 0)) / list_sum(list_filter(r[100:119], lambda x: x > 0)), 0) as largest_up_day_share_20",
            "now / early - 1 as old_high_gap_120", "120 - list_position(h[1:90], early) as days_since_old_high",
            "len(list_filter(range(2, 90), lambda i: h[i] >= early * 0.97e0 and h[i] >= h[i - 1] and h[i] >= h[i + 1])) as old_high_rejection_count"]
    for n in (10, 20, 60):
        out.append(f"list_aggregate(r[{120 - n}:119], 'stddev_pop') as volatility_{n}")
    for n in (20, 60):
        out.append(f"len(list_filter(r[{120 - n}:119], lambda x: x > 0)) / {n}.0e0 as positive_day_ratio_{n}")
    vol = "list_avg(list_transform(list_filter(range(100, 120), lambda i: r[i] {} 0), lambda i: v[i + 1]))"
    out += ["list_avg(v[116:120]) / list_avg(v[96:115]) as volume_ratio_5_20",
            f"coalesce(coalesce({vol.format('>')}, 0) / {vol.format('<')}, 1) as up_down_volume_ratio_20",
            "(now - list_min(l[116:120])) / (list_max(h[116:120]) - list_min(l[116:120])) as close_location_5",
            "now / list_min(l[111:120]) - 1 as rebound_from_10_low", "c[110] / c[60] - 1 as prior_return_60_ex_last_10",
            "119 - pk as pullback_duration_60", "greatest(0, 1 - now / h[pk + 1]) / greatest(119 - pk, 1) as pullback_speed_60",
            "greatest(0, h[pk + 1] / list_min(l[greatest(pk - 60, 0) + 1:pk + 1]) - 1) as prior_advance_before_peak",
            "(h[pk + 1] - now) / (h[pk + 1] - list_min(l[greatest(pk - 60, 0) + 1:pk + 1])) as retracement_of_prior_advance",
            "list_min(list_transform(range(101, 121), lambda i: c[i] / c[i - 5] - 1)) as worst_5day_return_20",
            f"({_cl('(now / c[117] - 1) / 0.05e0')} + {_cl('(now / c[115] - 1) / 0.08e0')} + case when now >= list_avg(c[111:120]) then 1 else 0 end"
            f" + {_cl('(now - list_min(l[116:120])) / (list_max(h[116:120]) - list_min(l[116:120]))')} + {_cl('(now / list_min(l[111:120]) - 1) / 0.1e0')}) / 5 as turn_confirmation",
            "list_avg(list_transform(range(107, 121), lambda i: greatest(h[i] - l[i], abs(h[i] - c[i - 1]), abs(l[i] - c[i - 1])))) / now as atr_14_pct"]
    return ", ".join(out)


FRAMES["facts"] = f"""
select x.*, f.* exclude (entity), ((1 - {_cl('abs(x.return_60) / 0.15e0')}) + (1 - {_cl('f.trend_fit_60')}) + {_cl('x.days_since_60_high / 40.0e0')}) / 3 as range_staleness_60
from (select entity, bar_date, {_facts_sql()} from w120e) x join wfit f on x.entity = f.entity"""

FRAMES["paths"] = """
select entity, list_max(d120) as max_drawdown_120, list_max(d60) as max_drawdown_60, list_min(list_transform(range(6, 121), lambda i: c[i] / c[i - 5] - 1)) as worst_return_5,
  list_min(list_transform(range(11, 121), lambda i: c[i] / c[i - 10] - 1)) as worst_return_10,
  len(list_filter(range(1, 12), lambda k: c[10 * k + 1] > c[10 * k - 9])) / 11.0e0 as anchor_up_ratio, list_max(d40) as recent_pullback_depth_40,
  40 - tr as recent_pullback_low_age, case when list_max(c[81:80 + tr]) > c[80 + tr] then (c[120] - c[80 + tr]) / (list_max(c[81:80 + tr]) - c[80 + tr]) else 0 end as recent_recovery_fraction
from (select *, list_position(d40, list_max(d40)) as tr from (select *, list_transform(range(1, 121), lambda i: 1 - c[i] / list_max(c[1:i])) as d120,
  list_transform(range(61, 121), lambda i: 1 - c[i] / list_max(c[61:i])) as d60, list_transform(range(81, 121), lambda i: 1 - c[i] / list_max(c[81:i])) as d40 from w120))"""

FRAMES["monthends"] = """select max(bar_date) as bar_date from cal where bar_date <= (select d from dayref) group by strftime(bar_date, '%Y%m')"""
FRAMES["first12m"] = """
select k.* from mkt k join monthends e on k.bar_date = e.bar_date qualify row_number() over (partition by template_id order by k.bar_date) <= 12"""
FRAMES["frozen"] = """
select template_id, quantile_cont(p99, 0.75) as threshold, median(p99) as p99_median, count(*) as months from first12m group by 1"""
FRAMES["snaps"] = """
select frequency, bar_date, row_number() over (partition by frequency order by bar_date) - 1 as seq from (
  select 'weekly' as frequency, max(bar_date) as bar_date from cal where bar_date <= (select d from dayref) group by strftime(bar_date, '%G-%V')
  union all select 'monthly', bar_date from monthends)"""
FRAMES["dsc"] = """
select s.frequency, s.seq, p.*, f.threshold, p.score >= f.threshold as q, (p.n_group - p.rank + 1) * 100.0e0 / p.n_group as percentile
from panel p join snaps s on p.bar_date = s.bar_date join frozen f on p.template_id = f.template_id"""
FRAMES["dstate"] = """
select frequency, seq, bar_date, entity, case when count(case when q then 1 end) = 0 then 'none' when count(case when q then 1 end) > 1 then 'mixed'
  else 't' || cast(max(case when q then template_id end) as varchar) end as state, coalesce(string_agg(case when q then 't' || cast(template_id as varchar) end, '+' order by template_id), 'none') as labels
from dsc group by 1, 2, 3, 4"""
FRAMES["states"] = """select unnest(['none', 'mixed']) as state union all select distinct 't' || cast(template_id as varchar) from templates"""
FRAMES["dind"] = """
select *, qualified * 1.0e0 / eligible as rate, sum(qualified) over g * 1.0e0 / sum(eligible) over g as market_rate, sum(qualified) over g as total_q, sum(eligible) over g as total_n
from (select frequency, seq, bar_date, template_id, industry, count(*) as eligible, count(case when q then 1 end) as qualified from dsc group by all)
window g as (partition by frequency, seq, template_id)"""
