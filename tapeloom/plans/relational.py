"""Filters, joins and aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.functions.ranking import exact_quantiles, order_positions, running_totals, top_k
from tapeloom.functions.scalars import flag, ratio
from tapeloom.operators import bars as B
from tapeloom.operators import calendar as C
from tapeloom.operators import membership as M
from tapeloom.operators.events import bar_events, events_of_few
from tapeloom.plans import similarity as sim
from tapeloom.plans.common import K, best_first, daily_top, panel, scored
from tapeloom.plans.projections import cap_tier
from tapeloom.plans.registry import query
from tapeloom.sources.staging import stage
from tapeloom.sources.tables import Market

# ---------------------------------------------------------------- filters


@query("flt_board", "entity:i board:s", "select entity, board from securities where board in ('main', 'star')")
def _(m: Market) -> DataFrame:
    return m.securities.where(F.col("board").isin("main", "star"))


def cap_range(value, low=None, high=None, inclusive: bool = True):
    """Inclusive range, or the older strict form; a missing value never passes."""
    cond = value.isNotNull()
    if low is not None:
        cond &= (value >= low) if inclusive else (value > low)
    if high is not None:
        cond &= (value <= high) if inclusive else (value < high)
    return cond


@query("flt_market_cap", "entity:i bar_date:d total_mv:f strict:b",
       """select entity, bar_date, total_mv, total_mv > 100 and total_mv < 300 as strict from caps
          where total_mv is not null and total_mv >= 100 and total_mv <= 300""")
def _(m: Market) -> DataFrame:
    mv = F.col("total_mv")
    return m.caps.where(cap_range(mv, 100, 300)).withColumn("strict", cap_range(mv, 100, 300, inclusive=False))


@query("flt_industry", "entity:i industry_code:i industry:s",
       "select entity, industry_code, industry from membership where industry in ('NATION_9', 'NATION_6') or industry_code in (3, 7, 12)")
def _(m: Market) -> DataFrame:
    return m.membership.where(F.col("industry").isin("NATION_9", "NATION_6") | F.col("industry_code").isin(3, 7, 12))


@query("flt_exclude_st", "entity:i bar_date:d close:f",
       "select b.entity, b.bar_date, b.close from bars0 b where not exists (select 1 from flags f where f.entity = b.entity and f.bar_date = b.bar_date)")
def _(m: Market) -> DataFrame:
    return m.bars0.join(m.flags, ["entity", "bar_date"], "left_anti")


@query("flt_active_listing", "entity:i bar_date:d",
       """select b.entity, b.bar_date from bars0 b join securities s on b.entity = s.entity
          where s.list_date <= b.bar_date and (s.delist_date is null or s.delist_date > b.bar_date)""")
def _(m: Market) -> DataFrame:
    return M.active_listing(m.bars0, m.securities)


@query("flt_complete_window", "entity:i t:i bar_date:d close:f",
       """select entity, 60 - rn + 0 as t, bar_date, close from (
            select *, count(*) over (partition by entity) as c, max(bar_date) over (partition by entity) as e from (
              select *, row_number() over (partition by entity order by bar_date desc) as rn from bars0 where bar_date <= (select d from dayref))
            where rn <= 60) where c = 60 and e = (select d from dayref)""")
def _(m: Market) -> DataFrame:
    return B.complete_windows(m.bars0, 60, m.as_of)


@query("flt_endpoint_stride", "entity:i pos:i bar_date:d",
       "select entity, pos, bar_date from bars where pos >= 120 and ((pos - 120) % 15 = 0 or pos = n_bars)")
def _(m: Market) -> DataFrame:
    pos = F.col("pos")
    return m.bars.where((pos >= 120) & (((pos - 120) % 15 == 0) | (pos == F.col("n_bars"))))


_TAIL = """
with tb as (select template_id, n, greatest(5, cast(ceil(n * 0.2e0) as integer)) as k from zlists),
tt as (select t.template_id, b.k, arg_max(close, t) / arg_min(close, t) - 1 as tret, arg_max(close, t) / max(close) - 1 as tdd
  from templates t join tb b on t.template_id = b.template_id where t.t > t.n - b.k group by t.template_id, b.k),
cand as (select a.template_id, a.entity, a.score, tt.tret, tt.tdd,
    arg_max(q.close, q.pos) / arg_min(q.close, q.pos) - 1 as cret, arg_max(q.close, q.pos) / max(q.close) - 1 as cdd
  from nowscores a join tt on a.template_id = tt.template_id join qfqnow q on q.entity = a.entity and q.pos between a.pos - tt.k + 1 and a.pos
  where a.bar_date = (select d from dayref) group by all)
"""


def tail_gated(m: Market) -> DataFrame:
    """Latest scores with the tail rule: same direction as the template and near its tail high."""
    book = sim.book(m)
    bars = dict((k, max(5, -(-len(z) // 5))) for k, z in book.templates)
    sizes = F.create_map(*[F.lit(v) for kv in bars.items() for v in kv])
    newest = Window.partitionBy("entity").orderBy(F.col("bar_date").desc())
    tail = (
        m.qfq_now
        .withColumn("back", F.row_number().over(newest))
        .where(F.col("back") <= max(bars.values()))
    )
    exploded = tail.select(
        "entity", "bar_date", "close", "back", F.explode(F.array(*[F.lit(k) for k in bars])).alias("template_id")
    ).where(F.col("back") <= F.element_at(sizes, F.col("template_id")))
    cand = exploded.groupBy("template_id", "entity").agg(
        F.max_by("close", "bar_date").alias("last"), F.min_by("close", "bar_date").alias("first"), F.max("close").alias("peak")
    )
    pts = sim.points(m).where(F.col("t") > F.col("n") - F.element_at(sizes, F.col("template_id").cast("int")))
    tmpl = pts.groupBy("template_id").agg(
        (F.max_by("close", "t") / F.min_by("close", "t") - 1).alias("tret"),
        (F.max_by("close", "t") / F.max("close") - 1).alias("tdd"),
    )
    cret, cdd = F.col("last") / F.col("first") - 1, F.col("last") / F.col("peak") - 1
    return (
        S_latest(m, book).join(cand, ["template_id", "entity"]).join(tmpl, "template_id")
        .withColumn("tail_return", cret).withColumn("tail_drawdown", cdd)
        .withColumn("passed", (cret * F.col("tret") >= 0) & (cdd >= F.col("tdd") - 0.05))
    )


def S_latest(m: Market, book) -> DataFrame:
    return sim.S.latest_scores(m.qfq_now, book, m.as_of)


@query("flt_tail_gate", "template_id:i entity:i tail_return:f tail_drawdown:f",
       _TAIL + "select template_id, entity, cret as tail_return, cdd as tail_drawdown from cand where cret * tret >= 0 and cdd >= tdd - 0.05e0")
def _(m: Market) -> DataFrame:
    return tail_gated(m).where("passed")


@query("flt_exclude_codes", "entity:i name:s",
       "select entity, name from securities where entity not in (select s_suppkey from supplier where s_acctbal < 0)")
def _(m: Market) -> DataFrame:
    used = m.table("supplier").where(F.col("s_acctbal") < 0).select(F.col("s_suppkey").alias("entity"))
    return m.securities.join(used, "entity", "left_anti")


# ---------------------------------------------------------------- joins


@query("jn_bars_factors", "entity:i bar_date:d close:f adj_factor:f", "select entity, bar_date, close, adj_factor from barsf")
def _(m: Market) -> DataFrame:
    return m.bars_with_factor


@query("jn_dim_left", "entity:i board:s total_mv:f industry:s",
       """select s.entity, s.board, c.total_mv, mm.industry from securities s
          left join (select * from caps where bar_date = (select d from dayref)) c on s.entity = c.entity
          left join (select entity, arg_min(industry, in_date) as industry from membership group by 1) mm on s.entity = mm.entity""")
def _(m: Market) -> DataFrame:
    first = m.membership.groupBy("entity").agg(F.min_by("industry", "in_date").alias("industry"))
    caps = m.caps.where(F.col("bar_date") == m.as_of).select("entity", "total_mv")
    return m.securities.join(caps, "entity", "left").join(first, "entity", "left")


def _pit_sql(op: str) -> str:
    return f"""select b.entity, b.bar_date, coalesce(m.industry_code, -1) as industry_code from bars0 b left join membership m
      on b.entity = m.entity and m.in_date <= b.bar_date and (m.out_date is null or m.out_date {op} b.bar_date)
      qualify row_number() over (partition by b.entity, b.bar_date order by m.in_date desc) = 1"""


@query("jn_point_in_time", "entity:i bar_date:d industry_code:i", _pit_sql(">"))
def _(m: Market) -> DataFrame:
    return M.industry_on(m.bars0.select("entity", "bar_date"), m.membership)


@query("jn_point_in_time_inclusive", "entity:i bar_date:d industry_code:i", _pit_sql(">="))
def _(m: Market) -> DataFrame:
    return M.industry_on(m.bars0.select("entity", "bar_date"), m.membership, end_inclusive=True)


@query("jn_asof_slice", "entity:i sample:i bar_date:d close:f",
       """with days as (select bar_date as day, (ord // 20) as sample from cal where ord % 20 = 19)
          select entity, sample, max(bar_date) as bar_date, arg_max(close, bar_date) as close
          from bars0 join days on bar_date <= day group by entity, sample""")
def _(m: Market) -> DataFrame:
    """Last bar at or before each sample date.

    Each bar first answers its own calendar period (one aggregate), then a
    running max_by over the periods carries it forward; no bar meets every
    sample date.
    """
    step = 20
    dated = C.with_ordinal(m.bars0.select("entity", "bar_date", "close"), m.cal)
    own = dated.groupBy("entity", F.floor(F.col("ord") / step).alias("sample")).agg(
        F.max(F.struct("bar_date", "close")).alias("last")
    )
    samples = F.floor((m.cal.agg(F.max("ord")).scalar() + 1) / step) - 1
    following = F.lead("sample").over(Window.partitionBy("entity").orderBy("sample"))
    until = F.coalesce(following - 1, samples)
    held = own.withColumn("until", F.least(until, samples)).where(F.col("sample") <= F.col("until"))
    return held.select(
        "entity", F.explode(F.sequence("sample", "until")).alias("sample"), "last.bar_date", "last.close"
    )


@query("jn_prior_ordinal", "template_id:i bar_date:d entity:i rank:i prior_rank:i",
       """with d as (select template_id, ord, entity, rank as c, null as p from daily union all select template_id, ord + 10, entity, null, rank from daily)
          select d.template_id, c.bar_date, d.entity, max(d.c) as rank, max(d.p) as prior_rank from d join cal c on d.ord = c.ord group by all having count(d.c) > 0 and count(d.p) > 0""")
def _(m: Market) -> DataFrame:
    """Each member speaks for its own day and for the day that looks back at it: one scored frame, one aggregate."""
    none = F.lit(None).cast("int")
    sides = F.array(
        F.struct(F.col("ord").alias("ord"), F.col("rank").alias("rank"), none.alias("prior_rank")),
        F.struct((F.col("ord") + 10).alias("ord"), none.alias("rank"), F.col("rank").alias("prior_rank")),
    )
    spoken = daily_top(m).select("template_id", "entity", F.explode(sides).alias("s")).select("template_id", "entity", "s.*")
    both = spoken.groupBy("template_id", "entity", "ord").agg(F.max("rank").alias("rank"), F.max("prior_rank").alias("prior_rank"))
    met = both.where(F.col("rank").isNotNull() & F.col("prior_rank").isNotNull())
    return met.join(F.broadcast(m.cal), "ord")  # one row a date


@query("jn_full_compare", "template_id:i bar_date:d entity:i in_current:b in_prior:b",
       """with d as (select template_id, ord, entity, 1 as c, 0 as p from daily union all select template_id, ord + 10, entity, 0, 1 from daily)
          select d.template_id, c.bar_date, d.entity, max(d.c) = 1 as in_current, max(d.p) = 1 as in_prior from d join cal c on d.ord = c.ord group by all""")
def _(m: Market) -> DataFrame:
    top = stage(daily_top(m).select("template_id", "ord", "entity"))
    cur = top.withColumn("c", F.lit(True))
    prior = top.withColumn("ord", F.col("ord") + 10).withColumn("p", F.lit(True))
    both = cur.join(prior, ["template_id", "ord", "entity"], "full_outer")
    dated = both.join(F.broadcast(m.cal), "ord")
    return dated.select(
        "template_id", "bar_date", "entity",
        F.coalesce("c", F.lit(False)).alias("in_current"), F.coalesce("p", F.lit(False)).alias("in_prior"),
    )


@query("jn_semi_codes", "entity:i n:i", "select entity, count(*) as n from bars0 where entity in (select entity from securities where board = 'star') group by 1")
def _(m: Market) -> DataFrame:
    codes = m.securities.where(F.col("board") == "star").select("entity")
    return m.bars0.join(codes, "entity", "left_semi").groupBy("entity").agg(F.count(F.lit(1)).alias("n"))


@query("jn_anti_missing", "entity:i status:s",
       """select entity, 'not_calculated' as status from securities where entity not in (select entity from bars0 where bar_date = (select d from dayref))
          union all select entity, 'present' from bars0 where bar_date = (select d from dayref)""")
def _(m: Market) -> DataFrame:
    there = m.bars0.where(F.col("bar_date") == m.as_of).select("entity")
    absent = m.securities.select("entity").join(there, "entity", "left_anti")
    return absent.withColumn("status", F.lit("not_calculated")).unionByName(there.withColumn("status", F.lit("present")))


EVENTS_SQL = """
with lim as (select *, prev * 1.1e0 as up_limit, prev * 0.9e0 as down_limit from (
    select entity, bar_date, pos, close, lag(close) over (partition by entity order by bar_date) as prev from bars)),
ev as (select *, coalesce(close >= up_limit - greatest(abs(up_limit) * 1e-5, 0.001), false) as up,
    coalesce(close <= down_limit + greatest(abs(down_limit) * 1e-5, 0.001), false) as down from lim),
wins as (select a.template_id, a.entity, a.score, a.n, a.bar_date as end_date, s.bar_date as start_date, a.pos
  from nowscores a join bars s on s.entity = a.entity and s.pos = a.pos - a.n + 1 where a.bar_date = (select d from dayref)),
evc as (select w.template_id, w.entity, w.score, w.start_date, w.end_date,
    count(case when e.up then 1 end) as up_count, count(case when e.down then 1 end) as down_count,
    max(ce.ord) - max(cs.ord) + 1 - count(*) as suspension_count,
    max(abs(e.close / e.prev - 1) * 100) as max_abs_pct
  from wins w join ev e on e.entity = w.entity and e.bar_date between w.start_date and w.end_date
  join cal cs on cs.bar_date = w.start_date join cal ce on ce.bar_date = w.end_date
  group by w.template_id, w.entity, w.score, w.start_date, w.end_date)
"""


def events(m: Market) -> DataFrame:
    return events_of_few(sim.latest(m).drop("max_abs_pct"), bar_events(m.bars_by_security, m.cal))


def events_in(m: Market, windows: DataFrame) -> DataFrame:
    """Events of the windows of a few securities, a written table; the other bars go first."""
    bars = m.bars0.join(windows.select("entity").distinct(), "entity", "left_semi")
    return events_of_few(windows.drop("max_abs_pct"), bar_events(bars, m.cal))


@query("jn_window_events", "template_id:i entity:i up_count:i down_count:i suspension_count:i",
       EVENTS_SQL + "select template_id, entity, up_count, down_count, suspension_count from evc")
def _(m: Market) -> DataFrame:
    return events(m)


@query("jn_template_pairs", "bar_date:d a:i b:i common:i",
       """select x.bar_date, x.template_id as a, y.template_id as b, count(*) as common from daily x join daily y
          on x.bar_date = y.bar_date and x.entity = y.entity and x.template_id < y.template_id group by all""")
def _(m: Market) -> DataFrame:
    top = stage(daily_top(m).select("template_id", "bar_date", "entity"))
    other = top.withColumnRenamed("template_id", "b")
    pairs = top.withColumnRenamed("template_id", "a").join(other, ["bar_date", "entity"]).where(F.col("a") < F.col("b"))
    return pairs.groupBy("bar_date", "a", "b").agg(F.count(F.lit(1)).alias("common"))


def rated(m: Market) -> DataFrame:
    """Labelled documents: rating = quality plus toxicity, score = length, category = language."""
    docs = m.table("documents").select("doc_id", "lang", "source", "n_chars")
    labels = m.table("labels").select("doc_id", (F.col("quality") * 2 + F.col("toxic")).alias("rating"))
    return docs.join(labels, "doc_id").select(
        F.col("doc_id").alias("sample_id"), F.col("lang").alias("category"), "source", "rating",
        F.col("n_chars").cast("double").alias("score"),
    )


def pair_counts(items: DataFrame, ratings: int = 4) -> DataFrame:
    """Comparable, concordant and tied pairs per category without forming any pair.

    Items are counted per (category, score, rating); running totals over the
    score order then give, for every rating, how many lower-rated items lie
    below or level with it.
    """
    names = [f"r{i}" for i in range(ratings)]
    counts = stage(items.groupBy("category", "score").agg(
        *[F.count_if(F.col("rating") == i).alias(n) for i, n in enumerate(names)]
    ))
    run = running_totals(counts, ["category"], "score", names)
    comparable, good, tied = F.lit(0), F.lit(0), F.lit(0)
    for hi in range(1, ratings):
        for lo in range(hi):
            comparable = comparable + F.col(f"r{hi}") * F.col(f"total_r{lo}")
            good = good + F.col(f"r{hi}") * F.col(f"below_r{lo}")
            tied = tied + F.col(f"r{hi}") * F.col(f"r{lo}")
    return run.groupBy("category").agg(
        F.sum(comparable).alias("comparable"), F.sum(good).alias("concordant"), F.sum(tied).alias("tied")
    )


RATED = """
rated as (select d.doc_id as sample_id, d.lang as category, d.source, l.quality * 2 + l.toxic as rating, cast(d.n_chars as double) as score
  from documents d join labels l on d.doc_id = l.doc_id)"""


@query("jn_pairwise_theta", "category:s comparable:i concordant:i tied:i",
       f"""with {RATED} select a.category, count(*) as comparable, count(case when a.score > b.score then 1 end) as concordant,
          count(case when a.score = b.score then 1 end) as tied from rated a join rated b on a.category = b.category and a.rating > b.rating group by 1""")
def _(m: Market) -> DataFrame:
    return pair_counts(rated(m)).where(F.col("comparable") > 0)


# ---------------------------------------------------------------- aggregations


@query("agg_industry_catalog", "industry_code:i industry:s n:i",
       "select industry_code, industry, count(*) as n from membership where out_date is null group by 1, 2")
def _(m: Market) -> DataFrame:
    current = m.membership.where(F.col("out_date").isNull())
    return current.groupBy("industry_code", "industry").agg(F.count(F.lit(1)).alias("n")).orderBy("industry", "industry_code")


def distribution(m: Market, scores: DataFrame | None = None) -> DataFrame:
    """Per date and template: count, extremes, negative share and exact quantiles."""
    keys = ["template_id", "bar_date"]
    base = stage(sim.scores(m).select(*keys, "score")) if scores is None else scores.select(*keys, "score")
    flat = base.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("eligible"), F.max("score").alias("max_score"), F.min("score").alias("min_score"),
        F.avg(flag(F.col("score") < 0)).alias("negative_share"),
        F.count_if(F.col("score") >= 0.70).alias("n70"), F.count_if(F.col("score") >= 0.75).alias("n75"),
        F.count_if(F.col("score") >= 0.80).alias("n80"),
    )
    points = {"p05": 0.05, "median_score": 0.5, "p95": 0.95, "p99": 0.99}
    return flat.join(exact_quantiles(base, keys, "score", points, staged=True), keys)


@query("agg_distribution", "template_id:i bar_date:d eligible:i max_score:f median_score:f p95:f p99:f min_score:f negative_share:f",
       "select template_id, bar_date, eligible, max_score, median_score, p95, p99, min_score, negative_share from mkt")
def _(m: Market) -> DataFrame:
    return distribution(m)


@query("agg_histogram", "template_id:i bin:i n:i",
       """with b as (select template_id, least(cast(floor((score + 1) / 2 * 24) as integer), 23) as bin, count(*) as n from scores group by 1, 2)
          select t.template_id, g.bin, coalesce(b.n, 0) as n from zlists t, (select unnest(range(24)) as bin) g
          left join b on b.template_id = t.template_id and b.bin = g.bin""")
def _(m: Market) -> DataFrame:
    # Empty bins come from exploding the per-template map, not from a join.
    binned = F.least(F.floor((F.col("score") + 1) / 2 * 24), F.lit(23)).cast("int")
    counts = sim.scores(m).groupBy("template_id", binned.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    folded = counts.groupBy("template_id").agg(F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("m"))
    grid = folded.select("template_id", "m", F.explode(F.sequence(F.lit(0), F.lit(23))).alias("bin"))
    return grid.select("template_id", "bin", F.coalesce(F.try_element_at("m", F.col("bin")), F.lit(0)).alias("n"))


def breakdown(df: DataFrame, keys: list[str], group: str, chosen: str) -> DataFrame:
    """Share of the chosen rows per group against the share of all rows; zero groups kept."""
    counted = df.groupBy(*keys, group).agg(
        F.count(F.lit(1)).alias("base_count"), F.count_if(F.col(chosen)).alias("count")
    )
    w = Window.partitionBy(*keys)
    share = F.col("count") / F.greatest(F.sum("count").over(w), F.lit(1))
    base = F.col("base_count") / F.sum("base_count").over(w)
    return (
        counted.withColumn("share", share).withColumn("market_share", base)
        .withColumn("excess_pp", (F.col("share") - F.col("market_share")) * 100)
        .withColumn("ratio", F.try_divide("share", "market_share"))
    )


_LATEST_PANEL = """
with lp as (select a.template_id, a.entity, a.score, coalesce(m.industry, 'missing') as industry,
    row_number() over (partition by a.template_id order by a.score desc, a.entity) as rank, c.total_mv,
    case when c.total_mv is null then 'missing' when c.total_mv / 1e4 < 50 then '<50' else 'more' end as tier
  from nowscores a left join membership m on a.entity = m.entity and m.in_date <= a.bar_date and (m.out_date is null or m.out_date > a.bar_date)
  left join caps c on c.entity = a.entity and c.bar_date = a.bar_date
  where a.bar_date = (select d from dayref))
"""


def latest_panel(m: Market) -> DataFrame:
    """Newest scores with industry and a membership flag of the Top-K."""
    base = stage(sim.latest(m).withColumn("bar_date", F.col("end_date")))
    best = top_k(base, ["template_id"], best_first(), K).select("template_id", "entity", "rank")
    return M.industry_on(base.join(best, ["template_id", "entity"], "left"), m.membership).withColumn(
        "chosen", F.col("rank").isNotNull()
    )


@query("agg_breakdown", "template_id:i industry:s count:i share:f market_share:f excess_pp:f ratio:f",
       _LATEST_PANEL + """select template_id, industry, cnt as count, share, market_share, (share - market_share) * 100 as excess_pp, share / market_share as ratio
         from (select template_id, industry, count(case when rank <= 100 then 1 end) as cnt,
           count(case when rank <= 100 then 1 end) * 1.0e0 / sum(count(case when rank <= 100 then 1 end)) over (partition by template_id) as share,
           count(*) * 1.0e0 / sum(count(*)) over (partition by template_id) as market_share from lp group by 1, 2)""")
def _(m: Market) -> DataFrame:
    return breakdown(latest_panel(m), ["template_id"], "industry", "chosen")


def concentration(df: DataFrame, keys: list[str], group: str) -> DataFrame:
    """Coverage, top share, HHI and leading group; a tie goes to the group seen first by rank."""
    per = df.groupBy(*keys, group).agg(F.count(F.lit(1)).alias("n"), F.min("rank").alias("first_rank"))
    total = F.sum("n")
    return per.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("coverage"), (F.max("n") / total).alias("top_share"),
        (F.sum(F.col("n") * F.col("n")) / (total * total)).alias("hhi"),  # one division of whole numbers: no rounding noise
        F.max_by(group, F.struct("n", -F.col("first_rank"))).alias("leader"),
    )


@query("agg_concentration", "template_id:i bar_date:d coverage:i top_share:f hhi:f leader:s",
       """with g as (select template_id, bar_date, industry, count(*) as n, min(rank) as fr from daily group by all),
          s as (select template_id, bar_date, count(*) as coverage, cast(max(n) as double) as top_n, cast(sum(n) as double) as total, cast(sum(n * n) as double) as squares,
            arg_max(industry, struct_pack(a := n, b := -fr)) as leader from g group by 1, 2)
          select template_id, bar_date, coverage, top_n / total as top_share, squares / (total * total) as hhi, leader from s""")
def _(m: Market) -> DataFrame:
    return concentration(daily_top(m), ["template_id", "bar_date"], "industry")


@query("agg_anomaly_share", "template_id:i limit_share:f suspension_share:f abnormal_share:f any_share:f event_count:i",
       EVENTS_SQL + """select template_id, avg(case when up_count + down_count > 0 then 1.0e0 else 0 end) as limit_share,
         avg(case when suspension_count > 0 then 1.0e0 else 0 end) as suspension_share,
         avg(case when max_abs_pct >= 9.5 then 1.0e0 else 0 end) as abnormal_share,
         avg(case when up_count + down_count > 0 or suspension_count > 0 or max_abs_pct >= 9.5 then 1.0e0 else 0 end) as any_share,
         count(case when up_count + down_count > 0 or suspension_count > 0 or max_abs_pct >= 9.5 then 1 end) as event_count
         from evc group by 1""")
def _(m: Market) -> DataFrame:
    limit = (F.col("up_count") + F.col("down_count")) > 0
    stop, jump = F.col("suspension_count") > 0, F.col("max_abs_pct") >= 9.5
    return events(m).groupBy("template_id").agg(
        F.avg(flag(limit)).alias("limit_share"), F.avg(flag(stop)).alias("suspension_share"),
        F.avg(flag(jump)).alias("abnormal_share"), F.avg(flag(limit | stop | jump)).alias("any_share"),
        F.count_if(limit | stop | jump).alias("event_count"),
    )


def industry_counts(m: Market, k: int = K) -> DataFrame:
    """(date, template, industry): eligible, chosen, rate and share; counted before any shuffle of rows."""
    keys = ["template_id", "bar_date", "industry_code", "industry"]
    base = stage(panel(m).select(*keys, "entity", "score"))  # scored once, read for both counts
    eligible = base.groupBy(*keys).agg(F.count(F.lit(1)).alias("eligible"))
    best = top_k(base, ["template_id", "bar_date"], best_first(), k)
    chosen = best.groupBy(*keys).agg(F.count(F.lit(1)).alias("top_count"))
    return (
        eligible.join(chosen, keys, "left").fillna(0, ["top_count"])
        .withColumn("selection_rate", F.col("top_count") / F.col("eligible"))
        .withColumn("top_share", F.col("top_count") / F.lit(float(k)))
    )


@query("agg_industry_counts", "template_id:i bar_date:d industry_code:i eligible:i top_count:i selection_rate:f top_share:f",
       """select template_id, bar_date, industry_code, count(*) as eligible, count(case when rank <= 100 then 1 end) as top_count,
          count(case when rank <= 100 then 1 end) * 1.0e0 / count(*) as selection_rate, count(case when rank <= 100 then 1 end) / 100.0e0 as top_share
          from panel group by 1, 2, 3""")
def _(m: Market) -> DataFrame:
    return industry_counts(m)


def other_rollup(counts: DataFrame, keys: list[str]) -> DataFrame:
    """Merge industries with one or two members into 'other', keeping its component list."""
    small = F.col("top_count").isin(1, 2)
    tagged = counts.where(F.col("top_count") > 0).withColumn(
        "block", F.when(small, "other").otherwise(F.col("industry"))
    )
    return tagged.groupBy(*keys, "block").agg(
        F.sum("eligible").alias("eligible"), F.sum("top_count").alias("top_count"),
        F.array_join(F.sort_array(F.collect_set(F.when(small, F.col("industry")))), ",").alias("components"),
    )


@query("agg_other_rollup", "template_id:i bar_date:d block:s eligible:i top_count:i components:s",
       """with c as (select template_id, bar_date, industry, count(*) as eligible, count(case when rank <= 100 then 1 end) as top_count from panel group by 1, 2, 3)
          select template_id, bar_date, case when top_count in (1, 2) then 'other' else industry end as block, sum(eligible) as eligible, sum(top_count) as top_count,
            coalesce(string_agg(case when top_count in (1, 2) then industry end, ',' order by industry), '') as components
          from c where top_count > 0 group by 1, 2, 3""")
def _(m: Market) -> DataFrame:
    return other_rollup(industry_counts(m), ["template_id", "bar_date"])


@query("agg_month_end", "period:s bar_date:d", "select strftime(bar_date, '%Y%m') as period, max(bar_date) as bar_date from cal group by 1")
def _(m: Market) -> DataFrame:
    return C.period_ends(m.cal).where(F.col("frequency") == "monthly")


@query("agg_week_end", "period:s bar_date:d",
       "select strftime(bar_date, '%G-%V') as period, max(bar_date) as bar_date from cal group by 1")
def _(m: Market) -> DataFrame:
    return C.period_ends(m.cal).where(F.col("frequency") == "weekly")


def month_ends(m: Market) -> DataFrame:
    ends = C.period_ends(m.cal.where(F.col("bar_date") <= m.as_of)).where(F.col("frequency") == "monthly")
    return ends.select("bar_date", F.col("period").alias("month"))


def frozen_thresholds(dist: DataFrame, ends: DataFrame, months: int = 12) -> DataFrame:
    """75th percentile of the month-end p99 over the first `months` scored months."""
    monthly = dist.join(F.broadcast(ends), "bar_date")
    first = top_k(monthly, ["template_id"], [F.col("bar_date")], months, "seq")
    return first.groupBy("template_id").agg(
        F.expr("percentile(p99, 0.75)").alias("threshold"), F.expr("percentile(p99, 0.5)").alias("p99_median"),
        F.count(F.lit(1)).alias("months"), F.min("bar_date").alias("start_date"), F.max("bar_date").alias("end_date"),
    )


THRESHOLD_SQL = """
ends as (select max(bar_date) as bar_date from cal where bar_date <= (select d from dayref) group by strftime(bar_date, '%Y%m')),
first12 as (select k.* from mkt k join ends e on k.bar_date = e.bar_date qualify row_number() over (partition by template_id order by k.bar_date) <= 12),
thr as (select template_id, quantile_cont(p99, 0.75) as threshold, median(p99) as p99_median, count(*) as months, min(bar_date) as start_date, max(bar_date) as end_date
  from first12 group by 1)"""


@query("agg_quantile_threshold", "template_id:i threshold:f p99_median:f months:i start_date:d end_date:d",
       f"with {THRESHOLD_SQL} select * from thr")
def _(m: Market) -> DataFrame:
    return frozen_thresholds(distribution(m), month_ends(m))
