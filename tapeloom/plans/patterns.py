"""Pattern rules, screens and industry rotation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeloom.functions.ranking import top_k
from tapeloom.functions.scalars import round_even
from tapeloom.operators import calendar as C
from tapeloom.operators import history as H
from tapeloom.operators import patterns as P
from tapeloom.operators import rotation as R
from tapeloom.operators.asof import as_of_samples, sampled_span
from tapeloom.operators.history import Filters
from tapeloom.plans.common import K
from tapeloom.plans.projections import heat_level
from tapeloom.plans.registry import query
from tapeloom.plans.relational import cap_range
from tapeloom.plans.sources import _fresh
from tapeloom.sources.staging import stage
from tapeloom.sources.tables import Market


@query("pat_linear_fit", "entity:i bar_date:d slope:f fit:f", "select entity, bar_date, s20 as slope, f20 as fit from patw where pos >= 20")
def _(m: Market) -> DataFrame:
    return P.linear_fit(m.bars, 20, "slope", "fit").where(F.col("pos") >= 20)


def _single(name: str, category: str) -> None:
    @query(name, f"entity:i bar_date:d score_{category}:f", f"select entity, bar_date, score_{category} from pats where score_{category} is not null")
    def _(m: Market) -> DataFrame:
        return P.pattern_scores(m.bars, (category,)).where(F.col(f"score_{category}").isNotNull())


for _name, _category in (("pat_breakout", "breakout"), ("pat_pullback", "pullback"), ("pat_range_bounce", "range_bounce")):
    _single(_name, _category)


LAST_SQL = """
last_bar as (select * from bars where pos = n_bars),
prim as (select p.entity, count(*) as matches, arg_max(p.category, struct_pack(a := p.score, b := p.prio)) as category, max(p.score) as score
  from patlong p join last_bar l on p.entity = l.entity and p.bar_date = l.bar_date group by 1)"""


@query("pat_score_stock", "entity:i bar_date:d n_past:i status:s matches:i category:s score:f",
       f"""with {LAST_SQL} select l.entity, l.bar_date, least(l.pos, 120) as n_past, case when l.pos < 60 then 'not_calculated' when p.entity is not null then 'matched' else 'no_match' end as status,
          coalesce(p.matches, 0) as matches, p.category, p.score from last_bar l left join prim p on l.entity = p.entity""")
def _(m: Market) -> DataFrame:
    df = P.latest_matches(m.bars0)
    return df.select("entity", "bar_date", "n_past", "status", F.size("matches").alias("matches"), "primary.category", "primary.score")


@query("pat_score_history", "sample:i entity:i score:f",
       """select l.sample, l.entity, p.score from (select x.sample, b.entity, max(b.bar_date) as last_bar from samples x join bars0 b on b.bar_date <= x.bar_date group by 1, 2) l
          join patlong p on p.entity = l.entity and p.bar_date = l.last_bar and p.category = 'pullback'""")
def _(m: Market) -> DataFrame:
    samples = C.rotation_samples(m.cal.where(F.col("bar_date") <= m.as_of))
    first = samples.agg(F.min("ord")).scalar()
    near = sampled_span(C.with_ordinal(m.bars0, m.cal), first, R.STEP, R.SAMPLES, P.RULES["screen"]["lookback_bars"])
    scored = P.pattern_scores(near, ("pullback",))
    last = as_of_samples(scored, first, R.STEP, R.SAMPLES, ["score_pullback"])
    return last.where(F.col("score_pullback") >= P.RULES["pullback"]["minimum_score"]).withColumn(
        "score", round_even(F.col("score_pullback"), 2)
    )


_POOL = """
pool as (select s.entity, s.name, s.board, c.total_mv from securities s join caps c on c.entity = s.entity and c.bar_date = (select d from dayref)
  left join flags f on f.entity = s.entity and f.bar_date = (select d from dayref)
  where s.board in ('main', 'star') and c.total_mv >= 50 and f.entity is null)"""


def pool(m: Market, day: Column | None = None, chosen: Filters = Filters()) -> DataFrame:
    """Screened universe on a day (the as-of date): boards, least size, not flagged."""
    there = F.col("bar_date") == (m.as_of if day is None else day)
    out = m.securities.where(F.col("board").isin(*chosen.boards)).select("entity", "name", "board")
    if chosen.min_cap is not None:
        caps = m.caps.where(there & cap_range(F.col("total_mv"), chosen.min_cap)).select("entity", "total_mv")
        out = out.join(caps, "entity")
    if chosen.exclude_flagged:
        out = out.join(m.flags.where(there).select("entity"), "entity", "left_anti")
    return out


def screen(m: Market, day: Column | None = None, chosen: Filters = Filters(), found: DataFrame | None = None) -> DataFrame:
    """Every eligible security with its status, matches and primary category; with a day and what was found then, as it was then."""
    eligible = pool(m, day, chosen)
    if found is None:
        found = P.latest_matches(m.bars0.join(eligible.select("entity"), "entity", "left_semi"))
    out = eligible.join(found, "entity", "left")
    return out.withColumn("status", F.coalesce("status", F.lit("not_calculated")))


@query("pat_screen", "entity:i status:s category:s score:f rank:i category_rank:i",
       f"""with {LAST_SQL}, {_POOL}, ev as (select l.entity, case when l.pos < 60 then 'not_calculated' when p.entity is not null then 'matched' else 'no_match' end as status, p.category, p.score
          from pool o join last_bar l on l.entity = o.entity left join prim p on l.entity = p.entity),
        cr as (select p.entity, p.category, row_number() over (partition by p.category order by p.score desc, p.entity) as category_rank
          from patlong p join last_bar l on p.entity = l.entity and p.bar_date = l.bar_date where p.entity in (select entity from pool)),
        rk as (select *, case when status = 'matched' then row_number() over (partition by status order by score desc, entity) end as rank from ev)
        select rk.entity, rk.status, rk.category, rk.score, case when rk.rank <= 100 then rk.rank end as rank, case when rk.rank <= 100 and cr.category_rank <= 100 then cr.category_rank end as category_rank
        from rk left join cr on rk.entity = cr.entity and rk.category = cr.category""")
def _(m: Market) -> DataFrame:
    df = stage(screen(m)).withColumn("category", F.col("primary.category")).withColumn("score", F.col("primary.score"))
    order = [F.col("score").desc(), F.col("entity")]
    combined = top_k(df.where(F.col("status") == "matched"), ["status"], order, K).select("entity", "rank")
    per = top_k(P.category_list(df.where(F.col("status") == "matched")), ["category"], order, K, "category_rank")
    out = df.join(combined, "entity", "left").join(per.select("entity", "category", "category_rank"), ["entity", "category"], "left")
    return out.withColumn("category_rank", F.when(F.col("rank").isNotNull(), F.col("category_rank")))


@query("top_per_category", "category:s category_rank:i entity:i score:f",
       f"""with {LAST_SQL} select category, category_rank, entity, score from (select p.*, row_number() over (partition by p.category order by p.score desc, p.entity) as category_rank
          from patlong p join last_bar l on p.entity = l.entity and p.bar_date = l.bar_date) where category_rank <= 100""")
def _(m: Market) -> DataFrame:
    matches = P.category_list(P.latest_matches(m.bars0))
    return top_k(matches, ["category"], [F.col("score").desc(), F.col("entity")], K, "category_rank")


@query("pat_pool", "category:s total:i best:f",
       f"""with {LAST_SQL}, {_POOL} select p.category, count(*) as total, max(p.score) as best from patlong p join last_bar l on p.entity = l.entity and p.bar_date = l.bar_date
          where p.entity in (select entity from pool) group by 1""")
def _(m: Market) -> DataFrame:
    rows = P.category_list(screen(m).where(F.col("status") == "matched"))
    return rows.groupBy("category").agg(F.count(F.lit(1)).alias("total"), F.max("score").alias("best"))


@query("pat_single", "bar_date:d score_breakout:f score_pullback:f score_range_bounce:f",
       "select bar_date, score_breakout, score_pullback, score_range_bounce from pats where entity = 7 and pos >= 60")
def _(m: Market) -> DataFrame:
    # The filter on the security reaches the Parquet scan through the bar aggregate.
    return P.pattern_scores(m.bars.where(F.col("entity") == 7)).where(F.col("pos") >= 60)


#: run, dates before the newest, filters, saved: the unsaved run and the other filters must not count as comparable
WIDE = Filters(boards=("growth",), min_cap=None, exclude_flagged=False)
RUNS = (("earlier", 11, Filters(), True), ("trial", 6, Filters(), False), ("latest", 1, Filters(), True), ("wide", 1, WIDE, True))

_RUNS_SQL = f"""
runs as (select * from (values {", ".join(f"('{run}', {seq}, {back - 1}, '{f.canonical()}', {str(saved).lower()})" for seq, (run, back, f, saved) in enumerate(RUNS))}) as r(run, seq, back, filters, saved)),
dated as (select r.*, k.bar_date as snapshot, k.ord from runs r join cal k on k.ord = (select o from dayref) - r.back),
chosen as (select d.*, s.entity from dated d join securities s on (d.run = 'wide' and s.board = 'growth')
    or (d.run <> 'wide' and s.board in ('main', 'star')
      and exists (select 1 from caps c where c.entity = s.entity and c.bar_date = d.snapshot and c.total_mv >= 50)
      and not exists (select 1 from flags f where f.entity = s.entity and f.bar_date = d.snapshot))),
lastb as (select c.run, c.entity, max(b.bar_date) as bar_date, least(count(*), 120) as history_bars
    from chosen c join bars0 b on b.entity = c.entity and b.bar_date <= c.snapshot group by 1, 2),
hits as (select l.run, l.entity, p.category, p.score, p.prio from lastb l join patlong p on p.entity = l.entity and p.bar_date = l.bar_date),
evals as (select c.run, c.seq, c.snapshot, c.filters, c.saved, c.entity, l.bar_date, coalesce(l.history_bars, 0) as history_bars,
    case when coalesce(l.history_bars, 0) < 60 then 'not_calculated' when h.matches is null then 'no_match' else 'matched' end as status,
    case when l.entity is null then 'no bars' when l.history_bars < 60 then 'short history' end as warning, coalesce(h.matches, '') as matches
    from chosen c left join lastb l using (run, entity)
    left join (select run, entity, string_agg(category, ',' order by prio desc) as matches from hits group by all) h using (run, entity)),
cats as (select * from (values ('breakout'), ('pullback'), ('range_bounce')) as v(category)),
cnt as (select d.run, d.seq, d.snapshot, d.filters, d.saved, k.category, count(h.entity) as n
    from dated d cross join cats k left join hits h on h.run = d.run and h.category = k.category group by all),
prior as (select a.run, b.run as previous_run, b.snapshot as previous_snapshot from dated a join dated b
    on a.filters = b.filters and b.saved and b.snapshot < a.snapshot
    qualify row_number() over (partition by a.run order by b.snapshot desc, b.seq desc) = 1),
listed as (select run, entity, category, score, row_number() over (partition by run order by score desc, entity) as rank from
    (select *, row_number() over (partition by run, entity order by score desc, prio desc) as k from hits) where k = 1)"""


def run_history(m: Market) -> str:
    """The screens of ``RUNS`` published in a history of their own; its folder."""
    root = _fresh(m, "runs")
    # the bars are read once for all days, and what each day found is written
    days = {str(back): C.nth_newest(m.cal, back) for back in sorted({back for _, back, _, _ in RUNS})}
    matches = stage(P.matches_on(m.bars_by_security, days))
    for seq, (run, back, chosen, saved) in enumerate(RUNS):
        day = days[str(back)]
        found = matches.where(F.col("day") == str(back)).drop("day")
        rows = screen(m, day, chosen, found).withColumn("history_bars", F.coalesce("n_past", F.lit(0)))
        short = F.when(F.col("bar_date").isNull(), "no bars").when(F.col("status") == "not_calculated", "short history")
        H.append_run(m.spark, root, run, seq, day, chosen, rows.withColumn("warning", short), P.CATEGORIES, saved)
    return root


@query("his_append_run", "run:s part:s item:s n:i best:f filters:s",
       f"""with {_RUNS_SQL}
        select run, 'evaluations' as part, status as item, count(*) as n, cast(null as double) as best, filters from evals group by all
        union all select l.run, 'results', category, count(*), max(score), d.filters from listed l join dated d using (run) where rank <= 100 group by all
        union all select d.run, 'manifest', 'results', (select count(*) from listed l where l.run = d.run and rank <= 100), null, d.filters from dated d
        union all select d.run, 'manifest', 'evaluated', (select count(*) from evals e where e.run = d.run), null, d.filters from dated d""")
def _(m: Market) -> DataFrame:
    root = run_history(m)
    evaluations, results, runs = H.published(m.spark, root, "evaluations"), H.published(m.spark, root, "results"), H.manifests(m.spark, root)
    none, n = F.lit(None).cast("double").alias("best"), F.count(F.lit(1)).alias("n")
    parts = [
        evaluations.groupBy("run", F.lit("evaluations").alias("part"), F.col("status").alias("item"), "filters").agg(n).withColumn("best", F.lit(None).cast("double")),
        results.groupBy("run", F.lit("results").alias("part"), F.col("category").alias("item"), "filters").agg(n, F.max("score").alias("best")),
        runs.select("run", F.lit("manifest").alias("part"), F.lit("results").alias("item"), "filters", F.col("result_count").alias("n"), none),
        runs.select("run", F.lit("manifest").alias("part"), F.lit("evaluated").alias("item"), "filters", F.col("evaluated").alias("n"), none),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query("his_previous_counts", "run:s category:s n:i previous_run:s previous_snapshot:d previous:i change:i",
       f"""with {_RUNS_SQL} select a.run, a.category, a.n, p.previous_run, p.previous_snapshot, b.n as previous, a.n - b.n as change
          from cnt a left join prior p using (run) left join cnt b on b.run = p.previous_run and b.category = a.category""")
def _(m: Market) -> DataFrame:
    return H.category_changes(H.manifests(m.spark, run_history(m)))


@query("agg_counts_by_category", "category:s n:i change:i compared_with:d",
       f"""with {_RUNS_SQL} select a.category, a.n, a.n - b.n as change, p.previous_snapshot as compared_with
          from cnt a left join prior p using (run) left join cnt b on b.run = p.previous_run and b.category = a.category where a.run = 'latest'""")
def _(m: Market) -> DataFrame:
    changes = H.category_changes(H.manifests(m.spark, run_history(m)))
    return changes.where(F.col("run") == "latest").withColumnRenamed("previous_snapshot", "compared_with")


@query("his_pattern_history", "entity:i nth:i run:s snapshot:d status:s state:s matches:s bar_date:d history_bars:i warning:s",
       f"""with {_RUNS_SQL}, nums as (select *, row_number() over w as nth, first_value(status) over w as newest from evals where saved
            window w as (partition by entity order by snapshot desc, seq desc, run))
          select entity, nth, run, snapshot, status, case newest when 'no_match' then 'calculated_no_match' else newest end as state, matches, bar_date, history_bars, warning
          from nums where nth <= 10""")
def _(m: Market) -> DataFrame:
    rows = H.security_history(H.published(m.spark, run_history(m), "evaluations"), keep=10)
    return rows.withColumn("matches", F.array_join(F.transform("matches", lambda x: x["category"]), ","))


@query("jn_pattern_history", "run:s snapshot:d entity:i status:s filters:s",
       f"with {_RUNS_SQL} select run, snapshot, entity, status, filters from evals where saved order by snapshot desc, seq desc, entity")
def _(m: Market) -> DataFrame:
    rows = H.published(m.spark, run_history(m), "evaluations").where("saved")
    return rows.orderBy(F.col("snapshot").desc(), F.col("seq").desc(), "entity")


# ---------------------------------------------------------------- rotation


def samples(m: Market) -> DataFrame:
    return C.rotation_samples(m.cal.where(F.col("bar_date") <= m.as_of))


def universe(m: Market) -> DataFrame:
    return R.universe(m.securities, samples(m), m.flags, m.membership, ["main", "star"])


def rotation_top(m: Market) -> DataFrame:
    first = samples(m).agg(F.min("ord")).scalar()
    return R.top_by_sample(C.with_ordinal(m.bars0, m.cal), universe(m), first, "breakout", K)


def rotation_cells(m: Market) -> DataFrame:
    return R.matrix(rotation_top(m), m.membership, samples(m))


@query("rot_sample_dates", "sample:i bar_date:d ord:i", "select sample, bar_date, ord from samples")
def _(m: Market) -> DataFrame:
    return samples(m)


@query("rot_timeline_dates", "bar_date:d ord:i", "select bar_date, ord from cal where ord % 5 = 0 or ord = (select max(ord) from cal)")
def _(m: Market) -> DataFrame:
    return C.timeline_dates(m.cal)


@query("rot_pit_universe", "sample:i entity:i industry_code:i", "select sample, entity, industry_code from universe")
def _(m: Market) -> DataFrame:
    return universe(m)


@query("rot_top_by_date", "sample:i rank:i entity:i score:f industry_code:i", "select sample, rank, entity, score, industry_code from rottop")
def _(m: Market) -> DataFrame:
    return rotation_top(m)


@query("rot_matrix", "industry_code:i sample:i bar_date:d n:i change:i heat:i stocks:s",
       """select r.industry_code, r.sample, r.bar_date, n, change, case when n <= 0 then 0 when n <= 2 then 1 when n <= 4 then 2 when n <= 7 then 3 when n <= 10 then 4 else 5 end as heat,
          coalesce(s.stocks, '') as stocks from rotmat r left join (select industry_code, sample, string_agg(rank || ':' || entity, ',' order by rank) as stocks from rottop group by 1, 2) s
          on s.industry_code = r.industry_code and s.sample = r.sample""")
def _(m: Market) -> DataFrame:
    listed = F.transform("stocks", lambda x: F.concat_ws(":", x["rank"].cast("string"), x["entity"].cast("string")))
    return rotation_cells(m).withColumn("heat", heat_level(F.col("n"))).withColumn("stocks", F.array_join(listed, ","))


@query("rot_features", "industry_code:i slope:f persistence:f recent_change:i effective:i cumulative:i",
       "select industry_code, slope, persistence, recent_change, effective, cumulative from rotfeat")
def _(m: Market) -> DataFrame:
    return R.features(rotation_cells(m))


@query("rot_rank", "industry_code:i current_rank:i rotation_rank:i", "select industry_code, current_rank, rotation_rank from rotrank")
def _(m: Market) -> DataFrame:
    return R.ranks(R.features(rotation_cells(m)))


@query("rot_status", "industry_code:i status:s", "select industry_code, status from rotrank")
def _(m: Market) -> DataFrame:
    return R.ranks(R.features(rotation_cells(m)))


@query("rot_select_active", "display:i industry_code:i slope:f",
       """with a as (select *, case when slope >= 0.25 then 1 when slope <= -0.25 then -1 else 0 end as side from rotrank where greatest(n0, n1, n2, n3) > 0),
          b as (select *, row_number() over (partition by side order by rotation_rank) as k from a),
          c as (select * from b order by case when side = 1 and k <= 4 then 0 when side = -1 and k <= 4 then 1 else 2 end, rotation_rank limit 12)
          select row_number() over (order by slope desc, persistence desc, effective desc, industry_code) as display, industry_code, slope from c""")
def _(m: Market) -> DataFrame:
    return R.select_active(R.ranks(R.features(rotation_cells(m))))


@query("rot_summary", "covered:i strongest:s fastest_up:s fastest_down:s rising:i falling:i top3:i top3_start:i new_top10:i concentration:s",
       """with p as (select industry_code, max(case when sample = (select max(sample) from samples) - 1 then n end) as prev, max(case when sample = (select max(sample) from samples) - 3 then n end) as start from rotmat group by 1),
          q as (select *, row_number() over (order by prev desc, industry_code) as pr, row_number() over (order by start desc) as sr from p),
          s as (select count(case when n3 > 0 then 1 end) as covered, arg_min(industry, current_rank) filter (where n3 > 0) as strongest,
            arg_min(industry, rotation_rank) filter (where slope >= 0.25) as fastest_up, arg_min(industry, rotation_rank) filter (where slope <= -0.25) as fastest_down,
            count(case when slope >= 0.25 then 1 end) as rising, count(case when slope <= -0.25 then 1 end) as falling, sum(case when current_rank <= 3 then n3 end) as top3,
            sum(case when sr <= 3 then start end) as top3_start, count(case when current_rank <= 10 and pr > 10 then 1 end) as new_top10
            from rotrank join q using (industry_code))
          select *, case when top3 - top3_start >= 5 then 'concentrating' when top3 - top3_start <= -5 then 'spreading' else 'stable' end as concentration from s""")
def _(m: Market) -> DataFrame:
    cells = stage(rotation_cells(m))
    return R.summary(R.ranks(R.features(cells)), cells)


@query("rot_warnings", "incomplete_dates:i missing_industry:i samples:i warnings:s",
       """with d as (select x.sample, count(t.entity) as n, count(case when t.entity is not null and t.industry_code is null then 1 end) as miss from samples x left join rottop t on x.sample = t.sample group by 1),
          s as (select count(case when n < 100 then 1 end) as incomplete_dates, sum(miss) as missing_industry, count(*) as samples from d)
          select *, concat_ws(';', case when incomplete_dates > 0 then 'incomplete' end, case when missing_industry > 0 then 'missing industry' end, case when samples <> 24 then 'short history' end) as warnings from s""")
def _(m: Market) -> DataFrame:
    per = rotation_top(m).groupBy("sample").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("industry_code").isNull()).alias("miss"))
    days = samples(m).join(per, "sample", "left").fillna(0, ["n", "miss"])
    out = days.agg(
        F.count_if(F.col("n") < K).alias("incomplete_dates"), F.sum("miss").alias("missing_industry"), F.count(F.lit(1)).alias("samples")
    )
    notes = F.array_compact(F.array(
        F.when(F.col("incomplete_dates") > 0, "incomplete"), F.when(F.col("missing_industry") > 0, "missing industry"),
        F.when(F.col("samples") != R.SAMPLES, "short history"),
    ))
    return out.withColumn("warnings", F.array_join(notes, ";"))
