"""Template dynamics: thresholds, distributions, stability, states, industries, sizes, audits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.functions.ranking import exact_quantiles, order_positions, top_k
from tapeloom.functions.scalars import corr_or_null, flag
from tapeloom.operators import calendar as C
from tapeloom.operators import dynamics as D
from tapeloom.operators.membership import industry_on
from tapeloom.operators.runs import streaks
from tapeloom.operators.verdicts import Rule, evaluate, evaluate_sql, one_row
from tapeloom.plans import similarity as sim
from tapeloom.plans.common import K, best_first, panel, scored
from tapeloom.plans.projections import cap_tier
from tapeloom.plans.registry import QUERIES, query
from tapeloom.plans.relational import EVENTS_SQL, concentration, distribution, events, events_in, frozen_thresholds, month_ends, tail_gated, _TAIL
from tapeloom.plans.windows import position_label, quintile
from tapeloom.sources.staging import stage
from tapeloom.sources.tables import Market

FOCUS = "NATION_9"
KS = (5, 10, 30, 100)  # list sizes of the stability study
OVERLAP_K = 30
LARGE = 30  # members from which an industry is ranked
# Supplied extremes of the two control populations per template.
CONTROLS = [(1, 0.86, 0.90), (2, 0.84, 0.91), (3, 0.88, 0.85), (4, 0.95, 0.97)]


def snapshots(m: Market) -> DataFrame:
    return D.number_snapshots(C.period_ends(m.cal.where(F.col("bar_date") <= m.as_of)))


def state_names(m: Market) -> tuple[str, ...]:
    return D.state_names([k for k, _ in sim.book(m).templates])


def states(m: Market, rows: DataFrame) -> DataFrame:
    return D.states(rows, [k for k, _ in sim.book(m).templates])


def snapped(m: Market, frequency: str | None = None) -> DataFrame:
    """``snapshot_rows``, built once for a query."""
    return m.once(f"snapped {frequency}", lambda: snapshot_rows(m, frequency))


def snapshot_rows(m: Market, frequency: str | None) -> DataFrame:
    """Panel rows on snapshot dates with the frozen threshold and the qualified flag.

    Thresholds are one row per template of the bounded registry, snapshots one
    row per period: both are small by construction.
    """
    snaps, ends = snapshot_days(m, frequency)
    base = snapshot_scores(m, frequency)
    lines = stage(frozen_thresholds(month_end_distribution(m, base), ends).select("template_id", "threshold"))
    # not written again: each use reads the panel with two small tables
    rows = base.join(F.broadcast(snaps), "bar_date").join(F.broadcast(lines), "template_id")
    return rows.withColumn("q", F.col("score") >= F.col("threshold"))


def snapshot_days(m: Market, frequency: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Snapshots and month ends, both written once for a query."""
    snaps, ends = m.once("snapshots", lambda: stage(snapshots(m))), m.once("month ends", lambda: stage(month_ends(m)))
    return (snaps.where(F.col("frequency") == frequency) if frequency else snaps), ends


def snapshot_scores(m: Market, frequency: str | None = None) -> DataFrame:
    """Panel rows on snapshot dates and month ends, scored and written once for a query."""
    snaps, ends = snapshot_days(m, frequency)
    days = snaps.select("bar_date").unionByName(ends.select("bar_date"))
    return m.once(f"snapshot scores {frequency}", lambda: stage(panel(m, days).drop("window_start")))


def month_end_distribution(m: Market, scores: DataFrame) -> DataFrame:
    """``distribution`` of scores that hold the month ends, on those dates; the as-of date is the newest of them."""
    _, ends = snapshot_days(m)
    return m.once("month end distribution", lambda: stage(distribution(m, scores.join(F.broadcast(ends), "bar_date", "left_semi"))))


@query("dyn_annotate", "template_id:i bar_date:d entity:i rank:i percentile:f industry:s tier:s quintile:s",
       """select d.template_id, d.bar_date, d.entity, d.rank, d.percentile, d.industry, case when c.total_mv is null then 'missing' when c.total_mv / 1e4 < 50 then '<50' else '50-200' end as tier,
            'Q' || cast(cast(ceil(5.0e0 * row_number() over (partition by d.template_id, d.bar_date order by c.total_mv, d.entity) / count(*) over (partition by d.template_id, d.bar_date)) as integer) as varchar) as quintile
          from dsc d join caps c on c.entity = d.entity and c.bar_date = d.bar_date where frequency = 'monthly'""")
def _(m: Market) -> DataFrame:
    rows = panel(m, month_ends(m)).join(m.caps, ["entity", "bar_date"], "left")
    keys = ["template_id", "bar_date"]
    by_score = stage(order_positions(rows, keys, "score", ["entity"]))
    sized = order_positions(by_score.withColumnRenamed("n_group", "n"), keys, "total_mv", ["entity"], descending=False, out="size_rank", total="n_sized", staged=True)
    return sized.withColumns({
        "percentile": (F.col("n") - F.col("rank") + 1) / F.col("n") * 100,
        "tier": cap_tier(F.col("total_mv")), "quintile": quintile(F.col("size_rank"), F.col("n_sized")),
    })


@query("dyn_thresholds", "template_id:i threshold:f p99_median:f months:i latest_max:f above_random:b above_ordinary:b risk:s",
       """with c(template_id, rmax, omax) as (values (1, 0.86e0, 0.90e0), (2, 0.84e0, 0.91e0), (3, 0.88e0, 0.85e0), (4, 0.95e0, 0.97e0)),
          l as (select template_id, max(score) as latest_max from scores where bar_date = (select d from dayref) group by 1)
          select f.*, l.latest_max, l.latest_max > c.rmax as above_random, l.latest_max > c.omax as above_ordinary,
            case when threshold <= least(rmax, omax) then 'high' when threshold <= greatest(rmax, omax) then 'mid' else 'lower' end as risk
          from frozen f join c using (template_id) join l using (template_id)""")
def _(m: Market) -> DataFrame:
    return threshold_table(m)


def threshold_table(m: Market, scores: DataFrame | None = None) -> DataFrame:
    """Thresholds beside the newest best score and the controls; written ``scores``, if given, hold the month ends."""
    _, ends = snapshot_days(m)
    if scores is None:
        scores = stage(sim.scores(m, ends).select("template_id", "bar_date", "score"))
    dist = month_end_distribution(m, scores)
    controls = m.spark.createDataFrame(CONTROLS, "template_id long, random_max double, ordinary_max double")
    newest = dist.where(F.col("bar_date") == m.as_of).select("template_id", F.col("max_score").alias("latest_max"))
    t = frozen_thresholds(dist, ends).join(controls, "template_id").join(newest, "template_id")
    lo, hi = F.least("random_max", "ordinary_max"), F.greatest("random_max", "ordinary_max")
    return t.withColumns({
        "above_random": F.col("latest_max") > F.col("random_max"), "above_ordinary": F.col("latest_max") > F.col("ordinary_max"),
        "risk": F.when(F.col("threshold") <= lo, "high").when(F.col("threshold") <= hi, "mid").otherwise("lower"),
    })


@query("dyn_distribution", "frequency:s seq:i template_id:i eligible:i max_score:f median_score:f p05:f p95:f p99:f width:f qualified:i qualified_share:f industry_width:i hhi:f reference:f position:f label:s",
       """with b as (select frequency, seq, template_id, count(*) as eligible, max(score) as max_score, median(score) as median_score, quantile_cont(score, 0.05) as p05, quantile_cont(score, 0.95) as p95,
            quantile_cont(score, 0.99) as p99, count(case when q then 1 end) as qualified from dsc group by 1, 2, 3),
          i as (select frequency, seq, template_id, count(*) as industry_width, sum(n * n) * 1.0e0 / (sum(n) * sum(n)) as hhi from
            (select frequency, seq, template_id, industry, count(*) as n from dsc where q group by all) group by 1, 2, 3),
          x as (select b.*, p95 - p05 as width, qualified * 1.0e0 / eligible as qualified_share, coalesce(industry_width, 0) as industry_width, coalesce(hhi, 0) as hhi,
            quantile_cont(p99, 0.75) over (partition by frequency, template_id order by seq rows between 26 preceding and 1 preceding) as reference,
            cume_dist() over (partition by frequency, template_id order by floor(p99 * 1e9)) as position from b left join i using (frequency, seq, template_id))
          select *, case when position >= 2/3.0e0 then 'high' when position <= 1/3.0e0 then 'low' else 'mid' end as label from x""")
def _(m: Market) -> DataFrame:
    rows = snapped(m)
    keys = ["frequency", "seq", "template_id"]
    base = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("eligible"), F.max("score").alias("max_score"), F.count_if(F.col("q")).alias("qualified"))
    spread = exact_quantiles(rows, keys, "score", {"p05": 0.05, "median_score": 0.5, "p95": 0.95, "p99": 0.99}, staged=True)
    per = rows.where(F.col("q")).groupBy(*keys, "industry").agg(F.count(F.lit(1)).alias("n"))
    width = per.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("industry_width"), (F.sum(F.col("n") * F.col("n")) / (F.sum("n") * F.sum("n"))).alias("hhi")
    )
    w = Window.partitionBy("frequency", "template_id")
    out = base.join(spread, keys).join(width, keys, "left").fillna(0, ["industry_width", "hhi"])
    return out.withColumns({
        "width": F.col("p95") - F.col("p05"), "qualified_share": F.col("qualified") / F.col("eligible"),
        "reference": F.expr("percentile(p99, 0.75)").over(w.orderBy("seq").rowsBetween(-26, -1)),
        "position": F.cume_dist().over(w.orderBy(F.floor(F.col("p99") * 1e9))),
    }).withColumn("label", position_label(F.col("position")))


@query("dyn_memberships", "template_id:i seq:i top_k:i entity:i rank:i streak:i",
       """with t as (select d.template_id, d.seq, k.top_k, d.entity, d.rank from dsc d, (select unnest([5, 10, 30, 100]) as top_k) k where frequency = 'monthly' and d.rank <= k.top_k)
          select template_id, seq, top_k, entity, rank, row_number() over (partition by template_id, top_k, entity, g order by seq) as streak
          from (select *, seq - row_number() over (partition by template_id, top_k, entity order by seq) as g from t)""")
def _(m: Market) -> DataFrame:
    snaps = snapshots(m).where(F.col("frequency") == "monthly")
    best = top_k(scored(m, snaps).join(F.broadcast(snaps), "bar_date"), ["template_id", "seq"], best_first(), KS[-1])
    sizes = F.filter(F.array(*[F.lit(k) for k in KS]), lambda k: F.col("rank") <= k)
    return streaks(best.withColumn("top_k", F.explode(sizes)), ["template_id", "top_k", "entity"], "seq")


@query("dyn_qualified", "template_id:i seq:i entity:i exceedance:f industry:s",
       "select template_id, seq, entity, score - threshold as exceedance, industry from dsc where frequency = 'monthly' and q")
def _(m: Market) -> DataFrame:
    return snapped(m, "monthly").where(F.col("q")).withColumn("exceedance", F.col("score") - F.col("threshold"))


@query("dyn_stability", "template_id:i seq:i top_k:i retention:f turnover:f baseline:f percentile_corr:f percentile_mae:f top_rank_corr:f boundary_share:f common:i",
       """with a as (select template_id, seq, entity, rank, n_group, percentile from dsc where frequency = 'monthly'),
          u as (select template_id, seq as s, entity, rank as rc, null as rp, n_group as nc, null as np, percentile as pc, null as pp from a
            union all select template_id, seq + 1, entity, null, rank, null, n_group, null, percentile from a),
          b as (select template_id, s as seq, entity, max(rc) as rc, max(rp) as rp, max(nc) as nc, max(np) as np, max(pc) as pc, max(pp) as pp from u group by 1, 2, 3),
          w as (select template_id, seq, count(case when rc is not null and rp is not null then 1 end) as common, corr(pp, pc) as percentile_corr, avg(abs(pp - pc)) as percentile_mae,
            corr(least(coalesce(rp, 101), 101), least(coalesce(rc, 101), 101)) filter (where coalesce(rc, 101) <= 100 or coalesce(rp, 101) <= 100) as top_rank_corr, greatest(max(nc), max(np)) as largest
            from b group by 1, 2 having count(rc) > 0 and count(rp) > 0),
          k as (select template_id, seq, k.top_k, count(case when rc <= k.top_k and rp <= k.top_k then 1 end) as kept,
            count(case when coalesce(rc <= k.top_k, false) <> coalesce(rp <= k.top_k, false) then 1 end) as changed,
            count(case when coalesce(rc <= k.top_k, false) <> coalesce(rp <= k.top_k, false) and (rc between k.top_k - 5 and k.top_k + 5 or rp between k.top_k - 5 and k.top_k + 5) then 1 end) as edge
            from b, (select unnest([5, 10, 30, 100]) as top_k) k group by 1, 2, 3)
          select w.*, k.top_k, kept * 1.0e0 / k.top_k as retention, 1 - kept * 1.0e0 / k.top_k as turnover, k.top_k * 1.0e0 / largest as baseline, coalesce(edge * 1.0e0 / nullif(changed, 0), 0) as boundary_share
          from w join k using (template_id, seq)""")
def _(m: Market) -> DataFrame:
    return D.stability(ranked_snapshots(m), KS, KS[-1])


def ranked_snapshots(m: Market, rows: DataFrame | None = None) -> DataFrame:
    """Monthly snapshots in full order; ``rows`` are those of a panel that is written already."""
    staged = rows is not None
    if rows is None:
        snaps = snapshots(m).where(F.col("frequency") == "monthly")
        rows = scored(m, snaps).join(F.broadcast(snaps), "bar_date")
    rows = rows.select("frequency", "template_id", "seq", "entity", "score")
    pos = order_positions(rows, ["frequency", "template_id", "seq"], "score", ["entity"], staged=staged)
    n = F.col("n_group")
    return stage(pos.withColumn("percentile", (n - F.col("rank") + 1) / n * 100))


@query("dyn_jaccard", "frequency:s seq:i a:i b:i jaccard_top:f jaccard_q:f common_q:i",
       """with t as (select frequency, seq, template_id, count(case when rank <= 30 then 1 end) as nt, count(case when q then 1 end) as nq from dsc group by 1, 2, 3),
          c as (select x.frequency, x.seq, x.template_id as a, y.template_id as b, count(case when x.rank <= 30 and y.rank <= 30 then 1 end) as ct, count(case when x.q and y.q then 1 end) as cq
            from dsc x join dsc y on x.frequency = y.frequency and x.seq = y.seq and x.entity = y.entity and x.template_id < y.template_id group by all)
          select l.frequency, l.seq, l.template_id as a, r.template_id as b, coalesce(coalesce(ct, 0) * 1.0e0 / nullif(l.nt + r.nt - coalesce(ct, 0), 0), 0) as jaccard_top,
            coalesce(coalesce(cq, 0) * 1.0e0 / nullif(l.nq + r.nq - coalesce(cq, 0), 0), 0) as jaccard_q, coalesce(cq, 0) as common_q
          from t l join t r on l.frequency = r.frequency and l.seq = r.seq and l.template_id < r.template_id
          left join c on c.frequency = l.frequency and c.seq = l.seq and c.a = l.template_id and c.b = r.template_id""")
def _(m: Market) -> DataFrame:
    rows = snapped(m)
    return pair_jaccard(rows, top_k(rows, ["frequency", "seq", "template_id"], best_first(), OVERLAP_K))


def pair_jaccard(rows: DataFrame, best: DataFrame) -> DataFrame:
    """Overlaps of the lists ``best`` and of the qualified rows; other rows are in no list and go before the shuffle.

    Every snapshot and template has a best row, so each keeps its counts.
    """
    keys = ["frequency", "seq", "template_id", "entity"]
    listed = best.select(*keys, F.lit(True).alias("top"), F.lit(False).alias("q"))
    qualified = rows.where(F.col("q")).select(*keys, F.lit(False).alias("top"), F.lit(True).alias("q"))
    members = stage(listed.unionByName(qualified).groupBy(*keys).agg(F.max("top").alias("top"), F.max("q").alias("q")))
    return D.pair_overlap(members, {"top": "top", "q": "q"})


@query("dyn_state", "frequency:s seq:i state:s count:i share:f",
       """select s.frequency, s.seq, x.state, count(case when d.state = x.state then 1 end) as count, count(case when d.state = x.state then 1 end) * 1.0e0 / count(*) as share
          from (select distinct frequency, seq from dstate) s cross join states x join dstate d on d.frequency = s.frequency and d.seq = s.seq group by 1, 2, 3""")
def _(m: Market) -> DataFrame:
    return D.state_counts(states(m, snapped(m)), state_names(m))


@query("dyn_label_counts", "frequency:s seq:i labels:s n:i", "select frequency, seq, labels, count(*) as n from dstate group by 1, 2, 3")
def _(m: Market) -> DataFrame:
    return states(m, snapped(m)).groupBy("frequency", "seq", "labels").agg(F.count(F.lit(1)).alias("n"))


_TRANS = """
mv as (select b.frequency, a.state as f, b.state as t, count(*) as n from dstate a join dstate b on a.frequency = b.frequency and a.entity = b.entity and b.seq = a.seq + 1 group by all),
gr as (select fr.frequency, x.state as from_state, y.state as to_state, coalesce(m.n, 0) as count, coalesce(r.n, 0) as back from (select distinct frequency from mv) fr cross join states x cross join states y
  left join mv m on m.frequency = fr.frequency and m.f = x.state and m.t = y.state left join mv r on r.frequency = fr.frequency and r.f = y.state and r.t = x.state),
tot as (select *, sum(count) over (partition by frequency, from_state) as rt, sum(count) over (partition by frequency, to_state) as ct, sum(count) over (partition by frequency) as gt,
  sum(back) over (partition by frequency, to_state) as bt from gr),
tr as (select frequency, from_state, to_state, count, coalesce(count * 1.0e0 / nullif(rt, 0), 0) as row_rate, coalesce(rt * ct * 1.0e0 / nullif(gt, 0), 0) as expected, coalesce(back * 1.0e0 / nullif(bt, 0), 0) as reverse_rate from tot)"""


@query("dyn_transition", "frequency:s from_state:s to_state:s count:i row_rate:f expected:f lift:f reverse_rate:f asymmetry_pp:f",
       f"with {_TRANS} select *, case when expected > 0 then count / expected end as lift, (row_rate - reverse_rate) * 100 as asymmetry_pp from tr")
def _(m: Market) -> DataFrame:
    return D.transitions(stage(states(m, snapped(m))), state_names(m))


@query("dyn_dwell", "frequency:s state:s runs:i mean_duration:f median_duration:f max_duration:i exit_rate:f",
       f"""with {_TRANS}, i as (select *, row_number() over (partition by frequency, entity order by seq) - row_number() over (partition by frequency, entity, state order by seq) as g from dstate),
          r as (select frequency, entity, state, g, count(*) as d from i group by all)
          select r.frequency, r.state, count(*) as runs, avg(d) as mean_duration, median(d) as median_duration, max(d) as max_duration, 1 - any_value(tr.row_rate) as exit_rate
          from r left join tr on tr.frequency = r.frequency and tr.from_state = r.state and tr.to_state = r.state group by 1, 2""")
def _(m: Market) -> DataFrame:
    st = stage(states(m, snapped(m)))
    return D.dwell(st, D.transitions(st, state_names(m)))


_WIL = """greatest(0, ((rate + 3.8416e0 / (2 * eligible)) / (1 + 3.8416e0 / eligible)) - 1.96e0 * sqrt(rate * (1 - rate) / eligible + 3.8416e0 / (4.0e0 * eligible * eligible)) / (1 + 3.8416e0 / eligible)) as wilson_low,
  least(1, ((rate + 3.8416e0 / (2 * eligible)) / (1 + 3.8416e0 / eligible)) + 1.96e0 * sqrt(rate * (1 - rate) / eligible + 3.8416e0 / (4.0e0 * eligible * eligible)) / (1 + 3.8416e0 / eligible)) as wilson_high"""
_IND = f"""
ix as (select *, {_WIL}, lag(rate) over (partition by frequency, template_id, industry order by seq) as prior_rate, lead(seq) over (partition by frequency, template_id, industry order by seq) as nxt,
  (rank() over (partition by frequency, seq, template_id order by rate) + (count(*) over (partition by frequency, seq, template_id, rate) - 1) / 2.0e0) / count(*) over (partition by frequency, seq, template_id) as rate_percentile from dind),
sel as (select d.frequency, d.template_id, d.industry, d.seq, d.entity, ix.nxt from dsc d join ix using (frequency, template_id, industry, seq) where d.q),
sp as (select frequency, template_id, industry, seq as o, entity, 1 as c, 0 as p from sel union all select frequency, template_id, industry, nxt, entity, 0, 1 from sel where nxt is not null),
bo as (select frequency, template_id, industry, o, entity, max(c) as c, max(p) as p from sp group by all),
fl as (select frequency, template_id, industry, o as seq, sum(c * (1 - p)) as nw, sum(c * p) as rt, sum(p * (1 - c)) as xt from bo group by all),
iy as (select ix.*, coalesce(nw, 0) as new_count, coalesce(rt, 0) as retained_count, coalesce(xt, 0) as exit_count, (rate - market_rate) * 100 as rate_excess_pp,
  (qualified * 1.0e0 / greatest(total_q, 1) - eligible * 1.0e0 / total_n) * 100 as share_excess_pp, eligible < 30 as small_sample,
  case when rate > market_rate and coalesce(rate > prior_rate, false) then 'strong_rising' when rate > market_rate then 'strong_fading' when coalesce(rate > prior_rate, false) then 'weak_improving' else 'weak_fading' end as status
  from ix left join fl using (frequency, template_id, industry, seq))"""


@query("dyn_industry", "frequency:s seq:i template_id:i industry:s eligible:i qualified:i rate:f market_rate:f rate_excess_pp:f share_excess_pp:f wilson_low:f wilson_high:f new_count:i retained_count:i exit_count:i status:s small_sample:b rate_percentile:f",
       f"with {_IND} select * from iy")
def _(m: Market) -> DataFrame:
    return D.industries(snapped(m))


@query("dyn_migration", "frequency:s from_template:i to_template:i count:i",
       f"""with {_IND}, ld as (select frequency, seq, industry, arg_max(template_id, struct_pack(a := round_even(rate_percentile * 1e9, 0), b := -template_id)) as t from iy group by 1, 2, 3)
          select b.frequency, a.t as from_template, b.t as to_template, count(*) as count from ld a join ld b on a.frequency = b.frequency and a.industry = b.industry and b.seq = a.seq + 1 group by all""")
def _(m: Market) -> DataFrame:
    return D.migration(stage(D.leaders(D.industries(snapped(m)))))


def current(m: Market) -> DataFrame:
    """Rows of the as-of date with their frozen threshold."""
    return snapped(m, "monthly").where(F.col("bar_date") == m.as_of)


@query("dyn_focus_industry", "template_id:i eligible:i qualified:i rate:f rank_among_large:i status:s rate_excess_pp:f top1:i top3_share:f rate_without_top1:f rate_without_top3:f",
       f"""with {_IND}, cur as (select d.*, row_number() over (partition by template_id, industry order by score desc, entity) as rn from dsc d where frequency = 'monthly' and bar_date = (select d from dayref)),
          f as (select template_id, industry, count(*) as eligible, count(case when q then 1 end) as qualified, count(case when q then 1 end) * 1.0e0 / count(*) as rate,
            coalesce(sum(case when rn <= 3 then greatest(score - threshold, 0) end) / nullif(sum(greatest(score - threshold, 0)), 0), 0) as top3_share,
            count(case when q and rn > 1 then 1 end) * 1.0e0 / greatest(count(*) - 1, 1) as rate_without_top1, count(case when q and rn > 3 then 1 end) * 1.0e0 / greatest(count(*) - least(3, count(*)), 1) as rate_without_top3
            from cur group by 1, 2),
          r as (select *, case when eligible >= 30 then (select count(*) from f g where g.template_id = f.template_id and g.eligible >= 30 and (g.rate > f.rate or (g.rate = f.rate and g.industry < f.industry))) + 1 end as rank_among_large from f)
          select r.*, coalesce(iy.status, 'missing') as status, iy.rate_excess_pp, c.entity as top1 from r
          left join iy on iy.template_id = r.template_id and iy.industry = r.industry and iy.frequency = 'monthly' and iy.bar_date = (select d from dayref)
          left join cur c on c.template_id = r.template_id and c.industry = r.industry and c.rn = 1 where r.industry = '{FOCUS}'""")
def _(m: Market) -> DataFrame:
    rows = current(m)
    focus = rows.where(F.col("industry") == FOCUS)
    over = F.greatest(F.col("score") - F.col("threshold"), F.lit(0.0))
    lead = top_k(focus, ["template_id"], best_first(), 3, "rn").groupBy("template_id").agg(
        F.sum(over).alias("top3"), F.count_if(F.col("q")).alias("q3"), F.count_if(F.col("q") & (F.col("rn") == 1)).alias("q1"),
        F.max(F.when(F.col("rn") == 1, F.col("entity"))).alias("top1"),
    )
    trend = D.industries(snapped(m, "monthly")).where((F.col("industry") == FOCUS) & (F.col("bar_date") == m.as_of)).select(
        "template_id", "status", "rate_excess_pp"
    )
    rates = rows.groupBy("template_id", "industry").agg(
        F.count(F.lit(1)).alias("eligible"), F.count_if(F.col("q")).alias("qualified"), F.sum(over).alias("excess")
    ).withColumn("rate", F.col("qualified") / F.col("eligible"))
    # One row per industry of the catalog reaches this window.
    order = Window.partitionBy("template_id", F.col("eligible") >= LARGE).orderBy(F.col("rate").desc(), "industry")
    ranked_ = rates.withColumn("rank_among_large", F.when(F.col("eligible") >= LARGE, F.row_number().over(order))).where(F.col("industry") == FOCUS)
    n, q = F.col("eligible"), F.col("qualified")
    return ranked_.join(lead, "template_id").join(trend, "template_id", "left").withColumns({
        "status": F.coalesce("status", F.lit("missing")),
        "top3_share": F.coalesce(F.try_divide("top3", "excess"), F.lit(0.0)),
        "rate_without_top1": (q - F.col("q1")) / F.greatest(n - 1, F.lit(1)),
        "rate_without_top3": (q - F.col("q3")) / F.greatest(n - F.least(F.lit(3), n), F.lit(1)),
    })


@query("dyn_cap", "template_id:i seq:i dimension:s grp:s eligible:i qualified:i rate:f rate_excess_pp:f",
       """with c as (select d.template_id, d.seq, d.q, case when c.total_mv < 100 then 'small' when c.total_mv < 200 then 'mid' else 'large' end as tier,
            'Q' || cast(cast(ceil(5.0e0 * row_number() over (partition by d.template_id, d.seq order by c.total_mv, d.entity) / count(*) over (partition by d.template_id, d.seq)) as integer) as varchar) as quintile
            from dsc d join caps c on c.entity = d.entity and c.bar_date = d.bar_date where frequency = 'monthly'),
          u as (select template_id, seq, q, 'tier' as dimension, tier as grp from c union all select template_id, seq, q, 'quintile', quintile from c),
          g as (select template_id, seq, dimension, grp, count(*) as eligible, count(case when q then 1 end) as qualified from u group by all)
          select *, qualified * 1.0e0 / eligible as rate, (qualified * 1.0e0 / eligible - sum(qualified) over w * 1.0e0 / sum(eligible) over w) * 100 as rate_excess_pp from g window w as (partition by template_id, seq, dimension)""")
def _(m: Market) -> DataFrame:
    g = sized(m)
    dims = F.array(
        F.struct(F.lit("tier").alias("dimension"), F.col("tier").alias("grp")),
        F.struct(F.lit("quintile").alias("dimension"), F.col("quintile").alias("grp")),
    )
    long = g.select("template_id", "seq", "q", F.explode(dims).alias("d")).select("template_id", "seq", "q", "d.*")
    per = long.groupBy("template_id", "seq", "dimension", "grp").agg(F.count(F.lit(1)).alias("eligible"), F.count_if(F.col("q")).alias("qualified"))
    w = Window.partitionBy("template_id", "seq", "dimension")
    market = F.sum("qualified").over(w) / F.sum("eligible").over(w)
    return per.withColumn("rate", F.col("qualified") / F.col("eligible")).withColumn("rate_excess_pp", (F.col("rate") - market) * 100)


def size_tier(mv):
    """Cut points that spread the adapter's traded amounts over three tiers."""
    return F.when(mv < 100, "small").when(mv < 200, "mid").otherwise("large")


def sized(m: Market) -> DataFrame:
    rows = snapped(m, "monthly").join(m.caps, ["entity", "bar_date"])
    pos = order_positions(rows, ["template_id", "seq"], "total_mv", ["entity"], descending=False, out="size_rank", total="n_sized")
    return pos.withColumns({"tier": size_tier(F.col("total_mv")), "quintile": quintile(F.col("size_rank"), F.col("n_sized"))})


@query("dyn_cap_shift", "seq:i common:i tier_shift:f quintile_shift:f",
       """with c as (select s.seq, c.entity, case when c.total_mv < 100 then 'small' when c.total_mv < 200 then 'mid' else 'large' end as tier,
            ceil(5.0e0 * row_number() over (partition by s.seq order by c.total_mv, c.entity) / count(*) over (partition by s.seq)) as quintile from caps c join snaps s on s.bar_date = c.bar_date where s.frequency = 'monthly')
          select b.seq, count(*) as common, avg(case when a.tier <> b.tier then 1.0e0 else 0 end) as tier_shift, avg(case when a.quintile <> b.quintile then 1.0e0 else 0 end) as quintile_shift
          from c a join c b on a.entity = b.entity and b.seq = a.seq + 1 group by 1""")
def _(m: Market) -> DataFrame:
    snaps = snapshots(m).where(F.col("frequency") == "monthly")
    rows = m.caps.join(F.broadcast(snaps), "bar_date")
    pos = order_positions(rows, ["seq"], "total_mv", ["entity"], descending=False, out="size_rank", total="n_sized")
    g = stage(pos.withColumns({"tier": size_tier(F.col("total_mv")), "quintile": quintile(F.col("size_rank"), F.col("n_sized"))}))
    both = D.previous(g.select("entity", "seq", "tier", "quintile"), ["entity"], ["tier", "quintile"])
    return both.groupBy("seq").agg(
        F.count(F.lit(1)).alias("common"), F.avg(flag(F.col("tier") != F.col("prev_tier"))).alias("tier_shift"),
        F.avg(flag(F.col("quintile") != F.col("prev_quintile"))).alias("quintile_shift"),
    )


@query("dyn_exclusion", "template_id:i variant:s eligible:i qualified:i rate:f change_pp:f",
       f"""with cur as (select d.*, row_number() over (partition by template_id, industry order by score desc, entity) as rn from dsc d where frequency = 'monthly' and bar_date = (select d from dayref)),
          v as (select template_id, q, 'base' as variant from cur union all select template_id, q, 'without focus' from cur where industry <> '{FOCUS}'
            union all select template_id, q, 'without top1' from cur where rn > 1 union all select template_id, q, 'without top3' from cur where rn > 3),
          g as (select template_id, variant, count(*) as eligible, count(case when q then 1 end) as qualified from v group by 1, 2)
          select *, qualified * 1.0e0 / greatest(eligible, 1) as rate, (qualified * 1.0e0 / greatest(eligible, 1) - max(case when variant = 'base' then qualified * 1.0e0 / eligible end) over (partition by template_id)) * 100 as change_pp from g""")
def _(m: Market) -> DataFrame:
    return exclusions(current(m))


def exclusions(rows: DataFrame) -> DataFrame:
    """Leader removal is arithmetic on industry counts; the variants are columns of one pass."""
    per = rows.groupBy("template_id", "industry").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("q")).alias("k"))

    def cut(c: str, j: int):
        return F.greatest(F.col(c) - j, F.lit(0))

    out_focus = F.col("industry") != FOCUS
    wide = per.groupBy("template_id").agg(
        F.sum("n").alias("n0"), F.sum("k").alias("k0"),
        F.sum(F.when(out_focus, F.col("n"))).alias("n1"), F.sum(F.when(out_focus, F.col("k"))).alias("k1"),
        F.sum(cut("n", 1)).alias("n2"), F.sum(cut("k", 1)).alias("k2"), F.sum(cut("n", 3)).alias("n3"), F.sum(cut("k", 3)).alias("k3"),
    )
    names = ("base", "without focus", "without top1", "without top3")
    rows = F.array(*[F.struct(F.lit(v).alias("variant"), F.col(f"n{i}").alias("eligible"), F.col(f"k{i}").alias("qualified")) for i, v in enumerate(names)])
    long = wide.select("template_id", (F.col("k0") / F.col("n0")).alias("base_rate"), F.explode(rows).alias("r")).select("template_id", "base_rate", "r.*")
    # A variant that removes every row has no group in the report.
    long = long.where(F.col("eligible") > 0).withColumn("rate", F.col("qualified") / F.greatest(F.col("eligible"), F.lit(1)))
    return long.withColumn("change_pp", (F.col("rate") - F.col("base_rate")) * 100)


@query("dyn_history", "template_id:i seq:i eligible:i max_score:f median_score:f p99:f qualified:i coverage:i hhi:f turnover:f",
       """with b as (select template_id, seq, count(*) as eligible, max(score) as max_score, median(score) as median_score, quantile_cont(score, 0.99) as p99, count(case when q then 1 end) as qualified
            from dsc where frequency = 'monthly' group by 1, 2),
          g as (select template_id, seq, industry, count(*) as n from dsc where frequency = 'monthly' and rank <= 100 group by 1, 2, 3),
          h as (select template_id, seq, count(*) as coverage, cast(sum(n * n) as double) / cast(sum(n) * sum(n) as double) as hhi from g group by 1, 2),
          t as (select a.template_id, b.seq, count(*) as kept from dsc a join dsc b on a.template_id = b.template_id and a.entity = b.entity and b.seq = a.seq + 1 and a.frequency = 'monthly' and b.frequency = 'monthly' and a.rank <= 100 and b.rank <= 100 group by 1, 2)
          select b.*, h.coverage, h.hhi, case when p.seq is not null then 1 - coalesce(t.kept, 0) / 100.0e0 end as turnover from b join h using (template_id, seq)
          left join t on t.template_id = b.template_id and t.seq = b.seq left join b p on p.template_id = b.template_id and p.seq = b.seq - 1""")
def _(m: Market) -> DataFrame:
    rows = snapped(m, "monthly")
    return history(m, rows, top_k(rows, ["template_id", "seq"], best_first(), K))


def history(m: Market, rows: DataFrame, best: DataFrame) -> DataFrame:
    keys = ["template_id", "seq"]
    base = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("eligible"), F.max("score").alias("max_score"), F.count_if(F.col("q")).alias("qualified"))
    spread = exact_quantiles(rows, keys, "score", {"median_score": 0.5, "p99": 0.99}, staged=True)
    top = stage(best.select(*keys, "entity", "industry", "rank"))
    kept = top.select(*keys, "entity").join(
        top.select("template_id", "entity", (F.col("seq") + 1).alias("seq")), ["template_id", "entity", "seq"], "left_semi"
    ).groupBy(*keys).agg(F.count(F.lit(1)).alias("kept"))
    before = base.select("template_id", (F.col("seq") + 1).alias("seq"), F.lit(True).alias("has_prior"))
    out = base.join(spread, keys).join(concentration(top, keys, "industry").select(*keys, "coverage", "hhi"), keys)
    out = out.join(kept, keys, "left").join(before, keys, "left")
    return out.withColumn("turnover", F.when(F.col("has_prior"), 1 - F.coalesce("kept", F.lit(0)) / F.lit(float(K))))


@query("dyn_annotations", "template_id:i entity:i rank:i percentile:f up_count:i down_count:i suspension_count:i abnormal:b event_driven:b",
       EVENTS_SQL + """select template_id, entity, rank, (n - rank + 1) * 100.0e0 / n as percentile, up_count, down_count, suspension_count, max_abs_pct >= 9.5 as abnormal,
         up_count + down_count > 0 or suspension_count > 0 or max_abs_pct >= 9.5 as event_driven
         from (select *, row_number() over (partition by template_id order by score desc, entity) as rank, count(*) over (partition by template_id) as n from evc)""")
def _(m: Market) -> DataFrame:
    pos = order_positions(events(m), ["template_id"], "score", ["entity"])
    n, jump = F.col("n_group"), F.col("max_abs_pct") >= 9.5
    return pos.withColumns({
        "percentile": (n - F.col("rank") + 1) / n * 100, "abnormal": jump,
        "event_driven": (F.col("up_count") + F.col("down_count") > 0) | (F.col("suspension_count") > 0) | jump,
    })


VERDICTS = (
    Rule("H1", "score levels differ between templates", (("supported", (("score_spread", ">=", 0.08),)),)),
    Rule("H2", "the leading industry is the same in short and long lists", (("supported", (("stable_industry", ">=", 3),)),)),
    Rule("H3", "the leading size tier is the same in short and long lists", (("supported", (("stable_tier", ">=", 3),)),)),
    Rule("H4", "coverage and concentration tell wide supply from a crowded one", otherwise="supported",
         evidence=("coverage_min", "coverage_max", "hhi_min", "hhi_max")),
    Rule("H5", "templates pick different securities", (("supported", (("max_overlap", "<=", 0.25),)),)),
    Rule("H6", "lists are not driven by single events",
         (("not_supported", (("max_event", ">=", 0.8),)), ("weak", (("max_event", ">=", 0.5),))), "supported"),
    Rule("H7", "supply and membership vary over time",
         (("supported", (("supply_cv", ">=", 0.25),)), ("supported", (("list_turnover", ">=", 0.4),)))),
    Rule("H8", "some template is weak against its own history", (("supported", (("weak_supply", ">=", 1),)),)),
    Rule("A1", "templates need thresholds of their own", (("supported", (("threshold_range", ">=", 0.03),)),), evidence=("controls_hit",)),
    Rule("A2", "a fixed top share hides changing supply", (("supported", (("max_cv", ">=", 0.25),)),)),
    Rule("A3", "best scores do not beat the control populations", (("supported", (("controls_hit", ">=", 2),)),)),
    Rule("B1", "highest score, tail and counts place the supply", (("supported", (("max_cv", ">=", 0.25),)),)),
    Rule("C1", "turnover is mostly at the boundary of the list", (
        ("supported", (("boundary", ">=", 0.35), ("whole_corr", ">=", 0.7), ("top100_turnover", "<=", 0.6))),
        ("weak", (("boundary", ">=", 0.25), ("whole_corr", ">=", 0.7), ("top100_turnover", "<=", 0.8)))), "not_supported"),
    Rule("D1", "template pairs differ and states follow each other", (("supported", (("jaccard_spread", ">=", 0.05), ("max_lift", ">=", 1.2))),)),
    Rule("E1", "the focus industry is fading", (("supported", (("focus_weak", ">=", 2),)),)),
    Rule("E2/E3", "industries by rate and excess share, sizes by fixed tiers and quintiles", otherwise="supported", evidence=("small_industries",)),
    Rule("F1", "lists are robust to the window length", (("supported", (("window_median", ">=", 0.25),)),), evidence=("exclusion_change",)),
)
LISTS = (10, 30, 100)  # sizes in which a leader has to be the same
EVENT_K = 30  # windows of a template that are searched for events


def _as_rows(df: DataFrame, names: list[str]) -> DataFrame:
    """One row of measures as (measure, value) rows."""
    cells = F.array(*[F.struct(F.lit(n).alias("measure"), F.col(n).cast("double").alias("value")) for n in names])
    return df.select(F.explode(cells).alias("c")).select("c.*")


def _variation(counts: DataFrame, keys: list[str], out: str) -> DataFrame:
    """Largest coefficient of variation of n over the groups; 0 for a group of zeros."""
    per = counts.groupBy(*keys).agg(F.coalesce(F.try_divide(F.stddev_pop("n"), F.avg("n")), F.lit(0.0)).alias("cv"))
    return _as_rows(per.agg(F.max("cv").alias(out)), [out])


def _median(column: str):
    return F.expr(f"percentile({column}, 0.5)")


def verdict_measures(m: Market) -> DataFrame:
    """(measure, value) of everything that ``VERDICTS`` looks at."""
    rows = snapped(m)
    monthly = rows.where(F.col("frequency") == "monthly")
    m.once("snapped monthly", lambda: monthly)
    # one list for each date serves both frequencies, the histories, the overlaps and the newest lists
    daily = stage(top_k(snapshot_scores(m), ["template_id", "bar_date"], best_first(), K).select("template_id", "bar_date", "entity", "score", "industry", "rank"))
    best = daily.join(F.broadcast(snapshot_days(m)[0]), "bar_date")
    best_monthly = best.where(F.col("frequency") == "monthly")
    h = stage(history(m, monthly, best_monthly))
    newest = h.agg(F.max("seq")).scalar()
    own = h.groupBy("template_id").agg(_median("p99").alias("mp"), _median("max_score").alias("mm"))
    now = stage(h.where(F.col("seq") == newest).join(own, "template_id"))
    levels = now.agg(
        F.greatest(F.max("p99") - F.min("p99"), F.max("median_score") - F.min("median_score")).alias("score_spread"),
        F.count_if((F.col("p99") < F.col("mp")) & (F.col("max_score") < F.col("mm"))).alias("weak_supply"),
    )
    lines = now.select("template_id", F.col("p99").alias("line"))
    reached = monthly.join(lines, "template_id").groupBy("template_id", "seq").agg(F.count_if(F.col("score") >= F.col("line")).alias("n"))
    qualified = rows.groupBy("frequency", "template_id", "seq").agg(F.count_if(F.col("q")).alias("n"))
    limits = threshold_table(m, snapshot_scores(m)).agg(
        (F.max("threshold") - F.min("threshold")).alias("threshold_range"),
        F.count_if(~F.col("above_random") | ~F.col("above_ordinary")).alias("controls_hit"),
    )

    stable = stage(D.stability(ranked_snapshots(m, monthly), KS, KS[-1]))
    short, long = stable.where(F.col("top_k") == 30), stable.where(F.col("top_k") == 100)
    turnover = short.groupBy("template_id").agg(_median("turnover").alias("t")).agg(_median("t").alias("list_turnover"))
    edge = short.agg(_median("boundary_share").alias("boundary"), _median("percentile_corr").alias("whole_corr"))
    top100 = long.agg(_median("turnover").alias("top100_turnover"))

    pairs = stage(pair_jaccard(rows, best.where(F.col("rank") <= OVERLAP_K)))
    middle = pairs.groupBy("a", "b").agg(_median("jaccard_top").alias("j")).agg((F.max("j") - F.min("j")).alias("jaccard_spread"))
    overlap = pairs.where((F.col("frequency") == "monthly") & (F.col("seq") == newest)).agg(F.coalesce(F.max("jaccard_top"), F.lit(0.0)).alias("max_overlap"))
    moves = D.transitions(stage(states(m, rows)), state_names(m)).where((F.col("from_state") != "none") & (F.col("to_state") != "none"))
    lift = moves.agg(F.coalesce(F.max("lift"), F.lit(0.0)).alias("max_lift"))
    latest = D.industries(monthly).where(F.col("seq") == newest)
    focus = latest.agg(
        F.count_if((F.col("industry") == FOCUS) & F.col("status").isin("strong_fading", "weak_fading")).alias("focus_weak"),
        F.count_if("small_sample").alias("small_industries"),
    )
    windows = stage(sim.best_windows(m, EVENT_K))
    window = sim.sensitivity(windows).agg(_median("jaccard").alias("window_median"))
    removed = exclusions(current(m)).where(F.col("variant") != "base").agg(F.max(F.abs("change_pp")).alias("exclusion_change"))

    newest_best = best_monthly.where(F.col("seq") == newest).join(m.caps, ["entity", "bar_date"], "left")
    lists = stage(newest_best.withColumn("tier", size_tier(F.col("total_mv"))).withColumn(
        "size", F.explode(F.filter(F.array(*[F.lit(k) for k in LISTS]), lambda k: F.col("rank") <= k))
    ))
    industry = concentration(lists, ["template_id", "size"], "industry")
    same = industry.groupBy("template_id").agg(F.count_distinct("leader").alias("n")).agg(F.count_if(F.col("n") == 1).alias("stable_industry"))
    tier = concentration(lists, ["template_id", "size"], "tier").groupBy("template_id").agg(F.count_distinct("leader").alias("n"))
    tier = tier.agg(F.count_if(F.col("n") == 1).alias("stable_tier"))
    width = industry.where(F.col("size") == 30).agg(
        F.min("coverage").alias("coverage_min"), F.max("coverage").alias("coverage_max"), F.min("hhi").alias("hhi_min"), F.max("hhi").alias("hhi_max")
    )
    # the lists are chosen by score alone, so only the bars of their securities are searched for events
    driven = events_in(m, windows.where(F.col("variant") == "base").drop("variant", "rank"))
    hit = (F.col("up_count") + F.col("down_count") > 0) | (F.col("suspension_count") > 0) | (F.col("max_abs_pct") >= 9.5)
    event = driven.groupBy("template_id").agg(F.avg(flag(hit)).alias("e")).agg(F.coalesce(F.max("e"), F.lit(0.0)).alias("max_event"))

    frames = [levels, limits, turnover, edge, top100, middle, overlap, lift, focus, window, removed, same, tier, width, event]
    out = _variation(reached, ["template_id"], "supply_cv").unionByName(_variation(qualified, ["frequency", "template_id"], "max_cv"))
    for frame in frames:
        out = out.unionByName(_as_rows(frame, frame.columns))
    return out


def _verdict_sql() -> str:
    sql = {name: QUERIES[name].sql for name in ("dyn_thresholds", "dyn_stability", "dyn_jaccard", "dyn_transition", "dyn_industry", "dyn_exclusion", "sim_window_sensitivity")}
    leader = """select count(*) from (select template_id from (select template_id, size, arg_max({g}, struct_pack(a := n, b := -fr)) as leader
      from (select template_id, size, {g}, count(*) as n, min(rank) as fr from lists group by all) group by 1, 2) group by 1 having count(distinct leader) = 1)"""
    return f"""with {EVENTS_SQL.strip().removeprefix("with").strip()},
      h as (select template_id, seq, max(score) as mx, quantile_cont(score, 0.99) as p99, median(score) as md from dsc where frequency = 'monthly' group by 1, 2),
      ns as (select max(seq) as s from h), nowh as (select h.*, median(p99) over w as mp, median(mx) over w as mm from h window w as (partition by template_id)),
      nw as (select * from nowh where seq = (select s from ns)),
      reached as (select d.template_id, d.seq, count(case when d.score >= n.p99 then 1 end) as n from dsc d join nw n using (template_id) where d.frequency = 'monthly' group by 1, 2),
      qual as (select frequency, template_id, seq, count(case when q then 1 end) as n from dsc group by 1, 2, 3),
      thr_t as ({sql["dyn_thresholds"]}), stab as ({sql["dyn_stability"]}), jac as ({sql["dyn_jaccard"]}), trn as ({sql["dyn_transition"]}), ind as ({sql["dyn_industry"]}),
      exc as ({sql["dyn_exclusion"]}), wsn as ({sql["sim_window_sensitivity"]}),
      best as (select d.*, case when c.total_mv < 100 then 'small' when c.total_mv < 200 then 'mid' when c.total_mv is not null then 'large' end as tier
        from dsc d left join caps c on c.entity = d.entity and c.bar_date = d.bar_date where d.frequency = 'monthly' and d.seq = (select s from ns) and d.rank <= 100),
      lists as (select b.*, k.size from best b join (select unnest([10, 30, 100]) as size) k on b.rank <= k.size),
      conc as (select template_id, count(*) as coverage, cast(sum(n * n) as double) / cast(sum(n) * sum(n) as double) as hhi
        from (select template_id, industry, count(*) as n from lists where size = 30 group by 1, 2) group by 1),
      ev30 as (select * from evc qualify row_number() over (partition by template_id order by score desc, entity) <= 30),
      row1 as (select
        (select greatest(max(p99) - min(p99), max(md) - min(md)) from nw) as score_spread, cast((select count(*) from nw where p99 < mp and mx < mm) as double) as weak_supply,
        (select max(v) from (select coalesce(stddev_pop(n) / nullif(avg(n), 0), 0) as v from reached group by template_id)) as supply_cv,
        (select max(v) from (select coalesce(stddev_pop(n) / nullif(avg(n), 0), 0) as v from qual group by frequency, template_id)) as max_cv,
        (select max(threshold) - min(threshold) from thr_t) as threshold_range, cast((select count(*) from thr_t where not above_random or not above_ordinary) as double) as controls_hit,
        (select median(t) from (select median(turnover) as t from stab where top_k = 30 group by template_id)) as list_turnover,
        (select median(boundary_share) from stab where top_k = 30) as boundary, (select median(percentile_corr) from stab where top_k = 30 and not isnan(percentile_corr)) as whole_corr,
        (select median(turnover) from stab where top_k = 100) as top100_turnover,
        (select max(j) - min(j) from (select median(jaccard_top) as j from jac group by a, b)) as jaccard_spread,
        (select coalesce(max(jaccard_top), 0) from jac where frequency = 'monthly' and seq = (select s from ns)) as max_overlap,
        (select coalesce(max(lift), 0) from trn where from_state <> 'none' and to_state <> 'none') as max_lift,
        cast((select count(*) from ind where frequency = 'monthly' and seq = (select s from ns) and industry = '{FOCUS}' and status in ('strong_fading', 'weak_fading')) as double) as focus_weak,
        cast((select count(*) from ind where frequency = 'monthly' and seq = (select s from ns) and small_sample) as double) as small_industries,
        (select median(jaccard) from wsn) as window_median, (select max(abs(change_pp)) from exc where variant <> 'base') as exclusion_change,
        cast(({leader.format(g="industry")}) as double) as stable_industry, cast(({leader.format(g="tier")}) as double) as stable_tier,
        (select min(coverage) * 1.0e0 from conc) as coverage_min, (select max(coverage) * 1.0e0 from conc) as coverage_max, (select min(hhi) from conc) as hhi_min, (select max(hhi) from conc) as hhi_max,
        (select coalesce(max(e), 0) from (select avg(case when up_count + down_count > 0 or suspension_count > 0 or max_abs_pct >= 9.5 then 1.0e0 else 0 end) as e from ev30 group by template_id)) as max_event)
      {evaluate_sql(VERDICTS, "row1")}"""


@query("dyn_verdicts", "id:s decision:s wording:s measure:s value:f", _verdict_sql())
def _(m: Market) -> DataFrame:
    names = list(dict.fromkeys(n for r in VERDICTS for n in r.measures()))
    return evaluate(one_row(verdict_measures(m), names), VERDICTS)


# ---------------------------------------------------------------- audits

VARIANTS = (2, 4)


@query("aud_compare_variants", "bar_date:d eligible_a:i eligible_b:i spearman:f overlap:i jaccard:f",
       """with a as (select * from ranked where template_id = 2), b as (select * from ranked where template_id = 4),
          c as (select a.bar_date, a.entity, row_number() over (partition by a.bar_date order by a.rank) as ra, row_number() over (partition by a.bar_date order by b.rank) as rb, a.rank as ka, b.rank as kb
            from a join b on a.bar_date = b.bar_date and a.entity = b.entity),
          s as (select bar_date, case when count(*) >= 3 then corr(ra, rb) end as spearman, count(case when ka <= 100 and kb <= 100 then 1 end) as overlap from c group by 1),
          n as (select bar_date, count(case when template_id = 2 then 1 end) as eligible_a, count(case when template_id = 4 then 1 end) as eligible_b, count(case when template_id = 2 and rank <= 100 then 1 end) as ta,
            count(case when template_id = 4 and rank <= 100 then 1 end) as tb from ranked where template_id in (2, 4) group by 1)
          select n.bar_date, eligible_a, eligible_b, spearman, coalesce(overlap, 0) as overlap, coalesce(coalesce(overlap, 0) * 1.0e0 / nullif(ta + tb - coalesce(overlap, 0), 0), 0) as jaccard from n left join s using (bar_date)""")
def _(m: Market) -> DataFrame:
    rows = stage(scored(m).where(F.col("template_id").isin(*VARIANTS)).select("template_id", "bar_date", "entity", "score"))
    best = top_k(rows, ["template_id", "bar_date"], best_first(), K).select("template_id", "bar_date", "entity", F.lit(1).alias("top"))
    flagged = rows.join(best, ["template_id", "bar_date", "entity"], "left")

    def side(v: int, n: str):
        return F.max(F.when(F.col("template_id") == v, F.col(n)))

    a, b = VARIANTS
    both = stage(flagged.groupBy("bar_date", "entity").agg(
        side(a, "score").alias("sa"), side(b, "score").alias("sb"), side(a, "top").alias("ta"), side(b, "top").alias("tb")
    ))
    shared = stage(both.where(F.col("sa").isNotNull() & F.col("sb").isNotNull()))
    one = stage(order_positions(shared, ["bar_date"], "sa", ["entity"], out="ra", total=None, staged=True))
    two = order_positions(one, ["bar_date"], "sb", ["entity"], out="rb", total=None, staged=True)
    corr = two.groupBy("bar_date").agg(F.when(F.count(F.lit(1)) >= 3, corr_or_null("ra", "rb")).alias("spearman"))
    counts = both.groupBy("bar_date").agg(
        F.count("sa").alias("eligible_a"), F.count("sb").alias("eligible_b"), F.count_if((F.col("ta") == 1) & (F.col("tb") == 1)).alias("overlap"),
        F.count("ta").alias("na"), F.count("tb").alias("nb"),
    )
    jac = F.coalesce(F.try_divide("overlap", F.col("na") + F.col("nb") - F.col("overlap")), F.lit(0.0))
    return counts.join(corr, "bar_date", "left").withColumn("jaccard", jac)


_STAB = """
lg as (select unnest([1, 5, 10]) as lag),
df as (select distinct template_id, ord from daily where template_id in (2, 4)),
pr as (select d.template_id, l.lag, d.ord from df d cross join lg l join df p on p.template_id = d.template_id and p.ord = d.ord - l.lag),
cm as (select pr.template_id, pr.lag, pr.ord, a.rank as ra, b.rank as rb from pr join daily a on a.template_id = pr.template_id and a.ord = pr.ord join daily b on b.template_id = pr.template_id and b.ord = pr.ord - pr.lag and b.entity = a.entity),
sz as (select template_id, ord, count(*) as n from daily group by 1, 2),
rk as (select *, row_number() over (partition by template_id, lag, ord order by ra) as xa, row_number() over (partition by template_id, lag, ord order by rb) as xb from cm),
ob as (select pr.template_id, pr.lag, pr.ord, count(rk.ra) as overlap, count(rk.ra) * 1.0e0 / (any_value(s1.n) + any_value(s2.n) - count(rk.ra)) as jaccard, case when count(rk.ra) >= 3 then corr(xa, xb) end as spearman
  from pr left join rk using (template_id, lag, ord) join sz s1 on s1.template_id = pr.template_id and s1.ord = pr.ord join sz s2 on s2.template_id = pr.template_id and s2.ord = pr.ord - pr.lag group by 1, 2, 3)"""


def stability_observations(m: Market) -> DataFrame:
    from tapeloom.operators.flows import shifted_states

    top = stage(top_k(scored(m).where(F.col("template_id").isin(*VARIANTS)), ["template_id", "bar_date"], best_first(), K).select("template_id", "ord", "entity", "rank"))
    newest = m.cal.agg(F.max("ord")).scalar()
    states = shifted_states(top, ["template_id"], [1, 5, 10], ["rank"], newest)
    both = F.col("state") == "retained"
    keys = ["template_id", "lag", "ord"]
    # At most k current and k prior members per group.
    inside = states.where(both).withColumns({
        "xa": F.row_number().over(Window.partitionBy(*keys).orderBy("cur.rank")), "xb": F.row_number().over(Window.partitionBy(*keys).orderBy("prior.rank")),
    })
    corr = inside.groupBy(*keys).agg(F.when(F.count(F.lit(1)) >= 3, corr_or_null("xa", "xb")).alias("spearman"))
    counts = states.groupBy(*keys).agg(
        F.count_if(both).alias("overlap"), F.count(F.lit(1)).alias("n_union"), F.count("cur").alias("nc"), F.count("prior").alias("np")
    ).where((F.col("nc") > 0) & (F.col("np") > 0))
    return counts.join(corr, keys, "left").withColumn("jaccard", F.col("overlap") / F.col("n_union"))


@query("aud_stability", "template_id:i lag:i ord:i overlap:i jaccard:f spearman:f", f"with {_STAB} select * from ob")
def _(m: Market) -> DataFrame:
    return stability_observations(m)


@query("agg_group_rank_summary", "template_id:i lag:i observations:i overlap_mean:f overlap_median:f overlap_min:i jaccard_mean:f jaccard_median:f spearman_mean:f",
       f"""with {_STAB} select template_id, lag, count(*) as observations, avg(overlap) as overlap_mean, median(overlap) as overlap_median, min(overlap) as overlap_min, avg(jaccard) as jaccard_mean,
          median(jaccard) as jaccard_median, avg(spearman) as spearman_mean from ob group by 1, 2""")
def _(m: Market) -> DataFrame:
    # One observation per date: the exact percentile is bounded by the calendar.
    return stability_observations(m).groupBy("template_id", "lag").agg(
        F.count(F.lit(1)).alias("observations"), F.avg("overlap").alias("overlap_mean"), F.expr("percentile(overlap, 0.5)").alias("overlap_median"),
        F.min("overlap").alias("overlap_min"), F.avg("jaccard").alias("jaccard_mean"), F.expr("percentile(jaccard, 0.5)").alias("jaccard_median"),
        F.avg("spearman").alias("spearman_mean"),
    )


REVIEW_K, DRAFT = 20, 1.1  # items of a review; window of the draft as a multiple of the registered one
_REVIEW = "template_id:i kind:s role:s rank:i entity:i score:f return_pct:f drawdown_pct:f max_day_pct:f up:i down:i suspensions:i flags:s n:i more:i"


def _review_sql() -> str:
    variants = QUERIES["sim_window_sensitivity"].sql
    frames = variants[variants.index("variants as"):variants.index("altk as")].rstrip().rstrip(",")
    return f"""{_TAIL.rstrip()},
      g as (select *, cret * tret >= 0 and cdd >= tdd - 0.05e0 as passed from cand),
      sx as (select * from g qualify row_number() over (partition by template_id order by score desc, entity) <= 100),
      tx as (select * from g where passed qualify row_number() over (partition by template_id order by score desc, entity) <= 100),
      {frames},
      {EVENTS_SQL[EVENTS_SQL.index("lim as"):EVENTS_SQL.index("wins as")].rstrip().rstrip(",")},
      allw as (select 'original' as role, a.template_id, a.entity, a.score, a.n, a.pos from nowscores a where a.bar_date = (select d from dayref)
        union all select 'draft', a.template_id, a.entity, a.score, a.len, b.pos from alt a join bars b on b.entity = a.entity and b.bar_date = (select d from dayref) where a.f = {DRAFT}e0),
      topw as (select *, greatest(5, cast(ceil(n * 0.2e0) as integer)) as k from (select *, row_number() over (partition by role, template_id order by score desc, entity) as rank from allw) where rank <= {REVIEW_K}),
      path as (select w.role, w.template_id, w.entity, w.rank, w.score, w.n, w.k, w.pos as last_pos, q.pos, q.close, q.close / max(q.close) over (partition by w.role, w.template_id, w.entity order by q.pos) - 1 as down
        from topw w join qfqnow q on q.entity = w.entity and q.pos between w.pos - w.n + 1 and w.pos),
      shape as (select role, template_id, entity, any_value(rank) as rank, any_value(score) as score, arg_max(close, pos) / arg_min(close, pos) - 1 as ret, min(down) as drawdown,
          arg_max(close, pos) / max(case when pos = last_pos - k + 1 then close end) - 1 as tail, arg_max(close, pos) / max(case when pos > last_pos - k then close end) - 1 as deep from path group by 1, 2, 3),
      hits as (select w.role, w.template_id, w.entity, count(case when e.up then 1 end) as up, count(case when e.down then 1 end) as down, max(ce.ord) - max(cs.ord) + 1 - count(*) as susp,
          max(abs(e.close / e.prev - 1) * 100) as most from topw w join bars bs on bs.entity = w.entity and bs.pos = w.pos - w.n + 1 join bars be on be.entity = w.entity and be.pos = w.pos
          join ev e on e.entity = w.entity and e.bar_date between bs.bar_date and be.bar_date join cal cs on cs.bar_date = bs.bar_date join cal ce on ce.bar_date = be.bar_date group by 1, 2, 3)
      select template_id, 'item' as kind, role, rank, entity, score, ret * 100 as return_pct, drawdown * 100 as drawdown_pct, most as max_day_pct, up, down, susp as suspensions,
        concat_ws(',', case when up > 0 then 'limit up x' || up end, case when down > 0 then 'limit down x' || down end, case when susp > 0 then 'suspended x' || susp end,
          case when most >= 9.5 and up = 0 and down = 0 then 'large day' end) as flags, null as n, null as more from shape join hits using (role, template_id, entity)
      union all select template_id, 'role', role, null, null, null, null, null, null, null, null, (select count(*) from allw w where w.role = shape.role and w.template_id = shape.template_id), null,
        count(case when rank <= 10 and tail < 0 then 1 end), count(case when rank <= 10 and deep < -0.1e0 then 1 end) from shape group by template_id, role
      union all select a.template_id, 'overlap', null, null, null, null, null, null, null, null, null, null, null, count(b.entity), count(*) from topw a
        left join topw b on b.template_id = a.template_id and b.entity = a.entity and b.role = 'draft' and b.rank <= 10 where a.role = 'original' and a.rank <= 10 group by 1
      union all select a.template_id, 'gate', null, null, null, b.ret, null, null, null, a.standard, coalesce(b.gated, 0), null, null, coalesce(c.n, 0), null from (select template_id, count(*) as standard from sx group by 1) a
        left join (select template_id, count(*) as gated, avg(cret) as ret from tx group by 1) b using (template_id)
        left join (select sx.template_id, count(*) as n from sx join tx on sx.template_id = tx.template_id and sx.entity = tx.entity group by 1) c using (template_id)"""


@query("rev_top_review", _REVIEW, _review_sql())
def _(m: Market) -> DataFrame:
    """Best windows of the registered templates beside those of a draft with longer windows, and of the tail rule."""
    from tapeloom.operators import similarity as S

    book = sim.book(m)
    draft = book.resized(DRAFT)
    windows = S.latest_scores(m.qfq_now, book, m.as_of).withColumn("role", F.lit("original")).unionByName(
        S.latest_scores(m.qfq_now, draft, m.as_of).withColumn("role", F.lit("draft"))
    )
    windows = stage(windows)
    keys = ["role", "template_id"]
    top = stage(top_k(windows, keys, best_first(), REVIEW_K).drop("max_abs_pct"))
    hits = events_in(m, top)
    inside = top.join(m.qfq_now.select(F.col("entity").alias("_e"), "bar_date", "close"), (F.col("entity") == F.col("_e")) & F.col("bar_date").between(F.col("start_date"), F.col("end_date")))
    order = Window.partitionBy(*keys, "entity").orderBy("bar_date")
    back = F.row_number().over(Window.partitionBy(*keys, "entity").orderBy(F.col("bar_date").desc()))
    path = inside.withColumns({"_back": back, "_down": F.col("close") / F.max("close").over(order.rowsBetween(Window.unboundedPreceding, 0)) - 1})
    k = F.greatest(F.lit(5), F.ceil(F.col("window_bars") * 0.2))
    shape_ = path.groupBy(*keys, "entity").agg(
        F.max_by("close", "bar_date").alias("_last"), F.min_by("close", "bar_date").alias("_first"), F.min("_down").alias("_down"),
        F.max(F.when(F.col("_back") == k, F.col("close"))).alias("_tail"), F.max(F.when(F.col("_back") <= k, F.col("close"))).alias("_peak"),
    )
    items = stage(hits.join(shape_, [*keys, "entity"]).withColumns({
        "return_pct": (F.col("_last") / F.col("_first") - 1) * 100, "drawdown_pct": F.col("_down") * 100, "max_day_pct": F.col("max_abs_pct"),
        "_falling": (F.col("rank") <= 10) & (F.col("_last") / F.col("_tail") - 1 < 0), "_deep": (F.col("rank") <= 10) & (F.col("_last") / F.col("_peak") - 1 < -0.1),
    }))
    up, down, gone = F.col("up_count"), F.col("down_count"), F.col("suspension_count")
    flags = F.concat_ws(
        ",", F.when(up > 0, F.concat(F.lit("limit up x"), up)), F.when(down > 0, F.concat(F.lit("limit down x"), down)),
        F.when(gone > 0, F.concat(F.lit("suspended x"), gone)), F.when((F.col("max_day_pct") >= 9.5) & (up == 0) & (down == 0), F.lit("large day")),
    )
    eligible = windows.groupBy(*keys).agg(F.count(F.lit(1)).alias("suspensions"))
    roles = items.groupBy(*keys).agg(F.count_if("_falling").alias("n"), F.count_if("_deep").alias("more")).join(eligible, keys)
    ten = top.where(F.col("rank") <= 10)
    first, second = (ten.where(F.col("role") == r).select("template_id", "entity") for r in ("original", "draft"))
    overlap = first.join(second.withColumn("hit", F.lit(1)), ["template_id", "entity"], "left").groupBy("template_id").agg(
        F.count("hit").alias("n"), F.count(F.lit(1)).alias("more")
    )
    rows = stage(tail_gated(m))
    standard = top_k(rows, ["template_id"], best_first(), K).select("template_id", "entity", F.lit(1).alias("s"))
    gated = top_k(rows.where("passed"), ["template_id"], best_first(), K).select("template_id", "entity", "tail_return", F.lit(1).alias("g"))
    gate = standard.join(gated, ["template_id", "entity"], "full_outer").groupBy("template_id").agg(
        F.count("s").alias("up"), F.count("g").alias("down"), F.count_if(F.col("s").isNotNull() & F.col("g").isNotNull()).alias("n"), F.avg("tail_return").alias("score"),
    )
    listed = items.select("template_id", "role", "rank", "entity", "score", "return_pct", "drawdown_pct", "max_day_pct", up.alias("up"), down.alias("down"), gone.alias("suspensions"), flags.alias("flags"))
    parts = [df.withColumn("kind", F.lit(kind)) for kind, df in (("item", listed), ("role", roles), ("overlap", overlap), ("gate", gate))]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
