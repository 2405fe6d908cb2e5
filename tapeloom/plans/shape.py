"""Shape facts, profile and category scores, window mining."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.functions.ranking import exact_quantiles, top_k
from tapeloom.functions.scalars import round_even
from tapeloom.operators import facts as X
from tapeloom.operators import sampling as Z
from tapeloom.operators import shape as S
from tapeloom.operators.bars import by_entity
from tapeloom.plans import similarity as sim
from tapeloom.plans.registry import query
from tapeloom.plans.sql_frames import FRAMES
from tapeloom.plans.sql_terms import any_sql, finding_sql, profile_sql, term_sql
from tapeloom.sources.staging import stage
from tapeloom.sources.tables import Market


def windows(m: Market) -> DataFrame:
    return X.latest_windows(m.qfq_now, m.as_of)


def facts(m: Market) -> DataFrame:
    return X.shared_facts(windows(m))


def _fact(name: str, columns: list[str]) -> None:
    spec = "entity:i bar_date:d " + " ".join(f"{c}:f" for c in columns)

    @query(name, spec, f"select entity, bar_date, {', '.join(columns)} from facts")
    def _(m: Market) -> DataFrame:
        return facts(m)


for _name, _columns in X.FACT_GROUPS.items():
    _fact(_name, _columns)


@query("fact_path", "entity:i " + " ".join(f"{c}:f" for c in X.PATH_FACTS), "select * from paths")
def _(m: Market) -> DataFrame:
    return X.path_facts(windows(m))


@query("v2_ramp_band", "entity:i ramp:f band:f",
       f"select entity, {term_sql(('ramp', 'return_20', -0.1, 0.2))} as ramp, {term_sql(('band', 'return_20', -0.05, 0.05, 0.1))} as band from facts")
def _(m: Market) -> DataFrame:
    return facts(m).select(
        "entity", S.term(("ramp", "return_20", -0.1, 0.2)).alias("ramp"), S.term(("band", "return_20", -0.05, 0.05, 0.1)).alias("band")
    )


@query("v2_profile_score", "entity:i profile:s profile_score:f",
       " union all ".join(f"select entity, '{n}' as profile, {profile_sql(t)} as profile_score from facts" for n, t in S.PROFILES.items()))
def _(m: Market) -> DataFrame:
    return S.profile_scores(facts(m), ["entity"])


def _context_sql() -> str:
    frames, source = ["cx0 as (select f.*, p.* exclude (entity) from facts f join paths p on f.entity = p.entity)"], "cx0"
    for i, layer in enumerate(S.CONTEXT, 1):
        name = "cx" if i == len(S.CONTEXT) else f"cx{i}"
        frames.append(f"{name} as (select *, {', '.join(f'{term_sql(t)} as {c}' for c, t in layer.items())} from {source})")
        source = name
    return ",\n".join(frames)


CONTEXT_SQL = _context_sql()


def _prior_sql(name: str) -> str:
    spec = S.PRIORS[name]
    total = sum(w for w, _ in spec["terms"])
    raw = "(" + " + ".join(f"{w}e0 * {term_sql(t)}" for w, t in spec["terms"]) + f") / {total}e0"
    bad = " or ".join(finding_sql(f) for f in spec["findings"])
    return f"with {CONTEXT_SQL} select entity, {raw} * case when {bad} then {spec['penalty']}e0 else 1 end as prior, not ({bad}) as clean from cx"


def scored_windows(m: Market, windows_: DataFrame, priors: tuple[str, ...]) -> DataFrame:
    return S.prior_scores(X.path_facts(X.shared_facts(windows_)), priors)


def _prior(query_name: str, name: str) -> None:
    @query(query_name, "entity:i prior:f clean:b", _prior_sql(name))
    def _(m: Market) -> DataFrame:
        df = scored_windows(m, windows(m), (name,))
        return df.select("entity", F.col(f"prior_{name}").alias("prior"), F.col(f"clean_{name}").alias("clean"))


for _q, _n in (("v2_prefilter_visual", "visual"), ("v2_prefilter_healthy", "healthy"), ("v2_prefilter_breakout", "breakout"), ("v2_prefilter_pullback", "pullback")):
    _prior(_q, _n)


MINED = ("healthy", "breakout", "pullback")
MINED_K = 60
MINED_STRIDE = 15


def _mining_sql() -> str:
    """The facts of every sliding window: the frames of the newest windows, over windows keyed by security and stop."""
    renamed = {"w120": "m120", "w120e": "m120e", "wl120": "ml120", "wfit": "mfit", "facts": "mfacts", "paths": "mpaths"}
    pattern = re.compile(rf"\b({'|'.join(renamed)})\b")
    own = lambda text: pattern.sub(lambda m: renamed[m[1]], text)
    frames = ", ".join(f"{renamed[n]} as ({own(FRAMES[n])})" for n in ("w120e", "wl120", "wfit", "facts", "paths"))
    rows = []
    for name in MINED:
        spec = S.PRIORS[name]
        raw = "(" + " + ".join(f"{w}e0 * {term_sql(t)}" for w, t in spec["terms"]) + f") / {sum(w for w, _ in spec['terms'])}e0"
        bad = " or ".join(finding_sql(f) for f in spec["findings"])
        rows.append(f"select '{name}' as profile, entity // 100000 as entity, bar_date, {raw} * case when {bad} then {spec['penalty']}e0 else 1 end as prior, not ({bad}) as clean from cx")
    return f"""with m120 as (select s.entity * 100000 + s.pos as entity, any_value(s.bar_date) as bar_date, list(q.close order by q.pos) as c, list(q.high order by q.pos) as h,
        list(q.low order by q.pos) as l, list(q.volume order by q.pos) as v from qfq s join qfq q on q.entity = s.entity and q.pos between s.pos - 119 and s.pos
        where s.pos >= 120 and ((s.pos - 120) % {MINED_STRIDE} = 0 or s.pos = s.n_bars) group by 1 having count(*) = 120),
      {frames}, {own(CONTEXT_SQL)}, every as ({" union all ".join(rows)}),
      best as (select profile, entity, count(*) as windows, count(case when clean then 1 end) as clean_windows, arg_max(bar_date, struct_pack(a := prior, b := bar_date)) filter (where clean) as bar_date,
        max(prior) filter (where clean) as prior from every group by 1, 2),
      mined as (select profile, entity, row_number() over (partition by profile order by prior desc, entity) as place from best where clean_windows > 0)
      select best.*, case when place <= {MINED_K} then place end as place from best left join mined using (profile, entity)"""


@query("v2_mine_segments", "profile:s entity:i windows:i clean_windows:i bar_date:d prior:f place:i", _mining_sql())
def _(m: Market) -> DataFrame:
    """Windows and clean windows of every security by profile, its best clean one, and the place among the Top-60.

    Unclean windows are counted but never mined: without a clean one, date, prior and place are null.
    """
    df = stage(scored_windows(m, X.sliding_windows(m.qfq, MINED_STRIDE), MINED).select(
        "entity", "bar_date", *[f"{k}_{n}" for n in MINED for k in ("prior", "clean")]
    ))
    options = F.array(*[F.struct(F.lit(n).alias("profile"), F.col(f"prior_{n}").alias("prior"), F.col(f"clean_{n}").alias("clean")) for n in MINED])
    best = df.select("entity", "bar_date", F.inline(options)).groupBy("profile", "entity").agg(
        F.count(F.lit(1)).alias("windows"), F.count_if("clean").alias("clean_windows"),
        F.max(F.when(F.col("clean"), F.struct("prior", "bar_date"))).alias("b"),
    ).select("profile", "entity", "windows", "clean_windows", "b.bar_date", "b.prior")
    mined = top_k(best.where("clean_windows > 0"), ["profile"], [F.col("prior").desc(), F.col("entity")], MINED_K, "place")
    return best.join(mined.select("profile", "entity", "place"), ["profile", "entity"], "left")


# Ratings for the calibration queries: a fixed 0..3 label per security and category.
RATING = {c: i for i, c in enumerate(S.CATEGORY_KEYS)}


def rating_of() -> Column:
    shift = F.create_map(*[F.lit(x) for kv in RATING.items() for x in kv])
    return F.pmod(F.col("entity") * 7 + F.element_at(shift, F.col("category")) * 3, F.lit(4))


def records(m: Market, known: DataFrame | None = None) -> DataFrame:
    """Long labelled facts: entity, category, feature, weight, value, rating."""
    return S.long_facts(facts(m) if known is None else known, ["entity"]).withColumn("rating", rating_of())


_LONG = "lf as (" + " union all ".join(
    f"select entity, '{c}' as category, '{f}' as feature, {w}e0 as weight, cast({f} as double) as value, (entity * 7 + {RATING[c] * 3}) % 4 as rating from facts"
    for c, fs in S.WEIGHTS.items() for f, w in fs.items()) + ")"
MODEL_SQL = f"""{_LONG},
pos as (select category, feature, quantile_cont(value, 0.25) as q25, median(value) as median, quantile_cont(value, 0.75) as q75 from lf where rating >= 2 group by 1, 2),
al as (select category, feature, quantile_cont(value, 0.25) as a25, median(value) as amed, quantile_cont(value, 0.75) as a75, max(value) - min(value) as spread from lf group by 1, 2),
mad as (select lf.category, lf.feature, median(abs(value - amed)) as mad from lf join al using (category, feature) group by 1, 2),
model as (select pos.*, greatest((a75 - a25) / 1.349e0, mad * 1.4826e0, greatest(1e-4, abs(amed) * 0.02e0, spread * 0.02e0)) as robust_scale
  from pos join al using (category, feature) join mad using (category, feature)),
dist as (select entity, category, max(rating) as rating, sqrt(sum(weight * least(power((value - median) / robust_scale, 2), 64)) / sum(weight)) as distance
  from lf join model using (category, feature) group by 1, 2),
scales as (select category, greatest(0.5e0, median(distance) / 0.6680472308e0) as distance_scale, count(*) as positives from dist where rating >= 2 group by 1)"""


def model(m: Market, known: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(feature statistics, distance scale) per category from the labelled windows."""
    keys = ["category", "feature"]
    base = stage(records(m, known))
    quartiles = {"q25": 0.25, "median": 0.5, "q75": 0.75}
    positive = exact_quantiles(base.where(F.col("rating") >= 2), keys, "value", quartiles)
    every = exact_quantiles(base, keys, "value", {"a25": 0.25, "amed": 0.5, "a75": 0.75})
    spread = base.groupBy(*keys).agg((F.max("value") - F.min("value")).alias("spread"))
    apart = base.join(every.select(*keys, "amed"), keys).withColumn("gap", F.abs(F.col("value") - F.col("amed")))
    mad = exact_quantiles(apart, keys, "gap", {"mad": 0.5})
    floor = F.greatest(F.lit(1e-4), F.abs("amed") * 0.02, F.col("spread") * 0.02)
    scale = F.greatest((F.col("a75") - F.col("a25")) / 1.349, F.col("mad") * 1.4826, floor)
    stats = stage(positive.join(every, keys).join(spread, keys).join(mad, keys).withColumn("robust_scale", scale))
    part = F.col("weight") * S.squared(F.col("value"), F.col("median"), F.col("robust_scale"))
    distances = base.where(F.col("rating") >= 2).join(stats.select(*keys, "median", "robust_scale"), keys).groupBy("entity", "category").agg(
        F.sqrt(F.sum(part) / F.sum("weight")).alias("distance")
    )
    mid = exact_quantiles(distances, ["category"], "distance", {"mid": 0.5})
    return stats, mid.select("category", F.greatest(F.lit(0.5), F.col("mid") / 0.6680472308).alias("distance_scale"))


@query("cal_robust_stats", "category:s feature:s q25:f median:f q75:f robust_scale:f", f"with {MODEL_SQL} select * from model")
def _(m: Market) -> DataFrame:
    return model(m)[0]


@query("cal_distance_scale", "category:s distance_scale:f", f"with {MODEL_SQL} select category, distance_scale from scales")
def _(m: Market) -> DataFrame:
    return model(m)[1]


@query("cal_rating_hist", "category:s r0:i r1:i r2:i r3:i",
       f"with {_LONG}, r as (select distinct entity, category, rating from lf) select category, " + ", ".join(f"count(case when rating = {i} then 1 end) as r{i}" for i in range(4)) + " from r group by 1")
def _(m: Market) -> DataFrame:
    once = windows(m).select("entity", F.explode(F.array(*[F.lit(c) for c in S.CATEGORY_KEYS])).alias("category"))
    wide = once.withColumn("rating", rating_of()).groupBy("category").pivot("rating", [0, 1, 2, 3]).count().fillna(0)
    return wide.select("category", *[F.col(str(i)).alias(f"r{i}") for i in range(4)])


def _caps_sql(category: str, rules: list) -> str:
    def hit(then: list[str]) -> list[str]:
        return [f"case when {any_sql(groups)} then {value} end" for (_, _, _, groups), value in zip(rules, then, strict=True)]

    limits = hit([f"{float(limit)!r}e0" for limit, *_ in rules])
    codes, messages = hit([f"'{code}'" for _, code, *_ in rules]), hit([f"'{message}'" for _, _, message, _ in rules])
    return f"""select entity, '{category}' as category, coalesce(least({', '.join(limits)}), 3) as ceiling,
      {' + '.join(f"case when {any_sql(groups)} then 1 else 0 end" for *_, groups in rules)} as hits,
      concat_ws(',', {', '.join(codes)}) as codes, concat_ws('; ', {', '.join(messages)}) as messages from facts"""


_CAPS = " union all ".join(_caps_sql(c, rules) for c, rules in S.CAPS.items())


@query("v2_caps", "entity:i category:s ceiling:f hits:i codes:s messages:s", _CAPS)
def _(m: Market) -> DataFrame:
    rows = S.ceilings(facts(m), ["entity"])
    return rows.withColumn("codes", F.array_join("codes", ",")).withColumn("messages", F.array_join("messages", "; "))


_CAP_SQL = f"capx as ({_CAPS})"
SCORE_SQL = f"""{MODEL_SQL}, {_CAP_SQL},
v2 as (select d.entity, d.category, d.rating, d.distance, 3 * exp(-0.5e0 * power(d.distance / s.distance_scale, 2)) as raw_score, least(c.ceiling, 3 * exp(-0.5e0 * power(d.distance / s.distance_scale, 2))) as score
  from dist d join scales s using (category) join capx c using (entity, category))"""


def v2_scores(m: Market) -> DataFrame:
    known = stage(facts(m).drop("c", "h", "l", "v"))
    stats, scales = model(m, known)
    return S.category_scores(known, stats.select("category", "feature", "median", "robust_scale"), scales, ["entity"])


@query("v2_score_category", "entity:i category:s distance:f raw_score:f score:f first_contributor:s",
       f"""with {SCORE_SQL}, k as (select entity, category, arg_max(feature, struct_pack(a := weight * least(power((value - median) / robust_scale, 2), 64), b := feature)) as first_contributor
            from lf join model using (category, feature) group by 1, 2)
          select v2.*, k.first_contributor from v2 join k using (entity, category)""")
def _(m: Market) -> DataFrame:
    return v2_scores(m).withColumn("first_contributor", F.col("contributors")[0]["feature"])


@query("v2_score_all", "entity:i category:s distance:f raw_score:f score:f", f"with {SCORE_SQL} select * from v2")
def _(m: Market) -> DataFrame:
    return v2_scores(m)


@query("v2_rank_universe", "category:s rank:i entity:i score:f",
       f"""with {SCORE_SQL}, t as (select * from v2 where cast('0x' || substr(sha256(cast(entity as varchar)), 1, 13) as bigint) / 4503599627370496.0e0 >= 0.5 and
            cast('0x' || substr(sha256(cast(entity as varchar)), 1, 13) as bigint) / 4503599627370496.0e0 < 0.75)
          select * from (select category, row_number() over (partition by category order by round_even(score * 1e6, 0) desc, entity) as rank, entity, score from t) where rank <= 50""")
def _(m: Market) -> DataFrame:
    tuning = v2_scores(m).withColumn("split", Z.hash_split(F.col("entity").cast("string"))).where(F.col("split") == "tuning")
    return top_k(tuning, ["category"], [F.rint(F.col("score") * 1e6).desc(), F.col("entity")], 50)


_SHAPE = """
select a.template_id, a.entity, (arg_max(q.close, q.pos) / arg_min(q.close, q.pos) - 1) * 100 as return_pct,
  regr_slope(ln(q.close), power((q.pos - (a.pos - a.n + 1)) * 2.0e0 / (a.n - 1) - 1, 2)) as quadratic,
  regr_r2(ln(q.close), (q.pos - (a.pos - a.n + 1)) * 2.0e0 / (a.n - 1) - 1) + regr_r2(ln(q.close), power((q.pos - (a.pos - a.n + 1)) * 2.0e0 / (a.n - 1) - 1, 2)) as quadratic_r2,
  (regr_slope(ln(q.close), q.pos) filter (where q.pos - (a.pos - a.n + 1) < a.n // 2)) * 10000 as first_slope, (regr_slope(ln(q.close), q.pos) filter (where q.pos - (a.pos - a.n + 1) >= a.n // 2)) * 10000 as second_slope,
  min(q.close / q.peak - 1) * 100 as max_drawdown_pct, avg(case when q.prev is null then null when q.close > q.prev then 1.0e0 else 0 end) as positive_share
from top a join (select t.template_id, t.entity, q.pos, q.close, max(q.close) over (partition by t.template_id, t.entity order by q.pos) as peak, lag(q.close) over (partition by t.template_id, t.entity order by q.pos) as prev
    from top t join qfqnow q on q.entity = t.entity and q.pos between t.pos - t.n + 1 and t.pos) q on q.template_id = a.template_id and q.entity = a.entity
group by a.template_id, a.entity, a.n, a.pos"""
_TOPX = "top as (select * from (select *, row_number() over (partition by template_id order by score desc, entity) as rank from nowscores) where rank <= 20)"


def shape_metrics(windows_: DataFrame, keys: list[str]) -> DataFrame:
    """Return, quadratic term and fit, half slopes, drawdown and up share of each window.

    Input rows (keys, i, n, close).  On the symmetric grid x in [-1, 1] the linear
    and quadratic terms are orthogonal, so both come from one-variable regressions.
    """
    w = Window.partitionBy(*keys).orderBy("i")
    x = F.col("i") * 2.0 / (F.col("n") - 1) - 1
    df = windows_.withColumns({
        "x": x, "xx": x * x, "y": F.ln("close"), "_prev": F.lag("close").over(w),
        "_peak": F.max("close").over(w.rowsBetween(Window.unboundedPreceding, 0)),
    })
    half = F.floor(F.col("n") / 2)
    first, second = F.col("i") < half, F.col("i") >= half

    def slope(cond):
        return F.regr_slope(F.when(cond, F.col("y")), F.when(cond, F.col("i").cast("double"))) * 10000

    return df.groupBy(*keys).agg(
        ((F.max_by("close", "i") / F.min_by("close", "i") - 1) * 100).alias("return_pct"),
        F.regr_slope("y", "xx").alias("quadratic"), (F.regr_r2("y", "x") + F.regr_r2("y", "xx")).alias("quadratic_r2"),
        slope(first).alias("first_slope"), slope(second).alias("second_slope"),
        (F.min(F.col("close") / F.col("_peak") - 1) * 100).alias("max_drawdown_pct"),
        F.avg(F.when(F.col("_prev").isNotNull(), (F.col("close") > F.col("_prev")).cast("double"))).alias("positive_share"),
    ).withColumn("slope_delta", F.col("second_slope") - F.col("first_slope"))


def top_window_bars(m: Market) -> DataFrame:
    best = top_k(sim.latest(m), ["template_id"], [F.col("score").desc(), F.col("entity")], 20)
    bars = m.qfq_now.select("entity", "bar_date", "close")
    inside = best.join(bars, "entity").where(F.col("bar_date").between(F.col("start_date"), F.col("end_date")))
    w = Window.partitionBy("template_id", "entity").orderBy("bar_date")
    return inside.withColumn("i", F.row_number().over(w) - 1).withColumnRenamed("window_bars", "n")


@query("v2_shape_metrics", "template_id:i entity:i return_pct:f quadratic:f quadratic_r2:f first_slope:f second_slope:f max_drawdown_pct:f positive_share:f", f"with {_TOPX} {_SHAPE}")
def _(m: Market) -> DataFrame:
    return shape_metrics(top_window_bars(m), ["template_id", "entity"])


@query("aud_latest_shapes", "template_id:i n:i accelerating:i median_return:f median_quadratic:f",
       f"with {_TOPX}, s as ({_SHAPE}) select template_id, count(*) as n, count(case when quadratic > 0 and first_slope > 0 and second_slope > first_slope then 1 end) as accelerating, median(return_pct) as median_return, median(quadratic) as median_quadratic from s group by 1")
def _(m: Market) -> DataFrame:
    rows = shape_metrics(top_window_bars(m), ["template_id", "entity"])
    fast = (F.col("quadratic") > 0) & (F.col("first_slope") > 0) & (F.col("slope_delta") > 0)
    # At most k rows per template reach this aggregate.
    return rows.groupBy("template_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(fast).alias("accelerating"),
        F.expr("percentile(return_pct, 0.5)").alias("median_return"), F.expr("percentile(quadratic, 0.5)").alias("median_quadratic"),
    )


@query("v2_scan_source_window", "entity:i start:i quadratic:f quadratic_r2:f accelerating:b chosen:b",
       """with src as (select entity, pos - 20 as k, close from qfq where entity between 1 and 4 and pos between 21 and 180),
          w as (select s.entity, s.k as start, b.k - s.k as i, b.close from src s join src b on b.entity = s.entity and b.k between s.k and s.k + 79 where s.k <= 81),
          g as (select entity, start, regr_slope(ln(close), power(i * 2.0e0 / 79 - 1, 2)) as quadratic, regr_r2(ln(close), i * 2.0e0 / 79 - 1) + regr_r2(ln(close), power(i * 2.0e0 / 79 - 1, 2)) as quadratic_r2,
            regr_slope(ln(close), i) filter (where i < 40) as s1, regr_slope(ln(close), i) filter (where i >= 40) as s2 from w group by 1, 2),
          a as (select *, quadratic > 0 and s1 > 0 and s2 > s1 as accelerating from g)
          select *, accelerating and row_number() over (partition by entity order by case when accelerating then 0 else 1 end, floor(quadratic_r2 * 1e9) desc, quadratic desc, start) = 1 as chosen from a""")
def _(m: Market) -> DataFrame:
    src = m.qfq.where(F.col("entity").isin(list(range(1, 5))) & F.col("pos").between(21, 180)).select(
        "entity", (F.col("pos") - 20).alias("k"), "close"
    )
    # Each bar names the windows that contain it; at most 80 starts per bar.
    starts = F.sequence(F.greatest(F.col("k") - 79, F.lit(1)), F.least(F.col("k"), F.lit(81)))
    rows = src.withColumn("start", F.explode(starts)).withColumns({"i": F.col("k") - F.col("start"), "n": F.lit(80)})
    g = shape_metrics(rows, ["entity", "start"])
    g = g.withColumn("accelerating", (F.col("quadratic") > 0) & (F.col("first_slope") > 0) & (F.col("slope_delta") > 0))
    order = Window.partitionBy("entity").orderBy(
        F.when(F.col("accelerating"), 0).otherwise(1), F.floor(F.col("quadratic_r2") * 1e9).desc(), F.col("quadratic").desc(), "start"
    )
    return g.withColumn("chosen", F.col("accelerating") & (F.row_number().over(order) == 1))


@query("v2_segment_review", "template_id:i bars:i return_pct:f first_half_pct:f second_half_pct:f last20_share:f advance_pct:f",
       """select template_id, count(*) as bars, (arg_max(close, t) / arg_min(close, t) - 1) * 100 as return_pct, (max(case when t = n // 2 + 1 then close end) / arg_min(close, t) - 1) * 100 as first_half_pct,
            (arg_max(close, t) / max(case when t = n // 2 + 1 then close end) - 1) * 100 as second_half_pct,
            case when arg_max(close, t) > arg_min(close, t) then (arg_max(close, t) - max(case when t = n - 20 then close end)) / (arg_max(close, t) - arg_min(close, t)) * 100 end as last20_share,
            (max(close) / arg_min(close, t) - 1) * 100 as advance_pct
          from templates group by template_id, n""")
def _(m: Market) -> DataFrame:
    t, n = F.col("t"), F.col("n")
    per = sim.points(m).groupBy("template_id", "n").agg(
        F.count(F.lit(1)).alias("bars"), F.min_by("close", "t").alias("a"), F.max_by("close", "t").alias("z"), F.max("close").alias("top"),
        F.max(F.when(t == F.floor(n / 2) + 1, F.col("close"))).alias("mid"), F.max(F.when(t == n - 20, F.col("close"))).alias("b20"),
    )
    a, z, mid = F.col("a"), F.col("z"), F.col("mid")
    return per.withColumns({
        "return_pct": (z / a - 1) * 100, "first_half_pct": (mid / a - 1) * 100, "second_half_pct": (z / mid - 1) * 100,
        "last20_share": F.when(z > a, (z - F.col("b20")) / (z - a) * 100), "advance_pct": (F.col("top") / a - 1) * 100,
    })
