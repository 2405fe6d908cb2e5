"""Data-quality and leakage checks as (check_name, passed, n_bad) tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.functions.ranking import top_k
from tapeloom.operators import dynamics as D
from tapeloom.operators import sampling as Z
from tapeloom.operators import similarity as SIM
from tapeloom.operators.bars import PRICES, adjust_as_of
from tapeloom.plans import similarity as sim
from tapeloom.plans.breadth import IND_SQL, THR_SQL, _FLOW_SQL, industry_daily, industry_threshold_daily, market_daily, with_position
from tapeloom.plans.common import K, best_first, scored
from tapeloom.plans.dynamics import _IND, _TRANS, snapped, state_names, states
from tapeloom.plans.registry import query
from tapeloom.sources.staging import stage
from tapeloom.sources.store import unpivot_checks
from tapeloom.sources.tables import Market

_SPEC = "check_name:s passed:b n_bad:i"


@query("dq_unique_key", _SPEC,
       """with a as (select count(*) as n from (select 1 from bars0 group by entity, bar_date having count(*) > 1)),
          b as (select count(*) as n from (select 1 from lineitem group by l_orderkey, l_linenumber having count(*) > 1)),
          c as (select count(*) as n from (select 1 from factors group by entity, bar_date having count(*) > 1))
          select 'bars' as check_name, n = 0 as passed, n as n_bad from a union all select 'lines', n = 0, n from b union all select 'factors', n = 0, n from c""")
def _(m: Market) -> DataFrame:
    def repeated(df: DataFrame, keys: list[str]) -> "Column":
        return df.groupBy(*keys).count().where(F.col("count") > 1).agg(F.count(F.lit(1))).scalar()

    one = m.spark.range(1).select(
        repeated(m.bars0, ["entity", "bar_date"]).alias("bars"), repeated(m.table("lineitem"), ["l_orderkey", "l_linenumber"]).alias("lines"),
        repeated(m.factors, ["entity", "bar_date"]).alias("factors"),
    )
    return unpivot_checks(one)


@query("dq_factor", _SPEC,
       """with x as (select count(case when adj_factor is null then 1 end) as m, count(case when adj_factor <= 0 then 1 end) as p from barsf)
          select 'missing' as check_name, m = 0 as passed, m as n_bad from x union all select 'non_positive', p = 0, p from x""")
def _(m: Market) -> DataFrame:
    return unpivot_checks(m.bars_with_factor.agg(
        F.count_if(F.col("adj_factor").isNull()).alias("missing"), F.count_if(F.col("adj_factor") <= 0).alias("non_positive")
    ))


@query("dq_score_range", _SPEC,
       "with x as (select count(case when abs(score) > 1 + 1e-8 then 1 end) as n from scores) select 'range' as check_name, n = 0 as passed, n as n_bad from x")
def _(m: Market) -> DataFrame:
    return unpivot_checks(sim.scores(m).agg(F.count_if(F.abs("score") > 1 + 1e-8).alias("range")))


# Every check below runs twice: on the table as it is, and on a copy in which a rule has planted faults.

_TABLES = ("sound", "planted")


def _both(sound: DataFrame, planted: DataFrame) -> DataFrame:
    return sound.withColumn("copy", F.lit("sound")).unionByName(planted.withColumn("copy", F.lit("planted")))


def _findings(counts: DataFrame) -> DataFrame:
    """Counts of bad rows by copy as (check_name, passed, n_bad); a copy without a row has none."""
    names = [c for c in counts.columns if c != "copy"]
    one = counts.agg(*[
        F.coalesce(F.sum(F.when(F.col("copy") == t, F.col(n))), F.lit(0)).alias(n if t == "sound" else f"planted {n}") for t in _TABLES for n in names
    ])
    return unpivot_checks(one)


def _findings_sql(source: str, *names: str) -> str:
    return " union all ".join(
        f"""select '{n if t == "sound" else f"planted {n}"}' as check_name, n = 0 as passed, n as n_bad from (select coalesce(sum({n}), 0) as n from {source} where copy = '{t}')"""
        for t in _TABLES for n in names
    )


def _at(ordinal: str, code: str, step: int, place: int, which: int) -> str:
    """Where a fault is planted: one industry in seven on one date in ``step``."""
    return f"{ordinal} % {step} = {place} and {code} % 7 = {which}"


_TOP_FAULTS = {
    "top_count": (_at("ord", "industry_code", 50, 0, 3), "top_count + 1"), "retained_count": (_at("ord", "industry_code", 50, 10, 4), "retained_count + 1"),
    "exit_count": (_at("ord", "industry_code", 50, 20, 5), "exit_count + 2"), "selection_rate": (_at("ord", "industry_code", 50, 30, 6), "selection_rate + 0.5e0"),
    "eligible": (_at("ord", "industry_code", 50, 40, 2) + " and top_count > 0", "top_count - 1"),
}


def _planted(df: DataFrame, faults: dict[str, tuple[str, str]]) -> DataFrame:
    return df.withColumns({c: F.expr(f"case when {where} then {value} else {c} end").cast(df.schema[c].dataType) for c, (where, value) in faults.items()})


def _planted_sql(source: str, faults: dict[str, tuple[str, str]], columns: tuple[str, ...]) -> str:
    cells = [f"case when {faults[c][0]} then {faults[c][1]} else {c} end as {c}" if c in faults else c for c in columns]
    return f"select 'sound' as copy, {', '.join(columns)} from {source} union all select 'planted', {', '.join(cells)} from {source}"


_TOP_COLUMNS = ("template_id", "lag", "ord", "industry_code", "eligible", "top_count", "new_count", "retained_count", "exit_count", "selection_rate")


@query("dq_top100_identities", _SPEC,
       f"""with src as (select *, case when eligible > 0 then top_count * 1.0e0 / eligible else 0 end as selection_rate from brdind),
          both_t as ({_planted_sql("src", _TOP_FAULTS, _TOP_COLUMNS)}),
          per as (select copy, template_id, lag, ord, sum(eligible) as eligible, sum(top_count) as top, sum(new_count) as new, sum(retained_count) as kept, sum(exit_count) as gone from both_t group by all),
          pr as (select p.*, coalesce(q.top, 0) as prior_top from per p left join per q on q.copy = p.copy and q.template_id = p.template_id and q.lag = p.lag and q.ord + q.lag = p.ord),
          c as (select copy, count(case when top <> least({K}, eligible) then 1 end) as size, count(case when new + kept <> top then 1 end) as current, count(case when gone + kept <> prior_top then 1 end) as prior,
            0 as within_eligible, 0 as rate from pr group by 1
            union all select copy, 0, 0, 0, count(case when top_count > eligible then 1 end), count(case when eligible > 0 and abs(selection_rate - top_count * 1.0e0 / eligible) > 1e-12 then 1 end) from both_t group by 1)
          {_findings_sql("c", "size", "current", "prior", "within_eligible", "rate")}""")
def _(m: Market) -> DataFrame:
    sound = industry_daily(m).select(*_TOP_COLUMNS)
    daily = stage(_both(sound, _planted(sound, _TOP_FAULTS)))
    keys = ["copy", "template_id", "lag", "ord"]
    per = daily.groupBy(*keys).agg(
        F.sum("eligible").alias("eligible"), F.sum("top_count").alias("top"), F.sum("new_count").alias("new"),
        F.sum("retained_count").alias("kept"), F.sum("exit_count").alias("gone"),
    )
    prior = per.select("copy", "template_id", "lag", (F.col("ord") + F.col("lag")).alias("ord"), F.col("top").alias("prior_top"))
    both = per.join(prior, keys, "left")
    wanted = F.least(F.lit(K), F.col("eligible"))
    bad = both.groupBy("copy").agg(
        F.count_if(F.col("top") != wanted).alias("size"), F.count_if(F.col("new") + F.col("kept") != F.col("top")).alias("current"),
        F.count_if(F.col("gone") + F.col("kept") != F.coalesce("prior_top", F.lit(0))).alias("prior"),
    )
    rows = daily.groupBy("copy").agg(
        F.count_if(F.col("top_count") > F.col("eligible")).alias("within_eligible"),
        F.count_if((F.col("eligible") > 0) & (F.abs(F.col("selection_rate") - F.col("top_count") / F.nullif(F.col("eligible"), F.lit(0))) > 1e-12)).alias("rate"),
    )
    return _findings(bad).unionByName(_findings(rows))


_LINE_FAULTS = {
    "above": (_at("ord", "industry_code", 60, 0, 3) + " and threshold > 0.78e0", "above + 9"), "new_count": (_at("ord", "industry_code", 60, 15, 4), "new_count + 1"),
    "exit_count": (_at("ord", "industry_code", 60, 30, 5), "exit_count + 1"), "above_without_top3": (_at("ord", "industry_code", 60, 45, 6), "above_without_top1 + 1"),
}
_LINE_COLUMNS = ("threshold", "template_id", "ord", "industry_code", "above", "new_count", "retained_count", "exit_count", "above_without_top1", "above_without_top3")


@query("dq_threshold_monotone", _SPEC,
       f"""with {IND_SQL}, {_FLOW_SQL}, src as (select t.*, coalesce(new_count, 0) as new_count, coalesce(retained_count, 0) as retained_count, coalesce(exit_count, 0) as exit_count
            from thi t left join fl using (threshold, template_id, industry_code, ord)),
          both_t as ({_planted_sql("src", _LINE_FAULTS, _LINE_COLUMNS)}),
          lw as (select *, lag(above) over (partition by copy, template_id, industry_code, ord order by threshold) as lower_above, lag(above) over (partition by copy, threshold, template_id, industry_code order by ord) as before from both_t),
          tot as (select copy, threshold, template_id, ord, sum(above) as s from both_t group by all),
          mk as (select l.threshold, k.template_id, k.ord, case l.threshold when 0.7e0 then n70 when 0.75e0 then n75 else n80 end as above from mkt k, lines l),
          c as (select copy, count(case when above > lower_above then 1 end) as monotone, count(case when new_count + retained_count <> above or exit_count + retained_count <> coalesce(before, 0) then 1 end) as flows,
              count(case when above_without_top3 > above_without_top1 or above_without_top1 > above then 1 end) as leaders, 0 as market_sum from lw group by 1
            union all select t.copy, 0, 0, 0, count(case when mk.above <> coalesce(tot.s, 0) then 1 end) from (select unnest(['sound', 'planted']) as copy) t cross join mk
              left join tot on tot.copy = t.copy and tot.threshold = mk.threshold and tot.template_id = mk.template_id and tot.ord = mk.ord group by 1)
          {_findings_sql("c", "monotone", "flows", "leaders", "market_sum")}""")
def _(m: Market) -> DataFrame:
    sound = industry_threshold_daily(m).select(*_LINE_COLUMNS)
    ind = stage(_both(sound, _planted(sound, _LINE_FAULTS)))
    w = Window.partitionBy("copy", "template_id", "industry_code", "ord").orderBy("threshold")
    seen = Window.partitionBy("copy", "threshold", "template_id", "industry_code").orderBy("ord")
    checked = ind.withColumns({"_lower": F.lag("above").over(w), "_before": F.lag("above").over(seen)})
    rows = checked.groupBy("copy").agg(
        F.count_if(F.col("above") > F.col("_lower")).alias("monotone"),
        F.count_if(
            (F.col("new_count") + F.col("retained_count") != F.col("above"))
            | (F.col("exit_count") + F.col("retained_count") != F.coalesce("_before", F.lit(0)))
        ).alias("flows"),
        F.count_if((F.col("above_without_top3") > F.col("above_without_top1")) | (F.col("above_without_top1") > F.col("above"))).alias("leaders"),
    )
    total = ind.groupBy("copy", "threshold", "template_id", "ord").agg(F.sum("above").alias("sum_above"))
    each = market_daily(m).withColumn("copy", F.explode(F.array(*[F.lit(t) for t in _TABLES])))
    market = each.join(total, ["copy", "threshold", "template_id", "ord"], "left")
    sums = market.groupBy("copy").agg(F.count_if(F.col("above") != F.coalesce("sum_above", F.lit(0))).alias("market_sum"))
    return _findings(rows).unionByName(_findings(sums))


_MOVE_FAULTS = {"row_rate": ("from_state = 'mixed' and to_state = 'none'", "row_rate + 0.25e0")}
_IND_FAULTS = {
    "wilson_low": ("seq % 10 = 3 and rate < 0.5e0", "0.9e0"), "rate": ("seq % 10 = 7 and eligible > 2", "rate + 2"),
}
_PAIR_GAP = "seq % 9 = 4"  # snapshots whose pairs are missing in the planted copy


@query("dq_dynamics", _SPEC,
       f"""with {_TRANS}, {_IND}, mv_t as ({_planted_sql("(select * from tr where frequency = 'monthly')", _MOVE_FAULTS, ("frequency", "from_state", "to_state", "count", "row_rate"))}),
          in_t as ({_planted_sql("(select * from iy where frequency = 'monthly')", _IND_FAULTS, ("seq", "eligible", "rate", "wilson_low", "wilson_high"))}),
          rs as (select copy, frequency, from_state, sum(row_rate) as r, sum(count) as n from mv_t group by all),
          sz as (select seq, count(distinct template_id) as t from dsc where frequency = 'monthly' group by 1),
          pairs_t as (select t.copy, sz.seq, sz.t, case when t.copy = 'planted' and {_PAIR_GAP} then 0 else sz.t * (sz.t - 1) / 2 end as p from (select unnest(['sound', 'planted']) as copy) t cross join sz),
          c as (select copy, count(case when n > 0 and abs(r - 1) > 1e-9 then 1 end) as row_rates, 0 as wilson, 0 as rates, 0 as pairs from rs group by 1
            union all select copy, 0, count(case when rate < wilson_low - 1e-9 or rate > wilson_high + 1e-9 then 1 end), count(case when not rate between 0 and 1 then 1 end), 0 from in_t group by 1
            union all select copy, 0, 0, 0, count(case when p * 2 <> t * (t - 1) then 1 end) from pairs_t group by 1)
          {_findings_sql("c", "row_rates", "wilson", "rates", "pairs")}""")
def _(m: Market) -> DataFrame:
    rows = snapped(m, "monthly")
    moves = D.transitions(stage(states(m, rows)), state_names(m)).select("frequency", "from_state", "to_state", "count", "row_rate")
    sums = _both(moves, _planted(moves, _MOVE_FAULTS)).groupBy("copy", "frequency", "from_state").agg(F.sum("row_rate").alias("r"), F.sum("count").alias("n"))
    a = sums.groupBy("copy").agg(F.count_if((F.col("n") > 0) & (F.abs(F.col("r") - 1) > 1e-9)).alias("row_rates"))
    ind = D.industries(rows).select("seq", "eligible", "rate", "wilson_low", "wilson_high")
    b = _both(ind, _planted(ind, _IND_FAULTS)).groupBy("copy").agg(
        F.count_if((F.col("rate") < F.col("wilson_low") - 1e-9) | (F.col("rate") > F.col("wilson_high") + 1e-9)).alias("wilson"),
        F.count_if(~F.col("rate").between(0, 1)).alias("rates"),
    )
    sizes = rows.groupBy("seq").agg(F.count_distinct("template_id").alias("t")).withColumn("copy", F.explode(F.array(*[F.lit(t) for t in _TABLES])))
    found = D.pair_overlap(rows, {"q": "q"})
    pairs = _both(found, found.where(f"not ({_PAIR_GAP})")).groupBy("copy", "seq").agg(F.count(F.lit(1)).alias("p"))
    c = sizes.join(pairs, ["copy", "seq"], "left").groupBy("copy").agg(
        F.count_if(F.coalesce("p", F.lit(0)) * 2 != F.col("t") * (F.col("t") - 1)).alias("pairs")
    )
    return _findings(a).unionByName(_findings(b)).unionByName(_findings(c))


_DAY_FAULTS = {
    "change_1d": ("ord % 40 = 0", "change_1d + 1"), "change_5d": ("ord % 40 = 10", "change_5d - 1"), "ma5": ("ord % 40 = 20", "ma5 + 0.5e0"),
    "position": ("ord % 40 = 30", "position / 2"),
}
_DAY_COLUMNS = ("threshold", "template_id", "ord", "above", "change_1d", "change_5d", "ma5", "position")


@query("dq_recompute", _SPEC,
       f"""with {THR_SQL}, src as (select *, (select count(*) from mk0 h where h.threshold = k.threshold and h.template_id = k.template_id and h.ord <= k.ord and h.above <= k.above) * 1.0e0
            / (select count(*) from mk0 h where h.threshold = k.threshold and h.template_id = k.template_id and h.ord <= k.ord) as position from mkd k),
          both_t as ({_planted_sql("src", _DAY_FAULTS, _DAY_COLUMNS)}),
          j as (select b.*, s.change_1d as c1, s.change_5d as c5, s.ma5 as m5, s.position as ps from both_t b join src s using (threshold, template_id, ord)),
          c as (select copy, count(case when change_1d is distinct from c1 then 1 end) as change_1d, count(case when change_5d is distinct from c5 then 1 end) as change_5d,
            count(case when abs(ma5 - m5) > 1e-9 then 1 end) as ma5, count(case when abs(position - ps) > 1e-9 then 1 end) as position from j group by 1)
          {_findings_sql("c", "change_1d", "change_5d", "ma5", "position")}""")
def _(m: Market) -> DataFrame:
    """Recompute by other means: changes by ordinal joins, averages by explicit sums, positions from sorted counts."""
    sound = stage(with_position(stage(market_daily(m))).select(*_DAY_COLUMNS))
    keys = ["threshold", "template_id"]
    w = Window.partitionBy(*keys).orderBy("ord")
    numbered = stage(sound.select(*keys, "ord", "above", F.row_number().over(w).alias("k")))
    again = numbered
    for n in (1, 5):
        prior = numbered.select(*keys, (F.col("k") + n).alias("k"), F.col("above").alias(f"_p{n}"))
        again = again.join(prior, [*keys, "k"], "left").withColumn(f"c{n}", F.col("above") - F.col(f"_p{n}"))
    shifted = numbered.select(*keys, F.explode(F.sequence(F.col("k"), F.col("k") + 4)).alias("k"), "above")
    means = shifted.groupBy(*keys, "k").agg(F.avg("above").alias("m5"))
    # rows up to a place with values up to its own: totals of the distinct values seen by then
    values = numbered.groupBy(*keys, "above").agg(F.array_sort(F.collect_list("k")).alias("ks"))
    low = numbered.join(values.select(*keys, F.col("above").alias("v"), "ks"), keys).where(F.col("v") <= F.col("above"))
    counted = low.groupBy(*keys, "k").agg((F.sum(F.size(F.filter("ks", lambda x: x <= F.col("k")))) / F.max("k")).alias("ps"))
    want = again.join(means, [*keys, "k"]).join(counted, [*keys, "k"]).select(*keys, "ord", "c1", "c5", "m5", "ps")
    both = _both(sound, _planted(sound, _DAY_FAULTS)).join(want, [*keys, "ord"])
    return _findings(both.groupBy("copy").agg(
        F.count_if(~F.col("change_1d").eqNullSafe(F.col("c1"))).alias("change_1d"), F.count_if(~F.col("change_5d").eqNullSafe(F.col("c5"))).alias("change_5d"),
        F.count_if(F.abs(F.col("ma5") - F.col("m5")) > 1e-9).alias("ma5"), F.count_if(F.abs(F.col("position") - F.col("ps")) > 1e-9).alias("position"),
    ))


def stored_samples(m: Market) -> DataFrame:
    """A sample table as it may come from outside: some rows break a rule.

    Every 29th security, from another start for each rule, has a second row in another split, its
    dates in reverse, or a score date before its last bar.
    """
    code = F.col("entity").cast("string")
    recent = top_k(m.bars0.where(F.col("bar_date") <= m.as_of).select("entity", "bar_date"), ["entity"], [F.col("bar_date").desc()], 120)
    sound = recent.groupBy("entity").agg(F.array_sort(F.collect_list("bar_date")).alias("dates"), F.max("bar_date").alias("score_date"))
    sound = sound.withColumn("split", Z.hash_split(code))
    place = F.col("entity") % 29
    planted = sound.withColumns({
        "dates": F.when(place == 7, F.reverse("dates")).otherwise(F.col("dates")),
        "score_date": F.when(place == 11, F.date_sub("score_date", 7)).otherwise(F.col("score_date")),
    })
    return planted.unionByName(sound.where(place == 5).withColumn("split", F.concat(F.col("split").cast("string"), F.lit("-again"))))


@query("dq_leakage_split", _SPEC,
       """with r as (select entity, bar_date, row_number() over (partition by entity order by bar_date desc) as rn from bars0 where bar_date <= (select d from dayref)),
          g as (select entity, list(bar_date order by bar_date) as dates, max(bar_date) as score_date, 'a' as split from r where rn <= 120 group by 1),
          s as (select entity, case when entity % 29 = 7 then list_reverse(dates) else dates end as dates, case when entity % 29 = 11 then score_date - 7 else score_date end as score_date, split from g
            union all select entity, dates, score_date, 'b' from g where entity % 29 = 5),
          c as (select count(*) as n from (select entity from s group by 1 having count(distinct split) > 1)),
          x as (select count(case when dates <> list_sort(list_distinct(dates)) then 1 end) as u, count(case when list_max(dates) > score_date then 1 end) as a,
            count(case when dates[-1] <> score_date then 1 end) as l from s)
          select 'group_in_two_splits' as check_name, n = 0 as passed, n as n_bad from c union all select 'unsorted_dates', u = 0, u from x
          union all select 'bar_after_score_date', a = 0, a from x union all select 'last_bar_differs', l = 0, l from x""")
def _(m: Market) -> DataFrame:
    samples = stored_samples(m)
    crossed = samples.groupBy("entity").agg(F.count_distinct("split").alias("n")).agg(F.count_if(F.col("n") > 1).alias("group_in_two_splits"))
    rows = samples.agg(
        F.count_if(F.col("dates") != F.array_sort(F.array_distinct("dates"))).alias("unsorted_dates"),
        F.count_if(F.exists("dates", lambda d: d > F.col("score_date"))).alias("bar_after_score_date"),
        F.count_if(F.element_at("dates", -1) != F.col("score_date")).alias("last_bar_differs"),
    )
    return unpivot_checks(crossed).unionByName(unpivot_checks(rows))


@query("dq_censoring", _SPEC,
       """with f as (select template_id, entity, round_even(score * 1e7, 0) as s from nowscores), g as (select template_id, entity, round_even(score * 1e7, 0) as s from plusscores),
          h as (select template_id, entity, round_even(score * 1e7, 0) as s from allscores where bar_date = (select d from dayref)),
          a as (select count(*) as n from (select * from ((select * from f except select * from g) union all (select * from g except select * from f)))),
          b as (select count(*) as n from (select * from ((select * from f except select * from h) union all (select * from h except select * from f))))
          select 'future_rows_change_result' as check_name, n = 0 as passed, n as n_bad from a union all select 'control_whole_history', n = 0, n from b""")
def _(m: Market) -> DataFrame:
    """Later bars do not change the as-of scores; the control shows that adjusting over all bars does."""
    book = sim.book(m)

    def result(bars: DataFrame) -> DataFrame:
        return SIM.latest_scores(bars, book, m.as_of).select("template_id", "entity", F.rint(F.col("score") * 1e7).alias("score"))

    def changes(a: DataFrame, b: DataFrame, name: str) -> DataFrame:
        return unpivot_checks(a.exceptAll(b).unionByName(b.exceptAll(a)).agg(F.count(F.lit(1)).alias(name)))

    last = m.bars_in_place.where(F.col("bar_date") == m.as_of)
    later = last.withColumns({c: F.col(c) * 3 for c in PRICES} | {
        "bar_date": F.date_add("bar_date", 70), "adj_factor": F.lit(9.0), "pos": F.col("pos") + 1000,
    })
    now = result(m.qfq_now)
    appended = result(adjust_as_of(m.bars_in_place.unionByName(later), m.as_of))
    return changes(now, appended, "future_rows_change_result").unionByName(changes(now, result(m.qfq), "control_whole_history"))
