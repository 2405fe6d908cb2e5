"""Top-k selections and set operations between snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.functions.ranking import top_k
from tapeloom.functions.scalars import flag, padded
from tapeloom.operators.calendar import with_ordinal
from tapeloom.operators.flows import flow_counts, flows_to_last_seen, shifted_states
from tapeloom.operators.membership import industry_on
from tapeloom.operators.patterns import latest_matches
from tapeloom.operators.runs import streaks
from tapeloom.plans import similarity as sim
from tapeloom.plans.common import K, best_first, daily_top, panel, scored
from tapeloom.plans.patterns import LAST_SQL
from tapeloom.plans.registry import query
from tapeloom.plans.relational import EVENTS_SQL, latest_panel
from tapeloom.sources.staging import stage
from tapeloom.sources.tables import Market


@query("top_template_latest", "template_id:i rank:i entity:i score:f start_date:d end_date:d industry:s",
       """select * from (select a.template_id, row_number() over (partition by a.template_id order by a.score desc, a.entity) as rank, a.entity, a.score,
            b.bar_date as start_date, a.bar_date as end_date, coalesce(m.industry, 'missing') as industry
          from nowscores a join bars b on b.entity = a.entity and b.pos = a.pos - a.n + 1
          left join membership m on a.entity = m.entity and m.in_date <= a.bar_date and (m.out_date is null or m.out_date > a.bar_date)
          where a.bar_date = (select d from dayref)) where rank <= 10""")
def _(m: Market) -> DataFrame:
    best = top_k(sim.latest(m), ["template_id"], best_first(), 10)
    return industry_on(best.withColumn("bar_date", F.col("end_date")), m.membership)


@query("top_daily_100", "template_id:i bar_date:d rank:i entity:i score:f industry_code:i",
       "select template_id, bar_date, rank, entity, score, industry_code from panel where rank <= 100")
def _(m: Market) -> DataFrame:
    return daily_top(m, 100)


@query("top_primary_match", "entity:i bar_date:d category:s score:f",
       f"with {LAST_SQL} select l.entity, l.bar_date, p.category, p.score from last_bar l join prim p on p.entity = l.entity where l.pos >= 60")
def _(m: Market) -> DataFrame:
    # Ties of the pattern scores go to the first category: the struct orders by score, then by minus position.
    found = latest_matches(m.bars0).where(F.col("status") == "matched")
    return found.select("entity", "bar_date", "primary.category", "primary.score")


# Weights of the ways in which a security can match a query.
SEARCH_WEIGHTS = {"code": 100, "symbol": 95, "name": 90, "symbol_start": 70, "spelling_start": 60, "name_start": 50}
SEARCHES = ["000001", " 000012.sh", "Supplier#000000007", "s00000", "Supplier#00000000", "nobody"]


def search(securities: DataFrame, queries: list[str], limit: int = 20) -> DataFrame:
    """The best matches of each query text: (query, match_rank, place) over code, symbol, name and spelling.

    The query texts ride along as one short literal array per security.
    """
    q = F.explode(F.array(*[F.lit(text.strip()) for text in queries if text.strip()])).alias("query")
    rows = securities.select("entity", "symbol", "code", "name", "spelling", q).withColumn("q", F.upper("query"))
    hit = F.contains("symbol", F.col("q")) | F.contains("code", F.col("q")) | F.contains("name", F.col("query")) | F.contains("spelling", F.col("q"))
    ways = {
        "code": F.col("code") == F.col("q"), "symbol": F.col("symbol") == F.col("q"), "name": F.col("name") == F.col("query"),
        "symbol_start": F.startswith("symbol", F.col("q")), "spelling_start": F.startswith("spelling", F.col("q")),
        "name_start": F.startswith("name", F.col("query")),
    }
    weights = [F.when(cond, SEARCH_WEIGHTS[way]).otherwise(0) for way, cond in ways.items()]
    ranked_ = rows.where(hit).withColumn("match_rank", sum(weights[1:], weights[0]))
    return top_k(ranked_, ["query"], [F.col("match_rank").desc(), F.col("symbol")], limit, "place")


@query("top_search", "query:s place:i entity:i match_rank:i",
       f"""with b as (select entity, lpad(cast(entity as varchar), cast(greatest(6, length(cast(entity as varchar))) as integer), '0') as symbol, name from securities),
          c as (select *, symbol || '.SH' as code, 'S' || symbol as spelling from b),
          t as (select trim(x) as query, upper(trim(x)) as q from (select unnest({SEARCHES!r}) as x)),
          h as (select query, entity, symbol, case when code = q then 100 else 0 end + case when symbol = q then 95 else 0 end + case when name = query then 90 else 0 end
              + case when starts_with(symbol, q) then 70 else 0 end + case when starts_with(spelling, q) then 60 else 0 end + case when starts_with(name, query) then 50 else 0 end as match_rank
            from c, t where contains(symbol, q) or contains(code, q) or contains(name, query) or contains(spelling, q))
          select * from (select *, row_number() over (partition by query order by match_rank desc, symbol) as place from h) where place <= 20""")
def _(m: Market) -> DataFrame:
    symbol = padded("entity")
    listed = m.securities.select(
        "entity", symbol.alias("symbol"), F.concat(symbol, F.lit(".SH")).alias("code"), "name", F.concat(F.lit("S"), symbol).alias("spelling"),
    )
    return search(listed, SEARCHES)


@query("top_one_per_security", "entity:i template_id:i bar_date:d score:f",
       """select entity, template_id, bar_date, score from (select *, row_number() over (partition by entity order by floor(score * 1e9) desc, bar_date desc, template_id desc) as rn from scores) where rn = 1""")
def _(m: Market) -> DataFrame:
    key = F.struct(F.floor(F.col("score") * 1e9), "bar_date", "template_id", "score")
    best = sim.scores(m).groupBy("entity").agg(F.max(key).alias("b"))
    return best.select("entity", "b.template_id", "b.bar_date", "b.score")


@query("top_leader_removal", "template_id:i bar_date:d industry_code:i eligible:i above:i top100:i without:i eligible_left:i above_left:i above_rate_left:f top100_left:i top100_share_left:f",
       """with r as (select p.*, row_number() over (partition by template_id, bar_date, industry_code order by score desc, entity) as rn,
              row_number() over (partition by template_id, bar_date order by score desc, entity) as rank from panel p),
          c as (select template_id, bar_date, industry_code, k.without, count(*) as eligible, count(case when score >= 0.7 then 1 end) as above, count(case when rank <= 100 then 1 end) as top100,
            count(case when rn > k.without then 1 end) as eligible_left, count(case when score >= 0.7 and rn > k.without then 1 end) as above_left,
            count(case when rank <= 100 and rn > k.without then 1 end) as top100_left from r, (select unnest([1, 3]) as without) k group by 1, 2, 3, 4)
          select *, coalesce(above_left * 1.0e0 / nullif(eligible_left, 0), 0) as above_rate_left, top100_left / 100.0e0 as top100_share_left from c""")
def _(m: Market) -> DataFrame:
    return leader_removal(panel(m), 0.7)


def leader_removal(rows: DataFrame, threshold: float, leaders: tuple[int, ...] = (1, 3)) -> DataFrame:
    """Counts of every template, day and industry with and without its leaders.

    The leaders of a group are its highest scores, so whatever is kept by score (above a threshold, in
    the daily list) loses them first: removing them is arithmetic on counts.
    """
    keys = ["template_id", "bar_date", "industry_code"]
    listed = top_k(rows, ["template_id", "bar_date"], best_first(), K).groupBy(*keys).agg(F.count(F.lit(1)).alias("top100"))
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("eligible"), F.count_if(F.col("score") >= threshold).alias("above"))
    code = F.coalesce("industry_code", F.lit(-1))  # a security without industry belongs to a group of its own
    counts, listed = counts.withColumn("_code", code), listed.withColumn("_code", code).drop("industry_code")
    counts = counts.join(listed, ["template_id", "bar_date", "_code"], "left")
    counts = counts.fillna(0, ["top100"]).withColumn("without", F.explode(F.array(*[F.lit(k) for k in leaders])))
    left = {f"{c}_left": F.greatest(F.col(c) - F.col("without"), F.lit(0)) for c in ("eligible", "above", "top100")}
    return counts.withColumns(left).withColumns({
        "above_rate_left": F.coalesce(F.try_divide("above_left", "eligible_left"), F.lit(0.0)), "top100_share_left": F.col("top100_left") / float(K),
    })


def day_states(m: Market, lags: list[int], group: list[str]) -> DataFrame:
    top = daily_top(m)
    newest = m.cal.agg(F.max("ord")).scalar()
    return shifted_states(top, ["template_id"], lags, group, newest)


_STATES = """
with l as (select unnest([10, 20]) as lag),
sp as (select d.template_id, l.lag, d.ord as o, d.entity, d.industry_code as c, null as p, d.rank as cr, null as pr from daily d, l
  union all select d.template_id, l.lag, d.ord + l.lag, d.entity, null, d.industry_code, null, d.rank from daily d, l where d.ord + l.lag <= (select max(ord) from cal)),
st as (select template_id, lag, o, entity, max(c) as c, max(p) as p, max(cr) as cr, max(pr) as pr,
  case when max(c) is not null and max(p) is not null then 'retained' when max(c) is not null then 'new' else 'exit' end as state from sp group by 1, 2, 3, 4)
"""


@query("set_flow", "template_id:i lag:i ord:i industry_code:i new_count:i retained_count:i exit_count:i net:i",
       _STATES + """, fl as (select template_id, lag, o as ord, coalesce(c, p) as industry_code, count(case when state = 'new' then 1 end) as new_count,
          count(case when state = 'retained' then 1 end) as retained_count from st where c is not null group by all),
         ex as (select template_id, lag, o as ord, p as industry_code, count(*) as exit_count from st where state = 'exit' group by all)
         select coalesce(f.template_id, e.template_id) as template_id, coalesce(f.lag, e.lag) as lag, coalesce(f.ord, e.ord) as ord, coalesce(f.industry_code, e.industry_code) as industry_code,
           coalesce(new_count, 0) as new_count, coalesce(retained_count, 0) as retained_count, coalesce(exit_count, 0) as exit_count, coalesce(new_count, 0) - coalesce(exit_count, 0) as net
         from fl f full join ex e on f.template_id = e.template_id and f.lag = e.lag and f.ord = e.ord and f.industry_code = e.industry_code""")
def _(m: Market) -> DataFrame:
    states = day_states(m, [10, 20], ["industry_code"]).withColumn(
        "industry_code", F.coalesce("cur.industry_code", "prior.industry_code")
    )
    counts = flow_counts(states, ["template_id", "lag", "ord", "industry_code"])
    return counts.withColumn("net", F.col("new_count") - F.col("exit_count"))


@query("set_flow_lists", "template_id:i ord:i state:s members:s",
       _STATES + """select template_id, o as ord, state, string_agg(cast(entity as varchar), ',' order by coalesce(cr, pr), entity) as members from st where lag = 10 group by all""")
def _(m: Market) -> DataFrame:
    states = day_states(m, [10], ["industry_code", "rank"])
    rank = F.coalesce("cur.rank", "prior.rank")
    # A list holds at most k current and k prior members of one snapshot.
    lists = states.groupBy("template_id", "ord", "state").agg(
        F.array_sort(F.collect_list(F.struct(rank.alias("rank"), "entity"))).alias("l")
    )
    return lists.withColumn("members", F.array_join(F.transform("l", lambda x: x["entity"].cast("string")), ","))


@query("set_flow_group", "template_id:i industry_code:i ord:i new_count:i retained_count:i exit_count:i",
       """with seen as (select distinct template_id, industry_code, ord from panel),
          nx as (select *, lead(ord) over (partition by template_id, industry_code order by ord) as nxt from seen),
          sel as (select p.template_id, p.industry_code, p.ord, p.entity, nx.nxt from panel p join nx using (template_id, industry_code, ord) where p.score >= 0.7),
          sp as (select template_id, industry_code, ord as o, entity, 1 as c, 0 as p from sel union all select template_id, industry_code, nxt, entity, 0, 1 from sel where nxt is not null),
          b as (select template_id, industry_code, o, entity, max(c) as c, max(p) as p from sp group by all),
          f as (select template_id, industry_code, o, sum(c * (1 - p)) as n, sum(c * p) as r, sum(p * (1 - c)) as x from b group by all)
          select s.template_id, s.industry_code, s.ord, coalesce(n, 0) as new_count, coalesce(r, 0) as retained_count, coalesce(x, 0) as exit_count
          from seen s left join f on s.template_id = f.template_id and s.industry_code = f.industry_code and s.ord = f.o""")
def _(m: Market) -> DataFrame:
    keys = ["template_id", "industry_code"]
    base = stage(panel(m).select(*keys, "ord", "entity", "score"))
    return flows_to_last_seen(
        base.select(*keys, "ord").distinct(), base.where(F.col("score") >= 0.7).select(*keys, "ord", "entity"), keys
    )


def jaccard_table(sets: DataFrame, keys: list[str], left: str = "in_a", right: str = "in_b") -> DataFrame:
    both = F.sum((F.col(left) & F.col(right)).cast("int"))
    return sets.groupBy(*keys).agg(
        both.alias("common"), (both / F.count(F.lit(1))).alias("jaccard")
    )


@query("set_jaccard", "template_id:i bar_date:d common:i jaccard:f",
       """with d as (select template_id, ord, entity, 1 as c, 0 as p from daily union all select template_id, ord + 1, entity, 0, 1 from daily),
          b as (select template_id, ord, entity, max(c) as c, max(p) as p from d group by all)
          select template_id, bar_date, sum(c * p) as common, avg(c * p * 1.0e0) as jaccard from b join cal using (ord) group by 1, 2""")
def _(m: Market) -> DataFrame:
    states = day_states(m, [1], ["industry_code"])
    sets = states.withColumn("in_a", F.col("cur").isNotNull()).withColumn("in_b", F.col("prior").isNotNull())
    return jaccard_table(sets, ["template_id", "ord"]).join(F.broadcast(m.cal), "ord")


@query("set_consistency", "template_id:i bar_date:d qualified:i consistent_2:i consistent_3:i",
       """with q as (select template_id, ord, bar_date, entity, ord - row_number() over (partition by template_id, entity order by ord) as g from panel where score >= 0.7),
          s as (select *, row_number() over (partition by template_id, entity, g order by ord) as streak from q)
          select template_id, bar_date, count(*) as qualified, count(case when streak >= 2 then 1 end) as consistent_2, count(case when streak >= 3 then 1 end) as consistent_3 from s group by 1, 2""")
def _(m: Market) -> DataFrame:
    q = scored(m).where(F.col("score") >= 0.7)
    return streaks(q, ["template_id", "entity"]).groupBy("template_id", "bar_date").agg(
        F.count(F.lit(1)).alias("qualified"), F.count_if(F.col("streak") >= 2).alias("consistent_2"),
        F.count_if(F.col("streak") >= 3).alias("consistent_3"),
    )


@query("set_symmetric_boundary", "template_id:i ord:i changed:i boundary_share:f",
       """with t as (select template_id, ord, entity, rank from ranked where rank <= 35),
          d as (select template_id, ord as o, entity, rank as c, null as p from t union all select template_id, ord + 1, entity, null, rank from t where ord < (select max(ord) from cal)),
          b as (select template_id, o as ord, entity, max(c) as c, max(p) as p from d group by 1, 2, 3)
          select template_id, ord, count(*) as changed, avg(case when c between 25 and 35 or p between 25 and 35 then 1.0e0 else 0 end) as boundary_share
          from b where (coalesce(c, 99) <= 30) <> (coalesce(p, 99) <= 30) group by 1, 2""")
def _(m: Market) -> DataFrame:
    # Ranks beyond 35 cannot be boundary ranks, so the Top-35 carries all the evidence.
    near = top_k(scored(m), ["template_id", "bar_date"], best_first(), 35)
    newest = m.cal.agg(F.max("ord")).scalar()
    both = shifted_states(near, ["template_id"], [1], ["rank"], newest)
    cur, prior = F.col("cur.rank"), F.col("prior.rank")
    inside = F.coalesce(cur, F.lit(99)) <= 30
    was = F.coalesce(prior, F.lit(99)) <= 30
    edge = F.coalesce(cur.between(25, 35), F.lit(False)) | F.coalesce(prior.between(25, 35), F.lit(False))
    return both.where(inside != was).groupBy("template_id", "ord").agg(
        F.count(F.lit(1)).alias("changed"), F.avg(flag(edge)).alias("boundary_share")
    )


@query("set_union_rows", "template_id:i bar_date:d rank:i entity:i score:f",
       "select template_id, bar_date, rank, entity, score from daily where bar_date = (select d from dayref)")
def _(m: Market) -> DataFrame:
    """The lists of all templates as one table: the template is a column from the start, no union of per-template frames."""
    return daily_top(m).where(F.col("bar_date") == m.as_of)


@query("set_cross_hits", "bar_date:d entity:i template_id:i others:s",
       """select a.bar_date, a.entity, a.template_id, coalesce(string_agg(cast(b.template_id as varchar), ',' order by b.template_id), '') as others
          from daily a left join daily b on a.bar_date = b.bar_date and a.entity = b.entity and a.template_id <> b.template_id group by 1, 2, 3""")
def _(m: Market) -> DataFrame:
    hits = daily_top(m).groupBy("bar_date", "entity").agg(F.array_sort(F.collect_set("template_id")).alias("all"))
    rows = hits.select("bar_date", "entity", "all", F.explode("all").alias("template_id"))
    others = F.filter("all", lambda t: t != F.col("template_id"))
    return rows.withColumn("others", F.array_join(F.transform(others, lambda t: t.cast("string")), ","))


@query("set_flow_events", "event_type:s day:d new_count:i retained_count:i exit_count:i",
       """with u as (select distinct user_id, cast(ts as date) as day, event_type from events),
          sp as (select event_type, day, user_id, 1 as c, 0 as p from u union all select event_type, day + 1, user_id, 0, 1 from u where day < (select max(day) from u)),
          b as (select event_type, day, user_id, max(c) as c, max(p) as p from sp group by all)
          select event_type, day, sum(c * (1 - p)) as new_count, sum(c * p) as retained_count, sum(p * (1 - c)) as exit_count from b group by 1, 2""")
def _(m: Market) -> DataFrame:
    day = F.col("ts").cast("date")
    members = m.table("events").select("event_type", F.datediff(day, F.lit("1970-01-01")).alias("ord"), F.col("user_id").alias("entity")).distinct()
    newest = m.table("events").agg(F.max(F.datediff(day, F.lit("1970-01-01")))).scalar()
    states = shifted_states(members.withColumn("g", F.lit(1)), ["event_type"], [1], ["g"], newest)
    counts = flow_counts(states, ["event_type", "ord"])
    return counts.withColumn("day", F.date_add(F.lit("1970-01-01").cast("date"), F.col("ord")))
