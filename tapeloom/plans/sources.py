"""Readers, snapshots and sinks."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.functions.ranking import top_k
from tapeloom.operators import bars as B
from tapeloom.operators import calendar as C
from tapeloom.plans import similarity as sim
from tapeloom.functions.scalars import padded
from tapeloom.plans.registry import query
from tapeloom.sources import store
from tapeloom.sources.staging import staging_root
from tapeloom.sources.tables import Market

_BARS = "entity bigint, open double, high double, low double, close double, volume double, amount double"
_known: dict[tuple[str, str, str], str] = {}


def _fresh(m: Market, name: str) -> str:
    return f"{staging_root(m.spark)}/tapeloom-store/{name}-{uuid.uuid4().hex}"


def _stored(m: Market, name: str, df) -> str:
    """Path of a partitioned copy of a frame, written once per session and folder."""
    key = (m.spark.sparkContext.applicationId, m.folder, name)
    if key not in _known:
        path = _fresh(m, name)
        store.write_partitioned(df(), path)
        _known[key] = path
    return _known[key]


def bar_store(m: Market) -> DataFrame:
    # written once: the store is the table, unless the query has staged the bars before
    return store.read_partitioned(m.spark, _stored(m, "bars", lambda: m.bars0 if "bars0" in vars(m) else m.aggregate_lines()), _BARS)


def factor_store(m: Market) -> DataFrame:
    path = _stored(m, "factors", lambda: m.factors)
    return store.read_partitioned(m.spark, path, "entity bigint, adj_factor double")


@query("src_partitioned_scan", "bar_date:d n:i volume:f",
       """select bar_date, count(*) as n, sum(volume) as volume from bars0
          where bar_date between date '1997-01-03' and date '1999-12-31' group by 1""")
def _(m: Market) -> DataFrame:
    picked = store.between(bar_store(m), "19970103", "19991231")
    return picked.groupBy("bar_date").agg(F.count(F.lit(1)).alias("n"), F.sum("volume").alias("volume"))


@query("src_latest_partition", "bars:s factors:s",
       """select strftime(max(bar_date), '%Y%m%d') as bars,
          (select strftime(max(bar_date), '%Y%m%d') from factors) as factors from bars0""")
def _(m: Market) -> DataFrame:
    newest = store.latest_partition(factor_store(m))
    return bar_store(m).agg(F.max(store.PARTITION).alias("bars")).withColumn("factors", newest)


@query("src_snapshot_read", "entity:i close:f amount:f",
       "select entity, close, amount from bars0 where bar_date = (select max(bar_date) from bars0)")
def _(m: Market) -> DataFrame:
    return store.snapshot(bar_store(m), ["entity", "close", "amount"])


@query("src_trading_calendar", "seq:i bar_date:d",
       """select row_number() over (order by bar_date) as seq, bar_date from
          (select bar_date from cal where bar_date <= (select d from dayref) order by bar_date desc limit 60)""")
def _(m: Market) -> DataFrame:
    return C.last_dates(m.cal, 60, m.as_of)


@query("src_bar_bounds", "entity:i first_date:d last_date:d",
       "select entity, min(bar_date) as first_date, max(bar_date) as last_date from bars0 group by 1")
def _(m: Market) -> DataFrame:
    week = F.next_day(F.date_sub(F.col("l_shipdate").cast("date"), 1), "FRI")
    # Bounds need no bars: a min / max over the raw lines is a pure partial aggregate.
    return m.table("lineitem").groupBy(F.col("l_suppkey").alias("entity")).agg(
        F.min(week).alias("first_date"), F.max(week).alias("last_date")
    )


@query("src_st_history", "bar_date:d n:i named:i",
       """select bar_date, count(*) as n, count(case when entity % 2 = 0 then 1 end) as named
          from flags where bar_date between date '1998-01-02' and date '2000-12-29' group by 1""")
def _(m: Market) -> DataFrame:
    # Two writers with different schemas share one table; the merged read fills the gap with null.
    path = _fresh(m, "flags")
    store.write_partitioned(m.flags.where(F.col("entity") % 2 == 1), f"{path}/part=old")
    store.write_partitioned(
        m.flags.where(F.col("entity") % 2 == 0).withColumn("type_name", F.lit("flagged")), f"{path}/part=new"
    )
    df = store.read_partitioned(m.spark, path, "entity bigint, type_name string", merge=True)
    return store.between(df, "19980102", "20001229").groupBy("bar_date").agg(
        F.count(F.lit(1)).alias("n"), F.count("type_name").alias("named")
    )


@query("src_bulk_history", "entity:i bar_date:d close:f adj_factor:f",
       """select entity, bar_date, close, adj_factor from barsf where entity in
          (select entity from securities where board = 'main') and bar_date >= date '1999-01-01'""")
def _(m: Market) -> DataFrame:
    codes = m.securities.where(F.col("board") == "main").select("entity")
    return m.bars_with_factor.where(F.col("bar_date") >= F.lit("1999-01-01").cast("date")).join(
        codes, "entity", "left_semi"
    )


@query("src_security_union", "code:s entity:i status:s",
       """select * from (select code, entity, status from (
            select *, lpad(cast(entity as varchar), cast(greatest(6, length(cast(entity as varchar))) as integer), '0') || case entity % 4 when 0 then '.SH' when 1 then '.SZ' when 2 then '.BJ' else '.XX' end as code
            from (select entity, 'L' as status, 0 as prio from securities
                  union all select entity, 'D', 1 from securities where delist_date is not null
                  union all select entity, 'P', 2 from securities where entity % 7 = 0))
          qualify row_number() over (partition by code order by prio) = 1) where regexp_matches(code, '\\.(SH|SZ|BJ)$')""")
def _(m: Market) -> DataFrame:
    base = m.securities
    listed = base.select("entity", F.lit("L").alias("status"), F.lit(0).alias("prio"))
    gone = base.where(F.col("delist_date").isNotNull()).select("entity", F.lit("D").alias("status"), F.lit(1).alias("prio"))
    paused = base.where(F.col("entity") % 7 == 0).select("entity", F.lit("P").alias("status"), F.lit(2).alias("prio"))
    suffix = F.element_at(F.array(*[F.lit(s) for s in (".SH", ".SZ", ".BJ", ".XX")]), (F.col("entity") % 4 + 1).cast("int"))
    all_rows = listed.unionByName(gone).unionByName(paused).withColumn(
        "code", F.concat(padded("entity"), suffix)
    )
    # min_by is a partial aggregate: no sort and no window per code.
    best = all_rows.where(F.col("code").rlike(r"\.(SH|SZ|BJ)$")).groupBy("code").agg(
        F.min_by(F.struct("entity", "status"), "prio").alias("r")
    )
    return best.select("code", "r.*")


def registry_path(m: Market) -> str:
    path = _fresh(m, "registry")
    cut = sim.points(m).groupBy("template_id").agg(
        F.min("bar_date").alias("a"), F.max("bar_date").alias("b"), F.count(F.lit(1)).cast("int").alias("n")
    )
    text = F.date_format
    entry = F.struct(
        F.concat(F.lit("t"), F.col("template_id")).alias("key"),
        F.concat(F.lit("template "), F.col("template_id")).alias("label"),
        padded("template_id").alias("source_code"),
        text("a", "yyyyMMdd").alias("start_date"), text("b", "yyyyMMdd").alias("end_date"),
        F.col("n").alias("window_bars"),
    )
    doc = cut.agg(F.array_sort(F.collect_list(entry)).alias("templates")).select(
        F.lit(1).alias("schema_version"), F.lit(store.ALGORITHM).alias("algorithm"), "templates"
    )
    doc.write.json(path)
    return path


@query("src_template_registry", "key:s source_code:s start_date:s end_date:s window_bars:i",
       """select 't' || template_id as key, lpad(cast(template_id as varchar), 6, '0') as source_code,
          strftime(min(bar_date), '%Y%m%d') as start_date, strftime(max(bar_date), '%Y%m%d') as end_date, count(*) as window_bars
          from templates group by template_id""")
def _(m: Market) -> DataFrame:
    return store.read_registry(m.spark, registry_path(m)).where(F.col("algorithm") == store.ALGORITHM)


#: faults planted in a copy of the registry, by template: a repeated key, a bad date, a window of one bar, reversed dates, a
#: window that its security does not have, one that starts between two bars, and one that is longer than it says
_FAULTY = """
fr as (select 't' || template_id as key, template_id, strftime(min(bar_date), '%Y%m%d') as start_date, strftime(max(bar_date), '%Y%m%d') as end_date, count(*) as window_bars from templates group by template_id),
reg as (select 'sound' as copy, key, template_id as source, start_date, end_date, window_bars from fr
  union all select 'planted', key, template_id, start_date, end_date, window_bars from fr
  union all select 'planted', 't1', template_id, start_date, end_date, window_bars from fr where template_id = 2
  union all select 'planted', 'x1', template_id, '2000-1-7', end_date, window_bars from fr where template_id = 1
  union all select 'planted', 'x2', template_id, start_date, end_date, 1 from fr where template_id = 2
  union all select 'planted', 'x3', template_id, end_date, start_date, window_bars from fr where template_id = 3
  union all select 'planted', 'x4', 999999, start_date, end_date, window_bars from fr where template_id = 4
  union all select 'planted', 'x5', template_id, cast(cast(start_date as bigint) - 1 as varchar), end_date, window_bars from fr where template_id = 1)"""


@query("dq_registry", "check_name:s passed:b n_bad:i",
       f"""with {_FAULTY},
          fmt as (select copy, 0 as algorithm, count(key) - count(distinct key) as unique_key, count(case when not (regexp_full_match(start_date, '[0-9]{{8}}') and regexp_full_match(end_date, '[0-9]{{8}}')) then 1 end) as date_format,
            count(case when start_date > end_date then 1 end) as date_order, count(case when window_bars < 2 then 1 end) as window_bars, 0 as not_empty from reg group by 1),
          win as (select r.copy, r.key, r.start_date, r.end_date, r.window_bars, count(b.entity) as n, min(strftime(b.bar_date, '%Y%m%d')) as f, max(strftime(b.bar_date, '%Y%m%d')) as l
            from reg r left join bars0 b on b.entity = r.source and strftime(b.bar_date, '%Y%m%d') between r.start_date and r.end_date group by 1, 2, 3, 4, 5),
          src as (select copy, count(case when n = 0 then 1 end) as window_exists, count(case when n > 0 and (f <> start_date or l <> end_date) then 1 end) as window_ends,
            count(case when n > 0 and n <> window_bars then 1 end) as window_length, 0 as repeated_dates, 0 as prices from win group by 1),
          c as (select * from fmt join src using (copy)),
          u as (unpivot c on algorithm, unique_key, date_format, date_order, window_bars, not_empty, window_exists, window_ends, window_length, repeated_dates, prices into name check_name value n_bad)
          select case when copy = 'sound' then check_name else 'planted ' || check_name end as check_name, n_bad = 0 as passed, n_bad from u""")
def _(m: Market) -> DataFrame:
    sound = store.read_registry(m.spark, registry_path(m))
    first, second, third, fourth = (sound.where(F.col("key") == f"t{i}") for i in range(1, 5))
    earlier = (F.col("start_date").cast("bigint") - 1).cast("string")
    planted = [
        sound, second.withColumn("key", F.lit("t1")), first.withColumns({"key": F.lit("x1"), "start_date": F.lit("2000-1-7")}),
        second.withColumns({"key": F.lit("x2"), "window_bars": F.lit(1)}), third.withColumns({"key": F.lit("x3"), "start_date": F.col("end_date"), "end_date": F.col("start_date")}),
        fourth.withColumns({"key": F.lit("x4"), "source_code": F.lit("999999")}), first.withColumns({"key": F.lit("x5"), "start_date": earlier}),
    ]
    faulty = reduce(DataFrame.unionByName, planted)
    bars = m.bars0.withColumn("source_code", padded("entity"))

    def checks(registry: DataFrame, prefix: str) -> DataFrame:
        both = store.registry_findings(registry).unionByName(store.registry_windows(registry, bars))
        return both.withColumn("check_name", F.concat(F.lit(prefix), F.col("check_name")))

    return checks(sound, "").unionByName(checks(faulty, "planted "))


@query("src_ranking_file", "template_id:s rank:i entity:i score:f window_bars:i",
       """select cast(template_id as varchar) as template_id, rank, entity, score, n as window_bars from (
          select *, row_number() over (partition by template_id order by score desc, entity) as rank
          from nowscores) where rank <= 20""")
def _(m: Market) -> DataFrame:
    path = _fresh(m, "rankings")
    best = top_k(sim.latest(m), ["template_id"], [F.col("score").desc(), F.col("entity")], 20)
    docs = best.groupBy(F.col("template_id").cast("string").alias("template_id")).agg(
        F.max(F.date_format("end_date", "yyyyMMdd")).alias("as_of"),
        F.array_sort(F.collect_list(F.struct(
            "rank", "entity", "score", F.date_format("end_date", "yyyyMMdd").alias("end_date"), "window_bars"
        ))).alias("items"),
    ).withColumn("algorithm", F.lit(store.ALGORITHM))
    docs.write.json(path)
    return store.read_rankings(m.spark, path, F.date_format(m.as_of, "yyyyMMdd"), 20)


@query("src_csv_reload", "threshold:f template_id:i bar_date:s n:i",
       """select 0.75e0 as threshold, template_id, strftime(bar_date, '%Y%m%d') as bar_date,
          count(case when score >= 0.75e0 then 1 end) as n from scores group by template_id, bar_date""")
def _(m: Market) -> DataFrame:
    path = _fresh(m, "counts")
    lines = F.array(*[F.lit(t) for t in (0.70, 0.75, 0.80)])
    counts = (
        sim.scores(m)
        .groupBy("template_id", "bar_date")
        .agg(*[F.count_if(F.col("score") >= t).alias(f"n{i}") for i, t in enumerate((0.70, 0.75, 0.80))])
        .select("template_id", F.date_format("bar_date", "yyyyMMdd").alias("bar_date"),
                F.posexplode(lines).alias("i", "threshold"), F.array("n0", "n1", "n2").alias("n"))
        .select("threshold", "template_id", "bar_date", F.get("n", F.col("i")).alias("n"))
    )
    store.write_csv(counts, path)
    back = store.read_csv(m.spark, path, "threshold double, template_id bigint, bar_date string, n bigint")
    return back.where(F.abs(F.col("threshold") - 0.75) < 1e-8)


@query("snk_tables", "entity:i n:i close_sum:f",
       "select entity, count(*) as n, sum(close) as close_sum from qfq group by 1")
def _(m: Market) -> DataFrame:
    path = _fresh(m, "qfq")
    m.qfq.select("entity", "bar_date", "close").write.mode("errorifexists").parquet(path)
    return m.spark.read.parquet(path).groupBy("entity").agg(
        F.count(F.lit(1)).alias("n"), F.sum("close").alias("close_sum")
    )


@query("top_tail_rows", "entity:i bar_date:d close:f",
       """select entity, bar_date, close from bars0
          qualify row_number() over (partition by entity order by bar_date desc) <= 30""")
def _(m: Market) -> DataFrame:
    return top_k(m.bars0, ["entity"], [F.col("bar_date").desc()], 30)


@query("prj_pick_latest_shared_date", "as_of:d",
       "select least((select max(bar_date) from bars0), (select max(bar_date) from factors)) as as_of")
def _(m: Market) -> DataFrame:
    newest = m.factors.agg(F.max("bar_date")).scalar()
    return m.cal.agg(F.max("bar_date").alias("d")).select(F.least(F.col("d"), newest).alias("as_of"))
