"""Calibration metrics, splits, identifiers and greedy quotas."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.functions.ranking import order_positions, top_k
from tapeloom.functions.scalars import round_even
from tapeloom.operators import facts as X
from tapeloom.operators import metrics as Q
from tapeloom.operators import sampling as Z
from tapeloom.operators import shape as S
from tapeloom.operators.selection import fill_quotas
from tapeloom.plans import shape
from tapeloom.plans.projections import anonymous_windows
from tapeloom.plans.registry import query
from tapeloom.plans.relational import RATED, pair_counts, rated
from tapeloom.plans.sql_terms import profile_sql
from tapeloom.sources.staging import stage
from tapeloom.sources.tables import Market

_RK = f"{RATED}, rk as (select *, row_number() over (partition by category order by score desc, sample_id) as rank, count(*) over (partition by category) as n from rated)"
_HEX = "cast('0x' || substr(sha256({}), 1, 13) as bigint)"


@query("met_ndcg", "category:s dcg:f idcg:f ndcg:f",
       f"""with {_RK}, id as (select *, row_number() over (partition by category order by rating desc, sample_id) as ir from rk)
          select a.category, a.dcg, b.idcg, coalesce(a.dcg / nullif(b.idcg, 0), 0) as ndcg from (select category, sum((power(2, rating) - 1) / log2(rank + 1)) as dcg from rk group by 1) a
          join (select category, sum((power(2, rating) - 1) / log2(ir + 1)) as idcg from id group by 1) b using (category)""")
def _(m: Market) -> DataFrame:
    return Q.ndcg(Q.ranked_items(rated(m)))


@query("met_pairwise", "category:s accuracy:f comparable:i tied:i",
       f"""with {RATED} select a.category, (count(case when a.score > b.score then 1 end) + 0.5e0 * count(case when a.score = b.score then 1 end)) / count(*) as accuracy, count(*) as comparable,
          count(case when a.score = b.score then 1 end) as tied from rated a join rated b on a.category = b.category and a.rating > b.rating group by 1""")
def _(m: Market) -> DataFrame:
    p = pair_counts(rated(m)).where(F.col("comparable") > 0)
    return p.withColumn("accuracy", (F.col("concordant") + 0.5 * F.col("tied")) / F.col("comparable"))


@query("met_purity", "category:s top_k:i n:i purity:f severe:f",
       f"""with {_RK} select category, k.top_k, count(*) as n, avg(case when rating >= 2 then 1.0e0 else 0 end) as purity, avg(case when rating = 0 then 1.0e0 else 0 end) as severe
         from rk join (select unnest([20, 50]) as top_k) k on rk.rank <= k.top_k group by 1, 2""")
def _(m: Market) -> DataFrame:
    return Q.purity(rated(m), (20, 50))


@query("met_strata", "category:s stratum:i n:i score_min:f score_max:f mean_rating:f",
       f"""with {_RK}, s as (select *, ntile(4) over (partition by category order by rank) as stratum from rk)
          select category, stratum, count(*) as n, min(score) as score_min, max(score) as score_max, avg(rating) as mean_rating from s group by 1, 2""")
def _(m: Market) -> DataFrame:
    return Q.strata(Q.ranked_items(rated(m)))


@query("met_severe", "category:s rank:i sample_id:i score:f", f"with {_RK} select category, rank, sample_id, score from rk where rank <= 20 and rating = 0")
def _(m: Market) -> DataFrame:
    best = top_k(rated(m), ["category"], [F.col("score").desc(), F.col("sample_id")], 20)
    return best.where(F.col("rating") == 0)


@query("met_extreme_mismatch", "side:s pos:i entity:i category:s score:f rating:i",
       f"""with {shape.SCORE_SQL}, x as (select 'low_rated_high_score' as side, entity, category, score, rating, row_number() over (order by round_even(score * 1e6, 0) desc, entity, category) as pos from v2 where rating = 0
            union all select 'high_rated_low_score', entity, category, score, rating, row_number() over (order by round_even(score * 1e6, 0), entity, category) from v2 where rating = 3)
          select * from x where pos <= 10""")
def _(m: Market) -> DataFrame:
    rows = stage(with_rating(m).drop("contributors")).withColumn("key", F.rint(F.col("score") * 1e6))
    high = rows.where(F.col("rating") == 0).withColumn("side", F.lit("low_rated_high_score")).withColumn("key", -F.col("key"))
    low = rows.where(F.col("rating") == 3).withColumn("side", F.lit("high_rated_low_score"))
    return top_k(high.unionByName(low), ["side"], [F.col("key"), F.col("entity"), F.col("category")], 10, "pos")


def with_rating(m: Market) -> DataFrame:
    return shape.v2_scores(m).withColumn("rating", shape.rating_of())


_CONF = f"""with {shape.SCORE_SQL}, h as (select entity, category, rating, max(rating) over (partition by entity) as mx from v2),
  w as (select entity, any_value(category) as human from h where rating = mx group by 1 having count(*) = 1),
  p as (select entity, arg_max(category, struct_pack(a := score, b := case category when 'fresh_breakout' then -1 when 'healthy_uptrend' then -2 else -3 end)) as predicted from v2 group by 1)
  select human, predicted, count(*) as n from w join p using (entity) group by 1, 2"""


def _confusion(name: str) -> None:
    @query(name, "human:s predicted:s n:i", _CONF)
    def _(m: Market) -> DataFrame:
        return Q.confusion(with_rating(m), S.CATEGORY_KEYS)


_confusion("met_confusion")
_confusion("agg_confusion")


@query("cal_join_rounds", "doc_id:i in_manifest:b in_labels:b in_audit:b same_content:b complete:b",
       """select doc_id, m is not null as in_manifest, l is not null as in_labels, a is not null as in_audit, coalesce(m = a, false) as same_content,
            m is not null and l is not null and a is not null and coalesce(m = a, false) as complete
          from (select doc_id, sha256(text) as m from documents) full join (select distinct doc_id, 1 as l from labels) using (doc_id)
          full join (select item_id * 3 as doc_id, sha256(text) as a from benchmark) using (doc_id)""")
def _(m: Market) -> DataFrame:
    """Manifest, labels and audit by sample: who lacks a sample, and whose content differs; no side is filtered.

    The benchmark stands for the audit, its ids tripled, so that some have no document.
    """
    manifest = m.table("documents").select("doc_id", F.sha2("text", 256).alias("m"))
    labels = m.table("labels").select("doc_id", F.lit(True).alias("l")).distinct()
    audit = m.table("benchmark").select((F.col("item_id") * 3).alias("doc_id"), F.sha2("text", 256).alias("a"))
    joined = manifest.join(labels, "doc_id", "full_outer").join(audit, "doc_id", "full_outer")
    there = {f"in_{n}": F.col(c).isNotNull() for n, c in (("manifest", "m"), ("labels", "l"), ("audit", "a"))}
    same = F.coalesce(F.col("m") == F.col("a"), F.lit(False))
    return joined.withColumns({**there, "same_content": same}).withColumn(
        "complete", F.col("in_manifest") & F.col("in_labels") & F.col("in_audit") & F.col("same_content")
    )


_STORED_FAULTS = {4: ("return_20", "+ 0.01e0"), 5: ("volatility_20", "* 1.5e0"), 6: ("ma_alignment", None)}


@query("cal_recompute_facts", "entity:i field:s stored:f recomputed:f same_content:b",
       " union all ".join(
           f"""select entity, '{name}' as field, {f"{name} {change}" if change else "null"} as stored, {name} as recomputed, true as same_content from facts
               where entity % 13 = {place} and {f"abs(({name} {change}) - {name}) > 1e-9" if change else f"{name} is not null"}""" for place, (name, change) in _STORED_FAULTS.items())
       + " union all select entity, 'content', null, null, false from facts where entity % 13 = 7")
def _(m: Market) -> DataFrame:
    """Samples as they were stored, facts and content hash beside the bars, against what their own bars give now.

    A rule has planted faults: three facts changed or lost, and bars that are no longer those of the manifest.
    """
    place, arrays = F.col("entity") % 13, ["c", "h", "l", "v"]
    content = F.sha2(F.to_json(F.struct(*arrays)), 256)
    kept = shape.facts(m).withColumn("content", F.when(place == 7, F.sha2(content, 256)).otherwise(content))
    names = [f for f in kept.columns if f not in ("entity", "bar_date", "content", *arrays) and kept.schema[f].dataType.typeName() == "double"]
    for at, (name, change) in _STORED_FAULTS.items():
        kept = kept.withColumn(name, F.when(place == at, F.expr(f"{name} {change}") if change else F.lit(None)).otherwise(F.col(name)))
    stored = stage(kept.select("entity", "bar_date", "content", *arrays, *[F.col(n).alias(f"stored_{n}") for n in names]))
    again = X.shared_facts(stored.select("entity", "bar_date", *arrays)).select("entity", *names)
    both = stored.join(again, "entity").withColumn("same_content", F.col("content") == content)
    fields = F.array(*[F.struct(F.lit(n).alias("field"), F.col(f"stored_{n}").alias("stored"), F.col(n).alias("recomputed")) for n in names])
    differs = F.filter(
        fields, lambda f: (f["stored"].isNull() & f["recomputed"].isNotNull()) | (F.abs(f["stored"] - f["recomputed"]) > 1e-9)
    )
    changed = F.when(~F.col("same_content"), F.array(F.struct(F.lit("content").alias("field"), F.lit(None).cast("double").alias("stored"), F.lit(None).cast("double").alias("recomputed"))))
    found = F.concat(differs, F.coalesce(changed, F.array().cast("array<struct<field:string,stored:double,recomputed:double>>")))
    return both.select("entity", "same_content", F.explode(found).alias("f")).select("entity", "same_content", "f.*")


@query("cal_round_disjoint", "o_custkey:i rounds:i",
       "select o_custkey, count(distinct year(o_orderdate) % 3) as rounds from orders group by 1 having count(distinct year(o_orderdate) % 3) > 1")
def _(m: Market) -> DataFrame:
    seen = m.table("orders").select("o_custkey", (F.year("o_orderdate") % 3).alias("round")).distinct()
    return seen.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("rounds")).where(F.col("rounds") > 1)


@query("spl_hash_split", "entity:i split:s",
       f"select c_custkey as entity, case when p < 0.5 then 'template' when p < 0.75 then 'tuning' else 'final_evaluation' end as split from (select c_custkey, {_HEX.format('cast(c_custkey as varchar)')} / 4503599627370496.0e0 as p from customer)")
def _(m: Market) -> DataFrame:
    keys = m.table("customer").select(F.col("c_custkey").alias("entity"))
    return keys.withColumn("split", Z.hash_split(F.col("entity").cast("string")))


@query("spl_grouped", "entity:i split:s",
       f"""with h as (select c_custkey as entity, row_number() over (order by {_HEX.format('cast(c_custkey as varchar)')}, c_custkey) as pos, count(*) over () as n from customer),
          s as (select *, floor(n * 0.5e0) as a, floor(n * 0.25e0) as b, n * 0.5e0 - floor(n * 0.5e0) as ra, n * 0.25e0 - floor(n * 0.25e0) as rb from h),
          z as (select *, n - a - b - b as lft from s),
          k as (select *, a + case when (case when rb > ra then 2 else 0 end) < lft then 1 else 0 end as na, b + case when (case when ra >= rb then 1 else 0 end) < lft then 1 else 0 end as nb from z)
          select entity, case when pos <= na then 'template' when pos <= na + nb then 'tuning' else 'final_evaluation' end as split from k""")
def _(m: Market) -> DataFrame:
    keys = m.table("customer").select(F.lit(1).alias("one"), F.col("c_custkey").alias("entity"))
    hashed = keys.withColumn("h", Z.hash_position(F.col("entity").cast("string")))
    return Z.grouped_split(order_positions(hashed, ["one"], "h", ["entity"], descending=False), "rank", "n_group")


SECRET = b"tapeloom-demo-secret"


def _hmac_sql(message: str) -> str:
    pads = ["".join(f"{b ^ pad:02x}" for b in SECRET.ljust(64, b"\0")) for pad in (0x5C, 0x36)]
    return f"upper(sha256(unhex('{pads[0]}') || unhex(sha256(unhex('{pads[1]}') || encode({message})))))"


@query("anon_id", "entity:i sample_id:s group_id:s",
       f"""select entity, 'S-' || substr({_hmac_sql("'v1|' || entity || '|' || strftime(bar_date, '%Y%m%d')")}, 1, 12) as sample_id,
          'G-' || substr({_hmac_sql("'group|' || entity")}, 1, 16) as group_id from bars0""")
def _(m: Market) -> DataFrame:
    code = F.col("entity").cast("string")
    day = F.date_format("bar_date", "yyyyMMdd")
    return m.bars0.select(
        "entity", Z.anonymous_id(SECRET, "v1", code, day).alias("sample_id"), Z.group_id(SECRET, code).alias("group_id")
    )


@query("fp_content", "entity:i bar_date:d fingerprint:s")
def _(m: Market) -> DataFrame:
    return m.bars0.withColumn("fingerprint", Z.fingerprint(["entity", "bar_date", "open", "high", "low", "close"]))


@query("smp_dates", "entity:i bar_date:d",
       f"""with p as (select bar_date, row_number() over (order by bar_date) - 1 as k from (select bar_date from cal where ord >= 150 and bar_date <= (select d from dayref))), n as (select count(*) as n from p),
          e as (select entity, {_HEX.format("'pick|' || cast(entity as varchar)")} % (select n from n) as k from securities) select entity, bar_date from e join p using (k)""")
def _(m: Market) -> DataFrame:
    dates = m.cal.where((F.col("ord") >= 150) & (F.col("bar_date") <= m.as_of))
    # The date pool is one array bounded by the calendar; each security indexes into it.
    picked = m.securities.select("entity").withColumn("pool", dates.agg(F.array_sort(F.collect_list("bar_date"))).scalar())
    text = F.concat(F.lit("pick|"), F.col("entity").cast("string"))
    number = F.conv(F.substring(F.sha2(text, 256), 1, 13), 16, 10).cast("bigint")
    return picked.select("entity", F.get("pool", F.pmod(number, F.size("pool")).cast("int")).alias("bar_date"))


QUOTA_SETS = {"profiles": S.QUOTAS, "stages": S.STAGE_QUOTAS}


def _quota_sql() -> str:
    """A step for each profile: best sample of every group not yet used, highest score first, then the smaller hash."""
    steps, parts = [], []
    for name, quotas in QUOTA_SETS.items():
        used: list[str] = []
        for i, (profile, quota) in enumerate(quotas.items()):
            left = "".join(f" and grp not in (select grp from {u})" for u in used)
            step = f"{name}_{i}"
            steps.append(f"""{step} as (select profile, entity, grp, profile_score from (select *, row_number() over (partition by grp order by profile_score desc, h) as k
              from pool where profile = '{profile}'{left}) where k = 1 order by profile_score desc, h limit {quota})""")
            used.append(step)
            parts.append(f"select '{name}' as quota_set, * from {step}")
    rows = " union all ".join(
        f"select entity, entity % 60 as grp, sha256(cast(entity as varchar)) as h, '{n}' as profile, round_even(({profile_sql(S.PROFILES[n])}) * 1e8, 0) / 1e8 as profile_score from facts"
        for quotas in QUOTA_SETS.values() for n in quotas
    )
    return f"with pool as materialized ({rows}), {', '.join(steps)} {' union all '.join(parts)}"


@query("top_quota_greedy", "quota_set:s profile:s entity:i grp:i profile_score:f", _quota_sql())
def _(m: Market) -> DataFrame:
    scored = stage(S.profile_scores(shape.facts(m), ["entity"]).withColumns({
        "grp": F.col("entity") % 60, "profile_score": round_even("profile_score", 8),
    }))
    parts = [fill_quotas(scored, quotas).withColumn("quota_set", F.lit(name)) for name, quotas in QUOTA_SETS.items()]
    return parts[0].unionByName(parts[1])
