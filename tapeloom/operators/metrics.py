"""Ranking metrics of rated items: (category, sample_id, rating 0..3, score)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.functions.ranking import order_positions, top_k
from tapeloom.functions.scalars import flag
from tapeloom.sources.staging import stage


def ranked_items(items: DataFrame) -> DataFrame:
    """Items with their exact rank in the category (score descending, then id) and the category size."""
    return order_positions(items, ["category"], "score", ["sample_id"])


def ndcg(ranked: DataFrame) -> DataFrame:
    """Discounted gain over its ideal, per category.

    Ratings take four values, so the ideal order is known from three counts: the
    ideal gain of a position needs no second sort.
    """
    counts = ranked.groupBy("category").agg(*[F.count_if(F.col("rating") >= r).alias(f"at{r}") for r in (3, 2, 1)])
    pos = F.col("rank")
    ideal = F.when(pos <= F.col("at3"), 7).when(pos <= F.col("at2"), 3).when(pos <= F.col("at1"), 1).otherwise(0)
    discount = F.log2(pos + 1)
    gain = F.pow(F.lit(2.0), F.col("rating")) - 1
    sums = ranked.join(counts, "category").groupBy("category").agg(
        F.sum(gain / discount).alias("dcg"), F.sum(ideal / discount).alias("idcg")
    )
    return sums.withColumn("ndcg", F.coalesce(F.try_divide("dcg", "idcg"), F.lit(0.0)))


def purity(items: DataFrame, ks: tuple[int, ...]) -> DataFrame:
    """Share of good and of bad ratings in the first k items of a category, for each k (all items, if fewer)."""
    best = top_k(items, ["category"], [F.col("score").desc(), F.col("sample_id")], max(ks))
    sizes = F.filter(F.array(*[F.lit(k) for k in ks]), lambda k: F.col("rank") <= k)
    return best.withColumn("top_k", F.explode(sizes)).groupBy("category", "top_k").agg(
        F.count(F.lit(1)).alias("n"), F.avg(flag(F.col("rating") >= 2)).alias("purity"), F.avg(flag(F.col("rating") == 0)).alias("severe")
    )


def stratum(rank: Column, n: Column, parts: int = 4) -> Column:
    """Part 1..parts of a rank when n items are cut into near-equal parts, larger ones first."""
    base, extra = F.floor(n / parts), n % parts
    wide = extra * (base + 1)
    inside = F.when(rank <= wide, F.floor((rank - 1) / (base + 1))).otherwise(
        extra + F.floor(F.coalesce(F.try_divide(rank - 1 - wide, base), F.lit(0)))
    )
    return (inside + 1).cast("int")


def strata(ranked: DataFrame) -> DataFrame:
    cut = ranked.withColumn("stratum", stratum(F.col("rank"), F.col("n_group")))
    return cut.groupBy("category", "stratum").agg(
        F.count(F.lit(1)).alias("n"), F.min("score").alias("score_min"), F.max("score").alias("score_max"), F.avg("rating").alias("mean_rating")
    )


def confusion(rows: DataFrame, categories: tuple[str, ...]) -> DataFrame:
    """Dominant human class against the highest-scored class; rows with a human tie are left out."""
    pick = F.struct(F.col("score"), -F.array_position(F.array(*[F.lit(c) for c in categories]), F.col("category")), F.col("category"))
    per = rows.groupBy("entity").agg(
        F.max("rating").alias("top"), F.collect_list(F.struct("rating", "category")).alias("all"), F.max(pick).alias("p")
    )
    winners = F.filter("all", lambda x: x["rating"] == F.col("top"))
    clear = per.withColumn("w", winners).where(F.size("w") == 1)
    return clear.groupBy(F.col("w")[0]["category"].alias("human"), F.col("p.category").alias("predicted")).agg(F.count(F.lit(1)).alias("n"))
