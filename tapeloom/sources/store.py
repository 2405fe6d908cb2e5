"""Date-partitioned Parquet tables, JSON / CSV documents and their readers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

PARTITION = "date"


def write_partitioned(df: DataFrame, path: str) -> None:
    """Write under date=YYYYMMDD folders; refuses to overwrite.

    The rebalance hint lets adaptive execution split a heavy date over several
    files and merge light ones, instead of one task per date.
    """
    keyed = df.withColumn(PARTITION, F.date_format("bar_date", "yyyyMMdd")).drop("bar_date")
    keyed.hint("rebalance", PARTITION).write.mode("errorifexists").partitionBy(PARTITION).parquet(path)


def read_partitioned(spark: SparkSession, path: str, schema: str, merge: bool = False) -> DataFrame:
    """Read with a declared schema; ``merge`` tolerates files with differing columns."""
    declared = T.StructType.fromDDL(f"{schema}, {PARTITION} string")
    reader = spark.read if not merge else spark.read.option("mergeSchema", "true")
    df = reader.schema(declared).parquet(path)
    return df.withColumn("bar_date", F.to_date(PARTITION, "yyyyMMdd"))


def between(df: DataFrame, start: str, end: str) -> DataFrame:
    """Partition-pruned range: the filter is on the partition column itself."""
    return df.where(F.col(PARTITION).between(start, end))


def latest_partition(df: DataFrame) -> Column:
    """Newest partition of a table as a scalar subquery (reads partition values only)."""
    return df.select(PARTITION).agg(F.max(PARTITION)).scalar()


def snapshot(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.where(F.col(PARTITION) == latest_partition(df)).select(*columns)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").option("header", True).csv(path)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)


def write_nested_json(df: DataFrame, path: str, key: str) -> None:
    df.write.mode("errorifexists").partitionBy(key).json(path)


REGISTRY_SCHEMA = (
    "schema_version int, algorithm string, templates array<struct<key:string,label:string,"
    "source_code:string,start_date:string,end_date:string,window_bars:int>>"
)
# Fixed value: the algorithm id a registry or ranking document must carry.
ALGORITHM = "qfq_log_close_independent_z_single_window_pearson"


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    doc = spark.read.schema(REGISTRY_SCHEMA).json(path)
    return doc.select("algorithm", F.explode("templates").alias("t")).select("algorithm", "t.*")


def registry_findings(registry: DataFrame) -> DataFrame:
    """One row per rule: (check_name, n_bad)."""
    digits = r"^\d{8}$"
    dates = F.col("start_date").rlike(digits) & F.col("end_date").rlike(digits)
    agg = registry.agg(
        F.count_if(F.col("algorithm") != ALGORITHM).alias("algorithm"),
        (F.count("key") - F.count_distinct("key")).alias("unique_key"),
        F.count_if(~dates).alias("date_format"),
        F.count_if(F.col("start_date") > F.col("end_date")).alias("date_order"),
        F.count_if(F.col("window_bars") < 2).alias("window_bars"),
        F.when(F.count(F.lit(1)) == 0, 1).otherwise(0).cast("bigint").alias("not_empty"),
    )
    return unpivot_checks(agg)


def registry_windows(registry: DataFrame, bars: DataFrame) -> DataFrame:
    """One row per rule of the source windows: (check_name, n_bad) counts of templates.

    A window must start and end on bars of its security, hold exactly as many bars as it says, each date
    once, and only sound prices.
    """
    day = F.date_format("bar_date", "yyyyMMdd")
    own = bars.select(F.col("source_code").alias("_code"), day.alias("_day"), "open", "high", "low", "close")
    inside = registry.join(own, (F.col("source_code") == F.col("_code")) & F.col("_day").between(F.col("start_date"), F.col("end_date")), "left")
    prices = [F.col(c) for c in ("open", "high", "low", "close")]
    sound = (F.col("low") > 0) & (F.least(*prices) >= F.col("low")) & (F.greatest(*prices) <= F.col("high"))
    per = inside.groupBy("key", "start_date", "end_date", "window_bars").agg(
        F.count("_day").alias("n"), F.count_distinct("_day").alias("days"), F.min("_day").alias("first"), F.max("_day").alias("last"),
        F.count_if(F.col("_day").isNotNull() & ~F.coalesce(sound, F.lit(False))).alias("unsound"),
    )
    return unpivot_checks(per.agg(
        F.count_if(F.col("n") == 0).alias("window_exists"),
        F.count_if((F.col("n") > 0) & ((F.col("first") != F.col("start_date")) | (F.col("last") != F.col("end_date")))).alias("window_ends"),
        F.count_if((F.col("n") > 0) & (F.col("n") != F.col("window_bars"))).alias("window_length"),
        F.count_if(F.col("n") != F.col("days")).alias("repeated_dates"), F.count_if(F.col("unsound") > 0).alias("prices"),
    ))


def unpivot_checks(one_row: DataFrame) -> DataFrame:
    """Turn a one-row frame of bad-row counts into (check_name, passed, n_bad)."""
    pairs = F.array(*[
        F.struct(F.lit(c).alias("check_name"), F.coalesce(F.col(c).cast("bigint"), F.lit(0)).alias("n_bad"))
        for c in one_row.columns
    ])
    rows = one_row.select(F.explode(pairs).alias("r")).select("r.*")
    return rows.withColumn("passed", F.col("n_bad") == 0)


RANKING_SCHEMA = (
    "template_id string, algorithm string, as_of string, items array<struct<rank:int,entity:bigint,"
    "score:double,end_date:string,window_bars:int>>"
)


def read_rankings(spark: SparkSession, path: str, as_of: Column, expected: int) -> DataFrame:
    """Precomputed rankings; a document is accepted only when every rule holds.

    Rules: algorithm, as-of date, `expected` items, ranks 1..n in sequence,
    distinct securities, scores in [-1, 1] that never rise with rank.
    """
    docs = spark.read.schema(RANKING_SCHEMA).json(path)
    items = F.array_sort("items")
    ranks, scores = F.transform("sorted", lambda i: i["rank"]), F.transform("sorted", lambda i: i["score"])
    falling = F.forall(
        F.sequence(F.lit(1), F.size("sorted") - 1),
        lambda i: F.element_at(scores, i) >= F.element_at(scores, i + 1),
    )
    ok = (
        (F.col("algorithm") == ALGORITHM)
        & (F.col("as_of") == as_of)
        & (F.size("items") == expected)
        & (ranks == F.sequence(F.lit(1), F.lit(expected)))
        & (F.size(F.array_distinct(F.transform("sorted", lambda i: i["entity"]))) == expected)
        & F.forall(scores, lambda s: F.abs(s) <= 1)
        & F.when(F.lit(expected) > 1, falling).otherwise(True)
    )
    accepted = docs.withColumn("sorted", items).where(ok)
    return accepted.select("template_id", F.explode("sorted").alias("i")).select("template_id", "i.*")
