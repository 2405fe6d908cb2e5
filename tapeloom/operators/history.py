"""Append-only history of screen runs: three linked tables published as one.

``runs`` holds one manifest a run, ``evaluations`` a row for every eligible security whatever its status,
``results`` the ranked list.  A run's rows are written under an attempt of their own and its manifest last,
in one file, so readers, who follow manifests, see a whole run or nothing of it.  Appending a published run
again changes nothing; what a lost attempt left behind is never read.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Sequence
from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tapeloom.functions.ranking import top_k

_MATCHES = "array<struct<category:string,score:double>>"
SCHEMAS = {
    "runs": "run string, attempt string, seq bigint, snapshot date, filters string, filter_key string, saved boolean, "
    "rule_version string, evaluated bigint, result_count bigint, counts array<struct<category:string,n:bigint>>, warnings array<string>",
    "evaluations": f"entity bigint, status string, matches {_MATCHES}, bar_date date, history_bars int, warning string, "
    "run string, attempt string",
    "results": "entity bigint, category string, score double, rank int, category_rank int, run string, attempt string",
}


@dataclass(frozen=True)
class Filters:
    """What a screen selects; equal selections have equal canonical text, however they were spelt."""

    boards: tuple[str, ...] = ("main", "star")
    min_cap: float | None = 50
    exclude_flagged: bool = True
    top_k: int = 100

    def canonical(self) -> str:
        values = {f.name: getattr(self, f.name) for f in fields(self)}
        values["boards"] = sorted(set(self.boards))
        values["min_cap"] = None if self.min_cap is None else float(self.min_cap)
        return json.dumps(values, sort_keys=True, separators=(",", ":"))

    @property
    def key(self) -> str:
        return hashlib.sha256(self.canonical().encode()).hexdigest()


def create(spark: SparkSession, root: str) -> None:
    """Empty tables where there are none yet."""
    for table, schema in SCHEMAS.items():
        spark.createDataFrame([], schema).write.mode("ignore").parquet(f"{root}/{table}")


def _table(spark: SparkSession, root: str, table: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[table]).parquet(f"{root}/{table}")


def manifests(spark: SparkSession, root: str) -> DataFrame:
    """One row for each published run; if two writers published the same run, the first attempt by name counts."""
    first = Window.partitionBy("run").orderBy("attempt")
    rows = _table(spark, root, "runs").withColumn("_n", F.row_number().over(first))
    return rows.where(F.col("_n") == 1).drop("_n")


def published(spark: SparkSession, root: str, table: str) -> DataFrame:
    """Rows of ``evaluations`` or ``results`` of published runs, with what their manifest says of the run."""
    runs = manifests(spark, root).select("run", "attempt", "seq", "snapshot", "filters", "filter_key", "saved", "warnings")
    return _table(spark, root, table).join(runs, ["run", "attempt"])


def write_rows(spark: SparkSession, root: str, run: str, attempt: str, evaluations: DataFrame, keep: int) -> None:
    """The data of one attempt; nobody reads it before its manifest is there."""
    matches = F.transform("matches", lambda m: F.struct(m["category"].alias("category"), m["score"].cast("double").alias("score")))
    matches = F.coalesce(matches, F.array().cast(_MATCHES))
    rows = evaluations.select(
        F.col("entity").cast("bigint"), "status", matches.alias("matches"), "bar_date", F.col("history_bars").cast("int"), "warning",
        F.lit(run).alias("run"), F.lit(attempt).alias("attempt"),
    )
    rows.write.mode("append").partitionBy("run", "attempt").parquet(f"{root}/evaluations")
    own = _attempt(spark, root, run, attempt).where(F.col("status") == "matched")
    order = [F.col("score").desc(), F.col("entity")]
    each = own.select("entity", F.posexplode("matches").alias("place", "m")).select("entity", "place", "m.category", "m.score")
    per = top_k(each, ["category"], order, keep, "category_rank").select("entity", "category", "category_rank")
    best = F.reduce(
        "matches", F.get("matches", F.lit(0)), lambda a, m: F.when(m["score"] > a["score"], m).otherwise(a)
    )  # ties: the first category in order
    primary = own.select("entity", best.alias("m"), F.lit(run).alias("run")).select("entity", "m.category", "m.score", "run")
    combined = top_k(primary, ["run"], order, keep, "rank").join(per, ["entity", "category"], "left")
    combined.select("entity", "category", "score", "rank", "category_rank", "run", F.lit(attempt).alias("attempt")).write.mode(
        "append"
    ).partitionBy("run", "attempt").parquet(f"{root}/results")


def _attempt(spark: SparkSession, root: str, run: str, attempt: str, table: str = "evaluations") -> DataFrame:
    return _table(spark, root, table).where((F.col("run") == run) & (F.col("attempt") == attempt))


def append_run(
    spark: SparkSession, root: str, run: str, seq: int, snapshot: Column, filters: Filters, evaluations: DataFrame,
    categories: Sequence[str], saved: bool = True, rule_version: str = "1",
) -> bool:
    """Publish a run of (entity, status, matches, bar_date, history_bars, warning) rows; False if it already is.

    Counts are of all matches, not of the ranked list, and name every category.
    """
    create(spark, root)
    if not manifests(spark, root).where(F.col("run") == run).isEmpty():
        return False
    attempt = uuid.uuid4().hex
    write_rows(spark, root, run, attempt, evaluations, filters.top_k)
    rows = _attempt(spark, root, run, attempt)
    counts = [F.count_if(F.array_contains("matches.category", c)).alias(f"n_{c}") for c in categories]
    totals = rows.agg(F.count(F.lit(1)).alias("evaluated"), F.count_if(F.col("warning").isNotNull()).alias("warned"), *counts)
    listed = _attempt(spark, root, run, attempt, "results").agg(F.count(F.lit(1)).alias("n")).scalar()
    note = F.when(F.col("warned") > 0, F.format_string("%d securities without enough history", "warned"))
    manifest = totals.select(
        F.lit(run).alias("run"), F.lit(attempt).alias("attempt"), F.lit(seq).cast("bigint").alias("seq"), snapshot.alias("snapshot"),
        F.lit(filters.canonical()).alias("filters"), F.lit(filters.key).alias("filter_key"), F.lit(saved).alias("saved"),
        F.lit(rule_version).alias("rule_version"), "evaluated", listed.alias("result_count"),
        F.array(*[F.struct(F.lit(c).alias("category"), F.col(f"n_{c}").alias("n")) for c in categories]).alias("counts"),
        F.array_compact(F.array(note)).alias("warnings"),
    )
    manifest.coalesce(1).write.mode("append").parquet(f"{root}/runs")
    return True


def with_previous(runs: DataFrame) -> DataFrame:
    """Each run with ``previous``: run, snapshot and counts of the latest saved run of an earlier date with the same filters."""
    day = F.datediff("snapshot", F.lit("1970-01-01").cast("date"))
    earlier = Window.partitionBy("filter_key").orderBy(day).rangeBetween(Window.unboundedPreceding, -1)
    row = F.when(F.col("saved"), F.struct("snapshot", "seq", "run", "counts"))
    return runs.withColumn("previous", F.max(row).over(earlier))


def category_changes(runs: DataFrame) -> DataFrame:
    """run, category, n, and the count of the previous comparable run (null where there is none)."""
    pairs = with_previous(runs).select("run", "snapshot", "saved", "previous", F.explode("counts").alias("c"))
    before = F.get(F.filter("previous.counts", lambda p: p["category"] == F.col("c.category")), F.lit(0))["n"]
    return pairs.select(
        "run", "snapshot", "saved", "c.category", "c.n", F.col("previous.run").alias("previous_run"),
        F.col("previous.snapshot").alias("previous_snapshot"), before.alias("previous"), (F.col("c.n") - before).alias("change"),
    )


STATES = {"not_calculated": "not_calculated", "no_match": "calculated_no_match", "matched": "matched"}


def security_history(evaluations: DataFrame, keep: int | None = None) -> DataFrame:
    """Evaluations of saved runs, numbered from the newest for each security; ``keep`` bounds the list.

    ``state`` is what the newest one says of the security.
    """
    newest = Window.partitionBy("entity").orderBy(F.col("snapshot").desc(), F.col("seq").desc(), F.col("run"))
    saved = evaluations.where("saved").withColumn("nth", F.row_number().over(newest))
    state = F.create_map(*[F.lit(x) for pair in STATES.items() for x in pair])
    out = saved.withColumn("state", F.first(state[F.col("status")]).over(newest))
    return out if keep is None else out.where(F.col("nth") <= keep)
