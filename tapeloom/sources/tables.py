"""Adapters that give every operator real input from the star-schema tables.

One supplier is one security; its sales lines form weekly bars.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tapeloom.operators import bars as B
from tapeloom.operators import calendar as C
from tapeloom.sources.staging import stage

# Fixed values of the four registered template windows: source security -> bars.
TEMPLATE_BARS = {1: 50, 2: 80, 3: 55, 4: 80}
TEMPLATE_START = 20
TASK_ROWS, MIN_TASK_ROWS = 1 << 18, 1 << 13  # bars of a task that works by security


class Market:
    """Lazily built frames over one folder of driver tables."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark = spark
        self.folder = folder
        self._shared: dict[str, DataFrame] = {}

    def once(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        """A frame that several parts of a query share, built at its first use."""
        if name not in self._shared:
            self._shared[name] = build()
        return self._shared[name]

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def bars0(self) -> DataFrame:
        """The bar table, written once per market.

        Bars, calendar, flags, factors, templates and the as-of date all come
        from it, so a query would otherwise repeat this aggregate several times.
        """
        return stage(self.aggregate_lines())

    def aggregate_lines(self) -> DataFrame:
        """One row per security and week.

        The lines go to tasks by security and week, so a hot security is spread over its weeks, and are sorted once;
        partial aggregates would leave more than half of them, each with two keys of its own to sort by.
        """
        order = F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
        week = F.next_day(F.date_sub(F.col("l_shipdate").cast("date"), 1), "FRI")
        lines = self.table("lineitem").select(
            F.col("l_suppkey").alias("entity"), week.alias("bar_date"),
            "l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity",
        )
        price = F.col("l_extendedprice") / F.col("l_quantity")
        return (
            lines.repartition("entity", "bar_date")
            .groupBy("entity", "bar_date")
            .agg(
                F.min_by(price, order).alias("open"),
                F.max(price).alias("high"),
                F.min(price).alias("low"),
                F.max_by(price, order).alias("close"),
                F.sum("l_quantity").alias("volume"),
                F.sum("l_extendedprice").alias("amount"),
            )
        )

    @cached_property
    def bars_by_security(self) -> DataFrame:
        """``bars0`` in tasks of at most about ``TASK_ROWS`` rows, a security in one of them.

        The number of tasks is fixed by the rows: partitions that are merged by their compressed size grow with the table.
        """
        rows = self.bars0.count()
        parts = max(-(-rows // TASK_ROWS), min(self.spark.sparkContext.defaultParallelism, -(-rows // MIN_TASK_ROWS)), 1)
        return self.bars0.repartition(parts, "entity")

    @cached_property
    def bars(self) -> DataFrame:
        return self.bars_by_security.withColumn("pos", F.row_number().over(B.by_entity())).withColumn(
            "n_bars", F.count(F.lit(1)).over(Window.partitionBy("entity"))
        )

    @cached_property
    def cal(self) -> DataFrame:
        return C.trading_calendar(self.bars0)

    @cached_property
    def as_of(self) -> Column:
        """Second-newest date (the newest week is partial), as a scalar subquery."""
        return C.nth_newest(self.cal, 1)

    @cached_property
    def factors(self) -> DataFrame:
        gap = (F.col("pos") % 17 == 0) & (F.col("pos") < F.col("n_bars"))
        step = F.lit(1.0) + F.lit(0.1) * F.floor(F.col("pos") / F.lit(50.0))
        return self.bars.select("entity", "bar_date", F.when(~gap, step).alias("adj_factor"))

    @cached_property
    def bars_with_factor(self) -> DataFrame:
        return B.attach_factors(self.bars, self.factors)

    @cached_property
    def bars_in_place(self) -> DataFrame:
        """``bars_with_factor`` without the join: the factor is a function of the bar."""
        gap = (F.col("pos") % 17 == 0) & (F.col("pos") < F.col("n_bars"))
        step = F.lit(1.0) + F.lit(0.1) * F.floor(F.col("pos") / F.lit(50.0))
        return self.bars.withColumn("adj_factor", F.when(~gap, step))

    @cached_property
    def qfq(self) -> DataFrame:
        """Bars adjusted with the batch policy over the whole history."""
        return B.adjust_prices(self.bars_in_place, "batch_qfq")

    @cached_property
    def qfq_now(self) -> DataFrame:
        """Bars adjusted with what is known at the as-of date: later bars go before factors are filled."""
        return B.adjust_as_of(self.bars_in_place, self.as_of)

    @cached_property
    def securities(self) -> DataFrame:
        key = F.col("s_suppkey")
        return self.table("supplier").select(
            key.alias("entity"),
            F.col("s_name").alias("name"),
            F.when(key % 3 == 0, "main").when(key % 3 == 1, "growth").otherwise("star").alias("board"),
            F.date_add(F.lit("1995-01-06").cast("date"), ((key % 5) * 30).cast("int")).alias("list_date"),
            F.when(key % 10 == 9, F.lit("2000-12-29").cast("date")).alias("delist_date"),
        )

    @cached_property
    def membership(self) -> DataFrame:
        nation = self.table("nation")
        supplier = self.table("supplier")
        switch = F.lit("1998-06-26").cast("date")
        first = supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(
            F.col("s_suppkey").alias("entity"),
            F.col("n_nationkey").alias("industry_code"),
            F.col("n_name").alias("industry"),
            F.lit("1995-01-01").cast("date").alias("in_date"),
            F.when(F.col("s_suppkey") % 4 == 0, switch).alias("out_date"),
        )
        second = (
            supplier.where(F.col("s_suppkey") % 4 == 0)
            .join(nation, (F.col("s_nationkey") + 7) % 25 == F.col("n_nationkey"))
            .select(
                F.col("s_suppkey").alias("entity"),
                F.col("n_nationkey").alias("industry_code"),
                F.col("n_name").alias("industry"),
                switch.alias("in_date"),
                F.lit(None).cast("date").alias("out_date"),
            )
        )
        return first.unionByName(second)

    @cached_property
    def flags(self) -> DataFrame:
        dated = C.with_ordinal(self.bars0.select("entity", "bar_date"), self.cal)
        return dated.where((F.col("entity") * 7 + F.col("ord")) % 40 == 0).select("entity", "bar_date")

    @cached_property
    def valuation(self) -> DataFrame:
        """Total order value per customer and month, standing in for market value."""
        return (
            self.table("orders")
            .groupBy(
                F.col("o_custkey").alias("entity"),
                F.last_day(F.col("o_orderdate").cast("date")).alias("bar_date"),
            )
            .agg(F.sum("o_totalprice").alias("total_mv"))
        )

    @cached_property
    def caps(self) -> DataFrame:
        """Traded amount of each security and date in thousands, the size of a security."""
        return self.bars0.select("entity", "bar_date", (F.col("amount") / 1000.0).alias("total_mv"))
