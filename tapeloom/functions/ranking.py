"""Exact ranks and quantiles of large groups without one-task windows.

A cross-section (all securities of one date) grows with the universe, so a
window partitioned by date alone would put a whole cross-section into one
task.  A group of at most ``RANGE_ROWS`` rows is one window.  Larger ones are
split first, into a number of ranges that follows the rows of the largest:

1. distinct values per group are counted (map-side combined),
2. a mergeable quantile sketch gives each group its own range limits; the
   limits only steer the split, they never influence a result,
3. a value that is itself a limit has a range of its own, which may be split
   further by the column that orders equal values,
4. range totals are accumulated, and the exact position inside a range is a
   window over (group, range).

Results are exact for any distribution; ties collapse in step 1, or are dealt
over as many tasks as they need in step 3.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.sources.staging import stage

RANGE_ROWS = 1 << 16  # rows of a window
BINNED_ROWS, BINS = 1 << 12, 256  # rows from which a group's quantiles are found in bins, and their number


def _ranges(staged: DataFrame, keys: list[str]) -> int:
    """How many ranges the largest group of a written table needs."""
    most = staged.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0
    return -(-most // RANGE_ROWS)


def _limits(df: DataFrame, keys: list[str], value: str | Column, ranges: int, out: str) -> DataFrame:
    """Range limits of each group, written first, so that their true size is known when the join is planned:
    small limits are broadcast and the large side is not shuffled by the (few) group keys."""
    steps = F.array(*[F.lit(i / ranges) for i in range(1, max(ranges, 2))])
    return stage(df.groupBy(*keys).agg(F.array_distinct(F.percentile_approx(value, steps, F.lit(max(1000, 4 * ranges)))).alias(out)))


def _with_range(df: DataFrame, keys: list[str], value: str, ranges: int) -> DataFrame:
    """``_range`` ascends with the value; odd ones hold a single value, which is a limit."""
    below = F.size(F.filter("_limits", lambda x: x < F.col(value)))
    at = F.coalesce(F.array_contains("_limits", F.col(value)), F.lit(False)).cast("int")
    return df.join(_limits(df, keys, value, ranges, "_limits"), keys).withColumn("_range", below * 2 + at).drop("_limits")


def _order_number(df: DataFrame, column: str) -> Column:
    """A number that never falls when the column rises: itself, or the first six bytes of a text."""
    kind = df.schema[column].dataType.typeName()
    if kind == "string":
        return F.conv(F.rpad(F.hex(F.substring(F.encode(column, "utf-8"), 1, 6)), 12, "0"), 16, 10).cast("bigint")
    return F.datediff(column, F.lit("1970-01-01").cast("date")) if kind == "date" else F.col(column)


def _with_part(ranged: DataFrame, keys: list[str], tie: str) -> DataFrame:
    """``_part`` splits ranges of a single value that are too large for a window, ascending with the tie column."""
    counts = ranged.where(F.col("_range") % 2 == 1).groupBy(*keys, "_range").agg(F.count(F.lit(1)).alias("_n"))
    heavy = stage(counts.where(F.col("_n") > RANGE_ROWS))
    most = heavy.agg(F.max("_n")).first()[0]
    if not most:
        return ranged.withColumn("_part", F.lit(0))
    number = _order_number(ranged, tie)
    tied = ranged.join(heavy.drop("_n"), [*keys, "_range"], "left_semi")
    limits = _limits(tied, [*keys, "_range"], number, -(-most // RANGE_ROWS), "_ties")
    part = F.size(F.filter(F.coalesce("_ties", F.array().cast("array<bigint>")), lambda x: x < number))
    return ranged.join(limits, [*keys, "_range"], "left").withColumn("_part", part).drop("_ties")


def running_totals(staged: DataFrame, keys: list[str], value: str, measures: list[str]) -> DataFrame:
    """For each row of distinct (keys, value) of a written table: below_<m> and total_<m> of every measure."""
    ranges = _ranges(staged, keys)
    whole = Window.partitionBy(*keys)
    if ranges <= 1:
        before = whole.orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
        return staged.withColumns({
            **{f"below_{m}": F.coalesce(F.sum(m).over(before), F.lit(0)) for m in measures}, **{f"total_{m}": F.sum(m).over(whole) for m in measures},
        })
    ranged = _with_range(staged, keys, value, ranges)
    by_range = Window.partitionBy(*keys).orderBy("_range")
    offsets = ranged.groupBy(*keys, "_range").agg(*[F.sum(m).alias(f"_{m}") for m in measures])
    for m in measures:
        offsets = offsets.withColumn(f"_off_{m}", F.sum(f"_{m}").over(by_range) - F.col(f"_{m}"))
        offsets = offsets.withColumn(f"total_{m}", F.sum(f"_{m}").over(whole))
    inside = Window.partitionBy(*keys, "_range").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    out = ranged.join(offsets, [*keys, "_range"])
    for m in measures:
        out = out.withColumn(
            f"below_{m}", F.col(f"_off_{m}") + F.sum(m).over(inside) - F.col(m)
        )
    return out.drop("_range", *[f"_{m}" for m in measures], *[f"_off_{m}" for m in measures])


def value_positions(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, value, n_below, n_equal, n_total) for every distinct value of a group."""
    counts = stage(
        df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n_equal"))
    )
    totals = running_totals(counts, keys, value, ["n_equal"])
    return totals.select(
        *keys, value, F.col("below_n_equal").alias("n_below"), "n_equal",
        F.col("total_n_equal").alias("n_total"),
    )


def average_rank_share(df: DataFrame, keys: list[str], value: str, out: str, staged: bool = False) -> DataFrame:
    """Rank share with ties averaged, ascending, in (0, 1]; null values get null.

    Rows of one window, or of one range of values, lie together and count each other, so nothing is joined back to
    the rows; a range of a single value needs its total only.  ``staged`` says that ``df`` is a written table.
    """
    base = df if staged else stage(df)
    ranges = _ranges(base, keys)

    def share(below: Column, equal: Column, total: Column) -> Column:
        return F.when(F.col(value).isNotNull(), (below + (equal + 1) / F.lit(2.0)) / total)

    def counts(group: list) -> tuple[Column, Column]:
        return F.rank().over(Window.partitionBy(*group).orderBy(value)) - 1, F.count(F.lit(1)).over(Window.partitionBy(*group, value))

    if ranges <= 1:
        group = [*keys, F.col(value).isNull()]
        below, equal = counts(group)
        return base.withColumn(out, share(below, equal, F.count(F.lit(1)).over(Window.partitionBy(*group))))
    known = base.where(F.col(value).isNotNull())
    ranged = _with_range(known, keys, value, ranges)
    sizes = ranged.groupBy(*keys, "_range").agg(F.count(F.lit(1)).alias("_n")).withColumns({
        "_off": F.sum("_n").over(Window.partitionBy(*keys).orderBy("_range")) - F.col("_n"), "_all": F.sum("_n").over(Window.partitionBy(*keys)),
    })
    placed = ranged.join(stage(sizes), [*keys, "_range"])
    single = F.col("_range") % 2 == 1
    below, equal = counts([*keys, "_range"])
    mixed = placed.where(~single).withColumn(out, share(F.col("_off") + below, equal, F.col("_all")))
    whole = placed.where(single).withColumn(out, share(F.col("_off"), F.col("_n"), F.col("_all")))
    rest = base.where(F.col(value).isNull()).withColumn(out, F.lit(None).cast("double"))
    names = [*base.columns, out]
    return mixed.select(*names).unionByName(whole.select(*names)).unionByName(rest.select(*names))


def cumulative_share(df: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
    """Share of the group at or below the row's value."""
    pos = value_positions(df, keys, value).select(
        *keys, value, ((F.col("n_below") + F.col("n_equal")) / F.col("n_total")).alias(out)
    )
    return df.join(pos, [*keys, value], "left")


def prefix_share(df: DataFrame, keys: list[str], order: str, value: str, out: str) -> DataFrame:
    """Share of the rows up to and including each one, by ``order``, that are at or below its ``value``.

    ``order`` is unique within a group.  Two rows of a group lie in the two halves of exactly one time block
    whose length is a power of two, so a row's count is the sum over those blocks in whose second half it
    lies of the first-half rows at or below it: a running sum by value.  A group of n rows costs
    n log2(n) rows in one shuffle, and no row carries its past.
    """
    w = Window.partitionBy(*keys)
    placed = df.select(*keys, order, value, (F.row_number().over(w.orderBy(order)) - 1).alias("_at"), F.count(F.lit(1)).over(w).alias("_n"))
    levels = F.sequence(F.lit(1), F.length(F.bin(F.greatest(F.col("_n") - 1, F.lit(1)))))
    each = placed.withColumn("_level", F.explode(levels))
    half = F.call_function("shiftright", F.col("_at"), F.col("_level") - 1)
    each = each.withColumns({"_block": F.floor(half / 2), "_late": half % 2})
    below = Window.partitionBy(*keys, "_level", "_block").orderBy(value, "_late").rowsBetween(Window.unboundedPreceding, 0)
    counted = each.withColumn("_below", F.sum(1 - F.col("_late")).over(below))
    shares = counted.groupBy(*keys, order).agg(
        ((F.sum(F.when(F.col("_late") == 1, F.col("_below")).otherwise(0)) + 1) / (F.max("_at") + 1)).alias(out)
    )
    return df.join(shares, [*keys, order])


def exact_quantiles(
    df: DataFrame, keys: list[str], value: str, points: dict[str, float], staged: bool = False
) -> DataFrame:
    """Linear-interpolated quantiles per group, one column per named point.

    Groups of more than ``BINNED_ROWS`` rows are first counted in ``BINS`` bins of equal width, which shuffles counts
    only; the rows of the few bins that hold a wanted place are then ordered, by the same exact steps for any
    distribution.  ``staged`` says that ``df`` is a written table or cheap to read three times.
    """
    rows = df.select(*keys, value).where(F.col(value).isNotNull())
    rows = rows if staged else stage(rows)
    number = F.col(value).cast("double")
    spans = stage(rows.groupBy(*keys).agg(F.min(number).alias("_lo"), F.max(number).alias("_hi"), F.count(F.lit(1)).alias("_n")))
    if (spans.agg(F.max("_n")).first()[0] or 0) <= BINNED_ROWS:
        pos = value_positions(rows, keys, value)
    else:
        pos = _wanted_positions(rows, spans.drop("_n"), keys, value, list(points.values()))
    return pos.groupBy(*keys).agg(*[_order_statistic(value, p).alias(name) for name, p in points.items()])


def _wanted_positions(rows: DataFrame, spans: DataFrame, keys: list[str], value: str, points: list[float]) -> DataFrame:
    """``value_positions`` of the values in those bins that hold the places of ``points``."""
    same = [rows[k].eqNullSafe(spans[k]) for k in keys]
    width = F.col("_hi") - F.col("_lo")
    # never falls when the value rises; a group with a NaN or without a finite width is one bin
    place = F.floor((F.col(value).cast("double") - F.col("_lo")) / width * BINS)
    binned = F.when((width > 0) & (width < float("inf")), F.least(place, F.lit(BINS - 1))).otherwise(0).cast("int")
    placed = rows.join(spans, same).select(*[rows[k] for k in keys], value, binned.alias("_bin"))
    order = Window.partitionBy(*keys).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    counts = placed.groupBy(*keys, "_bin").agg(F.count(F.lit(1)).alias("_c")).withColumns({
        "_below": F.coalesce(F.sum("_c").over(order), F.lit(0)), "_total": F.sum("_c").over(Window.partitionBy(*keys)),
    })
    spots = [(F.col("_total") - 1) * F.lit(float(p)) for p in points]
    held = [(F.col("_below") <= k) & (k < F.col("_below") + F.col("_c")) for s in spots for k in (F.floor(s), F.ceil(s))]
    wanted = stage(counts.where(reduce(lambda x, y: x | y, held)).select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("_bin").alias("_b"), "_below", "_total"))

    def in_wanted(df: DataFrame, kind: str) -> DataFrame:
        return df.join(wanted, [*[df[k].eqNullSafe(wanted[f"_{k}"]) for k in keys], df["_bin"] == wanted["_b"]], kind)

    pos = in_wanted(value_positions(in_wanted(placed, "left_semi"), [*keys, "_bin"], value), "inner")
    return pos.select(*keys, value, (F.col("n_below") + F.col("_below")).alias("n_below"), "n_equal", F.col("_total").alias("n_total"))


def _order_statistic(value: str, p: float) -> Column:
    spot = (F.col("n_total") - 1) * F.lit(float(p))
    lo, hi = F.floor(spot), F.ceil(spot)

    def holds(k: Column) -> Column:
        return (F.col("n_below") <= k) & (k < F.col("n_below") + F.col("n_equal"))

    low = F.max(F.when(holds(lo), F.col(value)))
    high = F.max(F.when(holds(hi), F.col(value)))
    frac = F.max(spot - lo)
    return low + (high - low) * frac


def order_positions(
    df: DataFrame,
    keys: list[str],
    value: str,
    ties: list[str],
    descending: bool = True,
    out: str = "rank",
    total: str | None = "n_group",
    staged: bool = False,
) -> DataFrame:
    """Dense 1..n order of every row of a group (value, then ties ascending)."""
    base = df if staged else stage(df)
    value_order = F.col(value).desc() if descending else F.col(value).asc()
    ranges = _ranges(base, keys)
    if ranges <= 1:
        whole = Window.partitionBy(*keys)
        ranked = base.withColumn(out, F.row_number().over(whole.orderBy(value_order, *ties)))
        return ranked.withColumn(total, F.count(F.lit(1)).over(whole)) if total else ranked
    ranged = _with_part(_with_range(base, keys, value, ranges), keys, ties[0])
    key_order = F.col("_range").desc() if descending else F.col("_range").asc()
    offsets = (
        ranged.groupBy(*keys, "_range", "_part")
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn(
            "_offset",
            F.sum("_n").over(Window.partitionBy(*keys).orderBy(key_order, "_part")) - F.col("_n"),
        )
        .withColumn("_total", F.sum("_n").over(Window.partitionBy(*keys)))
        .drop("_n")
    )
    inside = Window.partitionBy(*keys, "_range", "_part").orderBy(value_order, *ties)
    ranked = ranged.join(offsets, [*keys, "_range", "_part"]).withColumn(
        out, F.row_number().over(inside) + F.col("_offset")
    )
    if total:
        ranked = ranked.withColumn(total, F.col("_total"))
    return ranked.drop("_range", "_part", "_offset", "_total")


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int, out: str = "rank") -> DataFrame:
    """First k rows per group; the limit runs on each task before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(out, F.row_number().over(w)).where(F.col(out) <= k)
