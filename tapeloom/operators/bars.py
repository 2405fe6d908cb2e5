"""Bar cleaning, price adjustment, resampling and simple per-bar projections.

Windows here are partitioned by security.  After cleaning, a security has at
most one row per date, so such a partition is bounded by the calendar.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.functions.scalars import round_even

PRICES = ("open", "high", "low", "close")


def by_entity() -> "Window":
    return Window.partitionBy("entity").orderBy("bar_date")


def normalize_bars(raw: DataFrame, date_col: str = "trade_date", order: str = "ingest") -> DataFrame:
    """Parse dates and numbers, drop unusable rows, repair the envelope, keep one row per date.

    ``order`` names the arrival order; the last arrival of a date wins.
    """
    digits = F.substring(F.regexp_replace(F.col(date_col).cast("string"), r"\D", ""), 1, 8)
    df = raw.withColumn("bar_date", F.when(F.length(digits) == 8, F.try_to_date(digits, "yyyyMMdd")))
    for name in (*PRICES, "volume", "amount"):
        df = df.withColumn(name, F.expr(f"try_cast(`{name}` as double)"))
    for name in PRICES:
        df = df.where(F.col(name).isNotNull() & ~F.isnan(name) & (F.col(name) > 0))
    df = df.where(F.col("bar_date").isNotNull())
    fields = [F.col(c) for c in PRICES]
    df = df.withColumn("_top", F.greatest(*fields)).withColumn("_bottom", F.least(*fields))
    df = df.withColumn("high", F.col("_top")).withColumn("low", F.col("_bottom"))
    for name in ("volume", "amount"):
        df = df.withColumn(name, F.greatest(F.coalesce(F.nanvl(name, F.lit(0.0)), F.lit(0.0)), F.lit(0.0)))
    kept = df.groupBy("entity", "bar_date").agg(
        F.max_by(F.struct(*PRICES, "volume", "amount"), order).alias("_row")
    )
    return kept.select("entity", "bar_date", "_row.*")


def chart_average_guard(average: Column, low: Column, high: Column) -> Column:
    """A moving average far outside the bar's own range is a data error: null it."""
    return F.when((average >= low / 4) & (average <= high * 4), average)


def fill_backward(value: str) -> Column:
    # a running value from the newest bar back; a frame that opens forward is read again for every row
    w = Window.partitionBy("entity").orderBy(F.col("bar_date").desc()).rowsBetween(Window.unboundedPreceding, 0)
    return F.last(value, ignorenulls=True).over(w)


def fill_forward(value: str) -> Column:
    w = by_entity().rowsBetween(Window.unboundedPreceding, 0)
    return F.last(value, ignorenulls=True).over(w)


def _anchor(value: str) -> Column:
    w = by_entity().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return F.last(value, ignorenulls=True).over(w)


def attach_factors(bars: DataFrame, factors: DataFrame) -> DataFrame:
    return bars.join(factors.select("entity", "bar_date", "adj_factor"), ["entity", "bar_date"], "left")


def adjust_prices(bars: DataFrame, mode: str, columns: tuple[str, ...] = PRICES) -> DataFrame:
    """Apply one of the named adjustment policies to bars carrying ``adj_factor``.

    ``batch_qfq``   backward fill, anchor on the last row, rows left without a factor stay null
    ``sample_qfq``  forward then backward fill inside the given window, anchor on the last row
    ``chart_qfq``   as sample_qfq over the whole history, prices rounded to 4 digits
    ``chart_hfq``   forward then backward fill, no anchor, prices rounded to 4 digits
    ``review_qfq``  backward fill, rows without a factor dropped, prices rounded to 2 digits
    """
    if mode in ("batch_qfq", "review_qfq"):
        df = bars.withColumn("_f", fill_backward("adj_factor"))
    elif mode in ("sample_qfq", "chart_qfq", "chart_hfq"):
        df = bars.withColumn("_ff", fill_forward("adj_factor"))
        df = df.withColumn("_f", fill_backward("_ff")).drop("_ff")
    else:
        raise ValueError(f"unknown adjustment mode: {mode}")
    if mode == "review_qfq":
        df = df.where(F.col("_f").isNotNull())
    if mode == "chart_hfq":
        df = df.withColumn("_m", F.col("_f"))
    else:
        df = df.withColumn("_m", F.try_divide(F.col("_f"), _anchor("_f")))
    digits = {"chart_qfq": 4, "chart_hfq": 4, "review_qfq": 2}.get(mode)
    for name in columns:
        adjusted = F.col(name) * F.col("_m")
        df = df.withColumn(name, round_even(adjusted, digits) if digits else adjusted)
    return df.drop("_f", "_m", "adj_factor")


def factors_before(starts: DataFrame, factors: DataFrame) -> DataFrame:
    """The last known factor on or before each (entity, page, first) start, by one pass over both in date order."""
    known = factors.where(F.col("adj_factor").isNotNull()).select("entity", "bar_date", "adj_factor", F.lit(None).cast("bigint").alias("page"))
    asked = starts.select("entity", F.col("first").alias("bar_date"), F.lit(None).cast("double").alias("adj_factor"), F.col("page").cast("bigint"))
    order = Window.partitionBy("entity").orderBy("bar_date", F.col("page").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    both = known.unionByName(asked).withColumn("seed", F.last("adj_factor", ignorenulls=True).over(order))
    return both.where(F.col("page").isNotNull()).select("entity", "page", "seed")


def adjust_pages(pages: DataFrame, factors: DataFrame, latest: Column, mode: str = "qfq") -> DataFrame:
    """Adjust bars page by page so that pages fit together, whichever of them are asked for.

    ``pages`` has entity, page, bar_date, prices and pre_close; ``factors`` is the whole factor table.  Inside
    a page factors are filled forward, a leading gap takes the last factor known before the page, and only
    what is still open is filled backward.  ``qfq`` divides by one anchor for all pages of a security, its last
    factor on or before ``latest``; ``hfq`` does not.  Prices have 4 digits, change and pct_chg 2.

    A page without any factor stays raw, with ``used`` raw and the reason in ``warning``; where factors end
    before ``latest`` the last one goes on and the warning says so.
    """
    starts = pages.groupBy("entity", "page").agg(F.min("bar_date").alias("first"))
    known = factors.where(F.col("adj_factor").isNotNull() & (F.col("bar_date") <= latest))
    anchors = known.groupBy("entity").agg(F.max_by("adj_factor", "bar_date").alias("_anchor"), F.max("bar_date").alias("_until"))
    df = attach_factors(pages, factors).join(factors_before(starts, factors), ["entity", "page"], "left").join(anchors, "entity", "left")
    page = Window.partitionBy("entity", "page").orderBy("bar_date")
    ahead = F.last("adj_factor", ignorenulls=True).over(page.rowsBetween(Window.unboundedPreceding, 0))
    back = Window.partitionBy("entity", "page").orderBy(F.col("bar_date").desc()).rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("_f", F.coalesce(ahead, "seed"))
    df = df.withColumn("_f", F.coalesce("_f", F.last("adj_factor", ignorenulls=True).over(back)))
    df = df.withColumn("_m", F.try_divide(F.col("_f"), F.col("_anchor")) if mode == "qfq" else F.col("_f"))
    for name in (*PRICES, "pre_close"):
        df = df.withColumn(name, F.when(F.col("_m").isNull(), F.col(name)).otherwise(round_even(F.col(name) * F.col("_m"), 4)))
    change = round_even(F.col("close") - F.col("pre_close"), 2)
    warning = F.when(F.col("_m").isNull(), "no factor: bars are raw").when(F.col("_until") < latest, "factors end early: the last one goes on")
    return df.withColumns({
        "change": change, "pct_chg": round_even(F.try_divide(change, F.col("pre_close")) * 100, 2), "warning": warning,
        "used": F.when(F.col("_m").isNull(), "raw").otherwise(mode),
    }).drop("_f", "_m", "_anchor", "_until", "seed", "adj_factor")


def in_pages(bars: DataFrame, size: int) -> DataFrame:
    """Pages of ``size`` bars of each security, number 1 the newest."""
    newest = Window.partitionBy("entity").orderBy(F.col("bar_date").desc())
    return bars.withColumn("page", F.floor((F.row_number().over(newest) - 1) / size) + 1)


def adjustment_errors(bars: DataFrame, day: Column) -> DataFrame:
    """Securities that the batch policy cannot adjust as of ``day``: one row each with what is wrong and since when.

    A bar's factor is missing if neither it nor a later bar up to ``day`` has one.
    """
    filled = bars.where(F.col("bar_date") <= day).withColumn("_f", fill_backward("adj_factor"))
    missing, wrong = F.col("_f").isNull(), F.col("_f") <= 0
    found = filled.where(missing | wrong).groupBy("entity").agg(
        F.count_if(missing).alias("n_missing"), F.count_if(wrong).alias("n_not_positive"), F.min("bar_date").alias("since")
    )
    return found.withColumn("error", F.when(F.col("n_missing") > 0, "missing factor").otherwise("factor not positive"))


def adjust_as_of(bars: DataFrame, day: Column, mode: str = "batch_qfq") -> DataFrame:
    """``adjust_prices`` on the bars up to ``day``; no later factor fills a gap or moves the anchor.

    Bars whose factor is not known by then are left out, so a security that lacks its newest one
    has no result as of that day.
    """
    return adjust_prices(bars.where(F.col("bar_date") <= day), mode).where(F.col("close").isNotNull())


def with_previous_close(bars: DataFrame) -> DataFrame:
    return bars.withColumn("pre_close", F.lag("close").over(by_entity()))


def with_change(df: DataFrame) -> DataFrame:
    change = F.col("close") - F.col("pre_close")
    return df.withColumn("change", change).withColumn(
        "pct_chg", F.try_divide(change, F.col("pre_close")) * 100
    )


def period_key(period: str) -> Column:
    """Bucket of a date: Saturday-to-Friday week (its Friday), or a calendar period start."""
    d = F.col("bar_date")
    if period == "1w":
        return F.next_day(F.date_sub(d, 1), "FRI")
    unit = {"1m": "month", "1q": "quarter", "1y": "year"}[period]
    return F.date_trunc(unit, d).cast("date")


def resample_bars(bars: DataFrame, period: str) -> DataFrame:
    """Week, month, quarter or year bars with change columns (partial aggregation only)."""
    out = bars.groupBy("entity", period_key(period).alias("bucket")).agg(
        F.max("bar_date").alias("bar_date"),
        F.min_by("open", "bar_date").alias("open"),
        F.max("high").alias("high"),
        F.min("low").alias("low"),
        F.max_by("close", "bar_date").alias("close"),
        F.min_by("pre_close", "bar_date").alias("pre_close"),
        F.sum("volume").alias("volume"),
        F.sum("amount").alias("amount"),
    )
    return with_change(out)


def bars_page(visible: DataFrame, history: DataFrame, period: str, limit: int) -> DataFrame:
    """Last ``limit`` period bars per security of the visible bars, with paging flags.

    Period bars are built before the limit; bounds describe the whole history.
    """
    periods = resample_bars(visible, period)
    newest = Window.partitionBy("entity").orderBy(F.col("bar_date").desc())
    page = periods.withColumn("_rn", F.row_number().over(newest)).where(F.col("_rn") <= limit)
    page = page.groupBy("entity").agg(
        F.count(F.lit(1)).alias("returned"),
        F.min("bar_date").alias("returned_start"),
        F.max("bar_date").alias("returned_end"),
        F.max_by("close", "bar_date").alias("last_close"),
        F.max_by("change", "bar_date").alias("last_change"),
    )
    bounds = history.groupBy("entity").agg(
        F.min("bar_date").alias("oldest_available"), F.max("bar_date").alias("newest_available")
    )
    return page.join(bounds, "entity").withColumn(
        "has_more_before", F.col("returned_start") > F.col("oldest_available")
    ).withColumn("has_more_after", F.col("returned_end") < F.col("newest_available"))


def index_100(bars: DataFrame, keys: list[str]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy("bar_date")
    return bars.withColumn("index_100", F.col("close") / F.first("close").over(w) * 100)


def complete_windows(bars: DataFrame, n: int, as_of: Column) -> DataFrame:
    """The last n rows of every security whose n-th newest row exists and whose last row is as_of."""
    newest = Window.partitionBy("entity").orderBy(F.col("bar_date").desc())
    tail = bars.where(F.col("bar_date") <= as_of).withColumn("_rn", F.row_number().over(newest))
    tail = tail.where(F.col("_rn") <= n)
    whole = Window.partitionBy("entity")
    tail = tail.withColumn("_n", F.count(F.lit(1)).over(whole)).withColumn(
        "_end", F.max("bar_date").over(whole)
    )
    return (
        tail.where((F.col("_n") == n) & (F.col("_end") == as_of))
        .withColumn("t", F.lit(n) - F.col("_rn"))
        .drop("_rn", "_n", "_end")
    )
