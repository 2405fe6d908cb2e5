"""Template similarity: Pearson correlation of z-scored log closes."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapeloom.functions.ranking import top_k
from tapeloom.operators.bars import by_entity
from tapeloom.sources.staging import stage

FLAT = 1e-12
MAX_WINDOW = 240
BROADCAST_VALUES = 500_000  # of template vectors, about 16 MB
MIN_WINDOW = 2


def z_of(x: Column, keys: list[str]) -> Column:
    """z-score inside the group (population deviation), null for a flat group."""
    w = Window.partitionBy(*keys)
    sigma = F.stddev_pop(x).over(w)
    return F.when(sigma > FLAT, (x - F.avg(x).over(w)) / sigma)


def standardised(values: str) -> Column:
    """The z-scores of an array (population deviation), null for a flat one.

    Mean and deviation are variables of a lambda: as columns they would be computed again for every value.
    """
    def mean(xs: Column) -> Column:
        return F.aggregate(xs, F.lit(0.0), lambda a, v: a + v) / F.size(xs)

    def with_value(value: Column, use) -> Column:
        return F.transform(F.array(value), use)[0]

    def scaled(c: Column) -> Column:
        return with_value(F.sqrt(mean(F.transform(c, lambda v: v * v))), lambda s: F.when(s > FLAT, F.transform(c, lambda v: v / s)))

    return with_value(with_value(mean(F.col(values)), lambda mu: F.transform(F.col(values), lambda v: v - mu)), scaled)


def template_points(bars: DataFrame, windows: dict[int, int], start: int) -> DataFrame:
    """Cut one window per registered source security: (template_id, n, t, bar_date, close, x, z)."""
    n = F.create_map(*[F.lit(v) for kv in windows.items() for v in kv])
    cut = (
        bars.where(F.col("entity").isin(list(windows)))
        .withColumn("n", F.element_at(n, F.col("entity").cast("int")))
        .withColumn("t", F.col("pos") - start)
        .where((F.col("t") >= 1) & (F.col("t") <= F.col("n")))
        .withColumn("x", F.ln("close"))
    )
    return cut.select(
        F.col("entity").alias("template_id"), "n", "t", "bar_date", "close", "x",
        z_of(F.col("x"), ["entity"]).alias("z"),
    )


@dataclass(frozen=True)
class TemplateBook:
    """The template registry: parameter vectors of at most ``MAX_WINDOW`` values, named one by one."""

    templates: tuple[tuple[int, tuple[float, ...]], ...]

    @classmethod
    def load(cls, points: DataFrame) -> "TemplateBook":
        """Read the registered vectors to the driver and check their lengths."""
        rows = points.select("template_id", "t", "z").collect()
        vectors: dict[int, list[tuple[int, float]]] = {}
        for r in rows:
            vectors.setdefault(r.template_id, []).append((r.t, r.z))
        for key, pts in vectors.items():
            if not MIN_WINDOW <= len(pts) <= MAX_WINDOW or any(z is None for _, z in pts):
                raise ValueError(f"template {key} has no usable window")
        return cls(tuple((k, tuple(z for _, z in sorted(v))) for k, v in sorted(vectors.items())))

    @property
    def longest(self) -> int:
        return max(len(z) for _, z in self.templates)

    def points(self, spark: SparkSession) -> DataFrame:
        """(template_id, n, back, z) with back = bars before the window end."""
        data = [
            (k, len(z), len(z) - 1 - i, float(v))
            for k, z in self.templates for i, v in enumerate(z)
        ]
        return spark.createDataFrame(data, "template_id long, n int, back int, z double")

    def resized(self, factor: float) -> "TemplateBook":
        """Every curve linearly interpolated to a scaled length and standardised again."""
        return self._interpolated(lambda n: max(10, int(round(n * factor))))

    def resized_to(self, bars: int) -> "TemplateBook":
        return self._interpolated(lambda n: bars)

    def _interpolated(self, length) -> "TemplateBook":
        out = []
        for k, z in self.templates:
            n = length(len(z))
            curve = np.interp(np.linspace(0, 1, n), np.linspace(0, 1, len(z)), z)
            out.append((k, tuple((curve - curve.mean()) / curve.std())))
        return TemplateBook(tuple(out))


def latest_scores(bars: DataFrame, book: TemplateBook, as_of: Column) -> DataFrame:
    """Score every security's newest window per template; a flat or short window has no score.

    The template vectors are broadcast while they are few (their number of values is known here), so
    the join and the aggregate stay on the partitioning of the security window and scoring adds no
    shuffle; a larger registry joins by position.
    """
    newest = Window.partitionBy("entity").orderBy(F.col("bar_date").desc())
    tail = (
        bars.where(F.col("bar_date") <= as_of)
        .withColumn("_prev", F.lag("close").over(by_entity()))
        .withColumn("back", F.row_number().over(newest) - 1)
        .where(F.col("back") < book.longest)
    )
    x = F.when(F.col("close") > 0, F.ln("close"))
    pct = F.abs(F.try_divide(F.col("close"), F.col("_prev")) - 1) * 100
    points = book.points(bars.sparkSession)
    if sum(len(z) for _, z in book.templates) <= BROADCAST_VALUES:
        points = F.broadcast(points)
    joined = tail.select("entity", "bar_date", "back", x.alias("x"), pct.alias("pct")).join(points, "back")
    per = joined.groupBy("template_id", "entity").agg(
        F.first("n").alias("n"),
        F.count("x").alias("_cnt"),
        F.sum(F.col("z") * F.col("x")).alias("_dot"),
        F.stddev_pop("x").alias("_sigma"),
        F.min("bar_date").alias("start_date"),
        F.max("bar_date").alias("end_date"),
        F.max("pct").alias("max_abs_pct"),
    )
    score = F.col("_dot") / (F.col("n") * F.col("_sigma"))
    return (
        per.where((F.col("_cnt") == F.col("n")) & (F.col("end_date") == as_of) & (F.col("_sigma") > FLAT))
        .withColumn("score", F.greatest(F.lit(-1.0), F.least(F.lit(1.0), score)))
        .select("template_id", "entity", "score", "start_date", "end_date",
                F.col("n").alias("window_bars"), "max_abs_pct")
    )


TEMPLATE_BLOCK, SECURITY_BLOCK = 1 << 15, 1 << 16  # vectors of a block; two blocks are what a task holds
BLOCK_VALUES = 1 << 22  # values of a block at most, about 32 MB
TEMPLATE_ROWS, SECURITY_ROWS = 256, 2048  # of one matrix product


def equal_windows(tails: DataFrame, keep: int) -> DataFrame:
    """(closes, entities): securities whose newest bars are equal, as one row with the ``keep`` smallest of them."""
    first = top_k(tails.select("closes", "entity"), ["closes"], [F.col("entity")], keep)
    return first.groupBy("closes").agg(F.array_sort(F.collect_list("entity")).alias("entities"))


def best_of_registry(bars: DataFrame, registry: DataFrame, as_of: Column, keep: int) -> DataFrame:
    """The ``keep`` securities that fit each template best, for a registry of any size.

    ``registry`` is (template_id, z), its vectors of any lengths.  Equal vectors and equal newest windows are scored
    once.  Templates and windows are dealt to blocks by hash; each pair of blocks meets in one task, as matrix
    products for every length, and hands on only the best of each template.  The driver learns the longest
    length and two counts.  A security has a score if its newest bar is of ``as_of``, its window is whole,
    positive and not flat.
    """
    spark = registry.sparkSession
    longest = registry.agg(F.max(F.size("z"))).first()[0]
    if longest is None:
        return spark.createDataFrame([], "template_id bigint, entity bigint, score double, rank int")
    newest = Window.partitionBy("entity").orderBy(F.col("bar_date").desc())
    recent = bars.where(F.col("bar_date") <= as_of).withColumn("back", F.row_number().over(newest)).where(F.col("back") <= longest)
    tails = recent.groupBy("entity").agg(
        F.transform(F.array_sort(F.collect_list(F.struct((-F.col("back")).alias("at"), "close"))), lambda p: p["close"]).alias("closes"),
        F.max("bar_date").alias("end_date"),
    ).where(F.col("end_date") == as_of).select(F.col("entity").cast("bigint"), "closes")
    tails = stage(equal_windows(tails, keep))
    shapes = stage(registry.groupBy("z").agg(F.min(F.col("template_id").cast("bigint")).alias("shape")))
    values = max(1, BLOCK_VALUES // max(longest, 1))
    t_rows, s_rows = min(TEMPLATE_BLOCK, values), min(SECURITY_BLOCK, values)
    n_shapes = shapes.count()
    # small registries are still dealt to every core
    t_blocks = max(-(-n_shapes // t_rows), min(spark.sparkContext.defaultParallelism, -(-n_shapes // TEMPLATE_ROWS)))
    s_blocks = max(1, -(-tails.count() // s_rows))

    def dealt(df: DataFrame, key: Column, own: str, number: int, other: str, others: int) -> DataFrame:
        placed = df.withColumn(own, F.pmod(F.xxhash64(key), F.lit(number)))
        return placed.withColumn(other, F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(others - 1).cast("bigint"))))

    left = dealt(shapes, F.col("shape"), "t_block", t_blocks, "s_block", s_blocks)
    first = F.col("entities")[0]
    right = dealt(tails.select(first.alias("entity"), "closes"), F.col("entity"), "s_block", s_blocks, "t_block", t_blocks)
    pairs = left.groupBy("t_block", "s_block").cogroup(right.groupBy("t_block", "s_block")).applyInArrow(
        _block_scorer(keep), "shape bigint, entity bigint, score double"
    )
    order = [F.col("score").desc(), F.col("entity")]
    groups = top_k(pairs, ["shape"], order, keep).drop("rank")
    members = groups.join(tails.select(first.alias("entity"), "entities"), "entity").select("shape", "score", F.explode("entities").alias("entity"))
    best = top_k(members, ["shape"], order, keep)
    return registry.select(F.col("template_id").cast("bigint"), "z").join(shapes, "z").select("template_id", "shape").join(best, "shape").drop("shape")


def _block_scorer(keep: int):
    """Cogroup function of a block of templates and one of windows; everything it uses is nested so that it ships by value."""
    flat, t_rows, s_rows, slice_rows = FLAT, TEMPLATE_ROWS, SECURITY_ROWS, 1 << 15

    def lists(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Values, first places and lengths of a list column."""
        rows = column.combine_chunks()
        sizes = pc.fill_null(pc.list_value_length(rows), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        return rows.flatten().to_numpy(zero_copy_only=False), np.cumsum(sizes) - sizes, sizes

    def split(rows: np.ndarray, scale: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows less their means, over scale and the root of their length, and the means over scale."""
        mean = rows.mean(1)
        return (rows - mean[:, None]) / (scale * np.sqrt(rows.shape[1]))[:, None], mean / scale

    def best(z: np.ndarray, x: np.ndarray, sigma: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Template row, window row and score of the ``keep`` best windows of each template; equal scores by window row.

        Products in single precision find the windows that can be among the best, allowing for their rounding
        error; those are scored in double precision.
        """
        n = z.shape[1]
        (zc, zm), (xc, xm) = split(z, np.ones(len(z))), split(x, sigma)
        # |rounding error| <= (terms + 2) * eps * sum of the sizes of the products
        slack = 2.0 ** -23 * (n + 8) * (np.linalg.norm(zc, axis=1) + np.abs(zm) * np.abs(xm).max())
        kind = np.float32 if np.abs(z).max() < 1e30 and np.abs(xm).max() < 1e30 else np.float64
        left, right = np.column_stack([zc, zm]).astype(kind), np.column_stack([xc, xm]).astype(kind)
        found = []
        for a in range(0, len(z), t_rows):
            some, error = left[a:a + t_rows], slack[a:a + t_rows]
            t, j, s = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
            least = np.full(len(some), -np.inf)
            for b in range(0, len(x), s_rows):
                rough = some @ right[b:b + s_rows].T
                if not b and rough.shape[1] >= keep:
                    least = np.minimum(np.partition(rough, rough.shape[1] - keep, axis=1)[:, -keep], 1) - error
                # scores end at -1, where the smaller security wins
                bound = np.where(least - error <= -1, -np.inf, least - error).astype(kind)
                bound = np.nextafter(bound, kind(-np.inf))
                rows, cols = np.nonzero(~(rough < bound[:, None]))
                for c in range(0, len(rows), slice_rows):
                    r, w = rows[c:c + slice_rows], cols[c:c + slice_rows] + b
                    exact = np.clip(np.einsum("ij,ij->i", z[a + r], x[w]) / (n * sigma[w]), -1, 1)
                    t, j, s = np.concatenate([t, r]), np.concatenate([j, w]), np.concatenate([s, exact])
                    order = np.lexsort((j, -s, t))
                    t, j, s = t[order], j[order], s[order]
                    place = np.arange(len(t)) - np.searchsorted(t, t)
                    t, j, s, place = (v[place < keep] for v in (t, j, s, place))
                    full = place == keep - 1
                    least[t[full]] = np.fmax(least[t[full]], s[full])
            found.append((t + a, j, s))
        return tuple(np.concatenate(v) for v in zip(*found))

    def score(some: pa.Table, windows: pa.Table) -> pa.Table:
        windows = windows.sort_by("entity")
        names, entities = some.column("shape").to_numpy(), windows.column("entity").to_numpy()
        (z, z_at, z_size), (closes, at, size) = lists(some.column("z")), lists(windows.column("closes"))
        out = [(names[:0], entities[:0], np.zeros(0))]
        for n in np.unique(z_size[z_size > 0]):
            which, able = np.flatnonzero(z_size == n), np.flatnonzero(size >= n)
            x = closes[(at + size - n)[able][:, None] + np.arange(n)]
            whole = (x > 0).all(1)
            able, x = able[whole], np.log(x[whole])
            sigma = x.std(1)
            able, x, sigma = able[sigma > flat], x[sigma > flat], sigma[sigma > flat]
            if len(able):
                t, j, s = best(z[z_at[which][:, None] + np.arange(n)], x, sigma)
                out.append((names[which[t]], entities[able[j]], s))
        return pa.table(dict(zip(("shape", "entity", "score"), (np.concatenate(v) for v in zip(*out)))))

    return score


def rolling_scores(
    bars: DataFrame, book: TemplateBook, days: DataFrame | None = None, only: Column | None = None, carry: tuple[str, ...] = ()
) -> DataFrame:
    """Score every trailing window of every security against every template.

    With ``days`` (bar_date, a row per date of the calendar at most) only windows that end on one of
    them are scored, with ``only`` those whose last bar fulfils it.  ``carry`` names columns of the last bar
    that the scores keep, so that nothing has to be joined to the rows of all templates.

    Rows lie by security, as the window over each leaves them, and are sorted by date; tasks then stream
    Arrow batches and carry only the last ``longest - 1`` rows from one batch to
    the next, so memory does not depend on the length of a security's history.
    A flat window scores 0; a security with a non-positive price is dropped.
    """
    entity_type = bars.schema["entity"].dataType
    schema = T.StructType([
        T.StructField("template_id", T.LongType()),
        T.StructField("entity", entity_type),
        T.StructField("bar_date", T.DateType()),
        T.StructField("window_start", T.DateType()),
        T.StructField("score", T.DoubleType()),
        *[bars.schema[c] for c in carry],
    ])
    whole = Window.partitionBy("entity")
    usable = bars.withColumn("_low", F.min("close").over(whole)).where(F.col("_low") > 0)
    series = (
        _marked(usable, days, only).select("entity", "bar_date", F.ln("close").alias("x"), "wanted", *carry)
        .sortWithinPartitions("entity", "bar_date")
    )
    return series.mapInArrow(_window_scorer(book, carry), schema)


def _marked(bars: DataFrame, days: DataFrame | None, only: Column | None) -> DataFrame:
    """Bars with ``wanted``: whether their date is asked for and ``only`` holds."""
    own = F.lit(True) if only is None else F.coalesce(only, F.lit(False))
    if days is None:
        return bars.withColumn("wanted", own)
    asked = F.broadcast(days.select("bar_date").distinct().withColumn("_asked", F.lit(True)))
    return bars.join(asked, "bar_date", "left").withColumn("wanted", F.coalesce("_asked", F.lit(False)) & own)


def _window_scorer(book: TemplateBook, carry: tuple[str, ...] = ()):
    """Arrow batch function; everything it uses is nested so that it ships by value."""
    templates = [(k, np.asarray(z)) for k, z in book.templates]
    keep = book.longest - 1
    flat = FLAT

    def score_table(table: pa.Table, seen: int) -> Iterator[pa.RecordBatch]:
        owner = table.column("entity").to_numpy()
        x = table.column("x").to_numpy()
        wanted = table.column("wanted").to_numpy()
        for key, z in templates:
            n = len(z)
            if len(x) < n:
                continue
            ends = np.arange(n - 1, len(x))
            ends = ends[wanted[ends] & (ends >= seen) & (owner[ends] == owner[ends - n + 1])]
            if not len(ends):
                continue
            windows = np.lib.stride_tricks.sliding_window_view(x, n)[ends - n + 1]
            sigma = windows.std(axis=1)
            dots = windows @ z
            score = np.divide(dots, n * sigma, out=np.zeros_like(dots), where=sigma > flat)
            last, first = pa.array(ends), pa.array(ends - n + 1)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(len(ends), key, dtype=np.int64)),
                    table.column("entity").take(last).combine_chunks(),
                    table.column("bar_date").take(last).combine_chunks(),
                    table.column("bar_date").take(first).combine_chunks(),
                    pa.array(score),
                    *[table.column(c).take(last).combine_chunks() for c in carry],
                ],
                names=["template_id", "entity", "bar_date", "window_start", "score", *carry],
            )

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            fresh = pa.Table.from_batches([batch])
            seen = held.num_rows if held is not None else 0
            table = (pa.concat_tables([held, fresh]) if held is not None else fresh).combine_chunks()
            yield from score_table(table, seen)
            held = table.slice(max(0, table.num_rows - keep))

    return score


def window_correlation(k: int) -> Column:
    """Correlation of the last k positions of aligned series (aggregate), null when flat."""
    a, b = F.when(F.col("back") < k, F.col("x")), F.when(F.col("back") < k, F.col("y"))
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))
