"""Hard-negative mining over an inverted multi-index.

Two codebooks, one for each half of a vector, are fitted on a bounded sample; every row is filed in the
cell (i, j) of its nearest centroids.  A row's inner product with an anchor is at most the sum over the
halves of (anchor . centroid + |anchor| x radius), so a heap over the two lists of half bounds, each in
falling order, visits cells by falling bound, and may stop once no better row can be left.  Results are
therefore those of a full comparison.

Cells are packed into shards of a bounded number of rows, a large cell into several, and anchors into
slices; each task searches one shard for one slice.  An anchor first searches the shard with its highest
bound, and what it finds there bounds which others it has to see.  Positives come first, since they set
the windows that negatives must fall in.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.llm.frames import map_batches, pick, stage
from tapeloom.llm.vectors import complete, of_common_length, scaled

LARGEST = 4096.0  # entries; with them inner products are exact as double up to 8,192 dimensions
SAMPLE_ROWS = 16384  # that the codebooks are fitted on: those of the least hash of the id
ROUNDS = 12  # of the fit
SHARD_ROWS = (1024, 131072)  # least, most; between them an even share for SHARDS
SHARDS = 24
SLICE_ANCHORS = 131072
SCORE_CELLS = 1 << 21  # scores of a task held at a time
WAVES = (4, 16, 64)  # cells an anchor takes from its heap before thresholds are renewed

SCHEMA = (
    "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"
)
_FOUND = "anchor bigint, request int, score bigint, vec_id bigint, row bigint"
_ROW = "row bigint, vec_id bigint, label int, q array<int>"


def matrix(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    """A list column without nulls, all lists of ``width`` entries, as rows of doubles."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), width)


def codebook(points: np.ndarray, size: int) -> np.ndarray:
    """``size`` centroids at most, by farthest-first seeding and Lloyd's rounds; the same for the same points."""
    distinct = np.unique(points, axis=0)
    centres = [distinct.mean(0)]
    far = ((distinct - centres[0]) ** 2).sum(1)
    while len(centres) < min(size, len(distinct)):
        centres.append(distinct[far.argmax()])
        far = np.minimum(far, ((distinct - centres[-1]) ** 2).sum(1))
    book = np.array(centres)
    for _ in range(ROUNDS):
        near = nearest(points, book)[0]
        count = np.bincount(near, minlength=len(book))
        sums = np.zeros_like(book)
        np.add.at(sums, near, points)
        book = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], book)
    return book


def nearest(points: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centroid of each point and the distance to it."""
    code = ((book**2).sum(1) - 2 * points @ book.T).argmin(1)
    return code, np.sqrt(((points - book[code]) ** 2).sum(1))


@dataclass
class Index:
    """Codebooks, and the cells with their radii and shards; a fixed number of cells whatever the rows."""

    half: int
    width: int
    books: tuple[np.ndarray, np.ndarray]
    cells: np.ndarray  # (i, j) of each cell, in the order of shards
    radii: np.ndarray  # of its rows' halves
    first: np.ndarray  # shard of its first piece
    pieces: np.ndarray
    shards: int
    largest: float  # norm of a row

    def half_bounds(self, anchors: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
        """Anchors times centroids and norms for each half, and the slack that rounding may need."""
        parts = [anchors[:, : self.half], anchors[:, self.half :]]
        norms = [np.sqrt((p**2).sum(1)) for p in parts]
        slack = 1e-3 + 1e-9 * np.sqrt((anchors**2).sum(1)) * self.largest
        return [p @ b.T for p, b in zip(parts, self.books, strict=True)], norms, slack

    def shard_bounds(self, anchors: np.ndarray) -> np.ndarray:
        """What a row of each shard can score at most with each anchor."""
        dots, norms, slack = self.half_bounds(anchors)
        bound = dots[0][:, self.cells[:, 0]] + dots[1][:, self.cells[:, 1]]
        bound += norms[0][:, None] * self.radii[:, 0] + norms[1][:, None] * self.radii[:, 1] + slack[:, None]
        out = np.full((len(anchors), self.shards), -np.inf)
        for cell, (start, pieces) in enumerate(zip(self.first, self.pieces, strict=True)):
            part = out[:, start : start + pieces]
            np.maximum(part, bound[:, cell : cell + 1], out=part)
        return out


def build_index(rows: DataFrame, width: int, size: int | None = None, shard_rows: int | None = None) -> tuple[Index, DataFrame] | None:
    """The index of (row, vec_id, label, q) rows, and these rows with their shard and codes, written once."""
    sample = rows.orderBy(F.xxhash64("vec_id"), "row").limit(SAMPLE_ROWS).select("q").toArrow()
    if not sample.num_rows:
        return None
    half, points = (width + 1) // 2, matrix(sample.column(0), width)
    count = rows.count()
    size = size or int(np.clip(round(2 * count**0.25), 2, 256))
    books = codebook(points[:, :half], size), codebook(points[:, half:], size)

    def file(batch: pa.RecordBatch) -> pa.RecordBatch:
        q = matrix(batch.column(3), width)
        (i, r), (j, s) = nearest(q[:, :half], books[0]), nearest(q[:, half:], books[1])
        more = [pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(r), pa.array(s), pa.array(np.sqrt((q**2).sum(1)))]
        return pa.RecordBatch.from_arrays([*batch.columns, *more], ["row", "vec_id", "label", "q", "i", "j", "r", "s", "norm"])

    filed = stage(map_batches(rows.select("row", "vec_id", "label", "q"), file, f"{_ROW}, i int, j int, r double, s double, norm double"))
    cells = filed.groupBy("i", "j").agg(F.count("*").alias("n"), F.max("r"), F.max("s"), F.max("norm"))
    cells = sorted(tuple(c) for c in cells.collect())  # at most one for each pair of centroids
    most = shard_rows or int(np.clip(-(-count // SHARDS), *SHARD_ROWS))
    first, pieces, shard, room = [], [], -1, 0
    for _, _, n, *_ in cells:
        if n <= room:
            room -= n
            first.append(shard)
            pieces.append(1)
        else:
            first.append(shard + 1)
            pieces.append(-(-n // most))
            shard += pieces[-1]
            room = most - n if pieces[-1] == 1 else 0
    table = np.array([c[:2] for c in cells])
    index = Index(
        half, width, books, table, np.array([c[3:5] for c in cells]), np.array(first), np.array(pieces), shard + 1,
        max(c[5] for c in cells),
    )

    stride = len(books[1])
    start, parts = np.zeros((2, len(books[0]) * stride), np.int64)
    start[table[:, 0] * stride + table[:, 1]], parts[table[:, 0] * stride + table[:, 1]] = first, pieces
    at = F.col("i") * stride + F.col("j")
    of = lambda values: F.get(F.array(*[F.lit(int(v)) for v in values]), at)
    dealt = of(start) + F.pmod(F.xxhash64("row"), of(np.maximum(parts, 1)))
    return index, filed.withColumn("shard", dealt.cast("int")).drop("norm")


class _Heap:
    """Visits the cells of one anchor by falling sum of half bounds."""

    def __init__(self, first: np.ndarray, second: np.ndarray) -> None:
        self.order = np.argsort(-first, kind="stable"), np.argsort(-second, kind="stable")
        self.sums = first[self.order[0]].tolist(), second[self.order[1]].tolist()
        self.names = self.order[0].tolist(), self.order[1].tolist()
        self.heap = [(-(self.sums[0][0] + self.sums[1][0]), 0, 0)]

    def take(self, stop: float, number: int, cell_of: list[list[int]]) -> list[int]:
        """The next ``number`` cells that exist; fewer only if those left have bounds under ``stop``."""
        (a_sums, b_sums), (a_names, b_names), heap, found = self.sums, self.names, self.heap, []
        while heap and len(found) < number:
            if -heap[0][0] < stop:
                heap.clear()
                break
            _, a, b = heapq.heappop(heap)
            if b + 1 < len(b_sums):
                heapq.heappush(heap, (-(a_sums[a] + b_sums[b + 1]), a, b + 1))
            if b == 0 and a + 1 < len(a_sums):
                heapq.heappush(heap, (-(a_sums[a + 1] + b_sums[0]), a + 1, 0))
            if (cell := cell_of[a_names[a]][b_names[b]]) >= 0:
                found.append(cell)
        return found


def _best(scores: np.ndarray, allowed: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (line, column) of the ``k`` highest allowed scores of each line, ties by the lesser column."""
    masked = np.where(allowed, scores, -np.inf)
    if masked.shape[1] > k:
        kth = np.partition(masked, -k, axis=1)[:, -k, None]
        above = masked > kth
        equal = (masked == kth) & allowed
        allowed = above & allowed | equal & (np.cumsum(equal, axis=1) <= k - above.sum(1)[:, None])
    return np.nonzero(allowed)


def search(index: Index, rows: pa.Table, anchors: pa.Table, k: int, same: bool) -> pa.Table:
    """The best ``k`` rows for each request (low, high, least) of each anchor within one shard.

    A row answers a request of an anchor if its label is the same (or not), and its score lies from low
    to high and is at least ``least``, of which ``k`` rows are known elsewhere.
    """
    q, label = matrix(anchors.column("q"), index.width), anchors.column("label").to_numpy()
    low, high, least = (np.stack(anchors.column(c).to_numpy()).astype(np.float64) for c in ("low", "high", "least"))
    n, requests = low.shape
    least = np.maximum(low, least)
    least[low > high] = np.inf

    i, j = rows.column("i").to_numpy(), rows.column("j").to_numpy()
    ids, keys = rows.column("vec_id").to_numpy(), rows.column("row").to_numpy()
    order = np.lexsort((keys, ids, j, i))
    i, j, ids, keys = i[order], j[order], ids[order], keys[order]
    x, labels = matrix(rows.column("q"), index.width)[order], rows.column("label").to_numpy()[order]
    starts = np.flatnonzero(np.r_[True, (i[1:] != i[:-1]) | (j[1:] != j[:-1])])
    ends = np.r_[starts[1:], len(i)]
    (a_codes, a_at), (b_codes, b_at) = np.unique(i, return_inverse=True), np.unique(j, return_inverse=True)
    cell_of = np.full((len(a_codes), len(b_codes)), -1)
    cell_of[a_at[starts], b_at[starts]] = np.arange(len(starts))
    cell_of = cell_of.tolist()
    radii = np.zeros(len(a_codes)), np.zeros(len(b_codes))
    np.maximum.at(radii[0], a_at, rows.column("r").to_numpy()[order])
    np.maximum.at(radii[1], b_at, rows.column("s").to_numpy()[order])
    dots, norms, slack = index.half_bounds(q)
    bounds = dots[0][:, a_codes] + norms[0][:, None] * radii[0] + slack[:, None], dots[1][:, b_codes] + norms[1][:, None] * radii[1]

    heaps = [_Heap(bounds[0][a], bounds[1][a]) for a in range(n)]
    best = [np.zeros((0, 4), np.int64)]  # anchor, request, score, place
    live, wave = range(n), 0
    while live:
        number = WAVES[min(wave, len(WAVES) - 1)]
        wave += 1
        stops = least.min(1)
        visits = [(a, c) for a in live for c in heaps[a].take(stops[a], number, cell_of)]
        live = sorted({a for a, _ in visits})
        if not visits:
            break
        who, cell = np.array(visits).T
        by = np.argsort(cell, kind="stable")
        for part in np.split(by, np.flatnonzero(np.diff(cell[by])) + 1):
            start, end = starts[cell[part[0]]], ends[cell[part[0]]]
            step = max(1, SCORE_CELLS // int(end - start))
            for at in range(0, len(part), step):
                a = who[part[at : at + step]]
                scores = q[a] @ x[start:end].T
                kin = label[a][:, None] == labels[start:end]
                fit = kin if same else ~kin
                for request in range(requests):
                    hit = fit & (scores >= least[a, request, None]) & (scores <= high[a, request, None])
                    if not (some := hit.any(1)).any():
                        continue
                    line, column = _best(scores[some], hit[some], k)
                    line = np.flatnonzero(some)[line]
                    best.append(np.stack([a[line], np.full(len(line), request), scores[line, column].astype(np.int64), start + column], 1))
        merged = np.concatenate(best)
        group = merged[:, 0] * requests + merged[:, 1]
        order = np.lexsort((keys[merged[:, 3]], ids[merged[:, 3]], -merged[:, 2], group))
        merged, group = merged[order], group[order]
        rank = np.arange(len(group)) - np.searchsorted(group, group)
        merged, group, rank = merged[rank < k], group[rank < k], rank[rank < k]
        full = rank == k - 1
        flat = least.reshape(-1)
        flat[group[full]] = np.maximum(flat[group[full]], merged[full, 2])
        best = [merged]
    out = np.concatenate(best)
    columns = [anchors.column("row").to_numpy()[out[:, 0]], out[:, 1].astype(np.int32), out[:, 2], ids[out[:, 3]], keys[out[:, 3]]]
    return pa.table(dict(zip(("anchor", "request", "score", "vec_id", "row"), columns, strict=True)))


def _places(requests: DataFrame, index: Index, slices: int, home: bool) -> DataFrame:
    """Each anchor beside the shards it has to search: the one of the highest bound, or all others that may hold a hit."""

    def place(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        bound = index.shard_bounds(matrix(batch.column(2), index.width))
        low, high, least = (np.stack(batch.column(c).to_numpy(zero_copy_only=False)).astype(np.float64) for c in (3, 4, 5))
        stop = np.where(low > high, np.inf, np.maximum(low, least)).min(1)
        best = bound.argmax(1)
        wanted = bound >= stop[:, None]
        chosen = np.zeros_like(wanted)
        chosen[np.arange(len(best)), best] = True
        line, shard = np.nonzero(wanted & (chosen if home else ~chosen))
        if not len(line):
            return None
        taken = batch.take(pa.array(line))
        return pa.RecordBatch.from_arrays([*taken.columns, pa.array(shard.astype(np.int32))], [*taken.schema.names, "shard"])

    columns = requests.select("row", "label", "q", "low", "high", "least")
    lists = "low array<bigint>, high array<bigint>, least array<bigint>"
    placed = map_batches(columns, place, f"row bigint, label int, q array<int>, {lists}, shard int")
    return placed.withColumn("slice", F.pmod(F.xxhash64("row"), F.lit(slices)).cast("int"))


def _pass(index: Index, rows: DataFrame, requests: DataFrame, slices: int, k: int, same: bool, home: bool) -> DataFrame:
    filed = rows.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
    placed = _places(requests, index, slices, home)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if left.num_rows and right.num_rows:
            return search(index, left, right, k, same)
        return pa.table({"anchor": pa.array([], pa.int64()), "request": pa.array([], pa.int32()), "score": pa.array([], pa.int64()),
                         "vec_id": pa.array([], pa.int64()), "row": pa.array([], pa.int64())})

    return filed.groupBy("shard", "slice").cogroup(placed.groupBy("shard", "slice")).applyInArrow(run, _FOUND)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("anchor", "request").orderBy(F.desc("score"), "vec_id", "row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def best_rows(index: Index, rows: DataFrame, requests: DataFrame, slices: int, k: int, same: bool) -> DataFrame:
    """(anchor, request, score, vec_id, row, rank): the first ``k`` rows for each request, over all shards.

    Searches the shard of the highest bound first; with ``k`` hits there the least of them becomes the
    threshold of the search in the others.
    """
    near = stage(_pass(index, rows, requests, slices, k, same, home=True))
    known = _ranked(near, k).where(F.col("rank") == k).groupBy("anchor").agg(F.map_from_entries(F.collect_list(F.struct("request", "score"))).alias("known"))
    raised = F.transform("least", lambda v, i: F.greatest(v, F.coalesce(F.try_element_at("known", i), v)))
    rest = requests.join(known, requests.row == known.anchor, "left").withColumn("least", F.coalesce(raised, F.col("least")))
    far = _pass(index, rows, rest, slices, k, same, home=False)
    return _ranked(near.unionAll(far), k)


def mine(
    df: DataFrame, anchor: Column, vec_id: str = "vec_id", vector: str = "embedding", label: str | Column = "label",
    positives: int = 5, negatives: int = 3, scale: int = 256, window: tuple[int, int] = (50, 95),
    size: int | None = None, shard_rows: int | None = None, slice_anchors: int = SLICE_ANCHORS,
) -> DataFrame:
    """The first ``negatives`` different-label rows inside each positive's window, for each row where ``anchor`` holds.

    ``anchor`` and ``label`` are expressions over (``vec_id``, ``label``).  Scores are inner products of
    floor(scale * entry); the window is given in percent of the positive's score.  Equal scores are
    ordered by id.

    Rows with a null id, label or vector, a null, NaN or infinite entry or one beyond ``LARGEST``, and
    vectors of another length than the most frequent, take no part.  Repeated rows are rows of their own:
    each is an anchor, and may be the positive or negative of another.  An anchor without a positive, or a
    positive without a negative in its window, has no rows; nor has an empty table.  Other columns are not read.
    """
    spark = df.sparkSession
    whole = pick(df, vec_id=vec_id, v=vector, **({"label": label} if isinstance(label, str) else {}))
    if not isinstance(label, str):
        whole = df.select(F.col(f"`{vec_id}`").alias("vec_id"), F.col(f"`{vector}`").alias("v"), label.alias("label"))
    whole = whole.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & complete(F.col("v"), LARGEST))
    whole, width = of_common_length(whole, "v")
    if not width:
        return spark.createDataFrame([], SCHEMA)
    rows = stage(whole.select(
        F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("bigint").alias("vec_id"),
        F.col("label").cast("int").alias("label"), F.transform(scaled(F.col("v"), scale), lambda c: c.cast("int")).alias("q"),
    ))
    built = build_index(rows, width, size, shard_rows)
    if built is None:
        return spark.createDataFrame([], SCHEMA)
    index, filed = built
    anchors = rows.where(anchor)
    slices = max(1, -(-anchors.count() // slice_anchors))
    bottom, top = -(2**62), 2**62
    all_rows = anchors.select("row", "label", "q", *[F.array(F.lit(v)).alias(c) for c, v in (("low", bottom), ("high", top), ("least", bottom))])
    # one more than the positives, as an anchor's own row may be among them
    near = best_rows(index, filed, all_rows, slices, positives + 1, same=True).where(F.col("row") != F.col("anchor"))
    order = Window.partitionBy("anchor").orderBy("rank")
    near = stage(near.withColumn("request", F.row_number().over(order) - 1).where(F.col("request") < positives)
                 .select("anchor", "request", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")))
    low, high = window
    scores = near.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("request", "positive_score"))).alias("p"))
    score = lambda i: F.get("p", F.lit(i))["positive_score"]

    def bound(percent: int, up: int, empty: int) -> Column:
        """Hundredths of the scores, rounded up or down; a negative or missing score has an empty window."""
        part = lambda i: F.call_function("div", score(i) * percent + up, F.lit(100))
        return F.array(*[F.when(score(i) >= 0, part(i)).otherwise(F.lit(empty)).cast("bigint") for i in range(positives)])

    bounds = [bound(low, 99, 0).alias("low"), bound(high, 0, -1).alias("high")]
    windows = anchors.join(scores, anchors.row == scores.anchor).select("row", "label", "q", *bounds)
    windows = windows.withColumn("least", F.col("low"))
    far = best_rows(index, filed, windows, slices, negatives, same=False)
    far = far.select("anchor", "request", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    ids = anchors.select(F.col("row").alias("anchor"), F.col("vec_id").alias("anchor_id"))
    joined = far.join(near, ["anchor", "request"]).join(ids, "anchor")
    return joined.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
