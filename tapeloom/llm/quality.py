"""Quality classifier: ridge regression on random Fourier features of document statistics.

The features approximate a Gaussian kernel.  Each partition of labelled rows adds up its own normal
equations; Spark sums them cell by cell, the driver solves one small system.  Scores of a second
fold of labelled rows, counted in a fixed number of bins, give the isotonic calibration.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeloom.llm.arrays import BLANKS, byte_set, chunks, code_points, mix, runs, window_hashes, word_hashes
from tapeloom.llm.frames import bounded, held_out, map_batches, pick, stage

FEATURES = 256
WIDTH = 4.0  # standard deviation of the Gaussian kernel, in standardised statistics
RIDGE = 1e-4  # times the number of rows
BINS = 2000
SEED = 7
SPAN = (-1.0, 2.0)  # raw scores outside count in the first or last bin

_UPPER, _LOWER = byte_set(bytes(range(65, 91))), byte_set(bytes(range(97, 123)))
_CLASSES = [
    _UPPER, _LOWER, byte_set(bytes(range(48, 58))), byte_set(b" "), byte_set(b"\n"), byte_set(b"#*$%&|<>"),
    byte_set(b"!?"), byte_set(b".,;:"), byte_set(b"\"'()[]{}-_/\\=+@^~`"), byte_set(bytes(range(128, 256))),
]
N_STATISTICS = len(_CLASSES) + 9


def _per_text(values: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(owner, weights=values, minlength=n)


def _distinct(hashes: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of each text and the count of its most frequent one."""
    key, first, count = np.unique(hashes ^ mix(owner.astype(np.uint64)), return_index=True, return_counts=True)
    most = np.zeros(n)
    np.maximum.at(most, owner[first], count)
    return np.bincount(owner[first], minlength=n).astype(float), most


def statistics(column: pa.Array) -> np.ndarray:
    """A row of numbers for each text: shares of byte classes, word and line shapes, repetition."""
    out = np.zeros((len(column), N_STATISTICS))
    for first, end, raw, at in chunks(column):
        n = end - first
        size = np.maximum(np.diff(at), 1)
        rows = out[first:end]
        for k, flags in enumerate(_CLASSES):
            sums = np.concatenate([[0], np.cumsum(flags[raw], dtype=np.int64)])
            rows[:, k] = (sums[at[1:]] - sums[at[:-1]]) / size
        starts, ends, owner = runs(~BLANKS[raw], at)
        n_words = np.bincount(owner, minlength=n)
        words = np.maximum(n_words, 1)
        points = code_points(raw)
        length = (points[ends] - points[starts]).astype(float)
        mean = _per_text(length, owner, n) / words
        hashes = word_hashes(raw, starts, ends)
        distinct, most = _distinct(hashes, owner, n)
        place, triples = window_hashes(hashes, owner, 3)
        distinct3, most3 = _distinct(triples, owner[place], n)
        n_triples = np.maximum(n_words - 2, 1)
        capital = _UPPER[raw[starts]] if len(starts) else np.zeros(0)
        shouted = (_UPPER[raw[starts]] & _UPPER[raw[ends - 1]]) if len(starts) else np.zeros(0)
        base = len(_CLASSES)
        columns = [
            np.log1p(np.diff(at)), mean, np.sqrt(np.maximum(_per_text(length**2, owner, n) / words - mean**2, 0)),
            np.log1p(distinct) / np.log1p(words), most / words, distinct3 / n_triples, most3 / n_triples,
            _per_text(capital, owner, n) / words, _per_text(shouted, owner, n) / words,
        ]
        for k, values in enumerate(columns):
            rows[:, base + k] = values
    return out


@dataclass(frozen=True)
class Model:
    centre: np.ndarray
    scale: np.ndarray
    weights: np.ndarray  # of the Fourier features and the constant
    knots: np.ndarray  # raw scores, ascending
    values: np.ndarray  # calibrated scores, ascending

    def features(self, rows: np.ndarray) -> np.ndarray:
        return fourier((rows - self.centre) / self.scale)

    def raw(self, rows: np.ndarray) -> np.ndarray:
        return self.features(rows) @ self.weights

    def score(self, rows: np.ndarray) -> np.ndarray:
        return np.interp(self.raw(rows), self.knots, self.values)


def fourier(rows: np.ndarray) -> np.ndarray:
    """Random cosine features and a constant; extreme statistics are drawn in to six deviations."""
    rng = np.random.default_rng(SEED)
    directions = rng.normal(size=(N_STATISTICS, FEATURES)) / WIDTH
    shift = rng.uniform(0, 2 * np.pi, FEATURES)
    wave = np.cos(np.clip(rows, -6, 6) @ directions + shift) * np.sqrt(2 / FEATURES)
    return np.hstack([wave, np.ones((len(rows), 1))])


def isotonic(x: np.ndarray, total: np.ndarray, good: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators over ascending x: block means of x and of the labels."""
    blocks: list[list[float]] = []
    for a, n, g in zip(x, total, good, strict=True):
        blocks.append([a * n, n, g])
        while len(blocks) > 1 and blocks[-2][2] * blocks[-1][1] >= blocks[-1][2] * blocks[-2][1]:
            last = blocks.pop()
            blocks[-1] = [p + q for p, q in zip(blocks[-1], last, strict=True)]
    b = np.array(blocks)
    return b[:, 0] / b[:, 1], b[:, 2] / b[:, 1]


def _rows(column: pa.ListArray) -> np.ndarray:
    return np.asarray(column.flatten(), np.float64).reshape(-1, N_STATISTICS)


def with_statistics(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    def scan(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = statistics(batch.column(1))
        lists = pa.FixedSizeListArray.from_arrays(pa.array(rows.ravel()), N_STATISTICS).cast(pa.list_(pa.float64()))
        return pa.RecordBatch.from_arrays([batch.column(0), lists], ["doc_id", "statistics"])

    named = pick(docs, doc_id=doc_id, text=text).withColumn("doc_id", F.col("doc_id").cast("bigint"))
    return map_batches(named, scan, "doc_id bigint, statistics array<double>")


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality") -> Model:
    """Learn from all labelled rows that are not held out: crc32 remainder 0 fits, 2 calibrates.

    Rows without an id or a label teach nothing.  Without any labelled row every score is 0.5; with
    rows of one fold only, that fold serves both ends.
    """
    answers = pick(labels, doc_id=doc_id, label=label).where("doc_id is not null and label is not null")
    answers = answers.where(~held_out(F.col("doc_id"))).withColumn("doc_id", F.col("doc_id").cast("bigint"))
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3
    # texts that are held out teach nothing: they go before statistics are taken of them
    texts = docs.where(F.col(f"`{doc_id}`").isNotNull() & ~held_out(F.col(f"`{doc_id}`")))
    rows = with_statistics(texts, doc_id, text).join(answers, "doc_id")
    rows = stage(rows.select("statistics", F.col("label").cast("double").alias("label"), (fold == 0).alias("fits")))

    known = rows.groupBy("fits").agg(
        F.count("*").alias("n"),
        *[f(F.col("statistics")[k]).alias(f"{p}{k}") for k in range(N_STATISTICS) for p, f in (("m", F.avg), ("s", F.stddev_pop))],
    ).collect()
    if not known:
        zero = np.zeros(N_STATISTICS)
        return Model(zero, zero + 1, np.zeros(FEATURES + 1), np.array([0.0]), np.array([0.5]))
    by = {r["fits"]: r for r in known}
    r = by.get(True) or by[False]
    centre = np.array([r[f"m{k}"] for k in range(N_STATISTICS)])
    scale = np.array([max(r[f"s{k}"], 1e-6) for k in range(N_STATISTICS)])
    both = len(by) == 2
    weights = _solve(rows.where("fits") if both else rows, centre, scale, r["n"])
    raw = Model(centre, scale, weights, np.array([0.0]), np.array([0.5])).raw
    knots, values = _calibrate(rows.where("not fits") if both else rows, raw)
    return Model(centre, scale, weights, knots, values)


def _solve(rows: DataFrame, centre: np.ndarray, scale: np.ndarray, n: int) -> np.ndarray:
    """Ridge weights from normal equations that partitions sum for themselves and Spark cell by cell."""
    size = FEATURES + 2  # features, constant, label

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size))
        for batch in batches:
            for first in range(0, batch.num_rows, 4096):
                part = batch.slice(first, 4096)
                label = np.asarray(part.column(1), np.float64)
                z = np.column_stack([fourier((_rows(part.column(0)) - centre) / scale), label])
                total += z.T @ z
        i, j = np.triu_indices(size)
        yield pa.RecordBatch.from_arrays([pa.array(i * size + j), pa.array(total[i, j])], ["cell", "value"])

    sums = rows.select("statistics", "label").mapInArrow(add_up, "cell bigint, value double")
    cells = bounded(sums.groupBy("cell").agg(F.sum("value").alias("value")), size * size, "normal equations")
    full = np.zeros((size, size))
    for cell, value in cells:
        full[divmod(cell, size)] = value
    full = np.triu(full) + np.triu(full, 1).T
    gram = full[:-1, :-1] + RIDGE * max(n, 1) * np.eye(size - 1)
    return np.linalg.solve(gram, full[:-1, -1])


def _calibrate(rows: DataFrame, raw) -> tuple[np.ndarray, np.ndarray]:
    low, high = SPAN

    def bins(batch: pa.RecordBatch) -> pa.RecordBatch:
        place = (raw(_rows(batch.column(0))) - low) / (high - low) * BINS
        place = np.clip(place, 0, BINS - 1).astype(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(place), batch.column(1)], ["bin", "label"])

    counted = map_batches(rows.select("statistics", "label"), bins, "bin bigint, label double")
    found = bounded(counted.groupBy("bin").agg(F.count("*").alias("n"), F.sum("label").alias("good")), BINS, "bins")
    found.sort()
    b = np.array([(bin_, n, good) for bin_, n, good in found], float)
    return isotonic(low + (b[:, 0] + 0.5) * (high - low) / BINS, b[:, 1], b[:, 2])


def score(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, score and predicted of every document.

    Null or empty texts have the score of an empty text; a null id is not held out; repeated rows
    give repeated rows; labels, language, source and id are not inputs of the score.
    """

    def scan(batch: pa.RecordBatch) -> pa.RecordBatch:
        scores = np.clip(model.score(statistics(batch.column(1))), 0.0, 1.0)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores)], ["doc_id", "score"])

    named = pick(docs, doc_id=doc_id, text=text).withColumn("doc_id", F.col("doc_id").cast("bigint"))
    scored = map_batches(named, scan, "doc_id bigint, score double")
    predicted = (F.col("score") >= 0.5).cast("int").alias("predicted")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", predicted)


def keep_good(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows, with all their columns, that ``model`` scores 0.5 or more."""
    place = docs.columns.index(text)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(model.score(statistics(batch.column(place))) >= 0.5))

    return docs.mapInArrow(scan, docs.schema)
