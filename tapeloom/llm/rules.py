"""Quality rules: compression bands over whole documents and fixed chunks, beside counting rules.

A zstandard ratio far below that of prose of the same length means repetition, one far above it
means noise (keys, encoded bytes).  Short texts compress badly, so each length has its own limits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeloom.llm.arrays import BLANKS, byte_set, chunks, code_points, mix, runs, window_hashes, word_hashes
from tapeloom.llm.frames import map_batches, pick

#: (bytes from, lowest ratio, highest ratio); the last row whose first number fits holds
BANDS = (
    (0, 0.0, 99.0), (64, 0.45, 99.0), (128, 0.38, 1.10), (256, 0.42, 0.95), (512, 0.40, 0.85),
    (1024, 0.36, 0.74), (2048, 0.33, 0.70), (4096, 0.30, 0.68), (16384, 0.27, 0.66),
)
CHUNK_BYTES = 4096
CHUNK_SHARE = 0.5  # of the chunks of a document that may lie outside their limits
LEVEL = 3
SYMBOLS = byte_set(b"#*$%&|<>")
REPEAT_WORDS = 8

_COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
SCHEMA = "doc_id bigint, " + ", ".join(f"{c} bigint" for c in _COUNTS) + ", ratio double, ratio_fits boolean, n_chunks bigint, n_chunks_out bigint"


def limits(n: int, bands=BANDS) -> tuple[float, float]:
    low, high = bands[0][1:]
    for least, a, b in bands:
        if n >= least:
            low, high = a, b
    return low, high


def _sums(values: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(owner, weights=values, minlength=n).astype(np.int64)


def _text_counts(raw: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    """Words, code points in words, symbols, repeated lines and repeated window words of each text."""
    n = len(at) - 1
    starts, ends, owner = runs(~BLANKS[raw], at)
    points = code_points(raw)
    symbols = np.concatenate([[0], np.cumsum(SYMBOLS[raw])])

    lines_from, lines_to, line_owner = runs(raw != 0x0A, at)
    words_before = np.searchsorted(starts, lines_to) - np.searchsorted(starts, lines_from)
    spoken = words_before > 0
    key = word_hashes(raw, lines_from[spoken], lines_to[spoken], fold=False) ^ mix(line_owner[spoken].astype(np.uint64))
    _, first = np.unique(key, return_index=True)
    again = np.ones(len(key), bool)
    again[first] = False

    hashes = word_hashes(raw, starts, ends, fold=False)
    place, window = window_hashes(hashes, owner, REPEAT_WORDS)
    _, back, count = np.unique(window ^ mix(owner[place].astype(np.uint64)), return_inverse=True, return_counts=True)
    hit = place[count[back] > 1]
    cover = np.zeros(len(starts) + 1, np.int64)
    np.add.at(cover, hit, 1)
    np.add.at(cover, hit + REPEAT_WORDS, -1)
    repeated = np.cumsum(cover[:-1]) > 0
    return [
        np.bincount(owner, minlength=n), _sums(points[ends] - points[starts], owner, n),
        symbols[at[1:]] - symbols[at[:-1]], _sums(again, line_owner[spoken], n), _sums(repeated, owner, n),
    ]


def _compression(text: bytes, pack: zstandard.ZstdCompressor, bands) -> tuple[float, bool, int, int]:
    """Ratio of the whole, whether it fits, chunks, chunks outside their limits."""
    if not text:
        return 1.0, True, 0, 0
    whole = len(pack.compress(text)) / len(text)
    if len(text) <= CHUNK_BYTES:
        parts = [(len(text), whole)]
    else:
        pieces = (text[i : i + CHUNK_BYTES] for i in range(0, len(text), CHUNK_BYTES))
        parts = [(len(p), len(pack.compress(p)) / len(p)) for p in pieces]
    fits = [low <= r <= high for m, r in [(len(text), whole), *parts] for low, high in [limits(m, bands)]]
    return whole, fits[0], len(parts), len(parts) - sum(fits[1:])


def rule_counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", bands=BANDS) -> DataFrame:
    """One row per document: counts, whole ratio, chunks and chunks outside their limits.

    A null or empty text has zero counts, ratio 1 and no chunks; a null id stays null; repeated
    rows give repeated rows; columns other than the two named are not read.
    """

    def scan(batch: pa.RecordBatch) -> pa.RecordBatch:
        pack = zstandard.ZstdCompressor(level=LEVEL)
        counts, packed = [], []
        for _, _, raw, at in chunks(batch.column(1)):
            counts.append(_text_counts(raw, at))
            data = raw.tobytes()
            packed += [_compression(data[a:b], pack, bands) for a, b in zip(at[:-1], at[1:], strict=True)]
        columns = [np.concatenate([c[i] for c in counts]) for i in range(len(_COUNTS))]
        columns += [np.array(x) for x in zip(*packed, strict=True)]
        names = ["doc_id", *_COUNTS, "ratio", "ratio_fits", "n_chunks", "n_chunks_out"]
        return pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, columns)], names)

    return map_batches(pick(docs, doc_id=doc_id, text=text).withColumn("doc_id", F.col("doc_id").cast("bigint")), scan, SCHEMA)


def quality_rules(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", bands=BANDS) -> DataFrame:
    """Counts of every document with ``base_failed`` and ``kept``; see ``rule_counts`` for odd rows.

    ``kept`` needs the base rules, a whole ratio inside the limits of the document's length, and at
    most half of its chunks outside the limits of theirs.  Empty texts fail the base rule.
    """
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    inside = F.col("ratio_fits") & (F.col("n_chunks_out") <= CHUNK_SHARE * F.col("n_chunks"))
    return rule_counts(docs, doc_id, text, bands).withColumn("base_failed", failed).withColumn("kept", ~failed & inside)
