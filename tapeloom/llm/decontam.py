"""Benchmark decontamination: a prefix-filtered join of item windows with document words.

A window of an item occurs in a document only if its rarest shingle does.  So each window is filed
under that one shingle (its necessary prefix, by counts over all documents), documents offer the
places of such shingles with the words around them, and the join then bounds the place of the
window and compares its words exactly.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeloom.llm.arrays import FOLDED_PUNCTUATION, chunks, runs, window_hashes, word_hashes
from tapeloom.llm.frames import bounded, filter_bits, fresh, map_batches, numbered, pick, stage

WINDOW = 10  # words; a shorter item is one window
SHINGLE = 3  # words; a shorter item is one shingle
FILTER_BITS = 23  # least address bits of the filter that tasks hold (1 MB); more shingles have more, up to 32 MB

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


def _words(raw: np.ndarray, at: np.ndarray):
    starts, ends, owner = runs(~FOLDED_PUNCTUATION[raw], at)
    return starts, ends, owner, word_hashes(raw, starts, ends)


def _joiner(raw: np.ndarray):
    folded = _FOLD[raw].tobytes()

    def join(starts, ends) -> str:
        return " ".join(folded[a:b].decode() for a, b in zip(starts, ends, strict=True))

    return join


def item_windows(items: DataFrame, item_id: str, text: str, window: int, shingle: int) -> DataFrame:
    """A row for each shingle of each window: item, window words, size, the shingle's hash and offset."""

    def scan(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows: list[tuple] = []
        ids = batch.column(0).to_pylist()
        for first, _, raw, at in chunks(batch.column(1)):
            starts, ends, owner, hashes = _words(raw, at)
            join = _joiner(raw)
            for k in range(len(at) - 1):
                lo, hi = np.searchsorted(owner, [k, k + 1])
                n = hi - lo
                if not n:
                    continue
                size, part = min(n, window), min(n, shingle)
                _, keys = window_hashes(hashes[lo:hi], owner[lo:hi], part)
                keys = keys.view(np.int64).tolist()
                for w in range(n - size + 1):
                    words = join(starts[lo + w : lo + w + size], ends[lo + w : lo + w + size])
                    rows += [(ids[first + k], words, size, part, keys[w + o], o) for o in range(size - part + 1)]
        columns = list(zip(*rows, strict=True)) or [()] * 6
        kinds = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int32()]
        names = ["item_id", "words", "size", "part", "key", "offset"]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)

    named = pick(items, item_id=item_id, text=text).withColumn("item_id", F.col("item_id").cast("string"))
    schema = "item_id string, words string, size int, part int, key bigint, offset int"
    return map_batches(named, scan, schema)


def _filter_of(keys: DataFrame) -> tuple[np.ndarray, list[int]]:
    """A bitmap of the low bits of ``key`` and the shingle sizes in use."""
    size = filter_bits(keys.select("key").distinct().count(), FILTER_BITS)
    slot = F.col("key").bitwiseAND(F.lit((1 << size) - 1))
    bit = F.expr("shiftleft(1L, cast(key & 63 as int))")
    words = keys.groupBy(F.shiftright(slot, 6).alias("word")).agg(F.bit_or(bit).alias("bits")).toArrow()
    bitmap = np.zeros(1 << (size - 6), np.int64)
    bitmap[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    parts = [r[0] for r in bounded(keys.select("part").distinct(), 64, "shingle sizes")]
    return bitmap.view(np.uint64), sorted(parts)


def _passing(bitmap: np.ndarray, keys: np.ndarray) -> np.ndarray:
    slot = (keys & np.uint64(64 * len(bitmap) - 1)).astype(np.int64)
    return (bitmap[slot >> 6] >> (slot & 63).astype(np.uint64)) & np.uint64(1) == 1


def shingle_counts(docs: DataFrame, text: str, bitmap: np.ndarray, parts: list[int]) -> DataFrame:
    """How often the shingles that pass the filter occur in all documents."""

    def scan(batch: pa.RecordBatch) -> pa.RecordBatch:
        kept = [np.zeros(0, np.uint64)]
        for _, _, raw, at in chunks(batch.column(0)):
            _, _, owner, hashes = _words(raw, at)
            for part in parts:
                _, keys = window_hashes(hashes, owner, part)
                kept.append(keys[_passing(bitmap, keys)])
        keys, n = np.unique(np.concatenate(kept), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n)], ["key", "n"])

    counted = map_batches(pick(docs, text=text), scan, "key bigint, n bigint")
    return counted.groupBy("key").agg(F.sum("n").alias("n"))


def _scan_documents(docs: DataFrame, doc_id: str, text: str, bitmap, parts: list[int], window: int) -> DataFrame:
    """Words of each document and the places of filed shingles with the words around them."""
    place_type = pa.struct([("key", pa.int64()), ("at", pa.int32()), ("first", pa.int32()), ("around", pa.string())])

    def scan(batch: pa.RecordBatch) -> pa.RecordBatch:
        n_words, prints, places = [], [], []
        for _, _, raw, at in chunks(batch.column(1)):
            starts, ends, owner, hashes = _words(raw, at)
            join = _joiner(raw)
            n = len(at) - 1
            lows = np.searchsorted(owner, np.arange(n + 1))
            n_words.append(np.diff(lows))
            filled = np.flatnonzero(np.diff(at))
            whole = np.zeros(n, np.uint64)
            whole[filled] = word_hashes(raw, at[filled], at[filled + 1], fold=False)
            prints.append(whole.view(np.int64))
            own: list[list] = [[] for _ in range(n)]
            for part in parts:
                place, keys = window_hashes(hashes, owner, part)
                hit = np.flatnonzero(_passing(bitmap, keys))
                for p, key in zip(place[hit].tolist(), keys[hit].view(np.int64).tolist(), strict=True):
                    k = int(owner[p])
                    a, b = max(lows[k], p - window + part), min(lows[k + 1], p + window)
                    own[k].append({"key": key, "at": p - lows[k], "first": a - lows[k], "around": join(starts[a:b], ends[a:b])})
            places += own
        columns = [batch.column(0), pa.array(np.concatenate(prints)), pa.array(np.concatenate(n_words))]
        return pa.RecordBatch.from_arrays(
            [*columns, pa.array(places, pa.list_(place_type))], ["doc_id", "print", "n_words", "places"],
        )

    schema = "doc_id bigint, print bigint, n_words bigint, places array<struct<key: bigint, at: int, first: int, around: string>>"
    named = pick(docs, doc_id=doc_id, text=text).withColumn("doc_id", F.col("doc_id").cast("bigint"))
    return map_batches(named, scan, schema)


def contamination(
    docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id",
    item_text: str = "text", window: int = WINDOW, shingle: int = SHINGLE,
) -> DataFrame:
    """doc_id, n_words, n_hit (words inside occurrences of windows), the sorted ``items`` of each document and their number.

    Null and empty texts have no words; items without words occur nowhere; items without an id count for
    n_hit and, all together, as one of n_items, but are not in ``items``; repeated items and
    documents are judged alike; an empty benchmark hits nothing; other columns are not read.
    """
    shingles = stage(item_windows(items, item_id, item_text, window, shingle))
    bitmap, parts = _filter_of(shingles)
    counts = shingle_counts(docs, text, bitmap, parts)
    rarest = F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "key", "offset", "part")).alias("rare")
    windows = shingles.join(counts, "key", "left").groupBy("words", "size").agg(rarest)
    windows = stage(windows.select("words", "size", "rare.key", "rare.offset", "rare.part"))
    bitmap, parts = _filter_of(windows)
    scanned = stage(_scan_documents(docs, doc_id, text, bitmap, parts, window))

    places = scanned.where(F.size("places") > 0).select("doc_id", "print", "n_words", F.inline("places"))
    start = F.col("at") - F.col("offset")
    fits = (start >= F.col("first")) & (start + F.col("size") <= F.col("n_words"))
    inside = F.array_join(F.slice(F.split("around", " "), start - F.col("first") + 1, F.col("size")), " ")
    found = places.join(windows, "key").where(fits).where(inside == F.col("words"))
    found = found.select("doc_id", "print", "words", start.alias("start"), "size")
    hits = found.groupBy("doc_id", "print").agg(
        F.size(F.array_distinct(F.flatten(F.collect_set(F.expr("sequence(start, start + size - 1)"))))).cast("bigint").alias("n_hit"),
    )
    owners = shingles.select("item_id", "words").distinct()
    named = found.select("doc_id", "print", "words").distinct().join(owners, "words")
    nameless = F.max(F.col("item_id").isNull().cast("bigint"))
    named = named.groupBy("doc_id", "print").agg(
        F.sort_array(F.collect_set("item_id")).alias("items"), (F.size(F.collect_set("item_id")) + nameless).alias("n_items"),
    )
    own = {"doc_id": "own_id", "print": "own_print"}
    same = F.col("print").eqNullSafe(F.col("own_print")) & F.col("doc_id").eqNullSafe(F.col("own_id"))
    joined = scanned.drop("places").join(hits.withColumnsRenamed(own), same, "left").drop("own_id", "own_print")
    joined = joined.join(named.withColumnsRenamed(own), same, "left")
    return joined.select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        F.coalesce("n_items", F.lit(0)).cast("bigint").alias("n_items"),
    )


def drop_contaminated(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """The documents without any occurrence of a benchmark window; each row is judged by its own text.

    Rows are told apart by a key of their own: ``doc_id`` may be null or shared and is not read.
    """
    rows, key = numbered(docs)
    hit = fresh(rows, "hit_key")
    hits = contamination(rows, items, doc_id=key).where("n_hit > 0").select(F.col("doc_id").alias(hit))
    return rows.join(hits, F.col(key) == F.col(hit), "left_anti").drop(key)
