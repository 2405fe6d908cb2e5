"""Exact substring deduplication by a depth-limited radix sort of suffixes.

Only suffixes at anchors are sorted: every window of ``LENGTH`` bytes has one, chosen by its content
alone (the rightmost least hash of its grams), so equal windows have equal anchors at equal places.
Digits are taken most significant first, and a bucket of one suffix is never looked at again:
the first digit is the gram at the anchor, the second all the text that windows over the anchor can
reach.  Suffixes equal in both are repeated in full.  What is left splits, in the last pass, by
whole windows; groups of two or more are exactly the repeated ones.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeloom.llm.arrays import _CODES, chunks, mix, powers
from tapeloom.llm.frames import pick, stage
from tapeloom.llm.neardup import whole_groups

LENGTH = 400  # bytes of a repeated window
GRAM = 200  # bytes of the first digit
REACH = LENGTH - GRAM  # bytes before an anchor that a window over it can reach
PIECE = 1 << 20  # bytes handled at a time; longer texts are cut into overlapping pieces
BUCKET = 8192  # contexts of one anchor compared in one task; more are exploded into windows

_BASE = np.uint64(0x2545F4914F6CDD1D)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_PLACE_BITS = 22


class _Rolling:
    """Hashes of any byte range of one buffer."""

    def __init__(self, raw: np.ndarray, tables: tuple[np.ndarray, np.ndarray]) -> None:
        self.sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(_CODES[raw] * tables[0][: len(raw)], out=self.sums[1:])
        self.inverse = tables[1]

    def __call__(self, first: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[first]) * self.inverse[first])

    def grams(self, size: int) -> np.ndarray:
        n = len(self.sums) - size
        return mix((self.sums[size:] - self.sums[:n]) * self.inverse[:n]) if n > 0 else np.zeros(0, np.uint64)


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    return powers(n, _BASE), powers(n, _INVERSE)


def _sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    n = len(values) - width + 1
    rows = -(-len(values) // width)
    padded = np.full(rows * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(values)] = values
    block = padded.reshape(rows, width)
    before = np.minimum.accumulate(block, axis=1).ravel()
    after = np.minimum.accumulate(block[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(after[:n], before[width - 1 : width - 1 + n])


def anchors(raw: np.ndarray, at: np.ndarray, tables, starts: tuple[int, int] | None = None):
    """(place, text, gram hash, context hash) of the anchors of all windows; ``starts`` bounds the windows' starts."""
    none = np.zeros(0, np.int64)
    if len(raw) < LENGTH:
        return none, none, none, none
    roll = _Rolling(raw, tables)
    grams = roll.grams(GRAM)
    last = np.uint64((1 << _PLACE_BITS) - 1)
    key = (grams & ~last) | (last - np.arange(len(grams), dtype=np.uint64))
    least = _sliding_least(key, REACH + 1)
    owner = np.repeat(np.arange(len(at) - 1), np.diff(at))[: len(least)]
    fits = np.arange(len(least)) + LENGTH <= at[owner + 1]
    if starts is not None:
        fits[: starts[0]] = False
        fits[starts[1] :] = False
    place = (last - (least[fits] & last)).astype(np.int64)
    owner = owner[fits]
    fresh = np.ones(len(place), bool)
    fresh[1:] = (place[1:] != place[:-1]) | (owner[1:] != owner[:-1])
    place, owner = place[fresh], owner[fresh]
    first, end = np.maximum(at[owner], place - REACH), np.minimum(at[owner + 1], place + LENGTH)
    shape = ((place - first).astype(np.uint64) << np.uint64(32)) | (end - place).astype(np.uint64)
    return place, owner, grams[place], mix(roll(first, end) ^ mix(shape))


def _pieces(n: int) -> Iterator[tuple[int, int, int, int]]:
    """Byte range of each piece of a long text, and the window starts that it answers for."""
    for first in range(0, n, PIECE):
        a, b = max(0, first - LENGTH), min(n, first + PIECE + 2 * LENGTH)
        yield a, b, first - a, min(n, first + PIECE) - a


def _met_here(place: np.ndarray, owner: np.ndarray, at: np.ndarray, gram: np.ndarray, context: np.ndarray):
    """Of anchors with equal gram and context, one and their number; and (text, first, last) of all that are not alone.

    A phrase repeated for a long way has as many equal anchors as phrases; one a chunk goes on, however long.
    """
    order = np.lexsort((context, gram))
    g, c = gram[order], context[order]
    begins = np.flatnonzero(np.concatenate([[True], (g[1:] != g[:-1]) | (c[1:] != c[:-1])]))
    times = np.diff(np.append(begins, len(order)))
    again = np.sort(order[np.repeat(times, times) > 1])
    text, here = owner[again], place[again] - at[owner[again]]
    apart = np.ones(len(again) + 1, bool)
    apart[1:-1] = (text[1:] != text[:-1]) | (np.diff(here) > REACH + LENGTH)
    first, last = np.flatnonzero(apart[:-1]), np.flatnonzero(apart[1:])
    return order[begins], times, (text[first], np.maximum(here[first] - REACH, 0), here[last] + LENGTH)


def _anchor_rows(docs: DataFrame) -> DataFrame:
    """gram, context, key, place and number of the anchors of all texts; a task offers equal texts twice at most.

    Rows without a gram are byte ranges, from place to last, that windows repeated inside one chunk of texts cover.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = _tables(2 * PIECE + 4 * LENGTH)
        seen: dict[int, int] = {}
        for batch in batches:
            keys, fresh = batch.column(0).to_numpy(), np.zeros(batch.num_rows, bool)
            for i, key in enumerate(keys.tolist()):
                seen[key] = times = seen.get(key, 0) + 1
                fresh[i] = times <= 2
            batch = batch.filter(pa.array(fresh))
            keys = batch.column(0).to_numpy()
            for head, end, raw, at in chunks(batch.column(1), PIECE):
                if end - head > 1 or len(raw) <= PIECE:
                    found = [anchors(raw, at, tables)]
                else:
                    found, done = [], -1
                    for a, b, low, high in _pieces(len(raw)):
                        own = anchors(raw[a:b], np.array([0, b - a]), tables, (low, high))
                        new = own[0] + a > done  # the first windows of a piece may share the anchor of the last ones
                        place, *rest = (x[new] for x in own)
                        found.append((place + a, *rest))
                        done = max([done, *(place[-1:] + a).tolist()])
                for place, owner, gram, context in found:
                    if len(place):
                        one, times, (text, first, last) = _met_here(place, owner, at, gram, context)
                        no_hash, no_place = pa.nulls(len(text), pa.int64()), pa.nulls(len(one), pa.int32())
                        suffixes = [gram[one].view(np.int64), context[one].view(np.int64), keys[head:end][owner[one]],
                                    (place - at[owner])[one].astype(np.int32), times.astype(np.int64), no_place]
                        ranges = [no_hash, no_hash, keys[head:end][text], first.astype(np.int32), no_hash, last.astype(np.int32)]
                        for columns in (suffixes, ranges):
                            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names)

    schema = "gram bigint, context bigint, key bigint, place int, times bigint, last int"
    names = [f.split()[0] for f in schema.split(", ")]
    return docs.select("key", "text").mapInArrow(scan, schema)


def _contexts(texts: DataFrame) -> DataFrame:
    """The bytes around each wanted place of the texts."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, text, wanted in zip(*(batch.column(i) for i in range(3)), strict=True):
                data, key = text.as_py().encode(), key.as_py()
                for w in wanted.as_py():
                    first = max(0, w["place"] - REACH)
                    rows.append((w["gram"], key, w["place"], w["n"], w["place"] - first, data[first : w["place"] + LENGTH]))
            if rows:
                kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.binary()]
                columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, ["gram", "key", "place", "n", "before", "bytes"])

    return texts.mapInArrow(scan, "gram bigint, key bigint, place int, n bigint, before int, bytes binary")


def _window_rows(before: np.ndarray, parts: list[bytes], tables) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Context number, bytes from window start to anchor, and hash of every window of the contexts."""
    raw = np.frombuffer(b"".join(parts), np.uint8)
    sizes = np.array([len(p) for p in parts])
    begins = np.cumsum(sizes) - sizes
    lead = np.minimum(before, sizes - LENGTH)
    n = np.maximum(lead + 1, 0)  # windows start at the context's first byte up to the anchor
    row = np.repeat(np.arange(len(parts)), n)
    offset = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    start = begins[row] + offset
    return row, before[row] - offset, _Rolling(raw, tables)(start, start + LENGTH)


def _split_buckets(contexts: DataFrame) -> DataFrame:
    """key, first, last (byte range) that repeated windows over single contexts cover."""

    def pair(x: bytes, xb: int, y: bytes, yb: int) -> tuple[int, int]:
        """Equal bytes before and from the anchor."""
        n = min(xb, yb)
        a, b = np.frombuffer(x[xb - n : xb], np.uint8), np.frombuffer(y[yb - n : yb], np.uint8)
        odd = np.flatnonzero(a[::-1] != b[::-1])
        left = int(odd[0]) if len(odd) else n
        m = min(len(x) - xb, len(y) - yb)
        a, b = np.frombuffer(x[xb : xb + m], np.uint8), np.frombuffer(y[yb : yb + m], np.uint8)
        odd = np.flatnonzero(a != b)
        return left, int(odd[0]) if len(odd) else m

    def few(before, parts) -> dict[int, tuple[int, int]]:
        out: dict[int, tuple[int, int]] = {}
        for i in range(len(parts)):
            for j in range(i):
                left, right = pair(parts[i], before[i], parts[j], before[j])
                if left + right >= LENGTH:
                    right = min(right, LENGTH)
                    for k in (i, j):
                        low, high = out.get(k, (0, 0))
                        out[k] = max(low, left), max(high, right)
        return out

    def many(before, parts, tables) -> dict[int, tuple[int, int]]:
        row, lead, window = _window_rows(np.array(before), parts, tables)
        _, back, count = np.unique(window ^ mix(lead.astype(np.uint64)), return_inverse=True, return_counts=True)
        hit = count[back] > 1
        out: dict[int, tuple[int, int]] = {}
        for k, a in zip(row[hit].tolist(), lead[hit].tolist(), strict=True):
            low, high = out.get(k, (0, 0))
            out[k] = max(low, a), max(high, LENGTH - a)
        return out

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = _tables(BUCKET * (LENGTH + REACH) + 1)
        for table, starts in whole_groups(batches, 1):
            columns = [table.column(i).to_pylist() for i in range(1, 6)]
            rows = []
            for a, b in zip(starts.tolist(), [*starts[1:].tolist(), table.num_rows], strict=True):
                keys, places, n, before, parts = (c[a:b] for c in columns)
                found = few(before, parts) if b - a <= 6 else many(before, parts, tables)
                rows += [(keys[k], places[k] - low, places[k] + high) for k, (low, high) in found.items() if n[k] == 1]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], ["key", "first", "last"])

    listed = contexts.repartition("gram").sortWithinPartitions("gram")
    return listed.mapInArrow(scan, "key bigint, first bigint, last bigint")


def _explode_buckets(contexts: DataFrame) -> DataFrame:
    """As ``_split_buckets``, for anchors with more contexts than a task should hold."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = _tables(500 * (LENGTH + REACH) + 1)
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                part = batch.slice(i, 500)
                row, lead, window = _window_rows(part.column(4).to_numpy(), part.column(5).to_pylist(), tables)
                if len(row):
                    take = pa.array(row)
                    yield pa.RecordBatch.from_arrays(
                        [part.column(0).take(take), part.column(1).take(take), part.column(2).take(take), part.column(3).take(take),
                         pa.array(lead.astype(np.int32)), pa.array(window.view(np.int64))],
                        ["gram", "key", "place", "n", "lead", "window"],
                    )

    windows = contexts.mapInArrow(scan, "gram bigint, key bigint, place int, n bigint, lead int, window bigint")
    again = stage(windows.groupBy("gram", "lead", "window").agg(F.count("*").alias("times")).where("times > 1").drop("times"))
    hit = windows.where("n = 1").join(again, ["gram", "lead", "window"], "left_semi")
    first, last = F.min(F.col("place") - F.col("lead")), F.max(F.col("place") - F.col("lead") + LENGTH)
    return hit.groupBy("key", "place").agg(first.cast("bigint").alias("first"), last.cast("bigint").alias("last")).drop("place")


def repeated_ranges(texts: DataFrame) -> DataFrame:
    """key and the byte ranges (array of first, last; they may overlap) that repeated windows cover.

    ``texts`` has key and text, equal keys for equal texts.
    """
    rows = stage(_anchor_rows(texts))
    offered, met = rows.where("gram is not null").drop("last"), rows.where("gram is null").select("key", "place", "last")
    # written, as mixed below, so that the join reads two plain shuffles and can split the partition of a frequent gram
    repeated = stage(offered.groupBy("gram").agg(F.sum("times").alias("times")).where("times > 1").drop("times"))
    suffixes = stage(offered.join(repeated, "gram", "left_semi"))

    by_context = suffixes.groupBy("gram", "context").agg(F.sum("times").alias("n"), F.min(F.struct("key", "place")).alias("one"))
    by_context = stage(by_context)
    whole = by_context.where("n > 1").select("gram", "context")
    # no distinct here: it would hold the join to its partitions, and a frequent context to one of them
    covered = suffixes.where("times = 1").join(whole, ["gram", "context"], "left_semi")
    place = F.col("place").cast("bigint")
    covered = covered.select("key", F.greatest(place - REACH, F.lit(0)).alias("first"), (place + LENGTH).alias("last"))
    covered = covered.unionByName(met.select("key", place.alias("first"), F.col("last").cast("bigint")))

    mixed = by_context.groupBy("gram").agg(F.count("*").alias("contexts"), F.min("n").alias("least"))
    mixed = stage(mixed.where("contexts > 1 and least = 1").select("gram", "contexts"))
    wanted = by_context.join(mixed, "gram").select("one.key", F.struct("gram", "one.place", "n").alias("wanted"), "contexts")
    wanted = wanted.groupBy("key").agg(F.collect_list(F.struct("wanted.*", "contexts")).alias("wanted"))
    single = texts.dropDuplicates(["key"]).join(wanted, "key").select("key", "text", "wanted")
    hot = mixed.where(F.col("contexts") > BUCKET).select("gram")
    contexts = stage(_contexts(single))
    some = _split_buckets(contexts.join(hot, "gram", "left_anti"))
    ranges = covered.unionByName(some)
    if not hot.isEmpty():
        ranges = ranges.unionByName(_explode_buckets(contexts.join(hot, "gram", "left_semi")))
    return ranges.groupBy("key").agg(F.collect_set(F.struct("first", "last")).alias("ranges"))


def _merged(ranges: list[dict], n: int) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for first, last in sorted((r["first"], min(r["last"], n)) for r in ranges):
        if out and first <= out[-1][1]:
            out[-1][1] = max(out[-1][1], last)
        else:
            out.append([first, last])
    return [(a, b) for a, b in out]


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", kept_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every text (and ``kept``, its remaining bytes).

    A byte goes if it lies in a string of 400 bytes that also starts elsewhere, in the same or another
    text, judged on the input.  Null and empty texts have no bytes; shorter texts lose nothing;
    repeated rows lose everything from 400 bytes on; null ids stay null; other columns are not read.
    """
    named = pick(docs, doc_id=doc_id, text=text).select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    named = named.withColumn("key", F.xxhash64("text"))
    ranges = repeated_ranges(named.where(F.octet_length("text") >= LENGTH).select("key", "text"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, found in zip(batch.column(1), batch.column(2), strict=True):
                data = text.as_py().encode()
                spans = _merged(found.as_py() or [], len(data))
                ends = [0, *[x for span in spans for x in span], len(data)]
                kept = b"".join(data[a:b] for a, b in zip(ends[::2], ends[1::2], strict=True))
                rows.append((len(data), len(data) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), kept if kept_text else b""))
            if rows:
                columns = list(zip(*rows, strict=True))[: 5 if kept_text else 4]
                yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, columns)], names)

    schema = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string" + ", kept binary" * kept_text
    names = [f.split()[0] for f in schema.split(", ")]
    joined = named.join(ranges, "key", "left").select("doc_id", "text", "ranges")
    return joined.mapInArrow(cut, schema)
