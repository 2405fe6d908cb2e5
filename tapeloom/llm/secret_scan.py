"""Secret scans: fixed patterns, and random-looking strings found by two character Markov models.

One model learns random strings, the other ordinary identifiers.  The labelled samples are the
corpus' own: the values that the fixed patterns find are random but for those that look like words, other
runs of identifier characters, the names of keys among them, are ordinary but for what looks random in them.  A run, or a long enough part of one, whose log-likelihood ratio per character passes a
threshold is a secret too; the fixed patterns' finds are cut out of runs first.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeloom.llm.arrays import byte_set, chunks, code_points, runs
from tapeloom.llm.frames import bounded, map_batches, pick

# fixed values: kinds in their order, patterns and least lengths
KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(
    rb"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]"
    rb"|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
MIN_ASSIGN, MIN_ACCESS, MIN_HEX = 6, 20, 24
WORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")

LETTERS = b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
SIZE = len(LETTERS) + 1  # the last symbol begins a string
MIN_SAMPLE = 8  # characters of a run that teaches
MIN_RUN = 20  # characters of a run that is judged
THRESHOLD = 2.25  # nats for each character
MIN_DISTINCT = 8  # different characters of a random string: rulers such as "=====" have few
SMOOTHING = 1.0
SWITCHES = 0.28  # share of changes of kind (lower to upper case, letter to digit or back) from which a stretch teaches no ordinary run

_CODE = np.full(256, SIZE - 1, np.int64)
_CODE[list(LETTERS)] = np.arange(len(LETTERS))
_IN_RUN = byte_set(LETTERS)
_KIND = np.zeros(256, np.int8)  # 0 separators
_KIND[list(LETTERS[:26])], _KIND[list(LETTERS[26:52])], _KIND[list(LETTERS[52:62])] = 1, 2, 3
_IS_CUT = byte_set(b"=/_-")
_HEX = byte_set(b"0123456789abcdef")


@dataclass(frozen=True)
class Models:
    """Log-likelihood ratio, random over ordinary, of a character after the two before it."""

    ratio: np.ndarray


def base_spans(data: bytes, raw: np.ndarray, at: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, kind number, end) by byte of what the fixed patterns find within each text, ascending."""
    found: list[tuple[int, int, int]] = []
    lowered = data.lower()
    first_key, first_access = any(w in lowered for w in WORDS), b"AKIA" in data
    if first_key or first_access:
        for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            if first_key and any(lowered.find(w, a, b) >= 0 for w in WORDS):
                found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(data, a, b) if m.end(2) - m.start(2) >= MIN_ASSIGN]
            if first_access and data.find(b"AKIA", a, b) >= 0:
                found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(data, a, b) if m.end() - m.start() >= MIN_ACCESS]
    starts, ends, _ = runs(_HEX[raw], at)
    long = ends - starts >= MIN_HEX
    found += [(a, 2, b) for a, b in zip(starts[long].tolist(), ends[long].tolist(), strict=True)]
    return sorted(found)


def _base_bytes(size: int, spans: list[tuple[int, int, int]]) -> np.ndarray:
    """Which bytes lie in a base span."""
    inside = np.zeros(size, bool)
    for a, _, b in spans:
        inside[a:b] = True
    return inside


def _value_bytes(data: bytes, spans: list[tuple[int, int, int]]) -> np.ndarray:
    """Which bytes lie in the secret part of a base span: the value of a key, not its name."""
    inside = np.zeros(len(data), bool)
    for a, kind, b in spans:
        inside[ASSIGN.match(data, a, b).start(2) if kind == 0 else a : b] = True
    return inside


def _triples(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Transition cells of the characters of runs, and the run of each."""
    sizes = ends - starts
    place = np.repeat(starts, sizes) + np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    into = place - np.repeat(starts, sizes)
    code = _CODE[raw[place]]
    one = np.where(into > 0, np.roll(code, 1), SIZE - 1)
    two = np.where(into > 1, np.roll(code, 2), SIZE - 1)
    return (two * SIZE + one) * SIZE + code, np.repeat(np.arange(len(starts)), sizes)


def _switches(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which characters of runs change kind; a lower-case letter after a capital does not."""
    sizes = ends - starts
    begins = np.cumsum(sizes) - sizes
    kind = _KIND[raw[np.repeat(starts - begins, sizes) + np.arange(sizes.sum())]]
    last = np.roll(kind, 1)
    changed = (kind != last) & (kind > 0) & (last > 0) & ~((last == 2) & (kind == 1))
    changed[begins] = False
    return changed


def _inside_windows(values: np.ndarray, sizes: np.ndarray, limit: float) -> np.ndarray:
    """Which characters lie in a window of ``MIN_RUN`` characters, or a shorter run, whose mean passes ``limit``."""
    total = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
    ends = np.repeat(np.cumsum(sizes), sizes)
    first = np.arange(len(values))
    last = first + np.repeat(np.minimum(sizes, MIN_RUN), sizes)
    first, last = first[last <= ends], last[last <= ends]
    hit = total[last] - total[first] > limit * (last - first)
    step = np.bincount(first[hit], minlength=len(total)) - np.bincount(last[hit], minlength=len(total))
    return np.cumsum(step)[:-1] > 0


def train(docs: DataFrame, text: str = "text", threshold: float = THRESHOLD) -> Models:
    """Count transitions of both kinds of runs in all texts; the tables have ``SIZE`` cubed cells.

    What looks random teaches no ordinary run, so that secrets which no pattern knows stay improbable
    there however frequent they are: first runs with a stretch that often changes between cases and
    digits are left out, then also those with one which the models learnt in this way find random.  Likewise no
    value of one kind of characters throughout, such as a word, teaches the random model, nor, the second
    time, one that the models find ordinary.  Without samples of a
    kind its model is uniform, so an empty corpus finds nothing by ratio.
    """
    return _fit(docs, text, _fit(docs, text, None, threshold), threshold)


def _fit(docs: DataFrame, text: str, known: Models | None, threshold: float) -> Models:
    """Models of one pass; those of the pass before tell which runs are not ordinary."""

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        cells = np.zeros(2 * SIZE**3, np.int64)
        for _, _, raw, at in chunks(batch.column(0)):
            data = raw.tobytes()
            in_run, in_value = _IN_RUN[raw], _value_bytes(data, base_spans(data, raw, at))
            for kind, inside in enumerate((in_run & ~in_value, in_run & in_value)):
                starts, ends, _ = runs(inside, at)
                long = ends - starts >= MIN_SAMPLE
                starts, ends = starts[long], ends[long]
                cell, run = _triples(raw, starts, ends)
                if kind == 0 and len(cell):
                    odd = _inside_windows(_switches(raw, starts, ends), ends - starts, SWITCHES)
                    if known is not None:
                        odd |= _inside_windows(known.ratio[cell], ends - starts, threshold)
                    cell = cell[np.bincount(run, weights=odd)[run] == 0]
                elif len(cell):
                    mixed = np.bincount(run, weights=_switches(raw, starts, ends)) > 0
                    if known is not None:
                        mixed &= np.bincount(run, weights=known.ratio[cell]) > 0
                    cell = cell[mixed[run]]
                cells[kind * SIZE**3 : (kind + 1) * SIZE**3] += np.bincount(cell, minlength=SIZE**3)
        used = np.flatnonzero(cells)
        return pa.RecordBatch.from_arrays([pa.array(used), pa.array(cells[used])], ["cell", "n"])

    counted = map_batches(pick(docs, text=text), count, "cell bigint, n bigint")
    sums = bounded(counted.groupBy("cell").agg(F.sum("n").alias("n")), 2 * SIZE**3, "transition cells")
    table = np.zeros(2 * SIZE**3)
    for cell, n in sums:
        table[cell] = n
    logs = []
    for kind, counts in enumerate(table.reshape(2, SIZE, SIZE, SIZE)):
        # a character after two others falls back on the character after one, and that on its share;
        # random strings may use the whole alphabet, whatever the samples use
        one = counts.sum(0)
        share = (one.sum(0) + SMOOTHING) / (one.sum() + SMOOTHING * SIZE) if kind == 0 else np.full(SIZE, 1 / SIZE)
        short = (one + SMOOTHING * SIZE * share) / (one.sum(1, keepdims=True) + SMOOTHING * SIZE)
        full = (counts + SMOOTHING * SIZE * short) / (counts.sum(2, keepdims=True) + SMOOTHING * SIZE)
        logs.append(np.log(full if kind == 0 else (full + 1 / SIZE) / 2))
    return Models((logs[1] - logs[0]).ravel().astype(np.float32))


def _stretches(over: np.ndarray, cuts: np.ndarray) -> list[tuple[int, int]]:
    """Ranges of a piece that are random: all of it, or its best stretches of ``MIN_RUN`` characters or more.

    ``over`` is the ratio of each character less the threshold, ``cuts`` the separators.  A stretch is
    widened to the separators around it; what lies left and right of it is judged again.
    """
    out, rest = [], [(0, len(over))]
    while rest:
        a, b = rest.pop()
        if b - a < MIN_RUN:
            continue
        total = np.concatenate([[0.0], np.cumsum(over[a:b])])
        if total[-1] > 0:
            out.append((a, b))
            continue
        gain = total[MIN_RUN:] - np.minimum.accumulate(total[:-MIN_RUN])
        best = int(np.argmax(gain))
        if gain[best] <= 0:
            continue
        low = a + int(np.argmin(total[: best + 1]))
        high = a + best + MIN_RUN
        before, after = np.flatnonzero(cuts[a:low]), np.flatnonzero(cuts[high:b])
        low = a + int(before[-1]) + 1 if len(before) else a
        high = high + int(after[0]) if len(after) else b
        out.append((low, high))
        rest += [(a, low), (high, b)]
    return out


def text_spans(raw: np.ndarray, at: np.ndarray, models: Models, threshold: float = THRESHOLD) -> list[tuple[int, int, int]]:
    """Base spans and what the models find random in the runs, or parts of runs, between them."""
    spans = base_spans(raw.tobytes(), raw, at)
    starts, ends, _ = runs(_IN_RUN[raw] & ~_base_bytes(len(raw), spans), at)
    long = ends - starts >= MIN_RUN
    starts, ends = starts[long], ends[long]
    if len(starts):
        over = models.ratio[_triples(raw, starts, ends)[0]].astype(np.float64) - threshold
        begins = np.cumsum(ends - starts) - (ends - starts)
        found = []
        for a, b, k in zip(starts.tolist(), ends.tolist(), begins.tolist(), strict=True):
            found += [(a + i, 3, a + j) for i, j in _stretches(over[k : k + b - a], _IS_CUT[raw[a:b]])]
        spans = sorted(spans + [s for s in found if len(set(raw[s[0] : s[2]].tolist())) >= MIN_DISTINCT])
    return spans


def _joined(spans: list[tuple[int, int, int]], points: np.ndarray, origin: int) -> str:
    return ",".join(f"{KINDS[k]}:{points[a] - origin}:{points[b] - origin}" for a, k, b in spans)


def find(docs: DataFrame, models: Models, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Counts and spans of the secrets of every whole text; spans are in code points, end exclusive.

    A null or empty text has no secrets and an empty list; repeated rows give repeated rows; other
    columns are not read.
    """

    def scan(batch: pa.RecordBatch) -> pa.RecordBatch:
        counts, digests, lists = [], [], []
        for _, _, raw, at in chunks(batch.column(1)):
            spans, points = text_spans(raw, at, models, threshold), code_points(raw)
            cut = np.searchsorted([s[0] for s in spans], at)
            for k in range(len(at) - 1):
                own = spans[cut[k] : cut[k + 1]]
                base = [s for s in own if s[1] < 3]
                counts.append([sum(s[1] == kind for s in own) for kind in range(4)])
                digests.append(hashlib.sha256(_joined(base, points, points[at[k]]).encode()).hexdigest())
                lists.append(_joined(own, points, points[at[k]]))
        columns = [pa.array(c, pa.int64()) for c in zip(*counts, strict=True)]
        names = ["doc_id", "n_assign", "n_access", "n_hex", "n_random", "base_sha256", "spans"]
        return pa.RecordBatch.from_arrays([batch.column(0), *columns, pa.array(digests), pa.array(lists)], names)

    named = pick(docs, doc_id=doc_id, text=text).withColumn("doc_id", F.col("doc_id").cast("bigint"))
    schema = "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, n_random bigint, base_sha256 string, spans string"
    return map_batches(named, scan, schema)


def redact(docs: DataFrame, models: Models, text: str = "text", mark: str = "[SECRET]", threshold: float = THRESHOLD) -> DataFrame:
    """The documents with each stretch covered by secrets replaced by ``mark``; null texts stay null."""
    place = docs.columns.index(text)
    put = mark.encode()

    def scan(batches):
        for batch in batches:
            out: list[str | None] = []
            column = batch.column(place)
            for first, end, raw, at in chunks(column):
                data, spans = raw.tobytes(), text_spans(raw, at, models, threshold)
                cut = np.searchsorted([s[0] for s in spans], at)
                for k in range(end - first):
                    if not column[first + k].is_valid:
                        out.append(None)
                        continue
                    pieces, done = [], int(at[k])
                    for a, _, b in spans[cut[k] : cut[k + 1]]:
                        if a >= done:
                            pieces += [data[done:a], put]
                        done = max(done, b)
                    out.append(b"".join([*pieces, data[done : at[k + 1]]]).decode())
            yield batch.set_column(place, text, pa.array(out, pa.string()))

    return docs.mapInArrow(scan, docs.schema)
