"""Near-duplicates: an inverted join on the coordinates of MinHash signatures.

A signature is a set of (coordinate, value) tokens.  Two sets with the wanted similarity agree in at
least ``least_matches`` coordinates but for a chance of one in a million, so they share a token among
the rarest ``K - least_matches + 1`` of each (prefix).  Documents are posted under those tokens only;
inside a posting list collisions are counted over whole signatures, and what is already reached is
skipped, so a list yields a forest of its matches and never all pairs.  The components of those
matches are families; within a family links are confirmed on the full shingle sets.
Equal sets count as one member from the start.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeloom.llm.arrays import BLANKS, chunks, mix, runs, sequence_hash, window_hashes, word_hashes
from tapeloom.llm.components import components
from tapeloom.llm.frames import filter_bits, fresh, map_batches, numbered, pick, stage

K = 64
MISS = 1e-6  # chance that one linked pair agrees in too few coordinates
CELL_BITS = 18  # of the count table that orders tokens by rarity; 2 MB whatever the corpus
LIST_ROWS = 8192  # a longer posting list is split into blocks, which meet in pairs
FAMILY_SHINGLES = 2_000_000  # a family with more is split likewise
FILTER_BITS = 24  # least address bits of the filter of family members (2 MB); more members have more, up to 32 MB

_rng = np.random.default_rng(64)
_A = _rng.integers(0, 2**32, K, dtype=np.uint32) | np.uint32(1)
_B = _rng.integers(0, 2**32, K, dtype=np.uint32)
_SALT = _rng.integers(0, 2**63, K, dtype=np.uint64)


def least_matches(threshold: float, k: int = K, miss: float = MISS) -> int:
    """The most coordinates in which a pair of this similarity agrees but for the chance ``miss``."""
    tail, m = 0.0, 0
    while m < k:
        tail += comb(k, m) * threshold**m * (1 - threshold) ** (k - m)
        if tail > miss:
            break
        m += 1
    return max(m, 1)


def shingle_sets(raw: np.ndarray, at: np.ndarray, size: int) -> list[np.ndarray]:
    """The ascending distinct shingle hashes of each text."""
    starts, ends, owner = runs(~BLANKS[raw], at)
    words = word_hashes(raw, starts, ends)
    place, keys = window_hashes(words, owner, size)
    cut = np.searchsorted(owner[place], np.arange(len(at)))
    first = np.searchsorted(owner, np.arange(len(at)))
    out = []
    for k in range(len(at) - 1):
        n = first[k + 1] - first[k]
        if n >= size:
            out.append(np.unique(keys[cut[k] : cut[k + 1]]))
        else:
            out.append(np.array([sequence_hash(words[first[k] : first[k + 1]])] if n else [], np.uint64))
    return out


def _print(keys: np.ndarray) -> bytes:
    return hashlib.blake2b(keys.tobytes(), digest_size=16).digest()


def _signatures(sets: list[np.ndarray]) -> np.ndarray:
    """A row of K minima for each non-empty set."""
    flat = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
    sizes = np.array([len(s) for s in sets])
    begins = np.cumsum(sizes) - sizes
    return np.column_stack([np.minimum.reduceat(flat * a + b, begins) for a, b in zip(_A, _B, strict=True)])


def sketch(docs: DataFrame, doc_id: str, text: str, size: int) -> DataFrame:
    """doc_id, number of shingles, print of the set and signature (null without shingles)."""

    def scan(batch: pa.RecordBatch) -> pa.RecordBatch:
        n, prints, signatures = [], [], []
        for _, _, raw, at in chunks(batch.column(1)):
            sets = shingle_sets(raw, at, size)
            full = [s for s in sets if len(s)]
            rows = iter(_signatures(full)) if full else iter(())
            for s in sets:
                n.append(len(s))
                prints.append(_print(s) if len(s) else None)
                signatures.append(next(rows).tobytes() if len(s) else None)
        columns = [pa.array(n, pa.int64()), pa.array(prints, pa.binary()), pa.array(signatures, pa.binary())]
        return pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", "n_shingles", "print", "signature"])

    named = pick(docs, doc_id=doc_id, text=text).withColumn("doc_id", F.col("doc_id").cast("bigint"))
    return map_batches(named, scan, "doc_id bigint, n_shingles bigint, print binary, signature binary")


def _tokens(signatures: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    rows = np.frombuffer(b"".join(signatures.to_pylist()), np.uint32).reshape(-1, K)
    return rows, mix(rows.astype(np.uint64) ^ _SALT)


def token_counts(members: DataFrame) -> np.ndarray:
    """How often tokens occur, counted in a table of fixed size over all signatures."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(1 << CELL_BITS, np.int64)
        for batch in batches:
            if batch.num_rows:
                cells = (_tokens(batch.column(0))[1] >> np.uint64(64 - CELL_BITS)).astype(np.int64)
                table += np.bincount(cells.ravel(), minlength=len(table))
        used = np.flatnonzero(table)
        for i in range(0, len(used), 20_000):
            part = used[i : i + 20_000]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(table[part])], ["cell", "n"])

    sums = members.select("signature").mapInArrow(count, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n"))
    found = sums.toArrow()  # at most 2 ** CELL_BITS rows
    out = np.zeros(1 << CELL_BITS, np.int64)
    out[found.column("cell").to_numpy()] = found.column("n").to_numpy()
    return out


def postings(members: DataFrame, counts: np.ndarray, matches: int) -> DataFrame:
    """Members under their rarest tokens, with a short form of the signature; hot tokens in blocks."""
    prefix = K - matches + 1
    usual = 2 * int(counts.mean()) + 1  # what other tokens add to a cell

    def post(batch: pa.RecordBatch) -> pa.RecordBatch:
        nodes, (rows, tokens) = batch.column(0), _tokens(batch.column(1))
        load = counts[(tokens >> np.uint64(64 - CELL_BITS)).astype(np.int64)]
        order = np.lexsort((tokens, load), axis=1)[:, :prefix]
        token, load = np.take_along_axis(tokens, order, 1).ravel(), np.take_along_axis(load, order, 1).ravel()
        member = np.repeat(np.arange(len(rows)), prefix)
        blocks = np.maximum(1, -(-(load - usual) // LIST_ROWS))
        own = (mix(tokens[:, 0] ^ tokens[:, -1])[member] % blocks.astype(np.uint64)).astype(np.int64)
        copy = np.repeat(np.arange(len(token)), blocks)
        other = np.arange(len(copy)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        low, high = np.minimum(own[copy], other), np.maximum(own[copy], other)
        short = (rows & 255).astype(np.uint8)
        data = pa.array([r.tobytes() for r in short], pa.binary())
        member = pa.array(member[copy])
        return pa.RecordBatch.from_arrays(
            [pa.array(token[copy].view(np.int64)), pa.array((low << 20 | high)), nodes.take(member), data.take(member)],
            ["token", "block", "node", "short"],
        )

    def small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 1000):
                yield post(batch.slice(i, 1000))

    return members.select("node", "signature").mapInArrow(small, "token bigint, block bigint, node bigint, short binary")


def _forest(n: int, linked) -> list[tuple[int, int]]:
    """Edges that join what ``linked(i, others)`` joins; what is reached is not compared again."""
    edges, rest = [], np.arange(n)
    while len(rest):
        queue, rest = [int(rest[0])], rest[1:]
        while queue and len(rest):
            i = queue.pop()
            hit = linked(i, rest)
            found = rest[hit].tolist()
            edges += [(i, j) for j in found]
            queue += found
            rest = rest[~hit]
    return edges


def fixed(column: pa.Array, width: int) -> np.ndarray:
    """A row of bytes for each value of a binary column without nulls whose values have one width."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]].reshape(-1, width)


def whole_groups(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups of a stream sorted by its first bigint columns, with the starts of the groups."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        new = pa.Table.from_batches([batch])
        held = new if held is None else pa.concat_tables([held, new])
        keys = [held.column(c).to_numpy() for c in range(n_keys)]
        starts = np.flatnonzero(np.concatenate([[True], np.any([k[1:] != k[:-1] for k in keys], axis=0)]))
        if len(starts) > 1:
            yield held.slice(0, starts[-1]), starts[:-1]
            held = held.slice(starts[-1]).combine_chunks()
    if held is not None:
        yield held, np.zeros(1, np.int64)


def matches_of_lists(posted: DataFrame, matches: int) -> DataFrame:
    """A forest of each posting list's pairs that agree in at least ``matches`` coordinates."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in whole_groups(batches, 2):
            sizes = np.diff(np.append(starts, table.num_rows))
            if sizes.max() < 2:
                continue
            short, nodes = fixed(table.column("short"), K), table.column("node").to_numpy()
            pair = starts[sizes == 2]
            pair = pair[(short[pair] == short[pair + 1]).sum(1) >= matches]
            left, right = [pair], [pair + 1]
            for a, n in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
                own = short[a : a + n]
                edges = _forest(n, lambda i, rest, own=own: (own[rest] == own[i]).sum(1) >= matches)
                if edges:
                    edge = np.array(edges) + a
                    left.append(edge[:, 0])
                    right.append(edge[:, 1])
            left, right = np.concatenate(left), np.concatenate(right)
            for i in range(0, len(left), 10_000):
                ends = [pa.array(nodes[side[i : i + 10_000]]) for side in (left, right)]
                yield pa.RecordBatch.from_arrays(ends, ["a", "b"])

    listed = posted.repartition("token", "block").sortWithinPartitions("token", "block")
    return listed.mapInArrow(scan, "a bigint, b bigint").distinct()


def _slots(prints: np.ndarray, doc_ids: np.ndarray, bits: int) -> np.ndarray:
    """The filter address of a class and the document that stands for it."""
    first = np.ascontiguousarray(prints[:, :8]).view(np.uint64).ravel()
    return (mix(first ^ mix(doc_ids.astype(np.uint64))) >> np.uint64(64 - bits)).astype(np.int64)


def _ids(column: pa.Array) -> np.ndarray:
    return np.asarray(column.fill_null(-1), np.int64)


def _member_filter(members: DataFrame) -> np.ndarray:
    """A bitmap of the documents that stand for the members of families."""

    size = filter_bits(members.count(), FILTER_BITS)

    def address(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(_slots(fixed(batch.column(0), 16), _ids(batch.column(1)), size))], ["slot"])

    slots = map_batches(members.select("print", "doc_id"), address, "slot bigint")
    words = slots.groupBy(F.shiftright("slot", 6).alias("word"))
    found = words.agg(F.bit_or(F.expr("shiftleft(1L, cast(slot & 63 as int))")).alias("bits")).toArrow()
    bitmap = np.zeros(1 << (size - 6), np.int64)
    bitmap[found.column("word").to_numpy()] = found.column("bits").to_numpy()
    return bitmap.view(np.uint64)


def _full_sets(docs: DataFrame, doc_id: str, text: str, size: int, bitmap: np.ndarray) -> DataFrame:
    """print and shingle set of the documents that pass the filter."""
    bits = len(bitmap).bit_length() + 5

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = _ids(batch.column(0)) if batch.num_rows else None
            for first, end, raw, at in chunks(batch.column(1)):
                sets = shingle_sets(raw, at, size)
                full = np.array([k for k, s in enumerate(sets) if len(s)], np.int64)
                if not len(full):
                    continue
                prints = [_print(sets[k]) for k in full]
                slot = _slots(np.frombuffer(b"".join(prints), np.uint8).reshape(-1, 16), ids[first:end][full], bits)
                hit = (bitmap[slot >> 6] >> (slot & 63).astype(np.uint64)) & np.uint64(1) == 1
                rows = [(prints[j], sets[full[j]].tobytes()) for j in np.flatnonzero(hit).tolist()]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in zip(*rows, strict=True)], ["print", "shingles"])

    named = pick(docs, doc_id=doc_id, text=text).withColumn("doc_id", F.col("doc_id").cast("bigint"))
    return named.mapInArrow(scan, "print binary, shingles binary")


def _links(blocks: DataFrame, percent: int) -> DataFrame:
    """A forest of the pairs of each family block that are similar enough by their full sets."""

    def edges_of(sets: list[np.ndarray]) -> list[tuple[int, int]]:
        size = np.array([len(s) for s in sets])
        begins = np.cumsum(size) - size
        _, codes = np.unique(np.concatenate(sets), return_inverse=True)
        flag = np.zeros(len(codes), bool)

        def linked(i: int, rest: np.ndarray) -> np.ndarray:
            own = codes[begins[i] : begins[i] + size[i]]
            flag[own] = True
            if len(rest) * 8 < len(size):
                common = np.array([np.count_nonzero(flag[codes[begins[j] : begins[j] + size[j]]]) for j in rest.tolist()])
            else:
                common = np.add.reduceat(flag[codes], begins, dtype=np.int64)[rest]
            flag[own] = False
            return 100 * common >= percent * (size[i] + size[rest] - common)

        return _forest(len(size), linked)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in whole_groups(batches, 2):
            edges: list[tuple[int, int]] = []
            nodes = table.column("node").to_pylist()
            for a, b in zip(starts.tolist(), [*starts[1:].tolist(), table.num_rows], strict=True):
                if b - a > 1:
                    sets = [np.frombuffer(s.as_py(), np.uint64) for s in table.column("shingles").slice(a, b - a)]
                    edges += [(nodes[a + i], nodes[a + j]) for i, j in edges_of(sets)]
            if edges:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*edges, strict=True)], ["a", "b"])

    listed = blocks.repartition("family", "block").sortWithinPartitions("family", "block")
    return listed.mapInArrow(scan, "a bigint, b bigint").distinct()


def _placed(members: DataFrame, percent: int) -> DataFrame:
    """Members of families with their block (``own``) and all blocks that they have to meet (``others``).

    A family of at most ``FAMILY_SHINGLES`` is one block.  In a larger one, members are dealt by set size
    first, in classes so wide that sets of similar documents lie in the same class or in neighbours, and
    then to blocks of their class: blocks of other classes are never compared.
    """
    width = max(-math.log(percent / 100) * (1 + 1e-9), 0.005)
    whole = members.groupBy("root").agg(F.sum("n_shingles").alias("load"))
    level = F.when(F.col("load") > FAMILY_SHINGLES, F.floor(F.log(F.greatest("n_shingles", F.lit(1)).cast("double")) / width)).otherwise(0)
    dealt = members.join(whole, "root").withColumn("level", level.cast("bigint"))
    sizes = dealt.groupBy("root", "level").agg(F.ceil(F.sum("n_shingles") / FAMILY_SHINGLES).cast("bigint").alias("blocks"))
    plan = sizes.groupBy("root").agg(F.map_from_entries(F.collect_list(F.struct("level", "blocks"))).alias("plan"))  # an entry a level
    dealt = dealt.join(plan, "root")

    def ids(level):
        blocks = F.coalesce(F.try_element_at("plan", level), F.lit(0).cast("bigint"))
        return F.transform(F.filter(F.sequence(F.lit(0).cast("bigint"), blocks), lambda i: i < blocks), lambda i: level * (1 << 18) + i)

    level = F.col("level")
    own = level * (1 << 18) + F.pmod(F.xxhash64("node"), F.element_at("plan", level))
    return dealt.withColumns({"own": own, "others": F.concat(ids(level), ids(level - 1), ids(level + 1))}).drop("load", "level", "plan")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every document.

    Documents are linked if their shingle sets have at least ``percent`` % in common (intersection
    over union); component_id is the least id that links reach, kept says that it is the document's
    own.  A text of fewer words than a shingle is one shingle; a null, empty or blank text has none
    and no link.  Rows with a null id count as texts but lead nothing: they are kept only if no
    other row of their component has an id.  Repeated rows share a component.
    """
    matches = least_matches(percent / 100)
    sketched = stage(sketch(docs, doc_id, text, shingle))
    whole = sketched.where("print is not null")
    classes = stage(whole.groupBy("print").agg(
        F.min("doc_id").alias("doc_id"), F.min("n_shingles").alias("n_shingles"), F.min("signature").alias("signature"),
    ).withColumn("node", F.monotonically_increasing_id()))  # numbered as written
    counts = token_counts(classes)
    families = components(matches_of_lists(postings(classes, counts, matches), matches))
    members = families.join(classes.drop("signature"), "node")
    members = stage(_placed(members, percent))

    sets = _full_sets(docs, doc_id, text, shingle, _member_filter(members)).groupBy("print").agg(F.min("shingles").alias("shingles"))
    family = F.col("root").alias("family")
    blocks = sets.join(members.select("print", "node", family, "own", F.explode("others").alias("other")), "print")
    block = (F.least("own", "other") * (1 << 31) + F.greatest("own", "other")).alias("block")
    linked = components(_links(blocks.select("family", block, "node", "shingles"), percent))

    joined = classes.select("node", "print", "doc_id").join(linked, "node", "left")
    joined = joined.select("print", "doc_id", F.coalesce("root", "node").alias("root"))
    least = joined.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    named = joined.select("print", "root").join(least, "root").select(F.col("print").alias("own_print"), "component_id")
    out = sketched.drop("signature").join(named, F.col("print") == F.col("own_print"), "left")
    component = F.when(F.col("print").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    out = out.select("doc_id", "n_shingles", component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()))


def keep_one(docs: DataFrame, doc_id: str = "doc_id", **settings) -> DataFrame:
    """Exactly one row of each component, with its least id or none if no row has one; all columns stay.

    Rows are told apart by a key of their own, so rows without id, repeated rows and different texts under
    one id are each judged for themselves; a row without shingles is a component of its own.
    """
    rows, key = numbered(docs)
    judged = near_duplicates(rows, doc_id=key, **settings).select(F.col("doc_id").alias("own_key"), "component_id")
    ids = rows.select(F.col(key).alias("key"), F.col(f"`{doc_id}`").alias("id"))
    name = fresh(rows, "first_key")
    least = F.min(F.struct(F.col("id").isNull(), "id", "key"))["key"].alias(name)
    first = judged.join(ids, F.col("own_key") == F.col("key")).groupBy("component_id").agg(least).select(name)
    return rows.join(first, F.col(key) == F.col(name), "left_semi").drop(key)
