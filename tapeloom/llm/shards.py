"""Token ids in training order: fixed-length sequences, a keyed permutation, fixed-stride shards.

Every sequence has a number (its place in the corpus).  A keyed Feistel network with cycle-walking maps
the numbers 0 .. n-1 one-to-one onto slots, without a table or a sort of random numbers.  Sequences
are range-partitioned by slot and written as shards of equal stride, so slot s lies in shard
s // per_shard at byte (s % per_shard) * stride, and reading can resume at any slot.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.llm.arrays import mix
from tapeloom.llm.frames import pick, stage

LENGTH = 1024  # ids of a sequence
PER_SHARD = 512  # sequences of a shard
ROUNDS = 4


@dataclass(frozen=True)
class Permutation:
    """A keyed one-to-one map of 0 .. n-1 onto itself."""

    n: int
    key: int

    def __call__(self, numbers: np.ndarray) -> np.ndarray:
        half = max(1, (max(self.n - 1, 1).bit_length() + 1) // 2)
        mask = np.uint64((1 << half) - 1)
        keys = mix(np.arange(1, ROUNDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(self.key))
        out = numbers.astype(np.uint64)
        walking = np.ones(len(out), bool)
        while walking.any():  # the network permutes 4 ** half >= n values; those outside walk on
            left, right = out[walking] >> np.uint64(half), out[walking] & mask
            for k in keys:
                left, right = right, left ^ (mix(right ^ k) & mask)
            out[walking] = left << np.uint64(half) | right
            walking = out >= self.n
        return out.astype(np.int64)


def sequences(docs: DataFrame, ranks: dict[bytes, int], pattern: str, end_id: int, doc_id: str, text: str, length: int) -> DataFrame:
    """block (the task), number in the block, doc_id, part, n_ids, ids (uint16) of each document's sequences.

    A document's ids and the end id are cut into parts of ``length``; the last is padded with the end id, and
    ``n_ids`` says how many of its ids come before the padding.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        block, number = TaskContext.get().partitionId(), 0
        for batch in batches:
            for i in range(0, batch.num_rows, 200):
                rows = []
                for doc, t in zip(batch.column(0).slice(i, 200), batch.column(1).slice(i, 200), strict=True):
                    ids = coder.encode_ordinary(t.as_py() or "")
                    n = len(ids) // length + 1
                    padded = np.full(n * length, end_id, np.uint16)
                    padded[: len(ids)] = ids
                    for part in range(n):
                        real = min(length, len(ids) + 1 - part * length)
                        rows.append((block, number, doc.as_py(), part, real, padded[part * length : (part + 1) * length].tobytes()))
                        number += 1
                if rows:
                    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)],
                        ["block", "number", "doc_id", "part", "n_ids", "ids"],
                    )

    named = pick(docs, doc_id=doc_id, text=text).withColumn("doc_id", F.col("doc_id").cast("bigint"))
    return named.mapInArrow(scan, "block int, number bigint, doc_id bigint, part int, n_ids int, ids binary")


def in_training_order(
    docs: DataFrame, ranks: dict[bytes, int], pattern: str, key: int, end_id: int, doc_id: str = "doc_id",
    text: str = "text", length: int = LENGTH,
) -> DataFrame:
    """slot, doc_id, part, n_ids and ids of every sequence; slots are 0 .. n-1, permuted by ``key``.

    A null or empty text is one sequence of end ids; null ids stay null; repeated rows are
    sequences of their own; an empty table has no slots; other columns are not read.
    """
    if max(max(ranks.values(), default=0), end_id) >= 1 << 16:
        raise ValueError("ids of two bytes are needed")
    cut = stage(sequences(docs, ranks, pattern, end_id, doc_id, text, length))
    sizes = cut.groupBy("block").agg(F.count("*").alias("size"))
    # a row for each input task, summed up in the order of the blocks
    before = F.sum("size").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select("block", F.coalesce(before, F.lit(0)).alias("offset"))
    permutation = Permutation(cut.count(), key)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slots = permutation(batch.column(0).to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(slots), *batch.columns[1:]], ["slot", "doc_id", "part", "n_ids", "ids"])

    # offsets are a row of two numbers for each input task, so the ids stay where they are
    numbered = cut.join(F.broadcast(offsets), "block").select((F.col("offset") + F.col("number")).alias("at"), "doc_id", "part", "n_ids", "ids")
    return numbered.mapInArrow(assign, "slot bigint, doc_id bigint, part int, n_ids int, ids binary")


def shards(ordered: DataFrame, per_shard: int = PER_SHARD) -> DataFrame:
    """shard, first_slot, n_sequences, stride (bytes), n_ids, payload and its sha256: a row for each shard, in order.

    ``payload`` holds the ids of the shard's slots one after the other, so each starts at a multiple of
    the stride; ``n_ids`` has the ids before the padding of each.  A range partition holds whole shards; only one shard is in memory at a time.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, first, held, real = None, 0, [], []

        def row() -> pa.RecordBatch:
            data = b"".join(held)
            values = [shard, first, len(held), len(held[0]), real, data, hashlib.sha256(data).hexdigest()]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], names)

        for batch in batches:
            for s, slot, n, ids in zip(*(batch.column(i) for i in range(4)), strict=True):
                if s.as_py() != shard:
                    if held:
                        yield row()
                    shard, first, held, real = s.as_py(), slot.as_py(), [], []
                held.append(ids.as_py())
                real.append(n.as_py())
        if held:
            yield row()

    names = ["shard", "first_slot", "n_sequences", "stride", "n_ids", "payload", "payload_sha256"]
    kinds = [*[pa.int64()] * 4, pa.list_(pa.int32()), pa.binary(), pa.string()]
    placed = ordered.select(F.floor(F.col("slot") / per_shard).alias("shard"), "slot", "n_ids", "ids")
    listed = placed.repartitionByRange("shard").sortWithinPartitions("shard", "slot")
    schema = "shard bigint, first_slot bigint, n_sequences bigint, stride bigint, n_ids array<int>, payload binary, payload_sha256 string"
    return listed.mapInArrow(pack, schema)


def write_shards(ordered: DataFrame, path: str, per_shard: int = PER_SHARD) -> None:
    """Shards as a Parquet table sorted by shard, which any store takes that Spark can write to."""
    shards(ordered, per_shard).write.parquet(path)


def read_slots(table: DataFrame, first: int, per_shard: int = PER_SHARD) -> DataFrame:
    """slot, n_ids and ids of all slots from ``first`` on; shards before are skipped by their number."""
    kept = table.where(F.col("shard") >= first // per_shard)
    step = F.explode(F.sequence(F.lit(0), F.col("n_sequences") - 1)).alias("step")
    rows = kept.select("first_slot", "stride", "n_ids", "payload", step)
    slot = (F.col("first_slot") + F.col("step")).alias("slot")
    ids = F.substring(F.col("payload"), (F.col("step") * F.col("stride") + 1).cast("int"), F.col("stride").cast("int")).alias("ids")
    return rows.select(slot, F.get("n_ids", F.col("step")).alias("n_ids"), ids).where(F.col("slot") >= first)
