"""Byte-level BPE: every distinct pre-token is encoded once, in one place of the whole cluster.

Tasks cut texts into pre-tokens and keep, for a block of documents, one list of its distinct
pre-tokens and for each document the positions as numbers into that list.  The lists are shuffled by
word, so that a word meets its like from all blocks and is encoded once; its ids go back to the
blocks, and each block puts its documents together again by position.  Ids of whole texts are decoded
with the table of token bytes, which the vocabulary bounds.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeloom.llm.frames import pick, stage_by

BLOCK_WORDS = 400_000  # distinct pre-tokens after which a task closes its block
BLOCK_TOKENS = 8_000_000  # pre-tokens after which it does
ROW_WORDS = 20_000  # words in one row of a block's list


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ranks of a rank file."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def _ragged(parts: list[bytes]) -> tuple[bytes, bytes]:
    """Joined bytes and their lengths."""
    return b"".join(parts), _varint(np.array([len(p) for p in parts], np.int64))


def _split(data: bytes, lengths: bytes) -> list[bytes]:
    at = np.cumsum(_unvarint(lengths)).tolist()
    return [data[a:b] for a, b in zip([0, *at[:-1]], at, strict=True)]


def _varint(numbers: np.ndarray) -> bytes:
    """Numbers under 2^28 in seven-bit groups, lowest first; the high bit says that more follow."""
    size = 1 + (numbers >= 1 << 7).astype(np.int64) + (numbers >= 1 << 14) + (numbers >= 1 << 21)
    end = np.cumsum(size)
    out = np.zeros(int(end[-1]) if len(end) else 0, np.uint8)
    for k in range(4):
        has = size > k
        out[(end - size)[has] + k] = ((numbers[has] >> (7 * k)) & 127) | np.where(size[has] > k + 1, 128, 0)
    return out.tobytes()


def _unvarint(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8)
    last = np.flatnonzero(raw < 128)
    first = np.concatenate([[0], last[:-1] + 1]) if len(last) else last
    out = np.zeros(len(last), np.int64)
    for k in range(4):
        has = first + k <= last
        out[has] |= (raw[first[has] + k].astype(np.int64) & 127) << (7 * k)
    return out


class _Block:
    """The documents and distinct pre-tokens of one block."""

    def __init__(self, number: int) -> None:
        self.key = f"{TaskContext.get().partitionId()}-{number}"
        self.words: dict[str, int] = {}
        self.tokens = 0
        self.rows: list[tuple] = []

    def add(self, doc_id, tokens: list[str]) -> None:
        number = self.words
        for w in set(tokens).difference(number):
            number[w] = len(number)
        self.tokens += len(tokens)
        places = np.fromiter(map(number.__getitem__, tokens), np.int64, len(tokens))
        self.rows.append((doc_id, _varint(places)))

    def batches(self, buckets: int) -> Iterator[pa.RecordBatch]:
        for i in range(0, len(self.rows), 2000):
            ids, places = zip(*self.rows[i : i + 2000], strict=True)
            yield _batch([self.key] * len(ids), [-1] * len(ids), ids, places, [None] * len(ids), [None] * len(ids))
        groups: dict[int, list[bytes]] = {}
        numbers: dict[int, list[int]] = {}
        for word, number in self.words.items():
            data = word.encode()
            bucket = hash_bucket(data, buckets)
            groups.setdefault(bucket, []).append(data)
            numbers.setdefault(bucket, []).append(number)
        rows = []
        for bucket, parts in groups.items():
            for i in range(0, len(parts), ROW_WORDS):
                data, lengths = _ragged(parts[i : i + ROW_WORDS])
                steps = np.diff(np.array(numbers[bucket][i : i + ROW_WORDS], np.int64), prepend=0)
                rows.append((self.key, bucket, None, _varint(steps), data, lengths))
        for i in range(0, len(rows), 500):
            yield _batch(*zip(*rows[i : i + 500], strict=True))


def hash_bucket(word: bytes, buckets: int) -> int:
    return int.from_bytes(hashlib.blake2b(word, digest_size=4).digest(), "little") % buckets


_NAMES = ["block", "bucket", "doc_id", "numbers", "data", "lengths"]
_TYPES = [pa.string(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
_SCHEMA = "block string, bucket int, doc_id bigint, numbers binary, data binary, lengths binary"


def _batch(*columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _TYPES, strict=True)], _NAMES)


def cut(docs: DataFrame, pattern: str, buckets: int) -> DataFrame:
    """Rows of documents (bucket -1, their positions) and of word lists (bucket of the word)."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, block, number = regex.compile(pattern), _Block(0), 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                block.add(doc_id.as_py(), pieces.findall(text.as_py() or ""))
                if len(block.words) >= BLOCK_WORDS or block.tokens >= BLOCK_TOKENS:
                    yield from block.batches(buckets)
                    number += 1
                    block = _Block(number)
        if block.rows:
            yield from block.batches(buckets)

    return docs.mapInArrow(scan, _SCHEMA)


def encode_words(lists: DataFrame, ranks: dict[bytes, int], pattern: str) -> DataFrame:
    """The word lists with uint16 or int32 ids in place of bytes; rows of a bucket follow each other."""
    wide = np.uint16 if max(ranks.values(), default=0) < 1 << 16 else np.int32

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})._encode_single_piece
        bucket, known = None, {}
        for batch in batches:
            rows = []
            for row in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                if row[1] != bucket or len(known) > 4 * BLOCK_WORDS:
                    bucket, known = row[1], {}
                words = _split(row[4], row[5])
                for w in set(words).difference(known):
                    known[w] = np.array(piece(w), wide).tobytes()
                rows.append((*row[:4], *_ragged([known[w] for w in words])))
            if rows:
                yield _batch(*zip(*rows, strict=True))

    return lists.mapInArrow(scan, _SCHEMA)


def encode_documents(docs: DataFrame, ranks: dict[bytes, int], pattern: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and the ``ids`` (little-endian int32 bytes) of every whole text, by global distinct words.

    A null or empty text has no ids; repeated rows give repeated rows; other columns are not read.
    """
    return _assembled(docs, ranks, pattern, doc_id, text, _ids_row, "doc_id bigint, n_tokens bigint, ids binary")


def encode_digests(docs: DataFrame, ranks: dict[bytes, int], pattern: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens and digests of the ids as text and of the bytes they decode to; see ``encode_documents``."""
    schema = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    return _assembled(docs, ranks, pattern, doc_id, text, _digest_row, schema)


def token_table(ranks: dict[bytes, int]) -> dict[int, bytes]:
    """The bytes of each token id."""
    return {rank: token for token, rank in ranks.items()}


def decoded(ids: bytes, token_bytes: dict[int, bytes]) -> bytes:
    """The bytes that little-endian int32 ids stand for."""
    try:
        return b"".join([token_bytes[i] for i in np.frombuffer(ids, "<i4").tolist()])
    except KeyError as unknown:
        raise ValueError(f"no token has the id {unknown.args[0]}") from None


def decode(encoded: DataFrame, ranks: dict[bytes, int], doc_id: str = "doc_id", ids: str = "ids") -> DataFrame:
    """doc_id, the ``data`` bytes of the ids that ``encode_documents`` gave, and these as ``text``.

    Null ids give nulls; bytes that are not UTF-8 (ids cut inside a character) have no text; an id
    without a token is an error; repeated rows give repeated rows; other columns are not read.
    """
    token_bytes = token_table(ranks)

    def text_of(data: bytes | None) -> str | None:
        try:
            return None if data is None else data.decode()
        except UnicodeDecodeError:
            return None

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                part = batch.slice(i, 500)
                data = [None if v is None else decoded(v, token_bytes) for v in part.column(1).to_pylist()]
                columns = [part.column(0), pa.array(data, pa.binary()), pa.array(map(text_of, data), pa.string())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "data", "text"])

    named = pick(encoded, doc_id=doc_id, ids=ids).withColumn("doc_id", F.col("doc_id").cast("bigint"))
    return named.mapInArrow(scan, "doc_id bigint, data binary, text string")


def _ids_row(pieces: list[np.ndarray], token_bytes: dict[int, bytes]):
    """Row maker of plain ids."""
    sizes = np.array([len(p) for p in pieces], np.int64)
    begins = np.cumsum(sizes) - sizes
    flat = np.concatenate(pieces).astype(np.int32) if pieces else np.zeros(0, np.int32)

    def make(places: np.ndarray) -> tuple:
        n = sizes[places]
        total = int(n.sum())
        ids = flat[np.repeat(begins[places] - (np.cumsum(n) - n), n) + np.arange(total)]
        return total, ids.tobytes()

    return make, [pa.int64(), pa.binary()]


def _digest_row(pieces: list[np.ndarray], token_bytes: dict[int, bytes]):
    """Row maker of digests: both are taken from the ids of the whole text, put together and then decoded."""
    whole, _ = _ids_row(pieces, token_bytes)
    written = {i: str(i).encode() for i in token_bytes}

    def make(places: np.ndarray) -> tuple:
        total, data = whole(places)
        ids = b",".join([written[i] for i in np.frombuffer(data, "<i4").tolist()])
        return total, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded(data, token_bytes)).hexdigest()

    return make, [pa.int64(), pa.string(), pa.string()]


def _assembled(docs, ranks, pattern, doc_id, text, maker, schema: str) -> DataFrame:
    spark = docs.sparkSession
    buckets = 4 * max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    wide = np.uint16 if max(ranks.values(), default=0) < 1 << 16 else np.int32
    token_bytes = token_table(ranks)
    names = [f.split()[0] for f in schema.split(", ")]

    named = pick(docs, doc_id=doc_id, text=text).withColumn("doc_id", F.col("doc_id").cast("bigint"))
    pieces = stage_by(cut(named, pattern, buckets), "block", buckets // 4)  # documents stay where they are from here on
    lists = pieces.where("bucket >= 0").repartition("bucket").sortWithinPartitions("bucket")
    encoded = encode_words(lists, ranks, pattern)

    def rebuild(own: pa.Table, words: pa.Table) -> pa.Table:
        found: dict[int, np.ndarray] = {}
        for steps, data, lengths in zip(*(words.column(c).to_pylist() for c in ("numbers", "data", "lengths")), strict=True):
            ids = [np.frombuffer(p, wide) for p in _split(data, lengths)]
            found.update(zip(np.cumsum(_unvarint(steps)).tolist(), ids, strict=True))
        make, kinds = maker([found[k] for k in range(len(found))], token_bytes)
        rows = [make(_unvarint(p.as_py())) for p in own.column("numbers")]
        columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)]
        return pa.Table.from_arrays([own.column("doc_id"), *columns], names)

    own = pieces.where("bucket < 0").groupBy("block")
    return own.cogroup(encoded.groupBy("block")).applyInArrow(rebuild, schema)
