"""Token counts by rank-synchronous array merging.

The distinct pre-tokens of a batch form one ragged array of symbols.  In each step every sequence
merges all places of its own lowest-ranked pair at once; sequences without a ranked pair leave the
array, and the symbols they still have are their tokens.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeloom.llm.arrays import buffers, chunks
from tapeloom.llm.frames import pick

LIMIT = 2048
REMEMBERED = 400_000  # distinct pre-tokens whose count a task remembers; it starts anew beyond that
NO_RANK = np.int64(1 << 40)
SCHEMA = "doc_id bigint, n_bytes bigint, n_tokens bigint"


@dataclass(frozen=True)
class WordVocabulary:
    """What counting needs of a tokenizer file: symbols of bytes, ranked pairs, special strings."""

    inner: np.ndarray  # symbol of a byte inside a pre-token
    final: np.ndarray  # symbol of a byte at its end
    pairs: np.ndarray  # left << 32 | right, ascending
    ranks: np.ndarray
    merged: np.ndarray
    pattern: str
    specials: tuple[str, ...]


def _byte_letters() -> list[str]:
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters = {b: chr(b) for b in shown}
    for b in range(256):
        letters.setdefault(b, chr(256 + len(letters) - len(shown)))
    return [letters[b] for b in range(256)]


def read_vocabulary(path: str) -> WordVocabulary:
    """A byte-level BPE file whose last symbol of a word carries a suffix, lower-casing and NFC."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, vocab = spec["model"], spec["model"]["vocab"]
    letters, suffix = _byte_letters(), model["end_of_word_suffix"]
    rows = [(vocab[a] << 32 | vocab[b], rank, vocab[a + b]) for rank, (a, b) in enumerate(model["merges"])]
    table = np.array(sorted(rows), np.int64)
    split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
    return WordVocabulary(
        np.array([vocab[c] for c in letters], np.int64), np.array([vocab[c + suffix] for c in letters], np.int64),
        table[:, 0].copy(), table[:, 1].copy(), table[:, 2].copy(), split["pattern"]["Regex"],
        tuple(t["content"] for t in spec["added_tokens"]),
    )


def merge_counts(words: list[str], v: WordVocabulary) -> np.ndarray:
    """How many symbols survive in each non-empty pre-token."""
    column = pa.array(words, pa.large_string())
    raw, at = buffers(column)
    symbols = v.inner[raw]
    symbols[at[1:] - 1] = v.final[raw[at[1:] - 1]]
    owner = np.repeat(np.arange(len(words)), np.diff(at))
    counts = np.zeros(len(words), np.int64)
    while len(symbols):
        begins = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
        sizes = np.diff(np.concatenate([begins, [len(owner)]]))
        key = symbols[:-1] << 32 | symbols[1:]
        found = np.minimum(np.searchsorted(v.pairs, key), len(v.pairs) - 1)
        known = (v.pairs[found] == key) & (owner[1:] == owner[:-1])
        rank = np.full(len(symbols), NO_RANK)
        rank[:-1][known] = v.ranks[found[known]]
        lowest = np.repeat(np.minimum.reduceat(rank, begins), sizes)
        done = lowest == NO_RANK
        np.add.at(counts, owner[done], 1)
        hit = (rank == lowest) & ~done
        place = np.flatnonzero(hit)
        # a run of overlapping places (as in "aaa") merges its first, third, ...
        fresh = np.concatenate([[True], np.diff(place) > 1])
        run = np.maximum.accumulate(np.where(fresh, np.arange(len(place)), 0)) if len(place) else place
        place = place[(np.arange(len(place)) - run) % 2 == 0]
        symbols[place] = v.merged[found[place]]
        stays = ~done
        stays[place + 1] = False
        symbols, owner = symbols[stays], owner[stays]
    return counts


def normalise(text: str) -> str:
    """NFC, then each character's own lower case (no form for the end of a word)."""
    return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()


def count_tokens(docs: DataFrame, vocabulary: WordVocabulary, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens of every whole text.

    Null or empty texts have no bytes and no tokens; a special string inside a text is one token;
    repeated rows give repeated rows; other columns are not read.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = regex.compile(vocabulary.pattern)
        special = regex.compile("|".join(map(regex.escape, vocabulary.specials))) if vocabulary.specials else None
        known: dict[str, int] = {}

        def counts(texts: list[str]) -> list[int]:
            parts = [special.split(t) if special else [t] for t in texts]
            tokens = [[w for part in p for w in pieces.findall(normalise(part))] for p in parts]
            present = set().union(*tokens)
            if len(known) > REMEMBERED:
                known.clear()
            if new := [w for w in present if w not in known]:
                known.update(zip(new, merge_counts(new, vocabulary).tolist(), strict=True))
            return [len(p) - 1 + sum(map(known.__getitem__, t)) for p, t in zip(parts, tokens, strict=True)]

        for batch in (b for b in batches if b.num_rows):
            n_tokens, n_bytes = [], []
            for first, end, _, at in chunks(batch.column(1)):
                n_tokens += counts(batch.column(1).slice(first, end - first).fill_null("").to_pylist())
                n_bytes.append(np.diff(at))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.concatenate(n_bytes)), pa.array(n_tokens, pa.int64())],
                ["doc_id", "n_bytes", "n_tokens"],
            )

    named = pick(docs, doc_id=doc_id, text=text).withColumn("doc_id", F.col("doc_id").cast("bigint"))
    return named.mapInArrow(scan, SCHEMA)


def token_counts(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """``count_tokens`` by the file at ``path`` with ``over_limit``: more than ``limit`` tokens."""
    return count_tokens(docs, read_vocabulary(path)).withColumn("over_limit", F.col("n_tokens") > limit)
