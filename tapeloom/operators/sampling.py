"""Deterministic splits, keyed anonymous ids and content fingerprints."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Research splits and their target shares.
SPLITS = (("template", 0.5), ("tuning", 0.25), ("final_evaluation", 0.25))
_DIGITS = 13


def hash_position(key: Column) -> Column:
    """Position of sha256(key) in [0, 1), from its first 52 bits (exact in a double)."""
    head = F.conv(F.substring(F.sha2(key, 256), 1, _DIGITS), 16, 10).cast("double")
    return head / F.lit(float(16**_DIGITS))


def hash_split(key: Column) -> Column:
    pos = hash_position(key)
    out, edge = None, 0.0
    for name, weight in SPLITS[:-1]:
        edge += weight
        out = F.when(pos < edge, name) if out is None else out.when(pos < edge, name)
    return out.otherwise(SPLITS[-1][0])


def grouped_split(ordered: DataFrame, position: str, total: str) -> DataFrame:
    """Exact-share split of groups already numbered 1..n in hash order (largest remainder)."""
    n = F.col(total).cast("double")
    raw = [n * w for _, w in SPLITS]
    base = [F.floor(r) for r in raw]
    left = F.col(total) - (base[0] + base[1] + base[2])
    parts = [r - b for r, b in zip(raw, base)]
    # The rank of a split's remainder counts larger ones, and equal ones declared earlier.
    sizes = []
    for i in range(len(SPLITS)):
        ahead = F.lit(0)
        for j in range(len(SPLITS)):
            if j != i:
                wins = parts[j] > parts[i] if j > i else parts[j] >= parts[i]
                ahead = ahead + wins.cast("int")
        sizes.append(base[i] + (ahead < left).cast("int"))
    pos = F.col(position)
    split = (
        F.when(pos <= sizes[0], SPLITS[0][0]).when(pos <= sizes[0] + sizes[1], SPLITS[1][0]).otherwise(SPLITS[2][0])
    )
    return ordered.withColumn("split", split)


def hmac_sha256(secret: bytes, message: Column) -> Column:
    """Hex HMAC-SHA256 in built-in expressions: the two key pads are literals."""
    block = 64
    key = hashlib.sha256(secret).digest() if len(secret) > block else secret
    key = key.ljust(block, b"\0")
    inner, outer = bytes(b ^ 0x36 for b in key), bytes(b ^ 0x5C for b in key)
    digest = F.sha2(F.concat(F.lit(inner), F.encode(message, "UTF-8")), 256)
    return F.sha2(F.concat(F.lit(outer), F.unhex(digest)), 256)


def anonymous_id(secret: bytes, version: str, code: Column, day: Column) -> Column:
    text = F.concat_ws("|", F.lit(version), code, day)
    return F.concat(F.lit("S-"), F.upper(F.substring(hmac_sha256(secret, text), 1, 12)))


def group_id(secret: bytes, code: Column) -> Column:
    return F.concat(F.lit("G-"), F.upper(F.substring(hmac_sha256(secret, F.concat(F.lit("group|"), code)), 1, 16)))


def fingerprint(columns: list[str]) -> Column:
    """Content hash of a record: sha256 of its JSON with columns in sorted order."""
    return F.sha2(F.to_json(F.struct(*[F.col(c) for c in sorted(columns)])), 256)
