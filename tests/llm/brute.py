"""Plain versions of the operators for small tables."""

from __future__ import annotations

import collections
import hashlib
import re
import string

import numpy as np

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
BLANK_WORDS = re.compile("[^\x20\x09-\x0d]+")
ITEM_WORDS = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)


def sha(data: str | bytes) -> str:
    return hashlib.sha256(data.encode() if isinstance(data, str) else data).hexdigest()


def shingles(text: str | None, size: int) -> frozenset:
    words = BLANK_WORDS.findall((text or "").translate(LOWER))
    if len(words) >= size:
        return frozenset(tuple(words[i : i + size]) for i in range(len(words) - size + 1))
    return frozenset([tuple(words)]) if words else frozenset()


def near_components(texts: dict, size: int, percent: int) -> dict:
    """Least id that links reach, of every id."""
    sets = {i: shingles(t, size) for i, t in texts.items()}
    root = {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(i for i in texts if sets[i])
    for at, i in enumerate(ids):
        for j in ids[at + 1 :]:
            common = len(sets[i] & sets[j])
            if 100 * common >= percent * (len(sets[i]) + len(sets[j]) - common):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in texts}


def repeats(texts: list[bytes], length: int = 400) -> list[tuple]:
    """Bytes, removed bytes, removed runs and digest of the rest, of each text."""
    times = collections.Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            if times[t[i : i + length]] > 1:
                gone[i : i + length] = True
        runs = int((gone & ~np.concatenate([[False], gone[:-1]])).sum()) if len(t) else 0
        out.append((len(t), int(gone.sum()), runs, sha(bytes(np.frombuffer(t, np.uint8)[~gone]))))
    return out


def item_windows(items: list[tuple], window: int = 10) -> dict[tuple, set]:
    """Item ids of each window."""
    out = collections.defaultdict(set)
    for item, text in items:
        words = ITEM_WORDS.findall((text or "").translate(LOWER))
        size = min(window, len(words))
        for i in range(len(words) - size + 1 if words else 0):
            out[tuple(words[i : i + size])].add(str(item))
    return out


def contamination(text: str | None, windows: dict[tuple, set]) -> tuple[int, int, list[str]]:
    words = ITEM_WORDS.findall((text or "").translate(LOWER))
    hit, items = set(), set()
    for size in {len(w) for w in windows}:
        for i in range(len(words) - size + 1):
            if own := windows.get(tuple(words[i : i + size])):
                hit.update(range(i, i + size))
                items |= own
    return len(words), len(hit), sorted(items)


def base_secrets(text: str | None) -> list[tuple[int, int, int]]:
    text = text or ""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(found)


def redacted(text: str, mark: str = "[SECRET]") -> str:
    out, done = [], 0
    for a, _, b in base_secrets(text):
        if a >= done:
            out += [text[done:a], mark]
        done = max(done, b)
    return "".join([*out, text[done:]])


def rule_counts(text: str | None) -> tuple:
    text = text or ""
    words = BLANK_WORDS.findall(text)
    seen, dups = set(), 0
    for line in text.split("\n"):
        if BLANK_WORDS.search(line):
            dups += line in seen
            seen.add(line)
    times = collections.Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    again = {k for i in range(len(words) - 7) if times[tuple(words[i : i + 8])] > 1 for k in range(i, i + 8)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dups, len(again)
