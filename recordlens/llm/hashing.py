"""Hashes of words and of their beginnings, for many texts at once, without a Python loop over words."""

from __future__ import annotations

import numpy as np

PREFIXES = (4, 5, 6)  # bytes
_ODD = np.uint64(0x9E3779B97F4A7C15 | 1)
_BACK = np.uint64(pow(int(_ODD), -1, 1 << 64))
_SPACES = np.zeros(256, bool)
_SPACES[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


# Bytes of text that are hashed in one go.
PART = 1 << 20


def word_hashes(texts: list[str | None], prefixes: tuple[int, ...] = PREFIXES, *, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """For every word (cut at ASCII white space, with ``lower`` A-Z lower-cased) its hash and those of its beginnings, and where each
    text's words begin (one more entry at the end).  A word shorter than a beginning stands for it whole."""
    parts, offsets, first = [], [np.zeros(1, np.int64)], 0
    sizes = np.cumsum([len(t or "") for t in texts])
    while first < len(texts):
        last = max(first + 1, int(np.searchsorted(sizes, (sizes[first - 1] if first else 0) + PART, "right")))
        found, places = _word_hashes(texts[first:last], prefixes, lower)
        parts.append(found)
        offsets.append(places[1:] + offsets[-1][-1])
        first = last
    return (np.concatenate(parts) if parts else np.zeros((0, 1 + len(prefixes)), np.uint64)), np.concatenate(offsets)


def _word_hashes(texts: list[str | None], prefixes: tuple[int, ...], lower: bool) -> tuple[np.ndarray, np.ndarray]:
    data = b"\n".join((t or "").encode() for t in texts) + b"\n"
    raw = np.frombuffer(data, np.uint8)
    raw = _LOWER[raw] if lower else raw
    space = _SPACES[raw]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    if not space[0]:
        edge = np.append(0, edge)
    starts, ends = edge[0::2], edge[1::2]
    borders = np.cumsum([0, *(len((t or "").encode()) + 1 for t in texts)])
    offsets = np.searchsorted(starts, borders)
    # A polynomial hash of any stretch, from running sums modulo 2^64.
    powers = np.full(len(raw), _ODD)
    powers[0] = 1
    np.cumprod(powers, out=powers)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * powers, out=sums[1:])
    back = np.full(len(raw), _BACK)
    back[0] = 1
    np.cumprod(back, out=back)
    out = np.empty((len(starts), 1 + len(prefixes)), np.uint64)
    for k, limit in enumerate((None, *prefixes)):
        stop = ends if limit is None else np.minimum(ends, starts + limit)
        out[:, k] = mixed((sums[stop] - sums[starts]) * back[starts] + np.uint64(k))
    return out, offsets


def hash_of(word: str) -> int:
    return int(word_hashes([word], ())[0][0, 0])
