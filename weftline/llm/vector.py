"""Words and word hashes of Arrow text columns in numpy, a bounded piece at a time."""

from __future__ import annotations

import numpy as np

PIECE = 1 << 20

_rng = np.random.Generator(np.random.PCG64(20240229))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_TABLE = _rng.integers(1, 2**63, 256, dtype=np.uint64)[_LOWER] * np.uint64(2) + np.uint64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 2**64)


def _cache() -> dict:
    """One per worker process, whatever module copy asks: functions arrive here by value."""
    import sys
    import types

    return sys.modules.setdefault("_weftline_cache", types.ModuleType("_weftline_cache")).__dict__


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    kept = _cache().get("powers")
    if kept is None or len(kept[0]) < n:
        size = max(n, PIECE + (1 << 16))
        up, down = np.full(size, _BASE, np.uint64), np.full(size, _INVERSE, np.uint64)
        up[0] = down[0] = 1
        kept = _cache()["powers"] = (np.multiply.accumulate(up), np.multiply.accumulate(down))
    return kept[0][:n], kept[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; a new array."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_buffers(column) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of a text column; null is empty."""
    import pyarrow as pa

    column = column.fill_null("") if column.null_count else column
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, kind, len(column) + 1, column.offset * np.dtype(kind).itemsize).astype(np.int64)
    return np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), at


def _piece_words(buf: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    word = ~_SPACE[buf]
    before, after = np.empty_like(word), np.empty_like(word)
    before[0], before[1:] = False, word[:-1]
    after[-1], after[:-1] = False, word[1:]
    inner = breaks[(breaks > 0) & (breaks < len(buf))]
    before[inner] = False
    after[inner - 1] = False
    starts, ends = np.flatnonzero(word & ~before), np.flatnonzero(word & ~after) + 1
    up, down = _powers(len(buf) + 1)
    total = np.empty(len(buf) + 1, np.uint64)
    total[0] = 0
    np.cumsum(_TABLE[buf] * up[:-1], out=total[1:])
    return starts, ends, mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def words(buf: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the texts buf[at[i]:at[i+1]]: start and end of each word in buf, and its hash with A-Z lower-cased.

    Works through pieces of about PIECE bytes, cut where a word ends, so temporaries stay small for any text.
    """
    parts, lo, end = [], int(at[0]), int(at[-1])
    while lo < end:
        hi = min(lo + PIECE, end)
        while hi < end:  # to a space or the start of a text
            space = np.flatnonzero(_SPACE[buf[lo:hi]])
            k = np.searchsorted(at, hi, "right") - 1
            cutoff = max(int(at[k]), lo + int(space[-1]) + 1 if len(space) else 0)
            if cutoff > lo:
                hi = cutoff
                break
            hi = min(hi + PIECE, end)
        inside = at[np.searchsorted(at, lo, "left") : np.searchsorted(at, hi, "right")] - lo
        s, e, h = _piece_words(buf[lo:hi], inside)
        parts.append((s + lo, e + lo, h))
        lo = hi
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def spans(at: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Offsets into the words of each text: text i has words [out[i], out[i+1])."""
    return np.searchsorted(starts, at, "left")


def shingles(hashes: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Text number and hash of each k-word shingle, not distinct; a text with 1 to k - 1 words has one, of them all."""
    counts = np.diff(first)
    owner = np.repeat(np.arange(len(counts)), counts)
    n, width = len(hashes), np.uint64(0)
    out, left = np.zeros(n, np.uint64), counts[owner] - (np.arange(n) - first[:-1][owner])
    factor = np.uint64(0xD6E8FEB86659FD93)
    for j in range(k):
        take = np.zeros(n, np.uint64)
        take[: max(n - j, 0)] = hashes[j:]
        take[left <= j] = 0
        width = width + np.uint64(1)
        out = out * factor + np.where(left > j, mix(take + width), np.uint64(0))
    keep = (left >= k) | ((counts[owner] < k) & (left == counts[owner]))
    return owner[keep], mix(out[keep])


def distinct(owner: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (owner, value), by owner, then value; owner comes sorted."""
    if not len(owner):
        return owner, values
    order = np.lexsort((values, owner))
    o, v = owner[order], values[order]
    new = np.ones(len(o), bool)
    new[1:] = (o[1:] != o[:-1]) | (v[1:] != v[:-1])
    return o[new], v[new]


def groups(at: np.ndarray, limit: int = PIECE):
    """Ranges of texts of about limit bytes together, at least one text each."""
    lo = 0
    while lo < len(at) - 1:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + limit, "right")) - 1)
        yield lo, hi
        lo = hi
