"""Word and word-shingle hashes of Arrow text columns, vectorised over the UTF-8 bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_BLOCK = 1 << 18
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_CODES = np.random.default_rng(5).integers(1, 1 << 63, 256, dtype=np.uint64)
_CODES[65:91] = _CODES[97:123]  # A-Z count as a-z
_STEPS = np.random.default_rng(6).integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)
_POWERS: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "up" not in _POWERS or len(_POWERS["up"]) < n:
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            p = np.full(max(n, _BLOCK + 1), base, np.uint64)
            p[0] = 1
            _POWERS[name] = np.multiply.accumulate(p)
    return _POWERS["up"], _POWERS["down"]


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its n + 1 offsets (nulls are empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    if len(column) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    off = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    if column.null_count:
        keep = np.diff(off) * ~np.asarray(column.is_null())
        if keep.sum() != off[-1] - off[0]:
            return text_buffer(column.fill_null(""))
    return raw, off


def word_hashes(raw: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of ``raw`` and the byte each begins at. Words are runs without ASCII
    white space that don't cross ``starts`` (first bytes of texts); A-Z count as a-z."""
    n = len(raw)
    space = _SPACE[raw]
    inner = np.zeros(n, bool)
    inner[1:] = ~space[1:] & ~space[:-1]
    inner[starts[starts < n]] = False
    first = np.flatnonzero(~space & ~inner)
    if not len(first):
        return np.zeros(0, np.uint64), first
    ends_here = np.ones(n, bool)
    ends_here[:-1] = ~inner[1:]
    last = np.flatnonzero(~space & ends_here)
    up, down = _powers(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_CODES[raw] * up[:n], out=total[1:])
    return mix((total[last + 1] - total[first]) * down[first] + (last - first).astype(np.uint64)), first


def words_by_text(column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """(row, word hashes) of each text; texts are hashed in blocks, long ones cut at white space."""
    raw, off = text_buffer(column)
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + _BLOCK, "right")) - 1)
        if off[j] - off[i] <= 2 * _BLOCK:
            h, at = word_hashes(raw[off[i] : off[j]], off[i:j] - off[i])
            cut = np.searchsorted(at, off[i : j + 1] - off[i])
            for k in range(i, j):
                yield k, h[cut[k - i] : cut[k - i + 1]]
            i = j
            continue
        parts, s, end = [], int(off[i]), int(off[i + 1])
        while s < end:
            e = min(s + _BLOCK, end)
            while e < end and not (w := np.flatnonzero(_SPACE[raw[e : e + 65536]])).size:
                e = min(e + 65536, end)
            e = e if e >= end else e + int(w[0])
            parts.append(word_hashes(raw[s:e], np.zeros(1, np.int64))[0])
            s = e
        yield i, np.concatenate(parts)
        i += 1


def shingle_set(words: np.ndarray, n: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the ``n``-word shingles; of the whole sequence if it is shorter."""
    if not len(words):
        return words
    k = min(n, len(words))
    h = np.full(len(words) - k + 1, k, np.uint64)
    for j in range(k):
        h += words[j : len(words) - k + 1 + j] * _STEPS[j]
    return np.unique(mix(h))
