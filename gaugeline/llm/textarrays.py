"""Whole columns of text as arrays of word and shingle hashes, for use inside Arrow batches.

Words are the runs between the separators of `common.SPACE`, with A-Z lower-cased. A word's hash is the sum over its
bytes of a strong mix of (byte, place in word); a shingle's hash mixes the hashes of its words by place. Hashes have 64
bits; what is decided by them is exact up to collisions of that width."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_BYTES = np.arange(256, dtype=np.uint8)
_LOWER = np.where((_BYTES >= 65) & (_BYTES <= 90), _BYTES + 32, _BYTES).astype(np.uint8)
_SPACE = (_BYTES == 32) | ((_BYTES >= 9) & (_BYTES <= 13))
CHUNK = 1 << 20            # bytes hashed at a time, cut at a separator


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A well-known 64-bit finalizer; bijective."""
    x = x + np.uint64((salt * 0x9E3779B97F4A7C15 + 0x9E3779B97F4A7C15) % (1 << 64))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_PLACE = mix(np.arange(64 * 256, dtype=np.uint64), 5)          # (place, byte) -> mix, for the first 64 places


def raw(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column and the offsets of its rows; a null is empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = col.cast(pa.large_string()).fill_null("")
    off = np.frombuffer(col.buffers()[1], np.int64)[col.offset:col.offset + len(col) + 1] if len(col) else np.zeros(1, np.int64)
    data = np.frombuffer(col.buffers()[2], np.uint8)[off[0]:off[-1]] if off[-1] > off[0] else np.empty(0, np.uint8)
    return data, off - off[0]


def word_hashes(col: pa.Array, lower: bool = True, space: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of every word, word offsets per row, byte position of every word's start within the column's bytes). `space`
    marks the bytes that separate words."""
    data, off = raw(col)
    n = len(data)
    edge = np.zeros(n + 1, bool)
    edge[off] = True
    hashes, starts, at = [np.empty(0, np.uint64)], [np.empty(0, np.int64)], 0
    while at < n:
        end = min(at + CHUNK, n)
        while end < n and not (edge[end] or space[data[end]]):
            nxt = np.flatnonzero(edge[end:end + CHUNK] | np.append(space[data[end:end + CHUNK]], True)[:len(edge[end:end + CHUNK])])
            end = end + int(nxt[0]) if len(nxt) else min(end + CHUNK, n)
        b = data[at:end]
        word = ~space[b]
        start = word.copy()
        start[1:] &= ~word[:-1] | edge[at + 1:end]
        s = np.flatnonzero(start)
        if len(s):
            w = np.flatnonzero(word)                             # bytes of words only
            which = np.cumsum(start[w]) - 1
            place = w - s[which]
            b = (_LOWER[b] if lower else b)[w].astype(np.int64)
            v = _PLACE[np.minimum(place, 63) * 256 + b]
            far = place >= 63
            if far.any():
                v[far] = mix((place[far] * 256 + b[far]).astype(np.uint64), 5)
            hashes.append(np.add.reduceat(v, np.flatnonzero(start[w])))
            starts.append(s + at)
        at = end
    h, s = np.concatenate(hashes), np.concatenate(starts)
    return mix(h, 1), np.searchsorted(s, off), s


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of every window of k words; of the whole sequence when it is shorter; none without words."""
    n = len(words)
    if not n:
        return words
    w = min(k, n)
    total = np.zeros(n - w + 1, np.uint64)
    for j in range(w):
        total += words[j:n - w + 1 + j] * np.uint64(_ODD[j % 64])
    return mix(total, w)


_ODD = [int(x) | 1 for x in mix(np.arange(64, dtype=np.uint64), 9)]


def set_print(values: np.ndarray) -> bytes:
    """128-bit fingerprint of a set of distinct hashes, in any order."""
    return b"".join(int(mix(values, s).sum(dtype=np.uint64)).to_bytes(8, "big") for s in (21, 22))
