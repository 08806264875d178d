"""Maximal periodic runs of words, by block convolution.

A run is a stretch of consecutive words with smallest period q (words q apart are equal) that no neighbouring word
extends, long enough to hold the period twice. `find` gives every text its runs and the text without their repeats.

Method. At the dyadic scales B = 1, 2, 4, ... the words of a batch of texts are cut into aligned blocks of B words. A run
with period q in [2B, 4B) holds a whole block and, q words later, the same block again. So for every block the sum of
squared differences of word numbers against the following window is taken at all these distances at once, by an exact
number-theoretic transform (as many primes as the largest possible sum needs); where the sum is zero, the block occurs.
Neighbouring blocks that occur at one distance form a chain, and the chain is extended word by word at both ends, by less
than a block, as the next block does not occur. Two exact sieves go before the transform: a block can only occur if all its
grams (four words; single words at the two smallest scales) come again within 4B words; and a block whose window lies
inside a run of period q <= B can only occur there at multiples of q, which are no smallest periods.

Texts of a batch stand behind one another with a mark of their own between, so no match crosses. Memory goes with
`SPAN` words, or with one text where that is longer.

Nulls: a null text or array has no words and no runs, and collapses to the empty text; a null word equals other null words
and is left out when the rest is joined. Empty tables give empty tables; repeated rows are each answered; other columns
pass through, and an input column that has an output's name is replaced. Ties do not arise: a stretch has one smallest
period."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeline.llm.common import add_columns, fresh
from gaugeline.llm.common import words as words_of
from gaugeline.llm.textarrays import mix

LEAST = 12                 # words that a run has at least
SPAN = 1 << 18             # words searched at a time, whole texts
CELLS = 1 << 19            # numbers that one transform holds
GRAM = 4                   # words of a gram in the sieve
#: Primes with a primitive root each; p - 1 divides by 2^23 at least (fixed values).
PRIMES = [(998244353, 3), (469762049, 3), (167772161, 3), (754974721, 11)]


def _roots(p: int, g: int, n: int) -> np.ndarray:
    """The first n / 2 powers of a primitive n-th root of one modulo p, by doubling."""
    w, out = pow(g, (p - 1) // n, p), np.ones(1, np.uint64)
    while len(out) < n // 2:
        out = np.concatenate([out, out * np.uint64(pow(w, len(out), p)) % np.uint64(p)])
    return out


def _forward(a: np.ndarray, p: int, roots: np.ndarray) -> np.ndarray:
    """Transform of every row; the result is in bit-reversed order, which a product of two transforms does not mind."""
    rows, n = a.shape
    q, h = np.uint64(p), n // 2
    while h:
        v = a.reshape(rows, n // (2 * h), 2, h)
        x, y = v[:, :, 0], v[:, :, 1]
        out = np.empty_like(v)
        s = x + y
        out[:, :, 0] = np.where(s >= q, s - q, s)
        out[:, :, 1] = (x + (q - y)) * roots[::n // (2 * h)] % q
        a, h = out.reshape(rows, n), h // 2
    return a


def _backward(a: np.ndarray, p: int, roots: np.ndarray) -> np.ndarray:
    rows, n = a.shape
    q, h = np.uint64(p), 1
    back = np.concatenate([roots[:1], (q - roots[:0:-1])]) if n > 2 else roots      # w^-k = -w^(n/2-k)
    while h < n:
        v = a.reshape(rows, n // (2 * h), 2, h)
        x, y = v[:, :, 0], v[:, :, 1] * back[::n // (2 * h)] % q
        out = np.empty_like(v)
        s, d = x + y, x + (q - y)
        out[:, :, 0] = np.where(s >= q, s - q, s)
        out[:, :, 1] = np.where(d >= q, d - q, d)
        a, h = out.reshape(rows, n), h * 2
    return a * np.uint64(pow(n, -1, p)) % q


def zero_mismatches(x: np.ndarray, starts: np.ndarray, size: int, first: int, count: int) -> tuple[np.ndarray, np.ndarray]:
    """(place in `starts`, distance) wherever the block of `size` words at a start occurs again `first` ... `first + count - 1`
    words later. `x`: word numbers, none negative, reaching past every window."""
    n = 1 << (count + 2 * size - 3).bit_length() if count + 2 * size > 3 else 1
    n, top, width = max(n, 2), int(x.max()) ** 2 * size, count + size - 1
    primes, product = [], 1
    for pg in PRIMES:
        if product <= top:
            primes.append(pg)
            product *= pg[0]
    if product <= top:
        raise ValueError("word numbers are too large for an exact sum")
    squares = np.concatenate([np.zeros(1, np.uint64), np.cumsum(x.astype(np.uint64) ** np.uint64(2))])
    found, at, step = [], [], max(CELLS // n, 1)
    for i in range(0, len(starts), step):
        s = starts[i:i + step]
        block, window = x[s[:, None] + np.arange(size - 1, -1, -1)], x[s[:, None] + first + np.arange(width)]
        far = s[:, None] + first + np.arange(count)
        both = (squares[s + size] - squares[s])[:, None] + (squares[far + size] - squares[far])
        zero = np.ones(both.shape, bool)
        for p, g in primes:
            roots, q = _roots(p, g, n), np.uint64(p)
            a, b = np.zeros((len(s), n), np.uint64), np.zeros((len(s), n), np.uint64)
            a[:, :size], b[:, :width] = block, window
            a %= q
            b %= q
            product = _backward(_forward(a, p, roots) * _forward(b, p, roots) % q, p, roots)[:, size - 1:size - 1 + count]
            zero &= both % q == product * np.uint64(2) % q
        b, d = np.nonzero(zero)
        found.append(b + i)
        at.append(d + first)
    return (np.concatenate(found), np.concatenate(at)) if found else (np.empty(0, np.int64), np.empty(0, np.int64))


def _again(keys: np.ndarray) -> np.ndarray:
    """How far ahead each key comes again; the length of the array where it does not."""
    out, order = np.full(len(keys), len(keys), np.int64), np.argsort(keys, kind="stable")
    same = keys[order[1:]] == keys[order[:-1]]
    out[order[:-1][same]] = (order[1:] - order[:-1])[same]
    return out


def _extended(x: np.ndarray, l: np.ndarray, r: np.ndarray, d: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Equal words before l and from r on, counted up to one block; whether a count came to a whole block."""
    before, after = np.empty(len(l), np.int64), np.empty(len(l), np.int64)
    for i in range(0, len(l), step := max(CELLS // size, 1)):
        c = slice(i, i + step)
        left = l[c, None] - 1 - np.arange(size)
        differ = (left < 0) | (x[np.maximum(left, 0)] != x[np.maximum(left, 0) + d[c, None]])
        before[c] = np.where(differ.any(axis=1), differ.argmax(axis=1), size)
        right = r[c, None] + np.arange(size)
        differ = x[right] != x[right + d[c, None]]
        after[c] = np.where(differ.any(axis=1), differ.argmax(axis=1), size)
    return l - before, r + after, (before == size) | (after == size)


def runs(x: np.ndarray, longest: int, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, smallest period) of every run of a sequence of numbers in which no text is longer than `longest`."""
    n = len(x)
    lo, hi, per = (np.empty(0, np.int64) for _ in range(3))
    if not n:
        return lo, hi, per
    top = 1
    while 4 * top <= longest:
        top *= 2
    # Past the end stands a number of its own: a block that reaches there holds the last word, whose copy would lie beyond.
    x = np.concatenate([x, np.full(8 * top + 8, int(x.max()) + 1)])
    grams = np.zeros(n, np.uint64)
    for j in range(GRAM):
        grams = mix(grams + x[j:n + j].astype(np.uint64), j)
    single, gram, size = _again(x[:n]), _again(grams), 1
    while size <= top:
        first = 1 if size == 1 else 2 * size
        wide = 1 if size < GRAM else GRAM
        near = np.append(single if wide == 1 else gram, np.full(size, n))
        starts = np.arange(0, n, size)
        spread = np.lib.stride_tricks.sliding_window_view(near, size - wide + 1)[::size][:len(starts)]
        alive = spread.max(axis=1) < 4 * size
        inside = (per <= size) & (hi - lo >= 5 * size)
        if inside.any():
            a, b = -(-lo[inside] // size), (hi[inside] - 5 * size) // size
            ok = b >= a
            change = np.zeros(len(starts) + 1, np.int64)
            np.add.at(change, a[ok], 1)
            np.add.at(change, b[ok] + 1, -1)
            alive &= np.cumsum(change[:-1]) == 0
        starts = starts[alive]
        at, d = zero_mismatches(x, starts, size, first, 4 * size - first)
        s = starts[at]
        if len(at) and (per <= size).any():
            # Nor is a multiple of the period a smallest one where block and copy lie in one run: of the runs that
            # begin before a block, the one that reaches farthest is looked at.
            l, e, q = (v[per <= size] for v in (lo, hi, per))
            far = np.maximum.accumulate(np.where(e == np.maximum.accumulate(e), np.arange(len(e)), 0))
            k = np.searchsorted(l, s, side="right") - 1
            run = far[np.maximum(k, 0)]
            ok = ~((k >= 0) & (s + d + size <= e[run]) & (d % q[run] == 0) & (d > q[run]))
            s, d = s[ok], d[ok]
        if len(s):
            order = np.lexsort((s, d))
            s, d = s[order], d[order]
            new = np.append(True, (d[1:] != d[:-1]) | (s[1:] != s[:-1] + size))
            head = np.flatnonzero(new)
            tail = np.append(head[1:], len(s)) - 1
            l, r, d = s[head], s[tail] + size, d[head]
            # A chain is worth extending only if it can come to the length of a run.
            ok = r - l + 2 * (size - 1) + d >= np.maximum(least, 2 * d)
            l, r, whole = _extended(x, l[ok], r[ok], d[ok], size)
            d, e = d[ok], r + d[ok]
            ok = ~whole & (e - l >= np.maximum(least, 2 * d))
            lo, hi, per = np.append(lo, l[ok]), np.append(hi, e[ok]), np.append(per, d[ok])
            order = np.lexsort((per, hi, lo))
            lo, hi, per = lo[order], hi[order], per[order]
            own = np.append(True, (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])) if len(lo) else np.empty(0, bool)
            lo, hi, per = lo[own], hi[own], per[own]
        size *= 2
    order = np.lexsort((per, lo))
    return lo[order], hi[order], per[order]


def _spans(sizes: np.ndarray):
    """Ranges of texts of about SPAN words."""
    i = 0
    while i < len(sizes):
        j, total = i + 1, sizes[i]
        while j < len(sizes) and total + sizes[j] <= SPAN:
            total += sizes[j]
            j += 1
        yield i, j
        i = j


def _joined(words: pa.Array, rows: np.ndarray, keep: np.ndarray, count: int) -> pa.Array:
    """The kept words of each row, one space between."""
    words = words.cast(pa.large_string())
    off = np.frombuffer(words.buffers()[1], np.int64)[words.offset:words.offset + len(words) + 1] if len(words) else np.zeros(1, np.int64)
    data = words.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    begin, row = off[:-1][keep], rows[keep]
    size = np.diff(off)[keep] + 1
    at = np.cumsum(size) - size
    out = np.full(int(size.sum()), 32, np.uint8)
    put = np.ones(len(out), bool)
    put[at + size - 1] = False
    out[put] = data[(np.repeat(begin - at, size) + np.arange(len(out)))[put]]
    last = np.bincount(row, weights=size, minlength=count).astype(np.int64)
    # The space behind a row's last word goes.
    stay = np.ones(len(out), bool)
    ends = np.cumsum(last)
    stay[ends[last > 0] - 1] = False
    cut = np.append(0, np.cumsum(np.maximum(last - 1, 0)))
    return pa.LargeStringArray.from_buffers(count, pa.py_buffer(cut.astype(np.int64)), pa.py_buffer(out[stay])).cast(pa.string())


def _answer(col: pa.Array, least: int) -> tuple[pa.Array, pa.Array]:
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    sizes = np.asarray(col.value_lengths().fill_null(0)).astype(np.int64)
    flat, off = col.flatten(), np.append(0, np.cumsum(sizes))
    made, texts, place = [], [], []
    for i, j in _spans(sizes):
        part, own = flat.slice(off[i], off[j] - off[i]), sizes[i:j]
        codes = part.dictionary_encode()
        ids = np.asarray(codes.indices.fill_null(len(codes.dictionary))).astype(np.int64)
        top, rows = len(codes.dictionary) + 1, np.repeat(np.arange(j - i), own)
        # One mark between texts: word k of row r stands at k + r.
        x = np.empty(len(ids) + (j - i), np.int64)
        where = np.arange(len(ids)) + rows
        marks = off[i + 1:j + 1] - off[i] + np.arange(j - i)
        x[where], x[marks] = ids, top + np.arange(j - i)
        lo, hi, per = runs(x, int(own.max(initial=0)), least)
        change = np.zeros(len(x) + 1, np.int64)
        np.add.at(change, lo + per, 1)
        np.add.at(change, hi, -1)
        keep = (np.cumsum(change[:-1]) == 0)[where] & np.asarray(part.is_valid())
        texts.append(_joined(part, rows, keep, j - i))
        row = np.searchsorted(marks, lo)
        made.append(np.stack([lo - np.append(0, marks + 1)[row], hi - lo, per]))
        place.append(np.bincount(row, minlength=j - i))
    triple = np.concatenate(made, axis=1) if made else np.empty((3, 0), np.int64)
    kind = [pa.field(c, pa.int64()) for c in ("start", "length", "period")]
    structs = pa.StructArray.from_arrays([pa.array(v) for v in triple], fields=kind)
    offsets = np.append(0, np.cumsum(np.concatenate(place))) if place else np.zeros(1, np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), structs), pa.concat_arrays(texts) if texts else pa.array([], pa.string())


def find(df: DataFrame, text: str = "text", words: str | None = None, least: int = LEAST, runs: str = "runs", collapsed: str = "collapsed") -> DataFrame:
    """Append `runs` (array of start, length, period; by start, then period) and `collapsed` (the words that no run repeats,
    joined by one space). The words are those of the column `text`, or the array column `words` if one is named. A word goes
    if some run holds it after that run's first period."""
    own = fresh(df, "_words")
    df = df.withColumn(own, words_of(F.col(text)) if words is None else F.col(words))

    def fn(b):
        found, rest = _answer(b.column(own), least)
        return {runs: found, collapsed: rest}

    return add_columns(df, fn, f"`{runs}` array<struct<start bigint, length bigint, period bigint>>, `{collapsed}` string").drop(own)
