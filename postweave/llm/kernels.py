"""Vectorised text kernels over Arrow buffers: words, word hashes and rolling window hashes.

A word is a run of bytes other than 0x20 and 0x09-0x0D. Nothing here makes an object for each word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
#: Also ASCII punctuation, for terms of models.
BREAKS = SPACES.copy()
BREAKS[[b for b in range(0x21, 0x7F) if not chr(b).isalnum()]] = True
FOLD = np.arange(256, dtype=np.uint8)
FOLD[ord("A"): ord("Z") + 1] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = x + U64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def table(seed: int) -> np.ndarray:
    return mix(np.arange(256, dtype=U64) + U64(seed << 16))


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, U64)
    out[0] = 1
    return np.multiply.accumulate(out)


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts one after another, and n + 1 offsets; a null text is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset: column.offset + len(column) + 1]
    body = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return body[at[0]: at[-1]], at - at[0]


def pieces(offsets: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of documents of at most limit bytes together; a longer document stands alone."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def next_break(data: np.ndarray, at: int, end: int, breaks: np.ndarray, step: int) -> int:
    """Where the first break from at on stands, or end."""
    for lo in range(at, end, step):
        found = breaks[data[lo: min(end, lo + step)]]
        if found.any():
            return lo + int(found.argmax())
    return end


def stretches(data: np.ndarray, offsets: np.ndarray, limit: int, breaks: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of bytes of at most limit that cut no word; a longer word is a range of its own."""
    for lo, hi in pieces(offsets, limit):
        at, end = int(offsets[lo]), int(offsets[hi])
        while end - at > limit:  # one long document
            tail = breaks[data[at: at + limit]][::-1]
            to = at + limit - int(tail.argmax()) if tail.any() else next_break(data, at + limit, end, breaks, limit)
            yield at, to
            at = to
        if end > at:
            yield at, end


class Words:
    """doc (index), start, end (bytes) of each word, and one hash for each seed.

    Texts are worked through in stretches of at most limit bytes, so that what is held beside the
    words themselves doesn't grow with the longest text."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, fold: bool, seeds: tuple[int, ...] = (1,), limit: int = 1 << 20, breaks: np.ndarray = SPACES):
        index = np.int32 if len(data) < 1 << 31 else np.int64
        parts = [self._some(data, offsets, a, b, fold, seeds, breaks, index, limit) for a, b in stretches(data, offsets, limit, breaks)]
        empty = [np.empty(0, index)] * 3 + [np.empty(0, U64)] * len(seeds)
        self.doc, self.start, self.end, *self.hashes = [np.concatenate(x) for x in zip(*parts)] if parts else empty
        self.n_docs = len(offsets) - 1

    @staticmethod
    def _some(data, offsets, a, b, fold, seeds, breaks, index, limit):
        bases = [0x100000001B3 + (seed << 21) for seed in seeds]
        if b - a > limit:  # one word
            doc, sums = int(np.searchsorted(offsets, a, "right")) - 1, [U64(0)] * len(seeds)
            for lo in range(a, b, limit):
                part = data[lo: min(b, lo + limit)]
                part = FOLD[part] if fold else part
                for i, (seed, base) in enumerate(zip(seeds, bases)):
                    own = (table(seed)[part] * powers(base, len(part))).sum(dtype=U64)
                    sums[i] = U64((int(sums[i]) + int(own) * pow(base, lo - a, 1 << 64)) & 0xFFFFFFFFFFFFFFFF)
            size = np.array([b - a]).astype(U64)
            return [np.array([x], index) for x in (doc, a, b)] + [mix(np.array([x], U64) ^ size) for x in sums]
        part = data[a:b]
        if fold:
            part = FOLD[part]
        n = len(part)
        at = offsets[np.searchsorted(offsets, a): np.searchsorted(offsets, b, "right")] - a  # where documents begin or end
        inside = ~breaks[part]
        opens = np.empty(n + 1, bool)  # a new document, or a space before
        opens[0], opens[n] = True, True
        opens[1:n] = ~inside[: n - 1]
        opens[at] = True
        start = np.flatnonzero(inside & opens[:n])
        shuts = opens[1:].copy()
        shuts[: n - 1] |= ~inside[1:]
        end = np.flatnonzero(inside & shuts) + 1
        doc = np.searchsorted(offsets, start + a, "right") - 1
        out = [x.astype(index) for x in (doc, start + a, end + a)]
        if len(start) == 0:
            return out + [np.empty(0, U64)] * len(seeds)
        where = np.arange(n)
        local = where - np.maximum.accumulate(np.where(inside & opens[:n], where, 0))
        local[~inside] = 0
        for seed, base in zip(seeds, bases):
            each = table(seed)[part] * powers(base, int((end - start).max()) + 1)[local]
            each[~inside] = 0
            out.append(mix(np.add.reduceat(each, start) ^ (end - start).astype(U64)))
        return out

    def counts(self) -> np.ndarray:
        return np.bincount(self.doc, minlength=self.n_docs)


def rolling(hashes: np.ndarray, k: int, base: int = 0x9E3779B97F4A7C15 | 1) -> np.ndarray:
    """Hash of each k consecutive words, by doubling: log k passes."""
    n = len(hashes)
    if n < k:
        return np.empty(0, U64)
    power = lambda m: U64(pow(base, m, 1 << 64))
    done, size, run, length = None, 0, hashes, 1
    while True:
        if k & length:
            done = run if done is None else run[: n - length - size + 1] * power(size) + done[length: n - size + 1]
            size += length
        if length * 2 > k:
            return mix(done[: n - k + 1])
        run = run[: len(run) - length] * power(length) + run[length:]
        length *= 2


def windows(words: Words, k: int, which: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Index of the first word, and the hash, of each window that lies in one document."""
    h = rolling(words.hashes[which], k)
    at = np.flatnonzero(words.doc[: len(h)] == words.doc[k - 1:]) if len(h) else np.empty(0, np.int64)
    return at, h[at]


def sliding_min(values: np.ndarray, n: int) -> np.ndarray:
    """The least of each n consecutive values, by doubling."""
    out, length = values, 1
    while length * 2 <= n:
        out, length = np.minimum(out[: len(out) - length], out[length:]), length * 2
    return np.minimum(out[: len(out) - (n - length)], out[n - length:]) if length < n else out


def shingle_sets(words: Words, k: int) -> list[np.ndarray]:
    """Sorted distinct k-word shingle hashes of each document; fewer words are one shingle."""
    at, h = windows(words, k)
    bounds = np.searchsorted(words.doc[at], np.arange(words.n_docs + 1))
    first = np.searchsorted(words.doc, np.arange(words.n_docs + 1))
    out = []
    for i in range(words.n_docs):
        n = first[i + 1] - first[i]
        if n >= k:
            out.append(np.unique(h[bounds[i]: bounds[i + 1]]))
        elif n:
            out.append(mix(rolling(words.hashes[0][first[i]: first[i + 1]], int(n)) + U64(n)))
        else:
            out.append(np.empty(0, U64))
    return out


def letter_stretches(data: bytes, limit: int = 1 << 20) -> Iterator[bytes]:
    """Parts of about limit bytes, cut before a space only."""
    at = 0
    while at < len(data):
        end = data.find(b" ", at + limit)
        end = len(data) if end < 0 else end
        yield data[at:end]
        at = end
