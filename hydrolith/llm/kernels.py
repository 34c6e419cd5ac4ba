"""Vectorised word hashing, n-gram hashing and minimiser selection."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BASE = np.uint64(0x9E3779B97F4A7C15)
MIX = np.uint64(0xD6E8FEB86659FD93)
SHIFT = np.uint64(32)
#: A fixed random value for each byte; those of A-Z are those of a-z.
BYTES = np.random.default_rng(2024).integers(1, 1 << 63, 256, dtype=np.uint64)
BYTES[65:91] = BYTES[97:123]
WORDY = np.ones(256, bool)
WORDY[[32, *range(9, 14)]] = False
#: Bytes of short texts that are hashed at once.
PIECE = 1 << 18


def split_words(text: str | None) -> list[bytes]:
    """ASCII-lower-cased words between ASCII white space; none for a null text."""
    return text.encode("utf-8", "replace").lower().split() if text else []


class WordHash:
    """64-bit hashes of the words of a text: a polynomial in the bytes of each, from differences of one running sum."""

    def __init__(self) -> None:
        self.powers = self.inverses = np.ones(1, np.uint64)

    def grow(self, n: int) -> None:
        """Powers of the base and of its inverse modulo 2^64 up to n; they are kept for the longest text so far."""
        base, inverse = int(BASE), pow(int(BASE), -1, 1 << 64)
        with np.errstate(over="ignore"):
            self.powers, self.inverses = np.full((2, n + 1), 1, np.uint64)
            self.powers[1:], self.inverses[1:] = base, inverse
            np.cumprod(self.powers, out=self.powers)
            np.cumprod(self.inverses, out=self.inverses)

    def __call__(self, text: str | None) -> np.ndarray:
        raw = np.frombuffer((text or "").encode("utf-8", "replace"), np.uint8)
        return self.many(raw, np.array([0, len(raw)]))[0]

    def many(self, raw: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of texts that follow each other in raw, cut at ``cuts``: hashes of their words, and which is the first of each (and how many there are)."""
        if not len(raw):
            return np.empty(0, np.uint64), np.zeros(len(cuts), np.int64)
        if len(raw) >= len(self.powers):
            self.grow(max(2 * len(self.powers), len(raw) + 1, 1 << 14))
        word = WORDY[raw]
        first, last = word.copy(), word.copy()
        first[1:] &= ~word[:-1]
        last[:-1] &= ~word[1:]
        inner = cuts[(cuts > 0) & (cuts < len(raw))]
        first[inner], last[inner - 1] = word[inner], word[inner - 1]
        start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
        with np.errstate(over="ignore"):
            total = np.zeros(len(raw) + 1, np.uint64)
            np.cumsum(BYTES[raw] * self.powers[: len(raw)], out=total[1:])
            return mixed((total[end] - total[start]) * self.inverses[start]), np.searchsorted(start, cuts)

    def pieces(self, texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Index of the first, and many(), of texts without nulls, some PIECE bytes of whole texts at a time."""
        _, offsets, data = texts.buffers()
        width = np.int64 if pa.types.is_large_string(texts.type) else np.int32
        offsets = np.frombuffer(offsets, width)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
        raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
        i = 0
        while i < len(texts):
            j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + PIECE, "right")) - 1)
            yield i, *self.many(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            i = j


def word_hashes(text: str | None, seen: WordHash) -> np.ndarray:
    return seen(text)


def mixed(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ (h >> SHIFT)) * MIX
        h = (h ^ (h >> SHIFT)) * MIX
        return h ^ (h >> SHIFT)


def ngrams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n words, built by doubling: a run of 2m words joins two of m."""
    count = len(hashes) - n + 1
    if count <= 0:
        return np.empty(0, np.uint64)
    power, run, length = BASE, hashes, 1
    out, done = None, 0
    left = n
    with np.errstate(over="ignore"):
        while left:
            if left & 1:
                if out is None:
                    out, done = run, length
                else:
                    m = min(len(out), len(run) - done) if len(run) > done else 0
                    out, done = out[:m] * power + run[done : done + m], done + length
            left >>= 1
            if left:
                m = len(run) - length
                run = run[: max(m, 0)] * power + run[length:] if m > 0 else run[:0]
                length, power = 2 * length, power * power
        return mixed(out[:count])


def sliding(values: np.ndarray, width: int, pick) -> np.ndarray:
    """pick (np.minimum or np.maximum) over each window of width values."""
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out = pick(out[:-step], out[step:])
        have += step
    return out


def minimisers(grams: np.ndarray, window: int, every: bool = False) -> np.ndarray:
    """Positions whose hash is the least of some window of that many n-grams.

    Two texts that share a run of window n-grams select the same position in it. Of a run of equal hashes only
    the first counts, unless ``every`` is set. A text with fewer n-grams counts as one window.
    """
    n = len(grams)
    if n == 0:
        return np.empty(0, np.int64)
    if n <= window:
        return np.array([int(np.argmin(grams))], np.int64)
    least = sliding(grams, window, np.minimum)
    padded = np.concatenate([np.zeros(window - 1, np.uint64), least, np.zeros(window - 1, np.uint64)])
    chosen = grams == sliding(padded, window, np.maximum)
    if not every:
        chosen[1:] &= grams[1:] != grams[:-1]
    return np.flatnonzero(chosen)


def minimisers_of_many(grams: np.ndarray, first: np.ndarray, counts: np.ndarray, window: int) -> np.ndarray:
    """minimisers() of many texts with every=True: a text's n-grams are counts in number from first on; others lie across two texts."""
    chosen = np.zeros(len(grams), bool)
    long = counts > window
    if long.any():
        least = sliding(grams, window, np.minimum)
        change = np.zeros(len(least) + 1, np.int64)
        np.add.at(change, first[long], 1)
        np.add.at(change, first[long] + counts[long] - window + 1, -1)
        least = np.where(np.cumsum(change)[:-1] > 0, least, np.uint64(0))  # windows within one text
        padded = np.concatenate([np.zeros(window - 1, np.uint64), least, np.zeros(window - 1, np.uint64)])
        top = sliding(padded, window, np.maximum)
        chosen = (grams == top) & (top > 0)
    for s, n in zip(first[~long].tolist(), counts[~long].tolist(), strict=True):
        if n > 0:
            chosen[s + int(np.argmin(grams[s : s + n]))] = True
    return np.flatnonzero(chosen)
