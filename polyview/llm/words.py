"""Words of a batch of texts as numpy arrays of hashes.

A word is a maximal run of bytes other than space, tab, line feed, vertical tab,
form feed and carriage return.  Words are hashed without a Python loop: with
prefix sums of ``table[byte] * base**i`` a word's sum is a difference, divided by
``base**start`` so that it does not depend on the place.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from polyview.llm.common import process_state

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
SEGMENT = 1 << 18  # bytes hashed at once
U = np.uint64


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection that spreads every bit over the word."""
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, U)
    out[0] = 1
    return np.cumprod(out)


def _make_tables(seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    base = int(rng.integers(1, 2**63)) * 2 + 1
    table = rng.integers(0, 2**64, 256, U, endpoint=False)
    return table, _powers(base, SEGMENT), _powers(pow(base, -1, 2**64), SEGMENT)


def _tables(seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return process_state(f"word_tables_{seed}", lambda: _make_tables(seed))


@dataclass
class Words:
    """``starts`` and ``ends`` of all words in ``buf``; row r owns words ``first[r]`` to ``first[r + 1]``."""

    buf: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def rows(self) -> np.ndarray:
        """The row of each word."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def hashes(self, seed: int) -> np.ndarray:
        """64-bit hash of each word."""
        table, powers, inverse = _tables(seed)
        out = np.empty(len(self.starts), U)
        at = 0
        while at < len(self.starts):
            begin = self.starts[at]
            to = max(at + 1, int(np.searchsorted(self.ends, begin + SEGMENT, "right")))
            end = self.ends[to - 1]
            if end - begin > SEGMENT:  # one word longer than a segment: piece by piece
                out[at] = self._long(begin, end, table, powers)
            else:
                sums = np.zeros(end - begin + 1, U)
                np.cumsum(table[self.buf[begin:end]] * powers[:end - begin], out=sums[1:])
                s, e = self.starts[at:to] - begin, self.ends[at:to] - begin
                out[at:to] = (sums[e] - sums[s]) * inverse[s]
            at = to
        return mix(out)

    def _long(self, begin: int, end: int, table: np.ndarray, powers: np.ndarray) -> int:
        total, shift, base = 0, 1, int(powers[1])
        for lo in range(begin, end, SEGMENT):
            part = table[self.buf[lo:min(end, lo + SEGMENT)]]
            total += shift * int((part * powers[:len(part)]).sum(dtype=U))
            shift = shift * pow(base, len(part), 2**64) % 2**64
        return total % 2**64


def find_words(buf: np.ndarray, offsets: np.ndarray) -> Words:
    """Words of rows that lie end to end in ``buf``; a word never crosses a row."""
    word = ~SPACE[buf]
    n = len(buf)
    starts, ends = np.zeros(n + 1, bool), np.zeros(n + 1, bool)
    starts[:n] = word
    starts[1:n] &= ~word[:-1] if n else False
    ends[1:] = word
    ends[1:n] &= ~word[1:] if n else False
    inner = offsets[(offsets > 0) & (offsets < n)]
    starts[inner] = word[inner]
    ends[inner] = word[inner - 1]
    start_at = np.flatnonzero(starts[:n])
    return Words(buf, start_at, np.flatnonzero(ends), np.searchsorted(start_at, offsets))


def grams(hashes: np.ndarray, size: int, seed: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    """Hash of every ``size`` consecutive word hashes (``len - size + 1`` of them), by doubling."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, U)
    base = seed | 1
    out, done, part, width = None, 0, hashes, 1
    while True:
        if size & width:
            # out covers ``done`` words already; append this part behind them
            out = part if out is None else out[:len(out) - width] * U(pow(base, width, 2**64)) + part[done:done + len(out) - width]
            done += width
        if done == size:
            return mix(out[:n])
        part = part[:len(part) - width] * U(pow(base, width, 2**64)) + part[width:]
        width *= 2


def sliding_min(values: np.ndarray, size: int) -> np.ndarray:
    """The least of every ``size`` consecutive values."""
    n = len(values) - size + 1
    if n <= 0:
        return values[:0]
    width = 1
    while width * 2 <= size:
        values = np.minimum(values[:len(values) - width], values[width:])
        width *= 2
    rest = size - width
    return np.minimum(values[:n], values[rest:rest + n]) if rest else values[:n]


def whole(first: np.ndarray, total: int, size: int) -> np.ndarray:
    """Which of the ``total - size + 1`` word windows lie within one row."""
    n = total - size + 1
    if n <= 0:
        return np.zeros(0, bool)
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    return row[:n] == row[size - 1:]
