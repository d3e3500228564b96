"""Vectorised tokens, hashes and n-grams of Arrow text columns: no Python object is made for a word."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Odd multipliers of the rolling polynomials; any odd numbers of full width serve.
MULTIPLIERS = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93))
CHUNK = 1 << 20  #: bytes hashed at a time


def mixed(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: every bit of the result depends on every bit of ``x``."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: A random number for each byte.
BYTE = mixed(np.arange(1, 257, dtype=np.uint64) * MULTIPLIERS[0])

#: Classes of bytes: 0 separates tokens, and a token is a run of one other class.
BY_SPACE = np.ones(256, np.uint8)
BY_SPACE[[0x20, *range(0x09, 0x0E)]] = 0
#: 1: letters, digits, underscore and whatever is not ASCII.
WORDS_ONLY = np.array([c >= 128 or chr(c).isalnum() or c == 0x5F for c in range(256)], np.uint8)
#: 2: other visible characters.
WORDS_AND_MARKS = np.where(WORDS_ONLY == 1, 1, np.where(np.arange(256) > 32, 2, 0)).astype(np.uint8)


@dataclass
class Tokens:
    """Tokens of the texts of a column, one after the other."""

    hashes: np.ndarray  #: 64 bits of each token
    starts: np.ndarray  #: of each token, in bytes of the whole column
    stops: np.ndarray
    ends: np.ndarray  #: for each text, the number of tokens up to its end

    @property
    def lengths(self) -> np.ndarray:
        return np.diff(self.ends, prepend=0)

    def of(self, text: int) -> np.ndarray:
        return self.hashes[self.ends[text - 1] if text else 0 : self.ends[text]]

    def left(self) -> np.ndarray:
        """For each token, the number of tokens from it to the end of its text."""
        return np.repeat(self.ends, self.lengths) - np.arange(len(self.hashes))


_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of a multiplier and of its inverse modulo 2 ** 64."""
    size = max(CHUNK, 1 << (n - 1).bit_length())
    if size not in _powers:
        p = int(MULTIPLIERS[1])
        inverse = np.uint64(pow(p, -1, 1 << 64))
        _powers.clear()
        _powers[size] = tuple(np.cumprod(np.append(np.uint64(1), np.full(size - 1, m, np.uint64)), dtype=np.uint64) for m in (MULTIPLIERS[1], inverse))
    return _powers[size]


def tokenize(column: pa.Array, classes: np.ndarray = BY_SPACE, lower: bool = False) -> Tokens:
    """Null texts have no tokens."""
    column = pc.fill_null(column, "")
    if lower:
        column = pc.utf8_lower(column)
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    offsets = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]] if len(column) else np.empty(0, np.uint8)
    offsets = offsets - offsets[0] if len(column) else np.zeros(1, np.int64)
    kinds = classes[data]
    cut = np.ones(len(data) + 1, bool)
    cut[1:-1] = kinds[1:] != kinds[:-1]
    cut[offsets] = True
    at = np.flatnonzero(cut)
    starts, stops = at[:-1], at[1:]
    keep = kinds[starts] != 0
    starts, stops = starts[keep], stops[keep]
    hashes = np.empty(len(starts), np.uint64)
    a = 0
    while a < len(starts):
        base = starts[a]
        b = max(a + 1, int(np.searchsorted(stops, base + CHUNK, "right")))
        span = data[base : stops[b - 1]]
        power, inverse = _power_tables(len(span) + 1)
        total = np.zeros(len(span) + 1, np.uint64)
        np.cumsum(BYTE[span] * power[: len(span)], out=total[1:])
        hashes[a:b] = (total[stops[a:b] - base] - total[starts[a:b] - base]) * inverse[starts[a:b] - base]
        a = b
    return Tokens(mixed(hashes), starts, stops, np.searchsorted(starts, offsets[1:], "left"))


def hash_words(words: list[str], classes: np.ndarray = BY_SPACE) -> np.ndarray:
    """Hashes of single tokens, as ``tokenize`` gives them."""
    t = tokenize(pa.array(words, pa.string()), classes)
    if len(t.hashes) != len(words):
        raise ValueError("not single tokens")
    return t.hashes


def windows(hashes: np.ndarray, k: int, multiplier: np.uint64 = MULTIPLIERS[0]) -> np.ndarray:
    """A hash of each run of ``k`` consecutive entries; entry i stands for the run that starts at i."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = hashes[:n].copy()
    for j in range(1, k):
        out *= multiplier
        out += hashes[j : n + j]
    return mixed(out)


def pieces(batches: Iterable[pa.RecordBatch], text: str = "text", size: int = 1_000_000) -> Iterator[pa.RecordBatch]:
    """Batches cut to about ``size`` bytes of text, and never less than a row."""
    for batch in batches:
        ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column(text)), 0), np.int64))
        at = 0
        while at < batch.num_rows:
            base = ends[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(ends, base + size, "right")))
            yield batch.slice(at, end - at)
            at = end
