"""Words and shingles of Arrow text columns as numpy arrays, for operators that run in Arrow batches.

A column is read through its offsets and bytes, so no Python string is made. Work goes in blocks of
about ``BLOCK`` bytes (a single text may be longer), which bounds memory at any batch size.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

BLOCK = 1 << 20
SPACE = b" \t\n\x0b\x0c\r"

_BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def byte_table(members: bytes) -> np.ndarray:
    """Boolean table of 256 bytes: whether each is one of ``members``."""
    table = np.zeros(256, bool)
    table[np.frombuffer(members, np.uint8)] = True
    return table


IS_SPACE = byte_table(SPACE)
#: Bytes that end a word when punctuation doesn't count: all but letters, digits and bytes from 128.
IS_BREAK = ~(byte_table(b"0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")
             | (np.arange(256) >= 128))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(h: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit values (the splitmix64 finalizer)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _power_table(base: int, size: int) -> np.ndarray:
    table = _powers.get(base)
    if table is None or len(table) < size:
        steps = np.full(max(size, BLOCK), base, np.uint64)
        steps[0] = 1
        table = _powers[base] = np.cumprod(steps, dtype=np.uint64)
    return table


@dataclass
class Words:
    """Words of a block of texts: byte spans, and where the words of each text begin."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes."""
        out = np.empty(len(self.starts), np.uint64)
        at = 0
        while at < len(out):
            origin = int(self.starts[at])
            to = max(at + 1, int(np.searchsorted(self.ends, origin + BLOCK, "right")))
            span = self.data[origin:int(self.ends[to - 1])]
            powers = _power_table(_BASE, len(span) + 1)
            total = np.zeros(len(span) + 1, np.uint64)
            np.cumsum((span.astype(np.uint64) + np.uint64(1)) * powers[:len(span)], out=total[1:])
            s, e = self.starts[at:to] - origin, self.ends[at:to] - origin
            inverse = _power_table(_INVERSE, len(span) + 1)
            # The length keeps words apart from their extensions by bytes that add nothing.
            out[at:to] = mix((total[e] - total[s]) * inverse[s] + (e - s).astype(np.uint64))
            at = to
        return out


def find_words(data: np.ndarray, offsets: np.ndarray, breaks: np.ndarray = IS_SPACE) -> Words:
    """Maximal runs of bytes outside ``breaks`` within each text ``data[offsets[i]:offsets[i+1]]``."""
    inside = ~breaks[data]
    edge = np.diff(inside.astype(np.int8), prepend=np.int8(0), append=np.int8(0))
    start, end = edge == 1, edge == -1
    # A text's border splits a run that goes over it.
    border = offsets[1:-1]
    border = border[(border > 0) & (border < len(data))]
    cut = border[inside[border] & inside[border - 1]]
    start[cut] = True
    end[cut] = True
    starts, ends = np.flatnonzero(start), np.flatnonzero(end)
    return Words(data, starts, ends, np.searchsorted(starts, offsets))


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null is an empty text."""
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    _, offsets, data = column.buffers()
    if len(column) == 0 or offsets is None:
        return np.empty(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, np.int64, len(column) + 1 + column.offset)[column.offset:]
    size = int(at[-1])
    body = np.frombuffer(data, np.uint8, size) if data is not None and size else np.empty(0, np.uint8)
    return body[int(at[0]):], at - at[0]


def blocks(column: pa.Array, limit: int = BLOCK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows with about ``limit`` bytes in all."""
    data, offsets = column_bytes(column)
    row, rows = 0, len(offsets) - 1
    while row < rows:
        to = int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1
        to = min(rows, max(row + 1, to))
        yield row, to, data[offsets[row]:offsets[to]], offsets[row:to + 1] - offsets[row]
        row = to


_STEP = [np.uint64(pow(_BASE, 2 * i + 1, 1 << 64) | 1) for i in range(16)]


def shingles(words: Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text) of every window of ``width`` words, in order.

    A text of fewer words has one window, the whole sequence; a text without words has none.
    """
    h, first, counts = words.hashes(), words.first, words.counts
    short = np.minimum(counts, width)
    windows = np.where(counts > 0, counts - short + 1, 0)
    text = np.repeat(np.arange(len(counts)), windows)
    begin = np.cumsum(windows) - windows
    at = np.arange(len(text)) - begin[text] + first[:-1][text]
    length = short[text]
    total = length.astype(np.uint64)
    for i in range(width):
        use = length > i
        if use.all():
            total = total + h[at + i] * _STEP[i]
        else:
            total[use] += h[at[use] + i] * _STEP[i]
    return mix(total), text


def unique_per_text(values: np.ndarray, text: np.ndarray, texts: int) -> Iterator[np.ndarray]:
    """The sorted distinct values of each text, also of texts without any."""
    bounds = np.searchsorted(text, np.arange(texts + 1))
    for i in range(texts):
        yield np.unique(values[bounds[i]:bounds[i + 1]])
