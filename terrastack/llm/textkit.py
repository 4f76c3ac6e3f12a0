"""Arrow string columns as numpy byte buffers: word bounds, word hashes, n-gram hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BASE = np.uint64(0x9E3779B97F4A7C15)
#: Inverse of BASE modulo 2**64.
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
MIX = np.uint64(0xBF58476D1CE4E5B9)
#: A second base with its inverse, for hashes that are independent of the first.
OTHER = np.uint64(0xD1342543DE82EF95)
OTHER_INVERSE = np.uint64(pow(0xD1342543DE82EF95, -1, 1 << 64))

#: 1 where a byte is ASCII white space as the contracts define it: 0x20 and 0x09 to 0x0D.
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: ASCII lower-casing of single bytes; bytes of longer UTF-8 sequences stay.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

_powers: dict[str, np.ndarray] = {}


def powers(n: int, other: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i below n, or those of the second base."""
    names, bases = (("other up", "other down"), (OTHER, OTHER_INVERSE)) if other else (("up", "down"), (BASE, INVERSE))
    if len(_powers.get(names[0], ())) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        for name, base in zip(names, bases):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            _powers[name] = np.multiply.accumulate(steps)
    return _powers[names[0]][:n], _powers[names[1]][:n]


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread polynomial hashes over all 64 bits."""
    h = h ^ (h >> np.uint64(31))
    h = h * MIX
    return h ^ (h >> np.uint64(29))


#: Random weight of each byte, for the second hash: it isn't a function of the first even where bytes differ regularly.
WEIGHT = mixed(mixed((np.arange(256, dtype=np.uint64) + np.uint64(1)) * BASE) * OTHER)


def buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and n + 1 offsets of a string column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "" if not pa.types.is_binary(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if offsets is None or len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, off - off[0]


def runs_of_rows(offsets: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most ``most`` bytes together, or of a single longer row."""
    n, start = len(offsets) - 1, 0
    while start < n:
        end = int(np.searchsorted(offsets, offsets[start] + most, side="right")) - 1
        end = min(max(end, start + 1), n)
        yield start, end
        start = end


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words, and the row of each; words don't cross rows."""
    n = len(data)
    if n == 0:
        empty = np.zeros(0, np.int64)
        return empty, empty, empty
    solid = ~SPACE[data]
    first = np.zeros(n + 1, bool)
    inner = offsets[(offsets > 0) & (offsets < n)]
    first[inner] = True
    before = np.concatenate(([False], solid[:-1]))
    starts = np.flatnonzero(solid & (~before | first[:n]))
    after = np.concatenate((solid[1:], [False]))
    ends = np.flatnonzero(solid & (~after | first[1:])) + 1
    row = np.searchsorted(offsets, starts, side="right") - 1
    return starts, ends, row


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word of ``data``, about 1 MB of text at a time (a longer word as a whole)."""
    out = np.zeros(len(starts), np.uint64)
    for a, b in runs_of_rows(np.append(starts, ends[-1:]), 1 << 20):
        low, high = int(starts[a]), int(ends[b - 1])
        up, down = powers(high - low + 1)
        total = np.zeros(high - low + 1, np.uint64)
        np.cumsum((data[low:high].astype(np.uint64) + np.uint64(1)) * up[: high - low], out=total[1:])
        out[a:b] = mixed((total[ends[a:b] - low] - total[starts[a:b] - low]) * down[starts[a:b] - low])
    return out


def ngrams(hashes: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of n consecutive words within a row, and the index of each first word."""
    count = len(hashes) - n + 1
    if count <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = np.zeros(count, np.uint64)
    for i in range(n):
        h = mixed(h * BASE + hashes[i : i + count])
    at = np.flatnonzero(row[:count] == row[n - 1 :])
    return h[at], at
