"""Vectorised word kernels over Arrow text columns.

Words are maximal runs of bytes outside ``[\\x20\\x09-\\x0D]``.  All kernels work
on UTF-8 bytes in bounded slices, so one batch or one very long text never needs
more than a few tens of megabytes beside itself.  Null texts count as empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20
#: Bytes hashed at a time, few enough for a core's cache.
HASH_BYTES = 1 << 15
U64 = np.uint64
_P, _P_INVERSE = U64(0x9E3779B97F4A7C15), U64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_GOLD = U64(0x9E3779B97F4A7C15)
_BYTE_CODES = np.random.Generator(np.random.PCG64(20260101)).integers(0, 1 << 64, 256, dtype=np.uint64)

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Blanks, signs and other ASCII that is neither letter nor digit.
SIGNS = np.array([c < 128 and not chr(c).isalnum() for c in range(256)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def translated(data: np.ndarray, table: np.ndarray) -> np.ndarray:
    """table[data] for a table of 256 single bytes, several times as fast."""
    return np.frombuffer(data.tobytes().translate(table.tobytes()), table.dtype)


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser, element-wise."""
    x = np.atleast_1d(np.asarray(x, U64))
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def text_slices(column: pa.Array | pa.ChunkedArray, max_bytes: int = SLICE_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Yield (first row, uint8 data, int64 row starts with a last end) of whole rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if not len(column):
        return
    ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(column):
        last = int(np.searchsorted(ends, ends[first] + max_bytes, "right")) - 1
        last = min(max(last, first + 1), len(column))
        yield first, data[ends[first] : ends[last]], (ends[first : last + 1] - ends[first]).astype(np.int64)
        first = last


def word_bounds(data: np.ndarray, starts: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each word; rows never share a word."""
    n = len(data)
    if not n:
        return (np.zeros(0, np.int64),) * 3
    blank = translated(data, space)
    opens, closes = np.empty(n, bool), np.empty(n, bool)
    opens[0], opens[1:] = True, blank[:-1]
    closes[-1], closes[:-1] = True, blank[1:]
    inner = starts[(starts > 0) & (starts < n)]
    opens[inner], closes[inner - 1] = True, True
    begin, end = np.flatnonzero(opens & ~blank), np.flatnonzero(closes & ~blank) + 1
    return begin, end, np.repeat(np.arange(len(starts) - 1), np.diff(np.searchsorted(begin, starts)))


_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n:
        up, down = np.full(n, _P, U64), np.full(n, _P_INVERSE, U64)
        up[0] = down[0] = U64(1)
        up, down = np.cumprod(up, dtype=U64), np.cumprod(down, dtype=U64)
        if n > 4 * SLICE_BYTES:  # one giant word: not worth keeping
            return up, down
        _POWERS.update(up=up, down=down)
    return _POWERS["up"], _POWERS["down"]


def word_hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes, alike in every process."""
    out, k = np.empty(len(begin), U64), 0
    while k < len(begin):
        stop = max(k + 1, int(np.searchsorted(end, begin[k] + HASH_BYTES, "right")))
        low, high = begin[k], end[stop - 1]
        up, down = _powers(int(high - low))
        sums = np.zeros(high - low + 1, U64)
        np.cumsum(_BYTE_CODES.take(data[low:high]) * up[: high - low], out=sums[1:])
        b, e = begin[k:stop] - low, end[k:stop] - low
        out[k:stop] = mix((sums[e] - sums[b]) * down[b] + (e - b).astype(U64) * _GOLD)
        k = stop
    return out


def shingles(words: np.ndarray, rows: np.ndarray, n_rows: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes by row: (sorted hashes of all rows, row offsets).

    A row with fewer than ``width`` words has its whole word sequence as its only
    shingle; a row without words has none.
    """
    factor = mix(np.arange(1000, 1000 + width, dtype=U64)) | U64(1)
    counts = np.bincount(rows, minlength=n_rows)
    first = np.concatenate([[0], np.cumsum(counts)])
    n = len(words) - width + 1
    if n > 0:
        codes = words[:n] * factor[0]
        for j in range(1, width):
            codes = codes + words[j : j + n] * factor[j]
        whole = rows[:n] == rows[width - 1 :]
        codes, at = mix(codes[whole]), rows[:n][whole]
    else:
        codes, at = np.zeros(0, U64), np.zeros(0, np.int64)
    made = np.bincount(at, minlength=n_rows)
    edge = np.concatenate([[0], np.cumsum(made)])
    parts, sizes = [], np.zeros(n_rows, np.int64)
    for r in range(n_rows):
        if made[r]:
            own = np.unique(codes[edge[r] : edge[r + 1]])
        elif counts[r]:
            short = words[first[r] : first[r + 1]]
            own = mix(np.array([np.sum(short * factor[: len(short)], dtype=U64) + U64(len(short))]))
        else:
            continue
        parts.append(own)
        sizes[r] = len(own)
    return (np.concatenate(parts) if parts else np.zeros(0, U64)), np.concatenate([[0], np.cumsum(sizes)])
