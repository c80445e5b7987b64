"""Numpy views of Arrow text columns, and hashes of byte ranges, for use inside Spark tasks."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa

#: Bytes of text that a task turns into numpy arrays at once; a longer single text stands alone.
SLICE_BYTES = 1 << 19

_MULT = np.uint64(0x9E3779B97F4A7C15 | 1)
_BYTE_CODES = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64)


@cache
def _trim() -> Callable[[int], int] | None:
    try:
        return ctypes.CDLL("libc.so.6").malloc_trim
    except (OSError, AttributeError):  # another C library
        return None


def give_back() -> None:
    """Let the system have what this worker has freed: workers live on, beside those of other stages."""
    pa.default_memory_pool().release_unused()
    if trim := _trim():
        trim(0)


def slices(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows of at most ``most`` bytes: (first row, end row, bytes, offsets). Null reads as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    n = len(column)
    if not n:
        return
    _, at, data = column.buffers()
    at = np.frombuffer(at, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        end = max(row + 1, int(np.searchsorted(at, at[row] + most, "right")) - 1)
        yield row, end, data[at[row] : at[end]], at[row : end + 1] - at[row]
        row = end
    give_back()


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finaliser (splitmix): every input bit reaches every output bit."""
    x = x + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_powers = np.ones(1, np.uint64)
_inverses = np.ones(1, np.uint64)


def _grow(n: int) -> None:
    global _powers, _inverses
    if len(_powers) < n:
        n = max(n, SLICE_BYTES + 2)
        inverse = np.uint64(pow(int(_MULT), -1, 1 << 64))
        _powers = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, _MULT)]), dtype=np.uint64)
        _inverses = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, inverse)]), dtype=np.uint64)


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Prefix sums of a polynomial hash over bytes or 64-bit symbols, one entry more than those; see ``range_hash``."""
    _grow(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    codes = _BYTE_CODES[data] if data.dtype == np.uint8 else data
    np.cumsum(codes * _powers[: len(data)], out=out[1:], dtype=np.uint64)
    return out


def range_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of ranges, equal for equal contents wherever they lie.

    Good for choosing and grouping only: modulo a power of two some unlike contents of a thousand
    symbols always hash alike. Where equality is decided, ``field_hash`` is used.
    """
    return mix((prefix[end] - prefix[start]) * _inverses[start] + (end - start).astype(np.uint64))


#: Two polynomials over the field of this prime (fixed value), in which unlike contents hash alike by chance only.
_PRIME = np.uint64((1 << 31) - 1)
_BASES = (1_093_187_113, 1_947_326_821)
_field_powers = np.ones((2, 1), np.uint64)
_field_inverses = np.ones((2, 1), np.uint64)


def _fold(x: np.ndarray) -> np.ndarray:
    """``x`` modulo the prime, where ``x`` is under 2^62; the prime itself may stand for 0."""
    x = (x & _PRIME) + (x >> np.uint64(31))
    return (x & _PRIME) + (x >> np.uint64(31))


def _field_row(base: int, n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    filled = 1
    while filled < n:  # powers double in number: base ** (filled + i) = base ** filled * base ** i
        k = min(filled, n - filled)
        out[filled : filled + k] = out[:k] * np.uint64(pow(base, filled, int(_PRIME))) % _PRIME
        filled += k
    return out


def _grow_field(n: int) -> None:
    global _field_powers, _field_inverses
    if _field_powers.shape[1] < n:
        n = max(n, SLICE_BYTES + 2)
        _field_powers = np.stack([_field_row(b, n) for b in _BASES])
        _field_inverses = np.stack([_field_row(pow(b, -1, int(_PRIME)), n) for b in _BASES])


def field_prefix(data: np.ndarray) -> np.ndarray:
    """Prefix sums of two polynomials over bytes or 64-bit symbols, for ``field_hash``."""
    _grow_field(len(data) + 1)
    out = np.zeros((2, len(data) + 1), np.uint64)
    small = data.dtype == np.uint8  # a few million products of bytes can be summed as they are
    parts = [data.astype(np.uint64) + np.uint64(1)] * 2 if small else [data & _PRIME, data >> np.uint64(33)]
    for k, part in enumerate(parts):
        terms = part * _field_powers[k, : len(data)]
        np.cumsum(terms if small and len(data) < 1 << 22 else _fold(terms), out=out[k, 1:], dtype=np.uint64)
    return out


def field_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of ranges, equal for equal contents wherever they lie; unlike contents of n symbols collide with a chance of (n / 2^31)^2."""
    halves = [_fold(_fold(prefix[k][end] - prefix[k][start]) * _field_inverses[k][start]) % _PRIME for k in (0, 1)]
    return mix(mix((halves[0] << np.uint64(31)) | halves[1], 1) + (end - start).astype(np.uint64))


def word_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of words, eight bytes at a time, each mixed into what the ones before it gave."""
    size = ends - starts
    out = size.astype(np.uint64)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    rows, at = np.arange(len(starts)), starts.astype(np.int64)
    step = np.arange(8)
    while len(rows):
        piece = padded[at[:, None] + step]
        piece[step >= (ends[rows] - at)[:, None]] = 0
        out[rows] = mix(out[rows] ^ piece.reshape(-1).view(np.uint64), 11)
        at += 8
        more = at < ends[rows]
        rows, at = rows[more], at[more]
    return out


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True


def blank(data: np.ndarray) -> np.ndarray:
    return _BLANK[data]


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words (runs without blanks), and for each text the index of its first word.

    A word never crosses two texts.
    """
    ink = ~_BLANK[data]
    before = np.zeros(len(data), bool)
    before[1:] = ink[:-1]
    inner = offsets[(offsets > 0) & (offsets < len(data))]
    before[inner] = False
    starts = np.flatnonzero(ink & ~before)
    after = np.zeros(len(data), bool)
    after[:-1] = ink[1:]
    after[inner - 1] = False
    ends = np.flatnonzero(ink & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)
