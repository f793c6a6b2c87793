"""NumPy kernels over Arrow text columns: words, rolling hashes, sliding minima.

Texts stay in Arrow's byte buffers. All work goes in chunks of at most CHUNK bytes (a longer text is a chunk of its
own), so a worker's memory follows the longest text and not the batch.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK = 1 << 20
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BYTE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_R, _Q = 0x9E3779B97F4A7C15 | 1, 0xC2B2AE3D27D4EB4F | 1
_LEFT = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)  # the first bytes of eight
_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** i modulo 2 ** 64 for i < n; base is odd, so every power has an inverse."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        out = np.full(size, base, np.uint64)
        out[0] = 1
        _POWERS[base] = have = np.multiply.accumulate(out)
    return have[:n]


def inverse(base: int) -> int:
    return pow(base, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a string column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.type not in (pa.string(), pa.large_string()):
        column = column.cast(pa.string())
    column = pc.fill_null(column, "")
    kind = np.int64 if column.type == pa.large_string() else np.int32
    if not len(column):
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return off, raw


def chunks(off: np.ndarray, size: int = 0):
    """Ranges of rows with at most size bytes together, at least one row each."""
    size, n, i = size or CHUNK, len(off) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + size, "right")) - 1)
        yield i, j
        i = j


def words(raw: np.ndarray, off: np.ndarray, space: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, by default [^\\x20\\x09-\\x0D]+, and the rows' offsets into them; off begins at 0."""
    n = len(raw)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    solid = ~space[raw]
    cut = np.zeros(n + 1, bool)
    cut[off] = True
    first = solid.copy()
    first[1:] &= ~solid[:-1] | cut[1:-1]
    last = solid.copy()
    last[:-1] &= ~solid[1:] | cut[1:-1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, off)


def prefix(values: np.ndarray, base: int) -> np.ndarray:
    """Prefix sums of values[i] * base ** i, modulo 2 ** 64."""
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(base, len(values)), out=out[1:])
    return out


def spans(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """Hashes of [start, end) by the prefix sums, alike wherever the span stands."""
    h = (sums[ends] - sums[starts]) * powers(inverse(base), len(sums))[starts]
    return mix(h ^ ((ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))


def _pieces(count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where each run of count pieces begins, and of each piece its run and its place there."""
    first = np.cumsum(count) - count
    run = np.repeat(np.arange(len(count)), count)
    return first, run, np.arange(len(run)) - first[run]


def _added(pieces: np.ndarray, place: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Hash of each run: its pieces are mixed with their places before they add up, so no sum of products of one base can vanish."""
    mixed = mix(mix(pieces) + (place + 1).astype(np.uint64) * np.uint64(_R))
    return mix(np.add.reduceat(mixed, first) ^ (size.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the bytes [start, end), none empty, by pieces of 8 bytes."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    padded = np.concatenate([raw, np.zeros(8, np.uint8)])
    eight = np.ndarray(len(raw) + 1, np.dtype("<u8"), padded, strides=(1,))
    first, run, place = _pieces((ends - starts + 7) >> 3)
    at = starts[run] + 8 * place
    return _added(eight[at] & _LEFT[np.minimum(ends[run] - at, 8)], place, first, ends - starts)


def run_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of values[start:end], none empty."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    first, run, place = _pieces(ends - starts)
    return _added(values[starts[run] + place], place, first, ends - starts)


def grams(hashes: np.ndarray, k: int, base: int = _Q, sums: np.ndarray | None = None) -> np.ndarray:
    """Hash of each run of k values; row bounds are the caller's."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    sums = prefix(hashes, base) if sums is None else sums
    h = (sums[k:] - sums[:n]) * powers(inverse(base), n)
    return mix(h ^ np.uint64(k * 0xD6E8FEB86659FD93 % 2**64))


_LOW = np.uint64((1 << 28) - 1)


def sliding_argmin(values: np.ndarray, w: int) -> np.ndarray:
    """Place of the smallest of values[i:i+w] by the upper 36 bits, the rightmost of equals."""
    n, have = len(values), 1
    if n < w:
        return np.zeros(0, np.int64)
    v = (values & ~_LOW) | (_LOW - (np.arange(n, dtype=np.uint64) & _LOW))
    while have < w:
        step = min(have, w - have)
        v = np.minimum(v[step:], v[: len(v) - step])
        have += step
    at = np.arange(len(v))
    return at + ((_LOW - (v & _LOW)).astype(np.int64) - at) % (1 << 28)


def covered(n: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Mask of the n places that some [start, end) covers."""
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, starts, 1)
    np.add.at(step, ends, -1)
    return np.cumsum(step[:-1]) > 0


P61 = (1 << 61) - 1
_P61, _M31, _M30 = np.uint64(P61), np.uint64((1 << 31) - 1), np.uint64((1 << 30) - 1)
_POWERS61: dict[int, np.ndarray] = {}


def fold61(x: np.ndarray) -> np.ndarray:
    """x modulo the prime 2 ** 61 - 1."""
    x = (x & _P61) + (x >> np.uint64(61))
    return np.where(x >= _P61, x - _P61, x)


def add61(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return fold61(a + b)


def sub61(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return fold61(a + (_P61 - b))


def mul61(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products modulo 2 ** 61 - 1 in halves of 30 and 31 bits, so that no sum passes 64 bits."""
    ah, al, bh, bl = a >> np.uint64(31), a & _M31, b >> np.uint64(31), b & _M31
    mid = al * bh + ah * bl
    return fold61(((ah * bh) << np.uint64(1)) + (mid >> np.uint64(30)) + ((mid & _M30) << np.uint64(31)) + al * bl)


def cumsum61(x: np.ndarray) -> np.ndarray:
    """Sums of the first 0 to len(x) values modulo 2 ** 61 - 1; upper and lower halves add up apart, for up to 2 ** 31 values."""
    low, high = np.zeros(len(x) + 1, np.uint64), np.zeros(len(x) + 1, np.uint64)
    np.cumsum(x & np.uint64(0xFFFFFFFF), out=low[1:])
    np.cumsum(x >> np.uint64(32), out=high[1:])
    high = fold61(high)
    return add61(fold61(low), ((high << np.uint64(32)) & _P61) | (high >> np.uint64(29)))


def powers61(base: int, n: int) -> np.ndarray:
    """base ** i modulo 2 ** 61 - 1 for i < n."""
    have = _POWERS61.get(base, np.ones(1, np.uint64))
    while len(have) < n:
        have = np.concatenate([have, mul61(have, np.uint64(pow(base, len(have), P61)))])
    _POWERS61[base] = have
    return have[:n]
