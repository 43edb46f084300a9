"""NumPy helpers on the packed bytes of a batch of texts."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from framelark.llm.lean import at_task_end

#: Odd multiplier of the rolling hash and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
BASE_INV = pow(BASE, -1, 1 << 64)
STEP = 1 << 16


def text_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """``(bytes, offsets)`` of an Arrow string or binary column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, off, data = column.buffers()
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(off, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (a fixed bijection)."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


_POWERS: dict[int, np.ndarray] = {}
at_task_end(_POWERS.clear)


def powers(n: int, base: int = BASE) -> np.ndarray:
    """``base ** i`` modulo 2**64 for ``i < n``."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        size = 1 << max(12, int(n).bit_length())
        steps = np.full(size, base, np.uint64)
        steps[0] = 1
        have = _POWERS[base] = np.multiply.accumulate(steps)
    return have[:n]


def prefix_hash(values: np.ndarray) -> np.ndarray:
    """Sums of ``(v + 1) * BASE**i`` before each position; see :func:`range_hash`."""
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum((values.astype(np.uint64) + np.uint64(1)) * powers(len(values)), out=out[1:])
    return out


def range_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of each range; equal values hash alike wherever they stand."""
    h = (prefix[end] - prefix[start]) * powers(len(prefix), BASE_INV)[start]
    return mix(h + (end - start).astype(np.uint64) * np.uint64(0xA24BAED4963EE407))


def ragged(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The indices ``start .. start + length`` of all ranges, one after another."""
    total = int(length.sum())
    if total == 0:
        return np.zeros(0, np.int64)
    ends = np.cumsum(length)
    return np.arange(total) + np.repeat(start - (ends - length), length)


def pieces(offsets: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Cut rows ``0 .. n`` into runs of about ``most`` bytes; a longer row stands alone."""
    out, first, n = [], 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1
        last = min(n, max(last, first + 1))
        out.append((first, last))
        first = last
    return out


def slices(batch: pa.RecordBatch, column: int, most: int = 1 << 20):
    """Parts of a batch that hold about ``most`` bytes of a text column each, so that work on them stays small."""
    _, off = text_bytes(batch.column(column))
    for first, last in pieces(off, most):
        yield batch.slice(first, last - first)
