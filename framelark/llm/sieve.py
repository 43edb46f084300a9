"""A lossless sieve: which 64-bit fingerprints occur in two documents or more, and in how many.

Blocks of documents send their distinct fingerprints as sorted, delta-coded
runs with counts, one row per block and bucket; each bucket answers with one
code per fingerprint: 0 for one document, else eight times the binary logarithm
of their number (a block counts 255 documents at most, so codes of very
frequent ones are low; the order they give stays the same for all). Fingerprints
are cut to 32 bits inside a bucket, so a few pass by chance; callers verify.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, functions as F

from framelark.llm.lean import lean_table

RUNS = "bucket bigint, block bigint, data binary"
BITS = "block bigint, bucket bigint, data binary"


def squeeze(raw: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(raw)


def unsqueeze(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def pack_ints(values: np.ndarray) -> bytes:
    """Integers as compressed byte planes (cheap for small or slowly growing values)."""
    width = values.dtype.itemsize
    head = np.array([len(values), width], np.int64).tobytes()
    return squeeze(head + values.view(np.uint8).reshape(-1, width).T.tobytes())


def unpack_ints(data: bytes, dtype) -> np.ndarray:
    raw = unsqueeze(data)
    n, width = np.frombuffer(raw[:16], np.int64)
    return np.frombuffer(raw[16:], np.uint8).reshape(width, n).T.copy().view(dtype).reshape(-1)


def block_count(docs: DataFrame, text: Column, block_bytes: int) -> int:
    """How many blocks of about ``block_bytes`` the texts fill (one pass over their lengths)."""
    total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    return max(1, -(-int(total) // block_bytes))


def sorted_keys(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """``bucket << 32 | fingerprint`` of mixed hashes."""
    low = hashes & np.uint64(0xFFFFFFFF)
    return ((hashes >> np.uint64(32)) % np.uint64(buckets)) << np.uint64(32) | low


def distinct_keys(keys: np.ndarray, owners: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(distinct sorted keys, owners up to 255, index of each input)``; owners must not fall along the input."""
    if not len(keys):
        return keys, np.zeros(0, np.uint8), np.zeros(0, np.int64)
    order = np.argsort(keys, kind="stable")
    ks, os_ = keys[order], owners[order]
    new = np.r_[True, ks[1:] != ks[:-1]]
    first = np.flatnonzero(new)
    owner = new.copy()
    owner[1:] |= os_[1:] != os_[:-1]
    several = np.minimum(np.add.reduceat(owner, first, dtype=np.int64), 255).astype(np.uint8)
    index = np.empty(len(keys), np.int64)
    index[order] = np.cumsum(new) - 1
    return ks[first], several, index


def bucket_bounds(keys: np.ndarray, buckets: int) -> np.ndarray:
    return np.searchsorted(keys, np.arange(buckets + 1, dtype=np.uint64) << np.uint64(32))


def run_rows(block: int, keys: np.ndarray, several: np.ndarray, buckets: int) -> pa.Table:
    bounds = bucket_bounds(keys, buckets)
    out_bucket, out_data = [], []
    for b in range(buckets):
        lo, hi = bounds[b], bounds[b + 1]
        if lo == hi:
            continue
        fps = (keys[lo:hi] & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        data = pack_ints(np.diff(fps, prepend=np.uint32(0)))
        out_bucket.append(b)
        out_data.append(len(data).to_bytes(8, "little") + data + pack_ints(several[lo:hi]))
    return pa.table(
        {
            "bucket": pa.array(out_bucket, pa.int64()),
            "block": pa.array([block] * len(out_bucket), pa.int64()),
            "data": pa.array(out_data, pa.binary()),
        }
    )


def _judge(table: pa.Table) -> pa.Table:
    """One bucket: add up the documents of each fingerprint."""
    fps, owners, sizes = [], [], []
    for data in table.column("data").to_pylist():
        n = int.from_bytes(data[:8], "little")
        fps.append(np.cumsum(unpack_ints(data[8 : 8 + n], np.uint32), dtype=np.uint32))
        owners.append(unpack_ints(data[8 + n :], np.uint8))
        sizes.append(len(fps[-1]))
    every = np.concatenate(fps)
    order = np.argsort(every, kind="stable")
    s = every[order]
    new = np.ones(len(s), bool)
    new[1:] = s[1:] != s[:-1]
    total = np.add.reduceat(np.concatenate(owners)[order], np.flatnonzero(new), dtype=np.int64)
    code = np.minimum(np.log2(total) * 8, 255).astype(np.uint8)
    codes = np.empty(len(s), np.uint8)
    codes[order] = code[np.cumsum(new) - 1]
    packed = [pack_ints(x) for x in np.split(codes, np.cumsum(sizes)[:-1])]
    return pa.table(
        {"block": table.column("block"), "bucket": table.column("bucket"), "data": pa.array(packed, pa.binary())}
    )


def judge(runs: DataFrame) -> DataFrame:
    return runs.groupBy("bucket").applyInArrow(lean_table(_judge), BITS)


def codes_of(keys: np.ndarray, buckets: int, answers: pa.Table) -> np.ndarray:
    """For each distinct key of a block, the code that its bucket gave it."""
    bounds = bucket_bounds(keys, buckets)
    out = np.zeros(len(keys), np.uint8)
    for b, data in zip(answers.column("bucket").to_pylist(), answers.column("data").to_pylist()):
        out[bounds[b] : bounds[b + 1]] = unpack_ints(data, np.uint8)
    return out
