"""BPE encoding and decoding: a queue of merge ranks over a linked list of symbols."""

from __future__ import annotations

import hashlib
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from framelark.llm.lean import at_task_end, lean_map

from framelark.llm.packed import pieces, ragged, slices
from framelark.llm.word_split import WordCoder, ids_list, read_vocabulary

_SHIFT = 32
_MASK = (1 << _SHIFT) - 1
_LOADED: dict[str, "BytePairs"] = {}


@at_task_end
def _shrink() -> None:
    """Words are dear to encode here, so a worker keeps them for its next task while they are few."""
    for pairs in _LOADED.values():
        pairs.coder.shrink()



class BytePairs:
    """A byte-level BPE vocabulary: encode by merge ranks, decode by concatenation."""

    def __init__(self, path: str):
        tokens, merges, special = read_vocabulary(path)
        self.first = [tokens[bytes([b])] for b in range(256)]
        self.size = max([*tokens.values(), *special.values()]) + 1
        #: left id * size + right id -> rank << 32 | new id.
        self.merge: dict[int, int] = {}
        for rank, (left, right) in enumerate(merges):
            self.merge.setdefault(tokens[left] * self.size + tokens[right], rank << _SHIFT | tokens[left + right])
        strings = [b""] * self.size
        for t, i in tokens.items():
            strings[i] = t
        for t, i in special.items():
            strings[i] = t.encode()
        self.length = np.array([len(s) for s in strings], np.int64)
        self.begin = np.cumsum(self.length) - self.length
        self.bytes = np.frombuffer(b"".join(strings), np.uint8)
        self.coder = WordCoder(self.encode_word, special)

    def encode_word(self, word: str) -> list[int]:
        """Merge the pair of lowest rank, leftmost first, until no pair has a rank.

        The queue holds ``rank << 32 | position`` of a pair's left symbol. Symbols are a
        doubly linked list; a merge gives its right symbol up and queues the two new
        pairs. An entry whose position no longer starts a pair of that rank is stale.
        """
        first, get, size = self.first, self.merge.get, self.size
        symbol = [first[b] for b in word.encode()]
        n = len(symbol)
        queue = []
        for i in range(n - 1):
            found = get(symbol[i] * size + symbol[i + 1])
            if found is not None:
                queue.append(found - (found & _MASK) | i)
        if not queue:
            return symbol
        heapify(queue)
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        while queue:
            entry = heappop(queue)
            i = entry & _MASK
            left, j = symbol[i], after[i]
            if left < 0 or j >= n:
                continue
            found = get(left * size + symbol[j])
            if found is None or (found ^ entry) > _MASK:
                continue
            new = symbol[i] = found & _MASK
            symbol[j] = -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                found = get(new * size + symbol[k])
                if found is not None:
                    heappush(queue, found - (found & _MASK) | i)
            h = before[i]
            if h >= 0:
                found = get(symbol[h] * size + new)
                if found is not None:
                    heappush(queue, found - (found & _MASK) | h)
        return [s for s in symbol if s >= 0]

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``(bytes, offsets)`` of the vocabulary strings of each list, one after another."""
        length = self.length[ids]
        upto = np.r_[0, np.cumsum(length)]
        return self.bytes[ragged(self.begin[ids], length)], upto[offsets]


def load(path: str) -> BytePairs:
    if path not in _LOADED:
        _LOADED[path] = BytePairs(path)
    return _LOADED[path]


def bpe_encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id and ``ids`` (array<int>), whole texts, special strings recognised.

    ``path`` is the vocabulary file, readable on every executor. Null and empty text
    give an empty list. Words are encoded once per batch and kept in a bounded
    memory of words; nothing is shuffled. Other columns are not read, ids may repeat or be null.
    """

    def run(batches):
        coder = load(path).coder
        for batch in (part for whole in batches for part in slices(whole, 1)):
            ids, offsets = coder.encode(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids_list(ids, offsets)], names=["_id", "ids"])

    slim = docs.select(F.col(id_col).cast("bigint").alias("_id"), F.col(text_col).cast("string").alias("_text"))
    return slim.mapInArrow(lean_map(run), "_id bigint, ids array<int>").withColumnRenamed("_id", id_col)


def bpe_decode(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """One row per input row: id and ``text``; a null list gives null, broken UTF-8 the replacement sign."""

    def run(batches):
        pairs = load(path)
        for batch in batches:
            lists = batch.column(1)
            offsets = lists.offsets.to_numpy().astype(np.int64)
            ids = lists.values.to_numpy(zero_copy_only=False)
            for first, last in pieces(offsets, 1 << 18):
                own = offsets[first : last + 1]
                raw, ends = pairs.decode(ids[own[0] : own[-1]].astype(np.int64), own - own[0])
                view = raw.tobytes()
                texts = [
                    view[a:b].decode("utf-8", "replace") if ok else None
                    for a, b, ok in zip(ends[:-1], ends[1:], lists[first:last].is_valid().to_pylist())
                ]
                some = batch.column(0)[first:last]
                yield pa.RecordBatch.from_arrays([some, pa.array(texts, pa.string())], names=["_id", "text"])

    slim = encoded.select(F.col(id_col).cast("bigint").alias("_id"), F.col(ids_col).cast("array<int>").alias("_ids"))
    return slim.mapInArrow(lean_map(run), "_id bigint, text string").withColumnRenamed("_id", id_col)


def bpe_round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and decode in one pass: id, ``n_tokens``, ``ids_sha256``, ``decoded_sha256``.

    The digests are of the ids as little-endian unsigned 32-bit integers and of the
    decoded text in UTF-8. Edge cases as in :func:`bpe_encode`.
    """

    def run(batches):
        pairs = load(path)
        for batch in (part for whole in batches for part in slices(whole, 1)):
            ids, offsets = pairs.coder.encode(batch.column(1))
            raw, ends = pairs.decode(ids, offsets)
            code, text = memoryview(ids.astype("<u4")), memoryview(raw)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(np.diff(offsets)),
                    pa.array([hashlib.sha256(code[a:b]).hexdigest() for a, b in zip(offsets[:-1], offsets[1:])], pa.string()),
                    pa.array([_text_digest(text[a:b]) for a, b in zip(ends[:-1], ends[1:])], pa.string()),
                ],
                names=["_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    slim = docs.select(F.col(id_col).cast("bigint").alias("_id"), F.col(text_col).cast("string").alias("_text"))
    schema = "_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    return slim.mapInArrow(lean_map(run), schema).withColumnRenamed("_id", id_col)


def _text_digest(raw: memoryview) -> str:
    return hashlib.sha256(bytes(raw).decode("utf-8", "replace").encode()).hexdigest()
