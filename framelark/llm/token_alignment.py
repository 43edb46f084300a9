"""Cross-tokenizer alignment: groups of the tokens of two tokenizers, by interval coalescing."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from framelark.functions.storage import write_through
from framelark.llm.lean import at_task_end, lean_map
from framelark.llm.packed import ragged, slices, text_bytes
from framelark.llm.word_split import WordCoder, read_vocabulary

_LOADED: dict[tuple[str, str], "TokenizerPair"] = {}
at_task_end(_LOADED.clear)
_SHIFT = np.int64(32)


@dataclass
class Tokens:
    """Tokens of several texts in one row: ids, text number and byte range of each."""

    ids: np.ndarray
    doc: np.ndarray
    start: np.ndarray
    end: np.ndarray


def coalesce_intervals(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(order, group)``: intervals sorted by start, and the number of the group of each in that order.

    A group breaks where a start reaches the running maximum of the ends before it.
    """
    order = np.lexsort((end, start))
    first = np.ones(len(order), bool)
    if len(order):
        first[1:] = start[order][1:] >= np.maximum.accumulate(end[order])[:-1]
    return order, np.cumsum(first) - 1


def overlapping_pairs(a: Tokens, b: Tokens) -> tuple[np.ndarray, np.ndarray]:
    """Positions of every A and B token whose byte ranges overlap; both are sorted and gapless inside a text."""
    low = np.searchsorted(b.end, a.start, "right")
    high = np.searchsorted(b.start, a.end, "left")
    return np.repeat(np.arange(len(a.ids)), high - low), ragged(low, high - low)


class TokenizerPair:
    """A byte-level BPE file (A) and a sentence-piece model (B), and the bytes of their tokens."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece
        import tiktoken

        tokens, _, special = read_vocabulary(path_a)
        words = tiktoken.Encoding("words", pat_str=r"[\s\S]+", mergeable_ranks=tokens, special_tokens={})
        #: Without special tokens: their strings inside texts are plain text.
        self.coder = WordCoder(words.encode_ordinary, {}, most=500_000)
        strings = [b""] * (max([*tokens.values(), *special.values()]) + 1)
        for t, i in tokens.items():
            strings[i] = t
        for t, i in special.items():
            strings[i] = t.encode()
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=path_b)
        size = self.pieces.vocab_size()
        self.bytes = [
            _table(strings),
            _table([b"" if self.pieces.is_control(i) else _piece_bytes(self.pieces, i) for i in range(size)]),
        ]
        #: How ids are stored: two bytes where the vocabulary allows.
        self.kinds = [np.dtype("<u2" if len(length) <= 1 << 16 else "<u4") for _, length, _ in self.bytes]

    def encode_a(self, column) -> tuple[np.ndarray, np.ndarray]:
        ids, off = self.coder.encode(column)
        return ids.astype(np.int64), off

    def encode_b(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        lists = self.pieces.encode(texts, num_threads=1)
        count = np.fromiter(map(len, lists), np.int64, len(lists))
        flat = np.fromiter((i for ids in lists for i in ids), np.int64, int(count.sum()))
        return flat, np.r_[0, np.cumsum(count)]

    def spelled(self, side: int, ids: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``(bytes, offsets per text)`` of the joined tokens of each text."""
        begin, length, data = self.bytes[side]
        upto = np.r_[0, np.cumsum(length[ids])]
        return data[ragged(begin[ids], length[ids])], upto[off]

    def placed(self, side: int, ids: np.ndarray, off: np.ndarray) -> Tokens:
        """The tokens of the texts, at their bytes in the joined bytes of all of them."""
        doc = np.repeat(np.arange(len(off) - 1), np.diff(off))
        end = np.cumsum(self.bytes[side][1][ids])
        return Tokens(ids, doc, end - self.bytes[side][1][ids], end)


def _table(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    length = np.array([len(s) for s in strings], np.int64)
    return np.cumsum(length) - length, length, np.frombuffer(b"".join(strings), np.uint8)


def _piece_bytes(pieces, i: int) -> bytes:
    text = pieces.id_to_piece(i)
    return bytes([int(text[3:5], 16)]) if pieces.is_byte(i) else text.replace("▁", " ").encode()


def tokenizer_pair(path_a: str, path_b: str) -> TokenizerPair:
    if (path_a, path_b) not in _LOADED:
        _LOADED[path_a, path_b] = TokenizerPair(path_a, path_b)
    return _LOADED[path_a, path_b]


def _equal_texts(one, other) -> np.ndarray:
    """Which texts have the same bytes in both ``(bytes, offsets)``."""
    (x, ox), (y, oy) = one, other
    x, y = memoryview(np.ascontiguousarray(x)), memoryview(np.ascontiguousarray(y))
    lines = zip(ox[:-1].tolist(), ox[1:].tolist(), oy[:-1].tolist(), oy[1:].tolist())
    return np.array([x[a:b] == y[c:d] for a, b, c, d in lines], bool)


def encode_batch(pair: TokenizerPair, column) -> list[tuple[np.ndarray, np.ndarray]]:
    """``(ids, offsets)`` of A and of B for a column of texts that begin with a blank (null: no text).

    A text that a tokenizer spells otherwise, and one that is only the blank, has no tokens.
    """
    raw = text_bytes(column)
    # The model adds the blank itself.
    found = [pair.encode_a(column), pair.encode_b([(t or "")[1:] for t in column.to_pylist()])]
    keep = np.diff(raw[1]) > 1
    for side in (0, 1):
        keep &= _equal_texts(raw, pair.spelled(side, *found[side]))
    out = []
    for ids, off in found:
        count = np.diff(off)
        out.append((ids[np.repeat(keep, count)], np.r_[0, np.cumsum(np.where(keep, count, 0))].astype(np.int64)))
    return out


def group_sizes(a: Tokens, b: Tokens) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(a_in, b_in, doc)`` of each group: how many A and B tokens it holds, and its text."""
    order, group = coalesce_intervals(np.r_[a.start, b.start], np.r_[a.end, b.end])
    of = np.empty(len(order), np.int64)
    of[order] = group
    groups = int(group[-1]) + 1 if len(group) else 0
    in_a, in_b = of[: len(a.ids)], of[len(a.ids) :]
    doc = np.zeros(groups, np.int64)
    doc[in_a] = a.doc
    return np.bincount(in_a, minlength=groups), np.bincount(in_b, minlength=groups), doc


ALIGNED = "_id bigint, a_ids array<int>, b_ids array<int>, a_in array<int>, b_in array<int>"
CODED = "_id bigint, a binary, b binary"


def _lists(values: np.ndarray, off: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(values.astype(np.int32)))


def _blobs(ids: np.ndarray, off: np.ndarray, kind: np.dtype) -> pa.Array:
    """One binary value per text: its ids, ``kind.itemsize`` bytes each."""
    data = pa.py_buffer(ids.astype(kind))
    return pa.Array.from_buffers(pa.binary(), len(off) - 1, [None, pa.py_buffer((off * kind.itemsize).astype(np.int32)), data])


def _ids(column, kind: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    raw, off = text_bytes(column)
    return np.frombuffer(raw.tobytes(), kind).astype(np.int64), off // kind.itemsize


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.concat(F.lit(" "), F.col(text_col).cast("string"))
    return docs.select(F.col(id_col).cast("bigint").alias("_id"), text.alias("_text"))


def align_tokenizers(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, ``a_ids``, ``b_ids`` and, per group, the numbers ``a_in`` and ``b_in`` of their tokens.

    Both tokenizers spell a blank and the text. Byte offsets where an A and a B token
    both end cut the tokens into groups; the k-th group holds the next ``a_in[k]`` A and ``b_in[k]`` B tokens.

    * null and empty text, and texts that one of the tokenizers spells otherwise, have empty lists.
    * ids may repeat or be null; every row is aligned by itself, whole. Other columns are not read.
    * an empty table gives an empty result.

    Nothing is shuffled. Work is done on about 1 MB of text at a time; a longer text stands alone.
    """

    def run(batches):
        pair = tokenizer_pair(path_a, path_b)
        for batch in (part for whole in batches for part in slices(whole, 1)):
            found = encode_batch(pair, batch.column(1))
            a_in, b_in, doc = group_sizes(*[pair.placed(side, *found[side]) for side in (0, 1)])
            off = np.r_[0, np.cumsum(np.bincount(doc, minlength=len(batch)))].astype(np.int64)
            columns = [batch.column(0), *[_lists(*f) for f in found], _lists(a_in, off), _lists(b_in, off)]
            yield pa.RecordBatch.from_arrays(columns, names=["_id", "a_ids", "b_ids", "a_in", "b_in"])

    return _texts(docs, id_col, text_col).mapInArrow(lean_map(run), ALIGNED).withColumnRenamed("_id", id_col)


def encode_both(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(_id, a, b)``: the ids of both tokenizers as binary, for the steps that read them again."""

    def run(batches):
        pair = tokenizer_pair(path_a, path_b)
        for batch in (part for whole in batches for part in slices(whole, 1)):
            found = encode_batch(pair, batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), *[_blobs(*f, k) for f, k in zip(found, pair.kinds)]], names=["_id", "a", "b"])

    return _texts(docs, id_col, text_col).mapInArrow(lean_map(run), CODED)


def _tokens_of(batch, pair: TokenizerPair, first: int) -> tuple[Tokens, Tokens]:
    """Both token rows of a batch of :func:`encode_both`, at their places in the joined bytes."""
    return tuple(pair.placed(side, *_ids(batch.column(first + side), pair.kinds[side])) for side in (0, 1))


def linked_pairs(a: Tokens, b: Tokens) -> tuple[np.ndarray, np.ndarray]:
    """Of the overlapping pairs those whose byte ranges end together."""
    i, j = overlapping_pairs(a, b)
    together = a.end[i] == b.end[j]
    return i[together], j[together]


def link_counts(coded: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """``(a, b, n)``: the links of each id pair in all rows of :func:`encode_both`.

    Every partition counts its own pairs first. Tokens that end together are one
    the ending of the other, so there are at most as many pairs as the token bytes of both vocabularies.
    """

    def run(batches):
        pair = tokenizer_pair(path_a, path_b)
        keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in (part for whole in batches for part in slices(whole, 0)):
            a, b = _tokens_of(batch, pair, 0)
            i, j = linked_pairs(a, b)
            fresh, n = np.unique(a.ids[i] << _SHIFT | b.ids[j], return_counts=True)
            keys, where = np.unique(np.r_[keys, fresh], return_inverse=True)
            counts = np.bincount(where, weights=np.r_[counts, n], minlength=len(keys)).astype(np.int64)
        yield pa.RecordBatch.from_arrays(
            [pa.array(keys >> _SHIFT), pa.array(keys & np.int64(0xFFFFFFFF)), pa.array(counts)], names=["a", "b", "n"]
        )

    pairs = coded.select("a", "b").mapInArrow(lean_map(run), "a bigint, b bigint, n bigint")
    return pairs.groupBy("a", "b").agg(F.sum("n").alias("n"))


def group_digests(a_ids, b_ids, a_in, b_in, row_of_group: np.ndarray, rows: int) -> list[str]:
    """SHA-256 of ``a1,a2|b1;a3|b2,b3`` per row; an empty string for rows without groups."""
    groups = len(a_in)
    length = np.empty(2 * groups, np.int64)
    length[0::2], length[1::2] = a_in, b_in
    ends = np.cumsum(length)
    # Tokens of group 0 of A, group 0 of B, group 1 of A and so on.
    ids = np.empty(int(ends[-1]) if groups else 0, np.int64)
    ids[ragged((ends - length)[0::2], a_in)] = a_ids
    ids[ragged((ends - length)[1::2], b_in)] = b_ids
    digits = np.ones(len(ids), np.int64)
    power = 10
    while len(ids) and power <= ids.max():
        digits += ids >= power
        power *= 10
    upto = np.cumsum(digits + 1)
    text = np.full(int(upto[-1]) if len(ids) else 0, ord(","), np.uint8)
    for k in range(int(digits.max()) if len(ids) else 0):  # k-th digit from the right
        has = digits > k
        text[upto[has] - 2 - k] = ord("0") + ids[has] // 10**k % 10
    text[upto[ends[0::2] - 1] - 1] = ord("|")
    text[upto[ends[1::2] - 1] - 1] = ord(";")
    last = np.searchsorted(row_of_group, np.arange(rows), "right")  # groups up to each row
    stop = np.r_[0, upto][np.r_[0, ends[1::2]][last]]
    view = memoryview(text)
    return [hashlib.sha256(view[s : e - 1]).hexdigest() if e > s else "" for s, e in zip(np.r_[0, stop[:-1]].tolist(), stop.tolist())]


def alignment_report(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``n_best``, ``count_sum``, ``groups_sha256``.

    The ids of both tokenizers are stored once and read twice: for the counts of all linked id pairs, and
    for the rows. The counts are as many as the vocabularies allow, not as the input
    (checked), so they are sent to the tasks. Edge cases as in :func:`align_tokenizers`:
    zeros and an empty digest without tokens.
    """
    spark = docs.sparkSession
    coded = write_through(encode_both(docs, path_a, path_b, id_col, text_col), "coded")
    pair = tokenizer_pair(path_a, path_b)
    bound = 2 * sum(int(length.sum()) for _, length, _ in pair.bytes)
    counted = link_counts(coded, path_a, path_b).limit(bound + 1).toArrow()
    if counted.num_rows > bound:
        raise RuntimeError("more linked pairs than the vocabularies allow")
    keys = counted.column("a").to_numpy() << _SHIFT | counted.column("b").to_numpy()
    order = np.argsort(keys)
    keys, counts = keys[order], counted.column("n").to_numpy()[order]
    most = np.zeros(len(pair.bytes[1][1]), np.int64)
    np.maximum.at(most, keys & np.int64(0xFFFFFFFF), counts)
    shared = spark.sparkContext.broadcast((keys, counts, most))

    def run(batches):
        pair = tokenizer_pair(path_a, path_b)
        keys, counts, most = shared.value
        for batch in (part for whole in batches for part in slices(whole, 1)):
            a, b = _tokens_of(batch, pair, 1)
            a_in, b_in, of_row = group_sizes(a, b)
            rows = len(batch)
            i, j = linked_pairs(a, b)
            row = a.doc[i]
            n = counts[np.searchsorted(keys, a.ids[i] << _SHIFT | b.ids[j])]
            per = lambda doc, weights=None: np.bincount(doc, weights, minlength=rows).astype(np.int64)
            total = np.r_[0, np.cumsum(n)]
            edges = np.searchsorted(row, np.arange(rows + 1))  # links come in row order
            columns = [
                per(a.doc), per(b.doc), per(of_row), per(row), per(row[n == most[b.ids[j]]]), np.diff(total[edges]),
            ]
            digest = group_digests(a.ids, b.ids, a_in, b_in, of_row, rows)
            names = ["_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, columns), pa.array(digest, pa.string())], names=names)

    schema = "_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string"
    return coded.mapInArrow(lean_map(run), schema).withColumnRenamed("_id", id_col)
