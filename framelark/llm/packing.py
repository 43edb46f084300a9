"""Best-fit packing of tokenised documents under several capacities at once."""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from framelark.functions.storage import write_through
from framelark.llm.lean import at_task_end, lean_group, lean_map
from framelark.llm.packed import ragged, slices
from framelark.llm.word_split import WordCoder, ids_list, read_vocabulary

_CODERS: dict[str, WordCoder] = {}
at_task_end(_CODERS.clear)


def library_coder(path: str) -> WordCoder:
    """A coder whose new words go through the tokeniser library, with the ranks of the file at ``path``."""
    if path not in _CODERS:
        import tiktoken

        tokens, _, special = read_vocabulary(path)
        one_word = tiktoken.Encoding("words", pat_str=r"[\s\S]+", mergeable_ranks=tokens, special_tokens={})
        _CODERS[path] = WordCoder(one_word.encode_ordinary, special)
    return _CODERS[path]


@dataclass(frozen=True)
class Capacity:
    """What one sequence may hold. ``attention`` bounds the sum of squared piece lengths."""

    tokens: int = 1024
    documents: int | None = None
    attention: int | None = None
    #: ``norm``: smallest weighted residual norm after placing; ``dot``: largest demand times residual.
    rule: str = "norm"
    weights: tuple[float, float, float] = (1.0, 1e-3, 1e-3)

    def limits(self) -> np.ndarray:
        t = self.tokens
        return np.array([t, t if self.documents is None else self.documents, t * t if self.attention is None else self.attention])


def vector_best_fit(lengths: np.ndarray, capacity: Capacity) -> tuple[np.ndarray, np.ndarray]:
    """``(bin, offset)`` of each piece, longest first, each into the best bin that has room in every capacity.

    Pieces of one length are placed together: under the norm rule a bin that takes
    one stays the best while it has room, so bins are filled in order of their norm;
    under the dot rule every bin takes one per round. A piece that exceeds a capacity
    by itself gets a bin of its own.
    """
    limits = capacity.limits().astype(np.int64)
    scale = np.array(capacity.weights) / np.maximum(limits, 1)
    order = np.argsort(-lengths, kind="stable")
    which, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    open_bins = np.zeros(0, np.int64)
    left = np.zeros((0, 3), np.int64)  # residual of every bin, open or not
    bins = 0
    ordered = lengths[order]
    smallest = int(ordered[-1]) if len(ordered) else 0
    at = 0
    while at < len(order):
        size = int(ordered[at])
        stop = at + int(np.searchsorted(-ordered[at:], -size, "right"))
        need = np.array([size, 1, size * size], np.int64)
        per = np.maximum(need, 1)
        while at < stop and len(open_bins):
            room = (left[open_bins] // per).min(axis=1)
            fit = np.flatnonzero(room > 0)
            if not len(fit):
                break
            after = left[open_bins[fit]]
            if capacity.rule == "norm":
                score = (((after - need) * scale) ** 2).sum(axis=1)
                take = room[fit]
            else:
                score = -(after * scale * need * scale).sum(axis=1)
                take = np.ones(len(fit), np.int64)
            best = np.argsort(score, kind="stable")
            take = take[best]
            upto = np.minimum(np.cumsum(take), stop - at)
            take = np.diff(np.r_[0, upto])
            target = np.repeat(open_bins[fit[best]], take)
            step = np.arange(len(target)) - np.repeat(upto - take, take)
            mine = order[at : at + len(target)]
            which[mine], offset[mine] = target, limits[0] - left[target, 0] + step * size
            left[open_bins[fit[best]]] -= take[:, None] * need
            at += len(target)
        if at < stop:
            count = stop - at
            each = max(1, int((limits // per).min()))
            fresh = -(-count // each)
            mine = order[at:stop]
            which[mine] = bins + np.arange(count) // each
            offset[mine] = np.arange(count) % each * size
            took = np.full(fresh, each, np.int64)
            took[-1] = count - each * (fresh - 1)
            left = np.concatenate([left, np.maximum(limits - took[:, None] * need, 0)])
            open_bins = np.r_[open_bins, bins + np.arange(fresh)]
            bins += fresh
            at = stop
        open_bins = open_bins[(left[open_bins] >= [smallest, 1, smallest * smallest]).all(axis=1)]
    return which, offset


PIECE = "_row bigint, _id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


def tokenised_pieces(docs: DataFrame, path: str, id_col: str, text_col: str, tokens: int, end_id: int | None, with_ids: bool):
    """Pieces of at most ``tokens`` ids; only longer documents are cut, and then the first piece takes the remainder."""

    def run(batches):
        coder = library_coder(path)
        for batch in (part for whole in batches for part in slices(whole, 2)):
            ids, off = coder.encode(batch.column(2))
            n = len(off) - 1
            if end_id is not None:
                ids = np.insert(ids, off[1:], np.uint32(end_id))
                off = off + np.arange(n + 1)
            total = np.diff(off)
            count = np.where(total > 0, -(-total // tokens), 0)
            row = np.repeat(np.arange(n), count)
            piece = ragged(np.zeros(n, np.int64), count)
            head = total - (count - 1) * tokens  # length of the first piece
            start = np.where(piece == 0, 0, head[row] + (piece - 1) * tokens)
            length = np.where(piece == 0, head[row], tokens)
            begin = off[:-1][row] + start
            raw = memoryview(ids.astype("<u4"))
            crc = np.array([zlib.crc32(raw[a:b]) for a, b in zip(begin.tolist(), (begin + length).tolist())], np.int64)
            take = pa.array(row)
            columns = [batch.column(0).take(take), batch.column(1).take(take), piece.astype(np.int32), start, length, crc]
            names = ["_row", "_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                columns.append(ids_list(ids, np.r_[off[:1], begin + length]))
                names.append("ids")
            yield pa.RecordBatch.from_arrays([pa.array(c) if isinstance(c, np.ndarray) else c for c in columns], names=names)

    slim = docs.select(
        F.monotonically_increasing_id().alias("_row"),
        F.col(id_col).cast("bigint").alias("_id"),
        F.col(text_col).cast("string").alias("_text"),
    )
    return slim.mapInArrow(lean_map(run), PIECE + (", ids array<int>" if with_ids else ""))


def pack_documents(
    docs: DataFrame,
    path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: Capacity = Capacity(),
    end_id: int | None = 2,
    with_ids: bool = False,
    group_pieces: int = 32_768,
) -> DataFrame:
    """One row per piece: id, ``piece``, ``start``, ``length``, ``ids_crc32``, ``sequence_id``, ``offset`` (and ``ids``).

    A document is its ids and then ``end_id``. Pieces are dealt by hash into groups of
    about ``group_pieces`` and packed per group, so a sequence has pieces of one group only;
    a group closes all but its last few sequences, which costs well under one in a
    thousand. Within a sequence ``offset`` runs without gaps from 0.

    * null and empty text are a document of ``end_id`` alone (no piece at all without ``end_id``).
    * ids may repeat or be null: every row is packed; its pieces share no sequence on purpose.
    * an empty table gives an empty result; other columns are not read.
    """
    pieces = write_through(tokenised_pieces(docs, path, id_col, text_col, capacity.tokens, end_id, with_ids), "pieces")
    groups = max(1, -(-pieces.count() // group_pieces))
    slim = pieces.select("_row", "_id", "piece", "start", "length", "ids_crc32").withColumn(
        "_group", F.pmod(F.xxhash64("_row", "piece"), F.lit(groups))
    )

    def pack(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        table = table.sort_by([("_id", "ascending"), ("_row", "ascending"), ("piece", "ascending")])
        which, offset = vector_best_fit(table.column("length").to_numpy(), capacity)
        table = table.drop_columns(["_group"])
        return table.append_column("sequence_id", pa.array((key[0].as_py() << 32) + which)).append_column(
            "offset", pa.array(offset)
        )

    packed = slim.groupBy("_group").applyInArrow(lean_group(pack), PIECE + ", sequence_id bigint, offset bigint")
    if with_ids:
        packed = packed.join(pieces.select("_row", "piece", "ids"), ["_row", "piece"])
    columns = ["piece", "start", "length", "ids_crc32", "sequence_id", "offset", *(["ids"] if with_ids else [])]
    return packed.select(F.col("_id").alias(id_col), *columns)
