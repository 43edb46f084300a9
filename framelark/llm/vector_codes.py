"""Vector code compression: integer codebooks per part, searched by slice-and-intersect bitmasks."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from framelark.functions.storage import write_through
from framelark.llm.lean import lean_map

#: Components of this size still give exact squared distances in 64 bits for vectors of up to 2,000 numbers.
LARGEST = 1 << 25
_ONE = np.uint64(1)


class SliceIndex:
    """Nearest entry of one codebook (at most 64 entries), exact, ties to the lower index.

    Per dimension the entries' coordinates are sorted, and ``prefix[i]`` is the mask of the
    first ``i`` of them. The entries within a radius of ``x`` in that dimension are two
    prefix masks apart; the masks of all dimensions are ANDed. What is left holds every
    entry whose distance is at most the radius, so a best candidate within the
    radius is the nearest entry. Rows without one are searched again with a radius that
    their best candidate, or a doubling, gives.
    """

    def __init__(self, book: np.ndarray):
        self.book = book  # entries x width
        k, width = book.shape
        order = np.argsort(book, axis=0, kind="stable")
        self.sorted = np.take_along_axis(book, order, axis=0).T.copy()
        self.prefix = np.zeros((width, k + 1), np.uint64)
        for j in range(width):
            np.bitwise_or.accumulate(_ONE << order[:, j].astype(np.uint64), out=self.prefix[j, 1:])
        apart = ((book[:, None, :] - book[None, :, :]) ** 2).sum(axis=2)
        some = apart[apart > 0]
        # Half the usual distance between entries: most vectors find their entry at once.
        self.radius = max(1, int(np.sqrt(np.median(some))) // 2) if len(some) else 1

    def masks(self, x: np.ndarray, radius: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.prefix[0, -1] if len(self.prefix) else _ONE)
        for j in range(x.shape[1]):
            low = np.searchsorted(self.sorted[j], x[:, j] - radius, "left")
            high = np.searchsorted(self.sorted[j], x[:, j] + radius, "right")
            out &= self.prefix[j, high] ^ self.prefix[j, low]
        return out

    def best(self, x: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``(entry, squared distance)`` among the entries of each mask; -1 where it is empty."""
        entry, least = np.full(len(x), -1, np.int64), np.full(len(x), np.iinfo(np.int64).max)
        rows = np.flatnonzero(mask)
        left = mask[rows]
        while len(rows):
            at = np.bitwise_count((left & (~left + _ONE)) - _ONE).astype(np.int64)  # lowest set bit
            gap = x[rows] - self.book[at]
            far = np.einsum("ij,ij->i", gap, gap)
            closer = far < least[rows]  # entries come in ascending order: a tie keeps the lower one
            entry[rows[closer]], least[rows[closer]] = at[closer], far[closer]
            left = left & (left - _ONE)
            more = left != 0
            rows, left = rows[more], left[more]
        return entry, least

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        radius = np.full(len(x), self.radius, np.int64)
        entry, least = self.best(x, self.masks(x, radius))
        open_rows = np.flatnonzero((entry < 0) | (least > radius**2))
        while len(open_rows):
            none = entry[open_rows] < 0
            # The root of the best distance, rounded up: everything nearer lies inside.
            root = np.ceil(np.sqrt(np.where(none, 0, least[open_rows]).astype(float))).astype(np.int64) + 1
            wider = radius[open_rows] = np.where(none, radius[open_rows] * 2, root)
            found = self.best(x[open_rows], self.masks(x[open_rows], wider))
            entry[open_rows], least[open_rows] = found
            open_rows = open_rows[(found[0] < 0) | (found[1] > wider**2)]
        return entry, least


@dataclass
class Codebooks:
    """``parts`` codebooks of ``k`` entries of ``width`` integers each; of fixed size."""

    books: np.ndarray  # parts x k x width

    def __post_init__(self):
        self.indexes = [SliceIndex(b) for b in self.books]

    def assign(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``(codes, squared distance summed over parts)`` of ``n x parts x width`` integers."""
        codes, error = np.zeros(x.shape[:2], np.uint8), np.zeros(len(x), np.int64)
        for p, index in enumerate(self.indexes):
            entry, least = index.nearest(x[:, p])
            codes[:, p] = entry
            error += least
        return codes, error

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.books.ravel().tolist())).encode()).hexdigest()


def integer_vectors(vectors: DataFrame, id_col: str, vector_col: str, label_col: str, scale: int) -> DataFrame:
    """``(_id, _label, _v)`` of the rows whose vector is not null and has finite components only; built-in functions."""
    x = F.col(vector_col).cast("array<double>")
    finite = F.forall(x, lambda c: F.coalesce(F.abs(c) < float("inf"), F.lit(False)) & ~F.isnan(c))
    too_far = F.raise_error(F.lit(f"a component times {scale} is {LARGEST} or more")).cast("bigint")
    whole = F.transform(x, lambda c: F.when(F.abs(c) * scale < LARGEST, F.floor(c * scale)).otherwise(too_far).cast("int"))
    return vectors.filter(x.isNotNull() & finite).select(F.col(id_col).alias("_id"), F.col(label_col).alias("_label"), whole.alias("_v"))


def _matrix(column, dim: int, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """``(rows of length dim, their numbers as n x parts x width)`` of an Arrow list column."""
    length = np.diff(column.offsets.to_numpy())
    good = length == dim
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return good, flat[np.repeat(good, length)].reshape(int(good.sum()), parts, dim // parts)


def fit_codebooks(whole: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2) -> Codebooks | None:
    """Codebooks from all rows of :func:`integer_vectors`; None without rows.

    They start as the vectors of the smallest ids (``entries`` of them). Each round, every
    partition sums the vectors of each entry; the sums meet in a grouped sum by part and
    entry, so the driver gets one row per entry, whatever the input.
    """

    def smallest(rows: DataFrame, n: int) -> list:
        return [r[0] for r in rows.orderBy(F.asc_nulls_last("_id"), "_v").select("_v").limit(n).collect()]

    seeds = smallest(whole, entries)
    if not seeds:
        return None
    dim = len(seeds[0])
    if any(len(v) != dim for v in seeds):
        seeds = smallest(whole.filter(F.size("_v") == dim), entries)
    if dim % parts:
        raise ValueError(f"vectors of {dim} components have no {parts} equal parts")
    width = dim // parts
    found = Codebooks(np.array(seeds, np.int64).reshape(len(seeds), parts, width).transpose(1, 0, 2).copy())
    k, columns = len(seeds), [f"s{j}" for j in range(width)]

    for _ in range(rounds):
        state = found

        def add(batches):
            sums, counts = np.zeros((parts * k, width), np.int64), np.zeros(parts * k, np.int64)
            for batch in batches:
                _, x = _matrix(batch.column(0), dim, parts)
                codes, _ = state.assign(x)
                where = (codes + np.arange(parts) * k).ravel()
                counts += np.bincount(where, minlength=parts * k)
                np.add.at(sums, where, x.reshape(len(where), width))
            used = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays(
                [pa.array(a) for a in (used, counts[used], *sums[used].T)], names=["slot", "n", *columns]
            )

        schema = ", ".join(f"{c} bigint" for c in ["slot", "n", *columns])
        totals = whole.select("_v").mapInArrow(lean_map(add), schema).groupBy("slot").agg(*[F.sum(c).alias(c) for c in ["n", *columns]])
        books = found.books.reshape(parts * k, width).copy()
        for slot, n, *sums in totals.collect():  # at most parts x entries rows
            books[slot] = [s // n for s in sums]
        found = Codebooks(books.reshape(parts, k, width))
    return found


def encode_vectors(whole: DataFrame, found: Codebooks) -> DataFrame:
    """``(_id, _label, code, error)`` per row; null code and error where the length is not the codebooks'."""
    parts, _, width = found.books.shape
    dim, fields = parts * width, {f.name: f.dataType.simpleString() for f in whole.schema.fields}

    def run(batches):
        for batch in batches:
            good, x = _matrix(batch.column(2), dim, parts)
            codes, error = found.assign(x)
            text = codes.tobytes().hex()
            code = np.full(len(good), None, object)
            code[good] = [text[i : i + 2 * parts] for i in range(0, len(text), 2 * parts)]
            total = np.zeros(len(good), np.int64)
            total[good] = error
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(code, pa.string()), pa.array(total, mask=~good)],
                names=["_id", "_label", "code", "error"],
            )

    return whole.mapInArrow(lean_map(run), f"_id {fields['_id']}, _label {fields['_label']}, code string, error bigint")


def compress_vectors(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    parts: int = 16,
    entries: int = 64,
    rounds: int = 2,
    scale: int = 256,
    salts: int = 32,
) -> DataFrame:
    """One row per kept row: id, ``code``, ``error``, ``label_error``, ``codebooks_sha256``, and the label as ``label``.

    A component becomes ``floor(scale * x)``; a vector is cut into ``parts`` and each part
    coded by its nearest codebook entry (two hex digits). All arithmetic is on integers, so
    reruns agree to the bit. The input is read once per round and twice more; store it before
    if it is dear to compute.

    * rows whose vector is null, or holds null or non-finite components, are dropped.
    * vectors of another length than that of the smallest id get null code and error, and
      count nowhere; a length that ``parts`` does not divide is an error (ValueError), as is a
      component of 2**25 / ``scale`` or more. Vectors without components have the code 0...0.
    * null ids come after all others when the first codebooks are chosen; repeated ids are
      separate vectors, ordered by their numbers.
    * null labels are one label. Fewer rows than ``entries`` give smaller codebooks.
    * an empty table, or one without a usable vector, gives an empty result.
    * further columns are not read, whatever their names.

    ``label_error`` is summed before the shuffle and joined back by label and salt, so no
    task holds all rows of a label.
    """
    if entries > 64:
        raise ValueError("a mask holds at most 64 entries")
    whole = integer_vectors(vectors, id_col, vector_col, label_col, scale)
    found = fit_codebooks(whole, parts, entries, rounds)
    if found is None:
        none = whole.select("_id", "_label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("bigint").alias("error"))
        coded, digest = none.filter("false"), ""
    else:
        coded, digest = write_through(encode_vectors(whole, found), "codes"), found.digest()
    totals = coded.groupBy(F.col("_label").alias("_of")).agg(F.sum("error").alias("label_error"))
    totals = totals.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    mine = coded.withColumn("_salt", F.pmod(F.xxhash64("_id", "code"), F.lit(salts)).cast("int"))
    joined = mine.join(totals, F.col("_label").eqNullSafe(F.col("_of")) & (F.col("_salt") == F.col("_part")))
    return joined.select(
        F.col("_id").alias(id_col), F.col("_label").alias("label"), "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256")
    )
