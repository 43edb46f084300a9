"""Quality classifier: random Fourier features, ridge by summed normal equations, isotonic calibration."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from framelark.functions.storage import write_through
from framelark.llm.lean import lean_map
from framelark.llm.ngram_join import _SPACE
from framelark.llm.packed import pieces, prefix_hash, range_hash, text_bytes

LOWER, UPPER, DIGIT, BLANK, NEWLINE, STOP, COMMA, LOUD, SIGN, BAR, QUOTE, HIGH, TAIL, CONTROL = range(14)
_KIND = np.full(256, CONTROL, np.uint8)
_KIND[97:123], _KIND[65:91], _KIND[48:58] = LOWER, UPPER, DIGIT
_KIND[[32, 9]], _KIND[10], _KIND[ord(".")], _KIND[ord(",")], _KIND[ord("|")] = BLANK, NEWLINE, STOP, COMMA, BAR
_KIND[[ord(c) for c in "!?"]] = LOUD
_KIND[[ord(c) for c in "#$%&*@^~=+<>_/\\"]] = SIGN
_KIND[[ord(c) for c in "\"'()-:;[]{}`"]] = QUOTE
_KIND[192:], _KIND[128:192] = HIGH, TAIL
STATISTICS = 19


def text_statistics(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """One row of ``STATISTICS`` numbers per text; an empty text gives zeros."""
    out = [np.zeros((0, STATISTICS))]
    for first, last in pieces(off, 1 << 20):
        base, rows = off[first], last - first
        chunk, edges = buf[base : off[last]], off[first : last + 1] - base
        n = len(chunk)
        size = np.diff(edges)
        owner = np.repeat(np.arange(rows), size)
        kind = _KIND[chunk]
        count = np.bincount(owner * 14 + kind, minlength=rows * 14).reshape(rows, 14).astype(float)
        inside = np.r_[False, ~_SPACE[chunk], False]
        head, tail = inside[1:-1] & ~inside[:-2], inside[1:-1] & ~inside[2:]
        cut = edges[edges < n]
        head[cut] = inside[1:-1][cut]
        ends = edges[1:][edges[1:] > 0] - 1
        tail[ends] = inside[1:-1][ends]
        start, end = np.flatnonzero(head), np.flatnonzero(tail) + 1
        word = range_hash(prefix_hash(chunk), start, end)
        doc = np.searchsorted(edges, start, "right") - 1
        words = np.bincount(doc, minlength=rows).astype(float)
        again = np.zeros(len(word), bool)
        again[1:] = (word[1:] == word[:-1]) & (doc[1:] == doc[:-1])
        again = np.bincount(doc[again], minlength=rows)
        order = np.lexsort((word, doc))
        new = np.ones(len(word), bool)
        new[1:] = (word[order][1:] != word[order][:-1]) | (doc[order][1:] != doc[order][:-1])
        distinct = np.bincount(doc[order][new], minlength=rows)
        length = (end - start).astype(float)
        mean = np.bincount(doc, weights=length, minlength=rows) / np.maximum(words, 1)
        spread = np.sqrt(np.maximum(np.bincount(doc, weights=length**2, minlength=rows) / np.maximum(words, 1) - mean**2, 0))
        signed = np.isin(kind[end - 1], (SIGN, LOUD)) if n else np.zeros(0, bool)
        signed = np.bincount(doc[signed], minlength=rows)
        w, chars = np.maximum(words, 1), np.maximum(size - count[:, TAIL], 1)
        letters = np.maximum(count[:, LOWER] + count[:, UPPER] + count[:, HIGH], 1)
        lines = count[:, NEWLINE] + (size > 0)
        out.append(
            np.stack(
                [
                    np.log1p(words),
                    np.log1p(size),
                    mean,
                    spread,
                    count[:, UPPER] / letters,
                    count[:, DIGIT] / chars,
                    np.sqrt(count[:, LOUD] / w),
                    np.sqrt(count[:, SIGN] / w),
                    np.sqrt(count[:, BAR] / w),
                    np.sqrt(count[:, QUOTE] / w),
                    count[:, STOP] / w,
                    count[:, COMMA] / w,
                    np.log1p(lines) - np.log1p(words),
                    count[:, HIGH] / letters,
                    count[:, CONTROL] / chars,
                    distinct / w,
                    np.log1p(distinct) - np.log1p(words),
                    again / w,
                    signed / w,
                ],
                axis=1,
            )
            * (size > 0)[:, None]
        )
    return np.concatenate(out)


@dataclass
class QualityModel:
    """Fixed-size model: its size depends on ``width`` and ``bins`` only."""

    mean: np.ndarray
    scale: np.ndarray
    width: int = 256
    seed: int = 17
    beta: np.ndarray | None = None
    knots: np.ndarray = field(default_factory=lambda: np.zeros(1))
    levels: np.ndarray = field(default_factory=lambda: np.full(1, 0.5))

    def expand(self, stats: np.ndarray) -> np.ndarray:
        """Cosines of random projections (a Gaussian kernel of width sqrt(d)), the statistics, and 1."""
        d = len(self.mean)
        rng = np.random.default_rng(self.seed)
        w, b = rng.normal(size=(d, self.width)) / np.sqrt(d), rng.uniform(0, 2 * np.pi, self.width)
        z = np.clip((np.nan_to_num(stats) - self.mean) / self.scale, -6, 6)
        return np.concatenate([np.sqrt(2 / self.width) * np.cos(z @ w + b), z, np.ones((len(z), 1))], axis=1)

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.expand(stats) @ self.beta

    def score(self, stats: np.ndarray) -> np.ndarray:
        if self.beta is None:
            return np.full(len(stats), 0.5)
        return np.clip(np.interp(self.raw(stats), self.knots, self.levels), 0.0, 1.0)


def isotonic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators over points sorted by ``x``: centre and level of each pool."""
    pools: list[list[float]] = []
    for xi, yi, wi in zip(x, y, weight):
        pools.append([xi * wi, yi * wi, wi])
        while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last)]
    p = np.array(pools)
    return p[:, 0] / p[:, 2], p[:, 1] / p[:, 2]


def text_hash(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def document_statistics(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(_id, text_hash, stats)`` per row, from whole texts."""

    def run(batches):
        for batch in batches:
            stats = text_statistics(*text_bytes(batch.column(1)))
            flat = pa.array(stats.ravel())
            offsets = pa.array(np.arange(len(stats) + 1, dtype=np.int32) * STATISTICS)
            lists = pa.ListArray.from_arrays(offsets, flat)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), lists], names=["_id", "text_hash", "stats"])

    text = F.col(text_col).cast("string")
    slim = docs.select(F.col(id_col).cast("bigint").alias("_id"), text.alias("_text"), text_hash(text).alias("text_hash"))
    return slim.mapInArrow(lean_map(run), "_id bigint, text_hash bigint, stats array<double>")


def fold_is_held_out(id_column: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(id_column.cast("string")), F.lit(5)) == 0, F.lit(False))


def _rows(batch, column: int) -> np.ndarray:
    return batch.column(column).values.to_numpy(zero_copy_only=False).reshape(-1, STATISTICS)


def fit_quality(train: DataFrame, width: int = 256, ridge: float = 1e-2, bins: int = 1024, seed: int = 17) -> QualityModel:
    """Fit on ``(stats, y)`` rows, all of them.

    Each partition sums its own normal equations; the sums meet row by row of the
    matrix, in two levels, so the driver gets one matrix. Calibration counts labels per
    bin of the raw score (at most ``bins + 1`` rows) and pools them. Without
    rows, or with one label only, every score is that label's share (0.5 without rows).
    """
    n, rate = train.agg(F.count(F.lit(1)), F.avg("y")).first()
    zero = np.zeros(STATISTICS)
    model = QualityModel(zero, zero + 1, width, seed)
    if not n or rate in (0.0, 1.0):
        model.levels = np.full(1, rate if n else 0.5)
        model.beta = np.zeros(width + STATISTICS + 1) if n else None
        return model
    moments = train.agg(
        *[F.avg(F.col("stats")[i]) for i in range(STATISTICS)], *[F.stddev_pop(F.col("stats")[i]) for i in range(STATISTICS)]
    ).first()
    model.mean = np.array(moments[:STATISTICS], float)
    model.scale = np.maximum(np.array(moments[STATISTICS:], float), 1e-6)
    side = width + STATISTICS + 1

    def equations(batches):
        total = np.zeros((side, side + 1))
        for batch in batches:
            z = model.expand(_rows(batch, 0))
            y = batch.column(1).to_numpy(zero_copy_only=False)
            total += z.T @ np.concatenate([z, y[:, None]], axis=1)
        salt = TaskContext.get().partitionId() % 64
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(side)), pa.array(np.full(side, salt)), pa.array([r.tobytes() for r in total], pa.binary())],
            names=["i", "salt", "line"],
        )

    def add(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        total = np.sum([np.frombuffer(x) for x in table.column("line").to_pylist()], axis=0)
        return pa.table({"i": [key[0].as_py()], "line": pa.array([total.tobytes()], pa.binary())})

    lines = train.select("stats", F.col("y").cast("double")).mapInArrow(lean_map(equations), "i bigint, salt bigint, line binary")
    sums = lines.groupBy("i", "salt").applyInArrow(add, "i bigint, line binary")
    sums = sums.groupBy("i").applyInArrow(add, "i bigint, line binary").collect()
    matrix = np.zeros((side, side + 1))
    for i, line in sums:
        matrix[i] = np.frombuffer(line)
    penalty = ridge * np.eye(side)
    penalty[-1, -1] = 0
    model.beta = np.linalg.solve(matrix[:, :side] + n * 1e-4 * penalty + 1e-9 * np.eye(side), matrix[:, side])

    def binned(batches):
        for batch in batches:
            raw = np.clip(model.raw(_rows(batch, 0)), -0.5, 1.5)
            place = np.rint((raw + 0.5) / 2 * bins).astype(np.int64)
            y = batch.column(1).to_numpy(zero_copy_only=False)
            c, s = np.bincount(place, minlength=bins + 1), np.bincount(place, weights=y, minlength=bins + 1)
            r = np.bincount(place, weights=raw, minlength=bins + 1)
            some = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array(some), *map(pa.array, (c[some].astype(float), s[some], r[some]))], names=list("bcsr"))

    counts = (
        train.select("stats", F.col("y").cast("double"))
        .mapInArrow(lean_map(binned), "b bigint, c double, s double, r double")
        .groupBy("b")
        .agg(F.sum("c"), F.sum("s"), F.sum("r"))
        .orderBy("b")
        .collect()
    )
    c, s, r = (np.array([x[k] for x in counts], float) for k in (1, 2, 3))
    model.knots, model.levels = isotonic(r / c, s / c, c)
    return model


def classify_quality(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    threshold: float = 0.3,
) -> DataFrame:
    """One row per input row: id, ``held_out``, ``score`` in 0..1, ``predicted``, ``text_hash``.

    Only statistics of the whole text are inputs. The model learns from all labelled
    rows whose crc32(id as text) modulo 5 is not 0; the others are ``held_out``.

    * null or empty text has statistics of zero and is scored like any other.
    * null labels are ignored; several labels of one id count with their mean.
    * null ids are not held out and never labelled; repeated rows get equal scores.
    * without usable labels every score is 0.5; an empty table gives an empty result.
    """
    stats = write_through(document_statistics(docs, id_col, text_col), "statistics")
    known = (
        labels.select(F.col(id_col).cast("bigint").alias("_l"), F.col(label_col).cast("double").alias("y"))
        .filter("_l IS NOT NULL AND y IS NOT NULL")
        .groupBy("_l")
        .agg(F.avg("y").alias("y"))
    )
    held = fold_is_held_out(F.col("_id"))
    train = stats.filter(~held).join(known, F.col("_id") == F.col("_l")).select("stats", "y")
    model = fit_quality(write_through(train, "labelled"))

    def run(batches):
        for batch in batches:
            score = model.score(_rows(batch, 2))
            predicted = pa.array((score >= threshold).astype(np.int32))
            names = ["_id", "score", "predicted", "text_hash"]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score), predicted, batch.column(1)], names=names)

    return stats.mapInArrow(lean_map(run), "_id bigint, score double, predicted int, text_hash bigint").select(
        F.col("_id").alias(id_col), fold_is_held_out(F.col("_id")).alias("held_out"), "score", "predicted", "text_hash"
    )
