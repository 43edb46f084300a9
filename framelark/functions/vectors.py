"""Column expressions over vectors stored as ``ARRAY<DOUBLE>``."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def as_double(vec: Column) -> Column:
    return vec.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def l2_normalize(vec: Column, floor: float = 1e-8) -> Column:
    """Scale to unit length. The norm is repeated as an array, so it is computed once per row."""
    total = F.aggregate(vec, F.lit(0.0), lambda s, x: s + x * x)
    norms = F.array_repeat(F.greatest(F.sqrt(total), F.lit(floor)), F.size(vec))
    return F.zip_with(vec, norms, lambda x, n: x / n)


def fuse(clip: Column, dino: Column, clip_weight: float = 0.55, dino_weight: float = 0.45) -> Column:
    """Weighted concatenation of two embeddings, scaled to unit length."""
    joined = F.concat(
        F.transform(clip, lambda x: x * F.lit(clip_weight)),
        F.transform(dino, lambda x: x * F.lit(dino_weight)),
    )
    return l2_normalize(joined)


def zeros(width: int) -> Column:
    return F.array_repeat(F.lit(0.0), width)


def correlation_distance(prev: Column, cur: Column) -> Column:
    """``1 - Pearson``; flat histograms count as equal when all bins are close.

    The means and the three sums are bound by struct steps, so nothing is
    recomputed per element.
    """
    n = F.size(cur).cast("double")
    means = F.struct(
        (F.aggregate(prev, F.lit(0.0), lambda s, x: s + x) / n).alias("mp"),
        (F.aggregate(cur, F.lit(0.0), lambda s, x: s + x) / n).alias("mc"),
    )
    pairs = F.zip_with(prev, cur, lambda p, c: F.struct(p.alias("p"), c.alias("c")))

    def with_means(m: Column) -> Column:
        zero = F.struct(F.lit(0.0).alias("pc"), F.lit(0.0).alias("pp"), F.lit(0.0).alias("cc"), F.lit(True).alias("same"))

        def step(s, x):
            dp, dc = x["p"] - m["mp"], x["c"] - m["mc"]
            near = F.abs(x["p"] - x["c"]) <= F.lit(1e-8) + F.lit(1e-5) * F.abs(x["c"])
            return F.struct(
                (s["pc"] + dp * dc).alias("pc"),
                (s["pp"] + dp * dp).alias("pp"),
                (s["cc"] + dc * dc).alias("cc"),
                (s["same"] & near).alias("same"),
            )

        def finish(s):
            denom = F.sqrt(s["pp"]) * F.sqrt(s["cc"])
            return F.when(denom < 1e-8, F.when(s["same"], 0.0).otherwise(1.0)).otherwise(
                F.lit(1.0) - F.try_divide(s["pc"], denom)
            )

        return F.aggregate(pairs, zero, step, finish)

    return F.transform(F.array(means), with_means)[0]
