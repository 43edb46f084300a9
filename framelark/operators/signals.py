"""Per-frame signals and their per-video normalisation."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import DoubleType

from framelark.functions.partitioned import GROUP_ROWS, exact_percentiles, null_safe, with_neighbors
from framelark.functions.storage import write_through
from framelark.functions.vectors import correlation_distance, dot, fuse
from framelark.operators.similarity import knn_rarity

KEY = "video_id"
HIST_BINS = 512
MAX_LOCAL_PROMPTS = 4096
MAX_LOCAL_NUMBERS = 1 << 22
PROMPT_BLOCK = 256

# Weights of the importance score.
IMPORTANCE_WEIGHTS = {
    "semantic_change": 0.34,
    "motion_score": 0.16,
    "histogram_score": 0.06,
    "quality_score": 0.14,
    "rarity_score": 0.14,
    "prompt_alignment": 0.22,
}


def _frame_bins(pixels: DataFrame) -> DataFrame:
    """Occupied colour bins of each frame, sorted, and the number of its pixels."""
    frame = [KEY, "frame_index"]

    def level(c: str):
        return F.floor(F.col(c) / 32).cast("int")

    bins = pixels.select(*frame, (level("r") * 64 + level("g") * 8 + level("b")).alias("bin"))
    counts = bins.groupBy(*frame, "bin").agg(F.count(F.lit(1)).alias("cnt"))
    entries = F.array_sort(F.collect_list(F.struct("bin", "cnt")))
    return counts.groupBy(*frame).agg(entries.alias("e"), F.sum("cnt").alias("total"))


def rgb_bins(pixels: DataFrame) -> DataFrame:
    """Sparse 8x8x8 colour histogram: share of each occupied bin per frame."""
    rows = _frame_bins(pixels).select(KEY, "frame_index", "total", F.inline("e"))
    return rows.select(KEY, "frame_index", "bin", (F.col("cnt") / F.col("total")).alias("share"))


def rgb_histogram(pixels: DataFrame) -> DataFrame:
    """Dense L1-normalised histogram of 512 bins per frame."""
    packed = _frame_bins(pixels)
    gaps = F.transform(
        "e",
        lambda x, i: F.concat(
            F.array_repeat(
                F.lit(0.0), x["bin"] - F.when(i == 0, F.lit(-1)).otherwise(F.get(F.col("e"), i - 1)["bin"]) - 1
            ),
            F.array(x["cnt"] / F.col("total")),
        ),
    )
    tail = F.array_repeat(F.lit(0.0), F.lit(HIST_BINS - 1) - F.element_at("e", -1)["bin"])
    return packed.select(KEY, "frame_index", F.concat(F.flatten(gaps), tail).alias("hist"))


def histogram_diff(df: DataFrame, hist: str = "hist", index: str = "sample_index") -> DataFrame:
    """Histogram change against the previous sample; 0 for the first."""
    near = with_neighbors(df, [KEY], index, [hist], after=False)
    change = F.when(F.col(f"prev_{hist}").isNull(), 0.0).otherwise(
        correlation_distance(F.col(f"prev_{hist}"), F.col(hist))
    )
    return near.withColumn("histogram_diff_raw", change).drop(f"prev_{hist}")


def frame_quality(df: DataFrame) -> DataFrame:
    """Exposure from mean luma, and sharpness weighted by it."""
    exposure = F.greatest(F.lit(0.0), 1.0 - F.abs(F.col("mean_luma") / 255.0 - 0.5) / 0.5)
    return df.withColumn("exposure_raw", exposure).withColumn(
        "quality_raw", F.col("sharpness_raw") * (0.5 + 0.5 * F.col("exposure_raw"))
    )


def fuse_embeddings(df: DataFrame, clip_weight: float = 0.55, dino_weight: float = 0.45) -> DataFrame:
    return df.withColumn("fused", fuse(F.col("clip"), F.col("dino"), clip_weight, dino_weight))


def _neighbor_distances(df: DataFrame) -> DataFrame:
    near = with_neighbors(df, [KEY], "sample_index", ["fused"])

    def distance(col: str):
        return F.lit(1.0) - F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(F.col(col), F.col("fused"))))

    return near.select(
        *df.columns,
        F.when(F.col("prev_fused").isNotNull(), distance("prev_fused")).alias("prev_dist"),
        F.when(F.col("next_fused").isNotNull(), distance("next_fused")).alias("next_dist"),
    )


def semantic_change(df: DataFrame) -> DataFrame:
    """Mean distance to the neighbours and distance to the previous sample.

    One pass gives both ``semantic_raw`` and ``boundary_raw``.
    """
    near = _neighbor_distances(df)
    both = F.coalesce("prev_dist", F.lit(0.0)) + F.coalesce("next_dist", F.lit(0.0))
    count = F.col("prev_dist").isNotNull().cast("int") + F.col("next_dist").isNotNull().cast("int")
    return near.select(
        *df.columns,
        (both / F.greatest(count, F.lit(1))).alias("semantic_raw"),
        F.coalesce("prev_dist", F.lit(0.0)).alias("boundary_raw"),
    )


def boundary_strength(df: DataFrame) -> DataFrame:
    return semantic_change(df).drop("semantic_raw")


def prompt_alignment(frames: DataFrame, prompts: DataFrame, vec: str = "clip") -> DataFrame:
    """Highest cosine of each frame to any prompt; 0 without prompts, null for a null vector.

    Null prompts are left out. A bank of up to ``MAX_LOCAL_PROMPTS`` rows and ``MAX_LOCAL_NUMBERS``
    numbers (both checked) travels with the task as one matrix. A larger bank is cut into
    blocks and joined by block number, with equal results, also on null keys and repeated
    ones. Both sides must have unit length.
    """
    bank = prompts.select("embedding").filter("embedding IS NOT NULL")
    size = bank.limit(MAX_LOCAL_PROMPTS + 1).agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.size("embedding")), F.lit(0)).alias("numbers")
    ).first()
    if size.n > MAX_LOCAL_PROMPTS or size.numbers > MAX_LOCAL_NUMBERS:
        return _prompt_alignment_blocks(frames, bank, vec)
    if not size.n:
        return frames.withColumn("prompt_raw", F.when(F.col(vec).isNotNull(), 0.0))
    matrix = np.asarray([list(r[0]) for r in bank.collect()], dtype="float64").T

    @F.pandas_udf(DoubleType())
    def best_cosine(vecs):
        import pandas as pd

        out, there = np.full(len(vecs), np.nan), vecs.notna().to_numpy()
        if there.any():
            out[there] = (np.stack(vecs[there].to_list()) @ matrix).max(axis=1)
        return pd.Series(out).where(there, None)

    return frames.withColumn("prompt_raw", best_cosine(F.col(vec)))


def _prompt_alignment_blocks(frames: DataFrame, prompts: DataFrame, vec: str) -> DataFrame:
    """The same by an equi-join on block numbers. Equal vectors have equal scores, so the vector is the key."""
    hashed = prompts.select(F.xxhash64("embedding").alias("h"), "embedding")
    total = prompts.count()
    blocks = max(1, -(-total // PROMPT_BLOCK))
    bank = hashed.groupBy(F.pmod("h", F.lit(blocks)).cast("int").alias("pblock")).agg(
        F.collect_list("embedding").alias("bank")
    )
    used = bank.select("pblock")
    known = frames.select(F.col(vec).alias("_vec")).filter("_vec IS NOT NULL").distinct()
    spread = known.withColumn("pblock", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    score = F.array_max(F.transform("bank", lambda p: dot(p, F.col("_vec"))))
    best = (
        spread.join(used, "pblock", "left_semi").join(bank, "pblock")
        .groupBy("_vec")
        .agg(F.max(score).alias("prompt_raw"))
    )
    return frames.join(best, F.col(vec) == F.col("_vec"), "left").drop("_vec")


def robust_minmax(
    df: DataFrame,
    columns: dict[str, str],
    keys: list[str] | None = None,
    lower: float = 0.05,
    upper: float = 0.95,
    group_rows: int = GROUP_ROWS,
) -> DataFrame:
    """Scale ``{source: output}`` columns on their 5th..95th percentile per key, clipped to [0, 1].

    Every row stays; rows whose key is null are one key.
    """
    keys = keys or [KEY]
    wanted = {}
    for src in columns:
        wanted[f"_lo_{src}"] = (src, lower)
        wanted[f"_hi_{src}"] = (src, upper)
    found = exact_percentiles(df, keys, wanted, group_rows)
    marks = [f"_of_{c}" for c in keys]
    scaled = df.join(found.withColumnsRenamed(dict(zip(keys, marks))), null_safe(keys, marks))

    def scale(src: str):
        lo, span = F.col(f"_lo_{src}"), F.col(f"_hi_{src}") - F.col(f"_lo_{src}")
        inside = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.try_divide(F.col(src) - lo, span)))
        return F.when(span < 1e-8, 0.0).otherwise(inside)

    keep = [c for c in df.columns if c not in columns.values()]
    return scaled.select(*keep, *[scale(src).alias(out) for src, out in columns.items()])


def raw_signals(frames: DataFrame, prompts: DataFrame, k: int = 5) -> DataFrame:
    """All raw signals of fused frames, before scaling.

    Only ids and fused vectors go through the windows; they come back as numbers.
    """
    slim = frames.select(KEY, "sample_index", "fused")
    change = semantic_change(slim).drop("fused")
    rare = knn_rarity(slim, [KEY], k).withColumnRenamed("rarity", "rarity_raw")
    rare = rare.withColumn("sample_index", F.col("sample_index").cast("int"))
    return prompt_alignment(frames, prompts).join(change, [KEY, "sample_index"]).join(rare, [KEY, "sample_index"])


def importance(df: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """Scale the raw signals and add the weighted sum ``local_importance``."""
    weights = weights or IMPORTANCE_WEIGHTS
    scaled = robust_minmax(
        df,
        {
            "semantic_raw": "semantic_change",
            "boundary_raw": "boundary_score",
            "motion_raw": "motion_score",
            "histogram_diff_raw": "histogram_score",
            "quality_raw": "quality_score",
            "rarity_raw": "rarity_score",
            "prompt_raw": "prompt_alignment",
        },
    )
    total = sum((F.lit(w) * F.col(c) for c, w in weights.items()), F.lit(0.0))
    return scaled.withColumn("local_importance", total)


def score_frames(
    frames: DataFrame, prompts: DataFrame, weights: dict[str, float] | None = None, k: int = 5
) -> DataFrame:
    """Importance of every fused frame. The raw signals are stored once before scaling."""
    return importance(write_through(raw_signals(frames, prompts, k), "signals"), weights)
