"""The whole key-frame plan: from frames and prompts to fixed-length features."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, functions as F

from framelark.functions.storage import write_through
from framelark.operators import scenes, selection, signals

KEY = "video_id"


@dataclass(frozen=True)
class KeyframeConfig:
    """Defaults of the feature job."""

    num_keyframes: int = 40
    adaptive_budget: bool = False
    duration_ref: float = 14.78
    complexity_weight: float = 0.75
    min_raw: int = 40
    max_raw: int = 96
    min_scene: float = 2.0
    max_scene: float = 20.0
    boundary_pct: float = 0.92
    knn: int = 5
    importance: dict = field(default_factory=lambda: dict(signals.IMPORTANCE_WEIGHTS))
    greedy: selection.GreedyWeights = selection.GreedyWeights()
    compression: selection.CompressionWeights = selection.CompressionWeights()
    group_rows: int = selection.GROUP_ROWS


ABLATION = KeyframeConfig(greedy=selection.ABLATION_GREEDY, compression=selection.ABLATION_COMPRESSION)


@dataclass
class KeyframeResult:
    candidates: DataFrame
    selected: DataFrame
    failures: DataFrame
    features: DataFrame
    table: DataFrame


def extract_keyframes(
    frames: DataFrame, prompts: DataFrame, cfg: KeyframeConfig = KeyframeConfig(), durations: DataFrame | None = None
) -> KeyframeResult:
    """Score, segment, choose, compress and resample.

    ``frames``: ``video_id, sample_index, timestamp_sec, motion_raw,
    histogram_diff_raw, quality_raw, clip, dino``. Steps read more than once are
    stored in the shared scratch folder. The fused vectors are written once,
    with the raw signals; later tables hold scalars only.
    """
    # Stored once by video: both uses of the vectors read it.
    fused = write_through(signals.fuse_embeddings(frames), "fused", [KEY])
    raw_scores = write_through(signals.raw_signals(fused, prompts, cfg.knn).drop("dino", "clip"), "signals")
    vectors = raw_scores.select(KEY, "sample_index", "fused")
    scored = write_through(signals.importance(raw_scores.drop("fused"), cfg.importance), "scored")
    labelled = write_through(
        scenes.detect_scenes(scored, cfg.min_scene, cfg.max_scene, cfg.boundary_pct), "scenes"
    )
    budgets = write_through(
        scenes.raw_budget(
            labelled,
            durations,
            cfg.num_keyframes,
            cfg.adaptive_budget,
            cfg.duration_ref,
            cfg.complexity_weight,
            cfg.min_raw,
            cfg.max_raw,
            cfg.boundary_pct,
        ),
        "budgets",
    )
    max_budget = cfg.max_raw if cfg.adaptive_budget else cfg.num_keyframes
    with_vectors = labelled.join(vectors, [KEY, "sample_index"])
    picked = write_through(
        selection.greedy_select(with_vectors, budgets, cfg.greedy, max_budget, cfg.group_rows), "picked"
    )
    failures = picked.filter(F.col("error").isNotNull()).select(KEY, "error")
    raw = with_vectors.join(picked.filter(F.col("error").isNull()).drop("error"), [KEY, "sample_index"])
    raw = write_through(raw, "raw")
    scores = selection.scene_scores(labelled, cfg.compression)
    final = write_through(
        selection.compress_to_budget(raw, scores, cfg.num_keyframes, cfg.compression), "selected"
    )
    features = selection.resample_embeddings(final, cfg.num_keyframes)
    # Every scored frame, with what selection and compression said about it.
    table = labelled.join(picked.filter(F.col("error").isNull()).drop("error"), [KEY, "sample_index"], "left").join(
        final.select(KEY, "sample_index", "compression_score", "selected_rank"), [KEY, "sample_index"], "left"
    )
    return KeyframeResult(labelled, final.drop("fused"), failures, features, table)
