"""Writers and the tables they write."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from framelark.functions.text import video_number

# Columns of the candidate table and of the category metrics.
CANDIDATE_COLUMNS = [
    "sample_index", "frame_index", "timestamp_sec", "scene_id", "motion_raw", "histogram_diff_raw",
    "sharpness_raw", "exposure_raw", "quality_raw", "semantic_change", "boundary_score", "motion_score",
    "histogram_score", "quality_score", "rarity_score", "prompt_alignment", "local_importance",
    "selection_gain", "raw_selected_rank", "compression_score", "selected_rank",
]
CATEGORY_COLUMNS = [
    "category", "num_videos", "num_train_videos", "avg_train_duration_sec",
    "bleu_1", "bleu_2", "bleu_3", "bleu_4", "meteor", "rouge_l", "cider",
]
STATUSES = ["ok", "skipped_existing", "failed"]


def candidate_scores(df: DataFrame) -> DataFrame:
    """The candidate columns that exist, times to 4 places and other floats to 6."""
    out = [F.col("video_id")]
    for name in CANDIDATE_COLUMNS:
        if name in df.columns:
            col = F.col(name)
            if df.schema[name].dataType.typeName() in ("double", "float"):
                col = F.bround(col, 4 if name == "timestamp_sec" else 6)
            out.append(col.alias(name))
    return df.select(*out)


def selected_timestamps(selected: DataFrame) -> DataFrame:
    """Rank and time of the chosen frames; groups are bounded by the frame budget."""
    order = W.partitionBy("video_id").orderBy("timestamp_sec", "sample_index")
    return selected.select(
        "video_id",
        F.row_number().over(order).alias("selected_rank"),
        F.format_string("%.6f", "timestamp_sec").alias("timestamp_sec"),
    )


def manifest(videos: DataFrame, done: DataFrame, results: DataFrame, failures: DataFrame) -> DataFrame:
    """Status of every video: skipped when already done, failed, or ok with its counts."""
    base = videos.select("video_id").join(done.select("video_id", F.lit(True).alias("_done")).distinct(), "video_id", "left")
    joined = base.join(failures.select("video_id", "error"), "video_id", "left").join(results, "video_id", "left")
    status = (
        F.when(F.col("_done"), "skipped_existing").when(F.col("error").isNotNull(), "failed").otherwise("ok")
    )
    return joined.withColumn("status", status).drop("_done")


def manifest_summary(rows: DataFrame) -> DataFrame:
    return rows.agg(
        F.count(F.lit(1)).alias("processed_videos"),
        F.count_if(F.col("status") == "ok").alias("successful_videos"),
        F.count_if(F.col("status") == "skipped_existing").alias("skipped_videos"),
        F.count_if(F.col("status") == "failed").alias("failed_videos"),
    )


def write_split_captions(captions: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite") -> None:
    captions.select("split", "video_id", "cap_id", "caption").write.mode(mode).partitionBy("split").format(fmt).save(path)


def write_features(features: DataFrame, path: str, mode: str = "overwrite", most_records: int = 0) -> None:
    """Store by family and split.

    The rows are dealt by family and split, and adaptive execution cuts large parts and joins
    small ones to its advisory size, so the number of files follows the bytes written.
    ``most_records`` bounds the rows of a file (0: no bound).
    """
    dealt = features.hint("rebalance", "family", "split")
    dealt.write.mode(mode).option("maxRecordsPerFile", most_records).partitionBy("family", "split").parquet(path)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("header", True).csv(path)


def write_candidates(df: DataFrame, path: str) -> None:
    write_csv(candidate_scores(df), path)


def write_timestamps(selected: DataFrame, path: str) -> None:
    write_csv(selected_timestamps(selected), path)


def write_failures(failures: DataFrame, path: str) -> None:
    """Append failures as JSON lines."""
    failures.select("video_id", "error").write.mode("append").json(path)


def write_metrics(rows: DataFrame, path: str, columns: list[str] | None = None, fmt: str = "csv") -> None:
    """Metric rows in fixed columns; absent ones are left out of JSON and empty in CSV."""
    columns = columns or CATEGORY_COLUMNS
    whole = rows.select(*[F.col(c) if c in rows.columns else F.lit(None).cast("string").alias(c) for c in columns])
    if fmt == "csv":
        write_csv(whole, path)
    else:
        whole.write.mode("overwrite").json(path)


def write_id_list(ids: DataFrame, path: str) -> None:
    """Sorted ids, one per line, by split when there is one."""
    out = ids.withColumn("_n", video_number(F.col("video_id")))
    keys = ["split"] if "split" in ids.columns else []
    ordered = out.repartitionByRange(*[F.col(k) for k in keys], F.col("_n")).sortWithinPartitions(*keys, "_n")
    writer = ordered.select(*keys, F.col("video_id").alias("value")).write.mode("overwrite")
    (writer.partitionBy(*keys) if keys else writer).text(path)
