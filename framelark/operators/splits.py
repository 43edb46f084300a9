"""Video metadata: splits, file resolution, counts and frame sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from framelark.functions.partitioned import dense_index
from framelark.functions.text import video_number

KEY = "video_id"
# The split names.
SPLITS = ["train", "val", "test"]
ID_BLOCK = 65536


def canonical_splits(videos: DataFrame) -> DataFrame:
    """``validate`` becomes ``val``; rows of other splits are dropped."""
    split = F.when(F.col("split") == "validate", "val").otherwise(F.col("split"))
    return videos.withColumn("split", split).filter(F.col("split").isin(SPLITS))


def split_names(df: DataFrame) -> DataFrame:
    return df.sparkSession.range(1).select(F.explode(F.array(*[F.lit(s) for s in SPLITS])).alias("split"))


def split_positions(videos: DataFrame) -> DataFrame:
    """Ids of each split in numeric order, numbered from 0."""
    ids = canonical_splits(videos).select("split", KEY).withColumn("number", video_number(F.col(KEY)))
    return dense_index(ids, ["split"], F.floor(F.col("number") / ID_BLOCK), ["number", KEY], "position")


def filter_requested(df: DataFrame, requested: DataFrame) -> DataFrame:
    """Rows whose id is asked for, by ``video_id`` or else by numeric ``id``."""
    wanted = requested.select(F.coalesce(F.col(KEY), F.concat(F.lit("video"), F.col("id").cast("string"))).alias(KEY))
    return df.join(wanted, KEY, "left_semi")


def resolve_splits(videos: DataFrame, files: DataFrame, strict: bool = False) -> DataFrame:
    """Path of every split id; NULL when no file exists. ``strict`` raises on any absent file."""
    found = files.select(KEY, "path")
    out = split_positions(videos).join(found, KEY, "left").select("split", KEY, "position", "path")
    if strict:
        absent = out.filter("path IS NULL").groupBy("split").count().orderBy("split").collect()
        if absent:
            raise FileNotFoundError("missing videos: " + ", ".join(f"{r[0]}={r[1]}" for r in absent))
    return out


def resolution_report(resolved: DataFrame) -> DataFrame:
    return resolved.groupBy("split").agg(
        F.count("path").alias("present"), F.count_if(F.col("path").isNull()).alias("absent")
    )


def split_counts(videos: DataFrame) -> DataFrame:
    counts = canonical_splits(videos).groupBy("split").agg(F.count(F.lit(1)).alias("n"))
    return split_names(videos).join(counts, "split", "left").select("split", F.coalesce("n", F.lit(0)).alias("n"))


def category_map(videos: DataFrame, order: str = "id") -> DataFrame:
    """Category of each test video; the row that comes last by ``order`` wins.

    With repeated ids ``order`` must be the place in the file.
    """
    test = videos.filter("split = 'test'")
    return test.groupBy(KEY).agg(F.max_by("category", order).cast("int").alias("category"))


def train_length_by_category(videos: DataFrame) -> DataFrame:
    return (
        videos.filter("split = 'train'")
        .groupBy("category")
        .agg(
            F.count(F.lit(1)).alias("num_train_videos"),
            F.avg(F.col("end_time") - F.col("start_time")).alias("avg_train_duration_sec"),
        )
    )


def limit_per_split(videos: DataFrame, n: int) -> DataFrame:
    """First ``n`` ids of every split in numeric order."""
    ids = canonical_splits(videos).select("split", KEY)
    order = W.partitionBy("split").orderBy(video_number(F.col(KEY)), KEY)
    return ids.withColumn("position", F.row_number().over(order)).filter(F.col("position") <= n)


def range_coverage(files: DataFrame, lo: int, hi: int) -> DataFrame:
    """Ids in ``lo..hi`` without a file; a ``" 2"`` copy suffix is ignored."""
    have = files.select(F.replace(F.col(KEY), F.lit(" 2"), F.lit("")).alias(KEY))
    ids = files.sparkSession.range(lo, hi + 1).select(F.concat(F.lit("video"), F.col("id").cast("string")).alias(KEY))
    return ids.join(have, KEY, "left_anti")


def video_header(df: DataFrame, sample_fps: float) -> DataFrame:
    """Frame rate with default, duration, and sampling stride."""
    fps = F.when(F.col("native_fps") <= 0.0, F.lit(max(sample_fps, 1.0))).otherwise(F.col("native_fps"))
    with_fps = df.withColumn("fps", fps)
    return with_fps.withColumn(
        "duration_sec", F.when(F.col("total_frames") > 0, F.col("total_frames") / F.col("fps")).otherwise(0.0)
    ).withColumn("stride", F.greatest(F.lit(1), F.bround(F.col("fps") / max(sample_fps, 1e-6)).cast("int")))


def sample_frames(frames: DataFrame, header: DataFrame, max_samples: int | None = None) -> DataFrame:
    """Every ``stride``-th frame with its sample number and time.

    Sample numbers count the frames kept, so they have no holes where frames are absent. A frame that is
    listed twice is one sample. The frames kept travel as masks of 64 bits, so no
    frame is sorted; columns beside the frame number come back by a join.
    """
    # One row of the header per video, held in memory: a sort-merge join would sort all frames.
    known = header.select(KEY, "stride", "fps").hint("shuffle_hash")
    rows = frames.select(KEY, "frame_index").join(known, KEY).filter(F.col("frame_index") % F.col("stride") == 0)
    masks = rows.select(KEY, "stride", "fps", F.expr("frame_index div stride").alias("place")).groupBy(
        KEY, "stride", "fps", F.shiftright("place", 6).alias("word")
    ).agg(F.bit_or(F.expr("shiftleft(1L, cast(place & 63 AS INT))")).alias("mask"))
    # The window sees one row per 64 frames kept, already in place.
    earlier = W.partitionBy(KEY).orderBy("word").rowsBetween(W.unboundedPreceding, -1)
    numbered = masks.withColumn("before", F.coalesce(F.sum(F.bit_count("mask")).over(earlier), F.lit(0)))
    bit = F.explode(F.sequence(F.lit(0), F.lit(63)))
    out = (
        numbered.select("*", bit.alias("bit"))
        .filter("shiftright(mask, bit) & 1 = 1")
        .withColumn("sample_index", (F.col("before") + F.expr("bit_count(mask & ~shiftleft(-1L, bit))")).cast("int"))
        .withColumn("frame_index", ((F.col("word") * 64 + F.col("bit")) * F.col("stride")).cast(frames.schema["frame_index"].dataType))
        .withColumn("timestamp_sec", F.col("frame_index") / F.col("fps"))
    )
    if max_samples is not None:
        out = out.filter(F.col("sample_index") < max_samples)
    if len(frames.columns) > 2:
        out = frames.join(out, [KEY, "frame_index"])
    return out.select(*frames.columns, "stride", "fps", "sample_index", "timestamp_sec")


def evenly_spaced(count: Column, target: int) -> Column:
    """``target`` indices spread over ``0..count-1``, ascending."""
    if target <= 0:
        return F.array().cast("array<int>")
    step = (count - 1) / F.lit(float(max(target - 1, 1)))
    ticks = F.sequence(F.lit(0), F.lit(target - 1))
    picks = F.array_distinct(F.transform(ticks, lambda i: F.bround(i * step).cast("int")))
    # Unused low numbers fill gaps left by equal picks.
    filled = F.slice(F.concat(picks, F.array_except(ticks, picks)), 1, target)
    empty = F.array().cast("array<int>")
    return (
        F.when(count <= 0, empty)
        .when(count <= target, F.sequence(F.lit(0), F.greatest(count - 1, F.lit(0)).cast("int")))
        .otherwise(F.array_sort(filled))
    )
