"""Scene boundaries from the normalised boundary score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from framelark.functions.partitioned import block_of, exact_percentiles, prefix_aggregate, with_neighbors
from framelark.functions.storage import write_through

KEY = "video_id"
_SPANS_PER_BLOCK = 256


def local_peaks(df: DataFrame, value: str = "boundary_score") -> DataFrame:
    """Interior rows with ``v >= prev`` and ``v > next``; with under 3 samples every row from 1 on."""
    near = with_neighbors(df, [KEY], "sample_index", [value])
    sizes = df.groupBy(KEY).agg(F.count(F.lit(1)).alias("_n"))
    v, prev, nxt = F.col(value), F.col(f"prev_{value}"), F.col(f"next_{value}")
    inner = prev.isNotNull() & nxt.isNotNull() & (v >= prev) & (v > nxt)
    peak = F.when(F.col("_n") < 3, F.col("sample_index") >= 1).otherwise(inner)
    return near.join(sizes, KEY).filter(peak).select(*df.columns)


def boundary_threshold(df: DataFrame, pct: float = 0.92, value: str = "boundary_score") -> DataFrame:
    """Percentile of the boundary score without sample 0; 1.0 for two samples or fewer."""
    tail = df.filter(F.col("sample_index") > 0)
    cut = exact_percentiles(tail, [KEY], {"_thr": (value, pct)})
    sizes = df.groupBy(KEY).agg(F.count(F.lit(1)).alias("samples"))
    thr = F.when(F.col("samples") > 2, F.col("_thr")).otherwise(F.lit(1.0))
    return sizes.join(cut, KEY, "left").select(KEY, "samples", thr.alias("threshold"))


def _accept(times: Column, start: Column, gap: float) -> Column:
    """Fold: keep each time at least ``gap`` after the last kept one."""

    def step(s, x):
        ok = x["t"] - s["last"] >= gap
        return F.struct(
            F.when(ok, x["t"]).otherwise(s["last"]).alias("last"),
            F.when(ok, F.concat(s["kept"], F.array(x["i"]))).otherwise(s["kept"]).alias("kept"),
        )

    zero = F.struct(start.cast("double").alias("last"), F.array().cast("array<int>").alias("kept"))
    return F.aggregate(times, zero, step)


def _last_accepted(times: Column, start: Column, gap: float) -> Column:
    return F.aggregate(
        times, start.cast("double"), lambda s, x: F.when(x["t"] - s >= gap, x["t"]).otherwise(s)
    )


def spaced_starts(cands: DataFrame, origin: DataFrame, gap: float) -> DataFrame:
    """Candidates kept greedily in time order, each ``gap`` after the last kept one.

    ``origin`` gives ``t0`` per video, the first kept time. The timeline is cut
    into blocks of 256 gaps. Only candidates in the last gap of a block can
    block the next one, so each block is folded once per such candidate, and a
    short chain over one row per block picks the true entry.
    """
    if gap <= 0:
        return cands.select(KEY, "sample_index")
    span = gap * _SPANS_PER_BLOCK
    timed = cands.join(origin, KEY).select(
        KEY, "t0", F.col("timestamp_sec").alias("t"), F.col("sample_index").cast("int").alias("i")
    )
    blocks = (
        timed.withColumn("block", F.floor((F.col("t") - F.col("t0")) / span).cast("bigint"))
        .groupBy(KEY, "block")
        .agg(F.max("t0").alias("t0"), F.array_sort(F.collect_list(F.struct("t", "i"))).alias("times"))
    )
    # One row per block from here on, so the per-video windows stay short.
    in_order = W.partitionBy(KEY).orderBy("block")
    prev_block, prev_times = F.lag("block").over(in_order), F.lag("times").over(in_order)
    border = F.col("t0") + F.col("block") * F.lit(span) - F.lit(gap)
    late = F.transform(F.filter("prev_times", lambda x: x["t"] > border), lambda x: x["t"])
    late = F.when(F.col("prev_block") == F.col("block") - 1, late).otherwise(F.array().cast("array<double>"))
    entries = F.when(F.col("block") == 0, F.array("t0")).otherwise(
        F.concat(late, F.array(F.lit(float("-inf"))))
    )
    linked = (
        blocks.withColumn("prev_block", prev_block)
        .withColumn("prev_times", prev_times)
        .withColumn("last_block", F.max("block").over(W.partitionBy(KEY)))
        .select(KEY, "block", "t0", "times", "last_block", entries.alias("entries"))
    )
    chained = linked.filter("last_block > 0").select(
        KEY,
        "block",
        "entries",
        F.transform("entries", lambda e: _last_accepted(F.col("times"), e, gap)).alias("exits"),
    )

    def chain(pdf):
        import pandas as pd

        pdf = pdf.sort_values("block")
        state, rows = None, []
        for video, block, entries, exits in zip(pdf["video_id"], pdf["block"], pdf["entries"], pdf["exits"]):
            known = dict(zip(entries, exits))
            entry = state if state in known else list(entries)[-1]
            rows.append((video, block, entry))
            state = known[entry]
        return pd.DataFrame(rows, columns=["video_id", "block", "entry"])

    entry = chained.groupBy(KEY).applyInPandas(chain, "video_id string, block bigint, entry double")
    kept = _accept(F.col("times"), F.coalesce("entry", "t0"), gap)["kept"]
    return linked.join(entry, [KEY, "block"], "left").select(KEY, F.explode(kept).alias("sample_index"))


def scene_starts(df: DataFrame, min_duration: float = 2.0, pct: float = 0.92, value: str = "boundary_score") -> DataFrame:
    """First sample of every coarse scene: sample 0 and spaced peaks over the threshold.

    The short table of starts is stored, since every use of it reads it several times.
    """
    slim = df.select(KEY, "sample_index", "timestamp_sec", value)
    strong = (
        local_peaks(slim, value)
        .join(boundary_threshold(slim, pct, value), KEY)
        .filter(F.col(value) >= F.col("threshold"))
    )
    origin = slim.groupBy(KEY).agg(F.min("timestamp_sec").alias("t0"))
    kept = spaced_starts(strong, origin, min_duration)
    return write_through(origin.select(KEY, F.lit(0).alias("sample_index")).unionByName(kept), "starts")


def assign_scenes(df: DataFrame, starts: DataFrame) -> DataFrame:
    """Number the scenes by a running count of starts."""
    flags = starts.select(KEY, "sample_index").withColumn("_start", F.lit(1))
    marked = df.join(flags, [KEY, "sample_index"], "left")
    numbered = prefix_aggregate(
        marked,
        [KEY],
        block_of("sample_index"),
        ["sample_index"],
        {"_scene": ("sum", F.coalesce("_start", F.lit(0)))},
    )
    return numbered.select(*df.columns, (F.col("_scene") - 1).cast("int").alias("scene_id"))


def scene_table(labelled: DataFrame) -> DataFrame:
    """One row per scene: half-open index range, times and size."""
    return labelled.groupBy(KEY, "scene_id").agg(
        F.min("sample_index").alias("start_idx"),
        (F.max("sample_index") + 1).alias("end_idx"),
        F.min("timestamp_sec").alias("start_sec"),
        F.max("timestamp_sec").alias("end_sec"),
        F.count(F.lit(1)).alias("frames"),
        (F.max("timestamp_sec") - F.min("timestamp_sec")).alias("duration"),
    )


def split_long_scenes(scenes: DataFrame, max_duration: float = 20.0) -> DataFrame:
    """Extra starts that cut scenes longer than ``max_duration`` into equal pieces."""
    size = F.col("end_idx") - F.col("start_idx")
    pieces = F.ceil(F.col("duration") / F.lit(max_duration)).cast("int")
    long = scenes.filter((size > 1) & (F.col("duration") > max_duration) & (pieces > 1))
    cut = F.col("start_idx") + F.bround(size * (F.col("piece") / F.col("pieces"))).cast("int")
    return (
        long.withColumn("pieces", pieces)
        .withColumn("piece", F.explode(F.expr("sequence(1, pieces - 1)")))
        .select(KEY, cut.cast("int").alias("sample_index"), "start_idx", "end_idx")
        .filter("sample_index > start_idx AND sample_index < end_idx")
        .select(KEY, "sample_index")
        .distinct()
    )


def detect_scenes(
    df: DataFrame, min_duration: float = 2.0, max_duration: float = 20.0, pct: float = 0.92, value: str = "boundary_score"
) -> DataFrame:
    """Frames with the ``scene_id`` of their final scene."""
    starts = scene_starts(df, min_duration, pct, value)
    coarse = scene_table(assign_scenes(df.select(KEY, "sample_index", "timestamp_sec"), starts))
    return assign_scenes(df, starts.unionByName(split_long_scenes(coarse, max_duration)))


def raw_budget(
    df: DataFrame,
    durations: DataFrame | None = None,
    final_budget: int = 40,
    adaptive: bool = True,
    duration_ref: float = 14.78,
    complexity_weight: float = 0.75,
    min_raw: int = 40,
    max_raw: int = 96,
    pct: float = 0.92,
    value: str = "boundary_score",
) -> DataFrame:
    """Number of raw key frames per video, with the factors behind it.

    A video without a duration keeps its row, with a null budget.
    """
    if adaptive and durations is None:
        raise ValueError("an adaptive budget needs durations")
    if not adaptive:
        sizes = df.groupBy(KEY).agg(F.count(F.lit(1)).alias("samples"))
        return sizes.select(
            KEY,
            F.lit(1.0).alias("duration_factor"),
            F.lit(1.0).alias("complexity_factor"),
            F.lit(0.0).alias("boundary_density"),
            F.least(F.lit(final_budget), F.col("samples")).cast("int").alias("raw_budget"),
        )
    slim = df.select(KEY, "sample_index", value)
    thr = boundary_threshold(slim, pct, value)
    over = F.when(F.col("sample_index") > 0, (F.col(value) >= F.col("threshold")).cast("double"))
    density = F.when(F.col("samples") > 2, F.col("hit")).otherwise(F.lit(0.0))
    stats = (
        slim.join(thr, KEY).groupBy(KEY, "samples").agg(F.avg(over).alias("hit"))
        .withColumn("boundary_density", density)
        .join(durations.select(KEY, "duration_sec"), KEY, "left")
        .withColumn("duration_factor", F.sqrt(F.greatest("duration_sec", F.lit(1e-6)) / max(duration_ref, 1e-6)))
        .withColumn("complexity_factor", 1.0 + complexity_weight * F.col("boundary_density"))
    )
    wanted = F.bround(final_budget * F.col("duration_factor") * F.col("complexity_factor"))
    floored = F.greatest(wanted, F.lit(float(max(final_budget, min_raw))))
    capped = F.least(floored, F.lit(float(max_raw)), F.col("samples").cast("double"))
    capped = F.when(F.col("duration_sec").isNotNull(), capped)
    return stats.select(
        KEY, "duration_factor", "complexity_factor", "boundary_density", capped.cast("int").alias("raw_budget")
    )
