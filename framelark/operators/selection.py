"""Choosing key frames: seeds, greedy coverage, quotas, compression, resampling."""

from __future__ import annotations

from dataclasses import dataclass
from itertools import count

from pyspark.sql import DataFrame, Window as W, functions as F
from pyspark.sql.types import DoubleType, IntegerType, StringType, StructField, StructType

from framelark.functions.storage import write_through
from framelark.operators.similarity import centrality

KEY = "video_id"
GROUP_ROWS = 2048
EVAL_ROWS = 512
NO_BUDGET = "no budget for this video"
BAD_VECTOR = "vectors missing or of different lengths"


@dataclass(frozen=True)
class GreedyWeights:
    """Weights of the greedy gain and the smallest gap in seconds."""

    coverage: float = 0.55
    scene_bonus: float = 0.15
    redundancy: float = 0.30
    min_gap: float = 1.0


@dataclass(frozen=True)
class CompressionWeights:
    """Weights of the scene score and of the frame score."""

    scene: float = 0.50
    duration: float = 0.20
    prompt: float = 0.30
    importance: float = 0.60
    centrality: float = 0.25
    boundary: float = 0.15


ABLATION_GREEDY = GreedyWeights(coverage=0.25, scene_bonus=0.08, redundancy=0.18)
ABLATION_COMPRESSION = CompressionWeights(scene=0.55, duration=0.25, prompt=0.20)


def scene_seeds(frames: DataFrame, budgets: DataFrame, max_budget: int | None = None) -> DataFrame:
    """Best frame of each of the strongest scenes, at most ``raw_budget`` per video (and ``max_budget``, if given)."""
    scored = (
        frames.select(KEY, "scene_id", "sample_index", "local_importance")
        .join(
            centrality(frames, [KEY, "scene_id"]).withColumn("sample_index", F.col("sample_index").cast("int")),
            [KEY, "scene_id", "sample_index"],
        )
        .withColumn("rep", 0.65 * F.col("local_importance") + 0.35 * F.col("centrality"))
    )
    scenes = scored.groupBy(KEY, "scene_id").agg(
        F.max_by("sample_index", F.struct("rep", -F.col("sample_index"))).alias("sample_index"),
        (
            F.avg("local_importance")
            + 0.35 * F.max("local_importance")
            + 0.05 * F.log1p(F.count(F.lit(1)).cast("double"))
        ).alias("strength"),
    )
    order = W.partitionBy(KEY).orderBy(F.desc("strength"), "scene_id")
    return (
        scenes.withColumn("seed_rank", F.row_number().over(order))
        .filter(F.lit(True) if max_budget is None else F.col("seed_rank") <= max_budget)
        .join(budgets.select(KEY, "raw_budget"), KEY)
        .filter("seed_rank <= raw_budget")
        .select(KEY, "scene_id", "sample_index", "strength", "seed_rank")
    )


_PICK_SCHEMA = StructType(
    [
        StructField(KEY, StringType()),
        StructField("sample_index", IntegerType()),
        StructField("selection_gain", DoubleType()),
        StructField("raw_selected_rank", IntegerType()),
        StructField("error", StringType()),
    ]
)


def greedy_select(
    frames: DataFrame,
    budgets: DataFrame,
    weights: GreedyWeights = GreedyWeights(),
    max_budget: int = 96,
    group_rows: int = GROUP_ROWS,
) -> DataFrame:
    """Coverage-aware greedy choice of ``raw_budget`` frames per video.

    Videos of up to ``group_rows`` frames are handled one per group. Longer ones
    are never put in one task: see ``_greedy_distributed``. Either way a video without a
    budget, or with a vector of another length or none, gives one row with ``error``.
    ``max_budget`` is the largest budget a caller expects; it limits neither path.
    """
    cols = [KEY, "sample_index", "timestamp_sec", "scene_id", "local_importance", "fused"]
    sized = frames.groupBy(KEY).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > group_rows)
    long_ids = write_through(sized, "long")
    work = frames.select(*cols)
    if long_ids.isEmpty():
        return _greedy_grouped(work, budgets, weights)
    picked = _greedy_grouped(work.join(long_ids, KEY, "left_anti"), budgets, weights)
    return picked.unionByName(_greedy_distributed(work.join(long_ids, KEY), budgets, weights, EVAL_ROWS))


def _greedy_grouped(frames: DataFrame, budgets: DataFrame, weights: GreedyWeights) -> DataFrame:
    names = _PICK_SCHEMA.fieldNames()
    # Plain numbers travel to the workers, so these need not import this package.
    no_budget, bad_vector = NO_BUDGET, BAD_VECTOR
    coverage, scene_bonus = weights.coverage, weights.scene_bonus
    redundancy, min_gap = weights.redundancy, weights.min_gap

    def choose(pdf):
        import heapq

        import numpy as np

        pdf = pdf.sort_values("sample_index")
        index = pdf["sample_index"].to_numpy()
        ts = pdf["timestamp_sec"].to_numpy()
        scene = pdf["scene_id"].to_numpy()
        gain0 = pdf["local_importance"].to_numpy()
        if np.isnan(float(np.float64(pdf["raw_budget"].iloc[0]))):
            raise ValueError(no_budget)
        if len({-1 if v is None else len(v) for v in pdf["fused"]}) > 1 or pdf["fused"].isna().any():
            raise ValueError(bad_vector)
        n, budget = len(pdf), int(min(pdf["raw_budget"].iloc[0], len(pdf)))
        x = np.stack(pdf["fused"].to_list())
        sim = np.clip(x @ x.T, 0.0, 1.0)

        seeds = []
        for label in np.unique(scene):
            rows = np.flatnonzero(scene == label)
            rep = 0.65 * gain0[rows] + 0.35 * sim[np.ix_(rows, rows)].mean(axis=1)
            strength = gain0[rows].mean() + 0.35 * gain0[rows].max() + 0.05 * np.log1p(len(rows))
            seeds.append((-strength, label, rows[rep.argmax()]))
        seeds.sort()

        cover, nearest = np.zeros(n), np.zeros(n)
        chosen, gains, seen = [], [], set()
        open_rows = np.ones(n, dtype=bool)

        def take(i, gain):
            np.maximum(cover, sim[:, i], out=cover)
            np.maximum(nearest, sim[:, i], out=nearest)
            open_rows[np.abs(ts - ts[i]) < min_gap] = False
            open_rows[i] = False
            seen.add(scene[i])
            chosen.append(i)
            gains.append(gain)

        def exact(i):
            extra = (np.maximum(cover, sim[:, i]).sum() - cover.sum()) / n
            bonus = 0.0 if scene[i] in seen else scene_bonus
            return gain0[i] + coverage * extra + bonus - redundancy * nearest[i]

        for _, _, i in seeds[:budget]:
            if open_rows[i]:
                take(i, gain0[i])

        # The gain of a frame never grows, so an old value is an upper bound and
        # only frames that reach the top of the heap are computed again.
        for gap_rule in (True, False):
            heap = [
                (-exact(i), i, len(chosen))
                for i in range(n)
                if (open_rows[i] if gap_rule else i not in set(chosen))
            ]
            heapq.heapify(heap)
            while heap and len(chosen) < budget:
                bound, i, stamp = heapq.heappop(heap)
                if gap_rule and not open_rows[i]:
                    continue
                if stamp == len(chosen):
                    take(i, -bound)
                else:
                    heapq.heappush(heap, (-exact(i), i, len(chosen)))

        ranks = np.empty(len(chosen), dtype="int32")
        ranks[np.argsort(ts[chosen], kind="stable")] = np.arange(1, len(chosen) + 1)
        return index[chosen], gains, ranks

    def run(pdf):
        import pandas as pd

        video = pdf["video_id"].iloc[0]
        try:
            index, gains, ranks = choose(pdf)
        except Exception as exc:
            return pd.DataFrame([(video, None, None, None, str(exc))], columns=names)
        out = pd.DataFrame({"sample_index": index, "selection_gain": gains, "raw_selected_rank": ranks})
        out["video_id"], out["error"] = video, None
        return out[names]

    with_budget = frames.join(budgets.select(KEY, "raw_budget"), KEY, "left")
    return with_budget.groupBy(KEY).applyInPandas(run, _PICK_SCHEMA)


def _greedy_distributed(
    frames: DataFrame, budgets: DataFrame, weights: GreedyWeights, eval_rows: int
) -> DataFrame:
    """The same choice for all long videos at once, their frames spread over all tasks.

    A round adds one frame to every video that still wants one, until none does, in a fixed number of
    jobs, so the number of jobs follows the budget and not the number of videos. The
    similarity sum of a frame bounds its coverage gain for good: a round ranks frames
    by that bound, computes exact gains of the ``eval_rows`` best per video
    as sums over blocks of frames, and goes on to the next ones only for videos where
    a bound still beats the best gain. State is a table of numbers per frame; vectors are
    stored once.
    """
    spark = frames.sparkSession
    sized = frames.join(budgets.select(KEY, "raw_budget"), KEY, "left")
    dims = sized.groupBy(KEY).agg(
        F.max("raw_budget").alias("budget"),
        (F.count_if(F.col("fused").isNull()) + F.max(F.size("fused")) - F.min(F.size("fused"))).alias("odd"),
    )
    problem = F.when(F.col("budget").isNull(), NO_BUDGET).when(F.col("odd") != 0, BAD_VECTOR)
    dims = write_through(dims.select(KEY, "budget", problem.alias("error")), "long-videos")
    failed = dims.filter("error IS NOT NULL").select(
        KEY, *[F.lit(None).cast(t).alias(c) for c, t in (("sample_index", "int"), ("selection_gain", "double"), ("raw_selected_rank", "int"))], "error"
    )
    good = write_through(frames.join(dims.filter("error IS NULL").select(KEY, "budget"), KEY), "long-good")
    center = centrality(good, [KEY]).withColumn("sample_index", F.col("sample_index").cast("int"))
    block = F.floor(F.col("sample_index") / BLOCK).cast("int")
    table = write_through(good.join(center, [KEY, "sample_index"]).withColumn("blk", block), "long-frames", [KEY, "blk"])
    plain = table.drop("fused")
    seeds = scene_seeds(table, budgets)
    seeds = seeds.join(plain.select(KEY, "sample_index", "timestamp_sec", "local_importance"), [KEY, "sample_index"])
    picks = write_through(seeds.groupBy(KEY).applyInPandas(_apart(weights.min_gap), PICKED), "seeds")
    state = plain.select(KEY, "sample_index", F.lit(0.0).alias("cover"))
    state = write_through(_covered(table, state, picks), "cover")
    for turn in count():
        wanting = dims.filter("error IS NULL").join(picks.groupBy(KEY).agg(F.count(F.lit(1)).alias("have")), KEY, "left")
        pool = _pool(plain, state, picks, wanting.filter("coalesce(have, 0) < budget").select(KEY), weights)
        pool = write_through(pool, "pool")
        if pool.isEmpty():
            break
        best, page, after = None, pool, None
        while True:
            top = _top(page, eval_rows)
            exact = write_through(_exact_gains(table, state, top, weights), "gains")
            best = exact if best is None else write_through(best.unionByName(exact), "gains")
            row = F.struct("gain", (-F.col("sample_index")).alias("i"))
            leader = best.groupBy(KEY).agg(F.max(row).alias("r")).select(KEY, F.col("r.gain").alias("gain"), (-F.col("r.i")).alias("sample_index"))
            leader = write_through(leader, "leader")
            last = exact.groupBy(KEY).agg(F.min(F.struct("bound", (-F.col("sample_index")).alias("i"))).alias("last"))
            rest = page.join(last, KEY).filter(F.struct("bound", (-F.col("sample_index")).alias("i")) < F.col("last")).drop("last")
            page = write_through(rest.join(leader.select(KEY, "gain"), KEY).filter("bound >= gain").drop("gain"), "page")
            if page.isEmpty():
                break
        new = leader.select(KEY, "sample_index", "gain", F.lit(AFTER_SEEDS + turn).alias("ord"))
        new = write_through(new, "new")
        state = write_through(_covered(table, state, new), "cover")
        picks = write_through(picks.unionByName(new), "picks")
    by_time = W.partitionBy(KEY).orderBy("timestamp_sec", "ord")
    return failed.unionByName(
        picks.join(plain.select(KEY, "sample_index", "timestamp_sec"), [KEY, "sample_index"]).select(
            KEY, "sample_index", F.col("gain").alias("selection_gain"), F.row_number().over(by_time).alias("raw_selected_rank"),
            F.lit(None).cast("string").alias("error"),
        )
    )


BLOCK = 1024
AFTER_SEEDS = 1 << 30
PICKED = f"{KEY} string, sample_index int, gain double, ord int"


def _apart(gap: float):
    """Seeds of one video (at most its budget) in order of rank, ``gap`` seconds apart."""

    def choose(pdf):
        kept, times = [], []
        for row in pdf.sort_values("seed_rank").itertuples():
            if all(abs(row.timestamp_sec - t) >= gap for t in times):
                kept.append((row.video_id, row.sample_index, row.local_importance, row.seed_rank))
                times.append(row.timestamp_sec)
        return type(pdf)(kept, columns=["video_id", "sample_index", "gain", "ord"])

    return choose


def _covered(table: DataFrame, state: DataFrame, picks: DataFrame) -> DataFrame:
    """``state`` after more picks: the highest similarity of each frame to any pick of its video.

    The picked vectors are sent once to every block of frames of their video.
    """
    vectors = picks.select(KEY, "sample_index").join(table.select(KEY, "sample_index", "fused"), [KEY, "sample_index"])
    touched = table.join(picks.select(KEY).distinct(), KEY, "left_semi").select(KEY, "sample_index", "blk", "fused")
    sent = vectors.select(KEY, "fused").join(table.select(KEY, "blk").distinct(), KEY)
    sent = sent.select(*[F.col(c).alias(c) for c in sent.columns])  # columns of its own: both sides come from one table

    def nearest(key, frames, picked):
        import numpy as np
        import pandas as pd

        if len(frames) == 0 or len(picked) == 0:
            return pd.DataFrame()  # typed by the schema; empty lists would be numbers
        x, new = np.stack(frames["fused"].to_list()), np.stack(picked["fused"].to_list()).T
        near = np.clip(x @ new, 0.0, 1.0).max(axis=1)
        return pd.DataFrame({"video_id": key[0], "sample_index": frames["sample_index"], "near": near})

    seen = touched.groupBy(KEY, "blk").cogroup(sent.groupBy(KEY, "blk")).applyInPandas(nearest, f"{KEY} string, sample_index int, near double")
    cover = F.greatest("cover", F.coalesce("near", F.lit(0.0))).alias("cover")
    return state.join(seen, [KEY, "sample_index"], "left").select(KEY, "sample_index", cover)


def _pool(plain: DataFrame, state: DataFrame, picks: DataFrame, wanting: DataFrame, weights: GreedyWeights) -> DataFrame:
    """Frames that may come next, with the known part of their gain and a bound of the whole.

    Frames near a pick come only where a video has no others.
    """
    known = plain.join(wanting, KEY).join(state, [KEY, "sample_index"])
    times = picks.join(plain.select(KEY, "sample_index", "timestamp_sec", "scene_id"), [KEY, "sample_index"])
    lists = times.groupBy(KEY).agg(
        F.collect_list("timestamp_sec").alias("times"), F.collect_set("scene_id").alias("seen"), F.collect_list("sample_index").alias("taken")
    )
    known = known.join(lists, KEY, "left").filter(~F.coalesce(F.array_contains("taken", F.col("sample_index")), F.lit(False)))
    far = F.coalesce(F.forall("times", lambda t: F.abs(F.col("timestamp_sec") - t) >= weights.min_gap), F.lit(True))
    known = known.withColumn("far", far)
    any_far = known.groupBy(KEY).agg(F.bool_or("far").alias("any_far"))
    bonus = F.when(F.coalesce(F.array_contains("seen", F.col("scene_id")), F.lit(False)), 0.0).otherwise(weights.scene_bonus)
    fixed = F.col("local_importance") + bonus - weights.redundancy * F.col("cover")
    # A small margin keeps the bound above rounding differences of the two sums.
    return (
        known.join(any_far, KEY).filter("far OR NOT any_far")
        .select(KEY, "sample_index", "blk", "n", fixed.alias("fixed"), "centrality")
        .withColumn("bound", F.col("fixed") + weights.coverage * F.col("centrality") + 1e-9).drop("centrality")
    )


def _top(pool: DataFrame, k: int) -> DataFrame:
    """The ``k`` best bounds of each video, first per block, so that no window sees a whole video."""
    order = [F.desc("bound"), F.col("sample_index")]
    head = pool.withColumn("rk", F.row_number().over(W.partitionBy(KEY, "blk").orderBy(*order))).filter(F.col("rk") <= k)
    return head.withColumn("rk", F.row_number().over(W.partitionBy(KEY).orderBy(*order))).filter(F.col("rk") <= k).drop("rk")


def _exact_gains(table: DataFrame, state: DataFrame, top: DataFrame, weights: GreedyWeights) -> DataFrame:
    """The gain of each candidate, its coverage summed over the blocks of its video."""
    blocks = table.select(KEY, "blk").distinct()
    cands = top.join(table.select(KEY, "sample_index", "fused"), [KEY, "sample_index"]).select(KEY, "sample_index", "fused")
    sent = cands.join(blocks, KEY)
    sent = sent.select(*[F.col(c).alias(c) for c in sent.columns])  # columns of its own: both sides come from one table

    def partial(key, frames, cand):
        import numpy as np
        import pandas as pd

        if len(frames) == 0 or len(cand) == 0:
            return pd.DataFrame()  # typed by the schema; empty lists would be numbers
        x, new = np.stack(frames["fused"].to_list()), np.stack(cand["fused"].to_list()).T
        cover = frames["cover"].to_numpy()[:, None]
        sums = (np.maximum(cover, np.clip(x @ new, 0.0, 1.0)) - cover).sum(axis=0)
        return pd.DataFrame({"video_id": key[0], "sample_index": cand["sample_index"], "part": sums})

    # Videos that have all their frames send no candidates.
    touched = table.join(top.select(KEY).distinct(), KEY, "left_semi")
    whole = touched.select(KEY, "sample_index", "blk", "fused").join(state, [KEY, "sample_index"])
    parts = whole.groupBy(KEY, "blk").cogroup(sent.groupBy(KEY, "blk")).applyInPandas(partial, f"{KEY} string, sample_index int, part double")
    sums = parts.groupBy(KEY, "sample_index").agg(F.sum("part").alias("extra"))
    gain = F.col("fixed") + weights.coverage * F.col("extra") / F.col("n")
    return top.join(sums, [KEY, "sample_index"]).select(KEY, "sample_index", "bound", gain.alias("gain"))


def scene_scores(frames: DataFrame, weights: CompressionWeights = CompressionWeights()) -> DataFrame:
    """Score of every scene from importance, share of time and prompt alignment."""
    span = F.when(F.count(F.lit(1)) > 1, F.max("timestamp_sec") - F.min("timestamp_sec")).otherwise(F.lit(1e-6))
    scenes = frames.groupBy(KEY, "scene_id").agg(
        span.alias("duration"),
        F.avg("local_importance").alias("mean_importance"),
        F.avg("prompt_alignment").alias("mean_prompt"),
    )
    totals = scenes.groupBy(KEY).agg(
        F.greatest(F.sum(F.greatest(F.lit(1e-6), F.col("duration"))), F.lit(1e-6)).alias("total")
    )
    score = (
        weights.scene * F.col("mean_importance")
        + weights.duration * F.col("duration") / F.col("total")
        + weights.prompt * F.col("mean_prompt")
    )
    return scenes.join(totals, KEY).select(KEY, "scene_id", score.alias("scene_score"))


def scene_quotas(scored: DataFrame, budget: str = "budget") -> DataFrame:
    """Seats per scene: one each, then by highest ``score / (seats + 0.5)``.

    Input rows are scenes with chosen frames: ``scene_score``, ``available`` and
    the budget column. Every scene has at least one chosen frame, so a video has
    at most as many rows, and as many seats, as chosen frames.
    """
    by_score = W.partitionBy(KEY).orderBy(F.desc("scene_score"), "scene_id")
    ranked = scored.withColumn("pos", F.row_number().over(by_score)).withColumn(
        "scenes", F.count(F.lit(1)).over(W.partitionBy(KEY))
    )
    seats = (
        ranked.filter((F.col("scenes") < F.col(budget)) & (F.col("available") > 1))
        .withColumn("seat", F.explode(F.expr("sequence(1, cast(available as int) - 1)")))
        .withColumn("gain", F.col("scene_score") / (F.col("seat") + 0.5))
    )
    by_gain = W.partitionBy(KEY).orderBy(F.desc("gain"), "pos", "seat")
    extra = (
        seats.withColumn("turn", F.row_number().over(by_gain))
        .filter(F.col("turn") <= F.col(budget) - F.col("scenes"))
        .groupBy(KEY, "scene_id")
        .agg(F.count(F.lit(1)).alias("extra"))
    )
    quota = F.when(F.col("pos") > F.col(budget), 0).otherwise(1 + F.coalesce("extra", F.lit(0)))
    return ranked.join(extra, [KEY, "scene_id"], "left").select(KEY, "scene_id", quota.cast("int").alias("quota"))


def compress_to_budget(
    raw: DataFrame, scores: DataFrame, final_budget: int, weights: CompressionWeights = CompressionWeights()
) -> DataFrame:
    """Cut the raw choice of each video to ``final_budget`` frames, ranked by time.

    ``raw`` is bounded per video by the raw budget.
    """
    video = W.partitionBy(KEY)
    sized = raw.withColumn("raw_count", F.count(F.lit(1)).over(video))
    small = sized.filter(F.col("raw_count") <= final_budget).withColumn("compression_score", F.col("local_importance"))
    large = sized.filter(F.col("raw_count") > final_budget)

    available = large.groupBy(KEY, "scene_id").agg(F.count(F.lit(1)).alias("available"))
    quotas = scene_quotas(
        available.join(scores, [KEY, "scene_id"]).withColumn("budget", F.lit(final_budget))
    )
    center = centrality(large, [KEY, "scene_id"]).withColumn("sample_index", F.col("sample_index").cast("int"))
    score = (
        weights.importance * F.col("local_importance")
        + weights.centrality * F.col("centrality")
        + weights.boundary * F.col("boundary_score")
    )
    in_scene = W.partitionBy(KEY, "scene_id").orderBy(F.desc("compression_score"), "sample_index")
    placed = (
        large.join(center, [KEY, "scene_id", "sample_index"])
        .withColumn("compression_score", score)
        .join(quotas, [KEY, "scene_id"])
        .withColumn("place", F.row_number().over(in_scene))
        .withColumn("spare", (F.col("place") > F.col("quota")).cast("int"))
    )
    # Frames within their quota come first, then the rest by score.
    order = video.orderBy("spare", F.when(F.col("spare") == 1, -F.col("compression_score")), "scene_id", "place")
    kept = (
        placed.withColumn("turn", F.row_number().over(order))
        .filter(F.col("turn") <= final_budget)
        .drop("centrality", "quota", "place", "spare", "turn")
    )
    by_time = video.orderBy("timestamp_sec", "sample_index")
    return small.unionByName(kept).withColumn("selected_rank", F.row_number().over(by_time)).drop("raw_count")


def histogram_topk(frames: DataFrame, n: int, gap: float) -> DataFrame:
    """Baseline: highest histogram change first, ``gap`` seconds apart, then filled up.

    A kept frame rules out only frames less than ``gap`` away, and those lie in
    three time buckets of that width. So the best ``n`` times that many frames
    decide the result, and the rank filter bounds each group without loss.
    """
    slim = frames.select(KEY, "sample_index", "timestamp_sec", "histogram_diff_raw", "quality_raw")
    if gap > 0:
        per_bucket = slim.groupBy(KEY, F.floor(F.col("timestamp_sec") / gap).alias("b")).agg(
            F.count(F.lit(1)).alias("c")
        )
        # The densest bucket of each video bounds its own list.
        slim = slim.join(per_bucket.groupBy(KEY).agg((3 * F.max("c")).alias("reach")), KEY)
    else:
        slim = slim.withColumn("reach", F.lit(1))
    best = W.partitionBy(KEY).orderBy(F.desc("histogram_diff_raw"), F.desc("quality_raw"), "sample_index")
    ranked = slim.withColumn("rk", F.row_number().over(best)).filter(F.col("rk") <= n * F.col("reach"))
    items = F.array_sort(
        F.collect_list(F.struct("rk", F.col("timestamp_sec").alias("t"), F.col("sample_index").alias("i")))
    )
    grouped = ranked.groupBy(KEY).agg(items.alias("items"))

    def step(kept, x):
        apart = F.forall(kept, lambda k: F.abs(x["t"] - k["t"]) >= gap)
        return F.when((F.size(kept) < n) & apart, F.concat(kept, F.array(x))).otherwise(kept)

    kept = F.aggregate("items", F.slice("items", 1, 0), step)
    rest = F.slice(F.array_except("items", "kept"), 1, n)
    fill = F.slice(F.concat("kept", rest), 1, n)
    picked = (
        grouped.withColumn("kept", kept).select(KEY, F.explode(fill).alias("x"))
        .select(KEY, F.col("x.i").alias("sample_index"), F.col("x.t").alias("timestamp_sec"))
    )
    by_time = W.partitionBy(KEY).orderBy("timestamp_sec", "sample_index")
    return picked.withColumn("selected_rank", F.row_number().over(by_time))


def gather_selected(frames: DataFrame, selected: DataFrame, vec: str = "fused") -> DataFrame:
    """Embeddings of the chosen frames with their rank in time order."""
    return frames.select(KEY, "sample_index", vec).join(
        selected.select(KEY, "sample_index", "timestamp_sec", "selected_rank"), [KEY, "sample_index"]
    )


def resample_embeddings(selected: DataFrame, target_len: int, vec: str = "fused") -> DataFrame:
    """Linear interpolation of each chosen sequence to ``target_len`` slots.

    Every frame emits the slots that fall between it and the next frame. Groups
    are bounded by the frame budget.
    """
    video = W.partitionBy(KEY)
    order = video.orderBy("timestamp_sec", "sample_index")
    base = (
        selected.select(KEY, "sample_index", "timestamp_sec", F.col(vec).alias("vec"))
        .withColumn("r", F.row_number().over(order) - 1)
        .withColumn("n", F.count(F.lit(1)).over(video))
        .withColumn("t0", F.min("timestamp_sec").over(video))
        .withColumn("t1", F.max("timestamp_sec").over(video))
    )
    span = F.col("t1") - F.col("t0")
    even = F.try_divide(F.col("r").cast("double"), F.col("n") - 1)
    src = F.when(span <= 1e-6, even).otherwise(F.try_divide(F.col("timestamp_sec") - F.col("t0"), span))
    moved = base.withColumn("src", src).withColumn("nsrc", F.lead("src").over(order)).withColumn(
        "nvec", F.lead("vec").over(order)
    )
    inner = F.filter(
        F.sequence(F.lit(0), F.lit(target_len - 1)),
        lambda s: (s > 0)
        & (s < target_len - 1)
        & (s / float(max(target_len - 1, 1)) >= F.col("src"))
        & ((s / float(max(target_len - 1, 1)) < F.col("nsrc")) | (F.col("r") == F.col("n") - 2)),
    )
    none = F.array().cast("array<int>")
    first = F.when(F.col("r") == 0, F.array(F.lit(0))).otherwise(none)
    last = F.when((F.col("r") == F.col("n") - 1), F.array(F.lit(target_len - 1))).otherwise(none)
    slots = (
        F.when(F.col("n") == target_len, F.array(F.col("r")))
        .when(F.lit(target_len == 1), F.when(F.col("r") == F.col("n") - 1, F.array(F.lit(0))).otherwise(none))
        .when(F.col("n") == 1, F.sequence(F.lit(0), F.lit(target_len - 1)))
        .when(F.col("r") == F.col("n") - 1, last)
        .otherwise(F.array_union(first, inner))
    )
    dst = F.col("slot") / float(max(target_len - 1, 1))
    alpha = (dst - F.col("src")) / F.greatest(F.col("nsrc") - F.col("src"), F.lit(1e-6))
    exact = (
        (F.col("n") == target_len) | (F.col("n") == 1) | (F.col("slot") == 0) | (F.col("slot") == target_len - 1)
    )
    return (
        moved.withColumn("slot", F.explode(slots))
        .withColumn("alpha", alpha)
        .select(
            KEY,
            "slot",
            F.when(exact, F.col("vec"))
            .otherwise(F.zip_with("vec", "nvec", lambda a, b: a * (1.0 - F.col("alpha")) + b * F.col("alpha")))
            .alias("vec"),
        )
    )
