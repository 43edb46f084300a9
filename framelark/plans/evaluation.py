"""Whole evaluations: all metrics per video, per corpus and per category."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, Window as W, functions as F

from framelark.functions.storage import write_through
from framelark.operators import caption_metrics as m
from framelark.operators.splits import category_map, train_length_by_category

KEY = "video_id"
_MEANS = ["meteor", "rouge_l", "cider"]


def _stored(pred: DataFrame, refs: DataFrame, by: list[str]) -> tuple[DataFrame, DataFrame]:
    """Tokens of the scored captions, stored once: many branches read each table."""
    p, r = m.scored_pairs(pred.select(*by, KEY, "caption"), refs.select(*by, KEY, "cap_id", "caption"), by)
    p, r = m.with_group_size(m.with_tokens(p), m.with_tokens(r), by)
    return write_through(p, "pred", compression="zstd"), write_through(r, "refs", compression="zstd")


def score_per_video(pred: DataFrame, refs: DataFrame, by: list[str] | None = None) -> DataFrame:
    """The seven metrics of every scored video, keyed by ``by`` and ``video_id``."""
    by, ids = by or [], m.video_keys(by)
    p, r = _stored(pred, refs, by)
    return (
        m.cider_per_video(p, r, by).join(m.bleu_per_video(p, r, by=by), ids)
        .join(m.meteor(p, r, by), ids).join(m.rouge_l(p, r, by), ids)
    )


def score_captions(pred: DataFrame, refs: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Corpus metrics per group, with the number of videos."""
    by, ids = by or [], m.video_keys(by)
    p, r = _stored(pred, refs, by)
    single = m.cider_per_video(p, r, by).join(m.meteor(p, r, by), ids).join(m.rouge_l(p, r, by), ids)
    means = single.groupBy(*by).agg(
        F.count(F.lit(1)).alias("num_videos"), *[F.avg(c).alias(c) for c in _MEANS]
    )
    bleu = m.bleu_corpus(p, r, by)
    if by:
        return means.join(bleu, by)
    # One row on either side.
    return means.withColumn("_one", F.lit(1)).join(bleu.withColumn("_one", F.lit(1)), "_one").drop("_one")


def score_by_category(pred: DataFrame, refs: DataFrame, train_videos: DataFrame | None = None) -> DataFrame:
    """Metrics inside every category, with training clip lengths beside them.

    Document frequencies and N are taken inside the category.
    """
    rows = score_captions(pred, refs, ["category"])
    if train_videos is None:
        return rows
    return rows.join(train_length_by_category(train_videos), "category", "left")


def score_grouping_sets(pred: DataFrame, refs: DataFrame, sets: list[list[str]]) -> DataFrame:
    """Corpus metrics for several groupings at once: ``grouping_set``, its columns, ``num_videos`` and the metrics.

    Both tables carry all grouping columns; a video is its id and their values, so one id may come
    in several splits or epochs. A column that a set leaves out is null in its rows; a set leaves
    out videos that are null in one of its columns. METEOR, ROUGE-L and the parts of BLEU are found once per
    video and added up for every set. Only CIDEr depends on the set: its document frequencies
    and N are taken inside each group, for all sets at once.
    """
    columns = list(dict.fromkeys(c for names in sets for c in names))
    cell = F.to_json(F.struct(F.lit(0).alias("_"), *columns))
    named = F.concat(cell, F.lit("#"), F.col(KEY)).alias(KEY)
    p, r = m.scored_pairs(
        pred.select(cell.alias("cell"), *columns, named, "caption"), refs.select(cell.alias("cell"), named, "cap_id", "caption")
    )
    p, r = [write_through(m.with_tokens(x), name, compression="zstd") for x, name in ((p, "pred"), (r, "refs"))]

    # A cell holds the videos with equal values in all columns; each set puts it into one group, or none.
    cells = p.groupBy("cell", *columns).agg(F.count(F.lit(1)).alias("videos"))
    for i, names in enumerate(sets):
        known = reduce(and_, [F.col(c).isNotNull() for c in names], F.lit(True))
        cells = cells.withColumn(f"grp_{i}", F.when(known, F.to_json(F.struct(F.lit(i).alias("_"), *names))))
    for i in range(len(sets)):
        cells = cells.withColumn(f"size_{i}", F.sum("videos").over(W.partitionBy(f"grp_{i}")))
    cells = write_through(cells, "cells")
    # Captions meet once; all metrics start from the stored pairs.
    numbers = [F.when(F.col(f"grp_{i}").isNotNull(), F.xxhash64(f"grp_{i}")).alias(f"number_{i}") for i in range(len(sets))]
    sizes = [f"size_{i}" for i in range(len(sets))]
    spoken = p.select(KEY, "cell", "tokens").join(cells.select("cell", *numbers, *sizes), "cell").drop("cell")
    grp, videos = F.array(*[f"number_{i}" for i in range(len(sets))]), F.array(*sizes)
    packed = m.pack_pairs(m.token_pairs(spoken, r.select(KEY, "cap_id", "tokens"), [KEY], grp, videos), [KEY])
    pairs = m.packed_pairs(packed)
    cider = m.cider_of_pairs(packed, [KEY], len(sets))
    parts = m.bleu_components(p, r, pairs=pairs).join(m.meteor(p, r, pairs=pairs), KEY).join(m.rouge_l(p, r, pairs=pairs), KEY)
    single = parts.join(cider, KEY).join(p.select(KEY, "cell"), KEY)
    # First one row per cell, then those of each group.
    sums = single.groupBy("cell").agg(
        F.count(F.lit(1)).alias("num_videos"), *[F.sum(c).alias(c) for c in ("meteor", "rouge_l", *m.BLEU_PARTS)],
        *[F.sum(f"cider_{i}").alias(f"cider_{i}") for i in range(len(sets))],
    )
    member = [
        F.when(
            F.col(f"grp_{i}").isNotNull(),
            F.struct(
                F.lit(i).alias("grouping_set"), F.col(f"grp_{i}").alias("grp"), F.col(f"cider_{i}").alias("cider"),
                *[(F.col(c) if c in names else F.lit(None).cast(pred.schema[c].dataType)).alias(c) for c in columns],
            ),
        )
        for i, names in enumerate(sets)
    ]
    added = ["num_videos", "meteor", "rouge_l", *m.BLEU_PARTS]
    rows = sums.join(cells, "cell").select(*added, F.explode(F.array_compact(F.array(*member))).alias("g")).select(*added, "g.*")
    totals = rows.groupBy("grouping_set", "grp", *columns).agg(*[F.sum(c).alias(c) for c in (*added, "cider")])
    means = [(F.col(c) / F.col("num_videos")).alias(c) for c in _MEANS]
    return totals.select("grouping_set", *columns, "num_videos", *means, *m.bleu_of_totals())


def category_report(pred: DataFrame, refs: DataFrame, videos: DataFrame, order: str = "id") -> DataFrame:
    """The whole category evaluation: one row per category and one for all, ``category`` null.

    The category of a video comes from the metadata; only ids that have a prediction,
    references and a category count. Training clip lengths stand beside each category.
    """
    valid = write_through(m.valid_ids(pred, refs, category_map(videos, order)).distinct(), "valid")
    p, r = pred.select(KEY, "caption").join(valid, KEY), refs.select(KEY, "cap_id", "caption").join(valid, KEY)
    rows = score_grouping_sets(p, r, [["category"], []]).drop("grouping_set")
    return rows.join(train_length_by_category(videos), "category", "left")
