"""Within-group cosine similarity, reduced tile by tile.

The similarity matrix of a video is never stored. Vectors are cut into blocks;
one task works on one pair of blocks with a small matrix product and returns
one row per vector: sums, extremes and the k best values. A long video becomes
many tiles, so it spreads over the cluster, and results stay exact.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from framelark.functions.partitioned import block_of

TILE_ROWS = 1024


def similarity_tiles(
    frames: DataFrame, keys: list[str], index: str, vec: str, top_k: int = 0, rows: int = TILE_ROWS
) -> DataFrame:
    """Per vector and tile: count, sums, extremes and ``top_k`` of the cosines to the rest.

    Vectors must have unit length. Cosines are clipped to [-1, 1]; ``pos_sum``
    clips them to [0, 1] and also counts the vector itself.
    """
    slim = frames.select(*keys, F.col(index).cast("bigint").alias(index), F.col(vec).alias("vec"))
    slim = slim.withColumn("home", block_of(index, rows))
    span = slim.groupBy(*keys).agg(F.min("home").alias("lo_block"), F.max("home").alias("hi_block"))
    pairs = (
        slim.join(span, keys)
        .withColumn("other", F.explode(F.sequence("lo_block", "hi_block")))
        .select(
            *keys, index, "vec", "home",
            F.least("home", "other").alias("a"), F.greatest("home", "other").alias("b"),
        )
    )
    key_fields = [frames.schema[k] for k in keys]
    schema = StructType(
        [
            *key_fields,
            StructField(index, LongType()),
            StructField("others", LongType()),
            StructField("sim_sum", DoubleType()),
            StructField("pos_sum", DoubleType()),
            StructField("sim_max", DoubleType()),
            StructField("sim_min", DoubleType()),
            StructField("best", ArrayType(DoubleType())),
        ]
    )

    def one_tile(key, pdf):
        import numpy as np
        import pandas as pd

        lo, hi = key[-2], key[-1]
        same = lo == hi
        left = pdf[pdf["home"] == lo].sort_values(index)
        right = left if same else pdf[pdf["home"] == hi].sort_values(index)
        if len(left) == 0 or len(right) == 0:
            return pd.DataFrame()  # typed by the schema; empty lists would be numbers
        sims = np.clip(np.stack(left["vec"].to_list()) @ np.stack(right["vec"].to_list()).T, -1.0, 1.0)

        def side(part, m, own):
            n_self = 1 if own else 0
            count = m.shape[1] - n_self
            pos = np.clip(m, 0.0, 1.0).sum(axis=1)
            rest = m
            if own:
                rest = m[~np.eye(len(m), dtype=bool)].reshape(len(m), count)
            k = min(top_k, count)
            best = np.sort(np.partition(rest, count - k, axis=1)[:, count - k :], axis=1) if k else None
            return pd.DataFrame(
                {
                    **{f.name: key[i] for i, f in enumerate(key_fields)},
                    index: part[index].to_numpy(),
                    "others": count,
                    "sim_sum": rest.sum(axis=1),
                    "pos_sum": pos,
                    "sim_max": rest.max(axis=1) if count else np.nan,
                    "sim_min": rest.min(axis=1) if count else np.nan,
                    "best": list(best) if k else [[] for _ in range(len(part))],
                }
            )

        if same:
            return side(left, sims, True)
        return pd.concat([side(left, sims, False), side(right, sims.T, False)])

    return pairs.groupBy(*keys, "a", "b").applyInPandas(one_tile, schema)


def similarity_profile(frames: DataFrame, keys: list[str], index: str = "sample_index", vec: str = "fused") -> DataFrame:
    """Mean, maximum and minimum similarity of each vector to the others of its group."""
    tiles = similarity_tiles(frames, keys, index, vec)
    return tiles.groupBy(*keys, index).agg(
        F.sum("others").alias("others"),
        F.try_divide(F.sum("sim_sum"), F.sum("others")).alias("mean_sim"),
        F.max(F.when(F.col("others") > 0, F.col("sim_max"))).alias("max_sim"),
        F.min(F.when(F.col("others") > 0, F.col("sim_min"))).alias("min_sim"),
    )


def centrality(frames: DataFrame, keys: list[str], index: str = "sample_index", vec: str = "fused") -> DataFrame:
    """Mean of the similarities clipped to [0, 1], the vector itself included."""
    tiles = similarity_tiles(frames, keys, index, vec)
    return tiles.groupBy(*keys, index).agg(
        (F.sum("pos_sum") / (F.sum("others") + 1)).alias("centrality")
    )


def knn_rarity(frames: DataFrame, keys: list[str], k: int = 5, index: str = "sample_index", vec: str = "fused") -> DataFrame:
    """``1 - mean`` of the k highest similarities to other vectors; 0 when alone."""
    tiles = similarity_tiles(frames, keys, index, vec, top_k=k)
    ranked = W.partitionBy(*keys, index).orderBy(F.desc_nulls_last("s"))
    return (
        tiles.select(*keys, index, F.explode_outer("best").alias("s"))
        .withColumn("rk", F.row_number().over(ranked))
        .filter(F.col("rk") <= k)
        .groupBy(*keys, index)
        .agg(F.coalesce(F.lit(1.0) - F.avg("s"), F.lit(0.0)).alias("rarity"))
    )
