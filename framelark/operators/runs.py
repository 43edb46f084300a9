"""Training logs: losses, best epochs, run rankings."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from framelark.functions.partitioned import block_of, prefix_aggregate

# Columns of the run summary.
SUMMARY_COLUMNS = {
    "experiment": "string",
    "dataset_mode": "string",
    "selector": "string",
    "modalities": "string",
    "freeze_decoder": "boolean",
    "Bleu_4": "double",
    "CIDEr": "double",
    "ROUGE_L": "double",
    "METEOR": "double",
    "best_epoch": "int",
    "best_val_loss": "double",
    "run_dir": "string",
}
METRIC_COLUMNS = ["Bleu_4", "CIDEr", "ROUGE_L", "METEOR"]


def epoch_loss(batch_log: DataFrame) -> DataFrame:
    return batch_log.groupBy("run_id", "epoch").agg(
        F.avg("loss").alias("loss"), F.count(F.lit(1)).alias("batches")
    )


def checkpoint_flags(history: DataFrame) -> DataFrame:
    """Epochs that beat every earlier one: lower loss, higher CIDEr. A missing value beats nothing."""
    before = prefix_aggregate(
        history,
        ["run_id"],
        block_of("epoch"),
        ["epoch"],
        {"_low": ("min", F.col("val_loss")), "_high": ("max", F.col("val_cider"))},
        inclusive=False,
    )

    def beats(value, earlier, better):
        return value.isNotNull() & (earlier.isNull() | better)

    return before.select(
        *history.columns,
        beats(F.col("val_loss"), F.col("_low"), F.col("val_loss") < F.col("_low")).alias("best_loss"),
        beats(F.col("val_cider"), F.col("_high"), F.col("val_cider") > F.col("_high")).alias("best_cider"),
    )


def best_epoch(history: DataFrame) -> DataFrame:
    """First epoch with the lowest loss, and with the highest CIDEr; missing values lose."""
    loss, cider = F.col("val_loss"), F.col("val_cider")
    return history.groupBy("run_id").agg(
        F.min_by("epoch", F.when(loss.isNotNull(), F.struct("val_loss", "epoch"))).alias("loss_epoch"),
        F.min("val_loss").alias("best_val_loss"),
        F.min_by("epoch", F.when(cider.isNotNull(), F.struct(-cider, "epoch"))).alias("cider_epoch"),
        F.max("val_cider").alias("best_val_cider"),
    )


def periodic(history: DataFrame, n: int = 10) -> DataFrame:
    return history.filter(F.col("epoch") % n == 0)


def best_run(summary: DataFrame, by: list[str], order: str = "ord") -> DataFrame:
    """Best CIDEr per group (missing counts as -1); the first run wins ties."""
    score = F.coalesce("cider", F.lit(-1.0))
    row = F.struct(*[c for c in summary.columns if c not in by])
    best = F.min_by(row, F.struct((-score).alias("s"), F.col(order).alias("o")))
    return summary.groupBy(*by).agg(best.alias("r")).select(*by, "r.*")


def ablation_summary(parts: list[DataFrame]) -> DataFrame:
    """Runs of all parts in fixed columns; missing metrics are 0, other gaps NULL."""
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p, allowMissingColumns=True)
    have = set(whole.columns)
    cols = []
    for name, kind in SUMMARY_COLUMNS.items():
        col = (F.col(name) if name in have else F.lit(None)).cast(kind)
        cols.append((F.coalesce(col, F.lit(0.0)) if name in METRIC_COLUMNS else col).alias(name))
    return whole.select(*cols)


def rank_runs(runs: DataFrame, order: str = "ord") -> DataFrame:
    """Runs by CIDEr, missing last, first run first on ties."""
    return runs.orderBy(F.desc_nulls_last("cider"), order)


def compare_runs(a: DataFrame, b: DataFrame, key: str = "run_id") -> DataFrame:
    """Winner and gap of two tables of best scores; a tie goes to the second."""
    left = a.select(key, F.col("cider").alias("cider_a"))
    right = b.select(key, F.col("cider").alias("cider_b"))
    return left.join(right, key).select(
        key,
        "cider_a",
        "cider_b",
        F.when(F.col("cider_a") > F.col("cider_b"), "a").otherwise("b").alias("winner"),
        F.abs(F.col("cider_a") - F.col("cider_b")).alias("gap"),
    )
