"""Exact dedup: group by a 128-bit content hash, compare bytes, keep one row."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "max") -> DataFrame:
    """One row per input row: id, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``.

    Rows are grouped on ``(md5(text), text)``: the hash deals the rows out, the
    text itself as second key compares bytes, so texts of one hash that differ
    stay apart. Every task first collapses its own copies, so a text that a third
    of all rows share reaches its group as one row per task. The answer goes back
    to the rows through an equi-join on two digests, which adaptive execution
    may split where a text is hot.

    * null text counts as the empty text; empty texts form one group.
    * ``keep`` is ``"max"`` or ``"min"``: the largest or smallest id stays. Null ids
      lose against all others; a group of only null ids keeps them all.
    * rows that repeat both id and text are the same document: all carry the
      same ``kept``.
    * an empty table gives an empty result; other columns are not read.
    """
    if keep not in ("max", "min"):
        raise ValueError("keep must be 'max' or 'min'")
    base = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    content_hash = F.unhex(F.md5(F.col("_text"))).alias("_hash")
    digest = F.unhex(F.sha2(F.col("_text"), 256)).alias("_digest")
    pick = F.max if keep == "max" else F.min
    groups = (
        base.groupBy(content_hash, "_text")
        .agg(pick("_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .select("_hash", digest, "keep_id", "group_size")
    )
    rows = base.select("_id", content_hash, digest)
    return rows.join(groups, ["_hash", "_digest"]).select(
        F.col("_id").alias(id_col),
        "keep_id",
        "group_size",
        F.col("_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("_digest")).alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "max") -> DataFrame:
    """The rows of ``docs`` that :func:`exact_dedup` keeps, with all their columns.

    Rows are told apart by id and text, so an id that comes with several texts, or no
    id at all, loses only the texts that are copies.
    """
    lost = exact_dedup(docs, id_col, text_col, keep).filter(~F.col("kept"))
    lost = lost.select(F.col(id_col).alias("_lost"), F.col("text_sha256").alias("_lost_text")).distinct()
    same = F.col(id_col).eqNullSafe(F.col("_lost")) & (F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256) == F.col("_lost_text"))
    return docs.join(lost, same, "left_anti")
