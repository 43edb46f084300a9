"""Line dedup: a suffix array of line runs by prefix doubling; later copies of maximal repeated runs go."""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from framelark.functions.storage import write_through
from framelark.llm.lean import lean_map


def _ranked(groups: DataFrame, order: list[str]) -> DataFrame:
    """Give each row a number that grows along ``order`` over the whole table (not dense)."""
    return groups.orderBy(*order).withColumn("rank", F.monotonically_increasing_id())


def _repeated(runs: DataFrame, order: list[str], name: str, carry: tuple[str, ...] = ()) -> DataFrame:
    """``(doc, row, at, rank, first_doc, first_row, first_at)`` and ``carry`` of the runs that occur at two places or more.

    Equal runs share a rank, and ranks are in the order of the runs: a slice of the
    suffix array of line ids. ``first`` is the earliest place.
    """
    groups = (
        runs.groupBy(*order)
        .agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc", "at", "row")).alias("first"))
        .filter("n > 1")
    )
    groups = write_through(_ranked(groups.drop("n"), order), f"{name}-ranks")
    first = [F.col(f"first.{c}").alias(f"first_{c}") for c in ("doc", "row", "at")]
    return write_through(runs.join(groups, order).select("doc", "row", "at", "rank", *first, *carry).distinct(), name)


def literal(separator: str) -> str:
    """A regular expression for just this string."""
    if not separator:
        raise ValueError("the separator is empty")
    return "".join(f"\\x{{{ord(c):x}}}" for c in separator)


def repeated_lines(docs: DataFrame, id_col: str, text_col: str, separator: str) -> DataFrame:
    """Places of the lines that occur twice or more, with their ``size`` in bytes."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    single = (
        docs.select(
            F.col(id_col).cast("bigint").alias("doc"),
            F.xxhash64(text).alias("row"),
            F.posexplode(F.split(text, literal(separator), -1)).alias("at", "line"),
        )
        .filter("doc IS NOT NULL")
        .select(
            "doc", "row", F.col("at").cast("bigint").alias("at"),
            F.xxhash64("line").alias("r1"), F.crc32(F.encode("line", "utf-8")).alias("r2"), F.octet_length("line").alias("size"),
        )
    )
    return _repeated(single, ["r1", "r2"], "lines", ("size",))


def line_ranks(lines: DataFrame, least: int) -> list[tuple[int, DataFrame]]:
    """``(length, places)`` of the repeated runs of every length that prefix doubling passes.

    A round ranks the runs of twice the length by the pair of ranks of their halves. Only
    runs that repeat go on (a run can repeat only if both halves do), until none is
    left. ``least`` is one of the lengths: two overlapping runs of a power of two are
    joined to it, and doubling goes on from there. ``lines`` are the repeated single lines.
    """
    level, size = lines.drop("size"), 1
    levels = [(size, level)]
    while size < least or not level.isEmpty():
        step = min(size, least - size) if size < least else size
        right = level.select("doc", "row", (F.col("at") - step).alias("at"), F.col("rank").alias("r2"))
        pairs = level.select("doc", "row", "at", F.col("rank").alias("r1")).join(right, ["doc", "row", "at"])
        level, size = _repeated(pairs, ["r1", "r2"], f"runs{size + step}"), size + step
        levels.append((size, level))
    return levels


def _earlier() -> Column:
    before = F.col("first_doc") < F.col("doc")
    return before | ((F.col("first_doc") == F.col("doc")) & (F.col("first_at") < F.col("at")))


def common_prefixes(levels: list[tuple[int, DataFrame]], least: int) -> DataFrame:
    """``(doc, row, at, lines)``: how many lines each later copy shares with its source.

    The source is the earliest place of the longest ranked run that starts at the place and
    has a copy further up. From there on the common prefix is read off the ranks, longest
    first: where both sides have the same rank, that many lines more agree. A place is one
    row per round, however many copies its run has.
    """
    later = [
        df.filter(_earlier()).select(
            "doc", "row", "at", F.struct(F.lit(n).cast("bigint").alias("n"), "first_doc", "first_row", "first_at").alias("s")
        )
        for n, df in levels if n >= least
    ]
    found = reduce(DataFrame.unionByName, later).groupBy("doc", "row", "at").agg(F.max("s").alias("s"))
    found = found.select("doc", "row", "at", F.col("s.n").alias("top"), "s.first_doc", "s.first_row", "s.first_at", F.col("s.n").alias("lines"))
    found = write_through(found, "later")
    for k, (n, df) in enumerate(reversed(levels[:-1])):
        ranks = df.select("doc", "row", "at", "rank")
        mine = ranks.select("doc", "row", F.col("at").alias("next"), F.col("rank").alias("mine"))
        source = ranks.toDF("first_doc", "first_row", "next_first", "other")
        found = (
            found.withColumn("next", F.when(F.col("top") > n, F.col("at") + F.col("lines")))
            .withColumn("next_first", F.when(F.col("top") > n, F.col("first_at") + F.col("lines")))
            .join(mine, ["doc", "row", "next"], "left").join(source, ["first_doc", "first_row", "next_first"], "left")
            .withColumn("lines", F.col("lines") + F.when(F.col("mine") == F.col("other"), n).otherwise(0))
            .drop("next", "next_first", "mine", "other")
        )
        if k % 4 == 3:
            found = write_through(found, "prefixes")
    return found.select("doc", "row", "at", "lines")


def short_copies(docs: DataFrame, id_col: str, text_col: str, separator: str, length: int) -> DataFrame:
    """``(doc, row, at, lines)`` of whole texts of fewer than ``length`` lines, not empty, that a smaller id has too."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    short = (
        docs.select(
            F.col(id_col).cast("bigint").alias("doc"), F.xxhash64(text).alias("row"),
            F.crc32(F.encode(text, "utf-8")).alias("r2"), F.size(F.split(text, literal(separator), -1)).alias("lines"), (text == "").alias("empty"),
        )
        .filter((F.col("lines") < length) & ~F.col("empty") & F.col("doc").isNotNull())
        .drop("empty")
    )
    short = write_through(short.distinct(), "short")
    groups = short.groupBy("row", "r2").agg(F.count(F.lit(1)).alias("n"), F.min("doc").alias("first")).filter("n > 1")
    later = short.join(groups, ["row", "r2"]).filter(F.col("first") < F.col("doc"))
    return later.select("doc", "row", F.lit(0).cast("bigint").alias("at"), "lines")


RESULT = "_id bigint, n_lines bigint, n_removed bigint, n_spans bigint, longest bigint, kept_sha256 string, kept string"


def line_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_lines: int = 2, separator: str = "\n",
    long_bytes: int | None = None, whole_copies: bool = False,
) -> DataFrame:
    """Delete each line covered by a run of ``min_lines`` lines or more that also starts earlier.

    With ``long_bytes`` a single line of that many bytes or more is such a run by itself, and
    with ``whole_copies`` so is the whole text of a document of fewer than ``min_lines`` lines
    that a document with a smaller id has as its whole text. Earlier: in a document with a
    smaller id, or further up in the same one, where the two may overlap (of ``a, a, a``
    the first line stays). Places of equal rank are the intervals of the suffix array; the
    common prefix of a later copy with its source (:func:`common_prefixes`) is its repeated run.
    Returns per row: id, ``n_lines``, ``n_removed``, ``n_spans`` (deleted runs that lie in no
    other; they may touch or overlap), ``longest`` (lines of the longest), ``kept_sha256``
    and ``kept`` (the remaining lines, joined again).

    * lines are compared by 96 bits of hash; ``separator`` is any string but the empty one, taken literally.
    * null text counts as the empty text, which is one empty line; without ``long_bytes`` and
      ``whole_copies``, texts of fewer than ``min_lines`` lines keep everything.
    * rows with null id neither delete nor lose anything.
    * rows that repeat an id are one document whose rows number their lines alike:
      equal rows delete nothing from each other.
    * an empty table gives an empty result; other columns are not read.
    """
    single = repeated_lines(docs, id_col, text_col, separator)
    spans = common_prefixes(line_ranks(single, min_lines), min_lines)
    if long_bytes is not None:
        long = single.filter(_earlier() & (F.col("size") >= long_bytes))
        spans = spans.unionByName(long.select("doc", "row", "at", F.lit(1).cast("bigint").alias("lines")))
    if whole_copies:
        spans = spans.unionByName(short_copies(docs, id_col, text_col, separator, min_lines))
    starts = spans.groupBy("doc", "row").agg(F.collect_list(F.struct("at", "lines")).alias("starts"))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("bigint").alias("_id"), text.alias("_text"), F.xxhash64(text).alias("_row"))
    rows = rows.join(starts, (F.col("_id") == F.col("doc")) & (F.col("_row") == F.col("row")), "left")

    def cut(batches):
        for batch in batches:
            out = []
            for name, whole, at in zip(*(batch.column(c).to_pylist() for c in (0, 1, 2))):
                lines = whole.split(separator)
                gone, spans, reach = np.zeros(len(lines), bool), [], 0
                for x in sorted(at or (), key=lambda x: (x["at"], -x["lines"])):
                    if x["at"] + x["lines"] > reach:
                        reach = x["at"] + x["lines"]
                        gone[x["at"] : reach] = True
                        spans.append(x["lines"])
                kept = separator.join(x for x, g in zip(lines, gone.tolist()) if not g) if spans else whole
                digest = hashlib.sha256(kept.encode()).hexdigest()
                out.append((name, len(lines), int(gone.sum()), len(spans), max(spans, default=0), digest, kept))
            names = ["_id", "n_lines", "n_removed", "n_spans", "longest", "kept_sha256", "kept"]
            types = [pa.int64()] * 5 + [pa.string()] * 2
            columns = list(zip(*out)) if out else [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

    return rows.select("_id", "_text", "starts").mapInArrow(lean_map(cut), RESULT).withColumnRenamed("_id", id_col)
