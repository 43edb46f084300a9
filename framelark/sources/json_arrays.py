"""Elements of the arrays of large JSON objects, one object split over many tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from framelark.functions.partitioned import BLOCK_ROWS, prefix_aggregate
from framelark.functions.storage import write_through

ORDER = ["blk", "at"]
_PIECE = ["file", *ORDER]
#: Everything up to the first brace that stands outside a string.
_LEAD = r'(?s)^((?:[^"{]++|"[^"\\]*+(?:\\.[^"\\]*+)*+")*+)'
#: The key of an array that opens at the end of a lead.
_KEY = r'"([^"\\]*+(?:\\.[^"\\]*+)*+)"\s*:\s*\[\s*$'


def _bucket() -> Column:
    """Grows along the pieces of a file."""
    return F.struct("blk", F.floor(F.col("at") / BLOCK_ROWS).alias("part"))


def _net_depth(bare: Column) -> Column:
    """Opened minus closed brackets outside strings; ``bare`` has no escapes. The brace that ends the piece is not in it."""
    outside = F.regexp_replace(F.regexp_replace(bare, '"[^"]*"', ""), '"[^"]*$', "")
    count = lambda chars: F.length(outside) - F.length(F.translate(outside, chars, ""))
    return count("{[") - count("]")


def _pieces(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """The text between closing braces, with its quotes, and its depth if it starts outside or inside a string.

    Spark splits a file of any size at such a separator as it does at line ends. A brace
    never cuts an escape in two.
    """
    text = spark.read.option("lineSep", "}").text(path)
    bare = F.regexp_replace("value", r"(?s)\\.", "")
    return text.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("blk"),
        F.monotonically_increasing_id().alias("at"), "value",
        (F.length(bare) - F.length(F.translate(bare, '"', ""))).alias("quotes"),
        _net_depth(bare).alias("outside"), _net_depth(F.concat(F.lit('"'), bare)).alias("inside"),
    )


def read_json_arrays(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``(file, array, line, element)`` of ``{"name": [{...}, ...], ...}`` files: each array's objects, as text.

    ``line`` counts from 0 within an array of a file. The names of a file's arrays are sent to all tasks. Whether a piece starts inside a string
    is the parity of the quotes before it, and how deep it starts the sum of the brackets before it: running
    sums over blocks of pieces (one row per block crosses its border), so no task reads a file whole.
    A piece that ends an object at depth 3 ends an element; elements with nested objects, or
    braces in strings, are joined from their pieces. Arrays of other values than objects, single
    values and objects beside the arrays are passed over. A file holds one object; an array of
    one name should stand in it once. Broken files give elements that do not parse.
    """
    stored = write_through(_pieces(spark, path), "pieces", compression="zstd")
    slim = stored.drop("value")
    parity = prefix_aggregate(slim, ["file"], _bucket(), ORDER, {"before": ("sum", F.col("quotes"))}, inclusive=False)
    starts = F.col("before") % 2 == 1
    ends = (F.col("before") + F.col("quotes")) % 2 == 0  # the brace behind the piece stands outside strings
    moved = F.when(starts, F.col("inside")).otherwise(F.col("outside"))
    steps = parity.select(*_PIECE, moved.alias("opened"), ends.cast("int").alias("closes"))
    steps = write_through(steps, "steps", compression="zstd")
    depth = prefix_aggregate(steps, ["file"], _bucket(), ORDER, {"depth": ("sum", F.col("opened") - F.col("closes"))}, inclusive=False)
    last = (F.col("closes") == 1) & (F.col("depth") + F.col("opened") == 3)
    depth = write_through(depth.select(*_PIECE, "depth", last.cast("int").alias("last")), "depths", compression="zstd")
    # Pieces of an element share its number; the ends before a piece are counted.
    number = prefix_aggregate(depth, ["file"], _bucket(), ORDER, {"number": ("sum", F.col("last"))}, inclusive=False)
    number = number.withColumn("pieces", F.count(F.lit(1)).over(W.partitionBy("file", "number")))
    whole = stored.select(*_PIECE, "value").join(number, _PIECE)
    piece = F.struct(*ORDER, "depth", "last", "value")
    # Most elements are one piece and stay where they are.
    packed = whole.filter("pieces > 1").groupBy("file", "number").agg(F.array_sort(F.collect_list(piece)).alias("p"))
    packed = packed.unionByName(whole.filter("pieces = 1").select("file", "number", F.array(piece).alias("p")))
    # What lies before the piece in which the element starts is an object beside the arrays.
    first = F.array_max(F.transform(F.col("p"), lambda x, i: F.when(x["depth"] <= 2, i)))
    packed = packed.filter(F.element_at("p", -1)["last"] == 1).withColumn("p", F.slice("p", first + 1, F.size("p")))
    packed = packed.select("file", "number", F.col("p")[0].alias("head"), F.concat(F.array_join(F.col("p.value"), "}"), F.lit("}")).alias("text"))
    # The root's own brace is not the element's.
    rooted = F.when(F.col("head.depth") <= 0, F.regexp_replace("text", r"^[^{]*\{", "")).otherwise(F.col("text"))
    cut = packed.select("file", "number", rooted.alias("text")).withColumn("lead", F.regexp_extract("text", _LEAD, 1))
    # An object inside an object follows a colon, an element a bracket or a comma.
    cut = cut.filter(F.col("lead").rlike(r"[\[,]\s*$")).select(
        "file", "number", F.when(F.col("lead").rlike(r"\[\s*$"), F.regexp_extract("lead", _KEY, 1)).alias("opens"),
        F.expr("substring(text, length(lead) + 1)").alias("element"),
    )
    cut = write_through(cut, "elements", compression="zstd")
    # The arrays of a file by their first element; between two of them all numbers are elements of one array.
    firsts = cut.filter("opens IS NOT NULL").groupBy("file").agg(F.array_sort(F.collect_list(F.struct("number", "opens"))).alias("firsts"))
    named = cut.drop("opens").join(F.broadcast(firsts), "file")
    newest = F.element_at(F.filter("firsts", lambda x: x["number"] <= F.col("number")), -1)
    return named.withColumn("of", newest).select(
        "file", F.col("of.opens").alias("array"), (F.col("number") - F.col("of.number")).alias("line"), "element"
    )
