"""Readers for metadata, captions, predictions, prompts and feature files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from framelark.functions.partitioned import dense_index
from framelark.operators.features import index_files
from framelark.schemas import CAPTION_MAP, METADATA, PREDICTION_MAP
from framelark.sources.json_arrays import read_json_arrays

# The default prompt bank.
DEFAULT_PROMPTS = [
    "a person interacting with objects",
    "a close-up of an important object",
    "a scene change in a video",
    "a frame showing a clear action",
    "an indoor environment",
    "an outdoor environment",
    "a vehicle or transportation scene",
    "a group of people",
    "a damaged object or structure",
    "smoke fire or an emergency scene",
    "a rescue or response scene",
    "a landscape or wide scene",
]


#: Metadata files beyond this size are split over tasks.
WHOLE_BYTES = 64 << 20


def read_metadata(spark: SparkSession, path: str, whole_bytes: int = WHOLE_BYTES) -> tuple[DataFrame, DataFrame]:
    """``videos`` and ``sentences`` tables of metadata JSON files.

    A metadata file is one JSON object. Files of up to ``whole_bytes`` are parsed whole, many in
    parallel; larger ones are split over many tasks. Store the tables as Parquet for later jobs.
    """
    files = spark.read.format("binaryFile").load(path).select("path", (F.col("length") > whole_bytes).alias("big"))
    names = {big: [r["path"] for r in files.filter(F.col("big") == big).collect()] for big in (True, False)}
    if names[True]:
        videos, lines = _large_tables(spark, names[True])
        if names[False]:
            more_videos, more_lines = _whole_tables(spark.read.schema(METADATA).option("multiLine", True).json(names[False]))
            videos, lines = videos.unionByName(more_videos), lines.unionByName(more_lines)
        return videos, _numbered(lines)
    videos, lines = _whole_tables(spark.read.schema(METADATA).option("multiLine", True).json(path))
    return videos, _numbered(lines)


def _whole_tables(doc: DataFrame) -> tuple[DataFrame, DataFrame]:
    videos = doc.select(F.inline("videos"))
    lines = doc.select(F.col("_metadata.file_path").alias("file"), F.posexplode("sentences").alias("line", "s"))
    return _renamed(videos), lines.select("file", F.col("line").cast("bigint").alias("line"), "s.video_id", "s.caption")


def _renamed(videos: DataFrame) -> DataFrame:
    return videos.withColumnsRenamed({"start time": "start_time", "end time": "end_time"})


def _numbered(lines: DataFrame) -> DataFrame:
    """Captions numbered within their video by line, then by file."""
    out = dense_index(lines, ["video_id"], F.floor(F.col("line") / 65536), ["line", "file"], "cap_id")
    return out.select("video_id", F.col("cap_id").cast("int").alias("cap_id"), "caption")


def read_large_metadata(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The same tables as :func:`read_metadata`, from objects of any size: each is split over many tasks."""
    videos, lines = _large_tables(spark, path)
    return videos, _numbered(lines)


def _large_tables(spark: SparkSession, path: str | list[str]) -> tuple[DataFrame, DataFrame]:
    elements = read_json_arrays(spark, path)
    inner = {f.name: f.dataType.elementType for f in METADATA.fields}

    def rows(name: str) -> DataFrame:
        parsed = elements.filter(F.col("array") == name).withColumn("e", F.from_json("element", inner[name]))
        return parsed.select("file", "line", "e.*")

    return _renamed(rows("videos").drop("file", "line")), rows("sentences").select("file", "line", "video_id", "caption")


def read_captions(spark: SparkSession, path: str) -> DataFrame:
    """Sentences of a caption map, or of metadata when the file has ``sentences``.

    An id that stands in several metadata files numbers its captions by line, then by file.
    """
    text = spark.read.text(path, wholetext=True)
    raw = text.select(
        F.get_json_object("value", "$.sentences").isNotNull().alias("full"), "value", F.input_file_name().alias("file")
    )
    full = raw.filter("full").select("file", F.from_json("value", METADATA).alias("d"))
    from_full = full.select("file", F.posexplode("d.sentences").alias("line", "s")).select(
        "file", "line", "s.video_id", "s.caption"
    )
    from_full = dense_index(from_full, ["video_id"], F.floor(F.col("line") / 65536), ["line", "file"], "cap_id")
    mapped = raw.filter("NOT full").select(F.explode(F.from_json("value", CAPTION_MAP)).alias("video_id", "caps"))
    from_map = mapped.select("video_id", F.posexplode("caps").alias("cap_id", "caption"))
    return from_map.select("video_id", F.col("cap_id").cast("bigint").alias("cap_id"), "caption").unionByName(
        from_full.select("video_id", "cap_id", "caption")
    )


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    text = spark.read.text(path, wholetext=True)
    entries = text.select(F.explode(F.from_json("value", PREDICTION_MAP)).alias("video_id", "p"))
    return entries.select("video_id", F.col("p")[0]["caption"].alias("caption"))


def clean_prompts(lines: DataFrame) -> DataFrame:
    """Strip, drop blank and ``#`` lines, keep the first of equal prompts.

    ``lines``: ``ord, line``.
    """
    prompt = F.regexp_replace("line", r"(?U)^\s+|\s+$", "")
    return (
        lines.select("ord", prompt.alias("prompt"))
        .filter((F.col("prompt") != "") & ~F.col("prompt").startswith("#"))
        .groupBy("prompt")
        .agg(F.min("ord").alias("ord"))
        .select("ord", "prompt")
    )


def load_prompts(spark: SparkSession, path: str | None = None, defaults: bool = True) -> DataFrame:
    """Default prompts first, then the lines of the file."""
    bank = DEFAULT_PROMPTS if defaults else []
    schema = "ord bigint, line string"
    head = spark.createDataFrame([(i - len(bank), p) for i, p in enumerate(bank)], schema)
    if path is None:
        return clean_prompts(head)
    whole = spark.read.text(path, wholetext=True)
    lines = whole.select(F.posexplode(F.split("value", r"\r?\n")).alias("ord", "line"))
    return clean_prompts(head.unionByName(lines.select(F.col("ord").cast("bigint").alias("ord"), "line")))


def list_files(spark: SparkSession, roots: list[str], pattern: str) -> DataFrame:
    """Files below ordered roots, one per stem: the first root wins. Contents are not read."""
    parts = []
    for priority, root in enumerate(roots):
        found = (
            spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern)
            .load(root).select("path")
        )
        parts.append(found.withColumn("root_priority", F.lit(priority)))
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    stem = F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1)
    return index_files(whole.withColumn("video_id", stem))


def parse_feature_blobs(blobs: DataFrame) -> DataFrame:
    """Rows of NumPy files given as ``video_id, content``; one file at a time per task."""

    def parse(batches):
        import io

        import numpy as np
        import pandas as pd

        for pdf in batches:
            for video, blob in zip(pdf["video_id"], pdf["content"]):
                m = np.atleast_2d(np.load(io.BytesIO(blob), allow_pickle=False)).astype("float32")
                yield pd.DataFrame({"video_id": video, "pos": np.arange(len(m), dtype="int32"), "vec": list(m)})

    return blobs.mapInPandas(parse, "video_id string, pos int, vec array<float>")


def read_feature_files(spark: SparkSession, path: str, pattern: str = "*.npy") -> DataFrame:
    """Rows of per-video NumPy matrices below a folder: ``video_id, pos, vec``."""
    found = (
        spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    )
    return parse_feature_blobs(found.select(F.regexp_extract("path", r"([^/]+)\.npy$", 1).alias("video_id"), "content"))
