"""NumPy matrices as a Spark data source: many tasks per large file, many small files per task, and a writer.

``.npy`` files hold one matrix per video (its name is the video id), or blocks of one: the rows
from ``p`` on of video ``v`` are in ``v@p.npy``, so a long video is written by many tasks.
"""

from __future__ import annotations

import math
import sys
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition, WriterCommitMessage,
)

from framelark.functions.partitioned import block_of

NAME = "numpy_matrix"
SCHEMA = "video_id string, pos int, vec array<float>"
SPLIT_BYTES = 64 << 20
CHUNK_BYTES = 4 << 20
BLOCK_ROWS = 4096


def open_store(path: str):
    """``(file system, path in it)`` of a path or an address that Arrow knows."""
    from pyarrow import fs

    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    if "://" in path:
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


def video_and_start(path: str) -> tuple[str, int]:
    stem = path.rsplit("/", 1)[-1][: -len(".npy")]
    video, at, start = stem.rpartition("@")
    return (video, int(start)) if at and start.isdigit() else (stem, 0)


@dataclass
class Ranges(InputPartition):
    """Byte ranges ``(path, low, high)`` that one task reads."""

    ranges: list[tuple[str, int, int]]


def plan_ranges(files: list[tuple[str, int]], split_bytes: int) -> list[Ranges]:
    """Cut large files and gather small ones, so that each task has about ``split_bytes``; headers are not read."""
    out: list[Ranges] = []
    room = 0
    for path, size in sorted(files):
        cuts = max(1, math.ceil(size / split_bytes))
        for k in range(cuts):
            low, high = size * k // cuts, size * (k + 1) // cuts
            if high - low > room:
                out.append(Ranges([]))
                room = split_bytes
            out[-1].ranges.append((path, low, high))
            room -= high - low
    return out


def read_header(f) -> tuple[int, int, np.dtype, int]:
    """``(rows, columns, type, offset of the data)``; one-dimensional arrays are one row."""
    version = np.lib.format.read_magic(f)
    read = np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0
    shape, by_column, kind = read(f)
    if kind.hasobject or len(shape) > 2 or (by_column and len(shape) == 2 and min(shape) > 1):
        raise ValueError(f"not a matrix of numbers stored by rows: shape {shape}, type {kind}")
    rows, columns = shape if len(shape) == 2 else (1, int(np.prod(shape, dtype=np.int64)))
    return rows, columns, kind, f.tell()


def read_rows(store, path: str, low: int, high: int):
    """Record batches of the rows whose first byte lies in ``low .. high`` (a file without row bytes: in its first range)."""
    video, start = video_and_start(path)
    with store.open_input_file(path) as f:
        rows, columns, kind, offset = read_header(f)
        width = columns * kind.itemsize
        at = lambda byte: min(rows, max(0, math.ceil((byte - offset) / width))) if width else (rows if byte else 0)
        first, last = at(low), at(high)
        step = max(1, CHUNK_BYTES // max(1, width))
        for begin in range(first, last, step):
            n = min(step, last - begin)
            f.seek(offset + begin * width)
            data = f.read(n * width)
            if len(data) != n * width:
                raise ValueError(f"{path} ends early")
            flat = np.frombuffer(data, kind).astype(np.float32)
            vec = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * columns), pa.array(flat))
            pos = pa.array(np.arange(start + begin, start + begin + n, dtype=np.int32))
            yield pa.RecordBatch.from_arrays([pa.array([video] * n, pa.string()), pos, vec], names=["video_id", "pos", "vec"])


class NumpyReader(DataSourceReader):
    def __init__(self, path: str, split_bytes: int):
        self.path, self.split_bytes, self.only = path, split_bytes, None

    def pushFilters(self, filters):
        """Filters on ``video_id`` choose the files; all others stay with Spark."""
        for f in filters:
            values = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
            if values is None or f.attribute != ("video_id",):
                yield f
            else:
                self.only = values if self.only is None else self.only & values

    def partitions(self):
        from pyarrow import fs

        store, path = open_store(self.path)
        info = store.get_file_info(path)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        found = [info] if info.is_file else store.get_file_info(fs.FileSelector(path, recursive=True))
        files = [(i.path, i.size) for i in found if i.is_file and i.path.endswith(".npy")]
        if self.only is not None:
            files = [f for f in files if video_and_start(f[0])[0] in self.only]
        return plan_ranges(files, self.split_bytes) or [Ranges([])]

    def read(self, partition):
        store, _ = open_store(self.path)
        for path, low, high in partition.ranges:
            yield from read_rows(store, path, low, high)


class NumpyWriter(DataSourceArrowWriter):
    """Writes runs of rows with equal ``(video_id, block)``; file names depend on them alone, so a task that runs again overwrites."""

    def __init__(self, path: str):
        self.path = path

    def write(self, iterator):
        store, folder = open_store(self.path)
        store.create_dir(folder, recursive=True)
        key, vectors = None, []

        def flush():
            if vectors:
                video, start = key
                with store.open_output_stream(f"{folder}/{video}@{start}.npy") as f:
                    np.lib.format.write_array(f, np.stack(vectors).astype(np.float32), allow_pickle=False)

        for batch in iterator:
            columns = [batch.column(i) for i in range(3)]
            for video, pos, vec in zip(columns[0].to_pylist(), columns[1].to_pylist(), columns[2]):
                mine = (video, pos // BLOCK_ROWS * BLOCK_ROWS)
                if mine != key:
                    flush()
                    key, vectors = mine, []
                if pos != mine[1] + len(vectors):
                    raise ValueError(f"positions of {video} are not gapless at {pos}")
                vectors.append(vec.values.to_numpy(zero_copy_only=False))
        flush()
        return WriterCommitMessage()


class NumpyMatrixSource(DataSource):
    """``spark.read.format("numpy_matrix").load(folder)``; option ``split_bytes``."""

    @classmethod
    def name(cls):
        return NAME

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return NumpyReader(self.options["path"], int(self.options.get("split_bytes", SPLIT_BYTES)))

    def writer(self, schema, overwrite):
        return NumpyWriter(self.options["path"])


def register_numpy(spark: SparkSession) -> None:
    """Make the source known to a session, and let it take filters."""
    cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers need not find this package
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(NumpyMatrixSource)


def read_matrices(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """``video_id, pos, vec`` of all ``.npy`` files below a folder, or of one file.

    A file is read by as many tasks as it has ``split_bytes``, each its own rows. An empty folder
    gives no rows; a missing one, a file that is cut short, and one that holds no matrix of numbers are errors.
    """
    register_numpy(spark)
    return spark.read.format(NAME).option("split_bytes", split_bytes).load(path)


def write_matrices(rows: DataFrame, path: str) -> None:
    """Write ``video_id, pos, vec`` as matrices; ``pos`` is gapless from 0 in each video.

    A video of more than ``BLOCK_ROWS`` rows becomes several files, written by different tasks.
    """
    register_numpy(rows.sparkSession)
    slim = rows.select("video_id", F.col("pos").cast("int").alias("pos"), F.col("vec").cast("array<float>").alias("vec"))
    placed = slim.repartition("video_id", block_of("pos", BLOCK_ROWS)).sortWithinPartitions("video_id", "pos")
    placed.write.format(NAME).mode("append").save(path)
