"""Incremental variants on Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from framelark.functions.storage import folder_of, make_folder, scratch_path, scratch_scope, write_through
from framelark.functions.vectors import dot
from framelark.streaming.state import frames_before, give_out, nearest, on_disk_state, token_of


@dataclass(frozen=True)
class BatchStream:
    """A stream whose result is computed trigger by trigger with plain batch operations.

    ``step(batch, number)`` returns the rows of a trigger; what later triggers need is state of ``stream``.
    """

    stream: DataFrame
    step: Callable[[DataFrame, int], DataFrame]
    schema: str

    def run(self, out: str, checkpoint: str) -> DataFrame:
        """Take all files present now; later calls with the same folders go on from there.

        A batch that runs again after a crash overwrites its own folders.
        """
        spark, step = self.stream.sparkSession, self.step
        empty = spark.createDataFrame([], f"{self.schema}, batch bigint")
        empty.write.mode("append").partitionBy("batch").parquet(out)

        def write(batch: DataFrame, number: int) -> None:
            with scratch_scope(spark):
                step(batch, number).write.mode("overwrite").parquet(f"{out}/batch={number}")

        with on_disk_state(spark):
            query = (
                self.stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
                .trigger(availableNow=True).start()
            )
        query.awaitTermination()
        return spark.read.schema(empty.schema).parquet(out).drop("batch")


def run_to_table(stream: DataFrame | BatchStream, name: str, mode: str = "append", keys: list[str] | None = None) -> DataFrame:
    """Run a stream over all files present now and return what it wrote.

    ``update`` output keeps, per ``keys``, the row of the latest batch that changed it:
    every batch adds only its changed rows, under its own number.
    """
    if isinstance(stream, BatchStream):
        spark = stream.stream.sparkSession
        return stream.run(scratch_path(spark, name), scratch_path(spark, f"{name}-state"))
    spark = stream.sparkSession
    out, state = scratch_path(spark, name), scratch_path(spark, f"{name}-state")
    writer = stream.writeStream.option("checkpointLocation", state).outputMode(mode).trigger(availableNow=True)
    if mode == "update":
        query = writer.foreachBatch(lambda batch, n: batch.write.mode("overwrite").parquet(f"{out}/batch={n}")).start()
    else:
        query = writer.format("parquet").option("path", out).start()
    query.awaitTermination()
    make_folder(spark, out)  # a stream without rows writes nothing
    if mode != "update":
        return spark.read.schema(stream.schema).parquet(out)
    changed = spark.read.schema(StructType([*stream.schema.fields, StructField("batch", LongType())])).parquet(out)
    row = F.struct(*[c for c in stream.columns if c not in keys])
    latest = changed.groupBy(*keys).agg(F.max_by(row, "batch").alias("r"))
    return latest.select(*keys, "r.*").select(*stream.columns)


def read_stream(
    spark: SparkSession, folder: str, pattern: str, schema: StructType, max_files: int | None = None
) -> DataFrame:
    """Files of a folder as a stream; ``max_files`` bounds the files of one batch."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", pattern)
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(folder)


def table_stream(spark: SparkSession, path: str, schema: StructType, max_files: int | None = None) -> DataFrame:
    """A Parquet table as a stream: the files of its folder, or the one file that it is.

    A path that does not exist is an error; a folder that is still empty is a stream without rows yet.
    """
    folder, name = folder_of(spark, path)
    return read_stream(spark, folder, name or "*.parquet", schema, max_files)


def stream_pending(
    stream: DataFrame, process: Callable[[DataFrame], DataFrame], done_path: str, failed_path: str, checkpoint: str,
    key: str = "video_id",
) -> None:
    """Process every id until it has succeeded once; failures go to a log and may come again.

    ``process`` maps a batch to the same ids with an ``error`` column. Which ids were given out is
    keyed state (:func:`framelark.streaming.state.give_out`), whenever they arrive: there is no watermark, so
    nothing is late, and a trigger touches only the state of its own ids. Failed tries are reported in a
    folder next to the checkpoint, which is a second source of the stream. A call goes on until no try of
    its own has failed unreported, so an id that failed and came again in one call is tried again in it.
    Rows of a null id are one id. A batch that runs again after a crash overwrites its own folders, and a
    report counts once, for the try that it names. Spark fixes the number of state partitions when the
    checkpoint is new.
    """
    spark = stream.sparkSession
    kind = stream.schema[key].dataType.simpleString()
    # An empty history from the start, so that it can be read.
    spark.createDataFrame([], f"{key} {kind}, batch bigint").write.mode("append").partitionBy("batch").parquet(done_path)
    reports, report = f"{checkpoint}-reports", "_token string, _try bigint"
    make_folder(spark, reports)
    failed = []

    def write(batch: DataFrame, number: int) -> None:
        with scratch_scope(spark):
            given = write_through(batch, "given")
            if given.isEmpty():
                return
            slot = f"{failed_path}-work/batch={number}"
            result = process(given.drop("_token", "_try"))
            result.write.mode("overwrite").parquet(slot)
            stored = spark.read.schema(result.schema).parquet(slot)
            bad = stored.filter(F.col("error").isNotNull()).select(key, "error")
            bad.write.mode("overwrite").json(f"{failed_path}/batch={number}")
            stored.filter(F.col("error").isNull()).write.mode("overwrite").parquet(f"{done_path}/batch={number}")
            tries = given.select("_token", "_try").join(bad.select(token_of(key).alias("_token")).distinct(), "_token")
            if not bad.isEmpty():
                tries.write.mode("append").parquet(reports)
                failed.append(number)

    while True:
        failed.clear()
        given = give_out(stream, spark.readStream.schema(report).parquet(reports), key)
        with on_disk_state(spark):
            query = given.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
        if not failed:
            break
    make_folder(spark, failed_path)  # so that the log of a stream without rows can be read


def stream_manifest(stream: DataFrame, time: str = "ts", late: str = "1 hour", width: str = "1 hour") -> DataFrame:
    """Rows per status and hour, kept up to date."""
    return (
        stream.withWatermark(time, late)
        .groupBy(F.window(time, width).alias("w"), "status")
        .agg(F.count(F.lit(1)).alias("n"))
        .select(F.col("w.start").alias("hour"), "status", "n")
    )


BAD_FRAME = "sample_index or vector missing, or vectors of different lengths"


def frame_changes(answers: DataFrame, number: int) -> DataFrame:
    """``1 - cosine`` of each frame of a trigger to the newest frame before it, here or in earlier triggers."""
    rows = nearest(write_through(answers, "answers"))
    cur, prev = F.col("vec"), F.col("prev")
    norms = F.greatest(F.sqrt(dot(prev, prev)), F.lit(1e-8)) * F.greatest(F.sqrt(dot(cur, cur)), F.lit(1e-8))
    cosine = dot(prev, cur) / norms
    # greatest and least take NaN as the largest number.
    cosine = F.when(F.isnan(cosine), cosine).otherwise(F.least(F.greatest(cosine, F.lit(-1.0)), F.lit(1.0)))
    change = (
        F.when(F.col("before").isNull(), 0.0)
        .when(F.size(prev) != F.size(cur), F.raise_error(F.lit(BAD_FRAME)).cast("double"))
        .otherwise(1.0 - cosine)
    )
    return rows.select("video_id", F.col("at").cast("int").alias("sample_index"), change.alias("change"))


def stream_frame_change(stream: DataFrame) -> BatchStream:
    """Change of each frame of a live feed against the frame before it.

    The first frame of a video gets 0. A frame that arrives after newer ones is compared with the
    newest frame before it that has come by then, however old; rows given out before are not changed.
    Frames are keyed state (:func:`framelark.streaming.state.frames_before`): a trigger touches the groups of its own
    frames and the entries before them, whatever has come before. A frame that comes twice in a trigger counts
    with its largest vector as the frame before, one that comes again later with its newest. Null ids are one
    video. A missing component counts as NaN. A row without index or vector, or with a vector of
    another length than the frame before, is an error.
    """
    bad = F.col("sample_index").isNull() | F.col("vec").isNull()

    def checked(column):
        return F.when(bad, F.raise_error(F.lit(BAD_FRAME)).cast(column[1])).otherwise(F.col(column[0]).cast(column[1]))

    frames = stream.select(
        token_of("video_id").alias("token"), F.col("video_id").cast("string").alias("video_id"),
        checked(("sample_index", "bigint")).alias("at"), checked(("vec", "array<double>")).alias("vec"),
    )
    return BatchStream(frames_before(frames), frame_changes, "video_id string, sample_index int, change double")
