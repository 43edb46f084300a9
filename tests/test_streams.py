"""Streams against the batch result, and across restarts."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from checks import store_queries  # noqa: F401
from checks.registry import QUERIES
from framelark.streaming import streams
from framelark.streaming.state import on_disk_state
from tests.conftest import SF

SCHEMA = "video_id string, ts timestamp, status string"


def rows(*ids):
    start = dt.datetime(2024, 1, 1)
    return [(v, start + dt.timedelta(minutes=i), "ok") for i, v in enumerate(ids)]


def test_pending_across_restarts(spark, tmp_path):
    feed, done, failed, state = (str(tmp_path / n) for n in ("feed", "done", "failed", "state"))
    schema = spark.createDataFrame([], SCHEMA).schema

    def process(batch):
        return batch.select("video_id", F.when(F.col("video_id") == "v3", "broken").alias("error"))

    def run():
        source = streams.read_stream(spark, feed, "*.parquet", schema)
        streams.stream_pending(source, process, done, failed, state)
        return sorted(r[0] for r in spark.read.parquet(done).select("video_id").collect())

    spark.createDataFrame(rows("v1", "v2", "v1"), SCHEMA).write.parquet(feed)
    assert run() == ["v1", "v2"]
    spark.createDataFrame(rows("v2", "v3", "v3"), SCHEMA).write.mode("append").parquet(feed)
    # Only ids that succeeded are done; the failed one is logged.
    assert run() == ["v1", "v2"]
    assert run() == ["v1", "v2"]
    assert [r["video_id"] for r in spark.read.json(failed).select("video_id").collect()] == ["v3"]


def test_late_ids_and_retries(spark, tmp_path):
    feed, done, failed, state = (str(tmp_path / n) for n in ("feed", "done", "failed", "state"))
    schema = spark.createDataFrame([], SCHEMA).schema
    broken = {"v2"}
    calls = []

    def process(batch):
        calls.append(sorted(r[0] for r in batch.select("video_id").collect()))
        return batch.select("video_id", F.when(F.col("video_id").isin(*broken, "-"), "broken").alias("error"))

    def run(*given):
        spark.createDataFrame([(v, dt.datetime(*day), "ok") for v, day in given], SCHEMA).write.mode("append").parquet(feed)
        streams.stream_pending(streams.read_stream(spark, feed, "*.parquet", schema), process, done, failed, state)
        return sorted(r[0] for r in spark.read.parquet(done).select("video_id").collect())

    assert run(("v1", (2024, 1, 20)), ("v2", (2024, 1, 20))) == ["v1"]
    # Seen for the first time, with an old event time.
    assert run(("v0", (2024, 1, 1))) == ["v0", "v1"]
    # A failed id that comes again is tried again, however late.
    broken.clear()
    assert run(("v2", (2024, 3, 1)), ("v1", (2024, 3, 1))) == ["v0", "v1", "v2"]
    assert calls == [["v1", "v2"], ["v0"], ["v2"]]


def test_manifest_updates_across_batches(spark, tmp_path):
    feed = str(tmp_path / "feed")
    schema = spark.createDataFrame([], SCHEMA).schema
    for part in (rows("a", "b"), rows("c"), rows("d", "e", "f")):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(feed)
    stream = streams.stream_manifest(streams.read_stream(spark, feed, "*.parquet", schema, max_files=1))
    got = streams.run_to_table(stream, "manifest", "update", ["hour", "status"]).collect()
    assert [(r["status"], r["n"]) for r in got] == [("ok", 6)]


def test_frame_change_out_of_order(spark, tmp_path):
    feed = str(tmp_path / "feed")
    schema = "video_id string, sample_index int, vec array<double>"
    vecs = {0: [1.0, 0.0], 1: [0.0, 1.0], 2: [1.0, 1.0], 3: [1.0, 0.0]}
    for part in ([0, 2], [1, 3]):
        df = spark.createDataFrame([("v", i, vecs[i]) for i in part], schema)
        df.coalesce(1).write.mode("append").parquet(feed)
    source = streams.read_stream(spark, feed, "*.parquet", df.schema, max_files=1)
    got = {r[1]: r[2] for r in streams.run_to_table(streams.stream_frame_change(source), "change").collect()}
    assert got[0] == 0.0 and abs(got[2] - (1 - 2**-0.5)) < 1e-9
    # Frame 1 came after frame 2: it is compared with frame 0, the newest before it.
    assert abs(got[1] - 1.0) < 1e-9 and abs(got[3] - (1 - 2**-0.5)) < 1e-9


def test_frame_change_of_a_shuffled_video_in_small_arrow_batches(spark, tmp_path):
    feed, out, state = (str(tmp_path / n) for n in ("feed", "out", "state"))
    schema = "video_id string, sample_index int, vec array<double>"
    rnd = random.Random(6)
    vecs = {i: [rnd.random() for _ in range(3)] for i in range(1000)}
    late = {3, 500, 501, 996}

    def run(frames):
        df = spark.createDataFrame([("v", i, vecs[i]) for i in frames], schema)
        df.repartition(5).write.mode("append").parquet(feed)
        source = streams.stream_frame_change(streams.read_stream(spark, feed, "*.parquet", df.schema))
        return {r[1]: r[2] for r in source.run(out, state).collect()}

    def change(i, known):
        before = max((j for j in known if j < i), default=None)
        if before is None:
            return 0.0
        a, b = vecs[before], vecs[i]
        return 1 - sum(x * y for x, y in zip(a, b)) / math.sqrt(sum(x * x for x in a) * sum(x * x for x in b))

    first = [i for i in range(1000) if i not in late]
    rnd.shuffle(first)
    rows_before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10")
    try:
        got = run(first)
        assert len(got) == 996 and all(abs(got[i] - change(i, first)) < 1e-9 for i in first)
        # Late frames, most of them older than the newest 64: the frames before them are still known.
        got = run(sorted(late, reverse=True))
        assert len(got) == 1000 and all(abs(got[i] - change(i, vecs)) < 1e-9 for i in late)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows_before)


@pytest.mark.parametrize("name", ["T1_stream_pending", "T2_stream_manifest", "T3_stream_frame_change"])
def test_a_table_may_be_a_folder(spark, tmp_path, name):
    """Equal rows from a file and from the same table as a folder of several files."""
    for table in ("events", "embeddings"):
        spark.read.parquet(f"{SF}/{table}.parquet").repartition(5).write.parquet(str(tmp_path / f"{table}.parquet"))
    one, many = QUERIES[name](spark, SF), QUERIES[name](spark, str(tmp_path))
    assert one.count() > 0
    assert one.exceptAll(many).count() == 0 and many.exceptAll(one).count() == 0


@pytest.mark.parametrize("name", ["T1_stream_pending", "T2_stream_manifest", "T3_stream_frame_change"])
def test_a_folder_without_rows(spark, tmp_path, name):
    for table in ("events", "embeddings"):
        spark.read.parquet(f"{SF}/{table}.parquet").limit(0).write.parquet(str(tmp_path / f"{table}.parquet"))
    assert QUERIES[name](spark, str(tmp_path)).collect() == []


def test_a_missing_table_is_an_error(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        streams.table_stream(spark, str(tmp_path / "none.parquet"), spark.range(1).schema)


def few_state_partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    return before


FRAME = "video_id string, sample_index int, vec array<double>"


def test_frame_change_across_far_places_and_restarts(spark, tmp_path):
    """Indexes far apart and negative, repeated frames and null ids, in three calls, against brute force."""
    feed, out, state = (str(tmp_path / n) for n in ("feed", "out", "state"))
    rnd = random.Random(11)
    places = [-(2**31), -5, 0, 3, 1023, 1024, 5000, 2**20 - 1, 2**20, 2**30 + 7, 2**31 - 1]
    before = few_state_partitions(spark)
    known, want = {}, {}
    try:
        for call in range(3):
            rows = [(v, i, [rnd.random(), rnd.random()]) for v in ("a", "", None) for i in rnd.sample(places, 5)]
            rows.append((*rows[0][:2], [2.0 + call, 0.5]))
            spark.createDataFrame(rows, FRAME).repartition(3).write.mode("append").parquet(feed)
            source = streams.read_stream(spark, feed, "*.parquet", spark.createDataFrame([], FRAME).schema)
            got = streams.stream_frame_change(source).run(out, state).collect()
            trigger = {}
            for v, i, vec in rows:
                trigger[v, i] = max(trigger.get((v, i), vec), vec)
            known.update(trigger)
            for v, i, vec in rows:
                at = max((j for w, j in known if w == v and j < i), default=None)
                change = 0.0
                if at is not None:
                    p = known[v, at]
                    change = 1 - sum(x * y for x, y in zip(p, vec)) / math.hypot(*p) / math.hypot(*vec)
                want.setdefault((str(v), i), []).append(round(change, 9))
            have = {}
            for r in got:
                have.setdefault((str(r["video_id"]), r["sample_index"]), []).append(round(r["change"], 9) + 0.0)
            assert {k: sorted(v) for k, v in have.items()} == {k: sorted(v) for k, v in want.items()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_a_trigger_costs_the_same_however_long_the_history(spark, tmp_path):
    """Same rows in, same state entries read and written, from the second trigger of a hot video on."""
    feed = str(tmp_path / "feed")
    for n in range(8):
        rows = [("hot", 40 * n + i, [1.0, float(i)]) for i in range(40)]
        spark.createDataFrame(rows, FRAME).coalesce(1).write.mode("append").parquet(feed)
    source = streams.read_stream(spark, feed, "*.parquet", spark.createDataFrame([], FRAME).schema, max_files=1)
    answers = streams.stream_frame_change(source).stream
    before = few_state_partitions(spark)
    try:
        with on_disk_state(spark):
            query = (
                answers.writeStream.foreachBatch(lambda batch, n: batch.write.format("noop").mode("overwrite").save())
                .option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
            )
        query.awaitTermination()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    progress = [p for p in query.recentProgress if p["numInputRows"]]
    assert [p["numInputRows"] for p in progress] == [40] * 8
    work = [[p["stateOperators"][0]["customMetrics"][m] for m in ("rocksdbGetCount", "rocksdbPutCount")] for p in progress[1:]]
    assert max(w[0] for w in work) <= 1.2 * min(w[0] for w in work) + 8
    assert max(w[1] for w in work) <= 1.2 * min(w[1] for w in work) + 8


def test_an_id_that_fails_and_comes_again_in_one_call(spark, tmp_path):
    """Three triggers in one call: the id is given out, comes again while its try counts as open, and is tried again."""
    feed, done, failed, state = (str(tmp_path / n) for n in ("feed", "done", "failed", "state"))
    for day in (1, 2, 3):
        given = [("v1", dt.datetime(2024, 1, day), "ok"), (None, dt.datetime(2024, 1, day), "ok")]
        spark.createDataFrame(given, SCHEMA).coalesce(1).write.mode("append").parquet(feed)
    calls = []

    def process(batch):
        ids = sorted(str(r[0]) for r in batch.select("video_id").collect())
        calls.append(ids)
        return batch.select("video_id", F.when(F.lit(len(calls) == 1), "broken").alias("error"))

    before = few_state_partitions(spark)
    try:
        for _ in range(2):
            source = streams.read_stream(spark, feed, "*.parquet", spark.createDataFrame([], SCHEMA).schema, max_files=1)
            streams.stream_pending(source, process, done, failed, state)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert calls == [["None", "v1"], ["None", "v1"]]
    assert sorted(str(r[0]) for r in spark.read.parquet(done).select("video_id").collect()) == ["None", "v1"]
