"""The NumPy data source: split files, gathered files, filters, round trips and damage."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from framelark.sources import numpy_source as ns


def rows_of(df):
    return sorted((r.video_id, r.pos, tuple(r.vec)) for r in df.collect())


def expected(files):
    return sorted(
        (v, i, tuple(float(np.float32(x)) for x in row)) for v, m in files.items() for i, row in enumerate(np.atleast_2d(m))
    )


@pytest.fixture
def folder(tmp_path):
    rng = np.random.default_rng(1)
    files = {
        "video1": rng.normal(size=(1000, 7)).astype(np.float32), "video2": rng.normal(size=(3, 5)), "video3": rng.integers(0, 9, (11, 2)),
        "video4": np.arange(6.0), "a@b": rng.normal(size=(2, 3)).astype(np.float16), "none": np.zeros((0, 4), np.float32), "wide": np.zeros((3, 0)),
    }
    for k, (v, m) in enumerate(files.items()):
        (tmp_path / f"part{k % 2}").mkdir(exist_ok=True)
        np.save(tmp_path / f"part{k % 2}" / f"{v}.npy", m)
    (tmp_path / "part0" / "note.txt").write_text("not a matrix")
    return tmp_path, files


@pytest.mark.parametrize("split", [100, 4096, ns.SPLIT_BYTES])
def test_rows_do_not_depend_on_the_split(spark, folder, split):
    path, files = folder
    df = ns.read_matrices(spark, str(path), split)
    assert rows_of(df) == expected(files)
    if split == 4096:
        one = ns.read_matrices(spark, str(path / "part0" / "video1.npy"), split)
        assert one.rdd.getNumPartitions() == 7
        assert one.groupBy(F.spark_partition_id().alias("p")).count().filter("count > 200").count() == 0


def test_small_files_are_gathered():
    plan = ns.plan_ranges([(f"f{i:03}", 100) for i in range(50)] + [("large", 1000)], 400)
    sizes = [sum(high - low for _, low, high in p.ranges) for p in plan]
    assert max(sizes) <= 400 and len(plan) < 20 and sum(sizes) == 6000


def test_filters_choose_files(spark, folder):
    path, files = folder
    reader = ns.NumpyReader(str(path), ns.SPLIT_BYTES)
    left = list(reader.pushFilters([ns.EqualTo(("video_id",), "video2"), ns.EqualTo(("pos",), 1)]))
    assert left == [ns.EqualTo(("pos",), 1)]
    assert [p.rsplit("/", 1)[1] for part in reader.partitions() for p, _, _ in part.ranges] == ["video2.npy"]
    df = ns.read_matrices(spark, str(path)).filter("video_id IN ('video2', 'video4', 'absent') AND pos < 2")
    assert rows_of(df) == [r for r in expected(files) if r[0] in ("video2", "video4") and r[1] < 2]


def test_round_trip_of_a_long_video(spark, tmp_path):
    vec = F.array(F.col("id").cast("float"), F.lit(0.5))
    hot = spark.range(10_000).select(F.lit("hot").alias("video_id"), F.col("id").cast("int").alias("pos"), vec.alias("vec"))
    other = spark.range(3).select(F.lit("b@x").alias("video_id"), F.col("id").cast("int").alias("pos"), vec.alias("vec"))
    out = str(tmp_path / "out")
    ns.write_matrices(hot.unionByName(other).orderBy(F.rand(1)), out)
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["b@x@0.npy", "hot@0.npy", "hot@4096.npy", "hot@8192.npy"]
    back = ns.read_matrices(spark, out, 10_000)
    assert rows_of(back) == rows_of(hot.unionByName(other))
    assert back.filter("video_id = 'hot'").groupBy("video_id").agg(F.max("pos")).first()[1] == 9999


def test_empty_missing_and_damaged(spark, tmp_path):
    assert ns.read_matrices(spark, str(tmp_path)).collect() == []
    with pytest.raises(Exception, match="absent"):
        ns.read_matrices(spark, str(tmp_path / "absent")).collect()
    np.save(tmp_path / "v.npy", np.ones((10, 3)))
    whole = (tmp_path / "v.npy").read_bytes()
    (tmp_path / "v.npy").write_bytes(whole[:-5])
    with pytest.raises(Exception, match="ends early"):
        ns.read_matrices(spark, str(tmp_path)).collect()
    np.save(tmp_path / "v.npy", np.asfortranarray(np.ones((10, 3))))
    with pytest.raises(Exception, match="stored by rows"):
        ns.read_matrices(spark, str(tmp_path)).collect()
    gap = spark.createDataFrame([("v", 0, [1.0]), ("v", 2, [1.0])], ns.SCHEMA)
    with pytest.raises(Exception, match="not gapless"):
        ns.write_matrices(gap, str(tmp_path / "gap"))
