"""Block-wise helpers against plain windows and NumPy, with one key holding most rows."""

import numpy as np
import pytest
from pyspark.sql import Window as W, functions as F

from framelark.functions import partitioned as p
from framelark.operators import scenes, similarity


@pytest.fixture(scope="module")
def skewed(spark):
    rng = np.random.default_rng(1)
    rows = []
    for key, n in (("hot", 700), ("warm", 40), ("cold", 2), ("one", 1)):
        rows += [(key, i, float(v)) for i, v in enumerate(np.round(rng.normal(size=n), 2))]
    return spark.createDataFrame(rows, "video_id string, sample_index int, v double").cache()


def pulled(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_running_values(skewed):
    w = W.partitionBy("video_id").orderBy("sample_index")
    got = p.prefix_aggregate(
        skewed, ["video_id"], p.block_of("sample_index", 16), ["sample_index"],
        {"lo": ("min", F.col("v")), "hi": ("max", F.col("v"))}, inclusive=False,
    )
    before = w.rowsBetween(W.unboundedPreceding, -1)
    want = skewed.withColumn("lo", F.min("v").over(before)).withColumn("hi", F.max("v").over(before))
    cols = ["video_id", "sample_index", F.coalesce("lo", F.lit(99.0)), F.coalesce("hi", F.lit(99.0))]
    assert pulled(got, *cols) == pulled(want, *cols)


def test_dense_index(skewed):
    got = p.dense_index(skewed.drop("v"), ["video_id"], p.block_of("sample_index", 8), ["sample_index"], "n")
    assert pulled(got, "video_id", "sample_index", "n") == pulled(
        skewed.withColumn("n", F.col("sample_index").cast("bigint")), "video_id", "sample_index", "n"
    )


def test_neighbors(skewed):
    w = W.partitionBy("video_id").orderBy("sample_index")
    got = p.with_neighbors(skewed, ["video_id"], "sample_index", ["v"], rows=16)
    want = skewed.withColumn("prev_v", F.lag("v").over(w)).withColumn("next_v", F.lead("v").over(w))
    cols = ["video_id", "sample_index", F.coalesce("prev_v", F.lit(99.0)), F.coalesce("next_v", F.lit(99.0))]
    assert pulled(got, *cols) == pulled(want, *cols)


@pytest.mark.parametrize("group_rows", [1, 100, 10_000])
def test_percentiles(skewed, group_rows):
    wanted = {"a": ("v", 0.05), "b": ("v", 0.5), "c": ("v", 0.92), "d": ("v", 1.0)}
    got = {r["video_id"]: r for r in p.exact_percentiles(skewed, ["video_id"], wanted, group_rows).collect()}
    for key, pdf in skewed.toPandas().groupby("video_id"):
        for out, (_, q) in wanted.items():
            assert got[key][out] == pytest.approx(np.percentile(pdf["v"], q * 100))


@pytest.mark.parametrize("spans", [2, 256])
def test_spaced_starts(spark, monkeypatch, spans):
    monkeypatch.setattr(scenes, "_SPANS_PER_BLOCK", spans)
    rng = np.random.default_rng(3)
    rows, want = [], set()
    for key, n in (("hot", 400), ("b", 9), ("c", 1)):
        last = 0.0
        for i, t in enumerate(np.cumsum(rng.choice([0.5, 0.75, 3.0], size=n)), start=1):
            rows.append((key, i, float(t)))
            if t - last >= 2.0:
                want.add((key, i))
                last = t
    cands = spark.createDataFrame(rows, "video_id string, sample_index int, timestamp_sec double")
    origin = cands.select("video_id").distinct().withColumn("t0", F.lit(0.0))
    got = {tuple(r) for r in scenes.spaced_starts(cands, origin, 2.0).collect()}
    assert got == want


@pytest.mark.parametrize("rows", [7, 1024])
def test_tiles(spark, rows):
    rng = np.random.default_rng(5)
    data, want = [], {}
    for key, n in (("hot", 40), ("b", 3), ("one", 1)):
        x = rng.normal(size=(n, 6))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        sims = np.clip(x @ x.T, -1, 1)
        for i in range(n):
            data.append((key, i, x[i].tolist()))
            others = np.delete(sims[i], i)
            rare = 1 - np.sort(others)[-5:].mean() if n > 1 else 0.0
            want[key, i] = (np.clip(sims[i], 0, 1).mean(), rare)
    df = spark.createDataFrame(data, "video_id string, sample_index int, fused array<double>")
    tiles = similarity.similarity_tiles(df, ["video_id"], "sample_index", "fused", 5, rows)
    got = {}
    for (key, i), part in tiles.toPandas().groupby(["video_id", "sample_index"]):
        best = sorted(v for row in part["best"] for v in row)[-5:]
        rare = 1 - np.mean(best) if best else 0.0
        got[key, i] = (part["pos_sum"].sum() / (part["others"].sum() + 1), rare)
    assert got.keys() == want.keys()
    for k in want:
        assert got[k] == pytest.approx(want[k])


ODD = [1.0, 2.0, 3.0, 4.0, float("nan"), float("nan"), float("inf"), float("-inf"), None, 0.0, -0.0, -2.5]


def test_percentiles_agree_on_odd_values(spark):
    rows = [("odd", v) for v in ODD] + [("none", None)] * 3 + [("nan", float("nan"))] * 4 + [("one", 7.0)]
    df = spark.createDataFrame(rows, "k string, v double")
    wanted = {f"p{q}": ("v", q / 100) for q in (0, 5, 25, 50, 75, 92, 100)}

    def run(limit):
        return sorted(repr(tuple(r)) for r in p.exact_percentiles(df, ["k"], wanted, limit).select("k", *wanted).collect())

    assert run(1) == run(10**6)
    assert len(run(1)) == 4


def test_percentiles_of_close_values(spark):
    df = spark.range(100_000).select(F.lit("k").alias("k"), (1.0 + F.pmod(F.col("id") * 7919, F.lit(100_000)) * 1e-8).alias("v"))
    wanted = {"a": ("v", 0.3), "b": ("v", 0.92)}
    assert p.exact_percentiles(df, ["k"], wanted, 10).collect() == p.exact_percentiles(df, ["k"], wanted).collect()


def test_null_keys_and_null_order_stay(spark):
    rows = [("a", 1), ("a", None), (None, 5), (None, None), ("a", 2), (None, 1)]
    df = spark.createDataFrame(rows, "k string, o int")
    got = p.dense_index(df, ["k"], F.floor(F.col("o") / 2), ["o"], "n")
    plain = df.withColumn("n", F.row_number().over(W.partitionBy("k").orderBy("o")) - 1)
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, map(tuple, plain.collect())))


def test_null_keys_of_percentiles_scaling_and_neighbors(spark):
    from framelark.operators.signals import robust_minmax

    rows = [(k, i, float((i * 7) % 5)) for k in ("a", None) for i in range(20)]
    df = spark.createDataFrame(rows, "video_id string, i int, v double")
    wanted = {"p": ("v", 0.3)}
    for limit in (1, 10**6):
        got = {r.video_id: r.p for r in p.exact_percentiles(df, ["video_id"], wanted, limit).collect()}
        assert got == {"a": 1.0, None: 1.0}
        scaled = robust_minmax(df, {"v": "w"}, group_rows=limit).collect()
        assert sorted(r.w for r in scaled if r.video_id is None) == sorted(r.w for r in scaled if r.video_id == "a")
        assert len(scaled) == 40 and {r.w for r in scaled} == {0.0, 0.25, 0.5, 0.75, 1.0}
    odd = spark.createDataFrame([(None, 0, 1.0), (None, 1, 2.0), (None, None, 3.0), ("a", None, 4.0), ("a", None, 5.0)], "video_id string, i int, v double")
    got = {r.v: (r.prev_v, r.next_v) for r in p.with_neighbors(odd, ["video_id"], "i", ["v"], rows=16).collect()}
    assert got == {1.0: (None, 2.0), 2.0: (1.0, None), 3.0: (None, None), 4.0: (None, None), 5.0: (None, None)}


@pytest.mark.parametrize("group_rows", [1, 10_000])
def test_percentiles_round_like_sql(spark, con, group_rows):
    # Neighbours in rank a few rounding steps apart: the last bit decides who reaches the threshold.
    lo, hi = 0.8900000000000001, 0.8900000000000006
    values = [0.5] * 80 + [lo, hi] + [0.95] * 6
    df = spark.createDataFrame([("a", v) for v in values], "video_id string, v double")
    got = p.exact_percentiles(df, ["video_id"], {"t": ("v", 0.92)}, group_rows).first()["t"]
    assert got == con.execute("SELECT quantile_cont(unnest, 0.92e0) FROM unnest(?::DOUBLE[])", [values]).fetchone()[0] == lo


def test_tiles_without_rows(spark):
    # Blocks 1 and 2 of the index hold no row.
    df = spark.createDataFrame([("a", 0, [1.0, 0.0]), ("a", 30, [0.6, 0.8])], "video_id string, sample_index int, fused array<double>")
    tiles = similarity.similarity_tiles(df, ["video_id"], "sample_index", "fused", rows=10)
    got = tiles.groupBy("sample_index").agg(F.sum("sim_sum").alias("s")).collect()
    assert {r["sample_index"]: r["s"] for r in got} == pytest.approx({0: 0.6, 30: 0.6})
