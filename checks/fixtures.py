"""Typed views over the test tables, in Spark and as DuckDB SQL.

Every view reads its whole table and whole texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from framelark.functions.partitioned import dense_index
from framelark.functions.vectors import as_double, l2_normalize
from framelark.operators.signals import frame_quality


SCAN_BYTES = 128 << 20


def table(spark: SparkSession, sf: str, name: str, spread: bool = False) -> DataFrame:
    """One test table. ``spread`` deals the rows to all cores when the scan has fewer parts than cores.

    The test files hold one row group each, so their scans are one task. Large
    tables have enough parts and are left as they are.
    """
    df = spark.read.parquet(f"{sf}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    if spread and len(df.inputFiles()) < cores and _bytes(df) < cores * SCAN_BYTES:
        return df.repartition(cores)
    return df


def _bytes(df: DataFrame) -> int:
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def _video(col) -> F.Column:
    return F.concat(F.lit("video"), col.cast("string"))


def frames(spark: SparkSession, sf: str) -> DataFrame:
    """One row per vector: two half embeddings and raw signals from its first items."""
    src = table(spark, sf, "embeddings").select(
        _video(F.col("label")).alias("video_id"), "vec_id", as_double(F.col("embedding")).alias("e")
    )
    # Whole vectors are numbered by id inside their video, block by block.
    idx = dense_index(src, ["video_id"], F.floor(F.col("vec_id") / 4096), ["vec_id"], "sample_index")
    e = F.col("e")
    out = idx.select(
        "video_id",
        F.col("sample_index").cast("int").alias("sample_index"),
        (F.col("sample_index") * 15).cast("int").alias("frame_index"),
        (F.col("sample_index") * 0.5).alias("timestamp_sec"),
        F.abs(e[0]).alias("motion_raw"),
        (1.0 - e[1]).alias("histogram_diff_raw"),
        (100.0 * F.abs(e[2])).alias("sharpness_raw"),
        (127.5 * (1.0 + e[3])).alias("mean_luma"),
        F.slice("e", 1, 32).alias("clip"),
        F.slice("e", 33, 32).alias("dino"),
    )
    return frame_quality(out)


def unit_frames(spark: SparkSession, sf: str) -> DataFrame:
    """``frames`` with both embeddings scaled to unit length."""
    df = frames(spark, sf)
    return df.withColumn("clip", l2_normalize(F.col("clip"))).withColumn("dino", l2_normalize(F.col("dino")))


def prompts(spark: SparkSession, sf: str) -> DataFrame:
    """One prompt per label: the unit-length mean of its first half vectors."""
    items = table(spark, sf, "embeddings").select(
        "label", F.posexplode(F.slice(as_double(F.col("embedding")), 1, 32)).alias("pos", "x")
    )
    means = items.groupBy("label", "pos").agg(F.avg("x").alias("x"))
    packed = means.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("pos", "x"))).alias("m"))
    return packed.select(
        F.col("label").alias("ord"),
        F.concat(F.lit("prompt "), F.col("label").cast("string")).alias("prompt"),
        l2_normalize(F.transform("m", lambda s: s["x"])).alias("embedding"),
    )


def signals(spark: SparkSession, sf: str) -> DataFrame:
    src = table(spark, sf, "events").select(
        _video(F.col("user_id")).alias("video_id"), "ts", "event_id",
        F.col("value").alias("motion_raw"),
        (F.col("value") * 7.0 % 1.0).alias("boundary_raw"),
        (F.col("event_id") % 97 / 96.0).alias("quality_raw"),
    )
    idx = dense_index(src, ["video_id"], F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 3600), ["ts", "event_id"], "sample_index")
    return idx.select(
        "video_id",
        F.col("sample_index").cast("int").alias("sample_index"),
        (F.col("sample_index") * 0.5).alias("timestamp_sec"),
        "motion_raw", "boundary_raw", "quality_raw",
    )


def videos(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    return o.select(
        _video(key).alias("video_id"),
        key.alias("id"),
        F.when(F.col("o_orderstatus") == "F", "train").when(F.col("o_orderstatus") == "O", "validate")
        .otherwise("test").alias("split"),
        (cust % 20).cast("int").alias("category"),
        (key % 7).cast("double").alias("start_time"),
        ((key % 7).cast("double") + 10.0 + (cust % 21).cast("double")).alias("end_time"),
        F.when(key % 4 == 0, 0.0).when(key % 4 == 1, 24.0).when(key % 4 == 2, 25.0).otherwise(29.97).alias("native_fps"),
        (key * 37 % 900).cast("int").alias("total_frames"),
    )


def sentences(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents", spread=True)
    return d.select(
        _video(F.floor(F.col("doc_id") / 5)).alias("video_id"),
        (F.col("doc_id") % 5).cast("int").alias("cap_id"),
        F.col("text").alias("caption"),
    )


def turns(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "conversations", spread=True)
    return c.select(
        _video(F.col("conv_id")).alias("video_id"),
        (F.col("conv_id") % 20).cast("int").alias("category"),
        F.col("turn").cast("int").alias("turn"),
        "role",
        F.col("text").alias("caption"),
    )


def predictions(spark: SparkSession, sf: str) -> DataFrame:
    """First assistant turn of each conversation."""
    said = turns(spark, sf).filter("role = 'assistant'")
    return said.groupBy("video_id", "category").agg(F.min_by("caption", "turn").alias("caption"))


def references(spark: SparkSession, sf: str) -> DataFrame:
    """All user turns."""
    return turns(spark, sf).filter("role = 'user'").select(
        "video_id", "category", F.col("turn").alias("cap_id"), "caption"
    )


def history(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select(
        (F.col("o_custkey") % 50).cast("int").alias("run_id"),
        "o_orderkey",
        (F.col("o_totalprice") / 1.0e5).alias("val_loss"),
        ((F.col("o_totalprice") % 1000.0) / 1000.0).alias("val_cider"),
    )
    idx = dense_index(o, ["run_id"], F.floor(F.col("o_orderkey") / 65536), ["o_orderkey"], "epoch", start=1)
    return idx.select("run_id", F.col("epoch").cast("int").alias("epoch"), "val_loss", "val_cider")


def pixels(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem")
    return li.select(
        _video(F.col("l_suppkey") % 10).alias("video_id"),
        F.col("l_linenumber").alias("frame_index"),
        (F.col("l_partkey") % 256).cast("int").alias("r"),
        (F.col("l_orderkey") % 256).cast("int").alias("g"),
        (F.col("l_suppkey") * 31 % 256).cast("int").alias("b"),
    )


def files(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem")
    return li.select(
        _video(F.col("l_orderkey")).alias("video_id"),
        F.when(F.col("l_returnflag") == "A", "clip").when(F.col("l_returnflag") == "N", "dino")
        .otherwise("audio").alias("family"),
        F.col("l_linenumber").alias("root_priority"),
        F.concat(F.lit("/root"), F.col("l_linenumber").cast("string"), F.lit("/"), F.col("l_partkey").cast("string")).alias("path"),
        F.when(F.col("l_partkey") % 17 == 0, 1279).otherwise(1280).alias("dim"),
    )


# The same views for the SQL side.
VIEWS = {
    "fx_frames": """
        SELECT video_id, sample_index, sample_index*15 AS frame_index, sample_index*0.5e0 AS timestamp_sec,
               abs(e[1]) AS motion_raw, 1e0-e[2] AS histogram_diff_raw, 100e0*abs(e[3]) AS sharpness_raw,
               127.5e0*(1e0+e[4]) AS mean_luma, e[1:32] AS clip, e[33:64] AS dino,
               greatest(0e0, 1e0-abs((127.5e0*(1e0+e[4]))/255e0-0.5e0)/0.5e0) AS exposure_raw,
               100e0*abs(e[3])*(0.5e0+0.5e0*greatest(0e0, 1e0-abs((127.5e0*(1e0+e[4]))/255e0-0.5e0)/0.5e0)) AS quality_raw
        FROM (SELECT concat('video', label) AS video_id,
                     CAST(row_number() OVER (PARTITION BY label ORDER BY vec_id)-1 AS INT) AS sample_index,
                     CAST(embedding AS DOUBLE[]) AS e FROM embeddings)""",
    "fx_unit": """
        SELECT * REPLACE (list_transform(clip, lambda x: x/greatest(sqrt(list_dot_product(clip,clip)),1e-8)) AS clip,
                          list_transform(dino, lambda x: x/greatest(sqrt(list_dot_product(dino,dino)),1e-8)) AS dino)
        FROM fx_frames""",
    "fx_prompts": """
        SELECT ord, prompt, list_transform(m, lambda x: x/greatest(sqrt(list_dot_product(m,m)),1e-8)) AS embedding
        FROM (SELECT label AS ord, concat('prompt ', label) AS prompt, list(x ORDER BY pos) AS m
              FROM (SELECT label, pos, avg(CAST(embedding[pos] AS DOUBLE)) AS x
                    FROM embeddings, (SELECT unnest(range(1,33)) AS pos) GROUP BY ALL) GROUP BY ALL)""",
    "fx_signals": """
        SELECT concat('video', user_id) AS video_id,
               CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts,event_id)-1 AS INT) AS sample_index,
               (row_number() OVER (PARTITION BY user_id ORDER BY ts,event_id)-1)*0.5e0 AS timestamp_sec,
               value AS motion_raw, (value*7.0e0) % 1.0e0 AS boundary_raw, event_id % 97 / 96.0e0 AS quality_raw
        FROM events""",
    "fx_videos": """
        SELECT concat('video', o_orderkey) AS video_id, o_orderkey AS id,
               CASE o_orderstatus WHEN 'F' THEN 'train' WHEN 'O' THEN 'validate' ELSE 'test' END AS split,
               CAST(o_custkey % 20 AS INT) AS category, CAST(o_orderkey % 7 AS DOUBLE) AS start_time,
               CAST(o_orderkey % 7 AS DOUBLE)+10.0e0+CAST(o_custkey % 21 AS DOUBLE) AS end_time,
               CASE CAST(o_orderkey % 4 AS INT) WHEN 0 THEN 0.0e0 WHEN 1 THEN 24.0e0 WHEN 2 THEN 25.0e0 ELSE 29.97e0 END AS native_fps,
               CAST(o_orderkey*37 % 900 AS INT) AS total_frames FROM orders""",
    "fx_sentences": """
        SELECT concat('video', CAST(floor(doc_id/5.0e0) AS BIGINT)) AS video_id, CAST(doc_id % 5 AS INT) AS cap_id,
               text AS caption FROM documents""",
    "fx_turns": """
        SELECT concat('video', conv_id) AS video_id, CAST(conv_id % 20 AS INT) AS category, CAST(turn AS INT) AS turn,
               role, text AS caption FROM conversations""",
    "fx_pred": """
        SELECT video_id, category, arg_min(caption, turn) AS caption FROM fx_turns WHERE role='assistant' GROUP BY ALL""",
    "fx_refs": "SELECT video_id, category, turn AS cap_id, caption FROM fx_turns WHERE role='user'",
    "fx_history": """
        SELECT CAST(o_custkey % 50 AS INT) AS run_id,
               CAST(row_number() OVER (PARTITION BY o_custkey % 50 ORDER BY o_orderkey) AS INT) AS epoch,
               o_totalprice/1.0e5 AS val_loss, (o_totalprice % 1000.0e0)/1000.0e0 AS val_cider FROM orders""",
    "fx_pixels": """
        SELECT concat('video', l_suppkey % 10) AS video_id, l_linenumber AS frame_index,
               CAST(l_partkey % 256 AS INT) AS r, CAST(l_orderkey % 256 AS INT) AS g,
               CAST(l_suppkey*31 % 256 AS INT) AS b FROM lineitem""",
    "fx_files": """
        SELECT concat('video', l_orderkey) AS video_id,
               CASE l_returnflag WHEN 'A' THEN 'clip' WHEN 'N' THEN 'dino' ELSE 'audio' END AS family,
               l_linenumber AS root_priority, concat('/root', l_linenumber, '/', l_partkey) AS path,
               CASE WHEN l_partkey % 17=0 THEN 1279 ELSE 1280 END AS dim FROM lineitem""",
}
_NEEDS = {"fx_unit": ["fx_frames"], "fx_pred": ["fx_turns"], "fx_refs": ["fx_turns"]}


def with_views(names: list[str], ctes: dict[str, str], body: str, recursive: bool = False) -> str:
    """``WITH`` clause of the named views and extra steps, then the body."""
    order: list[str] = []
    for n in names:
        for need in [*_NEEDS.get(n, []), n]:
            if need not in order:
                order.append(need)
    parts = [f"{n} AS MATERIALIZED ({VIEWS[n].strip()})" for n in order]
    parts += [f"{n} AS ({q.strip()})" for n, q in ctes.items()]
    word = "WITH RECURSIVE" if recursive else "WITH"
    return f"{word} " + ",\n".join(parts) + "\n" + body.strip()
