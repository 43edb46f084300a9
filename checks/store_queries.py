"""Queries of feature stores, run logs, readers, writers and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import BinaryType

from checks import fixtures as fx
from checks.fixtures import with_views
from checks.registry import query
from checks.text_queries import CANON
from framelark.functions.partitioned import block_of, dense_index
from framelark.functions.storage import scratch_path
from framelark.operators import captions, features, runs, splits, temporal
from framelark.schemas import EVENT
from framelark.sources import numpy_source, readers, sinks
from framelark.streaming import streams

KEY = "video_id"
FAMILIES = ["clip", "dino", "audio"]


def r6(*cols: str):
    return [F.round(c, 6).alias(c) for c in cols]


#: Longest vector of :func:`ramp`, and the period of its items.
RAMP_MAX, RAMP_PERIOD = 1280, 101


def ramp(width, seed) -> F.Column:
    """A vector of up to ``RAMP_MAX`` items that depend on a seed and on their position.

    Item ``i`` is ``(7 i + seed) mod 101 / 101``. As 7 * 29 = 1 mod 101, a seed only moves the start by ``29 seed``
    items, so every vector is one cut out of a constant array; no item is computed for its row.
    """
    run = ",".join(repr(j * 7 % RAMP_PERIOD / RAMP_PERIOD) for j in range(1, RAMP_MAX + RAMP_PERIOD + 1))
    start = F.pmod(F.lit(29) * F.pmod(seed.cast("bigint"), F.lit(RAMP_PERIOD)), F.lit(RAMP_PERIOD)) + 1
    return F.slice(F.split(F.lit(run), ",").cast("array<double>"), start.cast("int"), width)


SQL_RAMP = "list_transform(range(1,{w}+1), lambda i: ((i*7+{s}) % 101)/101e0)"


def fused_files(s, sf) -> DataFrame:
    best = features.index_files(fx.files(s, sf).drop("family"))
    seed = F.length("path")
    return best.select(KEY, ramp(F.col("dim"), seed).alias("vec"))


FUSED_FILES = {
    "best": "SELECT video_id, b.p AS path, b.d AS dim FROM (SELECT video_id, min(struct_pack(r:=root_priority, p:=path, d:=dim)) AS b FROM fx_files GROUP BY 1)",
    "vecs": f"SELECT video_id, dim, {SQL_RAMP.format(w='dim', s='length(path)')} AS vec FROM best",
}


# --- feature stores -------------------------------------------------------


@query("S5_index_files", with_views(["fx_files"], {}, """SELECT video_id, family, root_priority, path, dim FROM (SELECT *, row_number() OVER
    (PARTITION BY video_id, family ORDER BY root_priority, path, dim) AS k FROM fx_files) WHERE k=1"""))  # fmt: skip
def _(s, sf):
    return features.index_files(fx.files(s, sf), [KEY, "family"])


LISTED = "SELECT DISTINCT concat('video', user_id) AS video_id, user_id AS id FROM events"


@query("S5_list_files", f"""SELECT video_id, CAST(min(r) AS INT) AS root_priority, min(tail) AS tail FROM (
    SELECT video_id, id % 2 AS r, concat('/root', id % 2, '/', video_id, '.json') AS tail FROM ({LISTED}) WHERE id % 3 <> 0
    UNION ALL SELECT video_id, 2, concat('/root2/', video_id, '.json') FROM ({LISTED}) WHERE id % 3 = 0 OR id % 4 = 1) GROUP BY 1""")
def _(s, sf):
    """Files written under three roots, found by listing; the first root that has an id wins."""
    users = fx.table(s, sf, "events").select(F.concat(F.lit("video"), F.col("user_id").cast("string")).alias(KEY), F.col("user_id").alias("id")).distinct()
    number = F.col("id")
    root = scratch_path(s, "listing")
    parts = [(number % 3 != 0) & (number % 2 == 0), (number % 3 != 0) & (number % 2 == 1), (number % 3 == 0) | (number % 4 == 1)]
    for k, keep in enumerate(parts):
        write_named(users.filter(keep).select(KEY), f"{root}/root{k}")
    found = readers.list_files(s, [f"{root}/root{k}" for k in range(len(parts))], "*.json")
    return found.select(KEY, "root_priority", F.regexp_extract("path", r"(/root\d/[^/]+)$", 1).alias("tail"))


def write_named(ids: DataFrame, folder: str) -> None:
    """One small file per id, named after it, written by the tasks."""

    def run(batches):
        from pyarrow import fs

        where, inner = fs.FileSystem.from_uri(folder)
        where.create_dir(inner, recursive=True)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                with where.open_output_stream(f"{inner}/{name}.json") as out:
                    out.write(b"{}")
            yield batch

    ids.mapInArrow(run, f"{KEY} string").count()


@query("E1_split_fused", with_views(["fx_files", "fx_videos"], {**CANON, **FUSED_FILES}, """SELECT video_id, split, CAST(512 AS INT) AS clip_dim, CAST(768 AS INT) AS dino_dim,
    round(vec[1],6) AS clip_first, round(vec[512],6) AS clip_last, round(vec[513],6) AS dino_first, round(vec[1280],6) AS dino_last
    FROM vecs JOIN canon USING (video_id) WHERE dim=1280"""))  # fmt: skip
def _(s, sf):
    good, _ = features.split_fused(fused_files(s, sf), fx.videos(s, sf))
    return good.select(
        KEY, "split", F.size("clip").alias("clip_dim"), F.size("dino").alias("dino_dim"),
        F.round(F.col("clip")[0], 6).alias("clip_first"), F.round(F.col("clip")[511], 6).alias("clip_last"),
        F.round(F.col("dino")[0], 6).alias("dino_first"), F.round(F.col("dino")[767], 6).alias("dino_last"),
    )


@query("E1_bad_shapes", with_views(["fx_files", "fx_videos"], {**CANON, **FUSED_FILES}, "SELECT video_id, split, dim FROM best JOIN canon USING (video_id) WHERE dim<>1280"))
def _(s, sf):
    _, bad = features.split_fused(fused_files(s, sf), fx.videos(s, sf))
    return bad.select(KEY, "split", "dim")


@query("E2_missing_features", with_views(["fx_files", "fx_videos"], CANON, "SELECT split, video_id FROM canon WHERE video_id NOT IN (SELECT video_id FROM fx_files WHERE family='clip')"))
def _(s, sf):
    return features.missing_features(fx.videos(s, sf), fx.files(s, sf).filter("family = 'clip'"))


@query("E3_feature_completeness", with_views(["fx_files", "fx_videos"], {**CANON,
    "ex": "SELECT split, count(video_id) AS expected FROM sp LEFT JOIN canon USING (split) GROUP BY 1",
    "fd": "SELECT family, split, count(DISTINCT video_id) AS actual FROM fx_files JOIN canon USING (video_id) GROUP BY 1,2",
    "fa": "SELECT unnest(['clip','dino','audio']) AS family"},
    "SELECT family, split, expected, coalesce(actual,0) AS actual, coalesce(actual,0)>=expected AS complete FROM (SELECT * FROM fa, ex) LEFT JOIN fd USING (family, split)"))
def _(s, sf):
    return features.feature_completeness(fx.files(s, sf), fx.videos(s, sf), FAMILIES)


@query("E4_store_parity", with_views(["fx_files", "fx_videos"], {**CANON,
    "c": """SELECT split, count(DISTINCT video_id) FILTER (family='clip') AS clip, count(DISTINCT video_id) FILTER (family='dino') AS dino,
            count(DISTINCT video_id) FILTER (family='audio') AS audio FROM sp LEFT JOIN (SELECT * FROM fx_files JOIN canon USING (video_id)) USING (split) GROUP BY 1"""},
    "SELECT *, CASE WHEN clip=dino AND dino=audio THEN 'ok' ELSE 'MISMATCH' END AS parity FROM c"))
def _(s, sf):
    return features.store_parity(fx.files(s, sf), fx.videos(s, sf), FAMILIES)


USABLE = "SELECT split, video_id FROM canon WHERE video_id IN (SELECT video_id FROM fx_sentences)" + "".join(
    f" AND video_id IN (SELECT video_id FROM fx_files WHERE family='{f}')" for f in FAMILIES
)


@query("E5_usable_videos", with_views(["fx_files", "fx_videos", "fx_sentences"], CANON, USABLE))
def _(s, sf):
    return features.usable_videos(fx.videos(s, sf), fx.sentences(s, sf), fx.files(s, sf), "clip_dino_audio")


@query("E5_usable_videos_fused", with_views(["fx_files", "fx_videos", "fx_sentences"], CANON, """SELECT split, video_id FROM canon WHERE video_id IN (SELECT video_id FROM fx_sentences)
    AND video_id IN (SELECT video_id FROM fx_files WHERE family='clip')"""))  # fmt: skip
def _(s, sf):
    files = fx.files(s, sf).withColumn("family", F.when(F.col("family") == "clip", "fused").otherwise(F.col("family")))
    return features.usable_videos(fx.videos(s, sf), fx.sentences(s, sf), files, "clip_dino", "fused")


@query("E6_orphan_features", with_views(["fx_files", "fx_sentences"], {}, "SELECT DISTINCT video_id FROM fx_files WHERE video_id NOT IN (SELECT video_id FROM fx_sentences)"))
def _(s, sf):
    return features.orphan_features(fx.files(s, sf), fx.sentences(s, sf))


@query("E7_select_modalities", with_views(["fx_videos"], {}, f"""SELECT video_id, 512 AS clip_dim, 768 AS dino_dim, 128 AS audio_dim,
    round(list_sum({SQL_RAMP.format(w=512, s='id')}),6) AS clip_sum, round(list_sum({SQL_RAMP.format(w=768, s='id')}),6) AS dino_sum, 0e0 AS audio_sum FROM fx_videos"""))  # fmt: skip
def _(s, sf):
    vids = fx.videos(s, sf).select(
        KEY, ramp(F.lit(512), F.col("id")).alias("clip"), ramp(F.lit(768), F.col("id")).alias("dino"),
        ramp(F.lit(128), F.col("id")).alias("audio"),
    )
    out = features.select_modalities(vids, "clip_dino")
    total = [F.round(F.aggregate(c, F.lit(0.0), lambda a, x: a + x), 6).alias(f"{c}_sum") for c in FAMILIES]
    return out.select(KEY, *[F.size(c).alias(f"{c}_dim") for c in FAMILIES], *total)


AUDIO = {
    "audio": f"SELECT video_id, win, batch, {SQL_RAMP.format(w=128, s='(win*31+length(video_id))')} AS vec FROM aud",
}
AUD = "SELECT video_id, CAST(cap_id AS INT) AS win, CAST(replace(video_id,'video','') AS BIGINT)//8 AS batch FROM fx_sentences WHERE cap_id <= length(caption) % 5"
# Number the kept captions of a video from 0: one audio window each.
AUD = f"SELECT video_id, batch, CAST(row_number() OVER (PARTITION BY video_id ORDER BY win)-1 AS INT) AS win FROM ({AUD})"
AUDIO = {"aud": AUD, **AUDIO}


def audio(s, sf) -> DataFrame:
    from framelark.functions.partitioned import dense_index

    kept = fx.sentences(s, sf).filter(F.col("cap_id") <= F.length("caption") % 5)
    idx = dense_index(kept, [KEY], F.floor(F.col("cap_id") / 4096), ["cap_id"], "win")
    number = F.replace(F.col(KEY), F.lit("video"), F.lit("")).cast("bigint")
    return idx.select(
        KEY, F.col("win").cast("int").alias("win"), F.floor(number / 8).alias("batch"),
        ramp(F.lit(128), F.col("win").cast("int") * 31 + F.length(KEY)).alias("vec"),
    )


def vec_sum(col="vec") -> F.Column:
    return F.round(F.aggregate(col, F.lit(0.0), lambda a, x: a + x), 6).alias("vec_sum")


@query("E8_audio_or_zero", with_views(["fx_videos", "fx_sentences"], {**CANON, **AUDIO}, """SELECT video_id, split, coalesce(win,0) AS win, 128 AS dim,
    round(coalesce(list_sum(vec),0e0),6) AS vec_sum FROM canon LEFT JOIN audio USING (video_id)"""))  # fmt: skip
def _(s, sf):
    out = features.audio_or_zero(fx.videos(s, sf), audio(s, sf).drop("batch"))
    return out.select(KEY, "split", "win", F.size("vec").alias("dim"), vec_sum())


@query("E9_chunk_windows", with_views(["fx_history"], {
    "h": "SELECT concat('video',run_id) AS video_id, epoch-1 AS pos, val_loss FROM fx_history",
    "b": "SELECT video_id, CAST(pos//96 AS INT) AS win, list(val_loss ORDER BY pos) AS v FROM h GROUP BY 1,2"},
    "SELECT video_id, win, 96 AS n, round(list_sum(v),8) AS total, round(v[1],8) AS first FROM b WHERE len(v)=96 OR win=0"))
def _(s, sf):
    hist = fx.history(s, sf).select(
        F.concat(F.lit("video"), F.col("run_id").cast("string")).alias(KEY), (F.col("epoch") - 1).alias("pos"), "val_loss"
    )
    out = features.chunk_windows(hist, "val_loss")
    total = F.aggregate("items", F.lit(0.0), lambda a, x: a + x)
    return out.select(KEY, "win", F.size("items").alias("n"), F.round(total, 8).alias("total"), F.round(F.col("items")[0], 8).alias("first"))


@query("E10_downmix", """SELECT concat('video',l_orderkey) AS video_id, l_linenumber AS t, round(avg(l_discount),6) AS sample FROM lineitem GROUP BY 1,2""")
def _(s, sf):
    li = fx.table(s, sf, "lineitem").select(
        F.concat(F.lit("video"), F.col("l_orderkey").cast("string")).alias(KEY),
        F.col("l_linenumber").alias("t"),
        F.col("l_discount").alias("sample"),
    )
    return features.downmix(li).select(KEY, "t", *r6("sample"))


PADDED = {
    **AUDIO,
    "sz": "SELECT batch, video_id, count(*) AS n FROM audio GROUP BY ALL",
    "mx": "SELECT batch, max(n) AS longest FROM sz GROUP BY 1",
    "grid": "SELECT batch, video_id, CAST(unnest(range(0,longest)) AS INT) AS win FROM sz JOIN mx USING (batch)",
    "pad": "SELECT batch, video_id, win, vec, CASE WHEN vec IS NULL THEN 0 ELSE 1 END AS mask FROM grid LEFT JOIN audio USING (batch, video_id, win)",
}


@query("E11_pad_audio", with_views(["fx_sentences"], PADDED, "SELECT batch, video_id, win, mask, round(coalesce(list_sum(vec),0e0),6) AS vec_sum FROM pad"))
def _(s, sf):
    return features.pad_audio(audio(s, sf)).select("batch", KEY, "win", "mask", vec_sum())


@query("E12_infer_mask", with_views(["fx_sentences"], PADDED, "SELECT video_id, win, mask FROM pad"))
def _(s, sf):
    padded = features.pad_audio(audio(s, sf)).drop("mask")
    return features.infer_mask(padded).select(KEY, "win", "mask")


@query("E12_any_valid", with_views(["fx_videos", "fx_sentences"], {**CANON, **AUDIO}, "SELECT video_id, bool_or(vec IS NOT NULL) AS has_audio FROM canon LEFT JOIN audio USING (video_id) GROUP BY 1"))
def _(s, sf):
    return features.any_valid(features.infer_mask(features.audio_or_zero(fx.videos(s, sf), audio(s, sf).drop("batch"))))


@query("E13_concat_sequences", with_views(["fx_sentences"], {**PADDED, "v": "SELECT video_id, CAST(cap_id AS INT) AS slot, length(caption) AS len FROM fx_sentences",
    "n": "SELECT video_id, count(*) AS o FROM v GROUP BY 1"},
    f"""SELECT video_id, slot AS pos, 1 AS attention, round(list_sum({SQL_RAMP.format(w=16, s='len')}),6) AS vec_sum FROM v
        UNION ALL SELECT video_id, CAST(win+coalesce(o,0) AS INT), mask, round(coalesce(list_sum(vec),0e0)*mask,6) FROM pad LEFT JOIN n USING (video_id)"""))  # fmt: skip
def _(s, sf):
    visual = fx.sentences(s, sf).select(KEY, F.col("cap_id").alias("slot"), ramp(F.lit(16), F.length("caption")).alias("vec"))
    out = features.concat_sequences(visual, features.pad_audio(audio(s, sf)).drop("batch"))
    return out.select(KEY, "pos", "attention", vec_sum())


@query("E14_pending_videos", with_views(["fx_files", "fx_videos"], CANON, """SELECT split, video_id FROM canon WHERE NOT (video_id IN (SELECT video_id FROM fx_files WHERE family='clip')
    AND video_id IN (SELECT video_id FROM fx_files WHERE family='dino'))"""))  # fmt: skip
def _(s, sf):
    return features.pending_videos(fx.videos(s, sf), fx.files(s, sf), ["clip", "dino"])


@query("E15_choose_source", with_views(["fx_files"], {"r": "SELECT DISTINCT CASE WHEN family='clip' THEN 'fused' ELSE 'split' END AS family, concat('/root',root_priority) AS root FROM fx_files"},
    "SELECT count(*) FILTER (family='fused') AS fused_roots, CASE WHEN count(*) FILTER (family='fused')>0 THEN 'fused' ELSE 'split' END AS source FROM r"))
def _(s, sf):
    roots = fx.files(s, sf).select(
        F.when(F.col("family") == "clip", "fused").otherwise("split").alias("family"),
        F.concat(F.lit("/root"), F.col("root_priority").cast("string")).alias("root"),
    )
    return features.choose_source(roots)


# --- run logs -------------------------------------------------------------


@query("G1_epoch_loss", """SELECT CAST(l_suppkey % 50 AS INT) AS run_id, l_linenumber AS epoch, round(avg(l_extendedprice/1.0e4),6) AS loss, count(*) AS batches FROM lineitem GROUP BY 1,2""")
def _(s, sf):
    log = fx.table(s, sf, "lineitem").select(
        (F.col("l_suppkey") % 50).cast("int").alias("run_id"), F.col("l_linenumber").alias("epoch"),
        (F.col("l_extendedprice") / 1.0e4).alias("loss"),
    )
    return runs.epoch_loss(log).select("run_id", "epoch", *r6("loss"), "batches")


@query("G2_checkpoint_flags", with_views(["fx_history"], {"p": """SELECT *, min(val_loss) OVER w AS lo, max(val_cider) OVER w AS hi FROM fx_history
    WINDOW w AS (PARTITION BY run_id ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"""},
    "SELECT run_id, epoch, lo IS NULL OR val_loss<lo AS best_loss, hi IS NULL OR val_cider>hi AS best_cider FROM p"))
def _(s, sf):
    return runs.checkpoint_flags(fx.history(s, sf)).select("run_id", "epoch", "best_loss", "best_cider")


BEST = "SELECT run_id, first(epoch ORDER BY val_loss, epoch) AS loss_epoch, min(val_loss) AS best_val_loss, first(epoch ORDER BY val_cider DESC, epoch) AS cider_epoch, max(val_cider) AS best_val_cider FROM fx_history GROUP BY 1"


@query("G3_best_epoch", with_views(["fx_history"], {}, BEST))
def _(s, sf):
    out = runs.best_epoch(fx.history(s, sf))
    return out.select("run_id", "loss_epoch", "best_val_loss", "cider_epoch", "best_val_cider")


@query("G3_periodic", with_views(["fx_history"], {}, "SELECT run_id, epoch FROM fx_history WHERE epoch % 10 = 0"))
def _(s, sf):
    return runs.periodic(fx.history(s, sf)).select("run_id", "epoch")


def summary(s, sf) -> DataFrame:
    """Best CIDEr per run; every seventh run has none."""
    best = runs.best_epoch(fx.history(s, sf))
    return best.select(
        "run_id", F.col("run_id").alias("ord"),
        F.when(F.col("run_id") % 7 == 0, None).otherwise(F.round("best_val_cider", 2)).alias("cider"),
        F.when(F.col("run_id") % 2 == 0, "frozen").otherwise("trained").alias("decoder"),
        F.element_at(F.array(F.lit("clip"), F.lit("clip_dino"), F.lit("clip_dino_audio")), F.col("run_id") % 3 + 1).alias("modalities"),
        "best_val_loss", "cider_epoch",
    )


SUMMARY = {
    "be": BEST,
    "sm": """SELECT run_id, run_id AS ord, CASE WHEN run_id % 7 = 0 THEN NULL ELSE round(best_val_cider,2) END AS cider,
             CASE WHEN run_id % 2 = 0 THEN 'frozen' ELSE 'trained' END AS decoder,
             (['clip','clip_dino','clip_dino_audio'])[run_id % 3 + 1] AS modalities, best_val_loss, cider_epoch FROM be""",
}


@query("G4_best_run", with_views(["fx_history"], SUMMARY, """SELECT decoder, modalities, run_id, cider FROM (SELECT *, row_number() OVER
    (PARTITION BY decoder, modalities ORDER BY coalesce(cider,-1) DESC, ord) AS k FROM sm) WHERE k=1"""))  # fmt: skip
def _(s, sf):
    return runs.best_run(summary(s, sf), ["decoder", "modalities"]).select("decoder", "modalities", "run_id", "cider")


@query("G5_ablation_summary", with_views(["fx_history"], SUMMARY, """SELECT concat('run',run_id) AS experiment, NULL AS dataset_mode, NULL AS selector, modalities,
    CASE WHEN run_id % 2 = 0 THEN true END AS freeze_decoder, 0e0 AS "Bleu_4", CASE WHEN run_id % 2 = 0 THEN coalesce(cider,0e0) ELSE 0e0 END AS "CIDEr",
    0e0 AS "ROUGE_L", 0e0 AS "METEOR", CASE WHEN run_id % 2 = 0 THEN cider_epoch END AS best_epoch, CASE WHEN run_id % 2 = 1 THEN best_val_loss END AS best_val_loss, NULL AS run_dir FROM sm"""))  # fmt: skip
def _(s, sf):
    base = summary(s, sf).withColumn("experiment", F.concat(F.lit("run"), F.col("run_id").cast("string")))
    frozen = base.filter("decoder = 'frozen'").select(
        "experiment", "modalities", F.lit(True).alias("freeze_decoder"), F.col("cider").alias("CIDEr"), F.col("cider_epoch").alias("best_epoch")
    )
    trained = base.filter("decoder = 'trained'").select("experiment", "modalities", "best_val_loss")
    return runs.ablation_summary([frozen, trained])


@query("G6_rank_runs", with_views(["fx_history"], SUMMARY, "SELECT run_id, cider, CAST(row_number() OVER (ORDER BY cider DESC NULLS LAST, ord) AS INT) AS place FROM sm"))
def _(s, sf):
    from pyspark.sql import Window as W

    # One row per run: a short report, so the place may come from one window.
    ranked = runs.rank_runs(summary(s, sf))
    order = W.orderBy(F.desc_nulls_last("cider"), "ord")
    return ranked.select("run_id", "cider", F.row_number().over(order).alias("place"))


@query("G7_compare_runs", with_views(["fx_history"], {
    "a": "SELECT run_id, round(max(val_cider),2) AS cider FROM fx_history WHERE epoch % 2 = 0 GROUP BY 1",
    "b": "SELECT run_id, round(max(val_cider),2) AS cider FROM fx_history WHERE epoch % 2 = 1 GROUP BY 1"},
    "SELECT run_id, a.cider AS cider_a, b.cider AS cider_b, CASE WHEN a.cider>b.cider THEN 'a' ELSE 'b' END AS winner, round(abs(a.cider-b.cider),6) AS gap FROM a JOIN b USING (run_id)"))
def _(s, sf):
    def best(rest: int) -> DataFrame:
        part = fx.history(s, sf).filter(F.col("epoch") % 2 == rest)
        return part.groupBy("run_id").agg(F.round(F.max("val_cider"), 2).alias("cider"))

    return runs.compare_runs(best(0), best(1)).select("run_id", "cider_a", "cider_b", "winner", *r6("gap"))


# --- readers and writers: written by Spark from the tables, then read back --


def _metadata_files(s, sf) -> str:
    """Metadata objects of 1,000 video numbers each, one object per file."""
    part = F.floor(F.replace(F.col(KEY), F.lit("video"), F.lit("")).cast("bigint") / 1000)
    video = F.struct(KEY, "id", "split", "category", F.col("start_time").alias("start time"), F.col("end_time").alias("end time"))
    vids = fx.videos(s, sf).groupBy(part.alias("part")).agg(F.collect_list(video).alias("videos"))
    order = F.array_sort(F.collect_list(F.struct("cap_id", KEY, "caption")))
    sents = fx.sentences(s, sf).groupBy(part.alias("part")).agg(order.alias("o")).select(
        "part", F.transform("o", lambda x: F.struct(x[KEY].alias(KEY), x["caption"].alias("caption"))).alias("sentences")
    )
    path = scratch_path(s, "metadata")
    both = vids.join(sents, "part", "left").select("part", F.to_json(F.struct("videos", F.coalesce("sentences", F.array().cast("array<struct<video_id:string,caption:string>>")).alias("sentences"))).alias("value"))
    both.repartition("part").write.partitionBy("part").option("lineSep", "\n").text(path)
    return path


@query("S1_metadata_videos", with_views(["fx_videos"], {}, "SELECT video_id, id, split, category, start_time, end_time FROM fx_videos"))
def _(s, sf):
    videos, _ = readers.read_metadata(s, _metadata_files(s, sf))
    return videos


@query("S1_metadata_sentences", with_views(["fx_sentences", "fx_videos"], {}, "SELECT * FROM fx_sentences"))
def _(s, sf):
    _, sentences = readers.read_metadata(s, _metadata_files(s, sf))
    return sentences


@query("S1_large_metadata_videos", with_views(["fx_videos"], {}, "SELECT video_id, id, split, category, start_time, end_time FROM fx_videos"))
def _(s, sf):
    videos, _ = readers.read_large_metadata(s, _metadata_files(s, sf))
    return videos


@query("S1_large_metadata_sentences", with_views(["fx_sentences", "fx_videos"], {}, "SELECT * FROM fx_sentences"))
def _(s, sf):
    _, sentences = readers.read_large_metadata(s, _metadata_files(s, sf))
    return sentences


@query("S2_read_captions", with_views(["fx_sentences"], {}, "SELECT video_id, CAST(cap_id AS BIGINT) AS cap_id, caption FROM fx_sentences"))
def _(s, sf):
    """Half of the folder holds caption maps, the other half metadata."""
    number = F.replace(F.col(KEY), F.lit("video"), F.lit("")).cast("bigint")
    sent = fx.sentences(s, sf).withColumn("part", F.floor(number / 20))
    lists = sent.groupBy("part", KEY).agg(F.array_sort(F.collect_list(F.struct("cap_id", "caption"))).alias("o"))
    lists = lists.select("part", KEY, F.transform("o", lambda x: x["caption"]).alias("caps"))
    maps = lists.filter("part % 2 = 0").groupBy("part").agg(
        F.to_json(F.map_from_entries(F.collect_list(F.struct(KEY, "caps")))).alias("value")
    )
    full = (
        sent.filter("part % 2 = 1").groupBy("part")
        .agg(F.array_sort(F.collect_list(F.struct("cap_id", KEY, "caption"))).alias("o"))
        .select("part", F.to_json(F.struct(F.transform("o", lambda x: F.struct(x[KEY].alias(KEY), x["caption"].alias("caption"))).alias("sentences"))).alias("value"))
    )
    path = scratch_path(s, "captions")
    maps.unionByName(full).repartition("part").write.partitionBy("part").text(path)
    return readers.read_captions(s, path)


@query("S3_read_predictions", with_views(["fx_pred"], {}, "SELECT video_id, caption FROM fx_pred"))
def _(s, sf):
    number = F.replace(F.col(KEY), F.lit("video"), F.lit("")).cast("bigint")
    one = F.struct(F.col(KEY), F.array(F.struct(F.col(KEY).alias("image_id"), "caption")))
    files = fx.predictions(s, sf).groupBy(F.floor(number / 50).alias("part")).agg(
        F.to_json(F.map_from_entries(F.collect_list(one))).alias("value")
    )
    path = scratch_path(s, "predictions")
    files.repartition("part").write.partitionBy("part").text(path)
    return readers.read_predictions(s, path)


@query("S4_clean_prompts", r"""WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents),
    e AS (SELECT doc_id*1000000+i-1 AS ord, regexp_replace(ls[i],'^\s+|\s+$','','g') AS prompt FROM (SELECT *, unnest(range(1,len(ls)+1)) AS i FROM l))
    SELECT min(ord) AS ord, prompt FROM e WHERE prompt<>'' AND NOT starts_with(prompt,'#') GROUP BY prompt""")
def _(s, sf):
    lines = fx.table(s, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return readers.clean_prompts(lines.select((F.col("doc_id") * 1000000 + F.col("pos")).alias("ord"), "line"))


@query("S6_parse_feature_blobs", """SELECT concat('vec',vec_id) AS video_id, 0 AS pos, CAST(len(embedding) AS INT) AS dim,
    round(list_sum(CAST(embedding AS DOUBLE[])),6) AS vec_sum FROM embeddings""")
def _(s, sf):
    @F.pandas_udf(BinaryType())
    def to_npy(vecs):
        import io

        import numpy as np
        import pandas as pd

        out = []
        for v in vecs:
            buf = io.BytesIO()
            np.save(buf, np.asarray(v, dtype="float32").reshape(1, -1))
            out.append(buf.getvalue())
        return pd.Series(out)

    blobs = fx.table(s, sf, "embeddings").select(
        F.concat(F.lit("vec"), F.col("vec_id").cast("string")).alias(KEY), to_npy("embedding").alias("content")
    )
    out = readers.parse_feature_blobs(blobs)
    total = F.aggregate(F.col("vec").cast("array<double>"), F.lit(0.0), lambda a, x: a + x)
    return out.select(KEY, "pos", F.size("vec").alias("dim"), F.round(total, 6).alias("vec_sum"))


@query("S6_parse_matrices", """SELECT concat('label',label) AS video_id, CAST(row_number() OVER (PARTITION BY label ORDER BY vec_id)-1 AS INT) AS pos, CAST(len(embedding) AS INT) AS dim,
    round(list_sum(CAST(embedding AS DOUBLE[])),6) AS vec_sum FROM embeddings""")
def _(s, sf):
    """Vectors of a label as one matrix, in files of blocks, written and read by the NumPy source."""
    path = scratch_path(s, "matrices")
    rows = fx.table(s, sf, "embeddings").select(F.concat(F.lit("label"), F.col("label").cast("string")).alias(KEY), "vec_id", F.col("embedding").alias("vec"))
    numpy_source.write_matrices(dense_index(rows, [KEY], block_of("vec_id"), ["vec_id"], "pos"), path)
    out = numpy_source.read_matrices(s, path)
    total = F.aggregate(F.col("vec").cast("array<double>"), F.lit(0.0), lambda a, x: a + x)
    return out.select(KEY, "pos", F.size("vec").alias("dim"), F.round(total, 6).alias("vec_sum"))


@query("K1_write_split_captions", with_views(["fx_videos", "fx_sentences"], CANON, "SELECT split, video_id, cap_id, caption FROM fx_sentences JOIN canon USING (video_id)"))
def _(s, sf):
    path = scratch_path(s, "split-captions")
    sinks.write_split_captions(captions.captions_by_split(fx.videos(s, sf), fx.sentences(s, sf)), path)
    return s.read.parquet(path)


@query("K2_write_features", with_views(["fx_files", "fx_videos"], CANON, """SELECT family, split, count(*) AS n, count(DISTINCT video_id) AS videos
    FROM fx_files JOIN canon USING (video_id) GROUP BY 1,2"""))  # fmt: skip
def _(s, sf):
    path = scratch_path(s, "features")
    vids = splits.canonical_splits(fx.videos(s, sf)).select(KEY, "split")
    sinks.write_features(fx.files(s, sf).join(vids, KEY), path)
    back = s.read.parquet(path).groupBy("family", "split")
    return back.agg(F.count(F.lit(1)).alias("n"), F.countDistinct(KEY).alias("videos"))


def run_manifest(s, sf) -> DataFrame:
    """Done: has a dino file. Failed: has an audio file but no clip file."""
    files = fx.files(s, sf)
    flags = files.groupBy(KEY).agg(*[F.bool_or(F.col("family") == f).alias(f) for f in FAMILIES])
    failed = flags.filter("audio AND NOT clip").select(KEY, F.lit("no clip file").alias("error"))
    results = fx.videos(s, sf).select(KEY, F.round(F.col("end_time") - F.col("start_time"), 4).alias("duration_sec"))
    return sinks.manifest(fx.videos(s, sf), files.filter("family = 'dino'"), results, failed)


MANIFEST = {
    "fl": "SELECT video_id, bool_or(family='clip') AS clip, bool_or(family='dino') AS dino, bool_or(family='audio') AS audio FROM fx_files GROUP BY 1",
    "mf": """SELECT video_id, CASE WHEN audio AND NOT clip THEN 'no clip file' END AS error, round(end_time-start_time,4) AS duration_sec,
             CASE WHEN dino THEN 'skipped_existing' WHEN audio AND NOT clip THEN 'failed' ELSE 'ok' END AS status FROM fx_videos LEFT JOIN fl USING (video_id)""",
}


@query("K5_manifest", with_views(["fx_files", "fx_videos"], MANIFEST, "SELECT * FROM mf"))
def _(s, sf):
    return run_manifest(s, sf)


@query("K5_manifest_summary", with_views(["fx_files", "fx_videos"], MANIFEST, """SELECT count(*) AS processed_videos, count(*) FILTER (status='ok') AS successful_videos,
    count(*) FILTER (status='skipped_existing') AS skipped_videos, count(*) FILTER (status='failed') AS failed_videos FROM mf"""))  # fmt: skip
def _(s, sf):
    return sinks.manifest_summary(run_manifest(s, sf))


@query("K6_write_failures", with_views(["fx_files", "fx_videos"], MANIFEST, "SELECT video_id, error FROM mf WHERE status='failed'"))
def _(s, sf):
    path = scratch_path(s, "failures")
    sinks.write_failures(run_manifest(s, sf).filter("status = 'failed'"), path)
    return s.read.schema("video_id string, error string").json(path)


@query("K7_write_metrics", with_views(["fx_videos"], {}, """SELECT category, count(*) AS num_train_videos, round(avg(end_time-start_time),6) AS avg_train_duration_sec
    FROM fx_videos WHERE split='train' GROUP BY 1"""))  # fmt: skip
def _(s, sf):
    path = scratch_path(s, "metrics")
    rows = splits.train_length_by_category(fx.videos(s, sf))
    sinks.write_metrics(rows.select("category", "num_train_videos", *r6("avg_train_duration_sec")), path)
    types = ", ".join(f"{c} {'int' if c == 'category' else 'bigint' if c.startswith('num') else 'double'}" for c in sinks.CATEGORY_COLUMNS)
    return s.read.schema(types).option("header", True).csv(path).select("category", "num_train_videos", "avg_train_duration_sec")


@query("K8_write_id_list", with_views(["fx_videos", "fx_sentences"], CANON, "SELECT split, video_id AS value FROM canon WHERE video_id NOT IN (SELECT video_id FROM fx_sentences)"))
def _(s, sf):
    path = scratch_path(s, "ids")
    sinks.write_id_list(captions.missing_captions(fx.videos(s, sf), fx.sentences(s, sf)), path)
    return s.read.schema("value string, split string").text(path)


# --- streams ---------------------------------------------------------------


def event_stream(s, sf) -> DataFrame:
    return streams.table_stream(s, f"{sf}/events.parquet", EVENT).select(
        F.concat(F.lit("video"), F.col("user_id").cast("string")).alias(KEY),
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("event_type").alias("status"),
    )


@query("T1_stream_pending", """SELECT DISTINCT concat('video',user_id) AS video_id, CASE WHEN user_id % 17 = 0 THEN 'unreadable' END AS error FROM events""")
def _(s, sf):
    def process(batch: DataFrame) -> DataFrame:
        number = F.replace(F.col(KEY), F.lit("video"), F.lit("")).cast("bigint")
        return batch.select(KEY, F.when(number % 17 == 0, "unreadable").alias("error"))

    done, failed, state = (scratch_path(s, n) for n in ("done", "failed", "pending-state"))
    streams.stream_pending(event_stream(s, sf), process, done, failed, state)
    good = s.read.schema("video_id string, error string").parquet(done).select(KEY, "error")
    return good.union(s.read.schema("video_id string, error string").json(failed).select(KEY, "error"))


@query("T2_stream_manifest", "SELECT strftime(date_trunc('hour', ts),'%Y-%m-%d %H') AS hour, event_type AS status, count(*) AS n FROM events GROUP BY 1,2")
def _(s, sf):
    out = streams.run_to_table(streams.stream_manifest(event_stream(s, sf)), "manifest", "update", ["hour", "status"])
    return out.select(F.date_format("hour", "yyyy-MM-dd HH").alias("hour"), "status", "n")


@query("T3_stream_frame_change", """SELECT concat('video',label) AS video_id, CAST(vec_id AS INT) AS sample_index,
    round(CASE WHEN p IS NULL THEN 0e0 ELSE 1e0-list_dot_product(p,e)/(sqrt(list_dot_product(p,p))*sqrt(list_dot_product(e,e))) END,6) AS change
    FROM (SELECT *, lag(e) OVER (PARTITION BY label ORDER BY vec_id) AS p FROM (SELECT *, CAST(embedding AS DOUBLE[]) AS e FROM embeddings))""")
def _(s, sf):
    schema = s.read.parquet(f"{sf}/embeddings.parquet").schema
    feed = streams.table_stream(s, f"{sf}/embeddings.parquet", schema).select(
        F.concat(F.lit("video"), F.col("label").cast("string")).alias(KEY),
        F.col("vec_id").cast("int").alias("sample_index"),
        F.col("embedding").cast("array<double>").alias("vec"),
    )
    out = streams.run_to_table(streams.stream_frame_change(feed), "change")
    return out.select(KEY, "sample_index", *r6("change"))


# --- joins on time -----------------------------------------------------------


def timed(s, sf, kind: str, name: str) -> DataFrame:
    """Events of one kind as ``video_id``, time in seconds and number; at one time of a video the largest number."""
    seconds = F.col("ts").cast("timestamp").cast("double")
    rows = fx.table(s, sf, "events").filter(F.col("event_type") == kind)
    rows = rows.select(F.concat(F.lit("video"), F.col("user_id").cast("string")).alias(KEY), seconds.alias(f"{name}_sec"), F.col("event_id").alias(name))
    return rows.groupBy(KEY, f"{name}_sec").agg(F.max(name).alias(name))


TIMED = ", ".join(
    f"{name} AS (SELECT concat('video',user_id) AS video_id, ts, max(event_id) AS {name} FROM events WHERE event_type='{kind}' GROUP BY 1, 2)"
    for kind, name in (("click", "frame"), ("view", "scene"), ("purchase", "audio"))
)


@query("W7_frames_in_scenes", f"""WITH {TIMED} SELECT f.video_id, frame, scene FROM frame f LEFT JOIN scene s
    ON f.video_id = s.video_id AND f.ts >= s.ts AND f.ts < s.ts + INTERVAL 6 HOUR""")
def _(s, sf):
    scenes = timed(s, sf, "view", "scene").withColumn("end_sec", F.col("scene_sec") + 6 * 3600)
    out = temporal.interval_join(timed(s, sf, "click", "frame"), scenes, [KEY], "frame_sec", "scene_sec", "end_sec", 4 * 3600.0, "left")
    return out.select(KEY, "frame", "scene")


@query("E16_audio_before_frame", f"""WITH {TIMED} SELECT f.video_id, frame, audio FROM frame f ASOF LEFT JOIN audio a ON f.video_id = a.video_id AND f.ts >= a.ts""")
def _(s, sf):
    out = temporal.asof_join(timed(s, sf, "click", "frame"), timed(s, sf, "purchase", "audio"), [KEY], "frame_sec", "audio_sec", ["audio"], 86400.0)
    return out.select(KEY, "frame", "audio")


@query("E16_audio_nearest_frame", f"""WITH {TIMED}, near AS (SELECT frame, arg_min(audio, struct_pack(d := abs(epoch_us(f.ts) - epoch_us(a.ts)), t := a.ts)) AS audio
    FROM frame f JOIN audio a ON f.video_id = a.video_id WHERE abs(epoch_us(f.ts) - epoch_us(a.ts)) <= 43200000000 GROUP BY 1)
    SELECT video_id, frame, audio FROM frame LEFT JOIN near USING (frame)""")
def _(s, sf):
    frames, audio = timed(s, sf, "click", "frame"), timed(s, sf, "purchase", "audio")
    out = temporal.asof_join(frames, audio, [KEY], "frame_sec", "audio_sec", ["audio"], 86400.0, "nearest", 43200.0)
    return out.select(KEY, "frame", "audio")
