"""Queries of the frame side: signals, scenes, selection."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from checks import fixtures as fx
from checks.fixtures import with_views
from checks.registry import query
from framelark.functions.partitioned import dense_index
from framelark.functions.storage import write_through
from framelark.functions.vectors import l2_normalize
from framelark.operators import features, scenes, selection, signals, similarity, splits
from framelark.plans.keyframes import ABLATION, KeyframeConfig, extract_keyframes
from framelark.sources import sinks

KEY = "video_id"
IDX = "CAST(sample_index AS INT) AS sample_index"


def stored_signals(s, sf) -> DataFrame:
    """The signal view as a stored table, as a frame table would be."""
    return write_through(fx.signals(s, sf), "signals")


def fused(s, sf) -> DataFrame:
    return signals.fuse_embeddings(fx.unit_frames(s, sf))


def r6(*cols: str):
    return [F.round(c, 6).alias(c) for c in cols]


def items(df: DataFrame, keys: list[str], vec: str) -> DataFrame:
    """One row per vector item, rounded."""
    return df.select(*keys, F.posexplode(vec).alias("pos", "x")).select(
        *keys, F.col("pos").cast("int").alias("pos"), F.round("x", 6).alias("x")
    )


def sql_items(keys: str, vec: str, src: str) -> str:
    return (
        f"SELECT {keys}, CAST(i-1 AS INT) AS pos, round({vec}[i], 6) AS x "
        f"FROM (SELECT *, unnest(range(1, len({vec})+1)) AS i FROM {src})"
    )


UNIT = "list_transform({v}, lambda x: x/greatest(sqrt(list_dot_product({v},{v})),1e-8))"
FUSED = {
    "fz": f"""SELECT * EXCLUDE (v), {UNIT.format(v='v')} AS fused FROM (SELECT *, list_concat(
              list_transform(clip, lambda x: x*0.55e0), list_transform(dino, lambda x: x*0.45e0)) AS v FROM fx_unit)"""
}
DIST = {
    **FUSED,
    "nb": """SELECT *, CASE WHEN pv IS NOT NULL THEN 1e0-greatest(-1e0,least(1e0,list_dot_product(pv,fused))) END AS pd,
             CASE WHEN nv IS NOT NULL THEN 1e0-greatest(-1e0,least(1e0,list_dot_product(nv,fused))) END AS nd
             FROM (SELECT *, lag(fused) OVER w AS pv, lead(fused) OVER w AS nv FROM fz
                   WINDOW w AS (PARTITION BY video_id ORDER BY sample_index))""",
    "change": """SELECT *, (coalesce(pd,0e0)+coalesce(nd,0e0))/greatest((pd IS NOT NULL)::INT+(nd IS NOT NULL)::INT,1) AS semantic_raw,
                 coalesce(pd,0e0) AS boundary_raw FROM nb""",
}
PAIRS = {
    "sim": """SELECT a.video_id, a.sample_index AS i, b.sample_index AS j,
              greatest(-1e0, least(1e0, list_dot_product(a.fused, b.fused))) AS s
              FROM fz a JOIN fz b ON a.video_id=b.video_id""",
    "rar": """SELECT video_id, i AS sample_index, coalesce(1e0-avg(s) FILTER (rk<=5 AND i<>j), 0e0) AS rarity_raw
              FROM (SELECT *, row_number() OVER (PARTITION BY video_id, i ORDER BY (i=j), s DESC, j) AS rk FROM sim) GROUP BY 1,2""",
}
ALIGN = {
    "al": """SELECT video_id, sample_index, max(list_dot_product(clip, embedding)) AS prompt_raw
             FROM fx_unit, fx_prompts GROUP BY 1,2"""
}


def minmax_sql(col: str, out: str, src: str) -> str:
    lo = f"quantile_cont({col},0.05e0) OVER (PARTITION BY video_id)"
    hi = f"quantile_cont({col},0.95e0) OVER (PARTITION BY video_id)"
    return f"CASE WHEN {hi}-{lo}<1e-8 THEN 0e0 ELSE greatest(0e0,least(1e0,({col}-{lo})/({hi}-{lo}))) END AS {out}"


SCALED = [
    ("semantic_raw", "semantic_change"), ("boundary_raw", "boundary_score"), ("motion_raw", "motion_score"),
    ("histogram_diff_raw", "histogram_score"), ("quality_raw", "quality_score"), ("rarity_raw", "rarity_score"),
    ("prompt_raw", "prompt_alignment"),
]
SCORED = {
    **DIST,
    **PAIRS,
    **ALIGN,
    "raws": "SELECT * FROM change JOIN rar USING (video_id, sample_index) JOIN al USING (video_id, sample_index)",
    "norm": "SELECT *, " + ", ".join(minmax_sql(a, b, "raws") for a, b in SCALED) + " FROM raws",
    "sc": """SELECT *, 0.34e0*semantic_change+0.16e0*motion_score+0.06e0*histogram_score+0.14e0*quality_score
             +0.14e0*rarity_score+0.22e0*prompt_alignment AS local_importance FROM norm""",
}
SCORE_COLS = [b for _, b in SCALED] + ["local_importance"]


def scored(s, sf) -> DataFrame:
    return signals.score_frames(fused(s, sf), fx.prompts(s, sf))


# --- signals -------------------------------------------------------------


@query(
    "D1_rgb_histogram",
    with_views(["fx_pixels"], {
        "b": "SELECT video_id, frame_index, (r//32)*64+(g//32)*8+(b//32) AS pos FROM fx_pixels",
        "c": "SELECT video_id, frame_index, pos, count(*) AS c FROM b GROUP BY ALL",
        "f": "SELECT video_id, frame_index, count(*) AS n FROM b GROUP BY ALL",
        "g": "SELECT video_id, frame_index, n, unnest(range(0,512)) AS pos FROM f",
    }, """SELECT video_id, frame_index, CAST(g.pos AS INT) AS pos, round(coalesce(c.c,0)/n,6) AS x
          FROM g LEFT JOIN c USING (video_id, frame_index, pos)"""),
)
def _(s, sf):
    return items(signals.rgb_histogram(fx.pixels(s, sf)), [KEY, "frame_index"], "hist")


@query(
    "D2_histogram_diff",
    with_views(["fx_pixels"], {
        "b": "SELECT video_id, frame_index, (r//32)*64+(g//32)*8+(b//32) AS pos FROM fx_pixels",
        "c": "SELECT video_id, frame_index, pos, count(*) AS c FROM b GROUP BY ALL",
        "f": "SELECT video_id, frame_index, count(*) AS n FROM b GROUP BY ALL",
        "d": """SELECT video_id, frame_index, g.pos, coalesce(c.c,0)/n AS x
                FROM (SELECT *, unnest(range(0,512)) AS pos FROM f) g LEFT JOIN c USING (video_id, frame_index, pos)""",
        "m": "SELECT *, x-avg(x) OVER (PARTITION BY video_id, frame_index) AS xc FROM d",
        "p": "SELECT *, lag(xc) OVER (PARTITION BY video_id, pos ORDER BY frame_index) AS yc FROM m",
    }, """SELECT video_id, frame_index, round(CASE WHEN count(yc)=0 THEN 0e0
              ELSE 1e0-sum(xc*yc)/(sqrt(sum(xc*xc))*sqrt(sum(yc*yc))) END, 6) AS histogram_diff_raw
          FROM p GROUP BY 1,2"""),
)
def _(s, sf):
    hist = signals.rgb_histogram(fx.pixels(s, sf))
    idx = dense_index(hist, [KEY], F.floor(F.col("frame_index") / 4096), ["frame_index"], "sample_index")
    return signals.histogram_diff(idx).select(KEY, "frame_index", *r6("histogram_diff_raw"))


@query(
    "D3_frame_quality",
    with_views(["fx_frames"], {}, f"""SELECT video_id, {IDX}, round(exposure_raw,6) AS exposure_raw,
        round(quality_raw,6) AS quality_raw FROM fx_frames"""),
)
def _(s, sf):
    base = fx.frames(s, sf).drop("exposure_raw", "quality_raw")
    return signals.frame_quality(base).select(KEY, "sample_index", *r6("exposure_raw", "quality_raw"))


@query("D4_l2_normalize", with_views(["fx_unit"], {}, sql_items("video_id, sample_index", "clip", "fx_unit")))
def _(s, sf):
    df = fx.frames(s, sf).withColumn("clip", l2_normalize(F.col("clip")))
    return items(df, [KEY, "sample_index"], "clip")


@query("D5_fuse_embeddings", with_views(["fx_unit"], FUSED, sql_items("video_id, sample_index", "fused", "fz")))
def _(s, sf):
    return items(fused(s, sf), [KEY, "sample_index"], "fused")


@query(
    "D6_similarity_profile",
    with_views(["fx_unit"], {**FUSED, "sim": PAIRS["sim"]}, """SELECT video_id, CAST(i AS BIGINT) AS sample_index, count(*) FILTER (i<>j) AS others,
        round(avg(s) FILTER (i<>j),6) AS mean_sim, round(max(s) FILTER (i<>j),6) AS max_sim, round(min(s) FILTER (i<>j),6) AS min_sim
        FROM sim GROUP BY 1,2"""),
)
def _(s, sf):
    return similarity.similarity_profile(fused(s, sf), [KEY]).select(
        KEY, "sample_index", "others", *r6("mean_sim", "max_sim", "min_sim")
    )


@query(
    "D7_semantic_change",
    with_views(["fx_unit"], DIST, f"SELECT video_id, {IDX}, round(semantic_raw,6) AS semantic_raw FROM change"),
)
def _(s, sf):
    return signals.semantic_change(fused(s, sf)).select(KEY, "sample_index", *r6("semantic_raw"))


@query(
    "D8_boundary_strength",
    with_views(["fx_unit"], DIST, f"SELECT video_id, {IDX}, round(boundary_raw,6) AS boundary_raw FROM change"),
)
def _(s, sf):
    return signals.boundary_strength(fused(s, sf)).select(KEY, "sample_index", *r6("boundary_raw"))


@query(
    "D9_knn_rarity",
    with_views(["fx_unit"], {**FUSED, **PAIRS}, "SELECT video_id, CAST(sample_index AS BIGINT) AS sample_index, round(rarity_raw,6) AS rarity FROM rar"),
)
def _(s, sf):
    return similarity.knn_rarity(fused(s, sf), [KEY]).select(KEY, "sample_index", *r6("rarity"))


@query(
    "D10_prompt_alignment",
    with_views(["fx_unit", "fx_prompts"], ALIGN, f"SELECT video_id, {IDX}, round(prompt_raw,6) AS prompt_raw FROM al"),
)
def _(s, sf):
    return signals.prompt_alignment(fx.unit_frames(s, sf), fx.prompts(s, sf)).select(KEY, "sample_index", *r6("prompt_raw"))


@query(
    "D11_robust_minmax",
    with_views(["fx_signals"], {}, "SELECT video_id, sample_index, " + ", ".join(
        f"round({n},6) AS {n}" for n in ("motion_score", "quality_score")) + " FROM (SELECT *, "
        + minmax_sql("motion_raw", "motion_score", "") + ", " + minmax_sql("quality_raw", "quality_score", "") + " FROM fx_signals)"),
)
def _(s, sf):
    out = signals.robust_minmax(stored_signals(s, sf), {"motion_raw": "motion_score", "quality_raw": "quality_score"})
    return out.select(KEY, "sample_index", *r6("motion_score", "quality_score"))


@query(
    "D12_score_frames",
    with_views(["fx_unit", "fx_prompts"], SCORED, f"SELECT video_id, {IDX}, " + ", ".join(
        f"round({c},6) AS {c}" for c in SCORE_COLS) + " FROM sc"),
)
def _(s, sf):
    return scored(s, sf).select(KEY, "sample_index", *r6(*SCORE_COLS))


POOL = """SELECT video_id, i-1 AS pos, avg({v}[i]) AS x FROM (SELECT *, unnest(range(1,33)) AS i FROM fx_unit) GROUP BY ALL"""


@query(
    "D14_mean_pool",
    with_views(["fx_unit"], {}, f"SELECT video_id, CAST(pos AS INT) AS pos, round(x,6) AS x FROM ({POOL.format(v='clip')})"),
)
def _(s, sf):
    return items(features.mean_pool(fx.unit_frames(s, sf), [KEY], "clip"), [KEY], "pooled")


@query(
    "D15_concat_pooled",
    with_views(["fx_unit"], {}, f"""SELECT video_id, CAST(pos AS INT) AS pos, round(x,6) AS x FROM ({POOL.format(v='clip')})
        UNION ALL SELECT video_id, CAST(pos+32 AS INT), round(x,6) FROM ({POOL.format(v='dino')})"""),
)
def _(s, sf):
    u = fx.unit_frames(s, sf)
    out = features.concat_pooled(features.mean_pool(u, [KEY], "clip"), features.mean_pool(u, [KEY], "dino"))
    return items(out, [KEY], "pooled")


# --- scenes --------------------------------------------------------------

PEAKS = {
    "nbr": """SELECT *, lag(boundary_raw) OVER w AS p, lead(boundary_raw) OVER w AS q, count(*) OVER (PARTITION BY video_id) AS n
              FROM fx_signals WINDOW w AS (PARTITION BY video_id ORDER BY sample_index)""",
    "peaks": """SELECT video_id, sample_index, timestamp_sec, boundary_raw FROM nbr WHERE CASE WHEN n<3 THEN sample_index>=1
                ELSE p IS NOT NULL AND q IS NOT NULL AND boundary_raw>=p AND boundary_raw>q END""",
    "thr": """SELECT video_id, count(*) AS samples, CASE WHEN count(*)>2 THEN quantile_cont(boundary_raw,0.92e0) FILTER (sample_index>0)
              ELSE 1e0 END AS threshold FROM fx_signals GROUP BY 1""",
}
STARTS = {
    **PEAKS,
    "cand": """SELECT video_id, sample_index, timestamp_sec AS t FROM peaks JOIN thr USING (video_id) WHERE boundary_raw>=threshold
               UNION ALL SELECT video_id, 0, min(timestamp_sec) FROM fx_signals GROUP BY 1""",
    "hop": """SELECT a.video_id, a.sample_index AS at, min(b.sample_index) AS nxt FROM cand a JOIN cand b
              ON a.video_id=b.video_id AND b.sample_index>a.sample_index AND b.t-a.t>=2e0 GROUP BY 1,2""",
    "starts": """SELECT video_id, 0 AS sample_index FROM thr UNION ALL
                 SELECT hop.video_id, nxt FROM starts s JOIN hop ON s.video_id=hop.video_id AND s.sample_index=hop.at""",
}
COARSE = {
    **STARTS,
    "lab": """SELECT f.video_id, f.sample_index, f.timestamp_sec, CAST(sum(CASE WHEN st.sample_index IS NULL THEN 0 ELSE 1 END)
              OVER (PARTITION BY f.video_id ORDER BY f.sample_index)-1 AS INT) AS scene_id
              FROM fx_signals f LEFT JOIN starts st USING (video_id, sample_index)""",
    "scn": """SELECT video_id, scene_id, CAST(min(sample_index) AS INT) AS start_idx, CAST(max(sample_index)+1 AS INT) AS end_idx,
              min(timestamp_sec) AS start_sec, max(timestamp_sec) AS end_sec, count(*) AS frames,
              max(timestamp_sec)-min(timestamp_sec) AS duration FROM lab GROUP BY 1,2""",
    "cuts": """SELECT DISTINCT video_id, c AS sample_index FROM (
               SELECT video_id, start_idx, end_idx, CAST(start_idx+round_even((end_idx-start_idx)*(p*1e0/pieces),0) AS INT) AS c
               FROM (SELECT *, CAST(ceil(duration/5e0) AS INT) AS pieces, unnest(range(1, CAST(ceil(duration/5e0) AS INT))) AS p
                     FROM scn WHERE duration>5e0 AND end_idx-start_idx>1)) WHERE c>start_idx AND c<end_idx""",
}
VALUE = "boundary_raw"


@query("W1_local_peaks", with_views(["fx_signals"], PEAKS, "SELECT video_id, sample_index FROM peaks"))
def _(s, sf):
    return scenes.local_peaks(stored_signals(s, sf), VALUE).select(KEY, "sample_index")


@query(
    "W2_boundary_threshold",
    with_views(["fx_signals"], PEAKS, "SELECT video_id, samples, round(threshold,6) AS threshold FROM thr"),
)
def _(s, sf):
    return scenes.boundary_threshold(stored_signals(s, sf), value=VALUE).select(KEY, "samples", *r6("threshold"))


@query("W3_scene_starts", with_views(["fx_signals"], STARTS, "SELECT video_id, CAST(sample_index AS INT) AS sample_index FROM starts", recursive=True))
def _(s, sf):
    return scenes.scene_starts(stored_signals(s, sf), value=VALUE).select(KEY, "sample_index")


def coarse(s, sf) -> DataFrame:
    sig = stored_signals(s, sf)
    return scenes.scene_table(scenes.assign_scenes(sig, scenes.scene_starts(sig, value=VALUE)))


@query("W4_split_long_scenes", with_views(["fx_signals"], COARSE, "SELECT * FROM cuts", recursive=True))
def _(s, sf):
    return scenes.split_long_scenes(coarse(s, sf), 5.0)


@query("W5_assign_scenes", with_views(["fx_signals"], COARSE, "SELECT * FROM scn", recursive=True))
def _(s, sf):
    return coarse(s, sf)


DURATION = "SELECT video_id, max(timestamp_sec)+0.5e0 AS duration_sec FROM fx_signals GROUP BY 1"


@query(
    "W6_raw_budget",
    with_views(["fx_signals"], {**PEAKS, "dur": DURATION,
        "st": """SELECT video_id, samples, sqrt(greatest(duration_sec,1e-6)/14.78e0) AS df,
                 CASE WHEN samples>2 THEN avg(CASE WHEN boundary_raw>=threshold THEN 1e0 ELSE 0e0 END) FILTER (sample_index>0) ELSE 0e0 END AS bd
                 FROM fx_signals JOIN thr USING (video_id) JOIN dur USING (video_id) GROUP BY video_id, samples, duration_sec"""},
        """SELECT video_id, round(df,6) AS duration_factor, round(1e0+0.75e0*bd,6) AS complexity_factor, round(bd,6) AS boundary_density,
           CAST(least(least(greatest(round_even(40e0*df*(1e0+0.75e0*bd),0),40e0),96e0),samples) AS INT) AS raw_budget FROM st"""),
)
def _(s, sf):
    sig = stored_signals(s, sf)
    dur = sig.groupBy(KEY).agg((F.max("timestamp_sec") + 0.5).alias("duration_sec"))
    return scenes.raw_budget(sig, dur, value=VALUE).select(
        KEY, *r6("duration_factor", "complexity_factor", "boundary_density"), "raw_budget"
    )


# --- selection -----------------------------------------------------------

# Scenes of ten frames and an importance from the raw signals keep the SQL readable.
PLAIN = {
    **FUSED,
    "pf": """SELECT video_id, sample_index, timestamp_sec, fused, CAST(sample_index//10 AS INT) AS scene_id,
             motion_raw+0.1e0*abs(histogram_diff_raw) AS local_importance, motion_raw AS prompt_alignment,
             abs(histogram_diff_raw) AS boundary_score FROM fz""",
    "insc": """SELECT a.video_id, a.scene_id, a.sample_index, avg(greatest(0e0,least(1e0,list_dot_product(a.fused,b.fused)))) AS centrality
               FROM pf a JOIN pf b ON a.video_id=b.video_id AND a.scene_id=b.scene_id GROUP BY 1,2,3""",
}


def plain(s, sf) -> DataFrame:
    return fused(s, sf).select(
        KEY, "sample_index", "timestamp_sec", "fused",
        F.floor(F.col("sample_index") / 10).cast("int").alias("scene_id"),
        (F.col("motion_raw") + 0.1 * F.abs("histogram_diff_raw")).alias("local_importance"),
        F.col("motion_raw").alias("prompt_alignment"),
        F.abs("histogram_diff_raw").alias("boundary_score"),
    )


@query(
    "L1_scene_seeds",
    with_views(["fx_unit"], {**PLAIN,
        "best": """SELECT video_id, scene_id, sample_index FROM (SELECT pf.*, row_number() OVER (PARTITION BY pf.video_id, pf.scene_id
                   ORDER BY 0.65e0*local_importance+0.35e0*centrality DESC, pf.sample_index) AS rk
                   FROM pf JOIN insc ON pf.video_id=insc.video_id AND pf.sample_index=insc.sample_index) WHERE rk=1""",
        "str": """SELECT video_id, scene_id, avg(local_importance)+0.35e0*max(local_importance)+0.05e0*ln(1e0+count(*)) AS strength
                  FROM pf GROUP BY 1,2""",
        "rk": """SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY strength DESC, scene_id) AS seed_rank
                 FROM best JOIN str USING (video_id, scene_id)"""},
        f"SELECT video_id, scene_id, {IDX}, round(strength,6) AS strength, CAST(seed_rank AS INT) AS seed_rank FROM rk WHERE seed_rank<=4"),
)
def _(s, sf):
    df = plain(s, sf)
    budgets = df.select(KEY).distinct().withColumn("raw_budget", F.lit(4))
    return selection.scene_seeds(df, budgets, 4).select(KEY, "scene_id", "sample_index", *r6("strength"), "seed_rank")


# Greedy choice: one recursion step takes, or skips, one frame of every video.
GREEDY = {
    "insc": PLAIN["insc"],
    "rows": """SELECT a.video_id, a.sample_index AS i, list(greatest(0e0,least(1e0,list_dot_product(a.fused,b.fused))) ORDER BY b.sample_index) AS row
               FROM pf a JOIN pf b USING (video_id) GROUP BY 1,2""",
    "gf": """SELECT pf.video_id, pf.sample_index AS i, timestamp_sec AS t, scene_id, local_importance AS li, row, len(row) AS n
             FROM pf JOIN rows ON pf.video_id=rows.video_id AND pf.sample_index=rows.i""",
    "sbest": """SELECT video_id, scene_id, sample_index AS i FROM (SELECT pf.*, row_number() OVER (PARTITION BY pf.video_id, pf.scene_id
                ORDER BY 0.65e0*local_importance+0.35e0*centrality DESC, pf.sample_index) AS rk
                FROM pf JOIN insc ON pf.video_id=insc.video_id AND pf.sample_index=insc.sample_index) WHERE rk=1""",
    "sstr": """SELECT video_id, scene_id, avg(local_importance)+0.35e0*max(local_importance)+0.05e0*ln(1e0+count(*)) AS strength FROM pf GROUP BY 1,2""",
    "seeds": """SELECT video_id, list(i ORDER BY strength DESC, scene_id) AS seeds FROM sbest JOIN sstr USING (video_id, scene_id) GROUP BY 1""",
    "gr": """SELECT seeds.video_id, least(bud.raw_budget, n) AS budget, seeds[1:bud.raw_budget] AS todo, CAST([] AS INT[]) AS picked, CAST([] AS DOUBLE[]) AS gains,
             CAST([] AS DOUBLE[]) AS times, CAST([] AS INT[]) AS seen, list_transform(range(0, n), lambda x: 0e0) AS cover
             FROM seeds JOIN bud USING (video_id) JOIN (SELECT video_id, count(*) AS n FROM pf GROUP BY 1) USING (video_id)
             UNION ALL
             SELECT video_id, budget, todo[2:], CASE WHEN take THEN list_append(picked, i) ELSE picked END, CASE WHEN take THEN list_append(gains, gain) ELSE gains END,
                    CASE WHEN take THEN list_append(times, t) ELSE times END, CASE WHEN take THEN list_append(seen, scene_id) ELSE seen END,
                    CASE WHEN take THEN list_transform(cover, lambda x, k: greatest(x, row[k])) ELSE cover END
             FROM (SELECT *, CASE WHEN len(todo)>0 THEN li ELSE value END AS gain, far OR len(todo)=0 AS take FROM (
                   SELECT gr.*, gf.i, gf.t, gf.scene_id, gf.li, gf.row, len(list_filter(times, lambda x: abs(x-gf.t)<{gap}))=0 AS far,
                          gf.li+{cov}*(list_sum(list_transform(cover, lambda x, k: greatest(x, gf.row[k])))-list_sum(cover))/gf.n
                          +CASE WHEN list_contains(seen, gf.scene_id) THEN 0e0 ELSE {bonus} END-{red}*cover[gf.i+1] AS value
                   FROM gr JOIN gf USING (video_id)
                   WHERE len(picked)<budget AND NOT list_contains(picked, gf.i) AND (len(todo)=0 OR gf.i=todo[1]))
                   QUALIFY row_number() OVER (PARTITION BY video_id ORDER BY far DESC, value DESC, i)=1)""",
    "gend": "SELECT video_id, arg_max(picked, len(picked)) AS picked, arg_max(gains, len(picked)) AS gains FROM gr GROUP BY 1",
    "gout": """SELECT video_id, sample_index, timestamp_sec, selection_gain, CAST(row_number() OVER (PARTITION BY video_id ORDER BY timestamp_sec, sample_index) AS INT) AS raw_selected_rank
               FROM (SELECT video_id, unnest(picked) AS sample_index, unnest(gains) AS selection_gain FROM gend) JOIN (SELECT video_id, sample_index, timestamp_sec FROM pf) USING (video_id, sample_index)""",
}


def greedy_sql(cov: str = "0.55e0", bonus: str = "0.15e0", red: str = "0.30e0", gap: str = "1e0") -> dict[str, str]:
    out = dict(GREEDY)
    for name, value in (("{cov}", cov), ("{bonus}", bonus), ("{red}", red), ("{gap}", gap)):
        out["gr"] = out["gr"].replace(name, value)
    return out


@query(
    "L2_greedy_select",
    with_views(["fx_unit"], {**PLAIN, "bud": "SELECT video_id, least(12, count(*)) AS raw_budget FROM pf GROUP BY 1", **greedy_sql()},
        f"SELECT video_id, {IDX}, round(selection_gain,6) AS selection_gain, raw_selected_rank, CAST(NULL AS VARCHAR) AS error FROM gout", recursive=True),
)
def _(s, sf):
    df = plain(s, sf)
    budgets = scenes.raw_budget(df, final_budget=12, adaptive=False)
    out = selection.greedy_select(df, budgets, max_budget=12)
    return out.select(KEY, "sample_index", *r6("selection_gain"), "raw_selected_rank", "error")


SCENES = {
    **PLAIN,
    "sd": """SELECT video_id, scene_id, CASE WHEN count(*)>1 THEN max(timestamp_sec)-min(timestamp_sec) ELSE 1e-6 END AS d,
             avg(local_importance) AS mi, avg(prompt_alignment) AS mp, count(*) AS available FROM pf GROUP BY 1,2""",
    "ss": """SELECT *, 0.5e0*mi+0.2e0*d/greatest(sum(greatest(1e-6,d)) OVER (PARTITION BY video_id),1e-6)+0.3e0*mp AS scene_score FROM sd""",
}
QUOTAS = {
    "rkd": """SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY scene_score DESC, scene_id) AS rk,
              count(*) OVER (PARTITION BY video_id) AS ns FROM {src}""",
    "seats": """SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY scene_score/(seat+0.5e0) DESC, rk, seat) AS turn
                FROM (SELECT *, unnest(range(1, available)) AS seat FROM rkd WHERE ns<{b})""",
    "ext": "SELECT video_id, scene_id, count(*) AS extra FROM seats WHERE turn<={b}-ns GROUP BY 1,2",
    "quo": """SELECT video_id, scene_id, CAST(CASE WHEN rk>{b} THEN 0 ELSE 1+coalesce(extra,0) END AS INT) AS quota
              FROM rkd LEFT JOIN ext USING (video_id, scene_id)""",
}


def quota_sql(src: str, b: int) -> dict[str, str]:
    return {k: v.replace("{src}", src).replace("{b}", str(b)) for k, v in QUOTAS.items()}


@query("L3_scene_quotas", with_views(["fx_unit"], {**SCENES, **quota_sql("ss", 9)}, "SELECT * FROM quo"))
def _(s, sf):
    df = plain(s, sf)
    sizes = df.groupBy(KEY, "scene_id").agg(F.count(F.lit(1)).alias("available"))
    rows = selection.scene_scores(df).join(sizes, [KEY, "scene_id"]).withColumn("budget", F.lit(9))
    return selection.scene_quotas(rows)


@query("L4_scene_scores", with_views(["fx_unit"], SCENES, "SELECT video_id, scene_id, round(scene_score,6) AS scene_score FROM ss"))
def _(s, sf):
    return selection.scene_scores(plain(s, sf)).select(KEY, "scene_id", *r6("scene_score"))


@query(
    "L6_histogram_topk",
    with_views(["fx_frames"], {
        "o": """SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY histogram_diff_raw DESC, quality_raw DESC, sample_index) AS rk,
                count(*) OVER (PARTITION BY video_id) AS n FROM fx_frames""",
        "go": """SELECT video_id, CAST(0 AS BIGINT) AS rk, CAST([] AS DOUBLE[]) AS ts, CAST([] AS INT[]) AS kept FROM o GROUP BY 1
                 UNION ALL SELECT g.video_id, o.rk, CASE WHEN ok THEN list_append(ts, t) ELSE ts END, CASE WHEN ok THEN list_append(kept, i) ELSE kept END
                 FROM (SELECT g.*, o.rk AS ork, o.timestamp_sec AS t, o.sample_index AS i,
                       len(g.kept)<16 AND len(list_filter(g.ts, lambda x: abs(x-o.timestamp_sec)<2e0))=0 AS ok
                       FROM go g JOIN o ON g.video_id=o.video_id AND o.rk=g.rk+1) g JOIN o ON g.video_id=o.video_id AND o.rk=g.ork""",
        "fin": "SELECT video_id, arg_max(kept, rk) AS kept FROM go GROUP BY 1",
        "pk": """SELECT video_id, sample_index, timestamp_sec FROM (SELECT o.*, row_number() OVER (PARTITION BY o.video_id
                 ORDER BY (NOT list_contains(kept, sample_index))::INT, rk) AS turn FROM o JOIN fin USING (video_id)) WHERE turn<=16"""},
        f"""SELECT video_id, {IDX}, timestamp_sec, CAST(row_number() OVER (PARTITION BY video_id ORDER BY timestamp_sec) AS INT) AS selected_rank FROM pk""",
        recursive=True),
)
def _(s, sf):
    return selection.histogram_topk(fx.frames(s, sf), 16, 2.0)


def keyframes(s, sf, cfg: KeyframeConfig):
    u = fx.unit_frames(s, sf)
    dur = u.groupBy(KEY).agg((F.max("timestamp_sec") + 0.5).alias("duration_sec"))
    return extract_keyframes(u, fx.prompts(s, sf), cfg, dur)


def on_scores(ctes: dict[str, str]) -> dict[str, str]:
    """Scene steps over the scored frames instead of the signal view."""
    return {k: v.replace("fx_signals", "sc").replace("boundary_raw", "boundary_score").replace("5e0", "20e0") if k != "thr"
            else v.replace("fx_signals", "sc").replace("boundary_raw", "boundary_score") for k, v in ctes.items()}


def compress_sql(b: int) -> dict[str, str]:
    """From the greedy choice ``raw`` to the kept frames ``fin``."""
    return {
        "rawn": "SELECT *, count(*) OVER (PARTITION BY video_id) AS rc FROM raw",
        "big": f"SELECT * FROM rawn WHERE rc>{b}",
        "av": "SELECT video_id, scene_id, count(*) AS available FROM big GROUP BY 1,2",
        "avs": "SELECT av.*, scene_score FROM av JOIN ss USING (video_id, scene_id)",
        **quota_sql("avs", b),
        "cen": """SELECT a.video_id, a.sample_index, avg(greatest(0e0,least(1e0,list_dot_product(a.fused,b.fused)))) AS c
                  FROM big a JOIN big b ON a.video_id=b.video_id AND a.scene_id=b.scene_id GROUP BY 1,2""",
        "pl": """SELECT *, row_number() OVER (PARTITION BY video_id, scene_id ORDER BY score DESC, sample_index) AS place FROM (
                 SELECT big.*, quota, 0.6e0*local_importance+0.25e0*c+0.15e0*boundary_score AS score FROM big
                 JOIN cen ON big.video_id=cen.video_id AND big.sample_index=cen.sample_index
                 JOIN quo ON big.video_id=quo.video_id AND big.scene_id=quo.scene_id)""",
        "tn": """SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY (place>quota)::INT,
                 CASE WHEN place>quota THEN -score END, scene_id, place) AS turn FROM pl""",
        "kept": f"""SELECT video_id, sample_index, score AS compression_score FROM tn WHERE turn<={b}
                    UNION ALL SELECT video_id, sample_index, local_importance FROM rawn WHERE rc<={b}""",
        "fin": """SELECT pf.*, selection_gain, raw_selected_rank, compression_score,
                  CAST(row_number() OVER (PARTITION BY pf.video_id ORDER BY pf.timestamp_sec, pf.sample_index) AS INT) AS selected_rank
                  FROM kept JOIN pf ON kept.video_id=pf.video_id AND kept.sample_index=pf.sample_index
                  JOIN gout ON kept.video_id=gout.video_id AND kept.sample_index=gout.sample_index""",
    }


RAW = {"raw": "SELECT pf.*, selection_gain, raw_selected_rank FROM pf JOIN gout ON pf.video_id=gout.video_id AND pf.sample_index=gout.sample_index"}
SCENE_STEPS = {
    **SCORED,
    **on_scores({**COARSE}),
    "st2": "SELECT video_id, sample_index FROM starts UNION ALL SELECT video_id, sample_index FROM cuts",
    "lab2": """SELECT f.video_id, f.sample_index, CAST(sum(CASE WHEN st.sample_index IS NULL THEN 0 ELSE 1 END)
               OVER (PARTITION BY f.video_id ORDER BY f.sample_index)-1 AS INT) AS scene_id FROM sc f LEFT JOIN st2 st USING (video_id, sample_index)""",
    "pf": "SELECT sc.*, scene_id FROM sc JOIN lab2 ON sc.video_id=lab2.video_id AND sc.sample_index=lab2.sample_index",
}
FIXED_BUDGET = "SELECT video_id, least({b}, count(*)) AS raw_budget FROM pf GROUP BY 1"
ADAPTIVE = """SELECT video_id, CAST(least(least(greatest(round_even(12e0*df*(1e0+0.75e0*bd),0),12e0),24e0),samples) AS INT) AS raw_budget FROM (
    SELECT sc.video_id, samples, sqrt(greatest(max(sc.timestamp_sec)+0.5e0,1e-6)/14.78e0) AS df,
           CASE WHEN samples>2 THEN avg(CASE WHEN boundary_score>=threshold THEN 1e0 ELSE 0e0 END) FILTER (sample_index>0) ELSE 0e0 END AS bd
    FROM sc JOIN thr USING (video_id) GROUP BY sc.video_id, samples)"""


def scene_score_sql(scene: str, duration: str, prompt: str) -> dict[str, str]:
    return {
        "sd": SCENES["sd"],
        "ss": f"""SELECT *, {scene}*mi+{duration}*d/greatest(sum(greatest(1e-6,d)) OVER (PARTITION BY video_id),1e-6)+{prompt}*mp AS scene_score FROM sd""",
    }


ADAPTIVE_KEYFRAMES = {
    **SCENE_STEPS, "bud": ADAPTIVE, **greedy_sql(), **RAW, **scene_score_sql("0.5e0", "0.2e0", "0.3e0"), **compress_sql(12),
}
ABLATION_KEYFRAMES = {
    **SCENE_STEPS, "bud": FIXED_BUDGET.format(b=40), **greedy_sql("0.25e0", "0.08e0", "0.18e0"), **RAW,
    **scene_score_sql("0.55e0", "0.25e0", "0.20e0"), **compress_sql(40),
}


def resample_sql(src: str, slots: int) -> dict[str, str]:
    """``bl``: the vectors of ``src`` (``fused``, ranked by ``selected_rank``) at ``slots`` places."""
    last = slots - 1
    return {
        "sel0": f"""SELECT video_id, selected_rank-1 AS r, count(*) OVER (PARTITION BY video_id) AS n, fused, timestamp_sec AS t,
                    min(timestamp_sec) OVER (PARTITION BY video_id) AS a, max(timestamp_sec) OVER (PARTITION BY video_id) AS z FROM {src}""",
        "sel": "SELECT *, CASE WHEN z-a<=1e-6 THEN r*1e0/greatest(n-1,1) ELSE (t-a)/(z-a) END AS src FROM sel0",
        "dst": f"SELECT DISTINCT video_id, n, unnest(range(0,{slots})) AS slot FROM sel",
        "up": f"""SELECT d.video_id, d.slot, n, greatest(1, least(n-1, (SELECT count(*) FROM sel s WHERE s.video_id=d.video_id AND s.src<=d.slot/{last}e0))) AS u FROM dst d""",
        "bl": f"""SELECT up.video_id, slot, CASE WHEN up.n={slots} THEN (SELECT fused FROM sel q WHERE q.video_id=up.video_id AND q.r=slot) WHEN up.n=1 OR slot=0 THEN a.fused WHEN slot={last} THEN b.fused ELSE
                 list_transform(a.fused, lambda x, i: x*(1e0-(slot/{last}e0-a.src)/greatest(b.src-a.src,1e-6))
                 + b.fused[i]*((slot/{last}e0-a.src)/greatest(b.src-a.src,1e-6))) END AS vec
                 FROM up JOIN sel a ON a.video_id=up.video_id AND a.r=u-1 LEFT JOIN sel b ON b.video_id=up.video_id AND b.r=u""",
    }


@query(
    "L5_compress_to_budget",
    with_views(["fx_unit"], {**SCENES, "bud": "SELECT video_id, least(20, count(*)) AS raw_budget FROM pf GROUP BY 1", **greedy_sql(), **RAW, **compress_sql(12)},
        f"SELECT video_id, {IDX}, round(compression_score,6) AS compression_score, selected_rank FROM fin", recursive=True),
)
def _(s, sf):
    df = write_through(plain(s, sf), "plain")
    out = selection.greedy_select(df, scenes.raw_budget(df, final_budget=20, adaptive=False), max_budget=20)
    raw = write_through(df.join(out.drop("error"), [KEY, "sample_index"]), "raw")
    kept = selection.compress_to_budget(raw, selection.scene_scores(df), 12)
    return kept.select(KEY, "sample_index", *r6("compression_score"), "selected_rank")


@query(
    "L8_extract_keyframes",
    with_views(["fx_unit", "fx_prompts"], ADAPTIVE_KEYFRAMES, f"""SELECT video_id, {IDX}, scene_id, round(selection_gain,6) AS selection_gain,
        round(compression_score,6) AS compression_score, selected_rank FROM fin""", recursive=True),
)
def _(s, sf):
    cfg = KeyframeConfig(num_keyframes=12, adaptive_budget=True, min_raw=12, max_raw=24)
    out = keyframes(s, sf, cfg).selected
    return out.select(KEY, "sample_index", "scene_id", *r6("selection_gain", "compression_score"), "selected_rank")


@query(
    "L8_keyframe_features",
    with_views(["fx_unit", "fx_prompts"], {**ABLATION_KEYFRAMES, **resample_sql("fin", 40)}, sql_items("video_id, CAST(slot AS INT) AS slot", "vec", "bl"), recursive=True),
)
def _(s, sf):
    return items(keyframes(s, sf, ABLATION).features, [KEY, "slot"], "vec")


def greedy(s, sf) -> tuple[DataFrame, DataFrame]:
    """Plain frames and their greedy choice of twelve, ranked by time."""
    df = write_through(plain(s, sf), "plain")
    out = selection.greedy_select(df, scenes.raw_budget(df, final_budget=12, adaptive=False), max_budget=12)
    ranked = df.select(KEY, "sample_index", "timestamp_sec").join(
        out.select(KEY, "sample_index", F.col("raw_selected_rank").alias("selected_rank")), [KEY, "sample_index"]
    )
    return df, write_through(ranked, "choice")


CHOICE = {
    **PLAIN, "bud": FIXED_BUDGET.format(b=12), **greedy_sql(),
    "pick": "SELECT gout.video_id, gout.sample_index, gout.timestamp_sec, raw_selected_rank AS selected_rank, fused FROM gout JOIN pf ON gout.video_id=pf.video_id AND gout.sample_index=pf.sample_index",
}


@query(
    "D13_gather_selected",
    with_views(["fx_unit"], CHOICE, sql_items("video_id, selected_rank", "fused", "pick"), recursive=True),
)
def _(s, sf):
    return items(selection.gather_selected(*greedy(s, sf)), [KEY, "selected_rank"], "fused")


@query(
    "L7_resample_embeddings",
    with_views(["fx_unit"], {**CHOICE, **resample_sql("pick", 20)}, sql_items("video_id, CAST(slot AS INT) AS slot", "vec", "bl"), recursive=True),
)
def _(s, sf):
    chosen = selection.gather_selected(*greedy(s, sf))
    return items(selection.resample_embeddings(chosen, 20), [KEY, "slot"], "vec")


@query(
    "L7_single_slot",
    with_views(["fx_unit"], {**CHOICE, "last": "SELECT * FROM pick QUALIFY row_number() OVER (PARTITION BY video_id ORDER BY timestamp_sec DESC)=1"},
        sql_items("video_id, 0 AS slot", "fused", "last"), recursive=True),
)
def _(s, sf):
    chosen = selection.gather_selected(*greedy(s, sf))
    return items(selection.resample_embeddings(chosen, 1), [KEY, "slot"], "vec")


# --- tables written for frames --------------------------------------------


@query(
    "K3_candidate_scores",
    with_views(["fx_frames"], {}, f"""SELECT video_id, {IDX}, CAST(frame_index AS INT) AS frame_index, round_even(timestamp_sec,4) AS timestamp_sec,
        round_even(motion_raw,6) AS motion_raw, round_even(histogram_diff_raw,6) AS histogram_diff_raw, round_even(sharpness_raw,6) AS sharpness_raw,
        round_even(exposure_raw,6) AS exposure_raw, round_even(quality_raw,6) AS quality_raw FROM fx_frames"""),
)
def _(s, sf):
    return sinks.candidate_scores(fx.frames(s, sf))


@query(
    "K4_selected_timestamps",
    with_views(["fx_unit"], CHOICE, "SELECT video_id, selected_rank, printf('%.6f', timestamp_sec) AS timestamp_sec FROM pick", recursive=True),
)
def _(s, sf):
    return sinks.selected_timestamps(greedy(s, sf)[1])


@query(
    "K3_candidates_after_selection",
    with_views(["fx_unit", "fx_prompts"], ADAPTIVE_KEYFRAMES, "SELECT pf.video_id, CAST(pf.sample_index AS INT) AS sample_index, CAST(pf.frame_index AS INT) AS frame_index, "
        "round_even(pf.timestamp_sec,4) AS timestamp_sec, pf.scene_id, " + ", ".join(f"round(pf.{c},6) AS {c}" for c in [
            "motion_raw", "histogram_diff_raw", "sharpness_raw", "exposure_raw", "quality_raw", "semantic_change", "boundary_score", "motion_score",
            "histogram_score", "quality_score", "rarity_score", "prompt_alignment", "local_importance"])
        + """, round(gout.selection_gain,6) AS selection_gain, gout.raw_selected_rank, round(fin.compression_score,6) AS compression_score, fin.selected_rank
        FROM pf LEFT JOIN gout ON pf.video_id=gout.video_id AND pf.sample_index=gout.sample_index
        LEFT JOIN fin ON pf.video_id=fin.video_id AND pf.sample_index=fin.sample_index""", recursive=True),
)
def _(s, sf):
    cfg = KeyframeConfig(num_keyframes=12, adaptive_budget=True, min_raw=12, max_raw=24)
    return sinks.candidate_scores(keyframes(s, sf, cfg).table)


@query(
    "M10_video_header",
    with_views(["fx_videos"], {"h": "SELECT *, CASE WHEN native_fps<=0 THEN 3e0 ELSE native_fps END AS fps FROM fx_videos"},
        """SELECT video_id, fps, round(CASE WHEN total_frames>0 THEN total_frames/fps ELSE 0e0 END,6) AS duration_sec,
           CAST(greatest(1, round_even(fps/3e0,0)) AS INT) AS stride FROM h"""),
)
def _(s, sf):
    return splits.video_header(fx.videos(s, sf), 3.0).select(KEY, "fps", *r6("duration_sec"), "stride")


@query(
    "M11_sample_frames",
    with_views(["fx_videos"], {"h": "SELECT *, CASE WHEN native_fps<=0 THEN 3e0 ELSE native_fps END AS fps FROM fx_videos",
        "g": "SELECT video_id, fps, greatest(1, CAST(round_even(fps/3e0,0) AS INT)) AS stride, unnest(range(0, total_frames)) AS frame_index FROM h",
        "k": "SELECT video_id, frame_index, frame_index//stride AS sample_index, frame_index/fps AS t FROM g WHERE frame_index % stride = 0"},
        """SELECT video_id, count(*) AS samples, CAST(max(sample_index) AS INT) AS last_sample, CAST(sum(frame_index) AS BIGINT) AS frame_sum,
           round(max(t),6) AS last_sec FROM k GROUP BY 1"""),
)
def _(s, sf):
    head = splits.video_header(fx.videos(s, sf), 3.0)
    # Spread the videos before each becomes hundreds of frames; the join then needs no second shuffle.
    decoded = fx.videos(s, sf).filter("total_frames > 0").repartition(KEY).select(
        KEY, F.explode(F.expr("sequence(0, total_frames - 1)")).alias("frame_index")
    )
    return splits.sample_frames(decoded, head).groupBy(KEY).agg(
        F.count(F.lit(1)).alias("samples"),
        F.max("sample_index").alias("last_sample"),
        F.sum("frame_index").alias("frame_sum"),
        F.round(F.max("timestamp_sec"), 6).alias("last_sec"),
    )


@query(
    "M12_evenly_spaced",
    with_views(["fx_videos"], {
        "p": """SELECT video_id, total_frames AS n, unnest(CASE WHEN total_frames<=0 THEN CAST([] AS BIGINT[]) WHEN total_frames<=8 THEN range(0,total_frames)
                ELSE list_transform(range(0,8), lambda i: CAST(round_even(i*((total_frames-1)/7e0),0) AS BIGINT)) END) AS frame_index FROM fx_videos"""},
        "SELECT DISTINCT video_id, CAST(frame_index AS INT) AS frame_index FROM p"),
)
def _(s, sf):
    return fx.videos(s, sf).select(KEY, F.explode(splits.evenly_spaced(F.col("total_frames"), 8)).alias("frame_index"))
