"""Feature stores: audits, modality joins, padding and masks."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from framelark.functions.vectors import zeros
from framelark.operators.splits import canonical_splits, split_names

KEY = "video_id"
# Vector widths and window length.
CLIP_DIM, DINO_DIM, AUDIO_DIM = 512, 768, 128
FUSED_DIM = CLIP_DIM + DINO_DIM
WINDOW_FRAMES = 96
MODALITIES = {"clip": ["clip"], "clip_dino": ["clip", "dino"], "clip_dino_audio": ["clip", "dino", "audio"]}


def index_files(files: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """One path per id: the first root wins, then the first path."""
    keys = keys or [KEY]
    rest = [c for c in files.columns if c not in (*keys, "root_priority", "path")]
    best = F.min(F.struct("root_priority", "path", *rest)).alias("f")
    return files.groupBy(*keys).agg(best).select(*keys, "f.*")


def split_fused(fused: DataFrame, videos: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Halves of the fused vectors of known videos, and the rows of wrong width."""
    known = fused.join(canonical_splits(videos).select(KEY, "split"), KEY)
    good = known.filter(F.size("vec") == FUSED_DIM)
    halves = good.withColumn("clip", F.slice("vec", 1, CLIP_DIM)).withColumn(
        "dino", F.slice("vec", CLIP_DIM + 1, DINO_DIM)
    )
    bad = known.filter(F.size("vec") != FUSED_DIM).withColumn("dim", F.size("vec")).drop("vec")
    return halves.drop("vec"), bad


def missing_features(videos: DataFrame, files: DataFrame) -> DataFrame:
    return canonical_splits(videos).select("split", KEY).join(files.select(KEY), KEY, "left_anti").select("split", KEY)


def feature_completeness(files: DataFrame, videos: DataFrame, families: list[str]) -> DataFrame:
    """Ids found per family and split against the ids expected."""
    splits = canonical_splits(videos).select(KEY, "split")
    expected = split_names(videos).join(
        splits.groupBy("split").agg(F.count(F.lit(1)).alias("expected")), "split", "left"
    )
    grid = expected.withColumn("family", F.explode(F.array(*[F.lit(f) for f in families])))
    found = (
        files.select("family", KEY).distinct().join(splits, KEY)
        .groupBy("family", "split").agg(F.count(F.lit(1)).alias("actual"))
    )
    joined = grid.join(found, ["family", "split"], "left").fillna(0, ["expected", "actual"])
    return joined.select(
        "family", "split", "expected", "actual", (F.col("actual") >= F.col("expected")).alias("complete")
    )


def store_parity(files: DataFrame, videos: DataFrame, stores: list[str]) -> DataFrame:
    """Ids per split and store; ``MISMATCH`` when the stores differ."""
    owned = files.select("family", KEY).distinct().join(canonical_splits(videos).select(KEY, "split"), KEY)
    counts = owned.groupBy("split").agg(*[F.count_if(F.col("family") == s).alias(s) for s in stores])
    whole = split_names(videos).join(counts, "split", "left").fillna(0)
    same = F.greatest(*stores) == F.least(*stores) if len(stores) > 1 else F.lit(True)
    return whole.withColumn("parity", F.when(same, "ok").otherwise("MISMATCH"))


def usable_videos(
    videos: DataFrame, captions: DataFrame, files: DataFrame, modalities: str, source: str = "split"
) -> DataFrame:
    """Videos with a caption and every file the chosen modalities need."""
    need = list(MODALITIES[modalities])
    if source == "fused":
        need = ["fused"] + [f for f in need if f == "audio"]
    flags = files.groupBy(KEY).agg(*[F.bool_or(F.col("family") == f).alias(f"has_{f}") for f in need])
    full = flags.filter(" AND ".join(f"has_{f}" for f in need)).select(KEY)
    ids = canonical_splits(videos).select("split", KEY)
    return ids.join(full, KEY, "left_semi").join(captions.select(KEY), KEY, "left_semi").select("split", KEY)


def orphan_features(files: DataFrame, captions: DataFrame) -> DataFrame:
    return files.select(KEY).distinct().join(captions.select(KEY), KEY, "left_anti")


def select_modalities(df: DataFrame, name: str) -> DataFrame:
    """Keep the named modalities; the others become zeros of the same shape."""
    dims = {"clip": CLIP_DIM, "dino": DINO_DIM, "audio": AUDIO_DIM}
    used = MODALITIES[name]
    return df.select(
        *[c for c in df.columns if c not in dims],
        *[(F.col(c) if c in used else zeros(d)).alias(c) for c, d in dims.items() if c in df.columns],
    )


def audio_or_zero(videos: DataFrame, audio: DataFrame) -> DataFrame:
    """Audio windows of each video; one zero window where none exists."""
    joined = canonical_splits(videos).select(KEY, "split").join(audio, KEY, "left")
    return joined.select(
        KEY, "split", F.coalesce("win", F.lit(0)).alias("win"), F.coalesce("vec", zeros(AUDIO_DIM)).alias("vec")
    )


def chunk_windows(df: DataFrame, value: str, size: int = WINDOW_FRAMES, index: str = "pos") -> DataFrame:
    """Blocks of ``size`` items; the short tail is dropped, a lone short block is padded with 0."""
    block = F.floor(F.col(index) / size).cast("int")
    packed = F.array_sort(F.collect_list(F.struct(F.col(index).alias("p"), F.col(value).alias("v"))))
    blocks = df.groupBy(KEY, block.alias("win")).agg(packed.alias("b"))
    # A later block can only follow a full first one, so a short block 0 is alone.
    kept = blocks.filter((F.size("b") == size) | (F.col("win") == 0))
    items = F.transform("b", lambda s: s["v"])
    return kept.select(KEY, "win", F.concat(items, F.array_repeat(F.lit(0.0), size - F.size("b"))).alias("items"))


def downmix(df: DataFrame) -> DataFrame:
    """Mean of all channels at each sample."""
    return df.groupBy(KEY, "t").agg(F.avg("sample").alias("sample"))


def pad_audio(audio: DataFrame, batch: str = "batch", dim: int = AUDIO_DIM) -> DataFrame:
    """Pad each video to the most windows of its batch, with a 0/1 mask."""
    sizes = audio.groupBy(batch, KEY).agg(F.count(F.lit(1)).alias("_n"))
    longest = sizes.groupBy(batch).agg(F.max("_n").alias("_longest"))
    holes = (
        sizes.join(longest, batch).filter("_n < _longest")
        .withColumn("win", F.explode(F.expr("sequence(cast(_n as int), cast(_longest as int) - 1)")))
        .select(batch, KEY, "win", zeros(dim).alias("vec"), F.lit(0).alias("mask"))
    )
    real = audio.select(batch, KEY, F.col("win").cast("int").alias("win"), "vec", F.lit(1).alias("mask"))
    return real.unionByName(holes)


def infer_mask(df: DataFrame, vec: str = "vec") -> DataFrame:
    """1 where any item of the vector is not zero."""
    total = F.aggregate(vec, F.lit(0.0), lambda s, x: s + F.abs(x))
    return df.withColumn("mask", (total > 0).cast("int"))


def any_valid(masked: DataFrame) -> DataFrame:
    return masked.groupBy(KEY).agg(F.bool_or(F.col("mask") == 1).alias("has_audio"))


def concat_sequences(visual: DataFrame, audio: DataFrame) -> DataFrame:
    """Visual rows, then masked audio rows, with one attention mask."""
    size = visual.groupBy(KEY).agg(F.count(F.lit(1)).cast("int").alias("_offset"))
    first = visual.select(KEY, F.col("slot").alias("pos"), "vec", F.lit(1).alias("attention"))
    second = audio.join(size, KEY, "left").select(
        KEY,
        (F.col("win") + F.coalesce("_offset", F.lit(0))).alias("pos"),
        F.transform("vec", lambda x: x * F.col("mask")).alias("vec"),
        F.col("mask").alias("attention"),
    )
    return first.unionByName(second)


def pending_videos(videos: DataFrame, done: DataFrame, required: list[str], overwrite: bool = False) -> DataFrame:
    """Ids still to process: not all required outputs exist."""
    ids = canonical_splits(videos).select("split", KEY)
    if overwrite:
        return ids
    finished = (
        done.filter(F.col("family").isin(required)).groupBy(KEY)
        .agg(*[F.bool_or(F.col("family") == s).alias(f"has_{s}") for s in required])
        .filter(" AND ".join(f"has_{s}" for s in required))
    )
    return ids.join(finished.select(KEY), KEY, "left_anti").select("split", KEY)


def choose_source(roots: DataFrame, requested: str = "auto") -> DataFrame:
    """``fused`` when any distinct fused root exists, else ``split``."""
    distinct = roots.select("family", "root").distinct()
    count = F.count_if(F.col("family") == "fused")
    chosen = F.when(count > 0, "fused").otherwise("split") if requested == "auto" else F.lit(requested)
    return distinct.agg(count.alias("fused_roots"), chosen.alias("source"))


def mean_pool(df: DataFrame, by: list[str], vec: str = "vec") -> DataFrame:
    """Mean vector per key; padding rows count like any other."""
    means = df.select(*by, F.posexplode(vec).alias("pos", "x")).groupBy(*by, "pos").agg(F.avg("x").alias("x"))
    packed = means.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("pos", "x"))).alias("m"))
    return packed.select(*by, F.transform("m", lambda s: s["x"]).alias("pooled"))


def concat_pooled(a: DataFrame, b: DataFrame) -> DataFrame:
    """Join two pooled tables and append their vectors."""
    right = b.select(KEY, F.col("pooled").alias("_right"))
    return a.join(right, KEY).select(KEY, F.concat("pooled", "_right").alias("pooled"))


