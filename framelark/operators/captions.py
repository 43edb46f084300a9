"""Caption sets, vocabulary, encoding and batching."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from framelark.functions import chunks
from framelark.functions.partitioned import dense_index
from framelark.functions.text import tokenize_vocab, video_number
from framelark.operators.splits import ID_BLOCK, canonical_splits, split_names

KEY = "video_id"
#: Bytes of text whose words are counted together.
FIRST_SEEN_BYTES = 1 << 23
# Special tokens and their ids.
SPECIALS = {"<pad>": 0, "<sos>": 1, "<eos>": 2, "<unk>": 3}


def number_captions(sentences: DataFrame, order: str) -> DataFrame:
    """Caption lists as rows: ``cap_id`` is the ordinal within the video along ``order``.

    A list column would hold all captions of a video in one row; rows stay
    spread however many captions one video has.
    """
    return dense_index(sentences, [KEY], F.floor(F.col(order) / ID_BLOCK), [order], "cap_id")


def captions_by_split(videos: DataFrame, sentences: DataFrame) -> DataFrame:
    return sentences.join(canonical_splits(videos).select(KEY, "split"), KEY)


def missing_captions(videos: DataFrame, sentences: DataFrame) -> DataFrame:
    return canonical_splits(videos).select("split", KEY).join(sentences.select(KEY), KEY, "left_anti").select("split", KEY)


def caption_report(videos: DataFrame, sentences: DataFrame) -> DataFrame:
    """Expected, captioned and missing videos, and captions, per split."""
    per_video = sentences.groupBy(KEY).agg(F.count(F.lit(1)).alias("caps"))
    counts = (
        canonical_splits(videos).select("split", KEY).join(per_video, KEY, "left")
        .groupBy("split")
        .agg(
            F.count(F.lit(1)).alias("expected"),
            F.count("caps").alias("with_captions"),
            F.count_if(F.col("caps").isNull()).alias("missing"),
            F.coalesce(F.sum("caps"), F.lit(0)).alias("captions"),
        )
    )
    return split_names(videos).join(counts, "split", "left").fillna(0)


def tokenization_report(original: DataFrame, tokenized: DataFrame) -> DataFrame:
    """One row per id: same key, same number of captions, not all blank."""
    a = original.groupBy(KEY).agg(F.count(F.lit(1)).alias("n_original"))
    b = tokenized.groupBy(KEY).agg(
        F.count(F.lit(1)).alias("n_tokenized"), F.bool_or(F.trim("caption") != "").alias("has_text")
    )
    ok = (F.col("n_original") == F.col("n_tokenized")) & F.col("has_text")
    return a.join(b, KEY, "full").select(
        KEY, "n_original", "n_tokenized", F.coalesce(ok, F.lit(False)).alias("valid")
    )


def _words(sentences: DataFrame) -> DataFrame:
    return sentences.select(KEY, "cap_id", F.posexplode(tokenize_vocab(F.col("caption"))).alias("pos", "word"))


def word_counts(sentences: DataFrame) -> DataFrame:
    return _words(sentences).groupBy("word").agg(F.count(F.lit(1)).alias("freq"))


def _first_seen(sentences: DataFrame) -> DataFrame:
    """``word, freq, num, cap_id, pos``: the words of some captions together, with their number and first place. A null key comes first."""
    text = F.array_join(tokenize_vocab(F.col("caption")), " ")
    rows = sentences.select(video_number(F.col(KEY)).alias("num"), "cap_id", text.alias("text"))
    keys, most, tidy = rows.schema.fields[:2], FIRST_SEEN_BYTES, chunks.tidying()

    def count(batch):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        at = pa.Table.from_batches([batch])
        at = at.filter(pc.greater(pc.fill_null(pc.binary_length(at.column("text")), 0), 0)).combine_chunks()
        ends = np.concatenate([[0], np.cumsum(pc.binary_length(at.column("text")).to_numpy(), dtype=np.int64)])
        start = 0
        while start < len(at):
            stop = max(start + 1, int(np.searchsorted(ends, ends[start] + most, "right")) - 1)
            part = at.slice(start, stop - start)
            part = part.take(pc.sort_indices(part, sort_keys=[("num", "ascending"), ("cap_id", "ascending")], null_placement="at_start"))
            lists = pc.split_pattern(part.column("text").combine_chunks(), " ")
            lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
            coded, sizes = lists.flatten().dictionary_encode(), pc.list_value_length(lists).to_numpy(zero_copy_only=False)
            codes = coded.indices.to_numpy(zero_copy_only=False)
            heads = np.cumsum(sizes) - sizes
            new = np.zeros(len(part), bool)
            new[:1] = True
            for c in ("num", "cap_id"):
                x = pc.fill_null(part.column(c).combine_chunks().dictionary_encode().indices, -1).to_numpy(zero_copy_only=False)
                new[1:] |= x[1:] != x[:-1]
            along = np.arange(len(codes))
            if not new.all():  # captions under one key stand side by side
                along = np.lexsort((along - np.repeat(heads, sizes), np.repeat(np.cumsum(new), sizes)))
            _, first, freq = np.unique(codes[along], return_index=True, return_counts=True)
            first = along[first]
            row = np.searchsorted(heads, first, "right") - 1
            own = part.select([f.name for f in keys]).take(pa.array(row)).combine_chunks()
            columns = [coded.dictionary, pa.array(freq, pa.int64()), *[own.column(f.name).combine_chunks() for f in keys], pa.array(first - heads[row], pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, names=["word", "freq", "num", "cap_id", "pos"])
            start = stop

    def run(batches):
        for batch in batches:
            yield from count(batch)
            batch = None
            tidy()

    return rows.mapInArrow(run, f"word string, freq bigint, num bigint, cap_id {keys[1].dataType.simpleString()}, pos int")


def build_vocab(sentences: DataFrame, min_freq: int = 2) -> DataFrame:
    """Words of at least ``min_freq``, numbered from 4 by first appearance, plus specials."""
    words = (
        _first_seen(sentences).groupBy("word")
        .agg(F.sum("freq").alias("freq"), F.min(F.struct("num", "cap_id", "pos")).alias("at"))
        .filter(F.col("freq") >= min_freq)
        .select("word", "freq", "at.num", "at.cap_id", "at.pos")
    )
    ranked = dense_index(
        words, [], F.floor(F.col("num") / 1024), ["num", "cap_id", "pos"], "idx", start=len(SPECIALS)
    )
    specials = F.explode(F.array(*[F.struct(F.lit(w).alias("word"), F.lit(i).alias("idx")) for w, i in SPECIALS.items()]))
    head = sentences.sparkSession.range(1).select(specials.alias("s"))
    return head.select("s.word", F.col("s.idx").cast("int").alias("idx"), F.lit(None).cast("bigint").alias("freq")).unionByName(
        ranked.select("word", F.col("idx").cast("int").alias("idx"), "freq")
    )


def encode_captions(sentences: DataFrame, vocab: DataFrame) -> DataFrame:
    """``<sos>`` + word ids (unknown words 3) + ``<eos>``."""
    words = sentences.select(KEY, "cap_id", tokenize_vocab(F.col("caption")).alias("word"))
    packed = chunks.pack(words, "word", "words")
    body = chunks.unpack(chunks.look_up(packed, vocab, "word", "idx", SPECIALS["<unk>"]), "b")
    whole = F.concat(F.array(F.lit(SPECIALS["<sos>"])), "b", F.array(F.lit(SPECIALS["<eos>"])))
    return body.select(KEY, "cap_id", whole.alias("ids"))


def decode_ids(encoded: DataFrame, vocab: DataFrame) -> DataFrame:
    """Words up to ``<eos>``, without padding and ``<sos>``; unknown ids become ``<unk>``."""
    stop = F.array_position("ids", SPECIALS["<eos>"])
    body = F.when(stop > 0, F.slice("ids", F.lit(1), (stop - 1).cast("int"))).otherwise(F.col("ids"))
    shown = F.filter(body, lambda x: ~x.isin(SPECIALS["<pad>"], SPECIALS["<sos>"]))
    packed = chunks.pack(encoded.select(KEY, "cap_id", shown.alias("idx")), "idx", "ids")
    words = chunks.unpack(chunks.look_up(packed, vocab, "idx", "word", "<unk>"), "w")
    return words.select(KEY, "cap_id", F.array_join("w", " ").alias("text"))


def pad_batch(df: DataFrame, batch: str = "batch", ids: str = "ids", pad: int = 0) -> DataFrame:
    """Pad id lists to the longest of their batch."""
    longest = df.groupBy(batch).agg(F.max(F.size(ids)).alias("_longest"))
    fill = F.array_repeat(F.lit(pad), F.col("_longest") - F.size(ids))
    return df.join(longest, batch).withColumn(ids, F.concat(ids, fill)).drop("_longest")


def mask_labels(df: DataFrame, max_len: int, pad: int = 0, ids: str = "ids") -> DataFrame:
    """Cut ids to ``max_len`` and add ``labels`` with padding replaced by -100."""
    return df.withColumn(ids, F.slice(ids, 1, max_len)).withColumn(
        "labels", F.transform(ids, lambda x: F.when(x == pad, -100).otherwise(x))
    )


def _hash(seed: int, *cols: str) -> F.Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(c).cast("string") for c in cols]))


def assign_batches(df: DataFrame, seed: int, size: int, key: str = KEY) -> DataFrame:
    """Seeded shuffle into batches of ``size``; the last one may be shorter."""
    mixed = df.withColumn("_h", _hash(seed, key))
    bucket = F.conv(F.substring("_h", 1, 3), 16, 10).cast("bigint")
    ranked = dense_index(mixed, [], bucket, ["_h", key], "_pos")
    return ranked.withColumn("batch", F.floor(F.col("_pos") / size)).drop("_h", "_pos")


def sample_caption(sentences: DataFrame, seed: int) -> DataFrame:
    """One caption per video, drawn by a seeded hash."""
    return sentences.groupBy(KEY).agg(
        F.min_by(F.struct("cap_id", "caption"), _hash(seed, KEY, "cap_id")).alias("s")
    ).select(KEY, "s.cap_id", "s.caption")


def preview_samples(pred: DataFrame, refs: DataFrame, n: int, seed: int, shown: int = 3) -> DataFrame:
    """``n`` random predictions with their first references, for display."""
    chosen = pred.select(KEY, F.col("caption").alias("prediction")).orderBy(_hash(seed, KEY), KEY).limit(n)
    order = W.partitionBy(KEY).orderBy("cap_id")
    first = (
        refs.select(KEY, "cap_id", F.col("caption").alias("reference"))
        .withColumn("ref_no", F.row_number().over(order))
        .filter(F.col("ref_no") <= shown)
    )
    return chosen.join(first, KEY).select(KEY, "prediction", "ref_no", "reference")
