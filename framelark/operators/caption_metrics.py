"""BLEU, CIDEr, METEOR and ROUGE-L as joins and grouped sums.

``pred`` holds one caption per ``video_id``; ``refs`` holds any number, told
apart by ``cap_id``. ``by`` names extra columns of both tables (a category, a batch or an
epoch): a video is then ``(*by, video_id)``, so ids may come again in other groups, and
document frequencies and totals are taken inside each group. Rows with a null group are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StructField, StructType

from framelark.functions.storage import write_through
from framelark.functions.text import eval_tokens

KEY = "video_id"
MAX_N = 4
#: Tokens of a chunk of captions whose n-grams are numbered together.
CHUNK_TOKENS = 1 << 19


def with_tokens(df: DataFrame) -> DataFrame:
    """Replace ``caption`` by its scoring tokens; every metric below takes either form."""
    return df.withColumn("tokens", eval_tokens(F.col("caption"))).drop("caption")


def with_group_size(pred: DataFrame, refs: DataFrame, by: list[str]) -> tuple[DataFrame, DataFrame]:
    """Add ``videos``, the scored videos of the group, to the captions of both tables.

    It travels with the n-grams from here, so no n-gram table is joined on ``by`` alone.
    """
    if "videos" in pred.columns:
        return pred, refs
    sizes = group_sizes(pred, by)
    if not by:
        return pred.withColumn("videos", sizes.scalar()), refs.withColumn("videos", sizes.scalar())
    return pred.join(sizes, by), refs.join(sizes, by)


def _tokens(df: DataFrame, keep: list[str]) -> DataFrame:
    tokens = F.col("tokens") if "tokens" in df.columns else eval_tokens(F.col("caption"))
    return df.select(*keep, tokens.alias("tokens"))


def ngram_counts(df: DataFrame, ids: list[str], n: int = MAX_N) -> DataFrame:
    """Counts of the 1..n-grams of each caption.

    All n-grams of a caption leave one input row, so the partial count before
    the shuffle is already complete.
    """
    def of_size(k: int) -> Column:
        starts = F.expr(f"sequence(0, size(tokens) - {k})")

        # Direct item access; slicing would copy the whole caption for each n-gram.
        def gram(i: Column) -> Column:
            return F.concat_ws(" ", *[F.get(F.col("tokens"), i + j) for j in range(k)])

        spans = F.transform(starts, lambda i: F.struct(F.lit(k).alias("n"), gram(i).alias("gram")))
        return F.when(F.size("tokens") >= k, spans).otherwise(F.array().cast("array<struct<n:int,gram:string>>"))

    grams = F.flatten(F.array(*[of_size(k) for k in range(1, n + 1)]))
    return (
        _tokens(df, ids).select(*ids, F.explode(grams).alias("g"))
        .groupBy(*ids, "g.n", "g.gram").agg(F.count(F.lit(1)).alias("cnt"))
    )


def video_keys(by: list[str] | None) -> list[str]:
    """What tells one scored video from another."""
    return [*(by or []), KEY]


def scored_pairs(pred: DataFrame, refs: DataFrame, by: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Predictions that have references, and references that have a prediction."""
    ids = video_keys(by)
    return pred.join(refs.select(*ids), ids, "left_semi"), refs.join(pred.select(*ids), ids, "left_semi")


def caption_pairs(pred: DataFrame, refs: DataFrame, ids: list[str]) -> DataFrame:
    """Each reference beside its prediction, as tokens ``ref`` and ``hyp`` with their numbers."""
    hyp = _tokens(pred, ids).select(*ids, F.col("tokens").alias("hyp"), F.size("tokens").alias("hyp_len"))
    ref = _tokens(refs, [*ids, "cap_id"]).select(*ids, "cap_id", F.col("tokens").alias("ref"), F.size("tokens").alias("ref_len"))
    return ref.join(hyp, ids)


def ref_length(
    pred: DataFrame, refs: DataFrame, option: str = "closest", by: list[str] | None = None, pairs: DataFrame | None = None
) -> DataFrame:
    """Prediction length and effective reference length; ties go to the shorter. ``pairs``: stored :func:`caption_pairs`."""
    ids = video_keys(by)
    if pairs is not None:
        met = pairs.select(*ids, F.col("hyp_len").alias("test_len"), F.col("ref_len").alias("len"))
    else:
        p = _tokens(pred, ids).select(*ids, F.size("tokens").alias("test_len"))
        met = p.join(_tokens(refs, ids).select(*ids, F.size("tokens").alias("len")), ids)
    length = {
        "closest": F.min(F.struct(F.abs(F.col("len") - F.col("test_len")).alias("d"), F.col("len"))).getField("len"),
        "shortest": F.min("len"),
        "average": F.avg("len"),
    }[option]
    return met.groupBy(*ids, "test_len").agg(length.cast("double").alias("ref_len"))


def bleu_components(
    pred: DataFrame,
    refs: DataFrame,
    option: str = "closest",
    grams: tuple[DataFrame, DataFrame] | None = None,
    by: list[str] | None = None,
    pairs: DataFrame | None = None,
) -> DataFrame:
    """Per video: lengths, guesses and clipped matches for n = 1..4.

    ``grams``: stored :func:`ngram_counts` of both tables, where there are any; ``pairs``: stored :func:`caption_pairs`.
    """
    ids = video_keys(by)
    if grams:
        hyp, ref = grams
        best = ref.groupBy(*ids, "n", "gram").agg(F.max("cnt").alias("most"))
        met = hyp.join(best, [*ids, "n", "gram"]).select(*ids, "n", F.least("cnt", "most").alias("c"))
    else:
        met = _shared_counts(caption_pairs(pred, refs, ids) if pairs is None else pairs, ids).groupBy(*ids, "n", "place").agg(F.max("c").alias("c"))
    hits = met.groupBy(*ids).agg(*[F.sum(F.when(F.col("n") == k, F.col("c"))).alias(f"c{k}") for k in range(1, MAX_N + 1)])
    lengths = ref_length(pred, refs, option, by, pairs)
    return lengths.join(hits, ids, "left").select(
        *ids,
        "test_len",
        "ref_len",
        *[F.greatest(F.lit(0), F.col("test_len") - (k - 1)).alias(f"guess_{k}") for k in range(1, MAX_N + 1)],
        *[F.coalesce(F.col(f"c{k}"), F.lit(0)).alias(f"correct_{k}") for k in range(1, MAX_N + 1)],
    )


def _shared_counts(pairs: DataFrame, ids: list[str]) -> DataFrame:
    """``ids, n, place, c`` per n-gram that a reference has in common with its prediction.

    ``place`` is where the prediction has it first, ``c`` the smaller count. Captions meet as tokens,
    and only n-grams in common leave a pair.
    """
    fields = [pairs.schema[c] for c in ids]
    most, gram_arrays = CHUNK_TOKENS, _gram_numbering()

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        for batch in batches:
            both = [batch.column(batch.schema.get_field_index(c)) for c in ("hyp", "ref")]
            sizes = [pc.fill_null(pc.list_value_length(x), 0).to_numpy(zero_copy_only=False).astype(np.int64) for x in both]
            total = np.concatenate([[0], np.cumsum(sizes[0] + sizes[1])])
            start = 0
            while start < batch.num_rows:
                stop = max(start + 1, int(np.searchsorted(total, total[start] + most, "right")) - 1)
                m = stop - start
                flat = pa.concat_arrays([x.slice(start, m).flatten() for x in both]).dictionary_encode()
                ends = np.concatenate([[0], np.cumsum(np.concatenate([x[start:stop] for x in sizes]))])
                for k, (rows, number, _, at) in enumerate(gram_arrays(flat.indices.to_numpy(zero_copy_only=False), ends, MAX_N), 1):
                    wide = max(1, int(number.max(initial=0)) + 1)
                    cell, first, count = np.unique(rows * wide + number, return_index=True, return_counts=True)
                    mine = cell < m * wide  # the predictions; row m + i is the reference of i
                    _, h, r = np.intersect1d(cell[mine], cell[~mine] - m * wide, assume_unique=True, return_indices=True)
                    pair, least = cell[mine][h] // wide, np.minimum(count[mine][h], count[~mine][r])
                    place = at[first[mine][h]] - ends[pair]
                    keys = [batch.column(batch.schema.get_field_index(f.name)).take(pa.array(pair + start)) for f in fields]
                    yield pa.RecordBatch.from_arrays(
                        [*keys, pa.array(np.full(len(pair), k, np.int32)), pa.array(place, pa.int32()), pa.array(least, pa.int64())],
                        names=[*[f.name for f in fields], "n", "place", "c"],
                    )
                start = stop

    found = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in fields)
    return pairs.select(*ids, "hyp", "ref").mapInArrow(run, f"{found}n int, place int, c bigint")


BLEU_PARTS = ["test_len", "ref_len", *[f"{w}_{k}" for w in ("guess", "correct") for k in range(1, MAX_N + 1)]]


def bleu_of_totals() -> list[Column]:
    """BLEU 1 to 4 from summed :data:`BLEU_PARTS`."""
    return _bleu()


def _bleu(prefix: str = "") -> list[Column]:
    ratio = (F.col(f"{prefix}test_len") + 1e-15) / (F.col(f"{prefix}ref_len") + 1e-9)
    brevity = F.when(ratio < 1, F.exp(1 - 1 / ratio)).otherwise(1.0)
    product, out = F.lit(1.0), []
    for k in range(1, MAX_N + 1):
        product = product * ((F.col(f"{prefix}correct_{k}") + 1e-15) / (F.col(f"{prefix}guess_{k}") + 1e-9))
        out.append((F.pow(product, F.lit(1.0 / k)) * brevity).alias(f"bleu_{k}"))
    return out


def bleu_per_video(
    pred: DataFrame, refs: DataFrame, option: str = "closest", grams=None, by: list[str] | None = None
) -> DataFrame:
    return bleu_components(pred, refs, option, grams, by).select(*video_keys(by), *_bleu())


def bleu_corpus(pred: DataFrame, refs: DataFrame, by: list[str] | None = None, grams=None) -> DataFrame:
    """Totals of the components per group, then the same formula."""
    by = by or []
    parts = bleu_components(pred, refs, grams=grams, by=by)
    return parts.groupBy(*by).agg(*[F.sum(c).alias(c) for c in BLEU_PARTS]).select(*by, *bleu_of_totals())


def document_frequency(refs: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Number of videos whose references hold the n-gram."""
    return _doc_freq(ngram_counts(refs, [*(by or []), KEY, "cap_id"]), by or [])


def _doc_freq(grams: DataFrame, by: list[str]) -> DataFrame:
    per_video = grams.select(*by, KEY, "n", "gram").distinct()
    return per_video.groupBy(*by, "n", "gram").agg(F.count(F.lit(1)).alias("df"))


def _weights(grams: DataFrame, df: DataFrame, by: list[str]) -> DataFrame:
    """tf-idf weight of each n-gram: ``tf * (ln N - ln max(1, df))``; ``grams`` carry N as ``videos``."""
    joined = grams.join(df, [*by, "n", "gram"], "left")
    idf = F.log(F.col("videos").cast("double")) - F.log(F.greatest(F.lit(1.0), F.coalesce("df", F.lit(1)).cast("double")))
    return joined.withColumn("w", F.col("cnt") * idf).drop("df", "videos")


def group_sizes(pred: DataFrame, by: list[str]) -> DataFrame:
    """Scored videos per group: one row when ``by`` is empty."""
    return pred.groupBy(*by).agg(F.count(F.lit(1)).alias("videos"))


def cider_vectors(pred: DataFrame, refs: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Norm per caption and n, and length in bigrams, of the reference vectors."""
    by = by or []
    pred, refs = with_group_size(pred, refs, by)
    grams = ngram_counts(refs, [*by, KEY, "cap_id", "videos"])
    w = _weights(grams, _doc_freq(grams, by), by)
    return w.groupBy(*by, KEY, "cap_id", "n").agg(
        F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"),
        F.sum(F.when(F.col("n") == 2, F.col("cnt")).otherwise(0)).alias("bigrams"),
    )


def _distinct_grams(n: int = MAX_N) -> Column:
    """The distinct 1..n-grams of the array ``tokens``, as ``(n, gram)``."""
    def of_size(k: int) -> Column:
        starts = F.expr(f"sequence(0, size(tokens) - {k})")
        gram = lambda i: F.concat_ws(" ", *[F.get(F.col("tokens"), i + j) for j in range(k)])
        spans = F.transform(starts, lambda i: F.struct(F.lit(k).alias("n"), gram(i).alias("gram")))
        return F.when(F.size("tokens") >= k, spans).otherwise(F.array().cast("array<struct<n:int,gram:string>>"))

    return F.array_distinct(F.flatten(F.array(*[of_size(k) for k in range(1, n + 1)])))


def shared_frequency(refs: DataFrame, by: list[str]) -> DataFrame:
    """``by, n, gram, df`` of the n-grams that the references of two videos or more hold; any other counts as 1."""
    tokens = _tokens(refs, [*by, KEY])
    per_video = tokens.select(*by, KEY, F.explode(_distinct_grams()).alias("g")).select(*by, KEY, "g.n", "g.gram").distinct()
    return per_video.groupBy(*by, "n", "gram").agg(F.count(F.lit(1)).alias("df")).filter("df > 1")


def _gram_numbering():
    """A function for the tasks; nested, so that it travels with them."""
    def gram_arrays(tokens, ends, n: int):
        """Of each n: row and number of all n-grams of a chunk, the first place of each number, and the places of all."""
        import numpy as np

        rows = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
        left = ends[1:][rows] - np.arange(len(tokens))  # tokens from here to the end of the row
        at, number, out = np.arange(len(tokens)), tokens.astype(np.int64), []
        for k in range(1, n + 1):
            if k > 1:
                at = at[left[at] >= k]
                # A gram is its first k-1 tokens, by number, and the token behind them.
                pair = prefix[at] * (int(tokens.max(initial=0)) + 1) + tokens[at + k - 1]
                first, number = np.unique(pair, return_index=True, return_inverse=True)[1:]
            else:
                first, number = np.unique(number, return_index=True, return_inverse=True)[1:]
            prefix = np.zeros(len(tokens), np.int64)
            prefix[at] = number
            out.append((rows[at], number, at[first], at))
        return out

    return gram_arrays


def token_pairs(hyp: DataFrame, refs: DataFrame, ids: list[str], grp: Column, videos: Column) -> DataFrame:
    """Each reference beside the prediction of its video, if there is one, as tokens.

    ``hyp`` and ``refs`` hold ``tokens``. The lists ``grp`` and ``videos`` (never null) have, for each set of groups, that of
    the video (null: none) and its size. ``_vid`` tells videos apart, ``_n_refs`` is how many rows of it there are.
    """
    many = refs.groupBy(*ids).agg(F.count(F.lit(1)).alias("_n_refs"))
    mine = many.join(hyp.withColumnRenamed("tokens", "hyp").withColumn("_scored", F.lit(True)), ids, "left")
    met = refs.withColumnRenamed("tokens", "ref").join(mine, ids, "left")
    return met.select(
        *ids, "cap_id", F.size("hyp").alias("hyp_len"), F.size("ref").alias("ref_len"), "ref", "hyp", F.coalesce("_scored", F.lit(False)).alias("_scored"),
        F.xxhash64(*ids).alias("_vid"), F.coalesce("_n_refs", F.lit(0)).alias("_n_refs"), grp.alias("_grp"), videos.alias("_videos"),
    )


def pack_pairs(pairs: DataFrame, ids: list[str]) -> DataFrame:
    """Stored chunks of :func:`token_pairs`: all tokens as numbers into one dictionary of the chunk.

    A prediction stands once for the references in a row that it meets (``hyp_of``), before all references. ``cell``
    numbers the videos' groups in all sets; ``open`` is the ``_vid`` of a video with references in other chunks, else 0.
    """
    fields = [pairs.schema[c] for c in [*ids, "cap_id", "hyp_len", "ref_len"]]
    row = ", ".join(f"{f.name}: {f.dataType.simpleString()}" for f in fields)

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc
        from pyspark import TaskContext

        none = np.iinfo(np.int64).min
        number = TaskContext.get().partitionId() << 32
        one = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
        plain = lambda x, null: pc.fill_null(x, null).to_numpy(zero_copy_only=False)
        for batch in batches:
            at = {c: batch.column(batch.schema.get_field_index(c)) for c in batch.schema.names}
            hyp, ref = at["hyp"], at["ref"]
            h, r = [plain(pc.list_value_length(x), 0).astype(np.int64) for x in (hyp, ref)]
            vid, many, scored = plain(at["_vid"], 0), plain(at["_n_refs"], 0), plain(at["_scored"], False)
            sets = [plain(at[c].flatten(), none).reshape(batch.num_rows, -1) for c in ("_grp", "_videos")]
            codes = hyp.flatten().dictionary_encode().indices.to_numpy(zero_copy_only=False)
            ends = np.concatenate([[0], np.cumsum(h)])
            again = np.zeros(batch.num_rows, bool)
            for i in np.flatnonzero((vid[1:] == vid[:-1]) & (h[1:] == h[:-1])) + 1:
                again[i] = np.array_equal(codes[ends[i] : ends[i + 1]], codes[ends[i - 1] : ends[i]])
            total = np.concatenate([[0], np.cumsum(r + np.where(again, 0, h))])
            start = 0
            while start < batch.num_rows:
                stop = max(start + 1, int(np.searchsorted(total, total[start] + CHUNK_TOKENS - (h[start] if again[start] else 0), "right")) - 1)
                fresh = ~again[start:stop]
                fresh[0] = True
                said = hyp.take(pa.array(np.flatnonzero(fresh) + start))
                flat = pa.concat_arrays([said.flatten(), ref.slice(start, stop - start).flatten()]).dictionary_encode()
                hyp_of = np.where(scored[start:stop], np.cumsum(fresh) - 1, -1)
                cells, cell = np.unique(np.hstack([x[start:stop] for x in sets]), axis=0, return_inverse=True)
                vids, head, video, held = np.unique(vid[start:stop], return_index=True, return_inverse=True, return_counts=True)
                whole = held == many[start:stop][head]
                keys = pa.StructArray.from_arrays([at[f.name].slice(start, stop - start) for f in fields], names=[f.name for f in fields])
                sizes = np.concatenate([h[start:stop][fresh], r[start:stop]])
                lists = {
                    "hyp_of": pa.array(hyp_of, pa.int32()), "cell": pa.array(cell.ravel(), pa.int32()), "cells": pa.array(cells.ravel(), pa.int64()),
                    "video": pa.array(video, pa.int32()), "open": pa.array(np.where(whole, 0, np.where(vids == 0, 1, vids)), pa.int64()),
                    "sizes": pa.array(sizes, pa.int32()), "items": flat.indices.cast(pa.int32()), "dictionary": flat.dictionary,
                }
                yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), one(keys), *map(one, lists.values())], names=["chunk", "rows", *lists])
                number, start = number + 1, stop

    schema = f"""chunk bigint, rows array<struct<{row}>>, hyp_of array<int>, cell array<int>, cells array<bigint>, video array<int>,
        open array<bigint>, sizes array<int>, items array<int>, dictionary array<string>"""
    return write_through(pairs.mapInArrow(run, schema), "pairs", compression="zstd")


def packed_pairs(packed: DataFrame) -> DataFrame:
    """The scored pairs of :func:`pack_pairs` as :func:`caption_pairs`, with numbers for tokens that agree within a pair."""
    fields, most = packed.schema["rows"].dataType.elementType.fields, CHUNK_TOKENS

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            at = {c: batch.column(batch.schema.get_field_index(c)) for c in batch.schema.names}
            for r in range(batch.num_rows):
                keys, items, hyp_of = at["rows"][r].values, at["items"][r].values, at["hyp_of"][r].values.to_numpy()
                ends = np.concatenate([[0], np.cumsum(at["sizes"][r].values.to_numpy(), dtype=np.int64)])
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), items)
                mine = np.flatnonzero(hyp_of >= 0)
                other = mine + len(ends) - 1 - len(hyp_of)
                size, spoke = np.diff(ends), hyp_of[mine]
                total = np.concatenate([[0], np.cumsum(size[spoke] + size[other])])
                start = 0
                while start < len(mine):
                    stop = max(start + 1, int(np.searchsorted(total, total[start] + most, "right")) - 1)
                    pick = lambda x: pa.array(x[start:stop])  # noqa: B023, E731
                    columns = [*keys.take(pick(mine)).flatten(), lists.take(pick(spoke)), lists.take(pick(other))]
                    yield pa.RecordBatch.from_arrays(columns, names=[*[f.name for f in fields], "hyp", "ref"])
                    start = stop

    ints = ArrayType(IntegerType())
    schema = StructType([*fields, StructField("hyp", ints), StructField("ref", ints)])
    return packed.select("rows", "hyp_of", "sizes", "items").mapInArrow(run, schema)


def _chunk_tools(bits: int, sets: int):
    """Functions for the tasks; nested, so that they travel with them.

    An entry of a chunk is an n-gram in a cell, known outside by 96 bits of hash. Chunks send their entries to ``2 ** bits`` buckets
    in two rounds: n = 1 and 2, and then those of n = 3 and 4 whose bigrams all stand in two videos or more, since no other can.
    """
    gram_arrays = _gram_numbering()

    def shrink(a) -> bytes:
        """Bytes by their place in the number, so that the leading ones of sorted numbers compress."""
        import numpy as np
        import pyarrow as pa

        raw = np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T.tobytes()
        return len(a).to_bytes(4, "little") + pa.compress(raw, codec="zstd", asbytes=True)

    def grow(b: bytes, kind):
        import numpy as np
        import pyarrow as pa

        n, size = int.from_bytes(b[:4], "little"), np.dtype(kind).itemsize
        raw = pa.decompress(b[4:], n * size, codec="zstd", asbytes=True)
        return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, n).T).view(kind).ravel()

    class Chunk:
        def __init__(self, at: dict, r: int):
            import numpy as np
            import pandas as pd

            ints = lambda c: at[c][r].values.to_numpy()
            self.id, self.tokens, self.hyp_of = at["chunk"][r].as_py(), ints("items"), ints("hyp_of")
            self.ends = np.concatenate([[0], np.cumsum(ints("sizes"), dtype=np.int64)])
            self.hyps = len(self.ends) - 1 - len(self.hyp_of)
            self.cells, self.video, self.open = ints("cells").reshape(-1, 2 * sets), ints("video").astype(np.int64), ints("open")
            cell = ints("cell").astype(np.int64)
            self.cell = np.concatenate([np.zeros(self.hyps, np.int64), cell])
            said = self.hyp_of >= 0
            self.cell[self.hyp_of[said]] = cell[said]
            words = at["dictionary"][r].values.to_numpy(zero_copy_only=False)
            self.words = [pd.util.hash_array(words, hash_key=key, categorize=False) for key in ("framelark-ngrams", "ngrams-framelark")]
            self.grams = gram_arrays(self.tokens, self.ends, MAX_N)

        def hashes(self, first, k: int):
            import numpy as np

            out = []
            for w in self.words:
                x = np.full(len(first), k, np.uint64)
                for j in range(k):
                    x = (x ^ w[self.tokens[first + j]]) * np.uint64(0x9E3779B97F4A7C15)
                    x ^= x >> np.uint64(29)
                out.append(x)
            return out[0], (out[1] >> np.uint64(32)).astype(np.uint32)

        def entries(self, sizes, shared=None) -> dict:
            """Entries of n-grams of these sizes, by hash; ``of``: the entry of each n-gram (-1: none); ``shared``: places of bigrams that count."""
            import numpy as np

            wide, videos, base = len(self.cells), max(1, len(self.open)), 0
            parts, loose, of = [], [], {}
            for k in sizes:
                rows, number, first, place = self.grams[k - 1]
                ok = np.ones(len(place), bool)
                for j in range(k - 1 if shared is not None else 0):
                    ok &= shared[place + j]
                own, mine = np.unique(number[ok] * wide + self.cell[rows[ok]], return_inverse=True)
                of[k] = np.full(len(place), -1)
                of[k][ok] = mine + base
                ref = rows[ok] >= self.hyps
                held = np.unique(mine[ref] * videos + self.video[rows[ok][ref] - self.hyps])
                entry, name = held // videos, self.open[held % videos]
                count = np.bincount(entry[name == 0], minlength=len(own))
                loose.append((entry[name != 0] + base, name[name != 0]))
                parts.append((*self.hashes(first[own // wide], k), (own % wide).astype(np.int32), count.astype(np.int32)))
                base += len(own)
            h, low, cell, count = [np.concatenate(x) for x in zip(*parts)]
            order = np.lexsort((cell, low, h))
            place = np.empty(base, np.int64)
            place[order] = np.arange(base)
            return {
                "h": h[order], "low": low[order], "cell": cell[order], "count": count[order],
                "of": {k: np.where(x < 0, -1, place[x]) if base else x for k, x in of.items()},
                "loose": place[np.concatenate([x for x, _ in loose])], "name": np.concatenate([x for _, x in loose]),
            }

        def frequencies(self, entries: dict, replies: list, turn: int):
            """Videos that hold each entry, per set; 1 for all that no bucket has named."""
            import numpy as np

            out = np.ones((len(entries["h"]) + 1, sets), np.int64)  # the last row is that of entry -1
            for x in replies or ():
                if x["turn"] == turn:
                    start = np.searchsorted(entries["h"] >> np.uint64(64 - bits), np.uint64(x["bucket"]))
                    out[start + grow(x["place"], np.int32)] = grow(x["df"], np.int64).reshape(-1, sets)
            return out

        def shared(self, entries: dict, df):
            """Places where a bigram stands that two videos or more hold, in one of the sets."""
            import numpy as np

            out = np.zeros(len(self.tokens) + 1, bool)
            out[self.grams[1][3]] = (df > 1).any(axis=1)[entries["of"][2]]
            return out

    return Chunk, shrink, grow


ASKED = "bucket int, chunk bigint, cells binary, h binary, low binary, cell binary, count binary, loose binary, name binary"
REPLIES = "chunk bigint, turn int, bucket int, place binary, df binary"


def _asked(chunks: DataFrame, bits: int, sets: int, turn: int) -> DataFrame:
    """:data:`ASKED`: what each chunk sends to each bucket in this turn; ``chunks`` of turn 1 hold the replies of turn 0."""
    Chunk, shrink, _ = _chunk_tools(bits, sets)

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            at = {c: batch.column(batch.schema.get_field_index(c)) for c in batch.schema.names}
            for r in range(batch.num_rows):
                chunk = Chunk(at, r)
                asked = chunk.entries((1, 2))
                if turn:
                    df = chunk.frequencies(asked, at["replies"][r].as_py(), 0)
                    asked = chunk.entries((3, 4), chunk.shared(asked, df))
                cells, out = shrink(chunk.cells.ravel()), []
                buckets, starts = np.unique(asked["h"] >> np.uint64(64 - bits), return_index=True)
                turns = np.argsort(asked["loose"], kind="stable")
                loose, name = asked["loose"][turns], asked["name"][turns]
                for bucket, a, b in zip(buckets, starts, [*starts[1:], len(asked["h"])]):
                    c, d = np.searchsorted(loose, [a, b])
                    body = [asked[x][a:b] for x in ("h", "low", "cell", "count")]
                    out.append((int(bucket), chunk.id, cells, *map(shrink, body), shrink((loose[c:d] - a).astype(np.int32)), shrink(name[c:d])))
                types = [pa.int32(), pa.int64(), *[pa.binary()] * 7]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), types)], names=[x.split()[0] for x in ASKED.split(", ")])

    return chunks.mapInArrow(run, ASKED)


def _answered(asked: DataFrame, bits: int, sets: int, turn: int) -> DataFrame:
    """:data:`REPLIES`: the entries of each chunk that two videos or more of a group hold, with that number in each set."""
    _, shrink, grow = _chunk_tools(bits, sets)

    def run(table):
        import numpy as np
        import pyarrow as pa

        none = np.iinfo(np.int64).min
        rows = table.combine_chunks().to_pylist()
        read = lambda c, kind: [grow(x[c], kind) for x in rows]
        h, low, cell, count = read("h", np.uint64), read("low", np.uint32), read("cell", np.int32), read("count", np.int32)
        groups = [x.reshape(-1, 2 * sets)[:, :sets][c] for x, c in zip(read("cells", np.int64), cell)]
        starts = np.concatenate([[0], np.cumsum([len(x) for x in h])])
        loose = np.concatenate([x.astype(np.int64) + a for x, a in zip(read("loose", np.int32), starts)])
        name = np.unique(np.concatenate(read("name", np.int64)), return_inverse=True)[1]
        h, low, count, groups = np.concatenate(h), np.concatenate(low), np.concatenate(count), np.concatenate(groups)
        order = np.lexsort((low, h))
        new = np.ones(len(h), np.int64)
        new[1:] = (h[order][1:] != h[order][:-1]) | (low[order][1:] != low[order][:-1])
        gram = np.empty(len(h), np.int64)
        gram[order] = np.cumsum(new)
        df = np.ones((len(h), sets), np.int64)
        for i in range(sets):
            kinds, group = np.unique(groups[:, i], return_inverse=True)
            keys, key = np.unique(gram * len(kinds) + group, return_inverse=True)
            found = np.bincount(key, count, len(keys)).astype(np.int64)
            # A video that stands in several chunks names itself, and counts once.
            once = np.unique(key[loose] * (int(name.max(initial=0)) + 1) + name)
            found += np.bincount(once // (int(name.max(initial=0)) + 1), minlength=len(keys))
            df[:, i] = np.where(groups[:, i] == none, 1, np.maximum(found, 1)[key])
        out = []
        for x, a, b in zip(rows, starts, starts[1:]):
            place = np.flatnonzero((df[a:b] > 1).any(axis=1))
            if len(place):
                out.append((x["chunk"], turn, x["bucket"], shrink(place.astype(np.int32)), shrink(df[a:b][place].ravel())))
        types = [pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]
        columns = list(zip(*out)) or [[]] * 5
        return pa.Table.from_arrays([pa.array(x, t) for x, t in zip(columns, types)], names=[x.split()[0] for x in REPLIES.split(", ")])

    return asked.groupBy("bucket").applyInArrow(run, REPLIES)


def _with_replies(packed: DataFrame, replies: DataFrame) -> DataFrame:
    found = replies.groupBy("chunk").agg(F.collect_list(F.struct("turn", "bucket", "place", "df")).alias("replies"))
    return packed.join(found, "chunk", "left")


def _pair_scores(met: DataFrame, bits: int, sets: int, sigma: float) -> DataFrame:
    """Per scored pair and set ``s_i``: the mean clipped cosine of 1..n-grams times the length penalty; null in sets without the pair."""
    fields = met.schema["rows"].dataType.elementType.fields
    names = [f.name for f in fields]
    Chunk, _, _ = _chunk_tools(bits, sets)

    def run(batches):
        import numpy as np
        import pyarrow as pa

        none = np.iinfo(np.int64).min
        for batch in batches:
            at = {c: batch.column(batch.schema.get_field_index(c)) for c in batch.schema.names}
            for r in range(batch.num_rows):
                chunk, replies = Chunk(at, r), at["replies"][r].as_py()
                short = chunk.entries((1, 2))
                few = chunk.frequencies(short, replies, 0)
                long = chunk.entries((3, 4), chunk.shared(short, few))
                known = [(short, few)] * 2 + [(long, chunk.frequencies(long, replies, 1))] * 2
                H, m = chunk.hyps, len(chunk.hyp_of)
                inside, spoke = chunk.cells[:, :sets] != none, np.maximum(chunk.hyp_of, 0)
                big = np.log(np.where(inside, chunk.cells[:, sets:], 1).astype(float))
                cosine = np.zeros((m, sets))
                for k, (rows, number, first, _) in enumerate(chunk.grams, 1):
                    entries, df = known[k - 1]
                    # Counts of each gram in each row: predictions, and then references.
                    wide = max(1, len(first))
                    cell, spot, count = np.unique(rows * wide + number, return_index=True, return_counts=True)
                    row, gram = cell // wide, cell % wide
                    lower = df[entries["of"][k][spot]]
                    ref = np.searchsorted(row, H)
                    want = spoke[row[ref:] - H] * wide + gram[ref:]
                    near = np.searchsorted(cell[:ref], want)
                    near[near == ref] = 0
                    same = cell[near] == want if ref else np.zeros(len(want), bool)
                    for i in range(sets):
                        w = count * (big[chunk.cell[row], i] - np.log(lower[:, i].astype(float)))
                        norm = np.sqrt(np.bincount(row, w * w, H + m))
                        other = np.where(same, w[near], 0.0) if ref else np.zeros(len(want))
                        v = np.bincount(row[ref:] - H, np.minimum(other, w[ref:]) * w[ref:], m)
                        both = norm[spoke] * norm[H:]
                        cosine[:, i] += np.where(both != 0, v / np.where(both != 0, both, 1.0), v)
                bigrams = np.maximum(0, np.diff(chunk.ends) - 1).astype(float)
                delta = bigrams[spoke] - bigrams[H:]
                s = cosine / MAX_N * np.exp(-(delta * delta) / (2 * sigma * sigma))[:, None]
                mine = np.flatnonzero(chunk.hyp_of >= 0)
                known = inside[chunk.cell[H:]][mine]
                scores = [pa.array(s[mine, i], mask=~known[:, i]) for i in range(sets)]
                yield pa.RecordBatch.from_arrays([*at["rows"][r].values.take(pa.array(mine)).flatten(), *scores], names=[*names, *[f"s_{i}" for i in range(sets)]])

    return met.mapInArrow(run, StructType([*fields, *[StructField(f"s_{i}", DoubleType()) for i in range(sets)]]))


def cider_of_pairs(packed: DataFrame, ids: list[str], sets: int = 1, sigma: float = 6.0) -> DataFrame:
    """``ids, cider_0, cider_1, ...``: CIDEr of each video in each set, from :func:`pack_pairs`.

    A chunk sends the hashes of its n-grams to buckets, once each with the number of its videos whose references hold them;
    only n-grams of two videos or more come back, with their frequencies. Weights, norms and products are taken inside the chunk.
    """
    bits = max(6, (packed.count() - 1).bit_length())
    first = write_through(_answered(_asked(packed, bits, sets, 0), bits, sets, 0), "replies", compression="zstd")
    second = _answered(_asked(_with_replies(packed, first), bits, sets, 1), bits, sets, 1)
    scored = _pair_scores(_with_replies(packed, first.unionByName(second)), bits, sets, sigma)
    # Every reference is one pair, so their mean is that of the pairs.
    return scored.groupBy(*ids).agg(*[(F.sum(f"s_{i}") / F.count(F.lit(1)) * 10.0).alias(f"cider_{i}") for i in range(sets)])


def cider_per_video(pred: DataFrame, refs: DataFrame, by: list[str] | None = None, sigma: float = 6.0) -> DataFrame:
    """CIDEr of each video: clipped cosine with a length penalty, mean over references, times 10.

    Captions are stored as tokens before they meet, so that no plan holds their origin more than once.
    """
    by, ids = by or [], video_keys(by)
    stored = [df if "tokens" in df.columns else write_through(_tokens(df, keep), "tokens", compression="zstd") for df, keep in ((pred, ids), (refs, [*ids, "cap_id"]))]
    pred, refs = with_group_size(stored[0], stored[1], by)
    pairs = token_pairs(
        pred.select(*ids, "videos", "tokens"), refs.select(*ids, "cap_id", "tokens"), ids,
        F.array(F.xxhash64(F.lit(0), *by)), F.array("videos"),
    )
    return cider_of_pairs(pack_pairs(pairs, ids), ids, sigma=sigma).withColumnRenamed("cider_0", "cider")


def cider_corpus(pred: DataFrame, refs: DataFrame, by: list[str] | None = None) -> DataFrame:
    by = by or []
    return cider_per_video(pred, refs, by).groupBy(*by).agg(F.avg("cider").alias("cider"))


def lcs_length(a: str, b: str) -> Column:
    """Length of the longest common subsequence of two token array columns.

    Bit-parallel row update on Python integers: one step per token of ``b``,
    whatever the length of ``a``.
    """

    @F.pandas_udf(IntegerType())
    def lcs(left, right):
        import pandas as pd

        out = []
        for x, y in zip(left, right):
            masks: dict = {}
            for i, token in enumerate(x):
                masks[token] = masks.get(token, 0) | (1 << i)
            full = (1 << len(x)) - 1
            row = full
            for token in y:
                hit = row & masks.get(token, 0)
                row = ((row + hit) | (row - hit)) & full
            out.append(len(x) - row.bit_count())
        return pd.Series(out, dtype="int32")

    return lcs(F.col(a), F.col(b))


def lcs_pairs(pred: DataFrame, refs: DataFrame, by: list[str] | None = None, pairs: DataFrame | None = None) -> DataFrame:
    ids = video_keys(by)
    pairs = caption_pairs(pred, refs, ids) if pairs is None else pairs
    return pairs.select(*ids, "cap_id", "hyp_len", "ref_len", lcs_length("hyp", "ref").alias("lcs"))


def rouge_l(pred: DataFrame, refs: DataFrame, by: list[str] | None = None, pairs: DataFrame | None = None) -> DataFrame:
    """Best F1 of the common subsequence over the references of each video."""
    p, r = F.try_divide("lcs", "hyp_len"), F.try_divide("lcs", "ref_len")
    f1 = F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0))
    return lcs_pairs(pred, refs, by, pairs).groupBy(*video_keys(by)).agg(F.max(f1).alias("rouge_l"))


def meteor_alignment(pred: DataFrame, refs: DataFrame, by: list[str] | None = None, pairs: DataFrame | None = None) -> DataFrame:
    """Matches and chunks per reference: the k-th equal token meets the k-th.

    A match opens a chunk unless the match of the token before is next to it. Pairs are matched where they meet.
    """
    ids = video_keys(by)
    pairs = caption_pairs(pred, refs, ids) if pairs is None else pairs
    fields = [pairs.schema[c] for c in [*ids, "cap_id", "hyp_len", "ref_len"]]
    most = CHUNK_TOKENS

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        for batch in batches:
            both = [batch.column(batch.schema.get_field_index(c)) for c in ("hyp", "ref")]
            sizes = [pc.fill_null(pc.list_value_length(x), 0).to_numpy(zero_copy_only=False).astype(np.int64) for x in both]
            total = np.concatenate([[0], np.cumsum(sizes[0] + sizes[1])])
            start = 0
            while start < batch.num_rows:
                stop = max(start + 1, int(np.searchsorted(total, total[start] + most, "right")) - 1)
                m = stop - start
                token = pa.concat_arrays([x.slice(start, m).flatten() for x in both]).dictionary_encode().indices.to_numpy(zero_copy_only=False)
                size = np.concatenate([x[start:stop] for x in sizes])
                row, first = np.repeat(np.arange(2 * m), size), np.cumsum(size) - size
                # The running number of each equal token in its caption; rows from m are the references.
                wide = int(token.max(initial=0)) + 1
                cell = row * wide + token
                order = np.argsort(cell, kind="stable")
                head = np.concatenate([[True], cell[order][1:] != cell[order][:-1]])[: len(order)]
                nth = np.arange(len(order)) - np.maximum.accumulate(np.where(head, np.arange(len(order)), 0))
                place, pair = order - first[row[order]], row[order] % m
                # By pair, token and number; both sides are in that order.
                key = (pair * wide + token[order]) * (int(nth.max(initial=0)) + 1) + nth
                mine = row[order] < m
                _, a, b = np.intersect1d(key[mine], key[~mine], assume_unique=True, return_indices=True)
                pair, h, r = pair[mine][a], place[mine][a], place[~mine][b]
                along = np.lexsort((h, pair))
                pair, h, r = pair[along], h[along], r[along]
                opens = np.ones(len(pair), bool)
                opens[1:] = (pair[1:] != pair[:-1]) | (h[1:] != h[:-1] + 1) | (r[1:] != r[:-1] + 1)
                found = [pa.array(np.bincount(x, minlength=m), pa.int64()) for x in (pair, pair[opens])]
                keys = [batch.column(batch.schema.get_field_index(f.name)).slice(start, m) for f in fields]
                yield pa.RecordBatch.from_arrays([*keys, *found], names=[*[f.name for f in fields], "matches", "chunks"])
                start = stop

    schema = StructType([*fields, StructField("matches", LongType()), StructField("chunks", LongType())])
    return pairs.select(*ids, "cap_id", "hyp_len", "ref_len", "hyp", "ref").mapInArrow(run, schema)


def meteor(pred: DataFrame, refs: DataFrame, by: list[str] | None = None, pairs: DataFrame | None = None) -> DataFrame:
    """Best score over the references of each video; exact matches only."""
    p = F.col("matches") / F.greatest("hyp_len", F.lit(1))
    r = F.col("matches") / F.greatest("ref_len", F.lit(1))
    mean = 10 * p * r / F.greatest(r + 9 * p, F.lit(1e-8))
    penalty = 0.5 * F.pow(F.try_divide("chunks", "matches"), F.lit(3.0))
    score = F.when(F.col("matches") == 0, 0.0).otherwise((1.0 - penalty) * mean)
    return meteor_alignment(pred, refs, by, pairs).groupBy(*video_keys(by)).agg(F.max(score).alias("meteor"))


def missing_ground_truth(pred: DataFrame, refs: DataFrame, strict: bool = False, shown: int = 10) -> DataFrame:
    """Predictions without references; ``strict`` raises with the count and the first ids."""
    absent = pred.select(KEY).join(refs.select(KEY), KEY, "left_anti")
    if strict:
        total = absent.count()
        if total:
            first = [r[0] for r in absent.orderBy(KEY).limit(shown).collect()]
            raise ValueError(f"{total} predictions without ground truth, first: {first}")
    return absent


def valid_ids(pred: DataFrame, refs: DataFrame, categories: DataFrame) -> DataFrame:
    """Ids present in predictions, references and the category map."""
    return (
        pred.select(KEY).join(refs.select(KEY), KEY, "left_semi").join(categories.select(KEY, "category"), KEY)
    )


def reward_advantage(sampled: DataFrame, greedy: DataFrame, refs: DataFrame, batch: str = "batch") -> DataFrame:
    """Sampled minus greedy CIDEr per video, with document frequencies per batch."""
    a = cider_per_video(sampled, refs, [batch]).withColumnRenamed("cider", "sampled_cider")
    b = cider_per_video(greedy, refs, [batch]).withColumnRenamed("cider", "greedy_cider")
    return a.join(b, video_keys([batch])).withColumn("advantage", F.col("sampled_cider") - F.col("greedy_cider"))


def reward_means(advantages: DataFrame, batch: str = "batch") -> DataFrame:
    """Mean sampled score, greedy score and advantage of each batch."""
    names = ["sampled_cider", "greedy_cider", "advantage"]
    return advantages.groupBy(batch).agg(
        F.count(F.lit(1)).alias("videos"), *[F.avg(c).alias(f"mean_{c}") for c in names]
    )


def rank_categories(rows: DataFrame, k: int = 5) -> DataFrame:
    """Top and bottom ``k`` categories by CIDEr; ties by category."""
    top = rows.orderBy(F.desc("cider"), "category").limit(k).withColumn("side", F.lit("top"))
    low = rows.orderBy("cider", F.desc("category")).limit(k).withColumn("side", F.lit("bottom"))
    # At most k rows reach each of these windows.
    first = top.withColumn("place", F.row_number().over(W.partitionBy("side").orderBy(F.desc("cider"), "category")))
    last = low.withColumn("place", F.row_number().over(W.partitionBy("side").orderBy("cider", F.desc("category"))))
    return first.unionByName(last)
