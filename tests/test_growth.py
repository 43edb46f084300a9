"""What a query's work grows with: plans and results of the forms that keep large tables small."""

import json
import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from checks import store_queries as sq
from checks.registry import QUERIES
from framelark.functions import chunks
from framelark.functions.partitioned import dense_index
from framelark.operators import caption_metrics as m, captions
from framelark.sources import json_arrays, readers
from tests.conftest import SF


def optimized(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("name", ["E1_split_fused", "E1_bad_shapes"])
def test_fused_vectors_are_cut_not_computed_item_by_item(spark, name):
    assert "lambda" not in optimized(QUERIES[name](spark, SF))


def test_ramp_items(spark):
    rows = spark.range(0, 300).select("id", F.when(F.col("id") % 2 == 0, 1280).otherwise(7).alias("w"))
    for seed, vec in rows.select("id", sq.ramp(F.col("w"), F.col("id") * 31).alias("vec")).collect():
        assert vec == [(i * 7 + seed * 31) % 101 / 101.0 for i in range(1, (1280 if seed % 2 == 0 else 7) + 1)]


def test_running_sums_deal_rows_out_once(spark):
    df = spark.range(0, 500).select(F.expr("CASE WHEN id % 3 > 0 THEN id % 3 END").alias("k"), "id", F.lit("text").alias("t"))
    out = dense_index(df, ["k"], F.floor(F.col("id") / 16), ["id"], "pos", start=1)
    assert "Join" not in optimized(out)
    assert all(r["pos"] == r["id"] // 3 + 1 for r in out.collect())


def test_files_beyond_a_size_are_split(spark, tmp_path):
    want, folder = [], tmp_path / "m"
    folder.mkdir()
    for k, n in enumerate((3, 400)):
        sentences = [{"video_id": f"video{i % 5}", "caption": f"{k} {i} a brace }} and {{ a quote \""} for i in range(n)]
        videos = [{"video_id": f"video{k}", "id": k, "split": "train", "category": 1, "start time": 0.5, "end time": 1.5}]
        (folder / f"f{k}.json").write_text(json.dumps({"videos": videos, "sentences": sentences}))
        want += [(i, s["video_id"], s["caption"]) for i, s in enumerate(sentences)]
    whole = readers.read_metadata(spark, str(folder))
    split = readers.read_metadata(spark, str(folder), whole_bytes=2000)
    assert "binaryFile" not in optimized(whole[1]) and "elements" in split[1].inputFiles()[0] + split[1].inputFiles()[-1]
    for a, b in zip(whole, split):
        assert a.columns == b.columns and sorted(map(repr, a.collect())) == sorted(map(repr, b.collect()))
    assert sorted(r["caption"] for r in split[1].collect()) == sorted(c for _, _, c in want)


def test_one_piece_elements_are_not_grouped(spark, tmp_path):
    """The text of an element that no brace cuts takes part in one join and in no sort or window."""
    (tmp_path / "m.json").write_text(json.dumps({"sentences": [{"video_id": "video1", "caption": str(i)} for i in range(9)]}))
    elements = json_arrays.read_json_arrays(spark, str(tmp_path / "m.json"))
    plan = optimized(elements)
    assert "Window" not in plan and "Aggregate" in plan
    assert [(r["array"], r["line"]) for r in elements.orderBy("line").collect()] == [("sentences", i) for i in range(9)]


def test_only_distinct_words_of_a_chunk_are_dealt_out(spark):
    rows = [(f"video{i}", i % 3, " ".join(f"w{(i * j) % 7}" for j in range(i % 5))) for i in range(40)] + [("video99", 0, None)]
    df = spark.createDataFrame(rows, "video_id string, cap_id int, caption string")
    lists = df.select("video_id", "cap_id", F.split("caption", " ").alias("word")).coalesce(1)
    vocab = spark.createDataFrame([(f"w{k}", k + 4) for k in range(0, 7, 2)], "word string, idx int")
    for size in (1, 10, 1000):
        packed = chunks.pack(lists, "word", "t", size)
        assert packed.count() > 1 or size == 1000
        assert all(len(set(r["dictionary"])) == len(r["dictionary"]) for r in packed.collect())
        out = chunks.unpack(chunks.look_up(packed, vocab, "word", "idx", 3), "ids")
        want = {v: [int(w[1:]) + 4 if w and int(w[1:]) % 2 == 0 else 3 for w in t.split(" ")] if t is not None else [] for v, _, t in rows}
        assert {r["video_id"]: r["ids"] for r in out.collect()} == want
    enc = captions.encode_captions(df, vocab)
    assert "dictionary" in optimized(enc) and "explode(word" not in optimized(enc)


@pytest.mark.parametrize("by", [None, ["grp"]])
def test_cider_asks_once_per_chunk_and_only_shared_grams_come_back(spark, monkeypatch, by):
    words = "a b c d e".split()
    pred = [(f"v{i}", i % 2, " ".join(words[(i * j) % 5] for j in range(i % 9))) for i in range(30)]
    refs = [(f"v{i}", i % 2, c, " ".join(words[(i + c * j) % 5] for j in range((i + c) % 8))) for i in range(30) for c in range(i % 3)]
    p = spark.createDataFrame(pred, "video_id string, grp int, caption string")
    r = spark.createDataFrame(refs, "video_id string, grp int, cap_id int, caption string")
    p, r = m.scored_pairs(p, r, by)
    grams = lambda t: Counter((n, tuple(t[i : i + n])) for n in range(1, 5) for i in range(len(t) - n + 1))
    for size in (1, 40, 1 << 17):
        monkeypatch.setattr(m, "CHUNK_TOKENS", size)
        got = {x["video_id"]: x["cider"] for x in m.cider_per_video(p, r, by).collect()}
        want = {}
        for g in (0, 1) if by else (None,):
            mine = {v: t.split() for v, k, t in pred if g in (None, k) and any(v == x[0] for x in refs)}
            held = {v: [t.split() for x, _, _, t in refs if x == v] for v in mine}
            df = Counter(gram for v in mine for gram in set().union(*[grams(t) for t in held[v]]))
            weight = lambda t: {x: c * (math.log(len(mine)) - math.log(max(1, df[x]))) for x, c in grams(t).items()}
            for v, t in mine.items():
                h, total = weight(t), 0.0
                for ref in held[v]:
                    w, s = weight(ref), 0.0
                    for n in range(1, 5):
                        dot = sum(min(h.get(x, 0.0), y) * y for x, y in w.items() if x[0] == n)
                        size2 = [math.sqrt(sum(y * y for x, y in z.items() if x[0] == n)) for z in (h, w)]
                        s += dot / (size2[0] * size2[1]) if size2[0] and size2[1] else dot
                    gap = max(0, len(t) - 1) - max(0, len(ref) - 1)
                    total += s / 4 * math.exp(-(gap**2) / 72)
                want[v] = 10 * total / len(held[v])
        assert got == pytest.approx(want)
    shared = m.shared_frequency(r, by or []).collect()
    assert shared and all(x["df"] > 1 for x in shared)


def test_bleu_of_pairs_equals_that_of_ngram_tables(spark, monkeypatch):
    monkeypatch.setattr(m, "CHUNK_TOKENS", 30)
    words = "a b c".split()
    p = spark.createDataFrame([(f"v{i}", " ".join(words[(i * j) % 3] for j in range(i % 9))) for i in range(20)], "video_id string, caption string")
    refs = [(f"v{i}", c, " ".join(words[(i + c * j) % 3] for j in range((i + c) % 8))) for i in range(20) for c in range(i % 4)]
    r = spark.createDataFrame(refs, "video_id string, cap_id int, caption string")
    tables = m.ngram_counts(p, ["video_id"]), m.ngram_counts(r, ["video_id", "cap_id"])
    short, long = m.bleu_components(p, r), m.bleu_components(p, r, grams=tables)
    assert "gram" not in optimized(short)
    assert sorted(map(tuple, short.collect())) == sorted(map(tuple, long.collect()))


def test_cider_plans_start_from_stored_tokens(spark):
    """The origin of the captions stands in no plan with the n-grams, and no n-gram is a row."""
    p = spark.createDataFrame([(f"v{i}", i % 2, "a b c") for i in range(9)], "video_id string, grp int, caption string")
    r = spark.createDataFrame([(f"v{i}", i % 2, c, "a b d") for i in range(9) for c in range(2)], "video_id string, grp int, cap_id int, caption string")
    plan = optimized(m.cider_corpus(*m.scored_pairs(p, r, ["grp"]), ["grp"]))
    assert "LogicalRDD" not in plan and "explode" not in plan and "gram#" not in plan


def test_a_video_in_several_chunks_counts_once(spark, monkeypatch):
    words = "a b c d e f g".split()
    refs = [("hot", c, " ".join(words[(c * j) % 7] for j in range(1 + c % 6))) for c in range(40)] + [(f"v{i}", 0, f"a b {words[i]}") for i in range(6)]
    pred = [("hot", "a b c d")] + [(f"v{i}", "a b c") for i in range(6)]
    p = spark.createDataFrame(pred, "video_id string, caption string")
    r = spark.createDataFrame(refs, "video_id string, cap_id int, caption string")
    found = []
    for size in (5, 1 << 19):
        monkeypatch.setattr(m, "CHUNK_TOKENS", size)
        found.append({x["video_id"]: x["cider"] for x in m.cider_per_video(p, r).collect()})
    assert found[0] == pytest.approx(found[1])
    # "a" and "b" stand in all seven videos, so one-word weights of v1 are nought but for the last word.
    assert found[0]["v0"] != found[0]["v2"] and found[0]["v2"] > 0


def test_grouping_sets_start_from_stored_pairs(spark, monkeypatch):
    """No n-gram and no position of a token is a row; chunks of any size give the same."""
    from framelark.plans.evaluation import score_grouping_sets

    words = "a b c d e".split()
    pred = [(f"v{i}", i % 3, " ".join(words[(i * j) % 5] for j in range(2 + i % 5))) for i in range(12)]
    refs = [(f"v{i}", i % 3, c, " ".join(words[(i + c * j) % 5] for j in range(1 + (i + c) % 6))) for i in range(12) for c in range(2)]
    p = spark.createDataFrame(pred, "video_id string, cat int, caption string")
    r = spark.createDataFrame(refs, "video_id string, cat int, cap_id int, caption string")
    found = []
    for size in (9, 1 << 19):
        monkeypatch.setattr(m, "CHUNK_TOKENS", size)
        out = score_grouping_sets(p, r, [["cat"], []])
        plan = optimized(out)
        assert "gram#" not in plan and "explode(tokens" not in plan
        found.append({(x["grouping_set"], x["cat"]): (x["cider"], x["meteor"], x["bleu_2"], x["rouge_l"]) for x in out.collect()})
    assert len(found[0]) == 4 and all(found[0][k] == pytest.approx(found[1][k]) for k in found[0])


def test_vocabulary_counts_words_of_many_captions_at_once(spark, monkeypatch):
    """No word of a caption is a row; frequencies and first places are those of the rows, also under null and repeated keys."""
    rows = [(f"video{(i * 7) % 20}", i % 2, " ".join(f"w{(i * j) % 11}" for j in range(i % 6))) for i in range(60)]
    rows += [("video3", 0, "w1 new w2"), ("video3", 0, "new w9"), (None, 1, "w5 lost"), ("video4", None, "lost w3"), ("video5", 1, None)]
    df = spark.createDataFrame(rows, "video_id string, cap_id int, caption string").coalesce(1)
    assert "explode(filter" not in optimized(captions.build_vocab(df))
    least = lambda x: tuple((v is not None, v) for v in x)
    want = {}
    for video, cap, text in rows:
        for pos, word in enumerate((text or "").split()):
            at = (int(video[5:]) if video else None, cap, pos)
            n, first = want.get(word, (0, at))
            want[word] = (n + 1, min(first, at, key=least))
    for size in (1, 20, 1 << 23):
        monkeypatch.setattr(captions, "FIRST_SEEN_BYTES", size)
        got = captions._first_seen(df).groupBy("word").agg(F.sum("freq").alias("n"), F.min(F.struct("num", "cap_id", "pos")).alias("at"))
        assert {x["word"]: (x["n"], tuple(x["at"])) for x in got.collect()} == want


def test_places_of_a_chunk_are_compressed(spark):
    lists = spark.createDataFrame([("v", ["a", "b", "a"]), ("w", []), ("x", None), ("y", [""])], "video_id string, word array<string>").coalesce(1)
    packed = chunks.pack(lists, "word", "t")
    assert dict(packed.dtypes)["items"] == "binary"
    vocab = spark.createDataFrame([("a", 4), ("", 5)], "word string, idx int")
    out = chunks.unpack(chunks.look_up(packed, vocab, "word", "idx", 3), "ids")
    assert {x["video_id"]: x["ids"] for x in out.collect()} == {"v": [4, 3, 4], "w": [], "x": [], "y": [5]}
    zero = spark.createDataFrame([("v", ["a\0b"])], "video_id string, word array<string>")
    with pytest.raises(Exception, match="zero character"):
        chunks.pack(zero, "word", "t")
