"""Readers and writers on small files; text helpers; strict modes."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from framelark.functions.text import strip_ptb_punct, tokenize_eval, tokenize_vocab
from framelark.operators import captions, features, scenes, selection, splits
from framelark.sources import readers, sinks
from framelark.sources.json_arrays import read_json_arrays


def test_metadata_and_caption_map(spark, tmp_path):
    meta = {
        "videos": [{"video_id": "video3", "id": 3, "split": "validate", "category": 2, "start time": 1.0, "end time": 4.5}],
        "sentences": [{"video_id": "video3", "caption": "one"}, {"video_id": "video3", "caption": "two"}],
    }
    (tmp_path / "m.json").write_text(json.dumps(meta, indent=1))
    videos, sentences = readers.read_metadata(spark, str(tmp_path / "m.json"))
    assert videos.first()["end_time"] == 4.5
    want = {("video3", 0, "one"), ("video3", 1, "two")}
    assert {tuple(r) for r in sentences.collect()} == want
    assert {tuple(r) for r in readers.read_captions(spark, str(tmp_path / "m.json")).collect()} == want
    (tmp_path / "c.json").write_text(json.dumps({"video3": ["one", "two"]}))
    assert {tuple(r) for r in readers.read_captions(spark, str(tmp_path / "c.json")).collect()} == want
    (tmp_path / "p.json").write_text(json.dumps({"video3": [{"image_id": "video3", "caption": "x"}]}))
    assert [tuple(r) for r in readers.read_predictions(spark, str(tmp_path / "p.json")).collect()] == [("video3", "x")]


def test_prompts(spark, tmp_path):
    (tmp_path / "p.txt").write_text("# note\n\n  a new prompt \na group of people\na new prompt\n")
    rows = readers.load_prompts(spark, str(tmp_path / "p.txt")).orderBy("ord").collect()
    assert [r["prompt"] for r in rows] == readers.DEFAULT_PROMPTS + ["a new prompt"]


def test_files_and_matrices(spark, tmp_path):
    for root, value in (("first", 1.0), ("second", 2.0)):
        (tmp_path / root / "deep").mkdir(parents=True)
        np.save(tmp_path / root / "deep" / "video1.npy", np.full((3, 2), value, dtype="float32"))
    np.save(tmp_path / "second" / "video2.npy", np.zeros((1, 2), dtype="float32"))
    found = readers.list_files(spark, [str(tmp_path / "first"), str(tmp_path / "second")], "*.npy").collect()
    assert {r["video_id"]: r["root_priority"] for r in found} == {"video1": 0, "video2": 1}
    rows = readers.read_feature_files(spark, str(tmp_path / "second")).collect()
    assert {(r["video_id"], r["pos"], tuple(r["vec"])) for r in rows} == {
        *[("video1", i, (2.0, 2.0)) for i in range(3)], ("video2", 0, (0.0, 0.0))
    }


def test_writers(spark, tmp_path):
    ids = spark.createDataFrame([("train", "video10"), ("train", "video9"), ("val", "video1")], "split string, video_id string")
    sinks.write_id_list(ids, str(tmp_path / "ids"))
    assert {tuple(r) for r in spark.read.text(str(tmp_path / "ids")).collect()} == {
        ("video10", "train"), ("video9", "train"), ("video1", "val")
    }
    bad = spark.createDataFrame([("video1", "boom")], "video_id string, error string")
    for _ in range(2):
        sinks.write_failures(bad, str(tmp_path / "fail"))
    assert spark.read.json(str(tmp_path / "fail")).count() == 2
    sel = spark.createDataFrame([("v", 4, 2.0), ("v", 1, 0.5)], "video_id string, sample_index int, timestamp_sec double")
    sinks.write_timestamps(sel, str(tmp_path / "ts"))
    back = spark.read.option("header", True).csv(str(tmp_path / "ts")).orderBy("selected_rank").collect()
    assert [r["timestamp_sec"] for r in back] == ["0.500000", "2.000000"]
    rows = spark.createDataFrame([(1, 2.0)], "category int, cider double")
    sinks.write_metrics(rows, str(tmp_path / "metrics"))
    assert spark.read.option("header", True).csv(str(tmp_path / "metrics")).columns == sinks.CATEGORY_COLUMNS


def test_tokenizers(spark):
    df = spark.createDataFrame([("Don't  STOP, now! 2 ",)], "t string")
    assert df.select(tokenize_vocab(F.col("t"))).first()[0] == ["dont", "stop", "now", "2"]
    assert df.select(tokenize_eval(F.col("t"))).first()[0] == "don t stop now 2"
    ptb = spark.createDataFrame([("a cat , -LRB- big -RRB- sat\n. ''",)], "t string")
    assert ptb.select(strip_ptb_punct(F.col("t"))).first()[0] == "a cat big sat"


def test_encode_and_decode(spark):
    sent = spark.createDataFrame(
        [("video2", 0, "b a"), ("video10", 0, "a c"), ("video2", 1, "a b")], "video_id string, cap_id int, caption string"
    )
    vocab = captions.build_vocab(sent, 2).cache()
    words = {r["word"]: r["idx"] for r in vocab.collect()}
    assert words == {"<pad>": 0, "<sos>": 1, "<eos>": 2, "<unk>": 3, "b": 4, "a": 5}
    enc = captions.encode_captions(sent, vocab)
    ids = {(r["video_id"], r["cap_id"]): list(r["ids"]) for r in enc.collect()}
    assert ids["video10", 0] == [1, 5, 3, 2]
    text = {(r["video_id"], r["cap_id"]): r["text"] for r in captions.decode_ids(enc, vocab).collect()}
    assert text["video2", 0] == "b a" and text["video10", 0] == "a <unk>"
    raw = spark.createDataFrame([("v", 0, [1, 99, 0, 5, 2, 4])], "video_id string, cap_id int, ids array<int>")
    assert captions.decode_ids(raw, vocab).first()["text"] == "<unk> a"


def test_strict_resolution(spark):
    videos = spark.createDataFrame([("video1", "train"), ("video2", "val")], "video_id string, split string")
    files = spark.createDataFrame([("video1", "/x")], "video_id string, path string")
    assert splits.resolve_splits(videos, files).count() == 2
    with pytest.raises(FileNotFoundError, match="val=1"):
        splits.resolve_splits(videos, files, strict=True)


def test_evenly_spaced(spark):
    def direct(count, target):
        if count <= 0 or target <= 0:
            return []
        if target >= count:
            return list(range(count))
        return sorted({round(i * (count - 1) / max(target - 1, 1)) for i in range(target)})

    for target in (1, 2, 5, 8):
        rows = spark.range(0, 40).select("id", splits.evenly_spaced(F.col("id").cast("int"), target).alias("p")).collect()
        for r in rows:
            assert list(r["p"]) == direct(r["id"], target)


def test_windows_and_masks(spark):
    one = [("a", i, 1.0) for i in range(5)] + [("b", i, 2.0) for i in range(9)]
    df = spark.createDataFrame(one, "video_id string, pos int, v double")
    got = {(r["video_id"], r["win"]): list(r["items"]) for r in features.chunk_windows(df, "v", 4).collect()}
    assert got == {("a", 0): [1.0] * 4, ("b", 0): [2.0] * 4, ("b", 1): [2.0] * 4}
    short = features.chunk_windows(df.filter("video_id = 'a'"), "v", 8).first()
    assert list(short["items"]) == [1.0] * 5 + [0.0] * 3


def test_resample_edges(spark):
    def run(rows, n):
        df = spark.createDataFrame(rows, "video_id string, sample_index int, timestamp_sec double, fused array<double>")
        out = selection.resample_embeddings(df, n).orderBy("slot").collect()
        assert [r["slot"] for r in out] == list(range(n))
        return [r["vec"][0] for r in out]

    assert run([("v", 0, 3.0, [7.0])], 4) == [7.0] * 4
    assert run([("v", 0, 1.0, [0.0]), ("v", 1, 1.0, [3.0])], 4) == pytest.approx([0.0, 1.0, 2.0, 3.0])
    assert run([("v", 0, 0.0, [0.0]), ("v", 1, 1.0, [1.0]), ("v", 2, 4.0, [4.0])], 5) == pytest.approx([0, 1, 2, 3, 4])
    same = [("v", i, float(i), [float(i)]) for i in range(3)]
    assert run(same, 3) == [0.0, 1.0, 2.0]


def test_short_videos_have_scenes(spark):
    rows = [("a", i, i * 0.5, 0.1) for i in range(2)] + [("b", 0, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "video_id string, sample_index int, timestamp_sec double, boundary_score double")
    out = scenes.detect_scenes(df).collect()
    assert {(r["video_id"], r["sample_index"], r["scene_id"]) for r in out} == {("a", 0, 0), ("a", 1, 0), ("b", 0, 0)}


def test_missing_metrics_never_win(spark):
    from framelark.operators import runs

    rows = [(1, 1, None, None), (1, 2, 0.5, 0.1), (1, 3, None, 0.3), (1, 4, 0.3, None), (2, 1, None, None)]
    history = spark.createDataFrame(rows, "run_id int, epoch int, val_loss double, val_cider double")
    got = {r["run_id"]: r for r in runs.best_epoch(history).collect()}
    assert (got[1]["loss_epoch"], got[1]["best_val_loss"], got[1]["cider_epoch"]) == (4, 0.3, 3)
    assert got[2]["loss_epoch"] is None
    flags = {(r["run_id"], r["epoch"]): (r["best_loss"], r["best_cider"]) for r in runs.checkpoint_flags(history).collect()}
    assert flags == {(1, 1): (False, False), (1, 2): (True, True), (1, 3): (False, True), (1, 4): (True, False), (2, 1): (False, False)}


def test_samples_are_dense_and_the_last_row_of_an_id_wins(spark):
    from framelark.operators import splits

    frames = spark.createDataFrame([("v", i) for i in (0, 2, 6, 8, 9)], "video_id string, frame_index int")
    header = spark.createDataFrame([("v", 2, 10.0)], "video_id string, stride int, fps double")
    got = sorted(tuple(r) for r in splits.sample_frames(frames, header).select("frame_index", "sample_index").collect())
    assert got == [(0, 0), (2, 1), (6, 2), (8, 3)]
    videos = spark.createDataFrame([("v", 1, "test", 3, 0), ("v", 1, "test", 5, 2), ("v", 1, "test", 4, 1)], "video_id string, id int, split string, category int, line int")
    assert splits.category_map(videos, "line").first()["category"] == 5


def test_samples_carry_columns_and_sort_no_frames(spark):
    from framelark.operators import splits

    gone = {3 * i for i in range(0, 1000, 7)}
    frames = spark.range(0, 3000).filter(~F.col("id").isin(gone)).select(
        F.lit("v").alias("video_id"), F.col("id").cast("int").alias("frame_index"), (F.col("id") * 2).alias("extra")
    )
    header = spark.createDataFrame([("v", 3, 10.0)], "video_id string, stride int, fps double")
    want = [(i, i * 2, n, i / 10.0) for n, i in enumerate(i for i in range(0, 3000, 3) if i not in gone)]
    out = splits.sample_frames(frames, header).select("frame_index", "extra", "sample_index", "timestamp_sec")
    assert sorted(tuple(r) for r in out.collect()) == want
    slim = splits.sample_frames(frames.drop("extra"), header, max_samples=200)
    assert sorted(r["sample_index"] for r in slim.collect()) == list(range(200))
    plan = slim._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan


def test_scratch_scope_removes_its_tables(spark):
    import os

    from framelark.functions.storage import scratch_scope, write_through

    with scratch_scope(spark) as made:
        assert write_through(spark.range(5).toDF("id"), "scoped").count() == 5
        folders = [p.removeprefix("file:") for p in made]
        assert len(folders) == 1 and os.path.isdir(folders[0])
    assert not os.path.exists(folders[0])


def test_captions_of_one_id_in_two_files(spark, tmp_path):
    for name, texts in (("b.json", ["x", "y"]), ("a.json", ["p", "q"])):
        whole = {"videos": [], "sentences": [{"video_id": "v", "caption": t} for t in texts]}
        (tmp_path / name).write_text(json.dumps(whole))
    got = readers.read_captions(spark, str(tmp_path)).orderBy("cap_id").select("caption").collect()
    assert [r[0] for r in got] == ["p", "x", "q", "y"]
    frames = spark.range(1000).select(F.lit("dino").alias("family"), F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("split"), "id")
    sinks.write_features(frames, str(tmp_path / "f"), most_records=100)
    assert len(list((tmp_path / "f").rglob("*.parquet"))) == 10 and spark.read.parquet(str(tmp_path / "f")).count() == 1000


def test_json_arrays_split_anywhere(spark, tmp_path):
    """Braces, quotes and escapes at every border, nested objects, objects beside the arrays, against the plain parser."""
    odd = ['}', '{"', '\\', '\\"', 'a}, {"b": [', '"}', 'é\u2028}', '', 'x\\\\', ']} "sentences": [', '\n}\t{']
    docs = []
    for d in range(3):
        sents = [{"video_id": f"v{i}", "caption": odd[(i + d) % len(odd)] * (i % 3 + 1), "more": [{"k": {"z": "}"}}] * (i % 2)} for i in range(150)]
        vids = [{"video_id": f"v{i}", "id": i, "odd}": {}} for i in range(20)]
        doc = {"info": {"year": 1, "x": {"y": "{"}}, "n": "a {b", "years": [1, 2], "videos": vids, "none": [], "sentences": sents, "end": {"a": 1}}
        docs.append({k: doc[k] for k in (doc if d else ("videos", "n", "sentences", "info"))})
        (tmp_path / f"d{d}.json").write_text(json.dumps(doc if d else docs[0], indent=d or None, ensure_ascii=d < 2) + "\n" * d)
    (tmp_path / "empty.json").write_text("")
    (tmp_path / "none.json").write_text('{"videos": [], "sentences": []}')
    want = sorted((f"d{d}.json", n, i, json.dumps(e, sort_keys=True)) for d, doc in enumerate(docs) for n in ("videos", "sentences") for i, e in enumerate(doc[n]))
    for size in ("128m", "700b"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            got = read_json_arrays(spark, str(tmp_path)).collect()
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
        assert sorted((r.file.rpartition("/")[2], r.array, r.line, json.dumps(json.loads(r.element), sort_keys=True)) for r in got) == want
    plain = readers.read_metadata(spark, str(tmp_path / "d1.json"))
    large = readers.read_large_metadata(spark, str(tmp_path / "d1.json"))
    for a, b in zip(plain, large):
        assert sorted(map(repr, a.collect())) == sorted(map(repr, b.select(*a.columns).collect()))
