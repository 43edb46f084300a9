"""Caption metrics on two worked videos and on simple identities."""

import math
import random

import pytest
from pyspark.sql import functions as F

from framelark.operators import caption_metrics as m
from framelark.plans.evaluation import score_captions, score_per_video

REFS = [
    ("184321", 0, "A train traveling down tracks next to lights."),
    ("184321", 1, "A train coming down the tracks arriving at a station."),
    ("81922", 0, "A large jetliner flying over a traffic filled street."),
    ("81922", 1, "The plane is flying over top of the cars"),
]
PRED = [("184321", "train traveling down a track in front of a road"), ("81922", "plane is flying through the sky")]


@pytest.fixture(scope="module")
def sample(spark):
    return (
        spark.createDataFrame(PRED, "video_id string, caption string"),
        spark.createDataFrame(REFS, "video_id string, cap_id int, caption string"),
    )


def by_id(df, col):
    return {r["video_id"]: r[col] for r in df.collect()}


def test_worked_values(sample):
    pred, refs = sample
    parts = {r["video_id"]: r for r in m.bleu_components(pred, refs).collect()}
    # train, traveling, down, a (once in a reference that has it twice at most) and one more "a".
    one = parts["184321"]
    assert (one["test_len"], one["guess_1"], one["guess_4"]) == (10, 10, 7)
    assert (one["correct_1"], one["correct_2"], one["correct_3"]) == (5, 2, 1)
    assert one["ref_len"] == 10.0
    two = parts["81922"]
    assert (two["test_len"], two["correct_1"], two["correct_2"], two["ref_len"]) == (6, 4, 2, 9.0)
    bleu = {r["video_id"]: r for r in m.bleu_per_video(pred, refs).collect()}
    assert bleu["184321"]["bleu_1"] == pytest.approx(0.5, abs=1e-6)
    assert bleu["81922"]["bleu_1"] == pytest.approx(4 / 6 * math.exp(1 - 9 / 6), abs=1e-6)
    # train traveling down | plane is flying, the: three and four matches.
    rouge = by_id(m.rouge_l(pred, refs), "rouge_l")
    assert rouge["81922"] == pytest.approx(2 * (4 / 6) * (4 / 9) / (4 / 6 + 4 / 9))
    total = m.bleu_corpus(pred, refs).first()
    assert total["bleu_1"] == pytest.approx(9 / 16 * math.exp(1 - 19 / 16), abs=1e-6)


def test_all_metrics_in_one_table(sample):
    pred, refs = sample
    per = score_per_video(pred, refs).collect()
    whole = score_captions(pred, refs).first()
    assert whole["num_videos"] == 2
    for name in ("meteor", "rouge_l", "cider"):
        assert whole[name] == pytest.approx(sum(r[name] for r in per) / 2)


def test_identical_caption(spark):
    text = "one two three four five six"
    pred = spark.createDataFrame([("a", text)], "video_id string, caption string")
    refs = spark.createDataFrame([("a", 0, text)], "video_id string, cap_id int, caption string")
    assert m.bleu_per_video(pred, refs).first()["bleu_4"] == pytest.approx(1.0, abs=1e-6)
    assert m.meteor(pred, refs).first()["meteor"] == pytest.approx(1 - 0.5 / 6**3)
    assert m.rouge_l(pred, refs).first()["rouge_l"] == pytest.approx(1.0)
    # One scored video: N = 1, so every weight is ln 1 = 0.
    assert m.cider_per_video(pred, refs).first()["cider"] == 0.0


def test_empty_caption_keeps_its_row(spark):
    pred = spark.createDataFrame([("a", "..."), ("b", "a b")], "video_id string, caption string")
    refs = spark.createDataFrame(
        [("a", 0, "x y"), ("b", 0, "a b"), ("b", 1, "!")], "video_id string, cap_id int, caption string"
    )
    row = {r["video_id"]: r for r in score_per_video(pred, refs).collect()}
    assert row["a"]["bleu_1"] == row["a"]["meteor"] == row["a"]["rouge_l"] == row["a"]["cider"] == 0.0
    # Unigrams and bigrams match fully in one of two references; half of n = 1..4.
    assert row["b"]["cider"] == pytest.approx(2.5)


def table_lcs(a, b):
    rows = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            rows[i + 1][j + 1] = rows[i][j] + 1 if x == y else max(rows[i][j + 1], rows[i + 1][j])
    return rows[-1][-1]


def test_lcs_against_table(spark):
    rng = random.Random(4)
    data = [
        ([rng.choice("abcd") for _ in range(rng.randint(0, 90))], [rng.choice("abcde") for _ in range(rng.randint(0, 90))])
        for _ in range(60)
    ]
    df = spark.createDataFrame(data, "a array<string>, b array<string>")
    for row in df.select("a", "b", m.lcs_length("a", "b").alias("n")).collect():
        assert row["n"] == table_lcs(row["a"], row["b"])


def test_hot_video(spark):
    """One video with most references gives the same scores as the definition."""
    refs = [("hot", i, f"a cat number {i % 7} sits") for i in range(300)] + [("b", 0, "a dog runs")]
    pred = [("hot", "a cat sits"), ("b", "a dog sits")]
    p = spark.createDataFrame(pred, "video_id string, caption string")
    r = spark.createDataFrame(refs, "video_id string, cap_id int, caption string")
    rouge = by_id(m.rouge_l(p, r), "rouge_l")
    assert rouge["hot"] == pytest.approx(2 * 1 * (3 / 5) / (1 + 3 / 5))
    assert m.cider_per_video(p, r).count() == 2


def test_strict_ground_truth(sample):
    pred, refs = sample
    with pytest.raises(ValueError, match="1 predictions"):
        m.missing_ground_truth(pred, refs.filter("video_id = '81922'"), strict=True)


def test_grouping_sets_equal_one_evaluation_per_group(spark):
    """Ids that come again in other groups, and a null group that counts only where its column does not."""
    from framelark.plans.evaluation import score_captions, score_grouping_sets

    words = "a man is riding the big red horse on a beach".split()
    pred, refs = [], []
    for i in range(24):
        cat, part = (None if i % 7 == 3 else i % 3), ("x", "y")[i % 2]
        video = f"v{i % 10}"  # 10 to 19 and 20 to 23 repeat the ids, some of them in the same category
        part = f"{part}{i // 10}"
        pred.append((video, cat, part, " ".join(words[i % 4 : i % 4 + 3 + i % 5])))
        refs += [(video, cat, part, c, " ".join(words[(i + c) % 5 : (i + c) % 5 + 6])) for c in range(3)]
    pred = spark.createDataFrame(pred, "video_id string, cat int, part string, caption string")
    refs = spark.createDataFrame(refs, "video_id string, cat int, part string, cap_id int, caption string")
    sets = [["cat", "part"], ["cat"], ["part"], []]
    names = ["num_videos", "bleu_1", "bleu_4", "meteor", "rouge_l", "cider"]
    got = {(r.grouping_set, r.cat, r.part): [r[n] for n in names] for r in score_grouping_sets(pred, refs, sets).collect()}
    unique = F.concat("video_id", F.lit("/"), F.coalesce(F.col("cat").cast("string"), F.lit("-")), F.col("part")).alias("video_id")
    p, r = pred.select(unique, "cat", "part", "caption"), refs.select(unique, "cat", "part", "cap_id", "caption")
    want = {}
    for i, by in enumerate(sets):
        for row in score_captions(p.dropna(subset=by) if by else p, r.dropna(subset=by) if by else r, by).collect():
            d = row.asDict()
            want[i, d.get("cat"), d.get("part")] = [d[n] for n in names]
    assert got.keys() == want.keys() and got[3, None, None][0] == 24
    for k in want:
        assert got[k] == pytest.approx(want[k]), k
