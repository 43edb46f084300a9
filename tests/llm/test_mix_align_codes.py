"""Source mixing, token alignment and vector codes against brute force, and on odd rows."""

from __future__ import annotations

import hashlib
import random
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from framelark.llm.mixing import mix_sources, sainte_lague, share_targets
from framelark.llm.queries import QUERIES, vocabulary_path
from framelark.llm.shipping import ship
from framelark.llm.token_alignment import align_tokenizers, alignment_report, coalesce_intervals
from framelark.llm.vector_codes import SliceIndex, compress_vectors
from framelark.llm.word_split import byte_chars
from tests.conftest import SF
from tests.llm.helpers import CLASHING, document_frame, odd_documents

A, B = "byte_bpe_50k.json", "piece_bpe_32k.model"


@pytest.fixture(autouse=True)
def shipped(spark):
    ship(spark)


# --- mixing ----------------------------------------------------------------


def brute_targets(sizes: dict, weights, percent=150, most=2) -> dict:
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, open_sources, left = {}, list(order), Fraction(percent * sum(sizes.values()), 100)
    while open_sources:
        unit = left / sum(weight[s] for s in open_sources)
        full = [s for s in open_sources if unit * weight[s] >= most * sizes[s]]
        if not full:
            return target | {s: unit * weight[s] for s in open_sources}
        for s in full:
            target[s] = Fraction(most * sizes[s])
            left -= target[s]
            open_sources.remove(s)
    return target


@pytest.mark.parametrize("seed", range(3))
def test_targets_by_refilling(spark, seed):
    rnd = random.Random(seed)
    sizes = {rnd.choice(["", "a", "Ä", "z"]) + str(i): rnd.choice([0, 1, 50, 5000, 10**6]) + rnd.randint(0, 9) for i in range(12)}
    sizes[None] = 777
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size bigint")
    got = {r.source: r.target for r in share_targets(df, [3, 1, 2]).collect()}
    want = brute_targets(sizes, [3, 1, 2])
    assert got.keys() == want.keys()
    assert all(abs(got[s] - float(want[s])) <= 1e-9 * max(1.0, float(want[s])) for s in want)


@pytest.mark.parametrize("seed", range(3))
def test_quotas_are_the_highest_quotients(spark, seed):
    rnd = random.Random(seed)
    rows = []
    for g in range(4):
        shares = [rnd.choice([0, 1, 3, 40, 900]) for _ in range(rnd.randint(1, 9))]
        seats = min(sum(shares), rnd.choice([0, 1, 7, 500])) if g else sum(shares)
        rows += [(g, i, s, sum(shares), len(shares), seats, 2 * s) for i, s in enumerate(shares)]
    df = spark.createDataFrame(rows, "g int, i int, share bigint, total bigint, rivals bigint, seats bigint, cap bigint")
    got = {(r.g, r.i): r.quota for r in sainte_lague(df, ["g"], "share", "total", "rivals", "seats", "cap", "i").collect()}
    for g in range(4):
        mine = [r for r in rows if r[0] == g]
        quotients = sorted((-s / (2 * k - 1), i) for _, i, s, _, _, _, cap in mine for k in range(1, cap + 1))
        want = Counter(i for _, i in quotients[: mine[0][5]])
        assert {i: got[g, i] for _, i, *_ in mine} == {i: want[i] for _, i, *_ in mine}


def mix_frame(spark, rows):
    data = [(i, t, s, 1, "b", 2, "i", "t", "d", 3, "k") for i, t, s in rows]
    return spark.createDataFrame(data, "doc_id bigint, text string, source string, " + CLASHING)


def test_mix_of_odd_rows_and_small_shards(spark):
    rnd = random.Random(3)
    rows = [(i, "w " * rnd.randint(0, 400), rnd.choice(["hot", "hot", "b", "Z"])) for i in range(300)]
    rows += [(None, "x y z", None), (None, "x y z", None), (7, "again and again", "b"), (900, None, "b"), (901, "", None), (902, " \t\n", "b")]
    rows += [(903, "long " * 5_000, "long"), (904, None, "empty")]
    df = mix_frame(spark, rows)
    options = dict(block_words=8, shard_words=2000, shard_rows=40)
    got = mix_sources(df, **options).collect()
    assert len(got) == len(rows)
    assert sorted(map(repr, got)) == sorted(map(repr, mix_sources(df.repartition(7), **options).collect()))
    sizes, taken, target = Counter(), Counter(), {}
    for r in got:
        assert 0 <= r.taken <= 2 * r.size
        assert r.taken == r.copies * r.size + sum(x.to_word - x.from_word for x in r.spans)
        assert all(0 <= x.from_word < x.to_word <= r.size for x in r.spans)
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
    want = brute_targets(dict(sizes), [3, 1, 2])
    assert Counter((i, len((t or "").split())) for i, t, _ in rows) == Counter((r.doc_id, r.size) for r in got)
    for s in sizes:
        assert abs(target[s] - float(want[s])) < 1e-6
        assert abs(taken[s] - target[s]) <= 0.002 * target[s] + 16
    assert mix_sources(df, **options, seed=12).select("doc_id", "taken").exceptAll(mix_sources(df, **options).select("doc_id", "taken")).count()


def test_mix_without_words_or_rows(spark):
    got = mix_sources(mix_frame(spark, [(1, None, "a"), (2, " ", None)])).collect()
    assert [(r.taken, r.target) for r in got] == [(0, 0.0)] * 2
    assert mix_sources(mix_frame(spark, [])).collect() == []


# --- alignment -------------------------------------------------------------


def brute_alignment(rows):
    import sentencepiece
    from tokenizers import Tokenizer

    one = Tokenizer.from_file(vocabulary_path(A))
    one.encode_special_tokens = True
    two = sentencepiece.SentencePieceProcessor(model_file=vocabulary_path(B))
    back, counts, per = byte_chars(), Counter(), []

    def piece(i):
        p = two.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if two.is_byte(i) else p.replace("▁", " ").encode()

    for i, text in rows:
        full = (" " + (text or "")).encode()
        a = one.encode(" " + text, add_special_tokens=False).ids if text else []
        b = two.encode(text) if text else []
        parts = [[bytes(back[c] for c in one.id_to_token(x)) for x in a], [piece(x) for x in b]]
        if b"".join(parts[0]) != full or b"".join(parts[1]) != full:
            per.append((i, 0, 0, 0, [], ""))
            continue
        ends = [np.cumsum([len(p) for p in side]).tolist() for side in parts]
        groups, links, at = [], [], [0, 0]
        for c in sorted(set(ends[0]) & set(ends[1])):
            stop = [ends[0].index(c) + 1, ends[1].index(c) + 1]
            ga, gb = a[at[0] : stop[0]], b[at[1] : stop[1]]
            at = stop
            groups.append(",".join(map(str, ga)) + "|" + ",".join(map(str, gb)))
            links.append((ga[-1], gb[-1]))
        counts.update(links)
        per.append((i, len(a), len(b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    best = Counter()
    for (_, y), n in counts.items():
        best[y] = max(best[y], n)
    return [(i, na, nb, g, len(ls), sum(counts[p] == best[p[1]] for p in ls), sum(counts[p] for p in ls), h) for i, na, nb, g, ls, h in per]


def test_alignment_of_odd_texts(spark):
    texts = ["a ", " ", "  a  b \n c\t\n", "<|endoftext|> x <s> </s><unk> <pad>", "▁x", "日本語テキスト😀", "\x00\x01a", "é́", "<0x41>   　z", "\r\n\r\n"]
    rows = [r for r in odd_documents() if not r[1] or len(r[1]) < 5000] + [(500 + i, t) for i, t in enumerate(texts)]
    got = [tuple(r) for r in alignment_report(document_frame(spark, rows), vocabulary_path(A), vocabulary_path(B)).collect()]
    assert sorted(got, key=repr) == sorted(brute_alignment(rows), key=repr)


def test_alignment_groups_hold_all_tokens(spark):
    rows = [(1, "ab " * 20_000), (2, None), (None, "x"), (3, "unbelievably")]
    got = {r.doc_id: r for r in align_tokenizers(document_frame(spark, rows), vocabulary_path(A), vocabulary_path(B)).collect()}
    assert got[2].a_ids == [] and len(got) == 4
    for r in got.values():
        assert sum(r.a_in) == len(r.a_ids) and sum(r.b_in) == len(r.b_ids) and len(r.a_in) == len(r.b_in)
        assert all(r.a_in) and all(r.b_in)
    assert alignment_report(document_frame(spark, []), vocabulary_path(A), vocabulary_path(B)).collect() == []


def test_intervals_coalesce_by_running_maximum():
    order, group = coalesce_intervals(np.array([0, 4, 0, 2, 6, 6]), np.array([4, 6, 2, 5, 9, 9]))
    assert group[np.argsort(order)].tolist() == [0, 0, 0, 0, 1, 1]


def test_registered_alignment(spark, con):
    rows = con.execute("SELECT doc_id, text FROM documents").fetchall()
    got = [tuple(r) for r in QUERIES["op12_token_alignment"](spark, SF).collect()]
    assert sorted(got) == sorted(brute_alignment(rows))


# --- vector codes ----------------------------------------------------------


def brute_codes(rows, parts=16, entries=64, rounds=2):
    kept = [r for r in rows if r[1] is not None and all(c is not None and np.isfinite(c) for c in r[1])]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, [int(np.floor(256 * c)) for c in r[1]]))
    x = np.array([[int(np.floor(256 * float(c))) for c in v] for _, v, _ in kept], np.int64).reshape(len(kept), parts, -1)
    books = x[:entries].transpose(1, 0, 2).copy()
    for _ in range(rounds):
        codes = ((x[:, :, None] - books[None]) ** 2).sum(axis=3).argmin(axis=2)
        for p in range(parts):
            for e in range(books.shape[1]):
                mine = x[codes[:, p] == e, p]
                if len(mine):
                    books[p, e] = [int(s) // len(mine) for s in mine.sum(axis=0)]
    far = ((x[:, :, None] - books[None]) ** 2).sum(axis=3)
    codes, error = far.argmin(axis=2), far.min(axis=2).sum(axis=1).tolist()
    digest = hashlib.sha256(",".join(str(n) for n in books.ravel().tolist()).encode()).hexdigest()
    total = Counter()
    for (_, _, label), e in zip(kept, error):
        total[label] += e
    return [(r[0], "".join(f"{c:02x}" for c in code), e, total[r[2]], digest) for r, code, e in zip(kept, codes.tolist(), error)]


def vector_frame(spark, rows):
    data = [(i, v, k, 1, "b", 2, "i", "t", "d", 3, "k") for i, v, k in rows]
    return spark.createDataFrame(data, "vec_id bigint, embedding array<float>, label int, " + CLASHING)


def codes_of(df):
    return sorted((tuple(r) for r in df.select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()), key=repr)


@pytest.mark.parametrize("n", [5, 400])
def test_codes_of_odd_vectors(spark, n):
    rng = np.random.default_rng(n)
    rows = [(int(i), np.float32(rng.normal(size=32) * rng.choice([0.01, 1, 30])).tolist(), int(rng.integers(3))) for i in rng.permutation(n)]
    rows += [(1, [0.0] * 32, None), (1, [0.0] * 32, None), (None, [1.0] * 32, 2), (-3, [-0.001] * 32, None)]
    rows += [(900, None, 1), (901, [1.0] * 31 + [None], 1), (902, [float("nan")] * 32, 1), (903, [float("-inf")] + [0.0] * 31, None)]
    assert codes_of(compress_vectors(vector_frame(spark, rows))) == sorted(brute_codes(rows), key=repr)


def test_codes_without_rows_and_with_other_lengths(spark):
    assert compress_vectors(vector_frame(spark, [])).collect() == []
    assert compress_vectors(vector_frame(spark, [(1, None, 1)])).collect() == []
    got = {r.vec_id: r for r in compress_vectors(vector_frame(spark, [(1, [0.5] * 16, 1), (2, [0.5] * 8, 1), (3, [0.7] * 16, 1)])).collect()}
    assert (got[2].code, got[2].error, got[2].label_error) == (None, None, 0) and got[3].code == "01" * 16
    empty = compress_vectors(vector_frame(spark, [(1, [], 1), (2, [], 1)])).collect()
    assert [(r.code, r.error) for r in empty] == [("00" * 16, 0)] * 2


def test_slices_find_the_nearest_entry():
    rng = np.random.default_rng(1)
    for k, width, spread in [(64, 4, 100), (64, 4, 3), (1, 3, 9), (7, 1, 1000)]:
        book = rng.integers(-spread, spread, (k, width))
        x = np.r_[rng.integers(-3 * spread, 3 * spread, (500, width)), np.full((1, width), 10**7)]
        far = ((x[:, None] - book[None]) ** 2).sum(axis=2)
        entry, least = SliceIndex(book).nearest(x)
        assert (entry == far.argmin(axis=1)).all() and (least == far.min(axis=1)).all()


def test_registered_codes(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding", F.col("label")).collect()]
    assert codes_of(QUERIES["op13_vector_codes"](spark, SF)) == sorted(brute_codes(rows), key=repr)
