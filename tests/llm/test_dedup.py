"""Copies, near copies, passages and lines against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from framelark.llm.exact_dedup import drop_copies, exact_dedup
from framelark.llm.graph import connected_components
from framelark.llm.line_dedup import line_dedup
from framelark.llm.ngram_join import SetTrie, ngram_jaccard
from framelark.llm.suffix_dedup import merge_runs, suffix_dedup
from tests.llm.helpers import (
    brute_jaccard,
    brute_lines,
    brute_suffix,
    collected,
    components,
    document_frame,
    odd_documents,
    prose,
)


def test_exact_dedup(spark):
    rows = odd_documents()
    got = {}
    for r in exact_dedup(document_frame(spark, rows)).collect():
        got.setdefault((r.doc_id, r.text_sha256), []).append(r)
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    assert sum(map(len, got.values())) == len(rows)
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep = max(known) if known else None
        for rs in got.values():
            for r in rs:
                if r.keep_id == keep and r.doc_id in ids and r.group_size == len(ids):
                    assert r.kept == (r.doc_id == keep)
    copies = drop_copies(document_frame(spark, rows))
    assert len(copies.columns) == 10
    left = [(r.doc_id, r.text or "") for r in copies.collect()]
    assert {t for _, t in left} == set(groups)
    want = set()
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        want.add((max(known) if known else None, text))
    assert set(left) == want


def test_drop_copies_tells_rows_by_text(spark):
    rows = [(1, "a"), (2, "a"), (1, "b"), (None, "a"), (None, "c"), (None, None), (3, "")]
    got = collected(drop_copies(document_frame(spark, rows)).select("doc_id", "text"))
    assert got == sorted([(2, "a"), (1, "b"), (None, "c"), (3, "")], key=repr)


@pytest.mark.parametrize("block", [4_000, 16 << 20])
def test_suffix_dedup(spark, block):
    rows = odd_documents()
    got = suffix_dedup(document_frame(spark, rows), block_bytes=block)
    assert collected(got.drop("kept")) == brute_suffix(rows, 50)


def test_suffix_dedup_carries_columns_and_text(spark):
    rows = [(1, "é" * 60), (2, "x" + "é" * 60 + "y"), (3, "plain")]
    df = document_frame(spark, rows)
    got = {r.doc_id: r for r in suffix_dedup(df, carry=["block", "data"], as_text=True).collect()}
    assert got[2].kept == "xy" and got[3].kept == "plain" and got[2].carried.data == "d"


def test_merge_runs_gives_order_and_prefixes():
    rnd = random.Random(3)
    texts = [bytes(rnd.choice(b"ab") for _ in range(12)) for _ in range(500)]
    runs = []
    for k in range(7):
        part = sorted(texts[k::7])
        lcp = [0] + [next((j for j in range(12) if a[j] != b[j]), 12) for a, b in zip(part, part[1:])]
        runs.append((part, lcp))
    runs.append(([], []))
    codes, shares = merge_runs(runs, 12)
    order = [runs[c >> 32][0][c & 0xFFFFFFFF] for c in codes]
    assert order == sorted(texts)
    assert shares[1:] == [next((j for j in range(12) if a[j] != b[j]), 12) for a, b in zip(order, order[1:])]


@pytest.mark.parametrize("words,upper,group", [(3, 90, 32 << 20), (5, 80, 32 << 20), (2, 60, 2_000)])
def test_ngram_jaccard(spark, words, upper, group):
    rows = odd_documents()
    got = ngram_jaccard(document_frame(spark, rows), words=words, threshold=(upper, 100), block_bytes=4_000, group_bytes=group)
    assert collected(got) == brute_jaccard(rows, words, upper, 100)


def test_ngram_jaccard_chain_of_near_copies(spark):
    rnd = random.Random(9)
    text, rows = prose(rnd, 80).split(" "), []
    for i in range(40):
        text = list(text)
        text[rnd.randrange(80)] = f"new{i}"
        rows.append((i, " ".join(text)))
    assert collected(ngram_jaccard(document_frame(spark, rows), threshold=(80, 100))) == brute_jaccard(rows, 3, 80, 100)


def test_trie_links_what_brute_force_links():
    rnd = random.Random(4)
    sets = []
    for _ in range(120):
        base = sets[rnd.randrange(len(sets))] if sets and rnd.random() < 0.6 else {rnd.randrange(300) for _ in range(40)}
        sets.append({x for x in base if rnd.random() > 0.05} | {rnd.randrange(300) for _ in range(rnd.randrange(3))})
    trie = SetTrie(80, 100)
    order = sorted(range(120), key=lambda i: len(sets[i]))
    for i in order:
        trie.add(sorted(sets[i]), len(sets[i]))
    got = {}
    for at, i in enumerate(order):
        got.setdefault(trie.find(at), set()).add(i)
    want = {}
    for i, c in components(range(120), lambda a, b: 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])).items():
        want.setdefault(c, set()).add(i)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


@pytest.mark.parametrize("least", [1, 2, 3, 5])
def test_line_dedup(spark, least):
    rows = [r for r in odd_documents() if r[0] != 1]
    rnd = random.Random(2)
    rows += [(500 + i, "\n".join(rnd.choice("abcd") for _ in range(rnd.randint(1, 30)))) for i in range(25)]
    assert collected(line_dedup(document_frame(spark, rows), min_lines=least).drop("kept")) == brute_lines(rows, least)


@pytest.mark.parametrize("least", [1, 2, 3])
def test_line_dedup_of_long_lines_and_whole_copies(spark, least):
    rows = [r for r in odd_documents() if r[0] != 1]
    passage = prose(random.Random(7), 60)
    rows += [(600, f"head\n{passage}\ntail"), (601, f"{passage}\nother"), (602, f"a1\n{passage}\n{passage}\na2")]
    rows += [(603, "short"), (604, "short"), (605, "short\nx1"), (606, "x2\nshort"), (None, "short"), (607, "é" * 25), (608, "é" * 25 + "\nz")]
    got = line_dedup(document_frame(spark, rows), min_lines=least, long_bytes=50, whole_copies=True)
    assert collected(got.drop("kept")) == brute_lines(rows, least, 50, True)
    if least == 2:
        kept = {r.doc_id: r.kept for r in got.collect()}
        assert [kept[i] for i in (601, 602, 603, 604, 606, 608)] == ["other", "a1\na2", "short", "", "x2\nshort", "z"]


@pytest.mark.parametrize("least", [1, 2, 3])
def test_line_runs_are_common_prefixes(spark, least):
    """Runs of 3 to 21 lines inside other lines, two that meet, and lines that repeat themselves."""
    rnd = random.Random(11)
    runs = [[f"r{k}l{j}" for j in range(n)] for k, n in enumerate((3, 5, 8, 13, 21))]
    rows = [(i, "\n".join(x for run in rnd.sample(runs, 3) for x in [f"u{i}{run[0]}", *run])) for i in range(12)]
    rows += [(20, "p\nA\nB\nq"), (21, "s\nB\nC\nt"), (22, "x\nA\nB\nC\ny"), (23, "a\n" * 9), (24, "z\n" + "b\nc\n" * 7)]
    rows += [(25, "b\nc\n" * 9 + "d"), (25, "a\n" * 12 + "d"), (None, "a\na\na")]
    got = line_dedup(document_frame(spark, rows), min_lines=least)
    assert collected(got.drop("kept")) == brute_lines(rows, least)
    if least == 2:  # AB and BC are two runs: ABC stands nowhere else
        assert [(r.n_removed, r.n_spans, r.longest) for r in got.collect() if r.doc_id == 22] == [(3, 2, 2)]


@pytest.mark.parametrize("separator", ["|", ".", "\\n", "ab", "\\"])
def test_line_separator_is_literal(spark, separator):
    rows = [(1, "aa\nbb\ncc"), (2, "aa\nbb\ndd"), (3, "x|y.z\naa\nbb"), (4, "aa"), (5, "")]
    other = [(i, t.replace("\n", separator)) for i, t in rows]
    got = line_dedup(document_frame(spark, other), separator=separator).select("doc_id", "n_lines", "n_removed", "kept").collect()
    if separator not in ("|", ".", "ab"):  # these stand inside the lines too
        assert sorted((r.doc_id, r.n_lines, r.n_removed) for r in got) == [(1, 3, 0), (2, 3, 2), (3, 3, 2), (4, 1, 0), (5, 1, 0)]
    assert {r.doc_id: r.kept for r in got}[2] == "dd"


def test_query_of_lines_leaves_no_later_copy_of_a_passage(spark, tmp_path):
    from framelark.llm.queries import QUERIES

    passage = prose(random.Random(8), 60)
    rows = [(1, f"a\n{passage}"), (2, f"b\n{passage}\nc"), (3, "one line"), (4, "one line")]
    document_frame(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    got = QUERIES["op4_line_dedup"](spark, str(tmp_path))
    assert {r.doc_id: r.n_removed for r in got.collect()} == {1: 0, 2: 1, 3: 0, 4: 1}


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(50)] + [(7, 7), (None, 3)]
    got = dict(map(tuple, connected_components(spark.createDataFrame(edges, "a bigint, b bigint").repartition(9)).collect()))
    assert all(got[i] == 0 for i in range(61)) and all(got[1000 + i] == 1000 for i in range(50))


def test_empty_tables(spark):
    none = document_frame(spark, [])
    for df in (exact_dedup(none), suffix_dedup(none), ngram_jaccard(none), line_dedup(none)):
        assert df.count() == 0
    blank = document_frame(spark, [(1, None), (2, "")])
    assert collected(suffix_dedup(blank).select("doc_id", "n_removed")) == [(1, 0), (2, 0)]
    assert collected(ngram_jaccard(blank)) == [(1, 0, 1), (2, 0, 2)]
    assert line_dedup(blank).agg(F.sum("n_removed")).first()[0] == 0
