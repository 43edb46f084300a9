"""Embedding near-dedup, the quality classifier, and the pipeline."""

import numpy as np
import pytest

import corpus_pipeline
from framelark.llm.lattice_dedup import lattice_near_dedup, nearest_e8, shortest_vectors
from framelark.llm.packing import pack_documents
from framelark.llm.quality import classify_quality, isotonic
from framelark.llm.queries import vocabulary_path
from tests.conftest import SF
from tests.llm.helpers import brute_jaccard, brute_suffix, collected, components, document_frame, odd_documents


def test_nearest_e8_is_nearest():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 8)) * 2
    home = nearest_e8(x)
    assert (np.abs(home * 2 - np.rint(home * 2)) == 0).all() and (home.sum(axis=1) % 2 == 0).all()
    around = shortest_vectors()
    assert len(around) == 240 and np.allclose((around**2).sum(axis=1), 2)
    d = ((x - home) ** 2).sum(axis=1)
    others = ((x[:, None] - home[:, None] - around) ** 2).sum(axis=2).min(axis=1)
    assert (d <= others + 1e-12).all()


def vectors(seed=3, groups=25, dim=16):
    rng = np.random.default_rng(seed)
    rows, k = [], 0
    for g in range(groups):
        centre = rng.normal(size=dim)
        for _ in range(int(rng.integers(1, 9))):
            v = centre + rng.normal(size=dim) * rng.choice([0.0, 0.1, 0.3])
            rows.append((k, [float(np.float32(x)) for x in v], g % 3))
            k += 1
    zero, nan = [0.0] * dim, [float("nan")] * dim
    rows += [(900, None, 1), (901, zero, 1), (902, nan, 1), (903, [float("inf")] * dim, 1), (904, [None] * dim, 1), (905, [], 1)]
    rows += [(906, rows[0][1], None), (907, rows[0][1], 2), (908, rows[0][1], 0), (None, rows[0][1], 0), (909, [1.0, 2.0], 0), (910, [2.0, 4.0], 0)]
    return rows


@pytest.mark.parametrize("unit", [3, 2048])
def test_lattice_near_dedup(spark, unit):
    rows = vectors()
    frame = spark.createDataFrame([(*r, 1, 2, "x") for r in rows], "vec_id bigint, embedding array<float>, label int, cell int, rep int, key string")
    got = {r.vec_id: r for r in lattice_near_dedup(frame, unit_rows=unit, tables=12, probes=8).collect() if r.vec_id is not None}
    unit_of = {}
    for i, v, label in rows:
        if i is not None and label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            a = np.array(v, np.float32).astype(float)
            unit_of[i] = (label, a / np.sqrt(a @ a))

    def linked(a, b):
        (la, x), (lb, y) = unit_of[a], unit_of[b]
        return la == lb and len(x) == len(y) and x @ y >= 0.93

    want = components(list(unit_of), linked)
    links = {a: sum(a != b and linked(a, b) for b in unit_of) for a in unit_of}
    # Cells of so many tables find all pairs of this fixture, so the result is exact.
    for i, v, label in rows:
        if i is not None:
            assert (got[i].n_links, got[i].component_id) == (links.get(i, 0), want.get(i, i)), i
            assert got[i].kept == (got[i].component_id == i)
    assert lattice_near_dedup(frame.limit(0)).count() == 0


def test_isotonic():
    x, y = isotonic(np.arange(6.0), np.array([0, 1, 0.5, 0.2, 0.9, 1]), np.ones(6))
    assert (np.diff(y) >= 0).all() and np.isclose(y[1], (1 + 0.5 + 0.2) / 3)


def test_quality_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    got = classify_quality(docs, labels).join(labels, "doc_id").filter("held_out").select("score", "predicted", "quality").collect()
    score, predicted, y = (np.array(x, float) for x in zip(*got))
    ranks = np.empty(len(y))
    ranks[np.argsort(score, kind="stable")] = np.arange(len(y))
    auc = (ranks[y == 1].sum() - (y == 1).sum() * ((y == 1).sum() - 1) / 2) / ((y == 1).sum() * (y == 0).sum())
    assert auc > 0.9 and (predicted == y).mean() > 0.93 and (score >= 0).all() and (score <= 1).all()


def test_quality_edge_cases(spark):
    docs = document_frame(spark, odd_documents())
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, None), (None, 1), (3, 0), (4, 1)], "doc_id bigint, quality int")
    for some in (labels, labels.limit(0), labels.filter("quality = 1")):
        rows = classify_quality(docs, some).collect()
        assert len(rows) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    assert classify_quality(docs.limit(0), labels).count() == 0


def test_pipeline_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    scored = classify_quality(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    good = {r.doc_id for r in scored.collect() if r.predicted == 1}
    kept = corpus_pipeline.quality(spark, docs, SF)
    assert kept.columns == columns and {r.doc_id for r in kept.collect()} == good
    rows = [(r.doc_id, r.text) for r in kept.collect()]
    last = {}
    for i, t in rows:
        last[t or ""] = max(last.get(t or "", i), i)
    single = corpus_pipeline.exact(spark, kept, SF)
    assert single.columns == columns and {r.doc_id for r in single.collect()} == set(last.values())
    rows = [(r.doc_id, r.text) for r in single.collect()]
    near = corpus_pipeline.near(spark, single, SF)
    assert near.columns == columns
    assert {r.doc_id for r in near.collect()} == {i for i, _, c in brute_jaccard(rows, 5, 80, 100) if i == c}
    rows = [(r.doc_id, r.text) for r in near.collect()]
    cut = corpus_pipeline.passages(spark, near, SF)
    assert cut.columns == columns and dict(cut.dtypes) == dict(docs.dtypes)
    after = {r.doc_id: r for r in cut.collect()}
    for i, n, removed, _, _ in brute_suffix(rows, 50):
        assert (i in after) == (removed < n or n == 0)
        if removed == 0:
            assert after[i].text == dict(rows)[i]
        elif i in after:
            assert n - removed - 6 * 20 <= len(after[i].text.encode()) <= n - removed
    assert collected(corpus_pipeline.packing(spark, cut, SF).drop("sequence_id", "offset")) == collected(
        pack_documents(cut, vocabulary_path()).drop("sequence_id", "offset")
    )
    assert corpus_pipeline.run(spark, SF).count() == corpus_pipeline.packing(spark, cut, SF).count()


def test_pipeline_keeps_odd_rows_defined(spark):
    docs = spark.createDataFrame(
        [(i, t, "en", "s", len(t or "")) for i, t in odd_documents()], "doc_id bigint, text string, lang string, source string, n_chars bigint"
    )
    for _, stage in corpus_pipeline.STAGES[1:4]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and 0 < out.count() <= docs.count()
        assert stage(spark, docs.limit(0), SF).count() == 0


def test_lattice_tells_vectors_of_one_id_apart(spark):
    close = [[1.0, 0.01 * k, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0] for k in range(3)]
    rows = [(1, close[0], 5), (1, close[1], 5), (2, close[2], 5), (9, [0.0, 1.0] + [0.0] * 6, 5), (1, [0.0, 0.0, 1.0] + [0.0] * 5, 5)]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int")
    got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in lattice_near_dedup(frame).collect())
    assert got == [(1, 0, 1, True), (1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False), (9, 0, 9, True)]


def test_lattice_recall_with_registered_parameters(spark, tmp_path):
    """The given vectors, each with a copy at a cosine between 0.9 and 1."""
    from framelark.llm.queries import QUERIES
    from tests.conftest import SF

    rows = spark.read.parquet(f"{SF}/embeddings.parquet").filter("label IS NOT NULL").limit(300).collect()
    v = np.array([r.embedding for r in rows], float)
    v /= np.sqrt((v * v).sum(axis=1, keepdims=True))
    rng = np.random.default_rng(3)
    noise = rng.normal(size=v.shape)
    noise /= np.sqrt((noise * noise).sum(axis=1, keepdims=True))
    v = np.float32(np.r_[v, v + noise * rng.uniform(0, 0.48, (len(v), 1))])
    label = np.array([r.label for r in rows] * 2)
    data = [(i, x, int(k)) for i, (x, k) in enumerate(zip(v.tolist(), label))]
    spark.createDataFrame(data, "vec_id bigint, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    u = v.astype(float)
    u /= np.sqrt((u * u).sum(axis=1, keepdims=True))
    true = ((u @ u.T >= 0.93) & (label[:, None] == label[None])).sum(axis=1) - 1
    found = {r.vec_id: r.n_links for r in QUERIES["op8_lattice_near_dedup"](spark, str(tmp_path)).collect()}
    got = np.array([found[i] for i in range(len(v))])
    assert (got <= true).all() and true.sum() > 200 and got.sum() >= 0.9 * true.sum()
