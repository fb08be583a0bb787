"""Exact top-k and approximate neighbours against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillscan.llm import ann, topk

SCHEMA = "vec_id long, embedding array<float>, score string, rank int"


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(6, 16))
    x = (centres[rng.integers(0, 6, 1500)] + 0.7 * rng.normal(size=(1500, 16))).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[700:760] = x[3]  # one vector many times: ties
    return x


@pytest.fixture(scope="module")
def table(spark, vectors):
    rows = [(k, v.tolist(), "clash", 1) for k, v in enumerate(vectors)]
    odd = [(5000, None, "", 1), (5050, [], "", 1), (5100, [float("nan")] * 16, "", 1), (None, vectors[0].tolist(), "", 1), (5150, [float("inf")] + [0.0] * 15, "", 1), (5200, [None] + [0.5] * 15, "", 1)]
    return spark.createDataFrame(rows + odd, SCHEMA).repartition(3).cache()


def test_exact_topk(spark, table, vectors):
    v = np.floor(256 * vectors.astype(np.float64)).astype(np.int64)
    got = {}
    for r in topk.topk_inner_product(table, 5, 50).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    for q in range(0, 1500, 50):
        s = v @ v[q]
        ids = [i for i in np.lexsort((np.arange(1500), -s)) if i != q][:5]
        assert sorted(got[q]) == [(j + 1, i, s[i]) for j, i in enumerate(ids)]
    assert len(got) == 30
    assert topk.topk_inner_product(spark.createDataFrame([], SCHEMA), 5, 50).count() == 0


def test_search_stops_only_on_proof(vectors):
    v = np.floor(256 * vectors.astype(np.float64)).astype(np.int64)
    index = topk.ImpactIndex(v)
    fewer = 0
    for q in range(0, 1500, 100):
        can = set(index.search(v[q], 5, np.asarray([q])).tolist())
        s = v @ v[q]
        s[q] = -(10**9)
        assert set(np.flatnonzero(s >= np.sort(s)[-5]).tolist()) <= can
        fewer += len(can) < 750
    assert fewer > 5


def test_nearest_neighbours(spark, table, vectors):
    x = vectors.astype(np.float64)
    got = {}
    for r in ann.nearest(table, 20, F.col("_id") % 20 == 0).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    hits = 0
    for q in range(0, 1500, 20):
        s = x @ x[q]
        rows = sorted(got[q])
        assert [r[0] for r in rows] == list(range(1, 21)) and all(r[2] == pytest.approx(s[r[1]], abs=1e-12) for r in rows)
        assert all((a[2], -a[1]) >= (b[2], -b[1]) for a, b in zip(rows, rows[1:])) and q not in [r[1] for r in rows]
        s[q] = -9
        hits += sum(s[r[1]] >= np.sort(s)[-20] - 1e-12 for r in rows)
    assert hits >= 0.9 * 20 * 75 and len(got) == 75
    assert ann.nearest(spark.createDataFrame([], SCHEMA), 20, F.col("_id") % 20 == 0).count() == 0


def test_lone_vectors_get_all_their_neighbours(spark):
    """Dense groups of copies need one leaf each; a vector alone in its leaf must go on to others."""
    x = np.concatenate([np.repeat(np.eye(16)[:3], 800, axis=0), np.eye(16)[3:5]])
    rows = [(k, v.tolist(), "", 1) for k, v in enumerate(x)]
    got = {}
    for r in ann.nearest(spark.createDataFrame(rows, SCHEMA), 20, (F.col("_id") % 20 == 0) | (F.col("_id") > 2399)).collect():
        got.setdefault(r.query_id, []).append(r["rank"])
    assert len(got) == 122 and all(sorted(ranks) == list(range(1, 21)) for ranks in got.values())
    few = [(k, v, "", 1) for k, v in [(0, x[0].tolist()), (0, x[900].tolist()), (1, x[1700].tolist())]]
    assert {r.vec_id for r in ann.nearest(spark.createDataFrame(few, SCHEMA), 20, F.col("_id") == 0).collect()} == {1}


def test_search_opens_few_postings_on_peaked_vectors():
    """Segments of high impact settle a query before most postings are multiplied."""
    rng = np.random.default_rng(8)
    v = np.floor(256 * rng.standard_t(1.5, size=(3000, 24))).astype(np.int64)
    index = topk.ImpactIndex(v)
    for q in range(0, 3000, 300):
        can = set(index.search(v[q], 5, np.asarray([q])).tolist())
        s = v @ v[q]
        s[q] = np.iinfo(np.int64).min
        assert set(np.flatnonzero(s >= np.sort(s)[-5]).tolist()) <= can
    assert 0 < index.opened < 0.85 * 10 * v.size


def recall_of(spark, x, every=20, k=20):
    rows = [(i, v.tolist(), "", 1) for i, v in enumerate(x)]
    got = {}
    for r in ann.nearest(spark.createDataFrame(rows, SCHEMA), k, F.col("_id") % every == 0).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    x = x.astype(np.float32).astype(np.float64)
    hits = asked = 0
    for q in range(0, len(x), every):
        s = np.add.reduce(x * x[q], axis=1)
        ids = [i for i in np.lexsort((np.arange(len(x)), -s)) if i != q][:k]
        rows = sorted(got[q])
        assert [r[0] for r in rows] == list(range(1, len(ids) + 1)) and all(r[2] == s[r[1]] for r in rows)
        hits, asked = hits + len(set(ids) & {r[1] for r in rows}), asked + len(ids)
    return hits / asked


def test_recall_with_heavy_tailed_norms_and_unvisited_leaves(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(6000, 16)) * rng.pareto(1.5, size=(6000, 1))
    assert recall_of(spark, x, every=100) >= 0.9


def test_vectors_of_several_lengths(spark):
    rng = np.random.default_rng(6)
    rows = [(i, rng.normal(size=8 if i % 3 else 5).tolist(), "", 1) for i in range(300)]
    got = {}
    for r in ann.nearest(spark.createDataFrame(rows, SCHEMA), 20, F.col("_id") % 20 == 0).collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert len(got) == 15 and all(len(v) == 20 and all((i % 3 == 0) == (q % 3 == 0) for i in v) for q, v in got.items())
