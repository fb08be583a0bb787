"""Embedding whitening against big-integer and fraction arithmetic."""

from fractions import Fraction

import numpy as np
import pytest

from quillscan.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, whitened string, n int"


def plain(vectors):
    """Exact sums, the covariance as fractions, deviations."""
    x = [[int(np.floor(1024 * float(c))) + 100_000 for c in v] for v in vectors]
    n, d = len(x), len(x[0])
    s = [sum(r[k] for r in x) for k in range(d)]
    z = [[n * r[k] - s[k] for k in range(d)] for r in x]
    cov = [[Fraction(sum(r[i] * r[j] for r in z), n**3) for j in range(d)] for i in range(d)]
    return np.asarray(z, dtype=object), s, cov, [sum(v * v for v in r) for r in z]


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(2)
    x = (rng.normal(size=(400, 12)) * np.linspace(3, 0.05, 12)).astype(np.float32)
    x[50:90] = x[3]
    return x


def result(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    models = whitening.fit(df)
    return models, whitening.whiten(df.drop("whitened"), models).collect()


def test_limbs_give_exact_products():
    rng = np.random.default_rng(1)
    for top in (3, 2**19, 2**33, 2**60):
        y = rng.integers(-top, top, (9000, 5))
        g = whitening.Gram(5)
        g.add(y)
        o = y.astype(object)
        assert (g.result() == o.T @ o).all()
        back = sum(np.asarray(c.astype(object)) << (36 * k) for k, c in enumerate(whitening.digits(g.result().ravel())))
        assert (back == g.result().ravel()).all()


def test_whitening(spark, vectors):
    odd = [None, [], [float("nan")] + [0.0] * 11, [None] + [0.0] * 11, [float("inf")] + [0.0] * 11]
    rows = [(k if k != 7 else None, v.tolist(), "clash", 1) for k, v in enumerate(vectors)] + [(900 + k, v, "", 1) for k, v in enumerate(odd)]
    models, got = result(spark, rows)
    assert len(got) == 400 and set(models) == {12}
    z, s, cov, dev = plain(vectors)
    assert models[12].sums == s and models[12].n == 400
    e, u = np.linalg.eigh(np.asarray(cov, dtype=np.float64))
    e, u = e[::-1][:8], u[:, ::-1][:, :8]
    by = {r.vec_id: r.whitened for r in got}
    want = (z / 400).astype(np.float64) @ u / np.sqrt(e)
    mine = np.asarray([by[k if k != 7 else None]["values"] for k in range(400)])
    sign = np.sign((mine * want).sum(axis=0))
    assert np.allclose(mine * sign, want, rtol=1e-7, atol=1e-9)
    assert [by[k if k != 7 else None].deviation for k in range(400)] == dev == [int(by[k if k != 7 else None].deviation_exact) for k in range(400)]
    assert np.allclose(by[0].explained, e / float(sum(cov[k][k] for k in range(12))), rtol=1e-9)
    assert by[0].identity_error == pytest.approx(np.abs(mine.T @ mine / 400 - np.eye(8)).max(), abs=1e-9) and by[0].identity_error < 1e-9


def test_odd_tables(spark):
    """No rows, equal rows, fewer rows than dimensions, huge entries, several lengths."""
    assert result(spark, [])[1] == [] and result(spark, [(1, None, "", 1)])[1] == []
    models, got = result(spark, [(k, [0.5, 0.25], "", 1) for k in range(5)])
    assert len(got) == 5 and all(r.whitened["values"] == [] and r.whitened.deviation == 0 for r in got)
    rng = np.random.default_rng(3)
    few = rng.normal(size=(3, 20)).astype(np.float32)
    models, got = result(spark, [(k, v.tolist(), "", 1) for k, v in enumerate(few)])
    assert all(len(r.whitened["values"]) == 2 for r in got) and models[20].identity_error < 1e-9
    huge = [(0, [3e38, 1.0], "", 1), (1, [-3e38, 2.0], "", 1), (2, [0.0, 0.0], "", 1), (3, [1e12, 0.0], "", 1)]
    models, got = result(spark, huge)
    assert len(got) == 4 and all(r.whitened.deviation_exact is None or r.whitened.deviation_exact >= 0 for r in got)
    mixed = [(k, rng.normal(size=3 + k % 2).tolist(), "", 1) for k in range(40)]
    models, got = result(spark, mixed)
    assert set(models) == {3, 4} and sorted(len(r.whitened["values"]) for r in got) == [3] * 20 + [4] * 20 and models[3].n == 20


def test_clash(spark):
    df = spark.createDataFrame([(1, [1.0], "", 1)], SCHEMA)
    with pytest.raises(ValueError):
        whitening.whiten(df, {})
