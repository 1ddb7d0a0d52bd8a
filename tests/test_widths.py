"""Operators on many columns, against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegrid.operators import multivar, states, stats

P = 40


@pytest.fixture(scope="module")
def wide(spark):
    rng = np.random.default_rng(11)
    low = rng.normal(size=(300, 3)) @ rng.normal(size=(3, P))
    sparse = np.where(rng.random((300, P)) < 0.05, rng.normal(scale=8, size=(300, P)), 0)
    x = low + sparse
    rows = [(i, i % 30, *map(float, r)) for i, r in enumerate(x)]
    cols = [f"f{k}" for k in range(P)]
    return spark.createDataFrame(rows, "id long, time long, " + ", ".join(f"{c} double" for c in cols)), cols, x, low


def test_mahalanobis(wide):
    df, cols, x, _ = wide
    res = x - np.array([x[t::30].mean(axis=0) for t in range(30)])[np.arange(300) % 30]
    n, p = res.shape
    c = res - res.mean(axis=0)
    cov = c.T @ c / n
    mu = np.trace(cov) / p
    d2 = (cov**2).sum() / p - mu**2
    b2 = (((c**2).sum(axis=1) ** 2).sum() / n - (cov**2).sum()) / (p * n)
    w = min(max(b2, 0), d2) / d2
    want = np.sqrt(np.einsum("ij,jk,ik->i", res, np.linalg.inv((1 - w) * cov + w * mu * np.eye(p)), res))
    holed = df.withColumn("f3", F.when(F.col("id") != 7, F.col("f3")))
    got = dict(states.mahalanobis(df, ["time"], cols).select("id", "deviation").collect())
    assert np.allclose([got[i] for i in range(n)], want)
    assert states.mahalanobis(holed, ["time"], cols).where("id = 7").first()["deviation"] is None


def test_correlations_pairwise_complete(wide):
    df, cols, x, _ = wide
    df = df.withColumns({"f1": F.when(F.col("id") % 4 != 0, F.col("f1")), "f5": F.lit(2.0)})
    got = {(r["feature_a"], r["feature_b"]): r["r"] for r in stats.corr_matrix(df, cols).collect()}
    keep = np.arange(300) % 4 != 0
    assert np.isclose(got["f1", "f2"], np.corrcoef(x[keep, 1], x[keep, 2])[0, 1]) and np.isclose(got["f2", "f9"], np.corrcoef(x[:, 2], x[:, 9])[0, 1])
    assert got["f2", "f5"] is None and len(got) == P * (P - 1) // 2


def test_components(wide):
    df, cols, x, _ = wide
    got = multivar.pca(df, cols, 3)[0].orderBy("id").select("PC1", "PC2", "PC3").collect()
    _, v = multivar.components(np.cov(x.T, bias=True), 3)
    assert np.allclose(np.array(got), (x - x.mean(axis=0)) @ v)


def test_split_without_convergence_is_an_error(wide):
    df, cols, _, _ = wide
    with pytest.raises(RuntimeError):
        multivar.robust_pca(df, "id", cols, iters=1)


def test_split_writes_few_states(wide, monkeypatch):
    df, cols, _, _ = wide
    written, settle = [], multivar.settle
    monkeypatch.setattr(multivar, "settle", lambda d, name: written.append(name) or settle(d, name))
    with pytest.raises(RuntimeError):
        multivar.robust_pca(df, "id", cols, iters=20, tol=0)
    assert len(written) == 1 + 19 // multivar.REPLAY


def test_split_that_plain_rounds_do_not_reach(spark, monkeypatch):
    """Plain rounds take 218 to this tol; combined states reach the same split in 100."""
    rng = np.random.default_rng(10)
    m = np.outer(rng.normal(size=60), rng.normal(size=5))
    m[rng.integers(0, 60, 12), rng.integers(0, 5, 12)] += 6.0
    cols = [f"c{j}" for j in range(5)]
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(m)], "id long, " + ", ".join(f"{c} double" for c in cols))
    monkeypatch.setattr(multivar, "PLAIN", 40, raising=False)
    monkeypatch.setattr(multivar, "BLOCK", 64, raising=False)
    got = multivar.robust_pca(df, "id", cols, iters=100, tol=1e-9).toPandas().sort_values("id")
    mu, lam = m.size / (4 * np.abs(m).sum()), 1 / np.sqrt(60)
    t = np.zeros_like(m)
    for _ in range(300):
        y = np.clip(t, -lam / mu, lam / mu)
        u, w, v = np.linalg.svd(m - t + 2 * y, full_matrices=False)
        low = u @ np.diag(np.maximum(w - 1 / mu, 0)) @ v
        t = m - low + y
    np.testing.assert_allclose(got[[f"{c}_low" for c in cols]].to_numpy(), low, atol=1e-5)
    np.testing.assert_allclose(got[[f"{c}_sparse" for c in cols]].to_numpy(), m - low, atol=1e-5)


def test_inflation_and_loadings(wide):
    df, cols, x, _ = wide
    got = dict(multivar.vif(df, cols).collect())
    for k in (0, 7, P - 1):
        others = np.delete(x, k, axis=1)
        left = x[:, k] - others @ np.linalg.lstsq(others, x[:, k], rcond=None)[0]
        assert got[cols[k]] == pytest.approx((x[:, k] ** 2).sum() / (left**2).sum())
    load = multivar.loadings_table(df, cols, 3).toPandas()
    _, s, v = np.linalg.svd(x - x.mean(axis=0), full_matrices=False)
    for j in range(3):
        mine = load[load.component == f"PC{j + 1}"]
        assert abs(mine.loading.to_numpy() @ v[j]) == pytest.approx(1) and mine.explained.iloc[0] == pytest.approx(s[j] ** 2 / (s**2).sum())
        assert mine.loading.iloc[np.abs(mine.loading).argmax()] > 0
