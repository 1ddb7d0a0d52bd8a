"""Pairs in tiles, and leave-one-out components, against numpy."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidegrid.operators import joins, multivar, pairwise


def long(x: np.ndarray, **more) -> pd.DataFrame:
    d = pd.DataFrame(x).melt(ignore_index=False, var_name="c", value_name="v").reset_index(names="i").dropna()
    return d.assign(**more)


@pytest.mark.parametrize("tile, block", [(3, 7), (4, 1000), (100, 16)])
def test_tiles(spark, tile, block):
    """More entities than a tile, levels far above the spread, gaps, constant series, groups of two samples."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=(40, 11)) + 1e7 * np.arange(11)
    x[rng.random(x.shape) < 0.2] = np.nan
    x[:, 4], x[:, 5] = 0.1, np.where(np.arange(40) < 20, 0.3, np.nan)
    few = x[:2, :5].copy()
    df = spark.createDataFrame(pd.concat([long(x, g="many", n=9), long(few, g="two", n=9)]))
    df = df.unionAll(df.limit(1).select("i", "c", F.lit(None).cast("double").alias("v"), "g", "n"))
    got = pairwise.pairwise_moments(df, ["g"], "c", "i", "v", block, tile).withColumn("r", pairwise.moments_corr()).toPandas()
    for g, m in (("many", x), ("two", few)):
        want, n = pd.DataFrame(m).corr(), pd.DataFrame(m).notna().astype(int).T @ pd.DataFrame(m).notna().astype(int)
        mine = got[got.g == g]
        assert len(mine) == sum(n.iloc[a, b] > 0 for a in range(m.shape[1]) for b in range(a + 1, m.shape[1]))
        for r in mine.itertuples():
            assert r.n == n.iloc[r.a, r.b] and r.a < r.b
            both = np.isfinite(m[:, r.a]) & np.isfinite(m[:, r.b])
            if np.ptp(m[both, r.a]) == 0 or np.ptp(m[both, r.b]) == 0:
                assert np.isnan(r.r)
            else:
                assert r.r == pytest.approx(want.iloc[r.a, r.b], abs=1e-7)


@pytest.mark.parametrize("block", [5, 1000])
def test_constant_where_shared(spark, block):
    """A series that varies, but not at the times that it shares with another, has no r with that one."""
    x = np.random.default_rng(5).normal(size=(60, 4))
    x[:30, 0], x[30:, 0] = 27.31, 1e4 * x[30:, 0]
    x[:15, 0] += 1e-14
    x[30:, 1] = np.nan
    got = pairwise.pairwise_moments(spark.createDataFrame(long(x, g=1)), ["g"], "c", "i", "v", block, 2).withColumn("r", pairwise.moments_corr()).collect()
    r = {(row["a"], row["b"]): row["r"] for row in got}
    assert r.pop((0, 1)) is None and len(r) == 5
    want = pd.DataFrame(x).corr()
    assert all(v == pytest.approx(want.iloc[a, b], abs=1e-9) for (a, b), v in r.items())


def test_diagonal_and_raw(spark):
    x = np.random.default_rng(3).normal(size=(30, 5))
    got = pairwise.pairwise_moments(spark.createDataFrame(long(x, g=1)), ["g"], "c", "i", "v", 8, 2, centre=False, diagonal=True).toPandas()
    assert len(got) == 15
    for r in got.itertuples():
        assert r.sxy == pytest.approx((x[:, r.a] * x[:, r.b]).sum())


def test_no_rows(spark):
    none = spark.createDataFrame([], "g int, c string, i int, v double")
    assert joins.pairs(none, ["g"], "c", "i", "v").count() == 0
    assert multivar.pc_influence(none, "c", "i", "v").count() == 0


def plain(x: np.ndarray) -> list[float]:
    """x: subjects by times."""
    def first(m):
        return np.linalg.svd(m - m.mean(axis=0), full_matrices=False)[2][0]
    whole = first(x)
    return [abs(whole @ first(np.delete(x, j, axis=0))) for j in range(len(x))]


@pytest.mark.parametrize("s, t", [(12, 5000), (30, 17), (3, 4)])
def test_leave_one_out(spark, s, t):
    rng = np.random.default_rng(s)
    x = rng.normal(size=(s, t)) + np.outer(rng.normal(size=s), rng.normal(size=t))
    x[0] *= 4  # a subject that the component depends on
    df = long(x.T)
    gone = df[(df.c == 1) & (df.i == 3)].index if t > 5 else []
    got = multivar.pc_influence(spark.createDataFrame(df.drop(gone).rename(columns={"c": "__set"})), "__set", "i", "v").toPandas().set_index("__set")
    kept = np.delete(x, 3, axis=1) if t > 5 else x
    want = plain(kept)
    assert got.similarity.reindex(range(s)).tolist() == pytest.approx(want, abs=1e-8)
    cut = np.mean(want) - 2 * np.std(want, ddof=1)
    assert got.influential.reindex(range(s)).tolist() == [c < cut for c in want]


def test_left_out_edges():
    assert np.isnan(multivar._left_out(np.zeros((4, 4)))).all() and np.isnan(multivar._left_out(np.eye(2))).all()
    # Two subjects carry the first component alone, two others the second.
    x = np.array([[3.0, 0], [-3, 0], [0, 1], [0, -1]])
    assert multivar._left_out(x @ x.T)[2:].tolist() == pytest.approx([1, 1])


@pytest.mark.parametrize("chunk, bytes_", [(3, 400), (256, 1 << 25)])
def test_turned_series(spark, monkeypatch, chunk, bytes_):
    """Against turned copies, with a constant series and several chunks and blocks."""
    from tidegrid.operators import stats

    monkeypatch.setattr(stats, "CHUNK", chunk)
    monkeypatch.setattr(stats, "SUM_BYTES", bytes_)
    rng = np.random.default_rng(11)
    d = pd.DataFrame([(f"s{e}", t, *rng.normal(size=2)) for e in range(8) for t in range(17)], columns=["who", "t", "x", "y"])
    df = spark.createDataFrame(d)
    got = stats.isc_null(df, "who", "t", ["x", "y"], 6, 3)
    turned = df.withColumn("perm", F.explode(F.sequence(F.lit(1), F.lit(6))))
    turned = turned.withColumn("t", F.pmod(F.col("t") - stats.shift_of(F.col("who"), F.col("perm"), F.lit(17), 3), F.lit(17)))
    want = {(r.perm, r.who): (r.n_times, r.isc) for r in stats.isc(turned, "who", "t", ["x", "y"], ["perm"]).collect()}
    rows = got.collect()
    assert len(rows) == len(want) == 48
    for r in rows:
        assert (r.n_times, r.isc) == pytest.approx(want[r.perm, r.who])
    flat = df.withColumn("x", F.when(F.col("who") == "s1", 1.0).otherwise(F.col("x")))
    assert {r.who for r in stats.isc_null(flat, "who", "t", ["x", "y"], 2, 3).where("isc is null").collect()} == {"s1"}
    assert stats.isc_null(df.where("false"), "who", "t", ["x"], 2, 3).count() == 0
