"""Values, guards and numerics checked against literals or numpy."""

import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidegrid.functions import ids, scalars, special
from tidegrid.operators import aggs, events, group, joins, multivar, quality, reshape, series, spectral, states, stats, windows
from tidegrid.sources import tables, textfiles, wide


def one(spark, col):
    return spark.range(1).select(col.alias("x")).first()[0]


def test_tail_probabilities():
    # Tabulated: t(10) = 2.228 and t(3) = 3.182 at 5 %, F(3, 20) = 3.098, chi2(4) = 9.488.
    assert special.t_tail(2.228, 10) == pytest.approx(0.05, abs=2e-5)
    assert special.t_tail(3.182, 3) == pytest.approx(0.05, abs=2e-5)
    assert special.f_tail(3.098, 3, 20) == pytest.approx(0.05, abs=2e-4)
    assert special.chi2_tail(9.488, 4) == pytest.approx(0.05, abs=2e-5)
    # One degree of freedom has a closed form.
    assert special.t_tail(1.0, 1) == pytest.approx(0.5, abs=1e-12)
    assert special.chi2_tail(2.0, 2) == pytest.approx(np.exp(-1), abs=1e-12)


def test_p_columns(spark):
    d = spark.createDataFrame([(2.228, 10), (None, 5)], "t double, dof int")
    got = [r.p for r in stats.with_t_p(d, F.col("dof")).collect()]
    assert got[0] == pytest.approx(0.05, abs=2e-5) and got[1] is None


def test_identity(spark):
    names = spark.createDataFrame([("ns127_02_ses-3_run-7",), ("LH010",), ("NS178_run_12",)], "e string")
    got = names.select(
        ids.patient_id(F.col("e")), ids.run_label(F.col("e")), ids.session_label(F.col("e"), ids.patient_id(F.col("e"))), ids.parse_entry(F.col("e"))).collect()
    assert [tuple(r)[:3] for r in got] == [("NS127_02", "run-07", "ses-03"), ("LH010", "run-01", "ses-01"), ("NS178", "run-12", "ses-01")]
    assert tuple(got[0][3]) == ("ns127_02", "ses-3", "run-7")
    with pytest.raises(Exception, match="no patient"):
        spark.range(1).select(ids.patient_id(F.lit("X1"))).collect()


def test_recording_names(spark):
    d = spark.createDataFrame([
        ("sub-LH012_ses-01_task-despicable_me_hungarian_run-01_ieeg_preprocessed.fif",), ("sub-NS144_ses-implant02_task-DespMeEng_ieeg_prep_ref_avg.fif",), ("sub-X_task-rest_ieeg.fif",)], "n string")
    got = [tuple(r[0]) for r in d.select(ids.recording_name(F.col("n"))).collect()]
    assert got == [("01", "despicable_me_hungarian", "01"), ("implant02", "despicable_me_english", "01"), ("", None, "01")]


def test_bands_and_log(spark):
    assert one(spark, scalars.assign_band(F.lit(3.5))) == "theta"
    assert one(spark, scalars.assign_band(F.lit(3.5), scalars.BANDS_CANONICAL)) is None
    assert one(spark, scalars.log_power(F.lit(0.0))) == pytest.approx(-307.65, abs=0.01)
    assert one(spark, scalars.mmss(F.lit(125.9))) == "02:05"
    assert one(spark, scalars.knee_freq(F.lit(-1.0), F.lit(2.0))) is None


def test_stim_log(spark):
    lines = ["39.0600     EXP     visual_standard: autoDraw = True", "39.1103     EXP     Sound audio_deviant started",
             "40.0 EXP visual_standard: autoDraw = False", "41.0 EXP Sound audio_standard reached end of file", "text"]
    got = textfiles.parse_stim_log(spark.createDataFrame([(x,) for x in lines], "value string")).collect()
    assert [(r.time_s, r.modality, r.condition) for r in got] == [(39.06, "visual", "standard"), (39.1103, "auditory", "deviant")]


def test_bad_channel_list(spark, tmp_path):
    (tmp_path / "a_bad_channels.txt").write_text("# list\nLTG1\n\n RAH2 \n")
    assert [r.label for r in textfiles.read_bad_channels(spark, str(tmp_path)).collect()] == ["LTG1", "RAH2"]


def test_wide_round_trip(spark, tmp_path):
    long = spark.createDataFrame([("p", w, c, w + len(c) / 10) for w in range(12) for c in ("LA1", "LA22", "RB1")], "SubID string, w int, label string, v double")
    meta = spark.createDataFrame([("p", "LA1", "x", "DMN"), ("p", "LA22", "y", None), ("p", "RB1", "z", "VN")], "SubID string, label string, DK_Atlas string, network string")
    order = ["RB1", "LA22", "LA1"]
    w = wide.to_wide(long, meta, "SubID", "w", "label", "v", order, ["DK_Atlas", "network"])
    assert w.columns[-3:] == order
    wide.write_wide(w, str(tmp_path / "w"))
    m, back = wide.read_wide(spark, str(tmp_path / "w"))
    assert {(r.atlas, r.label): r.region for r in m.collect()}[("DK_Atlas_Region", "LA22")] == "y"
    assert sorted(map(tuple, back.collect())) == sorted(("p", c, x, v) for _, x, c, v in long.collect())
    with pytest.raises(ValueError, match="missing"):
        wide.to_wide(long, meta, "SubID", "w", "label", "v", order + ["ZZ1"], ["network"])


def test_wide_without_index(spark, tmp_path):
    text = "SubID,Atlas,LA1\np,DK_Atlas_Region,x\np,network,y\n" + "".join(f"p,,{i}.5\n" for i in range(50)) + "p,,bad\n"
    (tmp_path / "t.csv").write_text(text)
    m, back = wide.read_wide(spark, str(tmp_path / "t.csv"))
    got = {r.window_idx: r.value for r in back.collect()}
    assert m.count() == 2 and got[0] == 0.5 and got[49] == 49.5 and got[50] is None


def test_write_once_and_coverage(spark, tmp_path):
    d, path = spark.range(3), str(tmp_path / "t")
    assert tables.write_once(d, path) and not tables.write_once(spark.range(9), path)
    assert spark.read.parquet(path).count() == 3 and tables.write_once(spark.range(9), path, overwrite=True)
    cov = spark.createDataFrame([("a", ""), ("b", "yes")], "k string, include string")
    at = str(tmp_path / "c")
    assert tables.write_coverage(cov.filter("k = 'a'"), at) == at
    assert tables.write_coverage(cov, at) == at
    assert tables.write_coverage(cov, at) == at + "_rescan" and os.path.exists(at + "_rescan")


def test_signal_store(spark, tmp_path):
    d = spark.range(100).select(F.lit("r1").alias("recording"), F.lit("c").alias("channel"), F.col("id").alias("sample_idx"), F.col("id").cast("float").alias("value"))
    path = str(tmp_path / "s")
    tables.write_signal(d, path, {"fs": "600"}, ["recording"], ["channel", "sample_idx"])
    assert tables.read_signal(spark, path).count() == 100 and tables.read_provenance(spark, path).first()["fs"] == "600"


def test_guards(spark):
    d = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "k string, v int")
    with pytest.raises(ValueError, match="duplicated"):
        joins.merge_labels(spark.createDataFrame([("a",)], "k string"), d, ["k"])
    with pytest.raises(ValueError, match="absent from metadata.*'b'"):
        joins.attach_meta(d, spark.createDataFrame([("a", "x")], "k string, r string"), ["k"])
    with pytest.raises(ValueError, match="duplicated"):
        reshape.remap_ids(d, spark.createDataFrame([("a", "x"), ("a", "y")], "o string, n string"), "k", "o", "n")
    with pytest.raises(ValueError, match="several columns"):
        tables.standardise(spark.createDataFrame([(1, 2)], "DK int, dk_ int"), {"dk": ["dk_"]})
    with pytest.raises(ValueError, match="output rate"):
        spectral.check_rate([100.0], [4.0], 20.0)
    flat = spark.createDataFrame([("c", i, float(i), 1.0) for i in range(4)], "ch string, i int, v double, n double")
    with pytest.raises(Exception, match="noise channel is flat"):
        series.regress_out(flat.drop("n"), flat.select("i", F.col("n").alias("noise")), [], "ch", "i", "v", "o").collect()
    with pytest.raises(ValueError, match="columns differ"):
        tables.check_schema(d, "qc_1s")


def test_best_source(spark):
    d = spark.createDataFrame([("a", "x_run-1_ses-2.csv"), ("a", "x_run-02_ses-02.csv"), ("b", "p_run-01.csv"), ("b", "q_run-01.csv")], "k string, f string")
    s = joins.source_score(F.col("f"), F.lit("run-01"), F.lit("ses-02"), F.lit("film"))
    got = {r.k: (r.score, r.f) for r in joins.pick_best(d, ["k"], s, "f").collect()}
    assert got == {"a": (6, "x_run-1_ses-2.csv"), "b": (4, None)}


def test_response_literals(spark):
    t = spark.createDataFrame([("s", 0.0, 1), ("s", 1.0, 2)], "k string, t double, id long")
    b = spark.createDataFrame([("s", 1.2, 1), ("s", 1.3, 2)], "k string, t double, id long")
    got = {r.id: r.response_t for r in joins.match_responses(t, b, ["k"], "t", "id", 1.5).collect()}
    assert got == {1: 1.2, 2: 1.3}
    assert [r.first_t for r in joins.response_table(t, b, ["k"], "t", "id", 1.5).collect()] == [1.2, 1.2]


def test_drift_literals(spark):
    def split(cfs, compat=False):
        d = spark.createDataFrame([("a", 0, i, f) for i, f in enumerate(cfs)], "k string, run_id long, i long, f double")
        return sorted((r.i, r.event_id) for r in events.split_on_drift(d, ["k", "run_id"], "i", "f", 2.0, compat).collect())

    # The running median holds the value itself: at 14 it is 10.5.
    assert split([10.0, 10.5, 14.0, 14.2]) == [(0, 0), (1, 0), (2, 2), (3, 2)]
    assert split([10.0, 10.0, 15.0]) == [(0, 0), (1, 0), (2, 2)]
    assert split([10.0, 10.0, 15.0], compat=True) == [(0, 0), (1, 0)]


def test_to_events_brackets(spark):
    cf = [None, 10.0, 10.5, None, 10.2, None, None, 11.0]
    ts = spark.createDataFrame([("c", i, f, f, 1.0) for i, f in enumerate(cf)], "ch string, w long, alpha_cf double, alpha_amp double, e double")
    got = sorted((r.onset_lo_sec, r.onset_hi_sec, r.offset_lo_sec, r.offset_hi_sec, r.duration_lo_sec, r.duration_hi_sec, r.shorter_than_window, r.n_windows)
                 for r in events.to_events(ts, ["ch"], "w", "e", ["alpha"]).collect())
    assert got == [(10.0, 12.5, 10.0, 12.5, 0.0, 17.5, True, 3), (25.0, 27.5, 17.5, 27.5, 0.0, 10.0, True, 1)]


def test_z_round_trip(spark):
    pdf = pd.DataFrame({"k": ["a"] * 9, "i": range(9), "v": [3.0, 1, 4, 1, 5, 9, 2, 6, 5]})
    d = spark.createDataFrame(pdf)
    z = series.robust_z(d, ["k"], "v", "z").toPandas().sort_values("i")
    med = np.median(pdf.v)
    np.testing.assert_allclose(z["z"], (pdf.v - med) / (1.4826 * np.median(abs(pdf.v - med))))
    flat = spark.createDataFrame([("a", 2.0)] * 3, "k string, v double")
    assert [r.z for r in series.robust_z(flat, ["k"], "v", "z").collect()] == [None] * 3
    assert [r.z for r in series.robust_z(flat, ["k"], "v", "z", zero="one").collect()] == [0.0] * 3


def test_window_moments_large_offset(spark):
    v = 1e9 + np.random.default_rng(0).normal(size=40)
    d = spark.createDataFrame(pd.DataFrame({"k": "a", "i": range(40), "v": v}))
    got = windows.window_moments(d, ["k"], "i", "v", 20, 5).toPandas().sort_values("window_idx")
    want = [v[s:s + 20].std() for s in range(0, 21, 5)]
    np.testing.assert_allclose(got["sd"], want, rtol=1e-6)


@pytest.mark.parametrize("block", [16, 64, 8192])
def test_welch_blocks(spark, block):
    x = np.random.default_rng(2).normal(size=203)
    d = spark.createDataFrame(pd.DataFrame({"k": "a", "i": range(203), "v": x}))
    got = spectral.welch_psd(d, ["k"], "i", "v", 50.0, 32, block=block).toPandas().sort_values("freq")
    w = 0.54 - 0.46 * np.cos(2 * np.pi * np.arange(32) / 32)
    segs = [x[s:s + 32] for s in range(0, 203 - 31, 16)]
    p = np.mean([np.abs(np.fft.rfft((s - s.mean()) * w)) ** 2 for s in segs], axis=0) / (50 * (w**2).sum())
    p[1:-1] *= 2
    np.testing.assert_allclose(got["power"], p, rtol=1e-9)
    assert set(got["n_segments"]) == {len(segs)}


@pytest.mark.parametrize("block", [16, 8192])
def test_tf_power(spark, block):
    x = np.random.default_rng(3).normal(size=120)
    d = spark.createDataFrame(pd.DataFrame({"k": "a", "i": range(120), "v": x}))
    got = spectral.tf_power(d, ["k"], "i", "v", 40.0, [4.0, 8.0], [2.0, 3.0], 2, block=block).toPandas().sort_values(["freq", "i"])
    for f, c in ((4.0, 2.0), (8.0, 3.0)):
        w = spectral._wavelet(f, c, 40.0)
        full = np.convolve(x, w, "full")[len(w) // 2:len(w) // 2 + 120]
        np.testing.assert_allclose(got[got.freq == f]["power"], np.abs(full[::2]) ** 2, rtol=1e-9)


def test_aperiodic_line(spark):
    f = np.arange(1, 41, 1.0)
    p = 10 ** (2.0 - 1.5 * np.log10(f))
    bump = p * 10 ** (0.8 * np.exp(-((f - 10) ** 2) / 4))
    d = spark.createDataFrame(pd.DataFrame({"k": ["line"] * 40 + ["bump"] * 40, "freq": np.r_[f, f], "power": np.r_[p, bump]}))
    fit = spectral.aperiodic_fit(d, ["k"], 1, 40)
    got = {r.k: r for r in fit.collect()}
    assert got["line"].exponent == pytest.approx(1.5) and got["line"].offset == pytest.approx(2.0) and got["line"].r2 == pytest.approx(1.0)
    assert abs(got["bump"].exponent - 1.5) < 0.1
    pk = spectral.local_peaks(spectral.flatten(d, fit, ["k"], 1, 40).filter("k = 'bump'"), ["k"], 0.3, 1.0).collect()
    assert [r.cf for r in pk] == [10.0]


def test_identical_series_correlate(spark):
    x = np.random.default_rng(5).normal(size=30)
    d = spark.createDataFrame(pd.DataFrame([(s, i, v) for s in "abc" for i, v in enumerate(x)], columns=["s", "i", "v"]))
    assert [r.isc for r in stats.isc(d, "s", "i", ["v"]).collect()] == pytest.approx([1.0] * 3)


def test_pairs_with_gaps(spark):
    rng = np.random.default_rng(6)
    pdf = pd.DataFrame({c: rng.normal(size=50) for c in "abcd"})
    pdf = pdf.mask(rng.random(pdf.shape) < 0.2)
    long = pdf.melt(ignore_index=False, var_name="c").reset_index().dropna().assign(g="r")
    got = joins.pairs(spark.createDataFrame(long), ["g"], "c", "index", "value").toPandas()
    small = joins.pairwise_moments(spark.createDataFrame(long), ["g"], "c", "index", "value", block=8).withColumn("r", joins.moments_corr()).toPandas()
    want = pdf.corr()
    for d in (got, small):
        assert len(d) == 6
        for r in d.itertuples():
            assert r.r == pytest.approx(want.loc[r.a, r.b], abs=1e-9)


def test_fdr(spark):
    p = [0.01, 0.04, 0.03, None, 0.2, 0.04]
    d = spark.createDataFrame(list(enumerate(p)), "i int, p double")
    got = {r.i: r.p_adj for r in stats.adjust(d, [], "p", "i").collect()}
    assert got[0] == pytest.approx(0.05) and got[1] == got[5] == got[2] == pytest.approx(0.05) and got[3] is None and got[4] == pytest.approx(0.2)


def test_permutation_cut(spark, tiny_pieces):
    pdf = pd.DataFrame({"g": "a", "id": range(60), "v": np.r_[np.zeros(30), np.ones(30) * 5]})
    d = spark.createDataFrame(pdf)
    r = stats.permutation_test(d, ["g"], "v", F.col("id") >= 30, "id", 20, 1).first()
    assert r.observed == 5.0 and r.n_extreme == 0 and r.p == pytest.approx(1 / 21)


def test_shrinkage(spark):
    x = np.random.default_rng(8).normal(size=(80, 4)) @ np.diag([1, 2, 3, 0.5])
    d = spark.createDataFrame(pd.DataFrame(x, columns=list("abcd")))
    cov, w = states.shrunk_cov(d, list("abcd"))
    c = x - x.mean(0)
    s = c.T @ c / 80
    mu = np.trace(s) / 4
    delta = ((s - mu * np.eye(4)) ** 2).sum()
    beta = min(sum(((np.outer(r, r) - s) ** 2).sum() for r in c) / 80**2, delta)
    assert w == pytest.approx(beta / delta)
    np.testing.assert_allclose(cov, (1 - w) * s + w * mu * np.eye(4), atol=1e-12)


def test_pca_and_influence(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(12, 6)) + np.outer(rng.normal(size=12), np.arange(6))
    d = spark.createDataFrame(pd.DataFrame([(f"s{i}", t, x[i, t]) for i in range(12) for t in range(6)], columns=["s", "t", "v"]))
    got = {r.s: r.similarity for r in multivar.pc_influence(d, "s", "t", "v").collect()}

    def pc(m):
        return np.linalg.svd(m - m.mean(0))[2][0]

    for i in range(12):
        assert got[f"s{i}"] == pytest.approx(abs(pc(x) @ pc(np.delete(x, i, 0))), abs=1e-9)
    wide_d = spark.createDataFrame(pd.DataFrame(x, columns=[f"c{j}" for j in range(6)]))
    scored, load = multivar.pca(wide_d, [f"c{j}" for j in range(6)], 2)
    u = np.linalg.svd(x - x.mean(0), full_matrices=False)
    np.testing.assert_allclose(np.abs(load["PC1"]), np.abs(u[2][0]), atol=1e-9)
    assert sum(load.attrs["explained"]) == pytest.approx((u[1][:2] ** 2).sum() / (u[1] ** 2).sum())


def test_robust_pca_recovers(spark):
    rng = np.random.default_rng(10)
    low = np.outer(rng.normal(size=60), rng.normal(size=5))
    sparse = np.zeros((60, 5))
    sparse[rng.integers(0, 60, 12), rng.integers(0, 5, 12)] = 6.0
    m = low + sparse
    cols = [f"c{j}" for j in range(5)]
    d = spark.createDataFrame(pd.DataFrame(m, columns=cols).assign(id=range(60)))
    got = multivar.robust_pca(d, "id", cols, tol=1e-4).toPandas().sort_values("id")
    # The same alternating directions on the whole matrix.
    mu, lam = m.size / (4 * np.abs(m).sum()), 1 / np.sqrt(60)
    s, y = np.zeros_like(m), np.zeros_like(m)
    lo = np.inf
    while np.linalg.norm(m - lo - s) > 1e-4 * np.linalg.norm(m):
        u, w, v = np.linalg.svd(m - s + y / mu, full_matrices=False)
        lo = u @ np.diag(np.maximum(w - 1 / mu, 0)) @ v
        t = m - lo + y / mu
        s = np.sign(t) * np.maximum(np.abs(t) - lam / mu, 0)
        y = y + mu * (m - lo - s)
    np.testing.assert_allclose(got[[f"{c}_low" for c in cols]].to_numpy(), lo, atol=1e-6)
    np.testing.assert_allclose(got[[f"{c}_sparse" for c in cols]].to_numpy(), s, atol=1e-6)


def test_top_k_slices(spark):
    d = spark.createDataFrame(pd.DataFrame({"g": ["h"] * 500 + ["a"] * 2, "v": list(range(500)) + [1, 2]}))
    got = reshape.top_k_by(d, ["g"], [F.col("v").desc()], 3, ["v"]).toPandas()
    assert sorted(got[got.g == "h"]["v"]) == [497, 498, 499] and len(got) == 5


def test_mixed_missing_gaze(spark):
    got = [one(spark, quality.gaze_pass(F.lit(a).cast("double"), F.lit(b).cast("double"))) for a, b in ((0.8, 0.9), (0.8, 0.5), (None, 0.9))]
    assert got == [True, False, None]


def test_shape_matches_pandas(spark):
    x = np.random.default_rng(11).exponential(size=50)
    r = aggs.shape(spark.createDataFrame(pd.DataFrame({"k": "a", "v": x})), ["k"], "v").first()
    assert r["skew"] == pytest.approx(pd.Series(x).skew()) and r["kurtosis"] == pytest.approx(pd.Series(x).kurt())


def test_corr_without_spread(spark):
    """A constant side gives NaN, as SQL does; no division by zero, and rows with one side alone don't count."""
    d = spark.createDataFrame(
        [("flat", 1.0, 2.0), ("flat", 1.0, 3.0), ("one", 1.0, 2.0), ("none", None, 2.0), ("part", 1.0, 2.0), ("part", 1.0, 4.0), ("part", 9.0, None),
         ("line", 1.0, 2.0), ("line", 2.0, 4.0), ("line", 4.0, 8.0)], "k string, a double, b double")
    got = {r["k"]: r["r"] for r in stats.band_coupling(d, ["k"], "a", "b").collect()}
    assert all(np.isnan(got[k]) for k in ("flat", "one", "part")) and got["none"] is None and got["line"] == pytest.approx(1)
    assert [r["r"] for r in stats.corr_by(d, ["k"], "a", "b").where("k = 'part'").collect()] == [pytest.approx(np.nan, nan_ok=True)]


def test_quantiles_round_as_sql(spark):
    """Neighbours that differ by rounding alone, values far apart, and one infinite."""
    import duckdb

    rng = np.random.default_rng(4)
    low = np.round(rng.uniform(0, 150, 400), 3)
    high = np.where(np.arange(400) % 2, np.nextafter(low, 999), low + rng.uniform(0, 30, 400))
    low[2], high[2] = 1.0, np.inf
    d = pd.DataFrame({"k": np.repeat(np.arange(400), 4), "v": np.column_stack([low - 1, low, high, high + 1]).ravel()})
    probs = {"a": 0.25, "b": 0.4, "c": 0.5, "d": 0.75, "e": 0.9}
    got = group.percentiles(spark.createDataFrame(d), ["k"], "v", probs).toPandas().set_index("k").sort_index()
    want = duckdb.sql("SELECT k, " + ", ".join(f"quantile_cont(v, {p}) AS {n}" for n, p in probs.items()) + " FROM d GROUP BY k").df().set_index("k").sort_index()
    pd.testing.assert_frame_equal(got, want[got.columns], check_exact=True, check_index_type=False)


def test_tf_power_leaves_python_as_flat_arrays(spark):
    """No object per sample in the plan of a block's result."""
    d = spark.createDataFrame([("a", i, float(i % 7)) for i in range(40)], "k string, i long, v double")
    got = spectral.tf_power(d, ["k"], "i", "v", 8.0, [1.0, 2.0], [2.0, 3.0], 2, block=8)
    assert "struct<at" not in got._jdf.queryExecution().analyzed().toString() and dict(got.dtypes)["i"] == "bigint"
    whole = spectral.tf_power(d, ["k"], "i", "v", 8.0, [1.0, 2.0], [2.0, 3.0], 2)
    rows = [sorted((r["i"], r["freq"], round(r["power"], 9)) for r in x.collect()) for x in (got, whole)]
    assert rows[0] == rows[1] and [r[0] for r in rows[0]] == [i for i in range(0, 40, 2) for _ in range(2)]


def _one_below():
    """A spectrum with a single point under its first line: none but that is left for the second."""
    hz = [0.5 * k for k in range(1, 9)]
    return pd.DataFrame([("one", f, 0.01 if f == 2.0 else 10.0, 3) for f in hz] + [("two", f, 10.0 / f + k % 3, 3) for k, f in enumerate(hz)], columns=["k", "freq", "power", "n_segments"])


def test_band_readout_without_a_line(spark):
    """No flat spectrum: no frequency of its maximum either."""
    psd = spark.createDataFrame(_one_below())
    flat = spectral.flatten(psd, spectral.aperiodic_fit(psd, ["k"], 0.5, 4), ["k"], 0.5, 4)
    got = {r["k"]: r for r in spectral.band_readout(flat, ["k"], {"mid": (1.0, 2.5)}).collect()}
    assert got["one"][1:] == (None, None, None, False) and None not in got["two"]


def test_fits_compared_with_one_point_left(spark):
    """The exponent of a line through one point is NaN, as SQL's slope, and so is what is made of it."""
    import duckdb

    psd = spark.createDataFrame(_one_below())
    a, b = (spectral.aperiodic_fit(psd, ["k"], 0.5, 4, refit=x) for x in (False, True))
    fit = {r["k"]: r for r in b.collect()}
    offset, exponent = duckdb.connect().execute("SELECT regr_intercept(y, x), -regr_slope(y, x) FROM (VALUES (1.0::DOUBLE, 2.0::DOUBLE)) t(y, x)").fetchall()[0]
    assert np.isnan(exponent) and np.isnan(fit["one"]["exponent"]) and fit["one"]["offset"] is offset is None and fit["one"]["n_freqs"] == 8
    got = {r["output"]: r for r in spectral.compare_fits(a, b, ["k"], ["offset", "exponent"]).collect()}
    assert np.isnan(got["exponent"]["r"]) and np.isnan(got["exponent"]["bias"]) and got["offset"]["n"] == 2 and np.isfinite(got["offset"]["bias"])


def test_bias_against_with_one_point_left(spark):
    psd = spark.createDataFrame(_one_below())
    a, b = (spectral.aperiodic_fit(psd, ["k"], 0.5, 4, refit=x) for x in (False, True))
    level = spark.createDataFrame([("one", 1.0), ("two", 2.0)], "k string, level double")
    got = {r["output"]: r for r in spectral.compare_fits(a, b, ["k"], ["exponent"], level, ["level"]).collect()}
    assert np.isnan(got["exponent"]["r_level"])


def test_equal_windows_have_no_spread(spark):
    """Two of a channel's three windows are equal, their pane sums but for rounding: no scale, and no electrode."""
    from tidegrid.plans import flows

    rng, rows = np.random.default_rng(12), []
    for v in np.round(rng.exponential(50, (5000, 8)), 2):
        v[4], v[5] = np.round(v[0] + 1.37, 2), np.round(v[1] - 1.37, 2)
        mid = sum(v.tolist()) / 8
        a, b, c = ((v[i] - mid) + (v[i + 1] - mid) for i in (0, 2, 4))
        if len(rows) < 240 and (v[0] + v[1]) + v[2] + v[3] == (v[2] + v[3]) + v[4] + v[5] and mid + (a + b) / 4 != mid + (b + c) / 4:
            rows += [(len(rows) // 8, "c", i, float(x)) for i, x in enumerate(v)]
    assert len(rows) == 240
    sig = spark.createDataFrame(rows, "recording long, channel string, sample_idx long, value double").coalesce(1)
    means = windows.window_means(sig, ["recording", "channel"], "sample_idx", "value", 4, 2)
    got = {(r["recording"], r["window_idx"]): r["mean"] for r in means.collect()}
    assert len(got) == 90 and all(got[(k, w)] == np.cumsum([x for *_, x in rows[8 * k + 2 * w:8 * k + 2 * w + 4]])[-1] / 4 for k, w in got)
    lab = spark.createDataFrame([(k, w, (states.INTERNAL, states.EXTERNAL, states.EXTERNAL)[w]) for k in range(30) for w in range(3)], "recording long, window_idx long, label string")
    meta = spark.createDataFrame([("c", "r")], "channel string, region string")
    assert flows.power_contrast(sig, meta, lab, "recording", "channel", "sample_idx", "value", "region", 4, 2, min_n=1).collect() == []


def test_digits_of_blocks_of_rows():
    """Against hashlib: no tail, tails of several lengths in one block, and more than one block."""
    import hashlib

    from tidegrid.functions.digests import digits_48

    rng, heads = np.random.default_rng(6), [b"7-1", b"7-23", b"7-1000", b"-12345-1"]
    for widths in ([0, 0], [0, 1, 5, 47, 3], [52] * 3, [60] * 2, [130] * 2):
        tails = [rng.integers(32, 120, w).astype(np.uint8).tobytes() for w in widths]
        text = np.zeros((len(tails), max(widths)), dtype=np.uint8)
        for row, x in zip(text, tails):
            row[:len(x)] = list(x)
        for head, got in zip(heads, digits_48(heads, text, np.array(widths))):
            assert got.tolist() == [int(hashlib.md5(head + x).hexdigest()[:12], 16) for x in tails]


def test_permutations_are_hashed_in_blocks(spark):
    """Ids of several lengths, text and missing ones, by the digits of a plain digest a row; no such expression in the scan's plan."""
    import hashlib

    ids = [str(i) if i < 300 else "x" * 60 + str(i) for i in range(400)]
    v = np.round(np.random.default_rng(8).normal(size=400), 3).tolist()
    d = spark.createDataFrame([("g", i, x, k % 3 == 0) for k, (i, x) in enumerate(zip(ids, v))], "g string, i string, v double, a boolean")
    got = stats.permutation_test(d, ["g"], "v", F.col("a"), "i", 30, 9).first()
    a, diffs = np.arange(400) % 3 == 0, []
    for p in range(1, 31):
        order = sorted(range(400), key=lambda k: hashlib.md5(f"9-{p}-{ids[k]}".encode()).hexdigest()[:12])
        x = np.array(v)[order]
        diffs.append(x[:a.sum()].mean() - x[a.sum():].mean())
    observed = np.array(v)[a].mean() - np.array(v)[~a].mean()
    assert got["observed"] == pytest.approx(observed) and got["n_extreme"] == int((np.abs(diffs) >= abs(observed)).sum())


def test_rows_stay_in_place_beside_few_groups(spark):
    """Three groups of some 60 MB of rows: their summary is broadcast, so that no task holds a group."""
    d = spark.range(0, 4_000_000, 1, 8).select((F.col("id") % 3).alias("k"), (F.col("id") * 7919 % 4_000_037).cast("double").alias("v"))
    got = group.with_stats(d, ["k"], {"m": F.max("v")})
    assert "SortMergeJoin" not in got._jdf.queryExecution().executedPlan().toString()
    assert got.agg(F.count("m")).first()[0] == 4_000_000
