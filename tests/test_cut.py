"""Work on cut series equals work on whole ones, one hot series included."""

import bisect
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidegrid.operators import events, filters, group, joins, scan, series, windows

pytestmark = pytest.mark.usefixtures("tiny_pieces")


def rows(n_hot=120, others=6, seed=1, ties=True):
    """A hot series with a third or more of the rows, and small ones."""
    rng = random.Random(seed)
    out, i = [], 0
    for key, n in [("hot", n_hot)] + [(f"s{k}", rng.randint(1, 30)) for k in range(others)]:
        t = 0.0
        for j in range(n):
            t += rng.choice([0.0, 0.1, 0.5, 1.5, 4.0]) if ties else rng.choice([0.1, 0.5, 1.5])
            out.append((key, j, round(t, 6), float(rng.randint(0, 20)), i))
            i += 1
    return pd.DataFrame(out, columns=["k", "i", "t", "v", "id"])


def frame(spark, pdf):
    return spark.createDataFrame(pdf.sample(frac=1, random_state=3)).repartition(5)


def test_time_index(spark):
    pdf = rows()
    got = scan.time_index(frame(spark, pdf), ["k"], ["t", "id"], out="at").toPandas()
    assert (got["at"] == got["i"]).all() and len(got) == len(pdf)


def test_one_instant_is_cut_too(spark):
    pdf = pd.DataFrame({"k": "a", "t": [5.0] * 90 + [6.0] * 3, "id": range(93)})
    c = scan.cut(frame(spark, pdf), ["k"], ["t", "id"])
    assert c.df.groupBy(scan.SEG).count().agg(F.max("count")).first()[0] < 60
    got = scan.scan(c, total={"n": F.lit(1)}).toPandas().sort_values("id")
    assert got["n"].tolist() == list(range(1, 94))


def test_scan_values(spark):
    pdf = rows()
    pdf["x"] = pdf["v"].where(pdf["v"] > 14)
    d = frame(spark, pdf.drop(columns="x")).withColumn("x", F.when(F.col("v") > 14, F.col("v")))
    got = scan.scan(scan.cut(d, ["k"], ["t", "id"]), last={"a": F.col("x")}, last_before={"b": F.col("x")}, first_from={"c": F.col("x")},
                    first_after={"e": F.col("x")}, total={"s": F.col("v")}).toPandas().sort_values("id").reset_index(drop=True)
    g = pdf.sort_values(["k", "i"]).groupby("k")["x"]
    for col, want in {"a": g.ffill(), "b": g.transform(lambda s: s.ffill().shift()), "c": g.bfill(), "e": g.transform(lambda s: s.bfill().shift(-1)),
                      "s": pdf.groupby("k")["v"].cumsum()}.items():
        pd.testing.assert_series_equal(got[col], want.sort_index().reset_index(drop=True), check_names=False)


def test_dense_scan_and_frames(spark):
    pdf = rows()
    got = scan.scan(scan.cut_dense(frame(spark, pdf), ["k"], "i"), total={"s": F.col("v")})
    got = scan.framed(got, ["k"], "i", 9, 4, lambda w: {"m": F.sum("v").over(w)}).toPandas().sort_values("id").reset_index(drop=True)
    assert (got["s"] == pdf.groupby("k")["v"].cumsum()).all()
    want = [pdf[(pdf.k == r.k) & (pdf.i >= r.i - 9) & (pdf.i <= r.i + 4)]["v"].sum() for r in pdf.itertuples()]
    assert got["m"].tolist() == want


def test_debounce(spark):
    pdf = rows()
    got = filters.debounce(frame(spark, pdf), ["k"], "t", 1.0, "id").toPandas()
    want = set()
    for _, g in pdf.groupby("k"):
        last = -np.inf
        for r in g.itertuples():
            if r.t - last >= 1.0:
                want.add(r.id)
                last = r.t
    assert set(got["id"]) == want


def test_match_responses(spark):
    pdf = rows(200)
    tg, rs = pdf[pdf.v < 9], pdf[pdf.v >= 9]
    got = joins.match_responses(frame(spark, tg[["k", "t", "id"]]), frame(spark, rs[["k", "t", "id"]]), ["k"], "t", "id", 1.5).toPandas().set_index("id")
    for k, g in tg.groupby("k"):
        used = set()
        resp = rs[rs.k == k]
        for a in g.itertuples():
            hit = next((b for b in resp.itertuples() if b.id not in used and a.t <= b.t <= a.t + 1.5), None)
            if hit is None:
                assert pd.isna(got.loc[a.id, "response_id"])
            else:
                used.add(hit.id)
                assert got.loc[a.id, "response_id"] == hit.id


def test_nearest_join(spark):
    pdf = rows()
    a, b = pdf[pdf.v < 12], pdf[pdf.v >= 12]
    got = joins.nearest_join(frame(spark, a[["k", "t", "id"]]), frame(spark, b[["k", "t", "id"]]), ["k"], "t", ["id"], 0.8).toPandas().set_index("id")
    assert len(got) == len(a)
    for r in a.itertuples():
        c = b[b.k == r.k]
        best = min(((abs(r.t - x.t), x.t, x.id) for x in c.itertuples()), default=None)
        want = best[2] if best and best[0] <= 0.8 else None
        assert (pd.isna(got.loc[r.id, "near_id"]) and want is None) or got.loc[r.id, "near_id"] == want


def test_response_tables(spark):
    pdf = rows()
    a, b = pdf[pdf.v < 9], pdf[pdf.v >= 9]
    got = joins.response_table(frame(spark, a[["k", "t", "id"]]), frame(spark, b[["k", "t", "id"]]), ["k"], "t", "id", 1.5).toPandas()
    for r in got.itertuples():
        hits = sorted(x.t for x in b.itertuples() if x.k == r.k and r.t <= x.t <= r.t + 1.5)
        assert r.n_hits == len(hits) and r.response_times == "; ".join(f"{h:.6f}" for h in hits)
        assert (pd.isna(r.first_t) and not hits) or r.first_t == hits[0]


def drift(cfs, tol):
    ids, start, seg = [], None, []
    for i, f in cfs:
        if start is not None and abs(f - np.median(seg + [f])) > tol:
            start, seg = i, [f]
        else:
            start, seg = (i if start is None else start), seg + [f]
        ids.append((i, start))
    return ids


def windows_of_bands(nulls=True):
    """A long series and short ones with up to two bands a window, and one without a key."""
    rng = random.Random(4)
    out = []
    for key, n in [("hot", 60)] + [(f"s{k}", rng.randint(1, 7)) for k in range(9)] + [(None, 3)] * nulls:
        for i in range(n):
            cf = [rng.choice([None, 4.0, 5.5, 6.0, 7.25]), rng.choice([None, 9.0, 9.5, 12.0, 13.0])]
            out.append((key, i, float(rng.randint(0, 9)), *[x for c in cf for x in (c, c and rng.random())]))
    return out


def brute_events(windows):
    got = {}
    for key in {w[0] for w in windows} - {None}:
        mine = sorted(w for w in windows if w[0] == key)
        for b, name in enumerate(("theta", "alpha")):
            run, runs = [], []
            for w in (w for w in mine if w[3 + 2 * b] is not None):
                if not run or w[1] - run[-1][1] > 2:
                    run = []
                    runs.append(run)
                run.append(w)
            for run in runs:
                ids = [e for _, e in drift([(w[1], w[3 + 2 * b]) for w in run], 2.0)]
                for e in set(ids):
                    ev = [w for w, i in zip(run, ids) if i == e]
                    cf, amp = [w[3 + 2 * b] for w in ev], [w[4 + 2 * b] for w in ev]
                    first, last = ev[0][1], ev[-1][1]
                    got[key, name, first * 2.5 + 10] = (
                        first * 2.5 if first == 0 else first * 2.5 + 7.5, last * 2.5 + (10 if last == mine[-1][1] else 2.5),
                        len(ev), np.median(cf), min(cf), max(cf), max(amp), pytest.approx(np.mean(amp)), pytest.approx(np.mean([w[2] for w in ev])),
                    )
    return got


def events_of(spark, windows):
    d = spark.createDataFrame(windows, "k string, i long, e double, theta_cf double, theta_amp double, alpha_cf double, alpha_amp double").repartition(5)
    return events.to_events(d, ["k"], "i", "e", ["theta", "alpha"])


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


@pytest.mark.parametrize("piece", [7, 1000])
def test_to_events_whole_and_in_pieces(spark, monkeypatch, piece):
    monkeypatch.setattr(scan, "SEGMENT_ROWS", piece)
    rows = windows_of_bands()
    got = {(r.k, r.band, r.onset_hi_sec): (r.onset_lo_sec, r.offset_hi_sec, r.n_windows, r.cf_median, r.cf_min, r.cf_max, r.amp_max, r.amp_mean, r.exponent_mean)
           for r in events_of(spark, rows).collect()}
    want = brute_events(rows)
    assert got == want and max(x[2] for x in want.values()) > 3


def test_short_series_are_dealt_once(spark, monkeypatch):
    """Runs, drift and ends need one shuffle of the windows, the events another;
    nothing but the windows is written."""
    written = []
    for module in (scan, events):
        monkeypatch.setattr(module, "settle", lambda df, name="part", f=module.settle: written.append(name) or f(df, name))
    monkeypatch.setattr(scan, "SEGMENT_ROWS", 1000)
    assert exchanges(events_of(spark, windows_of_bands())) == 2 and written == ["windows"]


def test_drift_of_missing_numbers(spark):
    vals = [10.0, 10.5, float("nan"), 10.0, float("nan"), float("nan"), 11.0, 11.5, 10.0]
    d = spark.createDataFrame([("a", 0, i, f) for i, f in enumerate(vals)], "k string, run_id long, i long, f double")
    got = sorted((r.i, r.event_id) for r in events.split_on_drift(d, ["k", "run_id"], "i", "f").collect())
    assert [e for _, e in got] == [0, 0, 2, 3, 4, 5, 6, 6, 6]


def test_split_on_drift(spark):
    pdf = rows(150)
    d = events.runs(frame(spark, pdf[pdf.v > 3][["k", "i", "v"]]), ["k"], "i", 1)
    got = events.split_on_drift(d, ["k", "run_id"], "i", "v", 6.0).toPandas()
    for (_, run), g in got.groupby(["k", "run_id"]):
        g = g.sort_values("i")
        assert list(zip(g.i, g.event_id)) == drift(list(zip(g.i, g.v)), 6.0)
        assert (np.diff(g.i) <= 2).all() and g.i.iloc[0] == run


def test_runs_example(spark):
    present = [0, 1, 3, 6]
    d = spark.createDataFrame([("a", i) for i in present], "k string, i long")
    got = {r.i: r.run_id for r in events.runs(d, ["k"], "i", 1).collect()}
    assert got == {0: 0, 1: 0, 3: 0, 6: 6}


def test_percentiles_bracket(spark, monkeypatch):
    monkeypatch.setattr(group, "SMALL_GROUP", 50)
    monkeypatch.setattr(group, "BRACKET", 0.02)
    rng = np.random.default_rng(0)
    pdf = pd.DataFrame({"k": ["hot"] * 6000 + ["b"] * 30 + ["c"], "v": np.round(rng.normal(size=6031), 2)})
    probs = {"lo": 0.0, "q": 0.137, "m": 0.5, "h": 0.999, "top": 1.0}
    got = group.percentiles(spark.createDataFrame(pdf), ["k"], "v", probs).toPandas().set_index("k")
    for k, g in pdf.groupby("k"):
        for n, p in probs.items():
            assert got.loc[k, n] == pytest.approx(np.quantile(g.v, p), abs=1e-12)


def test_average_rank(spark):
    pdf = rows()
    got = group.average_rank(frame(spark, pdf), [], "v", "r").toPandas().sort_values("id").reset_index(drop=True)
    assert (got["r"] == pdf["v"].rank()).all()


def gaps(seed=5, n=160):
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(size=n), 3)
    x[rng.random(n) < 0.35] = np.nan
    return x


def as_series(spark, **cols):
    n = len(next(iter(cols.values())))
    pdf = pd.DataFrame({"k": "a", "i": np.arange(n), **cols})
    d = spark.createDataFrame(pdf)
    return d.select("k", "i", *[F.nanvl(c, F.lit(None)).alias(c) if pdf[c].dtype == float else F.col(c) for c in cols])


@pytest.mark.parametrize("edge", ["null", "hold", "line"])
def test_interpolate(spark, edge):
    x = gaps()
    x[:3] = np.nan
    x[-2:] = np.nan
    d = as_series(spark, x=x).withColumn("t", F.col("i").cast("double"))
    got = series.interpolate(d, ["k"], "i", "t", "x", "y", edge=edge).toPandas().sort_values("i")["y"].to_numpy(dtype=float)
    at = np.arange(len(x))
    ok = ~np.isnan(x)
    want = np.interp(at, at[ok], x[ok])
    a, b = at[ok][0], at[ok][-1]
    if edge == "null":
        want[:a], want[b + 1:] = np.nan, np.nan
    if edge == "line":
        i, v = at[ok], x[ok]
        want[:a] = v[0] + (v[1] - v[0]) / (i[1] - i[0]) * (at[:a] - i[0])
        want[b + 1:] = v[-1] + (v[-1] - v[-2]) / (i[-1] - i[-2]) * (at[b + 1:] - i[-1])
    np.testing.assert_allclose(got, want, atol=1e-9)


def test_combine_pair(spark):
    left, right = gaps(1), gaps(2)
    got = series.combine_pair(as_series(spark, a=left, b=right), ["k"], "i", "a", "b", 3, "c").toPandas().sort_values("i")["c"].to_numpy(dtype=float)
    d = np.convolve(left - right, np.ones(3) / 3, "same")
    at, ok = np.arange(len(d)), ~np.isnan(d)
    i, v = at[ok], d[ok]
    full = np.interp(at, i, v)
    full[: i[0]] = v[0] + (v[1] - v[0]) / (i[1] - i[0]) * (at[: i[0]] - i[0])
    full[i[-1] + 1:] = v[-1] + (v[-1] - v[-2]) / (i[-1] - i[-2]) * (at[i[-1] + 1:] - i[-1])
    one = np.where(~np.isnan(left) & ~np.isnan(right), (left + right) / 2, np.where(~np.isnan(left), left - full / 2, np.where(~np.isnan(right), right + full / 2, np.nan)))
    good = ~np.isnan(one)
    np.testing.assert_allclose(got, np.interp(at, at[good], one[good]), atol=1e-9)


def test_fill_and_buffer(spark):
    rng = np.random.default_rng(4)
    valid = rng.random(120) > 0.3
    x = np.round(rng.normal(size=120), 3)
    d = as_series(spark, x=x, ok=valid)
    got = series.fill_and_buffer(d, ["k"], "i", "x", "ok", 3, 5, 1).toPandas().sort_values("i")
    now = valid.copy()
    i = 0
    while i < 120:
        j = i
        while j < 120 and not valid[j]:
            j += 1
        if 0 < j - i < 3:
            now[i:j] = True
        i = max(j, i + 1)
    bad = np.convolve(~now, np.r_[np.zeros(1), np.ones(5)], "full")[2:122] > 1
    at = np.arange(120)
    want = np.where(now & ~bad, np.interp(at, at[valid], x[valid]), np.nan)
    assert (got["ok"].to_numpy() == (now & ~bad)).all()
    np.testing.assert_allclose(got["x"].to_numpy(dtype=float), want, atol=1e-9)


def test_peak_events(spark):
    rng = np.random.default_rng(7)
    n, k, gap, reach = 150, 2, 5, 6
    x, y = np.cumsum(rng.normal(size=n)), np.cumsum(rng.normal(size=n))
    got = series.detect_peaks_events(as_series(spark, x=x, y=y), ["k"], "i", "x", "y", 1.2, 0.6, k, gap, reach).toPandas().sort_values("peak_idx")
    score = np.full(n, np.nan)
    for i in range(k, n - k):
        score[i] = (abs(x[i + 1:i + k + 1].sum() - x[i - k:i].sum()) + abs(y[i + 1:i + k + 1].sum() - y[i - k:i].sum())) / 2
    s = score[~np.isnan(score)]
    q1, q2, q3 = np.quantile(s, [0.25, 0.5, 0.75])
    on = np.nan_to_num(score, nan=-1) > q2 + 0.6 * (q3 - q1)
    want, last = [], -np.inf
    for i in range(n):
        near = score[max(i - 1, 0):i + 2]
        if not np.isnan(score[i]) and score[i] == np.nanmax(near) and score[i] > 1.2 * (q3 - q1) and i - last >= gap:
            lo = [j for j in range(max(i - reach, 0), i) if not on[j]]
            hi = [j for j in range(i + 1, min(i + reach, n - 1) + 1) if not on[j]]
            want.append((i, lo[-1] + 1 if lo else i, hi[0] if hi else i))
            last = i
    assert list(zip(got.peak_idx, got.onset_idx, got.offset_idx)) == want


def test_window_counts_formula(spark):
    d = spark.range(47).select(F.lit("a").alias("k"), F.col("id").alias("i"), F.col("id").cast("double").alias("v"))
    w = windows.window_reduce(windows.assign_windows(d, "i", 20, 5), ["k"], "v", 20, {"m": "mean"})
    assert sorted(r.window_idx * 5 for r in w.collect()) == [0, 5, 10, 15, 20, 25]
    assert windows.grid(spark.range(5990).select(F.lit("a").alias("k"), F.col("id").alias("i")), ["k"], "i", 100, 25).count() == 236


def test_conform_grid(spark):
    for n in (1, 2, 5, 9, 10, 11):
        d = spark.range(n).select(F.lit("a").alias("k"), F.col("id").alias("window_idx"), (F.col("id") * F.col("id")).cast("double").alias("v"))
        got = windows.conform_grid(d, ["k"], "v", 10).toPandas().sort_values("window_idx")
        v = np.arange(n, dtype=float) ** 2
        want = v[:10] if n >= 10 else np.interp(np.linspace(0, 1, 10), np.linspace(0, 1, n), v) if n > 1 else np.full(10, v[0])
        np.testing.assert_allclose(got["v"], want, atol=1e-9)
        assert got["window_idx"].tolist() == list(range(10))
    with pytest.raises(Exception, match="more windows"):
        d = spark.range(13).select(F.lit("a").alias("k"), F.col("id").alias("window_idx"), F.lit(1.0).alias("v"))
        windows.conform_grid(d, ["k"], "v", 10).collect()


def test_trimmed_mean(spark):
    def trim(n):
        d = spark.range(1, n + 1).agg(windows.trimmed_mean(F.collect_list(F.col("id").cast("double"))).alias("m"))
        return d.first()[0]

    assert trim(10) == 5.5 and trim(4) == 2.5


def test_rolling_median_zero_edge(spark):
    x = np.array([3.0, 1.0, 4.0, 1.0, 5.0, 9.0, 2.0, 6.0, 5.0, 3.0])
    got = windows.rolling_median(as_series(spark, x=x), ["k"], "i", "x", 5, "m", edge="zero").toPandas().sort_values("i")["m"]
    pad = np.r_[0, 0, x, 0, 0]
    assert got.tolist() == [np.median(pad[i:i + 5]) for i in range(len(x))]


def test_hot_instant_nearest(spark):
    """A third of all rows at one moment."""
    pdf = pd.DataFrame({"k": "a", "t": [1.0] * 60 + list(np.linspace(0, 3, 61)), "id": range(121)})
    a, b = pdf[pdf.id % 2 == 0], pdf[pdf.id % 2 == 1]
    got = joins.nearest_join(frame(spark, a), frame(spark, b), ["k"], "t", ["id"]).toPandas().set_index("id")
    times = sorted(b.t)
    for r in a.itertuples():
        j = bisect.bisect_left(times, r.t)
        best = min(abs(r.t - x) for x in times[max(0, j - 1):j + 1])
        assert abs(got.loc[r.id, "near_error"]) == pytest.approx(best, abs=1e-12)


def test_overlap_join(spark):
    """Seconds covered, against all pairs, on random and touching intervals."""
    rng = random.Random(4)
    a = pd.DataFrame([("x" if i % 3 else "y", s := rng.randint(0, 80) / 4, s + rng.randint(0, 12) / 4, rng.random() < 0.7) for i in range(90)], columns=["k", "s", "e", "bad"])
    b = pd.DataFrame([("x" if i % 4 else "z", s := rng.randint(0, 80) / 4, s + rng.randint(1, 20) / 4, i) for i in range(40)], columns=["k", "b0", "b1", "id"])
    got = joins.overlap_join(spark.createDataFrame(a), spark.createDataFrame(b), ["k"], ("s", "e"), ("b0", "b1"), "id", F.col("bad")).toPandas().set_index("id")
    assert len(got) == 40
    for r in b.itertuples():
        want = sum(max(0, min(x.e, r.b1) - max(x.s, r.b0)) for x in a.itertuples() if x.k == r.k and x.bad)
        assert got.loc[r.id, "overlap_sec"] == pytest.approx(want, abs=1e-6)


def _leap_plain(t, gap):
    keep, last = [], -np.inf
    for i, x in enumerate(t):
        if x - last >= gap:
            keep.append(i)
            last = x
    return keep


@pytest.mark.parametrize("name, t, gap", [
    ("periodic", np.arange(4000) * 1.0, 1.5), ("tenths", np.arange(900) / 10.0, 0.3), ("wide", np.sort(np.random.default_rng(1).random(700) * 50), 3.0),
    ("ties", np.repeat(np.arange(60.0), 11), 2.0), ("longer than all", np.arange(300.0), 1e9), ("sparse", np.arange(200) * 7.0, 1.0)])
def test_leap_in_few_rounds(spark, monkeypatch, name, t, gap):
    """Kept rows, and doublings of the pointers: at most 2 log2(pieces)."""
    from tidegrid.operators import chains

    written, settle = [], chains.settle
    monkeypatch.setattr(chains, "settle", lambda df, name="part": (written.append(name), settle(df, name))[1])
    d = spark.createDataFrame(pd.DataFrame({"k": 1, "i": range(len(t)), "t": t}))
    got = filters.debounce(d.unionAll(d.where("i < 40").withColumn("k", F.lit(2))), ["k"], "t", gap, "i", rows=len(t) // 60).collect()
    assert sorted(r["i"] for r in got if r["k"] == 1) == _leap_plain(t, gap)
    assert sorted(r["i"] for r in got if r["k"] == 2) == _leap_plain(t[:40], gap)
    assert 0 < written.count("jumps") / 2 <= 2 * np.log2(60)  # a doubling writes the path and the pointers


def test_clamped(spark):
    from tidegrid.operators import chains

    r = np.random.default_rng(4)
    low = r.integers(-9, 9, 400)
    high = low + r.integers(0, 6, 400)
    d = pd.DataFrame({"k": np.repeat([1, 2], [350, 50]), "i": np.append(np.arange(350), np.arange(50)), "lo": low, "hi": high})
    want, x = [], {}
    for row in d.itertuples():
        before = x.get(row.k, 3)
        x[row.k] = min(max(before, row.lo), row.hi)
        want.append((row.k, row.i, before, x[row.k]))
    for rows in (7, 1000):
        got = chains.clamped(spark.createDataFrame(d), ["k"], "i", F.col("lo"), F.col("hi"), "y", "y0", 3, rows)
        assert sorted((r.k, r.i, r.y0, r.y) for r in got.collect()) == want


def test_queue_that_never_empties(spark):
    """Bursts of targets far ahead of their responses, cut within the burst."""
    t = [(1, float(i // 40), i) for i in range(200)]
    rs = [(1, 3.0 + i / 50, i) for i in range(230)]
    got = joins.match_responses(spark.createDataFrame(t, "k int, t double, id int"), spark.createDataFrame(rs, "k int, t double, id int"), ["k"], "t", "id", 4.0, rows=9)
    waiting, want = list(t), {}
    for _, now, i in rs:
        waiting = [w for w in waiting if w[1] + 4.0 >= now]
        if waiting and waiting[0][1] <= now:
            want[waiting.pop(0)[2]] = i
    assert {r["id"]: r["response_id"] for r in got.collect() if r["hit"]} == want and len(want) > 50


@pytest.mark.parametrize("by", [[], ["g"]])
def test_adjust_one_family_in_pieces(spark, by):
    from tidegrid.operators import stats

    r = np.random.default_rng(8)
    d = pd.DataFrame({"g": r.integers(0, 3, 400), "i": range(400), "p": np.round(r.random(400) ** 2, 2)})
    d.loc[d.i % 13 == 0, "p"] = np.nan
    df = spark.createDataFrame(d).withColumn("p", F.when(~F.isnan("p"), F.col("p")))
    got = {x.i: x.p_adj for x in stats.adjust(df, by, "p", "i", rows=11).collect()}
    plan = stats.adjust(df, by, "p", "i", rows=11)._jdf.queryExecution().toString()
    assert len(got) == 400
    for _, f in d.groupby("g") if by else [(0, d)]:
        f = f.dropna().sort_values(["p", "i"])
        want = np.minimum(1, np.minimum.accumulate((f.p * len(f) / np.arange(1, len(f) + 1)).to_numpy()[::-1])[::-1])
        assert [got[i] for i in f.i] == pytest.approx(want)
    assert all(got[i] is None for i in d.i[d.p.isna()])
    one = stats.adjust(df, by, "p", "i", "bonferroni", rows=11).where("p is not null").first()
    assert one.p_adj == pytest.approx(min(1, one.p * (d.p.notna() & ((d.g == one.g) if by else True)).sum()))


@pytest.mark.parametrize("repeated", [False, True])
def test_permutations_by_threshold(spark, repeated):
    """Against a full sort of each permutation; one id for many rows misses the bracket."""
    import hashlib

    from tidegrid.operators import stats

    r = np.random.default_rng(9)
    n = 3000
    d = pd.DataFrame({"g": (np.arange(n) % 4 == 0).astype(int), "i": np.arange(n) % (7 if repeated else n), "a": r.random(n) < 0.3})
    d["v"] = np.round(d.i % 5 + r.random(n), 3) if not repeated else (d.i * 1.0)  # rows of an id are alike
    df = spark.createDataFrame(d).withColumn("v", F.when(F.col("v") != 2.5, F.col("v")))
    got = {x.g: x for x in stats.permutation_test(df, ["g"], "v", F.col("a"), "i", 40, 5).collect()}
    for g, f in d.groupby("g"):
        na, want = int(f.a.sum()), []
        for p in range(1, 41):
            h = [int(hashlib.md5(f"5-{p}-{i}".encode()).hexdigest()[:12], 16) for i in f.i]
            v = f.v.to_numpy()[np.lexsort((f.i, h))]
            want.append(v[:na].mean() - v[na:].mean())
        seen = f.v[f.a].mean() - f.v[~f.a].mean()
        assert got[g].observed == pytest.approx(seen) and got[g].n_extreme == (np.abs(want) >= abs(seen)).sum()
        assert got[g].p == pytest.approx((got[g].n_extreme + 1) / 41)
    none = stats.permutation_test(df.where("a"), ["g"], "v", F.col("a"), "i", 5, 5).collect()
    assert [(x.observed, x.p) for x in none] == [(None, None)] * 2


def test_running_median_is_fast_and_exact():
    import time

    r, m = np.random.default_rng(1), events.Median()
    for k, x in enumerate(r.normal(size=300).tolist()):
        m.add(x)
        if k % 50 == 0:
            m = events.Median(m.below(), m.above())
    assert m.value() == pytest.approx(np.median(np.random.default_rng(1).normal(size=300)))
    t0 = time.time()
    m = events.Median()
    for x in r.permutation(200_000).tolist():
        m.add(float(x))
        m.value()
    assert m.value() == 99_999.5 and time.time() - t0 < 10


def test_pieces_stay_small_beyond_the_partitions(spark, monkeypatch):
    monkeypatch.setattr(scan, "MAX_PIECES", 3)
    t = np.random.default_rng(3).permutation(500) // 7
    d = spark.createDataFrame(pd.DataFrame({"k": (np.arange(500) < 450).astype(int), "t": t, "i": range(500)}))
    c = scan.cut(d, ["k"], ["t", "i"], 20)
    size = c.df.groupBy("k", scan.SEG).count().agg(F.max("count"), F.count("*")).first()
    assert size[0] <= 20 and size[1] >= 25
    got = scan.time_index(d, ["k"], ["t", "i"], "pos", 20).toPandas()
    for _, g in got.groupby("k"):
        assert g.sort_values(["t", "i"]).pos.tolist() == list(range(len(g)))
