"""Cleaning of single series: scaling, gaps, masks, events, references."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegrid.functions.scalars import zscore_of
from tidegrid.operators.filters import debounce
from tidegrid.operators.group import percentiles, with_stats
from tidegrid.operators.scan import cut, cut_dense, framed, scan
from tidegrid.session import settle

MAD_TO_SD = 1.4826
GRID_BLOCK = 4096


def robust_stats(df: DataFrame, keys: list[str], value: str, ref: Column | None = None) -> DataFrame:
    """Median and median absolute deviation per series, optionally from the
    reference rows only."""
    base = df.filter(ref) if ref is not None else df
    base = base.select(*keys, F.col(value).alias("__v"))
    med = settle(percentiles(base, keys, "__v", {"med": 0.5}), "median")
    dev = base.join(med, keys).select(*keys, F.abs(F.col("__v") - F.col("med")).alias("__d"))
    return settle(med.join(percentiles(dev, keys, "__d", {"mad": 0.5}), keys), "scale")


def robust_z(df: DataFrame, keys: list[str], value: str, out: str, ref: Column | None = None, zero: str = "null",
             eps: float = 1e-12) -> DataFrame:
    """(x - median) / (1.4826 * MAD). A zero MAD gives missing ("null"),
    counts as 1 ("one") or has eps added ("eps"). `ref` picks the rows that set
    the scale; all rows are scaled."""
    mad = F.col("mad")
    if zero == "eps":
        scale = (mad + eps) * MAD_TO_SD
    else:
        sd = mad * MAD_TO_SD
        scale = F.when(sd > (0 if zero == "null" else 1e-8), sd)
        scale = F.coalesce(scale, F.lit(1.0)) if zero == "one" else scale
    z = (F.col(value) - F.col("med")) / scale
    return df.join(robust_stats(df, keys, value, ref), keys, "left").withColumn(out, z).drop("med", "mad")


def unscale(df: DataFrame, stats: DataFrame, keys: list[str], z: str, out: str) -> DataFrame:
    """Invert robust_z from the stored median and MAD."""
    return df.join(stats, keys, "left").withColumn(out, F.col(z) * F.col("mad") * MAD_TO_SD + F.col("med")).drop("med", "mad")


def zscore(df: DataFrame, keys: list[str], cols: list[str], ddof: int, fill: float | None = None, suffix: str = "_z") -> DataFrame:
    """Mean/sd scaling per key; zero variance gives missing."""
    if fill is not None:
        df = df.fillna(fill, cols)
    sd = F.stddev_pop if ddof == 0 else F.stddev_samp
    stats = {f"__{s}_{c}": f(c) for c in cols for s, f in (("m", F.avg), ("s", sd))}
    d = with_stats(df, keys, stats)
    return d.withColumns({c + suffix: zscore_of(F.col(c), F.col(f"__m_{c}"), F.col(f"__s_{c}")) for c in cols}).drop(*stats)


def interpolate(df: DataFrame, keys: list[str], idx: str, t: str, value: str, out: str, max_gap: int | None = None,
                edge: str = "null") -> DataFrame:
    """Linear interpolation of missing values along a 0-based index.

    max_gap: longer runs of missing samples stay missing. edge: outside the
    first and last value "null", "hold" the end value, or "line" (go on along
    the last two values).
    """
    here = F.when(F.col(value).isNotNull(), F.struct(F.col(t).alias("t"), F.col(value).alias("v"), F.col(idx).alias("i")))
    need = {"last": {"__p": here}, "first_from": {"__n": here}}
    d = scan(cut_dense(df, keys, idx), **need)
    p, n = F.col("__p"), F.col("__n")
    frac = (F.col(t) - p["t"]) / F.when(n["t"] != p["t"], n["t"] - p["t"])
    fill = p["v"] + (n["v"] - p["v"]) * frac
    drops: list[str] = ["__p", "__n"]
    if edge == "hold":
        fill = F.when(p.isNull(), n["v"]).when(n.isNull(), p["v"]).otherwise(fill)
    elif edge == "line":
        ends = with_stats(df.filter(here.isNotNull()).select(*keys, here.alias("__h")), keys, {"__a": F.min("__h"), "__z": F.max("__h")})
        ends = ends.groupBy(*keys).agg(
            F.first("__a").alias("__a"), F.min(F.when(F.col("__h.i") > F.col("__a.i"), F.col("__h"))).alias("__a2"),
            F.first("__z").alias("__z"), F.max(F.when(F.col("__h.i") < F.col("__z.i"), F.col("__h"))).alias("__z2"),
        )
        d = d.join(ends, keys, "left")
        drops += ["__a", "__a2", "__z", "__z2"]

        def line(a: str, b: str) -> Column:
            slope = (F.col(f"{b}.v") - F.col(f"{a}.v")) / (F.col(f"{b}.t") - F.col(f"{a}.t"))
            return F.col(f"{a}.v") + slope * (F.col(t) - F.col(f"{a}.t"))

        fill = F.when(p.isNull(), line("__a", "__a2")).when(n.isNull(), line("__z", "__z2")).otherwise(fill)
    if max_gap is not None:
        d = with_stats(d, keys, {"__len": F.max(idx) + 1})
        run = F.coalesce(n["i"], F.col("__len")) - F.coalesce(p["i"], F.lit(-1)) - 1
        fill = F.when(run <= max_gap, fill)
        drops.append("__len")
    return d.withColumn(out, F.coalesce(F.col(value), fill)).drop(*drops)


def resample(df: DataFrame, points: DataFrame, keys: list[str], t: str, value: str) -> DataFrame:
    """Linear interpolation at the given points (keys, t); missing outside the
    samples' range. Samples and points share one ordered pass."""
    both = df.select(*keys, t, F.col(value).alias("__v"), F.lit(0).alias("__side")).filter("__v is not null").unionByName(
        points.select(*keys, t, F.lit(1).alias("__side")), allowMissingColumns=True
    )
    here = F.when(F.col("__side") == 0, F.struct(F.col(t).alias("t"), F.col("__v").alias("v")))
    # An equal time sorts the sample first: it is both the last value and exact.
    d = scan(cut(both, keys, [t, "__side"]), last={"__p": here}, first_from={"__n": here}).filter("__side = 1")
    exact = F.col("__p.t") == F.col(t)
    frac = (F.col(t) - F.col("__p.t")) / (F.col("__n.t") - F.col("__p.t"))
    return d.select(*keys, t, F.when(exact, F.col("__p.v")).otherwise(
        F.col("__p.v") + (F.col("__n.v") - F.col("__p.v")) * frac).alias(value))


def fill_and_buffer(df: DataFrame, keys: list[str], idx: str, value: str, valid: str, k_small: int, k_large: int,
                    k_delay: int) -> DataFrame:
    """Fill invalid runs shorter than k_small; then blank a buffer of k_large
    samples, shifted by k_delay, wherever it meets two or more samples that are
    still invalid."""
    shown = F.when(F.col(valid), F.col(value))
    mark = F.when(F.col(valid), F.col(idx))
    d = df.withColumns({"__x": shown, "__i": F.col(idx).cast("double")})
    d = interpolate(d, keys, idx, "__i", "__x", "__y", edge="hold")
    d = with_stats(scan(cut_dense(d, keys, idx), last={"__p": mark}, first_from={"__n": mark}), keys, {"__len": F.max(idx) + 1})
    run = F.coalesce(F.col("__n"), F.col("__len")) - F.coalesce(F.col("__p"), F.lit(-1)) - 1
    ok = F.col(valid) | (run < k_small)
    d = d.withColumns({"__ok": ok}).withColumn("__bad", F.when(F.col("__ok"), 0).otherwise(1))
    width = k_delay + k_large
    c = (width - 1) // 2
    d = framed(d, keys, idx, width - 1 - c, c - k_delay, lambda w: {"__near": F.sum("__bad").over(w)})
    good = F.col("__ok") & (F.coalesce(F.col("__near"), F.lit(0)) <= 1)
    return d.withColumns({value: F.when(good, F.col("__y")), valid: good}).drop(
        "__x", "__i", "__y", "__p", "__n", "__len", "__ok", "__bad", "__near")


def cap_filled(df: DataFrame, keys: list[str], raw: str, filled: str, k: float, mode: str = "clip", center: str = "median") -> DataFrame:
    """Hold filled-in values within center +/- k sd of the raw ones: clip them
    to the bound, or put the center in their place ("reset")."""
    d = with_stats(df, keys, {"__sd": F.stddev_pop(raw)})
    if center == "median":
        d = d.join(percentiles(df, keys, raw, {"__mid": 0.5}), keys, "left")
    else:
        d = d.withColumn("__mid", F.lit(0.0))
    mid, reach = F.col("__mid"), F.lit(float(k)) * F.col("__sd")
    x = F.col(filled)
    held = F.least(F.greatest(x, mid - reach), mid + reach) if mode == "clip" else F.when(F.abs(x - mid) > reach, mid).otherwise(x)
    return d.withColumn(filled, F.when(F.col(raw).isNull() & x.isNotNull(), held).otherwise(x)).drop("__sd", "__mid")


def dilate(df: DataFrame, keys: list[str], idx: str, mask: str, k: int, out: str) -> DataFrame:
    return framed(df, keys, idx, k, k, lambda w: {out: F.max(mask).over(w)})


def erode(df: DataFrame, keys: list[str], idx: str, mask: str, k: int, out: str) -> DataFrame:
    return framed(df, keys, idx, k, k, lambda w: {out: F.min(mask).over(w)})


def combine_pair(df: DataFrame, keys: list[str], idx: str, left: str, right: str, k: int, out: str) -> DataFrame:
    """Two eyes as one: the mean where both are valid; one eye moved by half
    the running mean difference where only one is; gaps interpolated."""
    both = F.col(left) - F.col(right)
    half = k // 2

    def cols(w):
        # A running mean over k samples is known only where all k are.
        return {"__d": F.when(F.count(both).over(w) == F.count(F.lit(1)).over(w), F.sum(both).over(w) / F.lit(k))}

    d = framed(df, keys, idx, half, half, cols).withColumn("__i", F.col(idx).cast("double"))
    d = interpolate(d, keys, idx, "__i", "__d", "__df", edge="line")
    one = (
        F.when(F.col(left).isNotNull() & F.col(right).isNotNull(), (F.col(left) + F.col(right)) / 2)
        .when(F.col(left).isNotNull(), F.col(left) - F.col("__df") / 2)
        .when(F.col(right).isNotNull(), F.col(right) + F.col("__df") / 2)
    )
    d = d.withColumn("__x", one)
    return interpolate(d, keys, idx, "__i", "__x", out, edge="hold").drop("__d", "__df", "__i", "__x")


def islands(df: DataFrame, keys: list[str], idx: str, cond: Column) -> DataFrame:
    """Rows where cond holds, with `run_id`, the start index of their run."""
    from tidegrid.operators.events import runs

    return runs(df.filter(cond), keys, idx, 0)


def detect_runs(df: DataFrame, keys: list[str], idx: str, cond: Column, fs: float, min_sec: float, max_sec: float) -> DataFrame:
    """Runs of cond lasting min_sec to max_sec. A run ends at the first sample
    after it; one that reaches the end of the series ends at its last sample."""
    d = with_stats(df, keys, {"__last": F.max(idx)})
    runs = islands(d, keys, idx, cond).groupBy(*keys, "run_id").agg(F.max(idx).alias("__end"), F.first("__last").alias("__last"))
    end = F.least(F.col("__end") + 1, F.col("__last"))
    length = (end - F.col("run_id")) / F.lit(float(fs))
    return runs.select(*keys, F.col("run_id").alias("start_idx"), end.alias("end_idx"), length.alias("duration")).filter(
        F.col("duration").between(min_sec, max_sec)
    )


def kinematics(df: DataFrame, keys: list[str], idx: str, x: str, y: str, fs: float) -> DataFrame:
    """Steps, speed and acceleration from the sample before, and the central
    gradient of x."""
    def cols(w):
        back, back2, ahead = w.rowsBetween(-1, -1), w.rowsBetween(-2, -2), w.rowsBetween(1, 1)
        return {
            "__px": F.lag(x).over(back), "__py": F.lag(y).over(back), "__nx": F.lead(x).over(ahead),
            "__qx": F.lag(x, 2).over(back2), "__qy": F.lag(y, 2).over(back2),
            "__first": F.lag(idx).over(back).isNull(), "__last": F.lead(idx).over(ahead).isNull(),
        }

    d = framed(df, keys, idx, 2, 1, cols)
    rate = F.lit(float(fs))
    dx, dy = F.col(x) - F.col("__px"), F.col(y) - F.col("__py")
    px, py = F.col("__px") - F.col("__qx"), F.col("__py") - F.col("__qy")
    v, v0 = F.sqrt(dx * dx + dy * dy) * rate, F.sqrt(px * px + py * py) * rate
    grad = (
        F.when(F.col("__first"), F.col("__nx") - F.col(x)).when(F.col("__last"), dx)
        .otherwise((F.col("__nx") - F.col("__px")) / 2)
    )
    return d.withColumns({"dx": dx, "dy": dy, "speed": v, "accel": (v - v0) * rate, "gradient": grad}).drop(
        "__px", "__py", "__nx", "__qx", "__qy", "__first", "__last")


def step_from(df: DataFrame, keys: list[str], idx: str, cols: dict[str, str]) -> DataFrame:
    """Difference from the sample before: cols maps new name -> column."""
    return framed(df, keys, idx, 1, 0, lambda w: {n: F.col(c) - F.lag(c).over(w_rows(w)) for n, c in cols.items()})


def w_rows(w):
    """The same window without a frame, for lag and lead."""
    return w.rowsBetween(-1, -1)


def speed_limits(df: DataFrame, keys: list[str], idx: str, x: str, y: str, valid: Column, fs: float, pad: int,
                 q: float = 0.999, factor: float = 1.2) -> DataFrame:
    """Upper limits of speed and acceleration: adjacent good samples only, none
    within `pad` of a gap, q-quantile times a factor."""
    good = F.coalesce(valid & F.col(x).isNotNull() & F.col(y).isNotNull(), F.lit(False))
    d = df.withColumn("__g", F.when(good, 1).otherwise(0))
    d = erode(d, keys, idx, "__g", pad, "__g2")
    d = d.withColumns({c: F.when(F.col("__g2") == 1, F.col(c)) for c in (x, y)})
    d = kinematics(d, keys, idx, x, y, fs).select(*keys, "speed", F.abs("accel").alias("__a"))
    d = settle(d, "speed")
    q_v = percentiles(d, keys, "speed", {"q_v": q})
    q_a = percentiles(d, keys, "__a", {"q_a": q})
    sums = d.groupBy(*keys).agg(
        F.max("speed").alias("speed_max"), F.max("__a").alias("accel_max"), F.count("speed").alias("n_speed"), F.count("__a").alias("n_accel")
    )
    return sums.join(q_v, keys, "left").join(q_a, keys, "left").withColumns(
        {"vmax": F.col("q_v") * factor, "amax": F.col("q_a") * factor}
    ).drop("q_v", "q_a")


def mask_spikes(df: DataFrame, keys: list[str], idx: str, value: str, z: float, out: str) -> DataFrame:
    """A sample whose step exceeds z robust sd of the steps becomes missing.
    A series whose steps have zero MAD stays as it is."""
    d = settle(step_from(df, keys, idx, {"__dx": value}), "steps")
    d = d.join(robust_stats(d.filter("__dx is not null"), keys, "__dx"), keys, "left")
    hit = (F.col("mad") > 0) & (F.abs("__dx") > F.lit(float(z) * MAD_TO_SD) * F.col("mad"))
    return d.withColumn(out, F.when(F.coalesce(hit, F.lit(False)), None).otherwise(F.col(value))).drop("__dx", "med", "mad")


def spike_runs(df: DataFrame, keys: list[str], idx: str, value: str, z: float, max_width: int) -> DataFrame:
    """Short runs of extreme steps: start, width and centre sample."""
    # The steps are read five times and cost a shuffle: written once.
    d = settle(step_from(df, keys, idx, {"__dx": value}).filter("__dx is not null").select(*keys, idx, "__dx"), "steps")
    d = d.join(robust_stats(d, keys, "__dx"), keys).filter("mad > 0")
    extreme = F.abs(F.lit(0.6745) * (F.col("__dx") - F.col("med")) / F.col("mad")) > z
    # Extreme steps are few: the runs start from a small table.
    hits = settle(d.filter(extreme).select(*keys, idx), "extremes")
    runs = islands(hits, keys, idx, F.lit(True)).groupBy(*keys, "run_id").agg(F.max(idx).alias("__end"))
    width = F.col("__end") - F.col("run_id") + 1
    return runs.select(
        *keys, F.col("run_id").alias("start_idx"), width.alias("width"), F.floor((F.col("run_id") + F.col("__end") - 2) / 2 + 1).alias("center")
    ).filter(F.col("width") <= max_width)


def detect_spikes(df: DataFrame, keys: list[str], idx: str, value: str, z: float, max_width: int, min_sep: int) -> DataFrame:
    """Spike centres at least min_sep samples apart."""
    return debounce(spike_runs(df, keys, idx, value, z, max_width), keys, "center", min_sep, "start_idx")


def repair_spikes(df: DataFrame, spikes: DataFrame, keys: list[str], idx: str, value: str, w: int, out: str) -> DataFrame:
    """Interpolate w samples either side of each spike centre."""
    near = spikes.select(*keys, F.explode(F.sequence(F.col("center") - w, F.col("center") + w)).alias(idx)).distinct()
    d = df.join(near.withColumn("__hit", F.lit(True)), [*keys, idx], "left")
    d = d.withColumns({"__x": F.when(F.col("__hit").isNull(), F.col(value)), "__i": F.col(idx).cast("double")})
    return interpolate(d, keys, idx, "__i", "__x", out, edge="hold").drop("__x", "__i", "__hit")


def hold_last(df: DataFrame, keys: list[str], idx: str, value: str, ok: Column, out: str, first: float = 0.0) -> DataFrame:
    """Values failing the condition take the last one that passed."""
    d = scan(cut_dense(df, keys, idx), last={out: F.when(ok, F.col(value))})
    return d.withColumn(out, F.coalesce(out, F.lit(float(first)))).withColumn("held", F.coalesce(~ok, F.lit(False)))


def near_counts(marks: DataFrame, events: DataFrame, keys: list[str], idx: str, tol: int) -> DataFrame:
    """Marks within tol of an event, and the rest, per key."""
    from tidegrid.operators.joins import nearest_join

    t = F.col(idx).cast("double").alias("__at")
    near = nearest_join(marks.select(*keys, t), events.select(*keys, t, F.lit(1).alias("__e")), keys, "__at", ["__e"], float(tol))
    out = near.groupBy(*keys).agg(F.count(F.lit(1)).alias("total"), F.count("near_t").alias("near"))
    return out.withColumns({"isolated": F.col("total") - F.col("near"), "pct_near": F.col("near") / F.col("total") * 100.0})


def detect_peaks_events(df: DataFrame, keys: list[str], idx: str, x: str, y: str, thr_iqr: float, on_iqr: float, k: int,
                        min_dist: int, reach: int) -> DataFrame:
    """Saccade-like events: local maxima of an edge score above thr_iqr
    interquartile ranges, none near gaps, at least min_dist apart; onset and
    offset where the score crosses median + on_iqr IQRs within `reach`."""
    def gather(w):
        ahead, behind = w.rangeBetween(1, k), w.rangeBetween(-k, -1)
        return {
            "__dx": F.sum(x).over(ahead) - F.sum(x).over(behind),
            "__dy": F.sum(y).over(ahead) - F.sum(y).over(behind),
            "__n": F.count(F.when(F.col(x).isNotNull() & F.col(y).isNotNull(), 1)).over(w),
        }

    d = framed(df, keys, idx, k, k, gather)
    score = (F.abs("__dx") + F.abs("__dy")) / 2
    d = d.withColumn("score", F.when(F.col("__n") == 2 * k + 1, score)).drop("__dx", "__dy", "__n")
    d = settle(d.select(*keys, idx, "score"), "score")
    q = percentiles(d, keys, "score", {"q1": 0.25, "q2": 0.5, "q3": 0.75})
    d = framed(d, keys, idx, 1, 1, lambda w: {"__peak": F.max("score").over(w)})
    d = d.join(q, keys).withColumn("__iqr", F.col("q3") - F.col("q1"))
    above = F.col("score") > F.col("q2") + F.lit(float(on_iqr)) * F.col("__iqr")
    d = d.withColumn("__on", F.when(above, 1).otherwise(0))
    d = framed(d, keys, idx, reach, reach, lambda w: {
        "__w": F.collect_list(F.struct(F.col(idx).alias("i"), F.col("__on").alias("on"))).over(w)
    })
    peak = (F.col("score") == F.col("__peak")) & (F.col("score") > F.lit(float(thr_iqr)) * F.col("__iqr"))
    d = d.filter(peak)
    ups = F.filter("__w", lambda r: (r["on"] == 0) & (r["i"] < F.col(idx)))
    downs = F.filter("__w", lambda r: (r["on"] == 0) & (r["i"] > F.col(idx)))
    d = d.withColumns({
        "onset_idx": F.coalesce(F.try_element_at(ups, F.lit(-1))["i"] + 1, F.col(idx)),
        "offset_idx": F.coalesce(F.try_element_at(downs, F.lit(1))["i"], F.col(idx)),
    }).select(*keys, F.col(idx).alias("peak_idx"), "score", "onset_idx", "offset_idx")
    return debounce(d.withColumn("__p", F.col("peak_idx").cast("double")), keys, "__p", float(min_dist), "peak_idx").drop("__p")


def rising_edges(df: DataFrame, keys: list[str], idx: str, value: str, k_sd: float = 2.0) -> DataFrame:
    """Samples where the value first exceeds mean + k sd."""
    d = with_stats(df, keys, {"__m": F.avg(value), "__s": F.stddev_pop(value)})
    d = d.withColumn("__up", F.when(F.col(value) > F.col("__m") + F.lit(float(k_sd)) * F.col("__s"), 1).otherwise(0))
    d = framed(d, keys, idx, 1, 0, lambda w: {"__was": F.min("__up").over(w.rowsBetween(-1, -1))})
    return d.filter("__up = 1 and __was = 0").drop("__m", "__s", "__up", "__was")


def rereference(df: DataFrame, by: list[str], idx: str, channel: str, value: str, mode: str, out: str, *,
                group: str | None = None, good: Column | None = None, chosen: list[str] | None = None,
                pairs: DataFrame | None = None, number: str | None = None) -> DataFrame:
    """group / common / channels: subtract the mean of good, or chosen,
    channels at each sample (a group with fewer than two good channels is left
    as it is). pairs: anode - cathode, first of duplicated names kept.
    neighbour: contact n minus contact n + 1 of its group."""
    if mode in ("group", "common", "channels"):
        src = F.col(channel).isin(chosen) if mode == "channels" else (good if good is not None else F.lit(True))
        at = [*by, idx, *([group] if mode == "group" else [])]
        ref = df.groupBy(*at).agg(F.avg(F.when(src, F.col(value))).alias("__ref"), F.count(F.when(src, 1)).alias("__n"))
        sub = F.col(value) - F.col("__ref")
        if mode == "group":
            sub = F.when(F.col("__n") >= 2, sub).otherwise(F.col(value))
        return df.join(ref, at, "left").withColumn(out, sub).drop("__ref", "__n")
    if mode == "pairs":
        once = pairs.groupBy("name").agg(F.min_by(F.struct("anode", "cathode"), "ordinal").alias("__p")).select("name", "__p.*")
        a = df.join(once, df[channel] == once["anode"]).select(*by, idx, "name", "cathode", F.col(value).alias("__a"))
        b = df.select(*by, idx, F.col(channel).alias("cathode"), F.col(value).alias("__b"))
        return a.join(b, [*by, idx, "cathode"]).select(*by, idx, "name", (F.col("__a") - F.col("__b")).alias(out))
    if mode == "neighbour":
        nxt = df.select(*by, idx, group, (F.col(number) - 1).alias(number), F.col(value).alias("__b"))
        return df.join(nxt, [*by, idx, group, number]).withColumn(out, F.col(value) - F.col("__b")).drop("__b")
    raise ValueError(mode)


def regress_out(df: DataFrame, noise: DataFrame, by: list[str], channel: str, idx: str, value: str, out: str) -> DataFrame:
    """Subtract beta * (noise - mean noise), beta = cov / var per channel. The
    channel keeps its mean; a flat noise channel is an error. `noise` has one
    row per (by, idx) with column noise."""
    d = df.join(noise, [*by, idx])
    d = with_stats(d, [*by, channel], {"__c": F.covar_pop(value, "noise"), "__v": F.var_pop("noise"), "__m": F.avg("noise")})
    flat = F.raise_error(F.lit("noise channel is flat")).cast("double")
    beta = F.col("__c") / F.when(F.col("__v") == 0, flat).otherwise(F.col("__v"))
    return d.withColumn(out, F.col(value) - beta * (F.col("noise") - F.col("__m"))).drop("__c", "__v", "__m")


def circular_shift(df: DataFrame, keys: list[str], idx: str, k: Column) -> DataFrame:
    """Turn each series by k samples: sample k becomes the first."""
    d = with_stats(df, keys, {"__n": F.max(idx) + 1})
    return d.withColumn(idx, F.pmod(F.col(idx) - k, F.col("__n"))).drop("__n")


def smooth_decimate(df: DataFrame, keys: list[str], idx: str, value: str, size: int, k: int, out: str, passes: int = 1) -> DataFrame:
    """Moving average, once or twice, then every k-th sample."""
    d, src = df, value
    for _ in range(passes):
        d = framed(d, keys, idx, size // 2, (size - 1) // 2, lambda w: {out: F.avg(src).over(w)})
        src = out
    return d.filter(F.pmod(F.col(idx), F.lit(k)) == 0)


def align_average(df: DataFrame, series: str, t: str, value: str, dt: float) -> DataFrame:
    """Mean over series on a common grid: their overlap in time, step dt. Also
    the number of series contributing."""
    span = df.groupBy(series).agg(F.min(t).alias("__a"), F.max(t).alias("__b"))
    lo, hi = span.agg(F.max("__a"), F.min("__b")).first()
    n = int((hi - lo) // dt) if lo is not None else -1
    # By blocks of the grid, so that no array holds all of it.
    first = F.explode(F.sequence(F.lit(0), F.lit(n), F.lit(GRID_BLOCK)).cast("array<bigint>") if n >= 0 else F.array().cast("array<bigint>"))
    steps = F.explode(F.sequence(F.col("__first"), F.least(F.col("__first") + GRID_BLOCK - 1, F.lit(n).cast("bigint"))))
    at = F.lit(lo) + F.col("grid_idx") * F.lit(float(dt))
    points = span.select(series, first.alias("__first")).select(series, steps.alias("grid_idx")).withColumn(t, at)
    got = resample(df, points, [series], t, value).withColumn("grid_idx", F.round((F.col(t) - F.lit(lo)) / F.lit(float(dt))).cast("long"))
    return got.groupBy("grid_idx").agg(F.first(t).alias(t), F.avg(value).alias("mean"), F.count(value).alias("n_series"))


def median_step(df: DataFrame, keys: list[str], idx: str, t: str) -> DataFrame:
    """Median sampling interval per series."""
    return percentiles(step_from(df, keys, idx, {"__dt": t}), keys, "__dt", {"dt": 0.5})


def disparity(df: DataFrame, lx: Column, rx: Column, ly: Column, ry: Column) -> DataFrame:
    """Right minus left gaze: horizontal, length and angle."""
    dx, dy = rx - lx, ry - ly
    return df.withColumns({"disp_x": dx, "disp_norm": F.sqrt(dx * dx + dy * dy), "disp_angle": F.degrees(F.atan2(dy, dx))})


def saccade_table(starts: DataFrame, samples: DataFrame, by: list[str], onset: str, fixation: str, t: str, idx: str,
                  x: str, y: str) -> DataFrame:
    """Distance from the sample nearest saccade onset to the one nearest
    fixation onset; missing if either position is."""
    from tidegrid.operators.joins import nearest_join

    side = samples.select(*by, t, idx, x, y)
    a = nearest_join(starts.withColumn(t, F.col(onset)), side, by, t, [idx, x, y], tie=idx)
    a = a.withColumnsRenamed({f"near_{c}": f"start_{c}" for c in (idx, x, y)}).drop("near_t", "near_error", t)
    b = nearest_join(a.withColumn(t, F.col(fixation)), side, by, t, [idx, x, y], tie=idx)
    b = b.withColumnsRenamed({f"near_{c}": f"end_{c}" for c in (idx, x, y)}).drop("near_t", "near_error", t)
    return b.withColumn("dispersion", F.sqrt(F.pow(F.col(f"end_{x}") - F.col(f"start_{x}"), 2) + F.pow(F.col(f"end_{y}") - F.col(f"start_{y}"), 2)))


def fixation_stats(df: DataFrame, keys: list[str], onset: str, fixation: str, tie: str) -> DataFrame:
    """A fixation lasts until the next saccade: count, mean, sd, total."""
    d = scan(cut(df, keys, [onset, tie]), first_after={"__next": F.col(onset)})
    dur = F.col("__next") - F.col(fixation)
    return d.groupBy(*keys).agg(
        F.count(dur).alias("n_fixations"), F.avg(dur).alias("mean_fixation"), F.stddev_pop(dur).alias("sd_fixation"), F.sum(dur).alias("sum_fixation")
    )


def rate_sd(df: DataFrame, keys: list[str], idx: str, value: str, fs: float) -> DataFrame:
    """Sd of the sample-to-sample rate of change."""
    d = step_from(df, keys, idx, {"__d": value})
    return d.groupBy(*keys).agg(F.stddev_pop(F.col("__d") * F.lit(float(fs))).alias("rate_sd"))
