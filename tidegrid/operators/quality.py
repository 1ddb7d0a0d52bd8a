"""Data quality and coverage tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegrid.operators.group import average_rank, percentiles, with_stats
from tidegrid.operators.joins import join_fallback
from tidegrid.operators.reshape import top_k_by
from tidegrid.operators.series import robust_z
from tidegrid.operators.windows import pad_mask
from tidegrid.session import settle


def artifact_windows(df: DataFrame, by: list[str], channel: str, idx: str, value: str, thr: float = 4.0, share: float = 0.1,
                     mean: float = 1.0, pad: int = 3) -> DataFrame:
    """Bins where many channels are high at once: share of channels with
    robust z over thr above `share`, and mean z above `mean`; padded."""
    z = robust_z(df, [*by, channel], value, "__z", zero="one")
    d = z.groupBy(*by, idx).agg(
        F.avg(F.when(F.col("__z") > thr, 1.0).otherwise(0.0)).alias("frac_high"), F.avg("__z").alias("global_mean"), F.max("__z").alias("global_max")
    )
    hit = (F.col("frac_high") > share) & (F.col("global_mean") > mean)
    d = d.withColumn("mask", F.when(hit, 1).otherwise(0))
    return pad_mask(d, by, idx, "mask", pad, "mask_padded")


def mask_to_windows(df: DataFrame, by: list[str], idx: str, mask: str, length: float, step: float, bin_width: float = 1.0) -> DataFrame:
    """A mask of bins carried to the windows of `length` seconds every `step`
    that end within the series: window_idx, start_sec, end_sec, bad_overlap_sec
    (seconds shared with masked bins) and mask (any at all)."""
    i = F.col("window_idx")
    ends = df.groupBy(*by).agg(((F.max(idx) + 1) * bin_width).alias("__end")).where(F.col("__end") >= length)
    grid = ends.select(*by, F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("__end") - length) / step))).alias("window_idx"))
    grid = grid.withColumns({"start_sec": i * step, "end_sec": i * step + length})
    lo, hi = F.col(idx) * bin_width, (F.col(idx) + 1) * bin_width
    first = F.greatest(F.floor((lo - length) / step) + 1, F.lit(0))
    bad = df.where(F.col(mask) > 0).select(*by, lo.alias("__lo"), hi.alias("__hi"), F.explode(F.sequence(first, F.greatest(F.ceil(hi / step) - 1, first))).alias("window_idx"))
    shared = F.greatest(F.least("__hi", i * step + length) - F.greatest("__lo", i * step), F.lit(0.0))
    bad = bad.groupBy(*by, "window_idx").agg(F.sum(shared).alias("__bad"))
    out = grid.join(bad, [*by, "window_idx"], "left").withColumn("bad_overlap_sec", F.coalesce("__bad", F.lit(0.0)))
    return out.withColumn("mask", (F.col("bad_overlap_sec") > 0).cast("int")).drop("__bad")


def gaze_pass(a: Column, b: Column, least: float = 0.7) -> Column:
    """Each eye present often enough; missing if either share is."""
    return F.when(a.isNotNull() & b.isNotNull(), (a >= least) & (b >= least))


def coverage(recordings: DataFrame, stages: dict[str, tuple[DataFrame, list[str]]], eye: DataFrame, included: DataFrame) -> DataFrame:
    """One row per recording: a flag per stage present, eye shares found under
    the first matching key, the 70 % rule in each eye, whether the analysis
    used it, and empty columns for a human's decision."""
    d = recordings
    for name, (table, on) in stages.items():
        seen = table.select(*on).distinct().withColumn(name, F.lit(True))
        d = d.join(seen, on, "left").fillna(False, [name])
    base = F.split(F.col("patient"), "_")[0]
    pat, vid, run, one = F.col("patient"), F.col("video"), F.col("run"), F.lit("01")
    shares = ["right_present", "left_present", "right_present_post", "left_present_post"]
    d = join_fallback(d, eye, [dict(zip(("patient", "video", "run"), k)) for k in ((pat, vid, run), (base, vid, run), (pat, vid, one), (base, vid, one))], shares)
    keys = ["patient", "session", "video", "run"]
    inc = included.select(*keys).distinct().withColumn("in_pca_stage", F.lit(True))
    d = d.join(inc, keys, "left").fillna(False, ["in_pca_stage"])
    passed = gaze_pass(F.col("right_present"), F.col("left_present"))
    return d.withColumns({
        "gaze_pass_70": passed,
        "gaze_pass_70_post": gaze_pass(F.col("right_present_post"), F.col("left_present_post")),
        "suggested_include": passed,
        "include": F.lit(""), "exclude_reason": F.lit(""), "exclude_modality": F.lit(""),
    })


def missing_fraction(df: DataFrame, by: list[str], cols: list[str]) -> DataFrame:
    return df.groupBy(*by).agg(*[F.avg(F.col(c).isNull().cast("double")).alias(f"{c}_missing") for c in cols])


def integrity(df: DataFrame, recording: list[str], channel: str, value: str) -> DataFrame:
    """ok, partial (a channel all zero) or unreadable (the first channel holds
    non-finite values), from every channel."""
    x = F.col(value)
    bad = x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    per = df.groupBy(*recording, channel).agg(
        F.max(F.when(~bad, F.abs(x))).alias("__top"), F.count_if(bad).alias("__bad")
    )
    d = per.groupBy(*recording).agg(
        F.count(F.lit(1)).alias("n_channels"), F.count_if(F.coalesce(F.col("__top"), F.lit(0.0)) == 0).alias("n_zero"),
        F.min_by("__bad", channel).alias("__first_bad"),
    )
    state = F.when(F.col("__first_bad") > 0, "unreadable").when(F.col("n_zero") > 0, "partial").otherwise("ok")
    return d.withColumn("status", state).drop("__first_bad")


def recording_quality(df: DataFrame, recording: list[str], channel: str, value: str, bad: Column) -> DataFrame:
    """Amplitude metrics over good channels, flat channels (sd below a tenth
    of the median sd), share of good contacts and the grade from it."""
    g = df.filter(~bad)
    m = g.groupBy(*recording).agg(
        F.avg(F.abs(F.col(value))).alias("mean_abs"), F.stddev_pop(value).alias("sd"), (F.max(value) - F.min(value)).alias("range")
    )
    ch = g.groupBy(*recording, channel).agg(F.stddev_pop(value).alias("__sd"))
    flat = ch.join(percentiles(ch, recording, "__sd", {"__med": 0.5}), recording).groupBy(*recording).agg(
        F.count_if(F.col("__sd") < F.col("__med") * 0.1).alias("n_flat"))
    n = df.groupBy(*recording, channel).agg(F.max(bad).alias("__bad")).groupBy(*recording).agg(
        F.count(F.lit(1)).alias("n_contacts"), F.count_if(~F.col("__bad")).alias("n_good"))
    pct = F.col("n_good") / F.col("n_contacts") * 100
    grade = F.when(pct >= 90, "EXCELLENT").when(pct >= 75, "GOOD").when(pct >= 50, "FAIR").otherwise("POOR")
    return n.join(m, recording, "left").join(flat, recording, "left").withColumn("good_pct", pct).withColumn("quality", grade)


def select_refs(df: DataFrame, contact: str, group: str, metrics: dict[str, tuple[Column, float]], keep: Column,
                per_group: int = 1, total: int = 12) -> DataFrame:
    """Reference contacts: those passing `keep`, scored by weighted robust z of
    each metric (lower is better), best per group, best overall."""
    d = df.filter(keep).withColumns({f"__x_{n}": c for n, (c, _) in metrics.items()}).withColumn("__all", F.lit(0))
    d = settle(d, "contacts")
    for n in metrics:
        d = settle(robust_z(d, ["__all"], f"__x_{n}", f"__z_{n}", zero="eps"), "contacts")
    d = d.withColumn("score", reduce(lambda a, b: a + b, [F.lit(float(w)) * F.col(f"__z_{n}") for n, (_, w) in metrics.items()]))
    best = top_k_by(d, [group], [F.col("score"), F.col(contact)], per_group, [contact])
    return best.orderBy("score", contact).limit(total).drop("rank", "__all", *[f"__x_{n}" for n in metrics], *[f"__z_{n}" for n in metrics])


def composite_rank(df: DataFrame, cols: list[str], out: str = "composite") -> DataFrame:
    """Mean of the average ranks of several columns; lower is better."""
    d = df
    for c in cols:
        d = average_rank(d, [], c, f"__r_{c}")
    return d.withColumn(out, reduce(lambda a, b: a + b, [F.col(f"__r_{c}") for c in cols]) / len(cols)).drop(*[f"__r_{c}" for c in cols])


def compare_timebases(a: DataFrame, b: DataFrame, by: list[str], idx: str, t: str, atol: float, rtol: float = 0.0) -> DataFrame:
    """Two clocks shifted to a common start and compared over the shorter."""
    def zeroed(d, name):
        return with_stats(d.select(*by, idx, t), by, {"__t0": F.min_by(t, idx)}).select(*by, idx, (F.col(t) - F.col("__t0")).alias(name))

    met = zeroed(a, "__a").join(zeroed(b, "__b"), [*by, idx])
    err = F.abs(F.col("__a") - F.col("__b"))
    return met.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.max(err).alias("max_error"), F.min(err <= atol + rtol * F.abs("__b")).alias("equal"))


def accuracy_summary(matched: DataFrame, responses: DataFrame, by: list[str], latency: str = "latency", hit: str = "hit") -> DataFrame:
    """Targets, hits, hit rate, responses, false alarms, mean and median
    latency. `matched` is match_responses' output: one response per target."""
    t = matched.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_targets"), F.count_if(hit).alias("n_hits"), F.avg(latency).alias("mean_rt"))
    med = percentiles(matched, by, latency, {"median_rt": 0.5})
    r = responses.groupBy(*by).agg(F.count(F.lit(1)).alias("n_responses"))
    d = t.join(med, by, "left").join(r, by, "left").fillna(0, ["n_responses"])
    return d.withColumns({"hit_rate": F.col("n_hits") / F.col("n_targets"), "n_false_alarms": F.col("n_responses") - F.col("n_hits")})


def sensitivity(df: DataFrame, by: list[str], idx: str, params: list[int], measure) -> DataFrame:
    """measure(df, parameter) for each parameter, stacked with it."""
    parts = [measure(df, p).withColumn("parameter", F.lit(p)) for p in params]
    return reduce(DataFrame.unionByName, parts)


def cohort_quality(df: DataFrame, by: list[str], share: str) -> DataFrame:
    """Recordings above 80 % and 50 % valid, and the mean percentage."""
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_recordings"), (F.avg(share) * 100).alias("mean_valid_pct"),
        F.count_if(F.col(share) > 0.8).alias("above_80"), F.count_if(F.col(share) > 0.5).alias("above_50"), F.count_if(F.col(share) <= 0.5).alias("to_exclude"),
    )


