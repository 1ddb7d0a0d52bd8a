"""Attention states: departure from the group, scaling, labels, sweeps."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegrid.operators.aggs import proportions
from tidegrid.operators.group import corr_of, percentiles, with_stats
from tidegrid.operators.multivar import moment_matrix
from tidegrid.operators.series import zscore

# Label names.
INTERNAL, EXTERNAL, NEUTRAL = "Internal_HighConfidence", "External_HighConfidence", "Neutral"


def residuals(df: DataFrame, time: list[str], cols: list[str]) -> DataFrame:
    """Each column minus its group mean at that time, as <col>_res."""
    d = with_stats(df, time, {f"__g_{c}": F.avg(c) for c in cols})
    return d.withColumns({f"{c}_res": F.col(c) - F.col(f"__g_{c}") for c in cols}).drop(*[f"__g_{c}" for c in cols])


def deviation_l2(df: DataFrame, time: list[str], cols: list[str], out: str = "deviation") -> DataFrame:
    d = residuals(df, time, cols)
    sq = reduce(lambda a, b: a + b, [F.col(f"{c}_res") * F.col(f"{c}_res") for c in cols])
    return d.withColumn(out, F.sqrt(sq)).drop(*[f"{c}_res" for c in cols])


def shrunk_cov(res: DataFrame, cols: list[str]) -> tuple[np.ndarray, float]:
    """Ledoit-Wolf covariance of complete rows and its shrinkage weight.

    One aggregate gives the p x p moments; a second, about the mean, the sum of
    squared row norms that sets the weight. Only those few numbers reach the
    driver."""
    full = res.dropna(subset=cols)
    n, mean, cov = moment_matrix(full, cols)
    p = len(cols)
    centred = [F.col(c) - F.lit(float(m)) for c, m in zip(cols, mean)]
    norm2 = reduce(lambda a, b: a + b, [c * c for c in centred])
    fourth = full.agg(F.sum(norm2 * norm2)).first()[0]
    mu = np.trace(cov) / p
    d2 = (cov**2).sum() / p - mu**2
    b2 = (fourth / n - (cov**2).sum()) / (p * n)
    weight = 0.0 if d2 == 0 else min(max(b2, 0.0), d2) / d2
    return (1 - weight) * cov + weight * mu * np.eye(p), weight


def mahalanobis(df: DataFrame, time: list[str], cols: list[str], out: str = "deviation", weight: float | None = None) -> DataFrame:
    """Distance from the group at each time under the shrunk covariance of all
    complete residuals; incomplete rows are missing. `weight` fixes the
    shrinkage instead of estimating it."""
    d = residuals(df, time, cols)
    res = [f"{c}_res" for c in cols]
    if weight is None:
        cov, _ = shrunk_cov(d, res)
    else:
        _, _, s = moment_matrix(d.dropna(subset=res), res)
        cov = (1 - weight) * s + weight * np.trace(s) / len(cols) * np.eye(len(cols))
    white = np.linalg.cholesky(np.linalg.inv(cov))

    @F.pandas_udf("double")
    def length(rows: pd.Series) -> pd.Series:
        x = np.array([list(r) for r in rows], dtype=float).reshape(len(rows), len(res))
        d = pd.Series(np.sqrt(((x @ white) ** 2).sum(axis=1)))
        return d.where(d.notna(), None)

    return d.withColumn(out, length(F.array(*res))).drop(*res)


def deviation_z(df: DataFrame, subject: list[str], time: list[str], dev: str, factor: str) -> DataFrame:
    """Deviation scaled within subject and within timepoint; factor within subject."""
    d = zscore(df, subject, [dev], 0, suffix="_subject_z")
    d = zscore(d, time, [dev], 0, suffix="_time_z")
    return zscore(d, subject, [factor], 0, suffix="_z")


def label_strict(pc: Column, dev: Column, thr_int: Column | float, thr_ext: Column | float) -> Column:
    ti = thr_int if isinstance(thr_int, Column) else F.lit(float(thr_int))
    te = thr_ext if isinstance(thr_ext, Column) else F.lit(float(thr_ext))
    return (
        F.when(pc.isNull() | dev.isNull(), F.lit(None).cast("string"))
        .when((pc > ti) & (dev > ti), INTERNAL)
        .when((pc < -te) & (dev < -te), EXTERNAL)
        .otherwise(NEUTRAL)
    )


def label_quadrant(pc: Column, dev: Column, z_hi: Column | float, z_lo: Column | float, dev_hi: Column, dev_lo: Column) -> Column:
    zh = z_hi if isinstance(z_hi, Column) else F.lit(float(z_hi))
    zl = z_lo if isinstance(z_lo, Column) else F.lit(float(z_lo))
    return (
        F.when((pc > zh) & (dev > dev_hi), "Internal_HighDeviation")
        .when((pc < -zl) & (dev < dev_lo), "External_LowDeviation")
        .when((pc > zh) & (dev < dev_lo), "Internal_LowDeviation")
        .when((pc < -zl) & (dev > dev_hi), "External_HighDeviation")
        .otherwise(NEUTRAL)
    )


def label_quadrants(df: DataFrame, video: list[str], pc: str, dev: str, z_hi: float, z_lo: float, q_hi: float = 0.7,
                    q_lo: float = 0.4, out: str = "label") -> DataFrame:
    """Five states from the factor's z and per-video quantiles of deviation."""
    d = df.join(percentiles(df, video, dev, {"dev_hi": q_hi, "dev_lo": q_lo}), video, "left")
    return d.withColumn(out, label_quadrant(F.col(pc), F.col(dev), z_hi, z_lo, F.col("dev_hi"), F.col("dev_lo")))


def label_band(df: DataFrame, subject: list[str], time: list[str], factor: str, z_int: float = 1.0, z_ext: float = 0.5) -> DataFrame:
    """Early scheme: internal where the subject's z of the group-demeaned
    factor exceeds z_int, external within z_ext group sd of the group mean."""
    d = with_stats(df, time, {"group_mean": F.avg(factor), "group_sd": F.stddev_samp(factor)})
    d = d.withColumn("demeaned", F.col(factor) - F.col("group_mean"))
    d = zscore(d, subject, ["demeaned"], 1)
    reach = F.lit(float(z_ext)) * F.col("group_sd")
    return d.withColumns({
        "internal": F.col("demeaned_z") > z_int,
        "external": F.col(factor).between(F.col("group_mean") - reach, F.col("group_mean") + reach),
    })


def label_flags(df: DataFrame, pc: str, dev: str, thr_int: float, thr_ext: float) -> DataFrame:
    """0/1 indicators; a missing input counts as 0."""
    hi = (F.col(pc) > thr_int) & (F.col(dev) > thr_int)
    lo = (F.col(pc) < -thr_ext) & (F.col(dev) < -thr_ext)
    return df.withColumns({
        "internal_flag": F.coalesce(hi.cast("int"), F.lit(0)), "external_flag": F.coalesce(lo.cast("int"), F.lit(0))
    })


def sweep(df: DataFrame, video: list[str], pc: str, dev: str, z_his: list[float], z_los: list[float], qs: list[float]) -> DataFrame:
    """State shares under every threshold combination, as one job: each row is
    copied once per combination, then counted map-side. The quantiles q and
    1 - q of all combinations come from one pass."""
    probs = {f"__q{i}{side}": (q if side == "h" else 1 - q) for i, q in enumerate(qs) for side in "hl"}
    d = df.join(percentiles(df, video, dev, probs), video, "left")
    combos = F.array(*[
        F.struct(F.lit(float(zh)).alias("z_hi"), F.lit(float(zl)).alias("z_lo"), F.lit(float(q)).alias("dev_q"),
                 F.col(f"__q{i}h").alias("dev_hi"), F.col(f"__q{i}l").alias("dev_lo"))
        for zh in z_his for zl in z_los for i, q in enumerate(qs)
    ])
    d = d.select(*video, pc, dev, F.explode(combos).alias("__c")).select(*video, pc, dev, "__c.*")
    d = d.withColumn("state", label_quadrant(F.col(pc), F.col(dev), F.col("z_hi"), F.col("z_lo"), F.col("dev_hi"), F.col("dev_lo")))
    return proportions(d, [*video, "z_hi", "z_lo", "dev_q"], "state")


def sweep_labels(df: DataFrame, pc: str, dev: str, thresholds: list[tuple[float, float]]) -> DataFrame:
    """Labels under several threshold pairs, long: thr_int, thr_ext, label."""
    pairs = F.array(*[F.struct(F.lit(float(a)).alias("thr_int"), F.lit(float(b)).alias("thr_ext")) for a, b in thresholds])
    d = df.withColumn("__t", F.explode(pairs)).select(*df.columns, "__t.*")
    return d.withColumn("label", label_strict(F.col(pc), F.col(dev), F.col("thr_int"), F.col("thr_ext")))


def agreement(df: DataFrame, by: list[str], a: str, b: str) -> DataFrame:
    return df.groupBy(*by).agg(F.avg(F.col(a).eqNullSafe(F.col(b)).cast("double")).alias("agreement"))


def align_sign(df: DataFrame, by: list[str], pc: str, ref: str) -> DataFrame:
    """Turn the component round where it correlates positively with ref."""
    d = with_stats(df, by, {"__r": corr_of(pc, ref)})
    return d.withColumn(pc, F.when(F.col("__r") > 0, -F.col(pc)).otherwise(F.col(pc))).drop("__r")


def expand_labels(df: DataFrame, idx: str, k: int, out: str = "short_idx") -> DataFrame:
    """Each long-window label repeated for its k short windows."""
    return df.withColumn(out, F.explode(F.sequence(F.col(idx) * k, F.col(idx) * k + (k - 1))))
