"""Aggregations over groups, states, regions and recordings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegrid.functions.scalars import mmss
from tidegrid.operators.group import percentiles, with_row, with_stats
from tidegrid.operators.series import robust_z
from tidegrid.session import settle


def summary(df: DataFrame, by: list[str], col: str) -> DataFrame:
    """mean, sd, min, max, median, count and mean absolute value."""
    base = df.groupBy(*by).agg(
        F.avg(col).alias("mean"), F.stddev_samp(col).alias("sd"), F.min(col).alias("min"), F.max(col).alias("max"),
        F.count(col).alias("n"), F.avg(F.abs(F.col(col))).alias("abs_mean"),
    )
    return base.join(percentiles(df, by, col, {"median": 0.5}), by, "left").orderBy(*by)


def describe_by(df: DataFrame, by: list[str], col: str) -> DataFrame:
    base = df.groupBy(*by).agg(
        F.count(col).alias("n"), F.avg(col).alias("mean"), F.stddev_samp(col).alias("sd"), F.min(col).alias("min"), F.max(col).alias("max")
    )
    return base.join(percentiles(df, by, col, {"q25": 0.25, "q50": 0.5, "q75": 0.75}), by, "left")


def shape(df: DataFrame, by: list[str], col: str) -> DataFrame:
    """Bias-corrected skewness and excess kurtosis."""
    n = F.col("n").cast("double")
    d = df.groupBy(*by).agg(F.count(col).alias("n"), F.skewness(col).alias("__g1"), F.kurtosis(col).alias("__g2"))
    skew = F.when(n > 2, F.sqrt(n * (n - 1)) / (n - 2) * F.col("__g1"))
    kurt = F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.col("__g2") + 6))
    return d.select(*by, "n", skew.alias("skew"), kurt.alias("kurtosis"))


def label_counts(df: DataFrame, subject: str, label: str, labels: list[str]) -> DataFrame:
    """Rows per subject and label, absent ones 0."""
    return df.groupBy(subject).agg(*[F.count_if(F.col(label) == v).alias(v) for v in labels])


def label_totals(df: DataFrame, subject: str, label: str) -> DataFrame:
    """Rows per label, and that number per subject."""
    # A distinct list first, then a plain count: no set of subjects is held in one buffer.
    n = df.select(subject).distinct().agg(F.count(F.lit(1)).alias("__subjects"))
    tot = df.filter(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("n_rows"))
    return with_row(tot, n).select(label, "n_rows", (F.col("n_rows") / F.col("__subjects")).alias("per_subject"))


def proportions(df: DataFrame, by: list[str], col: str) -> DataFrame:
    """Share of each value, missing counted as a value."""
    n = df.groupBy(*by, col).agg(F.count(F.lit(1)).alias("n"))
    return with_stats(n, by, {"__all": F.sum("n")}).withColumn("proportion", F.col("n") / F.col("__all")).drop("__all")


def crosstab(df: DataFrame, row: str, col: str, values: list[str]) -> DataFrame:
    return df.groupBy(row).pivot(col, values).agg(F.count(F.lit(1))).fillna(0, values)


def mean_sem(df: DataFrame, by: list[str], cols: list[str]) -> DataFrame:
    return df.groupBy(*by).agg(*[
        e for c in cols for e in (
            F.avg(c).alias(f"{c}_mean"), (F.stddev_samp(c) / F.sqrt(F.count(c))).alias(f"{c}_sem"), F.count(c).alias(f"{c}_n")
        )
    ])


def electrode_delta(power: DataFrame, keys: list[str], value: str, label: str, internal: str, external: str,
                    min_n: int = 10) -> DataFrame:
    """Mean power per state and their difference for each electrode with at
    least min_n windows in both states."""
    a = F.when(F.col(label) == internal, F.col(value))
    b = F.when(F.col(label) == external, F.col(value))
    out = power.groupBy(*keys).agg(
        F.avg(a).alias("mean_int"), F.avg(b).alias("mean_ext"), F.count(a).alias("n_int"), F.count(b).alias("n_ext")
    )
    return out.filter((F.col("n_int") >= min_n) & (F.col("n_ext") >= min_n)).withColumn("delta", F.col("mean_int") - F.col("mean_ext"))


def region_delta(elec: DataFrame, keys: list[str]) -> DataFrame:
    """Mean of the electrode means per region."""
    out = elec.groupBy(*keys).agg(
        F.avg("mean_int").alias("mean_int"), F.avg("mean_ext").alias("mean_ext"), F.count(F.lit(1)).alias("n_elec")
    )
    return out.withColumn("delta", F.col("mean_int") - F.col("mean_ext"))


def pooled_stats(power: DataFrame, keys: list[str], value: str, label: str, states: list[str], contact: list[str]) -> DataFrame:
    """Electrode-by-window values pooled per region and state: n, mean, sd,
    sem, and the number of contacts."""
    stats = power.filter(F.col(label).isin(states)).groupBy(*keys, label).agg(
        F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"),
        (F.stddev_samp(value) / F.sqrt(F.count(value))).alias("sem"),
    )
    contacts = power.select(*keys, *contact).distinct().groupBy(*keys).agg(F.count(F.lit(1)).alias("n_contacts"))
    return stats.join(contacts, keys)


def region_series(df: DataFrame, keys: list[str], channel: str, value: str, min_elec: int) -> DataFrame:
    """Mean over electrodes at each time, where at least min_elec of them are
    present. A channel counts once per (keys) row."""
    return df.groupBy(*keys).agg(F.avg(value).alias("mean"), F.count(value).alias("n_elec")).filter(F.col("n_elec") >= min_elec)


def region_spectrogram(tf: DataFrame, series: list[str], at: list[str], value: str, bad: Column) -> DataFrame:
    """Robust z per channel and frequency scaled on good windows, averaged per
    region; bad windows are missing. The windows are stored once, as scaling reads
    them several times."""
    tf = settle(tf, "power")
    z = robust_z(tf, series, value, "__z", ref=~bad, zero="one")
    return z.groupBy(*at).agg(F.avg(F.when(~bad, F.col("__z"))).alias("mean_z"))


def state_spectra(df: DataFrame, run: str, at: list[str], value: str, label: str, internal: str, external: str) -> DataFrame:
    """Mean per state in each run, then over runs, and the difference."""
    per = df.groupBy(run, *at).agg(
        F.avg(F.when(F.col(label) == internal, F.col(value))).alias("int"), F.avg(F.when(F.col(label) == external, F.col(value))).alias("ext")
    )
    per = per.withColumn("diff", F.col("int") - F.col("ext"))
    return per.groupBy(*at).agg(*[F.avg(c).alias(c) for c in ("int", "ext", "diff")], F.count("diff").alias("n_runs"))


def matrix(df: DataFrame, row: str, col: str, value: str, cols: list[str], order: DataFrame | None = None) -> DataFrame:
    """Rows by columns, one cell each; with an order table (row, ordinal) the
    rows follow it."""
    out = df.groupBy(row).pivot(col, cols).agg(F.first(value))
    return out.join(order, row).orderBy("ordinal") if order is not None else out


def contact_counts(meta: DataFrame, by: list[str], region: str) -> DataFrame:
    return meta.groupBy(*by, region).agg(F.count(F.lit(1)).alias("n_contacts"))


def pair_counts(counts: DataFrame, by: list[str], region: str) -> DataFrame:
    """Correlations per region pair: n(n-1)/2 inside a region, n*m between.
    The rows met are regions of an atlas, a fixed short list per recording."""
    a = counts.select(*by, F.col(region).alias("region_a"), F.col("n_contacts").alias("__n"))
    b = counts.select(*by, F.col(region).alias("region_b"), F.col("n_contacts").alias("__m"))
    met = a.join(b, by).filter(F.col("region_a") <= F.col("region_b"))
    n = F.when(F.col("region_a") == F.col("region_b"), F.col("__n") * (F.col("__n") - 1) / 2).otherwise(F.col("__n") * F.col("__m"))
    return met.select(*by, "region_a", "region_b", n.cast("long").alias("n_pairs"))


def over_subjects(counts: DataFrame, by: list[str], n: str) -> DataFrame:
    """Mean, least, most and sd of a count over the subjects that have it, and
    how many do; `by` names the region, or both of a pair."""
    v = F.col(n)
    return counts.where(v.isNotNull()).groupBy(*by).agg(
        F.avg(v).alias("mean"), F.min(v).alias("min"), F.max(v).alias("max"), F.stddev_samp(v).alias("sd"), F.count(v).alias("n_subjects"))


def recording_descriptives(df: DataFrame, keys: list[str], cols: list[str], medians: bool = True) -> DataFrame:
    """Count, sum, mean, sd and median of several columns in one row. The medians
    of all columns come from one chain over (key, column)."""
    base = df.groupBy(*keys).agg(*[
        e for c in cols for e in (
            F.count(c).alias(f"n_{c}"), F.sum(c).alias(f"sum_{c}"), F.avg(c).alias(f"mean_{c}"), F.stddev_pop(c).alias(f"std_{c}")
        )
    ])
    if medians:
        cells = F.explode(F.array(*[F.struct(F.lit(i).alias("__col"), F.col(c).cast("double").alias("__v")) for i, c in enumerate(cols)])).alias("__cell")
        mid = percentiles(df.select(*keys, cells).select(*keys, "__cell.*"), [*keys, "__col"], "__v", {"__median": 0.5})
        mid = mid.groupBy(*keys).agg(*[F.max(F.when(F.col("__col") == i, F.col("__median"))).alias(f"median_{c}") for i, c in enumerate(cols)])
        base = base.join(mid, keys, "left")
    return base


def state_density(df: DataFrame, time: str, subject: str, label: str, states: list[str]) -> DataFrame:
    """Share of subjects in each state at each time (one row per subject and time)."""
    return df.groupBy(time).agg(
        *[(F.count_if(F.col(label) == s) / F.count(F.lit(1))).alias(s) for s in states], F.count(F.lit(1)).alias("n_subjects")
    )


def crossings(df: DataFrame, time: str, measures: list[str], hi: float, lo: float, seconds: float) -> DataFrame:
    """Times at which a group mean lies above hi or below -lo."""
    means = df.groupBy(time).agg(*[F.avg(m).alias(m) for m in measures])
    long = means.unpivot([time], measures, "measure", "mean_value")
    kind = F.when(F.col("mean_value") > hi, f"Above {hi}").when(F.col("mean_value") < -lo, f"Below -{lo}")
    return long.withColumn("threshold", kind).filter(F.col("threshold").isNotNull()).withColumn(
        "movie_time", mmss(F.col(time) * F.lit(float(seconds)))
    )


def coverage_summary(df: DataFrame, by: list[str], flags: list[str]) -> DataFrame:
    return df.groupBy(*by).agg(*[F.count_if(f).alias(f) for f in flags], F.count(F.lit(1)).alias("n_recordings"))


def rule_gaps(df: DataFrame, rule: str, actual: str) -> DataFrame:
    """Included despite failing the rule; passing it but not included."""
    return df.agg(
        F.count_if(F.col(actual) & (F.col(rule) == F.lit(False))).alias("included_but_failing"),
        F.count_if(~F.col(actual) & (F.col(rule) == F.lit(True))).alias("passing_not_included"),
    )


def distinct_clean(df: DataFrame, col: str) -> DataFrame:
    v = F.trim(F.col(col))
    return df.select(v.alias(col)).filter(~F.col(col).isin("", "nan", "None")).distinct().orderBy(col)


def run_log(df: DataFrame, keys: list[str], expected: DataFrame, entry: str) -> DataFrame:
    """Loaded or missing, rows and entries of every expected input."""
    rows = df.groupBy(*keys, entry).agg(F.count(F.lit(1)).alias("__n")).groupBy(*keys).agg(
        F.sum("__n").alias("n_rows"), F.count(F.lit(1)).alias("n_entries")
    )
    out = expected.join(rows, keys, "left").fillna(0, ["n_rows", "n_entries"])
    return out.withColumn("status", F.when(F.col("n_rows") > 0, "loaded").otherwise("missing"))
