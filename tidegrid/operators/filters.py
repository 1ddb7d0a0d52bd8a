"""Row selection: usable channels, validity, intervals, minimum evidence."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegrid.functions.scalars import unit_hash
from tidegrid.operators.chains import leap
from tidegrid.operators.group import with_stats
from tidegrid.operators.scan import cut, scan


def usable_channels(signal: DataFrame, meta: DataFrame, bad: DataFrame, *, keys: list[str], channel: str,
                    value: str, min_sd: float = 1e-6) -> DataFrame:
    """Channels named in the sheet, not listed as bad, and not flat."""
    kept = signal.join(bad.select(channel).distinct(), channel, "left_anti").join(
        meta.select(channel).distinct(), channel, "left_semi"
    )
    alive = kept.groupBy(*keys).agg(F.stddev_pop(value).alias("__sd")).filter(F.col("__sd") > min_sd)
    return kept.join(alive.select(*keys), keys, "left_semi")


def keep_regions(df: DataFrame, region: str, excluded: list[str]) -> DataFrame:
    """Drop excluded and unlabelled regions."""
    name = F.trim(F.col(region))
    return df.filter(F.col(region).isNotNull() & (name != "") & ~F.lower(name).isin("nan", "none") & ~name.isin(excluded))


def clean_xy(df: DataFrame, x: str, y: str, valid: Column, lo: float = -0.25, hi: float = 1.25,
             flag: str = "valid") -> DataFrame:
    """Positions of invalid or out-of-bounds samples become missing."""
    inside = F.coalesce(valid & F.col(x).between(lo, hi) & F.col(y).between(lo, hi), F.lit(False))
    df = df.withColumn(flag, inside)
    return df.withColumns({c: F.when(F.col(flag), F.col(c)) for c in (x, y)})


def crop_rezero(df: DataFrame, bounds: DataFrame, keys: list[str], t: str, start: str = "start", end: str = "end") -> DataFrame:
    """Rows strictly inside the stimulus, time counted from the first kept row."""
    inside = df.join(bounds.select(*keys, start, end), keys).filter((F.col(t) > F.col(start)) & (F.col(t) < F.col(end)))
    return with_stats(inside, keys, {"__t0": F.min(t)}).withColumn(t, F.col(t) - F.col("__t0")).drop("__t0", start, end)


def peak_flags(bandwidth: Column, freq: Column, lo: Column, hi: Column, max_bw: float = 10.0, edge: float = 1.0) -> dict[str, Column]:
    return {
        "at_bandwidth_ceiling": bandwidth >= max_bw - 1e-6,
        "near_fit_edge": (freq <= lo + edge) | (freq >= hi - edge),
    }


def filter_peaks(df: DataFrame, bandwidth: str, freq: str, lo: Column, hi: Column, max_bw: float = 10.0,
                 edge: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """Peaks not at the bandwidth ceiling nor at the fit's edge, and the counts dropped."""
    flags = peak_flags(F.col(bandwidth), F.col(freq), lo, hi, max_bw, edge)
    drop = reduce(lambda a, b: a | b, flags.values())
    report = df.agg(
        *[F.count_if(c).alias(n) for n, c in flags.items()],
        F.count_if(~drop).alias("kept"),
        (F.count_if(drop) * 100.0 / F.greatest(F.count(F.lit(1)), F.lit(1))).alias("dropped_pct"),
    )
    return df.filter(~drop), report


def having_min(df: DataFrame, keys: list[str], minima: dict[str, tuple[Column, int]]) -> DataFrame:
    """Rows of groups whose counts reach every minimum. Each entry is
    name -> (column counted where non-null, minimum)."""
    counts = df.groupBy(*keys).agg(*[F.count(c).alias(n) for n, (c, _) in minima.items()])
    enough = reduce(lambda a, b: a & b, [F.col(n) >= m for n, (_, m) in minima.items()])
    return df.join(counts.filter(enough).select(*keys), keys, "left_semi")


def debounce(df: DataFrame, keys: list[str], t: str, gap: float, tie: str, rows: int | None = None) -> DataFrame:
    """Keep an event only if it comes at least `gap` after the last kept one."""
    if gap <= 0:
        return df.filter(F.col(t).isNotNull())
    return leap(cut(df.filter(F.col(t).isNotNull()), keys, [t, tie], rows), t, gap)


def stride(df: DataFrame, idx: str, k: int, offset: int = 0) -> DataFrame:
    """Every k-th window or sample."""
    return df.filter(F.pmod(F.col(idx) - F.lit(offset), F.lit(k)) == 0)


def sample_even(df: DataFrame, keys: list[str], order: list[str], n: int) -> DataFrame:
    """n rows per series spread evenly from first to last (all if fewer):
    pick j sits at position floor(j * (count - 1) / (n - 1))."""
    df = scan(cut(df, keys, order), total={"__pos": F.lit(1).cast("long")})
    df = with_stats(df, keys, {"__n": F.count(F.lit(1))}).withColumn("__pos", F.col("__pos") - 1)
    j = F.ceil(F.col("__pos") * (n - 1) / F.greatest(F.col("__n") - 1, F.lit(1)))
    hit = (F.floor(j * (F.col("__n") - 1) / F.lit(n - 1)) == F.col("__pos")) & (j <= n - 1)
    return df.filter((F.col("__n") <= n) | hit).drop("__pos", "__n")


def sample_random(df: DataFrame, keys: list[str], entity: str, n: int, seed: int) -> DataFrame:
    """All rows of n entities per key (all if fewer), picked by a seeded hash:
    the same in every run, whatever the order of the rows."""
    one = df.select(*keys, entity).distinct().withColumn("__h", unit_hash(F.lit(seed), *[F.col(k) for k in keys], F.col(entity)))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy("__h", entity))
    picked = one.withColumn("__r", rank).where(F.col("__r") <= n).drop("__h", "__r")
    return df.join(picked, [*keys, entity])


def flag_implausible(df: DataFrame, keys: list[str], velocity: str, vmax: float = 1000.0) -> DataFrame:
    """Per key: events, events faster than vmax, fastest velocity."""
    v = F.col(velocity)
    return df.groupBy(*keys).agg(
        F.count(v).alias("n_events"), F.count_if(v > vmax).alias("n_implausible"), F.max(v).alias("max_velocity")
    )


