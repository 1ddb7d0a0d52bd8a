"""Sliding windows over sample indices and seconds."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegrid.operators.group import with_stats
from tidegrid.operators.scan import cut, cut_dense, framed, scan


def assign_windows(df: DataFrame, idx: str, size: int, step: int, first: int = 0) -> DataFrame:
    """Each sample once per window [first + k*step, first + k*step + size)
    holding it, k >= 0. Windows cut off by the end of the series are told
    apart later by their row count."""
    i = F.col(idx) - F.lit(first)
    lo = F.greatest(F.ceil((i - (size - 1)) / F.lit(step)), F.lit(0))
    hi = F.floor(i / F.lit(step))
    return df.withColumn("window_idx", F.explode(F.when(lo <= hi, F.sequence(lo.cast("long"), hi.cast("long")))))


def center_of(step: int, short: int, long: int) -> int:
    """First sample of the long window centred on short window 0."""
    return short // 2 - long // 2


def assign_centered(df: DataFrame, idx: str, short: int, long: int, step: int) -> DataFrame:
    """Long windows centred on the short windows' centres, under the short
    windows' indices; a window starting before the series has too few rows and
    drops out with the incomplete ones."""
    return assign_windows(df, idx, long, step, first=center_of(step, short, long))


def window_center(size: int, step: int, fs: float = 1.0, first: int = 0) -> Column:
    return (F.col("window_idx") * step + F.lit(first) + F.lit(size) / 2) / F.lit(fs)


def trimmed_mean(values: Column, share: float = 0.2) -> Column:
    """Mean of a collected window after dropping int(share * n) values at each
    end. The array is as long as one window."""
    v = F.array_sort(values)
    cut = F.floor(F.size(v) * F.lit(share)).cast("int")
    kept = F.slice(v, cut + 1, F.size(v) - 2 * cut)
    return F.aggregate(kept, F.lit(0.0), lambda a, b: a + b) / F.size(kept)


Reducer = Callable[[Column], Column]

REDUCERS: dict[str, Reducer] = {
    "mean": F.avg,
    "sd": F.stddev_pop,
    "median": lambda c: F.percentile(c, 0.5),
    "trim20": lambda c: trimmed_mean(F.collect_list(c), 0.2),
}


def window_reduce(windowed: DataFrame, keys: list[str], value: str, size: int,
                  stats: dict[str, str | Reducer], nulls: str = "skip") -> DataFrame:
    """One row per complete window. Each stat is a reducer's name or any
    function from a column to an aggregate column. nulls="zero" counts a
    missing sample as 0."""
    v = F.coalesce(F.col(value), F.lit(0.0)) if nulls == "zero" else F.col(value)
    aggs = [(REDUCERS[f] if isinstance(f, str) else f)(v).alias(n) for n, f in stats.items()]
    out = windowed.groupBy(*keys, "window_idx").agg(F.count(F.lit(1)).alias("__rows"), *aggs)
    return out.filter(F.col("__rows") == size).drop("__rows")


def window_moments(df: DataFrame, keys: list[str], idx: str, value: str, size: int, step: int) -> DataFrame:
    """Mean and sd of each complete window from panes of one step, each pane
    summed once; only pane sums are copied to the size/step windows over them.
    Sums are taken about the series mean, so a large offset costs no digits."""
    if size % step:
        raise ValueError("panes need size to be a multiple of step")
    k = size // step
    mid = with_stats(df, keys, {"__mid": F.avg(value)})
    v = F.col(value) - F.col("__mid")
    panes = mid.groupBy(*keys, "__mid", F.floor(F.col(idx) / step).alias("__pane")).agg(
        F.count(F.lit(1)).alias("__rows"), F.count(v).alias("__n"), F.sum(v).alias("__s"), F.sum(v * v).alias("__ss")
    )
    lo = F.greatest(F.col("__pane") - (k - 1), F.lit(0))
    wins = panes.withColumn("window_idx", F.explode(F.sequence(lo, F.col("__pane")))).groupBy(*keys, "window_idx").agg(
        F.first("__mid").alias("__mid"), *[F.sum(c).alias(c) for c in ("__rows", "__n", "__s", "__ss")]
    )
    n = F.when(F.col("__n") > 0, F.col("__n"))
    dev = F.col("__s") / n
    return wins.filter(F.col("__rows") == size).select(
        *keys, "window_idx", F.col("__n").alias("n"), (F.col("__mid") + dev).alias("mean"),
        F.sqrt(F.greatest(F.col("__ss") / n - dev * dev, F.lit(0.0))).alias("sd"),
    )


def window_means(df: DataFrame, keys: list[str], idx: str, value: str, size: int, step: int) -> DataFrame:
    """Mean of each complete window, its values added one by one in index order,
    as a plain sum rounds it. Pane sums (window_moments) differ from that in the
    last digit, which decides whether the spread of few, equal windows is zero.
    Samples are copied to the windows over them; a row holds one window."""
    w = assign_windows(df.select(*keys, idx, F.col(value).cast("double").alias("__v")), idx, size, step)
    w = w.groupBy(*keys, "window_idx").agg(F.array_sort(F.collect_list(F.struct(idx, "__v"))).alias("__s")).filter(F.size("__s") == size)
    known = F.filter(F.col("__s.__v"), lambda v: v.isNotNull())
    total = F.aggregate(known, F.lit(0.0), lambda a, v: a + v)
    return w.select(*keys, "window_idx", (total / F.when(F.size(known) > 0, F.size(known))).alias("mean"))


def grid(df: DataFrame, keys: list[str], idx: str, size: int, step: int) -> DataFrame:
    """The complete windows of each series, one row per window."""
    n = df.groupBy(*keys).agg((F.max(idx) + 1).alias("__n")).filter(F.col("__n") >= size)
    k = F.floor((F.col("__n") - size) / F.lit(step)).cast("long")
    return n.select(*keys, F.explode(F.sequence(F.lit(0).cast("long"), k)).alias("window_idx"))


def window_counts(events_windowed: DataFrame, grid_: DataFrame, keys: list[str], seconds: float) -> DataFrame:
    """Events and events per second of every grid window; empty ones are 0."""
    n = events_windowed.groupBy(*keys, "window_idx").agg(F.count(F.lit(1)).alias("n_events"))
    out = grid_.join(n, [*keys, "window_idx"], "left").fillna(0, ["n_events"])
    return out.withColumn("rate", F.col("n_events") / F.lit(seconds))


def window_marks(events_windowed: DataFrame, grid_: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Mean and sd of event values per grid window; empty ones are missing."""
    m = events_windowed.groupBy(*keys, "window_idx").agg(
        F.avg(value).alias("mark_mean"), F.stddev_pop(value).alias("mark_sd")
    )
    return grid_.join(m, [*keys, "window_idx"], "left")


def fill_empty(df: DataFrame, keys: list[str], value: str, policy: str = "ffill", idx: str = "window_idx") -> DataFrame:
    """Empty windows: "ffill" (0 before the first), "zero" or "missing"."""
    if policy == "missing":
        return df
    if policy == "zero":
        return df.fillna(0.0, [value])
    out = scan(cut_dense(df, keys, idx), last={"__v": F.col(value)})
    return out.withColumn(value, F.coalesce("__v", F.lit(0.0))).drop("__v")


def conform_grid(df: DataFrame, keys: list[str], value: str, target: int, idx: str = "window_idx") -> DataFrame:
    """Exactly `target` windows per series: one too many drops the last, too
    few are stretched by linear interpolation, more is an error. Output is
    (keys, idx, value); each source window feeds the output positions between
    it and the next, so no series is gathered."""
    d = with_stats(df.select(*keys, idx, value), keys, {"__n": F.count(F.lit(1))})
    d = d.withColumn("__n", F.when(F.col("__n") > target + 1, F.raise_error(F.lit("more windows than the grid allows")).cast("long")).otherwise(F.col("__n")))
    short = F.col("__n") < target
    near = framed(d, keys, idx, 0, 1, lambda w: {"__next": F.last(value).over(w)})
    # Output j sits at source position j * (n - 1) / (target - 1).
    gap = F.greatest(F.col("__n") - 1, F.lit(1))
    first = F.when(F.col("__n") == 1, F.lit(0)).otherwise(F.ceil(F.col(idx) * (target - 1) / gap))
    until = F.when(F.col(idx) >= F.col("__n") - 1, F.lit(target - 1)).otherwise(
        F.ceil((F.col(idx) + 1) * (target - 1) / gap) - 1
    )
    spots = F.when(short, F.when(first <= until, F.sequence(first.cast("long"), until.cast("long")))).otherwise(
        F.when(F.col(idx) < target, F.array(F.col(idx).cast("long")))
    )
    out = near.withColumn("__j", F.explode(spots))
    part = F.when(short, F.col("__j") * gap / F.lit(target - 1) - F.col(idx)).otherwise(F.lit(0.0))
    lerp = F.when(part == 0, F.col(value)).otherwise(F.col(value) + (F.col("__next") - F.col(value)) * part)
    return out.select(*keys, F.col("__j").alias(idx), lerp.alias(value))


def scaled_grid(df: DataFrame, keys: list[str], idx: str, value: str, target: int) -> DataFrame:
    """A second clock cut to the first one's grid: step = int(n / (target + 1)),
    window = int(2 * n / (target + 1)), the last clipped."""
    d = with_stats(df, keys, {"__n": (F.max(idx) + 1)})
    step = F.floor(F.col("__n") / (target + 1)).cast("long")
    size = F.floor(2 * F.col("__n") / (target + 1)).cast("long")
    d = d.withColumns({"__step": step, "__size": size}).filter("__step > 0")
    lo = F.greatest(F.floor((F.col(idx) - F.col("__size")) / F.col("__step")) + 1, F.lit(0))
    hi = F.least(F.floor(F.col(idx) / F.col("__step")), F.lit(target - 1))
    d = d.withColumn("window_idx", F.explode(F.when(lo <= hi, F.sequence(lo.cast("long"), hi.cast("long")))))
    return d.groupBy(*keys, "window_idx").agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("sd"))


def tumbling(df: DataFrame, keys: list[str], t: str, seconds: float, aggs: dict[str, Column]) -> DataFrame:
    """Non-overlapping epochs with their start and end."""
    out = df.groupBy(*keys, F.floor(F.col(t) / seconds).alias("epoch_idx")).agg(*[c.alias(n) for n, c in aggs.items()])
    return out.withColumns({"start_sec": F.col("epoch_idx") * F.lit(float(seconds)), "end_sec": (F.col("epoch_idx") + 1) * F.lit(float(seconds))})


def bad_share(bins: DataFrame, keys: list[str], bin_idx: str, bad: Column, grid_: DataFrame, bin_sec: float,
              size: float, step: float) -> DataFrame:
    """Bad seconds and bad fraction of each window; a recording without any
    quality bins is missing, not 0. Bins reach their windows by arithmetic."""
    s = F.col(bin_idx) * F.lit(float(bin_sec))
    e = s + F.lit(float(bin_sec))
    lo = F.greatest(F.floor((s - size) / step) + 1, F.lit(0))
    hi = F.ceil(e / step) - 1
    hit = bins.filter(bad).withColumns({"__s": s, "__e": e}).withColumn(
        "window_idx", F.explode(F.when(lo <= hi, F.sequence(lo.cast("long"), hi.cast("long"))))
    )
    w0 = F.col("window_idx") * F.lit(float(step))
    sums = hit.groupBy(*keys, "window_idx").agg(
        F.sum(F.greatest(F.lit(0.0), F.least("__e", w0 + size) - F.greatest("__s", w0))).alias("bad_sec")
    )
    known = bins.select(*keys).distinct().withColumn("__known", F.lit(True))
    out = grid_.join(sums, [*keys, "window_idx"], "left").join(known, keys, "left")
    out = out.withColumn("bad_sec", F.when(F.col("__known"), F.coalesce("bad_sec", F.lit(0.0))))
    return out.withColumn("frac_bad", F.col("bad_sec") / F.lit(float(size))).drop("__known")


def pad_mask(df: DataFrame, keys: list[str], idx: str, mask: str, k: int, out: str) -> DataFrame:
    """True within k bins of a true bin."""
    return framed(df, keys, idx, k, k, lambda w: {out: F.max(mask).over(w)})


def interval_contrast(df: DataFrame, keys: list[str], t: str, value: str, base: tuple[float, float],
                      target: tuple[float, float]) -> DataFrame:
    """Target against baseline interval: means, difference, percent and z-like change."""
    def within(span):
        return F.when((F.col(t) >= span[0]) & (F.col(t) < span[1]), F.col(value))

    out = df.groupBy(*keys).agg(
        F.avg(within(base)).alias("base_mean"), F.avg(within(target)).alias("target_mean"),
        (F.stddev_pop(within(base)) + 1e-12).alias("__sd"),
    )
    diff = F.col("target_mean") - F.col("base_mean")
    return out.withColumns({
        "diff": diff,
        "pct_change": diff / (F.abs("base_mean") + 1e-12) * 100.0,
        "z_like": diff / F.col("__sd"),
    }).drop("__sd")


def rolling_mean(df: DataFrame, keys: list[str], idx: str, value: str, size: int, min_periods: int, out: str,
                 every: int | None = None) -> DataFrame:
    """Centred rolling mean, missing below min_periods values, optionally kept
    only at every n-th sample."""
    def cols(w):
        return {out: F.when(F.count(value).over(w) >= min_periods, F.avg(value).over(w))}

    res = framed(df, keys, idx, size // 2, (size - 1) // 2, cols)
    return res.filter(F.pmod(F.col(idx), F.lit(every)) == 0) if every else res


def rolling_median(df: DataFrame, keys: list[str], idx: str, value: str, size: int, out: str, edge: str = "shrink") -> DataFrame:
    """Centred rolling median of an odd number of samples. At the ends the
    window shrinks, or counts zeros outside the series (edge="zero")."""
    if size % 2 == 0:
        raise ValueError("median window must be odd")
    k = size // 2
    if edge == "shrink":
        return framed(df, keys, idx, k, k, lambda w: {out: F.percentile(value, 0.5).over(w)})

    def cols(w):
        seen = F.collect_list(value).over(w)
        return {out: F.array_sort(F.concat(seen, F.array_repeat(F.lit(0.0), F.lit(size) - F.size(seen))))[k]}

    return framed(df, keys, idx, k, k, cols)


def center_on_group(df: DataFrame, by: list[str], cols: list[str]) -> DataFrame:
    """Group mean and sd of each column at each time, and the deviation."""
    out = with_stats(df, by, {f"{c}_{s}": f(c) for c in cols for s, f in (("gmean", F.avg), ("gsd", F.stddev_samp))})
    return out.withColumns({f"{c}_dev": F.col(c) - F.col(f"{c}_gmean") for c in cols})


def epoch_fates(signal: DataFrame, events: DataFrame, by: list[str], idx: str, onset: str, event_id: str, fs: float,
                tmin: float, tmax: float, bad: DataFrame | None = None) -> DataFrame:
    """by, event_id, __at (the event's sample) and fate of each event: 'short' if
    the epoch from tmin to tmax does not fit whole in the recording, 'bad' if it
    meets a span of `bad` (by, start, end in seconds, the end excluded),
    otherwise 'kept'. An event without a time or recording is short.

    Spans are met without pairs: those that begin up to the epoch's end, less
    those that are over at its begin, from running counts."""
    at = F.round(F.col(onset) * F.lit(float(fs))).cast("long")
    a, b = round(tmin * fs), round(tmax * fs)
    n = signal.groupBy(*by).agg((F.max(idx) + 1).alias("__n"))
    d = events.select(*by, event_id, at.alias("__at")).join(n, by, "left")
    fits = F.coalesce((F.col("__at") + a >= 0) & (F.col("__at") + b < F.col("__n")), F.lit(False))
    d = d.withColumn("fate", F.when(fits, "kept").otherwise("short")).drop("__n")
    if bad is None:
        return d

    def marks(df: DataFrame, x: Column, side: int, id_: Column) -> DataFrame:
        return df.select(*by, x.cast("double").alias("__x"), F.lit(side).alias("__side"), id_.alias("__id"))

    spans, kept, who, nobody = bad.where(F.col("start") < F.col("end")), d.where("fate = 'kept'"), F.col(event_id), F.lit(None).cast(dict(events.dtypes)[event_id])
    both = marks(spans, F.col("start"), 0, nobody).unionAll(marks(spans, F.col("end"), 1, nobody)).unionAll(
        marks(kept, (F.col("__at") + a) / F.lit(float(fs)), 2, who)).unionAll(marks(kept, (F.col("__at") + b) / F.lit(float(fs)), 3, who))
    seen = scan(cut(both, by, ["__x", "__side", "__id"]), total={
        "__begun": (F.col("__side") == 0).cast("long"), "__over": (F.col("__side") == 1).cast("long")}).where("__side > 1")
    met = seen.groupBy(*by, F.col("__id").alias(event_id)).agg(
        (F.max(F.when(F.col("__side") == 3, F.col("__begun"))) - F.max(F.when(F.col("__side") == 2, F.col("__over"))) > 0).alias("__met"))
    fate = F.when((F.col("fate") == "kept") & F.coalesce("__met", F.lit(False)), "bad").otherwise(F.col("fate"))
    return d.join(met, [*by, event_id], "left").select(*by, event_id, "__at", fate.alias("fate"))


def epochs(signal: DataFrame, events: DataFrame, by: list[str], idx: str, onset: str, event_id: str, fs: float,
           tmin: float, tmax: float, bad: DataFrame | None = None) -> DataFrame:
    """Samples from tmin to tmax around each event, ends included. Events
    whose epoch does not fit whole in the recording, or meets a span of `bad`,
    are left out (see epoch_fates; epoch_report counts them)."""
    a, b = round(tmin * fs), round(tmax * fs)
    kept = epoch_fates(signal, events, by, idx, onset, event_id, fs, tmin, tmax, bad).where("fate = 'kept'")
    picks = kept.select(*by, event_id, "__at", F.explode(F.sequence(F.col("__at") + a, F.col("__at") + b)).alias(idx))
    return picks.join(signal, [*by, idx]).withColumn("offset", F.col(idx) - F.col("__at")).drop("__at")


def epoch_report(fates: DataFrame, by: list[str]) -> DataFrame:
    """Per recording: events, epochs kept, and those dropped by reason."""
    return fates.groupBy(*by).agg(F.count(F.lit(1)).alias("n_events"), *[
        F.count_if(F.col("fate") == f).alias(f"n_{f}") for f in ("kept", "short", "bad")])


def label_pulses(df: DataFrame, keys: list[str], t: str, tie: str, gap: float, start_at: DataFrame | None = None) -> DataFrame:
    """First pulse 'start', last 'end', a pulse more than `gap` after the one
    before 'probe_onset' (from `start_at`.min_time on, where given)."""
    here = F.struct(F.col(t).alias("t"))
    d = scan(cut(df, keys, [t, tie]), last_before={"__p": here}, first_after={"__n": here})
    d = d.withColumn("gap_before", F.col(t) - F.col("__p.t"))
    probe = F.col("gap_before") > gap
    if start_at is not None:
        d = d.join(start_at.select(*keys, "min_time"), keys, "left")
        probe = probe & (F.col("min_time").isNull() | (F.col(t) >= F.col("min_time")))
    label = (
        F.when(F.col("__n").isNull(), "end").when(F.col("__p").isNull(), "start").when(probe, "probe_onset").otherwise("other")
    )
    return d.withColumn("label", label).drop("__p", "__n", "min_time")
