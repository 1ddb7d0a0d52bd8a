"""From peaks per window to oscillation events."""

from __future__ import annotations

import heapq

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegrid.functions.scalars import assign_band
from tidegrid.operators.group import percentiles, with_stats
from tidegrid.operators.scan import Cut, cut_dense, fold, framed, scan, short, whole
from tidegrid.session import settle


def skeleton(peaks: DataFrame, keys: list[str], carried: list[str], order: str | list[str], kept: Column) -> DataFrame:
    """One row per window: the first non-null value of each carried column in
    peak order, and the number of kept peaks. `order` may name several columns;
    among peaks equal in all of them the smallest value counts as first."""
    order = [order] if isinstance(order, str) else order
    first = [F.min_by(c, F.when(F.col(c).isNotNull(), F.struct(*order, c))).alias(c) for c in carried]
    return peaks.groupBy(*keys).agg(*first, F.count_if(kept).alias("n_peaks_total"))


def peaks_to_timeseries(peaks: DataFrame, keys: list[str], freq: str, amp: str, width: str | None, order: str,
                        bands: dict[str, tuple[float, float]], kept: Column | None = None,
                        carried: list[str] | None = None) -> DataFrame:
    """One row per window: per band the largest kept peak (centre, amplitude,
    width; missing if none) and the count. One shuffle, no join per band.
    Without `width` there are no widths, and none is moved."""
    ok = F.coalesce(kept if kept is not None else F.lit(True), F.lit(False))
    d = peaks.withColumn("__band", F.when(ok, assign_band(F.col(freq), bands)))
    best = F.struct(F.col(amp).alias("a"), (-F.col(order)).alias("o"), F.col(freq).alias("f"), *([F.col(width).alias("w")] if width else []))
    aggs = [F.min_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in (carried or [])]
    aggs.append(F.count("__band").alias("n_peaks_total"))
    for b in bands:
        mine = F.col("__band") == b
        aggs += [F.max(F.when(mine, best)).alias(f"__{b}"), F.count_if(mine).alias(f"{b}_n")]
    d = d.groupBy(*keys).agg(*aggs)
    return d.select(*keys, *(carried or []), "n_peaks_total", *[
        c for b in bands for c in (
            F.col(f"__{b}.f").alias(f"{b}_cf"), F.col(f"__{b}.a").alias(f"{b}_amp"),
            *([F.col(f"__{b}.w").alias(f"{b}_bw")] if width else []), F.col(f"{b}_n"),
        )
    ])


def runs(present: DataFrame, keys: list[str], idx: str, max_gap: int = 1, single: bool = False) -> DataFrame:
    """Number rows into runs whose index gaps hold at most max_gap missing
    windows; run_id is the first index of the run. `single`: every series is one
    piece, and its rows leave in one partition."""
    i = F.col(idx).cast("long")
    if single:
        c = whole(present.filter(F.col(idx).isNotNull()), keys, idx)
        before = F.lag(i).over(c.window())
        c = Cut(c.df.withColumn("__start", F.when(before.isNull() | (i - before > max_gap + 1), i)), c.keys, c.order, True)
    else:
        near = framed(present, keys, idx, max_gap + 1, 0, lambda w: {"__near": F.count(idx).over(w.rangeBetween(-max_gap - 1, -1))})
        c = cut_dense(near.withColumn("__start", F.when(F.col("__near") == 0, i)).drop("__near"), keys, idx)
    return scan(c, last={"run_id": F.col("__start")}).drop("__start")


def split_on_drift(df: DataFrame, keys: list[str], idx: str, freq: str, tol: float = 2.0, compat: bool = False,
                   rows: int | None = None, running: tuple[str, str] | None = None, placed: bool = False) -> DataFrame:
    """Split a run where the frequency leaves the running median of the current
    event (the value itself included) by more than tol. Adds event_id, the
    first index of the event. compat=True drops a run's last window when it
    opens an event of its own.

    `keys` includes run_id. A long run is cut into pieces of windows; what
    passes from one to the next is the open event's frequencies in two halves.
    `running` names two more columns, the event's median up to the row and the
    row's place in the event, from 1. `placed`: no run is longer than a piece
    and each is in one partition already.
    """

    def walk(cols, opens, start=None, event=None):
        # An event of one value has no Median yet; many never get one. NaN
        # departs from anything, as in SQL, and is an event of its own.
        n, one = (event.count(), event.value()) if event else (0, None)
        ids, mids, places = [], [], []
        for i, f, first in zip(cols[idx].tolist(), cols[freq].tolist(), opens.tolist()):
            if first or n == 0:
                split = True
            elif n == 1:
                mid = (one + f) / 2.0
                split = not abs(f - mid) <= tol
                if not split:
                    event = Median([min(one, f)], [max(one, f)])
            else:
                event.add(f)
                mid = event.value()
                split = not abs(f - mid) <= tol
            if split:
                start, event, n, one, mid = i, None, 1, f, f
            else:
                n += 1
            ids.append(start)
            mids.append(mid)
            places.append(n)
        return ids, mids, places, start, event or Median([] if one is None else [one], [])

    def columns(ids, mids, places):
        return {"event_id": ids} | (dict(zip(running, (mids, places))) if running else {})

    def kernel(cols, carry):
        none = np.zeros(len(cols[idx]), dtype=bool)
        *cells, start, event = walk(cols, none, *((carry[0], Median(carry[1], carry[2])) if carry else ()))
        return np.arange(len(none)), columns(*cells), [start, event.below(), event.above()]

    def fresh(cols, opens):
        return columns(*walk(cols, opens)[:3])

    c = whole(df, keys, idx, True) if placed else cut_dense(df, keys, idx, rows)
    extra = {"event_id": "bigint"} | (dict(zip(running, ("double", "bigint"))) if running else {})
    out = fold(c, kernel, [idx, freq], extra, fresh)
    if not compat:
        return out
    out = with_stats(out, keys, {"__last": F.max(idx), "__first": F.min(idx)})
    lone = (F.col(idx) == F.col("__last")) & (F.col("event_id") == F.col(idx)) & (F.col("__first") != F.col("__last"))
    return out.filter(~lone).drop("__last", "__first")


class Median:
    """The running median of added values, in O(log n) each: the lower half as a
    heap of negated values, the upper half as a heap; the lower has as many or
    one more."""

    def __init__(self, below: list[float] | None = None, above: list[float] | None = None):
        # Sorted lists are heaps.
        self.low, self.high = [-x for x in reversed(below or [])], list(above or [])

    def add(self, x: float) -> None:
        if self.low and x > -self.low[0]:
            heapq.heappush(self.high, x)
        else:
            heapq.heappush(self.low, -x)
        if len(self.low) > len(self.high) + 1:
            heapq.heappush(self.high, -heapq.heappop(self.low))
        elif len(self.high) > len(self.low):
            heapq.heappush(self.low, -heapq.heappop(self.high))

    def value(self) -> float:
        return -self.low[0] if len(self.low) > len(self.high) else (self.high[0] - self.low[0]) / 2.0

    def count(self) -> int:
        return len(self.low) + len(self.high)

    def below(self) -> list[float]:
        return sorted(-x for x in self.low)

    def above(self) -> list[float]:
        return sorted(self.high)


def events_from_runs(df: DataFrame, keys: list[str], run: str, idx: str, freq: str, amp: str, exponent: str,
                     ends: DataFrame | None, step: float = 2.5, window: float = 10.0, running: tuple[str, str] | None = None) -> DataFrame:
    """Event rows with onset and offset brackets. `ends` has the first and last
    window index of each series (first_idx, last_idx), or is None where the rows
    have them. A run touching an end has the whole window there as its bracket,
    otherwise one step. `running`: columns with the run's median up to a row and
    the row's place, whose last value is the median; without them it is counted."""
    own = [] if ends is not None else [F.min(c).alias(c) for c in ("first_idx", "last_idx")]
    e = df.groupBy(*keys, run).agg(
        F.min(idx).alias("__a"), F.max(idx).alias("__b"), F.count(F.lit(1)).alias("n_windows"),
        F.min(freq).alias("cf_min"), F.max(freq).alias("cf_max"),
        F.max(amp).alias("amp_max"), F.avg(amp).alias("amp_mean"), F.avg(exponent).alias("exponent_mean"),
        *own, *([F.max_by(*running).alias("cf_median")] if running else []),
    )
    if not running:
        e = e.join(percentiles(df, [*keys, run], freq, {"cf_median": 0.5}), [*keys, run])
    if ends is not None:
        e = e.join(ends, keys)
    s0, s1 = F.col("__a") * F.lit(step), F.col("__b") * F.lit(step)
    e0, e1 = s0 + window, s1 + window
    on_lo = F.when(F.col("__a") == F.col("first_idx"), s0).otherwise(e0 - step)
    off_hi = F.when(F.col("__b") == F.col("last_idx"), e1).otherwise(s1 + step)
    d_lo, d_hi = F.greatest(F.lit(0.0), s1 - e0), e1 - s0
    return e.select(
        *keys, on_lo.alias("onset_lo_sec"), e0.alias("onset_hi_sec"), s1.alias("offset_lo_sec"), off_hi.alias("offset_hi_sec"),
        ((on_lo + e0) / 2).alias("onset_sec"), ((s1 + off_hi) / 2).alias("offset_sec"),
        d_lo.alias("duration_lo_sec"), d_hi.alias("duration_hi_sec"), ((d_lo + d_hi) / 2).alias("duration_sec"),
        (s1 - e0 < 0).alias("shorter_than_window"), "n_windows", "cf_median", "cf_min", "cf_max", "amp_max", "amp_mean", "exponent_mean",
    )


def to_events(ts: DataFrame, keys: list[str], idx: str, exponent: str, bands: list[str], carried: list[str] | None = None,
              tol: float = 2.0, max_gap: int = 1, step: float = 2.5, window: float = 10.0, compat: bool = False) -> DataFrame:
    """Window table -> events of every band, all bands in one pass.

    Series of one piece are dealt once, by `keys`: their ends, runs and events
    are all found where they are. Longer ones go piece by piece."""
    carried = carried or []
    i = F.col(idx).cast("long")
    ts = settle(ts.select(*keys, i.alias(idx), exponent, *carried, *[f"{b}_{m}" for b in bands for m in ("cf", "amp")]), "windows")
    single = short(ts, idx)
    marks = {"first_idx": F.min(idx), "last_idx": F.max(idx)}
    own = []
    rows = ts
    if single:
        own = list(marks)
        for k in keys:
            rows = rows.filter(F.col(k).isNotNull())
        rows = rows.repartition(*keys).withColumns({n: v.over(Window.partitionBy(*keys)) for n, v in marks.items()})
    one = F.array(*[
        F.struct(F.lit(b).alias("band"), F.col(f"{b}_cf").alias("cf"), F.col(f"{b}_amp").alias("amp")) for b in bands
    ])
    long = rows.select(*keys, *own, idx, exponent, F.explode(one).alias("__b"))
    long = long.select(*keys, *own, F.col("__b.band").alias("band"), idx, exponent, F.col("__b.cf").alias("cf"), F.col("__b.amp").alias("amp"))
    by, running = [*keys, "band"], ("__mid", "__place")
    run = runs(long.filter(F.col("cf").isNotNull()), by, idx, max_gap, single)
    parts = split_on_drift(run, [*by, "run_id"], idx, "cf", tol, compat, running=running, placed=single)
    ends = ts.groupBy(*keys).agg(*[v.alias(n) for n, v in marks.items()], *[F.min_by(c, idx).alias(c) for c in carried])
    ends_by = None if single else ends.drop(*carried).withColumn("band", F.explode(F.array(*[F.lit(b) for b in bands])))
    out = events_from_runs(parts, by, "event_id", idx, "cf", "amp", exponent, ends_by, step, window, running)
    return out.join(ends.select(*keys, *carried), keys) if carried else out


def merge_attention(peaks: DataFrame, labels: DataFrame, bad: DataFrame, on: list[str], label: str) -> DataFrame:
    """Attention label and bad-window flag of each peak, many-to-one, with
    whether a label was found."""
    from tidegrid.operators.joins import merge_labels

    d = merge_labels(peaks, labels.select(*on, label), on, indicator="has_label")
    d = merge_labels(d, bad.select(*on).distinct(), on, validate=False, indicator="bad_window")
    return d.withColumn("good_window", ~F.col("bad_window"))
