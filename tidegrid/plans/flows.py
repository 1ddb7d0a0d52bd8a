"""The three analyses end to end, each as one chain of operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.operators import aggs, events, joins, multivar, series, spectral, states, stats, windows
from tidegrid.session import settle


def power_contrast(signal: DataFrame, meta: DataFrame, labels: DataFrame, recording: str, channel: str, idx: str, value: str,
                   region: str, size: int, step: int, min_n: int = 10, min_subjects: int = 3) -> DataFrame:
    """Signal -> robust z of window means -> state contrast per electrode and
    region -> t over recordings, corrected.

    The robust scale is affine, so windows are cut first and scaled after:
    a quarter of the rows at 75 % overlap of a step-sized grid. Window means are
    plain sums in order: where two of a channel's few windows are equal, their MAD
    must not be a rounding error that blows up the third.
    """
    win = windows.window_means(signal, [recording, channel], idx, value, size, step)
    win = settle(win, "windowed")
    z = series.robust_z(win, [recording, channel], "mean", "z")
    lab = joins.merge_labels(z, labels, [recording, "window_idx"])
    lab = joins.attach_meta(lab, meta, [channel], strict=False)
    elec = aggs.electrode_delta(lab, [recording, channel, region], "z", "label", states.INTERNAL, states.EXTERNAL, min_n)
    per = settle(aggs.region_delta(elec, [recording, region]), "regions")
    t = stats.ttest_1samp(per, [region], "delta", min_subjects)
    t = stats.with_t_p(t, F.col("n") - 1)
    return stats.adjust(t, [], "p", region)


def attention_labels(features: DataFrame, subject: str, time: str, cols: list[str], isc_col: str, thr_int: float, thr_ext: float,
                     weight: float | None = None) -> DataFrame:
    """Window features -> first component, sign aligned -> departure from the
    group -> scaled -> strict label."""
    scored, _ = multivar.pca(features, cols, 1)
    scored = states.align_sign(scored, [], "PC1", isc_col)
    dev = settle(states.mahalanobis(scored, [time], cols, "deviation", weight), "deviation")
    z = states.deviation_z(dev, [subject], [time], "deviation", "PC1")
    return z.withColumn("label", states.label_strict(F.col("PC1_z"), F.col("deviation_subject_z"), thr_int, thr_ext))


def spectral_events(signal: DataFrame, keys: list[str], idx: str, value: str, fs: float, size: int, step: int, seg: int,
                    lo: float, hi: float, bands: dict[str, tuple[float, float]], min_height: float = 0.05) -> DataFrame:
    """Signal -> spectrum per window -> aperiodic line -> peaks -> largest per
    band -> events."""
    w = windows.assign_windows(signal, idx, size, step)
    w = w.withColumn("__pos", F.col(idx) - F.col("window_idx") * step)
    wk = [*keys, "window_idx"]
    psd = settle(spectral.welch_psd(w, wk, "__pos", value, fs, seg, fmin=lo, fmax=hi), "psd")
    fit = settle(spectral.aperiodic_fit(psd, wk, lo, hi), "fit")
    flat = settle(spectral.flatten(psd, fit, wk, lo, hi), "flat")
    peaks = spectral.local_peaks(flat, wk, min_height, fs / seg)
    rows = fit.select(*wk, "exponent").join(peaks, wk, "left").withColumn("order", F.col("cf"))
    ts = events.peaks_to_timeseries(rows, wk, "cf", "height", "width", "order", bands, F.col("cf").isNotNull())
    return events.to_events(ts.join(fit.select(*wk, "exponent"), wk), keys, "window_idx", "exponent", list(bands), step=step / fs, window=size / fs)
