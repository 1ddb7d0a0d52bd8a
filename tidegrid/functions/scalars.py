"""Scalar rules shared by the operators."""

from __future__ import annotations

import sys

from pyspark.sql import Column
from pyspark.sql import functions as F

# Band edges in Hz, half-open.
BANDS_CONTIGUOUS = {
    "delta": (1.0, 3.5), "theta": (3.5, 7.5), "alpha": (7.5, 13.5), "beta": (13.5, 30.5), "gamma": (30.5, 57.0),
}
BANDS_CANONICAL = {
    "delta": (1.0, 3.0), "theta": (4.0, 7.0), "alpha": (8.0, 13.0), "beta": (14.0, 30.0), "gamma": (31.0, 50.0),
}


def nan_to_null(col: Column) -> Column:
    return F.when(~F.isnan(col), col)


def log_power(power: Column, floor: float = sys.float_info.min) -> Column:
    """log10 with the argument held at the smallest normal double."""
    return F.log10(F.greatest(power, F.lit(floor)))


def compressed_log(power: Column) -> Column:
    """log10(x + 1e-6): kept for comparison only, it compresses low values."""
    return F.log10(power + F.lit(1e-6))


def mmss(seconds: Column) -> Column:
    whole = F.floor(seconds)
    return F.format_string("%02d:%02d", F.floor(whole / 60), whole % 60)


def window_start(index: Column, step: float = 2.5) -> Column:
    return F.round(index * F.lit(step), 6)


def assign_band(freq: Column, edges: dict[str, tuple[float, float]] = BANDS_CONTIGUOUS) -> Column:
    """Band whose half-open range holds the frequency, else null."""
    out = F.lit(None).cast("string")
    for name, (lo, hi) in reversed(edges.items()):
        out = F.when((freq >= lo) & (freq < hi), name).otherwise(out)
    return out


def stars(p: Column) -> Column:
    return F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").otherwise("")


def zscore_of(x: Column, mean: Column, sd: Column) -> Column:
    """(x - mean) / sd, null where sd is zero or missing."""
    return (x - mean) / F.when(sd != 0, sd)


def hash_digits(*parts: Column) -> Column:
    """48 repeatable random bits of any values as 12 hex digits, whose order as
    text is that of the numbers."""
    return F.substring(F.md5(F.concat_ws("-", *[p.cast("string") for p in parts])), 1, 12)


def unit_bits(x: Column) -> Column:
    """A number in [0, 1] as the whole number of 48 bits that hash_digits stand for."""
    return F.least(F.floor(x * float(2**48)), F.lit(2**48 - 1)).cast("long")


def unit_hash(*parts: Column) -> Column:
    """A repeatable number in [0, 1) from any values, the same in every run
    and on every machine."""
    return F.conv(hash_digits(*parts), 16, 10).cast("double") / F.lit(float(2**48))


def to_degrees(pixels: Column, distance: Column, size: float, n_pixels: float) -> Column:
    """Visual angle of a screen length, from the screen's size and distance."""
    return pixels * F.degrees(2 * F.atan(F.lit(size) / (2 * distance))) / F.lit(n_pixels)


def focus_displacement(disparity: Column, dist_left: Column, dist_right: Column, pupil_cm: Column) -> Column:
    """Displacement of the visual focus in depth; positive is divergence."""
    e = F.lit(0.283) * F.abs(disparity)
    reach = e * (dist_left + dist_right) * 5
    return F.when(disparity > 0, reach / (pupil_cm * 10 - e)).otherwise(-reach / (pupil_cm * 10 + e))


def knee_freq(knee: Column, exponent: Column) -> Column:
    """knee ** (1 / exponent), null unless both are positive."""
    return F.when((knee > 0) & (exponent > 0), F.pow(knee, 1 / exponent))
