"""Masks, logarithms, scaling, cyclic encodings, bins and payload expressions."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import ALERT_LOG10, QUANTILES

__all__ = [
    "alert_level", "bin_of_angle", "cache_key", "clean_sample", "climatology_bin", "cyclic", "day_of_year", "energy_label", "exceeds", "finite", "gaussian_quantiles",
    "hour_of_day", "inverse_log10", "inverse_scaled", "iso_utc", "local_time", "log10_floor", "logistic_exceedance", "lut_bin", "mask_invalid", "null_if_nan",
    "or_mask", "payload", "quantised_kp", "scaled", "sigma_of_quantiles", "sorted_quantiles", "survival",
]


def null_if_nan(x: Column) -> Column:
    """NaN means missing to the engine, and missing is NULL."""
    return F.when(~F.isnan(x), x)


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))


def mask_invalid(x: Column, *, fill: float | None = None, lo: float | None = None, hi: float | None = None) -> Column:
    """NULL where x is the fill value (within rounding) or outside the closed range."""
    bad = F.isnan(x)
    if fill is not None:
        bad = bad | (F.abs(x - F.lit(fill)) <= F.lit(1e-8 + 1e-5 * abs(fill)))
    if lo is not None:
        bad = bad | (x < F.lit(lo))
    if hi is not None:
        bad = bad | (x > F.lit(hi))
    return F.when(~bad, x)


def log10_floor(x: Column, floor: float = 1e-2) -> Column:
    """log10 with values below floor lifted to it; missing stays missing."""
    return F.when(x.isNotNull() & ~F.isnan(x), F.log10(F.greatest(x, F.lit(floor))))


def inverse_log10(x: Column) -> Column:
    return F.pow(F.lit(10.0), x)


def scaled(x: Column, center: float, scale: float) -> Column:
    return (x - F.lit(center)) / F.lit(scale)


def inverse_scaled(x: Column, center: float, scale: float) -> Column:
    return x * F.lit(scale) + F.lit(center)


def cyclic(x: Column, period: float) -> tuple[Column, Column]:
    """Sine and cosine of the phase of x."""
    phase = x * F.lit(2 * math.pi) / F.lit(period)
    return F.sin(phase), F.cos(phase)


def hour_of_day(t: Column) -> Column:
    return F.hour(t) + F.minute(t) / 60.0 + F.second(t) / 3600.0


def day_of_year(t: Column) -> Column:
    return F.dayofyear(t) + (F.hour(t) + F.minute(t) / 60.0) / 24.0


def local_time(t: Column, longitude: Column) -> Column:
    """Magnetic local time from universal time and longitude, in [0, 24)."""
    return F.pmod(hour_of_day(t) + longitude / 15.0, F.lit(24.0))


def bin_of_angle(sin: Column, cos: Column, n: int) -> Column:
    """Which of n equal sectors the phase given by sine and cosine falls into."""
    turn = F.pmod(F.atan2(sin, cos) / F.lit(2 * math.pi), F.lit(1.0))
    return F.least(F.floor(turn * n), F.lit(n - 1)).cast("int")


def climatology_bin(tod: Column, kp: Column, doy: Column, mlt: Column, *, n_kp: int = 10, n_doy: int = 12, n_mlt: int = 8) -> Column:
    """One number for a cell of time of day, activity, season and local time; a missing activity counts as 0."""
    k = F.least(F.greatest(F.coalesce(F.floor(kp), F.lit(0)), F.lit(0)), F.lit(n_kp - 1))
    return (((tod * n_kp + k) * n_doy + doy) * n_mlt + mlt).cast("int")


def lut_bin(mlt: Column, n: int) -> Column:
    return F.least(F.greatest(F.floor(F.pmod(mlt, F.lit(24.0)) / 24.0 * n), F.lit(0)), F.lit(n - 1)).cast("int")


def sigma_of_quantiles(lo: Column, hi: Column, taus: Sequence[float] = (QUANTILES[0], QUANTILES[-1])) -> Column:
    """Standard deviation of the normal law with these two quantiles, 1e-6 at least."""
    z = NormalDist().inv_cdf(taus[1]) - NormalDist().inv_cdf(taus[0])
    return F.greatest((hi - lo) / F.lit(z), F.lit(1e-6))


def gaussian_quantiles(mid: Column, sigma: Column, taus: Sequence[float] = QUANTILES) -> Column:
    return F.array_sort(F.array(*[mid + F.lit(NormalDist().inv_cdf(t)) * sigma for t in taus]))


def sorted_quantiles(*q: Column) -> Column:
    """Quantiles that do not cross."""
    return F.array_sort(F.array(*q))


def survival(x: float | Column, mean: Column, sigma: Column) -> Column:
    """P(X > x) of a normal law; a step where sigma is not positive.

    Spark has no error function. Half the complementary one of |z|/sqrt 2 follows from the continued fraction for
    large and the power series for small arguments, both unrolled from the inside out, a few operations a term, so that
    the plan is free of Python and its code small enough to be compiled.
    """
    x = F.lit(x) if isinstance(x, (int, float)) else x
    z = (x - mean) / sigma
    a = F.abs(z)
    dens = F.exp(-a * a / 2) / F.lit(math.sqrt(2 * math.pi))
    series = F.lit(1.0)
    for k in range(39, 0, -1):
        series = 1 + a * a / F.lit(2.0 * k + 1) * series
    series = a * series
    frac = a
    for k in range(30, 0, -1):
        frac = a + F.lit(float(k)) / frac
    tail = F.when(a < 2.5, 0.5 - dens * series).otherwise(dens / frac)
    return F.when(sigma > 0, F.when(z >= 0, tail).otherwise(1 - tail)).otherwise((mean > x).cast("double"))


def logistic_exceedance(p50: Column, spread: Column, threshold: float = ALERT_LOG10) -> Column:
    return 1 / (1 + F.exp(-(p50 - F.lit(threshold)) / (F.lit(0.5) * spread)))


def exceeds(y: Column, threshold: float = ALERT_LOG10) -> Column:
    return (y >= F.lit(threshold)).cast("tinyint")


def alert_level(p: Column) -> Column:
    """ALERT from one half, WATCH from one fifth, else NOMINAL; a missing probability is 0."""
    p = F.coalesce(p, F.lit(0.0))
    return F.when(p >= 0.5, "ALERT").when(p >= 0.2, "WATCH").otherwise("NOMINAL")


def quantised_kp(kp: Column) -> Column:
    """To the nearest third, halves to even."""
    return F.rint(kp * 3) / 3


def or_mask(old: Column, new: Column) -> Column:
    return F.greatest(F.coalesce(old, F.lit(0)), F.coalesce(new, F.lit(0))).cast("tinyint")


def iso_utc(t: Column) -> Column:
    return F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def cache_key(vector: Column, context: Column | None = None) -> Column:
    """Hash of a vector rounded half to even at three places, and of the context it was made in."""
    rounded = F.transform(vector, lambda v: F.bround(v, 3))
    return F.xxhash64(rounded, context) if context is not None else F.xxhash64(rounded)


def energy_label(text: Column) -> Column:
    return F.regexp_replace(text, " ", "")


def clean_sample(sample: Column) -> Column:
    """A map without its missing values."""
    return F.map_filter(sample, lambda _, v: v.isNotNull() & ~F.isnan(v))


def payload(issued: Column, satellite: Column, horizons: Mapping[str, Mapping[str, Column]]) -> Column:
    """Forecast message: per horizon flux quantiles in linear units, clipped probability and alert flag."""
    entries = []
    for name, q in horizons.items():
        p = F.least(F.greatest(q["p"], F.lit(0.0)), F.lit(1.0))
        body = F.struct(*[q[k].alias(f"log_{k}") for k in ("p10", "p50", "p90")], inverse_log10(q["p50"]).alias("flux"), p.alias("p_exceed"), (p >= 0.5).alias("alert"))
        entries.append(F.struct(F.lit(name).alias("key"), body.alias("value")))
    return F.struct(iso_utc(issued).alias("issued_utc"), satellite.alias("satellite"), F.map_from_entries(F.array(*entries)).alias("horizons"))
