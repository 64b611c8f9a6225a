"""Solar-wind coupling expressions. Missing inputs give missing results unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import DEFAULT_LAG_MIN, L1_DISTANCE_KM, PROTON_KG
from .scalar import cyclic, day_of_year, hour_of_day

__all__ = ["add_coupling", "add_cyclic", "ballistic_lag", "clock_angle", "dynamic_pressure", "epsilon", "newell", "southward", "standoff"]


def clock_angle(by: Column, bz: Column) -> Column:
    return F.atan2(by, bz)


def southward(v: Column, bz: Column) -> Column:
    """Speed times the southward field; a missing field counts as none."""
    return v * F.when(bz < 0, -bz).otherwise(F.lit(0.0)) * 1e-3


def newell(v: Column, by: Column, bz: Column) -> Column:
    transverse = F.hypot(by, bz)
    return F.pow(v, F.lit(4 / 3)) * F.pow(transverse, F.lit(2 / 3)) * F.pow(F.abs(F.sin(clock_angle(by, bz) / 2)), F.lit(8 / 3))


def epsilon(v: Column, b: Column, by: Column, bz: Column) -> Column:
    return v * b * b * F.pow(F.sin(clock_angle(by, bz) / 2), F.lit(4.0))


def dynamic_pressure(n: Column, v: Column) -> Column:
    """In nPa, from particles per cubic centimetre and km/s."""
    return n * F.lit(PROTON_KG) * 1e6 * F.pow(v * 1e3, F.lit(2.0)) * 1e9


def standoff(pressure: Column, bz: Column) -> Column:
    """Subsolar distance of the magnetopause in Earth radii."""
    return (F.lit(10.22) + 1.29 * F.tanh(0.184 * (bz + 8.14))) * F.pow(pressure, F.lit(-1 / 6.6))


def ballistic_lag(v: Column, distance_km: float = L1_DISTANCE_KM, default_min: float = DEFAULT_LAG_MIN) -> Column:
    """Minutes from the upstream point to Earth; the default where the speed is missing or not positive."""
    usable = (v > 0) & ~F.isnan(v) & (v < F.lit(float("inf")))
    return F.when(usable, F.lit(distance_km) / v / 60).otherwise(F.lit(default_min))


def add_coupling(df: DataFrame) -> DataFrame:
    """The five coupling columns; without by_gsm it counts as 0, without pdyn it is derived."""
    v, bz, b = F.col("vsw"), F.col("bz_gsm"), F.col("bt")
    by = F.col("by_gsm") if "by_gsm" in df.columns else F.lit(0.0)
    derived = dynamic_pressure(F.col("density"), v)
    pressure = F.coalesce(F.col("pdyn"), derived) if "pdyn" in df.columns else derived
    return df.withColumns({"pdyn": pressure}).withColumns(
        {"vbs": southward(v, bz), "newell": newell(v, by, bz), "epsilon": epsilon(v, b, by, bz), "clock": clock_angle(by, bz), "standoff": standoff(F.col("pdyn"), bz)}
    )


def add_cyclic(df: DataFrame, time: str = "time") -> DataFrame:
    out = dict(zip(("tod_sin", "tod_cos"), cyclic(hour_of_day(F.col(time)), 24.0), strict=True))
    out |= dict(zip(("doy_sin", "doy_cos"), cyclic(day_of_year(F.col(time)), 365.25), strict=True))
    if "mlt" in df.columns:
        out |= dict(zip(("mlt_sin", "mlt_cos"), cyclic(F.col("mlt"), 24.0), strict=True))
    return df.withColumns(out)
