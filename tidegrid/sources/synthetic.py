"""Synthetic drivers and fluxes: seeded expressions, one recursive process, injected spikes and gaps.

The random streams are Spark's; series agree with other generators in their statistics, not bit by bit.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import dynamic_pressure, local_time, log10_floor, quantised_kp
from ..operators.windows import causal_convolve, decay_kernel
from ..schema import Grid

FIVE = Grid()


def time_axis(spark: SparkSession, days: float, start: str = "2020-01-01", step: int = 300) -> DataFrame:
    n = int(days * 86400 / step)
    base = F.unix_seconds(F.lit(start).cast("timestamp"))
    return spark.range(n).select(F.col("id").alias("i"), F.timestamp_seconds(base + F.col("id") * step).alias("time"))


def ou_process(df: DataFrame, noise: str, name: str, theta: float, sigma: float, x0: float = 0.0, keys: tuple[str, ...] = ()) -> DataFrame:
    """x_i = (1 - theta) x_{i-1} + sigma noise_i along time, per series.

    The weights of old noise fall geometrically, so the recursion is a causal filter; it is run on blocks of rows, each
    of which starts from the last value of the block before: one pass gives each block's own sum, a scan carries on.
    """
    steps = 4096
    block = df.withColumn("__b", F.floor(F.unix_seconds("time") / (steps * FIVE.step)))
    decay = 1 - theta

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("time").reset_index(drop=True)
        x, out = 0.0, []
        for e in part[noise]:
            x = decay * x + sigma * e
            out.append(x)
        part["__own"], part["__k"] = out, range(1, len(part) + 1)
        return part

    own = block.groupBy(*keys, "__b").applyInPandas(run, T.StructType([*block.schema.fields, T.StructField("__own", T.DoubleType()), T.StructField("__k", T.LongType())]))
    # the recursion over blocks is the same filter again, with a row a block; blocks far back weigh nothing (decay ** steps), so a window of a few is exact to rounding
    ends = own.groupBy(*keys, "__b").agg(F.max_by("__own", "__k").alias("__e"), F.max("__k").alias("__n"))
    by = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("__b")
    far = max(1, math.ceil(45 / (steps * -math.log(max(decay, 1e-9))))) if 0 < decay < 1 else None
    if far is None or far > 64:
        raise ValueError("theta must lie between 0.0002 and 1, so that the past fades within 64 blocks")
    back = [(F.lag("__e", k).over(by), F.sum("__n").over(by.rowsBetween(-k + 1, -1)) if k > 1 else F.lit(0)) for k in range(1, far + 1)]
    before = F.sum("__n").over(by.rowsBetween(Window.unboundedPreceding, -1))
    carry = sum((F.coalesce(e * F.pow(F.lit(decay), n), F.lit(0.0)) for e, n in back), F.lit(0.0)) + F.lit(float(x0)) * F.pow(F.lit(decay), F.coalesce(before, F.lit(0)))
    carry = ends.select(*keys, "__b", carry.alias("__x"))
    out = own.join(carry, [*keys, "__b"])
    return out.withColumn(name, F.col("__own") + F.pow(F.lit(decay), F.col("__k")) * F.col("__x")).drop("__b", "__own", "__k", "__x")


def solar_wind(spark: SparkSession, days: float, seed: int = 0, start: str = "2020-01-01") -> DataFrame:
    """Speed with 27-day streams, density against it, field and activity indices."""
    d = time_axis(spark, days, start).withColumns({"__a": noise("i", 3 * seed), "__b": noise("i", 3 * seed + 1), "__c": noise("i", 3 * seed + 2)})
    for k, (theta, s) in {"__a": (0.005, 3.0), "__b": (0.02, 0.35), "__c": (0.05, 0.5)}.items():
        d = ou_process(d, k, f"{k}x", theta, s)
    phase = F.unix_seconds("time") * (2 * math.pi / (27 * 86400.0))
    v = F.greatest(F.lit(420.0) + 90 * F.sin(phase) + F.col("__ax"), F.lit(260.0))
    d = d.withColumn("vsw", v).withColumn("density", F.greatest(F.lit(5.0) * F.pow(F.lit(420.0) / F.col("vsw"), F.lit(1.5)) * F.exp(F.col("__bx") / 3), F.lit(0.1)))
    d = d.withColumn("bz_gsm", 2 * F.col("__cx")).withColumn("bt", F.abs("bz_gsm") + 3)
    d = d.withColumn("pdyn", dynamic_pressure(F.col("density"), F.col("vsw")))
    kp = F.least(F.greatest(F.lit(1.0) + (F.col("vsw") - 350) / 120 + F.greatest(-F.col("bz_gsm"), F.lit(0.0)) / 2, F.lit(0.0)), F.lit(9.0))
    return d.withColumn("kp", quantised_kp(kp)).drop("i", "__a", "__b", "__c", "__ax", "__bx", "__cx")


def flux(df: DataFrame, longitude: float = 83.0, seed: int = 0) -> DataFrame:
    """Electron flux that follows the speed with a delay and a daily course."""
    d = causal_convolve(df, FIVE, "vsw", decay_kernel(200.0, 288), "__drive").withColumn("mlt", local_time(F.col("time"), F.lit(longitude)))
    log = F.lit(2.0) + (F.col("__drive") - 400) / 150 + 0.4 * F.cos((F.col("mlt") - 12) * (2 * math.pi / 24)) + 0.05 * noise(F.unix_seconds("time"), 3 * seed + 5)
    d = d.withColumns({"flux_e2": F.pow(F.lit(10.0), log), "longitude": F.lit(longitude)}).drop("__drive")
    return d.withColumn("log_flux_e2", log10_floor(F.col("flux_e2")))


def inject_spikes(df: DataFrame, column: str, rate: float = 0.002, factor: float = 50.0, seed: int = 0) -> DataFrame:
    return df.withColumn(column, F.when(F.pmod(F.xxhash64(F.unix_seconds("time"), F.lit(seed), F.lit("spike")), F.lit(1_000_000)) < int(rate * 1_000_000), F.col(column) * factor).otherwise(F.col(column)))


def noise(i: Column | str, seed: int) -> Column:
    """Standard normal values that depend on a row's number and the seed alone, however the rows are partitioned."""
    u = lambda k: (F.pmod(F.xxhash64(i, F.lit(seed), F.lit(k)), F.lit(1 << 53)) + 0.5) / float(1 << 53)
    return F.sqrt(-2 * F.log(u(0))) * F.cos(2 * math.pi * u(1))


def inject_gaps(df: DataFrame, column: str, share: float = 0.03, longest: int = 6, seed: int = 0, long_share: float = 0.0, long_steps: int = 144) -> DataFrame:
    """Blocks of up to `longest` rows lose their value, about `share` of all rows; of `long_steps` rows, about `long_share`.

    Adds `<column>_imputed`. At most half of all rows go, whatever the shares.
    """
    def gone(length: int, part: float, salt: int) -> Column:
        block = F.floor(F.unix_seconds("time") / (FIVE.step * length))
        start = F.pmod(F.xxhash64(block, F.lit(seed), F.lit(salt)), F.lit(length))  # a gap may begin within its block
        u = F.pmod(F.xxhash64(block, F.lit(seed), F.lit(salt + 1)), F.lit(10_000)) / 10_000.0
        at = F.pmod(F.unix_seconds("time") / FIVE.step, F.lit(length))
        return (u < 2 * part) & (at >= start)

    scale = min(1.0, 0.5 / max(share + long_share, 1e-9))
    hit = gone(longest, share * scale, 0) | gone(long_steps, long_share * scale, 10)
    return df.withColumns({f"{column}_imputed": hit.cast("tinyint"), column: F.when(~hit, F.col(column))})


def replay(df: DataFrame, hours: float = 24.0) -> DataFrame:
    """The last hours of a frame, without spikes and gaps of its own, as a stand-in for a live feed."""
    end = df.agg(F.max(F.unix_seconds("time"))).first()[0]
    return df.where(F.unix_seconds("time") > F.lit(end) - int(hours * 3600)) if end is not None else df


def demo_dataset(spark: SparkSession, days: float = 10, seed: int = 0, longitude: float = 83.0, sat_id: str = "sat-1") -> DataFrame:
    d = flux(solar_wind(spark, days, seed), longitude, seed).withColumn("sat_id", F.lit(sat_id))
    return inject_gaps(inject_spikes(d, "flux_e2", seed=seed), "flux_e2", seed=seed)


def sample_stream(spark: SparkSession, rows_per_second: int = 1, seed: int = 0) -> DataFrame:
    """A rate stream with a daily course, for trying the online plan."""
    r = spark.readStream.format("rate").option("rowsPerSecond", rows_per_second).load()
    turn = F.pmod(F.col("value"), F.lit(288)) * (2 * math.pi / 288)
    return r.select(F.lit("sat-1").alias("sat_id"), F.col("timestamp").alias("time"), (F.lit(2.5) + 0.5 * F.sin(turn) + F.pmod(F.xxhash64("value", F.lit(seed)), F.lit(1000)) / 10_000.0).alias("x"))
