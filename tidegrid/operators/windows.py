"""Lags, rolling statistics, supervised anchors, splits and the shapes models read."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import add_coupling, add_cyclic, exceeds
from ..schema import DECODER_STEPS, HORIZON_STEPS, KNOWN_FUTURE, Grid
from .halo import CHUNK_STEPS, positioned, windowed

# Which lags and rolling widths the feature contract has.
LAGS = {"log_flux_e2": (1, 12, 72, 288), "vsw": (288, 432, 576)}
ROLLING = {"vsw": ((12, "mean"), (72, "mean"), (288, "mean"), (288, "std"), (288, "max")), "log_flux_e2": ((72, "mean"), (288, "mean"), (288, "std")), "bz_gsm": ((72, "min"),)}

STATS = {"mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max}


def _lags(w, wanted: Mapping[str, Sequence[int]]) -> dict[str, Column]:
    return {f"{c}_lag{k}": F.lag(c, k).over(w) for c, ks in wanted.items() for k in ks}


def _rolling(w, wanted: Mapping[str, Sequence[tuple[int, str]]]) -> dict[str, Column]:
    return {f"{c}_roll{n}_{s}": STATS[s](c).over(w.rowsBetween(-(n - 1), 0)) for c, ks in wanted.items() for n, s in ks}


def add_lags(df: DataFrame, grid: Grid, column: str, steps: Sequence[int], chunk_steps: int = CHUNK_STEPS) -> DataFrame:
    return windowed(df, grid, max(steps), 0, lambda d, w: d.withColumns(_lags(w, {column: steps})), chunk_steps)


def add_rolling(df: DataFrame, grid: Grid, column: str, widths: Sequence[int], stats: Sequence[str] = ("mean", "std", "min", "max"), chunk_steps: int = CHUNK_STEPS) -> DataFrame:
    """Trailing statistics over rows; missing values are skipped, the standard deviation is that of a sample."""
    return windowed(df, grid, max(widths) - 1, 0, lambda d, w: d.withColumns(_rolling(w, {column: [(n, s) for n in widths for s in stats]})), chunk_steps)


def feature_matrix(df: DataFrame, grid: Grid, lags: Mapping[str, Sequence[int]] | None = None, rolling: Mapping[str, Sequence[tuple[int, str]]] | None = None, chunk_steps: int = CHUNK_STEPS) -> DataFrame:
    """Coupling, cyclic, lag and rolling columns; all windows share one exchange and one sort."""
    lags = {c: k for c, k in (LAGS if lags is None else lags).items() if c in df.columns}
    rolling = {c: k for c, k in (ROLLING if rolling is None else rolling).items() if c in df.columns}
    df = add_cyclic(add_coupling(df) if {"vsw", "density", "bz_gsm", "bt"} <= set(df.columns) else df, grid.time)
    reach = max([1, *(k for ks in lags.values() for k in ks), *(n for ks in rolling.values() for n, _ in ks)])
    return windowed(df, grid, reach, 0, lambda d, w: d.withColumns(_lags(w, lags) | _rolling(w, rolling)), chunk_steps)


def anchors(
    df: DataFrame, grid: Grid, features: Sequence[str], target: str, lookback: int, *, decoder: int = DECODER_STEPS, horizons: Mapping[str, int] | None = None, threshold: float = 3.0,
    future: Sequence[str] = KNOWN_FUTURE, drop_missing: bool = True, arrays: bool = False, keep: Sequence[str] = (), chunk_steps: int = CHUNK_STEPS,
) -> DataFrame:
    """One row per anchor time with targets ahead; inputs as arrays only on demand.

    An anchor needs `lookback` rows behind it (itself included) and as many rows ahead as the decoder or the farthest
    horizon; with drop_missing it is kept only if no input, known future value or target among them is missing.
    """
    horizons = dict(HORIZON_STEPS if horizons is None else horizons)
    future = [c for c in future if c in df.columns]
    ahead = max(decoder, *horizons.values())

    def add(d, w):
        back, fore = w.rowsBetween(-(lookback - 1), 0), w.rowsBetween(1, decoder)
        gone = lambda cols: F.greatest(*[F.col(c).isNull().cast("int") for c in cols], F.lit(0), F.lit(0))
        d = d.withColumns({"__x": gone(features), "__f": gone(future)})
        new = {"__nb": F.count(F.lit(1)).over(back), "__na": F.count(F.lit(1)).over(w.rowsBetween(1, ahead)), "__bx": F.sum("__x").over(back), "__bf": F.coalesce(F.sum("__f").over(fore), F.lit(0))}
        new |= {f"y_{h}": F.lead(target, k).over(w) for h, k in horizons.items()}
        if arrays:
            pack = lambda cols: F.struct(F.array(*[F.col(c).cast("float") for c in cols]).alias("v"))
            new["X"] = F.transform(F.collect_list(pack(features)).over(back), lambda s: s["v"])
            if future:
                new["X_future"] = F.transform(F.collect_list(pack(future)).over(fore), lambda s: s["v"])
        return d.withColumns(new)

    d = windowed(df, grid, lookback - 1, ahead, add, chunk_steps)
    ok = (F.col("__nb") == lookback) & (F.col("__na") == ahead)
    if drop_missing:
        ok = ok & (F.col("__bx") == 0) & (F.col("__bf") == 0)
        for h in horizons:
            ok = ok & F.col(f"y_{h}").isNotNull()
    cols = [*grid.keys, grid.time, *keep, *[f"y_{h}" for h in horizons]]
    d = d.where(ok).withColumns({f"y_exceed_{h}": exceeds(F.col(f"y_{h}"), threshold) for h in horizons})
    return d.select(*dict.fromkeys([*cols, *[f"y_exceed_{h}" for h in horizons], *(["X"] + ["X_future"] * bool(future) if arrays else [])]))


def chronological_split(df: DataFrame, grid: Grid, train: float = 0.7, val: float = 0.15, embargo: int = 0) -> DataFrame:
    """Adds `split`: rows within `embargo` positions of either side of a cut belong to none (NULL)."""
    d = positioned(df, grid, "__pos", "__n")
    a, b = F.floor(F.col("__n") * train), F.floor(F.col("__n") * (train + val))
    p = F.col("__pos")
    split = F.when(p < a - embargo, "train").when((p >= a + embargo) & (p < b - embargo), "val").when(p >= b + embargo, "test")
    return d.withColumn("split", split).drop("__pos", "__n")


def select_split(df: DataFrame, split: str) -> DataFrame:
    if split not in ("train", "val", "test", "all"):
        raise ValueError(f"unknown split {split!r}")
    return df if split == "all" else df.where(F.col("split") == split)


def every_nth(df: DataFrame, grid: Grid, stride: int, most_recent: int | None = None) -> DataFrame:
    """Every stride-th row by position, then only the most recent ones."""
    d = positioned(df, grid, "__pos", None).where(F.col("__pos") % stride == 0).drop("__pos")
    return d.orderBy(F.col(grid.time).desc()).limit(most_recent) if most_recent is not None else d


def window_stats(df: DataFrame, grid: Grid, columns: Sequence[str], lookback: int, chunk_steps: int = CHUNK_STEPS) -> DataFrame:
    """Last, first, mean, population deviation, minimum and maximum of each channel over the window; missing becomes 0."""
    def add(d, w):
        f = w.rowsBetween(-(lookback - 1), 0)
        each = {"last": lambda c: F.col(c), "first": lambda c: F.first(c).over(f), "mean": lambda c: F.avg(c).over(f), "std": lambda c: F.stddev_pop(c).over(f), "min": lambda c: F.min(c).over(f), "max": lambda c: F.max(c).over(f)}
        return d.withColumns({f"{c}_{k}": F.coalesce(g(c), F.lit(0.0)) for c in columns for k, g in each.items()} | {"__nb": F.count(F.lit(1)).over(f)})

    return windowed(df, grid, lookback - 1, 0, add, chunk_steps).where(F.col("__nb") == lookback).drop("__nb")


def filter_design(df: DataFrame, grid: Grid, lookback: int, recent: int, speed: str = "vsw", flux: str = "log_flux_e2", chunk_steps: int = CHUNK_STEPS) -> DataFrame:
    """Inputs of the linear filter: last, mean, recent mean and maximum, change of the speed, and the last flux."""
    k = min(recent, lookback)

    def add(d, w):
        f, r = w.rowsBetween(-(lookback - 1), 0), w.rowsBetween(-(k - 1), 0)
        new = {"v_last": F.col(speed), "v_mean": F.avg(speed).over(f), "v_recent": F.avg(speed).over(r), "v_recent_max": F.max(speed).over(r), "v_change": F.col(speed) - F.first(speed).over(f), "flux_last": F.col(flux)}
        return d.withColumns({n: F.coalesce(c, F.lit(0.0)) for n, c in new.items()} | {"__nb": F.count(F.lit(1)).over(f)})

    return windowed(df, grid, lookback - 1, 0, add, chunk_steps).where(F.col("__nb") == lookback).drop("__nb")


def decoder_path(df: DataFrame, last: str, horizons: Mapping[str, int] | None = None, steps: int = DECODER_STEPS) -> DataFrame:
    """Rows (step, value): the broken line through the last value and each horizon's target, flat beyond the last."""
    knots = [(0, F.col(last)), *[(k, F.col(f"y_{h}")) for h, k in sorted((horizons or HORIZON_STEPS).items(), key=lambda x: x[1])]]
    d = df.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(steps))))
    s, path = F.col("step"), None
    for (a, va), (b, vb) in zip(knots, knots[1:], strict=False):
        piece = va + (vb - va) * (s - a) / float(b - a)
        path = F.when(s <= b, piece) if path is None else path.when(s <= b, piece)
    return d.withColumn("value", path.otherwise(knots[-1][1]))


def unroll(df: DataFrame, key: Sequence[str], x: str = "X", future: str = "X_future") -> DataFrame:
    """Window arrays to rows (time_idx, inputs, known): the decoder repeats the last inputs, the encoder the first known row."""
    enc = df.select(*key, F.posexplode(x).alias("time_idx", "inputs"), F.element_at(future, 1).alias("known"))
    dec = df.select(*key, F.size(x).alias("__n"), F.posexplode(future).alias("__i", "known"), F.element_at(x, -1).alias("inputs"))
    return enc.unionByName(dec.select(*key, (F.col("__n") + F.col("__i")).alias("time_idx"), "inputs", "known"))


def causal_convolve(df: DataFrame, grid: Grid, column: str, kernel: Sequence[float], name: str, chunk_steps: int = CHUNK_STEPS) -> DataFrame:
    """Sum of kernel[k] times the value k rows back; rows before the series count as 0."""
    ker = F.array(*[F.lit(float(k)) for k in kernel])

    def add(d, w):
        values = F.collect_list(F.coalesce(F.col(column), F.lit(0.0))).over(w.rowsBetween(-(len(kernel) - 1), 0))
        return d.withColumn(name, F.aggregate(F.zip_with(F.reverse(values), F.slice(ker, 1, F.size(values)), lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b))

    return windowed(df, grid, len(kernel) - 1, 0, add, chunk_steps)


def decay_kernel(tau: float, n: int) -> list[float]:
    raw = [math.exp(-i / tau) for i in range(n)]
    return [r / sum(raw) for r in raw]
