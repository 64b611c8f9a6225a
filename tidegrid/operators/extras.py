"""Sustained exceedances and daily fluence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import Grid
from .halo import CHUNK_STEPS, positioned


def sustained(df: DataFrame, grid: Grid, column: str, threshold: float, least: int, chunk_steps: int = CHUNK_STEPS) -> DataFrame:
    """start, stop, steps of every run of at least `least` rows at or above the threshold, each one step apart."""
    hot = df.where(F.col(column) >= threshold).select(*grid.keys, grid.time)
    p = positioned(hot, grid, "__pos", None, chunk_steps)
    isle = F.unix_seconds(F.col(grid.time)) / grid.step - F.col("__pos")
    runs = p.groupBy(*grid.keys, isle.cast("bigint").alias("__isle")).agg(F.min(grid.time).alias("start"), F.max(grid.time).alias("stop"), F.count("*").alias("steps"))
    return runs.where(F.col("steps") >= least).drop("__isle")


def daily_fluence(df: DataFrame, grid: Grid, column: str) -> DataFrame:
    """Sum over the day times the step in seconds."""
    return df.groupBy(*grid.keys, F.date_trunc("day", F.col(grid.time)).alias("day")).agg((F.sum(column) * grid.step).alias("fluence"), F.count(column).alias("n"))
