"""Windows over long series without one task per series.

A series with few keys and a long history would put every row of a window into one task. Here time is cut into chunks;
each row is also sent to the neighbouring chunks that need it as context (the halo), windows run per (keys, chunk), and
the context rows are dropped again. For frames of bounded width on a uniform grid the result is that of one window.
What reaches back without a bound (last value, position) takes two phases: a value per chunk, then a scan over chunks.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..schema import Grid

CHUNK_STEPS = 8192


def chunk_of(grid: Grid, steps: int) -> Column:
    return F.floor(F.unix_seconds(F.col(grid.time)) / (steps * grid.step)).cast("bigint")


def spec(grid: Grid, *more: str) -> WindowSpec:
    keys = [*grid.keys, *more]
    return (Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))).orderBy(grid.time)


def windowed(df: DataFrame, grid: Grid, before: int, after: int, add: Callable[[DataFrame, WindowSpec], DataFrame], chunk_steps: int = CHUNK_STEPS) -> DataFrame:
    """add(df, window) over frames that reach at most `before` rows back and `after` rows ahead."""
    steps = max(chunk_steps, before + after)
    t, span = F.unix_seconds(F.col(grid.time)), steps * grid.step
    first, last = F.floor((t - after * grid.step) / span), F.floor((t + before * grid.step) / span)
    wide = df.withColumn("__home", chunk_of(grid, steps)).withColumn("__chunk", F.explode(F.sequence(first.cast("bigint"), last.cast("bigint"))))
    return add(wide, spec(grid, "__chunk")).where(F.col("__home") == F.col("__chunk")).drop("__home", "__chunk")


def spread(grid: Grid, *more: str) -> WindowSpec:
    """As spec(), newest first: looking ahead is looking back in it, and a running value costs one step a row."""
    keys = [*grid.keys, *more]
    return (Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))).orderBy(F.col(grid.time).desc())


def carried(df: DataFrame, grid: Grid, values: dict[str, Column], chunk_steps: int = CHUNK_STEPS, ahead: bool = False) -> DataFrame:
    """For each name the last (with ahead: next) non-null value at or before (after) the row, however far away."""
    w = (spread if ahead else spec)(grid, "__chunk").rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumns({f"__v{i}": c for i, c in enumerate(values.values())}).withColumn("__chunk", chunk_of(grid, chunk_steps))
    ends = df.groupBy(*grid.keys, "__chunk").agg(
        *[(F.min_by if ahead else F.max_by)(f"__v{i}", F.when(F.col(f"__v{i}").isNotNull(), F.col(grid.time))).alias(f"__e{i}") for i in range(len(values))]
    )
    scan = Window.partitionBy(*(grid.keys or [F.lit(0)])).orderBy(F.col("__chunk").desc() if ahead else F.col("__chunk").asc()).rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select(*grid.keys, "__chunk", *[F.last(F.col(f"__e{i}"), ignorenulls=True).over(scan).alias(f"__c{i}") for i in range(len(values))])
    out = df.withColumns({name: F.last(F.col(f"__v{i}"), ignorenulls=True).over(w) for i, name in enumerate(values)})
    out = out.join(ends, [*grid.keys, "__chunk"], "left")
    return out.withColumns({name: F.coalesce(F.col(name), F.col(f"__c{i}")) for i, name in enumerate(values)}).drop("__chunk", *[f"__{k}{i}" for k in "vc" for i in range(len(values))])


def surrounded(df: DataFrame, grid: Grid, known: Column, chunk_steps: int = CHUNK_STEPS) -> DataFrame:
    """Adds the times (seconds) of the nearest rows where `known` holds, at or before and at or after each row (__before,
    __after), and of the first and last row of the series (__first, __last). One value a chunk serves all four, so df is
    read once for these and once for the rows."""
    t = F.unix_seconds(F.col(grid.time))
    d = df.withColumns({"__k": F.when(known, t), "__chunk": chunk_of(grid, chunk_steps)})
    ends = d.groupBy(*grid.keys, "__chunk").agg(F.min("__k").alias("__lo"), F.max("__k").alias("__hi"), F.min(t).alias("__a"), F.max(t).alias("__b"))
    by = Window.partitionBy(*(grid.keys or [F.lit(0)]))
    back = by.orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    ahead = by.orderBy(F.col("__chunk").desc()).rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select(*grid.keys, "__chunk", F.max("__hi").over(back).alias("__p"), F.min("__lo").over(ahead).alias("__q"), F.min("__a").over(by).alias("__first"), F.max("__b").over(by).alias("__last"))
    upto = (Window.unboundedPreceding, 0)
    d = d.withColumns({"__before": F.max("__k").over(spec(grid, "__chunk").rowsBetween(*upto)), "__after": F.min("__k").over(spread(grid, "__chunk").rowsBetween(*upto))})
    d = d.join(ends, [*grid.keys, "__chunk"], "left")
    return d.withColumns({"__before": F.coalesce("__before", "__p"), "__after": F.coalesce("__after", "__q")}).drop("__k", "__chunk", "__p", "__q")


def positioned(df: DataFrame, grid: Grid, name: str = "pos", total: str | None = "n_rows", chunk_steps: int = CHUNK_STEPS, order: Sequence[str] = ()) -> DataFrame:
    """0-based position by time (then `order`) within each series, and the number of rows of the series."""
    df = df.withColumn("__chunk", chunk_of(grid, chunk_steps))
    counts = df.groupBy(*grid.keys, "__chunk").agg(F.count("*").alias("__n"))
    by = Window.partitionBy(*(grid.keys or [F.lit(0)]))
    counts = counts.select(
        *grid.keys, "__chunk", F.coalesce(F.sum("__n").over(by.orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__base"), F.sum("__n").over(by).alias("__total")
    )
    out = df.withColumn("__r", F.row_number().over(Window.partitionBy(*grid.keys, "__chunk").orderBy(grid.time, *order))).join(counts, [*grid.keys, "__chunk"])
    out = out.withColumn(name, F.col("__base") + F.col("__r") - 1)
    if total:
        out = out.withColumn(total, F.col("__total"))
    return out.drop("__chunk", "__base", "__total", "__r")


def rows_windowed(df: DataFrame, grid: Grid, before: int, add: Callable[[DataFrame, WindowSpec], DataFrame], order: Sequence[str] = (), chunk_rows: int = CHUNK_STEPS) -> DataFrame:
    """add(df, window) over frames that reach at most `before` rows back, for series without a uniform step.

    Rows are cut into chunks by their position in the series; `order` tells rows of equal time apart.
    """
    size = max(chunk_rows, before)
    d = positioned(df, grid, "__at", None, order=order)
    chunk = F.floor(F.col("__at") / size).cast("bigint")
    d = d.withColumn("__home", chunk).withColumn("__chunk", F.explode(F.when(F.pmod("__at", F.lit(size)) >= size - before, F.array(chunk, chunk + 1)).otherwise(F.array(chunk))))
    w = Window.partitionBy(*grid.keys, "__chunk").orderBy("__at")
    return add(d, w).where(F.col("__home") == F.col("__chunk")).drop("__home", "__chunk", "__at")


def previous_time(df: DataFrame, grid: Grid, name: str, chunk_steps: int = CHUNK_STEPS) -> DataFrame:
    """The time of the row before, however far back: within a chunk by a window, for its first row from the ends of chunks."""
    df = df.withColumn("__chunk", chunk_of(grid, chunk_steps))
    ends = df.groupBy(*grid.keys, "__chunk").agg(F.max(grid.time).alias("__last"))
    by = Window.partitionBy(*(grid.keys or [F.lit(0)])).orderBy("__chunk")
    ends = ends.select(*grid.keys, "__chunk", F.lag("__last").over(by).alias("__before"))
    out = df.withColumn(name, F.lag(grid.time).over(spec(grid, "__chunk"))).join(ends, [*grid.keys, "__chunk"], "left")
    return out.withColumn(name, F.coalesce(name, "__before")).drop("__chunk", "__before")


def names(columns: Sequence[str] | str) -> list[str]:
    return [columns] if isinstance(columns, str) else list(columns)
