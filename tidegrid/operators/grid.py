"""Uniform grids, deduplication, validation and merging of sources."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ballistic_lag, null_if_nan
from ..schema import KNOWN_FUTURE, MERGED_COLUMNS, Grid
from .halo import CHUNK_STEPS, previous_time

AGGREGATES = {
    "mean": F.avg, "max": F.max, "min": F.min, "sum": F.sum, "count": F.count, "median": F.median,
}


def bin_start(t: Column, step: int) -> Column:
    """Left edge of the bin of t, bins counted from the epoch."""
    return F.timestamp_micros((F.floor(F.unix_micros(t) / (step * 1_000_000)) * (step * 1_000_000)).cast("bigint"))


def _aggregate(how: str, column: str, time: str) -> Column:
    if how in ("first", "last"):
        return (F.min_by if how == "first" else F.max_by)(F.col(column), F.when(F.col(column).isNotNull(), F.col(time)))
    if how not in AGGREGATES:
        raise ValueError(f"unknown aggregation {how!r}")
    return AGGREGATES[how](F.col(column))


def resample(df: DataFrame, grid: Grid, columns: Sequence[str], how: str = "mean", overrides: Mapping[str, str] | None = None, complete: bool = True) -> DataFrame:
    """One row per bin; with complete also for empty bins between the first and the last of each series.

    Empty bins go into the same aggregate as rows without values, so nothing has to be joined afterwards.
    """
    how_of = {c: (overrides or {}).get(c, how) for c in columns}
    kinds = dict(df.dtypes)
    value = {c: null_if_nan(F.col(c)) if kinds[c] in ("double", "float") else F.col(c) for c in columns}
    rows = df.select(*grid.keys, grid.time, *[v.alias(c) for c, v in value.items()], bin_start(F.col(grid.time), grid.step).alias("__bin"), F.lit(1).alias("__one"))
    if complete:
        empty = time_axis(df, grid).withColumnRenamed(grid.time, "__bin")
        rows = rows.where(F.col(grid.time).isNotNull()).unionByName(empty, allowMissingColumns=True)
    made = {c: _aggregate(h, c, grid.time) for c, h in how_of.items()}
    made = {c: F.when(F.count("__one") > 0, a) if how_of[c] == "count" else a for c, a in made.items()}  # no rows, no count
    return rows.groupBy(*grid.keys, "__bin").agg(*[a.alias(c) for c, a in made.items()]).withColumnRenamed("__bin", grid.time)


def time_axis(df: DataFrame, grid: Grid, chunk_steps: int = CHUNK_STEPS) -> DataFrame:
    """Every bin from the first to the last of each series, made chunk by chunk, so that no row holds a whole axis."""
    t = F.floor(F.unix_micros(grid.time) / (grid.step * 1_000_000)).cast("bigint")
    span = df.groupBy(*grid.keys).agg(F.min(t).alias("__a"), F.max(t).alias("__b")).where("__a IS NOT NULL")
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    chunks = span.withColumn("__c", F.explode(F.sequence(F.floor(F.col("__a") / chunk_steps), F.floor(F.col("__b") / chunk_steps)))).repartition(n, *grid.keys, "__c")
    bins = F.sequence(F.greatest("__a", F.col("__c") * chunk_steps), F.least("__b", (F.col("__c") + 1) * chunk_steps - 1))
    return chunks.select(*grid.keys, F.explode(bins).alias("__t")).select(*grid.keys, F.timestamp_seconds(F.col("__t") * grid.step).alias(grid.time))


def row_missing(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Flag of rows in which every one of the columns is missing."""
    own = [c for c in columns if not c.endswith("_imputed")]
    return df.withColumn("row_missing", F.coalesce(*[F.col(c) for c in own]).isNull().cast("tinyint"))


def harmonise(df: DataFrame, rename: Mapping[str, str], kinds: Mapping[str, str] | None = None) -> DataFrame:
    df = df.withColumnsRenamed({k: v for k, v in rename.items() if k in df.columns})
    return df.withColumns({c: F.col(c).cast(k) for c, k in (kinds or {}).items() if c in df.columns})


def keep_last(df: DataFrame, by: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """Of rows with equal `by` the last in the given order, as one grouped aggregate (combined before the shuffle)."""
    rest = [c for c in df.columns if c not in by]
    order = [F.col(c) if isinstance(c, str) else c for c in order]
    best = df.groupBy(*by).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("__r"))
    return best.select(*by, "__r.*").select(*df.columns)


def time_steps(df: DataFrame, grid: Grid) -> DataFrame:
    """One row: missing times, repeated ones, steps other than the grid's, and rows."""
    d = previous_time(df.select(*grid.keys, F.col(grid.time)), grid, "__p").select(F.col(grid.time), (F.unix_seconds(grid.time) - F.unix_seconds("__p")).alias("d"))
    return d.agg(F.count_if(F.col(grid.time).isNull()).alias("nulls"), F.count_if(F.col("d") == 0).alias("repeats"), F.count_if((F.col("d") != grid.step) & (F.col("d") != 0)).alias("odd"), F.count("*").alias("n"))


def check_time(df: DataFrame, grid: Grid) -> list[str]:
    """What is wrong with the time column: missing, repeated, or not in steps of the grid."""
    r = time_steps(df, grid).first()
    out = [f"{r['nulls']} missing times"] * (r["nulls"] > 0) + [f"{r['repeats']} repeated times"] * (r["repeats"] > 0)
    return out + [f"{r['odd']} steps other than {grid.step} s"] * (r["odd"] > 0 and r["n"] > 2)


def _columns(df: DataFrame, required: Sequence[str]) -> tuple[list[str], list[str]]:
    """What is wrong with the columns of a frame, and those of them that can be looked into."""
    kinds = dict(df.dtypes)
    out = [f"{c} is missing" for c in required if c not in kinds]
    out += [f"{c} is {kinds[c]}, not double" for c in required if kinds.get(c, "double") not in ("double", "float")]
    return out, [c for c in required if kinds.get(c) in ("double", "float")]


def merged_rules(df: DataFrame) -> tuple[list[str], dict[str, Column]]:
    """What is wrong with the columns of a merged frame, and conditions that none of its rows may meet."""
    out, there = _columns(df, MERGED_COLUMNS)
    has, rules = set(df.columns), {f"{c} has infinite values": F.abs(F.col(c)) == F.lit(float("inf")) for c in there}
    if "mlt" in has:
        rules["mlt is outside [0, 24)"] = (F.col("mlt") < 0) | (F.col("mlt") >= 24)
    if "kp" in has:
        rules["kp is outside [0, 9]"] = (F.col("kp") < 0) | (F.col("kp") > 9)
    return out, rules | {f"{c} is not 0 or 1": ~F.col(c).isin(0, 1) for c in df.columns if c.endswith("_imputed")}


def feature_rules(df: DataFrame, columns: Sequence[str], target: str = "log_flux_e2") -> tuple[list[str], dict[str, Column]]:
    out, there = _columns(df, [*dict.fromkeys([*columns, *KNOWN_FUTURE, target])])
    return out, {f"{c} has infinite values": F.abs(F.col(c)) == F.lit(float("inf")) for c in there}


def with_time_rules(df: DataFrame, grid: Grid) -> tuple[DataFrame, dict[str, Column]]:
    """df with a column `__previous`, the time of the row before, and conditions on it: missing, repeated or odd steps."""
    d = previous_time(df, grid, "__previous")
    step = F.unix_seconds(grid.time) - F.unix_seconds("__previous")
    return d, {"missing times": F.col(grid.time).isNull(), "repeated times": step == 0, f"steps other than {grid.step} s": (step != grid.step) & (step != 0)}


def _counted(df: DataFrame, out: list[str], rules: Mapping[str, Column]) -> list[str]:
    r = df.agg(*[F.count_if(F.coalesce(c, F.lit(False))).alias(f"c{i}") for i, c in enumerate(rules.values())]).first() if rules else []
    return out + [f"{name} ({r[i]} rows)" for i, name in enumerate(rules) if r[i]]


def validate_merged(df: DataFrame) -> list[str]:
    """Problems of a merged frame, found in one aggregate pass."""
    return _counted(df, *merged_rules(df))


def validate_features(df: DataFrame, columns: Sequence[str], target: str = "log_flux_e2") -> list[str]:
    return _counted(df, *feature_rules(df, columns, target))


def merge_pair(left: DataFrame, right: DataFrame, on: Sequence[str] = ("time",), how: str = "inner") -> DataFrame:
    """Join on time; columns that both sides have are the left's."""
    return left.join(right.drop(*[c for c in right.columns if c in left.columns and c not in on]), list(on), how)


def merge_sources(frames: Sequence[DataFrame], on: Sequence[str] = ("time",), how: str = "full_outer") -> DataFrame:
    """Earlier frames take precedence: a later one adds only the columns that are new."""
    if not frames:
        raise ValueError("no frames to merge")
    return reduce(lambda a, b: merge_pair(a, b, on, how), frames)


def shift_ballistic(df: DataFrame, grid: Grid, columns: Sequence[str], speed: str = "vsw", keep_lag: bool = False) -> DataFrame:
    """Move each row to its arrival time; of rows that arrive together the one measured last stays; then re-grid by means."""
    lag = ballistic_lag(F.col(speed))
    moved = df.withColumn("lag_min", lag).withColumn("__from", F.col(grid.time))
    moved = moved.withColumn(grid.time, F.timestamp_micros(F.unix_micros(grid.time) + F.floor(F.col("lag_min") * 60e6).cast("bigint")))
    moved = keep_last(moved, [*grid.keys, grid.time], ["__from"])
    return resample(moved, grid, [*columns, *(["lag_min"] if keep_lag else [])])


def align(geo: DataFrame, upstream: DataFrame, grid: Grid, columns: Sequence[str], method: str = "ballistic", how: str = "inner") -> DataFrame:
    """Join ground truth and upstream drivers, these moved ballistically unless they already are."""
    if method not in ("ballistic", "preshifted", "omni"):
        raise ValueError(f"unknown method {method!r}")
    if method == "ballistic":
        upstream = shift_ballistic(upstream, grid, columns)
    return merge_pair(geo, upstream, (*grid.keys, grid.time), how)


def replace_channels(mirror: DataFrame, fresh: DataFrame, on: Sequence[str] = ("time",)) -> DataFrame:
    """Rows of mirror; channels that fresh has too are fresh's, missing values included."""
    common = [c for c in fresh.columns if c in mirror.columns and c not in on]
    j = mirror.drop(*common).join(fresh.select(*on, *common), list(on), "left")
    return j.select(*mirror.columns)


def deviations(a: DataFrame, b: DataFrame, columns: Sequence[str], on: Sequence[str] = ("time",), rtol: float = 1e-6, atol: float = 1e-3) -> DataFrame:
    """Per channel the largest difference on common values and how many exceed the tolerance."""
    j = a.select(*on, *[F.col(c).alias(f"a_{c}") for c in columns]).join(b.select(*on, *[F.col(c).alias(f"b_{c}") for c in columns]), list(on))
    long = j.select(F.explode(F.array(*[F.struct(F.lit(c).alias("channel"), F.col(f"a_{c}").alias("a"), F.col(f"b_{c}").alias("b")) for c in columns])).alias("x")).select("x.*")
    d = F.abs(F.col("a") - F.col("b"))
    return long.groupBy("channel").agg(F.max(d).alias("max_abs"), F.count_if(d > F.lit(atol) + F.lit(rtol) * F.abs("b")).alias("n_off"), F.count(d).alias("n"))


def fill_absent(df: DataFrame, constants: Mapping[str, float], copies: Mapping[str, str] | None = None) -> DataFrame:
    """Columns that are absent or wholly missing become constants, or copies of another column."""
    wanted = [c for c in {**constants, **(copies or {})} if c in df.columns]
    counts = df.agg(F.count(F.lit(1)).alias("__n"), *[F.count(c).alias(c) for c in wanted]).first()
    empty = [c for c in {**constants, **(copies or {})} if c not in df.columns or not counts[c]]
    return df.withColumns({c: F.lit(constants[c]).cast("double") if c in constants else F.col(copies[c]) for c in empty})


def rescale_kp(df: DataFrame) -> DataFrame:
    """An index stored times ten (its maximum is above 9) is brought back."""
    high = (df.agg(F.max("kp")).first()[0] or 0) > 9
    return df.withColumn("kp", F.col("kp") / 10) if high else df
