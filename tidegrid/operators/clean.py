"""Spikes, gaps and interpolation on a uniform grid."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dynamic_pressure, log10_floor, or_mask
from ..schema import MAD_TO_SIGMA, Grid, Settings
from .grid import keep_last
from .halo import CHUNK_STEPS, carried, names, surrounded, windowed


def _median(c: Column) -> Column:
    return F.percentile(c, F.lit(0.5))


def hampel(df: DataFrame, grid: Grid, columns: Sequence[str] | str, window: int = 7, n_sigma: float = 3.0, replace: str = "null", chunk_steps: int = CHUNK_STEPS) -> DataFrame:
    """Outliers against a centred running median become missing (or the median); adds `<column>_outlier`."""
    if window % 2 == 0 or replace not in ("null", "median"):
        raise ValueError("window must be odd and replace null or median")
    cols, half = names(columns), window // 2

    def add(d, w):
        frame = w.rowsBetween(-half, half)
        d = d.withColumns({f"__m_{c}": _median(F.col(c)).over(frame) for c in cols})
        d = d.withColumns({f"__d_{c}": F.abs(F.col(c) - F.col(f"__m_{c}")) for c in cols})
        d = d.withColumns({f"__s_{c}": _median(F.col(f"__d_{c}")).over(frame) for c in cols})
        d = d.withColumns({f"{c}_outlier": F.coalesce(F.col(f"__d_{c}") > n_sigma * MAD_TO_SIGMA * F.col(f"__s_{c}"), F.lit(False)) for c in cols})
        d = d.withColumns({c: F.when(~F.col(f"{c}_outlier"), F.col(c)).otherwise(F.col(f"__m_{c}") if replace == "median" else F.lit(None)) for c in cols})
        return d.drop(*[f"__{k}_{c}" for k in "mds" for c in cols])

    return windowed(df, grid, 2 * half, 2 * half, add, chunk_steps)


def gap_lengths(df: DataFrame, grid: Grid, column: str, name: str = "gap_len", chunk_steps: int = CHUNK_STEPS) -> DataFrame:
    """Length in steps of the run of missing values a row is part of, 0 where there is a value; of any length."""
    d = surrounded(df, grid, F.col(column).isNotNull(), chunk_steps)
    run = (F.coalesce("__after", F.col("__last") + grid.step) - F.coalesce("__before", F.col("__first") - grid.step)) / grid.step - 1
    return d.withColumn(name, F.when(F.col(column).isNull(), run).otherwise(0).cast("bigint")).drop("__before", "__after", "__first", "__last")


def gap_classes(df: DataFrame, grid: Grid, column: str, max_gap: int, chunk_steps: int = CHUNK_STEPS) -> DataFrame:
    """short_gap and long_gap flags."""
    d = gap_lengths(df, grid, column, "__len", chunk_steps)
    return d.withColumns({"short_gap": F.col("__len").between(1, max_gap), "long_gap": F.col("__len") > max_gap}).drop("__len")


def interpolate_short(df: DataFrame, grid: Grid, columns: Sequence[str] | str, max_gap: int, mask_edges: bool = False, chunk_steps: int = CHUNK_STEPS) -> DataFrame:
    """Fill interior gaps of at most max_gap steps linearly in time; adds `<column>_imputed`.

    Context of max_gap + 1 rows tells short from long gaps, so this needs no global pass. Gaps at either end of a series
    are not filled; with mask_edges those short enough are still marked.
    """
    cols = names(columns)

    def add(d, w):
        back, ahead = w.rowsBetween(-(max_gap + 1), 0), w.rowsBetween(0, max_gap + 1)
        t = F.unix_seconds(F.col(grid.time))
        new = {}
        for c in cols:
            known = F.when(F.col(c).isNotNull(), t)
            new |= {f"__pt_{c}": F.last(known, ignorenulls=True).over(back), f"__nt_{c}": F.first(known, ignorenulls=True).over(ahead)}
            new |= {f"__pv_{c}": F.last(c, ignorenulls=True).over(back), f"__nv_{c}": F.first(c, ignorenulls=True).over(ahead)}
        d = d.withColumns(new | {"__rb": F.count(F.lit(1)).over(back), "__ra": F.count(F.lit(1)).over(ahead)})
        out = {}
        for c in cols:
            pt, nt, pv, nv = (F.col(f"__{k}_{c}") for k in ("pt", "nt", "pv", "nv"))
            short = F.col(c).isNull() & ((nt - pt) <= (max_gap + 1) * grid.step)
            value = pv + (nv - pv) * (t - pt) / (nt - pt)
            out[c] = F.when(short, value).otherwise(F.col(c))
            mark = F.coalesce(short, F.lit(False))
            if mask_edges:  # an end of the series is within reach on one side, a value on the other
                lead = F.col(c).isNull() & pt.isNull() & (F.col("__rb") - 1 + (nt - t) / grid.step <= max_gap)
                trail = F.col(c).isNull() & nt.isNull() & ((t - pt) / grid.step + F.col("__ra") - 1 <= max_gap)
                mark = mark | F.coalesce(lead, F.lit(False)) | F.coalesce(trail, F.lit(False))
            out[f"{c}_imputed"] = mark.cast("tinyint")
        return d.withColumns(out).drop(*[f"__{k}_{c}" for k in ("pt", "nt", "pv", "nv") for c in cols], "__rb", "__ra")

    return windowed(df, grid, max_gap + 1, max_gap + 1, add, chunk_steps)


def forward_fill(df: DataFrame, grid: Grid, columns: Sequence[str] | str, chunk_steps: int = CHUNK_STEPS) -> DataFrame:
    cols = names(columns)
    d = carried(df, grid, {f"__f_{c}": F.col(c) for c in cols}, chunk_steps)
    return d.withColumns({c: F.col(f"__f_{c}") for c in cols}).drop(*[f"__f_{c}" for c in cols])


def preprocess(df: DataFrame, grid: Grid, channels: Sequence[str], settings: Settings | None = None, order: Sequence[str] = ()) -> DataFrame:
    """Deduplicate, despike, fill short gaps, derive pressure and log fluxes; masks of earlier steps are kept."""
    s = settings or Settings()
    if order:
        df = keep_last(df, [*grid.keys, grid.time], order)
    old = [c for c in df.columns if c.endswith("_imputed")]
    df = df.withColumnsRenamed({c: f"__old_{c}" for c in old})
    df = hampel(df, grid, channels, s.hampel_window, s.hampel_sigma)
    df = interpolate_short(df, grid, channels, s.max_gap).drop(*[f"{c}_outlier" for c in channels])
    df = df.withColumns({c: or_mask(F.col(f"__old_{c}"), F.col(c)) if c in df.columns else F.col(f"__old_{c}") for c in old}).drop(*[f"__old_{c}" for c in old])
    if {"density", "vsw"} <= set(df.columns):
        df = df.withColumn("pdyn", dynamic_pressure(F.col("density"), F.col("vsw")))
    return df.withColumns({f"log_{c}": log10_floor(F.col(c)) for c in ("flux_e2", "flux_seed") if c in df.columns})
