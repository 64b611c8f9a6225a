"""Windows for training, stored once and cut when they are read.

A grid is stored as chunks of consecutive rows, each value once; windows as rows that say where each one ends in which
chunk. So the folder grows with the grid, whatever the lookback, where arrays per window would hold each value as many
times as a window is long. Reading joins each chunk with its neighbours and its windows, and cuts strided views of the
values, a bounded batch at a time; nothing but the batch that is being handed on holds a value twice.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.windows import anchors
from ..schema import DECODER_STEPS, KNOWN_FUTURE, Grid
from .sinks import load_state, save_state

CHUNK_STEPS = 4096
#: Bytes of the tensors in one batch that a reader hands on.
BATCH_BYTES = 16 << 20


def write_windows(
    df: DataFrame, grid: Grid, features: Sequence[str], target: str, path: str, lookback: int, *, decoder: int = DECODER_STEPS, horizons: Mapping[str, int] | None = None, threshold: float = 3.0,
    future: Sequence[str] = KNOWN_FUTURE, drop_missing: bool = True, keep: Sequence[str] = (), chunk_steps: int = CHUNK_STEPS,
) -> None:
    """The windows that anchors() finds on a complete grid: chunks of values, and a row for each window."""
    steps = max(chunk_steps, lookback, decoder)
    future = [c for c in future if c in df.columns]
    at = F.floor(F.unix_seconds(grid.time) / grid.step).cast("long")
    place = {"chunk": F.floor(at / steps).cast("long"), "at": at}
    cells = lambda cols: F.array(*[F.col(c).cast("float") for c in cols])
    rows = F.array_sort(F.collect_list(F.struct("at", cells(features).alias("x"), cells(future).alias("f"))))
    chunks = df.withColumns(place).groupBy(*grid.keys, "chunk").agg(F.min("at").alias("first"), rows.alias("r"))
    flat = [F.flatten(F.col(f"r.{n}")).alias(n) for n in ("x", "f")]
    chunks.select(*grid.keys, "chunk", "first", F.size("r").alias("n"), *flat).write.mode("overwrite").parquet(f"{path}/chunks")
    found = anchors(df, grid, features, target, lookback, decoder=decoder, horizons=horizons, threshold=threshold, future=future, drop_missing=drop_missing, keep=keep)
    found.withColumns(place).write.mode("overwrite").parquet(f"{path}/windows")
    save_state(df.sparkSession, {"keys": list(grid.keys), "time": grid.time, "lookback": lookback, "decoder": decoder, "features": list(features), "future": future}, f"{path}/shape")


def views(values: np.ndarray, ends: np.ndarray, length: int) -> np.ndarray:
    """Windows of `length` rows ending before each of `ends`, as views of the values: (windows, length, columns)."""
    return np.lib.stride_tricks.sliding_window_view(values, length, axis=0)[ends - length].transpose(0, 2, 1)


def _floats(b: pa.RecordBatch, column: str, i: int, width: int) -> np.ndarray:
    cells = b.column(column)[i].values
    return np.empty((0, width), dtype=np.float32) if cells is None else cells.to_numpy(zero_copy_only=False).astype(np.float32, copy=False).reshape(-1, width)


def _nested(tensor: np.ndarray) -> pa.Array:
    n, rows, cols = tensor.shape
    cells = pa.array(np.ascontiguousarray(tensor).ravel(), pa.float32(), from_pandas=True)
    inner = pa.ListArray.from_arrays(np.arange(0, n * rows * cols + 1, cols, dtype=np.int32), cells)
    return pa.ListArray.from_arrays(np.arange(0, n * rows + 1, rows, dtype=np.int32), inner)


def _cut(shape: dict, batch_bytes: int):
    lookback, decoder, width, known = shape["lookback"], shape["decoder"], len(shape["features"]), len(shape["future"])
    per = max(1, batch_bytes // (4 * (lookback * width + decoder * known)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                x = np.concatenate([_floats(b, c, i, width) for c in ("before_x", "x")])
                f = np.concatenate([_floats(b, c, i, known) for c in ("f", "after_f")]) if known else None
                first, behind = b.column("first")[i].as_py(), len(x) - b.column("n")[i].as_py()
                w = b.column("w")[i].values
                at = w.field("at").to_numpy() - first + 1
                for lo in range(0, len(at), per):
                    part, ends = w.slice(lo, per), at[lo : lo + per]
                    cols = {w.type.field(j).name: part.field(j) for j in range(w.type.num_fields) if w.type.field(j).name != "at"} | {"X": _nested(views(x, ends + behind, lookback))}
                    if known:
                        cols["X_future"] = _nested(views(f, ends + decoder, decoder))
                    yield pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))

    return run


def read_windows(spark: SparkSession, path: str, where: str | None = None, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """Windows (those that meet a condition on their own columns) with X and, if any future columns were stored, X_future, as anchors(arrays=True) gives them."""
    shape, chunks, windows = load_state(spark, f"{path}/shape"), spark.read.parquet(f"{path}/chunks"), spark.read.parquet(f"{path}/windows")
    keys, own = shape["keys"], [c for c in windows.columns if c not in ("chunk", "at")]
    if where:
        windows = windows.where(where)
    per = windows.groupBy(*keys, "chunk").agg(F.collect_list(F.struct(*own, "at")).alias("w"))  # at most as many as a chunk has rows
    before = chunks.select(*keys, (F.col("chunk") + 1).alias("chunk"), F.col("x").alias("before_x"))
    after = chunks.select(*keys, (F.col("chunk") - 1).alias("chunk"), F.col("f").alias("after_f"))
    all_of = per.join(chunks, [*keys, "chunk"]).join(before, [*keys, "chunk"], "left").join(after, [*keys, "chunk"], "left")
    kinds = dict(windows.dtypes)
    out = ", ".join([f"`{c}` {kinds[c]}" for c in own] + ["X array<array<float>>"] + ["X_future array<array<float>>"] * bool(shape["future"]))
    return all_of.select("first", "n", "x", "f", "before_x", "after_f", "w").mapInArrow(_cut(shape, batch_bytes), out)
