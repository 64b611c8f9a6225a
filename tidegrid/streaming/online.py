"""Online features: state of bounded size per series, in order of event time, equal to the batch windows; event-time grids; latest tables."""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..functions import add_coupling, add_cyclic
from ..operators.clean import forward_fill
from ..operators.halo import carried, rows_windowed
from ..operators.windows import LAGS, ROLLING, feature_matrix
from ..schema import CADENCE_S, Grid
from ..sources.folders import update_version


class RingBuffer:
    """The last `size` values; 0 is the oldest, -1 the newest."""

    def __init__(self, size: int, values=()):
        if size < 1:
            raise ValueError("size must be positive")
        self.data = deque(values, maxlen=size)

    def append(self, x: float) -> float | None:
        """The value that falls out, if one does."""
        out = self.data[0] if len(self.data) == self.data.maxlen else None
        self.data.append(x)
        return out

    def values(self) -> list[float]:
        return list(self.data)

    def __getitem__(self, i: int) -> float:
        return self.data[i]

    def __len__(self) -> int:
        return len(self.data)


class Welford:
    """Mean and spread that take values in and out."""

    def __init__(self, n: int = 0, mean: float = 0.0, m2: float = 0.0):
        self.n, self.mean, self.m2 = n, mean, m2

    def update(self, x: float) -> None:
        self.n += 1
        d = x - self.mean
        self.mean += d / self.n
        self.m2 += d * (x - self.mean)

    def remove(self, x: float) -> None:
        if not self.n:
            raise ValueError("nothing to remove")
        if self.n == 1:
            self.__init__()
            return
        d = x - self.mean
        self.mean -= d / (self.n - 1)
        self.m2 = max(0.0, self.m2 - d * (x - self.mean))
        self.n -= 1

    def variance(self) -> float | None:
        return self.m2 / self.n if self.n else None

    def sample_variance(self) -> float | None:
        return self.m2 / (self.n - 1) if self.n > 1 else None

    def std(self) -> float | None:
        return math.sqrt(self.m2 / (self.n - 1)) if self.n > 1 else None

    def zscore(self, x: float) -> float:
        s = math.sqrt(self.m2 / self.n) if self.n else 0.0
        return (x - self.mean) / s if s > 0 else 0.0


class MonotonicDeque:
    """Extreme of the last `window` samples."""

    def __init__(self, window: int, largest: bool = True):
        self.window, self.largest, self.items, self.i = window, largest, deque(), 0

    def push(self, x: float) -> float:
        worse = (lambda a: a <= x) if self.largest else (lambda a: a >= x)
        while self.items and worse(self.items[-1][1]):
            self.items.pop()
        self.items.append((self.i, x))
        self.i += 1
        while self.items[0][0] <= self.i - 1 - self.window:
            self.items.popleft()
        return self.items[0][1]


#: Setting that stateful features need; the session's owner makes it.
ROCKSDB = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
FEATURES = ("n", "mean", "std", "high", "low", "lag1")

Rolling = Mapping[str, Sequence[tuple[int, str]]]


#: Fewer samples than this are taken one by one.
FEW = 32
#: Values of windows that are looked at together.
BLOCK = 1 << 18


def _over_windows(values: np.ndarray, first: int, n: int, stats: Sequence[str]) -> dict[str, np.ndarray]:
    """Of the last `n` values up to each place from `first` on (fewer at the start), each of `stats`."""
    total = len(values) - first
    out = {s: np.full(total, np.nan) for s in stats}

    def put(to: slice, w: np.ndarray) -> None:
        size = w.shape[1]
        mean = w.sum(axis=1) / size
        for s in stats:
            if s == "std":
                out[s][to] = np.sqrt(((w - mean[:, None]) ** 2).sum(axis=1) / (size - 1)) if size > 1 else np.nan
            else:
                out[s][to] = size if s == "n" else mean if s == "mean" else w.max(axis=1) if s == "max" else w.min(axis=1)

    short = min(total, max(0, n - 1 - first))
    for i in range(short):
        put(slice(i, i + 1), values[None, : first + i + 1])
    if short < total:
        wide = np.lib.stride_tricks.sliding_window_view(values[first + short - n + 1 :], n)
        step = max(1, BLOCK // n)
        for i in range(0, len(wide), step):
            put(slice(short + i, short + min(i + step, len(wide))), wide[i : i + step])
    return out


class Channel:
    """One channel of a series: its last values; moments that take values in and out; deques of extremes.

    `push` takes one sample; moments are then summed anew from the kept values once a width, so errors of going in and
    out do not build up. `take` takes many, all windows of a block at a time, and leaves what `push` would have left.
    """

    SCHEMA = "seen long, values array<double>, moments array<double>, sizes array<int>, places array<long>, tops array<double>"

    def __init__(self, lags: Sequence[int], rolling: Sequence[tuple[int, str]], held: tuple | None = None):
        seen, values, moments, sizes, places, tops = held or (0, [], [], [], [], [])
        self.seen, self.recent = seen, RingBuffer(max([1, *(k + 1 for k in lags), *(n for n, _ in rolling)]), values)
        self.moments = {n: Welford() for n in sorted({n for n, s in rolling if s in ("n", "mean", "std")})}
        for k, m in enumerate(self.moments.values()):
            if moments:
                m.n, m.mean, m.m2 = int(moments[3 * k]), moments[3 * k + 1], moments[3 * k + 2]
        self.extremes = {(n, s): MonotonicDeque(n, s == "max") for n, s in sorted({(n, s) for n, s in rolling if s in ("max", "min")})}
        at = 0
        for d, size in zip(self.extremes.values(), sizes, strict=False):
            d.i, d.items = seen, deque(zip(places[at : at + size], tops[at : at + size], strict=True))
            at += size

    def state(self) -> tuple:
        items = [i for d in self.extremes.values() for i in d.items]
        return (
            self.seen, self.recent.values(), [float(v) for m in self.moments.values() for v in (m.n, m.mean, m.m2)], [len(d.items) for d in self.extremes.values()], [i for i, _ in items], [x for _, x in items],
        )

    def push(self, x: float) -> None:
        for n, m in self.moments.items():
            if len(self.recent) >= n:
                m.remove(self.recent[-n])
            m.update(x)
        for d in self.extremes.values():
            d.push(x)
        self.recent.append(x)
        self.seen += 1
        for n, m in self.moments.items():
            if self.seen % n == 0:
                m.mean = math.fsum(self.recent[-i] for i in range(1, n + 1)) / n
                m.m2 = math.fsum((self.recent[-i] - m.mean) ** 2 for i in range(1, n + 1))

    def repeat(self) -> None:
        """A missing sample repeats the last one."""
        if len(self.recent):
            self.push(self.recent[-1])

    def take(self, xs: np.ndarray, lags: Sequence[int], rolling: Sequence[tuple[int, str]]) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
        """Value, lags and rolling values after each of `xs`; a missing sample repeats the last one. Undefined ones are NaN."""
        if len(xs) < FEW:
            rows = []
            for x in xs.tolist():
                self.repeat() if math.isnan(x) else self.push(x)
                rows.append([self.lag(0), *[self.lag(k) for k in lags], *[self.over(n, s) for n, s in rolling]])
            cols = list(np.array(rows, dtype=float).reshape(len(xs), 1 + len(lags) + len(rolling)).T)
            return cols[0], cols[1 : 1 + len(lags)], cols[1 + len(lags) :]
        old = np.array(self.recent.values(), dtype=float)
        last = np.maximum.accumulate(np.where(np.isnan(xs), -1, np.arange(len(xs))))
        skip = 0 if len(old) else int((last < 0).sum())  # nothing to repeat yet
        new = np.where(last >= 0, xs[last], old[-1] if len(old) else np.nan)[skip:]
        values, first = np.concatenate([old, new]), len(old)

        def placed(col: np.ndarray) -> np.ndarray:
            return np.concatenate([np.full(len(xs) - len(col), np.nan), col])

        stats = {n: [s for m, s in rolling if m == n] for n, _ in rolling}
        with np.errstate(invalid="ignore", over="ignore"):
            over = {n: _over_windows(values, first, n, of) for n, of in stats.items()}
        out = placed(new), [placed(values[max(0, first - k) : max(0, len(values) - k)]) for k in lags], [placed(over[n][s]) for n, s in rolling]
        self.recent, self.seen = RingBuffer(self.recent.data.maxlen, values[-self.recent.data.maxlen :].tolist()), self.seen + len(new)
        for n, m in self.moments.items():
            w = values[-n:]
            m.n, m.mean = len(w), float(w.mean()) if len(w) else 0.0
            m.m2 = float(((w - m.mean) ** 2).sum())
        for (n, _), d in self.extremes.items():
            w = values[-n:].tolist()
            d.items.clear()
            d.i = self.seen - len(w)
            for x in w:
                d.push(x)
        return out

    def lag(self, k: int) -> float | None:
        return self.recent[-k - 1] if len(self.recent) > k else None

    def over(self, n: int, stat: str) -> float | None:
        if not len(self.recent):
            return None
        if stat in ("max", "min"):
            return self.extremes[n, stat].items[0][1]
        m = self.moments[n]
        return m.std() if stat == "std" else float(m.n) if stat == "n" else m.mean


class OnlineSeries(StatefulProcessor):
    """Per series the features of every sample, in order of event time, whatever order samples come in.

    Samples wait in spans of event time. When the watermark passes a span, its timer takes them, and those of all other
    spans passed, in order of time through the channels, so a late sample stands where it belongs. Samples of one time
    count once: of each channel the largest value that came. What comes for a span already passed is left out. State of
    a series is what waits, in parts as it came, so that what waits is never written twice; and per channel the values of
    the longest lag or width with their moments and extremes.
    """

    #: Values that are gathered before they are put into the state, or go through the channels together.
    GATHER = 1 << 18

    def __init__(self, channels: Sequence[str], lags: Mapping[str, Sequence[int]], rolling: Rolling, span: int):
        self.channels, self.span = list(channels), span * 1_000_000
        self.lags, self.rolling = {c: tuple(lags.get(c, ())) for c in channels}, {c: tuple(rolling.get(c, ())) for c in channels}

    def init(self, handle) -> None:
        self.handle = handle
        self.parts = handle.getMapState("parts", "until long", "n int")
        self.waiting = handle.getMapState("waiting", "until long, part int", "at binary, x binary")
        self.held = handle.getMapState("held", "channel string", Channel.SCHEMA)
        self.done = handle.getValueState("done", "until long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        done = self.done.get()
        came, n = [], 0
        for part in rows:
            at, x = part["us"].to_numpy(dtype="int64"), part[self.channels].to_numpy(dtype=float)
            came.append((at, x))
            n += x.size
            if n >= self.GATHER:
                self._wait(came, done)
                came, n = [], 0
        if came:
            self._wait(came, done)
        return iter(())

    def _wait(self, came: list[tuple[np.ndarray, np.ndarray]], done: tuple | None) -> None:
        """Samples into the spans they belong to, a part more for each."""
        at, x = np.concatenate([a for a, _ in came]), np.concatenate([v for _, v in came])
        until = -(-at // self.span) * self.span
        order = np.argsort(until, kind="stable")
        at, x, until = at[order], x[order], until[order]
        starts = np.flatnonzero(np.diff(until, prepend=until[:1] - 1))
        for i, j in zip(starts.tolist(), [*starts[1:].tolist(), len(at)], strict=True):
            u = int(until[i])
            if done is not None and u <= done[0]:
                continue
            k = int(self.parts.getValue((u,))[0]) if self.parts.containsKey((u,)) else 0
            if not k:
                self.handle.registerTimer(u // 1000)
            self.waiting.updateValue((u, k), (at[i:j].tobytes(), x[i:j].tobytes()))
            self.parts.updateValue((u,), (k + 1,))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now, done = expiredTimerInfo.getExpiryTimeInMs() * 1000, self.done.get()
        if done is not None and now <= done[0]:
            return  # an earlier timer has taken this span along
        passed = max(now, timerValues.getCurrentWatermarkInMs() * 1000)
        due = sorted((int(k[0]), int(v[0])) for k, v in list(self.parts.iterator()) if k[0] <= passed)
        channels = {c: Channel(self.lags[c], self.rolling[c], self.held.getValue((c,)) if self.held.containsKey((c,)) else None) for c in self.channels}
        came, n = [], 0
        for until, parts in due:
            for k in range(parts):
                at, x = self.waiting.getValue((until, k))
                came.append((np.frombuffer(at, dtype="int64"), np.frombuffer(x, dtype=float).reshape(-1, len(self.channels))))
                n += came[-1][1].size
                self.waiting.removeKey((until, k))
            self.parts.removeKey((until,))
            if n >= self.GATHER:
                yield self._features(key[0], came, channels)
                came, n = [], 0
        if came:
            yield self._features(key[0], came, channels)
        for name, c in channels.items():
            self.held.updateValue((name,), c.state())
        self.done.update((max([now, *[u for u, _ in due]]),))

    def _features(self, series: str, came: list[tuple[np.ndarray, np.ndarray]], channels: dict[str, Channel]) -> pd.DataFrame:
        at, x = np.concatenate([a for a, _ in came]), np.concatenate([v for _, v in came])
        order = np.argsort(at, kind="stable")
        at = at[order]
        starts = np.flatnonzero(np.diff(at, prepend=at[:1] - 1))
        x = np.fmax.reduceat(x[order], starts, axis=0)
        taken = [c.take(x[:, i], self.lags[name], self.rolling[name]) for i, (name, c) in enumerate(channels.items())]
        cols = [*[v for v, _, _ in taken], *[v for _, lags, _ in taken for v in lags], *[v for _, _, rolling in taken for v in rolling]]
        return pd.DataFrame(dict(zip(["sat_id", "us", *series_columns(self.channels, self.lags, self.rolling)], [[series] * len(starts), at[starts], *cols], strict=True)))

    def close(self) -> None:
        pass


def series_columns(channels: Sequence[str], lags: Mapping[str, Sequence[int]], rolling: Rolling) -> list[str]:
    return [*channels, *[f"{c}_lag{k}" for c in channels for k in lags.get(c, ())], *[f"{c}_roll{n}_{s}" for c in channels for n, s in rolling.get(c, ())]]


def stream_series(stream: DataFrame, channels: Sequence[str], lags: Mapping[str, Sequence[int]], rolling: Rolling, late: str, span: int) -> DataFrame:
    """Streaming frame (sat_id, time, channels) with lags and rolling values; rows come out once the watermark passes the
    end of their span of `span` seconds. The session must use the RocksDB state store (ROCKSDB)."""
    cols = series_columns(channels, lags, rolling)
    samples = stream.withWatermark("time", late).select("sat_id", "time", F.unix_micros("time").alias("us"), *[F.col(c).cast("double").alias(c) for c in channels])
    out = samples.groupBy("sat_id").transformWithStateInPandas(OnlineSeries(channels, lags, rolling, span), "sat_id string, us long, " + ", ".join(f"{c} double" for c in cols), "Append", "EventTime")
    return out.select("sat_id", F.timestamp_micros("us").alias("time"), *cols)


def stream_features(stream: DataFrame, window: int = 72, late: str = "10 minutes", span: int = CADENCE_S) -> DataFrame:
    """Streaming frame (sat_id, time, x) with its features; a series begins with its first value."""
    named = {"n": F.col(f"x_roll{window}_n").cast("long"), "mean": F.col(f"x_roll{window}_mean"), "std": F.col(f"x_roll{window}_std"), "high": F.col(f"x_roll{window}_max"), "low": F.col(f"x_roll{window}_min"), "lag1": F.col("x_lag1")}
    out = stream_series(stream, ["x"], {"x": (1,)}, {"x": [(window, s) for s in ("n", "mean", "std", "max", "min")]}, late, span)
    return out.where("x IS NOT NULL").select("sat_id", "time", "x", *[named[c].alias(c) for c in FEATURES])


def batch_replay(df: DataFrame, window: int = 72) -> DataFrame:
    """The same features over a batch, by window functions over chunks of each series; rows of equal time go by value."""
    series = Grid(keys=("sat_id",))

    def add(d, w):
        by = w.rowsBetween(-(window - 1), 0)
        return d.select("*", F.count("x").over(by).alias("n"), F.avg("x").over(by).alias("mean"), F.stddev_samp("x").over(by).alias("std"), F.max("x").over(by).alias("high"), F.min("x").over(by).alias("low"), F.lag("x").over(w).alias("lag1"))

    d = carried(df.select("sat_id", "time", "x"), series, {"__x": F.col("x")}).withColumn("x", F.col("__x")).drop("__x").where("x IS NOT NULL")
    return rows_windowed(d, series, window - 1, add, order=("x",)).select("sat_id", "time", "x", "n", "mean", "std", "high", "low", "lag1")


def event_grid(stream: DataFrame, step: str = "5 minutes", late: str = "10 minutes", keys: tuple[str, ...] = ("sat_id",)) -> DataFrame:
    """Means per bin of event time; rows later than `late` behind the newest are left out."""
    g = stream.withWatermark("time", late).groupBy(F.window("time", step), *keys).agg(F.avg("x").alias("x"), F.count("x").alias("n"))
    return g.select(*keys, F.col("window.start").alias("time"), "x", "n")


def without_repeats(stream: DataFrame, late: str = "10 minutes", keys: tuple[str, ...] = ("sat_id", "time")) -> DataFrame:
    """Polls overlap; each sample counts once."""
    return stream.withWatermark("time", late).dropDuplicatesWithinWatermark(list(keys))


def query_id(batch: DataFrame) -> str:
    """The id, kept in its checkpoint, of the streaming query that a foreachBatch function runs for."""
    return batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId") or "batch"


def keep_latest(path: str, keys: tuple[str, ...] = ("sat_id",), query: str | None = None):
    """For foreachBatch: a table with each key's newest row, a new version a batch.

    The version remembers the last batch of each query, by name or else by the id that its checkpoint gives it, so a batch
    that comes again is left out, and several queries may write at the same time. A query with a name that starts anew,
    without its checkpoint, needs a new one.
    """

    def run(batch: DataFrame, epoch: int) -> None:
        def change(old: DataFrame | None) -> DataFrame:
            both = batch if old is None else batch.unionByName(old)
            rest = [c for c in batch.columns if c not in keys]
            return both.groupBy(*keys).agg(F.max_by(F.struct(*rest), "time").alias("r")).select(*keys, "r.*").select(*batch.columns)

        update_version(batch.sparkSession, path, change, marks={query or query_id(batch): epoch})

    return run


#: Channels that a sample brings, carried forward where missing.
CHANNELS = ("log_flux_e2", "log_flux_seed", "vsw", "density", "pdyn", "bz_gsm", "bt", "ae", "al", "kp", "sym_h", "f107")


def stream_vector(stream: DataFrame, lags=LAGS, rolling=ROLLING, late: str = "10 minutes", span: int = CADENCE_S) -> DataFrame:
    """Streaming frame (sat_id, time, channels) with lags and rolling values from state, coupling and cyclic columns as expressions."""
    samples = stream.select("sat_id", "time", *[F.col(c).cast("double").alias(c) if c in stream.columns else F.lit(None).cast("double").alias(c) for c in CHANNELS])
    return add_cyclic(add_coupling(stream_series(samples, CHANNELS, lags, rolling, late, span)))


def batch_vector(df: DataFrame, lags=LAGS, rolling=ROLLING, grid: Grid | None = None) -> DataFrame:
    """The same over a batch on a uniform grid."""
    grid = grid or Grid(keys=("sat_id",))
    d = df.select("sat_id", "time", *[F.col(c).cast("double").alias(c) if c in df.columns else F.lit(None).cast("double").alias(c) for c in CHANNELS])
    return feature_matrix(forward_fill(d, grid, CHANNELS), grid, lags, rolling)
