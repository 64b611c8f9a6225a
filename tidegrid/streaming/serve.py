"""Serving side of the online plan: forecasts per micro-batch, by a chain of predictors; a bounded cache; answers and pushes."""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import alert_level, iso_utc
from ..plans.models import Forecaster, lut_forecast
from ..schema import ALERT_LOG10, HORIZON_STEPS
from ..sources.folders import read_version
from .online import keep_latest


class ForecastCache:
    """The most recently used `size` entries, with counts of hits and misses."""

    def __init__(self, size: int = 256):
        if size < 1:
            raise ValueError("size must be positive")
        self.size, self.held, self.hits, self.misses = size, OrderedDict(), 0, 0

    def get(self, key):
        if key not in self.held:
            self.misses += 1
            return None
        self.hits += 1
        self.held.move_to_end(key)
        return self.held[key]

    def put(self, key, value) -> None:
        self.held[key] = value
        self.held.move_to_end(key)
        if len(self.held) > self.size:
            self.held.popitem(last=False)

    def __len__(self) -> int:
        return len(self.held)


def predict_chain(df: DataFrame, predictors: Sequence[Forecaster], table: Sequence[tuple[float, float]], horizons: Mapping[str, int] | None = None, threshold: float = ALERT_LOG10) -> DataFrame:
    """Forecast columns of every horizon, row by row from the first fitted predictor that has all of them for the row, else from the fixed table by local time; adds `model`."""
    horizons = dict(horizons or HORIZON_STEPS)
    names = [f"{h}_{c}" for h in horizons for c in ("q10", "q50", "q90", "pred", "p")]
    own, d, steps = df.columns, df, []
    for i, p in enumerate(x for x in predictors if x.fitted):
        d = p.predict(d).withColumnsRenamed({n: f"__{i}_{n}" for n in names})
        whole = F.lit(True)
        for n in names:
            whole = whole & F.col(f"__{i}_{n}").isNotNull()
        steps.append((whole, p.name, {n: F.col(f"__{i}_{n}") for n in names}))
    mlt = d if "mlt" in d.columns else d.withColumn("mlt", F.lit(None).cast("double"))
    d = lut_forecast(mlt, table, threshold=threshold)
    last = {f"{h}_{c}": F.col(f) for h in horizons for c, f in (("q10", "q10"), ("q50", "q50"), ("q90", "q90"), ("pred", "q50"), ("p", "p"))}

    def first(pick) -> Column:
        out = pick("table", last)
        for whole, name, columns in reversed(steps):
            out = F.when(whole, pick(name, columns)).otherwise(out)
        return out

    return d.select(*own, *[first(lambda name, columns, n=n: columns[n]).alias(n) for n in names], first(lambda name, columns: F.lit(name)).alias("model"))


def forecast_rows(df: DataFrame, horizons: Mapping[str, int] | None = None) -> DataFrame:
    """sat_id, time, issued_utc, model and per horizon flux quantiles, probability and alert level as a map."""
    horizons = dict(horizons or HORIZON_STEPS)
    ten = lambda c: F.pow(F.lit(10.0), F.col(c))
    one = lambda h: F.struct(ten(f"{h}_q10").alias("q10"), ten(f"{h}_q50").alias("q50"), ten(f"{h}_q90").alias("q90"), F.col(f"{h}_p").alias("p_exceed"), alert_level(F.col(f"{h}_p")).alias("level"))
    return df.select("sat_id", "time", iso_utc(F.col("time")).alias("issued_utc"), "model", F.create_map(*[x for h in horizons for x in (F.lit(h), one(h))]).alias("horizons"))


def refresh(path: str, predictors: Sequence[Forecaster], table: Sequence[tuple[float, float]], horizons: Mapping[str, int] | None = None, threshold: float = ALERT_LOG10):
    """For foreachBatch over feature rows: forecast the newest row of each series and keep it in the table at `path`."""
    store = keep_latest(path)

    def run(batch: DataFrame, epoch: int) -> None:
        rest = [c for c in batch.columns if c != "sat_id"]
        newest = batch.groupBy("sat_id").agg(F.max_by(F.struct(*rest), "time").alias("r")).select("sat_id", "r.*")
        store(forecast_rows(predict_chain(newest, predictors, table, horizons, threshold), horizons), epoch)

    return run


def every(stream: DataFrame, action: Callable[[DataFrame, int], None], checkpoint: str, seconds: int = 60):
    """Run an action on each micro-batch of an interval."""
    return stream.writeStream.foreachBatch(action).option("checkpointLocation", checkpoint).trigger(processingTime=f"{seconds} seconds").start()


def answer(spark: SparkSession, path: str, sat_id: str, horizon: str | None = None) -> tuple[int, dict]:
    """Status and body: 503 while there is no forecast, 404 for an unknown horizon."""
    table = read_version(spark, path)
    row = table.where(F.col("sat_id") == sat_id).first() if table is not None else None
    if row is None:
        return 503, {"detail": "no forecast yet"}
    body = row.asDict(recursive=True)
    if horizon is None:
        return 200, body
    if horizon not in body["horizons"]:
        return 404, {"detail": f"unknown horizon {horizon!r}; known are {sorted(body['horizons'])}"}
    return 200, {"issued_utc": body["issued_utc"], "model": body["model"], **body["horizons"][horizon]}


def check_vector(vector: Sequence[float], n: int) -> tuple[int, dict]:
    """422 for a vector of the wrong length."""
    return (200, {}) if len(vector) == n else (422, {"detail": f"{len(vector)} values, not {n}"})


def push_changes(send: Callable[[dict], None]):
    """For foreachBatch over forecast rows: send a series' forecast when its time of issue has changed."""
    issued: dict[str, str] = {}

    def run(batch: DataFrame, epoch: int) -> None:
        newest = batch.groupBy("sat_id").agg(F.max("issued_utc").alias("issued_utc"))
        for r in batch.join(newest, ["sat_id", "issued_utc"]).toLocalIterator():  # a row per series
            if issued.get(r["sat_id"]) != r["issued_utc"]:
                issued[r["sat_id"]] = r["issued_utc"]
                send(r.asDict(recursive=True))

    return run
