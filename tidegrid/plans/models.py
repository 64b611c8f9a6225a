"""Forecasters over anchor frames.

An anchor frame has one row per time with the last target value, model inputs and targets y_<horizon>. Every forecaster
adds, per horizon h, the columns `<h>_q10, <h>_q50, <h>_q90, <h>_pred, <h>_p` (probability of reaching the threshold).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import ClassVar

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import gaussian_quantiles, logistic_exceedance, lut_bin, survival
from ..operators.quantiles import exact_quantiles
from ..schema import ALERT_LOG10, HORIZON_STEPS, QUANTILES
from ..sources.sinks import load_state, save_state
from . import trees


class Forecaster:
    """Fit on an anchor frame, then add forecast columns to another."""

    name: ClassVar[str] = "abstract"

    def __init__(self, horizons: Mapping[str, int] | None = None, threshold: float = ALERT_LOG10, **params):
        self.horizons, self.threshold, self.params, self.fitted = dict(horizons or HORIZON_STEPS), threshold, params, False

    def fit(self, df: DataFrame) -> Forecaster:
        self.fitted = True
        return self

    def predict(self, df: DataFrame) -> DataFrame:
        raise NotImplementedError

    def _require(self) -> None:
        if not self.fitted:
            raise RuntimeError(f"{self.name} has not been fitted")

    def _columns(self, h: str, q, pred, p) -> dict:
        return {f"{h}_q10": q[0], f"{h}_q50": q[1], f"{h}_q90": q[2], f"{h}_pred": pred, f"{h}_p": p}


class Persistence(Forecaster):
    """The last observed value at every horizon; degenerate quantiles, probability 0 or 1."""

    name = "persistence"

    def predict(self, df: DataFrame) -> DataFrame:
        x = F.col(self.params.get("last", "last"))
        return df.withColumns({k: c for h in self.horizons for k, c in self._columns(h, [x, x, x], x, (x >= self.threshold).cast("double")).items()})


#: Bin number that stands for all rows of a horizon while quantiles are computed.
ALL = -1


class Climatology(Forecaster):
    """Mean, quantiles and exceedance frequency per bin of the target time; unseen bins take those of all rows.

    Columns `bin_<h>` give the bin; the table has at most one row per horizon and bin, bounded by the binning.
    """

    name = "climatology"

    def fit(self, df: DataFrame) -> Climatology:
        long = df.select(F.explode(F.array(*[F.struct(F.lit(h).alias("horizon"), F.col(f"bin_{h}").cast("int").alias("bin"), F.col(f"y_{h}").alias("y")) for h in self.horizons])).alias("r")).select("r.*").where("y IS NOT NULL")
        long = long.withColumn("bin", F.explode(F.array_compact(F.array("bin", F.lit(ALL)))))
        stats = long.groupBy("horizon", "bin").agg(F.avg("y").alias("mean"), F.avg((F.col("y") >= self.threshold).cast("double")).alias("freq"), F.count("*").alias("n"))
        q = exact_quantiles(long, ["horizon", "bin"], "y", QUANTILES)
        table = stats.join(q, ["horizon", "bin"]).select("horizon", F.when(F.col("bin") != ALL, F.col("bin")).alias("bin"), "mean", *[F.col("q")[i].alias(n) for i, n in enumerate(("q10", "q50", "q90"))], "freq", "n")
        self.table = df.sparkSession.createDataFrame(table.collect(), table.schema)  # at most a row per horizon and bin, so it is not computed again
        self.fitted = True
        return self

    def predict(self, df: DataFrame) -> DataFrame:
        self._require()
        for h in self.horizons:
            own = self.table.where((F.col("horizon") == h) & F.col("bin").isNotNull()).select(F.col("bin").alias(f"bin_{h}"), *[F.col(c).alias(f"__{c}") for c in ("mean", "q10", "q50", "q90", "freq")])
            rest = self.table.where((F.col("horizon") == h) & F.col("bin").isNull()).select(*[F.col(c).alias(f"__a_{c}") for c in ("mean", "q10", "q50", "q90", "freq")])
            df = df.join(F.broadcast(own), f"bin_{h}", "left").crossJoin(F.broadcast(rest))  # one row per bin; one row
            pick = {c: F.coalesce(F.col(f"__{c}"), F.col(f"__a_{c}")) for c in ("mean", "q10", "q50", "q90", "freq")}
            q = F.array_sort(F.array(pick["q10"], pick["q50"], pick["q90"]))
            df = df.withColumns(self._columns(h, [q[0], q[1], q[2]], pick["mean"], pick["freq"])).drop(*[f"__{a}{c}" for a in ("", "a_") for c in pick])
        return df


class LinearFilter(Forecaster):
    """Least squares on a few inputs per horizon, Gaussian residuals.

    All horizons come from one aggregate: for each the sums of products of the inputs, the constant and the target over
    rows that have one, which add up over partitions in any order. Inputs are taken relative to a pilot row, so that sums
    of large, nearly equal values keep their digits. The driver solves systems of as many unknowns as inputs.
    """

    name = "refm"

    def fit(self, df: DataFrame) -> LinearFilter:
        self.inputs = list(self.params["inputs"])
        d = df.na.fill(0.0, self.inputs)
        ys = [f"y_{h}" for h in self.horizons]
        seen = d.select(*self.inputs, *ys).where(" OR ".join(f"`{y}` IS NOT NULL" for y in ys)).first()
        pilot = {c: float(seen[c] or 0.0) if seen else 0.0 for c in [*self.inputs, *ys]}
        k = len(self.inputs) + 2
        cells = [F.struct(F.lit(i).alias("h"), F.array(*[F.col(c) - F.lit(pilot[c]) for c in self.inputs], F.lit(1.0), F.col(y) - F.lit(pilot[y])).alias("z")) for i, y in enumerate(ys)]
        long = d.select(F.explode(F.array(*cells)).alias("r")).select("r.h", "r.z").where(F.col("z")[k - 1].isNotNull())
        upper = [(i, j) for i in range(k) for j in range(i, k)]
        found = {r["h"]: r["s"] for r in long.groupBy("h").agg(F.array(*[F.sum(F.col("z")[i] * F.col("z")[j]) for i, j in upper]).alias("s")).collect()}  # a row per horizon
        self.models, self.sigma = {}, {}
        for n, (h, y) in enumerate(zip(self.horizons, ys, strict=True)):
            gram = np.zeros((k, k))
            gram[np.triu_indices(k)] = found.get(n, 0.0)
            gram += np.triu(gram, 1).T
            w, sigma = solved(gram)
            self.models[h] = w[:-1].tolist(), float(w[-1] + pilot[y] - sum(b * pilot[c] for b, c in zip(w[:-1], self.inputs, strict=True)))
            self.sigma[h] = sigma
        self.fitted = True
        return self

    def _value(self, h: str):
        w, b = self.models[h]
        return sum((F.lit(float(c)) * F.col(n) for c, n in zip(w, self.inputs, strict=True)), F.lit(float(b)))

    def predict(self, df: DataFrame) -> DataFrame:
        self._require()
        df = df.na.fill(0.0, self.inputs).withColumns({f"{h}_pred": self._value(h) for h in self.horizons})
        each = F.array(*[F.struct(F.col(f"{h}_pred").alias("mid"), F.lit(float(self.sigma[h])).alias("sigma")) for h in self.horizons])
        df = df.withColumn("__p", F.transform(each, lambda m: survival(self.threshold, m["mid"], m["sigma"])))
        for i, h in enumerate(self.horizons):
            q = gaussian_quantiles(F.col(f"{h}_pred"), F.lit(self.sigma[h]))
            df = df.withColumns(self._columns(h, [q[0], q[1], q[2]], F.col(f"{h}_pred"), F.col("__p")[i]))
        return df.drop("__p")


def solved(gram: np.ndarray) -> tuple[np.ndarray, float]:
    """Least-squares weights and the residuals' deviation from sums of products of (inputs, constant, target).

    Inputs that others determine get no weight of their own (the shortest of all solutions, in units of their spread).
    """
    n, xx, xy = gram[-2, -2], gram[:-1, :-1], gram[:-1, -1]
    if n <= 0:
        return np.zeros(len(xy)), 0.0
    centre = xx[-1] / n
    cov = xx[:-1, :-1] - np.outer(centre[:-1], centre[:-1]) * n
    cross = xy[:-1] - centre[:-1] * xy[-1]
    unit = np.sqrt(np.maximum(np.diag(cov), 0))
    unit[unit <= 1e-9 * np.sqrt(np.maximum(np.diag(xx)[:-1], 1e-300))] = np.inf
    b = np.linalg.lstsq(cov / np.outer(unit, unit), cross / unit, rcond=1e-10)[0] / unit if len(cross) else cross
    rest = gram[-1, -1] - xy[-1] ** 2 / n - 2 * b @ cross + b @ cov @ b
    return np.append(b, xy[-1] / n - b @ centre[:-1]), float(np.sqrt(max(rest, 0.0) / n))


class BoostedTrees(Forecaster):
    """Gradient-boosted trees per horizon: one model for each quantile by its own loss, and a logistic one for exceedance, all grown together."""

    name = "lightgbm"

    def fit(self, df: DataFrame) -> BoostedTrees:
        self.inputs = list(self.params["inputs"])
        targets, taus = [], []
        for h in self.horizons:
            y, reached = F.col(f"y_{h}").cast("double"), (F.col(f"y_{h}") >= self.threshold).cast("double")
            for tau, value in [*((t, y) for t in QUANTILES), (trees.LOGISTIC, reached)]:
                targets.append(F.when(y.isNotNull(), F.struct(F.lit(len(taus)).alias("m"), value.alias("y"))))
                taus.append(tau)
        size = {"trees": self.params.get("trees", 20), "depth": self.params.get("depth", 4)} | {k: self.params[k] for k in ("bins", "rate", "least") if k in self.params}
        self.ensemble = trees.fit(df.withColumn("targets", F.array_compact(F.array(*targets))), self.inputs, taus, **size)
        self.fitted = True
        return self

    def importance(self, h: str) -> dict[str, float]:
        """Of the median's model."""
        per = len(QUANTILES) + 1
        return self.ensemble.importance(list(self.horizons).index(h) * per + QUANTILES.index(0.5))

    def predict(self, df: DataFrame) -> DataFrame:
        self._require()
        x, per = df.withColumn("__f", self.ensemble.score()), len(QUANTILES) + 1
        for k, h in enumerate(self.horizons):
            at = k * per
            q = F.array_sort(F.array(*[F.col("__f")[at + i] for i in range(len(QUANTILES))]))
            x = x.withColumn("__q", q)
            x = x.withColumns(self._columns(h, [F.col("__q")[i] for i in range(3)], F.col("__q")[1], 1 / (1 + F.exp(-F.col("__f")[at + len(QUANTILES)])))).drop("__q")
        return x.drop("__f")


class Absent(Forecaster):
    """A model whose library is not part of the engine."""

    needs: ClassVar[str] = ""

    def __init__(self, *a, **k):
        raise RuntimeError(f"{self.name} needs {self.needs}; register a Forecaster of your own under this name to use it")


def _absent(model: str, library: str) -> type[Forecaster]:
    return type(model, (Absent,), {"name": model, "needs": library})


REGISTRY: dict[str, type[Forecaster]] = {c.name: c for c in (Persistence, Climatology, LinearFilter, BoostedTrees)}
REGISTRY |= {n: _absent(n, lib) for n, lib in (("tft", "torch"), ("nhits", "torch"), ("foundation", "a pretrained model"), ("onnx", "an exported graph"))}


def save_model(m: Forecaster, spark: SparkSession, path: str) -> None:
    """A fitted forecaster as a table of one JSON row; all of them are of driver size."""
    m._require()
    state = {"name": m.name, "horizons": m.horizons, "threshold": m.threshold, "params": m.params}
    if isinstance(m, Climatology):
        state["table"] = [list(r) for r in m.table.collect()]  # at most a row per horizon and bin
    elif isinstance(m, LinearFilter):
        state |= {"models": {h: [list(map(float, w)), float(b)] for h, (w, b) in m.models.items()}, "sigma": m.sigma}
    elif isinstance(m, BoostedTrees):
        state["ensemble"] = m.ensemble.state()
    save_state(spark, state, f"{path}/state")


def load_model(spark: SparkSession, path: str) -> Forecaster:
    state = load_state(spark, f"{path}/state")
    m = build_model(state["name"], horizons=state["horizons"], threshold=state["threshold"], **state["params"])
    if isinstance(m, Climatology):
        m.table = spark.createDataFrame([tuple(r) for r in state["table"]], "horizon string, bin int, mean double, q10 double, q50 double, q90 double, freq double, n long")
    elif isinstance(m, LinearFilter):
        m.inputs, m.models, m.sigma = list(m.params["inputs"]), {h: (w, b) for h, (w, b) in state["models"].items()}, state["sigma"]
    elif isinstance(m, BoostedTrees):
        m.inputs, m.ensemble = list(m.params["inputs"]), trees.Ensemble(**state["ensemble"])
    m.fitted = True
    return m


def register_model(name: str, cls: type[Forecaster]) -> None:
    REGISTRY[name] = cls


def build_model(name: str, **params) -> Forecaster:
    if name not in REGISTRY:
        raise ValueError(f"unknown model {name!r}; known are {sorted(REGISTRY)}")
    return REGISTRY[name](**params)


def lut_forecast(df: DataFrame, table: Sequence[tuple[float, float]], mlt: str = "mlt", threshold: float = ALERT_LOG10) -> DataFrame:
    """Forecast from a fixed table of (median, spread) per sector of local time; noon where local time is missing."""
    lut = F.array(*[F.struct(F.lit(float(m)).alias("p50"), F.lit(float(s)).alias("spread")) for m, s in table])
    cell = F.element_at(lut, lut_bin(F.coalesce(F.col(mlt), F.lit(12.0)), len(table)) + 1)
    df = df.withColumn("__c", cell)
    p50, spread = F.col("__c.p50"), F.col("__c.spread")
    return df.withColumns({"q50": p50, "q10": p50 - spread, "q90": p50 + spread, "p": logistic_exceedance(p50, spread, threshold)}).drop("__c")


def fit_scaler(df: DataFrame, columns: Sequence[str], kind: str = "standard") -> dict:
    """Centre and scale per column in one pass; a centre that is not finite is 0, a scale that is not positive is 1."""
    if kind not in ("standard", "robust"):
        raise ValueError(f"unknown scaler {kind!r}")
    if kind == "standard":
        r = df.agg(*[a for c in columns for a in (F.avg(c).alias(f"c_{c}"), F.stddev_pop(c).alias(f"s_{c}"))]).first()
        found = {c: (r[f"c_{c}"], r[f"s_{c}"]) for c in columns}
    else:
        long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("channel"), F.col(c).cast("double").alias("v")) for c in columns])).alias("r")).select("r.*")
        found = {r["channel"]: (r["q"][1], r["q"][2] - r["q"][0]) for r in exact_quantiles(long, ["channel"], "v", (0.25, 0.5, 0.75)).collect()}  # a row per column
    ok = lambda x: x is not None and x == x and abs(x) != float("inf")
    each = [found.get(c, (None, None)) for c in columns]
    return {"kind": kind, "columns": list(columns), "center": [m if ok(m) else 0.0 for m, _ in each], "scale": [x if ok(x) and x > 0 else 1.0 for _, x in each]}


def apply_scaler(df: DataFrame, state: Mapping, inverse: bool = False) -> DataFrame:
    each = zip(state["columns"], state["center"], state["scale"], strict=True)
    return df.withColumns({c: F.col(c) * F.lit(s) + F.lit(m) if inverse else (F.col(c) - F.lit(m)) / F.lit(s) for c, m, s in each if c in df.columns})


def tensor_scaler(df: DataFrame, array: str) -> DataFrame:
    """Mean and deviation per channel of an array column; deviations below 1e-8 count as 1."""
    s = df.select(F.posexplode(array).alias("channel", "v")).groupBy("channel").agg(F.avg(F.col("v").cast("double")).alias("mean"), F.stddev_pop(F.col("v").cast("double")).alias("std"))
    return s.withColumn("std", F.when(F.col("std") < 1e-8, 1.0).otherwise(F.col("std")))
