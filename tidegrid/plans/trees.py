"""Gradient-boosted trees by grouped aggregates, several models at once: quantile loss and logistic loss.

Every row of a model carries its binned inputs and its score so far. A level of one tree of all models is one aggregate
over (model, node, input, bin), summed in each task before the shuffle, so its size follows the models and bins and not the rows; the
best split of each node is picked in Spark and only that comes to the driver. Leaves of quantile models are exact
quantiles of the residuals, found by counted ranges; those of logistic ones are one Newton step. For each tree rows
are written to the shared folder with their scores and leaves, which ends their lineage; a lost executor costs no more than that tree's tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.quantiles import exact_quantiles
from ..sources.folders import remove, scratch

#: What a model's target is fitted by: this for logistic loss, else the level of the quantile.
LOGISTIC = -1.0
#: Gains are compared at this many decimals, so that sums in another order pick the same split.
GAIN_DECIMALS = 9
#: Rows of a task while trees grow, at most; fewer where that gives each core a task.
TASK_ROWS = 200_000
#: Rows while trees grow: a list of (model, target, score before the last tree, leaf of it).
STATE = "bins array<int>, t array<struct<m: int, y: double, f: double, node: int>>"


@dataclass
class Ensemble:
    """Models of equal shape. Nodes of a tree are numbered as in a heap; one whose input is -1 is a leaf."""

    inputs: list[str]
    taus: list[float]
    start: list[float]
    rate: float
    inputs_of: list = field(default_factory=list)  # per tree: models x nodes
    limits: list = field(default_factory=list)
    leaves: list = field(default_factory=list)
    gains: list = field(default_factory=list)  # per model, by input

    def score(self, row: Column | None = None) -> Column:
        """Scores of all models as an array, from the inputs of a row."""
        start, rate = np.array(self.start), self.rate
        trees = [(np.array(f), np.array(c), np.array(v)) for f, c, v in zip(self.inputs_of, self.limits, self.leaves, strict=True)]

        @F.pandas_udf("array<double>")
        def scored(x: pd.Series) -> pd.Series:
            if not len(x):
                return pd.Series([], dtype=object)
            x = np.stack(x.to_numpy())
            out, at = np.tile(start, (len(x), 1)), np.arange(len(x))
            for used, limit, leaf in trees:
                for m in range(len(start)):
                    node = np.zeros(len(x), dtype=int)
                    while (inner := used[m][node] >= 0).any():
                        right = x[at, np.maximum(used[m][node], 0)] > limit[m][node]
                        node = np.where(inner, 2 * node + 1 + right, node)
                    out[:, m] += rate * leaf[m][node]
            return pd.Series(list(out))

        return scored(row if row is not None else F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in self.inputs]))

    def importance(self, m: int) -> dict[str, float]:
        """Share of each input in the gain of a model's splits."""
        total = sum(self.gains[m])
        return dict(zip(self.inputs, [g / total if total else 0.0 for g in self.gains[m]], strict=True))

    def state(self) -> dict:
        return {k: [np.asarray(x).tolist() for x in v] if k in ("inputs_of", "limits", "leaves", "gains") else v for k, v in self.__dict__.items()}


def bin_edges(df: DataFrame, inputs: Sequence[str], bins: int) -> list[list[float]]:
    """Distinct inner edges of about equally filled bins of each input."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(i).alias("j"), F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias("v")) for i, c in enumerate(inputs)])).alias("r")).select("r.*")
    found = {r["j"]: r["q"] for r in exact_quantiles(long, ["j"], "v", [k / bins for k in range(1, bins)]).collect()}  # a row per input
    return [sorted(set(found.get(j, []))) for j in range(len(inputs))]


def _bins(inputs: Sequence[str], edges: list[list[float]]) -> Column:
    """Per input the number of edges below its value."""
    def one(c: str, limits: list[float]) -> Column:
        v = F.coalesce(F.col(c).cast("double"), F.lit(0.0))
        return F.size(F.filter(_table(np.array(limits, dtype=float)), lambda e: e < v)) if limits else F.lit(0)

    return F.array(*[one(c, limits) for c, limits in zip(inputs, edges, strict=True)])


def _table(per_model: np.ndarray) -> Column:
    """models x nodes as one flat literal, to be looked up by model and node."""
    end = "D" if per_model.dtype.kind == "f" else ""
    return F.expr(f"array({', '.join(f'{v!r}{end}' for v in per_model.ravel().tolist())})")


@dataclass
class _Step:
    """What a pass over the stored rows needs: leaves that the last tree adds to scores, and the tree grown so far."""

    taus: np.ndarray
    used: np.ndarray
    limit: np.ndarray
    depth: int
    added: np.ndarray | None = None

    def flat(self, b: pa.RecordBatch) -> dict[str, np.ndarray]:
        """A row of each (input row, model): its place in the batch, model, target, score and node of the tree so far."""
        t = b.column("t")
        row = pc.list_parent_indices(t).to_numpy(zero_copy_only=False)
        m, y, f, node = (t.flatten().field(c).to_numpy(zero_copy_only=False) for c in ("m", "y", "f", "node"))
        if self.added is not None:
            f = f + self.added[m, node]
        bins = b.column("bins").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
        node = np.zeros(len(m), dtype=np.int32)
        for _ in range(self.depth):
            u = self.used[m, node]
            right = bins[row, np.maximum(u, 0)] > self.limit[m, node]
            node = np.where(u >= 0, 2 * node + 1 + right, node).astype(np.int32)
        return {"row": row, "m": m, "y": y, "f": f, "node": node, "bins": bins}

    def gradients(self, x: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Falling gradient and curvature of the loss at the score so far."""
        tau = self.taus[x["m"]]
        with np.errstate(over="ignore"):
            p = 1 / (1 + np.exp(-x["f"]))
        logistic = tau == LOGISTIC
        return np.where(logistic, x["y"] - p, tau - (x["y"] < x["f"])), np.where(logistic, p * (1 - p), 1.0)


def _passed(now: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    return now.select("bins", "t").mapInArrow(run, schema)


def _cells(now: DataFrame, step: _Step, size: int) -> DataFrame:
    """g, h and n of each (m, node, j, b) among the deepest nodes; a task sums its rows before they are shuffled."""
    low, wide = 2**step.depth - 1, 2**step.depth

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = None
        for b in batches:
            x = step.flat(b)
            at = np.flatnonzero(x["node"] >= low)
            g, h = (v[at] for v in step.gradients(x))
            inputs = x["bins"].shape[1]
            if sums is None:
                sums = np.zeros((3, len(step.taus) * wide, inputs, size))
            cell = x["m"][at].astype(np.int64) * wide + x["node"][at] - low
            for j in range(inputs):
                to = cell * size + x["bins"][x["row"][at], j]
                for k, w in enumerate((g, h, None)):
                    sums[k, :, j] += np.bincount(to, w, minlength=sums.shape[1] * size).reshape(-1, size)
        if sums is not None:
            c, j, b = np.nonzero(sums[2])
            cols = [c // wide, c % wide + low, j, b]
            yield pa.RecordBatch.from_arrays([*[pa.array(v, pa.int32()) for v in cols], *[pa.array(s[c, j, b]) for s in sums[:2]], pa.array(sums[2][c, j, b], pa.int64())], names=["m", "node", "j", "b", "g", "h", "n"])

    return _passed(now, run, "m int, node int, j int, b int, g double, h double, n long")


def _splits(now: DataFrame, step: _Step, size: int, least: int) -> DataFrame:
    """The best split of each (m, node): input, bin (rows of that bin and lower ones go left) and gain."""
    per = _cells(now, step, size).repartition("m", "node")  # the histograms, once for all that follows
    per = per.groupBy("m", "node", "j", "b").agg(F.sum("g").alias("g"), F.sum("h").alias("h"), F.sum("n").alias("n"))
    by = Window.partitionBy("m", "node", "j")
    upto = by.orderBy("b").rowsBetween(Window.unboundedPreceding, 0)
    s = per.select("m", "node", "j", "b", *[F.sum(c).over(upto).alias(f"l{c}") for c in "ghn"], *[F.sum(c).over(by).alias(f"t{c}") for c in "ghn"])
    worth = lambda g, h: F.when(h > 0, g * g / h).otherwise(F.lit(0.0))
    gain = worth(F.col("lg"), F.col("lh")) + worth(F.col("tg") - F.col("lg"), F.col("th") - F.col("lh")) - worth(F.col("tg"), F.col("th"))
    s = s.where((F.col("ln") >= least) & (F.col("tn") - F.col("ln") >= least)).select("m", "node", F.struct(F.round(gain, GAIN_DECIMALS).alias("gain"), (-F.col("j")).alias("j"), (-F.col("b")).alias("b")).alias("s"))
    return s.groupBy("m", "node").agg(F.max("s").alias("s")).where("s.gain > 0").select("m", "node", (-F.col("s.j")).alias("j"), (-F.col("s.b")).alias("b"), "s.gain")


def _placed(now: DataFrame, step: _Step) -> DataFrame:
    """The rows with their scores so far and their leaves of the tree."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = step.flat(b)
            t = pa.StructArray.from_arrays([pa.array(x["m"], pa.int32()), pa.array(x["y"], pa.float64()), pa.array(x["f"], pa.float64()), pa.array(x["node"], pa.int32())], names=["m", "y", "f", "node"])
            ends = np.concatenate([[0], np.cumsum(np.bincount(x["row"], minlength=b.num_rows))])
            yield pa.RecordBatch.from_arrays([b.column("bins"), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), t)], names=["bins", "t"])

    return _passed(now, run, STATE)


def _steps(placed: DataFrame, step: _Step) -> DataFrame:
    """Sums of gradient and curvature of each (m, node) of the logistic models; a task sums its rows before they are shuffled."""
    models, nodes = step.used.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((3, models * nodes))
        for b in batches:
            t = b.column("t").flatten()
            x = {c: t.field(c).to_numpy(zero_copy_only=False) for c in ("m", "y", "f", "node")}
            at = np.flatnonzero(step.taus[x["m"]] == LOGISTIC)
            x = {c: v[at] for c, v in x.items()}
            for k, w in enumerate((*step.gradients(x), None)):
                sums[k] += np.bincount(x["m"].astype(np.int64) * nodes + x["node"], w, minlength=models * nodes)
        c = np.flatnonzero(sums[2])
        yield pa.RecordBatch.from_arrays([pa.array(c // nodes, pa.int32()), pa.array(c % nodes, pa.int32()), pa.array(sums[0][c]), pa.array(sums[1][c])], names=["m", "node", "g", "h"])

    return placed.select("t").mapInArrow(run, "m int, node int, g double, h double").groupBy("m", "node").agg(F.sum("g").alias("g"), F.sum("h").alias("h"))


def _ranges(r: np.ndarray) -> np.ndarray:
    """quantiles.value_range."""
    return np.floor(np.sign(r) * np.log2(np.abs(r) + 1) * 256).astype(np.int64)


def _leaf_quantiles(placed: DataFrame, taus: Sequence[float]) -> dict[tuple[int, int], float]:
    """By (model, leaf) the exact quantile, at the model's level, of what its scores leave.

    One pass counts ranges of values, summed in each task before the shuffle; a second one sends on only the values of those
    ranges in which a wanted rank lies. What comes to the driver is a row for each model and leaf.
    """
    levels = np.array(taus, dtype=float)
    spark = placed.sparkSession

    def residuals(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        t = b.column("t").flatten()
        m, y, f, node = (t.field(c).to_numpy(zero_copy_only=False) for c in ("m", "y", "f", "node"))
        at = np.flatnonzero(levels[m] != LOGISTIC)
        return m[at], node[at], y[at] - f[at]

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, n = np.zeros((0, 3), dtype=np.int64), np.zeros(0, dtype=np.int64)
        for b in batches:
            m, node, r = residuals(b)
            keys = np.concatenate([keys, np.stack([m.astype(np.int64), node.astype(np.int64), _ranges(r)], axis=1)])
            n = np.concatenate([n, np.ones(len(m), dtype=np.int64)])
            order = np.lexsort(keys.T)
            keys, n = keys[order], n[order]
            starts = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]).any(axis=1)])) if len(keys) else np.zeros(0, dtype=int)
            keys, n = keys[starts], np.add.reduceat(n, starts) if len(starts) else n
        if len(n):
            yield pa.RecordBatch.from_arrays([pa.array(keys[:, 0], pa.int32()), pa.array(keys[:, 1], pa.int32()), pa.array(keys[:, 2]), pa.array(n)], names=["m", "node", "c", "n"])

    by = Window.partitionBy("m", "node")
    heads = placed.select("t").mapInArrow(counts, "m int, node int, c long, n long").repartition("m", "node").groupBy("m", "node", "c").agg(F.sum("n").alias("n"))
    heads = heads.select("m", "node", "c", "n", (F.sum("n").over(by.orderBy("c").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("below"), F.sum("n").over(by).alias("total"))
    at = (F.col("total") - 1) * _table(levels)[F.col("m")]
    lies = lambda rank: (rank >= F.col("below")) & (rank < F.col("below") + F.col("n"))
    wanted = heads.where(lies(F.floor(at)) | lies(F.ceil(at))).select("m", "node", "c", "below", "total").collect()  # two rows per model and leaf at most
    if not wanted:
        return {}
    ranges = np.array([(r["m"], r["node"], r["c"]) for r in wanted], dtype=np.int64)

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = {}
        for k, (m, node, c) in enumerate(ranges.tolist()):
            ids.setdefault((m, node), []).append((c, k))
        for b in batches:
            m, node, r = residuals(b)
            c, k = _ranges(r), np.full(len(m), -1)
            first = np.full((len(levels), int(ranges[:, 1].max()) + 1, 2), -1)
            for (a, leaf), found in ids.items():
                first[a, leaf, : len(found)] = [i for _, i in found]
            for side in range(2):
                to = first[m, node, side]
                k = np.where((to >= 0) & (ranges[to, 2] == c), to, k)
            hit = np.flatnonzero(k >= 0)
            yield pa.RecordBatch.from_arrays([pa.array(k[hit], pa.int32()), pa.array(r[hit])], names=["k", "v"])

    values = placed.select("t").mapInArrow(near, "k int, v double").groupBy("k", "v").agg(F.count("*").alias("n"))
    known = spark.createDataFrame([(k, r["m"], r["node"], r["below"], r["total"]) for k, r in enumerate(wanted)], "k int, m int, node int, below long, total long")
    up = Window.partitionBy("k").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    values = values.withColumn("upto", F.sum("n").over(up)).join(F.broadcast(known), "k").withColumn("upto", F.col("below") + F.col("upto"))
    ends = values.groupBy("m", "node").agg(*[F.min(F.when(F.col("upto") > rank, F.col("v"))).alias(c) for c, rank in (("lo", F.floor(at)), ("hi", F.ceil(at)))], F.first("total").alias("total"))
    return {(r["m"], r["node"]): r["q"] for r in ends.select("m", "node", (F.col("lo") + (F.col("hi") - F.col("lo")) * (at - F.floor(at))).alias("q")).collect()}


def fit(rows: DataFrame, inputs: Sequence[str], taus: Sequence[float], trees: int, depth: int, bins: int = 32, rate: float = 0.3, least: int = 20) -> Ensemble:
    """An ensemble for each of `taus`, by its place; rows hold the inputs and `targets`, an array of (m, y), one for each model that the row has a target for."""
    spark, base = rows.sparkSession, scratch(rows.sparkSession)
    rows.select(*[F.col(c).cast("double").alias(c) for c in inputs], "targets").write.parquet(f"{base}/rows")  # what makes the inputs runs once
    rows = spark.read.parquet(f"{base}/rows").withColumn("targets", F.filter("targets", lambda t: t.y.isNotNull()))
    edges = bin_edges(rows, inputs, bins)
    long = rows.select(_bins(inputs, edges).alias("bins"), F.explode("targets").alias("t")).select("bins", F.col("t.m").alias("m"), F.col("t.y").cast("double").alias("y"))
    first = {r["m"]: r["q"] for r in exact_quantiles(long, ["m"], "y", [t for t in sorted(set(taus)) if t != LOGISTIC] or [0.5]).collect()}
    found = long.groupBy("m").agg(F.avg("y").alias("y"), F.count("*").alias("n")).collect()
    means = {r["m"]: r["y"] for r in found}
    tasks = max(spark.sparkContext.defaultParallelism, -(-max((r["n"] for r in found), default=0) // TASK_ROWS))
    level = {t: i for i, t in enumerate(sorted({t for t in taus if t != LOGISTIC}))}

    def begin(m: int, tau: float) -> float:
        if m not in means:
            return 0.0
        if tau != LOGISTIC:
            return float(first[m][level[tau]])
        p = min(max(means[m], 1e-6), 1 - 1e-6)
        return float(np.log(p / (1 - p)))

    e = Ensemble(list(inputs), list(taus), [begin(m, t) for m, t in enumerate(taus)], rate, gains=[[0.0] * len(inputs) for _ in taus])
    state = f"{base}/start"
    begun = F.transform("targets", lambda t: F.struct(t.m.cast("int").alias("m"), t.y.cast("double").alias("y"), _table(np.array(e.start, dtype=float))[t.m].alias("f"), F.lit(0).alias("node")))
    rows.select(_bins(inputs, edges).alias("bins"), begun.alias("t")).where(F.size("t") > 0).repartition(tasks).write.parquet(state)  # small rows, but much work
    shape, size = (len(taus), 2 ** (depth + 1) - 1), max(map(len, edges), default=0) + 1
    of_m = np.array(taus, dtype=float) == LOGISTIC
    for t in range(trees):
        now = spark.read.schema(STATE).parquet(state)
        used, limit, leaf = np.full(shape, -1), np.zeros(shape, dtype=int), np.zeros(shape)
        value = np.zeros(shape)
        added = rate * np.asarray(e.leaves[-1]) if t else None  # from where the last tree has put each row
        for d in range(depth):
            found = _splits(now, _Step(np.array(taus, dtype=float), used, limit, d, added), size, least).collect()  # a row per model and node at most
            for r in found:
                used[r["m"], r["node"]], limit[r["m"], r["node"]], value[r["m"], r["node"]] = r["j"], r["b"], edges[r["j"]][r["b"]]
                e.gains[r["m"]][r["j"]] += r["gain"]
            if not found:
                break
        placed = f"{base}/placed{t}"
        last = _Step(np.array(taus, dtype=float), used, limit, depth, added)
        _placed(now, last).write.parquet(placed)
        remove(spark, state)
        state, placed = placed, spark.read.schema(STATE).parquet(placed)
        for (m, node), q in (_leaf_quantiles(placed, taus) if level else {}).items():
            leaf[m, node] = q
        if of_m.any():
            for r in _steps(placed, last).collect():  # a row per model and leaf
                leaf[r["m"], r["node"]] = r["g"] / r["h"] if r["h"] else 0.0
        e.inputs_of.append(used)
        e.limits.append(value)
        e.leaves.append(leaf)
    remove(spark, base)
    return e
