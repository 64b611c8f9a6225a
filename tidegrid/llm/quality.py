"""Quality classifier: regularised quadratic discriminant over transformed document statistics.

Every document is turned into a few statistics of its whole text, put on log scales. For each class the mean and a
covariance shrunk towards its diagonal are estimated, with the weight of the diagonal taken from the data (the
Ledoit-Wolf estimate, from sums that all labelled rows add to). A score is the logistic of the difference of the two
log densities; each density is a Mahalanobis length, computed with a Cholesky factor that is inverted once and kept.
One scale and one offset, fitted on at most `CALIBRATION_ROWS` labelled rows, turn the difference into a probability.

Class sums are taken over all labelled rows that are not held out. Labels, language, source and doc_id never enter a
score. Null text counts as empty text; empty texts get a score as any other. Repeated rows each get their row; a
repeated label counts once, the larger winning. If a class has no labelled rows, every score is 0.5. Texts of any length
are read whole, a document at a time; an empty table gives no rows; a score of exactly THRESHOLD is accepted; only
doc_id and text are looked at, whatever other columns are called.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import byte_batches, documents, pick, plain_names, sampled, scratch, stored

CALIBRATION_ROWS = 20_000
THRESHOLD = 0.7
NAMES = (
    "words", "word_length", "symbols", "upper", "stops", "commas", "pipes", "marks", "spread", "repeats", "line_repeats", "lines", "entropy", "long_words",
)

#: Signs of broken markup; those of phone numbers, addresses and code are left out.
_SYMBOLS = [ord(c) for c in "#$%&*^~"]


def statistics(text: str | None) -> list[float]:
    """The transformed statistics of one text, in the order of NAMES."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    counts = np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256)
    words = raw.split()
    n, size = len(words), max(1, len(raw))
    lines = raw.split(b"\n")
    share = lambda k, of, least=0.002: math.log(least + k / (of + 10))  # noqa: E731  short texts say less
    seen = counts[counts > 0] / size
    letters = int(counts[65:91].sum() + counts[97:123].sum() + counts[128:].sum())
    return [
        math.log1p(n),
        math.log1p(letters / max(1, n)),
        share(int(counts[_SYMBOLS].sum()), size),
        share(int(counts[65:91].sum()), max(1, letters)),
        share(int(counts[46]), n, 0.01),
        share(int(counts[44]), n, 0.01),
        share(int(counts[124]), n),
        share(int(counts[33] + counts[63]), n),
        math.log((1 + len(set(words))) / (1 + n) ** 0.9),
        share(sum(map(eq, words, words[1:])), n, 0.005),
        share(len(lines) - len(set(lines)), len(lines), 0.01),
        share(len(lines), n, 0.005),
        float(-(seen * np.log(seen)).sum()) if len(raw) else 0.0,
        share(sum(len(w) > 24 for w in words), n, 0.01),
    ]


def _statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        x = [statistics(t.as_py()) for t in b.column("text")]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(x, pa.list_(pa.float64()))], names=["doc_id", "x"])


def featured(docs: DataFrame) -> DataFrame:
    """doc_id and its statistics x."""
    byte_batches(docs.sparkSession)
    return pick(docs, "doc_id", "text").mapInArrow(_statistics, "doc_id long, x array<double>")


class Discriminant:
    """Two Gaussians with shrunk covariances; holds the inverted Cholesky factors."""

    def __init__(self, shift: np.ndarray, scale: np.ndarray, means: list[np.ndarray], covs: list[np.ndarray], counts: list[int]):
        self.shift, self.scale, self.means = shift, scale, means
        roots = [np.linalg.cholesky(c) for c in covs]
        self.inverse = [np.linalg.inv(r) for r in roots]
        self.half_log_det = [float(np.log(np.diag(r)).sum()) for r in roots]
        self.prior = math.log(counts[1] / counts[0])
        self.slope, self.offset = 1.0, 0.0

    def difference(self, x: np.ndarray) -> np.ndarray:
        """Log density of class 1 less that of class 0, with the priors."""
        z = (x - self.shift) / self.scale
        dense = [-0.5 * (((z - m) @ inv.T) ** 2).sum(axis=1) - h for m, inv, h in zip(self.means, self.inverse, self.half_log_det, strict=True)]
        return dense[1] - dense[0] + self.prior

    def score(self, x: np.ndarray) -> np.ndarray:
        d = np.clip(self.slope * np.arcsinh(self.difference(x) / 2) + self.offset, -30, 30)
        return 1 / (1 + np.exp(-d))

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> None:
        """Newton's steps for slope and offset over the squashed difference, with a small penalty so that separable classes stay finite."""
        a = np.stack([np.arcsinh(self.difference(x) / 2), np.ones(len(x))], axis=1)
        w = np.array([1.0, 0.0])
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
            g = a.T @ (p - y) + 1e-2 * (w - [1, 0])
            h = (a * (p * (1 - p))[:, None]).T @ a + 1e-2 * np.eye(2)
            step = np.linalg.solve(h, g)
            w = w - np.clip(step, -1, 1)
            if np.abs(step).max() < 1e-9:
                break
        self.slope, self.offset = max(float(w[0]), 1e-3), float(w[1])


def _moments(shift: np.ndarray, scale: np.ndarray, means: dict[int, np.ndarray]):
    """One row of sums per class and batch: count, outer products, sum of fourth powers of lengths."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            y = b.column("y").to_numpy(zero_copy_only=False)
            x = (np.array(b.column("x").to_pylist(), dtype=float).reshape(len(y), -1) - shift) / scale
            rows = []
            for k, m in means.items():
                z = x[y == k] - m
                rows.append((k, [float(len(z)), float(((z**2).sum(axis=1) ** 2).sum()), *(z.T @ z).ravel()] if len(z) else []))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.list_(pa.float64()))], names=["y", "s"])

    return run


def shrunk(outer: np.ndarray, n: float, fourth: float) -> np.ndarray:
    """Covariance drawn towards its own diagonal with the Ledoit-Wolf weight."""
    cov = outer / n
    target = np.diag(np.diag(cov))
    spread = ((cov - target) ** 2).sum()
    noise = max(0.0, (fourth / n - (cov**2).sum()) / n)
    weight = min(1.0, noise / spread) if spread > 0 else 1.0
    weight = max(weight, 0.02)
    return (1 - weight) * cov + weight * target + 1e-3 * np.eye(len(cov))


def fit(labelled: DataFrame, calibration_rows: int = CALIBRATION_ROWS) -> Discriminant | None:
    """From rows (doc_id, x, y); None if a class has no rows."""
    p = len(NAMES)
    per_class = labelled.groupBy("y").agg(F.count("*").alias("n"), *[f(F.col("x")[i]).alias(f"{k}{i}") for i in range(p) for k, f in (("m", F.avg), ("q", lambda c: F.avg(c * c)))]).collect()
    per_class = {r["y"]: r for r in per_class if r["y"] in (0, 1)}
    if len(per_class) < 2:
        return None
    counts = [per_class[k]["n"] for k in (0, 1)]
    raw = [np.array([per_class[k][f"m{i}"] for i in range(p)]) for k in (0, 1)]
    squares = [np.array([per_class[k][f"q{i}"] for i in range(p)]) for k in (0, 1)]
    share = np.array(counts) / sum(counts)
    shift = share[0] * raw[0] + share[1] * raw[1]
    scale = np.sqrt(np.maximum(share[0] * squares[0] + share[1] * squares[1] - shift**2, 1e-12))
    scale[scale < 1e-4] = 1.0
    means = [(m - shift) / scale for m in raw]
    sums = labelled.select("x", F.col("y").cast("int").alias("y")).mapInArrow(_moments(shift, scale, dict(enumerate(means))), "y int, s array<double>")
    got = sums.select("y", F.posexplode("s")).groupBy("y", "pos").agg(F.sum("col").alias("v")).collect()
    table = np.zeros((2, 2 + p * p))
    for r in got:
        table[r["y"], r["pos"]] = r["v"]
    covs = [shrunk(table[k, 2:].reshape(p, p), table[k, 0], table[k, 1]) for k in (0, 1)]
    model = Discriminant(shift, scale, means, covs, counts)
    # a share of all labelled rows by hash, so that no task sends the driver more than its part
    rows = labelled.where(sampled("doc_id", 0.9 * calibration_rows / sum(counts))).select("x", "y").limit(calibration_rows).collect()
    model.calibrate(np.array([r["x"] for r in rows], dtype=float).reshape(-1, p), np.array([r["y"] for r in rows], dtype=float))
    return model


def _score(model: Discriminant | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array(b.column("x").to_pylist(), dtype=float).reshape(b.num_rows, -1)
            s = model.score(x) if model and len(x) else np.full(b.num_rows, 0.5)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(s, pa.float64())], names=["doc_id", "score"])

    return run


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def train(x: DataFrame, labels: DataFrame) -> Discriminant | None:
    """Fit on the labelled rows of x (doc_id, x) that are not held out."""
    y = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.max("quality").cast("int").alias("y"))
    return fit(x.where(~held_out()).join(y, "doc_id"))


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of docs."""
    spark = docs.sparkSession
    x = stored(featured(docs), scratch(spark))
    s = x.mapInArrow(_score(train(x, labels)), "doc_id long, score double")
    return s.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def _kept(model: Discriminant | None, at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array([statistics(t.as_py()) for t in b.column(at)], dtype=float).reshape(b.num_rows, len(NAMES))
            if model and len(x):
                b = b.filter(pa.array(model.score(x) >= THRESHOLD))
            yield b

    return run


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs whose score reaches the threshold, unchanged; all of them if nothing is labelled."""
    spark = docs.sparkSession
    model = train(stored(featured(docs), scratch(spark)), labels)
    plain = plain_names(docs)
    return plain.mapInArrow(_kept(model, docs.columns.index("text")), plain.schema).toDF(*docs.columns)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
