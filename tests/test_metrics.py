"""Scores against hand-computed vectors and published contingency counts."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegrid.functions import survival
from tidegrid.operators import metrics as M

# Published counts (hits, misses, false alarms, correct negatives) and scores (pod, far, csi, f1, hss, tss).
COUNTS = [
    ((240, 18, 25, 509), (0.9302, 0.09434, 0.8481, 0.9178, 0.8773, 0.8834)),
    ((151, 85, 114, 442), (0.6398, 0.4302, 0.4314, 0.6028, 0.4199, 0.4348)),
    ((29, 200, 54, 509), (0.1266, 0.6506, 0.1025, 0.1859, 0.03789, 0.03072)),
    ((82, 147, 158, 405), (0.3581, 0.6583, 0.2119, 0.3497, 0.07635, 0.07744)),
]


@pytest.mark.parametrize("counts,scores", COUNTS)
def test_event_scores(spark, counts, scores):
    r = spark.createDataFrame([tuple(map(float, counts))], "h double, m double, f double, c double").select(*M.event_scores(*map(F.col, "hmfc"))).first()
    for name, want in zip(("pod", "far", "csi", "f1", "hss", "tss"), scores, strict=True):
        assert r[name] == pytest.approx(want, rel=1e-3)


def test_undefined_is_null(spark):
    r = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "y double, p double").agg(M.prediction_efficiency(F.col("y"), F.col("p")).alias("pe"), M.pearson(F.col("y"), F.col("p")).alias("r")).first()
    assert r["pe"] is None and r["r"] is None


def test_regression_skips_rows_that_are_not_finite(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 2.0), (None, 1.0), (3.0, float("nan")), (4.0, float("inf"))], "y double, p double")
    r = df.agg(*M.regression_report(F.col("y"), F.col("p"))).first()
    assert r["n"] == 2 and r["rmse"] == pytest.approx(math.sqrt(0.5)) and r["bias"] == 0.5


def test_pinball_at_one_half_is_half_the_absolute_error(spark):
    df = spark.createDataFrame([(float(i), float(i * i % 7)) for i in range(20)], "y double, p double")
    r = df.agg(M.pinball(F.col("y"), F.col("p"), 0.5).alias("a"), M.mae(F.col("y"), F.col("p")).alias("b")).first()
    assert r["a"] == pytest.approx(r["b"] / 2)


def test_area_with_ties_is_that_of_all_pairs(spark):
    rng = np.random.default_rng(0)
    s, y = np.round(rng.random(300), 1), rng.integers(0, 2, 300)
    want = np.mean([1.0 if a > b else 0.5 if a == b else 0.0 for a in s[y == 1] for b in s[y == 0]])
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, s, strict=True)], "y int, s double")
    assert M.roc_auc(df, "y", "s").first()["roc_auc"] == pytest.approx(want)
    assert M.roc_auc(df.where("y = 1"), "y", "s").first()["roc_auc"] is None


def test_reliability_bins_are_those_of_digitize(spark):
    rng = np.random.default_rng(1)
    p = np.round(rng.random(500), 2)
    want = np.bincount(np.clip(np.digitize(p, np.linspace(0, 1, 11)) - 1, 0, 9), minlength=10)
    df = spark.createDataFrame([(float(x), 1) for x in p], "p double, o int")
    assert [r["n"] for r in M.reliability(df, "p", "o").orderBy("bin").collect()] == want.tolist()


def test_normal_tail(spark):
    xs = [-6.0, -2.5, -1.0, 0.0, 0.3, 1.0, 2.4, 2.6, 4.0, 8.0]
    df = spark.createDataFrame([(x,) for x in xs], "z double").select(survival(3.0, 3.0 - F.col("z"), F.lit(1.0)).alias("p"), "z")
    for r in df.collect():
        assert r["p"] == pytest.approx(math.erfc(r["z"] / math.sqrt(2)) / 2, rel=1e-9, abs=1e-18)


def test_evaluate_and_report(spark):
    rows = [("m", "h", float(i), float(i) + 0.5, float(i) - 1, 0.5, float(i) - 1, float(i), float(i) + 1) for i in range(10)]
    long = spark.createDataFrame(rows, "model string, horizon string, y double, pred double, ref double, p double, q10 double, q50 double, q90 double")
    t = M.evaluate(long, 5.0)
    r = t.first()
    assert r["skill"] == pytest.approx(0.75) and r["picp"] == 1.0 and r["roc_auc"] == 0.5
    assert M.best_model(t).first()["model"] == "m" and "| h | m | 0.75 |" in M.markdown(t, ["h"], ["skill"])
    assert M.tidy(t).where("metric = 'rmse'").first()["value"] == pytest.approx(0.5)


def test_report_of_all_sets_equals_reports_of_each(spark):
    """Scores over sets of models and horizons are those of evaluate() on the rows of the set; persistence comes along by itself."""
    i = F.col("id")
    long = spark.range(400).select(
        F.when(i % 2 == 0, "m1").otherwise("m2").alias("model"), F.when(i % 8 < 5, "6h").otherwise("12h").alias("horizon"), (F.sin("id") * 3).alias("y"), (F.sin(i + 0.3) * 3).alias("pred"), (F.sin(i - 1) * 3).alias("ref"),
        F.abs(F.cos("id")).alias("p"), (F.sin("id") * 3 - 1).alias("q10"), F.cos("id").alias("q50"), (F.sin("id") * 2 + 1).alias("q90"), i.alias("key"),
    )
    full = M.with_persistence(long, "m1", 1.0)
    assert full.where("model = 'persistence'").count() == 200 and full.where("model = 'persistence' AND pred = ref AND q10 = ref AND p = CAST(ref >= 1 AS DOUBLE)").count() == 200
    got = {(r["model"], r["horizon"]): r.asDict() for r in M.report(full, 1.0).collect()}
    want = {}
    for models, horizons in ((True, True), (True, False), (False, True), (False, False)):
        d = full if models else full.withColumn("model", F.lit(M.ALL))
        for r in M.evaluate(d if horizons else d.withColumn("horizon", F.lit(M.ALL)), 1.0).collect():
            want[r["model"], r["horizon"]] = r.asDict()
    assert got.keys() == want.keys() and len(got) == 12
    for k, w in want.items():
        assert set(got[k]) == set(w) and all(got[k][c] == pytest.approx(v) if isinstance(v, float) else got[k][c] == v for c, v in w.items()), k
