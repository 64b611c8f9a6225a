"""Spikes, gaps, fills and windows against pandas on random gappy series, whole and in chunks."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidegrid.operators import clean as C
from tidegrid.operators import windows as W
from tidegrid.operators.extras import sustained
from tidegrid.schema import Grid

G = Grid()


def series(spark, values, start=1_600_000_200):
    rows = [(start // 300 * 300 + 300 * i, None if v is None or v != v else float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "t long, x double").select(F.timestamp_seconds("t").alias("time"), "x")


def got(df, *cols):
    return df.orderBy("time").select(*cols).toPandas()


@pytest.fixture(scope="module")
def gappy():
    rng = np.random.default_rng(3)
    x = rng.normal(10, 2, 700)
    x[rng.random(700) < 0.2] = np.nan
    x[100:130] = np.nan
    x[::50] *= 6
    return x


@pytest.mark.parametrize("chunk", [50, 8192])
def test_hampel_is_that_of_pandas(spark, gappy, chunk):
    s = pd.Series(gappy)
    med = s.rolling(7, center=True, min_periods=1).median()
    dev = (s - med).abs()
    mad = dev.rolling(7, center=True, min_periods=1).median()
    flag = (dev > 3 * 1.4826 * mad) & s.notna()
    r = got(C.hampel(series(spark, gappy), G, "x", chunk_steps=chunk), "x", "x_outlier")
    assert (r.x_outlier.to_numpy() == flag.to_numpy()).all()
    assert r.x.isna().to_numpy().tolist() == (s.isna() | flag).tolist()


def test_gap_vector(spark):
    r = got(C.gap_lengths(series(spark, [1, None, None, 4, None, 6]), G, "x"), "gap_len")
    assert r.gap_len.tolist() == [0, 2, 2, 0, 1, 0]


@pytest.mark.parametrize("chunk", [3, 64, 8192])
def test_gap_lengths_do_not_depend_on_chunks(spark, gappy, chunk):
    miss = np.isnan(gappy)
    want, i = np.zeros(len(gappy), int), 0
    while i < len(gappy):
        j = i
        while j < len(gappy) and miss[j] == miss[i]:
            j += 1
        if miss[i]:
            want[i:j] = j - i
        i = j
    assert got(C.gap_lengths(series(spark, gappy), G, "x", chunk_steps=chunk), "gap_len").gap_len.tolist() == want.tolist()


@pytest.mark.parametrize("chunk", [16, 8192])
def test_short_gaps_are_interpolated_and_long_ones_left(spark, gappy, chunk):
    s = pd.Series(gappy)
    run = s.isna().groupby(s.notna().cumsum()).transform("sum").where(s.isna(), 0)
    full = s.interpolate(limit_area="inside")
    want = s.where(~((run <= 4) & s.isna()), full)
    r = got(C.interpolate_short(series(spark, gappy), G, "x", 4, chunk_steps=chunk), "x", "x_imputed")
    np.testing.assert_allclose(r.x.to_numpy(), want.to_numpy(), rtol=1e-12)
    assert r.x_imputed.sum() == int((s.isna() & want.notna()).sum())


def test_edges_stay_empty_and_are_marked_only_on_demand(spark):
    v = [None, None, 3, 4, None, 6, None]
    assert got(C.interpolate_short(series(spark, v), G, "x", 3), "x_imputed").x_imputed.tolist() == [0, 0, 0, 0, 1, 0, 0]
    assert got(C.interpolate_short(series(spark, v), G, "x", 3, mask_edges=True), "x_imputed").x_imputed.tolist() == [1, 1, 0, 0, 1, 0, 1]


@pytest.mark.parametrize("chunk", [10, 8192])
def test_forward_fill(spark, gappy, chunk):
    np.testing.assert_array_equal(got(C.forward_fill(series(spark, gappy), G, "x", chunk_steps=chunk), "x").x.to_numpy(), pd.Series(gappy).ffill().to_numpy())


@pytest.mark.parametrize("chunk", [64, 8192])
def test_rolling_and_lags(spark, gappy, chunk):
    s = pd.Series(gappy)
    r = got(W.add_rolling(W.add_lags(series(spark, gappy), G, "x", [1, 20], chunk_steps=chunk), G, "x", [12], chunk_steps=chunk), "x_lag1", "x_lag20", "x_roll12_mean", "x_roll12_std", "x_roll12_min", "x_roll12_max")
    w = s.rolling(12, min_periods=1)
    for name, want in (("x_lag1", s.shift(1)), ("x_lag20", s.shift(20)), ("x_roll12_mean", w.mean()), ("x_roll12_std", s.rolling(12, min_periods=2).std()), ("x_roll12_min", w.min()), ("x_roll12_max", w.max())):
        np.testing.assert_allclose(r[name].to_numpy(dtype=float), want.to_numpy(), rtol=1e-9, err_msg=name)


def test_one_missing_value_removes_the_anchors_that_see_it(spark):
    v = list(range(400))
    whole = W.anchors(series(spark, v), G, ["x"], "x", 20, decoder=30, horizons={"a": 5, "b": 30}, future=(), chunk_steps=100).count()
    assert whole == 400 - 19 - 30
    v[200] = None
    left = W.anchors(series(spark, v), G, ["x"], "x", 20, decoder=30, horizons={"a": 5, "b": 30}, future=(), chunk_steps=100)
    assert left.count() == whole - 20 - 2  # twenty windows hold it, two targets are it


def test_anchor_targets_and_arrays(spark):
    a = W.anchors(series(spark, range(60)).withColumn("k", F.col("x") * 2), G, ["x"], "x", 5, decoder=3, horizons={"h": 2}, threshold=30.0, future=("k",), arrays=True).orderBy("time").first()
    assert [v[0] for v in a["X"]] == [0, 1, 2, 3, 4] and [v[0] for v in a["X_future"]] == [10, 12, 14] and a["y_h"] == 6 and a["y_exceed_h"] == 0


def test_split_keeps_its_distance(spark):
    r = got(W.chronological_split(series(spark, range(1000)).select("time"), G, 0.7, 0.15, 20), "split")
    at = {k: np.flatnonzero(r.split.to_numpy() == k) for k in ("train", "val", "test")}
    assert at["train"].max() == 679 and at["val"].min() == 720 and at["val"].max() == 829 and at["test"].min() == 870
    with pytest.raises(ValueError):
        W.select_split(series(spark, [1]), "other")


def test_sustained(spark):
    r = sustained(series(spark, [1, 9, 9, 9, 1, 9, 9, None, 9]), G, "x", 5, 3).collect()
    assert [x["steps"] for x in r] == [3]


def test_even_windows_are_refused(spark):
    with pytest.raises(ValueError):
        C.hampel(series(spark, [1]), G, "x", window=4)
