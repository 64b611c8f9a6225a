"""Forecasters, scalers, payloads and streams."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegrid import functions as X
from tidegrid.operators.quantiles import exact_quantiles
from tidegrid.plans import models
from tidegrid.plans import trees as trees_module
from tidegrid.sources.folders import read_version
from tidegrid.streaming import online

H = {"a": 1}


@pytest.fixture(scope="module")
def frame(spark):
    return spark.range(200).select("id", F.timestamp_seconds(F.col("id") * 300).alias("time"), (F.col("id") % 10).cast("double").alias("last"), (2.0 * (F.col("id") % 10) + 1).alias("y_a"), (F.col("id") % 5).cast("int").alias("bin_a"))


def test_persistence(spark, frame):
    r = models.Persistence(H, 5.0).predict(frame).where("last = 7").first()
    assert r["a_q10"] == r["a_q90"] == 7 and r["a_p"] == 1.0


def test_climatology_falls_back_to_all_rows(spark, frame):
    m = models.Climatology(H, 10.0)
    with pytest.raises(RuntimeError):
        m.predict(frame)
    p = m.fit(frame).predict(frame.limit(1).withColumn("bin_a", F.lit(99))).first()
    assert p["a_pred"] == pytest.approx(10.0) and p["a_p"] == pytest.approx(0.5)


def test_linear_filter_finds_a_line(spark, frame):
    r = models.LinearFilter(H, 10.0, inputs=["last"]).fit(frame).predict(frame).where("last = 4").first()
    assert r["a_pred"] == pytest.approx(9.0, abs=1e-6)


def test_boosted_trees(spark, frame):
    m = models.BoostedTrees(H, 10.0, inputs=["last"], trees=3, depth=3).fit(frame)
    r = m.predict(frame).where("last = 9").first()
    assert r["a_q10"] <= r["a_q50"] <= r["a_q90"] and r["a_p"] > 0.5 and m.importance("a")["last"] == pytest.approx(1.0)


def plain_trees(x, targets, taus, trees, depth, bins, rate, least):
    """The same boosting by sorting and looping: scores of every model for every row."""
    edges = [sorted(set(np.quantile(x[:, j], [k / bins for k in range(1, bins)]))) for j in range(x.shape[1])]
    binned = np.stack([[sum(e < v for e in es) for v in x[:, j]] for j, es in enumerate(edges)], axis=1)
    out = np.zeros((len(x), len(taus)))
    for m, tau in enumerate(taus):
        y = targets[:, m]
        ok = ~np.isnan(y)
        logistic = tau == trees_module.LOGISTIC
        p = min(max(y[ok].mean(), 1e-6), 1 - 1e-6)
        f = np.full(len(x), np.log(p / (1 - p)) if logistic else np.quantile(y[ok], tau))
        for _ in range(trees):
            prob = 1 / (1 + np.exp(-f))
            g, h = (y - prob, prob * (1 - prob)) if logistic else (tau - (y < f), np.ones(len(x)))
            node = np.zeros(len(x), dtype=int)
            for d in range(depth):
                for k in range(2**d - 1, 2 ** (d + 1) - 1):
                    own = (node == k) & ok
                    worth = lambda r: g[r].sum() ** 2 / h[r].sum() if h[r].sum() > 0 else 0.0  # noqa: B023, E731
                    best = (0.0, 0, 0)
                    for j in range(x.shape[1]):
                        for b in range(len(edges[j])):
                            left = own & (binned[:, j] <= b)
                            if left.sum() >= least and own.sum() - left.sum() >= least:
                                best = max(best, (round(worth(left) + worth(own & ~left) - worth(own), 9), -j, -b))
                    if best[0] > 0:
                        node = np.where(node == k, 2 * k + 1 + (binned[:, -best[1]] > -best[2]), node)
            for k in set(node[ok]):
                own = (node == k) & ok
                f = np.where(node == k, f + rate * (g[own].sum() / h[own].sum() if logistic else np.quantile((y - f)[own], tau)), f)
        out[:, m] = f
    return out


def test_quantile_trees_equal_a_plain_version(spark):
    r = np.random.default_rng(4)
    x = np.round(r.normal(0, 1, (300, 3)), 3)
    y = 2 * x[:, 0] + np.where(x[:, 1] > 0.3, 3, 0) + r.gamma(2, 1, 300)
    taus = [0.1, 0.5, 0.9, trees_module.LOGISTIC]
    targets = np.stack([y, y, y, (y > 2).astype(float)], axis=1)
    targets[::23] = np.nan
    rows = [(i, *map(float, a), [(m, float(v)) for m, v in enumerate(t) if v == v]) for i, (a, t) in enumerate(zip(x, targets, strict=True))]
    df = spark.createDataFrame(rows, "id int, a double, b double, c double, targets array<struct<m: int, y: double>>").repartition(3)
    size = {"trees": 4, "depth": 3, "bins": 8, "rate": 0.3, "least": 10}
    e = trees_module.fit(df, ["a", "b", "c"], taus, **size)
    got = np.array([q["f"] for q in df.withColumn("f", e.score()).orderBy("id").select("f").collect()])
    np.testing.assert_allclose(got, plain_trees(x, targets, taus, **size), atol=1e-9)
    again = trees_module.Ensemble(**json.loads(json.dumps(e.state())))
    assert df.limit(0).withColumn("f", e.score()).count() == 0
    np.testing.assert_array_equal(got, np.array([q["f"] for q in df.withColumn("f", again.score()).orderBy("id").select("f").collect()]))


def test_each_quantile_has_its_own_loss(spark):
    """On rows never seen, skewed noise whose width depends on an input: outer quantiles beat the median moved by a constant."""
    r = np.random.default_rng(9)
    a = r.uniform(0, 1, 3000)
    y = 5 * a + r.exponential(0.2 + 3 * a)
    df = spark.createDataFrame([(i, float(v), float(w)) for i, (v, w) in enumerate(zip(a, y, strict=True))], "id int, last double, y_a double")
    m = models.BoostedTrees(H, 5.0, inputs=["last"], trees=12, depth=3).fit(df.where("id < 2000"))
    p = m.predict(df.where("id >= 2000")).toPandas()
    pin = lambda q, t: np.maximum(t * (p.y_a - q), (t - 1) * (p.y_a - q)).mean()
    rest = (y[:2000] - 5 * a[:2000]) - np.median(y[:2000] - 5 * a[:2000])
    for c, t in (("a_q10", 0.1), ("a_q90", 0.9)):
        assert pin(p[c], t) < 0.97 * pin(p.a_q50 + np.quantile(rest, t), t)
    assert 0.74 < ((p.y_a >= p.a_q10) & (p.y_a <= p.a_q90)).mean() < 0.86
    assert np.mean((p.a_p - (p.y_a >= 5)) ** 2) < 0.8 * np.var(p.y_a >= 5)


def test_models_without_targets_or_with_one_class(spark, frame):
    m = models.BoostedTrees({"a": 1, "none": 2}, 1e9, inputs=["last"], trees=2, depth=2).fit(frame.withColumn("y_none", F.lit(None).cast("double")))
    r = m.predict(frame).first()
    assert r["a_p"] < 0.01 and r["none_q50"] == 0.0


def test_least_squares_from_sums_equal_numpy(spark):
    """Large offsets, an input that others determine, one that never changes, and targets that are missing for some horizons."""
    r = np.random.default_rng(2)
    x = np.column_stack([r.normal(400, 30, 500), r.normal(1e6, 2, 500), r.normal(0, 1, 500)])
    y = 0.3 * x[:, 0] - 2 * x[:, 1] + x[:, 2] + r.normal(0, 0.5, 500)
    rows = [(i, *map(float, a), float(a[0] + a[2]), 7.0, float(v), float(v * 2) if i % 3 else None) for i, (a, v) in enumerate(zip(x, y, strict=True))]
    df = spark.createDataFrame(rows, "id int, u double, v double, w double, same double, flat double, y_a double, y_b double").repartition(4)
    m = models.LinearFilter({"a": 1, "b": 2}, 3.0, inputs=["u", "v", "w", "same", "flat"]).fit(df)
    p = m.predict(df).orderBy("id").toPandas()
    for h, keep in (("a", np.ones(500, bool)), ("b", np.arange(500) % 3 > 0)):
        design = np.column_stack([x - x.mean(0), np.ones(500)])
        t = y * (2 if h == "b" else 1)
        w = np.linalg.lstsq(design[keep], t[keep], rcond=None)[0]
        np.testing.assert_allclose(p[f"{h}_pred"], design @ w, atol=1e-5)
        assert m.sigma[h] == pytest.approx(np.std(t[keep] - (design @ w)[keep]), rel=1e-5)
    assert models.LinearFilter(H, 3.0, inputs=["u"]).fit(df.where("y_a IS NULL")).models["a"][0] == [0.0]


def test_registry():
    with pytest.raises(RuntimeError, match="torch"):
        models.build_model("tft")
    with pytest.raises(ValueError):
        models.build_model("nope")
    models.register_model("mine", models.Persistence)
    assert isinstance(models.build_model("mine"), models.Persistence)


def test_scaler_is_undone(spark, frame):
    s = models.fit_scaler(frame.withColumn("flat", F.lit(3.0)), ["last", "flat"], "robust")
    assert s["scale"][1] == 1.0
    back = models.apply_scaler(models.apply_scaler(frame, s), s, inverse=True)
    assert back.agg(F.max(F.abs(F.col("last") - F.col("id") % 10))).first()[0] < 1e-12


def test_payload_and_small_functions(spark):
    q = {"p10": F.lit(1.0), "p50": F.lit(2.0), "p90": F.lit(3.0), "p": F.lit(1.5)}
    r = spark.range(1).select(X.payload(F.timestamp_seconds(F.lit(0)), F.lit("s"), {"6h": q}).alias("m"), X.quantised_kp(F.lit(2.5)).alias("k"), X.alert_level(F.lit(None).cast("double")).alias("lvl"), X.lut_bin(F.lit(-1.0), 24).alias("b")).first()
    assert r["m"]["horizons"]["6h"]["flux"] == 100.0 and r["m"]["horizons"]["6h"]["p_exceed"] == 1.0 and r["m"]["issued_utc"] == "1970-01-01T00:00:00Z"
    assert r["k"] == pytest.approx(8 / 3) and r["lvl"] == "NOMINAL" and r["b"] == 23
    f = models.lut_forecast(spark.createDataFrame([(None,), (0.5,)], "mlt double"), [(1.0, 0.2), (3.5, 0.2)]).collect()
    assert f[0]["q50"] == 3.5 and f[1]["q50"] == 1.0


def test_state_classes():
    w = online.Welford()
    for v in (1e9 + 1, 1e9 + 2, 1e9 + 3, 1e9 + 4, 1e9 + 5):
        w.update(v)
    assert w.sample_variance() == pytest.approx(2.5)
    w.remove(1e9 + 1)
    assert w.n == 4 and w.mean == pytest.approx(1e9 + 3.5)
    with pytest.raises(ValueError):
        online.Welford().remove(1.0)
    m, xs = online.MonotonicDeque(3), [5, 1, 4, 2, 2, 9, 0]
    assert [m.push(x) for x in xs] == [max(xs[max(0, i - 2) : i + 1]) for i in range(len(xs))]
    b = online.RingBuffer(2)
    assert [b.append(i) for i in range(4)] == [None, None, 0, 1] and b[0] == 2 and b[-1] == 3


def test_stream_equals_batch(spark, tmp_path):
    rows = spark.range(300).select(F.concat(F.lit("s"), (F.col("id") % 2).cast("string")).alias("sat_id"), F.timestamp_seconds(F.col("id") * 60 + 6000).alias("time"), F.when(F.col("id") % 7 != 3, F.sin("id")).alias("x"))
    parts = [rows.where((F.unix_seconds("time") >= 6000 * k) & (F.unix_seconds("time") < 6000 * (k + 1))) for k in range(1, 4)]
    parts[0].write.parquet(f"{tmp_path}/in")
    q = online.stream_features(spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in"), 20, "0 seconds", 60).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").outputMode("append").start()
    q.processAllAvailable()
    for p in parts[1:]:
        p.write.mode("append").parquet(f"{tmp_path}/in")
        q.processAllAvailable()
    q.stop()
    s = spark.read.parquet(f"{tmp_path}/out").orderBy("sat_id", "time").toPandas()
    b = online.batch_replay(rows, 20).orderBy("sat_id", "time").toPandas()
    assert len(s) == len(b)
    for c in ("n", "mean", "std", "high", "low", "lag1"):
        assert (s[c].astype(float) - b[c].astype(float)).abs().max() < 1e-9, c


def test_event_time_plans(spark, tmp_path):
    rows = spark.range(20).select(F.lit("s").alias("sat_id"), F.timestamp_seconds(F.col("id") * 60 + 600_000).alias("time"), F.col("id").cast("double").alias("x"))
    rows.unionByName(rows).write.parquet(f"{tmp_path}/in")
    src = lambda: spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
    q = online.event_grid(src()).writeStream.format("memory").queryName("grid_t").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r["n"] for r in spark.table("grid_t").collect()) == [10, 10, 10, 10]
    q = online.without_repeats(src()).writeStream.format("memory").queryName("once_t").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("once_t").count() == 20
    q = src().writeStream.foreachBatch(online.keep_latest(f"{tmp_path}/t")).option("checkpointLocation", f"{tmp_path}/cp").start()
    q.processAllAvailable()
    q.stop()
    assert read_version(spark, f"file://{tmp_path}/t").first()["x"] == 19.0
    online.keep_latest(f"file://{tmp_path}/t")(rows.where("x < 3"), 7)  # a batch that comes again changes nothing
    assert read_version(spark, f"file://{tmp_path}/t").first()["x"] == 19.0
    (tmp_path / "t/v000000000099").mkdir()  # a version that was lost before it was complete
    assert read_version(spark, f"file://{tmp_path}/t").first()["x"] == 19.0


def test_whole_vector_in_a_stream_equals_the_batch_one(spark, tmp_path):
    lags, rolling = {"log_flux_e2": (1, 12), "vsw": (30,)}, {"vsw": ((12, "mean"), (24, "std"), (24, "max")), "log_flux_e2": ((24, "mean"),), "bz_gsm": ((12, "min"),)}
    i = F.col("id")
    rows = spark.range(240).select(
        F.concat(F.lit("s"), (i % 2).cast("string")).alias("sat_id"), F.timestamp_seconds(F.floor(i / 2) * 300 + 1_600_000_200).alias("time"), F.sin("id").alias("log_flux_e2"),
        F.when(i % 11 != 4, 400 + 30 * F.cos(i / 7)).alias("vsw"), (5 + F.sin(i / 3)).alias("density"), (3 * F.cos(i / 5)).alias("bz_gsm"), F.lit(4.0).alias("bt"),
    )
    (tmp_path / "in").mkdir()
    src = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
    cut = [1_600_000_200 + 300 * k for k in (0, 50, 51, 90, 120)]
    q = None
    for a, b in zip(cut, cut[1:], strict=False):
        rows.where((F.unix_seconds("time") >= a) & (F.unix_seconds("time") < b)).write.mode("append").parquet(f"{tmp_path}/in")
        q = q or online.stream_vector(src, lags, rolling, '0 seconds').writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").outputMode("append").start()
        q.processAllAvailable()
    q.stop()
    s = spark.read.parquet(f"{tmp_path}/out").orderBy("sat_id", "time").toPandas()
    b = online.batch_vector(rows, lags, rolling).orderBy("sat_id", "time").toPandas()
    assert len(s) == len(b) == 240 and set(s.columns) == set(b.columns)
    for c in s.columns:
        if c not in ("sat_id", "time"):
            x, y = s[c].astype(float), b[c].astype(float)
            assert (x.isna() == y.isna()).all() and (x - y).abs().fillna(0).max() < 1e-9, c


def test_serving(spark, tmp_path):
    from tidegrid.streaming import serve

    cache = serve.ForecastCache(2)
    for k in "abc":
        cache.put(k, k.upper())
    assert cache.get("a") is None and cache.get("c") == "C" and (cache.hits, cache.misses, len(cache)) == (1, 1, 2)
    path, table = f"file://{tmp_path}/f", [(2.0, 0.3)] * 24
    assert serve.answer(spark, path, "s")[0] == 503
    rows = spark.createDataFrame([("s", 1_600_000_000, 2.5), ("s", 1_600_000_300, 3.5), ("z", 1_600_000_000, 1.0)], "sat_id string, t long, last double").select("sat_id", F.timestamp_seconds("t").alias("time"), "last")
    serve.refresh(path, [models.Persistence()], table)(rows, 0)
    assert serve.answer(spark, path, "s", "6h")[1]["model"] == "table"  # nothing is fitted
    serve.refresh(path, [models.Persistence().fit(rows)], table)(rows.withColumn("time", F.timestamp_seconds(F.unix_seconds("time") + 600)), 1)
    code, body = serve.answer(spark, path, "s", "6h")
    assert code == 200 and body["model"] == "persistence" and body["q50"] == pytest.approx(10**3.5) and body["issued_utc"] == "2020-09-13T12:41:40Z"
    assert serve.answer(spark, path, "s", "9h")[0] == 404 and serve.check_vector([1.0], 2)[0] == 422 and set(serve.answer(spark, path, "z")[1]["horizons"]) == {"nowcast", "6h", "12h"}
    both = rows.withColumn("bin", F.lit(1))
    half = models.Climatology({"6h": 72}, 3.0)
    half.table, half.fitted = spark.createDataFrame([("6h", 1, 1.0, 0.5, 1.0, 1.5, 0.2, 3), ("6h", None, None, None, None, None, None, 0)], "horizon string, bin int, mean double, q10 double, q50 double, q90 double, freq double, n long"), True
    some = serve.predict_chain(both.withColumn("bin_6h", F.when(F.col("sat_id") == "s", 1)), [half, models.Persistence({"6h": 72}).fit(rows)], table, {"6h": 72}).collect()
    assert {r["sat_id"]: r["model"] for r in some} == {"s": "climatology", "z": "persistence"} and all(r["6h_pred"] == (1.0 if r["sat_id"] == "s" else r["last"]) for r in some)
    sent = []
    push = serve.push_changes(sent.append)
    for epoch in (0, 1):
        push(read_version(spark, path), epoch)
    assert sorted(x["sat_id"] for x in sent) == ["s", "z"]


def test_exact_quantiles_equal_numpy(spark):
    r = np.random.default_rng(3)
    x = np.concatenate([r.normal(0, 1, 3000), r.integers(0, 5, 3000).astype(float), [1e6, -1e6, 0.0]])
    g = (np.arange(len(x)) % 3).tolist()
    df = spark.createDataFrame([(a, float(b)) for a, b in zip(g, x, strict=True)] + [(0, None), (7, None)], "g int, v double")
    ps = (0.0, 0.1, 0.5, 0.9, 0.99, 1.0)
    got = {q["g"]: q["q"] for q in exact_quantiles(df, ["g"], "v", ps).collect()}
    assert set(got) == {0, 1, 2}
    for k, q in got.items():
        np.testing.assert_allclose(q, np.quantile(x[np.array(g) == k], ps), rtol=1e-12, atol=1e-12)
    assert exact_quantiles(df.where("g = 7"), [], "v", ps).count() == 0


def test_linear_filter_equals_least_squares(spark):
    r = np.random.default_rng(5)
    x = r.normal(size=(400, 3))
    y = x @ [1.5, -2.0, 0.3] + 0.7 + r.normal(0, 0.1, 400)
    df = spark.createDataFrame([(*map(float, row), float(t)) for row, t in zip(x, y, strict=True)], "a double, b double, c double, y_6h double")
    m = models.LinearFilter({"6h": 72}, 3.0, inputs=["a", "b", "c"]).fit(df)
    a = np.column_stack([x, np.ones(400)])
    w = np.linalg.lstsq(a, y, rcond=None)[0]
    np.testing.assert_allclose([*m.models["6h"][0], m.models["6h"][1]], w, atol=1e-8)
    assert m.sigma["6h"] == pytest.approx((y - a @ w).std(), abs=1e-9)


def _sent(spark, run):
    """Records that the stages of run() write to shuffles."""
    store = spark.sparkContext._jsc.sc().statusStore()

    def stages():
        found = store.stageList(None, False, False, getattr(store, "stageList$default$4")(), None)
        return {s.stageId(): s.shuffleWriteRecords() for s in map(found.apply, range(found.size()))}

    before = max(stages(), default=-1)
    run()
    return sum(n for k, n in stages().items() if k > before)


def test_what_a_tree_sends_follows_the_model_and_not_the_rows(spark):
    """Shuffled records of two trees more, for rows and four times as many; all targets differ."""
    sent = {}
    for n in (4000, 16000):
        rows = spark.range(n).select((F.col("id") % 64).cast("double").alias("a"), F.array(*[F.struct(F.lit(m).alias("m"), (F.rand(m) / 10).alias("y")) for m in range(3)]).alias("targets")).localCheckpoint()
        one, three = (_sent(spark, lambda t=t, rows=rows: trees_module.fit(rows, ["a"], [0.1, 0.5, 0.9], trees=t, depth=2, bins=8)) for t in (1, 3))
        sent[n] = three - one
    assert 0 < sent[16000] < 2 * sent[4000], sent
