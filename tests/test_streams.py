"""Streams with late, repeated and replayed input against their batch forms; tables that several write; windows stored once."""

import math
import random
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidegrid.operators import grid as G
from tidegrid.operators import windows as W
from tidegrid.schema import Grid
from tidegrid.sources import folders, shards, sinks
from tidegrid.streaming import feed, online, serve
from tidegrid.streaming.history import History, last_rows

#: Times of tests count from here; a stream's watermark begins at the epoch.
BASE = 1_500_000_000
SAMPLES = "sat_id string, time timestamp, x double"


def samples(spark, rows):
    return spark.createDataFrame([(s, BASE + float(t), x) for s, t, x in rows], "sat_id string, t double, x double").select("sat_id", F.timestamp_seconds("t").alias("time"), "x")


def run(spark, parts, window=3, late="1000 seconds", span=300):
    far = 10_000_000
    arrivals = [{"s": samples(spark, p)} for p in [*parts, [("~", far, None)]]]
    out = feed.fed(spark, arrivals, lambda s: online.stream_features(s, window, late, span), online.ROCKSDB)
    return {(r["sat_id"], r["time"].timestamp() - BASE): r for r in out.collect()}


# ------------------------------------------------------------------ state
@pytest.mark.parametrize("kind", ["plain", "large", "wide"])
def test_a_channel_equals_plain_windows(kind):
    """Values in and out of moments and deques, kept as state and taken up again at any point."""
    r = random.Random(1)
    xs = {"plain": [r.gauss(100, 15) for _ in range(5000)], "large": [1e9 + i % 5 + 1 for i in range(1000)], "wide": [r.gauss(0, 1000) for _ in range(2000)]}[kind]
    n, lags, rolling = 37, (1, 12), [(37, s) for s in ("n", "mean", "std", "max", "min")] + [(5, "max")]
    c = online.Channel(lags, rolling)
    for i, x in enumerate(xs):
        c.push(x)
        if i % 97 == 0:
            c = online.Channel(lags, rolling, c.state())
        w = xs[max(0, i - n + 1) : i + 1]
        assert (c.over(n, "n"), c.over(n, "max"), c.over(n, "min"), c.over(5, "max")) == (len(w), max(w), min(w), max(w[-5:]))
        assert c.over(n, "mean") == pytest.approx(np.mean(w), rel=1e-12) and c.lag(12) == (xs[i - 12] if i >= 12 else None)
        assert (c.over(n, "std") is None) == (len(w) < 2) and (len(w) < 2 or math.isclose(c.over(n, "std"), np.std(w, ddof=1), rel_tol=1e-6, abs_tol=1e-6))


def test_state_is_of_bounded_size():
    c = online.Channel((1,), [(72, "max"), (72, "mean")])
    for i in range(10_000):
        c.push(float(-i))
    assert all(len(v) <= 73 for v in c.state()[1:])


@pytest.mark.parametrize("cut", [1, 31, 32, 71, 500])
def test_many_samples_leave_what_single_ones_leave(cut):
    r = random.Random(4)
    xs = np.array([math.nan] * 40 + [r.choice([math.nan, *[r.gauss(0, 5)] * 6]) for _ in range(1960)])
    lags, rolling = (1, 12), [(n, s) for n in (1, 12, 72) for s in ("n", "mean", "std", "max", "min")]
    one, many = online.Channel(lags, rolling), online.Channel(lags, rolling)
    for i in range(0, len(xs), cut):
        x, back, over = many.take(xs[i : i + cut], lags, rolling)
        for k, v in enumerate(xs[i : i + cut]):
            one.repeat() if math.isnan(v) else one.push(v)
            want = [one.lag(0), *[one.lag(j) for j in lags], *[one.over(n, s) for n, s in rolling]]
            assert [x[k], *[b[k] for b in back], *[o[k] for o in over]] == pytest.approx([math.nan if w is None else w for w in want], abs=1e-9, nan_ok=True)
        a, b = one.state(), many.state()
        assert a[0] == b[0] and a[1] == b[1] and a[2] == pytest.approx(b[2], abs=1e-7) and a[3:] == b[3:]
        many = online.Channel(lags, rolling, b)


class Handle(dict):
    """State in dictionaries; counts the values that are written to what waits and the keys that are listed."""

    def __init__(self):
        super().__init__()
        self.timers, self.written, self.listed = set(), 0, 0

    def getMapState(self, name, *schema):  # noqa: N802
        h, state = self, self.setdefault(name, {})

        class Map:
            containsKey, getValue, removeKey = staticmethod(state.__contains__), staticmethod(state.get), staticmethod(state.pop)  # noqa: N815

            def updateValue(self, k, v):  # noqa: N802
                h.written += sum(map(len, v)) if name == "waiting" else 0
                state[k] = v

            def keys(self):
                h.listed += len(state)
                return iter(list(state))

            def iterator(self):
                h.listed += len(state)
                return iter(list(state.items()))

        return Map()

    def getValueState(self, name, *schema):  # noqa: N802
        state = self.setdefault(name, {})
        return type("Value", (), {"get": lambda _: state.get(0), "update": lambda _, v: state.update({0: v})})()

    def registerTimer(self, ms):  # noqa: N802
        self.timers.add(ms)


@pytest.mark.parametrize("span", [60, 10_000_000])
def test_work_of_a_series_grows_with_its_samples(span):
    """Very many spans that pass at once, and a span that comes in very many parts."""
    work = {}
    for size in (500, 1000):
        h, p = Handle(), online.OnlineSeries(["x"], {"x": (1,)}, {"x": [(3, "mean")]}, span)
        p.GATHER = 10
        p.init(h)
        rows = pd.DataFrame({"us": [60_000_000 * (i + 1) for i in range(size)], "x": [float(i) for i in range(size)]})
        list(p.handleInputRows(("s",), iter([rows[i : i + 10] for i in range(0, size, 10)]), None))
        mark, out = max(h.timers), []
        for t in sorted(h.timers):
            out += p.handleExpiredTimer(("s",), type("Times", (), {"getCurrentWatermarkInMs": lambda _, m=mark: m})(), type("Info", (), {"getExpiryTimeInMs": lambda _, t=t: t})())
        out = pd.concat(out)
        assert out["x"].tolist() == rows["x"].tolist() and out["x_roll3_mean"].tolist()[2:] == pytest.approx([float(i - 1) for i in range(2, size)])
        assert not h["waiting"] and not h.get("parts")
        work[size] = h.written + h.listed
    assert work[1000] <= 2.1 * work[500]


# ------------------------------------------------------------------ streams
def test_late_and_repeated_samples_stand_where_they_belong(spark):
    got = run(spark, [[("s", 0, 1.0), ("s", 300, 2.0), ("s", 900, 4.0)], [("s", 600, 3.0), ("s", 900, 4.0)]])
    assert {t: (r["n"], r["mean"], r["lag1"]) for (_, t), r in got.items()} == {0: (1, 1.0, None), 300: (2, 1.5, 1.0), 600: (3, 2.0, 2.0), 900: (3, 3.0, 3.0)}


def test_too_late_samples_change_nothing(spark):
    parts = [[("s", 300 * i, float(i)) for i in range(10)], [("s", 300 * i, float(i)) for i in range(10, 20)], [("s", 450, 99.0), ("s", 600, 99.0), ("s", 6000, 20.0)]]
    got = run(spark, parts)
    assert sorted(t for _, t in got) == [300.0 * i for i in range(21)] and all(r["x"] == t / 300 for (_, t), r in got.items())


def test_any_order_within_the_bound_gives_the_batch_result(spark):
    r = random.Random(3)
    rows = [(f"s{i % 3}", 60 * (i // 3) + r.choice([0, 0, 0.5]), r.choice([None, *([r.gauss(0, 5)] * 6)])) for i in range(600)]
    rows += [(s, t, x) for s, t, x in rows[::17]] + [("s0", 600, 7.5), ("s0", 600, -7.5)]
    rows = [(s, t, x) for s, t, x in rows if t != 600 or s != "s0"] + [("s0", 600, 7.5), ("s0", 600, -7.5), ("s0", 600, None)]
    came = sorted(rows, key=lambda x: x[1] + r.uniform(0, 900))
    parts = [came[i : i + 130] for i in range(0, len(came), 130)]
    got = run(spark, parts, 20)
    once = samples(spark, rows).groupBy("sat_id", "time").agg(F.max("x").alias("x"))
    want = {(x["sat_id"], x["time"].timestamp() - BASE): x for x in online.batch_replay(once, 20).collect()}
    assert got.keys() == want.keys() and len(parts) >= 5
    for k, w in want.items():
        for c in ("x", "n", "mean", "std", "high", "low", "lag1"):
            assert (got[k][c] is None) == (w[c] is None) and (w[c] is None or got[k][c] == pytest.approx(w[c], abs=1e-9)), (k, c)


def test_three_feeds_joined_as_they_arrive(spark):
    r = random.Random(5)
    feeds = {c: [(u, 60.0 * t + 60, float(t + u)) for u in range(3) for t in range(60) if r.random() < share] for c, share in (("a", 0.7), ("b", 0.5), ("c", 0.2))}
    frame = lambda c, rows: spark.createDataFrame(rows, "u int, t double, v double").select("u", F.timestamp_seconds("t").alias("time"), F.col("v").alias(c))
    parts = []
    for k in range(5):
        new = {c: [x for x in rows if (x[1] + 420 * (x[0] == 1)) // 720 == k] for c, rows in feeds.items()}  # one series comes late
        again = {c: [x for x in rows if x[1] // 720 == k - 1 and x[1] % 720 >= 600] for c, rows in feeds.items()}
        parts.append({c: frame(c, new[c] + (again[c] if k else [])) for c in feeds})
    parts.append({c: frame(c, [x for x in rows if (x[1] + 420 * (x[0] == 1)) // 720 == 5] + [(-1 - i, 1e6, None)]) for i, (c, rows) in enumerate(feeds.items())})
    got = feed.fed(spark, parts, lambda **f: feed.outer_merged(f, ("u",), "800 seconds")).where("u >= 0").collect()
    want = G.merge_sources([frame(c, rows) for c, rows in feeds.items()], on=("u", "time")).collect()
    key = lambda x: (x["u"], x["time"].timestamp(), x["a"], x["b"], x["c"])
    assert sorted(map(key, got), key=str) == sorted(map(key, want), key=str)


def test_settings_come_back(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    with feed.settings(spark, {name: "other", "spark.tidegrid.test": "1"}):
        assert spark.conf.get(name) == "other"
    assert spark.conf.get(name, None) == before and spark.conf.get("spark.tidegrid.test", None) is None


def test_interval_jobs_and_refresh_survive_a_replay(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    rows = samples(spark, [("s", 300 * i, float(i)) for i in range(5)])
    rows.write.parquet(f"{tmp_path}/in")
    h = History(spark, f"file://{tmp_path}/h")
    q = serve.every(spark.readStream.schema(SAMPLES).parquet(f"{tmp_path}/in"), h.append(), f"{tmp_path}/cp", 1)
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    assert h.read().count() == 5 and [p.name for p in (tmp_path / "h/log").iterdir()] == [q.id]
    run_latest = online.keep_latest(path, query="q")
    run_latest(rows.where("x < 3"), 0)
    run_latest(samples(spark, [("s", 9000, 9.0)]), 0)  # that epoch has been there
    assert folders.read_version(spark, path).first()["x"] == 2.0
    run_latest(rows, 1)
    assert folders.read_version(spark, path).first()["x"] == 4.0


# ------------------------------------------------------------------ history
def test_history_after_replays_crashes_and_compactions(spark, tmp_path):
    h = History(spark, f"file://{tmp_path}/h", depth=288, step=300)
    assert h.read() is None
    rows = [(s, 300 * i, float(i)) for s in ("a", "b") for i in range(1000)]
    parts = [samples(spark, [x for x in rows if x[1] // 60_000 == k]) for k in range(5)]
    one, other = h.append("one"), h.append("other")
    one(parts[0], 0)
    one(parts[0], 0)
    h.compact()
    one(parts[0], 0)
    parts[1].write.parquet(f"{tmp_path}/h/rows/lost")  # rows were written, and the writer died before its commit
    one(parts[1], 1)
    other(samples(spark, [("a", 299_700, -1.0)]), 0)
    one(parts[2], 2)
    h.compact()
    h.compact()
    one(parts[3], 3)
    one(parts[4], 4)
    want = {(s, float(t)) for s, t, _ in rows if t >= 300 * 712}
    for _ in range(2):
        got = [(r["sat_id"], r["time"].timestamp() - BASE) for r in h.read().collect()]
        assert len(got) == 576 and set(got) == want
        h.compact()
    long = spark.range(1000).select(F.lit("s").alias("sat_id"), F.timestamp_seconds(F.col("id") * 300).alias("time"))
    assert last_rows(long).agg(F.min("time"), F.count("*")).first()[1] == 288


# ------------------------------------------------------------------ versions
def test_concurrent_upserts_lose_nothing(spark, tmp_path):
    path = f"file://{tmp_path}/m"
    row = lambda k: spark.createDataFrame([(f"f{k}", k)], "file string, n long")
    with ThreadPoolExecutor(6) as pool:
        list(pool.map(lambda k: sinks.upsert_rows(spark, path, row(k), ["file"]), range(12)))
    assert sorted(tuple(r) for r in folders.read_version(spark, path).collect()) == sorted((f"f{k}", k) for k in range(12))
    assert folders.versions(spark, path) == list(range(12)) and len(list((tmp_path / "m/data").iterdir())) == 2
    assert sinks.upsert_rows(spark, path, row(3).withColumn("n", F.lit(99).cast("long")), ["file"], {"late": 5})
    assert not sinks.upsert_rows(spark, path, row(4), ["file"], {"late": 5}) and folders.read_version(spark, path).where("n = 99").count() == 1


def test_only_one_of_many_makes_a_version(spark, tmp_path):
    path = f"file://{tmp_path}/c"

    def attempt(k):
        try:
            return folders.commit(spark, path, None, {"by": k})
        except folders.Conflict:
            return None

    with ThreadPoolExecutor(8) as pool:
        assert sorted(x is not None for x in pool.map(attempt, range(16))) == [False] * 15 + [True]
    with pytest.raises(folders.Conflict):
        folders.commit(spark, path, 5, {})
    assert not [f for f in (tmp_path / "c/commits").iterdir() if f.name.startswith(".")and not f.name.endswith(".crc")]


def test_rejected_rows_are_never_seen(spark, tmp_path):
    path = f"file://{tmp_path}/g"
    good = spark.range(100).select(F.timestamp_seconds(F.col("id") * 300).alias("time"), (F.col("id") / 10).alias("kp"), (F.col("id") % 24).cast("double").alias("mlt"))

    def write(df):
        timed, rules = G.with_time_rules(df, Grid())
        sinks.write_checked(timed, path, rules | G.merged_rules(df)[1], drop=["__previous"])

    with pytest.raises(sinks.Rejected) as e:
        write(good.union(good.where("kp = 0.3")).withColumn("mlt", F.when(F.col("kp") == 0.3, 24.0).otherwise(F.col("mlt"))))
    assert e.value.found["repeated times"] == 1 and e.value.found["mlt is outside [0, 24)"] == 2
    assert folders.read_version(spark, path) is None and not list((tmp_path / "g/data").iterdir())
    write(good.where("kp <= 9"))
    assert folders.read_version(spark, path).count() == 91 and folders.read_version(spark, path).columns == ["time", "kp", "mlt"]
    notes = []
    folders.update_version(spark, path, lambda old: good, check=sinks.gate(G.merged_rules(good)[1], notes.append))
    assert notes == [{"kp is outside [0, 9]": 9}] and folders.read_version(spark, path).count() == 100


def test_checks_take_no_job_of_their_own(spark, tmp_path):
    sc, ran = spark.sparkContext, []
    df = spark.range(1000).select(F.col("id").cast("double").alias("kp"))
    for k, act in enumerate((lambda: df.write.parquet(f"{tmp_path}/plain"), lambda: sinks.write_checked(df.where("kp <= 9"), f"file://{tmp_path}/checked", G.merged_rules(df)[1]))):
        sc.setJobGroup(f"g{k}", "")
        act()
        ran.append(len(sc.statusTracker().getJobIdsForGroup(f"g{k}")))
    sc.setJobGroup("", "")
    assert ran[0] == ran[1]


# ------------------------------------------------------------------ windows that are stored once
@pytest.mark.parametrize(("lookback", "steps"), [(7, 16), (30, 16), (16, 64)])
def test_stored_windows_equal_arrays(spark, tmp_path, lookback, steps):
    i, grid = F.col("id"), Grid(keys=("sat_id",))
    d = spark.range(400).select(
        F.concat(F.lit("s"), (i % 2).cast("string")).alias("sat_id"), F.timestamp_seconds((F.floor(i / 2) + 1000 * (i % 2)) * 300).alias("time"), F.sin("id").alias("u"), F.when(i % 41 != 7, F.cos("id")).alias("v"),
        F.hour(F.timestamp_seconds(i * 300)).cast("double").alias("tod_sin"), F.lit(1.0).alias("tod_cos"),
    )
    for drop in (True, False):
        kw = {"decoder": 9, "horizons": {"a": 3}, "threshold": 0.5, "drop_missing": drop}
        path = f"{tmp_path}/{drop}"
        shards.write_windows(d, grid, ["u", "v"], "u", path, lookback, chunk_steps=steps, **kw)
        want = {(r["sat_id"], r["time"]): r for r in W.anchors(d, grid, ["u", "v"], "u", lookback, arrays=True, **kw).collect()}
        got = shards.read_windows(spark, path, batch_bytes=4 * 9 * lookback).collect()
        assert len(got) == len(want) > 50
        for r in got:
            w = want[r["sat_id"], r["time"]]
            assert (r["X"], r["X_future"], r["y_a"], r["y_exceed_a"]) == (w["X"], w["X_future"], w["y_a"], w["y_exceed_a"])
        assert shards.read_windows(spark, path, "sat_id = 's1'").count() == sum(k[0] == "s1" for k in want)
    assert shards.read_windows(spark, path, "sat_id = 'none'").count() == 0


def test_stored_windows_take_each_value_once(spark, tmp_path):
    d = spark.range(5000).select(F.timestamp_seconds(F.col("id") * 300).alias("time"), F.rand(1).alias("u"))
    sizes = {}
    for lookback in (8, 512):
        shards.write_windows(d, Grid(), ["u"], "u", f"{tmp_path}/{lookback}", lookback, decoder=4, horizons={"a": 1}, future=())
        sizes[lookback] = sum(f.stat().st_size for f in (tmp_path / str(lookback) / "chunks").glob("*.parquet"))
    assert sizes[512] < 1.2 * sizes[8] < 1.2 * 5000 * 4 * 2


def test_views_hold_no_values():
    x = np.arange(40, dtype=np.float32).reshape(20, 2)
    v = shards.views(x, np.array([5, 20]), 5)
    assert v.shape == (2, 5, 2) and (v[0] == x[:5]).all() and (v[1] == x[15:]).all()
