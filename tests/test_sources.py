"""CDF files, JSON feeds, tables, manifests."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegrid.operators import grid as G
from tidegrid.schema import Grid, settings_from
from tidegrid.sources import cdf, feeds, sinks, synthetic


def test_cdf_round_trip(spark, tmp_path):
    t = [1_435_708_500_000_000 + i * 300_000_000 for i in range(50)]
    x, v = np.linspace(0, 10, 50), np.full(50, 400.0)
    x[7] = np.nan
    v[3] = 5000.0
    cdf.write_cdf(f"{tmp_path}/a.cdf", t, {"flux_e2": x, "vsw": v}, {"vsw": {"UNITS": "km/s", "VALIDMAX": 2000.0}})
    assert cdf.list_variables(f"{tmp_path}/a.cdf") == ["Epoch", "flux_e2", "vsw"]
    assert cdf.list_data_variables(f"{tmp_path}/a.cdf") == ["flux_e2", "vsw"]
    assert cdf.variable_meta(f"{tmp_path}/a.cdf", "vsw")["units"] == "km/s"
    w = cdf.wide(cdf.read_cdf(spark, [f"{tmp_path}/a.cdf"]), ["flux_e2", "vsw"]).orderBy("time").select(F.unix_micros("time").alias("t"), "flux_e2", "vsw").toPandas()
    assert w.t.tolist() == t
    np.testing.assert_array_equal(w.flux_e2.to_numpy(), x)
    assert np.isnan(w.vsw[3]) and w.vsw[4] == 400
    assert {r["var"] for r in cdf.read_cdf(spark, [f"{tmp_path}/a.cdf"], ["vsw"]).collect()} == {"vsw"}


def test_leap_second_times_round_trip():
    base = 1_435_708_800 * 10**9  # 2015-07-01, a leap second lies before it
    for s in (-10, -1, 0, 1, 10):
        assert cdf.unix_ns_of(cdf.tt2000_of(base + s * 10**9)) == base + s * 10**9
    assert cdf.tt2000_of(base) - cdf.tt2000_of(base - 10**9) == 2 * 10**9


def test_feeds(spark):
    lists = json.dumps([["time_tag", "speed", "note"], ["2024-01-01 00:00:00", "400.5", "a"], ["2024-01-01 00:05:00", None, "b"]])
    f = feeds.finalise(feeds.parse_lists(spark, lists))
    assert dict(f.dtypes) == {"time": "timestamp", "speed": "double", "note": "string"} and f.count() == 2
    assert feeds.parse_lists(spark, "[]").count() == 0
    recs = json.dumps([{"time_tag": "2024-01-01T00:00:00Z", "energy": ">=2 MeV", "flux": 12.5}, {"time_tag": "2024-01-01T00:00:00Z", "energy": ">=0.8 MeV", "flux": 99}])
    e = feeds.electrons(feeds.finalise(feeds.parse_records(spark, recs)))
    assert [r["flux_e2"] for r in e.collect()] == [12.5]
    k = feeds.kp(spark.createDataFrame([(3.0,)], "Kp double").select(F.to_timestamp(F.lit("2024-01-01")).alias("time"), "Kp"))
    sw = feeds.solar_wind(f.select("time", "speed"), f.select("time", F.lit(1.0).alias("bz")))
    m = feeds.merged_realtime(e, sw, k).orderBy("time").collect()
    assert [r["kp"] for r in m] == [3.0, 3.0] and m[0]["vsw"] == 400.5
    assert feeds.alerts({"no": 1}) == []
    h = feeds.hapi_frame(spark, [["2024-01-01T00:00:00Z", [1.5, 2.0], -1e31], ["2024-01-01T00:01:00Z", [2.5, 2.0], 7.0]], [("t", None), ("a", None), ("b", -1e31)]).collect()
    assert [(r["a"], r["b"]) for r in h] == [(1.5, None), (2.5, 7.0)]


def test_tables_states_and_manifest(spark, tmp_path):
    d = synthetic.time_axis(spark, 1).select("time", F.col("i").cast("double").alias("x"))
    sinks.write_grid(d, f"{tmp_path}/g")
    assert sinks.read_grid(spark, f"{tmp_path}/g", ["x"]).count() == 288
    sinks.save_state(spark, {"a": [1.0]}, f"{tmp_path}/s")
    assert sinks.load_state(spark, f"{tmp_path}/s") == {"a": [1.0]}
    a, b = sinks.manifest_row(d, "f1", "x"), sinks.manifest_row(d, "f2", "x")
    assert sorted(r["file"] for r in sinks.upsert(a.unionByName(b), a.withColumn("sha256", F.lit("new")), ["file"]).where("sha256 = 'x'").collect()) == ["f2"]


def test_recursion_is_the_loop(spark):
    d = synthetic.time_axis(spark, 40).withColumn("e", F.sin(F.col("i") * 1.7))
    r = synthetic.ou_process(d, "e", "x", 0.1, 2.0, 5.0).orderBy("i").toPandas()
    x, want = 5.0, []
    for e in r.e:
        x = 0.9 * x + 2.0 * e
        want.append(x)
    np.testing.assert_allclose(r.x.to_numpy(), want, rtol=1e-9, atol=1e-9)


def test_demo_dataset_is_valid(spark):
    d = synthetic.demo_dataset(spark, 3)
    assert d.count() == 864
    assert not G.check_time(d.select("time"), Grid())
    assert any("log_flux_seed is missing" in p for p in G.validate_merged(d))
    assert d.where("flux_e2_imputed = 1 AND flux_e2 IS NOT NULL").count() == 0


def test_validation_finds_each_fault(spark):
    from tidegrid.schema import MERGED_COLUMNS

    good = spark.range(5).select(F.timestamp_seconds(F.col("id") * 300).alias("time"), *[F.lit(1.0).alias(c) for c in MERGED_COLUMNS], F.lit(0).cast("tinyint").alias("vsw_imputed"))
    assert G.validate_merged(good) == [] and G.check_time(good, Grid()) == []
    for col, value, text in (("mlt", 24.0, "mlt"), ("kp", 9.5, "kp"), ("vsw", float("inf"), "infinite"), ("vsw_imputed", 3, "not 0 or 1")):
        assert any(text in p for p in G.validate_merged(good.withColumn(col, F.lit(value)))), col
    assert G.check_time(good.unionByName(good), Grid()) and G.check_time(good.where("time <> timestamp_seconds(600)"), Grid())


def test_settings():
    s = settings_from({"lookback": 12, "model": {"name": "refm", "ridge": 1}})
    assert s.lookback == 12 and s.model == "refm" and s.params == {"ridge": 1}
    with pytest.raises(ValueError):
        settings_from({"nope": 1})


def test_cdf_forms(spark, tmp_path):
    """Compressed as a whole, column-major, and equal times in a file, of which the last value counts."""
    import gzip
    import struct

    t = [1_435_708_500_000_000 + i * 300_000_000 for i in range(4)]
    plain = cdf.cdf_bytes([t[0], t[1], t[1], t[3]], {"a": [1.0, 2.0, 3.0, 4.0]})
    body = gzip.compress(plain[8:])
    packed = plain[:4] + b"\xcc\xcc\x00\x01" + struct.pack(">qiqqi", len(body) + 32, 10, 40 + len(body), len(plain) - 8, 0) + body + struct.pack(">qiiiii", 28, 11, 5, 0, 1, 5)
    (tmp_path / "z.cdf").write_bytes(packed)
    w = cdf.wide(cdf.read_cdf(spark, [f"file://{tmp_path}/z.cdf"]), ["a"]).orderBy("time").collect()
    assert [r["a"] for r in w] == [1.0, 3.0, 4.0]
    f = cdf.File(plain)
    f.vars["a"].dims, f.vars["a"].n, f.row_major = (2, 2), 1, False
    assert f.values("a").tolist() == [[[1.0, 3.0], [2.0, 4.0]]]
    with pytest.raises(ValueError, match="files of their own"):
        cdf.File(plain[:43] + bytes([plain[43] & ~2]) + plain[44:])


def test_cdf_files_by_period(spark, tmp_path):
    d = synthetic.time_axis(spark, 60).select("time", F.col("i").cast("double").alias("vsw"), F.lit(None).cast("double").alias("kp"), F.lit("s1").alias("sat_id"))
    files = cdf.write_cdf_files(d, f"file://{tmp_path}/c", kind="omni", keys=("sat_id",)).collect()
    assert sorted(r["path"].rpartition("/")[2] for r in files) == ["s1-202001.cdf", "s1-202002.cdf"] and sum(r["n"] for r in files) == 60 * 288
    back = cdf.wide(cdf.read_cdf(spark, [r["path"] for r in files]), ["vsw", "kp"])
    assert back.join(d, ["time", "vsw"]).count() == 60 * 288 and back.where("kp IS NOT NULL").count() == 0


@pytest.fixture
def server(tmp_path):
    """A local archive: HAPI answers by hour, and a list of two CDF files."""
    import http.server
    import threading
    from urllib.parse import parse_qs, urlparse

    day = 1_704_067_200
    for k in range(2):
        cdf.write_cdf(f"{tmp_path}/f{k}.cdf", [(day + 86400 * k + 300 * i) * 1_000_000 for i in range(3)], {"B": [float(k), float("nan"), 2.0]})

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):  # noqa: N802
            u = urlparse(self.path)
            q = {k: v[0] for k, v in parse_qs(u.query).items()}
            if u.path == "/hapi/info":
                body = json.dumps({"parameters": [{"name": "Time"}, {"name": "V", "fill": "9999"}, {"name": "B", "size": [2], "fill": None}, {"name": "W"}]})
            elif u.path == "/hapi/data":
                hour = int(q["time.min"][11:13])
                body = f"{q['time.min']},{400 + hour},1.5,2.5,x\n{q['time.min'][:14]}30:00Z,9999,3.5,4.5,7\n"
            elif u.path.startswith("/cda/D/data/"):
                body = json.dumps({"FileDescription": [{"Name": f"http://127.0.0.1:{self.server.server_port}/f{k}.cdf"} for k in range(2)]})
            elif u.path.endswith(".cdf"):
                body = (tmp_path / u.path[1:]).read_bytes()
            else:
                self.send_error(404)
                return
            self.send_response(200)
            self.end_headers()
            self.wfile.write(body if isinstance(body, bytes) else body.encode())

        def log_message(self, *a):
            pass

    s = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_port}"
    s.shutdown()


def test_fetches(spark, server):
    from tidegrid.sources import fetch

    h = fetch.fetch_hapi(spark, None, "D", ["V", "B", "W"], "2024-01-01T00:00:00Z", "2024-01-01T03:00:00Z", hours=1, url=f"{server}/hapi/").orderBy("time").collect()
    assert [(r["V"], r["B"], r["W"]) for r in h] == [x for k in range(3) for x in ((400.0 + k, 1.5, None), (None, 3.5, 7.0))]
    c = fetch.fetch_cdaweb(spark, "D", ["B", "absent"], "2024-01-01", "2024-01-03", base=f"{server}/cda").orderBy("time").collect()
    assert [(r["B"], r["absent"]) for r in c] == [(0.0, None), (None, None), (2.0, None), (1.0, None), (None, None), (2.0, None)]
    assert fetch.archive() == fetch.archive("cdaweb") and len({fetch.archive(n) for n in fetch.HAPI_SERVERS}) == 7 and fetch.archive("amda", "http://other/") == "http://other"
    with pytest.raises(ValueError, match="no archive is called"):
        fetch.archive("nowhere")
    with pytest.raises(RuntimeError, match="check the network"):
        fetch.get(f"{server}/none")
    assert fetch.resolve_source(spark, lambda s: s.range(1)).count() == 1 and fetch.resolve_source(spark).isStreaming
