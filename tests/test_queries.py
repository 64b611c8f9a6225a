"""Every query against its SQL on the smallest driver tables, where they are there."""

import os

import duckdb
import pytest

from tidegrid.plans import queries

HERE = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings labels".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(HERE), reason="driver tables are not there")


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{HERE}/{t}.parquet'")
    return c


def plain(rows):
    return sorted((tuple("NULL" if v is None or v != v else round(float(v), 6) + 0.0 if not isinstance(v, (bool, str)) else str(v) for v in r) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_agrees_with_sql(spark, db, name):
    df = queries.QUERIES[name](spark, HERE)
    cols = sorted(df.columns)
    want = db.execute(f"SELECT {', '.join(cols)} FROM ({queries.SQL[name]})").fetchall()
    assert plain(map(tuple, df.select(*cols).collect())) == plain(want)


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.SQL)))
def test_query_without_sql_runs(spark, name):
    assert queries.QUERIES[name](spark, HERE).count() > 0


def test_unroll_windows_has_every_anchor(spark):
    """Brute force: 72 values up to the anchor, then its last value for each of the 144 steps of the decoder."""
    g = sorted((r["t"], r["flux"] or 0.0) for r in queries.QUERIES["resample_grid_5min"](spark, HERE).collect())
    flux = [f for _, f in g]
    got = {}
    for r in queries.QUERIES["unroll_windows"](spark, HERE).collect():
        got.setdefault(r["anchor"], {})[r["time_idx"]] = r["value"]
    assert sorted(got) == [t for t, _ in g[71 : len(g) - 144]]
    for i in range(71, len(g) - 144):
        want = flux[i - 71 : i + 1] + [flux[i]] * 144
        assert [got[g[i][0]].get(k) for k in range(216)] == pytest.approx(want, abs=1e-4)
        assert len(got[g[i][0]]) == 216


def test_gbt_quantiles_has_every_anchor_and_horizon(spark):
    """Four fifths of the fitted targets lie between the outer quantiles, and the median is nearer than a constant."""
    got = {r["t"]: r for r in queries.QUERIES["gbt_quantiles"](spark, HERE).collect()}
    want = {r["t"]: r for r in queries.QUERIES["supervised_targets"](spark, HERE).collect()}
    assert sorted(got) == sorted(want)
    for h in queries.H:
        y = {t: r[f"y_{h}"] for t, r in want.items()}
        mid = sorted(y.values())[len(y) // 2]
        assert all(got[t][f"{h}_q10"] <= got[t][f"{h}_q50"] <= got[t][f"{h}_q90"] and 0 <= got[t][f"{h}_p"] <= 1 for t in y)
        assert sum(got[t][f"{h}_q10"] - 1e-5 <= v <= got[t][f"{h}_q90"] + 1e-5 for t, v in y.items()) / len(y) == pytest.approx(0.8, abs=0.05)
        assert sum(abs(got[t][f"{h}_q50"] - v) for t, v in y.items()) < sum(abs(mid - v) for v in y.values())


def test_manifest_upsert_counts_every_event(spark, db):
    got = {r["file"]: (r["n_records"], r["first_t"], r["last_t"]) for r in queries.QUERIES["manifest_upsert"](spark, HERE).collect()}
    want = {r[0]: r[1:] for r in db.execute("SELECT event_type, count(*), min(epoch_us(ts) // 1000000), max(epoch_us(ts) // 1000000) FROM events GROUP BY 1").fetchall()}
    assert got == want
