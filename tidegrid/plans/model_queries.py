"""Queries of fitted models, reports, stored windows and guarded tables."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from statistics import NormalDist

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import add_coupling, bin_of_angle, climatology_bin, cyclic, day_of_year, hour_of_day, local_time
from ..operators import clean as C
from ..operators import grid as G
from ..operators import halo
from ..operators import metrics as M
from ..operators import windows as W
from ..schema import Settings
from ..sources import shards, sinks
from ..sources.folders import kept, read_version, scratch
from . import models, views
from .queries import EVAL_ROWS, G1F, GN, TEST, THR, H, L, _scored, query

# ------------------------------------------------------------------ least squares, against Gram-Schmidt in SQL
REFM_INPUTS = ("v_last", "v_mean", "v_recent", "v_recent_max", "v_change", "flux_last")
REFM_AHEAD = {"nowcast": 1, "6h": 6, "12h": 12}
Z90 = NormalDist().inv_cdf(0.9)


def _refm_sql() -> str:
    """Each input in turn is freed of those before it, and the forecast takes up what of the target lies along it."""
    out = GN + """,
d AS (SELECT t, flux_e2, coalesce(vsw, 0) AS v_last, coalesce(avg(vsw) OVER w, 0) AS v_mean, coalesce(avg(vsw) OVER r, 0) AS v_recent, coalesce(max(vsw) OVER r, 0) AS v_recent_max, coalesce(vsw - first_value(vsw) OVER w, 0) AS v_change, coalesce(flux_e2, 0) AS flux_last
FROM n WINDOW w AS (ORDER BY t ROWS BETWEEN 23 PRECEDING AND CURRENT ROW), r AS (ORDER BY t ROWS BETWEEN 11 PRECEDING AND CURRENT ROW) QUALIFY count(*) OVER w = 24)"""
    known = "FILTER (WHERE y IS NOT NULL) OVER ()"
    for h, k in REFM_AHEAD.items():
        at, cols = f"a_{h}", REFM_INPUTS
        out += f",\n{at}_y AS (SELECT t, lead(flux_e2, {k}) OVER (ORDER BY t) AS y, {', '.join(cols)} FROM d)"
        out += f",\n{at}_0 AS (SELECT t, y, avg(y) OVER () AS p, {', '.join(f'{c} - avg({c}) {known} AS {c}' for c in cols)} FROM {at}_y)"
        for j, c in enumerate(cols):
            share = lambda v, c=c: f"coalesce(sum({v} * {c}) {known} / nullif(sum({c} * {c}) {known}, 0), 0)"
            rest = [f"{v} - {c} * {share(v)} AS {v}" for v in cols[j + 1 :]]
            out += f",\n{at}_{j + 1} AS (SELECT t, y, p + {c} * {share('y')} AS p{''.join(', ' + v for v in rest)} FROM {at}_{j})"
    rows = " UNION ALL ".join(f"SELECT t, '{h}' AS horizon, y, p AS pred, sqrt(avg((y - p) ** 2) OVER ()) AS s FROM a_{h}_{len(REFM_INPUTS)}" for h in REFM_AHEAD)
    return f"""{out},
f AS ({rows}),
z AS (SELECT *, least(greatest(({THR} - pred) / s, -9), 9) AS z FROM f),
i AS (SELECT i / 400.0 AS u, CASE WHEN i IN (0, 400) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END / 1200.0 AS w FROM range(0, 401) x(i))
--
SELECT t, horizon, y, pred, pred - {Z90} * s AS q10, pred + {Z90} * s AS q90, 0.5 - (SELECT sum(w * z.z * exp(-power(u * z.z, 2) / 2)) FROM i) / sqrt(2 * pi()) AS p FROM z"""


@query(_refm_sql(), "t horizon")
def refm_fit(spark: SparkSession, d: str) -> DataFrame:
    x = W.filter_design(views.grid_n(spark, d), views.HOUR, 24, 12, flux="flux_e2", chunk_steps=4096).withColumn("last", F.col("flux_last"))
    x = halo.windowed(x, views.HOUR, 0, 12, lambda d, w: d.withColumns({f"y_{h}": F.lead("flux_e2", k).over(w) for h, k in REFM_AHEAD.items()}))
    m = models.LinearFilter(REFM_AHEAD, THR, inputs=list(REFM_INPUTS)).fit(x)
    return M.by_horizon(m.predict(x), ["time"], H, {"y": "y_{h}", "pred": "{h}_pred", "q10": "{h}_q10", "q90": "{h}_q90", "p": "{h}_p"})


@query()
def gbt_quantiles(spark: SparkSession, d: str) -> DataFrame:
    """Fitted on all anchors and predicted for all of them, every horizon."""
    a = views.anchor_frame(spark, d)
    x = kept(a.join(W.window_stats(views.filled(spark, d), views.FIVE, ["flux"], L).drop("flux"), "time"))
    m = models.BoostedTrees(H, THR, inputs=["flux_last", "flux_mean", "flux_std", "flux_min", "flux_max"], trees=8, depth=3).fit(x)
    return m.predict(x).select("time", *[f"{h}_{c}" for h in H for c in ("q10", "q50", "q90", "p")])


# ------------------------------------------------------------------ reports
@query(
    TEST + f"""
--
SELECT CASE WHEN grouping(model) = 1 THEN 'all' ELSE model END AS model, CASE WHEN grouping(horizon) = 1 THEN 'all' ELSE horizon END AS horizon, sqrt(avg((y - pred) ** 2)) AS rmse, avg(abs(y - pred)) AS mae, avg(pred - y) AS bias,
 1 - avg((y - pred) ** 2) / nullif(var_pop(y), 0) AS pe, 1 - avg((y - pred) ** 2) / nullif(avg((y - ref) ** 2), 0) AS skill, count_if(y >= {THR} AND pred >= {THR})::DOUBLE AS hits, count_if(y < {THR} AND pred >= {THR})::DOUBLE AS false_alarms,
 avg((p - (y >= {THR})::INT) ** 2) AS brier, avg((y BETWEEN q10 AND q90)::INT) AS picp, count(*) AS n
FROM {EVAL_ROWS} GROUP BY GROUPING SETS ((model, horizon), (model), (horizon), ())""",
    "model horizon n",
)
def report_sets(spark: SparkSession, d: str) -> DataFrame:
    """A model's rows bring the forecast of persistence along; its scores and both totals come from one aggregate."""
    t = M.report(M.with_persistence(_scored(spark, d, "climatology"), "climatology", THR), THR)
    return t.select("model", "horizon", "rmse", "mae", "bias", "pe", "skill", "hits", "false_alarms", "brier", "picp", "n")


@query(
    TEST + """
--
SELECT horizon, power(10, sqrt(avg((log10(greatest(y, 1e-2)) - log10(greatest(pred, 1e-2))) ** 2))) AS uncertainty_factor FROM pc GROUP BY 1""",
    "horizon",
)
def uncertainty_factor(spark: SparkSession, d: str) -> DataFrame:
    from ..functions import log10_floor

    return _scored(spark, d, "climatology").groupBy("horizon").agg(M.uncertainty_factor(log10_floor(F.col("y"), 1e-2), log10_floor(F.col("pred"), 1e-2)).alias("uncertainty_factor"))


# ------------------------------------------------------------------ windows that are stored once
@query(
    f"""{G1F},
w AS (SELECT t, flux, sum(flux::FLOAT::DOUBLE) OVER b AS total, first_value(flux::FLOAT::DOUBLE) OVER b AS oldest, sum((flux / 2)::FLOAT::DOUBLE) OVER b AS halves, count(*) OVER b AS nb, count(*) OVER a AS na,
 sum(hour(to_timestamp(t) AT TIME ZONE 'UTC')) OVER a AS hours, lead(flux, 8) OVER (ORDER BY t) AS y_nowcast FROM f
 WINDOW b AS (ORDER BY t ROWS BETWEEN {L - 1} PRECEDING AND CURRENT ROW), a AS (ORDER BY t ROWS BETWEEN 1 FOLLOWING AND 144 FOLLOWING))
--
SELECT t, y_nowcast, total, oldest, flux::FLOAT::DOUBLE AS newest, halves, hours::DOUBLE AS hours, {L} AS n_back, 144 AS n_ahead FROM w WHERE nb = {L} AND na = 144""",
    "t n_back n_ahead",
)
def window_tensors(spark: SparkSession, d: str) -> DataFrame:
    """Windows written as chunks and places, cut again on reading, and summed up."""
    g = views.filled(spark, d).withColumns({"half": F.col("flux") / 2, "hour": F.hour("time").cast("double")})
    path = scratch(spark)
    shards.write_windows(g, views.FIVE, ["flux", "half"], "flux", path, L, horizons=H, threshold=THR, future=("hour",), chunk_steps=1024)
    add = lambda of, j: F.aggregate(of, F.lit(0.0), lambda a, r: a + r[j].cast("double"))
    cell = lambda i: F.element_at("X", i)[0].cast("double")
    return shards.read_windows(spark, path).select("time", "y_nowcast", add("X", 0).alias("total"), cell(1).alias("oldest"), cell(-1).alias("newest"), add("X", 1).alias("halves"), add("X_future", 0).alias("hours"), F.size("X").alias("n_back"), F.size("X_future").alias("n_ahead"))


# ------------------------------------------------------------------ tables that several write, and rows that are checked
@query("SELECT event_type AS file, count(*) AS n_records, min(epoch_us(ts) // 1000000) AS first_t, max(epoch_us(ts) // 1000000) AS last_t FROM events GROUP BY 1", "file n_records first_t last_t")
def concurrent_manifest(spark: SparkSession, d: str) -> DataFrame:
    """A writer for each type at the same time, all into one manifest; no row is lost, and one that comes again changes nothing."""
    e, path = views.events(spark, d), scratch(spark)
    kinds = [r["event_type"] for r in e.select("event_type").distinct().collect()]  # a handful

    def record(kind: str) -> None:
        row = sinks.manifest_row(e.where(F.col("event_type") == kind).select("time", "value"), kind, kind)
        sinks.upsert_rows(spark, path, row, ["file"], {kind: 1})

    with ThreadPoolExecutor(4) as pool:
        list(pool.map(record, [*kinds, *kinds]))
    m = read_version(spark, path)
    return m.select("file", "n_records", F.unix_seconds("start").alias("first_t"), F.unix_seconds("end").alias("last_t"))


@query(f"{GN}\n--\nSELECT t, flux_e2, vsw, density, bz_gsm, bt FROM n", "t")
def checked_write(spark: SparkSession, d: str) -> DataFrame:
    """Rows are checked by the job that writes them; a second version, with a repeated time and infinite values, is never seen."""
    g, path = views.grid_n(spark, d).drop("flux_seed"), scratch(spark)

    def write(df: DataFrame) -> None:
        timed, rules = G.with_time_rules(df, views.HOUR)
        rules |= {k: v for k, v in G.merged_rules(df)[1].items()}
        sinks.write_checked(timed, path, rules, drop=["__previous"])

    write(g)
    try:
        write(g.unionByName(g.where("vsw IS NOT NULL").limit(1).withColumn("vsw", F.lit(float("inf")))))
    except sinks.Rejected:
        pass
    return read_version(spark, path).select("time", "flux_e2", "vsw", "density", "bz_gsm", "bt")


# ------------------------------------------------------------------ functions on inputs of their own
@query(
    GN + """, p AS (SELECT *, density - 3 AS b_y, sqrt(power(density - 3, 2) + power(bz_gsm, 2)) AS bt_yz, atan2(density - 3, bz_gsm) AS clock, density * 1.67262192369e-27 * 1e6 * power(vsw * 1e3, 2) * 1e9 AS pd FROM n)
--
SELECT t, clock, power(vsw, 4.0/3) * power(bt_yz, 2.0/3) * power(abs(sin(clock / 2)), 8.0/3) AS newell, vsw * bt * bt * power(sin(clock / 2), 4) AS epsilon, pd AS pdyn, vsw * CASE WHEN bz_gsm - 20 < 0 THEN 20 - bz_gsm ELSE 0 END * 1e-3 AS vbs, (10.22 + 1.29 * tanh(0.184 * (bz_gsm + 8.14))) * power(pd, -1/6.6) AS standoff FROM p""",
    "t",
)
def coupling_by(spark: SparkSession, d: str) -> DataFrame:
    """Coupling functions with both components of the field; the southward one often."""
    from ..functions import southward

    g = add_coupling(views.grid_n(spark, d).withColumn("by_gsm", F.col("density") - 3))
    return g.select("time", "clock", "newell", "epsilon", "pdyn", southward(F.col("vsw"), F.col("bz_gsm") - 20).alias("vbs"), "standoff")


@query(
    """WITH e AS (SELECT event_id, value, (epoch_us(ts) // 1000000) % 86400 / 3600.0 AS hod, dayofyear(ts) + (hour(ts) + minute(ts) / 60.0) / 24.0 AS doy FROM events)
--
SELECT event_id, (((least(floor(hod / 24 * 7), 6) * 10 + least(greatest(floor(value / 20), 0), 9)) * 37 + least(floor(doy / 365.25 * 37), 36)) * 11 + least(floor((hod + 83.07 / 15) % 24 / 24 * 11), 10))::INT AS cell FROM e""",
    "event_id cell",
)
def climatology_cells(spark: SparkSession, d: str) -> DataFrame:
    """Cells of time of day, activity, season and local time, all four of more than one value."""
    e = views.events(spark, d)
    turn = lambda x, period, n: bin_of_angle(*cyclic(x, period), n)
    t = F.col("time")
    cell = climatology_bin(turn(hour_of_day(t), 24.0, 7), F.col("value") / 20, turn(day_of_year(t), 365.25, 37), turn(local_time(t, F.lit(83.07)), 24.0, 11), n_kp=10, n_doy=37, n_mlt=11)
    return e.select("event_id", cell.alias("cell"))


def _chain_sql(channels: tuple[str, ...], gap: int) -> str:
    out = GN
    for c in channels:
        seven = "(ORDER BY t ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)"
        out += f""",
m_{c} AS (SELECT t, {c} AS v, median({c}) OVER {seven} AS med FROM n),
o_{c} AS (SELECT t, CASE WHEN NOT coalesce(abs(v - med) > 3 * 1.4826 * median(abs(v - med)) OVER {seven}, false) THEN v END AS v FROM m_{c}),
e_{c} AS (SELECT t, v, max(t) FILTER (WHERE v IS NOT NULL) OVER (ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS pt, min(t) FILTER (WHERE v IS NOT NULL) OVER (ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS nt FROM o_{c}),
f_{c} AS (SELECT e.t, coalesce(e.v IS NULL AND nt - pt <= {gap + 1} * 3600, false) AS made, CASE WHEN e.v IS NULL AND nt - pt <= {gap + 1} * 3600 THEN p.v + (q.v - p.v) * (e.t - pt) / (nt - pt) ELSE e.v END AS v FROM e_{c} e LEFT JOIN o_{c} p ON p.t = pt LEFT JOIN o_{c} q ON q.t = nt)"""
    return out


CHAIN = ("flux_e2", "vsw", "density")


@query(
    _chain_sql(CHAIN, 2) + """
--
SELECT a.t, a.v AS flux_e2, b.v AS vsw, c.v AS density, a.made::TINYINT AS flux_e2_imputed, b.made::TINYINT AS vsw_imputed, c.made::TINYINT AS density_imputed,
 c.v * 1.67262192369e-27 * 1e6 * power(b.v * 1e3, 2) * 1e9 AS pdyn, CASE WHEN a.v IS NOT NULL THEN log10(greatest(a.v, 1e-2)) END AS log_flux_e2 FROM f_flux_e2 a JOIN f_vsw b USING (t) JOIN f_density c USING (t)""",
    "t flux_e2_imputed vsw_imputed density_imputed",
)
def preprocess_chain(spark: SparkSession, d: str) -> DataFrame:
    """Despiking, short gaps, pressure and log flux in one plan."""
    p = C.preprocess(views.grid_n(spark, d).select("time", *CHAIN), views.HOUR, CHAIN, Settings(max_gap=2))
    return p.select("time", *CHAIN, *[f"{c}_imputed" for c in CHAIN], "pdyn", "log_flux_e2")
