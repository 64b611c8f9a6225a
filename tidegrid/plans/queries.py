"""Every operator as a query over the driver's tables, with the SQL it must agree with.

Times are seconds since the epoch in results; doubles are rounded to six decimals on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import alert_level, climatology_bin, cyclic, exceeds, hour_of_day, log10_floor, mask_invalid, quantised_kp
from ..operators import clean as C
from ..operators import grid as G
from ..operators import halo
from ..operators import metrics as M
from ..operators import windows as W
from ..schema import DECODER_STEPS
from ..sources import cdf, feeds
from ..sources.folders import kept, scratch
from . import models, views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

H = views.STEPS
L = views.LOOKBACK
THR = views.THRESHOLD


#: Means of amounts in cents often lie half way between two roundings; this moves them off the edge on both sides.
NUDGE = 1.37e-8


def tidy(df: DataFrame) -> DataFrame:
    """Times as seconds, doubles rounded, no negative zero."""
    out = []
    for c, kind in df.dtypes:
        if kind == "timestamp":
            out.append(F.unix_seconds(c).alias("t" if c == "time" else c))
        elif kind in ("double", "float"):
            out.append((F.round(F.col(c).cast("double") + NUDGE, 6) + 0.0).alias(c))
        else:
            out.append(F.col(c))
    return df.select(*out)


def query(sql: str | None = None, plain: str = ""):
    """Register a query; `plain` names result columns that SQL must not round."""

    def add(f):
        QUERIES[f.__name__] = lambda spark, d: tidy(f(spark, d))
        if sql:
            with_part, _, body = sql.rpartition("\n--\n")
            keep = ", ".join(x for x in plain.split())
            cols = f"{keep}, round(COLUMNS(* EXCLUDE ({keep})) + {NUDGE}, 6) + 0.0" if keep else f"round(COLUMNS(*) + {NUDGE}, 6) + 0.0"
            SQL[f.__name__] = f"{with_part}\nSELECT {cols} FROM ({body})" if sql.count("\n--\n") else f"SELECT {cols} FROM ({sql})"
        return f

    return add


# ------------------------------------------------------------------ SQL of the views
G1 = """WITH b AS (SELECT (epoch_us(ts) // 300000000) * 300 AS t, avg(value) AS flux FROM events GROUP BY 1),
g AS (SELECT s.t, b.flux FROM (SELECT unnest(range(min(t), max(t) + 300, 300)) AS t FROM b) s LEFT JOIN b USING (t))"""


def gn(step: int) -> str:
    mean = "avg({v}) FILTER (WHERE event_type = '{k}') AS {n}"
    cols = ", ".join(mean.format(v=v, k=k, n=n) for n, k, v in (("flux_e2", "purchase", "value"), ("flux_seed", "signup", "value"), ("vsw", "click", "value + 300"), ("density", "view", "value / 10"), ("bz_gsm", "error", "50 - value")))
    return f"""WITH b AS (SELECT (epoch_us(ts) // {step}000000) * {step} AS t, {cols} FROM events GROUP BY 1),
n AS (SELECT s.t, flux_e2, flux_seed, vsw, density, bz_gsm, abs(bz_gsm) + 1 AS bt
  FROM (SELECT unnest(range(min(t), max(t) + {step}, {step})) AS t FROM b) s LEFT JOIN b USING (t))"""


GN = gn(3600)
ISLES = """,
i AS (SELECT t, flux, sum((flux IS NOT NULL)::INT) OVER (ORDER BY t) AS grp FROM g),
r AS (SELECT t, flux, sum((flux IS NULL)::INT) OVER (PARTITION BY grp) AS run,
  max(t) FILTER (WHERE flux IS NOT NULL) OVER (ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS pt,
  min(t) FILTER (WHERE flux IS NOT NULL) OVER (ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS nt FROM i),
k AS (SELECT r.t, r.flux, CASE WHEN r.flux IS NULL THEN run ELSE 0 END AS len, pt, nt, p.flux AS pv, q.flux AS nv
  FROM r LEFT JOIN g p ON p.t = pt LEFT JOIN g q ON q.t = nt)"""
SHORT = """,
s AS (SELECT t, CASE WHEN flux IS NULL AND len <= 6 AND pt IS NOT NULL AND nt IS NOT NULL THEN pv + (nv - pv) * (t - pt) / (nt - pt) ELSE flux END AS flux,
  (flux IS NULL AND len <= 6 AND pt IS NOT NULL AND nt IS NOT NULL)::TINYINT AS flux_imputed FROM k),
f AS (SELECT t, last_value(flux IGNORE NULLS) OVER (ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS flux FROM s)"""
G1F = G1 + ISLES + SHORT
ANCHOR = f""",
w AS (SELECT t, flux AS last, lead(flux, 8) OVER (ORDER BY t) AS y_nowcast, lead(flux, 72) OVER (ORDER BY t) AS y_6h, lead(flux, 144) OVER (ORDER BY t) AS y_12h,
  count(*) OVER (ORDER BY t ROWS BETWEEN {L - 1} PRECEDING AND CURRENT ROW) AS nb,
  count(*) OVER (ORDER BY t ROWS BETWEEN 1 FOLLOWING AND 144 FOLLOWING) AS na FROM f),
a AS (SELECT t, last, y_nowcast, y_6h, y_12h, (y_nowcast >= {THR})::TINYINT AS y_exceed_nowcast, (y_6h >= {THR})::TINYINT AS y_exceed_6h, (y_12h >= {THR})::TINYINT AS y_exceed_12h
  FROM w WHERE nb = {L} AND na = 144),
lg AS (SELECT t, 'nowcast' AS horizon, last, y_nowcast AS y FROM a UNION ALL SELECT t, '6h', last, y_6h FROM a UNION ALL SELECT t, '12h', last, y_12h FROM a)"""
G1A = G1F + ANCHOR


# ------------------------------------------------------------------ grids
@query(f"{G1}\n--\nSELECT t, flux FROM g", "t")
def resample_grid_5min(spark, d):
    return views.grid1(spark, d)


@query(
    """WITH b AS (SELECT (epoch_us(ts) // 3600000000) * 3600 AS t, avg(value) AS mean, max(value) AS high, min(value) AS low, sum(value) AS total, count(value) AS n, median(value) AS mid,
 arg_min(value, ts) AS first, arg_max(value, ts) AS last FROM events GROUP BY 1)
--
SELECT s.t, mean, high, low, total, n, mid, first, last FROM (SELECT unnest(range(min(t), max(t) + 3600, 3600)) AS t FROM b) s LEFT JOIN b USING (t)""",
    "t n",
)
def resample_agg_overrides(spark, d):
    how = {"mean": "mean", "high": "max", "low": "min", "total": "sum", "n": "count", "mid": "median", "first": "first", "last": "last"}
    e = views.events(spark, d).select("time", *[F.col("value").alias(c) for c in how])
    return G.resample(e, views.HOUR, list(how), overrides=how)


@query(gn(300) + "\n--\nSELECT t, (coalesce(flux_e2, flux_seed, vsw, density, bz_gsm) IS NULL)::TINYINT AS row_missing FROM n", "t row_missing")
def row_missing_flag(spark, d):
    return G.row_missing(views.grid_n(spark, d, views.FIVE), views.CHANNELS).select("time", "row_missing")


@query(f"{GN}\n--\nSELECT * FROM n", "t")
def channel_grid(spark, d):
    return views.grid_n(spark, d)


@query(
    f"""{GN}
--
SELECT count(*) AS n_rows, count_if(vsw IS NULL) AS vsw_null, count_if(abs(bz_gsm) = 'inf'::DOUBLE) AS bz_inf, count_if(flux_e2 > 200) AS flux_high, 0 AS bad_steps FROM n""",
    "n_rows vsw_null bz_inf flux_high bad_steps",
)
def validate_grid(spark, d):
    g = views.grid_n(spark, d)
    ranges = g.agg(F.count_if(F.col("vsw").isNull()).alias("vsw_null"), F.count_if(F.abs("bz_gsm") == float("inf")).alias("bz_inf"), F.count_if(F.col("flux_e2") > 200).alias("flux_high"))
    return G.time_steps(g, views.HOUR).join(ranges).select(F.col("n").alias("n_rows"), "vsw_null", "bz_inf", "flux_high", F.col("odd").cast("int").alias("bad_steps"))  # one row each


@query("SELECT o_orderkey, CASE WHEN o_totalprice >= 1000 AND o_totalprice <= 200000 AND NOT abs(o_totalprice - 150000) <= 1e-8 + 1e-5 * 150000 THEN o_totalprice END AS price FROM orders", "o_orderkey")
def mask_invalid_range(spark, d):
    return views.table(spark, d, "orders").select("o_orderkey", mask_invalid(F.col("o_totalprice"), fill=150000.0, lo=1000.0, hi=200000.0).alias("price"))


@query("SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey, arg_max(o_totalprice, (o_orderdate, o_orderkey)) AS o_totalprice FROM orders GROUP BY 1", "o_custkey o_orderkey")
def dedup_keep_last(spark, d):
    o = views.table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_totalprice")
    return G.keep_last(o, ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey", "o_totalprice")


@query("SELECT n_nationkey AS id, n_name AS name, n_regionkey::DOUBLE AS region FROM nation", "id name")
def harmonise_columns(spark, d):
    n = G.harmonise(views.table(spark, d, "nation"), {"n_nationkey": "id", "n_name": "name", "n_regionkey": "region"}, {"region": "double"})
    return n.select("id", "name", "region")


@query(
    """WITH m AS (SELECT event_type AS file, count(*) AS n_records, min(epoch_us(ts) // 1000000) AS first_t, max(epoch_us(ts) // 1000000) AS last_t, avg((value > 100)::INT) AS fill_fraction FROM events GROUP BY 1),
u AS (SELECT event_type AS file, count(*) AS n_records, min(epoch_us(ts) // 1000000) AS first_t, max(epoch_us(ts) // 1000000) AS last_t, avg((value > 100)::INT) AS fill_fraction FROM events WHERE event_type IN ('click', 'view') GROUP BY 1)
--
SELECT * FROM u UNION ALL SELECT * FROM m WHERE file NOT IN (SELECT file FROM u)""",
    "file n_records first_t last_t",
)
def manifest_upsert(spark, d):
    from ..sources.sinks import upsert

    e = views.events(spark, d)

    def entry(x):
        return x.groupBy(F.col("event_type").alias("file")).agg(F.count("*").alias("n_records"), F.min(F.unix_seconds("time")).alias("first_t"), F.max(F.unix_seconds("time")).alias("last_t"), F.avg((F.col("value") > 100).cast("int")).alias("fill_fraction"))

    fresh = F.col("file").isin("click", "view")
    old = entry(e).withColumn("n_records", F.when(fresh, F.lit(0).cast("bigint")).otherwise(F.col("n_records")))  # entries to be replaced differ from the new ones
    return upsert(old, entry(e.where("event_type IN ('click', 'view')")), ["file"])


# ------------------------------------------------------------------ cleaning
SPIKY = f"""{G1},
x AS (SELECT t, CASE WHEN (t // 300) % 97 = 0 THEN flux * 8 ELSE flux END AS flux FROM g),
m AS (SELECT t, flux, median(flux) OVER (ORDER BY t ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS med FROM x),
dv AS (SELECT t, flux, med, abs(flux - med) AS dev FROM m),
o AS (SELECT t, flux, med, coalesce(dev > 3 * 1.4826 * median(dev) OVER (ORDER BY t ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING), false) AS flux_outlier FROM dv)"""


@query(f"{SPIKY}\n--\nSELECT t, CASE WHEN NOT flux_outlier THEN flux END AS flux, flux_outlier FROM o", "t flux_outlier")
def hampel_flags(spark, d):
    return C.hampel(views.spiky(spark, d), views.FIVE, "flux")


@query(f"{SPIKY}\n--\nSELECT t, CASE WHEN flux_outlier THEN med ELSE flux END AS flux, flux_outlier FROM o", "t flux_outlier")
def hampel_median(spark, d):
    return C.hampel(views.spiky(spark, d), views.FIVE, "flux", replace="median")


@query(f"{G1}{ISLES}\n--\nSELECT t, flux, len::BIGINT AS gap_len FROM k", "t gap_len")
def gap_run_lengths(spark, d):
    return C.gap_lengths(views.grid1(spark, d), views.FIVE, "flux")


@query(f"{G1}{ISLES}\n--\nSELECT t, len BETWEEN 1 AND 2 AS short_gap, len > 2 AS long_gap FROM k", "t short_gap long_gap")
def gap_classes(spark, d):
    return C.gap_classes(views.grid1(spark, d), views.FIVE, "flux", 2).drop("flux")


@query(f"{G1F}\n--\nSELECT t, flux, flux_imputed FROM s", "t flux_imputed")
def interpolate_short(spark, d):
    return C.interpolate_short(views.grid1(spark, d), views.FIVE, "flux", 6)


@query(f"{G1}\n--\nSELECT t, last_value(flux IGNORE NULLS) OVER (ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS flux FROM g", "t")
def forward_fill(spark, d):
    return C.forward_fill(views.grid1(spark, d), views.FIVE, "flux")


# ------------------------------------------------------------------ one series per event type, with gaps
GK = """WITH b AS (SELECT event_type AS k, (epoch_us(ts) // 300000000) * 300 AS t, avg(value) AS flux FROM events GROUP BY 1, 2),
g AS (SELECT s.k, s.t, b.flux FROM (SELECT k, unnest(range(min(t), max(t) + 300, 300)) AS t FROM b GROUP BY k) s LEFT JOIN b USING (k, t)),
i AS (SELECT k, t, flux, sum((flux IS NOT NULL)::INT) OVER (PARTITION BY k ORDER BY t) AS grp FROM g),
r AS (SELECT k, t, flux, sum((flux IS NULL)::INT) OVER (PARTITION BY k, grp) AS run,
  max(t) FILTER (WHERE flux IS NOT NULL) OVER (PARTITION BY k ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS pt,
  min(t) FILTER (WHERE flux IS NOT NULL) OVER (PARTITION BY k ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS nt FROM i),
q AS (SELECT r.k, r.t, r.flux, CASE WHEN r.flux IS NULL THEN run ELSE 0 END AS len, pt, nt, p.flux AS pv, n.flux AS nv
  FROM r LEFT JOIN g p ON p.k = r.k AND p.t = pt LEFT JOIN g n ON n.k = r.k AND n.t = nt),
s AS (SELECT k, t, CASE WHEN flux IS NULL AND len <= 6 AND pt IS NOT NULL AND nt IS NOT NULL THEN pv + (nv - pv) * (t - pt) / (nt - pt) ELSE flux END AS flux,
  (flux IS NULL AND len <= 6 AND pt IS NOT NULL AND nt IS NOT NULL)::TINYINT AS flux_imputed FROM q),
f AS (SELECT k, t, last_value(flux IGNORE NULLS) OVER (PARTITION BY k ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS flux FROM s),
w AS (SELECT k, t, flux AS last, lead(flux, 8) OVER o AS y_nowcast, lead(flux, 72) OVER o AS y_6h, lead(flux, 144) OVER o AS y_12h,
  count(*) OVER (PARTITION BY k ORDER BY t ROWS BETWEEN 71 PRECEDING AND CURRENT ROW) AS nb, count(*) OVER (PARTITION BY k ORDER BY t ROWS BETWEEN 1 FOLLOWING AND 144 FOLLOWING) AS na FROM f WINDOW o AS (PARTITION BY k ORDER BY t)),
a AS (SELECT k, t, last, y_nowcast, y_6h, y_12h FROM w WHERE nb = 72 AND na = 144)"""


@query(f"{GK}\n--\nSELECT k AS event_type, t, flux FROM g", "event_type t")
def keyed_grid(spark, d):
    return views.grid_k(spark, d)


@query(f"{GK}\n--\nSELECT k AS event_type, t, flux, len::BIGINT AS gap_len FROM q", "event_type t gap_len")
def keyed_gap_lengths(spark, d):
    return C.gap_lengths(views.grid_k(spark, d), views.KEYED, "flux")


@query(f"{GK}\n--\nSELECT k AS event_type, t, flux, flux_imputed FROM s", "event_type t flux_imputed")
def keyed_interpolate(spark, d):
    return C.interpolate_short(views.grid_k(spark, d), views.KEYED, "flux", 6)


def _filled_k(spark, d):
    return C.forward_fill(C.interpolate_short(views.grid_k(spark, d), views.KEYED, "flux", 6).drop("flux_imputed"), views.KEYED, "flux")


@query(f"{GK}\n--\nSELECT k AS event_type, t, flux FROM f", "event_type t")
def keyed_forward_fill(spark, d):
    return _filled_k(spark, d)


@query(
    f"""{GK}
--
SELECT k AS event_type, t, flux, lag(flux, 12) OVER (PARTITION BY k ORDER BY t) AS flux_lag12, avg(flux) OVER x AS flux_roll72_mean, stddev_samp(flux) OVER x AS flux_roll72_std FROM g
WINDOW x AS (PARTITION BY k ORDER BY t ROWS BETWEEN 71 PRECEDING AND CURRENT ROW)""",
    "event_type t",
)
def keyed_features(spark, d):
    g = views.grid_k(spark, d)
    return W.feature_matrix(g, views.KEYED, {"flux": (12,)}, {"flux": ((72, "mean"), (72, "std"))}).drop("tod_sin", "tod_cos", "doy_sin", "doy_cos")


@query(f"{GK}\n--\nSELECT k AS event_type, t, last, y_nowcast, y_6h, y_12h FROM a WHERE last IS NOT NULL AND t >= (SELECT min(t) FROM f z WHERE z.k = a.k AND z.flux IS NOT NULL) + 71 * 300", "event_type t")
def keyed_anchors(spark, d):
    """Anchors of each series whose window has no missing value."""
    a = W.anchors(_filled_k(spark, d).withColumn("last", F.col("flux")), views.KEYED, ["flux"], "flux", L, horizons=H, threshold=THR, future=(), keep=("last",))
    return a.drop(*[f"y_exceed_{h}" for h in H])


@query(
    f"""{GK},
z AS (SELECT k, t, row_number() OVER (PARTITION BY k ORDER BY t) - 1 AS pos, count(*) OVER (PARTITION BY k) AS n FROM a)
--
SELECT k AS event_type, t, CASE WHEN pos < floor(n * 0.7) - 144 THEN 'train' WHEN pos >= floor(n * 0.7) + 144 AND pos < floor(n * 0.85) - 144 THEN 'val' WHEN pos >= floor(n * 0.85) + 144 THEN 'test' END AS split FROM z""",
    "event_type t split",
)
def keyed_split(spark, d):
    a = W.anchors(_filled_k(spark, d), views.KEYED, ["flux"], "flux", L, horizons=H, threshold=THR, future=())
    return W.chronological_split(a.select("event_type", "time"), views.KEYED, 0.7, 0.15, 144)


@query(
    f"""{GK},
m AS (SELECT k, t, flux, median(flux) OVER (PARTITION BY k ORDER BY t ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS med FROM f),
dv AS (SELECT k, t, flux, med, abs(flux - med) AS dev FROM m)
--
SELECT k AS event_type, t, flux > 0 AND coalesce(dev > 3 * 1.4826 * median(dev) OVER (PARTITION BY k ORDER BY t ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING), false) AS flux_outlier FROM dv""",
    "event_type t flux_outlier",
)
def keyed_hampel(spark, d):
    return C.hampel(_filled_k(spark, d), views.KEYED, "flux").select("event_type", "time", "flux_outlier")


# ------------------------------------------------------------------ features
@query(f"{G1}\n--\nSELECT t, flux, lag(flux, 1) OVER (ORDER BY t) AS flux_lag1, lag(flux, 12) OVER (ORDER BY t) AS flux_lag12, lag(flux, 288) OVER (ORDER BY t) AS flux_lag288 FROM g", "t")
def lags(spark, d):
    return W.add_lags(views.grid1(spark, d), views.FIVE, "flux", [1, 12, 288])


@query(
    f"""{G1}
--
SELECT t, flux, avg(flux) OVER w AS flux_roll12_mean, stddev_samp(flux) OVER w AS flux_roll12_std, min(flux) OVER w AS flux_roll12_min, max(flux) OVER w AS flux_roll12_max,
 avg(flux) OVER x AS flux_roll72_mean, stddev_samp(flux) OVER x AS flux_roll72_std, min(flux) OVER x AS flux_roll72_min, max(flux) OVER x AS flux_roll72_max
FROM g WINDOW w AS (ORDER BY t ROWS BETWEEN 11 PRECEDING AND CURRENT ROW), x AS (ORDER BY t ROWS BETWEEN 71 PRECEDING AND CURRENT ROW)""",
    "t",
)
def rolling_stats(spark, d):
    return W.add_rolling(views.grid1(spark, d), views.FIVE, "flux", [12, 72])


TIME_SQL = "(hour(ts) + minute(ts) / 60.0 + second(ts) / 3600.0)::DOUBLE"


@query(
    f"""SELECT event_id, sin(2 * pi() * {TIME_SQL} / 24) AS tod_sin, cos(2 * pi() * {TIME_SQL} / 24) AS tod_cos,
 sin(2 * pi() * (dayofyear(ts) + (hour(ts) + minute(ts) / 60.0) / 24) / 365.25) AS doy_sin, cos(2 * pi() * (dayofyear(ts) + (hour(ts) + minute(ts) / 60.0) / 24) / 365.25) AS doy_cos,
 sin(2 * pi() * fmod({TIME_SQL} + 83.0 / 15, 24) / 24) AS mlt_sin, cos(2 * pi() * fmod({TIME_SQL} + 83.0 / 15, 24) / 24) AS mlt_cos FROM events""",
    "event_id",
)
def cyclic_features(spark, d):
    from ..functions import add_cyclic, local_time

    e = views.events(spark, d).select("event_id", "time").withColumn("mlt", local_time(F.col("time"), F.lit(83.0)))
    return add_cyclic(e).drop("time", "mlt")


COUPLING = """, p AS (SELECT *, density * 1.67262192369e-27 * 1e6 * power(vsw * 1e3, 2) * 1e9 AS pdyn FROM n)"""


@query(
    GN + COUPLING + """
--
SELECT t, pdyn, vsw * CASE WHEN bz_gsm < 0 THEN -bz_gsm ELSE 0 END * 1e-3 AS vbs,
 power(vsw, 4.0/3) * power(abs(bz_gsm), 2.0/3) * power(abs(sin(atan2(0.0, bz_gsm) / 2)), 8.0/3) AS newell,
 vsw * bt * bt * power(sin(atan2(0.0, bz_gsm) / 2), 4) AS epsilon, atan2(0.0, bz_gsm) AS clock,
 (10.22 + 1.29 * tanh(0.184 * (bz_gsm + 8.14))) * power(pdyn, -1/6.6) AS standoff FROM p""",
    "t",
)
def coupling_functions(spark, d):
    from ..functions import add_coupling

    return add_coupling(views.grid_n(spark, d)).select("time", "pdyn", "vbs", "newell", "epsilon", "clock", "standoff")


@query("SELECT event_id, log10(greatest(value - 20, 0.01)) AS log_value, power(10, log10(greatest(value - 20, 0.01))) AS back FROM events", "event_id")
def log_floor(spark, d):
    from ..functions import inverse_log10

    x = log10_floor(F.col("value") - 20, 0.01)
    return views.events(spark, d).select("event_id", x.alias("log_value"), inverse_log10(x).alias("back"))


@query(
    f"""{G1},
x AS (SELECT t, flux, avg(flux) OVER (ORDER BY t ROWS BETWEEN 71 PRECEDING AND CURRENT ROW) AS m72, lag(flux, 12) OVER (ORDER BY t) AS l12 FROM g)
--
SELECT t, flux, sin(2 * pi() * (t % 86400 / 3600.0) / 24) AS tod_sin, cos(2 * pi() * (t % 86400 / 3600.0) / 24) AS tod_cos, l12 AS flux_lag12, m72 AS flux_roll72_mean FROM x""",
    "t",
)
def feature_matrix(spark, d):
    f = W.feature_matrix(views.grid1(spark, d), views.FIVE, {"flux": (12,)}, {"flux": ((72, "mean"),)})
    return f.drop("doy_sin", "doy_cos")


# ------------------------------------------------------------------ alignment
SHIFT = """, mv AS (SELECT t + 0 AS t0, t * 1000000 + floor((CASE WHEN vsw > 0 THEN 1.5e6 / vsw / 60 ELSE 47.0 END) * 60e6)::BIGINT AS us, vsw, density FROM n),
dd AS (SELECT us, arg_max(vsw, t0) AS vsw, arg_max(density, t0) AS density, max(t0) AS t0 FROM mv GROUP BY us),
dn AS (SELECT d.us, m.vsw, m.density FROM dd d JOIN mv m ON m.us = d.us AND m.t0 = d.t0),
sb AS (SELECT us // 3600000000 * 3600 AS t, avg(vsw) AS vsw, avg(density) AS density FROM dn GROUP BY 1),
sh AS (SELECT s.t, vsw, density FROM (SELECT unnest(range(min(t), max(t) + 3600, 3600)) AS t FROM sb) s LEFT JOIN sb USING (t))"""


@query(GN + SHIFT + "\n--\nSELECT * FROM sh", "t")
def ballistic_shift(spark, d):
    return G.shift_ballistic(views.grid_n(spark, d).select("time", "vsw", "density"), views.HOUR, ["vsw", "density"])


@query(GN + SHIFT + "\n--\nSELECT n.t, n.flux_e2, sh.vsw, sh.density FROM n JOIN sh USING (t)", "t")
def merge_inner(spark, d):
    n = views.grid_n(spark, d)
    return G.align(n.select("time", "flux_e2"), n.select("time", "vsw", "density"), views.HOUR, ["vsw", "density"])


@query(
    gn(300) + """
, a AS (SELECT t, flux_e2, vsw FROM n WHERE flux_e2 IS NOT NULL), b2 AS (SELECT t, vsw, density FROM n WHERE density IS NOT NULL), c AS (SELECT t, bz_gsm, density FROM n WHERE bz_gsm IS NOT NULL)
--
SELECT coalesce(a.t, b2.t, c.t) AS t, a.flux_e2, a.vsw, b2.density, c.bz_gsm FROM a FULL JOIN b2 ON a.t = b2.t FULL JOIN c ON c.t = coalesce(a.t, b2.t)""",
    "t",
)
def merge_outer_precedence(spark, d):
    n = views.grid_n(spark, d, views.FIVE)
    frames = [n.where("flux_e2 IS NOT NULL").select("time", "flux_e2", "vsw"), n.where("density IS NOT NULL").select("time", "vsw", "density"), n.where("bz_gsm IS NOT NULL").select("time", "bz_gsm", "density")]
    return G.merge_sources(frames)


@query(GN + "\n--\nSELECT n.t, CASE WHEN n.t % 7200 = 0 THEN n.density ELSE NULL END AS vsw, n.flux_e2 FROM n", "t")
def replace_channels(spark, d):
    n = views.grid_n(spark, d)
    fresh = n.where(F.unix_seconds("time") % 7200 == 0).select("time", F.col("density").alias("vsw"))
    return G.replace_channels(n.select("time", "vsw", "flux_e2"), fresh)


@query(
    GN + """
--
SELECT 'flux_e2' AS channel, max(abs(flux_e2 - flux_e2 * 1.001)) AS max_abs, count_if(abs(flux_e2 - flux_e2 * 1.001) > 0.05 + 1e-6 * abs(flux_e2 * 1.001)) AS n_off, count(flux_e2) AS n FROM n
UNION ALL SELECT 'vsw', max(abs(vsw - vsw * 1.001)), count_if(abs(vsw - vsw * 1.001) > 0.05 + 1e-6 * abs(vsw * 1.001)), count(vsw) FROM n""",
    "channel n_off n",
)
def roundtrip_deviation(spark, d):
    n = views.grid_n(spark, d).select("time", "flux_e2", "vsw")
    return G.deviations(n, n.withColumns({c: F.col(c) * 1.001 for c in ("flux_e2", "vsw")}), ["flux_e2", "vsw"], atol=0.05)


@query(GN + "\n--\nSELECT t, 2.0 AS kp, 100.0 AS f107, flux_e2 AS copy FROM n", "t")
def fill_absent(spark, d):
    n = views.grid_n(spark, d).select("time", "flux_e2").withColumn("kp", F.lit(None).cast("double"))
    return G.fill_absent(n, {"kp": 2.0, "f107": 100.0}, {"copy": "flux_e2"}).drop("flux_e2")


# ------------------------------------------------------------------ sources, over payloads and files made from the tables
@query(GN + "\n--\nSELECT t, flux_e2, vsw, density FROM n", "t")
def cdf_round_trip(spark, d):
    """Hourly channels written to CDF files, one for each month, and read back."""
    names = ["flux_e2", "vsw", "density"]
    files = cdf.write_cdf_files(views.grid_n(spark, d).select("time", *names), scratch(spark), names)
    return cdf.wide(cdf.read_cdf(spark, [r["path"] for r in files.select("path").collect()], names), names)  # one path a month


@query(GN + "\n--\nSELECT t, vsw, density, bz_gsm FROM n", "t")
def feed_lists(spark, d):
    """Wind speed, density and field as JSON lists with a header, a payload a day, parsed and joined as feeds are."""
    def payloads(cols: dict) -> DataFrame:
        g = views.grid_n(spark, d).select(F.date_trunc("day", "time").alias("day"), F.array(F.date_format("time", "yyyy-MM-dd HH:mm:ss"), *[F.col(c).cast("string") for c in cols]).alias("r"))
        head = ["time_tag", *cols.values()]
        bodies = g.groupBy("day").agg(F.to_json(F.concat(F.array(F.array(*[F.lit(h) for h in head])), F.collect_list("r"))).alias("body"))
        return feeds.finalise(feeds.lists_of(bodies, head))

    return feeds.solar_wind(payloads({"vsw": "speed", "density": "density"}), payloads({"bz_gsm": "bz"})).select("time", "vsw", "density", "bz_gsm")


@query("SELECT epoch_us(ts) // 1000000 AS t, value AS flux_e2 FROM events WHERE event_type = 'purchase'", "t")
def feed_records(spark, d):
    """Flux records of two energy channels as JSON objects, a payload a day, of which one channel counts."""
    e = views.events(spark, d)
    r = F.struct(F.concat(F.date_format("time", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("Z")).alias("time_tag"), F.when(F.col("event_type") == "purchase", ">=2 MeV").otherwise(">=0.8 MeV").alias("energy"), F.col("value").alias("flux"))
    bodies = e.groupBy(F.date_trunc("day", "time").alias("day")).agg(F.to_json(F.collect_list(r)).alias("body"))
    return feeds.electrons(feeds.finalise(feeds.records_of(bodies, ["time_tag", "energy", "flux"])))


# ------------------------------------------------------------------ windows and splits
@query(f"{G1A}\n--\nSELECT * FROM a", "t y_exceed_nowcast y_exceed_6h y_exceed_12h")
def supervised_targets(spark, d):
    return views.anchor_frame(spark, d)


VALID = f"""{G1}{ISLES}{SHORT},
v AS (SELECT t, lead(flux, 8) OVER (ORDER BY t) AS a, lead(flux, 72) OVER (ORDER BY t) AS b, lead(flux, 144) OVER (ORDER BY t) AS c,
  sum((flux IS NULL)::INT) OVER (ORDER BY t ROWS BETWEEN {L - 1} PRECEDING AND CURRENT ROW) AS bad, count(*) OVER (ORDER BY t ROWS BETWEEN {L - 1} PRECEDING AND CURRENT ROW) AS nb,
  count(*) OVER (ORDER BY t ROWS BETWEEN 1 FOLLOWING AND 144 FOLLOWING) AS na FROM s)"""


@query(f"{VALID}\n--\nSELECT t, a AS y_nowcast, b AS y_6h, c AS y_12h FROM v WHERE nb = {L} AND na = 144 AND bad = 0 AND a IS NOT NULL AND b IS NOT NULL AND c IS NOT NULL", "t")
def window_validity(spark, d):
    g = C.interpolate_short(views.grid1(spark, d), views.FIVE, "flux", 6)
    a = W.anchors(g, views.FIVE, ["flux"], "flux", L, horizons=H, threshold=THR, future=())
    return a.select("time", *[f"y_{h}" for h in H])


SPLIT = """, z AS (SELECT t, row_number() OVER (ORDER BY t) - 1 AS pos, count(*) OVER () AS n FROM a),
sp AS (SELECT t, CASE WHEN pos < floor(n * 0.7) - 144 THEN 'train' WHEN pos >= floor(n * 0.7) + 144 AND pos < floor(n * 0.85) - 144 THEN 'val' WHEN pos >= floor(n * 0.85) + 144 THEN 'test' END AS split FROM z)"""


@query(f"{G1A}{SPLIT}\n--\nSELECT t, split FROM sp", "t split")
def chronological_split(spark, d):
    return W.chronological_split(views.anchor_frame(spark, d).select("time"), views.FIVE, 0.7, 0.15, 144)


@query(f"{G1A},\nz AS (SELECT t, last, row_number() OVER (ORDER BY t) - 1 AS pos FROM a)\n--\nSELECT t, last FROM (SELECT * FROM z WHERE pos % 4 = 0 ORDER BY t DESC LIMIT 100)", "t")
def stride_recent(spark, d):
    return W.every_nth(views.anchor_frame(spark, d).select("time", "last"), views.FIVE, 4, 100)


@query(
    f"""{G1}
--
SELECT t, coalesce(flux, 0) AS flux_last, coalesce(first_value(flux) OVER w, 0) AS flux_first, coalesce(avg(flux) OVER w, 0) AS flux_mean, coalesce(stddev_pop(flux) OVER w, 0) AS flux_std,
 coalesce(min(flux) OVER w, 0) AS flux_min, coalesce(max(flux) OVER w, 0) AS flux_max FROM g
WINDOW w AS (ORDER BY t ROWS BETWEEN {L - 1} PRECEDING AND CURRENT ROW) QUALIFY count(*) OVER w = {L}""",
    "t",
)
def window_stats_flatten(spark, d):
    return W.window_stats(views.grid1(spark, d), views.FIVE, ["flux"], L).drop("flux")


DESIGN_SQL = f"""{GN}
--
SELECT t, coalesce(vsw, 0) AS v_last, coalesce(avg(vsw) OVER w, 0) AS v_mean, coalesce(avg(vsw) OVER r, 0) AS v_recent, coalesce(max(vsw) OVER r, 0) AS v_recent_max, coalesce(vsw - first_value(vsw) OVER w, 0) AS v_change, coalesce(flux_e2, 0) AS flux_last
FROM n WINDOW w AS (ORDER BY t ROWS BETWEEN {L - 1} PRECEDING AND CURRENT ROW), r AS (ORDER BY t ROWS BETWEEN 11 PRECEDING AND CURRENT ROW) QUALIFY count(*) OVER w = {L}"""


@query(DESIGN_SQL, "t")
def refm_design(spark, d):
    x = W.filter_design(views.grid_n(spark, d), views.HOUR, L, 12, flux="flux_e2")
    return x.select("time", "v_last", "v_mean", "v_recent", "v_recent_max", "v_change", "flux_last")


@query(
    f"""{G1A},
st AS (SELECT unnest(range(1, 145)) AS step)
--
SELECT t, step, CASE WHEN step <= 8 THEN last + (y_nowcast - last) * step / 8.0 WHEN step <= 72 THEN y_nowcast + (y_6h - y_nowcast) * (step - 8) / 64.0 ELSE y_6h + (y_12h - y_6h) * (step - 72) / 72.0 END AS value FROM a, st""",
    "t step",
)
def decoder_path(spark, d):
    return W.decoder_path(views.anchor_frame(spark, d), "last", H).select("time", F.col("step").cast("bigint").alias("step"), "value")


@query(
    f"""{G1}
--
SELECT t, 0.5 * coalesce(flux, 0) + 0.3 * coalesce(lag(flux, 1) OVER (ORDER BY t), 0) + 0.2 * coalesce(lag(flux, 2) OVER (ORDER BY t), 0) AS smooth FROM g""",
    "t",
)
def causal_convolution(spark, d):
    return W.causal_convolve(views.grid1(spark, d), views.FIVE, "flux", [0.5, 0.3, 0.2], "smooth").select("time", "smooth")


@query(
    f"""{G1},
x AS (SELECT t, row_number() OVER (ORDER BY t) - 1 AS pos, coalesce(flux, 0) AS flux, count(*) OVER () AS n FROM g),
an AS (SELECT t AS anchor, pos, k FROM x, range(0, {L + DECODER_STEPS}) r(k) WHERE pos >= {L - 1} AND pos + {DECODER_STEPS} < n)
--
SELECT an.anchor, an.k AS time_idx, x.flux::FLOAT::DOUBLE AS value FROM an JOIN x ON x.pos = an.pos - {L - 1} + least(an.k, {L - 1})""",
    "anchor time_idx",
)
def unroll_windows(spark, d):
    """Every anchor with the lookback and decoder of the other window queries."""
    g = views.grid1(spark, d).withColumn("flux", F.coalesce("flux", F.lit(0.0))).withColumn("k", F.lit(1.0))
    a = W.anchors(g, views.FIVE, ["flux"], "flux", L, horizons=H, threshold=THR, future=("k",), arrays=True)
    return W.unroll(a, ["time"]).select(F.unix_seconds("time").alias("anchor"), F.col("time_idx").cast("bigint").alias("time_idx"), F.col("inputs")[0].alias("value"))


# ------------------------------------------------------------------ models
CLIM_BINS = 7


def _with_bins(a: DataFrame) -> DataFrame:
    """Sector of the time of day at each target; seven sectors, so that no edge falls on the grid."""
    for h, k in H.items():
        at = F.timestamp_micros(F.unix_micros("time") + k * 300_000_000)
        s, c = cyclic(hour_of_day(at), 24.0)
        from ..functions import bin_of_angle

        a = a.withColumn(f"bin_{h}", climatology_bin(bin_of_angle(s, c, CLIM_BINS), F.lit(0.0), F.lit(0), F.lit(0), n_kp=1, n_doy=1, n_mlt=1))
    return a


CLIM = G1A + f"""{SPLIT},
ct AS (SELECT lg.t, horizon, y, least(floor(((t + CASE horizon WHEN 'nowcast' THEN 8 WHEN '6h' THEN 72 ELSE 144 END * 300) % 86400) / 86400.0 * {CLIM_BINS}), {CLIM_BINS - 1})::INT AS bin FROM lg),
tr AS (SELECT ct.* FROM ct JOIN sp USING (t) WHERE split = 'train'),
lt AS (SELECT horizon, bin, avg(y) AS mean, quantile_cont(y, 0.1) AS q10, quantile_cont(y, 0.5) AS q50, quantile_cont(y, 0.9) AS q90, avg((y >= {THR})::INT) AS freq, count(*) AS n FROM tr GROUP BY 1, 2
  UNION ALL SELECT horizon, NULL, avg(y), quantile_cont(y, 0.1), quantile_cont(y, 0.5), quantile_cont(y, 0.9), avg((y >= {THR})::INT), count(*) FROM tr GROUP BY 1)"""


def _split_anchors(spark, d):
    """Anchors with bins and splits, made once for all that is fitted on them and all that is predicted."""
    return kept(W.chronological_split(_with_bins(kept(views.anchor_frame(spark, d))), views.FIVE, 0.7, 0.15, 144))


def _climatology(spark, d):
    a = _split_anchors(spark, d)
    return models.Climatology(H, THR).fit(W.select_split(a, "train")), a


@query(f"{CLIM}\n--\nSELECT * REPLACE (coalesce(bin, -1) AS bin) FROM lt", "horizon bin n")
def climatology_fit(spark, d):
    """Bin -1 holds all rows of a horizon."""
    return _climatology(spark, d)[0].table.withColumn("bin", F.coalesce("bin", F.lit(-1)))


@query(
    CLIM + """
--
SELECT t, horizon, coalesce(l.mean, g.mean) AS pred, coalesce(l.q10, g.q10) AS q10, coalesce(l.q90, g.q90) AS q90, coalesce(l.freq, g.freq) AS p
FROM ct JOIN sp USING (t) LEFT JOIN lt l USING (horizon, bin) JOIN lt g ON g.horizon = ct.horizon AND g.bin IS NULL WHERE split = 'test'""",
    "t horizon",
)
def climatology_predict(spark, d):
    m, a = _climatology(spark, d)
    p = m.predict(W.select_split(a, "test"))
    return M.by_horizon(p, ["time"], H, {"pred": "{h}_pred", "q10": "{h}_q10", "q90": "{h}_q90", "p": "{h}_p"})


@query(f"{G1A}\n--\nSELECT t, horizon, last AS pred, last AS q10, last AS q90, (last >= {THR})::INT AS p FROM lg", "t horizon")
def persistence_predict(spark, d):
    p = models.Persistence(H, THR).predict(views.anchor_frame(spark, d))
    return M.by_horizon(p, ["time"], H, {"pred": "{h}_pred", "q10": "{h}_q10", "q90": "{h}_q90", "p": "{h}_p"})


TRAIN_LINES = "(SELECT * FROM (SELECT *, row_number() OVER (ORDER BY l_shipdate, l_orderkey, l_linenumber) - 1 AS pos, count(*) OVER () AS n FROM lineitem) WHERE pos < floor(n * 0.7))"
LINES = ("l_quantity", "l_extendedprice", "l_discount")


def _train_lines(spark, d):
    """First 70 % by ship date: days before that of the cut as a whole, and of its rows those of the lowest ranks."""
    li = views.table(spark, d, "lineitem").select("l_shipdate", "l_orderkey", "l_linenumber", *LINES)
    days = kept(li.groupBy("l_shipdate").agg(F.count("*").alias("k")))
    n = int((days.agg(F.sum("k")).first()[0] or 0) * 0.7)
    upto = F.sum("k").over(Window.orderBy("l_shipdate").rowsBetween(Window.unboundedPreceding, 0))  # a row per day
    cut = days.withColumn("upto", upto).where(F.col("upto") > n).orderBy("l_shipdate").limit(1).collect()
    if not cut:
        return li
    day, left = cut[0]["l_shipdate"], n - (cut[0]["upto"] - cut[0]["k"])
    rank = F.row_number().over(Window.partitionBy("l_shipdate").orderBy("l_orderkey", "l_linenumber"))
    of_day = li.where(F.col("l_shipdate") == F.lit(day)).withColumn("r", rank).where(F.col("r") <= left).drop("r")
    return li.where(F.col("l_shipdate") < F.lit(day)).unionByName(of_day)


def _scaler_rows(spark, state):
    return spark.createDataFrame([(c, float(m), float(s)) for c, m, s in zip(state["columns"], state["center"], state["scale"], strict=True)], "channel string, center double, scale double")


@query(" UNION ALL ".join(f"SELECT '{c}' AS channel, avg({c}) AS center, stddev_pop({c}) AS scale FROM {TRAIN_LINES}" for c in LINES), "channel")
def scaler_standard(spark, d):
    return _scaler_rows(spark, models.fit_scaler(_train_lines(spark, d), LINES))


@query(" UNION ALL ".join(f"SELECT '{c}' AS channel, quantile_cont({c}, 0.5) AS center, quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25) AS scale FROM {TRAIN_LINES}" for c in LINES), "channel")
def scaler_robust(spark, d):
    return _scaler_rows(spark, models.fit_scaler(_train_lines(spark, d), LINES, "robust"))


@query("SELECT channel - 1 AS channel, avg(v) AS mean, CASE WHEN stddev_pop(v) < 1e-8 THEN 1 ELSE stddev_pop(v) END AS std FROM (SELECT generate_subscripts(embedding, 1) AS channel, unnest(embedding)::DOUBLE AS v FROM embeddings) GROUP BY 1", "channel")
def tensor_scaler(spark, d):
    return models.tensor_scaler(views.table(spark, d, "embeddings"), "embedding").withColumn("channel", F.col("channel").cast("bigint"))


# ------------------------------------------------------------------ scores
def _scored(spark, d, model="persistence"):
    a = _split_anchors(spark, d)
    train, test = W.select_split(a, "train"), W.select_split(a, "test")
    m = models.Climatology(H, THR).fit(train) if model == "climatology" else models.Persistence(H, THR)
    cols = {"y": "y_{h}", "pred": "{h}_pred", "ref": "last", "p": "{h}_p", "q10": "{h}_q10", "q50": "{h}_q50", "q90": "{h}_q90"}
    return M.by_horizon(m.predict(test), ["time"], H, cols).withColumn("model", F.lit(model))


TEST = CLIM + f""",
pc AS (SELECT ct.t, ct.horizon, ct.y, lg.last AS ref, coalesce(l.mean, g.mean) AS pred, coalesce(l.q10, g.q10) AS q10, coalesce(l.q50, g.q50) AS q50, coalesce(l.q90, g.q90) AS q90, coalesce(l.freq, g.freq) AS p
  FROM ct JOIN lg USING (t, horizon) JOIN sp USING (t) LEFT JOIN lt l USING (horizon, bin) JOIN lt g ON g.horizon = ct.horizon AND g.bin IS NULL WHERE split = 'test'),
pp AS (SELECT lg.t, lg.horizon, lg.y, lg.last AS ref, lg.last AS pred, lg.last AS q10, lg.last AS q50, lg.last AS q90, (lg.last >= {THR})::INT::DOUBLE AS p FROM lg JOIN sp USING (t) WHERE split = 'test')"""


@query(
    TEST + """
--
SELECT horizon, sqrt(avg((y - pred) ** 2)) AS rmse, avg(abs(y - pred)) AS mae, avg(pred - y) AS bias, 1 - avg((y - pred) ** 2) / nullif(var_pop(y), 0) AS pe,
 covar_pop(y, pred) / nullif(stddev_pop(y) * stddev_pop(pred), 0) AS corr, count(*) AS n FROM pp GROUP BY 1""",
    "horizon n",
)
def regression_metrics(spark, d):
    return _scored(spark, d).groupBy("horizon").agg(*M.regression_report(F.col("y"), F.col("pred"))).drop("uncertainty_factor")


@query(TEST + "\n--\nSELECT horizon, 1 - avg((y - pred) ** 2) / nullif(avg((y - ref) ** 2), 0) AS skill FROM pc GROUP BY 1", "horizon")
def skill_vs_persistence(spark, d):
    return _scored(spark, d, "climatology").groupBy("horizon").agg(M.skill(F.col("y"), F.col("pred"), F.col("ref")).alias("skill"))


EVENTS_SQL = """WITH c AS (SELECT count_if(quality = 1 AND toxic = 1)::DOUBLE AS h, count_if(quality = 1 AND toxic = 0)::DOUBLE AS m, count_if(quality = 0 AND toxic = 1)::DOUBLE AS f, count_if(quality = 0 AND toxic = 0)::DOUBLE AS c FROM labels)
--
SELECT h AS hits, m AS misses, f AS false_alarms, c AS correct_negatives, h / (h + m) AS pod, f / (h + f) AS far, f / (f + c) AS pofd, h / (h + m + f) AS csi, 2 * h / (2 * h + f + m) AS f1,
 (h + c - ((h + m) * (h + f) + (c + m) * (c + f)) / (h + m + f + c)) / (h + m + f + c - ((h + m) * (h + f) + (c + m) * (c + f)) / (h + m + f + c)) AS hss, h / (h + m) - f / (f + c) AS tss FROM c"""


@query(EVENTS_SQL)
def event_metrics(spark, d):
    t = views.table(spark, d, "labels").agg(*M.contingency(F.col("quality"), F.col("toxic")))
    return t.select("*", *M.event_scores(F.col("hits"), F.col("misses"), F.col("false_alarms"), F.col("correct_negatives")))


@query(
    """WITH s AS (SELECT quality AS o, round(n_chars / 500) / 20.0 AS s FROM labels JOIN documents USING (doc_id)),
r AS (SELECT o, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0 AS rk FROM s)
--
SELECT (sum(rk) FILTER (WHERE o = 1) - count_if(o = 1) * (count_if(o = 1) + 1) / 2.0) / (count_if(o = 1)::DOUBLE * count_if(o = 0)) AS roc_auc, count_if(o = 1) AS n_pos, count_if(o = 0) AS n_neg FROM r""",
    "n_pos n_neg",
)
def roc_auc(spark, d):
    s = views.table(spark, d, "labels").join(views.table(spark, d, "documents").select("doc_id", "n_chars"), "doc_id")
    return M.roc_auc(s.select("quality", (F.round(F.col("n_chars") / 500.0) / 20.0).alias("s")), "quality", "s")


@query(TEST + f"\n--\nSELECT horizon, avg((p - (y >= {THR})::INT) ** 2) AS brier, 1 - avg((p - (y >= {THR})::INT) ** 2) / nullif(var_pop((y >= {THR})::INT), 0) AS bss FROM pc GROUP BY 1", "horizon")
def brier_bss(spark, d):
    o = exceeds(F.col("y"), THR).cast("double")
    return _scored(spark, d, "climatology").groupBy("horizon").agg(M.brier(F.col("p"), o).alias("brier"), M.brier_skill(F.col("p"), o).alias("bss"))


@query(
    """WITH s AS (SELECT toxic AS o, least(n_chars / 10000.0, 1.0)::DOUBLE AS p FROM labels JOIN documents USING (doc_id)),
e AS (SELECT least(greatest((SELECT count(*) FROM range(0, 11) x(i) WHERE s.p >= i * 0.1::DOUBLE) - 1, 0), 9) AS bin, o FROM s),
c AS (SELECT bin, avg(o) AS observed, count(*) AS n FROM e GROUP BY 1)
--
SELECT i::INT AS bin, (i + 0.5) / 10 AS centre, c.observed, coalesce(c.n, 0) AS n FROM range(0, 10) x(i) LEFT JOIN c ON c.bin = i""",
    "bin n",
)
def reliability_curve(spark, d):
    s = views.table(spark, d, "labels").join(views.table(spark, d, "documents").select("doc_id", "n_chars"), "doc_id")
    return M.reliability(s.select(F.col("toxic").alias("o"), F.least(F.col("n_chars") / 10000.0, F.lit(1.0)).alias("p")), "p", "o").withColumn("n", F.col("n").cast("bigint"))


@query(
    TEST + """
--
SELECT horizon, avg(greatest(0.1 * (y - q10), -0.9 * (y - q10))) AS pinball_10, avg(greatest(0.5 * (y - q50), -0.5 * (y - q50))) AS pinball_50, avg(greatest(0.9 * (y - q90), -0.1 * (y - q90))) AS pinball_90,
 2 * (avg(greatest(0.1 * (y - q10), -0.9 * (y - q10))) + avg(greatest(0.5 * (y - q50), -0.5 * (y - q50))) + avg(greatest(0.9 * (y - q90), -0.1 * (y - q90)))) / 3 AS crps, avg((y BETWEEN q10 AND q90)::INT) AS picp FROM pc GROUP BY 1""",
    "horizon",
)
def pinball_crps_picp(spark, d):
    y, q = F.col("y"), [F.col(c) for c in ("q10", "q50", "q90")]
    return _scored(spark, d, "climatology").groupBy("horizon").agg(*[M.pinball(y, c, t).alias(f"pinball_{int(t * 100)}") for c, t in zip(q, (0.1, 0.5, 0.9), strict=True)], M.crps(y, q).alias("crps"), M.picp(y, q[0], q[2]).alias("picp"))


EVAL_ROWS = "(SELECT 'climatology' AS model, * FROM pc UNION ALL SELECT 'persistence', * FROM pp)"


def _both(spark, d):
    """Rows of both models from one frame of test anchors."""
    a = _split_anchors(spark, d)
    p = W.select_split(a, "test")
    for m in (models.Persistence(H, THR), models.Climatology(H, THR).fit(W.select_split(a, "train"))):
        p = m.predict(p)
        p = p.withColumnsRenamed({f"{h}_{c}": f"{m.name}_{h}_{c}" for h in H for c in ("pred", "p", "q10", "q50", "q90")})
    cols = {"y": "y_{h}", "ref": "last"} | {c: f"{{m}}_{{h}}_{c}" for c in ("pred", "p", "q10", "q50", "q90")}
    return M.by_horizon(p, ["time"], H, cols, ("persistence", "climatology"))


@query(
    TEST + f"""
--
SELECT model, horizon, sqrt(avg((y - pred) ** 2)) AS rmse, 1 - avg((y - pred) ** 2) / nullif(var_pop(y), 0) AS pe, 1 - avg((y - pred) ** 2) / nullif(avg((y - ref) ** 2), 0) AS skill,
 count_if(y >= {THR} AND pred >= {THR})::DOUBLE AS hits, avg((p - (y >= {THR})::INT) ** 2) AS brier, avg((y BETWEEN q10 AND q90)::INT) AS picp, 0.8 AS picp_nominal FROM {EVAL_ROWS} GROUP BY 1, 2""",
    "model horizon",
)
def compare_models(spark, d):
    t = M.evaluate(_both(spark, d), THR)
    return t.select("model", "horizon", "rmse", "pe", "skill", "hits", "brier", "picp", "picp_nominal")


@query(
    TEST + f"""
, e AS (SELECT model, horizon, 1 - avg((y - pred) ** 2) / nullif(var_pop(y), 0) AS pe FROM {EVAL_ROWS} GROUP BY 1, 2), m AS (SELECT model, avg(pe) AS mean FROM e GROUP BY 1)
--
SELECT arg_max(model, mean) AS model, max(mean) AS mean FROM m""",
    "model",
)
def best_model(spark, d):
    return M.best_model(M.evaluate(_both(spark, d), THR))


@query(f"SELECT event_type, coalesce(avg((value >= {THR})::INT), 0) AS fraction FROM events GROUP BY 1", "event_type")
def exceedance_fraction(spark, d):
    return views.events(spark, d).groupBy("event_type").agg(M.exceedance_fraction(F.col("value"), THR).alias("fraction"))


@query("SELECT event_id, CASE WHEN value / 200 >= 0.5 THEN 'ALERT' WHEN value / 200 >= 0.2 THEN 'WATCH' ELSE 'NOMINAL' END AS level FROM events", "event_id level")
def alert_levels(spark, d):
    return views.events(spark, d).select("event_id", alert_level(F.col("value") / 200).alias("level"))


@query("SELECT event_id, round_even(value * 3, 0) / 3 AS kp FROM events", "event_id")
def quantise_thirds(spark, d):
    return views.events(spark, d).select("event_id", quantised_kp(F.col("value")).alias("kp"))


@query(f"{G1}\n--\nSELECT max(t) AS t, arg_max(flux, t) AS flux FROM g", "t")
def latest_row(spark, d):
    from ..operators.grid import keep_last

    g = views.grid1(spark, d).withColumn("one", F.lit(1))
    return keep_last(g, ["one"], ["time"]).select("time", "flux")


@query(
    f"""{G1F},
e AS (SELECT t, flux >= {THR} AS hot FROM f WHERE flux IS NOT NULL), k2 AS (SELECT t, t // 300 - row_number() OVER (ORDER BY t) AS isle FROM e WHERE hot)
--
SELECT min(t) AS start, max(t) AS stop, count(*) AS steps FROM k2 GROUP BY isle HAVING count(*) >= 3""",
    "start stop steps",
)
def sustained_periods(spark, d):
    from ..operators.extras import sustained

    r = sustained(views.filled(spark, d), views.FIVE, "flux", THR, 3)
    return r.select(F.unix_seconds("start").alias("start"), F.unix_seconds("stop").alias("stop"), "steps")


@query(f"{G1F}\n--\nSELECT t // 86400 * 86400 AS day, sum(flux) * 300 AS fluence, count(flux) AS n FROM f GROUP BY 1", "day n")
def daily_fluence(spark, d):
    from ..operators.extras import daily_fluence as fluence

    return fluence(views.filled(spark, d), views.FIVE, "flux").select(F.unix_seconds("day").alias("day"), "fluence", "n")


# ------------------------------------------------------------------ rows only: iterative, fitted or stateful
@query(
    """SELECT event_type AS sat_id, epoch_us(ts) // 1000000 AS t, value AS x, count(*) OVER w AS n, avg(value) OVER w AS mean, stddev_samp(value) OVER w AS std, max(value) OVER w AS high, min(value) OVER w AS low,
 lag(value) OVER (PARTITION BY event_type ORDER BY ts, value) AS lag1 FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, value ROWS BETWEEN 71 PRECEDING AND CURRENT ROW)""",
    "sat_id t n",
)
def online_features(spark, d):
    from ..streaming.online import batch_replay

    e = views.events(spark, d).select(F.col("event_type").alias("sat_id"), "time", F.col("value").alias("x"))
    return batch_replay(e, window=72)


@query(
    f"""WITH z AS (SELECT event_id, ({THR} - value) / 25.0 AS z FROM events),
r AS (SELECT i / 400.0 AS u, CASE WHEN i IN (0, 400) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END / 1200.0 AS w FROM range(0, 401) x(i))
--
SELECT event_id, 0.5 - sum(w * least(greatest(z, -9), 9) * exp(-power(u * least(greatest(z, -9), 9), 2) / 2)) / sqrt(2 * pi()) AS p FROM z, r GROUP BY event_id""",
    "event_id",
)
def normal_survival(spark, d):
    """The SQL integrates the density by Simpson's rule."""
    from ..functions import survival

    return views.events(spark, d).select("event_id", survival(THR, F.col("value"), F.lit(25.0)).alias("p"))


@query()
def synthetic_series(spark, d):
    """A series over the days that the events cover."""
    from ..sources.synthetic import solar_wind

    ends = views.events(spark, d).agg(F.min("time").cast("date").alias("a"), F.max("time").cast("date").alias("b")).first()
    days = (ends["b"] - ends["a"]).days + 1 if ends["a"] else 0
    return solar_wind(spark, days=days, seed=7, start=str(ends["a"]))


from . import model_queries, stream_queries  # noqa: E402, F401  they register themselves with what is above
