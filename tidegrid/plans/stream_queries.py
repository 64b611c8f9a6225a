"""Queries that run as streams: events arrive in parts, some late and some twice, and the result is that of all of them.

Arrivals are written to the shared folder one after another, each a micro-batch. A last arrival of marks, far ahead in
time and of no series, moves the watermark past everything else.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..streaming import feed, online
from ..streaming.history import History
from ..sources.folders import scratch
from . import views
from .queries import query

PARTS, DAY = 6, 86_400
#: How far behind the newest a sample may come, in seconds.
LATE = DAY


def arrivals(df: DataFrame, key: str, parts: int = PARTS) -> Iterator[DataFrame]:
    """df, cut by time and written once, a folder for each part. Of the last half day of each part some rows (by key) come a part later, and some with both."""
    t = F.unix_seconds("time")
    ends = df.agg(F.min(t), F.max(t)).first()
    if ends[0] is None:
        return
    span = -(-(ends[1] - ends[0] + 1) // parts)
    part = F.floor((t - ends[0]) / span).cast("int")
    edge = (t - ends[0]) % span >= span - min(DAY // 2, span // 2)
    mix = F.pmod(F.xxhash64(key, "time"), F.lit(12))
    late, again = edge & (mix < 3), edge & (mix >= 10)
    came = df.withColumn("__came", F.explode(F.when(late, F.array(part + 1)).when(again, F.array(part, part + 1)).otherwise(F.array(part))))
    path = scratch(df.sparkSession)
    came.write.partitionBy("__came").parquet(path)
    came = df.sparkSession.read.schema(came.schema).parquet(path)
    for k in range(parts + 1):
        yield came.where(F.col("__came") == k).drop("__came")


def mark(like: DataFrame, series: str, name) -> DataFrame:
    """One row far ahead: the newest time and four days, all values missing."""
    kinds = dict(like.dtypes)
    ahead = like.agg(F.timestamp_seconds(F.unix_seconds(F.max("time")) + 4 * DAY).alias("time"))
    return ahead.select(*[F.col("time") if c == "time" else F.lit(name if c == series else None).cast(kinds[c]).alias(c) for c in like.columns])


ONCE = "s AS (SELECT event_type AS sat_id, ts, max(value) AS x FROM events GROUP BY 1, 2)"


@query(
    f"""WITH {ONCE}
--
SELECT sat_id, epoch_us(ts) // 1000000 AS t, x, count(*) OVER w AS n, avg(x) OVER w AS mean, stddev_samp(x) OVER w AS std, max(x) OVER w AS high, min(x) OVER w AS low, lag(x) OVER (PARTITION BY sat_id ORDER BY ts) AS lag1
FROM s WINDOW w AS (PARTITION BY sat_id ORDER BY ts ROWS BETWEEN 71 PRECEDING AND CURRENT ROW)""",
    "sat_id t n",
)
def stream_features(spark: SparkSession, d: str) -> DataFrame:
    """Seven micro-batches; windows stand in order of event time, whatever order samples came in."""
    e = views.events(spark, d).select(F.col("event_type").alias("sat_id"), "time", F.col("value").alias("x"))
    parts = [*({"samples": p} for p in arrivals(e, "sat_id")), {"samples": mark(e, "sat_id", "~")}]
    return feed.fed(spark, parts, lambda samples: online.stream_features(samples, 72, f"{LATE} seconds", DAY), online.ROCKSDB)


FEEDS = {"flux_e2": "purchase", "vsw": "click", "kp": "error"}


@query(
    f"""SELECT user_id, (epoch_us(ts) // 3600000000) * 3600 AS t, {", ".join(f"avg(value) FILTER (WHERE event_type = '{k}') AS {c}" for c, k in FEEDS.items())}
FROM events WHERE event_type IN ('purchase', 'click', 'error') GROUP BY 1, 2""",
    "user_id t",
)
def stream_merged_feeds(spark: SparkSession, d: str) -> DataFrame:
    """Three feeds of hourly means per user, joined as they arrive; most rows have no partner in the others."""
    e = views.events(spark, d)
    means = {
        c: e.where(F.col("event_type") == k).groupBy("user_id", F.timestamp_seconds(F.floor(F.unix_seconds("time") / 3600) * 3600).alias("time")).agg(F.avg("value").alias(c)) for c, k in FEEDS.items()
    }
    cut = {c: [*arrivals(m, "user_id"), mark(m, "user_id", -1 - i)] for i, (c, m) in enumerate(means.items())}
    parts = [dict(zip(cut, p, strict=True)) for p in zip(*cut.values(), strict=True)]
    out = feed.fed(spark, parts, lambda **feeds: feed.outer_merged(feeds, ("user_id",), f"{LATE} seconds"))
    return out.where("user_id >= 0").select("user_id", "time", *FEEDS)


@query(
    """WITH h AS (SELECT event_type AS sat_id, (epoch_us(ts) // 3600000000) * 3600 AS t, avg(value) AS x FROM events GROUP BY 1, 2),
r AS (SELECT *, max(t) OVER (PARTITION BY sat_id) AS newest, row_number() OVER (PARTITION BY sat_id ORDER BY t DESC) AS k FROM h)
--
SELECT sat_id, t, x FROM r WHERE k <= 288 AND t > newest - 288 * 3600""",
    "sat_id t",
)
def stream_history(spark: SparkSession, d: str) -> DataFrame:
    """The last 288 hours of each series, from a log of batches that are compacted on the way; every second batch comes twice."""
    e = views.events(spark, d)
    hours = e.groupBy(F.col("event_type").alias("sat_id"), F.timestamp_seconds(F.floor(F.unix_seconds("time") / 3600) * 3600).alias("time")).agg(F.avg("value").alias("x"))
    h = History(spark, scratch(spark), depth=288, step=3600)
    take = h.append("hours")
    for epoch, part in enumerate(arrivals(hours, "sat_id")):
        take(part, epoch)
        if epoch % 2:
            h.compact()
            take(part, epoch)
    out = h.read()
    return hours.limit(0) if out is None else out.select("sat_id", "time", "x")
