"""Run a streaming plan over data that arrives in parts, a micro-batch for each."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.folders import scratch


@contextmanager
def settings(spark: SparkSession, values: Mapping[str, str]) -> Iterator[None]:
    """Settings of the session for what starts inside, as they were afterwards."""
    before = {k: spark.conf.get(k, None) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def fed(spark: SparkSession, arrivals: Iterable[Mapping[str, DataFrame]], plan: Callable[..., DataFrame], conf: Mapping[str, str] | None = None) -> DataFrame:
    """What plan(**streams) has put out when all arrivals have been taken in.

    Each arrival brings new rows of some of the streams, by name; the first one must bring rows of all. The query keeps its
    state in the shared folder and goes on from there if it is started again; its rows are written there as well. State
    has a partition a core at most, as each one costs every micro-batch a little.
    """
    base = scratch(spark)
    cores = min(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    conf = {"spark.sql.shuffle.partitions": str(max(1, cores)), **(conf or {})}
    running = None
    try:
        for arrival in arrivals:
            for name, rows in arrival.items():
                rows.write.mode("append").parquet(f"{base}/in/{name}")
            if running is None:
                streams = {name: spark.readStream.schema(rows.schema).parquet(f"{base}/in/{name}") for name, rows in arrival.items()}
                out = plan(**streams)
                with settings(spark, conf):
                    running = out.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").outputMode("append").start()
            running.processAllAvailable()
    finally:
        if running is not None:
            running.stop()
    return spark.read.schema(out.schema).parquet(f"{base}/out")


def outer_merged(feeds: Mapping[str, DataFrame], keys: Sequence[str] = (), late: str = "1 hour") -> DataFrame:
    """Streams with columns of their own joined on time and keys by full outer joins.

    A row without partners comes out once, when the watermark (the slowest feed's newest time less `late`) has passed its
    time; what is older leaves the state. A sample that is sent again within that time counts once.
    """
    on, out = [*keys, "time"], None
    for feed in feeds.values():
        feed = feed.withWatermark("time", late).dropDuplicatesWithinWatermark(on)
        if out is None:
            out = feed
            continue
        a, b = out.alias("a"), feed.alias("b")
        match = reduce(lambda x, y: x & y, [F.col(f"a.{c}") == F.col(f"b.{c}") for c in on])
        values = [F.col(f"{s}.{c}") for s, side in (("a", out), ("b", feed)) for c in side.columns if c not in on]
        out = a.join(b, match, "full_outer").select(*[F.coalesce(f"a.{c}", f"b.{c}").alias(c) for c in on], *values)
    return out
