"""Views of the driver's tables that stand for sensor channels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import grid as G
from ..schema import Grid

FIVE = Grid(step=300)
HOUR = Grid(step=3600)
THRESHOLD = 70.0
STEPS = {"nowcast": 8, "6h": 72, "12h": 144}
LOOKBACK = 72


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("time", F.col("ts").cast("timestamp"))


def grid1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """time, flux: five-minute means over all events."""
    return G.resample(events(spark, sf_dir).select("time", F.col("value").alias("flux")), FIVE, ["flux"])


KEYED = Grid(keys=("event_type",), step=300)


def grid_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_type, time, flux: five-minute means of each type, a series each; most bins are empty."""
    return G.resample(events(spark, sf_dir).select("event_type", "time", F.col("value").alias("flux")), KEYED, ["flux"])


CHANNELS = ("flux_e2", "flux_seed", "vsw", "density", "bz_gsm")


def raw_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind, v = F.col("event_type"), F.col("value")
    return events(spark, sf_dir).select(
        "time", F.when(kind == "purchase", v).alias("flux_e2"), F.when(kind == "signup", v).alias("flux_seed"), F.when(kind == "click", v + 300).alias("vsw"),
        F.when(kind == "view", v / 10).alias("density"), F.when(kind == "error", 50 - v).alias("bz_gsm"),
    )


def grid_n(spark: SparkSession, sf_dir: str, grid: Grid = HOUR) -> DataFrame:
    """Hourly means of the five channels, and the field strength."""
    return G.resample(raw_channels(spark, sf_dir), grid, CHANNELS).withColumn("bt", F.abs("bz_gsm") + 1)


def spiky(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = grid1(spark, sf_dir)
    return g.withColumn("flux", F.when(F.pmod(F.unix_seconds("time") / 300, F.lit(97)) == 0, F.col("flux") * 8).otherwise(F.col("flux")))


def filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """grid1 with short gaps interpolated and the rest carried forward."""
    from ..operators.clean import forward_fill, interpolate_short

    return forward_fill(interpolate_short(grid1(spark, sf_dir), FIVE, "flux", 6).drop("flux_imputed"), FIVE, "flux")


def anchor_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchors of the filled grid with the last value."""
    from ..operators.windows import anchors

    g = filled(spark, sf_dir).withColumn("last", F.col("flux"))
    return anchors(g, FIVE, ["flux"], "flux", LOOKBACK, horizons=STEPS, threshold=THRESHOLD, future=(), keep=("last",))
