"""The smallest whole plan: raw events to a clean log series with a trailing mean."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import log10_floor
from ..operators import clean as C
from ..operators import windows as W
from . import views


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = C.interpolate_short(views.grid1(spark, sf_dir), views.FIVE, "flux", 6)
    g = C.gap_lengths(g, views.FIVE, "flux").withColumn("log_flux", log10_floor(F.col("flux")))
    return W.add_rolling(g, views.FIVE, "log_flux", [72], ["mean"])
