"""Exact quantiles without a task that holds all values of a group.

Rows are counted per distinct value, combined before the shuffle; counts are summed over ranges of values, which tells in
which ranges the wanted ranks lie, and only the values of these are put in order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def value_range(v: Column) -> Column:
    """A whole number that never falls as v grows, 256 to each doubling of 1 + |v|."""
    return F.floor(F.signum(v) * F.log2(F.abs(v) + 1) * 256).cast("bigint")


def exact_quantiles(df: DataFrame, by: Sequence[str], value: str, probabilities: Sequence[float], name: str = "q") -> DataFrame:
    """by and `name`, the quantiles of the non-null values, between neighbours in proportion; groups without values are left out.

    Columns of `by` must not be null.
    """
    per = df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).cast("double").alias("__v")).agg(F.count("*").alias("__n")).withColumn("__c", value_range(F.col("__v")))
    group = Window.partitionBy(*(by or [F.lit(0)]))
    heads = per.groupBy(*by, "__c").agg(F.sum("__n").alias("__cn"))
    heads = heads.select(*by, "__c", "__cn", (F.sum("__cn").over(group.orderBy("__c").rowsBetween(Window.unboundedPreceding, 0)) - F.col("__cn")).alias("__below"), F.sum("__cn").over(group).alias("__total"))
    at = [(F.col("__total") - 1) * F.lit(float(p)) for p in probabilities]
    ranks = [r for a in at for r in (F.floor(a), F.ceil(a))]
    wanted = F.lit(False)
    for r in ranks:
        wanted = wanted | ((r >= F.col("__below")) & (r < F.col("__below") + F.col("__cn")))
    inner = Window.partitionBy(*by, "__c").orderBy("__v").rowsBetween(Window.unboundedPreceding, 0)
    near = per.join(heads.where(wanted), [*by, "__c"]).withColumn("__to", F.col("__below") + F.sum("__n").over(inner))
    ends = near.groupBy(*by).agg(*[F.min(F.when(F.col("__to") > r, F.col("__v"))).alias(f"__{i}") for i, r in enumerate(ranks)], F.first("__total").alias("__total"))
    between = [F.col(f"__{2 * i}") + (F.col(f"__{2 * i + 1}") - F.col(f"__{2 * i}")) * (a - F.floor(a)) for i, a in enumerate(at)]
    return ends.where("__total IS NOT NULL").select(*by, F.array(*between).alias(name))
