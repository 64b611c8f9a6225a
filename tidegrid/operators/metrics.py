"""Forecast scores as aggregate expressions, so that any grouping scores all groups in one pass.

Every score leaves out rows in which one of its own inputs is missing, NaN or infinite. What is undefined is NULL.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import finite
from ..schema import QUANTILES
from .quantiles import value_range


def _on(*cols: Column):
    """Columns that are NULL unless all are finite."""
    ok = cols[0].isNotNull()
    for c in cols:
        ok = ok & finite(c)
    return [F.when(ok, c) for c in cols]


def ratio(a: Column, b: Column) -> Column:
    return F.try_divide(a.cast("double"), F.nullif(b.cast("double"), F.lit(0.0)))


def rmse(y: Column, p: Column) -> Column:
    y, p = _on(y, p)
    return F.sqrt(F.avg((y - p) * (y - p)))


def mae(y: Column, p: Column) -> Column:
    y, p = _on(y, p)
    return F.avg(F.abs(y - p))


def bias(y: Column, p: Column) -> Column:
    y, p = _on(y, p)
    return F.avg(p - y)


def prediction_efficiency(y: Column, p: Column) -> Column:
    y, p = _on(y, p)
    return 1 - ratio(F.avg((y - p) * (y - p)), F.var_pop(y))


def skill(y: Column, p: Column, ref: Column) -> Column:
    y, p, ref = _on(y, p, ref)
    return 1 - ratio(F.avg((y - p) * (y - p)), F.avg((y - ref) * (y - ref)))


def pearson(y: Column, p: Column) -> Column:
    y, p = _on(y, p)
    return ratio(F.covar_pop(y, p), F.stddev_pop(y) * F.stddev_pop(p))


def uncertainty_factor(y: Column, p: Column) -> Column:
    return F.pow(F.lit(10.0), rmse(y, p))


def regression_report(y: Column, p: Column) -> list[Column]:
    a, b = _on(y, p)
    return [
        rmse(y, p).alias("rmse"), mae(y, p).alias("mae"), bias(y, p).alias("bias"), prediction_efficiency(y, p).alias("pe"), pearson(y, p).alias("corr"),
        uncertainty_factor(y, p).alias("uncertainty_factor"), F.count(a + b).alias("n"),
    ]


def contingency(y: Column, p: Column) -> list[Column]:
    """Hits, misses, false alarms and correct negatives of two 0/1 columns."""
    cell = lambda a, b: F.count_if((y == a) & (p == b)).cast("double")
    return [cell(1, 1).alias("hits"), cell(1, 0).alias("misses"), cell(0, 1).alias("false_alarms"), cell(0, 0).alias("correct_negatives")]


def event_scores(h: Column, m: Column, f: Column, c: Column) -> list[Column]:
    """Scores from the four counts."""
    n = h + m + f + c
    pod, pofd = ratio(h, h + m), ratio(f, f + c)
    expected = ratio((h + m) * (h + f) + (c + m) * (c + f), n)
    return [
        pod.alias("pod"), ratio(f, h + f).alias("far"), pofd.alias("pofd"), ratio(h, h + m + f).alias("csi"), ratio(2 * h, 2 * h + f + m).alias("f1"),
        ratio(h + c - expected, n - expected).alias("hss"), (pod - pofd).alias("tss"),
    ]


def brier(p: Column, o: Column) -> Column:
    p, o = _on(p, o)
    return F.avg((p - o) * (p - o))


def brier_skill(p: Column, o: Column) -> Column:
    """Against always saying the base rate."""
    a, b = _on(p, o)
    return 1 - ratio(F.avg((a - b) * (a - b)), F.var_pop(b))


def pinball(y: Column, q: Column, tau: float) -> Column:
    y, q = _on(y, q)
    d = y - q
    return F.avg(F.greatest(F.lit(tau) * d, F.lit(tau - 1) * d))


def crps(y: Column, quantiles: Sequence[Column], taus: Sequence[float] = QUANTILES) -> Column:
    """Twice the mean pinball loss over the quantiles that have one."""
    each = F.array_compact(F.array(*[pinball(y, q, t) for q, t in zip(quantiles, taus, strict=True)]))
    return 2 * ratio(F.aggregate(each, F.lit(0.0), lambda a, b: a + b), F.size(each))


def picp(y: Column, lo: Column, hi: Column) -> Column:
    y, lo, hi = _on(y, lo, hi)
    return F.avg(((y >= lo) & (y <= hi)).cast("double"))


def exceedance_fraction(x: Column, threshold: float) -> Column:
    return F.coalesce(F.avg((x >= threshold).cast("double")), F.lit(0.0))


def roc_auc(df: DataFrame, truth: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    """Mann-Whitney area per group, ties at half; NULL where a class is absent.

    Rows are first counted per distinct score, so that ties, however many, are one row; the running count goes over
    distinct scores in ranges (each range sums up first), not over all rows in one task.
    """
    d = df.where(finite(F.col(score)) & F.col(truth).isNotNull())
    per = d.groupBy(*by, F.col(score).cast("double").alias("__s")).agg(F.count_if(F.col(truth) == 1).alias("__p"), F.count_if(F.col(truth) != 1).alias("__n"))
    per = per.withColumn("__c", value_range(F.col("__s")))
    heads = per.groupBy(*by, "__c").agg(F.sum("__n").alias("__cn"))
    over = Window.partitionBy(*(by or [F.lit(0)])).orderBy("__c").rowsBetween(Window.unboundedPreceding, -1)
    heads = heads.select(*by, "__c", F.coalesce(F.sum("__cn").over(over), F.lit(0)).alias("__below"))
    inner = Window.partitionBy(*by, "__c").orderBy("__s").rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("__in", F.coalesce(F.sum("__n").over(inner), F.lit(0))).join(heads, [*by, "__c"])
    won = F.sum(F.col("__p") * (F.col("__below") + F.col("__in") + F.col("__n") / 2.0))
    return per.groupBy(*by).agg(ratio(won, F.sum("__p").cast("double") * F.sum("__n")).alias("roc_auc"), F.sum("__p").alias("n_pos"), F.sum("__n").alias("n_neg"))


def reliability(df: DataFrame, prob: str, truth: str, n_bins: int = 10) -> DataFrame:
    """Every bin with its centre, observed frequency (NULL if empty) and count; edges are multiples of the rounded 1/n_bins, so 0.3 lies in the third of ten bins."""
    edges = [*[i * (1 / n_bins) for i in range(n_bins)], 1.0]
    p = F.col(prob)
    found = sum(((p >= F.lit(e)).cast("int") for e in edges), F.lit(0)) - 1
    bins = df.where(finite(p) & F.col(truth).isNotNull()).groupBy(F.least(F.greatest(found, F.lit(0)), F.lit(n_bins - 1)).alias("bin")).agg(F.avg(F.col(truth).cast("double")).alias("observed"), F.count("*").alias("n"))
    all_bins = df.sparkSession.range(n_bins).select(F.col("id").cast("int").alias("bin"), ((F.col("id") + 0.5) / n_bins).alias("centre"))
    return all_bins.join(bins, "bin", "left").select("bin", "centre", "observed", F.coalesce("n", F.lit(0)).alias("n"))


def by_horizon(df: DataFrame, key: Sequence[str], horizons: Mapping[str, int], columns: Mapping[str, str], models: Sequence[str] = ()) -> DataFrame:
    """One row per horizon: columns maps a name to a pattern with {h}, as y -> y_{h}; with models one per model, {m} in patterns, too."""
    rows = [
        F.struct(*([F.lit(m).alias("model")] if models else []), F.lit(h).alias("horizon"), *[F.col(pat.format(h=h, m=m)).cast("double").alias(n) for n, pat in columns.items()])
        for m in (models or [""]) for h in horizons
    ]
    return df.select(*key, F.explode(F.array(*rows)).alias("r")).select(*key, "r.*")


def _scores(threshold: float, taus: Sequence[float]) -> list[Column]:
    y, pred, ref, p = F.col("y"), F.col("pred"), F.col("ref"), F.col("p")
    o, e = (y >= threshold).cast("int"), (pred >= threshold).cast("int")
    qs = [F.col(c) for c in ("q10", "q50", "q90")]
    return [
        *regression_report(y, pred), skill(y, pred, ref).alias("skill"), *contingency(o, e), brier(p, o.cast("double")).alias("brier"), brier_skill(p, o.cast("double")).alias("bss"),
        crps(y, qs, taus).alias("crps"), picp(y, qs[0], qs[-1]).alias("picp"),
    ]


def _with_events(table: DataFrame, taus: Sequence[float]) -> DataFrame:
    return table.select("*", *event_scores(F.col("hits"), F.col("misses"), F.col("false_alarms"), F.col("correct_negatives")), F.lit(taus[-1] - taus[0]).alias("picp_nominal"))


def evaluate(long: DataFrame, threshold: float, by: Sequence[str] = ("model", "horizon"), taus: Sequence[float] = QUANTILES) -> DataFrame:
    """All scores of rows (y, pred, ref, p, q10, q50, q90), per group, in one aggregation plus the ranked area."""
    table = _with_events(long.groupBy(*by).agg(*_scores(threshold, taus)), taus)
    area = roc_auc(long.withColumn("__o", (F.col("y") >= threshold).cast("int")), "__o", "p", by).select(*by, "roc_auc")
    return table.join(area, list(by), "left")


def with_persistence(long: DataFrame, of: str, threshold: float, name: str = "persistence") -> DataFrame:
    """Rows of evaluate(), and for each row of the model `of` one of the forecast that the last value stays."""
    cols = ("model", "pred", "p", "q10", "q50", "q90")
    ref = F.col("ref")
    own = F.struct(*[F.col(c) for c in cols])
    same = F.struct(F.lit(name).alias("model"), ref.alias("pred"), (ref >= threshold).cast("double").alias("p"), *[ref.alias(q) for q in cols[3:]])
    rest = [c for c in long.columns if c not in cols]
    return long.select(*rest, F.explode(F.array_compact(F.array(own, F.when(F.col("model") == of, same)))).alias("r")).select(*rest, "r.*")


#: Stands for all models or all horizons in a report.
ALL = "all"


def report(long: DataFrame, threshold: float, taus: Sequence[float] = QUANTILES) -> DataFrame:
    """All scores per model and horizon, per model, per horizon and over all rows, from one pass over the rows by GROUPING SETS."""
    by = ("model", "horizon")
    table = long.groupingSets([[F.col(c) for c in s] for s in (by, by[:1], by[1:], ())], *by).agg(*[F.grouping(c).alias(f"__{c}") for c in by], *_scores(threshold, taus))
    table = table.withColumns({c: F.when(F.col(f"__{c}") == 1, F.lit(ALL)).otherwise(F.col(c)) for c in by}).drop(*[f"__{c}" for c in by])
    sets = F.explode(F.array(*[F.struct(m.alias("model"), h.alias("horizon")) for m in (F.col("model"), F.lit(ALL)) for h in (F.col("horizon"), F.lit(ALL))]))
    area = roc_auc(long.select(sets.alias("s"), "p", (F.col("y") >= threshold).cast("int").alias("__o")).select("s.*", "p", "__o"), "__o", "p", by).select(*by, "roc_auc")
    return _with_events(table, taus).join(area, list(by), "left")


def tidy(table: DataFrame, by: Sequence[str] = ("model", "horizon")) -> DataFrame:
    """Scores as rows (metric, value)."""
    cols = [c for c in table.columns if c not in by]
    return table.select(*by, F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in cols])).alias("m")).select(*by, "m.*")


def best_model(table: DataFrame, metric: str = "pe") -> DataFrame:
    """The model whose mean score over horizons is highest."""
    means = table.where(finite(F.col(metric))).groupBy("model").agg(F.avg(metric).alias("mean"))
    return means.agg(F.max_by("model", "mean").alias("model"), F.max("mean").alias("mean"))


def markdown(table: DataFrame, horizons: Sequence[str], metrics: Sequence[str]) -> str:
    """Report text, grouped by horizon; the table has a row per model and horizon only."""
    rows = {(r["horizon"], r["model"]): r for r in table.select("model", "horizon", *metrics).collect()}
    head = "| horizon | model | " + " | ".join(metrics) + " |\n|" + "---|" * (len(metrics) + 2)
    body = [f"| {h} | {m} | " + " | ".join("-" if r[c] is None else f"{r[c]:.4g}" for c in metrics) + " |" for h in horizons for (g, m), r in sorted(rows.items()) if g == h]
    return "\n".join([head, *body]) + "\n"
