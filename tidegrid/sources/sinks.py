"""Writers: tables, reports, manifests, scaler states, plot data."""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .folders import Check, update_version


def write_grid(df: DataFrame, path: str, time: str = "time") -> None:
    """Parquet by year and month, so that time ranges prune files."""
    df.withColumns({"year": F.year(time), "month": F.month(time)}).write.mode("overwrite").partitionBy("year", "month").parquet(path)


def read_grid(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path).drop("year", "month")
    return df.select(*columns) if columns else df


def upsert(old: DataFrame, new: DataFrame, key: Sequence[str]) -> DataFrame:
    """Rows of new, and rows of old whose key new does not have."""
    return new.unionByName(old.join(new.select(*key), list(key), "left_anti"))


def manifest_row(df: DataFrame, file: str, digest: str, time: str = "time") -> DataFrame:
    """file, sha256, n_records, start, end and the share of cells that are missing."""
    cells = [c for c in df.columns if c != time]
    missing = sum((F.col(c).isNull().cast("double") for c in cells), F.lit(0.0)) / max(1, len(cells))
    return df.agg(F.lit(file).alias("file"), F.lit(digest).alias("sha256"), F.count("*").alias("n_records"), F.min(time).alias("start"), F.max(time).alias("end"), F.avg(missing).alias("fill_fraction"))


def write_report(tidy: DataFrame, path: str) -> None:
    """Scores as JSON lines and as CSV with a header."""
    tidy.write.mode("overwrite").json(f"{path}/json")
    tidy.write.mode("overwrite").option("header", True).csv(f"{path}/csv")


def save_state(spark: SparkSession, state: Mapping, path: str) -> None:
    """A scaler or model state of driver size, as one JSON row."""
    spark.createDataFrame([(json.dumps(state),)], "state string").write.mode("overwrite").parquet(path)


def load_state(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.parquet(path).first()["state"])


def plot_forecast(df: DataFrame, horizon: str, points: int = 500) -> DataFrame:
    """The latest points of a fan chart, in linear units."""
    cols = ["time", *[F.pow(F.lit(10.0), F.col(c)).alias(c) for c in (f"{horizon}_q10", f"{horizon}_q50", f"{horizon}_q90")]]
    return df.orderBy(F.col("time").desc()).limit(points).select(*cols)


def plot_skill(table: DataFrame, metric: str = "skill") -> DataFrame:
    return table.groupBy("model").pivot("horizon").agg(F.first(metric))


def plot_reliability(long: DataFrame, n_bins: int = 10) -> DataFrame:
    """Points of a reliability diagram, a line per horizon: rows (horizon, bin, centre, observed, n) of the bins that have any, from rows (horizon, p, o)."""
    b = F.least(F.floor(F.col("p") * n_bins), F.lit(n_bins - 1)).cast("int")
    return long.where("p IS NOT NULL AND o IS NOT NULL").groupBy("horizon", b.alias("bin")).agg(F.avg(F.col("o").cast("double")).alias("observed"), F.count("*").alias("n")).withColumn("centre", (F.col("bin") + 0.5) / n_bins)


def upsert_rows(spark: SparkSession, path: str, new: DataFrame, key: Sequence[str], marks: Mapping[str, int] | None = None) -> bool:
    """Rows of new, by key, into the versioned table at path; several writers at once lose no rows of one another."""
    return update_version(spark, path, lambda old: new if old is None else upsert(old, new, key), marks=marks)


class Rejected(ValueError):
    """Rows that break rules; `found` has how many rows break each."""

    def __init__(self, found: Mapping[str, int]):
        super().__init__("; ".join(f"{name} ({n} rows)" for name, n in found.items()))
        self.found = dict(found)


def gate(rules: Mapping[str, Column], note: Callable[[dict[str, int]], None] | None = None) -> Check:
    """A check of a write: rows that meet a rule's condition are counted as they are written, with no job of their own.

    Afterwards `note` gets what was found, by name; without it a rule that any row breaks raises Rejected, so that what
    was written is never committed.
    """

    def check(rows: DataFrame) -> tuple[DataFrame, Callable[[], None]]:
        seen = Observation()
        counts = [F.count_if(F.coalesce(c, F.lit(False))).alias(f"c{i}") for i, c in enumerate(rules.values())]
        rows = rows.observe(seen, F.count(F.lit(1)).alias("n"), *counts)

        def verdict() -> None:
            got = seen.get
            found = {name: got[f"c{i}"] for i, name in enumerate(rules) if got[f"c{i}"]}
            if note:
                note(found)
            elif found:
                raise Rejected(found)

        return rows, verdict

    return check


def write_checked(df: DataFrame, path: str, rules: Mapping[str, Column], drop: Sequence[str] = ()) -> None:
    """df without the columns that only rules need, as the next version at path; none of it is visible if a rule is broken."""
    check = gate(rules)

    def both(rows: DataFrame) -> tuple[DataFrame, Callable[[], None]]:
        seen, verdict = check(rows)
        return seen.drop(*drop), verdict

    update_version(df.sparkSession, path, lambda old: df, check=both)
