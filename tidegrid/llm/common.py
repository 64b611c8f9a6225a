"""What the corpus operators share: the scratch folder, tables written there, word and hash helpers."""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.folders import children, passing, remove, run_id, scratch, scratch_table

__all__ = ["byte_batches", "children", "distinct", "documents", "double_hashes", "mixed", "passing", "pick", "plain_names", "ranked", "remove", "run_hashes", "run_id", "sampled", "scratch", "scratch_table", "stored", "sweep", "word_hashes"]

#: Bytes of one Arrow batch handed to Python; rows can be very long, so bytes bound memory and rows do not.
BATCH_BYTES = 8 << 20

_U64 = np.uint64
_GOLD = _U64(0x9E3779B97F4A7C15)


def stored(df: DataFrame, path: str) -> DataFrame:
    """df written as Parquet at path and read again: lineage ends in the shared folder."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def sweep(spark: SparkSession) -> None:
    """Drop the scratch tables and folders of this run. Only when no result that reads them is still to be written."""
    for t in spark.catalog.listTables():
        if t.name.startswith(f"tidegrid_{run_id(spark)}_"):
            spark.sql(f"DROP TABLE IF EXISTS `{t.name}`")
    base = scratch(spark).rpartition("/")[0]
    for name in children(spark, base):
        if name.startswith(f"tidegrid-{run_id(spark)}-"):
            remove(spark, f"{base}/{name}")


def byte_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by bytes, as document lengths differ by orders of magnitude."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def pick(df: DataFrame, *columns: str) -> DataFrame:
    """Only these columns, whatever else the table holds, cast to the types the operators take."""
    kinds = {"doc_id": "bigint", "text": "string", "page_id": "bigint", "item_id": "bigint"}
    return df.select(*[F.col(f"`{c}`").cast(kinds.get(c, "string")).alias(c) for c in columns])


def plain_names(df: DataFrame) -> DataFrame:
    """df with all columns but doc_id and text renamed by their place, as functions over batches cannot take every name; `toDF` gives them back."""
    return df.toDF(*[c if c in ("doc_id", "text") else f"c{i}" for i, c in enumerate(df.columns)])


#: Places of a task within what monotonically_increasing_id() gives.
TASK_SHIFT = 33


def ranked(rows: DataFrame, group: str, order: list[Column], base: str) -> tuple[DataFrame, int]:
    """rows with their place `idx` in the group and its size `n`; the size of the largest group.

    Rows are sorted by range of (group, order) and stored; a row's place within its range and the number of rows of the
    group in the ranges before give its place in the group, so no group is ordered in one task, however large it is.
    """
    sort = [F.col(group).asc(), *order]
    at = F.monotonically_increasing_id()
    rows = stored(rows.repartitionByRange(*sort).sortWithinPartitions(*sort).withColumn("at", at).withColumn("part", F.shiftright("at", TASK_SHIFT)), f"{base}/sorted")
    held = rows.groupBy(group, "part").agg(F.min("at").alias("first"), F.count("*").alias("m"))
    of = Window.partitionBy(group)
    before = F.sum("m").over(of.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    starts = stored(held.select(group, "part", (F.coalesce(before, F.lit(0)) - F.col("first")).alias("shift"), F.sum("m").over(of).alias("n")), f"{base}/starts")
    largest = starts.agg(F.max("n")).first()[0] or 0
    return rows.join(starts, [group, "part"]).withColumn("idx", F.col("at") + F.col("shift")).drop("at", "part", "shift"), largest


def sampled(column: str, share: float) -> Column:
    """Condition that holds for about this share of the values of a column, by the whole range of a 64-bit hash, so that no share is rounded to nothing."""
    return F.xxhash64(column) < F.lit(int(max(0.0, min(1.0, share)) * (1 << 64)) - (1 << 63)) if share < 1 else F.lit(True)


def mixed(h: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash, so that its high bits are as good as its low ones."""
    h = h.astype(_U64, copy=True)
    h ^= h >> _U64(32)
    h *= _U64(0xD6E8FEB86659FD93)
    h ^= h >> _U64(32)
    h *= _U64(0xD6E8FEB86659FD93)
    h ^= h >> _U64(32)
    return h


def word_hashes(words: list[bytes], seed: int = 0) -> np.ndarray:
    if seed:
        return np.fromiter((xxhash.xxh3_64_intdigest(w, seed) for w in words), dtype=_U64, count=len(words))
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=_U64, count=len(words))


def distinct(keys: np.ndarray) -> np.ndarray:
    """Sorted distinct values; sorting is far faster here than the hash table that np.unique takes for this."""
    keys = np.sort(keys)
    return keys[np.concatenate([[True], keys[1:] != keys[:-1]])] if len(keys) else keys


def double_hashes(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Both halves of a 128-bit hash of each word."""
    both = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, words)), dtype=">u8").reshape(-1, 2)
    return both[:, 1].astype(_U64), both[:, 0].astype(_U64)


def run_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Hash of every run of `width` consecutive word hashes; empty if there are fewer.

    Doubling combines two runs of equal width into one of twice the width, so a run costs log2(width) passes.
    """
    n = len(words) - width + 1
    if n <= 0:
        return np.empty(0, dtype=_U64)
    part, done, size, level = words.astype(_U64, copy=False), None, 1, 0
    left = width
    while left:
        if left & 1:
            if done is None:
                done, done_size = part, size
            else:
                m = min(len(done) - size, len(part))
                # the run so far stands after this part
                done = mixed(part[:m] * _GOLD + done[size : size + m] + _U64(level))
                done_size += size
        left >>= 1
        level += 1
        if left:
            m = len(part) - size
            part = mixed(part[:m] * _GOLD + part[size : size + m] + _U64(level * 7919))
            size *= 2
    return done[:n]
