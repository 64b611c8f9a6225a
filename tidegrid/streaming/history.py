"""The last rows of each series, from a log of micro-batches that may come again.

A batch is a folder of rows and a commit file named by query and epoch, which is made once: a batch that is replayed after
a crash finds its file and changes nothing. Compaction folds the log into a version that remembers the last epoch of each
query, trimmed to the rows a reader can ask for; it compares versions before it commits, so several may run at once.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..schema import CADENCE_S
from ..sources.folders import children, latest, put_new, read_small, read_version, remove, update_version
from .online import query_id


def last_rows(df: DataFrame, depth: int = 288, step: int = CADENCE_S, keys: tuple[str, ...] = ("sat_id",)) -> DataFrame:
    """The last `depth` rows of each series; only rows that a full grid would hold are ranked, so a task has few of a series."""
    ends = df.groupBy(*keys).agg(F.max("time").alias("__end"))
    near = df.join(ends, list(keys)).where(F.unix_seconds("time") > F.unix_seconds("__end") - depth * step).drop("__end")
    w = Window.partitionBy(*keys).orderBy(F.col("time").desc())
    return near.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= depth).drop("__r")


class History:
    """History of the series below a folder."""

    def __init__(self, spark: SparkSession, path: str, keys: tuple[str, ...] = ("sat_id",), depth: int = 288, step: int = CADENCE_S):
        self.spark, self.path, self.keys, self.depth, self.step = spark, path, keys, depth, step

    def append(self, query: str | None = None) -> Callable[[DataFrame, int], None]:
        """For foreachBatch; batches are told apart by the query's name, or else the id of its checkpoint, and their epoch.
        A query with a name that starts anew, without its checkpoint, needs a new one."""

        def run(batch: DataFrame, epoch: int) -> None:
            name = query or query_id(batch)
            mark = f"{self.path}/log/{name}/{epoch:012d}"
            found = latest(self.spark, self.path)
            if f"{epoch:012d}" in children(self.spark, f"{self.path}/log/{name}") or (found and found[1]["marks"].get(name, -1) >= epoch):
                return
            folder = uuid.uuid4().hex
            batch.write.parquet(f"{self.path}/rows/{folder}")
            if not put_new(self.spark, mark, folder):
                remove(self.spark, f"{self.path}/rows/{folder}")

        return run

    def _logged(self) -> list[tuple[str, int]]:
        return [(q, int(e)) for q in sorted(children(self.spark, f"{self.path}/log")) for e in sorted(children(self.spark, f"{self.path}/log/{q}")) if e.isdigit()]

    def _rows(self, base: DataFrame | None, logged: list[tuple[str, int]]) -> DataFrame | None:
        """Base and logged batches; of rows of one time the one of the last epoch counts."""
        names = [(e, read_small(self.spark, f"{self.path}/log/{q}/{e:012d}")) for q, e in logged]
        parts = ([base.withColumn("__e", F.lit(-1))] if base is not None else []) + [self.spark.read.parquet(f"{self.path}/rows/{n}").withColumn("__e", F.lit(e)) for e, n in names]
        if not parts:
            return None
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        rest = [c for c in out.columns if c not in (*self.keys, "time", "__e")]
        cols = [c for c in out.columns if c != "__e"]
        newest = out.groupBy(*self.keys, "time").agg(F.max_by(F.struct(*rest), "__e").alias("r"))
        return last_rows(newest.select(*self.keys, "time", "r.*").select(*cols), self.depth, self.step, self.keys)

    def read(self) -> DataFrame | None:
        """The history as all committed batches make it; None if there is none yet."""
        logged = self._logged()  # before the version: what is compacted meanwhile is in it
        found = latest(self.spark, self.path)
        marks = found[1]["marks"] if found else {}
        return self._rows(read_version(self.spark, self.path), [x for x in logged if x[1] > marks.get(x[0], -1)])

    def compact(self) -> None:
        """Fold the log into the next version; batches that the version before has already folded are deleted."""
        found = latest(self.spark, self.path)
        done = found[1]["marks"] if found else {}
        logged = self._logged()
        for q, e in logged:
            if e <= done.get(q, -1):
                name = read_small(self.spark, f"{self.path}/log/{q}/{e:012d}")
                remove(self.spark, f"{self.path}/rows/{name}")
                remove(self.spark, f"{self.path}/log/{q}/{e:012d}")
        new = [x for x in logged if x[1] > done.get(x[0], -1)]
        if new:
            update_version(self.spark, self.path, lambda old: self._rows(old, new), marks={q: max(e for p, e in new if p == q) for q, _ in new})
