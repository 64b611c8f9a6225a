"""Chunks of consecutive documents, kept in a table bucketed by chunk.

Operators that look at a chunk twice (to send out keys, then to apply what came back) join the answers to this table
without moving its texts again.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, GroupedData
from pyspark.sql import functions as F

from .common import byte_batches, scratch, scratch_table

CHUNK_BYTES = 6 << 20
PARTITION_BYTES = 12 << 20
#: A partition streams its chunks, so its size is no matter of memory; these keep the number of tasks in hand.
MANY, LARGE = 20_000, 512 << 20
#: Partitions of an exchange of runs at most; what a scheduler bears, at every size.
MOST_PARTITIONS = 100_000


def _gather(columns: list[str], chunk_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq = TaskContext.get().partitionId(), 0
        held, size = [], 0

        def flush():
            nonlocal held, size, seq
            t = pa.Table.from_batches(held).combine_chunks()
            n = t.num_rows
            text = t.column("text").combine_chunks()
            text = text.chunk(0) if isinstance(text, pa.ChunkedArray) else text
            rest = [t.column(c).combine_chunks() for c in columns]
            rest = [c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in rest]
            ends = pa.array([0, n], pa.int32())
            out = pa.RecordBatch.from_arrays(
                [pa.array([(part << 24) + seq], pa.int64()), pa.ListArray.from_arrays(ends, text), pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays(rest, names=columns))],
                names=["chunk", "texts", "rest"],
            )
            held, size, seq = [], 0, seq + 1
            return out

        for b in batches:
            step = max(1, int(b.num_rows * chunk_bytes / max(1, b.nbytes)))
            for at in range(0, b.num_rows, step):
                held.append(b.slice(at, step))
                size += held[-1].nbytes
                if size >= chunk_bytes:
                    yield flush()
        if held:
            yield flush()

    return run


def chunked(docs: DataFrame, rest: list[str], order: list[str] | None = None, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Table (chunk, texts, rest): documents as they are read or, with order, so that smaller chunk numbers hold earlier ones.

    `rest` are the other columns that come along. Rows with equal order may stand in either order.
    """
    spark = docs.sparkSession
    byte_batches(spark)
    df = docs.select(F.col("text"), *[F.col(f"`{c}`") for c in rest])
    partitions = partitions_for(docs)
    if order:
        df = df.repartitionByRange(partitions, *[F.col(f"`{c}`").asc_nulls_first() for c in order[:1]]).sortWithinPartitions(*[F.col(f"`{c}`").asc_nulls_first() for c in order])
    kinds = ", ".join(f"`{f.name}`: {f.dataType.simpleString()}" for f in df.select(*[F.col(f"`{c}`") for c in rest]).schema)
    rows = df.mapInArrow(_gather(rest, chunk_bytes), f"chunk long, texts array<string>, rest array<struct<{kinds}>>")
    name = scratch_table(spark)
    n = min(max(partitions, 8), 65_536)
    rows.write.option("path", f"{scratch(spark)}/chunks").option("compression", "zstd").format("parquet").bucketBy(n, "chunk").saveAsTable(name)
    return spark.table(name)


def partitions_for(docs: DataFrame) -> int:
    """About one partition for every PARTITION_BYTES of text; beyond MANY partitions they grow, up to LARGE bytes each."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(1, min(-(-total // PARTITION_BYTES), max(MANY, -(-total // LARGE))))


def by_range(sent: DataFrame, n_ranges: int) -> GroupedData:
    """Runs grouped by key range, a partition for each range; beyond MOST_PARTITIONS a task takes several, one after another."""
    return sent.repartition(min(n_ranges, MOST_PARTITIONS), "piece").groupBy("piece")


def join_answers(table: DataFrame, answers: DataFrame, name: str = "answers") -> DataFrame:
    """table with the answers (chunk, piece, body) of each chunk as an array; the table is not shuffled."""
    per = answers.groupBy("chunk").agg(F.collect_list(F.struct("piece", "body")).alias(name))
    return table.join(per.hint("shuffle_hash"), "chunk", "left")
