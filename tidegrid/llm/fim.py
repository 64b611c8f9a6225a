"""Fill-in-middle transformation, as a pipeline of pyarrow.compute over each batch.

A text is cut into units (lines with their newline, the last one perhaps without), and into a prefix, a middle and a
suffix of whole units. Each batch splits its texts into lists of units, flattens them with the index of their text,
computes each unit's ordinal there, filters by role, rebuilds one list per text and role and joins it. Cut points come
from hashes of the row's id, so a task that runs again gives the same rows, and no row depends on another.

Forms: `plain`, the text itself; `psm`, prefix, suffix, middle; `spm`, suffix, prefix, middle. A text stays plain if it is
empty, holds a sentinel, or its hash says so. Missing texts count as empty. A missing id has the hash of the seed alone.
Equal ids with different texts are cut by the same numbers. Texts of any length stay whole: batches are bounded by bytes,
so one text is the most a task holds beyond a batch. Other columns are ignored, whatever their names; an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import byte_batches, documents, pick

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED = 7
#: Texts in a hundred that are transformed at all, and of those the ones that take the suffix first.
RATE, SPM_RATE = 100, 50
OUT = "doc_id long, n long, form string, prefix string, middle string, suffix string, output string"


def _numbers(seed: int) -> list[Column]:
    """Four 32-bit numbers of a row's id."""
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(hashed, 8 * i + 1, 8), 16, 10).cast("long").alias(f"h{i + 1}") for i in range(4)]


def _rest(a: pa.Array, by: pa.Array | int) -> pa.Array:
    """Remainder of division, for numbers that are not negative."""
    return pc.subtract(a, pc.multiply(pc.divide(a, by), by))


def units(texts: pa.Array) -> tuple[pa.Array, pa.Array, pa.Array]:
    """Units of all texts, the index of each one's text, and its ordinal there."""
    pieces = pc.split_pattern(texts.cast(pa.large_string()), "\n")
    parent = pc.list_parent_indices(pieces).cast(pa.int64())
    flat = pc.list_flatten(pieces)
    lengths = pc.list_value_length(pieces).cast(pa.int64())
    starts = pc.subtract(pc.cumulative_sum(lengths), lengths)
    ordinal = pc.subtract(pa.array(np.arange(len(flat))), starts.take(parent))
    last = pc.equal(ordinal, pc.subtract(lengths, 1).take(parent))
    flat = pc.if_else(last, flat, pc.binary_join_element_wise(flat, pa.scalar("\n", pa.large_string()), pa.scalar("", pa.large_string())))
    real = pc.invert(pc.and_(last, pc.equal(flat, "")))  # after a final newline there is nothing
    return flat.filter(real), parent.filter(real), ordinal.filter(real)


def _counts(parent: pa.Array, n: int) -> pa.Array:
    """How many units each of n texts has."""
    per = pa.table({"p": pa.concat_arrays([parent, pa.array(np.arange(n))])}).group_by("p").aggregate([([], "count_all")]).sort_by("p")
    return pc.subtract(per.column("count_all").combine_chunks(), 1).cast(pa.int64())


def _joined(flat: pa.Array, parent: pa.Array, chosen: pa.Array, n: int) -> pa.Array:
    """Chosen units of each of n texts as one string."""
    ends = pc.cumulative_sum(_counts(parent.filter(chosen), n))
    lists = pa.LargeListArray.from_arrays(pa.concat_arrays([pa.array([0], pa.int64()), ends]), flat.filter(chosen))
    return pc.binary_join(lists, pa.scalar("", pa.large_string()))


def _transform(rate: int, spm_rate: int):
    mark = {m: pa.scalar(m, pa.large_string()) for m in (PREFIX, SUFFIX, MIDDLE)}
    nothing = pa.scalar("", pa.large_string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            text = pc.fill_null(b.column("text").cast(pa.large_string()), "")
            flat, parent, ordinal = units(text)
            n = _counts(parent, b.num_rows)
            one, two = (_rest(b.column(h), pc.add(n, 1)) for h in ("h1", "h2"))
            low, high = pc.min_element_wise(one, two), pc.max_element_wise(one, two)
            in_prefix = pc.less(ordinal, low.take(parent))
            in_suffix = pc.greater_equal(ordinal, high.take(parent))
            in_middle = pc.invert(pc.or_(in_prefix, in_suffix))
            p, m, s = (_joined(flat, parent, chosen, b.num_rows) for chosen in (in_prefix, in_middle, in_suffix))
            plain = pc.or_(pc.equal(text, ""), pc.greater_equal(_rest(b.column("h3"), 100), rate))
            for sentinel in mark:
                plain = pc.or_(plain, pc.match_substring(text, sentinel))
            spm = pc.less(_rest(b.column("h4"), 100), spm_rate)
            by_prefix = pc.binary_join_element_wise(mark[PREFIX], p, mark[SUFFIX], s, mark[MIDDLE], m, nothing)
            by_suffix = pc.binary_join_element_wise(mark[SUFFIX], s, mark[PREFIX], p, mark[MIDDLE], m, nothing)
            kinds = [pc.if_else(plain, "plain", pc.if_else(spm, "spm", "psm")), *[pc.if_else(plain, pa.scalar(None, pa.large_string()), x) for x in (p, m, s)], pc.if_else(plain, text, pc.if_else(spm, by_suffix, by_prefix))]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), n, *[k.cast(pa.string()) for k in kinds]], names=["doc_id", "n", "form", "prefix", "middle", "suffix", "output"])

    return run


def transformed(docs: DataFrame, seed: int = SEED, rate: int = RATE, spm_rate: int = SPM_RATE) -> DataFrame:
    """doc_id, number of units, form, prefix, middle and suffix (null if plain), and the output of every row."""
    byte_batches(docs.sparkSession)
    return pick(docs, "doc_id", "text").select("doc_id", "text", *_numbers(seed)).mapInArrow(_transform(rate, spm_rate), OUT)


def restored(output: str, form: str) -> Column:
    """The text that an output was made of, from nothing but the output and its form.

    No part holds a sentinel, and none overlaps itself, so the first one found is the one that was put there.
    """
    out = F.col(output)

    def between(start: str, end: str) -> Column:
        return F.substring_index(F.substring_index(out, start, -1), end, 1)

    middle = F.substring_index(out, MIDDLE, -1)
    psm = F.concat(between(PREFIX, SUFFIX), middle, between(SUFFIX, MIDDLE))
    spm = F.concat(between(PREFIX, MIDDLE), middle, between(SUFFIX, PREFIX))
    return F.when(F.col(form) == "psm", psm).when(F.col(form) == "spm", spm).otherwise(out)


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = transformed(documents(spark, sf_dir))
    sha = lambda c: F.sha2(c, 256)
    return t.select("doc_id", "n", "form", F.char_length("prefix").cast("long").alias("prefix_chars"), F.char_length("middle").cast("long").alias("middle_chars"), sha(F.col("output")).alias("output_sha256"), sha(restored("output", "form")).alias("restored_sha256"))
