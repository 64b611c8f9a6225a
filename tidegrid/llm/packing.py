"""Packing token sequences by cutting-stock column generation.

Documents are tokenised once and cut into whole sequences and one rest each. Rest lengths are counted in classes of
`GRAIN` tokens; the histogram, whose size is bounded by the sequence length alone, is all that reaches the driver. There
a linear program over packing patterns is solved by column generation: a revised simplex keeps the basis, a knapsack
dynamic program over class sizes finds the pattern of least reduced cost, until none gains more than `GAP` or after
`ROUNDS` columns (which costs a little padding, never a piece). Pattern
counts are rounded down, what is left is packed best-fit. Every piece has a rank within its class (its place in its task
plus a running sum of task counts), and rank arithmetic assigns it to a copy of a pattern, so no class, however many
pieces it holds, meets in one task.

Defined results: null text counts as empty, its document is the closing id alone. Repeated rows are packed like any
other; equal ones may change places. Tasks are ordered by the number of their partition, so a table read in the same
splits is packed the same way each time. A text of any length is cut into as many pieces as it needs; an empty table
gives no rows; of the table's columns only doc_id and text are looked at, whatever the others are called. Ids are those of the tokenizer file's byte-level BPE; text pieces between spaces are encoded once and remembered
in a bounded table (`CACHE`). Inside a sequence longer classes stand first.
"""

from __future__ import annotations

import base64
import re
import struct
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import byte_batches, documents, pick, scratch, stored

LENGTH = 2048
GRAIN = 8
GAP = 2e-3
ROUNDS = 4000
CACHE = 400_000
CLOSING = 1
SPECIAL = "<|endoftext|>"

_CUT = re.compile(r"(?<=\S)(?= \S)")
_ODD = re.compile(r"\s ")
_SPACE = re.compile(r"\s+")
#: Length of a run of white space from which on the tokenizer file itself encodes a piece.
WIDE = 10_000


class Encoder(dict):
    """Text to little-endian 32-bit ids; as a dict it remembers the ids of text pieces.

    A piece is cut where a space follows a character that is not white space: the tokenizer's own pattern never
    reaches across such a place, so pieces can be encoded on their own.
    """

    def __init__(self, ranks_file: str, pattern: str, special: int, whole_file: str):
        import tiktoken

        super().__init__()
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(ranks_file, "rb"))}
        self.encode = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.special, self.whole_file, self.whole = struct.pack("<I", special), whole_file, None

    def _whole(self, piece: str) -> list[int]:
        """Ids from the tokenizer file itself, for white space longer than the faster encoder's pattern engine bears."""
        if self.whole is None:
            from tokenizers import Tokenizer

            self.whole = Tokenizer.from_file(self.whole_file)
        return self.whole.encode(piece, add_special_tokens=False).ids

    def __missing__(self, piece: str) -> bytes:
        wide = len(piece) >= WIDE and any(len(m[0]) >= WIDE for m in _SPACE.finditer(piece))
        ids = np.array((self._whole if wide else self.encode)(piece), dtype="<u4").tobytes()
        if len(piece) <= 48:
            if len(self) >= CACHE:
                self.clear()
            self[piece] = ids
        return ids

    def plain(self, text: str) -> bytes:
        if not text:
            return b""
        if _ODD.search(text):
            pieces = _CUT.split(text)
        else:
            first, *rest = text.split(" ")
            pieces = [first, *[" " + x for x in rest]] if first else [" " + x for x in rest]
        return b"".join(map(self.__getitem__, pieces))

    def ids(self, text: str | None) -> bytes:
        if text and SPECIAL in text:
            return self.special.join(map(self.plain, text.split(SPECIAL)))
        return self.plain(text or "")


def encoder(folder: str | None = None) -> Encoder:
    import public_tokenizers

    ranks, whole = (f"{folder}/{n}" if folder else str(public_tokenizers.path(n)) for n in ("byte_bpe_50k.tiktoken", "byte_bpe_50k.json"))
    return Encoder(ranks, public_tokenizers.PATTERN, 50256, whole)


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, class int, chunk long, rank long"


def _cut(length: int, grain: int, folder: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, chunk, ranks = encoder(folder), TaskContext.get().partitionId(), defaultdict(int)
        closing = struct.pack("<I", CLOSING)
        for b in batches:
            rows = []
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text"), strict=True):
                ids = memoryview(enc.ids(text.as_py()) + closing)
                n = len(ids) // 4
                for start in range(0, n, length):
                    size = min(length, n - start)
                    kind = -(-size // grain)
                    rows.append((doc_id, start, size, zlib.crc32(ids[4 * start : 4 * (start + size)]), n, kind, chunk, ranks[kind]))
                    ranks[kind] += 1
            kinds = [pa.int64()] * 5 + [pa.int32(), pa.int64(), pa.int64()]
            cols = list(zip(*rows, strict=True)) if rows else [()] * 8
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=[x.split()[0] for x in PIECES.split(", ")])

    return run


def best_pattern(worth: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """The multiset of classes 1..len(worth) within `room` that is worth most: unbounded knapsack by dynamic programming."""
    best, taken = np.zeros(room + 1), np.zeros(room + 1, dtype=int)
    for size in range(1, room + 1):
        k = min(size, len(worth))
        got = best[size - k : size][::-1] + worth[:k]
        i = int(got.argmax())
        if got[i] > best[size - 1] + 1e-12:
            best[size], taken[size] = got[i], i + 1
        else:
            best[size] = best[size - 1]
    pattern, size = np.zeros(len(worth), dtype=int), room
    while size > 0:
        if taken[size]:
            pattern[taken[size] - 1] += 1
            size -= taken[size]
        else:
            size -= 1
    return float(best[room]), pattern


def column_generation(demand: np.ndarray, room: int, gap: float = GAP, rounds: int = ROUNDS) -> list[tuple[np.ndarray, float]]:
    """Patterns and their fractional counts: least number of sequences that hold demand[i] pieces of class i + 1."""
    there = np.flatnonzero(demand)
    m = len(there)
    if not m:
        return []
    sizes = there + 1
    basis = [np.where(np.arange(m) == i, room // sizes[i], 0) for i in range(m)]
    inverse = np.diag(1.0 / np.array([room // s for s in sizes]))
    amount = inverse @ demand[there]
    for _ in range(rounds):
        duals = inverse.sum(axis=0)
        worth = np.zeros(room)
        worth[sizes - 1] = np.maximum(duals, 0)
        value, full = best_pattern(worth, room)
        if value <= 1 + gap:
            break
        column = full[there]
        direction = inverse @ column
        with np.errstate(divide="ignore", invalid="ignore"):
            step = np.where(direction > 1e-9, amount / direction, np.inf)
        out = int(step.argmin())
        if not np.isfinite(step[out]):
            break
        amount = np.maximum(amount - step[out] * direction, 0)
        amount[out] = step[out]
        row = inverse[out] / direction[out]
        inverse = inverse - np.outer(direction, row)
        inverse[out] = row
        basis[out] = column
    return [(np.bincount(there, weights=p, minlength=len(demand)).astype(int), float(x)) for p, x in zip(basis, amount, strict=True) if x > 1e-9]


def rounded(demand: np.ndarray, patterns: list[tuple[np.ndarray, float]], room: int) -> list[tuple[np.ndarray, int]]:
    """Whole pattern counts that hold exactly the demand: rounded down, the rest packed best-fit, longest first."""
    left, out = demand.copy(), []
    for p, x in sorted(patterns, key=lambda t: -t[1]):
        used = p > 0
        n = int(min(np.floor(x + 1e-6), (left[used] // p[used]).min())) if used.any() else 0
        if n > 0:
            out.append((p, n))
            left = left - n * p
    while left.any():
        p, free = np.zeros_like(demand), room
        while free > 0:
            fits = np.flatnonzero((left - p)[:free] > 0)
            if not len(fits):
                break
            c = int(fits[-1])
            n = int(min((left - p)[c], free // (c + 1)))
            p[c] += n
            free -= n * (c + 1)
        used = p > 0
        n = int((left[used] // p[used]).min())
        out.append((p, n))
        left = left - n * p
    return out


def plan(demand: np.ndarray, room: int) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per class the starts of its runs of ranks, and for each run the pieces per sequence and the first sequence id."""
    runs, first = defaultdict(list), 0
    used = defaultdict(int)
    for p, n in rounded(demand, column_generation(demand, room), room):
        for c in np.flatnonzero(p):
            runs[int(c) + 1].append((used[c], int(p[c]), first))
            used[c] += int(p[c]) * n
        first += n
    return {c: tuple(np.array(x, dtype=np.int64) for x in zip(*r, strict=True)) for c, r in runs.items()}


def _assign(where: dict):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kind, rank = (b.column(c).to_numpy(zero_copy_only=False) for c in ("class", "place"))
            seq = np.zeros(len(kind), dtype=np.int64)
            for c in np.unique(kind):
                starts, per, first = where[int(c)]
                mine = kind == c
                i = np.searchsorted(starts, rank[mine], side="right") - 1
                seq[mine] = first[i] + (rank[mine] - starts[i]) // per[i]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(seq)], names=[*b.schema.names, "sequence_id"])

    return run


def packed(docs: DataFrame, length: int = LENGTH, grain: int = GRAIN, folder: str | None = None) -> DataFrame:
    """One row per piece with its sequence and offset."""
    spark = docs.sparkSession
    byte_batches(spark)
    pieces = stored(pick(docs, "doc_id", "text").mapInArrow(_cut(length, grain, folder), PIECES), scratch(spark))
    counts = pieces.groupBy("chunk", "class").agg(F.count("*").alias("n"))
    room = -(-length // grain)
    demand = np.zeros(room, dtype=np.int64)
    for c, n in counts.groupBy("class").agg(F.sum("n")).collect():  # at most one row per class
        demand[c - 1] = n
    before = Window.partitionBy("class").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("chunk", "class", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    placed = pieces.join(base, ["chunk", "class"]).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "class", (F.col("base") + F.col("rank")).alias("place"))
    seq = placed.mapInArrow(_assign(plan(demand, room)), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, class int, place long, sequence_id long")
    inside = Window.partitionBy("sequence_id").orderBy(F.col("class").desc(), "place").rowsBetween(Window.unboundedPreceding, -1)
    return seq.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", F.coalesce(F.sum("length").over(inside), F.lit(0)).cast("bigint").alias("offset"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(documents(spark, sf_dir))
