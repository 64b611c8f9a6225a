"""SimHash near-dedup by tiled exact comparison: exclusive-or and bit counts of whole tiles, tile pairs too far apart skipped.

1. Each text becomes a 64-bit fingerprint of its shingles. Equal fingerprints are one from here on, named by themselves.
2. Distinct fingerprints are sorted by their population counts: of all 64 bits, then of the first half, of quarters and so
   on. Consecutive ones make a tile of at most `tile` fingerprints, which keeps the least and the largest count in each
   of 1, 2, 4, 8 and 16 equal parts of the word over its members.
3. Counts of a part differ by no more than the bits that differ in it. So the gaps between two tiles' counts, summed over
   the parts of one width, bound the distance of any two of their members from below; a pair of tiles with a bound beyond
   the radius is skipped. What is left is dealt out, a pair a row.
4. A task cuts both tiles into small ones, skips pairs of those by the same bound, and compares the others in full. It
   passes on a link from each fingerprint to one that it is connected with, not all pairs, so a group of near copies
   gives as many links as it has members, and small tiles that are already connected as a whole are skipped as well.
5. Components of the links give each fingerprint its class, and its documents theirs.

Every pair within the radius is found: nothing is hashed into buckets, sampled or capped. The price is that the number of
tile pairs grows with the square of the distinct fingerprints; the README has figures.

Missing and empty texts have fingerprint zero and link like any other. Texts of any length are read whole, `BLOCK`
shingles at a time. A missing doc_id is never a component's name unless it has no other. Repeated rows each get their
row. Other columns are ignored, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import byte_batches, documents, pick, ranked, remove, scratch, stored
from .components import components

WIDTH, SEED, RADIUS = 4, 42, 4
#: Fingerprints of a tile and of the small tiles within.
TILE, SMALL = 32_768, 128
#: Equal parts of the word whose population counts are kept.
PARTS = (1, 2, 4, 8, 16)
#: Shingles that are hashed at a time.
BLOCK = 1 << 16
MOST_TASKS = 20_000
BITS = 64
_U64 = np.uint64


def _hashes(words: list[bytes], width: int, seed: int) -> Iterator[np.ndarray]:
    """Hashes of all shingles, some at a time."""
    width = min(width, len(words))
    line, ends = b" ".join(words), np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate([[0], ends[:-1]])[: len(words) - width + 1].tolist()
    ends = (ends[width - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    for at in range(0, len(starts), BLOCK):
        yield np.array([digest(line[a:z], seed) for a, z in zip(starts[at : at + BLOCK], ends[at : at + BLOCK], strict=True)], dtype=_U64)


def fingerprint(text: str | None, width: int = WIDTH, seed: int = SEED) -> int:
    """Each bit is 1 if it is set in over half of the shingles' hashes; zero without words. As a signed 64-bit number."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    n, ones = 0, np.zeros(BITS, dtype=np.int64)
    for h in _hashes(words, width, seed):
        n += len(h)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, BITS // 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.int64)[0])


def _fingerprints(width: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            prints = [fingerprint(t.as_py(), width, seed) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(prints, pa.int64())], names=["doc_id", "print"])

    return run


def fingerprints(docs: DataFrame, width: int = WIDTH, seed: int = SEED) -> DataFrame:
    """(doc_id, print) of every row."""
    byte_batches(docs.sparkSession)
    return pick(docs, "doc_id", "text").mapInArrow(_fingerprints(width, seed), "doc_id long, print long")


# ------------------------------------------------------------------ tiles
def _order() -> list:
    """What tiles are sorted by: the count of the whole, then of the left half of each part, wide parts before narrow ones.

    With a part's count known, that of its left half tells that of the right one.
    """
    by = [F.bit_count("print")]
    for parts in PARTS[1:]:
        wide = BITS // parts
        for k in range(0, parts, 2):
            mask = ((1 << wide) - 1) << (k * wide)
            by.append(F.bit_count(F.col("print").bitwiseAND(F.lit(mask))))
    return by


def counts(prints: np.ndarray) -> np.ndarray:
    """Population counts of the parts of each fingerprint, widest parts first."""
    finest = PARTS[-1]
    wide = BITS // finest
    per = np.stack([np.bitwise_count((prints >> _U64(k * wide)) & _U64((1 << wide) - 1)) for k in range(finest)], axis=1).astype(np.int16)
    return np.concatenate([per.reshape(len(prints), p, -1).sum(axis=2) for p in PARTS], axis=1).astype(np.int16)


def box(per: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest counts of each `size` consecutive fingerprints."""
    at = np.arange(0, len(per), size)
    return np.minimum.reduceat(per, at), np.maximum.reduceat(per, at)


def apart(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Least distance that members of each of the tiles a can have from members of each of the tiles b."""
    gaps = np.maximum(0, np.maximum(a[0][:, None] - b[1][None], b[0][None] - a[1][:, None]))
    ends = np.cumsum((0, *PARTS))
    return np.max([gaps[:, :, x:y].sum(axis=2) for x, y in zip(ends, ends[1:], strict=False)], axis=0)


def _boxed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i in range(b.num_rows):
            prints = b.column("prints")[i].values.to_numpy().view(_U64)
            low, high = (x[0].tolist() for x in box(counts(prints), len(prints)))
            cols = [b.column("tile").slice(i, 1), pa.array([low], pa.list_(pa.int16())), pa.array([high], pa.list_(pa.int16())), pa.array([prints.tobytes()], pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names=["tile", "low", "high", "body"])


def tiles(prints: DataFrame, size: int = TILE) -> DataFrame:
    """Distinct fingerprints as tiles (tile, low, high, body); tiles are full but for the last one, however many tasks sort them."""
    placed, _ = ranked(prints.select(F.lit(0).alias("g"), "print"), "g", [*_order(), F.col("print").asc()], scratch(prints.sparkSession))
    rows = placed.groupBy(F.floor(F.col("idx") / size).alias("tile")).agg(F.array_sort(F.collect_list(F.struct("idx", "print"))).alias("rows"))
    return rows.select("tile", F.col("rows.print").alias("prints")).mapInArrow(_boxed, "tile long, low array<short>, high array<short>, body binary")


def tile_pairs(table: DataFrame, radius: int) -> DataFrame:
    """Pairs (a, b) of tiles that may hold fingerprints within the radius, each with itself as well.

    Tiles meet on the population counts that they hold, as these differ by no more than the radius.
    """
    heads = table.select("tile", "low", "high")
    own = heads.select("tile", "low", "high", F.explode(F.sequence(F.col("low")[0].cast("int"), F.col("high")[0].cast("int"))).alias("ones"))
    near = heads.select(F.col("tile").alias("b"), F.col("low").alias("b_low"), F.col("high").alias("b_high"), F.explode(F.sequence(F.col("low")[0].cast("int") - radius, F.col("high")[0].cast("int") + radius)).alias("ones"))
    met = own.join(near, "ones").where(F.col("tile") <= F.col("b"))
    gap = lambda i: F.greatest(F.lit(0), F.col("low")[i] - F.col("b_high")[i], F.col("b_low")[i] - F.col("high")[i])
    at, fits = 0, F.lit(True)
    for parts in PARTS:
        fits = fits & (sum((gap(i) for i in range(at, at + parts)), F.lit(0)) <= radius)
        at += parts
    return met.where(fits).select(F.col("tile").alias("a"), "b").distinct()


# ------------------------------------------------------------------ comparison
class Forest:
    """Which of n things are connected so far: each holds the smallest number of those it is connected with."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def tie(self, i: np.ndarray, j: np.ndarray) -> None:
        while True:
            a, b = self.label[i], self.label[j]
            new = a != b
            if not new.any():
                return
            i, j, a, b = i[new], j[new], a[new], b[new]
            up = np.arange(len(self.label))
            np.minimum.at(up, np.maximum(a, b), np.minimum(a, b))
            while (up[up] != up).any():
                up = up[up]
            self.label = up[self.label]


def compared(a: np.ndarray, b: np.ndarray | None, radius: int, size: int = SMALL) -> np.ndarray:
    """Rows (fingerprint, another one that it is connected with) from all pairs within the radius of a and b; of a alone without b."""
    both = a if b is None else np.concatenate([a, b])
    shift = 0 if b is None else len(a)
    other = a if b is None else b
    near = apart(box(counts(a), size), box(counts(other), size)) <= radius
    forest = Forest(len(both))
    for p, q in zip(*np.nonzero(np.triu(near) if b is None else near), strict=True):
        x, y = p * size, q * size
        own, theirs = forest.label[x : x + size], forest.label[shift + y : shift + y + size]
        if own[0] == theirs[0] and (own == own[0]).all() and (theirs == own[0]).all():
            continue
        far = np.bitwise_count(a[x : x + size, None] ^ other[None, y : y + size])
        if far.min() > radius:  # most pairs of small tiles; finding places takes longer than all of the above
            continue
        i, j = np.nonzero(far <= radius)
        forest.tie(i + x, j + shift + y)
    moved = np.flatnonzero(forest.label != np.arange(len(both)))
    return np.stack([both[moved], both[forest.label[moved]]], axis=1)


def _links(radius: int, small: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                x, y = (np.frombuffer(b.column(c)[r].as_py(), dtype=_U64) for c in ("x", "y"))
                same = b.column("a")[r].as_py() == b.column("b")[r].as_py()
                found = compared(x, None if same else y, radius, small).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], names=["a", "b"])

    return run


def links(prints: DataFrame, radius: int = RADIUS, tile: int = TILE, small: int = SMALL) -> DataFrame:
    """Links (a, b) of distinct fingerprints that connect all those within the radius; not all pairs, but as connected as they are."""
    spark = prints.sparkSession
    base = scratch(spark)
    table = stored(tiles(prints, tile), f"{base}/tiles")
    pairs = stored(tile_pairs(table, radius), f"{base}/pairs")
    many = max(1, min(pairs.count(), MOST_TASKS))
    byte_batches(spark)
    rows = pairs.join(table.select(F.col("tile").alias("a"), F.col("body").alias("x")), "a").join(table.select(F.col("tile").alias("b"), F.col("body").alias("y")), "b")
    return rows.select("a", "b", "x", "y").repartition(many, "a", "b").mapInArrow(_links(radius, small), "a long, b long")


def grouped(docs: DataFrame, width: int = WIDTH, seed: int = SEED, radius: int = RADIUS, tile: int = TILE, small: int = SMALL) -> DataFrame:
    """doc_id, print and component_id of every row."""
    base = scratch(docs.sparkSession)
    found = stored(fingerprints(docs, width, seed), f"{base}/found")
    low = stored(found.groupBy("print").agg(F.min("doc_id").alias("low")), f"{base}/low")
    tied = stored(links(low, radius, tile, small), f"{base}/links")
    labels = components(tied)
    named = stored(low.join(labels.select(F.col("node").alias("print"), "label"), "print", "left").select("print", "low", F.coalesce("label", "print").alias("label")), f"{base}/named")
    per = stored(named.groupBy("label").agg(F.min("low").alias("component_id")), f"{base}/per")
    known = stored(named.join(per, "label").select("print", "component_id"), f"{base}/known")
    for t in ("low", "links", "named", "per"):
        remove(docs.sparkSession, f"{base}/{t}")
    return found.join(known, "print").select("doc_id", "print", "component_id")


def op12_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = grouped(documents(spark, sf_dir))
    return g.select("doc_id", F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"), "component_id")
