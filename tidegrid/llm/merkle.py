"""Merkle manifest of a dataset, by lag and lead windows.

Each row is a leaf; the leaves of a group (a language) ascend by id, and every `fan` consecutive nodes become one, level
by level, until one is left: the group's subroot. Subroots, ordered by group, make up the root in the same way.

1. Leaves are stored with a hash of their own each, and sorted by range of (group, id). A row's place within its range
   and the number of rows in the ranges before give its place within the group, so no group is ordered in one task,
   however large it is.
2. On each level, lag and lead columns at the fixed offsets 1 to fan - 1 hold a node's siblings, masked by its slot in the
   run and by the length of the run; the first child of each run hashes its parent. Windows are of one run each. Levels
   shrink by the fan and are stored, which ends their lineage.
3. From the top down each node takes its parent's path and puts its own siblings before it. The window of a level and the
   join with its parents share one exchange, by run, so the leaves move once.

Values count as their UTF-8 text; missing ones as `-`. Missing ids stand first in their group and missing groups first of
all; repeated rows are leaves of their own, one after another. Long texts are hashed where they are read and do not move.
Columns other than those asked for are ignored, whatever their names; an empty table has no rows and no root.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, pick, ranked, scratch, stored

FAN = 8
#: What a leaf hashes, in this order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    """Length, colon and text of a value, so that no two rows of fields read the same."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(values: list[Column]) -> Column:
    return digest(*[field(v) for v in values])


def _siblings(nodes: DataFrame, fan: int) -> DataFrame:
    """nodes with their run, and the digests of the run's others to the left and to the right of each."""
    nodes = nodes.withColumn("run", F.floor(F.col("idx") / fan)).withColumn("slot", F.col("idx") - F.col("run") * fan)
    length = F.least(F.lit(fan), F.col("n") - F.col("run") * fan)
    w = Window.partitionBy("g", "run").orderBy("idx")
    none = F.lit("")
    left = [F.when(F.col("slot") >= k, F.lag("digest", k).over(w)).otherwise(none) for k in range(fan - 1, 0, -1)]
    right = [F.when(F.col("slot") + k < length, F.lead("digest", k).over(w)).otherwise(none) for k in range(1, fan)]
    return nodes.withColumns({"left": F.concat(*left), "right": F.concat(*right)})


def _climb(leaves: DataFrame, largest: int, fan: int, base: str) -> list[DataFrame]:
    """Nodes (g, idx, n, digest) of each level, leaves first; n is the number of nodes of the group on that level."""
    levels = [leaves]
    while largest > 1:
        first = _siblings(levels[-1].where("n > 1").select("g", "idx", "n", "digest"), fan).where("slot = 0")
        up = first.select("g", F.col("run").alias("idx"), F.ceil(F.col("n") / fan).alias("n"), digest(F.col("digest"), F.col("right")).alias("digest"))
        levels.append(stored(up, f"{base}/level{len(levels)}"))
        largest = -(-largest // fan)
    return levels


def _descend(levels: list[DataFrame], ends: DataFrame, fan: int) -> DataFrame:
    """The leaves with their path to the root: steps (left, right) from the leaf up, and what `ends` holds of their group, whose `steps` come last."""
    kept = [c for c in ends.columns if c not in ("g", "steps")]
    below = None
    for nodes in reversed(levels):
        own = [c for c in nodes.columns if c not in ("g", "idx", "n", "digest")]  # none but on the lowest level
        paths = nodes.where("n = 1").join(ends, "g").select("g", "idx", "digest", *own, *kept, "steps")
        if below is not None:
            parents = below.select("g", F.col("idx").alias("run"), *kept, F.col("steps").alias("above"))
            up = _siblings(nodes.where("n > 1"), fan).join(parents.hint("merge"), ["g", "run"])
            paths = paths.unionByName(up.select("g", "idx", "digest", *own, *kept, F.concat(F.array(F.struct("left", "right")), "above").alias("steps")))
        below = paths
    return below


def proofs(docs: DataFrame, leaves: dict[str, Column], group: Column, fan: int = FAN) -> DataFrame:
    """One row for each of docs: doc_id, the columns of `leaves` (the first is the leaf of the tree), subroot, root, and
    steps, an array of (left, right): the digests of its siblings on each level up to the root."""
    spark = docs.sparkSession
    base = scratch(spark)
    first = next(iter(leaves))
    rows = docs.select(F.coalesce(F.concat(F.lit("="), group.cast("string")), F.lit("")).alias("g"), "doc_id", *[c.alias(k) for k, c in leaves.items()])
    placed, largest = ranked(stored(rows, f"{base}/leaves"), "g", [F.col(c).asc_nulls_first() for c in ("doc_id", first)], f"{base}/low")
    low = _climb(placed.withColumn("digest", F.col(first)), largest, fan, f"{base}/low")
    tops = low[0].where("n = 1").select("g", "digest")
    for level in low[1:]:
        tops = tops.unionAll(level.where("n = 1").select("g", "digest"))
    tops, many = ranked(tops.select(F.lit("").alias("g"), F.col("g").alias("of"), "digest"), "g", [F.col("of").asc()], f"{base}/tops")
    high = _climb(tops, many, fan, f"{base}/high")
    root = high[-1].select("g", F.col("digest").alias("root"), F.array().cast("array<struct<left:string,right:string>>").alias("steps"))
    ends = stored(_descend(high, root, fan).select(F.col("of").alias("g"), F.col("digest").alias("subroot"), "root", "steps"), f"{base}/ends")
    return _descend(low, ends, fan).select("doc_id", *leaves, "subroot", "root", "steps")


def proof_text(steps: str) -> Column:
    """Digests of all siblings, level by level and left to right."""
    return F.array_join(F.transform(steps, lambda s: F.concat(s["left"], s["right"])), "")


def folded(start: Column, steps: str) -> Column:
    """The root that follows from a leaf and its siblings."""
    return F.aggregate(steps, start, lambda h, s: digest(s["left"], h, s["right"]))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = pick(documents(spark, sf_dir), *FIELDS)
    touched = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    lowered = [F.when(touched, F.translate(c, CAPITALS, SMALL)).otherwise(F.col(c)) if c == "text" else F.col(c) for c in FIELDS]
    leaves = {"leaf": leaf([F.col(c) for c in FIELDS]), "shown": leaf(lowered)}
    p = proofs(docs, leaves, F.col("lang"))
    p = p.withColumns({"proof_sha256": F.sha2(proof_text("steps"), 256), "folded_root": folded(F.col("shown"), "steps")})
    return p.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
