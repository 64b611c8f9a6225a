"""N-gram Jaccard join, size-aware: subsets for small sets, inverted lists for large ones.

A document's set holds its distinct five-word shingles, as 64-bit hashes. Two sets link when 100 * intersection >= 75 *
union. Documents with equal sets are one node, named by the 128-bit digest of the set.

1. Chunks of documents send the shingles they hold, with counts, to key ranges, which answer with how frequent each is
   over all documents (one entry a chunk and shingle, so a shingle of very many documents is no burden).
2. A set whose shingles are not at least three quarters shared can have no partner and is done. Of the others
   - light sets, up to a size boundary, enumerate their subsets of the size that a link with each partner size requires;
     a set that shares one with a set of that size is linked with it, so each need only be tied to the first of the
     partner size in the subset's list (and the tie is checked);
   - heavy sets, and light ones large enough to link with heavy ones, go into the inverted lists of their rarest
     shingles, so many that two linked sets always meet in a list (prefix filter, rarest first).
   The boundary is where the subsets of a set cost more rows than its lists and the candidates met there, from the mean
   number of sets that hold a shingle.
3. Lists are scanned in two rounds. The first pairs each node with the head of the list, the one with the fewest
   shingles of its own (in a group of copies the original, as a rule), and counts the shingles both share; components of
   the links found follow. The second pairs what is still apart within a list, if three bounds allow a link: both sizes;
   the places of the shingle in both prefixes; and what the two share with the head, plus at most what each shares with
   others outside the head. A group of many near copies is tied together in the first round, so its pairs are never all
   made, and no link is lost.

Null and empty texts have an empty set and link with nothing. Rows that share a doc_id are documents of their own; equal
rows are one node and so linked. Texts of any length give their whole set, one chunk of documents at a time; an empty
table gives no rows; only doc_id and text are looked at, whatever other columns are called.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import runs
from .chunks import by_range, chunked, join_answers
from .common import distinct, documents, pick, plain_names, remove, run_hashes, scratch, stored, word_hashes
from .components import components

WIDTH = 5
NEED, OF = 75, 100
RANGE_ENTRIES = 1 << 20
#: Rows that verifying one candidate costs as much as, for the boundary between light and heavy sets.
CANDIDATE_COST = 2
#: Sizes tried beyond the best one so far; from there on the subsets, which grow as binomials, only get dearer.
AHEAD = 8

_U64 = np.uint64


def shingles(text: str | None, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct shingle hashes of a text."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, dtype=_U64)
    h = word_hashes(words)
    if len(words) < width:
        return run_hashes(h, len(words)) ^ _U64(len(words))
    return distinct(run_hashes(h, width))


def node_of(s: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(s.tobytes())


def least_shared(n: int, m: int) -> int:
    """Shared shingles that a link of sets of n and m needs."""
    return -(-NEED * (n + m) // (OF + NEED))


def partners(n: int) -> range:
    """Sizes that a set of n can link with."""
    return range(-(-NEED * n // OF), n * OF // NEED + 1)


def prefix(n: int) -> int:
    return n - (-(-NEED * n // OF)) + 1


def subset_rows(n: int, light: int) -> int:
    return sum(comb(n, least_shared(n, m)) for m in partners(n) if m <= light and least_shared(n, m) <= min(n, m))


def boundary(mean_list: float) -> int:
    """Largest size for which enumerating subsets is no dearer than scanning lists of this mean length."""
    best = n = 0
    while n < best + AHEAD:
        n += 1
        if subset_rows(n, n) <= prefix(n) * (1 + CANDIDATE_COST * max(0.0, mean_list - 1)):
            best = n
    return best


def _counted(texts: pa.Array, width: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """The set of each document, and the chunk's shingles with the number of distinct sets that hold each."""
    sets, new, seen = [], [], set()
    for t in texts:
        s = shingles(t.as_py(), width)
        sets.append(s)
        if len(s) and (k := node_of(s)) not in seen:
            seen.add(k)
            new.append(s)
    keys, counts = np.unique(np.concatenate([*new, np.empty(0, _U64)]), return_counts=True)
    return sets, keys, counts


def _send(width: int, n_ranges: int):
    edges = runs.range_edges(n_ranges)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                _, keys, counts = _counted(b.column("texts")[i].values, width)
                cut = runs.cuts(keys, edges)
                filled = np.flatnonzero(np.diff(cut))
                body = [runs.encode(keys[cut[k] : cut[k + 1]]) for k in filled]
                many = [pa.compress(np.minimum(counts[cut[k] : cut[k + 1]], 65535).astype("<u2").tobytes(), "zstd", asbytes=True) for k in filled]
                yield pa.RecordBatch.from_arrays([pa.array(filled, pa.int32()), pa.array([b.column("chunk")[i].as_py()] * len(body), pa.int64()), pa.array(body, pa.binary()), pa.array(many, pa.binary())], names=["piece", "chunk", "body", "many"])

    return run


ANSWERS = "chunk long, piece int, body binary, holders long, distinct_keys long"


def _frequencies(key: tuple, group: pa.Table) -> pa.Table:
    """For each chunk's run one byte a key: 0 if no other chunk has it, else 1 + log2 of the number of sets that do, in halves."""
    each = [runs.decode(x.as_py()) for x in group.column("body")]
    own = [np.frombuffer(pa.decompress(x.as_py(), 2 * len(k), "zstd", asbytes=True), dtype="<u2").astype(np.int64) for x, k in zip(group.column("many"), each, strict=True)]
    keys, back = np.unique(np.concatenate(each), return_inverse=True)
    total = np.bincount(back, weights=np.concatenate(own)).astype(np.int64)
    out, at = [], 0
    for k, n in zip(each, own, strict=True):
        df = total[back[at : at + len(k)]]
        at += len(k)
        level = np.where(df > n, 1 + np.floor(2 * np.log2(df)), 0).astype(np.uint8)
        out.append(pa.compress(level.tobytes(), "zstd", asbytes=True))
    n = len(out)
    return pa.table({"chunk": group.column("chunk"), "piece": pa.array([key[0].as_py()] * n, pa.int32()), "body": pa.array(out, pa.binary()), "holders": pa.array([int(total.sum()) if not i else 0 for i in range(n)], pa.int64()), "distinct_keys": pa.array([len(keys) if not i else 0 for i in range(n)], pa.int64())})


SETS = "chunk long, idx int, doc_id long, n int, node binary, s int, tokens binary, lists array<long>, places array<int>, subsets array<struct<m: int, token: long>>"


def _six(s: np.ndarray) -> bytes:
    """The top 48 bits of sorted hashes, which tell the shingles of two sets apart as well as all 64 do in practice, without their low bytes."""
    return np.ascontiguousarray(s.astype("<u8").view(np.uint8).reshape(-1, 8)[:, 2:]).tobytes()


def _eight(b: bytes) -> np.ndarray:
    out = np.zeros((len(b) // 6, 8), dtype=np.uint8)
    out[:, 2:] = np.frombuffer(b, dtype=np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


def _classify(width: int, n_ranges: int, light: int):
    edges = runs.range_edges(n_ranges)

    def one(s: np.ndarray, level: np.ndarray) -> tuple:
        """Number of shared shingles, the set, its rarest shared ones with their places in the prefix, its subsets."""
        n = len(s)
        shared = level > 0
        if int(shared.sum()) * OF < NEED * n:
            return None, None, None, None, None
        subsets = lists = places = None
        if n <= light:
            subsets = []
            for m in partners(n):
                o = least_shared(n, m)
                if m <= light and o <= min(n, m):
                    head = np.array([min(n, m), max(n, m)], dtype=_U64).tobytes()
                    subsets += [(m, _signed(xxhash.xxh3_64_intdigest(head + np.array(c, dtype=_U64).tobytes()))) for c in combinations(s[shared], o)]
        if n * OF // NEED > light:
            order = np.lexsort((s, level))[: prefix(n)]
            places = np.flatnonzero(shared[order])
            lists, places = [_signed(int(x)) for x in s[order[places]]], places.tolist()
        return int(shared.sum()), (_six(s) if lists or subsets else None), lists or None, places or None, subsets

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                texts, rest, chunk = b.column("texts")[i].values, b.column("rest")[i].values, b.column("chunk")[i].as_py()
                sets, keys, counts = _counted(texts, width)
                cut = runs.cuts(keys, edges)
                level = np.zeros(len(keys), dtype=np.uint8)
                for a in b.column("answers")[i].as_py() or []:
                    lo, hi = cut[a["piece"]], cut[a["piece"] + 1]
                    level[lo:hi] = np.frombuffer(pa.decompress(a["body"], int(hi - lo), "zstd", asbytes=True), dtype=np.uint8)
                local = 1 + np.floor(2 * np.log2(np.maximum(counts, 1)))
                level = np.where(level > 0, level, np.where(counts > 1, local, 0)).astype(np.uint8)
                doc_ids, seen, rows = rest.field("doc_id").to_pylist(), set(), []
                for j, s in enumerate(sets):
                    if not len(s):
                        rows.append((chunk, j, doc_ids[j], 0, *[None] * 6))
                        continue
                    node = node_of(s)
                    more = (None,) * 5
                    if node not in seen:
                        seen.add(node)
                        more = one(s, level[np.searchsorted(keys, s)])
                    rows.append((chunk, j, doc_ids[j], len(s), node, *more))
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.int32(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.struct([("m", pa.int32()), ("token", pa.int64())]))]
                cols = list(zip(*rows, strict=True)) if rows else [()] * 10
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["chunk", "idx", "doc_id", "n", "node", "s", "tokens", "lists", "places", "subsets"])

    return run


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _count_shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        shared, linked, held, held_of = [], [], None, None
        for x, y in zip(b.column("ta"), b.column("tb"), strict=True):
            p, q = _eight(x.as_py()), y.as_py()
            if q != held_of:
                held, held_of = _eight(q), q
            k = int(runs.member(p, held).sum())
            shared.append(k)
            linked.append(OF * k >= NEED * (len(p) + len(held) - k))
        yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b"), pa.array(shared, pa.int32()), pa.array(linked, pa.bool_())], names=["a", "b", "shared", "linked"])


def _tested(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b) with the number of shingles their full sets share, and whether that makes a link."""
    first = pairs.join(sets.select(F.col("node").alias("a"), F.col("tokens").alias("ta")), "a")
    both = first.join(sets.select(F.col("node").alias("b"), F.col("tokens").alias("tb")), "b")
    return both.select("a", "b", "ta", "tb").mapInArrow(_count_shared, "a binary, b binary, shared int, linked boolean")


def _fits(a, b, most):
    """Whether sets of sizes a and b that share `most` shingles at best can link."""
    return (OF * a >= NEED * b) & (OF * b >= NEED * a) & ((OF + NEED) * most >= NEED * (a + b))


def nodes_and_labels(docs: DataFrame, rest: list[str], width: int = WIDTH) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The chunk table, its documents (chunk, idx, doc_id, n, node), and (node, label) of nodes with links."""
    spark = docs.sparkSession
    base = scratch(spark)
    table = chunked(docs, rest)
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_ranges = max(1, -(-total // (5 * RANGE_ENTRIES)))  # a shingle a word, and hardly a word below five bytes
    sent = table.select("chunk", "texts").mapInArrow(_send(width, n_ranges), "piece int, chunk long, body binary, many binary")
    answers = stored(by_range(sent, n_ranges).applyInArrow(_frequencies, ANSWERS), f"{base}/answers")
    size = answers.agg(F.sum("holders"), F.sum("distinct_keys")).first()
    light = boundary((size[0] or 0) / max(1, size[1] or 0))
    found = join_answers(table, answers).select("chunk", "texts", "rest", "answers").mapInArrow(_classify(width, n_ranges, light), SETS)
    found = stored(found, f"{base}/sets")

    sets = found.where("tokens IS NOT NULL").groupBy("node").agg(*[F.first(c).alias(c) for c in ("n", "s", "tokens", "lists", "places")])
    sets = stored(sets, f"{base}/heavy")
    lists = sets.select("node", "n", "s", F.explode(F.arrays_zip("lists", "places")).alias("p")).select("node", "n", "s", F.col("p.lists").alias("token"), F.col("p.places").alias("place"))
    # heads are stored before they are joined back: Spark then splits the list of a hot shingle over tasks
    heads = lists.groupBy("token").agg(F.min(F.struct((F.col("n") - F.col("s")).alias("own"), "n", "node")).alias("head"), F.min("n").alias("smallest"), F.count("*").alias("m"))
    heads = stored(heads.where("m > 1").select("token", "head", "smallest"), f"{base}/heads")
    to_head = _fits(F.col("n"), F.col("head.n"), F.least("s", F.col("head.n") - F.col("head.own"))) & (F.col("node") != F.col("head.node"))
    near = lists.join(heads, "token").where(to_head).select(F.col("node").alias("a"), F.col("head.node").alias("b"))
    subsets = found.where("subsets IS NOT NULL").select("node", "n", F.explode("subsets").alias("x")).select("node", "n", "x.m", "x.token").distinct()
    tops = stored(subsets.groupBy("token", F.col("n").alias("m")).agg(F.min("node").alias("b")), f"{base}/tops")
    tied = subsets.join(tops, ["token", "m"]).where(F.col("node") != F.col("b")).select(F.col("node").alias("a"), "b")
    tested = stored(_tested(near.unionAll(tied).distinct(), sets), f"{base}/tested")
    links = tested.where("linked").select("a", "b")
    labels = components(links)

    # what is still apart within a list, without entries whose place leaves no partner of the list's sizes
    room = F.floor((OF + NEED) * F.least(F.col("s"), F.col("n") - F.col("place")) / NEED) - F.col("n")  # largest partner
    own = lists.join(heads, "token").withColumn("room", room).where(F.col("room") >= F.col("smallest"))
    own = own.join(labels, "node", "left").select("node", "n", "s", "token", "room", F.col("head.node").alias("b"), F.coalesce("label", "node").alias("label"))
    own = stored(own, f"{base}/own")
    split = stored(own.groupBy("token").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("token"), f"{base}/split")
    left = own.join(split, "token", "left_semi").join(tested.select(F.col("a").alias("node"), "b", "shared"), ["node", "b"], "left")
    left = stored(left.withColumn("shared", F.when(F.col("node") == F.col("b"), F.col("n")).otherwise(F.col("shared"))), f"{base}/left")
    x, y = left.alias("x"), left.alias("y")
    through = F.least("x.shared", "y.shared") + F.least(F.col("x.s") - F.col("x.shared"), F.col("y.s") - F.col("y.shared"))
    most = F.least("x.s", "y.s", F.when(F.col("x.shared").isNotNull() & F.col("y.shared").isNotNull(), through).otherwise(F.col("x.s")))
    may = (F.col("x.label") < F.col("y.label")) & (F.col("x.n") <= F.col("y.room")) & (F.col("y.n") <= F.col("x.room")) & _fits(F.col("x.n"), F.col("y.n"), most)
    pairs = x.join(y, (F.col("x.token") == F.col("y.token")) & may).select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct()
    more = stored(_tested(pairs, sets).where("linked").select("a", "b"), f"{base}/more")
    if not more.isEmpty():
        labels = components(links.unionAll(more))
    found = stored(found.select("chunk", "idx", "doc_id", "n", "node"), f"{base}/found")
    for t in ("answers", "sets", "heavy", "heads", "tops", "tested", "own", "split", "left", "more"):
        remove(spark, f"{base}/{t}")
    return table, found, labels


def grouped(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, n_shingles, component_id of every row."""
    _, found, labels = nodes_and_labels(pick(docs, "doc_id", "text"), ["doc_id"], width)
    low = found.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("low")).join(labels, "node", "left").select("node", "low", F.coalesce("label", "node").alias("label"))
    base = scratch(docs.sparkSession)
    low = stored(low, f"{base}/low")
    per = stored(low.groupBy("label").agg(F.min("low").alias("component_id")), f"{base}/per")
    known = stored(low.join(per, "label").select("node", "component_id"), f"{base}/known")
    out = found.join(known, "node", "left")
    return out.select("doc_id", F.col("n").cast("bigint").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def _keep(names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                texts, rest = b.column("texts")[i].values, b.column("rest")[i].values
                keep = pa.array(sorted(b.column("kept")[i].as_py() or []), pa.int32())
                yield pa.RecordBatch.from_arrays([(texts if c == "text" else rest.field(c)).take(keep) for c in names], names=names)

    return run


def one_of_each(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """The rows of docs without all but one of each component: that of the smallest doc_id (of such, the first one read)."""
    plain = plain_names(docs)
    table, found, labels = nodes_and_labels(plain, [c for c in plain.columns if c != "text"], width)
    best = found.where("n > 0").groupBy("node").agg(F.min(F.struct("doc_id", "chunk", "idx")).alias("first"))
    best = best.join(labels, "node", "left").groupBy(F.coalesce("label", "node").alias("label")).agg(F.min("first").alias("first")).select("first.*")
    stay = best.select("chunk", "idx").unionAll(found.where("n = 0").select("chunk", "idx"))
    kept = stay.groupBy("chunk").agg(F.collect_list("idx").alias("kept"))
    return table.join(kept.hint("shuffle_hash"), "chunk").select("texts", "rest", "kept").mapInArrow(_keep(plain.columns), plain.schema).toDF(*docs.columns)


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouped(documents(spark, sf_dir))
