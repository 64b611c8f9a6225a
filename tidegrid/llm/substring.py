"""Substring dedup with a log-structured fingerprint index.

Documents are put in order of doc_id and cut into chunks, the batches of the index. A window is 20 consecutive words; its
key is a 64-bit hash of them, its proof a second one, from the other halves of the 128-bit hashes of the words.

1. Each chunk sorts the distinct keys of its windows and sends every range of the key space its share as one coded run.
   Ranges answer which keys another chunk has too; text that occurs once ends here.
2. For the others chunks send keys with their proofs. A range keeps a log of sorted immutable runs: it merge-joins each
   new run with them, in the order of the chunks, verifies matches by their proofs, marks the entries that are in the
   log, and adds the run, compacting runs of like length.
3. The marks go back to the chunk, which removes each word that a marked window covers, or one that the chunk itself has
   had before. Windows with different words count as equal with odds of 2 to the -128 a pair.

`index`, an Index of a folder, keeps windows for later batches: documents of batches committed before count as earlier than
all of this one, and only new documents are read. The folder holds immutable runs, each a table with a row per key range,
and commits, each a list of runs; the last one counts. A call stores its run but does not commit it: the caller writes the
rows it got and then calls index.commit(), so a call that is lost or made again finds the index as it was. A call merge-joins all its windows with the runs there are and adds one run; runs less than twice as long as what is added
to them are compacted into it. The number of ranges, a power of two, follows the size of history and batch together;
runs stored in other ranges are sliced anew as they are read.

Words are runs of bytes other than space and 0x09-0x0D. Null text has none; a text of fewer than 20 words loses nothing.
Rows that share a doc_id count as documents of their own, in the order of their texts, nulls first; equal rows are
repeats of one another. Texts of any length are looked at whole, one chunk at a time; an empty table gives no rows; only
doc_id and text are looked at, whatever other columns are called.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.folders import Conflict, commit, latest
from . import runs
from .chunks import by_range, chunked, join_answers
from .common import distinct, documents, double_hashes, pick, plain_names, remove, run_hashes, scratch, stored

WIDTH = 20
#: Entries of one key range; a task of the merge holds a few times that.
RANGE_ENTRIES = 1 << 20


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()


class Windows:
    """All windows of a chunk in order: the words, where each document ends, each window's first word, key and proof."""

    def __init__(self, texts: pa.Array, width: int):
        self.words, ends = [], [0]
        for t in texts:
            self.words += _words(t.as_py())
            ends.append(len(self.words))
        self.ends = np.array(ends, dtype=np.int64)
        n = np.diff(self.ends)
        many = np.maximum(n - width + 1, 0)  # windows of each document
        self.first = np.repeat(self.ends[:-1] - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(many.sum()) if len(many) else self.ends[:0]
        low, self._high = double_hashes(self.words)
        self.keys = run_hashes(low, width)[self.first] if len(self.first) else np.empty(0, np.uint64)
        self.width = width

    def proofs(self) -> np.ndarray:
        return run_hashes(self._high, self.width)[self.first] if len(self.first) else np.empty(0, np.uint64)


class Chunk:
    """Windows of a chunk; `shared` tells for each whether its key is in another chunk (or all are to be sent)."""

    def __init__(self, texts: pa.Array, answers, edges: np.ndarray, width: int, everything: bool):
        own = Windows(texts, width)
        self.edges, self.words, self.ends, self.first, self.keys, self.proofs = edges, own.words, own.ends, own.first, own.keys, own.proofs()
        keys, back, counts = np.unique(self.keys, return_inverse=True, return_counts=True)
        shared = np.full(len(keys), everything)
        cut = runs.cuts(keys, edges)
        for a in answers or []:
            lo, hi = cut[a["piece"]], cut[a["piece"] + 1]
            shared[lo:hi] = runs.flags(a["body"], hi - lo)
        self.shared, again = shared[back], counts[back] > 1
        self.repeats = np.zeros(len(self.keys), dtype=bool)
        at, order, new = self._entries(again)
        self.repeats[at[order[~new]]] = True  # the order is stable, so the first of equal windows is the earliest

    def _entries(self, pick: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = np.flatnonzero(pick)
        return at, *runs.ordered(self.keys[at], self.proofs[at])

    def sent(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Distinct shared entries by range: (range, keys, proofs)."""
        at, order, new = self._entries(self.shared)
        at = at[order[new]]
        keys, proofs = self.keys[at], self.proofs[at]
        cut = runs.cuts(keys, self.edges)
        for k in np.flatnonzero(np.diff(cut)).tolist():
            yield k, keys[cut[k] : cut[k + 1]], proofs[cut[k] : cut[k + 1]]

    def marked(self, found) -> np.ndarray:
        """Which windows are repeats, from the marks of the ranges and from the chunk itself."""
        at, order, new = self._entries(self.shared)
        number = np.cumsum(new) - 1
        cut = runs.cuts(self.keys[at[order[new]]], self.edges)
        seen = np.zeros(int(new.sum()), dtype=bool)
        for a in found or []:
            lo, hi = cut[a["piece"]], cut[a["piece"] + 1]
            seen[lo:hi] = runs.flags(a["body"], hi - lo)
        out = self.repeats.copy()
        out[at[order]] |= seen[number]
        return out


def _count(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([sum(max(0, len(_words(t.as_py())) - width + 1) for t in r) for r in (x.values for x in b.column("texts"))], pa.int64())], names=["n"])

    return run


def _rows(names: list[str], kinds: list[pa.DataType], rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)


def _send(width: int, n_ranges: int):
    edges = runs.range_edges(n_ranges)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                keys, chunk = distinct(Windows(b.column("texts")[i].values, width).keys), b.column("chunk")[i].as_py()
                cut = runs.cuts(keys, edges)
                yield _rows(["piece", "chunk", "body"], [pa.int32(), pa.int64(), pa.binary()], [(k, chunk, runs.encode(keys[cut[k] : cut[k + 1]])) for k in np.flatnonzero(np.diff(cut)).tolist()])

    return run


SHARED = "chunk long, piece int, body binary"


def _shared(key: tuple, group: pa.Table) -> pa.Table:
    """For each chunk's run which keys another chunk has; nothing for runs without any."""
    each = [runs.decode(x.as_py()) for x in group.column("body")]
    _, back, counts = np.unique(np.concatenate(each), return_inverse=True, return_counts=True)
    rows, at = [], 0
    for chunk, k in zip(group.column("chunk").to_pylist(), each, strict=True):
        many = counts[back[at : at + len(k)]] > 1
        at += len(k)
        if many.any():
            rows.append((chunk, key[0].as_py(), runs.bits(many)))
    return pa.Table.from_batches([_rows(["chunk", "piece", "body"], [pa.int64(), pa.int32(), pa.binary()], rows)])


ENTRIES = "piece int, chunk long, body binary, proofs binary"
_ENTRY_KINDS = [pa.int32(), pa.int64(), pa.binary(), pa.binary()]


def _prove(width: int, n_ranges: int, everything: bool):
    edges = runs.range_edges(n_ranges)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                own = Chunk(b.column("texts")[i].values, None if everything else b.column("answers")[i].as_py(), edges, width, everything)
                chunk = b.column("chunk")[i].as_py()
                yield _rows(["piece", "chunk", "body", "proofs"], _ENTRY_KINDS, [(k, chunk, runs.encode(x), y.astype("<u8").tobytes()) for k, x, y in own.sent()])

    return run


#: Chunk numbers of stored runs: those that stay, and those that this call compacts.
STAYS, COMPACTED = -2, -1
MARKS = "chunk long, piece int, body binary, proofs binary, n long"


def _merge(keep: bool):
    """One range: stored runs, then runs in the order of their chunks, against the log; with keep also the run to be stored."""

    def run(key: tuple, group: pa.Table) -> pa.Table:
        piece, chunks = key[0].as_py(), group.column("chunk").to_pylist()
        log, stays, rows = runs.Log(), runs.Log(), []
        for i in sorted(range(len(chunks)), key=chunks.__getitem__):
            mine = runs.decode(group.column("body")[i].as_py()), np.frombuffer(group.column("proofs")[i].as_py(), dtype="<u8")
            if chunks[i] == STAYS:
                stays.add(mine)
                continue
            if chunks[i] >= 0:
                old = stays.seen(mine)
                seen = old | log.seen(mine)
                if seen.any():
                    rows.append((chunks[i], piece, runs.bits(seen), None, int(seen.sum())))
                mine = mine[0][~old], mine[1][~old]
            log.add(mine)
        if keep:
            keys, proofs = log.compacted()
            rows.append((-1, piece, runs.encode(keys), proofs.astype("<u8").tobytes(), len(keys)))
        return pa.Table.from_batches([_rows(["chunk", "piece", "body", "proofs", "n"], [pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.int64()], rows)])

    return run


def covered(n_words: int, starts: np.ndarray, width: int) -> np.ndarray:
    """Which words windows with these first words cover."""
    d = np.bincount(starts, minlength=n_words + 1) - np.bincount(starts + width, minlength=n_words + 1)
    return np.cumsum(d[:n_words]) > 0


def _apply(width: int, n_ranges: int, everything: bool, names: list[str], texts_back: bool):
    edges = runs.range_edges(n_ranges)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                texts, rest = b.column("texts")[i].values, b.column("rest")[i].values
                chunk = Chunk(texts, b.column("answers")[i].as_py(), edges, width, everything)
                gone = covered(len(chunk.words), chunk.first[chunk.marked(b.column("found")[i].as_py())], width)
                before, rows = np.concatenate([[0], np.cumsum(gone)]), []
                for t, lo, hi in zip(texts, chunk.ends[:-1].tolist(), chunk.ends[1:].tolist(), strict=True):
                    removed = int(before[hi] - before[lo])
                    kept = [w for w, g in zip(chunk.words[lo:hi], gone[lo:hi].tolist(), strict=True) if not g] if removed else None
                    if texts_back:
                        rows.append(b" ".join(kept).decode("utf-8", "surrogatepass") if removed else t.as_py())
                    else:
                        rows.append((hi - lo, removed, hashlib.sha256(b" ".join(kept if removed else chunk.words[lo:hi])).hexdigest()))
                own = {rest.type.field(j).name: rest.field(j) for j in range(rest.type.num_fields)}
                if texts_back:
                    own["text"] = pa.array(rows, pa.string())
                    yield pa.RecordBatch.from_arrays([own[c] for c in names], names=names)
                else:
                    cols = list(zip(*rows, strict=True)) if rows else [(), (), ()]
                    yield pa.RecordBatch.from_arrays([own["doc_id"], pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    return run


class Index:
    """Stored runs of a folder, as its last commit lists them: (name, number of ranges, entries).

    One call of an operator takes in one batch, as the index stood when this object was made; commit(), once the call's
    rows have been written, makes the batch part of the history. A call that is lost or repeated before that leaves the
    index as it was, and of several callers that began from one state the first to commit wins: the others get Conflict
    and call again. A batch with a name that has been committed is `known`, so that a caller that died in between can
    tell that its rows were written.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        found = latest(spark, folder)
        self.base, content = found or (None, {"runs": [], "batches": []})
        self.runs = sorted((tuple(r) for r in content["runs"]), key=lambda r: r[2])
        self.batches = list(content["batches"])
        self.entries = sum(r[2] for r in self.runs)
        self.pending: tuple | None = None

    def known(self, batch: str) -> bool:
        return batch in self.batches

    def compacts(self, new: int) -> int:
        """How many of the shortest runs a run of `new` entries takes in, so that each stays at least twice as long as the next."""
        i = 0
        while i < len(self.runs) and self.runs[i][2] < 2 * new:
            new += self.runs[i][2]
            i += 1
        return i

    def rows(self, n_ranges: int, compacted: int) -> DataFrame | None:
        """All stored entries in the given ranges."""
        out = None
        for i, (name, _, _) in enumerate(self.runs):
            chunk = COMPACTED if i < compacted else STAYS
            part = self.spark.read.schema("piece int, body binary, proofs binary").parquet(f"{self.folder}/runs/{name}").mapInArrow(_slice(n_ranges, chunk), ENTRIES)
            out = part if out is None else out.unionAll(part)
        return out

    def prepare(self, run: DataFrame, n_ranges: int, compacted: int) -> None:
        """Store a run that is to stand in place of the shortest ones; no one reads it before the commit."""
        if self.pending:
            remove(self.spark, f"{self.folder}/runs/{self.pending[0]}")
        name = uuid.uuid4().hex
        run.write.parquet(f"{self.folder}/runs/{name}")
        n = self.spark.read.parquet(f"{self.folder}/runs/{name}").agg(F.sum("n")).first()[0] or 0
        self.pending = name, n_ranges, n, compacted

    def commit(self, batch: str | None = None) -> None:
        """Make the last call's batch part of the history, and delete what no version needs any more."""
        if not self.pending:
            raise RuntimeError("no call to commit")
        name, n_ranges, n, compacted = self.pending
        kept = [*self.runs[compacted:], *([(name, n_ranges, n)] if n else [])]
        content = {"runs": kept, "batches": [*self.batches, *([batch] if batch is not None else [])]}
        try:
            commit(self.spark, self.folder, self.base, content)
        except Conflict:
            remove(self.spark, f"{self.folder}/runs/{name}")
            self.pending = None
            raise
        for old in {r[0] for r in self.runs[:compacted]} | ({name} if not n else set()):
            remove(self.spark, f"{self.folder}/runs/{old}")
        self.pending = None
        self.__init__(self.spark, self.folder)


def _slice(n_ranges: int, chunk: int):
    edges = runs.range_edges(n_ranges)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for body, proofs in zip(b.column("body"), b.column("proofs"), strict=True):
                keys, p = runs.decode(body.as_py()), np.frombuffer(proofs.as_py(), dtype="<u8")
                cut = runs.cuts(keys, edges)
                yield _rows(["piece", "chunk", "body", "proofs"], _ENTRY_KINDS, [(k, chunk, runs.encode(keys[cut[k] : cut[k + 1]]), p[cut[k] : cut[k + 1]].tobytes()) for k in np.flatnonzero(np.diff(cut)).tolist()])

    return run


def ranges_for(entries: int) -> int:
    """The least power of two of ranges that hold at most RANGE_ENTRIES each on average."""
    return 1 << max(0, (max(1, entries) - 1) // RANGE_ENTRIES).bit_length()


def _marked(docs: DataFrame, rest: list[str], width: int, index: Index | None) -> tuple[DataFrame, int]:
    """Chunks with the shared keys (answers) and the marks (found) of each, and the number of key ranges."""
    spark, base = docs.sparkSession, scratch(docs.sparkSession)
    table = chunked(docs, rest, ["doc_id", "text"])
    total = table.select("texts").mapInArrow(_count(width), "n long").agg(F.sum("n")).first()[0] or 0
    n_ranges = ranges_for(total + (index.entries if index else 0))
    if index:
        compacted = index.compacts(total)
        both = table.withColumn("answers", F.lit(None).cast("array<struct<piece:int,body:binary>>"))
        sent = table.select("chunk", "texts").mapInArrow(_prove(width, n_ranges, True), ENTRIES)
        old = index.rows(n_ranges, compacted)
        sent = sent if old is None else sent.unionAll(old)
    else:
        keys = table.select("chunk", "texts").mapInArrow(_send(width, n_ranges), "piece int, chunk long, body binary")
        answers = stored(by_range(keys, n_ranges).applyInArrow(_shared, SHARED), f"{base}/shared")
        both = join_answers(table, answers)
        sent = both.where("answers IS NOT NULL").select("chunk", "texts", "answers").mapInArrow(_prove(width, n_ranges, False), ENTRIES)
    marks = stored(by_range(sent, n_ranges).applyInArrow(_merge(bool(index)), MARKS), f"{base}/marks")
    if index:
        index.prepare(marks.where("chunk = -1 AND n > 0").select("piece", "body", "proofs", "n"), n_ranges, compacted)
    return join_answers(both, marks.where("chunk >= 0"), "found"), n_ranges


def removed_words(docs: DataFrame, width: int = WIDTH, index: Index | None = None) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every row."""
    chunks, n_ranges = _marked(pick(docs, "doc_id", "text"), ["doc_id"], width, index)
    return chunks.select("texts", "rest", "answers", "found").mapInArrow(_apply(width, n_ranges, bool(index), [], False), "doc_id long, n_words long, n_removed long, kept_sha256 string")


def without_repeats(docs: DataFrame, width: int = WIDTH, index: Index | None = None) -> DataFrame:
    """docs with repeated words taken out of text (kept words joined by one space; untouched texts stay as they are)."""
    plain = plain_names(docs)
    chunks, n_ranges = _marked(plain, [c for c in plain.columns if c != "text"], width, index)
    return chunks.select("texts", "rest", "answers", "found").mapInArrow(_apply(width, n_ranges, bool(index), plain.columns, True), plain.schema).toDF(*docs.columns)


def op3_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removed_words(documents(spark, sf_dir))
