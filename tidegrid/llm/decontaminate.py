"""Benchmark decontamination by the q-gram lemma.

Benchmark items are folded (lower case, runs of anything but letters and digits as one space) and cut into overlapping windows of `WINDOW` characters, and
of `PASSAGE` characters every `STRIDE`, so that an excerpt of PASSAGE + STRIDE - 1 characters, some 13 words, holds a whole passage wherever it starts; shorter
items are one window. Two strings within k edits share at least n + 1 - q(k + 1) of the q-grams of a window of n
characters, on diagonals that differ by at most k. So for every document the q-grams it shares with benchmark texts are
found and counted in overlapping bands of diagonals (each 2k + 1 wide or wider, one every k + 1 diagonals, so that any
k + 1 neighbours lie within one), first per text with the least bound of its windows, then, where that is met, per
window. Bands that reach the bound become regions, and each region is verified by an alignment confined to its band. A document is reported with an item if one of the item's windows aligns within its edit
budget.

Benchmark windows are sent to the tasks in blocks of at most `BLOCK_CHARS` characters (or one item, should it be longer); a larger benchmark takes more
scans, none of its items is dropped. A document is walked in strides of `WALK` q-grams that overlap by a whole region, so
memory follows neither its length nor how often a q-gram repeats in it; equal windows of an item count once. Nothing is
shuffled. Null or empty texts and items match nothing, as do items of fewer than Q folded characters; repeated rows and
items are each reported; of equally good alignments the first is told. An empty table or benchmark gives no rows; only
doc_id, item_id and text are looked at, whatever other columns are called.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession

from .common import byte_batches, documents, pick, plain_names

Q = 8
WINDOW = 96
PASSAGE = 72
STRIDE = 8
RATE = 0.08
BLOCK_CHARS = 4 << 20
#: Q-grams of a document that are looked up in one go, and hits counted in one go.
WALK = 1 << 14
HITS = 1 << 18

_A = np.uint64(0x9E3779B97F4A7C15)
_B = np.uint64(0xC2B2AE3D27D4EB4F)
_BITS = 20


_BETWEEN = re.compile(r"[\W_]+")


def fold(text: str) -> str:
    """Lower-case letters and digits with single spaces between; punctuation and line breaks do not tell texts apart."""
    return _BETWEEN.sub(" ", text).strip().lower()


def grams(text: str) -> np.ndarray:
    """Hash of each run of Q = 8 characters, by doubling."""
    h = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    for width in (1, 2, 4):
        if len(h) <= width:
            return h[:0]
        h = h[:-width] * _A + h[width:]
        h ^= h >> np.uint64(29)
    return h * _B


def budget(n: int, rate: float = RATE) -> int:
    """Edits allowed to a window of n characters: the rate, lessened until the lemma asks for shared q-grams."""
    k = int(n * rate)
    while k > 0 and bound(n, k) < max(1, n // 8):
        k -= 1
    return k


def bound(n: int, k: int) -> int:
    return n + 1 - Q * (k + 1)


def windows(items: Iterable[tuple[int, str]]) -> list[tuple[int, int, int, str]]:
    """(item_id, number of its text, place, folded window), equal windows of a text once."""
    out = []
    for item, text in items:
        text = fold(text or "")
        unit = xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass"))
        for width, step in ((WINDOW, WINDOW // 2), (PASSAGE, STRIDE)):
            if width == WINDOW or len(text) > PASSAGE:  # a shorter item is one window already
                last = max(0, len(text) - width)
                first: dict[str, int] = {}
                for s in sorted({*range(0, last, step), last}):
                    if len(w := text[s : s + width]) >= Q:
                        first.setdefault(w, s)
                out += [(item, unit, s, w) for w, s in first.items()]
    return out


def banded_distances(pattern: np.ndarray, text: np.ndarray, firsts: np.ndarray, width: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """For each band of `width` diagonals from firsts[i] on: least edits that turn pattern into a piece of text within it, and that piece's end.

    Diagonal d is text position less pattern position; rows run over the pattern, cells over bands and their diagonals.
    More than k edits are told as k + 1, end -1.
    """
    far = k + 1 + len(pattern)
    steps = np.arange(width)
    diagonals = np.asarray(firsts)[:, None] + steps
    row = np.where((diagonals >= 0) & (diagonals <= len(text)), 0, far)  # the piece may start anywhere
    for i, c in enumerate(pattern):
        at = diagonals + i  # text position that a substitution in this row consumes
        inside = (at >= 0) & (at < len(text))
        same = inside & (text[np.where(inside, at, 0)] == c) if len(text) else inside
        new = np.where(inside, row + ~same, far)
        new[:, :-1] = np.minimum(new[:, :-1], row[:, 1:] + 1)  # a pattern character without one in the text
        out = (at < -1) | (at >= len(text))  # text consumed after this row
        new[out] = far
        row = np.minimum.accumulate(new - steps, axis=1) + steps  # text characters without one in the pattern
        row[out] = far
        if row.min() > k:
            return np.full(len(row), k + 1), np.full(len(row), -1)
    best = row.argmin(axis=1)
    edits = np.minimum(row[np.arange(len(row)), best], k + 1)
    return edits, np.where(edits <= k, diagonals[:, 0] + best + len(pattern), -1)


def banded_distance(pattern: np.ndarray, text: np.ndarray, first: int, last: int, k: int) -> tuple[int, int]:
    """One band, diagonals first..last."""
    edits, ends = banded_distances(pattern, text, np.array([first]), last - first + 1, k)
    return int(edits[0]), int(ends[0])


def dense(at: np.ndarray, fewest: int, span: int) -> np.ndarray:
    """Of sorted places those that stand, with at least `fewest` in all, within `span`: a region needs as many shared q-grams."""
    if len(at) < fewest or fewest <= 1:
        return at[: len(at) if fewest <= 1 else 0]
    first = np.flatnonzero(at[fewest - 1 :] - at[: len(at) - fewest + 1] <= span)
    edge = np.zeros(len(at) + 1, dtype=np.int64)
    edge[first] += 1
    np.subtract.at(edge, first + fewest, 1)
    return at[np.cumsum(edge[:-1]) > 0]


class Index:
    """Q-grams of a block of windows: hash -> (text, place) to find where shared ones gather, hash -> (window, place) to count there."""

    def __init__(self, wins: list[tuple[int, int, int, str]]):
        self.items = np.array([w[0] for w in wins], dtype=np.int64)
        self.codes = [np.frombuffer(w[3].encode("utf-32-le", "surrogatepass"), dtype="<u4") for w in wins]
        self.n = np.array([len(c) for c in self.codes])
        self.k = np.array([budget(n) for n in self.n])
        self.least = np.array([bound(n, k) for n, k in zip(self.n, self.k, strict=True)])
        self.fewest, self.span = int(self.least.min(initial=1 << 30)), int((self.n + self.k).max(initial=0))
        hashes = [grams(w[3]) for w in wins]
        h = np.concatenate([*hashes, np.empty(0, np.uint64)])
        sizes = [len(x) for x in hashes]
        win = np.repeat(np.arange(len(wins)), sizes)
        place = np.concatenate([*[np.arange(n) for n in sizes], np.empty(0, int)]).astype(np.int64)
        order = np.argsort(h, kind="stable")
        self.h, self.win, self.place = h[order], win[order], place[order]
        # texts: the largest step of bands and the least bound of their windows hold for all of them
        _, unit = np.unique(np.array([w[1] for w in wins], dtype=np.uint64), return_inverse=True)
        self.step, self.lowest = np.zeros(unit.max(initial=-1) + 1, dtype=np.int64), np.full(unit.max(initial=-1) + 1, 1 << 40)
        np.maximum.at(self.step, unit, self.k + 1)
        np.minimum.at(self.lowest, unit, self.least)
        at = (unit[win] << 40) + np.repeat(np.array([w[2] for w in wins], dtype=np.int64), sizes) + place
        at, first = np.unique(at, return_index=True)
        order = np.argsort(h[first], kind="stable")
        self.text_h, self.text_unit, self.text_place = h[first][order], (at >> 40)[order], (at & ((1 << 40) - 1))[order]
        self.bits = np.zeros(1 << _BITS, dtype=bool)
        self.bits[(self.h >> np.uint64(64 - _BITS)).astype(np.int64)] = True

    def matches(self, text: str) -> dict[int, tuple[int, int, int]]:
        """item -> (edits, end in the folded text, shared q-grams) of its best window."""
        h = grams(text)
        maybe = np.flatnonzero(self.bits[(h >> np.uint64(64 - _BITS)).astype(np.int64)])
        maybe = dense(maybe, self.fewest, self.span)
        found: dict[int, tuple[int, int, int]] = {}
        codes, at = None, 0
        while at < len(maybe):
            end = int(np.searchsorted(maybe, maybe[at] + WALK + self.span))  # every region lies within one stride
            near = self._gathered(h, maybe[at:end])
            for w, bands, shared in self._regions(h, near) if len(near) else ():
                item, k = int(self.items[w]), int(self.k[w])
                if item in found and found[item][0] == 0:
                    continue
                if codes is None:
                    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
                edits, ends = banded_distances(self.codes[w], codes, bands * (k + 1) - k, 4 * k + 3, k)
                i = int(edits.argmin())
                if edits[i] <= k and (item not in found or edits[i] < found[item][0]):
                    found[item] = int(edits[i]), int(ends[i]), int(shared[i])
            at = int(np.searchsorted(maybe, maybe[at] + WALK)) if end < len(maybe) else end
        return found

    def _gathered(self, h: np.ndarray, places: np.ndarray) -> np.ndarray:
        """Of these places those with q-grams in a band of diagonals of a benchmark text that holds as many as its least demanding window asks for."""
        lo, hi = np.searchsorted(self.text_h, h[places], "left"), np.searchsorted(self.text_h, h[places], "right")
        has = np.flatnonzero(hi > lo)
        has = has[np.isin(places[has], dense(places[has], self.fewest, self.span), assume_unique=True)]
        if not len(has):
            return places[:0]
        lo, n, places = lo[has], (hi - lo)[has], places[has]
        total = np.concatenate([[0], np.cumsum(n)])
        cuts = [0]
        while cuts[-1] < len(n):
            cuts.append(max(cuts[-1] + 1, int(np.searchsorted(total, total[cuts[-1]] + HITS, "right")) - 1))

        def bands(a: int, b: int) -> np.ndarray:
            m = n[a:b]
            hit = np.repeat(lo[a:b] - (total[a:b] - total[a]), m) + np.arange(total[b] - total[a])
            unit = self.text_unit[hit]
            return (unit << 40) + np.floor_divide(np.repeat(places[a:b], m) - self.text_place[hit], self.step[unit]) + (1 << 39)

        keys, counts, last = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64), None
        for a, b in zip(cuts, cuts[1:], strict=False):
            last = bands(a, b)
            new, more = np.unique(last, return_counts=True)
            if len(cuts) == 2:
                keys, counts = new, more
            else:
                keys, back = np.unique(np.concatenate([keys, new]), return_inverse=True)
                counts = np.bincount(back, weights=np.concatenate([counts, more]), minlength=len(keys)).astype(np.int64)
        # two neighbouring steps make a band
        upper = np.flatnonzero(keys[1:] - keys[:-1] == 1)
        both = counts.copy()
        both[upper] += counts[upper + 1]
        good = both >= self.lowest[keys >> 40]
        good[1:] |= good[:-1] & (keys[1:] - keys[:-1] == 1)
        keys = keys[good]
        if not len(keys):
            return places[:0]
        keep = np.zeros(len(places), dtype=bool)
        for a, b in zip(cuts, cuts[1:], strict=False):
            mine = last if len(cuts) == 2 else bands(a, b)
            at = np.searchsorted(keys, mine)
            at[at == len(keys)] = 0
            keep[a:b] = np.logical_or.reduceat(keys[at] == mine, total[a:b] - total[a])
        return places[keep]

    def _regions(self, h: np.ndarray, places: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(window, its bands of diagonals that reach the bound, q-grams shared in each), of q-grams at these places."""
        lo, hi = np.searchsorted(self.h, h[places], "left"), np.searchsorted(self.h, h[places], "right")
        n = hi - lo
        places, lo, n = places[n > 0], lo[n > 0], n[n > 0]
        keys, counts = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
        total = np.cumsum(n)
        at = 0
        while at < len(n):
            end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + HITS, "right")))
            m, first = n[at:end], lo[at:end]
            hit = np.repeat(first - np.concatenate([[0], np.cumsum(m)[:-1]]), m) + np.arange(m.sum())
            win = self.win[hit]
            band = np.floor_divide(np.repeat(places[at:end], m) - self.place[hit], self.k[win] + 1)
            key = (win << 40) + band + (1 << 39)
            new, more = np.unique(np.concatenate([key, key - 1]), return_counts=True)  # a band spans two steps, so each diagonal lies in two
            keys, back = np.unique(np.concatenate([keys, new]), return_inverse=True)
            counts = np.bincount(back, weights=np.concatenate([counts, more]), minlength=len(keys)).astype(np.int64)
            at = end
        win, band = keys >> 40, (keys & ((1 << 40) - 1)) - (1 << 39)
        good = counts >= self.least[win]
        win, band, counts = win[good], band[good], counts[good]
        edges = np.flatnonzero(np.concatenate([[True], win[1:] != win[:-1], [True]])) if len(win) else [0]
        for a, b in zip(edges, edges[1:], strict=False):
            yield int(win[a]), band[a:b], counts[a:b]


FOUND = "doc_id long, item_id long, edits int, region_end long, shared int"


def _scan(index: Index):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text"), strict=True):
                if t := text.as_py():
                    rows += [(doc_id, item, *x) for item, x in sorted(index.matches(fold(t)).items())]
            cols = list(zip(*rows, strict=True)) if rows else [()] * 5
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=[x.split()[0] for x in FOUND.split(", ")])

    return run


def blocks(benchmark: DataFrame, size: int = BLOCK_CHARS) -> Iterator[list[tuple[int, int, int, str]]]:
    """Windows of the benchmark, streamed to the driver and handed on in blocks of bounded size."""
    block, used = [], 0
    for r in pick(benchmark, "item_id", "text").where("text IS NOT NULL").orderBy("item_id", "text").toLocalIterator():
        own = windows([(r["item_id"], r["text"])])  # the windows of one item stay together, so it is reported once
        cost = sum(len(w[3]) for w in own)
        if block and used + cost > size:
            yield block
            block, used = [], 0
        block += own
        used += cost
    if block:
        yield block


def contaminated(docs: DataFrame, benchmark: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """doc_id and item_id of each document that holds an item or a window of it, with the best alignment."""
    byte_batches(docs.sparkSession)
    texts = pick(docs, "doc_id", "text")
    parts = [texts.mapInArrow(_scan(Index(b)), FOUND) for b in blocks(benchmark, block_chars)]
    return reduce(DataFrame.unionAll, parts) if parts else docs.sparkSession.createDataFrame([], FOUND)


def _clean(index: Index, at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = [not ((t := x.as_py()) and index.matches(fold(t))) for x in b.column(at)]
            yield b.filter(pa.array(keep, pa.bool_()))

    return run


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs that hold no benchmark passage, unchanged."""
    byte_batches(docs.sparkSession)
    left = plain_names(docs)
    for b in blocks(benchmark):
        left = left.mapInArrow(_clean(Index(b), docs.columns.index("text")), left.schema)
    return left.toDF(*docs.columns)


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
