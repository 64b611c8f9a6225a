"""Suffix-array dedup by a common-prefix-aware distributed merge sort, over a sparse suffix array.

A byte goes if a string of 50 bytes that covers it also starts in a document with a smaller doc_id. Sorting all suffixes
would move the corpus fifty times over, so only suffixes at anchors are sorted: in every 50-byte window the place of the
smallest hash of 24 bytes (leftmost on ties) is its anchor. Equal windows have their anchor at the same place, so each
window need only be compared with the windows of equal anchors.

1. Chunks of documents in order of doc_id send the hashes of their anchors to key ranges, which answer which of them
   other documents have too. Text that occurs once ends here.
2. For the others each chunk sorts the suffixes (up to 50 bytes) at its distinct anchors and sends every range a
   front-coded run: common prefix length with the entry before, the bytes that follow, and the bytes left of the anchor.
3. A range merges its runs with a loser tree. Each player keeps the length of the prefix it is known to share with the
   last winner; players with different lengths are ordered by these alone, equal ones are compared from there on, so no
   known prefix is read again. The tree yields the suffix array and its common prefix lengths.
4. A window that starts l bytes left of its anchor equals another if both stand in one stretch of the suffix array with
   common prefixes of 50 - l and agree in the l bytes before the anchor; the first document of each such class keeps it.
   The answers return to the chunks, which unite the marked windows and cut them out; where the anchors of its entries
   are, a chunk has sent along to itself, so that it need not find them again.

A passage of very many documents is one entry a chunk. An anchor with more than `HOT` occurrences in all, whose contexts
may differ, is not left to one range: each window around it is an entry of its own, dealt out by the hash of its 50
bytes, so that equal windows still meet and different ones spread over all ranges.

Null text counts as empty. Rows that share a doc_id count as documents of their own, in the order of their texts, nulls
first. Texts of any length are looked at whole, a megabyte at a time with overlaps of a window; an empty table gives no
rows; only doc_id and text are looked at, whatever other columns are called.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import runs
from .chunks import by_range, chunked, join_answers
from .common import distinct, documents, mixed, pick, scratch, stored

SPAN = 50
GRAM = 24
REACH = SPAN - GRAM
RANGE_ENTRIES = 1 << 20
#: Occurrences of an anchor beyond which its windows are dealt out one by one.
HOT = RANGE_ENTRIES // 4
#: Bytes of text looked at in one go inside a chunk; hashes are eight times that and should stay in a core's cache.
BLOCK = 1 << 17
#: Bytes of a chunk; its shared anchors are Python objects for a while.
CHUNK_BYTES = 3 << 20

_U64 = np.uint64
_MUL = [_U64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63)]


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of each 24 bytes, by doubling to 8 and 16 and joining both."""
    h = data.astype(_U64) + _U64(1)
    parts = {}
    for i, width in enumerate((1, 2, 4, 8)):
        if len(h) <= width:
            return h[:0]
        h = h[:-width] * _MUL[i] + h[width:]
        h ^= h >> _U64(31)
        parts[2 * width] = h
    n = len(data) - GRAM + 1
    if n <= 0:
        return h[:0]
    return mixed(parts[16][:n] * _MUL[4] + parts[8][16 : 16 + n])


class Anchors:
    """Anchors of a block of texts, or of a piece of one: place in the block, hash, first and last start of the windows they stand for, document."""

    def __init__(self, raws: list[bytes], skipped: int = 0):
        """`skipped`: bytes of the first document that stand before this block."""
        ends = np.cumsum([len(r) for r in raws], dtype=np.int64)
        self.starts = ends - [len(r) for r in raws] - skipped
        self.data = np.frombuffer(b"".join(raws), dtype=np.uint8)
        n = len(self.data) - SPAN + 1
        self.place = self.first = self.last = self.doc = np.empty(0, dtype=np.int64)
        self.hash = np.empty(0, dtype=_U64)
        if n <= 0:
            return
        h = gram_hashes(self.data)
        low = (h >> _U64(32) << _U64(32)) | np.arange(len(h), dtype=_U64)
        window, width = REACH + 1, 1
        while 2 * width <= window:
            low = np.minimum(low[:-width], low[width:])
            width *= 2
        if width < window:
            low = np.minimum(low[: len(low) - (window - width)], low[window - width :])
        anchor = (low[:n] & _U64(0xFFFFFFFF)).astype(np.int64)
        doc = np.repeat(np.arange(len(raws)), [len(r) for r in raws])[:n]
        inside = np.flatnonzero(np.arange(n) + SPAN <= ends[doc])
        if not len(inside):
            return
        a, d = anchor[inside], doc[inside]
        new = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (d[1:] != d[:-1])]))
        self.place, self.doc, self.first = a[new], d[new], inside[new]
        self.last = inside[np.concatenate([new[1:] - 1, [len(inside) - 1]])]
        self.hash = mixed(h[self.place] ^ _MUL[0])  # the smallest hashes of windows crowd at the low end; mixed once more they spread evenly over the ranges


def _raw(t) -> bytes:
    return (t.as_py() or "").encode("utf-8", "surrogatepass")


def _blocks(texts: pa.Array) -> Iterator[tuple[int, int, list[bytes]]]:
    """Documents of a chunk a few at a time, with the number of the first; a long one in pieces, with the bytes before each.

    Pieces overlap by a window less one byte, so that each window is in one piece.
    """
    held, size, first = [], 0, 0
    for i, t in enumerate(texts):
        raw = _raw(t)
        if len(raw) > BLOCK:
            if held:
                yield first, 0, held
            held, size, first = [], 0, i + 1
            for at in range(0, len(raw), BLOCK):
                yield i, at, [raw[at : at + BLOCK + SPAN - 1]]
            continue
        held.append(raw)
        size += len(raw)
        if size >= BLOCK:
            yield first, 0, held
            held, size, first = [], 0, i + 1
    if held:
        yield first, 0, held


def _anchors(texts: pa.Array) -> list[tuple[int, Anchors]]:
    return [(first, Anchors(raws, skipped)) for first, skipped, raws in _blocks(texts)]


def _counted(blocks: list[tuple[int, Anchors]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct anchor hashes of a chunk and in how many of its documents each is (pieces of a long one count apart)."""
    each = []
    for _, a in blocks:
        if len(a.hash):
            order = np.lexsort((a.doc, a.hash))
            h, d = a.hash[order], a.doc[order]
            each.append(h[np.concatenate([[True], (h[1:] != h[:-1]) | (d[1:] != d[:-1])])])
    return np.unique(np.concatenate([*each, np.empty(0, _U64)]), return_counts=True)


def _send(n_ranges: int):
    edges = runs.range_edges(n_ranges)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                keys, counts = _counted(_anchors(b.column("texts")[i].values))
                cut = runs.cuts(keys, edges)
                filled = np.flatnonzero(np.diff(cut))
                body = [runs.encode(keys[cut[k] : cut[k + 1]]) for k in filled]
                more = [pa.compress(np.minimum(counts[cut[k] : cut[k + 1]], 65535).astype("<u2").tobytes(), "zstd", asbytes=True) for k in filled]
                yield pa.RecordBatch.from_arrays([pa.array(filled, pa.int32()), pa.array([b.column("chunk")[i].as_py()] * len(body), pa.int64()), pa.array(body, pa.binary()), pa.array(more, pa.binary())], names=["piece", "chunk", "body", "more"])

    return run


MARKS = "chunk long, piece int, body binary"


def _shared(hot: int):
    """For each chunk's run a byte a key: 0 if no other document has it, 1 if one has, 2 if it is hot."""

    def run(key: tuple, group: pa.Table) -> pa.Table:
        each = [runs.decode(x.as_py()) for x in group.column("body")]
        own = [np.frombuffer(pa.decompress(x.as_py(), 2 * len(k), "zstd", asbytes=True), dtype="<u2") for x, k in zip(group.column("more"), each, strict=True)]
        _, back = np.unique(np.concatenate(each), return_inverse=True)
        total = np.bincount(back, weights=np.concatenate(own))
        level = (total > 1).astype(np.uint8) + (total > hot)
        out, at = [], 0
        for k in each:
            out.append(pa.compress(level[back[at : at + len(k)]].tobytes(), "zstd", asbytes=True))
            at += len(k)
        return pa.table({"chunk": group.column("chunk"), "piece": pa.array([key[0].as_py()] * len(out), pa.int32()), "body": pa.array(out, pa.binary())})

    return run


def common(a: bytes, b: bytes, known: int) -> int:
    """Length of the common prefix of a and b, of which `known` bytes are known."""
    n = min(len(a), len(b))
    if known >= n:
        return n
    x = int.from_bytes(a[known:n], "big") ^ int.from_bytes(b[known:n], "big")
    return n - (x.bit_length() + 7) // 8


def front_code(suffixes: list[bytes]) -> tuple[np.ndarray, np.ndarray, bytes]:
    """Common prefix with the entry before, length, and the bytes after the prefix, of sorted strings."""
    before, lcp = b"", np.zeros(len(suffixes), dtype=np.uint8)
    rest = []
    for i, s in enumerate(suffixes):
        lcp[i] = common(before, s, 0)
        rest.append(s[lcp[i] :])
        before = s
    return lcp, np.array([len(s) for s in suffixes], dtype=np.uint8), b"".join(rest)


class Run:
    """A front-coded run read entry by entry: the string, and its common prefix with the entry before it."""

    def __init__(self, lcp: list[int], size: list[int], rest: bytes):
        self.lcp, self.size, self.rest, self.i, self.at, self.s = lcp, size, rest, 0, 0, b""

    def next(self) -> tuple[bytes, int] | None:
        if self.i == len(self.lcp):
            return None
        p = self.lcp[self.i]
        end = self.at + self.size[self.i] - p
        self.s = self.s[:p] + self.rest[self.at : end]
        self.at, self.i = end, self.i + 1
        return self.s, p


def loser_tree(players: list[Run]) -> Iterator[tuple[int, int]]:
    """(run, common prefix with the string before) in sorted order; ties in the order of the runs."""
    k = 1
    while k < len(players):
        k *= 2
    strings: list[bytes | None] = [None] * k
    known = [0] * k  # prefix shared with the last winner
    for i, p in enumerate(players):
        if got := p.next():
            strings[i] = got[0]

    def match(a: int, b: int) -> tuple[int, int]:
        """Winner and loser; the loser's known prefix becomes that with the winner."""
        x, y = strings[a], strings[b]
        if x is None:
            return b, a
        if y is None:
            return a, b
        if known[a] != known[b]:
            return (a, b) if known[a] > known[b] else (b, a)
        c = common(x, y, known[a])
        if c == len(x) == len(y):
            a, b = min(a, b), max(a, b)
        elif c == len(y) or (c < len(x) and x[c] > y[c]):
            a, b = b, a
        known[b] = c
        return a, b

    tree = [0] * k
    level = list(range(k))
    at = k
    while len(level) > 1:
        at //= 2
        up = []
        for j in range(0, len(level), 2):
            w, lose = match(level[j], level[j + 1])
            tree[at + j // 2] = lose
            up.append(w)
        level = up
    w = level[0]
    while strings[w] is not None:
        yield w, known[w]
        got = players[w].next()
        strings[w], known[w] = got if got else (None, 0)
        node = (w + k) // 2
        while node:
            w, tree[node] = match(w, tree[node])
            node //= 2


def _pack(suffixes: list[bytes], lefts: list[bytes], low: np.ndarray, doc: np.ndarray) -> bytes:
    """One front-coded run with what goes along: left bytes, least l, document."""
    lcp, size, rest = front_code(suffixes)
    left_size = np.array([len(x) for x in lefts], dtype=np.uint8)
    parts = [lcp.tobytes(), size.tobytes(), left_size.tobytes(), low.astype(np.uint8).tobytes(), np.ascontiguousarray(doc.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes(), rest, b"".join(lefts)]
    whole = b"".join(parts)
    head = np.array([len(suffixes), len(rest), len(whole)], dtype="<u4").tobytes()
    return head + pa.compress(whole, "zstd", asbytes=True)


def _unpack(body: bytes):
    n, rest, size = np.frombuffer(body[:12], dtype="<u4").astype(int)
    whole = pa.decompress(body[12:], int(size), "zstd", asbytes=True)
    col = lambda i: np.frombuffer(whole, dtype=np.uint8, count=n, offset=i * n)
    doc = np.ascontiguousarray(np.frombuffer(whole, dtype=np.uint8, count=4 * n, offset=4 * n).reshape(4, n).T).view("<u4").ravel().astype(np.int64)
    return col(0), col(1), col(2), col(3), doc, whole[8 * n : 8 * n + rest], whole[8 * n + rest :]


class Group:
    """Entries of one chunk for one range, and the anchors they stand for.

    An entry is a distinct (suffix, left) pair; in sorted order each has the document of its first anchor and the least l.
    Of every anchor `where` has document, place, l of its first and last window, number of its entry, and whether an
    earlier document of the chunk has the entry.
    """

    def __init__(self, piece: int, entries: list[tuple[bytes, bytes]], doc: np.ndarray, place: np.ndarray, left: np.ndarray, low: np.ndarray):
        n = len(entries)
        first = dict(zip(reversed(entries), range(n - 1, -1, -1), strict=True))
        self.piece, self.order = piece, sorted(first)
        at = np.fromiter(map(first.__getitem__, self.order), dtype=np.int64, count=len(first))
        self.doc, self.low = doc[at], low[at]
        number = dict(zip(self.order, range(len(first)), strict=True))
        entry = np.fromiter(map(number.__getitem__, entries), dtype=np.int64, count=n)
        by = np.argsort(entry, kind="stable")
        self.where = np.stack([doc, place, left, low, entry, doc > self.doc[entry]])[:, by]


def pack_where(groups: list[tuple[int, int, np.ndarray]]) -> bytes:
    """Anchors of a chunk's groups (range, number of entries, where), small numbers in bytes of their own."""
    head = np.array([(piece, n, w.shape[1]) for piece, n, w in groups], dtype="<u4")
    w = np.concatenate([w for _, _, w in groups], axis=1)
    planes = [np.ascontiguousarray(w[i].astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes() for i in (0, 1, 4)]
    whole = b"".join([head.tobytes(), *planes, *[w[i].astype(np.uint8).tobytes() for i in (2, 3, 5)]])
    return np.array([len(head), w.shape[1], len(whole)], dtype="<u4").tobytes() + pa.compress(whole, "zstd", asbytes=True)


def unpack_where(body: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Rows (range, number of entries, number of anchors) of the groups, and their anchors with entries numbered through all groups."""
    k, n, size = np.frombuffer(body[:12], dtype="<u4").astype(int)
    whole = pa.decompress(body[12:], int(size), "zstd", asbytes=True)
    head = np.frombuffer(whole, dtype="<u4", count=3 * k).reshape(-1, 3).astype(np.int64)
    wide = [np.ascontiguousarray(np.frombuffer(whole, dtype=np.uint8, count=4 * n, offset=12 * k + 4 * n * i).reshape(4, n).T).view("<u4").ravel().astype(np.int64) for i in range(3)]
    small = [np.frombuffer(whole, dtype=np.uint8, count=n, offset=12 * k + 12 * n + n * i).astype(np.int64) for i in range(3)]
    wide[2] += np.repeat(np.cumsum(head[:, 1]) - head[:, 1], head[:, 2])
    return head, np.stack([wide[0], wide[1], small[0], small[1], wide[2], small[2]])


class Entries:
    """The shared anchors of a chunk, handed out range by range, so that only those of one are Python objects at a time."""

    def __init__(self, texts: pa.Array, answers, edges: np.ndarray):
        blocks = _anchors(texts)
        keys = distinct(np.concatenate([*[a.hash for _, a in blocks], np.empty(0, _U64)]))
        cut = runs.cuts(keys, edges)
        level = np.zeros(len(keys), dtype=np.uint8)
        for a in answers or []:
            lo, hi = cut[a["piece"]], cut[a["piece"] + 1]
            level[lo:hi] = np.frombuffer(pa.decompress(a["body"], int(hi - lo), "zstd", asbytes=True), dtype=np.uint8)
        piece_of = np.searchsorted(edges, keys, side="right")
        self.data = [a.data.tobytes() for _, a in blocks]
        cols = []  # range, block, place, first and last start in the block, document, its start
        for k, (first_doc, a) in enumerate(blocks):
            if not len(a.hash):
                continue
            at = np.searchsorted(keys, a.hash)
            for good, hot in ((np.flatnonzero(level[at] == 1), False), (np.flatnonzero(level[at] == 2), True)):
                if not len(good):
                    continue
                n = (a.last[good] - a.first[good] + 1) if hot else np.ones(len(good), dtype=np.int64)
                row = np.repeat(good, n)
                lo = np.repeat(a.first[good] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(len(row)) if hot else a.first[good]
                piece = np.searchsorted(edges, np.array([xxhash.xxh3_64_intdigest(self.data[k][x : x + SPAN]) for x in lo.tolist()], dtype=_U64), side="right") if hot else piece_of[at[good]]
                cols.append(np.stack([piece, np.full(len(row), k), a.place[row], lo, lo if hot else a.last[good], a.doc[row] + first_doc, a.starts[a.doc[row]]]))
        self.cols = np.concatenate([*cols, np.empty((7, 0), dtype=np.int64)], axis=1)
        self.cols = self.cols[:, np.lexsort((self.cols[5], self.cols[0]))]  # by range, there by document

    def groups(self) -> Iterator[Group]:
        edges = np.flatnonzero(np.diff(self.cols[0], prepend=-1, append=-1))
        for a, b in zip(edges, edges[1:], strict=False):
            piece, block, p, lo, hi, doc, start = self.cols[:, a:b]
            cut = zip(map(self.data.__getitem__, block.tolist()), lo.tolist(), p.tolist(), (hi + SPAN).tolist(), strict=True)
            yield Group(int(piece[0]), [(data[x:z], data[w:x]) for data, w, x, z in cut], doc, p - start, p - lo, p - hi)


def _exchange(n_ranges: int):
    """Runs for the ranges; and for the chunk itself, as a piece beyond the ranges, where the anchors of its entries are."""
    edges = runs.range_edges(n_ranges)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                pieces, body, where = [], [], []
                chunk = b.column("chunk")[i].as_py()
                for g in Entries(b.column("texts")[i].values, b.column("answers")[i].as_py(), edges).groups():
                    pieces.append(g.piece)
                    body.append(_pack([e[0] for e in g.order], [e[1] for e in g.order], g.low, g.doc))
                    where.append((g.piece, len(g.order), g.where))
                if where:
                    pieces.append(n_ranges + chunk % n_ranges)
                    body.append(pack_where(where))
                yield pa.RecordBatch.from_arrays([pa.array(pieces, pa.int32()), pa.array([chunk] * len(body), pa.int64()), pa.array(body, pa.binary())], names=["piece", "chunk", "body"])

    return run


def _merged(n_ranges: int):
    def run(key: tuple, group: pa.Table) -> pa.Table:
        """The answers of a range; what chunks sent to themselves goes on as it is."""
        if key[0].as_py() < n_ranges:
            return _merge(key, group)
        return group.select(["chunk", "piece", "body"])

    return run


def _merge(key: tuple, group: pa.Table) -> pa.Table:
    """Suffix array of one range, and for each entry a bit for each l whose window an earlier document has."""
    order = np.argsort(group.column("chunk").to_numpy(), kind="stable").tolist()
    chunks = group.column("chunk").to_pylist()
    parts = [_unpack(group.column("body")[i].as_py()) for i in order]
    sizes = [len(p[0]) for p in parts]
    starts = np.concatenate([[0], np.cumsum(sizes)])
    n = int(starts[-1])
    place = list(starts[:-1])
    array, lcp = np.empty(n, dtype=np.int64), np.empty(n, dtype=np.int64)
    for j, (r, c) in enumerate(loser_tree([Run(p[0].tolist(), p[1].tolist(), p[5]) for p in parts])):
        array[j], lcp[j] = place[r], c
        place[r] += 1
    low = np.concatenate([p[3] for p in parts]).astype(np.int64)[array]
    high = np.concatenate([p[2] for p in parts]).astype(np.int64)[array]
    when = np.concatenate([(np.int64(k) << 32) + p[4] for k, p in enumerate(parts)])[array]  # chunks are in order of documents
    lefts = np.zeros((n, REACH), dtype=np.uint8)  # bytes before the anchor, the nearest first
    for k, p in enumerate(parts):
        width = p[2].astype(np.int64)
        flat = np.frombuffer(p[6], dtype=np.uint8)
        ends = np.cumsum(width)
        for x in range(REACH):
            has = width > x
            lefts[starts[k] : starts[k + 1], x][has] = flat[ends[has] - 1 - x]
    lefts = lefts[array]
    marks = np.zeros(n, dtype=_U64)
    h = np.zeros(n, dtype=_U64)
    for x in range(REACH + 1):
        if x:
            h = mixed(h * _MUL[0] + lefts[:, x - 1].astype(_U64) + _U64(1))
        mine = np.flatnonzero((low <= x) & (x <= high))
        if not len(mine):
            continue
        stretch = np.cumsum(lcp < SPAN - x)[mine].astype(_U64)
        same = mixed(h[mine] ^ (stretch * _MUL[1]))
        by = np.argsort(same)
        s, w = same[by], when[mine][by]
        new = np.concatenate([[True], s[1:] != s[:-1]])
        least = np.minimum.reduceat(w, np.flatnonzero(new))[np.cumsum(new) - 1]
        marks[mine[by[w > least]]] |= _U64(1) << _U64(x)
    out = np.empty(n, dtype=_U64)
    out[array] = marks
    body = [pa.compress(np.ascontiguousarray(out[starts[k] : starts[k + 1]].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :4].T).tobytes(), "zstd", asbytes=True) for k in range(len(parts))]
    return pa.table({"chunk": pa.array([chunks[i] for i in order], pa.int64()), "piece": pa.array([key[0].as_py()] * len(body), pa.int32()), "body": pa.array(body, pa.binary())})


def _gone(found: dict[int, bytes], n_ranges: int) -> np.ndarray:
    """Document, first byte and end of what the marked windows of a chunk cover."""
    own = [piece for piece in found if piece >= n_ranges]
    if not own:
        return np.empty((3, 0), dtype=np.int64)
    head, (doc, place, left, low, entry, later) = unpack_where(found[own[0]])
    each = [np.frombuffer(pa.decompress(found[piece], 4 * n, "zstd", asbytes=True), dtype=np.uint8).reshape(4, -1).T for piece, n, _ in head.tolist()]
    marks = np.ascontiguousarray(np.concatenate(each)).view("<u4").ravel().astype(np.int64)[entry]
    every = (np.int64(1) << (left + 1)) - (np.int64(1) << low)
    whole = (later > 0) | (marks == every)  # all windows of the anchor
    out = [np.stack([doc, place - left, place - low + SPAN])[:, whole]]
    part = np.flatnonzero(~whole & (marks > 0))
    for x in range(REACH + 1):
        some = part[(marks[part] >> x) & 1 > 0]
        out.append(np.stack([doc[some], place[some] - x, place[some] - x + SPAN]))
    return np.concatenate(out, axis=1)


def _cut(n_ranges: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                texts = b.column("texts")[i].values
                gone = _gone({a["piece"]: a["body"] for a in b.column("found")[i].as_py() or []}, n_ranges)
                gone = gone[:, np.argsort(gone[0], kind="stable")]
                cut = np.searchsorted(gone[0], np.arange(len(texts) + 1))
                out = []
                for d, t in enumerate(texts):
                    raw = _raw(t)
                    n, removed, spans, kept = len(raw), 0, 0, raw
                    if cut[d] < cut[d + 1]:
                        _, at, end = gone[:, cut[d] : cut[d + 1]]
                        hit = np.cumsum(np.bincount(at, minlength=n + 1) - np.bincount(end, minlength=n + 1))[:-1] > 0
                        removed, spans = int(hit.sum()), int(np.count_nonzero(np.diff(np.concatenate([[0], hit.astype(np.int8)])) == 1))
                        kept = np.frombuffer(raw, dtype=np.uint8)[~hit].tobytes()
                    out.append((n, removed, spans, hashlib.sha256(kept).hexdigest()))
                cols = list(zip(*out, strict=True)) if out else [()] * 4
                rest = b.column("rest")[i].values
                yield pa.RecordBatch.from_arrays([rest.field("doc_id"), *[pa.array(c, k) for c, k in zip(cols, [pa.int64()] * 3 + [pa.string()], strict=True)]], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return run


def removed_bytes(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row."""
    docs = pick(docs, "doc_id", "text")
    base = scratch(docs.sparkSession)
    table = chunked(docs, ["doc_id"], ["doc_id", "text"], CHUNK_BYTES)
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_ranges = max(1, -(-total // (10 * RANGE_ENTRIES)))  # about one anchor in fourteen bytes
    sent = table.select("chunk", "texts").mapInArrow(_send(n_ranges), "piece int, chunk long, body binary, more binary")
    answers = stored(by_range(sent, n_ranges).applyInArrow(_shared(hot), MARKS), f"{base}/shared")
    runs_of = join_answers(table, answers).select("chunk", "texts", "answers").mapInArrow(_exchange(n_ranges), "piece int, chunk long, body binary")
    found = stored(by_range(runs_of, n_ranges).applyInArrow(_merged(n_ranges), MARKS), f"{base}/found")
    return join_answers(table, found, "found").select("texts", "rest", "found").mapInArrow(_cut(n_ranges), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removed_bytes(documents(spark, sf_dir))
