"""Sorted runs of 64-bit keys: coding, slicing into key ranges, and a small log-structured set of runs of verified keys.

Keys are dealt out by range. Each chunk of documents sorts its own keys and sends every range one coded run, so a key
that occurs in very many documents is one entry a chunk, not one a document. An entry of the log is a key and a proof, a
second hash of the same words; two entries are the same only if both agree.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_U64 = np.uint64


def encode(keys: np.ndarray) -> bytes:
    """Sorted distinct keys as differences, bytes of equal weight together, compressed."""
    if not len(keys):
        return b""
    gaps = np.empty_like(keys)
    gaps[0] = keys[0]
    np.subtract(keys[1:], keys[:-1], out=gaps[1:])
    planes = np.ascontiguousarray(gaps.astype("<u8").view(np.uint8).reshape(-1, 8).T)
    return len(keys).to_bytes(4, "little") + pa.compress(planes.tobytes(), "zstd", asbytes=True)


def decode(run: bytes) -> np.ndarray:
    if not run:
        return np.empty(0, dtype=_U64)
    n = int.from_bytes(run[:4], "little")
    planes = np.frombuffer(pa.decompress(run[4:], 8 * n, "zstd", asbytes=True), dtype=np.uint8).reshape(8, n)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u8").ravel().astype(_U64), dtype=_U64)


def range_edges(n_ranges: int) -> np.ndarray:
    """Lower edges of equal ranges of the key space, without the first."""
    width = (1 << 64) // n_ranges
    return np.array([i * width for i in range(1, n_ranges)], dtype=_U64)


def cuts(keys: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Where sorted keys are cut into the ranges."""
    return np.concatenate([[0], np.searchsorted(keys, edges, side="left"), [len(keys)]])


def member(keys: np.ndarray, run: np.ndarray) -> np.ndarray:
    """Which sorted keys are in a sorted run (a merge join: both advance together)."""
    if not len(run):
        return np.zeros(len(keys), dtype=bool)
    at = np.searchsorted(run, keys)
    at[at == len(run)] = len(run) - 1
    return run[at] == keys


Run = tuple[np.ndarray, np.ndarray]
EMPTY: Run = (np.empty(0, dtype=_U64), np.empty(0, dtype=_U64))


def verified(entries: Run, run: Run) -> np.ndarray:
    """Which entries (keys, proofs) are in a run sorted by key and proof: keys are merge-joined, proofs of equal keys compared."""
    (keys, proofs), (rk, rp) = entries, run
    at = np.searchsorted(rk, keys)
    left, out = np.flatnonzero(at < len(rk)), np.zeros(len(keys), dtype=bool)
    at = at[left]
    while len(left):  # once more for each further proof that a key of the run has
        same = rk[at] == keys[left]
        left, at = left[same], at[same]
        equal = rp[at] == proofs[left]
        out[left[equal]] = True
        left, at = left[~equal], at[~equal] + 1
        left, at = left[at < len(rk)], at[at < len(rk)]
    return out


def ordered(keys: np.ndarray, proofs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by key and proof, and which entries in that order differ from the one before."""
    order = np.lexsort((proofs, keys))
    k, p = keys[order], proofs[order]
    return order, np.concatenate([[True], (k[1:] != k[:-1]) | (p[1:] != p[:-1])]) if len(k) else np.empty(0, dtype=bool)


def merged(a: Run, b: Run) -> Run:
    keys, proofs = np.concatenate([a[0], b[0]]), np.concatenate([a[1], b[1]])
    order, new = ordered(keys, proofs)
    return keys[order][new], proofs[order][new]


class Log:
    """Immutable sorted runs, each at least twice as long as the next; adding one compacts those it makes too close."""

    def __init__(self):
        self.runs: list[Run] = []

    def seen(self, entries: Run) -> np.ndarray:
        out = np.zeros(len(entries[0]), dtype=bool)
        for r in self.runs:
            out |= verified(entries, r)
        return out

    def add(self, run: Run) -> None:
        if not len(run[0]):
            return
        self.runs.append(run)
        while len(self.runs) > 1 and len(self.runs[-2][0]) < 2 * len(self.runs[-1][0]):
            b, a = self.runs.pop(), self.runs.pop()
            self.runs.append(merged(a, b))

    def compacted(self) -> Run:
        out = EMPTY
        for r in reversed(self.runs):
            out = merged(out, r)
        return out


def bits(flags: np.ndarray) -> bytes:
    return np.packbits(flags).tobytes()


def flags(packed: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(packed, dtype=np.uint8), count=n).astype(bool)
