"""Merkle manifest, SimHash and fill-in-middle against plain versions, on small, odd and hostile tables."""

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tidegrid.llm import fim, merkle, simhash

from . import brute
from .test_edges import LONG, frame

CLASH = ("g", "idx", "n", "run", "slot", "digest", "steps", "root", "left", "print", "tile", "low", "label", "form", "h1", "part", "at")


def rows_of(spark, rows):
    """(doc_id, source, lang, n_chars, text) with columns of the operators' own names beside them."""
    return spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").withColumns({c: F.lit("own") for c in CLASH}).repartition(3)


# ------------------------------------------------------------------ Merkle
def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def plain_leaf(r):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in r))


def plain_tree(leaves, fan):
    """The top, and for each leaf its siblings on each level as (left, right) lists."""
    nodes, above, steps = list(leaves), list(range(len(leaves))), [[] for _ in leaves]
    while len(nodes) > 1:
        runs = [nodes[i : i + fan] for i in range(0, len(nodes), fan)]
        for k, at in enumerate(above):
            run, slot = runs[at // fan], at % fan
            steps[k].append((run[:slot], run[slot + 1 :]))
            above[k] = at // fan
        nodes = [sha("".join(r)) for r in runs]
    return nodes[0], steps


def plain_manifest(rows, fan=8):
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    langs = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees, out = {}, []
    for g in langs:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, plain_leaf(r)))
        trees[g] = plain_tree([plain_leaf(r) for r in groups[g]], fan)
    root, ups = plain_tree([trees[g][0] for g in langs], fan) if langs else (None, [])
    for g, up in zip(langs, ups, strict=True):
        for r, steps in zip(groups[g], trees[g][1], strict=True):
            path = steps + up
            low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r[4] or "")
            shown = (*r[:4], low) if r[4] is not None and r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 else r
            h = plain_leaf(shown)
            for left, right in path:
                h = sha("".join(left) + h + "".join(right))
            out.append((r[0], plain_leaf(r), trees[g][0], root, sha("".join("".join(a) + "".join(b) for a, b in path)), h, h == root))
    return sorted(out, key=str)


def table_of(spark, tmp_path, df):
    df.write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


@pytest.mark.parametrize("seed", range(2))
def test_merkle_against_a_plain_tree(spark, tmp_path, seed):
    r = random.Random(seed)
    sizes = {None: 1, "": 3, "en": 600, "de": 8, "fr": 9, "z": 65, "é": 64, **{f"l{i}": 1 + i % 2 for i in range(12 if seed else 0)}}
    ids = itertools.count(-5)
    rows = [(next(ids) * (1 if r.random() < 0.5 else 7), r.choice(["s", "hot", None, "é"]), g, r.choice([None, 0, 12]), r.choice([None, "", "Text A", "low", "ÄÖ Z"])) for g, n in sizes.items() for _ in range(n)]
    rows += [(None, "s", "en", 1, "A"), (None, None, "en", None, None)] + [(77, "s", "en", 1, "Same")] * 5 + [(77, "s", "en", 1, "other")]
    r.shuffle(rows)
    got = [tuple(x) for x in merkle.op11_merkle_manifest(spark, table_of(spark, tmp_path, rows_of(spark, rows))).collect()]
    assert sorted(got, key=str) == plain_manifest(rows)


@pytest.mark.parametrize("n", [0, 1, 2, 8, 9])
def test_merkle_of_few_rows(spark, tmp_path, n):
    rows = [(i, "s", "en", i, f"T{i}") for i in range(n)]
    got = [tuple(x) for x in merkle.op11_merkle_manifest(spark, table_of(spark, tmp_path, rows_of(spark, rows))).collect()]
    assert sorted(got, key=str) == (plain_manifest(rows) if n else [])


def test_merkle_with_another_fan(spark):
    rows = [(i, None, "x" if i % 5 else "y", 1, str(i)) for i in range(70)]
    p = merkle.proofs(rows_of(spark, rows), {"leaf": merkle.leaf([F.col(c) for c in merkle.FIELDS])}, F.col("lang"), fan=3)
    got = sorted((x["doc_id"], x["leaf"], x["subroot"], x["root"]) for x in p.collect())
    assert got == sorted(x[:4] for x in plain_manifest(rows, 3))


def test_one_changed_byte_shows(spark, tmp_path):
    rows = [(i, "s", "en", 1, "small" if i != 40 else "Large") for i in range(200)]
    got = {x["doc_id"]: x["verified"] for x in merkle.op11_merkle_manifest(spark, table_of(spark, tmp_path, rows_of(spark, rows))).collect()}
    assert {d for d, ok in got.items() if not ok} == ({40} if zlib.crc32(b"40") % 3 == 0 else set())


# ------------------------------------------------------------------ SimHash
def plain_print(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    hs = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 4]), 42) for i in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def plain_groups(rows, radius=4):
    prints = [plain_print(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in itertools.combinations(range(len(rows)), 2):
        if (prints[i] ^ prints[j]).bit_count() <= radius:
            root[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        at = find(i)
        low[at] = d if low.get(at) is None else low[at] if d is None else min(low[at], d)
    return sorted(((d, f"{p:016x}", low[find(i)]) for i, ((d, _), p) in enumerate(zip(rows, prints, strict=True))), key=str)


def documents_of(spark, tmp_path, rows):
    return table_of(spark, tmp_path, rows_of(spark, [(d, "s", "en", 1, t) for d, t in rows]))


def test_simhash_against_all_pairs(spark, tmp_path):
    rows = brute.corpus(260, seed=3) + brute.ODD + [(None, "one two"), (None, "alone here with nobody else at all")]
    rows += [(2000 + i, " ".join(f"c{k}" for k in range(300)) + f" tail{i % 40}") for i in range(80)]
    got = [tuple(x) for x in simhash.op12_simhash(spark, documents_of(spark, tmp_path, rows)).collect()]
    want = plain_groups(rows)
    assert sorted(got, key=str) == want
    assert len({x[2] for x in want}) < len(want) - 60  # there is something to find


@pytest.mark.parametrize(("tile", "small"), [(8, 3), (64, 16), (1 << 15, 256)])
def test_tiles_of_any_size_find_every_pair(spark, tile, small):
    """Random fingerprints around a few centres, the edges of the radius among them."""
    r = np.random.default_rng(5)
    flip = lambda x, k: x ^ sum(1 << int(b) for b in r.choice(64, k, replace=False))
    centres = [int(x) for x in r.integers(0, 1 << 63, 30)] + [0, (1 << 64) - 1]
    prints = sorted({*centres, *(flip(c, k) for c in centres for k in (1, 3, 4, 5, 6, 9))})
    df = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p,) for p in prints], "print long").repartition(3)
    root = {p: p for p in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in simhash.links(df, 4, tile, small).collect():
        root[find(a % (1 << 64))] = find(b % (1 << 64))
    got = {frozenset(g) for g in (tuple(p for p in prints if find(p) == top) for top in {find(p) for p in prints})}
    want = {p: {p} for p in prints}
    for a, b in itertools.combinations(prints, 2):
        if (a ^ b).bit_count() <= 4 and want[a] is not want[b]:
            want[a] |= want[b]
            for x in want[b]:
                want[x] = want[a]
    assert got == {frozenset(g) for g in want.values()}


def test_links_of_a_large_group_do_not_grow_with_its_square(spark):
    base = 0x0123456789ABCDEF
    near = sorted({base ^ (1 << i) ^ (1 << j) for i in range(63) for j in range(63)})
    df = spark.createDataFrame([(p,) for p in near], "print long")
    assert simhash.links(df, 4, 256, 32).count() < 20 * len(near)


def test_bounds_never_exceed_distances():
    r = np.random.default_rng(1)
    a, b = (r.integers(0, 1 << 63, 200).astype(np.uint64) for _ in range(2))
    low = simhash.apart(simhash.box(simhash.counts(a), 1), simhash.box(simhash.counts(b), 1))
    assert (low <= np.bitwise_count(a[:, None] ^ b[None])).all()


def test_simhash_of_long_texts_and_no_rows(spark):
    got = {r["doc_id"]: r for r in simhash.grouped(frame(spark, LONG)).collect()}
    assert all(r["print"] % (1 << 64) == plain_print(t) for (d, t), r in zip(LONG, (got[d] for d, _ in LONG), strict=True) if d != 9)
    assert got[8]["component_id"] == got[9]["component_id"] == 5 and got[7]["component_id"] == 1
    assert simhash.grouped(frame(spark, LONG).limit(0)).count() == 0


# ------------------------------------------------------------------ fill-in-middle
def plain_fim(d, text, rate=100, spm=50):
    text = text or ""
    ls = re.findall(r"[^\n]*\n|[^\n]+", text)
    h = sha(f"7:{'' if d is None else d}")
    h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    n = len(ls)
    a, z = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(ls[:a]), "".join(ls[a:z]), "".join(ls[z:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return d, n, "plain", None, None, sha(text), sha(text)
    form = "spm" if h4 % 100 < spm else "psm"
    out = f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"
    return d, n, form, len(p), len(m), sha(out), sha(text)


def test_fim_against_a_plain_version(spark, tmp_path):
    r = random.Random(2)
    bits = ["a", "é", "𝄞", "\n", "\n\n", "\r\n", "<", "P>", "<<S", "S>", "<M>", " ", " ", "\x0b", "def f():\n"]
    rows = [(i, "".join(r.choices(bits, weights=[5, 5, 5, 9, 2, 2, 1, 1, 1, 1, 0.1, 3, 1, 1, 5], k=r.randint(0, 40)))) for i in range(500)]
    rows += [(600, None), (601, ""), (602, "\n"), (603, "no newline"), (None, "a\nb\nc"), (604, "tie\n"), (604, "tie\n"), (604, "other\nlines\n")]
    got = [tuple(x) for x in fim.op13_fill_in_middle(spark, documents_of(spark, tmp_path, rows)).collect()]
    assert sorted(got, key=str) == sorted((plain_fim(d, t) for d, t in rows), key=str)
    assert {x[2] for x in got} == {"plain", "psm", "spm"}


def test_fim_of_long_texts_rates_and_no_rows(spark):
    t = fim.transformed(frame(spark, LONG))
    got = sorted(((r["doc_id"], r["n"], r["form"], sha(r["output"]), sha(r["back"])) for r in t.withColumn("back", fim.restored("output", "form")).collect()), key=str)
    assert got == sorted(((x[0], x[1], x[2], x[5], x[6]) for x in (plain_fim(d, t) for d, t in LONG)), key=str)
    assert fim.transformed(frame(spark, LONG).limit(0)).count() == 0
    rows = [(i, f"one {i}\ntwo\nthree") for i in range(300)]
    some = fim.transformed(rows_of(spark, [(d, "s", "en", 1, t) for d, t in rows]), rate=40, spm_rate=10).collect()
    assert sorted((r["doc_id"], r["form"], sha(r["output"])) for r in some) == sorted((x[0], x[2], x[5]) for x in (plain_fim(d, t, 40, 10) for d, t in rows))
