"""Substring, suffix and Jaccard operators against plain versions."""

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidegrid.sources.folders import Conflict
from tidegrid.llm import chunks, jaccard, runs, substring, suffix
from tidegrid.llm.components import components

from . import brute


def frame(spark, rows, extra=False):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    return df.withColumns({"chunk": F.lit("x"), "node": F.lit(1), "answers": F.lit(2.0), "label": F.lit(None).cast("string")}) if extra else df


@pytest.fixture
def small_chunks(monkeypatch):
    monkeypatch.setattr(chunks, "PARTITION_BYTES", 20_000)
    for module in (substring, jaccard, suffix):
        monkeypatch.setattr(module, "RANGE_ENTRIES", 2000)


ROWS = brute.corpus() + brute.ODD


def same(df, want):
    assert sorted(map(tuple, df.collect()), key=str) == sorted(want, key=str)


def test_substring(spark, small_chunks):
    same(substring.removed_words(frame(spark, ROWS, extra=True)), brute.substring(ROWS))


def test_substring_returns_texts_and_leaves_others_alone(spark, small_chunks):
    df = frame(spark, ROWS, extra=True)
    out = substring.without_repeats(df)
    assert out.columns == df.columns and out.count() == len(ROWS)
    want = {(d, n - gone) for d, n, gone, _ in brute.substring(ROWS)}
    assert {(r["doc_id"], len((r["text"] or "").split())) for r in out.collect()} == want
    assert out.where("text IS NULL").count() == 1 and out.where("text = ' \n\t '").count() == 1


def test_index_in_two_batches_equals_one(spark, small_chunks, tmp_path):
    first, second = ROWS[:70], [r for r in ROWS[70:] if r[0] < 900]
    index = substring.Index(spark, f"file://{tmp_path}/ix")
    a = substring.removed_words(frame(spark, first), index=index).collect()
    index.commit()
    b = substring.removed_words(frame(spark, second), index=substring.Index(spark, f"file://{tmp_path}/ix")).collect()
    assert sorted(map(tuple, a + b)) == sorted(brute.substring(first + second))


def test_index_after_lost_repeated_and_concurrent_calls(spark, small_chunks, tmp_path):
    """Only committed batches are history; the loser of a race calls again and gets what follows from the winner's batch."""
    folder = f"file://{tmp_path}/ix"
    rows = [r for r in ROWS if r[0] < 900]
    first, second, third = rows[:50], rows[50:90], rows[90:]
    plan = lambda part, index: sorted(map(tuple, substring.removed_words(frame(spark, part), index=index).collect()))
    lost = substring.Index(spark, folder)
    substring.removed_words(frame(spark, first), index=lost)  # planned, its rows never written, never committed
    index = substring.Index(spark, folder)
    assert index.runs == [] and plan(first, index) == plan(first, index) == sorted(brute.substring(first))  # called again before the commit
    index.commit("first")
    assert substring.Index(spark, folder).known("first") and not substring.Index(spark, folder).known("second")
    with pytest.raises(Conflict):
        lost.commit()
    with pytest.raises(RuntimeError):
        index.commit()
    one, two = substring.Index(spark, folder), substring.Index(spark, folder)
    got = plan(second, one)
    plan(third, two)
    one.commit("second")
    with pytest.raises(Conflict):
        two.commit("third")
    again = substring.Index(spark, folder)
    got += plan(first, index := substring.Index(spark, folder)) and []  # a look without a commit changes nothing
    got += plan(third, again)
    again.commit("third")
    assert sorted(got) == sorted(set(brute.substring(rows)) - set(brute.substring(first)))
    assert substring.Index(spark, folder).batches == ["first", "second", "third"]


def test_suffix(spark, small_chunks):
    same(suffix.removed_bytes(frame(spark, ROWS, extra=True)), brute.suffix(ROWS))


def test_suffix_windows_of_hot_anchors_are_dealt_out(spark, small_chunks):
    """A common header between varied neighbours; with hot=3 most shared anchors go window by window."""
    header = "This header stands in every document, word for word, and is longer than a window. "
    rows = [(i, f"{i * 7919} before it {i}" + header + f"after {i % 5} it {i * 104729} " * 3) for i in range(60)]
    same(suffix.removed_bytes(frame(spark, rows), hot=3), brute.suffix(rows))
    same(suffix.removed_bytes(frame(spark, ROWS), hot=3), brute.suffix(ROWS))


def test_suffix_long_texts_in_overlapping_pieces(monkeypatch):
    """Pieces stand for the same windows with the same anchors as the whole text."""
    text = " ".join(t or "" for _, t in ROWS)

    def windows():
        return sorted((doc + int(a.doc[j]), s - int(a.starts[a.doc[j]]), int(a.place[j] - a.starts[a.doc[j]])) for doc, a in suffix._anchors(pa.array(["x" * 80, text, None, text[:900]])) for j in range(len(a.doc)) for s in range(int(a.first[j]), int(a.last[j]) + 1))

    whole = windows()
    monkeypatch.setattr(suffix, "BLOCK", 700)
    assert windows() == whole and len(whole) == 31 + len(text.encode()) - 49 + len(text[:900].encode()) - 49


def test_suffix_same_document_keeps_its_own_repeats(spark):
    t = "abcdefghij" * 30
    same(suffix.removed_bytes(frame(spark, [(1, t), (2, "x" + t[:60])])), brute.suffix([(1, t), (2, "x" + t[:60])]))


def test_jaccard(spark, small_chunks):
    rows = [r for r in ROWS if r[0] != 904]
    same(jaccard.grouped(frame(spark, rows, extra=True)), brute.jaccard(rows))


def test_jaccard_small_sets_and_repeated_rows(spark):
    r = np.random.default_rng(0)
    base = [f"w{i}" for i in range(9)]
    rows = [(i, " ".join(base[: int(r.integers(0, 10))] + (["z"] if i % 3 == 0 else []))) for i in range(60)]
    same(jaccard.grouped(frame(spark, rows)), brute.jaccard(rows))
    same(jaccard.grouped(frame(spark, [(5, "a b c d e f"), (5, "a b c d e f"), (None, None)])), [(5, 2, 5), (5, 2, 5), (None, 0, None)])


@pytest.mark.parametrize("light", [0, 7, 11])
def test_sets_of_like_sizes_at_the_threshold(spark, light, monkeypatch):
    """Every split into light and heavy gives the same links; sets of six that share five are none, those with a set of five are."""
    r = np.random.default_rng(3)
    monkeypatch.setattr(jaccard, "boundary", lambda mean: light)
    texts = set()
    for _ in range(260):
        n = int(r.integers(5, 14))
        at = int(r.integers(0, 3))
        w = [f"v{i}" for i in range(at, at + n)]
        if r.random() < 0.5:
            w[int(r.integers(0, n))] = f"u{int(r.integers(0, 4))}"
        if r.random() < 0.5:
            w.append(f"t{int(r.integers(0, 9))}")
        texts.add(" ".join(w))
    rows = list(enumerate(sorted(texts)))
    same(jaccard.grouped(frame(spark, rows)), brute.jaccard(rows))


def test_many_near_copies(spark):
    import random

    r = random.Random(4)
    base = [f"b{i}" for i in range(120)]
    rows = [(i, " ".join(f"e{r.random()}" if r.random() < r.choice([0.005, 0.02, 0.04]) else w for w in base)) for i in range(150)]
    same(jaccard.grouped(frame(spark, rows)), brute.jaccard(rows))


def test_one_of_each(spark, small_chunks):
    rows = [r for r in ROWS if r[0] != 904] + [(904, "one two"), (904, "one two")]
    df = frame(spark, rows, extra=True)
    out = jaccard.one_of_each(df)
    assert out.columns == df.columns
    want = sorted({c for _, n, c in brute.jaccard(rows) if n} | {d for d, n, _ in brute.jaccard(rows) if not n})
    assert sorted(r["doc_id"] for r in out.collect()) == want


@pytest.mark.parametrize("operator", [substring.removed_words, suffix.removed_bytes, jaccard.grouped, substring.without_repeats, jaccard.one_of_each])
def test_empty_table(spark, operator):
    assert operator(frame(spark, [])).count() == 0


def test_boundary_follows_the_cost():
    assert 0 < jaccard.boundary(1.0) <= jaccard.boundary(3.0) <= jaccard.boundary(50.0) < jaccard.boundary(1e5)
    for mean in (1.0, 2.5, 40.0, 1e4):  # no larger size is cheaper
        best = jaccard.boundary(mean)
        assert all(jaccard.subset_rows(n, n) > jaccard.prefix(n) * (1 + jaccard.CANDIDATE_COST * (mean - 1)) for n in range(best + 1, 60))
    for n in range(1, 60):
        for m in jaccard.partners(n):
            o = jaccard.least_shared(n, m)
            assert 100 * o >= 75 * (n + m - o) and 100 * (o - 1) < 75 * (n + m - o + 1)
            assert n - o < jaccard.prefix(n)


@given(st.lists(st.lists(st.binary(max_size=12), max_size=12), min_size=1, max_size=6))
@settings(max_examples=100, deadline=None)
def test_loser_tree_merges_and_knows_its_prefixes(lists):
    lists = [sorted(x) for x in lists]
    coded = [suffix.front_code(x) for x in lists]
    got = list(suffix.loser_tree([suffix.Run(c[0].tolist(), c[1].tolist(), c[2]) for c in coded]))
    want = sorted((s, k) for k, x in enumerate(lists) for s in x)
    assert [g[0] for g in got] == [k for _, k in want]
    for i in range(1, len(want)):
        assert got[i][1] == suffix.common(want[i - 1][0], want[i][0], 0)


@given(st.lists(st.integers(0, 2**64 - 1), max_size=50, unique=True), st.integers(1, 9))
@settings(max_examples=100, deadline=None)
def test_runs_round_trip(keys, n):
    k = np.array(sorted(keys), dtype=np.uint64)
    cut = runs.cuts(k, runs.range_edges(n))
    assert np.array_equal(np.concatenate([runs.decode(runs.encode(k[a:b])) for a, b in zip(cut, cut[1:], strict=False)]), k)


def test_log_compacts_and_finds():
    log, seen = runs.Log(), set()
    r = np.random.default_rng(2)
    for _ in range(40):
        pairs = sorted(set(zip(r.integers(0, 800, 60).tolist(), r.integers(0, 4, 60).tolist(), strict=True)))  # keys with several proofs
        e = tuple(np.array(c, dtype=np.uint64) for c in zip(*pairs, strict=True))
        assert log.seen(e).tolist() == [x in seen for x in pairs]
        log.add(e)
        seen |= set(pairs)
        assert all(len(a[0]) >= 2 * len(b[0]) for a, b in zip(log.runs, log.runs[1:], strict=False))
    assert list(zip(*(c.tolist() for c in log.compacted()), strict=True)) == sorted(seen)


def test_windows_of_equal_keys_but_other_words_stay(spark, small_chunks, monkeypatch):
    """A key of two bits makes nearly all windows collide; proofs tell them apart."""
    rows = ROWS[:60]
    texts = pa.array([t for _, t in rows])

    class Coarse(substring.Windows):
        def __init__(self, texts, width):
            super().__init__(texts, width)
            self.keys = self.keys >> np.uint64(62)

    monkeypatch.setattr(substring, "Windows", Coarse)
    own = substring.Chunk(texts, None, runs.range_edges(1), 20, True)
    want, seen = [], set()
    for _, t in rows:
        w = (t or "").encode().split()
        for i in range(len(w) - 19):
            want.append(tuple(w[i : i + 20]) in seen)
            seen.add(tuple(w[i : i + 20]))
    assert own.marked(None).tolist() == want


def test_index_that_begins_small_is_dealt_anew(spark, small_chunks, tmp_path):
    """Many batches, the first of a few words; runs stay apart by size, ranges follow the history, and a lost call leaves it alone."""
    folder = f"file://{tmp_path}/ix"
    rows = [r for r in ROWS if r[0] < 900]
    parts = [rows[:1], rows[1:40], rows[40:44], rows[44:46], rows[46:]]
    got = []
    for i, part in enumerate(parts):
        lost = substring.Index(spark, folder)
        lost.prepare(spark.createDataFrame([], "piece int, body binary, proofs binary, n long"), 1, 0)  # a call that was lost before it was done
        index = substring.Index(spark, folder)
        got += substring.removed_words(frame(spark, part), index=index).collect()
        index.commit()
        assert index.base == i and all(b[2] >= 2 * a[2] for a, b in zip(index.runs, index.runs[1:], strict=False))
        lost.pending = None
    assert sorted(map(tuple, got)) == sorted(brute.substring(rows))
    assert index.runs[-1][1] > 1 and {r[0] for r in index.runs} <= {f.name for f in (tmp_path / "ix/runs").iterdir()}


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7)]
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and all(got[100 + i] == 100 for i in range(30))
