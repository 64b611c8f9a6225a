"""The corpus pipeline, each stage against a plain version over its own input."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidegrid.llm import decontaminate
from tidegrid.llm.common import scratch, stored

from . import brute
from .test_others import plain_quality


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    here, r = tmp_path_factory.mktemp("tables"), random.Random(9)
    items = [(i, " ".join("".join(r.choices("abcdefgh", k=r.randint(3, 8))) for _ in range(25))) for i in range(5)]
    rows, labels = [], []
    for d, text in brute.corpus(150, seed=8, vocabulary=900):
        bad = d % 6 == 5
        text = " ".join(f"{w}%%% |" for w in text.split()) if bad else text
        if d % 10 == 0:
            text += " " + items[d // 10 % 5][1]
        rows.append((d, text, "en", "s", len(text)))
        if len(text) > 300:
            labels.append((d, int(not bad), 0))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{here}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{here}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{here}/benchmark.parquet")
    return str(here)


def test_stages(spark, tables):
    pytest.importorskip("public_tokenizers")
    base, docs = scratch(spark), spark.read.parquet(f"{tables}/documents.parquet")
    pairs = lambda df: sorted((x["doc_id"], x["text"]) for x in df.collect())
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = pairs(docs), stored(stage(spark, docs, tables), f"{base}/{name}")
        seen[name] = before, docs
        if name != corpus_pipeline.STAGES[-1][0]:
            assert tuple(docs.columns) == corpus_pipeline.COLUMNS
    before, after = seen["quality"]
    assert {d for d, t in pairs(after)} >= {d for d, t in before if d % 6 != 5 and len(t) > 300}
    assert not {d for d, t in pairs(after) if d % 6 == 5 and len(t) > 300}
    before, after = seen["near_duplicates"]
    kept = {c for _, n, c in brute.jaccard(before) if n} | {d for d, n, _ in brute.jaccard(before) if not n}
    assert pairs(after) == [x for x in before if x[0] in kept]
    before, after = seen["substrings"]
    want = {d: n - gone for d, n, gone, _ in brute.substring(before)}
    assert {d: len(t.split()) for d, t in pairs(after)} == {d: n for d, n in want.items() if n}
    assert after.where(F.length("text") != F.col("n_chars")).count() == 0
    before, after = seen["decontamination"]
    items = [x["text"] for x in spark.read.parquet(f"{tables}/benchmark.parquet").collect()]
    assert pairs(after) == [x for x in before if not any(i in x[1] for i in items)]
    before, after = seen["packing"]
    assert after.select("doc_id").distinct().count() == len(before)
    assert after.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 2048").count() == 0


def plain_edits(pattern: str, text: str) -> int:
    """Least edits that turn pattern into a piece of text."""
    t, j = np.array([ord(c) for c in text]), np.arange(len(text) + 1)
    row = np.zeros(len(text) + 1, dtype=int)
    for c in pattern:
        new = np.concatenate([[row[0] + 1], np.minimum(row[:-1] + (t != ord(c)), row[1:] + 1)])
        row = np.minimum.accumulate(new - j) + j
    return int(row.min())


def test_run_equals_a_plain_version_of_the_whole(spark, tables):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    table = lambda n: spark.read.parquet(f"{tables}/{n}.parquet").collect()
    rows = [(r["doc_id"], r["text"]) for r in table("documents")]
    score = plain_quality(rows, [(r["doc_id"], r["quality"]) for r in table("labels")])
    rows = [(d, t) for d, t in rows if score[d] >= 0.7]
    kept = {c for _, n, c in brute.jaccard(rows) if n} | {d for d, n, _ in brute.jaccard(rows) if not n}
    rows = [r for r in rows if r[0] in kept]
    rows = [(d, t) for d, t, had in brute.without_repeats(rows) if t.split() or not had]
    windows = decontaminate.windows([(r["item_id"], r["text"]) for r in table("benchmark")])
    clean = lambda t: not any(plain_edits(w, t) <= decontaminate.budget(len(w)) for _, _, _, w in windows)
    rows = [(d, t) for d, t in rows if clean(decontaminate.fold(t))]
    t = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    want = {d: np.array([*t.encode(x, add_special_tokens=False).ids, 1], dtype="<u4") for d, x in rows}
    out = corpus_pipeline.run(spark, tables).toPandas()
    assert out.groupby("doc_id").length.sum().to_dict() == {d: len(x) for d, x in want.items()} and 20 < len(want) < len(score)
    for d, s, n, crc in out[["doc_id", "start", "length", "ids_crc32"]].itertuples(index=False):
        assert zlib.crc32(want[d][s : s + n].tobytes()) == crc
    for _, g in out.sort_values("offset").groupby("sequence_id"):
        assert g.offset.tolist() == [0, *g.length.cumsum()[:-1]] and g.length.sum() <= 2048


def test_texts_without_words_pass_the_substring_stage(spark):
    words = " ".join(f"w{i}" for i in range(30))
    rows = [(1, None), (2, ""), (3, "   "), (4, "\t\n "), (5, words), (6, words), (7, "short text"), (8, "\u00a0")]
    docs = spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    left = corpus_pipeline.without_repeats(spark, docs, "")
    assert left.columns == docs.columns and sorted((x["doc_id"], x["text"]) for x in left.collect()) == [x for x in rows if x[0] != 6]


def test_run_of_an_empty_table(spark, tables, tmp_path):
    """All five stages in a row, of no documents and of documents without words."""
    pytest.importorskip("public_tokenizers")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{tables}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    docs.limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.count() == 0 and {"doc_id", "start", "length", "sequence_id", "offset"} <= set(out.columns)
