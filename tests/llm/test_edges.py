"""Every corpus operator and pipeline stage on long and hostile texts, empty tables, clashing columns, missing values and repeated rows."""

import hashlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidegrid.llm import decontaminate, jaccard, language, license, media, packing, quality, substring, suffix, url_filter

from . import brute

WORDS = " ".join(f"w{i}x{i % 7}" for i in range(60_000))
LONG = [
    (1, WORDS), (2, "x" * 1_000_000), (3, " " * 1_000_000 + "end"), (4, "a b " * 100_000), (5, "\n" * 200_000), (6, "é" * 300_000), (7, WORDS + " tail"), (8, None), (9, ""), (9, ""), (10, "short"), (None, "short"),
]
CLASHES = ("chunk", "texts", "rest", "answers", "found", "node", "label", "score", "class", "rank", "item_id", "kind", "host", "guess", "license", "path", "x", "y", "a.b", "doc id")


def frame(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    return df.withColumns({c: F.lit(f"own {c}") for c in CLASHES if "." not in c}).select("*", F.lit(1.5).alias("a.b")).withColumns({"lang": F.lit("en"), "source": F.lit("s"), "n_chars": F.length("text").cast("bigint")})


def labels(spark):
    return spark.createDataFrame([(i, i % 2, 0) for i in range(1, 11)], "doc_id long, quality int, toxic int")


def bench(spark):
    return spark.createDataFrame([(1, "a b " * 40), (2, None), (3, "x" * 300), (4, "")], "item_id long, text string").withColumn("doc_id", F.lit("clash"))


OPERATORS = {
    "op2": lambda spark, d: quality.scored(d, labels(spark)),
    "op3": lambda spark, d: substring.removed_words(d),
    "op4": lambda spark, d: suffix.removed_bytes(d),
    "op5": lambda spark, d: media.media_columns(d, media.scratch(spark)),
    "op6": lambda spark, d: language.identify(d),
    "op9": lambda spark, d: license.scan(d.select("*", F.col("doc_id").alias("fid"))),
    "op10": lambda spark, d: jaccard.grouped(d),
}
STAGES = dict(corpus_pipeline.STAGES[:-1])


@pytest.mark.parametrize("name", OPERATORS)
def test_a_row_for_each_row(spark, name):
    out = OPERATORS[name](spark, frame(spark, LONG))
    key = "fid" if name == "op9" else "doc_id"
    got = [r.asDict() for r in out.collect()]
    assert sorted((str(r[key]) for r in got)) == sorted(str(d) for d, _ in LONG)
    assert OPERATORS[name](spark, frame(spark, LONG).limit(0)).count() == 0
    if name == "op3":
        assert sorted((r["doc_id"] or 0, r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got) == sorted((d or 0, *x) for d, *x in brute.substring(LONG))
    if name == "op4":
        assert {r["doc_id"]: r["n_removed"] for r in got if r["doc_id"] in (1, 3, 7)} == {1: 0, 3: 0, 7: len(WORDS)}
        assert all(r["kept_sha256"] == hashlib.sha256(b"").hexdigest() for r in got if r["doc_id"] in (8, 9))
    if name == "op10":
        n = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got}
        assert n[7][1] == 1 and n[4] == (2, 4) and n[2] == (1, 2) and n[8] == (0, 8) and n[10][0] == n[None][0] == 1
    if name == "op5":
        assert {r["payload_bytes"] for r in got if r["doc_id"] in (8, 9)} == {192}
        assert all(r["feature"].startswith("png:64x") and r["tail_crc32"] >= 0 for r in got)
    if name == "op6":
        assert {r["language"] for r in got} == {"en"}


def test_long_texts_are_packed_whole_and_read_for_benchmarks(spark):
    pytest.importorskip("public_tokenizers")
    p = packing.packed(frame(spark, LONG)).toPandas()
    per = p.groupby("doc_id", dropna=False).agg(n=("length", "sum"), t=("doc_tokens", "first"))
    e = packing.encoder()
    assert int(per.loc[1.0, "n"]) == len(e.ids(WORDS)) // 4 + 1 and p.groupby("sequence_id").length.sum().max() <= 2048
    found = decontaminate.contaminated(frame(spark, LONG), bench(spark)).collect()
    assert {(r["doc_id"], r["item_id"]) for r in found} == {(4, 1), (2, 3)}
    assert decontaminate.contaminated(frame(spark, LONG), bench(spark).limit(0)).count() == 0


@pytest.mark.parametrize("name", STAGES)
def test_stages_keep_rows_as_they_are(spark, name, tmp_path):
    labels(spark).write.parquet(f"{tmp_path}/labels.parquet")
    bench(spark).write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = frame(spark, LONG)
    out = STAGES[name](spark, docs, str(tmp_path))
    assert out.columns == docs.columns and STAGES[name](spark, docs.limit(0), str(tmp_path)).count() == 0
    rows = out.collect()
    assert all(r["chunk"] == "own chunk" and r["a.b"] == 1.5 and r["doc id"] == "own doc id" for r in rows)
    if name == "near_duplicates":
        assert sorted(str(r["doc_id"]) for r in rows) == sorted(["1", "2", "3", "4", "5", "6", "8", "9", "9", "None"])
    if name == "substrings":
        assert {r["doc_id"]: r["text"] for r in rows}[1] == WORDS and len(rows) == len(LONG)
    if name == "decontamination":
        assert sorted(str(r["doc_id"]) for r in rows) == sorted(str(d) for d, _ in LONG if d not in (2, 4))


def test_long_urls_and_many_rules(spark):
    pages = spark.createDataFrame([(1, "http://" + "a." * 100_000 + "com/en/" + "x" * 500_000), (2, "http://h.com/" + "p/" * 2000), (3, None), (3, None)], "page_id long, url string").withColumns({"host": F.lit("clash"), "rule": F.lit(1)})
    rules = [("block", "h.com", "/" + "p/" * i) for i in range(0, 3000, 3)] + list(url_filter.RULES)
    got = sorted((r["page_id"], r["rule"] and len(r["rule"]), r["verdict"]) for r in url_filter.judge(pages, rules).collect())
    assert got == [(1, len("com/en/"), "block"), (2, len("h.com/") + 2 * 1998, "block"), (3, None, "allow"), (3, None, "allow")]
