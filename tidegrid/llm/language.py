"""Language ID by Bayesian fusion of evidence.

The posterior of a language is the product of four terms, added as logarithms:
- text: a naive Bayes likelihood of the byte pairs of the whole visible text, tempered so that long texts stay arguable;
- markup: how likely the declared `lang` is under each language, from a smoothed table of declared against guessed;
- address suffix: the same for the last label of the host;
- host: the host's own share of languages, smoothed towards its suffix's, which is smoothed towards that of all pages.
The last three come from grouped sums over all rows; a row's own count is taken out of its host's before it is used, so
no row confirms itself.

Pages take all four. Documents have no markup and no address: text and the prior of their source (as host) remain.
Byte-pair tables are fitted on at most `TRAIN_DOCS` documents whose language is given and that are not held out
(crc32(doc_id) mod 4 = 2); a document's given language is never an input of its own result.

Null or empty text gives equal likelihoods, so the other evidence decides; without any the most frequent language. A
tie goes to the language that is first in the alphabet. Repeated rows each get their row. Pages of any length and with
any number of unclosed tags are read in one walk. Without any document of known language the only language is `und`; an
empty table gives no rows; columns beside those named here are not looked at, whatever they are called.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import byte_batches, documents, pick, sampled, scratch, stored

TRAIN_DOCS = 4000
TEMPER = 40.0
SMOOTH = 8.0

_CLOSES = {name: re.compile(rf"</{name}\s*>", re.I) for name in ("script", "style")}
_OPENS = re.compile(r"<(script|style)\b", re.I)
_ROOT = re.compile(r"<html\b", re.I)
_DECLARED = re.compile(r"\blang\s*=\s*[\"']?([A-Za-z]{2,3})", re.I)


def visible(page: str) -> str:
    """Text of a page without tags, comments, scripts and styles, in one walk: an end that was not found once is not looked for again."""
    out, at, closed = [], 0, {"-->": True, "script": True, "style": True}
    while (lt := page.find("<", at)) >= 0:
        out.append(page[at:lt])
        end = -1
        if page.startswith("<!--", lt):
            if closed["-->"]:
                end = page.find("-->", lt + 4) + 3
                closed["-->"] = end > 2
                end = end if end > 2 else -1
        elif (opens := _OPENS.match(page, lt)) and closed[name := opens[1].lower()]:
            found = _CLOSES[name].search(page, opens.end())
            closed[name] = found is not None
            end = found.end() if found else -1
        if end < 0:
            end = page.find(">", lt) + 1
            if not end:  # a bracket that opens nothing
                out.append(page[lt:])
                break
        out.append(" ")
        at = end
    else:
        out.append(page[at:])
    return html.unescape("".join(out))


def declared(page: str) -> str | None:
    """The language that the first html tag declares."""
    root = _ROOT.search(page)
    if not root:
        return None
    end = page.find(">", root.end())
    found = _DECLARED.search(page, root.end(), end if end >= 0 else len(page))
    return found[1].lower() if found else None


def pairs(text: str) -> np.ndarray:
    """Counts of byte pairs of the lower-cased text."""
    raw = np.frombuffer(text.lower().encode("utf-8", "surrogatepass"), dtype=np.uint8)
    if len(raw) < 2:
        return np.zeros(0, dtype=np.int64)
    return np.bincount(raw[:-1].astype(np.int64) * 256 + raw[1:], minlength=65536)


def _sum_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, byte pair, number) of a task's texts, pairs that do not occur left out."""
    sums: dict[str, np.ndarray] = {}
    for b in batches:
        for lang, text in zip(b.column("lang").to_pylist(), b.column("text"), strict=True):
            c = pairs(text.as_py() or "")
            if len(c):
                sums[lang] = sums.get(lang, 0) + c
    for lang, c in sums.items():
        at = np.flatnonzero(c)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(c[at], pa.int64())], names=["lang", "pair", "n"])


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, most: int = TRAIN_DOCS) -> tuple[list[str], np.ndarray]:
    """Languages and, per byte pair, the log share in each."""
    known = pick(docs, "doc_id", "lang", "text").where("lang IS NOT NULL AND doc_id IS NOT NULL").where(~held_out())
    sample = known.where(sampled("doc_id", 0.9 * most / max(1, known.count()))).select("lang", "text").limit(most)
    total: dict[str, np.ndarray] = {}
    for r in sample.mapInArrow(_sum_pairs, "lang string, pair int, n long").groupBy("lang", "pair").agg(F.sum("n").alias("n")).collect():  # rows bounded by the sample and by 65,536 pairs a language
        total.setdefault(r["lang"], np.zeros(65536, dtype=np.int64))[r["pair"]] = r["n"]
    langs = sorted(total)
    if not langs:
        return ["und"], np.zeros((65536, 1))
    counts = np.stack([total[k] for k in langs], axis=1) + 0.5
    return langs, np.log(counts / counts.sum(axis=0))


ROWS = "kind string, doc_id long, page_id long, host string, suffix string, markup string, text_ll array<double>"


def _evidence(kind: str, table: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ll, mark = [], []
            for t in b.column("body"):
                text = t.as_py() or ""
                mark.append(declared(text) if kind == "page" else None)
                c = pairs(visible(text) if kind == "page" else text)
                at = np.flatnonzero(c)
                n = int(c.sum()) if len(c) else 0
                ll.append((c[at] @ table[at] * (min(1.0, TEMPER / n))).tolist() if n else [0.0] * table.shape[1])
            ids, none = b.column("id"), pa.nulls(b.num_rows, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array([kind] * b.num_rows, pa.string()), none if kind == "page" else ids, ids if kind == "page" else none, b.column("host"), b.column("suffix"), pa.array(mark, pa.string()), pa.array(ll, pa.list_(pa.float64()))],
                names=[x.split()[0] for x in ROWS.split(", ")],
            )

    return run


def _normal(ll: Column) -> Column:
    """Log shares of a vector of log weights."""
    top = F.array_max(ll)
    return F.transform(ll, lambda x: x - top - F.log(F.aggregate(ll, F.lit(0.0), lambda a, y: a + F.exp(y - top))))


def _counts(rows: DataFrame, by: str, k: int) -> DataFrame:
    return rows.where(F.col(by).isNotNull()).groupBy("kind", by).agg(F.array(*[F.count_if(F.col("guess") == i).cast("double") for i in range(k)]).alias(f"{by}_n"))


def identify(docs: DataFrame, pages: DataFrame | None = None, most: int = TRAIN_DOCS) -> DataFrame:
    """kind, doc_id, page_id, language, probability, text_language of every row of both tables."""
    spark = docs.sparkSession
    byte_batches(spark)
    base = scratch(spark)
    langs, table = fit(docs, most)
    k = len(langs)
    body = docs.select(F.col("doc_id").cast("bigint").alias("id"), F.col("source").cast("string").alias("host"), F.lit(None).cast("string").alias("suffix"), F.col("text").cast("string").alias("body"))
    rows = body.mapInArrow(_evidence("document", table), ROWS)
    if pages is not None:
        host = F.lower(F.regexp_extract("url", r"://([^/?#:]+)", 1))
        web = pages.select(F.col("page_id").cast("bigint").alias("id"), F.when(host != "", host).alias("host"), F.col("html").cast("string").alias("body"))
        web = web.select("id", "host", F.substring_index("host", ".", -1).alias("suffix"), "body")
        rows = rows.unionAll(web.mapInArrow(_evidence("page", table), ROWS))
    guess = F.array_position(F.col("text_ll"), F.array_max("text_ll")).cast("int") - 1
    rows = stored(rows.withColumn("guess", F.when(F.array_max("text_ll") == F.array_min("text_ll"), F.lit(-1 if k > 1 else 0)).otherwise(guess)), f"{base}/rows")

    prior = rows.groupBy("kind").agg(F.array(*[F.count_if(F.col("guess") == i).cast("double") for i in range(k)]).alias("all_n"))
    zero = F.array(*[F.lit(0.0)] * k)
    share = lambda n, parent: F.transform(n, lambda x, i: (x + SMOOTH * F.get(parent, i)) / (F.aggregate(n, F.lit(0.0), lambda a, y: a + y) + SMOOTH))
    even = F.array(*[F.lit(1.0 / k)] * k)
    hosts = stored(_counts(rows, "host", k), f"{base}/hosts")
    suffixes, marks = _counts(rows, "suffix", k), _counts(rows, "markup", k)
    d = rows.join(F.broadcast(prior), "kind", "left")  # two rows
    for name, side in (("suffix", suffixes), ("markup", marks)):
        d = d.join(stored(side, f"{base}/{name}"), ["kind", name], "left")
    d = d.join(hosts, ["kind", "host"], "left")
    own = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: (i == F.col("guess")).cast("double"))
    less = lambda n: F.zip_with(F.coalesce(n, zero), F.when(n.isNotNull(), own).otherwise(zero), lambda a, b: F.greatest(a - b, F.lit(0.0)))
    d = d.withColumn("p0", share(less(F.col("all_n")), even))
    d = d.withColumn("p1", share(less(F.col("suffix_n")), F.col("p0"))).withColumn("p2", share(less(F.col("host_n")), F.col("p1")))
    # P(declared | language) up to a factor: the share of languages among rows with this declaration, over the prior
    d = d.withColumn("m", F.when(F.col("markup").isNotNull(), F.zip_with(share(less(F.col("markup_n")), F.col("p0")), F.col("p0"), lambda a, b: F.log(a / b))).otherwise(zero))
    post = F.transform("text_ll", lambda x, i: x + F.log(F.get("p2", i)) + F.get("m", i))
    d = d.withColumn("post", _normal(post))
    best = F.array_position("post", F.array_max("post")).cast("int")
    name = F.array(*[F.lit(x) for x in langs])
    return d.select(
        "kind", "doc_id", "page_id", F.element_at(name, best).alias("language"), F.exp(F.array_max("post")).alias("probability"),
        F.when(F.col("guess") >= 0, F.get(name, F.col("guess"))).alias("text_language"),
    )


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/pages.parquet"))
