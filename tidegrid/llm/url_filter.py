"""URL filters by a sort-merge range join.

A rule is a host and a path prefix. The host of a URL is turned round label by label and closed with a separator
(`blog.example.com` -> `com.example.blog.`), so that the rules of one host and of all its subdomains become one
interval of keys. URLs are sorted by that key inside each partition (no shuffle, so a host with a third of the rows
is no burden), hosts with rules are sorted once, and one sweep over the whole partition merges both, keeping the hosts
whose interval is open on a stack. Nested intervals make the stack a chain of ever longer hosts. The paths of one host
are sorted too and are intervals themselves: a search finds the last one that starts at or before the URL's path, and
the chain of those that enclose it leads to the longest that fits, so a host with very many paths costs a logarithm.

Rules are shipped in blocks of at most `BLOCK_BYTES`; a larger rule table is swept block by block, each adding to the
best rule so far, so that what is shipped has a bound and no rule is dropped.

Defined results: a null URL or one without `://` has empty host and path; it fits no rule, as do empty hosts. Repeated
rows stay repeated. Of two fitting rules the longer (host and path together) wins, then the longer host, then `allow`.
URLs of any length are looked at whole; an empty table gives no rows, no rules the default verdict for all; only
page_id and url are looked at, whatever other columns are called.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable, Iterable, Iterator, Sequence
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import byte_batches

Rule = tuple[str, str, str]

BLOCK_BYTES = 16 << 20
RULES: tuple[Rule, ...] = (
    ("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"),
)


def host_key(host: str) -> str:
    """Labels in reverse, each closed by a dot: subdomains of a host are exactly the keys that start with its key."""
    return ".".join(reversed(host.split("."))) + "."


def blocks(rules: Iterable[Rule], size: int = BLOCK_BYTES) -> Iterator[list[tuple[str, str, str, str]]]:
    """Sorted blocks of (key, path, rule, verdict), each below a bound of bytes."""
    block, used = [], 0
    for verdict, host, path in rules:
        host = host.translate(_LOWER)
        row = (host_key(host), path, host + path, verdict)
        cost = 64 + sum(map(len, row))
        if block and used + cost > size:
            yield sorted(block)
            block, used = [], 0
        block.append(row)
        used += cost
    if block:
        yield sorted(block)


_LOWER = {c: c + 32 for c in range(65, 91)}


def rank(rule: str, verdict: str) -> tuple:
    return len(rule), len(rule.split("/", 1)[0]), verdict == "allow", rule


class Paths:
    """The rules of one host, sorted by path, each with the longest one before it whose path it extends."""

    def __init__(self, rules: Sequence[tuple[str, str, str, str]]):
        best: dict[str, tuple[str, str]] = {}
        for _, path, rule, verdict in rules:
            if path not in best or rank(rule, verdict) > rank(*best[path]):
                best[path] = rule, verdict
        self.paths, self.rules, self.outer = sorted(best), [], []
        stack: list[int] = []
        for i, path in enumerate(self.paths):
            while stack and not path.startswith(self.paths[stack[-1]]):
                stack.pop()
            self.rules.append(best[path])
            self.outer.append(stack[-1] if stack else -1)
            stack.append(i)

    def longest(self, path: str) -> tuple[str, str] | None:
        i = bisect_right(self.paths, path) - 1
        while i >= 0 and not path.startswith(self.paths[i]):
            i = self.outer[i]
        return self.rules[i] if i >= 0 else None


def hosts(rules: Sequence[tuple[str, str, str, str]]) -> list[tuple[str, Paths]]:
    """(key, its paths) in the order of keys, from rules in sorted order."""
    return [(key, Paths(list(own))) for key, own in groupby(rules, key=itemgetter(0))]


class Sweep:
    """Merges keys, given in sorted order, with hosts in sorted order; keeps its place from one batch of keys to the next."""

    def __init__(self, hosts: Sequence[tuple[str, Paths]]):
        self.hosts, self.stack, self.at = hosts, [], 0

    def best(self, key: str, path: str) -> tuple[str, str] | None:
        """The (rule, verdict) that fits best."""
        hosts, stack = self.hosts, self.stack
        while self.at < len(hosts) and hosts[self.at][0] <= key:  # intervals that open before this key
            while stack and not hosts[self.at][0].startswith(stack[-1][0]):
                stack.pop()
            stack.append(hosts[self.at])
            self.at += 1
        while stack and not key.startswith(stack[-1][0]):  # those that have ended
            stack.pop()
        return max((r for _, own in stack if (r := own.longest(path))), key=lambda r: rank(*r), default=None)


def _sweeper(rules: list[tuple[str, str, str, str]], schema: pa.Schema) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sweep = Sweep(hosts(rules))
        for b in batches:
            old = list(zip(b.column("rule").to_pylist(), b.column("verdict").to_pylist(), strict=True))
            for i, (key, path) in enumerate(zip(b.column("key").to_pylist(), b.column("path").to_pylist(), strict=True)):
                got = sweep.best(key, path)
                if got and (old[i][0] is None or rank(*got) > rank(*old[i])):
                    old[i] = got
            cols = [b.column(n) for n in b.schema.names if n not in ("rule", "verdict")]
            yield pa.RecordBatch.from_arrays([*cols, pa.array([o[0] for o in old], pa.string()), pa.array([o[1] for o in old], pa.string())], schema=schema)

    return run


def split_url(url) -> tuple:
    """Columns host and path of a URL column."""
    has = url.isNotNull() & url.contains("://")
    rest = F.substring(url, F.instr(url, "://") + 3, F.length(url))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.when(has, host).otherwise(F.lit("")), F.when(has, path).otherwise(F.lit(""))


def judge(pages: DataFrame, rules: Iterable[Rule], default: str = "allow", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """page_id, host, path, rule, verdict of every row of pages (page_id, url)."""
    byte_batches(pages.sparkSession)
    df = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"))
    host, path = split_url(F.col("url"))
    df = df.select("page_id", host.alias("host"), path.alias("path"))
    df = df.withColumn("key", F.concat(F.array_join(F.reverse(F.split("host", r"\.")), "."), F.lit("."))).withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(None).cast("string")})
    schema = pa.schema([("page_id", pa.int64()), ("host", pa.string()), ("path", pa.string()), ("key", pa.string()), ("rule", pa.string()), ("verdict", pa.string())])
    for block in blocks(rules, block_bytes):
        df = df.sortWithinPartitions("key").mapInArrow(_sweeper(block, schema), "page_id long, host string, path string, key string, rule string, verdict string")
    return df.select("page_id", "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url"), RULES)


def oracle() -> str:
    """Plain SQL over the same rules: each rule is tested against each URL, the longest one that fits is kept."""
    values = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in RULES)
    return f"""
WITH rules(verdict, host, path) AS (VALUES {values}),
u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages),
p AS (SELECT page_id, row_number() OVER () AS n,
  coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
  coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM u),
m AS (SELECT p.n, max_by(r.host || r.path, length(r.host || r.path)) AS rule, max_by(r.verdict, length(r.host || r.path)) AS verdict
  FROM p JOIN rules r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path) GROUP BY p.n)
SELECT p.page_id, p.host, p.path, m.rule, coalesce(m.verdict, 'allow') AS verdict FROM p LEFT JOIN m USING (n)
"""
