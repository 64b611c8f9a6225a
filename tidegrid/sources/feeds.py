"""JSON feeds: lists of lists with a header, lists of objects, time columns, and the merged real-time frame."""

from __future__ import annotations

import json
import urllib.request
from collections.abc import Callable, Iterator, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

from ..functions import energy_label
from ..operators.clean import forward_fill
from ..schema import Grid

# Labels of the energy channels that count, and the names under which the activity index comes.
ENERGIES = (">=2MeV", ">=2.0MeV", ">2MeV", "2MeV")
KP_NAMES = ("kp_index", "kp", "estimated_kp", "Kp")
TIME_NAMES = ("time_tag", "time")


def get_json(url: str, timeout: float = 20.0):
    with urllib.request.urlopen(url, timeout=timeout) as r:  # noqa: S310
        return json.loads(r.read())


def lists_of(bodies: DataFrame, header: Sequence[str], body: str = "body") -> DataFrame:
    """Rows of payloads, one a row of `bodies`, that are lists of lists with a header first."""
    rows = bodies.select(F.posexplode(F.from_json(body, "array<array<string>>")).alias("i", "r")).where("i > 0")
    return rows.select(*[F.get("r", F.lit(j)).alias(str(c)) for j, c in enumerate(header)])


def records_of(bodies: DataFrame, names: Sequence[str], body: str = "body") -> DataFrame:
    """Rows of payloads that are lists of objects."""
    rows = bodies.select(F.explode(F.from_json(body, "array<map<string,string>>")).alias("r"))
    return rows.select(*[F.try_element_at("r", F.lit(c)).alias(c) for c in names])


def parse_lists(spark: SparkSession, text: str) -> DataFrame:
    """A list of lists whose first one is the header; fewer than two lists give an empty frame."""
    head = json.loads(text)[:1]
    return lists_of(spark.createDataFrame([(text,)], "body string"), head[0]) if head else spark.createDataFrame([], "time string")


def parse_records(spark: SparkSession, text: str) -> DataFrame:
    """A list of objects; the columns are the keys in order of appearance."""
    names = list(dict.fromkeys(k for r in json.loads(text) for k in r))
    return records_of(spark.createDataFrame([(text,)], "body string"), names) if names else spark.createDataFrame([], "time string")


def finalise(df: DataFrame) -> DataFrame:
    """`time` from time_tag, time or the first column; other columns become numbers where all their values are."""
    source = next((c for c in TIME_NAMES if c in df.columns), df.columns[0])
    rest = [c for c in df.columns if c != source]
    odd = df.agg(*[F.count_if(F.col(c).isNotNull() & F.expr(f"try_cast(`{c}` AS double)").isNull()).alias(c) for c in rest]).first() if rest else {}
    cols = [F.expr(f"try_cast(`{c}` AS double)").alias(c) if not odd[c] else F.col(c) for c in rest]
    clean = F.regexp_replace(F.col(source), "Z$", "")
    return df.select(F.try_to_timestamp(clean).alias("time"), *cols)


def electrons(df: DataFrame) -> DataFrame:
    """time, flux_e2 of the channels that count."""
    keep = df.where(energy_label(F.col("energy")).isin(*ENERGIES))
    return keep.select("time", F.expr("try_cast(flux AS double)").alias("flux_e2"))


def solar_wind(plasma: DataFrame, mag: DataFrame) -> DataFrame:
    return plasma.join(mag.drop(*[c for c in mag.columns if c in plasma.columns and c != "time"]), "time", "full_outer").withColumnsRenamed({"speed": "vsw", "bz": "bz_gsm"})


def kp(df: DataFrame) -> DataFrame:
    name = next((c for c in KP_NAMES if c in df.columns), None)
    return df.select("time", (F.expr(f"try_cast(`{name}` AS double)") if name else F.lit(None).cast("double")).alias("kp"))


def alerts(payload) -> list[dict]:
    return payload if isinstance(payload, list) else []


def merged_realtime(e: DataFrame, sw: DataFrame, k: DataFrame) -> DataFrame:
    """Outer join of the three feeds, the index carried forward."""
    d = e.join(sw, "time", "full_outer").join(k, "time", "full_outer")
    return forward_fill(d, Grid(), "kp")


def first_with_rows(candidates: Sequence[Callable[[], DataFrame]], column: str) -> DataFrame | None:
    """The first candidate that has a value in the column."""
    for c in candidates:
        df = c()
        if column in df.columns and not df.where(F.col(column).isNotNull()).isEmpty():
            return df
    return None


def hapi_frame(spark: SparkSession, rows: Sequence[Sequence], fields: Sequence[tuple[str, float | None]]) -> DataFrame:
    """Rows of a HAPI answer: the first field is ISO time, others numbers (or arrays, of which the first), fills are missing."""
    flat = [[None if v is None else str(v[0] if isinstance(v, (list, tuple)) else v) for v in r] for r in rows]
    df = spark.createDataFrame(flat, ", ".join(f"`{n}` string" for n, _ in fields))
    time = F.try_to_timestamp(F.regexp_replace(F.col(fields[0][0]), "Z$", "")).alias("time")
    cols = []
    for n, fill in fields[1:]:
        x = F.expr(f"try_cast(`{n}` AS double)")
        cols.append((F.when(~(F.abs(x - F.lit(float(fill))) <= F.lit(1e-8 + 1e-5 * abs(float(fill)))), x) if fill is not None else x).alias(n))
    return df.select(time, *cols).orderBy("time")


class _Poll(SimpleDataSourceStreamReader):
    def __init__(self, url: str):
        self.url = url

    def initialOffset(self):
        return {"n": 0}

    def read(self, start) -> tuple[Iterator[tuple], dict]:
        return iter([(start["n"], json.dumps(get_json(self.url)))]), {"n": start["n"] + 1}

    def readBetweenOffsets(self, start, end):
        return iter([])

    def commit(self, end):
        pass


class JsonPoll(DataSource):
    """spark.readStream.format("json_poll").option("url", …): one row (n, body) a poll."""

    @classmethod
    def name(cls):
        return "json_poll"

    def schema(self):
        return "n long, body string"

    def simpleStreamReader(self, schema):
        return _Poll(self.options["url"])
