"""Remote archives as data sources: HAPI servers by time range, and CDF archives by their list of files.

Both split the work into partitions, a time range or a file each, so that executors fetch side by side and a lost one is
asked again. Both give long rows (time, var, value, file, place), as `cdf.wide` takes them. Sources of a live stream are
picked by `resolve_source`.
"""

from __future__ import annotations

import csv
import io
import json
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator
from datetime import UTC, datetime, timedelta

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from . import cdf, feeds, synthetic

# Addresses of public archives.
HAPI_SERVERS = {
    "cdaweb": "https://cdaweb.gsfc.nasa.gov/hapi",
    "sscweb": "https://sscweb.gsfc.nasa.gov/WS/hapi",
    "lisird": "https://lasp.colorado.edu/lisird/hapi",
    "vires": "https://vires.services/hapi",
    "amda": "http://amda.irap.omp.eu/service/hapi",
    "intermagnet": "https://imag-data.bgs.ac.uk/GIN_V1/hapi",
    "ccmc": "https://iswa.gsfc.nasa.gov/IswaSystemWebApp/hapi",
}
CDAWEB = "https://cdaweb.gsfc.nasa.gov/WS/cdasr/1/dataviews/sp_phys/datasets"


def get(url: str, accept: str = "*/*", timeout: float = 60.0) -> bytes:
    """The body of an answer; errors say what was asked."""
    try:
        with urllib.request.urlopen(urllib.request.Request(url, headers={"Accept": accept}), timeout=timeout) as r:  # noqa: S310
            return r.read()
    except OSError as e:
        raise RuntimeError(f"fetching {url} failed: {e}; check the network and the names of archive, dataset and parameters") from e


def archive(name: str | None = None, url: str | None = None) -> str:
    """Address of a HAPI server: the one given, or that of an archive by name; CDAWeb's if nothing is said."""
    address = url or HAPI_SERVERS.get(name or "cdaweb")
    if not address:
        raise ValueError(f"no archive is called {name!r}; give its url, or one of {', '.join(HAPI_SERVERS)}")
    return address.rstrip("/")


def _instant(text: str) -> datetime:
    t = datetime.fromisoformat(text.replace("Z", "+00:00"))
    return t if t.tzinfo else t.replace(tzinfo=UTC)


def _z(t: datetime) -> str:
    return t.astimezone(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")


class _Hapi(DataSourceReader):
    def __init__(self, options):
        self.server, self.dataset = archive(options.get("archive"), options.get("url")), options["dataset"]
        self.parameters = [p for p in options.get("parameters", "").split(",") if p]
        self.start, self.stop, self.hours = _instant(options["start"]), _instant(options["stop"]), float(options.get("hours", "24"))

    def partitions(self):
        out, at = [], self.start
        while at < self.stop:
            end = min(at + timedelta(hours=self.hours), self.stop)
            out.append(InputPartition((_z(at), _z(end))))
            at = end
        return out

    def read(self, partition) -> Iterator[pa.RecordBatch]:
        start, stop = partition.value
        ask = {"id": self.dataset, "parameters": ",".join(self.parameters)} if self.parameters else {"id": self.dataset}
        info = json.loads(get(f"{self.server}/info?{urllib.parse.urlencode(ask)}"))
        url = f"{self.server}/data?{urllib.parse.urlencode(ask | {'time.min': start, 'time.max': stop, 'format': 'csv'})}"
        rows = list(csv.reader(io.StringIO(get(url).decode())))
        times = [int(_instant(r[0]).timestamp() * 1_000_000) for r in rows]
        at = 0
        for p in info["parameters"]:
            width = 1
            for k in p.get("size") or []:
                width *= k
            if at and (not self.parameters or p["name"] in self.parameters):
                values = [_value(r[at], p.get("fill")) for r in rows]  # the first of several channels
                n = len(rows)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(times, pa.timestamp("us", tz="UTC")), pa.array([p["name"]] * n, pa.string()), pa.array(values, pa.float64()), pa.array([url] * n, pa.string()), pa.array(range(n), pa.int64())],
                    names=["time", "var", "value", "file", "place"],
                )
            at += width


def _value(text: str, fill) -> float | None:
    try:
        x = float(text)
    except ValueError:
        return None
    bad = x != x or (fill is not None and abs(x - float(fill)) <= 1e-8 + 1e-5 * abs(float(fill)))
    return None if bad else x


class HapiSource(DataSource):
    """spark.read.format("hapi").options(archive=… or url=…, dataset=…, parameters="a,b", start=…, stop=…, hours=24)"""

    @classmethod
    def name(cls):
        return "hapi"

    def schema(self):
        return cdf.LONG

    def reader(self, schema):
        return _Hapi(self.options)


class _Archive(DataSourceReader):
    def __init__(self, options):
        self.variables = [v for v in options["variables"].split(",") if v]
        stamp = lambda t: _instant(t).strftime("%Y%m%dT%H%M%SZ")
        self.url = f"{options.get('base', CDAWEB)}/{options['dataset']}/data/{stamp(options['start'])},{stamp(options['stop'])}/{','.join(self.variables)}?format=cdf"

    def partitions(self):
        listed = json.loads(get(self.url, "application/json")).get("FileDescription") or []
        return [InputPartition(f["Name"]) for f in listed]

    def read(self, partition) -> Iterator[pa.RecordBatch]:
        if partition is not None and partition.value:
            yield from cdf.long_batches(get(partition.value), partition.value, self.variables)


class CdawebSource(DataSource):
    """spark.read.format("cdaweb").options(dataset=…, variables="a,b", start=…, stop=…): a partition per file of the archive's answer."""

    @classmethod
    def name(cls):
        return "cdaweb"

    def schema(self):
        return cdf.LONG

    def reader(self, schema):
        return _Archive(self.options)


def fetch_hapi(spark: SparkSession, name: str | None, dataset: str, parameters: list[str], start: str, stop: str, hours: float = 24, url: str | None = None) -> DataFrame:
    """time and one column a parameter; fill values and what is no number are null."""
    spark.dataSource.register(HapiSource)
    o = {"url": archive(name, url), "dataset": dataset, "parameters": ",".join(parameters), "start": start, "stop": stop, "hours": str(hours)}
    return cdf.wide(spark.read.format("hapi").options(**o).load(), parameters)


def fetch_cdaweb(spark: SparkSession, dataset: str, variables: list[str], start: str, stop: str, base: str = CDAWEB) -> DataFrame:
    """time and one column a variable; a variable that no file has is null throughout."""
    spark.dataSource.register(CdawebSource)
    o = {"dataset": dataset, "variables": ",".join(variables), "start": start, "stop": stop, "base": base}
    return cdf.wide(spark.read.format("cdaweb").options(**o).load(), variables)


def resolve_source(spark: SparkSession, source: Callable[[SparkSession], DataFrame] | str = "synthetic", **options) -> DataFrame:
    """A streaming frame: a callable's own, polls of a JSON feed for `poll`, else the synthetic sample stream."""
    if callable(source):
        return source(spark)
    if source == "poll":
        spark.dataSource.register(feeds.JsonPoll)
        return spark.readStream.format("json_poll").option("url", options["url"]).load()
    return synthetic.sample_stream(spark, **options)
