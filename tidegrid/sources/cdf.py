"""CDF version 3 files: a small decoder, and frames read and written through Spark's and Arrow's file systems.

Single-file CDFs are read, row- or column-major, compressed as a whole or by blocks of a variable; numbers and strings of
the common types. Spark's binary file source brings the bytes, from wherever Spark reads, and each file becomes long rows
(time, var, value) in Arrow batches, of the variables asked for only; `wide` pivots them in one shuffle, the last value
of a time winning. Frames are written as one file per period.
"""

from __future__ import annotations

import struct
import zlib
from bisect import bisect_right
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field
from datetime import UTC, datetime

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import CDF_FILL, CDF_KINDS

# Type numbers of the format, and the days from which one more leap second counts (the first with ten).
TYPES = {1: "i1", 2: "i2", 4: "i4", 8: "i8", 11: "u1", 12: "u2", 14: "u4", 21: "f4", 22: "f8", 31: "f8", 32: "c16", 33: "i8", 41: "i1", 44: "f4", 45: "f8"}
EPOCH, EPOCH16, TT2000, DOUBLE, CHAR = 31, 32, 33, 45, 51
LEAP_DAYS = (
    "1972-01-01 1972-07-01 1973-01-01 1974-01-01 1975-01-01 1976-01-01 1977-01-01 1978-01-01 1979-01-01 1980-01-01 1981-07-01 1982-07-01 1983-07-01 1985-07-01 "
    "1988-01-01 1990-01-01 1991-01-01 1992-07-01 1993-07-01 1994-07-01 1996-01-01 1997-07-01 1999-01-01 2006-01-01 2009-01-01 2012-07-01 2015-07-01 2017-01-01"
).split()

_LEAPS = [int(datetime.fromisoformat(d).replace(tzinfo=UTC).timestamp()) for d in LEAP_DAYS]
#: Seconds since 1970 of the origin of TT2000, counted without later leap seconds, in nanoseconds.
_ORIGIN_NS = 946_727_935_816_000_000
_EPOCH0_MS = 62_167_219_200_000  # milliseconds from year 0 to 1970


def leap_seconds(unix: float) -> int:
    return 9 + bisect_right(_LEAPS, unix)


def tt2000_of(unix_ns: int) -> int:
    return unix_ns - _ORIGIN_NS + (leap_seconds(unix_ns / 1e9) - 32) * 1_000_000_000


def unix_ns_of(tt: int) -> int:
    """Nanoseconds since 1970; within a leap second the last second of the day repeats."""
    guess = tt + _ORIGIN_NS
    for _ in range(2):
        guess = tt + _ORIGIN_NS - (leap_seconds(guess / 1e9) - 32) * 1_000_000_000
    return guess


def unix_us_of(tt: np.ndarray) -> np.ndarray:
    """Microseconds since 1970 of an array of TT2000 values."""
    leaps, guess = np.array(_LEAPS), tt + _ORIGIN_NS
    for _ in range(2):
        seconds = 9 + np.searchsorted(leaps, guess / 1e9, side="right") - 32
        guess = tt + _ORIGIN_NS - seconds * 1_000_000_000
    return guess // 1000


def _opened(path: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of an address or of a local path."""
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


@dataclass
class Variable:
    name: str
    kind: int
    dims: tuple[int, ...]
    n: int
    attrs: dict = field(default_factory=dict)
    blocks: list = field(default_factory=list)
    size: int = 1


class File:
    """Directory of one file; values are decoded on demand."""

    def __init__(self, data: bytes, name: str = "the file"):
        if data[:4] != b"\xcd\xf3\x00\x01":
            raise ValueError(f"{name} is not a CDF file of version 3")
        if data[4:8] == b"\xcc\xcc\x00\x01":  # one compressed record that holds all others
            cpr, size = struct.unpack_from(">qq", data, 8 + 12)
            if struct.unpack_from(">i", data, cpr + 12)[0] != 5:
                raise ValueError(f"{name} is compressed as a whole in another way than gzip")
            data = data[:4] + b"\x00\x00\xff\xff" + zlib.decompress(data[8 + 32 : cpr], 47)[:size]
        self.data = data
        if not self._at(8 + 32, ">i")[0] & 2:
            raise ValueError(f"{name} keeps its variables in files of their own")
        self.row_major = bool(self._at(8 + 32, ">i")[0] & 1)
        gdr = self._at(8 + 12, ">q")[0]
        encoding = self._at(8 + 28, ">i")[0]
        self.order = ">" if encoding in (1, 2, 5, 7, 9, 11, 12) else "<"
        zvar, attr = self._at(gdr + 20, ">q")[0], self._at(gdr + 28, ">q")[0]
        self.vars: dict[str, Variable] = {}
        by_num = {}
        while zvar:
            v, num, zvar = self._variable(zvar)
            self.vars[v.name] = by_num[num] = v
        while attr:
            attr = self._attribute(attr, by_num)

    def _at(self, at: int, fmt: str) -> tuple:
        return struct.unpack_from(fmt, self.data, at)

    def _text(self, at: int, n: int) -> str:
        return self.data[at : at + n].split(b"\0")[0].decode("utf-8", "replace")

    def _variable(self, at: int) -> tuple[Variable, int, int]:
        nxt, kind, last, vxr = self._at(at + 12, ">qiiq")
        elems, num = self._at(at + 64, ">ii")
        (ndims,) = self._at(at + 340, ">i")
        dims = self._at(at + 344, f">{ndims}i")
        v = Variable(self._text(at + 84, 256), kind, tuple(dims), last + 1, size=elems)
        v.blocks = list(self._blocks(vxr))
        return v, num, nxt

    def _blocks(self, vxr: int) -> Iterator[tuple[int, int, int]]:
        while vxr:
            nxt, n, used = self._at(vxr + 12, ">qii")
            first, last, off = self._at(vxr + 28, f">{n}i"), self._at(vxr + 28 + 4 * n, f">{n}i"), self._at(vxr + 28 + 8 * n, f">{n}q")
            for i in range(used):
                if self._at(off[i] + 8, ">i")[0] == 6:
                    yield from self._blocks(off[i])
                else:
                    yield first[i], last[i], off[i]
            vxr = nxt

    def _attribute(self, at: int, by_num: Mapping[int, Variable]) -> int:
        nxt = self._at(at + 12, ">q")[0]
        name, entry = self._text(at + 68, 256), self._at(at + 48, ">q")[0]
        while entry:
            after, _, kind, num, elems = self._at(entry + 12, ">qiiii")
            if num in by_num:
                by_num[num].attrs[name] = self._value(entry + 56, kind, elems)
            entry = after
        return nxt

    def _value(self, at: int, kind: int, elems: int):
        if kind in (51, 52):
            return self.data[at : at + elems].split(b"\0")[0].decode("utf-8", "replace").strip()
        x = np.frombuffer(self.data, dtype=self.order + TYPES[kind], count=elems, offset=at)
        return x[0].item() if elems == 1 else x.tolist()

    def values(self, name: str) -> np.ndarray:
        v = self.vars[name]
        text = v.kind in (51, 52)
        dtype = np.dtype(f"S{v.size}") if text else np.dtype(self.order + TYPES[v.kind])
        per = int(np.prod(v.dims)) if v.dims else 1
        out = np.zeros((v.n, per), dtype=dtype)
        for first, last, at in v.blocks:
            size, kind = self._at(at, ">qi")
            if kind == 13:
                (packed,) = self._at(at + 16, ">q")
                raw = zlib.decompress(self.data[at + 24 : at + 24 + packed], 47)
            else:
                raw = self.data[at + 12 : at + size]
            n = min(last, v.n - 1) - first + 1
            out[first : first + n] = np.frombuffer(raw, dtype=dtype, count=n * per).reshape(n, per)
        if self.row_major:
            return out.reshape((v.n, *v.dims))
        return out.reshape((v.n, *v.dims[::-1])).transpose(0, *range(len(v.dims), 0, -1))

    def data_variables(self) -> list[str]:
        typed = {n: str(v.attrs["VAR_TYPE"]).lower() for n, v in self.vars.items() if "VAR_TYPE" in v.attrs}
        if typed:
            return [n for n in self.vars if typed.get(n) == "data"]
        return [n for n in self.vars if "epoch" not in n.lower()]

    def time_of(self, name: str) -> np.ndarray:
        """Microseconds since 1970 of a variable's records, by DEPEND_0 or else the first epoch there is."""
        dep = self.vars[name].attrs.get("DEPEND_0")
        if dep not in self.vars:
            dep = next((n for n, v in self.vars.items() if v.kind in (EPOCH, EPOCH16, TT2000)), None)
        if dep is None:
            raise ValueError(f"{name} has no time variable")
        t, kind = self.values(dep), self.vars[dep].kind
        if kind == TT2000:
            return unix_us_of(t.astype(np.int64))
        if kind == EPOCH:
            return np.round((t - _EPOCH0_MS) * 1000).astype(np.int64)
        if kind == EPOCH16:
            return np.round((t.real - _EPOCH0_MS / 1000) * 1e6 + t.imag / 1e6).astype(np.int64)
        raise ValueError(f"{dep} is not a time variable")

    def series(self, name: str) -> tuple[np.ndarray, np.ndarray]:
        """Times and values of a variable (its first channel), NaN where it is filled or out of its valid range."""
        x = self.values(name)
        x = x.reshape(len(x), -1)[:, 0].astype(float)
        a = self.vars[name].attrs
        bad = ~np.isfinite(x)
        if (fill := _number(a.get("FILLVAL"))) is not None:
            bad |= np.isclose(x, fill)
        for key, low in (("VALIDMIN", True), ("VALIDMAX", False)):
            if (edge := _number(a.get(key))) is not None:
                bad |= (x < edge) if low else (x > edge)
        return self.time_of(name), np.where(bad, np.nan, x)


def _number(x) -> float | None:
    if isinstance(x, (list, tuple)):
        x = x[0] if x else None
    try:
        return None if x is None else float(x)
    except (TypeError, ValueError):
        return None


def open_cdf(path: str) -> File:
    """One file, at a local path or an address that Arrow reads."""
    fs, at = _opened(path)
    with fs.open_input_file(at) as f:
        return File(f.read(), path)


def list_variables(path: str) -> list[str]:
    return list(open_cdf(path).vars)


def list_data_variables(path: str) -> list[str]:
    return open_cdf(path).data_variables()


def variable_meta(path: str, name: str) -> dict:
    v = open_cdf(path).vars[name]
    pick = {k.lower(): v.attrs.get(k) for k in ("DEPEND_0", "UNITS", "CATDESC")}
    return pick | {k.lower(): _number(v.attrs.get(k)) for k in ("FILLVAL", "VALIDMIN", "VALIDMAX")} | {"source_var": name}


LONG = "time timestamp, var string, value double, file string, place long"


def long_batches(data: bytes, file: str, variables: Sequence[str] | None) -> Iterator[pa.RecordBatch]:
    """One Arrow batch per variable that the file has; values that are filled or out of range are null."""
    f = File(data, file)
    for name in variables if variables is not None else f.data_variables():
        if name in f.vars:
            t, x = f.series(name)
            n = len(t)
            yield pa.RecordBatch.from_arrays(
                [pa.array(t, pa.timestamp("us", tz="UTC")), pa.array([name] * n, pa.string()), pa.array(x, pa.float64(), from_pandas=True), pa.array([file] * n, pa.string()), pa.array(np.arange(n), pa.int64())],
                names=["time", "var", "value", "file", "place"],
            )


def _decode(variables: list[str] | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content in zip(b.column("path").to_pylist(), b.column("content"), strict=True):
                yield from long_batches(content.as_py(), path, variables)

    return run


def read_cdf(spark: SparkSession, paths: Sequence[str], variables: Sequence[str] | None = None) -> DataFrame:
    """Long rows (time, var, value, file, place in the file)."""
    files = spark.read.format("binaryFile").load(list(paths)).select("path", "content")
    return files.mapInArrow(_decode(list(variables) if variables is not None else None), LONG)


def wide(long: DataFrame, variables: Sequence[str]) -> DataFrame:
    """time and one column a variable; of several values at a time the last one of the last file wins."""
    last = F.struct("file", "place")
    aggs = [F.max_by("value", F.when(F.col("var") == v, last)).alias(v) for v in variables]
    return long.groupBy("time").agg(*aggs) if aggs else long.select("time").limit(0)


def write_cdf(path: str, times_us: Sequence[int], columns: Mapping[str, Sequence[float]], attrs: Mapping[str, Mapping] | None = None) -> None:
    """One file at a local path or an address that Arrow writes."""
    fs, at = _opened(path)
    with fs.open_output_stream(at) as f:
        f.write(cdf_bytes(times_us, columns, attrs))


def write_cdf_files(df: DataFrame, folder: str, columns: Sequence[str] | None = None, kind: str | None = None, keys: Sequence[str] = (), period: str = "yyyyMM", time: str = "time") -> DataFrame:
    """A file for each series and period, below folder; one row (path, n) a file, from which read_cdf can go on.

    `kind` picks the columns of a ground-truth (`goes`) or driver (`omni`) file. A period is the most that one task holds.
    """
    if kind is not None and kind not in CDF_KINDS:
        raise ValueError(f"unknown kind {kind!r}; known are {sorted(CDF_KINDS)}")
    names = [c for c in (columns if columns is not None else CDF_KINDS[kind] if kind else df.columns) if c in df.columns and c != time and c not in keys]
    cols = [F.col(c).cast("double").alias(c) for c in names]
    part = F.concat_ws("-", *[F.col(k).cast("string") for k in keys], F.date_format(time, period))

    def run(key: tuple, group: pa.Table) -> pa.Table:
        group = group.sort_by("t")
        path = f"{folder.rstrip('/')}/{key[0].as_py()}.cdf"
        fs, root = _opened(folder)
        fs.create_dir(root, recursive=True)
        write_cdf(path, group.column("t").to_numpy(), {c: group.column(c).to_numpy() for c in names})
        return pa.table({"path": pa.array([path], pa.string()), "n": pa.array([group.num_rows], pa.int64())})

    return df.where(F.col(time).isNotNull()).select(part.alias("part"), F.unix_micros(time).alias("t"), *cols).groupBy("part").applyInArrow(run, "path string, n long")


def cdf_bytes(times_us: Sequence[int], columns: Mapping[str, Sequence[float]], attrs: Mapping[str, Mapping] | None = None) -> bytes:
    """One file with a TT2000 `Epoch` and DOUBLE variables; NaN becomes the fill value."""
    names = ["Epoch", *columns]
    data = {"Epoch": np.array([tt2000_of(int(t) * 1000) for t in times_us], dtype="<i8")}
    data |= {n: np.where(np.isnan(x := np.asarray(v, dtype="<f8")), CDF_FILL, x).astype("<f8") for n, v in columns.items()}
    own = {n: {"DEPEND_0": "Epoch", "FILLVAL": CDF_FILL, "VAR_TYPE": "data", **(attrs or {}).get(n, {})} for n in columns} | {"Epoch": {"VAR_TYPE": "support_data", **(attrs or {}).get("Epoch", {})}}
    out = bytearray(b"\xcd\xf3\x00\x01\x00\x00\xff\xff")
    n = len(times_us)

    def put(fmt: str, *values, tail: bytes = b"") -> int:
        at, body = len(out), struct.pack(">" + fmt, *values) + tail
        out.extend(struct.pack(">q", len(body) + 8) + body)
        return at

    def fix(at: int, value: int) -> None:
        out[at : at + 8] = struct.pack(">q", value)

    cdr = put("iqiiiiiiiii", 1, 0, 3, 9, 6, 3, 0, 0, 0, 1, 0, tail=b"\0" * 256)
    gdr = put("iqqqqiiiiiqiii", 2, 0, 0, 0, 0, 0, 0, -1, 0, len(names), 0, 0, 20170101, -1)
    fix(cdr + 12, gdr)
    before = gdr + 20
    for i, name in enumerate(names):
        head = put("iqiiqqiiiiiiiqi", 8, 0, TT2000 if name == "Epoch" else DOUBLE, n - 1, 0, 0, 1, 0, 0, -1, -1, 1, i, -1, 0, tail=name.encode().ljust(256, b"\0") + struct.pack(">i", 0))
        fix(before, head)
        before = head + 12
        if n:
            vvr = put("i", 7, tail=data[name].tobytes())
            vxr = put("iqiiiiq", 6, 0, 1, 1, 0, n - 1, vvr)
            fix(head + 28, vxr)
            fix(head + 36, vxr)
    keys = list(dict.fromkeys(k for a in own.values() for k in a))
    before = gdr + 28
    for j, key in enumerate(keys):
        having = [(i, own[name][key]) for i, name in enumerate(names) if key in own[name]]
        adr = put("iqqiiiiiqiii", 4, 0, 0, 2, j, 0, -1, 0, 0, len(having), max(i for i, _ in having), -1, tail=key.encode().ljust(256, b"\0"))
        fix(before, adr)
        before = adr + 12
        link = adr + 48
        for i, value in having:
            text = str(value).encode() if isinstance(value, str) else struct.pack("<d", float(value))
            entry = put("iqiiiiiiiii", 9, 0, j, CHAR if isinstance(value, str) else DOUBLE, i, len(text) if isinstance(value, str) else 1, 0, 0, 0, -1, -1, tail=text)
            fix(link, entry)
            link = entry + 12
    fix(gdr + 36, len(out))
    struct.pack_into(">i", out, gdr + 48, len(keys))
    return bytes(out)
