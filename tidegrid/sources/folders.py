"""Folders on any file system that Spark reaches, and tables kept there as complete versions."""

from __future__ import annotations

import atexit
import json
import os
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator, Mapping
from contextlib import contextmanager
from contextvars import ContextVar

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession


def run_id(spark: SparkSession) -> str:
    """Name of this application, by which its scratch folders and tables are told from those of others."""
    return re.sub(r"\W", "_", spark.sparkContext.applicationId)


def scratch(spark: SparkSession) -> str:
    """A new folder name of this run below the shared folder of spark.checkpoint.dir.

    Only where that is unset and Spark runs in one JVM is a local folder used instead.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = getattr(spark, "_tidegrid_scratch", None)
        if not base:
            folder = tempfile.mkdtemp(prefix="tidegrid-")
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
            base = spark._tidegrid_scratch = "file://" + folder
    return _noted(f"{base.rstrip('/')}/tidegrid-{run_id(spark)}-{uuid.uuid4().hex}")


def kept(df: DataFrame) -> DataFrame:
    """df written to a scratch folder and read again: what is used more than once is made once, and its lineage ends."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_made: ContextVar[list[str] | None] = ContextVar("made", default=None)


def _noted(name: str) -> str:
    if (made := _made.get()) is not None:
        made.append(name)
    return name


def scratch_table(spark: SparkSession) -> str:
    """A new name for a scratch table of this run."""
    return _noted(f"tidegrid_{run_id(spark)}_{uuid.uuid4().hex}")


@contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """Scratch folders and tables that this thread makes inside are dropped at the end, when what they led to has been written elsewhere."""
    token = _made.set([])
    try:
        yield
    finally:
        made = _made.get() or []
        _made.reset(token)
        for name in made:
            if "/" in name:
                remove(spark, name)
            else:
                spark.sql(f"DROP TABLE IF EXISTS `{name}`")


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def children(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none where there is no such folder."""
    fs, p = _fs(spark, path)
    return [f.getPath().getName() for f in fs.listStatus(p)] if fs.exists(p) else []


def remove(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.delete(p, True)


def put_new(spark: SparkSession, path: str, text: str) -> bool:
    """Write a small file that is there as a whole or not at all; False if there is one of that name already.

    The file is written under another name first and then linked (local disks) or renamed without overwriting (HDFS and
    stores that offer it), which only one of several writers can do.
    """
    fs, p = _fs(spark, path)
    jvm = spark.sparkContext._jvm
    draft = jvm.org.apache.hadoop.fs.Path(p.getParent(), f".{uuid.uuid4().hex}")
    fs.mkdirs(p.getParent())
    out = fs.create(draft, False)
    out.write(bytearray(text.encode()))
    out.close()
    try:
        if fs.getUri().getScheme() == "file":
            os.link(draft.toUri().getPath(), p.toUri().getPath())
        else:
            none = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(p.toUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(draft, p, none)
        return True
    except FileExistsError:
        return False
    except Py4JJavaError as e:
        if "FileAlreadyExistsException" in str(e.java_exception.getClass().getName()):
            return False
        raise
    finally:
        fs.delete(draft, False)


def read_small(spark: SparkSession, path: str) -> str:
    fs, p = _fs(spark, path)
    file = fs.open(p)
    try:
        return bytes(file.readAllBytes()).decode()
    finally:
        file.close()


#: Wraps rows before they are written, and gives what is to be asked afterwards.
Check = Callable[[DataFrame], tuple[DataFrame, Callable[[], None]]]


class Conflict(RuntimeError):
    """Another writer has committed a version since this one began."""


#: Commit files that stay, so that a number once given is not given again to a writer that fell behind.
REMEMBERED = 1000


def versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the committed versions of a table, oldest first."""
    return sorted(int(n) for n in children(spark, f"{path}/commits") if n.isdigit())


def latest(spark: SparkSession, path: str) -> tuple[int, dict] | None:
    """Number and content of the last commit; None if there is none yet."""
    have = versions(spark, path)
    return (have[-1], json.loads(read_small(spark, f"{path}/commits/{have[-1]:012d}"))) if have else None


def commit(spark: SparkSession, path: str, base: int | None, content: dict) -> int:
    """Make content the version after `base` (None: the first), if nobody has made one since; else Conflict."""
    have = versions(spark, path)
    number = 0 if base is None else base + 1
    if (have[-1] if have else None) != base or not put_new(spark, f"{path}/commits/{number:012d}", json.dumps(content)):
        raise Conflict(f"{path}: version {number} was made by another writer")
    for old in have[:-REMEMBERED]:
        remove(spark, f"{path}/commits/{old:012d}")
    return number


def read_version(spark: SparkSession, path: str) -> DataFrame | None:
    """The last committed version; None if there is none yet."""
    found = latest(spark, path)
    return spark.read.parquet(f"{path}/data/{found[1]['data']}") if found else None


def update_version(spark: SparkSession, path: str, change: Callable[[DataFrame | None], DataFrame | None], keep: int = 2, marks: Mapping[str, int] | None = None, check: Check | None = None, tries: int = 50) -> bool:
    """Write change(last version) as the next one; readers see it whole or not at all, and no writer undoes another's.

    Rows are written first and committed by comparing the version they were made from; if another writer came first, the
    change is made anew from that one. `marks`, numbers by name, are kept with the version: a change none of whose marks is
    above the last one of its name has been made before and is left out (False). `check` wraps the rows before they are written and
    may raise after that, in which case nothing is committed. Rows of all but the last `keep` versions go.
    """
    for _ in range(tries):
        found = latest(spark, path)
        known = dict(found[1].get("marks", {})) if found else {}
        if marks and all(known.get(name, -1) >= n for name, n in marks.items()):
            return False
        rows = change(spark.read.parquet(f"{path}/data/{found[1]['data']}") if found else None)
        if rows is None:
            return False
        rows, verdict = check(rows) if check else (rows, lambda: None)
        name = uuid.uuid4().hex
        try:
            rows.write.parquet(f"{path}/data/{name}")
            verdict()
            before = found[1].get("before", [])[-(keep - 1) :] if found else []
            now = {"data": name, "marks": known | {name: max(n, known.get(name, -1)) for name, n in (marks or {}).items()}, "before": [*before, found[1]["data"]] if found else []}
            commit(spark, path, found[0] if found else None, now)
        except BaseException as e:
            remove(spark, f"{path}/data/{name}")
            if isinstance(e, Conflict) or isinstance(e, Exception) and latest(spark, path) != found:  # what it read may be gone by now
                continue
            raise
        for old in now["before"][: max(0, len(now["before"]) + 1 - keep)]:
            remove(spark, f"{path}/data/{old}")
        return True
    raise Conflict(f"{path}: {tries} other writers came first")


def write_version(df: DataFrame, path: str, keep: int = 2) -> None:
    """df as the next version, whatever the last one holds."""
    update_version(df.sparkSession, path, lambda old: df, keep)
