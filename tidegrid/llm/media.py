"""Media columns: content-addressed payloads in tar shards.

Each text becomes a payload of whole 192-byte rows and is kept losslessly as a PNG image of 64 RGB pixels a row, 8 bits
a sample. A task appends its images to tar shards in the shared folder, each under the SHA-256 of its bytes and once a
task, however many rows carry it; rows carry digest, shard, offset and length. Shards have names of their own per
attempt and count only through rows that were committed, so a lost executor leaves at most an orphan file.

A second pass range-reads each header (33 bytes) to fill the metadata columns, then the stored bytes for digests and
features. Nothing is shuffled, so copies of one text, however many, are no burden.

Shards are reached through `pyarrow.fs`, which opens local, HDFS, S3 and GCS addresses. Null text counts as empty; the
payload of an empty text is one row of 192 spaces. Repeated rows each get their row, equal texts equal values. Texts of
any length are stored whole, one at a time; an empty table gives no rows and no shard; only doc_id and text are looked at,
whatever other columns are called.
"""

from __future__ import annotations

import hashlib
import struct
import tarfile
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import byte_batches, documents, pick, scratch, stored

ROW = 192
PIXELS = ROW // 3
SHARD_BYTES = 256 << 20
HEADER = 33
MAGIC = b"\x89PNG\r\n\x1a\n"


def payload(text: str | None) -> tuple[bytes, int]:
    """UTF-8 bytes padded with spaces to whole rows, and their number before."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + b" " * ((-len(raw)) % ROW if raw else ROW), len(raw)


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def encode(data: bytes) -> bytes:
    rows = np.frombuffer(data, dtype=np.uint8).reshape(-1, ROW)
    lines = np.zeros((len(rows), ROW + 1), dtype=np.uint8)  # each line starts with filter type 0
    lines[:, 1:] = rows
    head = struct.pack(">IIBBBBB", PIXELS, len(rows), 8, 2, 0, 0, 0)
    return MAGIC + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), 1)) + _chunk(b"IEND", b"")


def read_header(head: bytes) -> tuple[int, int]:
    """Width and height from the first 33 bytes."""
    if head[:8] != MAGIC or head[12:16] != b"IHDR":
        raise ValueError("not an image of this store")
    return struct.unpack(">II", head[16:24])


def decode(media: bytes) -> bytes:
    width, height = read_header(media[:HEADER])
    at, body = 8, []
    while at < len(media):
        (size,) = struct.unpack(">I", media[at : at + 4])
        if media[at + 4 : at + 8] == b"IDAT":
            body.append(media[at + 8 : at + 8 + size])
        at += 12 + size
    lines = np.frombuffer(zlib.decompress(b"".join(body)), dtype=np.uint8).reshape(height, width * 3 + 1)
    return lines[:, 1:].tobytes()


class Shard:
    """A tar file that grows member by member and tells where each member's bytes stand."""

    def __init__(self, folder: str):
        self.fs, root = pafs.FileSystem.from_uri(folder)
        self.fs.create_dir(root, recursive=True)
        self.path = f"{root}/{uuid.uuid4().hex}.tar"
        self.out, self.at = self.fs.open_output_stream(self.path), 0

    def add(self, name: str, data: bytes) -> int:
        info = tarfile.TarInfo(name)
        info.size = len(data)
        head = info.tobuf(tarfile.PAX_FORMAT)
        self.out.write(head)
        self.out.write(data)
        self.out.write(b"\0" * (-len(data) % 512))
        start = self.at + len(head)
        self.at = start + len(data) + (-len(data) % 512)
        return start

    def close(self) -> None:
        self.out.write(b"\0" * 1024)
        self.out.close()


KEPT = "doc_id long, n_bytes long, digest string, shard string, offset long, length long"


def _write(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, there = None, {}
        for b in batches:
            rows = []
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text"), strict=True):
                data, n = payload(text.as_py())
                key = hashlib.sha256(data).digest()
                if key not in there:
                    media = encode(data)
                    digest = hashlib.sha256(media).hexdigest()
                    if shard is None or shard.at > SHARD_BYTES:
                        if shard:
                            shard.close()
                        shard = Shard(folder)
                    there[key] = digest, shard.path.rpartition("/")[2], shard.add(f"{digest}.png", media), len(media)
                rows.append((doc_id, n, *there[key]))
            cols = list(zip(*rows, strict=True)) if rows else [()] * 6
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["doc_id", "n_bytes", "digest", "shard", "offset", "length"])
        if shard:
            shard.close()

    return run


class Reader:
    """Range reads of members; one shard is open at a time, as rows stand in the order of their shards."""

    def __init__(self, folder: str):
        self.fs, self.root = pafs.FileSystem.from_uri(folder)
        self.name = self.file = None

    def read(self, shard: str, offset: int, length: int) -> bytes:
        if shard != self.name:
            if self.file:
                self.file.close()
            self.name, self.file = shard, self.fs.open_input_file(f"{self.root}/{shard}")
        return self.file.read_at(length, offset)


def feature(data: bytes, width: int, height: int) -> str:
    """Size and the mean of each colour channel, in thousandths."""
    means = np.frombuffer(data, dtype=np.uint8).reshape(-1, 3).sum(axis=0, dtype=np.int64) * 1000 // (width * height)
    return f"png:{width}x{height}:rgb8:{means[0]}:{means[1]}:{means[2]}"


SEEN = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, width int, height int, shard string, offset long"


def _read(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(folder)
        for b in batches:
            seen, rows = {}, []
            for r in b.to_pylist():
                at = r["shard"], r["offset"]
                if at not in seen:
                    width, height = read_header(reader.read(*at, HEADER))
                    media = reader.read(*at, r["length"])
                    data = decode(media)
                    digest = hashlib.sha256(media).hexdigest()
                    if digest != r["digest"]:
                        raise ValueError(f"the stored bytes of {r['digest']} have changed")
                    seen[at] = (len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-16:]), len(media), digest, feature(data, width, height), width, height, *at)
                rows.append((r["doc_id"], r["n_bytes"], *seen[at]))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.int64()]
            cols = list(zip(*rows, strict=True)) if rows else [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=[x.split(" ")[0] for x in SEEN.split(", ")])

    return run


def media_rows(docs: DataFrame, folder: str) -> DataFrame:
    """Write every text to shards below folder; doc_id, n_bytes, digest, shard, offset, length of each row, from a stored table."""
    byte_batches(docs.sparkSession)
    return stored(pick(docs, "doc_id", "text").mapInArrow(_write(f"{folder}/shards"), KEPT), f"{folder}/rows")


def media_columns(docs: DataFrame, folder: str) -> DataFrame:
    """Rows of media_rows with header, digests and features as read back."""
    return media_rows(docs, folder).mapInArrow(_read(f"{folder}/shards"), SEEN)


def op5_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_columns(documents(spark, sf_dir), scratch(spark)).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", F.col("width"), F.col("height"))
