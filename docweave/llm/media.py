"""Media columns: content-addressed payloads in tar shards.

A text's UTF-8 bytes (null: none) are followed by zero bytes up to a positive multiple of 64 and stored
as an 8-bit grey PNG image of width 64, one sample a byte, losslessly. Members of a tar shard are named
by the SHA-256 digest of their payload; a shard holds a payload once, however many rows have it. Rows
carry digest, shard, offset and length; metadata columns come from range reads of the header alone
(signature and IHDR), features from reading the stored bytes back.

Storing and reading are one pass each without a shuffle. A shard belongs to one task attempt and is
only referred to by rows of the attempt that Spark commits, so a lost executor leaves at most an
unreferenced file. Shards go to the shared folder, by pyarrow's file systems (file, hdfs, s3, ...).

Null and empty texts store 64 zero bytes; repeated rows share a member; null ids pass through; an
empty table writes no shard; extra columns are ignored. Memory is bounded by one text.
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
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from docweave.llm.common import chunks, shared_dir, staged

WIDTH = 64
# The PNG signature, and the length of it with the IHDR chunk.
SIGNATURE = b"\x89PNG\r\n\x1a\n"
HEADER_BYTES = 33
#: A shard is closed when it has grown to this.
SHARD_BYTES = 256 << 20


def payload_of(raw: bytes) -> bytes:
    """The bytes with zeros up to a positive multiple of WIDTH."""
    return raw.ljust(max(WIDTH, -(-len(raw) // WIDTH) * WIDTH), b"\0")


def to_png(payload: bytes) -> bytes:
    """8-bit grey samples, WIDTH a row, no filter."""

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    lines = np.zeros((len(rows), WIDTH + 1), np.uint8)
    lines[:, 1:] = rows
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return SIGNATURE + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines.tobytes(), 4)) + chunk(b"IEND", b"")


def header(data: bytes) -> tuple[int, int, int, int]:
    """Width, height, bit depth and colour type from the first HEADER_BYTES."""
    if data[:8] != SIGNATURE or data[12:16] != b"IHDR":
        raise ValueError("not a PNG header")
    return struct.unpack(">IIBB", data[16:26])


def from_png(data: bytes) -> bytes:
    """The samples of a stored image."""
    at, packed = 8, []
    while at < len(data):
        (n,) = struct.unpack(">I", data[at : at + 4])
        kind, body = data[at + 4 : at + 8], data[at + 8 : at + 8 + n]
        if struct.unpack(">I", data[at + 8 + n : at + 12 + n])[0] != zlib.crc32(kind + body):
            raise ValueError("a chunk's checksum is wrong")
        if kind == b"IDAT":
            packed.append(body)
        at += 12 + n
    return np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(-1, WIDTH + 1)[:, 1:].tobytes()


def store(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Writes shards; per row ``key``, n_bytes, digest, shard, offset and length of the member's data."""
    folder = f"{shared_dir(df.sparkSession)}/media-{uuid.uuid4().hex}"
    fields = [("n_bytes", T.LongType()), ("digest", T.StringType()), ("shard", T.StringType()), ("offset", T.LongType()), ("length", T.LongType())]
    schema = T.StructType([T.StructField(key, df.schema[key].dataType), *[T.StructField(n, t) for n, t in fields]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = pafs.FileSystem.from_uri(folder)
        part = TaskContext.get().partitionId()
        out, name, at, held = None, "", 0, {}
        for batch in chunks(batches, "text"):
            rows = []
            for text_ in batch.column("text").to_pylist():
                raw = (text_ or "").encode()
                payload = payload_of(raw)
                digest = hashlib.sha256(payload).hexdigest()
                if digest not in held:
                    if out is None:
                        fs.create_dir(path, recursive=True)
                        name, at = f"{part:06d}-{uuid.uuid4().hex}.tar", 0
                        out = fs.open_output_stream(f"{path}/{name}")
                    data = to_png(payload)
                    info = tarfile.TarInfo(f"{digest[:2]}/{digest}.png")
                    info.size = len(data)
                    head = info.tobuf(tarfile.USTAR_FORMAT)
                    out.write(head)
                    out.write(data)
                    out.write(b"\0" * (-len(data) % 512))
                    held[digest] = (f"{folder}/{name}", at + len(head), len(data))
                    at += len(head) + len(data) + -len(data) % 512
                rows.append((len(raw), digest, *held[digest]))
                if at > SHARD_BYTES:
                    out.write(b"\0" * 1024)
                    out.close()
                    out, held = None, {}
            cols = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([batch.column("key"), *[pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()), strict=True)]], names=schema.names)
        if out is not None:
            out.write(b"\0" * 1024)
            out.close()

    # written out: shards are made once, and rows refer to those of committed tasks
    return staged(df.select(key, text).toDF("key", "text").mapInArrow(run, schema), "media-rows")


class Shards:
    """Range reads; the file read last stays open."""

    def __init__(self) -> None:
        self.name, self.file = None, None

    def read(self, shard: str, offset: int, n: int) -> bytes:
        if shard != self.name:
            if self.file is not None:
                self.file.close()
            fs, path = pafs.FileSystem.from_uri(shard)
            self.name, self.file = shard, fs.open_input_file(path)
        return self.file.read_at(n, offset)


def _reading(rows: DataFrame, added: list[tuple[str, T.DataType]], size, one) -> DataFrame:
    """``rows`` with columns that ``one`` makes from the first ``size(length)`` stored bytes; consecutive equal members are read once."""
    schema = T.StructType([*rows.schema.fields, *[T.StructField(n, t) for n, t in added]])
    arrow = [pa.int64() if isinstance(t, T.LongType) else pa.string() for _, t in added]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards, last, made = Shards(), None, None
        for batch in batches:
            found = []
            for place in zip(*[batch.column(c).to_pylist() for c in ("shard", "offset", "length")], strict=True):
                if place != last:
                    last, made = place, one(shards.read(place[0], place[1], size(place[2])))
                found.append(made)
            cols = list(zip(*found, strict=True)) or [()] * len(arrow)
            yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(c, t) for c, t in zip(cols, arrow, strict=True)]], names=schema.names)

    return rows.mapInArrow(run, schema)


def metadata(rows: DataFrame) -> DataFrame:
    """Stored rows with width, height, bit_depth and colour_type, by header-only range reads."""
    return _reading(rows, [(n, T.LongType()) for n in ("width", "height", "bit_depth", "colour_type")], lambda _: HEADER_BYTES, header)


def describe(data: bytes) -> tuple:
    """payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256 and feature of stored bytes.

    The feature is the image's size with its average hash: one bit a column, set where the column's mean
    exceeds the image's."""
    payload = from_png(data)
    samples = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    sums = samples.sum(axis=0, dtype=np.int64)
    bits = np.packbits(sums * WIDTH > sums.sum()).tobytes().hex()
    return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(data), hashlib.sha256(data).hexdigest(), f"{WIDTH}x{len(samples)}:{bits}"


def features(rows: DataFrame) -> DataFrame:
    """Stored rows with what ``describe`` makes of the bytes read back."""
    longs = {"payload_bytes", "tail_crc32", "media_bytes"}
    names = ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
    return _reading(rows, [(n, T.LongType() if n in longs else T.StringType()) for n in names], lambda n: n, describe)
